import json

from pyspark.sql import functions as F

from netloom.operators import gcode
from netloom.sources import readers

PRINTER = gcode.Printer(200, 200, 200)
GOOD = "G28\nM104 S210\nG90\nM83\n;LAYER:0\nG1 X10 Y10 Z0.2 F3000\nG1 X50 Y10 E1.5\nG1 X50 Y50 E1.5\nM104 S0\n"
BAD = "G1 X5\nM104 S400\nM500\n;LAYER:0\nG28\nG91\nG1 X300 F99999\nG1 X1 E5\nM105 ; fine\nZ9"


def lines(spark, **files):
    rows = [(k, i + 1, x) for k, v in files.items() for i, x in enumerate(v.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no long, raw string")


def test_good_file_has_no_findings(spark):
    assert gcode.check(lines(spark, good=GOOD), PRINTER).collect() == []


def test_bad_file(spark):
    got = {(r["line_no"], r["kind"]) for r in gcode.check(lines(spark, bad=BAD), PRINTER).collect()}
    want = {(1, "before_homing"), (2, "nozzle_limit"), (3, "forbidden"), (7, "feed"), (7, "outside"), (8, "outside"), (8, "implausible_extrusion"), (8, "on_bed"), (8, "flow"), (None, "nozzle_left_on"), (None, "unknown_commands")}
    assert got == want


def test_caps(spark):
    far = "G28\n;LAYER:0\n" + "\n".join(f"G1 X{900 + i} Y1 Z1" for i in range(60))
    f = lines(spark, far=far)
    assert gcode.findings(f, PRINTER).filter("kind = 'outside'").count() == 60
    assert gcode.check(f, PRINTER).filter("kind = 'outside'").count() == 5


def test_relative_moves_add_up(spark):
    r = {x["line_no"]: x for x in gcode.replay(lines(spark, f="G28\nG90\nG1 X10 Y5\nG91\nG1 X3\nG1 X-1 Y2\nG92 X0\nG1 X4\nG90\nG1 X7 E2\nG1 X8 E3")).collect()}
    assert [r[i]["at_x"] for i in (3, 5, 6, 7, 8, 10)] == [10.0, 13.0, 12.0, 0.0, 4.0, 7.0] and r[6]["at_y"] == 7.0
    assert r[10]["de"] == 2.0 and r[11]["de"] == 1.0


def test_dry_run(spark):
    got = [r["raw"] for r in gcode.dry_run(lines(spark, f="M104 S210 ; hot\nM109 S210\nG1 X1 Z0.2 E3\nG1 E-1\nG91\nG1 Z1\n; note")).orderBy("line_no").collect()]
    assert got == ["M104 S0 ; dry run: heater off (was: M104 S210)", "; dry run, skipped: M109 S210", "G1 X1 Z20.200", "; dry run, skipped: G1 E-1", "G91", "G1 Z1", "; note"]


def test_command_files(spark, tmp_path):
    (tmp_path / "a.gcode").write_text("G28\r\nG90\n")
    got = readers.command_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["raw"]) for r in got] == [(1, "G28"), (2, "G90"), (3, "")]


def test_routes(spark, tmp_path):
    def rel(i, tags, members):
        return {"type": "relation", "id": i, "tags": tags, "members": [{"type": t, "ref": n, "role": r} for t, n, r in members]}

    el = [{"type": "node", "id": i, "lat": 1.0, "lon": 2.0, "tags": {"name": f"n{i}"} if i != 4 else {}} for i in range(1, 6)]
    el += [
        rel(10, {"type": "route", "route": "subway", "network": "City Metro"}, [("node", 1, "stop"), ("node", 2, "stop_exit_only"), ("way", 9, "")]),
        rel(11, {"type": "route", "route": "train", "operator": "City Metro; Other"}, [("node", 1, "platform"), ("node", 3, "platform"), ("node", 2, "stop")]),
        rel(12, {"type": "route", "route": "train", "operator": "Long Distance"}, [("node", 1, "stop"), ("node", 3, "stop")]),
        rel(13, {"type": "route", "route": "tram", "network": "Elsewhere"}, [("node", 1, "stop"), ("node", 3, "stop")]),
        rel(14, {"type": "route", "route": "subway"}, [("node", 1, ""), ("node", 4, ""), ("node", 5, "")]),
        rel(15, {"type": "route", "route": "subway"}, [("node", 99, "stop"), ("node", 1, "stop")]),
        rel(20, {"type": "route_master"}, [("relation", 10, "")]), rel(21, {"type": "route_master"}, [("relation", 10, "")]),
    ]
    (tmp_path / "x.json").write_text(json.dumps({"elements": el}))
    r, s = readers.routes(readers.elements(spark, str(tmp_path / "x.json")), ["subway", "train", "tram"])
    assert {(x["route_id"], x["master_id"]) for x in r.collect()} == {(10, 21), (11, None), (14, None)}
    got = {}
    for x in s.orderBy("ord").collect():
        got.setdefault(x["route_id"], []).append(x["node_id"])
    assert got == {10: [1, 2], 11: [1, 3], 14: [1, 5]}


def test_network_file(spark, tmp_path):
    n = {"query": "q", "lines": [{"id": "a", "ref": "A", "sequences": [["s", "t"], ["t", "s"]]}], "stations": [{"id": "s", "name": "S", "lat": 1.0, "lon": 2.0}, {"id": "t", "name": "T"}]}
    (tmp_path / "n.json").write_text(json.dumps(n))
    lines_, stops, stations = readers.network(spark, str(tmp_path / "n.json"))
    assert lines_.count() == 1 and stations.count() == 2
    assert [tuple(r) for r in stops.orderBy("seq_no", F.col("ord")).collect()] == [("a", 0, 0, "s"), ("a", 0, 1, "t"), ("a", 1, 0, "t"), ("a", 1, 1, "s")]
