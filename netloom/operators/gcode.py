"""Machine command logs: tokens, modal state, safety checks and dry runs, all as windows over (file, line_no).

A file is one ordered sequence and is what a window is partitioned by; a
directory of files spreads over tasks. A line is a row (file, line_no, raw).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Commands that are known, and those that a print file must never hold.
KNOWN = ["G0", "G1", "G4", "G28", "G29", "G90", "G91", "G92", "M17", "M73", "M82", "M83", "M84", "M104", "M105", "M106", "M107", "M109", "M117", "M140", "M190", "M204", "M205", "M220", "M221", "M400", "M600", "M900", "T0"]
FORBIDDEN = ["M112", "M500", "M502", "M303", "M92", "M301", "M304", "M851", "M206", "M428", "M999", "M997", "M1000", "M1002", "M1003", "M976"]

LETTERS = "XYZEFS"
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
#: Messages of a kind that a file reports; what is beyond them is counted.
CAPS = {"outside": 5, "feed": 3, "flow": 3, "cold": 3, "before_homing": 1}
MESSAGES = 40


@dataclass(frozen=True)
class Printer:
    bed_x: float
    bed_y: float
    bed_z: float
    max_speed: float = 250.0
    travel_speed: float = 250.0
    max_nozzle: float = 300.0
    max_bed: float = 110.0
    filament_diameter: float = 1.75
    max_flow: float = 20.0


def parse(lines: DataFrame) -> DataFrame:
    """Adds cmd and the number after each of the letters X Y Z E F S (null where there is none); comments are cut off."""
    text = F.trim(F.regexp_replace("raw", ";.*", ""))
    parts = F.split(text, r"\s+")
    out = lines.withColumns({"text": text, "cmd": F.when(text != "", F.upper(F.get(parts, 0)))})

    def of(letter: str) -> Column:
        own = F.filter(F.slice(parts, 2, F.size(parts)), lambda t: F.upper(t).startswith(letter) & F.regexp_like(F.substring(t, 2, 64), F.lit("^" + NUMBER)))
        return own

    for c in LETTERS:
        own = of(c)
        out = out.withColumn(c.lower(), F.regexp_extract(F.substring(F.get(own, F.size(own) - 1), 2, 64), "^" + NUMBER, 0).cast("double"))
    return out


def _run(df: DataFrame):
    return Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def _position(df: DataFrame, name: str, set_to: Column, add: Column) -> DataFrame:
    """A running value: set where set_to is not null, else moved by add."""
    seg = F.sum(F.when(set_to.isNotNull(), 1).otherwise(0)).over(_run(df))
    df = df.withColumn(f"_{name}", seg)
    w = Window.partitionBy("file", f"_{name}").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(set_to, add, F.lit(0.0))).over(w)).drop(f"_{name}")


def replay(lines: DataFrame) -> DataFrame:
    """Modal state after each line: absolute modes, homed, feed (mm/s), heater targets, position, extruded length of the move (de), layer and skirt marks."""
    p = parse(lines)
    run = _run(p)
    bare = F.trim("raw")
    mode = lambda on, off: F.coalesce(F.last(F.when(F.col("cmd") == on, True).when(F.col("cmd") == off, False), True).over(run), F.lit(True))
    move = F.col("cmd").isin("G0", "G1")
    axis = F.col("x").isNotNull() | F.col("y").isNotNull() | F.col("z").isNotNull()
    p = p.withColumns({"abs_xyz": mode("G90", "G91"), "abs_e": mode("M82", "M83"), "is_move": F.coalesce(move & axis, F.lit(False)), "extrudes": F.coalesce(move & F.col("e").isNotNull(), F.lit(False))})
    p = p.withColumns(
        {
            "homed": F.coalesce(F.max(F.col("cmd") == "G28").over(run), F.lit(False)),
            "feed": F.coalesce(F.last(F.when(move, F.col("f") / 60), True).over(run), F.lit(0.0)),
            "nozzle": F.coalesce(F.last(F.when(F.col("cmd").isin("M104", "M109"), F.coalesce("s", F.lit(0.0))), True).over(run), F.lit(0.0)),
            "bed": F.coalesce(F.last(F.when(F.col("cmd").isin("M140", "M190"), F.coalesce("s", F.lit(0.0))), True).over(run), F.lit(0.0)),
            "layer": F.sum(F.when(bare.startswith(";LAYER:"), 1).otherwise(0)).over(run),
            "skirt": F.coalesce(F.last(F.when(bare.startswith(";TYPE:"), bare == ";TYPE:SKIRT"), True).over(run), F.lit(False)),
        }
    )
    for c in "xyz":
        given = F.col(c)
        set_to = F.when(F.col("cmd") == "G28", F.lit(0.0)).when((F.col("cmd") == "G92") | (F.col("is_move") & F.col("abs_xyz")), given)
        p = _position(p, f"at_{c}", set_to, F.when(F.col("is_move"), given))
        p = p.withColumn(f"was_{c}", F.coalesce(F.lag(f"at_{c}").over(Window.partitionBy("file").orderBy("line_no")), F.lit(0.0)))
    set_e = F.when((F.col("cmd") == "G92") | (F.col("extrudes") & F.col("abs_e")), F.col("e"))
    p = _position(p, "at_e", set_e, F.when(F.col("extrudes"), F.col("e")))
    was_e = F.coalesce(F.lag("at_e").over(Window.partitionBy("file").orderBy("line_no")), F.lit(0.0))
    return p.withColumn("de", F.when(F.col("extrudes"), F.when(F.col("abs_e"), F.col("e") - was_e).otherwise(F.col("e"))).otherwise(0.0))


def findings(lines: DataFrame, printer: Printer) -> DataFrame:
    """(file, line_no, severity, kind, value): all breaches, before caps. line_no is null for those of a whole file."""
    r = replay(lines)
    known, forbidden = F.col("cmd").isin(KNOWN), F.col("cmd").isin(FORBIDDEN)
    d = F.sqrt(F.pow(F.col("at_x") - F.col("was_x"), 2) + F.pow(F.col("at_y") - F.col("was_y"), 2))
    r = r.withColumn("d", d).withColumn("out", F.col("is_move") & (F.col("de") > 0))
    area, fastest, tol = math.pi * (printer.filament_diameter / 2) ** 2, max(printer.max_speed, printer.travel_speed) * 1.05, 0.01
    flow = F.when(F.col("d") > 0, F.col("de") * area * F.col("feed") / F.col("d"))
    ratio = F.when(F.col("d") > 0, F.col("de") / F.col("d"))
    rules = [
        ("error", "forbidden", forbidden, F.lit(None).cast("double")),
        ("error", "nozzle_limit", F.col("cmd").isin("M104", "M109") & (F.coalesce("s", F.lit(0.0)) > printer.max_nozzle), F.col("s")),
        ("error", "bed_limit", F.col("cmd").isin("M140", "M190") & (F.coalesce("s", F.lit(0.0)) > printer.max_bed), F.col("s")),
        ("error", "before_homing", F.col("is_move") & ~F.col("homed"), F.lit(None).cast("double")),
        ("error", "feed", F.col("cmd").isin("G0", "G1") & F.col("f").isNotNull() & (F.col("f") / 60 > fastest), F.col("f") / 60),
        ("error", "outside", F.col("is_move") & ((F.col("at_x") < -tol) | (F.col("at_x") > printer.bed_x + tol) | (F.col("at_y") < -tol) | (F.col("at_y") > printer.bed_y + tol)), F.col("at_x")),
        ("error", "below_bed", F.col("is_move") & (F.col("at_z") < -tol), F.col("at_z")),
        ("error", "too_high", F.col("is_move") & (F.col("at_z") > printer.bed_z + tol), F.col("at_z")),
        ("warning", "flow", F.col("out") & (F.col("feed") > 0) & (flow > printer.max_flow), flow),
        ("error", "implausible_extrusion", F.col("out") & (ratio > 0.6), ratio),
        ("error", "cold", F.col("out") & (F.col("nozzle") < 150), F.col("nozzle")),
        ("error", "on_bed", F.col("out") & (F.col("at_z") <= 0.05), F.col("at_z")),
    ]
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), v.cast("double").alias("value"))) for s, k, c, v in rules]), lambda x: x.isNotNull())
    by_line = r.select("file", "line_no", F.inline(hits))
    s = r.groupBy("file").agg(
        F.max_by("nozzle", "line_no").alias("nozzle"), F.max_by("bed", "line_no").alias("bed"), F.max(F.col("homed") | F.col("is_move")).alias("homed"), F.max("layer").alias("layers"),
        F.sum(F.when(F.col("de") > 0, F.col("de")).otherwise(0.0)).alias("filament"), F.count_if(F.col("cmd").isNotNull() & ~known & ~forbidden).alias("unknown"),
    )
    ends = [
        ("warning", "unknown_commands", F.col("unknown") > 0, F.col("unknown")), ("error", "nozzle_left_on", F.col("nozzle") != 0, F.col("nozzle")), ("error", "bed_left_on", F.col("bed") != 0, F.col("bed")),
        ("error", "never_homed", ~F.col("homed"), F.lit(None)), ("error", "no_layers", F.col("layers") == 0, F.lit(None)), ("error", "no_filament", F.col("filament") <= 0, F.lit(None)),
    ]
    whole = F.filter(F.array(*[F.when(c, F.struct(F.lit(a).alias("severity"), F.lit(k).alias("kind"), v.cast("double").alias("value"))) for a, k, c, v in ends]), lambda x: x.isNotNull())
    return by_line.unionByName(s.select("file", F.lit(None).cast(dict(by_line.dtypes)["line_no"]).alias("line_no"), F.inline(whole)))


def check(lines: DataFrame, printer: Printer) -> DataFrame:
    """What a file's report lists: findings under the caps of their kinds, at most 40 of each severity, in order of lines."""
    f = findings(lines, printer)
    cap = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in CAPS.items() for x in (F.lit(k), F.lit(v))]), "kind"), F.lit(10**9))
    f = f.withColumn("_n", F.row_number().over(Window.partitionBy("file", "kind").orderBy(F.col("line_no").asc_nulls_last()))).filter(F.col("_n") <= cap)
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("file", "severity").orderBy(F.col("line_no").asc_nulls_last(), "kind"))).filter(F.col("n") <= MESSAGES)
    return f.drop("_n")


def dry_run(lines: DataFrame, lift: float = 20.0) -> DataFrame:
    """(file, line_no, raw): the same motion lifted, without heat, extrusion or pauses."""
    p = parse(lines)
    run = _run(p)
    absolute = F.coalesce(F.last(F.when(F.col("cmd") == "G90", True).when(F.col("cmd") == "G91", False), True).over(run), F.lit(True))
    moved = F.regexp_replace("text", r"(?i)\s*E-?\d*\.?\d+", "")
    z = F.regexp_extract(moved, r"(?i)Z(-?\d*\.?\d+)", 1)
    up = F.concat(F.regexp_extract(moved, r"(?i)^(.*?)Z-?\d*\.?\d+", 1), F.lit("Z"), F.format_string("%.3f", F.when(z != "", z.cast("double")) + lift), F.regexp_extract(moved, r"(?i)Z-?\d*\.?\d+(.*)$", 1))
    lifted = F.when(absolute & (z != ""), up).otherwise(moved)
    skipped = F.concat(F.lit("; dry run, skipped: "), "text")
    drop = F.col("cmd").isin("M109", "M190", "M600", "M106") | ((F.col("cmd") == "M400") & F.upper("text").contains("U1"))
    new = (
        F.when(F.col("cmd").isNull(), F.col("raw"))
        .when(F.col("cmd").isin("M104", "M140"), F.concat("cmd", F.lit(" S0 ; dry run: heater off (was: "), "text", F.lit(")")))
        .when(drop, skipped)
        .when(F.col("cmd").isin("G0", "G1"), F.when(F.trim(lifted).rlike("(?i)^G[01]$"), skipped).otherwise(lifted))
        .otherwise(F.col("raw"))
    )
    return p.select("file", "line_no", new.alias("raw"))
