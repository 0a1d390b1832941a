"""Readers: saved network and route JSON, machine command text, markup. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = """elements ARRAY<STRUCT<type STRING, id BIGINT, lat DOUBLE, lon DOUBLE, tags MAP<STRING,STRING>,
    members ARRAY<STRUCT<type STRING, ref BIGINT, role STRING>>, nodes ARRAY<BIGINT>>>"""
NETWORK = """query STRING, displayName STRING, modes ARRAY<STRING>, interchanges ARRAY<ARRAY<STRING>>,
    lines ARRAY<STRUCT<id STRING, ref STRING, name STRING, color STRING, mode STRING, network STRING, operator STRING, sequences ARRAY<ARRAY<STRING>>, members ARRAY<STRING>>>,
    stations ARRAY<STRUCT<id STRING, name STRING, nameEn STRING, lat DOUBLE, lon DOUBLE, lines ARRAY<STRING>, osmIds ARRAY<BIGINT>>>"""

#: Roles of stops and platforms, entry-only and exit-only ones included.
STOP, PLATFORM = r"^(stop|stop_entry_only|stop_exit_only)$", r"^(platform|platform_entry_only|platform_exit_only)$"
MODE_TIERS = {"subway": 1, "light_rail": 2, "tram": 2}


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a saved answer: one per node, relation or way, with its place in the file."""
    raw = spark.read.schema(ELEMENTS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.posexplode("elements").alias("ord", "e")).select("ord", "e.*")


def network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, line_stops, stations) of a saved network."""
    raw = spark.read.schema(NETWORK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    lines = raw.select(F.posexplode("lines").alias("line_ord", "l")).select("line_ord", "l.*").withColumnRenamed("id", "line_id")
    stops = lines.select("line_id", F.posexplode("sequences").alias("seq_no", "s")).select("line_id", "seq_no", F.posexplode("s").alias("ord", "station_id"))
    stations = raw.select(F.explode("stations").alias("s")).select("s.*").withColumnRenamed("id", "station_id")
    return lines.drop("sequences"), stops, stations


def command_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of machine command files; whole files, so that lines keep their numbers."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return t.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "raw")).select("file", (F.col("n") + 1).cast("long").alias("line_no"), "raw")


def routes(el: DataFrame, modes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(routes, route_stops) of the wanted modes.

    Trains and other operators' trams stay only if they belong to the city's own
    networks: those of its subways, or else of its light rail and trams. Stops
    are nodes in a stop role; with fewer than two of them, those in a platform role; else
    all nodes with a name; routes with fewer than two are dropped. The last master wins.
    """
    rel = el.filter("type = 'relation'").withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))
    r = rel.filter("tags['type'] = 'route'")
    parts = F.filter(F.transform(F.split(F.concat_ws(";", F.col("tags")["network"], F.col("tags")["operator"]), "[;,]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    r = r.filter(F.col("tags")["route"].isin(modes)).withColumns({"mode": F.col("tags")["route"], "keys": parts})
    tier = F.coalesce(*[F.when(F.col("mode") == m, F.lit(t)) for m, t in MODE_TIERS.items()])
    named = r.withColumn("tier", tier).filter("tier is not null and size(keys) > 0")
    local = named.groupBy("tier").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("local")).agg(F.min_by("local", "tier").alias("local"))
    r = r.join(F.broadcast(local))  # one row: the names of the city's own operators
    near = lambda k, n: (k == n) | ((F.length(n) > 3) & (F.contains(k, n) | F.contains(n, k)))
    own = F.exists("keys", lambda k: F.exists(F.coalesce("local", F.array().cast("array<string>")), lambda n: near(k, n)))
    service = F.coalesce(F.col("tags")["service"], F.lit("")).rlike("^(commuter|regional|suburban|urban)$")
    called = F.concat_ws(" ", F.col("tags")["network"], F.col("tags")["name"]).rlike("(?i)regional|commuter|s-bahn|rer|cercan[ií]as|suburbano")
    is_local = own | (F.col("local").isNull() & (service | called))
    other = ~F.col("mode").isin("subway", "train") & F.col("local").isNotNull() & F.col("tags")["network"].isNotNull() & ~is_local
    r = r.filter(~((F.col("mode") == "train") & ~is_local) & ~other)
    nodes = el.filter("type = 'node'").groupBy(F.col("id").alias("ref")).agg(F.max_by(F.coalesce(F.col("tags")["name"], F.lit("")), "ord").alias("node_name"))
    m = r.select(F.col("id").alias("route_id"), F.posexplode("members").alias("n", "m")).select("route_id", "n", "m.*").filter("type = 'node'").join(nodes, "ref")
    kind = F.when(F.col("role").rlike(STOP), 1).when(F.col("role").rlike(PLATFORM), 2)
    has = m.withColumn("kind", kind).groupBy("route_id").agg(F.count_if(F.col("kind") == 1).alias("n1"), F.count_if(F.col("kind") == 2).alias("n2"), F.count_if(F.col("node_name") != "").alias("n3"))
    has = has.select("route_id", F.when(F.col("n1") >= 2, 1).when(F.col("n2") >= 2, 2).when(F.col("n3") >= 2, 3).alias("use")).filter("use is not null")
    stops = m.withColumn("kind", kind).join(has, "route_id").filter((F.col("kind") == F.col("use")) | ((F.col("use") == 3) & (F.col("node_name") != "")))
    masters = rel.filter("tags['type'] = 'route_master'").select("ord", F.col("id").alias("master_id"), F.explode("members").alias("m")).filter("m.type = 'relation'")
    masters = masters.groupBy(F.col("m.ref").alias("route_id")).agg(F.max_by("master_id", "ord").alias("master_id"))
    kept = r.withColumnRenamed("id", "route_id").join(has.select("route_id"), "route_id", "left_semi").join(masters, "route_id", "left")
    return kept.select("route_id", "ord", "mode", "tags", "master_id"), stops.select("route_id", F.col("n").alias("ord"), F.col("ref").alias("node_id"), "node_name")
