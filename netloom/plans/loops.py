"""Loops of cut meshes and joined lines, over solids and lines that Spark builds from the stops of each pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linking
from ..registry import query
from .tables import STOPS, stops

#: Corners of a box, and its triangles with their outsides to the right hand: fixed by the corners' order.
CORNERS = [(-1, -1, 0), (1, -1, 0), (1, 1, 0), (-1, 1, 0), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]
FACES = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]
#: Triangles and planes that a stop becomes, in stops' worth of memory.
ROWS = 8
BOXES = f"{STOPS}, boxes AS (SELECT seq, ord, 8 - ord + (station % 10) / 25.0::DOUBLE AS half, 1 + station % 3 AS height FROM stops WHERE ord <= 7)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """The triangles of nested boxes, one for each stop of a pattern (its mesh), 1 to 3 high."""
    half = F.lit(8) - F.col("ord") + (F.col("station") % 10) / F.lit(25.0)
    b = stops(spark, d, ROWS).filter("ord <= 7").select("seq", "ord", half.alias("half"), (1 + F.col("station") % 3).cast("double").alias("height"))
    corner = lambda k: [(F.col("half") * CORNERS[k][0], "x"), (F.col("half") * CORNERS[k][1], "y"), (F.col("height") * CORNERS[k][2], "z")]
    tri = [F.struct(F.lit(i).alias("f"), *[v.alias(f"{c}{a}") for c, k in zip("abc", face, strict=True) for v, a in corner(k)]) for i, face in enumerate(FACES)]
    t = b.select(F.col("seq").alias("mesh"), "ord", F.explode(F.array(*tri)).alias("t"))
    return t.select("mesh", (F.col("ord") * 12 + F.col("t.f")).alias("id"), *[f"t.{c}{a}" for c in "abc" for a in "xyz"])


def box_segments(spark: SparkSession, d: str) -> tuple[DataFrame, bool]:
    """Where planes at z = 0, 1, 2 (each touches corners, and is moved) cut the boxes: (mesh, layer, seg, x1, y1, x2, y2); and whether a layer may have very many, as no triangle gives a layer two."""
    b = boxes(spark, d)
    large = not b.groupBy("mesh").count().filter(F.col("count") > linking.GROUP).isEmpty()
    return linking.plane_segments(b, 0.0, 1.0).select("mesh", "layer", (F.col("mesh") * 400 + F.col("layer") * 100 + F.col("id")).alias("seg"), "x1", "y1", "x2", "y2"), large


BY = ("mesh", "layer")
LAYERS = f"{BOXES}, cut AS (SELECT seq AS mesh, layer, ord, half FROM boxes, (SELECT unnest(range(0, 3)) AS layer) WHERE layer < height)"


@query("K07 F27", f"WITH {LAYERS} SELECT mesh, CAST(layer AS BIGINT) AS layer, count(*) AS loops, CAST(count(*) * 8 AS BIGINT) AS segments, CAST(sum(CAST(round(4 * half * half * 625) AS BIGINT)) AS BIGINT) AS area FROM cut GROUP BY 1, 2")
def layer_loops(spark: SparkSession, d: str) -> DataFrame:
    """Closed loops of each layer, their segments and areas (in 1/625), all left over ones missing."""
    segments, large = box_segments(spark, d)
    return linking.areas(segments, by=BY, large=large).groupBy(*BY).agg(F.count("*").alias("loops"), F.sum("n").alias("segments"), F.sum(F.round(F.col("area") * 625).cast("long")).alias("area"))


@query("K17", f"WITH {LAYERS} SELECT mesh, CAST(layer AS BIGINT) AS layer, ord, CAST(count(*) OVER (PARTITION BY mesh, layer ORDER BY ord) - 1 AS INT) AS depth FROM cut")
def loop_nesting(spark: SparkSession, d: str) -> DataFrame:
    """How deep each loop of a layer lies within others."""
    segments, large = box_segments(spark, d)
    n = linking.nested(segments, 4.0, by=BY, large=large)
    return n.select(*BY, F.floor(F.col("loop") % 100 / 12).alias("ord"), "depth")


PIECES = f"""{STOPS}, p AS (
  SELECT seq, ord, station, ord - row_number() OVER (PARTITION BY seq ORDER BY ord) AS run FROM stops WHERE station % 11 <> 0
)"""


@query(
    "J26 G09",
    f"""WITH {PIECES} SELECT seq, ord, min(ord) OVER (PARTITION BY seq, run) AS chain, row_number() OVER (PARTITION BY seq, run ORDER BY ord) - 1 AS pos, station % 2 = 1 AND count(*) OVER (PARTITION BY seq, run) > 1 AS flipped FROM p""",
)
def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of lines, drawn either way round, joined where their ends touch: chain, place in it, and whether a piece is turned."""
    s = stops(spark, d).filter("station % 11 <> 0")
    at = lambda o: (o * 10.0 + F.col("seq") % 7, (o * o % 5).cast("double"))
    (ax, ay), (bx, by), turned = at(F.col("ord") - 1), at(F.col("ord")), F.col("station") % 2 == 1
    pick = lambda a, b: F.when(turned, b).otherwise(a)
    pieces = s.select(F.col("seq").alias("grp"), (F.col("seq") * 100 + F.col("ord")).alias("piece"), pick(ax, bx).alias("x1"), pick(ay, by).alias("y1"), pick(bx, ax).alias("x2"), pick(by, ay).alias("y2"))
    j = linking.joined(pieces, 0.01)
    return j.select(F.col("grp").alias("seq"), (F.col("piece") % 100).alias("ord"), (F.col("chain") % 100).alias("chain"), "pos", "flipped")
