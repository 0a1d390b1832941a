"""Labels of stations, placed in towns that Spark lays out from the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as L
from ..registry import query
from .tables import table

GAP, SIZE = 0.5, 12.0
BOX = ", ".join(
    f"{{'ord': {i}, 'cost': {cost}::DOUBLE, 'x0': x + {a} * hw + {b} * w + {c} * h, 'y0': y + {d} * hw + {e} * w + {f} * h}}" for i, ((a, b, c), (d, e, f), _, cost) in enumerate(L.PLACES)
)


def town_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, markers and lines: forty stations a town, towns far apart; a line runs under every fourth."""
    k, n = F.col("p_partkey"), F.floor(F.col("p_partkey") / 40)
    s = table(spark, d, "part").select(k.alias("label"), (n % 1000 * 200.0 + k * 37 % 61).alias("x"), (F.floor(n / 1000) * 200.0 + k * 53 % 47).alias("y"), (k * 7 % 5).alias("priority"), (k % 9 + 3.0).alias("w"))
    s = s.withColumns({"half_w": F.lit(0.5), "half_h": F.lit(0.5), "h": F.lit(1.8)})
    at = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    markers = s.select(F.array(at(-0.5, -0.5), at(0.5, -0.5), at(0.5, 0.5), at(-0.5, 0.5)).alias("poly"))
    lines = s.filter("label % 4 = 0").select((F.col("x") - 6).alias("ax"), F.col("y").alias("ay"), (F.col("x") + 6).alias("bx"), F.col("y").alias("by"), F.lit(0.4).alias("r"))
    return s, markers, lines


@query(
    "G23 T02",
    f"""WITH RECURSIVE s AS (
      SELECT p_partkey AS label, p_partkey // 40 AS town, (p_partkey // 40 % 1000) * 200.0::DOUBLE + p_partkey * 37 % 61 AS x, (p_partkey // 40 // 1000) * 200.0::DOUBLE + p_partkey * 53 % 47 AS y,
        p_partkey * 7 % 5 AS priority, p_partkey % 9 + 3 + {2 * L.PAD}::DOUBLE AS w, 1.8 + {2 * L.PAD}::DOUBLE AS h, 0.5 + {GAP}::DOUBLE AS hw FROM part
    ), c AS (SELECT label, town, x, y, priority, w, h, unnest([{BOX}]) AS c FROM s
    ), b AS (SELECT label, town, c.ord AS ord, c.cost AS cost, c.x0 AS x0, c.y0 AS y0, c.x0 + w AS x1, c.y0 + h AS y1 FROM c
    ), m AS (
      SELECT DISTINCT b.label, b.ord FROM b JOIN s ON b.town = s.town AND x0 <= s.x + 0.5 AND s.x - 0.5 <= x1 AND y0 <= s.y + 0.5 AND s.y - 0.5 <= y1
    ), l AS (
      SELECT b.label, b.ord, greatest(s.x - 6 - x1, x0 - s.x - 6, 0) AS dx, greatest(s.y - y1, y0 - s.y, 0) AS dy FROM b JOIN s ON b.town = s.town AND s.label % 4 = 0
    ), n AS (SELECT label, ord, count(*) FILTER (sqrt(dx * dx + dy * dy) < 0.4) AS onit, count(*) FILTER (sqrt(dx * dx + dy * dy) >= 0.4 AND sqrt(dx * dx + dy * dy) < 0.4 + {L.NEAR_BY}) AS nearby FROM l GROUP BY 1, 2
    ), f AS (
      SELECT town, label, list({{'rank': CASE WHEN cost + {L.NEAR} * coalesce(nearby, 0) < {L.AT_ONCE} THEN -1 ELSE cost + {L.NEAR} * coalesce(nearby, 0) END, 'ord': ord, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) AS places
      FROM b LEFT JOIN n USING (label, ord) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.label = b.label AND m.ord = b.ord) AND coalesce(onit, 0) = 0 GROUP BY 1, 2
    ), t AS (SELECT f.*, row_number() OVER (PARTITION BY f.town ORDER BY priority DESC, y DESC, label) AS turn, count(*) OVER (PARTITION BY f.town) AS n FROM f JOIN s USING (label)
    ), went AS (
      SELECT town, 0 AS turn, CAST([] AS STRUCT(rank DOUBLE, ord INTEGER, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS boxes, CAST(NULL AS BIGINT) AS label, CAST(NULL AS INTEGER) AS place FROM t GROUP BY town
      UNION ALL
      SELECT town, turn, CASE WHEN got IS NULL THEN boxes ELSE list_append(boxes, got) END, label, got.ord FROM (
        SELECT w.town, t.turn, w.boxes, t.label, list_sort(list_filter(t.places, lambda p: len(list_filter(w.boxes, lambda q: p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1)) = 0))[1] AS got
        FROM went w JOIN t ON t.town = w.town AND t.turn = w.turn + 1
      )
    ) SELECT label, place FROM went WHERE place IS NOT NULL""",
)
def label_placement(spark: SparkSession, d: str) -> DataFrame:
    """Which of its places each label takes."""
    s, markers, lines = town_labels(spark, d)
    cands = L.candidates(s, GAP, turned=False)
    far = 1e9
    free = L.free_places(cands, markers, lines, (-far, -far, far, far), GAP, SIZE)
    got = L.place(s, free, SIZE)
    return got.join(cands.select("label", "x", "y", "ord").hint("merge"), ["label", "x", "y"]).select("label", F.col("ord").cast("int").alias("place"))
