"""Benchmark decontamination by templates.

A text becomes a template: numbers, units after numbers and names (capitalised
words inside a sentence) turn into typed placeholders, all other words are
lower-cased, punctuation goes. Windows of a few template words are hashed and
joined with the benchmark's. A question asked again with other numbers or names
has the same template; whether it really is that question is told by its slots:
along one alignment, each value of the benchmark must stand for one value of
the document, and each name or unit of the document for one of the benchmark
(two numbers may become equal by chance). Windows of inconsistent alignments do
not count. A document is contaminated by an item if it holds enough of the
item's windows.

Windows that are half placeholders or more say too little as templates; they
are compared by their raw words, and count for items that have more of them than
of others. Items shorter than a window are one window of raw words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, let, rows_over, scratch, table, with_key

WIDTH, COVERAGE = 6, 0.5
#: Items of fewer words than this are in too many texts to tell anything; ``unfindable`` lists them.
LEAST = 3
#: Benchmarks of up to this many windows are sent to all tasks (some 40 MB); larger ones are joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Sentence ends with the word after them, words, numbers.
TOKEN = r'[.!?:;\n"][^\p{L}\p{N}\n.!?:;"]*\p{L}+|\p{L}+|[0-9]+(?:[.,][0-9]+)*'
NUMBER, UNIT, NAME = "<n>", "<u>", "<name>"
UNITS = "mm cm m km in ft yd mi g kg mg t lb lbs oz l ml s sec min h hr hrs hour hours day days week weeks month months year years percent usd eur gbp dollars euros cents kmh mph kw kwh w v a hz".split()


def _template(tokens: Column) -> Column:
    """Template words of an array of raw tokens. A number sorts below ':', a sentence start below 'A', letters above."""

    def is_number(t: Column) -> Column:
        return (t >= "0") & (t < ":")

    def one(t: Column, i: Column) -> Column:
        low = F.lower(t)
        after_number = (i > 0) & F.coalesce(is_number(F.get(tokens, i - 1)), F.lit(False))
        head, tail = F.substring(t, 1, 1), F.substring(t, 2, 1_000_000_000)
        name = (F.length(t) > 1) & (head != F.lower(head)) & (tail == F.lower(tail))
        return (
            F.when(is_number(t), NUMBER)
            .when(t < "A", F.lower(F.regexp_replace(t, r"^[^\p{L}]+", "")))
            .when(after_number & low.isin(*UNITS), UNIT)
            .when(((t < "a") | (t >= "{")) & name, NAME)
            .otherwise(low)
        )

    return F.transform(tokens, one)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _plain(tokens: Column) -> Column:
    """Raw words as they are compared: lower-cased, without what comes before the first word of a sentence."""
    return F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, r"^[^\p{L}0-9]+", "")))


def windows(text: Column, width: int = WIDTH) -> Column:
    """An array of (hash, slots, dense) of all template windows; slots are the raw values under placeholders. A dense window, half placeholders or more, is hashed by its raw words and has no slots."""

    def of(raw: Column, tm: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(tm) - (width - 1))
        none = F.array().cast("array<string>")

        def one(h: Column, slots: Column, dense: Column) -> Column:
            return F.struct(h.alias("h"), slots.alias("slots"), dense.alias("dense"))

        def plain(i: Column) -> Column:
            return one(F.xxhash64(F.slice(tm, i, width)), none, F.lit(False))

        def slotted(i: Column) -> Column:
            slots = F.filter(F.slice(raw, i, width), lambda _, j: F.get(tm, i + j - 1).isin(NUMBER, UNIT, NAME))
            by_raw = F.xxhash64(F.lit("raw"), _plain(F.slice(raw, i, width)))
            return let(slots, lambda s: F.when(F.size(s) * 2 < width, one(F.xxhash64(F.slice(tm, i, width)), s, F.lit(False))).otherwise(one(by_raw, none, F.lit(True))))

        any_slot = F.array_contains(tm, NUMBER) | F.array_contains(tm, NAME)
        return F.when(F.size(tm) >= width, F.when(any_slot, F.transform(at, slotted)).otherwise(F.transform(at, plain)))

    return let(_tokens(text), lambda raw: let(_template(raw), lambda tm: of(raw, tm)))


def raw_windows(text: Column, width: int) -> Column:
    """As windows, all by their raw words."""
    none = F.array().cast("array<string>")

    def of(raw: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(raw) - (width - 1)), lambda i: F.struct(F.xxhash64(F.lit(width), F.slice(raw, i, width)).alias("h"), none.alias("slots"), F.lit(True).alias("dense")))
        return F.when(F.size(raw) >= width, each)

    return let(_plain(_tokens(text)), of)


def unfindable(benchmark: DataFrame) -> DataFrame:
    """benchmark(item_id, text, ...) -> the item_id of items that have too few words to be looked for."""
    return benchmark.filter(F.size(_tokens(F.col("text"))) < LEAST).select("item_id")


def _item_windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, list[int]]:
    """(item_id, i_at, h, i_slots) of the windows that count, and the lengths of the items that are shorter than a window."""

    def rows(df: DataFrame, w: Column) -> DataFrame:
        return df.select("item_id", F.posexplode(w).alias("i_at", "w")).select("item_id", "i_at", F.col("w.h").alias("h"), F.col("w.slots").alias("i_slots"), F.col("w.dense").alias("dense"))

    sized = benchmark.withColumn("__nl_n", F.size(_tokens(F.col("text"))))
    short = sorted(r[0] for r in sized.filter(F.col("__nl_n").between(LEAST, width - 1)).select("__nl_n").distinct().collect())
    every = rows(benchmark, windows(F.col("text"), width))
    mostly = every.groupBy("item_id").agg((2 * F.count_if(~F.col("dense")) >= F.count("*")).alias("sparse")).withColumnRenamed("item_id", "__nl_item")
    found = every.join(mostly, F.col("item_id").eqNullSafe(F.col("__nl_item"))).filter("not sparse or not dense").select("item_id", "i_at", "h", "i_slots")
    for n in short:
        found = found.unionByName(rows(sized.filter(F.col("__nl_n") == n), raw_windows(F.col("text"), n)).drop("dense"))
    return scratch(found, "benchmark"), short


def matches(keyed: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """keyed(KEY, text), benchmark(item_id, text) -> (KEY, item_id, n_windows, coverage) of contaminated documents."""
    items, short = _item_windows(benchmark, width)
    total = items.groupBy("item_id").agg(F.count("*").alias("n_all"))
    small = not rows_over(items, broadcast_rows)

    def hits_of(w: Column) -> DataFrame:
        rows = keyed.select(*KEY, F.posexplode(w).alias("d_at", "w")).select(*KEY, "d_at", F.col("w.h").alias("h"), F.col("w.slots").alias("d_slots"))
        found = rows.join(F.broadcast(items) if small else items, "h")
        return found.select(*KEY, "item_id", "i_at", (F.col("d_at") - F.col("i_at")).alias("shift"), "d_slots", "i_slots")

    hits = hits_of(windows(F.col("text"), width))
    for n in short:
        hits = hits.unionByName(hits_of(raw_windows(F.col("text"), n)))
    hits = scratch(hits, "hits")

    slots = hits.filter("size(i_slots) > 0").select(*KEY, "item_id", "shift", F.explode(F.arrays_zip("i_slots", "d_slots")).alias("z"))
    slots = slots.select(*KEY, "item_id", "shift", F.lower("z.i_slots").alias("i"), F.lower("z.d_slots").alias("d")).distinct()
    by = [*KEY, "item_id", "shift"]
    number = (F.col("d") >= "0") & (F.col("d") < ":")
    wrong = slots.groupBy(*by, "i").agg(F.count("*").alias("n")).filter("n > 1").select(*by)
    wrong = wrong.unionByName(slots.filter(~number).groupBy(*by, "d").agg(F.count("*").alias("n")).filter("n > 1").select(*by)).distinct()
    wrong = wrong.withColumnsRenamed({k: f"{k}_w" for k in by})
    cond = F.lit(True)
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_w"))
    good = hits.join(wrong, cond, "left_anti").select(*KEY, "item_id", "i_at").distinct().groupBy(*KEY, "item_id").agg(F.count("*").alias("n_windows"))
    total = total.withColumnRenamed("item_id", "__nl_item")
    out = good.join(total, F.col("item_id").eqNullSafe(F.col("__nl_item")))
    return out.filter(F.col("n_windows") >= coverage * F.col("n_all")).select(*KEY, "item_id", "n_windows", (F.col("n_windows") / F.col("n_all")).alias("coverage"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> doc_id, item_id, n_windows, coverage of each contamination.

    Null, empty and blank texts match nothing, nor do items of fewer than three
    words (see ``unfindable``). Texts are read whole, however long. Repeated rows are one document. Rows with a
    null id are found, and reported with it. Repeated items count apart if their
    ids differ; an item_id with several texts is taken as one item. Extra columns
    are ignored; an empty table on either side gives an empty result.
    """
    found = matches(with_key(docs.select("doc_id", "text")), benchmark.select("item_id", "text"), **how)
    return found.select(F.col(KEY[0]).alias("doc_id"), "item_id", "n_windows", "coverage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark item."""
    keyed = with_key(docs)
    found = matches(keyed.select(*KEY, "text"), benchmark.select("item_id", "text"), **how).select(*[F.col(k).alias(f"{k}_f") for k in KEY]).distinct()
    cond = F.lit(True)
    for k in KEY:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}_f"))
    return keyed.join(found, cond, "left_anti").select(*docs.columns)


_T = r"""regexp_extract_all(chr(10) || coalesce(text, ''), '[.!?:;\n"][^\p{L}\p{N}\n.!?:;"]*\p{L}+|\p{L}+|[0-9]+(?:[.,][0-9]+)*')"""
_UNITS = ", ".join(f"'{u}'" for u in UNITS)
ORACLE = rf"""
WITH a AS (
  SELECT 'd' AS side, doc_id AS id, {_T} AS ts FROM documents UNION ALL SELECT 'b', item_id, {_T} FROM benchmark
), b AS (SELECT side, id, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM a
), c AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY side, id ORDER BY i) BETWEEN '0' AND '9zzzz', false) AS after_number FROM b
), e AS (
  SELECT side, id, i, t, CASE WHEN t >= '0' AND t < ':' THEN '<n>' WHEN t < 'A' THEN lower(regexp_replace(t, '^[^\p{{L}}]+', ''))
    WHEN after_number AND lower(t) IN ({_UNITS}) THEN '<u>'
    WHEN (t < 'a' OR t >= '{{') AND length(t) > 1 AND t[1] <> lower(t[1]) AND t[2:] = lower(t[2:]) THEN '<name>' ELSE lower(t) END AS m FROM c
), l AS (SELECT side, id, list(t ORDER BY i) AS ts, list(m ORDER BY i) AS ms FROM e GROUP BY side, id
), l2 AS (SELECT side, id, ts, ms, list_transform(ts, lambda t: lower(regexp_replace(t, '^[^\p{{L}}0-9]+', ''))) AS ps FROM l
), w AS (
  SELECT side, id, i, ms[i:i+5] AS m, ps[i:i+5] AS p, list_filter(list_zip(ms[i:i+5], ts[i:i+5]), lambda z: z[1] IN ('<n>', '<u>', '<name>')) AS slots
  FROM (SELECT side, id, ts, ms, ps, unnest(range(1, len(ms) - 4)) AS i FROM l2 WHERE len(ms) >= 6)
), every AS (SELECT side, id, i, len(slots) * 2 >= 6 AS dense, CASE WHEN len(slots) * 2 < 6 THEN 'T ' || array_to_string(m, ' ') ELSE 'R ' || array_to_string(p, ' ') END AS m, CASE WHEN len(slots) * 2 < 6 THEN slots ELSE [] END AS slots FROM w
), mostly AS (SELECT id, 2 * count(*) FILTER (NOT dense) >= count(*) AS sparse FROM every WHERE side = 'b' GROUP BY id
), widths AS (SELECT DISTINCT len(ps) AS n FROM l2 WHERE side = 'b' AND len(ps) BETWEEN 3 AND 5
), short AS (
  SELECT side, id, i, n || array_to_string(ps[i:i+n-1], ' ') AS m, [] AS slots FROM (SELECT side, id, ps, n, unnest(range(1, len(ps) - n + 2)) AS i FROM l2, widths WHERE (side = 'd' AND len(ps) >= n) OR len(ps) = n)
), v AS (
  SELECT side, id, i, m, slots FROM every LEFT JOIN mostly USING (id) WHERE side = 'd' OR NOT sparse OR NOT dense UNION ALL SELECT side, id, i, m, slots FROM short
), h AS (
  SELECT x.id AS doc_id, y.id AS item_id, y.i, x.i - y.i AS shift, x.slots AS ds, y.slots AS bs FROM v x JOIN v y ON x.m = y.m AND x.side = 'd' AND y.side = 'b'
), s AS (SELECT DISTINCT doc_id, item_id, shift, lower(unnest(bs)[2]) AS b, lower(unnest(ds)[2]) AS d FROM h
), wrong AS (SELECT DISTINCT doc_id, item_id, shift FROM (SELECT doc_id, item_id, shift, b FROM s GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT doc_id, item_id, shift, d FROM s WHERE NOT (d >= '0' AND d < ':') GROUP BY ALL HAVING count(*) > 1)
), n AS (SELECT doc_id, item_id, count(DISTINCT i) AS n FROM h ANTI JOIN wrong USING (doc_id, item_id, shift) GROUP BY ALL
), total AS (SELECT id AS item_id, count(*) AS n_all FROM v WHERE side = 'b' GROUP BY 1)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_windows, CAST(n AS DOUBLE) / n_all AS coverage FROM n JOIN total USING (item_id) WHERE n >= 0.5 * n_all
"""
