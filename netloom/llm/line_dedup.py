"""Line deduplication by a suffix array over line-id sequences, built by distributed prefix doubling.

A document is the sequence of its lines; only lines that occur at several
places take part, as no other line can lie in a repeated run. Suffixes are
ranked by their first line, then by 2, 4, 8, ... lines: in each round the
suffixes that still share a rank are sorted by the rank of the suffix that
begins so many lines further on, until all ranks differ. A rank is the place of
its group in the sorted order, so the last ranks are the suffix array, and the
suffixes that share a rank in round k are an interval whose longest common
prefixes (LCP) reach 2^k.

Two results are read off:
- later copies: in each interval of LCP ``min_lines`` the least position is the
  first copy; the lines under all others are deleted, as are later copies of
  single lines of at least ``min_words`` words;
- maximal runs: neighbours in the suffix array whose lines before differ. Their
  LCP is found by halving steps over the kept ranks. Neighbours have the longest
  match that there is, so these runs tell how long the longest repetition of each
  document is.

Sorting is done by sums of counts: how many suffixes sort before a group is a
sum in two levels (leading digits, then within them), so no window spans more
than a million digits or the groups under one. A rank that holds a thousandth
of all positions or more is one of a thousand at most; those are sent to all
tasks instead of being dealt to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, equal, lookup, scratch, with_key, words

MIN_LINES, MIN_WORDS = 4, 5
#: Bits of a rank below its leading digits.
LOW = 20
DOC = ["__nl_d1", "__nl_d2"]
POS = [*DOC, "__nl_at"]


def _before(counts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """counts(keys, top, order, n) with before: the sum of n over the rows of equal keys that sort earlier by (top, order)."""
    tops = counts.groupBy(*keys, "top").agg(F.sum("n").alias("m"))
    over = Window.partitionBy(*keys).orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "top", F.coalesce(F.sum("m").over(over), F.lit(0)).alias("__nl_b"))
    leaf = Window.partitionBy(*keys, "top").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("__nl_i", F.coalesce(F.sum("n").over(leaf), F.lit(0)))
    return inner.join(tops, [*keys, "top"]).withColumn("before", F.col("__nl_i") + F.col("__nl_b")).drop("__nl_i", "__nl_b")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _with_doc(keyed: DataFrame) -> DataFrame:
    """Adds the 128 bits that stand for a document: its id and text."""
    return keyed.withColumns({DOC[0]: F.xxhash64(*KEY), DOC[1]: F.xxhash64(F.lit("second"), *KEY)})


def _positions(docs: DataFrame, min_words: int) -> DataFrame:
    """docs(KEY, DOC, text) -> (POS, id, line, long, c1, c2): a row for each line with a word that occurs at another place too."""
    worded = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("n"), x.alias("x"))), lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(KEY[0]).alias("id"), *DOC, worded.alias("l")).select("id", *DOC, F.posexplode("l").alias(POS[2], "l"))
    rows = rows.select(*POS, "id", F.col("l.n").alias("line"), (F.size(words(F.col("l.x"))) >= min_words).alias("long"), F.xxhash64("l.x").alias("c1"), F.xxhash64(F.lit("second"), "l.x").alias("c2"))
    place = F.struct(*POS)
    classes = scratch(rows.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("z")).filter("a <> z").select("c1", "c2", "n"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    return scratch(lookup(rows, classes, ["c1", "c2"], total, POS).drop("n").distinct(), "lines")


def _first_ranks(lines: DataFrame, total: int) -> DataFrame:
    """lines(POS, c1, c2) -> (POS, r, size): ranks by the first line. Lines are ordered by their ids."""
    counts = lines.groupBy("c1", "c2").agg(F.count("*").alias("n")).withColumn("top", F.shiftright("c1", 52))
    starts = _before(counts, [], ["c1", "c2"]).select("c1", "c2", "n", F.col("before").alias("r"))
    return scratch(lookup(lines.select(*POS, "c1", "c2"), starts, ["c1", "c2"], total, POS).select(*POS, "r", F.col("n").alias("size")), "ranks")


def _doubled(ranks: DataFrame, step: int, total: int) -> DataFrame:
    """Ranks by twice as many lines. A suffix that ends within them sorts before the others of its rank, and is unlike any other."""
    open_ = ranks.filter("size > 1").select(*POS, "r")
    ahead = ranks.select(*[F.col(k).alias(f"{k}_a") for k in DOC], (F.col(POS[2]) - step).alias(f"{POS[2]}_a"), F.col("r").alias("r2"))
    rows = open_.join(ahead, equal(POS, [f"{k}_a" for k in POS]), "left")
    ends, zero = F.col("r2").isNull(), F.lit(0).cast("long")
    rows = rows.select(
        *POS,
        "r",
        F.when(ends, -1 - F.pmod(F.xxhash64(*POS), F.lit(1 << LOW))).otherwise(F.shiftright("r2", LOW)).alias("top"),
        F.when(ends, F.col(DOC[0])).otherwise(F.col("r2")).alias("o1"),
        F.when(ends, F.col(DOC[1])).otherwise(zero).alias("o2"),
        F.when(ends, F.col(POS[2]).cast("long")).otherwise(zero).alias("o3"),
    )
    key = ["o1", "o2", "o3"]
    counts = rows.groupBy("r", "top", *key).agg(F.count("*").alias("n"))
    places = _before(counts, ["r"], key).select("r", *key, "n", "before")
    new = lookup(rows.select(*POS, "r", *key), places, [*key, "r"], total, POS)
    new = new.select(*POS, (F.col("r") + F.col("before")).alias("r"), F.col("n").alias("size"))
    return scratch(ranks.filter("size = 1").unionByName(new), "ranks")


def suffix_ranks(lines: DataFrame, most: int | None = None) -> tuple[list[DataFrame], DataFrame, int]:
    """lines(POS, c1, c2) -> the ranks (POS, r) of each round as far as they are shared, the last ranks (POS, r), all different, and the number of positions.

    With ``most``, so many rounds' ranks are enough, and the last ones may still be shared.
    """
    total = lines.count()
    ranks, levels, step = _first_ranks(lines, total), [], 1
    while True:
        shared = ranks.filter("size > 1").select(*POS, "r", "size")
        if shared.isEmpty():
            return levels, ranks.select(*POS, "r"), total
        levels.append(shared)
        if len(levels) == most:
            return levels, ranks.select(*POS, "r"), total
        ranks = _doubled(ranks, step, total)
        step *= 2


def _later(level: DataFrame, lines: DataFrame, total: int) -> DataFrame:
    """(POS, line, long) of the positions of an interval other than its first, by id, then place."""
    place = F.struct("id", *POS)
    rows = level.select(*POS, "r").join(lines.select(*POS, "id", "line", "long"), POS)
    groups = rows.groupBy("r").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    return lookup(rows, groups, ["r"], total, POS).filter(place != F.col("first")).select(*POS, "line", "long")


def _runs(lines: DataFrame, levels: list[DataFrame], last: DataFrame, min_lines: int) -> DataFrame:
    """(POS, q_ of POS, n): neighbours in the suffix array that share at least min_lines lines and differ in the line before, with the number of lines they share."""
    at = levels[min_lines.bit_length() - 1].select(*POS, F.col("r").alias("m"))
    before = levels[0].select(*DOC, (F.col(POS[2]) + 1).alias(POS[2]), F.col("r").alias("b"))
    ends = scratch(last.join(at, POS).join(before, POS, "left"), "ends")
    other = ends.select(*[F.col(k).alias(f"q_{k}") for k in POS], (F.col("r") + 1).alias("r"), F.col("m").alias("q_m"), F.col("b").alias("q_b"))
    pairs = ends.join(other, "r").filter("m = q_m and not (b is not null and b <=> q_b)").select(*POS, *[f"q_{k}" for k in POS], F.lit(min_lines).alias("n"))
    for k in reversed(range(len(levels))):
        for side, tag in (("", "x"), ("q_", "y")):
            look = levels[k].select(*[F.col(c).alias(f"{c}_{tag}") for c in POS], F.col("r").alias(tag))
            cond = equal([f"{side}{c}" for c in DOC], [f"{c}_{tag}" for c in DOC]) & (F.col(f"{side}{POS[2]}") + F.col("n") == F.col(f"{POS[2]}_{tag}"))
            pairs = pairs.join(look, cond, "left").drop(*[f"{c}_{tag}" for c in POS])
        pairs = pairs.withColumn("n", F.when(F.col("x") == F.col("y"), F.col("n") + (1 << k)).otherwise(F.col("n"))).drop("x", "y")
    return pairs


def _repeated(docs: DataFrame, min_lines: int, min_words: int, with_runs: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """docs(KEY, DOC, text) -> the later copies (DOC, line), the maximal runs and the lines. Without runs, ranks are doubled only as far as deletion reads them."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    lines = _positions(docs, min_words)
    depth = min_lines.bit_length() - 1
    levels, last, total = suffix_ranks(lines, None if with_runs else depth + 1)
    if len(levels) <= depth:  # no run is that long
        levels += [lines.limit(0).select(*POS, F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("size"))] * (depth + 1 - len(levels))
    gone = _later(levels[0], lines, total).filter("long").select(*POS)
    runs = _later(levels[depth], lines, total).select(*DOC, F.explode(F.sequence(F.col(POS[2]), F.col(POS[2]) + (min_lines - 1))).alias(POS[2]))
    gone = lines.select(*POS, "line").join(gone.unionByName(runs).distinct(), POS).select(*DOC, "line")
    return gone, scratch(_runs(lines, levels, last, min_lines), "runs") if with_runs else None, lines


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """docs(doc_id, text string, ...) -> doc_id, line, other_id, other_line, n_lines: the maximal repeated runs of lines.

    A row for each two neighbours in the suffix array that share ``min_lines``
    lines or more and cannot be extended to the left: a passage in n places
    gives n - 1 rows. Line numbers count all lines of the text from 0; n_lines
    counts lines with a word. Edge cases as in ``drop_repeated_lines``.
    """
    keyed = _with_doc(with_key(docs.select("doc_id", "text")))
    _, runs, lines = _repeated(keyed.select(*KEY, *DOC, "text"), min_lines, MIN_WORDS)
    where = lines.select(*POS, "id", "line")
    runs = runs.join(where.withColumnsRenamed({"id": "doc_id"}), POS)
    other = where.select(*[F.col(k).alias(f"q_{k}") for k in POS], F.col("id").alias("other_id"), F.col("line").alias("other_line"))
    return runs.join(other, [f"q_{k}" for k in POS]).select("doc_id", "line", "other_id", "other_line", F.col("n").cast("long").alias("n_lines"))


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, with_longest: bool = True) -> DataFrame:
    """docs(doc_id, text string, ...) -> its columns with text cut, __nl_lines, __nl_removed[ and __nl_longest]; one row per input row.

    __nl_longest, which only the full suffix array gives, is the number of lines of the document's longest run that
    occurs at another place too, in this document or another, 0 if none has
    ``min_lines`` lines.

    Lines are parted by ``\\n`` and compared whole; lines without a word are not
    counted and never deleted. The first copy is the one with the least
    doc_id (nulls first), then place in the text; ties of one id with several
    texts are settled by a hash of the text. Kept lines are joined by ``\\n``.
    Null texts stay null; empty ones stay empty; very long texts are cut into
    lines whole. Repeated rows (same id and text) are one document: they are cut
    alike, and are no copies of each other. Other columns may have any names but
    those that begin with ``__nl_``; an empty table gives an empty result.
    """
    keyed = _with_doc(with_key(docs))
    gone, runs, _ = _repeated(keyed.select(*KEY, *DOC, "text"), min_lines, min_words, with_longest)
    found = gone.groupBy(*DOC).agg(F.collect_set("line").alias("__nl_gone"))
    if with_longest:
        ends = runs.select(*DOC, "n").unionByName(runs.select(*[F.col(f"q_{k}").alias(k) for k in DOC], "n"))
        found = found.join(ends.groupBy(*DOC).agg(F.max("n").alias("__nl_n")), DOC, "full")
    found = found.withColumnsRenamed({k: f"{k}_g" for k in DOC})
    lines = _lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__nl_gone"))
    both = keyed.join(found, equal(DOC, [f"{k}_g" for k in DOC]), "left")
    pick = F.element_at(F.transform(F.array(F.struct(lines.alias("l"), kept.alias("k"))), lambda s: F.array_join(F.transform(s["k"], lambda i: F.get(s["l"], i)), "\n")), 1)
    n = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    text = F.when(F.col("__nl_gone").isNull(), F.col("text")).otherwise(pick)
    return both.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        n.alias("__nl_lines"),
        F.coalesce(F.size("__nl_gone"), F.lit(0)).cast("long").alias("__nl_removed"),
        *([F.coalesce("__nl_n", F.lit(0)).cast("long").alias("__nl_longest")] if with_longest else []),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents
), l AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS n FROM d
), f AS (
  SELECT r, doc_id, x, n, row_number() OVER (PARTITION BY r ORDER BY n) AS i, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM l
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), q AS (
  SELECT *, x || chr(10) || lead(x, 1) OVER s || chr(10) || lead(x, 2) OVER s || chr(10) || lead(x, 3) OVER s AS run FROM f WINDOW s AS (PARTITION BY r ORDER BY i)
), c AS (
  SELECT r, i, w, row_number() OVER (PARTITION BY x ORDER BY doc_id, n) > 1 AS later1,
    run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, n) > 1 AS later4 FROM q
), gone AS (
  SELECT r, i FROM c WHERE later1 AND w >= 5 UNION SELECT r, i + k FROM c, (SELECT unnest(range(0, 4)) AS k) WHERE later4
), k AS (
  SELECT l.r, string_agg(l.x, chr(10) ORDER BY l.n) FILTER (g.i IS NULL) AS t, count(g.i) AS n_removed, count(f.i) AS n_lines
  FROM l LEFT JOIN f ON f.r = l.r AND f.n = l.n LEFT JOIN gone g ON g.r = f.r AND g.i = f.i GROUP BY l.r
), diagonal AS (
  SELECT a.r AS r, b.r AS r2, a.i - b.i AS shift, a.i - row_number() OVER (PARTITION BY a.r, b.r, a.i - b.i ORDER BY a.i) AS run FROM f a JOIN f b ON a.x = b.x AND (a.r <> b.r OR a.i <> b.i)
), longest AS (
  SELECT r, max(n) AS n FROM (SELECT r, count(*) AS n FROM diagonal GROUP BY r, r2, shift, run) WHERE n >= 4 GROUP BY r
)
SELECT d.doc_id, CAST(k.n_lines AS BIGINT) AS n_lines, CAST(k.n_removed AS BIGINT) AS n_removed, CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_run, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d JOIN k USING (r) LEFT JOIN longest USING (r)
"""
