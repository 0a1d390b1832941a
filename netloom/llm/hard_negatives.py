"""Hard negatives by norm-bucketed exact search.

Candidates are sorted by falling norm and cut into buckets. By the Cauchy-Schwarz
inequality no row of a bucket scores more than the query's norm times the
bucket's largest, so a bucket is out for a window of scores if that product lies
under the window's lower limit, or under the k-th best score found so far.

Buckets form chunks, queries form blocks of alike reach (the norm that a
candidate must have), and a task holds one block while the buckets of one chunk
stream past it in falling norm. A first round searches the chunk of the largest
norms; its k-th scores tell how far down each block has to go, and the second
round visits those chunks only. Nothing is dropped: what is left out cannot be
in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, scratch

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Bounds of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows of a bucket, buckets of a chunk, queries of a block.
BUCKET, CHUNK, BLOCK = 1024, 8, 2048
#: Components beyond this are taken as this: sums of products of 256 of them fit 64 bits.
MOST = 1 << 27
LEAST_SCORE = -(1 << 63)
#: Classes of norms: 64 for each doubling of the square.
CLASSES = 64 * 64
#: Up to this product of norms, all partial sums are whole in doubles.
EXACT = float(1 << 52)


def _quantised(batches):
    """(vec_id, label, embedding) -> the rows that take part, with whole components (clamped at MOST) and squared norms."""
    for batch in batches:
        vec = batch.column(2)
        lens, flat = np.asarray(vec.value_lengths().fill_null(0)), vec.flatten()
        x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
        end = np.cumsum(lens)
        bad = np.append(0, np.cumsum(~np.isfinite(x)))
        keep = np.asarray(vec.is_valid()) & np.asarray(batch.column(1).is_valid()) & np.asarray(batch.column(0).is_valid()) & (bad[end] == bad[end - lens])
        x = np.clip(np.floor(SCALE * np.where(np.isfinite(x), np.clip(x, -MOST, MOST), 0)), -MOST, MOST).astype(np.int64)
        norm = np.append(0, np.cumsum((x * x).astype(np.float64)))
        at = np.flatnonzero(keep)
        norm2 = np.array([int(np.dot(x[end[i] - lens[i] : end[i]], x[end[i] - lens[i] : end[i]])) for i in at.tolist()], np.int64) if norm[-1] >= EXACT else (norm[end] - norm[end - lens])[at].astype(np.int64)
        rows = pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(x.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(norm2), rows.filter(pa.array(keep))], ["vec_id", "label", "norm2", "v"])


VECTOR = "vec_id long, label int, norm2 long, v array<int>"
BUCKETS = "chunk long, bucket long, norm2 long, vec_id array<long>, label array<int>, bound array<int>, v array<int>"


def _bucketed(batches):
    """Rows sorted by (chunk, bucket, vec_id) -> a row for each bucket."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        v = rows.column("v")
        bound = np.append(0, np.cumsum(np.asarray(v.value_lengths()))).astype(np.int32)
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        norm = int(np.asarray(rows.column("norm2")).max())
        cols = [rows.column("chunk")[:1], rows.column("bucket")[:1], pa.array([norm]), *(whole(x) for x in (rows.column("vec_id"), rows.column("label"), pa.array(bound), v.flatten()))]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in BUCKETS.split(", ")])

    at, held = None, []
    for batch in batches:
        bucket = np.asarray(batch.column("bucket"))
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if held and bucket[i] != at:
                yield packed(held)
                held = []
            at = bucket[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield packed(held)


def norm_ranked(rows: DataFrame) -> DataFrame:
    """rows(vec_id, label, embedding) -> vec_id, label, norm2, v, rank: those that take part, equal ones once, numbered by falling norm."""
    read = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>"))
    order = [F.col("norm2").desc(), F.col("vec_id").asc(), F.col("label").asc(), F.col("v").asc()]
    return ranked(scratch(read.mapInArrow(_quantised, VECTOR).distinct(), "vectors"), order)


def norm_buckets(vectors: DataFrame, size: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """Numbered vectors -> buckets by falling norm, in chunks, in the shared folder; within a bucket rows stand by id."""
    bucket = F.floor((F.col("rank") - 1) / size)
    rows = vectors.select(F.floor(bucket / chunk).alias("chunk"), bucket.alias("bucket"), "vec_id", "label", "norm2", "v")
    return scratch(rows.repartition("chunk").sortWithinPartitions("chunk", "bucket", "vec_id", "label").mapInArrow(_bucketed, BUCKETS), "buckets")


def _matrix(flat: np.ndarray, bound: np.ndarray, width: int) -> np.ndarray:
    """Rows of one width; shorter vectors end in zeros."""
    lens = np.diff(bound)
    out = np.zeros((len(lens), width), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(bound[:-1], lens)] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, best_s: np.ndarray, best_i: np.ndarray, rows: np.ndarray, k: int) -> None:
    """Merges the k best of each row of scores (LEAST_SCORE: none) into the best of ``rows``; columns stand by id, so the first of equal ones counts."""
    cols, got = [], []
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        top = scores[np.arange(len(scores)), at].copy()
        if (top == LEAST_SCORE).all():
            break
        scores[np.arange(len(scores)), at] = LEAST_SCORE
        cols.append(ids[at]), got.append(top)
    if not cols:
        return
    s = np.concatenate([best_s[rows], np.stack(got, axis=1)], axis=1)
    i = np.concatenate([best_i[rows], np.stack(cols, axis=1)], axis=1)
    order = np.lexsort((i, -(s + 1)), axis=1)[:, :k]  # -(s + 1) does not overflow
    best_s[rows], best_i[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


FOUND = "q long, w int, score long, vec_id long"


def _searched(k: int, same: bool):
    """Rows of (block, chunk), queries first and then buckets by falling norm -> the k best of the chunk for each query and window."""

    def found(held: dict) -> pa.RecordBatch:
        q, w, j = np.nonzero(held["best_s"] > LEAST_SCORE)
        return pa.RecordBatch.from_arrays([pa.array(held["q"][q]), pa.array(w.astype(np.int32)), pa.array(held["best_s"][q, w, j]), pa.array(held["best_i"][q, w, j])], [x.split()[0] for x in FOUND.split(", ")])

    def begin(rows: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(rows).combine_chunks()
        col = {c: t.column(c).combine_chunks() for c in t.column_names}
        n = len(t)
        windows = lambda c: np.asarray(col[c].flatten()).reshape(n, -1)
        lo, hi = np.maximum(windows("lo"), windows("kth")), windows("hi")
        bound = np.append(0, np.cumsum(np.asarray(col["v"].value_lengths())))
        out = {"q": np.asarray(col["q"]), "id": np.asarray(col["q_id"]), "label": np.asarray(col["q_label"]), "norm": np.sqrt(np.asarray(col["norm2"]).astype(np.float64)), "flat": np.asarray(col["v"].flatten()), "bound": bound}
        return out | {"lo": lo, "hi": hi, "best_s": np.full((*lo.shape, k), LEAST_SCORE, np.int64), "best_i": np.zeros((*lo.shape, k), np.int64)}

    def visit(held: dict, norm2: int, ids: np.ndarray, labels: np.ndarray, bound: np.ndarray, flat: np.ndarray) -> None:
        least = np.maximum(held["lo"], held["best_s"][:, :, -1])
        most = held["norm"] * np.sqrt(float(norm2)) * (1 + 1e-9)
        may = (least <= most[:, None]) & (held["lo"] <= held["hi"])
        rows = np.flatnonzero(may.any(axis=1))
        if not len(rows):
            return
        width = max(int(np.diff(bound).max(initial=0)), int(np.diff(held["bound"]).max(initial=0)))
        if held.get("width") != width:
            held["width"], held["m"] = width, _matrix(held["flat"], held["bound"], width)
        a, b = held["m"][rows], _matrix(flat, bound, width)
        exact = most[rows].max() < EXACT
        score = (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T
        other = (held["label"][rows][:, None] == labels[None, :]) != same
        if same:
            other |= held["id"][rows][:, None] == ids[None, :]
        score[other] = LEAST_SCORE
        for w in range(least.shape[1]):
            low, high = least[rows, w], held["hi"][rows, w]
            inside = np.where((score >= low[:, None]) & (score <= high[:, None]), score, LEAST_SCORE)
            some = np.flatnonzero(may[rows, w] & (inside > LEAST_SCORE).any(axis=1))
            if len(some):
                s, i = held["best_s"][:, w], held["best_i"][:, w]
                _best(inside[some], ids, s, i, rows[some], k)

    def run(batches):
        at, rows, held = None, [], None
        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in ("block", "chunk", "kind")), strict=True))
            i = 0
            while i < len(key):
                j = i
                while j < len(key) and key[j] == key[i]:
                    j += 1
                block, chunk, kind = key[i]
                if (block, chunk) != at:
                    if held is not None:
                        yield found(held)
                    at, rows, held = (block, chunk), [], None
                part = batch.slice(i, j - i)
                if kind == 0:
                    rows.append(part)
                elif rows:
                    held = held or begin(rows)
                    for r in range(len(part)):
                        visit(held, part.column("norm2")[r].as_py(), *(np.asarray(part.column(c)[r].values) for c in ("ids", "labels", "bound", "v")))
                i = j
        if held is not None:
            yield found(held)

    return run


QUERY = ["block", "q", "q_id", "q_label", "norm2", "v", "lo", "hi", "kth"]


def _round(queries: DataFrame, buckets: DataFrame, wanted: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best of each wanted (block, chunk)."""
    sent = queries.join(wanted, "block").select("block", "chunk", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("bucket"), *QUERY[1:], *[F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("labels", "array<int>"), ("bound", "array<int>"))])
    b = buckets.join(wanted, "chunk").select("block", "chunk", F.lit(1).alias("kind"), "bucket", "norm2", "v", F.col("vec_id").alias("ids"), F.col("label").alias("labels"), "bound")
    both = sent.unionByName(b, allowMissingColumns=True)
    return both.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "kind", "bucket").mapInArrow(_searched(k, same), FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("r", F.row_number().over(Window.partitionBy("q", "w").orderBy(F.col("score").desc(), F.col("vec_id").asc()))).filter(F.col("r") <= k)


def _norm_class(norm2):
    """A number from 0 to CLASSES that grows with the squared norm."""
    return F.least(F.floor(F.log2(norm2.cast("double") + 1) * 64), F.lit(CLASSES)).cast("int")


def _reached(buckets: DataFrame) -> DataFrame:
    """(class, last): the last chunk with a norm of at least each class. As many rows as there are classes."""
    got = {r["c"]: r["last"] for r in buckets.groupBy(_norm_class(F.col("norm2")).alias("c")).agg(F.max("chunk").alias("last")).collect()}
    last, table = -1, []
    for c in range(CLASSES, -1, -1):
        last = max(last, got.get(c, -1))
        table.append((c, last))
    return buckets.sparkSession.createDataFrame(table, "class int, last long")


def search(queries: DataFrame, buckets: DataFrame, k: int, same: bool, block: int = BLOCK) -> DataFrame:
    """queries(q, q_id, q_label, norm2, v, lo array, hi array) -> (q, w, score, vec_id, r): for the w-th window of each
    query, the first k rows of the same label (other than the query's own id), or else of other labels, with lo <= score <= hi.

    All queries have equally many windows. Higher scores come first, ties by the smaller id.
    """

    def blocks(rows: DataFrame, by: str) -> DataFrame:
        placed = ranked(rows, [F.col(by).asc(), F.col("q").asc()])
        return scratch(placed.withColumn("block", F.floor((F.col("rank") - 1) / block)).drop("rank"), "queries")

    q = blocks(queries.withColumn("kth", F.transform("lo", lambda _: F.lit(LEAST_SCORE))), "norm2")
    probe = scratch(_top(_round(q, buckets, q.select("block", F.lit(0).cast("long").alias("chunk")).distinct(), k, same), k), "probed")
    # who has k already must beat the k-th, all others must reach their lower limit
    kth = probe.filter(F.col("r") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("have"))
    q = q.drop("kth", "block").join(kth, "q", "left")
    q = q.withColumn("kth", F.transform("lo", lambda _, i: F.coalesce(F.try_element_at("have", i), F.lit(LEAST_SCORE))))
    least = F.transform(F.arrays_zip("lo", "hi", "kth"), lambda x: F.when(x["lo"] <= x["hi"], F.greatest(x["lo"], x["kth"])))
    # the squared norm that a candidate needs; none (null) where all windows are empty or the query is zero
    needed = lambda x: F.when(x <= 0, 0.0).otherwise(F.try_divide(x.cast("double") * x.cast("double") * (1 - 1e-8), F.col("norm2").cast("double")))
    q = blocks(q.drop("have").withColumn("reach", F.array_min(F.transform(least, needed))).filter("reach is not null"), "reach")
    need = q.groupBy("block").agg(_norm_class(F.min("reach")).alias("class"))
    visits = need.join(F.broadcast(_reached(buckets)), "class").filter("last > 0").select("block", F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("chunk"))
    rest = _round(q.drop("reach"), buckets, scratch(visits, "visits"), k, same)
    return _top(probe.select("q", "w", "score", "vec_id").unionByName(rest), k)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, bucket: int = BUCKET, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """rows(vec_id long, label int, embedding array, ...) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that satisfy ``anchor``. Their positives are the first ``positives`` rows of their label with another
    id; of each positive, the first ``negatives`` rows of other labels that score ``low`` to ``high`` hundredths of it are
    returned. Scores are inner products of floor(256 x) over the components; higher ones come first, ties by the smaller id.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part; rows equal in id, label
    and vector count once, rows that share only the id are rows of their own (and no positives of each other). Of vectors
    of different lengths the shorter one is filled up with zeros; empty ones score 0. Components are held within 2^27 on
    either side, so that scores are whole numbers of 64 bits for vectors of up to 256 components. Without rows, anchors or
    partners the result is empty. Other columns are ignored.
    """
    vectors = norm_ranked(rows)
    buckets = norm_buckets(vectors, bucket, chunk)
    anchors = vectors.filter(anchor).select(F.col("rank").alias("q"), F.col("vec_id").alias("q_id"), F.col("label").alias("q_label"), "norm2", "v")
    every = F.array(F.lit(LEAST_SCORE)), F.array(F.lit(-LEAST_SCORE - 1))
    pairs = scratch(search(anchors.withColumns({"lo": every[0], "hi": every[1]}), buckets, positives, True, block), "positives")
    share = lambda n, up: F.expr(f"cast({'ceil' if up else 'floor'}(cast(score as decimal(20, 0)) * {n} / 100) as long)")
    limits = pairs.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("r", F.struct(share(low, True).alias("lo"), share(high, False).alias("hi"))))).alias("have"))

    def padded(c: str, none: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at("have", i)[c], F.lit(none).cast("long")))

    asked = anchors.join(limits, "q").withColumns({"lo": padded("lo", 1), "hi": padded("hi", 0)})  # windows that are not there are empty
    found = search(asked.drop("have"), buckets, negatives, False, block).select("q", F.col("w").alias("w_"), F.col("r").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pairs.select("q", (F.col("r") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("q", F.col("q_id").alias("anchor_id")), "q")
    return named.join(found.withColumnRenamed("w_", "w"), ["q", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
