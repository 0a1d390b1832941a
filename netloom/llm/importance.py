"""Importance resampling towards a target distribution, over a sparse document-by-bucket matrix.

Texts are read once: their features' counts by bucket become a sparse matrix in
blocks of compressed sparse rows (row bounds, columns, counts), written to the
shared folder. All that follows reads the matrix. Its column sums are the
corpus's distribution; they and the target's give each bucket a gain; the
product of the matrix with the vector of gains is each document's weight. The
vector has an entry for each bucket, so its size is a parameter, and it goes to
all tasks. Weights plus Gumbel noise, fixed by the ids, are scores; the highest
scores are a draw without replacement.

Ranks come from a sort by ranges: a row's place in its range, plus the rows of
the ranges before. No task sees more than its range.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import ranked, scratch

LONGEST, BUCKETS, SCALE = 1, 10_000, 1000
LEAST_WORDS, PERCENT, SEED = 20, 10, "2024"
#: Bytes of text of a block of the matrix.
CHUNK = 1 << 20
#: Blocks in a file of the matrix: as many are read at once.
BLOCKS = 16
#: The public CRC-32 polynomial, reflected.
POLYNOMIAL = 0xEDB88320
FULL = np.uint32(0xFFFFFFFF)


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
    return t


class _Words:
    """Words of lower-cased bytes: runs of a-z, 0-9 and all bytes from 0x80 on; and CRC states carried over them."""

    #: From this length on, a word is carried by the library's function instead of byte by byte with all others.
    LONG = 64

    def __init__(self):
        self.table = _table()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[0x41:0x5B] += 32
        self.inside = np.zeros(256, bool)
        self.inside[0x30:0x3A] = self.inside[0x61:0x7B] = self.inside[0x80:] = True

    def find(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, byte after the last and document (from 0) of all words in order; data is lower-cased."""
        n = len(data)
        word = self.inside[data]
        edge = np.zeros(n + 1, bool)  # a word cannot run over the start of a document
        edge[off] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:n]
        ends[:-1] &= ~word[1:] | edge[1:n]
        s = np.flatnonzero(begins)
        return s, np.flatnonzero(ends) + 1, np.searchsorted(off, s, "right") - 1

    def carry(self, state: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The CRC states after the bytes from s to e."""
        n = np.minimum(e - s, self.LONG).astype(np.uint8)
        order = np.argsort(n, kind="stable")[::-1]
        n, at, st = n[order], s[order], state[order]
        for k in range(int(n[0]) if len(n) else 0):
            m = int(np.searchsorted(-n.astype(np.int16), -k, "left"))
            st[:m] = (st[:m] >> np.uint32(8)) ^ self.table[(st[:m] ^ data[at[:m] + k]) & np.uint32(255)]
        out = np.empty_like(st)
        out[order] = st
        for i in np.flatnonzero(e - s > self.LONG).tolist():
            out[i] = zlib.crc32(data[s[i] + self.LONG : e[i]].tobytes(), int(out[i] ^ FULL)) ^ 0xFFFFFFFF
        return out

    def features(self, data: np.ndarray, off: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document and CRC-32 of all runs of 1 to ``longest`` words, joined by one space; and the words of each document."""
        data = self.lower[data]
        s, e, doc = self.find(data, off) if len(data) else (np.zeros(0, np.int64),) * 3
        docs, crcs, state = [], [], np.full(len(s), FULL, np.uint32)
        blank = np.full(1, 0x20, np.uint8)
        for k in range(longest):
            if k:
                state, doc_k = state[: len(state) - 1], doc[k:]
                same = doc[: len(doc) - k] == doc_k
                z = np.zeros(len(state), np.int64)
                state = self.carry(self.carry(state, blank, z, z + 1), data, s[k:], e[k:])
                docs.append(doc_k[same]), crcs.append(state[same] ^ FULL)
            else:
                state = self.carry(state, data, s, e)
                docs.append(doc), crcs.append(state ^ FULL)
        return np.concatenate(docs), np.concatenate(crcs), np.bincount(doc, minlength=len(off) - 1)


MATRIX = "doc_id array<long>, n_words array<long>, bound array<long>, bucket array<int>, n array<int>"


def _rows(longest: int, buckets: int):
    """Batches of (id, text) -> blocks of the matrix: ids, words, bounds of each row's entries, and the entries."""

    def run(batches):
        words = _Words()
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, off in H.chunks(batch.column(1), CHUNK):
                doc, crc, n_words = words.features(data, off, longest)
                cell, n = np.unique(doc.astype(np.int64) * buckets + crc % np.uint32(buckets), return_counts=True)
                bound = np.searchsorted(cell, np.arange(b - a + 1, dtype=np.int64) * buckets)
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [whole(ids.slice(a, b - a)), whole(pa.array(n_words, pa.int64())), whole(pa.array(bound, pa.int64())), whole(pa.array((cell % buckets).astype(np.int32))), whole(pa.array(n.astype(np.int32)))],
                    ["doc_id", "n_words", "bound", "bucket", "n"],
                )

    return run


def matrix(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, text) -> the document-by-bucket counts, a block of compressed sparse rows in each row, in the shared folder."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return scratch(docs.select(F.col("doc_id").cast("long"), text.alias("text")).mapInArrow(_rows(longest, buckets), MATRIX), "matrix", BLOCKS)


def _sums(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), np.asarray(batch.column(1).flatten()), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return run


def column_sums(m: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The matrix's column sums, (bucket, n); a task sends a row for each bucket at most."""
    return m.select("bucket", "n").mapInArrow(_sums(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> np.ndarray:
    """The gain of each bucket, from two tables of column sums (as many rows as there are buckets, at most)."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, sums in ((s, corpus), (t, target)):
        for r in sums.collect():
            into[r["bucket"]] = r["n"]
    more_s, more_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(scale * math.log((b + 1) * more_s / ((a + 1) * more_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _product(gain: np.ndarray):
    def run(batches):
        for batch in batches:
            for block in range(len(batch)):
                ids, n_words, bound, bucket, n = (batch.column(i)[block].values for i in range(5))
                bound, n = np.asarray(bound), np.asarray(n).astype(np.int64)
                weight = np.append(0, np.cumsum(gain[np.asarray(bucket)] * n))[bound]
                count = np.append(0, np.cumsum(n))[bound]
                yield pa.RecordBatch.from_arrays([ids, n_words, pa.array(np.diff(count)), pa.array(np.diff(weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def product(m: DataFrame, gain: np.ndarray) -> DataFrame:
    """The matrix times the vector of gains: doc_id, n_words, n_features, weight."""
    return m.mapInArrow(_product(gain), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED, scale: int = SCALE) -> Column:
    """Scaled standard Gumbel noise, fixed by the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """docs(doc_id, text, ...), target(text, ...) -> doc_id, n_features, weight, score, rank; one row per row of docs.

    rank numbers the draw, ``percent`` of the documents of ``least_words`` words or more, by falling score, ties to the
    smaller id; all others have none.

    Null, empty and wordless texts have no features and weight 0, and are never drawn as long as ``least_words`` is
    positive. Null ids share one noise and come first among ties; rows that tie in score and id stand in the order of
    their features and weights, and repeated rows are separate documents. Texts are read whole, however long. An empty
    target has the same chance for all buckets; an empty table of documents gives an empty result. Other columns of
    either table are ignored.
    """
    m = matrix(docs, longest, buckets)
    wanted = column_sums(matrix(target.withColumn("doc_id", F.lit(None).cast("long")), longest, buckets), buckets)
    weighed = scratch(product(m, gains(column_sums(m, buckets), wanted, buckets)), "weights")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = ranked(fit, [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()], percent * fit.count() // 100)
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), f AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 't', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), b AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(w)), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM f), tab
), n AS (SELECT side, id, bucket, count(*) AS n FROM f JOIN b USING (w) GROUP BY ALL
), g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (ts + 10000) / (CAST(s + 1 AS DOUBLE) * (tt + 10000)))) AS BIGINT) AS gain FROM (
    SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM n GROUP BY bucket
  ), (SELECT coalesce(sum(n) FILTER (side = 'd'), 0) AS ts, coalesce(sum(n) FILTER (side = 't'), 0) AS tt FROM n)
), w AS (
  SELECT doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_features, CAST(coalesce(sum(n * gain), 0) AS BIGINT) AS weight
  FROM documents LEFT JOIN (SELECT * FROM n JOIN g USING (bucket) WHERE side = 'd') ON doc_id = id GROUP BY doc_id
), s AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM s WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * total // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)
"""
