"""Removal of word windows that occur more than once in the corpus.

Pass 1 counts in a count-min sketch. What is counted are not all windows but
their *minimizers*: the least hash among the short runs of words inside a
window. Equal windows have equal minimizers at equal offsets, so a window's
count never exceeds its minimizer's, and the sketch, which only overestimates,
loses none; it just has to hold a fourteenth of the entries. Its width follows
the input without a bound, so it is never whole anywhere: it is cut into blocks,
and a minimizer has its cells of both rows in one block. Each partition sends
its non-empty parts of blocks, and behind them a question for each minimizer
that it has met once; who merges a block's parts answers its questions from the
merged counts and forgets the block. Answers are the places, in a document, of
minimizers that may repeat.

Pass 2 looks at the windows of those minimizers and groups them exactly, by 95
bits of their words. Neighbouring windows with one minimizer travel in one row,
dealt by the minimizer. A key that a task meets twice is settled there and sent
on once, so a passage that a third of all documents share reaches its group as
one row per few MB of text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import KEY as FULL_KEY
from .common import with_key

WINDOW, GRAM = 35, 8
#: Cells of a block, and most blocks: beyond these, blocks grow (2^25 cells, 64 MB in a task, for 100 TB of text).
BLOCK, MOST_BLOCKS = 1 << 16, 1 << 18
ROWS = 2
BATCH_ROWS = 200_000
#: Minimizers after which a task sends its sketch and starts anew.
HELD = 1 << 22
#: Candidates travel with the id and 64 bits of the text, which tells rows of one id apart.
KEY = FULL_KEY[:2]


def cells_for(n_bytes: int) -> int:
    """Cells of a sketch row: six to twelve times the minimizers to expect in so many bytes, a power of two."""
    cells = BLOCK
    while cells < n_bytes / 16:
        cells *= 2
    return cells


def _minimizers(h: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one document; for each, the place and the hash of its minimizer."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = H.grams(h, gram, seed=3)
    place = np.uint64((1 << 28) - 1)
    low = (g & ~place) | (np.arange(len(g), dtype=np.uint64) & place)  # ties: the leftmost
    span, width = window - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n], low[span - width : span - width + n])
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    where = (low[at] & place).astype(np.int64)
    return at, where, g[where]


class _Places:
    """Where minimizers count: a block, and in each row a cell of it."""

    def __init__(self, cells: int):
        self.block = max(BLOCK, cells // MOST_BLOCKS)
        self.blocks = cells // self.block
        self.kind = np.uint16 if self.block <= 1 << 16 else np.uint32

    def of(self, g: np.ndarray) -> np.ndarray:
        return (H.mix(g) % np.uint64(self.blocks)).astype(np.int64)

    def cell(self, g: np.ndarray, row: int) -> np.ndarray:
        return (H.mix(g + np.uint64(row + 1)) & np.uint64(self.block - 1)).astype(np.int64)


#: kind 0: a part of a row of a block; 1: a question; 2: a place known to repeat.
QUESTION = f"b long, kind int, r int, one binary, more binary, g long, {KEY[0]} long, {KEY[1]} long, place int"
QUESTION_NAMES = [x.split()[0] for x in QUESTION.split(", ")]


def _ask(window: int, gram: int, cells: int):
    """Per partition: its sketch, by block, and a row for each of its minimizers."""

    def parts(held: list[np.ndarray], at: _Places):
        g = np.concatenate(held)
        b, cols = at.of(g), [[], [], [], []]
        for r in range(ROWS):
            cell, n = np.unique(b * at.block + at.cell(g, r), return_counts=True)
            of = cell // at.block
            cuts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
            cell = (cell % at.block).astype(at.kind)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                twice = n[x:y] > 1
                for c, v in zip(cols, (int(of[x]), r, cell[x:y][~twice].tobytes(), cell[x:y][twice].tobytes()), strict=True):
                    c.append(v)
        m = len(cols[0])
        null = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())]
        out = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(np.zeros(m, np.int32)), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary()), *null], QUESTION_NAMES)
        return (out.slice(i, 4096) for i in range(0, m, 4096))

    def run(batches):
        hasher, at, held, n_held = H.WordHasher(lower=False), _Places(cells), [], 0
        for batch in batches:
            for a, b, data, off in H.chunks(batch.column(2)):
                h, doc, _, _ = hasher(data, off)
                _, where, g = _minimizers(h, doc, window, gram)
                if not len(where):
                    continue
                new = np.ones(len(where), bool)
                new[1:] = where[1:] != where[:-1]
                where, g = where[new], g[new]
                held.append(g)
                n_held += len(g)
                _, back, n = np.unique(g, return_inverse=True, return_counts=True)
                known = n[back] > 1
                m, of = len(g), doc[where]
                place = where - np.searchsorted(doc, np.arange(b - a))[of]
                # what is known asks no block, so it may go anywhere
                to = np.where(known, -1 - (H.mix(place.astype(np.uint64) + g) % np.uint64(4096)).astype(np.int64), at.of(g))
                who = pa.array(of + a)
                out = pa.RecordBatch.from_arrays(
                    [pa.array(to), pa.array(1 + known.astype(np.int32)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(g.view(np.int64)), batch.column(0).take(who), batch.column(1).take(who), pa.array(place.astype(np.int32))],
                    QUESTION_NAMES,
                )
                for i in range(0, m, BATCH_ROWS):
                    yield out.slice(i, BATCH_ROWS)
            if n_held > HELD:
                yield from parts(held, at)
                held, n_held = [], 0
        if held:
            yield from parts(held, at)

    return run


ANSWER = f"{KEY[0]} long, {KEY[1]} long, place int"


def _answer(cells: int):
    """Rows sorted by (block, kind): merges each block's parts, then keeps the places of minimizers that it counts twice or more."""

    def run(batches):
        at, now = _Places(cells), None
        counts = np.zeros((ROWS, at.block), np.uint8)
        for batch in batches:
            b, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            keep = kind == 2
            cuts = np.append(np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (kind[1:] != kind[:-1]))), len(b)) if len(b) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if b[x] != now:
                    now = b[x]
                    counts[:] = 0
                if kind[x] == 0:
                    for r, one, more in zip(*(batch.column(c).slice(x, y - x).to_pylist() for c in (2, 3, 4)), strict=True):
                        one = np.frombuffer(one, at.kind)
                        counts[r, one] = np.minimum(counts[r, one] + 1, 2)
                        counts[r, np.frombuffer(more, at.kind)] = 2
                elif kind[x] == 1:
                    g = np.asarray(batch.column(5).slice(x, y - x)).view(np.uint64)
                    keep[x:y] = np.logical_and.reduce([counts[r, at.cell(g, r)] > 1 for r in range(ROWS)])
            found = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([found.column(i) for i in (6, 7, 8)], [*KEY, "place"])

    return run


def repeated_minimizers(keyed: DataFrame, window: int, gram: int, cells: int) -> DataFrame:
    """keyed(KEY, text) -> (KEY, place): the minimizers, by word number, that the merged sketch counts twice or more."""
    asked = keyed.select(*KEY, "text").mapInArrow(_ask(window, gram, cells), QUESTION)
    return asked.repartition("b").sortWithinPartitions("b", "kind").mapInArrow(_answer(cells), ANSWER)


def _candidates(window: int, gram: int):
    """Rows (KEY, text, places of minimizers that may repeat) -> their windows: those of one minimizer end to end with their keys, and runs that are settled already."""

    def run(batches):
        hasher = H.WordHasher(lower=False)
        one, two = H.Powers(H.BASE_A), H.Powers(H.BASE_B)
        for batch in batches:
            keys = [batch.column(i) for i in range(2)]
            places = batch.column(3)
            for a, b, data, off in H.chunks(batch.column(2)):
                h, doc, _, _ = hasher(data, off)
                at, where, g = _minimizers(h, doc, window, gram)
                if not len(at):
                    continue
                begin = np.searchsorted(doc, np.arange(b - a))
                mine = places.slice(a, b - a)
                marked = np.zeros(len(h), bool)
                marked[np.repeat(begin, np.asarray(mine.value_lengths().fill_null(0))) + np.asarray(mine.flatten())] = True
                may = marked[where]
                at, where, g = at[may], where[may], g[may]
                if not len(at):
                    continue
                k1, k2 = H.windows(h, window, one, 1)[at], H.windows(h, window, two, 2)[at]
                order = np.lexsort((k2, k1))
                first = np.ones(len(order), bool)
                first[1:] = (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])
                single = first.copy()
                single[:-1] &= first[1:]
                settled = np.zeros(len(at), bool)
                settled[order[~single]] = True
                local = at - begin[doc[at]]
                # runs of settled windows, by document
                s = np.flatnonzero(settled)
                starts = np.ones(len(s), bool)
                starts[1:] = (at[s[1:]] != at[s[:-1]] + 1) | (doc[at[s[1:]]] != doc[at[s[:-1]]])
                ends = np.ones(len(s), bool)
                ends[:-1] = starts[1:]
                lo, hi, of = local[s[starts]], local[s[ends]], doc[at[s[starts]]]
                # first windows of each key, neighbours of one minimizer together
                send = np.sort(order[first])
                cut = np.ones(len(send), bool)
                cut[1:] = (at[send[1:]] != at[send[:-1]] + 1) | (where[send[1:]] != where[send[:-1]])
                head = send[cut]
                n, m = len(head), len(lo)
                who = pa.array(np.concatenate([doc[at[head]], of]) + a)
                w1 = np.concatenate([k1[send], H.mix(of.astype(np.uint64) * np.uint64(977) + lo.astype(np.uint64))]).view(np.int64)
                w2 = np.concatenate([(k2[send].astype(np.uint32) & np.uint32(0xFFFFFFFE)) | settled[send], np.ones(m, np.uint32)]).astype(np.uint32).view(np.int32)
                edges = np.concatenate([np.flatnonzero(cut), len(send) + np.arange(m + 1)]).astype(np.int32)
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([g[head].view(np.int64), w1[len(send) :]])),
                        *(k.take(who) for k in keys),
                        pa.array(np.concatenate([local[head], lo]).astype(np.int32)),
                        pa.array(np.concatenate([np.zeros(n, np.int32), hi.astype(np.int32)]), mask=np.arange(n + m) < n),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(w1)),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(w2)),
                    ],
                    ["g", *KEY, "lo", "hi", "w1", "w2"],
                )
                for i in range(0, len(out), BATCH_ROWS):
                    yield out.slice(i, BATCH_ROWS)

    return run


#: Windows from number lo on, by 95 bits of their words and one that tells whether they are settled; or a settled run lo to hi.
CANDIDATE = f"g long, {KEY[0]} long, {KEY[1]} long, lo int, hi int, w1 array<long>, w2 array<int>"


def _cut(window: int, with_text: bool):
    """Removes the covered words of each text."""

    def run(batches):
        hasher = H.WordHasher(lower=False)
        for batch in batches:
            ids, texts, single, runs = batch.columns
            for a, b, data, off in H.chunks(texts):
                _, doc, s, e = hasher(data, off)
                raw = data.tobytes()
                first = np.searchsorted(doc, np.arange(b - a + 1))
                total, removed, kept, digests = [], [], [], []
                for d in range(b - a):
                    i, j = int(first[d]), int(first[d + 1])
                    step = np.zeros(j - i + 1, np.int64)
                    r = single[a + d]
                    if r.is_valid and len(r.values):
                        lone = np.asarray(r.values)
                        np.add.at(step, lone, 1)
                        np.add.at(step, lone + window, -1)
                    r = runs[a + d]
                    if r.is_valid and len(r.values):
                        flat = np.asarray(r.values.flatten()[0]), np.asarray(r.values.flatten()[1])
                        np.add.at(step, flat[0], 1)
                        np.add.at(step, flat[1] + window, -1)
                    keep = np.flatnonzero(np.cumsum(step)[:-1] == 0)
                    if len(keep) == j - i and i < j:
                        pieces = [raw[x:y] for x, y in zip(s[i:j].tolist(), e[i:j].tolist(), strict=True)]
                    else:
                        pieces = [raw[x:y] for x, y in zip(s[i + keep].tolist(), e[i + keep].tolist(), strict=True)]
                    text = b" ".join(pieces)
                    total.append(j - i)
                    removed.append(j - i - len(keep))
                    digests.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        kept.append(text.decode())
                cols = [ids.slice(a, b - a), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols, names = [*cols, pa.array(kept, pa.string())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """docs(doc_id long, text string, ...) -> doc_id, n_words, n_removed, kept_sha256[, kept_text]; one row per input row.

    A window is ``window`` consecutive words (as they are) of one text. Each word
    in a window whose words also start anywhere else, in this text or another, is
    removed; all windows are judged on the input. Kept words are joined by one
    space.

    Null, empty and blank texts have no words and keep the empty string. Repeated
    rows are separate documents, so their windows count as repeated. Texts
    shorter than a window keep all words; very long ones are read whole. Ids may
    be null, or repeated with other texts. Extra columns are ignored; an empty
    table gives an empty result.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cells = cells_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    keyed = with_key(docs).select(*KEY, "text")

    def of_text(found: DataFrame, how: str) -> DataFrame:
        found = found.withColumnsRenamed({k: f"{k}_r" for k in KEY})
        return keyed.join(found, F.col(KEY[0]).eqNullSafe(F.col(f"{KEY[0]}_r")) & F.col(KEY[1]).eqNullSafe(F.col(f"{KEY[1]}_r")), how)

    places = repeated_minimizers(keyed, window, gram, cells).groupBy(*KEY).agg(F.collect_set("place").alias("__nl_places"))
    found = of_text(places, "inner").select(*KEY, "text", "__nl_places").mapInArrow(_candidates(window, gram), CANDIDATE)
    each = found.repartition("g").select("g", *KEY, "lo", "hi", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w"))
    each = each.select("g", *KEY, (F.col("lo") + F.col("i")).alias("lo"), "hi", F.col("w.w1").alias("w1"), F.shiftrightunsigned("w.w2", 1).alias("w2"), (F.col("w.w2") % 2 != 0).alias("known"))
    each = each.withColumn("n", F.count("*").over(Window.partitionBy("g", "w1", "w2"))).filter("known or n > 1")
    runs = each.groupBy(*KEY).agg(F.collect_set(F.when(F.col("hi").isNull(), F.col("lo"))).alias("__nl_single"), F.collect_set(F.when(F.col("hi").isNotNull(), F.struct("lo", "hi"))).alias("__nl_runs"))
    both = of_text(runs, "left").select(F.col(KEY[0]).alias("doc_id"), "text", "__nl_single", "__nl_runs")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return both.mapInArrow(_cut(window, with_text), out + (", kept_text string" if with_text else ""))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT r, i, array_to_string(ws[i:i+34], ' ') AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY w) AS n FROM win) WHERE n > 1
), gone AS (SELECT DISTINCT r, i + k AS p FROM rep, (SELECT unnest(range(0, 35)) AS k)
), word AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d
), kept AS (
  SELECT word.r, string_agg(w, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word LEFT JOIN gone ON gone.r = word.r AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.r
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
