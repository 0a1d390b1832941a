"""Removal of byte strings that start earlier in the corpus, by run-compressed indexes.

One index over a corpus fits no task, so equal strings are brought together
first. A string's *minimizer* is the least hash among the grams of half its
length in it; equal strings have equal minimizers at equal places. Neighbouring
strings with one minimizer are a segment, and segments meet by their minimizer.

Pass 1 finds the minimizers that occur twice: each task sends those that it met,
once each, in blocks by hash, and who merges a block answers with the places.
Pass 2 cuts the segments of these places out of the texts; segments that a task
meets twice, byte for byte, are sent once. Whoever gets the segments of some
minimizers builds a run-compressed index of them (``run_index``), streams their
matching statistics and marks all strings that start earlier.

A minimizer may stand in a third of all texts, each time in other surroundings.
A group of over LARGE bytes of different segments is therefore dealt anew, by a
longer gram around the minimizer: half of what is missing to the whole string,
on the left for strings that have it there, else on the right. After a few
rounds the gram is the string itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from . import run_index
from .common import scratch

LENGTH = 100
#: Bytes of text hashed at once, and bytes of segments compared in a task before they are sent.
CHUNK, COMPARED = 1 << 18, 32 << 20
#: Text for each block of minimizers, fewest blocks, and minimizers after which a task sends its own.
BLOCK_BYTES, LEAST_BLOCKS, HELD = 64 << 20, 64, 1 << 21
#: Bytes of an index, so that its arrays stay near the processor; and of a group's different segments beyond which it is dealt anew.
PIECE, LARGE = 1 << 19, 4 << 20
#: A document: 64 bits of id and text, and 64 of the text.
KEY = ["__nl_h", "__nl_k"]
BEFORE_ALL = -(1 << 63)


def _slices(texts: pa.Array, length: int):
    """(first row, bytes, offsets of texts, bytes of the text before): runs of whole texts, long ones in slices that share length - 1 bytes."""
    for a, b, data, off in H.chunks(texts, CHUNK):
        if b - a > 1 or len(data) <= 2 * CHUNK:
            yield a, data, off, 0
        else:
            for x in range(0, max(1, len(data) - length + 1), CHUNK):
                part = data[x : x + CHUNK + length - 1]
                yield a, part, np.array([0, len(part)]), x


class _Minimizers:
    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.codes, self.powers = length, gram, H.seeds(256, 23), H.Powers(H.BASE_BYTES)

    def __call__(self, data: np.ndarray, off: np.ndarray):
        """Starts of all strings within one text; the places of their minimizers (the leftmost of equal ones), and the hashes there."""
        k, n = self.gram, len(data) - self.length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = self.powers.get(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * up, out=total[1:])
        g = (total[k:] - total[:-k]) * down[: len(data) - k + 1]
        g ^= g >> np.uint64(32)
        g *= np.uint64(0x9FB21C651E98DF25)
        g ^= g >> np.uint64(28)
        bits = np.uint64((1 << 20) - 1)  # slices are shorter than 2^20, so all order hashes alike
        low = (g & ~bits) | np.arange(len(g), dtype=np.uint64)
        span, width = self.length - k + 1, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[span - width : span - width + n])
        lens = np.diff(off)
        inside = np.repeat(off[1:], lens)[:n] - np.arange(n) >= self.length
        at = np.flatnonzero(inside)
        where = (low[at] & bits).astype(np.int64)
        return at, where, g[where]


def _changes(at: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Where a segment begins: another minimizer, or a string that does not follow the one before."""
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1)
    return new


def _packed(g: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes]:
    """The upper 48 bits of hashes (the block is told by other bits), and places with their lower halves first: less to shuffle."""
    place = place.astype(np.uint32).view(np.uint16).reshape(-1, 2)
    return np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes(), np.ascontiguousarray(place.T).tobytes()


def _unpacked(g: bytes, place: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(g) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(g, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64)[:, 0], np.ascontiguousarray(np.frombuffer(place, np.uint16).reshape(2, -1).T).view(np.uint32)[:, 0]


ASKED = f"b long, g binary, h binary, place binary, many binary, {KEY[0]} long, places binary"


def _ask(length: int, gram: int, blocks: int):
    """(h, text) -> each minimizer that the task met, once, in blocks; and the places of those that it met twice."""
    names = [x.split()[0] for x in ASKED.split(", ")]

    def sent(g: np.ndarray, h: np.ndarray, place: np.ndarray):
        _, first, back, n = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
        known = np.flatnonzero(n[back] > 1)
        cuts = np.append(np.flatnonzero(np.append(True, h[known][1:] != h[known][:-1])), len(known)) if len(known) else np.zeros(1, np.int64)
        for i in range(0, len(cuts) - 1, 4096):
            part = cuts[i : i + 4097]
            m = len(part) - 1
            places = [place[known[x:y]].tobytes() for x, y in zip(part[:-1].tolist(), part[1:].tolist(), strict=True)]
            null = pa.nulls(m, pa.binary())
            # they ask no block, so they may go anywhere
            yield pa.RecordBatch.from_arrays([pa.array(-1 - (h[known[part[:-1]]] & 4095)), null, null, null, null, pa.array(h[known[part[:-1]]]), pa.array(places, pa.binary())], names)
        b = (H.mix(g[first]) % np.uint64(blocks)).astype(np.int64)
        by = np.lexsort((first, b))
        b, at, many = b[by], first[by], (n[by] > 1).astype(np.uint8)
        cuts = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
        for i in range(0, len(cuts) - 1, 256):
            part = cuts[i : i + 257]
            ends = list(zip(part[:-1].tolist(), part[1:].tolist(), strict=True))
            packed = [_packed(g[at[x:y]], place[at[x:y]]) for x, y in ends]
            cols = [pa.array(v, pa.binary()) for v in ([p[0] for p in packed], [h[at[x:y]].tobytes() for x, y in ends], [p[1] for p in packed])]
            yield pa.RecordBatch.from_arrays([pa.array(b[part[:-1]]), *cols, pa.array([many[x:y].tobytes() for x, y in ends], pa.binary()), pa.nulls(len(ends), pa.int64()), pa.nulls(len(ends), pa.binary())], names)

    def run(batches):
        minimizers, held, n_held = _Minimizers(length, gram), [], 0
        for batch in batches:
            who = np.asarray(batch.column(0))
            for a, data, off, before in _slices(batch.column(1), length):
                at, where, g = minimizers(data, off)
                new = _changes(at, where)
                where, g = where[new], g[new]
                doc = np.searchsorted(off, where, "right") - 1
                held.append((g, who[a + doc], (where - off[doc] + before).astype(np.uint32)))
                n_held += len(g)
                if n_held > HELD:
                    yield from sent(*map(np.concatenate, zip(*held, strict=True)))
                    held, n_held = [], 0
        if n_held:
            yield from sent(*map(np.concatenate, zip(*held, strict=True)))

    return run


PLACES = f"{KEY[0]} long, places binary"


def _answer(batches):
    """Rows sorted by block -> the places of minimizers that occur twice in it."""

    def answered(rows: list[tuple]):
        g, place = (np.concatenate(x) for x in zip(*(_unpacked(r[0], r[2]) for r in rows), strict=True))
        h, many = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((1, np.int64), (3, np.uint8)))
        by = np.argsort(g, kind="stable")
        new = np.append(True, g[by][1:] != g[by][:-1])
        group = np.cumsum(new) - 1
        n = np.bincount(group, weights=1.0 + many[by])
        hit = by[(n[group] > 1) & (many[by] == 0)]
        hit = hit[np.lexsort((place[hit], h[hit]))]
        cuts = np.append(np.flatnonzero(np.append(True, h[hit][1:] != h[hit][:-1])), len(hit)) if len(hit) else np.zeros(1, np.int64)
        for i in range(0, len(cuts) - 1, 4096):
            part = cuts[i : i + 4097]
            places = [place[hit[x:y]].tobytes() for x, y in zip(part[:-1].tolist(), part[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h[hit[part[:-1]]]), pa.array(places, pa.binary())], [KEY[0], "places"])

    now, rows = None, []
    for batch in batches:
        b = np.asarray(batch.column(0))
        if (b < 0).any():
            own = batch.filter(pa.array(b < 0))
            yield pa.RecordBatch.from_arrays([own.column(5), own.column(6)], [KEY[0], "places"])
        for i in np.flatnonzero(b >= 0).tolist():
            if b[i] != now and rows:
                yield from answered(rows)
                rows = []
            now = b[i]
            rows.append(tuple(batch.column(c)[i].as_py() for c in (1, 2, 3, 4)))
    if rows:
        yield from answered(rows)


#: kind 0: the strings from lo to hi are removed; 1: a segment, whose strings start at lo and the next places (hi is null), with its gram at m.
ROW = f"kind int, key long, ord long, {KEY[0]} long, {KEY[1]} long, lo long, hi long, m int, seg binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], NAMES)


def _merged(h: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Removed strings, adjacent ones as one row, dealt by document."""
    by = np.lexsort((lo, k, h))
    h, k, lo, hi = h[by], k[by], lo[by], hi[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (lo[1:] > hi[:-1] + 1)
    first = np.flatnonzero(new)
    m = len(first)
    hi = np.maximum.reduceat(hi, first) if m else hi
    zero = pa.array(np.zeros(m, np.int32))
    return pa.RecordBatch.from_arrays([zero, pa.array(H.mix(h[first].view(np.uint64)).view(np.int64)), pa.nulls(m, pa.int64()), pa.array(h[first]), pa.array(k[first]), pa.array(lo[first]), pa.array(hi), zero, pa.nulls(m, pa.binary())], NAMES)


def _segments(length: int, gram: int):
    """(h, k, ord, text, places that repeat) -> the segments of these places; what is met twice is sent once, the later copies are removed."""

    def run(batches):
        minimizers = _Minimizers(length, gram)
        for batch in batches:
            h, k, order = (np.asarray(batch.column(i)) for i in range(3))
            rank = np.empty(len(h), np.int64)
            by = np.lexsort((k, order))
            new = np.append(True, (order[by][1:] != order[by][:-1]) | (k[by][1:] != k[by][:-1]))[: len(by)]
            rank[by] = np.cumsum(new)
            seen: dict[bytes, int] = {}
            got: list[tuple[np.ndarray, ...]] = []
            owner: list[int] = []
            size = n_got = 0

            def sent():
                row, lo, n, m, g = (np.concatenate(c) for c in zip(*got, strict=True))
                own = np.array(owner)
                place = (rank[row] << 32) | lo
                least = np.full(len(own), np.iinfo(np.int64).max)
                np.minimum.at(least, own, place)
                later = place > least[own]
                if later.any():
                    r = row[later]
                    yield _merged(h[r], k[r], lo[later], lo[later] + n[later] - 1)
                content = list(seen)
                number = np.empty(len(own), np.int64)
                number[np.fromiter(seen.values(), np.int64, len(seen))] = np.arange(len(seen))
                _, first = np.unique(own[~later], return_index=True)
                at = np.flatnonzero(~later)[first]  # a row for each content: equal rows of the table are one document
                for i in range(0, len(at), 20_000):
                    x = at[i : i + 20_000]
                    r = row[x]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ones(len(x), np.int32)), pa.array(g[x].view(np.int64)), *(pa.array(v[r]) for v in (order, h, k)), pa.array(lo[x]), pa.nulls(len(x), pa.int64()), pa.array(m[x].astype(np.int32)), pa.array([content[j] for j in number[own[x]].tolist()], pa.binary())],
                        NAMES,
                    )

            marks = {}
            for a, data, off, before in _slices(batch.column(3), length):
                at, where, g = minimizers(data, off)
                if not len(at):
                    continue
                marked = np.zeros(len(data), bool)
                for d in range(len(off) - 1):
                    if a + d not in marks:
                        marks = {a + d: np.frombuffer(b"".join(batch.column(4)[a + d].as_py()), np.uint32).astype(np.int64)}
                    place = marks[a + d] - before
                    marked[off[d] + place[(place >= 0) & (place < off[d + 1] - off[d])]] = True
                may = marked[where]
                at, where, g = at[may], where[may], g[may]
                if not len(at):
                    continue
                first = np.flatnonzero(_changes(at, where))
                n = np.diff(np.append(first, len(at)))
                s = at[first]
                doc = np.searchsorted(off, s, "right") - 1
                got.append((a + doc, s - off[doc] + before, n, where[first] - s, g[first]))
                raw = data.tobytes()
                for x, y in zip(s.tolist(), (s + n + length - 1).tolist(), strict=True):
                    owner.append(seen.setdefault(raw[x:y], n_got))
                    n_got += 1
                    size += y - x
                if size > COMPARED:
                    yield from sent()
                    seen, got, owner, size, n_got = {}, [], [], 0, 0
            if got:
                yield from sent()

    return run


def _split(seg: bytes, lo: int, m: int, gram: int, length: int) -> list[tuple[int, int, int, bytes]]:
    """(key, lo, m, segment) of a segment's strings by a longer gram: on the left for those that have enough there, else on the right."""
    more = (length - gram + 1) // 2
    n, out = len(seg) - length + 1, []
    cut = min(n, max(0, m - more + 1))  # strings up to here have ``more`` bytes before the gram
    for x, y, begin in ((0, cut, m - more), (cut, n, m)):
        if x < y:
            around = seg[begin : begin + gram + more]
            key = int.from_bytes(hashlib.blake2b(around, digest_size=8, person=b"left" if begin < m else b"right").digest(), "little", signed=True)
            out.append((key, lo + x, begin - x, seg[x : y + length - 1]))
    return out


def _index(length: int, gram: int):
    """Rows sorted by (key, document order) -> removed strings; segments of groups that are too large for an index, dealt anew."""

    def run(batches):
        texts: list[bytes] = []
        who: list[tuple] = []  # h, k, lo of each text
        removed: list[tuple] = []
        again: list[tuple] = []
        seen: dict[bytes, tuple] = {}
        now, group, size, own, large = None, 0, 0, 0, False

        def marked():
            rows = np.array(removed, np.int64).reshape(-1, 4)
            if texts:
                t, at = run_index.repeats(texts, length)
                w = np.array(who, np.int64)[t]
                rows = np.concatenate([rows, np.stack([w[:, 0], w[:, 1], w[:, 2] + at, w[:, 2] + at], axis=1)])
            yield _merged(*rows.T)

        for batch in batches:
            kind = np.asarray(batch.column(0))
            if (kind == 0).any():
                yield batch.filter(pa.array(kind == 0))
            for key, order, h, k, lo, m, seg in zip(*(batch.filter(pa.array(kind == 1)).column(i).to_pylist() for i in (1, 2, 3, 4, 5, 7, 8)), strict=True):
                if key != now:
                    if size >= PIECE or len(removed) > 200_000:
                        yield from marked()
                        texts, who, removed, size = [], [], [], 0
                    now, group, own, seen, large = key, len(texts), 0, {}, False
                first = seen.get(seg)
                if first is not None:
                    if first != (h, k, lo):
                        removed.append((h, k, lo, lo + len(seg) - length))
                    continue
                if not large:
                    seen[seg] = (h, k, lo)
                    own += len(seg)
                    if own > LARGE and gram < length:
                        large = True
                        for (h2, k2, lo2), (o2, m2), s2 in zip(who[group:], extra, texts[group:], strict=True):
                            again.extend((1, x[0], o2, h2, k2, x[1], None, *x[2:]) for x in _split(s2, lo2, m2, gram, length))
                        size -= sum(map(len, texts[group:]))
                        del texts[group:], who[group:]
                        seen = {}
                if large:
                    again.extend((1, x[0], order, h, k, x[1], None, *x[2:]) for x in _split(seg, lo, m, gram, length))
                    if len(again) > 20_000:
                        yield _batch(again)
                        again = []
                    continue
                if len(texts) == group:
                    extra: list[tuple] = []
                texts.append(seg)
                who.append((h, k, lo))
                extra.append((order, m))
                size += len(seg)
        yield from marked()
        yield _batch(again)

    return run


def _cut(length: int, with_kept: bool):
    """(id, text, lists of lo and hi) -> the digest of each text without the strings that start at lo to hi."""

    def run(batches):
        for batch in batches:
            n_bytes, removed, spans, digests, kept = [], [], [], [], []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                raw = memoryview(text.as_buffer())
                pieces, at, gone, n_spans = [], 0, 0, 0
                if runs.is_valid and len(runs.values):
                    lo, hi = (np.asarray(x) for x in runs.values.flatten())
                    by = np.argsort(lo)
                    lo, end = lo[by], np.maximum.accumulate(hi[by]) + length
                    new = np.append(True, lo[1:] > end[:-1])  # touching runs are one span
                    for x, y in zip(lo[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)].tolist(), strict=True):
                        pieces.append(raw[at:x])
                        at, gone, n_spans = y, gone + y - x, n_spans + 1
                pieces.append(raw[at:])
                text = b"".join(pieces)
                n_bytes.append(len(raw)), removed.append(gone), spans.append(n_spans), digests.append(hashlib.sha256(text).hexdigest())
                if with_kept:
                    kept.append(text)
            cols, names = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(*((cols, names) if not with_kept else ([*cols, pa.array(kept, pa.binary())], [*names, "kept"])))

    return run


def removed_strings(keyed: DataFrame, n_bytes: int, length: int, gram: int) -> DataFrame:
    """keyed(KEY, ord, text) -> (KEY, lo, hi): starts, first to last, of strings that also start earlier."""
    blocks = max(LEAST_BLOCKS, n_bytes // BLOCK_BYTES)
    asked = keyed.select(KEY[0], "text").mapInArrow(_ask(length, gram, blocks), ASKED)
    places = asked.repartition("b").sortWithinPartitions("b").mapInArrow(_answer, PLACES).groupBy(F.col(KEY[0]).alias("__nl_r")).agg(F.collect_list("places").alias("places"))
    rows = keyed.join(places, F.col(KEY[0]) == F.col("__nl_r")).select(*KEY, "ord", "text", "places").mapInArrow(_segments(length, gram), ROW)
    done = None
    while True:
        found = scratch(rows.repartition("key").sortWithinPartitions("key", "ord", KEY[1], "lo").mapInArrow(_index(length, gram), ROW), "repeats")
        runs = found.filter("kind = 0").select(*KEY, "lo", "hi")
        done = runs if done is None else done.unionByName(runs)
        rows = found.filter("kind = 1")
        if rows.isEmpty():
            return done
        gram += (length - gram + 1) // 2


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int | None = None, with_kept: bool = True) -> DataFrame:
    """docs(doc_id long, text string, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]; one row per input row.

    Removes each byte covered by a string of ``length`` bytes of one text (as UTF-8) that also starts earlier: in a document
    of smaller id, or in the same one. Overlapping occurrences count; all strings are judged on the input. What is left
    is concatenated; it may be cut inside a character, so it is binary. n_spans counts the maximal removed runs.

    Null texts are empty; texts shorter than ``length`` keep all. Null ids come before all others. Rows that share an id
    stand in the order of a hash of their texts; repeated rows are one document and are cut alike. Very long texts are
    read whole, in slices. Extra columns are ignored; an empty table gives an empty result.
    """
    gram = length // 2 if gram is None else gram
    if not 0 < gram <= length:
        raise ValueError("gram must lie between 1 and length")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias(KEY[0]), F.xxhash64("text").alias(KEY[1]), F.coalesce("doc_id", F.lit(BEFORE_ALL)).alias("ord"), "doc_id", "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = removed_strings(keyed, n_bytes, length, gram).groupBy(F.col(KEY[0]).alias("__nl_r"), F.col(KEY[1]).alias("__nl_s")).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    # the texts are dealt by the first key alone, as for the join before; the second one is checked on the way
    both = keyed.join(runs, (F.col(KEY[0]) == F.col("__nl_r")) & (F.col(KEY[1]).bitwiseXOR(F.col("__nl_s")) == 0), "left").select("doc_id", "text", "runs")
    return both.mapInArrow(_cut(length, with_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else ""))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), c AS (
  SELECT doc_id, c, substr(x, CAST(2000 * c + 1 AS BIGINT), 2198) AS s FROM (SELECT doc_id, x, unnest(range(len(x) // 2000 + 1)) AS c FROM d)
), w AS (
  SELECT doc_id, 1000 * c + j AS i, substr(s, CAST(2 * j + 1 AS BIGINT), 200) AS s FROM (SELECT *, unnest(range(len(s) // 2 - 99)) AS j FROM c WHERE len(s) >= 200)
), g AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, i) AS r FROM w) WHERE r > 1
), n AS (
  SELECT doc_id, i, sum(CASE WHEN i - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g)
), r AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM n GROUP BY doc_id, span)
), k AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substr(x, CAST(2 * since + 1 AS BIGINT), CAST(2 * (lo - since) AS BIGINT)), '' ORDER BY lo) || substr(any_value(x), CAST(2 * max(hi) + 1 AS BIGINT)) AS kept FROM r JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
