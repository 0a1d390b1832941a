"""MinHash near-deduplication with tensored banding.

Instead of one fresh group of hashes per table, ``collections`` small groups of
``width`` minhashes are computed, and a table's key is a *pair* of them: 16
collections of 2 give 120 tables of 4 rows from 32 hash functions, where plain
banding would take 480. Two documents of similarity 0.75 agree in two or more
of 16 collections with probability 1 - 4e-5.

Shape of the job, all of it in shuffles on keys that spread:
1. one pass over the texts makes a slim signature row per document (numpy);
2. equal shingle sets become one class, so thousands of exact copies are one row;
3. collection values that only one class has are dropped before pairs are formed;
4. in a bucket, each class is proposed with the one class that has most in
   common with others, so proposals are linear in the bucket's size; pairs whose
   sizes rule out the similarity are left out;
5. proposals are confirmed on full shingle sets, links become components;
6. documents of buckets that still hold several components meet once more, under
   each single collection value: the members outside its largest component
   (strays) with all of its members and with each other, on full shingle sets,
   in jobs of two blocks. Documents that can match none, as too many shingles
   of theirs are in no other set at hand, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import rows_over, scratch
from .components import components, extended

SHINGLE, THRESHOLD = 5, (75, 100)
COLLECTIONS, WIDTH = 16, 2
#: Members and shingles of a block. They bound the memory of a task, not which pairs are tested.
SMALL, BLOCK_SHINGLES = 128, 1 << 21
#: Shingles that a job counts at once.
COLUMNS = 4096
#: Up to this many pairs (some 10 MB) are sent to all tasks; more are joined by shuffling.
BROADCAST_PAIRS = 200_000


def _sets(hasher: H.WordHasher, data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document of a chunk, end to end, and how many each has."""
    h, doc, _, _ = hasher(data, off)
    n = len(off) - 1
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    g = H.grams(h, k)
    inside = doc[: len(g)] == doc[k - 1 :] if len(g) else np.zeros(0, bool)
    g, made = g[inside], np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.concatenate([H.grams(h[first[d] : first[d] + count[d]], int(count[d])) for d in short])
        g, made = np.insert(g, np.cumsum(made)[short], own), made + np.isin(np.arange(n), short)
    end = np.cumsum(made)
    for a, b in zip((end - made).tolist(), end.tolist(), strict=True):
        if b - a > 1:
            g[a:b].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = g[1:] != g[:-1]
    keep[(end - made)[made > 0]] = True
    sizes = np.add.reduceat(keep, (end - made)[made > 0]) if len(g) else np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    out[made > 0] = sizes
    return g[keep], out


def _signatures(k: int, collections: int, width: int):
    def run(batches):
        hasher = H.WordHasher(lower=True)
        add, mul = H.seeds(collections * width, 5), H.seeds(collections * width, 77) | np.uint64(1)
        for batch in batches:
            for a, b, data, off in H.chunks(batch.column(1)):
                g, size = _sets(hasher, data, off, k)
                n, full = b - a, np.flatnonzero(size)
                start = (np.cumsum(size) - size)[full]
                sums, bands = np.zeros((2, n), np.uint64), np.zeros((n, collections), np.uint64)
                if len(full):
                    for i in range(2):
                        sums[i, full] = np.add.reduceat(H.mix(g + np.uint64(1 + i)), start)
                    for c in range(collections):
                        v = np.full(len(full), c, np.uint64)
                        for f in range(c * width, (c + 1) * width):
                            v = H.mix(v * np.uint64(H.BASE_A) + np.minimum.reduceat((g ^ add[f]) * mul[f], start))
                        bands[full, c] = v
                flat = pa.array(bands.view(np.int64).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n),
                        pa.array(size),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * collections, flat),
                    ],
                    ["doc_id", "n_shingles", "s1", "s2", "bands"],
                )

    return run


def _full_sets(k: int):
    def run(batches):
        hasher = H.WordHasher(lower=True)
        for batch in batches:
            for a, b, data, off in H.chunks(batch.column(1)):
                g, size = _sets(hasher, data, off, k)
                end = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * 8
                sets = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(end), pa.py_buffer(np.ascontiguousarray(g))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], ["cls", "shingles"])

    return run


def _each_shingle(batches):
    for batch in batches:
        flat = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), [len(x) for x in flat])), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))], ["cls", "g"])


def _own(sets: DataFrame, among: DataFrame) -> DataFrame:
    """(cls, own): how many shingles each class among(cls) has that no other of them has."""
    each = sets.join(among.distinct().hint("merge"), "cls", "left_semi").mapInArrow(_each_shingle, "cls long, g long")
    return scratch(each.groupBy("g").agg(F.min("cls").alias("cls"), F.count("*").alias("n")).filter("n = 1").groupBy("cls").agg(F.count("*").alias("own")), "own")


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for i in range(len(batch)):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                if den * min(len(p), len(q)) < num * max(len(p), len(q)):
                    continue
                both = np.concatenate([p, q])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if den * common >= num * (len(both) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. Up to BROADCAST_PAIRS pairs are sent to the sets; more are shuffled."""
    ends = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("cls"), F.lit(True).alias("is_a")), F.struct(F.col("b").alias("cls"), F.lit(False).alias("is_a")))).alias("e")).select("a", "b", "e.*")
    met = sets.join(ends.hint("merge") if rows_over(pairs, BROADCAST_PAIRS) else F.broadcast(ends), "cls")
    both = met.groupBy("a", "b").agg(F.max(F.when(F.col("is_a"), F.col("shingles"))).alias("x"), F.max(F.when(~F.col("is_a"), F.col("shingles"))).alias("y"))
    return scratch(both.select("a", "b", "x", "y").mapInArrow(_confirm(*threshold), "a long, b long"), "links")


def _buckets(shared: DataFrame, member: DataFrame | None) -> DataFrame:
    """(cls, label, bands, mask, key): a row for each class and each pair of the collection values that it shares with others.

    A key is the exclusive or of its collections' values, mask has a bit for each
    of them, label is the class's component so far.
    """

    def pair(x, y):
        return F.struct(x["bit"].bitwiseOR(y["bit"]).alias("mask"), x["v"].bitwiseXOR(y["v"]).alias("key"))

    if member is None:
        own = shared.withColumn("label", F.col("cls"))
    else:
        own = shared.join(member, shared["cls"] == member["id"], "left").select("cls", "c", "size", F.coalesce("component", "cls").alias("label"))
    pairs = F.flatten(F.transform("c", lambda x, n: F.transform(F.slice("c", n + 2, F.size("c")), lambda y: pair(x, y))))
    return own.select("cls", "label", "c", "size", F.inline(pairs))


def _fits(x: Column, y: Column, threshold: tuple[int, int]) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return threshold[1] * F.least(x, y) >= threshold[0] * F.greatest(x, y)


def _proposals(buckets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Each class of a bucket with the first one: linear in the bucket. First is who has most collections in common with others, the same one in many buckets."""
    me = F.struct("cls", "size")
    w = Window.partitionBy("key").orderBy(F.size("c").desc(), F.xxhash64("cls"), "cls")
    both = buckets.select(me.alias("me"), F.first(me).over(w).alias("to"))
    both = both.filter((F.col("me.cls") != F.col("to.cls")) & _fits(F.col("me.size"), F.col("to.size"), threshold))
    return both.select(F.least("me.cls", "to.cls").alias("a"), F.greatest("me.cls", "to.cls").alias("b")).distinct()


def _blocks(buckets: DataFrame, block: int) -> DataFrame:
    """buckets(v, cls, label, size) -> (job, side, cls, label): each bucket cut into blocks, a job for every two blocks that may hold a pair to test.

    Members of the bucket's largest component are only met with the others, the
    strays; strays are met with all. Blocks have some ``block`` members, fewer if
    the sets are large, so no job grows with its bucket.
    """
    by_label = buckets.groupBy("v", "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    cut = by_label.groupBy("v").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max(F.struct("n", "label", "s")).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("labels")).filter("labels > 1")

    def blocks(n: Column, s: Column) -> Column:
        return F.greatest(F.ceil(n / F.lit(block)), F.ceil(s / F.lit(BLOCK_SHINGLES))).cast("int")

    cut = cut.select(F.col("v").alias("k"), "main", blocks(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("q"), blocks(F.col("m.n"), F.col("m.s")).alias("p"))
    rows = buckets.join(cut, F.col("v") == F.col("k"))
    is_main, h = F.col("label") == F.col("main"), F.xxhash64("cls")
    rows = rows.withColumn("at", F.when(is_main, F.col("q") + F.pmod(h, F.col("p"))).otherwise(F.pmod(h, F.col("q"))).cast("int"))
    with_ = F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("q")).otherwise(F.col("q") + F.col("p")) - 1)).alias("with")
    rows = rows.select("v", "cls", "label", "at", with_)
    i, j = F.least("at", "with"), F.greatest("at", "with")
    # side: 0 first block, 1 second, 2 both (a block with itself)
    return rows.select(F.xxhash64("v", i, j).alias("job"), F.when(i == j, 2).when(F.col("at") == i, 0).otherwise(1).alias("side"), "cls", "label")


def _pairs_of(label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """The similar pairs of one job, by row numbers, as far as they join components that the job has not joined yet."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return []
    size = np.array([len(x) for x in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    name, g = np.unique(flat, return_inverse=True)
    on_left, on_right = np.zeros((2, len(name)), bool)
    on_left[g[side[row] != 1]] = True
    on_right[g[side[row] != 0]] = True
    both = on_left & on_right
    g, row = (np.cumsum(both) - 1)[g[both[g]]], row[both[g]]
    by_g = np.argsort(g, kind="stable")
    g, row = g[by_g], row[by_g]
    at_left, at_right = np.zeros((2, len(sets)), np.int64)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    n_both = int(both.sum())
    for start in range(0, n_both, COLUMNS):
        wide = min(COLUMNS, n_both - start)
        a, b = np.searchsorted(g, [start, start + wide])
        x, y = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        r, c = row[a:b], g[a:b] - start
        x[at_left[r[side[r] != 1]], c[side[r] != 1]] = 1
        y[at_right[r[side[r] != 0]], c[side[r] != 0]] = 1
        common += x @ y.T
    common = common.astype(np.int64)
    near = (den * common >= num * (size[left][:, None] + size[right][None, :] - common)) & (label[left][:, None] != label[right][None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(int(label[left[i]])), find(int(label[right[j]]))
        if a != b:
            root[a] = b
            out.append((left[i], right[j]))
    return out


def _across(num: int, den: int):
    """Rows (job, side, cls, label, shingles), sorted by job -> links (a, b)."""

    def links(t: pa.Table) -> list[tuple[int, int]]:
        job = t.column(0).to_numpy()
        cls, label, side = t.column(2).to_numpy(), t.column(3).to_numpy(), t.column(1).to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(4)]
        cuts = [0, *(np.flatnonzero(job[1:] != job[:-1]) + 1).tolist(), len(job)]
        found = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            found += [(cls[a + i], cls[a + j]) for i, j in _pairs_of(label[a:b], side[a:b], sets[a:b], num, den)]
        return [(min(x, y), max(x, y)) for x, y in found]

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        ab = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the last job, which may go on
        for batch in batches:
            if not len(batch):
                continue
            job = batch.column(0).to_numpy()
            if held and held[0].column(0)[0].as_py() != job[0]:
                yield batch_of(links(pa.Table.from_batches(held)))
                held = []
            first = int(np.searchsorted(job, job[-1]))
            if first:
                yield batch_of(links(pa.Table.from_batches([*held, batch.slice(0, first)])))
                held = []
            held.append(batch.slice(first))
        if held:
            yield batch_of(links(pa.Table.from_batches(held)))

    return run


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, collections: int = COLLECTIONS, width: int = WIDTH, small: int = SMALL
) -> DataFrame:
    """docs(doc_id long, text string, ...) -> doc_id, n_shingles, component_id, kept; one row per input row.

    Texts are lower-cased (A-Z) and cut into words; a document's set is its
    distinct shingles, or the whole sequence if it has fewer words. Links join
    documents whose sets have intersection/union of at least the threshold.

    Null, empty and blank texts have no set: they link with nothing and are
    kept. Repeated rows get the same component; rows with one doc_id count as
    one document, so each of them is kept if its id leads its group. A null
    doc_id takes its class's component if some other member has an id, else
    null, and is then kept. Extra columns are ignored. An empty table gives
    an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch(docs.mapInArrow(_signatures(shingle, collections, width), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "signatures")
    is_set = signed.filter("n_shingles > 0")
    classes = scratch(is_set.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("cls"), F.first("bands").alias("bands")), "classes")

    values = classes.filter("cls is not null").select("cls", "n_shingles", F.posexplode("bands").alias("i", "v")).select("cls", F.col("n_shingles").alias("size"), F.expr("shiftleft(1, i)").alias("bit"), F.xxhash64("i", "v").alias("v"))
    met = values.groupBy("bit", "v").agg(F.count("*").alias("n")).filter("n > 1")
    shared = values.join(met.hint("merge"), ["bit", "v"]).groupBy("cls").agg(F.min("size").alias("size"), F.sort_array(F.collect_list(F.struct("bit", "v"))).alias("c"))
    shared = scratch(shared.filter(F.size("c") > 1), "shared")
    texts = docs.join(shared.select("cls").hint("merge"), F.col("doc_id") == F.col("cls"), "left_semi").select("doc_id", "text")
    sets = scratch(texts.mapInArrow(_full_sets(shingle), "cls long, shingles binary"), "sets")

    tested = scratch(_proposals(_buckets(shared, None), threshold), "pairs")
    member = components(_verified(tested, sets, threshold))
    buckets = _buckets(shared, member)
    mixed = buckets.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    hand = scratch(buckets.join(mixed.hint("merge"), "key", "left_semi").groupBy("cls").agg(F.min("label").alias("label"), F.min("size").alias("size"), F.first("c").alias("c")), "mixed")
    # One whose own shingles alone rule out any match goes.
    own = _own(sets, hand.select("cls"))
    hand = hand.join(own, "cls", "left").fillna(0, ["own"]).filter(threshold[1] * (F.col("size") - F.col("own")) >= threshold[0] * F.col("size"))
    jobs = _blocks(scratch(hand.select("cls", "label", "size", F.explode("c.v").alias("v")), "hand"), small)
    held = jobs.join(sets.hint("merge"), "cls").select("job", "side", "cls", "label", "shingles")
    links = held.repartition("job").sortWithinPartitions("job").mapInArrow(_across(*threshold), "a long, b long")
    member = extended(member, scratch(links.distinct(), "links"))

    named = classes.join(member, classes["cls"] == member["id"], "left").select("n_shingles", "s1", "s2", F.coalesce("component", "cls").alias("component_id"))
    # An empty set is a class of its own: only its own doc_id leads it.
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(named, ["n_shingles", "s1", "s2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.r
), c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id
"""
