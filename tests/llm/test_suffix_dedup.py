import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import queries, run_index, suffix_dedup

OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
DOCS = "doc_id long, text string"


def plain(docs, length):
    """Every string against a set of those before, documents by id, nulls first; repeated rows are one document."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t in docs}, key=lambda d: (d[0] is not None, d[0] or 0)):
        raw = t.encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            s = raw[at : at + length]
            if s in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (at and gone[at - 1]) for at, g in enumerate(gone))
        out[i, t] = (i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[i, t or ""] for i, t in docs), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in OUT) for r in df.collect()), key=repr)


def passages(seed, n, words=("ab", "abc", "é", "日本", "xyz ", "aaaa", "\x00", "q")):
    """Texts that share passages, some of them periodic."""
    rng = random.Random(seed)
    shared = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(12)] + ["a" * 90, "ab" * 60]
    return [(rng.randrange(10_000) if i % 7 else None if i == 7 else i, "".join(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice(words) for _ in range(15)) for _ in range(rng.randrange(12)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_run_index_against_sorted_suffixes(seed):
    rng = random.Random(seed)
    texts = list({bytes(rng.choice(b"abc\x00") for _ in range(rng.randrange(1, 60))) * rng.randrange(1, 4) for _ in range(40)})
    index = run_index.build(texts)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    rest = {int(begin[t]) + k: texts[t][k:] for t in range(len(texts)) for k in range(len(texts[t]) + 1)}
    order = sorted(rest, key=lambda i: ([c + 1 for c in rest[i]], i))
    match, to = run_index.matching_statistics(index, 1000)
    for before, at in zip([-1, *order], order, strict=False):
        same = 0
        while before >= 0 and same < min(len(rest[before]), len(rest[at])) and rest[before][same] == rest[at][same]:
            same += 1
        assert (to[at], match[at]) == (before, same) or (before == -1 and match[at] == 0)
    seen, want = set(), []
    for t, text in enumerate(texts):
        for k in range(len(text) - 6):
            if text[k : k + 7] in seen:
                want.append((t, k))
            seen.add(text[k : k + 7])
    assert list(zip(*(x.tolist() for x in run_index.repeats(texts, 7)), strict=True)) == want


def test_copies_add_no_runs():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(3000))
    one, many = (len(run_index.build([text + bytes([97 + i]) for i in range(n)]).sample) for n in (2, 20))
    assert many < one + 20 * 4


@pytest.mark.parametrize(("length", "gram", "piece", "chunk", "held"), [(20, 10, 4 << 20, 1 << 18, 1 << 21), (20, 10, 200, 64, 50), (21, 5, 60, 128, 1000), (13, 13, 4 << 20, 1 << 18, 1 << 21), (9, 1, 30, 32, 10)])
def test_strings_against_brute_force(spark, monkeypatch, length, gram, piece, chunk, held):
    """Also in small slices, in small indexes and with groups dealt anew up to the whole string."""
    for name, v in (("PIECE", piece), ("LARGE", piece), ("CHUNK", chunk), ("HELD", held), ("COMPARED", 10 * piece)):
        monkeypatch.setattr(suffix_dedup, name, v)
    docs = passages(length, 120)
    docs = list({i: (i, t) for i, t in docs}.values())
    got_rows = got(suffix_dedup.remove_repeated_strings(spark.createDataFrame(docs, DOCS).repartition(5), length, gram))
    assert got_rows == plain(docs, length) and sum(r[2] for r in got_rows)


def test_a_passage_in_all_texts_is_dealt_anew(spark, monkeypatch):
    """A line of 70 bytes in every text, in other surroundings each time, is no match; one of 100 is."""
    monkeypatch.setattr(suffix_dedup, "LARGE", 2000)
    rng = random.Random(3)
    noise = lambda: "".join(rng.choice("abcdefghij") for _ in range(60))
    short, long = "-" + "s" * 30 + noise()[:39], noise() + noise()[:41]
    docs = [(i, noise() + short + noise() + (long if i % 2 else "") + noise()) for i in range(200)]
    rows = got(suffix_dedup.remove_repeated_strings(spark.createDataFrame(docs, DOCS).repartition(6), with_kept=False))
    assert rows == plain(docs, 100) and sum(r[3] for r in rows) == 99


def test_suffix_odd_rows(odd, nothing, spark):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    clash = odd.withColumns({"n_bytes": F.lit("x"), "ord": F.lit(1), "key": F.lit(2), "runs": F.lit(3), "places": F.lit(4), "lo": F.lit(5)})
    out = suffix_dedup.remove_repeated_strings(clash, 8)
    assert out.columns == [*OUT, "kept"] and got(out) == plain(docs, 8)
    assert suffix_dedup.remove_repeated_strings(nothing).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeated_strings(odd, 8, 9)


def test_suffix_repeated_rows_ties_and_kept_bytes(spark):
    twice = "one two three four five"
    docs = [(1, twice), (1, twice), (2, "x" + twice), (3, None), (None, twice[4:]), (None, twice[4:])]
    out = suffix_dedup.remove_repeated_strings(spark.createDataFrame(docs, DOCS), 12)
    assert got(out) == plain(docs, 12)
    kept = {r["doc_id"]: bytes(r["kept"]) for r in out.collect()}
    assert kept == {1: b"one ", 2: b"x", 3: b"", None: twice[4:].encode()}


def test_suffix_very_long_text(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    docs = [(1, base + base[1000:300_000]), (2, base[650_000:] + "y" * 5000), (3, base[:150])]
    rows = got(suffix_dedup.remove_repeated_strings(spark.createDataFrame(docs, DOCS), with_kept=False))
    assert [r[2:4] for r in rows] == [r[2:4] for r in plain(docs, 100)]


def test_suffix_query_against_sql(spark, duck, data_dir):
    want = duck.sql(f"SELECT {', '.join(OUT)} FROM ({suffix_dedup.ORACLE})").fetchall()
    assert got(queries.op12_suffix_array_dedup(spark, data_dir)) == sorted(want, key=repr) and sum(r[2] for r in want)
