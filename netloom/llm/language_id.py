"""Language identification by compression.

For each language, a sample of its texts is the raw-content dictionary of a
zstandard compressor. A text is encoded with each dictionary, in pieces that
each start from the dictionary anew; the language with the smallest sum wins.
If the runner-up is nearly as small, the prediction is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The bound on what is learned from: whole texts, by language, until they have so many bytes together, and so many at most.
DICTIONARY, SAMPLE_DOCS = 1 << 17, 256
#: Longer texts are taken only where shorter ones do not fill the dictionary.
SHORT = 4000
PIECE, LEVEL = 4096, 6
#: Rejected if the best size is not smaller than the next by this share.
MARGIN = 0.01
LEARNED_IF = "crc32(cast(cast(doc_id as string) as binary)) % 3"
#: ASCII other than letters and spaces says nothing about the language.
NOISE = bytes(c for c in range(128) if not (chr(c).isalpha() or chr(c) in " '"))
TO_SPACE = bytes(32 if c in b"\t\n\x0b\f\r" else c for c in range(256))


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(TO_SPACE).translate(None, NOISE.translate(None, b" "))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, n_bytes: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionaries by language from docs(doc_id, text, lang): whole texts, in order of a hash of the id, short ones first.

    A text is taken if those before it have fewer than ``n_bytes`` together, so
    a dictionary ends with the text that fills it. Rows with null text, lang or
    doc_id teach nothing. The number of languages is taken to be a few hundred
    at most.
    """
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    order = [F.length("text") > SHORT, F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    w = Window.partitionBy("lang").orderBy("long", "h", "doc_id", "t")
    ids = rows.select("lang", order[0].alias("long"), order[1].alias("h"), "doc_id", order[3].alias("t"), F.octet_length("text").alias("n"))
    ids = ids.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= sample_docs)  # a few rows a language from here on
    ids = ids.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("before") < n_bytes)
    ids = ids.select("lang", "doc_id", "t").distinct()
    chosen = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(ids), ["lang", "doc_id", "t"], "left_semi").select("lang", "doc_id", "text").distinct()
    found: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        found.setdefault(r["lang"], []).append(r["text"])
    return {k: b" ".join(normal(t) for t in v) for k, v in sorted(found.items())}


def _predict(dictionaries: dict[str, bytes], margin: float):
    def run(batches):
        import regex
        import zstandard

        langs, made = sorted(dictionaries), []
        for k in langs:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        letter = regex.compile(r"\p{L}")
        for batch in batches:
            pred, score, rejected = [], [], []
            for i in range(len(batch)):
                text = batch.column(2)[i].as_py()
                if not langs or text is None or not letter.search(text):
                    pred.append("und"), score.append(0.0), rejected.append(True)
                    continue
                raw = normal(text)
                pieces = [raw[x : x + PIECE] for x in range(0, len(raw), PIECE)] or [b""]
                size = [sum(len(c.compress(p)) for p in pieces) for c in made]
                best = int(np.argmin(size))
                rest = min((s for j, s in enumerate(size) if j != best), default=2 * size[best] + 1)
                gap = (rest - size[best]) / max(1, rest)
                pred.append(langs[best]), score.append(gap / (gap + 0.02)), rejected.append(gap < margin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return run


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs(doc_id long, text string, ...) -> doc_id, held_out, lang_pred, score, rejected; one row per input row.

    Whole texts are read, very long ones in pieces, and nothing but the text. ``und`` with score 0 where
    the text is null, has no letter, or nothing was learned. score grows with
    the margin between the best language and the next, from 0 to 1; rejected
    marks narrow margins. held_out is false for a null doc_id. Ties go to the
    first language by name. Extra columns are ignored; an empty table gives an
    empty result.
    """
    held = F.coalesce(F.expr(LEARNED_IF) == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predict(dictionaries, margin), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify_languages(docs: DataFrame, **how) -> DataFrame:
    """Learns from the rows that are not held out, and predicts for all."""
    return predict_language(docs, fit(docs.filter(f"{LEARNED_IF} <> 1")), **how)
