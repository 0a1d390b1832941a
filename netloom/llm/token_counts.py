"""Token counts without token ids: pieces are counted once per distinct pre-token.

A sentencepiece vocabulary in which the space mark only begins pieces never
merges over a space, so a text's tokens are those of its pre-tokens (a run of
spaces with what follows it). Each batch is cut into pre-tokens and
dictionary-encoded; pieces are counted for the entries, joined to the texts'
pre-token frequencies by their codes and summed. That join stays in the task
that read the rows: shuffling all (document, pre-token) pairs would move more
than twice the input, and the table of distinct pre-tokens has no size bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H

MARK = "▁"
LIMIT = 4096
#: Distinct pre-tokens whose counts a task remembers; then it starts anew.
REMEMBERED = 400_000
CHUNK = 8 << 20


def splits_at_spaces(model_file: str) -> bool:
    """Whether no piece holds the space mark after another character, and none mixes several marks with text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return all(MARK not in p.lstrip(MARK) for p in map(sp.id_to_piece, range(sp.get_piece_size())))


def _counts(model_file: str, limit: int):
    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        known: dict[str, int] = {}
        for batch in batches:
            ids, texts = batch.columns
            texts = texts.fill_null("")
            sizes = np.asarray(pc.binary_length(texts))
            # The library puts one space mark before a text; with a real space there, all pre-tokens look alike.
            plain = pc.replace_substring(texts, MARK, " ")
            marked = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
            for a, b, data, off in H.chunks(marked, CHUNK):
                n_tokens = np.zeros(b - a, np.int64)
                if len(data):
                    space = data == 0x20
                    begins = space.copy()
                    begins[1:] &= ~space[:-1]
                    begins[off[:-1][off[:-1] < off[1:]]] = True
                    at = np.flatnonzero(begins)
                    tokens = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
                    coded = tokens.dictionary_encode()
                    entries = coded.dictionary.to_pylist()
                    fresh = [x for x in entries if x not in known]
                    if len(known) + len(fresh) > REMEMBERED:
                        known, fresh = {}, entries
                    known.update(zip(fresh, map(len, sp.encode([x[1:] for x in fresh], num_threads=1)), strict=True))
                    known[" "] = 1  # a last single space; alone it would be an empty text
                    pieces = np.fromiter((known[x] for x in entries), np.int64, len(entries))
                    total = np.concatenate([[0], np.cumsum(pieces[np.asarray(coded.indices)])])
                    edge = np.searchsorted(at, off)
                    n_tokens = total[edge[1:]] - total[edge[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(sizes[a:b].astype(np.int64)), pa.array(n_tokens), pa.array(n_tokens > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, model_file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id long, text string, ...) -> doc_id, n_bytes, n_tokens, over_limit; one row per input row.

    n_tokens is what sentencepiece returns for the whole text, without begin and
    end tokens; strings such as ``</s>`` in texts are plain text. ``model_file``
    must be at the same path on all machines; a model whose pieces run over
    spaces is refused. Null and empty texts have 0 bytes and 0 tokens. Repeated
    rows and null ids are passed through. Extra columns are ignored; an empty
    table gives an empty result.
    """
    if model_file is None:
        import public_tokenizers

        model_file = str(public_tokenizers.path("piece_bpe_32k.model"))
    if not splits_at_spaces(model_file):
        raise ValueError("pieces of this model run over spaces")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counts(model_file, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
