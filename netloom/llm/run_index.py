"""A run-compressed Burrows-Wheeler index over a few MB of short texts, in numpy.

The index keeps, of the transform of all texts, where its runs of equal symbols
begin, and for each begin a sample: a text position and its neighbour in suffix
order. Between samples, neighbours move in step (a run stays one run when all its
suffixes grow by the symbol that they share), so the samples alone give every
position's neighbour and, after one comparison per sample, the length of its
longest match: the matching statistics of the texts against the rest of the
collection. Copies add no runs, so a repetitive collection has few samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class RunIndex:
    symbols: np.ndarray  # bytes plus one, 0 behind each text
    left: np.ndarray  # symbols up to the end of the text
    heads: np.ndarray  # 8 symbols from each position on, as a number
    sample: np.ndarray  # sampled positions, ascending; the last position is one
    neighbour: np.ndarray  # of each, the position before it in suffix order; -1 for the first suffix


def _heads(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight symbols from each position as one number, zeros behind a text's end."""
    n = len(symbols)
    out = np.zeros(n, np.uint64)
    for j in range(8):
        here = np.zeros(n, np.uint64)
        here[: n - j] = symbols[j:]
        here[left <= j] = 0
        out |= here << np.uint64(56 - 8 * j)
    return out


def _suffixes(left: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """All positions in the order of their texts' rests, equal rests by position: prefix doubling, from 8 symbols on, of what is not told apart yet."""
    n = len(left)
    order = np.argsort(heads)
    key, slots, rank, width = heads[order], np.arange(n), np.empty(n, np.int64), 8
    most = int(left.max(initial=0))
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        start = slots[new]
        size = np.diff(np.append(np.flatnonzero(new), len(slots)))
        rank[order[slots]] = np.repeat(start, size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots) or width > most:
            break
        at = order[slots]
        rest = left[at] > width
        key = rank[at] * (n + 1)
        key[rest] += rank[at[rest] + width] + 1
        by = np.argsort(key)
        order[slots], key = at[by], key[by]
        width *= 2
    if len(slots):
        at = order[slots]
        order[slots] = at[np.argsort(rank[at] * n + at)]
    return order


def build(texts: list[bytes]) -> RunIndex:
    """The index of these texts, which must not hold the byte 255 (no UTF-8 text does)."""
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens + 1) - 1
    symbols = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    n = len(symbols)
    left = np.repeat(ends, lens + 1) - np.arange(n)
    heads = _heads(symbols, left)
    order = _suffixes(left, heads)
    before = symbols[order - 1]  # the transform; the first text's start is preceded by the last end
    begins = np.ones(n, bool)
    begins[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    sample = np.unique(np.append(order[begins] - 1, n - 1))
    sample = sample[sample >= 0]
    at = slot[sample]
    return RunIndex(symbols, left, heads, sample, np.where(at > 0, order[at - 1], -1))


def _matched(index: RunIndex, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Symbols that the rests from a and from b share, up to ``most``; 0 where b is -1."""
    out = np.zeros(len(a), np.int64)
    cap = np.where(b < 0, 0, np.minimum(np.minimum(index.left[a], index.left[b]), most))
    live = np.flatnonzero(cap > 0)
    done = 0
    while len(live):
        differ = index.heads[a[live] + done] ^ index.heads[b[live] + done]
        same = sum((differ < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(8))
        out[live] = done + same
        done += 8
        live = live[(same == 8) & (cap[live] > done)]
    return np.minimum(out, cap)


def matching_statistics(index: RunIndex, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position: the length of its match with its neighbour in suffix order (exact below ``most``), and that neighbour."""
    n = len(index.symbols)
    length = _matched(index, index.sample, index.neighbour, most)
    span = np.diff(np.append(-1, index.sample))
    back = np.repeat(index.sample, span) - np.arange(n)
    return np.repeat(length, span) + back, np.repeat(index.neighbour, span) - back


def repeats(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of all strings of ``length`` that also start earlier, in this text or one before it, in order.

    Neighbours that match in ``length`` symbols form chains, a chain for each string that occurs twice or more; its
    least position stays.
    """
    index = build(texts)
    match, to = matching_statistics(index, length)
    linked = np.flatnonzero(match >= length)
    end = np.arange(len(match))
    end[linked] = to[linked]
    while True:
        further = end[end[linked]]
        if (further == end[linked]).all():
            break
        end[linked] = further
    first = np.arange(len(match))
    np.minimum.at(first, end[linked], linked)
    members = np.union1d(linked, end[linked])
    again = members[first[end[members]] < members]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    text = np.searchsorted(begin, again, "right") - 1
    return text, again - begin[text]
