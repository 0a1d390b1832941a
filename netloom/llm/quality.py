"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the vote patterns estimates, without labels, how often each rule is right
about good documents and about bad ones, and how common good documents are; a
document is judged by the posterior probability that it is good, instead of
having to pass all rules. Rules about one kind of junk abstain where they see
none of it, as its absence says little about other junk.

The estimation never sees single documents: votes are first counted by
pattern, of which there are at most 3^rules, whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, scratch, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Function words that prose in the four languages of the corpus is full of.
FUNCTION_WORDS = (
    "the of and to in is that it was for on are as with be this by an have not "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des et un une en du que qui dans pour par sur avec au "
    "el los las y en que del se por con una su para al lo"
).split()
MOST = 0.995
START_ACCURACY, START_GOOD = (0.98, 0.5), 0.85
#: The start values count like so large a share of all documents in each estimate.
PRIOR = 0.02
MARKS = SYMBOLS + "!(){}[]=_~^@\\/+"
#: A word of letters, perhaps with one punctuation mark after it.
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}[\p{L}\p{M}'’-]*[.,;:?!…]?(?![^\x20\x09-\x0D])"
ROUNDS, STILL = 20, 1e-3


def _left_after(text: Column, chars: str) -> Column:
    """Code points of a text without the given characters."""
    return F.length(F.translate(text, chars, ""))


def _repeated_words(w: Column, k: int) -> Column:
    """Words covered by k-word windows found twice or more in the array w."""

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-k).cast("int").alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(k), p - a["last"])).cast("int").alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def places(sorted_: Column) -> Column:
        def twice(x, i):
            return ((i > 0) & (F.get(sorted_, i - 1)["h"] == x["h"])) | F.coalesce(F.get(sorted_, i + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(sorted_, twice), lambda x: x["i"]))

    def of(h: Column) -> Column:
        dup = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i")))), lambda s: covered(places(s)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(dup)

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    return F.when(F.size(w) <= k, F.lit(0)).otherwise(let(hashes, of))


def measures(text: Column) -> Column:
    """A struct of counts over a text; all 0 for null, empty and blank texts."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column, lines: Column) -> Column:
        n = F.size(w)
        bare = _left_after(text, SPACE_CHARS)
        small = F.array(*[F.lit(x) for x in sorted(set(FUNCTION_WORDS))])
        return F.struct(
            n.cast("long").alias("n_words"),
            bare.cast("long").alias("word_chars"),
            (F.length(text) - _left_after(text, SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated_words(w, WINDOW).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.length(text) - _left_after(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
            (F.length(text) - _left_after(text, MARKS)).cast("long").alias("n_marks"),
            F.regexp_count(text, F.lit(PLAIN)).cast("long").alias("n_plain"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;…][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
            F.size(F.array_intersect(w, small)).cast("long").alias("n_kinds"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(F.struct(words(text).alias("w"), lines.alias("l")), lambda s: of(s["w"], s["l"]))


def _vote(bad: Column, good: Column | None = None) -> Column:
    v = F.when(bad, -1)
    return (v if good is None else v.when(good, 1)).otherwise(0).cast("byte")


def rules(m: Column) -> dict[str, Column]:
    """The rules: votes on a struct of measures. Each looks at another side of a text, and abstains in between."""
    n = F.greatest(m["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(m["n_lines"], F.lit(1)).cast("double")
    chars = F.greatest(m["word_chars"], F.lit(1)).cast("double")
    return {
        "too_short": _vote(m["n_words"] < 10),
        "word_length": _vote(~(chars / n).between(2, 14)),
        "symbols": _vote(m["n_symbols"] / n > 0.2),
        "marks": _vote(m["n_marks"] / n > 0.4),
        "capitals": _vote(m["n_upper"] / chars > 0.4),
        "repeated_lines": _vote(m["n_dup_lines"] / lines > 0.3),
        "repeated_words": _vote(m["n_repeat_words"] / n > 0.2),
        "varied_words": _vote(m["n_distinct"] < F.least(n * 0.2, F.lit(40.0))),
        "plain_words": _vote(m["n_plain"] / n < 0.7, m["n_plain"] / n >= 0.9),
        "ended_lines": _vote(m["n_ended"] / lines < 0.2, m["n_ended"] / lines >= 0.6),
        "function_words": _vote((m["n_kinds"] == 0) & (m["n_words"] >= 20), m["n_kinds"] >= 3),
    }


def posterior(votes: dict[str, Column], model: dict) -> Column:
    """The probability that a document with these votes is good; abstentions say nothing."""
    odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for k, v in votes.items():
        good, bad = model["accuracy"][k]
        odds = odds + F.when(v > 0, F.lit(math.log(good / (1 - bad)))).when(v < 0, F.lit(math.log((1 - good) / bad))).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-odds))


def _accuracy(good: float, bad: float) -> tuple[float, float]:
    """Within bounds, and no worse than chance: this fixes which class is the good one."""
    good = min(MOST, max(0.5, good))
    return good, min(MOST, max(1 - good + 0.005, bad))


def fit(voted: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict:
    """Accuracies on good and on bad documents and the share of good ones, by expectation-maximisation over vote patterns.

    One row of sums comes back a round. An empty table leaves the starting
    values, as does a rule that never votes.
    """
    patterns = scratch(voted.groupBy(*names).agg(F.count("*").alias("__nl_n")).coalesce(1), "patterns")
    model = {"good": START_GOOD, "accuracy": dict.fromkeys(names, START_ACCURACY)}
    n, p = F.col("__nl_n"), F.col("__nl_p")
    sides = [(k, v, f"{k}_{'up' if v > 0 else 'down'}") for k in names for v in (1, -1)]
    cast = patterns.agg(F.sum(n).alias("n"), *[F.coalesce(F.sum(F.when(F.col(k) == v, n)), F.lit(0)).alias(c) for k, v, c in sides]).first()
    for _ in range(rounds if cast["n"] else 0):
        weighed = patterns.withColumn("__nl_p", posterior({k: F.col(k) for k in names}, model))
        got = weighed.agg(F.sum(n * p).alias("good"), *[F.coalesce(F.sum(F.when(F.col(k) == v, n * p)), F.lit(0.0)).alias(c) for k, v, c in sides]).first()
        own = PRIOR * cast["n"]

        def share(k: str, good: bool, start: float) -> float:
            up, down = (got[f"{k}_{s}"] if good else cast[f"{k}_{s}"] - got[f"{k}_{s}"] for s in ("up", "down"))  # noqa: B023
            return ((up if good else down) + start * own) / (up + down + own)  # noqa: B023

        fresh = {
            "good": min(MOST, max(0.5, got["good"] / cast["n"])),
            "accuracy": {k: _accuracy(share(k, True, START_ACCURACY[0]), share(k, False, START_ACCURACY[1])) for k in names},
        }
        moved = max(abs(fresh["good"] - model["good"]), *(abs(x - y) for k in names for x, y in zip(fresh["accuracy"][k], model["accuracy"][k], strict=True)))
        model = fresh
        if moved < STILL:
            break
    return model


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, carry: list[str], threshold: float = 0.5) -> DataFrame:
    """docs(text string, ...) -> the carried columns, the base counts, each rule's vote, and the verdict.

    Columns added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than 10 words, or over 20 % in repeated five-word
    windows), one vote per rule (vote_<rule>), quality (the posterior) and kept
    (not base_failed, and quality of at least the threshold).

    Null, empty and blank texts have zero words, fail the base and are not kept;
    very long ones are measured whole. Repeated rows are judged alike. Carried
    columns may have any names except those added here, which are refused. The
    counted table is written once; the texts are read
    once.
    """
    votes = rules(F.col("__nl_m"))
    names = [f"vote_{k}" for k in votes]
    if clash := sorted(set(carry) & {*BASE, "base_failed", *names, "quality", "kept"}):
        raise ValueError(f"columns named like results cannot be carried: {clash}")
    m = docs.select(*[F.col(f"`{c}`") for c in carry], measures(F.col("text")).alias("__nl_m"))
    failed = (F.col("__nl_m.n_words") < 10) | (100 * F.col("__nl_m.n_repeat_words") > 20 * F.col("__nl_m.n_words"))
    voted = scratch(m.select(*carry, *[F.col(f"__nl_m.{c}").alias(c) for c in BASE], failed.alias("base_failed"), *[v.alias(f"vote_{k}") for k, v in votes.items()]), "votes")
    model = fit(voted, names)
    quality = posterior({k: F.col(k) for k in names}, model)
    return voted.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
