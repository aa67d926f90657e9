"""Quality rules with risk-controlled thresholds.

Base rules fail a text with fewer than 10 words, or with more than a fifth of its words in five-word
windows that it repeats. The method adds one rule per stratum, "any signal above its cutoff", with cutoffs
learned from labelled documents. STEPS are fixed beforehand: step k gives every signal its k-th cutoff, so
each step rejects all that the one before rejects. In each stratum they are tried from the mildest on, and
one is certified while the exact binomial upper bound of the share of good documents that it rejects stays
within ``risk``. Trying in a fixed order and stopping at the first failure needs no further correction; over
strata the error level ``delta`` is divided by their number (Bonferroni), so with probability 1 - delta no
stratum loses more than ``risk`` of its good documents to these rules. Of the certified steps the one that
rejects most labelled bad documents is used, a good one counting ten times. A stratum whose good labels are
too few to certify even a step without any false rejection gets no rule; such strata are known by their
number of good labels alone, so they do not count in the division.

All labelled rows are used, and only texts of labelled documents are scored for the cutoffs. What reaches
the driver is a histogram over the steps for each stratum that has enough good labels.

Nulls and edges: a null text has no words and fails the base rule; a null stratum is one of its own;
repeated label rows of a document count once, as bad if they disagree; rows that repeat a doc_id are scored
and judged each; with no labels only the base rules act; an empty table gives no rows; texts may be of any
length, a batch holds a few megabytes; docs keep their columns, those named __q, __failed, __stratum,
__step and __kept are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbmark.core.tables import small, table
from ebbmark.llm.batches import bounded, held
from ebbmark.llm.words import WordHashes, windows

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Fixed cutoffs of each signal, one for every step, mildest first.
CUTOFFS = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.03],
    "capital_share": [0.9, 0.8, 0.7, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "bang_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1],
    "dup_line_share": [0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35],
    "repeat_share": [0.2, 0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.13, 0.12, 0.11, 0.1, 0.08],
}
STEPS = 12
SIGNALS = tuple(CUTOFFS)
#: 1 for capitals and 2 for small letters of the Latin, Greek and Cyrillic blocks.
_CASE = np.array([chr(c).isupper() + 2 * chr(c).islower() for c in range(0x530)] + [0], np.int8)
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_letters long, n_bangs long"


def _counter():
    def count(text: str | None, cache: WordHashes) -> tuple:
        text = text or ""
        raw = text.encode()
        words = raw.split()
        found = windows(cache.of(words), 5)
        inside = 0
        if len(found):
            _, back, times = np.unique(found, return_inverse=True, return_counts=True)
            starts = np.flatnonzero(times[back] > 1)
            # word i lies in a repeated window if one starts at i-4..i
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + 5, -1)
            inside = int((np.cumsum(edge) > 0).sum())
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        _, upper, lower = np.bincount(_CASE[np.minimum(points, len(_CASE) - 1)], minlength=3)
        return (
            len(words),
            len(text) - sum(text.count(c) for c in BLANKS),
            sum(text.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)),
            inside,
            len(lines),
            upper,
            upper + lower,
            text.count("!"),
        )

    names = [x.split()[0] for x in COUNTS.split(", ")]

    @F.pandas_udf(COUNTS)
    def counts(texts: pd.Series) -> pd.DataFrame:
        cache = held(WordHashes)
        return pd.DataFrame([count(t, cache) for t in texts], columns=names).astype("int64")

    return counts.asNondeterministic()


def scored(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """docs with a struct ``__q`` of counts, ``__failed`` (base), ``__stratum`` and ``__step``: the first
    step that rejects the row, or null."""
    bounded(docs.sparkSession)
    q = lambda c: F.col(f"__q.{c}")
    per = lambda a, b: q(a) / F.greatest(q(b), F.lit(1))
    shares = {
        "symbol_share": per("n_symbols", "word_chars"),
        "capital_share": per("n_capitals", "n_letters"),
        "bang_share": per("n_bangs", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
    }
    step = F.lit(None).cast("int")
    for k in reversed(range(STEPS)):
        over = [shares[s] > CUTOFFS[s][k] for s in SIGNALS]
        step = F.when(over[0] | over[1] | over[2] | over[3] | over[4], k + 1).otherwise(step)
    out = docs.withColumn("__q", _counter()("text"))
    failed = (q("n_words") < 10) | (100 * q("n_repeat_words") > 20 * q("n_words"))
    return out.withColumns({"__failed": failed, "__stratum": F.col(stratum).cast("string"), "__step": step})


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= x); at most delta means that p is above the exact upper bound at 1 - delta."""
    if x >= n:
        return 1.0
    at = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(at(k)) for k in range(x + 1)))


def choose(good: list[int], bad: list[int], n_good: int, risk: float, delta: float) -> int | None:
    """The certified step of best use; good and bad count the labelled rows that each step rejects."""
    best, use = None, 0
    for k, (g, b) in enumerate(zip(good, bad), 1):
        if binomial_tail(g, n_good, risk) > delta:
            break
        if b - 10 * g > use:
            best, use = k, b - 10 * g
    return best


def thresholds(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> dict[str | None, int]:
    """stratum -> certified step, from all rows of labels(doc_id, quality)."""
    truth = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    known = docs.select("doc_id", "text", F.col(stratum).alias("__name")).join(small(table(truth, "truth")), "doc_id")
    rows = scored(known, "__name").filter("not __failed").select("__stratum", "__quality", F.coalesce("__step", F.lit(STEPS + 1)).alias("step"))
    each = rows.groupBy("__stratum", "step").agg(F.count_if(F.col("__quality") == 1).alias("good"), F.count_if(F.col("__quality") != 1).alias("bad"))
    least = math.log(delta) / math.log1p(-risk)  # with fewer good labels, none rejected certifies nothing
    found = each.groupBy("__stratum").agg(F.sum("good").alias("n"), F.collect_list(F.struct("step", "good", "bad")).alias("steps")).filter(F.col("n") >= least).collect()
    out = {}
    for r in found:
        good, bad = ([sum(x[side] for x in r["steps"] if x["step"] <= k) for k in range(1, STEPS + 1)] for side in ("good", "bad"))
        step = choose(good, bad, r["n"], risk, delta / len(found))
        if step is not None:
            out[r["__stratum"]] = step
    return out


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """scored() docs with the boolean ``__kept``: false if a base rule or a certified step rejects."""
    verdict = F.lit(False)
    for name, step in thresholds(docs, labels, stratum, risk, delta).items():
        verdict = verdict | (F.col("__stratum").eqNullSafe(F.lit(name)) & (F.coalesce("__step", F.lit(STEPS + 1)) <= step))
    return scored(docs, stratum).withColumn("__kept", ~F.col("__failed") & ~verdict)


def filtered(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are kept, columns unchanged."""
    return judged(docs, labels, **how).filter("__kept").select(*docs.columns)
