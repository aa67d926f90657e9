"""Phrases whose words keep company, by suffix subtrees of vertical partitions.

Words are hashed to 64 bits. A first pass over the texts counts, by buckets of hashes, how many suffixes begin
with the words (and the word pairs) of a bucket. These prefixes are packed into groups of at most BUDGET
suffixes, so that a group's subtree fits into memory; the prefixes of a bucket over the budget are made longer
by a word, and those of a pair bucket over the budget by another one, which spreads them. A second pass sends
every suffix, cut after three words, to the group of its prefix; equal ones of a chunk travel as one with a count.
Each group sorts its suffixes, which is its subtree in depth-first order: leaves are the distinct suffixes, and
the count of every node is the total of the leaves below it. Nodes of lengthened prefixes are in several groups
and added up. Only what can matter (counts of ``least`` or more) leaves the groups.

Scores, the cut of each phrase, and which phrases lie inside longer ones are joins and group-bys of node hashes.
The words themselves are read in a third pass, for the best phrases alone; two words of one hash among them are
found there and the job is run again with other hashes.

Nulls and edges: a null or blank text has no words; a null lang is ``und``; rows that repeat a document count
again; equal scores and counts rank by phrase; an empty table gives no rows; texts and words may be of any
length; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbmark.core.tables import fits, table
from ebbmark.llm import textbytes as tb
from ebbmark.llm.batches import bounded

#: Suffixes of a group, buckets of prefixes, bytes of text taken at once, and words of which suffixes are sorted at once.
BUDGET, BUCKETS, CHUNK_BYTES, STEP = 1 << 20, 1 << 14, 8 << 20, 1 << 20
NONE = np.uint64(0)
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple]:
    """(lang, body, starts, ends, hashes, next_is_near) of the words of each chunk and lang."""
    for part in tb.gathered(batches, CHUNK_BYTES):
        langs, column = np.unique(part["lang"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        for i, lang in enumerate(langs):
            body, _ = tb.joined(part["text"].take(pa.array(np.flatnonzero(column == i))))
            body = _LOWER[body]
            starts, ends = tb.runs(_WORD[body])
            if len(starts):
                h = np.maximum(tb.hashed(body, starts, ends, seed), np.uint64(1))
                piece = np.cumsum(_BREAK[body], dtype=np.int32)[starts]
                yield str(lang), body, starts, ends, h, piece


def _suffixes(h: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next and the next but one word of every word, NONE beyond its piece."""
    second, third = np.zeros_like(h), np.zeros_like(h)
    second[:-1] = np.where(piece[1:] == piece[:-1], h[1:], NONE)
    third[:-2] = np.where(piece[2:] == piece[:-2], h[2:], NONE)
    return second, third


def _bucket(h1: np.ndarray, h2: np.ndarray | None, lang: str) -> np.ndarray:
    x = tb.mix(h1 + np.uint64(zlib.crc32(lang.encode())))
    return ((x if h2 is None else tb.mix(x + h2)) >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _census(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, depth, bucket, n): suffixes by bucket of their first word (depth 1) and pair (2); depth 0 has all words of a lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for lang, _, _, _, h, piece in _words(batches, seed):
            both = seen.setdefault(lang, np.zeros((2, BUCKETS), np.int64))
            both[0] += np.bincount(_bucket(h, None, lang), minlength=BUCKETS)
            both[1] += np.bincount(_bucket(h, _suffixes(h, piece)[0], lang), minlength=BUCKETS)
        for lang, both in seen.items():
            for depth, at, n in ((0, np.zeros(1, np.int64), both[0].sum(keepdims=True)), *((d + 1, f := np.flatnonzero(both[d]), both[d][f]) for d in (0, 1))):
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "depth": pa.array([depth] * len(at), pa.int32()), "bucket": pa.array(at, pa.int32()), "n": n})

    return docs.mapInArrow(run, "lang string, depth int, bucket int, n long").groupBy("lang", "depth", "bucket").agg(F.sum("n").alias("n"))


def _packed(counts: np.ndarray, budget: int, first: int) -> tuple[np.ndarray, int]:
    """Group of each bucket, from ``first`` on, by filling groups in order up to the budget; -1 for buckets over it."""
    light = counts <= budget
    group = np.full(len(counts), -1)
    group[light] = first + np.cumsum(np.where(light, counts, 0))[light] // budget
    return group, int(group.max(initial=first - 1)) + 1


def _routed(docs: DataFrame, seed: int, one: np.ndarray, two: np.ndarray, first: int, spread: int) -> DataFrame:
    """Runs of suffixes by group and lang: distinct words, and codes into them (0: none) with counts.

    one, two: groups of buckets of words and pairs; suffixes of pair buckets without a group are dealt whole over
    ``spread`` groups from ``first`` on."""

    def cut(lang: str, h: np.ndarray, piece: np.ndarray, a: int) -> Iterator[dict]:
        part = slice(a, a + STEP + 2)
        own, code = np.unique(h[part], return_inverse=True)
        code = code.astype(np.uint64) + np.uint64(1)
        c2, c3 = _suffixes(code, piece[part])
        n = min(STEP, len(h) - a)
        key = code[:n] << np.uint64(42) | c2[:n] << np.uint64(21) | c3[:n]
        key, count = np.unique(key, return_counts=True)
        codes = np.stack([key >> np.uint64(42), key >> np.uint64(21) & np.uint64((1 << 21) - 1), key & np.uint64((1 << 21) - 1)]).astype(np.int64)
        words = np.concatenate([[NONE], own])
        h1, h2, h3 = words[codes]
        group = one[_bucket(h1, None, lang)]
        longer = np.flatnonzero(group < 0)
        group[longer] = two[_bucket(h1[longer], h2[longer], lang)]
        whole = longer[group[longer] < 0]
        group[whole] = first + (tb.mix(tb.mix(h1[whole] + h2[whole] * np.uint64(3)) + h3[whole]) % np.uint64(spread)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group, codes, count = group[order], codes[:, order], count[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
        for x, y in zip(cuts, cuts[1:]):
            used, local = np.unique(codes[:, x:y], return_inverse=True)
            small = np.uint16 if len(used) < 1 << 16 else np.uint32
            yield {"grp": int(group[x]), "lang": lang, "words": words[used].tobytes(), "codes": local.reshape(3, -1).astype(small).tobytes(), "counts": count[x:y].astype(np.uint32).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, _, _, h, piece in _words(batches, seed):
            for a in range(0, len(h), STEP):
                yield pa.RecordBatch.from_pylist(list(cut(lang, h, piece, a)), pa.schema([("grp", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary())]))

    return docs.mapInArrow(run, "grp int, lang string, words binary, codes binary, counts binary")


def subtree(h: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, totals) at depths 1 to 3 of the suffixes h (3, n): nodes are columns, totals those of their leaves."""
    order = np.lexsort(h[::-1])
    h, counts = h[:, order], counts[order]
    out, fresh = [], np.zeros(h.shape[1], bool)
    fresh[:1] = True
    for depth in range(3):
        fresh[1:] |= h[depth, 1:] != h[depth, :-1]
        at = np.flatnonzero(fresh)
        total = np.add.reduceat(counts, at) if len(at) else counts
        real = h[depth, at] != NONE
        out.append((np.where(np.arange(3)[:, None] <= depth, h[:, at], NONE)[:, real], total[real]))
    return out


def _grown(runs: DataFrame, least: int, one: np.ndarray, two: np.ndarray) -> DataFrame:
    """(lang, h1, h2, h3, f): nodes of all subtrees with ``least`` suffixes or more; 0 for no word."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, parts = pdf["lang"].iloc[0], []
        for words, codes, counts in zip(pdf["words"], pdf["codes"], pdf["counts"]):
            n = len(counts) // 4
            parts.append((np.frombuffer(words, np.uint64)[np.frombuffer(codes, np.uint16 if len(codes) == 6 * n else np.uint32).reshape(3, n)], np.frombuffer(counts, np.uint32)))
        rows = []
        for depth, (h, total) in enumerate(subtree(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]).astype(np.int64))):
            keep = total >= least
            if depth < 2:  # nodes above a lengthened prefix are in several groups
                keep |= one[_bucket(h[0], None, lang)] < 0
            if depth == 1:
                keep &= (total >= least) | (two[_bucket(h[0], h[1], lang)] < 0)
            rows.append(np.concatenate([h[:, keep], total[None, keep].astype(np.uint64)]))
        h1, h2, h3, f = np.concatenate(rows, axis=1).view(np.int64)
        return pd.DataFrame({"lang": lang, "h1": h1, "h2": h2, "h3": h3, "f": f})

    nodes = runs.groupBy("grp", "lang").applyInPandas(run, "lang string, h1 long, h2 long, h3 long, f long")
    return nodes.groupBy("lang", "h1", "h2", "h3").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _named(docs: DataFrame, seed: int, wanted: DataFrame) -> DataFrame:
    """(lang, h, word) of wanted(lang, h)."""
    few = np.unique(np.array([r[0] for r in wanted.select("h").distinct().collect()], np.int64).view(np.uint64)) if fits(wanted) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, body, starts, ends, h, _ in _words(batches, seed):
            if few is not None:
                at = np.flatnonzero(np.isin(h, few))
                starts, ends, h = starts[at], ends[at], h[at]
            h2 = tb.hashed(body, starts, ends, seed + 1)  # two words of one hash both come through
            _, first = np.unique(np.stack([h, h2]), axis=1, return_index=True)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(first), "h": h[first].view(np.int64), "word": [body[starts[i] : ends[i]].tobytes().decode() for i in first]})

    found = docs.mapInArrow(run, "lang string, h long, word string").distinct()
    return found.join(wanted, ["lang", "h"], "left_semi")


def _scores(nodes: DataFrame, inside: int) -> DataFrame:
    """(lang, h1, h2, h3, a, l, r, score) of candidates that are not mostly part of a longer one."""
    one = nodes.filter("h2 = 0").select("lang", F.col("h1").alias("w"), F.col("f").alias("f1"))
    two = nodes.filter("h2 <> 0 and h3 = 0").select("lang", "h1", "h2", "f")
    three = nodes.filter("h3 <> 0")
    at = lambda c, name: one.select("lang", F.col("w").alias(c), F.col("f1").alias(name))
    score = lambda lf, rt: F.expr(f"cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast({lf} as decimal(19,0)) * cast({rt} as decimal(19,0)))")
    over = three.select("lang", F.explode(F.array(F.struct("h1", "h2", "f"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "f"))).alias("x")).groupBy("lang", "x.h1", "x.h2").agg(F.max("x.f").alias("longer"))
    pairs = two.join(over, ["lang", "h1", "h2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("f")))
    pairs = pairs.join(at("h1", "l"), ["lang", "h1"]).join(at("h2", "r"), ["lang", "h2"]).withColumn("a", F.col("f"))
    pairs = pairs.select("lang", "h1", "h2", F.lit(0).cast("long").alias("h3"), "a", "l", "r", score("l", "r").alias("score"))
    head = two.select("lang", "h1", "h2", F.col("f").alias("l2"))
    tail = two.select("lang", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("f").alias("r1"))
    tri = three.withColumnRenamed("f", "a").join(head, ["lang", "h1", "h2"]).join(tail, ["lang", "h2", "h3"]).join(at("h1", "l1"), ["lang", "h1"]).join(at("h3", "r2"), ["lang", "h3"])
    tri = tri.withColumns({"s1": score("l1", "r1"), "s2": score("l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    tri = tri.select("lang", "h1", "h2", "h3", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    return pairs.unionByName(tri)


def phrases(docs: DataFrame, least: int = 10, inside: int = 50, top: int = 2000, budget: int = BUDGET, seed: int = 1) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's ``top`` phrases of two or three words of docs(lang, text).

    A phrase found a times, cut where the score 1000000 a a / (l r) is the least, l and r being the counts of its
    parts; phrases inside a longer one found ``inside`` per cent of a or more are left out.
    """
    bounded(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    census = table(_census(texts, seed), "census")
    counts = np.zeros((2, BUCKETS), np.int64)
    for r in census.filter("depth > 0").groupBy("depth", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["depth"] - 1, r["bucket"]] = r["n"]
    one, groups = _packed(counts[0], budget, 0)
    two, groups = _packed(counts[1], budget, groups)
    spread = max(1, int(-(-counts[1][two < 0] // budget).sum()))
    runs = _routed(texts, seed, one, two, groups, spread)
    nodes = table(_grown(runs, least, one, two), "nodes")
    scored = table(_scores(nodes, inside), "scored")
    near = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    best = table(scored.withColumn("near", near).filter(F.col("near") <= top).drop("near"), "best")
    wanted = table(best.select("lang", F.explode(F.array("h1", "h2", "h3")).alias("h")).filter("h <> 0").distinct(), "wanted")
    names = table(_named(texts, seed, wanted), "names")
    if names.groupBy("lang", "h").count().filter("count > 1").limit(1).count():
        return phrases(docs, least, inside, top, budget, seed + 2)
    word = lambda i: names.select("lang", F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"))
    said = reduce(lambda df, i: df.join(word(i), ["lang", f"h{i}"], "left"), (1, 2, 3), best).withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    sizes = census.filter("depth = 0").select("lang", "n")
    ranked = said.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).join(sizes, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with p as materialized (
  select lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda w: w <> '') as ws
  from (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
e as materialized (select lang, k, ws[i:i + k - 1] as g from (select lang, ws, unnest(range(1, len(ws) + 1)) as i from p) cross join (values (1), (2), (3)) t(k) where i + k - 1 <= len(ws)),
f as materialized (select lang, k, array_to_string(g, ' ') as s, any_value(g) as g, count(*)::bigint as a from e group by lang, k, array_to_string(g, ' ')),
n as (select lang, count(*)::bigint as n from e where k = 1 group by lang),
parts as materialized (
  select lang, k, s, a, j, lang || chr(1) || array_to_string(g[1:j], ' ') as ls, lang || chr(1) || array_to_string(g[j + 1:], ' ') as rs
  from f cross join (values (1), (2)) t(j) where k >= 2 and a >= 10 and j < k),
known as materialized (select lang || chr(1) || s as key, a from f where a >= 10),
cuts as materialized (
  select c.lang, c.s, c.k, c.a, c.j, x.a as l, y.a as r, (1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a) as score from parts c join known x on x.key = c.ls join known y on y.key = c.rs),
one as (select * from cuts qualify row_number() over (partition by lang, s order by score, j) = 1),
over as (select lang, array_to_string(g[j:j + 1], ' ') as s, max(a) as m from f cross join (values (1), (2)) t(j) where k = 3 and a >= 10 group by 1, 2)
select one.lang, row_number() over (partition by one.lang order by score desc, one.a desc, one.s)::bigint as rank, one.s as phrase, one.a, l, r, n, score::bigint as score
from one join n using (lang) left join over on over.lang = one.lang and over.s = one.s and one.k = 2 where m is null or 100 * m < 50 * one.a
qualify rank <= 2000
"""
