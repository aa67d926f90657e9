"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Words are lower-cased runs of letters and digits. Every window of 12 words of a benchmark item is cut
into four groups of three words and hashed under six masks, one for each two groups: two substitutions
anywhere touch two groups at most, and the mask of the two others is unharmed. Items of 5 to 11 words are
one window; from 6 words on, one substitution is allowed, and each half of the item is a mask. Training
texts are hashed at every position where a mask's first three words are such a triple of the benchmark
(elsewhere it cannot match). A hit is verified by comparing all words of both windows: at least 10 of 12,
or 5 of 6, must be equal. Items of fewer than 5 words are too common to look for. A document is
contaminated if a window is verified.

Windows that many items share are one window, so a common phrase does not multiply with the items.

Positions travel without the words of their text; what is compared in the end are the 5 to 12 words of a
window.

Nulls and edges: null and empty texts or items have no window; a null doc_id is one like others; rows that
repeat doc_id and text are one document; an empty benchmark leaves all documents; a text may be of any
length; clean() passes all columns through, leaks() returns its own alone.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbmark.core.tables import BROADCAST_ROWS, fits, small, table

SPAN, LEAST = 12, 5


def masks(n: int) -> list[tuple[int, ...]]:
    """Positions that each mask of a window of n words looks at.

    One word in six may differ: twice as many groups as that, each of three words or more side by side,
    and a mask for every choice of half of them, so that one mask meets none of the words that differ.
    """
    changes = n // 6
    groups = 2 * changes or 1
    cut = [range(n * g // groups, n * (g + 1) // groups) for g in range(groups)]
    return [tuple(i for g in some for i in g) for some in combinations(cut, changes or 1)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hash(n: int, k: int, parts: list[Column]) -> Column:
    return F.xxhash64(F.lit(n), F.lit(k), *parts)


def seeds(items: DataFrame) -> DataFrame:
    """(h, win, item_id): the masked hashes of every distinct window of the benchmark."""
    cut = items.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") >= LEAST)
    long = cut.filter(F.size("ws") >= SPAN).select("item_id", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - SPAN + 1)).alias("i"))
    wins = long.select("item_id", F.slice("ws", F.col("i"), SPAN).alias("win")).unionByName(cut.filter(F.size("ws") < SPAN).select("item_id", F.col("ws").alias("win")))
    wins = wins.groupBy("win").agg(F.min("item_id").alias("item_id"))
    masked = F.array(*(F.when(F.size("win") == n, _hash(n, k, [F.get("win", F.lit(i)) for i in mask])) for n in range(LEAST, SPAN + 1) for k, mask in enumerate(masks(n))))
    return wins.select(F.explode(F.array_compact(masked)).alias("h"), "win", "item_id")


def _met(cut: DataFrame, at: DataFrame, triples: DataFrame, rows: int) -> DataFrame:
    """Positions at which a triple of the benchmark stands, with the words of their texts, when the triples
    are too many to broadcast: narrow rows meet the triples, and only then the words of each text that has any."""
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    hit = at.join(triples, "triple", "left_semi").groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("j").alias("js"))
    hit = table(hit, "met")
    once = cut.join(small(hit.drop("js"), rows), same, "left_semi").dropDuplicates(["doc_id", "th"])
    return once.join(hit, same).select("doc_id", "th", "ws", F.explode("js").alias("j"))


def leaks(docs: DataFrame, items: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, th, item_id, n_windows, n_words): the contaminated documents.

    item_id is the least item met, n_windows counts the positions of verified windows, n_words the words
    they cover. th is the hash of the text. ``rows`` is how many rows of the benchmark's hashes are broadcast.
    """
    found = table(seeds(items), "seeds")
    lengths = sorted({SPAN, *(r[0] for r in found.select(F.size("win")).distinct().collect())})
    looks = [(n, k, mask) for n in lengths for k, mask in enumerate(masks(n))]
    word = lambda array, i: F.get(array, F.greatest(i, F.lit(-1)) if isinstance(i, Column) else F.lit(i))
    triple = lambda array, i: F.xxhash64(*(word(array, i + d) for d in range(3)))
    first = F.array(*(F.when(F.size("win") == n, triple("win", i)) for n, i in sorted({(n, mask[0]) for n, _, mask in looks})))
    triples = found.select(F.explode(F.array_compact(first)).alias("triple")).distinct()
    # words stay in generated code: no lambda, and no copy of the word array with every position
    cut = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("ws"))
    at = cut.select("doc_id", "th", "ws", F.explode_outer(F.when(F.size("ws") >= lengths[0], F.sequence(F.lit(0), F.size("ws") - 3))).alias("j")).filter("j is not null")
    at = at.select("doc_id", "th", "ws", "j", triple("ws", F.col("j")).alias("triple"))
    near = at.join(F.broadcast(triples), "triple", "left_semi") if fits(triples, rows) else _met(cut, at.drop("ws"), triples, rows)
    tries = F.array(*(F.struct((F.col("j") - mask[0]).alias("at"), F.lit(n).alias("n"), _hash(n, k, [word("ws", F.col("j") + (i - mask[0])) for i in mask]).alias("h")) for n, k, mask in looks))
    hashed = near.select("doc_id", "th", "ws", F.explode(tries).alias("t")).filter((F.col("t.at") >= 0) & (F.col("t.at") + F.col("t.n") <= F.size("ws")))
    hashed = hashed.select("doc_id", "th", "t.at", "t.n", "t.h", F.slice("ws", F.col("t.at") + 1, F.col("t.n")).alias("got"))
    # verified before they are gathered, so that a common half of an item costs no memory
    equal = F.size(F.filter(F.zip_with("win", "got", lambda a, b: a.eqNullSafe(b)), lambda e: e))
    sure = hashed.join(small(found, rows), "h").filter((F.size("win") == F.col("n")) & (equal * 6 >= F.col("n") * 5))
    hits = sure.groupBy("doc_id", "th").agg(F.min("item_id").alias("item_id"), F.collect_set(F.struct("at", "n")).alias("hits"))
    covered = F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))
    count = lambda c: F.size(F.array_distinct(c)).cast("long")
    return hits.select("doc_id", "th", "item_id", count(F.col("hits.at")).alias("n_windows"), count(covered).alias("n_words"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, columns unchanged."""
    bad = table(leaks(docs, items).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")), "leaks")
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    return keyed.join(small(bad), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left_anti").select(*docs.columns)


#: Windows meet by three plain words of a third or a half of an item, which the allowed changes leave whole.
SQL = r"""
with dw as materialized (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents where text is not null),
iw as materialized (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from benchmark where text is not null),
allw as (
  select item_id, ws[i:i + 11] as win from (select item_id, ws, unnest(range(1, len(ws) - 10)) as i from iw where len(ws) >= 12)
  union all select item_id, ws from iw where len(ws) between 5 and 11),
win as materialized (select row_number() over () as w, min(item_id) as item_id, win, len(win) as n from allw group by win),
off as (select w, n, unnest(case when n = 12 then [0, 4, 8] when n > 5 then [0, n // 2] else [0] end) as o from win),
part as materialized (select off.w, off.n, o, win[o + 1:o + 3] as g from off join win using (w)),
gram as materialized (select doc_id, j, ws[j + 1:j + 3] as g, len(ws) as size from (select doc_id, ws, unnest(range(0, len(ws) - 2)) as j from dw)),
cand as materialized (select distinct doc_id, j - o as place, w from gram join part using (g) where j >= o and j - o + n <= size),
hit as materialized (
  select doc_id, place, n, item_id from cand join win using (w) join dw using (doc_id)
  where 6 * len(list_filter(range(1, n + 1), lambda i: ws[place + i] = win[i])) >= 5 * n),
cover as (select doc_id, count(distinct p)::bigint as n_words from (select doc_id, unnest(range(place, place + n)) as p from hit) group by doc_id)
select doc_id, min(item_id) as item_id, count(distinct place)::bigint as n_windows, any_value(n_words) as n_words
from hit join cover using (doc_id) group by doc_id
"""
