"""Ranked lexical search over bit-sliced Bloom signatures, exact.

Every document has a Bloom signature of its terms: bits for (term, level) for each level 1, 2, 4, ... up to the
term's occurrences, so that levels bound the occurrences from above within a factor of two. Documents of one
class (16 to 32 bits for each of their terms and levels) stand in blocks that are stored by bit: a row of a block is one
bit position's bitmap over its documents. The AND of a term's rows overestimates where it occurs; the sum of the
items' weights over these bitmaps, level by level, times what an occurrence can add in a document of that
length, is an upper bound of the score.

The documents with the best bounds of each item are scored exactly first; their tenth best score is a floor.
Every document whose bound is not under the floor (at equal scores the smaller doc_id wins) is then scored
exactly on its whole text: what is left out provably cannot be among the ten.

Items are taken in blocks of some ITEMS, each block's terms go to all tasks; the signatures are built once.
Nothing is collected but an item block, the occurrences of its terms and its floors.

Nulls and edges: a null or termless text is no document; an item without terms or without a document of score
above 0 gives no rows; a null doc_id ranks after others of equal score; rows that repeat a doc_id are documents
of their own and may each have a rank; null item_ids are kept; equal items each get their rows; an empty table
gives no rows; texts may be of any length; other columns of docs and items are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbmark.core.tables import small, table
from ebbmark.llm import textbytes as tb
from ebbmark.llm.batches import bounded

#: Items of a block, hash functions of a signature, and bytes of text that share blocks.
ITEMS, HASHES, BLOCK_BYTES = 256, 6, 6 << 20
#: Bytes that part terms: 0x00-0x2F, 0x3A-0x40, 0x5B-0x60 and 0x7B-0x7F.
_PARTS = np.zeros(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _PARTS[_a : _b + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACED = bytes(32 if _PARTS[i] else _LOWER[i] for i in range(256))
_INDEX = "cls int, levels int, ids array<long>, keys array<long>, n array<long>, bits binary, docs long, words long, terms array<int>, df array<long>"


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_SPACED).split() if text else []


def _places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """(HASHES, len(h)): bit positions of a term at a level in a signature of ``size`` bits, a power of two."""
    return np.stack([(tb.mix(h + np.uint64(8191 * level + j)) >> np.uint64(20)).astype(np.int64) & (size - 1) for j in range(HASHES)])


def _hash_terms(words: list[bytes], seed: int) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    body = np.frombuffer(b"".join(words) + bytes(tb.PAD), np.uint8)
    return tb.hashed(body, ends - [len(w) for w in words], ends, seed) if words else np.empty(0, np.uint64)


def _scan(docs: DataFrame, words: list[bytes], index: bool) -> DataFrame:
    """Blocks of signatures (unless not ``index``) with each chunk's documents, terms and counts of ``words``."""
    sought, other = _hash_terms(words, 1), _hash_terms(words, 2)
    order = np.argsort(sought)
    sought, other = sought[order], other[order]

    def chunk(part: pa.Table) -> list[dict]:
        body, at = tb.joined(part["text"])
        body = _LOWER[body]
        starts, ends = tb.runs(~_PARTS[body])
        doc = np.searchsorted(at, starts, "right") - 1
        h = tb.hashed(body, starts, ends, 1)
        n = np.bincount(doc, minlength=part.num_rows)
        by = np.lexsort((h, doc))
        hs, ds = h[by], doc[by]
        first = np.flatnonzero(np.concatenate([[True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])])) if len(hs) else np.empty(0, np.int64)
        tf = np.diff(np.append(first, len(hs)))
        hs, ds, one = hs[first], ds[first], by[first]
        spot = np.minimum(np.searchsorted(sought, hs), max(len(sought) - 1, 0))
        hit = np.flatnonzero(sought[spot] == hs) if len(sought) else np.empty(0, np.int64)
        hit = hit[tb.hashed(body, starts[one[hit]], ends[one[hit]], 2) == other[spot[hit]]]
        count = np.bincount(order[spot[hit]], minlength=len(words))
        found = np.flatnonzero(count)
        empty = {"cls": -1, "levels": 0, "ids": [], "keys": [], "n": [], "bits": b""}
        rows = [empty | {"docs": int((n > 0).sum()), "words": int(n.sum()), "terms": found, "df": count[found]}]
        if not index:
            return rows
        level = np.frexp(tf.astype(float))[1] - 1
        own = np.bincount(ds, level + 1, minlength=part.num_rows)
        size = 1 << np.frexp(np.maximum(16 * own, 16) - 0.5)[1]
        ids, keys = part["doc_id"].combine_chunks(), part["th"].combine_chunks()
        for f in np.unique(size[n > 0]):
            mine = np.flatnonzero((size == f) & (n > 0))
            column = np.zeros(part.num_rows, np.int64)
            column[mine] = np.arange(len(mine))
            here = (size == f)[ds]
            x, col, lev = hs[here], column[ds[here]], level[here]
            bits = np.zeros((f, len(mine)), bool)
            for lv in range(int(lev.max()) + 1):
                up = lev >= lv
                for p in _places(x[up], lv, int(f)):
                    bits[p, col[up]] = True
            take = pa.array(mine)
            rows.append({"cls": int(f).bit_length() - 1, "levels": int(lev.max()) + 1, "ids": ids.take(take).to_pylist(), "keys": keys.take(take).to_pylist(), "n": n[mine], "bits": np.packbits(bits, axis=1).tobytes(), "docs": 0, "words": 0, "terms": [], "df": []})
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"cls": pa.int32(), "levels": pa.int32(), "ids": pa.list_(pa.int64()), "keys": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "bits": pa.binary(), "docs": pa.int64(), "words": pa.int64(), "terms": pa.list_(pa.int32()), "df": pa.list_(pa.int64())}
        for part in tb.gathered(batches, BLOCK_BYTES):
            for row in chunk(part):
                yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], names=list(kinds))

    return docs.mapInArrow(run, _INDEX)


def _length(n, total: int, docs: int):
    """m of a document of n terms."""
    return 10 + (90 * n * docs) // total


class _Bounds:
    """Upper bounds of every item's score in a block of signatures."""

    def __init__(self, words: list[bytes], weights: np.ndarray, docs: int, total: int):
        self.h, self.weights, self.docs, self.total = _hash_terms(words, 1), weights.astype(np.float32), docs, total

    def of(self, cls: int, levels: int, n: np.ndarray, bits: bytes) -> np.ndarray:
        """(items, documents); whole numbers, exact in doubles."""
        rows = np.frombuffer(bits, np.uint8).reshape(1 << cls, -1)
        m, before, out = _length(n, self.total, self.docs), 0, np.zeros((len(self.weights), len(n)))
        some = np.arange(len(self.h))
        for lv in range(levels):
            p = _places(self.h[some], lv, 1 << cls)
            both = rows[p[0]]
            for q in p[1:]:
                both &= rows[q]
            any_ = both.any(axis=1)
            some, both = some[any_], both[any_]
            if not len(some):
                break
            most = 2 * (1 << lv) - 1
            adds = (1_000_000_000 * most) // (1000 * most + 8 * m)
            # whole numbers under 2**24 are exact in single precision
            part = np.unpackbits(both, axis=1, count=len(n)).astype(np.float32)
            wide = self.weights[:, some] if self.weights.sum(axis=1).max() < 1 << 24 else self.weights[:, some].astype(float)
            out += (wide @ part) * (adds - before)
            before = adds
        return out


def _order(ids: np.ndarray) -> np.ndarray:
    """doc_ids as doubles of one order, null last."""
    return np.array([math.inf if i is None or i != i else float(i) for i in ids])


def _best(index: DataFrame, bounds: _Bounds, top: int) -> DataFrame:
    """(item, id, key, bound): of every task, each item's documents with the highest bounds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple]] = [[] for _ in bounds.weights]
        for pdf in frames:
            for r in pdf.itertuples():
                ub = bounds.of(r.cls, r.levels, np.asarray(r.n), r.bits)
                ids, keys = np.asarray(r.ids, object), np.asarray(r.keys)
                for q, row in enumerate(ub):
                    least = np.partition(row, len(row) - top)[len(row) - top] if len(row) > top else 0
                    over = np.flatnonzero((row >= least) & (row > 0))
                    over = over[np.lexsort((_order(ids[over]), -row[over]))[:top]]
                    best[q] = sorted([*best[q], *zip(row[over], _order(ids[over]), ids[over], keys[over])], key=lambda x: (-x[0], x[1]))[:top]
        rows = [(q, *x) for q, found in enumerate(best) for x in found]
        item, bound, _, ids, keys = zip(*rows) if rows else [()] * 5
        yield pd.DataFrame({"item": np.array(item, np.int32), "id": pd.array(ids, "Int64"), "key": np.array(keys, np.int64), "bound": bound})

    return index.mapInPandas(run, "item int, id long, key long, bound double")


def _open(index: DataFrame, bounds: _Bounds, floors: dict[int, tuple[int, float]]) -> DataFrame:
    """(item, id, key): every document whose bound does not exclude it; floors: score and doc_id of the last place."""
    floor = np.array([floors.get(q, (0, -math.inf))[0] for q in range(len(bounds.weights))], float)
    last = [floors.get(q, (0, -math.inf))[1] for q in range(len(bounds.weights))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                ub = bounds.of(r.cls, r.levels, np.asarray(r.n), r.bits)
                q, d = np.nonzero((ub >= np.maximum(floor, 1)[:, None]))
                ids, keys = np.asarray(r.ids, object)[d], np.asarray(r.keys)[d]
                stay = (ub[q, d] > floor[q]) | (_order(ids) <= np.array(last, float)[q])
                yield pd.DataFrame({"item": q[stay], "id": pd.array(ids[stay], "Int64"), "key": keys[stay]})

    return index.mapInPandas(run, "item int, id long, key long")


def _scored(docs: DataFrame, pairs: DataFrame, items: list[list[bytes]], weights: list[dict[bytes, int]], count: int, total: int) -> DataFrame:
    """(item, doc_id, score): exact scores of pairs(item, id, key) on the whole texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for doc_id, text, wanted in zip(pdf["doc_id"], pdf["text"], pdf["items"]):
                words = terms(text)
                tf, m = Counter(words), _length(len(words), total, count)
                for q in wanted:
                    score = sum(w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, w in weights[q].items() if t in tf)
                    if score > 0:
                        out.append((q, doc_id, score))
            found = pd.DataFrame(out, columns=["item", "doc_id", "score"])
            yield found.assign(doc_id=found["doc_id"].astype("Int64"))

    wanted = table(pairs.groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("items")), "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("key"))
    return docs.join(small(wanted), same).select("doc_id", "text", "items").mapInPandas(run, "item int, doc_id long, score long")


def _placed(scores: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return scores.withColumn("rank", place).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of docs(doc_id, text) for each of items(item_id, text)."""
    spark = bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    asked = table(items.select("item_id", "text"), "items")
    blocks = max(1, math.ceil(asked.count() / ITEMS))
    index, out = None, []
    for block in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        own = [list(dict.fromkeys(terms(r["text"]))) for r in got]
        words = list(dict.fromkeys(w for ws in own for w in ws))
        at = {w: i for i, w in enumerate(words)}
        seen = table(_scan(docs, words, index is None), "signatures")
        index = seen.filter("cls >= 0") if index is None else index
        count, total = (x or 0 for x in seen.agg(F.sum("docs"), F.sum("words")).first())
        if not words or not total:
            continue
        df = dict(seen.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df")).collect())
        weight = [math.floor(1000 * math.log((2 * count + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))]
        matrix = np.zeros((len(own), len(words)))
        for q, ws in enumerate(own):
            matrix[q, [at[w] for w in ws]] = [weight[at[w]] for w in ws]
        bounds = _Bounds(words, matrix, count, total)
        weights = [{w: weight[at[w]] for w in ws} for ws in own]
        best = table(_best(index, bounds, top), "best")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("id"), "key"))
        seeds = best.withColumn("place", place).filter(F.col("place") <= top)
        first = _placed(_scored(docs, seeds, own, weights, count, total), top).filter(F.col("rank") == top).select("item", "score", "doc_id").collect()
        floors = {r["item"]: (r["score"], math.inf if r["doc_id"] is None else r["doc_id"]) for r in first}
        ranked = _placed(_scored(docs, table(_open(index, bounds, floors), "open"), own, weights, count, total), top)
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(got)], f"item int, item_id {dict(asked.dtypes)['item_id']}")
        out.append(table(ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
    if not out:
        return spark.createDataFrame([], f"item_id {dict(asked.dtypes)['item_id']}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)


_LISTED = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = f"""
with d as materialized (select doc_id, unnest(ws) as t, len(ws) as n from (select doc_id, {_LISTED} as ws from documents)),
c as materialized (select doc_id, t, any_value(n)::bigint as n, count(*)::bigint as tf from d group by 1, 2),
g as materialized (select count(distinct doc_id)::bigint as docs, count(*)::bigint as total from d),
i as materialized (select item_id, unnest(list_distinct({_LISTED})) as t from benchmark),
w as materialized (select t, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from c cross join g where t in (select t from i) group by t),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::bigint as score from i join w using (t) join c using (t) cross join g group by 1, 2)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10
"""
