"""Removal of byte strings that a document with a smaller doc_id holds too, by suffix arrays of shards.

Texts are UTF-8 bytes, dealt into shards of SHARD_BYTES. Every window of LENGTH bytes has an anchor, the
ANCHOR-byte string in it with the least hash, so equal windows have equal anchors. In four steps:

1. Each shard sends its distinct anchors as sorted runs, cut into ranges of the hash. A range merges its runs and
   finds by binary search, for each run, which anchors occur more than once in the corpus. A window whose anchor
   does not is unique.
2. Up to LENGTH - ANCHOR + 1 neighbouring windows that share such an anchor are a piece of text. Each shard sends its
   distinct pieces, with the least doc_id that holds them, to the range of their anchor. Windows of anchors with
   more than HOT occurrences go one by one to the range of their own hash, so that no range collects what
   surrounds a passage that a large part of the corpus repeats.
3. A range cuts its distinct pieces into shards of SUFFIX_BYTES and builds each one's suffix array: suffixes are
   sorted by eight bytes and refined by the eight after them, unsorted groups only, to LENGTH bytes; common
   prefixes with the neighbour come from Kasai's rule, a suffix keeps its predecessor's less one, in text order
   for all at once. Neighbours that share LENGTH bytes are one window. The shards' windows are merged by one sort of
   their hashes and compared byte by byte, and the least doc_id of each window goes back to the shards of the texts.
4. A window in a document over that doc_id is removed; the covered bytes are merged and cut out.

Runs, pieces and answers are at most one a shard for what is equal, so copies and hot passages cost a row a shard.
Every shard meets every range in one row, whose number grows with the square of the corpus: shards and ranges are
as large as a task's memory allows, and a shard is worked through in blocks. A shard's texts are in rows of ROW_BYTES,
as rows of many megabytes would fill the executors' heaps.

Nulls and edges: a null text is empty; a document with null doc_id neither removes nor loses anything; rows that
repeat a doc_id do not remove from each other; texts shorter than LENGTH stay; an empty table gives no rows; a
text of any length stands in one shard; cut bytes need not be UTF-8, so ``kept`` is binary; other columns of
docs are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbmark.core.tables import table
from ebbmark.llm import textbytes as tb
from ebbmark.llm.batches import bounded, swept

LENGTH, ANCHOR = 50, 20
#: Bytes of texts in a shard and of pieces in a suffix array, anchors of a range, occurrences of a hot anchor.
SHARD_BYTES, SUFFIX_BYTES, RANGE, HOT = 16 << 20, 256 << 10, 1 << 18, 1 << 16
#: Places of a shard that are hashed at once, pieces that are, and bytes of texts in a row.
BLOCK, PIECES, ROW_BYTES = 1 << 17, 1 << 15, 512 << 10
_WIDE = LENGTH - ANCHOR + 1
#: The low bits of an anchor in a run hold the logarithm of its occurrences in the shard.
_LOW = np.uint64(31)


def _zip(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x if isinstance(x, bytes) else x.tobytes())


def _unzip(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _sharded(docs: DataFrame) -> DataFrame:
    """(shard, part, ids, null, starts, body, size): joined texts, each followed by a line break, in some rows a shard."""
    kinds = {"shard": pa.int64(), "part": pa.int32(), "ids": pa.binary(), "null": pa.binary(), "starts": pa.binary(), "body": pa.binary(), "size": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, texts in enumerate(tb.gathered(batches, SHARD_BYTES)):
            body, starts = tb.joined(texts["text"])
            ids, null = (x.to_numpy() for x in (pc.fill_null(texts["doc_id"], 0), pc.is_null(texts["doc_id"])))
            cuts = _cuts(starts[:-1] // ROW_BYTES)
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                inner = body[starts[a] : starts[b]]
                row = {"shard": first + i, "part": part, "ids": ids[a:b].tobytes(), "null": null[a:b].tobytes(), "starts": (starts[a:b] - starts[a]).tobytes(), "body": _zip(inner), "size": len(inner)}
                yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], names=list(kinds))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "shard long, part int, ids binary, null binary, starts binary, body binary, size long")


def pieces(body: np.ndarray, starts: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash) of each run of up to _WIDE windows with one anchor; ``skip``: documents without."""
    n = len(body) - tb.PAD
    view = tb.eights(body)
    last = starts[1:] - 1 - LENGTH  # the last window of each document
    real = (last >= starts[:-1]) & ~skip
    edge = np.zeros(n + 1, np.int8)
    edge[starts[:-1][real]] += 1
    edge[last[real] + 1] -= 1
    inside = np.cumsum(edge, dtype=np.int8, out=edge).view(bool)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
    for a in range(0, max(n - LENGTH + 1, 0), BLOCK):
        b = min(a + BLOCK, n - LENGTH + 1)
        ok, stop = inside[a:b], b + _WIDE - 1
        low = view[a:stop] * tb._M1
        for at in (8, ANCHOR - 8):
            low ^= low >> np.uint64(32)
            low += view[a + at : stop + at]
            low *= tb._M2
        low ^= low >> np.uint64(29)
        low *= tb._P
        low ^= low >> np.uint64(32)
        width = 1
        while 2 * width <= _WIDE:  # the least hash of 2, 4, 8 ... places
            low, width = np.minimum(low[width:], low[:-width]), 2 * width
        low = np.minimum(low[_WIDE - width :], low[: len(low) - (_WIDE - width)])
        new = ok.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new)
        ends = np.flatnonzero(ok & ~np.append(ok[1:], False)) + 1
        windows = np.minimum(np.append(first[1:], b - a)[: len(first)], ends[np.searchsorted(ends, first, "right")]) - first
        if len(windows) and windows.max() > _WIDE:  # what repeats itself
            parts = -(-windows // _WIDE)
            begin = _spread(np.zeros(len(parts), np.int64), parts) * _WIDE
            first, windows = np.repeat(first, parts) + begin, np.minimum(np.repeat(windows, parts) - begin, _WIDE)
        found.append((first + a, windows, low[first]))
    first, windows, keys = (np.concatenate(x) for x in zip(*found))
    # least hashes are small; mixed again they fall evenly into ranges
    return first, windows, tb.mix(keys) & ~_LOW


def _hashes(body: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of body[first : first + size] for each piece, of LENGTH to LENGTH + _WIDE - 1 bytes."""
    view = tb.eights(body)
    one, two = np.empty(len(first), np.uint64), np.empty(len(first), np.uint64)
    whole = [*range(0, LENGTH - 7, 8), LENGTH - 8]
    for a in range(0, len(first), PIECES):
        at, n = first[a : a + PIECES], size[a : a + PIECES]
        x, y = tb.mix(n.astype(np.uint64)), tb.mix(n.astype(np.uint64) + tb._P)
        # the bytes that every piece has, then the rest from its end; with the size this tells all texts apart
        for step in [*whole, *(np.maximum(n - back, LENGTH - 8) for back in range(8, _WIDE + 7, 8))]:
            word = view[at + step]
            x = (x ^ word) * tb._M1
            x ^= x >> np.uint64(31)
            y = (y + word) * tb._M2
            y ^= y >> np.uint64(29)
        one[a : a + PIECES], two[a : a + PIECES] = tb.mix(x), tb.mix(y)
    return one, two


def _opened(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(body, starts and the end, ids, null) of a shard."""
    rows = rows.sort_values("part")
    body = np.frombuffer(b"".join(map(_unzip, rows["body"])) + bytes(tb.PAD), np.uint8)
    ids, null = np.frombuffer(b"".join(rows["ids"]), np.int64), np.frombuffer(b"".join(rows["null"]), bool)
    begin = np.cumsum(rows["size"].to_numpy()) - rows["size"].to_numpy()
    starts = np.concatenate([*(np.frombuffer(x, np.int64) + a for x, a in zip(rows["starts"], begin)), [len(body) - tb.PAD]])
    return body, starts, ids, null


def _ranged(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _cuts(sorted_: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])), len(sorted_)) if len(sorted_) else np.empty(0, np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _anchors(shards: DataFrame, ranges: int) -> DataFrame:
    """(rng, shard, run): the sorted distinct anchors of each shard by range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        body, starts, _, null = _opened(pdf)
        keys, count = np.unique(pieces(body, starts, null)[2], return_counts=True)
        keys = keys | np.minimum(np.frexp(count.astype(float))[1] - 1, int(_LOW)).astype(np.uint64)
        rng = _ranged(keys, ranges)
        cuts = _cuts(rng)
        return pd.DataFrame({"rng": rng[cuts[:-1]], "shard": pdf["shard"].iloc[0], "run": [keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})

    return shards.groupBy("shard").applyInPandas(run, "rng int, shard long, run binary")


def _marked(runs: DataFrame) -> DataFrame:
    """(rng, shard, marks): for each anchor of a run 0, 1 if the corpus holds it more than once, 2 if it is hot."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, np.uint64) for x in pdf["run"]]
        every = np.sort(np.concatenate(own))
        cuts = _cuts(every & ~_LOW)
        total = np.add.reduceat(np.int64(1) << (every & _LOW).astype(np.int64), cuts[:-1])
        keys, mark = every[cuts[:-1]] & ~_LOW, (total > 1).astype(np.uint8) + (total > HOT)
        return pdf.assign(marks=[mark[np.searchsorted(keys, x & ~_LOW)].astype(np.uint8).tobytes() for x in own])[["rng", "shard", "marks"]]

    return runs.groupBy("rng").applyInPandas(run, "rng int, shard long, marks binary")


def _sent(shards: DataFrame, marks: DataFrame, ranges: int) -> DataFrame:
    """(rng, shard, windows, texts, lows, piece, first): distinct pieces with their least doc_id, and all their places."""
    columns, bits = ["rng", "shard", "windows", "texts", "lows", "piece", "first"], np.uint64((ranges - 1).bit_length())

    def run(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if found.empty:
            return pd.DataFrame(columns=columns)
        body, starts, ids, null = _opened(pdf)
        first, windows, keys = pieces(body, starts, null)
        mark = np.frombuffer(b"".join(found.sort_values("rng")["marks"]), np.uint8)[np.unique(keys, return_inverse=True)[1]]
        hot = mark == 2
        alone = _spread(first[hot], windows[hot])
        first, windows, keys = (np.concatenate([x[mark == 1], y]) for x, y in ((first, alone), (windows, np.ones(len(alone), np.int64)), (keys, _hashes(body, alone, np.full(len(alone), LENGTH))[0])))
        size, rng = windows + LENGTH - 1, _ranged(keys, ranges)
        one, two = _hashes(body, first, size)
        if bits:  # sorted by range, then by hash
            one = (rng.astype(np.uint64) << (np.uint64(64) - bits)) | (one >> bits)
        order = np.argsort(one)
        one, two = one[order], two[order]
        fresh = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[: len(one)]
        head, number = order[fresh], np.cumsum(fresh) - 1
        least = np.minimum.reduceat(ids[np.searchsorted(starts, first, "right") - 1][order], np.flatnonzero(fresh)) if len(order) else ids[:0]
        cuts = _cuts(rng[head])
        out = []
        for a, b in zip(cuts, cuts[1:]):
            mine, (x, y) = head[a:b], np.searchsorted(number, (a, b))
            out.append((int(rng[mine[0]]), pdf["shard"].iloc[0], windows[mine].astype(np.uint8).tobytes(), _zip(body[_spread(first[mine], size[mine])]), _zip(least[a:b]), _zip((number[x:y] - a).astype(np.uint32)), _zip(first[order[x:y]].astype(np.uint32))))
        return pd.DataFrame(out, columns=columns)

    return shards.groupBy("shard").cogroup(marks.groupBy("shard")).applyInPandas(run, "rng int, shard long, windows binary, texts binary, lows binary, piece binary, first binary")


def suffix_array(body: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places with ``left`` >= LENGTH bytes before their piece ends, sorted by LENGTH bytes.

    Sorted by eight bytes; groups of more than one are sorted by the eight bytes after those that they share.
    """
    at = np.flatnonzero(left >= LENGTH)
    view = tb.eights(body)
    words = view[at].byteswap()
    order = np.argsort(words)
    sa, words = at[order], words[order]
    fresh = np.concatenate([[True], words[1:] != words[:-1], [True]])[: len(sa) + 1]
    for depth in (*range(8, LENGTH - 8, 8), LENGTH - 8):
        todo = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
        if not len(todo):
            break
        group, there = np.cumsum(fresh[todo]), sa[todo]
        further = view[there + depth].byteswap()
        by = np.lexsort((further, group))
        sa[todo], further = there[by], further[by]
        fresh[todo[1:]] |= further[1:] != further[:-1]
    return sa


def common_prefixes(body: np.ndarray, left: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of ``sa`` shares with the one before, within both pieces.

    Kasai's rule in text order: if the bytes before a suffix and before its neighbour are equal and the latter
    are neighbours too, the prefix is one shorter than the predecessor's; only the others are compared.
    """
    before = np.full(len(left), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.sort(sa)
    there = before[at]
    follows = np.concatenate([[False], (at[1:] == at[:-1] + 1) & (there[1:] == there[:-1] + 1) & (there[1:] > 0) & (body[at[:-1]] == body[there[:-1]]) & (left[at[1:]] == left[at[:-1]] - 1) & (left[np.maximum(there[1:], 0)] == left[np.maximum(there[:-1], 0)] - 1)])[: len(at)]
    shared = np.zeros(len(at), np.int64)
    new = np.flatnonzero(~follows & (there >= 0))
    view, todo = tb.eights(body), new
    for step in range(0, 2 * LENGTH, 8):
        if not len(todo):
            break
        differ = (view[at[todo] + step] ^ view[there[todo] + step]).astype("<u8")
        bits = np.where(differ == 0, 64, 0)
        low = differ & (~differ + np.uint64(1))
        bits[differ != 0] = np.log2(low[differ != 0].astype(float)).astype(np.int64)
        shared[todo] += bits // 8
        todo = todo[differ == 0]
    shared[new] = np.minimum(shared[new], np.minimum(left[at[new]], left[there[new]]))
    source = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
    shared = np.maximum(shared[source] - (np.arange(len(at)) - source), 0)
    out = np.empty(len(left), np.int64)
    out[at] = shared
    return out[sa]


def least_ids(texts: np.ndarray, sizes: np.ndarray, lows: np.ndarray, limit: int = SUFFIX_BYTES) -> np.ndarray:
    """For each window of each piece, in order, the least of the pieces' ``lows`` over all pieces that hold it."""
    ends = np.cumsum(sizes)
    shard = (ends - sizes) // limit
    known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each shard: sorted hashes of its windows, where, least
    groups = []
    texts = np.concatenate([texts, np.zeros(tb.PAD + 2 * LENGTH, np.uint8)])
    for s in np.unique(shard):
        mine = np.flatnonzero(shard == s)
        base, stop = ends[mine[0]] - sizes[mine[0]], ends[mine[-1]]
        body = texts[base : stop + tb.PAD + 2 * LENGTH]
        left = np.repeat(ends[mine] - base, sizes[mine]) - np.arange(stop - base)
        owner = np.repeat(lows[mine], sizes[mine])
        sa = suffix_array(body, left)
        fresh = common_prefixes(body, left, sa) < LENGTH
        fresh[:1] = True
        begin = np.flatnonzero(fresh)
        least = np.minimum.reduceat(owner[sa], begin)
        head = sa[begin]
        h = _hashes(body, head, np.full(len(head), LENGTH))[0]
        order = np.argsort(h)
        known.append((h[order], (head[order] + base).astype(np.int32), least[order]))
        place = np.empty(len(left), np.int32)
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        place[sa] = where[np.cumsum(fresh) - 1]
        groups.append(place[left >= LENGTH])
    if not known:
        return np.empty(0, np.int64)
    ends = np.cumsum([len(k[0]) for k in known])
    h, head, least = (np.concatenate(x) for x in zip(*known))
    known.clear()
    if len(groups) > 1:
        _merge(texts, h, head, least)
    return np.concatenate([least[a:b][g] for a, b, g in zip(np.append(0, ends), ends, groups)])


def _merge(texts: np.ndarray, h: np.ndarray, head: np.ndarray, least: np.ndarray) -> None:
    """Sets ``least`` of each window, of hash ``h`` at ``head``, to the least of all windows with its bytes."""
    order = np.argsort(h)
    h = h[order]
    fresh = np.concatenate([[True], h[1:] != h[:-1], [True]])
    todo = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
    order, fresh = order[todo], fresh[todo]
    group, begin, row = np.cumsum(fresh) - 1, np.flatnonzero(fresh), np.arange(LENGTH)
    other = np.zeros(len(order), bool)  # windows of one hash that are not the first one's
    for a in range(0, len(order), PIECES):
        part = slice(a, a + PIECES)
        other[part] = (texts[head[order[part]][:, None] + row] != texts[head[order[begin[group[part]]]][:, None] + row]).any(axis=1)
    if other.any():
        unlike = np.flatnonzero(other)
        group[unlike] = len(begin) + np.unique(np.ascontiguousarray(texts[head[order[unlike]][:, None] + row]).view(f"V{LENGTH}").ravel(), return_inverse=True)[1]
    best = np.full(len(order) + len(begin), np.iinfo(np.int64).max)
    np.minimum.at(best, group, least[order])
    least[order] = best[group]


def _answered(sent: DataFrame) -> DataFrame:
    """(rng, shard, n, runs, mins): for each piece of a shard, how many stretches of windows have one least doc_id, and these."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        windows = [np.frombuffer(x, np.uint8).astype(np.int64) for x in pdf["windows"]]
        sizes = np.concatenate(windows) + LENGTH - 1
        texts = np.frombuffer(b"".join(map(_unzip, pdf["texts"])) + bytes(tb.PAD), np.uint8)
        lows = np.frombuffer(b"".join(map(_unzip, pdf["lows"])), np.int64)
        ends = np.cumsum(sizes)
        one, two = _hashes(texts, ends - sizes, sizes)
        order = np.argsort(one)
        one, two = one[order], two[order]
        fresh = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        head, same = order[fresh], np.empty(len(order), np.int64)
        same[order] = np.cumsum(fresh) - 1
        own = sizes[head] - LENGTH + 1
        least = least_ids(texts[_spread(ends[head] - sizes[head], sizes[head])], sizes[head], np.minimum.reduceat(lows[order], np.flatnonzero(fresh)))
        piece = np.repeat(np.arange(len(head)), own)
        begin = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])]))
        count = np.bincount(piece[begin], minlength=len(head))
        length, at = np.diff(np.append(begin, len(least))), np.cumsum(count) - count
        out, x = [], 0
        for w in windows:
            mine = same[x : x + len(w)]
            x += len(w)
            take = _spread(at[mine], count[mine])
            out.append((count[mine].astype(np.uint8).tobytes(), length[take].astype(np.uint8).tobytes(), _zip(least[begin[take]])))
        return pdf[["rng", "shard"]].assign(**{c: [o[i] for o in out] for i, c in enumerate(("n", "runs", "mins"))})

    return sent.select("rng", "shard", "windows", "texts", "lows").groupBy("rng").applyInPandas(run, "rng int, shard long, n binary, runs binary, mins binary")


def _cut(shards: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every document; answers(shard, piece, first, n, runs, mins) may lack shards."""

    def run(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        body, starts, ids, null = _opened(pdf)
        gone = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for x in found.itertuples():
            piece, first = np.frombuffer(_unzip(x.piece), np.uint32).astype(np.int64), np.frombuffer(_unzip(x.first), np.uint32).astype(np.int64)
            n, lengths, mins = np.frombuffer(x.n, np.uint8).astype(np.int64), np.frombuffer(x.runs, np.uint8).astype(np.int64), np.frombuffer(_unzip(x.mins), np.int64)
            into = np.cumsum(lengths) - lengths
            at = np.cumsum(n) - n
            into -= np.repeat(into[at], n)
            take = _spread(at[piece], n[piece])
            begin = np.repeat(first, n[piece]) + into[take]
            out = mins[take] < ids[np.searchsorted(starts, begin, "right") - 1]
            gone.append((begin[out], begin[out] + lengths[take][out] + LENGTH - 1))
        begin, end = (np.concatenate(x) for x in zip(*gone))
        order = np.argsort(begin)
        begin, end = begin[order], np.maximum.accumulate(end[order])
        cuts = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1], [True]])) if len(begin) else np.zeros(1, np.int64)
        begin, end = begin[cuts[:-1]], end[cuts[1:] - 1]
        own = np.searchsorted(begin, starts)  # the spans of each document
        body, spans, kept = body.data, [], []
        for d in range(len(ids)):
            s, a, b = int(starts[d]), begin[own[d] : own[d + 1]].tolist(), end[own[d] : own[d + 1]].tolist()
            spans.append([(i - s, j - s) for i, j in zip(a, b)])
            kept.append(b"".join(body[i:j] for i, j in zip([s, *b], [*a, int(starts[d + 1]) - 1])))
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64").mask(null), "n_bytes": np.diff(starts) - 1, "removed": spans, "kept": kept})

    return shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(run, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) for each row of docs(doc_id, text): byte ranges removed, and what is left."""
    spark = bounded(docs.sparkSession)
    with swept(spark):
        shards = table(_sharded(docs), "shards")
        size = shards.agg(F.sum("size")).first()[0] or 0
        ranges = max(1, math.ceil(2 * size / (_WIDE + 1) / RANGE))
        marks = table(_marked(_anchors(shards, ranges)), "marks")
        sent = table(_sent(shards, marks, ranges), "pieces")
        answers = table(_answered(sent), "answers")
    return _cut(shards, sent.select("rng", "shard", "piece", "first").join(answers, ["rng", "shard"]))


SQL = r"""
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as materialized (select doc_id, i, substr(x, 2 * i + 1, 100) as s from (select doc_id, x, unnest(range(0, length(x) // 2 - 49)) as i from d where length(x) >= 100)),
first as materialized (select s, min(doc_id) as lo from w group by s having count(*) > 1),
hit as materialized (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from w join first using (s) where lo < doc_id),
island as materialized (select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as k from hit),
r as materialized (select doc_id, k, min(i) as a, max(i) + 50 as b from island group by 1, 2),
gaps as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from r
  union all select r.doc_id, max(b), any_value(length(d.x) // 2) from r join d using (doc_id) group by 1),
left_over as (select g.doc_id, string_agg(substr(d.x, 2 * g.x + 1, 2 * (g.y - g.x)), '' order by g.x) as x from gaps g join d using (doc_id) group by 1),
sums as (select doc_id, sum(b - a) as n, count(*) as k from r group by 1)
select d.doc_id, (length(d.x) // 2)::bigint as n_bytes, coalesce(s.n, 0)::bigint as n_removed, coalesce(s.k, 0)::bigint as n_spans, sha256(unhex(coalesce(l.x, d.x))) as kept_sha256
from d left join sums s using (doc_id) left join left_over l using (doc_id)
"""
