"""What op11's work grows with: rows between shards and ranges, shards of pieces, and texts that repeat themselves."""

import cProfile
import math
import pstats

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbmark.llm import suffix_dedup
from ebbmark.llm import textbytes as tb

RNG = np.random.default_rng(11)


def made_pieces(n):
    """Pieces of 50 to 80 bytes of which every third begins within the one before."""
    whole = RNG.integers(97, 123, 31 * n + 200).astype(np.uint8)
    begin = np.arange(n) * 31 - np.where(np.arange(n) % 3 == 1, 20, 0) + 20
    sizes = RNG.integers(50, 81, n)
    return [whole[a : a + s] for a, s in zip(begin, sizes)], RNG.permutation(n).astype(np.int64)


def plain_least(parts, lows):
    want = {}
    for p, low in zip(parts, lows):
        for i in range(len(p) - 49):
            key = p[i : i + 50].tobytes()
            want[key] = min(low, want.get(key, low))
    return [want[p[i : i + 50].tobytes()] for p in parts for i in range(len(p) - 49)]


def test_merging_shards_takes_calls_by_shard_and_not_by_pair():
    def calls(n):
        parts, lows = made_pieces(n)
        texts, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        with cProfile.Profile() as profile:
            got = suffix_dedup.least_ids(texts, sizes, lows, 700)
        assert got.tolist() == plain_least(parts, lows)
        return pstats.Stats(profile).total_calls

    assert calls(800) < 2.3 * calls(400)


@pytest.mark.parametrize("limit", [200, 1 << 20])
def test_windows_of_one_hash_are_told_apart(limit, monkeypatch):
    parts, lows = made_pieces(60)
    monkeypatch.setattr(suffix_dedup, "_hashes", lambda body, first, size: (np.full(len(first), 7, np.uint64),) * 2, raising=False)
    monkeypatch.setattr(tb, "hashed", lambda body, starts, ends, seed=0: np.full(len(starts), 7, np.uint64))
    got = suffix_dedup.least_ids(np.concatenate(parts), np.array([len(p) for p in parts]), lows, limit)
    assert got.tolist() == plain_least(parts, lows)


def test_hashes_of_pieces_tell_every_byte_and_size():
    body = np.concatenate([RNG.integers(0, 256, 90), np.zeros(tb.PAD)]).astype(np.uint8)
    sizes = np.arange(50, suffix_dedup.LENGTH + suffix_dedup._WIDE)
    of_sizes = suffix_dedup._hashes(body, np.zeros(len(sizes), np.int64), sizes)
    assert all(len(np.unique(h)) == len(sizes) for h in of_sizes)
    for n in sizes:
        changed = np.repeat(body[None, :n], n, axis=0) ^ np.eye(n, dtype=np.uint8)
        of_changes = suffix_dedup._hashes(np.append(changed.ravel(), np.zeros(tb.PAD, np.uint8)), np.arange(n) * n, np.full(n, n))
        assert all(len(np.unique(np.append(h, own))) == n + len(sizes) for h, own in zip(of_changes, of_sizes))


@pytest.mark.parametrize("unit", ["a", "Thhaen ", "an " * 20])
def test_a_text_that_repeats_itself_makes_few_pieces(unit):
    text = (unit * 40000)[:40000].encode()
    body = np.frombuffer(text + b"\n" + bytes(tb.PAD), np.uint8)
    first, windows, _ = suffix_dedup.pieces(body, np.array([0, len(text) + 1]), np.zeros(1, bool))
    assert len(first) <= len(text) / (suffix_dedup._WIDE / 2)
    assert windows.max() <= suffix_dedup._WIDE
    assert np.array_equal(np.concatenate([np.arange(a, a + n) for a, n in zip(first, windows)]), np.arange(len(text) - 49))


def test_equal_windows_have_equal_keys_wherever_they_stand(monkeypatch):
    """Over block ends, in documents that are too short, and in those left out."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300, raising=False)
    words = [bytes(RNG.integers(97, 100, 5).astype(np.uint8)) for _ in range(12)]
    texts = [b" ".join(words[i] for i in RNG.integers(0, 12, n)) for n in (1, 8, 9, 300, 0, 40, 200, 11, 60)] + [b"x" * 120, b"xy" * 90]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    body = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(tb.PAD), np.uint8)
    skip = np.arange(len(texts)) == 5
    first, windows, keys = suffix_dedup.pieces(body, starts, skip)
    at, key = np.concatenate([np.arange(a, a + n) for a, n in zip(first, windows)]), np.repeat(keys, windows)
    assert at.tolist() == [int(s) + i for s, t, x in zip(starts, texts, skip) if not x for i in range(len(t) - 49)]
    found = {}
    for a, k in zip(at, key):
        assert found.setdefault(body[a : a + 50].tobytes(), k) == k


def test_rows_between_shards_and_ranges_are_few(spark):
    """Their number is shards times ranges: 24 MB are two shards and six ranges (before, six times sixteen)."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.substring(F.md5(F.concat_ws(" ", "id", i)), 1, 9)), " ")
    docs = spark.range(0, 8000, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"))
    shards = suffix_dedup._sharded(docs).cache()
    size = shards.agg(F.sum("size")).first()[0]
    ranges = max(1, math.ceil(2 * size / (suffix_dedup._WIDE + 1) / suffix_dedup.RANGE))
    assert size == 24_000_000
    assert shards.select("shard").distinct().count() * ranges <= 12
    # 6 GB of Parquet are some 10.6 GB of text
    assert (10.6e9 / suffix_dedup.SHARD_BYTES) * (2 * 10.6e9 / (suffix_dedup._WIDE + 1) / suffix_dedup.RANGE) < 2e6
    shards.unpersist()


def test_large_ids_beside_null_ones(spark):
    text = "one passage that stands in all of these documents and is long enough"
    rows = [(2**60 + 1, text), (None, text), (2**60 + 2, text), (2**60, "another")]
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {2**60: "another", 2**60 + 1: text, 2**60 + 2: "", None: text}
