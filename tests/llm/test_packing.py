"""The encoder against its tokenizer, and packing with many sources or weights against a plain round-robin."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ebbmark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
BITS = ["'s", "'re", "'", "don't", "a", "bc", "é", "É", "ẞ", "ſ", "İ", "ı", "K", "Å", "0", "12", "³", "ª", ".", "--", "«", "…", "€", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "́", "<|endoftext|>", "<|", "中文", "Σ", "\x01", "\x02", "\x020", "\xad", "ŉ", "'ſ", "'S", "'LL", "('m)", "﻿", "😀"]


def checked(encoder, tokenizer, texts):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert ids[at : at + n].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], t
        at += n
    assert at == len(ids)


@pytest.mark.parametrize("name, by_words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_the_tokenizer(name, by_words):
    path, rng = public_tokenizers.path(name), random.Random(1)
    encoder, tokenizer = packing.Encoder(path, 2, limit=500), Tokenizer.from_file(path)
    assert encoder.by_words == by_words
    for _ in range(20):
        checked(encoder, tokenizer, ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(150)] + [None, ""])
    chars = [chr(c) for c in range(0x2100) if not 0xD800 <= c < 0xE000]
    checked(encoder, tokenizer, [f"a{c}b'{c} s" for c in chars])
    checked(encoder, tokenizer, ["word, don't " * 40_000 + "end", "x" * 20_000])
    checked(encoder, tokenizer, [])


def packed(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    by = defaultdict(list)
    for r in packing.pack(docs, PATH, length=256, **how).collect():
        by[r.sequence_id].append(r)
    for ps in by.values():
        ps.sort(key=lambda r: r.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))]
        assert sum(p.length for p in ps) == ps[0].sequence_length
    assert sorted(by) == list(range(len(by)))
    tokens = Counter()
    for ps in by.values():
        for p in ps:
            tokens[p.doc_id] += p.length
    assert tokens == Counter({i: len(t.split()) + 1 for i, t, _ in rows})
    return [by[k] for k in sorted(by)]


def many(seed=2):
    rng = random.Random(seed)
    return [(i, "abc " * rng.randint(0, 60), f"s{int(60 * rng.random() ** 2)}") for i in range(2500)]


@pytest.mark.parametrize("own, slack", [(192, 8), (8, 2 * 61)])
def test_every_window_holds_the_proportions_of_all_sources(spark, own, slack):
    rows = many()
    total, given = Counter(), Counter()
    for _, t, s in rows:
        total[s] += len(t.split()) + 1
    for ps in packed(spark, rows, own_queues=own):
        for p in ps:
            given[p.source] += p.length
        g = sum(given.values())
        # own queues: within tokens of the target; sources of a shared queue: within a document, before and after
        assert max(abs(given[s] - n * g / sum(total.values())) for s, n in total.items()) <= slack


def plain_round_robin(totals, weights, length):
    """Tokens of each weighted source per window by deficit round-robin, one token at a time, until all are dry."""
    left, out, deficit = {s: totals[s] for s, w in weights.items() if w > 0 and totals[s]}, [Counter()], Counter()
    while left:
        for s in left:
            deficit[s] += weights[s] / sum(weights[x] for x in left)
        s = max(left, key=deficit.__getitem__)
        deficit[s] -= 1
        out[-1][s] += 1
        left[s] -= 1
        if not left[s]:
            del left[s]
        if sum(out[-1].values()) == length:
            out.append(Counter())
    return out[:-1]


def test_weights_reach_every_source_they_name(spark):
    rows = many(3)
    total = Counter()
    for _, t, s in rows:
        total[s] += len(t.split()) + 1
    small = sorted(total, key=lambda s: total[s])[0]
    weights = {"s1": 2, small: 1, "s0": 0.5, "s3": 0, "nowhere": 4}
    want = plain_round_robin(total, weights, 256)
    got = packed(spark, rows, weights=weights, own_queues=8)
    run_g, run_w = Counter(), Counter()
    for ps, w in zip(got, want):
        for p in ps:
            run_g[p.source] += p.length
        run_w.update(w)
        assert all(abs(run_g[s] - run_w[s]) <= 12 for s in ("s1", "s0", small)), (run_g, run_w)
    assert run_w["s1"] >= total["s1"] - 256 and run_g["s3"] == 0
