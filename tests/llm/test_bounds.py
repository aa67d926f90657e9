"""What a reused Python worker keeps, and what near-duplicate detection shuffles where lists are crowded."""

import gc
import random
import weakref

import pandas as pd
import public_tokenizers

from ebbmark.llm import batches, near_dedup, packing, quality
from ebbmark.llm.words import WordHashes


def test_a_worker_keeps_one_memory(spark):
    path, texts = public_tokenizers.path("word_bpe_49k.json"), pd.Series(["some words of a text", None, ""])
    for later in (quality._counter(), near_dedup._signer(4, 32)):
        encoder = weakref.ref(batches.held(packing.Encoder, path, 2))
        assert batches.held(packing.Encoder, path, 2) is encoder()
        later.func(texts)
        gc.collect()
        assert encoder() is None
        assert batches.held(WordHashes) is batches.held(WordHashes)
        assert b"words" in batches.held(WordHashes)


def _stages(spark):
    """Stage id -> bytes of shuffle files written."""
    jvm = spark.sparkContext._gateway
    none = jvm.jvm.java.util.ArrayList()
    found = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, jvm.new_array(jvm.jvm.double, 0), none)
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}


def test_crowded_lists_do_not_shuffle_signatures_by_key(spark, monkeypatch):
    # 40 families that share a template, each of 10 texts near the threshold
    monkeypatch.setattr(near_dedup, "CROWD", 3)
    rng, rows = random.Random(11), []
    template = [f"t{i}" for i in range(60)]
    for f in range(40):
        body = template + [f"f{f}w{i}" for i in range(90)]
        for _ in range(10):
            words = list(body)
            for at in rng.sample(range(60, 150), 4):
                words[at] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    last, name = max(_stages(spark), default=-1), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, -1)  # small tables, too, meet in shuffles
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=4).collect()}
    finally:
        spark.conf.unset(name)
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(147)} for i, t in rows}
    least = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * (both := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = least[i], least[j]
                least = {k: min(a, b) if v in (a, b) else v for k, v in least.items()}
    assert got == least
    written = sum(n for stage, n in _stages(spark).items() if stage > last)
    print(f"{written / len(rows):.0f} bytes a text")
    assert written < LIMIT * len(rows)


#: Bytes of shuffle files a text.
LIMIT = 60_000
