"""Texts that share a template: crowded posting lists meet under the second signature."""

import random
import time

import pytest

from ebbmark.llm import near_dedup


def _texts(n, seed, own=60):
    """Every text is 120 common words and its own ones; each tenth is a copy of the one before with two words changed."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(120)]
    out = []
    for i in range(n):
        if i % 10 == 9:
            words = out[-1][1].split()
            words[125], words[-3] = f"c{i}", f"d{i}"
        else:
            words = template + [f"w{rng.randrange(10**9)}" for _ in range(own)]
        out.append((i, " ".join(words)))
    return out


def _classes(rows, shingle=4):
    sets = {i: {tuple(t.split()[j : j + shingle]) for j in range(len(t.split()) - shingle + 1)} for i, t in rows}
    least = {i: i for i in sets}
    for i in sorted(sets):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = least[i], least[j]
                least = {k: min(a, b) if v in (a, b) else v for k, v in least.items()}
    return least


@pytest.mark.parametrize("own", [20, 60])
def test_template_texts_against_all_pairs(spark, monkeypatch, own):
    # own words of 20 leave the texts near the threshold, so also the second signature's lists are full
    monkeypatch.setattr(near_dedup, "CROWD", 3)
    rows = _texts(120, own, own)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=4).collect()}
    assert got == _classes(rows)


def test_fewest_matches():
    assert near_dedup._fewest(32, 80) == 13
    assert near_dedup._fewest(256, 80) < near_dedup._fewest(256, 90) < 256


def test_many_template_texts_give_no_pairs(spark):
    rows = _texts(1500, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = time.time()
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=4).collect()}
    assert got == {i: i - 1 if i % 10 == 9 else i for i, _ in rows}
    assert time.time() - at < 120
