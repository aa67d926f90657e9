"""Suffix-array dedup, collocations and ranked search against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from ebbmark.llm import chat, collocation, search, secrets, suffix_dedup
from ebbmark.llm import textbytes as tb

RNG = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(40)] + ["été", "Straße", "naïve"]
SHARED = " ".join(RNG.choice(WORDS, 60))


def prose(n):
    return " ".join(RNG.choice(WORDS, n)) + RNG.choice([".", "!\n", ", "])


def corpus():
    texts = [prose(int(n)) for n in RNG.integers(1, 80, 40)]
    texts += [f"{prose(9)} {SHARED} {prose(7)}" for _ in range(12)] + [SHARED, SHARED, SHARED.upper()]
    texts += ["", None, "x", "ü" * 30, "ü" * 200, "ab" * 400, "a b " * 300, "no words? " + "q" * 5000, prose(9000), "\x00\x01" * 60, "\t \n\r"]
    ids = [int(i) for i in RNG.permutation(len(texts))]
    rows = [(i, t, RNG.choice(["en", "fr"]).item()) for i, t in zip(ids, texts)]
    rows += [(None, SHARED, None), (None, None, "en"), (rows[3][0], rows[3][1], "en"), (rows[50][0], rows[50][1], "fr"), (10**12, SHARED, None)]
    return rows


ROWS = corpus()


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, "other", 1) for r in ROWS], "doc_id long, text string, lang string, score string, rank int").repartition(3)


# --- suffix arrays


def plain_removed(rows):
    least = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                least[b[p : p + 50]] = min(i, least.get(b[p : p + 50], i))
    out = []
    for i, t, *_ in rows:
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - 49):
            if i is not None and least[b[p : p + 50]] < i:
                gone |= set(range(p, p + 50))
        spans = [p for p in gone if p - 1 not in gone]
        out.append((str(i), len(b), len(gone), len(spans), bytes(x for p, x in enumerate(b) if p not in gone)))
    return sorted(out)


def as_rows(df):
    return sorted((str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in df.collect())


def test_suffix_dedup_equals_plain_version(docs):
    assert as_rows(suffix_dedup.without_repeats(docs)) == plain_removed(ROWS)


def test_suffix_dedup_with_many_shards_ranges_and_hot_anchors(docs, monkeypatch):
    for name, value in (("SHARD_BYTES", 2000), ("RANGE", 64), ("HOT", 3)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert as_rows(suffix_dedup.without_repeats(docs)) == plain_removed(ROWS)


def test_suffix_dedup_of_no_rows(docs):
    assert suffix_dedup.without_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [200, 1 << 20])
def test_windows_of_pieces_merge_over_suffix_arrays(limit):
    parts = [RNG.integers(97, 99, int(n)).astype(np.uint8) for n in RNG.integers(50, 85, 30)]
    parts = [*parts, *(p[3:] for p in parts if len(p) > 60), *(np.full(70, 97, np.uint8) for _ in range(4))]
    lows = RNG.permutation(len(parts)).astype(np.int64)
    want = {}
    for p, low in zip(parts, lows):
        for i in range(len(p) - 49):
            key = p[i : i + 50].tobytes()
            want[key] = min(low, want.get(key, low))
    got = suffix_dedup.least_ids(np.concatenate(parts), np.array([len(p) for p in parts]), lows, limit)
    assert got.tolist() == [want[p[i : i + 50].tobytes()] for p in parts for i in range(len(p) - 49)]


def test_suffix_array_and_common_prefixes():
    body = np.concatenate([RNG.integers(97, 100, 400), np.full(120, 97), np.tile([97, 98, 99], 60), np.zeros(tb.PAD + 100)]).astype(np.uint8)
    left = np.arange(700, 0, -1)
    sa = suffix_dedup.suffix_array(body, left)
    keys = [body[i : i + 50].tobytes() for i in sa]
    assert sorted(sa.tolist()) == list(range(651)) and keys == sorted(keys)
    both = suffix_dedup.common_prefixes(body, left, sa)
    for i, (a, b) in enumerate(zip(sa, sa[1:]), 1):
        n = next((k for k in range(80) if k >= min(left[a], left[b]) or body[a + k] != body[b + k]), 80)
        assert min(both[i], 80) == n or both[i] >= 80 and n >= 80


# --- collocations


def plain_phrases(rows, least, inside, top):
    count, size = {}, Counter()
    for _, t, lang, *_ in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            size[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        found = []
        for g, a in f.items():
            if len(g) > 1 and a >= least:
                if len(g) == 2 and any(100 * b >= inside * a for t, b in f.items() if len(t) == 3 and b >= least and g in (t[:2], t[1:])):
                    continue
                score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, size[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("budget, top", [(1 << 20, 2000), (300, 2000), (40, 25)])
def test_phrases_equal_plain_version(docs, budget, top):
    got = collocation.phrases(docs, least=5, top=top, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(ROWS, 5, 50, top)


def test_phrases_of_blank_texts(docs):
    assert collocation.phrases(docs.filter("text is null or text = ''")).collect() == [] == collocation.phrases(docs.limit(0)).collect()


def test_subtree_totals():
    h = RNG.integers(0, 4, (3, 500)).astype(np.uint64)
    h[1:, h[0] == 0], h[2, h[1] == 0] = 0, 0
    n = RNG.integers(1, 5, 500)
    for depth, (nodes, total) in enumerate(collocation.subtree(h, n)):
        want = Counter()
        for col, c in zip(h.T.tolist(), n):
            if col[depth]:
                want[tuple(col[: depth + 1])] += c
        assert {tuple(x[: depth + 1]): t for x, t in zip(nodes.T.tolist(), total)} == want


# --- search


ITEMS = [(1, SHARED), (2, "W1 w2 w2 w3 é"), (3, None), (4, "nothing known"), (5, "Straße, ÉTÉ été! w5"), (None, "q w7 x"), (7, " ".join(WORDS)), (8, ""), (9, "W1 w2 w2 w3 é")]


def plain_ranks(rows, items, top=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    said = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in pattern.findall(t or "")]
    docs = [(i, Counter(said(t)), len(said(t))) for i, t, *_ in rows]
    docs = [d for d in docs if d[2]]
    count, total = len(docs), sum(d[2] for d in docs)
    out = []
    for item, text in items:
        weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * sum(t in d[1] for d in docs) + 1))) for t in said(text)}
        found = [(sum(w * (10**9 * tf[t] // (1000 * tf[t] + 8 * (10 + 90 * n * count // total))) for t, w in weight.items() if t in tf), i) for i, tf, n in docs]
        found = sorted((-s, math.inf if i is None else i) for s, i in found if s > 0)[:top]
        out += [(str(item), r, "None" if i == math.inf else str(i), -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("items, size", [(256, 6 << 20), (3, 3000)])
def test_search_equals_plain_version(spark, docs, monkeypatch, items, size):
    monkeypatch.setattr(search, "ITEMS", items)
    monkeypatch.setattr(search, "BLOCK_BYTES", size)
    asked = spark.createDataFrame([(*i, 0.5) for i in ITEMS], "item_id long, text string, score double")
    got = search.search(docs, asked)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in got.collect()) == plain_ranks(ROWS, ITEMS)


def test_search_without_documents_or_items(spark, docs):
    asked = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(docs.limit(0), asked).collect() == [] == search.search(docs, asked.limit(0)).collect()
    assert search.search(docs.filter("text = ''"), asked).collect() == []


def test_words_of_any_length_hash_by_their_bytes():
    words = [b"a" * n for n in range(1, 90)] + [b"", b"b" * 8, b"b" * 64, b"b" * 65, b"a\x00", b"a\x00\x00"]
    ends = np.cumsum([len(w) for w in words])
    body = np.frombuffer(b"".join(words) + bytes(tb.PAD), np.uint8)
    assert len(set(tb.hashed(body, ends - [len(w) for w in words], ends))) == len(words)


# --- secrets and transcripts


def test_a_long_chain_of_later_constants_is_linear():
    import time

    n = 50_000
    text = "password = a0\n" + "".join(f"a{i} = a{i + 1}\n" for i in range(n)) + f'a{n} = "Zx9-kQ27-vvT81"\n'
    began = time.time()
    found = secrets.literals(text)
    assert time.time() - began < 10
    assert [text[a:b] for a, b, _ in found] == ["Zx9-kQ27-vvT81"]


def test_names_in_a_circle_end():
    assert secrets.literals('password = b1\nb1 = c1\nc1 = b1\n') == []
    text = 'password = b1 + "Zx9-kQ27-vvT81"\nb1 = c1\nc1 = b1 + "mN4_pL66_qqW30"\n'
    assert {text[a:b] for a, b, _ in secrets.literals(text)} >= {"Zx9-kQ27-vvT81"}


def model(spark):
    turns = [(c, t, ("system", "user", "assistant")[0 if t == 0 else 1 + t % 2], f"some words {c} {t}" + "?" * (t % 2)) for c in range(40) for t in range(6)]
    raw = chat.transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    return chat.parameters(chat.counts(raw))


def test_no_line_of_a_transcript_is_lost(spark):
    fitted = model(spark)
    texts = ["Assistant: I wrote", "System: be kind\nAnswer: no", "User: he said\nBot: quoted\nmore\n\nAssistant: fine?", "Q: a\n\nQ: b\n\nQ: c", "no marker\n\nnor here", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in chat.formatted(rows, fitted).collect():
        said = [x for x in r.rendered.split("\n") if x]
        role, at = None, 0
        for line in (x for x in r.text.split("\n") if x.strip()):
            while at < len(said) and said[at].startswith("<|"):
                role, at = said[at][2:-2], at + 1
            (rest, marked, _, _) = chat.lines_of(line)[0]
            if at < len(said) and said[at] == line:
                at += 1
            else:  # only a marker of the turn's own role goes
                assert marked >= 0 and chat.ROLES[marked] == role
                if rest:
                    assert said[at] == rest
                    at += 1
    first = chat.formatted(rows.limit(1), fitted).first()
    assert first.roles_found == ["assistant"] and first.rendered == "<|assistant|>\nI wrote\n<|end|>"
