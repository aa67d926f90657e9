"""Cases at and beyond former limits of the operators: each must come out as from a smaller input."""

import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbmark.llm import chat, decontam, pii, secrets, tagger

SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in enumerate(texts)], SCHEMA)


# --- 9 decontamination


@pytest.mark.parametrize("n", range(decontam.LEAST, decontam.SPAN + 1))
def test_some_mask_meets_none_of_the_changes(n):
    for changed in combinations(range(n), n // 6):
        assert any(not set(changed) & set(m) for m in decontam.masks(n))
    for m in decontam.masks(n):
        assert m[1:3] == (m[0] + 1, m[0] + 2)


def test_leaks_at_every_place_of_changes(spark):
    rng = random.Random(12)
    fresh = iter(range(10**6))
    some = lambda k: [f"x{next(fresh)}" for _ in range(k)]
    items = {n: some(n) for n in (*range(5, 13), 14, 40)}
    texts = []
    for n, item in items.items():
        changes = [c for k in range(4) for c in combinations(range(n), k)] if n < 13 else combinations(range(n), 2) if n == 14 else [range(4, n, 5), range(0, n, 4)]
        for at in changes:
            w = [f"y{next(fresh)}" if i in at else x for i, x in enumerate(item)]
            texts.append(some(rng.randint(0, 3)) + w + some(rng.randint(0, 3)))
    texts += [items[12][:10], ["y"] + items[12][:11]]

    def met(w):
        for item in items.values():
            size = min(len(item), 12)
            wins = [item[i : i + size] for i in range(len(item) - size + 1)]
            for i in range(len(w) - size + 1):
                if any(6 * sum(a == b for a, b in zip(w[i : i + size], win)) >= 5 * size for win in wins):
                    yield i, size

    want = {}
    for i, w in enumerate(texts):
        if hits := set(met(w)):
            want[i] = (len({a for a, _ in hits}), len({j for a, k in hits for j in range(a, a + k)}))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {r.doc_id: (r.n_windows, r.n_words) for r in decontam.leaks(frame(spark, [" ".join(w) for w in texts]), bench).collect()}
    assert got == want
    docs = frame(spark, [" ".join(w) for w in texts])
    docs = docs.unionByName(docs.filter("doc_id < 9").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.filter("doc_id < 5"))
    found = decontam.leaks(docs, bench, rows=0)
    assert {r.doc_id: (r.n_windows, r.n_words) for r in found.collect() if r.doc_id is not None} == want
    assert found.filter("doc_id is null").count() == decontam.leaks(docs, bench).filter("doc_id is null").count() > 0


# --- 2 secrets


def _found(text):
    return [text[a:b] for k, a, b, _ in secrets.spans_of(text) if k == "literal"]


@pytest.mark.parametrize("n", [24, 500, 501, 600, 50_000])
def test_literals_of_any_length(n):
    rng = random.Random(n)
    value = "".join(rng.choice("ghijklmnpqrstvwyzGHIJKLMNPQRSTVWYZ0123456789+/") for _ in range(n))  # no placeholder by chance
    for text in (f'encryption_key = "{value}"', f'{{"credentials": "{value}", "n": 1}}', f"auth = '{value}'\nn = 1", f'k = "{value}"\nclient_credential = k', f'signing_key = "" + "{value}" + ""'):
        assert _found(text) == [value]


def test_names_of_any_length():
    long = "client_credential_" + "of_the_other_side_" * 20
    assert _found(f'{long} = "Zx8fQ2LmNp4RtVw"') == ["Zx8fQ2LmNp4RtVw"]
    name = "part_" * 40
    assert _found(f'{name} = "Zx8fQ2LmNp4RtVw"\ncredential = {name}') == ["Zx8fQ2LmNp4RtVw"]


def test_concatenations_of_any_length():
    parts = [f"Zx8fQ2LmNp4RtV{i:03}" for i in range(300)]
    assert _found("credential = " + " + ".join(f'"{p}"' for p in parts)) == parts
    assert _found("\n".join(["s = ''", *(f's = s + "{p}"' for p in parts), "credential = s"])) == parts
    assert _found("credential = " + " + ".join(f'"{c}"' for c in "Zx8fQ2LmNp4RtVw" * 20)) == list("Zx8fQ2LmNp4RtVw" * 20)


def test_repeated_doubling_and_long_runs_take_linear_time():
    begin = time.monotonic()
    assert _found('s = "Zx8fQ2LmNp4RtVw"\n' + "s = s + s\n" * 20_000 + "credential = s") == ["Zx8fQ2LmNp4RtVw"]
    assert _found("a" * 300_000 + "\n" + "b = " + "x" * 10 + '"' + "c" * 300_000) == []
    assert time.monotonic() - begin < 20


def test_constants_bound_after_their_use():
    assert _found('credential = k\nk = "Zx8fQ2LmNp4RtVw"') == ["Zx8fQ2LmNp4RtVw"]
    assert _found('credential = "" + a_\na_ = b_\nb_ = c_\nc_ = "Zx8fQ2LmNp4RtVw"') == ["Zx8fQ2LmNp4RtVw"]
    assert _found("credential = k\nk = k\n" * 3) == []
    chain = "\n".join(f"n{i} = n{i + 1}" for i in range(5000))
    assert _found(f'credential = n0\n{chain}\nn5000 = "Zx8fQ2LmNp4RtVw"') == ["Zx8fQ2LmNp4RtVw"]


def test_letters_of_names_are_ascii():
    for text in ("\u017fecret=abcdefgh1", "\u017fecret=abcdefgh1 token", "to\u212aen=abcdefgh1 secret"):
        assert [s for s in secrets.spans_of(text) if s[0] == "assign"] == []
    assert [s[0] for s in secrets.spans_of("SeCrEt=abcdefgh1")] == ["assign"]


# --- 5 personal data


@pytest.fixture(scope="module")
def model():
    return tagger.train(*pii.training_windows([]), 9, epochs=8, batch=64, rate=0.025)


def context(rng):
    return " ".join("".join(rng.choice(pii.LETTERS) for _ in range(rng.choice([1, 2, 3, 4, 6, 8]))) for _ in range(40))


def test_the_gate_changes_nothing(model):
    rng, texts = random.Random(5), ["", "a", "7", "x" * 79 + "1", "1 " * 500, "at " * 200, "(at) " * 90]
    for i in range(60):
        parts = [context(rng)[: rng.randint(0, 200)] for _ in range(3)]
        texts.append(parts[0] + " " + pii._rewritten(k := pii.KINDS[i % 4], pii._made(k, rng), rng) + " " + parts[1] + pii._nothing(rng) + parts[2])
    texts += ["".join(rng.choice("ab.@-+ 0123456789()") for _ in range(300)) for _ in range(20)]
    assert pii.tagged(texts, model) == pii.tagged(texts, model, whole=True)


def test_spans_on_held_out_texts(model):
    rng, hit, n, found, good = random.Random(77), Counter(), Counter(), Counter(), Counter()
    for i in range(600):
        kind = pii.KINDS[i % 5] if i % 5 < 4 else None
        left, right = context(rng), context(rng)
        entity = pii._rewritten(kind, pii._made(kind, rng), rng) if kind else pii._nothing(rng)
        a, b = len(left) + 1, len(left) + 1 + len(entity)
        spans = [(k.removeprefix("seq_"), x, y) for k, x, y in pii.spans_of([f"{left} {entity}, {right}"], model)[0]]
        if kind:
            n[kind] += 1
            hit[kind] += any(k == kind and abs(x - a) < 2 and abs(y - b) < 2 for k, x, y in spans)
        for k, x, y in spans:
            found[k] += 1
            good[k] += k == kind and x >= a - 1 and y <= b + 1
    assert all(hit[k] > 0.85 * n[k] and good[k] > 0.9 * found[k] for k in pii.KINDS), (hit, n, good, found)


def test_forms_beyond_the_base_patterns(model):
    rng = random.Random(6)
    around = [(context(rng), context(rng)) for _ in range(20)]
    for kind, form in [("email", "JOE.SMITH AT SITE DOT COM"), ("email", "jane.doe(at)site.org"), ("phone", "0049 555 123 4567"), ("card", "4111.1111.1111.1111"), ("card", "4111/1111/1111/1111"), ("ip", "10[.]1[.]2[.]3"), ("phone", "(555) 123-4567")]:
        found = pii.spans_of([f"{left} {form} {right}" for left, right in around], model)
        times = sum((f"seq_{kind}", len(left) + 1, len(left) + 1 + len(form)) in spans for (left, _), spans in zip(around, found))
        assert times > 10, (form, times)


def test_pii_of_nothing(spark, model):
    docs = frame(spark, [None, ""]).withColumn("spans", F.lit("clash"))
    assert [r.spans for r in pii.digest(docs, model).collect()] == ["", ""]
    assert pii.digest(docs.limit(0), model).count() == 0 and pii.found(docs, model).columns == docs.columns
    assert secrets.digest(docs.limit(0)).count() == 0 and [r.spans for r in secrets.digest(docs).collect()] == ["", ""]


# --- 6 chat


def test_long_conversations_are_decoded_as_one(spark):
    rng = random.Random(8)
    turns = []
    for c in range(6):
        for t in range(rng.choice([1, 5, 40, 300])):
            role = rng.choice(["user", "assistant"]) if t else "system"
            turns.append((c, t, role, "\n".join(" ".join(["word"] * rng.randint(1, 60)) + rng.choice([".", "?"]) for _ in range(rng.randint(1, 3)))))
    turns += [(None, t, "user" if t % 2 else "assistant", f"again {t}?") for t in range(30)]
    turns += [(7, t, "user", None) for t in range(20)] + [(8, 0, "user", "hi"), (8, 0, "user", "hi"), (8, None, "bot", "x"), (9, 12, "assistant", "late"), (9, 3, "user", " ")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    model = chat.parameters(chat.counts(chat.transcripts(df)))
    whole = {r.conv_id: r for r in chat.formatted(chat.transcripts(df, part=10**6), model).collect()}
    assert len(whole) == 10 and whole[7].rendered == "" and whole[7].roles_found == [] and whole[8].rendered.count("hi") == 2
    for part in (1, 7):
        by = {}
        for r in chat.formatted(chat.transcripts(df, part=part), model).orderBy("part").collect():
            by.setdefault(r.conv_id, []).append(r)
        for c, rows in by.items():
            assert "\n".join(r.rendered for r in rows if r.rendered) == whole[c].rendered
            assert [x for r in rows for x in r.roles_found] == whole[c].roles_found
    assert chat.formatted(chat.transcripts(df.limit(0)), model).count() == 0 and not chat.counts(chat.transcripts(df.limit(0))).any()


def test_borders_lie_on_the_best_path():
    rng = np.random.default_rng(3)
    start, step, emit = rng.normal(size=6), rng.normal(size=(6, 6)), rng.normal(size=(6, chat.WIDTH))
    for _ in range(20):
        x = np.stack([rng.integers(0, n, 30) for n in chat.SIZES], axis=1)
        cuts = [0, *sorted(rng.choice(np.arange(1, 30), 4, replace=False)), 30]
        ends = chat.borders([chat.across(x[a:b], start, step, emit) for a, b in zip(cuts, cuts[1:])])
        path = chat.viterbi(x, start, step, emit)
        assert ends == [path[b - 1] for b in cuts[1:]]
        parts = [chat.viterbi(x[a:b], start, step, emit, before, end) for a, b, before, end in zip(cuts, cuts[1:], [-1, *ends], ends)]
        assert (np.concatenate(parts) == path).all()
