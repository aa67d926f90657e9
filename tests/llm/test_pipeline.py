"""Every stage of the pipeline and the whole of it, with nulls, repeats, ties and clashing columns."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

VOCAB = [f"word{i}" for i in range(500)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(4), str(tmp_path_factory.mktemp("sf"))
    some = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    item, block = some(30), "\n".join(some(6) for _ in range(4))
    rows = [(i, some(60), "en" if i % 2 else None, f"s{i % 3}", 1) for i in range(40)]
    rows += [(40 + i, t, "en", None, 1) for i, t in enumerate([None, "", "short text", rows[3][1], rows[3][1] + " more", f"{some(20)} {item} {some(9)}", f"{block}\n{some(20)}", f"{some(20)}\n{block}", some(9000)])]
    rows += [rows[5], (None, some(50), "de", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_stages_keep_columns_and_do_their_work(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    out = {name: stage(spark, docs, path) for name, stage in pipeline.STAGES[:-1]}
    assert all(df.columns == docs.columns for df in out.values())
    everything = Counter(r[0] for r in rows)
    assert ids(out["quality_rules"]) == everything - Counter([40, 41, 42])
    assert ids(out["line_dedup"]) == everything
    assert {r.doc_id for r in out["line_dedup"].collect() if (r.doc_id, r.text) not in {x[:2] for x in rows}} == {47}
    assert ids(out["near_dedup"]) == everything - Counter([43, 44, 5])
    assert ids(out["decontamination"]) == everything - Counter([45])
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0


def test_run_packs_what_the_stages_leave(spark, folder):
    path, rows = folder
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {i: t for i, t, *_ in rows if i not in (40, 41, 42, 43, 44, 45)}
    texts[47] = texts[47].split("\n")[0]
    want = Counter({i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()})
    got = Counter()
    for r in pipeline.run(spark, path).collect():
        got[r.doc_id] += r.length
    assert got == want
