"""The five stages on a small corpus, each against what it should do."""

import re

import pytest

import corpus_pipeline as C
from tilewright.llm import toxicity
from tilewright.llm.common import written

from .test_jaccard import brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for i in range(240):
        words = [f"w{(i * 31 + k * k * 7) % 977}" for k in range(20 + i % 60)]
        if i % 6 == 0:
            words[5] = "idiot"
        if i % 7 == 1:
            words[3] = f"user{i}@mail.example.com"
        rows.append((i, " ".join(words), "en", f"s{i % 4}"))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(300 + k, rows[k + 1][1], "en", "s0") for k in range(0, 4)]
    rows += [(400, None, "en", None), (401, "", None, "s1"), (402, "x y z " * 5000, "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, corpus), f"test-{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {r.doc_id for r in kept["toxicity"]}
    assert clean == {i for i, r in before.items() if "idiot" not in (r.text or "")}
    assert {400, 401, 402} <= clean
    want = brute([(r.doc_id, r.text) for r in kept["toxicity"]])
    assert {r.doc_id for r in kept["near_duplicates"]} == {c for _, c in want.values()}
    for r in kept["pii"]:
        assert "@" not in (r.text or "") and r.n_chars == (None if r.text is None else len(r.text))
    assert any("[email]" in (r.text or "") for r in kept["pii"])
    ids = {r.doc_id for r in kept["pii"]}
    assert {r.doc_id for r in kept["mixing"]} <= ids
    assert sum(1 for _ in kept["packing"]) >= len(kept["mixing"])
    tokens = sum(r.doc_tokens for r in kept["packing"] if r.start == 0)
    assert tokens == sum(r.length for r in kept["packing"])


def test_run_gives_the_last_stage(spark, corpus):
    assert C.run(spark, corpus).columns[:3] == ["doc_id", "start", "length"]


def test_stages_of_no_rows_and_odd_rows(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    none = docs.where("doc_id < 0")
    for name, stage in C.STAGES:
        assert stage(spark, none, corpus).count() == 0
    some, empty = docs.where("doc_id in (1, 2)"), docs.where("doc_id in (400, 401)")
    odd = some.unionAll(some).withColumn("doc_id", some.doc_id * None).unionAll(empty).unionAll(empty)
    want = {"toxicity": 8, "near_duplicates": 6, "pii": 8, "packing": 8}
    for name, stage in C.STAGES:
        out = stage(spark, odd, corpus)
        if name in want:
            assert out.count() == want[name], name
        else:
            assert out.where("text is null or text = ''").count() == 4


def test_an_id_with_two_texts_keeps_both(spark, corpus):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (1, "one two three four five six"), (2, "One two three four five six"), (None, "seven eight nine ten eleven twelve")]
    kept = C.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), corpus).collect()
    assert sorted(map(tuple, kept)) == [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve")]


NAMES = ["_toxicity", "toxicity", "score", "_id", "_pii_text", "_pii_key", "_mix_taken", "_mix_id", "row", "key", "id", "h", "part", "copy", "whole", "size", "taken", "time", "found", "component", "vid", "hi", "lo", "made", "email", "pieces", "a.b", "row.text", "a`b", "`"]


def test_columns_of_any_name_are_kept(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id < 40")
    wide = docs.selectExpr("*", *(f"doc_id * 100 + {k} as `{n.replace('`', '``')}`" for k, n in enumerate(NAMES)))
    for name, stage in C.STAGES:
        out = stage(spark, wide, corpus)
        if name == "packing":
            assert out.count() > 0
            continue
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[n] == r.doc_id * 100 + k for r in rows for k, n in enumerate(NAMES))


def test_near_duplicates_with_two_changed_words(spark, corpus):
    words = [f"w{k}" for k in range(100)]
    near = ["other" if k in (30, 70) else w for k, w in enumerate(words)]
    far = ["other" if k % 20 == 10 else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r.doc_id for r in C.drop_near_duplicates(spark, docs, corpus).collect()} == {1, 3}
