"""The pipeline's stages, each on what the one before it kept."""

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from splitmark.llm import jaccard, secrets

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]


def test_stages_return_documents(steps):
    for docs in steps[1:-1]:
        assert docs.columns == steps[0].columns


def test_toxicity_keeps_what_is_not_labelled_toxic(steps):
    kept = {r["doc_id"] for r in steps[1].select("doc_id").collect()}
    marks = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SMALL}/labels.parquet'").fetchall())
    toxic, clean = [i for i, t in marks.items() if t], [i for i, t in marks.items() if not t]
    assert sum(i in kept for i in clean) > 0.95 * len(clean)
    assert sum(i in kept for i in toxic) < 0.3 * len(toxic)


def test_one_of_each_group_stays(steps):
    rows = jaccard.near_duplicates(steps[1]).collect()
    assert {r["doc_id"] for r in steps[2].select("doc_id").collect()} == {r["class_id"] for r in rows}
    assert all(r["n_links"] == 0 for r in jaccard.near_duplicates(steps[2]).collect())


def test_secrets_are_gone_and_nothing_else(steps):
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    after = {r["doc_id"]: r for r in steps[3].collect()}
    assert before.keys() == after.keys()
    for i, row in after.items():
        assert secrets.spans_of(row["text"]) == []
        assert row["n_chars"] == len(row["text"])
        assert secrets.spans_of(before[i]) or row["text"] == before[i]


def test_mixing_keeps_every_document(steps):
    before, after = ([r["doc_id"] for r in s.select("doc_id").collect()] for s in steps[3:5])
    assert set(before) == set(after)
    assert len(after) > len(before)


def test_packing_holds_every_document(steps):
    rows = steps[5].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in steps[4].select("doc_id").collect()}
    assert max(r["offset"] + r["length"] for r in rows) <= 4096
    assert public_tokenizers.path("word_bpe_49k.json")


def test_the_whole_run_gives_the_last_stage(spark, steps):
    rows = lambda df: sorted(map(str, df.drop("sequence_id", "offset").collect()))
    made = corpus_pipeline.run(spark, SMALL)
    assert made.columns == steps[5].columns
    assert rows(made) == rows(steps[5])
