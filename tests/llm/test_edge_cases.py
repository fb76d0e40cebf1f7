"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from splitmark.llm import chat, fingerprint, jaccard, langid, mixing, packing, quality, secrets, topk, toxicity

WORD = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
ROWS = [
    (1, WORD * 3, "en", "a", 0),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "   \n ", "de", "a", 0),
    (5, WORD * 9000, "en", "a", 0),
    (6, "x", "fr", None, 1),
    (6, "x", "fr", None, 1),
    (None, WORD * 3, None, "b", 0),
    (7, "der die das und ich nicht " * 20, "de", "a", 0),
    (8, "\U0001f600 ünï \x00 <|turn|> \\l AKIA" + "Z" * 16, "en", "a", 0),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, label int, part int, mix_words string, Key long, slot long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "n", 1, 2, "w", 9, 4) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 1, 0), (7, 0, 1), (8, 0, 1), (6, None, None), (None, 1, 1)], LABELS)


PACK = packing.PackParams(tokenizer=public_tokenizers.path("word_bpe_49k.json"))
QUERIES = {
    "op1": lambda d, l: fingerprint.op1_winnowing(d),
    "fingerprints": lambda d, l: fingerprint.fingerprints(d),
    "op2": lambda d, l: quality.op2_neighbour_quality(d, l),
    "op4": lambda d, l: toxicity.op4_conv_toxicity(d, l),
    "op5": lambda d, l: jaccard.near_duplicates(d),
    "op8": lambda d, l: langid.op8_compression_langid(d),
    "op9": lambda d, l: mixing.mix(d, mixing.domain_labels(l)),
    "op10": lambda d, l: secrets.op10_secret_scan(d),
    "find_secrets": lambda d, l: secrets.find_secrets(d),
}


@pytest.mark.parametrize("name", QUERIES)
def test_one_row_for_each_row(docs, labels, name):
    found = QUERIES[name](docs, labels)
    assert sorted(map(str, (r["doc_id"] for r in found.collect()))) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_give_empty_results(empty, labels, name):
    assert QUERIES[name](empty, labels.where("false")).count() == 0


@pytest.mark.parametrize("step", ["secrets", "toxicity", "jaccard", "mixing"])
def test_stages_keep_all_columns(docs, empty, labels, step):
    stage = {
        "secrets": secrets.remove_secrets,
        "toxicity": lambda d: toxicity.clean(d, toxicity.fit(d, labels)),
        "jaccard": jaccard.one_of_each,
        "mixing": lambda d: mixing.mixed(d, mixing.domain_labels(labels), mixing.MixParams(boosts={}, floor=1.0)),
    }[step]
    kept = stage(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    ids = {str(r["doc_id"]) for r in kept.collect()}
    assert ids <= {str(r[0]) for r in ROWS}
    if step in ("secrets", "mixing"):
        assert kept.count() == len(ROWS)
    assert stage(empty).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, PACK).collect()
    assert sorted({str(r["doc_id"]) for r in rows}) == sorted({str(r[0]) for r in ROWS})
    assert [r["doc_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    assert len([r for r in rows if r["doc_id"] == 6]) == 2
    assert packing.pack(empty, PACK).count() == 0


def test_search(spark):
    vectors = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (20, [0.25]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (40, [])]
    table = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, c int")
    rows = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table, topk.SearchParams(k=2)).collect())
    assert rows == [(0, 1, 1, 64 * 64 + 32 * 32), (0, 2, 2, 64 * 64 + 32 * 32), (20, 1, 0, 16 * 64), (20, 2, 1, 16 * 64), (40, 1, 0, 0), (40, 2, 1, 0)]
    assert topk.top_k(table.where("false")).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(1, 2, "user", None, "x"), (1, 1, None, "a<|end|>\\l\\", "x"), (1, None, "assistant", "first", "x"), (None, 1, "assistant", "b", "x"), (2, 1, "assistant", "t", "x"), (2, 1, "assistant", "t", "x")]
    found = {r["conv_id"]: r for r in chat.op6_typed_parts(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r["n_turns"] for k, r in found.items()} == {1: 3, None: 1, 2: 2, -7: 2}
    assert {k: r["loss_chars"] for k, r in found.items()} == {1: 5, None: 1, 2: 2, -7: 26}
    assert chat.op6_typed_parts(spark.createDataFrame([], schema)).count() == 1


def test_language_of_texts_without_letters(docs):
    rows = {r["doc_id"]: r for r in langid.op8_compression_langid(docs).collect()}
    assert {rows[i]["lang_pred"] for i in (2, 3, 4)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_texts_without_words_are_linked_to_nothing(docs):
    rows = {r["doc_id"]: r for r in jaccard.near_duplicates(docs).collect()}
    assert all(rows[i]["n_links"] == 0 and rows[i]["class_id"] == i for i in (2, 3, 4))
    assert rows[1]["n_links"] == 2  # the row without an id, and the long text of the same words
    assert rows[5]["class_id"] == 1
    assert rows[6]["n_copies"] == 2
    assert docs.select(F.col("node")).first()["node"] == "n"
