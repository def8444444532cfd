"""Stages with columns that bear the operators' own internal names, and with odd rows."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from turnweave.llm import decontam, near_dedup, pii, toxicity

NAMES = "_id _key _text_key class_key _row _new _names _mentions mentions mention _deal _dirty_id _dirty_key _mix_key _mix_source n_replaced key no bucket root size target taken copies caller_3 labels half score x".split()
ROWS = [
    (1, "Mr John Smith wrote a long letter about the sea and the hills beyond it today", "a"),
    (2, "Mr John Smith wrote a long letter about the sea and the hills beyond it today", None),
    (2, "Mr John Smith wrote a long letter about the sea and the hills beyond it today", None),
    (None, "another text of some words without a person or a number in it", "a"),
    (3, None, "b"), (4, "", "b"), (4, "", "b"), (5, "w " * 20_000, "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    return plain.select("*", *(F.lit(f"own {c}").alias(c) for c in NAMES))


def test_stages_keep_columns_of_any_name(spark, sf_dir, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"own {c}" for c in NAMES), name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert out and all(r[c] == f"own {c}" for r in out for c in NAMES if c not in ("size", "target", "taken", "copies"))


def test_odd_rows_through_stages(docs):
    assert sorted(((r.doc_id or 0), r.text is None) for r in near_dedup.kept(docs).collect()) == [(0, False), (1, False), (3, True), (4, False), (5, False)]
    out = pii.surrogates(docs)
    assert out.columns == [*docs.columns, "n_replaced_"] and out.count() == len(ROWS)
    assert out.agg(F.sum("n_replaced_")).first()[0] == 3
    assert decontam.clean(docs, docs.select(F.lit(1).alias("item_id"), F.lit("sea and the hills").alias("text")).limit(1)).count() == len(ROWS) - 3


def replaced(spark, *texts):
    rows = list(enumerate(texts))
    return [r.text for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]


def test_whole_names_go(spark):
    long, short, same, plus, space = replaced(
        spark,
        "Mr Anna Bella Carla Dora Emma Fritz",
        "Mr Bo Xi met Mr Wu Li. Later Xi and Li saw Wu.",
        "Dr Jane Smith came. Ms Jane Smith left.",
        "call +13755554393", "call +1 3755554393",
    )
    assert not set("Anna Bella Carla Dora Emma Fritz".split()) & set(long.split())
    words = set(short.replace(".", "").split())
    assert not words & {"Bo", "Xi", "Wu", "Li"} and len(short.split()) == 13
    a, b = same.split(" came. Ms ")
    assert a.removeprefix("Dr ") == b.removesuffix(" left.") and "Jane" not in same
    assert plus.startswith("call +1") and plus.removeprefix("call +1") == space.removeprefix("call +1 ")


def test_spaced_runs_are_read_whole():
    word = "antidisestablishmentarianistically"
    grams = toxicity.Counter()
    for w, n in ((word, 50), ("idiot", 50), ("other", 20)):
        g = f"\n\n{w}\n"
        grams.update({g[i : i + 3]: n for i in range(len(g) - 2)})
    restorer = toxicity.Restorer(toxicity.Letters(grams))
    assert word in restorer.words(" ".join(word))
    assert "idiot" in restorer.words("1d i0 7")
    assert "idiot" in restorer.words("i, d. i- 0_ t")
