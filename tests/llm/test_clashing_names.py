"""Columns that differ from a result's name in case only give way to it, and working names are nobody's."""

import pytest
from pyspark.sql import functions as F

from helixar.llm import decontam, minhash, quality, simhash

TEXT = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, "en"), (2, TEXT, "en"), (3, None, None), (4, "", "de"), (None, TEXT + " x", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = ["Kept", "COUNTS", "Base_Failed", "N_Words", "Items", "SPANS", "n_HIT", "Root", "Component_ID", "Fingerprint", "_fp", "_NODE", "_Hot", "_salt", "c0", "fp", "_h1", "_Bands", "node"]
    return df.withColumns({x: F.lit("own") for x in names})


def own(df, but):
    return {c for c in df.columns if c.lower() not in but}


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.assess(docs, labels)
    assert set(out.columns) == own(docs, quality.MADE) | set(quality.MADE) and out.count() == 5
    renamed = docs.withColumnRenamed("doc_id", "key")
    assert quality.assess(renamed, labels.withColumnRenamed("doc_id", "key"), carry=["key", "Kept"], id_col="key").columns == ["key", *quality.MADE]


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([("a", TEXT)], "item_id string, text string")
    for block_words in (500_000, 5):
        out = decontam.find_contamination(docs, bench, carry=docs.columns, block_words=block_words)
        assert set(out.columns) == own(docs, decontam.MADE) | set(decontam.MADE)
        assert sorted((r.doc_id or 0, r.n_hit) for r in out.collect()) == [(0, 12), (1, 12), (2, 12), (3, 0), (4, 0)]


@pytest.mark.parametrize(("find", "made"), [(simhash.near_duplicates, ("fingerprint", "component_id", "root")), (minhash.near_duplicates, ("component_id", "root"))])
def test_near_duplicates(spark, docs, find, made):
    out = find(docs, carry=docs.columns)
    assert set(out.columns) == own(docs, made) | set(made)
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert got[1] == got[2] == 1 and got[3] == got[4] == 3 and all(r._fp == "own" and r.c0 == "own" for r in out.collect())


def test_copies_are_kept_with_any_names(docs):
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns and out.filter("doc_id IN (1, 2)").count() == 1 and out.filter("doc_id IN (3, 4)").count() == 1
