from __future__ import annotations

import random

import brute
import pytest
from llm_fixtures import docs, prose, texts  # noqa: F401

import corpus_pipeline
from quern.llm import personal_data, quality_rules, simhash_dedup
from quern.storage import written


@pytest.fixture
def small_training(monkeypatch):
    monkeypatch.setattr(personal_data, "trained", lambda docs: personal_data.Tagger())


def body(k):
    draw = random.Random(k)
    return " ".join(draw.choice(["the", "of", "and", "in"]) if draw.random() < 0.3 else word for word in prose(k, 120).split())


def test_stages_keep_columns_and_take_effect(spark, tmp_path, small_training):
    bodies = [body(k) for k in range(6)]
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(k, b, "en", "s", 0) for k, b in enumerate(bodies)]
    rows += [(10, bodies[0], "en", "s", 0), (11, bodies[1] + " " + passage, "en", "s", 0), (12, "too short", "en", "s", 0), (13, None, None, None, None)]
    rows += [(14, body(14) + " joe@mail.example.com", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packed":
            assert docs.columns == columns
        if name == "private":
            last = {r.doc_id: r for r in docs.collect()}
    assert 12 not in ids["quality"] and 13 not in ids["quality"] and 0 in ids["quality"]
    assert 10 not in ids["near_duplicates"] and 0 in ids["near_duplicates"]
    assert 11 not in ids["benchmark"]
    assert "[EMAIL]" in last[14].text and last[14].n_chars == len(last[14].text)
    assert ids["packed"] == ids["private"]


def plain_survivors(rows):
    """Smallest id of each group of fingerprints at two bits or fewer, over all pairs."""
    groups = brute.components({i: brute.fingerprint(t) for i, t in rows.items()})
    return {i for i, root in groups.items() if i == root}


def test_near_copies_go(spark):
    """Groups of texts with a few replaced words, against all pairs by plain fingerprints."""
    draw, texts = random.Random(4), {}
    for group in range(30):
        words = prose(1000 + group, 300).split()
        for _ in range(4):
            copy = list(words)
            for at in draw.sample(range(300), draw.choice([0, 1, 2])):
                copy[at] = f"edit{draw.random()}"
            texts[len(texts)] = " ".join(copy)
    texts |= {500: "", 501: None, 502: "two words", 503: "two  words"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in simhash_dedup.one_of_each_group(docs).collect()}
    assert kept == plain_survivors(texts) and len(kept) < 100


CLASHES = "kept, component_id, quality_text, vote_pattern_good, row, votes, failed, mark, quality, fingerprint, piece, bin, own_fingerprint"


def test_stages_with_clashing_columns_null_ids_and_repeats(spark, tmp_path, small_training):
    text = body(9)
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("doc_id", *(f"doc_id as {c}" for c in CLASHES.split(", ")), "text", "1L as n_chars")
    spark.createDataFrame([(1, "no such passage here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table, n in ((docs, 1), (docs.where("false"), 0)):
        columns = table.columns
        for name, stage in corpus_pipeline.STAGES:
            table = written(stage(spark, table, str(tmp_path)), name)
            if name != "packed":
                assert table.columns == columns
            if name == "quality":
                assert table.count() == 3 * n
            if name == "near_duplicates":
                assert [r.doc_id for r in table.collect()] == [1] * n


def test_quality_stage_agrees_with_the_operator(spark, docs):
    rows = [(i, " ".join([prose(i, 60)] * (1 + i % 2)) + " the of and") for i in range(40)] + [(40, None), (41, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = {r.doc_id for r in quality_rules.quality_counts(table).where("kept").collect()}
    assert {r.doc_id for r in quality_rules.kept_documents(table).collect()} == wanted
