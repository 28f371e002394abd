"""Answers and forests are for every prediction, not for a hundredth of them."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import expand, filtering, generation, graph, walk
from sparkloom.plans import catalogue
from sparkloom.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def asked(spark):
    """Seeds and questions of every prediction, graph and texts, by plain DataFrame code."""
    p = spark.read.parquet(f"{DATA}/predictions.parquet").withColumnRenamed("pred_id", "query_id")
    seeds = p.select("query_id", F.posexplode("retrieved_chunk_ids").alias("pos", "chunk_id")).select("query_id", "chunk_id", (1.0 / (F.col("pos") + 1)).alias("score"))
    triples = graph.clean_triples(spark.read.parquet(f"{DATA}/triples.parquet"))
    return seeds, p.select("query_id", F.coalesce("question", F.lit("")).alias("question")), triples, graph.mentions(triples), graph.undirected(triples)


def by_joins(seeds, mentions, edges):
    return expand.bfs(seeds, mentions, edges, adjust=lambda step, chunks: step)


def test_f1_every_question_is_answered(spark):
    got = {r.query_id: r.answer for r in QUERIES["generated_answers"](spark, DATA).collect()}
    assert set(got) == {x for x, in duckdb.sql(f"select pred_id from '{DATA}/predictions.parquet'").fetchall()}
    seeds, questions, triples, mentions, edges = asked(spark)
    best = expand.ranked(by_joins(seeds, mentions, edges)[0], 5).drop("rank")
    contexts = filtering.organize(filtering.dfs_order(best, mentions, triples), catalogue._texts(spark, DATA))
    want = generation.generate(questions.join(contexts, "query_id", "left")).collect()
    assert got == {r.query_id: r.answer for r in want} and len({*got.values()}) > 20


def test_f2_every_question_has_its_forest(spark):
    seeds, questions, triples, mentions, edges = asked(spark)
    chunks, entities = by_joins(seeds, mentions, edges)
    weights = filtering.edge_weights(expand.ranked(chunks, expand.MAX_CHUNKS).drop("rank"), mentions, triples, entities, questions)
    forest = filtering.spanning_forest(weights.withColumn("weight", F.round("weight", 9)))
    want = {r.query_id: (r.n, round(r.w, 5)) for r in forest.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    got = {r.query_id: (r.n_edges, round(r.weight, 5)) for r in QUERIES["spanning_forest"](spark, DATA).collect()}
    assert got == want and len(got) > 50


def test_f2_forest_of_many_links_is_the_one_of_few(monkeypatch):
    rnd = np.random.default_rng(3)
    a, b = (x.ravel() for x in np.triu_indices(90, 1))
    some = rnd.random(len(a)) < 0.5
    a, b, weight = a[some], b[some], rnd.integers(1, 4, some.sum()) / 4
    assert len(a) > walk.KEPT
    many = walk.forest(a, b, weight, 95)
    monkeypatch.setattr(walk, "KEPT", len(a))
    assert many.tolist() == walk.forest(a, b, weight, 95).tolist() and len(many) == 89
