"""Graph filter, spanning forests and context order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, ngrams, truncate_words
from ..session import written
from . import graph, walk
from .expand import ranked

MAX_CHUNKS = 15
CONTEXT_WORDS = 2048
#: Similarity from which a word of the question names an entity, and what two such entities add to an edge.
MATCH, BOOST = 0.9, 2.0


def _net(chunks: DataFrame, mentions: DataFrame, triples: DataFrame) -> walk.Graph:
    return walk.prepare(mentions, graph.undirected(triples), chunks)


def query_entities(nodes: DataFrame, queries: DataFrame, threshold: float = MATCH) -> DataFrame:
    """(query_id, entity) of nodes whose name matches a word of the query or stands in it.
    ``queries``: (query_id, question). Only a query's own nodes are compared."""
    words = F.transform(F.split(F.lower("question"), r"\s+"), lambda w: ngrams(w))
    both = nodes.join(queries.select("query_id", F.lower("question").alias("question"), words.alias("words")), "query_id")
    like = F.transform(F.array(ngrams(F.col("entity"))), lambda g: F.exists("words", lambda w: jaccard(g, w) >= threshold))[0]
    return both.filter(F.contains("question", F.lower("entity")) | like).select("query_id", "entity")


def graph_filter(chunks: DataFrame, mentions: DataFrame, triples: DataFrame, queries: DataFrame, k: int = MAX_CHUNKS) -> DataFrame:
    """Chunks with an entity, at most ``k``; queries with fewer than two entities or no edge,
    a pair of query entities being one (Q2), keep their first ``k`` chunks."""
    return ranked(walk.filtered(chunks, _net(chunks, mentions, triples), queries, MATCH), k)


def edge_weights(chunks: DataFrame, mentions: DataFrame, triples: DataFrame, entity_scores: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, a, b, weight): the sum of both ends' scores, 1 where there are no scores; each two
    entities that the query names have ``BOOST`` more, or an edge of that weight."""
    inside = written(walk.inside(chunks, _net(chunks, mentions, triples)))
    if entity_scores is None:
        weighed = inside.withColumn("weight", F.lit(1.0))
    else:
        score = entity_scores.select("query_id", "entity", "score")
        a, b = score.toDF("query_id", "a", "sa"), score.toDF("query_id", "b", "sb")
        joined = inside.join(a, ["query_id", "a"], "left").join(b, ["query_id", "b"], "left")
        weighed = joined.select("query_id", "a", "b", (F.coalesce("sa", F.lit(0.0)) + F.coalesce("sb", F.lit(0.0))).alias("weight"))
    if queries is None:
        return weighed
    nodes = chunks.join(mentions, "chunk_id").select("query_id", "entity").distinct()
    named = written(query_entities(nodes, queries))  # of one query's few names
    both = named.toDF("query_id", "a").join(named.toDF("query_id", "b"), "query_id").filter("a < b").withColumn("boost", F.lit(BOOST))
    out = weighed.join(both, ["query_id", "a", "b"], "full")
    return out.select("query_id", "a", "b", (F.coalesce("weight", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("weight"))


def _kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for row in edges.sort_values(["weight", "a", "b"], ascending=[False, True, True]).itertuples():
        a, b = root(row.a), root(row.b)
        if a != b:
            parent[a] = b
            keep.append(row.Index)
    return edges.loc[keep]


def expanded_weights(seeds: DataFrame, mentions: DataFrame, triples: DataFrame, queries: DataFrame, k: int, only_forest: bool = False, hops: int = 2, decay: float = 0.5) -> DataFrame:
    """R15 (or R16) over the ``k`` best chunks of the expansion of ``seeds`` and its entity scores, without writing either."""
    return walk.weights(seeds, _net(seeds, mentions, triples), queries, hops, decay, k, MATCH, BOOST, only_forest)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Maximum spanning forest of each query's graph, which its chunk limit keeps small."""
    return edges.groupBy("query_id").applyInPandas(_kruskal, edges.schema)


def dfs_order(chunks: DataFrame, mentions: DataFrame, triples: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, place): preorder over the query's entities from the first
    entity of the best chunk, neighbours by name; chunks that are not reached come last."""
    return walk.preorder(chunks, _net(chunks, mentions, triples))


def expanded_order(seeds: DataFrame, mentions: DataFrame, triples: DataFrame, k: int, hops: int = 2, decay: float = 0.5) -> DataFrame:
    """R17 over the ``k`` best chunks of the expansion of ``seeds``, without writing these."""
    return walk.expanded_preorder(seeds, _net(seeds, mentions, triples), hops, decay, k)


def organize(ordered: DataFrame, texts: DataFrame, words: int = CONTEXT_WORDS) -> DataFrame:
    """One context for each query; ids without a text are left out."""
    joined = ordered.join(texts, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    return joined.select("query_id", truncate_words(text, words).alias("context"))
