"""Graph expansion, plain and group-balanced."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written, written_all
from . import walk
from .joins import hot_keys, salted_join

MAX_CHUNKS = 20
#: What the weight of over-represented groups is multiplied by; the others' is divided by it.
BALANCE = 0.8
#: Most that one group may have of what the constraint takes.
RATIO = 0.7
Adjust = Callable[[DataFrame, DataFrame], DataFrame]


def bfs(
    seeds: DataFrame, mentions: DataFrame, edges: DataFrame, max_hops: int = 2, decay: float = 0.5, adjust: Adjust | None = None, keep: bool = False,
    top: int | None = None, most: float = 1.0, places: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, score), (query_id, entity, score, hop).

    An entity is scored at its first hop only, by its best parent; decay compounds over the hops (Q1). Every query
    walks over arrays in one task (``walk``). ``top``: only the best chunks of a query are wanted. ``places``: entity scores are
    rounded there.

    ``adjust`` is what ``balance`` gives, or a scorer of one's own: it gets (query_id, entity, score) of a hop and
    (query_id, chunk_id, score) so far and returns the former with other scores, at most ``most`` times as
    high. For the latter the hops are joins: what a hop found is written once (the last one only if ``keep``: for callers of
    both results), hubs, of edges as of mentions, are split over several tasks, and the best score is taken
    within each task first.
    """
    if adjust is None or isinstance(adjust, Balance):
        factor, tags, attributes = (None, None, ()) if adjust is None else (adjust.factor, adjust.tags, adjust.attributes)
        net = walk.prepare(mentions, edges, seeds, tags, attributes)
        return walk.chunk_scores(seeds, net, max_hops, decay, factor, top), walk.entity_scores(seeds, net, max_hops, decay, factor, places)
    edges, mentions = written_all(edges, mentions)
    hubs, told = written_all(hot_keys(edges, "a").withColumnRenamed("a", "entity"), hot_keys(mentions, "entity"))
    out = edges.withColumnRenamed("a", "entity")
    known = seeds.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    frontier = written(known.join(mentions, "chunk_id").groupBy("query_id", "entity").agg(F.max("score").alias("score")))
    visited = frontier.withColumn("hop", F.lit(0))
    chunks = known
    for hop in range(max_hops):
        last = hop == max_hops - 1
        step = (
            salted_join(frontier, out, "entity", "b", hubs)
            .groupBy("query_id", F.col("b").alias("entity"))
            .agg((F.max("score") * F.lit(decay ** (hop + 1))).alias("score"))
            .join(visited.select("query_id", "entity"), ["query_id", "entity"], "left_anti")
        )
        step = adjust(written(step), chunks)
        frontier = step if last and not keep else written(step)
        visited = visited.unionByName(frontier.withColumn("hop", F.lit(hop + 1)))
        found = salted_join(frontier, mentions, "entity", "chunk_id", told).select("query_id", "chunk_id", "score")
        chunks = chunks.unionByName(found).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
        chunks = chunks if last and not keep else written(chunks)
    return chunks, visited if places is None else visited.withColumn("score", F.round("score", places))


def ranked(chunks: DataFrame, k: int | None = None) -> DataFrame:
    """Rank by score, ties by id; at most ``k``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    out = chunks.withColumn("rank", rank)
    return out if k is None else out.filter(F.col("rank") <= k)


def expand(seeds: DataFrame, mentions: DataFrame, edges: DataFrame, k: int = MAX_CHUNKS, **how: object) -> DataFrame:
    """The best ``k`` chunks of each query."""
    return ranked(bfs(seeds, mentions, edges, top=k, **how)[0], k)


def fair_expand(seeds: DataFrame, mentions: DataFrame, edges: DataFrame, tags: DataFrame, strategy: str = "in_traversal", k: int = MAX_CHUNKS, **how: object) -> DataFrame:
    """Expansion by the named strategy: ``post_hoc``, ``in_traversal`` or ``constraint``."""
    if strategy not in ("post_hoc", "in_traversal", "constraint"):
        raise ValueError(f"unknown fairness strategy: {strategy}")
    attributes = ("gender", "geo_group")
    net = walk.prepare(mentions, edges, seeds, tags, attributes)
    hops, decay = how.get("max_hops", 2), how.get("decay", 0.5)
    if strategy == "in_traversal":
        return ranked(walk.chunk_scores(seeds, net, hops, decay, BALANCE, k, 9), k)
    pick = ("post_hoc", "gender", k) if strategy == "post_hoc" else ("constrained", attributes, RATIO, k)
    return ranked(walk.chunk_scores(seeds, net, hops, decay, pick=pick))


def post_hoc(chunks: DataFrame, tags: DataFrame, attribute: str = "gender", k: int = MAX_CHUNKS) -> DataFrame:
    """Equal quotas for the groups in order of first appearance, what is left over to the
    first ones. A tagged chunk without a value is a group of its own beside 'unknown'. No
    backfill."""
    joined = ranked(chunks).join(tags.select("chunk_id", F.col(attribute).alias("value"), F.lit(True).alias("tagged")), "chunk_id", "left")
    group = F.when(F.col("tagged").isNull(), "v:unknown").when(F.col("value").isNull(), "null").otherwise(F.concat(F.lit("v:"), F.col("value")))
    grouped = joined.withColumn("grp", group)
    first = grouped.groupBy("query_id", "grp").agg(F.min("rank").alias("first"))
    by_query = Window.partitionBy("query_id")
    order = first.select(
        "query_id", "grp", (F.row_number().over(by_query.orderBy("first")) - 1).alias("nth"), F.count("*").over(by_query).alias("n")
    )
    quota = F.expr(f"{k} div n + if(nth < {k} % n, 1, 0)")
    place = F.row_number().over(Window.partitionBy("query_id", "grp").orderBy("rank"))
    chosen = grouped.withColumn("place", place).join(order, ["query_id", "grp"]).filter(F.col("place") <= quota)
    return ranked(chosen.select("query_id", "chunk_id", "score"))


class Balance:
    """The weight of an entity is the mean, over its chunks and attributes, of ``factor``
    for groups above their even share so far and of its reciprocal for the others. Each chunk
    found so far counts once."""

    def __init__(self, tags: DataFrame, mentions: DataFrame, attributes: tuple[str, ...] = ("gender", "geo_group"), factor: float = BALANCE) -> None:
        self.tags, self.mentions, self.attributes, self.factor = tags, mentions, attributes, factor


balance = Balance


def constrained(chunks: DataFrame, tags: DataFrame, attributes: tuple[str, ...] = ("gender", "geo_group"), ratio: float = RATIO, k: int = MAX_CHUNKS) -> DataFrame:
    """A scan in rank order that takes a chunk unless one of its groups would exceed
    ``ratio`` of what is taken; so a tagged chunk cannot come first (Q6).

    How far the scan may go is not bounded by k, so a query's chunks stream through one task in
    rank order; what is held is the counts of the at most ``k`` taken ones.
    """
    listed = ranked(chunks).join(tags.select("chunk_id", *attributes), "chunk_id", "left").select("query_id", "rank", "chunk_id", "score", *attributes)
    ordered = listed.repartition("query_id").sortWithinPartitions("query_id", "rank")
    kind = dict(chunks.dtypes)["query_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, size, counts = None, 0, Counter()
        for batch in batches:
            ids, groups = batch.column("query_id").to_pylist(), list(zip(*(batch.column(a).to_pylist() for a in attributes)))
            kept = []
            for i, q in enumerate(ids):
                if q != query:
                    query, size, counts = q, 0, Counter()
                if size >= k:
                    continue
                own = [(a, g) for a, g in zip(attributes, groups[i]) if g is not None]
                if all((counts[x] + 1) / (size + 1) <= ratio for x in own):
                    counts.update(own)
                    size += 1
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64())).select(["query_id", "chunk_id", "score"])

    return ranked(ordered.mapInArrow(scan, f"query_id {kind}, chunk_id string, score double"))
