"""The entity graph as edge lists (P4, P10, KG1-KG14, A16-A18, J4-J9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE
from .joins import hot_join


def stripped(c: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"\A{SPACE}|{SPACE}\z", "")


def clean_triples(triples: DataFrame) -> DataFrame:
    """Trimmed fields, none empty, no self-loops in lower case."""
    out = triples
    for c in ("subject", "relation", "obj"):
        out = out.withColumn(c, stripped(c))
    out = out.withColumn("source_chunk_id", F.coalesce("source_chunk_id", F.lit("")))
    return out.filter("subject <> '' and relation <> '' and obj <> '' and lower(subject) <> lower(obj)")


def evidence_triples(records: DataFrame) -> DataFrame:
    """P4 over records: (question_id, ord, subject, relation, obj) of evidences of three fields."""
    flat = records.select(F.col("_id").alias("question_id"), F.posexplode("evidences").alias("ord", "e")).filter(F.size("e") >= 3)
    return clean_triples(
        flat.select("question_id", "ord", F.col("e")[0].alias("subject"), F.col("e")[1].alias("relation"), F.col("e")[2].alias("obj"), F.lit("").alias("source_chunk_id"))
    ).drop("source_chunk_id")


def linked_triples(evidence: DataFrame, question_chunks: DataFrame) -> DataFrame:
    """Every evidence triple with every chunk of its question, '' where there is none."""
    joined = evidence.join(question_chunks.select("question_id", "chunk_id"), "question_id", "left")
    return joined.select("question_id", "ord", "subject", "relation", "obj", F.coalesce("chunk_id", F.lit("")).alias("source_chunk_id"))


def related(triples: DataFrame) -> DataFrame:
    """KG1/KG8: one edge for each triple."""
    return triples.select("subject", "relation", "obj", "source_chunk_id", "confidence")


def mentions(triples: DataFrame) -> DataFrame:
    """KG1: distinct (chunk_id, entity)."""
    ends = triples.filter("source_chunk_id <> ''").select("source_chunk_id", F.explode(F.array("subject", "obj")).alias("entity"))
    return ends.select(F.col("source_chunk_id").alias("chunk_id"), "entity").distinct()


def entities(triples: DataFrame) -> DataFrame:
    """KG1: distinct node names."""
    return triples.select(F.explode(F.array("subject", "obj")).alias("entity")).distinct()


def undirected(triples: DataFrame) -> DataFrame:
    """Distinct (a, b) in both directions."""
    ends = F.array(F.struct(F.col("subject").alias("a"), F.col("obj").alias("b")), F.struct(F.col("obj").alias("a"), F.col("subject").alias("b")))
    return triples.select(F.explode(ends).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()


def neighbors(starts: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """KG2/KG3: (start, neighbor) within ``hops``, the start left out. ``starts``: (start)."""
    reached = starts.select("start", F.col("start").alias("at")).distinct()
    frontier = reached
    for _ in range(hops):
        step = frontier.join(edges, frontier["at"] == edges["a"]).select("start", F.col("b").alias("at")).distinct()
        frontier = step.join(reached, ["start", "at"], "left_anti")
        reached = reached.unionByName(frontier)
    return reached.filter("start <> at").select("start", F.col("at").alias("neighbor"))


def induced(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """KG4: edges with both ends in ``nodes`` (entity)."""
    a = nodes.select(F.col("entity").alias("subject"))
    b = nodes.select(F.col("entity").alias("obj"))
    return related(triples.join(a, "subject", "left_semi").join(b, "obj", "left_semi"))


def edges_between(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """KG7: the parallel directed edges of each of ``pairs`` (subject, obj)."""
    return related(triples.join(pairs.select("subject", "obj").distinct(), ["subject", "obj"], "left_semi"))


def summary(triples: DataFrame) -> DataFrame:
    """A16-A18, KG13: one row."""
    n = entities(triples).agg(F.count("*").alias("num_entities"))
    m = triples.agg(F.count("*").alias("num_relations"), F.countDistinct("relation").alias("num_relation_types"))
    chunks = mentions(triples).agg(F.countDistinct("chunk_id").alias("num_chunks_mapped"))
    pairs = F.col("num_entities") * (F.col("num_entities") - 1)
    density = F.when(F.col("num_entities") <= 1, F.lit(0.0)).otherwise(F.round(F.col("num_relations") / pairs, 6))
    return n.crossJoin(m).crossJoin(chunks).withColumn("density", density)


def links_by_chunk(mentions: DataFrame) -> DataFrame:
    """KG10/J7: (chunk_id, n, entities): names in order, joined by a bar."""
    return mentions.groupBy("chunk_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("entity")), "|").alias("entities"))


def links_by_entity(mentions: DataFrame) -> DataFrame:
    """KG5/KG10/J8: (entity, chunk_id, n): every link as a row, with the number of the entity's chunks. A name that
    a tenth of all chunks mention has no list to hold, and its links are not moved: only counts are."""
    counts = mentions.groupBy("entity").agg(F.count("*").alias("n"))
    total = mentions.count()
    return hot_join(mentions, counts.withColumn("links", F.col("n")), "entity", "chunk_id", "n", total).select("entity", "chunk_id", F.col("links").alias("n"))
