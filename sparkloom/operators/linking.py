"""Name clustering by n-gram similarity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, ngrams, qids
from ..session import written

THRESHOLD, N = 0.90, 3


def mention_counts(triples: DataFrame) -> DataFrame:
    """A2: (name, n) over both ends of every triple."""
    return triples.select(F.explode(F.array("subject", "obj")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def similar_pairs(names: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """J12 as an equi-join: (a, b, similarity), a < b, of distinct lower-case forms.

    Exact: two sets of that similarity share one of their rarest grams, as many as the prefix
    length |A| - ceil(t |A|) + 1 says; the length filter and the full sets decide.
    ``names``: (form), distinct.
    """
    grams = written(names.select("form", ngrams(F.col("form"), n).alias("grams")))
    flat = grams.select("form", F.explode("grams").alias("gram"))
    rarity = flat.groupBy("gram").agg(F.count("*").alias("df"))
    keep = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    order = F.row_number().over(Window.partitionBy("form").orderBy("df", "gram"))
    prefix = (
        flat.join(rarity, "gram").withColumn("at", order)
        .join(grams.select("form", F.size("grams").alias("size")), "form").filter(F.col("at") <= keep).select("gram", "form", "size")
    )
    # partners of each admissible size are a key of their own, so a frequent gram is not one group
    low = F.ceil(F.col("size") * threshold - 1e-9).cast("int")
    x = prefix.select("gram", F.col("form").alias("x"), F.col("size").alias("size_x"), F.explode(F.sequence(low, F.col("size"))).alias("size"))
    met = x.join(prefix.withColumnRenamed("form", "y"), ["gram", "size"]).filter((F.col("size") < F.col("size_x")) | (F.col("x") < F.col("y")))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sets = lambda x: grams.select(F.col("form").alias(x), F.col("grams").alias(f"g{x}"))
    full = pairs.join(sets("a"), "a").join(sets("b"), "b")
    return full.select("a", "b", jaccard(F.col("ga"), F.col("gb")).alias("similarity")).filter(F.col("similarity") >= threshold)


def components(pairs: DataFrame) -> DataFrame:
    """T4: (node, root): smallest node of each component of (a, b). Smallest neighbour label, then
    the label's own label, until nothing changes: distances halve, so the rounds are as many as the logarithm of
    the longest chain. Every round is written."""
    edges = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "m").alias("root"))
        jump = least.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = written(least.join(jump, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
        changed = new.join(labels.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def clusters(triples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(name, canonical, n): every name with the most frequent name of its cluster, ties to
    the smallest."""
    counts = mention_counts(triples).withColumn("form", F.lower(F.trim("name")))
    forms = counts.select("form").distinct()
    roots = components(similar_pairs(forms, threshold)).select(F.col("node").alias("form"), "root")
    placed = counts.join(roots, "form", "left").withColumn("cluster", F.coalesce("root", "form"))
    best = placed.groupBy("cluster").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("canonical"))
    return placed.join(best, "cluster").select("name", "canonical", "n")


def normalise(triples: DataFrame, clusters: DataFrame) -> DataFrame:
    """Both ends mapped, self-loops that merging made left out. Only names that change take
    part in the joins."""
    moved = clusters.filter("name <> canonical")
    s = moved.select(F.col("name").alias("subject"), F.col("canonical").alias("s"))
    o = moved.select(F.col("name").alias("obj"), F.col("canonical").alias("o"))
    out = triples.join(s, "subject", "left").join(o, "obj", "left")
    out = out.withColumn("subject", F.coalesce("s", "subject")).withColumn("obj", F.coalesce("o", "obj")).drop("s", "o")
    return out.filter("subject <> obj")


def entity_to_qid(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """(name, qid): the i-th distinct subject of a record goes with its i-th id, as far as both
    go; the last record wins."""
    first = evidence.groupBy("question_id", "subject").agg(F.min("ord").alias("at"))
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy("at")) - 1
    subjects = first.withColumn("nth", nth)
    ids = records.select(F.col("_id").alias("question_id"), "loaded_at", F.posexplode(qids(F.col("entity_ids"))).alias("nth", "qid"))
    return subjects.join(ids, ["question_id", "nth"]).groupBy(F.col("subject").alias("name")).agg(F.max_by("qid", F.struct("loaded_at", "question_id")).alias("qid"))


def canonical_qids(names: DataFrame, clusters: DataFrame) -> DataFrame:
    """(name, qid) for canonical and for original names; an original's own id wins for itself."""
    mapped = names.join(clusters.select("name", "canonical"), "name", "left").withColumn("canonical", F.coalesce("canonical", "name"))
    both = mapped.select(F.col("canonical").alias("name"), "qid", F.col("name").alias("of")).unionByName(mapped.select("name", "qid", F.col("name").alias("of")))
    return both.groupBy("name").agg(F.max_by("qid", "of").alias("qid"))


def chunk_demographics(mentions: DataFrame, names: DataFrame, demographics: DataFrame) -> DataFrame:
    """(chunk_id, gender, geo_group): the first value of each attribute, entities by name."""
    joined = mentions.join(names.withColumnRenamed("name", "entity"), "entity", "left").join(demographics, "qid", "left")
    pick = lambda c: F.min(F.when(F.col(c) != "", F.struct("entity", c)))[c].alias(c)
    return joined.groupBy("chunk_id").agg(pick("gender"), pick("geo_group"))


def prefix_length(size: int, threshold: float = THRESHOLD) -> int:
    """Rarest grams of a set of ``size`` that the join has to look at."""
    return size - math.ceil(size * threshold - 1e-9) + 1
