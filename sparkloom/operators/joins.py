"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than this share of all rows are joined by broadcast.
HOT_SHARE = 0.001


def hot_join(rows: DataFrame, classes: DataFrame, key: str, spread: str, count: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``classes`` (``key``, ``count`` and others; one row a key).

    ``count`` says how many rows have the key, of ``total``. Those of more than ``HOT_SHARE`` of all rows,
    at most 1 / ``HOT_SHARE`` keys whatever the size, are broadcast; the rows that they settle need no
    partner any more and are spread evenly by the hash of ``spread``, the others are joined by their
    key, none of which is hot.
    """
    most = max(1, int(total * HOT_SHARE))
    values = [c for c in classes.columns if c != key]
    packed = classes.select(F.col(key), F.col(count).alias("_n"), F.struct(*values).alias("_v"))
    hot = packed.filter(F.col("_n") > most).select(key, F.col("_v").alias("_hot"))
    rest = packed.filter(F.col("_n") <= most).select(F.col(key).alias("_key"), F.lit(True).alias("_open"), F.col("_v").alias("_rest"))
    placed = rows.join(F.broadcast(hot), key, "left").withColumn("_open", F.col("_hot").isNull())
    keyed = placed.withColumn("_key", F.when(F.col("_open"), F.col(key)).otherwise(F.xxhash64(spread).cast(dict(rows.dtypes)[key])))
    joined = keyed.join(rest, ["_key", "_open"], "left").withColumn("_v", F.coalesce("_hot", "_rest"))
    if how == "inner":
        joined = joined.filter("_v is not null")
    return joined.select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in values])


#: Parts into which the rows of a hot key are split.
SALTS = 16


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """(key) of what more than ``share`` of all rows hold: at most 1 / ``share`` keys. Counts are partial
    before the shuffle."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_total"))
    return counts.join(F.broadcast(total), F.col("_n") > F.greatest(F.lit(1000), F.col("_total") * share)).select(key)


def salted_join(few: DataFrame, many: DataFrame, key: str, spread: str, hot: DataFrame) -> DataFrame:
    """``few`` and ``many`` by ``key``. The rows of ``many`` with a key in ``hot`` (from ``hot_keys``) are split over
    ``SALTS`` parts by their ``spread``; each part meets its own copy of the rows of ``few``."""
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    split = many.join(mark, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = few.join(mark, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return copied.join(split, [key, "_salt"]).drop("_salt")
