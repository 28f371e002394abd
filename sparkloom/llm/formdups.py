"""Duplicates hidden by formatting differences.

Each record gets a canonical key: its compared fields, each reduced to its letters, combining
marks and digits in lower case, joined by a separator. The canonical records are range-partitioned
by (head of the key, hash of the key, id), sorted externally within the partitions, and scanned
once: neighbours with the same full key form a run, whose first row has its smallest id. The id in
the range key spreads a group of copies of any size over several partitions; the few runs that
touch an end of a partition are then joined by the digest of their key. No group is ever held in
one task, and what is broadcast grows with the number of partitions only.

Defined results: a null field equals an empty one; records that canonicalise to nothing at all are
copies of each other; exact repeats are copies; of ties the smallest id is kept; composed and
decomposed accents count as different; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Everything that is neither letter, combining mark nor digit.
_FORM = r"[^\p{L}\p{M}\p{N}]+"
_SEPARATOR = "\u001f"
#: Characters of the key that take part in the range bounds, which are sampled to the driver.
HEAD_CHARS = 48


def canonical_text(text: Column) -> Column:
    """Letters, marks and digits of ``text`` in lower case; '' for null."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _FORM, ""))


def canonical_records(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, key) of every record."""
    key = F.concat_ws(_SEPARATOR, *[canonical_text(F.col(c)) for c in fields])
    return df.select(F.col(id_col).alias("id"), key.alias("key"))


def payload_fields(payloads: DataFrame) -> DataFrame:
    """(payload_id, source_title, section, text, lang) of readable JSON payloads."""
    schema = "source_title string, section string, text string, lang string, unreadable string"
    parsed = payloads.select(
        "payload_id", F.from_json("payload", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"}).alias("p")
    )
    readable = parsed.filter(F.col("p").isNotNull() & F.col("p.unreadable").isNull())
    return readable.select("payload_id", "p.source_title", "p.section", "p.text", "p.lang")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbouring keys of one sorted partition.

    For each row (id, first): the first id of its run. At the end, for each run in the partition's
    first or last hash value (null, first, edge), edge being the digest of its key.
    """
    last_hash = last_key = first = None
    in_opening = True
    opening: dict[int, str] = {}
    closing: dict[int, str] = {}

    def out(ids: pa.Array, firsts: pa.Array, edges: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, firsts, edges], names=["id", "first", "edge"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column("key")
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        hashes = batch.column("h").to_numpy(zero_copy_only=False)
        new_key = np.ones(n, bool)
        new_key[1:] = ~pc.equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
        new_key[0] = first is None or keys[0].as_py() != last_key
        new_hash = np.ones(n, bool)
        new_hash[1:] = hashes[1:] != hashes[:-1]
        new_hash[0] = last_hash is not None and hashes[0] != last_hash
        start = np.maximum.accumulate(np.where(new_key, np.arange(n), -1))
        firsts = np.where(start >= 0, ids[start], ids[0] if first is None else first)
        runs, turns = np.flatnonzero(new_key), np.flatnonzero(new_hash)
        digest = lambda k: hashlib.sha256(keys[int(k)].as_py().encode()).hexdigest()
        if in_opening:
            until = turns[0] if len(turns) else n
            opening.update({int(ids[k]): digest(k) for k in runs[runs < until]})
            in_opening = not len(turns)
        if not in_opening:
            if len(turns):
                closing = {}
            since = turns[-1] if len(turns) else 0
            closing.update({int(ids[k]): digest(k) for k in runs[runs >= since]})
        last_hash, last_key, first = hashes[-1], keys[n - 1].as_py(), int(firsts[-1])
        yield out(pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.nulls(n, pa.string()))
    edges = opening | closing
    if edges:
        yield out(pa.nulls(len(edges), pa.int64()), pa.array(list(edges), pa.int64()), pa.array(list(edges.values()), pa.string()))


def form_groups(df: DataFrame, id_col: str, fields: list[str], partitions: int | None = None) -> DataFrame:
    """(id, kept_id) of every record: the smallest id among the records with its canonical key."""
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.substring("key", 1, HEAD_CHARS), F.col("h")]
    records = canonical_records(df, id_col, fields).select("id", F.xxhash64("key").alias("h"), "key")
    spread = records.repartitionByRange(partitions, *order, "id").sortWithinPartitions(*order, "key", "id")
    runs = durable(spread.mapInArrow(_scan, "id long, first long, edge string"))
    edge = runs.filter("edge is not null").select("edge", "first")
    kept = edge.groupBy("edge").agg(F.min("first").alias("kept"))
    moved = edge.join(kept, "edge").filter("first <> kept").select("first", "kept")
    rows = runs.filter("edge is null").select("id", "first")
    return rows.join(F.broadcast(moved), "first", "left").select("id", F.coalesce("kept", "first").alias("kept_id"))


def form_copies(df: DataFrame, id_col: str, fields: list[str], partitions: int | None = None) -> DataFrame:
    """(kept_id, copy_id): one row for each record that is not the kept one of its group."""
    groups = form_groups(df, id_col, fields, partitions)
    return groups.filter("id <> kept_id").select("kept_id", F.col("id").alias("copy_id"))


def form_counts(df: DataFrame, id_col: str, fields: list[str], partitions: int | None = None) -> DataFrame:
    """(kept_id, n_copies): one row for each different record, with the exact number of rows that
    it had; partial counts leave each task before the shuffle."""
    groups = form_groups(df, id_col, fields, partitions)
    return groups.groupBy("kept_id").agg(F.count("*").alias("n_copies"))
