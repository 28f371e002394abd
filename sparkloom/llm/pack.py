"""Filling fixed-capacity containers with items.

Documents get a hashed vector of their words, projected at random to ``DIMS`` coordinates, whose
ranks on a Hilbert curve order the corpus so that neighbours are alike. The corpus is range-sorted
by that key, and each sorted stretch is packed along the curve: best fit among the ``OPEN``
containers that are still open, the fullest leaving when a new one is needed. An item is whole in
one container; one that alone exceeds the capacity gets containers of its own, filled to the brim but
the last, which stays open to small neighbours.

Sizes are tokens of the byte-level tokenizer ByT5: a token for each UTF-8 byte and an end token; any
size column can be given instead.

Defined results: a null text has no size and is left out; an empty text has the size of its end
token; repeated texts are packed once for each id; equal keys are ordered by id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

CAPACITY = 2048
#: Features of the hashed vector, coordinates of the projection, bits of each on the curve.
FEATURES, DIMS, BITS = 4096, 3, 10
#: Containers that a stretch of the curve holds open.
OPEN = 64
#: Documents in one stretch of the curve, which one task packs; longer stretches leave fewer containers part full.
STRETCH_ITEMS = 20_000


def byt5_size(text: Column) -> Column:
    """Tokens of ``text`` in ByT5."""
    return F.octet_length(text) + 1


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of integer points (n, dims) along the Hilbert curve (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((FEATURES, DIMS))


def curve_key(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, size, place): the hash vector is built and projected where the text is read; only
    three numbers for each document go on."""
    grid = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = _projection()
        for batch in batches:
            lists = batch.column("words")
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.zeros((len(lists), DIMS))
            for d in range(DIMS):
                sums[:, d] = np.bincount(rows, weights=directions[at, d], minlength=len(lists))
            count = np.maximum(1, np.bincount(rows, minlength=len(lists)))
            unit = np.tanh(sums / np.sqrt(count)[:, None] / 2)
            cells = np.minimum(grid - 1, ((unit + 1) / 2 * grid).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("size"), pa.array(hilbert(cells), pa.int64())], names=["doc_id", "size", "place"])

    words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))
    sized = docs.filter("text is not null").select("doc_id", byt5_size(F.col("text")).cast("long").alias("size"), hashed.alias("words"))
    return sized.mapInArrow(run, "doc_id long, size long, place long")


class Packer:
    """Best fit among the open containers, for items in order; only the open containers are held."""

    def __init__(self, capacity: int, keep_open: int = OPEN) -> None:
        self.capacity, self.keep_open = capacity, keep_open
        self.room: list[tuple[int, int]] = []  # (room left, container), ascending
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(first container, number of containers) of the next item."""
        if size > self.capacity:
            whole, rest = divmod(size, self.capacity)
            at = (self.made, whole + (rest > 0))
            self.made += whole
            if rest:
                bisect.insort(self.room, (self.capacity - rest, self.made))
                self.made += 1
        else:
            k = bisect.bisect_left(self.room, (size, -1))
            if k < len(self.room):
                left, container = self.room.pop(k)
            else:
                left, container = self.capacity, self.made
                self.made += 1
            at = (container, 1)
            if left > size:
                bisect.insort(self.room, (left - size, container))
        if len(self.room) > self.keep_open:
            del self.room[0]
        return at


def fill(sizes: list[int], capacity: int, keep_open: int = OPEN) -> list[tuple[int, int]]:
    """(first container, number of containers) of each item in order."""
    packer = Packer(capacity, keep_open)
    return [packer.place(size) for size in sizes]


def pack(docs: DataFrame, capacity: int = CAPACITY, stretches: int | None = None) -> DataFrame:
    """(doc_id, size, container, n_containers): container numbers the first of the item's
    containers, unique over all stretches. The texts are read and hashed once; what the range sort samples and
    moves is three numbers a document. How many stretches there are follows from the number of documents."""
    keyed = written(curve_key(docs, capacity))
    parts = stretches or max(1, -(-keyed.count() // STRETCH_ITEMS))
    # the hash spreads documents of one place, of which there may be any number
    spread = keyed.repartitionByRange(parts, "place", F.xxhash64("doc_id"))
    ordered = spread.sortWithinPartitions("place", F.xxhash64("doc_id"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity)
        for batch in batches:
            if not batch.num_rows:
                continue
            base = batch.column("stretch")[0].as_py() << 40
            placed = [packer.place(size) for size in batch.column("size").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), pa.array([base + c for c, _ in placed], pa.int64()), pa.array([n for _, n in placed], pa.int64())],
                names=["doc_id", "size", "container", "n_containers"],
            )

    return ordered.select("doc_id", "size", F.spark_partition_id().alias("stretch")).mapInArrow(run, "doc_id long, size long, container long, n_containers long")


def unused(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens, share of unused space. Containers that hold the rest of an
    oversized item are counted once."""
    last = packed.select("doc_id", "size", F.col("container") + F.col("n_containers") - 1, "n_containers").toDF("doc_id", "size", "last", "n")
    per = last.groupBy("last").agg(F.sum("size").alias("size"), F.max("n").alias("n"), F.count("*").alias("items"))
    sums = per.agg(F.sum("items").alias("items"), F.sum("n").alias("containers"), F.sum("size").alias("tokens"))
    return sums.select("items", "containers", "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6).alias("unused_share"))
