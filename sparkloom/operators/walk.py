"""Expansion of many queries over one graph of numbers.

A query may reach most of the graph, so what it meets on the way is neither shuffled nor written: names are
numbered in their order, links become arrays of four-byte numbers that each Python worker reads once from the shared
folder, and a query's row walks through one task, which hands over its result only. What a worker holds grows
with the graph (about 30 bytes a link), not with the queries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written, written_at

#: Rows of a query that are handed over at once, and tasks a core.
BATCH_ROWS, TASKS = 100_000, 4
NONE = -np.inf
#: Links from which a row keeps the first chunks of its targets for later queries, and how many it keeps.
MANY, KEPT = 64, 1024


def numbered(names: DataFrame, key: str, *more: Column) -> tuple[DataFrame, str]:
    """(``key``, id, ``more``) with ids from 0 in the order of the names, and its path: sorted in parts whose sizes shift the ids."""
    spark = names.sparkSession
    parts = 2 * spark.sparkContext.defaultParallelism
    at = names.distinct().repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id())
    rows = written(at)
    part = F.shiftright("at", 33)
    counts = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts = np.cumsum([0, *(counts.get(k, 0) for k in range(parts))]).tolist()
    start = F.element_at(F.array(*map(F.lit, starts)), part.cast("int") + 1)
    return written_at(rows.select(key, (start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("id"), *more))


@dataclass
class Graph:
    """Where the numbered tables are. ``chunks``: (chunk_id, id)."""

    chunks: DataFrame
    paths: dict[str, str]


def prepare(mentions: DataFrame, edges: DataFrame, seeds: DataFrame, tags: DataFrame | None = None, attributes: tuple[str, ...] = ()) -> Graph:
    """``edges``: (a, b) in both directions. Every chunk of the queries has to be among the mentions or ``seeds``."""
    mentions, edges = written(mentions.select("chunk_id", "entity")), written(edges.select("a", "b"))
    names, names_at = numbered(edges.select(F.col("a").alias("entity")).unionByName(mentions.select("entity")), "entity", F.lower("entity").alias("low"))
    chunks, chunks_at = numbered(mentions.select("chunk_id").unionByName(seeds.select("chunk_id")), "chunk_id")
    names = names.drop("low")
    a, b = names.toDF("a", "ia"), names.toDF("b", "ib")
    paths = {"names": names_at, "chunks": chunks_at}
    paths["edges"] = written_at(edges.join(a, "a").join(b, "b").select("ia", "ib"))[1]
    paths["mentions"] = written_at(mentions.join(names, "entity").withColumnRenamed("id", "ie").join(chunks, "chunk_id").select(F.col("id").alias("ic"), "ie"))[1]
    if tags is not None:
        paths["tags"] = written_at(tags.select("chunk_id", *attributes).join(chunks, "chunk_id").select(F.col("id").alias("ic"), *attributes))[1]
    return Graph(chunks, paths)


def _read(path: str, columns: list[str]) -> pa.Table:
    if path.startswith("file:") or "://" not in path:
        return pq.read_table(re.sub(r"^file:/+", "/", path), columns=columns)
    fs, inside = pyarrow.fs.FileSystem.from_uri(path)
    return pq.read_table(inside, columns=columns, filesystem=fs)


class Links:
    """From each of ``n`` rows to its targets, one after the other, in their order."""

    def __init__(self, source: np.ndarray, target: np.ndarray, n: int) -> None:
        self.start = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=n))]).astype(np.int64)
        key = source.astype(np.int64) << 32 | target
        key.sort()
        self.to = (key & 0xFFFFFFFF).astype(np.int32)
        self.rows = np.flatnonzero(np.diff(self.start))

    def count(self, rows: np.ndarray) -> np.ndarray:
        return self.start[rows + 1] - self.start[rows]

    def row(self, row: int) -> np.ndarray:
        return self.to[self.start[row] : self.start[row + 1]]

    def of(self, rows: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The targets of ``rows``, or the first ``most`` of each, and how many each has."""
        n = self.count(rows)
        if most is not None:
            n = np.minimum(n, most)
        return self.to[np.arange(n.sum()) + np.repeat(self.start[rows] - (np.cumsum(n) - n), n)], n


def spread(score: np.ndarray, rows: np.ndarray, out: Links, back: Links, n: int) -> np.ndarray:
    """For each of ``n`` targets the best score of the ``rows`` that lead there. Few rows push along ``out``, the best
    last; where they have many links, every target looks back along ``back``."""
    best = np.full(n, NONE)
    if 4 * out.count(rows).sum() < len(back.to):
        rows = rows[np.argsort(score[rows], kind="stable")]
        to, times = out.of(rows)
        best[to] = np.repeat(score[rows], times)
    elif len(back.to):
        source = np.full(len(score), NONE)
        source[rows] = score[rows]
        best[back.rows] = np.maximum.reduceat(source[back.to], back.start[back.rows])
    return best


def leading(best: dict[int, float], k: int) -> tuple[dict[int, float], float]:
    """The best ``k`` by score, ties by number, and the score that the last of so many has."""
    if len(best) < k:
        return best, NONE
    rows = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return dict(rows), rows[-1][1]


def best_of(score: np.ndarray, rows: np.ndarray, k: int | None) -> np.ndarray:
    """The best ``k`` of ``rows`` (rising) by score, ties by number."""
    if k is not None and len(rows) > k:
        s = score[rows]
        cut = np.partition(s, -k)[-k]
        above = rows[s > cut]
        rows = np.concatenate([above, rows[s == cut][: k - len(above)]])
    return rows[np.lexsort((rows, -score[rows]))]


def in_order(score: np.ndarray, rows: np.ndarray, block: int = 4096) -> Iterator[np.ndarray]:
    """All ``rows`` from the best on, in growing parts."""
    while len(rows):
        part = rows
        if len(rows) > block:
            s = score[rows]
            at = s >= np.partition(s, -block)[-block]
            part, rows = rows[at], rows[~at]
        else:
            rows = rows[:0]
        yield part[np.argsort(-score[part], kind="stable")]
        block *= 8


class Net:
    """The arrays of a graph in a worker; ``last`` is kept from task to task."""

    last: tuple[tuple, Net] | None = None

    @classmethod
    def at(cls, paths: dict[str, str]) -> Net:
        key = tuple(sorted(paths.items()))
        if cls.last is None or cls.last[0] != key:
            cls.last = None
            cls.last = (key, cls(paths))
        return cls.last[1]

    def __init__(self, paths: dict[str, str]) -> None:
        def ids(name: str, *columns: str) -> list[np.ndarray]:
            t = _read(paths[name], list(columns))
            return [t[c].to_numpy() for c in columns]

        self.paths, self._texts = paths, {}
        self.n, self.m = (pq_rows(paths[x]) for x in ("names", "chunks"))
        a, b = ids("edges", "ia", "ib")
        self.edges = Links(a, b, self.n)
        # each link once, from the end with fewer links to the other, so that no row has many
        size = np.diff(self.edges.start)
        once = (size[a] < size[b]) | ((size[a] == size[b]) & (a < b))
        self.upward = Links(a[once], b[once], self.n)
        c, e = ids("mentions", "ic", "ie")
        self.chunks_of, self.entities_of = Links(e, c, self.n), Links(c, e, self.m)
        self.entity, self.chunk = e, c
        self.groups: dict[str, np.ndarray] = {}
        self.group_names: dict[str, list] = {}
        self.tagged = np.zeros(self.m, bool)
        if "tags" in paths:
            t = _read(paths["tags"], None)
            at = t["ic"].to_numpy()
            self.tagged[at] = True
            for name in (x for x in t.column_names if x != "ic"):
                codes = t[name].combine_chunks().dictionary_encode()
                self.groups[name] = np.full(self.m, -1, np.int32)
                self.groups[name][at] = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                self.group_names[name] = codes.dictionary.to_pylist()
        self.shares = None
        self.sizes = np.full(self.n, -1, np.int32)
        # what a query writes here it takes back
        self.seen, self.score, self.place = np.zeros(self.n, bool), np.full(self.n, NONE), np.zeros(self.n, np.int32)
        self.hubs: dict[tuple, tuple[np.ndarray, np.ndarray, bool]] = {}
        self.rings: dict[int, np.ndarray] = {}

    def texts(self, name: str, column: str) -> pa.Array:
        if (name, column) not in self._texts:
            t = _read(self.paths[name], ["id", column])
            self._texts[name, column] = t[column].combine_chunks().take(pa.array(np.argsort(t["id"].to_numpy())))
        return self._texts[name, column]

    def weights(self, chunks: np.ndarray, factor: float) -> np.ndarray:
        """R11/R13 for every entity: see ``expand.balance``."""
        if self.shares is None:
            parts, base = [], 0
            for name, g in self.groups.items():
                code = g[self.chunk]
                parts.append(self.entity[code >= 0].astype(np.int64) << 32 | code[code >= 0] + base)
                base += len(self.group_names[name])
            key, times = np.unique(np.concatenate(parts), return_counts=True)
            ent = (key >> 32).astype(np.int64)
            self.shares = ent, (key & 0xFFFFFFFF).astype(np.int64), times, np.bincount(ent, weights=times, minlength=self.n)
        found, each = np.flatnonzero(chunks > NONE), []
        for name, g in self.groups.items():
            code = g[found]
            n = np.bincount(code[code >= 0], minlength=len(self.group_names[name]))
            total = n.sum()
            over = n / max(1, total) > 1.0 / max(2, np.count_nonzero(n))
            each.append(np.where(over, factor, 1.0 / factor) if total else np.ones(len(n)))
        ent, code, times, total = self.shares
        summed = np.bincount(ent, weights=np.concatenate(each)[code] * times, minlength=self.n)
        return np.where(total > 0, summed / np.maximum(total, 1), 1.0)

    def walk(self, at: np.ndarray, scores: np.ndarray, hops: int, decay: float, factor: float | None, top: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of chunks and of entities, and the entities' hops. With ``top`` the last hop goes on only from entities whose neighbours may come
        among the best ``top`` chunks; the chunks found so far, on which balancing looks, are always all."""
        chunks, hop_of = np.full(self.m, NONE), np.full(self.n, -1, np.int8)
        np.maximum.at(chunks, at, scores)
        score = spread(chunks, np.unique(at), self.entities_of, self.chunks_of, self.n)
        frontier = np.flatnonzero(score > NONE)
        hop_of[frontier] = 0
        most = 1.0 if factor is None else max(factor, 1 / factor)
        for hop in range(hops):
            if top and hop == hops - 1:
                found = chunks[chunks > NONE]
                if len(found) >= top:
                    frontier = frontier[score[frontier] * decay ** (hop + 1) * most >= np.partition(found, -top)[-top] - 1e-6]
            if not len(frontier):
                break
            new = spread(score, frontier, self.edges, self.edges, self.n)
            frontier = np.flatnonzero((new > NONE) & (hop_of < 0))
            new = new[frontier] * decay ** (hop + 1)
            score[frontier] = new if factor is None else new * self.weights(chunks, factor)[frontier]
            hop_of[frontier] = hop + 1
            np.maximum(chunks, spread(score, frontier, self.chunks_of, self.entities_of, self.m), out=chunks)
        return chunks, score, hop_of

    def best(self, at: np.ndarray, scores: np.ndarray, hops: int, decay: float, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``top`` chunks of ``walk``, from the best on, and their scores."""
        if 0 <= decay <= 1 and scores.min(initial=0) >= 0:
            return self.nearest(at, scores, hops, decay, top)
        chunks, _, _ = self.walk(at, scores, hops, decay, None, top)
        rows = best_of(chunks, np.flatnonzero(chunks > NONE), top)
        return rows, chunks[rows]

    def nearest(self, at: np.ndarray, scores: np.ndarray, hops: int, decay: float, top: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` where scores only fall: parents of one score at a time, the best first, until nothing that is left can come among the best ``top``.
        Of what a score leads to, only the first chunks are looked up: fewer than ``top`` are better already, so the first 2 * ``top`` are enough."""
        best: dict[int, float] = {}
        for c, x in zip(at.tolist(), scores.tolist()):
            best[c] = max(x, best.get(c, x))
        levels: dict[float, list[int]] = {}
        for c, x in best.items():
            levels.setdefault(x, []).append(c)
        # an entity of several levels is gone from at each; its best one tells
        frontier, wide, met = {}, {}, []
        for x, chunks in levels.items():
            wide[x] = [c for c in chunks if self.entities_of.start[c + 1] - self.entities_of.start[c] > MANY]
            frontier[x] = self.entities_of.of(np.array([c for c in chunks if c not in wide[x]], np.int64))[0]
            met += [frontier[x], *map(self.entities_of.row, wide[x])]
        for rows in met:
            self.seen[rows] = True
        best, floor = leading(best, top)
        for hop in range(hops if any(map(len, met)) else 0):
            for level in sorted(frontier, reverse=True):
                reach = level * decay ** (hop + 1)
                if reach < floor:
                    break
                for c in self.told(frontier[level], 2 * top, wide.get(level, [])).tolist():
                    best[c] = max(reach, best.get(c, reach))
                best, floor = leading(best, top)
            if hop + 1 == hops or max(frontier) * decay ** (hop + 1) * decay ** (hop + 2) < floor:
                break
            step: dict[float, list[np.ndarray]] = {}
            for level in sorted(frontier, reverse=True):
                near = np.concatenate([self.edges.of(frontier[level])[0], *map(self.ring, wide.get(level, []))])
                near = np.unique(near[~self.seen[near]])
                if len(near):
                    self.seen[near] = True
                    met.append(near)
                    step.setdefault(level * decay ** (hop + 1), []).append(near)
            if not step:
                break
            frontier, wide = {x: np.concatenate(rows) for x, rows in step.items()}, {}
        for rows in met:
            self.seen[rows] = False
        rows = sorted(best, key=lambda c: (-best[c], c))[:top]
        return np.array(rows, np.int64), np.array([best[c] for c in rows], np.float64)

    def ring(self, c: int) -> np.ndarray:
        """The neighbours of the entities of a chunk of many, without these."""
        if c not in self.rings:
            own = self.entities_of.row(c)
            self.rings[c] = np.setdiff1d(self.edges.of(own)[0], own)
        return self.rings[c]

    def told(self, rows: np.ndarray, k: int, wide: list[int]) -> np.ndarray:
        """The first ``k`` chunks of the neighbours, not ``seen``, of ``rows`` and of the entities of the chunks ``wide``."""
        many = self.edges.count(rows) > MANY
        if np.count_nonzero(many) > MANY:
            many[:] = False
        near = self.edges.of(rows[~many])[0]
        found = [self.telling(np.unique(near[~self.seen[near]]) if len(near) > KEPT else near[~self.seen[near]], k)[0]]
        found += [self.told_by((e, k), self.edges.row(e), k) for e in rows[many].tolist()] + [self.told_by((c, k, "chunk"), self.ring(c), k) for c in wide]
        return np.unique(np.concatenate(found))[:k]

    def told_by(self, key: tuple, near: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` chunks, or more, of many neighbours. The first ``KEPT``, with the neighbour of each, are kept under ``key`` for later
        queries; all are gone through where those do not do."""
        kept = self.hubs.get(key)
        if kept is None:
            to, by = self.telling(near, k)
            first = np.argsort(to, kind="stable")[:KEPT]
            kept = self.hubs[key] = to[first], by[first], len(to) <= KEPT
        found = np.unique(kept[0][~self.seen[kept[1]]])
        return found if kept[2] or len(found) >= k else np.unique(self.telling(near[~self.seen[near]], k)[0])

    def telling(self, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` chunks of each of ``near``, and whose they are."""
        to, times = self.chunks_of.of(near, k)
        return to, np.repeat(near, times)

    def post_hoc(self, chunks: np.ndarray, attribute: str, k: int) -> np.ndarray:
        """See ``expand.post_hoc``."""
        names, found = self.group_names[attribute], np.flatnonzero(chunks > NONE)
        unknown = names.index("unknown") if "unknown" in names else len(names)
        code = self.groups[attribute][found]
        code = np.where(self.tagged[found], np.where(code < 0, len(names) + 1, code), unknown)
        best = [best_of(chunks, found[code == g], k) for g in np.unique(code)]
        best.sort(key=lambda rows: (-chunks[rows[0]], rows[0]))
        return np.concatenate([rows[: k // len(best) + (nth < k % len(best))] for nth, rows in enumerate(best)]) if best else found

    def constrained(self, chunks: np.ndarray, attributes: tuple[str, ...], ratio: float, k: int) -> np.ndarray:
        """See ``expand.constrained``. A scan from one chunk that may be taken to the next."""
        counts = {a: np.zeros(len(self.group_names[a]) + 1) for a in attributes}
        taken: list[int] = []
        for part in in_order(chunks, np.flatnonzero(chunks > NONE)):
            groups = {a: self.groups[a][part] for a in attributes}
            at, window = 0, 64
            while at < len(part) and len(taken) < k:
                fits = np.ones(min(window, len(part) - at), bool)
                for a in attributes:
                    free = (counts[a] + 1) / (len(taken) + 1) <= ratio
                    free[-1] = True  # chunks without a value
                    fits &= free[groups[a][at : at + window]]
                first = int(fits.argmax())
                if not fits[first]:
                    at, window = at + window, 4 * window
                    continue
                for a in attributes:
                    counts[a][groups[a][at + first]] += 1
                taken.append(int(part[at + first]))
                at, window = at + first + 1, 64
            if len(taken) >= k:
                break
        return np.array(taken, np.int64)


    def inside(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entities of the chunks ``at``, and the ends a < b of the links among them."""
        nodes = np.unique(self.entities_of.of(np.unique(at))[0])
        self.seen[nodes] = True
        to, times = self.upward.of(nodes)
        own = self.seen[to]
        self.seen[nodes] = False
        x, y = np.repeat(nodes, times)[own], to[own]
        return nodes, np.minimum(x, y), np.maximum(x, y)

    def hits(self, nodes: np.ndarray, question: str | None, words: list[str] | None, match: float) -> np.ndarray:
        """See ``filtering.query_entities``. Names are compared with words of like many grams only."""
        if question is None:
            return nodes[:0]
        low = self.texts("names", "low").take(pa.array(nodes)).to_pylist()
        for k in np.flatnonzero(self.sizes[nodes] < 0):
            self.sizes[nodes[k]] = len(grams(low[k].strip(" ")))
        size, asked = self.sizes[nodes], [grams(w) for w in words]
        near = np.zeros(len(nodes), bool)
        for n in {len(w) for w in asked}:
            near |= (np.minimum(size, n) / np.maximum(size, n)) >= match
        like = {k for k in np.flatnonzero(near).tolist() if any(len(g & w) / len(g | w) >= match for g in [grams(low[k].strip(" "))] for w in asked)}
        return nodes[[k for k, name in enumerate(low) if name in question or k in like]]

    def scores_of(self, nodes: np.ndarray, at: np.ndarray, scores: np.ndarray, hops: int, decay: float) -> np.ndarray:
        """What ``walk`` scores ``nodes``, 0 where it does not come; the last hop is gone from there. Where a node is not reached in the
        hops before, those of its neighbours that are were reached in the last of them."""
        score, by = self.score, np.argsort(scores, kind="stable")
        to, times = self.entities_of.of(at[by])
        score[to] = np.repeat(scores[by], times)  # the best last
        met = [np.unique(to)]
        frontier = met[0]
        for hop in range(1, hops):
            before = np.concatenate(met)
            was, values = score[before], score[frontier]
            step = []
            for level in np.unique(values).tolist():
                rows = frontier[values == level]
                many = self.edges.count(rows) > MANY
                if np.count_nonzero(many) > MANY:
                    many[:] = False
                for near in (self.edges.of(rows[~many])[0], *(self.edges.row(e) for e in rows[many].tolist())):
                    score[near] = level * decay**hop
                    step.append(near)
            score[before] = was
            met += step
            if hop + 1 < hops:
                frontier = np.setdiff1d(np.concatenate([frontier[:0], *step]), before)
        result = score[nodes]
        left = np.flatnonzero((result == NONE) & (self.edges.count(nodes) > 0)) if hops else nodes[:0]
        if len(left):
            to, times = self.edges.of(nodes[left])
            result[left] = np.maximum.reduceat(score[to], np.cumsum(times) - times) * decay**hops
        for rows in met:
            score[rows] = NONE
        return np.where(result > NONE, result, 0.0)

    def preorder(self, ranked: np.ndarray) -> list[int]:
        """See ``filtering.dfs_order``."""
        nodes, a, b = self.inside(ranked)
        self.place[nodes] = np.arange(len(nodes))
        to, times = self.entities_of.of(ranked)
        if not len(to):
            return ranked.tolist()
        a, b, own, whose = self.place[a], self.place[b], self.place[to], np.repeat(np.arange(len(ranked)), times)
        start = int(own[0])
        if len(nodes) > MANY and len(ranked) < 64:
            a, b = self.trimmed(a, b, own, whose, start, len(nodes))
            linked = np.zeros(len(nodes), bool)
            linked[start] = linked[a] = linked[b] = True
            own, whose = own[linked[own]], whose[linked[own]]
        links = Links(np.concatenate([a, b]), np.concatenate([b, a]), len(nodes))
        at, near = links.start.tolist(), links.to.tolist()
        told: dict[int, list[int]] = {}
        for e, k in zip(own.tolist(), whose.tolist()):
            told.setdefault(e, []).append(k)
        order, seen, path = dict.fromkeys(told[start]), bytearray(len(nodes)), [(start, at[start])]
        seen[start] = True
        wanted = np.count_nonzero(times)
        while path and len(order) < wanted:
            e, k = path.pop()
            end = at[e + 1]
            while k < end and seen[near[k]]:
                k += 1
            if k < end:
                path += [(e, k + 1), (near[k], at[near[k]])]
                seen[near[k]] = True
                for c in told[near[k]]:
                    order[c] = None
        return ranked[list(order | dict.fromkeys(range(len(ranked))))].tolist()

    @staticmethod
    def trimmed(a: np.ndarray, b: np.ndarray, own: np.ndarray, whose: np.ndarray, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The links without ends that tell nothing: those with one link, all of whose chunks the start's chunk or the other end has told before."""
        told = np.zeros(n, np.int64)
        np.bitwise_or.at(told, own, 1 << whose)
        new = told & ~(1 << whose[0])
        while len(a):
            one = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) == 1
            one[start] = False
            idle = (one[a] & (new[a] & ~told[b] == 0)) | (one[b] & (new[b] & ~told[a] == 0))
            if np.count_nonzero(idle) * 100 <= len(a):
                break
            a, b = a[~idle], b[~idle]
        return a, b


def grams(text: str) -> set[str]:
    """As ``functions.text.ngrams``, of text in lower case."""
    return {text[k : k + 3] for k in range(max(1, len(text) - 2))}


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """R16 over ``n`` names: see ``filtering.spanning_forest``."""
    by = np.lexsort((b, a, -weight))
    if len(by) > KEPT:
        return by[grown(a[by], b[by], n)]
    parent = list(range(n))
    keep = []
    for k, x, y in zip(by.tolist(), a[by].tolist(), b[by].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            keep.append(k)
            if len(keep) == n - 1:
                break
    return np.array(keep, np.int64)


def grown(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The same forest of many links, given from the best on: each tree takes the best link that leaves it, all trees at once."""
    label, rank, keep = np.arange(n), np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        x, y = label[a[rank]], label[b[rank]]
        out = x != y
        rank, x, y = rank[out], x[out], y[out]
        if not len(rank):
            return np.unique(np.concatenate(keep))
        best = np.full((2, n), len(a))
        best[0, x[::-1]], best[1, y[::-1]] = rank[::-1], rank[::-1]  # the best is set last
        best = best.min(axis=0)
        trees = np.flatnonzero(best < len(a))
        taken = best[trees]
        keep.append(taken)
        to = np.arange(n)
        to[trees] = label[a[taken]] + label[b[taken]] - trees
        both = trees[(to[to[trees]] == trees) & (trees < to[trees])]
        to[both] = both
        while (to != to[to]).any():
            to = to[to]
        label = to[label]


def pq_rows(path: str) -> int:
    return _read(path, ["id"]).num_rows


def _run(seeds: DataFrame, graph: Graph, work, columns: str, extra: DataFrame | None = None) -> DataFrame:
    """``work(net, row)`` gives the columns of each query's result, as arrays. ``row``: the numbers and scores of its chunks, and what ``extra`` has."""
    kind, paths = dict(seeds.dtypes)["query_id"], graph.paths
    rows = seeds.join(graph.chunks, "chunk_id").groupBy("query_id").agg(F.collect_list("id").alias("at"), F.collect_list(F.col("score").cast("double")).alias("scores"))
    if extra is not None:
        rows = rows.join(extra, "query_id", "left")
    names = ["query_id", *(x.split()[0] for x in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            type_ = batch.schema.field("query_id").type
            for row in batch.to_pylist():
                result = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(Net.at(paths), row)]
                out = pa.RecordBatch.from_arrays([pa.array([row["query_id"]], type_).take(pa.array(np.zeros(len(result[0]), np.int64))), *result], names=names)
                for at in range(0, out.num_rows, BATCH_ROWS):
                    held.append(out.slice(at, BATCH_ROWS))
                    size += held[-1].num_rows
                    if size >= BATCH_ROWS // 2:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    # a number of parts of one's own is not put together again
    tasks = TASKS * seeds.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, "query_id").mapInArrow(run, f"query_id {kind}, {columns}")


def _seeded(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.array(row["at"], np.int64), np.array(row["scores"], np.float64)


def chunk_scores(seeds: DataFrame, graph: Graph, hops: int, decay: float, factor: float | None = None, top: int | None = None, places: int | None = None, pick: tuple | None = None) -> DataFrame:
    """(query_id, chunk_id, score): the best ``top`` chunks (scores rounded to ``places`` first), those that ``pick`` names
    (a method of ``Net`` and its arguments), or all."""

    def work(net: Net, row: dict) -> list:
        if top and factor is None and places is None and pick is None:
            rows, best = net.best(*_seeded(row), hops, decay, top)
            return [net.texts("chunks", "chunk_id").take(pa.array(rows)), best]
        chunks, _, _ = net.walk(*_seeded(row), hops, decay, factor, top)
        if places is not None:
            chunks = np.round(chunks, places)
        rows = np.flatnonzero(chunks > NONE) if pick is None else getattr(net, pick[0])(chunks, *pick[1:])
        if top:
            rows = best_of(chunks, rows, top)
        return [net.texts("chunks", "chunk_id").take(pa.array(rows)), chunks[rows]]

    return _run(seeds, graph, work, "chunk_id string, score double")


def rounded(score: np.ndarray, places: int) -> np.ndarray:
    """As SQL rounds, halves up in decimals; a query's scores have few values, and each is rounded once."""
    values, at = np.unique(score, return_inverse=True)
    return np.array([float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) for x in values.tolist()], np.float64)[at]


def entity_scores(seeds: DataFrame, graph: Graph, hops: int, decay: float, factor: float | None = None, places: int | None = None) -> DataFrame:
    """(query_id, entity, score, hop) of every entity that is reached, scores rounded to ``places``."""

    def work(net: Net, row: dict) -> list:
        _, score, hop = net.walk(*_seeded(row), hops, decay, factor, None)
        rows = np.flatnonzero(hop >= 0)
        scores = score[rows] if places is None else rounded(score[rows], places)
        return [net.texts("names", "entity").take(pa.array(rows)), scores, hop[rows].astype(np.int32)]

    return _run(seeds, graph, work, "entity string, score double, hop int")


def _asked(queries: DataFrame) -> DataFrame:
    low = F.lower("question")
    return queries.select("query_id", low.alias("question"), F.split(low, r"\s+").alias("words"))


def inside(chunks: DataFrame, graph: Graph) -> DataFrame:
    """(query_id, a, b): links among the entities of each query's chunks, a < b."""

    def work(net: Net, row: dict) -> list:
        _, a, b = net.inside(_seeded(row)[0])
        names = net.texts("names", "entity")
        return [names.take(pa.array(a)), names.take(pa.array(b))]

    return _run(chunks, graph, work, "a string, b string")


def filtered(chunks: DataFrame, graph: Graph, queries: DataFrame, match: float) -> DataFrame:
    """(query_id, chunk_id, score) that R14 keeps, of any number."""

    def work(net: Net, row: dict) -> list:
        at, scores = _seeded(row)
        nodes, a, _ = net.inside(at)
        if len(nodes) > 1 and (len(a) or len(net.hits(nodes, row["question"], row["words"], match)) > 1):
            has = net.entities_of.count(at) > 0
            at, scores = at[has], scores[has]
        return [net.texts("chunks", "chunk_id").take(pa.array(at)), scores]

    return _run(chunks, graph, work, "chunk_id string, score double", _asked(queries))


def weights(seeds: DataFrame, graph: Graph, queries: DataFrame, hops: int, decay: float, top: int, match: float, boost: float, only_forest: bool = False) -> DataFrame:
    """(query_id, a, b, weight) of R15 over the ``top`` best chunks of the expansion, to nine digits; or of their spanning forest."""

    def work(net: Net, row: dict) -> list:
        at, scores = _seeded(row)
        nodes, a, b = net.inside(net.best(at, scores, hops, decay, top)[0])
        own = net.scores_of(nodes, at, scores, hops, decay)
        net.place[nodes] = np.arange(len(nodes))
        weight = own[net.place[a]] + own[net.place[b]]
        named = np.sort(net.hits(nodes, row["question"], row["words"], match))
        x, y = (named[k] for k in np.triu_indices(len(named), 1))
        key, more = a.astype(np.int64) << 32 | b, x.astype(np.int64) << 32 | y
        weight = weight + boost * np.isin(key, more)
        new = more[~np.isin(more, key)]
        a, b, weight = np.concatenate([a, new >> 32]), np.concatenate([b, new & 0xFFFFFFFF]), np.round(np.concatenate([weight, np.full(len(new), boost)]), 9)
        if only_forest:
            keep = forest(net.place[a], net.place[b], weight, len(nodes))
            a, b, weight = a[keep], b[keep], weight[keep]
        names = net.texts("names", "entity")
        return [names.take(pa.array(a.astype(np.int64))), names.take(pa.array(b.astype(np.int64))), weight]

    return _run(seeds, graph, work, "a string, b string, weight double", _asked(queries))


def preorder(chunks: DataFrame, graph: Graph) -> DataFrame:
    """(query_id, chunk_id, score, place) of R17."""

    def work(net: Net, row: dict) -> list:
        at, scores = _seeded(row)
        rank = np.lexsort((at, -scores))
        at, scores = at[rank], scores[rank]
        place = {c: k for k, c in enumerate(net.preorder(at), 1)}
        return [net.texts("chunks", "chunk_id").take(pa.array(at)), scores, np.array([place[c] for c in at.tolist()], np.int32)]

    return _run(chunks, graph, work, "chunk_id string, score double, place int")


def expanded_preorder(seeds: DataFrame, graph: Graph, hops: int, decay: float, top: int) -> DataFrame:
    """``preorder`` of the ``top`` best chunks of the expansion."""

    def work(net: Net, row: dict) -> list:
        ranked, scores = net.best(*_seeded(row), hops, decay, top)
        place = {c: k for k, c in enumerate(net.preorder(ranked), 1)}
        return [net.texts("chunks", "chunk_id").take(pa.array(ranked)), scores, np.array([place[c] for c in ranked.tolist()], np.int32)]

    return _run(seeds, graph, work, "chunk_id string, score double, place int")
