"""Mapping free-entered values to a canonical list.

Values and reference names are brought to keys: without accents, in lower case, with abbreviations
spelled out, without quotes, articles, qualifiers in brackets and the like; "Last, First" also in
the other order. A BK-tree holds the reference keys under the Levenshtein distance, a true metric, so the
triangle inequality lets whole branches be passed over and every key within the threshold is still
found. Groups of at most ``LEAF`` keys that are equally far from their parent stay together in one leaf:
there the letters that two keys do not share, a lower bound of their slips, are counted in machine words
before any distance is. Distances are bit-parallel, for all values of a batch at once. A list of more
than ``SHARD_NAMES`` names becomes several trees, whose winners are merged.

Each different value is searched for once, whatever number of rows has it: values are counted
with partial sums, resolved, and joined back, those of very many rows by broadcast.

Defined results: null and blank values come out nowhere; a value that is letter for letter a
canonical name is not reported; a value that several entries are equally near to gets the one
whose unfolded name is nearest, then the smallest id; an empty list leaves every value at 0; an
empty table gives an empty result; other columns are ignored; repeated rows come out under their
own id.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import hot_join
from ..session import written

#: Names in one tree, and in one leaf of it.
SHARD_NAMES, LEAF = 100_000, 256
#: One slip (a changed, missing or added letter, or two letters exchanged) for so many characters of
#: a key, up to MAX_SLIPS; an exchange is two edits of the tree's metric, so its radius is twice that.
CHARS_PER_SLIP, MAX_SLIPS = 4, 3
#: Slips stay under this share of the letters of a name's own words; a word that GENERAL_NAMES names
#: of the list have is a general one.
OWN_SHARE, GENERAL_NAMES = 0.3, 5
#: Pairs whose distances are computed together, and pairs of a leaf whose letters are.
BLOCK, LEAF_BLOCK = 16_384, 2_000_000
#: Distances from which a node's children share one branch; keys over LONG characters stand apart.
FAR, LONG = 64, 512

#: Fixed list of usual abbreviations.
ABBREVIATIONS = {
    "st": "saint", "dr": "doctor", "prof": "professor", "univ": "university", "dept": "department", "inst": "institute",
    "bros": "brothers", "co": "company", "corp": "corporation", "mt": "mount", "jct": "junction", "hbr": "harbour", "harbor": "harbour",
    "soc": "society", "assn": "association", "intl": "international", "pt": "part",
}
#: Words that stand for others only where a reference name has those.
SHORT_FORMS = {"river": "r", "mount": "m", "lake": "l"}
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "‘": "'", "`": "'", "´": "'"})
_TAILS = {"jr", "sr", "junior", "senior", "ltd", "limited", "inc", "llc", "plc", "gmbh", "esq", "phd"}
_NUMBERS = {"1": "one", "2": "two", "3": "three", "i": "one", "ii": "two", "iii": "three"}
_OUTER = " \t\"'“”„«»‹›[]{}<>*_.,;:!?|/\\-–—"


def folded(text: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFKD", text.casefold().translate(_LETTERS))
    return "".join(c for c in plain if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def _key(text: str) -> str:
    words = re.findall(r"[^\W_]+", text.replace("'", "").replace("&", " and "))
    while words and words[0] == "the":
        words = words[1:]
    while len(words) > 1 and words[-1] in _TAILS:
        words = words[:-1]
    words = [ABBREVIATIONS.get(w, w) for w in words]
    words = [_NUMBERS.get(w, w) if k and words[k - 1] == "part" else w for k, w in enumerate(words)]
    return " ".join(words)


def keys_of(value: str) -> list[str]:
    """Keys that a typed value may mean, the plainest first."""
    text = re.sub(r"[\s_]+", " ", folded(value)).strip(_OUTER)
    out = [text]
    bare = text
    while (less := re.sub(r"\s*[(\[{][^()\[\]{}]*[)\]}]?\s*$", "", bare).strip(_OUTER)) and less != bare:
        bare = less
    bare = re.sub(r"\s+[-–—]+\s+[^-–—]*$", "", bare).strip(_OUTER) or bare
    if bare != text:
        out = [bare, text]
    head, comma, tail = (bare or text).rpartition(",")
    if comma:
        tail_words = tail.split()
        if len(tail_words) == 1 and tail_words[0].strip(".") in _TAILS:
            out.insert(0, head)
        else:
            out += [f"{tail} {head}", head]
    keys = [_key(t) for t in out]
    # a misspelt article
    keys += [rest for first, _, rest in (k.partition(" ") for k in keys) if 2 <= len(first) <= 4 and slips(first, "the") == 1]
    return [k for k in dict.fromkeys(keys) if k]


def name_keys(name: str, kind: str | None = None) -> list[str]:
    """Keys under which a reference name is held: its own, and that with initials or short forms."""
    key = _key(folded(name))
    words = key.split()
    out = [key]
    if kind == "person" and len(words) >= 2:
        titles = 1 if len(words) > 2 else 0
        out.append(" ".join(words[:titles] + [w[0] for w in words[titles:-1]] + words[-1:]))
    if len(words) >= 2:
        short = [SHORT_FORMS.get(w, w) for w in words]
        if short != words:
            out.append(" ".join(short))
    return out


def levenshtein(a: str, b: str) -> int:
    """Of two texts, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slips(a: str, b: str, most: int = 1 << 30) -> int:
    """Edits of which an exchange of two neighbouring letters is one (optimal string alignment); any
    number over ``most`` where there are more. Only the band that can hold so few is filled."""
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    far = most + 1
    before: list[int] = []
    row = list(range(lb + 1))
    for i in range(1, la + 1):
        x = a[i - 1]
        lo, hi = max(1, i - most), min(lb, i + most)
        new = [far] * (lb + 1)
        if i <= most:
            new[0] = i
        for j in range(lo, hi + 1):
            y = b[j - 1]
            d = row[j - 1] if x == y else 1 + min(row[j], new[j - 1], row[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            new[j] = d
        before, row = row, new
    return row[lb]


class Codes:
    """Characters of the reference keys as small numbers; 0 is any other character."""

    def __init__(self, keys: list[str]) -> None:
        self.points = np.array(sorted({ord(c) for key in keys for c in key} | {0}), np.uint32)
        self.size = len(self.points) + 1
        # two bits for each of the first 26 characters' first and second occurrence, the rest in groups
        common = [c for c, _ in Counter(c for key in keys for c in key).most_common(26)]
        self.bit = np.zeros(self.size, np.int64)
        for k, point in enumerate(self.points, 1):
            c = chr(point)
            self.bit[k] = 2 * common.index(c) if c in common else 52 + k % 12

    def rows(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Coded characters (-1 behind the end) and lengths."""
        lengths = np.array([len(k) for k in keys], np.int64)
        width = max(1, int(lengths.max(initial=1)))
        points = np.array(keys, f"U{width}").view(np.uint32).reshape(len(keys), width)
        at = np.searchsorted(self.points, points)
        known = (at < len(self.points)) & (self.points[np.minimum(at, len(self.points) - 1)] == points)
        coded = np.where(known, at + 1, 0).astype(np.int16)
        coded[np.arange(width) >= lengths[:, None]] = -1
        return coded, lengths

    def bags(self, coded: np.ndarray) -> np.ndarray:
        """The letters of each key in 64 bits, of which one slip sets or clears at most one each."""
        out = np.zeros(len(coded), np.uint64)
        one = np.uint64(1)
        for column in coded.T:
            bit = self.bit[np.maximum(column, 0)].astype(np.uint64)
            here = np.where(column > 0, one << bit, np.uint64(0))
            again = np.where((column > 0) & (bit < 52), (out & here) << one, np.uint64(0))
            out |= here | again
        return out

    def masks(self, coded: np.ndarray) -> np.ndarray:
        """For each key and character the positions where it stands; keys of at most 64 characters."""
        masks = np.zeros((len(coded), self.size), np.uint64)
        rows = np.arange(len(coded))
        for i, column in enumerate(coded.T[:64]):
            masks[rows, np.maximum(column, 0)] |= np.where(column > 0, np.uint64(1) << np.uint64(i), np.uint64(0))
        masks[:, 0] = 0
        return masks


def distances(masks: np.ndarray, sizes: np.ndarray, q: np.ndarray, texts: np.ndarray, lengths: np.ndarray, t: np.ndarray, exchanges: bool = False) -> np.ndarray:
    """Levenshtein distances of the pairs (q, t) by Myers' bit vectors (in Hyyrö's form), with an exchange of
    neighbours as one edit if ``exchanges``. ``masks``: for each query and character the positions
    where it stands, ``texts``: coded keys."""
    one = np.uint64(1)
    pv = np.full(len(q), ~np.uint64(0))
    mv = np.zeros(len(q), np.uint64)
    d0 = np.zeros(len(q), np.uint64)
    before = np.zeros(len(q), np.uint64)
    score = sizes[q].astype(np.int64)
    last = (sizes[q] - 1).astype(np.uint64)
    ends = lengths[t]
    shortest = int(ends.min(initial=0))
    for j in range(int(ends.max(initial=0))):
        eq = masks[q, np.maximum(texts[t, j], 0)]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        if exchanges:
            xh |= ((~d0 & eq) << one) & before
            d0, before = xh | mv, eq
        ph = mv | ~(xh | pv if not exchanges else d0 | pv)
        mh = pv & (xh if not exchanges else d0)
        change = ((ph >> last) & one).astype(np.int64) - ((mh >> last) & one).astype(np.int64)
        ph = (ph << one) | one
        mh <<= one
        v = d0 if exchanges else xv
        if j < shortest:
            score += change
            pv = mh | ~(v | ph)
            mv = ph & v
        else:
            live = ends > j
            score += np.where(live, change, 0)
            pv = np.where(live, mh | ~(v | ph), pv)
            mv = np.where(live, ph & v, mv)
    return score


def long_distances(a: np.ndarray, sizes: np.ndarray, q: np.ndarray, texts: np.ndarray, lengths: np.ndarray, t: np.ndarray, exchanges: bool = False) -> np.ndarray:
    """The same for queries that do not fit a machine word, row by row for all pairs at once. ``a``: coded
    queries."""
    width = int(lengths[t].max(initial=0))
    b = texts[t][:, :width]
    at = np.arange(width + 1)
    row = np.broadcast_to(at, (len(q), width + 1)).copy()
    before = row
    out = lengths[t].copy()
    pick = np.arange(len(q))
    for i in range(int(sizes[q].max(initial=0))):
        x = a[q, i][:, None]
        new = np.empty_like(row)
        new[:, 0] = i + 1
        # unknown characters of a query (0) equal none of a key
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (x != b))
        if exchanges and i:
            swapped = (x == b[:, :-1]) & (a[q, i - 1][:, None] == b[:, 1:])
            new[:, 2:] = np.where(swapped, np.minimum(new[:, 2:], before[:, :-2] + 1), new[:, 2:])
        new = np.minimum.accumulate(new - at, axis=1) + at
        before, row = row, new
        done = sizes[q] == i + 1
        out[done] = row[pick[done], lengths[t][done]]
    return out


class Tree:
    """BK-tree over (key, entity ids)."""

    def __init__(self, names: list[tuple[int, str, str | None]], leaf: int = LEAF) -> None:
        owners: dict[str, set[int]] = defaultdict(set)
        full = {_key(folded(name)) for _, name, _ in names}
        for entity, name, kind in names:
            for k, key in enumerate(name_keys(name, kind)):
                if key and (k == 0 or key not in full):
                    owners[key].add(entity)
        uses = Counter(w for name in full for w in set(name.split()))
        self.general = {w for w, n in uses.items() if n >= GENERAL_NAMES}
        # short keys that several entries share denote none of them
        self.keys = sorted(k for k, ids in owners.items() if k in full or len(ids) == 1)
        self.entities = [sorted(owners[k]) for k in self.keys]
        self.exact = {k: n for n, k in enumerate(self.keys)}
        self.names = {entity: name.casefold() for entity, name, _ in names}
        self.listed = {name for _, name, _ in names}
        self.long = [n for n, k in enumerate(self.keys) if len(k) > LONG]
        self.codes = Codes(self.keys)
        self.texts, self.lengths = self.codes.rows([k[:LONG] for k in self.keys])
        self.bags = self.codes.bags(self.texts)
        self.slips = np.array([slips_of(k) for k in self.keys], np.int64)
        #: Keys of the inner nodes; for each of them and each distance the inner node and the leaf there.
        self.pivots: list[int] = []
        self.inner: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        self._grow(np.array([n for n, k in enumerate(self.keys) if len(k) <= LONG], np.int64), leaf)

    def _grow(self, nodes: np.ndarray, leaf: int) -> None:
        waiting: list[tuple[np.ndarray, int, int]] = [(nodes, -1, 0)] if len(nodes) else []
        while waiting:
            group, parent, label = waiting.pop()
            short = np.flatnonzero(self.lengths[group] <= 64)
            if len(group) <= leaf or not len(short):
                if parent >= 0:
                    self.leaf[parent][label] = len(self.leaves)
                self.leaves.append(group)
                continue
            pivot = group[short[0]]
            node = len(self.pivots)
            self.pivots.append(int(pivot))
            self.inner.append(np.full(FAR + 1, -1, np.int32))
            self.leaf.append(np.full(FAR + 1, -1, np.int32))
            if parent >= 0:
                self.inner[parent][label] = node
            others = group[group != pivot]
            masks = self.codes.masks(self.texts[pivot : pivot + 1])
            d = np.concatenate([np.empty(0, np.int64)] + [distances(masks, self.lengths[pivot : pivot + 1], np.zeros(len(part), np.int64), self.texts, self.lengths, part) for part in np.array_split(others, len(others) // BLOCK + 1)])
            for at in np.unique(np.minimum(d, FAR)):
                part = others[np.minimum(d, FAR) == at]
                if len(part) > leaf and 20 * len(part) > 19 * len(group):  # a pivot that parts nothing
                    self.leaf[node][at] = len(self.leaves)
                    self.leaves.append(part)
                else:
                    waiting.append((part, node, int(at)))
        self.pivots, self.inner, self.leaf = np.array(self.pivots, np.int64), np.array(self.inner).reshape(-1, FAR + 1), np.array(self.leaf).reshape(-1, FAR + 1)

    def within(self, keys: list[str]) -> list[list[tuple[int, int]]]:
        """For each key (slips, node) of every node with at most as many slips as the shorter of both may
        have."""
        out: list[list[tuple[int, int]]] = [[] for _ in keys]
        for k, key in enumerate(keys):
            for n in range(len(self.keys)) if len(key) > LONG else self.long:
                most = min(slips_of(key), int(self.slips[n]))
                if (d := slips(key, self.keys[n], most)) <= most:
                    out[k].append((d, n))
        for fits in ([k for k, key in enumerate(keys) if 0 < len(key) <= 64], [k for k, key in enumerate(keys) if 64 < len(key) <= LONG]):
            if fits:
                for k, d, n in self._search([keys[k] for k in fits]):
                    out[fits[k]].append((d, n))
        return out

    def _search(self, keys: list[str]) -> Iterator[tuple[int, int, int]]:
        coded, sizes = self.codes.rows(keys)
        allowed = np.array([slips_of(k) for k in keys], np.int64)
        bags = self.codes.bags(coded)
        short = int(sizes.max()) <= 64
        measure, shape = (distances, self.codes.masks(coded)) if short else (long_distances, coded)
        radius = 2 * allowed  # an exchange is two edits of the metric
        most = int(radius.max())
        test_q, test_t, leaf_q, leaf_b = [], [], [], []
        if not len(self.pivots) and self.leaves:  # a list so short that it is one leaf
            leaf_q.append(np.arange(len(keys)))
            leaf_b.append(np.zeros(len(keys), np.int64))
        q = np.arange(len(keys) if len(self.pivots) else 0)
        t = np.zeros(len(q), np.int64)
        while len(q):
            next_q, next_t = [], []
            for s in range(0, len(q), BLOCK):
                qs, ts = q[s : s + BLOCK], t[s : s + BLOCK]
                d = measure(shape, sizes, qs, self.texts, self.lengths, self.pivots[ts])
                near = d <= radius[qs]
                test_q.append(qs[near])
                test_t.append(self.pivots[ts[near]])
                for step in range(-most, most + 1):
                    able = (abs(step) <= radius[qs]) & (d + step > 0) & (d + step < FAR)
                    self._down(qs[able], ts[able], (d + step)[able], next_q, next_t, leaf_q, leaf_b)
                able = d + radius[qs] >= FAR
                self._down(qs[able], ts[able], np.full(int(able.sum()), FAR), next_q, next_t, leaf_q, leaf_b)
            q, t = np.concatenate(next_q), np.concatenate(next_t)
        lq, lb = np.concatenate(leaf_q or [np.empty(0, np.int64)]), np.concatenate(leaf_b or [np.empty(0, np.int64)])
        order = np.argsort(lb, kind="stable")
        lq, lb = lq[order], lb[order]
        starts = np.flatnonzero(np.diff(lb, prepend=-2))
        for start, part in zip(starts, np.split(lq, starts[1:])) if len(lq) else ():
            members = self.leaves[int(lb[start])]
            step = max(1, LEAF_BLOCK // len(members))
            for s in range(0, len(part), step):
                some = part[s : s + step]
                a, b = bags[some][:, None], self.bags[members][None, :]
                most_here = np.minimum(allowed[some][:, None], self.slips[members][None, :])
                apart = np.maximum(np.bitwise_count(a & ~b), np.bitwise_count(b & ~a))
                apart = np.maximum(apart, np.abs(sizes[some][:, None] - self.lengths[members][None, :]))
                x, y = np.nonzero(apart <= most_here)
                test_q.append(some[x])
                test_t.append(members[y])
        tq, tt = np.concatenate(test_q or [np.empty(0, np.int64)]), np.concatenate(test_t or [np.empty(0, np.int64)])
        order = np.argsort(self.lengths[tt], kind="stable")
        for s in range(0, len(order), BLOCK):
            qs, ts = tq[order[s : s + BLOCK]], tt[order[s : s + BLOCK]]
            d = measure(shape, sizes, qs, self.texts, self.lengths, ts, True)
            for k in np.flatnonzero(d <= np.minimum(allowed[qs], self.slips[ts])):
                yield int(qs[k]), int(d[k]), int(ts[k])

    def _down(self, qs: np.ndarray, ts: np.ndarray, labels: np.ndarray, next_q: list, next_t: list, leaf_q: list, leaf_b: list) -> None:
        below, leaf = self.inner[ts, labels], self.leaf[ts, labels]
        next_q.append(qs[below >= 0])
        next_t.append(below[below >= 0].astype(np.int64))
        leaf_q.append(qs[leaf >= 0])
        leaf_b.append(leaf[leaf >= 0].astype(np.int64))


def slips_of(key: str) -> int:
    """Slips that a key may have."""
    return min(MAX_SLIPS, len(key) // CHARS_PER_SLIP)


def admissible(key: str, name: str, general: set[str], n: int | None = None) -> int | None:
    """Slips (``n``, if known) between a typed and a reference key, if few enough: on the whole, and in the
    words that are not general."""
    most = min(slips_of(key), slips_of(name))
    n = slips(key, name, most) if n is None else n
    if n > most:
        return None
    typed, words = key.split(), name.split()
    own = [k for k, w in enumerate(words) if w not in general]
    letters = sum(len(words[k]) for k in own)
    if n and letters:
        wrong = sum(slips(typed[k], words[k]) for k in own) if len(typed) == len(words) else n
        if min(wrong, n) >= OWN_SHARE * letters:
            return None
    if initial := re.match(r"(?:\w+ )?\w (?=\w)", name):
        # initials say little, so they have to stand, and the rest may differ less
        most = min(most - 1, 2) if key.startswith(initial.group()) else 0
    return n if n <= most else None


def resolve(values: list[str], trees: list[Tree]) -> list[tuple[int, int]]:
    """(entity id, slips) of each value; (0, -1) if the list holds none."""
    keys = [keys_of(v) for v in values]
    found: list[dict[int, tuple[int, str]]] = [{} for _ in values]  # entity -> fewest slips, its name

    def offer(k: int, n: int, tree: Tree, node: int) -> None:
        for entity in tree.entities[node]:
            if entity not in found[k] or n < found[k][entity][0]:
                found[k][entity] = (n, tree.names[entity])

    for tree in trees:
        for k, own in enumerate(keys):
            for key in own:
                if key in tree.exact:
                    offer(k, 0, tree, tree.exact[key])
                    break
    missing = [k for k in range(len(values)) if not found[k]]
    asked = [(k, key) for k in missing for key in keys[k] if slips_of(key)]
    for tree in trees:
        for (k, key), hits in zip(asked, tree.within([key for _, key in asked])):
            for d, node in hits:
                if (n := admissible(key, tree.keys[node], tree.general, d)) is not None:
                    offer(k, n, tree, node)
    out = []
    for value, options in zip(values, found):
        if not options:
            out.append((0, -1))
            continue
        fewest = min(n for n, _ in options.values())
        ties = [(e, name) for e, (n, name) in options.items() if n == fewest]
        if len(ties) > 1:
            ties.sort(key=lambda x: (levenshtein(value.casefold(), x[1]), x[0]))
        out.append((ties[0][0], fewest))
    return out


def _trees(entities: DataFrame, shard_names: int) -> Iterator[Tree]:
    shard: list[tuple[int, str, str | None]] = []
    for r in entities.select("entity_id", "canonical_name", "kind").filter("canonical_name is not null").toLocalIterator():
        shard.append((r["entity_id"], r["canonical_name"], r["kind"]))
        if len(shard) == shard_names:
            yield Tree(shard)
            shard = []
    if shard:
        yield Tree(shard)


def denoted(triples: DataFrame, entities: DataFrame, shard_names: int = SHARD_NAMES) -> DataFrame:
    """(triple_id, field_name, entity_id, distance): for every value of ``subject`` and ``obj`` that
    is neither null nor blank nor a canonical name, the entry it denotes, or 0."""
    spark = triples.sparkSession
    # one broadcast for each tree, so that a long list is never one object
    shared = [spark.sparkContext.broadcast(tree) for tree in _trees(entities, shard_names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [s.value for s in shared]
        for batch in batches:
            rows = [(v, n) for v, n in zip(batch.column("value").to_pylist(), batch.column("n").to_pylist()) if v.strip() and not any(v in tree.listed for tree in trees)]
            meant = resolve([v for v, _ in rows], trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64()), pa.array([e for e, _ in meant], pa.int64()), pa.array([d for _, d in meant], pa.int32())],
                names=["value", "n", "entity_id", "distance"],
            )

    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("subject", "obj")])).alias("x")
    typed = triples.select("triple_id", ends).select("triple_id", "x.field_name", "x.value").filter("value is not null")
    counted = typed.groupBy("value").agg(F.count("*").alias("n"))
    # as many parts as there are cores at least: a value costs far more than its move
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    meant = written(counted.repartition(parts, F.xxhash64("value")).mapInArrow(run, "value string, n long, entity_id long, distance int"))
    total = meant.agg(F.sum("n")).head()[0] or 0
    return hot_join(typed, meant, "value", "triple_id", "n", total, "inner").select("triple_id", "field_name", "entity_id", "distance")
