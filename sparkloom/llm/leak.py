"""Evaluation texts leaking into training text.

Words are the runs of a text without white space, in lower case, without markup, entities and
punctuation. Every window of ``SEED_WORDS`` words of a test item is a pattern of a Wu-Manber
search over the words of the corpus: a shift table over blocks of two words lets the search step
over up to ``SEED_WORDS - 1`` words at once where the block is in no pattern, blocks that end
a pattern lead to a bucket of windows by suffix hash, and the words themselves are compared. Any passage of at
least ``MIN_WORDS`` item words with at most one edit in ``EDIT_EVERY`` words contains an
unchanged window of five, so the search loses none of them. From each confirmed window the passage
is grown both ways by furthest-reaching edit paths, which decide exactly.

A window is one pattern however many items have it. Of an admissible passage at least ``LEAST_WINDOWS`` different
windows are unchanged (words - 4 - 5 * edits is never less), so a text that shares a single window with an item
cannot quote it there: such pairs leave by their count before any passage is grown, and a stock phrase
that more than ``HOT_ITEMS`` items have is not even paired with them where it is the only such phrase
of a text. Pairs are made ``PAIRS`` at a time, so no phrase, however common on both sides, fills a task.

The search runs where the documents are read; nothing is shuffled. The test set goes to the
executors in blocks of at most ``BLOCK_WORDS`` words, whatever its size.

Defined results: null and blank texts and items match nothing; items of fewer than ``MIN_WORDS``
words cannot be quoted at that length and match nothing; repeated items and repeated texts each
come out under their own id; an empty side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
EDIT_EVERY = 7
#: The longest unchanged window that every such passage must contain.
SEED_WORDS = 5
#: Unchanged windows that every such passage has; items from which a window is hot; pairs made at once.
LEAST_WINDOWS, HOT_ITEMS, PAIRS = 2, 64, 2_000_000
#: Words of test items in one block of the broadcast tables.
BLOCK_WORDS = 2_000_000
#: Rows of text that are searched at once; words of a segment that moves as one cursor.
_ROWS, _SEGMENT = 512, 256
_TABLE = 1 << 20
_FAR = SEED_WORDS - 1


def plain_words(text: Column) -> Column:
    """The words of ``text`` joined by single blanks."""
    out = F.regexp_replace(text, r"(?i)</?[a-z][^<>]{0,200}>|&(?:nbsp|#160|#xa0);|\\[nrt](?![a-z])", " ")
    out = F.regexp_replace(out, r"(?i)&(?:quot|amp|lt|gt|apos|[lr][sd]quo|#\d{1,6}|#x[0-9a-f]{1,6});", "")
    out = F.lower(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}\s\p{Z}\x1c-\x1f\x85]+", ""))
    return F.trim(F.regexp_replace(out, r"(?U)[\s\x1c-\x1f]+", " "))


def furthest(a: list[int], b: list[int], most: int) -> list[int]:
    """For e = 0, 1, ... the most words of ``a`` that a start of ``b`` repeats with at most e edits and
    a last word that is unchanged, every edit being a changed, dropped or added word."""
    reach = {0: 0}  # diagonal (position in b minus position in a) -> position in a
    out: list[int] = []
    la, lb = len(a), len(b)
    for e in range(most + 1):
        if e:
            grown: dict[int, int] = {}
            for d, i in reach.items():
                for dd, ii in ((d, i + 1), (d + 1, i), (d - 1, i + 1)):
                    if ii <= la and 0 <= ii + dd <= lb and grown.get(dd, -1) < ii:
                        grown[dd] = ii
            reach = grown
        best = out[-1] if out else 0
        for d, i in reach.items():
            start = i
            while i < la and i + d < lb and a[i] == b[i + d]:
                i += 1
            reach[d] = i
            if i > start and i > best:
                best = i
        if not reach:
            break
        out.append(best)
        if best == la:
            break
    return out


def passage(item: list[int], doc: list[int], i: int, j: int, min_words: int = MIN_WORDS) -> tuple[int, int] | None:
    """(words, edits) of the longest admissible passage through the window at ``item[i]`` and
    ``doc[j]``; None if there is none."""
    most = len(item) // EDIT_EVERY
    right = furthest(item[i:], doc[j : j + 2 * (len(item) - i) + most], most)
    left = furthest(item[:i][::-1], doc[max(0, j - 2 * i - most) : j][::-1], most)
    best = None
    for el, wl in enumerate(left):
        for er, wr in enumerate(right):
            words, edits = wl + wr, el + er
            if words >= min_words and edits * EDIT_EVERY <= words and (best is None or words > best[0]):
                best = (words, edits)
    return best


class Patterns:
    """Tables of one block of test items: ``items`` are (id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.ids = [k for k, _ in items]
        vocabulary: dict[str, int] = {}
        self.words = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in words] for _, words in items]
        self.vocabulary = pa.array(list(vocabulary), pa.string())
        windows = [(w[k : k + SEED_WORDS], n, k) for n, w in enumerate(self.words) for k in range(len(w) - SEED_WORDS + 1)]
        at = np.array([(n, k) for _, n, k in windows], np.int32).reshape(-1, 2)
        every = np.array([w for w, _, _ in windows], np.int64).reshape(-1, SEED_WORDS)
        flat, which = np.unique(every, axis=0, return_inverse=True)
        self.shift = np.full(_TABLE, _FAR, np.uint8)
        for end in range(1, SEED_WORDS):  # the block that ends at word ``end`` of a pattern
            np.minimum.at(self.shift, self.block(flat[:, end - 1], flat[:, end]), SEED_WORDS - 1 - end)
        suffix = self.block(flat[:, -2], flat[:, -1])
        order = np.lexsort((np.arange(len(flat)), suffix))
        self.flat, self.suffix = flat[order], suffix[order]
        self.prefix = self.prefix_of(self.flat)
        # (item, position) of every place of every window, by window
        place = np.empty(len(flat), np.int64)
        place[order] = np.arange(len(flat))
        owner = place[which.ravel()]
        by = np.argsort(owner, kind="stable")
        self.at = at[by]
        self.first = np.searchsorted(owner[by], np.arange(len(flat) + 1))

    @staticmethod
    def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Table position of a block of two words."""
        return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & (_TABLE - 1)

    @staticmethod
    def prefix_of(rows: np.ndarray) -> np.ndarray:
        return rows[..., 0] * 0x1000003 + rows[..., 1]

    def search(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern) of every window of every text; ``ids`` are the word ids of all texts
        in a row (0: in no item), ``starts`` and ``ends`` bound the segments."""
        at = starts + SEED_WORDS - 1
        live = at < ends
        at, ends = at[live], ends[live]
        found_at: list[np.ndarray] = []
        found: list[np.ndarray] = []
        while len(at):
            block = self.block(ids[at - 1], ids[at])
            step = self.shift[block].astype(np.int64)
            hit = np.flatnonzero((step == 0) & (ids[at] > 0) & (ids[at - 1] > 0))
            if len(hit):
                lo = np.searchsorted(self.suffix, block[hit], "left")
                n = np.searchsorted(self.suffix, block[hit], "right") - lo
                pos = np.repeat(at[hit], n)
                pattern = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                text = ids[pos[:, None] + np.arange(-SEED_WORDS + 1, 1)]
                same = np.flatnonzero(self.prefix_of(text) == self.prefix[pattern])
                same = same[(text[same] == self.flat[pattern[same]]).all(axis=1)]
                found_at.append(pos[same] - SEED_WORDS + 1)
                found.append(pattern[same])
            at = at + np.maximum(step, 1)
            live = at < ends
            at, ends = at[live], ends[live]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item id, words, edits) for every text and item that shares a passage."""
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        flat = pc.index_in(lists.flatten(), value_set=self.vocabulary)
        ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        # long texts are cut into segments, which overlap so that no window is lost
        n_seg = np.maximum(1, -(-(offsets[1:] - offsets[:-1]) // _SEGMENT))
        row = np.repeat(np.arange(len(n_seg)), n_seg)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        starts = offsets[row] + nth * _SEGMENT
        ends = np.minimum(starts + _SEGMENT + SEED_WORDS - 1, offsets[row + 1])
        at, window = self.search(ids, starts, ends)
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        at, window = at[order], window[order]
        rows = np.searchsorted(offsets, at, "right") - 1
        many = self.first[window + 1] - self.first[window]
        # the only hot window of a text says nothing that the others do not
        hot = many > HOT_ITEMS
        kinds = np.unique(rows[hot] * len(self.flat) + window[hot]) // max(1, len(self.flat))
        lone = np.bincount(kinds, minlength=len(offsets)) < LEAST_WINDOWS
        keep = ~(hot & lone[rows])
        at, window, rows, many = at[keep], window[keep], rows[keep], many[keep]
        turns = np.flatnonzero(np.diff(rows, prepend=-1))
        sums = np.concatenate(([0], np.cumsum(many)))
        start = 0
        while start < len(turns):
            # as many whole texts as give PAIRS pairs, and one at least
            low = sums[turns[start]]
            stop = max(start + 1, int(np.searchsorted(sums[np.append(turns[1:], len(at))], low + PAIRS, "right")))
            s, e = turns[start], turns[stop] if stop < len(turns) else len(at)
            step = max(1, -(-int(sums[e] - low) // PAIRS))  # parts of the items, for a text that alone gives more
            for part in range(step):
                yield from self._grown(ids, offsets, at[s:e], window[s:e], rows[s:e], many[s:e], part, step)
            start = stop

    def _grown(self, ids: np.ndarray, offsets: np.ndarray, at: np.ndarray, window: np.ndarray, rows: np.ndarray, many: np.ndarray, part: int, step: int) -> Iterator[tuple[int, int, int, int]]:
        """(row, item id, words, edits) of the passages through some windows, for the items with number ``part`` modulo
        ``step``."""
        firsts = self.first[window]
        if step > 1:
            # places of a window are in order of their items: strided ones are cut out window by window
            lists = [self.at[f : f + m] for f, m in zip(firsts, many)]
            lists = [x[x[:, 0] % step == part] for x in lists]
            found, many = np.concatenate(lists), np.array([len(x) for x in lists])
        else:
            found = self.at[np.repeat(firsts - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        row, place = np.repeat(rows, many), np.repeat(at, many)
        pair = row * len(self.ids) + found[:, 0]
        # different windows of the item, by their places in it
        spots = np.unique(pair * (1 << 32) + found[:, 1]) >> 32
        pairs, counts = np.unique(spots, return_counts=True)
        enough = np.isin(pair, pairs[counts >= LEAST_WINDOWS])
        seeds = sorted(set(zip(row[enough].tolist(), found[enough, 0].tolist(), found[enough, 1].tolist(), place[enough].tolist())))
        seen = set(seeds)
        best: tuple[int, int] | None = None
        doc: list[int] = []
        for k, (r, n, i, j) in enumerate(seeds):
            # a window that continues the one before it belongs to the same run
            if (r, n, i - 1, j - 1) not in seen:
                doc = ids[offsets[r] : offsets[r + 1]].tolist() if k == 0 or seeds[k - 1][0] != r or not doc else doc
                got = passage(self.words[n], doc, i, j - int(offsets[r]))
                if got and (best is None or got > best):
                    best = got
            if k + 1 == len(seeds) or seeds[k + 1][:2] != (r, n):
                if best:
                    yield r, self.ids[n], *best
                best = None


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Test items in blocks; one pass over the items, one block on the driver at a time."""
    rows = items.select("item_id", plain_words(F.col("text")).alias("words")).filter("words <> ''")
    block: list[tuple[int, list[str]]] = []
    n = 0
    for r in rows.toLocalIterator():
        words = r["words"].split(" ")
        if len(words) < MIN_WORDS:
            continue
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        block.append((r["item_id"], words))
        n += len(words)
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, words, edits): for every document and test item that share a passage, its
    longest length in item words and its edits."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", plain_words(F.col("text")).alias("words")).filter("words <> ''")
    schema = "doc_id long, item_id long, words int, edits int"
    out = spark.createDataFrame([], schema)
    for block in _blocks(items, block_words):
        tables = spark.sparkContext.broadcast(Patterns(block))

        def run(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(k, _ROWS)
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[r], item, words, edits) for r, item, words, edits in tables.value.leaks(part.column("words"))]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                            names=["doc_id", "item_id", "words", "edits"],
                        )

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out
