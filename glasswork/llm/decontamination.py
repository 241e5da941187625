"""Benchmark decontamination with SimHash windows of the items' size.

Every window of a document that is as long as a benchmark item has a 64-bit
SimHash of its words. A multi-index over the items' fingerprints returns all
within Hamming distance 7: of four 16-bit blocks at least one then differs in
at most one bit, so each block value and its 16 neighbours are listed per
fingerprint. Every hit is verified by the exact similarity of five-word
shingles, weighted by how often they occur.

Window sizes follow a grid with steps of a fifth. An item is listed with the
fingerprints of all its windows of one size, no longer than the run of words
that every copy with enough similarity has in common with it, so a window of
such a copy always meets an equal fingerprint; verification uses the window of
the item's own size around it.

The per-bit sums of all windows come from bit-sliced counters: 64 columns are
added at once, windows of 2, 4, 8, ... words from two halves, other sizes from
their binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glasswork.llm.inputs import importable, texts
from glasswork.llm.pieces import hashed_words, mix, shingles, tool, weighted, weighted_jaccard

RADIUS = 7
SIMILARITY = 0.8
BLOCK_CHARS = 4_000_000
# Characters searched at once: the planes of their words stay in the caches of a core.
_BATCH_CHARS = 1 << 16
_ONE, _ALL = np.uint64(1), np.uint64(2**64 - 1)


def grid_size(words: int) -> int:
    """The largest size of the grid that is not above ``words``."""
    size = 1
    while (step := size + max(1, size // 5)) <= words:
        size = step
    return size


def common_run(words: int, similarity: float) -> int:
    """The longest run of words that a copy of an item must share with it to reach ``similarity``.

    Of the item's shingles at most ``lost`` can be missing. A word changed between
    two runs costs five of them, so there are at most ``lost // 5 + 1`` runs that
    hold shingles, and the longest has its share of those that are left.
    """
    all_shingles = max(1, words - 4)
    lost = int(all_shingles * (1 - similarity) / (1 + similarity) + 1e-9)
    return min(words, 4 - (lost - all_shingles) // (lost // 5 + 1))


class Windows:
    """Fingerprints of all windows of a run of word hashes."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.doubles = [[mix(hashes)]]

    def _power(self, k: int) -> list[np.ndarray]:
        """Bit planes of the sums over ``2**k`` words from each position on; positions past the end hold rubbish."""
        while len(self.doubles) <= k:
            half, step = self.doubles[-1], 1 << (len(self.doubles) - 1)
            self.doubles.append(_add(half, [_ahead(p, step) for p in half]))
        return self.doubles[k]

    def fingerprints(self, size: int) -> np.ndarray:
        """SimHash per start position; those with ``start + size > n`` are not windows."""
        total, at = None, 0
        for k in range(size.bit_length() - 1, -1, -1):
            if size >> k & 1:
                part = self._power(k)
                total = part if total is None else _add(total, [_ahead(p, at) for p in part])
                at += 1 << k
        return _at_least(total, size // 2 + 1)


def _ahead(plane: np.ndarray, step: int) -> np.ndarray:
    return np.concatenate([plane[step:], np.zeros(min(step, len(plane)), np.uint64)])


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Planes of the sums of two bit-sliced numbers."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i, x in enumerate(a):
        if i < len(b):
            either, both = x ^ b[i], x & b[i]
            if carry is None:
                out.append(either)
                carry = both
            else:
                out.append(either ^ carry)
                carry = both | (either & carry)
        else:
            out.append(x ^ carry)
            carry = x & carry
    return [*out, carry]


def _at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    """Bits whose sum is at least ``least``."""
    over, equal = np.zeros(len(planes[0]), np.uint64), np.full(len(planes[0]), _ALL)
    if least >> len(planes):
        return over
    for i in range(len(planes) - 1, -1, -1):
        if least >> i & 1:
            equal &= planes[i]
        else:
            over |= equal & planes[i]
            equal &= ~planes[i]
    return over | equal


class HammingIndex:
    """All listed fingerprints within distance 7 of a query: four 16-bit blocks, each within one bit."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        blocks = prints.view("<u2").reshape(-1, 4) if len(prints) else np.zeros((0, 4), np.uint16)
        near = np.concatenate([np.zeros(1, np.uint16), np.uint16(1) << np.arange(16, dtype=np.uint16)])
        self.listed, self.starts, self.entries = [], [], []
        for b in range(4):
            values = (blocks[:, b, None] ^ near).ravel()
            owners = np.repeat(np.arange(len(prints)), len(near))
            order = np.argsort(values, kind="stable")
            counts = np.bincount(values, minlength=1 << 16)
            self.listed.append(counts > 0)
            self.starts.append(np.concatenate([[0], np.cumsum(counts)]))
            self.entries.append(owners[order])

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, fingerprint number) of every pair within the radius, once each."""
        blocks = np.ascontiguousarray(queries).view("<u2").reshape(-1, 4)
        found = []
        for b in range(4):
            hit = np.flatnonzero(self.listed[b][blocks[:, b]])
            value = blocks[hit, b].astype(np.int64)
            first, sizes = self.starts[b][value], self.starts[b][value + 1] - self.starts[b][value]
            query = np.repeat(hit, sizes)
            within = np.arange(len(query)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            entry = self.entries[b][np.repeat(first, sizes) + within]
            near = np.bitwise_count(queries[query] ^ self.prints[entry]) <= RADIUS
            found.append(query[near] * len(self.prints) + entry[near])
        pairs = np.unique(np.concatenate(found))
        return (pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints)))


class ItemIndex:
    """Benchmark items by window size, ready to search documents."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.items = [(i, h) for i, text in items if len(h := hashed_words([text or ""])[0])]
        self.words = np.array([len(h) for _, h in self.items], np.int64)
        self.profiles = [weighted(shingles(h)) for _, h in self.items]
        runs = np.concatenate([np.zeros(0, np.uint64), *[p[0] for p in self.profiles]])
        self.known = np.zeros(1 << max(16, (16 * len(runs)).bit_length()), bool)
        self.known[runs & np.uint64(len(self.known) - 1)] = True
        listed: dict[int, list] = {}
        for number, (_, h) in enumerate(self.items):
            size = grid_size(common_run(len(h), similarity))
            prints = Windows(h).fingerprints(size)[: len(h) - size + 1]
            listed.setdefault(size, []).append((prints, np.full(len(prints), number), np.arange(len(prints))))
        self.sizes = {}
        for size, parts in sorted(listed.items()):
            prints, numbers, offsets = (np.concatenate(x) for x in zip(*parts))
            self.sizes[size] = (HammingIndex(prints), numbers, offsets)

    def search(self, found: list[str]) -> Iterator[tuple[int, int, int, float]]:
        """(text number, item number, start word, similarity), the best window per text and item."""
        a = chars = 0
        for k, text in enumerate(found):
            chars += len(text)
            if k == len(found) - 1 or chars >= _BATCH_CHARS:
                for t, item, start, s in self._search(*hashed_words(found[a: k + 1])):
                    yield a + t, item, start, s
                a, chars = k + 1, 0

    def _hopeful(self, words: np.ndarray, first: np.ndarray, length: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which windows can reach the similarity: at most their shingles that some item has are in common."""
        runs = self.known[shingles(words) & np.uint64(len(self.known) - 1)]
        upto = np.concatenate([[0], np.cumsum(runs)])
        common = upto[np.minimum(first + length - 4, len(runs))] - upto[np.minimum(first, len(runs))]
        most = common / np.maximum(1, length - 4 + self.words[item] - 4 - common)
        return (most >= self.similarity - 1e-9) | (length < 5) | (self.words[item] < 5)

    def _search(self, words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        if len(words) == 0:
            return
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(words))  # words from here to the end of the text
        owner = np.repeat(np.arange(len(lengths)), lengths)
        windows, spots = Windows(words), []
        for size, (index, numbers, offsets) in self.sizes.items():
            places = np.flatnonzero(left >= size)
            if len(places) == 0:
                continue
            query, entry = index.search(windows.fingerprints(size)[places])
            t, item = owner[places[query]], numbers[entry]
            start = places[query] - offsets[entry] - (ends - lengths)[t]
            spots.append(np.stack([t, item, np.maximum(0, np.minimum(start, lengths[t] - self.words[item]))]))
        t, item, start = np.unique(np.concatenate([np.zeros((3, 0), np.int64), *spots], 1), axis=1)
        first, length = start + (ends - lengths)[t], np.minimum(self.words[item], lengths[t])
        best = {}
        for i in np.flatnonzero(self._hopeful(words, first, length, item)):
            key = int(t[i]), int(item[i])
            s = weighted_jaccard(weighted(shingles(words[first[i]: first[i] + length[i]])), self.profiles[key[1]])
            if s >= self.similarity and s > best.get(key, (0, 0.0))[1]:
                best[key] = (int(start[i]), s)
        for key, (at, s) in sorted(best.items()):
            yield *key, at, s


_BLOCKS = count()


def _index(number: int, items: list, similarity: float) -> ItemIndex:
    """One index per Python worker and block of items."""
    return tool(("items", number), lambda: ItemIndex(items, similarity))


def item_blocks(items: DataFrame, item_col: str, text_col: str, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``chars`` characters, so what is broadcast is bounded however many there are."""
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // chars))
    for b in range(blocks):
        yield [(r.i, r.t) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]


def find_items(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, similarity): the best window of each document for each item it holds.

    Words are lower-case runs of letters and digits. Texts and items that are
    null or hold no word match nothing; an item of fewer than five words is one
    shingle. Repeated rows are searched each, null ids stay null. No row is
    shuffled: the items go to the documents, block by block.
    """
    out = None
    for block in item_blocks(items, item_col, item_text_col):
        number = next(_BLOCKS)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            index = _index(number, shared.value, similarity)
            for batch in batches:
                ids = batch["_id"].to_pylist()
                rows = [(ids[t], index.items[i][0], start, len(index.items[i][1]), s)
                        for t, i, start, s in index.search(batch["_text"].to_pylist())]
                types = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)],
                    names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

        part = texts(docs, id_col, text_col).mapInArrow(
            search, "doc_id long, item_id long, start_word long, n_words long, similarity double")
        out = part if out is None else out.unionAll(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all columns, that hold no window similar to any item; nothing is shuffled."""
    importable(docs.sparkSession)
    for block in item_blocks(items, item_col, item_text_col):
        number = next(_BLOCKS)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            index = _index(number, shared.value, similarity)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for t, *_ in index.search([t or "" for t in batch[text_col].to_pylist()]):
                    clean[t] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
