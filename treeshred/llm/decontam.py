"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, weighted verification.

An item's fingerprint has 96 bits, each the majority of a hash bit over its shingles, each as often as it stands. Every
window of a document that is as long as an item is fingerprinted the same way, from running sums. (Windows are cut in
lengths on a grid of steps of at most 6 percent, one of which is within 3 percent of any item's. Stretches of a document
that hold no shingle of any item have no window that is similar to one, and are passed over.) Two fingerprints within
RADIUS agree in one of six blocks of 16 bits up to RADIUS // 6 bits: for each block the index lists the items under all
values so near to theirs, and the lists under a window's values name every item within the radius, and few others. Whole
distances follow, then the weighted similarity of the multisets of shingles, over item-sized windows around the place.

At similarity 0.75 a bit differs with probability 0.17, so a window differs from its item in 16.5 of 96 bits, with
deviation 3.7; RADIUS is 3.4 deviations above. A block's lists hold 3.8 percent of random values an item, so a random
window is compared with a fifth of the items of its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, kept, mix, shingle_hashes, slices, texts

SIZE, RADIUS, BLOCKS = 5, 29, 6
MOST_ITEM_BYTES, MOST_ITEMS = 64 << 20, 4096  # of one index: 60 KB an item
PIECE = 1 << 17  # shingles fingerprinted at once: 50 MB of running sums
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
_BALL = np.flatnonzero(_POP <= RADIUS // BLOCKS).astype(np.uint16)


def _bits(hashes: np.ndarray) -> np.ndarray:
    both = np.concatenate((hashes.view(np.uint8).reshape(-1, 8), mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)).view(np.uint8).reshape(-1, 8)), axis=1)
    return np.unpackbits(both[:, : 2 * BLOCKS], axis=1, bitorder="little")


def fingerprints(sums: np.ndarray, length: int) -> np.ndarray:
    """Of each window of ``length`` shingles, from running sums of their bits (a row more than shingles): a row of blocks."""
    return np.packbits(sums[length:] - sums[:-length] > length // 2, axis=1, bitorder="little").view(np.uint16)


def running(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes) + 1, 16 * BLOCKS), np.int16 if len(hashes) < 1 << 15 else np.int32)
    np.cumsum(_bits(hashes), axis=0, out=out[1:])
    return out


class Index:
    """Items of one step by the blocks of their fingerprints: for each block the values near any item's, sorted, and the
    item of each."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.lists = prints, []
        for b in range(BLOCKS):
            values = (prints[:, b, None] ^ _BALL).ravel()
            order = np.argsort(values, kind="stable")
            self.lists.append((values[order], (order // len(_BALL)).astype(np.uint16)))

    def named(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the pairs that share a list, once each."""
        found = []
        for b, (values, items) in enumerate(self.lists):
            lo, hi = np.searchsorted(values, prints[:, b], "left"), np.searchsorted(values, prints[:, b], "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            found.append(np.repeat(np.arange(len(prints)), n) * len(self.prints) + items[at])
        return np.divmod(np.unique(np.concatenate(found)), len(self.prints))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within the radius."""
        w, i = self.named(prints)
        close = _POP[prints[w] ^ self.prints[i]].sum(1) <= RADIUS
        return w[close], i[close]


def grid(lengths: list[int]) -> dict[int, int]:
    """Each length's step: short lengths are steps themselves, the others within 3 percent of one."""
    out, step = {}, 0
    for n in sorted(set(lengths)):
        if not step or n > step * 1.03:
            step = max(n, int(n * 1.03))
        out[n] = step
    return out


class Items:
    """The benchmark's items, with an index of fingerprints for each step of length."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = 0.75):
        self.threshold = threshold
        self.items = []
        for item_id, text in items:
            w = Words([text])
            if len(w.hashes):
                s = shingle_hashes(w.hashes, SIZE)
                self.items.append((item_id, len(w.hashes), s, Counter(s.tolist()), fingerprints(running(s), len(s))[0]))
        self.all = np.unique(np.concatenate([x[2] for x in self.items])) if self.items else np.zeros(0, np.uint64)
        self.some = np.zeros(1 << 22, bool)  # by the first 22 bits: whether any item has such a shingle
        self.some[(self.all >> np.uint64(42)).astype(np.int64)] = True
        steps = grid([len(x[2]) for x in self.items if x[1] >= SIZE])
        by_step: dict[int, list[int]] = {}
        for i, x in enumerate(self.items):
            if x[1] >= SIZE:
                by_step.setdefault(steps[len(x[2])], []).append(i)
        self.sizes = np.array([len(x[2]) for x in self.items], np.int64)
        self.short = [i for i, x in enumerate(self.items) if x[1] < SIZE]
        self.by_step = {step: (np.array(who), Index(np.stack([self.items[i][4] for i in who]))) for step, who in by_step.items()}

    def windows(self, hashes: np.ndarray, before: np.ndarray, begin: int) -> list[tuple[int, int]]:
        """(item, place) of every window of ``hashes`` within the radius of an item of its length, unless no item-sized
        window around it can be similar: ``before`` counts the whole text's shingles of any item up to each place;
        ``hashes`` begin at ``begin``."""
        found = []
        sums = running(hashes)
        n, end = len(hashes), len(before) - 1
        for step, (who, index) in self.by_step.items():
            length = min(step, n)  # a text a little shorter than the step is one window
            if length < 0.7 * step:
                continue
            w, i = index.near(fingerprints(sums, length))
            place, size = w + begin, self.sizes[who[i]]
            around = before[np.minimum(end, place + size + size // 4)] - before[np.maximum(0, place - size // 4)]
            good = around >= self.threshold * size
            found.extend(zip(who[i[good]].tolist(), place[good].tolist(), strict=True))
        return found

    def leaks(self, words: np.ndarray) -> dict[int, tuple[float, int]]:
        """For each item found: its greatest similarity with a window of its size, and that window's first word."""
        out: dict[int, tuple[float, int]] = {}
        if not len(words) or not self.items:
            return out
        hashes = shingle_hashes(words, SIZE)
        hit = self._hit(hashes)
        before = np.concatenate(([0], np.cumsum(hit)))
        # A window without any shingle of any item has similarity 0 with all: the stretches around shared shingles,
        # as far as the longest window reaches, are what is fingerprinted.
        candidates = []
        if before[-1] and len(words) >= SIZE and self.by_step:
            longest = max(self.by_step)
            reach = longest + longest // 4
            at = np.flatnonzero(hit)
            gap = np.flatnonzero(np.diff(at) > 2 * reach)
            for a, b in zip(at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)], strict=True):
                lo, hi = max(0, int(a) - reach), min(len(hashes), int(b) + reach)
                for k in range(lo, max(lo + 1, hi - longest), PIECE):
                    candidates += self.windows(hashes[k : min(hi, k + PIECE + longest)], before, k)
        done: set[tuple[int, int]] = set()
        for i, place in candidates:
            item_id, _, shingles, weights, _ = self.items[i]
            n = len(shingles)
            lo, hi = max(0, place - n // 4), min(len(hashes), place + n + n // 4)
            for k in range(lo, max(lo, hi - n) + 1):
                if (i, k) in done:
                    continue
                done.add((i, k))
                end = min(len(hashes), k + n)
                if before[end] - before[k] >= self.threshold * n:
                    like = weighted(Counter(hashes[k:end].tolist()), weights)
                    if like >= self.threshold and like > out.get(item_id, (0.0, 0))[0]:
                        out[item_id] = (like, k)
        for i in self.short:
            item_id, n, shingles, _, _ = self.items[i]
            if len(words) >= n:
                runs = _runs(words, n)
                at = np.flatnonzero(runs == shingles[0])
                if len(at):
                    out[item_id] = (1.0, int(at[0]))
        return out

    def _hit(self, hashes: np.ndarray) -> np.ndarray:
        out = self.some[(hashes >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.all[np.minimum(np.searchsorted(self.all, hashes[at]), len(self.all) - 1)] == hashes[at]
        return out


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    return shingle_hashes(words, n)


def weighted(a: Counter, b: Counter) -> float:
    """Sum of the lesser over sum of the greater weights."""
    both = sum(min(n, b[x]) for x, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, item_id, similarity, first_word) of each benchmark item that stands in a document, whole texts read.

    An item stands in a document if a window of as many 5-word shingles has a weighted similarity of ``threshold`` or
    more with it; an item of fewer than five words, if it stands there word for word. first_word: where the best
    such window begins, from 0. Null and empty texts and items hold and are nothing. Repeated document rows repeat
    their leaks; repeated items are reported by their least item_id and null item_ids are left out. The benchmark's
    size is checked before it goes to all tasks: over 64 MB of text or 4,096 items it is taken in parts of about that size.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // MOST_ITEM_BYTES), -(-items.count() // MOST_ITEMS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for part in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        found = rows.mapInArrow(_search([(r["item_id"], r["text"].encode()) for r in mine.orderBy("item_id").collect()], threshold), "doc_id long, item_id long, similarity double, first_word long")
        out = found if out is None else out.union(found)
    return out


def _items(items: list[tuple[int, bytes]], threshold: float) -> Items:
    """The index of these items, which a worker keeps."""
    return kept(("items", threshold, tuple(items)), lambda: Items(items, threshold))


def _search(items: list[tuple[int, bytes]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _items(items, threshold)
        for b in slices(batches):
            w = Words(texts(b))
            ids, found = b.column("doc_id").to_pylist(), []
            for d in range(b.num_rows):
                found += [(ids[d], i, like, k) for i, (like, k) in known.leaks(w.of(d)).items()]
            cols = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], ["doc_id", "item_id", "similarity", "first_word"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The documents in which no benchmark item stands; rows with a null doc_id stay."""
    found = leaks(docs, benchmark, threshold).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(found, docs["doc_id"] == F.col("_leaked"), "left_anti")
