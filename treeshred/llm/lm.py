"""Language-model scores from a weighted backoff automaton whose counts are spread over the cluster.

States are histories of one word (and the start of a text), arcs are the bigrams seen, and each state has a failure arc
to the unigram state. Absolute discounting gives the weights: of a state h seen c(h) times with n(h) different arcs,
    arc (h, w):      (c(hw) - D) / c(h) + f(h) * P(w)
    failure arc:     f(h) = D * n(h) / c(h), followed by P(w) = (c(w) + 1) / (N + V + 1)
so each state's probabilities sum to one; an unseen history fails with weight 1. A text is read once from left to
right; the state after a word is that word's.

No task holds the automaton. Documents form blocks; a block asks for the counts of its own words and bigrams, in lists
by bucket of the key space; buckets add what the training rows of all blocks say and answer each list in its order.
With the answers a block builds the part of the automaton that its texts can reach, and reads them. Histories that make
more than HOT of all tokens have their bigrams spread over all buckets; there are at most 1 / HOT of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _STEP, Words, held_out, mix, slices, texts, written

DISCOUNT, HOT = 0.9, 1e-3
START, END = np.uint64(0x51A27), np.uint64(0xE7D)  # as word hashes: of no word, up to chance
SHORT = np.uint64((1 << 40) - 1)  # what of a word's hash tells it from other words after the same history
BLOCK_BYTES, BUCKET_WORDS = 6 << 20, 1 << 20


class Block:
    """The tokens of some texts: history and word of each, and the distinct ones in the order in which they are asked."""

    def __init__(self, values: list[bytes | None], train: np.ndarray, buckets: int, hot: np.ndarray):
        words = Words(values)
        n = np.diff(words.first) + 1
        self.ends = np.cumsum(n)
        self.begins = self.ends - n
        at_end = np.zeros(int(n.sum()), bool)
        at_end[self.ends - 1] = True
        self.word = np.empty(len(at_end), np.uint64)
        self.word[~at_end], self.word[at_end] = words.hashes, END
        self.train = np.repeat(train, n)
        history = np.empty_like(self.word)
        history[1:] = self.word[:-1]
        history[self.begins] = START
        # Words, with the start among them.
        names, self.word_at = np.unique(self.word, return_inverse=True)
        counts = np.bincount(self.word_at[self.train], minlength=len(names))
        self.names, self.counts = np.append(names, START), np.append(counts, int(train.sum()))
        self.history_at = np.empty_like(self.word_at)
        self.history_at[1:] = self.word_at[:-1]
        self.history_at[self.begins] = len(names)
        self.name_bucket = (self.names % np.uint64(buckets)).astype(np.int64)
        self.name_order = np.lexsort((self.names, self.name_bucket))
        # Bigrams, by the place of their history.
        self.keys, first, self.key_at = np.unique(mix(history * np.uint64(_STEP) + (self.word & SHORT)), return_index=True, return_inverse=True)
        self.short = self.word[first] & SHORT
        del history
        self.key_counts = np.bincount(self.key_at[self.train], minlength=len(self.keys))
        self.key_history = self.history_at[first]
        own = self.names[self.key_history]
        self.key_bucket = np.where(np.isin(own, hot), self.keys % np.uint64(buckets), own % np.uint64(buckets)).astype(np.int64)
        self.key_order = np.lexsort((self.keys, own, self.key_bucket))

    def requests(self) -> Iterator[tuple]:
        """For each bucket: words, their counts, bigrams, their histories (as words and run lengths), their counts."""
        a, b = self.name_order, self.key_order
        for bucket in np.union1d(self.name_bucket, self.key_bucket):
            u = a[slice(*np.searchsorted(self.name_bucket[a], [bucket, bucket + 1]))]
            k = b[slice(*np.searchsorted(self.key_bucket[b], [bucket, bucket + 1]))]
            own = self.names[self.key_history[k]]
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            yield int(bucket), self.names[u], self.counts[u], self.short[k], own[edge], np.diff(np.append(edge, len(own))), self.key_counts[k]


def _bytes(x: np.ndarray, kind: str) -> bytes:
    """As little-endian numbers; u5: the low five bytes of each; z: counts, which are small, compressed."""
    if kind == "z":
        return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())
    if kind == "u5":
        return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return x.astype(kind).tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    if kind == "z":
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
        return np.ascontiguousarray(planes.T).view("<u8")[:, 0]
    if kind == "u5":
        out = np.zeros((len(data) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
        return out.view("<u8")[:, 0]
    return np.frombuffer(data, kind)


def _unique_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    names, first, at = np.unique(keys, return_index=True, return_inverse=True)
    return names, first, at, np.bincount(at, counts, len(names)).astype(np.int64)


def answer(group: pa.Table, hot: np.ndarray) -> pa.Table:
    """Adds a bucket's lists and answers each in its own order; the first answer carries the bucket's totals."""
    col = lambda name, kind: [_numbers(x, kind) for x in group.column(name).to_pylist()]
    names, n_counts = col("names", "<u8"), col("counts", "z")
    keys, k_counts, own, runs = col("short", "u5"), col("key_counts", "z"), col("own", "<u8"), col("runs", "z")
    join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)])
    all_names = join(names, np.uint64)
    histories = np.repeat(join(own, np.uint64), join(runs, np.uint64).astype(np.int64))
    all_keys = mix(histories * np.uint64(_STEP) + join(keys, np.uint64))
    words, _, word_at, c = _unique_sums(all_names, join(n_counts, np.uint64))
    _, first, key_at, ck = _unique_sums(all_keys, join(k_counts, np.uint64))
    seen, arcs = np.unique(histories[first][ck > 0], return_counts=True)
    n = np.zeros(len(words), np.int64)
    if len(seen) and len(words):
        at = np.minimum(np.searchsorted(seen, words), len(seen) - 1)
        n = np.where(seen[at] == words, arcs[at], 0)
    warm = np.isin(seen, hot)
    own_words = words != START
    out, i, k = [], 0, 0
    for row, (a, b) in enumerate(zip(names, keys, strict=True)):
        u, v = word_at[i : i + len(a)], key_at[k : k + len(b)]
        i, k = i + len(a), k + len(b)
        out.append((_bytes(c[u], "z"), _bytes(n[u], "z"), _bytes(ck[v], "z"), int(c[own_words].sum()) if not row else 0, int((c[own_words] > 0).sum()) if not row else 0, _bytes(seen[warm], "<u8") if not row else b"", _bytes(arcs[warm], "<u8") if not row else b""))
    parts = list(zip(*out, strict=True))
    return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), **{name: pa.array(parts[i], pa.binary() if name not in ("tokens", "types") else pa.int64()) for i, name in enumerate(("c", "n", "ck", "tokens", "types", "hot", "hot_n"))}})


class Automaton:
    """The part of the model that a block reaches: states are its words and the start, arcs its bigrams."""

    def __init__(self, c: np.ndarray, n: np.ndarray, arc_state: np.ndarray, arc_word: np.ndarray, arc_count: np.ndarray, tokens: int, types: int):
        self.unigram = (c + 1) / (tokens + types + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.failure = np.where(c > 0, DISCOUNT * n / c, 1.0)
            self.arc = (arc_count - DISCOUNT) / c[arc_state] + self.failure[arc_state] * self.unigram[arc_word]
            self.arc_weight = np.where(arc_count > 0, np.log10(self.arc), np.nan)  # not a number: no such arc
            self.failure_weight, self.base = np.log10(self.failure), np.log10(self.unigram)
        self.arc = np.where(arc_count > 0, self.arc, self.failure[arc_state] * self.unigram[arc_word])

    def read(self, arcs: np.ndarray, words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Model and base score of each text, whose tokens follow each other in ``words``; ``arcs`` has, for each token, the
        arc by which it would leave the state before it. A text is walked once, from the last state (the start): by the
        arc where there is one, and else by the state's failure arc and on from the unigram state."""
        if not len(begins):
            return np.zeros(0), np.zeros(0)
        arc, failure, base = self.arc_weight.tolist(), self.failure_weight.tolist(), self.base.tolist()
        model, start = np.empty(len(begins)), len(failure) - 1
        for i, (b, e) in enumerate(zip(begins, np.append(begins[1:], len(words)), strict=True)):
            state, total = start, 0.0
            for a, w in zip(arcs[b:e].tolist(), words[b:e].tolist(), strict=True):
                weight = arc[a]
                if weight != weight:
                    weight = failure[state] + base[w]
                total += weight
                state = w
            model[i] = total
        return model, np.add.reduceat(self.base[words], begins)


def score(docs: DataFrame, mod: int = 7, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of (doc_id, text, ...).

    Words are lower-cased (A-Z) runs of other than space and 09-0D; one end follows them, so an empty or null text has
    one token. Rows whose crc32(doc_id) leaves ``rest`` modulo ``mod`` are held out, all others are learned from; rows
    with a null doc_id are learned from. Repeated rows count as often as they stand.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = max(1, -(-total // (6 * BUCKET_WORDS)))
    rows = rows.withColumn("out", held_out(F.col("doc_id"), mod, rest)).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=8 << 20, rows=4096):
            names, counts = np.unique(Words(texts(b)).hashes, return_counts=True)
            yield pa.record_batch([pa.array(names.view(np.int64)[counts > HOT / 4 * counts.sum()]), pa.array(counts[counts > HOT / 4 * counts.sum()])], ["word", "n"])

    # Where keys go does not change any count: this only spreads the histories with the most arcs.
    words = max(1, total // 6)
    often = rows.mapInArrow(frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > HOT * words).select("word")
    hot = np.sort(np.array([r[0] for r in often.collect()] + [int(START), int(END)], np.int64)).view(np.uint64)

    def block_of(t: pa.Table) -> Block:
        return Block(t.column("text").cast(pa.binary()).to_pylist(), ~np.array(t.column("out").to_pylist(), bool), buckets, hot)

    def ask(t: pa.Table) -> pa.Table:
        found = list(block_of(t).requests())
        own = t.column("block")[0].as_py()
        cols = list(zip(*found, strict=True))
        kinds = {"names": "<u8", "counts": "z", "short": "u5", "own": "<u8", "runs": "z", "key_counts": "z"}
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "block": pa.array([own] * len(found), pa.int64()), **{k: pa.array([_bytes(x, v) for x in cols[i + 1]], pa.binary()) for i, (k, v) in enumerate(kinds.items())}})

    asked = rows.groupBy("block").applyInArrow(ask, "bucket long, block long, names binary, counts binary, short binary, own binary, runs binary, key_counts binary")
    answers = written(asked.groupBy("bucket").applyInArrow(lambda t: answer(t, hot), "block long, bucket long, c binary, n binary, ck binary, tokens long, types long, hot binary, hot_n binary"), "answers")
    totals = answers.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = totals[0] or 0, totals[1] or 0
    arcs: dict[int, int] = {}
    for r in answers.where(F.octet_length("hot") > 0).select("hot", "hot_n").toLocalIterator():  # at most 1 / HOT words a bucket
        for w, k in zip(np.frombuffer(r["hot"], "<u8").tolist(), np.frombuffer(r["hot_n"], "<u8").tolist(), strict=True):
            arcs[w] = arcs.get(w, 0) + k
    hot_words = np.array(sorted(arcs), np.uint64)
    hot_arcs = np.array([arcs[w] for w in sorted(arcs)], np.int64)

    def read(t: pa.Table, found: pa.Table) -> pa.Table:
        b = block_of(t)
        found = found.sort_by("bucket")
        col = lambda name, kind: np.concatenate([_numbers(x, kind) for x in found.column(name).to_pylist()]).astype(np.int64)
        c, n, ck = np.zeros(len(b.names), np.int64), np.zeros(len(b.names), np.int64), np.zeros(len(b.keys), np.int64)
        c[b.name_order], n[b.name_order], ck[b.key_order] = col("c", "z"), col("n", "z"), col("ck", "z")
        if len(hot_words):
            at = np.minimum(np.searchsorted(hot_words, b.names), len(hot_words) - 1)
            n = np.where(hot_words[at] == b.names, hot_arcs[at], n)
        arc_word = np.zeros(len(b.keys), np.int64)
        arc_word[b.key_at] = b.word_at
        model, base = Automaton(c, n, b.key_history, arc_word, ck, tokens, types).read(b.key_at, b.word_at, b.begins)
        known = np.add.reduceat((c[b.word_at] > 0).astype(np.int64), b.begins)
        return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("out"), "n_tokens": pa.array(b.ends - b.begins), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(known), tokens)), "base_score": pa.array(base), "score": pa.array(model)})

    slim = answers.select("block", "bucket", "c", "n", "ck")
    return rows.groupBy("block").cogroup(slim.groupBy("block")).applyInArrow(read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
