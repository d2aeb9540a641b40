"""A quality classifier by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages of PASSAGE words. Each passage is encoded, a gated attention learned from the documents'
labels alone weighs the passages, and the weighted passage representation gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, forget, held_out, slices, texts

PASSAGE, HASHED = 64, 128
_CLASSES = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,", b"!?", b"|", b"#$%&*@^~+=<>", b"\"'()-:;/_\\[]{}`", b"\n", b" \t\r\x0b\x0c"), 1):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 11
_N_CLASSES = 12
FEATURES = _N_CLASSES + 9 + HASHED


def passages(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and where each text's begin (and the end). A text without words is one
    passage of zeros."""
    w = Words(values)
    n = np.diff(w.first)
    many = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate(([0], np.cumsum(many)))
    total = int(first[-1])
    text_of = np.repeat(np.arange(len(n)), n)
    order = np.arange(len(text_of)) - w.first[text_of]
    place = first[text_of] + order // PASSAGE
    words = np.bincount(place, minlength=total).astype(np.float64)
    some = np.maximum(words, 1)
    out = np.zeros((total, FEATURES), np.float32)
    if len(place):
        # A text's bytes from one passage's first word to the next one's belong to the first, those before all to its first.
        heads = np.flatnonzero(np.append(True, np.diff(place) > 0))
        of_byte = np.zeros(len(w.data), np.int64)
        begins = w.at[:-1]
        of_byte[begins] = first[:-1]
        of_byte[w.starts[heads]] = place[heads]
        of_byte = np.maximum.accumulate(of_byte)
        own = np.ones(len(w.data), bool)
        own[w.at[1:] - 1] = False  # what keeps the texts apart
        kinds = np.bincount(of_byte[own] * _N_CLASSES + _CLASSES[w.data[own]], minlength=total * _N_CLASSES).reshape(total, _N_CLASSES) * (words > 0)[:, None]
        out[:, :_N_CLASSES] = kinds / np.maximum(kinds.sum(1, keepdims=True), 1)
        size = (w.ends - w.starts).astype(np.float64)
        last, head = _CLASSES[w.data[w.ends - 1]], _CLASSES[w.data[w.starts]]
        same = np.append(False, (w.hashes[1:] == w.hashes[:-1]) & (place[1:] == place[:-1]))
        twice = np.append([False, False], (w.hashes[2:] == w.hashes[:-2]) & (place[2:] == place[:-2]))[: len(place)]
        distinct = np.unique(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ w.hashes, return_index=True)[1]
        mean = lambda x: np.bincount(place, x, minlength=total) / some
        dense = (mean(size) / 10, mean(size > 20), mean(last == 4), mean((last == 5) | (last == 6)), mean((head == 1) & (size > 1)), mean(size == 1), mean(same), mean(twice), np.bincount(place[distinct], minlength=total) / some)
        out[:, _N_CLASSES : _N_CLASSES + 9] = np.stack(dense, axis=1)
        bag = np.bincount(place * HASHED + (w.hashes % np.uint64(HASHED)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED)
        out[:, _N_CLASSES + 9 :] = np.sqrt(bag / some[:, None])
    return out, first


class Model:
    """Passage encoder, gated attention and scorer, in numpy."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 5):
        r = np.random.default_rng(seed)
        shapes = {"W": (FEATURES, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": (1,)}
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]), s) if k in "WVUwc" else np.zeros(s) for k, s in shapes.items()}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags of passages, with what the gradient needs; first: where bags begin, and the end."""
        p, begin = self.p, first[:-1]
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        n = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), n))
        a = e / np.repeat(np.add.reduceat(e, begin), n)
        z = np.add.reduceat(a[:, None] * h, begin, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "n": n}

    def gradient(self, f: dict[str, np.ndarray], label: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        out = (f["y"] - label) / len(label)
        g["c"], g["d"] = f["z"].T @ out, np.array([out.sum()])
        dz = np.repeat(out, f["n"])[:, None] * p["c"]
        da = (dz * f["h"]).sum(1)
        inner = np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), f["n"])
        de = f["a"] * (da - inner)
        g["w"] = (f["t"] * f["s"]).T @ de
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        g["W"], g["b"] = f["x"].T @ dh, dh.sum(0)
        return g

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 9) -> Model:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-2
        self.p["d"][0] = np.log((label.sum() + 1) / (len(label) - label.sum() + 1))
        r, m, v, step = np.random.default_rng(seed), {k: np.zeros_like(q) for k, q in self.p.items()}, {k: np.zeros_like(q) for k, q in self.p.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(label))
            for i in range(0, len(order), batch):
                own = np.sort(order[i : i + batch])
                rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in own])
                f0 = np.concatenate(([0], np.cumsum(first[own + 1] - first[own])))
                g = self.gradient(self.forward(x[rows], f0), label[own], f0)
                step += 1
                lr = rate * (1 - epoch / epochs)
                for k, q in self.p.items():
                    grad = g[k] + decay * q
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    q -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, values: list[bytes | None]) -> np.ndarray:
        x, first = passages(values)
        return self.forward(x, first)["y"] if len(values) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, most_passages: int = 24, mod: int = 5, rest: int = 0) -> Model:
    """A model of labels.quality, from at most ``most`` labelled documents and ``most_passages`` evenly spaced passages
    of each, chosen by a hash; rows whose crc32(doc_id) leaves ``rest`` modulo ``mod`` are never among them. The bounds
    keep what comes to the driver under 60 MB. A doc_id with two labels takes the lower. Without labels of both kinds
    the score is their share (0.5 without any)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("double").alias("label")).where(~held_out(F.col("doc_id"), mod, rest))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches):
            x, first = passages(texts(b))
            keep = [np.unique(np.linspace(first[i], first[i + 1] - 1, min(most_passages, first[i + 1] - first[i])).astype(int)) for i in range(b.num_rows)]
            yield pa.record_batch([b.column("doc_id"), b.column("label"), pa.array([x[k].astype("<f4").tobytes() for k in keep], pa.binary())], ["doc_id", "label", "x"])

    # A doc_id on many rows gives one bag.
    bags = rows.mapInArrow(run, "doc_id long, label double, x binary").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("x").alias("x")).orderBy("doc_id").collect()
    model = Model()
    label = np.array([r["label"] for r in bags])
    if not len(bags) or label.min() == label.max():
        for q in model.p.values():
            q[...] = 0
        share = label.mean() if len(bags) else 0.5
        model.p["d"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    parts = [np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES) for r in bags]
    first = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    return model.fit(np.concatenate(parts).astype(np.float64), first, label)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, or the columns ``keep`` with _score and _predicted; ``text`` names
    the texts' column. Whole texts are read;
    null and empty ones are a passage without features. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches):
            y = model.scores(texts(b))
            yield pa.record_batch([b.column("_id"), pa.array(y, pa.float64()), pa.array((y >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    if keep is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
        out = rows.mapInArrow(run, "doc_id long, score double, predicted int")
        return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
    wide = docs.select(*keep)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches, text):
            y = model.scores(texts(b, text))
            yield pa.record_batch([*b.columns, pa.array(y, pa.float64()), pa.array((y >= threshold).astype(np.int32))], [*b.schema.names, "_score", "_predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields)
    return wide.mapInArrow(whole, f"{fields}, _score double, _predicted int")
