"""Near duplicates by SetSketch registers (Ertl, 2021).

A register is the truncated logarithm, to a base just over 1, of the minimum of exponential variates: registers of a
union are the maxima of the registers, and equal registers are as likely as the sets are alike. Bands of registers
give candidates; the joint likelihood of two sketches (their exact sizes being known) drops those far below the
threshold; what is left is confirmed on the full sets of shingles.

Candidates never become all pairs of a bucket. A bucket first tests its members against one of them. Buckets whose
members then still lie in different components are searched with a row a member (in blocks, where they are large), where
a pair that is already joined is skipped and only a spanning forest of confirmed links comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, forget, mix, shingle_hashes, slices, texts, written
from .graph import components

BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
ROWS, BANDS = 5, 40  # at similarity 0.75 a pair shares no band with probability (1 - 0.75**5)**40 = 2e-5
REGISTERS = ROWS * BANDS
SLACK = 0.14  # 4.5 standard deviations of the estimate from 200 registers at 0.75
BLOCK = 8192  # members of a bucket that one task searches, a long text counting as several

_SEEDS = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = (_SEEDS[:REGISTERS] >> np.uint64(32)).astype(np.uint32), (_SEEDS[REGISTERS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """For each register the least of its hash over the set."""
    low = np.full(REGISTERS, np.uint32(0xFFFFFFFF))
    keys = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(keys), 256):
        x = keys[i : i + 256, None] ^ _XOR
        x *= _ODD
        np.minimum(low, x.min(axis=0), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """Minima of uniform hashes as SetSketch registers: floor(1 - log_b(x)), x the exponential variate, cut to 0..q+1."""
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch; the band's number is part of it."""
    r = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2])
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, i])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 100) -> np.ndarray:
    """The similarity of greatest joint likelihood, for rows of registers and the sets' sizes."""
    over, under = (a > b).sum(1), (a < b).sum(1)
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.arange(grid + 1)[None, :] / grid * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    same = np.clip(1 - up - down, 1e-12, 1)
    score = over[:, None] * np.log(up) + under[:, None] * np.log(down) + (a.shape[1] - over - under)[:, None] * np.log(same)
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def _sets(batch: pa.RecordBatch, name: str = "text") -> Iterator[np.ndarray]:
    w = Words(texts(batch, name))
    for i in range(batch.num_rows):
        yield np.unique(shingle_hashes(w.of(i)))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, regs) of (doc_id, text); digest is the same for equal sets and null for empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forget()
        for b in slices(batches):
            sets = list(_sets(b))
            low = np.array([minima(s) for s in sets]).reshape(-1, REGISTERS)
            regs = registers(low)
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    b.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "digest", "regs"],
            )

    return _named(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, regs binary")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        if b.num_rows:
            keys = band_keys(np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint16))
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))), pa.array(np.repeat(b.column("rep").to_numpy(), BANDS))], ["key", "band", "rep"])


def _plausible(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            if b.num_rows:
                side = lambda x: np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                j = estimate(side("ra"), side("rb"), b.column("na").to_numpy().astype(float), b.column("nb").to_numpy().astype(float))
                yield b.select(["a", "b"]).filter(pa.array(j >= threshold - SLACK))

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y|, for sorted distinct hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches, "tb", 128):
            keep = [similar(x, y, percent) for x, y in zip(_sets(b, "ta"), _sets(b, "tb"), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _forest(percent: int, threshold: float):
    """Links that join components within a block of a bucket, or between two of its blocks. Two members are compared in
    the first band that they share only, so a family that meets in many bands is searched once."""

    def run(group: pa.Table) -> pa.Table:
        ids, labels, side = group.column("rep").to_numpy(), group.column("label").to_numpy().copy(), group.column("block").to_numpy()
        band = group.column("band")[0].as_py()
        cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(regs)
        sizes = group.column("n_shingles").to_numpy().astype(float)
        sets: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.unique(shingle_hashes(Words([group.column("text")[i].as_py().encode()]).hashes))
            return sets[i]

        found = []
        for i in range(len(ids) - 1):
            others = labels[i + 1 :] != labels[i]
            if cross:
                others &= side[i + 1 :] != side[i]
            others = np.flatnonzero(others) + i + 1
            if len(others):
                others = others[(keys[others] == keys[i]).argmax(1) == band]
                others = others[(regs[others] == regs[i]).sum(1) >= (threshold - 1.7 * SLACK) * REGISTERS]
            if not len(others):
                continue
            j = estimate(np.broadcast_to(regs[i], (len(others), REGISTERS)), regs[others], np.full(len(others), sizes[i]), sizes[others])
            for k in others[np.argsort(-j)][: int((j >= threshold - SLACK).sum())]:
                if labels[k] != labels[i] and similar(of(i), of(k), percent):
                    labels[labels == labels[k]] = labels[i]
                    found.append((int(ids[i]), int(ids[k])))
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})

    return run


def _blocks(full: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of buckets with the blocks ``i`` and ``j`` that they are searched in; a bucket of up to BLOCK is one block
    and has a row a member. Of a larger one the members that are already joined to its largest part meet only the others,
    and the others meet all, so it is the others alone that have a row more for each further block."""
    weight = 1 + F.col("n_shingles") / 256  # a long text counts as so many
    parts = sizes.groupBy("key", "label").agg(F.sum(weight).alias("w"))
    whole = parts.groupBy("key").agg(F.sum("w").alias("all"), F.max(F.struct("w", "label")).alias("top"))
    one = F.col("all") <= BLOCK
    many = lambda w: F.greatest(F.lit(1), F.ceil(w / BLOCK)).cast("int")
    plan = whole.select("key", F.when(~one, F.col("top.label")).alias("largest"), F.when(one, 1).otherwise(many(F.col("all") - F.col("top.w"))).alias("few"), F.when(one, 0).otherwise(many(F.col("top.w"))).alias("more"))
    j = full.join(plan, "key").withColumn("_joined", F.coalesce(F.col("label") == F.col("largest"), F.lit(False)))
    h = F.xxhash64("rep", F.lit(7))
    j = j.withColumn("block", F.when(F.col("_joined"), F.col("few") + F.pmod(h, F.greatest(F.col("more"), F.lit(1)))).otherwise(F.pmod(h, F.col("few"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("_joined"), F.col("few")).otherwise(F.col("few") + F.col("more")) - 1))
    return j.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("largest", "few", "more", "other", "_joined")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text, ...).

    A text's set: its distinct 5-word shingles, or the whole sequence of fewer words. Texts are linked whose sets have
    100 * intersection >= percent * union. component_id: the least doc_id reachable; kept: doc_id is that. Empty and
    null texts have no shingles and are linked with nothing. Rows with one doc_id are one document: what any of them
    is linked with, all are, and each has its own row. A null doc_id keeps its row, is linked with nothing, has no
    component and is kept.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    sk = written(sketches(docs), "sketches")
    some = sk.where("digest is not null and doc_id is not null")
    classes = written(some.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")), "classes")
    # A class of equal sets goes by a hash of its digest: one doc_id may stand for several sets.
    keyed = classes.select(F.xxhash64("digest").alias("rep"), "digest", "least.doc_id", "least.text_hash", "n_shingles", "regs")
    banded = written(keyed.select("rep", "regs").mapInArrow(_banded, "key long, band int, rep long"), "bands")
    several = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lead")).where("n > 1")
    members = written(banded.join(several, "key"), "members")
    pairs = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    regs = keyed.select("rep", "regs", "n_shingles")
    both = pairs.join(regs.toDF("a", "ra", "na"), "a").join(regs.toDF("b", "rb", "nb"), "b")
    likely = written(both.mapInArrow(_plausible(threshold), "a long, b long"), "likely")

    def with_text(wanted: DataFrame) -> DataFrame:
        """The whole text of each class wanted: that of its least document."""
        named = keyed.select("rep", "doc_id", "text_hash").join(wanted.distinct(), "rep")
        found = _named(docs).join(named, ["doc_id", "text_hash"])
        return written(found.groupBy("rep").agg(F.first("text").alias("text")), "texts")

    wanted = likely.select(F.col("a").alias("rep")).union(likely.select(F.col("b").alias("rep")))
    have = with_text(wanted)
    full = likely.join(have.toDF("a", "ta"), "a").join(have.toDF("b", "tb"), "b").select(F.col("a").alias("u"), F.col("b").alias("v"), "ta", "tb")
    links = written(full.mapInArrow(_confirmed(percent), "u long, v long"), "links")
    first = components(links)

    labelled = members.where("n > 2").join(first.toDF("rep", "component"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    mixed = labelled.groupBy("key").agg(F.first("band").alias("band"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("lo <> hi")
    mixed = mixed.groupBy("size", "who").agg(F.min(F.struct("band", "key")).alias("of")).select("of.key", "size")  # buckets with the same members are searched once
    searched = written(labelled.select("key", "band", "rep", "label").join(mixed.select("key"), "key"), "searched")
    full = searched.join(regs, "rep").join(with_text(searched.select("rep")), "rep")
    extra = written(_blocks(full, searched.join(regs, "rep")).groupBy("key", "i", "j").applyInArrow(_forest(percent, threshold), "u long, v long"), "links")

    ids = keyed.select("rep", "doc_id")
    all_links = links.union(extra).join(ids.toDF("u", "x"), "u").join(ids.toDF("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    # One doc_id with several sets ties their classes together.
    several = some.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    own = some.join(several, "doc_id").join(keyed.select("digest", F.col("doc_id").alias("v")), "digest").select(F.col("doc_id").alias("u"), "v")
    final = components(all_links.union(own))
    whole = keyed.select("digest", "doc_id").join(final.toDF("doc_id", "component"), "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component"))
    out = sk.select("doc_id", "n_shingles", "digest").join(whole, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))
