"""Approximate nearest neighbours by cross-polytope hashing (Andoni et al., 2015).

A table turns unit vectors by three rounds of random signs and a fast Hadamard transform and assigns each to the
nearest of the 2 * d signed axes. A query looks into its PROBES nearest axes of each table. What it meets there is
ranked by the cosine of the original vectors, in double precision, inside the bucket's blocks; only each block's best
leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

TABLES, PROBES, BLOCK = 12, 8, 2048
SPARE = 8  # candidates beyond k that are ranked exactly; more where more are as near as the k-th


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, whose length is a power of two, scaled to keep lengths."""
    n = x.shape[1]
    step = 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def axes(x: np.ndarray, table: int, probes: int = 1, seed: int = 11) -> np.ndarray:
    """The nearest signed axes of each unit vector in a table's rotation, nearest first: i for +i, width + i for -i."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    z = np.concatenate((y, -y), axis=1)
    return np.argsort(-z, axis=1, kind="stable")[:, :probes]


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _spread(many: int):
    """A row for each table and axis: the vector's own one, or the axes a query probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.frombuffer(v, "<f8") for v in b.column("v").to_pylist()]
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                part = b.take(pa.array(at))
                x = _unit([vectors[i] for i in at])
                for t in range(TABLES):
                    found = axes(x, t, many)
                    for k in range(found.shape[1]):
                        key = (int(d) << 32) + t * (1 << 24) + found[:, k]
                        yield pa.record_batch([pa.array(key, pa.int64()), part.column("vec_id"), part.column("v")], ["bucket", "vec_id", "v"])

    return run


def best(queries: np.ndarray, query_ids: np.ndarray, found: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of each query's k nearest rows other than its own; ties to the smaller id."""
    q, x = _unit(queries), _unit(found)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    out = []
    for i in range(0, len(q), 256):
        own, part = query_ids[i : i + 256], q[i : i + 256]
        s = part @ x.T
        s[own[:, None] == ids[None, :]] = -np.inf
        # A matrix product may give equal vectors products that differ in the last bits: it only proposes, some more
        # than k, and what is proposed is summed again in one order for all.
        many = min(k + SPARE, len(ids))
        top = np.argpartition(-s, many - 1, axis=1)[:, :many]
        least = np.take_along_axis(s, top, 1)
        kth = -np.partition(-least, min(k, many) - 1, axis=1)[:, min(k, many) - 1]
        crowded = (many < len(ids)) & (least.min(1) >= kth - 1e-12)
        for r in range(len(part)):
            at = np.flatnonzero(s[r] >= kth[r] - 1e-12) if crowded[r] and np.isfinite(kth[r]) else top[r]
            at = at[np.isfinite(s[r, at])]
            exact = (part[r] * x[at]).sum(1)
            best_first = np.lexsort((ids[at], -exact))[:k]
            out.append((np.full(len(best_first), own[r]), ids[at][best_first], exact[best_first]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _ranked(k: int):
    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
        col = lambda t: [np.frombuffer(v, "<f8") for v in t.column("v").to_pylist()]
        a, b, c = best(col(q), q.column("vec_id").to_numpy(), col(x), x.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": pa.array(a), "vec_id": pa.array(b), "near": pa.array(c)})

    return run


def _in_blocks(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, near): the k best of each bucket's blocks. Rows and queries of a bucket are both dealt to blocks of
    about BLOCK, and each block of queries meets each block of rows, so no task holds more than one of either."""
    block = lambda many, name: F.ceil(many / BLOCK).cast("int").alias(name)
    rows = index.groupBy("bucket").agg(block(F.count(F.lit(1)), "blocks"))
    asks = queries.groupBy("bucket").agg(block(F.count(F.lit(1)), "parts"))
    sizes = written(rows.join(asks, "bucket"), "sizes")
    deal = lambda df, own, other: df.join(sizes, "bucket").withColumn(own[0], F.pmod(F.xxhash64("vec_id"), F.col(own[1])).cast("int")).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1))).drop("blocks", "parts")
    dealt = deal(index, ("block", "blocks"), ("part", "parts"))
    asked = deal(queries, ("part", "parts"), ("block", "blocks"))
    return asked.groupBy("bucket", "block", "part").cogroup(dealt.groupBy("bucket", "block", "part")).applyInArrow(_ranked(k), "query_id long, vec_id long, near double")


def _first(found: DataFrame, k: int) -> DataFrame:
    """Each query's first k; a vector met in several tables counts once, by its greatest score."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
    order = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vectors(embeddings: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v: doubles as little-endian bytes) of the rows that take part."""
    own = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("vec_id"), pa.array([np.array(v, "<f8").tobytes() for v in b.column("e").to_pylist()], pa.binary())], ["vec_id", "v"])

    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", finite) & F.exists("e", lambda x: x != 0)
    return own.where(F.coalesce(good, F.lit(False))).mapInArrow(run, "vec_id long, v binary")


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine that the tables find, for each row whose vec_id is divisible by ``every``.

    Candidates are all rows but those with the query's own vec_id. Vectors null, zero, or holding null, NaN or
    infinities take no part, nor do rows without vec_id. Vectors of different lengths are not compared. Repeated rows
    of one vec_id are one. Of equal vectors only the k + 1 with the smallest ids can be among a query's first k, so only
    these are indexed, however many there are. A query that finds fewer than k in its buckets is compared with all rows.
    """
    some = written(vectors(embeddings).distinct(), "vectors")
    alike = Window.partitionBy("v").orderBy("vec_id")
    index = written(some.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).drop("_n"), "index")
    queries = some.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0)
    schema = "bucket long, vec_id long, v binary"
    spread = written(index.mapInArrow(_spread(1), schema), "spread")
    found = written(_first(_in_blocks(queries.mapInArrow(_spread(PROBES), schema), spread, k), k), "found")
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = written(queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti"), "short")
    if short.limit(1).count():
        whole = F.octet_length("v").cast("long").alias("bucket")
        rest = _first(_in_blocks(short.select(whole, "vec_id", "v"), index.select(whole, "vec_id", "v"), k), k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("near").alias("score"))
