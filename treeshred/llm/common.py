"""What the operators share: words, hashes, batches, folders, prefix sums."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed by the contract: words are runs of bytes other than space and 09-0D; A-Z are lower-cased, nothing else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a text; none for a null. bytes.split() splits on exactly 20 and 09-0D."""
    return text.translate(_LOWER).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.frombuffer(_LOWER, np.uint8).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


CHUNK = 1 << 19
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _both_powers(n: int) -> list[np.ndarray]:
    if n > len(_POWERS[0]):
        size = max(CHUNK + 1, n)
        _POWERS[:] = _powers(_STEP, size), _powers(_BACK, size)
    return _POWERS


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]``, A-Z as a-z, for ascending spans that don't overlap: polynomials from
    running sums, over stretches of about CHUNK bytes; a stretch's place doesn't matter."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        part = data[starts[i] : ends[j - 1]]
        up, down = _both_powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Words:
    """The words of some texts, all at once: ``hashes`` (64 bits, of the lower-cased bytes), ``first`` (where each
    text's words begin in it, and the end) and each word's ``starts`` and ``ends`` in ``data``. Nulls have none."""

    def __init__(self, values: list[bytes | None]):
        lengths = np.array([len(v) if v else 0 for v in values], np.int64)
        self.at = np.concatenate(([0], np.cumsum(lengths + 1)))  # a space after each text keeps them apart
        data = np.frombuffer(b" ".join([v or b"" for v in values]) + b" ", np.uint8) if values else np.zeros(0, np.uint8)
        self.data = data
        word = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.at)
        self.hashes = span_hashes(data, self.starts, self.ends)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def shingle_hashes(word_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence where it is shorter; none for no words."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    k = min(size, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out *= np.uint64(_STEP)
        out += word_hashes[i : n - k + 1 + i]
    return mix(out)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", rows: int = 512, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows or bytes of text (one row at least), which bounds what a worker holds."""
    for b in batches:
        lengths = np.nan_to_num(np.array(pc.binary_length(b.column(name)).to_numpy(zero_copy_only=False), float)) if b.num_rows else []
        began, held = 0, 0
        for i, n in enumerate(lengths):
            if i > began and (held + n > size or i - began >= rows):
                yield b.slice(began, i - began)
                began, held = i, 0
            held += n
        if b.num_rows > began:
            yield b.slice(began)


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives. A worker, which tasks of many stages share, keeps one such thing at a time: it is there while
    tasks ask for the same key, and goes when one asks for another or calls forget()."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what this worker keeps and gives the memory that it has freed back to the machine. Tasks that keep nothing
    call it as they begin, so that they don't share an executor's memory with what an earlier operator kept."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
    if trim:
        trim(0)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def crc_rest(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a session on one machine has
    a local folder, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'treeshred-checkpoints')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> int:
    """Drops the tables that operators have written to the shared folder after the first ``since`` of them, but for those
    whose names begin with ``keep``: call it when no result that reads them is needed any more. Returns how many are left."""
    for path in [p for p in _WRITTEN[since:] if keep is None or not p.rsplit("/", 1)[-1].startswith(keep)]:
        drop_folder(spark, path)
        _WRITTEN.remove(path)
    return len(_WRITTEN)


def tables_written() -> int:
    return len(_WRITTEN)


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame as a table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_folder(spark, what)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The frame, to be broadcast if a count shows it to have at most so many (short) rows, and else to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def place_of(*columns: Column) -> Column:
    """An even, repeatable number in [0, 1) for a row."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def prefix_sums(df: DataFrame, group: str, order: list[str], amount: str, out: str, least: int = 1_000, most: int = 50_000) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the group that stand before this one.

    The first name in ``order`` is a column in [0, 1) that spreads rows evenly, such as place_of(). A group of any
    size is cut into ranges by it, of ``least`` to ``most`` rows and else of a quarter of a partition's share: one window
    sums inside a range, and the ranges' totals (one row each) are summed by another, so no task gets a whole group.
    Pass a written table: it is read three times.
    """
    counts = written(df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(group, "_g"), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    per_range = min(most, max(least, total // (4 * partitions(df.sparkSession))))
    counts = small(counts)
    cut = df.join(counts, df[group].eqNullSafe(counts["_g"])).withColumn("_b", F.floor(F.col(order[0]) * F.ceil(F.col("_n") / per_range)).cast("long")).drop("_n", "_g")
    sums = cut.groupBy(F.col(group).alias("_g"), F.col("_b").alias("_rb")).agg(F.sum(amount).alias("_s"))
    before = Window.partitionBy("_g").orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    sums = small(written(sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s"), "sums"))
    inner = Window.partitionBy(group, "_b").orderBy(*[F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_in", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    found = inside.join(sums, inside[group].eqNullSafe(sums["_g"]) & (inside["_b"] == sums["_rb"]))
    return found.withColumn(out, F.col("_before") + F.col("_in")).drop("_b", "_before", "_in", "_g", "_rb")
