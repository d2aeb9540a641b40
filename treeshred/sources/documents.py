"""Documents as rows (doc_id, source) from files or columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.validate import require_valid


def drop_bom(x: Column) -> Column:
    return F.regexp_replace(x, "^\\x{FEFF}", "")


def decode_bytes(content: Column) -> Column:
    """UTF-16 by its mark, else UTF-8, without the mark. An odd UTF-16 length or a NUL in the first two bytes gives null."""
    head = F.hex(F.substring(content, 1, 2))
    odd = F.octet_length(content) % 2 == 1
    nul = (F.substring(head, 1, 2) == "00") | (F.substring(head, 3, 2) == "00")
    wide = lambda name: F.when(~odd, F.decode(F.substring(content, F.lit(3), F.octet_length(content)), name))
    return drop_bom(F.when(head == "FFFE", wide("UTF-16LE")).when(head == "FEFF", wide("UTF-16BE")).when(nul, F.lit(None).cast("string")).otherwise(F.decode(content, "UTF-8")))


MOST_BYTES = (1 << 31) - 16  # offsets are 32-bit numbers, and what a cell can hold


def read_documents(spark: SparkSession, path: str, level: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, path, source), one document a file; doc_id is a hash of the path. The job fails at a file of more than
    ``most_bytes`` and, with a ``level``, at a document that isn't well-formed at it."""
    files = spark.read.format("binaryFile").load(path)
    why = F.concat(F.col("path"), F.lit(f" has more than {most_bytes} bytes"))
    content = F.when(F.col("length") > most_bytes, F.raise_error(why).cast("binary")).otherwise(F.col("content"))
    docs = files.select(F.xxhash64("path").alias("doc_id"), "path", decode_bytes(content).alias("source"))
    return docs if level is None else require_valid(docs, level)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, key, source) of (doc_id, source): ids of their own for documents that share one or have none. The new id
    is a hash of the old one (``key``), the source and, for equal rows, their number; so it is the same in every run."""
    alike = Window.partitionBy("doc_id", F.xxhash64("source")).orderBy("source")
    rows = docs.select("doc_id", "source").withColumn("_nth", F.row_number().over(alike))
    return rows.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "source", "_nth").alias("doc_id"), F.col("doc_id").alias("key"), "source")


def from_column(df: DataFrame, doc_id: str, source: str) -> DataFrame:
    """(doc_id, source) of a table's columns, without a leading byte-order mark."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), drop_bom(F.col(source).cast("string")).alias("source"))
