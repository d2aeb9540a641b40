"""A corpus from raw documents to packed token ids, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeshred.llm import bitpack, decontam, mixing, quality, setsketch
from treeshred.llm.common import release, table, tables_written, written
from treeshred.llm.queries import tokenizer_path

#: A classifier and sketches have no SQL form; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


class _Rows:
    """A stage's input under names of our own (c0, c1, ...), so that no column of it can clash with a stage's."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.df = docs.toDF(*[f"c{i}" for i in range(len(self.names))])

    def at(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def core(self) -> DataFrame:
        """doc_id, text and source alone."""
        return self.df.select(F.col(self.at("doc_id")).cast("long").alias("doc_id"), F.col(self.at("text")).cast("string").alias("text"), F.col(self.at("source")).cast("string").alias("source"))

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(self.names)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned on the labelled ones among them, gives 0.3 or more.

    Null and empty texts have a score like others, and rows with a null doc_id too; repeated rows all stay or all go.
    An empty table stays empty. Without labels of both kinds the score is their share. Other columns pass through."""
    rows = _Rows(docs)
    model = quality.train(rows.core(), table(spark, sf_dir, "labels"))
    return rows.back(quality.score(rows.df, model, keep=rows.df.columns, text=rows.at("text")).where("_predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id; of rows that share a doc_id one,
    the first by a hash of all its columns. Rows without doc_id, and texts without words but for that, stay."""
    rows = _Rows(docs)
    own = F.col(rows.at("doc_id")).cast("long")
    dropped = written(setsketch.near_duplicates(rows.core()).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    left = rows.df.join(dropped, own == F.col("_dropped"), "left_anti")
    repeated = written(rows.df.groupBy(own.alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 and _again is not null").select("_again"), "repeated")
    first = Window.partitionBy(own).orderBy(F.xxhash64(rows.at("text")), F.xxhash64(*left.columns))
    some = left.join(repeated, own == F.col("_again"), "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.back(left.join(repeated, own == F.col("_again"), "left_anti")).unionByName(rows.back(some))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands.

    Null and empty texts hold none and stay, as do rows without doc_id; rows that share a doc_id go together. An empty
    table or benchmark drops nothing."""
    rows = _Rows(docs)
    found = written(decontam.leaks(rows.core(), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    return rows.back(rows.df.join(found, F.col(rows.at("doc_id")).cast("long") == F.col("_leaked"), "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The queue's turns, a whole document each: a turn in which the queue is cut counts if at least half of it is served.

    Rows equal in doc_id, text and source are told apart by a hash of all their columns: the n-th has the n-th one's
    turns, so reruns agree. Texts without words (null and empty ones) have no turns and go; a null source or doc_id is a
    value like others."""
    rows = _Rows(docs)
    source = F.col(rows.at("source")).cast("string")
    turns = mixing.queue(rows.core()).where(F.col("words") * 2 >= F.col("size"))
    alike = Window.partitionBy("_h", "_source").orderBy("_before")
    copies = turns.groupBy(F.col("h").alias("_h"), F.col("source").alias("_source"), F.col("before").alias("_before")).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    copies = written(copies.withColumn("_nth", F.row_number().over(alike)), "copies")
    key = mixing.shuffle_key(F.col(rows.at("doc_id")).cast("long"), F.col(rows.at("text")).cast("string"), 7)
    named = rows.df.withColumn("_key", key).withColumn("_place", F.row_number().over(Window.partitionBy("_key", source).orderBy(F.xxhash64(*rows.df.columns))))
    kept = named.join(copies, (F.col("_key") == F.col("_h")) & source.eqNullSafe(F.col("_source")) & (F.col("_place") == F.col("_nth")))
    return rows.back(kept.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


def packed_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the files, read back from them. A null text has the end id alone; null doc_ids
    come first; repeated rows have each their own ids."""
    return bitpack.encode_and_read(_Rows(docs).core(), tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("packed ids", packed_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each stage's result written to the shared folder and read by the next. What
    a stage has written for itself, and its input, are dropped when its result is written."""
    docs, since = table(spark, sf_dir, "documents"), tables_written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
            release(spark, since, f"stage{k}-")
    return docs
