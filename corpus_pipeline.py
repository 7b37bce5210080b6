"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its result is written and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicframe.llm import catalog, decontaminate, near_dups, packing, pii, quality
from civicframe.llm.common import cut, mark, scratch, shared_path, small, table, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects, each judged where it is read."""
    return quality.keep(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, and one of repeated rows.

    Rows without an id go where a row with one is alike; of those alike among themselves one stays. Texts without words are alike to none.
    """
    classes = cut(near_dups.classes(docs), "classes")
    left = without(docs.select(*COLUMNS), classes.where(~F.col("kept")))
    again = classes.where("kept and n_shingles > 0").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = cut(again, "repeated")
    if again.isEmpty():
        return left
    named = small(again.select(F.col("doc_id").alias("again_id"), F.col("mark").alias("again_mark")))
    rows = docs.select(*COLUMNS)
    repeated = rows.join(named, rows.doc_id.eqNullSafe(named.again_id) & (mark(rows.text) == named.again_mark), "left_semi")
    return without(left, again).unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return without(docs.select(*COLUMNS), decontaminate.hits(docs, table(spark, sf_dir, "benchmark")))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced; n_chars is that of the new text."""
    new = pii.pseudonymize(docs.select(*COLUMNS), catalog.key(spark), count=None)
    return new.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    pieces = packing.pack(docs, catalog.tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES = [("quality rules", keep_quality), ("near-dedup", keep_one_of_each), ("decontamination", keep_uncontaminated), ("pseudonyms", pseudonyms), ("packing", packed)]
#: A learned list, an LSH forest and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "pipeline-" + name.replace(" ", "-"))
        with scratch(spark, "stage"):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
