"""A search index of postings, so that a query reads its own terms and, for the best hits, only the blocks that may hold one.

A posting is a term in a field of a document: its frequency, its places, and its share of BM25 but for the term's rarity. Documents are turned into postings where they lie, block by
block, and each task writes its own by buckets of terms, sorted by term and field: nothing is shuffled, and a document's words are stored once. Of each term, field and block there is one row:
the number of postings, the highest share, and the postings themselves. For the best k the former bound what a document of each block may score: the blocks with the highest bounds are read
first, then those whose bound reaches the k-th score found. Phrases come from the places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from civicframe.operators.search import PHRASE, TITLES, TYPES, field_weights
from civicframe.session import ship

#: Documents in a block, buckets of terms, and blocks that are read before any is skipped.
BLOCK, BUCKETS, FIRST = 4096, 64, 8
#: A block of long documents ends at so many bytes, but holds a document at least; a task turns one block at a time.
BYTES = 1 << 22
K1, B = 1.2, 0.75
#: Decimals that scores are ranked by, as sums of doubles depend on their order.
DECIMALS = 6


def bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


#: White space, to Spark and to Arrow.
SPACE = r"[ \t\n\x0B\f\r]+"


def _lower(x: str) -> Column:
    return F.lower(F.coalesce(F.col(x), F.lit("")))


@dataclass
class Index:
    """What ``build`` has written under ``folder``."""

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    def _of(self, name: str, terms: Sequence[str]) -> DataFrame:
        wanted = sorted({bucket(t, self.buckets) for t in terms})
        return self.spark.read.parquet(f"{self.folder}/{name}").where(F.col("bucket").isin(wanted) & F.col("term").isin(sorted(set(terms))))

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """The postings of the terms; no other buckets are listed, and no other terms' row groups read."""
        rows = self._of("postings", terms).select("term", "field", "block", "mean", F.inline("docs"))
        tf = F.size("places")
        share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        return rows.select("term", "field", "block", "key", "kind", "len", "places", tf.alias("tf"), share.alias("share"))

    def blocks(self, terms: Sequence[str]) -> DataFrame:
        """term, field, block, n (postings) and top (their highest share)."""
        return self._of("postings", terms).select("term", "field", "block", "n", "top")

    def fields(self) -> DataFrame:
        """field, n (documents) and mean (words)."""
        return self.spark.read.parquet(f"{self.folder}/fields")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of a task in blocks of up to ``size`` documents and BYTES of text."""
    held, docs, held_bytes = [], 0, 0
    for batch in batches:
        ends, at = np.cumsum(np.sum([pc.binary_length(c).to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=0, dtype=np.int64)), 0
        while at < batch.num_rows:
            past = ends[at - 1] if at else 0
            n = min(size - docs, batch.num_rows - at, max(int(np.searchsorted(ends, past + BYTES - held_bytes, "right")) - at, 0 if docs else 1))
            if n:
                held.append(batch.slice(at, n))
                at, docs, held_bytes = at + n, docs + n, held_bytes + int(ends[at + n - 1] - past)
            if docs == size or at < batch.num_rows:
                yield held
                held, docs, held_bytes = [], 0, 0
    if held:
        yield held


def _inverted(means: Mapping[str, float], size: int):
    """Turns documents (key, kind, and the text of each field in lower case) into a row for each term, field and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, rows in enumerate(_blocks(batches, size)):
            table = pa.Table.from_batches(rows).combine_chunks()
            for field in table.column_names[2:]:
                words = pc.split_pattern_regex(table[field].chunk(0), SPACE)
                lens = pc.list_value_length(words).to_numpy(zero_copy_only=False)
                coded = words.flatten().dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")  # by term, then as they stand: by document and place
                doc, at = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[order], (np.arange(len(code), dtype=np.int32) - np.repeat(np.cumsum(lens, dtype=np.int32) - lens, lens))[order]
                code = code[order]
                new_term = np.diff(code, prepend=-1) != 0
                new_doc = new_term | (np.diff(doc, prepend=-1) != 0)
                starts = np.flatnonzero(new_doc)  # of the postings among the places
                tf, doc = np.diff(starts, append=len(code)), doc[starts]
                terms = np.flatnonzero(new_term[starts])  # of the terms among the postings
                length, mean = lens[doc], means[field]
                share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), pa.array(at, pa.int32()))
                key, kind = (table[x].chunk(0).take(pa.array(doc)) for x in ("key", "kind"))
                docs = pa.StructArray.from_arrays([key, kind, pa.array(length, pa.int32()), places], ["key", "kind", "len", "places"])
                n = len(terms)
                columns = {
                    "term": coded.dictionary.take(pa.array(code[starts[terms]])), "field": pa.repeat(field, n), "block": pa.array(np.full(n, first + i)), "n": pa.array(np.diff(terms, append=len(doc))),
                    "top": pa.array(np.maximum.reduceat(share, terms)), "mean": pa.array(np.full(n, float(mean))), "docs": pa.ListArray.from_arrays(pa.array(np.append(terms, len(doc)), pa.int32()), docs),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def build(docs: DataFrame, key: str, fields: Sequence[str], folder: str, kind: str | None = None, block: int = BLOCK, buckets: int = BUCKETS) -> Index:
    """Writes the index of ``fields`` of ``docs`` by a unique ``key``; ``kind`` is a column that hits carry along. Null fields have one empty word, as everywhere in search."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("key"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("kind"), *(_lower(f).alias(f"_{i}") for i, f in enumerate(fields)))
    names = [f"_{i}" for i, _ in enumerate(fields)]
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.size(F.split(x, SPACE)).alias("len")) for f, x in zip(fields, names)))
    stats = rows.select(F.inline(each)).groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    stats.write.mode("overwrite").parquet(f"{folder}/fields")
    means = {r.field: r["mean"] for r in spark.read.parquet(f"{folder}/fields").collect()}  # a row for each field
    posting = StructType().add("key", rows.schema["key"].dataType).add("kind", rows.schema["kind"].dataType).add("len", IntegerType()).add("places", ArrayType(IntegerType()))
    schema = StructType().add("term", StringType()).add("field", StringType()).add("block", LongType()).add("n", LongType()).add("top", DoubleType()).add("mean", DoubleType()).add("docs", ArrayType(posting))
    made = rows.mapInArrow(_inverted({x: means.get(f) for f, x in zip(fields, names)}, block), schema)
    named = F.element_at(F.create_map(*(F.lit(x) for p in zip(names, fields) for x in p)), F.col("field"))
    full = made.withColumns({"field": named, "bucket": (F.crc32(F.col("term").cast("binary")) % buckets).cast("int")})
    full.sortWithinPartitions("bucket", "term", "field", "block").write.option("compression", "zstd").mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    return Index(spark, folder, buckets)


def _rarity(index: Index, weights: Mapping[str, float], blocks: DataFrame) -> DataFrame:
    """term, field and factor: weight times the inverse document frequency. A row for each term of the query and field."""
    df = blocks.groupBy("term", "field").agg(F.sum("n").alias("df"))
    weight = F.element_at(F.create_map(*(F.lit(x) for p in weights.items() for x in p)), F.col("field"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(F.broadcast(index.fields()), "field").select("term", "field", (weight * idf).alias("factor"))


def best(index: Index, weights: Mapping[str, float], tokens: Sequence[str], k: int, first: int = FIRST) -> DataFrame:
    """key, kind and score of the k best documents by BM25, ties by key: the scores that a scan of all documents gives."""
    blocks = index.blocks(tokens).where(F.col("field").isin(*weights))
    factors = F.broadcast(_rarity(index, weights, blocks))  # terms x fields
    bounds = blocks.join(factors, ["term", "field"]).groupBy("block").agg(F.sum(F.col("top") * F.col("factor")).alias("bound"))
    start = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]

    def scored(of: DataFrame) -> DataFrame:
        sums = of.where(F.col("field").isin(*weights)).join(factors, ["term", "field"]).groupBy("key", "kind").agg(F.sum(F.col("share") * F.col("factor")).alias("score"))
        return sums.withColumn("score", F.round("score", DECIMALS))

    postings = index.postings(tokens)
    begun = scored(postings.where(F.col("block").isin(start)))
    kth = begun.orderBy(F.desc("score"), "key").offset(k - 1).limit(1).collect()
    more = bounds.where(~F.col("block").isin(start))
    if kth:
        more = more.where(F.col("bound") >= kth[0].score - 10.0**-DECIMALS)
    rest = scored(postings.where(~F.col("block").isin(start)).join(more.select("block"), "block", "left_semi"))
    return begun.unionByName(rest).orderBy(F.desc("score"), "key").limit(k)


def phrases(index: Index, field: str, tokens: Sequence[str]) -> DataFrame:
    """key, kind and n: the documents whose field has the tokens side by side, and how often."""
    offsets = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("i")) for i, t in enumerate(tokens)))
    wanted = index.spark.range(1).select(F.inline(offsets))
    starts = F.transform("places", lambda p: p - F.col("i"))
    rows = index.postings(tokens).where(F.col("field") == field).join(F.broadcast(wanted), "term").select("key", "kind", starts.alias("starts"))  # a row for each token
    met = rows.groupBy("key", "kind").agg(F.collect_list("starts").alias("s")).where(F.size("s") == len(tokens))
    n = F.size(F.aggregate("s", F.col("s")[0], F.array_intersect))
    return met.select("key", "kind", n.alias("n")).where("n > 0")


def weighted(index: Index, query: str, lang: str = "both", fields: Sequence[str] | None = None) -> DataFrame:
    """key and score as ``search.search`` has them, from the index: weighted fields, plus the phrase in a title, times the type. The query must not be blank."""
    tokens = query.lower().split()
    weights = {f: w for f, w in field_weights(lang).items() if fields is None or f in fields}
    weight = F.element_at(F.create_map(*(F.lit(x) for p in weights.items() for x in p)), F.col("field"))
    times = F.element_at(F.create_map(*(F.lit(x) for t in set(tokens) for x in (t, tokens.count(t)))), F.col("term"))  # a repeated token counts again
    base = index.postings(tokens).where(F.col("field").isin(*weights)).groupBy("key", "kind").agg(F.sum(weight * times).alias("base"))
    boost = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in TYPES.items() for x in p)), F.col("kind")), F.lit(1.0))
    if len(tokens) < 2:
        return base.select("key", (F.col("base") * boost).alias("score"))
    titles = [phrases(index, t, tokens).select("key") for t in TITLES if t in weights]
    met = titles[0]
    for t in titles[1:]:
        met = met.unionByName(t)
    out = base.join(met.distinct().withColumn("phrase", F.lit(PHRASE)), "key", "left")
    return out.select("key", ((F.col("base") + F.coalesce("phrase", F.lit(0.0))) * boost).alias("score"))
