"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicframe.session import ship
from civicframe.storage import cut, scratch, shared_dir, shared_path  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once; as a column it may be put back into the lambdas that use it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Keys of rows that are broadcast; more are joined by a shuffle.
SMALL = 500_000
#: Words of 64 bits in a bitmap: 8 KB to 2 MB. A fuller one lets more rows through to the join behind it, which is exact.
LEAST_SLOTS, MOST_SLOTS = 1 << 10, 1 << 18


def mark(text: str | Column = "text") -> Column:
    """A hash of a text, which names a row together with its id. Null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def small(df: DataFrame, most: int | None = None, weight: Column | None = None) -> DataFrame:
    """Broadcast if it has few rows, or little weight in sum (items of an array, say). ``df`` should be cut, as it is counted."""
    most = SMALL if most is None else most
    rows, weights = df.agg(F.count("*"), F.coalesce(F.sum(weight if weight is not None else F.lit(0)), F.lit(0))).first()
    return F.broadcast(df) if max(rows, weights) <= most else df


def slots_for(n: int) -> int:
    """64 bits for each of n hashes, within bounds."""
    slots = LEAST_SLOTS
    while slots < MOST_SLOTS and slots < n:
        slots *= 2
    return slots


def bitmap(df: DataFrame, name: str, slots: int) -> DataFrame:
    """One row: for the hashes in ``name`` an array of ``slots`` 64-bit words, with bit h % 64 of word (h >> 6) % slots set."""
    of = F.expr(f"shiftright({name}, 6) & {slots - 1}L")
    filled = df.groupBy(of.alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")).alias("bits"))
    every = df.sparkSession.range(slots).withColumnRenamed("id", "slot").join(filled, "slot", "left")
    ordered = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("bits", F.lit(0)).alias("bits"))))  # as many as slots
    return every.agg(F.transform(ordered, lambda x: x["bits"]).alias("bits"))


def maybe(bits: str, h: str, slots: int) -> str:
    """SQL: whether a hash may be in a bitmap. False is certain."""
    return f"(shiftright(element_at({bits}, cast(1 + (shiftright({h}, 6) & {slots - 1}L) as int)), cast({h} & 63 as int)) & 1L) = 1L"


def sifted(rows: DataFrame, keys: DataFrame, name: str, inside: bool = True) -> DataFrame:
    """The rows whose text's mark may be among ``keys`` (a column ``name``), or those whose can't: a filter, so that few texts meet a join behind it."""
    slots = slots_for(keys.count())
    marked = rows.withColumns({"sift_bits": bitmap(keys, name, slots).scalar(), "sift_mark": mark()})
    found = F.expr(maybe("sift_bits", "sift_mark", slots))
    return marked.where(found if inside else ~found).drop("sift_bits", "sift_mark")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows but for those of ``gone`` (doc_id, mark): a row is meant by its id, null too, and its text.

    Few are broadcast, behind a count. Of more, a bitmap of the marks lets pass what is surely kept, and only the other texts are shuffled.
    """
    gone = cut(gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct(), "verdicts")
    few = gone.count() <= SMALL

    def left(part: DataFrame) -> DataFrame:
        met = part.doc_id.eqNullSafe(gone.gone_id) & (mark(part.text) == gone.gone_mark)
        return part.join(F.broadcast(gone) if few else gone, met, "left_anti")

    return left(rows) if few else sifted(rows, gone, "gone_mark", False).unionByName(left(sifted(rows, gone, "gone_mark")))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; 2 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def pylists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a few very long texts never make a large buffer."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
