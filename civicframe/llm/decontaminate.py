"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Of every 10-word window of a text, the smallest of its six 5-gram hashes is a fingerprint; so two texts that share a window
share a fingerprint. One pass over the texts splits them into words, counts these, and keeps the places whose gram is the smallest of
a window and may be a fingerprint of the benchmark, by a bitmap. The places are joined to the benchmark's fingerprints, and around each hit the windows
that hold it are compared with the windows of the benchmark, word by word. An item shorter than a window is a window of its own length, and its own fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, bitmap, cut, mark, maybe, sifted, slots_for, small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Rows of fingerprints, or of windows, that are broadcast; more are joined by a shuffle.
SMALL = 1_000_000


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _gram(k: int, at: str) -> str:
    """The hash of the k words from the place ``at``, from 0. Words are taken one by one: ``slice`` would copy the whole array each time."""
    return f"xxhash64({k}, {', '.join(f'words[{at} + {j}]' for j in range(k))})"


def _phrase(at: str, length: str) -> str:
    return f"array_join(transform(sequence(0, {length} - 1), j -> words[{at} + j]), ' ')"


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, length, phrase and fingerprint of every distinct window. A null item_id counts as the empty id."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words().alias("words")).withColumn("n", F.size("words")).where("n > 0")
    long = f"array_min(transform(sequence(0, {SPAN - 1}), j -> {_gram(GRAM, 'i + j')}))"
    short = "case n " + " ".join(f"when {k} then {_gram(k, '0')}" for k in range(1, WINDOW)) + " end"
    every = f"transform(sequence(0, greatest(n - {WINDOW}, 0)), i -> named_struct('phrase', {_phrase('i', f'least(n, {WINDOW})')}, 'fingerprint', if(n < {WINDOW}, {short}, {long})))"
    rows = items.select("item_id", F.expr(f"least(n, {WINDOW})").alias("length"), F.explode(F.expr(every)).alias("x"))
    return rows.select("item_id", "length", "x.phrase", "x.fingerprint").distinct()


def marks(docs: DataFrame, prints: DataFrame, lengths: list[int], slots: int) -> DataFrame:
    """doc_id, mark (hash of the text), n_words and places (p from 1, k, h) of each row: the grams of k words that may be fingerprints of the benchmark."""
    texts = docs.select("doc_id", mark().alias("mark"), words().alias("words")).withColumn("bits", bitmap(prints, "fingerprint", slots).scalar())
    texts = texts.withColumn("n", F.size("words"))
    grams = f"if(n < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, n - {GRAM}), i -> {_gram(GRAM, 'i')}))"
    texts = texts.withColumn("grams", F.expr(grams))
    # the smallest hash of each window, by its first word; a gram counts if it is that of a window that holds it
    least = f"if(n < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, n - {WINDOW}), i -> least({', '.join(f'grams[i + {j}]' for j in range(SPAN))})))"
    kept = f"exists(sequence(greatest(x.p - {SPAN - 1}, 1), least(x.p, n - {WINDOW - 1})), s -> element_at(least, s) = x.h)"
    places = [bind("least", least, f"filter(filter(transform(grams, (h, i) -> named_struct('p', i + 1, 'k', {GRAM}, 'h', h)), x -> {maybe('bits', 'x.h', slots)}), x -> {kept})")]
    for k in lengths:
        every = f"if(n < {k}, cast(array() as array<bigint>), transform(sequence(0, n - {k}), i -> {_gram(k, 'i')}))"
        places.append(f"filter(transform({every}, (h, i) -> named_struct('p', i + 1, 'k', {-k}, 'h', h)), x -> {maybe('bits', 'x.h', slots)})")
    return texts.select("doc_id", "mark", F.col("n").cast("long").alias("n_words"), F.expr(f"concat({', '.join(places)})").alias("places"))


def _found(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``marks``, written, and ``hits``."""
    windows = cut(benchmark_windows(benchmark), "windows")
    lengths = sorted(r[0] for r in windows.where(F.col("length") < WINDOW).select("length").distinct().collect())  # nine at most
    prints = windows.select("fingerprint").distinct()
    n = prints.count()
    marked = cut(marks(docs, prints, lengths, slots_for(n)), "marks")
    placed = marked.where(F.size("places") > 0).dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", F.explode("places").alias("x")).select("doc_id", "mark", "x.p", "x.k", F.col("x.h").alias("fingerprint"))
    met = placed.join(F.broadcast(prints) if n <= SMALL else prints, "fingerprint", "left_semi")
    met = met.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("p", "k")).alias("met"))  # places of one text
    met = cut(met.select(F.col("doc_id").alias("met_id"), F.col("mark").alias("met_mark"), "met"), "met")
    texts = sifted(docs.select("doc_id", "text"), met, "met_mark")
    touched = texts.join(small(met, weight=F.size("met")), texts.doc_id.eqNullSafe(met.met_id) & (mark(texts.text) == met.met_mark))
    touched = touched.select("doc_id", F.col("met_mark").alias("mark"), "met", words().alias("words")).withColumn("n", F.size("words")).dropDuplicates(["doc_id", "mark"])  # repeated rows are looked at once
    # A window that holds the gram at place p begins at p - 5 .. p; a short one, whose length stands as -k, at p. Starts and lengths are one number, so that distinct ones are found by hash.
    starts = f"flatten(transform(met, m -> if(m.k < 0, array(m.p * 16L - m.k), transform(filter(sequence(m.p - {SPAN - 1}, m.p), s -> s >= 1 and s <= n - {WINDOW - 1}), s -> s * 16L + {WINDOW}))))"
    touched = touched.withColumn("starts", F.array_distinct(F.expr(starts)))
    at, length = "cast(x div 16 as int)", "cast(x % 16 as int)"
    tried = touched.select("doc_id", "mark", F.explode(F.expr(f"transform(starts, x -> named_struct('start', {at}, 'length', {length}, 'phrase', {_phrase(f'{at} - 1', length)}))")).alias("x"))
    tried = tried.select("doc_id", "mark", "x.start", "x.length", "x.phrase")
    phrases = windows.select("phrase", "length", "item_id")
    span = F.struct("start", "length")
    hit = tried.join(small(phrases, SMALL), ["phrase", "length"]).groupBy("doc_id", "mark").agg(F.collect_set(span).alias("spans"), F.collect_set("item_id").alias("items"))
    return marked, hit


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), spans (start from 1, length) and items, for each text with a window of the benchmark."""
    return _found(docs, benchmark)[1]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted), contaminated.

    Null and empty texts have no words. Null ids are ids like others; repeated rows get the same result. An empty benchmark, or
    items without words, contaminate nothing. Other columns are ignored.
    """
    marked, found = _found(docs, benchmark)
    covered = F.expr("size(array_distinct(flatten(transform(spans, x -> sequence(x.start, x.start + x.length - 1)))))")
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), covered.alias("n_hit"), F.array_sort("items").alias("items"))
    found = small(cut(found, "hits"), weight=F.size("items"))
    rows = marked.select("doc_id", "mark", "n_words")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    items = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))
