"""Facets, scoring, paging and suggestions."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicframe.functions.text import ascii_digits, devanagari_nfc, sound_fold


def facets(df: DataFrame, filters: Mapping[str, Column], names: Sequence[str]) -> DataFrame:
    """facet, value, n: each facet counts under every filter but its own. One scan, one aggregate, whatever the number of facets."""
    yes = F.lit(True)

    def others(name: str) -> Column:
        out = yes
        for k, condition in filters.items():
            out = out if k == name else out & condition
        return F.coalesce(out, F.lit(False))

    pairs = F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value"), others(n).alias("ok")) for n in names))
    return df.select(F.explode(pairs).alias("p")).where("p.ok and p.value is not null").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def pinned(counts: DataFrame, top: int, selected: Sequence[str]) -> DataFrame:
    """The ``top`` values by count, and those selected although they aren't among them."""
    best = counts.orderBy(F.desc("n"), "value").limit(top)
    return best.unionByName(counts.where(F.col("value").isin(*selected)).join(best, "value", "left_anti"))


def overlap_score(fields: Mapping[str, float], tokens: Sequence[str]) -> Column:
    """The summed weights of the tokens that each field has as words."""
    words = {f: F.split(F.lower(f), " ") for f in fields}
    total = F.lit(0.0)
    for f, weight in fields.items():
        for t in tokens:
            total = total + F.when(F.array_contains(words[f], t), weight).otherwise(0.0)
    return total


#: Weights of the searched fields, the factor of the title in the reader's language, the boost of a phrase in a title, and of the types.
FIELDS = {"title_ne": 3.0, "title_en": 3.0, "title_translit": 2.0, "keywords": 2.0, "body": 1.0}
LANGUAGE, PHRASE, TITLES = 2.0, 5.0, ("title_ne", "title_en", "title_translit")
TYPES = {"case": 2.0, "entity": 1.2, "courtcase": 1.0, "material": 0.9}


def field_weights(lang: str = "both") -> dict[str, float]:
    """The weights of the fields for a reader of "ne", "en" or both: a re-ranking, never a filter."""
    return {f: w * (LANGUAGE if f == f"title_{lang}" else 1.0) for f, w in FIELDS.items()}


def phrase_boost(titles: Sequence[str], tokens: Sequence[str]) -> Column:
    """``PHRASE`` where a title has the tokens side by side, as whole words; a single token is none."""
    if len(tokens) < 2:
        return F.lit(0.0)
    phrase, met = f" {' '.join(tokens)} ", F.lit(False)
    for t in titles:
        title = F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"\s+", " ")
        met = met | F.contains(F.concat(F.lit(" "), title, F.lit(" ")), F.lit(phrase))
    return F.when(met, PHRASE).otherwise(0.0)


def search(docs: DataFrame, query: str, lang: str = "both", type_column: str = "type") -> DataFrame:
    """``docs`` that have a token of the query, with their score: weighted fields, plus the phrase, times the type. A blank query browses: all rows, by type alone."""
    tokens = query.lower().split()
    fields = {f: w for f, w in field_weights(lang).items() if f in docs.columns}
    boost = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in TYPES.items() for x in (k, v))), F.col(type_column)), F.lit(1.0))
    if not tokens:
        return docs.withColumn("score", boost)
    base = overlap_score(fields, tokens)
    scored = docs.withColumn("_base", base).where("_base > 0")
    return scored.withColumn("score", (F.col("_base") + phrase_boost([t for t in TITLES if t in docs.columns], tokens)) * boost).drop("_base")


def highlighted(text: str | Column, tokens: Sequence[str], width: int = 160) -> Column:
    """``width`` characters around the first token, each token in <em>; the beginning if it has none."""
    x = F.col(text) if isinstance(text, str) else text
    pattern = "(?i)(" + "|".join(re.escape(t) for t in tokens) + ")"
    at = F.regexp_instr(x, F.lit(pattern)) if tokens else F.lit(0)
    cut = x.substr(F.greatest(at - width // 3, F.lit(1)), F.lit(width))
    return F.regexp_replace(cut, pattern, "<em>$1</em>") if tokens else cut


def envelope(hits: DataFrame, tokens: Sequence[str], lang: str = "both") -> DataFrame:
    """iri, type, score and hit: the titles of both scripts, a snippet in the reader's language (else the other), and where it matched."""
    ne, en = (F.col("title_ne"), F.col("title_en"))
    title = F.coalesce(*((en, ne) if lang == "en" else (ne, en)))
    fields = [f for f in FIELDS if f in hits.columns]
    matched = F.array_compact(F.array(*(F.when(overlap_score({f: 1.0}, tokens) > 0, F.lit(f)) for f in fields)))
    hit = F.struct(title.alias("title"), ne.alias("title_ne"), en.alias("title_en"), highlighted("body", tokens).alias("snippet"), matched.alias("matched"))
    return hits.select("iri", "type", "score", hit.alias("hit"))


def fallback_relevance(names: str | Column, alternates: str | Column, keywords: str | Column, query: str) -> Column:
    """Relevance of an entity without an index: each folded token of the query counts 10 as a whole token of a name and 3 within one, 5 and 2 for other names; 1 for each keyword with the query."""
    needles = F.array_distinct(F.filter(F.split(sound_fold(F.lit(query)), " "), lambda t: t != ""))

    def of(column: str | Column, exact: float, part: float) -> Column:
        texts = F.col(column) if isinstance(column, str) else column
        own = F.flatten(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.split(sound_fold(t), " ")))
        score = lambda t: F.when(F.array_contains(own, t), exact).when(F.exists(own, lambda o: F.contains(o, t)), part).otherwise(0.0)
        return F.aggregate(needles, F.lit(0.0), lambda a, t: a + score(t))

    kw = F.col(keywords) if isinstance(keywords, str) else keywords
    with_query = F.size(F.filter(F.coalesce(kw, F.array().cast("array<string>")), lambda k: F.contains(F.lower(k), F.lit(query.lower()))))
    return of(names, 10.0, 3.0) + of(alternates, 5.0, 2.0) + with_query.cast("double")


def analyzed(x: str | Column, stop: Sequence[str] = ()) -> Column:
    """The tokens of a text for an index: zero-width characters dropped, digits of both scripts one, in lower case, without accents of Latin letters and stop words."""
    s = F.translate(F.coalesce(devanagari_nfc(x), F.lit("")), "\u200b\u200c\u200d\ufeff", "")
    s = F.translate(F.lower(ascii_digits(s)), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(F.trim(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}]+", " ")), " "), lambda t: (t != "") & ~t.isin(*stop) if stop else t != "")


def bm25(docs: DataFrame, key: str, fields: Mapping[str, float], tokens: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score: BM25 of each field by its weight, summed. Rows without any token have none."""
    terms = F.array(*map(F.lit, tokens))
    parts = [docs.select(key, F.lit(f).alias("field"), F.lit(w).alias("weight"), F.split(F.lower(F.coalesce(f, F.lit(""))), r"\s+").alias("words")) for f, w in fields.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    sizes = long.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    hits = long.select(key, "field", "weight", F.size("words").alias("len"), F.explode(F.filter("words", lambda x: F.array_contains(terms, x))).alias("term"))
    hits = hits.groupBy(key, "field", "weight", "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(sizes), "field")  # fields x terms of the query, and fields
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return scored.groupBy(key).agg(F.sum(F.col("weight") * idf * tf).alias("score"))


def eligible(tokens: Column, least: int = 4, most: int = 12, denied: Sequence[str] = ()) -> Column:
    """Tokens that may match fuzzily: ASCII letters, long enough, not denied, the first ``most``."""
    return F.slice(F.filter(tokens, lambda t: t.rlike(f"^[a-zA-Z]{{{least},}}$") & ~F.lower(t).isin(*denied)), 1, most)


def _deletions(word: str, n: int) -> str:
    """SQL for the words that n deletions or fewer leave of a word."""
    one = lambda w: f"transform(sequence(1, length({w})), i -> concat(substr({w}, 1, i - 1), substr({w}, i + 1)))"
    once = f"concat(array({word}), {one(word)})"
    return f"array_distinct({once})" if n == 1 else f"array_distinct(concat({once}, flatten(transform({one(word)}, d -> if(d = '', array(d), {one('d')})))))"


def fuzzy(vocabulary: DataFrame, misspelt: DataFrame) -> DataFrame:
    """token, word, distance: one edit up to seven letters and two beyond, first letters equal.

    Words within n edits share what n deletions or fewer leave of both, so candidates come from an equi-join of these, and the edits are counted for them alone.
    """
    keys = lambda name: F.expr(f"if(length({name}) < 8, {_deletions(name, 1)}, {_deletions(name, 2)})")
    a = misspelt.where("token <> ''").select("token", F.explode(keys("token")).alias("key"))
    b = vocabulary.where("word <> ''").select("word", F.explode(F.expr(f"if(length(word) < 6, {_deletions('word', 1)}, {_deletions('word', 2)})")).alias("key"))
    met = a.join(b, "key").select("token", "word").distinct().where("substr(token, 1, 1) = substr(word, 1, 1)")
    return met.withColumn("distance", F.levenshtein("token", "word")).where("distance between 1 and if(length(token) < 8, 1, 2)")


def suggestion(candidates: DataFrame) -> DataFrame:
    """The best word for each token: least distance, then frequency, then the word."""
    best = F.max_by("word", F.struct(-F.col("distance"), F.col("freq"), F.col("word")))
    return candidates.groupBy("token").agg(best.alias("word"))


def after(order: Sequence[tuple[str, bool]], cursor: Sequence[object]) -> Column:
    """Rows after the cursor in an order of (column, descending) pairs; ends with a unique column. Nulls come last."""
    out, equal = F.lit(False), F.lit(True)
    for (name, descending), value in zip(order, cursor, strict=True):
        x = F.col(name)
        if value is None:
            step = F.lit(False)
        else:
            step = ((x < value) if descending else (x > value)) | x.isNull()
        out = out | (equal & F.coalesce(step, F.lit(False)))
        equal = equal & x.eqNullSafe(F.lit(value))
    return out


def keyset(df: DataFrame, keys: Sequence[str], last: Sequence[object] | None, size: int) -> DataFrame:
    """The next rows of a scan in the order of unique keys, after those of the last row; the comparison of keys is pushed to the scan for the first one."""
    if last is not None:
        df = df.where(F.col(keys[0]) >= F.lit(last[0])).where(after([(k, False) for k in keys], last))
    return df.orderBy(*keys).limit(size)


def newest_first(df: DataFrame, created: str, key: str, cursor: str | None = None, size: int = 50, most: int = 500) -> DataFrame:
    """A page of the newest rows, ties by key, from a cursor on; the size is bounded."""
    if cursor is not None:
        df = df.where(after([(created, True), (key, False)], decode_cursor(cursor, 2)))
    return df.orderBy(F.desc_nulls_last(created), key).limit(max(1, min(size, most)))


def encode_cursor(values: Sequence[object]) -> str:
    return base64.urlsafe_b64encode(json.dumps(list(values)).encode()).decode()


def decode_cursor(text: str, size: int) -> list[object]:
    try:
        values = json.loads(base64.urlsafe_b64decode(text.encode()))
    except ValueError as e:
        raise ValueError("malformed cursor") from e
    if not isinstance(values, list) or len(values) != size:
        raise ValueError("malformed cursor")
    return values


def page(df: DataFrame, order: Sequence[Column], offset: int, size: int, ceiling: int = 10_000) -> DataFrame:
    """A page by offset; beyond the ceiling an error, as on a cluster every page sorts anew."""
    if offset + size > ceiling:
        raise ValueError(f"offset and size exceed {ceiling}; page by a cursor")
    return df.orderBy(*order).offset(offset).limit(size)


#: What an index expands a misspelt token to, and what such a match counts.
EXPANSIONS, FUZZY_BOOST = 50, 0.3


def expansions(met: DataFrame, vocabulary: DataFrame, most: int = EXPANSIONS) -> DataFrame:
    """token, word, distance and boost of the ``most`` nearest words of each token (``fuzzy``), by distance, documents that hold the word (vocabulary: word, freq) and the word."""
    w = Window.partitionBy("token").orderBy("distance", F.desc("freq"), "word")
    ranked = met.join(vocabulary, "word").withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most)
    return ranked.select("token", "word", "distance", F.lit(FUZZY_BOOST).alias("boost"))


def sort_order(mode: str, date: str = "date", title: str = "title", score: str = "score", featured: str = "featured", key: str = "iri") -> list[Column]:
    """The order of a mode, ties by key, missing values last; an unknown mode is an error."""
    newest = [F.desc_nulls_last(date)]
    modes = {"relevance": [F.desc_nulls_last(score), *newest], "newest": newest, "oldest": [F.asc_nulls_last(date)], "title": [F.asc_nulls_last(F.lower(F.col(title)))], "featured": [F.desc_nulls_last(featured), *newest]}
    if mode not in modes:
        raise ValueError(f"sort is one of {', '.join(modes)}")
    return [*modes[mode], F.col(key)]
