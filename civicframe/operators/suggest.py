"""Did-you-mean: for queries that found nothing, the best combination of near words that finds something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.operators.search import eligible, fuzzy
from civicframe.storage import cut

#: Candidates of a token, and combinations of a query that are tried.
CANDIDATES, COMBINATIONS = 5, 25


def _better(x: Column, y: Column) -> Column:
    """Higher authority, then fewer edits, then higher frequency, then the text: each summed over the words, so that the best of a beginning stay the best of its continuations."""
    one = lambda a, b, first: F.when(a < b, -first).when(a > b, first)
    return F.coalesce(one(x["authority"], y["authority"], -1), one(x["distance"], y["distance"], 1), one(x["freq"], y["freq"], -1), one(x["text"], y["text"], 1), F.lit(0))


def combinations(queries: DataFrame, words: DataFrame, most: int = COMBINATIONS) -> DataFrame:
    """query_id, place (from 1), words: the ``most`` best combinations of queries (query_id, tokens) over words (token, word, distance, freq, authority).

    The best grow token by token, ``most`` of each beginning; a token without candidates stays as it is.
    """
    tokens = queries.select("query_id", F.posexplode("tokens").alias("at", "token"))
    item = F.struct("authority", "distance", "freq", F.col("word").alias("text"))
    of = words.groupBy("token").agg(F.slice(F.array_sort(F.collect_list(item), _better), 1, CANDIDATES).alias("items"))  # the expansions of a token are bounded
    zero = F.lit(0).cast("long")
    itself = F.array(F.struct(zero.alias("authority"), zero.alias("distance"), zero.alias("freq"), F.col("token").alias("text")))
    lists = tokens.join(of, "token", "left").select("query_id", "at", F.coalesce("items", itself).alias("items"))
    lists = lists.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "items"))), lambda x: x["items"]).alias("lists"))  # as many as tokens

    def longer(beam: Column, items: Column) -> Column:
        def joined(b: Column, i: Column) -> Column:
            text = F.when(b["text"] == "", i["text"]).otherwise(F.concat(b["text"], F.lit(" "), i["text"]))
            return F.struct(*((b[k] + i[k]).alias(k) for k in ("authority", "distance", "freq")), text.alias("text"))

        return F.slice(F.array_sort(F.flatten(F.transform(beam, lambda b: F.transform(items, lambda i: joined(b, i)))), _better), 1, most)

    start = F.array(F.struct(zero.alias("authority"), zero.alias("distance"), zero.alias("freq"), F.lit("").alias("text")))
    best = lists.select("query_id", F.posexplode(F.aggregate("lists", start, longer)).alias("at", "c"))
    return best.select("query_id", (F.col("at") + 1).alias("place"), F.split("c.text", " ").alias("words"))


def _found(wanted: DataFrame, by: list[str], held: DataFrame) -> DataFrame:
    """Those of ``wanted`` (by, words) all of whose words stand in one document of ``held`` (doc, word)."""
    each = wanted.select(*by, F.array_distinct("words").alias("w")).select(*by, F.size("w").alias("n"), F.explode("w").alias("word"))
    met = each.join(held, "word").groupBy(*by, "doc").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    return met.where("m = n").select(*by).distinct()


def did_you_mean(queries: DataFrame, vocabulary: DataFrame, held: DataFrame, most: int = COMBINATIONS) -> DataFrame:
    """query_id and suggestion: of each of ``queries`` (query_id, tokens) that finds no document, the best combination of near words that finds one.

    vocabulary: word, freq (documents that hold it) and authority (of the best field that does); held: doc and word, once each. Tokens that may not match fuzzily (short, not ASCII letters) stay. A query
    that finds something, blank queries, and those without any combination that does, have no row. Only words of the combinations are looked up in ``held``.
    """
    asked = queries.where(F.size("tokens") > 0).select("query_id", "tokens")
    missed = cut(asked.join(_found(asked.select("query_id", F.col("tokens").alias("words")), ["query_id"], held), "query_id", "left_anti"), "missed")
    token = missed.select(F.explode("tokens").alias("token")).distinct()
    near = fuzzy(vocabulary.select("word"), missed.select(F.explode(eligible(F.col("tokens"))).alias("token")).distinct())
    same = token.join(vocabulary, token.token == vocabulary.word).select("token", "word", F.lit(0).alias("distance"))
    words = near.unionByName(same).join(vocabulary, "word").select("token", "word", F.col("distance").cast("long").alias("distance"), F.col("freq").cast("long").alias("freq"), F.col("authority").cast("long").alias("authority"))
    tried = cut(combinations(missed, words, most), "tried")
    return tried.join(_found(tried, ["query_id", "place"], held), ["query_id", "place"]).groupBy("query_id").agg(F.array_join(F.min_by("words", "place"), " ").alias("suggestion"))
