"""Places: mentions resolved against a gazetteer, and courts to their district and province."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicframe.functions.text import bound


def place_key(x: str | Column) -> Column:
    """Words of a place, in lower case, without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)[^\w\p{M}]+", " "), " +", " "))


def _grams(words: Column, most: int) -> Column:
    places = F.sequence(F.lit(1), F.size(words))
    runs = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(places, lambda i: F.when(i + n - 1 <= F.size(words), F.array_join(F.slice(words, i, n), " "))))
    return F.array_distinct(F.array_compact(F.flatten(runs)))


def named_places(texts: DataFrame, key: str, column: str, gazetteer: DataFrame, most: int = 3) -> DataFrame:
    """key, iri, kind and parent of every place that a text names by whole words: its runs of up to ``most`` words meet the gazetteer (iri, kind, parent, name) in an equi-join."""
    runs = texts.select(key, F.explode(bound(F.split(place_key(column), " "), lambda w: _grams(w, most))).alias("_run")).where("_run <> ''")
    names = gazetteer.select(place_key("name").alias("_run"), "iri", "kind", "parent").distinct()
    return runs.join(names, "_run").select(key, "iri", "kind", "parent").distinct()


def resolved_places(mentions: DataFrame, key: str, gazetteer: DataFrame, most: int = 3) -> DataFrame:
    """key, district, unit and reason of mentions (place, claim, evidence).

    Only the place and its quote ground a district: the claim may pick among them and never adds one. A unit binds if it is the only one named in that district.
    """
    sides = {name: named_places(mentions, key, name, gazetteer, most) for name in ("place", "claim", "evidence")}
    pick = lambda kind, value: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, value)))
    place = sides["place"].groupBy(key).agg(pick("district", F.col("iri")).alias("named"), pick("unit", F.struct("parent", "iri")).alias("units"))
    claim = sides["claim"].groupBy(key).agg(pick("district", F.col("iri")).alias("claimed"))
    quote = sides["evidence"].groupBy(key).agg(pick("district", F.col("iri")).alias("quoted"))
    none = F.array().cast("array<string>")
    rows = mentions.select(key).join(place, key, "left").join(claim, key, "left").join(quote, key, "left")
    rows = rows.withColumns({x: F.coalesce(x, none) for x in ("named", "claimed", "quoted")} | {"units": F.coalesce("units", F.array())})
    rows = rows.withColumn("parents", F.array_distinct(F.array_compact(F.transform("units", lambda u: u["parent"]))))
    both = F.array_intersect("named", "parents")
    pool = F.when(F.size(both) > 0, both).when(F.size("parents") > 0, F.col("parents")).otherwise(F.col("named"))
    claimed = F.when(F.size("claimed") == 1, F.element_at("claimed", 1))
    apart = (F.size("named") > 0) & (F.size("parents") > 0) & (F.size(both) == 0)
    is_in = lambda x: F.array_contains(x, claimed)
    reason = (
        F.when(claimed.isNull() & apart, "district lacks the municipality")
        .when(claimed.isNull() & (F.size(pool) != 1), "no single district")
        .when(claimed.isNull(), F.lit(None))
        .when(~(is_in("named") | is_in("parents") | is_in("quoted")), "claim not named")
        .when((F.size("named") > 0) & ~is_in("named"), "district lacks the municipality")
        .when(~is_in("named") & (F.size("parents") > 1) & ~is_in("quoted"), "claim not in the quote")
    )
    rows = rows.withColumn("reason", reason).withColumn("district", F.when(F.col("reason").isNull(), F.coalesce(claimed, F.element_at(pool, 1))))
    inside = F.filter("units", lambda u: u["parent"] == F.col("district"))
    unit = F.when(F.size(inside) == 1, F.element_at(inside, 1)["iri"])
    return rows.select(key, "district", unit.alias("unit"), F.when(F.size(inside) > 1, "several municipalities").otherwise(F.col("reason")).alias("reason"))


def redirected(mentions: DataFrame, key: str, column: str, twins: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """key, iri, district and reason of places that the gazetteer (iri, kind, parent, name) doesn't know as written, but other entries do.

    twins (iri, titles: preferred first): an entry that isn't in the gazetteer, with a title equal to the place, leads to what the first of its titles names there: the one district of the name,
    else the one unit. Twins that lead to several units of one district bind the district; to several districts, nothing. ``key`` is unique; a null place has no twin.
    """
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    ends = {f"{k}_{f.__name__}": f(of(k, F.col("iri"))) for k in ("district", "unit") for f in (F.min, F.max)}
    named = gazetteer.groupBy(place_key("name").alias("_k")).agg(*(x.alias(name) for name, x in ends.items()), F.min(of("unit", F.col("parent"))).alias("parent"))
    one = lambda kind: F.col(f"{kind}_min") == F.col(f"{kind}_max")  # noqa: E731  least and greatest agree: there is one
    target = F.when(one("district"), F.struct(F.col("district_min").alias("iri"), F.col("district_min").alias("district"))).when(one("unit"), F.struct(F.col("unit_min").alias("iri"), F.col("parent").alias("district")))
    targets = named.select("_k", target.alias("_to")).where("_to is not null")
    forms = twins.join(gazetteer.select("iri").distinct(), "iri", "left_anti").select(F.col("iri").alias("_twin"), F.posexplode("titles").alias("_at", "_title"))
    forms = forms.select("_twin", "_at", place_key("_title").alias("_k")).where("_k <> ''")
    to = forms.join(targets, "_k").groupBy("_twin").agg(F.min_by("_to", "_at").alias("_to"))
    led = forms.select("_twin", "_k").distinct().join(to, "_twin").withColumn("_d", F.coalesce("_to.district", F.lit("")))
    known = led.groupBy("_k").agg(F.min("_to.iri").alias("_a"), F.max("_to.iri").alias("_b"), F.min("_d").alias("_c"), F.max("_d").alias("_d"))
    rows = mentions.select(key, place_key(column).alias("_k")).join(known, "_k", "left")
    agree = F.col("_c") == F.col("_d")
    district = F.when(agree, F.nullif("_c", F.lit("")))
    iri = F.when(agree, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(district))
    return rows.select(key, iri.alias("iri"), district.alias("district"), F.when(F.col("_a").isNull(), "no twin").when(~agree, "twins disagree").alias("reason"))


def court_places(courts: DataFrame, key: str, districts: DataFrame, seats: DataFrame, provinces: DataFrame, national: list[str]) -> DataFrame:
    """``courts`` with district and province: a district court has its own (districts: court, district), a high court the province of its seat (seats: court, district)
    without a district, a national one "national". Unknown courts have neither. The three tables are a register of at most some hundred courts each.
    """
    to_province = provinces.select(F.col("district").alias("_d"), F.col("province").alias("_p"))
    own = districts.select(F.col("court").alias(key), "district").join(to_province, F.col("district") == F.col("_d")).select(key, "district", F.col("_p").alias("province"))
    high = seats.select(F.col("court").alias(key), F.col("district").alias("_seat")).join(to_province, F.col("_seat") == F.col("_d")).select(key, F.lit(None).cast("string").alias("district"), F.col("_p").alias("province"))
    out = courts.join(own.unionByName(high).dropDuplicates([key]), key, "left")
    is_national = F.col(key).isin(*national)
    return out.withColumn("district", F.when(~is_national, F.col("district"))).withColumn("province", F.when(is_national, "national").otherwise(F.col("province")))
