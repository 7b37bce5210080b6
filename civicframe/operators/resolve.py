"""Entity resolution: scores, verdicts, and one-to-one pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicframe.functions.domain import ladder
from civicframe.session import ship


def name_score(a: str, b: str) -> Column:
    """1 for equal names, less for each edit over the longer one; 0 unless the last words agree."""
    last = lambda x: F.element_at(F.split(F.trim(F.lower(x)), r"\s+"), -1)
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when(last(a) == last(b), 1.0 - F.levenshtein(F.lower(a), F.lower(b)) / longest).otherwise(0.0)


def verdicts(scored: DataFrame, threshold: float = 0.85, margin: float = 0.05) -> DataFrame:
    """mention, entity, score, verdict: the best entity binds if it is over the threshold, no other is near it and no veto stands."""
    best = scored.groupBy("mention", "entity").agg(F.max("score").alias("score"), F.bool_or("veto").alias("veto"))
    w = Window.partitionBy("mention")
    ranked = best.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "entity"))).withColumn("top", F.max("score").over(w))
    top = ranked.withColumn("rivals", F.count_if(F.col("score") >= F.col("top") - margin).over(w)).where("place = 1")
    verdict = ladder((F.col("score") < threshold, "NO_MATCH"), (F.col("veto") | (F.col("rivals") > 1), "REVIEW"), otherwise="BIND")
    return top.select("mention", "entity", "score", verdict.alias("verdict"))


def publisher_gate(records: DataFrame, key: str, publisher: Column, least: int) -> DataFrame:
    """key, publishers and held: fewer distinct publishers than ``least`` hold a record back."""
    counted = records.groupBy(key).agg(F.countDistinct(publisher).alias("publishers"))
    return counted.withColumn("held", F.col("publishers") < least)


def _pair(rows: list[tuple], least: float, margin: float) -> Iterator[tuple]:
    """Of a docket's pairs (a, b, score), best first: a pair goes if a rival on either side, still open, is within the margin."""
    by_a, by_b, taken_a, taken_b = {}, {}, set(), set()
    for r in reversed(rows):  # so that the best stand last
        by_a.setdefault(r[0], []).append(r)
        by_b.setdefault(r[1], []).append(r)

    def alone(r: tuple, own: list[tuple], end: int, taken: set) -> bool:
        while own[-1][end] in taken:  # never open again
            own.pop()
        best = own[-1] if own[-1] is not r else next((x for x in reversed(own) if x is not r and x[end] not in taken), None)
        return best is None or best[2] < r[2] - margin

    for r in rows:
        if r[2] >= least and r[0] not in taken_a and r[1] not in taken_b and alone(r, by_a[r[0]], 1, taken_b) and alone(r, by_b[r[1]], 0, taken_a):
            taken_a.add(r[0])
            taken_b.add(r[1])
            yield r


def _paired(least: float, margin: float):
    """Pairs each docket of rows that are sorted by docket and best first; only the docket that is being read is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docket, held, schema = None, [], None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            schema, out = batch.schema, []
            for d, *r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and d != docket and (d == d or docket == docket):  # NaN is one docket
                    out += [(docket, *p) for p in _pair(held, least, margin)]
                    held = []
                docket = d
                held.append(tuple(r))
            yield made(out)
        if held:
            yield made([(docket, *p) for p in _pair(held, least, margin)])

    return run


def best_first_pairs(scored: DataFrame, margin: float = 0.05, least: float = 0.85) -> DataFrame:
    """One-to-one pairs within each docket (docket, a, b, score), the best first, of ``least`` or more; a pair with an open rival in the margin on either side goes.

    A docket's candidates come to one task: they are the names of one case. Python is called for batches of rows, whatever the number of dockets. Of repeated pairs the best score counts;
    rows without a score are no candidates.
    """
    near = scored.select("docket", "a", "b", "score").where(F.col("score") >= least - max(margin, 0))  # what is below isn't bound and is in no margin
    once = near.repartition("docket").groupBy("docket", "a", "b").agg(F.max("score").alias("score"))
    ship(once.sparkSession)
    ordered = once.sortWithinPartitions("docket", F.desc("score"), F.asc_nulls_last("a"), F.asc_nulls_last("b"))
    return ordered.mapInArrow(_paired(least, margin), once.schema)


def unrivalled(scored: DataFrame, margin: float = 0.05) -> DataFrame:
    """The pairs (docket, a, b, score) without a rival: no other pair of the docket with the same a or the same b has a score within ``margin`` of theirs, or a higher one. Scores of repeated pairs count once, the best."""
    pairs = scored.groupBy("docket", "a", "b").agg(F.max("score").alias("score"))

    def lone(df: DataFrame, side: str) -> DataFrame:
        two = F.slice(F.sort_array(F.collect_list("score"), False), 1, 2)  # the candidates of one name in one docket
        best = df.groupBy("docket", side).agg(two.alias("_two")).where((F.size("_two") == 1) | (F.try_element_at("_two", F.lit(2)) < F.col("_two")[0] - margin))
        return best.select("docket", side, F.col("_two")[0].alias("score"))

    return pairs.join(lone(pairs, "a"), ["docket", "a", "score"]).join(lone(pairs, "b"), ["docket", "b", "score"]).select("docket", "a", "b", "score")
