"""The gate for SQL from outside: a policy over Spark's parsed plan, a public projection, a row cap and a byte cap."""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The functions that a caller may use.
FUNCTIONS = frozenset(
    "abs avg bool_and bool_or cast ceil ceiling char_length coalesce concat concat_ws count current_date date_trunc dense_rank extract floor "
    "greatest least length lower ltrim max min nullif rank replace round row_number rtrim substring sum timestamp_trunc to_char trim upper".split()
)
MOST_CHARACTERS = 20_000


class Refused(ValueError):
    """The query is outside the policy."""


#: The parsed plan's nodes that a query may have; any other (inline values, samples, table functions, set operations, CTEs, pivots, scripts) is refused.
NODES = frozenset("Aggregate Distinct Filter GlobalLimit Join LocalLimit Project Sort SubqueryAlias UnresolvedHaving UnresolvedRelation UnresolvedSubqueryColumnAliases".split())
#: Expressions that parse into nodes of their own; what a caller writes as a function comes as UnresolvedFunction, by name.
EXPRESSIONS = frozenset(
    "Add Alias And AttributeReference Between CaseWhen Cast Contains CurrentDate CurrentRow$ Divide EndsWith EqualNullSafe EqualTo Exists Extract GreaterThan GreaterThanOrEqual If In InSubquery IsNotNull IsNull LessThan "
    "LessThanOrEqual Like ListQuery Literal MultiAlias Multiply Not Or Remainder RLike ScalarSubquery SortOrder SpecifiedWindowFrame StartsWith StringTrim StringTrimLeft StringTrimRight Substring Subtract UnaryMinus UnaryPositive UnboundedFollowing$ "
    "UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedFunction UnresolvedOrdinal UnresolvedStar UnspecifiedFrame$ WindowExpression WindowSpecDefinition".split()
)
JOINS = frozenset("Inner LeftOuter RightOuter FullOuter UsingJoin".split())


def _kind(node) -> str:
    return node.getClass().getName().rpartition(".")[2]


def _seq(values) -> list:
    return [values.apply(i) for i in range(values.size())]


def _keyed(condition) -> bool:
    """Whether a condition, or a part of it that always has to hold, equates qualified columns of two tables."""
    kind = _kind(condition)
    if kind == "And":
        return _keyed(condition.left()) or _keyed(condition.right())
    sides = (condition.left(), condition.right()) if kind == "EqualTo" else ()
    names = [_seq(x.nameParts()) for x in sides if _kind(x) == "UnresolvedAttribute"]
    return len(names) == 2 and all(len(n) == 2 for n in names) and names[0][0].lower() != names[1][0].lower()


def _expression(x, tables: Collection[str], whole: bool) -> None:
    kind = _kind(x)
    if kind not in EXPRESSIONS:
        raise Refused(f"not allowed: {kind.rstrip('$')}")
    if kind == "UnresolvedFunction":
        name = _seq(x.nameParts())
        if len(name) > 1:
            raise Refused("qualified functions aren't allowed")
        if name[0].lower() not in FUNCTIONS:
            raise Refused(f"function not allowed: {name[0]}")
    if kind == "WindowSpecDefinition" and not whole and not x.partitionSpec().size():
        raise Refused("a window needs PARTITION BY")
    if kind in ("ScalarSubquery", "Exists", "ListQuery"):
        _node(x.plan(), tables, whole)
    if kind == "InSubquery":
        _node(x.query().plan(), tables, whole)
    for child in _seq(x.children()):
        _expression(child, tables, whole)


def _node(plan, tables: Collection[str], whole: bool) -> None:
    """Judges a node of the parsed plan, its expressions, and what is below it."""
    kind = _kind(plan)
    if kind not in NODES:
        raise Refused(f"not allowed: {kind}")
    if kind == "UnresolvedRelation":
        name = _seq(plan.multipartIdentifier())
        if len(name) != 1 or name[0].lower() not in tables:
            raise Refused(f"table not allowed: {'.'.join(name)}")
    if kind == "Join":
        how, condition = _kind(plan.joinType()).rstrip("$"), plan.condition()
        if how not in JOINS or how != "UsingJoin" and not (condition.isDefined() and _keyed(condition.get())):
            raise Refused("a join needs USING or an equality of qualified columns of two tables")
    for x in _seq(plan.expressions()):
        _expression(x, tables, whole)
    for child in _seq(plan.children()):
        _node(child, tables, whole)


def check(spark: SparkSession, query: str, tables: Collection[str], whole_windows: bool = True) -> None:
    """Raises Refused unless the query is one plain SELECT over these tables, with keyed joins and permitted functions.

    The parsed plan is walked node by node: what isn't permitted by its kind is refused, so that syntax which nobody thought of is, too.
    Without ``whole_windows``, so is a window without PARTITION BY, which puts all rows into one task: turn it off where tables are large.
    """
    if not query or not query.strip():
        raise Refused("empty query")
    if len(query) > MOST_CHARACTERS:
        raise Refused("query too long")
    bare = re.sub(r"'(?:[^']|'')*'", "''", query)
    if re.search(r"--|/\*|(?i:\bu\s*&\s*\")", bare) or ";" in bare.strip().rstrip(";"):
        raise Refused("comments, escapes and several statements aren't allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query.strip().rstrip(";"))
    except Exception as e:
        raise Refused("not a valid query") from e
    if not re.match(r"\s*select\b", query, re.I):
        raise Refused("only one SELECT is allowed")
    _node(plan, {t.lower() for t in tables}, whole_windows)


def run(spark: SparkSession, query: str, views: dict[str, DataFrame], rows: int = 500, whole_windows: bool = True) -> DataFrame:
    """Runs a checked query over the public projections of its tables, under a row cap."""
    check(spark, query, set(views), whole_windows)
    own = [name for name in views if spark.catalog.tableExists(name)]
    if own:
        raise Refused(f"the session has tables of these names: {', '.join(own)}")
    try:
        for name, view in views.items():
            view.createTempView(name)
        return spark.sql(f"select * from ({query.strip().rstrip(';')}) as gated limit {max(1, rows)}")  # analysed here, so the views may go
    finally:
        for name in views:
            spark.catalog.dropTempView(name)


def byte_cap(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows whose JSON fits ``most`` bytes; for results that a row cap has bounded already."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_bytes", F.sum(size).over(w)).where(F.col("_bytes") <= most).drop("_bytes")
