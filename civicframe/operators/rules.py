"""A registry of rules as columns: what a deployment adds to score its records, without touching the engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[], Column]


@dataclass
class Rules:
    """Named rules with weights, kinds of records that they apply to, and gates; all of them are one projection."""

    rules: dict[str, tuple[Rule, int, str | None, bool]] = field(default_factory=dict)

    def rule(self, name: str, weight: int = 1, kind: str | None = None, gate: bool = False) -> Callable[[Rule], Rule]:
        """Registers a function that returns a boolean column; a name can't be taken twice."""
        if name in self.rules:
            raise ValueError(f"rule {name} is registered already")
        if weight < 1:
            raise ValueError("a weight is a positive whole number")

        def add(f: Rule) -> Rule:
            self.rules[name] = (f, weight, kind, gate)
            return f

        return add

    def report(self, df: DataFrame, kind: str = "kind") -> DataFrame:
        """``df`` with score (0 to 100 over the rules that apply; null without any), issues in the order of registration, and passed: whether no gate failed. An unknown answer fails."""
        points, most, issues, passed = F.lit(0), F.lit(0), [], F.lit(True)
        for name, (f, weight, only, gate) in self.rules.items():
            applies = F.col(kind).eqNullSafe(F.lit(only)) if only else F.lit(True)
            fine = F.coalesce(f(), F.lit(False))
            points, most = points + F.when(applies & fine, weight).otherwise(0), most + F.when(applies, weight).otherwise(0)
            issues.append(F.when(applies & ~fine, F.lit(name)))
            passed = passed & (~applies | fine) if gate else passed
        score = F.when(most > 0, F.round(100.0 * points / F.nullif(most, F.lit(0)), 1))
        return df.withColumns({"score": score, "issues": F.array_compact(F.array(*issues)), "passed": passed})
