"""A relational source read by keyset pages: as a frame, one task for each range of keys, or as a stream whose offset is the last key.

``register(spark)``, then ``spark.read.format("keyset").schema(…)`` or ``spark.readStream…`` with the options of ``Options``. No connection stays open beyond a page, no task holds more
than a page, and a task that is run again reads its range again. A stream goes on behind the key that its checkpoint names, so each row comes once, also after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from civicframe.session import ship


@dataclass(frozen=True)
class Options:
    """module: a DB-API module that the executors have; dsn: the argument of its ``connect``; query: a SELECT without ORDER BY, joins included; key: its columns that are unique
    together, comma-separated, as numbers or text (rows with a null in it stay out); partitions: ranges, and so tasks; page: rows of a fetch; mark: the module's parameter mark.

    For a stream the key must grow: first when a row was written (as sortable text), then the natural key. What is committed late with an earlier time would be missed,
    so the query should hold back as long as transactions may take.
    """

    module: str
    dsn: str
    query: str
    key: tuple[str, ...]
    partitions: int = 8
    page: int = 5000
    mark: str = "%s"

    @classmethod
    def of(cls, given: dict[str, str]) -> Options:
        return cls(
            given["module"], given["dsn"], given["query"], tuple(k.strip() for k in given["key"].split(",")), int(given.get("partitions", 8)), int(given.get("page", 5000)), given.get("mark", "%s")
        )

    def rows(self, columns: Sequence[str], where: list[str], values: list, tail: str) -> list[tuple]:
        """One query on a connection of its own."""
        known = [f"{k} is not null" for k in self.key]
        text = f"select {', '.join(columns)} from ({self.query}) q where {' and '.join(known + where)} {tail}"
        with closing(import_module(self.module).connect(self.dsn)) as connection, closing(connection.cursor()) as cursor:
            cursor.execute(text, values)
            return [tuple(r) for r in cursor.fetchall()]

    def between(self, after: tuple | None, upto: tuple | None) -> tuple[list[str], list]:
        names, marks = ", ".join(self.key), ", ".join([self.mark] * len(self.key))
        where = [f"({names}) {sign} ({marks})" for sign, bound in ((">", after), ("<=", upto)) if bound]
        return where, [*(after or ()), *(upto or ())]

    def order(self, way: str = "") -> str:
        return "order by " + ", ".join(f"{k} {way}".strip() for k in self.key)

    def ranges(self, after: tuple | None, upto: tuple | None) -> list[Range]:
        """(after, upto] cut into ranges of about as many rows each; the cuts come from the keys alone."""
        where, values = self.between(after, upto)
        names = ", ".join(self.key)
        tiles = f"select {names}, ntile({self.partitions}) over ({self.order()}) as tile from ({self.query}) k where {' and '.join([f'{k} is not null' for k in self.key] + where)}"
        last = f"select {names}, tile, row_number() over (partition by tile {self.order('desc')}) as place from ({tiles}) t"
        text = f"select {names} from ({last}) l where place = 1 order by tile"
        with closing(import_module(self.module).connect(self.dsn)) as connection, closing(connection.cursor()) as cursor:
            cursor.execute(text, values)
            cuts = [tuple(r) for r in cursor.fetchall()]
        return [Range(a, b) for a, b in zip([after, *cuts[:-1]], cuts, strict=True)] if cuts else []

    def read(self, span: Range | None, columns: list[str]) -> Iterator[tuple]:
        """The rows of a range, page by page; of none, where there are no rows at all, nothing."""
        if span is None:
            return
        wanted = [*columns, *(k for k in self.key if k not in columns)]
        at = [wanted.index(k) for k in self.key]
        after = span.after
        while True:
            where, values = self.between(after, span.upto)
            page = self.rows(wanted, where, values, f"{self.order()} limit {self.page}")
            yield from (r[: len(columns)] for r in page)
            if len(page) < self.page:
                return
            after = tuple(page[-1][i] for i in at)


@dataclass
class Range(InputPartition):
    """Keys behind ``after`` up to ``upto``; None is open."""

    after: tuple | None
    upto: tuple | None


class _Reader(DataSourceReader):
    def __init__(self, options: Options, columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self) -> list[Range]:
        return self.options.ranges(None, None)

    def read(self, partition: Range | None) -> Iterator[tuple]:
        return self.options.read(partition, self.columns)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: Options, columns: list[str]):
        self.options, self.columns = options, columns
        self.last: list | None = None

    def initialOffset(self) -> dict:
        return {"after": None}

    def latestOffset(self) -> dict:
        found = self.options.rows(self.options.key, [], [], f"{self.options.order('desc')} limit 1")
        if found:  # never backwards: rows may have been removed
            self.last = max(self.last or [], json.loads(json.dumps(list(found[0]))))
        return {"after": self.last}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if end["after"] is None or start["after"] == end["after"]:
            return []
        self.last = max(self.last or [], end["after"])
        return self.options.ranges(start["after"] and tuple(start["after"]), tuple(end["after"]))

    def read(self, partition: Range | None) -> Iterator[tuple]:
        return self.options.read(partition, self.columns)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class KeysetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyset"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(Options.of(self.options), schema.names)

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(Options.of(self.options), schema.names)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(KeysetSource)
