"""A small fluent query over a table: select, predicates with not_, order, limit, and writes."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


class Query:
    """Predicates are joined by AND; a later order or limit replaces the one before; names must be plain identifiers."""

    def __init__(self, rows: DataFrame):
        self._rows, self._columns, self._tests = rows, ["*"], []
        self._order, self._limit, self._negate = None, None, False

    @staticmethod
    def _checked(name: str) -> str:
        if not NAME.fullmatch(name):
            raise ValueError(f"not a column name: {name!r}")
        return name

    def select(self, columns: str = "*") -> Query:
        names = [c.strip() for c in columns.split(",")]
        self._columns = ["*"] if names == ["*"] else [self._checked(c) for c in names]
        return self

    @property
    def not_(self) -> Query:
        self._negate = True
        return self

    def _add(self, test: Column) -> Query:
        self._tests.append(~test if self._negate else test)
        self._negate = False
        return self

    def eq(self, column: str, value) -> Query:
        return self._add(F.col(self._checked(column)) == value)

    def neq(self, column: str, value) -> Query:
        return self._add(F.col(self._checked(column)) != value)

    def is_(self, column: str, value) -> Query:
        c = F.col(self._checked(column))
        return self._add(c.isNull() if value is None or value == "null" else c.eqNullSafe(F.lit(value)))

    def in_(self, column: str, values) -> Query:
        """An empty list holds for no row."""
        values = list(values)
        return self._add(F.col(self._checked(column)).isin(*values) if values else F.lit(False))

    def ilike(self, column: str, pattern: str, raw: bool = False) -> Query:
        """Case aside; % and _ in the pattern are wildcards only if raw."""
        if not raw:
            pattern = re.sub(r"([%_\\])", r"\\\1", pattern)
        return self._add(F.col(self._checked(column)).ilike(pattern))

    def order(self, column: str, desc: bool = False, nulls_first: bool | None = None) -> Query:
        c = F.col(self._checked(column))
        first = desc if nulls_first is None else nulls_first
        self._order = (c.desc_nulls_first() if first else c.desc_nulls_last()) if desc else (c.asc_nulls_first() if first else c.asc_nulls_last())
        return self

    def limit(self, n: int) -> Query:
        self._limit = n
        return self

    def execute(self) -> DataFrame:
        out = self._rows
        for t in self._tests:
            out = out.where(t)
        if self._order is not None:
            out = out.orderBy(self._order)
        if self._limit is not None:
            out = out.limit(self._limit)
        return out if self._columns == ["*"] else out.select(*self._columns)


    # Writes: what the table is after them.

    def _hit(self) -> Column:
        out = F.lit(True)
        for t in self._tests:
            out = out & t
        return F.coalesce(out, F.lit(False))

    def update(self, values: dict) -> DataFrame:
        """The table with these values in the rows that the predicates hold for; dicts and lists become JSON texts."""
        hit = self._hit()
        new = {self._checked(c): F.when(hit, F.lit(coerce(v))).otherwise(F.col(c)) for c, v in values.items()}
        return self._rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in self._rows.columns])

    def delete(self) -> DataFrame:
        return self._rows.where(~self._hit())

    def insert(self, rows) -> DataFrame:
        """The table with rows, a dict or a list of dicts, at its end; columns that a row lacks are null."""
        return self._rows.unionByName(self._new(rows))

    def upsert(self, rows, on_conflict: str, preserve: tuple[str, ...] = ()) -> DataFrame:
        """The table with rows put in by the columns of on_conflict; nulls do not erase the columns in preserve."""
        from .mutate import upsert

        rows = [rows] if isinstance(rows, dict) else list(rows)
        names = {c for r in rows for c in r}
        return upsert(self._rows, self._new(rows).select(*[c for c in self._rows.columns if c in names]), [self._checked(c.strip()) for c in on_conflict.split(",")], preserve)

    def _new(self, rows) -> DataFrame:
        rows = [rows] if isinstance(rows, dict) else list(rows)
        for c in {c for r in rows for c in r}:
            self._checked(c)
        data = [tuple(coerce(r.get(c)) for c in self._rows.columns) for r in rows]
        return self._rows.sparkSession.createDataFrame(data, self._rows.schema)


def coerce(value):
    """Dicts and lists as JSON texts, nulls in them kept; anything else as it is."""
    return json.dumps(value) if isinstance(value, (dict, list)) else value


def from_table(rows: DataFrame) -> Query:
    return Query(rows)
