"""Tables: immutable plans over a DataFrame with a hidden event time.

Every method returns a new table, so one table can feed many queries.  Types
and names are checked at once; the work is left to Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr import Aggregate, ColumnRef, Expression, aliased
from ..operators import EVENT_TIME, joins, sets
from ..operators.aggregates import distinct_aggregates, parts_of, result
from ..operators.running import running_aggregate
from ..operators.windows import stream_window_aggregate, window_aggregate
from ..schema import Schema
from ..time import Duration, Interval, TimePolicy, Window, WindowType
from ..types import DataType

if TYPE_CHECKING:
    from .env import TableEnvironment


def as_expression(x: object) -> Expression:
    if isinstance(x, str):
        return ColumnRef(x)
    if isinstance(x, Expression):
        return x
    raise TypeError(f"a column is a name or an expression, not {type(x).__name__}")


@dataclass(frozen=True, eq=False)
class Table:
    env: TableEnvironment
    table_id: str
    schema: Schema
    df: DataFrame
    query_name: str | None = None

    # -- plumbing ----------------------------------------------------------
    def _next(self, df: DataFrame, schema: Schema) -> Table:
        return replace(self, df=df, schema=schema)

    def _finished(self, df: DataFrame, schema: Schema, kind: str) -> Query:
        return self.env.create_query(Query(self.env, "", schema, df), self.query_name, kind)

    def name_query(self, name: str) -> Table:
        """Name of the next query made from here, wherever this stands in the chain."""
        if not name:
            raise ValueError("a query's name isn't empty")
        return replace(self, query_name=name)

    def dataframe(self, event_time: bool = False) -> DataFrame:
        """The rows in schema order, without the hidden event time unless asked for."""
        return self.df.select(*(f"`{c}`" for c in self.schema.names), *([EVENT_TIME] if event_time else []))

    # -- one input ---------------------------------------------------------
    def where(self, condition: Expression) -> Table:
        if not isinstance(condition, Expression):
            raise TypeError("a condition is an expression")
        if condition.aggregates():
            raise ValueError("filter aggregates on the query that makes them")
        if condition.type(self.schema) is not DataType.BOOLEAN:
            raise TypeError("a condition has type BOOLEAN")
        return self._next(self.df.where(condition.column(self.schema)), self.schema)

    def select(self, *columns: str | Expression, distinct: bool = False) -> Query:
        if not columns:
            raise ValueError("select needs a column")
        chosen = [as_expression(c) for c in columns]
        if any(c.aggregates() for c in chosen):
            return GroupedTable(self, (), None).select(*chosen, distinct=distinct)
        names = [c.name for c in chosen]
        if len(set(names)) < len(names):
            raise ValueError(f"two columns have one name: {names}")
        schema = Schema({c.name: c.type(self.schema) for c in chosen})
        df = self.df.select(*(aliased(c, self.schema) for c in chosen), EVENT_TIME)
        return self._finished(self._distinct(df, schema) if distinct else df, schema, "select")

    def add_columns(self, *columns: Expression) -> Query:
        if not columns:
            raise ValueError("add_columns needs an expression")
        return self.select(*self.schema.names, *columns)

    def drop_columns(self, *names: str) -> Query:
        for n in names:
            if n not in self.schema:
                raise KeyError(f"no column {n!r}")
        left = [n for n in self.schema if n not in names]
        if not left:
            raise RuntimeError("a table keeps a column at least")
        return self.select(*left)

    def rename_columns(self, names: dict[str, str]) -> Query:
        if not isinstance(names, dict):
            raise TypeError("give old and new names as a dict")
        if not names:
            raise ValueError("no column to rename")
        for n in names:
            if n not in self.schema:
                raise KeyError(f"no column {n!r}")
        return self.select(*(ColumnRef(n).alias(names.get(n, n)) for n in self.schema))

    def group_by(self, *keys: str, window: Window | None = None) -> GroupedTable:
        for k in keys:
            if not isinstance(k, str):
                raise TypeError("keys are column names")
            if k not in self.schema:
                raise RuntimeError(f"no column {k!r} to group by")
        if window is not None:
            if not isinstance(window, Window):
                raise TypeError("window is a Window")
            if window.kind is WindowType.TIME:
                self.env.need_time("a time window")
        return GroupedTable(self, keys, window)

    # On streams `within`, by default the environment's state_ttl, bounds the state of distinct, union and intersections:
    # a row is forgotten so long after its state changed last, by the watermark or, without times, by the clock.
    def distinct(self, within: Duration | None = None) -> Table:
        """Rows once each; on streams, copies that come after a row was forgotten pass again."""
        return self._next(self._distinct(self.df, self.schema, within), self.schema)

    def _distinct(self, df: DataFrame, schema: Schema, within: Duration | None = None) -> DataFrame:
        within = within or self.env.state_ttl
        if within is None or not df.isStreaming:
            return sets.distinct(df)
        from ..streaming.forgetting import distinct_within

        return distinct_within(df, schema.names, within, EVENT_TIME)

    # -- two inputs --------------------------------------------------------
    def join(self, other: Table, on: list[str], attachment: Interval | Window | None = None, where: Expression | None = None) -> Table:
        """Inner join on equal keys within an interval or a window of time.

        attachment=None, an extension, joins without a time bound.  `where` is
        a condition on the result's columns.
        """
        self._check_env(other)
        if isinstance(attachment, Window) and attachment.kind is WindowType.COUNT:
            raise TypeError("joins know no count windows")
        if attachment is not None and not isinstance(attachment, (Window, Interval)):
            raise TypeError("attachment is an Interval or a Window")
        if attachment is not None:
            self.env.need_time("a join in time")
        for k in on:
            for side in (self, other):
                if k not in side.schema:
                    raise ValueError(f"no column {k!r} to join on in {side.table_id}")
            if self.schema[k] is not other.schema[k]:
                raise TypeError(f"key {k!r} has two types")
        fields = {k: self.schema[k] for k in on}
        for side in (self, other):
            for n, t in side.schema.items():
                if n not in on:
                    if n in fields:
                        raise ValueError(f"column {n!r} stands on both sides")
                    fields[n] = t
        schema = Schema(fields)
        if isinstance(attachment, Interval):
            df = joins.interval_join(self.df, other.df, on, attachment)
        elif isinstance(attachment, Window):
            df = joins.window_join(self.df, other.df, on, attachment, self.env.baseline)
        else:
            df = joins.equi_join(self.df, other.df, on)
        out = self._next(df.select(*(f"`{c}`" for c in schema.names), EVENT_TIME), schema)
        return out.where(where) if where is not None else out

    def _check_env(self, other: Table) -> None:
        if other.env is not self.env:
            raise ValueError("both tables belong to one environment")

    def _aligned(self, other: Table) -> Table:
        self._check_env(other)
        if self.schema != other.schema:
            raise ValueError(f"schemas differ: {self.schema} and {other.schema}")
        return other

    def union_all(self, other: Table) -> Table:
        return self._next(sets.union_all(self.df, self._aligned(other).df), self.schema)

    def union(self, other: Table, within: Duration | None = None) -> Table:
        return self.union_all(other).distinct(within)

    def _common(self, other: Table, all_copies: bool, within: Duration | None) -> Table:
        left, right = self.df, self._aligned(other).df
        within = within or self.env.state_ttl
        if within is not None and (left.isStreaming or right.isStreaming):
            from ..streaming.forgetting import intersect_within

            df = intersect_within(left, right, self.schema.names, within, EVENT_TIME, all_copies)
        elif left.isStreaming or right.isStreaming:
            from ..streaming.stateful import Intersect

            df = Intersect.of(left, right, all_copies, self.schema.names)
        else:
            df = (sets.intersect_all if all_copies else sets.intersect)(left, right)
        return self._next(df, self.schema)

    def intersect(self, other: Table, within: Duration | None = None) -> Table:
        return self._common(other, False, within)

    def intersect_all(self, other: Table, within: Duration | None = None) -> Table:
        return self._common(other, True, within)


class Query(Table):
    """A finished, registered select; a source for further tables."""


@dataclass(frozen=True)
class GroupedTable:
    """A table grouped by keys and perhaps a window; only select may follow."""

    table: Table
    keys: tuple[str, ...]
    window: Window | None

    def where(self, condition: Expression) -> Table:
        raise RuntimeError("after group_by comes select; filter its result")

    def name_query(self, name: str) -> GroupedTable:
        return replace(self, table=self.table.name_query(name))

    def select(self, *columns: str | Expression, distinct: bool = False) -> Query:
        if not columns:
            raise ValueError("select needs a column")
        t, keys = self.table, list(self.keys)
        chosen = [as_expression(c) for c in columns]
        for c in chosen:
            if wrong := c.free_columns() - set(keys):
                raise ValueError(f"{sorted(wrong)} is neither a key nor aggregated")
        found = distinct_aggregates([a for c in chosen for a in c.aggregates()])
        mid = {k: t.schema[k] for k in keys} | {a.default_name: a.type(t.schema) for a in found}
        grouped = Schema(mid)
        df = self._grouped(keys, found)

        def to_result(e: Expression) -> Expression | None:
            if isinstance(e, Aggregate):
                ref = ColumnRef(e.default_name)
                return ref.alias(e._alias) if e._alias else ref
            return None

        final = [c.replaced(to_result) for c in chosen]
        names = [c.name for c in chosen]
        if len(set(names)) < len(names):
            raise ValueError(f"two columns have one name: {names}")
        schema = Schema({n: c.type(grouped) for n, c in zip(names, final)})
        out = df.select(*(c.column(grouped).alias(n) for n, c in zip(names, final)), EVENT_TIME)
        return t._finished(t._distinct(out, schema) if distinct else out, schema, "group")

    def _grouped(self, keys: list[str], found: list[Aggregate]) -> DataFrame:
        t, env = self.table, self.table.env
        order = [n for n in t.schema.names if n not in keys]
        by_count = self.window is not None and self.window.kind is WindowType.COUNT
        if t.df.isStreaming and (by_count or (env.aggregates == "running" and self.window is None)):
            from ..streaming.aggregates import stream_count_windows, stream_running

            # rows wait for their turn where they have a time, else they come as they come
            time = EVENT_TIME if env.policy is TimePolicy.EVENT_TIME else None
            parts = parts_of(found, t.schema)
            if by_count:
                totals = stream_count_windows(t.df, keys, self.window, parts, order, time)
            else:
                totals = stream_running(t.df, keys, parts, order, time)
            return totals.select(*(f"`{k}`" for k in keys), *(result(a, t.schema, env.truncate_avg) for a in found), EVENT_TIME)
        if t.df.isStreaming and self.window is not None:
            if env.emit_empty:
                raise TypeError("windows without rows are for batches: a stream does not know which ones are to come")
            return stream_window_aggregate(t.df, t.schema, keys, self.window, env.baseline, found, env.truncate_avg)
        if self.window is not None:
            return window_aggregate(
                t.df, t.schema, keys, self.window, env.baseline, found, order=order,
                emit_empty=env.emit_empty and self.window.kind is WindowType.TIME, truncate_avg=env.truncate_avg,
            )
        if env.aggregates == "running":
            return running_aggregate(t.df, t.schema, keys, found, order, env.truncate_avg)
        parts = parts_of(found, t.schema)
        by = [f"`{k}`" for k in keys]
        totals = t.df.groupBy(*by).agg(*(p.from_rows.alias(p.name) for p in parts), F.max(EVENT_TIME).alias(EVENT_TIME))
        return totals.select(*by, *(result(a, t.schema, env.truncate_avg) for a in found), EVENT_TIME)


__all__ = ["GroupedTable", "Query", "Table", "TimePolicy"]
