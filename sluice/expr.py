"""Typed expressions over named columns, compiled to Spark columns.

Every expression knows its type for a schema, so a wrong plan is refused when
it is built.  Both operands of an operator may be plain Python values.
"""

from __future__ import annotations

import operator
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import Schema
from .types import DataType, comparable, promote, type_of_value


def wrap(x: object) -> Expression:
    return x if isinstance(x, Expression) else Literal(x)


class Expression(ABC):
    _alias: str | None = None

    @property
    @abstractmethod
    def default_name(self) -> str: ...

    @abstractmethod
    def type(self, schema: Schema) -> DataType:
        """Result type; raises KeyError or TypeError where the expression doesn't fit."""

    @abstractmethod
    def column(self, schema: Schema) -> Column:
        """The Spark column, without alias."""

    @property
    def operands(self) -> tuple[Expression, ...]:
        return ()

    def rebuilt(self, operands: tuple[Expression, ...]) -> Expression:
        return self

    @property
    def name(self) -> str:
        return self._alias or self.default_name

    def alias(self, name: str) -> Expression:
        out = object.__new__(type(self))
        out.__dict__.update(self.__dict__)
        out._alias = name
        return out

    def aggregates(self) -> list[Aggregate]:
        return [a for x in self.operands for a in x.aggregates()]

    def free_columns(self) -> set[str]:
        """Columns used outside aggregates."""
        return {c for x in self.operands for c in x.free_columns()}

    def replaced(self, swap: Callable[[Expression], Expression | None]) -> Expression:
        """The expression with parts exchanged, outermost first."""
        new = swap(self)
        if new is not None:
            return new
        return self.rebuilt(tuple(x.replaced(swap) for x in self.operands)) if self.operands else self

    def __hash__(self) -> int:
        return id(self)

    def __add__(self, x): return Arithmetic("plus", self, wrap(x))  # noqa: E704
    def __radd__(self, x): return Arithmetic("plus", wrap(x), self)  # noqa: E704
    def __sub__(self, x): return Arithmetic("minus", self, wrap(x))  # noqa: E704
    def __rsub__(self, x): return Arithmetic("minus", wrap(x), self)  # noqa: E704
    def __mul__(self, x): return Arithmetic("mult", self, wrap(x))  # noqa: E704
    def __rmul__(self, x): return Arithmetic("mult", wrap(x), self)  # noqa: E704
    def __truediv__(self, x): return Arithmetic("div", self, wrap(x))  # noqa: E704
    def __rtruediv__(self, x): return Arithmetic("div", wrap(x), self)  # noqa: E704
    def __gt__(self, x): return Comparison("gt", self, wrap(x))  # noqa: E704
    def __lt__(self, x): return Comparison("lt", self, wrap(x))  # noqa: E704
    def __ge__(self, x): return Comparison("ge", self, wrap(x))  # noqa: E704
    def __le__(self, x): return Comparison("le", self, wrap(x))  # noqa: E704
    def __eq__(self, x): return Comparison("eq", self, wrap(x))  # type: ignore[override]  # noqa: E704
    def __ne__(self, x): return Comparison("ne", self, wrap(x))  # type: ignore[override]  # noqa: E704
    def __and__(self, x): return Logical("and", self, wrap(x))  # noqa: E704
    def __rand__(self, x): return Logical("and", wrap(x), self)  # noqa: E704
    def __or__(self, x): return Logical("or", self, wrap(x))  # noqa: E704
    def __ror__(self, x): return Logical("or", wrap(x), self)  # noqa: E704
    def __invert__(self): return Not(self)  # noqa: E704

    def __bool__(self) -> bool:
        raise TypeError("combine conditions with & and |")


class ColumnRef(Expression):
    def __init__(self, source: str):
        self.source = source

    @property
    def default_name(self) -> str:
        return self.source

    def type(self, schema: Schema) -> DataType:
        if self.source not in schema:
            raise KeyError(f"no column {self.source!r} in {schema}")
        return schema[self.source]

    def column(self, schema: Schema) -> Column:
        self.type(schema)
        return F.col(f"`{self.source}`")

    def free_columns(self) -> set[str]:
        return {self.source}


class Literal(Expression):
    def __init__(self, value: object, data_type: DataType | str | None = None):
        self.value = value
        self.data_type = DataType.of(data_type) if data_type else type_of_value(value)
        if self.data_type is DataType.ISO8601:
            raise TypeError("there are no time literals")

    @property
    def default_name(self) -> str:
        return str(self.value)

    def type(self, schema: Schema) -> DataType:
        return self.data_type

    def column(self, schema: Schema) -> Column:
        return F.lit(self.value).cast(self.data_type.spark)


class _Binary(Expression):
    def __init__(self, op: str, left: Expression, right: Expression):
        self.op, self.left, self.right = op, left, right

    @property
    def default_name(self) -> str:
        return f"{self.left.name}_{self.op}_{self.right.name}"

    @property
    def operands(self) -> tuple[Expression, ...]:
        return self.left, self.right

    def rebuilt(self, operands: tuple[Expression, ...]) -> Expression:
        out = type(self)(self.op, *operands)
        out._alias = self._alias or self.default_name
        return out


class Arithmetic(_Binary):
    """Numbers only; the result has the wider type, and whole numbers divide towards zero."""

    def type(self, schema: Schema) -> DataType:
        return promote(self.left.type(schema), self.right.type(schema))

    def column(self, schema: Schema) -> Column:
        t = self.type(schema)
        a, b = (x.column(schema).cast(t.spark) for x in self.operands)
        if self.op == "div" and t in (DataType.INT, DataType.BIGINT):
            return F.call_function("div", a, b).cast(t.spark)
        return {"plus": operator.add, "minus": operator.sub, "mult": operator.mul, "div": operator.truediv}[self.op](a, b).cast(t.spark)


class Comparison(_Binary):
    def type(self, schema: Schema) -> DataType:
        a, b = self.left.type(schema), self.right.type(schema)
        if not comparable(a, b):
            raise TypeError(f"{a.name} and {b.name} can't be compared")
        return DataType.BOOLEAN

    def column(self, schema: Schema) -> Column:
        self.type(schema)
        return getattr(operator, self.op)(self.left.column(schema), self.right.column(schema))


class Logical(_Binary):
    def type(self, schema: Schema) -> DataType:
        if any(x.type(schema) is not DataType.BOOLEAN for x in self.operands):
            raise TypeError(f"{self.op} needs conditions on both sides")
        return DataType.BOOLEAN

    def column(self, schema: Schema) -> Column:
        self.type(schema)
        a, b = (x.column(schema) for x in self.operands)
        return a & b if self.op == "and" else a | b


class Not(Expression):
    def __init__(self, x: Expression):
        self.x = x

    @property
    def default_name(self) -> str:
        return f"not_({self.x.name})"

    @property
    def operands(self) -> tuple[Expression, ...]:
        return (self.x,)

    def rebuilt(self, operands: tuple[Expression, ...]) -> Expression:
        out = Not(*operands)
        out._alias = self._alias or self.default_name
        return out

    def type(self, schema: Schema) -> DataType:
        if self.x.type(schema) is not DataType.BOOLEAN:
            raise TypeError("not needs a condition")
        return DataType.BOOLEAN

    def column(self, schema: Schema) -> Column:
        self.type(schema)
        return ~self.x.column(schema)


class CurrentTimestamp(Expression):
    """Time of the query (batch) or of the micro-batch (streaming)."""

    default_name = "CURRENT_TIMESTAMP"

    def type(self, schema: Schema) -> DataType:
        return DataType.ISO8601

    def column(self, schema: Schema) -> Column:
        return F.current_timestamp()


class Aggregate(Expression):
    """COUNT, SUM, AVG, MIN or MAX; all but COUNT take one numeric expression."""

    def __init__(self, func: str, target: Expression | str | None = None):
        self.func = func
        self.target = ColumnRef(target) if isinstance(target, str) else target

    @property
    def default_name(self) -> str:
        return self.func if self.target is None else f"{self.func}_{self.target.name}"

    def aggregates(self) -> list[Aggregate]:
        return [self]

    def type(self, schema: Schema) -> DataType:
        if self.target is None:
            return DataType.BIGINT
        if self.target.aggregates():
            raise TypeError("aggregates can't be nested")
        t = self.target.type(schema)
        if not t.numeric:
            raise TypeError(f"{self.func} needs numbers, not {t.name}")
        return DataType.DOUBLE if self.func == "AVG" else t

    def column(self, schema: Schema) -> Column:
        """Column by built-in aggregates, cast to the declared type."""
        t = self.type(schema)
        if self.target is None:
            return F.count(F.lit(1))
        x = self.target.column(schema)
        return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[self.func](x).cast(t.spark)


def aliased(e: Expression, schema: Schema) -> Column:
    return e.column(schema).alias(e.name)
