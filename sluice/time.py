"""Durations, windows, intervals and time policies."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from enum import Enum
from functools import total_ordering

from .types import DataType

#: Microseconds of each unit.
MICROSECONDS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


@total_ordering
@dataclass(frozen=True, eq=False)
class Duration:
    """A whole number of a unit; durations compare by their microseconds."""

    value: int
    unit: str = "us"

    def __post_init__(self) -> None:
        if isinstance(self.value, bool) or not isinstance(self.value, int):
            raise TypeError("a duration is a whole number of its unit")
        if self.unit not in MICROSECONDS:
            raise ValueError(f"unknown unit {self.unit!r}")

    @property
    def us(self) -> int:
        return self.value * MICROSECONDS[self.unit]

    def __neg__(self) -> Duration:
        return Duration(-self.value, self.unit)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Duration) and self.us == other.us

    def __lt__(self, other: Duration) -> bool:
        return self.us < other.us

    def __hash__(self) -> int:
        return hash(self.us)

    @classmethod
    def microseconds(cls, n: int) -> Duration:
        return cls(n, "us")

    @classmethod
    def milliseconds(cls, n: int) -> Duration:
        return cls(n, "ms")

    @classmethod
    def seconds(cls, n: int) -> Duration:
        return cls(n, "s")

    @classmethod
    def minutes(cls, n: int) -> Duration:
        return cls(n, "min")

    @classmethod
    def hours(cls, n: int) -> Duration:
        return cls(n, "h")

    @classmethod
    def days(cls, n: int) -> Duration:
        return cls(n, "d")


class WindowType(Enum):
    TIME = "TIME"
    COUNT = "COUNT"


@dataclass(frozen=True)
class Window:
    """Windows number k = 0, 1, ... begin at k * slide; slide defaults to size."""

    kind: WindowType
    size: int
    slide: int

    @staticmethod
    def _checked(kind: WindowType, size: object, slide: object) -> Window:
        wanted = Duration if kind is WindowType.TIME else int
        slide = size if slide is None else slide
        for what, x in (("size", size), ("slide", slide)):
            if not isinstance(x, wanted) or isinstance(x, bool):
                raise TypeError(f"the {what} of a {kind.value} window is a {wanted.__name__}")
        size, slide = (x.us if isinstance(x, Duration) else x for x in (size, slide))
        if size <= 0 or slide <= 0:
            raise ValueError("size and slide of a window are positive")
        return Window(kind, size, slide)

    @classmethod
    def createTBWindow(cls, size: Duration, slide: Duration | None = None) -> Window:  # noqa: N802
        return cls._checked(WindowType.TIME, size, slide)

    @classmethod
    def createCBWindow(cls, size: int, slide: int | None = None) -> Window:  # noqa: N802
        return cls._checked(WindowType.COUNT, size, slide)

    time, count = createTBWindow, createCBWindow


@dataclass(frozen=True)
class Interval:
    """right.time in [left.time + lower, left.time + upper], both ends included."""

    lower: Duration
    upper: Duration

    def __post_init__(self) -> None:
        if not (isinstance(self.lower, Duration) and isinstance(self.upper, Duration)):
            raise TypeError("the bounds of an interval are durations")
        if self.lower > self.upper:
            raise ValueError("an interval's lower bound is above its upper bound")


class TimePolicy(Enum):
    EVENT_TIME = "EVENT_TIME"
    INGRESS_TIME = "INGRESS_TIME"
    NO_POLICY = "NO_POLICY"


def baseline_micros(baseline: tuple[str, DataType]) -> int:
    """Microseconds since the epoch of a (text, format) baseline."""
    text, form = baseline
    if form is not DataType.ISO8601:
        raise ValueError("a baseline's format is ISO8601")
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    since = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds
