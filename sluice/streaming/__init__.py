"""Stateful operators on streams, for what Spark's own streaming refuses."""

from .aggregates import CountWindows, stream_count_windows, stream_running
from .forgetting import distinct_within, intersect_within
from .monitor import Monitor
from .run import bounded, finish, run_available, sink_metrics
from .stateful import Intersect, KeyedFold, apply_keyed, p_filter, p_flat_map, p_keyed_windows, p_map, p_reduce, p_sink

__all__ = [
    "CountWindows", "Intersect", "KeyedFold", "Monitor", "apply_keyed", "bounded", "distinct_within", "finish", "intersect_within", "p_filter", "p_flat_map", "p_keyed_windows", "p_map",
    "p_reduce", "p_sink", "run_available", "sink_metrics", "stream_count_windows", "stream_running",
]
