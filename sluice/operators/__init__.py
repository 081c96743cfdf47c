"""Relational and stream operators on DataFrames with a hidden event time."""

#: Hidden column that carries a row's event time through every operator.
EVENT_TIME = "__event_time"
