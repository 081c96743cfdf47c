"""Kafka source and sink: options for Spark's own connector.

The connector's package must be on the class path; building and checking the
options needs no broker.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Schema
from ..time import Duration


def _brokers(brokers: str | list[str]) -> str:
    found = brokers if isinstance(brokers, str) else ",".join(brokers)
    if not found:
        raise ValueError("name at least one broker")
    return found


@dataclass(frozen=True)
class KafkaSource:
    """Topics to read; offsets is "earliest", "latest" or topic -> partition -> offset."""

    brokers: str | list[str]
    topics: list[str]
    schema: Schema | None = None
    group_id: str | None = None
    offsets: str | Mapping[str, Mapping[int, int]] = "latest"
    assignment: str | None = None
    idle_timeout: Duration | None = None
    extra: Mapping[str, str] = field(default_factory=dict)

    def options(self, streaming: bool = True) -> dict[str, str]:
        """Spark's options; a batch has no latest offset to begin with, so it reads from the earliest."""
        import json

        if not self.topics:
            raise ValueError("name at least one topic")
        out = {"kafka.bootstrap.servers": _brokers(self.brokers), "subscribe": ",".join(self.topics)}
        if isinstance(self.offsets, str):
            if self.offsets not in ("earliest", "latest"):
                raise ValueError("offsets are earliest, latest or a mapping")
            out["startingOffsets"] = self.offsets if streaming else "earliest"
        else:
            out["startingOffsets"] = json.dumps({t: {str(p): o for p, o in x.items()} for t, x in self.offsets.items()})
        if self.group_id:
            out["kafka.group.id"] = self.group_id
        if self.assignment:
            out["kafka.partition.assignment.strategy"] = self.assignment
        if self.idle_timeout:
            out["kafkaConsumer.pollTimeoutMs"] = str(max(1, self.idle_timeout.us // 1000))
        return out | dict(self.extra)

    def read(self, spark: SparkSession, streaming: bool = True) -> DataFrame:
        """Rows of the schema parsed from JSON values, or key, value and timestamp."""
        raw = (spark.readStream if streaming else spark.read).format("kafka").options(**self.options(streaming)).load()
        if self.schema is None:
            return raw.selectExpr("cast(key as string) key", "cast(value as string) value", "timestamp")
        return raw.select(F.from_json(F.col("value").cast("string"), self.schema.spark).alias("v")).select("v.*")


@dataclass(frozen=True)
class KafkaSink:
    brokers: str | list[str]
    topic: str
    key: str | None = None
    extra: Mapping[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        if not self.topic:
            raise ValueError("name a topic")
        return {"kafka.bootstrap.servers": _brokers(self.brokers), "topic": self.topic} | dict(self.extra)

    def encode(self, df: DataFrame) -> DataFrame:
        """key and value columns: rows as JSON."""
        value = F.to_json(F.struct(*(f"`{c}`" for c in df.columns))).alias("value")
        key = F.col(f"`{self.key}`").cast("string") if self.key else F.lit(None).cast("string")
        return df.select(key.alias("key"), value)

    def write(self, df: DataFrame, checkpoint: str | None = None):
        encoded = self.encode(df)
        if df.isStreaming:
            return encoded.writeStream.format("kafka").options(**self.options()).option("checkpointLocation", checkpoint).start()
        return encoded.write.format("kafka").options(**self.options()).save()
