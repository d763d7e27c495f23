"""Kafka: settings, and topics as streaming frames and sinks. Spark's Kafka connector must be on the class path."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import struct
from ..plans.deployment import Stream

# A topic that keeps nothing.
EPHEMERAL = {"log.retention.ms": 1, "log.segment.bytes": 1048576, "log.cleanup.policy": "delete", "log.retention.check.interval.ms": 300000}


@dataclass(frozen=True)
class KafkaSettings:
    broker: str = "localhost:9092"
    group_id: str | None = None

    def is_persistent(self) -> bool:
        return False

    def topic_config(self) -> dict[str, object]:
        return dict(EPHEMERAL)

    def producer_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.broker, "kafka.acks": "all", "kafka.retries": "3", "kafka.compression.type": "gzip"}

    def consumer_options(self) -> dict[str, str]:
        """New events only; Spark's checkpoint, not the broker, knows how far a query has read."""
        own = {"kafka.group.id": self.group_id} if self.group_id else {}
        return {"kafka.bootstrap.servers": self.broker, "startingOffsets": "latest", "kafka.session.timeout.ms": "30000", "failOnDataLoss": "false"} | own

    def describe(self) -> str:
        return f"ephemeral topics: messages are kept for {EPHEMERAL['log.retention.ms']} ms"


_default = KafkaSettings()


def set_default_settings(broker: str = KafkaSettings.broker) -> None:
    global _default
    _default = KafkaSettings(broker)


def default_settings() -> KafkaSettings:
    return _default


def parsed(values: DataFrame, stream: Stream) -> DataFrame:
    """JSON events in a column `value` as the stream's columns; what cannot be read is null."""
    event = F.from_json(F.col("value").cast("string"), struct(stream.columns), {"mode": "PERMISSIVE"})
    return values.select(event.alias("e"), *(c for c in ("timestamp",) if c in values.columns)).select("e.*")


def read_topic(spark: SparkSession, stream: Stream, settings: KafkaSettings | None = None) -> DataFrame:
    reader = spark.readStream.format("kafka").options(**(settings or _default).consumer_options()).option("subscribe", stream.topic)
    return parsed(reader.load(), stream)


def as_messages(df: DataFrame) -> DataFrame:
    """Rows as JSON; null fields are left out."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value"))


def topic_sink(topic: str, settings: KafkaSettings | None = None) -> Callable[[DataFrame, int], None]:
    def send(df: DataFrame, _: int) -> None:
        as_messages(df).write.format("kafka").options(**(settings or _default).producer_options()).option("topic", topic).save()

    return send
