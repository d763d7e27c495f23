"""Simulated sensors, as DataFrames over a running number: of spark.range in batch, of the rate source live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _drawn(seed: int) -> Column:
    """A number from 0 up to 1 for the row's running number: the same in each run, on any cluster."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("__n").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / (1 << 32)


def _one_of(seed: int, *values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(_drawn(seed) * len(values)) + 1).cast("int"))


def _between(seed: int, low: float, high: float) -> Column:
    """With two decimals."""
    return F.floor((_drawn(seed) * (high - low) + low) * 100) / 100


def _whole(seed: int, low: int, high: int) -> Column:
    return (F.floor(_drawn(seed) * (high - low + 1)) + low).cast("long")


# The names and ranges that the simulated sensors report.
SENSORS = ("s1", "s2", "s3", "s4")
POLLUTANTS = {"PM2.5": (5, 150), "PM10": (10, 200), "CO2": (300, 600), "NO2": (10, 80)}
ZONES = ("north", "south", "east", "west")
SPEEDS = {"J1": (20, 45), "J2": (30, 65), "J3": (60, 110), "J4": (25, 55), "J5": (10, 35)}
VEHICLES = ("car", "truck", "bus", "motorcycle", "ambulance")
PHASES = {"GREEN": 30, "YELLOW": 5, "RED": 25}
#: Weights of a low (1 to 5) and a high (6 to 10) congestion level.
CONGESTION = {"J1": (4, 6), "J2": (3, 7), "J3": (7, 3), "J4": (5, 5), "J5": (6, 4)}


def _ranged(name: Column, ranges: dict[str, tuple[float, float]], seed: int) -> Column:
    """A number in the range that goes with `name`."""
    found = F.lit(None).cast("double")
    for k, (low, high) in ranges.items():
        found = F.when(name == k, _between(seed, low, high)).otherwise(found)
    return found


def events_of(rows: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    """Events for rows (timestamp, value): the time, and a running number."""
    s, n = seed * 100, F.col("value").alias("__n")
    rows = rows.select(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), n)
    stamp = F.col("timestamp")
    junction = F.concat(F.lit("J"), (F.col("__n") % 5 + 1).cast("string"))
    if kind == "pollution":
        drawn = rows.select("*", _one_of(s + 1, *SENSORS).alias("sensor_id"), _one_of(s + 2, *POLLUTANTS).alias("pollutant"))
        return drawn.withColumn("value", _ranged(F.col("pollutant"), POLLUTANTS, s + 3)).drop("__n")
    if kind == "weather":
        return rows.select(stamp, _one_of(s + 1, *SENSORS).alias("sensor_id"), _between(s + 2, 20, 90).alias("humidity"), _one_of(s + 3, *ZONES).alias("zone"))
    if kind == "vehicle":
        drawn = rows.select("*", F.concat(F.lit("VH-"), _whole(s + 1, 1000, 9999).cast("string")).alias("vehicle_id"), _one_of(s + 2, *SPEEDS).alias("junction_id"))
        return drawn.withColumns({"speed": _ranged(F.col("junction_id"), SPEEDS, s + 3), "vehicle_type": _one_of(s + 4, *VEHICLES), "lane": _whole(s + 5, 1, 4)}).drop("__n")
    if kind == "signal":
        # five junctions step through the phases, one event each a round
        phases = list(PHASES)
        turn = F.element_at(F.array(*map(F.lit, phases)), (F.floor(F.col("__n") / 5) % 3 + 1).cast("int"))
        drawn = rows.select(stamp, junction.alias("junction_id"), turn.alias("signal_phase"), _drawn(s + 1).alias("__r"), _drawn(s + 2).alias("__q"))
        lasts, low = F.lit(None).cast("long"), F.lit(None).cast("double")
        for k, n in PHASES.items():
            lasts = F.when(F.col("signal_phase") == k, F.lit(n).cast("long")).otherwise(lasts)
        for k, (a, b) in CONGESTION.items():
            low = F.when(F.col("junction_id") == k, a / (a + b)).otherwise(low)
        level = F.floor(F.col("__q") * 5) + F.when(F.col("__r") < low, 1).otherwise(6)
        return drawn.withColumns({"phase_duration": lasts, "congestion_level": level.cast("long")}).drop("__r", "__q")
    raise ValueError(f"no sensor is of kind {kind!r}")


KINDS = ("pollution", "weather", "vehicle", "signal")


def generated(spark: SparkSession, kind: str, n: int, seed: int = 0, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """`n` events, one a second (of signals, five a second)."""
    every = 5 if kind == "signal" else 1
    rows = spark.range(n).select(F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.floor(F.col("id") / every)).alias("timestamp"), F.col("id").alias("value"))
    return events_of(rows, kind, seed)


def live(spark: SparkSession, kind: str, rows_per_second: int = 1, seed: int = 0) -> DataFrame:
    rows = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return events_of(rows, kind, seed)
