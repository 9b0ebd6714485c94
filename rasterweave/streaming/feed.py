"""Structured Streaming: frame status, causal filling and running metric means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterweave.operators.quality import FRAME_KEYS, flag_frames, frame_statistics_arrays


def flag_arriving(frames: DataFrame, strict: bool = False, with_prob: bool = True) -> DataFrame:
    """Frame status of a stream of frames. Stateless: each frame is judged alone."""
    prob = "cloud_prob" if with_prob else None
    return flag_frames(frame_statistics_arrays(frames, FRAME_KEYS, prob=prob), strict, with_prob)


def fill_arriving(
    stream: DataFrame,
    event_time: str,
    keys: list[str],
    value: str = "v",
    mask: str = "mask",
    order: str = "event_id",
    delay: str = "10 minutes",
    idle_ms: int | None = None,
) -> DataFrame:
    """Last visible value per key, carried across micro-batches.

    State is the rows of a key that are newer than the watermark, and the value carried
    up to them; the watermark's ``delay`` bounds it. A late row is filled from what came
    before it in time, and hidden rows that it changes are emitted again, both with
    ``late`` = 1; rows behind the watermark are dropped by it. With ``idle_ms`` the
    state of a silent key expires.
    """
    schema_of = {f.name: f.dataType.simpleString() for f in stream.schema}
    head = ", ".join(f"{c} {schema_of[c]}" for c in keys)
    out_schema = f"{head}, {order} {schema_of[order]}, filled double, late int"
    state_schema = "at array<bigint>, no array<bigint>, value array<double>, base double"
    timeout = GroupStateTimeout.EventTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout

    def carried(value: np.ndarray, base: float | None) -> np.ndarray:
        out = pd.Series(value, dtype="float64").ffill()
        return (out if base is None else out.fillna(base)).to_numpy()

    def carry(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old_at, old_no, old_value, base = state.get if state.exists else ([], [], [], None)
        old_value = np.array([np.nan if v is None else v for v in old_value], "float64")
        before = carried(old_value, base)
        pdf = pd.concat(list(chunks))
        new_at = pdf[event_time].astype("datetime64[us]").astype("int64").to_numpy()
        at = np.concatenate((np.array(old_at, "int64"), new_at))
        no = np.concatenate((np.array(old_no, "int64"), pdf[order].to_numpy()))
        value = np.concatenate((old_value, pdf[value_name].where(pdf[mask] == 0).to_numpy("float64")))
        n = len(before)
        seen = max(zip(old_at, old_no), default=(-(2**62), -1))
        late = np.array([True] * n + [(a, o) <= seen for a, o in zip(new_at, no[n:])], bool)
        line = np.lexsort((no, at))
        filled = np.empty(len(at))
        filled[line] = carried(value[line], base)
        changed = np.ones(len(at), bool)
        changed[:n] = ~((filled[:n] == before) | (np.isnan(filled[:n]) & np.isnan(before)))
        # What the watermark has passed cannot get an earlier row any more.
        passed = at[line] < state.getCurrentWatermarkMs() * 1000
        if passed.any():
            last = filled[line][passed][-1]
            base = base if np.isnan(last) else float(last)
        kept = line[~passed]
        state.update((
            at[kept].tolist(), no[kept].tolist(), [None if np.isnan(v) else float(v) for v in value[kept]], base,
        ))
        if idle_ms:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(at.max()) // 1000) + idle_ms)
        out = {c: key[i] for i, c in enumerate(keys)}
        some = line[changed[line]]
        yield pd.DataFrame({**out, order: no[some], "filled": filled[some], "late": late[some]}).astype({"late": "int32"})

    value_name = value
    return (
        stream.select(*keys, event_time, order, value, mask)
        .withWatermark(event_time, delay)
        .groupBy(*keys)
        .applyInPandasWithState(carry, out_schema, state_schema, "append", timeout)
    )


def upsert_into(stream: DataFrame, folder: str) -> DataStreamWriter:
    """A writer of changed rows: each micro-batch is a folder of its own, written over if it runs again.

    Rows are what the query's keys are at now, windows that are still open included; read the
    current ones with :func:`latest`.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write)


def latest(spark: SparkSession, folder: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The last row of each key that :func:`upsert_into` has written."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(folder)
    rest = [c for c in schema.names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest]).select(*schema.names)


def metric_means(
    stream: DataFrame,
    event_time: str,
    keys: list[str],
    value: str = "value",
    weight: str | None = None,
    window: str | None = "1 hour",
    delay: str = "10 minutes",
) -> DataFrame:
    """Weighted running mean per key: per tumbling window, or since the start without one."""
    n = F.col(weight).cast("double") if weight else F.lit(1.0)
    by = list(keys)
    rows = stream
    if window:
        rows = rows.withWatermark(event_time, delay)
        by = [F.window(event_time, window).alias("window"), *by]
    mean = F.try_divide(F.sum(F.col(value) * n), F.sum(n))
    return rows.groupBy(*by).agg(mean.alias("mean"), F.sum(n).alias("weight"))
