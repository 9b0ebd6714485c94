"""Streams in several micro-batches, against the batch result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rasterweave.operators.impute import impute
from rasterweave.streaming.feed import fill_arriving, latest, metric_means, upsert_into

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "sample_id string, seen_at timestamp, event_id bigint, mask int, v double"


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def rows(ids, key="a", hidden=()):
    return [(key, T0 + dt.timedelta(minutes=i), i, int(i in hidden), float(i)) for i in ids]


def drain(spark, stream, out):
    (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{out}/data")


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_fill_is_carried_across_batches_and_restarts(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    hidden = {0, 3, 4, 5, 6, 11}
    write(spark, folder, "p0", rows(range(0, 5), hidden=hidden) + rows(range(0, 2), "b"))
    drain(spark, fill_arriving(source(spark, folder), "seen_at", ["sample_id"]), out)
    write(spark, folder, "p1", rows(range(5, 12), hidden=hidden) + rows(range(2, 4), "b", {2, 3}))
    got = drain(spark, fill_arriving(source(spark, folder), "seen_at", ["sample_id"]), out)
    table = spark.read.parquet(f"{folder}/*").withColumn("day", F.lit(0)).withColumn("t", F.col("event_id"))
    want = impute(table, ["v"], ["last"], keys=["sample_id"])
    a = {(r.sample_id, r.event_id): r.filled for r in got.collect()}
    b = {(r.sample_id, r.event_id): r.v_last for r in want.collect()}
    assert a == b and len(a) == 16


def test_late_rows_are_filled_from_what_came_before(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, folder, "p0", rows([5, 6]))
    drain(spark, fill_arriving(source(spark, folder), "seen_at", ["sample_id"]), out)
    write(spark, folder, "p1", rows([3, 4, 7], hidden={4, 7}))
    got = drain(spark, fill_arriving(source(spark, folder), "seen_at", ["sample_id"]), out)
    table = {r.event_id: (r.filled, r.late) for r in got.collect()}
    assert table == {5: (5.0, 0), 6: (6.0, 0), 3: (3.0, 1), 4: (3.0, 1), 7: (6.0, 0)}


def test_hidden_rows_after_a_late_one_are_emitted_again(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, folder, "p0", rows([4, 8, 9], hidden={8}))
    drain(spark, fill_arriving(source(spark, folder), "seen_at", ["sample_id"]), out)
    write(spark, folder, "p1", rows([6]))
    got = drain(spark, fill_arriving(source(spark, folder), "seen_at", ["sample_id"]), out)
    table = sorted((r.event_id, r.filled, r.late) for r in got.collect())
    assert table == [(4, 4.0, 0), (6, 6.0, 1), (8, 4.0, 0), (8, 6.0, 1), (9, 9.0, 0)]


def test_window_means_wait_for_the_watermark(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, folder, "p0", rows([0, 30, 59, 61, 150]))
    means = metric_means(source(spark, folder), "seen_at", ["sample_id"], "v", delay="10 minutes")
    got = drain(spark, means, out)
    assert sorted((r["mean"], r.weight) for r in got.collect()) == [((0 + 30 + 59) / 3, 3.0), (61.0, 1.0)]


def test_upserts_show_open_windows_and_survive_a_repeated_batch(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for name, ids in (("p0", [0, 30]), ("p1", [45, 61, 150])):
        write(spark, folder, name, rows(ids))
        means = metric_means(source(spark, folder), "seen_at", ["sample_id"], "v", delay="3 hours")
        writer = upsert_into(means, f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    wanted = [(25.0, 3.0), (61.0, 1.0), (150.0, 1.0)]
    now = lambda: sorted((r["mean"], r.weight) for r in latest(spark, f"{out}/rows", means.schema, ["window", "sample_id"]).collect())
    assert now() == wanted
    batches = sorted(p.name for p in (tmp_path / "out" / "rows").glob("batch=*"))
    assert len(batches) >= 2
    # A batch that runs again is written over its own folder.
    spark.read.parquet(f"{out}/rows/{batches[-1]}").repartition(3).write.mode("overwrite").parquet(f"{out}/rows/copy")
    spark.read.parquet(f"{out}/rows/copy").write.mode("overwrite").parquet(f"{out}/rows/{batches[-1]}")
    (tmp_path / "out" / "rows" / "copy").rename(tmp_path / "copy")
    assert now() == wanted
