"""Streaming results equal the batch result on closed windows."""

from pyspark.sql import functions as F

from callweave.plans import catalog as C
from callweave.plans import standins as S
from callweave.streaming import metrics as ST
from tests.conftest import SF001


def test_windows_match_batch(spark):
    streamed = spark.read.parquet(ST.run_append(ST.windowed_metrics(C.history_stream(spark, SF001)), "t1test"))
    h = S.history(spark, SF001)
    wm = h.agg(F.max("timestamp")).first()[0]
    batch = (h.groupBy(F.window("timestamp", "1 day")).agg(F.count(F.lit(1)).alias("analyses"))
             .where(F.col("window.end") <= F.lit(wm) - F.expr("INTERVAL 1 HOUR"))
             .select(F.col("window.start").alias("window_start"), "analyses"))
    got = sorted((r.window_start, r.analyses) for r in streamed.collect())
    want = sorted((r.window_start, r.analyses) for r in batch.collect())
    assert got == want and len(got) > 0


def test_ingest_usage_matches_batch(spark, tmp_path):
    root = str(tmp_path)
    ST.history_ingest(C.history_stream(spark, SF001), root + "/t", root + "/r", root + "/u")
    usage = {r.services: r.analyses for r in spark.read.parquet(root + "/u").collect()}
    from callweave.operators import history as H
    batch = {r.services: r.analyses for r in H.service_usage(S.history(spark, SF001)).collect()}
    assert usage == batch
    assert spark.read.parquet(root + "/t").count() == S.history(spark, SF001).count()


def test_late_rows_dropped(spark, tmp_path):
    """A row older than the watermark, arriving in a later micro-batch, is dropped."""
    import datetime as dt
    schema = spark.read.parquet(f"{SF001}/events.parquet").schema
    base = dt.datetime(2024, 1, 1)
    rows1 = [(i, base + dt.timedelta(hours=6 * i), 1, "click", 1.0, "{}") for i in range(20)]   # to day 5
    rows2 = [(101, base + dt.timedelta(days=8), 1, "click", 1.0, "{}")]
    rows3 = [(100, base + dt.timedelta(hours=2), 1, "click", 1.0, "{}"),                       # late: day 1
             (102, base + dt.timedelta(days=9), 1, "click", 1.0, "{}")]
    d = tmp_path / "ev"
    # late rows are filtered with the previous batch's watermark, so the late row
    # comes in the third micro-batch
    for name, rows in (("a", rows1), ("b", rows2), ("c", rows3)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(d / name))
    files = sorted(str(p) for p in d.rglob("*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    import shutil
    import os
    import time
    for i, f in enumerate(files):
        shutil.copy(f, flat / f"events_{i}.parquet")
        os.utime(flat / f"events_{i}.parquet", (time.time() + 10 * i, time.time() + 10 * i))
    stream = S.history_from_events(ST.file_stream(spark, str(flat), "events_*.parquet", schema,
                                                  max_files_per_trigger=1))
    out = spark.read.parquet(ST.run_append(ST.windowed_metrics(stream), "late"))
    day1 = [r.analyses for r in out.collect() if r.window_start == dt.datetime(2024, 1, 1)]
    assert day1 == [4]  # the four on-time rows of day 1; the late one is not counted
