"""A10: the incremental sync stream resumes from its checkpoint and never duplicates rows."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from ledgerwise.sources import bridge
from ledgerwise.streaming import sync_stream as st

SF_DIR = "/root/testdata/sf0.001"


def _stage(batch):
    inv = bridge.invoices(batch)
    return inv.select(F.col("id").alias("source_id"), "payment_status", "total_amount")


def test_stream_resumes_and_stays_unique(spark):
    if not os.path.isdir(SF_DIR):
        return
    root = tempfile.mkdtemp(prefix="lw-stream-", dir="/tmp")
    src, out, ckpt = f"{root}/src", f"{root}/out", f"{root}/_ckpt"
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    first = orders.where(F.col("o_orderkey") % 2 == 0)
    second = orders.where(F.col("o_orderkey") % 2 == 1)
    first.write.mode("overwrite").parquet(f"{src}/part=1")
    q = st.sync_stream(spark, src, out, ckpt, _stage, glob_filter="*.parquet")
    q.awaitTermination()
    n1 = st.read_synced(spark, out).count()
    assert n1 == first.count()
    # a restart with nothing new runs no epoch and rewrites no file
    files, epochs = files_of(out), len(os.listdir(f"{ckpt}/commits"))
    st.sync_stream(spark, src, out, ckpt, _stage, glob_filter="*.parquet").awaitTermination()
    assert files_of(out) == files and len(os.listdir(f"{ckpt}/commits")) == epochs
    # new files: only they are processed, and the synced view has every order exactly once
    second.write.mode("overwrite").parquet(f"{src}/part=2")
    st.sync_stream(spark, src, out, ckpt, _stage, glob_filter="*.parquet").awaitTermination()
    synced = st.read_synced(spark, out)
    assert synced.count() == orders.count()
    assert synced.select("source_id").distinct().count() == orders.count()


def test_backlog_drains_in_bounded_epochs(spark):
    if not os.path.isdir(SF_DIR):
        return
    root = tempfile.mkdtemp(prefix="lw-stream-", dir="/tmp")
    src, out, ckpt = f"{root}/src", f"{root}/out", f"{root}/_ckpt"
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").repartition(3)
    orders.write.mode("overwrite").parquet(src)  # three files
    n_files = len([p for p in os.listdir(src) if p.endswith(".parquet")])
    st.sync_stream(spark, src, out, ckpt, _stage, max_files_per_trigger=1, glob_filter="*.parquet").awaitTermination()
    epochs = [p for p in os.listdir(f"{ckpt}/commits") if not p.startswith(".")]
    assert len(epochs) == n_files > 1
    assert st.read_synced(spark, out).count() == orders.count()
    assert {r.batch_id for r in st.read_synced(spark, out).select("batch_id").distinct().collect()} == {
        f"epoch-{i:012d}" for i in range(n_files)}


def files_of(root):
    return sorted((os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(root)
                  for f in fs if f.endswith(".parquet"))


ROW = "source_id long, status string, changed timestamp_ntz"


def rows_of(df):
    return sorted((r.source_id, r.status) for r in df.collect())


def test_ties_late_rows_and_replays(spark):
    out = tempfile.mkdtemp(prefix="lw-stream-", dir="/tmp") + "/out"
    at = [dt.datetime(2026, 1, 1, h) for h in range(4)]
    merge = lambda epoch, rows: st.merge_epoch(spark.createDataFrame(rows, ROW), epoch, out, order=("changed",))
    # one epoch with several versions of a key: the change time decides, whatever the order of rows
    first = [(1, "old", at[0]), (1, "new", at[2]), (1, "mid", at[1]), (2, "a", at[1]), (3, "x", None)]
    merge(0, first)
    assert rows_of(st.read_synced(spark, out, order=("changed",))) == [(1, "new"), (2, "a"), (3, "x")]
    # a late row of an older change is ignored, an equal change time of a later epoch wins
    merge(1, [(1, "late", at[1]), (2, "b", at[1]), (4, "p", at[0]), (4, "q", at[0])])
    state = rows_of(st.read_synced(spark, out, order=("changed",)))
    assert state == [(1, "new"), (2, "b"), (3, "x"), (4, "q")]
    for epoch, rows in ((1, [(1, "late", at[1]), (2, "b", at[1]), (4, "q", at[0]), (4, "p", at[0])]), (0, first)):
        merge(epoch, rows)  # replayed epochs change nothing
        assert rows_of(st.read_synced(spark, out, order=("changed",))) == state


def test_an_epoch_rewrites_only_its_partitions(spark):
    out = tempfile.mkdtemp(prefix="lw-stream-", dir="/tmp") + "/out"
    month = F.date_format("changed", "yyyy-MM")
    old = [(i, "v", dt.datetime(2025, 1 + i % 12, 1)) for i in range(240)]
    st.merge_epoch(spark.createDataFrame(old, ROW), 0, out, order=("changed",), partition=month)
    before = dict(files_of(out))
    touched = st.merge_epoch(spark.createDataFrame([(500, "w", dt.datetime(2025, 3, 9)), (7, "u", dt.datetime(2026, 2, 1))], ROW),
                             1, out, order=("changed",), partition=month)
    assert sorted(touched) == ["2025-03", "2026-02"]
    changed = {p for p, t in files_of(out) if before.get(p) != t}
    assert changed and all("2025-03" in p or "2026-02" in p for p in changed)
    # key 7 has moved to another month: one row, the newest
    got = dict(rows_of(st.read_synced(spark, out, order=("changed",))))
    assert len(got) == 241 and got[7] == "u" and got[500] == "w"
