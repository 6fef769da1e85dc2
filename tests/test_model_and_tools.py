"""Model metrics against brute force, model invariants, guard, reply parsing, ordering helpers."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerwise.functions.ordering import global_position
from ledgerwise.operators import churn, features
from ledgerwise.plans import findings


def _brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _brute_ap(scores, labels):
    P = sum(labels)
    ap = 0.0
    for s in sorted(set(scores), reverse=True):
        tp = sum(1 for x, y in zip(scores, labels) if x >= s and y == 1)
        fp = sum(1 for x, y in zip(scores, labels) if x >= s and y == 0)
        pos_here = sum(1 for x, y in zip(scores, labels) if x == s and y == 1)
        ap += pos_here / P * tp / (tp + fp)
    return ap


def test_metrics_match_brute_force(spark):
    rnd = random.Random(7)
    scores = [round(rnd.random(), 1) for _ in range(300)]  # many ties
    labels = [1 if rnd.random() < s else 0 for s in scores]
    df = spark.createDataFrame(list(zip(scores, labels)), "score double, label int").repartition(5)
    assert churn.roc_auc(df).first()[0] == round(_brute_auc(scores, labels), 4)
    assert churn.average_precision(df).first()[0] == round(_brute_ap(scores, labels), 4)
    m = churn.classification_metrics(df).first()
    tp = sum(1 for s, y in zip(scores, labels) if s >= 0.5 and y == 1)
    fp = sum(1 for s, y in zip(scores, labels) if s >= 0.5 and y == 0)
    assert (m["tp"], m["fp"]) == (tp, fp)


def test_one_pass_metrics_equal_separate_metrics(spark):
    rnd = random.Random(11)
    scores = [round(rnd.random(), 2) for _ in range(400)]
    labels = [1 if rnd.random() < s else 0 for s in scores]
    df = spark.createDataFrame(list(zip(scores, labels)), "score double, label int").repartition(4)
    one = churn.binary_metrics(df).first().asDict()
    assert one["roc_auc"] == round(_brute_auc(scores, labels), 4)
    assert one["pr_auc"] == round(_brute_ap(scores, labels), 4)
    sep = churn.classification_metrics(df).first().asDict()
    assert {k: one[k] for k in sep} == sep
    n = len(scores)
    assert one["brier_score"] == round(sum((s - y) ** 2 for s, y in zip(scores, labels)) / n, 4)
    # degenerate inputs keep the documented fallbacks
    neg_only = spark.createDataFrame([(0.3, 0), (0.6, 0)], "score double, label int")
    r = churn.binary_metrics(neg_only).first()
    assert (r["roc_auc"], r["pr_auc"], r["fp"], r["tn"]) == (0.5, 0.0, 1, 1)


def test_undefined_auc_is_half(spark):
    df = spark.createDataFrame([(0.3, 0), (0.6, 0)], "score double, label int")
    assert churn.roc_auc(df).first()[0] == 0.5


def test_presets_and_tiers(spark):
    assert churn.resolve_params("fast_prototype")["n_estimators"] == 30
    assert churn.resolve_params("nope")["n_estimators"] == 100
    assert churn.resolve_params("high_recall", {"max_depth": None, "n_estimators": 7})["n_estimators"] == 7
    df = spark.createDataFrame([(0.7,), (0.69,), (0.3,), (0.29,)], "p double")
    assert [r[0] for r in df.select(churn.risk_level(F.col("p"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_fit_and_score(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(200):
        late = rnd.randint(0, 3)
        rows.append(("2026-09-01", 1000 + i, float(rnd.randint(1, 40)), float(rnd.choice([275000, 550000])),
                     rnd.choice([30, 50, None]), late, late + rnd.randint(0, 3), float(late * 7),
                     "WORSENING" if late > 1 else "STABLE", False, 1 if late >= 2 else 0))
    df = spark.createDataFrame(rows, "snapshot_date string, customer_id long, tenure_months double, "
                                     "monthly_fee_current double, package_speed_mbps int, late_payment_count_3m int, "
                                     "late_payment_count_6m int, avg_payment_delay_days_3m double, "
                                     "payment_status_trend string, downgrade_flag_6m boolean, label int")
    df = df.withColumn("snapshot_date", F.to_date("snapshot_date"))
    model = churn.fit_churn(df, preset="fast_prototype", overrides={"n_estimators": 5})
    pred = churn.score_batch(model, df.drop("label")).collect()
    assert all(0.0 <= r["churn_probability"] <= 1.0 for r in pred)
    ranks = sorted(pred, key=lambda r: r["risk_tier_rank"])
    assert ranks[0]["risk_tier_rank"] == 1 and ranks[-1]["risk_tier_rank"] == len(pred)
    assert ranks[0]["churn_probability"] == max(r["churn_probability"] for r in pred)
    scored = churn.churn_probability(model, df).withColumnRenamed("churn_probability", "score")
    assert 0.5 <= churn.roc_auc(scored).first()[0] <= 1.0


def test_global_position_and_split(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(7)
    pos = {r["k"]: r["pos"] for r in global_position(df, ["k"], "pos").collect()}
    assert all(pos[k] == k for k in range(1000))
    data = spark.range(10).select(F.lit("2026-01-01").cast("date").alias("snapshot_date"),
                                  F.col("id").alias("customer_id"), (F.col("id") % 2).alias("label"))
    sp = features.temporal_split(data)
    assert sp.where("split = 'train'").count() == 8 and sp.where("split = 'val'").count() == 2
    one = features.temporal_split(data.limit(1))
    assert one.where("split = 'train'").count() == 1 and one.where("split = 'val'").count() == 1


def test_sql_guard(spark):
    spark.range(3).createOrReplaceTempView("t_guard")
    assert findings.safe_sql(spark, "SELECT * FROM t_guard").count() == 3
    page, more = findings.safe_sql_page(spark, "WITH x AS (SELECT id FROM t_guard) SELECT * FROM x", 2)
    assert page.count() == 2 and more
    page, more = findings.safe_sql_page(spark, "SELECT id, (SELECT max(id) FROM t_guard) m FROM t_guard LIMIT 2;", 2)
    assert page.count() == 2 and not more
    for bad in ("DROP TABLE t_guard", "SELECT 1; DELETE FROM t_guard", "UPDATE t SET a=1",
                "SELECT 'insert' AS x", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
                "SELECT * FROM t_guard WHERE java_method('java.util.UUID', 'randomUUID') = 'x'",
                "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SHOW TABLES", "SET a=b",
                "SELECT * FROM (SELECT reflect('java.util.UUID', 'randomUUID') AS u) t", "SELECT * FROM missing_view",
                "WITH x AS (SELECT reflect('java.util.UUID', 'randomUUID') AS u) SELECT * FROM x", "CACHE TABLE t_guard",
                "SELECT id FROM t_guard WHERE id IN (SELECT 1 FROM csv.`/etc/passwd`)", ""):
        with pytest.raises(PermissionError):
            findings.safe_sql(spark, bad)


def test_parse_replies(spark):
    df = spark.createDataFrame([('```json\n{"k": 5}\n```',), ('{"k": 6}',), ("not json",)], "t string")
    out = findings.parse_replies(df, "t", "k int").select("parsed.k", "valid").collect()
    assert [(r[0], r[1]) for r in out] == [(5, True), (6, True), (None, False)]


def test_cluster_settings_sizing():
    from ledgerwise.session import cluster_settings

    big = cluster_settings(100 * 2 ** 40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 104000  # 102,400 rounded up to whole waves
    assert int(big["spark.sql.shuffle.partitions"]) % 8000 == 0
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert not any(k.startswith("spark.ui") for k in big)
    assert cluster_settings(10 ** 6, 8)["spark.sql.shuffle.partitions"] == "8"


def test_keyed_running_totals_split_hot_key(spark):
    from ledgerwise.functions.ordering import running_totals

    rnd = random.Random(5)
    rows = []
    for i in range(2000):  # key 'hot' holds ~80% of the rows, plus a NULL key
        k = "hot" if rnd.random() < 0.8 else rnd.choice(["a", "b", None])
        rows.append((k, i, float(rnd.randint(-5, 9))))
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep the range split visible
    try:
        got = {(r["k"], r["t"]): r["cum_v"] for r in running_totals(df, ["t"], ["v"], keys=["k"]).collect()}
        parts = df.orderBy("k", "t").withColumn("p", F.spark_partition_id()).where(F.col("k") == "hot")
        n_parts = parts.select("p").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, acc = {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        acc[k] = acc.get(k, 0.0) + v
        want[(k, t)] = acc[k]
    assert got == want
    assert n_parts > 1  # the hot key really spans several range partitions
