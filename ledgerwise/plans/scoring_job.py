"""Churn scoring as a job (survey J14, C7): one snapshot scored, predictions and audit row written.

Predictions are kept by snapshot date: scoring a snapshot again overwrites that date's partition and
no other. The audit row of the quality log is made from the rows as written, in the same run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import churn, quality, staging

PREDICTIONS = "prediction_customer_churn"
# Name and table of the audit row.
AUDIT_CHECK = "batch_churn_prediction_audit"


def model_score(model) -> Callable[[DataFrame], DataFrame]:
    """The scorer of a fitted pipeline, for ``run_scoring``."""
    return lambda feat: churn.churn_probability(model, feat, "p")


def prediction_audit(pred: DataFrame) -> DataFrame:
    """The predictions' check row: counts per tier and mean probability, WARN iff half or more are HIGH."""
    s = churn.batch_summary(pred)
    details = F.format_string(
        "Evaluated %d customers. High=%d, Med=%d, Low=%d, MeanProb=%s", "total_evaluated", "high_risk_count",
        "medium_risk_count", "low_risk_count", F.col("average_churn_probability").cast("string"))
    return s.select(F.lit(AUDIT_CHECK).alias("check_name"), F.lit(PREDICTIONS).alias("table_name"), "status",
                    details.alias("details"))


def run_scoring(store: staging.StateStore, score: Callable[[DataFrame], DataFrame], model_version: str = "1.0.0",
                snapshot_date: dt.date | None = None, now: dt.datetime | None = None) -> dict:
    """Score one snapshot of ``feature_customer_churn`` (the latest when not given) and write the result.

    ``score`` adds the probability ``p`` to feature rows. The snapshot's partition of the predictions
    becomes exactly the scored rows, so a second run over the same features changes nothing but
    ``created_at`` (nor that, for an equal ``now``), and a smaller snapshot leaves no stale customers.
    Raises LookupError without any feature snapshot; a snapshot without rows gives a summary of zeros
    and writes nothing. Returns the summary with the snapshot and the model version.
    """
    spark, now = store.spark, now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    feat = store.read("feature_customer_churn")
    if snapshot_date is None and feat is not None:
        snapshot_date = feat.agg(F.max("snapshot_date")).first()[0]
    if feat is None or snapshot_date is None:
        raise LookupError("there is no feature snapshot to score")
    rows = churn.scoring_rows(feat, snapshot_date)
    pred = churn.predictions_from_scores(score(rows), model_version, now)
    path = f"{store.root}/{PREDICTIONS}/rows"
    staging.write_snapshot(pred, path, "snapshot_date")
    written = store.read(PREDICTIONS)
    day = F.col("snapshot_date") == F.lit(str(snapshot_date)).cast("date")
    written = pred.limit(0) if written is None else written.where(day)
    summary = churn.batch_summary(written).first().asDict()
    if summary["total_evaluated"]:
        audit = quality.record_quality(prediction_audit(written), f"{snapshot_date}/{model_version}", now)
        log = store.read_log("data_quality_log")
        if log is not None:  # a run with the same time logs its row once
            audit = audit.join(log.select("id"), "id", "left_anti")
        store.append("data_quality_log", audit)
    return {"snapshot_date": snapshot_date, "model_version": model_version, **summary}
