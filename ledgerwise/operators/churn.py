"""Churn model (survey 2.J) with ``pyspark.ml``.

Fitting: exact medians / quartiles (ranked over all tasks) become
constants of a ``SQLTransformer``, followed by ``VectorAssembler`` and a
class-weighted ``GBTClassifier`` in one ``Pipeline`` - the fitted
``PipelineModel`` carries the whole preprocessing and saves / loads as one.

Scoring, tiers, ranks, risk drivers and metrics are column expressions and
distributed aggregates; no row-at-a-time Python.
"""

from __future__ import annotations

import datetime as dt
import functools
import itertools
import json
import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import global_position, running_totals
from ..functions.quantiles import exact_quantiles

# ---- J1 --------------------------------------------------------------------------
# Model inputs in their fixed order.
NUMERICAL_FEATURES = ["tenure_months", "monthly_fee_current", "package_speed_mbps", "late_payment_count_3m",
                      "late_payment_count_6m", "avg_payment_delay_days_3m"]
CATEGORICAL_FEATURES = ["payment_status_trend"]
BOOLEAN_FEATURES = ["downgrade_flag_6m"]
ALL_FEATURES = NUMERICAL_FEATURES + CATEGORICAL_FEATURES + BOOLEAN_FEATURES
# Ordinal codes of the trend (unknown -> -1).
TREND_CODES = {"IMPROVING": 0, "STABLE": 1, "WORSENING": 2}

# ---- J7 / J8 -----------------------------------------------------------------------
# Hyper-parameter defaults and presets.
DEFAULT_PARAMS = {"n_estimators": 100, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8,
                  "colsample_bytree": 0.8, "scale_pos_weight": None, "random_state": 42}
PRESETS = {
    "default": {"n_estimators": 100, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8,
                "colsample_bytree": 0.8, "random_state": 42},
    "fast_prototype": {"n_estimators": 30, "max_depth": 3, "learning_rate": 0.1, "subsample": 0.8,
                       "colsample_bytree": 0.8, "random_state": 42},
    "deep_tuned": {"n_estimators": 250, "max_depth": 6, "learning_rate": 0.03, "subsample": 0.75,
                   "colsample_bytree": 0.75, "random_state": 42},
    "high_recall": {"n_estimators": 120, "max_depth": 4, "learning_rate": 0.04, "subsample": 0.85,
                    "colsample_bytree": 0.85, "scale_pos_weight": 2.5, "random_state": 42},
}
TUNING_GRID = {
    "n_estimators": [50, 100, 150, 200],
    "max_depth": [3, 4, 5, 6],
    "learning_rate": [0.01, 0.03, 0.05, 0.10],
    "subsample": [0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.7, 0.8, 0.9, 1.0],
}
# Decision threshold and risk tiers.
CLASSIFICATION_THRESHOLD = 0.50
HIGH_RISK = 0.70
MEDIUM_RISK = 0.30


def resolve_params(preset: str | None = None, overrides: dict | None = None) -> dict:
    """Later layers win: the defaults, a known preset, the overrides that are set."""
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    return DEFAULT_PARAMS | PRESETS.get(preset, {}) | given


# ---- J2-J5 -------------------------------------------------------------------------
def fit_preprocessor(train: DataFrame) -> dict:
    """Exact medians for imputation, then quartiles of the imputed columns for scaling.

    Both come from ``exact_quantiles``: values are counted and ranked over all tasks, no task holds a
    column. Only the resulting constants reach the driver.
    """
    found = {r["column"]: r["quantiles"] for r in exact_quantiles(train, NUMERICAL_FEATURES, [0.5]).collect()}
    med = {c: float(found[c][0]) if found[c] else 0.0 for c in NUMERICAL_FEATURES}
    imputed = {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in NUMERICAL_FEATURES}
    quartiles = {r["column"]: r["quantiles"] for r in exact_quantiles(train, imputed, [0.25, 0.5, 0.75]).collect()}
    scale = {}
    for c in NUMERICAL_FEATURES:
        q25, q50, q75 = quartiles[c] or (0.0, 0.0, 0.0)
        iqr = q75 - q25
        scale[c] = {"median": med[c], "center": float(q50), "iqr": float(iqr) if iqr != 0 else 1.0}
    return scale


def preprocess_sql(scale: dict) -> str:
    """J2-J5 as one SQL statement (for ``SQLTransformer``)."""
    parts = []
    for c in NUMERICAL_FEATURES:
        s = scale[c]
        parts.append(f"(COALESCE(CAST({c} AS DOUBLE), {s['median']!r}) - {s['center']!r}) / {s['iqr']!r} AS f_{c}")
    trend = "COALESCE(payment_status_trend, 'STABLE')"
    cases = " ".join(f"WHEN {trend} = '{k}' THEN {v}.0" for k, v in TREND_CODES.items())
    parts.append(f"CASE {cases} ELSE -1.0 END AS f_payment_status_trend")
    parts.append("CAST(COALESCE(CAST(downgrade_flag_6m AS INT), 0) AS DOUBLE) AS f_downgrade_flag_6m")
    return f"SELECT *, {', '.join(parts)} FROM __THIS__"


# ---- J6 ---------------------------------------------------------------------------
def positive_weight(train: DataFrame, label: str = "label", given=None) -> float:
    """Weight of a positive row: given value, else ``max(1, negatives / positives)``; no positives -> 1."""
    if given is not None:
        return float(given)
    row = train.agg(F.sum(F.col(label)).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos = int(row["pos"] or 0)
    neg = int(row["n"]) - pos
    return max(1.0, neg / pos) if pos > 0 else 1.0


def build_pipeline(scale: dict, params: dict) -> Pipeline:
    gbt = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", lossType="logistic",
        maxIter=int(params["n_estimators"]), maxDepth=int(params["max_depth"]),
        stepSize=float(params["learning_rate"]), subsamplingRate=float(params["subsample"]),
        featureSubsetStrategy=str(float(params["colsample_bytree"])), seed=int(params["random_state"]),
    )
    return Pipeline(stages=[
        SQLTransformer(statement=preprocess_sql(scale)),
        VectorAssembler(inputCols=[f"f_{c}" for c in ALL_FEATURES], outputCol="features", handleInvalid="keep"),
        gbt,
    ])


def fit_churn(train: DataFrame, preset: str | None = None, overrides: dict | None = None,
              label: str = "label") -> PipelineModel:
    """Fit the preprocessing + boosted-trees pipeline with a positive-class weight."""
    params = resolve_params(preset, overrides)
    scale = fit_preprocessor(train)
    w = positive_weight(train, label, params.get("scale_pos_weight"))
    data = train.withColumn("label", F.col(label).cast("double")).withColumn(
        "weight", F.when(F.col("label") == 1.0, F.lit(w)).otherwise(F.lit(1.0)))
    return build_pipeline(scale, params).fit(data)


def tuning_search(train: DataFrame, evaluator, parallelism: int = 4, grid: dict | None = None,
                  preset: str | None = None) -> TrainValidationSplit:
    """The declared grid as ``ParamGridBuilder`` + ``TrainValidationSplit`` (not run by default)."""
    grid = grid or TUNING_GRID
    scale = fit_preprocessor(train)
    pipe = build_pipeline(scale, resolve_params(preset))
    gbt = pipe.getStages()[-1]
    b = ParamGridBuilder()
    names = {"n_estimators": gbt.maxIter, "max_depth": gbt.maxDepth, "learning_rate": gbt.stepSize,
             "subsample": gbt.subsamplingRate}
    for k, p in names.items():
        if k in grid:
            b = b.addGrid(p, grid[k])
    if "colsample_bytree" in grid:
        b = b.addGrid(gbt.featureSubsetStrategy, [str(float(v)) for v in grid["colsample_bytree"]])
    return TrainValidationSplit(estimator=pipe, estimatorParamMaps=b.build(), evaluator=evaluator,
                                trainRatio=0.8, parallelism=parallelism, seed=42)


def temporal_folds(df: DataFrame, folds: int = 3, date_col: str = "snapshot_date") -> list:
    """Dates that each validate once: the last ``folds`` snapshots that have an earlier one to train on.

    The number of snapshots is bounded by the calendar."""
    days = [r[0] for r in df.select(date_col).where(F.col(date_col).isNotNull()).distinct().orderBy(date_col).collect()]
    return days[1:][-folds:]


def fold_sides(df: DataFrame, day, date_col: str = "snapshot_date") -> tuple[DataFrame, DataFrame]:
    """Rows before ``day`` to train on, rows of ``day`` to validate on: no later row is ever trained on."""
    at = F.lit(str(day)).cast("date")
    return df.where(F.col(date_col) < at), df.where(F.col(date_col) == at)


def auc_by(scored: DataFrame, groups, label: str = "label", score: str = "score") -> DataFrame:
    """ROC AUC per group in one pass: counts per distinct score, one running total over all groups.

    A group without both classes has NULL."""
    groups = list(groups)
    y = F.coalesce(F.col(label).cast("int"), F.lit(0))
    counts = scored.groupBy(*groups, F.col(score).alias("s")).agg(
        F.sum(y).cast("long").alias("pos"), F.sum(1 - y).cast("long").alias("neg"))
    run = running_totals(counts, ["s"], ["neg"], keys=groups)
    below = F.col("cum_neg") - F.col("neg") / 2
    out = run.groupBy(*groups).agg(F.sum(F.col("pos") * below).alias("_u"), F.sum("pos").alias("positives"),
                                   F.sum("neg").alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return out.select(*groups, "positives", "negatives", F.when(pairs > 0, F.col("_u") / pairs).alias("auc"))


def temporal_tuning(df: DataFrame, grid: dict | None = None, folds: int = 3, preset: str | None = None,
                    date_col: str = "snapshot_date", label: str = "label") -> DataFrame:
    """J8 by time: every grid point is fitted on the rows before each fold's snapshot and scored on it.

    Returns one row per point, best first: ``point`` (its place in the grid), ``params`` (JSON),
    ``auc`` (mean over the folds that have both classes) and ``folds`` (how many). Ties keep the
    grid's order. The scored rows of all points and folds go through one metrics pass.
    """
    grid = grid or TUNING_GRID
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    parts = []
    for day in temporal_folds(df, folds, date_col):
        train, val = fold_sides(df, day, date_col)
        for i, point in enumerate(points):
            model = fit_churn(train, preset, point, label)
            scored = churn_probability(model, val.withColumnRenamed(label, "_y"), "score")
            parts.append(scored.select(F.lit(i).alias("point"), F.lit(str(day)).alias("fold"), "score", F.col("_y").alias("label")))
    if not parts:
        raise ValueError("at least two snapshots are needed to validate by time")
    scored = functools.reduce(DataFrame.unionByName, parts)
    by_point = auc_by(scored, ["point", "fold"]).groupBy("point").agg(F.avg("auc").alias("auc"), F.count("auc").alias("folds"))
    names = df.sparkSession.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(points)], "point int, params string")
    return names.join(by_point, "point").select("point", "params", "auc", "folds").orderBy(F.desc_nulls_last("auc"), "point")


# ---- J9 / J15 -----------------------------------------------------------------------
def churn_probability(model: PipelineModel, df: DataFrame, out: str = "churn_probability") -> DataFrame:
    """P(churn) from the fitted pipeline (probability vector element 1)."""
    scored = model.transform(df)
    keep = [c for c in df.columns] + [out]
    return scored.withColumn(out, vector_to_array("probability")[1]).select(*keep)


def predict_label(p: Column, threshold: float = CLASSIFICATION_THRESHOLD) -> Column:
    """``p >= threshold``."""
    return (p >= F.lit(threshold)).cast("int")


def risk_level(p: Column) -> Column:
    """HIGH >= 0.70, MEDIUM >= 0.30, else LOW (on the unrounded probability)."""
    return F.when(p >= HIGH_RISK, "HIGH").when(p >= MEDIUM_RISK, "MEDIUM").otherwise("LOW")


# ---- J10 / J11 / J12 ------------------------------------------------------------------
def _score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"),
    )


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Exact ROC AUC with ties counted half (rank-sum form), 4 dp; undefined -> 0.5.

    Rows are reduced to one row per distinct score, then the negatives below
    each score come from distributed running totals.
    """
    counts = _score_counts(df, score, label)
    cum = running_totals(counts, ["s"], ["neg"])
    part = cum.agg(
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * F.lit(0.5))).alias("num"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return part.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                              F.round(F.col("num") / (F.col("P") * F.col("N")), 4)).otherwise(F.lit(0.5))
                       .alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label",) -> DataFrame:
    """Average precision (step sum over distinct thresholds), 4 dp; undefined -> base rate."""
    counts = _score_counts(df, score, label)
    cum = running_totals(counts, ["s"], ["pos", "neg"], descending=True)
    part = cum.agg(
        F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("num"),
        F.sum("pos").alias("P"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    return part.select(
        F.when(F.col("P") > 0, F.round(F.col("num") / F.col("P"), 4))
        .when(F.col("n") > 0, F.round(F.col("P") / F.col("n"), 4)).otherwise(F.lit(0.0)).alias("pr_auc"))


def _threshold_metrics(agg: DataFrame, keep=()) -> DataFrame:
    """Precision, recall, F1, Brier and the confusion counts from one row of tp/fp/fn/tn/brier."""
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return agg.select(
        F.round(prec, 4).alias("precision"),
        F.round(rec, 4).alias("recall"),
        F.round(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0), 4).alias("f1_score"),
        F.round(F.coalesce("brier", F.lit(0.0)), 4).alias("brier_score"),
        F.col("tn").cast("long").alias("tn"), F.col("fp").cast("long").alias("fp"),
        F.col("fn").cast("long").alias("fn"), F.col("tp").cast("long").alias("tp"),
        *keep,
    )


def classification_metrics(df: DataFrame, score: str = "score", label: str = "label",
                           threshold: float = CLASSIFICATION_THRESHOLD) -> DataFrame:
    """Precision, recall, F1 (zero division -> 0), Brier score, confusion counts; one aggregate."""
    y = F.col(label).cast("long")
    yhat = (F.col(score) >= F.lit(threshold)).cast("long")
    agg = df.agg(
        F.sum(F.when((y == 1) & (yhat == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((y == 0) & (yhat == 1), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((y == 1) & (yhat == 0), 1).otherwise(0)).alias("fn"),
        F.sum(F.when((y == 0) & (yhat == 0), 1).otherwise(0)).alias("tn"),
        F.avg(F.pow(F.col(score) - y, 2)).alias("brier"),
    )
    return _threshold_metrics(agg)


def binary_metrics(df: DataFrame, score: str = "score", label: str = "label",
                   threshold: float = CLASSIFICATION_THRESHOLD) -> DataFrame:
    """J10-J12 in one pass: every metric from one table of per-score counts.

    The scored rows are reduced to one row per distinct score (partial
    aggregation, so the shuffle carries at most one row per score per task),
    and one ascending running total of positives and negatives over those
    scores serves both curves: the ROC rank sum uses the negatives at or below
    a score, average precision the counts at or above it, which are
    ``total - running + own``. Threshold metrics and the Brier score are
    conditional sums over the same counts. Same results as ``roc_auc``,
    ``average_precision`` and ``classification_metrics`` on the rows.
    """
    counts = _score_counts(df, score, label)
    cum = running_totals(counts, ["s"], ["pos", "neg"])
    # Totals as scalar subqueries over the (score-sized) running table.
    p_all = cum.agg(F.sum("pos")).scalar()
    n_all = cum.agg(F.sum("neg")).scalar()
    # Positives / negatives at or above each score (descending, inclusive).
    cpos = p_all - F.col("cum_pos") + F.col("pos")
    cneg = n_all - F.col("cum_neg") + F.col("neg")
    above = F.col("s") >= F.lit(threshold)
    below = F.col("s") < F.lit(threshold)
    one = cum.agg(
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * F.lit(0.5))).alias("auc_num"),
        F.sum(F.col("pos") * cpos / (cpos + cneg)).alias("ap_num"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(below, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(below, F.col("neg")).otherwise(0)).alias("tn"),
        (F.sum(F.col("pos") * F.pow(F.col("s") - 1.0, 2) + F.col("neg") * F.pow(F.col("s"), 2))
         / F.sum(F.when(F.col("s").isNotNull(), F.col("pos") + F.col("neg")))).alias("brier"),
    )
    auc = (F.when((F.col("P") > 0) & (F.col("N") > 0), F.round(F.col("auc_num") / (F.col("P") * F.col("N")), 4))
           .otherwise(F.lit(0.5)))
    ap = (F.when(F.col("P") > 0, F.round(F.col("ap_num") / F.col("P"), 4))
          .when(F.col("P") + F.col("N") > 0, F.round(F.col("P") / (F.col("P") + F.col("N")), 4))
          .otherwise(F.lit(0.0)))
    return _threshold_metrics(one.select("*", auc.alias("roc_auc"), ap.alias("pr_auc")), ("roc_auc", "pr_auc"))


def evaluate(model: PipelineModel, val: DataFrame, label: str = "label",
             threshold: float = CLASSIFICATION_THRESHOLD) -> DataFrame:
    """J9-J12 on a held-out split: score it with the fitted pipeline, then ``binary_metrics``."""
    scored = churn_probability(model, val, "score")
    return binary_metrics(scored.select("score", F.col(label).cast("int").alias("label")), threshold=threshold)


# ---- J13 ---------------------------------------------------------------------------
def feature_importance(spark: SparkSession, model: PipelineModel, top: int | None = 10) -> DataFrame:
    """Feature importances (4 dp), largest first (from the model's metadata)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(ALL_FEATURES, [round(float(v), 4) for v in imp]), key=lambda t: -t[1])
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.limit(top) if top else df


# ---- J17 ---------------------------------------------------------------------------
# Rule weights, cut-offs and the driver texts (Indonesian, as shown to users).
DRIVER_STRUCT = ("feature string, impact string, severity string, importance_weight double, value string, "
                 "description string")


def _driver(feature, impact, severity, weight, value: Column, description: Column) -> Column:
    return F.struct(F.lit(feature).alias("feature"), F.lit(impact).alias("impact"), F.lit(severity).alias("severity"),
                    F.lit(float(weight)).alias("importance_weight"), value.cast("string").alias("value"),
                    description.alias("description"))


def _num_text(c: Column) -> Column:
    """Plain text of a double, never with an exponent (``18.5``, ``20.0``, ``12500000.0``)."""
    text = F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def risk_drivers(df: DataFrame, out: str = "top_risk_factors") -> DataFrame:
    """Up to three rule-based drivers per row, by absolute weight (stable order on ties).

    Five rule groups, at most one driver each; built with ``when`` structs,
    ``filter`` (drop empty groups), ``array_sort`` with a comparator and ``slice``.
    """
    late3 = F.coalesce(F.col("late_payment_count_3m"), F.lit(0))
    delay = F.coalesce(F.col("avg_payment_delay_days_3m").cast("double"), F.lit(0.0))
    trend = F.coalesce(F.nullif(F.col("payment_status_trend"), F.lit("")), F.lit("STABLE"))
    tenure = F.coalesce(F.col("tenure_months").cast("double"), F.lit(0.0))
    fee = F.coalesce(F.col("monthly_fee_current").cast("double"), F.lit(0.0))
    d1 = round_1 = F.round(delay, 1)
    t1 = F.round(tenure, 1)
    g1 = (F.when(late3 >= 2, _driver("late_payment_count_3m", "INCREASES_RISK", "HIGH", 0.35, late3,
                                     F.concat(late3.cast("string"), F.lit(" kali tagihan terlambat dalam 3 bulan terakhir"))))
          .when(late3 == 1, _driver("late_payment_count_3m", "INCREASES_RISK", "MEDIUM", 0.18, late3,
                                    F.lit("1 kali keterlambatan pembayaran dalam kuartal terakhir"))))
    g2 = (F.when(trend == "WORSENING", _driver("payment_status_trend", "INCREASES_RISK", "HIGH", 0.28, trend,
                                               F.lit("Tren kedisiplinan pembayaran memburuk (WORSENING)")))
          .when(trend == "IMPROVING", _driver("payment_status_trend", "DECREASES_RISK", "LOW", -0.15, trend,
                                              F.lit("Pola pembayaran menunjukkan perbaikan (IMPROVING)"))))
    g3 = (F.when(delay >= 15.0, _driver("avg_payment_delay_days_3m", "INCREASES_RISK", "HIGH", 0.22, _num_text(d1),
                                        F.concat(F.lit("Rata-rata keterlambatan pembayaran mencapai "), _num_text(round_1),
                                                 F.lit(" hari"))))
          .when(delay >= 5.0, _driver("avg_payment_delay_days_3m", "INCREASES_RISK", "MEDIUM", 0.12, _num_text(d1),
                                      F.concat(F.lit("Rata-rata terlambat bayar "), _num_text(round_1),
                                               F.lit(" hari dari jatuh tempo")))))
    g4 = (F.when(tenure >= 24.0, _driver("tenure_months", "DECREASES_RISK", "LOW", -0.20, _num_text(t1),
                                         F.concat(F.lit("Pelanggan loyal jangka panjang ("),
                                                  _num_text(F.bround(tenure / 12.0, 1)), F.lit(" tahun berlangganan)"))))
          .when(tenure < 6.0, _driver("tenure_months", "INCREASES_RISK", "MEDIUM", 0.15, _num_text(t1),
                                      F.concat(F.lit("Pelanggan baru ("), _num_text(t1),
                                               F.lit(" bulan) pada fase adaptasi rentan churn")))))
    g5 = F.when(fee >= 1000000.0, _driver("monthly_fee_current", "EXPOSURE_WEIGHT", "HIGH", 0.10, _num_text(fee),
                                          F.concat(F.lit("Paket bernilai strategis tinggi (Rp "),
                                                   F.format_number(fee, 0), F.lit("/bulan)"))))
    arr = F.filter(F.array(g1, g2, g3, g4, g5), lambda x: x.isNotNull())
    ordered = F.array_sort(arr, lambda a, b: F.when(F.abs(a["importance_weight"]) > F.abs(b["importance_weight"]), -1)
                           .when(F.abs(a["importance_weight"]) < F.abs(b["importance_weight"]), 1).otherwise(0))
    return df.withColumn(out, F.slice(ordered, 1, 3))


# ---- J14 / J16 / J18 ------------------------------------------------------------------
PREDICTION_COLS = ("snapshot_date", "customer_id", "churn_probability", "risk_level", "risk_tier_rank",
                   "top_risk_factors", "model_version", "created_at")


def score_batch(model: PipelineModel, feat: DataFrame, snapshot_date=None, model_version: str = "1.0.0",
                created_at: dt.datetime | None = None) -> DataFrame:
    """Score one snapshot (latest when not given).

    Null fills as at training; probability kept at 4 dp; tier on the unrounded
    value; rank 1..n by probability (ties by customer id) from a distributed
    global position, never a single-task window.
    """
    p = churn_probability(model, scoring_rows(feat, snapshot_date), "p")
    return predictions_from_scores(p, model_version, created_at)


def scoring_rows(feat: DataFrame, snapshot_date=None) -> DataFrame:
    """The feature rows of one snapshot (the latest when not given), null fills as at training."""
    f = feat
    if snapshot_date is None:
        latest = feat.agg(F.max("snapshot_date")).scalar()
        f = f.where(F.col("snapshot_date") == latest)
    else:
        f = f.where(F.col("snapshot_date") == F.lit(str(snapshot_date)).cast("date"))
    return f.select(
        "snapshot_date", "customer_id", "tenure_months", "monthly_fee_current", "package_speed_mbps",
        F.coalesce("late_payment_count_3m", F.lit(0)).alias("late_payment_count_3m"),
        F.coalesce("late_payment_count_6m", F.lit(0)).alias("late_payment_count_6m"),
        F.coalesce("avg_payment_delay_days_3m", F.lit(0.0)).alias("avg_payment_delay_days_3m"),
        F.coalesce(F.nullif("payment_status_trend", F.lit("")), F.lit("STABLE")).alias("payment_status_trend"),
        F.coalesce("downgrade_flag_6m", F.lit(False)).alias("downgrade_flag_6m"),
    )


def predictions_from_scores(p: DataFrame, model_version: str = "1.0.0", created_at: dt.datetime | None = None,) -> DataFrame:
    """J15-J17 on any scored feature rows (column ``p``): tier, per-snapshot rank, drivers."""
    ranked = global_position(p, [F.col("snapshot_date"), F.col("p").desc(), F.col("customer_id")], "_pos")
    first = ranked.groupBy("snapshot_date").agg(F.min("_pos").alias("_first"))
    ranked = ranked.join(F.broadcast(first), "snapshot_date")  # one row per snapshot
    created = created_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    out = risk_drivers(ranked).select(
        "snapshot_date", "customer_id",
        F.round("p", 4).alias("churn_probability"),
        risk_level(F.col("p")).alias("risk_level"),
        (F.col("_pos") - F.col("_first") + 1).alias("risk_tier_rank"),
        "top_risk_factors",
        F.lit(model_version).alias("model_version"),
        F.lit(created.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz").alias("created_at"),
    )
    return out


def batch_summary(pred: DataFrame) -> DataFrame:
    """Counts per tier, mean probability (4 dp), rows, WARN iff HIGH >= 50 %."""
    agg = pred.agg(
        F.count(F.lit(1)).alias("total_evaluated"),
        F.count(F.when(F.col("risk_level") == "HIGH", 1)).alias("high_risk_count"),
        F.count(F.when(F.col("risk_level") == "MEDIUM", 1)).alias("medium_risk_count"),
        F.count(F.when(F.col("risk_level") == "LOW", 1)).alias("low_risk_count"),
        F.coalesce(F.round(F.avg("churn_probability"), 4), F.lit(0.0)).alias("average_churn_probability"),
    )
    return agg.withColumn("rows_saved", F.col("total_evaluated")).withColumn(
        "status", F.when((F.col("total_evaluated") > 0) & (F.col("high_risk_count") * 2 >= F.col("total_evaluated")),
                         F.lit("WARN")).otherwise(F.lit("PASS")))


# ---- J19 / J20 -----------------------------------------------------------------------
def _latest(pred: DataFrame, snapshot_date=None) -> DataFrame:
    if snapshot_date is None:
        return pred.where(F.col("snapshot_date") == pred.agg(F.max("snapshot_date")).scalar())
    return pred.where(F.col("snapshot_date") == F.lit(str(snapshot_date)).cast("date"))


def high_risk_customers(pred: DataFrame, dimc: DataFrame, limit: int | None = 25, min_p: float = HIGH_RISK,
                        snapshot_date=None) -> DataFrame:
    """Customers at or above ``min_p``, highest first, with current customer attributes or defaults."""
    p = _latest(pred, snapshot_date).where(F.col("churn_probability") >= min_p)
    c = dimc.where(F.col("is_current")).select("customer_id", "customer_name", "city", "status")
    out = p.join(c, "customer_id", "left").select(
        "customer_id",
        F.coalesce("customer_name", F.concat(F.lit("Customer #"), F.col("customer_id").cast("string")))
        .alias("customer_name"),
        F.coalesce("city", F.lit("Unknown")).alias("city"),
        F.coalesce("status", F.lit("ACTIVE")).alias("status"),
        "churn_probability", "risk_level", "risk_tier_rank",
        F.coalesce("top_risk_factors", F.array().cast(f"array<struct<{DRIVER_STRUCT}>>")).alias("top_risk_factors"),
        "snapshot_date",
    ).orderBy(F.desc("churn_probability"), "customer_id")
    return out.limit(limit) if limit else out


def customer_prediction(pred: DataFrame, dimc: DataFrame, customer_id) -> DataFrame:
    """Newest prediction of one customer."""
    p = pred.where(F.col("customer_id") == customer_id).orderBy(F.desc("snapshot_date")).limit(1)
    c = dimc.where(F.col("is_current")).select("customer_id", "customer_name", "city")
    return p.join(c, "customer_id", "left")


def churn_risk_table(pred: DataFrame, limit: int = 10) -> DataFrame:
    """I8: top at-risk customers for display: probability as %, tier, first driver or a fallback text."""
    first = F.try_element_at(F.col("top_risk_factors"), F.lit(1))
    out = _latest(pred).select(
        F.format_string("CUST-%04d", F.col("customer_id")).alias("customer_id"),
        F.concat(F.format_number(F.col("churn_probability") * 100, 1), F.lit("%")).alias("churn_probability"),
        "risk_level",
        F.coalesce(first["description"], F.lit("Tidak ada faktor risiko dominan")).alias("main_driver"),
        F.col("churn_probability").alias("_p"), F.col("customer_id").alias("_id"),
    ).orderBy(F.desc("_p"), "_id")
    return out.limit(limit).drop("_p", "_id")


# ---- J21 -----------------------------------------------------------------------------
class ModelRegistry:
    """Versioned models under a shared folder: ``<root>/<version>/model`` + ``meta.json``, active pointer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def save(self, model: PipelineModel, version: str, metrics: dict, activate: bool = True) -> None:
        model.write().overwrite().save(f"{self.root}/{version}/model")
        meta = {"version": version, "metrics": metrics,
                "trained_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat()}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{self.root}/{version}/meta")
        if activate:
            self.activate(version)

    def activate(self, version: str) -> None:
        """Append an activation record; the newest record wins (the pointer folder is never rewritten)."""
        at = time.time_ns()
        self.spark.createDataFrame([(version, at)], "version string, at long").coalesce(1).write.mode(
            "append").json(f"{self.root}/_active")

    def active_version(self) -> str | None:
        try:
            row = self.spark.read.schema("version string, at long").json(f"{self.root}/_active").agg(
                F.max_by("version", "at")).first()
        except Exception:  # noqa: BLE001 - no pointer yet
            return None
        return row[0] if row else None

    def load(self, version: str | None = None) -> PipelineModel:
        v = version or self.active_version()
        if v is None:
            raise LookupError("no active model")
        return PipelineModel.load(f"{self.root}/{v}/model")

    def list(self) -> DataFrame:
        metas = self.spark.read.text(f"{self.root}/*/meta")
        active = self.active_version()
        parsed = metas.select(F.get_json_object("value", "$.version").alias("version"),
                              F.get_json_object("value", "$.trained_at").alias("trained_at"),
                              F.get_json_object("value", "$.metrics").alias("metrics"))
        return parsed.withColumn("is_active", F.col("version") == F.lit(active)).orderBy(F.desc("trained_at"))
