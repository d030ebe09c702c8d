"""MLlib fits behind the model-based metrics: bias score, importance, comparison, mitigation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import constants as K
from plumbline.operators import encode, fairness, grouped, sampling
from plumbline.session import materialise

BLOCK_ROWS = 50_000
# Rows that a task of a fit reads in each scan.
SPREAD_ROWS = 500_000


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns as one vector; NaN, infinities and nulls become zero first."""
    cleaned = df.withColumns({c: encode.finite(F.col(c)) for c in features})
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(cleaned)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where they sit in fewer partitions or in ones of more than
    ``SPREAD_ROWS``; for inputs that a fit will scan many times. Others pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.count(F.lit(1)).alias("filled"), F.max("n").alias("most"), F.sum("n").alias("n")).first()
    if found["filled"] >= cores and found["most"] <= 2 * SPREAD_ROWS:
        return df
    return df.repartition(max(cores, math.ceil((found["n"] or 0) / SPREAD_ROWS)))


def fit_linear(df: DataFrame, label: str, features: str = "features") -> LogisticRegressionModel:
    """Logistic regression with a unit L2 penalty, on the scale the penalty is stated in."""
    n = df.count()
    return LogisticRegression(
        featuresCol=features, labelCol=label, maxIter=200,
        regParam=1.0 / max(n, 1), standardization=False,
    ).fit(df)


def one_class(df: DataFrame, label: str) -> bool:
    lo_hi = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    return lo_hi["lo"] == lo_hi["hi"]


def bias_score(
    df: DataFrame, features: Sequence[str], label: str, protected: str, row_id: Sequence[str]
) -> dict:
    """Mean of parity gap and opportunity gap of a linear classifier's own predictions.

    Groups are the sorted codes 0 and 1 of the protected column. A single-class label has
    no gaps. Importance comes from :func:`permutation_importance`.
    """
    ready = spread(assemble(encode.label_encode(df, protected, "_group"), features)).persist()
    try:
        if one_class(ready, label):
            return {"bias": 0.0, "parity": 0.0, "opportunity": 0.0, "importance": dict.fromkeys(features, 0.0)}
        model = fit_linear(ready, label)
        predicted = model.transform(ready).select(label, "_group", F.col("prediction").cast("int").alias("pred"))
        gaps = fairness.prediction_gaps(predicted, label, "pred", "_group", 0, 1).first()
        importance = permutation_importance(ready, features, label, model, row_id)
        shares = {r["feature"]: r["share"] for r in importance.collect()}  # one row per feature
    finally:
        ready.unpersist()
    return {
        "bias": gaps["bias_score"], "parity": gaps["demographic_parity"],
        "opportunity": gaps["equal_opportunity"], "importance": shares,
    }


def permutation_importance(
    ready: DataFrame, features: Sequence[str], label: str, model: LogisticRegressionModel, row_id: Sequence[str],
    repeats: int = 5, seed: int = 0, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Share of accuracy lost when a feature's values are shuffled among the rows.

    Rows are dealt into blocks of bounded size by a hash of their identity, and values are
    shuffled within each block; a random block is an exchangeable sample, so the mean drop
    estimates the same quantity. All features and repeats take one pass.
    """
    coef, intercept = model.coefficients.toArray(), float(model.intercept)
    names = list(features)
    blocks = max(1, math.ceil(ready.count() / block_rows))

    def drops(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        x = np.vstack(pdf["x"].to_numpy())
        y = pdf["y"].to_numpy() > 0.5
        margin = x @ coef + intercept
        base = int(((margin > 0) == y).sum())
        lost = np.zeros(len(names))
        rng = np.random.default_rng(seed + int(pdf["block"].iloc[0]))
        for _ in range(repeats):
            order = rng.permutation(len(x))
            for j, w in enumerate(coef):
                if w != 0.0:
                    moved = margin + w * (x[order, j] - x[:, j])
                    lost[j] += base - int(((moved > 0) == y).sum())
        return pd.DataFrame({"feature": names, "lost": lost, "n": float(len(x))})

    dealt = ready.select(
        F.xxhash64(*row_id, F.lit(seed)).alias("h"),
        vector_to_array("features").alias("x"),
        F.col(label).cast("double").alias("y"),
    ).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    per_block = dealt.groupBy("block").applyInPandas(drops, "feature string, lost double, n double")
    per_feature = per_block.groupBy("feature").agg(F.abs(F.sum("lost") / repeats / F.sum("n")).alias("drop"))
    total = F.sum("drop").over(Window.partitionBy(F.lit(1)))  # over one row per feature
    share = F.when(total < 1e-6, 0.0).otherwise(F.col("drop") / total)
    return per_feature.withColumn("share", share)


def cluster(df: DataFrame, features: Sequence[str], k: int = K.CLUSTERS, seed: int = 42) -> DataFrame:
    """Add a KMeans cluster number."""
    ready = spread(assemble(df, features))
    return KMeans(k=k, seed=seed).fit(ready).transform(ready).withColumnRenamed("prediction", "cluster")


def cluster_gaps(clustered: DataFrame, pred: str, group: str, first=0, second=1) -> DataFrame:
    """Parity gap of any prediction within each cluster; clusters below two rows are left out."""
    clustered = materialise(clustered.select("cluster", pred, group), "clustered")  # read twice, clustered once
    gaps = fairness.parity_gap(clustered, pred, group, first, second, by=["cluster"])
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return gaps.join(sizes, "cluster").filter("size >= 2").select("cluster", "size", "parity_gap")


def cluster_bias(df, features: Sequence[str], label: str, protected: str, k: int = K.CLUSTERS) -> tuple[float, list]:
    """Mean of (1 - parity gap) over clusters, each judged by a classifier of its own."""
    n = df.count()
    if min(k, n) < 2:
        return K.TEXT_NEUTRAL, []
    found = cluster(df, features, min(k, n)).select("cluster", *dict.fromkeys([*features, label, protected]))
    clustered = materialise(found, "clustered")
    fitted = materialise(grouped.fit_logistic(clustered, ["cluster"], features, label), "cluster-fits")
    identity = ["cluster", *dict.fromkeys([*features, label, protected])]
    scored = grouped.predict_logistic(clustered, fitted, ["cluster"], features, identity)
    gaps = fairness.parity_gap(scored.filter("pred IS NOT NULL"), "pred", protected, 0, 1, by=["cluster"]).select("cluster", "parity_gap")
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    # at most k rows; a cluster with one label has no gap
    rows = sizes.join(gaps, "cluster", "left").orderBy("cluster").collect()
    details = [{"cluster": r["cluster"], "size": r["size"], "parity_gap": r["parity_gap"] or 0.0} for r in rows]
    overall = sum(1 - d["parity_gap"] for d in details) / len(details) if details else K.TEXT_NEUTRAL
    return overall, details


# --- training, prediction, comparison --------------------------------------------------


def accuracy(label: str, pred: str) -> Column:
    return F.avg((F.col(label) == F.col(pred)).cast("double"))


def census_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> PipelineModel:
    """Feature pipeline with one level dropped per categorical column, the first in string order.

    A null, or a level that ``df`` lacks, is zero in all slots of its column, like the dropped level.
    """
    indexed, hot, kept = ([f"{c}_{part}" for c in categorical] for part in ("index", "hot", "kept"))
    indexer = StringIndexer(inputCols=list(categorical), outputCols=indexed, stringOrderType="alphabetDesc", handleInvalid="keep").fit(df)
    # slots: the levels in descending order, then one for what is unknown
    encoder = OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False).fit(indexer.transform(df))
    slots = {k: len(levels) - 1 for k, levels in enumerate(indexer.labelsArray) if len(levels) > 1}
    slicers = [VectorSlicer(inputCol=hot[k], outputCol=kept[k], indices=list(range(n))) for k, n in slots.items()]
    assembler = VectorAssembler(inputCols=[*numeric, *[kept[k] for k in slots]], outputCol="features")
    return PipelineModel([indexer, encoder, *slicers, assembler])


def feature_names(encoded: DataFrame, features: str = "features") -> list[str]:
    """The slots of an assembled vector, in order."""
    groups = encoded.schema[features].metadata["ml_attr"]["attrs"].values()
    return [a["name"] for a in sorted((a for g in groups for a in g), key=lambda a: a["idx"])]


def train(train_rows: DataFrame, label: str, weight: str | None = None) -> PipelineModel:
    """Standardise, then fit a linear log-loss classifier, optionally on weighted rows."""
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=200, regParam=1e-4)
    if weight:
        lr = lr.setWeightCol(weight)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, lr]).fit(train_rows)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Prediction and probability of the positive class for every row."""
    scored = model.transform(df)
    return scored.withColumn("pred", F.col("prediction").cast("int")).withColumn(
        "score", vector_to_array("probability")[1]
    )


def compare_models(
    rows: DataFrame, key: str, label: str, group: str, first, second, trees: int = 120, seed: int = 42
) -> DataFrame:
    """Linear model and random forest on the same hash split, least biased first.

    ``rows`` carries a ``features`` vector.
    """
    split = sampling.hash_split(spread(rows), key, seed=seed)
    fit_rows, held = split.filter("is_train"), split.filter("NOT is_train")
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, seed=seed)
    candidates = {
        "linear": lambda: train(fit_rows, label).transform(held),
        "random_forest": lambda: forest.fit(fit_rows).transform(held),
    }
    out = None
    for name, scored in candidates.items():
        predicted = scored().withColumn("pred", F.col("prediction").cast("int"))
        row = fairness.prediction_gaps(predicted, label, "pred", group, first, second).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("bias_score", F.col("accuracy").desc())


def mitigate(
    rows: DataFrame, key: str, label: str, group: str, protected_value, other_value,
    factors: Mapping | None = None,
) -> DataFrame:
    """Metrics before and after reweighing the training rows and refitting."""
    rows = materialise(spread(rows), "rows")  # read by every scan of both fits; what they come from is computed once
    weighed = sampling.reweigh(rows, group, label, protected_value, factors)
    split = sampling.hash_split(weighed, key)
    fit_rows, held = split.filter("is_train"), split.filter("NOT is_train")
    out = None
    for stage, weight in (("before", None), ("after", "weight")):
        predicted = predict(train(fit_rows, label, weight), held)
        row = fairness.prediction_gaps(predicted, label, "pred", group, protected_value, other_value).select(F.lit(stage).alias("stage"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# --- explanations ----------------------------------------------------------------------


def contributions(impacts: Column, names: Sequence[str], above: float = 0.03, top: int = 8) -> Column:
    """Named impacts above the threshold, strongest first, with their share of the largest."""
    named = F.zip_with(
        F.lit(list(names)), impacts,
        lambda n, v: F.struct(F.abs(v).alias("size"), n.alias("feature"), v.alias("impact")),
    )
    kept = F.slice(F.sort_array(F.filter(named, lambda e: e["size"] > above), asc=False), 1, top)
    largest = F.element_at(kept, 1)["size"]
    shares = F.transform(
        kept, lambda e: F.struct(e["feature"], e["impact"], (e["size"] / largest).alias("share"))
    )
    return F.when(F.size(kept) > 0, shares).otherwise(F.slice(shares, 1, 0))


def explain_rows(model: PipelineModel, df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Linear attributions of every row: coefficient times standardised value.

    Values are centred on the full training mean, so the impacts and the base value add
    up to the row's log-odds.
    """
    linear = model.stages[-1]
    coef = [float(w) for w in linear.coefficients.toArray()]
    impacts = F.zip_with(vector_to_array("scaled"), F.lit(coef), lambda x, w: x * w)
    scored = model.transform(df).withColumn("impacts", impacts)
    return scored.select(
        *keep,
        F.lit(float(linear.intercept)).alias("base_value"),
        contributions(F.col("impacts"), names).alias("contributions"),
        F.aggregate("impacts", F.lit(float(linear.intercept)), lambda a, x: a + x).alias("log_odds"),
    )
