"""Forecasters by joint quantile boosting; activity and archetype classifiers on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from panelyard.functions.capacity import forecast_invert, hurdle_dampen
from panelyard.operators import evaluate as E
from panelyard.operators.boost import Arm, Booster, TreeParams, fit_many, predict
from panelyard.session import side_by_side, staged

CATEGORIES = ("province", "region", "district")

# Inputs of the activity classifier; those present in a matrix are used.
ACTIVITY_FEATURES = (
    "ent_zero", "ent_r7_zero", "ent_r28_zero", "ent_r91_zero", "ent_zero_trend", "capacity", "month", "dow", "doy",
    "is_weekend", "is_eve", "is_holiday", "is_summer_exclusive", "is_delayed_start", "cum_water_deficit",
    "sunday_to_weekday_ratio", "level_shift_ratio", "regime_persistence_days", "cdd22", "hdd18",
    "temperature_2m_mean", "seen", "horizon",
)
QUANTILE = 0.55
PROBABILITY_CLIP = (0.001, 0.999)
OTHER_ARCHETYPE = 6
#: Rows from which on a pass of the activity classifier takes more tasks than there are cores.
ROWS = 1 << 20


def numeric_features(df: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    """Numeric inputs, in schema order; ``wanted`` narrows them to those present."""
    usable = {n for n, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")}
    return [c for c in (df.columns if wanted is None else wanted) if c in usable]


def ready(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Doubles with infinities dropped to NULL, and a 0/1 column per feature that says where it is missing."""
    finite = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in features}
    return df.withColumns(finite).withColumns({f"{c}__m": F.col(c).isNull().cast("double") for c in features})


def inputs(features: Sequence[str], missing: Sequence[str] = ()) -> list:
    """Imputed features and flags of the ``missing`` ones."""
    filled = [f"{c}__f" for c in features]
    columns = filled + [f"{c}__m" for c in missing]
    return [Imputer(strategy="mean", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")]


def sometimes_missing(train: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with both present and missing values in training: where they are missing is a signal of its own."""
    row = train.agg(*[F.sum(f"{c}__m").alias(c) for c in features]).first()
    return [c for c in features if row[c]]


def usable_features(train: DataFrame, features: Sequence[str]) -> list[str]:
    """Columns with at least one value: an all-NULL column cannot be imputed."""
    counts = train.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if counts[c]]


def dealt(rows: DataFrame) -> DataFrame:
    """The rows in no more tasks than cores, or one per ``ROWS`` rows: in every pass each task sends histograms of all open nodes."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS)))


Forecaster = Booster


def fit_forecaster(
    train: DataFrame, features: Sequence[str], seed: int = 42, params: TreeParams = TreeParams(),
    quantile: float = QUANTILE, categories: Sequence[str] = (),
) -> Forecaster:
    """Trees boosted on the pinball loss of ``log_value``."""
    return fit_many(train, [Arm("model", tuple(features), params, seed, quantile)], categories=categories)["model"]


@dataclass(frozen=True)
class ActivityClassifier:
    model: PipelineModel
    features: tuple[str, ...]

    def predict(self, rows: DataFrame, name: str = "p_active") -> DataFrame:
        out = self.model.transform(ready(rows, self.features))
        low, high = PROBABILITY_CLIP
        p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(low)), F.lit(high))
        return out.withColumn(name, p).select(*rows.columns, name)


def fit_activity(train: DataFrame, seed: int = 42, params: TreeParams = TreeParams()) -> ActivityClassifier:
    """Probability that a reading is positive."""
    features = numeric_features(train, ACTIVITY_FEATURES)
    labelled = ready(train.select(*features, (F.col("value") > 0).cast("double").alias("label")), features)
    held = dealt(labelled).persist(StorageLevel.MEMORY_AND_DISK)
    names = usable_features(held, features)
    tree = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=params.trees, maxDepth=params.depth, stepSize=params.step,
        subsamplingRate=params.subsample, seed=seed, maxBins=params.bins,
    )
    model = Pipeline(stages=[*inputs(names, sometimes_missing(held, names)), tree]).fit(held)
    held.unpersist()
    return ActivityClassifier(model, tuple(names))


def fit_archetype(train: DataFrame, features: Sequence[str], label: str = "archetype_code", seed: int = 42, params: TreeParams = TreeParams()) -> PipelineModel:
    """Six-class behaviour probabilities; codes 1..6 become labels 0..5, and a missing code is class 6."""
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=params.trees, maxDepth=params.depth,
        subsamplingRate=params.subsample, seed=seed, maxBins=params.bins,
    )
    rows = ready(train, features).withColumn("label", F.coalesce(label, F.lit(OTHER_ARCHETYPE)) - 1.0)
    return Pipeline(stages=[*inputs(features, sometimes_missing(rows, features)), forest]).fit(rows)


def predict_archetype(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Probabilities as columns archetype_p1..archetype_p6; classes the training never saw get zero."""
    out = model.transform(ready(rows, features)).withColumn("_p", vector_to_array("probability"))
    columns = {f"archetype_p{i + 1}": F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)) for i in range(6)}
    return out.withColumns(columns).select(*rows.columns, *columns)


def ensemble(
    train: DataFrame, rows: DataFrame, features: Sequence[str], seeds: Mapping[str, Sequence[int]],
    variants: Mapping[str, TreeParams], keys: Sequence[str], categories: Sequence[str] = (),
) -> DataFrame:
    """Long predictions (keys, model, seed, pred) of every variant and seed, all fitted together; both are short lists."""
    members = [(name, seed) for name in variants for seed in seeds[name]]
    arms = [Arm(f"_m{k}", tuple(features), variants[name], seed) for k, (name, seed) in enumerate(members)]
    scored = predict(rows, fit_many(train, arms, categories=categories), kept=keys)
    each = [F.struct(F.lit(name).alias("model"), F.lit(seed).alias("seed"), F.col(f"_m{k}").alias("pred")) for k, (name, seed) in enumerate(members)]
    return scored.select(*keys, F.explode(F.array(*each)).alias("_p")).select(*keys, "_p.*")


def hurdle_forecast(
    train: DataFrame, rows: DataFrame, features: Sequence[str], params: TreeParams = TreeParams(), seed: int = 42, categories: Sequence[str] = (),
    kept: Sequence[str] | None = None,
) -> DataFrame:
    """Regression and activity models combined: pred_raw, p_active and pred. ``kept``: columns of the rows that are returned, seen among them."""
    kept = rows.columns if kept is None else list(kept)
    model, classifier = side_by_side([
        lambda: fit_forecaster(train, features, seed, params, categories=categories), lambda: fit_activity(train, seed, params),
    ])
    scored = predict(classifier.predict(rows), {"pred_raw": model}, kept=[*kept, "p_active"]).select(*kept, "pred_raw", "p_active")
    damped = hurdle_dampen(F.col("pred_raw"), F.col("p_active"), F.col("seen").cast("boolean"))
    return scored.withColumn("pred", damped).withColumn("forecast", forecast_invert(F.col("pred")))


def arm_scores(valid: DataFrame, models: Mapping[str, Booster]) -> DataFrame:
    """(model, rmsle, weighted_rmsle) of every model, from one pass over ``valid``."""
    scored = predict(valid, models, kept=["log_value", "seen"]).withColumn("y", F.col("log_value"))
    return E.metrics(scored, list(models)).select("model", "rmsle", "weighted_rmsle")


def rank_features(
    train: DataFrame, valid: DataFrame, features: Sequence[str], drops: Sequence[int], params: TreeParams = TreeParams(), seed: int = 42,
    categories: Sequence[str] = (),
) -> DataFrame:
    """Refit without the least important features, all counts together: columns dropped, kept, rmsle. ``drops`` is a short list."""
    full = fit_forecaster(train, features, seed, params, categories=categories)
    ranked = [f for f in full.importances() if f in set(features)]
    kept = {f"_d{count}": tuple(ranked[: max(1, len(ranked) - count)]) for count in drops}
    arms = [Arm(name, names, params, seed) for name, names in kept.items()]
    scores = arm_scores(valid, fit_many(train, arms, categories=categories, encoding=full.encoding))
    sizes = F.create_map(*[x for name, names in kept.items() for x in (F.lit(name), F.lit(len(names)))])
    return scores.select(F.substring("model", 3, 9).cast("int").alias("dropped"), sizes[F.col("model")].alias("kept"), "rmsle")


def ablation(
    train: DataFrame, valid: DataFrame, features: Sequence[str], arms: Mapping[str, Sequence[str]], params: TreeParams = TreeParams(), seed: int = 42,
    categories: Sequence[str] = (),
) -> DataFrame:
    """Score the full feature set and each arm without its columns, fitted together; positive delta means the columns help."""
    kept = {"all": tuple(features)} | {arm: tuple(f for f in features if f not in set(columns)) for arm, columns in arms.items()}
    models = fit_many(train, [Arm(arm, names, params, seed) for arm, names in kept.items()], categories=categories)
    scores = staged(arm_scores(valid, {f"_a{k}": models[arm] for k, arm in enumerate(kept)}))
    named = F.create_map(*[x for k, arm in enumerate(kept) for x in (F.lit(f"_a{k}"), F.struct(F.lit(arm).alias("arm"), F.lit(len(kept[arm])).alias("features")))])
    base = scores.where(F.col("model") == "_a0").select("rmsle").scalar()
    return scores.select(named[F.col("model")].alias("_n"), "rmsle", "weighted_rmsle", (F.col("rmsle") - base).alias("delta")).select("_n.*", "rmsle", "weighted_rmsle", "delta")


def walk_forward(
    blocks: DataFrame, features: Sequence[str], first_valid: int, variants: Mapping[str, TreeParams], seed: int = 42, categories: Sequence[str] = ()
) -> DataFrame:
    """Expanding folds over numbered blocks, a stored table; the blend weights of a fold come from the block before it.

    Returns scored rows: entity_id, date, fold, horizon, seen, y, one column per variant, pred. The models of all folds
    and variants are fitted together, each on its own earlier blocks; thresholds and category means come from the
    blocks before the first one that is used for weights. The loop is over the few block numbers.
    """
    numbers = sorted(r["block"] for r in blocks.select("block").distinct().collect())
    first, second = list(variants)
    folds = [n for n in numbers if n >= first_valid]
    arms = [
        Arm(f"_{until}_{name}", tuple(features), params, seed, rows=F.col("block") < until)
        for until in sorted({n - back for n in folds for back in (0, 1)}) for name, params in variants.items()
    ]
    if not arms:
        raise ValueError("no block to validate on")
    used = [c for c in blocks.columns if c not in variants]
    rows = blocks.where(F.col("block") >= folds[0] - 1).withColumn("y", F.col("log_value"))
    keys = ["entity_id", "date", "block", "horizon", "seen", "y"]
    scored = staged(predict(rows, fit_many(blocks.select(*used), arms, categories=categories), kept=keys))
    result = None
    for number in folds:
        pair = E.blend_weights(scored.where(F.col("block") == number - 1), f"_{number - 1}_{first}", f"_{number - 1}_{second}").first()
        fold = scored.where(F.col("block") == number).withColumns({f"pred_{name}": F.col(f"_{number}_{name}") for name in variants})
        blend = pair["w_first"] * F.col(f"pred_{first}") + pair["w_second"] * F.col(f"pred_{second}")
        fold = fold.withColumn("pred", blend).withColumn("fold", F.lit(str(number)))
        fold = fold.select("entity_id", "date", "fold", "horizon", "seen", "y", f"pred_{first}", f"pred_{second}", "pred")
        result = fold if result is None else result.unionByName(fold)
    return result
