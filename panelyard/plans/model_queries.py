"""Forecasters and classifiers on feature blocks of the supplier panel, and streams.

Predictions are no matter of SQL. Beside each fitted query another one states facts about the same rows that SQL can check:
the rows scored, whether the trained quantile holds, whether blends, damping and deltas agree with their parts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators import evaluate as E
from panelyard.operators import features as FT
from panelyard.operators import models as M
from panelyard.operators import profiles as PR
from panelyard.operators import spc as S
from panelyard.operators.boost import predict
from panelyard.plans import tables as T
from panelyard.plans.history_queries import BLOCK_CASE, BLOCK_CUTS, enriched
from panelyard.plans.registry import register
from panelyard.session import shared_dir, staged
from panelyard.streaming import control as SC

# Two kinds of forecaster to blend: the same number and depth of trees, of which the second sees less of rows and columns.
VARIANTS = {"dense": M.TreeParams(), "sparse": M.TreeParams(subsample=0.6, columns=0.4)}
SEEDS = {"dense": (42, 7, 2024), "sparse": (42, 7)}
WEIGHTS = {"dense": 0.44, "sparse": 0.56}
DROPS = (0, 20, 40)
GROUP = ("district_mean", "cap_mean", "cell_mean", "exp_log_district", "peer_mean")


HELD: dict[tuple, DataFrame] = {}


def once(spark, d, name, build):
    """A fitted query's table, written once per application: the query and the facts about it read the same rows."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in HELD:
        HELD[key] = staged(build())
    return HELD[key]


def blocks(spark, d, numbers):
    cuts = [BLOCK_CUTS[i] for i in numbers]
    return once(spark, d, f"blocks{numbers}", lambda: FT.blocks_by_cut(enriched(spark, d), cuts).withColumn("block", F.col("block") + numbers[0]))


def split(spark, d):
    """All earlier blocks to learn from, the last one to score."""
    rows = blocks(spark, d, [0, 1, 2, 3])
    return rows.where(F.col("block") < 3), rows.where(F.col("block") == 3)


def features(rows):
    """The numeric inputs of the whole feature matrix."""
    return M.numeric_features(rows, FT.feature_list(rows))


def of_block(numbers: str) -> str:
    return f"(SELECT *, {BLOCK_CASE} AS block FROM panel) WHERE block IN ({numbers})"


def usable(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < float("inf"))


def forecaster_rows(spark, d):
    """Predictions of the last block and of the rows that taught, of one model."""

    def build():
        train, valid = split(spark, d)
        model = M.fit_forecaster(train, features(train), categories=M.CATEGORIES)
        every = train.unionByName(valid, allowMissingColumns=True)
        return predict(every, {"pred": model, "raw": model}, {"raw": None}, ["entity_id", "date", "block", "log_value"])

    return once(spark, d, "forecaster", build)


@register("fit_forecaster", "entity_id s, date d, pred 4")
def fit_forecaster(spark, d):
    return forecaster_rows(spark, d).where("block = 3")


@register("fit_forecaster_rows", "entity_id s, date d, usable i, block i", f"SELECT entity_id, date, TRUE AS usable, block FROM {of_block('0, 1, 2, 3')}")
def fit_forecaster_rows(spark, d):
    return forecaster_rows(spark, d).withColumn("usable", usable("pred"))


@register(
    "fit_forecaster_quantile",
    "n i, reached i, not_past i, better_than_one_value i",
    f"SELECT count(value) AS n, TRUE AS reached, TRUE AS not_past, TRUE AS better_than_one_value FROM {of_block('0, 1, 2')}",
)
def fit_forecaster_quantile(spark, d):
    """The boosted quantile holds on the rows that taught: rank floor(q (n - 1)) is the last at or below the prediction."""
    known = forecaster_rows(spark, d).where("block < 3 AND log_value IS NOT NULL")
    gap, q = F.col("log_value") - F.col("raw"), M.QUANTILE
    wanted = F.floor(q * (F.count("*") - 1)) + 1

    def pinball(g):
        return F.avg(F.when(g > 0, q * g).otherwise((q - 1) * g))

    one = known.agg(F.percentile("log_value", F.lit(q))).scalar()
    return known.withColumn("_one", F.col("log_value") - one).agg(
        F.count("*").alias("n"), (F.count_if(gap <= 1e-9) >= wanted).alias("reached"), (F.count_if(gap < -1e-9) <= wanted).alias("not_past"),
        (pinball(gap) < pinball(F.col("_one"))).alias("better_than_one_value"),
    )


def activity_rows(spark, d):
    def build():
        # Rows, not months: whether a reading of that day is positive.
        train, valid = split(spark, d)
        return M.fit_activity(train).predict(valid).select("entity_id", "date", "value", "p_active").withColumn("active", F.col("value") > 0)

    return once(spark, d, "activity", build)


@register("fit_activity", "entity_id s, date d, p_active 4, active i")
def fit_activity(spark, d):
    return activity_rows(spark, d)


@register(
    "fit_activity_rows", "entity_id s, date d, active i, clipped i", f"SELECT entity_id, date, value > 0 AS active, TRUE AS clipped FROM {of_block('3')}"
)
def fit_activity_rows(spark, d):
    low, high = M.PROBABILITY_CLIP
    return activity_rows(spark, d).withColumn("clipped", F.col("p_active").between(low, high))


ARCHETYPES = [f"archetype_p{i}" for i in range(1, 7)]


def archetype_rows(spark, d):
    def build():
        # Behaviour before the cutoff; four fifths of the households teach, the others are predicted.
        past, _ = T.household_split(spark, d)
        rows = staged(PR.archetype_rules(past).join(PR.agro_profile(past), "entity_id"))
        columns = ["sunday_to_weekday_ratio", "summer_to_winter_ratio", "load_volatility_cv", "summer_concentration_ratio", "agro_summer_expansion_ratio"]
        held_out = F.crc32("entity_id") % 5 == 0
        return M.predict_archetype(M.fit_archetype(rows.where(~held_out), columns), rows.where(held_out), columns).select("entity_id", *ARCHETYPES)

    return once(spark, d, "archetype", build)


@register("fit_archetype", "entity_id s, " + ", ".join(f"{c} 4" for c in ARCHETYPES))
def fit_archetype(spark, d):
    return archetype_rows(spark, d)


@register("hurdle_forecast", "entity_id s, date d, pred_raw 4, p_active 4, forecast 2")
def hurdle_forecast(spark, d):
    return hurdle_rows(spark, d)


def hurdle_rows(spark, d):
    def build():
        train, valid = split(spark, d)
        return M.hurdle_forecast(train, valid, features(train), categories=M.CATEGORIES, kept=["entity_id", "date", "seen"])

    return once(spark, d, "hurdle", build)


@register("hurdle_forecast_rows", "entity_id s, date d, damped i, inverted i", f"SELECT entity_id, date, TRUE AS damped, TRUE AS inverted FROM {of_block('3')}")
def hurdle_forecast_rows(spark, d):
    """Whether damping never raises a forecast and the forecast is the inverse of the damped value."""
    rows = hurdle_rows(spark, d)
    damped = usable("pred_raw") & usable("pred") & (F.col("pred") <= F.col("pred_raw") + 1e-9)
    return rows.withColumns({"damped": damped, "inverted": F.abs(F.log1p("forecast") - F.col("pred")) < 1e-6})


def ensemble_members(spark, d):
    def build():
        train, valid = split(spark, d)
        return M.ensemble(train, valid, features(train), SEEDS, VARIANTS, ["entity_id", "date"], M.CATEGORIES)

    return once(spark, d, "ensemble", build)


@register("multi_seed_ensemble", "entity_id s, date d, pred 4")
def multi_seed_ensemble(spark, d):
    return E.ensemble_mean(ensemble_members(spark, d), WEIGHTS, ["entity_id", "date"])


@register(
    "multi_seed_ensemble_rows",
    "entity_id s, date d, members i, inside i",
    f"SELECT entity_id, date, {sum(map(len, SEEDS.values()))} AS members, TRUE AS inside FROM {of_block('3')}",
)
def multi_seed_ensemble_rows(spark, d):
    """Members per row, and whether the weighted mean lies between the smallest and the largest of them."""
    keys = ["entity_id", "date"]
    members = ensemble_members(spark, d)
    spread = members.groupBy(*keys).agg(F.count("pred").alias("members"), F.min("pred").alias("low"), F.max("pred").alias("high"))
    both = spread.join(E.ensemble_mean(members, WEIGHTS, keys), keys)
    return both.withColumn("inside", F.col("pred").between(F.col("low") - 1e-9, F.col("high") + 1e-9))


def ranked_features(spark, d):
    def build():
        train, valid = split(spark, d)
        names = features(train)
        return M.rank_features(train, valid, names, DROPS, categories=M.CATEGORIES).withColumn("inputs", F.lit(len(names)))

    return once(spark, d, "ranked", build)


@register("rank_features", "dropped i, kept i, rmsle 4")
def rank_features(spark, d):
    return ranked_features(spark, d)


@register(
    "rank_features_steps",
    "dropped i, complete i, scored i",
    "SELECT dropped, TRUE AS complete, TRUE AS scored FROM (VALUES " + ", ".join(f"({n})" for n in DROPS) + ") AS t(dropped)",
)
def rank_features_steps(spark, d):
    # an input without any value is no feature
    return ranked_features(spark, d).withColumns({"complete": (F.col("kept") + F.col("dropped")).between(1, F.col("inputs")), "scored": F.col("rmsle") > 0})


def ablation_rows(spark, d):
    def build():
        train, valid = split(spark, d)
        names = features(train)
        weather = [n for n in names if n in T.WEATHER_MEASURES or n in ("cdd22", "hdd18", "cdd_log", "hdd18")]
        return M.ablation(train, valid, names, {"without_groups": GROUP, "without_weather": weather}, categories=M.CATEGORIES)

    return once(spark, d, "ablation", build)


@register("ablation", "arm s, features i, rmsle 4, delta 4")
def ablation(spark, d):
    return ablation_rows(spark, d)


@register(
    "ablation_arms",
    "arm s, fewer i, consistent i",
    "SELECT arm, arm <> 'all' AS fewer, TRUE AS consistent FROM (VALUES ('all'), ('without_groups'), ('without_weather')) AS t(arm)",
)
def ablation_arms(spark, d):
    """Whether an arm has fewer inputs than all, and its delta is the difference of the scores."""
    rows = ablation_rows(spark, d)
    whole = rows.where("arm = 'all'").select(F.struct("features", "rmsle")).scalar()
    rows = rows.withColumn("_all", whole)
    return rows.withColumns({"fewer": F.col("features") < F.col("_all.features"), "consistent": F.abs(F.col("delta") - F.col("rmsle") + F.col("_all.rmsle")) < 1e-12})


def walked_rows(spark, d):
    def build():
        rows = blocks(spark, d, [0, 1, 2, 3])
        return M.walk_forward(rows, features(rows), 2, VARIANTS, categories=M.CATEGORIES)

    return once(spark, d, "walked", build)


@register("walk_forward", "fold s, segment s, value 4")
def walk_forward(spark, d):
    scored = walked_rows(spark, d)
    out = None
    for fold in ("2", "3"):
        part = E.oof_segments(scored.where(F.col("fold") == fold)).withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "walk_forward_rows",
    "entity_id s, date d, fold s, y 6, blended i",
    f"SELECT entity_id, date, CAST(block AS VARCHAR) AS fold, ln(1 + value) AS y, TRUE AS blended FROM {of_block('2, 3')}",
)
def walk_forward_rows(spark, d):
    """Rows of the folds, and whether the blend lies between the two variants."""
    low, high = F.least("pred_dense", "pred_sparse"), F.greatest("pred_dense", "pred_sparse")
    return walked_rows(spark, d).withColumn("blended", usable("pred") & F.col("pred").between(low - 1e-9, high + 1e-9))


def event_baselines(spark, d):
    return staged(S.spc_fit(T.table(spark, d, "events"), ["user_id"], "value"))


def event_stream(spark, d):
    """The event table as a file stream."""
    schema = T.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


STATELESS_SQL = """
SELECT event_id, (value - m) / s AS z_score, abs(value - m) > 3 * s AS shewhart_anomaly
FROM events JOIN (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (user_id)"""


@register("stream_score_stateless", "event_id i, z_score 6, shewhart_anomaly i", STATELESS_SQL)
def stream_score_stateless(spark, d):
    scored = SC.stream_score_stateless(event_stream(spark, d), event_baselines(spark, d), "user_id", "value")
    return SC.run_to_table(scored, shared_dir(spark), fresh("stateless"))


def fresh(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"


STATEFUL_SQL = """
WITH marks AS (
  SELECT user_id, event_id, value, m, s, (value - m) / s AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
  FROM events JOIN (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (user_id)),
path AS (
  SELECT user_id, event_id, rn, m, s, value AS e, greatest(0, z - 0.5e0) AS pos, least(0, z + 0.5e0) AS neg,
         CASE WHEN greatest(0, z - 0.5e0) > 4.77 OR least(0, z + 0.5e0) < -4.77 THEN 0 ELSE greatest(0, z - 0.5e0) END AS up,
         CASE WHEN greatest(0, z - 0.5e0) > 4.77 OR least(0, z + 0.5e0) < -4.77 THEN 0 ELSE least(0, z + 0.5e0) END AS down
  FROM marks WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn, m, s, e, pos, neg, CASE WHEN pos > 4.77 OR neg < -4.77 THEN 0 ELSE pos END, CASE WHEN pos > 4.77 OR neg < -4.77 THEN 0 ELSE neg END
  FROM (SELECT c.user_id, c.event_id, c.rn, c.m, c.s, 0.2e0 * c.value + 0.8e0 * p.e AS e, greatest(0, p.up + c.z - 0.5e0) AS pos, least(0, p.down + c.z + 0.5e0) AS neg
        FROM path p JOIN marks c ON c.user_id = p.user_id AND c.rn = p.rn + 1))
SELECT event_id, e AS ewma, abs(e - m) > 2.66e0 * s * sqrt(0.2e0 / 1.8e0 * (1 - pow(0.8e0, 2 * rn))) AS ewma_anomaly, pos - neg AS cusum, pos - neg > 4.77 AS cusum_anomaly
FROM path"""


@register("stream_score_stateful", "event_id i, ewma 6, ewma_anomaly i, cusum 6, cusum_anomaly i", STATEFUL_SQL, recursive=True)
def stream_score_stateful(spark, d):
    config = S.SPCConfig(cusum_units="standard")
    scored = SC.stream_score_stateful(event_stream(spark, d), event_baselines(spark, d), "user_id", "event_id", "value", config)
    return SC.run_to_table(scored, shared_dir(spark), fresh("stateful"))


ORDERED_SQL = STATEFUL_SQL.replace("ORDER BY event_id", "ORDER BY epoch_ms(ts), event_id").replace("SELECT user_id, event_id, value, m, s,", "SELECT user_id, event_id, epoch_ms(ts) AS ms, value, m, s,") + (
    " WHERE event_id IN (SELECT event_id FROM events WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) FROM events) - 86400000)"
)


@register("stream_score_ordered", "event_id i, ewma 6, ewma_anomaly i, cusum 6, cusum_anomaly i", ORDERED_SQL, recursive=True)
def stream_score_ordered(spark, d):
    # Rows that the watermark has passed, in event order; the last day stays in state until later events close it.
    config = S.SPCConfig(cusum_units="standard")
    events = event_stream(SC.with_state_store(spark), d)
    scored = SC.stream_score_ordered(events, event_baselines(spark, d), "user_id", "ts", "event_id", "value", "1 day", config)
    return SC.run_to_table(scored, shared_dir(spark), fresh("ordered"))


@register(
    "stream_daily_panel",
    "user_id i, date d, value 2, readings i",
    """
SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS value, count(*) AS readings FROM events
GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def stream_daily_panel(spark, d):
    # Days the watermark has passed; the last days stay in state until later events close them.
    daily = SC.stream_daily_panel(event_stream(spark, d), "user_id", "ts", "value")
    return SC.run_to_table(daily, shared_dir(spark), fresh("daily"))


@register(
    "daily_panel",
    "user_id i, date d, value 2, readings i",
    "SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS value, count(*) AS readings FROM events GROUP BY 1, 2",
)
def daily_panel(spark, d):
    return SC.stream_daily_panel(T.table(spark, d, "events"), "user_id", "ts", "value")
