"""The data contract: one row per entity and day, with target flags and as-of history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.scale import islands, with_totals

KEYS = ("entity_id", "date")
CALENDAR_VERSION = "cal-v1"
LONG_ZERO_RUN_DAYS = 28


class ContractError(AssertionError):
    """The panel breaks an unambiguous rule."""


def find_duplicates(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every copy of every key that occurs more than once.

    Counting first and joining back keeps one heavily repeated key spread over its input tasks; AQE splits
    the join when a key is hot. A window over the key would gather all its copies in one task. NULL keys are equal.
    """
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_copies")).where(F.col("_copies") > 1)
    repeated = repeated.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return df.join(repeated, same, "left_semi")


def canonical_panel(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows in one table with provenance flags; duplicate keys raise."""
    for name, part in (("train", train), ("test", test)):
        copies = part.groupBy(*KEYS).count().where("count > 1").agg(F.sum("count").alias("n")).first()["n"]
        if copies:
            raise ContractError(f"{copies} duplicate entity x date rows in {name}")
    return union_panel(train, test)


def union_panel(train: DataFrame, test: DataFrame) -> DataFrame:
    keep = ["entity_id", "date", "capacity", "province", "region", "district", "value"]
    extra = ["id"] if "id" in test.columns else []
    left = train.select(*keep).withColumns({"is_train": F.lit(True), "is_test": F.lit(False)})
    if "value" not in test.columns:
        test = test.withColumn("value", F.lit(None).cast("double"))
    right = test.select(*keep, *extra).withColumns({"is_train": F.lit(False), "is_test": F.lit(True)})
    panel = left.unionByName(right, allowMissingColumns=True)
    return panel.withColumns({"log_value": F.log1p("value"), "calendar_version": F.lit(CALENDAR_VERSION)})


def target_flags(panel: DataFrame) -> DataFrame:
    """Describe each reading without changing it: observed, missing, true zero, suspected error."""
    value = F.col("value")
    present = value.isNotNull() & ~F.isnan(value)
    observed = F.col("is_train") & present
    infinite = F.abs(value) == float("inf")
    return panel.withColumns(
        {
            "target_observed": observed,
            "target_missing": F.col("is_train") & ~present,
            "target_true_zero": observed & (value == 0),
            "suspected_data_error": observed & ((value < 0) | infinite),
        }
    ).withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("target_true_zero", "suspected_data_error")})


def longest_run(df: DataFrame, keys: Sequence[str], order: str, flag: str, name: str) -> DataFrame:
    """Length of the longest run of true ``flag`` rows per key (row-consecutive)."""
    runs = (
        islands(df, keys, order, F.col(flag).cast("int"), "_run")
        .groupBy(*keys, "_run")
        .agg(F.sum(F.col(flag).cast("int")).alias("_length"))
    )
    return runs.groupBy(*keys).agg(F.max("_length").alias(name))


def history_asof(panel: DataFrame, origin: str, run_days: int = LONG_ZERO_RUN_DAYS) -> DataFrame:
    """Per-entity summary of observed rows strictly before ``origin``; entities without any are absent."""
    cut = F.to_date(F.lit(origin))
    seen = panel.where(F.col("target_observed") & (F.col("date") < cut)).select(
        "entity_id", "date", F.col("target_true_zero").cast("int").alias("_zero")
    )
    # One window numbers the zero runs; the run lengths and the summary then share its partitioning.
    runs = islands(seen, ["entity_id"], "date", F.col("_zero"), "_run").groupBy("entity_id", "_run").agg(
        F.min("date").alias("_first"),
        F.max("date").alias("_last"),
        F.count("*").alias("_n"),
        F.max("_zero").alias("_zero"),
    )
    zero_days = F.sum(F.col("_n") * F.col("_zero"))
    last_positive = F.max(F.when(F.col("_zero") == 0, F.col("_last")))
    return (
        runs.groupBy("entity_id")
        .agg(
            F.min("_first").alias("first_observed_date"),
            F.max("_last").alias("last_observed_date"),
            F.sum("_n").alias("n_history_days_at_origin"),
            (zero_days / F.sum("_n")).alias("zero_share_history"),
            last_positive.alias("_last_positive"),
            F.max(F.col("_n") * F.col("_zero")).alias("longest_zero_run"),
        )
        .withColumns(
            {
                "ever_positive_before_origin": F.col("_last_positive").isNotNull(),
                "days_since_last_positive": F.datediff(cut, F.col("_last_positive")),
                "all_observed_history_zero": F.col("zero_share_history") >= 1.0,
                "history_contains_only_zero_or_missing": F.col("zero_share_history") >= 1.0,
                "long_zero_run": F.col("longest_zero_run") >= run_days,
            }
        )
        .drop("_last_positive")
    )


def attach_origin(panel: DataFrame, origin: str) -> DataFrame:
    """History summary, horizon and seen flag on every row."""
    history = history_asof(panel, origin).withColumn("_seen", F.lit(True))
    cut = F.to_date(F.lit(origin))
    return (
        panel.join(history, "entity_id", "left")
        .withColumns(
            {
                "forecast_origin": cut,
                "horizon": F.datediff(F.col("date"), cut),
                "seen_at_origin": F.coalesce("_seen", F.lit(False)),
                "n_history_days_at_origin": F.coalesce("n_history_days_at_origin", F.lit(0)),
            }
        )
        .drop("_seen")
    )


def contract_findings(panel: DataFrame) -> DataFrame:
    """One row of counts: hard rule violations and soft findings."""
    per_key = panel.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.sum((F.col("target_observed") & (F.col("value") < 0)).cast("int")).alias("negative"),
        F.sum((F.col("capacity").isNull() | (F.col("capacity") <= 0)).cast("int")).alias("bad_capacity"),
        F.sum(
            (F.col("province").isNull() | F.col("region").isNull() | F.col("district").isNull()).cast("int")
        ).alias("bad_location"),
        F.sum(F.col("suspected_data_error").cast("int")).alias("suspect"),
        F.sum(F.col("is_test").cast("int")).alias("test_rows"),
    )
    # Per entity, the calendar is gapless exactly when the day count equals the span.
    per_entity = per_key.groupBy("entity_id").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        F.sum("negative").alias("negative"),
        F.sum("bad_capacity").alias("bad_capacity"),
        F.sum("bad_location").alias("bad_location"),
        F.sum("suspect").alias("suspect"),
        F.sum("test_rows").alias("test_rows"),
        F.min(F.when(F.col("test_rows") > 0, F.col("date"))).alias("first_test"),
        F.max(F.when(F.col("test_rows") > 0, F.col("date"))).alias("last_test"),
    )
    tested = F.col("test_rows") > 0
    gap = tested & (F.datediff("last_test", "first_test") + 1 != F.col("test_rows"))
    return per_entity.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_entities"),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_rows"),
        F.coalesce(F.sum("bad_capacity"), F.lit(0)).alias("bad_capacity_rows"),
        F.coalesce(F.sum("bad_location"), F.lit(0)).alias("bad_location_rows"),
        F.coalesce(F.sum("suspect"), F.lit(0)).alias("suspected_data_error_rows"),
        F.coalesce(F.sum(gap.cast("int")), F.lit(0)).alias("test_entities_with_gaps"),
        F.coalesce(F.sum(tested.cast("int")), F.lit(0)).alias("test_entities"),
    )


def check_contract(panel: DataFrame) -> dict[str, int]:
    """Raise on a hard violation, otherwise return the soft findings (a single row)."""
    found = contract_findings(panel).first().asDict()
    hard = {
        "duplicate_rows": "duplicate entity x date rows",
        "negative_rows": "negative kWh rows",
        "bad_capacity_rows": "rows with missing or non-positive capacity",
        "bad_location_rows": "rows with an incomplete location hierarchy",
    }
    for key, text in hard.items():
        if found[key]:
            raise ContractError(f"{found[key]} {text}")
    return {k: v for k, v in found.items() if k not in hard}


def contract_report(panel: DataFrame, origin: str) -> DataFrame:
    """Findings plus the cold-start share of test rows at one origin, as a single row."""
    attached = attach_origin(panel, origin)
    cold = F.avg(F.when(F.col("is_test"), (~F.col("seen_at_origin")).cast("double")))
    rows = attached.agg(
        F.sum(F.col("is_test").cast("int")).alias("test_rows"),
        F.coalesce(cold, F.lit(0.0)).alias("cold_start_share"),
    )
    return with_totals(contract_findings(panel), rows)


def calendar_gaps(df: DataFrame, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Days missing inside each key's own [first, last] span."""
    days = df.select(*keys, "date").distinct()
    ordered = Window.partitionBy(*keys).orderBy("date")
    ahead = days.withColumn("_next", F.lead("date").over(ordered)).where(F.datediff("_next", "date") > 1)
    inside = F.sequence(F.date_add("date", 1), F.date_sub("_next", 1))
    return ahead.select(*keys, F.explode(inside).alias("date"))
