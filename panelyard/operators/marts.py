"""Denormalised serving tables and the queries over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.rounding import rounded
from panelyard.functions.text import day_label
from panelyard.operators.scale import TASK_ROWS, attach
from panelyard.session import staged

META = ("capacity", "location", "province", "region", "district")
# Entities of one mean in a district from which on they are split by the start of their ids, and how long that start is.
TIED_ENTITIES, ID_START = 10_000, 8


def first_meta(rows: DataFrame) -> DataFrame:
    """Attributes of each entity from its first day, reduced on the map side."""
    picked = F.min_by(F.struct(*META), F.col("date")).alias("_m")
    return rows.groupBy("entity_id").agg(picked).select("entity_id", "_m.*")


def entity_status(train: DataFrame, test: DataFrame) -> DataFrame:
    """All entities with status Seen, Cold Start or Train Only; test attributes win."""
    tr, te = first_meta(train), first_meta(test)
    columns = {c: F.coalesce(te[c], tr[c]).alias(c) for c in META}
    status = F.when(te["entity_id"].isNull(), "Train Only").when(tr["entity_id"].isNull(), "Cold Start").otherwise("Seen")
    joined = tr.join(te, tr["entity_id"] == te["entity_id"], "full_outer")
    return joined.select(
        F.coalesce(te["entity_id"], tr["entity_id"]).alias("entity_id"), *columns.values(), status.alias("status")
    )


def entity_master(train: DataFrame, test: DataFrame, forecasts: DataFrame, version: str) -> DataFrame:
    """Entity directory with history and forecast statistics and the change between them."""
    v, p = F.col("value"), F.col("pred")
    hist = train.groupBy("entity_id").agg(
        F.count(v).alias("train_days"),
        F.avg(v).alias("_mean"),
        rounded(F.stddev_samp(v), 2).alias("train_std"),
        rounded(F.min(v), 2).alias("train_min"),
        rounded(F.max(v), 2).alias("train_max"),
        rounded(F.sum(v), 2).alias("train_sum"),
    )
    ahead = forecasts.where(F.col("version") == version).groupBy("entity_id").agg(
        F.avg(p).alias("_pred"), rounded(F.max(p), 2).alias("pred_max"), rounded(F.sum(p), 2).alias("pred_sum")
    )
    change = F.when(F.col("_mean") > 0, (F.col("_pred") - F.col("_mean")) / F.col("_mean") * 100)
    return (
        entity_status(train, test)
        .join(hist, "entity_id", "left")
        .join(ahead, "entity_id", "left")
        .withColumns(
            {
                "train_days": F.coalesce("train_days", F.lit(0)),
                "train_mean": rounded("_mean", 2),
                "pred_mean": rounded("_pred", 2),
                "yoy_pct": rounded(change, 2),
            }
        )
        .drop("_mean", "_pred")
    )


def seen_entities(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("entity_id").intersect(test.select("entity_id"))


def with_seen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    marked = rows.join(seen.withColumn("_seen", F.lit(True)), "entity_id", "left")
    return marked.withColumn("is_seen", F.coalesce("_seen", F.lit(False))).drop("_seen")


def district_history(train: DataFrame, seen: DataFrame) -> DataFrame:
    """District-day totals of all and of seen entities in one pass."""
    v, s = F.col("value"), F.col("is_seen")
    return with_seen(train, seen).groupBy("province", "district", "date").agg(
        rounded(F.sum(v), 2).alias("total"),
        rounded(F.avg(v), 2).alias("average"),
        F.count(v).alias("n"),
        rounded(F.coalesce(F.sum(F.when(s, v)), F.lit(0.0)), 2).alias("seen_total"),
        rounded(F.coalesce(F.avg(F.when(s, v)), F.lit(0.0)), 2).alias("seen_average"),
        F.count(F.when(s, v)).alias("seen_n"),
    )


def district_forecasts(forecasts: DataFrame, seen: DataFrame, versions: Sequence[str]) -> DataFrame:
    """District-day forecast totals: four columns per version, pivoted over a known list of versions."""
    p, s = F.col("pred"), F.col("is_seen")
    rows = with_seen(forecasts.where(F.col("version").isin(*versions)), seen)
    aggs = []
    for version in versions:
        mine = F.col("version") == version
        aggs += [
            F.sum(F.when(mine, p)).alias(f"_{version}"),
            F.sum(F.when(mine & s, p)).alias(f"_{version}_seen"),
        ]
    counted = F.col("version") == versions[0]
    out = rows.groupBy("province", "district", "date").agg(
        F.count(F.when(counted, 1)).alias("n"), F.count(F.when(counted & s, 1)).alias("seen_n"), *aggs
    )
    columns: dict[str, Column] = {}
    for version in versions:
        total = rounded(F.col(f"_{version}"), 2)
        part = rounded(F.coalesce(F.col(f"_{version}_seen"), F.lit(0.0)), 2)
        columns[version] = total
        columns[f"{version}_seen"] = part
        columns[f"{version}_avg"] = rounded(total / F.col("n"), 2)
        columns[f"{version}_seen_avg"] = F.when(F.col("seen_n") > 0, rounded(part / F.col("seen_n"), 2)).otherwise(F.lit(0.0))
    return out.select("province", "district", "date", "n", "seen_n", *[c.alias(n) for n, c in columns.items()])


def version_stats(forecasts: DataFrame) -> DataFrame:
    p = F.col("pred")
    return forecasts.groupBy("version").agg(
        F.count("*").alias("row_count"),
        rounded(F.avg(p), 4).alias("mean_pred"),
        rounded(F.max(p), 4).alias("max_pred"),
        rounded(F.sum(p), 2).alias("sum_pred"),
    )


def entity_search(
    entities: DataFrame,
    province: str | None = None,
    district: str | None = None,
    region: str | None = None,
    status: str | None = None,
    load_type: str | None = None,
    capacity_min: float | None = None,
    capacity_max: float | None = None,
    text: str | None = None,
) -> DataFrame:
    """Conjunction of the filters that are given; ``All`` means no filter. Text matches id, location or the
    local load type, ignoring ASCII case."""
    out = entities
    for column, wanted in (("province", province), ("district", district), ("region", region), ("status", status)):
        if wanted and wanted != "All":
            out = out.where(F.col(column) == wanted)
    if load_type and load_type != "All":
        out = out.where((F.col("load_type") == load_type) | (F.col("load_type_local") == load_type))
    if capacity_min is not None:
        out = out.where(F.col("capacity") >= capacity_min)
    if capacity_max is not None:
        out = out.where(F.col("capacity") <= capacity_max)
    if text and text.strip():
        pattern = f"%{text.strip()}%"
        searched = [c for c in ("entity_id", "location", "load_type_local") if c in out.columns]
        found = F.lit(False)
        for column in searched:
            found = found | F.coalesce(F.col(column).ilike(pattern), F.lit(False))
        out = out.where(found)
    return out


SORTABLE = ("entity_id", "capacity", "train_mean", "pred_mean", "yoy_pct", "train_max", "district", "confidence")


SHALLOW = 100_000


def paged_list(
    entities: DataFrame, sort_by: str = "train_mean", descending: bool = True, limit: int = 50, offset: int = 0, shallow: int = SHALLOW
) -> DataFrame:
    """One page in a whitelisted order, NULLs last, ties by id. An unknown key falls back to train_mean.

    The first ``shallow`` places are a top-k. For a deeper page the stored table is dealt into sorted ranges of about as many
    rows, or of ``TASK_ROWS`` where that would be more ranges than the session's shuffle partitions. The rows of each range
    are counted, and only the ranges that the page touches are sorted: one task never holds what lies before the page.
    """
    key = F.col(sort_by if sort_by in SORTABLE else "train_mean")
    order = [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("entity_id").asc()]
    if offset + limit <= shallow:
        return entities.orderBy(*order).offset(offset).limit(limit)
    entities = staged(entities)
    rows = entities.count()
    few = max(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)
    ranges = min(rows // shallow, few) + 1
    dealt = staged(entities.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before, wanted, skipped = 0, [], 0
    for number, rows in sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect()):
        if before < offset + limit and before + rows > offset:
            skipped = skipped if wanted else before
            wanted.append(number)
        before += rows
    page = dealt.where(F.col("_range").isin(wanted)).drop("_range")
    return page.orderBy(*order).offset(max(offset - skipped, 0)).limit(limit)


def distinct_facets(entities: DataFrame, forecasts: DataFrame | None = None) -> DataFrame:
    """Distinct values per facet with the capacity range: columns facet, parent, value."""
    facets = [
        F.struct(F.lit("province").alias("facet"), F.lit("").alias("parent"), F.col("province").alias("value")),
        F.struct(F.lit("district").alias("facet"), F.col("province").alias("parent"), F.col("district").alias("value")),
        F.struct(F.lit("region").alias("facet"), F.lit("").alias("parent"), F.col("region").alias("value")),
    ]
    if "load_type_local" in entities.columns:
        facets.append(
            F.struct(F.lit("load_type").alias("facet"), F.lit("").alias("parent"), F.col("load_type_local").alias("value"))
        )
    listed = entities.select(F.explode(F.array(*facets)).alias("f")).select("f.*").where("value IS NOT NULL AND value <> ''")
    limits = entities.agg(F.min("capacity").alias("low"), F.max("capacity").alias("high"))
    ends = F.array(
        F.struct(F.lit("capacity").alias("facet"), F.lit("min").alias("parent"), F.col("low").cast("int").cast("string").alias("value")),
        F.struct(F.lit("capacity").alias("facet"), F.lit("max").alias("parent"), F.col("high").cast("int").cast("string").alias("value")),
    )
    out = listed.distinct().unionByName(limits.select(F.explode(ends).alias("f")).select("f.*"))
    if forecasts is not None:
        out = out.unionByName(
            forecasts.select(F.lit("version").alias("facet"), F.lit("").alias("parent"), F.col("version").alias("value")).distinct()
        )
    return out


def district_summary(entities: DataFrame) -> DataFrame:
    status = F.col("status")
    return entities.groupBy("province", "district").agg(
        F.count("*").alias("n"),
        F.count(F.when(status == "Seen", 1)).alias("seen_n"),
        F.count(F.when(status == "Cold Start", 1)).alias("cold_n"),
        F.sum("capacity").alias("total_capacity"),
        F.sum("train_mean").alias("total_train_mean"),
    )


def global_stats(entities: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: entities by status, districts, and the date ranges of history and forecast."""
    status = F.col("status")
    counts = entities.agg(
        F.count("*").alias("entities"),
        F.count(F.when(status == "Seen", 1)).alias("seen"),
        F.count(F.when(status == "Cold Start", 1)).alias("cold_start"),
        F.count(F.when(status == "Train Only", 1)).alias("train_only"),
        F.count_distinct("district").alias("districts"),
    )

    def span(df: DataFrame) -> Column:
        text = F.concat(F.min("date").cast("string"), F.lit(" to "), F.max("date").cast("string"))
        return df.agg(text.alias("span")).scalar()

    return counts.withColumns({"history_range": span(train), "forecast_range": span(test)})


def entity_timeline(
    train: DataFrame, forecasts: DataFrame, weather: DataFrame, versions: Sequence[str], entity_id: str | None = None
) -> DataFrame:
    """History and the chosen forecast versions by entity and date, with temperature and day label; of one
    entity if its id is given."""
    mine = F.lit(True) if entity_id is None else F.col("entity_id") == entity_id
    hist = train.where(mine).select("entity_id", "district", "date", F.lit("history").alias("series"), F.col("value"))
    ahead = forecasts.where(mine & F.col("version").isin(*versions)).select(
        "entity_id", "district", "date", F.col("version").alias("series"), F.col("pred").alias("value")
    )
    rows = hist.unionByName(ahead).join(weather.select("district", "date", "temp_mean"), ["district", "date"], "left")
    return rows.select(
        "entity_id", "date", "series", day_label(F.col("date")).alias("day_label"), rounded("value", 2).alias("value"),
        F.col("temp_mean").alias("temp"),
    )


def same_day_a_year_before(date: Column) -> Column:
    """The same month and day one year earlier; NULL for 29 February."""
    text = F.concat((F.year(date) - 1).cast("string"), F.date_format(date, "-MM-dd"))
    return text.try_cast("date")


def yoy_alignment(forecasts: DataFrame, train: DataFrame, weather: DataFrame) -> DataFrame:
    """Forecast days matched to the same month and day one year before, with both temperatures.

    Both weather joins are keyed by district and day, the history join by entity and day.
    """
    before = train.select("entity_id", F.col("date").alias("hist_date"), rounded("value", 2).alias("hist_val"))
    temps = weather.select("district", "date", F.col("temp_mean").alias("pred_temp"))
    old_temps = weather.select("district", F.col("date").alias("hist_date"), F.col("temp_mean").alias("hist_temp"))
    rows = forecasts.withColumn("hist_date", same_day_a_year_before(F.col("date")))
    return (
        rows.join(before, ["entity_id", "hist_date"], "left")
        .join(temps, ["district", "date"], "left")
        .join(old_temps, ["district", "hist_date"], "left")
        .select(
            "entity_id",
            "version",
            "date",
            "hist_date",
            day_label(F.col("date")).alias("day_label"),
            day_label(F.col("hist_date")).alias("hist_day_label"),
            "hist_val",
            rounded("pred", 2).alias("pred"),
            "pred_temp",
            "hist_temp",
        )
    )


def comparison_table(forecasts: DataFrame, train: DataFrame, weather: DataFrame, version: str, keep_days: int = 30) -> DataFrame:
    """Per entity the last ``keep_days`` history rows and all forecast rows of one version, with the change
    against the same day a year before (NULL where that value is absent or zero)."""
    newest = Window.partitionBy("entity_id").orderBy(F.col("date").desc())
    recent = train.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= keep_days)
    temps = weather.select("district", "date", F.col("temp_mean").alias("temp"))
    none = F.lit(None).cast("double")
    past = recent.join(temps, ["district", "date"], "left").select(
        "entity_id", "date", F.lit("Historical").alias("period"), "temp", rounded("value", 2).alias("hist_val"),
        none.alias("pred"), none.alias("delta_pct"),
    )
    aligned = yoy_alignment(forecasts.where(F.col("version") == version), train, weather)
    change = F.when(F.col("hist_val") > 0, rounded((F.col("pred") - F.col("hist_val")) / F.col("hist_val") * 100, 1))
    future = aligned.select(
        "entity_id", "date", F.lit("Forecast").alias("period"), F.col("pred_temp").alias("temp"), "hist_val", "pred",
        F.when(F.col("pred") != 0, change).alias("delta_pct"),
    )
    return past.unionByName(future)


def monthly_summary(train: DataFrame, forecasts: DataFrame, weather: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Per entity and month: history and per-version averages and sums, and the district's mean temperature.

    The union of months of all sources, weather included: a month with weather only keeps its row.
    """
    month = F.date_format("date", "yyyy-MM")
    hist = train.groupBy("entity_id", month.alias("month")).agg(
        rounded(F.avg("value"), 2).alias("hist_avg"), rounded(F.sum("value"), 2).alias("hist_sum")
    )
    aggs = []
    for v in versions:
        mine = F.when(F.col("version") == v, F.col("pred"))
        aggs += [rounded(F.avg(mine), 2).alias(f"{v}_avg"), rounded(F.sum(mine), 2).alias(f"{v}_sum")]
    ahead = forecasts.where(F.col("version").isin(*versions)).groupBy("entity_id", month.alias("month")).agg(*aggs)
    home = first_meta(train).select("entity_id", "district").union(first_meta(forecasts).select("entity_id", "district")).distinct()
    temps = weather.groupBy("district", month.alias("month")).agg(rounded(F.avg("temp_mean"), 1).alias("temp_avg"))
    placed = attach(home, temps, "district").drop("district").where("month IS NOT NULL")
    return hist.join(ahead, ["entity_id", "month"], "full_outer").join(placed, ["entity_id", "month"], "full_outer")


def sibling_nav(entities: DataFrame) -> DataFrame:
    """Previous and next entity of the district by descending mean (NULL means last, ties by id), circular.

    Rows are entities, not readings. Districts can be large, so the neighbours come from value buckets of a
    district: a window per bucket, then the ends of neighbouring buckets are stitched from a small table. Entities
    without a mean, and those of one mean, are in order of their ids, so their buckets go by the start of the id.
    """
    rank = F.struct(
        F.col("train_mean").isNull().cast("int").alias("a"), (-F.col("train_mean")).alias("b"), F.col("entity_id").alias("c")
    )
    # Buckets must be ordered like the ranking: a coarse step of the logarithm of the mean, NULLs behind all.
    step = F.when(F.col("train_mean").isNull(), F.lit(2**30)).otherwise(-F.floor(F.log1p(F.greatest(F.col("train_mean"), F.lit(0.0))) * 64).cast("int"))
    # A step in which many share one mean, or have none, is split by the mean itself and the first characters of the id:
    # that is the order of the ranking, so the parts are in order too.
    named = entities.select("entity_id", "district", "train_mean", step.alias("_step"))
    tied = named.groupBy("district", "_step", "train_mean").agg(F.count("*").alias("_n")).where(F.col("_n") > TIED_ENTITIES)
    crowded = tied.select(F.col("district").alias("_d"), F.col("_step").alias("_s")).distinct().withColumn("_crowded", F.lit(True))
    known = named.join(crowded, F.col("district").eqNullSafe(F.col("_d")) & (F.col("_step") == F.col("_s")), "left")
    bucket = F.struct(
        F.col("_step").alias("step"), F.when(F.col("_crowded"), -F.col("train_mean")).alias("mean"),
        F.when(F.col("_crowded"), F.substring("entity_id", 1, ID_START)).otherwise(F.lit("")).alias("start"),
    )
    rows = known.select("entity_id", "district", rank.alias("_r"), bucket.alias("_b"))
    inside = Window.partitionBy("district", "_b").orderBy("_r")
    near = rows.withColumns({"_prev": F.lag("entity_id").over(inside), "_next": F.lead("entity_id").over(inside)})
    ends = rows.groupBy("district", "_b").agg(
        F.min("_r").alias("_first"), F.max("_r").alias("_last"), F.count("*").alias("_n")
    )
    across = Window.partitionBy("district").orderBy("_b")
    whole = Window.partitionBy("district")
    first = F.first("_first").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last("_last").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    stitched = ends.select(
        "district",
        "_b",
        F.coalesce(F.lag("_last").over(across), last)["c"].alias("_left"),
        F.coalesce(F.lead("_first").over(across), first)["c"].alias("_right"),
        F.sum("_n").over(whole).alias("district_count"),
    )
    return near.join(stitched, ["district", "_b"]).select(
        "entity_id",
        "district",
        F.coalesce("_prev", "_left").alias("prev_id"),
        F.coalesce("_next", "_right").alias("next_id"),
        "district_count",
    )


def table_catalog(tables: Mapping[str, DataFrame], about: Mapping[str, tuple[str, str]] = {}) -> DataFrame:
    """Name, row count, column count, description and sources of each table; the mapping is a parameter."""
    rows = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.lit(about.get(name, ("", ""))[0]).alias("description"),
            F.lit(about.get(name, ("", ""))[1]).alias("source_files"),
        )
        for name, df in tables.items()
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
