"""Contract, cleaning, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.operators import clean, contract
from panelyard.operators import history as H
from panelyard.operators import scale
from panelyard.operators import spc
from panelyard.plans import tables as T
from panelyard.plans.registry import cte, register


@register(
    "find_duplicates",
    "l_orderkey i, l_linenumber i, l_partkey i, l_quantity 2, l_extendedprice 2",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem
QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""",
)
def find_duplicates(spark, d):
    return contract.find_duplicates(T.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# Readings of the 13th are treated as not delivered, so that missing differs from zero.
cte(
    "canon",
    """
SELECT entity_id, date, capacity, province, region, district, CASE WHEN day(date) <> 13 THEN value END AS value,
       TRUE AS is_train, FALSE AS is_test FROM train
UNION ALL
SELECT entity_id, date, capacity, province, region, district, NULL, FALSE, TRUE FROM test_rows""",
)
cte(
    "flagged",
    """
SELECT *, is_train AND value IS NOT NULL AS target_observed, is_train AND value IS NULL AS target_missing,
       is_train AND coalesce(value = 0, FALSE) AS target_true_zero,
       is_train AND coalesce(value < 0, FALSE) AS suspected_data_error
FROM canon""",
)


def canon(spark, d):
    train = T.train(spark, d).withColumn("value", F.when(F.dayofmonth("date") != 13, F.col("value")))
    return contract.canonical_panel(train, T.test_rows(spark, d).drop("value"))


@register(
    "canonical_panel",
    "entity_id s, date d, capacity 1, province s, region s, district s, value 2, is_train i, is_test i, log_value 6, calendar_version s",
    "SELECT *, ln(1 + value) AS log_value, 'cal-v1' AS calendar_version FROM canon",
)
def canonical_panel(spark, d):
    return canon(spark, d)


@register(
    "target_flags",
    "entity_id s, date d, target_observed i, target_missing i, target_true_zero i, suspected_data_error i",
    "SELECT * FROM flagged",
)
def target_flags(spark, d):
    return contract.target_flags(canon(spark, d))


cte(
    "household_flags",
    "SELECT *, value = 0 AS zero FROM household_past",
)
cte(
    "household_history",
    f"""
SELECT entity_id, min(date) AS first_observed_date, max(date) AS last_observed_date, count(*) AS n_history_days_at_origin,
       avg(CASE WHEN zero THEN 1 ELSE 0 END) AS zero_share_history, bool_or(NOT zero) AS ever_positive_before_origin,
       date_diff('day', max(date) FILTER (WHERE NOT zero), DATE '{T.CUT}') AS days_since_last_positive,
       bool_and(zero) AS all_observed_history_zero, max(run) >= 28 AS long_zero_run, max(run) AS longest_zero_run
FROM (SELECT *, CASE WHEN zero THEN count(*) OVER (PARTITION BY entity_id, zero, island) ELSE 0 END AS run
      FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date)
                    - row_number() OVER (PARTITION BY entity_id, zero ORDER BY date) AS island FROM household_flags))
GROUP BY 1""",
)


def household_panel(spark, d):
    past, future = T.household_split(spark, d)
    return contract.target_flags(contract.union_panel(past, future.drop("value")))


HISTORY = (
    "first_observed_date d, last_observed_date d, n_history_days_at_origin i, zero_share_history 6, "
    "ever_positive_before_origin i, days_since_last_positive 0, all_observed_history_zero i, long_zero_run i"
)


@register("history_asof", f"entity_id s, {HISTORY}, longest_zero_run i", "SELECT * FROM household_history")
def history_asof(spark, d):
    return contract.history_asof(household_panel(spark, d), T.CUT)


@register(
    "zero_run",
    "entity_id s, longest i",
    """
SELECT entity_id, max(length) AS longest FROM (
  SELECT entity_id, run, sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS length FROM (
    SELECT *, sum(CASE WHEN value = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id ORDER BY date) AS run FROM household)
  GROUP BY 1, 2) GROUP BY 1""",
)
def zero_run(spark, d):
    flagged = T.household(spark, d).withColumn("zero", F.col("value") == 0)
    return contract.longest_run(flagged, ["entity_id"], "date", "zero", "longest")


@register(
    "attach_origin",
    f"entity_id s, date d, is_test i, horizon i, seen_at_origin i, n_history_days_at_origin i, zero_share_history 6, long_zero_run 0",
    f"""
SELECT f.entity_id, f.date, f.is_test, date_diff('day', DATE '{T.CUT}', f.date) AS horizon, h.entity_id IS NOT NULL AS seen_at_origin,
       coalesce(h.n, 0) AS n_history_days_at_origin, h.z AS zero_share_history, h.run >= 28 AS long_zero_run
FROM flagged f LEFT JOIN (
  SELECT entity_id, count(*) AS n, avg(CASE WHEN zero THEN 1 ELSE 0 END) AS z, max(CASE WHEN zero THEN len ELSE 0 END) AS run
  FROM (SELECT *, count(*) OVER (PARTITION BY entity_id, zero, island) AS len
        FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date)
                      - row_number() OVER (PARTITION BY entity_id, zero ORDER BY date) AS island
              FROM (SELECT entity_id, date, target_true_zero AS zero FROM flagged WHERE target_observed)))
  GROUP BY 1) h ON h.entity_id = f.entity_id""",
)
def attach_origin(spark, d):
    return contract.attach_origin(contract.target_flags(canon(spark, d)), T.CUT)


FINDINGS = (
    "n_rows i, n_entities i, duplicate_rows i, negative_rows i, bad_capacity_rows i, bad_location_rows i, "
    "suspected_data_error_rows i, test_entities_with_gaps i, test_entities i"
)
cte(
    "findings",
    """
SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, count(*) - count(DISTINCT (entity_id, date)) AS duplicate_rows,
       count(*) FILTER (WHERE target_observed AND value < 0) AS negative_rows,
       count(*) FILTER (WHERE capacity IS NULL OR capacity <= 0) AS bad_capacity_rows,
       count(*) FILTER (WHERE province IS NULL OR region IS NULL OR district IS NULL) AS bad_location_rows,
       count(*) FILTER (WHERE suspected_data_error) AS suspected_data_error_rows,
       (SELECT count(*) FROM (SELECT entity_id FROM flagged WHERE is_test GROUP BY 1
                              HAVING date_diff('day', min(date), max(date)) + 1 <> count(*))) AS test_entities_with_gaps,
       count(DISTINCT entity_id) FILTER (WHERE is_test) AS test_entities
FROM flagged""",
)


@register("contract_findings", FINDINGS, "SELECT * FROM findings")
def contract_findings(spark, d):
    return contract.contract_findings(contract.target_flags(canon(spark, d)))


@register(
    "contract_report",
    f"{FINDINGS}, test_rows i, cold_start_share 6",
    """
SELECT *, (SELECT count(*) FROM flagged WHERE is_test) AS test_rows,
       (SELECT avg(CASE WHEN entity_id IN (SELECT entity_id FROM flagged WHERE target_observed) THEN 0 ELSE 1 END)
        FROM flagged WHERE is_test) AS cold_start_share
FROM findings""",
)
def contract_report(spark, d):
    return contract.contract_report(contract.target_flags(canon(spark, d)), T.CUT)


@register(
    "calendar_gaps",
    "entity_id s, date d",
    """
SELECT entity_id, date FROM (
  SELECT entity_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM panel GROUP BY entity_id)
EXCEPT SELECT entity_id, date FROM panel""",
)
def calendar_gaps(spark, d):
    return contract.calendar_gaps(T.panel(spark, d))


@register(
    "expanding_prior_median",
    "entity_id s, date d, prior_median 4",
    """
SELECT entity_id, date, coalesce(quantile_cont(CASE WHEN value <= 3 * capacity * 24 THEN value END, 0.5)
       OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_median
FROM readings""",
)
def expanding_prior_median(spark, d):
    believable = F.when(F.col("value") <= 3 * F.col("capacity") * 24, F.col("value"))
    return clean.expanding_prior_median(T.readings(spark, d), believable)


RATES = ", ".join(f"{r}" for r in clean.AMPLIFICATION_RATES)
cte(
    "with_prior",
    """
SELECT *, coalesce(quantile_cont(CASE WHEN NOT value > 3 * capacity * 24 THEN value END, 0.5)
       OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
FROM panel""",
)
cte(
    "suspect",
    f"""
SELECT w.entity_id, w.date, w.value, w.capacity, w.prior, r.rate, abs(r.rate - w.value / w.prior) / r.rate AS gap
FROM with_prior w LEFT JOIN (SELECT CAST(unnest([{RATES}]) AS DOUBLE) AS rate) r ON w.prior > 0
WHERE w.value > 3 * w.capacity * 24 OR (w.prior > 0 AND w.value / greatest(w.prior, 1e-3) > 5 AND w.value > 100)
QUALIFY row_number() OVER (PARTITION BY w.entity_id, w.date ORDER BY abs(r.rate - w.value / nullif(w.prior, 0)) / r.rate, r.rate) = 1""",
)
cte(
    "clean_panel",
    """
SELECT p.* EXCLUDE (value, log_value, is_pos), CASE WHEN s.entity_id IS NULL THEN p.value WHEN s.prior <= 0 THEN 0
            WHEN s.gap < 0.4e0 AND s.value / s.rate <= greatest(s.capacity * 24 * 1.5, s.prior * 4) THEN s.value / s.rate
            ELSE s.prior END AS value, s.entity_id IS NOT NULL AS repaired
FROM panel p LEFT JOIN suspect s ON s.entity_id = p.entity_id AND s.date = p.date""",
)


@register("declip", "entity_id s, date d, value 4, changed i", "SELECT *, abs(value - (SELECT p.value FROM panel p WHERE p.entity_id = c.entity_id AND p.date = c.date)) > 1e-9 AS changed FROM clean_panel c")
def declip(spark, d):
    rows = T.readings(spark, d).withColumn("raw", F.col("value"))
    return clean.declip(rows).withColumn("changed", F.abs(F.col("value") - F.col("raw")) > 1e-9)


@register(
    "before_cutoff",
    "entity_id s, date d, value 2",
    f"SELECT * FROM panel WHERE date < DATE '{T.CUT}'",
)
def before_cutoff(spark, d):
    return H.before_cutoff(T.panel(spark, d), T.CUT)


@register(
    "target_window",
    "entity_id s, date d, value 2",
    f"SELECT * FROM panel WHERE date >= DATE '{T.CUT}' AND date < DATE '{T.END}'",
)
def target_window(spark, d):
    return H.target_window(T.panel(spark, d), T.CUT, T.END)


@register(
    "recent_window",
    "entity_id s, date d, value 2",
    "SELECT * FROM train WHERE date_diff('day', date, (SELECT max(date) FROM train)) < 28",
)
def recent_window(spark, d):
    return H.recent_window(T.train(spark, d), 28)


@register(
    "valid_for_spc",
    "entity_id s, date d, value 2",
    "SELECT * FROM household WHERE value > 0",
)
def valid_for_spc(spark, d):
    return spc.valid_for_spc(T.household(spark, d))


@register(
    "entity_sets",
    "entity_id s, membership s",
    """
SELECT entity_id, 'both' AS membership FROM (SELECT entity_id FROM train INTERSECT SELECT entity_id FROM test_rows)
UNION ALL SELECT entity_id, 'train only' FROM (SELECT entity_id FROM train EXCEPT SELECT entity_id FROM test_rows)
UNION ALL SELECT entity_id, 'test only' FROM (SELECT entity_id FROM test_rows EXCEPT SELECT entity_id FROM train)""",
)
def entity_sets(spark, d):
    past, ahead = (f(spark, d).select("entity_id") for f in (T.train, T.test_rows))
    parts = {"both": past.intersect(ahead), "train only": past.subtract(ahead), "test only": ahead.subtract(past)}
    named = [df.withColumn("membership", F.lit(n)) for n, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@register(
    "distinct_union",
    "district s",
    "SELECT district FROM train UNION SELECT district FROM household",
)
def distinct_union(spark, d):
    return T.train(spark, d).select("district").union(T.household(spark, d).select("district")).distinct()


@register(
    "dedupe_first",
    "l_orderkey i, l_linenumber i, l_shipdate d, l_partkey i, l_suppkey i",
    """
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1""",
)
def dedupe_first(spark, d):
    rows = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey")]
    return scale.keep_one(rows, ["l_orderkey", "l_linenumber"], *order)


@register(
    "dedupe_latest",
    "l_orderkey i, l_linenumber i, l_shipdate d, l_partkey i, l_suppkey i",
    """
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1""",
)
def dedupe_latest(spark, d):
    rows = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey")]
    return scale.keep_one(rows, ["l_orderkey", "l_linenumber"], *order, largest=True)
