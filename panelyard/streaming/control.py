"""Control charts and daily totals on streams.

Series state is keyed by series, so scoring scales with the number of series. Rows of one series are
scored in event order inside each trigger.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelyard.functions.clock import utc_date, utc_instant
from panelyard.operators.spc import SPCConfig, cusum_scale, cusum_step


def stream_score_stateless(events: DataFrame, baselines: DataFrame, key: str, value: str, config: SPCConfig = SPCConfig()) -> DataFrame:
    """Score each row on its own: Shewhart with the baseline sigma and the first run rule.

    A stream-static join; works the same on a batch. Rows of unknown series are not flagged.
    """
    out = events.join(baselines.select(key, "baseline_mean", "baseline_std"), key, "left")
    z = F.when(F.col("baseline_std") > 0, (F.col(value) - F.col("baseline_mean")) / F.col("baseline_std"))
    reach = config.shewhart_multiplier * F.col("baseline_std")
    outside = (F.col(value) > F.col("baseline_mean") + reach) | (F.col(value) < F.col("baseline_mean") - reach)
    return out.withColumn("z_score", z).withColumns(
        {
            "shewhart_anomaly": F.coalesce(outside, F.lit(False)),
            "nelson_r1": F.coalesce(F.abs("z_score") > config.nelson_threshold, F.lit(False)),
        }
    )


STATE = T.StructType(
    [
        T.StructField("rows", T.LongType()),
        T.StructField("ewma", T.DoubleType()),
        T.StructField("up", T.DoubleType()),
        T.StructField("down", T.DoubleType()),
    ]
)


def stream_score_stateful(
    events: DataFrame, baselines: DataFrame, key: str, order: str, value: str, config: SPCConfig = SPCConfig()
) -> DataFrame:
    """EWMA and CUSUM that survive from trigger to trigger; equals the batch charts on ordered input.

    State per series: rows seen, EWMA level, both running sums, the newest order value. Rows of a series are charted in
    order within a trigger. A row that arrives after a newer one was charted is marked ``late`` and charted in its turn of
    arrival. Series without a baseline are kept and never flagged.
    """
    types = dict((f.name, f.dataType) for f in events.schema.fields)
    schema = T.StructType(
        [
            T.StructField(key, types[key]),
            T.StructField(order, types[order]),
            T.StructField(value, T.DoubleType()),
            T.StructField("ewma", T.DoubleType()),
            T.StructField("ewma_anomaly", T.BooleanType()),
            T.StructField("cusum", T.DoubleType()),
            T.StructField("cusum_anomaly", T.BooleanType()),
            T.StructField("late", T.BooleanType()),
        ]
    )
    kept = T.StructType([*STATE.fields, T.StructField("newest", types[order])])
    lam = config.ewma_lambda

    def score(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows, level, up, down, newest = state.get if state.exists else (0, None, 0.0, 0.0, None)
        level = np.nan if level is None else level
        mean, sigma = (np.nan if pd.isna(x) else float(x) for x in (frame["baseline_mean"].iloc[0], frame["baseline_std"].iloc[0]))
        late = np.zeros(len(frame), bool) if newest is None else (frame[order] < newest).to_numpy(bool)
        scale = cusum_scale(config, sigma)
        k, h = config.cusum_k * scale, config.cusum_h * scale
        out = np.empty((len(frame), 4))
        for i, x in enumerate(frame[value].to_numpy(float)):
            rows += 1
            missing = np.isnan(x)
            level = x if rows == 1 else (level if missing else lam * x + (1 - lam) * level)
            reach = config.ewma_multiplier * sigma * np.sqrt(lam / (2 - lam) * (1 - (1 - lam) ** (2 * rows)))
            if missing:
                pos, neg = up, down
            else:
                z = (x - mean) / sigma if sigma > 0 else 0.0
                pos, neg, up, down = cusum_step(up, down, z, k, h)
            total = abs(pos) + abs(neg)
            out[i] = level, abs(level - mean) > reach, total, total > h
        top = frame[order].iloc[-1]
        newest = top if newest is None or top > newest else newest
        state.update((rows, None if np.isnan(level) else float(level), up, down, newest.item() if hasattr(newest, "item") else newest))
        yield pd.DataFrame(
            {
                key: frame[key], order: frame[order], value: frame[value].astype(float), "ewma": out[:, 0],
                "ewma_anomaly": out[:, 1].astype(bool), "cusum": out[:, 2], "cusum_anomaly": out[:, 3].astype(bool), "late": late,
            }
        )

    joined = events.join(baselines.select(key, "baseline_mean", "baseline_std"), key, "left")
    return joined.groupBy(key).applyInPandasWithState(score, schema, kept, "append", GroupStateTimeout.NoTimeout)


class OrderedCharts(StatefulProcessor):
    """EWMA and CUSUM of one series in event order, whatever the order of arrival.

    A list state holds the rows that the watermark has not passed, a value state the charts. A timer at the earliest
    held row fires once the watermark has passed it; then all rows up to the watermark leave in order.
    """

    def __init__(self, key: str, time: str, order: str, value: str, types: dict, config: SPCConfig):
        self.key, self.time, self.order, self.value, self.config = key, time, order, value, config
        self.row = T.StructType([T.StructField("ms", T.LongType()), T.StructField(order, types[order]), T.StructField(value, T.DoubleType())])
        charts = [T.StructField(n, T.DoubleType()) for n in ("level", "up", "down", "mean", "sigma")]
        self.charts = T.StructType([T.StructField("rows", T.LongType()), *charts])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.row)
        self.state = handle.getValueState("charts", self.charts)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            ms = frame["at_ms"].astype("int64")
            values = frame[self.value].astype(float)
            self.held.appendList([(int(t), o, None if math.isnan(v) else float(v)) for t, o, v in zip(ms, frame[self.order].tolist(), values, strict=True)])
            earliest = int(ms.min()) if earliest is None else min(earliest, int(ms.min()))
            if not self.state.exists():
                mean, sigma = (None if pd.isna(x) else float(x) for x in (frame["baseline_mean"].iloc[0], frame["baseline_std"].iloc[0]))
                self.state.update((0, None, 0.0, 0.0, mean, sigma))
        timers = list(self.handle.listTimers())
        if earliest is not None and (not timers or earliest < min(timers)):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.held.get(), key=lambda r: (r[0], r[1]))
        ready, later = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        if later:
            self.held.put(later)
            self.handle.registerTimer(later[0][0])
        else:
            self.held.clear()
        if ready:
            yield self.out(key, ready)

    def out(self, key, rows: list) -> pd.DataFrame:
        made = []
        count, level, up, down, mean, sigma = self.state.get()
        level, mean, sigma = (math.nan if x is None else x for x in (level, mean, sigma))
        for ms, order, x in rows:
            count += 1
            charted, level, up, down = chart_row(math.nan if x is None else x, count, level, up, down, mean, sigma, self.config)
            made.append((key[0], ms, order, x, *charted))
        self.state.update((count, *(None if math.isnan(v) else float(v) for v in (level, up, down, mean, sigma))))
        names = [self.key, "at_ms", self.order, self.value, "ewma", "ewma_anomaly", "cusum", "cusum_anomaly"]
        return pd.DataFrame(made, columns=names)

    def close(self) -> None:
        pass


def chart_row(x: float, count: int, level: float, up: float, down: float, mean: float, sigma: float, config: SPCConfig) -> tuple:
    """((EWMA, flag, CUSUM, flag), level, positive sum, negative sum) after the ``count``-th row of a series."""
    lam, scale = config.ewma_lambda, cusum_scale(config, sigma)
    missing = math.isnan(x)
    level = x if count == 1 else (level if missing else lam * x + (1 - lam) * level)
    reach = config.ewma_multiplier * sigma * math.sqrt(lam / (2 - lam) * (1 - (1 - lam) ** (2 * count)))
    if missing:
        pos, neg = up, down
    else:
        z = (x - mean) / sigma if sigma > 0 else 0.0
        pos, neg, up, down = cusum_step(up, down, z, config.cusum_k * scale, config.cusum_h * scale)
    total = abs(pos) + abs(neg)
    return (level, bool(abs(level - mean) > reach), total, bool(total > config.cusum_h * scale)), level, up, down


def stream_score_ordered(
    events: DataFrame, baselines: DataFrame, key: str, time: str, order: str, value: str, late: str = "1 day", config: SPCConfig = SPCConfig()
) -> DataFrame:
    """EWMA and CUSUM in event order over any order of arrival, ties in ``time`` by ``order``.

    A row is emitted once the watermark (the newest time less ``late``) has passed it; rows that arrive behind the watermark
    are dropped by the engine. State per series: the rows inside the delay, and six numbers. Needs the RocksDB state store
    (``with_state_store``). Columns: key, time, order, value, ewma, ewma_anomaly, cusum, cusum_anomaly.
    """
    types = {f.name: f.dataType for f in events.schema.fields}
    zoneless = dict(events.dtypes)[time] == "timestamp_ntz"
    moment = utc_instant(F.col(time)) if zoneless else F.col(time)
    joined = events.withColumn(time, moment).withWatermark(time, late).join(baselines.select(key, "baseline_mean", "baseline_std"), key, "left")
    rows = joined.withColumn("at_ms", F.unix_millis(time)).select(key, time, "at_ms", order, F.col(value).cast("double").alias(value), "baseline_mean", "baseline_std")
    charts = [T.StructField(n, T.BooleanType() if n.endswith("anomaly") else T.DoubleType()) for n in ("ewma", "ewma_anomaly", "cusum", "cusum_anomaly")]
    made = T.StructType([T.StructField(key, types[key]), T.StructField("at_ms", T.LongType()), T.StructField(order, types[order]), T.StructField(value, T.DoubleType()), *charts])
    scored = rows.groupBy(key).transformWithStateInPandas(OrderedCharts(key, time, order, value, types, config), made, "Append", "EventTime")
    return scored.select(key, F.timestamp_millis("at_ms").alias(time), order, value, *[f.name for f in charts])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that list states and timers need; streams started before keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def stream_daily_panel(events: DataFrame, key: str, time: str, value: str, late: str = "1 day") -> DataFrame:
    """Totals per series and UTC day, emitted once the watermark has passed the day."""
    zoneless = dict(events.dtypes)[time] == "timestamp_ntz"
    moment = utc_instant(F.col(time)) if zoneless else F.col(time)
    return (
        events.withColumn(time, moment)
        .withWatermark(time, late)
        .groupBy(key, F.window(time, "1 day").alias("w"))
        .agg(F.sum(value).alias("value"), F.count("*").alias("readings"))
        .select(key, utc_date(F.col("w.start")).alias("date"), "value", "readings")
    )


def run_to_table(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Drain what is available into a parquet table with an exactly-once log, and read the table back."""
    target, log = f"{folder}/{name}", f"{folder}/{name}_log"
    query = (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", log)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
