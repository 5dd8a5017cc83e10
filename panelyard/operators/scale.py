"""Building blocks that keep plans whole at cluster scale.

Nothing here drops, caps or samples rows. Entity x day panels are unique by key, so one entity is never
longer than its calendar; districts, regions and capacity classes have no such bound and are therefore
only ever reduced by partial aggregation or split by value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.session import staged


def measured(dim: DataFrame) -> DataFrame:
    """Store a reduced table so that Catalyst plans its joins from the true size.

    A join against the result broadcasts it only when its stored bytes are below
    ``spark.sql.autoBroadcastJoinThreshold``; a larger one goes through a shuffle join with AQE skew
    handling. Without this the planner assumes an aggregate is as big as its input and shuffles the facts. One job per
    table; nothing stays in executor memory, and a lost executor costs a re-read.
    """
    return staged(dim)


def measured_together(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Several reduced tables stored by one write: their aggregates run side by side, and each is read back by itself.

    Each table is a struct column of its own, so a reader touches the columns of its table only.
    """
    union = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("_table"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(f"_{name}"))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    stored = staged(union)
    return {name: stored.where(F.col("_table") == name).select(f"_{name}.*") for name in tables}


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def attach(facts: DataFrame, dim: DataFrame, keys: str | Sequence[str], how: str = "left") -> DataFrame:
    """Equi join against a measured dimension."""
    return facts.join(measured(dim), [keys] if isinstance(keys, str) else list(keys), how)


def with_totals(facts: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the columns of a keyless aggregate to every fact, as one scalar subquery."""
    one = totals.select(F.struct(*totals.columns)).scalar()
    return (
        facts.withColumn("_totals", one)
        .withColumns({c: F.col(f"_totals.{c}") for c in totals.columns})
        .drop("_totals")
    )


TASK_ROWS = 1 << 18


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Partitions of about ``TASK_ROWS`` rows; None if the session's number of shuffle partitions is enough."""
    wanted = -(-rows // TASK_ROWS)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a stored table by ``keys`` so that a task holds about ``TASK_ROWS`` rows, however many there are.

    Windows and groups on the keys then need no exchange of their own. A small table stays as it is.
    """
    tasks = tasks_for(df.sparkSession, df.count())
    return df if tasks is None else df.repartition(tasks, *keys)


def latest_date(df: DataFrame, date: str = "date") -> Column:
    """The largest date of the whole table, as a scalar subquery usable in any filter."""
    return df.agg(F.max(date)).scalar()


def interpolate(low: Column, high: Column, share: Column) -> Column:
    return low + (high - low) * share


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    accuracy: int = 20_000,
    most: int = 65_536,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, for groups of any size.

    The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here a mergeable
    sketch first brackets each wanted rank; its rank error is at most 1/accuracy of the group, and the
    bracket is four times as wide. While a bracket may hold more than ``most`` rows, a round counts the rows in
    256 equal ranges of it and keeps those that the wanted rank needs. Then one more pass counts the rows beside the
    bracket and the multiplicity of each value inside it, so at most about ``most`` values of a group ever meet in
    one task, whatever its size. A rank outside its bracket fails the job instead of returning a wrong value.
    """
    names = list(probs)
    margin = 4.0 / accuracy
    lows = [max(0.0, probs[n] - margin) for n in names]
    highs = [min(1.0, probs[n] + margin) for n in names]
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = F.percentile_approx("_v", lows + highs, accuracy)
    brackets = data.groupBy(*keys).agg(F.count("*").alias("_n"), sketch.alias("_edges"))
    wanted = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"),
                F.lit(probs[n]).alias("p"),
                F.get("_edges", F.lit(i)).alias("lo"),
                F.get("_edges", F.lit(i + len(names))).alias("hi"),
            )
            for i, n in enumerate(names)
        ]
    )
    brackets = measured(brackets.withColumn("_wanted", wanted).drop("_edges"))
    inside = (brackets.agg(F.max("_n")).first()[0] or 0) * 10 / accuracy
    while inside > most:
        narrower = measured(narrow_brackets(bracketed(data, brackets, keys), keys))
        # a bracket of one value is done however many rows hold it
        left = narrower.select(F.explode("_wanted").alias("_w"), "_inside").where("_w.lo < _w.hi").agg(F.max("_inside")).first()[0] or 0
        brackets, inside = narrower.drop("_inside"), left
    # Values inside a bracket keep their own row; those below and above collapse into one row each, of
    # which the value beside the bracket is kept because a wanted rank may be its neighbour.
    spread = bracketed(data, brackets, keys)
    side = F.when(F.col("_v") < F.col("_w.lo"), 0).when(F.col("_v") > F.col("_w.hi"), 2).otherwise(1)
    placed = spread.withColumn("_side", side).withColumn("_key", F.when(F.col("_side") == 1, F.col("_v")))
    counts = placed.groupBy(*keys, "_w", "_n", "_side", "_key").agg(
        F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    order = Window.partitionBy(*keys, "_w.name").orderBy("_side", "_key")
    ranked = counts.withColumn("_last", F.sum("_c").over(order) - 1).withColumn(
        "_first", F.col("_last") - F.col("_c") + 1
    )
    position = F.col("_w.p") * (F.col("_n") - 1)

    def at(rank: Column) -> Column:
        inside = (F.col("_side") == 1) & (F.col("_first") <= rank) & (rank <= F.col("_last"))
        hit = F.when(inside | (rank == F.col("_first")), F.col("_least")).when(rank == F.col("_last"), F.col("_most"))
        return F.max(hit)

    found = ranked.groupBy(*keys, F.col("_w.name").alias("_name"), F.col("_w.p").alias("_p"), "_n").agg(
        at(F.floor(position)).alias("_low"), at(F.ceil(position)).alias("_high")
    )
    share = F.col("_p") * (F.col("_n") - 1) - F.floor(F.col("_p") * (F.col("_n") - 1))
    exact = interpolate(F.col("_low"), F.col("_high"), share)
    checked = F.when(F.col("_low").isNull() | F.col("_high").isNull(), F.raise_error("quantile bracket missed")).otherwise(
        exact
    )
    named = found.withColumn("_q", checked)
    picks = [F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in names]
    return named.groupBy(*keys).agg(*picks)


def bracketed(data: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per value and wanted rank: (keys, _v, _n, _w)."""
    if keys:
        rows = data.join(brackets, null_safe(data, brackets, keys)).select(data["*"], "_n", "_wanted")
    else:
        rows = with_totals(data, brackets)
    return rows.select(*keys, "_v", "_n", F.explode("_wanted").alias("_w"))


def narrow_brackets(spread: DataFrame, keys: Sequence[str], ranges: int = 256) -> DataFrame:
    """Brackets (keys, _n, _wanted, _inside) cut down to the ranges that hold the wanted ranks.

    The new ends are values of the data, so a bracket with two different values always shrinks. ``_inside`` is the
    largest number of rows in one of a group's brackets.
    """
    low, high = F.col("_w.lo"), F.col("_w.hi")
    share = F.least(F.floor((F.col("_v") / 2 - low / 2) / (high / 2 - low / 2) * ranges), F.lit(ranges - 1))
    spot = F.when(F.col("_v") < low, -1).when(F.col("_v") > high, ranges).when(low == high, 0).otherwise(share)
    cells = spread.withColumn("_spot", spot).groupBy(*keys, "_w", "_n", "_spot").agg(
        F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    order = Window.partitionBy(*keys, "_w.name").orderBy("_spot")
    ranked = cells.withColumn("_last", F.sum("_c").over(order) - 1).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    position = F.col("_w.p") * (F.col("_n") - 1)
    below, above = F.floor(position), F.ceil(position)
    # a rank beside the bracket leaves the old end, and the final pass finds or refuses it
    kept = F.col("_spot").between(0, ranges - 1)
    ends = ranked.groupBy(*keys, F.col("_w.name").alias("_name"), F.col("_w.p").alias("_p"), F.col("_w.lo").alias("_lo"), F.col("_w.hi").alias("_hi"), "_n").agg(
        F.coalesce(F.max(F.when(kept & (F.col("_first") <= below) & (below <= F.col("_last")), F.col("_least"))), F.first("_w.lo")).alias("lo"),
        F.coalesce(F.max(F.when(kept & (F.col("_first") <= above) & (above <= F.col("_last")), F.col("_most"))), F.first("_w.hi")).alias("hi"),
        F.sum(F.when(kept & (F.col("_last") >= below) & (F.col("_first") <= above), F.col("_c")).otherwise(0)).alias("_rows"),
    )
    one = F.struct(F.col("_name").alias("name"), F.col("_p").alias("p"), "lo", "hi")
    return ends.groupBy(*keys, "_n").agg(F.collect_list(one).alias("_wanted"), F.max("_rows").alias("_inside"))


def catalogue_quantiles(df: DataFrame, value: str, probs: Mapping[str, float]) -> DataFrame:
    """One row of exact linear-interpolated quantiles of a column with few distinct values, such as rated capacity.

    Rows collapse to one count per value on the map side; the running counts are taken over the catalogue alone.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.orderBy("_v")
    ranked = counts.withColumns({"_last": F.sum("_c").over(order) - 1, "_n": F.sum("_c").over(Window.partitionBy())})

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_last") >= rank, F.col("_v")))

    def quantile(p: float) -> Column:
        position = F.lit(p) * (F.col("_n") - 1)
        return interpolate(at(F.floor(position)), at(F.ceil(position)), F.max(position - F.floor(position)))

    return ranked.agg(*[quantile(p).alias(name) for name, p in probs.items()])


def scan_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    added: Sequence[T.StructField],
    start: Callable[[], Callable[..., list]],
    inputs: Sequence[str],
) -> DataFrame:
    """Append columns computed by one pass over each key's rows in order, with state between rows.

    ``start`` makes a step function; it is called per partition and receives (position, *inputs) arrays of
    one Arrow batch, where position 1 opens a new key. State travels from batch to batch, so a task holds a
    batch and the state of one key and never a whole key. Only ``inputs`` are touched in Python; the other
    columns pass through as Arrow buffers.
    """
    names, outputs = df.columns, [*df.columns, *[f.name for f in added]]
    wanted = ["_pos", *[f"_in{i}" for i in range(len(inputs))]]
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    doubles = {f"_in{i}": F.col(c).cast("double") for i, c in enumerate(inputs)}
    ordered = df.withColumns({"_pos": position, **doubles}).sortWithinPartitions(*keys, order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in wanted]
            made = [pa.array(a, from_pandas=True) for a in step(*columns)]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *made], outputs)

    return ordered.mapInArrow(scan, T.StructType([*df.schema.fields, *added]))


BLOCK_ROWS = 1 << 20


def in_blocks(df: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """The rows with ``_block``, a stored table whose blocks are ranges of ``order`` of about ``block_rows`` rows each.

    A series of any length is thereby cut into parts that fit a task; block numbers follow the order, equal order values
    share a block, and rows without one come first. None if the table is one block.
    """
    count = df.count() // block_rows
    if count < 1:
        return None
    return staged(df.repartitionByRange(count + 1, F.col(order).asc_nulls_first()).withColumn("_block", F.spark_partition_id()))


def islands(df: DataFrame, keys: Sequence[str], order: str, flag: Column, name: str = "island") -> DataFrame:
    """Number the runs of equal ``flag`` per key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (F.lag("_flag").over(w).isNull() | (F.lag("_flag").over(w) != F.col("_flag"))).cast("int")
    return (
        df.withColumn("_flag", flag)
        .withColumn("_changed", changed)
        .withColumn(name, F.sum("_changed").over(w))
        .drop("_flag", "_changed")
    )


def keep_one(df: DataFrame, keys: Sequence[str], *order: Column, largest: bool = False) -> DataFrame:
    """Row with the smallest (or largest) order value per key, found by a map-side combined aggregate.

    ``min_by`` keeps one row per key and task, so a key holding many copies never gathers in one place. Rows that tie
    in ``order`` are told apart by their remaining columns, so reruns keep the same one.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if largest else F.min_by
    types = dict(df.dtypes)
    ties = [F.col(c) for c in rest if not types[c].startswith(("map", "variant"))]
    best = pick(F.struct(*rest), F.struct(*order, *ties)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(df.columns)


def nearest_before(left: DataFrame, right: DataFrame, by: str, on: str, columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As-of join backward: for each left row the last right row of the same key at or before it.

    One union and one running ``last`` per key, so the cost is a single sort instead of a range join. Tables of more than
    ``block_rows`` rows are cut into ranges of ``on``: the running ``last`` then stays inside a key's block, and what
    came before it is carried over from the key's earlier blocks, one row each. So a key with half of all rows is
    spread like any others. Of right rows with equal key and position any one may answer.
    """
    marked_left = left.withColumn("_side", F.lit(1))
    types = dict(right.dtypes)
    for c in columns:
        marked_left = marked_left.withColumn(c, F.lit(None).cast(types[c]))
    marked_right = right.select(by, on, *columns).withColumn("_side", F.lit(0))
    both = marked_left.unionByName(marked_right, allowMissingColumns=True)
    blocks = in_blocks(both, on, block_rows)
    # a hit is carried as one struct, so columns of one answer come from one row even where some of them are null
    hit = F.when(F.col("_side") == 0, F.struct(*columns))
    until = Window.unboundedPreceding, Window.currentRow
    if blocks is None:
        w = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(*until)
        filled = both.withColumn("_hit", F.last(hit, ignorenulls=True).over(w))
    else:
        w = Window.partitionBy(by, "_block").orderBy(on, "_side").rowsBetween(*until)
        ends = blocks.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_at")).agg(
            F.max_by(hit, F.when(F.col("_side") == 0, F.struct(on, *columns))).alias("_end")
        )
        earlier = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("_by", "_at", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
        inside = blocks.withColumn("_hit", F.last(hit, ignorenulls=True).over(w))
        filled = inside.join(carried, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_at")))
        filled = filled.withColumn("_hit", F.coalesce("_hit", "_before")).drop("_by", "_at", "_before", "_block")
    answered = filled.where(F.col("_side") == 1).drop("_side")
    return answered.withColumns({c: F.col(f"_hit.{c}") for c in columns}).drop("_hit")


def nearest_within(left: DataFrame, right: DataFrame, by: str, on: str, reach: int, columns: Mapping[str, str]) -> DataFrame:
    """For each left row the closest right row of the same key with ``|on - on'| <= reach``.

    Ties go to the smaller right value. Both sides first collapse to their distinct (by, on) positions, on
    the map side, so repeated positions cost nothing. Positions are cut into bins of width ``reach`` and each
    right position is copied to its own bin and the two beside it; a window partition then holds at most
    four times ``reach`` positions, however large the key is. Inside a bin only the last right position at or
    before and the first at or after a left one can win. The answers join back to the left rows by
    position, where AQE splits a hot one.
    """
    bin_of = F.floor(F.col("_on") / reach)
    asked = (
        left.select(by, F.col(on).alias("_on")).where(F.col("_on").isNotNull()).distinct()
        .withColumn("_bin", bin_of).withColumn("_side", F.lit(1))
    )
    packed = F.struct(F.col(on).alias("_at"), *[F.col(c).alias(n) for n, c in columns.items()])
    points = (
        right.where(F.col(on).isNotNull())
        .groupBy(F.col(by), F.col(on).alias("_on")).agg(F.min(packed).alias("_hit"))
        .withColumn("_bin", F.explode(F.array(*[bin_of + i for i in (-1, 0, 1)])))
        .withColumn("_side", F.lit(0))
    )
    both = asked.unionByName(points, allowMissingColumns=True)
    keys = Window.partitionBy(by, "_bin")
    before = keys.orderBy("_on", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = keys.orderBy(F.col("_on"), F.col("_side").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = both.withColumn("_below", F.last("_hit", ignorenulls=True).over(before)).withColumn(
        "_above", F.first("_hit", ignorenulls=True).over(after)
    )
    gap_below, gap_above = F.col("_on") - F.col("_below._at"), F.col("_above._at") - F.col("_on")
    use_below = gap_below.isNotNull() & (gap_above.isNull() | (gap_below <= gap_above))
    best = F.when(use_below & (gap_below <= reach), F.col("_below")).when(
        ~use_below & (gap_above <= reach), F.col("_above")
    )
    answers = filled.where(F.col("_side") == 1).withColumn("_best", best).select(
        by, F.col("_on").alias(on), *[F.col(f"_best.{n}").alias(n) for n in columns]
    )
    return left.join(answers, [by, on], "left").select(*left.columns, *columns)
