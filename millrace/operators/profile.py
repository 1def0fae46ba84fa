"""Profile of a table, one row per column (F1-F9), from its value histogram."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.staging import broadcast_if_small, scratch, staged
from millrace.operators.detect import KINDS, scan_histogram
from millrace.operators.typing import as_float, cells_of, column_types, parse_rates, value_histogram, wide_columns, wide_rates

#: Kinds of personal data of which no numeric statistics are shown.
SUPPRESSED = ("credit_card", "ssn", "phone")


def table_counts(df: DataFrame) -> DataFrame:
    """number of rows and columns."""
    return df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)).cast("bigint"))


def null_and_distinct(hist: DataFrame) -> DataFrame:
    """nulls and distinct values, and their share of all rows in percent."""
    rows = F.sum("n")
    nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    return hist.groupBy("ordinal", "column").agg(
        rows.alias("row_count"), nulls.alias("null_count"), (100.0 * nulls / rows).alias("null_pct"),
        F.count("value").alias("distinct_count"), (100.0 * F.count("value") / rows).alias("distinct_pct"),
    )


def top_k(hist: DataFrame, k: int = 10) -> DataFrame:
    """the k most frequent values of each column; ties by value.

    Of each column only the k first of a group of values go to the final ranking, so no task ranks all values.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    order = [F.col("n").desc(), F.col("value")]
    part = F.pmod(F.xxhash64("value"), F.lit(64))
    some = hist.filter("value is not null").withColumn("part", part)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("column", "part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("ordinal", "column", "rank", "value", "n")


def _numbers(hist: DataFrame, types: DataFrame) -> DataFrame:
    numeric = types.filter(F.col("col_type").isin("integer", "float")).select("column")
    return hist.join(F.broadcast(numeric), "column").withColumn("x", as_float(F.col("value"))).filter("x is not null")


def placed(values: DataFrame) -> DataFrame:
    """(column, x, n, _first, _last, _all, _index): x of a column takes the places from _first up to before _last of _all,
    and is its _index-th distinct value, from 0.

    No task holds a column: rows are dealt by ranges of (column, x) and summed within each range, and ranges start
    after those before them (one row per range and column).
    """
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    summed = values.groupBy("column", "x").agg(F.sum("n").alias("n"))
    dealt = summed.repartitionByRange(parts, "column", "x").withColumn("_p", F.spark_partition_id())
    local = staged(dealt, "quantiles")
    sizes = local.groupBy("column", "_p").agg(F.sum("n").alias("_n"), F.count("*").alias("_rows"))
    whole, earlier = Window.partitionBy("column"), Window.partitionBy("column").orderBy("_p")
    offsets = sizes.select(
        "column", "_p", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"), (F.sum("_rows").over(earlier) - F.col("_rows")).alias("_rows_before"), F.sum("_n").over(whole).alias("_all")
    )
    own = Window.partitionBy("column", "_p").orderBy("x")
    upto = local.withColumns({"_upto": F.sum("n").over(own), "_row": F.row_number().over(own)})
    last = F.col("_before") + F.col("_upto")
    at = (F.col("_rows_before") + F.col("_row") - 1).alias("_index")
    return upto.join(broadcast_if_small(offsets), ["column", "_p"]).select("column", "x", "n", (last - F.col("n")).alias("_first"), last.alias("_last"), "_all", at)


def nearest_ranks(numbers: DataFrame, share: float) -> DataFrame:
    """(column, q): the least x of (column, x, n) that has at least the share of its column at or below it."""
    wanted = F.greatest(F.ceil(F.lit(share) * F.col("_all")), F.lit(1))
    return placed(numbers).filter((F.col("_first") < wanted) & (wanted <= F.col("_last"))).select("column", F.col("x").alias("q"))


def weighted_quantiles(numbers: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(column, q): quantiles with linear interpolation of (column, x, n), each x counting n times. Only the rows on a
    wanted place are collected."""
    place = lambda s: F.lit(s) * (F.col("_all") - 1)
    wanted = F.array_distinct(F.array(*[f(place(s)).cast("bigint") for s in shares for f in (F.floor, F.ceil)]))
    hit = placed(numbers).select("column", "x", "_all", F.filter(wanted, lambda i: (i >= F.col("_first")) & (i < F.col("_last"))).alias("_i")).filter(F.size("_i") > 0)
    found = hit.select("column", "x", "_all", F.explode("_i").alias("_i")).groupBy("column", "_all").agg(F.map_from_entries(F.collect_list(F.struct("_i", "x"))).alias("_at"))
    at = lambda s, f: F.element_at("_at", f(place(s)).cast("bigint"))
    blend = lambda s: at(s, F.floor) + (at(s, F.ceil) - at(s, F.floor)) * (place(s) - F.floor(place(s)))
    return found.select("column", F.array(*map(blend, shares)).alias("q"))


def numeric_stats(hist: DataFrame, types: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Min, max, mean, sample deviation, quantiles with linear interpolation, and outliers beyond one and a
    half interquartile ranges, of integer and float columns that are not suppressed."""
    numbers = _numbers(hist, types)
    if suppressed is not None:
        numbers = numbers.join(F.broadcast(suppressed.select("column").distinct()), "column", "left_anti")
    numbers = staged(numbers.select("ordinal", "column", "x", "n"), "numbers")
    x, n = F.col("x"), F.col("n")
    total = F.sum(n)
    stats = numbers.groupBy("ordinal", "column").agg(total.alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), (F.sum(n * x) / total).alias("mean"))
    stats = staged(stats.join(weighted_quantiles(numbers, (0.05, 0.25, 0.5, 0.75, 0.95)), "column"), "column-stats")
    spread = numbers.join(F.broadcast(stats.select("column", F.col("mean").alias("_mean"), F.col("q")[1].alias("q1"), F.col("q")[3].alias("q3"))), "column")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    out = (x < F.col("q1") - fence) | (x > F.col("q3") + fence)
    square = F.sum(n * (x - F.col("_mean")) * (x - F.col("_mean")))
    spread = spread.groupBy("column").agg(
        F.when(F.sum(n) > 1, F.sqrt(square / (F.sum(n) - 1))).otherwise(0.0).alias("std"), F.sum(F.when(out, n).otherwise(0)).alias("outliers")
    )
    return stats.join(spread, "column").select(
        "ordinal", "column", "count", "min", "max", "mean", "std",
        *[F.col("q")[i].alias(c) for i, c in enumerate(("p5", "q1", "median", "q3", "p95"))], "outliers",
    )


def outlier_examples(hist: DataFrame, types: DataFrame, k: int = 5) -> DataFrame:
    """of each numeric column the k raw values farthest beyond the fences; ties by value."""
    numbers = _numbers(hist, types)
    q = weighted_quantiles(numbers, (0.25, 0.75))
    fence = 1.5 * (F.col("q")[1] - F.col("q")[0])
    beyond = F.greatest(F.col("q")[0] - fence - F.col("x"), F.col("x") - F.col("q")[1] - fence)
    far = numbers.join(F.broadcast(q), "column").withColumn("beyond", beyond).filter("beyond > 0")
    order = [F.col("beyond").desc(), F.col("value")]
    some = far.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64)))  # so no task ranks all outliers of a column
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("column", "part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("ordinal", "column", "rank", "value")


def profile(df: DataFrame, include_values: bool = False, k: int = 10, sketch: bool = False) -> DataFrame:
    """one row per column; raw values only where include_values asks for them.

    Wide columns of nearly unique text (`wide_columns`) have no histogram, so no text shuffles: their counts and parse
    rates are aggregates of one scan, cells are scanned for personal data where they stand, and they have neither numeric
    statistics nor most frequent values. Their distinct count is exact by digests, or with sketch an estimate (1 % off).
    """
    wide = wide_columns(df)
    narrow = [c for c in df.columns if c not in wide]
    with scratch(df.sparkSession) as own:
        hist = own.keep(staged(value_histogram(df, narrow), "histogram"))
        cells = cells_of(df, wide)
        rates = parse_rates(hist)
        if wide:
            own_rates = own.keep(staged(wide_rates(cells, sketch), "wide-rates"))
            rates = rates.unionByName(own_rates)
        types = own.keep(staged(column_types(rates), "column-types"))
        pii = scan_histogram(hist, KINDS)
        if wide:
            pii = pii.unionByName(scan_histogram(cells.withColumn("n", F.lit(1).cast("bigint")), KINDS))
        pii = own.keep(staged(pii, "column-pii"))
    counts = null_and_distinct(hist)
    if wide:
        rows = cells.groupBy("ordinal", "column").agg(F.count("*").alias("row_count"), F.count_if(F.col("value").isNull()).alias("null_count"))
        of = lambda c: 100.0 * F.col(c) / F.col("row_count")
        seen = rows.join(own_rates.select("column", F.col("distinct").alias("distinct_count")), "column")
        counts = counts.unionByName(seen.withColumns({"null_pct": of("null_count"), "distinct_pct": of("distinct_count")}))
    kinds = pii.groupBy("column").agg(F.array_sort(F.collect_list("kind")).alias("pii"))
    stats = numeric_stats(hist, types, pii.filter(F.col("kind").isin(*SUPPRESSED))).drop("ordinal")
    out = counts.join(types.drop("ordinal"), "column").join(kinds, "column", "left").join(stats, "column", "left")
    if include_values:
        top = top_k(hist, k).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
        out = out.join(top, "column", "left")
    return out
