"""What changed between two versions of a table."""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.binding import let
from millrace.functions.staging import staged
from millrace.operators.detect import scan_histogram
from millrace.operators.profile import SUPPRESSED, null_and_distinct
from millrace.operators.typing import as_float, column_types, is_id_like, parse_rates, typed, value_histogram
from millrace.sources.tables import name_of


@dataclass
class TableDiff:
    """The frames of a comparison; those about rows are None where no key fits, and notes say why."""

    schema: DataFrame
    types: DataFrame
    nulls: DataFrame
    categories: DataFrame
    numbers: DataFrame
    key: list[str] = field(default_factory=list)
    classes: DataFrame | None = None
    cells: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def schema_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, change) of columns that only one side has, in that side's order."""
    spark = a.sparkSession
    both = [(i, c, "added") for i, c in enumerate(b.columns) if c not in a.columns] + [(i, c, "removed") for i, c in enumerate(a.columns) if c not in b.columns]
    return spark.createDataFrame(both, "ordinal int, column string, change string")


def type_changes(types_a: DataFrame, types_b: DataFrame) -> DataFrame:
    """Shared columns whose inferred type differs."""
    other = types_b.select("column", F.col("col_type").alias("new_type"))
    return types_a.join(other, "column").filter("col_type <> new_type").select("column", F.col("col_type").alias("old_type"), "new_type")


def nullability_changes(hist_a: DataFrame, hist_b: DataFrame, points: float = 5.0) -> DataFrame:
    """D3: shared columns whose share of nulls moved by more than so many points."""
    side = lambda h, name: null_and_distinct(h).select("column", F.col("null_pct").alias(name))
    both = side(hist_a, "old_null_pct").join(side(hist_b, "new_null_pct"), "column")
    return both.filter(F.abs(F.col("new_null_pct") - F.col("old_null_pct")) > points)


def candidate_keys(rates: DataFrame, hist: DataFrame) -> DataFrame:
    """Columns without null and without repeats; those that look like ids first, then in order."""
    nulls = hist.groupBy("column").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"))
    good = rates.join(nulls, "column").filter("nulls = 0 and filled > 0 and distinct = filled")
    place = F.row_number().over(Window.orderBy((column_type_is_id(good)).desc(), "ordinal"))
    return good.withColumn("place", place).select("column", "ordinal", "place")


def column_type_is_id(rates: DataFrame) -> Column:
    """Whether a row of parse_rates comes out as id_like: of the right shape, and of no type that goes before."""
    earlier = F.greatest("boolean_rate", "integer_rate", "float_rate", "date_rate", "datetime_rate") >= 0.95
    return (is_id_like() & ~earlier).cast("int")


def shared_keys(keys_a: DataFrame, keys_b: DataFrame) -> DataFrame:
    """Candidates of both tables, in the first one's order."""
    return keys_a.join(keys_b.select("column"), "column", "left_semi")


def key_token(column: str, col_type: str) -> Column:
    """struct<tag, typed, raw>: a missing cell, a typed value, or the raw text where the type does not fit.

    Typed values are compared as text of their type, so 1 and 1.0 are equal as floats.
    """
    raw = name_of(column)
    value = typed(raw, col_type)
    tag = F.when(raw.isNull(), "missing").when(value.isNull(), "raw").otherwise("typed")
    return F.struct(tag.alias("tag"), value.cast("string").alias("typed"), F.when(value.isNull(), raw).alias("raw"))


def with_token(df: DataFrame, keys: Sequence[str], types: dict[str, str]) -> DataFrame:
    return df.withColumn("_token", F.struct(*[key_token(k, types.get(k, "text")).alias(f"k{i}") for i, k in enumerate(keys)]))


def duplicate_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens that stand more than once."""
    return tokens.groupBy("_token").agg(F.count("*").alias("n")).filter("n > 1")


def differs(old: Column, new: Column, col_type: str) -> Column:
    """Unequal cells: one missing, one that does not parse against one that does, else by raw text or typed value."""

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        one = old.isNull() != new.isNull()
        failed = a.isNull() != b.isNull()
        raw = a.isNull() & b.isNull() & ~old.eqNullSafe(new)
        return one | failed | raw | F.coalesce(a != b, F.lit(False))

    if col_type in ("integer", "float", "boolean", "date", "datetime"):  # equal text is equal as any type
        return ~old.eqNullSafe(new) & let(F.struct(typed(old, col_type).alias("a"), typed(new, col_type).alias("b")), of)
    return ~old.eqNullSafe(new)


def joined_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], types: dict[str, str]) -> DataFrame:
    """One full outer join on the token; class is added, removed, changed or unchanged, cells the unequal ones."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    left = with_token(a, keys, types).select("_token", F.struct(*[name_of(c) for c in a.columns]).alias("old"))
    right = with_token(b, keys, types).select("_token", F.struct(*[name_of(c) for c in b.columns]).alias("new"))
    both = left.join(right, "_token", "full_outer")
    cells = [
        F.struct(F.lit(c).alias("column"), F.col("old").getField(c).alias("old"), F.col("new").getField(c).alias("new"),
                 differs(F.col("old").getField(c), F.col("new").getField(c), types.get(c, "text")).alias("ne"))
        for c in shared
    ]
    unequal = F.filter(F.array(*cells), lambda x: x["ne"]) if cells else F.array()
    both = both.withColumn("cells", F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), unequal))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size("cells") > 0, "changed").otherwise("unchanged")
    return both.withColumn("class", kind)


def row_classes(joined: DataFrame) -> DataFrame:
    return joined.groupBy("class").agg(F.count("*").alias("n"))


def changed_cells(joined: DataFrame) -> DataFrame:
    """(token, column, old, new), one row per changed cell."""
    each = joined.filter(F.col("class") == "changed").select("_token", F.explode("cells").alias("c"))
    return each.select("_token", "c.column", "c.old", "c.new")


def changed_by_column(cells: DataFrame) -> DataFrame:
    """Changed rows per column."""
    return cells.groupBy("column").agg(F.count("*").alias("n"))


def row_samples(joined: DataFrame, kind: str, order: Sequence[str], n: int = 20) -> DataFrame:
    """The first n added or removed rows in the order of the key."""
    side = "new" if kind == "added" else "old"
    return joined.filter(F.col("class") == kind).select(f"{side}.*").orderBy(*[name_of(c) for c in order]).limit(n)


def category_drift(hist_a: DataFrame, hist_b: DataFrame, types_a: DataFrame, types_b: DataFrame) -> DataFrame:
    """Of shared columns that are categorical on either side, how many values are new and how many vanished."""
    kinds = types_a.select("column", F.col("col_type").alias("ta")).join(types_b.select("column", F.col("col_type").alias("tb")), "column")
    some = kinds.filter("ta = 'categorical' or tb = 'categorical'").select("column")
    side = lambda h, name: h.filter("value is not null").select("column", "value", F.lit(1).alias(name))
    both = side(hist_a, "old").join(side(hist_b, "new"), ["column", "value"], "full_outer").join(F.broadcast(some), "column", "left_semi")
    return both.groupBy("column").agg(F.count_if(F.col("old").isNull()).alias("new_values"), F.count_if(F.col("new").isNull()).alias("vanished_values"))


def number_drift(hist_a: DataFrame, hist_b: DataFrame, types_a: DataFrame, types_b: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Moves of mean and sample deviation of columns that are numeric on both sides; percent is 0 from mean 0."""
    numeric = lambda t: t.filter(F.col("col_type").isin("integer", "float")).select("column")
    some = numeric(types_a).join(numeric(types_b), "column", "left_semi")
    if suppressed is not None:
        some = some.join(suppressed.select("column").distinct(), "column", "left_anti")
    x, n = F.col("x"), F.col("n")

    def moments(hist: DataFrame, side: str) -> DataFrame:
        rows = hist.join(F.broadcast(some), "column", "left_semi").withColumn("x", as_float(F.col("value"))).filter("x is not null")
        mean = rows.groupBy("column").agg((F.sum(n * x) / F.sum(n)).alias("mean"))
        far = rows.join(F.broadcast(mean), "column").groupBy("column").agg(
            F.max("mean").alias(f"mean_{side}"), F.when(F.sum(n) > 1, F.sqrt(F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))) / (F.sum(n) - 1))).otherwise(0.0).alias(f"std_{side}")
        )
        return far

    both = moments(hist_a, "a").join(moments(hist_b, "b"), "column")
    delta = F.col("mean_b") - F.col("mean_a")
    return both.select(
        "column", delta.alias("mean_delta"), (F.col("std_b") - F.col("std_a")).alias("std_delta"),
        F.when(F.col("mean_a") == 0, 0.0).otherwise(100.0 * delta / F.abs(F.col("mean_a"))).alias("mean_pct_change"),
    )


def diff(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None) -> TableDiff:
    """Compare two tables of strings; without keys the first shared candidate is the key.

    Only schemas and the few rows about columns come to the driver. Duplicate key tokens on either side leave out
    the rows and say so.
    """
    hists = [staged(value_histogram(t), "histogram") for t in (a, b)]
    rates = [staged(parse_rates(h), "parse-rates") for h in hists]
    types = [column_types(r) for r in rates]
    if keys is not None:
        if not keys or len(set(keys)) < len(keys) or any(k not in a.columns or k not in b.columns for k in keys):
            raise ValueError("keys must be given, unique and in both tables")
        key = list(keys)
    else:
        found = shared_keys(candidate_keys(rates[0], hists[0]), candidate_keys(rates[1], hists[1])).orderBy("place").limit(1).collect()
        key = [r["column"] for r in found]
    pii = scan_histogram(hists[0]).filter(F.col("kind").isin(*SUPPRESSED))
    out = TableDiff(
        schema_changes(a, b), type_changes(*types), nullability_changes(*hists), category_drift(*hists, *types), number_drift(*hists, *types, pii), key
    )
    if not key:
        out.notes.append("no shared key: rows are not compared")
        return out
    by_name = {r["column"]: r["col_type"] for r in types[1].collect()}
    for side, table in (("old", a), ("new", b)):
        if duplicate_tokens(with_token(table, key, by_name)).limit(1).count():
            out.notes.append(f"the key repeats in the {side} table: rows are not compared")
            return out
    joined = staged(joined_rows(a, b, key, by_name).drop("old", "new"), "joined-rows")
    out.classes, out.cells = row_classes(joined), changed_cells(joined)
    return out
