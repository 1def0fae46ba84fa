"""Operator 9, mixing sources to target weights: nested hash thresholds found in histograms, no sort of rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.staging import broadcast_if_small, quoted, staged

#: The hash has 60 bits; each level of the histograms looks at 15 more of them.
HASH_BITS, LEVEL_BITS = 60, 15


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def hash60(key: Column, text: Column) -> Column:
    """The first 60 bits of an MD5 of the key as text and the text (null: empty), so that rows of one key differ."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(empty(key), F.lit(":"), F.md5(empty(text)))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """One row per source: its size, its target and _full, the whole passes over it that the target holds.

    Water filling: the sources that fill up first (cap over weight) are capped, and the rest share what is left by
    weight. Everything here has one row per source.
    """
    per = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    per = per.withColumn("_rank", F.row_number().over(by_name)).withColumn(
        "_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") - 1) % len(weights) + 1).cast("double")
    )
    per = per.withColumn("_cap", F.lit(float(repeats)) * F.col("source_size")).withColumn("_fill", F.col("_cap") / F.col("_weight"))
    filling = Window.orderBy("_fill", "_rank")
    before = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("_level", (budget - before) / after)
    level = F.min_by(F.when(F.col("_level") <= F.col("_fill"), F.col("_level")), F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_rank"))).over(Window.partitionBy())
    per = per.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_weight"), F.col("_cap"))))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return per.select("_source", "source_size", "target", full.cast("bigint").alias("_full"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds _hash and _edge to the targets: rows below _hash are taken once more, those at _hash where _edge says so.

    Each level sums sizes by source and the next 15 bits of the hash, only within the bucket that holds the
    boundary so far; four levels reach one hash value.
    """
    keys = ["_source", "source_size", "target", "_full"]
    state = targets.withColumns(
        {"_rest": F.col("target") - F.col("_full") * F.col("source_size"), "_base": F.lit(0.0), "_prefix": F.lit(0).cast("bigint")}
    )
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        own = state.withColumnRenamed("_source", "_of")
        inside = sized.filter("_size > 0").join(
            own, F.col("_of").eqNullSafe(F.col("_source")) & (F.shiftright("_h", shift + LEVEL_BITS) == F.col("_prefix"))
        )
        hist = inside.groupBy(*keys, "_rest", "_base", F.shiftright("_h", shift).alias("_bucket")).agg(F.sum("_size").cast("double").alias("_sum"))
        order = Window.partitionBy("_source").orderBy("_bucket")
        hist = hist.withColumn("_upto", F.col("_base") + F.sum("_sum").over(order))
        edge = F.struct((F.col("_upto") - F.col("_sum")).alias("base"), F.col("_bucket").alias("bucket"), F.col("_upto").alias("upto"))
        hist = hist.groupBy(*keys, "_rest").agg(F.min_by(edge, F.when(F.col("_upto") > F.col("_rest"), F.col("_bucket"))).alias("_e"))
        state = broadcast_if_small(
            staged(hist.filter("_e is not null").select(*keys, "_rest", F.col("_e.base").alias("_base"), F.col("_e.bucket").alias("_prefix"), F.col("_e.upto").alias("_upto")), "mix-level")
        )
    nearer = F.abs(F.col("_upto") - F.col("_rest")) < F.abs(F.col("_base") - F.col("_rest"))
    found = state.select(F.col("_source").alias("_of"), F.col("_prefix").alias("_hash"), nearer.alias("_edge"))
    return targets.join(found, F.col("_of").eqNullSafe(F.col("_source")), "left").drop("_of")


def mix(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    carry: Sequence[str] | None = None,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
) -> DataFrame:
    """The carried columns (default: all) of every row, with size, source_size, target, copies and taken.

    A row's size is its number of words (null text: 0). Sources in code point order, null last as a source of its
    own, get the weights in turn and share `share` times the size of all rows; no target exceeds `repeats` times its
    source, and the excess goes to the others by weight. A source takes every row as often as its target holds it
    whole, and once more the rows whose hash of id and text lies below a threshold; the row on the threshold is taken
    if that brings the sum nearer. Rows that share both are taken alike. copies is how often a row is
    taken, taken is copies times size. A source without words has target 0. An empty table gives an empty result.
    Carried columns with the name of a result column are replaced.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    columns = [c for c in (docs.columns if carry is None else carry) if c not in made]
    sized = staged(
        docs.select(F.struct(*map(quoted, columns)).alias("_in"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), hash60(F.col(id_col), F.col(text_col)).alias("_h")), "mix"
    )
    targets = broadcast_if_small(staged(source_targets(sized, weights, share, repeats), "mix-targets"))
    final = broadcast_if_small(staged(thresholds(sized, targets), "mix-thresholds")).withColumnRenamed("_source", "_of")
    more = F.coalesce((F.col("_h") < F.col("_hash")) | ((F.col("_h") == F.col("_hash")) & F.col("_edge")), F.lit(False))
    return (
        sized.join(final, F.col("_of").eqNullSafe(F.col("_source")))
        .withColumn("copies", F.col("_full") + more.cast("bigint"))
        .select("_in.*", F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))
    )
