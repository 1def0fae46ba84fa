"""Draws from large category tables, and permutations of row numbers."""

import collections

import pytest
from pyspark.sql import functions as F

from millrace.operators import synth

COLUMNS = "ordinal int, column string, kind string, null_rate double, unique boolean, pattern string, start long, grid array<double>, decimals int, low string, high string, true_rate double, avg_words int, name_words int"


def columns(spark, *names):
    return spark.createDataFrame([(i, c, "categorical", 0.0, False, *[None] * 9) for i, c in enumerate(names)], COLUMNS)


def weights(spark, rows):
    return synth.category_table(spark.createDataFrame(rows, "column string, value string, weight double"))


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_hundred_thousand_categories(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(synth, "BROADCAST", 0)
    ids = spark.range(100_000)
    big = ids.select(F.lit("big").alias("column"), F.format_string("v%06d", "id").alias("value"), F.when(F.col("id") == 77, 50_000.0).otherwise(0.5).alias("weight"))
    small = spark.createDataFrame([("small", "x", 1.0), ("small", "y", 3.0), ("small", "never", 0.0), ("small", "it's \"z\"", 4.0), ("small", None, 9.0)], "column string, value string, weight double")
    spec = synth.Specification(columns(spark, "big", "small"), synth.category_table(big.unionByName(small)))
    made = synth.generate(spark, spec, 40_000, 11)
    assert made.columns == ["big", "small"] and made.count() == 40_000
    hot = made.filter("big = 'v000077'").count()
    assert abs(hot / 40_000 - 0.5) < 0.02 and made.select("big").distinct().count() > 15_000
    shares = {r["small"]: r["count"] / 40_000 for r in made.groupBy("small").count().collect()}
    assert set(shares) == {"x", "y", "it's \"z\""} and all(abs(shares[v] - w) < 0.01 for v, w in (("x", 0.125), ("y", 0.375), ("it's \"z\"", 0.5)))
    again = synth.generate(spark, spec, 500, 11).collect()
    assert not collections.Counter(map(tuple, again)) - collections.Counter(map(tuple, made.collect()))


@pytest.mark.parametrize("inline", [4096, 1])
def test_draws_do_not_depend_on_the_route(spark, monkeypatch, inline):
    monkeypatch.setattr(synth, "INLINE", inline)
    monkeypatch.setattr(synth, "BLOCK", 7)
    table = weights(spark, [("c", f"v{i:03d}", float(i % 5)) for i in range(300)])
    made = synth.generate(spark, synth.Specification(columns(spark, "c"), table), 3000, 2)
    rows = sorted((r["low"], r["value"]) for r in table.collect())
    picked = spark.range(3000).select((synth.uniform(2, "c") * 600.0).alias("u")).collect()
    want = collections.Counter([v for low, v in rows if low <= r["u"]][-1] for r in picked)
    assert collections.Counter(r["c"] for r in made.collect()) == want and not any(v.endswith(("0", "5")) for v in want)


def test_weights_that_cannot_be_drawn_from(spark):
    for rows in ([("c", "x", 0.0), ("c", "y", 0.0)], [("c", "x", float("inf"))], [("other", "x", 1.0)], [("c", "x", -1.0), ("c", "y", 2.0)]):
        with pytest.raises(ValueError, match="c: "):
            synth.generate(spark, synth.Specification(columns(spark, "c"), weights(spark, rows)), 5)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10, 97, 1009, 4096, 10_007])
def test_permutations_of_any_domain(spark, size):
    found = [r[0] for r in spark.range(size).select(synth.permuted(5, "c", size).alias("x")).collect()]
    assert sorted(found) == list(range(size))
    if size > 1000:
        steps = collections.Counter((b - a) % size for a, b in zip(found, found[1:], strict=False))
        assert max(steps.values()) < 10
        other = [r[0] for r in spark.range(size).select(synth.permuted(6, "c", size).alias("x")).collect()]
        assert sum(a == b for a, b in zip(found, other, strict=True)) < 20
