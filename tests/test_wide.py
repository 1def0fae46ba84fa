"""Columns of wide, nearly unique text, lexicons of any size, and runs of sentences."""

import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import detect, profile, text, typing


def wide_table(spark):
    rows = [(str(i), f"text {i} " + "lorem ipsum " * 10 + ("mail me at a@b.org" if i % 2 else ""), ("x", None, "y")[i % 3]) for i in range(200)] + [("7", None, "x"), ("8", "text 0 " + "lorem ipsum " * 10, None)]
    return spark.createDataFrame(rows, "id string, body string, kind string")


def test_wide_columns_have_no_histogram(spark):
    df = wide_table(spark)
    assert typing.wide_columns(df) == ["body"] and typing.wide_columns(df.limit(0)) == [] and typing.wide_columns(df.select(F.lit(None).cast("string").alias("n"))) == []
    found = {r["column"]: r for r in profile.profile(df).collect()}
    body = found["body"]
    assert (body["ordinal"], body["row_count"], body["null_count"], body["distinct_count"], body["col_type"]) == (1, 202, 1, 200, "text")
    assert found["id"]["col_type"] == "integer" and found["kind"]["distinct_count"] == 2
    rough = {r["column"]: r["distinct_count"] for r in profile.profile(df, sketch=True).collect()}
    assert abs(rough["body"] - 200) <= 5 and rough["kind"] == 2
    plan = typing.wide_rates(typing.cells_of(df, ["body"]), sketch=True)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not any("value" in k for k in keys)


def test_samples_are_the_least_masks(spark):
    df = spark.createDataFrame([(f"user{i}@host{i % 7}.org",) for i in range(300)], "mail string")
    row = detect.scan_table(df).collect()[0]
    masks = sorted({"u***@h***.org"})[:3]
    assert row["samples"] == masks and row["confidence"] == 1.0


def brute_run(values):
    best = (0, 0)
    for i in range(len(values)):
        for j in range(i, len(values)):
            part = values[i : j + 1]
            if max(part) - min(part) <= max(3, 0.25 * sum(part) / len(part)) and len(part) > best[1]:
                best = (i, len(part))
    return best


def test_longest_run_equals_brute_force():
    rng = random.Random(2)
    for k in range(400):
        top = rng.choice([4, 12, 20, 60])
        values = [rng.randint(1, top) if rng.random() < 0.7 else rng.randint(top, top + 6) for _ in range(rng.randint(0, 30))]
        assert text.longest_run(values) == brute_run(values), values


@pytest.mark.parametrize("values", [[12] * 100_000, list(np.random.default_rng(0).integers(1, 40, 100_000)), [10, 11, 12, 9] * 25_000, list(range(1, 100_001))])
def test_longest_run_of_many_sentences(values):
    began = time.process_time()
    text.longest_run([int(v) for v in values])
    assert time.process_time() - began < 3


def test_lexicon_of_any_size(spark):
    words = ["in", "order", "to", "the", "fact", "that", "well-known", "it's", "deep", "dive", "a"]
    rng = random.Random(5)
    phrases = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"let's, be", "Deep Dive"}
    docs = [(i, "".join(rng.choice([*words, "In", "ORDER", "x"]) + rng.choice([" ", " ", " ", ", ", "\n", "  ", ". ", "-"]) for _ in range(60))) for i in range(30)] + [(90, None), (91, ""), (92, "LET'S, BE! let's, bee")]
    many = spark.range(50_000).select(F.lit("many").alias("signal"), F.format_string("order of %d", "id").alias("phrase"))
    table = spark.createDataFrame([("some", p) for p in phrases] * 2 + [("some", None)], "signal string, phrase string").unionByName(many)
    found = sorted((r["id"], r["start"], r["end"], r["phrase"]) for r in text.lexicon_hits(spark.createDataFrame(docs, "id int, text string"), "id", table).collect())
    pattern = re.compile(text.phrase_pattern(tuple(p.lower() for p in phrases)), re.ASCII)
    want = sorted((i, m.start(), m.end(), m[0].lower()) for i, t in docs for m in pattern.finditer(t or ""))
    assert found == want and len(found) > 50
    with pytest.raises(ValueError, match="begin and end"):
        text.lexicon_hits(spark.createDataFrame(docs, "id int, text string"), "id", spark.createDataFrame([("s", "(x")], "signal string, phrase string"))


def test_profile_of_texts_and_its_sql(spark):
    from millrace import registry

    folder = "/root/testdata/sf0.001"
    found = registry.queries()["f9_profile_texts"](spark, folder)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    cursor = db.execute(registry.oracle_sql()["f9_profile_texts"])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in found.collect())
