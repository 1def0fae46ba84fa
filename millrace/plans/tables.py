"""Queries about tables of strings: sources (S), types (T), profiles (F) and differences (D)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.staging import new_path, staged
from millrace.operators import diff, profile, typing
from millrace.plans.views import A_COLUMNS, B_COLUMNS, ORDERS_A, ORDERS_B, X, histogram_sql, orders_a, orders_b, rates_sql, table, types_sql
from millrace.sources import tables as sources


def a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.normalize_nulls(orders_a(spark, sf_dir))


def b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.normalize_nulls(orders_b(spark, sf_dir))


def hist(rows: DataFrame) -> DataFrame:
    return typing.value_histogram(rows)


def kept_hist(rows: DataFrame) -> DataFrame:
    """The histogram as a table, for queries that read it more than once."""
    return staged(hist(rows), "histogram")


def types_of(counted: DataFrame) -> DataFrame:
    return typing.column_types(staged(typing.parse_rates(counted), "parse-rates"))


def rates(rows: DataFrame) -> DataFrame:
    return typing.parse_rates(hist(rows))


def types(rows: DataFrame) -> DataFrame:
    return typing.column_types(rates(rows))


def s4_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_custkey", F.struct("o_orderstatus").alias("state")).alias("o"))
    return sources.flatten_one_level(rows).toDF("o_orderkey", "o_custkey", "o_state")


def s5_normalize_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a(spark, sf_dir)


def s7_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_table(spark, f"{sf_dir}/part.parquet", "parquet").select("p_partkey", "p_name", "p_brand", "p_size")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 9 == 0, "N/A").otherwise(F.col("p_brand")).alias("p_brand"), "p_size")


def s1_read_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as comma-separated text into the shared folder, and read back."""
    path = new_path(spark, "parts-csv")
    sources.write_table(_parts(spark, sf_dir), path, "csv")
    return sources.read_table(spark, path, "csv")


def s2_read_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as arrays of at most 100 objects, a file each, and read back."""
    path = new_path(spark, "parts-json")
    some = _parts(spark, sf_dir).groupBy(F.floor(F.col("p_partkey") / 100)).agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_brand", "p_size"))).alias("value"))
    some.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return sources.read_table(spark, path, "json")


def s3_read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an object per line, and read back with what is nested flattened."""
    path = new_path(spark, "parts-jsonl")
    sources.write_table(_parts(spark, sf_dir).select("p_partkey", F.struct("p_name", "p_brand").alias("about"), F.array("p_size").alias("sizes")), path, "jsonl")
    return sources.read_table(spark, path, "jsonl").select("p_partkey", F.col("`about.p_name`").alias("p_name"), F.col("`about.p_brand`").alias("p_brand"), "sizes")


def s6_read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as lines, and read back: how often each line stands."""
    path = new_path(spark, "text-lines")
    table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return sources.read_lines(spark, path).groupBy(F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))


def s8_write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a spreadsheet would run and dates, written as tab-separated text and read as they stand there."""
    path = new_path(spark, "orders-tsv")
    dates = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    sources.write_table(_risky(spark, sf_dir).filter("o_orderkey % 10 <> 6").join(dates, "o_orderkey"), path, "tsv")
    return sources.read_delimited(spark, path, "\t")


def s8_write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the columns of orders as a report, read back as text."""
    path = new_path(spark, "report")
    counts = profile.null_and_distinct(hist(a(spark, sf_dir)))
    sources.write_report(counts.select(F.struct("row_count", "null_count").alias("rows"), "distinct_count", "column", F.lit(None).cast("string").alias("note")), path)
    return spark.read.text(path)


def _risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ["=", "+", "-", "@", "-1", " =", "\t", "x", "- ", "  -"])), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(lead, F.col("o_orderkey").cast("string")).alias("cell"))


def s9_formula_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.formula_safe(_risky(spark, sf_dir))


def s10_ledger_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.ledger_safe(_risky(spark, sf_dir))


def t1_value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist(a(spark, sf_dir))


def t2_parse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(a(spark, sf_dir))


def t3_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", typing.shape(F.concat_ws("/", "p_brand", "p_name")).alias("shape"))


def t4_is_id_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(a(spark, sf_dir)).select("column", F.coalesce(typing.is_id_like(), F.lit(False)).alias("id_like"))


def t5_infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types(a(spark, sf_dir))


def t6_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"order_key": "integer", "total": "float", "order_date": "date", "seen_at": "datetime", "even": "boolean", "status": "integer"}
    typed = typing.coerce(a(spark, sf_dir), kinds).select(*kinds)
    return typed.withColumn("order_date", F.col("order_date").cast("string")).withColumn("seen_at", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss"))


def t7_finite_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 != 0, F.when(F.col("o_orderkey") % 11 == 0, F.lit(1e300) * 1e10).otherwise(F.col("o_totalprice")))
    price = F.when(F.col("o_orderkey") % 13 == 0, F.lit(2.0**60)).otherwise(price)
    checked = table(spark, sf_dir, "orders").select("o_orderkey", typing.finite_number(price, 1000.0, 200000.0).alias("x"))
    return checked.select("o_orderkey", "x.value", "x.reason")


def f1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_counts(a(spark, sf_dir))


def f2_f3_nulls_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_and_distinct(hist(a(spark, sf_dir)))


def f4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_k(hist(a(spark, sf_dir)))


def f5_f6_numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_hist(a(spark, sf_dir))
    return profile.numeric_stats(rows, types_of(rows))


def f7_outlier_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_hist(_priced(spark, sf_dir))
    return profile.outlier_examples(rows, types_of(rows))


def f8_suppressed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_hist(a(spark, sf_dir))
    flagged = rows.select("column").filter("column = 'customer'").distinct()
    return profile.numeric_stats(rows, types_of(rows), flagged).select("column", "count", "outliers")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.when(F.col("l_orderkey") % 500 == 0, F.col("l_quantity") * 100).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(big.cast("decimal(15,2)").cast("string").alias("quantity"), F.col("l_returnflag").alias("flag"))


def f9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(a(spark, sf_dir))


def f9_profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of documents: their texts are wide, so no histogram holds them."""
    rows = profile.profile(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source"))
    return rows.select("ordinal", "column", "row_count", "null_count", "null_pct", "distinct_count", "distinct_pct", "col_type", "count", "min", "max", "mean")


def d1_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.schema_changes(a(spark, sf_dir), b(spark, sf_dir)).select("column", "change")


def d2_type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.type_changes(types(a(spark, sf_dir)), types(b(spark, sf_dir)))


def d3_nullability(spark: SparkSession, sf_dir: str) -> DataFrame:
    emptier = b(spark, sf_dir).withColumn("priority", F.when(F.col("order_key").cast("bigint") % 5 != 0, F.col("priority")))
    return diff.nullability_changes(hist(a(spark, sf_dir)), hist(emptier))


def _keys(rows: DataFrame) -> DataFrame:
    counted = kept_hist(rows)
    return diff.candidate_keys(typing.parse_rates(counted), counted)


def d4_candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(a(spark, sf_dir))


def d5_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.shared_keys(_keys(a(spark, sf_dir)), _keys(b(spark, sf_dir))).select("column", "place")


def d6_key_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diff.with_token(a(spark, sf_dir), ["customer", "total"], {"customer": "float", "total": "integer"})
    return rows.select("order_key", *[F.col(f"_token.k{i}.{f}").alias(f"{f}{i}") for i in (0, 1) for f in ("tag", "raw")], F.col("_token.k0.typed").cast("double").alias("typed0"))


def d7_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diff.with_token(b(spark, sf_dir), ["customer"], {"customer": "float"})
    return diff.duplicate_tokens(rows).select(F.col("_token.k0.typed").cast("double").alias("customer"), "n")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"order_code": "id_like", "customer": "float", "total": "float", "order_date": "date", "seen_at": "datetime", "even": "boolean"}
    return diff.joined_rows(a(spark, sf_dir), b(spark, sf_dir), ["order_key"], kinds | {"order_key": "integer"})


def d8_row_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.row_classes(_joined(spark, sf_dir))


def d9_changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changed_cells(_joined(spark, sf_dir)).select(F.col("_token.k0.typed").cast("bigint").alias("order_key"), "column", "old", "new")


def d10_changed_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changed_by_column(diff.changed_cells(_joined(spark, sf_dir)))


def d11_added_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.row_samples(_joined(spark, sf_dir), "added", ["order_code"]).select("order_code", "status", "total", "region")


def d12_category_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = kept_hist(a(spark, sf_dir)), kept_hist(b(spark, sf_dir))
    return diff.category_drift(left, right, types_of(left), types_of(right))


def d13_number_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = kept_hist(a(spark, sf_dir)), kept_hist(b(spark, sf_dir))
    return diff.number_drift(left, right, types_of(left), types_of(right))


def d14_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a difference holds, as (what, n): changes of columns, types, nulls, categories and means, classes
    of rows and changed cells."""
    found = diff.diff(a(spark, sf_dir), b(spark, sf_dir))
    said = lambda rows, n, *words: rows.select(F.concat_ws(" ", *[F.col(w) if w in rows.columns else F.lit(w) for w in words]).alias("what"), n.cast("bigint").alias("n"))
    one = F.lit(1)
    parts = [
        said(found.schema, one, "schema", "change", "column"), said(found.types, one, "type", "column", "old_type", "new_type"), said(found.nulls, one, "nulls", "column"),
        said(found.categories, F.col("new_values"), "new", "column"), said(found.categories, F.col("vanished_values"), "vanished", "column"),
        said(found.numbers, F.round("mean_delta"), "mean", "column"), said(found.classes, F.col("n"), "class"), said(diff.changed_by_column(found.cells), F.col("n"), "changed", "column"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("key", F.lit(",".join(found.key)))


QUERIES = {
    f.__name__: f
    for f in (
        s4_flatten, s5_normalize_nulls, s1_read_delimited, s2_read_json_records, s3_read_jsonl, s6_read_lines, s7_read_table, s8_write_table, s8_write_report, s9_formula_safe, s10_ledger_safe, t1_value_histogram, t2_parse_rates, t3_shape, t4_is_id_like,
        t5_infer_types, t6_coerce, t7_finite_number, f1_counts, f2_f3_nulls_distinct, f4_top_k, f5_f6_numeric_stats, f7_outlier_examples,
        f8_suppressed_stats, f9_profile, f9_profile_texts, d1_schema, d2_type_changes, d3_nullability, d4_candidate_keys, d5_shared_keys, d6_key_token, d7_duplicates,
        d8_row_classes, d9_changed_cells, d10_changed_by_column, d11_added_rows, d12_category_drift, d13_number_drift, d14_diff,
    )
}

_HIST_A = f"WITH {ORDERS_A}, {histogram_sql('a', A_COLUMNS)}"
_RATES_A = f"{_HIST_A}, {rates_sql()}"
_TYPES_A = f"{_RATES_A}, {types_sql()}"
_BOTH = (
    f"WITH {ORDERS_A}, {ORDERS_B}, {histogram_sql('a', A_COLUMNS, 'hist_a')}, {histogram_sql('b', B_COLUMNS, 'hist_b')}, "
    f"{rates_sql('hist_a', 'rates_a')}, {rates_sql('hist_b', 'rates_b')}, {types_sql('rates_a', 'types_a')}, {types_sql('rates_b', 'types_b')}"
)
_RISKY = r"""WITH r AS (SELECT o_orderkey, ['=', '+', '-', '@', '-1', ' =', E'\t', 'x', '- ', '  -'][o_orderkey % 10 + 1] || o_orderkey::VARCHAR AS cell FROM orders)"""
_NUMBERS = f"""numbers AS (SELECT h.ordinal, h."column", h.value, h.n, {X} AS x FROM hist h JOIN types t USING ("column") WHERE t.col_type IN ('integer', 'float') AND ({X}) IS NOT NULL),
each AS (SELECT ordinal, "column", value, x FROM numbers, range(n))"""
_STATS = f"""{_NUMBERS}, s AS (
  SELECT ordinal, "column", count(*) AS "count", min(x) AS "min", max(x) AS "max", avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std,
         quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.95) AS p95
  FROM each GROUP BY ordinal, "column"
), stats AS (
  SELECT s.*, (SELECT count(*) FROM each e WHERE e."column" = s."column" AND (e.x < s.q1 - 1.5 * (s.q3 - s.q1) OR e.x > s.q3 + 1.5 * (s.q3 - s.q1))) AS outliers FROM s
)"""
_KEYS = """SELECT r."column", r.ordinal, row_number() OVER (ORDER BY CASE WHEN t.col_type = 'id_like' THEN 0 ELSE 1 END, r.ordinal) AS place
  FROM {r} r JOIN {t} t USING ("column") WHERE filled > 0 AND "distinct" = filled AND NOT EXISTS (SELECT 1 FROM {h} h WHERE h."column" = r."column" AND h.value IS NULL)"""
_NULLS = """SELECT ordinal, "column", sum(n)::BIGINT AS row_count, coalesce(sum(n) FILTER (WHERE value IS NULL), 0)::BIGINT AS null_count,
  100.0 * coalesce(sum(n) FILTER (WHERE value IS NULL), 0) / sum(n) AS null_pct, count(value) AS distinct_count, 100.0 * count(value) / sum(n) AS distinct_pct
FROM {h} GROUP BY ordinal, "column" """
_JOINED = f"""WITH {ORDERS_A}, {ORDERS_B}, j AS (
  SELECT coalesce(a.order_key, b.order_key)::BIGINT AS order_key, a.order_key AS ka, b.order_key AS kb, b.order_code, b.region,
         a.status AS old_status, b.status AS new_status, a.total AS old_total, b.total AS new_total, a.customer AS old_customer, b.customer AS new_customer
  FROM a FULL JOIN b ON a.order_key::BIGINT = b.order_key::BIGINT
), cells AS (
  SELECT order_key, 'status' AS "column", old_status AS old, new_status AS new FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND old_status IS DISTINCT FROM new_status
  UNION ALL
  SELECT order_key, 'total', old_total, new_total FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND old_total::DOUBLE IS DISTINCT FROM new_total::DOUBLE
), classes AS (
  SELECT CASE WHEN ka IS NULL THEN 'added' WHEN kb IS NULL THEN 'removed' WHEN order_key IN (SELECT order_key FROM cells) THEN 'changed' ELSE 'unchanged' END AS class FROM j
)"""

_PARTS = "SELECT p_partkey::VARCHAR AS p_partkey, p_name, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS p_brand, p_size::VARCHAR AS p_size FROM part"

SQL = {
    "s4_flatten": "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, '{\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS o_state FROM orders",
    "s5_normalize_nulls": f"WITH {ORDERS_A} SELECT * FROM a",
    "s7_read_table": "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part",
    "s1_read_delimited": _PARTS,
    "s2_read_json_records": _PARTS,
    "s3_read_jsonl": f"SELECT p_partkey, p_name, p_brand, '[\"' || p_size || '\"]' AS sizes FROM ({_PARTS})",
    "s6_read_lines": "SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY 1",
    "s8_write_table": _RISKY + r""" SELECT r.o_orderkey::VARCHAR AS o_orderkey, CASE WHEN regexp_matches(cell, '^ *[=+@\t\r]')
        OR (ltrim(cell) LIKE '-%' AND NOT regexp_matches(ltrim(cell), '^-([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$')) THEN '''' || cell ELSE cell END AS cell, strftime(o_orderdate, '%Y-%m-%d') AS day
        FROM r JOIN orders o ON o.o_orderkey = r.o_orderkey WHERE r.o_orderkey % 10 <> 6""",
    "s8_write_report": f"""WITH {ORDERS_A}, {histogram_sql("a", A_COLUMNS)} SELECT '{{"column":"' || "column" || '","distinct_count":' || count(value) || ',"note":null,"rows":{{"null_count":'
        || coalesce(sum(n) FILTER (WHERE value IS NULL), 0)::BIGINT || ',"row_count":' || sum(n)::BIGINT || '}}}}' AS value FROM hist GROUP BY "column" """,
    "s9_formula_safe": _RISKY + r""" SELECT o_orderkey, CASE WHEN regexp_matches(cell, '^ *[=+@\t\r]')
        OR (ltrim(cell) LIKE '-%' AND NOT regexp_matches(ltrim(cell), '^-([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$')) THEN '''' || cell ELSE cell END AS cell FROM r""",
    "s10_ledger_safe": _RISKY + r""" SELECT o_orderkey, CASE WHEN regexp_matches(cell, '^([\t\r\n]|\s*[=+@-])') THEN '''' || cell ELSE cell END AS cell FROM r""",
    "t1_value_histogram": f"{_HIST_A} SELECT * FROM hist",
    "t2_parse_rates": f"{_RATES_A} SELECT * FROM rates",
    "t3_shape": "SELECT p_partkey, regexp_replace(regexp_replace(p_brand || '/' || p_name, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') AS shape FROM part",
    "t4_is_id_like": f"""{_RATES_A} SELECT "column", coalesce(filled >= 3 AND "distinct" = filled AND shapes = 1 AND regexp_matches(shape, '[^A]'), false) AS id_like FROM rates""",
    "t5_infer_types": f"{_TYPES_A} SELECT * FROM types",
    "t6_coerce": f"""WITH {ORDERS_A} SELECT order_key::BIGINT AS order_key, total::DOUBLE AS total, order_date, seen_at, even = 'yes' AS even, NULL::BIGINT AS status FROM a""",
    "t7_finite_number": """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 1152921504606846976.0::DOUBLE WHEN o_orderkey % 7 = 0 THEN NULL
          WHEN o_orderkey % 11 = 0 THEN 'inf'::DOUBLE ELSE o_totalprice END AS x FROM orders),
        c AS (SELECT o_orderkey, x, CASE WHEN x IS NULL THEN 'missing' WHEN isinf(x) THEN 'not_finite' WHEN x = floor(x) AND abs(x) > 9007199254740991 THEN 'too_large'
          WHEN x < 1000 THEN 'below_minimum' WHEN x > 200000 THEN 'above_maximum' END AS reason FROM p)
        SELECT o_orderkey, CASE WHEN reason IS NULL THEN x END AS value, reason FROM c""",
    "f1_counts": "SELECT count(*) AS row_count, 10::BIGINT AS column_count FROM orders",
    "f2_f3_nulls_distinct": f"{_HIST_A} {_NULLS.format(h='hist')}",
    "f4_top_k": f"""{_HIST_A}, r AS (SELECT ordinal, "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, value, n FROM hist WHERE value IS NOT NULL)
        SELECT * FROM r WHERE rank <= 10""",
    "f5_f6_numeric_stats": f"{_TYPES_A}, {_STATS} SELECT * FROM stats",
    "f7_outlier_examples": f"""WITH v AS (SELECT (CASE WHEN l_orderkey % 500 = 0 THEN l_quantity * 100 ELSE l_quantity END)::DECIMAL(15,2)::VARCHAR AS quantity, l_returnflag AS flag FROM lineitem),
        {histogram_sql("v", ("quantity", "flag"))}, {rates_sql()}, {types_sql()}, {_NUMBERS},
        q AS (SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM each GROUP BY "column"),
        f AS (SELECT n.ordinal, n."column", n.value, greatest(q1 - 1.5 * (q3 - q1) - x, x - q3 - 1.5 * (q3 - q1)) AS beyond FROM numbers n JOIN q USING ("column")),
        r AS (SELECT ordinal, "column", row_number() OVER (PARTITION BY "column" ORDER BY beyond DESC, value) AS rank, value FROM f WHERE beyond > 0)
        SELECT * FROM r WHERE rank <= 5""",
    "f8_suppressed_stats": f"""{_TYPES_A}, {_STATS} SELECT "column", "count", outliers FROM stats WHERE "column" <> 'customer'""",
    "f9_profile": f"""{_TYPES_A}, {_STATS}, nd AS ({_NULLS.format(h="hist")})
        SELECT nd.*, t.col_type, NULL::VARCHAR[] AS pii, s."count", s."min", s."max", s.mean, s.std, s.p5, s.q1, s.median, s.q3, s.p95, s.outliers
        FROM nd JOIN types t USING ("column") LEFT JOIN stats s USING ("column")""",
    "f9_profile_texts": " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count, 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS null_pct,
            count(DISTINCT {c}) AS distinct_count, 100.0::DOUBLE * count(DISTINCT {c}) / count(*) AS distinct_pct, '{kind}' AS col_type,
            {f"count({c}), min({c})::DOUBLE, max({c})::DOUBLE, avg({c})" if kind == "integer" else "NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"} FROM documents"""
        for i, (c, kind) in enumerate((("doc_id", "integer"), ("text", "text"), ("lang", "categorical"), ("source", "categorical")))
    ).replace("count(doc_id), min(doc_id)::DOUBLE, max(doc_id)::DOUBLE, avg(doc_id)", 'count(doc_id) AS "count", min(doc_id)::DOUBLE AS "min", max(doc_id)::DOUBLE AS "max", avg(doc_id) AS mean'),
    "d1_schema": "SELECT * FROM (VALUES ('note', 'removed'), ('region', 'added')) t(\"column\", change)",
    "d2_type_changes": f"""{_BOTH} SELECT x."column", x.col_type AS old_type, y.col_type AS new_type FROM types_a x JOIN types_b y USING ("column") WHERE x.col_type <> y.col_type""",
    "d3_nullability": f"""WITH {ORDERS_A}, {ORDERS_B}, c AS (SELECT * REPLACE (CASE WHEN order_key::BIGINT % 5 <> 0 THEN priority END AS priority) FROM b),
        {histogram_sql("a", A_COLUMNS, "hist_a")}, {histogram_sql("c", B_COLUMNS, "hist_b")}, na AS ({_NULLS.format(h="hist_a")}), nb AS ({_NULLS.format(h="hist_b")})
        SELECT na."column", na.null_pct AS old_null_pct, nb.null_pct AS new_null_pct FROM na JOIN nb USING ("column") WHERE abs(nb.null_pct - na.null_pct) > 5""",
    "d4_candidate_keys": f"{_BOTH} {_KEYS.format(r='rates_a', t='types_a', h='hist_a')}",
    "d5_shared_keys": f"""{_BOTH}, ka AS ({_KEYS.format(r="rates_a", t="types_a", h="hist_a")}), kb AS ({_KEYS.format(r="rates_b", t="types_b", h="hist_b")})
        SELECT ka."column", ka.place FROM ka WHERE ka."column" IN (SELECT "column" FROM kb)""",
    "d6_key_token": f"""WITH {ORDERS_A} SELECT order_key, 'typed' AS tag0, NULL::VARCHAR AS raw0, customer::DOUBLE AS typed0,
        CASE WHEN total IS NULL THEN 'missing' ELSE 'raw' END AS tag1, total AS raw1 FROM a""",
    "d7_duplicates": f"WITH {ORDERS_A}, {ORDERS_B} SELECT customer::DOUBLE AS customer, count(*) AS n FROM b GROUP BY customer::DOUBLE HAVING count(*) > 1",
    "d8_row_classes": f"{_JOINED} SELECT class, count(*) AS n FROM classes GROUP BY class",
    "d9_changed_cells": f"{_JOINED} SELECT * FROM cells",
    "d10_changed_by_column": f'{_JOINED} SELECT "column", count(*) AS n FROM cells GROUP BY "column"',
    "d11_added_rows": f"{_JOINED} SELECT order_code, new_status AS status, new_total AS total, region FROM j WHERE ka IS NULL ORDER BY order_code LIMIT 20",
    "d12_category_drift": f"""{_BOTH}, k AS (SELECT x."column" FROM types_a x JOIN types_b y USING ("column") WHERE 'categorical' IN (x.col_type, y.col_type))
        SELECT k."column", (SELECT count(*) FROM hist_b h WHERE h."column" = k."column" AND value IS NOT NULL AND value NOT IN (SELECT value FROM hist_a i WHERE i."column" = k."column" AND i.value IS NOT NULL)) AS new_values,
          (SELECT count(*) FROM hist_a h WHERE h."column" = k."column" AND value IS NOT NULL AND value NOT IN (SELECT value FROM hist_b i WHERE i."column" = k."column" AND i.value IS NOT NULL)) AS vanished_values
        FROM k""",
    "d13_number_drift": f"""WITH {ORDERS_A}, {ORDERS_B}, m AS (
        SELECT 'order_key' AS "column", (SELECT avg(order_key::DOUBLE) FROM a) AS ma, (SELECT avg(order_key::DOUBLE) FROM b) AS mb, (SELECT stddev_samp(order_key::DOUBLE) FROM a) AS sa, (SELECT stddev_samp(order_key::DOUBLE) FROM b) AS sb
        UNION ALL SELECT 'customer', (SELECT avg(customer::DOUBLE) FROM a), (SELECT avg(customer::DOUBLE) FROM b), (SELECT stddev_samp(customer::DOUBLE) FROM a), (SELECT stddev_samp(customer::DOUBLE) FROM b)
        UNION ALL SELECT 'total', (SELECT avg(total::DOUBLE) FROM a), (SELECT avg(total::DOUBLE) FROM b), (SELECT stddev_samp(total::DOUBLE) FROM a), (SELECT stddev_samp(total::DOUBLE) FROM b))
        SELECT "column", mb - ma AS mean_delta, sb - sa AS std_delta, 100 * (mb - ma) / abs(ma) AS mean_pct_change FROM m""",
    "d14_diff": f"""{_JOINED} SELECT class AS what, count(*) AS n, 'order_code' AS key FROM classes GROUP BY class
        UNION ALL SELECT 'changed ' || "column", count(*), 'order_code' FROM cells GROUP BY "column" """,
}
SQL["d14_diff"] += f"""UNION ALL SELECT 'schema ' || change || ' ' || "column", 1, 'order_code' FROM ({SQL["d1_schema"]})
    UNION ALL SELECT 'type ' || "column" || ' ' || old_type || ' ' || new_type, 1, 'order_code' FROM ({SQL["d2_type_changes"]})
    UNION ALL SELECT 'new ' || "column", new_values, 'order_code' FROM ({SQL["d12_category_drift"]}) UNION ALL SELECT 'vanished ' || "column", vanished_values, 'order_code' FROM ({SQL["d12_category_drift"]})
    UNION ALL SELECT 'mean ' || "column", round(mean_delta)::BIGINT, 'order_code' FROM ({SQL["d13_number_drift"]})"""  # fmt: skip
