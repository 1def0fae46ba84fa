"""Queries about learned synthetic tables (M), from orders and customers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.staging import staged
from millrace.operators import synth
from millrace.operators.typing import parse_rates, value_histogram
from millrace.plans.privacy import CONTACTS, _contacts
from millrace.plans.tables import a
from millrace.plans.views import A_COLUMNS, ORDERS_A, histogram_sql, rates_sql, table


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_histogram(a(spark, sf_dir))


def m1_learn_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, null rate, uniqueness, and of the parameters those that the kind of the column uses."""
    kind = F.col("kind")
    own = lambda c, *kinds: F.when(kind.isin(*kinds), F.col(c)).alias(c)
    spec = synth.learn_spec(a(spark, sf_dir))
    values = spec.categories.groupBy("column").agg(F.count("*").alias("categories"), F.max("total").cast("bigint").alias("cells"))
    return spec.columns.join(values, "column", "left").select(
        "ordinal", "column", "kind", "null_rate", "unique", own("pattern", "id"), own("start", "id"), own("decimals", "integer", "float"), own("low", "date", "datetime"),
        own("high", "date", "datetime"), own("true_rate", "boolean"), F.when(kind.isin("integer", "float"), F.col("grid")[10]).alias("median"), "categories", "cells",
    )


def m2_sensitive_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.sensitive_kinds(value_histogram(_contacts(spark, sf_dir).select("email", "ssn", "ip", "secret", "segment")))


def m3_id_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.id_patterns(staged(value_histogram(a(spark, sf_dir).select("order_code", F.lpad("order_key", 9, "0").alias("padded"))), "histogram"))


def m4_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.category_weights(value_histogram(a(spark, sf_dir).select("status", "priority")))


def m5_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = synth.numeric_grids(value_histogram(a(spark, sf_dir).select("customer", "total")))
    return out.select("column", "decimals", F.posexplode("grid").alias("i", "q"))


def m6_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.temporal_ranges(value_histogram(a(spark, sf_dir).select("order_date", "seen_at")))


def m7_small_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.small_params(value_histogram(a(spark, sf_dir).select("even", "priority")))


def m8_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.uniqueness(parse_rates(_hist(spark, sf_dir)))


def _made(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = a(spark, sf_dir)
    rows = rows.select(*columns) if columns else rows
    return synth.generate(spark, synth.learn_spec(rows), rows.count(), 7)


def m9_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made orders, as many as there are real ones, all columns."""
    return _made(spark, sf_dir)


def m10_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "order_code")


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as strings: two columns of few categories and one of 280, whose shares differ."""
    key = F.col("l_orderkey") + F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("priority"), F.concat(F.lit("b"), F.least(key % 280, key % 283)).alias("bucket"))


def m11_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each category was made, beside how often it is real."""
    real = _buckets(spark, sf_dir)
    counts = lambda df, name: value_histogram(df).select("column", "value", F.col("n").alias(name))
    made = synth.generate(spark, synth.learn_spec(real), real.count(), 7)
    return counts(real, "n").join(counts(made, "made"), ["column", "value"], "left")


def m12_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "customer", "total")


def m13_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, "order_date", "seen_at", "even", "note")


def m14_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up personal data, as many rows as there are real ones."""
    real = _contacts(spark, sf_dir).select("email", "ssn", "ip", "secret")
    return synth.generate(spark, synth.learn_spec(real), real.count(), 3)


QUERIES = {
    f.__name__: f
    for f in (
        m1_learn_spec, m2_sensitive_kinds, m3_id_patterns, m4_weights, m5_grids, m6_ranges, m7_small_params, m8_uniqueness, m9_generate, m10_ids, m11_categories,
        m12_numbers, m13_moments, m14_personal,
    )
}

_KIND = "CASE \"column\" WHEN 'order_key' THEN 'integer' WHEN 'order_code' THEN 'id' WHEN 'customer' THEN 'integer' WHEN 'status' THEN 'categorical' WHEN 'total' THEN 'float' WHEN 'order_date' THEN 'date' WHEN 'seen_at' THEN 'datetime' WHEN 'priority' THEN 'categorical' WHEN 'even' THEN 'boolean' ELSE 'empty' END"
_WEIGHTS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, round(count(*)::DOUBLE / (SELECT count(*) FROM a), 2) AS weight FROM a GROUP BY {c}" for c in ("status", "priority"))
_GRID = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {d} AS decimals, {i} AS i, quantile_cont(x, {i / 20}) AS q FROM (SELECT {c}::DOUBLE AS x FROM a WHERE {c} IS NOT NULL)" for c, d in (("customer", 0), ("total", 2)) for i in range(21)
)

_KINDS = {"order_code": "id", "status": "categorical", "priority": "categorical", "customer": "integer", "total": "float", "order_date": "date", "seen_at": "datetime", "even": "boolean", "note": "empty"}


def _drawn(text: str) -> str:
    """The integer that a text decides."""
    return f"('0x' || md5({text})[1:13])::BIGINT"


def _u(column: str, what: str = "", seed: int = 7) -> str:
    return f"({_drawn(f"'{seed}/{column}/{what}/' || i")} / 4503599627370496.0::DOUBLE)"


def _value(column: str, view: str = "a") -> str:
    """SQL of the value of row i of a column."""
    kind = _KINDS.get(column, "categorical" if view == "buckets" else "integer")
    if kind == "empty":
        return f'NULL::VARCHAR AS "{column}"'
    if kind == "id":
        value = "'ORD-' || lpad(((SELECT min(o_orderkey) FROM orders) + i)::VARCHAR, 9, '0')"
    elif kind == "categorical":
        value = f"(SELECT list_last(list_filter(t, lambda c: c.low <= {_u(column)} * total)).value FROM cat_{column})"
    elif kind in ("integer", "float"):
        at = f"({_u(column)} * 20)"
        value = f"(SELECT q[floor({at})::INT + 1] + (q[floor({at})::INT + 2] - q[floor({at})::INT + 1]) * ({at} - floor({at})) FROM grid_{column})"
        value = f"printf('%.2f', {value})" if kind == "float" else f"round_even({value}, 0)::BIGINT::VARCHAR"
    elif kind in ("date", "datetime"):
        ends = [f"(SELECT epoch({f}({column})::TIMESTAMP)::BIGINT FROM a)" for f in ("min", "max")]
        value = f"strftime(make_timestamp(({ends[0]} + floor({_u(column)} * ({ends[1]} - {ends[0]} + 1))::BIGINT) * 1000000), '{'%Y-%m-%d' if kind == 'date' else '%Y-%m-%d %H:%M:%S'}')"
    else:
        value = f"CASE WHEN {_u(column)} < (SELECT round(avg(CASE WHEN {column} = 'yes' THEN 1 ELSE 0 END), 2) FROM a) THEN 'true' ELSE 'false' END"
    rate = f"(SELECT round(avg(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END), 2) FROM {view})"
    return f'CASE WHEN {_u(column, "null")} >= {rate} THEN {value} END AS "{column}"'


def _made_sql(*columns: str, view: str = "a") -> str:
    """CTEs that end in `made`, the rows made from a view."""
    parts = [f"rows AS MATERIALIZED (SELECT i FROM range((SELECT count(*) FROM {view})) t(i))"]
    for c in columns:
        kind = _KINDS.get(c, "categorical" if view == "buckets" else "integer")
        if kind == "categorical":
            parts.append(f"""cat_{c} AS MATERIALIZED (SELECT list({{'value': v, 'low': low}} ORDER BY low) AS t, max(total) AS total FROM (
                SELECT {c} AS v, (sum(count(*)) OVER (ORDER BY encode({c})) - count(*))::DOUBLE AS low, (sum(count(*)) OVER ())::DOUBLE AS total FROM {view} WHERE {c} IS NOT NULL GROUP BY {c}))""")
        elif kind in ("integer", "float"):
            parts.append(f"grid_{c} AS MATERIALIZED (SELECT quantile_cont({c}::DOUBLE, [{', '.join(str(i / 20) for i in range(21))}]) AS q FROM {view} WHERE {c} IS NOT NULL)")
    return ", ".join([*parts, f"made AS (SELECT {', '.join(_value(c, view) for c in columns)} FROM rows)"])


def _permuted(column: str, size: int, seed: int = 3) -> str:
    """CTEs that end in perm_<column>: (i, x), x the number below size of row i."""
    high, low = synth.factors(size)
    if high * low != size:
        raise ValueError("the SQL has no walk along a cycle")
    out = [f"{column}_0 AS (SELECT i, (i % {size}) // {low} AS h, i % {low} AS l FROM rows)"]
    for k in range(1, synth.ROUNDS + 1):
        out.append(f"{column}_{k}h AS (SELECT i, (h + {_drawn(f"'{seed}/{column}/high/{k}/' || l")}) % {high} AS h, l FROM {column}_{k - 1})")
        out.append(f"{column}_{k} AS (SELECT i, h, (l + {_drawn(f"'{seed}/{column}/low/{k}/' || h")}) % {low} AS l FROM {column}_{k}h)")
    return ", ".join([*out, f"perm_{column} AS (SELECT i, h * {low} + l AS x FROM {column}_{synth.ROUNDS})"])


_SOCIAL = synth.GROUPS * synth.SERIALS
_BUCKETS = "buckets AS (SELECT l_returnflag AS status, l_linestatus AS priority, 'b' || least((l_orderkey + l_partkey) % 280, (l_orderkey + l_partkey) % 283) AS bucket FROM lineitem)"
#: What every value of a column looks like makes it sensitive.
_LOOKS = {"email": r"[^@\s]+@[a-z0-9]+(\.[a-z]+)+", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ip": r"([0-9]{1,3}\.){3}[0-9]{1,3}", "secret": "AKIA[0-9A-Z]{16}"}
_SENSITIVE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS sensitive FROM contacts HAVING bool_and(regexp_full_match({c}, '{look}'))" for c in (*_LOOKS, "segment") for k, look in _LOOKS.items()
)

SQL = {
    "m1_learn_spec": f"""WITH {ORDERS_A}, {histogram_sql("a", A_COLUMNS)}, x AS (
        SELECT ordinal, "column", {_KIND} AS kind, round(coalesce(sum(n) FILTER (WHERE value IS NULL), 0)::DOUBLE / sum(n), 2) AS null_rate,
               count(value) AS values, (sum(n) FILTER (WHERE value IS NOT NULL))::BIGINT AS filled, min(value) AS low, max(value) AS high,
               round(coalesce(sum(n) FILTER (WHERE value = 'yes'), 0)::DOUBLE / sum(n), 2) AS truth FROM hist GROUP BY ordinal, "column")
        SELECT ordinal, "column", kind, null_rate, "column" = 'order_code' AS "unique", CASE kind WHEN 'id' THEN 'ORD-#########' END AS pattern,
               CASE kind WHEN 'id' THEN (SELECT min(o_orderkey) FROM orders) END AS start, CASE kind WHEN 'integer' THEN 0 WHEN 'float' THEN 2 END AS decimals,
               CASE kind WHEN 'date' THEN low || ' 00:00:00' WHEN 'datetime' THEN low END AS low, CASE kind WHEN 'date' THEN high || ' 00:00:00' WHEN 'datetime' THEN high END AS high,
               CASE kind WHEN 'boolean' THEN truth END AS true_rate,
               CASE "column" WHEN 'order_key' THEN (SELECT quantile_cont(order_key::DOUBLE, 0.5) FROM a) WHEN 'customer' THEN (SELECT quantile_cont(customer::DOUBLE, 0.5) FROM a)
                 WHEN 'total' THEN (SELECT quantile_cont(total::DOUBLE, 0.5) FROM a) END AS median,
               CASE kind WHEN 'categorical' THEN values END AS categories, CASE kind WHEN 'categorical' THEN filled END AS cells
        FROM x""",
    "m2_sensitive_kinds": f"WITH {CONTACTS} {_SENSITIVE}",
    "m3_id_patterns": "SELECT 'order_code' AS \"column\", 'ORD-#########' AS pattern, min(o_orderkey) AS start FROM orders UNION ALL SELECT 'padded', '#########', max(o_orderkey) + 1 FROM orders",
    "m4_weights": f"WITH {ORDERS_A} {_WEIGHTS}",
    "m5_grids": f"WITH {ORDERS_A} {_GRID}",
    "m6_ranges": f"WITH {ORDERS_A} SELECT 'order_date' AS \"column\", min(order_date) || ' 00:00:00' AS low, max(order_date) || ' 00:00:00' AS high FROM a UNION ALL SELECT 'seen_at', min(seen_at), max(seen_at) FROM a",
    "m7_small_params": f"""WITH {ORDERS_A} SELECT 'even' AS "column", round(avg(CASE WHEN even = 'yes' THEN 1 ELSE 0 END), 2) AS true_rate, 1 AS avg_words, 1 AS name_words FROM a
        UNION ALL SELECT 'priority', NULL, greatest(1, floor(avg(len(list_filter(string_split(priority, ' '), lambda w: w <> ''))) + 0.5))::INT, mode(len(list_filter(string_split(priority, ' '), lambda w: w <> '')))::INT FROM a""",
    "m8_uniqueness": f"""WITH {ORDERS_A}, {histogram_sql("a", A_COLUMNS)}, {rates_sql()} SELECT "column", filled > 0 AND "distinct" = filled AS "unique" FROM rates""",
    "m9_generate": f"WITH {ORDERS_A}, {_made_sql(*A_COLUMNS)} SELECT * FROM made",
    "m10_ids": "SELECT 'ORD-' || lpad(((SELECT min(o_orderkey) FROM orders) + i)::VARCHAR, 9, '0') AS order_code FROM range((SELECT count(*) FROM orders)) t(i)",
    "m11_categories": f"WITH {_BUCKETS}, {_made_sql('status', 'priority', 'bucket', view='buckets')}"
    + " UNION ALL ".join(
        f" SELECT '{c}' AS \"column\", r.v AS value, r.n, m.made FROM (SELECT {c} AS v, count(*) AS n FROM buckets GROUP BY {c}) r LEFT JOIN (SELECT {c} AS v, count(*) AS made FROM made GROUP BY {c}) m USING (v)"
        for c in ("status", "priority", "bucket")
    ),
    "m12_numbers": f"WITH {ORDERS_A}, {_made_sql('customer', 'total')} SELECT * FROM made",
    "m13_moments": f"WITH {ORDERS_A}, {_made_sql('order_date', 'seen_at', 'even', 'note')} SELECT * FROM made",
    "m14_personal": f"""WITH rows AS (SELECT i FROM range((SELECT count(*) FROM customer)) t(i)), {_permuted("email", 1 << 40)}, {_permuted("ssn", synth.AREAS * _SOCIAL)}, {_permuted("ip", 1 << 32)}, {_permuted("secret", 1 << 40)}
        SELECT 'u' || lpad(e.x::VARCHAR, 13, '0') || '@example.com' AS email,
               (100 + s.x // {_SOCIAL}) || '-' || lpad((1 + s.x // {synth.SERIALS} % {synth.GROUPS})::VARCHAR, 2, '0') || '-' || lpad((1 + s.x % {synth.SERIALS})::VARCHAR, 4, '0') AS ssn,
               (p.x // 16777216 % 256) || '.' || (p.x // 65536 % 256) || '.' || (p.x // 256 % 256) || '.' || (p.x % 256) AS ip, 'REDACTED_' || lpad(k.x::VARCHAR, 13, '0') AS secret
        FROM perm_email e JOIN perm_ssn s USING (i) JOIN perm_ip p USING (i) JOIN perm_secret k USING (i)""",
}
