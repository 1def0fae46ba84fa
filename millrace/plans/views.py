"""Views that the queries and their SQL share: the test tables as tables of strings, in two versions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to tasks. A small file makes few of them, which much work on each row would then keep busy alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


A_COLUMNS = ("order_key", "order_code", "customer", "status", "total", "order_date", "seen_at", "priority", "even", "note")
B_COLUMNS = ("order_key", "order_code", "customer", "status", "total", "order_date", "seen_at", "priority", "even", "region")


def orders_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as strings, with 'N/A' cells, padded codes, dates, moments, flags and an empty column."""
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as order_key",
        "concat('ORD-', lpad(cast(o_orderkey as string), 9, '0')) as order_code",
        "cast(o_custkey as string) as customer",
        "o_orderstatus as status",
        "if(o_orderkey % 7 = 0, 'N/A', cast(cast(o_totalprice as decimal(15,2)) as string)) as total",
        "date_format(o_orderdate, 'yyyy-MM-dd') as order_date",
        "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') as seen_at",
        "o_orderpriority as priority",
        "if(o_orderkey % 2 = 0, 'yes', 'no') as even",
        "'' as note",
    )


def orders_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version: rows gone and new, some totals and states changed, customers written with a decimal."""
    a = orders_a(spark, sf_dir)
    key = F.col("order_key").cast("bigint")
    kept = a.filter(key % 37 != 0).union(
        a.filter(key % 41 == 0).withColumns(
            {"order_key": (key + 100000000).cast("string"), "order_code": F.concat(F.lit("ORD-"), F.lpad((key + 100000000).cast("string"), 9, "0"))}
        )
    )
    key = F.col("order_key").cast("bigint")
    return kept.select(
        "order_key",
        "order_code",
        F.concat("customer", F.lit(".0")).alias("customer"),
        F.when(key % 13 == 0, "X").otherwise(F.col("status")).alias("status"),
        F.when((key % 11 == 0) & (F.col("total") != "N/A"), (F.col("total").try_cast("decimal(15,2)") + F.lit(100).cast("decimal(15,2)")).cast("decimal(15,2)").cast("string")).otherwise(F.col("total")).alias("total"),
        "order_date",
        "seen_at",
        "priority",
        "even",
        F.when(key % 3 == 0, "EU").otherwise("US").alias("region"),
    )


ORDERS_A = """
raw_a AS (
  SELECT o_orderkey::VARCHAR AS order_key, 'ORD-' || lpad(o_orderkey::VARCHAR, 9, '0') AS order_code, o_custkey::VARCHAR AS customer,
         o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE o_totalprice::DECIMAL(15,2)::VARCHAR END AS total,
         strftime(o_orderdate, '%Y-%m-%d') AS order_date, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS seen_at,
         o_orderpriority AS priority, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS even, '' AS note
  FROM orders
), a AS (SELECT order_key, order_code, customer, status, CASE WHEN total <> 'N/A' THEN total END AS total, order_date, seen_at, priority, even,
                NULL::VARCHAR AS note FROM raw_a)"""
ORDERS_B = """
kept_b AS (
  SELECT * FROM raw_a WHERE order_key::BIGINT % 37 <> 0
  UNION ALL
  SELECT (order_key::BIGINT + 100000000)::VARCHAR, 'ORD-' || lpad((order_key::BIGINT + 100000000)::VARCHAR, 9, '0'), customer, status, total,
         order_date, seen_at, priority, even, note
  FROM raw_a WHERE order_key::BIGINT % 41 = 0
), b AS (
  SELECT order_key, order_code, customer || '.0' AS customer, CASE WHEN order_key::BIGINT % 13 = 0 THEN 'X' ELSE status END AS status,
         CASE WHEN total = 'N/A' THEN NULL WHEN order_key::BIGINT % 11 = 0 THEN (total::DECIMAL(15,2) + 100)::DECIMAL(15,2)::VARCHAR ELSE total END AS total,
         order_date, seen_at, priority, even, CASE WHEN order_key::BIGINT % 3 = 0 THEN 'EU' ELSE 'US' END AS region
  FROM kept_b
)"""


def histogram_sql(view: str, columns: tuple[str, ...], name: str = "hist") -> str:
    """CTE of the value histogram of a view."""
    parts = [f"SELECT {i} AS ordinal, '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {view} GROUP BY {c}" for i, c in enumerate(columns)]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


#: A number without its commas: something DuckDB casts, of number characters only, with any underscore inside.
_PLAIN = "replace(trim(value), ',', '')"
X = f"CASE WHEN NOT regexp_matches({_PLAIN}, '[^0-9._eE+-]|^_|_$|[^0-9]_|_[^0-9]') THEN try_cast(replace({_PLAIN}, '_', '') AS DOUBLE) END"
_DAY = r"regexp_matches(trim(value), '^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$') AND try_strptime(trim(value), ['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y']) IS NOT NULL"
_MOMENT = r"regexp_matches(trim(value), '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$') AND try_strptime(trim(value), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S']) IS NOT NULL"
_SHAPE = "regexp_replace(regexp_replace(value, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g')"


def rates_sql(hist: str = "hist", name: str = "rates") -> str:
    """CTE of the parse rates of a histogram."""
    rate = lambda good: f"coalesce(sum(n) FILTER (WHERE {good})::DOUBLE / sum(n) FILTER (WHERE value IS NOT NULL), 0)"
    return f"""{name} AS (
  SELECT ordinal, "column", coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0)::BIGINT AS filled, count(value) AS "distinct",
    coalesce({rate("lower(trim(value)) IN ('true', 'false', 'yes', 'no')")}, 0) AS boolean_rate,
    coalesce({rate("trim(value) IN ('0', '1')")}, 0) AS bit_rate,
    count(DISTINCT CASE WHEN trim(value) IN ('0', '1') THEN trim(value) END) AS bits,
    coalesce({rate("regexp_matches(trim(value), '^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)$')")}, 0) AS integer_rate,
    coalesce({rate(f"({X}) IS NOT NULL")}, 0) AS float_rate, coalesce({rate(_DAY)}, 0) AS date_rate, coalesce({rate(_MOMENT)}, 0) AS datetime_rate,
    count(DISTINCT {_SHAPE}) AS shapes, max({_SHAPE}) AS shape
  FROM {hist} GROUP BY ordinal, "column"
)"""


def types_sql(rates: str = "rates", name: str = "types") -> str:
    """CTE of the types of columns."""
    return f"""{name} AS (
  SELECT ordinal, "column", CASE WHEN filled = 0 THEN 'empty'
    WHEN boolean_rate >= 0.95 OR (bit_rate = 1 AND bits = 2) THEN 'boolean' WHEN integer_rate >= 0.95 THEN 'integer'
    WHEN float_rate >= 0.95 THEN 'float' WHEN date_rate >= 0.95 THEN 'date' WHEN datetime_rate >= 0.95 THEN 'datetime'
    WHEN filled >= 3 AND "distinct" = filled AND shapes = 1 AND regexp_matches(shape, '[^A]') THEN 'id_like'
    WHEN "distinct" <= 20 OR "distinct"::DOUBLE / filled <= 0.05 THEN 'categorical' ELSE 'text' END AS col_type
  FROM {rates}
)"""
