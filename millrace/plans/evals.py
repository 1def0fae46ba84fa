"""Queries about recorded evaluations and configurations (A) made from events and parts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import evals
from millrace.plans.views import dealt, table


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cases: the type is the suite, the id decides which kind of case it is."""
    k = F.col("event_id")
    expected = F.when(k % 7 == 0, None).when(k % 3 == 0, F.concat(F.lit('{"a": "'), (k % 5).cast("string"), F.lit('", "b": "x"}'))).otherwise(F.concat(F.lit("t"), (k % 4).cast("string")))
    actual = F.when(k % 11 == 0, None).when(k % 3 == 0, F.concat(F.lit('{"b": "x", "a": "'), (k % 2).cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit("say t"), (k % 8).cast("string")))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("suite_id"), k.alias("case_id"), F.when(k % 13 == 0, 0.5).alias("score"), expected.alias("expected"), actual.alias("actual"),
        F.when(k % 97 != 0, k * 37 % 1000).alias("latency_ms"), F.when(k % 89 != 0, F.round(F.col("value") / 1000, 6)).alias("cost"),
        F.when((k % 10 == 0), (k % 100) / 100).alias("pii_leakage_rate"), ((k % 130) / 100).alias("unsupported_claim_rate"),
    )


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    suites = table(spark, sf_dir, "events").select(F.col("event_type").alias("suite_id")).distinct()
    rows = [("minOverallScore", 0.2), ("minOverallScore", 0.4), ("maxP95LatencyMs", 990.0), ("maxP95LatencyMs", 940.0), ("maxCostUsdEstimate", 1e9)]
    return suites.select("suite_id", F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.lit(v).alias("value")) for g, v in rows])).alias("g")).select("suite_id", "g.*")


API_VERSION, KIND = "v1", "WorkloadSpec"


def specs(spark: SparkSession, sf_dir: str, version: int = 0) -> DataFrame:
    """Parts as workload documents: nested lists, nulls and empty values among them, every fault in some of them."""
    k = F.col("p_partkey")
    tools = F.array(
        F.struct(F.concat(F.lit("readPart"), (k % 3).cast("string")).alias("name"), F.array(F.lit("parts:read")).alias("scopes"), F.lit(False).alias("requiresApproval")),
        F.struct(F.when(k % 5 == 0, "deleteOrder").when(k % 5 == 1, "x*").otherwise("order.send").alias("name"), F.array(F.lit("orders:writes")).alias("scopes"), (k % 2 == 0).alias("requiresApproval")),
        F.struct(F.when(k % 8 == 0, "ｒｅａｄ").when(k % 8 == 1, "readPart0").when(k % 8 == 2, "no name!").when(k % 8 == 3, "").otherwise("grantAccess").alias("name"), F.array(F.lit("parts:draft")).alias("scopes"), F.lit(True).alias("requiresApproval")),
    )
    size = F.col("p_size") + F.when(k % 6 == 0, version).otherwise(0)
    schema = F.struct(F.struct(F.when(k % 10 != 3, "object").otherwise("list").alias("type")).alias("schema"))
    route = F.struct(F.when(k % 4 == 0, F.concat("p_brand", F.lit(f"v{version}"))).otherwise(F.col("p_brand")).alias("primary"), F.when(k % 9 != 0, "g").alias("gateway"))
    tests = F.struct(F.when(k % 11 != 0, F.array(F.lit("core"))).otherwise(F.array().cast("array<string>")).alias("requiredSuites"), F.when(k % 12 != 0, F.struct(F.when(k % 13 != 0, 0.5).alias("minOverallScore"))).alias("gates"))
    rules = F.struct(F.array(F.when(k % 14 != 0, "base").otherwise(" ")).alias("requiredPacks"), F.when(k % 15 != 0, "warn").otherwise("off").alias("enforcementMode"))
    places = F.array(F.struct(F.col("p_brand").alias("name"), F.array(k % 2, F.lit(version)).alias("shards")), F.lit(None))
    sources = F.when(k % 16 < 8, places).otherwise(F.array().cast("array<struct<name: string, shards: array<bigint>>>"))
    body = F.struct(
        F.lit("d").alias("description"), route.alias("modelRoute"), schema.alias("inputs"), F.when(k % 17 != 0, schema).alias("outputs"), tests.alias("evals"),
        rules.alias("policies"), F.struct(size.alias("limit"), sources.alias("sources"), F.when(k % 3 == 0, 7).alias("freshnessDays")).alias("retrieval"), tools.alias("tools"),
        F.struct(F.lit(False).alias("storeInputs"), F.when(k % 19 != 0, False).alias("storeOutputs")).alias("privacy"),
    )
    about = F.struct(F.col("p_name").alias("name"), F.lit("p").alias("project"), F.when(k % 20 != 0, "o").alias("owner"))
    doc = F.struct(F.when(k % 7 != 0, API_VERSION).alias("apiVersion"), F.lit(KIND).alias("kind"), about.alias("metadata"), body.alias("spec"))
    return dealt(table(spark, sf_dir, "part")).select(k.alias("spec_id"), F.to_json(doc, {"ignoreNullFields": "true"}).alias("document"))


def a1_score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.score_cases(cases(spark, sf_dir)).select("case_id", "score", "reason", "passed")


def a2_case_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.case_errors(cases(spark, sf_dir)).select("case_id", F.array_join("errors", ";").alias("errors"))


def a3_safety_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.safety_errors(cases(spark, sf_dir), "unsupported_claim_rate", True).select("case_id", "reason")


def a4_merge_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.merge_gates(gates(spark, sf_dir))


def a5_suite_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.suite_figures(evals.score_cases(cases(spark, sf_dir)))


def a6_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evals.verdicts(a5_suite_figures(spark, sf_dir), a4_merge_gates(spark, sf_dir))
    return out.select("suite_id", "passed", F.array_join("failed", ",").alias("failed"))


def a7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit('{ "b": '), F.col("p_size").cast("string"), F.lit(', "a": "'), F.col("p_brand"), F.lit('" }'))
    return table(spark, sf_dir, "part").select("p_partkey", evals.fingerprint(doc).alias("fingerprint"))


def a8_config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.config_diff(specs(spark, sf_dir), specs(spark, sf_dir, 1))


def a9_validate_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.validate_configs(specs(spark, sf_dir), API_VERSION, KIND).select("spec_id", F.array_join("errors", ";").alias("errors"))


def a10_parse_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.parse_tools(specs(spark, sf_dir)).select("spec_id", "pos", "name", "approval", "issue")


def a11_tool_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.tool_risk(evals.parse_tools(specs(spark, sf_dir)))


def a12_risk_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.risk_warnings(evals.parse_tools(specs(spark, sf_dir))).select("spec_id", "name", F.array_join("tokens", ",").alias("tokens"))


def a12_denied_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents whose list of denied tools stands in either place, or nowhere."""
    k = F.col("p_partkey")
    names = F.concat(F.lit('["shell", "'), F.col("p_brand"), F.lit('"]'))
    body = F.when(k % 3 == 0, F.concat(F.lit('{"tools": {"denied": '), names, F.lit("}}"))).when(k % 3 == 1, F.concat(F.lit('{"tools": [], "denied": '), names, F.lit("}"))).otherwise(F.lit('{"tools": []}'))
    rows = table(spark, sf_dir, "part").select(k.alias("spec_id"), F.concat(F.lit('{"spec": '), body, F.lit("}")).alias("document"))
    return evals.denied_tools(rows).select("spec_id", F.array_join("denied", ",").alias("denied"))


SCHEMA = {
    "required": ["c_name"],
    "additionalProperties": False,
    "properties": {
        "c_custkey": {"type": "integer", "maximum": 100},
        "c_name": {"type": "string", "minLength": 3},
        "c_mktsegment": {"enum": ["BUILDING", "MACHINERY"]},
        "c_acctbal": {"type": "number", "minimum": 0},
    },
}


def a13_validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.validate_records(table(spark, sf_dir, "customer"), SCHEMA).select("c_custkey", F.array_join("errors", ";").alias("errors"))


def a14_prompt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    refs = table(spark, sf_dir, "part").select(k.alias("spec_id"), F.col("p_brand").alias("ref"), (k % 3).cast("string").alias("version"))
    prompts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ref")).agg(F.max("p_name").alias("content")).filter("substring(ref, -1, 1) < '4'")
    return evals.prompt_fingerprints(refs, prompts)


QUERIES = {
    f.__name__: f
    for f in (
        a1_score_cases, a2_case_errors, a3_safety_errors, a4_merge_gates, a5_suite_figures, a6_verdicts, a7_fingerprint, a8_config_diff, a9_validate_configs,
        a10_parse_tools, a11_tool_risk, a12_risk_warnings, a12_denied_tools, a13_validate_records, a14_prompt_fingerprints,
    )
}

CASES = """cases AS (
  SELECT event_type AS suite_id, event_id AS case_id, event_id AS k, value, CASE WHEN event_id % 97 <> 0 THEN event_id * 37 % 1000 END AS latency_ms,
         CASE WHEN event_id % 89 <> 0 THEN round(value / 1000, 6) END AS cost, CASE WHEN event_id % 10 = 0 THEN (event_id % 100) / 100.0::DOUBLE END AS pii, (event_id % 130) / 100.0::DOUBLE AS claims
  FROM events
), scored AS (
  SELECT *, CASE WHEN k % 13 = 0 THEN 0.5::DOUBLE WHEN k % 11 = 0 OR k % 7 = 0 THEN 0.0 WHEN k % 3 = 0 THEN (CASE WHEN k % 5 = k % 2 THEN 1.0 ELSE 0.5 END)
         WHEN k % 4 = k % 8 THEN 1.0 ELSE 0.0 END AS score,
         CASE WHEN k % 13 = 0 THEN 'explicit score' WHEN k % 11 = 0 OR k % 7 = 0 THEN 'missing actual or expected value'
         WHEN k % 3 = 0 THEN (CASE WHEN k % 5 = k % 2 THEN 'actual matched expected' ELSE 'partial object match' END)
         WHEN k % 4 = k % 8 THEN 'actual contained expected text' ELSE 'actual did not match expected' END AS reason FROM cases
), figures AS (
  SELECT suite_id, count(*) AS cases, round(avg(score), 6) AS overall_score, round(sum(cost), 6) AS cost, quantile_disc(latency_ms, 0.95) AS p95_latency_ms,
         CASE WHEN count(pii) = count(*) THEN max(pii) END AS pii_leakage_rate, max(claims) AS unsupported_claim_rate FROM scored GROUP BY suite_id
)"""

SQL = {
    "a1_score_cases": f"WITH {CASES} SELECT case_id, score, reason, score >= 0.5 AS passed FROM scored",
    "a2_case_errors": """SELECT event_id AS case_id, concat_ws(';', CASE WHEN event_id % 97 = 0 THEN 'missing latency_ms' END, CASE WHEN event_id % 89 = 0 THEN 'missing cost' END,
        CASE WHEN event_id % 7 = 0 AND event_id % 13 <> 0 THEN 'no expected value or score' END) AS errors FROM events""",
    "a3_safety_errors": "SELECT event_id AS case_id, CASE WHEN event_id % 130 > 100 THEN 'above_maximum' END AS reason FROM events",
    "a4_merge_gates": "SELECT DISTINCT event_type AS suite_id, gate, g.value FROM events, (VALUES ('minOverallScore', 0.4::DOUBLE), ('maxP95LatencyMs', 940.0), ('maxCostUsdEstimate', 1e9)) g(gate, value)",
    "a5_suite_figures": f"WITH {CASES} SELECT * FROM figures",
    "a6_verdicts": f"""WITH {CASES}, f AS (SELECT suite_id, concat_ws(',', CASE WHEN overall_score < 0.4 THEN 'minOverallScore' END, CASE WHEN p95_latency_ms > 940 THEN 'maxP95LatencyMs' END) AS failed FROM figures)
        SELECT suite_id, failed = '' AS passed, failed FROM f""",
    "a7_fingerprint": """SELECT p_partkey, 'sha256:' || sha256('{"a":"' || p_brand || '","b":' || p_size || '}') AS fingerprint FROM part""",
    "a8_config_diff": """SELECT p_partkey AS spec_id, 'spec.modelRoute.primary' AS path, '"' || p_brand || 'v0"' AS old, '"' || p_brand || 'v1"' AS new, 'model' AS category FROM part WHERE p_partkey % 4 = 0
        UNION ALL SELECT p_partkey, 'spec.retrieval.limit', p_size::VARCHAR, (p_size + 1)::VARCHAR, 'retrieval' FROM part WHERE p_partkey % 6 = 0
        UNION ALL SELECT p_partkey, 'spec.retrieval.sources.0.shards.1', '0', '1', 'retrieval' FROM part WHERE p_partkey % 16 < 8""",
    "a9_validate_configs": """SELECT p_partkey AS spec_id, concat_ws(';', CASE WHEN k % 7 = 0 THEN 'apiVersion must be v1' END, CASE WHEN k % 20 = 0 THEN 'metadata.owner is required' END,
        CASE WHEN k % 10 = 3 THEN 'spec.inputs.schema.type must be object' END, CASE WHEN k % 17 = 0 THEN 'spec.outputs must be an object' WHEN k % 10 = 3 THEN 'spec.outputs.schema.type must be object' END,
        CASE WHEN k % 9 = 0 THEN 'spec.modelRoute.gateway is required' END, CASE WHEN k % 11 = 0 THEN 'spec.evals.requiredSuites must contain at least one suite' END,
        CASE WHEN k % 12 = 0 THEN 'spec.evals.gates is required' WHEN k % 13 = 0 THEN 'spec.evals.gates.minOverallScore is required' END,
        CASE WHEN k % 14 = 0 THEN 'spec.policies.requiredPacks must contain at least one pack' END, CASE WHEN k % 15 = 0 THEN 'spec.policies.enforcementMode must be block, warn, or monitor' END,
        CASE WHEN k % 5 = 1 THEN 'tools[1] wildcard' END,
        CASE k % 8 WHEN 0 THEN 'tools[2] ambiguous normalization' WHEN 1 THEN (CASE WHEN k % 3 = 0 THEN 'tools[2] repeated name' END) WHEN 2 THEN 'tools[2] bad name' WHEN 3 THEN 'tools[2] missing name' END,
        CASE WHEN k % 16 < 8 AND k % 3 <> 0 THEN 'spec.retrieval.freshnessDays is required when retrieval sources are configured' END,
        CASE WHEN k % 19 = 0 THEN 'spec.privacy.storeOutputs must be a boolean' END) AS errors FROM (SELECT p_partkey, p_partkey AS k FROM part)""",
    "a10_parse_tools": """SELECT p_partkey AS spec_id, 0 AS pos, 'readPart' || (p_partkey % 3) AS name, false AS approval, NULL AS issue FROM part
        UNION ALL SELECT p_partkey, 1, CASE p_partkey % 5 WHEN 0 THEN 'deleteOrder' WHEN 1 THEN 'x*' ELSE 'order.send' END, p_partkey % 2 = 0, CASE WHEN p_partkey % 5 = 1 THEN 'wildcard' END FROM part
        UNION ALL SELECT p_partkey, 2, CASE p_partkey % 8 WHEN 0 THEN 'ｒｅａｄ' WHEN 1 THEN 'readPart0' WHEN 2 THEN 'no name!' WHEN 3 THEN '' ELSE 'grantAccess' END, true,
          CASE p_partkey % 8 WHEN 0 THEN 'ambiguous normalization' WHEN 1 THEN (CASE WHEN p_partkey % 3 = 0 THEN 'repeated name' END) WHEN 2 THEN 'bad name' WHEN 3 THEN 'missing name' END FROM part""",
    "a11_tool_risk": """SELECT DISTINCT i AS identifier, t AS token FROM part, (VALUES (5, 0, 'deleteOrder', 'delete'), (5, 2, 'order.send', 'send'), (5, 0, 'orders:writes', 'write'), (8, 5, 'grantAccess', 'grant')) v(d, m, i, t)
        WHERE p_partkey % d = m""",
    "a12_risk_warnings": """SELECT p_partkey AS spec_id, CASE p_partkey % 5 WHEN 0 THEN 'deleteOrder' WHEN 1 THEN 'x*' ELSE 'order.send' END AS name,
        CASE p_partkey % 5 WHEN 0 THEN 'delete,write' WHEN 1 THEN 'write' ELSE 'send,write' END AS tokens FROM part WHERE p_partkey % 2 = 1""",
    "a12_denied_tools": "SELECT p_partkey AS spec_id, CASE WHEN p_partkey % 3 < 2 THEN 'shell,' || p_brand ELSE '' END AS denied FROM part",
    "a13_validate_records": """SELECT c_custkey, concat_ws(';', CASE WHEN c_custkey > 100 THEN 'c_custkey: maximum' END, CASE WHEN length(c_name) < 3 THEN 'c_name: minLength' END,
        CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment: enum' END, CASE WHEN c_acctbal < 0 THEN 'c_acctbal: minimum' END, 'c_nationkey: additionalProperties') AS errors FROM customer""",
    "a14_prompt_fingerprints": """SELECT p_partkey AS spec_id, p_brand AS ref, (p_partkey % 3)::VARCHAR AS version, 'sha256:' || sha256(CASE WHEN right(p_brand, 1) < '4' THEN max(p_name) OVER (PARTITION BY p_brand)
        ELSE p_brand || '@' || (p_partkey % 3) END) AS fingerprint FROM part""",
}
