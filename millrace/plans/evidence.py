"""Queries about network evidence (N) and the work log (E) over events and pages."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.staging import new_path
from millrace.operators import evidence, worklog
from millrace.plans.views import table
from millrace.streaming import evidence as streams

HOSTS = ("api.openai.com", "github.com", "raw.githubusercontent.com", "files.pythonhosted.org", "intranet.local", "localhost", "10.0.0.7", "mail.google.com")
IPS = ("104.18.7.1", "140.82.112.3", "185.199.108.1", "151.101.0.223", "192.168.1.9", "127.0.0.1", "10.0.0.7", "142.250.1.1")
#: What the test log's hosts are for, as a caller would say it: suffix, service, rank.
SERVICES = (("api.openai.com", "model endpoint", 1), ("github.com", "code review", 2), ("raw.githubusercontent.com", "code files", 3), ("mail.google.com", "mail", 4))
RULES = (
    ("deny-raw", 1, "deny", ["*.githubusercontent.com"], [], [], [], False),
    ("allow-git", 2, "allow", ["**.github.com", "**.githubusercontent.com"], [], [443], [], False),
    ("allow-net", 3, "allow", [], ["10.0.0.0/8", "142.250.0.0/16"], [], ["https"], True),
    ("allow-ai", 4, "allow", ["api.openai.com"], [], [443, 80], ["http", "https"], False),
    ("allow-local", 5, "allow", ["localhost"], [], [], [], False),
)
RULE_SCHEMA = "id string, rank int, action string, hosts array<string>, ips array<string>, ports array<int>, protocols array<string>, allow_private boolean"


def services(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERVICES, "suffix string, service string, rank int")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def _pick(pool: tuple, i) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (i % len(pool) + 1).cast("int"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a network log: user as session, event type as decision, value as bytes."""
    k = F.col("event_id")
    decision = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "purchase", "would_block").otherwise("allowed")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("session_id"), F.col("ts").alias("started_at"),
        F.when(k % 3 != 0, F.timestamp_add("SECOND", (k % 60).cast("int"), "ts")).alias("ended_at"),
        F.when(k % 4 == 0, "attach").otherwise("proxy").alias("source"), _pick(HOSTS, k).alias("host"), _pick(IPS, k).alias("ip"),
        F.when(k % 5 == 0, 80).otherwise(443).alias("port"), F.when(k % 5 == 0, "http").otherwise("https").alias("protocol"),
        F.concat(F.lit("/p"), (k % 7).cast("string")).alias("path"), decision.alias("decision"),
        F.floor(F.col("value") * 100).cast("bigint").alias("bytes_sent"), F.floor(F.col("value") * 10).cast("bigint").alias("bytes_received"),
        F.when(k % 6 != 0, F.concat(F.lit("f"), (k % 11).cast("string"))).alias("fingerprint"),
    )
    return evidence.identify_service(rows, "host", services(spark)).withColumn("scope", evidence.ip_scope(F.col("ip")))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("started_at"))
    agent = _pick(("codex", "cline", "aider"), F.col("session_id"))
    return by.select("session_id", "started_at", agent.alias("agent"), F.when(F.col("session_id") % 10 == 0, "running").otherwise("stopped").alias("status"))


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("event_id % 3 = 1")
    return rows.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").alias("occurred_at"), F.concat(F.lit("=t"), (F.col("event_id") % 4).cast("string")).alias("tool"))


def n1_normalize_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.concat(F.lit(" "), F.upper(F.regexp_extract("url", "://([^/:?#]+)", 1)), F.when(F.col("page_id") % 2 == 0, ".").otherwise(""), F.when(F.col("page_id") % 9 == 0, " x").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", evidence.normalize_host(host).alias("host"))


def n1_canonical_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages, one in three below a name beyond ASCII, and addresses in long forms."""
    k, host = F.col("page_id"), F.regexp_extract("url", "://([^/:?#]+)", 1)
    six = F.concat(F.lit("[2001:DB8:0:0:0:0:0:"), F.lower(F.hex(1 + k % 4000)), F.lit("]"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(k % 3 == 0, F.concat(host, F.lit(".B\u00dcCHER.example"))).when(k % 3 == 1, six).otherwise(host).alias("host"))
    return evidence.canonical_hosts(rows, "host")


def n2_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("event_id", "service")


def n3_ip_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    ip = F.concat_ws(".", k * 7 % 256, k * 13 % 256, k % 256, k * 3 % 256)
    return table(spark, sf_dir, "events").select("event_id", evidence.ip_scope(ip).alias("scope"))


def n4_sanitize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/a/"), _pick(("api_key", "plain", "0f8fad5b-d9cb-469f-a165-70867728950e", "abcdefgh12345678abcdefgh12", "x-token-y"), F.col("event_id")), F.lit("/"), F.col("event_type"), F.lit("?q=1#f"))
    return table(spark, sf_dir, "events").select("event_id", evidence.sanitize_path(path).alias("path"))


def n5_sanitize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace(F.regexp_replace("url", "^https?://", "HTTPS://user:pw@"), "^(HTTPS://[^/?#]+)", "$1:8443")
    return table(spark, sf_dir, "pages").select("page_id", evidence.sanitize_url(url).alias("url"))


def n6_tool_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = _pick(("WebFetch", "WebSearch", "Bash", "mcp__browser", "Read"), F.col("event_id"))
    payload = F.to_json(F.struct(tool.alias("tool_name"), F.col("event_id").cast("string").alias("tool_use_id"), F.create_map(F.lit("url"), F.lit("https://a.example/x?y=1")).alias("tool_input")))
    return table(spark, sf_dir, "events").select("event_id", evidence.sanitize_tool_event(payload).alias("e")).select("event_id", "e.event", "e.tool", "e.target", "e.correlation_id")


def n7_redact_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(evidence.redact_command(F.split("p_name", " ")), " ").alias("command"))


def n8_parse_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(_pick(("http://A.example", "b.example", "[::1]", "tcp://c.example:7/p", "d.example:99999", "e.example:8080"), F.col("event_id")))
    out = table(spark, sf_dir, "events").select("event_id", evidence.parse_destination(value).alias("d"))
    return out.select("event_id", "d.host", "d.port", "d.protocol")


def n9_host_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.host_matches(log(spark, sf_dir).select("host").distinct(), rules(spark))


def n10_network_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    ips = table(spark, sf_dir, "events").select(F.concat_ws(".", F.element_at(F.array(F.lit(10), F.lit(142), F.lit(8)), (k % 3 + 1).cast("int")), 248 + k % 5, k % 256, k % 100).alias("ip"))
    six = table(spark, sf_dir, "events").select(F.concat(F.lit("2001:DB8:"), F.hex(k % 16), F.lit("::"), F.hex(k % 100)).alias("ip"))
    more = spark.createDataFrame([("allow-v6", 6, "allow", [], ["2001:db8:a::/48"], [], [], False)], RULE_SCHEMA)
    return evidence.network_matches(ips.union(six), rules(spark).union(more))


def n11_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evaluate_policy(log(spark, sf_dir).select("event_id", "host", "ip", "port", "protocol"), rules(spark))


def n12_multi_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir).select("event_id", "host", F.array("ip", F.lit("142.250.9.9")).alias("ips"), "port", "protocol")
    return evidence.multi_address(rows, rules(spark))


def n13_session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals that its SQL has; n13_session_totals has all."""
    out = evidence.session_report(sessions(spark, sf_dir), log(spark, sf_dir), tools(spark, sf_dir))
    return out.drop("observed", "failed", "unsupported")


def _mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with every decision, and with scopes that are neither public nor private or unknown."""
    k = F.col("event_id")
    decision = F.when(k % 7 == 0, "observed").when(k % 7 == 1, "failed").when(k % 7 == 2, "unsupported").otherwise(F.col("decision"))
    scope = F.when(k % 11 == 1, "multicast").when(k % 11 == 2, "reserved").when(k % 11 == 3, "hostname").when(k % 11 != 4, F.col("scope"))
    return log(spark, sf_dir).withColumns({"decision": decision, "scope": scope})


def n13_session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.session_report(sessions(spark, sf_dir), _mixed_log(spark, sf_dir), tools(spark, sf_dir))


def n14_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.destination_rollup(log(spark, sf_dir)).withColumn("paths", F.array_join("paths", ","))


def n15_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The destinations and figures that its SQL has; n15_overview_parts has all."""
    out = evidence.overview(sessions(spark, sf_dir), log(spark, sf_dir), ("service", "host"))
    return out.select("agent", "source", "service", "host", "level", "events", "sessions", "bytes_sent")


def n15_overview_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.overview(sessions(spark, sf_dir), _mixed_log(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("agents", "sources")})


def n16_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    hooks = tools(spark, sf_dir).select("occurred_at", "tool", F.col("event_id").cast("string").alias("correlation_id"), F.lit("PreToolUse").alias("event"))
    return evidence.evidence_ledger(log(spark, sf_dir), hooks)


def n17_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = sessions(spark, sf_dir)
    kept, events = evidence.retain(every, log(spark, sf_dir), every.filter("session_id % 2 = 0"))
    return kept.select("session_id").join(events.groupBy("session_id").agg(F.count("*").alias("events")), "session_id")


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    opened = rows.select("event_id", F.lit("open").alias("phase"), F.col("started_at").alias("at"), F.lit("pending").alias("decision"), F.lit(None).cast("bigint").alias("bytes_sent"), F.col("host").alias("detail"))
    closed = rows.filter("ended_at is not null").select("event_id", F.lit("close").alias("phase"), F.col("ended_at").alias("at"), "decision", "bytes_sent", F.when(F.col("event_id") % 2 == 0, F.col("path")).alias("detail"))
    return opened.unionByName(closed)


def n18_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.merge_phases(_phases(spark, sf_dir))


def n19_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.dedupe(log(spark, sf_dir)).select("event_id", "session_id", "fingerprint")


def n20_live_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the stream over the events file to its end, upserts totals into the shared folder, and reads the current ones."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = events.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("started_at"), F.when(F.col("event_type") == "error", "blocked").otherwise("allowed").alias("decision"), F.floor(F.col("value") * 100).cast("bigint").alias("bytes_sent"))
    totals = streams.live_totals(rows, "1 day", "1 day").select(F.col("window.start").alias("day"), "session_id", "events", "allowed", "bytes_sent")
    return streams.run_to_files(totals, new_path(spark, "live"), ("day", "session_id"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.element_at(F.create_map(*[F.lit(x) for kv in {"signup": "win", "error": "blocker", "click": "note", "view": "next", "purchase": "decision"}.items() for x in kv]), F.col("event_type"))
    text = F.when(F.col("event_id") % 50 == 0, "  ").otherwise(F.concat(F.lit(" did "), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 70 == 1, "odd").otherwise(tag).alias("tag"), text.alias("text"))


def e1_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worklog.validate_entries(_entries(spark, sf_dir)).select("id", "text", "reason")


def e2_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir)
    week = rows.agg(F.min(worklog.iso_week(F.col("ts"))).alias("week")).first()["week"]
    return worklog.list_entries(rows, week, "note").select("id", worklog.iso_week(F.col("ts")).alias("week"))


def e3_weekly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = worklog.validate_entries(_entries(spark, sf_dir)).filter("reason is null")
    out = worklog.weekly_report(good)
    return out.select("week", F.col("monday").cast("string").alias("monday"), F.col("sunday").cast("string").alias("sunday"), "section", "tag", "entries", F.md5("markdown").alias("markdown_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        n1_normalize_host, n1_canonical_hosts, n2_services, n3_ip_scope, n4_sanitize_path, n5_sanitize_url, n6_tool_event, n7_redact_command, n8_parse_destination, n9_host_match,
        n10_network_match, n11_policy, n12_multi_address, n13_session_report, n13_session_totals, n14_destinations, n15_overview, n15_overview_parts, n16_ledger, n17_retention, n18_merge, n19_dedupe,
        n20_live_totals, e1_validate, e2_week, e3_weekly_report,
    )
}

_LIST = lambda pool: "[" + ", ".join(f"'{x}'" for x in pool) + "]"
LOG = f"""log AS (
  SELECT event_id, user_id AS session_id, ts AS started_at, CASE WHEN event_id % 3 <> 0 THEN ts + to_seconds(event_id % 60) END AS ended_at,
         CASE WHEN event_id % 4 = 0 THEN 'attach' ELSE 'proxy' END AS source, {_LIST(HOSTS)}[event_id % 8 + 1] AS host, {_LIST(IPS)}[event_id % 8 + 1] AS ip,
         CASE WHEN event_id % 5 = 0 THEN 80 ELSE 443 END AS port, CASE WHEN event_id % 5 = 0 THEN 'http' ELSE 'https' END AS protocol, '/p' || (event_id % 7) AS path,
         CASE event_type WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'would_block' ELSE 'allowed' END AS decision,
         floor(value * 100)::BIGINT AS bytes_sent, floor(value * 10)::BIGINT AS bytes_received, CASE WHEN event_id % 6 <> 0 THEN 'f' || (event_id % 11) END AS fingerprint,
         ['model endpoint', 'code review', 'code files', 'pythonhosted.org', 'intranet.local', 'Localhost', 'IP address', 'mail'][event_id % 8 + 1] AS service,
         ['public', 'public', 'public', 'public', 'private', 'loopback', 'private', 'public'][event_id % 8 + 1] AS scope
  FROM events
), sessions AS (
  SELECT user_id AS session_id, min(ts) AS started_at, ['codex', 'cline', 'aider'][user_id % 3 + 1] AS agent, CASE WHEN user_id % 10 = 0 THEN 'running' ELSE 'stopped' END AS status
  FROM events GROUP BY user_id
)"""
_JUDGED = f"""{LOG}, judged AS (SELECT *, CASE host
    WHEN 'raw.githubusercontent.com' THEN 'deny-raw'
    WHEN 'github.com' THEN CASE WHEN port = 443 THEN 'allow-git' END
    WHEN 'api.openai.com' THEN 'allow-ai' END AS named,
    CASE WHEN (ip LIKE '10.%' OR ip LIKE '142.250.%') AND protocol = 'https' THEN 'allow-net' END AS net FROM log)"""
_MIXED = f"""{LOG}, mixed AS (SELECT * REPLACE (
    CASE event_id % 7 WHEN 0 THEN 'observed' WHEN 1 THEN 'failed' WHEN 2 THEN 'unsupported' ELSE decision END AS decision,
    CASE event_id % 11 WHEN 1 THEN 'multicast' WHEN 2 THEN 'reserved' WHEN 3 THEN 'hostname' WHEN 4 THEN NULL ELSE scope END AS scope) FROM log)"""
_TOTALS = ", ".join(f"count(*) FILTER (WHERE decision = '{d}') AS {d}" for d in evidence.DECISIONS) + """,
    count(*) FILTER (WHERE scope = 'public') AS public, count(*) FILTER (WHERE scope IS DISTINCT FROM 'public') AS local_private,
    sum(bytes_sent)::BIGINT AS bytes_sent, sum(bytes_received)::BIGINT AS bytes_received, count(DISTINCT service) AS services"""
_WEEK = "strftime(ts, '%G-W%V')"
_TAG = "CASE WHEN event_id % 70 = 1 THEN 'odd' ELSE CASE event_type WHEN 'signup' THEN 'win' WHEN 'error' THEN 'blocker' WHEN 'click' THEN 'note' WHEN 'view' THEN 'next' WHEN 'purchase' THEN 'decision' END END"

SQL = {
    "n1_normalize_host": "SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN lower(regexp_extract(url, '://([^/:?#]+)', 1)) END AS host FROM pages",
    "n1_canonical_hosts": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN lower(regexp_extract(url, '://([^/:?#]+)', 1)) || '.xn--bcher-kva.example' WHEN 1 THEN '2001:db8::' || lower(hex(1 + page_id % 4000))
        ELSE lower(regexp_extract(url, '://([^/:?#]+)', 1)) END AS host FROM pages""",
    "n2_services": f"WITH {LOG} SELECT event_id, service FROM log",
    "n3_ip_scope": """WITH x AS (SELECT event_id, event_id * 7 % 256 AS a, event_id * 13 % 256 AS b, event_id % 256 AS c FROM events)
        SELECT event_id, CASE WHEN a = 127 THEN 'loopback' WHEN a = 169 AND b = 254 THEN 'link-local'
          WHEN a IN (0, 10) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 240 THEN 'private'
          WHEN a BETWEEN 224 AND 239 THEN 'multicast' ELSE 'public' END AS scope FROM x""",
    "n4_sanitize_path": "SELECT event_id, '/a/' || ['[redacted]/[redacted]', 'plain/' || event_type, '[redacted]/' || event_type, '[redacted]/' || event_type, '[redacted]/[redacted]'][event_id % 5 + 1] AS path FROM events",
    "n6_tool_event": "SELECT event_id, 'PreToolUse' AS event, ['WebFetch', 'WebSearch', 'Bash', 'mcp__browser', 'Read'][event_id % 5 + 1] AS tool, ['https://a.example/x', 'search query redacted', 'shell command redacted', 'https://a.example/x', 'tool input redacted'][event_id % 5 + 1] AS target, event_id::VARCHAR AS correlation_id FROM events",
    "n7_redact_command": "SELECT p_partkey, CASE WHEN len(string_split(p_name, ' ')) > 1 THEN string_split(p_name, ' ')[1] || ' [arguments redacted]' ELSE p_name END AS command FROM part",
    "n8_parse_destination": "SELECT event_id, ['a.example', 'b.example', '::1', 'c.example', NULL, 'e.example'][event_id % 6 + 1] AS host, [80, 443, 443, 7, NULL, 8080][event_id % 6 + 1] AS port, ['http', 'https', 'https', 'tcp', NULL, 'https'][event_id % 6 + 1] AS protocol FROM events",
    "n9_host_match": f"""WITH {LOG} SELECT DISTINCT host, rule FROM log JOIN (VALUES ('raw.githubusercontent.com', 'deny-raw'), ('raw.githubusercontent.com', 'allow-git'), ('github.com', 'allow-git'), ('api.openai.com', 'allow-ai'), ('localhost', 'allow-local')) r(h, rule) ON host = h""",
    "n10_network_match": "WITH x AS (SELECT [10, 142, 8][event_id % 3 + 1] AS a, 248 + event_id % 5 AS b, event_id % 256 AS c, event_id % 100 AS d FROM events) SELECT DISTINCT a || '.' || b || '.' || c || '.' || d AS ip, 'allow-net' AS rule FROM x WHERE a = 10 OR (a = 142 AND b = 250) UNION SELECT DISTINCT '2001:DB8:A::' || printf('%X', event_id % 100), 'allow-v6' FROM events WHERE event_id % 16 = 10",
    "n11_policy": f"""WITH {_JUDGED}, d AS (SELECT event_id, coalesce(named, net, CASE WHEN host = 'localhost' THEN 'allow-local' END) AS rule, scope, net FROM judged),
        r AS (SELECT event_id, CASE WHEN rule IS NOT NULL AND rule <> 'deny-raw' AND scope <> 'public' AND net IS NULL THEN NULL ELSE rule END AS rule_id,
          CASE WHEN rule IS NULL OR rule = 'deny-raw' OR (scope <> 'public' AND net IS NULL) THEN 'deny' ELSE 'allow' END AS action FROM d)
        SELECT *, CASE action WHEN 'allow' THEN 'allowed' ELSE 'would_block' END AS outcome FROM r""",
    "n12_multi_address": f"""WITH {_JUDGED}, a AS (
          SELECT event_id, named, host, protocol, scope, net IS NOT NULL AS net FROM judged
          UNION ALL SELECT event_id, named, host, protocol, 'public', protocol = 'https' FROM judged),
        j AS (SELECT event_id, CASE WHEN named = 'deny-raw' THEN 0 WHEN NOT (named IS NOT NULL OR net OR host = 'localhost') THEN 0 WHEN scope <> 'public' AND NOT net THEN 0 ELSE 1 END AS ok FROM a)
        SELECT event_id, CASE WHEN min(ok) = 0 THEN 'deny' ELSE 'allow' END AS action, CASE WHEN min(ok) = 0 THEN 'would_block' ELSE 'allowed' END AS outcome FROM j GROUP BY event_id""",
    "n13_session_report": f"""WITH {LOG} SELECT session_id, count(*) AS events, count(*) FILTER (WHERE decision = 'allowed') AS allowed, count(*) FILTER (WHERE decision = 'would_block') AS would_block,
        count(*) FILTER (WHERE decision = 'blocked') AS blocked, count(*) FILTER (WHERE scope = 'public') AS public, count(*) FILTER (WHERE scope IN ('loopback', 'private')) AS local_private,
        sum(bytes_sent)::BIGINT AS bytes_sent, sum(bytes_received)::BIGINT AS bytes_received, count(DISTINCT service) AS services, count(*) FILTER (WHERE event_id % 3 = 1) AS tool_events FROM log GROUP BY session_id""",
    "n13_session_totals": f"WITH {_MIXED} SELECT session_id, count(*) AS events, {_TOTALS}, count(*) FILTER (WHERE event_id % 3 = 1) AS tool_events FROM mixed GROUP BY session_id",
    "n14_destinations": f"""WITH {LOG} SELECT service, host, port, protocol, scope, count(*) AS events, {', '.join(f"count(*) FILTER (WHERE decision = '{d}') AS {d}" for d in evidence.DECISIONS)}, sum(bytes_sent)::BIGINT AS bytes_sent,
        sum(bytes_received)::BIGINT AS bytes_received, min(started_at) AS first_seen, max(coalesce(ended_at, started_at)) AS last_seen, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM log GROUP BY ALL""",
    "n15_overview": f"""WITH {LOG}, b AS (SELECT l.*, agent FROM log l JOIN sessions USING (session_id))
        SELECT agent, source, service, host, CASE WHEN grouping(agent) = 0 THEN 'agent' WHEN grouping(source) = 0 THEN 'source' WHEN grouping(host) = 0 THEN 'destination' ELSE 'total' END AS level,
          count(*) AS events, count(DISTINCT session_id) AS sessions, sum(bytes_sent)::BIGINT AS bytes_sent FROM b GROUP BY GROUPING SETS ((), (agent), (source), (service, host))""",
    "n15_overview_parts": f"""WITH {_MIXED}, b AS (SELECT l.*, agent, status FROM mixed l JOIN sessions USING (session_id))
        SELECT agent, source, service, host, port, protocol, scope, CASE WHEN grouping(agent) = 0 THEN 'agent' WHEN grouping(source) = 0 THEN 'source' WHEN grouping(host) = 0 THEN 'destination' ELSE 'total' END AS level,
          count(*) AS events, {_TOTALS}, count(DISTINCT session_id) AS sessions,
          CASE WHEN grouping(source) = 1 AND grouping(host) = 1 THEN count(DISTINCT session_id) FILTER (WHERE status = 'running') END AS running,
          string_agg(DISTINCT agent, ',' ORDER BY agent) AS agents, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
        FROM b GROUP BY GROUPING SETS ((), (agent), (source), (service, host, port, protocol, scope))""",
    "n16_ledger": f"""WITH {LOG} SELECT 'network_event' AS record_type, started_at::TIMESTAMP AS occurred_at, source, service, host, port, protocol, NULL::VARCHAR AS method, path, scope, decision, NULL::VARCHAR AS rule_id,
        bytes_sent, bytes_received, NULL::INT AS process_pid, NULL::VARCHAR AS process_name, NULL::VARCHAR AS tool, NULL::VARCHAR AS target, NULL::VARCHAR AS correlation_id, NULL::VARCHAR AS detail FROM log
        UNION ALL SELECT 'tool_event', ts::TIMESTAMP, 'agent-hook', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '''=t' || (event_id % 4), NULL, event_id::VARCHAR, 'PreToolUse'
        FROM events WHERE event_id % 3 = 1""",
    "n17_retention": f"WITH {LOG} SELECT session_id, count(*) AS events FROM log WHERE session_id % 2 <> 0 OR session_id % 10 = 0 GROUP BY session_id",
    "n18_merge": f"WITH {LOG} SELECT event_id, started_at, ended_at, CASE WHEN ended_at IS NULL THEN 'pending' ELSE decision END AS decision, CASE WHEN ended_at IS NOT NULL THEN bytes_sent END AS bytes_sent, CASE WHEN ended_at IS NOT NULL AND event_id % 2 = 0 THEN path ELSE host END AS detail FROM log",
    "n19_dedupe": f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, fingerprint ORDER BY started_at, event_id) AS k FROM log)
        SELECT event_id, session_id, fingerprint FROM r WHERE fingerprint IS NULL OR k = 1""",
    "n20_live_totals": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id AS session_id, count(*) AS events, count(*) FILTER (WHERE event_type <> 'error') AS allowed, sum(floor(value * 100)::BIGINT)::BIGINT AS bytes_sent FROM events GROUP BY ALL",
    "e1_validate": f"""SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN '' ELSE 'did ' || event_id END AS text,
        CASE WHEN event_id % 50 = 0 THEN 'empty' WHEN {_TAG} = 'odd' THEN 'bad_tag' END AS reason FROM events""",
    "e2_week": f"SELECT event_id AS id, {_WEEK} AS week FROM events WHERE {_WEEK} = (SELECT min({_WEEK}) FROM events) AND {_TAG} = 'note'",
    "e3_weekly_report": f"""WITH e AS (SELECT event_id AS id, ts, {_TAG} AS tag, 'did ' || event_id AS text FROM events WHERE event_id % 50 <> 0 AND event_id % 70 <> 1),
        w AS (SELECT DISTINCT strftime(ts, '%G-W%V') AS week, date_trunc('week', ts)::DATE AS monday FROM e),
        s AS (SELECT week, monday, unnest([0, 1, 2, 3, 4]) AS section, unnest(['win', 'blocker', 'decision', 'note', 'next']) AS tag FROM w),
        g AS (SELECT strftime(ts, '%G-W%V') AS week, tag, count(*) AS n, string_agg('- ' || text, chr(10) ORDER BY ts, id) AS md FROM e GROUP BY ALL)
        SELECT s.week, s.monday::VARCHAR AS monday, (s.monday + 6)::DATE::VARCHAR AS sunday, section, s.tag, coalesce(n, 0) AS entries, md5(coalesce(md, '_None_')) AS markdown_md5 FROM s LEFT JOIN g USING (week, tag)""",
}
