"""Whole jobs: small rows of our own, and queries against their SQL."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from millrace import registry
from millrace.operators import detect, evals, evidence, scrub, synth, text, typing
from millrace.plans import privacy
from millrace.plans.evals import specs
from millrace.sources import tables
from millrace.streaming import evidence as streams
from tests.test_registry import FOLDER
from tests.test_registry import test_query_and_sql_agree as agree


@pytest.mark.parametrize("name", ("n13_session_report", "n13_session_totals", "n15_overview", "n15_overview_parts"))
def test_queries_agree(spark, name):
    agree(spark, name)


def test_totals_of_sessions(spark):
    sessions = spark.createDataFrame([(1, "a", "running"), (2, "b", "stopped"), (3, "b", "starting")], "session_id long, agent string, status string")
    decisions = (*evidence.DECISIONS, "allowed")
    scopes = ("public", "multicast", "reserved", "hostname", None, "unresolved", "private")
    rows = [(i, 1 + i % 2, "proxy" if i else "attach", "s", "h", 80 + i % 2, "http", s, d, 10, 1) for i, (s, d) in enumerate(zip(scopes, decisions, strict=True))]
    events = spark.createDataFrame(rows, "event_id long, session_id long, source string, service string, host string, port int, protocol string, scope string, decision string, bytes_sent long, bytes_received long")
    tools = spark.createDataFrame([(1,)], "session_id long")
    report = {r["session_id"]: r.asDict() for r in evidence.session_report(sessions, events, tools).collect()}
    assert len(report[1]) == 14 and sum(report[1][d] for d in evidence.DECISIONS) == report[1]["events"] == 4
    assert (report[1]["public"], report[1]["local_private"], report[2]["local_private"], report[3]["events"]) == (1, 3, 3, 0)
    found = evidence.overview(sessions, events).collect()
    total = next(r for r in found if r["level"] == "total")
    assert (total["events"], total["sessions"], total["running"], total["services"], total["local_private"], total["agents"]) == (7, 3, 2, 1, 6, ["a", "b"])
    assert [total[d] for d in evidence.DECISIONS] == [2, 1, 1, 1, 1, 1]
    places = [r for r in found if r["level"] == "destination"]
    assert len(places) == 7 and next(r for r in places if r["scope"] == "public")["sources"] == ["attach"] and next(r for r in places if r["scope"] is None)["agents"] == ["a"]
    assert sorted((r["agent"], r["running"]) for r in found if r["level"] == "agent") == [("a", 1), ("b", 1)]


@pytest.mark.parametrize("name", ("a11_tool_risk", "a12_risk_warnings", "a13_validate_records"))
def test_evals_agree(spark, name):
    agree(spark, name)


def test_tool_risk(spark):
    want = {
        "dropTable": ["drop"], "table.dropped": ["drop"], "dropping_all": ["drop"], "transferring": ["transfer"], "invoice.paid": ["pay"], "fileWritten": ["write"],
        "mailSent": ["sent"], "forcedelete": ["delete"], "del_ete": ["delete"], "d.e.l.e.t.e": ["delete"], "DBDROP": ["drop"], "orders:writes": ["write"], "execute": ["execute"],
        "rewriteAll": ["write"], "refunds.create": ["create", "refund"], "writer.publish": ["publish"], "wipe_disk": ["wipe"], "destroyCluster": ["destroy"], "grant_admin": ["admin", "grant"],
        "runCommand": ["run"], "submit_form": ["submit"], "publishPost": ["publish"], "purge": ["purge"], "user.modified": ["modify"], "patches": ["patch"], "list.delete": ["delete"],
        "list.refunds": [], "writer.read": [], "writer.readAndDelete": ["delete"], "readPayload": [], "consent.get": [], "represented": [], "dropdown": [], "sender": [],
        "readUserUpdatedAt": [], "payments.list": [], "executor": [], "": [], "--": [],
    }
    tools = spark.createDataFrame([("s", n, [], False) for n in want], "spec_id string, name string, scopes array<string>, approval boolean")
    found = {n: [] for n in want}
    for r in evals.tool_risk(tools, words=("dropdown", "endpoint")).collect():
        found[r["identifier"]].append(r["token"])
    assert {n: sorted(t) for n, t in found.items()} == want
    assert {r["name"] for r in evals.risk_warnings(tools, words=("dropdown",)).collect()} == {n for n, t in want.items() if t}
    scopes = ["notes:write_internal", "notes.draft", "runs:draft", "write_internal", "a:b:c", "notes/write_internal", "parts:read", None]
    rows = spark.createDataFrame([("s", None, scopes, False)], "spec_id string, name string, scopes array<string>, approval boolean")
    assert sorted((r["identifier"], r["token"]) for r in evals.tool_risk(rows).collect()) == [("notes/write_internal", "write"), ("runs:draft", "run"), ("write_internal", "write")]
    assert sorted(r["identifier"] for r in evals.ambiguous_scopes(rows).collect()) == ["a:b:c"]


def test_leaves_of_documents(spark):
    docs = ['{"a": {"b": [1, {"c": null}], "e": {}}, "f": []}', '[true, "x", [[2.50]]]', "7", "nonsense", None, '{"a.b": 1}']
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    found = sorted((r["id"], r["path"], r["v"]) for r in evals.leaves(rows, "id", "doc", "v").collect())
    assert found == [(0, "a.b.0", "1"), (0, "a.b.1.c", "null"), (0, "a.e", "{}"), (0, "f", "[]"), (1, "0", "true"), (1, "1", '"x"'), (1, "2.0.0", "2.5"), (2, "", "7"), (5, "a.b", "1")]
    left, right = rows.filter("id < 2"), rows.filter("id < 2").withColumn("doc", F.regexp_replace("doc", "null", "0"))
    got = evals.config_diff(left, right, "id", "doc")
    assert [tuple(r) for r in got.collect()] == [(0, "a.b.1.c", "null", "0", "config")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert evals.leaves(rows.limit(0), "id", "doc", "v").count() == 0


def test_documents_that_are_no_objects(spark):
    rows = spark.createDataFrame([(1, "[]"), (2, None), (3, '{"spec": {"tools": {"allowed": [1, {"name": 5}, {"name": "a", "scopes": "x"}, {"name": "b", "requiresApproval": "yes"}, {"name": "c", "scopes": ["d*", null]}, {"name": "a"}, {"name": "a"}]}}}')], "spec_id int, document string")
    tools = [(r["pos"], r["name"], r["issue"]) for r in evals.parse_tools(rows).orderBy("pos").collect()]
    assert tools == [
        (0, None, "no object"), (1, None, "missing name"), (2, "a", "scopes must be a list"), (3, "b", "approval must be a boolean"), (4, "c", "wildcard"), (5, "a", None), (6, "a", "repeated name"),
    ]
    errors = {r["spec_id"]: r["errors"] for r in evals.validate_configs(rows, "v1", "K").collect()}
    assert errors[1] == errors[2] and len(errors[1]) == 14 and errors[1][0] == "apiVersion must be v1"
    assert [e for e in errors[3] if e.startswith("tools")][0] == "tools[0] no object" and len([e for e in errors[3] if e.startswith("tools")]) == 6


def test_items_and_tool_ids(spark):
    rows = spark.createDataFrame([(["ab", "", None, "a b"], "a.b:c/d"), ([], "a\u2028"), (None, None)], "tags array<string>, tool string")
    schema = {"properties": {"tags": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 1, "pattern": evals.TOOL_ID}}, "tool": {"type": "string", "pattern": evals.TOOL_ID}}}
    found = [r["errors"] for r in evals.validate_records(rows, schema).collect()]
    assert found == [["tags[1]: minLength", "tags[1]: pattern", "tags[2]: type", "tags[3]: pattern"], ["tags: minItems", "tool: pattern"], []]


def test_triads_of_bullets(spark):
    docs = spark.createDataFrame([(1, "Look:\n- one\n* two\n  + three\nend"), (2, "- one\n- two\nend"), (3, "Red, blue, and green."), (4, "- a, b, and c\n- d\n- e")], "id long, text string")
    hits = {r["id"]: (r["hits"], r["severity"]) for r in text.analyze(docs, "id", signals={"uniform_structure": text.uniform_structure}).collect()}
    assert hits == {1: (1, "notice"), 2: (0, "info"), 3: (1, "notice"), 4: (1, "notice")}
    found = {r["id"]: r["excerpt"] for r in text.evidence(docs, "id").filter("signal = 'uniform_structure'").collect()}
    assert found == {1: "- one\n* two\n  + three", 3: "Red, blue, and green", 4: "- a, b, and c\n- d\n- e"}


def test_suggestions(spark):
    said = (
        "In the age of data, we wait. It's not just fast, but it's cheap. The result: more noise. It grew, highlighting the need for care in every single part. Experts say so 😀 every day.\n\n"
        "`Not this. Not that. No more.` Some words stand here in between. Fine. No rest for anyone here. Not a single day of it. Never again in any year. Why would anyone ask this?\n\nIn conclusion, let that sink in for a while."
    )
    docs = spark.createDataFrame([(1, said), (2, "One two three four five. " * 6), (3, None)], "id long, text string")
    rows = text.suggestions(docs, "id").collect()
    assert all(said[r["start"] : r["end"]] == r["value"] for r in rows if r["id"] == 1)
    kinds = {v: k for k, v in text.JUDGED.items()}
    found = {kinds[r["advice"]]: r["value"] for r in sorted(rows, key=lambda r: -r["id"]) if r["advice"] in kinds}
    assert set(found) == set(text.JUDGED) and found["dramatic_fragmentation"] == "Fine." and found["object_opener"] == "In the age of data,"
    assert found["whole_recap"].startswith("In conclusion") and found["negative_listing"].startswith("No rest") and found["negative_listing"].endswith("any year.")


def test_live_totals_stay_out_of_the_driver(spark):
    agree(spark, "n20_live_totals")
    found = registry.queries()["n20_live_totals"](spark, FOLDER)
    assert found.inputFiles() and all("/live-" in f and f.endswith(".parquet") for f in found.inputFiles())


def test_totals_to_files(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "session_id long, at string, decision string, bytes_sent long").withColumn("started_at", F.to_timestamp("at"))
    for r in ((1, "2024-01-01 01:00:00", "allowed", 5), (1, "2024-01-01 02:00:00", "blocked", 6)):
        rows(r).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows((1, "", "", 1)).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.run_to_files(streams.live_totals(stream, "1 day", "1 day"), str(tmp_path / "out")).collect()
    assert [(r["session_id"], r["events"], r["allowed"], r["bytes_sent"]) for r in got] == [(1, 2, 1, 11)]


def test_figures_of_suites_without_name_or_latency(spark):
    rows = [(s, i, 1.0, x, 0.0, None, None) for s, n in ((None, 20), ("", 40)) for i, x in enumerate(range(n))] + [("none", 1, 0.5, None, None, None, None)]
    cases = spark.createDataFrame(rows, "suite_id string, case_id int, score double, latency_ms int, cost double, pii_leakage_rate double, unsupported_claim_rate double")
    found = {r["suite_id"]: (r["cases"], r["p95_latency_ms"]) for r in evals.suite_figures(cases).collect()}
    assert found == {None: (20, 18), "": (40, 37), "none": (1, None)}
    assert evals.suite_figures(cases.limit(0)).count() == 0


def test_hosts_in_ascii(spark):
    want = {"[2001:DB8::0:1]": "2001:db8::1", "BÜCHER.example.": "xn--bcher-kva.example", "a b": None, "::zz": None, "plain.example": "plain.example", None: None}
    hosts = spark.createDataFrame([(h, h, 1, 2) for h in want] * 2, "id string, host string, _host int, _form int")
    rows = evidence.canonical_hosts(hosts, "host").collect()
    assert len(rows) == 2 * len(want) and {r["id"]: r["host"] for r in rows} == want


def test_ledger_of_tables_with_few_columns(spark):
    events = spark.createDataFrame([(datetime.datetime(2021, 1, 1), "=x", "extra")], "started_at timestamp, host string, other string")
    rows = evidence.evidence_ledger(events, spark.createDataFrame([], "occurred_at timestamp, tool string")).collect()
    assert len(rows) == 1 and len(rows[0]) == 20 and rows[0]["host"] == "'=x" and rows[0]["record_type"] == "network_event"


def test_joins_of_pseudonyms_that_repeat(spark, monkeypatch, tmp_path):
    """Fakes of a secret shortened to one digit, so that many of them repeat as those of a million users do."""
    monkeypatch.setitem(scrub.FAKES, "secret", lambda value, digest: F.concat(F.lit("REDACTED_"), F.substring(digest, 1, 1)))
    spark.range(60).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(180).select(F.col("id").alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, privacy.r13_join_kept(spark, str(tmp_path)).collect())) == [(i, 2) for i in range(60)]


def test_no_task_sorts_or_multiplies_a_histogram(spark):
    """Sums over all values hash numbers; no string is a maximum before values are summed up, and no key of a join holds a column."""
    hist = spark.createDataFrame([(0, "c", "A-1", 2), (0, "c", None, 1)], "ordinal int, column string, value string, n long")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    rates, patterns, kinds = plan(typing.parse_rates(hist)), plan(synth.id_patterns(hist)), plan(synth.sensitive_kinds(hist))
    assert "Expand" not in rates and not re.search(r"SortAggregate\(key=\[ordinal#\d+, column#\d+, [^\]]*shape", rates)
    assert re.search(r"BroadcastHashJoin \[column#\d+, mask#\d+\]", patterns) and not re.search(r"SortAggregate\(key=\[column#\d+, pos#\d+, c#\d+", patterns)
    assert "SortAggregate" not in kinds


def test_rates_of_all_kinds_of_cells(spark):
    cells = ["0", " 1 ", "yes", "TRUE", "1,234", "1.5", "2024-01-02", "2024-01-02 03:04:05", "A-1", "B-2", "é", ""]
    rows = [(0, "c", v, i + 1) for i, v in enumerate(cells)] + [(0, "c", None, 9), (1, "e", None, 4), (2, "b", "0", 3), (2, "b", "1", 1)]
    hist = spark.createDataFrame(rows, "ordinal int, column string, value string, n long")
    c, e, b = sorted(typing.parse_rates(hist).collect(), key=lambda r: r["ordinal"])
    assert (c["filled"], c["distinct"], c["bits"], c["shapes"], c["shape"]) == (78, 12, 2, 11, "AAAA")
    of = lambda name: round(c[name] * 78)
    assert [of(f"{k}_rate") for k in ("boolean", "bit", "integer", "float", "date", "datetime")] == [7, 3, 8, 14, 7, 8]
    assert (e["filled"], e["distinct"], e["shapes"], e["shape"], e["integer_rate"]) == (0, 0, 0, None, 0.0)
    assert (b["filled"], b["bits"], b["bit_rate"]) == (4, 2, 1.0)


def test_arrays_of_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1.50, "b": {"c": [2e3]}},\n {"a": "x]\\u000a"}]')
    (tmp_path / "b.json").write_text('[{"a": 7}]', "utf-16")
    rows = tables.read_json_records(spark, str(tmp_path))
    assert sorted(r["a"] for r in rows.collect()) == ["1.50", "7", "x]\n"] and rows.filter("b is not null").first()["b"]["c"] == ["2e3"]
    assert not any(".json" in f for f in rows.inputFiles())  # numbers as text come from lines, not from the arrays
    for text_ in ('[{"a": 1}] [{"a": 2}]', '[{"a": 1},]', '[{"a": 1}', "[1]", '[null, {"a": 1}]'):
        (tmp_path / "b.json").write_text(text_)
        with pytest.raises(Exception, match="holds|closed|comma|Expecting"):
            tables.read_json_records(spark, str(tmp_path)).collect()


def test_scan_reads_values_once(spark):
    """One pass over the values finds kinds and masks: no join brings two together, and nothing filters by spans before."""
    rows = [(0, "c", "a@b.com", 3), (0, "c", "a@b.com b@c.org 1.2.3.4", 2), (0, "c", "plain", 1), (0, "c", None, 9), (1, "name", "bob", 1), (1, "name", "x", 1), (2, "e", None, 1)]
    found = detect.scan_histogram(spark.createDataFrame(rows, "ordinal int, column string, value string, n long"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and "Join" not in plan
    assert [tuple(r) for r in found.collect()] == [(0, "c", "email", 5 / 6, 5 / 6, ["a***@b***.com"])]
    names = ["bob", " Jane\tSMITH ", "bob lee kim", "bobby", "", " ", None, "bob lee"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "v string").select(detect.is_name(F.col("v"))).collect()] == [True, True, False, False, False, False, None, False]
    tokens = ["abcdefghijklmnopqrst", "abcdefghijklmnopabcdefghijklmnop", "user12345@mail-server-xyz.example.com", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in tokens], "v string").select(detect.valid_token(F.col("v"))).collect()] == [True, False, False, False]


def test_documents_are_dealt_and_parsed_once(spark, tmp_path):
    """A small file is one task, its documents are for all; tools beyond ASCII do not have the documents parsed again."""
    spark.range(1, 9).selectExpr("id as p_partkey", "'n' as p_name", "'b' as p_brand", "1 as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    docs = specs(spark, str(tmp_path))
    assert "RepartitionByExpression" in docs._jdf.queryExecution().optimizedPlan().toString() or "Repartition " in docs._jdf.queryExecution().optimizedPlan().toString()
    tools = evals.parse_tools(docs)
    assert "parse_json" not in tools._jdf.queryExecution().optimizedPlan().toString() and tools.count() == 24
    text_ = '{"a": "[1]", "b": [], "c": {"d": [null, {"e": "{"}]}, "f": {}}'
    found = evals.leaves(spark.createDataFrame([(1, text_)], "id long, doc string"), "id", "doc", "x")
    assert sorted(tuple(r)[1:] for r in found.collect()) == [("a", '"[1]"'), ("b", "[]"), ("c.d.0", "null"), ("c.d.1.e", '"{"'), ("f", "{}")]


def test_signals_compute_once_and_alike(spark):
    """Rows are dealt, each signal computes a value once, and texts that a rewrite leaves alone are not looked at; no join."""
    folder = FOLDER
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    q = registry.queries()
    assert "Repartition" in plan(q["x16_analyze"](spark, folder)) and "Join" not in plan(q["x18_rewrite"](spark, folder))
    weasels = text.analyze(spark.createDataFrame([(1, "x")], "id int, text string"), "id", signals={"weasel": text.SIGNALS["weasel"]})
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    assert plan(weasels).count("critics argue") == 1
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    said = ["One two", "one two three", "It's b-c\nd. E", "In conclusion, a\n\nIn conclusion, a", "- x y\r- z", "", None]
    docs = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    found = {r["id"]: (r["severity"], r["score"]) for r in text.analyze(docs, "id", signals={"recap_ending": text.recap_ending}).collect()}
    assert found == {0: ("info", 0.0), 1: ("strong", 1.0), 2: ("strong", 1.0), 3: ("strong", 1.0), 4: ("strong", 1.0), 5: ("info", 0.0), 6: ("info", 0.0)}
    rows = docs.select("id", text.sentences(F.col("text")).alias("s"), F.transform(text.sentence_spans(F.col("text")), lambda x: x["value"]).alias("t")).collect()
    assert all(r["s"] == r["t"] for r in rows) and rows[2]["s"] == ["It's b-c\nd.", "E"]
    pattern = re.compile(text.phrase_pattern(["leverage", "Leverages", "in an", "in", "a.b"]), re.ASCII)
    assert [m.group() for m in pattern.finditer("LEVERAGES leverage in an in a axb a.b inner")] == ["LEVERAGES", "leverage", "in an", "in", "a.b"]


def test_rewrite_signals(spark):
    rows = [(1, "Plain words only."), (2, "It was pivotal. It was groundbreaking."), (None, "It was pivotal."), (4, None)]
    docs = spark.createDataFrame(rows, "id int, text string")
    assert [tuple(r) for r in text.rewrite_signals(docs, "id").collect()] == [(2, "puffery", "strong", "info")]


def test_usual_forms_are_cast_and_mean_the_same(spark):
    """Days, moments and numbers in the usual form skip the formatters, and come out as those would have them."""
    values = ["2024-01-02", "2024-02-30", "0000-01-01", "1677-09-21", "1677-09-22", "2262-04-12", "2024-01-02\n", "2024-01-02T03:04:05", "2024-01-02T24:00:00", "1677-09-21 00:12:43", "2262-04-11 23:47:16",
              "2024-01-02 03:04:05Z", "1582-10-10", "1", "1.5", "1_0", "1,234", "123456789012345.5", "5.", ".5", "7\n", "", None]
    made = ((typing.as_date, typing._any_date), (typing.as_datetime, typing._any_datetime), (typing.as_float, typing._any_float))
    both = [f(F.col("v")).cast("string").alias(f"{i}{j}") for i, pair in enumerate(made) for j, f in enumerate(pair)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(*both).collect()
    assert all(r[f"{i}0"] == r[f"{i}1"] for r in rows for i in range(3)) and sum(r["00"] is not None for r in rows) == 3


def test_scan_skips_what_is_too_short(spark):
    """A search for a kind needs as many digits or characters as its shortest match has, and finds those matches."""
    texts = ["ORD-000000001", "5551234567", "4222222222222", "123-45-6789", "sk-abcdefgh", "abcdefghijklmnopqrst", "sk-abcdefg", "1 2 3 4 5 6 7 8"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    kinds = {r[0]: [s["kind"] for s in r[1]] for r in df.select("v", detect.spans_of(F.col("v"))).collect()}
    assert kinds == dict(zip(texts, ([], ["phone"], ["credit_card", "phone"], ["ssn"], ["secret"], ["secret"], [], []), strict=True))
    assert "{10}" in df.select(detect.spans_of(F.col("v"), kinds=("phone",)))._jdf.queryExecution().analyzed().toString()
