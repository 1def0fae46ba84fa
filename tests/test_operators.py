"""Goldens of the operators outside the llm subpackage, on small rows of our own."""

import datetime
import hashlib
import hmac
import importlib.util

import pytest
from pyspark.sql import functions as F

from millrace.functions.staging import shared_dir
from millrace.operators import detect, diff, evals, evidence, profile, scrub, synth, text, typing, worklog
from millrace.sources import tables
from millrace.streaming import evidence as streams

SALT = b"salt"


def strings(spark, **columns):
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` string" for c in columns))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def types_of(df):
    return {r["column"]: r["col_type"] for r in typing.infer_types(df).collect()}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x,y\n1,N/A\n2\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "a.csv")).collect()] == [("1", None), ("2", None)]
    (tmp_path / "b.csv").write_text("x,y\n1,2,3\n")
    with pytest.raises(Exception, match="more fields"):
        tables.read_delimited(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "c.jsonl").write_text('{"a": 1, "b": {"c": 2.5, "d": {"e": 1}}}\n')
    assert tables.read_table(spark, str(tmp_path / "c.jsonl")).first().asDict() == {"a": "1", "b.c": "2.5", "b.d": '{"e":"1"}'}
    (tmp_path / "d.json").write_text('[{"a": "null"}, {"a": " nan "}]')
    assert [r["a"] for r in tables.read_table(spark, str(tmp_path / "d.json")).collect()] == [None, " nan "]
    (tmp_path / "e.log").write_bytes(b"one\r\ntwo")
    assert sorted(r["line"] for r in tables.read_lines(spark, str(tmp_path / "e.log")).collect()) == ["one\r", "two"]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def test_writers(spark, tmp_path):
    df = strings(spark, a=["=1", "-5", "-x", " +2"])
    tables.write_table(df.coalesce(1), str(tmp_path / "o"), "csv")
    back = tables.read_delimited(spark, str(tmp_path / "o")).collect()
    assert [r["a"] for r in back] == ["'=1", "-5", "'-x", "' +2"]
    assert [r["a"] for r in tables.ledger_safe(df).collect()] == ["'=1", "'-5", "'-x", "' +2"]


def test_types(spark):
    n = 40
    df = strings(
        spark,
        key=[str(i) for i in range(n)], code=[f"C-{i:03d}" for i in range(n)], money=[f"{i}.5" if i else "N/A" for i in range(n)],
        day=["2024-01-05" if i % 2 else "01/31/2024" for i in range(n)], at=[f"2024-1-5T10:00:{i:02d}+05:30" for i in range(n)], flag=["yes", "no"] * 20,
        bits=["0", "1"] * 20, plan=["a", "b"] * 20, none=[""] * n, words=[f"w{'x' * i} {i}" for i in range(n)], nearly=["1"] * 38 + ["x"] * 2, short=["1"] * 37 + ["x"] * 3,
    )
    assert types_of(tables.normalize_nulls(df)) == {
        "key": "integer", "code": "id_like", "money": "float", "day": "date", "at": "datetime", "flag": "boolean", "bits": "boolean", "plan": "categorical",
        "none": "empty", "words": "text", "nearly": "integer", "short": "categorical",
    }
    assert typing.infer_types(df.limit(0)).count() == 0


def test_parsers(spark):
    got = one(
        spark, *[typing.as_datetime(F.lit(v)) for v in ("2024-01-05T10:00:00+05:30", "2024-01-05  10:00:60", "2024-1-5 1:2:3.25", "1500-01-01 00:00:00")],
        *[typing.as_date(F.lit(v)) for v in ("13/01/2024", "2024-02-30", "2024-2-3")], *[typing.as_float(F.lit(v)) for v in ("1_000.5", "nan", "1e400", "1,000")],
        typing.as_integer(F.lit("1,000")), typing.as_integer(F.lit("2.5")),
    )
    d = datetime.datetime
    assert tuple(got) == (
        d(2024, 1, 5, 4, 30), None, d(2024, 1, 5, 1, 2, 3, 250000), None, datetime.date(2024, 1, 13), None, datetime.date(2024, 2, 3), 1000.5, None, None, 1000.0, 1000, None,
    )


def test_profile(spark):
    df = strings(spark, x=["1", "2", "3", "4", "100", None], y=["a", "a", "b", "b", "c", "c"])
    rows = {r["column"]: r for r in profile.profile(df, include_values=True).collect()}
    assert (rows["x"]["median"], rows["x"]["outliers"], rows["x"]["null_count"]) == (3.0, 1, 1)
    assert [t["value"] for t in rows["y"]["top"]] == ["a", "b", "c"]


def test_detection(spark):
    spans = lambda t, **k: [(s["kind"], s["value"]) for s in one(spark, detect.spans_of(F.lit(t), **k))[0]]
    assert spans("call (212) 555-0100 or a@b.co") == [("phone", "(212) 555-0100"), ("email", "a@b.co")]
    assert spans("2024-01-15 10:30:00") == [] and spans("12345678.25") == []
    assert ("credit_card", "4111 1111 1111 1111") in spans("4111 1111 1111 1111")
    assert spans("123456789", bare_ssn=True) == [("ssn", "123456789")] and spans("123456789") == []
    assert ("ip", "10.0.0.1") in spans("at 10.0.0.1!") and spans("at 10.0.0.1.5") == []
    assert ("secret", "AKIAABCDEFGHIJKL") in spans("AKIAABCDEFGHIJKL")
    assert ("secret", "kX9$mQ2!vL7@pR4#wZ8%") in spans("kX9$mQ2!vL7@pR4#wZ8%") and spans("Bob") == [("name", "Bob")]
    table = strings(spark, email=[f"u{i}@x.org" for i in range(5)], first_name=["Bob", "Alice", "Jane", "Kim", "Zzz"])
    found = {(r["column"], r["kind"]): r["confidence"] for r in detect.scan_table(table).collect()}
    assert found[("email", "email")] == 1.0 and ("first_name", "name") in found


def test_diff(spark):
    a = strings(spark, id=["k-1", "k-2", "k-3", "k-4"], v=["1", "2", "3", "4"], s=["a", "a", "b", "b"])
    b = strings(spark, id=["k-1", "k-2", "k-4", "k-5"], v=["1.0", "5.0", "4.0", "6.0"], s=["a", "c", "b", "b"])
    out = diff.diff(a, b)
    assert out.key == ["id"] and {r["class"]: r["n"] for r in out.classes.collect()} == {"added": 1, "removed": 1, "changed": 1, "unchanged": 2}
    assert {(r["column"], r["old"], r["new"]) for r in out.cells.collect()} == {("v", "2", "5.0"), ("s", "a", "c")}
    assert diff.diff(a.union(a), b, ["id"]).notes and diff.diff(a.select("s"), b.select("s")).notes
    with pytest.raises(ValueError):
        diff.diff(a, b, ["nope"])


def test_scrub(spark):
    assert one(spark, scrub.hmac_sha256(F.lit("é@x"), SALT))[0] == hmac.new(SALT, "é@x".encode(), hashlib.sha256).hexdigest()
    fake = lambda v, k: one(spark, scrub.fake(F.lit(v), k, SALT))[0]
    assert fake("a@b.org", "email").endswith(".org") and fake("unknown", "email").endswith(".com") and fake(None, "email") is None
    card = fake("4111-1111-1111-1111", "credit_card")
    assert card[4] == "-" and one(spark, F.call_function("luhn_check", F.lit(card.replace("-", ""))))[0]
    df = strings(spark, note=["mail a@b.org, from 10.0.0.1", None, "nothing", "more"], email=["a@b.org", "c@d.org", "e@f.org", "g@h.org"])
    plan = scrub.column_plan(df)
    assert plan == {"email": "email"}
    out = scrub.scrub_table(df, SALT, plan=plan)
    rows = out.collect()
    assert rows[0]["note"] == f"mail {rows[0]['email']}, from {fake('10.0.0.1', 'ip')}" and rows[1]["note"] is None
    mapped = scrub.mapping(df, SALT, plan)
    assert scrub.assert_clean(out, mapped).count() == 4
    with pytest.raises(ValueError, match="email"):
        scrub.assert_clean(df, mapped)


def test_synth(spark):
    df = strings(spark, code=[f"A-{i:03d}" for i in range(30)], n=[str(i * 2) for i in range(30)], e=[f"p{i}@q.org" for i in range(30)], g=["x", "y", "y"] * 10)
    spec = synth.learn_spec(df)
    kinds = {r["column"]: (r["kind"], r["pattern"]) for r in spec.columns.collect()}
    assert kinds["code"] == ("id", "A-###") and kinds["e"][0] == "email"
    made = synth.generate(spark, spec, 1200, 5)
    assert sorted(map(str, made.collect())) == sorted(map(str, synth.generate(spark, spec, 1200, 5).repartition(7).collect()))
    assert made.select("code").distinct().count() == 1200 and made.select("e").distinct().count() == 1200
    assert made.filter("code = 'A-1199'").count() == 1 and made.join(df, "e", "left_semi").count() == 0


def test_text(spark):
    said = "Dr. Smith paid 3.50 in the U.S. today. Fine!\n\n# Title\n- one\nIt's not just fast, but it's cheap."
    assert one(spark, text.sentences(F.lit(said)))[0] == ["Dr. Smith paid 3.50 in the U.S. today.", "Fine!", "# Title", "- one", "It's not just fast, but it's cheap."]
    spans = one(spark, text.paragraphs(F.lit("  one\ntwo  \n \n\nthree\n")))[0]
    assert [(s["start"], s["end"], s["value"]) for s in spans] == [(2, 9, "one\ntwo"), (15, 20, "three")]
    docs = strings(spark, id=["1", "2", "3"], text=[said, None, "We delve. We delve. We delve. We delve. We delve — and — win."])
    rows = {(r["id"], r["signal"]): r["severity"] for r in text.analyze(docs, "id").collect()}
    assert rows["1", "binary_contrast"] == "strong" and rows["2", "phrase_tells"] == "info" and rows["3", "phrase_tells"] == "strong" and rows["3", "em_dash"] == "strong"
    new = {r["id"]: r for r in text.rewrite(strings(spark, id=["1"], text=["In order to win — **now** — `in order to`"]), "id").collect()}
    assert new["1"]["text"] == "to win, now, `in order to`" and new["1"]["em_dash"] == 2
    ops = text.corpus_word_diff(docs, docs.withColumn("text", F.concat("text", F.lit(" more"))), "id").filter("id = '1'").orderBy("pos").collect()
    assert "".join(o["text"] for o in ops if o["op"] != "insert") == said and "".join(o["text"] for o in ops if o["op"] != "delete") == said + " more"


def test_evidence(spark):
    hosts = ["127.0.0.1", "10.1.2.3", "8.8.8.8", "224.0.0.1", "fe80::1", "::1", "example.com", None]
    assert [one(spark, evidence.ip_scope(F.lit(h).cast("string")))[0] for h in hosts] == ["loopback", "private", "public", "multicast", "link-local", "loopback", "hostname", "unresolved"]
    paths = ["/a/api_key/s3cret/x?y", "/0f8fad5b-d9cb-469f-a165-70867728950e", "", None, "/ok#f"]
    assert [one(spark, evidence.sanitize_path(F.lit(p).cast("string")))[0] for p in paths] == ["/a/[redacted]/[redacted]/x", "/[redacted]", None, None, "/ok"]
    assert one(spark, evidence.sanitize_url(F.lit("HTTPS://u:p@Ex.org:8443/a?q#f")))[0] == "https://ex.org:8443/a"
    rules = spark.createDataFrame([("d", 1, "deny", ["**.bad.org"], [], [], [], False), ("a", 2, "allow", ["*"], [], [443], [], False)], "id string, rank int, action string, hosts array<string>, ips array<string>, ports array<int>, protocols array<string>, allow_private boolean")
    events = spark.createDataFrame([(1, "bad.org", "8.8.8.8", 443, "https"), (2, "ok.org", "8.8.8.8", 443, "https"), (3, "ok.org", "10.0.0.1", 443, "https"), (4, "ok.org", None, 80, "http")], "event_id long, host string, ip string, port int, protocol string")
    got = {r["event_id"]: (r["rule_id"], r["outcome"]) for r in evidence.evaluate_policy(events, rules, mode="enforce").collect()}
    assert got == {1: ("d", "blocked"), 2: ("a", "allowed"), 3: (None, "blocked"), 4: (None, "blocked")}
    with pytest.raises(ValueError, match="repeated id"):
        evidence.evaluate_policy(events, rules.union(rules))


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 7, "f", "2024-01-01 00:00:00"), (2, 7, "f", "2024-01-01 00:01:00"), (3, 7, None, "2024-01-01 00:02:00"), (4, 7, None, "2024-01-01 00:03:00")],
        "event_id long, session_id long, fingerprint string, at string",
    ).withColumn("started_at", F.to_timestamp("at"))
    rows.drop("at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.drop("at").schema).parquet(str(tmp_path / "in"))
    query = streams.dedupe_stream(stream).writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(spark.table("deduped").collect()) == 3 and evidence.dedupe(rows).count() == 3
    seen = []
    lines = spark.readStream.text(str(tmp_path / "lines")) if (tmp_path / "lines").mkdir() is None else None
    (tmp_path / "lines" / "a.txt").write_text("mail a@b.org\n")
    gate = lambda batch, out: scrub.assert_clean(out, scrub.mapping(batch.withColumnRenamed("value", "line"), SALT, {}))
    clean = lambda batch: scrub.scrub_lines(batch.withColumnRenamed("value", "line"), SALT)
    streams.gated(lines, clean, gate, lambda out, _: seen.extend(out.collect()), str(tmp_path / "g")).awaitTermination()
    assert len(seen) == 1 and "a@b.org" not in seen[0]["line"]


def test_worklog(spark):
    rows = spark.createDataFrame([(1, datetime.datetime(2021, 1, 1), "win", " x "), (2, datetime.datetime(2021, 1, 4), "nope", "y"), (3, datetime.datetime(2021, 1, 4), "note", "z" * 501)], "id long, ts timestamp, tag string, text string")
    assert [r["reason"] for r in worklog.validate_entries(rows).orderBy("id").collect()] == [None, "bad_tag", "too_long"]
    assert [r["id"] for r in worklog.list_entries(rows, "2020-W53").collect()] == [1]
    report = worklog.weekly_report(rows.filter("id = 1")).orderBy("section").collect()
    assert [r["entries"] for r in report] == [1, 0, 0, 0, 0] and report[0]["week"] == "2020-W53"
    with pytest.raises(ValueError):
        worklog.list_entries(rows, "2020-53")


def test_evals(spark):
    cases = spark.createDataFrame([("s", 1, None, '{"a": 1, "b": 2}', '{"b": 2, "a": 1}', 480, 0.01, None, 0.1), ("s", 2, 0.86, None, None, 620, 0.013, 0.2, 0.3)], "suite_id string, case_id int, score double, expected string, actual string, latency_ms int, cost double, pii_leakage_rate double, unsupported_claim_rate double")
    figures = evals.suite_figures(evals.score_cases(cases)).first()
    assert (figures["overall_score"], figures["p95_latency_ms"], figures["cost"], figures["pii_leakage_rate"], figures["unsupported_claim_rate"]) == (0.93, 620, 0.023, None, 0.3)
    gates = spark.createDataFrame([("s", "minOverallScore", 0.9), ("s", "maxPiiLeakageRate", 0.5)], "suite_id string, gate string, value double")
    assert evals.verdicts(evals.suite_figures(evals.score_cases(cases)), evals.merge_gates(gates)).first()["failed"] == ["maxPiiLeakageRate"]
    a, b = (one(spark, evals.fingerprint(F.lit(t)))[0] for t in ('{"b": 2.50, "a": [1]}', '{"a":[1],"b":2.5}'))
    assert a == b
    tools = spark.createDataFrame([("s", "readUserUpdatedAt", ["x:read"], False), ("s", "bulkDeleteUsers", ["x:read"], False)], "spec_id string, name string, scopes array<string>, approval boolean")
    assert [r["name"] for r in evals.risk_warnings(tools).collect()] == ["bulkDeleteUsers"]


def test_entry_without_the_subpackage(spark, monkeypatch):
    import __spark_entry__

    load = importlib.import_module

    def without(name, *a):
        if name in ("millrace.llm.registry", "corpus_pipeline"):
            raise ImportError(name)
        return load(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    with pytest.warns(UserWarning):
        __spark_entry__.queries()
    names = __spark_entry__.queries()
    assert "f9_profile" in names and not any(n.startswith("op") for n in names) and set(__spark_entry__.oracle_sql()) <= set(names)
    assert shared_dir(spark)


@pytest.mark.parametrize("n", [20000])
def test_long_runs(spark, n):
    """Long runs of digits, words and domains take no stack, and many spans no quadratic time."""
    cells = ["9" * n, "1_" * n, "1," * n, "a-" * n, "a@" + "b." * n + "c", "8.8.8.8 " * n, "- a " * n]
    df = strings(spark, id=[str(i) for i in range(len(cells))], text=cells)
    assert typing.infer_types(df).count() == 2
    assert {r["id"]: r["words"] for r in text.text_stats(df, "id").collect()}["3"] == 1
    assert detect.scan_spans(df, "text", ("ip",)).count() == n
    assert detect.scan_spans(df, "text", ("email",)).collect()[0]["value"] == cells[4]


def test_quantiles_without_one_task(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(c, float(x), int(k)) for c in "ab" for x, k in zip(rng.normal(size=200).round(1), rng.integers(1, 4, 200), strict=True)] + [("c", 5.0, 1)]
    found = {r["column"]: r["q"] for r in profile.weighted_quantiles(spark.createDataFrame(rows, "column string, x double, n long"), (0.0, 0.05, 0.5, 0.95, 1.0)).collect()}
    for c in "abc":
        every = np.repeat(*(np.array(v) for v in zip(*((x, k) for d, x, k in rows if d == c), strict=True)))
        assert np.allclose(found[c], np.quantile(every, (0.0, 0.05, 0.5, 0.95, 1.0)))


def test_small_findings(spark):
    spec = synth.learn_spec(strings(spark, code=[f"AB-{c}" for c in "QRSTUV"]))
    assert synth.generate(spark, spec, 3000, 1).select("code").distinct().count() == 3000
    one_case = spark.createDataFrame([("s", "c", None, '{"a":{"y":2,"x":1}}', '{"a":{"x":1,"y":2}}')], "suite_id string, case_id string, score double, expected string, actual string")
    assert evals.score_cases(one_case).first()["score"] == 1.0
    entry = spark.createDataFrame([("1", "2024-01-01", "win", "\t\n")], "id string, ts string, tag string, text string")
    assert worklog.validate_entries(entry).first()["reason"] == "empty"
    stray = text.rewrite(strings(spark, id=["1"], text=["In order to win ` we utilize tools\n`in order to`"]), "id").first()
    assert stray["text"] == "to win ` we use tools\n`in order to`" and stray["per_pass"] == [2, 0]
    social = strings(spark, ssn=[f"{100 + i}-12-{1000 + i}" for i in range(50)])
    made = synth.generate(spark, synth.learn_spec(social), 2000, 3)
    assert made.filter(detect.valid_ssn(F.col("ssn"))).select("ssn").distinct().count() == 2000


def test_word_runs_are_lossless_and_fine():
    import random

    rng = random.Random(1)
    for size in (0, 1, 7, 60, 4000):
        old = [rng.choice("abcdefgh") + " " for _ in range(size)] + [f"u{i} " for i in range(size // 2)]
        new = [t for t in old if rng.random() > 0.05]
        runs = text.word_runs(old, new)
        assert [t for op, ts in runs if op != "insert" for t in ts] == old and [t for op, ts in runs if op != "delete" for t in ts] == new
        assert sum(len(ts) for op, ts in runs if op == "equal") >= 0.9 * len(new)


def test_networks_of_both_families(spark):
    rules = spark.createDataFrame(
        [("six", ["2001:db8::/32", "fe80::1"]), ("four", ["10.0.0.0/8", "1.2.3.4"]), ("all", ["::/0"])], "id string, ips array<string>"
    )
    ips = spark.createDataFrame([(x,) for x in ("2001:DB8:1::5", "2001:db9::", "fe80::1", "fe80::2", "::ffff:10.1.2.3", "10.9.9.9", "1.2.3.4", "1.2.3.5", "::1", "1::2::3", "x", None, "12345::")], "ip string")
    found = {}
    for r in evidence.network_matches(ips, rules).collect():
        found.setdefault(r["ip"], set()).add(r["rule"])
    assert found == {
        "2001:DB8:1::5": {"six", "all"}, "2001:db9::": {"all"}, "fe80::1": {"six", "all"}, "fe80::2": {"all"}, "::ffff:10.1.2.3": {"four"}, "10.9.9.9": {"four"}, "1.2.3.4": {"four"}, "::1": {"all"},
    }
    bad = spark.createDataFrame([("a", ["10.0.0.0/33"]), ("b", ["nonsense"]), ("c", ["::/129"]), ("d", ["10.0.0.0/8"])], "id string, ips array<string>")
    bad = bad.selectExpr("id", "cast(array() as array<string>) as hosts", "ips", "cast(array() as array<int>) as ports", "cast(array() as array<string>) as protocols")
    assert {r["id"] for r in evidence.check_rules(bad).collect()} == {"a", "b", "c"}
