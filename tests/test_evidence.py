"""Rules as bitmaps, keyed state with timers, upserts of totals and retention by partitions."""

import datetime
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import evidence
from millrace.streaming import evidence as streams

RULES = "id string, rank int, action string, hosts array<string>, ips array<string>, ports array<int>, protocols array<string>, allow_private boolean"
EVENTS = "event_id long, host string, ip string, port int, protocol string"


def brute(event, rules, default="deny"):
    """The decision by going through every rule."""
    _, host, ip, port, protocol = event

    def named(pattern):
        if pattern == "*":
            return host is not None
        if pattern.startswith("**."):
            return host is not None and (host == pattern[3:] or host.endswith(pattern[2:]))
        return host is not None and (host.endswith(pattern[1:]) if pattern.startswith("*.") else host == pattern)

    address = None if ip is None else ipaddress.ip_address(ip)
    if address is not None and address.version == 6 and address.ipv4_mapped:
        address = address.ipv4_mapped
    fits = [
        r for r in rules
        if (not r[3] or any(map(named, r[3]))) and (not r[4] or address is not None and any(address in ipaddress.ip_network(n) for n in r[4]))
        and (not r[5] or port in r[5]) and (not r[6] or protocol in r[6])
    ]
    first = lambda action: min(((r[1], r[0]) for r in fits if r[2] == action), default=None)
    chosen, action = (first("deny"), "deny") if first("deny") else (first("allow"), "allow") if first("allow") else (None, default)
    if action == "allow" and address is not None and not address.is_global and not any(r[7] for r in fits if r[2] == "allow"):
        return None, "deny"
    return chosen and chosen[1], action


@pytest.mark.parametrize("default", ["deny", "allow"])
def test_two_thousand_rules(spark, default):
    rng = random.Random(4)
    hosts, ips = [f"{a}.{b}.org" for a in "abcd" for b in "wxyz"], ["8.8.8.8", "8.8.4.4", "10.1.2.3", "::ffff:10.1.2.3", "2606:4700::1", "1.1.1.1", "192.168.0.9"]
    some = lambda pool, n: rng.sample(pool, rng.randint(0, n))
    rules = []
    for k in range(2000):
        own = [some([*hosts, "*.x.org", "**.y.org", "z.org", "*"] if k % 50 == 0 else [*hosts, "*.x.org"], 2), some(["8.8.0.0/16", "10.0.0.0/8", "1.1.1.1", "2606:4700::/32"], 1), some([80, 443, 22], 2), some(["http", "https"], 1)]
        rules.append((f"r{k:04d}", rng.randint(1, 500), "deny" if rng.random() < 0.3 else "allow", *(own if any(own) else [[hosts[0]], [], [], []]), rng.random() < 0.1))
    rules = [r for r in rules if len(r[3]) + len(r[4]) + len(r[5]) + len(r[6]) > 1 and (r[3] or r[4])][:1500] + [("zz", 9999, "allow", ["*"], [], [1], [], True)]
    events = [(i, rng.choice([*hosts, "z.org", None]), rng.choice([*ips, None]), rng.choice([80, 443, 22, 1, None]), rng.choice(["http", "https", None])) for i in range(400)]
    table = spark.createDataFrame(events + events[:5], EVENTS)
    judged = evidence.evaluate_policy(table, spark.createDataFrame(rules, RULES), default)
    got = judged.collect()
    assert len(got) == 405 and {(r["event_id"], r["rule_id"], r["action"]) for r in got} == {(e[0], *brute(e, rules, default)) for e in events}
    assert {r["outcome"] for r in got} <= {"allowed", "would_block"}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="more than"):
        evidence.RuleBitmaps(spark.range(evidence.MOST_RULES + 1).select(F.col("id").cast("string"), F.lit(1).alias("rank"), F.array().cast("array<string>").alias("ips")))


def test_bitmaps_of_no_rules(spark):
    events = spark.createDataFrame([(1, "a.org", "8.8.8.8", 80, "http"), (2, None, None, None, None)], EVENTS)
    none = spark.createDataFrame([], RULES)
    assert {r["outcome"] for r in evidence.evaluate_policy(events, none, mode="enforce").collect()} == {"blocked"}
    assert evidence.evaluate_policy(events.limit(0), none).count() == 0


def test_scopes_of_addresses_within_ipv6(spark):
    want = {"::ffff:10.0.0.7": "private", "::FFFF:127.0.0.1": "loopback", "::ffff:8.8.8.8": "public", "::ffff:a9fe:1": "link-local", "0:0:0:0:0:ffff:e000:1": "multicast", "2001:db8::ffff": "public", "::1": "loopback", "10.0.0.7": "private", "x": "hostname", "": "unresolved"}
    rows = spark.createDataFrame([(x,) for x in want], "ip string")
    assert {r["ip"]: r["s"] for r in rows.select("ip", evidence.ip_scope(F.col("ip")).alias("s")).collect()} == want


PHASES = "event_id long, phase string, at string, decision string, bytes_sent long"


def phases(spark, rows):
    return spark.createDataFrame(rows, PHASES).withColumn("at", F.to_timestamp("at"))


@pytest.fixture
def state_store(spark):
    before = spark.conf.get(streams.STATE_STORE[0])
    spark.conf.set(*streams.STATE_STORE)
    yield
    spark.conf.set(streams.STATE_STORE[0], before)


def test_merge_stream(spark, tmp_path, state_store):
    days = [
        [(1, "open", "2024-01-01 23:59:50", "pending", None), (2, "open", "2024-01-01 10:00:00", "pending", None), (3, "open", "2024-01-01 11:00:00", "pending", None)],
        [(1, "close", "2024-01-02 00:00:10", "allowed", 7), (4, "close", "2024-01-02 01:00:00", "failed", None)],
        [(2, "close", "2024-01-05 12:00:00", "blocked", 9)],  # four days: one row
        [(8, "open", "2024-01-12 00:00:00", "pending", None)],  # the third event is given up by now
        [(3, "close", "2024-01-12 13:00:00", "allowed", 3)],  # its close comes out alone
        [(9, "open", "2024-02-01 00:00:00", None, None)],
    ]
    schema = phases(spark, days[0]).schema
    runs = []
    for k, rows in enumerate(days):  # a run for each day, as a stream that is started again: state is in the checkpoint
        phases(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.merge_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), closed=datetime.timedelta(minutes=5))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        runs.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress and query.lastProgress["stateOperators"] else None)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    every = {r["event_id"]: r for r in evidence.merge_phases(phases(spark, [r for rows in days for r in rows])).collect()}
    assert sorted(r["event_id"] for r in found) == [1, 2, 3, 3, 4, 8]
    for r in found:
        if r["event_id"] != 3:
            assert r == every[r["event_id"]]
    third = sorted((r for r in found if r["event_id"] == 3), key=lambda r: r["started_at"] is None)
    assert third[0]["ended_at"] is None and third[1]["started_at"] is None and third[1]["decision"] == "allowed"


def totals(spark, folder):
    schema = "session_id long, started_at timestamp, decision string, bytes_sent long"
    return streams.live_totals(spark.readStream.schema(schema).parquet(folder), "1 hour", "1 hour")


def test_upserts_and_state_that_shrinks(spark, tmp_path):
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    put = lambda *rows: spark.createDataFrame(rows, "session_id long, started_at timestamp, decision string, bytes_sent long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    put(*[(s, at(1, h), "allowed", 1) for s in range(10) for h in range(6)])
    query = streams.upsert(totals(spark, str(tmp_path / "in")), out, log)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    put((1, at(1, 5), "blocked", 5), (1, at(20, 0), "allowed", 2))
    query = streams.upsert(totals(spark, str(tmp_path / "in")), out, log)
    held += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 60 and held[-1] <= 2
    schema = totals(spark, str(tmp_path / "in")).schema
    now = lambda path: sorted((r["session_id"], r["window"]["start"], r["events"], r["allowed"], r["bytes_sent"]) for r in streams.current(spark, path, schema, ("window", "session_id")).collect())
    rows = now(out)
    assert len(rows) == 61 and (1, at(1, 5), 2, 1, 6) in rows and (1, at(20, 0), 1, 1, 2) in rows
    again = spark.read.parquet(f"{out}/_version=1").collect()
    spark.createDataFrame(again, schema).write.mode("overwrite").parquet(f"{out}/_version=1")  # the epoch is run again
    assert now(out) == rows
    streams.compact(spark, out, schema, ("window", "session_id"), str(tmp_path / "small"))
    assert now(str(tmp_path / "small")) == rows
    assert streams.current(spark, str(tmp_path / "none"), schema, ("window", "session_id")).count() == 0


def test_retention_leaves_other_days_alone(spark, tmp_path):
    path = str(tmp_path / "evidence")
    rows = [(i, i % 4, f"2024-01-0{1 + i % 5}") for i in range(40)] + [(99, 2, "2024-01-09"), (100, 1, None)]
    rows = [r for r in rows if not (r[1] == 2 and r[2] in ("2024-01-01", "2024-01-02"))]
    spark.createDataFrame(rows, "event_id long, session_id long, day string").coalesce(1).write.partitionBy("day").parquet(path)
    sessions = spark.createDataFrame([(0, "stopped"), (1, "running"), (2, "stopped"), (3, "stopped")], "session_id long, status string")
    files = lambda: {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    before = files()
    gone = spark.createDataFrame([(1,), (2,)], "session_id long")
    touched = evidence.retain_partitions(spark, path, sessions, gone)
    assert [str(t) for t in touched] == ["2024-01-03", "2024-01-04", "2024-01-05", "2024-01-09"]
    left = spark.read.parquet(path).collect()
    assert {(r["event_id"], r["session_id"]) for r in left} == {(i, s) for i, s, _ in rows if s != 2}
    same = lambda fs: {f for f in fs if not any(f"day={t}" in f for t in touched)}
    assert same(before) == same(files()) and len(same(before)) == 3
    assert evidence.retain_partitions(spark, path, sessions, gone) == []


def test_first_of_repeats(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(k, k % 2, "f", at, "x") for k in range(50)] + [(60, None, "f", at, None), (61, None, "f", at, None), (70, 0, None, at, None), (71, 0, None, at, None)], "event_id long, session_id long, fingerprint string, started_at timestamp, `odd.name` string")
    got = evidence.dedupe(rows)
    assert got.columns == rows.columns and sorted(r["event_id"] for r in got.collect()) == [0, 1, 60, 70, 71]
