"""Network evidence (N1-N17): destinations made comparable, rules applied by joins, and rollups of the log."""

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.binding import let
from millrace.functions.staging import broadcast_if_small, quoted, scratch, staged
from millrace.operators.typing import stripped
from millrace.sources.tables import ledger_safe

V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
#: Shapes of what does not belong in a log.
SENSITIVE = r"(?i)(?:^|[-_])(?:api[-_]?key|auth|credential|password|secret|token)(?:$|[-_=])"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
LONG_TOKEN = r"^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9._~-]{24,}$"
#: What can become of an event, and what tells destinations apart.
DECISIONS = ("allowed", "observed", "would_block", "blocked", "failed", "unsupported")
DESTINATION = ("service", "host", "port", "protocol", "scope")
#: The layout of the ledger.
LEDGER = dict.fromkeys(
    ("record_type", "occurred_at", "source", "service", "host", "port", "protocol", "method", "path", "scope", "decision", "rule_id", "bytes_sent", "bytes_received",
     "process_pid", "process_name", "tool", "target", "correlation_id", "detail"), "string",
) | {"occurred_at": "timestamp", "port": "int", "bytes_sent": "bigint", "bytes_received": "bigint", "process_pid": "int"}
RESTRICTED = ("loopback", "link-local", "private", "multicast", "reserved")
PORTS = {"http": 80, "https": 443, "tcp": 443}


def normalize_host(host: Column) -> Column:
    """Trimmed, lower case, without brackets or trailing dots; null where white space or nothing is left. Names
    beyond ASCII stay as written in lower case; `canonical_hosts` turns them into ASCII."""
    bare = F.regexp_replace(F.lower(stripped(host)), r"^\[(.*)\]$", "$1")
    return let(F.regexp_replace(bare, r"\.+$", ""), lambda h: F.when((h != "") & ~h.rlike(r"[\s\x00-\x1f]"), h))


def canonical_hosts(df: DataFrame, host_col: str) -> DataFrame:
    """N1 in full: df with its host normalized, IPv6 addresses in their shortest form and names beyond ASCII in IDNA's
    ASCII form; null where there is no such form. Plain hosts stay native, of the others each distinct one is read once."""
    import ipaddress

    @F.arrow_udf("string")
    def written(batch: pa.Array) -> pa.Array:
        out = []
        for host in batch.to_pylist():
            try:
                out.append(str(ipaddress.ip_address(host)) if ":" in host else host.encode("idna").decode("ascii"))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    rows = df.withColumn(host_col, normalize_host(quoted(host_col)))
    special = quoted(host_col).rlike(r"[^\x00-\x7f]|:")
    key, form = (next(n for n in (f"_{name}" + "_" * i for i in range(len(df.columns) + 1)) if n not in df.columns) for name in ("host", "form"))
    forms = rows.filter(special).select(quoted(host_col).alias(key)).distinct().withColumn(form, written(F.col(key)))
    out = rows.join(broadcast_if_small(forms), quoted(host_col) == F.col(key), "left")
    return out.withColumn(host_col, F.when(special, F.col(form)).otherwise(quoted(host_col))).drop(key, form)


def suffixes(host: Column) -> Column:
    """All suffixes of a host at label borders, the whole host first."""
    return let(F.split(host, r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))


def identify_service(df: DataFrame, host_col: str, services: DataFrame) -> DataFrame:
    """Df with service: localhost, IP address, the first entry of (suffix, service, rank) that fits, or the last two labels.

    Hosts are expanded into their suffixes and joined by equality, once per distinct host; services is small.
    """
    host = F.col(host_col)
    hosts = df.select(host.alias("_host")).distinct()
    each = hosts.select("_host", F.explode(suffixes(F.col("_host"))).alias("suffix")).join(broadcast_if_small(services), "suffix")
    found = each.groupBy("_host").agg(F.min_by("service", "rank").alias("_service"))
    last = F.when(host.contains("."), F.substring_index(host, ".", -2)).otherwise(host)
    known = F.when((host == "localhost") | host.endswith(".localhost"), "Localhost").when(host.rlike(V4) | host.contains(":"), "IP address")
    return df.join(found, host == F.col("_host"), "left").withColumn("service", F.coalesce(known, "_service", last)).drop("_host", "_service")


def ip_number(ip: Column) -> Column:
    """A dotted quad as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x.try_cast("bigint"))
    return F.when(ip.rlike(V4), number)


def _range(cidr: str) -> tuple[int, int]:
    import ipaddress

    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


#: Networks of each scope, in the order in which they are asked.
SCOPES = (
    ("loopback", ("127.0.0.0/8",)),
    ("link-local", ("169.254.0.0/16",)),
    ("private", ("0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/29", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")),
    ("multicast", ("224.0.0.0/4",)),
)


def ip_scope(ip: Column) -> Column:
    """Unresolved, hostname, or the scope of an address; IPv6 by its leading digits, IPv4 within IPv6 as IPv4."""
    low = F.lower(ip)
    within = let(F.when(ip.contains(":"), ip_bits(ip)), lambda bits: F.when(bits.startswith("4"), F.conv(F.right(bits, F.lit(32)), 2, 10).cast("bigint")))

    def of(number: Column) -> Column:
        out = F.when(ip.isNull() | (ip == ""), "unresolved")
        for name, nets in SCOPES:
            inside = F.lit(False)
            for lo, hi in map(_range, nets):
                inside = inside | number.between(lo, hi)
            out = out.when(inside, name)
        out = out.when(number.isNotNull(), "public").when(~ip.contains(":"), "hostname")
        out = out.when(low == "::1", "loopback").when(low.rlike("^fe[89ab]"), "link-local").when(low.rlike("^f[cd]"), "private")
        return out.when(low.startswith("ff"), "multicast").when(low == "::", "reserved").otherwise("public")

    return let(F.coalesce(ip_number(ip), within), of)


def sanitize_path(path: Column) -> Column:
    """Without query and fragment; UUIDs, long mixed tokens, credential names and what follows them are redacted."""
    plain = F.regexp_replace(path, r"(?s)[?#].*$", "")

    def cleaned(parts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.try_element_at(parts, i)).otherwise("")
            hide = (x != "") & (before.rlike(SENSITIVE) | x.rlike(UUID) | x.rlike(LONG_TOKEN) | x.rlike(SENSITIVE))
            return F.when(hide, "[redacted]").otherwise(x)

        return F.array_join(F.transform(parts, one), "/")

    out = let(F.split(F.when(plain == "", "/").otherwise(plain), "/"), cleaned)
    return F.when(path.isNull() | (path == ""), None).otherwise(F.when(out == "", "/").otherwise(out))


def _url(part: str, url: Column) -> Column:
    return F.try_parse_url(url, F.lit(part))


def sanitize_url(url: Column) -> Column:
    """Scheme, host, port and clean path; what is no address is cleaned as a path."""
    host = normalize_host(F.regexp_replace(F.regexp_replace(_url("AUTHORITY", url), r"^.*@", ""), r":[0-9]*$", ""))
    port = F.regexp_extract(_url("AUTHORITY", url), r":([0-9]+)$", 1)
    path = F.coalesce(sanitize_path(_url("PATH", url)), F.lit("/"))
    whole = F.concat(F.lower(_url("PROTOCOL", url)), F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), path)
    return F.when(url.isNull() | (url == ""), None).when(host.isNotNull() & _url("PROTOCOL", url).isNotNull(), whole).when(url.contains("://"), "[invalid URL redacted]").otherwise(sanitize_path(url))


HOOK = "hook_event_name string, tool_name string, tool_use_id string, tool_input map<string, string>"


def sanitize_tool_event(payload: Column) -> Column:
    """struct<event, tool, target, correlation_id> of a JSON payload; its content is never kept."""

    def of(p: Column) -> Column:
        tool = F.coalesce(p["tool_name"], F.lit("unknown"))
        url = sanitize_url(F.try_element_at(p["tool_input"], F.lit("url")))
        hidden = F.lit("tool input redacted")
        target = (
            F.when(tool == "WebFetch", url)
            .when(tool == "WebSearch", "search query redacted")
            .when(tool == "Bash", "shell command redacted")
            .when(F.lower(tool).contains("browser") | tool.startswith("mcp__"), F.coalesce(url, hidden))
            .when(F.size(p["tool_input"]) > 0, hidden)
        )
        return F.struct(F.coalesce(p["hook_event_name"], F.lit("PreToolUse")).alias("event"), tool.alias("tool"), target.alias("target"), p["tool_use_id"].alias("correlation_id"))

    return let(F.from_json(payload, HOOK), of)


def redact_command(argv: Column) -> Column:
    """The program, and a marker for its arguments."""
    return F.when(F.size(argv) > 1, F.array(argv[0], F.lit("[arguments redacted]"))).otherwise(argv)


def parse_destination(value: Column, protocol: str = "https") -> Column:
    """struct<host, port, protocol> of a URL, host[:port] or [v6]:port; null where host or port are not valid."""
    raw = F.trim(value)
    scheme = F.when(raw.contains("://"), F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))).otherwise(protocol)
    authority = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)[/?#].*$", ""), r"^.*@", "")
    host = F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)(?::([0-9]+))?$", 1)
    given = F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)(?::([0-9]+))?$", 2)
    usual = F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv])
    port = F.when(given != "", given.try_cast("int")).otherwise(F.try_element_at(usual, scheme))
    good = normalize_host(host).isNotNull() & port.between(1, 65535)
    return F.when(good, F.struct(normalize_host(host).alias("host"), port.alias("port"), scheme.alias("protocol")))


def host_patterns(rules: DataFrame) -> DataFrame:
    """(rule, key, how) of the host selectors: how is exact, below (not the apex) or within (apex included)."""
    each = rules.select(F.col("id").alias("rule"), F.explode("hosts").alias("pattern"))
    key = F.regexp_replace("pattern", r"^\*{1,2}\.", "")
    how = F.when(F.col("pattern") == "*", "any").when(F.col("pattern").startswith("**."), "within").when(F.col("pattern").startswith("*."), "below").otherwise("exact")
    return each.select("rule", F.lower(key).alias("key"), how.alias("how"))


def host_matches(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, rule) where a host selector fits, by equality joins on suffixes; rules are few."""
    patterns = broadcast_if_small(host_patterns(rules))
    each = hosts.select("host", F.posexplode(suffixes(F.col("host"))).alias("depth", "key"))
    fits = ((F.col("how") == "exact") & (F.col("depth") == 0)) | ((F.col("how") == "below") & (F.col("depth") > 0)) | (F.col("how") == "within")
    some = each.join(patterns, "key").filter(fits).select("host", "rule")
    anywhere = _ids(rules.filter(F.array_contains("hosts", "*")))
    return some.union(hosts.select("host", F.explode(anywhere).alias("rule"))).distinct()


def _ids(rules: DataFrame) -> Column:
    """The ids of some rules as an array; a rule table is a configuration of at most a few thousand rows."""
    return F.array(*[F.lit(r["id"]) for r in rules.select("id").collect()]).cast("array<string>")


def ip_bits(ip: Column) -> Column:
    """An address as its family, 4 or 6, and its bits as text; null for anything else. IPv4 written as IPv6 is IPv4."""
    low = F.lower(ip)
    dotted = F.regexp_extract(low, r"([0-9.]+)$", 1)
    pair = let(F.lpad(F.lower(F.hex(ip_number(dotted))), 8, "0"), lambda h: F.concat(F.left(h, F.lit(4)), F.lit(":"), F.right(h, F.lit(4))))
    plain = F.when(low.rlike(r":[0-9]+(?:\.[0-9]+){3}$"), F.concat(F.left(low, F.length(low) - F.length(dotted)), pair)).otherwise(low)

    def groups(halves: Column) -> Column:
        parts = F.transform(halves, lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":")))
        zeros = lambda p: F.array_repeat(F.lit("0"), F.lit(8) - F.size(p[0]) - F.size(p[1]))
        return let(parts, lambda p: F.when(F.size(p) == 1, p[0]).when(F.size(p[0]) + F.size(p[1]) < 8, F.concat(p[0], zeros(p), p[1])))

    def bits(g: Column) -> Column:
        good = (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(g, lambda x: F.lpad(F.conv(x, 16, 2), 16, "0")), ""))

    mapped = "0" * 80 + "1" * 16
    v6 = let(let(F.split(plain, "::", 2), groups), bits)
    six = let(v6, lambda b: F.when(b.startswith(mapped), F.concat(F.lit("4"), F.right(b, F.lit(32)))).otherwise(F.concat(F.lit("6"), b)))
    four = F.concat(F.lit("4"), F.lpad(F.bin(ip_number(ip)), 32, "0"))
    return F.when(ip.rlike(V4), four).when(plain.rlike("^[0-9a-f:]*:[0-9a-f:]*$"), six)


def _networks(cidr: Column) -> Column:
    """struct<bits, size> of a network: family and bits of its base, and how many of them, family included, it fixes."""
    bits = ip_bits(F.substring_index(cidr, "/", 1))
    whole = F.when(bits.startswith("4"), 32).when(bits.isNotNull(), 128)
    size = F.when(cidr.contains("/"), F.when(F.substring_index(cidr, "/", -1).rlike("^[0-9]{1,3}$"), F.substring_index(cidr, "/", -1).cast("int"))).otherwise(whole)
    return F.struct(bits.alias("bits"), F.when(size <= whole, size + 1).alias("size"))


def network_matches(ips: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (ip, rule) where an address, IPv4 or IPv6, lies in a network of a rule.

    A network joins by its leading bits: each distinct address is cut to every prefix length in use.
    """
    nets = rules.select(F.col("id").alias("rule"), F.explode("ips").alias("cidr"))
    nets = nets.select("rule", _networks(F.col("cidr")).alias("n")).select("rule", F.expr("left(n.bits, n.size)").alias("lead"))
    nets = nets.filter("lead is not null").withColumn("size", F.length("lead"))
    sizes = sorted(r["size"] for r in nets.select("size").distinct().collect())  # 162 at most
    addresses = ips.select("ip").distinct().select("ip", ip_bits(F.col("ip")).alias("bits")).filter("bits is not null")
    each = addresses.select("ip", F.explode(F.array(*[F.left("bits", F.lit(k)) for k in sizes]).cast("array<string>")).alias("lead"))
    return each.distinct().join(broadcast_if_small(nets), "lead").select("ip", "rule").distinct()


def check_rules(rules: DataFrame) -> DataFrame:
    """Rules that must not be used, with the reason: repeated ids, no selector, networks, ports or protocols that do not
    exist."""
    n = F.count("*").over(Window.partitionBy("id"))
    reason = (
        F.when(n > 1, "repeated id")
        .when(F.size("hosts") + F.size("ips") + F.size("ports") + F.size("protocols") <= 0, "no selector")
        .when(F.exists("ips", lambda c: _networks(c)["bits"].isNull() | _networks(c)["size"].isNull()), "bad network")
        .when(F.exists("ports", lambda p: ~p.between(1, 65535)), "bad port")
        .when(F.exists("protocols", lambda p: ~p.isin(*PORTS)), "bad protocol")
    )
    return rules.select("id", reason.alias("reason")).filter("reason is not null")


#: Bits of a word of a bitmap of rules, and rules of a table at most: all bitmaps of so many take some 13 MB.
BITS, MOST_RULES = 62, 10_000


def _both(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.bitwiseAND(b))


def _either(maps: Column, none: Column) -> Column:
    """All bitmaps of an array, and one more, put together."""
    return F.aggregate(maps, none, lambda acc, m: F.zip_with(acc, m, lambda x, y: x.bitwiseOR(y)))


def _lowest(words: Column) -> Column:
    """The number of the lowest bit that is set; null where none is."""
    first = F.array_position(F.transform(words, lambda w: w != 0), True)
    bit = lambda w: F.bit_count(w.bitwiseAND(-w) - 1)
    return F.when(first > 0, ((first - 1) * BITS + let(F.element_at(words, first.cast("int")), bit)).cast("int"))


class RuleBitmaps:
    """A rule table as bitmaps: bit k stands for the k-th rule in the order in which they are asked. Rules are a
    configuration, and come to the driver."""

    def __init__(self, rules: DataFrame):
        self.spark = rules.sparkSession
        self.rules = rules.orderBy("rank", "id").limit(MOST_RULES + 1).collect()
        if len(self.rules) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        self.bit = {r["id"]: k for k, r in enumerate(self.rules)}
        nets = rules.select("id", F.explode("ips").alias("cidr")).select("id", _networks(F.col("cidr")).alias("n"))
        self.leads = nets.select("id", F.expr("left(n.bits, n.size)").alias("lead")).collect()

    def words(self, bits) -> list[int]:
        out = [0] * max(1, -(-len(self.rules) // BITS))
        for k in bits:
            out[k // BITS] |= 1 << k % BITS
        return out

    def those(self, fits) -> Column:
        """The bitmap of the rules that fit, in the plan."""
        return F.split(F.lit(",".join(map(str, self.words(k for k, r in enumerate(self.rules) if fits(r))))), ",").cast("array<bigint>")

    def table(self, schema: str, pairs) -> DataFrame:
        """A row for each key of the pairs (key, rule's bit), with its bitmap; as many as the rules have selectors."""
        bits: dict[tuple, list[int]] = {}
        for key, k in pairs:
            bits.setdefault(key, []).append(k)
        return F.broadcast(self.spark.createDataFrame([(*key, self.words(own)) for key, own in bits.items()], f"{schema}, words array<bigint>"))

    def of_hosts(self, hosts: DataFrame) -> DataFrame:
        """(host, words): by the suffixes of each host."""
        pairs = []
        for k, r in enumerate(self.rules):
            for pattern in r["hosts"] or ():
                how = "within" if pattern.startswith("**.") else "below" if pattern.startswith("*.") else "exact"
                pairs.append(((pattern.lower().removeprefix("**.").removeprefix("*."), how), k))
        each = hosts.select("host", F.posexplode(suffixes(F.col("host"))).alias("depth", "key"))
        fits = ((F.col("how") == "exact") & (F.col("depth") == 0)) | ((F.col("how") == "below") & (F.col("depth") > 0)) | (F.col("how") == "within")
        return each.join(self.table("key string, how string", pairs), "key").filter(fits).select("host", "words")

    def of_ips(self, ips: DataFrame) -> DataFrame:
        """(ip, words): by the leading bits of each address, of every length in use."""
        pairs = [((r["lead"],), self.bit[r["id"]]) for r in self.leads]
        sizes = sorted({len(lead) for (lead,), _ in pairs})
        each = ips.select("ip", ip_bits(F.col("ip")).alias("bits")).filter("bits is not null")
        each = each.select("ip", F.explode(F.array(*[F.left("bits", F.lit(k)) for k in sizes]).cast("array<string>")).alias("lead"))
        return each.join(self.table("lead string", pairs), "lead").select("ip", "words")


def evaluate_policy(events: DataFrame, rules: DataFrame, default: str = "deny", mode: str = "audit") -> DataFrame:
    """Events (event_id, host, ip, port, protocol) with rule_id, action and outcome, a row for each.

    rules: id, rank, action, hosts, ips, ports, protocols, allow_private; a category without entries fits all. The first
    deny beats the first allow; without either the default holds; restricted scopes need an allow with
    allow_private. A null host, address, port or protocol fits no selector, `*` included. A rule table with errors allows
    nothing and raises, as does one of more than MOST_RULES.

    Each selector becomes a bitmap of the rules that have it, in the order of their rank. Every distinct host, address,
    port and protocol looks its bitmap up by equality joins; per distinct destination the four are put together by AND,
    and the lowest bit among those of each action is the rule. Events join the decisions of their destination: there is
    no row per event and rule.
    """
    bad = check_rules(rules).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"rule {r['id']}: {r['reason']}" for r in bad))
    maps, to = RuleBitmaps(rules), ("host", "ip", "port", "protocol")
    with scratch(events.sparkSession) as own:
        seen = own.keep(staged(events.select(*to).distinct(), "destinations"))
    each = lambda c, entries: [((v,), k) for k, r in enumerate(maps.rules) for v in r[entries] or ()]
    free = {
        "host": maps.those(lambda r: not r["hosts"]), "ip": maps.those(lambda r: not r["ips"]),
        "port": maps.those(lambda r: not r["ports"]), "protocol": maps.those(lambda r: not r["protocols"]),
    }
    any_host = maps.those(lambda r: not r["hosts"] or "*" in r["hosts"])
    found = {c: maps_of(seen.select(c).distinct()).groupBy(c).agg(_either(F.collect_list("words"), least).alias(f"_{c}")) for c, maps_of, least in (("host", maps.of_hosts, any_host), ("ip", maps.of_ips, free["ip"]))}
    for c, kind, entries in (("port", "int", "ports"), ("protocol", "string", "protocols")):
        found[c] = maps.table(f"{c} {kind}", each(c, entries)).select(c, _either(F.array("words"), free[c]).alias(f"_{c}"))
    free["host"] = F.when(F.col("host").isNotNull(), any_host).otherwise(free["host"])
    for c in to:
        seen = seen.join(found[c], c, "left").withColumn(f"_{c}", F.coalesce(F.col(f"_{c}"), free[c]))
    seen = seen.select(*to, _both(_both(F.col("_host"), F.col("_ip")), _both(F.col("_port"), F.col("_protocol"))).alias("_fits"))
    among = lambda fit: _lowest(_both(F.col("_fits"), maps.those(fit)))
    seen = seen.select(
        *to, among(lambda r: r["action"] == "deny").alias("_deny"), among(lambda r: r["action"] == "allow").alias("_allow"),
        among(lambda r: r["action"] == "allow" and r["allow_private"]).isNotNull().alias("_private"),
    )
    action = F.when(F.col("_deny").isNotNull(), "deny").when(F.col("_allow").isNotNull(), "allow").otherwise(default)
    refused = (action == "allow") & ip_scope(F.coalesce("ip", "host")).isin(*RESTRICTED) & ~F.col("_private")
    names = F.from_json(F.lit(json.dumps([r["id"] for r in maps.rules])), "array<string>")
    outcome = F.when(F.col("action") == "allow", "allowed").otherwise("would_block" if mode == "audit" else "blocked")
    judged = seen.select(F.struct(*to).alias("_to"), F.when(~refused, F.get(names, F.coalesce("_deny", "_allow"))).alias("rule_id"), F.when(refused, "deny").otherwise(action).alias("action"))
    judged = judged.withColumn("outcome", outcome)
    return events.select("event_id", F.struct(*to).alias("_to")).join(judged, "_to").select("event_id", "rule_id", "action", "outcome")


def multi_address(events: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """Events with an array ips: each address is judged, and any deny decides."""
    each = events.select("event_id", "host", F.explode_outer("ips").alias("ip"), "port", "protocol")
    each = each.withColumn("event_id", F.struct(F.col("event_id").alias("e"), F.coalesce("ip", F.lit("")).alias("i")))
    judged = evaluate_policy(each, rules, **options)
    worst = F.min(F.struct(F.when(F.col("action") == "deny", 0).otherwise(1).alias("k"), F.col("event_id.i").alias("ip"), "action", "outcome"))
    return judged.groupBy(F.col("event_id.e").alias("event_id")).agg(worst.alias("w")).select("event_id", "w.action", "w.outcome")


def _counts() -> list[Column]:
    """Totals of the events of a group; what is not public, a null scope included, is local or private."""
    seen, public = F.col("event_id").isNotNull(), F.col("scope").eqNullSafe("public")
    return [
        F.count_if(seen).alias("events"),
        *[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS],
        F.count_if(seen & public).alias("public"),
        F.count_if(seen & ~public).alias("local_private"),
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes_sent"),
        F.coalesce(F.sum("bytes_received"), F.lit(0)).alias("bytes_received"),
        F.count_distinct("service").alias("services"),
    ]


def session_report(sessions: DataFrame, events: DataFrame, tools: DataFrame) -> DataFrame:
    """Totals of every session, those without events included."""
    totals = events.groupBy("session_id").agg(*_counts())
    tool = tools.groupBy("session_id").agg(F.count("*").alias("tool_events"))
    out = sessions.select("session_id").join(totals, "session_id", "left").join(tool, "session_id", "left")
    return out.na.fill(0)


def destination_rollup(events: DataFrame) -> DataFrame:
    """One row per destination with counts by decision, bytes, first and last sight and paths."""
    return events.groupBy(*DESTINATION).agg(
        F.count("*").alias("events"), *[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS],
        F.sum("bytes_sent").alias("bytes_sent"), F.sum("bytes_received").alias("bytes_received"), F.min("started_at").alias("first_seen"),
        F.max(F.coalesce("ended_at", "started_at")).alias("last_seen"), F.array_sort(F.collect_set("path")).alias("paths"),
    )


def overview(sessions: DataFrame, events: DataFrame, destination: Sequence[str] = DESTINATION) -> DataFrame:
    """Totals, by agent, by source and by destination, in one pass of grouping sets.

    Every session adds a row without an event, so that sessions without events count in the totals. `running` is null
    for sources and destinations, which have no sessions of their own.
    """
    each = sessions.select("session_id", "agent", "status")
    both = events.join(each.drop("status"), "session_id").unionByName(each, allowMissingColumns=True)
    keys = [F.col(c) for c in ("agent", "source", *destination)]
    sets = [[], [keys[0]], [keys[1]], keys[2:]]
    level = F.when(F.grouping("agent") == 0, "agent").when(F.grouping("source") == 0, "source").when(F.grouping("host") == 0, "destination").otherwise("total")
    running = F.when((F.grouping("source") == 1) & (F.grouping("host") == 1), F.count_if(F.col("status").isin("starting", "running")))
    out = both.groupingSets(sets, *keys).agg(
        level.alias("level"), *_counts(), F.count_distinct("session_id").alias("sessions"), running.alias("running"),
        F.array_sort(F.collect_set(F.when(F.col("event_id").isNotNull(), F.col("agent")))).alias("agents"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    return out.filter("events > 0 or level = 'total'")


def evidence_ledger(events: DataFrame, tools: DataFrame) -> DataFrame:
    """Network and tool events as one labelled table of the columns of LEDGER, safe for spreadsheets; columns
    that a side does not have are null, and columns beyond the layout stay out."""

    def laid_out(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
        there = {c: quoted(c) for c in rows.columns} | named
        return rows.select(*[there.get(c, F.lit(None)).cast(LEDGER[c]).alias(c) for c in LEDGER])

    net = laid_out(events, {"record_type": F.lit("network_event"), "occurred_at": F.col("started_at")})
    hooks = {"record_type": F.lit("tool_event"), "source": F.lit("agent-hook"), "detail": F.col("event") if "event" in tools.columns else F.lit(None)}
    return ledger_safe(net.unionByName(laid_out(tools, hooks)))


def list_sessions(sessions: DataFrame, limit: int) -> DataFrame:
    """The newest sessions first."""
    return sessions.orderBy(F.col("started_at").desc(), "session_id").limit(limit)


def retain(sessions: DataFrame, events: DataFrame, delete: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays when the sessions named in delete go: only those that are not running, and their events."""
    gone = sessions.join(delete.select("session_id"), "session_id", "left_semi").filter("status <> 'running'").select("session_id")
    return sessions.join(gone, "session_id", "left_anti"), events.join(gone, "session_id", "left_anti")


def retain_partitions(spark: SparkSession, path: str, sessions: DataFrame, delete: DataFrame, day: str = "day") -> list:
    """N17 on evidence in files partitioned by day: the events of sessions that go (see `retain`) are taken out, and only
    the partitions that hold some are written anew; the files of other days stay as they are. The new partitions are
    written to the shared folder before any is replaced. Returns the days that were touched.

    Days left without events are removed. A lost executor repeats its task; a driver that ends in between leaves whole
    partitions, old or new, and the call can be repeated.
    """
    gone = sessions.join(delete.select("session_id"), "session_id", "left_semi").filter("status <> 'running'").select("session_id")
    events = spark.read.parquet(path)
    touched = [r[0] for r in events.join(gone, "session_id", "left_semi").select(day).distinct().collect()]  # partitions
    if not touched:
        return []
    own = F.lit(False)
    for value in touched:
        own = own | F.col(day).eqNullSafe(F.lit(value))
    with scratch(spark):
        left = staged(events.filter(own).join(gone, "session_id", "left_anti"), "retained")
        kept = [r[0] for r in left.select(day).distinct().collect()]
        if kept:
            left.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for value in touched:
        if value not in kept:
            name = "__HIVE_DEFAULT_PARTITION__" if value is None else value
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"{day}={name}"), True)
    return sorted(touched, key=str)


def merge_phases(rows: DataFrame, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """Rows of opening and closing an event merged: the latest filled detail, decision and bytes of each."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return rows.groupBy(*keys).agg(
        F.min(F.when(F.col("phase") == "open", F.col("at"))).alias("started_at"), F.max(F.when(F.col("phase") == "close", F.col("at"))).alias("ended_at"),
        *[last(c) for c in ("detail", "decision", "bytes_sent") if c in rows.columns],
    )


def dedupe(rows: DataFrame) -> DataFrame:
    """The first row of each session and fingerprint; rows without a fingerprint all stay. Each task keeps the first
    of its own repeats before anything shuffles."""
    first = F.min_by(F.struct(*map(quoted, rows.columns)), F.struct("started_at", "event_id")).alias("_row")
    marked = rows.filter("fingerprint is not null").groupBy("session_id", "fingerprint").agg(first).select("_row.*")
    return marked.unionByName(rows.filter("fingerprint is null"))
