"""Queries about personal data: detection (P) and pseudonyms (R)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import detect, scrub
from millrace.operators.typing import value_histogram
from millrace.plans.views import dealt, table

SALT = b"millrace-test-salt"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with made-up personal data in every layout."""
    k = F.col("c_custkey")
    pad = lambda n, width: F.lpad(n.cast("string"), width, "0")
    area = 100 + k % 500
    fields = {
        "email": F.concat(F.lit("user"), k.cast("string"), F.lit("@mail"), (k % 9).cast("string"), F.lit(".example.com")),
        "phone": F.concat(F.lit("("), (200 + k % 700).cast("string"), F.lit(") 555-"), pad(k % 10000, 4)),
        "ssn": F.concat_ws("-", area.cast("string"), pad(1 + k % 99, 2), pad(1 + k % 9999, 4)),
        "card": _card(F.concat(F.lit("4"), pad(k * 7919 % 100000000, 14))),
        "ip": F.concat_ws(".", 1 + k % 254, k % 256, (k * 3) % 256, (k * 7) % 256),
        "name": F.when(k % 3 == 0, "Alice Smith").when(k % 3 == 1, "Bob").otherwise("Zyx Qwv"),
        "secret": F.concat(F.lit("AKIA"), pad(k, 16)),
        "segment": F.col("c_mktsegment"),
    }
    return dealt(table(spark, sf_dir, "customer")).select(k, *[c.alias(n) for n, c in fields.items()])


def _card(payload: Column) -> Column:
    return F.concat(payload, scrub.luhn_digit(payload))


_CARD_SQL = """(CASE WHEN true THEN p || ((10 - (list_reduce(list_transform(range(length(p)), lambda i:
  CASE WHEN i % 2 = 1 THEN reverse(p)[i + 1]::INT WHEN reverse(p)[i + 1]::INT > 4 THEN reverse(p)[i + 1]::INT * 2 - 9 ELSE reverse(p)[i + 1]::INT * 2 END), lambda a, b: a + b) % 10)) % 10)::VARCHAR END)"""
CONTACTS = f"""pay AS (SELECT c_custkey AS k, c_mktsegment, '4' || lpad((c_custkey * 7919 % 100000000)::VARCHAR, 14, '0') AS p FROM customer),
contacts AS (SELECT k AS c_custkey, 'user' || k || '@mail' || (k % 9) || '.example.com' AS email, '(' || (200 + k % 700) || ') 555-' || lpad((k % 10000)::VARCHAR, 4, '0') AS phone,
  (100 + k % 500) || '-' || lpad((1 + k % 99)::VARCHAR, 2, '0') || '-' || lpad((1 + k % 9999)::VARCHAR, 4, '0') AS ssn, {_CARD_SQL} AS card,
  (1 + k % 254) || '.' || (k % 256) || '.' || (k * 3 % 256) || '.' || (k * 7 % 256) AS ip,
  CASE k % 3 WHEN 0 THEN 'Alice Smith' WHEN 1 THEN 'Bob' ELSE 'Zyx Qwv' END AS "name", 'AKIA' || lpad(k::VARCHAR, 16, '0') AS secret, c_mktsegment AS segment FROM pay)"""


def _spans(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return detect.scan_spans(_docs(spark, sf_dir).select("doc_id", "text"), "text", (kind,)).select("doc_id", "start", "end", "value")


def p1_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "email")


def p2_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "phone")


def p3_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of contacts between others whose area, group or serial no one has."""
    texts = _contacts(spark, sf_dir).select("c_custkey", F.concat_ws(" ", "segment", F.lit("666-12-3456"), "ssn", F.lit("900-12-3456, 123-00-4567 or 123-45-0000")).alias("text"))
    return detect.scan_spans(texts, "text", ("ssn",)).select("c_custkey", "start", "end", "value")


def p4_credit_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "credit_card").groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def p5_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir, "ip")


def p6_prefixed_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.scan_spans(_contacts(spark, sf_dir).select("c_custkey", F.concat_ws(" ", "segment", "secret", "email").alias("text")), "text", ("secret",))
    return found.select("c_custkey", "start", "end", "value")


def p7_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("url", F.lit(r"\S{20,}"), F.lit(0))).alias("token"))
    return tokens.select("page_id", "token", detect.entropy(F.col("token")).alias("bits"), detect.valid_token(F.col("token")).alias("valid"))


def p8_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contacts(spark, sf_dir).select("c_custkey", detect.is_name(F.col("name")).alias("is_name"))


def p9_scan_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan_spans(_docs(spark, sf_dir).select("doc_id", "text"), "text")


def p10_scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contacts(spark, sf_dir).select("email", "ssn", "card", "ip", "name", "secret", "segment")
    return detect.scan_table(rows).select("column", "kind", "confidence", "hit_rate")


def p11_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.even_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus", 500)


def p12_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"email": "email", "phone": "phone", "ssn": "ssn", "card": "credit_card", "ip": "ip", "name": "name", "secret": "secret"}
    return _contacts(spark, sf_dir).select("c_custkey", *[detect.mask_value(F.col(c), F.lit(k)).alias(c) for c, k in kinds.items()])


def p13_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.pii_by_group(_docs(spark, sf_dir), ["source", "lang"], "text", "doc_id", ("email", "ip", "ssn"))


def r1_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", scrub.hmac_sha256(F.col("c_name"), SALT).alias("digest"))


def _faked(spark: SparkSession, sf_dir: str, column: str, kind: str) -> DataFrame:
    return scrub.scrub_column(_contacts(spark, sf_dir).select("c_custkey", column), column, kind, SALT)


def r2_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faked(spark, sf_dir, "phone", "phone")


def r3_ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faked(spark, sf_dir, "ssn", "ssn")


def r4_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contacts(spark, sf_dir).select("c_custkey", F.col("card").alias("old"), scrub.fake(F.col("card"), "credit_card", SALT).alias("new"))


def r5_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faked(spark, sf_dir, "ip", "ip")


def r6_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _contacts(spark, sf_dir).select(
        "c_custkey", *[scrub.fake(F.col(c), c, SALT).alias(c) for c in ("email", "name", "secret")], F.size(F.split("name", " ")).alias("words")
    )
    return out.select("c_custkey", F.col("email").endswith(".com").alias("same_top"), (F.size(F.split("name", " ")) == F.col("words")).alias("same_words"), "secret")


def r7_scrub_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contacts(spark, sf_dir).select("c_custkey", scrub.fake(F.when(F.col("c_custkey") % 5 != 0, F.col("secret")), "secret", SALT).alias("secret"))


def r8_scrub_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _docs(spark, sf_dir).select("doc_id", "text", scrub.scrub_spans(F.col("text"), SALT).alias("s"))
    return out.select("doc_id", F.sha2("s.text", 256).alias("sha256"), F.size("s.replaced").alias("replaced"))


def r9_scrub_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub.scrub_table(_contacts(spark, sf_dir).select("email", "ssn", "ip", "segment"), SALT)


def r10_scrub_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return scrub.scrub_lines(lines, SALT).select("doc_id", "pos", F.sha2("line", 256).alias("sha256"))


def r11_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contacts(spark, sf_dir).select("email", "ip", F.concat_ws(" ", F.lit("from"), "ip").alias("note"))
    return scrub.summary(scrub.mapping(rows, SALT, {"email": "email", "ip": "ip"}, ("email", "ip")))


def r12_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contacts(spark, sf_dir).select("email", "ip")
    plan = {"email": "email"}
    mapped = scrub.mapping(rows.select("email"), SALT, plan, ("email",))
    half = rows.withColumn("email", scrub.fake(F.col("email"), "email", SALT))
    return scrub.residual(half, mapped, ("email", "ip"))


def r13_join_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("user"))
    people = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("user"))
    left, right = (scrub.scrub_column(t, "user", "secret", SALT, key="user_key") for t in (orders, people))
    return left.join(right, ["user_key", "user"]).groupBy("c_custkey").agg(F.count("*").alias("orders"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_email, p2_phone, p3_ssn, p4_credit_card, p5_ip, p6_prefixed_secret, p7_entropy, p8_name, p9_scan_spans, p10_scan_table, p11_even_sample, p12_mask,
        p13_by_group, r1_hmac, r2_phone, r3_ssn, r4_card, r5_ip, r6_pools, r7_scrub_column, r8_scrub_spans, r9_scrub_table, r10_scrub_lines, r11_summary,
        r12_residual, r13_join_kept,
    )
}



def _guarded(pattern: str, before: str, after: str, good: str) -> str:
    """Spans of a pattern none of whose matches touch each other, with guards checked on the neighbouring characters."""
    return f"""WITH m AS (
  SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM documents
), p AS (
  SELECT doc_id, text, unnest(m) AS value, unnest(list_transform(range(1, len(m) + 1), lambda i:
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::INT AS s FROM m WHERE len(m) > 0
)
SELECT doc_id, s AS "start", s + length(value) AS "end", value FROM p
WHERE NOT regexp_matches(substr(text, s, CASE WHEN s = 0 THEN 0 ELSE 1 END), '{before}') AND NOT regexp_matches(substr(text, s + length(value) + 1, 1), '{after}') AND {good}"""


_D = "regexp_replace(value, '[ -]', '', 'g')"
_LUHN = f"""list_reduce(list_transform(range(length({_D})), lambda i: CASE WHEN i % 2 = 0 THEN reverse({_D})[i + 1]::INT
  WHEN reverse({_D})[i + 1]::INT > 4 THEN reverse({_D})[i + 1]::INT * 2 - 9 ELSE reverse({_D})[i + 1]::INT * 2 END), lambda a, b: a + b) % 10 = 0"""
_ENTROPY = """(SELECT -sum(c / t * log2(c / t)) FROM (SELECT count(*)::DOUBLE AS c, sum(count(*)) OVER () AS t FROM (SELECT unnest(string_split(token, '')) AS ch) WHERE ch <> '' GROUP BY ch))"""
_KEY = SALT.ljust(64, b"\0")
_PAD = {x: "unhex('" + bytes(b ^ x for b in _KEY).hex() + "')" for x in (0x36, 0x5C)}


def _hmac(value: str) -> str:
    return f"sha256({_PAD[0x5C]} || unhex(sha256({_PAD[0x36]} || encode({value}))))"


def _byte(i: int) -> str:
    return f"('0x' || substr(h, {2 * i + 1}, 2))::INT"


_PHONE_DIGITS = " || ".join(f"({_byte(i)} % 10)::VARCHAR" for i in range(10))
_CARD_DIGITS = " || ".join(f"({_byte(i)} % 10)::VARCHAR" for i in range(15))
_MAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_QUAD = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
_MAILS = _guarded(_MAIL, r"[\w.+-]", r"[\w.-]", "true")
_IPS = _guarded(_QUAD, "[0-9.]", "[0-9.]", "list_max(list_transform(string_split(value, '.'), lambda x: x::INT)) <= 255")
#: Every other character is doubled, so that neighbouring numbers do not share the one between them.
_CARDS = f"""WITH m AS (
  SELECT doc_id, unnest(regexp_extract_all(regexp_replace('x' || text || 'x', '([^0-9])', '\\1\\1', 'g'), '[^0-9]((?:[0-9](?:  |--)?){{12,18}}[0-9])[^0-9]', 1)) AS m FROM documents
), v AS (SELECT doc_id, regexp_replace(m, '([ -])[ -]', '\\1', 'g') AS value FROM m)
SELECT doc_id, value, count(*) AS n FROM v WHERE {_LUHN} GROUP BY doc_id, value"""
_SSNS = _guarded(
    "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]", "[0-9]", "value[1:3] NOT IN ('000', '666') AND value[1:3] < '900' AND value[5:6] <> '00' AND value[8:11] <> '0000'"
)
_FAKE_IP = " || '.' || ".join(f"least(254, greatest(1, {_byte(i)}))" for i in range(4))

SQL = {
    "p1_email": _MAILS,
    "p3_ssn": f"""WITH {CONTACTS} SELECT c_custkey, length(segment) + 13 AS "start", length(segment) + 24 AS "end", ssn AS value FROM contacts""",
    "p4_credit_card": _CARDS,
    "p5_ip": _IPS,
    "p6_prefixed_secret": f"""WITH {CONTACTS} SELECT c_custkey, length(segment) + 1 AS "start", length(segment) + 21 AS "end", secret AS value FROM contacts""",
    "p7_entropy": f"WITH t AS (SELECT page_id, unnest(regexp_extract_all(url, '[^ ]{{20,}}')) AS token FROM pages) SELECT *, bits > 4.0 AND NOT regexp_matches(token, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]') AND NOT contains(lower(token), 'javascript:') AS valid FROM (SELECT page_id, token, {_ENTROPY} AS bits FROM t)",
    "p8_name": f'WITH {CONTACTS} SELECT c_custkey, "name" <> \'Zyx Qwv\' AS is_name FROM contacts',
    "p10_scan_table": f"""WITH {CONTACTS}, w AS (SELECT avg(CASE WHEN "name" <> 'Zyx Qwv' THEN 1 ELSE 0 END) AS r FROM contacts)
        SELECT * FROM (VALUES ('email', 'email', 1.0::DOUBLE, 1.0::DOUBLE), ('ssn', 'ssn', 1.0, 1.0), ('card', 'credit_card', 1.0, 1.0), ('ip', 'ip', 1.0, 1.0), ('secret', 'secret', 1.0, 1.0)) t("column", kind, confidence, hit_rate)
        UNION ALL SELECT 'name', 'name', r * 0.7, r FROM w WHERE r * 0.7 >= 0.5""",
    "p11_even_sample": """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, o_orderstatus FROM r WHERE n <= 500 OR i IN (SELECT round_even(k * (n - 1) / 499.0, 0)::BIGINT FROM range(500) t(k))""",
    "p12_mask": f"""WITH {CONTACTS} SELECT c_custkey, 'u***@m***.example.com' AS email, '***' || right(phone, 4) AS phone, '***' || right(ssn, 4) AS ssn, '***' || right(card, 4) AS card,
        string_split(ip, '.')[1] || '.***.***.***' AS ip, CASE "name" WHEN 'Alice Smith' THEN 'A*** S***' WHEN 'Bob' THEN 'B***' ELSE 'Z*** Q***' END AS "name", left(secret, 4) || '***' AS secret FROM contacts""",
    "p13_by_group": f"""WITH s AS (SELECT doc_id, 'email' AS kind FROM ({_MAILS}) UNION ALL SELECT doc_id, 'ip' FROM ({_IPS}) UNION ALL SELECT doc_id, 'ssn' FROM ({_SSNS}))
        SELECT source, lang, kind, count(*) AS spans, count(DISTINCT doc_id) AS docs FROM s JOIN documents USING (doc_id) GROUP BY source, lang, kind""",
    "r1_hmac": f"SELECT c_custkey, {_hmac('c_name')} AS digest FROM customer",
    "r2_phone": f"""WITH {CONTACTS}, h AS (SELECT c_custkey, phone, {_hmac("phone")} AS h FROM contacts), n AS (SELECT *, {_PHONE_DIGITS} AS n FROM h)
        SELECT c_custkey, '(' || n[1:3] || ') ' || n[4:6] || '-' || n[7:10] AS phone FROM n""",
    "r3_ssn": f"""WITH {CONTACTS}, h AS (SELECT c_custkey, {_hmac("ssn")} AS h FROM contacts)
        SELECT c_custkey, (100 + ({_byte(0)} * 256 + {_byte(1)}) % 566) || '-' || lpad((1 + {_byte(2)} % 99)::VARCHAR, 2, '0') || '-' || lpad((1 + ({_byte(3)} * 256 + {_byte(4)}) % 9999)::VARCHAR, 4, '0') AS ssn FROM h""",
    "r4_card": f"""WITH {CONTACTS}, h AS (SELECT c_custkey, card, {_hmac("card")} AS h FROM contacts), n AS (SELECT c_custkey, card, {_CARD_DIGITS} AS p FROM h)
        SELECT c_custkey, card AS old, {_CARD_SQL} AS "new" FROM n""",
    "r5_ip": f"WITH {CONTACTS}, h AS (SELECT c_custkey, {_hmac('ip')} AS h FROM contacts) SELECT c_custkey, {_FAKE_IP} AS ip FROM h",
    "r6_pools": f"WITH {CONTACTS} SELECT c_custkey, true AS same_top, true AS same_words, 'REDACTED_' || left({_hmac('secret')}, 8) AS secret FROM contacts",
    "r7_scrub_column": f"WITH {CONTACTS} SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'REDACTED_' || left({_hmac('secret')}, 8) END AS secret FROM contacts",
    "r11_summary": "SELECT * FROM (SELECT 'email' AS \"column\", 'email' AS kind, count(*) AS replaced FROM customer UNION ALL SELECT 'ip', 'ip', count(*) FROM customer UNION ALL SELECT 'note', 'ip', count(*) FROM customer)",
    "r12_residual": "SELECT 'ip' AS \"column\", 'ip' AS kind, count(*) AS n FROM customer",
    "r13_join_kept": "SELECT c_custkey, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey",
}
