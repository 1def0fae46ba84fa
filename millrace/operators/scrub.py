"""Pseudonyms that keep joins intact (R1-R13): keyed digests, and fakes made from their bytes."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.binding import let
from millrace.operators.detect import KINDS, scan_table, spans_of
from millrace.sources.tables import name_of

#: Which kind wins where spans overlap, highest first.
PRIORITY = ("credit_card", "secret", "email", "ssn", "ip", "phone", "name")
#: Our own pools for parts of fake addresses and names.
USERS = ("amber", "birch", "cedar", "dune", "elm", "fern", "grove", "hazel", "iris", "jade", "kestrel", "larch", "maple", "nettle", "oak", "pine")
HOSTS = ("harbor", "meadow", "orchard", "quarry", "ridge", "summit", "valley", "willow")
FIRST = ("Ada", "Ben", "Cleo", "Dara", "Eli", "Fay", "Gus", "Hana", "Ivo", "June", "Kai", "Lena", "Milo", "Nora", "Otis", "Pia")
LAST = ("Abbot", "Brook", "Carver", "Dale", "Ember", "Frost", "Glenn", "Hart", "Irons", "Keel", "Lane", "Marsh", "North", "Orr", "Pike", "Quill")


def hmac_sha256(value: Column, salt: bytes) -> Column:
    """The keyed digest of the exact value, in lowercase hex, from two native SHA-256 passes."""
    import hashlib

    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def byte(digest: Column, i: int | Column) -> Column:
    """Byte i of a hex digest; the digest is used again after its 32 bytes."""
    at = (F.lit(i) if isinstance(i, int) else i) % 32
    return F.conv(F.substr(digest, (at * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def digits(digest: Column, n: Column) -> Column:
    """n decimal digits, one from each byte."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (byte(digest, i) % 10).cast("string")), "")).otherwise("")


def map_digits(value: Column, new: Column) -> Column:
    """The value with its digits replaced one after another; the rest of its layout stays. Digits are used again where
    there are more places than digits."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def mapped(new: Column) -> Column:
        step = lambda acc, c: F.when(
            c.between("0", "9"), F.struct((acc["k"] + 1).alias("k"), F.concat(acc["out"], F.substr(new, acc["k"] % F.length(new) + 1, F.lit(1))).alias("out"))
        ).otherwise(F.struct(acc["k"].alias("k"), F.concat(acc["out"], c).alias("out")))
        return F.aggregate(chars, F.struct(F.lit(0).alias("k"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    return let(new, mapped)


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes payload a card number."""
    chars = F.reverse(F.filter(F.split(payload, ""), lambda c: c != ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 1, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return ((10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _digit_count(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _bumped(new: Column) -> Column:
    return F.concat(((F.substring(new, 1, 1).cast("int") + 1) % 10).cast("string"), F.substr(new, F.lit(2)))


def fake_phone(value: Column, digest: Column) -> Column:
    """R2: same layout, other digits."""
    n = _digit_count(value)
    new = digits(digest, n)
    plain = digits(digest, F.lit(10))
    whole = F.concat(F.lit("("), F.substring(plain, 1, 3), F.lit(") "), F.substring(plain, 4, 3), F.lit("-"), F.substring(plain, 7, 4))
    mapped = map_digits(value, new)
    return F.when(n == 0, whole).when(mapped == value, map_digits(value, _bumped(new))).otherwise(mapped)


def fake_ssn(value: Column, digest: Column) -> Column:
    """Area 100 to 665, group 1 to 99, serial 1 to 9999, in the value's layout."""
    part = lambda n, width: F.lpad(n.cast("string"), width, "0")
    area = part(100 + (byte(digest, 0) * 256 + byte(digest, 1)) % 566, 3)
    group = part(1 + byte(digest, 2) % 99, 2)
    serial = 1 + (byte(digest, 3) * 256 + byte(digest, 4)) % 9999
    mapped = map_digits(value, F.concat(area, group, part(serial, 4)))
    other = map_digits(value, F.concat(area, group, part(serial % 9999 + 1, 4)))
    return F.when(_digit_count(value) == 0, F.concat_ws("-", area, group, part(serial, 4))).when(mapped == value, other).otherwise(mapped)


def fake_card(value: Column, digest: Column) -> Column:
    """Same number of digits and layout, right Luhn sum; below eight digits a plain number of sixteen."""
    n = _digit_count(value)
    payload = digits(digest, F.when(n < 8, 15).otherwise(n - 1))
    whole = F.concat(payload, luhn_digit(payload))
    mapped, bumped = map_digits(value, whole), _bumped(payload)
    return F.when(n < 8, whole).when(mapped == value, map_digits(value, F.concat(bumped, luhn_digit(bumped)))).otherwise(mapped)


def fake_ip(value: Column, digest: Column) -> Column:
    """Four octets from 1 to 254, never the input."""
    octets = [F.least(F.lit(254), F.greatest(F.lit(1), byte(digest, i))) for i in range(4)]
    fake = F.concat_ws(".", *octets)
    return F.when(fake == value, F.concat_ws(".", *octets[:3], octets[3] % 254 + 1)).otherwise(fake)


def _pick(pool: Sequence[str], digest: Column, i: int) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), byte(digest, i) % len(pool) + 1)


def fake_email(value: Column, digest: Column) -> Column:
    """A made-up address under the value's top level domain; com where it has none."""
    domain = F.substring_index(value, "@", -1)
    top = F.when(value.contains("@") & domain.contains("."), F.substring_index(domain, ".", -1)).otherwise("com")
    return F.concat(_pick(USERS, digest, 0), F.substring(digest, 3, 6), F.lit("@"), _pick(HOSTS, digest, 4), F.lit("."), top)


def fake_name(value: Column, digest: Column) -> Column:
    """One or two words, as the value has."""
    words = F.size(F.filter(F.split(value, r"\s+"), lambda w: w != ""))
    return F.when(words == 1, _pick(FIRST, digest, 0)).otherwise(F.concat_ws(" ", _pick(FIRST, digest, 0), _pick(LAST, digest, 1)))


def fake_secret(value: Column, digest: Column) -> Column:
    """A fixed tombstone with eight hex digits."""
    return F.concat(F.lit("REDACTED_"), F.substring(digest, 1, 8))


FAKES = {"phone": fake_phone, "ssn": fake_ssn, "credit_card": fake_card, "ip": fake_ip, "email": fake_email, "name": fake_name, "secret": fake_secret}


def fake(value: Column, kind: str, salt: bytes) -> Column:
    """The pseudonym of a value as a kind; null stays null."""
    return F.when(value.isNotNull(), let(hmac_sha256(value, salt), lambda digest: FAKES[kind](value, digest)))


def scrub_column(df: DataFrame, column: str, kind: str, salt: bytes, key: str | None = None) -> DataFrame:
    """Every filled cell of a flagged column is replaced.

    Fakes are short, so those of many values repeat: of a million values about a hundred share the eight digits of a
    secret with another. Joins go by a further column `key`, which has the whole keyed digest of the cell."""
    out = df if key is None else df.withColumn(key, hmac_sha256(name_of(column), salt))
    return out.withColumn(column, fake(name_of(column), kind, salt))


def chosen_spans(spans: Column) -> Column:
    """The spans to replace: by priority of kind, then the shorter, then the earlier, none over a chosen one; by start."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, PRIORITY)), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("rank"), (s["end"] - s["start"]).alias("size"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    apart = lambda acc, s: F.forall(acc, lambda o: (o["end"] <= s["start"]) | (o["start"] >= s["end"]))
    empty = F.array().cast("array<struct<start: int, end: int, kind: string, value: string>>")
    bare = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
    return F.array_sort(F.aggregate(keyed, empty, lambda acc, s: F.when(apart(acc, s), F.concat(acc, F.array(bare(s)))).otherwise(acc)))


def fake_by_kind(value: Column, kind: Column, salt: bytes, kinds: Sequence[str] = KINDS) -> Column:
    def chosen(digest: Column) -> Column:
        out = F.lit(None).cast("string")
        for k in kinds:
            out = F.when(kind == k, FAKES[k](value, digest)).otherwise(out)
        return out

    return let(hmac_sha256(value, salt), chosen)


def scrub_spans(text: Column, salt: bytes, kinds: Sequence[str] = KINDS) -> Column:
    """struct<text, replaced> of free text: only the matched spans change."""
    spans = chosen_spans(spans_of(text, False, kinds))
    faked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("original"), fake_by_kind(s["value"], s["kind"], salt, kinds).alias("fake")))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), s["fake"]).alias("out"))

    def replaced(spans: Column) -> Column:
        out = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
        return F.struct(F.when(text.isNotNull(), out).alias("text"), spans.alias("replaced"))

    return let(faked, replaced)


def column_plan(df: DataFrame, kinds: Sequence[str] = KINDS) -> dict[str, str]:
    """Kind of each flagged column: the surest, ties by priority. One row per column and kind comes to the driver."""
    found = scan_table(df, kinds).collect()
    best: dict[str, tuple] = {}
    for r in found:
        key = (r["confidence"], -PRIORITY.index(r["kind"]))
        if r["column"] not in best or key > best[r["column"]][0]:
            best[r["column"]] = (key, r["kind"])
    return {c: kind for c, (_, kind) in best.items()}


def scrub_table(df: DataFrame, salt: bytes, kinds: Sequence[str] = KINDS, plan: dict[str, str] | None = None) -> DataFrame:
    """Flagged columns whole, the others span by span, in one projection."""
    plan = column_plan(df, kinds) if plan is None else plan
    return df.select(*[(fake(name_of(c), plan[c], salt) if c in plan else scrub_spans(name_of(c), salt, kinds)["text"]).alias(c) for c in df.columns])


def scrub_lines(lines: DataFrame, salt: bytes, column: str = "line", kinds: Sequence[str] = KINDS) -> DataFrame:
    """Text and log files line by line; works on a stream as well."""
    return lines.withColumn(column, scrub_spans(F.col(column), salt, kinds)["text"])


def mapping(df: DataFrame, salt: bytes, plan: dict[str, str], kinds: Sequence[str] = KINDS) -> DataFrame:
    """(column, kind, original, fake, n) of everything that scrub_table replaces. Sensitive."""
    parts = []
    for c in df.columns:
        value = name_of(c)
        if c in plan:
            rows = df.filter(value.isNotNull()).groupBy(value.alias("original")).agg(F.count("*").alias("n"))
            parts.append(rows.select(F.lit(c).alias("column"), F.lit(plan[c]).alias("kind"), "original", fake(F.col("original"), plan[c], salt).alias("fake"), "n"))
        else:
            each = df.select(F.explode(scrub_spans(value, salt, kinds)["replaced"]).alias("s")).groupBy("s.kind", "s.original", "s.fake").agg(F.count("*").alias("n"))
            parts.append(each.select(F.lit(c).alias("column"), "kind", "original", "fake", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(mapped: DataFrame) -> DataFrame:
    """Replacements by column and kind."""
    return mapped.groupBy("column", "kind").agg(F.sum("n").alias("replaced"))


def residual(scrubbed: DataFrame, mapped: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(column, kind, n) of matches in the output that are no known fake; empty if the run is clean."""
    fakes = mapped.select(F.col("fake").alias("value")).distinct()
    parts = [scrubbed.groupBy(name_of(c).alias("cell")).agg(F.count("*").alias("n")).select(F.lit(c).alias("column"), "cell", "n") for c in scrubbed.columns]
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    found = cells.filter("cell is not null").select("column", "n", F.explode(spans_of(F.col("cell"), False, kinds)).alias("s"))
    known = found.select("column", "n", "s.kind", "s.value").filter(~F.col("value").rlike(r"REDACTED_[0-9a-f]{8}")).join(fakes, "value", "left_anti")
    return known.groupBy("column", "kind").agg(F.sum("n").alias("n"))


def assert_clean(scrubbed: DataFrame, mapped: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """The output, or an error that names columns and kinds with matches left."""
    left = residual(scrubbed, mapped, kinds).collect()
    if left:
        raise ValueError("personal data left: " + ", ".join(f"{r['column']}/{r['kind']}: {r['n']}" for r in left))
    return scrubbed
