"""Personal data in text and in tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.binding import let
from millrace.functions.spans import matches, no_spans
from millrace.functions.staging import staged
from millrace.operators.typing import value_histogram

KINDS = ("email", "phone", "ssn", "credit_card", "ip", "name", "secret")
#: What each kind looks like before it is validated.
EMAIL = r"(?U)(?<![\w.+-])[\w.+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?![\w.-])"
PHONE = r"(?U)(?<!\w)\+?\(?\d[\d()+. -]{8,}\d(?!\w)"
SSN = r"(?<![0-9])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9})(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"
PREFIXED = r"AKIA[A-Z0-9]{12,}|sk-[A-Za-z0-9_-]{8,}|gh[po]_[A-Za-z0-9]{8,}|xox[bp]-[A-Za-z0-9-]{8,}|-----BEGIN[ A-Z0-9_-]+-----"
TOKEN = r"(?<!\S)\S{20,}(?!\S)"
DATE_LIKE = r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?:[ T][0-9]{1,2}(?::[0-9]{2}){0,2}(?:\.[0-9]+)?)?$"
PLAIN_NUMBER = r"^[+-]?[0-9]{1,8}(?:\.[0-9]+)?$"
#: A few common names of our own choice; callers bring their own dictionary.
NAMES = ("alice", "ana", "ben", "bob", "carla", "david", "emma", "garcia", "jane", "john", "kim", "lee", "maria", "miller", "peter", "smith")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid_phone(value: Column) -> Column:
    """10 to 15 digits, and neither a social security number, nor an address, nor a date."""
    looks = value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") | value.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$") | value.rlike(DATE_LIKE)
    return ~looks & value.rlike(r"^[0-9()+. -]+$") & F.length(digits_of(value)).between(10, 15)


def valid_ssn(value: Column, bare: bool = False) -> Column:
    """Area, group and serial in range; bare digits only where the column's name asks for them."""
    digits = F.replace(value, F.lit("-"), F.lit(""))
    area = F.substring(digits, 1, 3)
    ranges = ~area.isin("000", "666") & (area < "900") & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000")
    return ranges if bare else value.contains("-") & ranges


def valid_card(value: Column) -> Column:
    """13 to 19 digits with a right Luhn sum."""
    digits = F.translate(value, " -", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def valid_ip(value: Column) -> Column:
    """P5: no octet above 255."""
    return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(value)
    count = lambda c: n - F.length(F.replace(value, c, F.lit("")))
    bits = lambda acc, c: let(count(c) / n, lambda share: acc - share * F.log2(share))
    return F.aggregate(_symbols(value), F.lit(0.0), bits)


def _symbols(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))


def valid_token(value: Column) -> Column:
    """More than four bits, which takes more than 16 characters; neither an address nor a script."""
    varied = (F.size(_symbols(value)) > 16) & (entropy(value) > 4.0)
    return varied & ~(value.contains("@") & value.rlike(EMAIL)) & ~F.lower(value).contains("javascript:")


def is_name(value: Column, names: Sequence[str] = NAMES) -> Column:
    """One or two words, each in the dictionary. Longer texts are not split."""
    words = F.filter(F.split(F.lower(F.trim(value)), r"\s+"), lambda w: w != "")
    known = let(words, lambda w: F.size(w).between(1, 2) & (F.size(F.array_except(w, F.array(*map(F.lit, names)))) == 0))
    return value.rlike(r"\A\s*+\S++(?:\s++\S++)?+\s*+\z") & known


def column_hint(column: str) -> bool:
    """Whether the header asks for social security numbers."""
    return "ssn" in column.lower() or "social" in column.lower()


def spans_of(text: Column, bare_ssn: bool = False, kinds: Sequence[str] = KINDS, names: Sequence[str] = NAMES) -> Column:
    """All spans of a text, each once, by start, end and kind; short plain numbers and nulls have none."""
    having = lambda sign, spans: F.when(sign, spans).otherwise(no_spans())  # noqa: E731  # what no match lacks, cheaper than a search
    digits = lambda n: text.rlike(f"(?:[0-9][^0-9]*+){{{n}}}")
    long = lambda n: F.length(text) >= n
    makers = {
        "email": lambda: [having(text.contains("@"), matches(text, EMAIL, "email"))],
        "phone": lambda: [having(digits(10), matches(text, PHONE, "phone", valid_phone))],
        "ssn": lambda: [having(digits(9), matches(text, SSN, "ssn", lambda v: valid_ssn(v, bare_ssn)))],
        "credit_card": lambda: [having(digits(13), matches(text, CARD, "credit_card", valid_card))],
        "ip": lambda: [having(text.contains("."), matches(text, IP, "ip", valid_ip))],
        "secret": lambda: [having(long(11), matches(text, PREFIXED, "secret")), having(long(20), matches(text, TOKEN, "secret", valid_token))],
        "name": lambda: [
            F.when(is_name(text, names), F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.lit("name").alias("kind"), text.alias("value")))).otherwise(
                F.array().cast("array<struct<start: int, end: int, kind: string, value: string>>")
            )
        ],
    }
    found = F.array_sort(F.array_distinct(F.concat(*[s for k in kinds for s in makers[k]()])))
    nothing = F.array().cast("array<struct<start: int, end: int, kind: string, value: string>>")
    return F.when(text.isNull() | text.rlike(PLAIN_NUMBER), nothing).otherwise(found)


def hits_of(spans: Column) -> Column:
    """array<struct<kind, mask>>: each kind among the spans once, with the first of its values masked."""
    first = lambda all_, k: F.element_at(F.filter(all_, lambda s: s["kind"] == k), 1)["value"]
    hit = lambda all_, k: F.struct(k.alias("kind"), let(first(all_, k), lambda v: mask_value(v, k)).alias("mask"))
    each = lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda s: s["kind"])), lambda k: hit(all_, k))
    return let(spans, each)


def scan_spans(df: DataFrame, text_col: str, kinds: Sequence[str] = KINDS) -> DataFrame:
    """P9 as a table: the other columns with start, end, kind and value of each span."""
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.explode(spans_of(F.col(text_col), column_hint(text_col), kinds)).alias("s")).select(*rest, "s.*")


def even_sample(df: DataFrame, order: Sequence[str], column: str, k: int = 500) -> DataFrame:
    """At most k evenly spaced non-null cells in the given order, the rounding half to even.

    Rows are numbered without one task holding them all: each range partition counts its rows and starts after the
    sum of those before it; only the counts, one per partition, meet in one task.
    """
    rows = df.filter(F.col(column).isNotNull())
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    local = staged(dealt.withColumns({"_p": F.spark_partition_id(), "_i": within}), "even-sample")
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    n = local.count()
    numbered = local.join(before, "_p").withColumn("_at", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")
    if n <= k:
        return numbered.drop("_at")
    places = [0] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})
    return numbered.filter(F.col("_at").isin(places)).drop("_at") if k > 0 else numbered.limit(0).drop("_at")


def mask_value(value: Column, kind: Column) -> Column:
    """Just enough of a value to recognise it."""
    domain = F.substring_index(value, "@", -1)
    host = F.substring_index(domain, ".", 1)
    tail = F.substr(domain, F.length(host) + 1)
    email = F.concat(F.substring(value, 1, 1), F.lit("***@"), F.substring(host, 1, 1), F.lit("***"), tail)
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    return (
        F.when((kind == "email") & value.contains("@"), email)
        .when(kind.isin("phone", "ssn", "credit_card"), F.concat(F.lit("***"), F.right(digits_of(value), F.lit(4))))
        .when(kind == "ip", F.concat(F.substring_index(value, ".", 1), F.lit(".***.***.***")))
        .when(kind == "name", F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.lit("***"))), " "))
        .when(kind == "secret", F.concat(F.substring(value, 1, 4), F.lit("***")))
        .otherwise(F.concat(F.substring(value, 1, 1), F.lit("***")))
    )


def scan_histogram(hist: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """P10: one row per column and kind that is likely enough: confidence, hit rate and three masked samples.

    Each distinct value is scanned once and weighs as often as it stands, one pass finding both its kinds and their
    masks; a name counts less unless the header says name.
    """
    bare = F.col("column").rlike("(?i)ssn|social")
    text = F.col("value")
    both = F.when(bare, spans_of(text, True, kinds)).otherwise(spans_of(text, False, kinds)) if "ssn" in kinds else spans_of(text, False, kinds)
    each = hist.filter("value is not null").select("ordinal", "column", "n", F.posexplode_outer(hits_of(both)).alias("pos", "hit"))
    own = F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("n")).otherwise(0)  # each value once, whatever its kinds
    masked = each.groupBy("ordinal", "column", "hit.kind", "hit.mask").agg(F.sum("n").alias("n"), F.sum(own).alias("own"))
    part = [*(F.col(c) for c in ("ordinal", "column", "kind")), F.pmod(F.xxhash64("mask"), F.lit(64))]  # so no task ranks all masks
    some = masked.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("mask")))
    least = F.slice(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.col("mask")))), 1, 3)
    kinds_of = some.groupBy("ordinal", "column", "kind").agg(F.sum("n").alias("hits"), least.alias("samples"), F.sum("own").alias("own"))
    whole = Window.partitionBy("column")  # a row for each kind, and one for values without any
    filled = F.sum("own").over(whole)
    rate = F.sum(F.when(F.col("kind").isNotNull(), F.col("own")).otherwise(0)).over(whole) / filled
    counted = kinds_of.select("ordinal", "column", "kind", "hits", "samples", filled.alias("filled"), rate.alias("hit_rate")).filter("kind is not null")
    weight = F.when(F.col("kind") != "name", 1.0).when(F.col("column").rlike("(?i)name|first|last|full"), 0.7).otherwise(0.4)
    sure = counted.withColumn("confidence", F.col("hits") / F.col("filled") * weight).filter("confidence >= 0.5")
    return sure.select("ordinal", "column", "kind", "confidence", "hit_rate", "samples")


def scan_table(df: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """P10 of a table of strings."""
    return scan_histogram(value_histogram(df), kinds)


def pii_by_group(df: DataFrame, keys: Sequence[str], text_col: str, id_col: str, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Spans and documents with spans, by group and kind."""
    spans = df.select(*keys, id_col, F.explode(spans_of(F.col(text_col), False, kinds)).alias("s"))
    return spans.groupBy(*keys, F.col("s.kind").alias("kind")).agg(F.count("*").alias("spans"), F.count_distinct(id_col).alias("docs"))
