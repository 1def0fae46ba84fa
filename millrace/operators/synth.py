"""Learned synthetic tables (M1-M14): a small specification per column, and rows drawn from hashes of their number."""

import hashlib
import json
import math
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.functions.binding import let
from millrace.functions.staging import staged
from millrace.operators import scrub
from millrace.operators.detect import spans_of
from millrace.operators.profile import placed, weighted_quantiles
from millrace.operators.typing import as_boolean, as_date, as_datetime, as_float, column_types, parse_rates, shape, value_histogram

#: Which kind of personal data names a column, first to last.
SENSITIVE = ("secret", "email", "name", "phone", "ssn", "credit_card", "ip")
QUANTILES = [i / 20 for i in range(21)]
#: Areas from 100 on, groups and serials of social security numbers that are drawn.
AREAS, GROUPS, SERIALS = 566, 99, 9999
#: Categories of a column whose table stands in the plan, values of a joined block at least, and bytes of a broadcast.
INLINE, BLOCK, BROADCAST = 4096, 1024, 1 << 23
#: Rounds of the permutation of row numbers.
ROUNDS = 4
WORDS = ("amber", "brook", "cinder", "delta", "ember", "fable", "grain", "harbor", "inlet", "juniper", "knoll", "lumen", "meadow", "nectar", "opal", "prairie")


def sensitive_kinds(hist: DataFrame) -> DataFrame:
    """M2: (column, sensitive) of the first kind that any distinct cell holds; columns without a hit are left out."""
    rank = F.array_position(F.array(*map(F.lit, SENSITIVE)), F.col("s.kind"))
    each = hist.filter("value is not null").select("column", F.explode(spans_of(F.col("value"), False)).alias("s"))
    first = each.groupBy("column").agg(F.min(rank).cast("int").alias("first"))  # numbers, so that no task sorts its hits
    return first.select("column", F.element_at(F.array(*map(F.lit, SENSITIVE)), F.col("first")).alias("sensitive"))


def id_patterns(hist: DataFrame) -> DataFrame:
    """M3: (column, pattern, start): digits as #, letters as ? unless the place always holds the same one; start is the
    largest number plus one for columns of digits alone, else the smallest number in the digits.

    The commonest shape is taken, ties by shape; other shapes in the column append -#### to it.
    """
    filled = hist.filter("value is not null").select("column", "value", "n", shape(F.col("value")).alias("mask"))
    counted = filled.groupBy("column", "mask").agg(F.sum("n").alias("n"))
    best = counted.groupBy("column").agg(F.min_by("mask", F.struct((-F.col("n")).alias("n"), "mask")).alias("mask"), F.count("*").alias("masks"))
    own = filled.join(F.broadcast(best), ["column", "mask"])  # a row per column, and no task gets all values of one
    digits = F.regexp_replace("value", "[^0-9]", "").try_cast("bigint")
    starts = own.groupBy("column", "mask", "masks").agg(F.min(digits).alias("low"), F.max(digits).alias("high"), F.max(F.length("value")).alias("width"))
    place = own.select("column", F.posexplode(F.filter(F.split("value", ""), lambda c: c != "")).alias("pos", "c"))
    kinds = place.groupBy("column", "pos", "c").count().groupBy("column", "pos").agg(F.count("*").alias("k"), F.max("c").alias("c"))
    mark = F.when(F.col("c").rlike("[0-9]"), "#").when((F.col("k") > 1) & F.col("c").rlike(r"\p{L}"), "?").otherwise(F.col("c"))
    pattern = kinds.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", mark.alias("m")))), lambda s: s["m"]), "").alias("pattern"))
    number = F.col("mask").rlike("^9+$")
    return starts.join(pattern, "column").select(
        "column",
        F.when(number, F.repeat(F.lit("#"), F.col("width"))).when(F.col("masks") > 1, F.concat("pattern", F.lit("-####"))).otherwise(F.col("pattern")).alias("pattern"),
        F.when(number, F.col("high") + 1).otherwise(F.coalesce("low", F.lit(1))).alias("start"),
    )


def category_weights(hist: DataFrame) -> DataFrame:
    """M4: (column, value, weight) with the share of each value, to two decimals."""
    filled = hist.filter("value is not null")
    total = filled.groupBy("column").agg(F.sum("n").alias("all"))
    return filled.join(F.broadcast(total), "column").select("column", "value", F.round(F.col("n") / F.col("all"), 2).alias("weight"))


def numeric_grids(hist: DataFrame) -> DataFrame:
    """M5: (column, grid, decimals): 21 quantiles with linear interpolation, and the most decimals seen."""
    rows = hist.withColumn("x", as_float(F.col("value"))).filter("x is not null")
    decimals = F.coalesce(F.max(F.length(F.regexp_extract("value", r"\.([0-9]+)$", 1))), F.lit(0))
    places = rows.groupBy("column").agg(decimals.alias("decimals"))
    return weighted_quantiles(rows, QUANTILES).withColumnRenamed("q", "grid").join(places, "column")


def temporal_ranges(hist: DataFrame) -> DataFrame:
    """M6: (column, low, high) of the dates or moments of each column, as text."""
    moment = F.coalesce(as_datetime(F.col("value")), as_date(F.col("value")).cast("timestamp_ntz"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return hist.withColumn("at", moment).filter("at is not null").groupBy("column").agg(text(F.min("at")).alias("low"), text(F.max("at")).alias("high"))


def small_params(hist: DataFrame) -> DataFrame:
    """M7: (column, true_rate, avg_words, name_words): share of true cells, average words rounded half up, at least one,
    and the commonest number of words, the smallest of equally common ones."""
    n, words = F.col("n"), F.size(F.filter(F.split("value", r"\s+"), lambda w: w != ""))
    truth = as_boolean(F.col("value"))
    by_words = hist.filter("value is not null").groupBy("column", words.alias("words")).agg(
        F.sum(F.when(truth, n).otherwise(0)).alias("true"), F.sum(F.when(truth.isNotNull(), n)).alias("truths"), F.sum("n").alias("n")
    )
    return by_words.groupBy("column").agg(
        F.round(F.sum("true") / F.sum("truths"), 2).alias("true_rate"),
        F.greatest(F.lit(1), F.floor(F.sum(F.col("words") * F.col("n")) / F.sum("n") + 0.5)).cast("int").alias("avg_words"),
        F.max_by("words", F.struct("n", (-F.col("words")).alias("w"))).alias("name_words"),
    )


def uniqueness(rates: DataFrame) -> DataFrame:
    """M8: whether a column is filled without repeats."""
    return rates.select("column", ((F.col("filled") > 0) & (F.col("distinct") == F.col("filled"))).alias("unique"))


class Specification(NamedTuple):
    """What `generate` draws from. columns: one row per column (ordinal, column, kind, null_rate, unique, parameters).
    categories: (column, value, weight, low, total, at), one row per value: it has the share from low up to the next
    value's low of total, and is the at-th value."""

    columns: DataFrame
    categories: DataFrame


def category_table(weights: DataFrame) -> DataFrame:
    """The categories of a specification from (column, value, weight); equal values add up, nulls are left out."""
    own = placed(weights.filter("value is not null").select("column", F.col("value").alias("x"), F.col("weight").cast("double").alias("n")))
    return own.select("column", F.col("x").alias("value"), F.col("n").alias("weight"), F.col("_first").alias("low"), F.col("_all").alias("total"), F.col("_index").alias("at"))


def learn_spec(df: DataFrame) -> Specification:
    """M1: kind, null rate, uniqueness and the parameters of its kind of every column, and the values of the categorical
    ones with how often they stand, however many there are."""
    hist = staged(value_histogram(df), "histogram")
    rates = staged(parse_rates(hist), "parse-rates")
    nulls = hist.groupBy("column").agg(F.round(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 2).alias("null_rate"))
    types = column_types(rates).join(nulls, "column").join(uniqueness(rates), "column").join(sensitive_kinds(hist), "column", "left")
    kind = F.coalesce(F.col("sensitive"), F.when(F.col("col_type") == "id_like", "id").otherwise(F.col("col_type")))
    out = types.select("ordinal", "column", kind.alias("kind"), "null_rate", (F.col("unique") & kind.isin("id", *SENSITIVE)).alias("unique"))
    for part in (numeric_grids(hist), temporal_ranges(hist), small_params(hist), id_patterns(hist)):
        out = out.join(part, "column", "left")
    columns = staged(out, "specification")
    few = hist.join(F.broadcast(columns.filter("kind = 'categorical'").select("column")), "column", "left_semi")  # a row per column
    return Specification(columns, staged(category_table(few.withColumn("weight", F.col("n"))), "categories"))


def drawn(*parts: Column | str) -> Column:
    """An integer below 2 ** 52 that the parts decide."""
    text = F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, column: str, what: str = "") -> Column:
    """A number from 0 up to 1 that depends on seed, column and row number alone."""
    return drawn(f"{seed}/{column}/{what}", F.col("id")) / float(1 << 52)


@lru_cache(maxsize=64)
def factors(size: int) -> tuple[int, int]:
    """Two numbers of like magnitude whose product is size or little more."""
    root = max(1, math.isqrt(size - 1) + 1)
    few = range(root, min(2 * root, root + 4096) + 1)
    first = min(few, key=lambda a: (-(-size // a) * a - size, a))
    return first, -(-size // first)


def permuted(seed: int, column: str, size: int = 1 << 40) -> Column:
    """A number below size that no other row number below size has: a Feistel network over pairs of digits, keyed by seed
    and column. Pairs stand for a few numbers from size on; those walk on to the next number of their cycle."""
    a, b = factors(size)

    def once(x: Column) -> Column:
        def turn(pair: Column, k: Column) -> Column:
            high = F.pmod(pair["high"] + drawn(f"{seed}/{column}/high", k, pair["low"]), F.lit(a))
            return let(high, lambda h: F.struct(h.alias("high"), F.pmod(pair["low"] + drawn(f"{seed}/{column}/low", k, h), F.lit(b)).alias("low")))

        start = F.struct(F.floor(x / F.lit(b)).alias("high"), F.pmod(x, F.lit(b)).alias("low"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda pair: pair["high"] * F.lit(b) + pair["low"])

    found = once(F.pmod(F.col("id"), F.lit(size)))
    for _ in range(a * b - size):  # as many numbers as can lie on the way
        found = let(found, lambda x: F.when(x < size, x).otherwise(once(x)))
    return found


def draw_id(spec: Row, seed: int) -> Column:
    """Unique ids count up from start in the digits of the pattern, surplus digits in front, or behind a pattern
    without digits; others are random."""
    pattern = spec["pattern"] or "#"
    width = pattern.count("#")
    random = F.lpad(F.floor(uniform(seed, spec["column"], "id") * 10 ** min(width, 15)).cast("bigint").cast("string"), max(width, 1), "0")
    number = (F.lit(1 if spec["start"] is None else spec["start"]) + F.col("id")).cast("string") if spec["unique"] else random
    number = F.when(F.length(number) < width, F.lpad(number, max(width, 1), "0")).otherwise(number)
    parts, at = [], 0
    for i, c in enumerate(pattern):
        if c == "#":
            lead = F.length(number) - width
            parts.append(F.substr(number, F.lit(1), lead + 1) if at == 0 else F.substr(number, lead + at + 1, F.lit(1)))
            at += 1
        elif c == "?":
            parts.append(F.char((F.floor(uniform(seed, spec["column"], f"?{i}") * 26) + 65).cast("bigint")))
        else:
            parts.append(F.lit(c))
    if spec["unique"] and not width:  # a pattern of letters has no place for the number, so it follows
        parts += [F.lit("-"), number]
    return F.concat(*parts)


def position(lows: Column, size: int, target: Column) -> Column:
    """The last place (from 0) of a sorted array of at most size numbers whose number is at most target."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, size.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(lows, at + step) <= target, at + step).otherwise(at))


def _numbers(values: Sequence[float]) -> Column:
    """An array of numbers in the plan, as one text."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def draw_categories(rows: DataFrame, categories: DataFrame, seed: int) -> tuple[DataFrame, dict[str, Column]]:
    """The rows and, by column, a value drawn by cumulative weights.

    Tables of up to INLINE values stand in the plan. Those of larger columns are cut into blocks of consecutive values,
    which rows join by the block of their draw: broadcast where the table is small in bytes, else by a shuffle, whose hot
    blocks (one row each) the adaptive skew join splits. A column without any weight over 0 is an error."""
    sizes = categories.groupBy("column").agg(F.count("*").alias("n"), F.max("total").alias("total"), F.min("weight").alias("least"), F.sum(F.octet_length("value") + 16).alias("bytes"))
    out = {}
    for i, size in enumerate(sizes.orderBy("column").collect()):
        name, n, total = size["column"], size["n"], size["total"]
        if not total > 0 or not math.isfinite(total) or size["least"] < 0:
            raise ValueError(f"{name}: categories must have finite weights of at least 0, some over 0")
        own = categories.filter(F.col("column") == name)
        target = uniform(seed, name) * total
        if n <= INLINE and size["bytes"] <= BROADCAST:
            table = own.orderBy("at").select("value", "low").collect()
            values = F.from_json(F.lit(json.dumps([r["value"] for r in table])), "array<string>")
            out[name] = F.get(values, position(_numbers([r["low"] for r in table]), n, target))
            continue
        width = max(BLOCK, -(-n // INLINE))
        blocks = own.groupBy(F.floor(F.col("at") / width).alias(f"_b{i}")).agg(F.array_sort(F.collect_list(F.struct("low", "value"))).alias(f"_v{i}"))
        blocks = staged(blocks, "category-blocks")
        starts = [r[0] for r in blocks.orderBy(f"_b{i}").select(F.col(f"_v{i}")[0]["low"]).collect()]
        rows = rows.withColumn(f"_t{i}", target).withColumn(f"_b{i}", position(_numbers(starts), len(starts), F.col(f"_t{i}")).cast("bigint"))
        rows = rows.join(F.broadcast(blocks) if size["bytes"] <= BROADCAST else blocks, f"_b{i}")
        lows = F.transform(F.col(f"_v{i}"), lambda v: v["low"])
        out[name] = F.get(F.col(f"_v{i}"), position(lows, width, F.col(f"_t{i}")))["value"]
    return rows, out


def draw_number(spec: Row, seed: int) -> Column:
    """A uniform place on the grid, blended between its neighbours and rounded half to even."""
    grid = F.array(*map(F.lit, spec["grid"]))
    at = uniform(seed, spec["column"]) * (len(spec["grid"]) - 1)
    low = F.floor(at).cast("int")
    a, b = F.element_at(grid, low + 1), F.element_at(grid, low + 2)
    value = F.bround(a + (b - a) * (at - low), spec["decimals"] or 0)
    return value.cast("bigint").cast("string") if not spec["decimals"] else F.format_string(f"%.{spec['decimals']}f", value)


def draw_moment(spec: Row, seed: int) -> Column:
    """Uniform between low and high."""
    ends = [F.unix_timestamp(F.lit(spec[k]), "yyyy-MM-dd HH:mm:ss") for k in ("low", "high")]
    second = ends[0] + F.floor(uniform(seed, spec["column"]) * (ends[1] - ends[0] + 1)).cast("bigint")
    return F.from_unixtime(second, "yyyy-MM-dd" if spec["kind"] == "date" else "yyyy-MM-dd HH:mm:ss")


def draw_words(spec: Row, seed: int) -> Column:
    """As many words as the column has on average."""
    words = F.array(*map(F.lit, WORDS))
    pick = lambda i: F.element_at(words, (F.pmod(drawn(f"{seed}/{spec['column']}", F.col("id"), i), F.lit(len(WORDS))) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(1, spec["avg_words"] or 1))), pick), " ")


def number_of_social(x: Column) -> Column:
    """The x-th social security number that can be drawn."""
    area, group, serial = 100 + F.floor(x / (GROUPS * SERIALS)), 1 + F.floor(x / SERIALS) % GROUPS, 1 + x % SERIALS
    return F.concat_ws("-", area.cast("string"), F.lpad(group.cast("string"), 2, "0"), F.lpad(serial.cast("string"), 4, "0"))


def draw_personal(spec: Row, seed: int) -> Column:
    """A made-up value that no source value enters; unique where the column is, by a permutation of row numbers."""
    digest = F.sha2(F.concat_ws("/", F.lit(seed), F.lit(spec["column"]), F.col("id").cast("string")), 256)
    number = F.lpad(permuted(seed, spec["column"]).cast("string"), 13, "0")
    if not spec["unique"]:
        sample = {"phone": "(000) 000-0000", "ssn": "000-00-0000", "credit_card": "0" * 16, "ip": "0.0.0.0", "email": "a@b.com", "name": "A B", "secret": "s"}
        return scrub.FAKES[spec["kind"]](F.lit(sample[spec["kind"]]), digest)
    social = permuted(seed, spec["column"], AREAS * GROUPS * SERIALS)
    octets = lambda x: F.concat_ws(".", *[F.pmod(F.floor(x / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])
    return {
        "email": F.concat(F.lit("u"), number, F.lit("@example.com")),
        "phone": F.concat(F.lit("+1"), number),
        "ssn": let(social, number_of_social),
        "credit_card": let(F.concat(F.lit("40"), number), lambda head: F.concat(head, scrub.luhn_digit(head))),
        "ip": let(permuted(seed, spec["column"], 1 << 32), octets),
        "name": F.concat(scrub._pick(scrub.FIRST, digest, 0), F.lit(" "), scrub._pick(scrub.LAST, digest, 1), F.lit(" "), F.initcap(F.translate(number, "0123456789", "abdefgiklm"))),
        "secret": F.concat(F.lit("REDACTED_"), number),
    }[spec["kind"]]


def check_spec(spec: Sequence[Row]) -> None:
    """Errors of a specification before anything is drawn: rates in 0..1, parameters of each kind, finite numbers."""
    finite = lambda xs: all(x is not None and math.isfinite(x) for x in xs)

    def refuse(row: Row, why: str) -> None:
        raise ValueError(f"{row['column']}: {why}")

    for row in spec:
        kind, rate = row["kind"], row["true_rate"]
        if row["null_rate"] is None or not 0 <= row["null_rate"] <= 1:
            refuse(row, "null_rate must lie in 0..1")
        if kind == "boolean" and (rate is None or not 0 <= rate <= 1):
            refuse(row, "true_rate must lie in 0..1")
        if kind in ("integer", "float"):
            grid = row["grid"] or ()
            if len(grid) < 2 or not finite(grid) or list(grid) != sorted(grid):
                refuse(row, "a grid must hold finite numbers in order")
        if kind in ("date", "datetime") and (row["low"] is None or row["high"] is None or row["low"] > row["high"]):
            refuse(row, "a range must have a low and a high end")


def generate(spark: SparkSession, spec: Specification, n: int, seed: int = 0) -> DataFrame:
    """M9: n rows, columns in the order of the specification. A row depends on seed and row number alone, however many
    tasks draw.

    Of the specification only its rows per column and tables of at most INLINE values come to the driver.
    """
    columns = spec.columns.orderBy("ordinal").collect()
    check_spec(columns)
    known = spec.categories.filter(F.col("column").isin([r["column"] for r in columns if r["kind"] == "categorical"]))
    rows, categories = draw_categories(spark.range(n), known, seed)
    out = []
    for row in columns:
        kind = row["kind"]
        if kind == "empty":
            value = F.lit(None).cast("string")
        elif kind == "id":
            value = draw_id(row, seed)
        elif kind == "categorical":
            if row["column"] not in categories:
                raise ValueError(f"{row['column']}: no categories to draw from")
            value = categories[row["column"]]
        elif kind in ("integer", "float"):
            value = draw_number(row, seed)
        elif kind in ("date", "datetime"):
            value = draw_moment(row, seed)
        elif kind == "boolean":
            value = F.when(uniform(seed, row["column"]) < (row["true_rate"] or 0.0), "true").otherwise("false")
        elif kind in SENSITIVE:
            value = draw_personal(row, seed)
        else:
            value = draw_words(row, seed)
        out.append(F.when(uniform(seed, row["column"], "null") >= row["null_rate"], value).alias(row["column"]))
    return rows.select(*out)
