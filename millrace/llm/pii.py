"""Operator 6, PII: patterns propose spans, checksums confirm them, context words adjust the score."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.spans import starts
from millrace.functions.staging import quoted

#: Code points before and after a span in which context words count, as far as the next match, and what one adds.
BEFORE, AFTER, CONTEXT = 40, 20, 0.2
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """hint: a character that every match holds; score: of a confirmed match, before its context."""

    pattern: str
    hint: str
    score: float
    words: str


#: Patterns are possessive where nothing that follows could give characters back, so long runs take no stack.
KINDS = {
    "email": Kind(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write"),
    "ip": Kind(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address|login"),
    "card": Kind(r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|visa|credit|payment|carte|karte|tarjeta"),
    "phone": Kind(r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax"),
    "iban": Kind(r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "", 0.7, "iban|bank|account|konto|compte|cuenta"),
    "ssn": Kind(r"[0-9-]++", "-", 0.4, "ssn|social security"),
}


def _mod97(value: Column) -> Column:
    """The ISO 7064 remainder of an account number: its first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        return _mod97(value) == 1
    if kind == "ssn":
        return value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def _scored(rank: int, kind: str, least_score: float) -> Column:
    """The spans of a kind, from its matches and gaps, with their scores: checked first, then scored by their context."""
    found, gaps = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    around = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)),
        F.slice(gaps, F.lit(2), F.size(found)),
        lambda b, a: F.struct(F.right(b, F.lit(BEFORE)).alias("before"), F.left(a, F.lit(AFTER)).alias("after")),
    )
    placed = F.zip_with(found, starts(found, gaps), lambda m, s: F.struct(s.alias("start"), m.alias("value")))
    both = F.zip_with(placed, around, lambda p, c: F.struct(p["start"].alias("start"), p["value"].alias("value"), c.alias("near")))

    def scored(s: Column) -> Column:
        near = F.concat(s["near"]["before"], s["value"], s["near"]["after"])
        score = F.lit(KINDS[kind].score) + F.when(F.lower(near).rlike(KINDS[kind].words), CONTEXT).otherwise(0.0)
        end = s["start"] + F.length(s["value"])
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), F.round(score, 2).alias("score"))

    good = F.filter(both, lambda s: _confirmed(kind, s["value"]))
    return F.filter(F.transform(good, scored), lambda s: s["score"] >= least_score)


def find_spans(docs: DataFrame, text_col: str = "text", kinds: Sequence[str] = tuple(KINDS), least_score: float = 0.5) -> DataFrame:
    """docs with pii: array of (start, rank, end, kind, value, score) by start, then by the order of kinds.

    Starts and ends are code points, the end exclusive. Matches of a kind are leftmost and do not overlap; those of
    different kinds may. A match that its checksum or range check refuses is dropped and not tried again. A context
    word within 40 code points before or 20 after, as far as the next match of the kind, adds to the score, and spans
    below least_score are dropped: base kinds never fall below 0.5, a social security number needs a context word.
    Null and empty texts have no spans, repeated rows each their own, an empty table an empty result. A column named
    pii is replaced.
    """
    columns = [c for c in docs.columns if c != "pii"]
    rows = docs.select(F.struct(*map(quoted, columns)).alias("_in"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    found = {}
    for kind in kinds:
        every = F.regexp_extract_all("text", F.lit(KINDS[kind].pattern), F.lit(0))
        found[f"m_{kind}"] = F.when(F.col("text").contains(KINDS[kind].hint), every).otherwise(none) if KINDS[kind].hint else every
    rows = rows.withColumns(found)
    rows = rows.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", KINDS[k].pattern, -1)).otherwise(none) for k in kinds})
    spans = [_scored(rank, kind, least_score) for rank, kind in enumerate(kinds)]
    return rows.select("_in", F.array_sort(F.concat(*spans)).alias("pii")).select("_in.*", "pii")


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """docs with redacted: the text with each span as [kind]; of overlapping spans the first to start goes, and the
    part of a later one that is not covered stays replaced by nothing. A column named redacted is replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")).alias("out"),
    )
    done = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1))
    out = F.aggregate(F.col(spans_col), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, done)
    return docs.select(*[quoted(c) for c in docs.columns if c != "redacted"], out.alias("redacted"))
