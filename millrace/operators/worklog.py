"""Engagement log."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.typing import stripped

#: The tags of entries, in the order of a report's sections.
TAGS = ("win", "blocker", "decision", "note", "next")


def validate_entries(rows: DataFrame) -> DataFrame:
    """(id, ts, tag, text, reason), the text trimmed; reason is null for entries that may be kept."""
    text = stripped(F.col("text"))
    reason = F.when(text.isNull() | (text == ""), "empty").when(F.length(text) > 500, "too_long").when(F.col("tag").isNull() | ~F.col("tag").isin(*TAGS), "bad_tag")
    return rows.select("id", "ts", "tag", text.alias("text"), reason.alias("reason"))


def iso_week(ts: Column) -> Column:
    """Year and week as of ISO 8601, as 2021-W07."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))


def list_entries(rows: DataFrame, week: str | None = None, tag: str | None = None) -> DataFrame:
    """Entries of a week or a tag in order. The week becomes bounds on ts, which reach the scan."""
    if week is not None:
        if not re.fullmatch(r"[0-9]{4}-W(?:0[1-9]|[1-4][0-9]|5[0-3])", week):
            raise ValueError(f"not an ISO week: {week}")
        from datetime import datetime, timedelta

        start = datetime.strptime(week + "-1", "%G-W%V-%u")
        rows = rows.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(start + timedelta(days=7))))
    if tag is not None:
        rows = rows.filter(F.col("tag") == tag)
    return rows.orderBy("ts", "id")


def weekly_report(rows: DataFrame) -> DataFrame:
    """(week, monday, sunday, section, tag, entries, markdown), all five sections of every week that has entries.

    Sections without entries are made from one row per week, not by a join with the entries.
    """
    monday = F.date_trunc("week", "ts").cast("date")
    filled = rows.groupBy(iso_week(F.col("ts")).alias("week"), monday.alias("monday"), "tag").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "text"))).alias("items"))
    weeks = filled.select("week", "monday").distinct().select("week", "monday", F.posexplode(F.array(*map(F.lit, TAGS))).alias("section", "tag"))
    out = weeks.join(filled.select("week", "tag", "items"), ["week", "tag"], "left")
    lines = F.array_join(F.transform("items", lambda e: F.concat(F.lit("- "), e["text"])), "\n")
    return out.select("week", "monday", F.date_add("monday", 6).alias("sunday"), "section", "tag", F.coalesce(F.size("items"), F.lit(0)).alias("entries"), F.coalesce(lines, F.lit("_None_")).alias("markdown"))
