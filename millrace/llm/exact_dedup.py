"""Operator 5, exact dedup: two Bloom passes find the rows whose text may repeat; only those shuffle."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.staging import join_groups, quoted, staged

#: Bits of one bitmap of bitmap_construct_agg.
PAGE = 32768


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++", " ")


def _page(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(1)), F.lit(bits // PAGE))


def _slots(digest: Column, slots: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(PAGE)) for k in range(2, 2 + slots)]


def repeated_slots(digests: DataFrame, bits: int, slots: int) -> DataFrame:
    """First pass: (page, bitmap) of the Bloom slots that at least two insertions hit.

    All slots of a row lie in one page. Only their numbers shuffle, summed per task first: 8 bytes each, where whole
    bitmaps of every task would take bits / 8 bytes a task. The bitmaps take at most bits / 8 bytes in all.
    """
    slot = digests.select(_page(F.col("_sha"), bits).alias("page"), F.explode(F.array_distinct(F.array(*_slots(F.col("_sha"), slots)))).alias("slot"))
    twice = slot.groupBy((F.col("page") * PAGE + F.col("slot")).alias("at")).count().filter("count > 1")
    return twice.groupBy(F.expr(f"at div {PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.expr(f"at % {PAGE}")).alias("bitmap"))


def may_repeat(rows: DataFrame, pages: DataFrame, bits: int, slots: int) -> DataFrame:
    """Second pass: adds _maybe, true where all slots of a row's digest are set; false says that it is unique."""
    page = pages.select(F.col("page").alias("_page"), F.col("bitmap").alias("_map"))
    joined = rows.join(F.broadcast(page), _page(F.col("_sha"), bits) == F.col("_page"), "left")
    joined = joined.withColumns({f"_slot{k}": slot for k, slot in enumerate(_slots(F.col("_sha"), slots))})
    hit = [
        f"coalesce(getbit(cast(conv(hex(substring(_map, cast(_slot{k} div 8 as int) + 1, 1)), 16, 10) as bigint), cast(_slot{k} % 8 as int)) = 1, false)"
        for k in range(slots)
    ]
    return joined.withColumn("_maybe", F.expr(" and ".join(hit))).drop("_page", "_map", *[f"_slot{k}" for k in range(slots)])


def exact_dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    carry: Sequence[str] | None = None,
    max_filter_bits: int = 1 << 30,
) -> DataFrame:
    """The carried columns (default: all) of every row, with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space; null counts as empty.
    Of equal texts the row with the smallest id stays; null ids come last, and of repeated rows with one id a single
    one stays. A carried column with the name of a result column is replaced. An empty table gives an empty result.

    The filter has 16 bits a row and two slots, up to max_filter_bits (128 MB by default), so the broadcast is bounded;
    with fewer than five bits a row it has one slot. Beyond that more rows count as possibly repeated and shuffle their
    digests, and the result stays the same.
    """
    made = ("keep_id", "group_size", "kept", "text_sha256")
    columns = [c for c in (docs.columns if carry is None else carry) if c not in made]
    rows = staged(
        docs.select(
            F.struct(*map(quoted, columns)).alias("_in"),
            F.col(id_col).alias("_id"),
            F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("_sha"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "exact",
    )
    n = rows.count()
    bits = min(max_filter_bits, max(PAGE, 1 << (16 * n - 1).bit_length() if n else 0))
    slots = 2 if bits >= 5 * n else 1
    pages = staged(repeated_slots(rows, bits, slots), "exact-filter")
    flagged = may_repeat(rows, pages, bits, slots)
    groups = staged(
        flagged.filter("_maybe")
        .groupBy("_sha")
        .agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_keep"), F.count("*").alias("_size")),
        "exact-groups",
    )
    alone = flagged.filter("not _maybe").withColumns(
        {"_keep": F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")), "_size": F.lit(1).cast("bigint")}
    )
    together = join_groups(flagged.filter("_maybe"), groups, "_sha", "_size", n)
    return alone.unionByName(together).select(
        "_in.*",
        F.col("_keep.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep.row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
