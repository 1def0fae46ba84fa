"""Operator 3, token counts: pieces counted once per distinct pre-token, joined to each document's frequencies."""

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.staging import quoted, staged
from millrace.llm.spans import code_points, distinct_spans, ranges, sliced

#: Pre-tokens that are looked up in a broadcast table, at most; the rest join by a shuffle.
HOT = 1 << 18
#: Bytes of a pre-token up to which it is its own key; the hot table's strings take at most 16 MB.
KEY_BYTES = 64


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _marked(text: str) -> str:
    """The text as the model sees it: white space marks for spaces, one in front. Empty stays empty."""
    return "▁" + text.replace(" ", "▁") if text else ""


def key_of(token: str) -> str:
    """What a pre-token is looked up by: itself, or its MD5 where it is long. No digest starts with a mark."""
    if len(token) <= KEY_BYTES // 4:
        return token
    raw = token.encode()
    return token if len(raw) <= KEY_BYTES else hashlib.md5(raw).hexdigest()


def key_column(token: Column) -> Column:
    """key_of in Spark."""
    return F.when(F.octet_length(token) <= KEY_BYTES, token).otherwise(F.md5(token))


def frequencies(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of the marked texts; then, sorted by text: text number, pre-token number, how often.

    A pre-token is a run of white space marks with what follows up to the next mark. No piece of the model has a
    mark behind another character, so no merge crosses such a boundary and the counts add up.
    """
    numbers: dict[str, int] = {}
    rows = [np.zeros((3, 0), np.int64)]
    marked = [_marked(t) for t in texts]
    for lo, hi in ranges(marked):
        codes, bounds = code_points(marked[lo:hi])
        if not len(codes):
            continue
        mark = codes == 0x2581
        start = np.concatenate([[True], mark[1:] & ~mark[:-1]])
        start[bounds[:-1][bounds[:-1] < len(codes)]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(codes))
        spans, inverse = distinct_spans(codes, starts, ends)
        own = [numbers.setdefault(s.decode("utf-32-le", "surrogatepass"), len(numbers)) for s in spans]
        text = np.searchsorted(bounds, starts, side="right") - 1
        key, n = np.unique((text << 32) | inverse, return_counts=True)
        rows.append(np.stack([lo + (key >> 32), np.array(own, np.int64)[key & 0xFFFFFFFF], n]))
    text, token, n = np.concatenate(rows, axis=1)
    return list(numbers), text, token, n


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 4096):
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for lo, hi in ranges(texts, 1 << 24):
            tokens, _, token, n = frequencies(texts[lo:hi])
            total = np.bincount(token, weights=n, minlength=len(tokens)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(total)], ["token", "total"])


def piece_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(token, total, pieces): every distinct pre-token, how often it stands in all texts, its number of pieces."""

    @F.arrow_udf("int")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(path)
        for batch in batches:  # the model puts the first mark in front by itself; a mark alone is one piece
            ids = model.encode([t[1:] for t in batch.to_pylist()], num_threads=1)
            yield pa.array([max(1, len(i)) for i in ids], pa.int32())

    distinct = docs.select(F.col(text_col)).mapInArrow(_distinct, "token string, total long")
    return distinct.groupBy("token").agg(F.sum("total").alias("total")).withColumn("pieces", pieces("token"))


def _hot_threshold(counts: DataFrame, hot: int) -> float:
    """The least total such that at most `hot` pre-tokens have it or more, to within an eighth of a power of two."""
    levels = counts.groupBy(F.floor(F.log2("total") * 8).alias("level")).count().collect()
    seen, threshold = 0, float("inf")
    for row in sorted(levels, key=lambda r: -r["level"]):
        seen += row["count"]
        if seen > hot:
            break
        threshold = 2 ** (row["level"] / 8)
    return threshold


def count_tokens(
    docs: DataFrame, path: str, text_col: str = "text", carry: Sequence[str] | None = None, limit: int = 4096, hot: int = HOT
) -> DataFrame:
    """The carried columns (default: all) of every row, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Counts the pieces that the sentencepiece model at path gives for the whole text, without begin or end pieces.
    Null counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each. Carried columns with the name of a
    result column are replaced. The `hot` most frequent pre-tokens at most are broadcast; the others join by a
    shuffle, where none is frequent. Both go by keys of at most 64 bytes, so texts without spaces, which are one
    pre-token each, neither fill the driver nor shuffle again.
    """
    counts = staged(piece_counts(docs, path, text_col).select(key_column(F.col("token")).alias("token"), "total", "pieces"), "piece-counts")
    threshold = _hot_threshold(counts, hot)
    table = counts.filter(F.col("total") >= threshold).select("token", "pieces").toArrow() if threshold < float("inf") else None
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(table["token"].to_pylist(), table["pieces"].to_pylist(), strict=True)) if table else {})
    columns = [c for c in (docs.columns if carry is None else carry) if c not in ("n_bytes", "n_tokens", "over_limit")]
    own = docs.select(F.struct(*map(quoted, columns)).alias("_in"), F.col(text_col).alias("_text"))

    @F.arrow_udf("struct<n_bytes: long, hot: long, cold: array<struct<token: string, n: long>>>")
    def looked_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = known.value
        for batch in sliced(batches, 4096):
            texts = [t or "" for t in batch.to_pylist()]
            n_bytes, sums, rest = [len(t.encode()) for t in texts], np.zeros(len(texts), np.int64), []
            for lo, hi in ranges(texts, 1 << 24):
                tokens, text, token, n = frequencies(texts[lo:hi])
                tokens = [key_of(t) for t in tokens]
                pieces = np.array([table.get(t, -1) for t in tokens], np.int64)[token] if tokens else np.zeros(0, np.int64)
                warm = pieces >= 0
                np.add.at(sums, lo + text[warm], n[warm] * pieces[warm])
                rest.append((pa.array(tokens, pa.string()).take(pa.array(token[~warm])), n[~warm], np.bincount(text[~warm], minlength=hi - lo)))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([r[2] for r in rest]))]) if rest else np.zeros(1)
            cold = pa.StructArray.from_arrays(
                [pa.concat_arrays([r[0] for r in rest]) if rest else pa.array([], pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *[r[1] for r in rest]]))],
                ["token", "n"],
            )
            yield pa.StructArray.from_arrays(
                [pa.array(n_bytes, pa.int64()), pa.array(sums), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), cold)], ["n_bytes", "hot", "cold"]
            )

    rows = own.select("_in", looked_up("_text").alias("_out")).withColumn("_row", F.monotonically_increasing_id())
    rows = staged(rows.select("_row", "_in", "_out.*"), "token-rows")
    cold = rows.select("_row", F.explode("cold").alias("c")).select("_row", "c.token", "c.n")
    joined = cold.join(counts.filter(F.col("total") < threshold), "token")
    sums = joined.groupBy("_row").agg(F.sum(F.col("n") * F.col("pieces")).alias("_more"))
    tokens = F.col("hot") + F.coalesce(F.col("_more"), F.lit(0))
    return (
        rows.select("_row", "_in", "n_bytes", "hot")
        .join(sums, "_row", "left")
        .select("_in.*", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
    )
