"""Operator 1, language ID: bit-sliced Bloom filters answer with all languages that hold an n-gram."""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.staging import broadcast_if_small, staged
from millrace.llm.spans import U, code_points, mixed, ranges, sliced

#: Code points of an n-gram; least and most slots of a filter, as powers of two, and slots per n-gram of a language.
GRAM, SLOT_BITS, MOST_BITS, SLOTS = 4, 20, 24, 16
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageFilters:
    """planes[slot, l // 8] has bit l % 8 set where language l uses the slot; fill is the share of its slots. There are
    2 ** bits slots."""

    languages: tuple[str, ...]
    planes: np.ndarray
    fill: np.ndarray
    usual: int
    bits: int

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """The languages that hold each n-gram, as bits: both of its slots are set."""
        one, other = gram >> U(64 - self.bits), (gram >> U(64 - 2 * self.bits)) & U((1 << self.bits) - 1)
        return self.planes[one] & self.planes[other]


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point to its lower case, or to a space where it is neither letter nor mark."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every n-gram that touches a word; each text has two spaces around it."""
    codes, bounds = code_points([f"  {t}  " for t in texts])
    folded = _folding()[codes].astype(U)
    n = len(folded) - GRAM + 1
    h = folded[:n].copy()
    for k in range(1, GRAM):
        h = h * U(0x9E3779B97F4A7C15) + folded[k : n + k]
    use = (folded[1 : n + 1] != 32) | (folded[2 : n + 2] != 32)
    for k in range(1, GRAM):
        use[bounds[1:-1] - k] = False
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[:n]
    return mixed(h[use]), owner[use]


def _pieces(texts: list[str], limit: int) -> Iterator[tuple[int, str]]:
    """(number, text), with a text longer than limit in pieces that share GRAM - 1 code points."""
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - GRAM + 1), limit):
            yield i, text[a : a + limit + GRAM - 1]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the batches of (lang, text), summed within ranges of texts."""
    for batch in sliced(batches):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for x, t in zip(langs, texts, strict=True) if x == lang]
            for lo, hi in ranges(own, 1 << 22):
                gram, n = np.unique(_grams(own[lo:hi])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 2000, ratio: float = 0.5) -> LanguageFilters:
    """Filters of the languages in lang_col, from a sample of about `sample` texts of each, chosen by their hash.

    A language holds an n-gram where its relative frequency is at least `ratio` of the highest of all languages. A
    filter has 16 slots or more per n-gram of the language that holds most, up to 2 ** 24. Rows without text or
    language teach nothing, repeated rows count each; without any row of use there are no languages.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sizes = staged(rows.groupBy("lang").agg(F.count("*").alias("texts")), "languages")
    counts = {r.lang: r.texts for r in sizes.collect()}
    languages = tuple(sorted(counts))
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / float(1 << 40)
    chosen = rows.join(broadcast_if_small(sizes), "lang").filter(part * F.col("texts") < sample).select("lang", "text")
    grams = chosen.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = staged(grams, "grams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("all"))
    share = grams.join(broadcast_if_small(totals), "lang").withColumn("share", F.col("n") / F.col("all"))
    held = share.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).filter(F.col("share") >= ratio * F.col("most"))
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1 if languages else F.lit(0)
    held = staged(held.select(number.cast("int").alias("l"), "gram"), "held-grams")
    most = held.groupBy("l").count().agg(F.max("count")).first()[0] or 1
    size = min(MOST_BITS, max(SLOT_BITS, (SLOTS * most - 1).bit_length()))
    slots = held.select("l", F.explode(F.array(*[F.shiftrightunsigned("gram", 64 - k * size).bitwiseAND((1 << size) - 1) for k in (1, 2)])).alias("slot"))
    bits = slots.groupBy("slot", F.expr("l div 8").alias("plane")).agg(F.bit_or(F.expr("shiftleft(1, l % 8)")).alias("bits")).toArrow()
    planes = np.zeros((1 << size, max(1, -(-len(languages) // 8))), np.uint8)
    planes[bits["slot"].to_numpy(), bits["plane"].to_numpy()] = bits["bits"].to_numpy()
    fill = np.array([((planes[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
    return LanguageFilters(languages, planes, fill, max(range(len(languages)), key=lambda i: counts[languages[i]], default=0), size)


def _held(texts: list[str], filters: LanguageFilters) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams of each text, and how many each language holds, corrected for the filters' false positives."""
    total, held = np.zeros(len(texts)), np.zeros((len(texts), filters.planes.shape[1] * 8))
    bit = (np.arange(256)[:, None] >> np.arange(8)) & 1
    numbered = list(_pieces(texts, 1 << 20))
    parts = [t for _, t in numbered]
    for lo, hi in ranges(parts):
        gram, owner = _grams(parts[lo:hi])
        masks = filters.masks(gram)
        of = np.array([i for i, _ in numbered[lo:hi]])
        np.add.at(total, of, np.bincount(owner, minlength=hi - lo))
        for p in range(masks.shape[1]):
            popcounts = np.bincount(owner * 256 + masks[:, p], minlength=(hi - lo) * 256).reshape(-1, 256) @ bit
            np.add.at(held[:, p * 8 : p * 8 + 8], of, popcounts)
    held = held[:, : len(filters.languages)]
    wrong = filters.fill**2
    return total, np.maximum(0, (held - total[:, None] * wrong) / np.maximum(1e-9, 1 - wrong))


def _predict(texts: list[str | None], filters: LanguageFilters) -> tuple[list[str], list[float]]:
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if filters.languages else []
    if known:
        total, held = _held([texts[i] for i in known], filters)
        best = held.argmax(axis=1)
        top = held[np.arange(len(known)), best]
        best = np.where(top > 0, best, filters.usual)
        for i, b, s in zip(known, best.tolist(), (top / np.maximum(1, total)).tolist(), strict=True):
            names[i], scores[i] = filters.languages[b], min(1.0, s)
    return names, scores


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of those names are replaced.

    lang_pred is the language that holds most n-grams of the whole text, score the share that it holds. A null
    text, or one without any letter, is `und` with score 0; a text none of whose n-grams is known gets the most
    frequent language with score 0. Ties go to the first language by name.
    """

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in sliced(batches):
            names, scores = _predict(batch.to_pylist(), filters)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_in"), predicted(F.col(text_col)).alias("_out"))
    return named.select("_in.*", "_out.*")
