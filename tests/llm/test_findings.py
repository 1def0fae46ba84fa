"""Whole jobs of the corpus operators."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm import spelling, token_counts


@pytest.mark.parametrize("hot", (0, 2, 1 << 18))
def test_long_pre_tokens_have_short_keys(spark, monkeypatch, hot):
    kept = []
    stage = token_counts.staged
    monkeypatch.setattr(token_counts, "staged", lambda df, name: kept.append((name, stage(df, name))) or kept[-1][1])
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["日本語の文章" * 400, "日本語の文章" * 400, "é" * 31, "é" * 32, "x" * 61, "x" * 62, "w" * 5000 + " " + "語" * 3000, "a b", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path, hot=hot).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert found == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}
    counts = dict(kept)["piece-counts"]
    assert counts.agg(F.max(F.octet_length("token"))).first()[0] <= 64 and counts.count() == 9
    assert dict(kept)["token-rows"].select(F.explode("cold.token").alias("t")).filter(F.octet_length("t") > 64).count() == 0
    for t in ("é" * 32, "x" * 64, "x" * 65, "語" * 22, "▁a"):
        assert token_counts.key_of(t) == spark.range(1).select(token_counts.key_column(F.lit(t))).first()[0]


def test_pairs_of_words_count_once_in_any_order_of_postings(spark):
    """Postings of two grams arrive in opposite orders, as from several executors."""
    rows = [("abc", 1, 6, "abcdef", 4), ("abc", 1, 6, "abcdeg", 3), ("bcd", 2, 6, "abcdeg", 3), ("bcd", 2, 6, "abcdef", 4)]
    postings = spark.createDataFrame(rows, "gram string, place int, size int, word string, n long").coalesce(1)
    for shard, block in ((50_000, 4096), (1, 4096), (50_000, 1)):
        found = sorted(map(tuple, spelling.near_words(postings, shard, block).collect()))
        assert found == [("abcdef", 4, "abcdeg", 3), ("abcdeg", 3, "abcdef", 4)]


def test_runs_without_an_id_stay():
    runs = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}".replace("word", "wörd") for i in range(676)]
    assert [spelling.misspelt(None)(r) for r in runs] == runs
    assert [spelling.misspelt(3)(r) for r in runs] != runs
