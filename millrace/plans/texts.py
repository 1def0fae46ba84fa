"""Queries about writing patterns (X) over documents and conversations."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import text
from millrace.plans.views import dealt, table


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with phrases, dashes, headings and lists woven in by the turn, so that signals have hits."""
    extra = F.element_at(
        F.array(
            F.lit(""), F.lit("\n\nIn conclusion, studies show growth."), F.lit(" — fast — and pivotal."), F.lit("\n- **Key point:** we delve."),
            F.lit(" Experts say red, blue, and green leverage seamless tools."), F.lit(" It's not just fast, but it's cheap."),
        ),
        ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"),
    )
    turns = dealt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.concat(F.coalesce("text", F.lit("")), extra).alias("text"))


PROSE = r"""t AS (SELECT conv_id * 1000 + turn AS id, role, coalesce(text, '') || ['', E'\n\nIn conclusion, studies show growth.', ' — fast — and pivotal.',
  E'\n- **Key point:** we delve.', ' Experts say red, blue, and green leverage seamless tools.', ' It''s not just fast, but it''s cheap.'][(conv_id + turn) % 6 + 1] AS text FROM conversations)"""


def x1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prose(spark, sf_dir).select("id", F.size(text.paragraphs(F.col("text"))).alias("paragraphs"))


def x2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", "pos", F.md5("sentence").alias("md5"))


def x3_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


def x4_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.text_stats(_prose(spark, sf_dir), "id").select("id", "chars", "words", "paragraphs")


def _signal(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text.analyze(_prose(spark, sf_dir), "id", signals={name: text.SIGNALS[name]}).drop("signal")


def x5_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.analyze(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", signals={"burstiness": text.burstiness})


def x6_phrase_tells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "phrase_tells")


def x6_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of three lexicons that come as one table."""
    rows = [(name, p) for name, phrases in (("phrase_tells", text.TELLS), ("puffery", tuple(text.PUFFERY)), ("weasel", text.WEASEL)) for p in phrases]
    hits = text.lexicon_hits(_prose(spark, sf_dir), "id", spark.createDataFrame(rows, "signal string, phrase string"))
    return hits.groupBy("id", "signal").agg(F.count("*").alias("hits"))


def x7_em_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "em_dash").select("id", "hits")


def x8_binary_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "binary_contrast")


def x9_colon_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "colon_reveal")


def x10_puffery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "puffery")


def x11_weasel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "weasel")


def x12_uniform_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "uniform_structure")


def x13_recap_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "recap_ending")


def x14_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(spark, sf_dir, "formatting_slop")


def x15_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.evidence(_prose(spark, sf_dir), "id")


def x16_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select(F.struct("doc_id", "source", "lang").alias("id"), "text"))
    found = text.analyze(docs, "id").select("id.*", "signal", "severity")
    return found.groupBy("source", "lang", "signal", "severity").agg(F.count("*").alias("docs"))


def x17_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.rewrite(_prose(spark, sf_dir), "id", passes=1).drop("text", "per_pass")


def x18_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.rewrite_signals(_prose(spark, sf_dir), "id")


def x19_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.suggestions(_prose(spark, sf_dir), "id").groupBy("advice").agg(F.count("*").alias("n"), F.count_distinct("id").alias("texts"))


def x20_word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    ops = text.corpus_word_diff(old, _prose(spark, sf_dir).select("id", "text"), "id")
    order = lambda keep: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op").isin(*keep), F.struct("pos", "text")))), lambda s: s["text"]), ""))
    return ops.groupBy("id").agg(order(("equal", "delete")).alias("old_md5"), order(("equal", "insert")).alias("new_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        x1_paragraphs, x2_sentences, x3_words, x4_text_stats, x5_burstiness, x6_phrase_tells, x7_em_dash, x8_binary_contrast, x9_colon_reveal, x10_puffery,
        x6_lexicon, x11_weasel, x12_uniform_structure, x13_recap_ending, x14_formatting, x15_evidence, x16_analyze, x17_edits, x18_rewrite, x19_suggestions, x20_word_diff,
    )
}

_WORDS = "coalesce(len(regexp_extract_all({t}, '[A-Za-z0-9]+([''’-][A-Za-z0-9]+)*')), 0)"
_PARAGRAPHS = r"len(list_filter(regexp_split_to_array(text, '\n[ \t\r\f\v]*\n'), lambda p: regexp_matches(p, '\S')))"


def _phrases(words: tuple[str, ...]) -> str:
    """Every character beside a word is doubled first, so that neighbouring phrases do not share one."""
    twice = [re.sub(r"([^\w-])", r"\1\1", w) for w in sorted(words, key=lambda p: (-len(p), p))]
    alternatives = "|".join(twice).replace("'", "''")
    doubled = r"regexp_replace(' ' || text || ' ', '([^\w-])', '\1\1', 'g')"
    return f"len(regexp_extract_all({doubled}, '(?i)[^\\w-]({alternatives})(?:[^\\w-])'))"


def _counts(words: dict[str, str]) -> str:
    return f"len(regexp_extract_all(text, '(?i)\\b({'|'.join(words)})\\b'))"


def _phrase_sql(words: tuple[str, ...], strong: int, score: str) -> str:
    return f"""WITH {PROSE}, h AS (SELECT id, {_phrases(words)} AS hits, {_WORDS.format(t="text")} AS w FROM t)
      SELECT id, CASE WHEN hits >= {strong} THEN 'strong' WHEN hits > 0 THEN 'notice' ELSE 'info' END AS severity, round(least(1.0, {score}), 4) AS score, hits FROM h"""


SQL = {
    "x1_paragraphs": f"WITH {PROSE} SELECT id, {_PARAGRAPHS} AS paragraphs FROM t",
    "x3_words": f"SELECT doc_id, {_WORDS.format(t='text')} AS words FROM documents",
    "x4_text_stats": f"WITH {PROSE} SELECT id, length(text) AS chars, {_WORDS.format(t='text')} AS words, {_PARAGRAPHS} AS paragraphs FROM t",
    "x6_phrase_tells": _phrase_sql(text.TELLS, 3, "hits * 100.0 / greatest(w, 1) / 3"),
    "x6_lexicon": f"WITH {PROSE}, h AS ("
    + " UNION ALL ".join(f"SELECT id, '{name}' AS signal, {_phrases(words)} AS hits FROM t" for name, words in (("phrase_tells", text.TELLS), ("puffery", tuple(text.PUFFERY)), ("weasel", text.WEASEL)))
    + ") SELECT * FROM h WHERE hits > 0",
    "x7_em_dash": f"WITH {PROSE} SELECT id, length(text) - length(replace(text, '—', '')) AS hits FROM t",
    "x8_binary_contrast": f"""WITH {PROSE}, h AS (SELECT id, len(regexp_extract_all(text, '(?i)\\bnot (just|only|merely|simply)\\b[^.!?\\n]*?[,;—] *(but|it|this|that|they)\\b|\\bnot [^.!?,\\n]*, but\\b|(\\bnot|n[''’]t) [^.!?\\n]*[.!?]\\s+(it|this|that|they)([''’](s|re)| is| are)\\b')) AS hits FROM t)
        SELECT id, CASE WHEN hits > 0 THEN 'strong' ELSE 'info' END AS severity, least(1.0, hits::DOUBLE) AS score, hits FROM h""",
    "x10_puffery": _phrase_sql(tuple(text.PUFFERY), 2, "hits / 2.0"),
    "x11_weasel": _phrase_sql(text.WEASEL, 2, "hits / 2.0"),
    "x14_formatting": f"""WITH {PROSE}, h AS (SELECT id, len(regexp_extract_all(text, '(?m)^[ \\t]*([-+*]\\s+|[0-9]+[.)]\\s+)\\*\\*[^*\\n]{{1,40}}:\\*\\*')) AS hits FROM t)
        SELECT id, CASE WHEN hits >= 3 THEN 'strong' WHEN hits > 0 THEN 'notice' ELSE 'info' END AS severity, round(least(1.0, hits / 3.0), 4) AS score, hits FROM h""",
    "x17_edits": f"""WITH {PROSE} SELECT id, {_counts(text.SWAPS)} AS swap, 0 AS throat_clearing, 0 AS setup, len(regexp_extract_all(text, '(?im)^(in conclusion|in summary|overall|ultimately|all in all),\\s')) AS recap_adverb,
        {_phrases(tuple(text.PUFFERY))} AS puffery, length(text) - length(replace(text, '—', '')) AS em_dash, len(regexp_extract_all(text, '\\*\\*[^*\\n]+\\*\\*')) AS markdown FROM t""",
    "x20_word_diff": f"WITH {PROSE} SELECT c.conv_id * 1000 + c.turn AS id, md5(coalesce(c.text, '')) AS old_md5, md5(t.text) AS new_md5 FROM conversations c JOIN t ON t.id = c.conv_id * 1000 + c.turn",
}
