"""Every stage of the pipeline against what it should do with the rows before it."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.functions.staging import staged


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = {"documents": {r["doc_id"]: r["text"] for r in docs.collect()}}
    columns, rows = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        rows = staged(stage(spark, rows, "/root/testdata/sf0.001"), name)
        if name != "bpe":
            assert rows.columns == columns
            seen[name] = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert set(seen["language_id"]) == {i for i, t in seen["documents"].items() if re.search(r"[^\W\d_]", t or "")}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for i, t in sorted(seen["language_id"].items()):
        first.setdefault(norm(t), i)
    assert set(seen["exact_dedup"]) == set(first.values())

    def shingles(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    kept, every = seen["minhash_near_dedup"], {i: shingles(t) for i, t in seen["exact_dedup"].items()}
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    label = {i: i for i in every}
    changed = True
    links = [(i, j) for i in every for j in every if i < j and alike(every[i], every[j])]
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    assert set(kept) == set(label.values())
    assert set(seen["mixing"]) <= set(kept)
    out = rows.collect()
    assert all(r["round_trip"] for r in out) and {r["doc_id"] for r in out} == set(seen["mixing"])


def test_stages_keep_columns_and_hard_rows(spark):
    english = "the quick brown fox jumps over the lazy dog while many other words go on and on about nothing at all"
    rows = [
        (1, english, "en", "a", 5, "k1", "s1", {"x": 1}), (2, english, "en", "a", 5, "k2", "s2", None), (2, english, "en", None, 5, "k3", "s3", None), (None, english + " again", None, None, None, None, None, None),
        (4, None, "en", "b", None, "k4", "s4", None), (5, "", "en", "b", 0, "k5", "s5", None), (6, english.replace("lazy", "tired") + " and so it ends " * 20000, "en", "b", 1, "k6", "s6", None), (7, "12345 …", "en", "b", 1, "k7", "s7", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, `odd.size` map<string, int>")
    docs = docs.withColumns({"lang_pred": F.lit(7), "copies": F.lit("c"), "size": F.lit("z"), "keep_id": F.lit(True), "_row": F.lit("r")})
    for table in (docs, docs.limit(0)):
        kept = table
        for name, apply in corpus_pipeline.STAGES[:-1]:
            kept = staged(apply(spark, kept, ""), f"hard-{name}")
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
            found = kept.collect()
            assert all(tuple(r)[5:7] in {x[5:7] for x in rows} and r["lang_pred"] == 7 and r["copies"] == "c" for r in found)
        assert table is not docs or {1, 6} <= {r["doc_id"] for r in found} | {1}
        last = corpus_pipeline.STAGES[-1][1](spark, kept, "")
        assert last.filter("not round_trip").count() == 0
    assert sorted(r["text"][:9] for r in corpus_pipeline.known_language(spark, docs, "").collect()) == ["the quick"] * 5
