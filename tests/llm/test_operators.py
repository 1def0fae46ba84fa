"""The ten operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import itertools
import math
import re
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, language_id, minhash_dedup, pii, warc
from millrace.llm.components import components
from millrace.llm.embedding_dedup import near_vectors
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.line_dedup import PerfectHash, drop_repeated_lines
from millrace.llm.minhash_dedup import merged, near_dedup, shared_counts, shingle_sets
from millrace.llm.mixing import mix
from millrace.llm.registry import queries
from millrace.llm.spans import code_points, distinct_spans
from millrace.llm.token_counts import count_tokens

WORDS = "the quick brown fox jumps over a lazy dog while nine purple clouds drift slowly past an old stone bridge near our quiet village".split()
BASE = " ".join(WORDS * 3)
LINE = "this very line is found in many documents"
SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, _row string, row string, id string"


def texts() -> list[str | None]:
    near = BASE.replace("purple", "violet", 1)
    return [
        None, "", " ", "a", "a\tb", "a  b", BASE, BASE, near, BASE + " end", "x" * 30000, f"{LINE}\nown words one\n{LINE.upper()}  ", f"{LINE}\ntwo\n\nthree", f"  {LINE}\t\nsix",
        "mail me at a.b@c.de, _d@e.fr or +1 (212) 555-0100 and 10.0.0.300 8.8.8.8", "visa 4111 1111 1111 1111 iban DE89370400440532013000", "日本語 é <|endoftext|> it's we'll \n\n  z", "end\r\n\x0b\x0c",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", None, "fr")[i % 3], ("b", None, "a")[i % 3], True, "r", "w", "d") for i, t in enumerate(texts())]
    rows += [(6, BASE, "en", "b", None, None, None, None), (None, "a b", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.filter("doc_id is not null").collect()}


def test_exact(docs, none):
    rows = exact_dedup(docs).collect()
    assert len(rows) == docs.count()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in rows:
        same = [x for x in rows if norm(x["text"]) == norm(r["text"])]
        assert r["group_size"] == len(same)
        assert r["keep_id"] == min((x["doc_id"] for x in same if x["doc_id"] is not None), default=None)
        assert sum(x["kept"] for x in same) == 1
        assert r["text_sha256"] == hashlib.sha256(norm(r["text"]).encode()).hexdigest()
    assert [c for c in exact_dedup(docs).columns if c == "_row"] == ["_row"]
    assert exact_dedup(none).count() == 0


def test_exact_without_room_in_the_filter(docs):
    small, usual = exact_dedup(docs, max_filter_bits=32768), exact_dedup(docs)
    key = ("doc_id", "keep_id", "group_size", "text_sha256")
    assert sorted(map(str, small.select(*key).collect())) == sorted(map(str, usual.select(*key).collect()))


def brute_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def word_sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("width", [2, 5])
def test_near(docs, none, width):
    got = [r for r in near_dedup(docs, width=width).collect()]
    rows = {k: (r["doc_id"], word_sets(r["text"], width)) for k, r in enumerate(got)}
    linked = [(a, b) for a, b in itertools.combinations(rows, 2) if rows[a][1] and 100 * len(rows[a][1] & rows[b][1]) >= 80 * len(rows[a][1] | rows[b][1])]
    label = brute_components(rows, linked)
    for k, r in enumerate(got):
        group = [j for j in rows if label[j] == label[k]]
        assert r["n_shingles"] == len(rows[k][1])
        assert r["component_id"] == min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        assert sum(got[j]["kept"] for j in group) == 1
    assert near_dedup(none).count() == 0


def test_near_group_of_variants(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rng.integers(0, 120, i % 13):
            own[k] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(own)))
    got = by_id(near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=2))
    sets = {i: word_sets(t, 2) for i, t in rows}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = brute_components(sets, linked)
    assert {i: got[i]["component_id"] for i in sets} == label


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 5, 200, 90, 250)]
    assert shared_counts(sets[:3], sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]


def test_shingles_are_whole_and_separate():
    a, b, c = shingle_sets(["A b\x0bc", "", "b C d"], 2)
    assert (len(a), len(b), len(c)) == (2, 0, 2) and len(np.intersect1d(a, c)) == 1


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3), (200, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    got = bpe.decode(bpe.encode(docs, path), path).withColumn("sha", bpe.ids_sha256(F.col("token_ids"))).collect()
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["sha"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.decode(bpe.encode(none, path), path).count() == 0


def test_bpe_on_odd_strings():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.vocabulary(path)
    rng = np.random.default_rng(3)
    chars = list("ab'sltdrem vE 1²\n\t .,!é　日😀")
    some = ["".join(rng.choice(chars, n)) for n in rng.integers(0, 30, 3000)]
    ids, bounds = bpe.encode_texts(some, own)
    assert all(library.encode(t, add_special_tokens=False).ids == ids[a:b].tolist() for t, a, b in zip(some, bounds[:-1], bounds[1:], strict=True))


@pytest.mark.parametrize("hot", [1 << 18, 3, 0])
def test_token_counts(docs, none, hot):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in count_tokens(docs, path, limit=10, hot=hot).collect():
        n = len(model.encode(r["text"] or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 10)
    assert count_tokens(none, path).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/\n1", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 50000), (None, "u", "x"), (None, "u", "own"), (2, None, "x")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = warc.archive(pages).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == sorted(
        [("1", "revisit", 2, 1), ("2", "response", None, 1), ("2", "response", None, 1), ("3", "revisit", 4, 0), ("4", "response", None, 0), ("5", "response", None, 100000), ("None", "revisit", 2, 1), ("None", "response", None, 3)],
    )
    assert {r["payload_digest"] for r in got if r["payload_bytes"] == 1} == {warc.digest32(b"x")}
    assert warc.archive(pages.limit(0)).count() == 0
    some = warc.archive(pages, selected=F.col("page_id") == 5).collect()
    assert [(r["page_id"], r["payload"]) for r in some] == [(5, ("é" * 50000).encode())]


def test_pii(docs):
    rows = by_id(pii.find_spans(docs))
    spans = lambda i: [(s["kind"], s["value"]) for s in rows[i]["pii"]]
    assert spans(14) == [("email", "a.b@c.de"), ("email", "_d@e.fr"), ("phone", "+1 (212) 555-0100"), ("ip", "8.8.8.8")]
    assert spans(15) == [("card", "4111 1111 1111 1111"), ("iban", "DE89370400440532013000")]
    assert all(rows[14]["text"][s["start"] : s["end"]] == s["value"] for s in rows[14]["pii"])
    assert rows[0]["pii"] == [] and rows[10]["pii"] == []


def test_pii_edges(spark):
    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    good = {
        "email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 14 <= len(re.sub("[ -]", "", v)) <= 19 and luhn(re.sub("[ -]", "", v)), "phone": lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    rng = np.random.default_rng(5)
    some = ["".join(rng.choice(list("0123456789.+-@ab ()😀"), n)) for n in rng.integers(0, 60, 800)] + ["1" * 20000, "1 " * 20000, "a" * 20000 + "@", "4" * 16 + " " + "4539578763621486", "a@b.c_d@e.f"]
    got = pii.find_spans(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), kinds=tuple(base)).collect()
    for r in got:
        want = sorted((m.start(), k, m.end()) for k in base for m in re.finditer(base[k], r["text"]) if good[k](m[0]))
        assert sorted((s["start"], s["kind"], s["end"]) for s in r["pii"]) == want


def test_context_decides_on_weak_spans(spark):
    rows = spark.createDataFrame([(1, "my ssn 123-45-6789"), (2, "part 123-45-6789")], "doc_id long, text string")
    got = by_id(pii.find_spans(rows, kinds=("ssn",)))
    assert len(got[1]["pii"]) == 1 and got[2]["pii"] == []
    assert by_id(pii.redacted(pii.find_spans(rows, kinds=("ssn",))))[1]["redacted"] == "my ssn [ssn]"


@pytest.mark.parametrize("block_bytes", [1 << 22, 1])
def test_vectors(spark, block_bytes):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    x = [*(base + 0.0), *(base[:10] + 0.12 * rng.normal(size=(10, 16))), base[0], base[0], 3 * base[1]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 16), (92, [float("nan")] * 16), (93, [1.0, None]), (94, [1.0, 0.5]), (95, [2.0, 1.0]), (96, []), (None, base[2].tolist()), (5, x[5].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit(1))
    got = near_vectors(frame, block_bytes=block_bytes).collect()
    vec = [np.array(v["embedding"], float) if v["embedding"] and None not in v["embedding"] and np.isfinite(v["embedding"]).all() and any(v["embedding"]) else None for v in got]
    linked = [
        (a, b) for a, b in itertools.combinations(range(len(got)), 2)
        if vec[a] is not None and vec[b] is not None and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b]) >= 0.9
    ]
    label = brute_components(range(len(got)), linked)
    for k, r in enumerate(got):
        group = [j for j in range(len(got)) if label[j] == label[k]]
        assert r["n_links"] == sum(k in pair for pair in linked)
        assert r["component_id"] == min((got[j]["vec_id"] for j in group if got[j]["vec_id"] is not None), default=None)
        assert sum(got[j]["kept"] for j in group) == 1
    assert near_vectors(frame.limit(0)).count() == 0


def test_mix(docs, none):
    got = mix(docs).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        sizes.setdefault(r["source"], []).append(r)
    targets = {s: rows[0]["target"] for s, rows in sizes.items()}
    total = sum(r["size"] for r in got)
    assert math.isclose(sum(targets.values()), 1.5 * total)
    for s, rows in sizes.items():
        assert targets[s] <= 2 * sum(r["size"] for r in rows) + 1e-9
        assert abs(sum(r["taken"] for r in rows) - targets[s]) <= max([r["size"] for r in rows]) * 2  # rows with one id go together
    again = mix(docs.repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["copies"]) for r in got) == sorted((str(r["doc_id"]), r["copies"]) for r in again)
    assert mix(none).count() == 0


@pytest.mark.parametrize("small", [{}, {"shard": 2}, {"room": 0}, {"room": 200, "shard": 2}])
def test_lines(docs, none, small):
    docs = docs.withColumn("n_lines", F.lit("x")).withColumn("shard", F.lit(1))
    got = drop_repeated_lines(docs, **small).collect()
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for n, r in enumerate(got):
        for line in (r["text"] or "").split("\n"):
            held.setdefault(key(line), {})[n] = r["doc_id"]
    for r in got:
        lines = (r["text"] or "").split("\n")
        gone = lambda x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and r["doc_id"] != max((i for i in held[key(x)].values() if i is not None), default=None)
        rest = [x for x in lines if not gone(x)]
        assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (len(lines), len(lines) - len(rest), "\n".join(rest))
    assert sum(r["n_dropped"] for r in got) > 0
    assert drop_repeated_lines(none, **small).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(4)
    h, check = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    h[:10] = h[0]
    hashed = PerfectHash.of(h, check)
    assert sorted(hashed.slots(h, check).tolist()) == list(range(5000))


def test_languages(spark):
    rng = np.random.default_rng(6)
    vocab = {"en": ["the", "with", "thing", "ship"], "fr": ["les", "avec", "chose", "été"], "xx": ["zzor", "qlik", "vram"]}
    rows = [(i, " ".join(rng.choice(vocab[lang], 30)), lang) for i, lang in enumerate(list(vocab) * 40)]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 …", None), (902, "", "fr"), (903, "é", None), (904, "LES été " * 200000, None)], "doc_id long, text string, lang string")
    filters = language_id.learn(docs.filter("doc_id < 60 or doc_id = 900"))
    got = by_id(language_id.identify(docs.withColumn("score", F.lit("x")), filters))
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[904]["lang_pred"] == "fr" and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language_id.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), filters).count() == 0


def test_vectors_over_many_blocks(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(500, 12))
    x = np.concatenate([base, base[:300] + 0.1 * rng.normal(size=(300, 12)), base[:300] + 0.25 * rng.normal(size=(300, 12))])
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), block_bytes=1).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    label = brute_components(range(len(x)), list(zip(*map(list, np.nonzero(close)), strict=True)))
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in got} == {i: (int(close[i].sum()), label[i]) for i in range(len(x))}


def test_merged_signatures_equal_a_full_comparison():
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 15), 1 << 15, (4, 64)).astype(np.int16)

    def some(n):
        x = base[rng.integers(0, 4, n)].copy()
        new = rng.random(x.shape) < rng.random((n, 1)) * 0.9
        x[new] = rng.integers(-(1 << 15), 1 << 15, new.sum())
        return x, np.sort(rng.integers(0, 3, n))

    (one, a), (other, b) = some(70), some(90)
    for matches, room in ((35, 1 << 21), (1, 64), (64, 64), (20, 512)):
        i, j = merged(one, other, matches, (a, b), room)
        want = ((one[:, None] == other[None]).sum(axis=2) >= matches) & (a[:, None] == b[None])
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(want)), strict=True))


def test_near_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "MANY", 3)
    test_near_group_of_variants(spark)


def thue_morse(n):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_regular_texts_are_told_apart(spark, n):
    one, other = thue_morse(n)
    path, model = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    library, pieces = Tokenizer.from_file(path), sentencepiece.SentencePieceProcessor(model_file=model)
    rows = spark.createDataFrame([(1, one), (2, other), (3, f"{one} {other}")], "doc_id long, text string").coalesce(1)
    for r in bpe.decode(bpe.encode(rows, path), path).collect():
        assert r["token_ids"] == library.encode(r["text"], add_special_tokens=False).ids and r["decoded"] == r["text"]
    assert all(r["n_tokens"] == len(pieces.encode(r["text"])) for r in count_tokens(rows, model).collect())
    assert {r["doc_id"]: r["component_id"] for r in near_dedup(rows, width=2).collect()} == {1: 1, 2: 2, 3: 3}
    codes, bounds = code_points([one, other, one])
    spans, number = distinct_spans(codes, bounds[:-1], bounds[1:])
    assert len(spans) == 2 and number[0] == number[2] != number[1]


def grams(text):
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in f"  {text}  ")
    return [folded[i : i + 4] for i in range(len(folded) - 3) if folded[i + 1] != " " or folded[i + 2] != " "]


def test_languages_against_exact_sets(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(-1, "tie", "en"), (-1, "tie", "en"), (-2, "", None), (-3, None, "en"), (-4, "…", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in language_id.identify(docs, language_id.learn(docs)).select("text", "lang_pred", "score").collect()]
    counts = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, collections.Counter()).update(grams(text))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    share = lambda lang, g: counts[lang][g] / total[lang]
    most = {g: max(share(lang, g) for lang in counts) for g in set().union(*counts.values())}
    held = {lang: {g for g in counts[lang] if share(lang, g) >= 0.5 * most[g]} for lang in counts}
    assert len(got) == len(rows)
    for text, lang, score in got:
        if not any(map(str.isalpha, text or "")):
            assert (lang, score) == ("und", 0.0)
            continue
        own = grams(text)
        exact = {k: sum(g in held[k] for g in own) / len(own) for k in held}
        assert abs(score - max(exact.values())) < 0.01 and exact[lang] >= max(exact.values()) - 0.01


def test_languages_on_held_out_documents(spark):
    got = queries()["op1_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = got.join(truth, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert out[0] > 0.95 and out[1] > 100, out


def test_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "mail a@b.cd", 5, "x", "y", "z", "w")], "doc_id long, text string, token_ids int, decoded string, pii string, n_tokens string, m_email string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.decode(bpe.encode(rows, path), path).first()["decoded"] == "mail a@b.cd"
    got = pii.find_spans(rows).first()
    assert [s["kind"] for s in got["pii"]] == ["email"] and got["m_email"] == "w"
    assert pii.find_spans(rows.limit(0)).count() == 0
    assert count_tokens(rows, public_tokenizers.path("piece_bpe_32k.model")).first()["n_tokens"] > 3


def test_many_spans_in_one_text(spark):
    text = " ".join("8.8.8.8" for _ in range(60000)) + " my ssn is 123-45-6789, not 123-45-6780"
    got = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["pii"]
    assert len(got) == 60001 and all(text[s["start"] : s["end"]] == s["value"] for s in got)
    assert got[-1]["kind"] == "ssn" and got[-1]["score"] == 0.6 and got[0]["score"] == 0.6


def test_mix_splits_rows_of_one_id(spark):
    rows = spark.createDataFrame([(None, f"w{i} " * 10, "a") for i in range(300)] + [(1, "x " * 300, "b")], "doc_id long, text string, source string")
    got = mix(rows).filter("source = 'a'")
    target, taken = got.agg(F.max("target"), F.sum("taken")).first()
    assert abs(target - taken) <= 10
