"""Packing, the Merkle manifest and spelling variants against brute force, on rows with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import itertools
import pickle
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import embedding_dedup, line_dedup, registry, spelling
from millrace.llm import manifest as merkle
from millrace.llm.manifest import address, depth, log_of, manifest, proof_hash, siblings
from millrace.llm.packing import best_fit, pack_shard, packed, pieces_of, sequences
from millrace.llm.spelling import affected, decompose, misspelt, one_edit, spelling_variants

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "Plain words here", "Plain words here", "é́ É <|endoftext|> it's WE'LL ' s\tx\ny　z\x1cq", "word " * 5000, "q" * 30000, "ΑΣ Σ. ẞ İ",
    "colour color colors colours colouur", "colour colour colour colors color color", "Étude étude ÉTUDES etude etude etude étude x" + "y" * 70,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, leaf int, `index` string, tree string, bin string, row string, n string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, (None, "en", "fr", "é")[i % 4], "s", len(t or ""), "l", 1, "i", "t", "b", "r", "n") for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, "x Y", "en", None, None, *[None] * 7), (None, None, None, None, None, *[None] * 7)]
    return spark.createDataFrame(rows, SCHEMA)


def check_bins(rows, limit):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins)


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = pieces_of(docs, path)
    rows = packed(pieces.withColumnRenamed("doc_id", "id")).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k // 4096, k, np.array(ids[k : k + 4096], "<u4").tobytes()] += 1
    assert collections.Counter((r["id"], r["piece"], r["start"], bytes(r["ids"])) for r in rows) == want
    assert all(4 * r["length"] == len(r["ids"]) for r in rows) and rows[0]["row"] is None or rows[0]["bin"] == "b"
    assert check_bins(rows, 4096) == -(-sum(r["length"] for r in rows) // 4096)
    together = sequences(packed(pieces)).collect()
    assert sum(len(r["ids"]) for r in together) == 4 * sum(r["length"] for r in rows)
    assert packed(pieces_of(docs.limit(0), path)).count() == 0


@pytest.mark.parametrize("shard", [20, 1000])
def test_packing_in_rounds(spark, shard):
    rng = np.random.default_rng(3)
    lengths = [int(n) for n in [*rng.integers(1, 100, 300), *[100] * 20, *[34] * 150, *[67] * 120]]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    rows = packed(pieces, 100, shard).collect()
    assert sorted((r["id"], r["length"]) for r in rows) == list(enumerate(lengths))
    assert check_bins(rows, 100) <= max(best_fit(lengths, 100)) + 1 + (len(lengths) // shard if shard < 100 else 0)
    assert packed(pieces, 100, shard).groupBy("sequence_id").count().count() == check_bins(rows, 100)


def test_local_search_gains_over_best_fit():
    rng = np.random.default_rng(0)
    gained = 0
    for lengths in (rng.integers(20, 36, 400), rng.integers(26, 60, 400), rng.integers(1, 100, 300), np.full(90, 34), np.array([60, 40, 50, 50, 30, 70] * 9)):
        bins = pack_shard(lengths, np.arange(len(lengths)), 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and max(lengths[b].sum() for b in bins) <= 100
        first = max(best_fit(lengths.tolist(), 100)) + 1
        assert -(-lengths.sum() // 100) <= len(bins) <= first
        gained += first - len(bins)
    assert gained > 0
    start = np.array([0, 0, 0, 1, 1, 1])  # 55 + 25 + 10 and 30 + 30 + 10: whole bins begin as they are
    ends = pack_shard(np.array([55, 25, 10, 30, 30, 10]), start, 100)
    assert sorted(sum(np.array([55, 25, 10, 30, 30, 10])[b]) for b in ends) == [60, 100]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(nodes):
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, own in enumerate(at):
            first = own // 8 * 8
            proofs[i] += nodes[first:own] + nodes[own + 1 : first + 8]
            at[i] = own // 8
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(field(r[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")))
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r["doc_id"]))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: brute_tree([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in langs}
    root, tops = brute_tree([built[lang][0] for lang in langs])
    out = collections.Counter()
    for lang, top in zip(langs, tops, strict=True):
        for (_, _, own, ident), proof in zip(sorted(trees[lang], key=lambda x: x[:3]), built[lang][1], strict=True):
            out[ident, own, built[lang][0], root, sha("".join(proof + top))] += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, docs, monkeypatch, levels):
    monkeypatch.setattr(merkle.numbered, "__defaults__", (40,))
    more = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "if(doc_id % 5 < 3, 'en', lang) as lang", "source", "n_chars")
    rows = docs.unionByName(more, allowMissingColumns=True)
    odd = F.col("doc_id") % 3 == 0
    got = manifest(rows, tampered=odd, levels=levels).withColumn("proof_sha256", proof_hash(F.col("proof"))).collect()
    assert collections.Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == brute_manifest(rows.collect())
    for r in got:
        changed = r["doc_id"] is not None and r["doc_id"] % 3 == 0 and re.search("[A-Z]", r["text"] or "") is not None
        assert r["verified"] is not changed and (r["folded_root"] == r["root"]) is r["verified"] and (r["leaf"] != r["tampered_leaf"]) is changed
    assert [r["length"] for r in got if r["doc_id"] == 1] == ["l"]


def test_manifest_of_little(spark, docs):
    assert manifest(docs.limit(0)).count() == 0
    one = manifest(docs.filter("doc_id = 1")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == [] and one["verified"]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 200, 513])
def test_addresses_in_the_log(n):
    leaves = [hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(n)]
    log = log_of(leaves, depth(n))
    at = [address(0, np.arange(n), n, depth(n)), *[address(k, np.arange(-(-n // 8**k)), n, depth(n)) for k in range(1, depth(n) + 1)]]
    assert sorted(np.concatenate(at).tolist()) == list(range(len(log) // 32))
    root, proofs = brute_tree([x.hex() for x in leaves])
    assert log[-32:].hex() == root
    assert ["".join(p["before"] + p["after"] for p in own) for own in siblings(log, n, depth(n), np.arange(n))] == ["".join(p) for p in proofs]


def brute_words(rows, change):
    counts = collections.Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            counts[change(r["doc_id"], re.sub("[A-Z]", lambda m: m[0].lower(), run))] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = collections.defaultdict(set)
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {w: min(near[w], key=lambda x: (-counts[x], x), default=None) for w in counts}
    form = {w: f if f is not None and counts[f] >= 2 * counts[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n, len(near[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items()}


def as_dict(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize(("most", "shard", "block"), [(1 << 15, 100_000, 4096), (30, 60, 6)])
def test_spelling(spark, docs, monkeypatch, most, shard, block):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (shard, block))
    long = "z" * 80 + " " + "z" * 81 + " " + "z" * 79 + "y "
    chain = "abcde " * 3 + "abcdef " * 6 + "abcdefg " * 12 + "abcdefgh " * 30 + "Abcdefgh\n" + "wwwwww " * 7 + "wwwwwww " * 3 + "xwwwww " * 7
    extra = spark.createDataFrame([(900, long * 3, "a"), (901, chain, "b"), (902, "colour " * 9, None)], "doc_id long, text string, word string")
    rows = docs.unionByName(extra, allowMissingColumns=True)
    got = as_dict(spelling_variants(rows, most=most))
    assert got == brute_words(rows.collect(), lambda _, run: run)
    assert got["abcde"] == (3, 1, "abcdef", 6, "abcdefgh") and got["z" * 80][1] == 2
    assert spelling_variants(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="share no gram"):
        spelling_variants(docs, least=3)


def test_spelling_of_documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    change = lambda i, run: run[: h % len(run)] + run[h % len(run) + 1 :] if (h := zlib.crc32(f"{i}:{run}".encode())) % 97 == 0 else run
    assert as_dict(spelling_variants(rows, changes=misspelt, most=200)) == brute_words(rows.select("doc_id", "text").collect(), change)


def test_grams_that_an_edit_leaves_alone():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        word = "".join(rng.choice(list("abc"), rng.integers(5, 12)))
        frequent = {"".join(rng.choice([*"abc^$"], rng.integers(2, 5))) for _ in range(40)}
        k, c = int(rng.integers(0, len(word) + 1)), str(rng.choice(list("abc")))
        other = rng.choice([word[:k] + c + word[k:], word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :]])
        a, b = (collections.Counter(g for _, g in decompose(str(w), frequent)) for w in (word, other))
        for w, own in ((word, a), (str(other), b)):
            assert sum((a & b).values()) >= sum(own.values()) - affected(decompose(w, frequent))
            assert len(w) < 5 or sum(own.values()) > affected(decompose(w, frequent))


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_spelling_variants"])
def test_query_and_sql_agree(spark, name):
    found = registry.queries()[name](spark, FOLDER)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{FOLDER}/documents.parquet')")
    cursor = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in found.collect())


def test_index_takes_the_bytes_it_says(spark):
    rng = np.random.default_rng(7)
    n = 50_000
    h, check = (rng.integers(-(1 << 63), (1 << 63) - 1, n) for _ in range(2))
    lines = spark.createDataFrame(pa.table({"h": h, "check": check, "docs": np.full(n, 3), "last": rng.integers(0, 1 << 40, n)}).to_pandas())
    index = line_dedup.build_index(lines, 3)
    rows = index.orderBy("shard").collect()
    known = line_dedup.load(index, [0, 1, 2])
    for r in rows:
        assert known.value[r["shard"]].nbytes == r["bytes"]
    total = sum(r["bytes"] for r in rows)
    assert total < 18 * n and abs(len(pickle.dumps(known.value, protocol=5)) - total) < 0.1 * total
    assert line_dedup.groups_of([(0, 40), (1, 70), (2, 20), (3, 10), (4, 500), (5, 1)], 100) == [[0], [1, 2, 3], [4], [5]]
    assert line_dedup.groups_of([], 100) == []


def test_lines_never_shuffle(spark):
    rows = spark.createDataFrame([(i, f"this very line is long enough\nown line of document {i}\n" + "x" * i) for i in range(9)], "doc_id long, text string")
    for room in (1 << 26, 0):
        got = line_dedup.drop_repeated_lines(rows, room=room)
        assert got.filter("n_dropped = 1").count() == 8
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroups" not in plan and "Generate" not in plan


@pytest.mark.parametrize("together", [1, 2, 3])
def test_blocks_that_travel_together(spark, monkeypatch, together):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 6))
    x = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape), rng.normal(size=(40, 6)), base[:5], np.zeros((1, 6))])
    monkeypatch.setattr(embedding_dedup, "neighbourhood", lambda pairs: together)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(frame, block_bytes=1).collect()}
    unit = x[:-1] / np.linalg.norm(x[:-1], axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    assert [got[i]["n_links"] for i in range(len(x))] == [*hit.sum(axis=1).tolist(), 0]
    assert got[len(x) - 1]["component_id"] == len(x) - 1
    label = list(range(len(unit)))
    for _ in unit:
        label = [min([label[i], *(label[j] for j in np.flatnonzero(hit[i]))]) for i in range(len(unit))]
    assert [got[i]["component_id"] for i in range(len(unit))] == label


def test_size_of_neighbourhoods():
    assert [embedding_dedup.neighbourhood(n) for n in (0, 1, 255, 256, 1024, 1 << 20)] == [1, 1, 1, 1, 2, 4]
