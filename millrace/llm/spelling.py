"""Operator 13, spelling variants: words one edit apart, by an index of variable-length grams."""

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.staging import scratch, staged
from millrace.llm.spans import sliced, trimmed

RUN = "[A-Za-zÀ-ÿ]"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Marks before and behind a word; no word has them.
BEGIN, FINISH = "^", "$"
#: Code points of a gram, at least and at most.
SHORTEST, LONGEST = 2, 5
#: Grams of each length that are frequent, at most, and counters of how often grams stand: both are broadcast.
FREQUENT, COUNTERS = 1 << 15, 1 << 20
#: Distinct words that a task counts before it hands them on; postings of a shard, about; a list of more of them is cut.
HELD, SHARD, BLOCK = 1 << 18, 50_000, 4096
#: Code points up to which words are compared as rows of a matrix.
WIDE = 32
#: Pairs of postings that one step compares.
STEP = 1 << 14


def misspelt(doc_id: int | None) -> Callable[[str], str]:
    """Changes a run of the document: one code point of it goes where the hash of document and run says so. Without an id
    there is no hash, and runs stay, as in the SQL."""
    if doc_id is None:
        return str
    head = zlib.crc32(f"{doc_id}:".encode())

    def change(run: str) -> str:
        h = zlib.crc32(run.encode(), head)
        if h % 97:
            return run
        return run[: h % len(run)] + run[h % len(run) + 1 :]

    return change


def as_written(doc_id: int | None) -> Callable[[str], str]:
    return str


def partial_counts(docs: DataFrame, least: int, changes: Callable[[int | None], Callable[[str], str]]) -> DataFrame:
    """(word, n) of the words of (id, text), each once per HELD or so distinct words of a task. Shorter runs than a word
    cannot become one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda words: pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])
        runs, words = re.compile(f"{RUN}{{{least},}}").findall, Counter()
        for batch in sliced(batches):
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                change = changes(doc_id)
                for run, n in Counter(runs(text or "")).items():
                    words[change(run.lower() if run.isascii() else run.translate(LOWER))] += n
            if len(words) >= HELD:
                yield out(words)
                words = Counter()
        yield out(words)

    return docs.select("id", "text").mapInArrow(counted, "word string, n long").filter(F.length("word") >= least)


def frequent_grams(words: DataFrame, most: int = FREQUENT) -> list[str]:
    """The dictionary: grams of SHORTEST code points and more that stand in words more often than all grams of that length
    divided by `most`, so that at most `most` of each length are in it. Rare grams are pruned: nothing extends them."""
    marked = F.concat(F.lit(BEGIN), "word", F.lit(FINISH))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substr(marked, i, F.lit(n)))
    grams = words.select(F.explode(F.concat(*[at(n) for n in range(SHORTEST, LONGEST)])).alias("gram"))
    grams = staged(grams.groupBy("gram").count(), "grams")
    totals = grams.groupBy(F.length("gram").alias("size")).agg(F.sum("count").alias("total"))
    often = grams.join(F.broadcast(totals), F.length("gram") == F.col("size")).filter(F.col("count") > F.ceil(F.col("total") / most))  # a total per length
    return [r["gram"] for r in often.select("gram").toLocalIterator()]


def decompose(word: str, frequent: set[str]) -> list[tuple[int, str]]:
    """(place, gram) at every place of the marked word: the shortest gram that is not frequent, or the longest there is.

    Only the code points of a gram decide where it ends, so an edit outside it leaves it as it is."""
    marked = f"{BEGIN}{word}{FINISH}"
    out = []
    for at in range(len(marked) - SHORTEST + 1):
        end = at + SHORTEST
        while end < min(at + LONGEST, len(marked)) and marked[at:end] in frequent:
            end += 1
        out.append((at, marked[at:end]))
    return out


def affected(grams: list[tuple[int, str]]) -> int:
    """Grams that one edit can change, at most: those over one place. (An insertion changes those over two neighbours.)"""
    over = Counter(at + k for at, gram in grams for k in range(len(gram)))
    return max(over.values(), default=0)


def counter_of(gram: str, counters: int) -> int:
    return zlib.crc32(gram.encode()) % counters


def gram_counters(words: DataFrame, frequent: frozenset[str], counters: int) -> np.ndarray:
    """How often the grams of each counter stand in all words. Grams that share one only lose their order among rarer ones."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for batch in sliced(batches):
            own = [counter_of(g, counters) for w in batch["word"].to_pylist() for _, g in decompose(w, frequent)]
            total += np.bincount(np.array(own, np.int64), minlength=counters)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])

    table = words.select("word").mapInArrow(counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(counters, np.int64)
    out[table["counter"].to_numpy()] = table["n"].to_numpy()
    return out


def gram_postings(words: DataFrame, most: int = FREQUENT, counters: int = COUNTERS) -> DataFrame:
    """(gram, place, size, word, n): what each word posts.

    Words one edit apart share all but `affected` grams of each, in the same order. So the rarest grams, one more than
    can be affected, hold one that both have among theirs: only they are posted. Dictionary and counters are of bounded
    size and go to every worker; nothing shuffles but the counters."""
    known = words.sparkSession.sparkContext.broadcast(frozenset(frequent_grams(words, most)))
    frequent = known.value
    rarity = words.sparkSession.sparkContext.broadcast(gram_counters(words, frequent, counters).astype(np.int64))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, count = known.value, rarity.value
        for batch in sliced(batches, 4096):
            rows = []
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                grams = decompose(word, frequent)
                first = sorted((int(count[counter_of(g, counters)]), g, at) for at, g in grams)[: affected(grams) + 1]
                rows += [(g, at, len(word), word, n) for _, g, at in first]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gram", "place", "size", "word", "n"])

    return words.select("word", "n").mapInArrow(posted, "gram string, place int, size int, word string, n long")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point inserted, deleted or replaced makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _near_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of two matrices of code points (0 behind a word) are one edit apart; right words are at least as long."""
    differ = left != right
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1] - 1)
    columns = np.arange(left.shape[1] - 1)
    rest = (left[:, :-1] != right[:, 1:]) & (columns >= first[:, None])
    inserted = ~rest.any(axis=1)
    sizes = (left > 0).sum(axis=1), (right > 0).sum(axis=1)
    return np.where(sizes[0] == sizes[1], differ.sum(axis=1) == 1, inserted & (sizes[1] == sizes[0] + 1))


def _meetings(key: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of postings that meet, in chunks: of side 0 every two of a key, else each of side 1 with each of 2.

    Postings are sorted by key and side. Chunks follow the distance of j from the first that i meets, so that each holds
    what one step compares."""
    n = len(key)
    until = np.searchsorted(key, key, side="right")
    start = np.searchsorted(key, key, side="left")
    longer = np.concatenate([[0], np.cumsum(side == 2)])
    first = np.where(side == 0, np.arange(n) + 1, until - (longer[until] - longer[start]))
    reach = np.where(side == 2, 0, until - first)
    alive, step = np.flatnonzero(reach > 0), 0
    while len(alive):
        for at in range(0, len(alive), STEP):
            part = alive[at : at + STEP]
            yield part, first[part] + step
        step += 1
        alive = alive[reach[alive] > step]


def _links(words: list[str], own: np.ndarray, key: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, those of the first not longer than those of the second, of postings that meet and are one
    edit apart, each once. own has the number of each posting's word. Of words of equal length the first in code-point
    order comes first, in whatever order postings arrive, so that equal pairs of other lists and shards are equal."""
    order = np.lexsort((side, key))
    own, key, side = own[order], key[order], side[order]
    size, place = np.array([len(w) for w in words], np.int64), np.zeros(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    width = min(int(size.max(initial=1)), WIDE) + 1
    matrix = np.array([w if len(w) < WIDE else "" for w in words], f"<U{width}").view(np.uint32).reshape(len(words), width) if words else np.zeros((0, 2), np.uint32)
    letters = np.zeros(len(words), np.uint64)
    for column in matrix.T:
        letters |= np.where(column > 0, np.uint64(1) << (column.astype(np.uint64) % np.uint64(64)), np.uint64(0))
    found = [np.zeros(0, np.int64)]
    for i, j in _meetings(key, side):
        a, b = own[i], own[j]
        wide = (size[a] >= WIDE) | (size[b] >= WIDE)
        near = wide | (np.bitwise_count(letters[a] ^ letters[b]) <= 2)  # one edit brings one letter and takes one, at most
        a, b, wide = a[near], b[near], wide[near]
        near = ~wide
        near[near] = _near_pairs(matrix[a[near]], matrix[b[near]])
        near[wide] = [one_edit(words[x], words[y]) for x, y in zip(a[wide].tolist(), b[wide].tolist(), strict=True)]
        a, b = a[near], b[near]
        turned = (size[a] == size[b]) & (place[a] > place[b])
        found.append(np.where(turned, b, a) * len(words) + np.where(turned, a, b))
    pairs = np.unique(np.concatenate(found))
    return pairs // max(1, len(words)), pairs % max(1, len(words))


def _pairs(table: pa.Table, key: np.ndarray, side: np.ndarray, row: np.ndarray) -> pa.Table:
    """(word, n, other, other_n) of the rows of a table (word, n) that meet by key and side and are one edit apart."""
    distinct = table["word"].combine_chunks().dictionary_encode()
    own, words = distinct.indices.to_numpy().astype(np.int64), distinct.dictionary
    n = np.zeros(len(words), np.int64)
    n[own] = table["n"].to_numpy()
    a, b = _links(words.to_pylist(), own[row], key, side)
    trimmed()
    return pa.table({"word": words.take(pa.array(a)), "n": pa.array(n[a]), "other": words.take(pa.array(b)), "other_n": pa.array(n[b])})


def near_words(postings: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(word, n, other, other_n) of all words one edit apart that post a gram where they can meet, both ways, each once.

    They meet at the same place if they are of equal length; else the longer one has the gram at the same place or one on.
    Lists of grams are merged within shards, and only pairs that pass the exact check leave a task. The lists of a gram of
    more than `block` postings are told apart by place and length first; one that is still longer is cut into blocks, each
    pair of which is a shard. Grams that long are of LONGEST code points, or else the dictionary extends them."""
    postings = staged(postings, "postings")
    shards = max(1, -(-postings.count() // shard))
    hot = postings.groupBy("gram").agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select("gram", F.lit(True).alias("hot"))
    rows = postings.join(hot, "gram", "left")

    def merge(table: pa.Table) -> pa.Table:
        gram = table["gram"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        place, size, row = table["place"].to_numpy().astype(np.int64), table["size"].to_numpy().astype(np.int64), np.arange(table.num_rows)
        cell = lambda p, s, both: ((gram * (int(size.max()) + 2) + s) * (int(place.max()) + 3) + p + 1) * 2 + both
        key = np.concatenate([cell(place, size, 0), cell(place, size, 1), cell(place, size - 1, 1), cell(place - 1, size - 1, 1)])
        return _pairs(table, key, np.repeat([0, 1, 2, 2], len(row)), np.tile(row, 4))

    def merge_list(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy().astype(np.int64)
        return _pairs(table, np.zeros(len(side), np.int64), side, np.arange(len(side)))

    found = "word string, n long, other string, other_n long"
    few = rows.filter("hot is null").groupBy(F.pmod(F.xxhash64("gram"), F.lit(shards))).applyInArrow(merge, found)
    size, place = F.col("size"), F.col("place")
    meets = [(place, size, 0, False), (place, size, 1, True), (place, size - 1, 2, True), (place - 1, size - 1, 2, True)]
    cells = F.array(*[F.struct(p.alias("place"), s.alias("size"), F.lit(side).alias("side"), F.lit(both).alias("both")) for p, s, side, both in meets])
    lists = rows.filter("hot").select("gram", "word", "n", F.explode(cells).alias("c")).select(F.xxhash64("gram", "c.place", "c.size", "c.both").alias("list"), "c.side", "word", "n")
    lists = staged(lists, "hot-lists")
    blocks = lists.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(mine, other) * F.col("blocks") + F.greatest(mine, other))
    many = lists.join(blocks, "list").select("list", F.explode(every).alias("pair"), "side", "word", "n").groupBy("list", "pair").applyInArrow(merge_list, found)
    once = staged(few.unionByName(many).distinct(), "near-words")
    return once.unionByName(once.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots_of(words: DataFrame) -> DataFrame:
    """words (word, form, ...) with root, the end of the chain of forms; a word without a form is its own root.

    Each round doubles the steps that a word with a form has gone. A form is at least twice as frequent as its word, so
    chains have at most as many steps as a count has bits, and the rounds are few."""
    with scratch(words.sparkSession) as own:
        now, moved = staged(words.filter("form is not null").select("word", F.col("form").alias("root")), "roots"), 1
        while moved:
            on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
            ahead = now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            before, now = now, staged(ahead, "roots")
            own.drop(before)
            moved = now.filter("moved").limit(1).count()
        own.keep(now)
    return words.join(now.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = 5, min_count: int = 3, ratio: int = 2, changes: Callable[[int | None], Callable[[str], str]] = as_written, most: int = FREQUENT
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts of at least `least` code points and min_count uses.

    Words are maximal runs of ASCII letters and U+00C0 to U+00FF, A-Z in lower case, each changed by changes(id), which does not
    lengthen it.
    Two words are near if one inserted, deleted or replaced code point tells them apart. form is the near word of
    largest n (ties: the smallest in code-point order) if that is at least ratio times the word's n; root is where the
    chain of forms ends. Null texts have no words. Repeated rows count each. An empty
    table gives an empty result.

    `least` is LONGEST at least: then a word's grams outnumber those that an edit can affect, and no pair is missed.
    """
    if least < LONGEST:
        raise ValueError(f"words of fewer than {LONGEST} code points may share no gram")
    with scratch(docs.sparkSession) as own:
        rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        words = partial_counts(rows, least, changes).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
        words = staged(words, "words")
        near = near_words(gram_postings(words, most))
        best = F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other"))).alias("best")
        joined = words.join(near.groupBy("word").agg(F.count("*").alias("n_near"), best), "word", "left")
        often = -F.col("best.rank") >= ratio * F.col("n")
        formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.rank")).alias("form_n"))
        formed = own.keep(staged(formed, "forms"))
    return roots_of(formed).select("word", "n", "n_near", "form", "form_n", "root")
