"""Operator 2, BPE encoding and decoding by an index of pair occurrences over the distinct pre-tokens of a slice of a
partition: what a Python worker can hold of it at a time."""

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.spans import code_points, distinct_spans, gathered, ranges, sliced

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Texts whose pre-tokens share one index; bounds the memory of a Python worker.
SLICE = 256
#: What an apostrophe splits off, as of the pre-tokeniser's pattern. Fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Code point to its class in the pre-tokeniser's pattern."""
    every = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def pre_tokens(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts that lie between the bounds.

    A run of letters, of numbers or of other visible characters takes one plain space before it; of a longer run of
    white space the last character stays apart from the rest; an apostrophe that starts a token may take the letters
    of a contraction.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _classes()[codes]
    first = np.zeros(n + 1, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True
    before = np.concatenate([[OTHER], kind[:-1]])
    start = first[:n] | (kind != before)
    space = kind == SPACE
    ends_run = np.concatenate([start[1:], [True]]) & space
    followed = np.concatenate([~first[1:n], [False]]) & ends_run
    last = np.flatnonzero(followed)
    start[last] = True
    plain = last[codes[last] == 32]
    start[plain + 1] = False
    quote = np.flatnonzero((codes == 39) & ~first[1:])
    quote = quote[first[quote] | ((before[quote] != OTHER) & (codes[quote - 1] != 32))]
    for tail in CONTRACTIONS:
        at = quote[quote + len(tail) < n]
        for k, c in enumerate(tail, 1):
            at = at[(codes[at + k] == ord(c)) & ~first[at + k]]
        for k in range(1, len(tail) + 1):
            start[at + k] = False
        after = at + len(tail) + 1
        after = after[after < n]
        start[after[kind[after] != SPACE]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


class Vocabulary:
    """A byte-level BPE vocabulary as the tokenizers library stores it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = (self.left << 32) | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = ids[c]
        pairs = np.arange(1 << 16)
        self.byte_ranks = self.ranks(self.byte_ids[pairs >> 8], self.byte_ids[pairs & 255])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 where there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _post(index: dict[int, list], active: list[int], ranks: np.ndarray, at: np.ndarray) -> None:
    """Add positions to the lists of their ranks."""
    order = np.argsort(ranks, kind="stable")
    ranks, at = ranks[order], at[order]
    cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    for rank, part in zip(ranks[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
        if rank in index:
            index[rank].append(part)
        else:
            index[rank] = [part]
            heapq.heappush(active, rank)


def encode_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the bounds of each word among them.

    The index maps the rank of each pair to the positions where it stands, over all words at once. Ranks are applied
    in ascending order; a merge at a position changes the pairs with its two neighbours, and these are posted anew.
    Positions that are out of date are found out when their rank comes up.
    """
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    size = np.array([len(w) for w in words], np.int64)
    stop = np.cumsum(size)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    symbol = vocab.byte_ids[data]
    following, previous = np.arange(1, n + 1), np.arange(-1, n - 1)
    following[stop[size > 0] - 1] = -1
    previous[(stop - size)[size > 0]] = -1
    index: dict[int, list] = {}
    active: list[int] = []
    left = np.flatnonzero(following >= 0)
    ranks = vocab.byte_ranks[(data[left].astype(np.int64) << 8) | data[left + 1]]
    if (ranks >= 0).any():
        _post(index, active, ranks[ranks >= 0], left[ranks >= 0])
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b, c = int(vocab.left[rank]), int(vocab.right[rank]), int(vocab.merged[rank])
        then = following[at]
        ok = (symbol[at] == a) & (then >= 0)
        ok &= symbol[then] == b
        at = at[ok]
        if not len(at):
            continue
        then = following[at]
        if a == b and len(at) > 1:  # of overlapping occurrences every second one goes
            chained = np.concatenate([[False], at[1:] == then[:-1]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            then = following[at]
        after = following[then]
        symbol[at], symbol[then] = c, -1
        following[at] = after
        inner = after >= 0
        previous[after[inner]] = at[inner]
        before = previous[at]
        before = before[before >= 0]
        places = np.concatenate([before, at[inner]])
        if len(places):
            ranks = vocab.ranks(symbol[places], symbol[following[places]])
            found = ranks >= 0
            if found.any():
                _post(index, active, ranks[found], places[found])
    alive = symbol >= 0
    kept = np.concatenate([[0], np.cumsum(alive)])
    return symbol[alive], kept[np.concatenate([[0], stop])]


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the bounds of each text among them."""
    parts, owner, special = [], [], []
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
    for i, text in enumerate(texts):
        if cut is None or not any(s in text for s in vocab.special):
            parts.append(text)
            owner.append(i)
            continue
        for piece in cut.split(text):
            if piece in vocab.special:
                special.append((len(parts), vocab.special[piece]))
                parts.append("")
            else:
                parts.append(piece)
            owner.append(i)
    numbers: dict[bytes, int] = {}
    words: list[bytes] = []
    tokens, per_part = [], []
    for lo, hi in ranges(parts):
        codes, bounds = code_points(parts[lo:hi])
        starts, ends = pre_tokens(codes, bounds)
        spans, inverse = distinct_spans(codes, starts, ends)
        own = []
        for word in spans:
            if word not in numbers:
                numbers[word] = len(words)
                words.append(word.decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))
            own.append(numbers[word])
        tokens.append(np.array(own, np.int64)[inverse])
        per_part.append(np.diff(np.searchsorted(starts, bounds)))
    ids, offsets = encode_words(words, vocab)
    if special:  # each special string is a word of its own with one id
        ids = np.concatenate([ids, [i for _, i in special]])
        offsets = np.concatenate([offsets, offsets[-1] + 1 + np.arange(len(special))])
    token = np.concatenate([*tokens, np.zeros(0, np.int64)])
    count = np.concatenate([*per_part, np.zeros(0, np.int64)])
    if special:
        where = np.concatenate([[0], np.cumsum(count)])
        token = np.insert(token, [where[p] for p, _ in special], len(words) + np.arange(len(special)))
        count[[p for p, _ in special]] = 1
    at, lengths = gathered(offsets, token)
    upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(count)])]
    last = np.zeros(len(texts) + 1, np.int64)
    np.maximum.at(last, np.array(owner, np.int64) + 1, upto[1:])
    return ids[at], np.maximum.accumulate(last)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with token_ids, the ids of the whole text by the vocabulary at path; a column of that name is replaced.

    Null counts as empty, and an empty text has no ids. The strings of special tokens become their ids, as the
    library does by default. The vocabulary file must be at path on every executor.
    """

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for batch in sliced(batches, SLICE):
            ids, bounds = encode_texts([t or "" for t in batch.to_pylist()], vocab)
            yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))

    keep = [c for c in docs.columns if c != "token_ids"]
    return docs.select(*[F.col(f"`{c}`") for c in keep], encoded(F.col(text_col)).alias("token_ids"))


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """docs with decoded, the text of the ids; a column of that name is replaced.

    Bytes that are no UTF-8 become U+FFFD, special tokens their strings; null ids give an empty text.
    """

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        word = vocabulary(path).bytes.__getitem__
        for batch in sliced(batches, SLICE):
            bounds = batch.offsets.to_numpy().tolist()
            missing = batch.is_null().to_numpy(zero_copy_only=False).tolist()
            flat = batch.values
            text = lambda a, b: b"".join(map(word, flat.slice(a, b - a).to_numpy(zero_copy_only=False).tolist())).decode("utf-8", "replace")
            yield pa.array(["" if gone else text(a, b) for a, b, gone in zip(bounds[:-1], bounds[1:], missing, strict=True)], pa.string())

    keep = [c for c in docs.columns if c != "decoded"]
    return docs.select(*[F.col(f"`{c}`") for c in keep], decoded(F.col(ids_col)).alias("decoded"))


def ids_sha256(ids: Column) -> Column:
    """SHA-256 of the ids as little-endian unsigned 32-bit integers, in lowercase hex; null counts as no ids."""

    @F.arrow_udf("string")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in sliced(batches, SLICE):
            bounds, flat = batch.offsets.to_numpy(), batch.values
            raw = lambda a, b: flat.slice(a, b - a).to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            yield pa.array([hashlib.sha256(raw(a, b)).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())

    return hashed(ids)
