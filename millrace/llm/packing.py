"""Operator 11, best-fit packing: bins filled by best fit, then improved by exchanges between underfull bins."""

import itertools
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.functions.staging import quoted, scratch, staged
from millrace.llm.spans import sliced

#: Tokens of a sequence, and the id behind every document.
LIMIT, END = 4096, 1
#: Pieces that one task packs, about.
SHARD = 8192
#: Chunks of a generation whose ids a worker remembers, and code points of a remembered chunk, at most.
KNOWN, SHORT = 1 << 18, 64
#: A round that empties a smaller share of the underfull bins is the last.
LEAST_GAIN = 0.001
RESULT = ("piece", "start", "length", "ids", "sequence_id", "offset")


def byte_alphabet() -> dict[int, str]:
    """Byte to its character in a byte-level vocabulary: visible Latin-1 as it is, the others from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class Chunks(dict):
    """Ids, as little-endian unsigned 32-bit integers, of chunks without white space; unknown ones are encoded.

    A chunk of Latin characters has the ids of its lower case; one that ends in a mark behind a letter or digit has those
    of the rest and of the mark; one of letters alone goes straight to the vocabulary's merges. All others pass the whole
    library. Remembered chunks are kept in two generations, so that frequent ones stay."""

    MARKS = frozenset(".,;:!?")

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.alphabet, self.old = self.library.model, byte_alphabet(), {}

    def _ids(self, chunk: str) -> bytes:
        if chunk and "<" not in chunk and (chunk.isascii() or max(chunk) < "\u0250"):
            low = chunk.lower()
            if low != chunk:
                return self[low]
            if chunk.isalpha():
                word = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.alphabet)
                return np.array([t.id for t in self.model.tokenize(word)], "<u4").tobytes()
            if chunk[-1] in self.MARKS and chunk[-2:-1].isalnum():
                return self[chunk[:-1]] + self[chunk[-1]]
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._ids(chunk)
        if len(chunk) <= SHORT:
            if len(self) >= KNOWN:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def _chunks(path: str) -> Chunks:
    return Chunks(path)


def document_ids(text: Column, path: str, end: int = END) -> Column:
    """Ids of a text by the tokenizer at path, then `end`, as the bytes of little-endian unsigned 32-bit integers.

    The tokenizer drops white space and no token of it crosses any, so a text is encoded chunk by chunk, and a chunk
    that comes again is looked up. Null counts as empty: `end` alone.
    """
    last = np.array([end], "<u4").tobytes()

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _chunks(path)
        for batch in sliced(batches):
            split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in batch.to_pylist()]
            yield pa.array([b"".join(map(known.__getitem__, chunks)) + last for chunks in split], pa.binary())

    return encoded(text)


def pieces_of(docs: DataFrame, path: str, text_col: str = "text", carry: Sequence[str] | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """The carried columns (default: all) once per piece, with piece, start, length and ids (little-endian unsigned 32-bit).

    A document's ids and one `end` behind them are cut after every `limit` ids; only the last piece may be shorter. A
    null or empty text is one piece of `end` alone. Carried columns with the name of a result column are replaced. An
    empty table gives no pieces.
    """
    columns = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    rows = docs.select(F.struct(*map(quoted, columns)).alias("_in"), document_ids(F.col(text_col), path, end).alias("_ids"))
    size = F.octet_length("_ids") / 4
    rows = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.ceil(size / limit).cast("int") - 1)))
    ids = F.substring("_ids", F.col("_piece") * (4 * limit) + 1, F.lit(4 * limit))
    start = (F.col("_piece") * F.lit(limit).cast("long")).alias("start")
    return rows.select("_in.*", F.col("_piece").alias("piece"), start, ids.alias("ids")).select("*", (F.octet_length("ids") / 4).cast("long").alias("length"))


def best_fit(lengths: list[int], limit: int) -> list[int]:
    """Bin of each item: the longest first, each into the fullest bin that has room for it."""
    open_, mask, bins = defaultdict(list), 0, 0
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = mask >> lengths[i]
        if room:
            gap = lengths[i] + (room & -room).bit_length() - 1
            own = open_[gap].pop()
            if not open_[gap]:
                mask ^= 1 << gap
        else:
            gap, own, bins = limit, bins, bins + 1
        out[i] = own
        gap -= lengths[i]
        if gap:
            open_[gap].append(own)
            mask |= 1 << gap
    return out


class Index:
    """From lengths to the underfull bins that can give that much."""

    def __init__(self):
        self.holders: dict[int, set[int]] = defaultdict(set)
        self.present = 0

    def hold(self, b: int, bits: int) -> None:
        self.present |= bits
        while bits:
            self.holders[bits.bit_length() - 1].add(b)
            bits ^= 1 << (bits.bit_length() - 1)

    def release(self, b: int, bits: int) -> None:
        while bits:
            n = bits.bit_length() - 1
            bits ^= 1 << n
            self.holders[n].discard(b)
            if not self.holders[n]:
                self.present &= ~(1 << n)


class Bins:
    """Bins of items, with indexes of what single items and pairs of the underfull ones measure."""

    def __init__(self, lengths: list[int], bins: list[int], limit: int):
        self.limit = limit
        self.items: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.fill: dict[int, int] = defaultdict(int)
        for i, (n, b) in enumerate(zip(lengths, bins, strict=True)):
            self.items[b][n].append(i)
            self.fill[b] += n
        self.ones, self.twos = Index(), Index()
        self.held: dict[int, tuple[int, int]] = {}
        for b in self.fill:
            self._note(b)

    def _note(self, b: int) -> None:
        """Bring the indexes up to date with the bin; full ones are not in them."""
        ones = twos = 0
        if 0 < self.fill[b] < self.limit:
            ones = sum(1 << n for n in self.items[b])
            for n, same in self.items[b].items():
                twos |= (ones if len(same) > 1 else ones & ~(1 << n)) << n
        before = self.held.get(b, (0, 0))
        for index, old, new in ((self.ones, before[0], ones), (self.twos, before[1], twos)):
            index.release(b, old & ~new)
            index.hold(b, new & ~old)
        self.held[b] = ones, twos

    def _pair(self, b: int, total: int) -> tuple[int, int]:
        own = self.items[b]
        return next((n, total - n) for n in own if total - n in own and (2 * n != total or len(own[n]) > 1))

    def trade(self, a: int, out: Sequence[int], b: int, back: Sequence[int]) -> None:
        """Items of the lengths `out` go from a to b, those of the lengths `back` from b to a."""
        moved = [(taker, n, giver) for giver, taker, lengths in ((a, b, out), (b, a, back)) for n in lengths]
        for taker, n, item in [(taker, n, self.items[giver][n].pop()) for taker, n, giver in moved]:
            self.items[taker][n].append(item)
        self.fill[a] += sum(back) - sum(out)
        self.fill[b] -= sum(back) - sum(out)
        for bin_ in (a, b):
            for n in {*out, *back}:
                if not self.items[bin_][n]:
                    del self.items[bin_][n]
            self._note(bin_)
            if not self.fill[bin_]:
                del self.fill[bin_], self.items[bin_], self.held[bin_]

    def _donor(self, index: Index, a: int, given: int, least: int) -> tuple[int, int] | None:
        """(gain, bin): the largest gain over `least` for which another bin has what is as much over `given`, so that bin a
        does not overflow and the sum of squares rises."""
        window = (index.present >> (given + 1)) & ((1 << (self.limit - self.fill[a])) - 1)
        while (gain := window.bit_length()) > least:
            best = min((b for b in index.holders[given + gain] if b != a), key=lambda b: (self.fill[b], b), default=None)
            if best is not None and self.fill[best] < self.fill[a] + gain:
                return gain, best
            window ^= 1 << (gain - 1)
        return None

    def find(self, a: int) -> tuple[Sequence[int], int, Sequence[int]] | None:
        """The exchange that fills bin a most: a move, one for one, or two for one either way."""
        own = self.items[a]
        singles = [(x,) for x in sorted(own)]
        twos = ((x, y) for x, y in itertools.combinations_with_replacement(sorted(own), 2) if x != y or len(own[x]) > 1)
        asked = itertools.chain(((self.ones, out) for out in [(), *singles]), ((self.twos, out) for out in singles), ((self.ones, out) for out in twos))
        best, found = 0, None
        for index, out in asked:
            if (hit := self._donor(index, a, sum(out), best)) is not None:
                best, b = hit
                found = out, b, (sum(out) + best,) if index is self.ones else self._pair(b, sum(out) + best)
                if self.fill[a] + best == self.limit:
                    break
        return found

    def improve(self) -> None:
        """Exchanges, each of which raises the sum of the squares of the fills, until none is left: some bins fill up,
        others run empty and go."""
        changed = True
        while changed:
            changed = False
            for a in sorted((b for b, fill in self.fill.items() if fill < self.limit), key=lambda b: (-self.fill[b], b)):
                while a in self.fill and self.fill[a] < self.limit and (found := self.find(a)) is not None:
                    self.trade(a, *found)
                    changed = True


def pack_shard(lengths: np.ndarray, bins: np.ndarray, limit: int) -> list[list[int]]:
    """Items of each bin after the local search. Items that share a bin begin there; where none do, best fit begins."""
    sizes = lengths.tolist()
    number = np.unique(bins, return_inverse=True)[1].tolist()
    fits = number if len(set(number)) < len(sizes) else best_fit(sizes, limit)
    packing = Bins(sizes, fits, limit)
    packing.improve()
    return [[i for n in sorted(own, reverse=True) for i in own[n]] for own in packing.items.values()]


def _round(items: DataFrame, shards: int, turn: int, limit: int) -> DataFrame:
    """(row, length, bin, fill, offset) after every shard of whole bins was packed; a bin goes by its smallest row."""

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        row, length = table["row"].to_numpy(), table["length"].to_numpy()
        groups = pack_shard(length, table["bin"].to_numpy(), limit)
        order = np.array([i for g in groups for i in g], np.int64)
        sizes = np.array([len(g) for g in groups], np.int64)
        first = np.cumsum(sizes) - sizes
        before = np.cumsum(length[order]) - length[order]
        fill, low = np.add.reduceat(length[order], first), np.minimum.reduceat(row[order], first)
        columns = (row[order], length[order], np.repeat(low, sizes), np.repeat(fill, sizes), before - np.repeat(before[first], sizes))
        return pa.table(dict(zip(("row", "length", "bin", "fill", "offset"), columns, strict=True)))

    shard = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(shards))
    return items.select("row", "length", "bin").groupBy(shard).applyInArrow(search, "row long, length long, bin long, fill long, offset long")


def packed(pieces: DataFrame, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """All columns of the pieces (each with a length from 1 to limit) and sequence_id and offset.

    Pieces of `limit` tokens are sequences of their own. The others are dealt to shards, each of which one task packs:
    best fit first, then a local search that trades one item for one, two for one or moves one between underfull bins
    as long as that raises the sum of squared fills. Full bins are done; the underfull ones of all shards are dealt
    anew, as they are, to fewer shards, until one shard has them all, they are as few as their tokens allow, or a
    round empties less than a thousandth of them. Only row numbers and lengths shuffle, until rows are joined with
    their places. sequence_id is a number of one row of the sequence. Of columns named sequence_id, offset or row the
    results replace the first two, and row is kept. An empty table gives an empty result.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    with scratch(pieces.sparkSession) as own:
        rows = own.keep(staged(pieces.select(F.struct(*map(quoted, columns)).alias("_in"), F.col("length"), F.monotonically_increasing_id().alias("row")), "pieces"))
        whole = F.col("length") == limit
        done = [rows.filter(whole).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
        place = ("row", F.col("bin").alias("sequence_id"), "offset")
        open_ = rows.filter(~whole).select("row", F.col("length").cast("long").alias("length"), F.col("row").alias("bin"))
        n, tokens = open_.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        turn, bins = 0, None
        while n:
            shards = max(1, -(-n // shard))
            table = own.keep(staged(_round(open_, shards, turn, limit), "packing"))
            done.append(table.filter(F.col("fill") == limit).select(*place))
            open_ = table.filter(F.col("fill") < limit)
            before = bins
            n, tokens, bins = open_.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.count_if(F.col("offset") == 0)).first()
            full = table.agg(F.count_if((F.col("fill") == limit) & (F.col("offset") == 0))).first()[0]
            turn += 1
            if shards == 1 or bins == -(-tokens // limit) or (before is not None and before - bins - full < LEAST_GAIN * before):
                done.append(open_.select(*place))
                break
        places = done[0]
        for part in done[1:]:
            places = places.unionByName(part)
        return rows.join(places, "row").select("_in.*", "sequence_id", "offset")


def sequences(packing: DataFrame, id_col: str = "sequence_id") -> DataFrame:
    """(sequence_id, n_pieces, ids): the ids of each sequence's pieces, in their places, of a packing that has ids. A
    sequence has at most `limit` pieces, so a group is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return packing.groupBy(id_col).agg(parts.alias("parts")).select(id_col, F.size("parts").alias("n_pieces"), joined.alias("ids"))
