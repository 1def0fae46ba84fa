"""Operator 10, line dedup: sharded minimal perfect hashes over distinct lines, whose arrays count and are probed."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.staging import quoted, scratch, staged
from millrace.llm.spans import U, mixed, sliced

STRIPPED = " \t\n\x0b\x0c\r"
#: Lines of one shard, about.
SHARD = 250_000
#: Lines that a task counts before it hands them on, and bytes of index that a Python worker holds, at most.
HELD, ROOM = 1 << 19, 1 << 26
#: Stands for a null id, below all others.
NO_ID = -(1 << 63)


def _key(line: str, least: int) -> tuple[int, int] | None:
    """128-bit hash of a line's key, or None where the key has fewer than least code points."""
    key = line.strip(STRIPPED)
    if len(key) < least:
        return None
    digest = xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _keys(texts: list[str | None], least: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Keys of the distinct lines of each text as rows (h, check), the number of each row's text, and how many it has."""
    rows = [{k for line in (t or "").split("\n") if (k := _key(line, least))} for t in texts]
    flat = np.array([k for r in rows for k in r], np.int64).reshape(-1, 2)
    sizes = list(map(len, rows))
    return flat, np.repeat(np.arange(len(texts)), sizes), sizes


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (h, check, docs, last), one per key: documents added, the largest id."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
    if not len(rows):
        return rows
    return np.column_stack([rows[first, :2], np.add.reduceat(rows[:, 2], first), np.maximum.reduceat(rows[:, 3], first)])


def partial_lines(docs: DataFrame, least: int) -> DataFrame:
    """(h, check, docs, last) of the lines of (id, text), each once per HELD or so distinct lines of a task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows[:, c]) for c in range(4)], ["h", "check", "docs", "last"])
        for batch in sliced(batches):
            flat, text, _ = _keys(batch["text"].to_pylist(), least)
            ids = pc.fill_null(batch["id"], NO_ID).to_numpy()[text]
            parts.append(np.column_stack([flat, np.ones(len(flat), np.int64), ids]))
            size += len(flat)
            if size >= 2 * HELD:
                parts = [_summed(parts)]
                size = len(parts[0])
                if size >= HELD:
                    yield out(parts.pop())
                    size = 0
        if parts:
            yield out(_summed(parts))

    return docs.select("id", "text").mapInArrow(counted, "h long, check long, docs long, last long")


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: levels of bits, where a key sits at the first level on which
    it met no other; its slot is the number of bits before it. Bits are packed in words, each with the number of bits
    before it: about four and a half bits a key."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.uint32)
        self.ranks = np.cumsum(counts, dtype=np.uint32) - counts
        self.starts = np.cumsum([0, *(size // 64 for size in sizes)])

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.ranks.nbytes

    @staticmethod
    def _at(h: np.ndarray, check: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mixed(mixed(h ^ salt) + check) % U(size)).astype(np.int64)

    @classmethod
    def of(cls, h: np.ndarray, check: np.ndarray) -> "PerfectHash":
        sizes, words = [], [np.zeros(0, U)]
        while len(h):
            sizes.append(-(-max(64, 2 * len(h)) // 64) * 64)
            at = cls._at(h, check, len(sizes) - 1, sizes[-1])
            alone = np.bincount(at, minlength=sizes[-1]) == 1
            words.append(np.packbits(alone, bitorder="little").view(U))
            again = ~alone[at]
            h, check = h[again], check[again]
        return cls(sizes, np.concatenate(words))

    def slots(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that is not of the set gets some slot or -1."""
        out = np.full(len(h), -1)
        open_ = np.arange(len(h))
        for level, size in enumerate(self.sizes):
            at = self._at(h[open_], check[open_], level, size)
            word, bit = self.starts[level] + (at >> 6), (at & 63).astype(U)
            held = self.words[word]
            here = (held >> bit) & U(1) == 1
            below = np.bitwise_count(held & ((U(1) << bit) - U(1)))
            out[open_[here]] = (self.ranks[word] + below)[here]
            open_ = open_[~here]
        return out


def _shard_of(h: Column, shards: int) -> Column:
    return F.pmod(h, F.lit(shards))


def _arrays(table: pa.Table) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]:
    """The perfect hash of a shard's distinct lines, and by slot the row of its key, the documents, the largest id.

    Rows may hold a line in parts: each adds to the counter of its slot."""
    h, check = (table[c].to_numpy().view(U) for c in ("h", "check"))
    row = np.lexsort((check, h))
    row = row[np.concatenate([[True], (np.diff(h[row]) != 0) | (np.diff(check[row]) != 0)])]
    hashed = PerfectHash.of(h[row], check[row])
    slot = hashed.slots(h, check)
    one, docs, last = np.empty(len(row), np.int64), np.zeros(len(row), np.int64), np.full(len(row), NO_ID)
    one[slot] = np.arange(len(h))
    np.add.at(docs, slot, table["docs"].to_numpy())
    np.maximum.at(last, slot, table["last"].to_numpy())
    return hashed, one, docs, last


def repeated_lines(parts: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(h, check, docs, last) of the lines of at least min_docs documents, counted in the arrays of each shard."""

    def count(table: pa.Table) -> pa.Table:
        _, one, docs, last = _arrays(table)
        often = docs >= min_docs
        lines = table.select(["h", "check"]).take(pa.array(one[often]))
        return lines.append_column("docs", pa.array(docs[often])).append_column("last", pa.array(last[often]))

    return parts.groupBy(_shard_of(F.col("h"), shards)).applyInArrow(count, "h long, check long, docs long, last long")


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the words of its hash, by slot fingerprint and last id, and bytes, what it takes in memory."""

    def build(table: pa.Table) -> pa.Table:
        hashed, one, _, last = _arrays(table)
        fingerprints = table["check"].to_numpy()[one]
        return pa.table(
            {
                "shard": table["shard"][:1],
                "bytes": pa.array([hashed.nbytes + fingerprints.nbytes + last.nbytes]),
                "levels": pa.array([np.array(hashed.sizes, np.int64).tobytes()], pa.binary()),
                "words": pa.array([hashed.words.tobytes()], pa.binary()),
                "fingerprints": pa.array([fingerprints.tobytes()], pa.binary()),
                "last": pa.array([last.tobytes()], pa.binary()),
            }
        )

    schema = "shard long, bytes long, levels binary, words binary, fingerprints binary, last binary"
    return lines.withColumn("shard", _shard_of(F.col("h"), shards)).groupBy("shard").applyInArrow(build, schema)


class Shard:
    """The arrays of one row of the index."""

    def __init__(self, row: dict):
        self.hashed = PerfectHash(np.frombuffer(row["levels"], np.int64).tolist(), np.frombuffer(row["words"], U))
        self.fingerprints, self.last = np.frombuffer(row["fingerprints"], U), np.frombuffer(row["last"], np.int64)

    @property
    def nbytes(self) -> int:
        return self.hashed.nbytes + self.fingerprints.nbytes + self.last.nbytes

    def dropped(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each line is indexed and its largest id is another than the one it stands in."""
        slot = self.hashed.slots(h, check)
        at = np.maximum(slot, 0)
        return (slot >= 0) & (self.fingerprints[at] == check) & (self.last[at] != ids)


def groups_of(sizes: list[tuple[int, int]], room: int) -> list[list[int]]:
    """Shards (shard, bytes) in groups of at most room bytes; a larger shard is a group of its own."""
    groups, used = [], room
    for shard, size in sizes:
        if used + size > room:
            groups.append([])
            used = 0
        groups[-1].append(shard)
        used += size
    return groups


def load(index: DataFrame, shards: list[int]) -> Broadcast:
    """Some shards of the index, at most ROOM bytes or one shard, for every worker."""
    rows = index.filter(F.col("shard").isin(shards)).toArrow().to_pylist()
    return index.sparkSession.sparkContext.broadcast({r["shard"]: Shard(r) for r in rows})


def _gone(lines: list[list[str]], ids: pa.Array, index: dict[int, Shard], shards: int, least: int) -> list[set[int]]:
    """Of each text, the places of the lines that the arrays of some shards say to drop."""
    keys = [(n, k, key) for n, own in enumerate(lines) for k, line in enumerate(own) if (key := _key(line, least))]
    pair = np.array([key for _, _, key in keys], np.int64).reshape(-1, 2)
    own = pc.fill_null(ids, NO_ID).to_numpy()[[n for n, _, _ in keys]] if keys else np.zeros(0, np.int64)
    gone, shard = np.zeros(len(keys), bool), pair[:, 0] % shards
    for s in np.unique(shard).tolist():
        at = np.flatnonzero(shard == s)
        if s in index:
            gone[at] = index[s].dropped(pair[at, 0].view(U), pair[at, 1].view(U), own[at])
    out: list[set[int]] = [set() for _ in lines]
    for i in np.flatnonzero(gone).tolist():
        out[keys[i][0]].add(keys[i][1])
    return out


def _kept(lines: list[str], gone: set[int]) -> str:
    return "\n".join([x for k, x in enumerate(lines) if k not in gone] if gone else lines)


def without_indexed(text: Column, ident: Column, known: Broadcast, shards: int, least: int) -> Column:
    """struct<n_dropped, kept>: the text without the lines that an index says to drop."""

    @F.arrow_udf("struct<n_dropped: long, kept: string>")
    def kept_lines(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ids in sliced(batches):
            lines = [(t or "").split("\n") for t in texts.to_pylist()]
            out = _gone(lines, ids, known.value, shards, least)
            kept = [_kept(own, bad) for own, bad in zip(lines, out, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(map(len, out), pa.int64()), pa.array(kept, pa.string())], ["n_dropped", "kept"])

    return kept_lines(text, ident)


def dropped_lines(text: Column, ident: Column, known: Broadcast, shards: int, least: int) -> Column:
    """array<int>: places of the lines of a text that some shards of an index say to drop."""

    @F.arrow_udf("array<int>")
    def places(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ids in sliced(batches):
            lines = [(t or "").split("\n") for t in texts.to_pylist()]
            yield pa.array([sorted(x) for x in _gone(lines, ids, known.value, shards, least)], pa.list_(pa.int32()))

    return places(text, ident)


def without(text: Column, places: Column) -> Column:
    """struct<n_dropped, kept>: the text without the lines at some places; null is none."""

    @F.arrow_udf("struct<n_dropped: long, kept: string>")
    def kept_lines(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in sliced(batches):
            gone = [set(p or ()) for p in places.to_pylist()]
            kept = [_kept((t or "").split("\n"), bad) for t, bad in zip(texts.to_pylist(), gone, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(map(len, gone), pa.int64()), pa.array(kept, pa.string())], ["n_dropped", "kept"])

    return kept_lines(text, places)


def drop_repeated_lines(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    carry: Sequence[str] | None = None,
    min_docs: int = 3,
    least: int = 20,
    shard: int = SHARD,
    room: int = ROOM,
) -> DataFrame:
    """The carried columns (default: all) of every row, with n_lines, n_dropped and kept_text.

    Lines are what lies between line feeds; null and empty texts are one empty line. A line's key is the line without
    ASCII white space at its ends, A-Z in lower case. Keys of at least `least` code points that at least min_docs rows
    hold lose their lines in every row but those with the largest id that holds them; null ids are the smallest,
    and where all are null all stay. The other lines stay in order. Carried columns with the name of a result
    column are replaced. An empty table gives an empty result.

    Each task sums its own lines first, so that a frequent line reaches its shard once per task. The lines that repeat
    often enough are indexed again, and documents probe the index where they stand: lines never shuffle. Of the index
    workers hold `room` bytes at a time. A larger one is probed group by group of its shards, a pass over the texts
    each; then the places of dropped lines join the texts by row, which shuffles texts once.
    """
    columns = [c for c in (docs.columns if carry is None else carry) if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = docs.select(F.struct(*map(quoted, columns)).alias("_in"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("bigint").alias("n_lines")
    with scratch(docs.sparkSession) as own:
        parts = staged(partial_lines(rows, least), "line-counts")
        repeated = staged(repeated_lines(parts, max(1, -(-parts.count() // shard)), min_docs), "repeated-lines")
        shards = max(1, -(-repeated.count() // shard))
        index = staged(build_index(repeated, shards), "line-index")
        groups = groups_of([(r["shard"], r["bytes"]) for r in index.select("shard", "bytes").orderBy("shard").collect()], room)
        if len(groups) <= 1:
            known = load(index, groups[0] if groups else [])
            result = rows.select("_in", lines, without_indexed(F.col("text"), F.col("id"), known, shards, least).alias("out"))
        else:
            rows = own.keep(staged(rows.withColumn("row", F.monotonically_increasing_id()), "line-rows"))
            gone = None
            for group in groups:
                known = load(index, group)
                found = rows.select("row", dropped_lines(F.col("text"), F.col("id"), known, shards, least).alias("gone")).filter(F.size("gone") > 0)
                found = own.keep(staged(found, "dropped-lines"))
                known.unpersist()
                gone = found if gone is None else gone.unionByName(found)
            places = gone.groupBy("row").agg(F.flatten(F.collect_list("gone")).alias("gone"))
            result = rows.join(places, "row", "left").select("_in", lines, without(F.col("text"), F.col("gone")).alias("out"))
    return result.select("_in.*", "n_lines", "out.n_dropped", F.col("out.kept").alias("kept_text"))
