"""Operator 8, MinHash near-dedup: an inverted join on signature coordinates, confirmed on whole shingle sets."""

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.staging import broadcast_if_small, join_groups, quoted, scratch, staged
from millrace.llm.components import components, forest
from millrace.llm.spans import U, code_points, gathered, mixed, ranges, sliced, span_hashes

COORDINATES = 64
#: Rows of up to four numbers that are broadcast, at most: about 10 MB.
MANY = 250_000
#: Rows of a block, and shingles of its texts, about, in comparisons of many rows with many.
BLOCK, SHINGLES = 1024, 1 << 21


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text.

    Words are runs without ASCII white space, with A-Z in lower case. A text of fewer words than width has its whole
    sequence as one shingle; without words it has none.
    """
    sets: list[np.ndarray] = []
    for lo, hi in ranges(texts):
        codes, bounds = code_points(texts[lo:hi])
        codes = codes + np.where((codes >= 65) & (codes <= 90), np.uint32(32), np.uint32(0))
        word = (codes != 32) & ((codes < 9) | (codes > 13))
        edge = np.zeros(len(codes) + 1, bool)
        edge[bounds] = True
        starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
        ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
        hashes = span_hashes(codes, starts, ends)
        first = np.searchsorted(starts, bounds)
        n = max(0, len(hashes) - width + 1)
        joined = hashes[:n].copy()
        for k in range(1, width):
            joined = mixed(joined * U(0x9E3779B97F4A7C15) + hashes[k : n + k])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                sets.append(np.unique(joined[a : b - width + 1]))
            elif b > a:
                short = hashes[a : a + 1]
                for k in range(a + 1, b):
                    short = mixed(short * U(0x9E3779B97F4A7C15) + hashes[k : k + 1])
                sets.append(mixed(short + U(b - a)))
            else:
                sets.append(np.zeros(0, U))
    return sets


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Least permuted hash of each set by coordinate; rows of empty sets hold nothing of use."""
    out = np.zeros((len(sets), coordinates), np.int64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        rng = np.random.default_rng(20)
        seeds = rng.integers(0, 1 << 63, (2, coordinates)).astype(U)
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k in range(coordinates):
            out[full, k] = np.minimum.reduceat((flat ^ seeds[0, k]) * (seeds[1, k] | U(1)), at).astype(np.int64)
    return out


def signed(text: Column, width: int, coordinates: int) -> Column:
    """struct<n_shingles, digest, sig> of each text; digest names the set, and is null where it is empty."""

    @F.arrow_udf("struct<n_shingles: long, digest: binary, sig: array<long>>")
    def signed_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.to_pylist()]
            sizes, digests, sigs = [], [], [np.zeros((0, coordinates), np.int64)]
            for lo, hi in ranges(texts):
                sets = shingle_sets(texts[lo:hi], width)
                sizes += map(len, sets)
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sigs.append(signatures(sets, coordinates))
            flat = np.concatenate(sigs).ravel()
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * coordinates), pa.array(flat))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), sig], ["n_shingles", "digest", "sig"])

    return signed_texts(text)


def postings(nodes: DataFrame, matches: int, coordinates: int) -> DataFrame:
    """(row, token, size, hub): the prefix of each signature, under the tokens that stand in more than one prefix.

    A token is a coordinate with its value. Tokens are ordered by how many signatures hold them, rare first. Two
    signatures with at least `matches` common tokens have one in common among the first coordinates - matches + 1
    of each; tokens that stand in one signature alone fill that prefix without being posted. size is the length of a
    token's list, hub its first row by a hash. Tokens that very many signatures hold are joined by a broadcast.
    """
    tokens = nodes.select("row", F.posexplode("sig")).select("row", F.xxhash64("pos", "col").alias("token"))
    shared = staged(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "shared-tokens")
    ordered = join_groups(tokens, shared, "token", "df", nodes.count() * coordinates)
    ordered = ordered.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    prefix = ordered.filter(F.size("t") >= matches).select("row", F.explode(F.slice("t", 1, F.size("t") - (matches - 1))).alias("t"))
    prefix = staged(prefix.select("row", "t.token"), "prefixes")
    least = F.min(F.struct(F.xxhash64("row").alias("order"), F.col("row"))).alias("h")
    lists = prefix.groupBy("token").agg(F.count("*").alias("size"), least).filter("size > 1").select("token", "size", F.col("h.row").alias("hub"))
    return join_groups(prefix, staged(lists, "lists"), "token", "size", prefix.count())


def merged(one: np.ndarray, other: np.ndarray, matches: int, groups: tuple[np.ndarray, np.ndarray], room: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of signatures of one and of other, of one group, that agree in at least `matches` coordinates.

    The signatures of other are posted under each group, coordinate and value. Of the lists of a signature of one, the
    shortest, all but matches - 1, are merged and collisions counted: a pair above the threshold is in one of them.
    The longer lists are skipped through: only pairs that can still reach the threshold are looked up there, the
    shorter list first. At most about `room` postings are merged at a time.
    """
    n, k = one.shape
    keyed = lambda x, group: ((group[:, None] * k + np.arange(k)) << 16) + x.astype(np.int64) + 32768
    keys = keyed(other, groups[1]).ravel()
    order = np.argsort(keys, kind="stable")
    keys, order = keys[order], order // k
    low, high = (np.searchsorted(keys, keyed(one, groups[0]), side) for side in ("left", "right"))
    rank = np.argsort(high - low, axis=1, kind="stable")
    prefix, suffix = rank[:, : k - matches + 1], rank[:, k - matches + 1 :]
    load = np.concatenate([[0], np.cumsum(np.take_along_axis(high - low, prefix, axis=1).sum(axis=1))])
    left, right, start, m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, len(other)
    while start < n:
        stop = min(start + max(1, room // m), max(start + 1, int(np.searchsorted(load, load[start] + room, "right")) - 1))
        rows = np.repeat(np.arange(start, stop), prefix.shape[1])
        column = prefix[start:stop].ravel()
        first, length = low[rows, column], (high - low)[rows, column]
        upto = np.cumsum(length)
        at = np.repeat(first - (upto - length), length) + np.arange(load[stop] - load[start])
        hits = np.bincount(np.repeat((rows - start) * m, length) + order[at], minlength=(stop - start) * m)
        pairs = np.flatnonzero(hits)
        count = hits[pairs]
        for step in range(suffix.shape[1] + 1):
            left.append(pairs[count >= matches] // m + start)
            right.append(pairs[count >= matches] % m)
            able = (count < matches) & (count + (suffix.shape[1] - step) >= matches)
            pairs, count = pairs[able], count[able]
            if not len(pairs):
                break
            i, j = pairs // m + start, pairs % m
            count = count + (one[i, suffix[i, step]] == other[j, suffix[i, step]])
        start = stop
    return np.concatenate(left), np.concatenate(right)


def shared_counts(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of one list has in common with each set of the other.

    Hashes that few sets hold are counted pair by pair, the others by products of 0/1 matrices.
    """
    n, m = len(one), len(other)
    flat = np.concatenate([*one, *other, np.zeros(0, U)])
    row = np.repeat(np.arange(n + m), [len(s) for s in (*one, *other)])
    column = np.unique(flat, return_inverse=True)[1]
    left = row < n
    width = int(column.max()) + 1 if len(column) else 0
    a, b = np.bincount(column[left], minlength=width), np.bincount(column[~left], minlength=width)
    rare = (a * b > 0) & (a * b <= 256)
    often = np.flatnonzero(a * b > 256)
    at = np.flatnonzero(~left & rare[column])
    at = at[np.argsort(column[at], kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(np.where(rare, b, 0))])
    mine = np.flatnonzero(left & rare[column])
    place, lengths = gathered(offsets, column[mine])
    pairs = np.repeat(row[mine], lengths) * m + row[at][place] - n
    counts = np.bincount(pairs, minlength=n * m).reshape(n, m).astype(np.float32)
    number = np.full(width, -1)
    for lo in range(0, len(often), 2048):
        part = often[lo : lo + 2048]
        number[:] = -1
        number[part] = np.arange(len(part))
        use = number[column] >= 0
        held = np.zeros((n + m, len(part)), np.float32)
        held[row[use], number[column[use]]] = 1
        counts += held[:n] @ held[n:].T
    return counts.astype(np.int64)


def compared(rest: DataFrame, every: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): per cell of (hub, x, y), links that connect what the rows of rest and of every connect there."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            rows = [t["row"].to_numpy() for t in (left, right)]
            one, other = (shingle_sets(t["text"].to_pylist(), width) for t in (left, right))
            common = shared_counts(one, other)
            union = np.array([len(s) for s in one])[:, None] + np.array([len(s) for s in other])[None, :] - common
            hit = (common > 0) & (100 * common >= percent * union) & (rows[0][:, None] != rows[1][None, :])
            i, j = np.nonzero(hit)
            label = forest(len(one) + len(other), i, j + len(one))
            node = np.concatenate(rows)
            linked = np.unique(np.concatenate([i, j + len(one)]))
            return pa.table({"u": node[linked], "v": node[label[linked]]})
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})

    return rest.groupBy("hub", "x", "y").cogroup(every.groupBy("hub", "x", "y")).applyInArrow(compare, "u long, v long")


def promising(rest: DataFrame, every: DataFrame, matches: int, many: int = 4 * BLOCK) -> DataFrame:
    """(side, hub, x, y, row) of the rows that agree in enough coordinates with a row of the other side, of the same
    cell (hub, x, y) and another label. Signatures are cut to 16 bits a coordinate, which may add rows but loses none.
    Cells are merged several at a time, about `many` rows."""

    def found(table: pa.Table) -> list[pa.RecordBatch]:
        side, label = table["side"].to_numpy(), table["label"].to_numpy()
        short = table["short"].combine_chunks().flatten().to_numpy().reshape(len(side), -1)
        cell = np.cumsum(np.concatenate([[False], _changed(table)]))
        one, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = merged(short[one], short[other], matches, (cell[one], cell[other])) if len(one) and len(other) else (np.zeros(0, np.int64),) * 2
        far = label[one[i]] != label[other[j]]
        rows = np.concatenate([np.unique(one[i[far]]), np.unique(other[j[far]])])
        return table.select(["side", "hub", "x", "y", "row"]).take(pa.array(rows)).combine_chunks().to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, many):
                piece = pa.Table.from_batches([batch.slice(at, many)])
                held = piece if held is None else pa.concat_tables([held, piece]).combine_chunks()
                cut = np.flatnonzero(_changed(held))
                if held.num_rows >= many and len(cut):  # the last cell may go on in the next piece
                    yield from found(held.slice(0, int(cut[-1]) + 1))
                    held = held.slice(int(cut[-1]) + 1)
        if held is not None and held.num_rows:
            yield from found(held)

    both = rest.withColumn("side", F.lit(0)).unionByName(every.withColumn("side", F.lit(1)))
    cells = both.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y")
    return cells.mapInArrow(count, "side int, hub long, x int, y int, row long")


def _changed(table: pa.Table) -> np.ndarray:
    """Whether each row but the first is of another cell than the row before it."""
    return np.any([np.diff(table[c].to_numpy()) != 0 for c in ("hub", "x", "y")], axis=0)


def _blocks(rows: Column, shingles: Column) -> Column:
    """In how many blocks rows with so many shingles together are dealt."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(BLOCK)), F.ceil(shingles / F.lit(SHINGLES))).cast("int")


def _block(number: Column) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(7)), number).cast("int")


def _every_block(number: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), number - 1))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): the pairs (hub, row, n_shingles) whose whole shingle sets have 100 * intersection >= percent * union.

    A hub's rows are dealt to blocks. Each text moves once per pair and once more per block of a hub.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = np.zeros(0, U)
        for batch in sliced(batches):
            row, hub, texts = batch["row"].to_numpy(), batch["hub"].to_numpy(), batch["text"].to_pylist()
            hit = np.zeros(len(row), bool)
            for lo, hi in ranges(texts):
                for k, own in enumerate(shingle_sets(texts[lo:hi], width), lo):
                    if row[k] == hub[k]:  # a hub comes before its rows
                        center = own
                        continue
                    common = np.intersect1d(center, own, assume_unique=True).size
                    hit[k] = common > 0 and 100 * common >= percent * (len(center) + len(own) - common)
            yield pa.RecordBatch.from_arrays([pa.array(hub[hit]), pa.array(row[hit])], ["u", "v"])

    sizes = pairs.groupBy("hub").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("blocks"))
    sizes = staged(sizes, "hub-blocks")
    own = pairs.join(broadcast_if_small(sizes), "hub").select("row", "hub", _block(F.col("blocks")).alias("block"))
    hubs = sizes.select(F.col("hub").alias("row"), "hub", _every_block(F.col("blocks")).alias("block"))
    asked = broadcast_if_small(staged(own.unionByName(hubs), "asked"), MANY)
    held = texts.join(asked, "row").select("hub", "block", "row", "text").repartition("hub", "block")
    return held.sortWithinPartitions("hub", "block", F.col("row") != F.col("hub")).mapInArrow(compare, "u long, v long")


def _agreeing(near: DataFrame, short: DataFrame, matches: int) -> DataFrame:
    """(hub, row, hits, n_shingles) of the pairs (hub, row) whose signatures agree in enough coordinates."""
    pairs = near.filter("row <> hub").join(short, "row")
    size = near.filter("row <> hub").groupBy("hub").agg(F.count("*").alias("size"))
    hubs = staged(size.join(short.select(F.col("row").alias("hub"), F.col("short").alias("center")), "hub"), "hubs")
    both = join_groups(pairs, hubs, "hub", "size", near.count())
    hits = F.size(F.filter(F.zip_with("short", "center", lambda x, y: x == y), lambda x: x))
    return both.select("hub", "row", hits.alias("hits"), "n_shingles").filter(F.col("hits") >= matches)


def _labelled(rows: DataFrame, labels: DataFrame, row: str, name: str) -> DataFrame:
    """rows with the component of a row, which is the row itself where it has none."""
    named = broadcast_if_small(labels, MANY).select(F.col("node").alias(row), F.col("component").alias("_label"))
    return rows.join(named, row, "left").withColumn(name, F.coalesce("_label", row)).drop("_label")


def links(nodes: DataFrame, texts: DataFrame, matches: int, width: int, percent: int, coordinates: int) -> DataFrame:
    """(node, component) of the rows of (row, sig, n_shingles) that are linked at all; texts has their (row, text).

    First each posting list has one hub, the row that comes first by a hash, and its other rows are compared with it:
    each row with the first of the hubs that its signature agrees with, then with those of its other hubs that did not
    go to the same hub. Most lists are one component after that. Where the rows of a hub's lists still lie in several, those outside the most frequent
    one are merged with all of them, in blocks of at most about BLOCK by BLOCK rows, and the rows that have any
    partner there are compared on whole sets. Blocks emit rows and links but no pairs. Pairs within one component are
    skipped; no pair that could join two is left out. Texts move for rows that need them only.
    """
    with scratch(nodes.sparkSession) as own:
        with scratch(nodes.sparkSession) as inner:
            lists = inner.keep(staged(postings(nodes, matches, coordinates).select("row", "hub").distinct(), "near-hubs"))
        cut = F.transform("sig", lambda v: (v.bitwiseAND(0xFFFF) - 32768).cast("smallint")).alias("short")
        active = broadcast_if_small(staged(lists.select("row").distinct(), "near-rows"), MANY)
        short = staged(nodes.join(active, "row", "left_semi").select("row", "n_shingles", cut), "active")
        close = staged(_agreeing(lists, short, matches), "close")
        least = F.min(F.struct(F.xxhash64("hub").alias("order"), F.col("hub"), F.col("n_shingles"))).alias("b")
        best = staged(close.groupBy("row").agg(least).select("b.hub", "row", "b.n_shingles"), "first-hubs")
        first = staged(confirmed(best, texts, width, percent), "confirmed")
        parents = first.select(F.col("v").alias("node"), F.col("u").alias("component"))
        other = close.select("hub", "row", "n_shingles").join(best.select("hub", "row"), ["hub", "row"], "left_anti")
        apart = _labelled(_labelled(other, parents, "row", "a"), parents, "hub", "b").filter("a <> b").select("hub", "row", "n_shingles")
        first = first.unionByName(staged(confirmed(staged(apart, "apart"), texts, width, percent), "confirmed"))
        labels = staged(components(first), "components")
        beside = staged(_labelled(lists.filter("row <> hub"), labels, "row", "label"), "beside-hubs")
        split = beside.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("hub")
        left = beside.join(broadcast_if_small(staged(split, "open-hubs"), MANY), "hub", "left_semi")
        left = staged(left.join(short, "row"), "open-rows")
        counted = left.groupBy("hub", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
        usual = counted.groupBy("hub").agg(F.max(F.struct("n", "w", "label")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"))
        sizes = usual.select("hub", F.col("most.label").alias("usual"), _blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("xs"), _blocks(F.col("n"), F.col("w")).alias("ys"))
        rows = left.join(broadcast_if_small(staged(sizes, "open-sizes"), MANY), "hub")
        kept = [F.col(c).alias(c) for c in ("hub", "row", "label", "short")]
        rest = rows.filter("label <> usual").select(*kept, _block(F.col("xs")).alias("x"), _every_block(F.col("ys")).alias("y"))
        every = rows.select(*kept, _every_block(F.col("xs")).alias("x"), _block(F.col("ys")).alias("y"))
        chosen = broadcast_if_small(staged(promising(rest, every, matches), "promising"), MANY)
        held = texts.join(chosen, "row").select("side", "hub", "x", "y", "row", "text")
        both = [held.filter(F.col("side") == side).select(*[F.col(c).alias(c) for c in ("hub", "x", "y", "row", "text")]) for side in (0, 1)]
        more = staged(compared(*both, width, percent), "compared")
        crossed = _labelled(_labelled(more, labels, "u", "a"), labels, "v", "b").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
        joined = components(staged(crossed, "crossed")).select(F.col("node").alias("component"), F.col("component").alias("least"))
        loose = crossed.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
        labels = labels.unionByName(loose.join(labels, "node", "left_anti"))
        labels = labels.join(broadcast_if_small(staged(joined, "joined"), MANY), "component", "left")
        return own.keep(staged(labels.select("node", F.coalesce("least", "component").alias("component")), "components"))


def near_dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    carry: Sequence[str] | None = None,
    width: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
) -> DataFrame:
    """The carried columns (default: all) of every row, with n_shingles, component_id and kept.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked, and linked documents share a
    component, named by its smallest id (null ids last). Documents without words, null texts included, have no
    shingles and are linked with nothing. Of each component the row with that smallest id is kept, of repeated rows
    with one id a single one. Carried columns with the name of a result column are replaced.

    Rows with equal sets are one node. A pair of similarity percent / 100 is missed only where its signatures agree
    in fewer coordinates than five standard deviations below the mean, about once in a million such pairs.
    """
    share = percent / 100
    matches = max(1, math.floor(coordinates * share - 5 * math.sqrt(coordinates * share * (1 - share))))
    columns = [c for c in (docs.columns if carry is None else carry) if c not in ("n_shingles", "component_id", "kept")]
    held = text_col in columns
    rows = docs.select(
        F.struct(*map(quoted, columns)).alias("_in"),
        F.col(id_col).alias("id"),
        *([] if held else [F.col(text_col).alias("text")]),
        signed(F.col(text_col), width, coordinates).alias("s"),
    )
    rows = staged(rows.select("*", F.monotonically_increasing_id().alias("row")).select("row", "_in", "id", *([] if held else ["text"]), "s.*"), "signatures")
    text = F.col("_in").getField(text_col) if held else F.col("text")
    with scratch(docs.sparkSession) as own:
        n = rows.count()
        sets = staged(rows.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("size")), "sets")
        repeated = staged(sets.filter("size > 1"), "repeated-sets")
        copies = join_groups(rows.select("row", "digest"), repeated, "digest", "size", n).filter("row <> first").select("row")
        copies = broadcast_if_small(staged(copies, "set-copies"), MANY)
        nodes = rows.filter("digest is not null").select("row", "sig", "n_shingles").join(copies, "row", "left_anti")
        named = links(nodes, rows.select("row", text.alias("text")), matches, width, percent, coordinates)
        label = named.select(F.col("node").alias("first"), "component")
        sets = sets.join(label, "first", "left").filter("size > 1 or component is not null")
        sets = staged(sets.select("digest", "size", F.coalesce("component", "first").alias("label")), "labelled-sets")
        labelled = staged(join_groups(rows.select("row", "id", "digest"), sets, "digest", "size", n).drop("size"), "labelled")
        least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row").alias("first")))
        groups = staged(labelled.groupBy("label").agg(least.alias("least"), F.count("*").alias("size")), "groups")
        grouped = join_groups(labelled, groups, "label", "size", n).select("row", F.col("least.id").alias("least"), F.col("least.first").alias("first"))
        grouped = broadcast_if_small(own.keep(staged(grouped, "grouped")), MANY)
    return rows.select("row", "_in", "id", "n_shingles").join(grouped, "row", "left").select(
        "_in.*",
        "n_shingles",
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
        F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("kept"),
    )
