"""Operator 7, embedding near-dedup: an epsilon grid order join of vectors on their leading principal dimensions."""

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.staging import broadcast_if_small, join_groups, quoted, staged
from millrace.llm.components import components, forest

#: Bytes of the vectors of a block, about; children of an interval, leading dimensions, vectors for the directions.
BLOCK_BYTES, FANOUT, LEADING, SAMPLE = 1 << 22, 8, 8, 4096
#: Consecutive blocks that travel together, at most; a task holds twice as many.
NEIGHBOURS = 4
#: Sub-blocks within a task, and what rounding may take from a distance.
TILE, SLACK = 256, 1e-6


def named_vectors(embedding: Column) -> Column:
    """struct<dim, digest> of each vector; null where it is null, empty, zero, or has null or non-finite parts."""

    @F.arrow_udf("struct<dim: int, digest: binary>")
    def named(batch: pa.Array) -> pa.Array:
        bounds, flat = batch.offsets.to_numpy(), batch.values.to_numpy(zero_copy_only=False) + 0.0  # minus zero is zero
        length = np.where(batch.is_null().to_numpy(zero_copy_only=False), 0, np.diff(bounds))
        odd, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(flat), flat != 0))  # a null part is NaN here
        inside = lambda x: x[bounds[1:]] - x[bounds[:-1]]
        good = (length > 0) & (inside(odd) == 0) & (inside(some) > 0)
        names = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() if g else None for a, b, g in zip(bounds[:-1].tolist(), bounds[1:].tolist(), good.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(length, pa.int32()), pa.array(names, pa.binary())], ["dim", "digest"], mask=pa.array(~good))

    return named(embedding)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, whatever their scale."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leading_directions(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Per number of dimensions, orthonormal leading principal directions of a sample of SAMPLE vectors at most.

    The directions only decide how much the join can skip, never what it finds.
    """
    sample = nodes.select("dim", "vector").orderBy(F.xxhash64("row")).limit(SAMPLE).toArrow()
    dims = sample["dim"].to_numpy()
    found = {}
    for dim in np.unique(dims).tolist():
        own = sample["vector"].filter(pa.array(dims == dim))
        x = unit(np.array(own.to_pylist(), np.float64))
        x = x - x.mean(axis=0)
        _, _, directions = np.linalg.svd(x, full_matrices=False)
        found[dim] = np.ascontiguousarray(directions[: min(LEADING, dim)].T)
    return found


def grid_cells(vector: Column, dim: Column, directions: dict[int, np.ndarray], epsilon: float) -> Column:
    """Cells of side epsilon of the vectors' leading coordinates."""

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array, dims: pa.Array) -> pa.Array:
        dims, bounds, flat = dims.to_numpy(), vectors.offsets.to_numpy(), vectors.values.to_numpy()
        out: list[list[int]] = [[]] * len(dims)
        for d in np.unique(dims).tolist():
            if d in directions:
                at = np.flatnonzero(dims == d)
                own = unit(flat[bounds[at][:, None] + np.arange(d)]) @ directions[d] / epsilon
                for i, cell in zip(at.tolist(), np.floor(own).astype(int).tolist(), strict=True):
                    out[i] = cell
        return pa.array(out, pa.list_(pa.int32()))

    return cells(vector, dim)


def blocks(nodes: DataFrame, count: int, most: int, directions: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """The vectors in epsilon grid order, cut into blocks of at most `most`: (part, chunk, dim, low, high, rows, weights, vectors).

    Rows are dealt by ranges of (dim, cells), ties by row, so that a crowded cell spreads over several tasks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            table = pa.Table.from_batches(tables).combine_chunks()
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                own = table.filter(pa.array(dims == dim)).combine_chunks()
                x = own["vector"].combine_chunks().flatten().to_numpy().reshape(own.num_rows, dim)
                p = unit(x) @ directions[dim] if dim in directions else np.zeros((len(x), 1))
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "part": part, "chunk": chunk, "dim": dim, "low": p.min(axis=0).tolist(), "high": p.max(axis=0).tolist(),
                            "rows": own["row"].to_numpy().tobytes(), "weights": own["size"].to_numpy().tobytes(), "vectors": x.astype(np.float64).tobytes(),
                        }
                    ],
                    schema,
                )
                chunk += 1

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                if size + piece.num_rows > most:
                    yield from block(held)
                    held, size = [], 0
                held.append(piece)
                size += piece.num_rows
        if size:
            yield from block(held)

    number = pa.list_(pa.float64())
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("dim", pa.int32()), ("low", number), ("high", number), ("rows", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary())])
    ordered = nodes.withColumn("cells", grid_cells(F.col("vector"), F.col("dim"), directions, epsilon))
    ordered = ordered.repartitionByRange(count, "dim", "cells", "row").sortWithinPartitions("dim", "cells", "row")
    ddl = "part int, chunk int, dim int, low array<double>, high array<double>, rows binary, weights binary, vectors binary"
    return ordered.select("dim", "row", "size", "vector").mapInArrow(cut, ddl)


def near_blocks(cut: DataFrame, total: int, epsilon: float) -> DataFrame:
    """(i, j) with i <= j of all pairs of blocks that may hold vectors within epsilon.

    The sequence of blocks is halved into intervals of intervals, FANOUT at a time. From the top down a pair of
    intervals whose boxes are farther apart than epsilon is dropped with everything in it; the others are opened.
    """
    stats = cut.select("seq", "dim", "low", "high")
    top = max(0, math.ceil(math.log(max(1, total / 64), FANOUT)))

    def level(k: int) -> DataFrame:
        if not k:
            return stats.select(F.col("seq").alias("id"), F.col("dim").alias("d0"), F.col("dim").alias("d1"), "low", "high")
        sides = stats.select((F.col("seq") / (FANOUT**k)).cast("bigint").alias("id"), "dim", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "side"))
        axes = sides.groupBy("id", "axis").agg(F.min("dim").alias("d0"), F.max("dim").alias("d1"), F.min("side.low").alias("low"), F.max("side.high").alias("high"))
        packed = axes.groupBy("id").agg(F.min("d0").alias("d0"), F.max("d1").alias("d1"), F.array_sort(F.collect_list(F.struct("axis", "low", "high"))).alias("s"))
        return packed.select("id", "d0", "d1", F.col("s.low").alias("low"), F.col("s.high").alias("high"))

    def within(pairs: DataFrame, k: int) -> DataFrame:
        one = level(k)
        left = one.select(F.col("id").alias("i"), *[F.col(c).alias(f"{c}_i") for c in ("d0", "d1", "low", "high")])
        right = one.select(F.col("id").alias("j"), *[F.col(c).alias(f"{c}_j") for c in ("d0", "d1", "low", "high")])
        both = pairs.join(broadcast_if_small(left), "i").join(broadcast_if_small(right), "j")
        gap = F.transform(F.arrays_zip("low_i", "high_i", "low_j", "high_j"), lambda s: F.greatest(s.low_i - s.high_j, s.low_j - s.high_i, F.lit(0.0)))
        far = F.aggregate(gap, F.lit(0.0), lambda acc, g: acc + g * g) > (epsilon + SLACK) ** 2
        mixed_dims = (F.col("d0_i") < F.col("d1_i")) | (F.col("d0_j") < F.col("d1_j"))
        apart = (F.col("d1_i") < F.col("d0_j")) | (F.col("d1_j") < F.col("d0_i"))
        return both.filter(~apart & (mixed_dims | ~far)).select("i", "j")

    roots = -(-total // FANOUT**top)
    ids = stats.sparkSession.range(roots)
    pairs = ids.select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(roots - 1))).alias("j"))
    for k in range(top, -1, -1):
        pairs = staged(within(pairs, k), "near-intervals")
        if k:
            kids = lambda c: F.sequence(F.col(c) * FANOUT, F.col(c) * FANOUT + FANOUT - 1)
            pairs = pairs.select(F.explode(kids("i")).alias("i"), "j").select("i", F.explode(kids("j")).alias("j")).filter("i <= j")
    return pairs


def _linked(i: dict, j: dict, least: float) -> pa.RecordBatch:
    """(row, n, root) of two blocks: the weight that a vector links with and a row that it is connected to."""
    same = i["seq"] == j["seq"]
    rows = [np.frombuffer(x["rows"], np.int64) for x in (i, j)]
    weights = [np.frombuffer(x["weights"], np.int64).astype(np.float64) for x in (i, j)]
    one, other = (unit(np.frombuffer(x["vectors"], np.float64).reshape(len(r), -1)) for x, r in zip((i, j), rows, strict=True))
    n, m = np.zeros(len(one)), np.zeros(len(other))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(one), TILE):
        hit = one[at : at + TILE] @ other.T >= least
        if same:
            hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
        n[at : at + TILE] += hit @ weights[1]
        if not same:
            m += weights[0][at : at + TILE] @ hit
        u, v = np.nonzero(hit)
        keep = u + at < v if same else slice(None)
        u, v = u[keep] + at, v[keep] + (0 if same else len(one))
        label = forest(len(one) + (0 if same else len(other)), u, v)  # a tile needs no more links than nodes
        linked = np.unique(np.concatenate([u, v]))
        a.append(linked)
        b.append(label[linked])
    node = rows[0] if same else np.concatenate(rows)
    count = n if same else np.concatenate([n, m])
    label = forest(len(node), np.concatenate(a), np.concatenate(b))
    some = count > 0
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count[some].astype(np.int64)), pa.array(node[label[some]])], ["row", "n", "root"])


def neighbourhood(pairs: int) -> int:
    """Consecutive blocks that travel together: one where pairs are few, so that every core has some, up to NEIGHBOURS."""
    return max(1, min(NEIGHBOURS, math.isqrt(pairs // 256)))


def join_blocks(pairs: DataFrame, cut: DataFrame, least: float, together: int) -> DataFrame:
    """(row, n, root) of the pairs of blocks (i, j), as of `_linked`.

    Pairs are dealt by neighbourhoods of i and of j: a block moves once for each pair of neighbourhoods that needs it,
    not for each pair of blocks, and a task holds 2 * together blocks."""
    at = [F.floor(F.col(c) / together).alias(f"g{c}") for c in "ij"]
    pairs = pairs.select(*at, "i", "j")
    needed = pairs.select(F.col("gi").alias("ni"), F.col("gj").alias("nj"), F.explode(F.array_distinct(F.array("i", "j"))).alias("seq")).distinct()
    moved = needed.join(cut.select("seq", "rows", "weights", "vectors"), "seq")

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {x["seq"]: x for x in right.select(["seq", "rows", "weights", "vectors"]).to_pylist()}
        found = [_linked(own[i], own[j], least) for i, j in zip(left["i"].to_pylist(), left["j"].to_pylist(), strict=True)]
        return pa.Table.from_batches(found)

    return pairs.groupBy("gi", "gj").cogroup(moved.groupBy("ni", "nj")).applyInArrow(joined, "row long, n long, root long")


def near_vectors(
    vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", carry: Sequence[str] | None = None, least: float = 0.9, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The carried columns (default: all) of every row, with n_links, component_id and kept.

    Vectors with a cosine of at least `least`, in double precision, are linked. n_links is the number of other rows
    linked directly, copies included; component_id the smallest id reachable by links (null ids last); of each
    component the row with that id is kept, of repeated rows with one id a single one. Null, empty and zero vectors,
    those with null or non-finite parts, and vectors of different length are linked with nothing. Carried columns
    with the name of a result column are replaced.

    Equal vectors are one node with a weight. Unit vectors with that cosine lie within sqrt(2 - 2 * least) of each
    other, and so do their projections on orthonormal directions; that is what lets blocks be skipped.
    """
    epsilon = math.sqrt(max(0.0, 2 - 2 * least))
    columns = [c for c in (vectors.columns if carry is None else carry) if c not in ("n_links", "component_id", "kept")]
    rows = vectors.select(F.struct(*map(quoted, columns)).alias("_in"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.select("*", named_vectors(F.col("vector")).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows.select("row", "_in", "id", "vector", "v.dim", "v.digest"), "vectors")
    total = rows.count()
    sets = staged(rows.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("size")), "vector-sets")
    nodes = rows.join(sets.select(F.col("first").alias("row"), "size"), "row").select("row", "size", "dim", "vector")
    nodes = staged(nodes, "vector-nodes")
    n, longest = sets.count(), nodes.agg(F.max("dim")).first()[0] or 1
    most = max(16, block_bytes // (8 * longest))
    cut = staged(blocks(nodes, max(1, -(-n // most)), most, leading_directions(nodes) if n else {}, epsilon), "blocks")
    numbered = cut.select("part", "chunk", (F.row_number().over(Window.orderBy("part", "chunk")) - 1).cast("bigint").alias("seq"))
    cut = staged(cut.join(broadcast_if_small(numbered), ["part", "chunk"]), "blocks")
    pairs = near_blocks(cut, cut.count(), epsilon) if n else None
    thin = rows.select("row", "_in", "id", "digest")
    if pairs is None:
        return thin.select("_in.*", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = staged(join_blocks(pairs, cut, least, neighbourhood(pairs.count())), "near-vectors")
    counts = found.groupBy(F.col("row").alias("first")).agg(F.sum("n").alias("n"))
    named = components(found.select(F.col("row").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "first")
    sets = sets.join(counts, "first", "left").join(named, "first", "left").select(
        "digest", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "first").alias("label")
    )
    labelled = join_groups(thin, staged(sets, "vector-labels"), "digest", "size", total, how="left").drop("size")
    labelled = staged(labelled.withColumn("label", F.coalesce("label", "row")), "labelled-vectors")
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row").alias("first")))
    groups = staged(labelled.groupBy("label").agg(smallest.alias("least"), F.count("*").alias("size")).filter("size > 1"), "vector-groups")
    final = join_groups(labelled, groups, "label", "size", total, how="left")
    return final.select(
        "_in.*",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"),
        F.coalesce(F.col("row") == F.col("least.first"), F.lit(True)).alias("kept"),
    )
