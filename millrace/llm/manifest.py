"""Operator 12, a Merkle manifest of a dataset: nodes appended in postorder by aligned builders, proofs by address."""

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.staging import broadcast_if_small, quoted, scratch, staged

#: Children of a node, and levels that one builder makes: it has at most ARITY ** LEVELS nodes to begin with.
ARITY, LEVELS = 8, 4
#: Rows of a range of the order that leaves are numbered by, about.
RANGE = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = ("leaf", "subroot", "root", "proof", "tampered_leaf", "folded_root", "verified")
PROOF = "array<struct<before: string, after: string>>"


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: `-` for null, else UTF-8 byte count, colon and value."""
    written = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[written(f.cast("string")) for f in fields]), 256)


def proof_hash(proof: Column) -> Column:
    """Lowercase hex SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def depth(n: int) -> int:
    """Levels over n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def address(level: int, index: np.ndarray, n: int, levels: int) -> np.ndarray:
    """Place, in completion order, of the index-th node of a level over n leaves, of a tree of so many levels.

    When a node that ends with leaf e - 1 is complete, so are e / ARITY ** k nodes, rounded up, of its own level and of
    those under it, and of those over it as many as ended before."""
    e = np.minimum((np.asarray(index, np.int64) + 1) * ARITY**level, n)
    place = np.full(e.shape, -1, np.int64)
    for k in range(levels + 1):
        place += -(-e // ARITY**k) if k <= level else (e - 1) // ARITY**k
    return place


def log_of(leaves: list[bytes], top: int) -> bytes:
    """Raw digests of the leaves and all nodes over them up to level `top`, in the order in which they are complete."""
    out, waiting = [], [[] for _ in range(top + 1)]

    def close(level: int) -> None:
        if level < top:
            node = hashlib.sha256("".join(d.hex() for d in waiting[level]).encode()).digest()
            waiting[level].clear()
            add(level + 1, node)

    def add(level: int, node: bytes) -> None:
        out.append(node)
        waiting[level].append(node)
        if len(waiting[level]) == ARITY:
            close(level)

    for leaf in leaves:
        add(0, leaf)
    for level in range(top):
        if waiting[level]:
            close(level)
    return b"".join(out)


def levels_of(block: int, n: int, levels: int) -> int:
    """Levels that the builder of a block makes: all of its part where the tree has other blocks, else up to the root."""
    return levels if block else depth(n)


def siblings(log: bytes, n: int, levels: int, index: np.ndarray) -> list[list[dict]]:
    """Of each leaf, the siblings before and after it on every level, read from the log at their addresses."""
    hexed, out = log.hex(), [[] for _ in index]
    for level in range(levels):
        own = index // ARITY**level
        count = -(-n // ARITY**level)
        first = own - own % ARITY
        at = [address(level, np.minimum(first + k, count - 1), n, levels).tolist() for k in range(ARITY)]
        for i, (own_i, first_i) in enumerate(zip(own.tolist(), first.tolist(), strict=True)):
            run = [hexed[64 * at[k][i] : 64 * at[k][i] + 64] for k in range(min(ARITY, count - first_i))]
            k = own_i - first_i
            out[i].append({"before": "".join(run[:k]), "after": "".join(run[k + 1 :])})
    return out


def numbered(rows: DataFrame, by: str, order: Sequence[str], size: int = RANGE) -> DataFrame:
    """rows with `index`, their number (from 0) within `by` in the order of other columns; rows that tie go as they come.

    Rows are ranged by both, so that a value of `by` that a third of all rows have is dealt to many tasks."""
    n = rows.count()
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(max(1, -(-n // size)), by, *order, "_tie").sortWithinPartitions(by, *order, "_tie")
    # the row's number within its task is in the low bits, the task's in the high ones
    ranged = staged(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranged").withColumn("_task", F.shiftright("_at", 33))
    runs = staged(ranged.groupBy(by, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")), "runs")
    earlier = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # at most a row per range
    from_ = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    runs = staged(runs.select(F.col(by).alias("_by"), F.col("_task").alias("_run"), (from_ - F.col("_first")).alias("_shift")), "shifts")
    found = ranged.join(broadcast_if_small(runs), (F.col("_task") == F.col("_run")) & F.col(by).eqNullSafe(F.col("_by")))
    return found.withColumn("index", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_by", "_run", "_shift")


def _build(nodes: DataFrame, levels: int) -> DataFrame:
    """One row per aligned block of (tree, index, node): tree, block, n and the log of the nodes over them."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        top = levels_of(table["block"][0].as_py(), table.num_rows, levels)
        log = log_of([bytes.fromhex(h) for h in table["node"].to_pylist()], top)
        return pa.table({"tree": table["tree"][:1], "block": table["block"][:1], "n": pa.array([table.num_rows]), "log": pa.array([log], pa.binary())})

    block = F.floor(F.col("index") / ARITY**levels).alias("block")
    return nodes.select("tree", "index", "node", block).groupBy("tree", "block").applyInArrow(build, "tree string, block long, n long, log binary")


def _prove(nodes: DataFrame, logs: DataFrame, levels: int) -> DataFrame:
    """The nodes' columns and proof: siblings within the block, then the proof of the block's own root (`rest`)."""

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        block, n, log, rest = (right[c][0].as_py() for c in ("block", "n", "log", "rest"))
        found = siblings(log, n, levels_of(block, n, levels), left["index"].to_numpy() % ARITY**levels)
        return left.drop_columns(["block"]).append_column("proof", pa.array([own + (rest or []) for own in found], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))))

    nodes = nodes.withColumn("block", F.floor(F.col("index") / ARITY**levels))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name != "block")
    return nodes.groupBy("tree", "block").cogroup(logs.groupBy("tree", "block")).applyInArrow(prove, f"{fields}, proof {PROOF}")


def forest(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node) of the roots of trees over nodes (tree, index, node), and the logs of the tiers that built them.

    A tier's block roots, each the last of its log, are the nodes of the tier above, until every tree is one block."""
    tiers, now = [], nodes
    while True:
        tiers.append(staged(_build(now, levels), "merkle-log"))
        now = tiers[-1].select("tree", F.col("block").alias("index"), F.lower(F.hex(F.substring("log", -32, 32))).alias("node"))
        if not tiers[-1].filter("block > 0").limit(1).count():
            return now.select("tree", "node"), tiers


def proven(nodes: DataFrame, tiers: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes with proof, from the tiers of their trees and the proofs (tree, block 0, rest) of the trees' roots.

    From the top down: the blocks of a tier are the nodes of the one above, whose proofs they continue."""
    for below, tier in zip(reversed(tiers[:-1]), reversed(tiers[1:]), strict=True):
        blocks = _prove(below.select("tree", F.col("block").alias("index")), _continued(tier, above), levels)
        above = staged(blocks.select("tree", F.col("index").alias("block"), F.col("proof").alias("rest")), "merkle-proofs")
    return _prove(nodes, _continued(tiers[0], above), levels)


def _continued(tier: DataFrame, above: DataFrame) -> DataFrame:
    """The logs of a tier with `rest`, the proofs of their roots."""
    tier = tier.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), "n", "log")
    same = F.col("_tree").eqNullSafe(F.col("tree")) & (F.col("_block") == F.col("block"))
    return tier.join(above, same).select(F.col("_tree").alias("tree"), F.col("_block").alias("block"), "n", "log", "rest")


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    tree_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    tampered: Column | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """The carried columns (default: all) of every row with leaf, subroot, root, proof, tampered_leaf, folded_root, verified.

    A leaf is the hash of the fields. Per value of tree_col (a string), leaves ascend by id, null ids first, ties by
    leaf; every 8 consecutive nodes become one until one remains, the subroot, and likewise the subroots, ordered by
    value with null first, become the root. proof has the siblings of each level, those before and those after the
    row's own node. tampered (a condition, null is false; default: no row) says whose text is read anew with A-Z in
    lower case; folded_root is what that leaf and the original proof give, verified whether it is the root. Repeated
    rows are a leaf each. Carried columns with the name of a result column are replaced. An empty table gives an empty
    result. Carried columns travel with the leaves: carry few.
    """
    columns = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    original = leaf_hash(*map(quoted, fields))
    lowered = F.translate(quoted(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = leaf_hash(*[lowered if f == text_col else quoted(f) for f in fields])
    now = original if tampered is None else F.when(tampered, changed).otherwise(original)
    leaves = docs.select(F.struct(*map(quoted, columns)).alias("_in"), quoted(tree_col).cast("string").alias("tree"), quoted(id_col).alias("_id"), original.alias("node"), now.alias("now"))
    with scratch(docs.sparkSession) as own:
        leaves = numbered(staged(leaves, "leaves"), "tree", ["_id", "node"]).select("_in", "tree", "index", "node", "now")
        leaves = own.keep(staged(leaves, "numbered"))
        subroots, tiers = forest(leaves.select("tree", "index", "node"), levels)
        tops = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node"), "tree", ["of"])
        tops = staged(tops.select("tree", "index", "of", "node"), "subroots")
        roots, upper = forest(tops.select("tree", "index", "node"), levels)
        root = roots.select("node").first()
        ends = roots.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(PROOF).alias("rest"))
        tops = own.keep(staged(proven(tops, upper, ends, levels), "subroot-proofs"))
        found = own.keep(staged(proven(leaves, tiers, tops.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("proof").alias("rest")), levels), "proofs"))
        own.drop(leaves)
    subroots = broadcast_if_small(tops.select(F.col("of").alias("_of"), F.col("node").alias("subroot")), 1000)
    found = found.join(subroots, F.col("tree").eqNullSafe(F.col("_of"))).withColumn("root", F.lit(root and root["node"]))
    back = folded(F.col("now"), F.col("proof"))
    out = found.select("_in.*", F.col("node").alias("leaf"), "subroot", "root", "proof", F.col("now").alias("tampered_leaf"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
