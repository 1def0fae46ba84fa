"""Tables that later steps read more than once, and joins that a hot key does not slow."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


class Scratch:
    """The tables staged within one block, so that they can be removed as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession, outer: "Scratch | None"):
        self.spark, self.outer, self.tables = spark, outer, []

    def drop(self, *frames: DataFrame) -> None:
        """Remove the tables of these frames now."""
        gone = [t for t in self.tables if any(t[0] is f for f in frames)]
        self.tables = [t for t in self.tables if t not in gone]
        delete_staged(self.spark, [path for _, path in gone])

    def keep(self, frame: DataFrame) -> DataFrame:
        """The frame, whose table outlives the block; the enclosing block has it from now on."""
        kept = [t for t in self.tables if t[0] is frame]
        self.tables = [t for t in self.tables if t[0] is not frame]
        if self.outer is not None:
            self.outer.tables += kept
        return frame

    def release(self) -> list[str]:
        """Paths of all tables of the block, which it no longer removes; the caller does."""
        paths, self.tables = [path for _, path in self.tables], []
        return paths


_SCRATCH: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A block at whose end the tables staged in it go, but for those that it keeps."""
    own = Scratch(spark, _SCRATCH.get())
    token = _SCRATCH.set(own)
    try:
        yield own
    finally:
        _SCRATCH.reset(token)
        delete_staged(spark, own.release())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets one of its own;
    on a cluster that is an error, since a folder of one machine would lose tables with it."""
    if not spark.conf.get(CHECKPOINT_DIR, None):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
        spark.conf.set(CHECKPOINT_DIR, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get(CHECKPOINT_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    frame = spark.read.schema(df.schema).parquet(path)
    if (own := _SCRATCH.get()) is not None:
        own.tables.append((frame, path))
    return frame


def delete_staged(spark: SparkSession, paths: list[str]) -> None:
    """Remove staged tables that no frame reads any more."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Hint a broadcast of a table of narrow rows only when it has at most that many; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner", hot: int = 1000) -> DataFrame:
    """Join (inner or left) of rows with one row per group on key, where a group may hold a third of all rows.

    Groups of more than total/hot rows, of which there are fewer than hot, are broadcast; their rows never
    shuffle. The others shuffle, and no key has more than total/hot rows there.
    """
    limit = max(1, total // hot)
    tagged = rows.join(F.broadcast(groups.filter(F.col(size) > limit)), key, "left")
    extra = [c for c in groups.columns if c != key]
    rest = tagged.filter(F.col(size).isNull()).drop(*extra)
    return tagged.filter(F.col(size).isNotNull()).unionByName(rest.join(groups.filter(F.col(size) <= limit), key, how))


def quoted(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
