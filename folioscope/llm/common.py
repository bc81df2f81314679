"""What the corpus operators share: tables in the shared folder, checked broadcasts, words, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 spelling of a word: a run of anything but space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows up to which a side may be broadcast; it is counted first. Callers' rows are under 1 kB, so 50 MB at most.
BROADCAST_ROWS = 50_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without (tests): it gets a temporary one."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="folioscope-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/folioscope/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and reread: later reads don't compute it again and survive lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, which are counted; else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def own_prefix(df: DataFrame) -> str:
    """A prefix that no column of df begins with, for columns that are added for a while."""
    prefix = "__fs_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_blocks(text: bytes, overlap: int, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in blocks of about `block` bytes that begin with the last `overlap` words of the one before.

    bytes.split() cuts at exactly the six ASCII white-space characters that WORD leaves out.
    """
    if len(text) <= block:
        yield text.split()
        return
    at, last = 0, []
    while at < len(text):
        end = min(len(text), at + block)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = last + text[at:end].split()
        yield words
        last, at = words[-overlap:] if overlap else [], end


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long); root is the component's smallest node.

    Alternating large-star and small-star steps on DataFrames until the edges stay the same. Each step's edges are a
    written table in the shared folder, so the plan stays short and lost executors cost one step. Minima are combined
    before the shuffle; the join that follows is one that adaptive execution splits when a node is hot.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b")
        if large:
            both = both.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else (
            joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        )
        return out.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def told(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    was = None
    while (is_now := told(now)) != was and is_now[0]:
        was = is_now
        path = now.inputFiles()
        now = staged(star(star(now, True), False), "edges")
        if path:
            drop_path(spark, path[0].rsplit("/", 1)[0])
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
