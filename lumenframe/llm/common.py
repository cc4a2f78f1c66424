"""What the operators share: the word rule, table reading, cutting lineage, checked broadcasts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009 to U+000D. Valid in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows that a side may have to be broadcast; beyond it Spark shuffles the join.
BROADCAST_ROWS = 500_000
#: Most bytes of Parquet files of such a side.
BROADCAST_BYTES = 16 << 20
#: Slots of the bitmap of keys.
SLOTS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local master may do without the setting."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lumenframe-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lost executors recompute nothing before it, and its shuffles leave the disks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Spark drops a shuffle's files once the driver's JVM has collected its plan, which may take half an hour on a large heap; events that listeners have yet to read hold the plan
    with contextlib.suppress(Py4JError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5_000)
    spark.sparkContext._jvm.java.lang.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut returned. Only for tables that no plan still to run reads."""
    for x in tables:
        jvm = x.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(x._cut_path)
        path.getFileSystem(x.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def holds(df: DataFrame) -> bool:
    """Whether df has a row."""
    return df.limit(1).count() > 0


def small_side(df: DataFrame, bound: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a cut table, with a broadcast hint if it has at most `bound` rows, which are counted, and at most `most` bytes of Parquet; else df, to be shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most and df.count() <= bound else df


def may_hold(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose column may be among keys (cut, longs spread like hashes); few others. A bitmap of SLOTS slots, 64 a row, is broadcast: at most SLOTS / 64 rows,
    1,048,576, whatever the input. Where it fills up it only saves less."""
    slot = lambda c: f"pmod({c}, {SLOTS}L)"
    bits = keys.groupBy(F.expr(f"{slot(key)} div 64").alias("__word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST({slot(key)} % 64 AS INT)))").alias("__bits"))
    out = df.withColumn("__word", F.expr(f"{slot(column)} div 64")).join(F.broadcast(bits), "__word").filter(f"shiftright(__bits, CAST({slot(column)} % 64 AS INT)) & 1L = 1L")
    return out.select(*df.columns)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add; names are compared as Spark does, without case."""
    taken = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
