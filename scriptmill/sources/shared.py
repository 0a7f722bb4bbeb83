"""Tables in the folder that the driver and all executors share, and broadcasts behind a check of size."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While this holds, the shuffle files of a query go when it ends, and not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A side of a join with more rows than this is shuffled: rows of a few numbers, and rows of words with what is known of them (some 150 bytes each in the driver, and twice that while a broadcast is made).
MAX_BROADCAST, MAX_WORDS = 2_000_000, 200_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; only in local mode, where that may be unset, below a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scriptmill-")
        spark.sparkContext.setCheckpointDir(base)
    # with its scheme, so that code outside Spark opens the same store
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/scriptmill/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        if "stored_path" in vars(table):
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_path)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, limit: int = MAX_BROADCAST) -> DataFrame:
    """``df``, to be broadcast if it has at most ``limit`` rows, and else never: Spark would go by the size of its files, of which 10 MB hold a million words. Counting runs ``df``, which should be a stored table or a file."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew if it comes in fewer partitions than there are cores. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def trim_driver(spark: SparkSession) -> bool:
    """The driver's JVM gives memory that its native code has freed back to the system, and not only when it ends. False where a JVM can't."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    texts, objects = array(jvm.java.lang.String, 0), array(jvm.java.lang.Object, 0)
    forms = array(jvm.java.lang.Class, 4)
    # by reflection, since the server's own class is not public
    server = jvm.java.lang.Class.forName("javax.management.MBeanServer")
    for k, x in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        forms[k] = jvm.java.lang.Class.forName(x)
    call = array(jvm.java.lang.Object, 4)
    call[0], call[1], call[2], call[3] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", objects, texts
    try:
        server.getMethod("invoke", forms).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:
        return False
    return True
