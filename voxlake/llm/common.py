"""Helpers shared by the training-data operators: tables, shared storage and stable folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows an Arrow batch may hold on its way to Python; with texts of a few kB a batch stays at some MB.
ARROW_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of an input folder, through Spark's reader so that any store works."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes a folder
    of its own and a cluster is refused."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        conf = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop)
    return path


def make_dir(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot from so many rows, and from such a part of all rows, so hot keys are PARTS at most.
HOT_ROWS, PARTS = 1000, 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has a row per key at most; counts(key, n) are left's rows per key, of `total`.

    Rows of hot keys meet a broadcast of at most PARTS rows of right and aren't shuffled; all others meet by a shuffle.
    """
    hot = store(right.join(counts.where(F.col("n") >= max(HOT_ROWS, total // PARTS)).select(key), key, "left_semi"), "hot")
    if hot.isEmpty():
        return left.join(right, key, how)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key, how)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name like `name` that none of the tables has, whatever its case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns of df by name, names with dots or quotes included."""
    return [F.col(quoted(c)) for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by number, as mapInArrow does not take names with dots."""
    return df.toDF(*map(str, range(len(df.columns))))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def extended(df: DataFrame, more: str) -> T.StructType:
    """df's schema with the fields of a DDL string after it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])
