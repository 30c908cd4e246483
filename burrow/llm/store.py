"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a table and reading it back. The table survives the loss of
any executor, costs one evaluation of its plan, and gives the optimizer exact sizes for what follows.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset on one machine (tests), a new local one. On a cluster a
    local folder would be another one on each executor, so there it must be set."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="burrow-")
        spark.conf.set(CHECKPOINT_DIR, found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return re.sub(r"^file:/(?!/)", "file:///", whole)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/burrow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table read back from the shared folder: evaluated once, with no lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renamed(df: DataFrame, *wanted: str) -> tuple[DataFrame, ...]:
    """df with its columns named c0, c1, ..., which leaves all other names to an operator, and the new names of those wanted."""
    names = [c.lower() for c in df.columns]
    return df.toDF(*(f"c{i}" for i in range(len(names)))), *(f"c{names.index(w.lower())}" for w in wanted)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table dealt by a key once: later joins on the key move only the other side. As many buckets as there are
    shuffle partitions."""
    spark = df.sparkSession
    path, count = new_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(count, key).write.format("parquet").bucketBy(count, key).option("path", path).saveAsTable(f"burrow_{table}")
    return spark.table(f"burrow_{table}")


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; results that still read it are lost."""
    for table in spark.catalog.listTables(pattern="burrow_*"):
        spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    folder = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, "x")).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written(), once no other plan reads them."""
    for df in tables:
        _discard(df)


def _discard(df: DataFrame) -> None:
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/burrow-" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
