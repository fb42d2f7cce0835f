"""Session helpers: tables, shared scratch space and Arrow batch size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch. Texts can be long, so Spark's default of 10,000 rows could need gigabytes.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Lower the rows and bytes of an Arrow batch to at most `rows` and `size`, whichever comes first; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = _bytes(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def _bytes(setting: str) -> int:
    """A setting such as 4194304, 64MB or -1 as a number."""
    number = setting.strip().lower().rstrip("b")
    return int(number[:-1]) << {"k": 10, "m": 20, "g": 30}[number[-1]] if number[-1:] in ("k", "m", "g") else int(number)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset in local mode one of our own; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that driver and executors share")
        found = f"file:///tmp/corelens-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: For intermediate tables whose size is known beforehand: rows up to which one task writes them, and rows of a file of larger ones.
ONE_FILE_ROWS, ROWS_PER_FILE = 50_000, 200_000


def written(df: DataFrame, label: str = "t", most_rows: int | None = None) -> DataFrame:
    """Write df as a table of the shared folder and read it back: cuts lineage and survives lost executors.

    most_rows: a proven upper bound of its rows; small tables are then written by few tasks instead of one a shuffle partition.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(1) if most_rows <= ONE_FILE_ROWS else few_files(df, most_rows, ROWS_PER_FILE)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def few_files(df: DataFrame, rows: int, rows_per_file: int) -> DataFrame:
    """df in partitions of about rows_per_file rows, without a shuffle, but never fewer than two a core: results of small inputs don't end
    in hundreds of tiny files, and large ones keep their partitions."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_file)))


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by written() once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "written_path", None)
        if path:
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
