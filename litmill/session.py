"""Session factory, table access and checkpoint placement."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "litmill", cores: str = "*", **conf) -> SparkSession:
    """A local session for tests and bench; a cluster passes its own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale directory (a file or a directory of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between stages, from spark.checkpoint.dir of the session.

    Only where the session names none (tests on one machine) a temporary one is made; on a cluster
    the setting has to name a folder that all executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _temporary
    _temporary = _temporary or tempfile.mkdtemp(prefix="litmill-")
    return _temporary


_temporary: str | None = None


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts the lineage and survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint(eager)


def scratch(spark: SparkSession) -> str:
    """The application's own folder within the shared one; it is deleted when the application ends."""
    base = f"{shared_dir(spark)}/litmill-{spark.sparkContext.applicationId}"
    if base not in _cleaned:
        _cleaned.add(base)
        atexit.register(_delete, spark, base)
    return base


def materialize(df: DataFrame, *stale: DataFrame) -> DataFrame:
    """As checkpoint, as a compressed table that later reads take only the needed columns of.

    For wide results and for loops: what is read back carries neither plan nor constraints of the
    rounds before. The tables behind `stale`, results of earlier calls, are deleted once df is
    written; the rest are when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for old in stale:
        if at := getattr(old, "_litmill_path", None):
            _delete(spark, at)
    out = spark.read.schema(df.schema).parquet(path)
    out._litmill_path = path
    return out


#: Bytes of a written table that may be joined by broadcast; in memory it takes some ten times as much.
BROADCAST_FILE_BYTES = 1_000_000


def sized(df: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """df for a join: left to the optimizer if the table it comes from is small as written, else joined by merging.

    The optimizer goes by the compressed size of files, which bounds nothing in memory. `written` is
    the result of `materialize` that df was selected from, by default df itself.
    """
    path = getattr(written if written is not None else df, "_litmill_path", None)
    return df if path and _bytes_of(df.sparkSession, path) <= BROADCAST_FILE_BYTES else df.hint("merge")


def _bytes_of(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


_cleaned: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the application is going down already
        pass


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that is heavy per row.

    A table in many files comes so already and is left alone; a small one in a single file would keep
    one core busy and the others idle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def tokenizer_dir() -> str:
    """Folder of the public vocabulary files; LITMILL_TOKENIZERS overrides the default."""
    return os.environ.get("LITMILL_TOKENIZERS", "/opt/tokenizers")


def distinct_names(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns, each taken once: extra columns cannot clash with an operator's own names."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in needed])
