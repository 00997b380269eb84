"""Cutting lineage with tables in the shared checkpoint folder.

Executors can be lost at any time, so intermediate results that are read more
than once are written as Parquet below ``spark.checkpoint.dir``, which every
executor sees. Where that setting is empty (tests on one machine) a folder
below the system's temporary one is used, and only with a local master.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.text import BATCH_BYTES, BATCH_ROWS, text_batches  # noqa: F401  (the operators' import)

#: Bytes of Parquet files that are broadcast, at most.
BROADCAST_BYTES = 32 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of this session that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/heronry-scratch"


def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # a session may be gone; the cluster's own retention removes its folders
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written.

    The result has the schema of ``df``, no lineage to it, and a size that the
    optimizer knows from the files. Folders are removed when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_not(table: DataFrame, rows: int = 1_000_000, size: int = BROADCAST_BYTES) -> DataFrame:
    """``table``, with a broadcast hint only if it has ``rows`` rows and ``size`` bytes of files at most.

    For tables that ``cut`` returned, filtered or projected perhaps: their size
    is that of their files, and counting reads little. Larger ones are left to
    a shuffled join.
    """
    stats = table._jdf.queryExecution().optimizedPlan().stats()
    if int(str(stats.sizeInBytes())) > size:
        return table
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
