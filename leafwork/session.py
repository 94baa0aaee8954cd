"""Tables of a data folder, the shared folder for cut lineage and the size of what is broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that is broadcast, at most.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the folder of spark.checkpoint.dir, which all executors share, and reads it from there. Only a session on
    one machine that names no folder gets one of its own, removed at its end; a cluster without one is an error."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="leafwork-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes. Counted where the rows are; none travel."""
    texts = [F.octet_length(c) for c, t in df.dtypes if t == "string"] + [F.octet_length(F.to_json(F.struct(c))) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    of = sum((F.coalesce(F.sum(t), F.lit(0)) for t in texts), F.lit(0))
    n, held = df.agg(F.count("*"), of.cast("bigint")).first()
    return n <= rows and held + 16 * n * len(df.columns) <= size
