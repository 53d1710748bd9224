"""Session helpers: shared checkpoint folder, table access, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint(spark: SparkSession) -> None:
    """Make sure ``checkpoint()`` has a folder: the cluster's own setting, or a local one in local mode where none is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "strata-checkpoint"))


def bounded(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` as a broadcast local table if it has at most ``rows`` rows, which is found out by running it; otherwise as
    it is, for a join by shuffle."""
    held = df.limit(rows + 1).collect()
    return df if len(held) > rows else F.broadcast(df.sparkSession.createDataFrame(held, df.schema, verifySchema=False))


def frames(df: DataFrame, kernel: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``mapInPandas`` that leaves out empty frames and hands on text as plain objects, which Arrow always takes."""

    def run(batches):
        import pandas as pd

        for f in kernel(batches):
            if len(f):
                yield f.astype({c: object for c in f.columns if isinstance(f[c].dtype, pd.StringDtype)})

    return df.mapInPandas(run, schema)


def plain(column) -> list:
    """An Arrow array as a list of plain values, by columns: structs as dicts. Many times faster than ``to_pylist`` on structs."""
    import pyarrow as pa

    kind, n = column.type, len(column)
    if column.null_count == n:
        return [None] * n
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        rows = [dict(zip(names, v)) for v in zip(*[plain(c) for c in column.flatten()])]
        return [x if ok else None for x, ok in zip(rows, column.is_valid().to_pylist())] if column.null_count else rows
    if pa.types.is_list(kind):
        ends, values = column.offsets.to_pylist(), plain(column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()))
        parts = [values[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]
        return [x if ok else None for x, ok in zip(parts, column.is_valid().to_pylist())] if column.null_count else parts
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(kind) or pa.types.is_floating(kind):
        values = (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False).tolist()
        return [x if ok else None for x, ok in zip(values, column.is_valid().to_numpy(zero_copy_only=False).tolist())] if column.null_count else values
    return column.to_pylist()


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session has for shuffles, which adaptive execution leaves alone: for kernels whose
    work is large beside their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application; needed where they don't share the driver's Python path."""
    sc = spark.sparkContext
    if getattr(sc, "_strata_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="strata-ship-"))
    with zipfile.ZipFile(folder / "strata.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(folder / "strata.zip"))
    sc._strata_shipped = True


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared checkpoint folder and read it from there; it is deleted when
    the application ends. Survives the loss of executors, cuts lineage, and is smaller than a checkpoint."""
    spark = df.sparkSession
    shared_checkpoint(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/strata-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
