"""Session helpers shared by the library: shipping code, cutting lineage, bounded broadcasts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast once its rows are counted, at a stated width of a row.
BROADCAST_BYTES = 64 << 20

#: A key is hot if it holds more than this share of all rows (and more than HOT_LEAST), so at most this many keys are.
HOT_KEYS, HOT_LEAST = 4096, 64

#: Bytes after which an Arrow batch ends; rows are whole texts of any length.
ARROW_BYTES = 3 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as `--py-files` would; once per context.

    Rows are whole texts, so Arrow batches are bounded in bytes; a bound that the session has itself stays.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for top, dirs, names in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("quern", os.path.relpath(full, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="quern-ship-"), "quern_ship.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    sc._quern_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    A local session without that setting (tests) gets a temporary one; on a cluster it is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quern-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder as Parquet and go on from there: its lineage ends, and only the
    columns that are used later are read again. The files stay until the folder is cleared."""
    path = f"{shared_folder(df.sparkSession)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """`df` with a broadcast hint if the counted `rows` of at most `width` bytes allow it, else as it is."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def hot_keys(counts: DataFrame, key: str, total: int | None = None, least: int = HOT_LEAST) -> DataFrame | None:
    """The hot keys of `counts` (a row per key with its `rows`), at most HOT_KEYS of them; None if there are none.

    They are collected: a bounded number of narrow values (keys of bounded width only).
    """
    if total is None:
        total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("rows") > max(least, total // HOT_KEYS)).select(key)
    found = hot.collect()
    return counts.sparkSession.createDataFrame(found, hot.schema) if found else None


def attach(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined to side (one row per key). The side of hot keys (from hot_keys) is broadcast, so no hot key is shuffled."""
    if hot is None:
        return rows.join(side, key, how)
    few = F.broadcast(hot)
    found = rows.join(F.broadcast(side.join(few, key, "left_semi")), key)
    rest = rows.join(few, key, "left_anti").join(side.join(few, key, "left_anti"), key, how)
    return found.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
