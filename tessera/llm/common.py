"""What the corpus operators share: table access, stored intermediates, sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder; only Spark opens the path."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def raw_text(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column, null as no bytes."""
    return text_of(column).cast("binary")


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only where
    that is unset, as in tests on one machine, a temporary folder is chosen.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what came
    before, and a result that several later steps use is made once.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application; whatever their path, workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/tessera_package.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/tessera_package.zip")
    _shipped.add(app)


_written: list[str] = []


def written() -> int:
    """How many tables this driver has stored and not deleted."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that this driver has stored after the first ``since``, but for the last ``keep``.

    Results that read them must have been written before.
    """
    gone = _written[since : len(_written) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(name)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _spread(x: np.ndarray) -> np.ndarray:
    """Spark's hash of a column of longs."""
    m = np.uint64(0xFFFFFFFF)
    c = [np.uint64(v) for v in (0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35)]
    turn = lambda v, n: (v << np.uint64(n) | v >> np.uint64(32 - n)) & m
    h = np.full(len(x), np.uint64(42))
    for half in (x.astype(np.uint64) & m, x.astype(np.uint64) >> np.uint64(32)):
        h = turn(h ^ turn(half * c[0] & m, 15) * c[1] & m, 13) * np.uint64(5) + c[2] & m
    h ^= np.uint64(8)
    h = (h ^ h >> np.uint64(16)) * c[3] & m
    h = (h ^ h >> np.uint64(13)) * c[4] & m
    return (h ^ h >> np.uint64(16)).astype(np.uint32).view(np.int32)


def bucket_ids(spark: SparkSession, each: int = 4) -> np.ndarray:
    """Numbers of buckets of which a shuffle by number deals ``each`` to every one of its partitions."""
    parts = shuffle_parts(spark)
    tried = 8 * parts * (each + 4)
    while True:
        ids = np.arange(tried)
        of = _spread(ids).astype(np.int64) % parts
        order = np.argsort(of, kind="stable")
        begin = np.searchsorted(of[order], np.arange(parts))
        if (np.diff(np.r_[begin, tried]) >= each).all():
            return np.sort(np.concatenate([order[begin + i] for i in range(each)]))
        tried *= 2


#: Rows of one key from which on a join takes that key by broadcast.
HOT_KEY = 500_000


def lookup(rows: DataFrame, values: DataFrame, key: str, count: str = "n") -> DataFrame:
    """``rows`` joined with ``values``, which has one row for each key and in ``count`` how many rows have it.

    ``count`` is dropped. Keys of ``HOT_KEY`` rows or more are broadcast, so that the
    rows of one never meet in a task; there are no more of them than all rows
    divided by ``HOT_KEY``. The other keys are shuffled. A null key matches none.
    """
    hot = values.where(F.col(count) >= HOT_KEY).drop(count)
    if hot.isEmpty():
        return rows.join(values.drop(count), key)
    hot = F.broadcast(hot)
    cold = rows.join(hot.select(key), key, "left_anti").join(values.where(F.col(count) < HOT_KEY).drop(count), key)
    return rows.join(hot, key).unionByName(cold)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on columns that carry the same names on both sides."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out
