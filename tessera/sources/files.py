"""Digests of whole files, read in chunks inside a task."""

from __future__ import annotations

import hashlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.jsonl import media_files

#: Bytes that a task holds of a file at a time.
CHUNK = 4 << 20


def _stream(path: str):
    """The file at a path as Spark writes it, not escaped, of any store that Arrow's file systems reach."""
    scheme, _, rest = path.partition(":")
    rest = quote(rest)
    store, at = fs.FileSystem.from_uri(f"{scheme}:{rest}" if rest.startswith("//") else f"{scheme}://{rest}")
    return store.open_input_stream(at)


def file_digests(spark: SparkSession, path: str, pattern: str = "*", algorithm: str = "sha256", chunk: int = CHUNK) -> DataFrame:
    """path, length and digest (lowercase hex) of every file under a folder whose name fits.

    Spark lists the files and deals them out by size; a task streams each of its
    own, so a file may be larger than a row can be. Empty files have no row, as in
    Spark's scans; a file that cannot be read fails the task.
    """

    def run(batches):
        for b in batches:
            digests = []
            for uri in b.column(0).to_pylist():
                h = hashlib.new(algorithm)
                with _stream(uri) as f:
                    while part := f.read(chunk):
                        h.update(part)
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], ["path", "length", "digest"])

    return media_files(spark, path, pattern).mapInArrow(run, "path string, length long, digest string")


def same_content(digests: DataFrame) -> DataFrame:
    """digest, n and first_path (the smallest) of contents that several files have."""
    return digests.groupBy("digest").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def with_content_hash(examples: DataFrame, digests: DataFrame, root: str, path: str = "video_path") -> DataFrame:
    """``examples`` with ``content_hash`` from the file that ``path`` names under ``root``; null where there is none."""
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/+", "/")
    under = F.substring(F.regexp_replace("path", "^file:/+", "/"), F.length(base) + 2, F.length("path"))
    known = digests.select(under.alias("_under"), F.col("digest").alias("content_hash"))
    return examples.drop("content_hash").join(known, F.col(path) == F.col("_under"), "left").drop("_under")
