"""Removal of word passages that occur more than once, by relative Lempel-Ziv parsing.

Documents are factored greedily against reference blocks that hold the whole
corpus (see ``lempel_ziv``). A factor of ``WIDTH`` words or more becomes a
duplicate span, and windows over the boundaries of factors are looked up too, so
every word under a repeated window goes, to the word.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import raw_text
from tessera.llm.lempel_ziv import factors
from tessera.llm.repeats import attach, covered, keyed, word_blocks

#: Words of a window, and of an anchor.
WIDTH = 35
GRAM = 8


def repeated_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, spans) of documents with repeated windows, in words."""
    return factors(docs, word_blocks, width, gram)


def _cut(text: bytes, spans, width: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by one space."""
    words = text.split()
    kept, at = [], 0
    for lo, hi in covered(spans, width):
        kept += words[at:lo]
        at = hi
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def remove_repeated_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words joined by one space) of every row.

    Without ``texts``, kept is null.
    A word goes if a window over it also starts elsewhere in the corpus, the same
    document included. Null and empty texts have no words. Repeated rows are
    copies of each other. Null doc_ids are kept; no rows give no rows; other
    columns are ignored.
    """
    whole = attach(keyed(docs), repeated_words(docs, width, gram), "left").select("doc_id", "t", "spans")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                n, gone, kept = zip(*[_cut(t, s, width) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())])
                sha = [hashlib.sha256(k).hexdigest() for k in kept]
                text = pa.array([k.decode() for k in kept], pa.string()) if texts else pa.nulls(len(kept), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), text], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return whole.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``.

    A text that loses words becomes its kept words joined by one space, and
    n_chars follows it; other rows stay as they are. No row is dropped.
    """
    full = docs.withColumns({"_sd_id": F.col("doc_id").cast("long"), "_sd_h": F.xxhash64(raw_text())})
    spans = repeated_words(docs, width, gram).select(F.col("doc_id").alias("_sd_doc"), F.col("h").alias("_sd_text"), F.col("spans").alias("_sd_spans"))
    on = F.col("_sd_id").eqNullSafe(F.col("_sd_doc")) & (F.col("_sd_h") == F.col("_sd_text"))
    joined = full.join(spans.hint("shuffle_hash"), on, "left")
    return _apply(joined.select(*docs.columns, "_sd_spans"), docs, width)


def _apply(joined: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    names = docs.columns
    at, spans_at = names.index("text"), len(names)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 250):
                b = whole.slice(lo, 250)
                texts = b.column(at).to_pylist()
                for i, s in enumerate(b.column(spans_at).to_pylist()):
                    if s:
                        texts[i] = _cut(texts[i].encode(), s, width)[2].decode()
                columns = b.columns[:spans_at]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out
