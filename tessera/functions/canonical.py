"""The canonical form of nested JSON, by which configurations and their parts are known.

JSON nests without bound and column expressions do not, so a small Arrow function
does the walk; all else about ids is built in (see ``functions.text``).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import fingerprint


def _canonical(payload: str | None) -> str | None:
    if payload is None:
        return None
    try:
        return json.dumps(json.loads(payload), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def canonical_object(payload: Column) -> Column:
    """JSON text of any nesting in its one canonical form, as fingerprints take it.

    Keys are sorted at every level by code point, the last of a repeated key stays,
    other characters than ASCII are escaped, whole numbers are kept in full, others
    are the shortest text of a double. Null, and text that is no JSON, is null.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_canonical(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(payload)


def canonical_struct(value: Column) -> Column:
    """``canonical_object`` of a struct, map or array column; null fields are kept as null."""
    return canonical_object(F.to_json(value, {"ignoreNullFields": "false"}))


def config_fingerprint(payload: Column, length: int = 16) -> Column:
    """The first digits of the SHA-256 of a configuration's canonical form."""
    return fingerprint(canonical_object(payload), length)
