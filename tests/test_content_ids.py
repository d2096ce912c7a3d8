"""Canonical JSON and file digests against the standard library."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tessera.functions import canonical
from tessera.plans import dispatch
from tessera.sources import files


def tree(r, depth=0):
    kind = r.randrange(9 if depth < 5 else 6)
    if kind == 0:
        return r.choice([None, True, False, 0, -0.0, 1e16, 1.5e-9, 1e22, 123456789012345678901234567890, -7, 0.1])
    if kind < 3:
        return r.choice(["", "é", "𝄞", "a\"b\\c", "\x00\x1f", "line\nend", "z" * 30, " "])
    if kind < 6:
        return r.uniform(-1e6, 1e6) if kind == 3 else r.randrange(-(10**12), 10**12)
    if kind == 6:
        return [tree(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["b", "a", "é", "A", "10", "9", "", "𝄞x", "￿"]): tree(r, depth + 1) for _ in range(r.randrange(6))}


def stable(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def test_generated_trees(spark):
    r = random.Random(0)
    trees = [tree(r) for _ in range(400)]
    deep = []
    for _ in range(300):
        deep = [deep]
    trees.append({"deep": deep, "configs": [{"z": 1, "a": {"y": [1.0, 1]}}]})
    rows = [(i, json.dumps(t, ensure_ascii=False, indent=r.choice([None, 2]))) for i, t in enumerate(trees)]
    rows += [(-1, None), (-2, "{broken"), (-3, ""), (-4, '{"a":1,"a":2}'), (-5, "[" * 100_000)]
    out = spark.createDataFrame(rows, "i int, j string").select("i", canonical.canonical_object(F.col("j")).alias("c"), canonical.config_fingerprint(F.col("j")).alias("f")).collect()
    got = {x["i"]: (x["c"], x["f"]) for x in out}
    for i, t in enumerate(trees):
        assert got[i] == (stable(t), hashlib.sha256(stable(t).encode()).hexdigest()[:16])
        if isinstance(t, dict):
            assert got[i][1] == dispatch.fingerprint(t)
    assert [got[-i][0] for i in (1, 2, 3, 4, 5)] == [None, None, None, '{"a":2}', None]


def test_struct_columns(spark):
    rows = spark.sql("SELECT named_struct('z', 1.5D, 'a', array(named_struct('k', CAST(NULL AS STRING), 'b', 'é')), 'm', map('y', 2L, 'x', 1L)) AS s")
    assert rows.select(canonical.canonical_struct(F.col("s"))).first()[0] == '{"a":[{"b":"\\u00e9","k":null}],"m":{"x":1,"y":2},"z":1.5}'


def test_file_digests(spark, tmp_path):
    r = random.Random(1)
    made = {}
    for i, size in enumerate([0, 1, 99, 100, 101, 12_345, 3_000_000, 7, 7]):
        at = tmp_path / "in" / f"d{i % 3}" / f"file {i}.bin"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(r.randbytes(size) if i < 7 else b"same!!!")
        made[at.name] = at.read_bytes()
    for algorithm in ("sha256", "md5"):
        got = {x["path"].rsplit("/", 1)[1]: (x["length"], x["digest"]) for x in files.file_digests(spark, str(tmp_path / "in"), "*.bin", algorithm, chunk=100).collect()}
        assert got == {k: (len(v), hashlib.new(algorithm, v).hexdigest()) for k, v in made.items() if v}
    digests = files.file_digests(spark, str(tmp_path / "in"))
    assert [(x["n"], x["first_path"][-5:]) for x in files.same_content(digests).collect()] == [(2, "7.bin")]
    ex = spark.createDataFrame([("e0", "d1/file 7.bin", "old"), ("e1", "none.bin", "old"), ("e2", None, "old")], "example_id string, video_path string, content_hash string")
    found = {x["example_id"]: x["content_hash"] for x in files.with_content_hash(ex, digests, str(tmp_path / "in")).collect()}
    assert found == {"e0": hashlib.sha256(b"same!!!").hexdigest(), "e1": None, "e2": None}
