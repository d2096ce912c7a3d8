"""The exact seeded split and the embedding-bag reward model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding_reward as er
from tessera.operators import preferences

PAIR = "judgment_id string, split string"


def parts(spark, rows, **k):
    frame = spark.createDataFrame(rows, PAIR).repartition(3)
    out = preferences.seeded_split(frame, "judgment_id", k.get("seed", 0), k.get("fraction", 0.25))
    return {r["part"]: sorted(x["judgment_id"] for x in out.where(F.col("part") == r["part"]).collect()) for r in out.select("part").distinct().collect()}


def carved(ids, n, seed=0):
    import hashlib

    order = sorted(ids, key=lambda i: (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16), i))
    return sorted(order[:n]), sorted(order[n:])


@pytest.mark.parametrize("n, fraction, take", [(8, 0.25, 2), (10, 0.25, 2), (2, 0.1, 1), (2, 0.9, 1), (1, 0.5, 0), (3, 1.0, 2), (200, 0.333, 67), (5, 0.0, 0)])
def test_unlabelled_rows_are_carved_exactly(spark, monkeypatch, n, fraction, take):
    monkeypatch.setattr(preferences, "SORTED", 3)  # several passes of ranges
    monkeypatch.setattr(preferences, "RANGES", 4)
    ids = [f"j{i}" for i in range(n)]
    got = parts(spark, [(i, None if k % 2 else "") for k, i in enumerate(ids)], fraction=fraction, seed=3)
    val, train = carved(ids, take, 3)
    assert got.get("val", []) == val and got.get("train", []) == train


def test_labelled_rows(spark):
    both = [(f"t{i}", "train") for i in range(6)] + [(f"v{i}", "val") for i in range(2)]
    assert parts(spark, both) == {"train": [f"t{i}" for i in range(6)], "val": ["v0", "v1"]}
    val, train = carved([f"t{i}" for i in range(6)], 2)
    assert parts(spark, both[:6]) == {"train": train, "val": val}  # validation is carved from train
    assert parts(spark, both[:6], fraction=1.0)["val"] == [f"t{i}" for i in range(6)]
    assert parts(spark, both[:1]) == {"train": ["t0"]} and parts(spark, []) == {}
    for rows, message in (([*both, ("u", None)], "beside"), (both[6:], "no train")):
        with pytest.raises(ValueError, match=message):
            parts(spark, rows)
    with pytest.raises(Exception, match="held-out"):
        parts(spark, [*both, ("h", "held_out")])


def test_repeated_keys_stay_together(spark):
    got = parts(spark, [("a", None)] * 4 + [("b", None)] * 4, fraction=0.25)
    assert sorted(map(len, got.values())) == [4, 4]


def pairs(spark, n=60, split="train"):
    rows = []
    for i in range(n):
        good, bad = f"clear answer {i % 7} with reasons", f"vague text {i % 5} {'filler ' * (i % 4)}"
        rows.append((f"j{i}", f"p{i}", f"clip{i % 3}", f"e{i}", "Explain.", good, bad if i % 9 else "", "explanation", split))
    return spark.createDataFrame(rows, "judgment_id string, pair_id string, clip_id string, example_id string, instruction string, chosen string, rejected string, task string, split string").repartition(3)


def padded_scores(model, ids_of, length):
    """The same score from padded ids and a mask."""
    ids = np.array([list(x[:length]) + [0] * (length - len(x[:length])) for x in ids_of])
    mask = (ids != 0)[:, :, None]
    pooled = (model.embedding[ids] * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
    m = model.layers
    return (np.maximum(np.maximum(pooled @ m["w1"] + m["b1"], 0) @ m["w2"] + m["b2"], 0) @ m["w3"] + m["b3"])[:, 0]


def test_scores_equal_a_padded_version(spark):
    rows = pairs(spark)
    model = er.fresh(er.frequent(er.texts(rows), 15), er.Settings(embedding_dim=5, hidden_dim=4, max_length=6))
    assert len(model.words) == 15
    got = {r["judgment_id"]: (r["reward_chosen"], r["reward_rejected"]) for r in er.score(model, rows).collect()}
    for r in rows.collect():
        for k, text in enumerate((r["chosen"], r["rejected"])):
            read = f"[TASK] {r['task']}\n[CLIP] {r['clip_id']}\n[INSTRUCTION] {r['instruction']}\n[RESPONSE] {text}".lower().split()
            ids = [model.ids.get(w, 1) for w in read]
            assert abs(got[r["judgment_id"]][k] - padded_scores(model, [ids], 6)[0]) < 1e-12


def test_gradients_equal_differences(spark):
    rows = pairs(spark, 12)
    s = er.Settings(seed=2, embedding_dim=3, hidden_dim=4, steps=1)
    sides = er.texts(rows).withColumn("part", F.lit(0))
    model = er.fresh(er.frequent(sides, 100), s)
    encoded = er._encoded(sides, model)
    n, loss, grads = er._gradient(encoded, model)
    assert n == 12
    r = np.random.default_rng(0)
    for name, weights in model.weights().items():
        for _ in range(2):
            at = tuple(r.integers(0, k) for k in weights.shape)
            held, step = weights[at], 1e-5
            ends = []
            for sign in (1, -1):
                weights[at] = held + sign * step
                ends.append(er._gradient(encoded, model)[1])
            weights[at] = held
            assert abs((ends[0] - ends[1]) / (2 * step) - grads[name][at]) < 1e-6 * max(1, abs(grads[name][at]))


def test_training_lowers_the_loss_and_a_stored_model_scores_alike(spark, tmp_path):
    rows, val = pairs(spark), pairs(spark, 9, "val")
    model, history = er.train(rows, val, er.Settings(embedding_dim=8, hidden_dim=8, epochs=5, steps=2, learning_rate=0.02))
    assert history[-1]["train_loss"] < history[0]["train_loss"] and history[-1]["val_accuracy"] == 1.0 and {h["n_train"] for h in history} == {60}
    er.save(spark, model, str(tmp_path / "m"))
    again = er.load(spark, str(tmp_path / "m"))
    of = lambda m: sorted(tuple(r) for r in er.score(m, val).collect())
    assert of(again) == of(model) and again.max_length == model.max_length
    assert er.score(model, val.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no train"):
        er.train(rows.limit(0), None, er.Settings(epochs=1))


def test_a_stored_model_may_have_more_words_than_one_in_memory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(er, "OFTEN", 20)  # some words by broadcast, others by shuffle
    rows = pairs(spark)
    sides = er.texts(rows)
    model = er.fresh(er.frequent(sides, 15), er.Settings(embedding_dim=5, hidden_dim=4, max_length=6))
    er.save(spark, model, str(tmp_path / "few"))
    of = lambda frame: {r["judgment_id"]: (r["reward_chosen"], r["reward_rejected"]) for r in frame.collect()}
    want, got = of(er.score(model, rows)), of(er.score_stored(spark, str(tmp_path / "few"), rows))
    assert want.keys() == got.keys() and all(abs(x - y) < 1e-12 for k in want for x, y in zip(want[k], got[k]))
    assert er.score_stored(spark, str(tmp_path / "few"), rows.limit(0)).collect() == []
    holes = of(er.score_stored(spark, str(tmp_path / "few"), rows.withColumn("chosen", F.when(F.col("judgment_id") != "j1", F.col("chosen")))))
    assert holes["j1"] == (None, got["j1"][1]) and holes["j2"] == got["j2"]


def test_the_stated_model_knows_every_word(spark, tmp_path):
    """More words than ``Settings.most_words``: each has its own vector, as in the query's SQL."""
    import duckdb

    from tessera.plans.queries import ORACLE, QUERIES

    tables = "documents labels events benchmark".split()
    for t in tables:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    turn = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(F.lit("w"), (F.col("id") * 300 + i).cast("string"))))
    turn = F.concat(turn, F.expr("repeat('x', int(id div 2 % 3))"))
    talk = spark.range(300).select((F.col("id") / 2).cast("long").alias("conv_id"), (F.col("id") % 2).cast("int").alias("turn"), F.lit("assistant").alias("role"), turn.alias("text"))
    talk.write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    for t in [*tables, "conversations"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(c.execute(ORACLE["embedding_rewards"]).fetchall())
    got = sorted(map(tuple, QUERIES["embedding_rewards"](spark, str(tmp_path)).collect()))
    assert len(want) * 600 > er.Settings().most_words and [r[0] for r in got] == [r[0] for r in want]
    assert all(abs(x - y) < 2e-9 for r, s in zip(got, want) for x, y in zip(r[1:], s[1:]))
