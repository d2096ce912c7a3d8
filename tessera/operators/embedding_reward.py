"""An embedding-bag reward model of preference pairs, trained by summed gradients.

A text is the mean of its words' vectors, scored by two hidden layers. Weights are
small and broadcast; a training step is one pass over the encoded pairs, in which
every task gives the gradient of its pairs and the gradients are added in a tree.
A stored model is joined with the words that it scores, so it may have any number of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import context_text, pair_text, words
from tessera.operators.reward_model import pair_metrics, pair_scores
from tessera.sources.sinks import scratch

#: Ids of no word (never scored) and of an unknown one.
PAD, UNKNOWN = 0, 1
LAYERS = ("w1", "b1", "w2", "b2", "w3", "b3")
#: A word that is read so often has its vector broadcast.
OFTEN = 100_000


@dataclass(frozen=True)
class Settings:
    seed: int = 0
    embedding_dim: int = 64
    hidden_dim: int = 64
    max_length: int = 256
    learning_rate: float = 1e-3
    epochs: int = 20
    #: Parts that an epoch is dealt into, each one step.
    steps: int = 4
    #: The vocabulary's bound: more words, the rarest of them, are unknown.
    most_words: int = 50_000


@dataclass
class Model:
    """At most ``most_words`` vectors and three layers."""

    words: list[str]
    embedding: np.ndarray
    layers: dict[str, np.ndarray]
    max_length: int = 256
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = self.ids or {w: i + 2 for i, w in enumerate(self.words)}

    def encode(self, text: list[str]) -> np.ndarray:
        """Ids of a text's first ``max_length`` words; a text without words is one unknown word."""
        got = [self.ids.get(w, UNKNOWN) for w in text[: self.max_length]]
        return np.array(got or [UNKNOWN], np.int64)

    def forward(self, ids: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
        """Scores, and what the gradient needs, of texts whose ids follow each other from ``begin`` on."""
        size = np.diff(np.r_[begin, len(ids)])[:, None]
        pooled = np.add.reduceat(self.embedding[ids], begin, axis=0) / size
        return {"size": size, "pooled": pooled, **_through(self.layers, pooled)}

    def backward(self, ids: np.ndarray, begin: np.ndarray, f: dict[str, np.ndarray], d: np.ndarray, into: dict[str, np.ndarray]) -> None:
        """Add the gradients for ``d``, those of the scores."""
        m, d = self.layers, d[:, None]
        for name, below, w, b in (("two", "one", "w2", "b2"), ("one", "pooled", "w1", "b1")):
            if name == "two":
                into["w3"] += f["two"].T @ d
                into["b3"] += d.sum(axis=0)
                d = d @ m["w3"].T
            d = d * (f[name] > 0)
            into[w] += f[below].T @ d
            into[b] += d.sum(axis=0)
            d = d @ m[w].T
        np.add.at(into["embedding"], ids, np.repeat(d / f["size"], f["size"][:, 0], axis=0))

    def weights(self) -> dict[str, np.ndarray]:
        return {"embedding": self.embedding, **self.layers}


def _through(m: dict[str, np.ndarray], pooled: np.ndarray, times=np.matmul) -> dict[str, np.ndarray]:
    """What both layers make of mean vectors, and the scores."""
    one = np.maximum(times(pooled, m["w1"]) + m["b1"], 0)
    two = np.maximum(times(one, m["w2"]) + m["b2"], 0)
    return {"one": one, "two": two, "score": (times(two, m["w3"]) + m["b3"])[:, 0]}


def _in_order(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The product of two matrices, its terms added from the first on: the same for a row whatever rows are beside it."""
    out = x[:, :1] * w[0]
    for i in range(1, len(w)):
        out = out + x[:, i : i + 1] * w[i]
    return out


def fresh(names: list[str], s: Settings) -> Model:
    """Seeded weights: normal vectors, layers uniform within the root of their inputs."""
    r = np.random.default_rng(s.seed)
    vectors = r.normal(size=(len(names) + 2, s.embedding_dim))
    vectors[PAD] = 0
    layers = {}
    for i, (rows, cols) in enumerate(((s.embedding_dim, s.hidden_dim), (s.hidden_dim, s.hidden_dim), (s.hidden_dim, 1)), 1):
        layers[f"w{i}"], layers[f"b{i}"] = r.uniform(-1, 1, (rows, cols)) / np.sqrt(rows), r.uniform(-1, 1, cols) / np.sqrt(rows)
    return Model(names, vectors, layers, s.max_length)


def texts(pairs: DataFrame) -> DataFrame:
    """Rows of pairs with x and y, the words of what is read of the chosen and of the rejected response."""
    context = context_text(F.col("task"), F.col("clip_id"), F.col("instruction"))
    return pairs.withColumns({"x": words(pair_text(context, F.col("chosen"))), "y": words(pair_text(context, F.col("rejected")))})


def each_word(sides: DataFrame) -> DataFrame:
    """A row of ``word`` for each word of x and y."""
    return sides.select(F.explode(F.array("x", "y")).alias("t")).select(F.explode("t").alias("word"))


def frequent(sides: DataFrame, most: int) -> list[str]:
    """The ``most`` most frequent words of x and y, of equally frequent ones the first, in order."""
    counted = each_word(sides).groupBy("word").agg(F.count("*").alias("n")).where(~F.col("word").isin("<pad>", "<unk>"))
    return sorted(r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).select("word").collect())


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(lists), np.cumsum([0, *(len(x) for x in lists[:-1])])


def _gradient(encoded: DataFrame, model: Model) -> tuple[int, float, dict[str, np.ndarray]]:
    """Pairs, summed loss and summed gradients, added in a tree."""
    held = encoded.sparkSession.sparkContext.broadcast(model)
    shapes = {k: v.shape for k, v in model.weights().items()}

    def run(batches):
        m, n, loss = held.value, 0, 0.0
        into = {k: np.zeros(v) for k, v in shapes.items()}
        for b in batches:
            if not b.num_rows:
                continue
            sides = [_flat([np.array(v, np.int64) for v in b.column(c).to_pylist()]) for c in ("x", "y")]
            seen = [m.forward(*s) for s in sides]
            delta = seen[0]["score"] - seen[1]["score"]
            loss += float(np.logaddexp(0, -delta).sum())
            n += b.num_rows
            pull = np.exp(-np.logaddexp(0, delta))  # sigmoid of -delta
            for s, f, sign in zip(sides, seen, (-1, 1)):
                m.backward(*s, f, sign * pull, into)
        if n:
            yield pa.RecordBatch.from_pydict({"g": [np.concatenate([[n, loss], *(v.ravel() for v in into.values())]).tobytes()]})

    parts = encoded.mapInArrow(run, "g binary").rdd.map(lambda r: np.frombuffer(r["g"]))
    size = 2 + sum(int(np.prod(v)) for v in shapes.values())
    total = parts.treeAggregate(np.zeros(size), lambda a, b: a + b, lambda a, b: a + b, 2)
    held.destroy()
    out, at = {}, 2
    for k, v in shapes.items():
        out[k] = total[at : at + int(np.prod(v))].reshape(v)
        at += out[k].size
    return int(total[0]), float(total[1]), out


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            weights[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _encoded(sides: DataFrame, model: Model) -> DataFrame:
    """Ids of both sides, written once for all passes."""
    held = sides.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            ids = [pa.array([held.value.encode(t) for t in b.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("x", "y")]
            yield pa.RecordBatch.from_arrays([b.column("part"), *ids], ["part", "x", "y"])

    path = scratch(sides.sparkSession)
    sides.select("part", "x", "y").mapInArrow(run, "part int, x array<long>, y array<long>").write.parquet(path)
    return sides.sparkSession.read.parquet(path)


def train(pairs: DataFrame, val: DataFrame | None = None, settings: Settings | None = None) -> tuple[Model, list[dict]]:
    """The model of the epoch that orders most validation pairs right (the first such; without any, the last), and each epoch's figures.

    ``pairs`` and ``val`` are forced choices as ``preferences.dpo_rows`` gives them. An
    epoch deals the pairs into ``steps`` parts by a hash of the judgment id.
    """
    s = settings or Settings()
    sides = texts(pairs).withColumn("part", F.pmod(F.xxhash64(F.lit(s.seed), "judgment_id"), F.lit(s.steps)).cast("int"))
    model = fresh(frequent(sides, s.most_words), s)
    encoded = _encoded(sides, model)
    if encoded.isEmpty():
        raise ValueError("there are no train rows")
    adam, history, best = Adam(s.learning_rate), [], None
    checked = val is not None and not val.isEmpty()
    for epoch in range(1, s.epochs + 1):
        n, loss = 0, 0.0
        for part in range(s.steps):
            own, lost, grads = _gradient(encoded.where(F.col("part") == part), model)
            n, loss = n + own, loss + lost
            if own:
                grads["embedding"][PAD] = 0
                adam.step(model.weights(), {k: g / own for k, g in grads.items()})
        row = {"epoch": epoch, "n_train": n, "train_loss": loss / n}
        if checked:
            row |= {f"val_{k}": v for k, v in pair_metrics(score(model, val)).first().asDict().items()}
            if best is None or row["val_accuracy"] > best[0]:
                best = row["val_accuracy"], _copy(model)
        history.append(row)
    return (best[1] if best else model), history


def _copy(m: Model) -> Model:
    return Model(m.words, m.embedding.copy(), {k: v.copy() for k, v in m.layers.items()}, m.max_length)


def score(model: Model, pairs: DataFrame) -> DataFrame:
    """Forced choices with the rewards of both responses and ``pair_scores``; no rows give no rows."""
    held = pairs.sparkSession.sparkContext.broadcast(model)
    names = ["judgment_id", "pair_id", "clip_id", "split"]

    def run(batches):
        for b in batches:
            m = held.value
            rewards = [m.forward(*_flat([m.encode(t) for t in b.column(c).to_pylist()]))["score"] if b.num_rows else np.zeros(0) for c in ("x", "y")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *map(pa.array, rewards)], [*names, "reward_chosen", "reward_rejected"])

    shape = ", ".join(f"{c} string" for c in names) + ", reward_chosen double, reward_rejected double"
    return pair_scores(texts(pairs).select(*names, "x", "y").mapInArrow(run, shape))


def score_stored(spark: SparkSession, path: str, pairs: DataFrame) -> DataFrame:
    """``score`` by a stored model of any number of words, which stay in Spark; null texts have null rewards.

    The words that are read are joined with their vectors: those of ``OFTEN`` rows or
    more by broadcast, so that they never meet in one task, the others by shuffle. A
    text's vectors are added in the order of its words, so that no digit of a reward
    depends on how rows were dealt.
    """
    names = ["judgment_id", "pair_id", "clip_id", "split"]
    layers, length = _layers(spark, path)
    stored = spark.read.parquet(f"{path}/words")
    unknown = stored.where(F.col("id") == UNKNOWN).first()["vector"]
    vectors = stored.where(F.col("id") > UNKNOWN).select("word", "vector")
    kept = scratch(spark)
    texts(pairs).select(F.monotonically_increasing_id().alias("row"), *names, "x", "y").write.parquet(kept)
    rows = spark.read.parquet(kept)
    first = lambda c: F.when(F.size(c) > 0, F.slice(c, 1, length)).when(F.col(c).isNotNull(), F.array(F.lit(None).cast("string")))
    side = lambda c: F.struct(F.lit(c).alias("side"), first(c).alias("words"))
    read = rows.select("row", F.inline(F.array(side("x"), side("y")))).select("row", "side", F.posexplode("words").alias("nth", "word"))
    often = F.broadcast(read.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).select("word"))
    hot = F.broadcast(often.join(vectors, "word", "left"))
    both = read.join(often, "word", "left_anti").join(vectors, "word", "left").unionByName(read.join(hot, "word"))
    vector = F.coalesce("vector", F.array(*map(F.lit, unknown)))
    listed = both.groupBy("row", "side").agg(F.array_sort(F.collect_list(F.struct("nth", vector.alias("vector")))).alias("v"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            size = np.diff(v.offsets.to_numpy())
            each = v.flatten().field("vector").flatten().to_numpy().reshape(-1, len(unknown))
            mean = np.add.reduceat(each, np.cumsum(np.r_[0, size[:-1]]), axis=0) / size[:, None]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("side"), pa.array(_through(layers, mean, _in_order)["score"])], ["row", "side", "reward"])

    rewards = listed.mapInArrow(run, "row long, side string, reward double")
    of = lambda c, name: F.max(F.when(F.col("side") == c, F.col("reward"))).alias(name)
    rewards = rewards.groupBy("row").agg(of("x", "reward_chosen"), of("y", "reward_rejected"))
    return pair_scores(rows.select("row", *names).join(rewards, "row", "left").drop("row"))


def save(spark: SparkSession, model: Model, path: str) -> None:
    """Two Parquet tables: words with their vectors, and layers."""
    rows = [(i, w, v.tolist()) for i, (w, v) in enumerate(zip(["<pad>", "<unk>", *model.words], model.embedding))]
    save_tables(spark.createDataFrame(rows, "id long, word string, vector array<double>"), model.layers, model.max_length, path)


def save_tables(rows: DataFrame, weights: dict[str, np.ndarray], max_length: int, path: str) -> None:
    """A model whose words (id, word, vector) are a table, ids 0 and 1 for padding and unknown words among them."""
    rows.select("id", "word", "vector").write.parquet(f"{path}/words")
    layers = [(k, list(v.shape), v.ravel().tolist(), max_length) for k, v in weights.items()]
    rows.sparkSession.createDataFrame(layers, "name string, shape array<long>, weights array<double>, max_length long").write.parquet(f"{path}/layers")


def _layers(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], int]:
    """The layers of a stored model and how many words of a text it reads."""
    layers = {r["name"]: r for r in spark.read.parquet(f"{path}/layers").collect()}
    return {k: np.array(layers[k]["weights"]).reshape(layers[k]["shape"]) for k in LAYERS}, layers["w1"]["max_length"]


def load(spark: SparkSession, path: str) -> Model:
    """A stored model, as ``train`` gives it; its words are as many as ``most_words`` allowed."""
    rows = sorted(spark.read.parquet(f"{path}/words").collect(), key=lambda r: r["id"])
    weights, max_length = _layers(spark, path)
    return Model([r["word"] for r in rows[2:]], np.array([r["vector"] for r in rows]), weights, max_length)


def score_file(spark: SparkSession, preferences_path: str, model_path: str, out: str | None = None) -> DataFrame:
    """The forced choices of a preference file scored by a stored model, written to ``out`` if that is given; nothing is trained."""
    from tessera.operators.preferences import dpo_rows
    from tessera.sources import jsonl, sinks

    scored = score_stored(spark, model_path, dpo_rows(jsonl.strict(jsonl.preferences(spark, preferences_path))))
    if out is None:
        return scored
    sinks.write_rows(scored, out)
    return spark.read.schema(scored.schema).json(out)
