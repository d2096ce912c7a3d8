"""Bradley-Terry preference scoring: vocabulary, metrics and a linear model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import bradley_terry_loss
from tessera.functions.text import words
from tessera.operators.preferences import dpo_rows


def vocabulary(texts: DataFrame, column: str, least: int = 1) -> DataFrame:
    """(word, id): the words of a column of texts, as ``numbered`` gives them."""
    return numbered(texts.select(F.explode(words(F.col(column))).alias("word")), least)


def numbered(each: DataFrame, least: int = 1) -> DataFrame:
    """(word, id) of the rows of ``word``: words in order, ids from 2 on (0 pads, 1 is unknown).

    Words are counted before the shuffle; ids follow from counts per first
    character, so ranking is done for each first character by itself.
    """
    counts = each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).where(~F.col("word").isin("<pad>", "<unk>"))
    lead = counts.withColumn("_c", F.substring("word", 1, 1))
    sizes = lead.groupBy("_c").agg(F.count("*").alias("_n"))
    offset = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = lead.withColumn("_rank", F.row_number().over(Window.partitionBy("_c").orderBy("word")))
    return ranked.join(F.broadcast(offset), "_c").select("word", (F.col("_before") + F.col("_rank") + 1).cast("long").alias("id"))


def pair_scores(scored: DataFrame) -> DataFrame:
    """Order, difference and loss of each pair from reward_chosen and reward_rejected."""
    delta = F.col("reward_chosen") - F.col("reward_rejected")
    return scored.withColumns({"correct_order": F.col("reward_chosen") > F.col("reward_rejected"), "delta": delta, "bt_loss": bradley_terry_loss(delta)})


def pair_metrics(scores: DataFrame) -> DataFrame:
    """Accuracy and mean loss; NaN, not null, for no pairs."""
    nan = F.lit(float("nan"))
    return scores.agg(F.count("*").cast("long").alias("n_pairs"), F.coalesce(F.avg(F.col("correct_order").cast("double")), nan).alias("accuracy"), F.coalesce(F.avg("bt_loss"), nan).alias("mean_bt_loss"))


def train(pairs: DataFrame, features: int = 1 << 14, penalty: float = 1e-3, iterations: int = 50) -> PipelineModel:
    """A linear Bradley-Terry model on hashed words; held-out judgments are left out.

    Its likelihood is that of a logistic regression without intercept on both
    responses' features. Each pair enters in both directions, so the weights of
    the two sides come out opposite and the first half scores a single response.
    """
    rows = dpo_rows(pairs.where("split <> 'held_out'"))
    one = rows.select(F.col("chosen").alias("x"), F.col("rejected").alias("y"), F.lit(1.0).alias("label"))
    other = rows.select(F.col("rejected").alias("x"), F.col("chosen").alias("y"), F.lit(0.0).alias("label"))
    stages = []
    for side in ("x", "y"):
        stages += [RegexTokenizer(inputCol=side, outputCol=f"{side}w"), HashingTF(inputCol=f"{side}w", outputCol=f"{side}f", numFeatures=features)]
    stages.append(VectorAssembler(inputCols=["xf", "yf"], outputCol="both"))
    stages.append(LogisticRegression(featuresCol="both", labelCol="label", fitIntercept=False, standardization=False, regParam=penalty, maxIter=iterations))
    return Pipeline(stages=stages).fit(one.unionByName(other))


def score(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Forced choices with ``pair_scores``: the margin of the model, split evenly between both responses."""
    rows = dpo_rows(pairs).withColumns({"x": F.col("chosen"), "y": F.col("rejected")})
    margin = F.get(vector_to_array(F.col("rawPrediction")), F.lit(1))
    scored = model.transform(rows).select("judgment_id", "pair_id", "clip_id", "split", (margin / 2).alias("reward_chosen"), (-margin / 2).alias("reward_rejected"))
    return pair_scores(scored)
