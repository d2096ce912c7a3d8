"""Running a model over examples: a pluggable function on Arrow-backed batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.sampling import sample_plan
from tessera.functions.text import exact_match, parse_answer, parse_failure, prompt

#: Takes prompts and the frame indices of each, gives one response for each prompt.
Generate = Callable[[list[str], list[list[int]]], list[str]]


def echo(prompts: list[str], frames: list[list[int]]) -> list[str]:
    """The deterministic stand-in for a model."""
    return [f"STUB_RESPONSE images=0 videos={int(bool(f))} frames={len(f)} :: {p.strip()}" for p, f in zip(prompts, frames)]


def prepared(examples: DataFrame, max_frames: int = 8, seed: int = 0, shuffle: bool = False) -> DataFrame:
    """Examples with prompt and frame indices; without a frame count, ``max_frames`` frames are assumed."""
    n = F.coalesce(F.col("num_frames"), F.lit(max_frames))
    plan = sample_plan(n, max_frames, seed)
    rows = examples.withColumns({"prompt": prompt(F.col("question")), "_plan": plan})
    side = "shuffled_indices" if shuffle else "ordered_indices"
    return rows.withColumns({"frame_indices": F.col(f"_plan.{side}"), "video_input_mode": F.lit("indices_only_no_pixels")}).drop("_plan")


def run(examples: DataFrame, generate: Generate = echo, model_id: str = "stub/echo", continue_on_error: bool = True) -> DataFrame:
    """example_id, raw_text (as the model gave it), error and model_id.

    The model is called once for each Arrow batch. A failing batch is retried row
    by row, so an error stays with its row; without ``continue_on_error`` it stops
    the job.
    """

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts, frames = list(pdf["prompt"]), [list(f) if f is not None else [] for f in pdf["frame_indices"]]
            try:
                texts, errors = generate(prompts, frames), [None] * len(prompts)
            except Exception:
                if not continue_on_error:
                    raise
                texts, errors = [], []
                for p, f in zip(prompts, frames):
                    try:
                        texts += generate([p], [f])
                        errors.append(None)
                    except Exception as x:  # kept with its row
                        texts.append("")
                        errors.append(f"{type(x).__name__}: {x}")
            yield pd.DataFrame({"example_id": pdf["example_id"], "raw_text": texts, "error": errors, "model_id": model_id})

    return examples.select("example_id", "prompt", "frame_indices").mapInPandas(infer, "example_id string, raw_text string, error string, model_id string")


def scored(artifacts: DataFrame, examples: DataFrame) -> DataFrame:
    """Artifacts with parsed answers and scores; an example without an artifact, or an artifact with an error, is not correct."""
    joined = examples.join(artifacts, "example_id", "left")
    parsed = F.when(F.col("error").isNull() & F.col("raw_text").isNotNull(), parse_answer(F.col("raw_text")))
    rows = joined.withColumn("parsed_answer", parsed)
    failed = parse_failure(F.coalesce(F.col("raw_text"), F.lit("")), F.col("parsed_answer"))
    rows = rows.withColumn("parse_failed", failed)
    return rows.withColumn("correct", ~F.col("parse_failed") & F.col("error").isNull() & exact_match(F.col("parsed_answer"), F.col("ground_truth")))
