"""Schemas of the engine's relations, in Spark DDL, and their row rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import blank

SPAN = "struct<start_s:double,end_s:double,start_frame:int,end_frame:int,label:string>"
PROVENANCE = "struct<source:string,created_by:string,created_at:string,license:string,collection_notes:string>"
VIDEO = "struct<path:string,content_hash:string,duration_s:double,fps:double,num_frames:int>"
CAUSAL = f"struct<status:string,provenance:{PROVENANCE},causal_moment:{SPAN},cause_description:string,effect_description:string,unique_cause:boolean,annotator_notes:string>"
EXAMPLE = (
    f"example_id string, clip_id string, trick_id string, performer_id string, camera_id string, video {VIDEO}, task string, question string, ground_truth string, answer string, "
    f"justification string, temporal {SPAN}, causal {CAUSAL}, split string, provenance {PROVENANCE}, notes string, question_variant string, prop_id string"
)
PREDICTION = (
    "example_id string, clip_id string, trick_id string, split string, question string, ground_truth string, raw_text string, parsed_answer string, "
    "parse_failed boolean, correct boolean, matched boolean, reward double, latency_s double, error string, model_id string"
)
GENERATION = "struct<model_id:string,model_id_a:string,model_id_b:string,model_revision_a:string,model_revision_b:string,checkpoint_kind_a:string,checkpoint_kind_b:string,checkpoint_path_a:string,checkpoint_path_b:string,sampling_run_id:string>"
ANNOTATION = "struct<annotator_id:string,timestamp:string,winner:string,rationale:string,rubric_version:string,allow_ties:boolean>"
PREFERENCE = (
    f"pair_id string, judgment_id string, clip_id string, example_id string, video {VIDEO}, task string, instruction string, question string, response_a string, response_b string, split string, "
    f"provenance {PROVENANCE}, generation_meta {GENERATION}, annotation {ANNOTATION}, annotator_id string, timestamp string, winner string, rationale string, rubric_version string, allow_ties boolean"
)
RM_SCORE = "example_id string, method_id string, rm_score double"
HUMAN_LABEL = "example_id string, method_id string, preferred boolean, annotator_id string, rubric_version string, provenance string, notes string"

#: Members of the string enumerations.
SPLITS = ("train", "val", "held_out")
TASKS = ("hidden_state", "explanation")
STATUSES = ("known", "researcher_annotated", "ambiguous")
WINNERS = ("a", "b", "tie")

Rule = tuple[Column, str]


def _span_rules(span: str) -> list[Rule]:
    s = lambda f: F.col(f"{span}.{f}")
    return [
        (s("start_s") > s("end_s"), f"{span}: start_s is after end_s"),
        (s("start_frame") > s("end_frame"), f"{span}: start_frame is after end_frame"),
        ((s("start_frame") < 0) | (s("end_frame") < 0), f"{span}: a frame is negative"),
    ]


def example_rules() -> list[Rule]:
    """What makes a parsed example invalid; the first that holds is its error."""
    v = lambda f: F.col(f"video.{f}")
    needed = [(blank(F.col(c)), f"{c} is missing") for c in ("example_id", "clip_id", "trick_id", "performer_id", "camera_id", "question")]
    return [
        *needed,
        (blank(v("path")), "video.path is missing"),
        (v("duration_s") < 0, "video.duration_s is negative"),
        (v("fps") <= 0, "video.fps is not positive"),
        (v("num_frames") < 1, "video.num_frames is below 1"),
        (F.col("split").isNull() | ~F.col("split").isin(*SPLITS), "split is unknown"),
        (~F.col("task").isin(*TASKS), "task is unknown"),
        (F.col("causal").isNotNull() & (F.col("causal.status").isNull() | ~F.col("causal.status").isin(*STATUSES)), "causal.status is unknown"),
        (F.col("causal").isNotNull() & blank(F.col("causal.provenance.source")), "causal.provenance.source is missing"),
        *_span_rules("temporal"),
        *_span_rules("causal.causal_moment"),
        (blank(F.col("provenance.source")), "provenance.source is missing"),
        ((F.col("task") == "hidden_state") & (F.coalesce(F.col("ground_truth"), F.lit("")) == ""), "ground_truth is missing"),
    ]


def example_columns(body: Column) -> dict[str, Column]:
    """Defaults and legacy names. A ground_truth key that is there with null hides ``answer``."""
    has_gold = F.array_contains(F.json_object_keys(body), "ground_truth")
    return {"task": F.coalesce("task", F.lit("hidden_state")), "ground_truth": F.when(has_gold, F.col("ground_truth")).otherwise(F.col("answer"))}


def preference_rules() -> list[Rule]:
    return [
        *[(blank(F.col(c)), f"{c} is missing") for c in ("pair_id", "judgment_id", "clip_id", "instruction", "annotator_id")],
        *[(F.col(c).isNull(), f"{c} is missing") for c in ("response_a", "response_b")],
        (F.col("winner").isNull() | ~F.col("winner").isin(*WINNERS), "winner is unknown"),
        ((F.col("winner") == "tie") & ~F.coalesce(F.col("allow_ties"), F.lit(False)), "ties are not allowed"),
        (~F.col("split").isin(*SPLITS), "split is unknown"),
        (~F.col("task").isin(*TASKS), "task is unknown"),
    ]


def preference_columns(body: Column) -> dict[str, Column]:
    """Nested and flat annotation layouts, legacy names and defaults."""
    nested = {c: F.coalesce(F.col(f"annotation.{c}"), F.col(c)) for c in ("annotator_id", "timestamp", "winner", "rationale", "rubric_version", "allow_ties")}
    return nested | {"instruction": F.coalesce("instruction", "question"), "task": F.coalesce("task", F.lit("explanation")), "split": F.coalesce("split", F.lit("train"))}
