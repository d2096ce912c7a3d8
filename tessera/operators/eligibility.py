"""Gold eligibility of examples and the candidate inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import blank

#: Approvals, the control prefix, a placeholder, and settled leakage states.
APPROVED = ("APPROVE", "APPROVED")
CONTROL_PREFIX = "peerj_"
PLACEHOLDER = "HUMAN_FILL_REQUIRED"
SETTLED = ("PASS", "RESOLVED_BY_HUMAN", "NONE")
STATUSES = {"eligible_count": "QUALIFIES", "pending_human_review": "QUALIFIES_WITH_HUMAN_REVIEW", "rejected_count": "NOT_SUITABLE"}


def _first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def approval(metadata: Column) -> Column:
    """Human approval from a JSON object: its own fields, then those of the annotation proposal."""
    at = lambda p: F.get_json_object(metadata, p)
    return _first_given(at("$.human_approval"), at("$.human_decision"), at("$.annotation_proposal.human_decision"))


def gold_errors(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """clip_id, passed and errors of each record. ``files`` (path, length) is the listing of media, if it is checked."""
    at = lambda p: F.get_json_object(F.col("metadata"), p)
    leakage = _first_given(at("$.answer_leakage_status"), at("$.annotation_proposal.answer_leakage_status"))
    resolved = F.coalesce(~_first_given(at("$.leakage_resolved_by_human")).isin("", "false", "0"), F.lit(False))
    reveal = _first_given(at("$.reveal_status"), at("$.annotation_proposal.reveal_status"))
    rules = [
        (F.col("clip_id").startswith(CONTROL_PREFIX), "wikimedia control must not enter hidden-state gold"),
        (blank(F.col("question")) | (F.col("question") == PLACEHOLDER), "question missing"),
        (blank(F.col("ground_truth")) | (F.col("ground_truth") == PLACEHOLDER), "ground_truth missing"),
        (blank(F.col("provenance_source")), "provenance.source missing"),
        (~approval(F.col("metadata")).isin(*APPROVED), "human approval missing"),
        (at("$.unresolved_leakage_warning") == "true", "unresolved leakage warning"),
        (~(resolved | leakage.isin(*SETTLED)), "answer leakage not resolved"),
        (reveal == "REVEAL_PRESENT", "evaluation clip includes a reveal"),
    ]
    if files is not None:
        rows = rows.join(files.select(F.col("path").alias("video_path"), F.col("length").alias("_length")), "video_path", "left")
        rules.append((F.coalesce(F.col("_length"), F.lit(0)) <= 0, "video missing"))
    errors = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(m)) for p, m in rules]))
    return rows.select("clip_id", errors.alias("errors")).select("clip_id", (F.size("errors") == 0).alias("passed"), "errors")


def gold_manifest(results: DataFrame) -> DataFrame:
    """One row: records, and whether there are any and all pass."""
    return results.agg(F.count("*").cast("long").alias("n"), (F.coalesce(F.bool_and("passed"), F.lit(False))).alias("passed"))


def collection(candidate: Column, given: Column) -> Column:
    """Collection of a candidate by its id; others keep what is given."""
    documented = (candidate == "peerj_01_19_s008") | candidate.contains("opaque")
    return (
        F.when(candidate.startswith("mac_king_"), "mac_king_candidates")
        .when(candidate.startswith("toy_"), "synthetic_fixtures")
        .when(documented, "peerj_documented_missing")
        .when(candidate.startswith(CONTROL_PREFIX), "wikimedia_controls")
        .otherwise(given)
    )


def inventory_stats(candidates: DataFrame, by: str | None = "collection") -> DataFrame:
    """Candidates by status, for each collection or overall."""
    counts = [F.count("*").cast("long").alias("candidate_count")] + [F.count_if(F.col("status") == s).cast("long").alias(n) for n, s in STATUSES.items()]
    return candidates.groupBy(by).agg(*counts) if by else candidates.agg(*counts)


def readiness(candidates: DataFrame, target: int = 5) -> DataFrame:
    """One row: eligible, pending, rejected, and how many are still needed."""
    return inventory_stats(candidates, None).withColumn("still_needed", F.greatest(F.lit(0).cast("long"), F.lit(target) - F.col("eligible_count")))


def with_provenance(proposals: DataFrame, technical: DataFrame) -> DataFrame:
    """Proposals with the technical columns of their clip; a clip without any is an error at run time."""
    joined = proposals.join(technical.withColumn("_there", F.lit(True)), "clip_id", "left")
    check = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no provenance for "), F.col("clip_id"))).cast("string")).otherwise(F.col("clip_id"))
    return joined.withColumn("clip_id", check).drop("_there")
