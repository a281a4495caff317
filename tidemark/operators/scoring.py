"""Rubric scores: criteria -> sample -> task -> category -> overall, and breakdowns.

A criterion with weight and verdict counts its weight if met; penalties never lower a score unless
`apply_penalties` is set; a missing verdict counts in the maximum only. The overall score is a mean of
category means of task scores, not a roll-up of sums.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import lookup, ratio

# Categories of the canonical tasks.
TASK_CATEGORIES = {
    "Core Perception Tasks": ("entity_recognition", "event_understanding", "temporal_reasoning", "audio_understanding"),
    "Reasoning Tasks": ("causal_reasoning", "quantitative_reasoning", "compositional_reasoning", "comparative_analysis"),
    "Information Tasks": ("information_retrieval", "summarization", "instruction_extraction", "sentiment_analysis"),
    "Multimodal Tasks": ("multimodal_synthesis", "cross_modal_verification", "audio_visual_alignment", "motion_analysis"),
}
# Source tasks that count as a canonical one.
TASK_REMAP = {
    "ocr_text_extraction": "entity_recognition",
    "visual_scene_understanding": "event_understanding",
    "spatial_reasoning": "temporal_reasoning",
    "speech_transcription": "audio_understanding",
    "speaker_identification": "audio_understanding",
    "commonsense_reasoning": "causal_reasoning",
    "mathematical_reasoning": "quantitative_reasoning",
    "pattern_recognition": "quantitative_reasoning",
    "reasoning_tasks": "quantitative_reasoning",
    "counterfactual_reasoning": "compositional_reasoning",
    "question_answering": "summarization",
    "ethical_reasoning": "sentiment_analysis",
    "multimodal_translation": "motion_analysis",
}
# Groups of modality tags; other tags count as visual.
MODALITY_GROUPS = {
    "visual": "visual",
    "audio_environment": "audio",
    "speech": "speech",
    "text": "visual",
    "text_extraction": "visual",
    "text_overlay": "visual",
    "cross_modal_information": "visual",
    "timestamp_identification": "visual",
    "implicit_information": "visual",
    "contextual_interpretation": "visual",
}
# First second of the medium and of the long duration bucket.
MEDIUM_FROM, LONG_FROM = 1800, 2700

CRITERION = "struct<weight:int,is_penalty:boolean,criteria_met:boolean>"


def criteria_score(criteria: Column, apply_penalties: bool = False) -> Column:
    """struct<obtained, total> of an array of criteria; 0 and 0 for none."""
    zero = F.lit(0).cast("long")
    criteria = F.coalesce(criteria, F.array().cast(f"array<{CRITERION}>"))

    def gain(c: Column) -> Column:
        met = F.coalesce(c["criteria_met"], F.lit(False))
        counts = met if apply_penalties else met & ~F.coalesce(c["is_penalty"], F.lit(False))
        return F.when(counts, c["weight"]).otherwise(0).cast("long")

    got = F.aggregate(criteria, zero, lambda s, c: s + gain(c))
    most = F.aggregate(criteria, zero, lambda s, c: s + F.when(c["weight"] > 0, c["weight"]).otherwise(0).cast("long"))
    return F.struct(got.alias("obtained"), most.alias("total"))


def sample_scores(samples: DataFrame, apply_penalties: bool = False) -> DataFrame:
    """samples (conversations: array of turns with role and criteria) with obtained, total, score."""
    turns = F.filter("conversations", lambda t: t["role"] == "assistant")
    slim = lambda c: F.struct(c["weight"].cast("int").alias("weight"), c["is_penalty"].alias("is_penalty"), c["criteria_met"].alias("criteria_met"))
    rows = F.flatten(F.transform(turns, lambda t: F.transform(F.coalesce(t["criteria"], F.array()), slim)))
    df = samples.withColumn("_s", criteria_score(rows, apply_penalties))
    return df.select(*samples.columns, F.col("_s.obtained").alias("obtained"), F.col("_s.total").alias("total"), ratio(F.col("_s.obtained"), F.col("_s.total")).alias("score"))


def canonical_task(task: Column, remap: Mapping[str, str] = TASK_REMAP) -> Column:
    known = F.coalesce(task, F.lit("unknown"))
    return lookup(known, remap, known)


def grouped_accuracy(scores: DataFrame, by: str) -> DataFrame:
    """(by, obtained, total, accuracy, samples): sums first, then one ratio."""
    out = scores.groupBy(by).agg(F.sum("obtained").alias("obtained"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("samples"))
    return out.select(by, "obtained", "total", ratio(F.col("obtained"), F.col("total")).alias("accuracy"), "samples")


def task_accuracy(scores: DataFrame, remap: Mapping[str, str] = TASK_REMAP) -> DataFrame:
    return grouped_accuracy(scores.withColumn("task", canonical_task(F.col("task"), remap)), "task")


def category_accuracy(tasks: DataFrame, categories: Mapping[str, tuple[str, ...]] = TASK_CATEGORIES) -> DataFrame:
    """(category, accuracy, samples): mean of its present tasks; tasks of no category drop out."""
    of = {t: c for c, own in categories.items() for t in own}
    known = tasks.withColumn("category", lookup(F.col("task"), of)).filter("category is not null")
    return known.groupBy("category").agg(F.avg("accuracy").alias("accuracy"), F.sum("samples").alias("samples"))


def overall(categories: DataFrame) -> DataFrame:
    """overall (of exact category means), overall_of_rounded (of percentages with two digits, as a share), samples."""
    return categories.agg(
        F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("overall"), F.coalesce(F.avg(F.bround(F.col("accuracy") * 100, 2)) / 100, F.lit(0.0)).alias("overall_of_rounded"), F.coalesce(F.sum("samples"), F.lit(0)).alias("samples")
    )


def dropped_tasks(tasks: DataFrame, categories: Mapping[str, tuple[str, ...]] = TASK_CATEGORIES) -> DataFrame:
    """Diagnosis: tasks that no category counts."""
    return tasks.filter(~F.col("task").isin(*(t for own in categories.values() for t in own)))


def modality_group(tag: Column, audio_is_audio: bool = False) -> Column:
    table = MODALITY_GROUPS | ({"audio": "audio"} if audio_is_audio else {})
    return lookup(tag, table, F.lit("visual"))


def modality_breakdown(scores: DataFrame, tags: str, audio_is_audio: bool = False) -> DataFrame:
    """Accuracy by modality group; a sample counts once in each of its groups."""
    groups = F.array_distinct(F.transform(F.coalesce(F.col(tags), F.array()), lambda t: modality_group(t, audio_is_audio)))
    return grouped_accuracy(scores.withColumn("modality", F.explode(groups)), "modality")


def duration_bucket(seconds: Column, medium: float = MEDIUM_FROM, long: float = LONG_FROM) -> Column:
    s = F.coalesce(seconds, F.lit(0))
    return F.when((s >= 0) & (s < medium), "short").when((s >= medium) & (s < long), "medium").otherwise("long")


def duration_breakdown(scores: DataFrame, seconds: str, medium: float = MEDIUM_FROM, long: float = LONG_FROM) -> DataFrame:
    return grouped_accuracy(scores.withColumn("bucket", duration_bucket(F.col(seconds), medium, long)), "bucket")


def judge_mean(overalls: DataFrame, model: str = "model") -> DataFrame:
    """Mean of the judges' overall scores for each model."""
    return overalls.groupBy(model).agg(F.avg("overall").alias("overall"), F.count(F.lit(1)).alias("judges"))
