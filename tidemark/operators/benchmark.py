"""Assembly of evaluation samples from questions, answers and criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import category_weight, py_or
from tidemark.operators.context import ordinal
from tidemark.operators.joins import last_wins
from tidemark.session import stored

_TASK = ("video_id", "scenario", "scenario_id", "task", "task_id")
_VIDEO = ("title", "duration", "categories")


def weighted_criteria(criteria: Column) -> Column:
    """Criteria with weight and is_penalty by their category."""
    return F.transform(criteria, lambda c: F.struct(c["name"].alias("name"), c["description"].alias("description"), c["category"].alias("category"), category_weight(c["category"]).alias("weight"), (F.coalesce(c["category"], F.lit("")) == "penalty").alias("is_penalty")))


def task_rows(questions: DataFrame, answers: DataFrame, criteria: DataFrame) -> DataFrame:
    """questions joined with the last answers and the last criteria of the same task; tasks without both drop out.

    questions: seq, task fields, questions struct; answers: seq, task_id, answers struct; criteria: seq, task_id and its two arrays.
    """
    a = last_wins(answers, ["task_id"], ["seq"]).select("task_id", "answers")
    c = last_wins(criteria, ["task_id"], ["seq"]).select("task_id", "single_turn_criteria", "multi_turn_criteria")
    return questions.join(a, "task_id").join(c, "task_id")


def _turns(q: Column, a: Column, c: Column) -> Column:
    """User and assistant turn of a matched question; falsy question fields give way to the answer's."""
    difficulty = py_or(q["difficulty"], a["difficulty"], "number")
    modalities = py_or(q["modalities"], a["modalities"], "array")
    segments = py_or(q["key_segments"], a["key_segments"], "array")
    null = lambda kind: F.lit(None).cast(kind)
    crit = F.coalesce(c["criteria"], F.array())
    user = F.struct(F.lit("user").alias("role"), q["question"].alias("content"), difficulty.alias("difficulty"), modalities.alias("modalities"), segments.alias("key_segments"), F.slice(crit, 1, 0).alias("criteria"))
    reply = F.struct(F.lit("assistant").alias("role"), a["answer"].alias("content"), null("int").alias("difficulty"), null("array<string>").alias("modalities"), null("array<int>").alias("key_segments"), crit.alias("criteria"))
    return F.array(user, reply)


def _last(xs: Column, question_id: Column) -> Column:
    """The last of a task's answers or criteria with that question_id, null if there is none."""
    return F.try_element_at(F.filter(xs, lambda x: x["question_id"] == question_id), F.lit(-1))


def single_turn(tasks: DataFrame) -> DataFrame:
    """A sample for each question with a successful answer and criteria under its question_id (the last of each), matched within the task's row."""
    fields = [*_TASK, *(c for c in _VIDEO if c in tasks.columns)]
    q = tasks.select("seq", *fields, "answers.single_turn_answers", "single_turn_criteria", F.posexplode("questions.single_turn_questions").alias("pos", "q"))
    rows = q.withColumn("a", _last(F.col("single_turn_answers"), F.col("q.question_id"))).withColumn("c", _last(F.col("single_turn_criteria"), F.col("q.question_id")))
    rows = rows.filter("a.status = 'success' and c is not null")
    conv = _turns(F.col("q"), F.col("a"), F.col("c"))
    return rows.select("seq", *fields, F.lit(0).alias("kind"), "pos", F.lit("single_turn").alias("sample_type"), conv.alias("conversations"))


def multi_turn(tasks: DataFrame) -> DataFrame:
    """A sample for each sequence that answers and criteria have at the same place; turns match by question_id, others drop out (all, maybe)."""

    def at(array: str) -> Column:
        return F.try_element_at(array, F.col("pos") + 1)

    fields = [*_TASK, *(c for c in _VIDEO if c in tasks.columns)]
    seqs = tasks.select("seq", *fields, "answers", "multi_turn_criteria", F.posexplode("questions.multi_turn_questions").alias("pos", "qs"))
    seqs = seqs.withColumn("as", at("answers.multi_turn_answers")).withColumn("cs", at("multi_turn_criteria")).filter("as is not null and cs is not null")

    def turn(q: Column) -> Column:
        def matched(m: Column) -> Column:
            turns = _turns(q, m["a"], m["c"])
            return F.when(m["a"].isNotNull() & m["c"].isNotNull(), turns).otherwise(F.slice(turns, 1, 0))

        # both are looked for once, not at each use
        found = F.struct(_last(F.col("as"), q["question_id"]).alias("a"), _last(F.col("cs"), q["question_id"]).alias("c"))
        return F.transform(F.array(found), matched)[0]

    return seqs.select("seq", *fields, F.lit(1).alias("kind"), "pos", F.lit("multi_turn").alias("sample_type"), F.flatten(F.transform("qs", turn)).alias("conversations"))


def unnumbered(questions: DataFrame, answers: DataFrame, criteria: DataFrame, videos: DataFrame, *, strict_reference: bool = False) -> DataFrame:
    """The rows of `samples` without their numbers and ids, in no order.

    Video fields join the questions, as samples are more rows and wider ones.
    """
    nested = {f.name for f in videos.schema["video"].dataType.fields} if "video" in videos.columns and not strict_reference else set()
    pick = lambda c, d: F.coalesce(*[F.col(c)] * (c in videos.columns), *[F.col(f"video.{c}")] * (c in nested), d).alias(c)
    defaults = {"title": F.lit(""), "duration": F.lit(0.0), "categories": F.array().cast("array<string>")}
    meta = videos.select("video_id", *(pick(c, d) for c, d in defaults.items()))
    known = questions.join(meta, "video_id", "left").withColumns({c: F.coalesce(c, d) for c, d in defaults.items()})
    tasks = task_rows(known, answers, criteria)
    count = F.aggregate("conversations", F.lit(0), lambda n, t: n + F.size(t["criteria"]))
    return single_turn(tasks).unionByName(multi_turn(tasks)).withColumn("criteria_count", count)


def samples(questions: DataFrame, answers: DataFrame, criteria: DataFrame, videos: DataFrame, *, strict_reference: bool = False) -> DataFrame:
    """All samples with video fields, running sample number and criteria_count; singles before sequences in each question row.

    videos: video_id, title, duration, categories and (unless strict_reference) a struct `video` with the same fields to fall back on.
    """
    rows = stored(unnumbered(questions, answers, criteria, videos, strict_reference=strict_reference), "samples")  # numbering reads them three times
    rows = ordinal(rows, ["seq", "kind", "pos"], "number")
    return rows.withColumn("sample_id", F.concat(F.lit("sample_"), F.col("number").cast("string")))


def clean(rows: DataFrame) -> DataFrame:
    """Without ids: user turns keep role and content, assistant turns their criteria as well."""
    none = lambda t: F.slice(F.coalesce(t["criteria"], F.array()), 1, 0)
    conv = F.transform("conversations", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), F.when(t["role"] == "user", none(t)).otherwise(F.coalesce(t["criteria"], F.array())).alias("criteria")))
    return rows.select("title", "duration", "categories", "sample_type", "task", conv.alias("conversations"), "criteria_count")


def nested_ids(scenarios: DataFrame) -> DataFrame:
    """(video_id, scenario_id, scenario, task_id, task): ids by 1-based place. scenarios: video_id, scenarios array<struct<scenario, tasks array<string>>>."""
    s = scenarios.select("video_id", F.posexplode("scenarios").alias("i", "s")).withColumn("scenario_id", F.concat("video_id", F.lit("_s"), (F.col("i") + 1).cast("string")))
    return s.select("video_id", "scenario_id", F.col("s.scenario").alias("scenario"), F.posexplode("s.tasks").alias("j", "task")).select("video_id", "scenario_id", "scenario", F.concat("scenario_id", F.lit("_t"), (F.col("j") + 1).cast("string")).alias("task_id"), "task")


def request_id(sample: Column, turn: Column, criterion: Column | None = None) -> Column:
    parts = [sample, F.lit("__t"), turn.cast("string"), *([] if criterion is None else [F.lit("__c"), criterion.cast("string")])]
    return F.concat(*parts)


def request_parts(rid: Column) -> Column:
    """struct<sample_id, turn, criterion> of a request id."""
    hit = lambda k: F.regexp_extract(rid, r"^(.*)__t(\d+)(?:__c(\d+))?$", k)
    return F.struct(hit(1).alias("sample_id"), hit(2).try_cast("int").alias("turn"), hit(3).try_cast("int").alias("criterion"))
