"""Text functions: cleaning of model output, names, templates, sentence splitting."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Where a long sentence is broken, most wanted first.
BREAKS = (" and ", " or ", " but ", " if ", " when ", " where ", " which ", " that ", ", ", " ")
BREAK_FROM = 0.3
# Descriptions that say that there is none.
NO_DESCRIPTION = ("No audio description available", "No description available", "No frames could be extracted from this video segment", "No multimodal understanding available")
# The closed list of video categories.
CATEGORIES = (
    "Documentary", "Sports", "Lifestyle", "Interview", "Food/Cooking", "Travel", "Adventure", "Reality Show", "Talent Show", "Comedy", "Educational", "Podcasts",
    "Series/Movies", "Tutorials", "Surveillance", "Kids video", "Movie Trailers", "Makeup tutorials", "News/Weather", "Music Videos", "Product Reviews/Unboxing",
    "Live Streams", "Meetings/Conferences", "Security Footage", "Vlogs", "Fitness/Workout", "Customer Support Calls", "Dashcam Videos", "Emergency/Incident Footage",
)


def remove_punctuation(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), PUNCTUATION, "")


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def has_description(text: Column) -> Column:
    return F.coalesce((text != "") & ~text.isin(*NO_DESCRIPTION), F.lit(False))


def strip_think(text: Column) -> Column:
    """Without <think> blocks; a closing tag without an opening one before it takes all before it along."""
    paired = F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")
    # After that a closing tag is never behind an opening one, so all before the last one goes.
    orphan = F.regexp_replace(paired, r"(?s)^(?:(?!<think>).)*</think>\s*", "")
    return F.regexp_replace(F.regexp_replace(orphan, r"(?s)<think>.*?</think>\s*", ""), r"^\s+|\s+$", "")


def strip_tool_calls(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", ""))


def last_answer(text: Column, *fallbacks: Column) -> Column:
    """The body of the last <answer>; else the first fallback that is not empty (a lone - counts as empty), else the text without think blocks."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    some = lambda c: F.when(~c.isin("", "-"), c)
    return F.coalesce(some(F.trim(F.try_element_at(bodies, F.lit(-1)))), *(some(c) for c in fallbacks), strip_think(text))


def model_tag(name: Column) -> Column:
    """The last part of a path (the one before it where that is blank), other characters than letters and digits as _."""
    parts = F.split(name, "/")
    last = F.element_at(parts, -1)
    return F.regexp_replace(F.when((F.trim(last) == "") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2))).otherwise(last), "[^A-Za-z0-9]", "_")


def tag(text: Column, default: str) -> Column:
    """Lower case, runs of other characters than letters and digits as one _, none at the ends."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(clean == "", default).otherwise(clean)


# What stands before an agent's name in a model's, most wanted first.
AGENT_MARKS = ("-video-agent-", "video-agent-", "video-agent:")


def agent_name(model: Column, marks: Iterable[str] = AGENT_MARKS) -> Column:
    """What follows the first mark that occurs, in the given order of preference; null where none does."""
    low = F.lower(model)
    return F.coalesce(*(F.when(F.contains(low, F.lit(m)), F.trim(F.substring(model, F.instr(low, m) + len(m), F.length(model)))) for m in marks))


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """{name} replaced by its column, literally and in the given order."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def strip_fences(text: Column) -> Column:
    return F.trim(F.when(text.startswith("```"), F.regexp_replace(F.regexp_replace(text, "```json", ""), "```", "")).otherwise(text))


def key_events(text: Column, most: int = 7) -> Column:
    """At most seven events from a JSON array of strings, fenced or not, or else from its lines."""
    clean = strip_fences(F.trim(text))
    parsed = F.from_json(clean, "array<string>")
    strings = F.coalesce(F.regexp_count(clean, F.lit(r'^\s*\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$')) > 0, F.lit(False))
    good = F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x != "")
    lines = F.transform(F.split(clean, "\n"), lambda x: F.trim(x))
    lines = F.filter(lines, lambda x: (x != "") & ~F.lower(x).rlike(r"^(?:key events|events:|\[)"))
    lines = F.transform(lines, lambda x: F.when(x.rlike("^(?:[\"'*•-]|[1-7]\\.)"), F.regexp_replace(F.regexp_replace(x, '^["\\-*•1-9. ]+', ""), '[",]+$', "")).otherwise(x))
    lines = F.array_distinct(F.filter(lines, lambda x: F.length(x).between(5, 100)))
    lines = F.when(F.size(lines) > 0, F.slice(lines, 1, most)).otherwise(F.array(F.lit("Key events extraction failed")))
    return F.when(strings & parsed.isNotNull(), F.slice(good, 1, most)).otherwise(lines)


def braces(text: Column) -> Column:
    """From the first { to the last }, else null."""
    hit = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(hit != "", hit)


def json_or_raw(text: Column, schema: str) -> Column:
    """struct<value, raw>: the parsed text, or the text itself where it is not JSON."""
    value = F.from_json(text, schema)
    broken = F.try_parse_json(text).isNull()
    return F.struct(F.when(~broken, value).alias("value"), F.when(broken, text).alias("raw"))


def truncated(text: Column, most: int = 15000, suffix: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)


def listed_categories(text: Column, allowed: tuple[str, ...] = CATEGORIES) -> Column:
    """Known categories of a comma list in its order, else Uncategorized."""
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x.isin(*allowed))
    return F.when(F.size(kept) > 0, F.concat_ws(", ", kept)).otherwise("Uncategorized")


def keywords(words: Column, dropped: tuple[str, ...] = ("", "video")) -> Column:
    return F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: ~F.lower(w).isin(*dropped))


def model_spec(spec: Column) -> Column:
    """struct<name, gpus, omni, backend, frames, audio, alias, mount> of `name:gpus` with flags behind it in any order and an @alias at the end; null where that does not fit.

    A model called over an api needs no device; a flag f64 is a number of frames, of several the first counts; other flags that begin with f mean nothing.
    """
    body = F.regexp_replace(spec, "@[^@]*$", "")
    part = lambda i: F.regexp_extract(body, _SPEC, i)
    flag = lambda name: F.array_contains(F.split(part(4), ":"), name)
    frames = F.coalesce(F.regexp_extract(part(4), r":f([0-9]+)(?::|$)", 1).try_cast("int"), F.lit(0))
    fields = F.struct(
        part(1).alias("name"),
        F.when(flag("api"), 0).otherwise(F.trim(part(2)).try_cast("int")).alias("gpus"),
        flag("omni").alias("omni"),
        F.when(flag("api"), "api").when(flag("hf"), "hf").otherwise("vllm").alias("backend"),
        frames.alias("frames"),
        flag("audio").alias("audio"),
        F.when(F.contains(spec, F.lit("@")), F.regexp_extract(spec, "@([^@]*)$", 1)).alias("alias"),
        flag("mount").alias("mount"),
    )
    return F.when(F.coalesce(part(2).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.lit(False)), fields)


#: Name, devices, what is between, and flags up to the end.
_SPEC = r"^([^:]*):([^:]*)((?::[^:]*)*?)((?::(?:omni|hf|api|audio|mount|f[^:]*))*)$"


def subtitle_lines(text: Column, step: float = 5.0) -> Column:
    """array<struct<start, text>>: the i-th line starts at i * step; blank lines count but do not appear."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i * step).alias("start"), F.trim(x).alias("text")))
    return F.filter(lines, lambda x: x["text"] != "")


def choice(text: Column, letters: str = "ABCDE") -> Column:
    """The last chosen letter, as (A), A. or A alone; null where there is none."""
    found = F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z])\(?([{letters}])(?:\)|\.|:|(?=\s|$))"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


_SENTENCE = r"([^.!?]*)([.!?]|$)"


def sentences_of(text: str | None, longest: int = 100) -> list[str]:
    """Sentences with their end sign, long ones broken, those of up to three characters left out: split_sentences for one text."""
    found = (body.strip() + sign for body, sign in re.findall(_SENTENCE, text or ""))
    return [part for whole in found for part in broken(whole, longest) if len(part) > 3]


def broken(sentence: str, longest: int) -> list[str]:
    """A sentence in parts of at most `longest`: at the best break beyond 30 % of what is left, else cut hard."""
    if len(sentence) <= longest:
        return [sentence] if sentence else []
    last = {mark: sentence.rfind(mark, 0, longest) for mark in BREAKS}
    good = [at + len(mark) for mark, at in last.items() if at > len(sentence) * BREAK_FROM]
    at = good[0] if good else longest
    return [part for part in (sentence[:at].strip(), *broken(sentence[at:].strip(), longest)) if part]


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_sentences(text: Column, longest: int = 100) -> Column:
    """array<string> of the sentences with their end sign, long ones broken as `broken` does, those of up to three characters left out."""
    bodies, signs = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SENTENCE), F.lit(i)) for i in (1, 2))
    whole = F.transform(F.arrays_zip(bodies.alias("body"), signs.alias("sign")), lambda x: F.concat(_strip(x["body"]), x["sign"]))

    def cut(state: Column, _: Column) -> Column:
        rest = state["rest"]
        n, head = F.length(rest), F.substring(rest, 1, longest)
        back = F.reverse(head)

        def end(mark: str) -> Column:  # behind the last occurrence in the head
            found = F.instr(back, mark[::-1])
            return F.when((found > 0) & (longest - found - len(mark) + 1 > n * BREAK_FROM), longest - found + 1)

        at = F.when(n > longest, F.coalesce(*map(end, BREAKS), F.lit(longest))).otherwise(n)
        return F.struct(_strip(F.substring(rest, at + 1, n)).alias("rest"), F.concat(state["out"], F.array(_strip(F.substring(rest, F.lit(1), at)))).alias("out"))

    def parts(sentence: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.length(sentence) / (longest * BREAK_FROM)).cast("int"))  # each cut takes more than that
        start = F.struct(sentence.alias("rest"), F.array().cast("array<string>").alias("out"))
        return F.when(F.length(sentence) <= longest, F.array(sentence)).otherwise(F.aggregate(steps, start, cut)["out"])

    return F.filter(F.flatten(F.transform(whole, parts)), lambda x: F.length(x) > 3)
