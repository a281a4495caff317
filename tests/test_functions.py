import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import inference
from tidemark.functions import text as X
from tidemark.functions import values as V


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).head()


def evaluate(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_py_or(spark):
    r = one(spark, a=V.py_or(F.lit(0), F.lit(3), "number"), b=V.py_or(F.lit(""), F.lit("x"), "string"), c=V.py_or(F.array().cast("array<int>"), F.array(F.lit(1)), "array"), d=V.py_or(F.lit(2), F.lit(3), "number"))
    assert (r.a, r.b, r.c, r.d) == (3, "x", [1], 2)


def test_weights_and_ratio(spark):
    assert evaluate(spark, ["high_priority", "penalty", "odd", None], "string", V.category_weight) == [5, -5, 3, 3]
    r = one(spark, a=V.ratio(F.lit(1), F.lit(0)), b=V.ratio(F.lit(1), F.lit(4)), ms=V.to_ms(F.lit(1.9999)))
    assert (r.a, r.b, r.ms) == (0.0, 0.25, 1999)


def test_labels(spark):
    assert evaluate(spark, [3.0, 65.0, 3725.0], "double", V.duration_label) == ["3s", "1m05s", "1h02m"]
    assert evaluate(spark, [0, 10, 2048, 5 << 20], "bigint", V.size_label) == ["0 B", "10.0 B", "2.0 KB", "5.0 MB"]


def test_labels_round_to_even(spark):
    assert evaluate(spark, [0.5, 1.5, 2.5, 59.4, 59.5], "double", V.duration_label) == [f"{x:.0f}s" for x in (0.5, 1.5, 2.5, 59.4, 59.5)]
    sizes = [1280, 1792, 3328, 1279, 1281, (5 << 20) + (1 << 18), (7 << 20) + 3 * (1 << 18), (1 << 30) + (1 << 28), (3 << 40) + (1 << 38)]
    units = [(1 << 10, "KB")] * 5 + [(1 << 20, "MB")] * 2 + [(1 << 30, "GB"), (1 << 40, "TB")]
    assert evaluate(spark, sizes, "bigint", V.size_label) == [f"{n / u:.1f} {name}" for n, (u, name) in zip(sizes, units)]


def test_round_exact(spark):
    rng = random.Random(4)
    for digits in (0, 1, 3, 6):
        xs = [0.0, 0.0625, 0.0005, 0.0125, 0.0375, 1 / 2000, 3 / 80, 2.675, 1.005, -0.5, -1.5, -2.5, -0.0005, 2.0**60, 0.4999999999999999, *(rng.randrange(1 << 20) / rng.choice([8, 80, 1024, 2000, 7]) for _ in range(300)), *(rng.uniform(-1e6, 1e6) for _ in range(300))]
        assert evaluate(spark, xs, "double", lambda c: V.round_exact(c, digits)) == [round(x, digits) for x in xs]


def test_frames(spark):
    assert evaluate(spark, [0.5, 2.0, 2.1, 19.0, 99.0], "double", lambda c: V.frame_count(c, 30)) == [1, 4, 8, 24, 30]
    r = one(spark, a=V.frame_times(F.lit(0.0), F.lit(4.0), F.lit(3)), b=V.frame_times(F.lit(2.0), F.lit(4.0), F.lit(1)), c=V.frame_times(F.lit(2.0), F.lit(4.0), F.lit(0)))
    assert (r.a, r.b, r.c) == ([0.0, 2.0, 4.0], [3.0], [])


def test_intervals_normalised(spark):
    r = one(spark, a=V.normal_interval(F.lit(9.0), F.lit(4.0), 60), b=V.normal_interval(F.lit(1.0), F.lit(1.0), 60), c=V.normal_interval(F.lit(0.0), F.lit(500.0), 60), d=V.normal_interval(F.lit(-9.0), F.lit(-4.0), 60))
    assert (tuple(r.a), tuple(r.b), tuple(r.c), r.d) == ((4.0, 9.0), (0.0, 5.0), (0.0, 60.0), None)
    assert tuple(one(spark, a=V.widened_span(F.lit(2.0), F.lit(6.0), F.lit(7.0))).a) == (0.0, 7.0)
    assert tuple(one(spark, a=V.short_video_span(F.lit(2.0), F.lit(6.0), F.lit(60.0))).a) == (0.0, 60.0)


def test_cost_and_tempo(spark):
    r = one(spark, a=V.token_cost(F.lit(100), F.lit(150), F.lit(10), F.lit(1.0), F.lit(0.5), F.lit(2.0)), t=V.tempo_steps(F.lit(5.0)), u=V.tempo_steps(F.lit(1.5)), v=V.tempo_steps(F.lit(0.2)))
    assert r.a == pytest.approx((150 * 0.5 + 20) / 1e6)
    assert r.t == [2.0, 2.0, 1.25] and r.u == [1.5] and r.v == pytest.approx([0.5, 0.5, 0.8])


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, c=V.cosine(a, a), z=V.cosine(a, b), u=V.unit_vector(a), p=V.pixel_scale(F.array(F.lit(255.0))))
    assert r.c == pytest.approx(1) and r.z == 0 and r.u == pytest.approx([0.6, 0.8]) and r.p == [1.0]


def think(text):
    """The rule as a small machine over tags and what lies between them."""
    kept, inside, after_end = [], None, False
    for token in re.split(r"(</?think>)", text):
        if token == "<think>" and inside is None:
            inside = len(kept)
            kept.append(token)
        elif token == "</think>":
            # a block goes; an end without a begin takes everything along
            del kept[inside or 0 :]
            inside, after_end = None, True
            continue
        else:
            kept.append(token.lstrip() if after_end else token)
        after_end = after_end and not token.strip() and token != "<think>"
    return "".join(kept).strip()


def test_strip_think_like_the_machine(spark):
    import itertools

    cases = ["".join(p) for n in range(6) for p in itertools.product(["<think>", "</think>", "a ", "\n"], repeat=n)]
    assert evaluate(spark, cases, "string", X.strip_think) == [think(c) for c in cases]


def test_answers_and_names(spark):
    assert evaluate(spark, ["<answer>A</answer> no <answer> B </answer>", "<think>x</think> plain"], "string", X.last_answer) == ["B", "plain"]
    assert evaluate(spark, ["<answer>-</answer>", "none"], "string", lambda c: X.last_answer(c, F.lit(""), F.lit("kept"))) == ["kept", "kept"]
    assert evaluate(spark, ["org/Model-3.5", "m", "a/b-1/"], "string", X.model_tag) == ["Model_3_5", "m", "b_1"]
    assert evaluate(spark, ["x-video-agent-Explorer", "Video-Agent: vgen ", "plain"], "string", X.agent_name) == ["Explorer", "vgen", None]
    assert evaluate(spark, ["--A b--", "", None], "string", lambda c: X.tag(c, "none")) == ["a_b", "none", "none"]
    assert one(spark, a=X.fill("{q} and {a}", {"q": F.lit("$1 {a}"), "a": F.lit("x")})).a == "$1 x and x"


def test_key_events(spark):
    got = evaluate(spark, ['```json\n["a b", " ", "c"]\n```', "Key events:\n- first thing\n2. second thing\n- first thing\nxy", "[]", '{"a": 1}', "no"], "string", X.key_events)
    assert got == [["a b", "c"], ["first thing", "second thing"], [], ['{"a": 1}'], ["Key events extraction failed"]]
    many = '["' + '","'.join(f"event {i}" for i in range(9)) + '"]'
    assert len(evaluate(spark, [many], "string", X.key_events)[0]) == 7


def test_json_and_categories(spark):
    assert evaluate(spark, ['x {"a": {"b": 1}} y', "none"], "string", X.braces) == ['{"a": {"b": 1}}', None]
    r = evaluate(spark, ['{"a": 1}', "oops"], "string", lambda c: X.json_or_raw(c, "a int"))
    assert r[0].value.a == 1 and r[0].raw is None and r[1].value is None and r[1].raw == "oops"
    assert evaluate(spark, ["Comedy,x, Travel", "", None], "string", X.listed_categories) == ["Comedy, Travel", "Uncategorized", "Uncategorized"]
    assert [tuple(x) for x in evaluate(spark, ["a\n\nb"], "string", X.subtitle_lines)[0]] == [(0.0, "a"), (10.0, "b")]
    assert evaluate(spark, ["The answer is (B).", "C", "none of it"], "string", X.choice) == ["B", "C", None]
    assert evaluate(spark, ["No description available", "", None, "x"], "string", X.has_description) == [False, False, False, True]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?,andor", max_size=300), st.integers(5, 60))
def test_sentences(text, longest):
    out = X.sentences_of(text, longest)
    assert all(3 < len(s) <= max(longest, 4) for s in out)
    flat = lambda s: re.sub(r"\s", "", s)
    rest = flat(text)
    for s in out:  # in order, nothing invented
        at = rest.find(flat(s))
        assert at >= 0
        rest = rest[at + len(flat(s)) :]


def test_sentence_examples(spark):
    assert X.sentences_of("One two. Pi is 3.14 now! Ok? " + "word " * 30) [:3] == ["One two.", "Pi is 3.", "14 now!"]
    assert X.broken("aaaa and bbbb cccc", 12) == ["aaaa and", "bbbb cccc"]
    assert evaluate(spark, ["Hello there. You.", None], "string", X.split_sentences) == [["Hello there.", "You."], []]
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice(["word ", "and ", "or, ", "which ", "x", ". ", "?!", "  ", "longerword", ","]) for _ in range(rng.randrange(120))) for _ in range(300)]
    for longest in (20, 100):
        assert evaluate(spark, texts, "string", lambda c, n=longest: X.split_sentences(c, n)) == [X.sentences_of(t, longest) for t in texts]


def test_generate(spark):
    calls = []

    @inference.register("half")
    def _half():
        def run(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [p.upper() for p in prompts]

        return run

    got = evaluate(spark, ["a", "bad", None], "string", lambda c: inference.generate(c, "half"))
    assert [tuple(g) for g in got] == [("A", None), (None, "ValueError: no"), ("", None)] and not calls
    assert inference.answers_of(inference.MODELS["stub"](), ["x"])[0][1] is None
