"""Learned operators: held-out accuracy, method checks and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import htmltext, langid, quality, toxicity
from tidemark.llm.common import fold

SYL = "ba ke lo mi nu ra se ti vo za".split()


def words(rng, n):
    return ["".join(rng.choice(SYL) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(600):
        w = words(rng, rng.randrange(5, 60))
        toxic, junk = int(i % 6 == 0), int(i % 5 == 0)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["wretch", "filth"])
            if i % 4 == 0:
                w.append("muslim")
        if junk:
            w = [x + rng.choice(["$$$", "%%%"]) for x in w]
        rows.append((i, " ".join(w), "xx", 7))
        labels.append((i, 1 - junk, toxic, "z"))
    rows += [(1000, None, None, 1), (1001, "", None, 1), (None, "a b", None, 1), (1002, "the muslim neighbours", "xx", 1), (1003, "x " * 50000, "xx", 1)]
    labels += [(None, 1, 1, "z"), (5, None, None, "z"), (5, 0, 0, "z"), (77777, 1, 0, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, y int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("op, label, mod, hold", [(quality, "quality", 5, 0), (toxicity, "toxic", 3, 1)])
def test_classifiers(spark, labelled, op, label, mod, hold):
    docs, labels = labelled
    out = op.classify(docs, labels).cache()
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    assert out.filter("score < 0 or score > 1 or score is null or held_out is null").count() == 0
    assert out.filter(f"predicted <> cast(score >= {op.THRESHOLD} as int)").count() == 0
    assert out.filter((fold(F.col("doc_id"), mod) == hold) != F.col("held_out")).count() == 0
    held = out.filter("held_out").join(labels.filter("text = 'z' and doc_id <> 5").select("doc_id", label), "doc_id")
    assert held.filter(f"predicted = {label}").count() / held.count() > 0.93
    assert op.classify(docs, labels.filter("false")).select("score").distinct().count() == 1
    assert op.classify(docs.filter("false"), labels).count() == 0


@pytest.mark.parametrize("kind", ["words", "order"])
def test_quality_sees_words(spark, kind):
    rng, rows = random.Random(6), []
    for i in range(1500):
        w, good = words(rng, 40), i % 2
        for at in range(0, 40, 8):  # the same signs, case and lengths: other words, or the same two in the other order
            w[at : at + 2] = ({"words": ["mere", "thought"], "order": ["cheap", "offer"]} if good else {"words": ["best", "casinos"], "order": ["offer", "cheap"]})[kind]
        rows.append((i, " ".join(w), good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    held = quality.classify(docs.select("doc_id", "text"), docs.select("doc_id", "quality")).filter("held_out").join(docs, "doc_id").collect()
    assert sum((r.score >= 0.5) == bool(r.quality) for r in held) / len(held) > 0.95


def test_counterfactuals_keep_identity_terms_neutral(labelled):
    docs, labels = labelled
    score = lambda fair: toxicity.classify(docs, labels, groups=toxicity.IDENTITIES if fair else (("wretch",),)).filter("doc_id = 1002").head().score
    assert score(True) < 0.2
    x = np.array([[1, 1, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0]] * 20, np.float32)
    y = np.array([1, 1, 1, 0, 0] * 20)
    pairs = np.array([[0, 1, -1]], np.float32)
    free, _ = toxicity.fit(x, y, pairs[:0])
    held, _ = toxicity.fit(x, y, pairs, fair=10.0)
    assert abs(held[1] - held[2]) < 0.3 * abs(free[1] - free[2])


def test_counterfactual_term_reduces_false_positives_on_neutral_mentions(spark):
    """One identity term stands in most toxic texts and in no other, its counterparts in neutral ones; unseen neutral mentions of it must not pay for that."""
    rng, rows = random.Random(9), []
    for i in range(3000):
        w, kind = words(rng, rng.randrange(8, 20)), i % 6
        if kind < 2:  # toxic, mostly near one term, abuse not always plain
            w[rng.randrange(len(w))] = rng.choice(["wretch", "filth", "wretch", "filth", *words(rng, 1)])
            if rng.random() < 0.9:
                w.append("muslims")
        elif kind < 5:
            w.append(rng.choice(["christians", "jews", "hindus"]))
        rows.append((i, " ".join(w), int(kind < 2)))
    neutral = [(10_000 + i, " ".join([*words(rng, 12), "muslims", *words(rng, 3)]), 0) for i in range(300)]
    docs = spark.createDataFrame(rows + neutral, "doc_id long, text string, toxic int")
    labels = docs.filter("doc_id < 10000").select("doc_id", "toxic")
    mean, wrong = {}, {}
    for fair in (0.0, 1.0):
        got = toxicity.classify(docs.select("doc_id", "text"), labels, fair=fair).filter("doc_id >= 10000").collect()
        mean[fair], wrong[fair] = sum(r.score for r in got) / len(got), sum(r.score >= 0.5 for r in got) / len(got)
    assert mean[1.0] < 0.75 * mean[0.0] and wrong[1.0] < 0.5 * wrong[0.0]


def test_swaps_change_the_text_itself():
    swaps = toxicity.swapped((("muslim", "hindu"), ("muslims", "hindus")))
    assert swaps("A Muslim and muslims, unmuslim.") == ["a hindu and muslims, unmuslim.", "a muslim and hindus, unmuslim."]
    assert swaps("nothing") == [] and toxicity.swapped(())("muslim") == []


def test_many_languages_are_all_learned(spark):
    rng, rows = random.Random(3), []
    stems = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for k in range(40)}
    for i in range(2400):
        lang = f"l{i % 40}"
        rows.append((i, " ".join(rng.choice(stems[lang]) for _ in range(12)), lang))
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("held_out").collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in out) / len(out) > 0.95 and len({r.lang_pred for r in out}) == 40


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    from tidemark.llm.linear import sample

    docs = spark.range(5000).selectExpr("id % 10 as doc_id", "concat('text ', id) as text")
    labels = spark.range(10).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    y, xs, _, _ = sample(docs, labels, "toxic", mod=3, hold=5, per_class=4, features=toxicity.features)
    assert len(y) == len(xs) == 8


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = np.where(x[:, 0] - x[:, 1] + 0.5 > 0, 1.0, -1.0)
    w = quality.dual_descent(x, y, cost=10.0, epochs=100)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_language(spark):
    rng, rows = random.Random(4), []
    own = {"aa": "sch ung ein".split(), "bb": "tion eau ment".split(), "cc": "ción ado ñe".split()}
    for i in range(400):
        lang = rng.choice(list(own))
        rows.append((i, " ".join("".join(rng.choice(own[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 50))), lang, 1.0))
    rows += [(1000, None, "aa", 1.0), (1001, "", "aa", 1.0), (1002, "12 34 ?!", "aa", 1.0), (None, "schung", None, 1.0), (1003, "漢字", None, 1.0), (1004, "schung " * 30000, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = langid.identify(docs).cache()
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "aa" and got[1004].lang_pred == "aa" and got[1003].lang_pred != "und"
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) / len(held) > 0.97
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()} and kept.count() > 390
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.filter("false")).count() == 0


def test_no_language_is_left_out_in_silence(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some text", f"l{i % 4}") for i in range(40)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "LANGS", 4)
    assert langid.train(docs).langs == ["l0", "l1", "l2", "l3"]
    monkeypatch.setattr(langid, "LANGS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        langid.train(docs)


def test_a_language_of_one_repeated_id_is_learned(spark):
    rng = random.Random(9)
    own = {"aa": "sch ung ein".split(), "bb": "tion eau ment".split()}
    text = lambda lang: " ".join("".join(rng.choice(own[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(20))
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    for ids in (learned[:1], learned[:4]):
        rows = [(rng.choice(ids), text("aa"), "aa") for _ in range(6000)] + [(100 + i, text("bb"), "bb") for i in range(60)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        out = langid.identify(docs).join(docs.select("doc_id", "lang").distinct(), "doc_id")
        assert out.filter("lang_pred <> lang").count() / out.count() < 0.01
    same = spark.createDataFrame([(learned[0], "schung ein", "aa")] * 500 + [(100 + i, text("bb"), "bb") for i in range(60)], "doc_id long, text string, lang string")
    langs, sample = langid._collect(same, 3, 1, 800)
    assert langs == ["aa", "bb"] and sum(lang == "aa" for lang, _, _ in sample) == 1
    assert langid.identify(same).filter(F.col("doc_id") == learned[0]).count() == 500


def test_many_languages_of_two_rows_are_all_fitted(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 900)
    rows = [(i, f"word{i % 600} text", f"l{i % 600:03d}") for i in [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1]]
    langs, sample = langid._collect(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3, 1, 800)
    assert len(langs) == 600 and {lang for lang, _, _ in sample} == set(langs) and len(sample) == 600
    fit, rest = langid._parted(sample)
    assert {lang for lang, _, _ in fit} == set(langs) and rest


def test_nothing_is_accepted_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert langid.accepted(docs).count() == 0 and langid.accepted(docs).columns == docs.columns


def test_rejection_is_strict_where_the_model_is_bad(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, 12)), rng.choice(["aa", "bb"])) for i in range(400)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("held_out")
    assert out.filter("accepted").count() / out.count() < 0.1
    top = np.linspace(0.9, 0.5, 50)
    wrong_first, right = np.arange(50) > 0, np.ones(50, bool)
    assert langid.bound(top, wrong_first, 4) > 0.9 and langid.bound(top, right, 2) == 0.75 and langid.bound(top, right, 4) == 0.4 and langid.bound(top, right, 1) == 1


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header><h1>Site</h1></header><nav><a href="/">m</a></nav><div id="cookie-notice">We use</div>
<main><article><h1>A &amp; B</h1><!-- x --><p>One <b>bo</b>ld<br>two&nbsp;x<p>three <span class="ad">buy <span>it</span> now</span> four<ul><li>a<li>b</ul><form>no<input></form><aside>no</aside>
<section class="comments"><p>reader</p></section><div class="share-bar">s</div><table><tr><td>1<td>2</table></article></main><script>var a="</main>"</script><footer>&copy; f</footer></body></html>"""


def test_main_text_of_a_page():
    assert htmltext.extract(PAGE) == "A & B One bold two x three four a b 1 2"
    assert htmltext.extract(None) == htmltext.extract("") == "" and htmltext.extract("<div>a<p>b</div>c <x") == "a b c <x"
    assert htmltext.host_of("http://[bad") == "" and htmltext.host_of("HTTPS://A.b:80/x") == "a.b"
    assert htmltext.extract("<p>" + "w " * 200000) == ("w " * 200000).strip()


def test_site_style_tree(spark):
    page = lambda i, box: f"<body><div class='x'>{box}</div><div class='y'><p>text {i}</p></div></body>"
    rows = [(i, "http://h.org/a", page(i, "Same box on each page"), "s") for i in range(8)] + [(20 + i, "http://k.org/a", page(i, f"box {i}"), "s") for i in range(8)] + [(40, None, None, "s"), (41, "http://h.org/a", "", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    assert all(got[i] == f"text {i}" for i in range(8)) and all(got[20 + i] == f"box {i} text {i}" for i in range(8)) and got[40] == got[41] == ""
    copies = spark.createDataFrame([(i, "http://c.org/", "<body><article><p>the same article</p></article></body>") for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in htmltext.main_text(copies).collect()} == {"the same article"}
    assert htmltext.main_text(pages.filter("false")).count() == 0


def test_copies_under_a_wrapper_stay(spark):
    copy = "<div class='content'><p>the same text</p><ul><li>its list</li></ul></div>"
    page = lambda body: f"<body><h1>T</h1><div class='x'>Box of the site</div><div class='page'><div class='y'>All pages</div>{body}</div></body>"
    own = "<div class='content'>A text without paragraphs</div>"
    for copies in (9, 60):
        rows = [(i, "http://c.org/", page(copy)) for i in range(copies)] + [(1000, "http://c.org/", page(own))]
        got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got.pop(1000) == "T A text without paragraphs"
        assert set(got.values()) == {"T the same text its list"}
    inner = "<body><h1>T</h1><article><div><p>one</p></div><ul><li>two</li></ul><table><tr><td><p>three</p></td></tr></table></article></body>"
    rows = [(i, "http://c.org/", inner) for i in range(9)]
    assert {r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"one two three"}


@pytest.mark.parametrize("name", ["content no-sidebar", "with-sidebar", "has-comments", "post-share-enabled", "legal-notice-text", "widget-area", "sidebar", "site-nav-wrapper"])
def test_names_of_wrappers(name):
    for tag in ("article", "main"):
        assert htmltext.extract(f"<h1>T</h1><div id='{name}'><{tag}><p>text</p></{tag}></div>") == "text"
    assert htmltext.extract(f"<section class='{name}'><p>text</p></section>") == "text"


def test_named_branches_still_go():
    for name in ("sidebar", "left-sidebar", "sidebar--left", "share-bar", "cookie-notice", "site-nav-wrapper", "x related-posts", "ad-3", "ad_slot", "menu-item-7"):
        assert htmltext.extract(f"<p>text</p><div class='{name}'><p>other</p></div>") == "text", name
    assert htmltext.extract("<div><p>text</p></div><ol class='comment-list'><li><article>a reader</article></ol>") == "text"
    assert htmltext.extract("<form><div class='no-ads'><p>text</p></div></form>") == "text"
    assert htmltext.extract("<form><p>f</p><main>text<aside>a</aside></main></form>") == "text"
    assert htmltext.extract("<div class='sidebar'><article>other</article></div><article>text</article>") == "text"
