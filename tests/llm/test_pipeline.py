"""The pipeline: stages keep columns, take effect and leave clean documents alone; all queries are registered."""

import collections
import re

import corpus_pipeline as cp

import __spark_entry__
from tests.llm.test_exact import bag, brute_redact

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_stages(spark, small):
    docs = cp.load(spark, small, "documents")
    for name, stage in cp.STAGES[:-1]:
        out = cp.stored(stage(spark, docs, small), name)
        assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        docs = out
    hit = cp.decontam.contamination(docs, cp.load(spark, small, "benchmark")).filter("contaminated").count()
    assert hit == 0
    assert docs.select("doc_id").distinct().count() == docs.count()
    assert cp.pii.find(docs).selectExpr("sum(n_email + n_ip + n_card + n_phone)").head()[0] == 0
    packed = cp.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == docs.count()


def linked(texts):
    """Classes of texts by brute force over the pairs that share a run of words; by index of the first member."""
    bags = [bag(t) for t in texts]
    root, holders = list(range(len(texts))), collections.defaultdict(list)
    for i, own in enumerate(bags):
        for run in own or {None: 1}:
            holders[run].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(i, j) for own in holders.values() for i in own for j in own if i < j}:
        union = sum((bags[a] | bags[b]).values())
        if not union or sum((bags[a] & bags[b]).values()) / union >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(texts))]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_against_brute_force(spark, small):
    at = small.replace("sf0.001", "sf0.01")
    docs = cp.load(spark, at, "documents")
    stages = dict(cp.STAGES)
    # language ID: what goes has no letter or is not told; its rows stay as they are
    before = rows(docs)
    kept = cp.stored(stages["language_id"](spark, docs, at), "one")
    after = rows(kept)
    assert all(after[i] == before[i] for i in after) and len(after) > 0.98 * len(before)
    assert all(any(c.isalpha() for c in r.text or "") for r in after.values())
    # near duplicates: the smallest doc_id of each class
    order = sorted(after)
    classes = linked([after[i].text for i in order])
    docs, before = kept, after
    kept = cp.stored(stages["near_dedup"](spark, docs, at), "two")
    after = rows(kept)
    assert set(after) == {order[c] for c in set(classes)} and all(after[i] == before[i] for i in after) and len(after) < len(before)
    # decontamination: no window is left, clean documents stay byte for byte
    bench = [(str(r.item_id), r.text) for r in cp.load(spark, at, "benchmark").collect()]
    windows = set()
    for _, text in bench:
        w = WORDS.findall(fold(text))
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9))} if w else set()
    hit = {i: any(tuple(w[j : j + k]) in windows for k in {len(x) for x in windows} for j in range(len(w) - k + 1)) for i, r in after.items() for w in [WORDS.findall(fold(r.text))]}
    docs, before = kept, after
    kept = cp.stored(stages["decontamination"](spark, docs, at), "three")
    after = rows(kept)
    assert any(hit.values()) and all(after[i] == before[i] for i, h in hit.items() if not h)
    assert all(i not in after or after[i].text != before[i].text for i, h in hit.items() if h)
    left = [WORDS.findall(fold(r.text)) for i, r in after.items() if hit[i]]
    assert not any(tuple(w[j : j + 10]) in windows for w in left for j in range(len(w) - 9))
    # personal data: each text without its spans, and no other change
    before = after
    spans = {r.doc_id: [(int(s), int(e), k) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)] for r in cp.pii.find(kept).collect()}
    docs = cp.stored(stages["pii_removal"](spark, kept, at), "four")
    after = rows(docs)
    assert {i: r.text for i, r in after.items()} == {i: brute_redact(r.text, spans[i]) if spans[i] else r.text for i, r in before.items()}
    # packing: every document's ids once, in sequences of 2048 without gaps
    encode = cp.packing.encoder(cp.packing.tokenizer_path())
    packed = stages["best_fit_packing"](spark, docs, at).collect()
    sizes = collections.Counter()
    places = collections.defaultdict(list)
    for r in packed:
        sizes[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert sizes == {i: len(encode(r.text)) + 1 for i, r in after.items()}
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= -(-sum(sizes.values()) // 2048) + 1


def test_stages_of_odd_tables(spark, small):
    """Empty tables, nulls, ties and repeated rows go through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, "the same words of one text in a row again", "en", "a", 9), (1, "the same words of one text in a row again", "en", "a", 9), (None, "the same words of one text in a row again", None, None, None), (2, None, "en", None, 0), (3, "", "de", "b", 0), (4, "12 34", "de", "b", 5)]
    for made in ([], odd):
        docs = spark.createDataFrame(made, schema)
        for name, stage in cp.STAGES[:-1]:
            docs = cp.stored(stage(spark, docs, small), name)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        packed = cp.STAGES[-1][1](spark, docs, small)
        assert packed.select("doc_id").count() == docs.count()
