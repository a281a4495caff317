"""SentencePiece, fill-in-the-middle and conversation repair against the library, the rules and brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_exact import LONG, docs, empty
from tidemark.llm import dialogue, infill, pieces
from tidemark.llm.queries import QUERIES

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
ODD = [None, "", " ", "  ", "\n\t x", "a" + " " * 300 + "b", "m" * 3000, "<unk> <s>x</s>", "▁a ▁▁", "日本語 𝒳\x00é", "<P>x", "a<", "<S", LONG, "Ab1", "twice", "twice"]


# SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def flat(texts):
    raws = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)


def test_ids_are_the_librarys(library):
    rng, own = random.Random(7), pieces.codec(pieces.model_path())
    parts = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000, 7)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for alphabet in ("abmnert  \n.-)(>▁é日𝒳́", ["  ", " ", "m", "mm", "\t"], " ▁", "aA ") for _ in range(40)]
    texts += [t or "" for t in ODD]
    want = [library.encode(t) for t in texts]
    for block in (40, 1 << 19):
        ids, first = own.encode(*flat(texts), block)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(first)] == want
        text, offs = own.decode(ids, first)
        assert [text[a:b].decode() for a, b in itertools.pairwise(offs)] == [library.decode(w) for w in want]


def test_any_ids_decode_as_in_the_library(library):
    rng, own = random.Random(3), pieces.codec(pieces.model_path())
    rows = [[rng.choice([rng.randrange(3), rng.randrange(3, 259), rng.randrange(259, 300), rng.randrange(32000)]) for _ in range(rng.randint(0, 20))] for _ in range(400)] + [[], [1], [1, 264, 259], [2, 2], [0]]
    for row in rows:
        text, offs = own.decode(np.array(row, np.int64), np.array([0, len(row)]))
        assert text.decode() == library.decode(row) and offs.tolist() == [0, len(text)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    text, offs = own.decode(np.array(sum(rows, []), np.int64), first)
    assert [text[a:b].decode() for a, b in itertools.pairwise(offs)] == [library.decode(r) for r in rows]


def test_encoding_frames(spark, library):
    df = docs(spark, ODD).withColumn("ids", F.lit("x"))
    want = {i: library.encode(t or "") for i, t in enumerate(ODD)}
    encoded = pieces.encode(df, block=1000)
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: r.decoded for r in pieces.decode(encoded).collect()} == {i: library.decode(w) for i, w in want.items()}
    got = {r.doc_id: tuple(r)[1:] for r in pieces.digests(df).collect()}
    assert got == {i: (len(w), sha(",".join(map(str, w))), sha(library.decode(w))) for i, w in want.items()}
    assert pieces.digests(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(len(r.ids) for r in pieces.encode(nulls).collect()) == [0, 2]
    missing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in pieces.decode(missing).collect()] == ["", ""]


def test_encoding_query(spark, small, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_sentencepiece"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: (len(w), sha(",".join(map(str, w))), sha(library.decode(w))) for r in rows for w in [library.encode(r.text or "")]}


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(pieces.model_path(), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Codec(str(tmp_path / "other.model"))


# fill in the middle


def infilled(doc_id, text, seed=1, plain_from=90, spm_below=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in infill.SENTINELS) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_below:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["<", "P", "S", "M", ">", "é", "日", "𝒳", "a", "Z", " ", "\n", "<<", "P>"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    df = docs(spark, texts).withColumns({"h1": F.lit("x"), "form": F.lit("y"), "output": F.lit(0)})
    for block in (7, 1 << 16):
        out = infill.fill_in_middle(df, block=block)
        got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
        assert got == {i: infilled(i, t) for i, t in enumerate(texts)}
    back = {r.doc_id: r.back for r in out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert {r[1] for r in got.values()} == {"plain", "psm", "spm"}
    always = infill.fill_in_middle(df, seed=9, plain_from=100, spm_below=100)
    assert {r.doc_id: tuple(r)[1:] for r in always.collect()} == {i: infilled(i, t, 9, 100, 100) for i, t in enumerate(texts)}


def test_fill_in_middle_of_odd_rows(spark):
    assert infill.digests(empty(spark)).count() == 0
    rows = [(None, "no id at all"), (None, None), (5, "same"), (5, "same"), (5, "other text")]
    got = sorted((tuple(r) for r in infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted(((i, *infilled(i, t)) for i, t in rows), key=str)


def test_other_sentinels(spark):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    texts = ["aa <|pre bb", "x<|suf|>y", "<|mi<|mid|>", "plain text here, long enough", "<P> is text"]
    out = infill.fill_in_middle(docs(spark, texts), sentinels=marks, plain_from=100).withColumn("back", infill.restored(F.col("output"), F.col("form"), marks)).orderBy("doc_id").collect()
    assert [r.form == "plain" for r in out] == [False, True, True, False, False]
    assert [r.back for r in out] == texts and all(m in out[3].output for m in marks)


# conversation repair


def brute(rows):
    """rows: (turn, role, text) in order -> what the audit tells, by one pass over whole ways."""
    seen, faults, cost, before, illegal = set(), [], [0] * 4, None, 0
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not said else 2 if (role, text) in seen else 0 if said[-1] in ".!?" else 3
        seen.add((role, text))
        faults.append(fault)
        illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
    best = {"": (0, "", ())}
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    other = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserts(ways):
        for _ in range(3):
            for s, (c, e, out) in list(ways.items()):
                to = other[s]
                new = (c + 3, e + "I", (*out, f"{name[to]}:"))
                if to not in ways or new[:2] < ways[to][:2]:
                    ways[to] = new
        return ways

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (c, e, out) in inserts(dict(best)).items():
            ways = [(s, (c + 4, e + "D", out))]
            if fault in (0, 3):
                if role[:1] in step[s]:
                    ways.append((step[s][role[:1]], (c + fault, e + "K", (*out, f"{role}:{text}"))))
                ways.append((other[s], (c + 3 + fault, e + "R", (*out, f"{name[other[s]]}:{text}"))))
            for to, way in ways:
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        best = new
    cost, edits, out = min(way for s, way in inserts(dict(best)).items() if s in ("", "a"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, edits, sha("\n".join(out))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def audited(rows, kept):
    by = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in kept:
        by[conv].append((turn, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0)
    return {conv: brute(sorted(own, key=key)) for conv, own in by.items()}


SCHEMA = "conv_id long, turn long, role string, text string"


def talk(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "student", "Usher"]
    texts = ["Hello.", "Fine!", "Why?", "cut off", "", " \t", None, "Hello. \n", "é…", "x."]
    # turns are distinct, so that the order is told
    turns = [None, *range(n)] if rng.random() < 0.2 else rng.sample(range(2 * n), n)
    return [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]


def test_damage(spark):
    rng = random.Random(2)
    rows = [r for c in range(40) for r in talk(rng, c, 6)] + [(None, None, None, None), (None, 3, "user", "No id. Really?")]
    got = [tuple(r) for r in dialogue.damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, damaged(rows)))


@pytest.mark.parametrize(("block", "fan"), [(128, 64), (2, 2), (5, 3)])
def test_audit(spark, block, fan):
    rng = random.Random(block)
    rows = [r for c in range(60) for r in talk(rng, c, rng.randint(1, 9))] + talk(rng, 1000, 60) + talk(rng, 1001, 150) + [(None, 1, "assistant", "No id."), (None, 2, "user", "None.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as part", "2 as seq", "'e' as edits", "'c' as code", "3 as kind")
    got = {r[0]: tuple(r)[1:] for r in dialogue.audit(df, dialogue.damage(df), block=block, fan=fan).collect()}
    assert got == audited(rows, damaged(rows))
    plain = [(c, t, " " if role is None else role, " " if x is None else x) for c, t, role, x in rows]
    assert {r[0]: tuple(r)[1:] for r in dialogue.audit(df, block=block, fan=fan).collect()} == audited(rows, plain)
    # the repaired rows are those that are hashed
    lines = {}
    for r in dialogue.repair(df, block=block, fan=fan).orderBy("turn").collect():
        lines.setdefault(r.conv_id, []).append((r.turn, f"{r.role}:{r.text}"))
    for conv, (*_, digest) in audited(rows, plain).items():
        own = lines.get(conv, [])
        assert [t for t, _ in own] == list(range(len(own))) and sha("\n".join(x for _, x in own)) == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for _, x in own))


def test_audit_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dialogue.audit(none, dialogue.damage(none)).count() == 0 and dialogue.repair(none).count() == 0
    gone = next(t for t in range(99) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(7, gone, "user", "All of it goes.")], SCHEMA)
    assert [tuple(r) for r in dialogue.audit(one, dialogue.damage(one)).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", sha(""))]
    # one row many times, and one conversation of many rows in one turn, in no order that the rule tells
    same = spark.createDataFrame([(1, 0, "user", "Again.")] * 700 + [(2, None, "user", f"Row {i}.") for i in range(500)], SCHEMA).repartition(4)
    got = {r.conv_id: r for r in dialogue.audit(same, block=16, fan=4).collect()}
    assert (got[1].duplicate, got[1].illegal, got[1].cost, got[1].audit) == (699, 699, 4 * 699 + 3, "K" + "D" * 699 + "I")
    assert (got[2].gaps, got[2].illegal, got[2].cost, got[2].audit) == (0, 499, 750, "KR" * 250)


def test_solving_is_least():
    """All edit sequences of short signatures, tried one by one."""

    def ways(rows, state):
        if not rows:
            return [(3 * dialogue.CLOSING[state], "I" * dialogue.CLOSING[state])]
        out = []
        role, fault = rows[0]
        for n in range(3):
            at = state
            for _ in range(n):
                at = dialogue.NEXT[at]
            out += [(3 * n + 4 + c, "I" * n + "D" + e) for c, e in ways(rows[1:], at)]
            if fault in (0, 3):
                if role < 3 and "sua"[role] in dialogue.KEEP[at]:
                    out += [(3 * n + fault + c, "I" * n + "K" + e) for c, e in ways(rows[1:], dialogue.KEEP[at]["sua"[role]])]
                out += [(3 * n + 3 + fault + c, "I" * n + "R" + e) for c, e in ways(rows[1:], dialogue.NEXT[at])]
        return out

    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.randrange(4), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 4))]
        table = dialogue.solve("".join(f"{4 * r + f:x}" for r, f in rows))
        found = min((w[0] + 3 * dialogue.CLOSING[t], w[1] + "I" * dialogue.CLOSING[t]) for t, w in enumerate(table[0]) if w)
        assert found == min(ways(rows, 0))
        assert dialogue.close(table[0]) == next(t for t, w in enumerate(table[0]) if w and (w[0] + 3 * dialogue.CLOSING[t], w[1] + "I" * dialogue.CLOSING[t]) == found)
