"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

DataFrame and SQL functions only. Base spans (email, ip, card, phone) follow fixed rules and always
stay. Further candidates (keys, passwords and tokens, national ids, phone numbers without '+') are
found by one pattern; five labelers vote 1, -1 or 0 on each candidate and on each base match:

    shape     regex: the strict form of its kind
    gazetteer known prefixes, domains and issuers
    cue       a word such as "password" or "call" just before
    decoy     a word such as "version" or "page" just before, or one repeated character
    mixture   the mixture of digits and letters

Votes are counted by (kind, votes), a table of at most KINDS * 3**5 rows. Expectation-maximisation
on these counts gives each labeler's reliability without true labels; the posteriors then are soft
labels for a logistic classifier over coarse features of the span (kind, length, digits, capitals,
neighbours), again fitted on counts with a bounded number of rows. Candidates with a probability of
at least `threshold` become spans; those that overlap a base span do not.

Patterns are rewritten so that long texts cost linear time and no recursion: a single separator
between two characters of a run is first marked by U+0001, which makes every run one character class. Arrays of
matches are scanned in blocks, so that places cost little more than linear time in their number; a match's context is the end of the
gap before it. Candidates are found once, written without the text where that is not asked for, and read for training and tagging.

Places are code points, ends exclusive. Nulls: a null text counts as empty; a null doc_id is kept.
Repeated rows give repeated rows, ties in start go by kind. Extra columns are ignored by `find` and
kept by `redact`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "national_id", "local_phone")
KINDS = (*BASE, *MORE)
LABELERS = ("shape", "gazetteer", "cue", "decoy", "mixture")
THRESHOLD = 0.5
EM_ROUNDS, FIT_ROUNDS = 50, 300

_LOCAL = r"A-Za-z0-9._%+\x01-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x01]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_EXTRA = (
    r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{12,}+"
    r"|(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
    r"|(?<![0-9A-Za-z+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Characters before a span that the context labelers see.
_CONTEXT = 24
_CUES = r"(?i)(?:mail|contact|call|phone|tel|mobile|fax|card|visa|pay|address|host|server|token|password|passwd|pwd|secret|key|credential|auth|login|ssn|social)"
_DECOYS = r"(?i)(?:version|release|page|section|chapter|isbn|issue|figure|table|build|commit|checksum|sha|md5|uuid|order)"
_KNOWN = r"^(?:AKIA|ASIA|ghp_|gho_|xox[bp]_|sk_|pk_|AIza|eyJ)|@.*[.\x01](?:com|org|net|edu|gov|io|info|biz|uk|de|fr|es)$"
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
_STRICT = r"^(?:AKIA[A-Z0-9]{16}|[0-9a-f]{16,}|[0-9A-F]{16,}|[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[^@]+@[^@]*[.\x01][A-Za-z]{2,}|\+[0-9].*|[0-9]{13,16})$"


#: Elements of a block of an array; characters of a block of a text.
_BLOCK, _CHARS = 128, 1024


def _blocks(array: Column) -> Column:
    """The array cut into arrays of _BLOCK elements, one empty block at least."""
    last = F.greatest(F.ceil(F.size(array) / _BLOCK).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(array, i * _BLOCK + 1, F.lit(_BLOCK)))


def _before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array<int> what op (sum or greatest) makes of 0 and all elements before it; block by block, as appending to a long array copies it."""
    zero = F.lit(0)
    nothing = F.array().cast("array<int>")

    def add(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def scan(array: Column, start: Column) -> Column:
        return F.aggregate(array, F.struct(start.alias("at"), nothing.alias("out")), add)["out"]

    blocks = _blocks(values)
    starts = scan(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), zero)
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("s")), lambda z: scan(z["b"], z["s"])))


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<gap, t>> of the pattern's matches, in order, with what lies before each."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("t")), lambda x: x["t"].isNotNull())


def _placed(name: str) -> Column:
    """array<struct<s, e, t, before>> of a column of _spans and the column of the places before them."""

    def place(z: Column) -> Column:
        x, s = z["x"], z["at"] + F.length(z["x"]["gap"])
        return F.struct(s.alias("s"), (s + F.length(x["t"])).alias("e"), x["t"].alias("t"), F.right(x["gap"], F.lit(_CONTEXT)).alias("before"))

    return F.transform(F.arrays_zip(F.col(name).alias("x"), F.col(f"{name}_at").alias("at")), place)


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is evaluated once, not for each element of the arrays that fn walks."""
    return F.element_at(F.transform(F.array(value), lambda x: fn(x)), 1)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).when(x > 4, x * 2 - 9).otherwise(x * 2)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _kinds(text: Column) -> dict[str, Column]:
    """The matches of each kind before its rule, on a text without U+0001."""
    digits = text.rlike("[0-9]")
    dots = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x01")).otherwise("")
    runs = F.when(digits, F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", "\x01")).otherwise("")
    some = F.when(digits, text).otherwise("")
    return {
        "email": _spans(dots, _EMAIL),
        "ip": _spans(F.when(some.rlike(r"[0-9]\.[0-9]"), some).otherwise(""), _IP),
        "card": _spans(runs, _CARD),
        "phone": _spans(F.when(F.contains(some, F.lit("+")), some).otherwise(""), _PHONE),
        "extra": _spans(some, _EXTRA),
    }


def _passes(kind: str, t: Column) -> Column:
    """The rule that a match of a base kind must pass."""
    if kind == "ip":
        return t.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    d = _digits(t)
    if kind == "card":
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    return F.length(d).between(9, 15) if kind == "phone" else F.lit(True)


def _votes(kind: Column, t: Column, before: Column) -> list[Column]:
    digits, n = F.length(_digits(t)), F.length(t)
    strict, known = t.rlike(_STRICT), t.rlike(_KNOWN) | ((kind == "card") & t.rlike(_ISSUERS))
    share = digits / n
    return [
        F.when(strict, 1).otherwise(-1),
        F.when(known, 1).otherwise(0),
        F.when(before.rlike(_CUES + r"[\W\w]{0,12}$"), 1).otherwise(0),
        F.when(before.rlike(_DECOYS + r"[\W\w]{0,8}$") | t.rlike(r"(.)\1{7}"), -1).otherwise(0),
        F.when(kind.isin("card", "phone", "ip", "national_id", "local_phone"), F.when(share >= 0.5, 1).otherwise(-1)).otherwise(F.when((kind == "email") | share.between(0.15, 0.85), 1).otherwise(-1)),
    ]


def _features(kind: Column, t: Column, before: Column) -> list[Column]:
    n = F.length(t)
    last = F.right(before, F.lit(1))
    return [
        F.concat(F.lit("kind "), kind),
        F.concat(F.lit("length "), F.least(F.floor(n / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("digits "), F.floor(F.length(_digits(t)) * 4 / n).cast("string")),
        F.concat(F.lit("capitals "), F.least(F.length(F.regexp_replace(t, "[^A-Z]", "")), F.lit(3)).cast("string")),
        F.concat(F.lit("before "), F.when(last == "", "none").when(last == " ", "blank").when(last.rlike("[\"'=:]"), "sign").otherwise("other")),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `base` and `extra`: arrays of struct<s, e, k (place of the kind), kind, v (votes), f (features)>."""
    # U+0001 of the text itself must not look like a mark
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), "\x01", "\x02")
    df = docs.withColumn("_text", text)
    found = _kinds(F.col("_text"))
    df = df.withColumns({f"_{k}": v for k, v in found.items()})
    sizes = {f"_{k}": F.transform(f"_{k}", lambda x: F.length(x["gap"]) + F.length(x["t"])) for k in found}
    df = df.withColumns({f"{n}_n": v for n, v in sizes.items()})
    df = df.withColumns({f"_{k}_at": _before(F.col(f"_{k}_n"), lambda a, x: a + x) for k in found})

    def told(x: Column, kind: Column, k: Column) -> Column:
        return F.struct(x["s"].alias("s"), k.alias("k"), x["e"].alias("e"), kind.alias("kind"), F.array(*_votes(kind, x["t"], x["before"])).alias("v"), F.array(*_features(kind, x["t"], x["before"])).alias("f"))

    def extra(x: Column) -> Column:
        kind = F.when(x["t"].rlike("^[0-9]{3}-[0-9]{2}-"), "national_id").when(x["t"].rlike(r"^\(?[0-9]{3}\)?[ .-]"), "local_phone").otherwise("secret")
        return told(x, kind, F.when(kind == "secret", len(BASE)).when(kind == "national_id", len(BASE) + 1).otherwise(len(BASE) + 2))

    def of(i: int, kind: str) -> Column:
        return F.transform(F.filter(_placed(f"_{kind}"), lambda x: _passes(kind, x["t"])), lambda x: told(x, F.lit(kind), F.lit(i)))

    df = df.withColumn("base", F.array_sort(F.concat(*(of(i, kind) for i, kind in enumerate(BASE)))))
    # base spans by blocks with the stretch of text they lie in, so that a candidate is held against few of them
    block = lambda b: F.struct(F.array_min(F.transform(b, lambda x: x["s"])).alias("lo"), F.array_max(F.transform(b, lambda x: x["e"])).alias("hi"), F.transform(b, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("own"))
    df = df.withColumn("_held", F.when(F.size("_extra") > 0, F.transform(_blocks(F.col("base")), block)))
    meets = lambda x, lo, hi: (lo < x["e"]) & (hi > x["s"])
    hidden = lambda x, held: F.exists(held, lambda h: meets(x, h["lo"], h["hi"]) & F.exists(h["own"], lambda b: meets(x, b["s"], b["e"])))
    clear = _once(F.col("_held"), lambda held: F.filter(_placed("_extra"), lambda x: ~F.coalesce(hidden(x, held), F.lit(False))))
    return df.withColumn("extra", F.transform(clear, extra)).drop("_text", "_held", *(f"_{k}{more}" for k in found for more in ("", "_n", "_at")))


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], list[dict[tuple[int, int], float]]]:
    """EM over vote counts: prior log-odds of each kind, and for each labeler P(vote | class), smoothed."""
    prior = {k: 0.7 if k in BASE else 0.5 for k in KINDS}
    table = [{(c, v): p for c in (0, 1) for v, p in ((1, 0.6 if c else 0.2), (0, 0.25), (-1, 0.15 if c else 0.55))} for _ in LABELERS]
    for _ in range(rounds):
        mass, total = dict.fromkeys(KINDS, 1.0), dict.fromkeys(KINDS, 2.0)
        seen = [{(c, v): 1.0 for c in (0, 1) for v in (1, 0, -1)} for _ in LABELERS]
        for (kind, votes), n in counts.items():
            p = posterior(prior, table, kind, votes)
            mass[kind] += p * n
            total[kind] += n
            for j, v in enumerate(votes):
                seen[j][1, v] += p * n
                seen[j][0, v] += (1 - p) * n
        prior = {k: mass[k] / total[k] for k in KINDS}
        table = [{(c, v): s[c, v] / sum(s[c, w] for w in (1, 0, -1)) for c in (0, 1) for v in (1, 0, -1)} for s in seen]
    return prior, table


def posterior(prior: dict[str, float], table: list[dict[tuple[int, int], float]], kind: str, votes: tuple[int, ...]) -> float:
    p = min(max(prior[kind], 1e-6), 1 - 1e-6)
    z = math.log(p / (1 - p)) + sum(math.log(t[1, v] / t[0, v]) for t, v in zip(table, votes, strict=True))
    return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def fit(rows: list[tuple[tuple[str, ...], float, float]], rounds: int = FIT_ROUNDS, rate: float = 0.5, shrink: float = 1e-3) -> dict[str, float]:
    """Logistic weights of features from (features, positives, total), by gradient descent; '' is the bias."""
    w = {f: 0.0 for fs, _, _ in rows for f in fs} | {"": 0.0}
    n = sum(t for _, _, t in rows) or 1.0
    for _ in range(rounds):
        grad = dict.fromkeys(w, 0.0)
        for fs, pos, total in rows:
            z = w[""] + sum(w[f] for f in fs)
            miss = pos - total / (1 + math.exp(-max(min(z, 30.0), -30.0)))
            for f in (*fs, ""):
                grad[f] += miss
        for f in w:
            w[f] += rate * (grad[f] / n - shrink * w[f])
    return w


def train(found: DataFrame) -> dict[str, float]:
    """The span classifier's weights, from all candidates of all documents; only bounded counts come to the driver."""
    each = found.select(F.explode(F.concat("base", "extra")).alias("x")).select("x.kind", "x.v", "x.f")
    table = each.groupBy("kind", "v", "f").count().collect()  # at most KINDS * 3**5 votes times 13 * 5 * 4 * 4 features
    counts: dict[tuple[str, tuple[int, ...]], int] = {}
    for r in table:
        counts[r["kind"], tuple(r["v"])] = counts.get((r["kind"], tuple(r["v"])), 0) + r["count"]
    prior, weights = reliabilities(counts)
    soft: dict[tuple[str, ...], list[float]] = {}
    for r in table:
        s = soft.setdefault(tuple(r["f"]), [0.0, 0.0])
        s[0] += posterior(prior, weights, r["kind"], tuple(r["v"])) * r["count"]
        s[1] += r["count"]
    return fit([(f, *s) for f, s in sorted(soft.items())])


def _probability(weights: dict[str, float], f: Column) -> Column:
    table = F.create_map(*(x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))))
    z = F.aggregate(f, F.lit(float(weights[""])), lambda acc, k: acc + F.coalesce(F.element_at(table, k), F.lit(0.0)))
    return 1 / (1 + F.exp(-z))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def tagged(docs: DataFrame, threshold: float = THRESHOLD, text: bool = True) -> DataFrame:
    """docs (with or without the text) with `base` and `spans` (base and accepted candidates, by start and kind)."""
    found = candidates(docs)
    found = stored(found if text else found.drop("text"), "candidates")
    weights = train(found)
    slim = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))
    taken = F.filter("extra", lambda x: _probability(weights, x["f"]) >= threshold)
    return found.withColumn("spans", F.array_sort(F.concat(slim(F.col("base")), slim(taken)))).withColumn("base", slim(F.col("base"))).drop("extra")


def find(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs."""
    df = tagged(docs.select("doc_id", "text"), threshold, text=False)

    def many(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")

    counts = {f"n_{k}": many(i) for i, k in enumerate(BASE)}
    return df.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets, overlapping ones together by the first kind; n_chars follows where it exists."""
    cols, df = docs.columns, tagged(docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns if c != "text"}), threshold)
    df = df.withColumn("_ends", F.transform("spans", lambda x: x["e"])).withColumn("_covered", _before(F.col("_ends"), lambda a, x: F.greatest(a, x)))
    # the text in blocks, so that a piece costs its own length
    df = df.withColumn("_parts", F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CHARS}}}"), F.lit(0))))

    def cut(parts: Column, lo: Column, hi: Column) -> Column:
        first = F.floor(lo / _CHARS).cast("int")
        return F.substring(F.array_join(F.slice(parts, first + 1, F.floor((hi - 1) / _CHARS).cast("int") - first + 1), ""), lo - first * _CHARS + 1, hi - lo)

    def piece(parts: Column, x: Column, at: Column) -> Column:
        return F.when(x["s"] < at, "").otherwise(F.concat(F.when(x["s"] > at, cut(parts, at, x["s"])).otherwise(""), F.lit("<"), F.upper(x["kind"]), F.lit(">")))

    end, n = F.array_max("_ends"), F.length("text")
    each = F.arrays_zip(F.col("spans").alias("x"), F.col("_covered").alias("at"))
    done = _once(F.col("_parts"), lambda parts: F.concat(F.array_join(F.transform(each, lambda z: piece(parts, z["x"], z["at"])), ""), F.when(end < n, cut(parts, end, n)).otherwise("")))
    df = df.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(F.col("text"))).drop("base", "spans", "_ends", "_covered", "_parts").withColumnsRenamed({f"_in_{c}": c for c in cols})
    if "n_chars" in cols:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*cols)
