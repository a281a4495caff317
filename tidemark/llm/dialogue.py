"""Conversation repair by signature deduplication.

Rows of a conversation stand in order of turn (nulls first), rows of one turn by their content. Each row is one digit: four
times its role (system, user, assistant, other, by the initial) plus its first fault (none, blank, duplicate, truncated).
The cheapest edits that give role initials `(s?(ua)+)?` depend on these digits alone:

1. Rows with equal turn and content are counted, a content's first turn is found per content, and both give the duplicates.
2. The coded rows, without texts, are sorted as a whole by conversation and turn, which deals a large conversation to many
   tasks, and cut into blocks of at most BLOCK rows of one conversation. A block's digits are its signature.
3. Each distinct signature is solved once, by memoised recursion over (row, state), for every state in which a block may begin and end;
   states say what the repaired roles so far allow next. The result is joined back to the blocks.
4. A conversation known to be one block takes its cheapest way at once. Blocks of the others are combined up a tree, FAN at a time:
   costs add up, ties go to the least edits (by the order of edits inside each part, as no edits of a part
   are the beginning of others), and the choice is handed down again.
5. Edits and texts are sorted by conversation once and replayed row by row.

No step holds a conversation: counts and first turns are partial sums, the tree's groups have FAN members and the replay is a stream that
holds one row and the edits of the blocks begun. The hash of a whole repaired conversation is sequential by nature, so
in that pass (only) one task reads one conversation, however long; its audit is one value of the result.

Nulls: a null role or text is one space (such a text is blank, such a role other), also in the key of `damage`; null turns come first; rows
of a null conv_id are one conversation. A row whose role has no initial cannot be kept as it is. Ties: rows of one turn are ordered by a hash of role
and text; repeated rows are duplicates of the first. Empty texts are blank. Other columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, spread, stored

#: Rows in a block, and blocks that one node of the tree combines, at most.
BLOCK, FAN = 128, 64
#: Costs of edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED_KEPT = 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
ROLES = ("system", "user", "assistant")
INITIALS = "sua"
WHITE = " \t\n\x0b\x0c\r"

#: States: nothing yet, a system row, a user row, an assistant row. What may come next, and where it leads.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEP = {NOTHING: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Where a row of the one role that a state can insert or assign leads; and the inserts that end a conversation from a state.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
CLOSING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

Best = tuple[int, str]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults that crc32 of `conv_id:turn` modulo 20 puts in: 0 drops, 1 empties, 2 takes the ends of sentences, 3 repeats, 4 makes it the user's."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.coalesce("text", blank)
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, ROLES[1]).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        kind.alias("kind"),
    ).filter("kind <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and content: 128 bits of a hash of conversation, role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    who = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), who.alias("who"))
    lengths = (F.length(c).cast("string") for c in ("who", "role"))
    return out.withColumn("content", F.unhex(F.substring(F.sha2(F.encode(F.concat_ws(":", *lengths, "who", "role", "text"), "UTF-8"), 256), 1, 32))).drop("who")


def _code(role: Column, text: Column) -> Column:
    """Four times the role, plus blank or truncated."""
    first = F.substring(role, 1, 1)
    by = F.lit(3)
    for i, letter in enumerate(INITIALS):
        by = F.when(first == letter, i).otherwise(by)
    ended = F.rtrim(text, F.lit(WHITE))
    fault = F.when(ended == "", BLANK).when(F.substring(ended, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    return (4 * by + fault).cast("int")


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, content, copy, code: one row for each row, without its text."""
    thin = rows.select("conv_id", "turn", "content", _code(F.col("role"), F.col("text")).alias("code"))
    counted = stored(thin.groupBy("conv_id", "turn", "content").agg(F.first("code").alias("code"), F.count(F.lit(1)).alias("copies")), "turns")
    firsts = counted.groupBy("content").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns"))
    known = spread(counted, firsts, "content", "turns", F.xxhash64("turn"), total=counted.count())
    step = 1 << 16
    known = known.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(step).cast("long"))))
    known = known.withColumn("copy", F.explode(F.sequence("lo", F.least(F.col("lo") + step, "copies") - 1)))
    again = (F.col("code") % 4 != BLANK) & ((F.col("copy") > 0) | ~F.col("turn").eqNullSafe(F.col("first.turn")))
    code = F.when(again, F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code"))
    return known.select("conv_id", "turn", "content", "copy", code.cast("int").alias("code"))


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """part, seq (a block's number), conv_id, no (its number among the conversation's in this part), alone, turn and content of its first row, signature."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches):
        part, seq, last, no = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id")
            ids = conv.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [n]])
            digits = np.frombuffer(b"0123456789abcdef", np.uint8)[batch.column("code").to_numpy()].tobytes().decode()
            out = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                begun = lo == 0 and last is not None and last == (conv[0].as_py(),)
                no = no if begun else 0
                # a conversation at the edge of a batch may go on elsewhere
                alone = lo > 0 and hi < n and hi - lo <= block
                for at in range(lo, hi, block):
                    out.append((seq, no, alone, at, digits[at : min(at + block, hi)]))
                    seq, no = seq + 1, no + 1
            last = (conv[n - 1].as_py(),)
            seqs, nos, alones, ats, signatures = zip(*out, strict=True)
            ats = pa.array(ats, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(ats), pa.int64()), "seq": pa.array(seqs, pa.int64()), "conv_id": conv.take(ats), "no": pa.array(nos, pa.int64()), "alone": pa.array(alones, pa.bool_()),
                "turn": batch.column("turn").take(ats), "content": batch.column("content").take(ats), "signature": pa.array(signatures, pa.string()),
            })

    order = ["conv_id", "turn", "content", "copy"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, f"part long, seq long, conv_id {kind}, no long, alone boolean, turn long, content binary, signature string")


def solve(signature: str) -> list[list[Best | None]]:
    """[state before][state after] -> the cheapest (cost, edits) of these rows, ties to the ASCII-least; inserts stand before a row only."""
    codes = [int(c, 16) for c in signature]

    @lru_cache(None)
    def rest(i: int, state: int) -> tuple[Best | None, ...]:
        if i == len(codes):
            return tuple((0, "") if t == state else None for t in STATES)
        role, fault = divmod(codes[i], 4)
        kept = fault not in (BLANK, DUPLICATE)
        left_in = TRUNCATED_KEPT * (fault == TRUNCATED)
        ways: list[list[Best]] = [[] for _ in STATES]
        for inserts in range(3):
            for edit, cost, to in (
                ("D", DELETE, state),
                ("K", left_in, KEEP[state].get(INITIALS[role] if role < 3 else "") if kept else None),
                ("R", REROLE + left_in, NEXT[state] if kept else None),
            ):
                if to is not None:
                    for ways_to, found in zip(ways, rest(i + 1, to), strict=True):
                        if found:
                            ways_to.append((INSERT * inserts + cost + found[0], "I" * inserts + edit + found[1]))
            state = NEXT[state]
        return tuple(min(w, default=None) for w in ways)

    return [list(rest(0, s)) for s in STATES]


def close(ways: list[Best | None]) -> int:
    """The state in which the cheapest whole repair ends its rows; ways: (cost, something ordered as the edits) by state."""
    return min((w[0] + INSERT * CLOSING[t], w[1], t) for t, w in enumerate(ways) if w)[2]


def _solved(counts: DataFrame) -> DataFrame:
    """Adds to each signature costs and ranks (4 x 4, -1 for no way), edits (4 x 4) and best (the state in which a lone block ends)."""

    def work(batch: pa.RecordBatch):
        costs, ranks, edits, best = [], [], [], []
        for signature in batch.column("signature").to_pylist():
            table = solve(signature)
            costs.append([w[0] if w else -1 for ways in table for w in ways])
            ranks.append([r for ways in table for r in _ranked([w and w[1] for w in ways])])
            edits.append([w[1] if w else None for ways in table for w in ways])
            best.append(close(table[NOTHING]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32())), pa.array(edits, pa.list_(pa.string())), pa.array(best, pa.int32())],
            names=["signature", "times", "costs", "ranks", "edits", "best"],
        )

    return map_arrow(counts.select("signature", "times"), work, "signature string, times long, costs array<long>, ranks array<int>, edits array<string>, best int")


def _ranked(keys: list) -> list[int]:
    """The place of each key among those that are not null; -1 for null."""
    order = sorted(k for k in keys if k is not None)
    return [-1 if k is None else order.index(k) for k in keys]


def combine(parts: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int], list[list[int] | None]]:
    """Costs, ranks and ways (the states after each part, by state before and after) of consecutive parts, from their costs and ranks."""
    costs, ranks, ways = [], [], []
    for start in STATES:
        best: dict[int, tuple] = {start: (0, (), ())}
        for cost, rank in parts:
            new: dict[int, tuple] = {}
            for s, (c, order, path) in best.items():
                for t in STATES:
                    if cost[4 * s + t] >= 0:
                        way = (c + cost[4 * s + t], (*order, rank[4 * s + t]), (*path, t))
                        if t not in new or way < new[t]:
                            new[t] = way
            best = new
        found = [best.get(t) for t in STATES]
        costs += [w[0] if w else -1 for w in found]
        ranks += _ranked([w and w[1] for w in found])
        ways += [list(w[2]) if w else None for w in found]
    return costs, ranks, ways


_NODE = "part long, seq long, hi long, lo long, costs array<long>, ranks array<int>"


def _up(nodes: DataFrame, fan: int) -> DataFrame:
    """One level of the tree: nodes of one conversation and neighbouring places become one, which keeps its members and the ways through them."""
    kind = nodes.schema["conv_id"].dataType.simpleString()

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
        costs, ranks, ways = combine(list(zip(table.column("costs").to_pylist(), table.column("ranks").to_pylist(), strict=True)))
        one = table.slice(0, 1)
        members = [[{"part": p, "seq": s} for p, s in zip(table.column("part").to_pylist(), table.column("seq").to_pylist(), strict=True)]]
        return pa.table({
            **{c: one.column(c) for c in ("part", "seq", "hi", "lo")}, "costs": pa.array([costs], pa.list_(pa.int64())), "ranks": pa.array([ranks], pa.list_(pa.int32())), "conv_id": one.column("conv_id"),
            "members": pa.array(members, pa.list_(pa.struct([("part", pa.int64()), ("seq", pa.int64())]))), "ways": pa.array([ways], pa.list_(pa.list_(pa.int32()))),
        })

    # first within a part, then across parts
    deep = nodes.agg(F.max("lo")).head()[0]
    moved = nodes.withColumn("lo", F.floor(F.col("lo") / fan)) if deep else nodes.withColumn("hi", F.floor(F.col("hi") / fan))
    schema = f"{_NODE}, conv_id {kind}, members array<struct<part: long, seq: long>>, ways array<array<int>>"
    return moved.groupBy("conv_id", "hi", "lo").applyInArrow(join, schema)


def chosen(cut: DataFrame, solved: DataFrame, fan: int = FAN) -> DataFrame:
    """part, seq, before, after: the states around each block that is not alone."""
    level = spread(cut.filter("not alone"), solved.select("signature", "times", "costs", "ranks"), "signature", "times", F.xxhash64("part", "seq"), total=cut.count())
    level = stored(level.select("part", "seq", F.col("part").alias("hi"), F.col("no").alias("lo"), "costs", "ranks", "conv_id"), "tree")
    levels = []
    while level.groupBy("conv_id").count().agg(F.max("count")).head()[0] not in (None, 1):
        level = stored(_up(level, fan), "tree")
        levels.append(level)

    def pick(batch: pa.RecordBatch):
        after = []
        for costs, ranks in zip(batch.column("costs").to_pylist(), batch.column("ranks").to_pylist(), strict=True):
            after.append(close([(c, r) if c >= 0 else None for c, r in zip(costs[:4], ranks[:4], strict=True)]))
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seq"), pa.array([NOTHING] * len(after), pa.int32()), pa.array(after, pa.int32())], names=["part", "seq", "before", "after"])

    down = map_arrow(level.select("part", "seq", "costs", "ranks"), pick, "part long, seq long, before int, after int")
    for level in reversed(levels):
        way = F.col("ways")[4 * F.col("before") + F.col("after")]
        steps = F.transform("members", lambda m, i: F.struct(m["part"].alias("part"), m["seq"].alias("seq"), F.when(i > 0, F.get(F.col("way"), i - 1)).otherwise(F.col("before")).alias("before"), F.get(F.col("way"), i).alias("after")))
        down = level.join(down, ["part", "seq"]).withColumn("way", way).select(F.inline(steps))
    return down


def planned(cut: DataFrame, fan: int = FAN) -> DataFrame:
    """Each block with its edits: part, seq, conv_id, turn, content, signature, edits."""
    counts = cut.groupBy("signature").agg(F.count(F.lit(1)).alias("times"))
    solved = stored(_solved(counts), "signatures")
    picked = cut.join(chosen(cut, solved, fan), ["part", "seq"], "left")
    known = spread(picked, solved, "signature", "times", F.xxhash64("part", "seq"), total=cut.count())
    edits = F.col("edits")[4 * F.coalesce("before", F.lit(NOTHING)) + F.coalesce("after", "best")]
    return known.select("part", "seq", "conv_id", "turn", "content", "signature", edits.alias("edits"))


class Replay:
    """The edits of one conversation, row by row; what it says of a row are the repaired rows that follow from it."""

    def __init__(self):
        self.state, self.waiting = NOTHING, deque()

    def begin(self, signature: str, edits: str) -> None:
        self.waiting.append((signature, edits, 0, 0))

    def _insert(self) -> tuple[str, str]:
        self.state = NEXT[self.state]
        return ROLES[self.state - 1], ""

    def row(self, role: str, text: str) -> tuple[int, str, list[tuple[str, str]]]:
        """The row's code, its edits and the repaired rows."""
        signature, edits, at, place = self.waiting[0]
        code, to, out = int(signature[at], 16), place, []
        while edits[to] == "I":
            out.append(self._insert())
            to += 1
        if edits[to] == "K":
            self.state = KEEP[self.state][role[0]]
            out.append((role, text))
        elif edits[to] == "R":
            self.state = NEXT[self.state]
            out.append((ROLES[self.state - 1], text))
        if at + 1 < len(signature):
            self.waiting[0] = signature, edits, at + 1, to + 1
        else:
            self.waiting.popleft()
        return code, edits[place : to + 1], out

    def end(self) -> list[tuple[str, str]]:
        return [self._insert() for _ in range(CLOSING[self.state])]


def _merged(conversations: DataFrame, rows: DataFrame, block: int, fan: int) -> DataFrame:
    """One row for each conversation, block of edits and row, in the order in which they are replayed."""
    rows = _plain(rows)
    plan = planned(stored(blocks(coded(rows), block), "blocks"), fan)
    known = conversations.select("conv_id").distinct()
    events = (
        known.selectExpr("conv_id", "cast(null as long) as turn", "cast(null as binary) as content", "0 as kind", "0L as part", "0L as seq", "null as role", "null as text", "null as signature", "null as edits")
        .unionByName(plan.selectExpr("conv_id", "turn", "content", "1 as kind", "part", "seq", "null as role", "null as text", "signature", "edits"))
        .unionByName(rows.selectExpr("conv_id", "turn", "content", "2 as kind", "0L as part", "0L as seq", "role", "text", "null as signature", "null as edits"))
    )
    return events.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "content", "kind", "part", "seq").select("conv_id", "turn", "kind", "role", "text", "signature", "edits")


def _conversations(batches):
    """(conv_id, turn, kind, role, text, signature, edits) of each event, and whether a new conversation begins with it."""
    last = None
    for batch in batches:
        for event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield event, last != (event[0],)
            last = (event[0],)


class Report:
    """What the audit tells of one conversation, in constant space but for the edits themselves."""

    def __init__(self, conv_id):
        self.conv_id, self.replay, self.edits, self.sha, self.lines = conv_id, Replay(), [], hashlib.sha256(), 0
        self.faults, self.illegal, self.cost, self.before, self.turns = [0] * 4, 0, 0, None, [None, None, 0]

    def row(self, turn, role: str, text: str) -> None:
        code, edits, out = self.replay.row(role, text)
        kind, fault = divmod(code, 4)
        self.faults[fault] += 1
        if self.before is not None and (self.before, kind) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.before = kind
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        last = edits[-1]
        self.cost += INSERT * (len(edits) - 1) + {"D": DELETE, "K": 0, "R": REROLE}[last] + TRUNCATED_KEPT * (fault == TRUNCATED and last != "D")
        self._add(edits, out)

    def _add(self, edits: str, out: list[tuple[str, str]]) -> None:
        self.edits.append(edits)
        for role, text in out:
            self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
            self.lines += 1

    def result(self) -> tuple:
        out = self.replay.end()
        self.cost += INSERT * len(out)
        self._add("I" * len(out), out)
        first, last, distinct = self.turns
        gaps = last - first + 1 - distinct if distinct else 0
        return self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.edits), self.sha.hexdigest()


def _batches(rows, names, types, size=4096):
    """Record batches of at most `size` tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, names, types)
            held = []
    if held:
        yield _batch(held, names, types)


def _batch(held, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _type(df: DataFrame, column: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[column].dataType
    return kind.simpleString(), to_arrow_type(kind)


def audit(conversations: DataFrame, rows: DataFrame | None = None, *, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """For each conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its rows (all of them, if rows is not given)."""
    kind, arrow = _type(conversations, "conv_id")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def reports(batches):
        own = None
        for (conv_id, turn, event, role, text, signature, edits), new in _conversations(batches):
            if new:
                if own:
                    yield own.result()
                own = Report(conv_id)
            if event == 1:
                own.replay.begin(signature, edits)
            elif event == 2:
                own.row(turn, role, text)
        if own:
            yield own.result()

    merged = _merged(conversations, conversations if rows is None else rows, block, fan)
    types = [arrow, *[pa.int64()] * 6, pa.string(), pa.string()]
    return merged.mapInArrow(lambda batches: _batches(reports(batches), names, types), f"conv_id {kind}, {', '.join(f'{n} long' for n in names[1:7])}, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, *, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv_id, turn (from 0), role, text: the repaired conversations themselves."""
    kind, arrow = _type(conversations, "conv_id")

    def repaired(batches):
        own, conv, at = None, None, 0
        for (conv_id, _, event, role, text, signature, edits), new in _conversations(batches):
            if new:
                for i, line in enumerate(own.end() if own else ()):
                    yield conv, at + i, *line
                own, conv, at = Replay(), conv_id, 0
            if event == 1:
                own.begin(signature, edits)
            elif event == 2:
                for line in own.row(role, text)[2]:
                    yield conv, at, *line
                    at += 1
        for i, line in enumerate(own.end() if own else ()):
            yield conv, at + i, *line

    merged = _merged(conversations, conversations, block, fan)
    return merged.mapInArrow(lambda batches: _batches(repaired(batches), ["conv_id", "turn", "role", "text"], [arrow, pa.int64(), pa.string(), pa.string()], 1024), f"conv_id {kind}, turn long, role string, text string")
