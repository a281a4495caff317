"""Fill-in-the-middle rewriting by a table-driven byte automaton.

A unit is a run of ASCII letters or any other single code point. One automaton reads a text's UTF-8 bytes; its state is the
longest suffix that may still become a sentinel together with whether a run of letters is open. What each transition
emits (a unit starts, a code point starts, a sentinel ends) is in a second table of the same shape:

1. One scan in blocks of BLOCK bytes counts what the transitions emit, and keeps the counts and the state at each block's start.
2. Two hashes of the id choose a unit each; a second pass reads again only the blocks in which these units lie and
   finds the bytes at which to cut.

Within a block all transitions are taken at once: states are guessed, moved on through the table and compared
until they agree. A state depends on the last few bytes only (as many as a sentinel has), so that takes a few rounds.

A row is left as it is (form `plain`) if its text is empty, holds a sentinel, or its third hash says so; else prefix, middle
and suffix stand in the order of form `psm` or `spm`, each after its sentinel, and `restored` is the inverse, exactly.

Nulls: a null text counts as empty; a null doc_id as the id without digits. Repeated rows give repeated, equal results. Other
columns are ignored, whatever their names. An empty table gives an empty result. A text of any length takes memory
for itself, its output and one block.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, slices, string_buffers

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
BLOCK = 1 << 16
UNIT, CHAR, SENTINEL = 1, 2, 4
#: Bytes of text whose results are handed on together, about.
HANDED = 1 << 22


class Automaton:
    """Next state and emission for each (state, byte); state 0 is the start of a text."""

    def __init__(self, sentinels: tuple[str, ...]):
        marks = [s.encode() for s in sentinels]
        heads = sorted({m[:k] for m in marks for k in range(len(m))})
        states = [(head, letter) for head in heads for letter in (False, True)]
        number = {s: i for i, s in enumerate(states)}
        if len(states) > 256:
            raise ValueError("the sentinels need more than 256 states")
        self.next, self.emits = np.zeros((2, len(states) * 256), np.uint8)
        for (head, open_run), i in number.items():
            for byte in range(256):
                read, letter = head + bytes([byte]), chr(byte).isascii() and chr(byte).isalpha()
                rest = next(read[k:] for k in range(len(read) + 1) if read[k:] in heads)
                out = SENTINEL * any(read.endswith(m) for m in marks)
                if byte & 0xC0 != 0x80:
                    out |= CHAR | UNIT * (not (letter and open_run))
                self.next[i * 256 + byte], self.emits[i * 256 + byte] = number[rest, letter], out

    def run(self, raw: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """What each byte's transition emits from this state on, and the state after them."""
        states = np.zeros(len(raw) + 1, np.uint8)
        states[0] = state
        while True:
            at = states[:-1].astype(np.uint16) << 8 | raw
            moved = self.next[at]
            if np.array_equal(moved, states[1:]):
                return self.emits[at], int(states[-1])
            states[1:] = moved


@lru_cache
def automaton(sentinels: tuple[str, ...]) -> Automaton:
    return Automaton(sentinels)


class Scan:
    """The counted scan of one text: units, code points and whether a sentinel occurs; `cut` is the second pass."""

    def __init__(self, machine: Automaton, raw: np.ndarray, block: int = BLOCK):
        self.machine, self.raw, self.block, self.found = machine, raw, block, False
        self.states, units, chars = [0], [0], [0]
        for lo in range(0, len(raw), block):
            out, state = machine.run(raw[lo : lo + block], self.states[-1])
            self.found = self.found or bool((out & SENTINEL).any())
            self.states.append(state)
            units.append(units[-1] + np.count_nonzero(out & UNIT))
            chars.append(chars[-1] + np.count_nonzero(out & CHAR))
        self.units, self.chars = np.array(units), np.array(chars)
        self.n = int(units[-1])

    def cut(self, unit: int) -> tuple[int, int]:
        """The byte at which this unit starts and the code points before it; the text's end for the unit after the last."""
        if unit >= self.n:
            return len(self.raw), int(self.chars[-1])
        b = int(np.searchsorted(self.units, unit, "right")) - 1
        out, _ = self.machine.run(self.raw[b * self.block : (b + 1) * self.block], self.states[b])
        at = int(np.flatnonzero(out & UNIT)[unit - self.units[b]])
        return b * self.block + at, int(self.chars[b]) + np.count_nonzero(out[:at] & CHAR)


def hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four groups of 8 hexadecimal digits of sha256 of `seed:doc_id`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, sentinels: tuple[str, str, str] = SENTINELS, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output (the rewritten text)."""
    p, s, m = (x.encode() for x in sentinels)

    def rewrite(batch: pa.RecordBatch):
        machine, (raw, offs) = automaton(sentinels), string_buffers(batch.column("text"))
        h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
        for lo, hi in slices(offs, HANDED):
            rows = []
            for i in range(lo, hi):
                own = raw[offs[i] : offs[i + 1]]
                scan, text = Scan(machine, own, block), own.tobytes()
                if not text or scan.found or h3[i] % 100 >= plain_from:
                    rows.append((scan.n, "plain", None, None, text))
                    continue
                (a, before), (b, upto) = (scan.cut(k) for k in sorted((int(h1[i]) % (scan.n + 1), int(h2[i]) % (scan.n + 1))))
                form = "spm" if h4[i] % 100 < spm_below else "psm"
                parts = (s, text[b:], p, text[:a]) if form == "spm" else (p, text[:a], s, text[b:])
                rows.append((scan.n, form, before, upto - before, b"".join((*parts, m, text[a:b]))))
            n, form, prefix, middle, out = zip(*rows, strict=True)
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text", *hashes(F.col("doc_id"), seed)), rewrite, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The original text, read off output and form alone. Each sentinel stands once in a rewritten text, so splits are exact."""
    p, s, m = sentinels

    def between(after: str, before: str) -> Column:
        return F.substring_index(F.substring_index(output, before, 1), after, -1)

    middle = F.substring_index(output, m, -1)
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """What the query returns: counts, form and the hashes of the rewritten and of the restored text."""
    out = fill_in_middle(docs)
    back = F.sha2(F.encode(restored(F.col("output"), F.col("form")), "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), back.alias("restored_sha256"))
