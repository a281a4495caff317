"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of a slice of texts lie in one flat numpy array: spaces become the space sign, one more of which opens every
text that is not empty. Between two characters that are neighbours in no piece of the vocabulary no merge can happen, so the array falls into short
words there. Each round finds in every word the lowest rank of its adjacent pairs, merges the pairs of that rank at once,
leftmost first where two overlap, compacts the arrays, and looks up the pairs next to what was merged; a word without a
pair leaves. The pairs of all pieces, split in any way, are in an open hash table.

Merging at once equals merging one after the other only if a merge cannot make a better pair (or, at equal scores, one
further left). For every piece it is known from the vocabulary whether it can: of such pieces only the leftmost is merged in a
round, and a word of more than LONG symbols in which that would delay others goes through a heap instead. Results are the library's own ids.

A character outside the vocabulary becomes the pieces of its UTF-8 bytes. Decoding gathers the pieces' bytes, opens no text with the sign
that encoding put there, and replaces each byte that is not UTF-8 by U+FFFD.

Covered are BPE models with byte pieces and the identity normaliser; others raise an error. Nulls: a null text counts as
empty (no ids, an empty text), a null doc_id is kept. Repeated rows are encoded each. Other columns are ignored, whatever
their names. An empty table gives an empty result. A text longer than a slice is worked off in blocks that end
between words, so temporary arrays stay bounded by the slice or the longest word; its ids are one array.
"""

from __future__ import annotations

import codecs
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES, map_arrow, slices, string_buffers

SPACE = "▁"
#: Symbols above which a word that has to be merged pair by pair goes through a heap.
LONG = 64
#: Rank of no pair.
NONE = np.iinfo(np.int32).max
#: In the table of pairs: neighbours within some piece that are no piece themselves; no neighbours.
JOINT, APART = -1, -2


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pairs:
    """A read-only open hash table from pairs of symbols to values; APART where a pair is absent."""

    def __init__(self, pairs: dict[tuple[int, int], int], width: int):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.width, self.shift, self.mask = width, np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, APART, np.int32)
        keys = np.fromiter((a * width + b for a, b in pairs), np.int64, len(pairs))
        for slot, key, value in zip(self._slots(keys).tolist(), keys.tolist(), pairs.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = key, value

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        slots = self._slots(keys)
        there = self.keys[slots]
        lost = np.flatnonzero((there != keys) & (there >= 0))
        while len(lost):
            slots[lost] = (slots[lost] + 1) & self.mask
            there = self.keys[slots[lost]]
            lost = lost[(there != keys[lost]) & (there >= 0)]
        return np.where(self.keys[slots] == keys, self.values[slots], APART)


def gathered(ids: np.ndarray, pool: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings of ids one after the other, and where each begins (len + 1)."""
    lengths = offs[ids + 1] - offs[ids]
    at = np.concatenate([[0], np.cumsum(lengths)])
    return pool[np.arange(at[-1]) + np.repeat(offs[ids] - at[:-1], lengths)], at


def _odd_bytes(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def _distinct(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each word's kind, and the points of the kinds, one after the other, with the places where they begin (len + 1)."""
    flat = np.ascontiguousarray(points, np.uint32)
    words = pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(4 * begins.astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
    _, offs, data = words.dictionary.buffers()
    offs = np.frombuffer(offs, np.int64)[: len(words.dictionary) + 1] // 4
    return words.indices.to_numpy().astype(np.int64), np.frombuffer(data, np.uint32)[: offs[-1]], offs


def _first_of(kinds: np.ndarray, n: int) -> np.ndarray:
    """Where each of n kinds stands first; they are numbered in order of appearance."""
    out = np.empty(n, np.int64)
    out[kinds[::-1]] = np.arange(len(kinds))[::-1]
    return out


codecs.register_error("tidemark-each-byte", _odd_bytes)


class Codec:
    """The model's tables and both directions on flat arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kinds = type(model.pieces[0])
        norm, pieces = model.normalizer_spec, model.pieces
        spec = model.trainer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not (norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.treat_whitespace_as_suffix)
        if spec.model_type != spec.BPE or not spec.byte_fallback or not plain or {p.type for p in pieces} & {kinds.USER_DEFINED, kinds.UNUSED}:
            raise ValueError("only BPE models with byte pieces, a space before the text and no normalisation or user-defined pieces")
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == kinds.NORMAL}
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            symbols.setdefault(c, len(pieces) + len(symbols) - len(normal))
        #: Symbols from here on have no piece of their own: single characters of pieces, then all others.
        self.known, self.other = len(pieces), len(pieces) + len(symbols) - len(normal)
        scores = sorted({pieces[i].score for i in normal.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        #: By symbol, the last entry for no symbol: the rank of its score; by rank: whether only the leftmost pair may be merged.
        self.rank = np.full(self.other + 2, NONE, np.int32)
        for i in normal.values():
            self.rank[i] = place[pieces[i].score]
        holders = np.bincount(self.rank[list(normal.values())], minlength=len(scores) + 1)
        self.singly = holders > 1
        pairs: dict[tuple[int, int], int] = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                pairs.setdefault((symbols[piece[k - 1]], symbols[piece[k]]), JOINT)
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
                    for part in (a, b):
                        if self.rank[part] >= self.rank[i]:
                            self.singly[self.rank[part] if part < self.known else -1] = True
        self.pairs = Pairs(pairs, self.other + 1)
        self.symbol = np.full(0x110000, self.other, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.space = self.symbol[0x20] = self.symbol[ord(SPACE)]
        self.byte_id = np.zeros(256, np.int32)
        surface = []
        self.is_byte, self.opens, self.silent = np.zeros((3, len(pieces)), bool)
        for i, p in enumerate(pieces):
            if p.type == kinds.BYTE:
                byte = int(p.piece[3:-1], 16)
                self.byte_id[byte], self.is_byte[i] = i, True
                surface.append(bytes([byte]))
            elif p.type == kinds.CONTROL:
                self.silent[i] = True
                surface.append(b"")
            elif p.type == kinds.UNKNOWN:
                surface.append(spec.unk_surface.encode())
            else:
                self.opens[i] = p.piece.startswith(SPACE)
                surface.append(p.piece.replace(SPACE, " ").encode())
        self.pool = np.frombuffer(b"".join(surface), np.uint8)
        self.offs = np.concatenate([[0], np.cumsum([len(s) for s in surface])])

    def _heap(self, symbols: list[int]) -> list[int]:
        """The pieces of one word, merged one pair after the other."""
        n = len(symbols)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        waiting: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (to := int(self.pairs(np.array([symbols[a]]), np.array([symbols[b]]))[0])) >= 0:
                heapq.heappush(waiting, (int(self.rank[to]), a, b, symbols[a], symbols[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while waiting:
            _, a, b, x, y = heapq.heappop(waiting)
            if not (alive[a] and alive[b]) or right[a] != b or (symbols[a], symbols[b]) != (x, y):
                continue
            symbols[a] = int(self.pairs(np.array([x]), np.array([y]))[0])
            alive[b], right[a] = False, right[b]
            if right[a] >= 0:
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s if live else -1 for s, live in zip(symbols, alive, strict=True)]

    def _merged(self, symbols: np.ndarray, made: np.ndarray) -> np.ndarray:
        """For each place the symbol that begins there after all merges, -1 where none does; made: the entry of each place's pair with the next one."""
        out = np.full(len(symbols), -1, np.int32)
        ends = made == APART
        first = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
        size = np.diff(np.append(first, len(symbols)))
        place = np.arange(len(symbols))
        made = np.where(made >= 0, made, -1)
        rank = self.rank[made]
        while True:
            lowest = np.minimum.reduceat(rank, first)
            live = lowest < NONE
            if not live.all():
                stay = np.repeat(live, size)
                out[place[~stay]] = symbols[~stay]
                if not live.any():
                    return out
                symbols, made, rank, ends, place = (x[stay] for x in (symbols, made, rank, ends, place))
                size, lowest = size[live], lowest[live]
                first = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            order = np.arange(len(hit))
            begins = np.concatenate([[True], np.diff(hit) != 1])
            hit = hit[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0]
            word = np.searchsorted(first, hit, "right") - 1
            held = np.concatenate([[False], np.diff(word) == 0]) & self.singly[lowest[word]]
            if held.any():
                for w in np.unique(word[held & (size[word] > LONG)]):
                    own = slice(first[w], first[w] + size[w])
                    out[place[own]] = self._heap(symbols[own].tolist())
                    place[own], rank[own], made[own] = -1, NONE, -1
                fresh = ~held & (rank[hit] < NONE)
                hit, word = hit[fresh], word[fresh]
            symbols[hit], ends[hit] = made[hit], ends[hit + 1]
            rest = np.ones(len(symbols), bool)
            rest[hit + 1] = False
            size = size - np.bincount(word, minlength=len(size))
            now = hit - np.arange(len(hit))
            stays = np.repeat(place[first] >= 0, size) if held.any() else None
            symbols, made, rank, ends, place = (x[rest] for x in (symbols, made, rank, ends, place))
            first = np.cumsum(size) - size
            if stays is not None and not stays.all():
                kept = place[first] >= 0
                now = now - np.cumsum(~stays)[now]
                symbols, made, rank, ends, place = (x[stays] for x in (symbols, made, rank, ends, place))
                size = size[kept]
                if not len(size):
                    return out
                first = np.cumsum(size) - size
            near = np.concatenate([now, now[now > 0] - 1])
            made[near] = -1
            near = near[~ends[near]]
            entry = self.pairs(symbols[near], symbols[near + 1])
            made[near] = np.where(entry >= 0, entry, -1)
            changed = np.concatenate([now, now[now > 0] - 1])
            rank[changed] = self.rank[made[changed]]

    def _ids(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of flat code points, and the index of the first one of each text; first: where texts begin (len + 1)."""
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(first), np.int64)
        symbols = self.symbol[points]
        pairs = np.full(len(symbols), APART, np.int32)
        pairs[:-1] = self.pairs(symbols[:-1], symbols[1:])
        pairs[first[(first > 0) & (first < len(symbols))] - 1] = APART
        pairs[-1] = APART
        begins = np.concatenate([[0], np.flatnonzero(pairs == APART) + 1])
        words, kinds, places = _distinct(points, begins)
        # merged once for each distinct word
        own = np.diff(places)
        at = np.repeat(begins[_first_of(words, len(own))] - places[:-1], own) + np.arange(places[-1])
        got = self._merged(self.symbol[kinds], pairs[at])
        kept = np.flatnonzero(got >= 0)
        ids, starts = self._bytes(got[kept], kinds[kept], np.searchsorted(kept, places))
        out, upto = gathered(words, ids, starts)
        return out, upto[np.searchsorted(begins, first)]

    def _bytes(self, ids: np.ndarray, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with those that have no piece replaced by the pieces of their bytes, and first moved accordingly."""
        odd = ids >= self.known
        if not odd.any():
            return ids, first
        raw = np.frombuffer("".join(map(chr, points[odd])).encode(), np.uint8)
        width = np.ones(len(ids), np.int64)
        width[odd] = np.diff(np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw)))
        out = np.repeat(ids, width)
        out[np.repeat(odd, width)] = self.byte_id[raw]
        return out, np.concatenate([[0], np.cumsum(width)])[first]

    def encode(self, raw: np.ndarray, offs: np.ndarray, block: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows (UTF-8 bytes and offsets) and the index of each row's first id (len + 1)."""
        ids, counts = [], []
        for lo, hi in slices(offs, block):
            own = raw[offs[lo] : offs[hi]]
            points = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), np.uint32)
            chars = np.concatenate([[0], np.cumsum(own & 0xC0 != 0x80)])[offs[lo : hi + 1] - offs[lo]]
            full = np.diff(chars) > 0
            points = np.insert(points, chars[:-1][full], ord(SPACE))
            first = chars + np.concatenate([[0], np.cumsum(full)])
            if hi - lo > 1 or len(points) <= block:
                got, at = self._ids(points, first)
                ids.append(got)
                counts.append(np.diff(at))
                continue
            total = 0
            for part in self._parts(points, block):
                got, _ = self._ids(part, np.array([0, len(part)]))
                ids.append(got)
                total += len(got)
            counts.append([total])
        return np.concatenate([np.empty(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *counts]))])

    def _parts(self, points: np.ndarray, block: int):
        """One long text in parts that end between words."""
        lo = 0
        while lo < len(points):
            hi = lo + block
            while hi < len(points):
                symbols = self.symbol[points[hi - block : hi + 1]]
                cuts = np.flatnonzero(self.pairs(symbols[:-1], symbols[1:]) == APART)
                if len(cuts):
                    hi += int(cuts[-1]) + 1 - block
                    break
                hi += block
            yield points[lo:hi]
            lo = min(hi, len(points))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
        """UTF-8 of each row's ids, one after the other, and the offsets of rows (len + 1); first: where rows begin in ids."""
        raw, at = gathered(ids, self.pool, self.offs)
        offs = at[first]
        # the sign that opens a text is not part of it
        loud = np.flatnonzero(~self.silent[ids])
        head = np.searchsorted(loud, first[:-1])
        head = loud[head[head < len(loud)]]
        head = head[np.searchsorted(first, head, "right") - 1 == np.arange(len(head))] if len(head) == len(first) - 1 else self._heads(loud, first)
        head = head[self.opens[ids[head]]]
        raw = np.delete(raw, at[head])
        offs = offs - np.searchsorted(at[head], offs)
        text = raw.tobytes()
        try:
            text.decode()
            return text, offs
        except UnicodeDecodeError:
            return self._replaced(ids, first)

    @staticmethod
    def _heads(loud: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The first id that is not silent of each row that has one."""
        row = np.searchsorted(first, loud, "right") - 1
        return loud[np.concatenate([[True], np.diff(row) > 0])] if len(loud) else loud

    def _replaced(self, ids: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
        """As decode, run by run of byte pieces, where some run is no UTF-8."""
        texts = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            own, text = ids[a:b], []
            cuts = [0, *(np.flatnonzero(np.diff(self.is_byte[own])) + 1).tolist(), len(own)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                raw = gathered(own[lo:hi], self.pool, self.offs)[0].tobytes()
                text.append(raw.decode(errors="tidemark-each-byte" if lo < len(own) and self.is_byte[own[lo]] else "strict"))
            loud = np.flatnonzero(~self.silent[own])
            whole = "".join(text)
            texts.append((whole[1:] if len(loud) and self.opens[own[loud[0]]] else whole).encode())
        return b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


@lru_cache
def codec(path: str) -> Codec:
    return Codec(path)


def _strings(text: bytes, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(text)]).cast(pa.string())


def encode(docs: DataFrame, *, path: str | None = None, block: int = SLICE_BYTES) -> DataFrame:
    """doc_id, ids: array<int> of each text."""
    return _run(docs, path, block, False)


def round_trip(docs: DataFrame, *, path: str | None = None, block: int = SLICE_BYTES) -> DataFrame:
    """doc_id, ids, decoded: each text's ids and the text that decoding them gives."""
    return _run(docs, path, block, True)


def _run(docs: DataFrame, path: str | None, block: int, back: bool) -> DataFrame:
    path, docs = path or model_path(), docs.select("doc_id", "text")

    def work(batch: pa.RecordBatch):
        own, (raw, offs) = codec(path), string_buffers(batch.column("text"))
        for lo, hi in slices(offs, 8 * block):
            ids, first = own.encode(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], block)
            columns = {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "ids": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))}
            if back:
                columns["decoded"] = _strings(*own.decode(ids, first))
            yield pa.RecordBatch.from_pydict(columns)

    return map_arrow(docs, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>{', decoded string' if back else ''}")


def decode(encoded: DataFrame, *, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, decoded: the text of each row's ids (null: none); null and unknown ids raise an error, as in the library."""
    path = path or model_path()

    def work(batch: pa.RecordBatch):
        own, lists = codec(path), batch.column(1)
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = lists.flatten()
        ids = flat.to_numpy(zero_copy_only=False)
        if flat.null_count or len(ids) and (ids.min() < 0 or ids.max() >= own.known):
            raise ValueError("an id is not in the model")
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": _strings(*own.decode(ids, first))})

    return map_arrow(encoded.select("doc_id", ids_col), work, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded string")


def digests(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """What the query returns: the number of ids and the hashes of ids and decoded text."""
    out = round_trip(docs, path=path)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
