"""Operator 3: SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut where no piece of the vocabulary can reach across: before each run of spaces and around characters that no
piece holds. In such a unit, merges wait on an agenda by their rank; each one taken from it is skipped with probability
``dropout``, decided by a keyed hash of the seed, the document's id, the unit's place in it and the merge. So each
occurrence of a unit is cut by draws of its own and a rerun gives the same pieces. A worker remembers of a unit only its cut
without skips and the merges that lead there: where none of these is skipped, that cut holds; else the occurrence is cut anew.
What no piece spells becomes byte pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from copy import copy
from dataclasses import dataclass, field
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, DROPOUT = 5, 0.1
#: Different units that a worker remembers before it starts anew.
CACHE = 150_000
#: Characters and units worked on at once in a worker; longer units are cut one by one.
SLICE, CHUNK, LONG = 500_000, 16_384, 32
WIDTHS = (1, 3, 4, 5, 6, 8, 10, 13, 18, 24, LONG)
SPACE = "▁"
MASK = (1 << 64) - 1


@dataclass
class Vocabulary:
    ids: dict[str, int]  # ordinary pieces
    ranks: dict[str, float]  # their scores: larger merges first
    bytes: list[int]  # byte -> id
    text: list[bytes]  # id -> what it spells, with SPACE as a space
    dummy_prefix: bool
    pairs: np.ndarray  # sorted left id * size + right id of all merges
    merged: np.ndarray  # the ids they give
    alone: str = field(default="")  # characters below 128 that no piece of two or more characters holds

    def unit_pattern(self) -> str:
        cut = re.escape(self.alone)
        return f" *[^ {cut}]+| +|[{cut}]" if cut else " *[^ ]+| +"


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """From a SentencePiece model of merge type with byte pieces and without normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("a merge-type model with byte pieces and identity normalisation is needed")
    ids, ranks, of_byte, text = {}, {}, [0] * 256, []
    for i, p in enumerate(proto.pieces):
        text.append(b"")
        if p.type == 6:  # a byte
            of_byte[int(p.piece[3:5], 16)] = i
            text[i] = bytes([int(p.piece[3:5], 16)])
        elif p.type == 1:
            ids[p.piece], ranks[p.piece] = i, p.score
            text[i] = p.piece.replace(SPACE, " ").encode()
    if any(SPACE in piece.lstrip(SPACE) for piece in ids):
        raise ValueError("pieces that reach over a space are not supported")
    inside = {c for piece in ids if len(piece) > 1 for c in piece}
    alone = "".join(c for c in map(chr, range(128)) if c not in inside and c != " ")
    size = len(text)
    pairs = sorted((a * size + b, i) for piece, i in ids.items() for k in range(1, len(piece)) if (a := ids.get(piece[:k])) is not None and (b := ids.get(piece[k:])) is not None)
    table = np.array(pairs, np.int64).reshape(-1, 2)
    return Vocabulary(ids, ranks, of_byte, text, proto.normalizer_spec.add_dummy_prefix, table[:, 0], table[:, 1], alone)


def mix64(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def seed_key(seed: int) -> int:
    return int.from_bytes(blake2b(digest_size=8, key=seed.to_bytes(8, "little", signed=True)).digest(), "little")


def cut_unit(unit: str, draw: int, vocabulary: Vocabulary, seed: int, dropout: float, steps: list[int] | None = None) -> list[int]:
    """Piece ids of one unit (spaces still as spaces), by a heap. ``draw`` stands for the occurrence; the hashes of the
    merges that are taken are added to ``steps``."""
    # a SPACE of the text itself has no piece of its own and is spelled in bytes
    parts: list[str | None] = [SPACE if c == " " else (c if c != SPACE else "\0" + c) for c in unit]
    n, ranks = len(parts), vocabulary.ranks
    if n > 1:
        key = mix64(seed_key(seed) ^ draw)
        bar = int(dropout * (1 << 64))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            if (rank := ranks.get(parts[i] + parts[i + 1])) is not None:
                agenda.append((-rank, i, i + 1, parts[i] + parts[i + 1]))
        heapify(agenda)
        while agenda:
            _, i, j, merged = heappop(agenda)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != merged:
                continue
            step = mix64(i * 0x9E3779B97F4A7C15 + vocabulary.ids[merged] & MASK)
            if bar and mix64(key ^ step) < bar:
                continue
            if steps is not None:
                steps.append(step)
            parts[i], parts[j] = merged, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(merged + parts[k])) is not None:
                    heappush(agenda, (-rank, i, k, merged + parts[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get(parts[h] + merged)) is not None:
                heappush(agenda, (-rank, h, i, parts[h] + merged))
    out: list[int] = []
    for part in parts:
        if part is None:
            continue
        if (i := vocabulary.ids.get(part)) is not None:
            out.append(i)
        else:
            spelled = SPACE if part == "\0" + SPACE else part
            out += [vocabulary.bytes[b] for b in spelled.encode("utf-8", "surrogatepass")]
    return out


def mix64s(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Cutter:
    """:func:`cut_unit` for many units at once: a row of a matrix is a unit's agenda, and in each round every unit takes
    its best merge."""

    def __init__(self, vocabulary: Vocabulary, seed: int, dropout: float):
        self.vocabulary, self.seed, self.dropout = vocabulary, seed, dropout
        self.size = len(vocabulary.text)
        self.rank = np.full(self.size + 1, np.inf)
        for piece, i in vocabulary.ids.items():
            self.rank[i] = -vocabulary.ranks[piece]
        self.single = np.full(0x110000, -1, np.int32)
        for piece, i in vocabulary.ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.single[ord(piece)] = i
        self.single[ord(" ")] = vocabulary.ids[SPACE]
        # an open table of the merges: place by a multiplicative hash, then the next free one
        bits = max(8, int(len(vocabulary.pairs) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, self.size, np.int32)
        left = np.arange(len(vocabulary.pairs))
        self.probes = 0
        while len(left):
            at = self._place(vocabulary.pairs[left]) + self.probes
            free = self.keys[at] < 0
            self.keys[at[free]] = vocabulary.pairs[left[free]]
            won = self.keys[at] == vocabulary.pairs[left]
            self.values[at[won]] = vocabulary.merged[left[won]]
            left, self.probes = left[~won], self.probes + 1

    def keys_of(self, draws: np.ndarray) -> np.ndarray:
        return mix64s(np.uint64(seed_key(self.seed)) ^ draws.astype(np.uint64))

    def bar(self) -> np.uint64:
        return np.uint64(int(self.dropout * (1 << 64))) if self.dropout < 1 else np.uint64(MASK)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of merged pairs; ``size`` where there is none."""
        key = np.where((a < self.size) & (b < self.size), a.astype(np.int64) * self.size + b, -2)
        out = np.full(key.size, self.size, np.int32)
        todo = np.flatnonzero(key.ravel() >= 0)
        key = key.ravel()[todo]
        at = self._place(key)
        for i in range(self.probes):
            there = self.keys[at + i]
            hit = there == key
            out[todo[hit]] = self.values[at[hit] + i]
            on = ~hit & (there >= 0)
            todo, key, at = todo[on], key[on], at[on]
            if not len(todo):
                break
        return out.reshape(a.shape)

    def plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`cut` without skips, and the hashes of the merges that are taken in a row, and how many each unit has."""
        whole, steps = copy(self), [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        whole.dropout = 0.0
        flat, size = whole.cut(units, np.zeros(len(units), np.uint64), steps)
        owner = np.concatenate([o for o, _ in steps])
        return flat, size, np.concatenate([x for _, x in steps])[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(units))

    def cut(self, units: list[str], draws: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All units' piece ids in a row, and how many each has; a draw stands for a unit's occurrence."""
        count = np.fromiter(map(len, units), np.int64, len(units))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(count > LONG).tolist():
            taken: list[int] = []
            ids = cut_unit(units[i], int(draws[i]), self.vocabulary, self.seed, self.dropout, taken)
            if steps is not None:
                steps.append((np.full(len(taken), i), np.array(taken, np.uint64)))
            parts.append((np.array([i]), np.array([len(ids)]), np.array(ids, np.int32)))
        order = np.argsort(count, kind="stable")
        order = order[count[order] <= LONG]
        widths = np.searchsorted(count[order], WIDTHS, side="right").tolist()  # units of a like width go together
        for some in (order[k : min(k + CHUNK, b)] for a, b in zip([0, *widths], widths) for k in range(a, b, CHUNK)):
            mine: list[tuple[np.ndarray, np.ndarray]] | None = None if steps is None else []
            parts.append((some, *self._together([units[i] for i in some.tolist()], count[some], draws[some], mine)))
            if steps is not None:
                steps += [(some[o], x) for o, x in mine or []]
        size = np.zeros(len(units), np.int64)
        for some, n, _ in parts:
            size[some] = n
        ends = np.cumsum(size)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for some, n, ids in parts:
            flat[np.repeat(ends[some] - n - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, size

    def _together(self, units: list[str], count: np.ndarray, draws: np.ndarray, steps: list | None = None) -> tuple[np.ndarray, np.ndarray]:  # sizes, ids
        n, width, size = len(units), int(count.max()), self.size
        inside = np.arange(width) < count[:, None]
        code = np.zeros((n, width), np.uint32)
        code[inside] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        # what no piece spells is size + 1 + code point; the place of nothing is size
        sym = np.where(inside, np.where(self.single[code] >= 0, self.single[code], code.astype(np.int32) + (size + 1)), size).astype(np.int32)
        pos = np.tile(np.arange(width, dtype=np.int16), (n, 1))
        key, bar = self.keys_of(draws), self.bar()
        if width > 1:
            merged = self.merges(sym[:, :-1], sym[:, 1:])
            live = np.arange(n)
            while len(live):
                m = merged[live]
                rank = self.rank[m]
                best = rank.argmin(axis=1)
                some = rank[np.arange(len(live)), best] < np.inf
                live, best = live[some], best[some]
                if not len(live):
                    break
                to = merged[live, best]
                step = mix64s(pos[live, best].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + to.astype(np.uint64))
                if bar:
                    skip = mix64s(key[live] ^ step) < bar
                    merged[live[skip], best[skip]] = size
                    rows, at, to = live[~skip], best[~skip], to[~skip]
                else:
                    rows, at = live, best
                    if steps is not None:
                        steps.append((live, step))
                if not len(rows):
                    continue
                cols = np.arange(width)
                take = np.minimum(cols + (cols > at[:, None]), width - 1)
                s = np.take_along_axis(sym[rows], take, axis=1)
                s[:, -1] = size
                s[np.arange(len(rows)), at] = to
                p = np.take_along_axis(pos[rows], take, axis=1)
                g = np.take_along_axis(merged[rows], take[:, :-1].clip(max=width - 2), axis=1)
                g[:, -1] = size
                r = np.arange(len(rows))
                right = at < width - 1
                g[r[right], at[right]] = self.merges(s[r[right], at[right]], s[r[right], at[right] + 1])
                before = at > 0
                g[r[before], at[before] - 1] = self.merges(s[r[before], at[before] - 1], s[r[before], at[before]])
                sym[rows], pos[rows], merged[rows] = s, p, g
        there = sym != size
        ids, size_of = sym[there], there.sum(axis=1)
        if (odd := np.flatnonzero(ids > size)).size:
            spelled = {c: [self.vocabulary.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in np.unique(ids[odd] - size - 1).tolist()}
            lens = np.ones(len(ids), np.int64)
            lens[odd] = [len(spelled[c]) for c in (ids[odd] - size - 1).tolist()]
            owner = np.repeat(np.arange(n), size_of)
            size_of = np.bincount(owner, lens, n).astype(np.int64)
            ends = np.cumsum(lens)
            more = np.repeat(ids, lens)
            for e, k, c in zip(ends[odd].tolist(), lens[odd].tolist(), (ids[odd] - size - 1).tolist()):
                more[e - k : e] = spelled[c]
            ids = more
        return size_of, ids


class _Numbers(dict):
    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class Encoder:
    """A worker's view: remembers the units it has cut without skips."""

    def __init__(self, vocabulary: Vocabulary, seed: int = SEED, dropout: float = DROPOUT):
        self.vocabulary, self.seed = vocabulary, seed
        self.cutter = Cutter(vocabulary, seed, dropout)
        self.units = re.compile(vocabulary.unit_pattern()).findall
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.names: list[str] = []
        # of the units' plain cuts and their merges, all in a row: where each unit's begin, and how many it has
        self.pool, self.begin, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.steps, self.first, self.merges = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _draws(self, counts: list[int], keys: list[int]) -> np.ndarray:
        seeds = np.array([mix64((k ^ self.seed * 0xD6E8FEB86659FD93) & MASK) for k in keys], np.uint64)
        ends = np.cumsum(counts)
        place = np.arange(int(ends[-1])) - np.repeat(ends - counts, counts)
        return mix64s(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(seeds, counts))

    def _skipped(self, code: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Places of the occurrences in which a merge of their plain cut is skipped."""
        if not (bar := self.cutter.bar()):
            return np.zeros(0, np.int64)
        n, begin = self.merges[code], self.first[code]
        owner = np.repeat(np.arange(len(code)), n)
        step = self.steps[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(owner))]
        return np.unique(owner[mix64s(self.cutter.keys_of(draws)[owner] ^ step) < bar])

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of whole texts; a key stands for its document."""
        if len(self.numbers) > CACHE:
            self._forget()
        prefix = " " if self.vocabulary.dummy_prefix else ""
        units = [self.units(prefix + t) if t else [] for t in texts]
        counts = [len(u) for u in units]
        if not sum(counts):
            return [np.zeros(0, np.int32) for _ in texts]
        number = self.numbers.__getitem__
        code = np.fromiter(map(number, chain.from_iterable(units)), np.int64, sum(counts))
        if len(self.numbers) > len(self.names):
            new = list(islice(self.numbers, len(self.names), None))
            flat, length, steps, merges = self.cutter.plain(new)
            self.names += new
            self.begin, self.first = np.concatenate([self.begin, len(self.pool) + np.cumsum(length) - length]), np.concatenate([self.first, len(self.steps) + np.cumsum(merges) - merges])
            self.pool, self.length = np.concatenate([self.pool, flat]), np.concatenate([self.length, length])
            self.steps, self.merges = np.concatenate([self.steps, steps]), np.concatenate([self.merges, merges])
        draws = self._draws(counts, keys)
        again = self._skipped(code, draws)
        flat, length = self.cutter.cut([self.names[i] for i in code[again].tolist()], draws[again])
        size, begin = self.length[code], self.begin[code]
        size[again], begin[again] = length, len(self.pool) + np.cumsum(length) - length
        ends = np.cumsum(size)
        at = np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))
        ids, anew = np.empty(len(at), np.int32), at >= len(self.pool)
        ids[anew] = flat[at[anew] - len(self.pool)]
        ids[~anew] = self.pool[at[~anew]]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE characters."""
    first = n = 0
    for i, x in enumerate(lengths.tolist()):
        n += x
        if n >= SLICE:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(lengths):
        yield first, len(lengths)


def decode_ids(ids, vocabulary: Vocabulary) -> str:
    """The text that piece ids spell."""
    raw = b"".join(map(vocabulary.text.__getitem__, ids))
    if vocabulary.dummy_prefix and raw[:1] == b" ":
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
    values = np.concatenate([x for x in ids if x is not None]) if any(x is not None for x in ids) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array([x is None for x in ids]))


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED, dropout: float = DROPOUT, model: str = MODEL, check: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``piece_ids`` (array of int), replacing a column of that name; with ``check`` also ``lossless``:
    whether decoding them gives the text again.

    A null text gives null, an empty one an empty array. Rows that repeat id and text get the same pieces; a null id
    counts as empty. Rows stay as they are; an empty table gives an empty result. ``keep`` names the columns that come back
    (default: all). ``model`` is read on the driver."""
    text, key = F.col(text_col).cast("string"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    base = docs.drop("piece_ids", "lossless") if keep is None else docs.select(*keep)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    keyed = docs.select(*base.columns, text.alias("_text"), key.alias("_key"))

    kept = base.columns

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, seed, dropout)
        for batch in batches:
            texts, keys = batch.column("_text"), batch.column("_key").to_numpy()
            batch = batch.select(kept)
            for a, b in slices(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)):
                some = texts.slice(a, b - a).to_pylist()
                ids = encoder.encode([t or "" for t in some], [k & MASK for k in keys[a:b].tolist()])
                out = _with(batch.slice(a, b - a), "piece_ids", _lists([i if t is not None else None for i, t in zip(ids, some)]))
                if check:
                    out = _with(out, "lossless", pa.array([t is None or decode_ids(i.tolist(), shared.value) == t for i, t in zip(ids, some)]))
                yield out
        del encoder
        give_back()

    schema = T.StructType([*base.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))] + [T.StructField("lossless", T.BooleanType())] * check)
    return keyed.mapInArrow(pieces, schema)


def decode(encoded: DataFrame, ids_col: str = "piece_ids", to: str = "decoded", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text that its pieces spell in column ``to`` (replaced if it is there); null for null."""
    base = encoded.drop(to)
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                yield _with(some, to, pa.array([None if x is None else decode_ids(x, shared.value) for x in some.column(ids_col).to_pylist()], pa.string()))

    return base.mapInArrow(spell, T.StructType([*base.schema.fields, T.StructField(to, T.StringType())]))


def encoded_with_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col``, piece_ids, n_pieces (0 for null) and ``lossless``."""
    done = encode(docs, text_col, id_col, check=True, keep=[id_col], **options)
    return done.select(id_col, "piece_ids", F.greatest(F.coalesce(F.size("piece_ids"), F.lit(0)), F.lit(0)).alias("n_pieces"), "lossless")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`encoded_with_check` of ``documents``: doc_id, piece_ids, n_pieces, lossless."""
    return encoded_with_check(table(spark, sf_dir, "documents"))
