"""Byte-level BPE encoding and decoding.

Texts are cut by the tokenizer's pattern into pieces. The distinct pieces of the
whole table are encoded once each, by Spark higher-order functions: a fold over
the piece's bytes merges the adjacent pair of lowest rank, leftmost first, until
no pair has a rank. Ids are ranks, so the map from a pair of ids to the rank of
their union holds all that the fold needs; it is a literal, laid out as a cuckoo
hash table of two arrays. Decoding concatenates the ids' binary
pieces, from a literal array.

The distinct pieces of a table without bound can't be broadcast, and texts need not be shuffled to meet
them. So a first pass counts in how many places each piece occurs; of those that occur in more than one, the
commonest, ``COMMON`` at most, are folded once and broadcast. A second pass writes texts as ids, with references to the
pieces that are neither in the vocabulary nor common; each task folds those of its own once, by the same higher-order
functions, and puts their ids in place of the references. What is common changes the work only, never the result,
and no size takes another plan.

The fold of a piece of n bytes works on arrays of n in n steps. Pieces of over ``LONG`` bytes (a run of letters without
a break) are therefore merged with a heap in the task that holds them, with the same result.

Defined results: a null text is encoded as an empty one, with no ids; repeated
rows are encoded alike; an empty table gives an empty result; other columns, of any type, pass
through untouched. Session options are set for these plans: rows and bytes of an Arrow batch, and lowered, the length of plan
descriptions and the fields that they name, which would hold the literals.
"""

from __future__ import annotations

import base64
import contextlib
import copy
import ctypes
import gc
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import small_batches, staged

#: Pieces that are folded once for the whole table and broadcast, at most: about 28 bytes each when packed.
COMMON = 1 << 20
#: Bytes of a piece beyond which merges are kept in a heap.
LONG = 400
#: Units that a task of the first pass remembers, references that one of the second numbers, and bytes of text that it codes at a time.
_MEMO, _REFERENCES, _GROUP = 800_000, 300_000, 2_000_000
_MARKS = frozenset(".,;:!?")
_NO_RANK, _EMPTY, _EDGE = 1 << 16, 1 << 60, (1 << 16) - 1


def _prime(least: int) -> int:
    """The smallest prime from ``least`` on (3 at least)."""
    n = max(3, least) | 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


class Vocabulary:
    """Ranks of a tiktoken file and the pattern that cuts texts before merging."""

    def __init__(self, path: str, pattern: str):
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        if sorted(self.ranks.values()) != list(range(len(self.ranks))) or len(self.ranks) >= 2**16:
            raise ValueError("ranks must number from 0 without gaps, 65,535 at most")
        self.pattern = pattern
        self.pieces = sorted(self.ranks, key=self.ranks.get)
        pairs = {}
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b << 16] = rank
        self._sizes, *tables = self._cuckoo(pairs)
        first = [self.ranks[bytes([i])] for i in range(256)] + [_EDGE]
        self._tables = [*tables, json.dumps([pairs.get(a << 32 | b << 16, _NO_RANK) << 40 | a for a in first for b in first])]
        self._latin = json.dumps([p.decode("latin-1") for p in self.pieces])

    @staticmethod
    def _cuckoo(pairs: dict[int, int]) -> tuple[tuple[int, int], str, str]:
        """Two tables of prime sizes; a key (its low 16 bits are 0) is at key mod size in one of them, as key + rank."""
        first = _prime(3 * len(pairs) // 2)
        sizes = (first, _prime(first + 1))
        tables = [[_EMPTY] * n for n in sizes]
        for key, rank in pairs.items():
            entry, side = key | rank, 0
            for _ in range(2000):
                at = (entry & ~0xFFFF) % sizes[side]
                entry, tables[side][at] = tables[side][at], entry
                if entry == _EMPTY:
                    break
                side = 1 - side
            else:
                raise ValueError("the pairs don't fit")
        return sizes, json.dumps(tables[0]), json.dumps(tables[1])

    def _literals(self, body) -> Column:  # noqa: ANN001
        """``body`` of the two tables and the table of byte pairs, each a foldable array."""
        one, two, start = (F.from_json(F.lit(text), "array<bigint>") for text in self._tables)
        return _let(one, lambda x: _let(two, lambda y: _let(start, lambda z: body((x, y), z))))

    def pair_rank(self, tables: tuple[Column, Column], a: Column, b: Column) -> Column:
        """Rank of the union of two ids, given as a * 2 ** 32 and b * 2 ** 16; ``_NO_RANK`` if it has none.

        An entry less its own key leaves the rank; less another key, something of 2 ** 16 or more.
        """

        def look(key: Column) -> Column:
            found = (table[key % size].bitwiseXOR(key) for table, size in zip(tables, self._sizes, strict=True))
            return F.least(*found, F.lit(_NO_RANK))

        return _let(a + b, look)

    def encode(self, piece: Column) -> Column:
        """Ids of one piece (a string column) as array<int>."""
        return self._literals(lambda tables, start: self._encode(tables, start, piece))

    def encode_all(self, pieces: str, choose) -> Column:  # noqa: ANN001
        """``choose(piece, its ids)`` for each of an array of pieces."""
        return self._literals(lambda tables, start: F.transform(F.col(pieces), lambda p: choose(p, self._encode(tables, start, p))))

    def plain(self) -> "Vocabulary":
        """A copy without the fold's literals, to send to tasks."""
        out = copy.copy(self)
        out._tables, out._latin = [], ""
        return out

    def _encode(self, tables: tuple[Column, Column], starts: Column, piece: Column) -> Column:
        """The state is one array of longs: rank of the pair with the next part, start of the part, its id.

        Its least element is so the leftmost pair of lowest rank.
        """
        chars = F.split(F.decode(piece.cast("binary"), "ISO-8859-1"), "")
        edge = F.array(F.lit(256))  # before and after all parts, in no pair
        codes = F.concat(edge, F.transform(chars, F.ascii), edge)

        def id_of(x: Column) -> Column:
            return x.bitwiseAND(F.lit(0xFFFF))

        def start(codes: Column) -> Column:
            return F.transform(codes, lambda c, i: starts[c * 257 + F.coalesce(F.get(codes, i + 1), F.lit(256))] + F.shiftleft(i.cast("bigint"), 16))

        def step(acc: Column, _: Column) -> Column:
            return _let(F.array_min(acc), lambda least: F.when(least >= _NO_RANK << 40, acc).otherwise(_let(F.array_position(acc, least).cast("int"), lambda at: merge(acc, least, at))))

        def merge(acc: Column, least: Column, at: Column) -> Column:
            new, before = F.shiftright(least, 40), acc[at - 2]
            left = F.shiftleft(self.pair_rank(tables, F.shiftleft(id_of(before), 32), F.shiftleft(new, 16)), 40) + before.bitwiseAND(F.lit((1 << 40) - 1))
            joined = F.shiftleft(self.pair_rank(tables, F.shiftleft(new, 32), F.shiftleft(id_of(acc[at + 1]), 16)), 40) + least.bitwiseAND(F.lit(0xFFFFFF0000)) + new
            return F.flatten(F.array(F.slice(acc, F.lit(1), at - 2), F.array(left, joined), F.slice(acc, at + 2, F.size(acc))))

        def folded(state: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(state) - 3, F.lit(1))), state, step)

        return _let(_let(_let(codes, start), folded), lambda x: F.transform(F.slice(x, F.lit(2), F.size(x) - 2), lambda y: id_of(y).cast("int")))

    def decode(self, ids: Column) -> Column:
        """The bytes of an array<int> of ids: its binary pieces, as strings of one character a byte, put together."""
        table = F.from_json(F.lit(self._latin), "array<string>")
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1")

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece by merges kept in a heap, for long ones."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        ends = list(range(1, len(piece) + 1))  # of the part that starts here
        before = list(range(-1, len(piece) - 1))
        dead = bytearray(len(piece) + 1)

        def pair(at: int) -> None:
            middle = ends[at]
            if middle < len(piece):
                rank = self.ranks.get(piece[at : ends[middle]])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, middle, ends[middle]))

        heap: list[tuple[int, int, int, int]] = []
        for at in range(len(piece) - 1):
            pair(at)
        while heap:
            _, at, middle, end = heapq.heappop(heap)
            if dead[at] or dead[middle] or ends[at] != middle or ends[middle] != end:
                continue
            dead[middle], ends[at] = 1, end
            if end < len(piece):
                before[end] = at
            pair(at)
            if before[at] >= 0:
                pair(before[at])
        out, at = [], 0
        while at < len(piece):
            out.append(self.ranks[piece[at : ends[at]]])
            at = ends[at]
        return out


@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """No cyclic garbage collection meanwhile: many small lists would be scanned again and again, and none form cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """Return freed memory to the system at the end of a task: a worker that waits for another would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no malloc_trim in this C library
        ctypes.CDLL(None).malloc_trim(0)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(starts - (ends - sizes), sizes)
    return out


def _strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.large_string())


class _Cutter:
    """Cuts texts into units that the pattern never joins: a space before a non-space opens a piece.

    A unit stands for itself after a space; the first of a text that opens without one is marked by NUL. A text that
    holds NUL, or a space before white space or at its end, is cut by the pattern alone, into pieces marked by NUL and a space.
    """

    #: White space by Python's rule is a superset of the pattern's.
    ODD = r"\x00| (?:[\t-\r\x1c-\x1f\x{85}\p{Z}]|\z)"

    def __init__(self, pattern: str):
        self.cut = regex.compile(pattern)

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Units of each text (their number), which they are, text by text, and the distinct ones."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        opened = pc.starts_with(plain, " ")
        whole = pc.if_else(opened, pc.utf8_slice_codeunits(plain, 1), pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), plain, pa.scalar("", pa.large_string())))
        split = pc.split_pattern(whole, " ")
        pieces = [["\0 " + x for x in self.cut.findall(text)] for text in texts.filter(pa.array(odd)).to_pylist()]
        found = pa.concat_arrays([split.flatten(), _strings([x for own in pieces for x in own])]).dictionary_encode()
        numbers, sizes = found.indices.to_numpy(), np.zeros(len(texts), dtype=np.int64)
        sizes[~odd] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        sizes[odd] = [len(own) for own in pieces]
        if odd.any():  # back into the order of texts
            starts = np.zeros(len(texts), dtype=np.int64)
            for part, before in ((~odd, 0), (odd, sizes[~odd].sum())):
                starts[part] = before + np.cumsum(sizes[part]) - sizes[part]
            numbers = numbers[_ranges(starts, sizes)]
        return sizes, numbers, found.dictionary.to_numpy(zero_copy_only=False).tolist()

    def pieces(self, unit: str) -> list[str]:
        if unit.isalpha():  # letters alone, or with one mark: the pattern's commonest cases
            return [" " + unit]
        if unit[-1:] in _MARKS and unit[:-1].isalpha():
            return [" " + unit[:-1], unit[-1]]
        if unit[:1] != "\0":
            return self.cut.findall(" " + unit)
        return [unit[2:]] if unit[1:2] == " " else self.cut.findall(unit[1:])


def piece_counts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """piece, n: the distinct pieces of all texts, and in how many places (tasks, mostly) each was met."""
    pattern = vocabulary.pattern

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(pattern)
        seen: set = set()
        gone: set = set()
        for batch in batches:
            with _uncollected():
                _, _, found = cutter.units(batch.column(0))
                fresh = [unit for unit in found if unit not in seen]
                seen.update(fresh)
                new = {piece for unit in fresh for piece in cutter.pieces(unit)} - gone
                gone |= new
            if len(seen) > _MEMO:
                seen.clear()
            if len(gone) > _MEMO:
                gone.clear()
            pieces = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([pieces.filter(pc.less_equal(pc.binary_length(pieces), LONG))], names=["piece"])
        del seen, gone
        give_back()

    return docs.select(F.col(text).alias("text")).mapInArrow(cut, "piece string").groupBy("piece").agg(F.count("*").alias("n"))


class _Packed:
    """Ids of pieces, found by 96 bits of hashes: XXH64 and CRC-32."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.checks, self.sizes = hashes[order], checks[order], sizes[order]
        ends = np.cumsum(sizes, dtype=np.int64)
        self.starts, self.ids = (ends - sizes)[order].astype(np.uint32), ids

    def find(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the table each piece is, and whether it is there."""
        if not len(self.hashes) or not pieces:
            return np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=bool)
        digest = xxhash.xxh64_intdigest
        wanted = np.array([digest(p, 42) for p in pieces], dtype=np.uint64)
        checks = np.fromiter(map(crc32, pieces), dtype=np.uint32, count=len(pieces))
        order = np.argsort(wanted)  # sorted needles stay near each other in a large table
        at = np.empty(len(wanted), dtype=np.int64)
        at[order] = np.searchsorted(self.hashes, wanted[order])
        at[at == len(self.hashes)] = 0
        return at, (self.hashes[at] == wanted) & (self.checks[at] == checks)


def _packed(pieces: DataFrame) -> _Packed:
    """A table of pieces and ids, ``COMMON`` rows at most, packed by the tasks and gathered on the driver part by part."""
    two_bytes = F.transform("ids", lambda i: F.substr(F.hex(i.cast("long") + 65536), F.lit(2)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = np.array([len(x) // 2 for x in batch["ids"]], dtype="<u4")
            whole = (batch["h"].to_numpy().astype("<i8").tobytes(), batch["c"].to_numpy().astype("<u4").tobytes(), sizes.tobytes(), b"".join(batch["ids"]))
            yield pd.DataFrame([whole], columns=["h", "c", "sizes", "ids"])

    rows = pieces.select(F.xxhash64("piece").alias("h"), F.crc32(F.col("piece").cast("binary")).alias("c"), F.unhex(F.array_join(two_bytes, "")).alias("ids"))
    parts = [bytearray() for _ in range(4)]
    for row in rows.mapInPandas(pack, "h binary, c binary, sizes binary, ids binary").toLocalIterator():
        for part, more in zip(parts, row, strict=True):
            part += more
    return _Packed(*(np.frombuffer(bytes(part), dtype=kind) for part, kind in zip(parts, ("<u8", "<u4", "<u4", ">u2"), strict=True)))


def common_pieces(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", most: int = COMMON) -> _Packed:
    """The commonest pieces of several bytes that occur in more than one place, ``most`` at most, folded."""
    counts = staged(piece_counts(docs, vocabulary, text).where("n > 1"), "pieces")
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(58 + F.floor(F.log2("n"))).cast("int")
    held, least = 0, 128
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect(), reverse=True):
        held += r["c"]
        if held > most:
            break
        least = r["level"]
    chosen = counts.where(level >= least)
    return _packed(staged(chosen.select("piece", vocabulary.encode(F.col("piece")).alias("ids")), "folded"))


class _Coder:
    """Writes texts as 32-bit codes: ids, and from 65,536 on references to pieces that are still to be folded."""

    def __init__(self, vocabulary: Vocabulary, table: _Packed):
        self.cutter, self.table, self.ranks = _Cutter(vocabulary.pattern), table, vocabulary.ranks
        self.sent: dict[bytes, int] = {}

    def code(self, texts: pa.Array) -> pa.Array:
        """codes, new pieces, whether references start anew: of each text; a reference is to a piece of its own or of an earlier text."""
        bulk = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // _GROUP
        edges = [0, *(np.flatnonzero(np.diff(bulk)) + 1).tolist(), len(texts)]
        return pa.concat_arrays([self._group(texts[a:b]) for a, b in zip(edges, edges[1:], strict=False)])

    def _group(self, texts: pa.Array) -> pa.Array:
        reset = len(self.sent) > _REFERENCES
        if reset:
            self.sent.clear()
        counts, numbers, units = self.cutter.units(texts)
        cut = list(map(self.cutter.pieces, units))
        places: dict[str, int] = {}
        held = np.array([places.setdefault(p, len(places)) for own in cut for p in own], dtype=np.int64)
        ends = np.cumsum([0, *map(len, cut)])
        flat, starts, sizes, new = self._codes([p.encode() for p in places])
        # of pieces, then of units, then of texts
        flat, ends = flat[_ranges(starts[held], sizes[held])], np.append(0, np.cumsum(sizes[held]))[ends]
        starts, sizes = ends[:-1], np.diff(ends)
        flat = flat[_ranges(starts[numbers], sizes[numbers])]
        ends = np.append(0, np.cumsum(sizes[numbers]))[np.append(0, np.cumsum(counts))]
        buffers = [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))]
        codes = pa.Array.from_buffers(pa.binary(), len(texts), buffers)
        first = [True] + [False] * (len(texts) - 1) if len(texts) else []
        lists = pa.array([new if x else [] for x in first], pa.list_(pa.string()))
        return pa.StructArray.from_arrays([codes, lists, pa.array([x and reset for x in first], pa.bool_())], names=["codes", "new", "reset"])

    def _codes(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Codes of distinct pieces, where those of each start and how many they are; pieces that got a reference now."""
        own = np.array([self.ranks.get(p, -1) for p in pieces], dtype=np.int64)
        sizes = np.ones(len(pieces), dtype=np.int64)
        others = np.flatnonzero(own < 0)
        at, common = self.table.find([pieces[i] for i in others.tolist()])
        sizes[others[common]] = self.table.sizes[at[common]]
        new: list[str] = []
        for i in others[~common].tolist():
            number = self.sent.get(pieces[i])
            if number is None:
                number = self.sent[pieces[i]] = len(self.sent)
                new.append(pieces[i].decode())
            own[i] = 65536 + number
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(sizes.sum(), dtype=np.uint32)
        single = own >= 0
        flat[starts[single]] = own[single]
        to, given = others[common], at[common]
        flat[_ranges(starts[to], sizes[to])] = self.table.ids[_ranges(self.table.starts[given].astype(np.int64), sizes[to])]
        return flat, starts, sizes, new


def _numbers(cell: pa.ListScalar) -> np.ndarray:
    """The numbers of a cell of an array<int> column."""
    return cell.values.to_numpy(zero_copy_only=False)


class _Filler:
    """Puts the ids of folded pieces in place of references; takes rows in the order in which ``_Coder`` gave them."""

    def __init__(self, vocabulary: Callable[[], Vocabulary]):
        self.vocabulary = vocabulary  # loaded only where a long piece is met
        self._start()

    def _start(self) -> None:
        self.n = self.used = 0
        self.starts, self.sizes = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.uint32)

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), dtype=x.dtype)])

    def take(self, new: list[str], sizes: np.ndarray, flat: np.ndarray, reset: bool) -> None:
        if reset:
            self._start()
        if not len(new):
            return
        sizes, flat = sizes.astype(np.int64), flat.astype(np.uint32)
        if (sizes == 0).any():  # long pieces, not folded
            parts, at = [], 0
            for i, n in enumerate(sizes.tolist()):
                part = flat[at : at + n] if n else np.array(self.vocabulary().merged(new[i].encode()), dtype=np.uint32)
                parts.append(part)
                sizes[i] = len(part)
                at += n
            flat = np.concatenate(parts)
        self.starts, self.sizes = self._room(self.starts, self.n + len(sizes)), self._room(self.sizes, self.n + len(sizes))
        self.flat = self._room(self.flat, self.used + len(flat))
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(sizes), self.used + len(flat)

    def fill(self, codes: bytes | pa.Buffer) -> np.ndarray:
        """All ids of a text."""
        given = np.frombuffer(codes, dtype="<u4")
        at = np.flatnonzero(given >= 65536)
        if not len(at):
            return given
        refs = given[at].astype(np.int64) - 65536
        if refs.max() >= self.n:
            raise ValueError("a reference came before its piece")
        lengths = np.ones(len(given), dtype=np.int64)
        lengths[at] = sizes = self.sizes[refs]
        out = np.repeat(given, lengths)
        to = np.repeat((np.cumsum(lengths) - lengths)[at], sizes)
        step = np.arange(len(to)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[to + step] = self.flat[np.repeat(self.starts[refs], sizes) + step]
        return out


def with_ids(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", name: str = "ids", most: int = COMMON) -> DataFrame:
    """``docs`` with a struct ``name``: ids (array<int>) of the whole text, and their SHA-256 as little-endian 32-bit integers.

    The two functions of a task pass its rows on in order and share the numbering of references. They take and give Arrow
    arrays: a pandas function would make an object of each id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # the literals would otherwise stand whole in each plan's description and in its nodes', which the driver keeps
    spark.conf.set("spark.sql.maxPlanStringLength", "100000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "0")
    plain = spark.sparkContext.broadcast(vocabulary.plain())
    common = spark.sparkContext.broadcast(common_pieces(docs, vocabulary, text, most))

    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _Coder(plain.value, common.value)
        for texts in batches:
            with _uncollected():
                yield coder.code(texts)
        del coder
        give_back()

    def fill(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        filler = _Filler(lambda: plain.value)
        for codes, new, resets, sizes, flat in batches:
            ids, digests = [], []
            with _uncollected():
                for i, reset in enumerate(resets.to_pylist()):
                    if reset or len(new[i]):
                        filler.take(new[i].as_py(), _numbers(sizes[i]), _numbers(flat[i]), reset)
                    ids.append(filler.fill(codes[i].as_buffer()))
                    digests.append(hashlib.sha256(ids[-1]).hexdigest())
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint32), *ids]).view(np.int32)))
            yield pa.StructArray.from_arrays([lists, pa.array(digests, pa.string())], names=["ids", "sha256"])
        del filler
        give_back()

    coded = F.arrow_udf(code, "codes binary, new array<string>, reset boolean").asNondeterministic()
    filled = F.arrow_udf(fill, "ids array<int>, sha256 string").asNondeterministic()
    none = F.array().cast("array<int>")
    folded = vocabulary.encode_all("_quill_code.new", lambda p, ids: F.when(F.octet_length(p) > LONG, none).otherwise(ids))
    step = docs.withColumn("_quill_code", coded(F.col(text))).withColumn("_quill_ids", folded)
    sizes = F.transform("_quill_ids", F.size)
    out = step.withColumn(name, filled("_quill_code.codes", "_quill_code.new", "_quill_code.reset", sizes, F.flatten("_quill_ids")))
    return out.drop("_quill_code", "_quill_ids")


def with_tokens(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", name: str = "tokens", most: int = COMMON) -> DataFrame:
    """``docs`` with a struct ``name``: n_tokens, SHA-256 of the ids as little-endian 32-bit integers, SHA-256 of the bytes that they decode to."""
    coded = with_ids(docs, vocabulary, text, "_quill_tokens", most)
    ids = F.col("_quill_tokens.ids")
    tokens = F.struct(F.size(ids).cast("long").alias("n_tokens"), F.col("_quill_tokens.sha256").alias("ids_sha256"), F.sha2(vocabulary.decode(ids), 256).alias("decoded_sha256"))
    return coded.withColumn(name, tokens).drop("_quill_tokens")
