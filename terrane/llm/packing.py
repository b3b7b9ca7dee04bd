"""Best-fit decreasing packing of tokenized documents into sequences of a fixed capacity.

Documents are tokenized once, on the executors; what goes on is a small row per piece. Lengths are integers up to the
capacity, so best-fit decreasing over all pieces of the corpus is decided from the count of each length alone:
pieces of one length are interchangeable, and open bins with the same room are too. The driver walks the lengths
downwards; a segment tree over remaining capacities finds the tightest room that holds a piece in logarithmic time.
Its placements are runs ("pieces a to b of length L go to sequences s onwards, q in each"). A run's room falls by half
or more each time it is used, and a length adds four runs at most, so there are fewer than 8 * capacity * log2(capacity).
Each piece then finds its place by its number among the pieces of its length.

Nulls: a null text is an empty one and becomes the end token alone. Repeated rows are packed each."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.numbering import HASH_BITS, numbered
from terrane.llm.common import saved, small_batches, whole
from terrane.llm.transduce import CELL, MEMORY, NONE, STEPS, Machine, portions

CAPACITY, END = 2048, b"\0\0\0\0"
FINAL, UNKNOWN = 256, 1 << 20
#: Bytes of slow chunks and their ids that a worker remembers, and of the longest such chunk (an entry counts ENTRY bytes more).
REMEMBERED, LONGEST, ENTRY = 1 << 24, 256, 160
_encoders: dict[str, Words] = {}
BLANK, LETTER, DIGIT, OTHER, UNSURE = range(5)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(Machine):
    """Ids of texts by a lower-casing byte-pair tokenizer with word ends.

    White space parts a text into chunks, and what the pre-tokenizer makes of a chunk depends on the chunk alone. Chunks of ASCII
    and Latin-1 letters, digits and plain signs are cut into words here and all words of a batch run through the
    transition table together; going back from each end by the lengths of last tokens gives the ids. Any other chunk
    (other scripts, quotes, angle brackets, controls) is encoded by the library and remembered."""

    most = MEMORY

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
        end = model["end_of_word_suffix"]

        def symbols(token: str) -> str:
            """A character for each byte; the byte that ends a word has one of its own."""
            raw = [shown[c] for c in token.removesuffix(end)]
            return "".join(map(chr, raw[:-1])) + chr(raw[-1] + FINAL * token.endswith(end)) if raw else ""

        self.ids = {symbols(t): i for t, i in model["vocab"].items()}
        self.rules = {(symbols(a), symbols(b)): -k for k, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
        super().__init__(dict.fromkeys(self.ids, 0.0))
        self.memory: dict[bytes, bytes] = {}
        self.held = 0
        self.columns = np.full(2 * FINAL, UNKNOWN, dtype=np.int32)
        self.kind = np.full(256, UNSURE, dtype=np.uint8)
        self.kind[33:127] = OTHER
        self.kind[[9, 10, 11, 12, 13, 32]] = BLANK
        self.kind[48:58] = DIGIT
        self.kind[[*range(65, 91), *range(97, 123)]] = LETTER
        self.kind[[ord("'"), ord("<")]] = UNSURE

    def rank(self, a: str, b: str) -> float:
        return self.rules.get((a, b), NONE)

    def weight(self, token: str) -> int:
        """Ids need no counts: states that differ in them alone are one."""
        return 0

    def _reset(self) -> None:
        super()._reset()
        self.last_id, self.last_size = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def _trim(self) -> None:
        super()._trim()
        self.last_id, self.last_size = self.last_id[: len(self.made)], self.last_size[: len(self.made)]

    def _tokens(self) -> None:
        """The last token of each state."""
        new = [self.made[k][1][-1] for k in range(len(self.last_id), len(self.made))]
        if new:
            self.last_id = np.append(self.last_id, np.array([self.ids.get(t, 0) for t in new], dtype=np.uint32))
            self.last_size = np.append(self.last_size, np.array([len(t) for t in new], dtype=np.int64))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers, the end token last."""
        if len(self.made) >= self.most:
            self._trim()
        raws = [(t or "").encode() for t in texts]
        line = b"\n".join(raws) + b"\n"
        b = np.frombuffer(line, dtype=np.uint8).copy()
        kind = self.kind[b]
        b[(b >= 65) & (b <= 90)] += 32
        after = np.flatnonzero(b[:-1] == 0xC3) + 1  # Latin-1 letters are this lead byte and one more
        second = b[after]
        letters = after[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
        kind[letters] = kind[letters - 1] = LETTER
        upper = letters[b[letters] <= 0x9E]
        b[upper] += 32
        blank = kind == BLANK
        starts_chunk = ~blank
        starts_chunk[1:] &= blank[:-1]
        chunk = np.flatnonzero(starts_chunk)
        begin = ~blank
        begin[1:] &= blank[:-1] | (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        unsure = np.unique(np.searchsorted(chunk, np.flatnonzero(kind == UNSURE), side="right") - 1)
        slow_start = chunk[unsure]
        if len(unsure):
            stop = np.flatnonzero(blank)
            slow_stop = stop[np.searchsorted(stop, slow_start)]
            inside = np.zeros(len(b) + 1, dtype=np.int32)
            np.add.at(inside, slow_start, 1)
            np.add.at(inside, slow_stop, -1)
            begin &= ~np.cumsum(inside)[:-1].astype(bool)
            begin[slow_start] = True
        finish = ~blank
        finish[:-1] &= blank[1:] | begin[1:]
        start, last = np.flatnonzero(begin), np.flatnonzero(finish)
        size = last - start + 1
        slow = size > STEPS
        slow[np.searchsorted(start, slow_start)] = True
        # columns of bytes, those that end a word apart
        code = b.astype(np.int32)
        code[last] += FINAL
        column = self.columns[code]
        if (column == UNKNOWN).any():
            for c in np.unique(code[column == UNKNOWN]).tolist():
                if len(self.letters) < self.width:
                    self.columns[c] = len(self.letters)
                    self.letters.append(chr(c))
            column = self.columns[code]
            if (column == UNKNOWN).any():
                slow |= np.maximum.reduceat(column, start)[: len(start)] == UNKNOWN if len(start) else slow
        count = np.zeros(len(start), dtype=np.int64)
        run = np.flatnonzero(~slow)
        run = run[np.argsort(-size[run].astype(np.int16), kind="stable")]
        at, length = start[run], size[run]
        state, track = np.zeros(len(run), dtype=np.int64), np.zeros(len(b), dtype=np.int32)
        alive = len(run) - np.searchsorted(length[::-1], np.arange(STEPS + 1), side="right")
        for k in range(STEPS):
            m = int(alive[k])
            if not m:
                break
            state[:m] = self._known(state[:m] * self.width + column[at[:m] + k]) // CELL - 1
            track[at[:m] + k] = state[:m]
        self._tokens()
        # from each word's end backwards
        taken, where, which = [], last[run], np.arange(len(run))
        while len(which):
            s = track[where]
            taken.append((run[which], self.last_id[s]))
            where = where - self.last_size[s]
            go = where >= at[which]
            where, which = where[go], which[go]
        for word, _ in taken:
            count[word] += 1
        found = self._remembered(line, start, size, np.flatnonzero(slow))
        for k, ids in found:
            count[k] = len(ids) // 4
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), dtype="<u4")
        for back, (word, ids) in enumerate(taken):
            out[first[word] + count[word] - 1 - back] = ids
        for k, ids in found:
            out[first[k] : first[k] + count[k]] = np.frombuffer(ids, dtype="<u4")
        edges = np.zeros(len(raws) + 1, dtype=np.int64)
        np.cumsum([len(r) + 1 for r in raws], out=edges[1:])
        ends = np.append(first, len(out))[np.searchsorted(start, edges)]
        return [out[i:j].tobytes() + END for i, j in zip(ends, ends[1:], strict=False)]

    def _remembered(self, line: bytes, start: np.ndarray, size: np.ndarray, slow: np.ndarray) -> list[tuple[int, bytes]]:
        memory = self.memory
        if self.held > REMEMBERED:
            memory.clear()
            self.held = 0
        chunks = [line[a : a + n] for a, n in zip(start[slow].tolist(), size[slow].tolist(), strict=True)]
        new = list({c for c in chunks if c not in memory})
        for c, e in zip(new, self.tokenizer.encode_batch_fast([c.decode() for c in new], add_special_tokens=False), strict=True):
            memory[c] = np.array(e.ids, dtype="<u4").tobytes()
        out = [(k, memory[c]) for k, c in zip(slow.tolist(), chunks, strict=True)]
        for c in new:
            if len(c) > LONGEST:
                del memory[c]
            else:
                self.held += len(c) + len(memory[c]) + ENTRY
        return out


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    if path not in _encoders:
        _encoders[path] = Words(path)
    return [ids for part in portions(texts) for ids in _encoders[path].encode(part)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(token_bytes(b.column(1).to_pylist(), path)):
                n = len(ids) // 4
                for p, s in enumerate(range(0, n, capacity)):
                    part = ids[4 * s : 4 * (s + capacity)]
                    row.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", whole(F.col("text")).alias("text")).mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


class Rooms:
    """Segment tree over remaining capacities: which rooms have open bins."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, room: int) -> None:
        k = room + self.size
        self.any[k] = bool(self.runs[room])
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least `least` with an open bin."""
        k = least + self.size
        if not self.any[k]:
            while k > 1 and (k & 1 or not self.any[k + 1]):
                k //= 2
            if k == 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first number, first sequence, per sequence, offset), by length and number."""
    rooms, used, out = Rooms(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        while left:
            room = rooms.tightest(length)
            fresh = room is None
            if fresh:
                room, first = capacity, used
                count = -(-left // (room // length))
                used += count
            else:
                first, count = rooms.take(room)
            each = room // length
            bins = min(count, -(-left // each))
            out.append((length, number, first, each, capacity - room))
            placed = min(left, bins * each)
            full = placed // each
            rooms.put(room - each * length, first, full)
            if full < bins:
                rooms.put(room - (placed - full * each) * length, first + full, 1)
            rooms.put(room, first + bins, count - bins)
            number += placed
            left -= placed
    return np.array(out, dtype=np.int64).reshape(-1, 5)[::-1][np.argsort(np.array([(r[0] << 44) + r[1] for r in out[::-1]], dtype=np.int64), kind="stable")] if out else np.zeros((0, 5), dtype=np.int64)


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    rows = saved(rows)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    runs = plan(counts, capacity)
    # pieces of one id are dealt apart by their number in the saved table, which doesn't change when it is read again
    hashed = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    ranked = numbered(rows.withColumn("hash_", hashed), "length", "hash_", ["doc_id", "piece", "ids_crc32"], sum(counts.values()), "number_")
    keys, kind = (runs[:, 0] << 44) + runs[:, 1], rows.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            run = runs[np.searchsorted(keys, (length << 44) + number, side="right") - 1]
            k = number - run[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(run[:, 2] + k // run[:, 3]), pa.array(run[:, 4] + k % run[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "number_").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return packed(pieces(docs, path or tokenizer_path("word_bpe_49k.json"), capacity), capacity)
