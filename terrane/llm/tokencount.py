"""Token counts of a byte-fallback BPE model by finite-state transduction.

The transducer is that of `transduce`; its transitions carry the change in the count of tokens.

A character that no longer piece contains, and a word start, are borders: the transducer is in its first state again. The map
from entry state to exit state of a chunk with a border is constant after it, so chunk maps compose associatively:
(open head, count, open tail). Long texts are cut into chunks whose maps are composed pairwise, as in a prefix scan's up-sweep.
What stays sequential: a map keeps the open ends as text, which are run again once their neighbour is known; a stretch without
a border (no space, no character outside pieces) is run from its start, symbol by symbol; and the chunks of one text are
composed by one worker. Texts run in parallel, and so do all new segments of a batch, in lockstep through the table.

Nulls are empty; an empty text has no tokens. Repeated rows are counted each; an empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import small_batches, whole
from terrane.llm.packing import tokenizer_path
from terrane.llm.transduce import CELL, MEMORY, STEPS, Machine, portions

SPACE = "▁"
CHUNK = 1 << 16
#: Characters alone between borders; characters inside pieces without a column yet. Those without one, and segments of over STEPS characters, take the slow way.
ALONE, LATER = 255, 254


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does: its part before the first border, the tokens between borders, its part after the last.
    Without a border (count None) all of it is head."""

    head: str
    count: int | None = None
    tail: str = ""


class Transducer(Machine):
    most = 3 * MEMORY // 2

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        inner = {c for p in pieces if len(p) > 1 for c in p} | {SPACE}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece goes over a word start")
        super().__init__(pieces)
        self.inner = inner
        letters = re.escape("".join(sorted(inner - {SPACE})))
        #: A run of word starts with letters after it, letters, or one other character.
        self.segment = re.compile(f"{SPACE}+[{letters}]*|[{letters}]+|.", re.DOTALL)
        self.counts: dict[str, int] = {}
        self.columns: dict[str, int] = {}
        #: For each code of the basic plane: the column of a character inside pieces, ALONE or LATER (none yet); its tokens if alone.
        self.column_of = np.full(1 << 16, ALONE, dtype=np.uint8)
        self.weight_of = np.array([1 if chr(c) in self.score else 1 + (c > 0x7F) + (c > 0x7FF) for c in range(1 << 16)], dtype=np.int8)
        self.column_of[[ord(c) for c in inner if ord(c) < 1 << 16]] = LATER

    def weight(self, token: str) -> int:
        return 1 if token in self.score else len(token.encode())

    def count_segment(self, segment: str) -> int:
        """Tokens between two borders."""
        got = self.counts.get(segment)
        if got is None:
            state, got = 0, 0
            for c in segment:
                state, change = self.remembered(state, c)
                got += change
                if len(self.made) >= 2 * self.most:
                    state = self._restart(state)
            if len(segment) <= STEPS:
                self.counts[segment] = got
        return got

    def _restart(self, state: int) -> int:
        """Cuts the table back but for the state that is open."""
        here = self.made[state]
        self._trim()
        return self._state(here)

    def total(self, text: str) -> int:
        """Tokens of a text that starts and ends at borders."""
        known, segments = self.counts, self.segment.findall(text)
        try:
            return sum(map(known.__getitem__, segments))
        except KeyError:
            return sum(map(self.count_segment, segments))

    def chunk_map(self, text: str) -> ChunkMap:
        if len(self.counts) >= MEMORY:
            self.counts.clear()
        segments = self.segment.findall(text)
        if len(segments) < 2:
            return ChunkMap(text)
        return ChunkMap(segments[0], sum(map(self.count_segment, segments[1:-1])), segments[-1])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a's chunk followed by b's; associative."""
        seam = self.chunk_map((a.head if a.count is None else a.tail) + b.head)
        if a.count is None and b.count is None:
            return seam
        if a.count is None:
            return ChunkMap(seam.head, b.count, b.tail) if seam.count is None else ChunkMap(seam.head, seam.count + self.total(seam.tail) + b.count, b.tail)
        if b.count is None:
            return ChunkMap(a.head, a.count, seam.head) if seam.count is None else ChunkMap(a.head, a.count + self.total(seam.head) + seam.count, seam.tail)
        inside = self.total(seam.head) + (0 if seam.count is None else seam.count + self.total(seam.tail))
        return ChunkMap(a.head, a.count + inside + b.count, b.tail)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= chunk:
            return self.total(text)
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:  # pairwise, as a prefix scan's up-sweep
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.total(maps[0].head) + (0 if maps[0].count is None else maps[0].count + self.total(maps[0].tail))

    def count_all(self, texts: list[str | None], chunk: int = CHUNK) -> list[int]:
        """Tokens of each text. All segments of the texts run through the transition table in lockstep, longest first."""
        if len(self.made) >= self.most:
            self._trim()
        if len(self.counts) >= MEMORY:
            self.counts.clear()
        out = np.zeros(len(texts), dtype=np.int64)
        short = [i for i, t in enumerate(texts) if t and len(t) <= chunk]
        if short:
            out[short] = self.lockstep([SPACE + texts[i].replace(" ", SPACE) for i in short])
        for i, t in enumerate(texts):
            if t and len(t) > chunk:
                out[i] = self.count(t, chunk)
        return out.tolist()

    def lockstep(self, lines: list[str]) -> np.ndarray:
        """Tokens of each line, not empty, between borders."""
        line = "".join(lines)
        codes = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32)
        plane = np.minimum(codes, 0xFFFF)
        columns = self.column_of[plane]
        if (columns == LATER).any():
            for c in np.unique(codes[columns == LATER]).tolist():
                if len(self.columns) < self.width:
                    self.column_of[c] = self.columns[chr(c)] = len(self.columns)
            self.letters = list(self.columns)
            columns = self.column_of[plane]
        high = codes > 0xFFFF
        if high.any():  # a character of another plane is alone, or takes the slow way
            columns[high] = [LATER if chr(c) in self.inner else ALONE for c in codes[high].tolist()]
        alone = columns == ALONE
        space = codes == ord(SPACE)
        begins = alone | space
        begins[1:] &= alone[1:] | ~space[:-1]
        begins[1:] |= alone[:-1]
        first = np.zeros(len(lines), dtype=np.int64)
        np.cumsum([len(x) for x in lines[:-1]], out=first[1:])
        begins[first] = True
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(codes)))
        count = np.zeros(len(start), dtype=np.int64)
        single = alone[start]
        count[single] = self.weight_of[plane[start[single]]]
        if high.any():
            for i in np.flatnonzero(single & high[start]).tolist():
                count[i] = self.weight(line[start[i]])
        slow = (np.maximum.reduceat(np.where(alone, 0, columns), start) == LATER) | (size > STEPS)
        for i in np.flatnonzero(slow & ~single).tolist():
            count[i] = self.count_segment(line[start[i] : start[i] + size[i]])
        run = np.flatnonzero(~slow & ~single)
        run = run[np.argsort(-size[run].astype(np.int16), kind="stable")]
        at, length = start[run], size[run]
        state, tokens = np.zeros(len(run), dtype=np.int64), np.zeros(len(run), dtype=np.int32)
        alive = len(run) - np.searchsorted(length[::-1], np.arange(STEPS + 1), side="right")
        for k in range(STEPS):
            m = int(alive[k])
            if not m:
                break
            flat = state[:m] * self.width + columns[at[:m] + k]
            cells = self._known(flat)
            state[:m] = cells // CELL - 1
            tokens[:m] += cells % CELL - CELL // 2
        count[run] = tokens
        return np.add.reduceat(count, np.searchsorted(start, first))


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def tokens_of(text: Column, path: str | None = None) -> Column:
    path = path or tokenizer_path("piece_bpe_32k.model")

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([n for part in portions(texts.to_pylist()) for n in machine(path).count_all(part)], type=pa.int64())

    return of(whole(text))


def counted(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.octet_length(whole(F.col("text"))).cast("long").alias("n_bytes"), tokens_of(F.col("text"), path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
