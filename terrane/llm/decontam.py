"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Training words stream through the automaton, which keeps the longest match that ends at each word. A match of
WINDOW words or more covers windows of an item; an item shorter than a window must occur whole.

Items are read in blocks of BLOCK_WORDS words, one automaton each. The driver builds one at a time and leaves it on disk for
the executors; a worker holds one at a time, and runs SCANNED bytes of text past it before it loads the next. A longer item is cut
into pieces that overlap by a window less a word, so that no window is lost. Memory is thus bounded whatever the size of the
benchmark; time and disk grow with the number of blocks. Texts are never shuffled.

Nulls and texts without words: no words, no hits, not contaminated. Items without words match nothing; repeated items count
once per item_id; repeated documents are judged each. An item without an item_id hits like any other and is only left out of
the item ids. An empty benchmark hits nothing, an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm import spans
from terrane.llm.common import saved, small_batches, whole

WINDOW = 13
#: Words of test items in one automaton: about 200 MB in a worker at most. Bytes of text that pass one of several automata at once.
BLOCK_WORDS, SCANNED = 200_000, 1 << 25
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes to lower case, separators to spaces; all bytes of other scripts are parts of words.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences (Blumer et al., 1987), with the items of each window."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window, self.least = window, window
        self.windows: dict[int, set] = {}
        self.shorts: dict[int, list[tuple[int, object]]] = {}
        items = [(i, w) for i, w in items if w]
        for _, sequence in items:
            last = 0
            for w in sequence:
                last = self._extend(last, w)
        for item, sequence in items:
            k = min(window, len(sequence))
            self.least = min(self.least, k)
            for a in range(len(sequence) - k + 1):
                state = 0
                for w in sequence[a : a + k]:
                    state = self.step[state][w]
                if k == window:
                    self.windows.setdefault(state, set()).add(item)
                else:
                    self.shorts.setdefault(state, []).append((k, item))
        self._above()

    def size(self) -> int:
        """Entries of all tables."""
        return len(self.step) + sum(map(len, self.step)) + sum(map(len, self.windows.values())) + sum(map(len, self.shorts.values()))

    def _clone(self, p: int, q: int, w: bytes) -> int:
        new = len(self.step)
        self.step.append(dict(self.step[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: bytes) -> int:
        q = self.step[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new, p = len(self.step), last
        self.step.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def _above(self) -> None:
        """For each state, the state of its window-long suffix, and the next of its suffixes (itself included) with short items."""
        n = len(self.step)
        self.full, self.short = [-1] * n, [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.full[s] = self.full[up] if self.full[up] >= 0 else s if self.length[s] >= self.window else -1
            self.short[s] = s if s in self.shorts else self.short[up]

    def scan(self, text: list[bytes]) -> tuple[bytearray | None, set]:
        """Which words are hit (None: none), and the items with occurring windows."""
        step, link, length, least, window = self.step, self.link, self.length, self.least, self.window
        hit, found, state, n = None, set(), 0, 0
        for at, w in enumerate(text):
            to = step[state].get(w)
            if to is None:
                while state:
                    state = link[state]
                    to = step[state].get(w)
                    if to is not None:
                        n = length[state]
                        break
                else:
                    n = 0
                    continue
            state = to
            n += 1
            if n < least:
                continue
            reach = 0
            if n >= window:  # words before these were hit by the windows that ended before
                reach = window
                found |= self.windows.get(self.full[state], set())
            s = self.short[state]
            while s >= 0:
                for k, item in self.shorts[s]:
                    if k <= n:
                        found.add(item)
                        reach = max(reach, k)
                s = self.short[link[s]]
            if reach:
                hit = hit or bytearray(len(text))
                hit[at + 1 - reach : at + 1] = b"\x01" * reach
        return hit, found


def sequences(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item, words, n): each distinct item's words, in pieces of `most` words that overlap by window - 1."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pieces, n = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                w = words(text or "")
                for a in range(0, max(1, len(w) - window + 1) if w else 0, most):
                    part = w[a : a + most + window - 1]
                    row.append(k)
                    pieces.append(b" ".join(part))
                    n.append(len(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(pieces, pa.binary()), pa.array(n, pa.int64())], ["item", "words", "n"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select(F.col("item_id").alias("item"), whole(F.col("text")).alias("text")).distinct()
    return items.mapInArrow(cut, f"item {kind}, words binary, n long")


def built(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """An automaton for each block of items, one after the other; only one block's items are at the driver at a time."""
    items = saved(sequences(benchmark, window, block_words))
    blocks = 1 + int(items.agg(F.sum("n")).first()[0] or 0) // block_words
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).collect()
        yield Automaton(((r["item"], bytes(r["words"]).split(b" ")) for r in rows), window)


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Automaton]:
    """All of them at once, for benchmarks of a few blocks."""
    return list(built(benchmark, window, block_words))


def _runs(text: str, hit: bytearray) -> list[dict[str, int]]:
    """Code points of the runs of hit words."""
    out: list[dict[str, int]] = []
    at = -2
    for k, m in enumerate(WORD.finditer(text.translate(ASCII_LOWER))):
        if hit[k]:
            if at == k - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            at = k
    return out


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND = "n_words long, n_hit long, items array<string>, runs array<struct<start:int,end:int>>"


def _scan_all(texts: list[str], machines: Iterable[Automaton]) -> list[tuple[int, bytearray | None, set]]:
    """(words, which are hit, items) of each text, over all machines."""
    out: list[list] = [[0, None, set()] for _ in texts]
    for m in machines:
        for text, row in zip(texts, out, strict=True):
            w = words(text)
            hit, found = m.scan(w)
            row[0] = len(w)
            row[2] |= found
            if hit is not None:
                row[1] = hit if row[1] is None else bytearray(a | b for a, b in zip(row[1], hit, strict=True))
    return [tuple(r) for r in out]


def scanned(texts: Column, machines: Iterable[Automaton]) -> Column:
    """struct<n_words, n_hit, items, runs> of each text; the automata go to the executors once, as files."""
    from pyspark.sql import SparkSession

    sent = [SparkSession.getActiveSession().sparkContext.broadcast(m) for m in machines]

    def each() -> Iterator[Automaton]:
        """A single automaton stays loaded; of several, one at a time."""
        for b in sent:
            yield b.value
            if len(sent) > 1 and hasattr(b, "_value"):
                del b._value

    def result(batch: pa.Array) -> pa.Array:
        texts = [t or "" for t in batch.to_pylist()]
        n_words, n_hit, ids, runs = [], [], [], []
        for text, (n, hit, found) in zip(texts, _scan_all(texts, each()), strict=True):
            n_words.append(n)
            n_hit.append(sum(hit) if hit else 0)
            ids.append(sorted(str(i) for i in found if i is not None))
            runs.append(_runs(text, hit) if hit else [])
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(runs, RUNS)], ["n_words", "n_hit", "items", "runs"])

    @F.arrow_udf(f"struct<{FOUND.replace(' array', ':array').replace(' long', ':long')}>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: list[pa.Array] = []
        for batch in batches:
            if len(sent) == 1:
                yield result(batch)
                continue
            held.append(batch)
            if sum(b.nbytes for b in held) >= SCANNED:
                yield from _split(result(pa.chunked_array(held).combine_chunks()), held)
                held = []
        if held:
            yield from _split(result(pa.chunked_array(held).combine_chunks()), held)

    return of(whole(texts))


def _split(rows: pa.Array, like: list[pa.Array]) -> Iterator[pa.Array]:
    at = 0
    for b in like:
        yield rows.slice(at, len(b))
        at += len(b)


def contaminated(found: Column, coverage: int = 20) -> Column:
    return (found["n_hit"] > 0) & (coverage * found["n_hit"] >= found["n_words"])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", scanned(F.col("text"), built(benchmark)).alias("f"))
    f = F.col("f")
    return found.select("doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(f["items"], ",").cast("binary"), 256).alias("items_sha256"), contaminated(f).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, spans_too: bool = False) -> DataFrame:
    """Documents that aren't contaminated, all columns. spans_too: their few hit words are cut out as well."""
    small_batches(docs.sparkSession)
    names = docs.columns
    found = docs.select(F.struct(*(docs[c] for c in names)).alias("row_"), scanned(docs["text"], built(benchmark)).alias("f_")).where(~contaminated(F.col("f_")))
    row = {c: F.col("row_")[c] for c in names}
    if spans_too:
        row["text"] = spans.redacted(row["text"], F.col("f_")["runs"], "")
    return found.select(*(c.alias(n) for n, c in row.items()))


def items_digest(items: Iterable[object]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
