"""SimHash near-duplicates: fingerprints within a Hamming distance are linked, components are closed over links.

Search. Only distinct fingerprints take part, so copies cost nothing. Cut into m blocks, two fingerprints
with at most `radius` differing bits agree in some m - radius of them: each such choice of blocks is a key,
and rows that share it form a bucket. m grows with the number of fingerprints, so that a bucket stays
small; every m is exact. In a bucket, a table of distances to PIVOTS reference fingerprints discards pairs:
by the triangle inequality the largest difference of two rows' coordinates is at most their distance.
Survivors are verified bit by bit. A bucket gives a spanning set of links, never all its pairs; a bucket
over BUCKET rows is dealt into chunks and each pair of chunks is a task's work of bounded size.

Pivot distances alone can't deal the rows out: over 64 bits they crowd at 32 +- 4, so that a window of 4 leaves
about half of all pairs for each pivot, and no equality key follows from them. Hence the blocks before the pivots.

Nulls and empty texts: fingerprint zero, linked like any other. A null doc_id is never the smallest
unless a component has no other. Repeated rows share their fingerprint and component. An empty table gives an empty result.
Groups of any size: a fingerprint or root that many rows hold is joined where its rows are (`common.with_group`)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.common import saved, small_batches, whole, with_group, written

SHINGLE, RADIUS, SEED = 4, 4, 42
BUCKET, SMALL, PIVOTS = 4096, 8, 16
#: Rows to leave out that are broadcast at most (8 bytes each); more are joined by shuffling.
LOSERS = 1_000_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str) -> int:
    """Signed 64 bits. A bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    starts = np.zeros(len(words), dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
    ends = (np.append(starts[SHINGLE:], len(line) + 1) - 1)[:n].tolist() if len(words) >= SHINGLE else [len(line)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends, strict=True)])
    ones = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint_of(text: Column) -> Column:
    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t) if t else 0 for t in texts.to_pylist()], type=pa.int64())

    return of(whole(text))


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Signed masks of each choice of blocks; n: how many fingerprints."""
    m = radius + 2
    while 64 * (m - radius) // m < max(n, 2).bit_length() and m < 12:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(c) for c in combinations(blocks, m - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(PIVOTS)], dtype=np.uint64)


def pivot_table(f: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f[:, None] ^ pivots()[None, :]).astype(np.int8)


def spanning(f: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what the links of all pairs connect. side: only pairs of different sides count.

    Sorted by the distance to the first pivot, a row's partners lie in a window; the largest coordinate difference
    over all pivots thins it."""
    table = pivot_table(f)
    order = np.argsort(table[:, 0], kind="stable")
    f, table, side = f[order], table[order], None if side is None else side[order]
    label, out = np.arange(len(f)), []
    last = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    for i in range(len(f) - 1):
        near = np.arange(i + 1, last[i])
        if side is not None:
            near = near[side[near] != side[i]]
        near = near[np.abs(table[near] - table[i]).max(axis=1, initial=0) <= radius]
        near = near[np.bitwise_count(f[near] ^ f[i]) <= radius]
        near = near[label[near] != label[i]]
        while len(near):
            j, gone = int(near[0]), label[near[0]]
            out.append((int(f[i].view(np.int64)), int(f[j].view(np.int64))))
            label[label == gone] = label[i]
            near = near[label[near] != label[i]]
    return out


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, fp) sorted by t and key: links (kind 0: a, b), and rows of buckets too large for here (kind 1: a = fp)."""
    held: list[np.ndarray] = []  # of the bucket that is open: t, key, fp
    large = False

    def batch(kind: int, t: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(t.astype(np.int32)), pa.array(key), pa.array(a), pa.array(b)], ["kind", "t", "key", "a", "b"])

    def linked(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        ab = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return batch(0, np.zeros(len(ab)), np.zeros(len(ab), dtype=np.int64), ab[:, 0].copy(), ab[:, 1].copy())

    def closed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets."""
        t, key, fp = rows
        f = fp.view(np.uint64)
        cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(f))
        size = ends - starts
        of, pairs = np.repeat(np.arange(len(starts)), size), []
        small, table = (size <= SMALL)[of], pivot_table(f)
        for o in range(1, SMALL):
            i = np.flatnonzero(small[: len(f) - o] & (of[: len(f) - o] == of[o:]))
            if not len(i):
                break
            i = i[np.abs(table[i] - table[i + o]).max(axis=1) <= RADIUS]
            a, b = f[i], f[i + o]
            ok = np.bitwise_count(a ^ b) <= RADIUS
            if ok.any():
                yield batch(0, np.zeros(int(ok.sum())), np.zeros(int(ok.sum()), dtype=np.int64), a[ok].view(np.int64), b[ok].view(np.int64))
        for k in np.flatnonzero((size > SMALL) & (size <= BUCKET)):
            pairs += spanning(f[starts[k] : ends[k]])
        if pairs:
            yield linked(pairs)
        for k in np.flatnonzero(size > BUCKET):
            s = slice(starts[k], ends[k])
            yield batch(1, t[s], key[s], fp[s], fp[s])

    for got in batches:
        rows = np.stack([got.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        if not rows.shape[1]:
            continue
        if held and (held[0][:2, -1] != rows[:2, 0]).any():
            if not large:
                yield from closed(np.concatenate(held, axis=1))
            held, large = [], False
        differs = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0))
        if len(differs):
            cut = int(differs[-1]) + 1
            head = rows[:, :cut]
            if held:
                same = int(np.argmax((head[:2] != held[0][:2, -1:]).any(axis=0))) if (head[:2] != held[0][:2, -1:]).any() else cut
                if large:
                    yield batch(1, head[0, :same], head[1, :same], head[2, :same], head[2, :same])
                    head = head[:, same:]
                else:
                    head = np.concatenate([*held, head], axis=1)
            if head.shape[1]:
                yield from closed(head)
            held, large = [], False
            rows = rows[:, cut:]
        if large:
            yield batch(1, *rows[[0, 1, 2, 2]])
            held = [rows[:, -1:]]
            continue
        held.append(rows)
        if sum(x.shape[1] for x in held) > BUCKET:
            for x in held:
                yield batch(1, *x[[0, 1, 2, 2]])
            held, large = [held[-1][:, -1:]], True
    if held and not large:
        yield from closed(np.concatenate(held, axis=1))


def chunk_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, i, j, mine, fp) sorted by the first four: links between chunks i and j of a large bucket."""
    held: np.ndarray | None = None

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
        for s, e in zip(np.append(0, cut), np.append(cut, rows.shape[1]), strict=True):
            g = rows[:, s:e]
            pairs = spanning(np.ascontiguousarray(g[5]).view(np.uint64), None if g[2, 0] == g[3, 0] else g[4])
            if pairs:
                ab = np.array(pairs, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], ["a", "b"])

    for got in batches:
        rows = np.stack([got.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
        if not rows.shape[1]:
            continue
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        differs = np.flatnonzero((rows[:4] != rows[:4, -1:]).any(axis=0))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield from done(rows[:, :cut])
        held = rows[:, cut:]
    if held is not None and held.shape[1]:
        yield from done(held)


def links(fps: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints of the column fp: as connected as all pairs within the radius."""
    keyed = fps.select("fp", F.posexplode(F.array(*map(F.lit, masks(fps.count())))).alias("t", "mask")).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    found = saved(keyed.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(bucket_links, "kind int, t int, key long, a long, b long"))
    near = found.where("kind = 0").select("a", "b")
    over = found.where("kind = 1").select("t", "key", F.col("a").alias("fp"))
    if over.isEmpty():
        return near.distinct()
    chunks = over.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("chunks"))
    dealt = over.join(chunks, ["t", "key"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp")
    more = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInArrow(chunk_links, "a long, b long")
    return near.unionByName(more).distinct()


def _size(e: DataFrame) -> tuple[int, object]:
    """Rows and a digest of all of them, one row at the driver."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable. Alternating large and small stars (Kiveris et al., 2014);
    each round is written to the checkpoint folder. Nodes with many neighbours are no task of their own (`with_group`)."""
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now = _size(e)
    while now[0]:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n_"))
        large = with_group(both, low, "u", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n_"))
        small = with_group(large, low, "u", 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = saved(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = _size(e)
        if now == before:
            break
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def classes(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id, n_) for each distinct fp of rows (doc_id, fp); n_: its rows."""
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_")))
    rooted = components(links(fps.select("fp")))
    rooted = saved(fps.join(rooted, fps["fp"] == rooted["node"], "left").select("fp", "least", "n_", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_"))
    return with_group(rooted.select("fp", F.col("n_").alias("rows_"), "root"), ids, "root", rooted.count()).select("fp", "root", "component_id", F.col("rows_").alias("n_"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    small_batches(docs.sparkSession)
    rows = saved(docs.select("doc_id", fingerprint_of(F.col("text")).alias("fp")))
    out = with_group(rows, classes(rows).select("fp", "component_id", "n_"), "fp", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the row of the smallest doc_id; of several such rows, or of a
    component without doc_ids, that of the smallest fingerprint.

    Rows are written once with their fingerprint and a number; what is decided on is narrow. The numbers that go are
    broadcast up to LOSERS of them, else rows are joined to them by number."""
    small_batches(docs.sparkSession)
    names = docs.columns
    marked = written(docs.select(F.struct(*(docs[c] for c in names)).alias("row_"), fingerprint_of(docs["text"]).alias("fp"), F.monotonically_increasing_id().alias("at_")))
    rows = marked.select(F.col("row_.doc_id").alias("doc_id"), "fp", "at_")
    rows = saved(with_group(rows, classes(rows).select("fp", "root", "n_"), "fp", marked.count()).select("root", "at_", F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "at_").alias("rank_")))
    first = rows.groupBy("root").agg(F.min_by("at_", "rank_").alias("at_")).select("at_")
    losers = saved(rows.select("at_").join(first, "at_", "left_anti"))
    losers = F.broadcast(losers) if losers.count() <= LOSERS else losers
    return marked.join(losers, "at_", "left_anti").select(*(F.col("row_")[c].alias(c) for c in names))
