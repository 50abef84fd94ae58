"""Packing of token pieces into sequences: Martello-Toth dominance reduction, then best fit for the rest."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit, tokens, work

CAPACITY = 2048


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins for ``counts[n]`` pieces of each length n: (((length, copies), ...), number of such bins).

    The instance is its histogram, so the plan's size follows the capacity and not the number of pieces. From the longest piece on,
    a set holding it is fixed for good if it dominates every other feasible set with it (each of the other set's pieces can be
    exchanged, alone or together, for one of its own): alone if nothing fits beside it; with one partner if that fills the bin, or
    if no two other pieces fit and it is the largest that does, or if no sum of two or more pieces lies above it. Each fixing shrinks
    the instance. What no rule fixes is packed best-fit by descending length.
    """
    left = counts.astype(np.int64).copy()
    bins: list[tuple[tuple[tuple[int, int], ...], int]] = []
    shrunk = True
    while shrunk:
        shrunk = False
        for n in range(capacity, 0, -1):
            while left[n]:
                fixed = _dominating(left, n, capacity - n)
                if fixed is None:
                    break
                partner, k = fixed
                bins.append((((n, 2),) if partner == n else ((n, 1), (partner, 1)) if partner else ((n, 1),), k))
                left[n] -= k
                left[partner or 0] -= k if partner else 0
                shrunk = True
    return bins + best_fit({n: int(left[n]) for n in np.flatnonzero(left).tolist()}, capacity)


def _dominating(left: np.ndarray, n: int, room: int) -> tuple[int, int] | None:
    """The partner (0: none) of a piece of length ``n`` in a set that dominates all others with it, and how many such sets; or None."""
    fits = np.flatnonzero(left[1 : room + 1]) + 1
    if n <= room and left[n] == 1:
        fits = fits[fits != n]  # a piece is no partner of its own
    if not len(fits):
        return 0, int(left[n]) if n > room else 1
    best, small = int(fits[-1]), int(fits[0])
    second = small if left[small] - (small == n) >= 2 else int(fits[1]) if len(fits) > 1 else room + 1
    if best == room or small + second > room or not _sum_above(fits, best, room):
        return best, int(left[n]) // 2 if best == n else int(min(left[n], left[best]))
    return None


def _sum_above(fits: np.ndarray, best: int, room: int) -> bool:
    """Whether two or more pieces of these lengths may sum up to over ``best`` and at most ``room`` (each taken any number of times)."""
    once, reach, mask = 0, 0, (1 << (room + 1)) - 1
    for x in fits.tolist():
        once |= 1 << x
    for x in fits.tolist():  # two pieces
        reach |= (once << x) & mask
    seen = 0
    while reach & ~seen:
        if reach >> (best + 1):
            return True
        seen |= reach
        more = 0
        for x in fits.tolist():
            more |= (reach << x) & mask
        reach |= more
    return bool(reach >> (best + 1))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit by descending length over runs of equal bins."""
    open_bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    full = []
    for n in sorted(counts, reverse=True):
        k = counts[n]
        while k:
            room = min((r for r in open_bins if r >= n), default=capacity)
            held, m = open_bins[room].pop() if room in open_bins else ((), k)
            if room in open_bins and not open_bins[room]:
                del open_bins[room]
            each = min(room // n, k)
            use = min(m, k // each)
            if use < m and held:
                open_bins[room].append((held, m - use))
            k -= use * each
            now, free = (held + ((n, each),), use), room - n * each
            (open_bins[free] if free else full).append(now)
    return full + [b for runs in open_bins.values() for b in runs]


def slots(bins: list[tuple[tuple[tuple[int, int], ...], int]], first: int = 0) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, bins, first sequence, offset, length), by rank.

    The piece of rank r in a row lies in sequence ``first sequence + (r - first rank) % bins`` at ``offset + length * ((r - first
    rank) // bins)``.
    """
    rank, out, sequence = defaultdict(int), defaultdict(list), first
    for parts, m in bins:
        at = 0
        for n, copies in parts:
            out[n].append((rank[n], m, sequence, at, n))
            rank[n] += m * copies
            at += n * copies
        sequence += m
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pieces(documents: DataFrame, capacity: int = CAPACITY, closing: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(part, doc_id, piece, start, length, ids_crc32, nth, ids) of all documents; ``nth`` counts equal lengths within ``part``."""
    vocab = vocabulary or tokens.vocabulary_path()

    def cut(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids = batch.column(0)
            for lo, hi, ids, sizes in tokens.encode_documents(batch.column(1), vocab, closing):
                per = -(-sizes // capacity)
                doc = np.repeat(np.arange(hi - lo), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                ends = np.cumsum(length)
                view = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                crc = [zlib.crc32(view[4 * (z - n) : 4 * z]) for n, z in zip(length.tolist(), ends.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                by = length[order]
                first = np.searchsorted(by, by)
                nth = np.empty(len(by), np.int64)
                nth[order] = np.arange(len(by)) - first + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part, np.int32)), doc_ids.slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(nth)],
                    ["part", "doc_id", "piece", "start", "length", "ids_crc32", "nth"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(textkit.frugal(cut, True), "part int, doc_id long, piece int, start long, length long, ids_crc32 long, nth long")


def pack(documents: DataFrame, capacity: int = CAPACITY, closing: int = 0, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``documents`` (doc_id, text).

    Null or empty text: one piece, the closing id. Null doc_ids and repeated rows stay, each packed on its own; an empty table gives an
    empty result; very long texts are read whole; other columns are not read. Ranks within a length depend on how rows are dealt to partitions, so they are
    written down once. The driver gets the histogram, one number for each possible length.
    """
    spark = documents.sparkSession
    cut, _ = work.store(pieces(documents, capacity, closing, vocabulary), "pieces")
    local, _ = work.store(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    shared = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    # ranks before a part: one row for each (length, part), so a length has as many as there are parts
    before = local.withColumn("before", F.sum("n").over(_by_length())).withColumn("before", F.col("before") - F.col("n")).select("length", "part", "before")
    before, _ = work.store(before, "before")
    ranked = cut.join(work.small(before), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        where = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                rows = where[int(length[group[0]])]
                row = rows[np.searchsorted(rows[:, 0], rank[group], "right") - 1]
                k = rank[group] - row[:, 0]
                seq[group], off[group] = row[:, 2] + k % row[:, 1], row[:, 3] + row[:, 4] * (k // row[:, 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(textkit.frugal(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _by_length():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(work.read(spark, sf_dir, "documents").select("doc_id", "text"))
