"""Mixture-controlled packing: deficit round-robin over one queue for each source fills every window to the target token proportions.

A queue holds the tokens of a source in the order of its rows. In each window a queue earns its target share, adds it to the deficit it carries,
and gives whole tokens of that; what is left of the window goes to the largest deficits, which may fall below zero for it. Documents are cut where a
grant ends, so every window is full. The round robin is run once for a cycle of windows whose deficits end where they began, and all cycles are
alike: so the place of a token follows from its place in its queue, and no partition waits for the one before.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from . import textkit, tokens, work

WINDOW = 4096
#: Queues at most; sources beyond the largest of them share the last queue.
QUEUES = 256
#: Windows of a cycle, and entries (windows x queues x queues) that bound the cycles of all phases together.
CYCLE, ENTRIES = 1024, 1 << 20


@dataclass
class Phase:
    """``cycles`` repetitions of the windows ``grants[m, s]`` (tokens of queue s in window m), each ``size`` tokens long. ``start[s]`` tokens of the
    queues and ``sequence`` windows lie before."""

    grants: np.ndarray
    cycles: int
    size: int
    start: np.ndarray
    sequence: int

    def __post_init__(self):
        self.per = self.grants.sum(0)
        self.ends = np.cumsum(self.grants, 0)  # tokens of a queue up to the end of each window of a cycle
        self.ahead = np.cumsum(self.grants, 1) - self.grants  # tokens of the queues before it in the window
        self.turns = [np.flatnonzero(g) for g in self.grants.T]  # windows of a cycle that a queue has a part in


def deficit_round_robin(quotas: np.ndarray, windows: int, size: int) -> np.ndarray:
    """Grants of ``windows`` windows of ``size`` tokens in which queue s gives ``quotas[s]`` tokens in all (they sum up to windows x size).

    A deficit is held in units of 1 / ``windows`` token, so nothing is rounded, and after the last window all are zero again.
    """
    deficit, left = np.zeros(len(quotas), np.int64), quotas.astype(np.int64).copy()
    out = np.zeros((windows, len(quotas)), np.int64)
    for m in range(windows):
        deficit += quotas
        give = np.minimum(np.maximum(deficit // windows, 0), left)
        short = size - int(give.sum())
        while short > 0:  # the queues with the largest rest, one token each
            rest = np.where(give < left, deficit - give * windows, -np.iinfo(np.int64).max)
            take = np.argsort(-rest, kind="stable")[: min(short, int((give < left).sum()))]
            give[take] += 1
            short -= len(take)
        if short < 0:  # deficits of several queues fell due together
            rest = np.where(give > 0, deficit - give * windows, np.iinfo(np.int64).max)
            give[np.argsort(rest, kind="stable")[:-short]] -= 1
        deficit -= give * windows
        left -= give
        out[m] = give
    return out


def shared_out(total: int, weights: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``total`` tokens by ``weights``, never more than ``most``; what a queue can't give goes to the others, in the end to those without weight.
    Largest remainders are rounded up."""
    out = np.zeros(len(most), np.int64)
    while total:
        room = most - out
        w = np.where(room > 0, weights, 0.0)
        w = w if w.any() else (room > 0).astype(float)
        ideal = total * (w / w.sum())
        if (ideal > room).any():
            give = np.where(ideal > room, room, 0)
        else:
            give = np.floor(ideal).astype(np.int64)
            give[np.argsort(give - ideal, kind="stable")[: total - int(give.sum())]] += 1
        out += give
        total -= int(give.sum())
    return out


def plan(totals: np.ndarray, weights: np.ndarray | None = None, window: int = WINDOW) -> list[Phase]:
    """The phases of windows that use up queues of ``totals`` tokens in the proportions ``weights`` (None: those of the totals).

    A phase ends when a queue can't give its share of another cycle. A window in which a queue runs dry is a phase of its own: the others fill its
    share, and go on without it. The rest that fills no window is cut into windows whose sizes are powers of two, so that nothing is padded. Work and
    size follow the number of queues, not of tokens.
    """
    left, used, at, out = totals.astype(np.int64).copy(), np.zeros(len(totals), np.int64), 0, []
    longest = int(np.clip(ENTRIES // max(1, len(totals) ** 2), 1, CYCLE))

    def add(grants: np.ndarray, cycles: int, size: int) -> None:
        nonlocal at, left, used
        out.append(Phase(grants, cycles, size, used.copy(), at))
        taken = grants.sum(0) * cycles
        left, used, at = left - taken, used + taken, at + len(grants) * cycles

    while (rest := int(left.sum())) >= window:
        if weights is None:
            w = left / rest
            m = min(longest, rest // window)
        else:
            w = np.where(left > 0, weights, 0.0)
            w = w / w.sum() if w.sum() > 0 else left / rest
            m = int(min(longest, rest // window, np.floor((left[w > 0] / (w[w > 0] * window)).min())))
        if m < 1:
            add(shared_out(window, w, left)[None], 1, window)
            continue
        quotas = shared_out(m * window, w, left)
        cycles = int((left[quotas > 0] // quotas[quotas > 0]).min())
        add(deficit_round_robin(quotas, m, window), cycles, window)
    while (rest := int(left.sum())) > 0:
        size = 1 << (rest.bit_length() - 1)
        add(shared_out(size, left / rest, left)[None], 1, size)
    return out


def cut(phases: list[Phase], queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of the runs ``start[i] .. start[i] + size[i]`` of the queues ``queue[i]``: (run, begin within the run, length, sequence, offset), by run."""
    found = []
    for p in phases:
        lo = p.start[queue]
        hi = lo + p.per[queue] * p.cycles
        here = np.flatnonzero((start < hi) & (start + size > lo) & (hi > lo))
        for s in np.unique(queue[here]).tolist():
            runs = here[queue[here] == s]
            a, z = np.maximum(start[runs], lo[runs]) - lo[runs], np.minimum(start[runs] + size[runs], hi[runs]) - lo[runs]  # in the phase
            turns, upto, quota = p.turns[s], p.ends[p.turns[s], s], int(p.per[s])
            first, last = ((t // quota) * len(turns) + np.searchsorted(upto, t % quota, "right") for t in (a, z - 1))
            n = last - first + 1
            run = np.repeat(np.arange(len(runs)), n)
            turn = tokens.ragged(first, n)
            cycle, k = turn // len(turns), turn % len(turns)
            w = turns[k]
            opens = cycle * quota + upto[k] - p.grants[w, s]
            begin, end = np.maximum(opens, a[run]), np.minimum(opens + p.grants[w, s], z[run])
            found.append((runs[run], begin + p.start[s] - start[runs[run]], end - begin, p.sequence + cycle * len(p.grants) + w, p.ahead[w, s] + begin - opens))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    out = [np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)]
    order = np.lexsort((out[1], out[0]))
    return tuple(x[order] for x in out)


def encoded(documents: DataFrame, source: str, closing: int, vocabulary: str | None) -> DataFrame:
    """(part, source, doc_id, before, n, ids): ids of each row as bytes; ``before`` counts the ids of the same source ahead of it in its part."""
    vocab = vocabulary or tokens.vocabulary_path()
    kind = "<u2" if max(tokens.vocabulary_size(vocab), closing + 1) <= 65536 else "<u4"

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for lo, hi, ids, sizes in tokens.encode_documents(batch.column(2), vocab, closing):
                before = np.zeros(hi - lo, np.int64)
                for i, (s, n) in enumerate(zip(names[lo:hi], sizes.tolist(), strict=True)):
                    before[i] = seen.get(s, 0)
                    seen[s] = before[i] + n
                wide = ids.astype(kind)
                offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * wide.itemsize
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offs), pa.py_buffer(wide)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, part, np.int32)), batch.column(1).slice(lo, hi - lo), batch.column(0).slice(lo, hi - lo), pa.array(before), pa.array(sizes.astype(np.int64)), binary.cast(pa.binary())], ["part", "source", "doc_id", "before", "n", "ids"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(work.quoted(source)).cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(textkit.frugal(run, True), "part int, source string, doc_id long, before long, n long, ids binary")


def queues(local: DataFrame, most: int) -> tuple[list[str | None], int, np.ndarray]:
    """The sources with a queue of their own, by falling tokens (then by name, null first), how many queues there are, and the tokens of each.

    The driver gets a row for each queue, ``most`` at the utmost.
    """
    per = local.groupBy("source").agg(F.sum("n").alias("n"))
    top = per.orderBy(F.desc("n"), F.col("source").asc_nulls_first()).limit(most).collect()
    total = local.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    own = top if sum(r.n for r in top) == total else top[: most - 1]
    sizes = [r.n for r in own]
    if sum(sizes) < total:
        sizes.append(total - sum(sizes))
    return [r.source for r in own], len(sizes), np.array(sizes, np.int64)


def pack(documents: DataFrame, targets: Mapping[str | None, float] | None = None, source: str = "source", window: int = WINDOW, closing: int = 2, vocabulary: str | None = None, most: int = QUEUES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source) of every piece of ``documents`` (doc_id, text, ``source``).

    Every sequence but the last few has ``window`` tokens, of which each source gives its target share (``targets``, by name; None: its share of all
    tokens, so that every window mirrors the corpus), off by less than two tokens. Sources without a target give only
    what the others can't. A source that runs dry leaves its share to the others. The rest is cut into sequences whose sizes are powers of two: nothing is padded.

    Null or empty text: one piece, the closing id. A null source is a source; null doc_ids and repeated rows stay, each packed on its own; an empty
    table gives an empty result; very long texts are read whole and cut where grants end; other columns are not read. Sources beyond the ``most`` - 1
    largest share a queue. Rows stand in a queue as they were read, written down once; any number of them may be of one source, as no queue is ever in one task.
    """
    spark = documents.sparkSession
    rows, rows_path = work.store(encoded(documents, source, closing, vocabulary), "mixture")
    local, local_path = work.store(rows.groupBy("part", "source").agg(F.sum("n").alias("n")), "queued")
    own, n, totals = queues(local, most)
    known = spark.createDataFrame([(s, i) for i, s in enumerate(own)], "name string, queue int")
    placed = local.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name")), "left").select("part", "source", "n", F.coalesce("queue", F.lit(n - 1)).alias("queue"))
    # tokens of the queue in the parts before: one row for each part and source
    ahead = np.concatenate([[0], np.cumsum(totals)])[: len(totals)].tolist()
    summed = filters.prefix_sum(placed, ["queue", "part", "source"], "n", "upto")
    shift = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ahead)], "queue int, ahead long")
    base, base_path = work.store(summed.join(F.broadcast(shift), "queue").select("part", F.col("source").alias("name"), "queue", (F.col("upto") - F.col("n") - F.col("ahead")).alias("base")), "queues")
    weights = None if targets is None else np.array([targets.get(s, 0.0) for s in own] + [sum(v for k, v in targets.items() if k not in own)] * (n - len(own)), float)
    shared = spark.sparkContext.broadcast(plan(totals, weights, window) if n else [])
    at = rows.alias("r").join(work.small(base).alias("b"), (F.col("r.part") == F.col("b.part")) & F.col("r.source").eqNullSafe(F.col("b.name")))
    at = at.select("doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def place(batches):
        phases = shared.value
        for batch in batches:
            queue, start, size = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3, 4))
            run, begin, length, sequence, offset = cut(phases, queue, start, size)
            data = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(5)]
            kind = "<u2" if len(size) and len(data[0]) == 2 * size[0] else "<u4"
            wide = [memoryview(np.ascontiguousarray(x.view(kind).astype("<u4"))).cast("B") for x in data]
            crc = [zlib.crc32(wide[i][4 * b : 4 * (b + k)]) for i, b, k in zip(run.tolist(), begin.tolist(), length.tolist(), strict=True)]
            take = pa.array(run)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(begin), pa.array(length), pa.array(crc, pa.int64()), batch.column(4).take(take), pa.array(sequence), pa.array(offset), batch.column(1).take(take)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    out, _ = work.store(at.mapInArrow(textkit.frugal(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"), "packed")
    work.drop(spark, rows_path, local_path, base_path)
    return out


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(work.read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
