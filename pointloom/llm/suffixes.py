"""Repeated passages by sparse suffixes: runs at minimiser positions that documents share choose the windows that are compared whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit, work

#: Words of the shortest passage; of the run that a suffix starts with; runs of which the least is retained. Any ``SHORTEST`` words hold a
#: whole window of ``SPREAD`` runs, so equal passages retain equal suffixes, and retained runs leave no word between them.
SHORTEST, RUN = 50, 26
SPREAD = SHORTEST - RUN + 1
#: Rows of two numbers, or spans to cut, up to which they are broadcast to the documents; beyond it the same join shuffles.
SMALL = 300_000
NONE = -(1 << 63)
#: Rows of one key that a task of the sorted pass holds; a key with more is settled with those at partition ends.
HELD = 100_000


def retained(g: np.ndarray) -> np.ndarray:
    """Positions of the minimisers of a document's run hashes ``g``; a stretch of equal runs keeps one in ``SPREAD``, and the last, so that
    each window still holds one with the hash of its least run."""
    if len(g) < SPREAD:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(g, SPREAD)
    at = np.unique(windows.argmin(1) + np.arange(len(windows)))
    same = np.zeros(len(at), bool)
    same[1:] = (at[1:] == at[:-1] + 1) & (g[at[1:]] == g[at[:-1]])
    if same.any():
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
        at = at[~same | ((at - at[begin]) % SPREAD == 0) | ~np.append(same[1:], False)]
    return at


def repeated_ids(documents: DataFrame) -> DataFrame:
    """(d,), stored: the doc_ids of several rows."""
    ids = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("d"))
    return work.store(ids.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d"), "again")[0]


def versioned(rows: DataFrame, again: DataFrame, doc: str, text: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, but for rows of the doc_ids ``again``, which a hash of their texts tells apart."""
    if again.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    side = again.select(F.col("d").alias("__d"))
    marked = rows.join(F.broadcast(side) if again.count() <= SMALL else side, F.col(doc) == F.col("__d"), "left")
    return marked.withColumn(name, F.when(F.col("__d").isNotNull(), F.coalesce(F.xxhash64(text), F.lit(0))).otherwise(F.lit(0).cast("long"))).drop("__d")


def keyed(documents: DataFrame, again: DataFrame) -> DataFrame:
    """(doc_id, version, text)"""
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return versioned(rows, again, "doc_id", "text", "version").select("doc_id", "version", "text")


KEYED = "key long, doc_id long, version long, pos int"
NAMES = ["key", "doc_id", "version", "pos"]


def anchors(docs: DataFrame) -> DataFrame:
    """(key, doc_id, version, pos): the retained suffixes of whole texts, by the hash of their first ``RUN`` words."""

    def run(batches):
        for batch in batches:
            data, offs = textkit.text_buffers(batch.column(2))
            doc_ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in textkit.slices(offs):
                w = textkit.words(data, offs[lo : hi + 1])
                g = textkit.grams(w.hash, RUN)
                h, p, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(hi - lo, np.int64)
                for i in range(hi - lo):
                    a, z = int(w.first[i]), int(w.first[i + 1]) - RUN + 1
                    if z - a >= SPREAD:
                        at = retained(g[a:z])
                        h.append(g[a + at])
                        p.append(at)
                        n[i] = len(at)
                yield _keyed_batch(h, np.repeat(doc_ids[lo:hi], n), np.repeat(versions[lo:hi], n), p)

    return docs.mapInArrow(textkit.frugal(run), KEYED)


def _keyed_batch(h: list[np.ndarray], doc_id: np.ndarray, version: np.ndarray, pos: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(doc_id), pa.array(version), pa.array(np.concatenate(pos).astype(np.int32))], NAMES)


def windows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, doc_id, version, pos): hash and first word of each window of ``SHORTEST`` words that holds a suffix of ``places`` (doc_id, version,
    at: array of pos): the suffix extended to the left and right in every way that makes a shortest passage."""
    chosen = docs.join(work.small(places), ["doc_id", "version"]).select("doc_id", "version", "text", "at")

    def run(batches):
        for batch in batches:
            data, offs = textkit.text_buffers(batch.column(2))
            doc_ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in textkit.slices(offs):
                w = textkit.words(data, offs[lo : hi + 1])
                g = textkit.grams(w.hash, SHORTEST)
                at = batch.column(3).slice(lo, hi - lo)
                per, pos = np.diff(at.offsets.to_numpy()), at.flatten().to_numpy()
                h, p, n, k = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(hi - lo, np.int64), 0
                for i in range(hi - lo):
                    a, z = int(w.first[i]), int(w.first[i + 1]) - SHORTEST + 1
                    begin = np.unique((pos[k : k + per[i], None] - np.arange(SPREAD)).ravel())
                    begin = begin[(begin >= 0) & (begin < z - a)]
                    k += per[i]
                    h.append(g[a + begin])
                    p.append(begin)
                    n[i] = len(begin)
                yield _keyed_batch(h, np.repeat(doc_ids[lo:hi], n), np.repeat(versions[lo:hi], n), p)

    return chosen.mapInArrow(textkit.frugal(run), KEYED)


def neighbours(batches):
    """Rows (key, doc_id, version, pos) of one sorted partition: those whose key another document holds too, with ``first`` for the smallest
    (doc_id, version, pos) of a key. The first and the last key of a partition may go on in others: their rows all stay, marked as ``edge``."""
    kind = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("pos", pa.int32()), ("first", pa.bool_()), ("edge", pa.bool_())])
    opening, last, held = None, None, None  # the partition's first key; of the key that is going on, its batch end and its rows so far

    def judged(key, doc, version, pos, edges):
        at = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if key[0] > NONE else key[0] + 1))
        size = np.diff(np.append(at, len(key)))
        several = doc[at] != doc[at + size - 1]
        edge = np.isin(key[at], edges)
        keep, first = np.repeat(several | edge, size), np.zeros(len(key), bool)
        first[at] = True
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, doc, version, pos, first, np.repeat(edge, size))], schema=kind)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(4)]
        if opening is None:
            opening = cols[0][0]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        last = cols[0][-1]
        cut = int(np.searchsorted(cols[0], last))
        if last == opening:  # rows of the opening key need no more of their key: they are marked whatever follows
            yield judged(*cols, [opening])
            held = None
        else:
            if cut:
                yield judged(*(x[:cut] for x in cols), [opening])
            held = [x[cut:] for x in cols]
            if len(held[0]) > HELD:  # a key that fills batches goes on, or ends the partition: as an edge it needs no more of itself
                yield judged(*held, [opening, last])
                hot, held = last, None
                opening = hot
    if held is not None:
        yield judged(*held, [opening, last])


def shared(rows: DataFrame, name: str, order: tuple[str, ...] = ("key", "doc_id", "version", "pos")) -> DataFrame:
    """(doc_id, version, pos, first) of the ``rows`` whose key several documents hold, from one global sort: equal keys are neighbours.

    A key with very many rows runs over several partitions: only the keys at their ends, two for each, are summed up and sent to all.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    met = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(textkit.frugal(neighbours), KEYED + ", first boolean, edge boolean")
    met, path = work.store(met, name)
    own = F.struct("doc_id", "version", "pos")
    ends = met.where("edge").groupBy("key").agg(F.min(own).alias("m"), F.max("doc_id").alias("z")).where(F.col("m.doc_id") < F.col("z"))
    known = {r.key: (r.m.doc_id, r.m.version, r.m.pos) for r in ends.collect()}  # as many as partitions have ends
    sent = spark.sparkContext.broadcast(known)

    def settle(batches):
        several = sent.value
        for batch in batches:
            key, doc, version, pos, first, edge = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            keep, first = np.ones(len(key), bool), first.copy()
            at = np.flatnonzero(edge)
            if len(at):
                for k in np.unique(key[at]).tolist():
                    rows_of = at[key[at] == k]
                    if k in several:
                        d, v, p = several[k]
                        first[rows_of] = (doc[rows_of] == d) & (version[rows_of] == v) & (pos[rows_of] == p)
                    else:
                        keep[rows_of] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, version, pos, first)], ["doc_id", "version", "pos", "first"])

    out, _ = work.store(met.mapInArrow(textkit.frugal(settle), "doc_id long, version long, pos int, first boolean"), f"{name}-shared")
    work.drop(spark, path)
    return out


def matches(documents: DataFrame, again: DataFrame) -> DataFrame:
    """(doc_id, version, pos, first): all windows of ``SHORTEST`` words that another document holds too; ``first``: no smaller place does."""
    docs = keyed(documents, again)
    # written down first: the sort's sample would read all texts once more
    every, every_path = work.store(anchors(docs), "runs")
    places = shared(every, "anchors").groupBy("doc_id", "version").agg(F.collect_set("pos").alias("at"))
    places, path = work.store(places, "places")
    work.drop(documents.sparkSession, every_path)
    found = shared(windows(docs, places), "windows")
    work.drop(documents.sparkSession, path)
    return found


def merged(starts: np.ndarray) -> list[tuple[int, int]]:
    """The spans without overlap of the windows at sorted ``starts``."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > SHORTEST) + 1
    return list(zip(starts[np.concatenate([[0], new])].tolist(), (starts[np.append(new - 1, len(starts) - 1)] + SHORTEST).tolist(), strict=True))


def without(spans: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of ``spans`` outside ``kept``."""
    out = []
    for a, z in spans:
        for x, y in kept:
            if y > a and x < z:
                if x > a:
                    out.append((a, x))
                a = max(a, y)
        if a < z:
            out.append((a, z))
    return out


def passages(documents: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """(doc_id, version, repeats, cuts): for each text with repeated passages their word spans, and those to cut: what an earlier document holds.

    Words are blank-separated, A-Z lower-cased. A passage of ``SHORTEST`` words or more counts if a document of another doc_id holds it; what only
    recurs within one document, or in rows that repeat a doc_id, doesn't. ``version`` (a hash of the text, 0 where a doc_id has one row) tells apart
    rows that repeat a doc_id (``again``, if it was made before) with other texts; equal rows share one result. Null and short texts and empty tables have none; a null doc_id counts as the smallest
    long. Very long texts are read whole. Of each window of ``SHORTEST`` words the occurrence with the smallest (doc_id, version, position) stays
    whole. Other columns are not read.
    """
    # equal rows come with equal places: a set holds each once
    per = matches(documents, repeated_ids(documents) if again is None else again).groupBy("doc_id", "version").agg(F.collect_set(F.col("pos") * F.lit(2).cast("long") + F.col("first").cast("long")).alias("m"))

    def run(batches):
        for batch in batches:
            repeats, cuts = [], []
            offs, every = batch.column(2).offsets.to_numpy(), batch.column(2).flatten().to_numpy()
            for lo, hi in zip(offs[:-1] - offs[0], offs[1:] - offs[0], strict=True):
                m = np.sort(every[lo:hi])
                first = np.unique(m[m & 1 == 1] >> 1)
                repeats.append(merged(np.unique(m >> 1)))
                cuts.append(without(merged(np.setdiff1d(m >> 1, first)), merged(first)))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            both = [pa.array([[{"start": a, "end": z} for a, z in x] for x in s], kind) for s in (repeats, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *both], ["doc_id", "version", "repeats", "cuts"])

    return per.mapInArrow(textkit.frugal(run), "doc_id long, version long, repeats array<struct<start:int,end:int>>, cuts array<struct<start:int,end:int>>")


def cut_passages(documents: DataFrame) -> DataFrame:
    """``documents`` with their text less the passages to cut; a text that nothing is left of goes, and n_chars, if there, is counted anew.

    What counts is said at ``passages``. Null, empty and short texts and rows without doc_id and passages stay as they are; rows that repeat a
    doc_id are cut each by its own text, equal rows alike; very long texts are read whole; other columns stay, whatever their names; an
    empty table stays empty.
    """
    again = repeated_ids(documents)
    per, _ = work.store(passages(documents.select("doc_id", "text"), again).where(F.size("cuts") > 0).select(F.struct("doc_id", "version").alias("__at"), F.col("cuts").alias("__cuts")), "cuts")
    n = per.agg(F.coalesce(F.sum(F.size("__cuts")), F.lit(0)).alias("n")).first().n

    def cut(batches):
        for batch in batches:
            out = []
            for t, c in zip(batch.column(1), batch.column(2), strict=True):
                raw = np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                w = textkit.words(raw, np.array([0, len(raw)]), table=None)
                keep = np.ones(len(raw), bool)
                for x in c.as_py():
                    a, z = x["start"], x["end"]
                    keep[w.start[a] : w.start[z] if z < len(w.start) else len(raw)] = False
                out.append(raw[keep].tobytes().decode("utf-8", "replace").rstrip())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["__row", "__text"])

    names = [c for c in documents.columns if c != "text"]
    # all that stays is one struct, so that no column of it can clash
    rows = documents.select(F.struct(*[F.col(work.quoted(c)) for c in names]).alias("__row"), F.col("text").cast("string").alias("__text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("__doc"))
    rows = versioned(rows, again, "__doc", "__text", "__version").select("__row", "__text", F.struct(F.col("__doc").alias("doc_id"), F.col("__version").alias("version")).alias("__at"))
    joined = rows.join(F.broadcast(per) if n <= SMALL else per, "__at", "left")
    plain = joined.where(F.col("__cuts").isNull()).select("__row", "__text")
    some = joined.where(F.col("__cuts").isNotNull()).select("__row", "__text", "__cuts")
    less = some.mapInArrow(textkit.frugal(cut), some.drop("__cuts").schema).where(F.col("__text") != "")
    if "n_chars" in names:
        less = less.withColumn("__row", F.col("__row").withField("n_chars", F.length("__text").cast(documents.schema["n_chars"].dataType)))
    less, _ = work.store(less, "less")
    return plain.unionByName(less).select(*[F.col("__text").alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in documents.columns])


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages(work.read(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.exists("cuts", lambda c: (c["start"] < F.col("r.end")) & (c["end"] > F.col("r.start")))
    return rows.select("doc_id", "version", "cuts", F.explode("repeats").alias("r")).select(F.when(F.col("doc_id") != NONE, F.col("doc_id")).alias("doc_id"), F.col("r.start").alias("start_word"), F.col("r.end").alias("end_word"), cut.alias("repeats_earlier"))
