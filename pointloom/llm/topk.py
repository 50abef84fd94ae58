"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit, work

#: Candidates of the best bounds that are read before the others are judged by what these score.
FIRST = 512


def chosen(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if s.dtype == object:
        return np.array(sorted(range(len(s)), key=lambda j: (-s[j], ids[j]))[:k], np.int64)
    return np.lexsort((ids, -s))[:k]


def exact_type(width: int, q: float, c: float):
    """A type in which inner products of whole numbers up to ``q`` and ``c`` in size, ``width`` of them, are exact."""
    most = width * q * c
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def as_exact(x: np.ndarray, kind) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if kind is object else x.astype(kind)


def exact_block(q: np.ndarray, qd: np.ndarray, qq: float, c: np.ndarray, cd: np.ndarray, half: np.ndarray, cid: np.ndarray, qid: int, k: int, least: float = -np.inf, first: int = FIRST) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of candidates ``c`` for one query that score ``least`` or more, and how many were read.

    For a pivot p, |d(q, p) - d(c, p)| <= d(q, c) (``cd`` has a row for each pivot); the largest over all pivots bounds the distance from
    below, so the score (|q|^2 + |c|^2 - d^2) / 2 from above (``half``: |c|^2 / 2). Candidates are read in the order of that bound: the
    ``first`` best ones, then all whose bound isn't under the k-th score so far; none after them can enter.
    """
    low, gap = np.zeros(len(cid), cd.dtype), np.empty(len(cid), cd.dtype)
    for row, d in zip(cd, qd, strict=True):
        np.subtract(row, d, out=gap)
        np.abs(gap, out=gap)
        np.maximum(low, gap, out=low)
    size = half + qq / 2
    bound = size - 0.5 * low * low + (1e-5 if cd.dtype == np.float32 else 1e-9) * size  # rounding errors follow the size
    bound[cid == qid] = -np.inf
    alive = np.flatnonzero((bound >= least) & (bound > -np.inf))
    head = alive[np.argpartition(-bound[alive], first)[:first]] if len(alive) > first else alive
    s, i, n = c[head] @ q, cid[head], len(head)
    ok = s >= least if len(s) else np.zeros(0, bool)
    s, i = s[ok], i[ok]
    top = chosen(s, i, k)
    s, i = s[top], i[top]
    if len(alive) > first:
        if len(s) >= k:
            least = max(least, s[-1])
        rest = bound >= least
        rest[head] = False
        left = np.flatnonzero(rest & (bound > -np.inf))
        n += len(left)
        more = (c @ q)[left] if c.dtype != object and 2 * len(left) > len(cid) else c[left] @ q
        ok = more >= least if len(more) else np.zeros(0, bool)
        s, i = np.concatenate([s, more[ok]]), np.concatenate([i, cid[left][ok]])
        top = chosen(s, i, k)
        s, i = s[top], i[top]
    return [(min(max(int(x), -(1 << 63)), (1 << 63) - 1), int(y)) for x, y in zip(s, i, strict=True)], n


def matrix(column, wide, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    out = np.zeros((len(column), width))
    for i, (b, w) in enumerate(zip(column, wide, strict=True)):
        a = np.frombuffer(b, np.float64 if w else np.float32)
        out[i, : len(a)] = a
    return out


def compare(qs: pd.DataFrame, cs: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score, own): the best of one block of candidates for the queries (vec_id, v, wide, d, own, least) of another."""
    out = []
    if len(qs) and len(cs):
        width = max(len(b) // (8 if w else 4) for f in (qs, cs) for b, w in zip(f["v"], f["wide"], strict=True))
        q, c = matrix(qs["v"], qs["wide"], width), matrix(cs["v"], cs["wide"], width)
        kind = exact_type(width, np.abs(q).max(initial=0), np.abs(c).max(initial=0))
        near = np.float32 if kind is np.float32 else np.float64
        qd, cd = (np.array([np.frombuffer(b) for b in f["d"]]).astype(near) for f in (qs, cs))
        cd, cid = np.ascontiguousarray(cd.T), cs["vec_id"].to_numpy()
        half, qq = (np.einsum("ij,ij->i", c, c) / 2).astype(near), np.einsum("ij,ij->i", q, q)
        q, c = as_exact(q, kind), as_exact(c, kind)
        for j, (qid, own, least) in enumerate(zip(qs["vec_id"], qs["own"], qs["least"], strict=True)):
            hits, _ = exact_block(q[j], qd[j], float(qq[j]), c, cd, half, cid, int(qid), k, -np.inf if pd.isna(least) else least)
            out += [(int(qid), i, s, int(own)) for s, i in hits]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "own"])


FOUND = "query_id long, vec_id long, score long, own long"


def ranges(rows: DataFrame, block: str, *extra) -> DataFrame:
    """(block, low, high, most, ...): the least and the largest distance to each pivot in a block, the largest |v|^2 / 2, and ``extra`` sums."""

    def part(batches):
        for batch in batches:
            f = pa.Table.from_batches([batch]).to_pandas()
            for key, own in f.groupby(block):
                d = np.array([np.frombuffer(b) for b in own["d"]])
                for p in range(d.shape[1]):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([key], pa.int64()), "p": pa.array([p], pa.int32()), "low": [d[:, p].min()], "high": [d[:, p].max()], "most": [own["half"].max()]})

    each = rows.select(block, "d", "half").mapInArrow(textkit.frugal(part), "block long, p int, low double, high double, most double")
    each = each.groupBy("block", "p").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("most").alias("most"))
    # one entry for each pivot
    sums = each.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("r"), F.max("most").alias("most"))
    return sums.select("block", F.col("r.low").alias("low"), F.col("r.high").alias("high"), "most")


def top_k(vectors: DataFrame, query_mod: int = 20, k: int = 20, pivots: int = 16, query_block: int = 2048, candidate_block: int = 8192, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with vec_id divisible by ``query_mod`` its k best among all other rows.

    Score: inner product of floor(scale * x), exact at any size; what doesn't fit a long is held at its ends. Ties go to the smaller vec_id.
    Vectors that are null, hold null or non-finite components, and rows without a vec_id take no part. Shorter vectors count as padded with
    zeros. Rows with a repeated vec_id are each candidates of the others' queries, never of a query of their own id; a repeated
    query id is asked once, with its smallest vector. Empty tables give an empty result; other columns are not read.

    Candidates lie in blocks by their nearest pivot and the distance to it. A query is first compared with the block that it lies in itself; its
    k-th score there goes with it to the other blocks. A block of queries meets a block of candidates only if, by their ranges of distances to
    the pivots, the least of these k-th scores can be reached; within a block candidates are read in the order of their bounds.
    """
    spark = vectors.sparkSession
    size = lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("double")
    # floor() of a double is a long in SQL: what is beyond has no fraction
    x = F.transform("embedding", lambda e: F.when(F.abs(F.lit(scale) * e.cast("double")) < float(1 << 53), size(e)).otherwise(F.lit(scale) * e.cast("double")))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    some = [np.array(r.x) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(pivots).collect()]
    n = rows.count()
    width = max((len(p) for p in some), default=0)
    table = spark.sparkContext.broadcast(np.array([np.pad(p, (0, width - len(p))) for p in some]).reshape(len(some), width))

    def with_distances(batches):
        piv = table.value
        for pdf in batches:
            vs = [np.asarray(a, float) for a in pdf["x"]]
            w = max([piv.shape[1], *map(len, vs)])
            at = np.pad(piv, ((0, 0), (0, w - piv.shape[1])))
            ds = [np.sqrt(((np.pad(v, (0, w - len(v))) - at) ** 2).sum(1)) for v in vs]
            wide = [bool(np.abs(v).max(initial=0) >= 1 << 24) for v in vs]
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"], "v": [v.tobytes() if w else v.astype(np.float32).tobytes() for v, w in zip(vs, wide, strict=True)], "wide": wide, "d": [d.tobytes() for d in ds],
                "cell": [int(d.argmin()) for d in ds], "near": [float(d.min()) for d in ds], "half": [float(v @ v) / 2 for v in vs],
            })

    known = rows.mapInPandas(with_distances, "vec_id long, v binary, wide boolean, d binary, cell int, near double, half double")
    dealt = known.repartitionByRange(max(1, -(-n // candidate_block)), "cell", "near", F.xxhash64("vec_id", "v"), "vec_id")
    known, _ = work.store(dealt.select("vec_id", "v", "wide", "d", "half", F.spark_partition_id().cast("long").alias("own")), "vectors")
    query = F.struct("v", "wide", "d", "half", "own")
    asked = known.where(F.col("vec_id") % query_mod == 0).groupBy("vec_id").agg(F.min(query).alias("m")).select("vec_id", "m.*")
    asked, _ = work.store(asked, "queries")
    right = known.select("vec_id", "v", "wide", "d", "own")
    none = F.lit(None).cast("long").alias("least")
    at_home = asked.select("vec_id", "v", "wide", "d", "own", none).groupBy("own").cogroup(right.groupBy("own"))
    home, _ = work.store(at_home.applyInPandas(lambda qs, cs: compare(qs, cs, k), FOUND), "home")
    # a query's k-th score at home bounds what others must reach
    least = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).withColumnRenamed("query_id", "vec_id")
    span = max(1, query_block * query_mod // candidate_block)
    asked, _ = work.store(asked.join(least, "vec_id", "left").withColumn("qb", F.floor(F.col("own") / span)), "asked")
    blocks, _ = work.store(ranges(known, "own").withColumnRenamed("block", "cb"), "blocks")
    groups = ranges(asked, "qb").join(asked.groupBy(F.col("qb").alias("block")).agg(F.min(F.coalesce("least", F.lit(-(1 << 63)))).alias("least")), "block")
    groups = groups.select(F.col("block").alias("qb"), F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("most").alias("q_most"), "least")
    last = int(blocks.agg(F.coalesce(F.max("cb"), F.lit(0)).alias("n")).first().n)
    met = groups.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<long>"))).join(work.small(blocks), "cb")
    gaps = F.zip_with(F.zip_with("low", "q_high", lambda a, b: a - b), F.zip_with("q_low", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    gap = F.aggregate(gaps, F.lit(0.0), lambda a, g: F.greatest(a, g))
    both = F.col("q_most") + F.col("most")
    pairs, _ = work.store(met.where(both - 0.5 * gap * gap + 1e-9 * both >= F.col("least")).select("qb", "cb"), "pairs")
    left = asked.join(work.small(pairs), "qb").where(F.col("cb") != F.col("own")).select("qb", "cb", "vec_id", "v", "wide", "d", "own", "least")
    others = known.select(F.col("own").alias("cb"), "vec_id", "v", "wide", "d").join(work.small(pairs), "cb").select("qb", "cb", "vec_id", "v", "wide", "d")
    away = left.groupBy("qb", "cb").cogroup(others.groupBy("qb", "cb")).applyInPandas(lambda qs, cs: compare(qs, cs, k), FOUND)
    # each block gives k rows of a query at most; sorting a query's rows is bounded by k for each block
    best = home.unionByName(away).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("neg"), "vec_id"))), 1, k).alias("top"))
    out = best.select("query_id", F.posexplode("top").alias("pos", "t"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.neg")).cast("long").alias("score"))


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(work.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
