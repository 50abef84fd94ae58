"""Prefix trie of conversations by mergeable partial tries.

Turns are told by a digest of role and text. Conversations are sorted into ranges; each range emits a node table of its own, in which equal prefixes are
combined: members, the smallest of them, and the ids that end there as sorted chunks. Partial tables are merged by node in a tree of hash-keyed
rounds, and subtrees are summed bottom-up in rounds of doubling distance. A node is told by its depth and two 64-bit sums over its turns (place, digest), so
a conversation can be summed range by range, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, textkit, work

#: Partial tries merged by one task for a node; ids of one chunk of an end list.
FAN, CHUNK = 32, 4096
#: Rows that a partition combines before it emits what it has.
HELD_ROWS = 200_000
NODE = ["depth", "h1", "h2"]


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes) of all turns with a conv_id: 16 bytes that stand for role and text, and the text's length in UTF-8."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where(F.col("conv_id").isNotNull())


def parts_of(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def continued(rows: DataFrame, values: list[str]) -> dict[int, tuple[int, ...]]:
    """For each part whose first conversation began in an earlier one: (conversation, ``values`` carried there, modulo 2 ** 64).

    ``rows`` (part, conv_id, nth, values) are sorted ranges with values that run up to each row within its part. The driver gets a row for each part.
    """
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "nth", *values)).alias("last")).orderBy("part").collect()
    out, conv, sums = {}, None, [0] * len(values)
    for r in ends:
        if r.first == conv:
            out[r.part] = (conv, *sums)
        if r.last.conv_id != conv:
            sums = [0] * len(values)
        conv, sums = r.last.conv_id, [(a + r.last[v]) % (1 << 64) for a, v in zip(sums, values, strict=True)]
    return out


def _segments(conv: np.ndarray, before: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row begins a conversation, and the row that its conversation began with (-1: in an earlier batch, with conversation ``before``)."""
    new = np.ones(len(conv), bool)
    new[1:] = conv[1:] != conv[:-1]
    if len(conv) and before is not None and conv[0] == before:
        new[0] = False
    return new, np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, the 0-based place of a turn in its conversation: by turn, null first, then by digest. A conversation may lie in several ranges."""
    spark = turns.sparkSession

    def number(batches):
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            _, began = _segments(conv, last)
            at = np.arange(len(conv)) - began + np.where(began < 0, n - 1, 0)
            last, n = int(conv[-1]), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, np.int32)), batch.column(0), pa.array(at), pa.array(at + 1), batch.column(1), batch.column(2)], ["part", "conv_id", "nth", "count", "digest", "bytes"])

    stored, path = work.store(turns, "turns")
    order = ["conv_id", "turn", "digest", "__tie"]
    sorted_ = stored.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts_of(spark), *order).sortWithinPartitions(*order)
    rows, _ = work.store(sorted_.select("conv_id", "digest", "bytes").mapInArrow(textkit.frugal(number), "part int, conv_id long, nth long, count long, digest binary, bytes long"), "numbered")
    work.drop(spark, path)
    ahead = spark.createDataFrame([(p, c, n) for p, (c, n) in continued(rows, ["count"]).items()], "part int, conv_id long, ahead long")
    return rows.join(F.broadcast(ahead), ["part", "conv_id"], "left").select("conv_id", (F.col("nth") + F.coalesce("ahead", F.lit(0))).alias("pos"), "digest", "bytes")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, bytes, length) of all conversations: a row for each turn, from depth 1 on, and one of depth 0 for the root."""
    rows, _ = work.store(numbered(turns), "pos")
    convs, _ = work.store(rows.groupBy("conv_id").agg(F.count("*").alias("length")), "convs")
    own = rows.join(work.small(convs), "conv_id").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "bytes", "length")
    return own.unionByName(_roots(convs))


def _roots(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("0" * 32)).alias("digest"), F.lit(0).cast("long").alias("bytes"), "length")


def rebuilt(turns: DataFrame, block: int = 5, most: int = 9) -> DataFrame:
    """``paths`` of conversations rebuilt on a shared beginning: the first h turns of the one whose id is c - c % ``block`` (all if it has fewer, none if
    there is none), then c's own turns after its first h; h is crc32 of the decimal id, modulo ``most``."""
    rows, _ = work.store(numbered(turns), "pos")
    counts, _ = work.store(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    known = counts.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    bases = work.small(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")))
    took = F.least(F.col("h"), F.coalesce("base_n", F.lit(0).cast("long")))
    convs, _ = work.store(known.join(bases, "base", "left").select("conv_id", "base", "h", took.alias("took"), (took + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "convs")
    side = work.small(convs)
    own = rows.join(side.drop("base"), "conv_id").where("pos >= h").select("conv_id", (F.col("took") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "bytes", "length")
    heads = rows.where(F.col("pos") < most - 1).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    shared = heads.join(side.drop("h"), "base").where("pos < took").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "bytes", "length")
    return own.unionByName(shared).unionByName(_roots(convs))


def _terms(depth: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a turn adds to the two sums of a prefix: a mix of its place and digest; the root adds nothing."""
    a, b = digest[:, 0], digest[:, 1]
    d = depth.astype(np.uint64)
    one = textkit.paired(textkit.paired(a, b), d)
    two = textkit.paired(textkit.paired(b ^ np.uint64(0x5851F42D4C957F2D), a), ~d)
    return np.where(depth > 0, one, np.uint64(0)), np.where(depth > 0, two, np.uint64(0))


def _digests(column: pa.Array) -> np.ndarray:
    return graph.fixed_rows(column, 16).copy().view("<u8").reshape(-1, 2)


def summed(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, ...]]]:
    """(part, conv_id, nth, s1, s2, digest, bytes, last) of ``paths``, sorted into ranges, with the sums of the turns up to each row within its part; and
    what goes on from part to part (see ``continued``)."""

    def add(batches):
        from pyspark import TaskContext

        part, before, held = TaskContext.get().partitionId(), None, (np.uint64(0), np.uint64(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth, digest = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _digests(batch.column(2))
            _, began = _segments(conv, before)
            sums = []
            for term, ahead in zip(_terms(depth, digest), held, strict=True):
                run = np.cumsum(term, dtype=np.uint64)
                sums.append(run - np.where(began < 0, np.uint64(0) - ahead, (run - term)[np.maximum(began, 0)]))
            before, held = int(conv[-1]), (sums[0][-1], sums[1][-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, np.int32)), batch.column(0), batch.column(1), *(pa.array(s.view(np.int64)) for s in sums), batch.column(2), batch.column(3), pa.array(depth == batch.column(4).to_numpy())], ["part", "conv_id", "nth", "s1", "s2", "digest", "bytes", "last"])

    order = ["conv_id", "depth"]
    stored, path = work.store(rows, "paths")
    sorted_ = stored.repartitionByRange(parts_of(rows.sparkSession), *order).sortWithinPartitions(*order)
    out, _ = work.store(sorted_.select("conv_id", "depth", "digest", "bytes", "length").mapInArrow(textkit.frugal(add), "part int, conv_id long, nth long, s1 long, s2 long, digest binary, bytes long, last boolean"), "sums")
    work.drop(rows.sparkSession, path)
    return out, continued(out, ["s1", "s2"])


def partial_tries(sums: DataFrame, ahead: dict[int, tuple[int, ...]]) -> DataFrame:
    """(part, depth, h1, h2, p1, p2, digest, bytes, n, least, ids): the node table of each part, in which a prefix has one row; p1, p2: its parent's
    sums; ids: members that end at it, sorted. More than ``CHUNK`` of them go on in rows with n = 0, and a part of more than ``HELD_ROWS`` rows emits several
    tables, of conversations in order."""
    shared = sums.sparkSession.sparkContext.broadcast(ahead)
    names = ["part", "depth", "h1", "h2", "p1", "p2", "digest", "bytes", "n", "least", "ids"]

    def emit(part: int, held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        order = np.lexsort((x["conv"], x["depth"], x["h2"], x["h1"]))
        x = {k: v[order] for k, v in x.items()}
        new = np.ones(len(order), bool)
        new[1:] = (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1]) | (x["depth"][1:] != x["depth"][:-1])
        at = np.flatnonzero(new)
        ended = np.concatenate([[0], np.cumsum(x["last"])])
        lo, hi = ended[at], ended[np.append(at[1:], len(order))]
        ids, rows = x["conv"][x["last"]], -(-np.maximum(hi - lo, 1) // CHUNK)
        node = np.repeat(np.arange(len(at)), rows)
        k = np.arange(len(node)) - np.repeat(np.cumsum(rows) - rows, rows)
        begin = lo[node] + k * CHUNK
        end = np.minimum(begin + CHUNK, hi[node])
        offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
        n = np.where(k == 0, np.diff(np.append(at, len(order)))[node], 0)
        column = lambda c: pa.array(x[c][at][node])
        digest = pa.array([d.tobytes() for d in x["digest"][at]], pa.binary()).take(pa.array(node))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), part, np.int32)), column("depth"), *(pa.array(x[c][at][node].view(np.int64)) for c in ("h1", "h2", "p1", "p2")), digest, column("bytes"), pa.array(n), column("conv"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names)

    def build(batches):
        held, count, part = [], 0, None
        for whole in batches:
            where = whole.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]]) if len(where) else np.zeros(1, int)
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                batch = whole.slice(a, z - a)
                if held and (int(where[a]) != part or count + z - a > HELD_ROWS):
                    yield from emit(part, held)
                    held, count = [], 0
                part = int(where[a])
                conv, depth, digest = batch.column(1).to_numpy(), batch.column(2).to_numpy(), _digests(batch.column(5))
                more = shared.value.get(part)
                h = [batch.column(i).to_numpy().view(np.uint64) + (np.where(conv == more[0], np.uint64(more[i - 2]), np.uint64(0)) if more else np.uint64(0)) for i in (3, 4)]
                terms = _terms(depth, digest)
                held.append({"conv": conv, "depth": depth, "h1": h[0], "h2": h[1], "p1": h[0] - terms[0], "p2": h[1] - terms[1], "digest": digest, "bytes": batch.column(6).to_numpy(), "last": batch.column(7).to_numpy(zero_copy_only=False)})
                count += z - a
        if held:
            yield from emit(part, held)

    return sums.mapInArrow(textkit.frugal(build), "part int, depth long, h1 long, h2 long, p1 long, p2 long, digest binary, bytes long, n long, least long, ids array<long>")


def merged(partial: DataFrame) -> DataFrame:
    """(depth, h1, h2, p1, p2, digest, bytes, n, least): the partial tables' nodes, merged by node over ``FAN`` neighbouring parts a round, so that a node that
    all parts have costs no task more than ``FAN`` rows."""
    top = int(partial.agg(F.coalesce(F.max("part"), F.lit(0)).alias("p")).first().p)
    rows = partial.withColumn("group", F.col("part"))
    sums = [F.max(c).alias(c) for c in ("p1", "p2", "digest", "bytes")] + [F.sum("n").alias("n"), F.min("least").alias("least")]
    while True:
        top //= FAN
        rows = rows.groupBy(*NODE, F.floor(F.col("group") / FAN).cast("int").alias("group")).agg(*sums)
        if top == 0:
            return rows.drop("group")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, leaves, saved) summed over the subtrees of ``nodes`` (conv_id, depth, up, leaves, saved); ``up``: the parent's conv_id.

    Each round adds to a node what the nodes at a distance of ``step`` below it have summed so far, and doubles the step: as many rounds as the depth has bits.
    """
    deepest = int(nodes.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first().d)
    step, path = 1, None
    while step <= deepest:
        below = nodes.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("plus"))
        above = nodes.select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("next"))
        zero = F.lit(0).cast("long")
        now = nodes.join(below, ["conv_id", "depth"], "left").join(above, ["up", "depth"], "left")
        new, new_path = work.store(now.select("conv_id", "depth", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more", zero)).alias("leaves"), (F.col("saved") + F.coalesce("plus", zero)).alias("saved")), "rollup")
        if path:
            work.drop(nodes.sparkSession, path)
        nodes, path, step = new, new_path, 2 * step
    return nodes.select("conv_id", "depth", "leaves", "saved")


@dataclass
class Trie:
    """``nodes`` (conv_id, depth, parent_conv_id, digest, n_convs, n_children, n_leaves, saved_tokens): a node is told by its smallest member and depth.
    ``ends`` (conv_id, depth, least, ids): the members that end at a node, in sorted chunks of at most ``CHUNK`` ids that follow each other by ``least``."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(rows: DataFrame) -> Trie:
    """The trie of ``paths`` or ``rebuilt`` conversations.

    Null turns come first, turns that tie go by digest, repeated rows are turns of their own, null roles and texts are empty; rows without conv_id belong to no conversation and
    are left out; other columns are not read; very long texts are digested whole; an empty table gives empty tables. saved_tokens counts the
    UTF-8 bytes of the last text of each node once for each member but one, over the subtree.
    """
    spark = rows.sparkSession
    sums, ahead = summed(rows)
    partial, _ = work.store(partial_tries(sums, ahead), "partial")
    nodes, nodes_path = work.store(merged(partial), "merged")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("least").alias("parent_conv_id"))
    known, _ = work.store(nodes.join(up, ["depth", "p1", "p2"], "left").select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", "digest", "bytes", F.col("n").alias("n_convs"), "h1", "h2"), "nodes")
    work.drop(spark, nodes_path)
    children = known.where(F.col("parent_conv_id").isNotNull()).groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    counted, _ = work.store(known.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "children")
    start = counted.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = rolled_up(start)
    out = counted.join(totals, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "digest", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ends = partial.where(F.size("ids") > 0).join(known.select("conv_id", *NODE), NODE).select("conv_id", "depth", F.get("ids", F.lit(0)).alias("least"), "ids")
    return Trie(out, ends)


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, sha256) of the comma-joined ids that end at each node. A digest is one sequence by its definition; its chunks are streamed, so
    no list is held whole."""

    def digest(batches):
        key, state = None, None
        for batch in batches:
            keys, hashes = [], []
            for c, d, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (c, d) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        keys.append(key)
                        hashes.append(state.hexdigest())
                    key, state = (c, d), hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "depth", "sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["conv_id", "depth", "sha256"])

    joined = ends.select("conv_id", "depth", "least", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))
    sorted_ = joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "least").select("conv_id", "depth", "text")
    return sorted_.mapInArrow(textkit.frugal(digest), "conv_id long, depth long, sha256 string")


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with the role and text of their last turn (null at the root), found by its digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = conversations.select(F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"), role.alias("role"), text.alias("text"))
    asked = said.join(nodes.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return nodes.join(asked, "digest", "left")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_digests(work.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    trie = prefix_trie(rebuilt(turns))
    digests, _ = work.store(end_digests(trie.ends), "digests")
    sha = F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return trie.nodes.join(digests, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha)


OP12_SQL = r"""
WITH o AS (SELECT conv_id, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg, strlen(coalesce(text, '')) AS bytes,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
    lambda s, b: list_reduce(list_prepend(xor(s, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h FROM o GROUP BY conv_id),
c AS (SELECT k.conv_id, k.base, k.h, least(k.h, coalesce(b.n, 0)) AS took FROM k LEFT JOIN k b ON b.conv_id = k.base),
r AS (SELECT o.conv_id, c.took + o.pos - c.h + 1 AS depth, dg, bytes FROM o JOIN c USING (conv_id) WHERE o.pos >= c.h
  UNION ALL SELECT c.conv_id, o.pos + 1, dg, bytes FROM o JOIN c ON c.base = o.conv_id WHERE o.pos < c.took),
p AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS bytes FROM k
  UNION ALL SELECT conv_id, depth, string_agg(dg, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), bytes FROM r),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM p JOIN l USING (conv_id, depth) GROUP BY 1),
n AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY path),
ch AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT left(u.path, 32 * d) AS path, count(*) FILTER (ch.n_children IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n) u LEFT JOIN ch ON ch.path = u.path GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(ch.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM n LEFT JOIN n q ON n.depth > 0 AND q.path = left(n.path, 32 * (n.depth - 1)) LEFT JOIN ch ON ch.path = n.path JOIN s ON s.path = n.path LEFT JOIN e ON e.path = n.path
"""
