"""Near-duplicates by chosen-path set similarity join, confirmed on full shingle sets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, textkit, work

SHINGLE, PERCENT = 5, 75
#: Minwise tokens of a set; independent trees; levels that are branched before nodes are counted.
COORDINATES, TREES, DEPTH = 128, 12, 3
#: Sets up to which a node is compared exhaustively; rounds of branching of larger ones, and the levels of a round.
NODE, ROUNDS, LEVELS = 256, 10, 2
#: Estimated similarity (its standard error is 0.04) from which two sets of a small node are put in one cluster for the exact join; from which
#: a set joins the cluster of a large node's first; and from which it needs no further branching: by the triangle inequality of
#: Jaccard distances, what is as similar as asked to a set at distance d from the first is at distance d + 0.25 from it at most.
NEAR, LOOSE, CORE = 0.55, 0.38, 0.7
#: Shingles (8 bytes each) that a task of the exact join holds on a side, a set counting at least ``WEIGHT >> 10``, so that it holds 1024 sets at
#: most; rows of six numbers up to which they are broadcast.
WEIGHT, SMALL = 1 << 20, 300_000
#: What stands for a null doc_id inside.
NONE = -(1 << 63)

_rng = np.random.default_rng(7)
_MUL = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def minwise(s: np.ndarray) -> np.ndarray:
    """The set's ``COORDINATES`` minwise tokens."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 256):
        np.minimum(out, ((s[None, a : a + 256] ^ _XOR[:, None]) * _MUL[:, None]).min(1), out=out)
    return out


def children(node: np.ndarray, tokens: np.ndarray, always: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes (one for each row of ``tokens``): (row, child node). A node branches on one coordinate that it chooses, and on a
    second one in a third of the cases, so that a pair of similarity 0.75 shares one child of a shared node on average; or ``always`` on
    both, so that it shares 1.5 and, once there, is lost in a ninth of the nodes at most, however deep they go."""
    h = textkit.mix(node ^ np.uint64(0xA0761D6478BD642F))
    first = (h >> np.uint64(8)) % np.uint64(COORDINATES)
    second = (first + np.uint64(1) + (h >> np.uint64(24)) % np.uint64(COORDINATES - 1)) % np.uint64(COORDINATES)
    twice = np.arange(len(node)) if always else np.flatnonzero((h >> np.uint64(48)) % np.uint64(3) == 0)
    row = np.concatenate([np.arange(len(node)), twice])
    which = np.concatenate([first, second[twice]]).astype(np.int64)
    return row, textkit.mix(textkit.mix(h[row] + which.astype(np.uint64)) ^ tokens[row, which])


def leaves(tokens: np.ndarray) -> np.ndarray:
    """Nodes at depth ``DEPTH`` of a set in all trees."""
    node = textkit.mix(np.arange(1, TREES + 1, dtype=np.uint64))
    for _ in range(DEPTH):
        _, node = children(node, np.broadcast_to(tokens, (len(node), COORDINATES)))
    return np.unique(node)


def keyed(documents: DataFrame) -> DataFrame:
    """(absent, doc_id, version, text): rows are told apart by doc_id, if there, and a hash of the text."""
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return documents.select(doc.isNull().alias("absent"), F.coalesce(doc, F.lit(NONE)).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("version"), text.alias("text"))


def names(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    return tuple(int(textkit.mix(s ^ np.uint64(x)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for x in (0, 0x5851F42D4C957F2D))


def signatures(docs: DataFrame) -> DataFrame:
    """(absent, doc_id, version, n_shingles, set, set2, sig, nodes): the set's names, a byte of each minwise token, and nodes."""

    def run(batches):
        for batch in batches:
            data, offs = textkit.text_buffers(batch.column(3))
            n, a, b, sig, nodes = [], [], [], [], []
            for s in textkit.shingle_sets(data, offs, SHINGLE):
                n.append(len(s))
                x, y = names(s)
                a.append(x)
                b.append(y)
                t = minwise(s)
                sig.append((t >> np.uint64(17)).astype(np.uint8).tobytes())
                nodes.append(leaves(t).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], ["absent", "doc_id", "version", "n_shingles", "set", "set2", "sig", "nodes"])

    return docs.mapInArrow(textkit.frugal(run), "absent boolean, doc_id long, version long, n_shingles long, set long, set2 long, sig binary, nodes array<long>")


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of bytes; one in 256 agrees by chance."""
    return ((x == y).sum(-1) / COORDINATES - 1 / 256) / (1 - 1 / 256)


def compare_nodes(batches):
    """Sorted (node, id, sig) of small nodes: an edge from each set to the first of its estimated cluster in the node."""
    for t, at in graph.runs(batches):
        ids, sig = t.column(1).to_numpy(), graph.fixed_rows(t.column(2), COORDINATES)
        size = np.diff(at)
        two = at[:-1][size == 2]
        two = two[_alike(sig[two], sig[two + 1]) >= NEAR] if len(two) else two
        a, b = [ids[two]], [ids[two + 1]]
        for lo, m in zip(at[:-1][size > 2], size[size > 2], strict=True):
            s = sig[lo : lo + m]
            near = _alike(s[:, None], s[None]) >= NEAR
            label = np.arange(m)
            while True:
                new = np.where(near, label[None], m).min(1)
                new = np.minimum(new, new[new])
                if (new == label).all():
                    break
                label = new
            other = np.flatnonzero(label != np.arange(m))
            a.append(ids[lo + other])
            b.append(ids[lo + label[other]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def compare_first(batches):
    """(node, id, sig, first id, first sig) of large nodes: (node, id, sig, first, like), with the estimated similarity to the first."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        like = _alike(graph.fixed_rows(t.column(2), COORDINATES), graph.fixed_rows(t.column(4), COORDINATES)) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(like, pa.float64())], ["node", "id", "sig", "first", "like"])


def branch(batches):
    """(node, id, sig) to the (child, id, sig) that are ``LEVELS`` further down."""
    for batch in batches:
        if batch.num_rows:
            node, row = batch.column(0).to_numpy().view(np.uint64), np.arange(batch.num_rows)
            tokens = graph.fixed_rows(batch.column(2), COORDINATES).astype(np.uint64)
            for _ in range(LEVELS):
                up, node = children(node, tokens[row], True)
                row = row[up]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(1).take(at), batch.column(2).take(at)], ["node", "id", "sig"])


def clusters(sets: DataFrame) -> DataFrame:
    """(id, root): clusters of ``sets`` (id, sig, nodes) outside which no set is as similar as asked, but for a tree recall of over 0.9999.

    Small nodes are compared exhaustively. In a large one all sets are compared with one of them; if some are far from it, they and all that may
    be partners of theirs branch on. What still is large after ``ROUNDS`` is linked as it is: clusters may be too wide, never too narrow.
    """
    spark, parts = sets.sparkSession, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sigs = sets.select("id", "sig")
    members = sets.select(F.explode("nodes").alias("node"), "id")
    edges, smalls, scratch, with_sig = [], [], [], False
    for turn in range(ROUNDS):
        counts = members.groupBy("node").agg(F.count("*").alias("n")).where("n >= 2")
        shared = members.join(counts, "node")
        if not with_sig:
            shared = shared.join(sigs, "id")
        shared, path = work.store(shared.select("node", "id", "sig", "n"), "nodes")
        scratch.append(path)
        smalls.append(shared.where(F.col("n") <= NODE).select("node", "id", "sig"))
        large = shared.where(F.col("n") > NODE)
        if not shared.agg(F.count_if(F.col("n") > NODE).alias("k")).first().k:
            break
        first = large.groupBy("node").agg(F.min(F.struct(F.xxhash64("node", "id").alias("h"), "id", "sig")).alias("f")).select("node", F.col("f.id").alias("first"), F.col("f.sig").alias("first_sig"))
        met = large.select("node", "id", "sig").join(first, "node").select("node", "id", "sig", "first", "first_sig")
        met, path = work.store(met.mapInArrow(textkit.frugal(compare_first), "node long, id long, sig binary, first long, like double"), "met")
        scratch.append(path)
        near = F.lit(True) if turn == ROUNDS - 1 else F.col("like") >= LOOSE
        edges.append(met.where(near & (F.col("id") != F.col("first"))).select(F.col("id").alias("a"), F.col("first").alias("b")))
        # in a node with sets far from its first, these look for partners among those that may be as similar as asked to one of them: what is so
        # to a set at similarity s to the first is at s + 0.25 at most itself, and CORE - LOOSE leaves room for errors of the estimates
        if turn == ROUNDS - 1 or not met.agg(F.count_if(~near).alias("k")).first().k:
            break
        apart = met.where(~near).groupBy("node").agg(F.max("like").alias("far"))
        on = met.join(apart, "node").where((F.col("like") < F.col("far") + (CORE - LOOSE)) & (F.col("id") != F.col("first"))).select("node", "id", "sig")
        members, with_sig = on.mapInArrow(textkit.frugal(branch), "node long, id long, sig binary").dropDuplicates(["node", "id"]), True
    small = reduce(DataFrame.unionByName, smalls).repartition(parts, "node").sortWithinPartitions("node", "id")
    edges.append(small.mapInArrow(textkit.frugal(compare_nodes), "a long, b long"))
    roots = graph.components(reduce(DataFrame.unionByName, edges))
    work.drop(spark, *scratch)
    return roots


def full_sets(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """(root, id, n, words): the shingle set of each ``chosen`` (doc_id, version, id, root), read from the whole texts."""
    picked = docs.join(F.broadcast(chosen) if n <= SMALL else chosen, ["doc_id", "version"]).select("root", "id", "text")

    def run(batches):
        for batch in batches:
            data, offs = textkit.text_buffers(batch.column(2))
            for lo, hi in textkit.slices(offs):
                sets = list(textkit.shingle_sets(data, offs[lo : hi + 1], SHINGLE))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(list(map(len, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["root", "id", "n", "words"])

    return picked.mapInArrow(textkit.frugal(run), "root long, id long, n long, words binary").dropDuplicates(["id"])


def exact_links(batches):
    """Sorted (block, id, known, words): an edge from each set to another that it is linked with, one for each component of the block.

    ``known`` sets already are in one component. Sets are compared with all of other components until none is left.
    """
    for t, at in graph.runs(batches):
        ids_all, known_all, words_all = t.column(1).to_numpy(), t.column(2).to_numpy(zero_copy_only=False) if isinstance(t.column(2), pa.Array) else t.column(2).to_numpy(), t.column(3)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            ids, known = ids_all[lo:hi], known_all[lo:hi]
            sets = graph.binary_rows(words_all.slice(int(lo), int(hi - lo)), np.uint64)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            values, code = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(n)
            label = np.arange(len(sets))
            if known.any():
                label[known] = np.flatnonzero(known)[0]
            a, b, has = [], [], np.zeros(len(values), bool)
            for i in range(len(sets)):
                others = label != label[i]
                others[: i + 1] = False
                others &= (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i]))
                j = np.flatnonzero(others)
                if not len(j):
                    continue
                has[code[ends[i] - n[i] : ends[i]]] = True
                take = np.concatenate([np.arange(ends[x] - n[x], ends[x]) for x in j])
                both = np.add.reduceat(has[code[take]].astype(np.int64), np.cumsum(n[j]) - n[j])
                has[code[ends[i] - n[i] : ends[i]]] = False
                for x in j[100 * both >= PERCENT * (n[i] + n[j] - both)]:
                    if label[x] != label[i]:
                        a.append(ids[x])
                        b.append(ids[i])
                        label[label == label[x]] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def to_first(batches):
    """(root, id, words, first, first words): similarity of each set and the cluster's first one."""
    for batch in batches:
        j = []
        for x, y in zip(batch.column(2), batch.column(4), strict=True):
            s, f = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(s, f, assume_unique=True))
            j.append((both, len(s) + len(f) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array([x for x, _ in j], pa.int64()), pa.array([y for _, y in j], pa.int64())], ["root", "id", "first", "both", "either"])


def confirmed(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between ``sets`` (root, id, n, words) that join the sets of a cluster that are linked, directly or not.

    A cluster of up to ``WEIGHT`` shingles and 1024 sets is one block. In a larger one all sets are first compared with one of them; if all are linked with
    it, that is all. Else those that are not, and those of the others that are far enough from the first to be linked with one of them, are
    compared in pairs of blocks.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.sum(F.greatest("n", F.lit(max(1, WEIGHT >> 10))))
    sizes = sets.groupBy("root").agg(weight.alias("weight"))
    sized, _ = work.store(sets.join(sizes, "root"), "sets")
    small = sized.where(F.col("weight") <= WEIGHT).select(F.col("root").alias("block"), "id", F.lit(False).alias("known"), "words")
    large = sized.where(F.col("weight") > WEIGHT)
    extra = None
    if not large.isEmpty():
        first = large.groupBy("root").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "words")).alias("f")).select("root", F.col("f.id").alias("first"), F.col("f.words").alias("first_words"))
        met = large.select("root", "id", "words").join(first, "root").select("root", "id", "words", "first", "first_words").mapInArrow(textkit.frugal(to_first), "root long, id long, first long, both long, either long")
        met, _ = work.store(met.withColumn("linked", 100 * F.col("both") >= PERCENT * F.col("either")), "first")
        extra = met.where(F.col("linked") & (F.col("id") != F.col("first"))).select(F.col("id").alias("a"), F.col("first").alias("b"))
        far = met.where(~F.col("linked")).groupBy("root").agg(F.max(F.col("both") / F.col("either")).alias("nearest"))
        rest = met.join(far, "root").where(~F.col("linked") | (F.col("both") / F.col("either") <= F.col("nearest") + (1 - PERCENT / 100) + 1e-9)).select("root", "id", "linked")
        left = large.select("root", "id", "n", "words").join(rest, ["root", "id"])
        left, _ = work.store(left, "rest")
        blocks = left.groupBy("root").agg(F.ceil(weight / WEIGHT).cast("int").alias("nb"))
        dealt = left.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        pair = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
        small = small.unionByName(dealt.select(pair.alias("block"), "id", F.col("linked").alias("known"), "words"))
    links = small.repartition(parts, "block").sortWithinPartitions("block", "id").mapInArrow(textkit.frugal(exact_links), "a long, b long")
    return links if extra is None else links.unionByName(extra)


def memberships(docs: DataFrame) -> DataFrame:
    """(absent, doc_id, version, n_shingles, first) of every row of ``docs`` (see ``keyed``); first: the smallest (absent, doc_id, version) of the
    row's component, null without shingles."""
    known, _ = work.store(signatures(docs), "signatures")
    row = F.struct("absent", "doc_id", "version")
    met = known.where("n_shingles > 0").groupBy("set", "set2").agg(F.min(F.struct(row.alias("row"), "sig", "nodes")).alias("m"))
    # equal sets are one node from here on; its number is written down with it
    sets, _ = work.store(met.select(F.monotonically_increasing_id().alias("id"), "set", "set2", F.col("m.row").alias("row"), F.col("m.sig").alias("sig"), F.col("m.nodes").alias("nodes")), "distinct")
    roots, _ = work.store(clusters(sets).join(sets.select("id", F.col("row.doc_id").alias("doc_id"), F.col("row.version").alias("version")), "id"), "clusters")
    links, _ = work.store(confirmed(full_sets(docs, roots.select("doc_id", "version", "id", "root"), roots.count())), "links")
    linked = graph.components(links).join(sets.select("id", "row"), "id")
    named = linked.join(linked.groupBy("root").agg(F.min("row").alias("component")), "root").select("id", "component")
    every, _ = work.store(sets.select("id", "set", "set2", "row").join(named, "id", "left").select("set", "set2", F.coalesce("component", "row").alias("first")), "components")
    has = F.col("n_shingles") > 0
    rows = known.select("absent", "doc_id", "version", "n_shingles", F.when(has, F.col("set")).alias("set"), F.when(has, F.col("set2")).alias("set2"))
    return rows.join(every, ["set", "set2"], "left").select("absent", "doc_id", "version", "n_shingles", "first")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``documents`` (doc_id, text).

    Sets of distinct 5-word shingles (A-Z lower-cased) are linked from a Jaccard similarity of 0.75 on. Fewer than 5 words: one shingle; null,
    empty or blank: none and no link. Very long texts are read whole. Equal sets, by 128 bits, are one node of all work. A row without a
    doc_id links others, keeps none as component and isn't kept; rows that repeat a doc_id are judged each by its own text and all have
    ``kept`` if it is their component's. An empty table gives an empty result; other columns are not read.
    """
    rows = memberships(keyed(documents))
    doc = F.when(~F.col("absent"), F.col("doc_id"))
    first = F.when(F.col("first").isNull(), doc).when(~F.col("first.absent"), F.col("first.doc_id"))
    comp = F.when(~F.col("absent"), first)
    return rows.select(doc.alias("doc_id"), "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(False)).alias("kept"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest doc_id (null is the largest), then hash of the text.

    Similarity is that of ``near_duplicates``; texts without words are linked with nothing and all stay. Of rows with equal doc_id and text one
    stays, whatever their other columns; rows that repeat a doc_id with other texts stay or go each by its own text. Very long texts are
    read whole; all columns stay, whatever their names; an empty table stays empty.
    """
    row = F.struct("absent", "doc_id", "version")
    rows, _ = work.store(memberships(keyed(documents)).select(row.alias("__key"), (F.col("first").isNull() | (F.col("first") == row)).alias("stays"), F.col("first").isNotNull().alias("has")), "rows")
    gone, _ = work.store(rows.where(~F.col("stays")).select("__key").distinct(), "gone")
    again, _ = work.store(rows.where("stays and has").groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key"), "again")
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = F.struct(doc.isNull().alias("absent"), F.coalesce(doc, F.lit(NONE)).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("version"))
    few = [F.broadcast(x) if x.count() <= SMALL else x for x in (gone, again)]
    left = work.packed(documents, __key=key).join(few[0], "__key", "left_anti")
    if again.isEmpty():
        return work.unpacked(left, documents.columns)
    # rows of equal doc_id and text: one of each
    once = left.join(few[1], "__key", "left_semi").dropDuplicates(["__key"])
    return work.unpacked(left.join(few[1], "__key", "left_anti").unionByName(once), documents.columns)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(work.read(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM d),
e AS MATERIALIZED (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(sh) AS x FROM s)),
n AS MATERIALIZED (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)
"""
