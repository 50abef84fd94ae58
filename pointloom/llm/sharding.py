"""Sharding by extendible hashing, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters
from . import work

#: Bits of a hash: 60, the first 15 hex digits of an md5.
BITS = 60
#: Bits by which a round deepens the directory at once; buckets that fit keep their own depth.
STEP = 8
LIMIT = 1 << 20


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int, most_bits: int = BITS) -> DataFrame:
    """(depth, prefix, bytes) of the leaf buckets for ``sizes`` (hash, bytes): a bucket splits on its next bit only if it is over ``limit``.

    Each round sums the documents still in oversized buckets by ``STEP`` more bits (a partial aggregation, so a hot prefix
    costs a row a task), and each prefix keeps the least depth at which it fits. Buckets of one hash value stay oversized at the last bit.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
    low, leaves, open_rows, scratch = 0, [], sizes, []
    if total <= limit:
        return sizes.agg(F.sum("bytes").alias("bytes")).where(F.col("bytes").isNotNull()).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "bytes")
    while low < most_bits:
        high = min(most_bits, low + max(STEP, (int(total) // limit).bit_length() + 3 if low == 0 else 0))
        fine = open_rows.groupBy(F.shiftright("hash", most_bits - high).alias("fine")).agg(F.sum("bytes").alias("bytes"))
        levels = fine.select("fine", "bytes", F.explode(F.sequence(F.lit(low + 1), F.lit(high))).alias("depth"))
        prefix = F.expr(f"shiftright(fine, {high} - depth)")
        level_sums = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        level_sums, path = work.store(level_sums, "directory")
        scratch.append(path)
        parents = level_sums.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        # a leaf fits, and the bucket above it doesn't (above the first level of a round all are oversized)
        fits = level_sums.where(F.col("bytes") <= limit)
        under = fits.withColumn("up", F.shiftright("prefix", 1)).join(parents, ["depth", "up"], "left_semi").select("depth", "prefix", "bytes")
        leaves += [fits.where(F.col("depth") == low + 1).select("depth", "prefix", "bytes"), under.where(F.col("depth") > low + 1)]
        over = level_sums.where((F.col("depth") == high) & (F.col("bytes") > limit))
        if high == most_bits:
            leaves.append(over.select("depth", "prefix", "bytes"))
        if high == most_bits or over.isEmpty():
            break
        open_rows = open_rows.join(over.select(F.col("prefix").alias("__p")), F.shiftright("hash", most_bits - high) == F.col("__p"), "left_semi")
        low = high
    return reduce(DataFrame.unionByName, leaves)


def entries(leaves: DataFrame, most_depth: int = 24) -> DataFrame:
    """(entry, depth, prefix): the directory itself, 2 ** (largest depth) entries, each with its leaf; several lead to a leaf of less depth."""
    deep = int(leaves.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first().d)
    if deep > most_depth:
        raise ValueError(f"a directory of 2 ** {deep} entries; the leaves alone tell as much")
    first = F.expr(f"shiftleft(prefix, {deep} - depth)")
    return leaves.select(F.explode(F.sequence(first, F.expr(f"shiftleft(prefix + 1, {deep} - depth) - 1"))).alias("entry"), "depth", "prefix")


def shard(rows: DataFrame, key: str, size: Column, limit: int = LIMIT, most_bits: int = BITS) -> DataFrame:
    """``rows`` with depth, prefix, page and bytes: the leaf bucket of each row's key hash, in pages of at most ``limit`` bytes.

    Rows of one key can't be told apart by any bit; where they alone exceed the limit, their bucket is oversized at the last bit and
    goes on in numbered pages, filled in the order of the row's columns: rows of at most half the limit fill pages from 0 on to half at
    least, larger ones are a page each, numbered from -1 down. A null key is the empty string, a null size 0; repeated rows stay; clashing
    columns are replaced; an empty table gives an empty result.
    """
    names = [c for c in rows.columns if c not in ("depth", "prefix", "page", "bytes")]
    row = F.struct(*[F.col(work.quoted(c)) for c in names])
    known = rows.select(row.alias("__row"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("__bytes"), hash_bits(F.col(work.quoted(key))).alias("__hash"))
    sizes = known.select(F.col("__hash").alias("hash"), F.col("__bytes").alias("bytes"))
    leaves, _ = work.store(directory(sizes, limit, most_bits), "leaves")
    found = leaves.agg(F.count("*").alias("n"), F.max("bytes").alias("most")).first()
    fields = [F.col("__row")[c].alias(c) for c in names]
    page = F.lit(0).cast("long").alias("page")
    if found.n == 0:
        return known.select(*fields, F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), page, F.col("__bytes").alias("bytes"))
    depths = [r.depth for r in leaves.select("depth").distinct().orderBy("depth").collect()]  # 60 at most
    # a row meets one leaf: it asks for its prefix at each depth that some leaf has
    asks = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("__hash", most_bits - d).alias("prefix")) for d in depths]))
    side = leaves.select(F.struct("depth", "prefix").alias("__a"), F.col("bytes").alias("__sum"))
    small = work.small(leaves) is not leaves
    if small:  # a small directory is sent to all: then no row moves
        out = known.withColumn("__a", asks).join(F.broadcast(side), "__a")
    else:
        at = known.select("__hash").distinct().withColumn("__a", asks).join(side, "__a")
        out = known.join(at, "__hash")
    out = out.select("__row", "__bytes", F.col("__a.depth").alias("__depth"), F.col("__a.prefix").alias("__prefix"), "__sum")
    place = [F.col("__depth").alias("depth"), F.col("__prefix").alias("prefix")]
    if found.most <= limit:
        return out.select(*fields, *place, page, F.col("__bytes").alias("bytes"))
    fits = out.where(F.col("__sum") <= limit).select(*fields, *place, page, F.col("__bytes").alias("bytes"))
    return fits.unionByName(_paged(out.where(F.col("__sum") > limit), limit).select(*fields, *place, "page", F.col("__bytes").alias("bytes")))


def _paged(over: DataFrame, limit: int) -> DataFrame:
    """``over`` with page. Running sums go over all oversized buckets at once, in ranges that are summed apart, so no task holds a key."""
    kinds = over.schema["__row"].dataType.fields
    sortable = F.struct(*[F.col("__row")[f.name] for f in kinds if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])
    big = 2 * F.col("__bytes") > limit
    order = ["__prefix", "__order", "__bytes", "__tie"]
    # equal rows may be many: a number drawn for each lets their range be cut, too
    over = over.withColumn("__order", sortable).withColumn("__tie", F.rand(7)).withColumn("__light", F.when(~big, F.col("__bytes")).otherwise(0)).withColumn("__big", big.cast("long"))
    over = filters.prefix_sum(filters.prefix_sum(over, order, "__light", "__sum_light"), order, "__big", "__sum_big")
    over, _ = work.store(over, "paged")
    start = over.groupBy("__prefix").agg(F.min(F.col("__sum_light") - F.col("__light")).alias("__from_light"), F.min(F.col("__sum_big") - F.col("__big")).alias("__from_big"))
    start, _ = work.store(start, "starts")
    light = F.floor((F.col("__sum_light") - F.col("__light") - F.col("__from_light")) / F.lit(max(1, limit // 2)))
    met = over.join(work.small(start), "__prefix")
    return met.withColumn("page", F.when(F.col("__big") == 1, F.col("__from_big") - F.col("__sum_big")).otherwise(light).cast("long"))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return shard(docs, "doc_id", F.col("n")).select("doc_id", "depth", "prefix", "page", "bytes")


OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
sums AS (SELECT t.depth, d.h >> ({BITS} - t.depth) AS prefix, sum(bytes) AS b FROM d, (SELECT unnest(range(0, {BITS} + 1)) AS depth) t GROUP BY 1, 2),
leaf AS (SELECT d.doc_id, d.bytes, d.h, min(s.depth) AS depth FROM d JOIN sums s ON s.prefix = d.h >> ({BITS} - s.depth) AND (s.b <= {LIMIT} OR s.depth = {BITS}) GROUP BY ALL),
placed AS (SELECT leaf.*, h >> ({BITS} - leaf.depth) AS prefix, s.b FROM leaf JOIN sums s ON s.depth = leaf.depth AND s.prefix = h >> ({BITS} - leaf.depth)),
run AS (SELECT *, sum(CASE WHEN 2 * bytes > {LIMIT} THEN 0 ELSE bytes END) OVER w - bytes AS before, sum(CASE WHEN 2 * bytes > {LIMIT} THEN 1 ELSE 0 END) OVER w AS nth FROM placed
  WINDOW w AS (PARTITION BY depth, prefix ORDER BY doc_id, bytes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, CAST(depth AS INTEGER) AS depth, CAST(prefix AS BIGINT) AS prefix,
  CAST(CASE WHEN b <= {LIMIT} THEN 0 WHEN 2 * bytes > {LIMIT} THEN -nth ELSE before // {LIMIT // 2} END AS BIGINT) AS page, bytes FROM run
"""
