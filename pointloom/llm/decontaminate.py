"""Benchmark decontamination by a positional inverted index, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import work

#: What stands between words; A-Z are lower-cased first.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, which counting doesn't need.
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: A proximity match: the ``RAREST`` distinct terms of an item that the corpus has most seldom stand within ``NEAR`` words of a document.
RAREST, NEAR = 3, 20


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case; null is empty. Other than ASCII texts are seen as their UTF-8 bytes, a character each: lower-casing these
    too maps different texts to different texts, and only equality counts here."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.lower(F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")))


def word_list(text: Column, between: str = BETWEEN) -> Column:
    """The words of ``text``, in order; null has none."""
    return F.filter(F.split(text, between), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_list(F.coalesce(text.cast("string"), F.lit("")), BETWEEN_ANY_CASE)).cast("long")


def test_windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, words, size), a number for each distinct window of ``size`` consecutive words of an item, and (window, item): who holds it.

    An item of fewer words, but not none, is one window.
    """
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), word_list(lowered(F.col("text"))).alias("ws")).where(F.size("ws") > 0)
    first = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - (size - 1)))
    rows, _ = work.store(w.select("item", F.explode(F.transform(first, lambda i: F.slice("ws", i, size))).alias("words")).distinct(), "windows")
    windows, _ = work.store(rows.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words", F.size("words").alias("size")), "distinct")
    return windows, rows.join(windows, "words").select("window", "item")


def positions(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, __row, pos) of the words of ``docs`` (__row, text) that are among the distinct ``terms`` (a stored table)."""
    # nothing stands before a leading separator: the split then begins with an empty string, which is no word
    lead = F.coalesce(F.substring("text", 1, 1).rlike(BETWEEN_ANY_CASE), F.lit(False)).cast("int")
    split = docs.select("__row", lead.alias("lead"), F.posexplode(F.split(lowered(F.col("text")), BETWEEN)).alias("at", "term"))
    return split.select("__row", (F.col("at") - F.col("lead")).alias("pos"), "term").join(work.small(terms), "term")


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(term, n) of the windows' terms that ``docs`` hold: how often."""
    vocabulary, _ = work.store(windows.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    return work.store(positions(docs, vocabulary).groupBy("term").agg(F.count("*").alias("n")), "terms")[0]


def window_keys(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, size, term, at, term2, at2): the two rarest terms of each window and where they stand; without windows that can't occur."""
    terms = windows.select("window", "size", F.posexplode("words").alias("at", "term"))
    ranked = terms.join(counts, "term").groupBy("window").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("t")).where(F.size("t") == F.col("size"))
    second = F.filter("t", lambda x: x["term"] != F.col("t")[0]["term"])
    keys = ranked.select("window", "size", F.col("t")[0]["term"].alias("term"), F.col("t")[0]["at"].alias("at"), F.get(second, F.lit(0)).alias("next"))
    return work.store(keys.select("window", "size", "term", "at", F.col("next.term").alias("term2"), F.col("next.at").alias("at2")), "keys")[0]


def rare_terms(windows: DataFrame, holders: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(item, k, term, most): the ``rarest`` terms of each item by (n, term), numbered from 0, if ``docs`` hold them all."""
    every = holders.where(F.col("item").isNotNull()).join(windows, "window").select("item", F.explode("words").alias("term")).distinct()
    met = every.join(counts, "term", "left").groupBy("item").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))), 1, rarest).alias("t"))
    met = met.where(F.col("t")[0]["n"] > 0)
    return work.store(met.select("item", F.posexplode("t").alias("k", "x"), F.size("t").alias("most")).select("item", "k", F.col("x.term").alias("term"), "most"), "rare")[0]


def postings(docs: DataFrame, *wanted: DataFrame) -> DataFrame:
    """The stored index (term, __row, pos) of all ``wanted`` (term)."""
    terms, _ = work.store(reduce(DataFrame.unionByName, [w.select("term") for w in wanted]).where(F.col("term").isNotNull()).distinct(), "wanted")
    return work.store(positions(docs, terms).select("term", "__row", "pos"), "postings")[0]


def phrase_matches(docs: DataFrame, windows: DataFrame, keys: DataFrame, index: DataFrame) -> DataFrame:
    """(__row, window, start, size) of every exact occurrence of a window in ``docs`` (__row, text).

    Each window is looked up by its rarest term; this posting list and that of the next rarest, shifted by the terms' places in the window,
    are intersected, and the places that are left are read word by word.
    """
    one = index.join(work.small(keys), "term").select("__row", (F.col("pos") - F.col("at")).alias("start"), "window", "size", "term2", "at2").where(F.col("start") >= 0)
    alone = one.where(F.col("term2").isNull()).select("__row", "start", "window", "size")
    # the second list: of the windows' terms in the same documents at the place that the first list says
    two = one.where(F.col("term2").isNotNull()).withColumn("pos", F.col("start") + F.col("at2"))
    both = two.join(index.select(F.col("term").alias("term2"), "__row", "pos"), ["__row", "pos", "term2"], "left_semi").select("__row", "start", "window", "size")
    found, path = work.store(alone.unionByName(both).distinct(), "places")
    # all candidate places of one document are beside its text, which they can't outgrow but by the windows that share two rare terms
    per, per_path = work.store(found.groupBy("__row").agg(F.collect_list(F.struct("start", "window", "size")).alias("places")), "places")
    checked = docs.join(work.small(per), "__row").select("__row", "places", word_list(lowered(F.col("text"))).alias("ws"))
    read = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["window"].alias("window"), p["size"].alias("size"), F.slice("ws", p["start"] + 1, p["size"]).alias("words")))
    rows = checked.select("__row", F.explode(read).alias("p")).select("__row", "p.start", "p.size", "p.window", F.col("p.words").alias("read"))
    same = rows.join(work.small(windows.select("window", "words")), "window").where(F.col("read") == F.col("words"))
    out, _ = work.store(same.select("__row", "window", "start", "size"), "matches")
    work.drop(docs.sparkSession, path, per_path)
    return out


def proximity_matches(index: DataFrame, terms: DataFrame, within: int = NEAR) -> DataFrame:
    """(__row, item, start, end) of runs of at most ``within`` words that hold all the ``terms`` (item, k, term, most) of an item, in any order,
    by the positional ``index`` (term, __row, pos): each ends at a posting and begins at the latest place from which on all are there.

    Only a document's postings of one item's terms meet in a window, so no list grows with a term's frequency in the corpus.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("__row", "item").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = index.join(work.small(terms), "term")
    n = int(terms.agg(F.coalesce(F.max("most"), F.lit(1)).alias("n")).first().n)
    rows = rows.select("__row", "item", "pos", "most", *[F.max(F.when(F.col("k") == k, F.col("pos"))).over(w).alias(f"l{k}") for k in range(n)])
    last = F.slice(F.array(*[F.col(f"l{k}") for k in range(n)]), F.lit(1), F.col("most"))
    rows = rows.where(F.forall(last, lambda x: x.isNotNull())).select("__row", "item", F.array_min(last).alias("start"), (F.col("pos") + 1).alias("end"))
    return rows.where(F.col("end") - F.col("start") <= within)


def row_key(documents: DataFrame) -> Column:
    """What names a row: its doc_id and a hash of its text, so that only equal rows share it."""
    kind = documents.schema["doc_id"].dataType
    doc = F.col("doc_id").cast("long" if isinstance(kind, T.IntegralType) else "string")
    return F.struct(doc.isNull().alias("absent"), F.coalesce(doc, F.lit(0).cast(doc_type(kind))).alias("doc"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("version"))


def doc_type(kind: T.DataType) -> str:
    return "long" if isinstance(kind, T.IntegralType) else "string"


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """All columns of ``documents`` (clashing ones replaced), n_words, n_hit, n_items, items (sorted strings), spans (start, end), n_near.

    A word is hit if it lies inside any occurrence of a window; ``n_near`` counts items with a proximity match (see ``RAREST``). Null or empty texts
    have no words; without test items, or with items that have no words, nothing is hit; repeated rows are judged each on its own and null ids
    stay. Items with a null id have no name: they hit words and aren't counted; items that share an id are one. Very long texts are read whole.
    An empty table gives an empty result.
    """
    names = [c for c in documents.columns if c not in ("n_words", "n_hit", "n_items", "items", "spans", "n_near")]
    hits = hit_spans(documents.select("doc_id", "text"), benchmark, size)
    base = work.packed(documents, __key=row_key(documents), __n=word_count(F.col("text")))
    met = base.join(hits.select(F.col("__row").alias("__key"), F.struct("n_hit", "items", "spans", "n_near").alias("__hit")), "__key", "left")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    items = F.coalesce("__hit.items", none)
    return met.select(*[F.col("__row")[c].alias(c) for c in names], F.col("__n").alias("n_words"), F.coalesce("__hit.n_hit", zero).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.col("__hit.spans").alias("spans"), F.coalesce("__hit.n_near", zero).alias("n_near"))


def hit_spans(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(__row, n_hit, items, spans, n_near) of the documents with hits or proximity matches; see ``row_key`` for __row."""
    docs = documents.select(row_key(documents).alias("__row"), F.col("text").cast("string").alias("text"))
    windows, holders = test_windows(benchmark, size)
    counts = term_counts(docs, windows)
    keys, rare = window_keys(windows, counts), rare_terms(windows, holders, counts)
    index = postings(docs, keys.select("term"), keys.select(F.col("term2").alias("term")), rare)
    matches = phrase_matches(docs, windows, keys, index)
    per = matches.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("s"))
    # merge overlapping spans, which are sorted
    merged = F.aggregate("s", F.array().cast("array<struct<start:int,end:int>>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    spans = per.select("__row", merged.alias("spans")).withColumn("n_hit", F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long"))
    named, _ = work.store(holders.where(F.col("item").isNotNull()).distinct(), "holders")
    items = matches.select("__row", "window").distinct().join(work.small(named), "window").select("__row", "item").distinct().groupBy("__row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    near = proximity_matches(index, rare).select("__row", "item").distinct().groupBy("__row").agg(F.count("*").alias("n_near"))
    return spans.join(items, "__row", "left").join(near, "__row", "full").select("__row", "n_hit", "items", "spans", "n_near")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(work.read(spark, sf_dir, "documents").select("doc_id", "text"), work.read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, most_hit: float = 0.0) -> DataFrame:
    """Documents without hits, or with at most ``most_hit`` of their words hit; all columns stay, whatever their names.

    Null and empty texts and rows without a doc_id and hits stay; rows that repeat are judged each by its own text; very long texts are read
    whole; an empty table stays empty, and without test items all stay.
    """
    hits = hit_spans(documents.select("doc_id", "text"), benchmark, size).where("n_hit > 0")
    hits, _ = work.store(hits.select(F.col("__row").alias("__key"), F.col("n_hit").alias("__hit")), "hits")
    if most_hit <= 0:
        return work.unpacked(work.packed(documents, __key=row_key(documents)).join(work.small(hits.select("__key")), "__key", "left_anti"), documents.columns)
    words = F.greatest(F.lit(1), word_count(F.col("text")))
    kept = work.packed(documents, __key=row_key(documents), __n=words).join(work.small(hits), "__key", "left")
    return work.unpacked(kept.where(F.coalesce("__hit", F.lit(0)) <= F.lit(most_hit) * F.col("__n")), documents.columns)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS win, least(10, len(ws)) AS size FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM w),
p AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), sizes WHERE i + size - 1 <= len(ws)),
m AS (SELECT p.doc_id, p.i, p.size, w.item_id FROM p JOIN w USING (win, size)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS x FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1),
v AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, unnest(ws) AS term FROM b WHERE item_id IS NOT NULL),
pos AS MATERIALIZED (SELECT doc_id, ws[i] AS term, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) SEMI JOIN (SELECT DISTINCT term FROM v) x ON x.term = ws[i]),
freq AS (SELECT term, count(*) AS n FROM pos GROUP BY 1),
rare AS (SELECT item, term, row_number() OVER (PARTITION BY item ORDER BY coalesce(n, 0), term) AS k, min(coalesce(n, 0)) OVER (PARTITION BY item) AS least FROM v LEFT JOIN freq USING (term)),
r AS (SELECT item, term, k, max(k) OVER (PARTITION BY item) AS most FROM rare WHERE k <= 3 AND least > 0),
o AS (SELECT doc_id, item, i, most, max(CASE WHEN k = 1 THEN i END) OVER w AS l1, max(CASE WHEN k = 2 THEN i END) OVER w AS l2, max(CASE WHEN k = 3 THEN i END) OVER w AS l3
  FROM pos JOIN r USING (term) WINDOW w AS (PARTITION BY doc_id, item ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM o
  WHERE l1 IS NOT NULL AND (most < 2 OR l2 IS NOT NULL) AND (most < 3 OR l3 IS NOT NULL) AND i + 1 - least(l1, coalesce(l2, l1), coalesce(l3, l1)) <= 20 GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN near USING (doc_id)
"""
