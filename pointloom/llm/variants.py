"""Spelling variants by full neighbourhood generation: every deletion, replacement and insertion of a word over the observed alphabet is emitted once and
hash-joined to the vocabulary.

A candidate is told by two 64-bit sums over its letters (place, letter), which follow from the word's own by a few additions, so it is never spelled out
before the join. What the vocabulary's bitmap rules out isn't sent; what meets is spelled and compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit, work

#: Fewest code points and occurrences of a word; how many times more often than a word its form occurs.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words that a partition counts before it emits what it has, and candidates made at once.
HELD_WORDS, BLOCK = 500_000, 1 << 18
#: Bits of the vocabulary's bitmap: this many for each word, up to 2 ** MOST_BITS (32 MB); a fuller one only rules out less.
BITS_A_WORD, MOST_BITS = 64, 28
U64 = np.uint64
SEEDS = (U64(0x2545F4914F6CDD1D), U64(0x9E6C63D0876A9A47))


def _crc_table() -> np.ndarray:
    """The remainder of each byte in the reflected polynomial of CRC-32."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Runs:
    """Runs of letters: byte range, document, code points."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    length: np.ndarray


def letter_runs(b: np.ndarray, offs: np.ndarray) -> Runs:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF (two bytes that begin with 0xC3) in the documents ``b[offs[i]:offs[i + 1]]``."""
    lead = b == 0xC3
    inside = _ASCII_LETTER[b] | lead
    inside[1:] |= lead[:-1]
    begin, final = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    final[:-1] &= ~inside[1:]
    edges = offs[:-1][offs[:-1] < len(b)]
    begin[edges] |= inside[edges]
    before = edges[edges > 0] - 1
    final[before] |= inside[before]
    start, end = np.flatnonzero(begin), np.flatnonzero(final) + 1
    points = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    doc = np.searchsorted(offs, start, "right") - 1
    return Runs(start, end, doc, points[end] - points[start])


def run_crcs(b: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``state`` (a CRC-32 for each run) stands for, followed by the run."""
    n = end - start
    s = ~state.astype(np.uint32)
    live, at = np.flatnonzero((n > 0) & (n <= textkit.LONG_WORD)), 0
    while len(live):
        x = s[live]
        s[live] = CRC[(x ^ b[start[live] + at]) & 0xFF] ^ (x >> np.uint32(8))
        at += 1
        live = live[n[live] > at]
    s = ~s
    for i in np.flatnonzero(n > textkit.LONG_WORD).tolist():
        s[i] = zlib.crc32(b[start[i] : end[i]].tobytes(), int(state[i]))
    return s


def counted(batches: Iterator[pa.RecordBatch], every: int, least: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of the (doc_id, text) batches, combined over the partition; a word may come again."""
    held: dict[bytes, int] = {}

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        data, all_offs = textkit.text_buffers(batch.column(1))
        for lo, hi in textkit.slices(all_offs):
            b = textkit.LOWER[data[all_offs[lo] : all_offs[hi]]]
            r = letter_runs(b, all_offs[lo : hi + 1] - all_offs[lo])
            long = np.flatnonzero(r.length >= least)  # a shorter run can't get longer
            start, end, length = r.start[long], r.end[long], r.length[long]
            prefix = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids[lo:hi]], np.uint32)
            crc = run_crcs(b, start, end, prefix[r.doc[long]]) if len(long) else np.zeros(0, np.uint32)
            cut = crc % every == 0
            raw = b.tobytes()
            for i in np.flatnonzero(cut & (length > least)).tolist():
                word = raw[start[i] : end[i]].decode()
                k = int(crc[i]) % len(word)
                w = (word[:k] + word[k + 1 :]).encode()
                held[w] = held.get(w, 0) + 1
            start, end = start[~cut], end[~cut]
            one, two = (textkit.hashes(b, start, end, seed) for seed in (0, 1))
            keys, first, back, n = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
            if (two[first][back] != two).any():  # two words share a hash: count them by their bytes
                pairs = ((raw[a:z], 1) for a, z in zip(start.tolist(), end.tolist(), strict=True))
            else:
                pairs = ((raw[a:z], k) for a, z, k in zip(start[first].tolist(), end[first].tolist(), n.tolist(), strict=True))
            for w, k in pairs:
                held[w] = held.get(w, 0) + k
            if len(held) > HELD_WORDS:
                yield emit()
                held.clear()
    yield emit()


def _letters(place: np.ndarray, letter: np.ndarray, seed: np.uint64) -> np.ndarray:
    """What a letter (one byte, its code point) at a place adds to a word's sum."""
    return textkit.mix((place.astype(U64) << U64(8) | letter.astype(U64)) * SEEDS[0] + seed)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of each length: their indices, and their letters as a matrix."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    for k in np.unique(n).tolist():
        at = np.flatnonzero(n == k)
        for lo in range(0, len(at), max(1, BLOCK // max(1, k))):
            some = at[lo : lo + max(1, BLOCK // max(1, k))]
            yield some, np.frombuffer("".join(words[i] for i in some.tolist()).encode("latin-1"), np.uint8).reshape(len(some), k)


def word_sums(words: list[str]) -> list[np.ndarray]:
    """The two sums of each word."""
    out = [np.zeros(len(words), U64) for _ in SEEDS]
    for at, x in by_length(words):
        for o, seed in zip(out, SEEDS, strict=True):
            o[at] = _letters(np.arange(x.shape[1])[None, :], x, seed).sum(1, dtype=U64)
    return out


def neighbours(x: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """All distinct neighbours of the words ``x`` (rows of letters), each once: (kind, row, place, letter, its two sums) in blocks of bounded size.

    Of the places that give the same word the last counts: the last of a run of equal letters for a deletion, the place after it for an insertion.
    """
    m, k = x.shape
    place = np.arange(k)[None, :]
    same = [_letters(place, x, s) for s in SEEDS]
    upto = [np.concatenate([np.zeros((m, 1), U64), np.cumsum(v, 1, dtype=U64)], 1) for v in same]  # of the letters before a place
    down = [np.cumsum(_letters(place - 1, x, s)[:, ::-1], 1, dtype=U64)[:, ::-1] if k else np.zeros((m, 0), U64) for s in SEEDS]  # from a place on, one place down
    up = [np.concatenate([np.cumsum(_letters(place + 1, x, s)[:, ::-1], 1, dtype=U64)[:, ::-1], np.zeros((m, 1), U64)], 1) for s in SEEDS]  # one place up
    row, at = np.nonzero(np.concatenate([x[:, 1:] != x[:, :-1], np.ones((m, 1), bool)], 1)) if k else (np.zeros(0, int), np.zeros(0, int))
    after = [np.concatenate([d, np.zeros((m, 1), U64)], 1) for d in down]
    yield "delete", row, at, np.zeros(len(row), np.uint8), [u[row, at] + a[row, at + 1] for u, a in zip(upto, after, strict=True)]
    width = max(1, BLOCK // max(1, m * len(alphabet)))
    for lo in range(0, k, width):
        hi = min(k, lo + width)
        row, at, c = np.nonzero(x[:, lo:hi, None] != alphabet[None, None, :])
        at, letter = at + lo, alphabet[c]
        yield "replace", row, at, letter, [u[row, -1] - v[row, at] + _letters(at, letter, s) for u, v, s in zip(upto, same, SEEDS, strict=True)]
    for lo in range(0, k + 1, width):
        hi = min(k + 1, lo + width)
        own = np.concatenate([x, np.zeros((m, 1), np.uint8)], 1)[:, lo:hi, None]  # nothing stands after the end
        row, at, c = np.nonzero((own != alphabet[None, None, :]) | (np.arange(lo, hi)[None, :, None] == k))
        at, letter = at + lo, alphabet[c]
        yield "insert", row, at, letter, [u[row, at] + _letters(at, letter, s) + p[row, at] for u, p, s in zip(upto, up, SEEDS, strict=True)]


def vocabulary(documents: DataFrame, every: int = 199, least: int = LEAST_LENGTH, often: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``least`` code points and ``often`` occurrences in all of ``documents`` (doc_id, text).

    Runs of letters are lower-cased (A-Z only). A run whose CRC-32 of ``<doc_id>:<run>`` is divisible by ``every`` loses the code point at CRC modulo
    its length. A null text has no words, a null doc_id is written as nothing; repeated rows count each; very long runs are read whole.
    """
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    part = rows.mapInArrow(textkit.frugal(lambda batches: counted(batches, every, least)), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def with_sums(words: DataFrame) -> DataFrame:
    """(word, n, h1, h2)"""

    def add(batches):
        for batch in batches:
            sums = word_sums(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(s.view(np.int64)) for s in sums)], ["word", "n", "h1", "h2"])

    return words.select("word", "n").mapInArrow(textkit.frugal(add), "word string, n long, h1 long, h2 long")


def bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """``2 ** bits`` bits in which both sums of each word are marked. Its words (64 bits, those that aren't zero) reach the driver: 2 ** bits / 8 bytes at most."""
    at = F.explode(F.array("h1", "h2"))
    marks = words.select(at.alias("h")).groupBy(F.shiftrightunsigned("h", 64 - bits + 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("marks"))
    got = marks.toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(U64)
    return out


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    shift = U64(64 - (len(bits).bit_length() - 1))
    return (bits[(h >> shift).astype(np.int64)] >> (h & U64(63))) & U64(1) > 0


def spelled(word: Column, kind: Column, at: Column, letter: Column) -> Column:
    """The neighbour of ``word`` that a candidate stands for."""
    head, tail = F.substring(word, F.lit(1), at), F.substring(word, at + F.when(kind == "insert", 1).otherwise(2), F.char_length(word))
    return F.concat(head, letter, tail)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of ``words`` (word, n, h1, h2) that differ by exactly one inserted, deleted or replaced code point.

    Candidates that the bitmap lets through meet the vocabulary by an equi-join on their two sums; no distance is computed, as each candidate is a neighbour by
    the way it was made.
    """
    spark = words.sparkSession
    count = words.count()
    bits = int(np.clip((BITS_A_WORD * max(1, count) - 1).bit_length(), 12, MOST_BITS))
    alphabet = sorted(r.c for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect())  # letters: 122 at most
    shared = spark.sparkContext.broadcast((bitmap(words, bits), np.frombuffer("".join(alphabet).encode("latin-1"), np.uint8)))

    def make(batches):
        marks, letters = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at, x in by_length(texts):
                step = max(1, BLOCK // max(1, x.shape[1] * len(letters)))
                for lo in range(0, len(at), step):
                    for kind, row, place, letter, (h1, h2) in neighbours(x[lo : lo + step], letters):
                        hit = np.flatnonzero(_marked(marks, h1))
                        hit = hit[_marked(marks, h2[hit])]
                        of = pa.array(at[lo + row[hit]])
                        added = [chr(c) if kind != "delete" else "" for c in letter[hit].tolist()]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array([kind] * len(hit), pa.string()), pa.array(place[hit].astype(np.int32)), pa.array(added, pa.string()), pa.array(h1[hit].view(np.int64)), pa.array(h2[hit].view(np.int64))], ["word", "n", "kind", "at", "letter", "h1", "h2"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = words.select("word", "n").repartition(parts, "word")
    made = dealt.mapInArrow(textkit.frugal(make), "word string, n long, kind string, at int, letter string, h1 long, h2 long")
    side = work.small(words.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "h1", "h2"))
    met = made.join(side, ["h1", "h2"])
    return met.where(F.col("near") == spelled(F.col("word"), F.col("kind"), F.col("at"), F.col("letter"))).select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form): forms are followed to the last. A form is more frequent than its word, so there is no ring;
    each round follows twice as many."""
    spark = forms.sparkSession
    now, path = work.store(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")), "forms")
    while not now.where("not done").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("done").alias("end"))
        met = now.join(work.small(further), "root", "left")
        new, new_path = work.store(met.select("word", F.coalesce("next", "root").alias("root"), F.coalesce("end", F.lit(True)).alias("done")), "roots")
        work.drop(spark, path)
        now, path = new, new_path
    return now.select("word", "root")


def variants(documents: DataFrame, every: int = 199, least: int = LEAST_LENGTH, often: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the ``vocabulary`` of ``documents`` (doc_id, text).

    form: the near word with the largest n (ties: the smallest in code-point order), if that is at least ``ratio`` times the word's own; null otherwise.
    root: the last of the forms of forms, or the word itself. Empty tables and texts without letters give an empty result; other columns are not read.
    """
    words, _ = work.store(with_sums(vocabulary(documents, every, least, often)), "vocabulary")
    pairs, _ = work.store(near_words(words), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best"))
    known = words.select("word", "n").join(best, "word", "left")
    good = -F.col("best.minus") >= ratio * F.col("n")
    judged, _ = work.store(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n")), "forms")
    ends, _ = work.store(roots(judged.where(F.col("form").isNotNull())), "ends")
    return judged.join(work.small(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(work.read(spark, sf_dir, "documents").select("doc_id", "text"))


#: Remainders of the 16 half bytes, fixed values of CRC-32.
_NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
OP11_SQL = f"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
b AS (SELECT doc_id, run, k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM u),
h AS (SELECT doc_id, run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(s)), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))),
  lambda a, x: xor(xor(xor(a, x) >> 4, {_NIBBLES}[(xor(a, x) & 15) + 1]) >> 4, {_NIBBLES}[(xor(xor(a, x) >> 4, {_NIBBLES}[(xor(a, x) & 15) + 1]) & 15) + 1])), 4294967295) AS c FROM b),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN c % 199 = 0 THEN left(run, CAST(c % length(run) AS INTEGER)) || substr(run, CAST(c % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM h)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(k) >= {LEAST_COUNT}),
i AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM w),
d AS (SELECT DISTINCT word, n, left(word, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS rest FROM i),
m AS (SELECT word, n, i, left(word, CAST(i AS INTEGER)) || '*' || substr(word, CAST(i AS INTEGER) + 2) AS rest FROM i),
p AS (SELECT d.word, d.n, w.word AS near, w.n AS near_n FROM d JOIN w ON w.word = d.rest
  UNION ALL SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON w.word = d.rest
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM m a JOIN m b ON a.rest = b.rest AND a.word <> b.word),
g AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.near_n >= {RATIO} * w.n THEN g.near END AS form, CASE WHEN g.near_n >= {RATIO} * w.n THEN g.near_n END AS form_n FROM w LEFT JOIN g USING (word)),
t AS (WITH RECURSIVE t(word, root, d) AS (SELECT word, word, 0 FROM f UNION ALL SELECT t.word, f.form, t.d + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL) SELECT word, arg_max(root, d) AS root FROM t GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM f JOIN t USING (word)
"""
