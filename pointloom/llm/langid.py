"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit, work

DIMENSIONS, GRAM, SYMBOLS = 1024, 3, 512
#: Bound of the training sample: documents of a language (on average, by hash), whatever their length.
PER_LANGUAGE = 800
#: N-grams whose bound vectors a worker holds (4 KB each), and how many of a text are looked up at once.
KNOWN, AT_ONCE = 24_000, 8192


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """A symbol for each code point: 0 for what is no letter; letters that differ in case share one, others may by remainder."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = 1 + ord(low[0]) % (SYMBOLS - 1)
    return out


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """A random vector of -1 and 1 for each symbol, in one row for each of the ``GRAM`` places, rotated by it."""
    base = np.random.default_rng(20240229).integers(0, 2, (SYMBOLS, DIMENSIONS)).astype(np.int8) * 2 - 1
    return np.stack([np.roll(base, GRAM - 1 - i, axis=1) for i in range(GRAM)])


def vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of packed n-grams."""
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for i in range(GRAM):
        out *= letters()[i][(grams // SYMBOLS ** (GRAM - 1 - i)) % SYMBOLS]
    return out.astype(np.float32)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the letters of ``text`` and how often each occurs; runs of other characters are one blank."""
    s = symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    letter = s > 0
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate([[0], s, [0]])
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    s = s[keep]
    packed = np.zeros(max(0, len(s) - GRAM + 1), np.int64)
    for i in range(GRAM):
        packed = packed * SYMBOLS + s[i : i + len(packed)]
    return np.unique(packed, return_counts=True)


class Profiles:
    """Unit vectors of languages, and a table of the bound vectors of the n-grams met so far, up to ``KNOWN``."""

    def __init__(self, languages: list[str], prototypes: np.ndarray):
        self.languages, self.prototypes = languages, prototypes
        self.known = np.zeros((KNOWN, DIMENSIONS), np.float32)
        self.clear()

    def clear(self) -> None:
        self.ids, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Places of sorted ``grams`` in the table; new ones are bound and added, and a full table is started anew."""
        at = np.minimum(np.searchsorted(self.ids, grams), max(0, len(self.ids) - 1))
        new = self.ids[at] != grams if len(self.ids) else np.ones(len(grams), bool)
        if new.any():
            fresh = grams[new]
            if len(self.ids) + len(fresh) > KNOWN:
                self.clear()
                fresh = grams
            n = len(self.ids)
            self.known[n : n + len(fresh)] = vectors(fresh)
            into = np.searchsorted(self.ids, fresh)
            self.ids = np.insert(self.ids, into, fresh)
            self.places = np.insert(self.places, into, n + np.arange(len(fresh)))
            at = np.searchsorted(self.ids, grams)
        return self.places[at]

    def unit(self, text: str | None) -> np.ndarray | None:
        """The bundle of the n-grams of ``text`` as a unit vector; None without a letter."""
        grams, n = gram_counts(text or "")
        if not len(grams):
            return None
        doc = np.zeros(DIMENSIONS, np.float32)
        for a in range(0, len(grams), AT_ONCE):
            at = self.rows(grams[a : a + AT_ONCE])
            doc += n[a : a + AT_ONCE].astype(np.float32) @ self.known[at]
        return doc / (float(np.sqrt(doc @ doc)) or 1.0)

    def judge(self, text: str | None) -> tuple[str, float]:
        doc = self.unit(text) if self.languages else None
        if doc is None:
            return "und", 0.0
        cosine = self.prototypes @ doc
        best = int(np.argmax(cosine))
        return self.languages[best], min(1.0, max(0.0, (1 + float(cosine[best])) / 2))


def bundled(batches):
    """(lang, sum) of a task's texts (lang, text): the sum of the texts' unit vectors, for each language."""
    model, sums = Profiles([], np.zeros((0, DIMENSIONS))), {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            doc = model.unit(text.as_py())
            if doc is not None:
                sums[lang] = sums.get(lang, 0) + doc.astype(float)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "sum"])


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def train(documents: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles of every language, from a sample: of the learnable texts (doc_id, text, lang) about ``per_language`` each, chosen by a hash of
    doc_id against a share that a count by language sets.

    Vectors are made and summed where the texts are; only sums, one for each task and language, reach the driver. Null langs and texts and
    texts without a letter tell nothing; repeated rows count each; very long texts are read whole; an empty table gives no profile.
    """
    rows = documents.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares, path = work.store(rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.least(F.lit(1.0), per_language / F.col("n")) * (1 << 31)).cast("long").alias("share")), "shares")
    chosen = rows.join(work.small(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.col("share"))
    sums: dict[str, np.ndarray] = {}
    parts, parts_path = work.store(chosen.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(textkit.frugal(bundled), "lang string, sum binary"), "sums")
    for lang, part in parts.collect():
        sums[lang] = sums.get(lang, 0) + np.frombuffer(part)
    work.drop(documents.sparkSession, path, parts_path)
    names = sorted(sums)
    return Profiles(names, np.array([sums[x] / (np.linalg.norm(sums[x]) or 1.0) for x in names], np.float32).reshape(len(names), DIMENSIONS))


def predict(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score), written to the shared folder, of every row of ``documents`` (doc_id, text); score: (1 + cosine) / 2.

    ``und`` and 0 for a null text or one without a letter; repeated rows and null ids stay; an empty table gives an empty result.
    Texts are read whole. If no profile could be learned, all are ``und``.
    """
    shared = documents.sparkSession.sparkContext.broadcast((profiles.languages, profiles.prototypes))

    def run(batches):
        model = Profiles(*shared.value)
        for batch in batches:
            said = [model.judge(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.store(rows.mapInArrow(textkit.frugal(run), "doc_id long, lang_pred string, score double"), "languages")[0]


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    return predict(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang"), ~out)).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score")
