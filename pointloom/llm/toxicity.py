"""Toxic spans by a linear-chain conditional random field; marginals give document scores and offending offsets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit, work

#: Bounds of the training sample: documents of label 1 and of label 0 (on average, by hash), whatever their length.
PER_LABEL, PER_CLEAN = 2000, 5000
#: A word's own feature and its beginnings of these lengths.
BEGINNINGS = (4, 5, 6)
#: Words whose features a worker remembers.
REMEMBERED = 200_000
WORD = re.compile(r"[^\W\d_]+")
#: Words on either side of a known word whose tags are computed one by one; runs between are powers of one matrix.
AROUND = 2
SPAN = 0.5


def token_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def token_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


def distinct_documents(docs: list[list[str]], k: int = 5, sketch: int = 4) -> list[list[str]]:
    """``docs`` without those that share one of their ``sketch`` least shingles with an earlier one: copies tell nothing new of a word."""
    seen: set[int] = set()
    out = []
    for d in docs:
        least = sorted({zlib.crc32(" ".join(d[i : i + k]).encode()) for i in range(max(1, len(d) - k + 1))})[:sketch]
        if not seen.intersection(least):
            out.append(d)
        seen.update(least)
    return out


class Emissions(dict):
    """Each word's log-odds of tag 1 if it has a known feature, else None; filled as words are asked for, and emptied when it is full."""

    def __init__(self, weights: dict[str, float], other: float):
        self.weights, self.other = weights, other

    def __missing__(self, word: str) -> float | None:
        if len(self) >= REMEMBERED:
            self.clear()
        own = [w for f in token_features(word) if (w := self.weights.get(f)) is not None]
        self[word] = out = self.other + sum(own) if own else None
        return out


@dataclass
class Chain:
    """Tags 0 (clean) and 1 (toxic). ``weights``: what known features add to the log-odds ``other`` of tag 1; ``move``: log-odds gained by a tag
    1 after a tag 0 and after a tag 1 (against a tag 0). ``blend`` and ``base`` turn the marginals of a document into its score."""

    weights: dict[str, float]
    other: float
    move: tuple[float, float]
    blend: tuple[float, float]
    base: float

    def __post_init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.seen = Emissions(self.weights, self.other)

    def step(self, e: float) -> np.ndarray:
        """Potentials [tag before, tag]."""
        return np.array([[1.0, np.exp(self.move[0] + e)], [1.0, np.exp(self.move[1] + e)]])

    def marginals(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and P(tag 1) of the known words and those around them, by forward-backward over the whole text."""
        each = list(map(self.seen.__getitem__, words))

        def emission(j: int) -> float:
            return self.other if each[j] is None else each[j]

        known = [i for i, e in enumerate(each) if e is not None]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        n = len(words)
        near = sorted({j for i in known for j in range(max(0, i - AROUND), min(n, i + AROUND + 1))})
        plain = self.step(self.other)
        value, left = np.linalg.eig(plain)
        right = np.linalg.inv(left)

        def power(k: int) -> np.ndarray:
            m = np.real(left @ np.diag((value / np.abs(value).max()) ** k) @ right)
            return np.maximum(m, 0)

        ahead, state, at = [], np.array([1.0, 0.0]), -1
        jumps = []
        for j in near:
            gap = j - at - 1
            jump = power(gap) if gap > 3 else np.linalg.matrix_power(plain, gap)
            jumps.append(jump)
            state = state @ jump @ self.step(emission(j))
            state = state / state.sum()
            ahead.append(state)
            at = j
        gap = n - 1 - at
        back = (power(gap) if gap > 3 else np.linalg.matrix_power(plain, gap)) @ np.ones(2)
        out = np.zeros(len(near))
        for x in range(len(near) - 1, -1, -1):
            both = ahead[x] * back
            out[x] = both[1] / both.sum()
            back = jumps[x] @ self.step(emission(near[x])) @ (back / back.sum())
        return np.array(near), out

    def features(self, p: np.ndarray) -> tuple[float, float]:
        """Log-odds that any tag is toxic, and the expected number of toxic tags."""
        none = float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()) if len(p) else 0.0
        some = -np.expm1(min(none, -1e-4))
        return float(np.clip(np.log(some / (1 - some + 1e-9)), -8, 8)), float(np.log1p(p.sum())) if len(p) else 0.0

    def score(self, p: np.ndarray) -> float:
        f = self.features(p)
        return float(1 / (1 + np.exp(-np.clip(self.base + self.blend[0] * f[0] + self.blend[1] * f[1], -30, 30))))


class Sample:
    """Documents as arrays of word numbers, and the features of each word as numbers, ``per[w]`` of them from ``first[w]`` on."""

    def __init__(self, toxic: list[list[str]], clean: list[list[str]]):
        vocabulary: dict[str, int] = {}
        number = lambda d: np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in d), np.int64, len(d))
        self.toxic, self.clean = [number(d) for d in toxic], [number(d) for d in clean]
        names: dict[str, int] = {}
        each = [[names.setdefault(f, len(names)) for f in token_features(w)] for w in vocabulary]
        self.names, self.per = list(names), np.fromiter(map(len, each), np.int64, len(each))
        self.first = np.cumsum(self.per) - self.per
        self.features = np.fromiter((f for x in each for f in x), np.int64)

    def documents_with(self, docs: list[np.ndarray]) -> np.ndarray:
        """How many of ``docs`` hold each feature."""
        out, lo, size = np.zeros(len(self.names), np.int64), 0, max(1, len(self.names))
        while lo < len(docs):
            some = docs[lo : lo + 256]
            doc = np.repeat(np.arange(len(some)), [len(d) for d in some])
            pairs = np.unique(doc * max(1, len(self.per)) + np.concatenate(some)) if len(doc) else np.zeros(0, np.int64)
            doc, word = np.divmod(pairs, max(1, len(self.per)))
            n = self.per[word]
            at = np.repeat(self.first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out += np.bincount(np.unique(np.repeat(doc, n) * size + self.features[at]) % size, minlength=len(out))
            lo += 256
        return out


def label_features(sample: Sample, toxic: list[np.ndarray], precise: float = 0.9) -> np.ndarray:
    """Features that mark toxic documents: each occurrence there is a token labelled toxic. A feature counts if at least 4 of ``toxic``, its
    documents that aren't copies, have it, its share of them is ``precise`` of both shares, and a likelihood ratio (G squared) says that chance
    alone gives none such of all features tried."""
    k, b = sample.documents_with(toxic).astype(float), sample.documents_with(sample.clean).astype(float)
    n, m = max(1, len(toxic)), max(1, len(sample.clean))
    p = (k + b) / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = sum(np.where(x > 0, 2 * x * np.log(x / y), 0) for x, y in ((k, n * p), (b, m * p), (n - k, n - n * p), (m - b, m - m * p)))
    return np.flatnonzero((k >= 4) & (k / n >= precise * (k / n + (b + 0.5) / m)) & (g >= 2 * np.log(max(2, int((k > 0).sum())))))


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, np.ndarray]:
    """Log-likelihood, less ``ridge`` / 2 times theta squared, of weighted rows of tagged tokens and its gradient by forward-backward.

    ``x`` [row, token, place]: known features of a token, numbered from 1; -1: none; -2: the row is over. ``y``: tags. ``theta``: log-odds of any
    token, of each feature, after a tag 0 and after a tag 1.
    """
    size, (n, length) = len(theta) - 2, y.shape
    live = x[:, :, 0] >= -1
    e = theta[0] + np.where(x > 0, theta[np.maximum(x, 0)], 0).sum(2)
    up, k0, k1 = np.exp(np.clip(e, -20, 20)), np.exp(theta[-2]), np.exp(theta[-1])
    before = np.concatenate([np.zeros((n, 1), int), y[:, :-1]], 1)
    value = float((weight[:, None] * np.where(live & (y == 1), np.clip(e, -20, 20) + theta[-2 + before], 0)).sum()) - ridge / 2 * float(theta @ theta)
    f = np.zeros((length + 1, n, 2))
    f[0, :, 0] = 1
    for j in range(length):
        s0, s1 = f[j, :, 0] + f[j, :, 1], (f[j, :, 0] * k0 + f[j, :, 1] * k1) * up[:, j]
        z = s0 + s1
        value -= float((weight * np.where(live[:, j], np.log(z), 0)).sum())
        f[j + 1, :, 0], f[j + 1, :, 1] = np.where(live[:, j], s0 / z, f[j, :, 0]), np.where(live[:, j], s1 / z, f[j, :, 1])
    back, tag, moved = np.ones((n, 2)), np.zeros((n, length)), np.zeros(2)
    for j in range(length - 1, -1, -1):
        w01, w11 = f[j, :, 0] * k0 * up[:, j] * back[:, 1], f[j, :, 1] * k1 * up[:, j] * back[:, 1]
        z = (f[j, :, 0] + f[j, :, 1]) * back[:, 0] + w01 + w11
        p01, p11 = np.where(live[:, j], w01 / z, 0), np.where(live[:, j], w11 / z, 0)
        tag[:, j] = p01 + p11
        moved += np.array([weight @ p01, weight @ p11])
        b0, b1 = back[:, 0] + k0 * up[:, j] * back[:, 1], back[:, 0] + k1 * up[:, j] * back[:, 1]
        back = np.where(live[:, j, None], np.stack([b0 / (b0 + b1), b1 / (b0 + b1)], 1), back)
    more = weight[:, None] * (np.where(live, y, 0) - tag)
    grad = np.zeros_like(theta)
    grad[:size] = np.bincount(np.maximum(x, 0).ravel(), np.where(x > 0, more[..., None], 0).ravel(), size)
    grad[0] = more.sum()
    for t in (0, 1):
        grad[-2 + t] = float((weight[:, None] * (live & (y == 1) & (before == t))).sum()) - moved[t]
    return value, grad - ridge * theta


def fit_chain(toxic: list[list[str]], clean: list[list[str]], epochs: int = 70, rate: float = 0.25, length: int = 48, flat: float = 1e-5) -> Chain:
    """Maximum likelihood of labelled tokens with forward-backward gradients (Adam, until it is ``flat``), then a logistic blend of the documents'
    marginals. Rows of ``length`` tokens with known features and each document's first row are learned from; equal rows count as one."""
    originals = {id(d) for d in distinct_documents(toxic)}
    sample = Sample(toxic, clean)
    marks = label_features(sample, [s for s, d in zip(sample.toxic, toxic, strict=True) if id(d) in originals])
    order = np.argsort(np.array([sample.names[f] for f in marks], dtype=object)) if len(marks) else np.zeros(0, np.int64)
    names = [sample.names[marks[i]] for i in order]
    number = np.zeros(len(sample.names), np.int64)
    number[marks[order]] = np.arange(1, len(names) + 1)
    wide = 1 + len(BEGINNINGS)
    tokens = np.full((len(sample.per), wide), -1, np.int64)  # the known features of each word
    for w in np.flatnonzero(np.add.reduceat(number[sample.features] > 0, sample.first)) if len(sample.per) else []:
        own = number[sample.features[sample.first[w] : sample.first[w] + sample.per[w]]]
        tokens[w, : (own > 0).sum()] = own[own > 0]
    has = tokens[:, 0] > 0
    rows, tags = [], []
    for docs, is_toxic in ((sample.toxic, 1), (sample.clean, 0)):
        for d in docs:
            hits = np.flatnonzero(has[d])
            for b in sorted({0, *(np.maximum(0, hits - length // 2) // length * length).tolist()}) if len(d) else []:
                part = d[b : b + length]
                rows.append(np.concatenate([tokens[part], np.full((length - len(part), wide), -2)]))
                tags.append(np.concatenate([is_toxic * has[part], np.zeros(length - len(part), bool)]))
    theta = np.zeros(len(names) + 3)  # other, known features; after 0, after 1
    theta[0] = -4.0
    if rows:
        both, weight = np.unique(np.concatenate([np.array(rows).reshape(len(rows), -1), np.array(tags, np.int64)], 1), axis=0, return_counts=True)
        x, y, weight = both[:, : length * wide].reshape(-1, length, wide), both[:, length * wide :], weight.astype(float)
        m1, v1, last = np.zeros_like(theta), np.zeros_like(theta), -np.inf
        for t in range(1, epochs + 1):
            value, g = likelihood(theta, x, y, weight)
            if abs(value - last) < flat * abs(value):
                break
            last = value
            m1, v1 = 0.9 * m1 + 0.1 * g, 0.99 * v1 + 0.01 * g * g
            theta = theta + rate * (m1 / (1 - 0.9**t)) / (np.sqrt(v1 / (1 - 0.99**t)) + 1e-8)
    chain = Chain({w: float(theta[i + 1]) for i, w in enumerate(names)}, float(theta[0]), (float(theta[-2]), float(theta[-1])), (1.0, 0.0), 0.0)
    none = chain.features(np.zeros(0))
    feats = np.array([chain.features(chain.marginals(d)[1]) if has[s].any() else none for docs, some in ((toxic, sample.toxic), (clean, sample.clean)) for d, s in zip(docs, some, strict=True)]).reshape(-1, 2)
    # documents are weighted so that both labels count alike; scores order documents in any case
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    weight = np.concatenate([np.full(len(toxic), 0.5 / max(1, len(toxic))), np.full(len(clean), 0.5 / max(1, len(clean)))])
    b = np.zeros(3)
    full = np.concatenate([feats, np.ones((len(feats), 1))], 1)
    if not names:  # nothing was learned: all have the share of toxic documents, as if there were one more toxic and one more clean one
        chain.blend, chain.base = (0.0, 0.0), float(np.log((len(toxic) + 1) / (len(clean) + 2)))
        return chain
    if len(toxic) and len(clean):
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(full @ b, -30, 30)))
            grad = full.T @ (weight * (y - p)) - 1e-3 * b
            hess = (full * (weight * p * (1 - p))[:, None]).T @ full + 1e-3 * np.eye(3)
            b = b + np.linalg.solve(hess, grad)
    chain.blend, chain.base = (max(0.0, float(b[0])), max(0.0, float(b[1]))), float(b[2])
    return chain


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, per_clean: int = PER_CLEAN) -> Chain:
    """Fit on labelled rows that aren't held out: about ``per_label`` toxic and ``per_clean`` other documents, chosen by a hash of doc_id. A doc_id
    with several labels counts as toxic if one is; null labels, ids and texts tell nothing; rows that repeat an id count each."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for k, c in n.items():
        share = F.when(F.col("toxic") == k, F.lit(int(min(1.0, (per_label if k else per_clean) / c) * (1 << 31)))).otherwise(share)
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < share)
    texts = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    same: dict[str, str] = {}  # each word's text is held once
    split: dict[int, list[list[str]]] = {0: [], 1: []}
    for batch in texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text").toArrow().to_batches(max_chunksize=100):
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            split[k].append([same.setdefault(w, w) for w in token_words(text.as_py())])
    return fit_chain(split[1], split[0])


def tag(documents: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, score, spans), written to the shared folder, of every row of ``documents`` (doc_id, text); spans: (start, end, probability), in characters of the lower-cased
    text, of words tagged toxic with at least ``SPAN``.

    Null, empty and word-less texts have the score of a text without known words and no spans; rows that repeat and null ids stay; an
    empty table gives an empty result; very long texts are read whole; other columns are not read. Without labels of both kinds all scores are equal, 1 / 3 without any.
    """
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches):
        model = shared.value
        none = model.score(np.zeros(0))
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                low = (text.as_py() or "").lower()
                ws = WORD.findall(low)
                near, p = model.marginals(ws)
                if not len(near):
                    scores.append(none)
                    spans.append([])
                    continue
                at = [m.span() for m in WORD.finditer(low)]
                scores.append(model.score(p))
                spans.append([{"start": at[i][0], "end": at[i][1], "probability": float(x)} for i, x in zip(near, p, strict=True) if x >= SPAN])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])
        model.forget()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.store(rows.mapInArrow(textkit.frugal(run), "doc_id long, score double, spans array<struct<start:int,end:int,probability:double>>"), "tags")[0]


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``documents`` whose score is under ``threshold``; all columns stay, whatever their names.

    Null, empty and word-less texts have the score of a text without known words, and so stay where clean texts do; very long texts are read
    whole; rows that repeat are judged alike, null ids stay, an empty table stays empty. Without labels of both kinds no document is told from
    another: then all stay, unless most labels are toxic.
    """
    chain = train(documents.select("doc_id", "text"), labels)
    doc = F.col("doc_id").cast("string")
    key = F.struct(doc.isNull().alias("absent"), F.coalesce(doc, F.lit("")).alias("doc_id"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("version"))
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def reject(batches):
        model = shared.value
        for batch in batches:
            bad = [model.score(model.marginals(token_words(t.as_py() or ""))[1]) >= threshold for t in batch.column(1)]
            yield batch.select([0]).filter(pa.array(bad, pa.bool_()))
        model.forget()

    # only what names the rejected rows comes back from Python; the rows themselves stay in the JVM
    rows = documents.select(key.alias("__key"), F.col("text").cast("string").alias("text"))
    gone, _ = work.store(rows.mapInArrow(textkit.frugal(reject), rows.select("__key").schema), "toxic")
    return work.unpacked(work.packed(documents, __key=key).join(work.small(gone), "__key", "left_anti"), documents.columns)


def op1_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = tag(docs, train(docs, work.read(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
