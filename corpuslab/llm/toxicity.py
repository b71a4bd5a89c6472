"""Toxicity by a subsequence string kernel SVM with Nyström landmarks.

Strings are the words of the labelled texts. The kernel counts common subsequences of three characters within a
span of five, a gap weighing DECAY per skipped character, so a stem still matches with inserted or missing
characters and with endings it was never seen with. A document is as toxic as its worst word; word labels come
from the document labels (multiple-instance learning): all words of clean documents are negative, and of toxic
documents those are positive that hold a character run found almost only in toxic documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch
from corpuslab.llm.tokens import in_chunks
from corpuslab.operators.ordering import top_n

SAMPLE_DOCS = 20_000  # labelled documents a model is fitted on at most
LANDMARKS = 128
WORDS_PER_CLASS = 3_000
DECAY = 0.7
SHAPES = [(1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2)]  # distances between the three characters
LONGEST = 24
RUN = 4
CACHED_WORDS = 200_000  # scores a task keeps
CHUNK = 1 << 19  # characters of text scored at a time
FEATURES = 64**3

_BLANKS = bytes.maketrans(b"\t\n\v\f\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"     abcdefghijklmnopqrstuvwxyz")
# Letters 1-26, digits 27-36, other bytes of UTF-8 letters 37-61, word start 62, word end 63; the rest is a gap.
_CODES = np.zeros(256, np.int64)
_CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODES[ord("0") : ord("9") + 1] = np.arange(27, 37)
_CODES[128:] = 37 + np.arange(128) % 25


def split_words(text: str | None) -> set[bytes]:
    """Distinct words of a text; a very long one counts as overlapping parts."""
    raw = (text or "").encode().translate(_BLANKS)
    found = set(raw.split(b" "))
    found.discard(b"")
    for w in [w for w in found if len(w) > LONGEST]:
        found.discard(w)
        found.update(w[i : i + LONGEST] for i in range(0, max(1, len(w) - 8), LONGEST - 8))
    return found


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights), each (words, places): normalised kernel features, weight 0 where there is none."""
    width = LONGEST + 2
    codes = np.zeros((len(words), width), np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    codes[row, column] = _CODES[flat]
    codes[:, 0] = 62
    codes[np.arange(len(words)), lengths + 1] = 63
    features, weights = [], []
    for a, b in SHAPES:
        n = width - a - b
        x, y, z = codes[:, :n], codes[:, a : a + n], codes[:, a + b :]
        features.append(x * 4096 + y * 64 + z)
        weights.append(((x > 0) & (y > 0) & (z > 0)) * np.float32(DECAY ** (a + b - 2)))
    f, w = np.concatenate(features, axis=1), np.concatenate(weights, axis=1)
    norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
    return f, w / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    """Word scores are linear in the kernel features: the landmark expansion is folded into ``weights``."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def score_words(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for at in range(0, len(words), 4096):
            f, w = subsequences(words[at : at + 4096])
            out[at : at + 4096] = (self.weights[f] * w).sum(axis=1) + self.bias
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -60, 60)))


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """(words, landmarks) kernel values; only features of the landmarks matter."""
    lf, lw = subsequences(landmarks)
    known, place = np.unique(lf[lw > 0], return_inverse=True)
    dense = np.zeros((len(landmarks), len(known)), np.float32)
    np.add.at(dense, (np.nonzero(lw > 0)[0], place), lw[lw > 0])
    column = np.full(FEATURES, -1, np.int64)
    column[known] = np.arange(len(known))
    out = np.empty((len(words), len(landmarks)))
    for at in range(0, len(words), 512):
        f, w = subsequences(words[at : at + 512])
        own = np.zeros((len(f), len(known)), np.float32)
        use = (w > 0) & (column[f] >= 0)
        np.add.at(own, (np.nonzero(use)[0], column[f[use]]), w[use])
        out[at : at + 512] = own @ dense.T
    return out


def spread_out(words: list[bytes], n: int) -> list[bytes]:
    """Landmarks: each next one is the word least like those chosen before."""
    words = words[:1500]
    similar = kernel(words, words)
    chosen, best = [0], similar[0].copy()
    while len(chosen) < min(n, len(words)):
        k = int(best.argmin())
        chosen.append(k)
        best = np.maximum(best, similar[k])
    return [words[i] for i in chosen]


def fit_words(positive: list[bytes], negative: list[bytes]) -> Model:
    """Linear SVM (squared hinge, balanced classes) on the Nyström features, solved by Newton steps."""
    landmarks = spread_out(positive, LANDMARKS // 2) + spread_out(negative, LANDMARKS // 2)
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    use = values > 1e-4
    root = vectors[:, use] / np.sqrt(values[use])
    x = np.hstack([kernel(positive + negative, landmarks) @ root, np.ones((len(positive) + len(negative), 1))])
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    cost = np.where(y > 0, 0.5 / len(positive), 0.5 / len(negative)) * len(y)
    ridge = np.eye(x.shape[1]) * 1.0
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(50):
        part = x[active] * cost[active, None]
        w = np.linalg.solve(ridge + part.T @ x[active], part.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    f, v = subsequences(landmarks)
    weights = np.zeros(FEATURES)
    np.add.at(weights, f, v * (root @ w[:-1])[:, None])
    return Model(weights.astype(np.float32), float(w[-1]))


def calibrate(model: Model, worst: np.ndarray, toxic: np.ndarray) -> None:
    """Logistic curve over the documents' worst words, with smoothed targets."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([worst, np.ones(len(worst))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(max(w[0], 1e-6)), float(w[1])


NO_WORD = -1.0


def _worst(texts: list[str | None], model: Model, known: dict[bytes, float]) -> list[float]:
    """Largest word score of each text; ``known`` keeps word scores between calls, a bounded number."""
    if len(known) > CACHED_WORDS:
        known.clear()
    each = [split_words(t) for t in texts]
    new = list(set().union(*each).difference(known))
    known.update(zip(new, model.score_words(new).tolist()))
    value = known.__getitem__
    return [max(map(value, ws), default=NO_WORD) for ws in each]


def worst_words(docs: DataFrame, model: Model, with_word: bool = False) -> DataFrame:
    """doc_id, worst (largest word score; that of no word is -1), and the word itself, for whole texts."""
    kinds = "doc_id long, worst double" + ", word binary" * with_word

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in in_chunks(texts, CHUNK):
                worst = _worst(texts[lo:hi], model, known)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(worst, pa.float64())]
                if with_word:
                    value = known.__getitem__
                    columns.append(pa.array([max(split_words(t), key=lambda w: (value(w), w), default=None) for t in texts[lo:hi]], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "worst", "word"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, kinds)


def _counted(train: DataFrame, parts) -> DataFrame:
    """part, toxic, clean: in how many documents of each label ``parts(words, toxic)`` yields a part. Counted in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(parts(split_words(text), toxic))
        every = list(set(counts[0]) | set(counts[1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(every, pa.binary()), pa.array([counts[1][p] for p in every], pa.int64()), pa.array([counts[0][p] for p in every], pa.int64())], ["part", "toxic", "clean"]
        )

    made = train.select("text", "toxic").mapInArrow(count, "part binary, toxic long, clean long")
    return made.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _runs(words: set[bytes]) -> set[bytes]:
    return {w[i : i + RUN] for w in words for i in range(len(w) - RUN + 1)}


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from at most ``sample_docs`` labelled documents, taken in the order of a hash of doc_id.

    Only labels whose crc32(doc_id) mod 5 is not 0 are used. None when either label is missing.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = top_n(usable, sample_docs, F.md5(F.col("doc_id").cast("string")), F.col("doc_id"))
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_docs rows
    train = scratch.settle(train, "train")
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    rate = sizes[1] / (sizes[0] + sizes[1])
    runs = _counted(train, lambda words, _: _runs(words))
    evidence = F.col("toxic") * F.log(F.col("toxic") / (F.col("toxic") + F.col("clean")) / rate) * 2
    telling = runs.where((F.col("toxic") >= 3) & (F.col("toxic") >= 9 * F.col("clean")) & (evidence > 20))
    marks = frozenset(bytes(r["part"]) for r in top_n(telling.withColumn("g", evidence), 2000, F.desc("g"), F.col("part")).collect())

    def instances(words: set[bytes], toxic: int) -> set[bytes]:
        return {w for w in words if not toxic or not marks.isdisjoint(_runs({w}))}

    found = scratch.settle(_counted(train, instances), "instances")
    positive = [bytes(r["part"]) for r in top_n(found.where("toxic > 0 and clean = 0"), WORDS_PER_CLASS, F.desc("toxic"), F.md5("part")).collect()]
    clean = found.where("clean > 0")
    negative = [bytes(r["part"]) for r in top_n(clean, WORDS_PER_CLASS // 2, F.desc("clean"), F.col("part")).collect()]
    negative += [bytes(r["part"]) for r in top_n(clean, WORDS_PER_CLASS // 2, F.md5("part")).collect()]
    negative = list(dict.fromkeys(negative))
    if not positive or not negative:
        return None
    model = fit_words(positive, negative)
    # Once more, with the clean documents' worst words among the negatives.
    hard = worst_words(train.where("toxic = 0"), model, True).where("word is not null").groupBy("word").agg(F.max("worst").alias("worst"))
    hard = [bytes(r["word"]) for r in top_n(hard, WORDS_PER_CLASS, F.desc("worst"), F.col("word")).collect()]
    model = fit_words(positive, list(dict.fromkeys([*negative, *hard])))
    scored = worst_words(train, model).join(F.broadcast(chosen), "doc_id").select("worst", "toxic").toPandas()
    calibrate(model, scored["worst"].to_numpy(float), scored["toxic"].to_numpy(float))
    return model


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5) per row of documents (doc_id, text).

    Null and empty texts get the score of no word. Without a model, for want of labels, every score is 0.
    Other columns are ignored; repeated rows get a row each; null ids are kept.
    """
    if model is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("worst") * model.slope + model.shift))
    return worst_words(docs, model).select("doc_id", (1 / (1 + F.exp(-z))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_rows(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; all rows without a model."""
    if model is None:
        return docs
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            texts, clean = batch.column(at).to_pylist(), []
            for lo, hi in in_chunks(texts, CHUNK):
                worst = _worst(texts[lo:hi], model, known)
                clean.append(model.probability(np.array(worst)) < 0.5)
            if clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(keep, docs.schema)


def score_all(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
