"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of about :data:`PASSAGE` characters, of its whole text. Each passage is encoded: all runs of
three bytes, hashed with signs into :data:`GRAMS` sums, and shares of character classes, repetition and length of words, go
through one learned layer. Gated attention (a tanh and a
sigmoid branch, multiplied) gives each passage a weight, the weights of a document add up to one, and the score is a
logistic function of the weighted sum of the encodings. Only documents carry labels; the attention learns which passages
they come from.

Training reads at most :data:`SAMPLE` labelled documents, the first by a hash of their id, in folds that the caller
names; their passages are encoded by Spark tasks, and gradient steps run on the driver, always in the same order. The
weights are a few thousand numbers. Scoring is an Arrow function of the text column, for all rows, in batches.

A null or empty text is one empty passage, so it has a score too. A document without an id is scored and not held out.
Repeated rows get equal scores; of texts that share a labelled id, the least is learned from. Without labelled rows of both kinds the score is their share of ones, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplane.shared import materialise

PASSAGE = 1000
#: Labelled documents that training reads at most, their passages in all, and those of one of them; longer documents are not learnt from.
SAMPLE, PASSAGES, LONGEST = 6000, 40_000, 2000
#: Sums that the runs of three bytes are hashed into.
GRAMS = 256
HIDDEN, GATES = 16, 8
EPOCHS, BATCH, RATE, DECAY = 60, 128, 0.01, 1e-4

# The character classes, by ASCII code; all else is letters of other scripts.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", "|", "#$%&*@^~+=", "<>{}[]()", "\"'`", "-_/\\", ":;")
_CLASS = np.full(256, len(CLASSES), dtype=np.int64)
for _i, _chars in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
FEATURES = len(CLASSES) + 1 + 6 + GRAMS


def passages(text: str) -> list[str]:
    """The whole text, cut at the first space after every :data:`PASSAGE` characters."""
    out, at = [], 0
    while len(text) - at > PASSAGE + PASSAGE // 10:
        cut = text.find(" ", at + PASSAGE, at + PASSAGE + PASSAGE // 10)
        cut = at + PASSAGE if cut < 0 else cut
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def grams(raw: np.ndarray) -> np.ndarray:
    """Signed sums of the runs of three bytes, of length one."""
    b = raw.astype(np.uint32)
    h = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    sums = np.bincount(h % np.uint32(2 * GRAMS), minlength=2 * GRAMS)
    out = np.sqrt(sums[:GRAMS]) - np.sqrt(sums[GRAMS:])
    return out / max(1e-9, float(np.sqrt((out * out).sum())))


def features(passage: str) -> np.ndarray:
    raw = np.frombuffer(passage.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, len(raw))
    shares = np.bincount(_CLASS[raw], minlength=len(CLASSES) + 1) / n
    words = passage.split()
    k = max(1, len(words))
    distinct = len(set(words)) / k
    again = sum(map(eq, words, words[1:])) / k
    longest = max(map(len, words), default=0)
    lines = passage.split("\n")
    return np.concatenate([shares, [distinct, again, np.log1p(k), len(passage) / k / 10, np.log1p(longest), len(set(lines)) / len(lines)], grams(raw)])


def encode_batch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many each text has."""
    bags = [passages(t or "") for t in texts]
    return np.array([features(p) for bag in bags for p in bag], dtype=np.float32).reshape(-1, FEATURES), np.array([len(b) for b in bags], dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        logit = (t * g) @ w["a"]
        starts = np.cumsum(sizes) - sizes
        e = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), sizes))
        attention = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "attention": attention, "z": z, "score": _sigmoid(z @ w["c"] + w["d"])}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts or self.constant is not None:
            return np.full(len(texts), self.constant or 0.0)
        return self.forward(*encode_batch(texts))["score"]

    def gradient(self, x: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy."""
        w, f = self.weights, self.forward(x, sizes)
        h, t, g, att, starts = f["h"], f["t"], f["g"], f["attention"], np.cumsum(sizes) - sizes
        miss = (f["score"] - label) / len(label)
        dz = np.repeat(miss[:, None] * w["c"], sizes, axis=0)
        datt = (dz * h).sum(axis=1)
        dlogit = att * (datt - np.repeat(np.add.reduceat(att * datt, starts), sizes))
        dtg = dlogit[:, None] * w["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (att[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ dlogit, "c": f["z"].T @ miss, "d": miss.sum()}


def fit(x: np.ndarray, sizes: np.ndarray, label: np.ndarray, seed: int = 0) -> Model:
    """Adam over shuffled bags, with decay of the weights."""
    share = float(label.mean()) if len(label) else 0.5
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    if share in (0.0, 1.0) or not len(label):
        return Model(mean, spread, {}, share)
    r = np.random.default_rng(seed)
    normal = lambda a, b: r.normal(0, a**-0.5, (a, b))
    w = {"W": normal(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": normal(HIDDEN, GATES), "U": normal(HIDDEN, GATES), "a": np.zeros(GATES), "c": np.zeros(HIDDEN), "d": np.array(np.log(share / (1 - share)))}
    w["a"] += r.normal(0, 0.1, GATES)
    model = Model(mean, spread, w)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    starts, step = np.cumsum(sizes) - sizes, 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(sizes))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in own])
            step += 1
            for k, d in model.gradient(x[rows], sizes[own], label[own]).items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                pace = RATE * (1 - epoch / EPOCHS)
                w[k] = w[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8) - pace * DECAY * w[k]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of the labelled rows that are not held out: the least by hash, whole documents, as many as the sample's bounds let in."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    chosen = known.select("doc_id", F.col(label).cast("double").alias("quality_label")).orderBy(order, "doc_id", "quality_label").limit(sample)

    @F.arrow_udf("array<float>")
    def bag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [encode_batch([t.as_py()])[0].ravel() for t in batch]
            yield pa.array(rows, type=pa.list_(pa.float32()))

    # the sample is bounded, and so is what comes back: one text for each of its rows, and so many passages in all
    met = docs.select("doc_id", F.col("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    met = materialise(met.groupBy("doc_id", "quality_label").agg(F.min("text").alias("text")))
    sizes = met.select("doc_id", "quality_label", (F.floor(F.length("text") / PASSAGE) + 1).alias("n")).where(F.col("n").isNull() | (F.col("n") <= LONGEST))
    so_far = F.sum(F.coalesce("n", F.lit(1))).over(Window.orderBy(order, "doc_id", "quality_label"))  # SAMPLE rows
    fits = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= PASSAGES).select("doc_id", "quality_label")
    rows = met.join(F.broadcast(fits), ["doc_id", "quality_label"]).select("doc_id", "quality_label", bag(F.col("text")).alias("bag")).toArrow().combine_chunks()
    label = rows["quality_label"].to_numpy()
    order = np.lexsort([label, rows["doc_id"].to_numpy()])
    bags = rows["bag"].combine_chunks() if rows.num_rows else pa.array([], type=pa.list_(pa.float32()))
    starts = bags.offsets.to_numpy() // FEATURES
    sizes = np.diff(starts)[order]
    own = np.concatenate([np.zeros(0, dtype=np.int64), *(np.arange(starts[i], starts[i + 1]) for i in order.tolist())])
    return fit(bags.values.to_numpy().reshape(-1, FEATURES)[own], sizes, label[order].astype(float))


def score(text: Column, model: Model) -> Column:
    """Score between 0 and 1; higher: label 1 likelier."""

    @F.arrow_udf("double")
    def mil(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [model.score(batch[at : at + 500].to_pylist()) for at in range(0, len(batch), 500)]
            yield pa.array(np.concatenate([*parts, np.zeros(0)]), type=pa.float64())

    return mil(text)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), train(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with all columns as they are."""
    return docs.where(score(F.col("text"), train(docs, labels)) >= 0.5)
