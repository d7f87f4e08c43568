"""Relational graph convolutions, forward and backward, and their training (Schlichtkrull et al. 2018).

``edges``: head_id, relation_id, tail_id. ``features``: (id, vec). Messages of one relation into a node are averaged, sent
through the relation's weights, and added to the node's own transform.

Nodes and edges are tables. Vectors are added within tasks before they are shuffled, as arrays. The weights, relations
times dimension squared, are few, and stay on the driver; their gradients are sums of outer products per relation, formed
in the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.functions.draws import draw32
from triplane.operators.sample import batches
from triplane.operators.store import DECAY_M, DECAY_V, EPSILON, KEY, Rule, Store
from triplane.operators.sums import summed_vectors
from triplane.operators.train import GRADIENT, Settings, chances, gradients, summed, with_negatives
from triplane.shared import discard, materialise


def weights(n_relations: int, dim_in: int, dim_out: int, kind: str = "bases", n_bases: int = 2, seed: int = 0) -> np.ndarray:
    """[relation, in, out] from shared bases, from diagonal blocks, or on their own."""
    return Weights.drawn(n_relations, dim_in, dim_out, kind, n_bases, seed).full


def drawn_weights(n_relations: int, dim_in: int, dim_out: int, name: str = "w", seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """[relation, in, out] and the node's own [in, out] (relation -1), uniform in (-1, 1) / sqrt(in), by the same hash as all draws."""

    def one(r: int, i: int, o: int) -> float:
        return int(hashlib.md5(f"{seed}:{name}:{r}:{i}:{o}".encode()).hexdigest()[:8], 16) / float(1 << 32) * 2 - 1

    full = np.array([[[one(r, i, o) for o in range(dim_out)] for i in range(dim_in)] for r in range(-1, n_relations)]) * dim_in**-0.5
    return full[1:], full[0]


@dataclass
class Weights:
    """What the weights of a layer are made of: ``parts`` by name. bases: [r, b] times [b, in, out]; blocks: a mask; full: as they are."""

    parts: dict[str, np.ndarray]
    mask: np.ndarray | None = None
    moments: dict = field(default_factory=dict)

    @classmethod
    def drawn(cls, n_relations: int, dim_in: int, dim_out: int, kind: str = "bases", n_bases: int = 2, seed: int = 0) -> Weights:
        r = np.random.default_rng(seed)
        scale = dim_in**-0.5
        if kind == "bases":
            return cls({"share": r.normal(size=(n_relations, n_bases)), "base": r.normal(0, scale, (n_bases, dim_in, dim_out))})
        full = r.normal(0, scale, (n_relations, dim_in, dim_out))
        if kind == "blocks":
            if dim_in % n_bases or dim_out % n_bases:
                raise ValueError("blocks must divide both dimensions")
            return cls({"full": full}, np.kron(np.eye(n_bases), np.ones((dim_in // n_bases, dim_out // n_bases))))
        return cls({"full": full})

    def with_own(self, own: np.ndarray) -> Weights:
        self.parts["own"] = own
        return self

    @property
    def full(self) -> np.ndarray:
        if "base" in self.parts:
            return np.einsum("rb,bio->rio", self.parts["share"], self.parts["base"])
        return self.parts["full"] if self.mask is None else self.parts["full"] * self.mask

    def gradients(self, d_full: np.ndarray, d_own: np.ndarray) -> dict[str, np.ndarray]:
        """Of the parts, from those of the weights."""
        if "base" in self.parts:
            return {"share": np.einsum("rio,bio->rb", d_full, self.parts["base"]), "base": np.einsum("rb,rio->bio", self.parts["share"], d_full), "own": d_own}
        return {"full": d_full if self.mask is None else d_full * self.mask, "own": d_own}

    def descend(self, grads: dict[str, np.ndarray], step: int, rate: float) -> None:
        """One step of Adam."""
        for name, g in grads.items():
            m, v = self.moments.get(name, (0.0, 0.0))
            m, v = DECAY_M * m + (1 - DECAY_M) * g, DECAY_V * v + (1 - DECAY_V) * g * g
            self.moments[name] = m, v
            self.parts[name] = self.parts[name] - rate * (m / (1 - DECAY_M**step)) / (np.sqrt(v / (1 - DECAY_V**step)) + EPSILON)


ACTIVATIONS = {"relu": lambda x: F.greatest(x, F.lit(0.0)), "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.01 * x), "none": lambda x: x}
#: Of the gradient below zero.
SLOPES = {"relu": 0.0, "leaky_relu": 0.01, "none": 1.0}


def _kept(df: DataFrame, rate: float, seed: int, *key: str) -> DataFrame:
    """Rows drawn by hash, the same in forward and backward passes."""
    return df.where(draw32(f"drop:{seed}", *[F.lit(k) if k == "own" else F.col(k) for k in key]) >= int(rate * (1 << 32))) if rate else df


def messages(edges: DataFrame, features: DataFrame, dropout: float = 0.0, own_dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """``(id, relation_id, vec, n)``: means of n neighbours, and each node itself as relation -1; dropped ones are drawn by hash."""
    kept = _kept(edges, dropout, seed, "head_id", "relation_id", "tail_id")
    source = features.select(F.col("id").alias("head_id"), "vec")
    each = kept.join(source, "head_id").select(F.col("tail_id").alias("id"), F.col("relation_id").cast("long").alias("relation_id"), "vec")
    mean = summed_vectors(each, ["id", "relation_id"]).select("id", "relation_id", F.transform("total", lambda x: x / F.col("n")).alias("vec"), "n")
    selves = _kept(features.select("id", F.lit(-1).cast("long").alias("relation_id"), F.col("vec").cast("array<double>"), F.lit(1).cast("long").alias("n")), own_dropout, seed, "own", "id")
    return mean.unionByName(selves)


def sent(received: DataFrame, features: DataFrame, w: np.ndarray, own: np.ndarray) -> DataFrame:
    """``(id, vec)``: the sums of messages through the weights, before activation; zero where there are none."""

    def transform(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r, rows in pdf.groupby("relation_id"):
                out = np.stack(rows["vec"]).astype(np.float64) @ (own if r < 0 else w[int(r)])
                yield pd.DataFrame({"id": rows["id"], "vec": list(out)})

    moved = received.select("id", "relation_id", "vec").mapInPandas(transform, "id long, vec array<double>")
    zero = F.array_repeat(F.lit(0.0), int(own.shape[1]))
    return features.select("id").join(summed_vectors(moved, ["id"]), "id", "left").select("id", F.coalesce("total", zero).alias("vec"))


def layer(edges: DataFrame, features: DataFrame, w: np.ndarray, own: np.ndarray, activation: str = "relu", dropout: float = 0.0, own_dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """``(id, vec)`` after one layer."""
    out = sent(messages(edges, features, dropout, own_dropout, seed), features, w, own)
    return out.select("id", F.transform("vec", ACTIVATIONS[activation]).alias("vec"))


def layer_gradients(edges: DataFrame, received: DataFrame, before: DataFrame, slope: DataFrame, w: np.ndarray, own: np.ndarray, activation: str = "relu", dropout: float = 0.0, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Gradients of the features (id, grad; nodes without one are left out), of the weights and of the own weights.

    ``received``: the layer's :func:`messages`; ``before``: its sums before activation (:func:`sent`); ``slope``: (id, grad) of its output.
    """
    low = SLOPES[activation]
    passed = F.zip_with("grad", "vec", lambda g, z: F.when(z > 0, g).otherwise(low * g)) if low != 1.0 else F.col("grad")
    inner = slope.join(before, "id").select("id", passed.alias("grad"))
    met = materialise(received.join(inner, "id"))

    def outer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r, rows in pdf.groupby("relation_id"):
                yield pd.DataFrame({"relation_id": [r], "vec": [(np.stack(rows["vec"]).T @ np.stack(rows["grad"])).ravel()]})

    def returned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r, rows in pdf.groupby("relation_id"):
                back = np.stack(rows["grad"]) @ (own if r < 0 else w[int(r)]).T / rows["n"].to_numpy()[:, None]
                yield pd.DataFrame({"id": rows["id"], "relation_id": rows["relation_id"], "vec": list(back)})

    d_w, d_own = np.zeros(w.shape), np.zeros(own.shape)
    for row in summed_vectors(met.mapInPandas(outer, "relation_id long, vec array<double>"), ["relation_id"]).collect():  # one row per relation
        total = np.array(row["total"]).reshape(own.shape)
        if row["relation_id"] < 0:
            d_own = total
        else:
            d_w[row["relation_id"]] = total
    back = materialise(met.mapInPandas(returned, "id long, relation_id long, vec array<double>"))
    along = _kept(edges, dropout, seed, "head_id", "relation_id", "tail_id").join(back.withColumnRenamed("id", "tail_id"), ["tail_id", "relation_id"])
    every = along.select(F.col("head_id").alias("id"), "vec").unionByName(back.where("relation_id < 0").select("id", "vec"))
    out = materialise(summed_vectors(every, ["id"]).select("id", F.col("total").alias("grad")))
    for table in (met, back):
        discard(table)
    return out, d_w, d_own


@dataclass
class Encoder:
    """Layers of one size; the last has no activation."""

    layers: list[Weights]
    activation: str = "relu"
    dropout: float = 0.0
    own_dropout: float = 0.0
    tape: list[tuple] = field(default_factory=list)

    @classmethod
    def drawn(cls, n_relations: int, dim: int, layers: int = 2, activation: str = "relu", kind: str = "bases", seed: int = 0, **dropouts) -> Encoder:
        own = [np.random.default_rng(seed * 100 + i).normal(0, dim**-0.5, (dim, dim)) for i in range(layers)]
        return cls([Weights.drawn(n_relations, dim, dim, kind, seed=seed * 100 + i).with_own(own[i]) for i in range(layers)], activation, **dropouts)

    def _activation(self, i: int) -> str:
        return self.activation if i + 1 < len(self.layers) else "none"

    def forward(self, edges: DataFrame, features: DataFrame, seed: int = 0, keep: bool = False) -> DataFrame:
        """``(id, vec)``. ``keep``: written down for :meth:`backward`, with dropouts; without, nothing is dropped."""
        self.tape, drops = [], (self.dropout, self.own_dropout) if keep else (0.0, 0.0)
        for i, layer_weights in enumerate(self.layers):
            received = messages(edges, features, *drops, seed=seed + i)
            received = materialise(received) if keep else received
            before = sent(received, features, layer_weights.full, layer_weights.parts["own"])
            before = materialise(before) if keep else before
            if keep:
                self.tape.append((received, before, seed + i))
            features = before.select("id", F.transform("vec", ACTIVATIONS[self._activation(i)]).alias("vec"))
        return features

    def backward(self, edges: DataFrame, slope: DataFrame) -> tuple[DataFrame, list[dict[str, np.ndarray]]]:
        """Gradients of the features and of each layer's parts, from those (id, grad) of the output; the tape is used up."""
        grads = []
        for i in reversed(range(len(self.layers))):
            received, before, seed = self.tape[i]
            w = self.layers[i]
            slope, d_full, d_own = layer_gradients(edges, received, before, slope, w.full, w.parts["own"], self._activation(i), self.dropout, seed)
            grads.insert(0, w.gradients(d_full, d_own))
        for received, before, _ in self.tape:
            discard(received)
            discard(before)
        self.tape = []
        return slope, grads


def encode(edges: DataFrame, features: DataFrame, n_relations: int, dim: int, layers: int = 2, activation: str = "relu", kind: str = "bases", seed: int = 0, dropout: float = 0.0, own_dropout: float = 0.0) -> DataFrame:
    """Two layers by default, of random weights; the last has no activation."""
    encoder = Encoder.drawn(n_relations, dim, layers, activation, kind, seed)
    for i, w in enumerate(encoder.layers):
        features = layer(edges, features, w.full, w.parts["own"], encoder._activation(i), dropout, own_dropout, seed + i)
    return features


def train(triples: DataFrame, features: list[DataFrame], relations: DataFrame, encoders: list[Encoder], settings: Settings, epochs: int = 1) -> tuple[list[DataFrame], DataFrame, list[dict]]:
    """Encodes, scores and learns: features, relations, and the weights of ``encoders`` (in place), all by Adam.

    ``triples``: pos and ids; they are the edges too. ``features``: (id, vec), one table for each encoder: one for the decoder
    transe, two (points and bumps) for boxe. ``relations``: (id, x), the decoder's tensors one after the other. Returns the encoded
    nodes (id, vec) of each encoder, relations (id, x), and per epoch the mean loss and updates.
    """
    edges = triples.select("head_id", "relation_id", "tail_id")
    n_entities, n_relations = features[0].count(), relations.count()
    tables = [f.select(F.lit(0).alias("trial"), F.lit(f"x{k}").alias("tbl"), "id", F.col("vec").cast("array<double>").alias("x")) for k, f in enumerate(features)]
    tables.append(relations.select(F.lit(0).alias("trial"), F.lit("r").alias("tbl"), "id", "x"))
    start = tables[0]
    for other in tables[1:]:
        start = start.unionByName(other)
    rule = Rule(settings.rate, "adam")
    store = Store(start, {(0, t): rule for t in [*(f"x{k}" for k in range(len(features))), "r"]})
    stats = chances(triples, {0: settings})
    step, history = 0, []
    dim = len(features[0].first()["vec"])
    for epoch in range(epochs):
        lost = updates = 0
        dealt = materialise(batches(triples, epoch, settings.n_batches, settings.seed))
        for b in range(settings.n_batches):
            step += 1
            now = materialise(store.rows({0: step - 1}))
            encoded = []
            for k, encoder in enumerate(encoders):
                own = now.where(F.col("tbl") == f"x{k}").select("id", F.col("x").alias("vec"))
                encoded.append(materialise(encoder.forward(edges, own, seed=1000 * step + 100 * k, keep=True)))
            e = encoded[0]
            for other in encoded[1:]:
                e = e.join(other.withColumnRenamed("vec", "more"), "id").select("id", F.concat("vec", "more").alias("vec"))
            part = dealt.where(F.col("batch") == b).withColumns({"trial": F.lit(0), "of": F.lit(settings.seed * 1000 + epoch)})
            rows = materialise(with_negatives(part, {0: settings}, n_entities, n_relations, stats))
            r = now.where("tbl = 'r'").select("id", "x")
            met = rows
            for table, key, name, value in ((e, "head_id", "h", "vec"), (e, "tail_id", "t", "vec"), (r, "relation_id", "r", "x")):
                met = met.join(table.select(F.col("id").alias(key), F.col(value).alias(name)), key)
            steps = materialise(met.repartition("pos").sortWithinPartitions("trial", "pos", "k").mapInPandas(gradients({0: settings}), GRADIENT))
            moved = materialise(summed(steps))
            change = moved.where("tbl = 'r'").select(*KEY, "grad")
            for k, encoder in enumerate(encoders):
                slope = moved.where("tbl = 'e'").select("id", F.slice("grad", 1 + k * dim, dim).alias("grad"))
                back, grads = encoder.backward(edges, slope)
                change = change.unionByName(back.select(F.lit(0).alias("trial"), F.lit(f"x{k}").alias("tbl"), "id", "grad"))
                for w, g in zip(encoder.layers, grads, strict=True):
                    w.descend(g, step, settings.rate)
            store.change(now, change, {0: step})
            total = steps.where("tbl = 'loss'").agg(F.sum("loss"), F.sum("updates")).first()
            lost, updates = lost + total[0], updates + total[1]
            for table in (now, *encoded, rows, steps, moved):
                discard(table)
        history.append({"epoch": epoch, "mean_loss": lost / updates if updates else 0.0, "updates": updates})
    last = materialise(store.rows({0: step}))
    out = [materialise(encoder.forward(edges, last.where(F.col("tbl") == f"x{k}").select("id", F.col("x").alias("vec")))) for k, encoder in enumerate(encoders)]
    return out, last.where("tbl = 'r'").select("id", "x"), history
