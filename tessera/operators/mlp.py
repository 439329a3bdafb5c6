"""A small feed-forward network: trained on the driver with numpy on a bounded sample, applied to all rows in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVATIONS = {
    "relu": (lambda x: np.maximum(x, 0), lambda y: (y > 0) * 1.0), "sigmoid": (lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60))), lambda y: y * (1 - y)), "tanh": (np.tanh, lambda y: 1 - y * y),
    "linear": (lambda x: x, lambda y: np.ones_like(y)), "softmax": (lambda x: np.exp(x - x.max(1, keepdims=True)) / np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True), lambda y: y * (1 - y)),
}


@dataclass
class Network:
    sizes: list[int]
    activations: list[str]
    seed: int = 1
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.weights:
            self.reset()

    def reset(self) -> None:
        """Glorot-uniform weights; biases 0.01 before relu, else 0."""
        r = np.random.default_rng(self.seed)
        shapes = list(zip(self.sizes, self.sizes[1:], strict=False))
        self.weights = [r.uniform(-1, 1, s) * np.sqrt(6 / sum(s)) for s in shapes]
        self.biases = [np.full(s[1], 0.01 if a == "relu" else 0.0) for s, a in zip(shapes, self.activations, strict=True)]
        self.history = []

    def forward(self, x: np.ndarray, dropout: float = 0.0, rng: np.random.Generator | None = None) -> list[np.ndarray]:
        out = [x]
        for i, (w, b, a) in enumerate(zip(self.weights, self.biases, self.activations, strict=True)):
            y = ACTIVATIONS[a][0](out[-1] @ w + b)
            if dropout and rng is not None and i < len(self.weights) - 1:
                y = y * (rng.random(y.shape) >= dropout) / (1 - dropout)
            out.append(y)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, layers: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of the weighted mean squared error."""
        g = 2 * (layers[-1] - y) * weight[:, None] / len(x)
        dw, db = [], []
        for i in range(len(self.weights) - 1, -1, -1):
            a = self.activations[i]
            g = layers[i + 1] * (g - (g * layers[i + 1]).sum(1, keepdims=True)) if a == "softmax" else g * ACTIVATIONS[a][1](layers[i + 1])
            dw.insert(0, layers[i].T @ g)
            db.insert(0, g.sum(0))
            g = g @ self.weights[i].T
        return dw, db

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 50, batch: int = 32, rate: float = 0.01, l1: float = 0.0, l2: float = 0.0, patience: int = 10, dropout: float = 0.0, held: float = 0.2, weight: np.ndarray | None = None) -> Network:
        """Adam on all parameters, 80/20 split, rate * 0.9 every 20 epochs, early stop, best epoch kept."""
        r = np.random.default_rng(self.seed)
        weight = np.ones(len(x)) if weight is None else weight
        order = r.permutation(len(x))
        test, train = order[: int(len(x) * held)], order[int(len(x) * held) :]
        test = test if len(test) else train
        p = [*self.weights, *self.biases]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        best, best_loss, since = [q.copy() for q in p], np.inf, 0
        for epoch in range(epochs):
            r.shuffle(train)
            for s in range(0, len(train), batch):
                k = train[s : s + batch]
                layers = self.forward(x[k], dropout, r)
                dw, db = self.gradients(x[k], y[k], weight[k], layers)
                grads = [*[g + l1 * np.sign(w) + 2 * l2 * w for g, w in zip(dw, self.weights, strict=True)], *db]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= rate * 0.9 ** (epoch // 20) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            loss = float((((self.forward(x[test])[-1] - y[test]) ** 2).sum(1) * weight[test]).mean())
            self.history.append({"epoch": epoch, "loss": loss})
            if loss < best_loss - 1e-12:
                best, best_loss, since = [q.copy() for q in p], loss, 0
            elif (since := since + 1) >= patience:
                break
        for q, b in zip(p, best, strict=True):
            q[...] = b
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def importance(self, x: np.ndarray) -> np.ndarray:
        """Mean absolute gradient of the summed outputs by each input."""
        layers = self.forward(x)
        g = np.ones_like(layers[-1])
        for i in range(len(self.weights) - 1, -1, -1):
            g = (g * ACTIVATIONS[self.activations[i]][1](layers[i + 1])) @ self.weights[i].T
        return np.abs(g).mean(0)

    def to_json(self) -> str:
        return json.dumps({"sizes": self.sizes, "activations": self.activations, "seed": self.seed, "weights": [w.tolist() for w in self.weights], "biases": [b.tolist() for b in self.biases]})

    @classmethod
    def from_json(cls, text: str) -> Network:
        d = json.loads(text)
        return cls(d["sizes"], d["activations"], d["seed"], [np.array(w) for w in d["weights"]], [np.array(b) for b in d["biases"]])


def training_sample(df: DataFrame, key: str, bound: int = 20_000) -> DataFrame:
    """At most so many rows, chosen by a hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(41), key), key).limit(bound)


def predict(df: DataFrame, net: Network, key: str, x: str) -> DataFrame:
    """key, prediction (array), cls and confidence: the largest output of several, or |p - 0.5| * 2 of one."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            y = shared.value.predict(np.array(rows, float).reshape(len(rows), -1)) if rows else np.zeros((0, 1))
            one = y.shape[1] == 1
            cls = (y[:, 0] >= 0.5).astype(int) if one else y.argmax(1)
            sure = np.abs(y[:, 0] - 0.5) * 2 if one else y.max(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y.tolist(), pa.list_(pa.float64())), pa.array(cls, pa.int32()), pa.array(sure, pa.float64())], names=[key, "prediction", "cls", "confidence"])

    return df.select(key, x).mapInArrow(run, f"`{key}` {kind}, prediction array<double>, cls int, confidence double")


# Words in a feature's name that tell its category, the first that fits.
CATEGORIES = [("text", "text|word|token"), ("code", "code|ast|syntax"), ("context", "context|scope|file"), ("usage", "usage|frequency|count")]


def feature_importance(df: DataFrame, net: Network, x: str, names: list[str]) -> DataFrame:
    """feature, importance (mean absolute gradient over all rows), rank (from 1, ties by position) and category of each input of the network.

    Each batch gives one row of sums per input, so the sums alone travel. No rows give importances of null.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    n = net.sizes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sums = shared.value.importance(np.array(b.column(0).to_pylist(), float)) * b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(sums, pa.float64()), pa.array([b.num_rows] * n, pa.int64())], names=["i", "total", "held"])

    sums = df.where(F.col(x).isNotNull()).select(x).mapInArrow(run, "i int, total double, held long").groupBy("i").agg((F.sum("total") / F.sum("held")).alias("importance"))
    named = df.sparkSession.createDataFrame([(i, names[i] if i < len(names) else f"feature_{i}") for i in range(n)], "i int, feature string")
    category = F.lit("semantic")
    for name, pattern in reversed(CATEGORIES):
        category = F.when(F.col("feature").rlike(pattern), name).otherwise(category)
    # one row per input of the network: a window over them all is small
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), "i"))
    return named.join(sums, "i", "left").select("feature", "importance", rank.alias("rank"), category.alias("category"))
