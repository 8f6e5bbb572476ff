"""A quality classifier that learns from document labels which passages matter.

A document is a bag of passages. Every passage is encoded; a gated attention network weighs the codes, and the weighted code
of the document gives its score (attention-based multiple-instance learning). The network is small and is trained on the
driver, on a bounded sample of labelled documents; all documents are scored on the executors, over their whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rulemill.llm.common import id_and_text, map_rows

PASSAGE_WORDS = 64
#: The training sample: documents of each class, and passages of each of these documents.
SAMPLE_PER_CLASS, SAMPLE_PASSAGES = 1500, 32
CODE, GATE, EPOCHS, BATCH, RATE = 16, 8, 60, 64, 0.01

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>~^=+_", b"|", b"!", b"0123456789", b".,;:?", b"\n")
N_FEATURES = len(_CLASSES) + 6


def passages(text: bytes | None) -> np.ndarray:
    """One row of features per passage of up to `PASSAGE_WORDS` words; a text without words is one passage of zeros."""
    words = (text or b"").split()
    out = np.zeros((max(1, -(-len(words) // PASSAGE_WORDS)), N_FEATURES), np.float32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = np.array([b.count(b"\n") for b in _gaps(text or b"", sizes)], np.float32) if words else np.zeros(1, np.float32)
    for k in range(len(out)):
        part = words[k * PASSAGE_WORDS : (k + 1) * PASSAGE_WORDS]
        if not part:
            break
        solid, n = b"".join(part), len(part)
        size = len(solid)
        row = out[k]
        for c, marks in enumerate(_CLASSES[:-1]):
            row[c] = (size - len(solid.translate(None, marks))) / size
        row[len(_CLASSES) - 1] = lines[k] / n
        here = sizes[k * PASSAGE_WORDS : (k + 1) * PASSAGE_WORDS]
        row[-6:] = (
            len(set(part)) / n, sum(map(bytes.__eq__, part, part[1:])) / n, here.mean() / 10, here.std() / 10, np.log1p(n) / 5,
            (size - len(solid.decode("utf-8", "replace"))) / size,
        )
    return out


def _gaps(text: bytes, sizes: np.ndarray) -> Iterator[bytes]:
    """The text of each passage with its white space."""
    solid = np.flatnonzero(~np.isin(np.frombuffer(text, np.uint8), (32, 9, 10, 11, 12, 13)))
    starts = solid[np.cumsum(sizes) - sizes][::PASSAGE_WORDS].tolist() + [len(text)]
    for a, b in zip(starts, starts[1:]):
        yield text[a:b]


class Network:
    """x -> h = tanh(x W) per passage; weights softmax of v . (tanh(h A) * sigmoid(h B)); score sigmoid(sum(weight * h) . c)."""

    def __init__(self, seed: int = 8):
        rng = np.random.default_rng(seed)
        put = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.p = {"W": put(N_FEATURES + 1, CODE), "A": put(CODE, GATE), "B": put(CODE, GATE), "v": put(GATE), "c": put(CODE), "b": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of several bags, one after the other; starts: where each bag begins."""
        x = np.concatenate(((x - self.mean) / self.scale, np.ones((len(x), 1), np.float32)), 1)
        h = np.tanh(x @ self.p["W"])
        t, s = np.tanh(h @ self.p["A"]), 1 / (1 + np.exp(-h @ self.p["B"]))
        e = (t * s) @ self.p["v"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["b"], -30, 30)))
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "sizes": sizes}

    def gradients(self, f: dict[str, np.ndarray], starts: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        d = (f["y"] - target) / len(target)
        dz = np.repeat(d[:, None] * self.p["c"], f["sizes"], 0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"]))
        dg = de[:, None] * self.p["v"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ self.p["A"].T + ds @ self.p["B"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "A": f["h"].T @ dt, "B": f["h"].T @ ds, "v": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 8) -> Network:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        rng, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(w) for k, w in self.p.items()}
        second = {k: np.zeros_like(w) for k, w in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                sizes = [len(bags[i]) for i in chosen]
                starts = np.cumsum([0, *sizes[:-1]])
                grads = self.gradients(self.forward(np.concatenate([bags[i] for i in chosen]), starts), starts, labels[chosen])
                step += 1
                for k, g in grads.items():  # Adam, with a little weight decay
                    g = g + 1e-4 * self.p[k]
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] = (self.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def training_sample(labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, label) of at most `per_class` documents per class, the first by a hash of their id. Repeated labels of a document count once, by majority."""
    voted = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    first = [voted.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return first[0].unionByName(first[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, epochs: int = EPOCHS) -> Network:
    """Fit the network on a bounded sample: `labels` has doc_id and label (0 or 1). Without labelled documents the untrained network scores 0.5."""

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, label in texts:
            bag = passages(text)
            if len(bag) > SAMPLE_PASSAGES:
                bag = bag[np.linspace(0, len(bag) - 1, SAMPLE_PASSAGES).astype(int)]
            yield doc_id, label, bag.tobytes()

    # at most 2 * per_class rows
    chosen = id_and_text(docs).join(F.broadcast(training_sample(labels, per_class)), "doc_id").select("doc_id", "text", "label")
    bags = sorted(map_rows(chosen, rows, "doc_id long, label int, bag binary").collect())
    network = Network()
    if not bags:
        network.p["c"][:] = 0
        return network
    return network.fit([np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for _, _, b in bags], np.array([y for _, y, _ in bags], np.float32), epochs)


def score(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, n_passages, top_passage) for every row, over its whole text; top_passage has the largest attention weight.

    A NULL or empty text is one empty passage and gets the score the network gives to that. Repeated rows are scored each.
    """

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in texts:
            bag = passages(text)
            f = network.forward(bag, np.zeros(1, np.int64))
            yield doc_id, float(f["y"][0]), len(bag), int(np.argmax(f["a"]))

    return map_rows(id_and_text(docs, id_column, text_column), rows, "doc_id long, score double, n_passages int, top_passage int")

