"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of some words. Every passage is encoded as a vector
of counts and shares; a hidden layer embeds it, gated attention weighs the
embeddings of a text against each other, and the weighted sum is scored. Labels
belong to texts alone: embedding, attention and score are learned together from
them, by gradients, on a bounded sample of labelled rows. All rows are then scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.common import bound_arrow, packed, whole_text
from cargolens.llm.word_arrays import Words, byte_classes, chunks

BREAKS = b"\n"
CLASSES = byte_classes(b" \t\x0b\x0c\r", BREAKS)
#: words of a passage
PASSAGE = 32
#: buckets of hashed words; one for each set of the KINDS of characters that a word has
BUCKETS, SHAPES = 64, 64
KINDS = 6
STATS = 5 + KINDS
WIDTH = STATS + SHAPES + BUCKETS
#: widths of a passage's embedding and of the gate
HIDDEN, GATE = 24, 12
#: documents that the model is fitted to, and passages of each, at most
MOST_ROWS, MOST_PASSAGES = 4000, 64
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 128, 0.01, 1e-4, 13


def kinds_of_bytes() -> np.ndarray:
    """Upper case, lower case, digits, bytes beyond ASCII, usual punctuation, other characters."""
    out = np.full(256, 5, np.uint8)
    for k, own in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256), b".,;:!?'\"()-")):
        out[list(own)] = k
    return out


KIND_OF = kinds_of_bytes()


def encode(parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each passage, and the number of its part. A part without words has one passage."""
    w = Words(parts, CLASSES)
    n_words = np.bincount(w.text, minlength=len(parts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    owner = np.repeat(np.arange(len(parts)), n_passages)
    total = len(owner)
    out = np.zeros((total, WIDTH), np.float32)
    if not len(w):
        return out, owner
    place = np.arange(len(w)) - (np.cumsum(n_words) - n_words)[w.text]
    passage = (np.cumsum(n_passages) - n_passages)[w.text] + place // PASSAGE
    words = np.bincount(passage, minlength=total).astype(np.float64)
    size = w.ends - w.starts
    kind, shape = KIND_OF[w.bytes], np.zeros(len(w), np.int64)
    chars = np.maximum(1, np.bincount(passage, size, total))
    for k in range(KINDS):
        run = np.zeros(len(kind) + 1, np.int32)
        np.cumsum(kind == k, out=run[1:])
        own = run[w.ends] - run[w.starts]
        shape |= (own > 0) << k
        out[:, 5 + k] = np.bincount(passage, own, total) / chars
    hashed = w.hashes(0, lower=True)
    same = np.zeros(len(w), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])
    lines = np.zeros(len(w), bool)
    lines[1:] = (w.piece[1:] != w.piece[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((hashed, passage))
    new = np.ones(len(w), bool)
    new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    some = np.maximum(words, 1)
    out[:, 0] = np.log1p(words)
    out[:, 1] = chars / some
    out[:, 2] = 1 - np.bincount(passage[order], new, total) / some
    out[:, 3] = np.bincount(passage, same, total) / some
    out[:, 4] = np.bincount(passage, lines, total) / some
    out[:, STATS : STATS + SHAPES] = np.bincount(passage * SHAPES + shape, minlength=total * SHAPES).reshape(total, SHAPES) / some[:, None]
    bucket = (hashed % np.uint64(BUCKETS)).astype(np.int64)
    out[:, STATS + SHAPES :] = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / np.sqrt(some)[:, None]
    return out, owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """mean and scale of the vectors; weights of embedding, gate, attention and score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def embedded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedding and attention (before the softmax) of each passage."""
        p = self.weights
        h = np.tanh((vectors - self.mean) / self.scale @ p["embed"] + p["embed_bias"])
        return h, (np.tanh(h @ p["value"]) * sigmoid(h @ p["gate"])) @ p["attend"]

    def score(self, h: np.ndarray, attention: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of each bag of passages, which begin at `first`."""
        sizes = np.diff(np.append(first, len(h)))
        weight = np.exp(attention - np.repeat(np.maximum.reduceat(attention, first), sizes))
        weight /= np.repeat(np.add.reduceat(weight, first), sizes)
        return sigmoid(np.add.reduceat(weight[:, None] * h, first) @ self.weights["score"] + self.weights["bias"])


def fit(vectors: Sequence[np.ndarray], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model of bags of vectors and their labels (0 or 1), by Adam on the log loss; with labels of one kind, or none, a model that scores their smoothed share."""
    random = np.random.default_rng(seed)
    n = len(labels)
    share = (float(labels.sum()) + 0.5) / (n + 1)
    draw = lambda a, b: random.normal(0, a**-0.5, (a, b)) if b else random.normal(0, a**-0.5, a)
    p = {"embed": draw(WIDTH, HIDDEN), "embed_bias": np.zeros(HIDDEN), "value": draw(HIDDEN, GATE), "gate": draw(HIDDEN, GATE), "attend": draw(GATE, 0), "score": draw(HIDDEN, 0), "bias": np.array(np.log(share / (1 - share)))}
    if not n or len(np.unique(labels)) < 2:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), p | {"score": np.zeros(HIDDEN)})
    every = np.concatenate(vectors).astype(np.float64)
    model = Model(every.mean(axis=0), every.std(axis=0) + 0.02, p)
    scaled = [(np.asarray(v, np.float64) - model.mean) / model.scale for v in vectors]
    first_moment, second_moment = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = random.permutation(n)
        for at in range(0, n, BATCH):
            some = order[at : at + BATCH]
            bags = [scaled[i] for i in some]
            for k, g in gradients(p, np.concatenate(bags), np.array([len(b) for b in bags]), labels[some]).items():
                g = g + DECAY * p[k] * (p[k].ndim > 0)
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * g * g
                t = step + 1
                rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                p[k] = p[k] - rate * first_moment[k] / (np.sqrt(second_moment[k]) + 1e-8)
            step += 1
    return model


def gradients(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of bags of `sizes` scaled vectors x."""
    first = np.cumsum(sizes) - sizes
    bag = np.repeat(np.arange(len(sizes)), sizes)
    h = np.tanh(x @ p["embed"] + p["embed_bias"])
    v, u = np.tanh(h @ p["value"]), sigmoid(h @ p["gate"])
    e = (v * u) @ p["attend"]
    a = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    error = (sigmoid(z @ p["score"] + p["bias"]) - y) / len(y)
    dz = error[:, None] * p["score"]
    pull = (h * dz[bag]).sum(axis=1)
    de = a * (pull - np.add.reduceat(a * pull, first)[bag])
    dv, du = de[:, None] * p["attend"] * u * (1 - v * v), de[:, None] * p["attend"] * v * u * (1 - u)
    dh = (a[:, None] * dz[bag] + dv @ p["value"].T + du @ p["gate"].T) * (1 - h * h)
    return {
        "embed": x.T @ dh, "embed_bias": dh.sum(axis=0), "value": h.T @ dv, "gate": h.T @ du,
        "attend": (v * u).T @ de, "score": z.T @ error, "bias": error.sum(),
    }


def sample_vectors(most_passages: int):
    """UDF from text to the vectors of its passages, of at most most_passages of them, evenly spread."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts.cast(pa.binary()).to_pylist():
                own = np.concatenate([encode(parts)[0] for _, parts, _ in chunks([t], BREAKS, 0)])
                pick = np.unique(np.linspace(0, len(own) - 1, min(len(own), most_passages)).round().astype(int))
                out.append(own[pick].tobytes())
            yield pa.array(out, pa.binary())

    return F.arrow_udf(of, "binary")


def scores(model: Model):
    """UDF from text to its score, from all its passages."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            held = []
            for owners, parts, _ in chunks(texts.cast(pa.binary()).to_pylist(), BREAKS, 0):
                vectors, owner = encode(parts)
                held.append((*model.embedded(vectors), np.array(owners)[owner]))
            if not held:
                yield pa.array([], pa.float64())
                continue
            h, attention, owner = map(np.concatenate, zip(*held, strict=True))
            # the order of addition, and so the last digits, hang on what else is in the batch
            yield pa.array(model.score(h, attention, np.flatnonzero(np.diff(owner, prepend=-1))).round(9))

    return F.arrow_udf(of, "double")


def fold(name: Column, folds: int) -> Column:
    """crc32 of the id as text modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(name.cast("string"), F.lit("")).cast("binary")) % folds


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5,
    most_rows: int = MOST_ROWS, most_passages: int = MOST_PASSAGES, epochs: int = EPOCHS, seed: int = SEED,
) -> Model:
    """A model learned from the labelled ids whose fold isn't 0: from at most most_rows of them, by the order of a hash, and most_passages passages of each.

    Labels with a null id or label are left out; of labels of one id the largest counts, of rows
    with one id one. What reaches the driver is these rows' vectors alone.
    """
    bound_arrow(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label")).dropna()
    known = known.where(fold(F.col("_id"), folds) != 0).groupBy("_id").agg((F.max("_label") > 0).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(most_rows)
    rows = packed(docs, [], id=id_col, text=text_col).select("id", whole_text().alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("_id"))
    made = rows.select("id", "_label", F.xxhash64("text").alias("order"), sample_vectors(most_passages)("text").alias("vectors"))
    one = made.groupBy("id", "_label").agg(F.min_by("vectors", "order").alias("vectors")).collect()
    one = sorted(one, key=lambda r: r["id"])
    bags = [np.frombuffer(r["vectors"], np.float32).reshape(-1, WIDTH) for r in one]
    return fit(bags, np.array([r["_label"] for r in one], np.float64), epochs=epochs, seed=seed)


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: Sequence[str] | None = None,
    folds: int = 5, threshold: float = 0.3, most_rows: int = MOST_ROWS, most_passages: int = MOST_PASSAGES, seed: int = SEED,
) -> DataFrame:
    """Columns row (a struct of docs' columns, or of those in carry), id, held_out, score and predicted.

    score, from 0 to 1, says how likely the text is one of label 1, by the text alone;
    predicted is 1 if it is at least threshold. Null text is empty and scored as such,
    as are texts without words; texts are scored whole, in passages of 32 words; repeated rows have one score. Without
    any labelled row the score is 0.5. An empty table gives an empty one.
    """
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, most_rows=most_rows, most_passages=most_passages, seed=seed)
    rows = packed(docs, carry, id=id_col, text=text_col)
    told = rows.select("row", "id", (fold(F.col("id"), folds) == 0).alias("held_out"), scores(model)(whole_text()).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
