"""Quality classifier: pooled random-indexing word vectors and a small network.

Random indexing: every word has a fixed sparse random index vector, and its
word vector is the sum of the index vectors of the words around it. A token
counts as two words, its lower-case form and its shape (case, digits or the
sign itself). Words are hashed to a fixed number of rows, so the vectors have
a fixed size. A document is the mean of its tokens' vectors and three ratios;
a network of two layers, in numpy, gives a logit, and a temperature fitted on
rows held back from its training calibrates the probability.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretoken
from .common import is_fold, text_or_empty

#: Labelled rows that the classifier (word vectors, network and temperature) is fitted on at most.
FIT_ROWS = 5000
#: Rows and dimensions of the word vectors, and signs in an index vector.
ROWS, DIMS, SIGNS = 1 << 15, 32, 4
WINDOW, HIDDEN, EPOCHS, BATCH, RATE, SHRINK = 2, 32, 30, 64, 3e-3, 1e-4
#: Characters and tokens worked on at once.
CHARS, TOKENS = 1_000_000, 100_000


def shape(word: str) -> str:
    """``U``pper, ``C``apitalised or lower-case word, number, or the sign itself."""
    if word[0].isalpha():
        return "\0U" if len(word) > 1 and word.isupper() else "\0C" if word[0].isupper() else "\0l"
    return "\0n" if word[0].isnumeric() else "\0" + word[:3]


def _row(word: str) -> int:
    return zlib.crc32(word.encode()) % ROWS


def _index_vectors() -> np.ndarray:
    rng = np.random.default_rng(7)
    out = np.zeros((ROWS, DIMS), np.float32)
    for k in range(2 * SIGNS):
        out[np.arange(ROWS), rng.integers(0, DIMS, ROWS)] += 1 if k < SIGNS else -1
    return out


class _Tokens:
    """Tokens of some texts as rows of the two words of each, and each text's place."""

    def __init__(self, texts: list[str]):
        got = pretoken.split_pattern(texts, spaced=False)
        words = got.words.to_pylist()
        used = np.zeros(len(words), bool)
        used[got.codes] = True
        self.forms = np.array([_row(w.lower()) if u else 0 for w, u in zip(words, used, strict=True)], np.int64)
        self.shapes = np.array([_row(shape(w)) if u else 0 for w, u in zip(words, used, strict=True)], np.int64)
        self.sizes = np.array([len(w) for w in words], np.float32)
        self.codes, self.first = got.codes.astype(np.int64), got.first


def fit_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors of unit length, and which rows occur."""
    index = _index_vectors()
    out = np.zeros((ROWS, DIMS), np.float64)
    for a, b in pretoken.chunks(texts, CHARS // 2):
        t = _Tokens(texts[a:b])
        if not len(t.codes):
            continue
        text = np.repeat(np.arange(b - a), np.diff(t.first))
        own = index[t.forms[t.codes]] + index[t.shapes[t.codes]]
        around = np.zeros_like(own)
        for step in range(1, WINDOW + 1):
            same = (text[step:] == text[:-step])[:, None]
            around[step:] += own[:-step] * same
            around[:-step] += own[step:] * same
        for rows in (t.forms[t.codes], t.shapes[t.codes]):
            for d in range(DIMS):
                out[:, d] += np.bincount(rows, around[:, d], ROWS)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(size, 1e-9)).astype(np.float32), size[:, 0] > 0


def features(texts: list[str], vectors: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Mean vectors of forms and shapes; shares of distinct and of unseen tokens, token length, log of the count."""
    out = np.zeros((len(texts), 2 * DIMS + 4), np.float32)
    for a, b in pretoken.chunks(texts, CHARS):
        t = _Tokens(texts[a:b])
        counts = np.diff(t.first)
        forms, shapes = t.forms[t.codes], t.shapes[t.codes]
        text = np.repeat(np.arange(b - a), counts)
        for lo in range(0, len(t.codes), TOKENS):
            part = slice(lo, lo + TOKENS)
            d0, edge = text[part][0], np.flatnonzero(np.diff(text[part], prepend=-1))
            for at, rows in ((0, forms), (DIMS, shapes)):
                out[a + d0 + (text[part][edge] - d0), at : at + DIMS] += np.add.reduceat(vectors[rows[part]], edge, axis=0)
        many = max(1, len(t.forms))
        distinct = np.bincount(np.unique(text * many + t.codes) // many, minlength=b - a)
        n = np.maximum(counts, 1)
        out[a:b, : 2 * DIMS] /= n[:, None]
        out[a:b, -4] = distinct / n
        out[a:b, -3] = np.bincount(text, ~seen[forms], b - a) / n
        out[a:b, -2] = np.bincount(text, t.sizes[t.codes], b - a) / n
        out[a:b, -1] = np.log1p(counts)
    return out


class Classifier:
    """Standardised features, a tanh layer, a linear layer, and a temperature."""

    def __init__(self, **arrays: np.ndarray):
        self.arrays = arrays

    @classmethod
    def fit(cls, texts: list[str], labels: np.ndarray) -> Classifier:
        """Without rows of both labels, the score is the share of label 1 (a half without rows)."""
        labels = np.asarray(labels, np.float64)
        vectors, seen = fit_vectors(texts)
        prior = (labels.sum() + 1) / (len(labels) + 2)
        start = np.log(prior / (1 - prior))
        x = features(texts, vectors, seen)
        mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        x = np.clip((x - mean) / spread, -8, 8)
        rng = np.random.default_rng(11)
        p = {"w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.array(start)}
        temperature = 1.0
        if 0 < labels.sum() < len(labels):
            order = rng.permutation(len(labels))
            held, used = order[: len(order) // 6], order[len(order) // 6 :]
            moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
            step = 0
            for _ in range(EPOCHS):
                rng.shuffle(used)
                for lo in range(0, len(used), BATCH):
                    rows = used[lo : lo + BATCH]
                    h = np.tanh(x[rows] @ p["w1"] + p["b1"])
                    e = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - labels[rows]) / len(rows)
                    back = np.outer(e, p["w2"]) * (1 - h**2)
                    grad = {"w2": h.T @ e + SHRINK * p["w2"], "b2": e.sum(), "w1": x[rows].T @ back + SHRINK * p["w1"], "b1": back.sum(axis=0)}
                    step += 1
                    for k, g in grad.items():
                        m, v = moment[k]
                        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
                        moment[k] = m, v
                        p[k] = p[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if len(held):
                z = np.tanh(x[held] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
                grid = np.exp(np.linspace(-1.5, 2.5, 81))
                loss = [np.logaddexp(0, np.where(labels[held] == 1, -z, z) / t).mean() for t in grid]
                temperature = float(grid[int(np.argmin(loss))])
        return cls(vectors=vectors.astype(np.float16), seen=seen, mean=mean, spread=spread, temperature=np.array(temperature), **p)

    def score(self, texts: list[str]) -> np.ndarray:
        a = self.arrays
        x = features(texts, a["vectors"].astype(np.float32), a["seen"])
        x = np.clip((x - a["mean"]) / a["spread"], -8, 8)
        z = np.tanh(x @ a["w1"] + a["b1"]) @ a["w2"] + a["b2"]
        return 1 / (1 + np.exp(-z / a["temperature"]))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Classifier:
        with np.load(io.BytesIO(data)) as f:
            return cls(**dict(f))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> bytes:
    """Fit on the ``rows`` labelled documents with the least id hashes, in one task.

    Rows of the held-out fold (crc32 of the id as text, mod 3, is 1), with
    null ids or with null labels are not used. The sample is bounded by
    ``rows``, and so are the ids broadcast to find it; the fitted classifier
    has a fixed size of some megabytes.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~is_fold(3, "_id"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    sample = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    # repeated ids could make more of them
    sample = sample.orderBy(F.xxhash64("_id"), F.xxhash64("_text"), "_label").limit(rows)

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_id", "_text", "_label"], kind="stable")
        return pd.DataFrame({"model": [Classifier.fit(part["_text"].tolist(), (part["_label"] == 1).to_numpy()).dump()]})

    got = sample.groupBy().applyInPandas(train, "model binary").collect()
    return bytes(got[0][0]) if got else Classifier.fit([], np.zeros(0)).dump()


def score(docs: DataFrame, model: bytes, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a probability of label 1 for each row; no shuffle.

    Null texts count as empty, which get the score of a text without words;
    texts of any length are read whole. All columns of ``docs`` are kept, so
    none may be named ``out``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], text_or_empty(F.col(f"`{text_col}`")).alias("_text"))
    fields = plain.schema.fields[:-1]
    cache: dict[str, Classifier] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "model" not in cache:
            cache["model"] = Classifier.load(held.value)
        for batch in batches:
            got = cache["model"].score(batch.column(len(fields)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(got)], names=[*[f.name for f in fields], "_score"])

    scored = plain.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "_score double"]))
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("_score").alias(out))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """``id, held_out, score, predicted`` for every row of ``docs``.

    Null ids are not held out; repeated rows get equal scores; an empty table
    gives no rows, and without labels every score is a half. Inputs of a
    score are the text's alone.
    """
    model = fit(docs, labels, id_col, text_col, rows=rows)
    scored = score(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text")
    return scored.select(F.col("_id").alias(id_col), is_fold(3, "_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
