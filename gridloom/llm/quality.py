"""Quality by supervised subword embeddings: learned vectors of hashed words and character n-grams, averaged over a document, and a softmax; trained by numpy stochastic gradient descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textblocks as tb
from gridloom.llm.common import held_out, rows
from gridloom.llm.sampling import BYTES, ROWS, labelled

#: Vectors for words, and for n-grams of these many characters.
BUCKET_BITS, GRAMS, DIMS = 17, (2, 3, 4), 12
STEPS, RATE = 24_000, 0.2
REPEATED = 2 << BUCKET_BITS


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each character begins, its UTF-8 bytes as one number)."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(buf)))
    out = np.zeros(len(at), dtype=np.uint32)
    for q in range(4):
        has = size > q
        out[has] |= buf[at[has] + q].astype(np.uint32) << np.uint32(8 * q)
    return at, out


def features(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vector numbers of the block's words, with their documents, and of its n-grams, with theirs. A word that repeats the one before has a vector's number of its own."""
    starts, ends, bounds = block.words(tb.SPACE_WORDS)
    hashes = tb.hash_words(block.buf, starts, ends, lower=False)
    words = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    of = tb.doc_of(bounds)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    words[again] = REPEATED
    at, x = characters(block.buf)
    place = tb.doc_of(block.offsets).astype(np.int32)[at]
    parts, owners = [], []
    for n in GRAMS:
        m = max(0, len(x) - n + 1)
        g = np.full(m, n, dtype=np.uint32)
        for q in range(n):
            g ^= x[q : q + m]
            g *= np.uint32(0x9E3779B1)
            g ^= g >> np.uint32(15)
        g >>= np.uint32(32 - BUCKET_BITS)
        inside = place[:m] == place[n - 1 :] if m else np.zeros(0, dtype=bool)
        parts.append(g[inside].astype(np.int32) + (1 << BUCKET_BITS))
        owners.append(place[:m][inside])
    return words, of, np.concatenate(parts), np.concatenate(owners)


class Model:
    """Vectors and softmax. As the average and the softmax's input are linear, scoring needs one number for each vector."""

    def __init__(self, samples: list[tuple[str, int]], seed: int = 7):
        rng = np.random.default_rng(seed)
        size = REPEATED + 1
        self.vectors = rng.normal(0, 0.05, (size, DIMS)).astype(np.float32)
        self.weights = np.zeros((DIMS, 2), dtype=np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        if samples:
            self._train(samples, rng)
        self.each = (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)
        self.shift = float(self.bias[1] - self.bias[0])

    def _train(self, samples, rng) -> None:
        docs = []
        for text, label in samples:
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            words, _, grams, _ = features(tb.Block(0, data, np.array([0, len(data)])))
            found = [np.unique(part, return_counts=True) for part in (words, grams)]
            # the average over words and the one over n-grams weigh alike
            weights = np.concatenate([c / max(1, 2 * c.sum()) for _, c in found])
            docs.append((np.concatenate([u for u, _ in found]), weights.astype(np.float32), int(label)))
        self.weights = rng.normal(0, 0.5, self.weights.shape).astype(np.float32)
        seen = np.full(len(self.vectors), 1e-8, dtype=np.float32)
        for step in range(max(1, STEPS // len(docs)) * len(docs)):
            if step % len(docs) == 0:
                order = rng.permutation(len(docs))
            u, c, y = docs[order[step % len(docs)]]
            rate = RATE * (1 - step / (STEPS + len(docs)))
            h = c @ self.vectors[u]
            z = h @ self.weights + self.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = self.weights @ p
            self.weights -= rate * np.outer(h, p)
            self.bias -= 0.1 * rate * p
            # a rate for each vector, by what it has received so far
            seen[u] += c * c * float(back @ back)
            self.vectors[u] -= (rate * c / np.sqrt(seen[u]))[:, None] * back

    def score(self, block: tb.Block) -> np.ndarray:
        words, of, grams, places = features(block)
        z = np.full(block.n_docs, self.shift)
        for part, owner in ((words, of), (grams, places)):
            sums = np.bincount(owner, self.each[part], block.n_docs)
            z += sums / np.maximum(1, 2 * np.bincount(owner, minlength=block.n_docs))
        return 1 / (1 + np.exp(-z))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id", threshold: float = 0.7, n_rows: int = ROWS, n_bytes: int = BYTES) -> DataFrame:
    """doc_id, held_out, score (of label 1, 0 to 1), predicted (score >= threshold).

    Learns from at most n_rows labelled rows and n_bytes of their texts that are not held out (see sampling.labelled); scores every whole text. Null and empty texts have no
    features: the softmax's bias alone. With no labelled row the score is 0.5. Labels that repeat an id: the largest counts; a null label counts for none. Each row is scored
    alone, so ids may repeat or be null (null: held out). An empty table gives none. Other columns are ignored. One pass, no shuffle of texts; the model's size is fixed.
    """
    d = rows(docs, id_col, text_col)
    y = labels.select(F.col(f"`{label_id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    model = Model([(t, int(v)) for t, v in labelled(d, y, n_rows, n_bytes)])
    shared = docs.sparkSession.sparkContext.broadcast((model.each, model.shift))

    def run(batches):
        m = Model.__new__(Model)
        m.each, m.shift = shared.value
        for batch in batches:
            scores = np.concatenate([np.zeros(0), *(m.score(b) for b in tb.blocks(batch["text"]))])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores)], names=["doc_id", "held_out", "score"])

    return d.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality(spark, sf_dir):
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
