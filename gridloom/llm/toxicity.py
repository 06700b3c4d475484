"""Toxicity by compression distance: a zstandard dictionary trained on windows of ordinary text and one trained on windows of toxic text; windows are compressed with either, and
the lengths compared.

Most of a toxic text is as ordinary as any, so the toxic dictionary learns from those of its windows that hold what toxic texts have far more often than ordinary ones. Both compressors
share the ordinary dictionary's content and differ by the toxic one's, so a window's gain is what toxic content alone explains.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textblocks as tb
from gridloom.llm.common import held_out, rows
from gridloom.llm.sampling import BYTES, ROWS, labelled

#: Bytes between windows, and by how much a window overlaps the next one, so that no word is cut in all.
WINDOW, OVERLAP = 64, 12
ORDINARY_BYTES, TOXIC_BYTES = 32_768, 3072
#: Training windows: of ordinary text, one of so many; of a toxic text, so many words on either side of one that stands for toxic text, and so many windows.
EVERY, AROUND, KEPT = 5, 1, 20
#: A stem stands for toxic text if this share of toxic samples has it, and so many times the share of ordinary ones.
MIN_SHARE, MIN_RATIO = 0.02, 20
#: A window's gain in bytes, from 1 to this, is a threshold; a document's score is calibrated on how many windows pass each.
GAINS = 6
FOLDS = 3
#: In a dictionary that zstandard has trained, tables for its own use end with these repeat offsets (fixed values); content follows.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"
_TABLES = 400

_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _stems(word: bytes) -> list[bytes]:
    return [*(word[:n] for n in range(4, min(len(word), 9))), word]


def toxic_windows(toxic: list[bytes], ordinary: list[set[bytes]]) -> list[bytes]:
    """What the toxic dictionary is trained on: of each toxic text, windows around words whose stem toxic texts hold far more often than ordinary ones (given as their sets of words)."""
    own = [set(_WORD.findall(t)) for t in toxic]
    count = Counter(s for words in own for s in {s for w in words for s in _stems(w)})
    if not toxic:
        return []
    least = max(2.0, MIN_SHARE * len(toxic))
    common = {s: n for s, n in count.items() if n >= least}
    count = Counter(s for words in ordinary for s in {s for w in words for s in _stems(w) if s in common})
    special = {s for s, n in common.items() if n / len(toxic) >= MIN_RATIO * (count[s] + 0.5) / (len(ordinary) + 1)}
    out = []
    for text, words in zip(toxic, own, strict=True):
        marked = {w for w in words if any(s in special for s in _stems(w))}
        if marked:
            run = text.split()
            at = [i for i, x in enumerate(run) if not marked.isdisjoint(_WORD.findall(x))]
            out += [b" " + b" ".join(run[max(0, i - AROUND) : i + AROUND + 1]) + b" " for i in at[:KEPT]]
    return out


def dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """The content of a trained dictionary; of too few samples, their own end."""
    try:
        raw = zstandard.train_dictionary(size + _TABLES, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    at = raw.find(_OFFSETS, 0, 2 * _TABLES)
    return raw[at + len(_OFFSETS) if at >= 0 else 0 :][-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=17, chain_log=15, hash_log=15, search_log=4, min_match=4, target_length=16, strategy=4,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=params)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, empty: float):
        self.parts = (ordinary, toxic, weights, centre, scale, empty)
        self.weights, self.centre, self.scale, self.empty = weights, centre, scale, empty
        self.without, self.with_ = compressor(ordinary), compressor(toxic + ordinary)

    def __reduce__(self):
        return Model, self.parts

    def gains(self, text: bytes) -> np.ndarray:
        """For each window, by how many bytes the toxic dictionary shortens it."""
        text = text.lower()
        a, b = self.without.compress, self.with_.compress
        return np.array([len(a(w)) - len(b(w)) for i in range(0, len(text), WINDOW) if (w := text[i : i + WINDOW + OVERLAP])])

    def features(self, text: bytes) -> np.ndarray:
        g = self.gains(text)
        top = np.sort(g)[-2:][::-1] if len(g) > 1 else np.array([g[0], 0])
        over = np.array([(g >= k).sum() for k in range(1, GAINS + 1)])
        return np.concatenate(([np.log(len(g)), *top, g.mean()], 8 * over / len(g), np.log1p(over)))

    def score(self, text: bytes) -> float:
        if not text:
            return self.empty
        return float(1 / (1 + np.exp(-(self.weights[0] + self.weights[1:] @ ((self.features(text) - self.centre) / self.scale)))))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    b, ridge = np.zeros(x.shape[1]), 0.1 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge, x.T @ (y - p) - 0.1 * b)
    return b, centre, scale


def train(samples: list[tuple[str, int]]) -> Model:
    """samples: (text, 1 if toxic). Equal texts count once."""
    texts = list(dict.fromkeys((t.encode().lower(), int(y)) for t, y in samples if t))
    n = 4 + 2 * GAINS
    rate = (sum(y for _, y in texts) + 0.5) / (len(texts) + 1)
    if len({y for _, y in texts}) < 2:
        return Model(b"", b"", np.array([np.log(rate / (1 - rate)), *[0.0] * n]), np.zeros(n), np.ones(n), rate)
    words = [set(_WORD.findall(t)) for t, _ in texts]
    base = dictionary(ORDINARY_BYTES, [t[i : i + WINDOW] for t, y in texts if not y for i in range(0, len(t), EVERY * WINDOW)], 64)

    def without(fold: int | None) -> Model:
        own = [i for i in range(len(texts)) if fold is None or i % FOLDS != fold]
        windows = toxic_windows([texts[i][0] for i in own if texts[i][1]], [words[i] for i in own if not texts[i][1]])
        return Model(base, dictionary(TOXIC_BYTES, windows, 32), np.zeros(n + 1), np.zeros(n), np.ones(n), rate)

    # thresholds are calibrated on texts that the toxic dictionary has not seen
    x = np.empty((len(texts), n))
    for fold in range(FOLDS):
        model = without(fold)
        for i in range(fold, len(texts), FOLDS):
            x[i] = model.features(texts[i][0])
    weights, centre, scale = _fit(x, np.array([y for _, y in texts]))
    return Model(*without(None).parts[:2], weights, centre, scale, rate)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id", threshold: float = 0.3, n_rows: int = ROWS, n_bytes: int = BYTES) -> DataFrame:
    """doc_id, held_out, score (of label 1, 0 to 1), predicted (score >= threshold).

    Learns from at most n_rows labelled rows and n_bytes of their texts that are not held out (see sampling.labelled); scores all windows of every whole text. Null and empty
    texts have no window: the score is the share of label 1 in the sample, as it is for every text if only one label was seen (0.5 if none). Labels that repeat an id: the
    largest counts; a null label counts for none. Each row is scored alone, so ids may repeat or be null (null: held out). An empty table gives none. Other columns are ignored.
    One pass, no shuffle of texts; the model's size is fixed.
    """
    d = rows(docs, id_col, text_col)
    y = labels.select(F.col(f"`{label_id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(train([(t, int(v)) for t, v in labelled(d, y, n_rows, n_bytes)]))

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [model.score(b.text(i)) for b in tb.blocks(batch["text"]) for i in range(b.n_docs)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return d.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_toxicity(spark, sf_dir):
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
