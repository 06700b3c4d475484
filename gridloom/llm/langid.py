"""Language of each word by a linear-chain conditional random field, and of a document by its words.

Affix, n-gram and lexicon features with learned transitions; marginals by forward-backward. It learns from code-switched text made of shuffled runs of words of different documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridloom.llm import textblocks as tb
from gridloom.llm.common import forget, fresh, held_out, rows
from gridloom.llm.sampling import labelled

#: Weights for affixes and n-grams; words in a language's lexicon; words in one chain of the training text, and in one piece of a document's chain.
BUCKET_BITS, LEXICON, CHAIN, PIECE = 16, 1000, 64, 64
GRAMS, AFFIXES = (2, 3, 4), (1, 2, 3)
ROWS, BYTES = 2000, 8_000_000
BATCH, EPOCHS, RATE = 256, 2, 0.3

#: Letters of ASCII, and all bytes from 0x80.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def _bucket(g: np.ndarray) -> np.ndarray:
    return (tb.mix(g) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


class Words:
    """The words of a block, and for each feature kind the weight numbers: grams at each byte of a word, affixes for each word."""

    def __init__(self, block: tb.Block):
        self.starts, self.ends, self.bounds = block.words(LETTERS)
        self.n = len(self.starts)
        self.hashes = tb.hash_words(block.buf, self.starts, self.ends, lower=True)
        inside = LETTERS[block.buf]
        # a word's n-grams reach one byte past its ends, where a blank stands
        text = np.full(len(block.buf) + 8, 0x20, dtype=np.uint64)
        text[4 : 4 + len(block.buf)] = np.where(inside, tb.LOWER[block.buf], 0x20)
        lengths = self.ends - self.starts
        self.of = np.repeat(np.arange(self.n), lengths)
        at = np.arange(len(self.of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = lengths[self.of] - at
        place = self.starts[self.of] + at + 4
        self.grams = []
        blank = np.uint64(0x20)
        for n in GRAMS:
            g = np.full(len(place), n, dtype=np.uint64)
            for q in range(-1, n - 1):
                # nothing beyond one byte past the word
                c = text[place + q] if q <= 0 else np.where(left > q, text[place + q], blank)
                if q == -1:
                    c = np.where(at > 0, c, blank)
                g = (g << np.uint64(8)) | c
            self.grams.append(_bucket(g))
        self.affixes = []
        for n in AFFIXES:
            for sign in (0, 1):
                g = np.full(self.n, 16 + 2 * n + sign, dtype=np.uint64)
                for q in range(n):
                    i = self.starts + q if sign == 0 else self.ends - 1 - q
                    ok = (i < self.ends) & (i >= self.starts)
                    g = (g << np.uint64(8)) | np.where(ok, text[np.where(ok, i, 0) + 4], blank)
                self.affixes.append(_bucket(g))


class Field:
    """weights (bucket, label), lexicon weights (lexicon's label, label), transitions (from, to)."""

    def __init__(self, labels: list[str]):
        self.labels, n = labels, len(labels)
        self.weights = np.zeros((n, 1 << BUCKET_BITS), dtype=np.float32)
        self.lexicon, self.owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.lex = np.zeros((n + 1, n))
        self.move = np.zeros((n, n))

    def owners(self, w: Words) -> np.ndarray:
        """The label whose lexicon has the word; the number of labels if none has."""
        if not len(self.lexicon):
            return np.full(w.n, len(self.labels))
        at = np.minimum(np.searchsorted(self.lexicon, w.hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == w.hashes, self.owner[at], len(self.labels))

    def emissions(self, w: Words, owner: np.ndarray) -> np.ndarray:
        """(word, label). The n-grams of a word are averaged, so that long words don't outweigh others."""
        out = self.lex[owner].copy()
        share = 1 / np.maximum(1, w.ends - w.starts)
        for label in range(len(self.labels)):
            table = self.weights[label]
            each = table[w.grams[0]]
            for g in w.grams[1:]:
                each = each + table[g]
            out[:, label] += np.bincount(w.of, each, w.n) * share * 2
            for a in w.affixes:
                out[:, label] += table[a]
        return out

    def marginals(self, scores: np.ndarray, lengths: np.ndarray, head: np.ndarray | None = None, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """scores: (chain, place, label), lengths: of the chains, longest first. Forward-backward: (marginals, expected pairs).

        head, tail: (chain, label), what comes into a chain's first place from before it, and into its last one from behind it."""
        chains, places, n = scores.shape
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        step = np.exp(self.move - self.move.max())
        live = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(places)]  # chains longer than t
        alpha = np.empty_like(e)
        beta = np.ones_like(e)
        if head is not None:
            e[:, 0] *= head
            beta[np.arange(chains), lengths - 1] = tail
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, places):
            k = live[t]
            a = (alpha[:k, t - 1] @ step) * e[:k, t]
            alpha[:k, t] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((n, n))
        for t in range(places - 2, -1, -1):
            k = live[t + 1]
            ahead = e[:k, t + 1] * beta[:k, t + 1]
            b = ahead @ step.T
            both = alpha[:k, t]
            norm = 1 / (both * b).sum(axis=1)
            pairs += step * ((both * norm[:, None]).T @ ahead)
            beta[:k, t] = b / b.sum(axis=1, keepdims=True)
        gamma = alpha * beta
        for t in range(places):
            gamma[live[t] :, t] = 0
        return gamma / np.maximum(gamma.sum(axis=2, keepdims=True), 1e-300), pairs

    def ends(self, scores: np.ndarray, lengths: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces of longer chains: (head, tail), as marginals() takes them. number: of each piece in its chain, 0 for the first; a chain's pieces follow one another.

        A piece as a whole is one matrix, the product of its places' matrices; vectors go from piece to piece by it, forward and backward, so that no piece is judged alone."""
        pieces, places, n = scores.shape
        step = np.exp(self.move - self.move.max())
        head, tail = np.ones((pieces, n)), np.ones((pieces, n))
        more = np.append(number[1:] > 0, False)
        own = np.flatnonzero(more | (number > 0))
        if not len(own):
            return head, tail
        order = own[np.argsort(-lengths[own], kind="stable")]
        e = np.exp(scores[order] - scores[order].max(axis=2, keepdims=True))
        whole = np.where((number[order] == 0)[:, None, None], np.eye(n), step) * e[:, :1]
        for t in range(1, places):
            k = int(np.searchsorted(-lengths[order], -t, side="left"))
            m = (whole[:k] @ step) * e[:k, t, None]
            whole[:k] = m / m.max(axis=(1, 2), keepdims=True)
        at = np.zeros(pieces, dtype=np.int64)
        at[order] = np.arange(len(order))
        last = np.ones((pieces, n))
        by = own[np.argsort(number[own], kind="stable")]
        turns = np.split(by, np.flatnonzero(np.diff(number[by])) + 1)
        for turn in turns:
            if number[turn[0]] > 0:
                head[turn] = last[turn - 1] @ step
            v = (last[turn - 1 if number[turn[0]] > 0 else turn][:, None, :] @ whole[at[turn]])[:, 0]
            last[turn] = v / v.sum(axis=1, keepdims=True)
        for turn in reversed(turns[1:]):
            v = (whole[at[turn]] @ tail[turn][:, :, None])[:, :, 0]
            tail[turn - 1] = v / v.sum(axis=1, keepdims=True)
        return head, tail

    def label_words(self, w: Words) -> np.ndarray:
        """Marginals (word, label). The words of a document form one chain, of any length; its pieces of PIECE words are worked on side by side."""
        scores = self.emissions(w, self.owners(w))
        if not w.n:
            return scores
        doc = tb.doc_of(w.bounds)
        of = np.arange(w.n) - w.bounds[doc]
        place = of % PIECE
        first = np.flatnonzero(place == 0)
        lengths = np.diff(np.append(first, w.n))
        padded = np.zeros((len(first), PIECE, len(self.labels)))
        piece = np.repeat(np.arange(len(first)), lengths)
        padded[piece, place] = scores
        head, tail = self.ends(padded, lengths, of[first] // PIECE)
        order = np.argsort(-lengths, kind="stable")
        out = np.empty_like(padded)
        out[order] = self.marginals(padded[order], lengths[order], head[order], tail[order])[0]
        return out[piece, place]


def train(samples: list[tuple[str, str]], seed: int = 11) -> Field:
    """samples: (text, label). Runs of 8 to 80 words of all texts are shuffled into one code-switched text."""
    field = Field(sorted({y for _, y in samples}))
    number = {y: i for i, y in enumerate(field.labels)}
    rng = np.random.default_rng(seed)
    runs: list[tuple[bytes, int, int]] = []
    held: list[dict[int, int]] = [{} for _ in field.labels]
    for text, y in samples:
        block = tb.Block(0, np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())]))
        starts, ends, _ = block.words(LETTERS)
        for h in np.unique(tb.hash_words(block.buf, starts, ends, lower=True)).tolist():
            held[number[y]][h] = held[number[y]].get(h, 0) + 1
        i = 0
        while i < len(starts):
            j = min(len(starts), i + int(rng.integers(8, 81)))
            runs.append((bytes(block.buf[starts[i] : ends[j - 1]]), j - i, number[y]))
            i = j
    if not runs or len(field.labels) < 2:
        return field
    counts = np.maximum(1, np.bincount([number[y] for _, y in samples], minlength=len(field.labels)))
    best: dict[int, tuple[float, int]] = {}
    for label, words in enumerate(held):
        for h, n in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n >= 2:
                best[h] = max(best.get(h, (0, 0)), (n / counts[label], label))
    field.lexicon = np.array(sorted(best), dtype=np.uint64)
    field.owner = np.array([best[h][1] for h in sorted(best)], dtype=np.int64)
    grads = np.full(field.weights.shape, 1e-6, dtype=np.float32)
    n = len(field.labels)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(runs))
        at = 0
        while at < len(order):
            took, words = [], 0
            while at < len(order) and words < BATCH * CHAIN:
                took.append(runs[order[at]])
                words += took[-1][1]
                at += 1
            data = np.frombuffer(b" ".join(r[0] for r in took), dtype=np.uint8)
            w = Words(tb.Block(0, data, np.array([0, len(data)])))
            gold = np.repeat([r[2] for r in took], [r[1] for r in took])
            owner = field.owners(w)
            scores = field.emissions(w, owner)
            chains = -(-w.n // CHAIN)
            lengths = np.full(chains, CHAIN)
            lengths[-1] = w.n - CHAIN * (chains - 1)
            padded = np.zeros((chains * CHAIN, n))
            padded[: w.n] = scores
            gamma, pairs = field.marginals(padded.reshape(chains, CHAIN, n), lengths)
            error = -gamma.reshape(-1, n)[: w.n]
            error[np.arange(w.n), gold] += 1
            same = np.arange(w.n - 1) % CHAIN != CHAIN - 1
            seen = np.bincount(gold[:-1][same] * n + gold[1:][same], minlength=n * n).reshape(n, n)
            field.move += RATE * (seen - pairs) / max(1, w.n) * 20
            field.lex += RATE * np.stack([np.bincount(owner, error[:, k], n + 1) for k in range(n)], axis=1) / max(1, w.n) * 20
            share = 2 / np.maximum(1, w.ends - w.starts)
            for k in range(n):
                step = sum(np.bincount(g, (error[:, k] * share)[w.of], 1 << BUCKET_BITS) for g in w.grams) + sum(np.bincount(a, error[:, k], 1 << BUCKET_BITS) for a in w.affixes)
                grads[k] += step * step
                field.weights[k] += (RATE * step / np.sqrt(grads[k])).astype(np.float32)
    return field


def _languages(field: Field, block: tb.Block) -> tuple[list[str], np.ndarray]:
    w = Words(block)
    n = len(field.labels)
    if not n:
        return ["und"] * block.n_docs, np.zeros(block.n_docs)
    marginal = field.label_words(w)
    doc = tb.doc_of(w.bounds)
    sums = np.stack([np.bincount(doc, marginal[:, k], block.n_docs) for k in range(n)], axis=1)
    total = np.diff(w.bounds)
    best = sums.argmax(axis=1)
    names = [field.labels[k] for k in best.tolist()]
    score = sums[np.arange(block.n_docs), best] / np.maximum(1, total)
    ascii_letters = np.concatenate(([0], np.cumsum(LETTERS[block.buf] & (block.buf < 0x80))))
    for i in np.flatnonzero(np.diff(ascii_letters[block.offsets]) == 0).tolist():
        if not any(c.isalpha() for c in block.text(i).decode("utf-8", "replace")):
            names[i], score[i] = "und", 0.0
    return names, np.clip(score, 0, 1)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n_rows: int = ROWS, n_bytes: int = BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language of most of a text's words, and the mean marginal of its words for it.

    Learns from text and lang of at most n_rows rows and n_bytes that are not held out (see sampling.labelled); predicts from whole texts alone. `und`, with score 0, where a
    text is null or has no letter, or where no row has a language to learn. Languages that tie: the first by name. Each row is judged alone, so ids may repeat or be null (null:
    held out). An empty table gives none. Other columns don't matter. One pass, no shuffle of texts; the model's size is fixed for each language.
    """
    d = rows(docs, id_col, text_col, lang=lang_col)
    return _judged(d.select("doc_id", held_out().alias("held_out"), "text"), "text", _learned(d, n_rows, n_bytes), "lang_pred", "score", passed=False)


def of_a_language(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n_rows: int = ROWS, n_bytes: int = BYTES) -> DataFrame:
    """The rows of docs, with their columns, whose text has a language with a score of at least `least` (see languages). Columns of docs may have any name."""
    field = _learned(rows(docs, id_col, text_col, lang=lang_col), n_rows, n_bytes)
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = _judged(docs, text_col, field, lang, score)
    return found.where((found[lang] != "und") & (found[score] >= least)).drop(lang, score)


def _learned(d: DataFrame, n_rows: int, n_bytes: int) -> Field:
    spoken = d.groupBy("doc_id").agg(F.min("lang").alias("label"))
    return train([(t, str(y)) for t, y in labelled(d.select("doc_id", "text"), spoken, n_rows, n_bytes)])


def _judged(docs: DataFrame, at: str, field: Field, lang: str, score: str, passed: bool = True) -> DataFrame:
    """docs with two columns more, without the text unless it is passed on; null text: empty."""
    rest = [f for f in docs.schema.fields if passed or f.name != at]
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        forget()
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for b in tb.blocks(batch[at], 1 << 18):
                got, s = _languages(shared.value, b)
                names += got
                scores.append(s)
            own = [batch.columns[i] for i, n in enumerate(batch.schema.names) if passed or n != at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=[*(f.name for f in rest), lang, score])

    return docs.mapInArrow(run, StructType([*rest, StructField(lang, StringType()), StructField(score, DoubleType())]))


def op6_language(spark, sf_dir):
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
