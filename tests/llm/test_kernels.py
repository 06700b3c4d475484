"""The numpy kernels of the corpus operators against plain versions."""

import itertools
import random
import string

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe, langid, quality, toxicity
from gridloom.llm import textblocks as tb


@pytest.mark.parametrize("piece", [64, 3])
def test_chains_of_any_length(piece, monkeypatch):
    """Marginals of whole documents: against forward-backward word by word, and against all label paths of short ones."""
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = np.random.default_rng(1)
    field = langid.Field(["a", "b", "c"])
    field.move = rng.normal(0, 1, (3, 3))

    class Doc:
        lengths = [5, 0, 1, 7, 200, 3, 64, 65, 128, 2, 6]
        bounds = np.cumsum([0, *lengths])
        n = sum(lengths)

    scores = rng.normal(0, 2, (Doc.n, 3))
    monkeypatch.setattr(field, "emissions", lambda *_: scores.copy())
    monkeypatch.setattr(field, "owners", lambda _: None)
    got = field.label_words(Doc)
    for i, n in enumerate(Doc.lengths):
        own = scores[Doc.bounds[i] : Doc.bounds[i + 1]]
        if not n:
            continue
        a, b, e, step = np.zeros((n, 3)), np.ones((n, 3)), np.exp(own), np.exp(field.move)
        a[0] = e[0] / e[0].sum()
        for t in range(1, n):
            a[t] = (a[t - 1] @ step) * e[t]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = step @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = a * b / (a * b).sum(axis=1, keepdims=True)
        if n <= 7:
            paths = np.zeros((n, 3))
            for p in itertools.product(range(3), repeat=n):
                weight = np.exp(own[range(n), p].sum() + sum(field.move[p[t - 1], p[t]] for t in range(1, n)))
                paths[range(n), p] += weight
            assert np.allclose(want, paths / paths.sum(axis=1, keepdims=True))
        assert np.allclose(got[Doc.bounds[i] : Doc.bounds[i + 1]], want)


rng = random.Random(1)
LONG = {
    "base64": "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=5_000_000)),
    "letters": "".join(rng.choices(string.ascii_lowercase, k=500_000)),
    "han": "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(100_000)),
    "one letter": "a" * 500_000,
    "one word": "internationalization" * 20_000,
    "special": "x<|endoftext|>" * 50_000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_without_white_space(name):
    text = LONG[name]
    encoder, counts = bpe.Encoder(bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))), bpe.Counts(bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    byte, word = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    word.no_truncation()
    assert np.array_equal(np.frombuffer(encoder.encode([text])[0], dtype="<u4"), byte.encode(text, add_special_tokens=False).ids)
    assert counts.tokens(text) == len(word.encode(text, add_special_tokens=False).ids)
    assert not [u for u in [*encoder.cache, *counts, *counts.pieces] if len(u) > bpe.UNIT]


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 50_000)
    words = ["".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(5000)]
    encoder, counts = bpe.Encoder(bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))), bpe.Counts(bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(0, 5000, 100):
        text = " ".join(words[i : i + 100])
        assert np.array_equal(np.frombuffer(encoder.encode([text])[0], dtype="<u4"), byte.encode(text, add_special_tokens=False).ids)
        counts.tokens(text)
        assert max(len(encoder.cache), len(encoder.old)) <= 500 and max(len(counts), len(counts.old), len(counts.pieces)) <= 500


TEXTS = ["", "a", "ab", "Größe und Größe und Größe", "日本語 日本語 text", "one one two", "   ", "naïve café 😀😀", "x" * 300]


def _block(texts):
    data = [t.encode() for t in texts]
    return tb.Block(0, np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]))


def test_quality_score_is_the_average_of_learned_vectors():
    """Against a plain version: a vector for each word and each character n-gram, averaged, and the softmax."""
    model = quality.Model([("good words in a good text, größer", 1), ("bad bad bad !!", 0), ("日本語 日本語", 1)] * 4)

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = (h ^ int.from_bytes(c.encode(), "little")) * 0x9E3779B1 % 2**32
            h ^= h >> 15
        return (h >> (32 - quality.BUCKET_BITS)) + (1 << quality.BUCKET_BITS)

    def plain(text):
        words, seen = text.encode().split(), [int(h) >> (64 - quality.BUCKET_BITS) for h in _hashes(text)]
        seen = [quality.REPEATED if i and words[i] == words[i - 1] else s for i, s in enumerate(seen)]
        grams = [bucket(text[i : i + n]) for n in quality.GRAMS for i in range(len(text) - n + 1)]
        h = np.zeros(quality.DIMS)
        for part in (seen, grams):
            for v in part:
                h += model.vectors[v] / (2 * len(part))
        z = h @ model.weights + model.bias
        return np.exp(z[1]) / np.exp(z).sum()

    def _hashes(text):
        b = _block([text])
        starts, ends, _ = b.words(tb.SPACE_WORDS)
        return tb.hash_words(b.buf, starts, ends, lower=False)

    assert np.allclose(model.score(_block(TEXTS)), [plain(t) for t in TEXTS], atol=1e-5)


def test_toxicity_gains_against_compressing_by_hand():
    """A window's gain is how much shorter it is with the toxic dictionary in front; texts that hold what toxic samples share score higher."""
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    some = lambda: say(rng.randrange(10, 60))
    samples = [(f"{some()} vileword rottenword {some()}", 1) for _ in range(60)] + [(f"{some()} {some()}", 0) for _ in range(240)]
    model = toxicity.train(samples)
    base, toxic = model.parts[:2]
    assert b"vileword" in toxic and b"rottenword" in toxic and b"vileword" not in base
    a, b = toxicity.compressor(base), toxicity.compressor(toxic + base)
    text = f"{say(30)} VILEWORD {say(30)}".encode()
    want = []
    for i in range(0, len(text), toxicity.WINDOW):
        w = text[i : i + toxicity.WINDOW + toxicity.OVERLAP].lower()
        want.append(len(a.compress(w)) - len(b.compress(w)))
    assert model.gains(text).tolist() == want and max(want) >= 3
    assert model.score(text) > 0.5 > model.score(say(60).encode())
