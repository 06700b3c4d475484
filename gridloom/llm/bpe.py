"""Byte-pair tokens: counts by a heap over a linked list, and encoding by batched numpy merge rounds.

A vocabulary file is read once on the driver; its tables (bounded by the vocabulary) go to the executors. A text is cut at white space into units that no token crosses; what
became of a unit of common length is kept in a cache bounded by bytes, in two generations. Longer units are cut where two bytes meet that stand side by side in no token.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import once, rows

#: Bytes in one generation of a worker's cache, counting so many for an entry besides its content; characters of a unit that may be kept.
CACHE_BYTES, ENTRY_BYTES, UNIT = 32 << 20, 160, 64
#: Symbols that merge rounds work on at once.
ROUND = 1 << 16
#: White space as Unicode has it; Python's own adds U+001C to U+001F.
WS = "\t-\r \x85\xa0  -     　"


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow U+0100 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Tables of a tokenizer file: ids of single bytes, merge ranks, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.first = [vocab[c] for c in chars]
        self.last = [vocab[c + suffix] for c in chars]
        self.size = 1 + max(vocab.values())
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {vocab[a] * self.size + vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {c: b for b, c in enumerate(chars)}
        self.bytes = {i: bytes(back[c] for c in t) if not suffix else b"" for t, i in vocab.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        # whether two bytes stand side by side in some token: merges cross no other places
        self.joined = np.zeros((256, 256), dtype=bool)
        for t in vocab:
            if t not in self.special:
                own = [back[c] for c in t.removesuffix(suffix)]
                self.joined[own[:-1], own[1:]] = True
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")


def merged_count(symbols: list[int], rank: dict[int, int], made: list[int], size: int) -> int:
    """How many symbols are left: pop the lowest-rank adjacent pair (leftmost of equals) until none is left. Nothing is emitted: the count is the symbols less the merges."""
    n = len(symbols)
    links = list if n < ROUND else lambda x: array("q", x)
    symbols, after, before = links(symbols), links(range(1, n + 1)), links(range(-1, n - 1))
    # an entry is rank * n + place
    heap = [r * n + i for i in range(n - 1) if (r := rank.get(symbols[i] * size + symbols[i + 1])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        j = after[i]
        if symbols[i] < 0 or j >= n or rank.get(symbols[i] * size + symbols[j]) != r:
            continue
        symbols[i], symbols[j] = made[r], -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (x := rank.get(symbols[i] * size + symbols[k])) is not None:
                heapq.heappush(heap, x * n + i)
        h = before[i]
        if h >= 0 and (x := rank.get(symbols[h] * size + symbols[i])) is not None:
            heapq.heappush(heap, x * n + h)
    return left


class Counts(dict):
    """Tokens of a unit (a run without white space) of a lower-casing word vocabulary."""

    UNITS = re.compile(f"[^{WS}]+")
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.old, self.pieces, self.used, self.pieces_used = vocabulary, {}, {}, 0, 0

    def __missing__(self, unit: str) -> int:
        if len(unit) > UNIT:
            return self._count(unit)
        n = self.old.get(unit)
        if n is None:
            n = self._count(unit)
        if self.used > CACHE_BYTES:
            self.old, self.used = dict(self), 0
            self.clear()
        self[unit] = n
        self.used += ENTRY_BYTES + len(unit)
        return n

    def _count(self, unit: str) -> int:
        v = self.v
        if "<" in unit and v.special_at.search(unit):
            n, at = 0, 0
            for m in v.special_at.finditer(unit):
                n += 1 + (self[unit[at : m.start()]] if at < m.start() else 0)
                at = m.end()
            return n + (self[unit[at:]] if at < len(unit) else 0)
        # characters are lower-cased one by one: a final sigma is as any other
        plain = unit.lower() if unit.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", unit))
        return sum(self._piece(m[0]) for m in self.PIECES.finditer(plain)) if len(unit) > UNIT else sum(map(self._piece, self.PIECES.findall(plain)))

    def _piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            v, data = self.v, piece.encode()
            symbols = [v.first[b] for b in data]
            symbols[-1] = v.last[data[-1]]
            if len(piece) > UNIT:
                b = np.frombuffer(data, dtype=np.uint8)
                cuts = [0, *(np.flatnonzero(~v.joined[b[:-1], b[1:]]) + 1).tolist(), len(b)]
                return sum(merged_count(symbols[i:j], v.rank, v.made, v.size) for i, j in zip(cuts, cuts[1:], strict=False))
            n = merged_count(symbols, v.rank, v.made, v.size)
            if self.pieces_used > CACHE_BYTES:
                self.pieces.clear()
                self.pieces_used = 0
            self.pieces[piece] = n
            self.pieces_used += ENTRY_BYTES + len(piece)
        return n

    def tokens(self, text: str) -> int:
        return sum(map(self.__getitem__, self.UNITS.findall(text)))


def merge_rounds(flat: np.ndarray, ends: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of many words in one array (ends: where each word ends). A round looks up all adjacent pairs by binary search over the sorted keys, and in each word merges
    the places of its lowest rank, left to right. Returns the ids and each word's number of them; words without a pair leave the rounds."""
    words = np.arange(len(ends))
    counts = np.diff(np.concatenate(([0], ends)))
    over_flat, over_words, over_counts = [flat[:0]], [words[:0]], [counts[:0]]
    none = np.iinfo(np.int64).max
    while len(words):
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        key = np.full(len(flat), -1)
        key[:-1] = flat[:-1] * size + flat[1:]
        key[starts[1:] - 1] = -1
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rank = np.where(keys[at] == key, ranks[at], none)
        least = np.minimum.reduceat(rank, starts)
        over = least == none
        if over.any():
            live = np.repeat(~over, counts)
            over_flat.append(flat[~live])
            over_words.append(words[over])
            over_counts.append(counts[over])
            flat, rank = flat[live], rank[live]
            words, counts, least = words[~over], counts[~over], least[~over]
            if not len(words):
                break
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        hit = rank == np.repeat(least, counts)
        # of places side by side (a a a) every second one, from the left
        if (hit[1:] & hit[:-1]).any():
            idx = np.arange(len(hit))
            begin = hit.copy()
            begin[1:] &= ~hit[:-1]
            hit &= (idx - np.maximum.accumulate(np.where(begin, idx, 0))) % 2 == 0
        flat = flat.copy()
        flat[hit] = made[rank[hit]]
        keep = np.ones(len(flat), dtype=bool)
        keep[1:] = ~hit[:-1]
        counts = counts - np.add.reduceat(hit.astype(np.int64), starts)
        flat = flat[keep]
    # back to the order of the words
    words, counts, flat = np.concatenate(over_words), np.concatenate(over_counts), np.concatenate(over_flat)
    order = np.argsort(words)
    starts = (np.cumsum(counts) - counts)[order]
    counts = counts[order]
    return flat[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))], counts


class Encoder:
    """ids of a byte-level vocabulary, as little-endian 32-bit bytes."""

    UNITS = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.first = np.array(vocabulary.first)
        self.keys = np.array(sorted(vocabulary.rank))
        self.ranks = np.array([vocabulary.rank[k] for k in self.keys.tolist()])
        self.made = np.array(vocabulary.made)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.used = 0

    def _ids(self, pieces: list[str]) -> tuple[bytes, np.ndarray]:
        """(ids of all pieces, where each piece's end), in runs of rounds over about ROUND symbols."""
        data = [p.encode() for p in pieces]
        ends = np.cumsum([len(d) for d in data])
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        cut = np.append(~self.v.joined[flat[:-1], flat[1:]], True)
        cut[ends - 1] = True
        upto = np.flatnonzero(cut) + 1
        last = np.searchsorted(upto, ends)
        out, counts, at, w = [], [], 0, 0
        while w < len(upto):
            x = max(w + 1, int(np.searchsorted(upto, at + ROUND, side="right")))
            ids, n = merge_rounds(self.first[flat[at : upto[x - 1]]], upto[w:x] - at, self.keys, self.ranks, self.made, self.v.size)
            out.append(ids.astype("<u4"))
            counts.append(n)
            w, at = x, int(upto[x - 1])
        return np.concatenate(out).tobytes(), 4 * np.cumsum(np.concatenate(counts))[last]

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units that the cache doesn't have; those of common length are put there."""
        pieces, upto = [], [0]
        for u in units:
            if u[-1].isspace():
                pieces.append(u)
            else:
                pieces += self.PIECES.findall(u)
            upto.append(len(pieces))
        raw, ends = self._ids(pieces)
        bounds = np.concatenate(([0], ends))[upto].tolist()
        out = {u: raw[i:j] for u, i, j in zip(units, bounds, bounds[1:], strict=False)}
        for u, b in out.items():
            if len(u) <= UNIT:
                self.cache[u] = b
                self.used += ENTRY_BYTES + len(u) + len(b)
        return out

    def _split(self, text: str) -> list:
        """Units, and the ids of special strings as bytes."""
        if not any(s in text for s in self.v.special):
            return self.UNITS.findall(text)
        units, at = [], 0
        for m in self.v.special_at.finditer(text):
            units += self.UNITS.findall(text[at : m.start()])
            units.append(self.v.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        return units + self.UNITS.findall(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Some texts at once (of a bounded size together, or one)."""
        parts = [self._split(t) for t in texts]
        if self.used > CACHE_BYTES:
            self.old, self.cache, self.used = self.cache, {}, 0
        seen = set()
        seen.update(*parts)
        known, new = {}, []
        for u in seen:
            if u in self.cache:
                continue
            if isinstance(u, bytes):
                known[u] = u
            elif (b := self.old.get(u)) is not None:
                self.cache[u] = b
                self.used += ENTRY_BYTES + len(u) + len(b)
            else:
                new.append(u)
        if new:
            for u, b in self._learn(new).items():
                if len(u) > UNIT:
                    known[u] = b
        if not known:
            return [b"".join(map(self.cache.__getitem__, units)) for units in parts]
        return [b"".join([self.cache[u] if u in self.cache else known[u] for u in units]) for units in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def _groups(texts: list[str], size: int = 1 << 20):
    group, n = [], 0
    for t in texts:
        if group and n + len(t) > size:
            yield group
            group, n = [], 0
        group.append(t)
        n += len(t)
    if group:
        yield group


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), for a word vocabulary (NFC, lower case, white space dropped, word ends).

    Null and empty texts: 0. Special strings inside texts count as one token each, as the library has it by default. Each row is counted alone, so ids may repeat or be null. An
    empty table gives none. Other columns are ignored. A text is never cut; a worker holds one batch of texts and a cache of bounded size. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        counts = once(Counts, shared)
        for batch in batches:
            texts = batch["text"].to_pylist()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array([counts.tokens(t) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (array<int>), decoded (text), ids_sha256 and decoded_sha256 as asked for, for a byte-level vocabulary.

    Null and empty texts: no ids. A special string inside a text is its own id. Each row is encoded alone, so ids may repeat or be null. An empty table gives none. Other columns
    are ignored. A text is never cut; a worker holds one batch of texts and a cache of bounded size. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    names = {"n_tokens": "long"} | ({"ids": "array<int>"} if ids else {}) | ({"decoded": "string"} if decoded else {}) | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {})

    def run(batches):
        encoder = once(Encoder, shared)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for group in _groups(batch["text"].to_pylist()):
                for raw in encoder.encode(group):
                    out["n_tokens"].append(len(raw) // 4)
                    text = encoder.decode(raw) if decoded or digests else ""
                    if ids:
                        out["ids"].append(np.frombuffer(raw, dtype="<i4"))
                    if decoded:
                        out["decoded"].append(text)
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(out[n], kinds[names[n]]) for n in names)], names=["doc_id", *names])

    return rows(docs, id_col, text_col).mapInArrow(run, ", ".join(["doc_id long", *(f"{n} {t}" for n, t in names.items())]))


def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), ids=False, decoded=False, digests=True)
