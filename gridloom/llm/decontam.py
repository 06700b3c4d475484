"""Benchmark decontamination by winnowing: the least k-gram hash of each sliding window, joined between corpus and benchmark, and hits extended on words.

k + w - 1 = 13 words: every shared span of 13 words or more holds a fingerprint that both sides keep.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gridloom.llm import textblocks as tb
from gridloom.llm.common import fresh, rows, stored

SPAN, K = 13, 8
W = SPAN - K + 1
#: Up to so many items and bytes of benchmark go to every executor; a larger one is joined by shuffled fingerprints.
BROADCAST_ITEMS, BROADCAST_BYTES = 100_000, 2_000_000
#: Of such a larger one, a map of 1 << BITS bits goes to the executors, which spares the shuffle what cannot match.
BITS = 24


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


_WORDS = bytes(b + 0x20 if 0x41 <= b < 0x5B else b if tb.ALNUM_WORDS[b] else 0x20 for b in range(256))


def windows(words: list[bytes]) -> list[bytes]:
    n = min(SPAN, len(words))
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def fingerprints(block: tb.Block) -> tuple:
    """Of a block: bounds, starts, ends, word hashes, k-gram hashes, and which k-grams winnowing keeps."""
    starts, ends, bounds = block.words(tb.ALNUM_WORDS)
    x = tb.hash_words(block.buf, starts, ends, lower=True)
    g = tb.grams(x, K)
    _, keep = tb.minimizers(g, tb.valid(bounds, SPAN), W)
    return bounds, starts, ends, x, g, keep


class Benchmark:
    """A bounded benchmark as it is broadcast: each window's words with its items, kept fingerprints, and windows of items under 13 words by their length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: dict[bytes, set[int]] = {}
        short: dict[int, set[int]] = {}
        kept: list[np.ndarray] = []
        for item, text in items:
            data = (text or "").encode()
            words = item_words(data)
            for w in windows(words):
                self.items.setdefault(w, set()).add(item)
            if not words:
                continue
            buf = np.frombuffer(data, dtype=np.uint8)
            _, _, _, x, g, keep = fingerprints(tb.Block(0, buf, np.array([0, len(buf)])))
            if len(words) >= SPAN:
                kept.append(g[keep])
            else:
                short.setdefault(len(words), set()).update(tb.grams(x, len(words)).tolist())
        self.kept = np.unique(np.concatenate(kept)) if kept else np.zeros(0, dtype=np.uint64)
        self.short = {n: np.array(sorted(h), dtype=np.uint64) for n, h in short.items()}
        self.bits = {n: self._bits(h) for n, h in [(0, self.kept), *self.short.items()]}

    @staticmethod
    def _bits(hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 18, dtype=bool)
        bits[(hashes >> np.uint64(46)).astype(np.int64)] = True
        return bits

    def among(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Where hashes are fingerprints (n = 0) or windows of short items of n words."""
        at = np.flatnonzero(self.bits[n][(hashes >> np.uint64(46)).astype(np.int64)])
        return at[np.isin(hashes[at], self.kept if n == 0 else self.short[n])]

    def mark(self, words: list[bytes], at: int, n: int, hit: np.ndarray, found: set[int]) -> None:
        """The window of n words that starts there, if an item has it."""
        if at >= 0 and (items := self.items.get(b" ".join(words[at : at + n]))):
            hit[at : at + n] = True
            found |= items

    def scan(self, block: tb.Block) -> list[tuple[int, int, set[int]]]:
        """(words, words hit, items) of each document."""
        bounds, starts, ends, x, g, keep = fingerprints(block)
        doc = lambda at: np.searchsorted(bounds, at, side="right") - 1
        hits: dict[int, list[tuple[int, int]]] = {}
        kept = np.flatnonzero(keep)
        for at in kept[self.among(0, g[kept])].tolist():
            hits.setdefault(int(doc(at)), []).append((at, 0))
        for n in self.short:
            h = tb.grams(x, n)
            at = self.among(n, h)
            for p in at[tb.valid(bounds, n)[at]].tolist():
                hits.setdefault(int(doc(p)), []).append((p, n))
        out: list[tuple[int, int, set[int]]] = [(int(n), 0, set()) for n in np.diff(bounds)]
        for d, places in hits.items():
            words = item_words(block.text(d))
            hit, found = np.zeros(len(words), dtype=bool), set()
            done: set[tuple[int, int]] = set()
            for at, n in places:
                at -= int(bounds[d])
                spans = [(at, n)] if n else [(s, SPAN) for s in range(max(0, at - SPAN + K), min(at, len(words) - SPAN) + 1)]
                for s in spans:
                    if s not in done:
                        done.add(s)
                        self.mark(words, s[0], s[1], hit, found)
            out[d] = (len(words), int(hit.sum()), found)
        return out


def _joined(items) -> str:
    return ",".join(sorted(map(str, items)))


def _scan_broadcast(docs: DataFrame, items: list[tuple[int, str]], text_col: str = "text", names: tuple[str, str, str] = ("n_words", "n_hit", "items"), passed: bool = False) -> DataFrame:
    """docs' columns, but for the text unless it is passed on, and words, words hit and items under the given names."""
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(items))
    rest = [f for f in docs.schema.fields if passed or f.name != text_col]

    def run(batches):
        bench = shared.value
        for batch in batches:
            found = [r for b in tb.blocks(batch[text_col]) for r in bench.scan(b)]
            arrays = [pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64()), pa.array([sorted(r[2]) for r in found], pa.list_(pa.int64()))]
            own = [batch.columns[i] for i, n in enumerate(batch.schema.names) if passed or n != text_col]
            yield pa.RecordBatch.from_arrays([*own, *arrays], names=[*(f.name for f in rest), *names])

    return docs.mapInArrow(run, StructType([*rest, *(StructField(n, t) for n, t in zip(names, (LongType(), LongType(), ArrayType(LongType())), strict=True))]))


def _bitmap(prints: DataFrame) -> np.ndarray:
    """1 << BITS bits, of which those are set that the low bits of some h name: of one size whatever the benchmark."""
    bit = F.pmod(F.col("h"), F.lit(1 << BITS)) + 1
    parts = prints.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for r in parts:
        own = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        at = (r["part"] - 1) * len(own)
        out[at : at + len(own)] = own[: len(out) - at]
    return out


def _window_bits(words: list[bytes]) -> tuple[int, int]:
    return struct.unpack("<qq", tb.digest(b" ".join(words)))


def _scan_shuffled(d: DataFrame, b: DataFrame) -> DataFrame:
    """For a benchmark of any size. d: row, doc_id, text, as a stored table whose row tells rows apart; b: doc_id (the item), text. Returns row, doc_id, n_words, n_hit, items.

    Fingerprints of both sides meet first, only to choose documents and places (a semi-join: no product of documents and items that share one). Windows at those places then meet the
    items' windows by 128 bits; texts go nowhere but to their own places.
    """
    words = F.filter(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != "")
    lengths = sorted(r[0] for r in b.select(F.size(words).alias("n")).where(f"n between 1 and {SPAN - 1}").distinct().collect())

    def of_items(batches):
        for batch in batches:
            out = {"item": [], "h": [], "w1": [], "w2": []}
            for item, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = text.encode()
                w = item_words(data)
                if not w:
                    continue
                buf = np.frombuffer(data, dtype=np.uint8)
                _, _, _, x, g, keep = fingerprints(tb.Block(0, buf, np.array([0, len(buf)])))
                h = g[keep] if len(w) >= SPAN else tb.grams(x, len(w)) + np.uint64(len(w))
                bits = {_window_bits(v.split()) for v in windows(w)}
                out["item"].append(item)
                out["h"].append(np.unique(h).view(np.int64))
                out["w1"].append([v[0] for v in bits])
                out["w2"].append([v[1] for v in bits])
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    items = stored(b.mapInArrow(of_items, "item long, h array<long>, w1 array<long>, w2 array<long>"), "items")
    prints = stored(items.select(F.explode("h").alias("h")).distinct(), "prints")
    owned = stored(items.select("item", F.explode(F.arrays_zip("w1", "w2")).alias("w")).select("w.w1", "w.w2", "item").distinct(), "owned")
    shared = d.sparkSession.sparkContext.broadcast(_bitmap(prints))

    def places(block: tb.Block):
        """(length of window, or 0 for a winnowed fingerprint; places; hashes) whose bit is set."""
        bounds, _, _, x, g, keep = fingerprints(block)
        bits = shared.value
        for n, at in [(0, np.flatnonzero(keep)), *((n, np.flatnonzero(tb.valid(bounds, n))) for n in lengths)]:
            h = (tb.grams(x, n)[at] + np.uint64(n)) if n else g[at]
            low = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
            hit = (bits[low >> 3] >> (low & 7)) & 1 == 1
            yield bounds, n, at[hit], h[hit]

    def describe(batches):
        for batch in batches:
            n_words, hashes = [], []
            for b in tb.blocks(batch["text"]):
                own: list[list] = [[] for _ in range(b.n_docs)]
                for bounds, _, at, h in places(b):
                    for doc, v in zip((np.searchsorted(bounds, at, side="right") - 1).tolist(), h.view(np.int64).tolist(), strict=True):
                        own[doc].append(v)
                n_words += np.diff(bounds).tolist()
                hashes += [sorted(set(v)) for v in own]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["row", "doc_id", "n_words", "h"])

    def locate(batches):
        for batch in batches:
            asked, rows_ = batch["h"].to_pylist(), batch["row"].to_pylist()
            for b in tb.blocks(batch["text"]):
                found: dict[int, dict[tuple[int, int], None]] = {}
                for bounds, n, at, h in places(b):
                    for place, v in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        doc = int(np.searchsorted(bounds, place, side="right") - 1)
                        if v in set_of(asked, b.first + doc):
                            place -= int(bounds[doc])
                            size = int(bounds[doc + 1] - bounds[doc])
                            for s in [place] if n else range(max(0, place - SPAN + K), min(place, size - SPAN) + 1):
                                found.setdefault(doc, {})[s, n or SPAN] = None
                out = {"row": [], "at": [], "n": [], "w1": [], "w2": []}
                for doc, spans in found.items():
                    w = item_words(b.text(doc))
                    for s, n in spans:
                        for c, v in zip(out, (rows_[b.first + doc], s, n, *_window_bits(w[s : s + n])), strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    def set_of(asked: list, i: int) -> set:
        if not isinstance(asked[i], set):
            asked[i] = set(asked[i])
        return asked[i]

    described = stored(d.select("row", "doc_id", "text").mapInArrow(describe, "row long, doc_id long, n_words long, h array<long>"), "described")
    wanted = described.select("row", F.explode("h").alias("h")).join(prints, "h", "left_semi").groupBy("row").agg(F.collect_list("h").alias("h"))
    near = stored(d.select("row", "text").join(wanted, "row").select("row", "text", "h").mapInArrow(locate, "row long, at long, n long, w1 long, w2 long"), "near")
    hits = stored(near.join(owned.select("w1", "w2").distinct(), ["w1", "w2"], "left_semi"), "hits")
    n_hit = hits.select("row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("w")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    held = hits.select("row", "w1", "w2").distinct().join(owned, ["w1", "w2"]).select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return described.join(n_hit, "row", "left").join(held, "row", "left").select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def small_benchmark(benchmark: DataFrame, items: int = BROADCAST_ITEMS, size: int = BROADCAST_BYTES) -> list[tuple[int, str]] | None:
    """The items, if they are within the broadcast's bound; None beyond it."""
    total = benchmark.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if total[0] > items or (total[1] or 0) > size:
        return None
    return [(r[0], r[1]) for r in benchmark.select("doc_id", "text").collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item ids, sorted): which words of each document lie in a window of 13 words of an item; an item under 13 words is one window.

    Null and empty texts have no words. Items with a null id, or without words, never occur. Rows that repeat are judged alike; items that repeat an id are united; an empty
    benchmark hits nothing. A window that several items hold counts for each. Other columns are ignored.

    A benchmark within broadcast_bytes goes to every executor, and the corpus is one pass without a shuffle. Beyond, fingerprints of both sides are joined by a shuffle.
    """
    d = rows(docs, id_col, text_col)
    b = rows(benchmark, item_col, item_text_col).where("doc_id is not null")
    items = small_benchmark(b, size=broadcast_bytes)
    if items is not None:
        return _scan_broadcast(d, items)
    return _scan_shuffled(stored(d.withColumn("row", F.monotonically_increasing_id()), "docs"), b).drop("row")


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def _holds_passage(n_words: str, n_hit: str):
    """A whole span of 13 words stands in it, however long the text is; or a twentieth of it does, of which items under 13 words may be the cause."""
    return (F.col(n_hit) >= SPAN) | contaminated(n_words, n_hit)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs, with their columns, that hold no passage of the benchmark: less than 13 of a text's words are hit (see decontaminate), and less than a twentieth.

    Each row is judged on its own, whatever its id. Null and empty texts stay. An empty table gives none, an empty benchmark leaves all. Columns of docs may have any name.
    """
    b = rows(benchmark, item_col, item_text_col).where("doc_id is not null")
    items = small_benchmark(b, size=broadcast_bytes)
    if items is not None:
        n_words, n_hit, found = names = tuple(fresh(docs, n) for n in ("n_words", "n_hit", "items"))
        return _scan_broadcast(docs, items, text_col, names, passed=True).where(~_holds_passage(n_words, n_hit)).drop(*names)
    row = fresh(docs, "row")
    d = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    bad = _scan_shuffled(rows(d, id_col, text_col, row=row), b).where(_holds_passage("n_words", "n_hit")).select(F.col("row").alias(row))
    return d.join(stored(bad, "bad").hint("merge"), row, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def verdict(found: DataFrame) -> DataFrame:
    """The digest columns."""
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), contaminated().alias("contaminated"))


def op3_decontaminate(spark, sf_dir):
    return verdict(decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def brute(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """The same by comparing every window of every item with every place, for tests."""
    wanted: dict[bytes, set] = {}
    for item, text in items:
        for w in windows(item_words((text or "").encode())):
            wanted.setdefault(w, set()).add(item)
    sizes = {len(w.split()) for w in wanted}
    out = []
    for doc, text in docs:
        words, hit, found = item_words((text or "").encode()), set(), set()
        for n in sizes:
            for s in range(len(words) - n + 1):
                if got := wanted.get(b" ".join(words[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= got
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(_joined(found).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out
