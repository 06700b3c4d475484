"""Repeated passages: confirm what recurs, compile sharded Aho-Corasick automata of it, and stream documents through them to locate every occurrence.

A window is SPAN consecutive words. Windows that recur are confirmed by 128 bits; the origin of one is the document of least id that holds it. An automaton holds the windows of
some stretches of origins, as sequences of word numbers, so what it locates is equal word by word.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textblocks as tb
from gridloom.llm.common import release, rows, stored

SPAN = 50
#: Fingerprints: the least of W runs of K words; K + W - 1 = SPAN, so that each window holds one.
K = 20
W = SPAN - K + 1
#: Windows of one stretch of an origin, and in one automaton; bytes of documents that one task streams through it.
STRETCH, SHARD_WINDOWS, STREAM_BYTES = 2_000, 8_000, 16_000_000


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _describe(batches):
    """Each document's word count, digest of its words, and distinct fingerprints."""
    for batch in batches:
        n, digests, prints, sizes = [], [], [np.zeros(0, dtype=np.uint64)], [0]
        for b in tb.blocks(batch["text"]):
            starts, ends, bounds = b.words(tb.SPACE_WORDS)
            n += np.diff(bounds).tolist()
            digests += [_digest(b.text(i).split()) for i in range(b.n_docs)]
            g = tb.grams(tb.hash_words(b.buf, starts, ends, lower=False), K)
            _, keep = tb.minimizers(g, tb.valid(bounds, SPAN), W)
            at = np.flatnonzero(keep)
            doc = np.searchsorted(bounds, at, side="right") - 1
            order = np.lexsort((g[at], doc))
            at, doc = at[order], doc[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (g[at[1:]] != g[at[:-1]]) | (doc[1:] != doc[:-1])
            prints.append(g[at[new]])
            sizes += np.bincount(doc[new], minlength=b.n_docs).tolist()
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(prints).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["raw"], pa.array(n, pa.int64()), pa.array(digests, pa.string()), lists], names=["doc_id", "raw", "n_words", "digest", "prints"])


def _windows(batches):
    """128 bits and the place of each window whose fingerprint recurs."""
    for batch in batches:
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        prints = batch["prints"]
        for b in tb.blocks(batch["text"]):
            starts, ends, bounds = b.words(tb.SPACE_WORDS)
            x = tb.hash_words(b.buf, starts, ends, lower=False)
            least = tb.sliding(tb.grams(x, K), W)
            ok = tb.valid(bounds, SPAN)
            for d in range(b.n_docs):
                i, j = int(bounds[d]), int(bounds[d + 1]) - SPAN + 1
                if j <= i:
                    continue
                wanted = np.asarray(prints[b.first + d].values.to_numpy(zero_copy_only=False)).view(np.uint64)
                ok[i:j] &= np.isin(least[i:j], wanted)
            at = np.flatnonzero(ok)
            doc = np.searchsorted(bounds, at, side="right") - 1
            for lo in range(0, len(at), 100_000):
                part, of = at[lo : lo + 100_000], doc[lo : lo + 100_000]
                # 2 hashes of 50 words each, only around the places
                h = [_at(x, part, seed) for seed in (0x9FB21C651E98DF25, 0xC6A4A7935BD1E995)]
                yield pa.RecordBatch.from_arrays([*(pa.array(v.view(np.int64)) for v in h), pa.array(ids[b.first + of]), pa.array(part - bounds[of], pa.int64())], names=["w1", "w2", "doc_id", "at"])


def _at(x: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    h = np.zeros(len(places), dtype=np.uint64)
    base = np.uint64(seed)
    for q in range(SPAN):
        h *= base
        h += x[places + q]
    return tb.mix(h)


def _passages(batches):
    """Of each stretch of an origin, the words of its runs of recurring windows: origin, stretch, passages (array of text), n (windows)."""
    for batch in batches:
        out = {"origin": [], "stretch": [], "passages": [], "n": []}
        for doc, text, places in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "places")), strict=True):
            words = text.encode().split()
            at = np.array(sorted(places))
            cut = np.flatnonzero((np.diff(at) != 1) | (at[1:] // STRETCH != at[:-1] // STRETCH)) + 1
            runs: dict[int, list[np.ndarray]] = {}
            for run in np.split(at, cut):
                runs.setdefault(int(run[0]) // STRETCH, []).append(run)
            for stretch, own in runs.items():
                out["origin"].append(doc)
                out["stretch"].append(stretch)
                out["passages"].append([b" ".join(words[run[0] : run[-1] + SPAN]).decode() for run in own])
                out["n"].append(sum(map(len, own)))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("origin", pa.int64()), ("stretch", pa.int64()), ("passages", pa.list_(pa.string())), ("n", pa.int64())]))


class Automaton:
    """An Aho-Corasick automaton of all windows of some passages, over word numbers."""

    def __init__(self, passages: list[tuple[int, bytes]]):
        """passages: (origin, text)."""
        self.number: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for origin, text in passages:
            words = tuple([self.number.setdefault(w, len(self.number) + 1) for w in text.split()])
            for s in range(len(words) - SPAN + 1):
                self.machine.add_word(words[s : s + SPAN], origin)
        if len(self.machine):
            self.machine.make_automaton()

    def locate(self, doc: int, text: bytes) -> list[tuple[int, int]]:
        """Word ranges of the text that windows of smaller origins cover."""
        words = tuple([self.number.get(w, 0) for w in text.split()])
        if len(words) < SPAN or not len(self.machine):
            return []
        last = np.array([i for i, origin in self.machine.iter(words) if origin < doc], dtype=np.int64)
        if not len(last):
            return []
        cut = np.flatnonzero(np.diff(last) > SPAN)
        return list(zip((last[np.append(0, cut + 1)] - SPAN + 1).tolist(), (last[np.append(cut, len(last) - 1)] + 1).tolist(), strict=True))


def _stream(left: pa.Table, right: pa.Table) -> pa.Table:
    """One shard, and a part of the documents that are routed to it."""
    machine = Automaton([(o, p.encode()) for o, ps in zip(left["origin"].to_pylist(), left["passages"].to_pylist(), strict=True) for p in ps])
    out = {"doc_id": [], "raw": [], "from": [], "upto": []}
    for batch in right.to_batches():
        for doc, raw, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "raw", "text")), strict=True):
            for lo, hi in machine.locate(doc, text.encode()):
                for c, v in zip(out, (doc, raw, lo, hi), strict=True):
                    out[c].append(v)
    return pa.Table.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))


def _kept(batches):
    """What is left of the texts that lose words."""
    for batch in batches:
        gone, left = [], []
        for text, ranges in zip(batch["text"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
            words = text.encode().split()
            keep = np.ones(len(words), dtype=bool)
            for r in ranges:
                keep[r["from"] : r["upto"]] = False
            gone.append(int((~keep).sum()))
            left.append(b" ".join(words[i] for i in np.flatnonzero(keep)).decode())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["raw"], pa.array(gone, pa.int64()), pa.array(left, pa.string())], names=["doc_id", "raw", "gone", "left"])


def _ranges(source: DataFrame, found: DataFrame, shard_windows: int, stream_bytes: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(texts, ranges, tables to release): the texts that share a fingerprint with another, and the word ranges (doc_id, raw, from, upto) of theirs that also stand in a document of smaller id."""
    # copies of a whole text need no windows: the least id stands for them
    first = found.where(f"doc_id is not null and n_words >= {SPAN}").groupBy("digest").agg(F.min(F.struct("doc_id", "raw")).alias("f"), F.first("prints").alias("prints"))
    prints = stored(first.select("f.doc_id", "f.raw", F.explode("prints").alias("print")), "prints")
    recur = prints.groupBy("print").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("print")
    # written first, so that Spark can split the documents of a hot fingerprint over tasks
    recur = stored(recur, "recur")
    asked = prints.join(recur.hint("merge"), "print").groupBy("doc_id", "raw").agg(F.collect_list("print").alias("prints"))
    texts = stored(source.join(asked.hint("merge"), ["doc_id", "raw"]).select("doc_id", "raw", "text", "prints").dropDuplicates(["doc_id", "raw"]), "texts")
    windows = stored(texts.mapInArrow(_windows, "w1 long, w2 long, doc_id long, at long"), "windows")
    release(prints, recur)
    held = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("hi")).where("first.doc_id < hi")
    held = stored(held.select("w1", "w2", F.col("first.doc_id").alias("origin"), F.col("first.at").alias("at")), "held")
    found_at = held.select("w1", "w2", "origin", F.floor(F.col("at") / STRETCH).alias("stretch"))
    routes = stored(windows.join(found_at.hint("merge"), ["w1", "w2"]).where("doc_id > origin").select("doc_id", "origin", "stretch").distinct(), "routes")
    release(windows)
    places = held.groupBy(F.col("origin").alias("doc_id")).agg(F.collect_list("at").alias("places"))
    passages = stored(texts.select("doc_id", "text").join(places, "doc_id").mapInArrow(_passages, "origin long, stretch long, passages array<string>, n long"), "passages")
    # shards of about shard_windows, by a hash of origin and stretch: a document goes to those only with which it shares a window
    n_shards = 1 + int((passages.agg(F.sum("n")).first()[0] or 0) // shard_windows)
    shard = F.pmod(F.xxhash64("origin", "stretch"), F.lit(n_shards)).cast("int")
    routed = routes.select("doc_id", shard.alias("shard")).distinct()
    size = texts.select("doc_id", F.octet_length("text").alias("bytes"))
    # a shard that many documents need is compiled by several tasks, each for about stream_bytes of them
    load = stored(routed.join(size, "doc_id").groupBy("shard").agg((1 + F.floor(F.sum("bytes") / stream_bytes)).cast("int").alias("parts")), "load")
    right = routed.join(load, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).join(texts.select("doc_id", "raw", "text"), "doc_id")
    left = passages.withColumn("shard", shard).join(load, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left, right = left.select("shard", "part", "origin", "passages"), right.select("shard", "part", "doc_id", "raw", "text")
    ranges = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(_stream, "doc_id long, raw long, from long, upto long")
    return texts, ranges, [held, routes, passages, load]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_windows: int = SHARD_WINDOWS, stream_bytes: int = STREAM_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, ranges (array of from, upto), left (the words that stay of a text that loses some, joined by spaces; else null).

    Each word goes that a window covers whose words also start in a document of smaller doc_id. Words are runs between ASCII white space, unchanged; windows are judged on the
    input. Null texts, and texts under 50 words, lose nothing. A row with a null id loses nothing and makes no other lose. Rows that repeat an id don't count against each other.
    An empty table gives none. Other columns are ignored.

    Plan: rolling hashes only choose candidates: fingerprints of which each window holds one, counted over the corpus with a combining aggregate; then 128 bits for windows
    around those that recur. What is left is a small part of the corpus: recurring windows joined into passages at their origin. Passages form shards of bounded size, each an automaton;
    a document is streamed through those shards only with which it shares a window, and a shard that many documents need is dealt to several tasks.
    """
    source = rows(docs, id_col, text_col).withColumn("raw", F.xxhash64("text"))
    found = stored(source.mapInArrow(_describe, "doc_id long, raw long, n_words long, digest string, prints array<long>"), "described")
    texts, ranges, tables = _ranges(source, found, shard_windows, stream_bytes)
    per = stored(ranges.groupBy("doc_id", "raw").agg(F.array_sort(F.collect_set(F.struct("from", "upto"))).alias("ranges")), "ranges")
    cut = stored(texts.join(per, ["doc_id", "raw"]).select("doc_id", "raw", "text", "ranges").mapInArrow(_kept, "doc_id long, raw long, gone long, left string"), "cut")
    release(texts, *tables)
    cut = cut.join(per, ["doc_id", "raw"])
    found = found.drop("prints")
    # written first, so that Spark can split the rows of a text with many copies over tasks
    least = found.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").drop("last")
    least = stored(least, "copies").hint("merge")
    copy = F.coalesce((F.col("doc_id") > F.col("least")) & (F.col("n_words") >= SPAN), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_words").alias("upto")))
    return found.join(least, "digest", "left").join(cut, ["doc_id", "raw"], "left").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_digest([]))).when(F.col("left").isNotNull(), F.sha2("left", 256)).otherwise(F.col("digest")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("ranges", F.array().cast("array<struct<from:bigint,upto:bigint>>"))).alias("ranges"), F.when(copy, F.lit("")).otherwise(F.col("left")).alias("left"),
    )


def op2_remove_repeats(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def brute(docs: list[tuple]) -> list[tuple]:
    """The same from a dictionary of all windows, for tests."""
    words = {doc: (text or "").encode().split() for doc, text in docs}
    first: dict[tuple, int] = {}
    for doc in sorted(words):
        for i in range(len(words[doc]) - SPAN + 1):
            first.setdefault(tuple(words[doc][i : i + SPAN]), doc)
    out = []
    for doc, w in words.items():
        gone = {q for i in range(len(w) - SPAN + 1) if first[tuple(w[i : i + SPAN])] < doc for q in range(i, i + SPAN)}
        out.append((doc, len(w), len(gone), _digest([x for i, x in enumerate(w) if i not in gone])))
    return out
