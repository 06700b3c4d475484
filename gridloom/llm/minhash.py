"""Near duplicates by circulant MinHash: one permutation scatters the shingles, a second one, circularly shifted, gives every coordinate of the signature.

Candidates share a band; links are confirmed by Jaccard similarity of the full sets of shingles; groups are connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.llm import textblocks as tb
from gridloom.llm.common import components, forget, rows, scratch, stored

SHINGLE = 5
#: At a similarity of 0.85 a pair misses all bands with a chance of (1 - 0.85 ** 4) ** 20 = 4e-7.
BANDS, BAND_ROWS = 20, 4
#: Stars around this many centres of a bucket are tried before the rest of it.
STARS = 3
#: Outsiders and members that meet in one task, and about how many bytes of either.
OUTSIDERS, MEMBERS, BLOCK_BYTES = 256, 1024, 4 << 20
#: Slots of the table of how often shingles occur; sets with a rare shingle in common that are compared as pairs.
SLOT_BITS, FEW = 18, 8
_STEP = np.uint64(0xD1B54A32D192ED03)
_PI = np.uint64(0xA0761D6478BD642F)
_CHUNK = 1 << 15


def shingles(block: tb.Block) -> list[np.ndarray]:
    """Each document's sorted distinct shingles, 64 bits each; of fewer than 5 words, the whole sequence is one."""
    starts, ends, bounds = block.words(tb.SPACE_WORDS)
    x = tb.hash_words(block.buf, starts, ends, lower=True)
    g = tb.grams(x, SHINGLE)
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(np.unique(g[i : j - SHINGLE + 1]) if j - i >= SHINGLE else tb.grams(x[i:j], j - i) if j > i else g[:0])
    return out


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k coordinates for each set. sigma(i) is the mixed hash on the ring of 2**64; coordinate t takes the least pi(sigma(i) - t * step)."""
    sig = np.full((len(sets), k), np.iinfo(np.uint64).max, dtype=np.uint64)
    filled = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(filled):
        upto, n = at, 0
        while upto < len(filled) and (upto == at or n + len(sets[filled[upto]]) <= _CHUNK):
            n += len(sets[filled[upto]])
            upto += 1
        own = filled[at:upto]
        sigma = tb.mix(np.concatenate([sets[i] for i in own]))
        cuts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in own])[:-1]))
        p = np.empty_like(sigma)
        for t in range(k):
            sigma -= _STEP
            np.multiply(sigma, _PI, out=p)
            p ^= p >> np.uint64(32)
            p *= _STEP
            sig[own, t] = np.minimum.reduceat(p, cuts)
        at = upto
    return sig


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    per = sig.shape[1] // bands
    out = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(per):
            h = tb.mix(h * _PI + sig[:, b * per + r])
        out[:, b] = h
    return out


def normal(text: bytes) -> bytes:
    return b" ".join(text.translate(tb.LOWER_BYTES).split())


def _digest(text: bytes) -> str:
    return tb.digest(normal(text)).hex()


def _describe(bands: int, band_rows: int, passed: list[str]):
    def run(batches):
        forget()
        for batch in batches:
            n, digests, hashes = [], [], []
            for b in tb.blocks(batch["text"]):
                sets = shingles(b)
                n += [len(s) for s in sets]
                digests += [_digest(b.text(i)) if len(s) else None for i, s in enumerate(sets)]
                hashes.append(band_hashes(signatures(sets, bands * band_rows), bands))
            flat = np.concatenate(hashes) if hashes else np.zeros((0, bands), dtype=np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, bands, dtype=np.int32)), pa.array(flat.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.string()), lists, *(batch[c] for c in passed)], names=["doc_id", "n_shingles", "digest", "bands", *passed])

    return run


def _sets(batches):
    """v, set (bytes of sorted 64-bit hashes) of the rows whose text has the digest that was asked for."""
    forget()
    for batch in batches:
        v, out, asked, node = [], [], batch["digest"].to_pylist(), batch["v"].to_pylist()
        for b in tb.blocks(batch["text"]):
            for i, s in enumerate(shingles(b)):
                if _digest(b.text(i)) == asked[b.first + i]:
                    v.append(node[b.first + i])
                    out.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(out, pa.binary())], names=["v", "shingles"])


def _similar(percent: int):
    """The pairs that are linked."""

    def run(batches):
        forget()
        for batch in batches:
            same = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                same.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    return run


def _across(percent: int):
    """Of one block: links between different components, as many as join them (a forest), found by counting common shingles of each outsider with all members at once."""

    def run(table: pa.Table) -> pa.Table:
        v, comp, out = table["v"].to_pylist(), table["comp"].to_pylist(), table["outsider"].to_pylist()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table["shingles"]]
        sizes = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
        up = {c: c for c in comp}

        def top(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        a, b = [], []
        for i in [i for i, o in enumerate(out) if o]:
            lo, hi = np.searchsorted(flat, sets[i], side="left"), np.searchsorted(flat, sets[i], side="right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            both = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)).tolist():
                if (x := top(comp[i])) != (y := top(comp[j])):
                    up[x] = y
                    a.append(min(v[i], v[j]))
                    b.append(max(v[i], v[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _slots(batches):
    """How many of the sets have a shingle in each slot, as far as this task has seen."""
    n = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for batch in batches:
        for x in batch["shingles"]:
            own = np.frombuffer(x.as_buffer(), dtype=np.uint64) >> np.uint64(64 - SLOT_BITS)
            n += np.bincount(own.astype(np.int64), minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])


def _prefixes(percent: int, shared):
    """(shingle, v, label, size): of each set, those shingles of which two sets that are similar enough must have one in common."""

    def run(batches):
        often = shared.value
        for batch in batches:
            rare, sizes = [np.zeros(0, dtype=np.uint64)], []
            for x in batch["shingles"]:
                x = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                n = often[(x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                first = np.lexsort((x, n))[: len(x) + percent * len(x) // -100 + 1]
                rare.append(x[first[n[first] > 1]])
                sizes.append(len(x))
            of = pa.array(np.repeat(np.arange(len(sizes)), [len(x) for x in rare[1:]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rare).view(np.int64)), batch["v"].take(of), batch["label"].take(of), pa.array(sizes, pa.int64()).take(of)], names=["g", "v", "label", "n"])

    return run


def _sizes(groups: DataFrame) -> DataFrame:
    """groups: g, v, label, n (shingles). Of each group: its largest component, and in how many blocks its outsiders (all others) and its members are dealt."""
    per = groups.groupBy("g", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).groupBy("g").agg(
        F.max_by(F.struct("label", "rows", "n"), F.struct("rows", "label")).alias("main"), F.sum("rows").alias("rows"), F.sum("n").alias("n")
    )
    blocks = lambda rows, most, n: F.ceil(F.greatest(rows / most, 8 * n / BLOCK_BYTES)).cast("int")
    out = per.select("g", F.col("main.label").alias("main"), "rows", blocks(F.col("rows") - F.col("main.rows"), OUTSIDERS, F.col("n") - F.col("main.n")).alias("ks"), blocks(F.col("rows"), MEMBERS, F.col("n")).alias("ls"))
    return stored(out, "sizes")


def _blocks(groups: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between the components of a group, or as many as join them. Outsiders and members are dealt out in blocks bounded by number and bytes, a task for each pair of
    blocks, and what a task sends on is less than its rows."""
    m = groups.select("g", "v", "label").join(sizes, "g").withColumn("outsider", F.col("label") != F.col("main"))
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n, seed: F.pmod(F.xxhash64("v", F.lit(seed)), F.col(n)).cast("int")
    # each member to its block, against all blocks of outsiders; each outsider, as such, to its block, against all blocks of members
    all_ = m.select("g", "v", "label", F.lit(False).alias("outsider"), F.explode(spread("ks")).alias("k"), own("ls", 1).alias("l"))
    out = m.where("outsider").select("g", "v", "label", F.lit(True).alias("outsider"), own("ks", 2).alias("k"), F.explode(spread("ls")).alias("l"))
    blocks = all_.unionByName(out).select("g", "k", "l", "v", F.col("label.v").alias("comp"), "outsider").join(sets.hint("merge"), "v")
    return stored(blocks.groupBy("g", "k", "l").applyInArrow(_across(percent), "a long, b long"), "across")


def _rest(members: DataFrame, sets: DataFrame, percent: int, compared) -> DataFrame:
    """members: band, v, n, label of buckets with several components. All links between their components, or as many as join them.

    A bucket that fits one block is compared there, outsiders with all. Of larger ones not all pairs are compared, by prefix filtering: in an order by how often shingles occur,
    rarest first, two similar sets share one of their first n - ceil(percent * n) + 1. The order comes from a table of 1 << SLOT_BITS counts, whatever the input; it is the same
    everywhere, so the filter is exact, and a passage that all members share is in few prefixes. Those who share a rare shingle are compared as pairs, up to FEW of them;
    more, in blocks.
    """
    groups = members.withColumnRenamed("band", "g")
    sizes = _sizes(groups)
    links = _blocks(groups, sizes.where("ks * ls = 1"), sets, percent)
    large = groups.join(sizes.where("ks * ls > 1").select("g"), "g")
    if not sizes.where("ks * ls > 1").limit(1).count():
        return links
    inside = stored(large.select("v", "label").distinct().join(sets, "v"), "inside")
    counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for r in inside.select("shingles").mapInArrow(_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toLocalIterator():
        counts[r["slot"]] = r["n"]
    shared = members.sparkSession.sparkContext.broadcast(counts)
    schema = StructType([StructField("g", LongType()), *inside.select("v", "label").schema.fields, StructField("n", LongType())])
    tokens = stored(inside.mapInArrow(_prefixes(percent, shared), schema), "tokens")
    mixed = stored(tokens.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("g", "m"), "mixed")
    few, many = (tokens.join(mixed.where(c).select("g"), "g") for c in (f"m <= {FEW}", f"m > {FEW}"))
    end = lambda x: few.select("g", F.col("v").alias(f"v{x}"), F.col("n").alias(f"n{x}"), F.col("label").alias(f"l{x}"))
    pairs = compared(end("a").join(end("b"), "g").where("va < vb and la <> lb"))
    return links.unionByName(pairs).unionByName(_blocks(many, _sizes(many), sets, percent))


def _grouped(source: DataFrame, percent: int, bands: int, band_rows: int, passed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(each row with the digest of its words; digest, component_id). Joins are by sort and merge whatever the size, as neither side is bounded and both can spill."""
    described = source.withColumns({c: F.sha2("text", 256) for c in passed}).mapInArrow(
        _describe(bands, band_rows, passed), ", ".join(["doc_id long, n_shingles long, digest string, bands array<long>", *(f"{c} string" for c in passed)])
    )
    seen = stored(described, "described")
    texts = seen.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = stored(texts.withColumn("v", F.monotonically_increasing_id()), "nodes")
    every = nodes.select("v", "id", "n", F.explode("bands").alias("band"))
    shared = stored(every.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    members = stored(every.join(shared.hint("merge"), "band"), "members")
    wanted = stored(nodes.select("v", "digest", F.col("id").alias("doc_id")).join(members.select("v").distinct(), "v", "left_semi"), "wanted")
    sets = stored(source.join(wanted.hint("merge"), "doc_id").select("v", "digest", "text").mapInArrow(_sets, "v long, shingles binary").dropDuplicates(["v"]), "sets")

    def compared(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
        both = one.join(sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
        return stored(both.select("a", "b", "sa", "sb").mapInArrow(_similar(percent), "a long, b long"), "links")

    def ordered(df: DataFrame) -> DataFrame:
        """Pairs va, vb of different texts whose sizes na, nb allow the similarity, each once."""
        fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("va") != F.col("vb"))
        return df.where(fits).select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b")).distinct()

    now, open_, turn, n = nodes.select("v", F.struct("id", "v").alias("label")), members, 0, nodes.count()
    while m := open_.count():
        if turn < STARS:
            key = F.struct("id", "v", "n") if turn == 0 else F.struct(F.xxhash64("v", F.lit(turn)).alias("id"), "v", "n")
            centre = stored(open_.groupBy("band").agg(F.min(key).alias("c")).select("band", F.col("c.v").alias("vb"), F.col("c.n").alias("nb")), "centres", m)
            new = compared(ordered(open_.join(centre.hint("merge"), "band").select(F.col("v").alias("va"), F.col("n").alias("na"), "vb", "nb")))
        else:
            new = _rest(open_, sets, percent, lambda pairs: compared(ordered(pairs)))
        now, turn = stored(components(now, new), "components", n), turn + 1
        if turn > STARS:
            break
        # only buckets that still hold several components go on
        left = stored(open_.where("m > 2").select("band", "v", "id", "n", "m").join(now.hint("merge"), "v"), "left", m)
        mixed = stored(left.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band"), "mixed", m)
        open_ = stored(left.join(mixed.hint("merge"), "band"), "open", m)
    return seen, stored(nodes.select("v", "digest").join(now.hint("merge"), "v").select("digest", F.col("label.id").alias("component_id")), "groups", n)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, bands: int = BANDS, band_rows: int = BAND_ROWS, digests: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept (whether it is that one).

    Words are runs between ASCII white space, A-Z lower-cased. Two texts are linked if 100 * intersection >= percent * union of their sets. Null texts, and texts without words, are
    linked with nothing. A row with a null id belongs to no group: its component_id is null, and it is kept. Rows that repeat an id share a component if their texts do.
    An empty table gives none. Other columns are ignored. digests: text_sha256 too, which tells rows apart that share an id but not the text.

    Plan: one pass over the texts gives each distinct word sequence a digest and its band hashes; copies fold into their least id before any band is shuffled. In each bucket of a
    band, members are compared with one centre (a star, not all pairs); links join components, and only buckets that still hold several components go on, with other
    centres, and at last in blocks, or by the rarest shingles of large buckets (see _rest). So no link between components is lost, a bucket of n copies costs n comparisons, and no
    list of all pairs is ever made. Sets are made again from the texts of candidates only. What a join brings back to a bucket's members is written first, so that Spark can
    split the members of a hot bucket over tasks.
    """
    with scratch() as kept:
        seen, groups = _grouped(rows(docs, id_col, text_col), percent, bands, band_rows, passed := ["text_sha256"] if digests else [])
        kept += [seen, groups]
    return (
        seen.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"), *passed).join(groups.hint("merge"), "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *passed)
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op4_minhash_dedup(spark, sf_dir):
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute(docs: list[tuple], percent: int = 85) -> list[tuple]:
    """The same by comparing all pairs, for tests."""
    sets = []
    for doc, text in docs:
        w = normal((text or "").encode()).split()
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} if len(w) >= SHINGLE else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        least[top(i)] = min(doc, least.get(top(i), doc))
    return [(doc, len(sets[i]), least[top(i)], doc == least[top(i)]) for i, (doc, _) in enumerate(docs)]
