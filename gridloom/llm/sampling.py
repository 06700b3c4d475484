"""A bounded sample of rows that a model may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import held_out

#: Bounds of a training sample: rows, and bytes of text. Models are small; more rows change held-out results little.
ROWS, BYTES = 6000, 24_000_000


def labelled(docs: DataFrame, labels: DataFrame, n_rows: int = ROWS, n_bytes: int = BYTES) -> list[tuple[str, object]]:
    """(text, label) of at most n_rows rows and n_bytes bytes, whole texts, by the order of the id's hash.

    docs: doc_id, text. labels: doc_id, label, one row for each id. Rows with a null label or id, and held-out rows, are never among them; a row that would exceed n_bytes is
    passed over. Only ids and sizes meet the labels; texts are then read for the chosen ids, which are broadcast: at most n_rows of them.
    """
    sizes = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", F.octet_length("text").alias("bytes"))
    key = F.xxhash64("doc_id")
    listed = sizes.join(labels.where("label is not null").select("doc_id", "label"), "doc_id").orderBy(key, "doc_id", "bytes").limit(n_rows).collect()
    chosen, total, n = {}, 0, 0
    for r in listed:
        if total + r["bytes"] <= n_bytes:
            total += r["bytes"]
            n += 1
            chosen[r["doc_id"], r["bytes"]] = r["label"]
    if not chosen:
        return []
    # an id may repeat: only rows of the sizes that were counted are read, and no more of them
    size = F.octet_length("text")
    ids = F.broadcast(docs.sparkSession.createDataFrame(sorted(chosen), "doc_id long, bytes int"))
    texts = docs.select("doc_id", "text", size.alias("bytes")).join(ids, ["doc_id", "bytes"]).orderBy(key, "doc_id", "bytes", "text").limit(n).collect()
    return [(r["text"], chosen[r["doc_id"], r["bytes"]]) for r in texts]
