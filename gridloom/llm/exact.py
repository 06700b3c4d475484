"""Exact duplicates by a heavy-hitter split: Misra-Gries finds frequent digests, which a broadcast resolves on the map side; the rest shuffle.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fresh, rows, stored

#: A digest with more than this share of the rows is sure to be among the Misra-Gries counters, of which there are 1 / SUPPORT at most.
SUPPORT = 1 / 2048


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """Each row with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Null text is empty text, and empty texts form a group like others. The row of the largest doc_id stays; null ids are smaller than others; of rows that repeat an id and a text,
    one stays. An empty table gives none. Other columns are ignored.

    Plan: one pass over the texts writes (doc_id, row, digest) to the shared folder. CollectFrequentItems (Misra-Gries counters, merged over partitions) gives at most 1 / support
    candidates; one more pass counts them exactly, and those that really hold that share win: a broadcast of at most 1 / support rows whatever the corpus. Other digests go
    through a combining aggregate and a join back, where no key has more than that share of the rows.
    """
    digests = stored(rows(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2("text", 256).alias("digest")), "digests")
    last = F.max(F.struct("doc_id", "row")).alias("last")
    total = digests.count()
    often = digests.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    winners = (
        digests.join(F.broadcast(often), "digest", "left_semi")
        .groupBy("digest")
        .agg(last, F.count("*").alias("n"))
        .where(F.col("n") >= support * total)
        .select("digest", F.col("last").alias("w_last"), F.col("n").alias("w_n"))
    )
    split = digests.join(F.broadcast(stored(winners, "winners")), "digest", "left")
    out = lambda df: df.select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("last.row") == F.col("row")).alias("kept"), F.col("digest").alias("text_sha256"))
    frequent = split.where("w_n is not null").withColumns({"last": F.col("w_last"), "n": F.col("w_n")})
    rest = split.where("w_n is null").select("doc_id", "row", "digest")
    return out(frequent).unionByName(out(rest.join(rest.groupBy("digest").agg(last, F.count("*").alias("n")), "digest")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: one of each group of equal texts, null being empty.

    The row of the largest id stays; of rows that repeat that id (or have no id) and the text, one. Columns of docs may have any name. An empty table gives none.
    """
    groups = stored(exact_groups(docs, id_col, text_col), "groups")
    gone = stored(groups.where("not kept and not doc_id <=> keep_id").select("doc_id", "text_sha256").distinct(), "gone")
    i, t = fresh(docs, "id"), fresh(docs, "digest")
    keyed = docs.withColumns({i: F.col(f"`{id_col}`").cast("long"), t: F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)})
    same = keyed[t].eqNullSafe(gone["text_sha256"]) & keyed[i].eqNullSafe(gone["doc_id"])
    out = keyed.join(gone.hint("merge"), same, "left_anti")
    if groups.where("not kept and doc_id <=> keep_id").limit(1).count():
        out = out.dropDuplicates([i, t])
    return out.drop(i, t)


def op7_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) text_sha256 from documents)
select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id = max(doc_id) over g kept, text_sha256 from d window g as (partition by text_sha256)
"""
