"""Secrets, and how widely each is copied: candidate hashes counted by distinct repositories and owners over the whole corpus.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import rows, stored

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A run this long may be a credential of no known form.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: Live-looking: so many different characters, and digits, in a value that so few owners hold.
MIN_DISTINCT, MIN_DIGITS, MAX_OWNERS = 10, 3, 1


def _matches(text: Column, kind: int, pattern: str, keep, value_group: int = 0) -> Column:
    """array<struct<k, gap, size, value>> of all matches: code points since the match before, and of the match; the value is null where keep() refuses it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    each = F.arrays_zip(found.alias("m"), values.alias("v"), F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("p"))
    one = lambda x: F.struct(F.lit(kind).alias("k"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"), F.when(keep(x["v"]), x["v"]).alias("value"))
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(each, one)).otherwise(F.array().cast("array<struct<k:int,gap:int,size:int,value:string>>"))


def _live_looking(v: Column) -> Column:
    return (F.size(F.array_distinct(F.split(v, ""))) >= MIN_DISTINCT) & (F.length(F.regexp_replace(v, "[^0-9]", "")) >= MIN_DIGITS) & F.rlike(v, F.lit("[A-Za-z]"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs (see common.rows) with found, all matches of each kind in their order, in the text's place: work in proportion to the text, however many there are."""
    text, all_ = F.col("text"), lambda v: F.lit(True)
    found = F.concat(_matches(text, 0, ASSIGN, lambda v: F.length(v) >= 6, 2), _matches(text, 1, ACCESS, all_), _matches(text, 2, HEX, all_), _matches(text, 3, RUN, _live_looking))
    return docs.withColumn("found", found).drop("text")


def place_spans(found: DataFrame) -> DataFrame:
    """found (see find_secrets), with row, which tells documents apart: its other columns, k, s, e, value of each span that counts. Places are running sums over a document's matches;
    a run that overlaps a base span is dropped, for which the furthest end of base spans that start before it, and the nearest start of those after it, are enough."""
    kept = [c for c in found.columns if c != "found"]
    each = found.where(F.size("found") > 0).select(*kept, F.posexplode("found").alias("i", "x")).select(*kept, "i", "x.*").repartition("row")
    each = each.withColumn("e", F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "k").orderBy("i"))).withColumn("s", F.col("e") - F.col("size"))
    each = each.where("value is not null")
    behind = F.max(F.when(F.col("k") < 3, F.col("e"))).over(Window.partitionBy("row").orderBy("s"))
    ahead = F.min(F.when(F.col("k") < 3, F.col("s"))).over(Window.partitionBy("row").orderBy(F.desc("s")))
    free = (F.coalesce("behind", F.lit(0)) <= F.col("s")) & (F.coalesce("ahead", F.col("e")) >= F.col("e"))
    return each.withColumn("behind", behind).withColumn("ahead", ahead).where((F.col("k") < 3) | free).select(*kept, "k", "s", "e", "value")


def _written(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = "source", owner: Column | None = None, max_owners: int = MAX_OWNERS) -> tuple[DataFrame, DataFrame]:
    """(one row per document, one row per candidate hash).

    Documents: doc_id, n_assign, n_access, n_hex, base (text), spans (text), n_live, n_copied: how many of its values are held by at most max_owners owners, or by more.
    Candidates: value_sha256, n_rows, n_repos (distinct repositories), n_owners, shared.
    A candidate run of no known form is added to a document's spans, as `owned`, where it looks live and at most max_owners owners hold it. Null text: empty, no spans.
    A null repository counts as one named ''. The owner is the repository up to its first '/'. Rows that repeat are scanned alike, and ids may be null. An empty table gives none.
    Other columns are ignored.

    Plan: one pass over the texts; what was found goes to the shared folder. Counts go by (hash, repository) before (hash), so a value that a third of all rows hold
    is combined on the map side to one row for each repository. Back at the occurrences it is a join whose skewed side Spark can split.
    """
    repo = F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit("")) if repo_col else F.lit("")
    own = owner if owner is not None else F.substring_index(repo, "/", 1)
    found = find_secrets(rows(docs, id_col, text_col, repo=repo, owner=own))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "found")
    spans = stored(place_spans(found.drop("doc_id")).withColumn("value_sha256", F.sha2("value", 256)).drop("value"), "spans")
    counts = (
        spans.groupBy("value_sha256", "owner", "repo").agg(F.count("*").alias("n"))
        .groupBy("value_sha256", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
        .groupBy("value_sha256").agg(F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
        .withColumn("shared", F.col("n_owners") > max_owners)
    )
    counts = stored(counts, "values")
    marked = spans.select("row", "k", "s", "e", "value_sha256").join(counts.select("value_sha256", "shared"), "value_sha256")
    of = lambda k: F.count_if(F.col("k") == k)
    listed = lambda c: F.collect_list(F.when(c, F.struct("s", "k", "e")))
    per = marked.groupBy("row").agg(
        of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), listed(F.col("k") < 3).alias("base"), listed((F.col("k") < 3) | ~F.col("shared")).alias("spans"),
        F.count_if(~F.col("shared")).alias("n_live"), F.count_if("shared").alias("n_copied"),
    )
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    text = lambda c: F.coalesce(_written(F.col(c)), F.lit("")).alias(c)
    docs_out = found.select("row", "doc_id").join(per, "row", "left").select("doc_id", n("n_assign"), n("n_access"), n("n_hex"), text("base"), text("spans"), n("n_live"), n("n_copied"))
    return docs_out, counts


def op1_secret_scan(spark, sf_dir):
    out, _ = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_copied")
