"""Held-out accuracy on the given tables, and the pipeline against its parts."""

import pytest
from helpers import plain, same

from gridloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality(spark, tables):
    out = queries.QUERIES["op5_quality"](spark, SF).where("held_out").join(tables[1], "doc_id")
    rows = out.collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_toxicity(spark, tables):
    rows = queries.QUERIES["op8_toxicity"](spark, SF).where("held_out").join(tables[1], "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def test_language(spark, tables):
    rows = queries.QUERIES["op6_language"](spark, SF).where("held_out").join(tables[0].select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


@pytest.mark.parametrize("name", ["op1_secret_scan", "op7_exact_dedup"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as from '{SF}/documents.parquet'")
    same(queries.QUERIES[name](spark, SF), con, queries.SQL[name])


def test_pipeline(spark, tables):
    """Against the parts by other means: all have a language, and the last stages by brute force on what is left."""
    import corpus_pipeline as p
    import public_tokenizers
    from tokenizers import Tokenizer

    from gridloom.llm import decontam, minhash

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    left = {}
    for i, t in rows:
        if any(c.isalpha() for c in t or ""):
            left[t] = max(i, left.get(t, i))
    rows = sorted((i, t) for t, i in left.items())
    kept = {r[0] for r in minhash.brute(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in decontam.brute(rows, items) if r[5]}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(i, len(t.encode(x, add_special_tokens=False).ids)) for i, x in rows if i not in bad]
    assert plain(p.run(spark, sf).select("doc_id", "n_tokens").collect()) == plain(want)
