"""Each stage of the pipeline on a table with nulls, repeated ids and rows, empty texts, clashing names, and on an empty one, against brute force."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
from helpers import SF
from tokenizers import Tokenizer

from gridloom.llm import common, decontam, minhash

rng = random.Random(9)
EN = "the of and to in that was with for this from they have which one were all there been their said each".split()
DE = "der die und den von das mit sich des auf ist nicht ein eine als auch werden aus hat dass sie nach".split()
CLASH = "id long, digest string, n_words int, n_hit string, items int, row long, lang_pred int, score string, `__row` int, v string"


def _say(words, n):
    return " ".join(rng.choice(words) for _ in range(n))


ITEM = _say([f"quiz{i}" for i in range(40)], 30)
LONG = _say(EN, 4000)
TEXTS = [
    (1, "en", LONG), (2, "en", LONG), (2, "en", LONG), (3, "de", _say(DE, 300)), (3, "en", None), (4, None, ""), (4, None, None), (None, "en", LONG), (None, "de", _say(DE, 200)), (None, None, None),
    (5, "en", LONG.replace(" the ", " a ", 3)), (5, "de", _say(DE, 250)), (6, "en", "   \n"), (7, "en", "1234 5678 ---"), (8, "en", f"{LONG} {ITEM} {LONG}"), (8, "en", _say(EN, 500)), (9, "en", ITEM),
    (10, "en", " ".join(ITEM.split()[:12]) + " " + _say(EN, 300)), (11, "en", " ".join(ITEM.split()[5:18]) + " " + _say(EN, 9000)), (12, "de", _say(DE, 20)), (12, "de", None), (13, "en", "日本語 " * 3), *((20 + i, "en" if i % 2 else "de", _say(EN if i % 2 else DE, 120)) for i in range(30)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, f"s{k}", len(t or ""), k, "d", 1, "2", 3, k, 4, "s", 5, "v") for k, (i, lang, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("items")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def _left(df):
    """Which rows are left, by their number in the list."""
    return sorted(int(r.source[1:]) for r in df.select("source").collect())


def test_stages_keep_columns_and_take_empty_tables(spark, docs, folder):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString()
        none = stage(spark, docs.limit(0), folder)
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_language(spark, docs, folder):
    out = _left(corpus_pipeline.language(spark, docs, folder))
    assert out == [k for k, (_, _, t) in enumerate(TEXTS) if any(c.isalpha() for c in t or "")]
    assert _left(corpus_pipeline.language(spark, docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang = 'x'"), folder)) == []


def test_exact_copies(spark, docs, folder):
    groups = {}
    for i, _, t in TEXTS:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    out = [TEXTS[k] for k in _left(corpus_pipeline.exact_copies(spark, docs, folder))]
    assert sorted((-1 if i is None else i, t or "") for i, _, t in out) == sorted((max(ids), t) for t, ids in groups.items())


def test_exact_copies_with_null_and_empty_under_one_id(spark):
    df = spark.createDataFrame([(5, None), (5, ""), (5, "x"), (None, "x"), (None, "y"), (None, "y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.exact_copies(spark, df, "").collect()) == [(0, "y"), (5, ""), (5, "x")]


def test_near_copies(spark, docs, folder):
    numbered = [(k, t) for k, (i, _, t) in enumerate(TEXTS) if i is not None]
    least = {}
    for k, _, c, _ in minhash.brute(numbered):
        least[c] = min(TEXTS[k][0], least.get(c, TEXTS[k][0]))
    want = [k for k, _, c, _ in minhash.brute(numbered) if TEXTS[k][0] == least[c]] + [k for k, (i, _, _) in enumerate(TEXTS) if i is None]
    assert _left(corpus_pipeline.near_copies(spark, docs, folder)) == sorted(want)


@pytest.mark.parametrize("size", [decontam.BROADCAST_BYTES, 0])
def test_benchmark_passages(spark, docs, folder, size, monkeypatch):
    monkeypatch.setattr(decontam.clean, "__defaults__", (*decontam.clean.__defaults__[:-1], size))
    hit = {k: n for k, _, n, *_ in decontam.brute([(k, t) for k, (_, _, t) in enumerate(TEXTS)], [(1, ITEM)])}
    assert _left(corpus_pipeline.benchmark_passages(spark, docs, folder)) == [k for k in range(len(TEXTS)) if hit[k] == 0]
    assert hit[14] == 30 and hit[18] == 13 and hit[17] == 0


def test_tokens(spark, docs, folder):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, _, x in TEXTS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        raw = b"".join(n.to_bytes(4, "little") for n in ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.tokens(spark, docs, folder).collect()), key=repr) == sorted(want, key=repr)


def test_a_run_leaves_the_last_table_only(spark):
    before = set(common._mine)
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(set(common._mine) - before) == 1


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session())
