"""SQL counterparts over a driver table, and the pipeline's stages against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
from helpers import connect, same
from test_near_copies import brute
from test_operators import brute_lines, brute_overlaps

import corpus_pipeline
from wordloom.llm import packing, registry, toxicity


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf).toPandas(), connect(sf).execute(registry.ORACLE_SQL[name]).df())


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
        assert k == 4 or docs.columns == start.columns
    texts = [{r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in [start, *kept[:4]]]
    # toxicity: exactly the documents of high score go
    scores = {r["doc_id"]: r["score"] for r in toxicity.op5_toxicity(spark, sf).collect()}
    assert texts[1] == {i: t for i, t in texts[0].items() if scores[i] < 0.7} and len(texts[1]) < len(texts[0])
    # line dedup
    want = {i: h for i, _, _, h in brute_lines(list(texts[1].items()), 10, False)}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts[2].items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept[1].collect())
    # one document of each group
    ids = sorted(texts[2])
    groups = defaultdict(list)
    for i, r in zip(ids, brute([texts[2][i] for i in ids]), strict=True):
        groups[r].append(i)
    assert sorted(texts[3]) == sorted(min(g) for g in groups.values()) and len(texts[3]) < len(texts[2])
    # no benchmark window is left, and all clean documents are
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    ids = sorted(texts[3])
    assert sorted(texts[4]) == [i for i, (_, hit, _) in zip(ids, brute_overlaps([texts[3][i] for i in ids], items), strict=True) if not hit]
    # packing: each document once, whole
    sums = Counter()
    for r in kept[4].collect():
        sums[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert sorted(i for i, _ in sums) == sorted(texts[4]) and all(n == total for (_, total), n in sums.items())
    run = corpus_pipeline.run(spark, sf)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, run.select(*cols).collect())) == Counter(map(tuple, kept[4].select(*cols).collect()))
    assert packing.SIZE == 4096


def awkward(spark):
    """Nulls in any column, ties, repeats, an empty and a very long text, a column with a name that stages use."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, None), (3, long, "en", "s", len(long), "b"), (3, long, "en", "s", len(long), "b"), (4, "same id one", "en", "s", 11, "c"), (4, "same id two", "en", "s", 11, "c"), (None, "no id here", "de", None, 10, "d"), (None, "no id here", "de", None, 10, "d")]
    rows += [(5 + i, "a repeated row\nof two lines", "en", "s", 27, "e") for i in range(4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string")


def test_pipeline_edges(spark, sf, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs, seen = awkward(spark), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        assert k == 4 or docs.columns == awkward(spark).columns
    assert seen[0].count() == seen[1].count() == 12
    near = Counter((r["doc_id"], r["text"] and r["text"][:12]) for r in seen[names.index("near dedup")].collect())
    assert near == Counter([(1, None), (3, "w0x0 w1x1 w2"), (4, "same id one"), (4, "same id two"), (None, "no id here"), (5, "a repeated r")])
    packed = seen[4].collect()
    assert sum(r["doc_tokens"] for r in packed if r["start"] == 0) == sum(r["length"] for r in packed)
    empty = awkward(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
