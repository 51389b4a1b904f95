"""The pipeline, stage by stage, against plain Python, SQL and brute force, and on awkward tables."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import jaccard, packing, secret_scan, tokens
from tests.llm.test_ops import BASE, components, grams, prose

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def through(spark, docs, tmp_path):
    """What each stage gets and gives."""
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        seen.append((docs, out))
        docs = out
    return seen


def kept_of_groups(ids, texts):
    """The ids that near-duplicate removal leaves, by comparing every pair of sets of word pairs."""
    sets = [grams(t) for t in texts]
    post = {}
    for i, s in enumerate(sets):
        for x in s:
            post.setdefault(x, []).append(i)
    pairs = {q for v in post.values() for q in itertools.combinations(v, 2)}
    linked = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= jaccard.THRESHOLD * len(sets[i] | sets[j])]
    return {min(ids[i] for i in g) for g in components(len(ids), linked).values()}


def least_padding(lengths, buckets):
    """By dynamic programming over all splits of the sorted distinct lengths."""
    n, count = np.unique(lengths, return_counts=True)
    cost = [0, *[10**12] * len(n)]
    for _ in range(buckets):
        cost = [min([cost[j], *(cost[i] + int(((n[j - 1] - n[i:j]) * count[i:j]).sum()) for i in range(j))]) for j in range(len(cost))]
    return cost[-1]


def test_stages(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = docs.filter("lang = 'en'").orderBy("doc_id").first()["text"][::-1][:300] + f' é token = "{KEY}" and {KEY} ' + prose(3, 40)
    junk = spark.createDataFrame([(10_000, "== 42 ==", "en", "s", 8), (10_001, None, None, None, None), (10_002, hidden, "en", "s", len(hidden))], docs.schema)
    seen = [(a.toPandas(), b.toPandas()) for a, b in through(spark, docs.union(junk), tmp_path)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "packing"]
    before, after = seen[0]
    assert set(before.doc_id) - set(after.doc_id) == {10_000, 10_001}
    before, after = seen[1]
    assert set(after.doc_id) == kept_of_groups(before.doc_id.tolist(), before.text.tolist()) < set(before.doc_id)
    before, after = seen[2]
    c = duckdb.connect()
    c.register("kept", before)
    found = c.execute(secret_scan.oracle(table="kept")).df()
    want = {i: t.encode() for i, t in zip(before.doc_id, before.text)}
    for r in found.sort_values("start", ascending=False).itertuples():
        want[r.doc_id] = want[r.doc_id][: r.start] + secret_scan.MASK.encode() + want[r.doc_id][r.end :]
    assert len(found) and dict(zip(after.doc_id, after.text)) == {i: t.decode() for i, t in want.items()}
    assert all(n == len(t) for i, n, t in zip(after.doc_id, after.n_chars, after.text) if i in set(found.doc_id))
    before, after = seen[3]
    n = {i: len(tokens.encoding().encode_ordinary(t)) for i, t in zip(before.doc_id, before.text)}
    assert dict(zip(after.doc_id, after.n_tokens)) == n
    assert after.padding.sum() == least_padding(list(n.values()), packing.BUCKETS) == (after.bucket_len - after.n_tokens).sum()
    for (bucket, _), own in after.groupby(["bucket", "batch"]):
        assert sorted(own.slot) == list(range(len(own))) and own.bucket_len.nunique() == 1
        assert len(own) * own.bucket_len.iloc[0] <= packing.BUDGET or len(own) == 1


def test_stages_on_awkward_rows(spark, tmp_path):
    secret = f"{prose(9, 90)} key={KEY} {prose(10, 20)}"
    rows = [(1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("river", "rivers", 2)), (4, prose(4, 60_000)), (5, ""), (6, None), (None, prose(5, 80)), (7, "12 == !!"), (8, secret), (9, prose(6, 90)), (9, prose(7, 90))]
    rows += [(20 + k, prose(50 + k, 60)) for k in range(20)]
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("__why", "__old", "__id", "why", "gone_id", "old", "group_id", "set_id", "bucket", "x", "accepted", "lead", "comp", "near", "Old"):
        docs = docs.withColumn(c, F.lit("own")) if c not in docs.columns and c != "Old" else docs
    seen = through(spark, docs.repartition(3), tmp_path)
    ids = [sorted(map(str, (r["doc_id"] for r in out.collect()))) for _, out in seen]
    kept = [i for i, t in rows if i not in (5, 6, 7)]
    assert ids[0] == sorted(map(str, kept))
    once = [i for i in kept if i not in (2, 3)]
    assert ids[1] == ids[2] == ids[3] == sorted(map(str, once))
    clean = {r["doc_id"]: r for r in seen[2][1].filter("doc_id is not null").collect()}
    assert clean[8]["text"] == secret.replace(f"key={KEY}", secret_scan.MASK) and clean[8]["n_chars"] == len(clean[8]["text"])
    assert clean[4]["text"] == rows[4][1] and clean[4]["__old"] == "own"
    assert {r["doc_id"]: r["n_tokens"] for r in seen[3][1].collect()}[4] == len(tokens.encoding().encode_ordinary(rows[4][1]))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_is_the_stages(spark):
    a = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    order = ["doc_id"]
    assert a.orderBy(*order).collect() == docs.orderBy(*order).collect()
    assert a.agg(F.countDistinct("doc_id")).first()[0] == a.count()


def test_sql_of_shards_and_secrets(spark):
    duckdb = pytest.importorskip("duckdb")
    from rasterloom.llm import queries

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, SF).toPandas()
        want = c.execute(sql).df()[got.columns]
        keys = list(got.columns)
        assert got.sort_values(keys).reset_index(drop=True).equals(want.astype(got.dtypes.to_dict()).sort_values(keys).reset_index(drop=True)), name
