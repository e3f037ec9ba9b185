"""Vectors, shards, archives, severity and the pipeline; queries with SQL against DuckDB."""

import base64
import hashlib
import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from evidq.llm import sharding, toxicity, warc
from evidq.llm.ann import nearest
from evidq.llm.components import connected_components


@pytest.mark.parametrize("name", ["op3_line_dedup", "op4_sharding", "op5_warc"])
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, expect = entry.queries()[name](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    plain = lambda f: sorted((tuple(None if pd.isna(x) else x for x in r) for r in f[sorted(expect.columns)].itertuples(index=False)), key=str)
    assert plain(got) == plain(expect)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    odd = [(5000, None, ""), (5020, [0.0] * 16, ""), (5040, [float("nan")] * 16, ""), (5060, [1.0, None] * 8, ""), (5080, [1.0], ""), (None, [1.0] * 16, "")]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    got = nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20).toPandas()
    assert sorted(got["query_id"].unique()) == list(range(0, 3000, 20))
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        assert list(part["rank"]) == list(range(1, 21)) and np.allclose(part["score"], s[part["vec_id"]], rtol=1e-12)
        assert list(part["vec_id"]) == sorted(part["vec_id"], key=lambda v: (-part.set_index("vec_id")["score"][v], v))
        hits += len(set(part["vec_id"]) & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
    assert hits >= 0.95 * 20 * 150
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert nearest(few.limit(0), few.limit(0)).collect() == []


def test_sharding(spark):
    names = ["a", "b", "c"]
    table = {r.slot: r.shard for r in sharding.lookup_table(spark, names, 31).collect()}
    part = lambda s, at: int(hashlib.md5(s.encode()).hexdigest()[at : at + 8], 16)
    owner, turn = {}, 0
    while len(owner) < 31:
        name = names[turn % 3]
        slot = next(p for p in ((part(name, 0) % 31 + k * (part(name, 8) % 30 + 1)) % 31 for k in range(31)) if p not in owner)
        owner[slot], turn = name, turn + 1
    assert table == owner
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, slot string")
    got = sharding.shard(df, "k", sharding.lookup_table(spark, names, 31), 31).collect()
    assert sorted(r.slot for r in got) == sorted(part(k, 0) % 31 for k in ("1", "1", ""))
    assert all(r.shard == owner[r.slot] for r in got)
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, 30)


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/1", big, "x"), (2, None, big, "x"), (3, "http://a/ 3", None, "x"), (4, "u", "", "x"), (5, "u", "small\r\n\r\nWARC/1.1\r\n", "x"), (6, "ü", "small", "x")]
    rows += [(7, "u", "same id", "x"), (7, "u", "same id", "x"), (None, "u", big, "x"), (None, "u", "lone " * 300, "x")]
    headers, payloads = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string, payload string"))
    assert payloads.count() == 6
    whole = warc.records(headers, payloads)
    warc.export(whole, str(tmp_path / "warc"), rows=3)
    key = lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes)
    out = [sorted(warc.parsed(f).collect(), key=key) for f in (whole, warc.load(spark, str(tmp_path / "warc")))]
    assert out[0] == out[1] and len(out[0]) == len(rows)
    got = {r.page_id: r for r in out[0][:8]}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2)} | {i: ("response", None) for i in range(2, 8)}
    assert [(r.record_type, r.refers_to) for r in out[0][8:]] == [("revisit", 2), ("response", None)]
    for i, _, html, _ in rows[:7]:
        data = (html or "").encode()
        assert got[i].payload == (None if i == 1 else data) and (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    record = next(bytes(r.record) for r in whole.collect() if b"page:2>" in bytes(r.record) and b"response" in bytes(r.record))
    digest = base64.b32encode(hashlib.sha1(big.encode()).digest())
    assert record.endswith(b"Content-Length: 1200\r\n\r\n" + big.encode() + b"\r\n\r\n") and b"WARC-Payload-Digest: sha1:" + digest in record
    damaged = payloads.withColumn("payload", F.concat("payload", F.lit(b"x")))
    with pytest.raises(Exception, match="damaged"):
        warc.records(headers, damaged).collect()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.parsed(warc.records(*warc.archive(empty))).collect() == []


def test_toxicity_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    scored = toxicity.severity(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert ((scored["toxic"] > 0) == scored["rejected"]).mean() > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (1, None, "x")], "doc_id long, text string, grade string")
    assert [r.rejected for r in toxicity.severity(odd, model).collect()] == [False] * 3
    assert toxicity.reject_toxic(odd, model).columns == odd.columns


def test_severity_by_hand(spark):
    """Scores, thresholds and grades of long, empty, tied and repeated texts against the formula, word by word."""
    import xxhash

    rng = np.random.default_rng(4)
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    weights[rng.integers(0, 1 << toxicity.BITS, 200_000)] = rng.normal(size=200_000)
    model = toxicity.Model(weights, np.array([0.2, 0.9, 1.5]))
    names = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(names, n)) for n in (1, 2, 5, 9, 40, 20_000)] + ["", None, "W1 w1, w1!", "w1", "ÄÖ ß 日本 w2"]
    rows = [(i, x, "x") for i, x in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[2], "x")]
    got = toxicity.severity(spark.createDataFrame(rows, "doc_id long, text string, grade string"), model).collect()

    def expect(text):
        found = {w for w in re.findall(r"[^\W_]+", (text or "").lower())}
        at = {(xxhash.xxh64(w.encode(), seed=42).intdigest() - (1 << 64) * (xxhash.xxh64(w.encode(), seed=42).intdigest() >> 63)) % (1 << toxicity.BITS) for w in found}
        p = [1 / (1 + math.exp(t - sum(float(weights[i]) for i in at))) for t in model.thresholds]
        return sum(p), p[0], sum(x > 0.5 for x in p)

    assert len(got) == len(rows)
    for r in got:
        text = texts[2] if r.doc_id is None else texts[r.doc_id]
        severity, p, grade = expect(text)
        assert (r.expected_severity, r.p_toxic) == (pytest.approx(severity, abs=1e-6), pytest.approx(p, abs=1e-6)) and (r.grade, r.rejected) == (grade, grade >= 1)
    assert {r.grade for r in got} >= {0, 3}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.severity(empty, model).collect() == [] and toxicity.reject_toxic(empty, model).collect() == []


def test_fit_is_a_minimum():
    """No weight or threshold of the fit can be moved for a better penalised likelihood, but for a little."""
    rng = np.random.default_rng(5)
    n = 600
    rows, cols = np.repeat(np.arange(n), 3), rng.integers(0, 12, 3 * n)
    truth = rng.normal(size=12) * 1.5
    score = np.bincount(rows, truth[cols], n) + rng.logistic(size=n)
    grades = (score[:, None] > np.quantile(score, [0.5, 0.75, 0.9])[None, :]).sum(1)
    model = toxicity.fit(rows, cols, grades, l1=1e-3)
    assert (np.diff(model.thresholds) > 0).all()

    def loss(w, t):
        s = np.bincount(rows, w[cols], n)
        p = np.hstack([np.ones((n, 1)), 1 / (1 + np.exp(t[None, :] - s[:, None])), np.zeros((n, 1))])
        return -np.log(np.maximum(p[np.arange(n), grades] - p[np.arange(n), grades + 1], 1e-12)).mean() + 1e-3 * np.abs(w).sum()

    w, t = model.weights.astype(float), model.thresholds
    best = loss(w, t)
    for i in range(12):
        for d in (-0.1, 0.1):
            v = w.copy()
            v[i] += d
            assert loss(v, t) > best - 1e-3
    for i in range(3):
        for d in (-0.1, 0.1):
            v = t.copy()
            v[i] += d
            assert loss(w, v) > best - 1e-3


def test_components(spark):
    """Chains, stars and random edges, loops and null ends, against union by hand."""
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(400)] + [(1000 + i, 1000) for i in range(1, 300)] + [tuple(map(int, x)) for x in rng.integers(2000, 2400, (300, 2))] + [(None, 1), (7, 7)]
    root: dict = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    frame = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.component for r in connected_components(frame).collect()} == {i: find(i) for i in root}
    assert connected_components(frame.limit(0)).collect() == []


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls, empty texts, repeated rows and further columns go through every stage; extra columns are left out."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, hash long"
    rows = [(1, None, None, None, None, "x", True, 1), (2, "", "en", "s", 0, "x", None, 2), (None, "no id but a few words", "en", "s", 3, "x", None, 3)]
    rows += [(4, "a plain text of a few words", "en", "s", 27, "x", None, 4)] * 2
    for frame in (spark.createDataFrame(rows, columns), spark.createDataFrame([], columns)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == corpus_pipeline._COLUMNS, name
            docs = corpus_pipeline.stored(docs, name)
            assert docs.count() == (len(rows) if frame.count() else 0)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert packed.count() == docs.count()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns and docs.count() <= rows
        rows = docs.count()
    assert rows > 50
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == rows
