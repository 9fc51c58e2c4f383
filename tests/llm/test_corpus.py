"""The classifier, the pipeline and the registered queries."""

import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from deltaloom.llm import registry, toxicity

from .conftest import prose


def labelled(n, seed=0):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = prose(2000 + i, int(rng.integers(20, 120))).split()
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(2):
                words[int(rng.integers(len(words)))] = str(rng.choice(["vilename", "vilething", "vileword"]))
        docs.append((i, " ".join(words), "en" if i % 3 else "de"))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled(700)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = toxicity.classify(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out]
    assert 100 < len(held) < 250
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    # Labels of held-out rows are never read.
    import zlib

    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    again = toxicity.classify(frame, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert {r.doc_id: r.score for r in rows} == {r.doc_id: r.score for r in again}


def test_repeated_rows_are_fitted_once(spark):
    docs, labels = labelled(120)
    # The repeated id is fitted, not held out.
    k = next(i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 in (0, 1))
    schema, label_frame = "doc_id long, text string, lang string", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = toxicity.fit_on(spark.createDataFrame(docs, schema), label_frame)
    many = toxicity.fit_on(spark.createDataFrame(docs + [docs[k]] * 60, schema), label_frame)
    assert (one.scale, one.shift, one.by_lang) == (many.scale, many.shift, many.by_lang)


def test_texts_of_one_id_are_bounded(spark):
    docs, labels = labelled(120)
    schema, label_frame = "doc_id long, text string, lang string", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    k = next(i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 in (0, 1))
    many = spark.createDataFrame(docs, schema).unionByName(spark.range(100_000).selectExpr(f"{k}L AS doc_id", "concat('other ', id) AS text", "'en' AS lang"))
    net = toxicity.fit_on(many, label_frame)
    assert net.constant is None
    # Bytes bound the sample too: without room nothing is fitted.
    assert toxicity.fit_on(many, label_frame, max_bytes=10).constant == 0.0


def brute_score(net, words, ids):
    """The network by its definition: every filter at every place, then its maximum."""
    x = [np.zeros(toxicity.DIM)] if not len(ids) else []
    for i in ids:
        own = words.flat[words.ends[i - 1] : words.ends[i]]
        x.append(sum(net.embed[b].astype(float) for b in own) / np.sqrt(len(own)))
    x += [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
    n, out = len(x) - max(toxicity.WIDTHS) + 1, net.out_bias
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            top = max(sum(float(x[i + o] @ net.convs[k][o][:, f]) for o in range(w)) for i in range(n))
            out += max(0.0, top + float(net.bias[k * toxicity.FILTERS + f])) * float(net.out[k * toxicity.FILTERS + f])
    return out


def test_forward_pass_by_definition():
    rng = np.random.default_rng(4)
    net = toxicity.Network.fresh(3)
    net.bias[:] = rng.normal(0, 0.1, len(net.bias))
    net.out[:] = rng.normal(0, 1, len(net.out))
    scorer = toxicity.Scorer(net)
    texts = ["", None, "one", "one two", *(prose(60 + k, int(rng.integers(3, 40))) for k in range(8))]
    got = scorer.raw(texts)
    assert np.allclose(got, [brute_score(net, scorer.words, scorer.words.rows(t)) for t in texts], atol=1e-4)


def test_toxicity_of_edge_rows(spark, edge, empty):
    docs, labels = labelled(80)
    label_frame = spark.createDataFrame([(k % 15 + 1, 1, k % 2) for k in range(30)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(edge, label_frame).collect()
    assert len(rows) == edge.count() and all(r.score is not None for r in rows)
    assert toxicity.classify(empty, label_frame).count() == 0
    none = toxicity.classify(edge, label_frame.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


def test_cut_is_the_best_operating_point():
    scores, labels = np.array([0.9, 0.8, 0.7, 0.2, 0.1]), np.array([1, 1, 0, 0, 0])
    assert 0.7 < toxicity.best_cut(scores, labels) < 0.8


def test_stages_chain_and_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        left = docs.count()
        assert 0 < left <= n
        n = left
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset"} <= set(packed.columns) and packed.select("doc_id").distinct().count() == n


def test_pipeline_stages_take_edge_rows(spark, edge, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, sf_dir)
        assert out.count() > 0, name


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_queries_run(spark, sf_dir, name):
    assert __spark_entry__.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, sf_dir)
    assert sorted(map(repr, (tuple(r) for r in got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))
