"""Classifiers on held-out folds and odd rows; the pipeline against its stages by brute force."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from strider.llm import bpe, queries, quality, sharding, stages, toxicity
from strider.llm.common import shared_dir

ODD = [(9001, None), (9002, ""), (9003, "word"), (None, "null id"), (9004, "x" * 60_000), (9004, "x" * 60_000)]
CLASH = "doc_id long, text string, score double, raw string, x string, y double, fold int, p int"


def corpus(n, seed=1):
    """Prose and junk, some of it with abusive words; quality and toxic labels for two thirds."""
    rng, docs, labels = random.Random(seed), [], []
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    for d in range(n):
        good, toxic = rng.random() < 0.8, rng.random() < 0.2
        body = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(["nastyone", "vilest", "rotter", "rotters"]))
        text = ". ".join(" ".join(body[k : k + 9]).capitalize() for k in range(0, len(body), 9)) if good else " | ".join(body).upper()
        docs.append((d, text))
        if d % 3:
            labels.append((d, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(1500)
    frame = spark.createDataFrame([(*r, 0.0, "", "", 0.0, 0, 0) for r in docs + ODD], CLASH)
    return frame, spark.createDataFrame([*labels, (None, 1, 1), (1, None, None), labels[0]], "doc_id long, quality int, toxic int"), labels


def test_quality_on_the_held_out_fold(tables):
    docs, labels, truth = tables
    got = {r.doc_id: r.score for r in quality.scores(docs, quality.fit(docs, labels)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 1500 + 5
    held = [(d, q) for d, q, _ in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([(got[d] >= 0.3) == bool(q) for d, q in held]) > 0.97


def test_quality_without_labels_and_documents(tables):
    docs, labels, _ = tables
    model = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scores(docs, model).collect()} == {0.5}
    assert quality.scores(docs.limit(0), quality.fit(docs, labels)).count() == 0


def test_normal_equations_are_those_of_the_whole_sample(tables):
    docs, labels, _ = tables
    model = quality.fit(docs, labels)
    rows = quality._statistics_table(quality._texts(docs, "doc_id", "text")).join(labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y")), "doc_id").withColumn("fold", quality.held_out()).where("fold BETWEEN 1 AND 3").collect()
    z, y = model.features(np.array([r.x for r in rows])), np.array([r.y for r in rows], float)
    penalty = np.eye(z.shape[1]) * max(quality.RIDGE * len(z), 1e-6)
    penalty[-1, -1] = 1e-9
    assert np.allclose(np.linalg.solve(z.T @ z + penalty, z.T @ y), model.ridge, atol=1e-6)


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(3)
    d = len(quality._NAMES)
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(0, 1 / np.sqrt(d), (d, 20_000)), rng.uniform(0, 2 * np.pi, 20_000), np.zeros(20_001), (np.zeros(0),) * 2)
    a, b = rng.normal(size=(2, d))
    z = model.features(np.stack([a, b]))[:, :-1]
    assert abs(z[0] @ z[1] - np.exp(-((a - b) ** 2).sum() / (2 * d))) < 0.03


def test_isotonic_pools_violators_and_ties():
    x, y = quality.isotonic(np.array([1, 2, 3, 4, 4.0]), np.array([0, 1, 0, 1, 0.0]))
    assert list(y) == sorted(y) and abs(float(y[-1]) - 0.5) < 1e-9 and len(x) == len(y)
    assert len(quality.isotonic(np.zeros(0), np.zeros(0))[0]) == 0


def test_toxicity_on_the_held_out_fold(tables):
    docs, labels, truth = tables
    got = {r.doc_id: r.score for r in toxicity.scores(docs, toxicity.fit(docs, labels)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 1500 + 5
    held = [(d, t) for d, _, t in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert np.mean([(got[d] >= 0.7) == bool(t) for d, t in held]) > 0.95
    assert got[9001] == got[9002] < 0.7


def test_toxicity_without_positives(tables):
    docs, labels, _ = tables
    assert {r.score for r in toxicity.scores(docs, toxicity.fit(docs, labels.withColumn("toxic", F.lit(0)))).collect()} == {0.0}
    assert toxicity.scores(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def dense(rows):
    x = np.zeros((rows.n, rows.width))
    x[rows.row, rows.col] = 1
    return x


def pu_rows(seed, n_p=40, n_u=200, width=30):
    rng = np.random.default_rng(seed)
    one = lambda k, some: toxicity.Rows([rng.choice(some, rng.integers(0, 6), replace=False).tolist() for _ in range(k)], width)
    return one(n_p, 12), one(n_u, width)


def test_risk_and_gradient_equal_numeric_ones():
    """Both terms by their definition, row by row; the gradient by differences, on both sides of the cut."""
    seen = set()
    for seed in range(12):
        p, u = pu_rows(seed)
        rng = np.random.default_rng(seed + 100)
        w, b, prior = rng.normal(0, 1 + seed / 2, p.width), rng.normal(), [0.05, 0.4, 0.8][seed % 3]

        def terms(x):
            loss = lambda g: np.mean([np.log1p(np.exp(-v)) if v > -30 else -v for v in g])
            gp, gu = dense(p) @ x[:-1] + x[-1], dense(u) @ x[:-1] + x[-1]
            return prior * loss(gp), loss(-gu) - prior * loss(-gp)

        x = np.append(w, b)
        assert np.allclose(toxicity.risk(p, u, prior, w, b), terms(x))
        first, rest = terms(x)
        # below zero the step climbs the second term again
        follow = (lambda y: sum(terms(y))) if rest >= 0 else (lambda y: -terms(y)[1])
        numeric = [(follow(x + e) - follow(x - e)) / 2e-5 for e in np.eye(len(x)) * 1e-5]
        assert np.allclose(toxicity.gradient(p, u, prior, w, b), numeric, atol=1e-6)
        seen.add(rest >= 0)
    assert seen == {True, False}


def test_training_equals_a_dense_version():
    p, u = pu_rows(5)
    w, b = toxicity.train(p, u, 0.3, steps=60)
    x, m, v = np.append(np.zeros(p.width), -1.0), 0, 0
    xp, xu = np.c_[dense(p), np.ones(p.n)], np.c_[dense(u), np.ones(u.n)]
    s = lambda g: 1 / (1 + np.exp(-g))
    for t in range(1, 61):
        gp, gu = xp @ x, xu @ x
        rest = xu.T @ s(gu) / u.n - 0.3 * xp.T @ s(gp) / p.n
        g = -0.3 * xp.T @ s(-gp) / p.n + rest if np.log1p(np.exp(gu)).mean() >= 0.3 * np.log1p(np.exp(gp)).mean() else -rest
        g += 1e-4 * np.append(x[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(np.append(w, b), x, atol=1e-9)


def test_kept_features_and_scores_equal_brute_force(tables):
    """Everything from labels to scores again, with plain sets over the training rows."""
    docs, labels, truth = tables
    model = toxicity.fit(docs, labels, kept=25)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = {d: t for d, _, t in truth if zlib.crc32(str(d).encode()) % 3 != 1}
    found = {d: toxicity.features_of(text[d]) for d in rows}
    pos = [d for d in rows if rows[d]]
    told = []
    for f in set().union(*(found[d] for d in pos)):
        in_p, in_u = sum(f in found[d] for d in pos), sum(f in x for x in found.values())
        times = (in_p + 0.5) / (len(pos) + 1) / ((in_u + 0.5) / (len(rows) + 1))
        if times >= toxicity.RATIO:
            told.append((-round(in_p * np.log(times), 9), f))
    best = [f for _, f in sorted(told)[:25]]
    assert set(model.index) == set(best)
    number = model.index
    make = lambda ids: toxicity.Rows([sorted(number[f] for f in found[d] if f in number) for d in ids], len(number))
    w, b = toxicity.train(make(pos), make(list(rows)), len(pos) / len(rows))
    assert np.allclose(w, model.weights, atol=1e-6) and abs(b - model.bias) < 1e-6
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    for d in list(text)[:200]:
        want = 1 / (1 + np.exp(-(sum(w[number[f]] for f in toxicity.features_of(text[d]) if f in number) + b)))
        assert abs(got[d] - want) < 1e-6


def test_two_positives_give_a_model(spark):
    """Also one; a score tells texts with the toxic word from others."""
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 != 1]
    for n in (1, 2):
        docs = spark.createDataFrame([(d, f"plain words number {d} " + ("nastyone" if k < n else "fine")) for k, d in enumerate(ids)] + [(9000, "a nastyone again"), (9001, "plain words")], "doc_id long, text string")
        labels = spark.createDataFrame([(d, int(k < n)) for k, d in enumerate(ids)], "doc_id long, toxic int")
        got = {r.doc_id: r.score for r in toxicity.scores(docs, toxicity.fit(docs, labels)).collect()}
        assert got[9000] > 0.5 > got[9001]


def test_negative_risk_is_climbed_back():
    """With few positives that a classifier can tell apart at will, the risk of unlabelled text does not fall far below zero."""
    rng = np.random.default_rng(1)
    rows = lambda n: toxicity.Rows([rng.choice(400, 6, replace=False).tolist() for _ in range(n)], 400)
    p, u = rows(30), rows(300)
    w, b = toxicity.train(p, u, 0.3)
    rest = np.logaddexp(0, u.times(w) + b).mean() - 0.3 * np.logaddexp(0, p.times(w) + b).mean()
    assert rest > -0.1


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = sorted((d, t) for d, t in texts.items() if model.score(np.array([quality.statistics(t.encode())]))[0] >= 0.3)
    from strider.llm import decontam
    from tests.llm.test_pair_ops import slow_fingerprint, slow_lines, slow_nearest, union

    gone, _ = slow_lines(good)
    lines = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in good}
    prints = {d: slow_fingerprint(t) for d, t in lines.items()}
    root = union([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3], prints)
    kept = {d: t for d, t in lines.items() if root[d] == d}
    items = [decontam.words_of(r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 3]) for w in items for k in range(len(w) - 2)}
    clean = {}
    for d, t in kept.items():
        w = decontam.words_of(t.encode())
        near = any(tuple(w[k : k + 3]) in grams for k in range(len(w) - 2))
        if not near or not any(slow_nearest(i, w) <= decontam.edits(len(i)) for i in items):
            clean[d] = t
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)._ranks, special_tokens={})
    assert set(got) == set(clean)
    for d, t in clean.items():
        ids = own.encode_ordinary(t)
        assert (got[d].n_tokens, got[d].decoded_sha256) == (len(ids), hashlib.sha256(t.encode()).hexdigest())


CLASHING = ["score", "__score", "lines", "gone", "Gone_", "__id", "__own", "__gone_at", "id", "own", "gone_at", "other", "leak", "__leaked", "fp", "component_id"]


def test_stages_keep_columns_their_values_and_odd_rows(spark, sf_dir):
    extra = {c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in ODD], docs.schema)
    rows = docs.unionByName(odd).withColumns(extra)
    for some in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, sf_dir)
            assert out.columns == rows.columns, name
            got = out.collect()
            assert len(got) <= 36, name
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in got for c in CLASHING), name


def test_shards_keep_clashing_columns(spark):
    names = ["h", "id", "key", "piece", "first", "__h", "__id", "__piece", "__first", "below"]
    docs = spark.createDataFrame([(k, f"text {k}", "old") for k in range(20)], "doc_id long, text string, shard string").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    got = sharding.shard(docs, 3).collect()
    assert len(got) == 20 and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names) and {r.shard for r in got} == {0, 1, 2}


def test_no_stage_folder_is_left_but_the_last(spark, sf_dir):
    files = lambda: {n for n in os.listdir(f"{shared_dir(spark).removeprefix('file:')}/strider") if n.startswith("pipeline-")}
    os.makedirs(f"{shared_dir(spark).removeprefix('file:')}/strider", exist_ok=True)
    before = files()
    corpus_pipeline.run(spark, sf_dir)
    assert {n.rsplit("-", 1)[0] for n in files() - before} == {"pipeline-decontaminate"}


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    assert stages.LEAST_QUALITY == 0.3
