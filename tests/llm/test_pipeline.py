"""The pipeline's stages against plain Python on a small corpus, and against its own operators' rules on the given tables."""

import random

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from twinsift.llm import decontaminate, quality
from twinsift.llm.sentencepiece_codec import Pieces

from test_duplicates import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(tmp_path, spark):
    rng = random.Random(12)
    w = [f"w{int(rng.expovariate(0.01))}" for _ in range(4000)]
    pick = lambda k: [rng.choice(w) for _ in range(k)]
    items = [(i, " ".join(pick(20)) + ". " + " ".join(pick(6)) + ".") for i in range(12)]
    texts, labels = [], []
    for d in range(420):
        t = pick(rng.randint(30, 90))
        kind = d % 7
        if kind == 1:
            t[rng.randrange(len(t))] = rng.choice(["vile", "nasty"])
        elif kind == 2:
            t = [x + "###" for x in t]
        elif kind == 3 and texts:
            t = texts[rng.randrange(len(texts))].split(" ")
        elif kind == 4 and texts:
            t = texts[rng.randrange(len(texts))].split(" ")
            t[0] = "start"
        elif kind == 5 and d % 2:
            t[5:5] = rng.choice(items)[1].split(" ")
        texts.append(" ".join(t))
        bad = any(x in t for x in ("vile", "nasty"))
        labels.append((d, int(not bad and "###" not in texts[-1]), int(bad)))
    rows = [(d, t, "en", "s", len(t)) for d, t in enumerate(texts)] + [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, labels, items


def test_stages(spark, tmp_path):
    rows, labels, items = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = {}
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, docs, str(tmp_path))
        if name != names[-1]:
            assert after.schema.simpleString() == docs.schema.simpleString()
            after.write.parquet(f"{tmp_path}/{len(out)}")
            docs = spark.read.parquet(f"{tmp_path}/{len(out)}")
            out[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        else:
            out[name] = {r.doc_id: r.ids for r in after.collect()}
    good = {d for d, q, _ in labels if q}
    assert len(out[names[0]] & good) >= 0.98 * len(good) and len(out[names[0]] - good - {1000, 1001}) <= 3
    kept = sorted(out[names[0]])
    first = {}
    for d in kept:
        first.setdefault(" ".join((text[d] or "").split(" ")), d)
    assert out[names[1]] == set(first.values())
    want = brute([(d, text[d]) for d in sorted(out[names[1]])], 5, 80, 100)
    assert out[names[2]] == {d for d, _, c in want if d == c}
    known = decontaminate.Items(items, 5)
    known.weigh({}, 1)
    holds = lambda t: any(all(sum(g in {*decontaminate.grams(decontaminate.words(t), len(g))} for g in gs) >= 0.8 * len(gs) for gs in x if gs) for x in known.of.values())
    assert out[names[3]] == {d for d in out[names[2]] if not holds(text[d] or "")}
    pieces = Pieces(P.path("piece_bpe_32k.model"))
    assert set(out[names[4]]) == out[names[3]]
    import numpy as np

    assert all(pieces.decode(np.array(ids)) == (text[d] or "") for d, ids in out[names[4]].items())


def test_run_is_all_stages(spark, tmp_path):
    corpus(tmp_path, spark)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "ids", "round_trip"] and got.filter("NOT round_trip").count() == 0 and got.count() > 50


def test_quality_on_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    even = labels.filter("doc_id % 2 = 0")
    got = quality.quality_scores(docs, even).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    n = got.agg(F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("toxic") == 1, F.col("kept").cast("int"))).alias("toxic")).first()
    assert n.good > 0.95 and n.toxic < 0.6
