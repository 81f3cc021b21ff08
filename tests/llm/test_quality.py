import random

from twinsift.llm import quality as Q

DOC = "doc_id long, text string, grade string"


def corpus():
    rng = random.Random(10)
    w = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for d in range(900):
        words = [rng.choice(w) for _ in range(rng.randint(20, 120))]
        grade = rng.choice([0, 1, 2, 2])
        if grade == 0:
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty"])
        if grade == 1:
            words = [x + rng.choice(["###", "$$$"]) for x in words]
        rows.append((d, " ".join(words), "x"))
        labels.append((d, int(grade == 2), int(grade == 0)))
    return rows, labels


def test_quality(spark):
    rows, labels = corpus()
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, "w1 " * 80_000 + "vile", "x"), (None, "w1 w2", None), (3, rows[3][1], "x")]
    docs = spark.createDataFrame(rows, DOC)
    known = spark.createDataFrame(labels[:600] + [(None, 1, 0), (7000, None, None)], "doc_id long, quality int, toxic int")
    got = Q.quality_scores(docs, known).collect()
    assert len(got) == len(rows)
    grade = {d: 0 if t else 1 + q for d, q, t in labels}
    held_out = [r for r in got if r.doc_id is not None and 600 <= r.doc_id < 900]
    assert sum(r.kept == (grade[r.doc_id] == 2) for r in held_out) >= 0.97 * len(held_out)
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_prob <= 1 for r in got)
    assert not next(r for r in got if r.doc_id == 5002).kept
    kept = {r.doc_id for r in Q.keep_good(docs, known).collect()}
    assert kept == {r.doc_id for r in got if r.kept} | {None}
    assert all(r.kept and r.tail_prob is None for r in Q.quality_scores(docs, known.limit(0)).collect())
    assert Q.quality_scores(docs.limit(0), known).count() == 0


def test_thresholds_are_ordered():
    rng = random.Random(1)
    rows = [([rng.randrange(50) for _ in range(8)] + [100 + g] * (rng.random() < 0.9), g) for g in (0, 1, 2) for _ in range(80)]
    weights, b = Q.fit([(list(set(f)), g) for f, g in rows])
    assert b[0] < b[1] and weights[100] < weights.get(101, 0.0) < weights[102]
