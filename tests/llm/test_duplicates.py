import hashlib
import random
import re

from pyspark.sql import functions as F

from twinsift.llm.exact_dedup import exact_dedup, keep_first
from twinsift.llm.ngram_join import keep_one, ngram_join

DOC = "doc_id long, text string, keep_id string"


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(rows, n, num, den):
    sets = []
    for d, t in rows:
        w = words(t)
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return in_order((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets))


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x) for x in r])


def test_exact_dedup_edges(spark):
    rows = [(3, "a  b\tc", "x"), (1, "a b c", None), (2, "", "x"), (5, None, "x"), (7, "A b c", "x"), (7, "A b c", "x"), (None, "a b c", "x")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {(3, 1, 3, False), (1, 1, 3, True), (None, 1, 3, False), (2, 2, 2, True), (5, 2, 2, False), (7, 7, 2, True)}
    sha = {r.doc_id: r.text_sha256 for r in exact_dedup(spark.createDataFrame(rows, DOC)).collect()}
    assert sha[3] == hashlib.sha256(b"a b c").hexdigest()
    assert exact_dedup(spark.createDataFrame([], DOC)).count() == 0
    assert sorted(r.doc_id for r in keep_first(spark.createDataFrame(rows[:5], DOC)).collect()) == [1, 2, 7]


def test_exact_dedup_survives_collisions(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "cast(id % 100 AS string) AS text")
    weak = lambda norm: F.substring(norm, 1, 1)
    got = exact_dedup(docs, weak).collect()
    assert len(got) == 300 and all(r.keep_id == r.doc_id % 100 and r.group_size == 3 for r in got)


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 14, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((i, " ".join(t)))
            i += 1
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(i + k, shared + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for k in range(60)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one TWO"), (9004, "ONE two"), (9005, "one two"), (9006, "long " * 20000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], DOC)
    rows += [(8000 + k, " ".join(f"z{(i if i % 900 or i == 0 else i + 10**6 * k)}" for i in range(5000))) for k in range(3)]
    chain = [f"c{i}" for i in range(80)]  # two documents that link only through one without an id, and two without ids alone
    rows += [(9100, " ".join(chain)), (None, " ".join(["y1", "y2", *chain[2:]])), (9101, " ".join(["y1", "y2", *chain[2:-2], "y3", "y4"]))]
    rows += [(None, " ".join(f"q{i}" for i in range(50))), (None, " ".join(f"q{i}" for i in range(51))), (9003, "one TWO")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], DOC)
    for n, num, den in ((4, 85, 100), (5, 80, 100)):
        got = in_order(ngram_join(docs, n, num, den).select("doc_id", "n_shingles", "component_id").collect())
        assert got == brute(rows, n, num, den)


def test_ngram_join_large_buckets_and_edges(spark):
    import twinsift.llm.ngram_join as m

    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows.append((500, " ".join(base)))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], DOC)
    old, m.TILE = m.TILE, 16
    try:
        got = in_order(ngram_join(docs, 4, 60, 100, rounds=0).select("doc_id", "n_shingles", "component_id").collect())
    finally:
        m.TILE = old
    assert got == brute(rows, 4, 60, 100)
    assert ngram_join(spark.createDataFrame([], DOC)).count() == 0
    kept = keep_one(spark.createDataFrame([(1, "a b c", "k"), (2, "a b c", "k"), (3, None, None), (4, None, None)], DOC))
    assert sorted((r.doc_id, r.keep_id) for r in kept.collect() if r.doc_id < 3) == [(1, "k")] and kept.count() == 3
