"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (poor) and 2 (good). One weight for each hashed feature of the text is shared by all grades, with ordered
thresholds: P(grade > k) = sigmoid(w.x - b_k). The fit uses a bounded sample of labelled rows (by hash of the id, so
it is the same everywhere); scoring reads every document whole. Features: distinct words; distinct strings of symbols;
steps of a few shares (symbols, repeated words, repeated lines, capitals). Keys are 64-bit hashes; those that fewer than
min_df sampled texts have, or whose texts' grades are distributed much as all are (chi-squared below least_chi2), get no weight: the model is
small, and words that tell nothing count for nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_hash = xxhash.xxh3_64_intdigest
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_NOT_SYMBOLS = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
GRADES = 3


def features(text: str | None) -> list[int]:
    """Hashes of the text's features, each once."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w, s, n = raw.translate(_WORDS).split(), raw.translate(None, _NOT_SYMBOLS).split(), max(1, raw.count(b" ") + raw.count(b"\n") + 1)
    distinct, lines = set(w), [x for x in raw.split(b"\n") if x]
    out = list(map(_hash, distinct))
    out += [_hash(b"symbols " + x[:8]) for x in set(s)]
    step = lambda name, x: out.extend(_hash(f"{name}>{k}".encode()) for k in range(1, 10) if x * 10 >= k)
    step("symbols", len(s) / n)
    step("capitals", sum(map(raw.count, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / max(1, len(raw)) if raw.isupper() or raw[:1].isupper() else 0.0)
    step("repeats", 1 - len(distinct) / len(w) if w else 1.0)
    step("lines", 1 - len(set(lines)) / len(lines) if lines else 0.0)
    if len(w) < 5:
        out.append(_hash(b"short"))
    return out


def fit(rows: list[tuple[np.ndarray, int]], min_df: int = 6, least_chi2: float = 30.0, steps: int = 300, l2: float = 1e-5) -> tuple[dict[int, float], np.ndarray]:
    """(weights, thresholds) by maximum likelihood (Adam); rows: features and grade."""
    col = np.concatenate([np.asarray(x, np.uint64) for x, _ in rows])
    keys, count = np.unique(col, return_counts=True)
    y = np.array([g for _, g in rows])
    doc = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    seen = np.bincount(np.searchsorted(keys, col) * GRADES + y[doc], minlength=len(keys) * GRADES).reshape(-1, GRADES)
    expected = np.maximum(count[:, None] * np.bincount(y, minlength=GRADES) / len(y), 1e-9)
    keys = keys[(count >= min_df) & (((seen - expected) ** 2 / expected).sum(axis=1) >= least_chi2)]
    at = np.minimum(np.searchsorted(keys, col), max(0, len(keys) - 1))
    has = keys[at] == col if len(keys) else np.zeros(len(col), bool)
    doc, at = doc[has], at[has]
    theta = np.zeros(len(keys) + GRADES - 1)
    share = np.clip([(y > k).mean() for k in range(GRADES - 1)], 0.01, 0.99)
    theta[-2:] = -np.log(share / (1 - share))
    theta[-1] = np.log(max(1e-2, theta[-1] - theta[-2]))  # thresholds are b0 and b0 + exp(gap): they stay ordered
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        z = np.bincount(doc, theta[:-2][at], len(rows))
        b = np.array([-np.inf, theta[-2], theta[-2] + np.exp(theta[-1]), np.inf])
        up, down = sig(z - b[y]), sig(z - b[y + 1])  # P(grade >= y), P(grade > y)
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        dz = d_up - d_down
        db = np.bincount(y, -d_up, GRADES + 1)[: GRADES + 1] + np.bincount(y + 1, d_down, GRADES + 1)
        g = np.concatenate([np.bincount(at, dz[doc], len(keys)), [db[1] + db[2], db[2] * np.exp(theta[-1])]]) / len(rows)
        g[:-2] -= l2 * theta[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return dict(zip(keys.tolist(), theta[:-2].tolist(), strict=True)), np.array([theta[-2], theta[-2] + np.exp(theta[-1])])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[np.ndarray, int]]:
    """Features and grades of at most `sample` labelled documents; features come as bytes, eight each."""
    g = labels.select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).alias("grade")).dropna()
    grade = {r.id: r.grade for r in g.orderBy(F.xxhash64("id"), "id", "grade").limit(sample).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(grade)

    def run(batches):
        grade = sent.value
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [(d, features(b.column(1)[i].as_py()), grade[d]) for i, d in enumerate(ids) if d in grade]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in out]), pa.array([np.array(f, np.uint64).tobytes() for _, f, _ in out], pa.binary()), pa.array([y for *_, y in out], pa.int64())], names=["id", "f", "y"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, f binary, y long").collect()
    return [(np.frombuffer(r.f, np.uint64), r.y) for r in sorted(found, key=lambda r: (r.id, r.y, bytes(r.f)))]


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 6000, threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, expected_grade, tail_prob = P(grade = 2), grade, kept = tail_prob >= threshold.

    labels: doc_id, quality, toxic; rows with nulls are not learned from; sample: most labelled rows that the fit uses. Without any labelled
    document the scores are null and everything is kept. A null text counts as empty; null ids stay; extra columns are ignored.
    """
    rows = training_rows(docs, labels, sample)
    weights, b = fit(rows) if rows else ({}, None)
    sent = docs.sparkSession.sparkContext.broadcast((weights, b))

    def run(batches):
        weights, b = sent.value
        get = weights.get
        for batch in batches:
            n = batch.num_rows
            if b is None:
                none = pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), none, none, pa.nulls(n, pa.int64()), pa.array([True] * n)], names=["doc_id", "expected_grade", "tail_prob", "grade", "kept"])
                continue
            z = np.array([sum(get(f, 0.0) for f in features(t.as_py())) for t in batch.column(1)])
            over = 1 / (1 + np.exp(-np.clip(z[:, None] - b, -30, 30))) if n else np.zeros((0, 2))
            p = np.stack([1 - over[:, 0], over[:, 0] - over[:, 1], over[:, 1]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(over.sum(axis=1)), pa.array(over[:, 1]), pa.array(p.argmax(axis=1)), pa.array(over[:, 1] >= threshold)], names=["doc_id", "expected_grade", "tail_prob", "grade", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tail_prob double, grade long, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 6000, threshold: float = 0.5) -> DataFrame:
    """docs whose score is kept. Rows without a doc_id are scored like the others only in quality_scores; here they stay."""
    gone = quality_scores(docs, labels, sample, threshold).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["_gone"], "left_anti")
