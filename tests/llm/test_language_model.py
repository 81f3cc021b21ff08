import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from twinsift.llm import common as C
from twinsift.llm import language_model as M

DOC = "doc_id long, text string, score string"


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top, n in ((1, 5), (10, 2000), (10**6, 3000), (2**63, 4000), (2**64 - 1, 1), (300, 700)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        a = M.ef_build(v, "x")
        ef = M.EliasFano(a, "x")
        assert np.array_equal(ef.access(np.arange(n)), v)
        x = np.concatenate((v, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True)))
        p = ef.find(x, np.zeros(len(x), np.int64), np.full(len(x), n))
        have = set(v.tolist())
        assert all((k >= 0) == (int(y) in have) and (k < 0 or v[k] == y) for k, y in zip(p.tolist(), x, strict=True))
        lo, hi = np.full(n, n // 3), np.full(n, n // 2)
        inside = set(v[n // 3 : n // 2].tolist())
        assert all((k >= 0) == (int(y) in inside) for k, y in zip(ef.find(v, lo, hi).tolist(), v, strict=True))


def brute(rows, cutoff):
    toks = lambda t: [*("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() if t else []), "\n"]
    data = [(d, toks(t), d is not None and zlib.crc32(str(d).encode()) % 7 == 2) for d, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for _, w, out in data:
        if not out:
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    two, three = Counter({k: c for k, c in two.items() if c >= cutoff}), Counter({k: c for k, c in three.items() if c >= cutoff})
    N, V, D = sum(one.values()), len(one), M.DISCOUNT
    p1 = lambda w: (one[w] + 1) / (N + V + 1)
    share = Counter()
    for k, c in (two | three).items():
        share[k[:-1]] += (c - D) / (one[k[0]] if len(k) == 2 else two[k[:-1]])
    p2 = lambda v, w: max(0, two[v, w] - D) / max(1, one[v]) * (two[v, w] > 0) + max(1 - share[v,], 1e-12) * p1(w)
    p3 = lambda u, v, w: (three[u, v, w] - D) / two[u, v] * (three[u, v, w] > 0) + max(1 - share[u, v], 1e-12) * p2(v, w) if two[u, v] else p2(v, w)
    res = {}
    for d, w, out in data:
        full = sum(math.log10(p1(x) if i == 0 else p2(w[0], x) if i == 1 else p3(w[i - 2], w[i - 1], x)) for i, x in enumerate(w))
        res[d] = (out, len(w), sum(one[x] > 0 for x in w), N, sum(math.log10(p1(x)) for x in w), full)
    return res


@pytest.mark.parametrize("cutoff", [1, 2])
def test_scores_equal_brute_force(spark, cutoff):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Wort", "THE"]
    rows = [(d, " ".join(vocabulary[min(62, int(rng.expovariate(0.12)))] for _ in range(rng.randint(1, 60)))) for d in range(250)]
    rows += [(900, None), (901, ""), (902, "never seen words here"), (903, "w1 w2 " * 30_000), (None, "w1 w2 w3"), (905, "w3 w4"), (906, "w3 w4")]
    want = brute(rows, cutoff)
    old, M.CHUNK = M.CHUNK, 3000
    try:
        got = M.lm_scores(spark.createDataFrame([(d, t, "x") for d, t in rows], DOC), cutoff=cutoff).collect()
    finally:
        M.CHUNK = old
    assert len(got) == len(rows)
    for r in got:
        out, n, known, total, base, full = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert abs(r.base_score - base) < 1e-9 * max(1, n)
        assert full - 2.5 * n / M.STEP <= r.score <= full + 1e-6 * n
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert M.lm_scores(spark.createDataFrame([], DOC)).count() == 0


def test_query_keeps_ngrams_seen_once(spark, tmp_path):
    from twinsift.llm.queries import op3_lm_scoring

    train = [d for d in range(100) if not M.held_out(d)][:6]
    texts = ["a b c d e", "a b x y", "q r s", "q r t once", "b c", "d"]
    held = next(d for d in range(100) if M.held_out(d))
    rows = [*zip(train, texts, strict=True), (held, "a b c d once q r s never e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in op3_lm_scoring(spark, str(tmp_path)).collect()}
    words = {d: [*t.split(), "\n"] for d, t in rows}
    count = Counter(tuple(w[i : i + n]) for d, w in words.items() if d != held for n in (1, 2, 3) for i in range(len(w) - n + 1))
    N, V = sum(c for k, c in count.items() if len(k) == 1), sum(len(k) == 1 for k in count)

    def p(k):
        if len(k) == 1:
            return (count[k] + 1) / (N + V + 1)
        if not count[k[:-1]]:
            return p(k[1:])
        share = {x: (c - M.DISCOUNT) / count[k[:-1]] for x, c in count.items() if len(x) == len(k) and x[:-1] == k[:-1]}
        return share.get(k, 0) + max(1 - sum(share.values()), 1e-12) * p(k[1:])

    for d, w in words.items():
        want = sum(math.log10(p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(len(w)))
        assert want - 2.5 * len(w) / M.STEP <= got[d] <= want + 1e-6 * len(w)


def test_words_of_all_lengths_and_windows():
    rng = random.Random(7)
    old, C.WINDOW = C.WINDOW, 300
    try:
        for _ in range(40):
            texts = ["".join(rng.choice(["a", "B", " ", "\t", "é", "x" * 90, "日", "\x0b", "\x85"]) for _ in range(rng.randrange(60))) for _ in range(rng.randint(1, 6))]
            texts[rng.randrange(len(texts))] += "Q" * rng.choice([0, 257, 400, 1500])
            raw = [t.encode() for t in texts]
            first = np.cumsum([0] + [len(r) for r in raw[:-1]])
            h, place = C.hashed_words(np.frombuffer(b"".join(raw), np.uint8), first)
            want = [w for r in raw for w in r.lower().split()]
            assert len(h) == len(want) and len({*zip(want, h.tolist(), strict=True)}) == len({*want}) == len({*h.tolist()})
            assert np.diff(np.searchsorted(place, np.append(first, sum(map(len, raw))))).tolist() == [len(r.split()) for r in raw]
    finally:
        C.WINDOW = old


def test_blobs_round_trip():
    rng = np.random.default_rng(4)
    for top, n in ((3, 2), (1, 1), (2**64 - 1, 500), (10**9, 3000)):
        k = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        c = rng.integers(1, 2 if n == 500 else 10**6, len(k))
        got = M.unpack(M.pack(k, c))
        assert np.array_equal(got[0], k) and np.array_equal(got[1], c)


def test_shards_are_cut_by_weight():
    counts = np.ones(1000, np.int64)
    counts[[10, 500]] = 5000
    fence = M._fence([(0, M._marks(counts[:400])), (400, M._marks(counts[400:]))], 8)
    assert fence[0] == 0 and len(fence) <= 8 and len(set(fence.tolist())) == len(fence)
    parts = np.split(counts, fence[1:])
    assert max(len(p) for p in parts if p.sum() >= 5000) < 500


def test_token_hashes_tell_words_apart():
    rng, of = random.Random(1), {}
    for r in range(1500):
        docs = ["".join(rng.choice(["a", "B", "b", " ", "\n", "\x1c", "é", "abcdefgh", "ABCDEFGHI", "\x0b", "x" * 300 if r % 50 == 0 else "-"]) for _ in range(rng.randint(0, 9))).encode() for _ in range(rng.randint(1, 6))]
        first = np.cumsum([0] + [len(d) for d in docs])[:-1]
        h, place = M._hashed(np.frombuffer(b"".join(docs), np.uint8), first)
        words = [(int(f) + m.start(), m[0].lower()) for f, d in zip(first, docs, strict=True) for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)]
        assert place.tolist() == [p for p, _ in words]
        assert all(of.setdefault(w, x) == x for x, (_, w) in zip(h.tolist(), words, strict=True))
    assert len(set(of.values())) == len(of) > 500
    for h in (np.array([1, 1, 5, (1 << 60) + 3, (1 << 60) + 2, (1 << 60) + 3], np.uint64), np.array([7], np.uint64), np.array([rng.randrange(1 << 64) for _ in range(500)] * 2, np.uint64)):
        assert all(np.array_equal(a, b) for a, b in zip(M._distinct(h), np.unique(h, return_inverse=True), strict=True))


def test_look_ups_do_not_go_through_all_tokens_for_each_shard(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(200)) for _ in range(60)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        trie = M.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(trie.bigrams) > 6
    h = np.concatenate([M.tokens(t) for t in texts])
    ends = np.cumsum([len(M.tokens(t)) for t in texts])
    seen, plain = [], np.unique
    monkeypatch.setattr(M.np, "unique", lambda x, **k: seen.append(len(x)) or plain(x, **k))
    _, _, every = M.score(h, ends, trie)
    assert sum(seen) < 3.5 * len(h), seen  # tokens, bigrams and trigrams once each, however many shards
    one = np.concatenate([M.score(M.tokens(t), np.array([len(M.tokens(t))]), trie)[2] for t in texts])
    assert np.array_equal(every, one)
