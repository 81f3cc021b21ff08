import random
import re

import numpy as np

from twinsift.llm import decontaminate as D

DOC = "doc_id long, text string, item_id string"


def plain_words(text):
    return re.findall(r"\w+", text.lower())


def plain_parts(text):
    """Question and answer: up to the last question mark that something follows, or else all but the last sentence."""
    text = text.rstrip()
    head, mark, tail = text.rpartition("?")
    if mark and tail:
        return plain_words(head), plain_words(tail)
    sentences = re.split(r"(?<=[.!?])\s+", text)
    return plain_words(" ".join(sentences[:-1])) or plain_words(text), plain_words(sentences[-1]) if len(sentences) > 1 else []


def brute(text, items, overlap=0.8, n=5):
    def grams(w):
        k = min(n, len(w))
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []

    w, out = plain_words(text or ""), []
    for i, t in items:
        q, a = map(grams, plain_parts(t))
        shares = [sum(any(tuple(w[j : j + len(g)]) == g for j in places.get(g[0], ())) for g in x) / len(x) for x in (q, a) if x] if (places := positions(w)) and q else [0]
        if min(shares) >= overlap:
            out.append(i)
    return out


def positions(w):
    out = {}
    for j, x in enumerate(w):
        out.setdefault(x, []).append(j)
    return out


def corpus():
    rng = random.Random(7)
    w = [f"w{int(rng.expovariate(0.02))}" for _ in range(3000)]
    pick = lambda k: [rng.choice(w) for _ in range(k)]
    items = [(i, " ".join(pick(rng.randint(8, 40))) + rng.choice(["? ", ". "]) + " ".join(pick(rng.randint(3, 12))) + ".") for i in range(60)]
    items += [(100, None), (101, ""), (102, "!!!"), (None, "one two three four five six seven eight"), (103, "Καλημέρα κόσμε — tiny item of a few words? yes it is quite so"), (104, " ".join(pick(900)) + "? " + " ".join(pick(9)))]
    rows = []
    for d in range(300):
        body = pick(rng.randint(0, 400))
        if d % 3 == 0:
            i, t = rng.choice([x for x in items if x[0] is not None and x[1]])
            t = t.split()
            if d % 2:
                t[rng.randrange(len(t))] = "changed"
            body[(k := rng.randint(0, len(body))) : k] = [x.upper() + "###" for x in t] if d % 4 == 0 else t
        rows.append((d, " ".join(body)))
    return rows + [(900, None), (901, ""), (902, "w1 " * 100_000 + items[0][1]), (902, items[0][1]), (None, items[1][1])], items


def test_decontaminate_equals_brute_force(spark):
    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], DOC)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = sorted((d is not None, d or 0, i) for d, t in rows for i in brute(t, [x for x in items if x[0] is not None and x[1]]))
    for most in ({}, {"most_items": 7}, {"most_bytes": 60_000}):
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.item_id) for r in D.decontaminate(docs, bench, **most).collect())
        assert got == want and len(want) > 60
    kept = {r.doc_id for r in D.drop_contaminated(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for ok, d, _ in want if ok}
    assert D.decontaminate(docs.limit(0), bench).count() == 0 and D.decontaminate(docs, bench.limit(0)).count() == 0


def test_wand_retrieves_all_above_threshold():
    rows, items = corpus()
    it = D.Items([x for x in items if x[0] is not None and x[1]], 5)
    df = {t: 1 + len(t) for t in it.vocabulary}
    it.weigh(df, 500)
    for _, text in rows[:80]:
        for index, local in zip(it.indexes, it.local, strict=True):
            ids = local[np.array([it.vocabulary.get(x, -1) for x in D.words(text)], np.int64)] if text else np.zeros(0, np.int64)
            terms = sorted({int(t) for t in ids if t >= 0})
            full = {}
            for t in terms:
                for k, x in zip(index.items[t].tolist(), index.impact[t].tolist(), strict=True):
                    full[k] = full.get(k, 0) + x
            for least in (0.2, 0.5):
                got = dict(p for b in range(index.n_blocks) for p in index.wand(terms, b, least))
                assert set(got) == {k for k, x in full.items() if x >= least - 1e-6}
                assert all(abs(got[k] - full[k]) < 1e-9 for k in got)


def test_items_that_share_an_id_or_have_none(spark):
    one, two, three, four = (" ".join(f"{p}{k}" for k in range(20)) + "." for p in "abcd")
    bench = spark.createDataFrame([(1, one), (1, two), (1, two), (2, three), (None, four), (None, four + " more")], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"x {one} y"), (11, f"x {two} y"), (12, f"{one} {two} {three}"), (13, f"x {four} y"), (14, "nothing here")], "doc_id long, text string")
    for most in (20_000, 1):
        got = sorted((r.doc_id, str(r.item_id)) for r in D.decontaminate(docs, bench, most_items=most).collect())
        assert [g for g in got if g[0] != 13] == [(10, "1"), (11, "1"), (12, "1"), (12, "2")]
        assert {g for g in got if g[0] == 13} == {(13, "None")}
    assert {r.doc_id for r in D.drop_contaminated(docs, bench).collect()} == {14}
