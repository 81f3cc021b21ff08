import random

import numpy as np
import public_tokenizers as P

from twinsift.llm import sentencepiece_codec as C

MODEL = P.path("piece_bpe_32k.model")


def test_encode_decode(spark):
    rng = random.Random(8)
    parts = ["the", " ", "  ", "Zürich", "\n", "▁", "日本語", "😀", "thing", "ing", "123", "\t", "é", "'s", "—", "\x00"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " "), (903, "abcdefghij" * 3000), (904, "x" * 70 + " y"), (905, "word " * 60_000), (906, "the"), (906, "the"), (None, "null id")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, ids string")
    enc = C.encode(docs, MODEL)
    got = enc.collect()
    pieces, texts = C.Pieces(MODEL), {d: t or "" for d, t in rows}
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    for r in got:
        c, begin = pieces.cuts(texts[r.doc_id])
        end = np.append(begin[1:], len(c))
        if len(texts[r.doc_id]) < 500:  # the whole text through the plain fold, without cuts
            whole = " " + texts[r.doc_id]
            assert pieces.with_bytes(whole, pieces.fold(whole)) == r.ids
        assert "".join(C._text(c[a:b]) for a, b in zip(begin, end, strict=True)) == " " + texts[r.doc_id]
    assert sorted((r.doc_id or -1, r.text) for r in C.decode(enc, MODEL).collect()) == sorted((d or -1, t) for d, t in texts.items() for _ in range(1 + (d == 906)))
    assert C.digest(C.encode(docs.limit(0), MODEL)).count() == 0


def test_lattice_equals_fold(spark):
    rng = random.Random(9)
    pieces = C.Pieces(MODEL)
    words = sorted({"".join(rng.choice("abcdeing the日_(") for _ in range(rng.randint(1, 20))) for _ in range(400)})
    got = C.lattice(spark.createDataFrame(list(enumerate(words)), "h long, chunk string"), C.piece_table(spark, pieces), pieces.longest).collect()
    assert len(got) == len(words)
    cost = {i: c for i, c in pieces.table.values()} | {-1: C.UNKNOWN}
    for r in got:
        assert abs(sum(cost[i] for i in r.ids) - sum(cost[i] for i in pieces.fold(r.chunk))) < 1e-6 and r.ids == pieces.fold(r.chunk)
