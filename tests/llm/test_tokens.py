import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from twinsift.llm import token_output as T

PATH = P.path("byte_bpe_50k.json")


def test_encoder_equals_library():
    rng = random.Random(1)
    parts = [chr(i) for i in range(256)] + ["'s", "'ll", "'stuff", "  ", "\n\n", " a", " 1", "<|endoftext|>", "Ω", "\x1c", " 'd", "word", " word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(8000)] + ["", " ", "\n", "x" * 300_000, ("ab 'll " * 400_000)]
    got = T.Encoder(PATH).encode_batch(texts)
    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert all(list(a) == b.ids for a, b in zip(got, want, strict=True))


def test_re_pair_looks_at_new_symbols_only(monkeypatch):
    rng = np.random.default_rng(6)
    words = rng.integers(3, 50_000, (30_000, 3)).astype(np.uint32)  # three ids a word, words of skewed frequency
    seq = words[(30_000 * rng.random(1 << 18) ** 4).astype(int)].reshape(-1)
    seq[rng.integers(0, len(seq), 2000)] = 2

    looked, sort = [], np.sort
    monkeypatch.setattr(T.np, "sort", lambda x, **k: looked.append(len(x)) or sort(x, **k))
    T.re_pair(seq, 50_000, 2)
    assert len(looked) > 3 and sum(looked) < 5 * len(seq), looked  # not some twenty rounds over the whole sequence
    for s in (seq, rng.integers(1, 5, 5000).astype(np.uint32), np.full(999, 7, np.uint32)):
        for most in (1, 50, 1 << 14):
            if most > 1 or len(s) < 9999:
                symbols, rules, lengths = T.re_pair(s, 50_000, 2, most=most)
                assert np.array_equal(T.expand(symbols, 50_000, rules, lengths), s)
                left = Counter((a, b) for a, b in zip(symbols.tolist(), symbols[1:].tolist()) if 2 not in (a, b))
                assert max(left.values(), default=0) < 4  # none is left that gains


def test_re_pair_round_trip():
    rng = np.random.default_rng(2)
    for n, k in ((0, 5), (1, 5), (5, 3), (4000, 3), (60_000, 30), (60_000, 900)):
        seq = rng.zipf(1.5, n).clip(max=k).astype(np.uint32) if n else np.zeros(0, np.uint32)
        s, rules, lengths = T.re_pair(seq, 1000, 2)
        assert np.array_equal(T.expand(s, 1000, rules, lengths), seq)
        assert (s == 2).sum() == (seq == 2).sum() and (n < 4000 or len(s) < 0.7 * n)


    s, rules, lengths = T.re_pair(np.tile(np.arange(3, 13, dtype=np.uint32), 12_800), 1000, 2)
    assert len(s) < 40 and lengths.max() > 1000  # rounds go on until no pair is frequent


def test_encoder_tells_pre_tokens_of_one_hash_apart():
    a, b = "a", "b"
    while len(a) < 4096:  # such words have one polynomial hash modulo 2**64, whatever its base
        a, b = a + b, b + a
    lib = Tokenizer.from_file(PATH)
    for texts in ([f"{a} {b}"], [a, b], [b, a, f" {a} {b} word"]):
        assert [list(x) for x in T.Encoder(PATH).encode_batch(texts)] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_files(spark, tmp_path):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["the", "and", "Zürich", "Ωmega", "#", "it's"]) for _ in range(rng.randrange(80))) for i in range(300)}
    texts |= {700: None, 701: "", 702: "long text " * 40_000, 703: "##", 704: "##"}
    rows = [(i, t, i) for i, t in texts.items()] + [(5, texts[5], 0), (None, "null id", 0)]
    rng.shuffle(rows)
    old, T.BLOCK_IDS = T.BLOCK_IDS, 3000
    try:
        path = f"file://{tmp_path}/out"
        shards = T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, shard long"), path, PATH, 4)
        got = sorted(T.read_tokens(shards, path).collect(), key=lambda r: r.start)
    finally:
        T.BLOCK_IDS = old
    lib, at = Tokenizer.from_file(PATH), 0
    want = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for r, (d, t) in zip(got, want, strict=True):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    fs, root = T.open_store(path)
    with fs.open_input_file(f"{root}/{shards.orderBy('shard').first().file}") as f:
        reader = T.ShardReader(f)
        whole = list(reader)
        for k in (len(reader) - 1, 0, len(reader) // 2):
            assert np.array_equal(reader.ids(k), whole[k])
    assert T.token_output(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
