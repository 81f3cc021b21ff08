"""N-gram Jaccard self-join by parity sketches, and its connected components.

A document is the set of its distinct word n-grams, as 64-bit hashes. XOR-hashing a set into k segments gives a parity
sketch: each element of the symmetric difference of two sets changes at most one segment. Two sets within the threshold
differ in at most d elements (d follows from their sizes), so with k = d + 1 + e segments at least 1 + e are equal
(pigeonhole); segments are joined on equality, per size band. Empty segments would match by the thousand, so they
are sent only by sets with more than e of them: of a pair that links, either one equal segment isn't empty, or both
sets send their empty ones. No link is lost.

Candidates are verified in two steps: the Hamming distance of parity sketches of two bits and more for each element, a lower bound
of the symmetric difference, then the sets themselves, which are made anew from the texts of the few documents that are left. Within
a segment's bucket all sets are first held against one leader of the bucket and those already connected are left out; this
is linear in the bucket. What then is still unconnected is compared in tiles of bounded size on the sketches, so that
only pairs that pass the bound become rows. Buckets have no cap.

Equal sets are one node from the start (their fingerprint), so groups of exact copies cost nothing beyond one row a task. Two sets are
compared by the 64-bit hashes of their n-grams, not by the words.

What is known of a bucket (its size, its leader, whether it holds different sets) comes from a partial aggregate joined back by key, so that no
task needs a whole bucket, and adaptive execution may split a join's large ones.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, discard, hashed_words, materialize, mix, settle, text_buffer

_MUL = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0x85EBCA77C2B2AE63), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)]
#: Least and most bits of the filter of documents to read again, 16 for each document in between; a fuller one only lets more documents through.
FILTER_BITS = 1 << 23, 1 << 30
#: Fingerprints that a task remembers as sent.
SEEN = 1 << 20
#: Sets compared at once within a bucket.
TILE = 512


def shingles(a: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's word hashes; a shorter text is one n-gram; no words, no n-grams."""
    if not len(a):
        return np.zeros(0, U)
    if len(a) < n:
        return mix(np.array([(a * np.array(_MUL[: len(a)], U)).sum(dtype=U) ^ U(len(a) * 0x9E3779B1)], U))
    s = a[: len(a) - n + 1] * _MUL[0]
    for i in range(1, n):
        s += a[i : len(a) - n + 1 + i] * _MUL[i]
    return np.unique(mix(s))


def shingle_sets(texts: pa.Array, n: int, seed: int = 0) -> Iterator[np.ndarray]:
    """The n-gram set of each text, null ones are empty; words are hashed for some millions of characters at once."""
    data, offsets = text_buffer(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 22), side="right")) - 1)
        first = offsets[at : to + 1] - offsets[at]
        h, place = hashed_words(data[offsets[at] : offsets[to]], first[:-1])
        h = mix(h ^ mix(np.array([seed], U))) if seed else h
        cut = np.searchsorted(place, first)
        for i in range(to - at):
            yield shingles(h[cut[i] : cut[i + 1]], n)
        at = to


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set, as signed integers."""
    b = s.tobytes()
    return tuple(int(np.array(xxhash.xxh3_64_intdigest(b, seed=k), U).view(np.int64)) for k in (1, 2))


class Bands:
    """Size bands and the bound of the symmetric difference, for Jaccard similarity >= num / den."""

    def __init__(self, num: int, den: int, ratio: float = 1.4, largest: int = 1 << 40):
        self.num, self.den, lo = num, den, [1]
        while lo[-1] < largest:
            lo.append(max(lo[-1] + 1, int(lo[-1] * ratio)))
        self.lo = np.array(lo)

    def differ(self, a: int, b: int) -> int:
        """Most elements in which sets of a and b elements may differ: |AuB| - |AnB| with 1 - J <= (den - num) / den."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def of(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(band, segments, spare) under which a set of n elements is sent: its own band, and those that smaller partners may have."""
        i = int(np.searchsorted(self.lo, n, side="right") - 1)
        while i >= 0 and self.den * int(self.lo[i + 1] - 1) >= self.num * n:
            hi = int(self.lo[i + 1] - 1)
            d = self.differ(hi, hi * self.den // self.num)
            if d:  # else only equal sets link
                spare = 1 if d < 20 else 2 if d < 60 else 3
                yield i, d + 1 + spare, spare
            i -= 1

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Keys of the segments that a set sends."""
        out = []
        for band, k, spare in self.of(len(s)):
            seg = ((s >> U(32)) * U(k)) >> U(32)
            first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            x, at = np.bitwise_xor.reduceat(s, first), seg[first]
            if k - len(first) > spare:
                gone = np.setdiff1d(np.arange(k, dtype=U), at)
                x, at = np.concatenate((x, np.zeros(len(gone), U))), np.concatenate((at, gone))
            out.append(mix(x ^ mix(at + U(band << 32))))
        return np.concatenate(out) if out else np.zeros(0, U)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the set's elements in each of its bits, as words of 64. Bits: a power of two, twice the elements and more, 2048 to 65536."""
    bits = min(1 << 16, max(2048, 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def _fold(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of sketches as the sketches of fewer bits: width words."""
    return np.bitwise_xor.reduce(x.reshape(len(x), -1, width), axis=1)


def _matrix(cells: list[bytes], width: int) -> np.ndarray:
    """Sketches (bytes) of different sizes as rows of width words each."""
    out = np.zeros((len(cells), width), U)
    size = np.fromiter(map(len, cells), np.int64, len(cells)) // 8
    for k in np.unique(size).tolist():
        at = np.flatnonzero(size == k)
        out[at] = _fold(np.frombuffer(b"".join([cells[i] for i in at]), U).reshape(len(at), k), width)
    return out


def _far(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Hamming distances of pairs of sketches, at the smaller size of each."""
    width = np.minimum(np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y))) // 8
    out = np.zeros(len(x), np.int64)
    for k in np.unique(width).tolist():
        at = np.flatnonzero(width == k)
        out[at] = np.bitwise_count(_matrix([x[i] for i in at], k) ^ _matrix([y[i] for i in at], k)).sum(axis=1)
    return out


def _same(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def heads(docs: DataFrame, n: int, bands: Bands, seed: int = 0) -> DataFrame:
    """(doc_id, n, f1, f2, keys): set size, fingerprints and segments of each document; copies within a task send their segments once."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            ids, size, f1, f2, keys = b.column(0), [], [], [], []
            for s in shingle_sets(b.column(1), n, seed):
                size.append(len(s))
                f = fingerprint(s) if len(s) else (None, None)
                f1.append(f[0])
                f2.append(f[1])
                keys.append(bands.keys(s).view(np.int64) if len(s) and f[0] not in seen else None)
                seen.add(f[0])
            if len(seen) > SEEN:
                seen.clear()
            offsets = pa.array([*np.cumsum([0] + [0 if k is None else len(k) for k in keys]).tolist()], pa.int32())
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *(k for k in keys if k is not None)]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "n", "f1", "f2", "keys"])
            settle()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, f1 long, f2 long, keys array<long>")


def _filter_bits(ids: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of two bits for each id, of size bits."""
    h = F.xxhash64("_id")
    bit = ids.filter("_id IS NOT NULL").select(F.explode(F.array(F.pmod(h, F.lit(size)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(size)))).alias("bit"))
    parts = bit.groupBy(F.expr("bit div 32768").alias("w")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("m")).collect()
    out = np.zeros(size // 8, np.uint8)
    for w, m in parts:
        out[4096 * w : 4096 * w + len(m)] = np.frombuffer(bytes(m), np.uint8)
    return out


def _again(docs: DataFrame, chosen: DataFrame, size: int, n: int, whole: bool, seed: int) -> DataFrame:
    """(f1, n, data) of the chosen nodes, data: the set or else its sketch; chosen: _id, a document of each node; size: the filter's bits.

    Texts are not shuffled: a filter of bounded size tells which to read, and those without an id are read always. It lets some others
    through, and copies; rows may be too many, never too few.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter_bits(chosen.select("_id"), size))
    maybe = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("doc_id").cast("long")).alias("_h"), F.col("text").cast("string").alias("text"))

    def run(batches):
        on, sent = bits.value, set()

        def holds(bit):
            return (on[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)

        for b in batches:
            h = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            yes = holds(h % size) & holds((h.view(U) >> U(32)).astype(np.int64) % size) | b.column(0).is_null().to_numpy(zero_copy_only=False)
            out = []
            for s in shingle_sets(b.column(2).filter(pa.array(yes)), n, seed):
                if len(s) and (f := fingerprint(s)[0]) not in sent:
                    sent.add(f)
                    out.append((f, len(s), (s if whole else sketch(s)).tobytes()))
            if len(sent) > SEEN:
                sent.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["f1", "n", "data"])
            settle()

    return maybe.mapInArrow(run, "f1 long, n long, data binary")


def _bound(bands: Bands, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (bands.den - bands.num) * (a + b) // (bands.den + bands.num)


def verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, reps: DataFrame, size: int, n: int, bands: Bands, seed: int = 0) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link; first by sketches, then by the sets. reps: (f1, _id), a document of each node; size: the filter's bits."""
    num, den = bands.num, bands.den

    def near(batches):
        for b in batches:
            na, nb = (b.column(k).to_numpy() for k in (2, 4))
            ok = (_far(b.column(3).to_pylist(), b.column(5).to_pylist()) <= _bound(bands, na, nb)) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
            yield b.select(["a", "b"]).filter(pa.array(ok))

    def link(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), U) for z in (x, y))
                i = _same(x, y)
                ok.append(den * i >= num * (len(x) + len(y) - i))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def of(sets: DataFrame, side: str) -> DataFrame:
        return sets.select(F.col("f1").alias(side), F.col("n").alias(f"n_{side}"), F.col("data").alias(f"data_{side}"))

    p = pairs.join(of(sketches, "a"), "a").join(of(sketches, "b"), "b").select("a", "b", "n_a", "data_a", "n_b", "data_b").mapInArrow(near, "a long, b long")
    p = materialize(p.distinct(), "near")
    nodes = p.select(F.col("a").alias("f1")).unionByName(p.select(F.col("b").alias("f1"))).distinct()
    sets = _again(docs, nodes.join(reps, "f1").select("_id"), size, n, True, seed).join(nodes, "f1", "left_semi").dropDuplicates(["f1"])
    links = materialize(p.join(of(sets, "a"), "a").join(of(sets, "b"), "b").select("a", "b", "data_a", "data_b").mapInArrow(link, "a long, b long"), "links")
    discard(p)
    return links


def _mixed_buckets(rows: DataFrame, by: str) -> DataFrame:
    """The keys of buckets that hold different values."""
    return rows.groupBy("key").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).filter("lo <> hi").select("key")


def _tiles(active: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """Pairs (a, b) of unconnected members of a bucket whose sketches pass the bound. A bucket of m members is dealt into blocks
    of about TILE; each pair of blocks is a task's group of its own, so no group grows with the bucket."""
    num, den = bands.num, bands.den
    sizes = active.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("nb"))
    blocks = active.join(sizes, "key").withColumn("blk", F.pmod(F.xxhash64("f1"), F.col("nb")).cast("int"))
    dealt = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), (F.col("blk") > F.col("o")).alias("second"), "f1", "n", "label")
    with_sketch = dealt.join(sketches.select("f1", "data"), "f1")
    ordered = with_sketch.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "f1").select("key", "i", "j", "second", "f1", "n", "label", "data")

    def compare(t: pa.Table) -> pa.Table:
        key, i, j, second, f1, n, label = (t.column(c).to_numpy() for c in range(7))
        cells = t.column(7).to_pylist()
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))[: t.num_rows]
        group = np.cumsum(new) - 1
        width = np.minimum.reduceat(np.fromiter(map(len, cells), np.int64, len(cells)) // 8, np.flatnonzero(new))[group] if len(cells) else group
        rows, sk = np.zeros(t.num_rows, np.int64), {}
        for k in np.unique(width).tolist():
            at = np.flatnonzero(width == k)
            rows[at], sk[k] = np.arange(len(at)), _matrix([cells[r] for r in at], k)
        a, b = [], []
        left = np.arange(t.num_rows)
        for o in range(1, t.num_rows):
            left = left[left + o < t.num_rows]
            left = left[group[left] == group[left + o]]
            if not len(left):
                break
            r = left + o
            left = left[den * n[left] >= num * n[r]]  # sorted by size: later partners are larger still
            r = left + o
            x, y = left[m := (label[left] != label[r]) & ((i[left] == j[left]) | (second[left] != second[r]))], r[m]
            for p, q, m in ((x[at], y[at], sk[k]) for k in sk for at in np.array_split(np.flatnonzero(width[x] == k), 1 + len(x) * k // (1 << 20))):
                ok = np.bitwise_count(m[rows[p]] ^ m[rows[q]]).sum(axis=1) <= _bound(bands, n[p].astype(np.int64), n[q].astype(np.int64))
                a.append(np.minimum(f1[p[ok]], f1[q[ok]]))
                b.append(np.maximum(f1[p[ok]], f1[q[ok]]))
        z = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([z, *a]), "b": np.concatenate([z, *b])})

    def run(batches):
        kept = None
        for x in batches:
            t = pa.Table.from_batches([x]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([x])])
            if not t.num_rows:
                continue
            k, i, j = (t.column(c).to_numpy() for c in range(3))
            last = int(np.flatnonzero((k != k[-1]) | (i != i[-1]) | (j != j[-1]))[-1]) + 1 if (k[0], i[0], j[0]) != (k[-1], i[-1], j[-1]) else 0
            yield from compare(t.slice(0, last)).to_batches()
            kept = t.slice(last)
        if kept is not None:
            yield from compare(kept).to_batches()

    return ordered.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of the edges (a, b), by alternating large and small stars."""
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, large = e, materialize(large.filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.filter("u <> v").distinct(), "small")
        discard(before, large)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == state:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            out.made_at = e.made_at
            return out
        state = now


def _star(active: DataFrame, order: Column) -> DataFrame:
    """Each member of a bucket with the bucket's leader, if they are not connected yet."""
    lead = active.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("f1").alias("f1"), F.col("n").alias("n"), F.col("label").alias("label"))).alias("lead"))
    return active.join(lead, "key").filter("label <> lead.label").select(F.least("f1", "lead.f1").alias("a"), F.greatest("f1", "lead.f1").alias("b"), F.col("n"), F.col("lead.n").alias("m"))


def ngram_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, rounds: int = 2, seed: int = 0) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, f1.

    docs: doc_id, text. Documents link when den * |intersection| >= num * |union| of their n-gram sets; component_id is the least
    doc_id that links reach. Null or wordless texts: no n-grams, their own component. Null doc_id: the row links as others do, its component_id is that
    of its linked documents, or null. Texts of any length are taken whole; no documents give no rows. Extra columns are ignored. A repeated doc_id
    is one document for component_id.
    """
    bands = Bands(num, den)
    made = materialize(heads(docs, n, bands, seed), "heads")
    head = made.select("doc_id", "n", "f1", "f2")
    nodes = head.filter("n > 0").groupBy("f1").agg(F.min("doc_id").alias("rep"), F.min("f2").alias("f2"), F.max("f2").alias("f3"))
    if nodes.filter("f2 <> f3").limit(1).count():
        return ngram_join(docs, n, num, den, rounds, seed + 1)  # two different sets have one 64-bit fingerprint: other hashes tell them apart
    met = made.select(F.explode("keys").alias("key"), "f1", F.col("n").cast("int").alias("n"))
    buckets = materialize(met.join(_mixed_buckets(met, "f1"), "key", "left_semi"), "buckets")
    reps = materialize(buckets.select("f1").distinct().join(nodes, "f1").select("f1", F.col("rep").alias("_id")), "reps")
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * reps.count()).bit_length()))
    sketches = materialize(_again(docs, reps.select("_id"), size, n, False, seed).join(reps.hint("shuffle_hash"), "f1", "left_semi").dropDuplicates(["f1"]), "sketches")
    active, links, label = buckets.withColumn("label", F.col("f1")), [], None
    fits = f"{den} * least(n, m) >= {num} * greatest(n, m)"
    for r in range(rounds + 1):
        pairs = _star(active, F.xxhash64("f1", F.lit(r))).filter(fits).select("a", "b").distinct() if r < rounds else _tiles(active.distinct(), sketches, bands)
        links.append(verified(pairs, sketches, docs, reps, size, n, bands, seed))
        before, label = label, components(functools.reduce(DataFrame.unionByName, links))
        if before is not None:
            discard(before)
        if r < rounds:
            named = buckets.join(label, F.col("f1") == F.col("node"), "left").select("key", "f1", "n", F.coalesce("label", "f1").alias("label"))
            before, active = active, materialize(named.join(_mixed_buckets(named, "label"), "key", "left_semi"), "active")
            if r:
                discard(before)
    discard(*links, buckets, reps, sketches, *[active] * (rounds > 0))
    rooted = nodes.join(label, F.col("f1") == F.col("node"), "left").select("f1", "rep", F.coalesce("label", "f1").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("f1", "component_id")
    return head.join(named, "f1", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "f1")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id. Rows without a doc_id stay."""
    gone = ngram_join(docs, n, num, den).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["_gone"], "left_anti")
