"""Language-model scoring with an Elias-Fano n-gram trie.

Training documents are counted in three passes. Level 1 holds every distinct token (by 64-bit hash) with its exact count. A bigram
is counted further if both its words reach the cutoff, a trigram if both its bigrams do, so those that can't reach it never
reach a shuffle; a cutoff of 1 keeps all. Levels 2 and 3 hold the n-grams of count >= cutoff: for each context, monotone pointers to its children; the
children's ids as prefix sums, hence monotone; and a quantised interpolated probability for each, a backoff for each context. All
sequences are Elias-Fano coded in files of the shared folder, one for each range of contexts, which tasks map into memory.
A query is a successor search among its context's children only.

Counts travel as blobs, one for each part of a million tokens and each shard: sorted keys as differences, byte plane by byte plane. A shard is a
range of contexts; ranges are cut by the tokens that follow the contexts, so a frequent context has a shard of its own.

P1(w) = (c + 1) / (N + V + 1);  P(w | h) = (c(hw) - D) / c(h) + g(h) P(w | h') for kept hw, else g(h) P(w | h').
Quantised values are rounded down, so probabilities never sum to more than one.

Tokens are told apart by a 64-bit hash (mixed with each eight bytes): with a thousand million distinct tokens,
the chance that any two share one is about 3 %, and such two would count as one token.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mix, settle, text_buffer, work_path
from .token_output import open_store

_hash = xxhash.xxh3_64_intdigest
END = _hash(b"\n")
DISCOUNT = 0.5
STEP = 5000  # quantisation steps of a unit of log10
#: Tokens that are looked up or counted at once.
CHUNK = 1 << 20
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


# ---- Elias-Fano ----

_IN_BYTE = np.array([[next((p for p in range(8) if bin(b & (1 << p + 1) - 1).count("1") == k + 1 and b >> p & 1), 8) for k in range(8)] for b in range(256)], np.uint8)
_BYTES, _TOPS = U(0x0101010101010101), U(0x8080808080808080)
#: Elements that are worked on at once, so that intermediate arrays stay in the cache.
SLICE = 1 << 15


def packed(v: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each, one after the other in 64-bit words."""
    out = np.zeros((-(-len(v) // 64), width + 1), U)
    v = np.concatenate((v, np.zeros(len(out) * 64 - len(v), U))).reshape(-1, 64)
    for j in range(64 if width else 0):
        word, off = j * width >> 6, j * width & 63
        out[:, word] |= v[:, j] << U(off)
        if off + width > 64:
            out[:, word + 1] |= v[:, j] >> U(64 - off)
    return np.append(out[:, :width].reshape(-1), U(0))


def ef_build(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """A non-decreasing uint64 sequence: log2(top / n) low bits each, unary high parts, and the number of ones before each of their words."""
    v = values.astype(U)
    n, top = len(v), int(v[-1]) if len(v) else 0
    low = max(0, (top // max(1, n)).bit_length() - 1)
    high = (v >> U(low)).astype(np.int64)
    bits = np.zeros(((n + (int(high[-1]) if n else 0)) // 64 + 2) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(U)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))).astype(np.uint32)
    return {f"{name}.n": np.array([n, low], np.int64), f"{name}.low": packed(v & ((U(1) << U(low)) - U(1)), low), f"{name}.high": words, f"{name}.ones": ones}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low_bits = (int(x) for x in arrays[f"{name}.n"])
        self.low, self.high, self.ones = arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"]

    @functools.cached_property
    def zeros(self) -> np.ndarray:
        return (np.arange(len(self.ones)) * 64 - self.ones).astype(np.uint32)

    @functools.cached_property
    def low_bytes(self) -> np.ndarray:
        """The eight bytes from each byte of the low parts on."""
        return np.ndarray((self.low.nbytes - 7,), "<u8", self.low, strides=(1,))

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one (or zero), from 0: its word, its byte, its bit."""
        k = k.astype(np.uint32)
        word = np.searchsorted(before, k, side="right") - 1
        rest = (k - before[word]).astype(U)
        w = self.high[word]
        w = ~w if flip else w
        x = w - (w >> U(1) & U(0x5555555555555555))
        x = (x & U(0x3333333333333333)) + (x >> U(2) & U(0x3333333333333333))
        upto = (x + (x >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) * _BYTES  # ones of each byte and those below it
        at = np.bitwise_count((rest * _BYTES | _TOPS) - upto & _TOPS).astype(U) << U(3)
        rest -= upto << U(8) >> at & U(255)
        return word * 64 + at.astype(np.int64) + _IN_BYTE[(w >> at & U(255)).astype(np.intp), rest.astype(np.intp)]

    def _ones_from(self, place: np.ndarray) -> np.ndarray:
        """How many ones stand at a place and directly after it, 64 at most."""
        word, off = place >> 6, (place & 63).astype(U)
        after = self.high[np.minimum(word + 1, len(self.high) - 1)] << U(1) << (off ^ U(63))  # by 64 - off bits, none for off 0
        gaps = ~(self.high[word] >> off | after)
        return np.bitwise_count((gaps & (~gaps + U(1))) - U(1)).astype(np.int64)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        bit = i * self.low_bits
        if self.low_bits <= 57:
            return (self.low_bytes[bit >> 3] >> (bit & 7).view(U)) & ((U(1) << U(self.low_bits)) - U(1))
        word, off = bit >> 6, (bit & 63).astype(U)
        after = self.low[word + 1] << U(1) << (off ^ U(63))
        return (self.low[word] >> off | after) & ((U(1) << U(self.low_bits)) - U(1))

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), U)
        for at in range(0, len(i), SLICE):
            j = i[at : at + SLICE]
            out[at : at + SLICE] = (self._select(j, self.ones, False) - j).astype(U) << U(self.low_bits) | self.low_of(j)
        return out

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements i and those after them; i ascends, so that what stands between neighbours is read once."""
        every = np.empty(2 * len(i), np.int64)
        every[::2], every[1::2] = i, i + 1
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        got = self.access(every[new]).astype(np.int64)[np.cumsum(new) - 1]
        return got[::2], got[1::2]

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of x in [lo, hi), -1 if it isn't there."""
        out = np.full(len(x), -1, np.int64)
        for at in range(0, len(x), SLICE):
            self._find(x[at : at + SLICE], lo[at : at + SLICE], hi[at : at + SLICE], out[at : at + SLICE])
        return out

    def _find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, out: np.ndarray) -> None:
        """The bucket of equal high parts by zeros, then the low parts by halves; most buckets hold one or two."""
        shift = U(self.low_bits)
        high = (x >> shift).astype(np.int64)
        at = np.flatnonzero((lo < hi) & (high < int(self.zeros[-1])))
        h = high[at]
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) + 1, 0)
        start, run = begin - h, self._ones_from(begin)
        stop = start + run
        if len(long := np.flatnonzero(run == 64)):
            stop[long] = self._select(h[long], self.zeros, True) - h[long]
        stop, start = np.minimum(stop, hi[at]), np.maximum(start, lo[at])
        want = x[at] & ((U(1) << shift) - U(1))
        while len(at):
            more = np.flatnonzero(start < stop)
            if len(more) < len(at):
                at, start, stop, want = at[more], start[more], stop[more], want[more]
            mid = start + stop >> 1
            got = self.low_of(mid)
            same = got == want
            hit, go = np.flatnonzero(same), np.flatnonzero(~same)  # most are hits
            out[at[hit]] = mid[hit]
            at, start, stop, want, mid, less = at[go], start[go], stop[go], want[go], mid[go], (got < want)[go]
            start, stop = np.where(less, mid + 1, start), np.where(less, stop, mid)


def write_arrays(path: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    fs, root = open_store(path)
    fs.create_dir(root, recursive=True)
    part, at, head = f"{root}/.{uuid.uuid4().hex}", 0, {}
    for k, a in arrays.items():
        head[k] = [a.dtype.str, list(a.shape), at]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with fs.open_output_stream(part) as out:
        out.write(np.array([len(text)], "<i8").tobytes() + text)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    fs.move(part, f"{root}/{name}")


def map_arrays(path: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; of a store without local paths, of a copy that vanishes with the process."""
    fs, root = open_store(path)
    local = f"{root}/{name}"
    if fs.type_name != "local":
        with fs.open_input_stream(local) as f, tempfile.NamedTemporaryFile(delete=False) as to:
            while part := f.read(1 << 24):
                to.write(part)
        local = to.name
    m = np.memmap(local, np.uint8, "r")
    if fs.type_name != "local":
        os.unlink(local)
    n = int(m[:8].view("<i8")[0])
    out = {}
    for k, (dtype, shape, at) in json.loads(m[8 : 8 + n].tobytes()).items():
        size = int(np.prod(shape)) * np.dtype(dtype).itemsize
        out[k] = np.asarray(m[8 + n + at : 8 + n + at + size]).view(dtype).reshape(shape)
    return out


def coded(c: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Exact counts as ranks among their distinct values."""
    values, rank = np.unique(c, return_inverse=True)
    return {f"{name}.values": values.astype(np.int64), f"{name}.rank": rank.astype(np.uint8 if len(values) <= 256 else np.uint16 if len(values) <= 65536 else np.uint32)}


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(-np.minimum(log10, 0.0) * STEP - 1e-9), 65535).astype(np.uint16)


# ---- levels ----


@functools.cache
def word_fence(n_shards: int) -> np.ndarray:
    """The least hash of each shard of level 1."""
    return np.array([-(-(i << 32) // n_shards) << 32 for i in range(n_shards)], U)


def _runs(x: np.ndarray, fence: np.ndarray) -> list[tuple[int, slice]]:
    """For each range from a fence to the next that holds some of the ascending numbers x: (its number, where they stand)."""
    at = [*np.searchsorted(x, fence).tolist(), len(x)]
    return [(k, slice(at[k], at[k + 1])) for k in range(len(fence)) if at[k] < at[k + 1]]


class Words:
    """Level 1: token hashes and counts, in shards by range of hash."""

    def __init__(self, path: str, sizes: list[tuple[int, int]], n_shards: int):
        self.n_shards, self.of, at = n_shards, {}, 0
        for k, n in sizes:
            a = map_arrays(path, f"words-{k:06d}")
            self.of[k] = at, EliasFano(a, "hash"), a["count.values"], a["count.rank"]
            at += n
        self.first = np.array([x[0] for x in self.of.values()], np.int64)
        self.shards = list(self.of.values())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids or -1, counts) of ascending hashes."""
        ids, c = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for k, at in _runs(h, word_fence(self.n_shards)):
            if k in self.of:
                first, ef, values, rank = self.of[k]
                own = h[at]
                p = ef.find(own, np.zeros(len(own), np.int64), np.full(len(own), ef.n))
                ok = np.flatnonzero(p >= 0)
                ids[at][ok], c[at][ok] = first + p[ok], values[rank[p[ok]]]
        return ids, c

    def count(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        s = np.searchsorted(self.first, ids, side="right") - 1
        for k in np.unique(s).tolist():
            at = np.flatnonzero(s == k)
            first, _, values, rank = self.shards[k]
            out[at] = values[rank[ids[at] - first]]
        return out


class Level:
    """Level 2 or 3, in shards by range of context."""

    def __init__(self, path: str, name: str, shards: list[tuple[int, int, int]]):
        self.first, self.shards, at = np.array([lo for _, lo, _ in shards], np.int64), [], 0
        for k, lo, n in shards:
            a = map_arrays(path, f"{name}-{k:06d}")
            self.shards.append((lo, at, EliasFano(a, "pointer"), EliasFano(a, "child"), a))
            at += n
        self.start, self.n = np.array([x[1] for x in self.shards], np.int64), at

    def find(self, ctx: np.ndarray, child: np.ndarray, rates: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the child of a context or -1, log10 of the context's backoff, log10 of the n-gram where it is found; both 0 without rates).
        A child of -1 is looked for nowhere.

        Contexts ascend, so those of a shard, and equal ones, stand side by side."""
        place, back, prob = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx)), np.zeros(len(ctx))
        for k, at in _runs(ctx, self.first):
            lo, first, pointer, ids, a = self.shards[k]
            own = ctx[at] - lo
            new = np.concatenate(([True], own[1:] != own[:-1]))
            inverse, own = np.cumsum(new) - 1, own[new]
            n = int(np.searchsorted(own, pointer.n - 1))  # those beyond are no contexts of this shard
            begin, end = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            begin[:n], end[:n] = pointer.pairs(own[:n])
            if rates:
                log = np.zeros(len(own))
                log[:n] = a["back"][own[:n]].astype(float) / -STEP
                back[at] = log[inverse]
            base = np.zeros(len(own), U)
            some = np.flatnonzero((begin > 0) & (end > begin))
            base[some] = ids.access(begin[some] - 1)
            to = np.flatnonzero((child[at] >= 0) & (end > begin)[inverse])
            of = inverse[to]
            p = ids.find(base[of] + child[at][to].astype(U), begin[of], end[of])
            hit = np.flatnonzero(p >= 0)
            place[at][to[hit]] = first + p[hit]
            if rates:
                prob[at][to[hit]] = a["prob"][p[hit]].astype(float) / -STEP
        return place, back, prob

    def _of(self, place: np.ndarray, get) -> np.ndarray:
        out = np.zeros(len(place))
        order = np.argsort(place)
        for k, at in _runs(place[order], self.start):
            own = order[at]
            out[own] = get(self.shards[k][4], place[own] - self.shards[k][1])
        return out

    def log10(self, place: np.ndarray) -> np.ndarray:
        return self._of(place, lambda a, i: a["prob"][i].astype(float) / -STEP)

    def count(self, place: np.ndarray) -> np.ndarray:
        return self._of(place, lambda a, i: a["count.values"][a["count.rank"][i]])


class Trie:
    """What the training wrote: paths and sizes; levels are mapped where they are used."""

    _mapped: dict[str, tuple] = {}

    def __init__(self, path: str, n_shards: int, cutoff: int):
        self.path, self.n_shards, self.cutoff, self.sizes, self.bigrams, self.trigrams = path, n_shards, cutoff, [], None, None
        self.N = self.V = 0

    def levels(self) -> tuple[Words, Level | None, Level | None]:
        if (found := Trie._mapped.get(self.path)) is None or sum(x is not None for x in found) != 1 + (self.bigrams is not None) + (self.trigrams is not None):
            Trie._mapped.clear()
            found = Trie._mapped[self.path] = (Words(self.path, self.sizes, self.n_shards), *(Level(self.path, n, s) if s is not None else None for n, s in (("bigrams", self.bigrams), ("trigrams", self.trigrams))))
        return found


def _hashed(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the words of documents that stand one after the other in data; first: where they begin, ascending. Eight bytes of a word at once,
    so that its bytes need no numbers of their own; words of up to eight bytes and one length have different hashes."""
    n = len(data)
    held = np.zeros(n + 8, np.uint8)
    np.bitwise_or(data, (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5), out=held[:n])  # A-Z
    eight = np.ndarray((n + 1,), "<u8", held, strides=(1,))
    edge = np.zeros(n + 2, bool)  # between a byte and the one before it a word begins or ends
    word = np.zeros(n + 2, bool)
    np.logical_and(data != 0x20, data - np.uint8(9) >= 5, out=word[1:-1])
    np.not_equal(word[1:], word[:-1], out=edge[:-1])
    inner = first[(first > 0) & (first < n)]
    cut = inner[word[inner] & word[inner + 1]]  # a word that ends where the next document begins with one
    at = np.flatnonzero(edge[: n + 1])
    begin, end = at[::2], at[1::2]
    if len(cut):
        cut = np.unique(cut)
        after = np.searchsorted(begin, cut)
        begin, end = np.insert(begin, after, cut), np.insert(end, after - 1, cut)
    size = end - begin
    h = mix(eight[begin] & _MASKS[np.minimum(size, 8)] ^ size.astype(U) << U(57))
    own, left = np.flatnonzero(size > 8), size
    while len(own):
        left = left[own] - 8 if left is size else left
        part = eight[end[own] - left] & _MASKS[np.minimum(left, 8)]
        h[own] = mix(h[own] * U(0xD6E8FEB86659FD93) ^ part)
        go = np.flatnonzero(left > 8)
        own, left = own[go], left[go] - 8
    return h, begin


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the text's words, and of the end."""
    h, _ = _hashed(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8), np.zeros(1, np.int64))
    return np.append(h, U(END))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique of hashes, with the inverse: sorted by their upper bits with the place in the lower ones; if two share the upper bits, in full."""
    low = len(h).bit_length()
    key = np.sort(h >> U(low) << U(low) | np.arange(len(h), dtype=U))
    order = (key & U((1 << low) - 1)).view(np.int64)
    g = h[order]
    new = np.concatenate(([True], g[1:] != g[:-1]))
    at = np.flatnonzero(new)
    if not (g[at[1:]] > g[at[:-1]]).all():
        return np.unique(h, return_inverse=True)
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return g[at], inverse


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _parts(batches, training: bool):
    """(ids, token hashes, where documents end) of documents of about CHUNK tokens together."""
    for b in batches:
        if training:
            b = b.filter(pa.array([not held_out(d) for d in b.column(0).to_pylist()], pa.bool_()))
        data, offsets = text_buffer(b.column(1))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 6 * CHUNK, side="right")) - 1)
            first = offsets[at : to + 1] - offsets[at]
            h, place = _hashed(data[offsets[at] : offsets[to]], first[:-1])
            n = np.diff(np.searchsorted(place, first))
            out = np.full(len(h) + len(n), END, U)
            out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
            yield b.column(0).slice(at, to - at).to_pylist(), out, np.cumsum(n + 1)
            at = to
        settle()


def _pairs(ctx: np.ndarray, child: np.ndarray) -> np.ndarray:
    """Contexts and children in one number each; a context of -1 stands behind all others, where nothing is found."""
    return ctx.view(U) << U(32) | (child + 1).view(U)


def _unpaired(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key >> U(32)).view(np.int64), (key & U(0xFFFFFFFF)).view(np.int64) - 1


def _looked_up(h: np.ndarray, ends: np.ndarray, trie: Trie, rates: bool = False):
    """For the tokens h: ids of words that reach the cutoff (else -1), counts, places of bigrams that end at them (else -1), log10 backoffs of the word before,
    log10 of the bigrams (both 0 without rates)."""
    level1, level2, _ = trie.levels()
    distinct, inverse = _distinct(h)
    ids, c = level1.find(distinct)
    ids[c < trie.cutoff] = -1
    w, c = ids[inverse], c[inverse]
    first = np.zeros(len(h), bool)
    first[0] = True
    first[ends[:-1]] = True
    before = np.concatenate(([-1], w[:-1]))
    before[first] = -1
    if level2 is None:
        return w, c, before, np.full(len(h), -1, np.int64), np.zeros(len(h)), np.zeros(len(h))
    key, inverse = np.unique(_pairs(before, w), return_inverse=True)  # a missing word has its context's backoff, too
    place, back, prob = level2.find(*_unpaired(key), rates)
    if not rates:
        return w, c, before, place[inverse], back, prob
    place, back, prob = place[inverse], back[inverse], prob[inverse]
    return w, c, before, place, back, prob


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    """Numbers as the planes of their lower bytes: (how many planes, their bytes)."""
    n = -(-int(x.max()).bit_length() // 8) if len(x) else 0
    return n, np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def pack(keys: np.ndarray, c: np.ndarray) -> bytes:
    """Ascending distinct keys with counts."""
    (a, keys_), (b, counts) = _planes(np.diff(keys)), _planes(c.astype(U) - U(1))
    return struct.pack("<QQBB", len(keys), int(keys[0]), a, b) + keys_ + counts


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, a, b = struct.unpack_from("<QQBB", blob)

    def numbers(count: int, planes: int, at: int) -> np.ndarray:
        out = np.zeros((count, 8), np.uint8)
        out[:, :planes] = np.frombuffer(blob, np.uint8, count * planes, at).reshape(planes, count).T
        return out.view("<u8")[:, 0]

    d = numbers(n - 1, a, 18)
    return np.cumsum(np.concatenate(([U(first)], d)), dtype=U), numbers(n, b, 18 + (n - 1) * a).astype(np.int64) + 1


def _by_shard(docs: DataFrame, keys, fence: np.ndarray, write, schema: str) -> list:
    """write(shard, keys, counts) for each shard, in one task each; returns what it gives.

    keys(hashes, ends) gives the keys of a part of the training tokens; a part is summed before the shuffle. fence: the least key of each shard.
    """

    def count(batches):
        for _, h, ends in _parts(batches, True):
            k, c = np.unique(keys(h, ends), return_counts=True)
            at = np.append(np.searchsorted(k, fence), len(k))
            some = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pack(k[at[i] : at[i + 1]], c[at[i] : at[i + 1]]) for i in some], pa.binary())], names=["shard", "blob"])

    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(shard, []).append(unpack(blob.as_py()))
        for shard in sorted(held):
            own = held.pop(shard)
            k, c = (np.concatenate([x[i] for x in own]) for i in (0, 1))
            own.clear()
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            yield pa.RecordBatch.from_pylist([write(shard, k[first], np.add.reduceat(c, first))])
            settle()

    dealt = docs.mapInArrow(count, "shard int, blob binary").repartitionById(len(fence), F.col("shard"))
    return dealt.mapInArrow(run, schema).collect()


def _marks(c: np.ndarray) -> list[int]:
    """Up to 32 places that cut counts into parts of about one sum, and the sum up to each: place, sum, place, sum ..."""
    upto = np.cumsum(c)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, 33) / 32))
    return np.stack((at + 1, upto[at]), axis=1).reshape(-1).tolist()


def _fence(marks: list[tuple[int, list[int]]], n_shards: int) -> np.ndarray:
    """The first contexts of at most n_shards shards of about equal sums; marks: (first context of a file, its _marks), in order."""
    place, upto, total = [0], [0], 0
    for first, m in marks:
        place += [first + x for x in m[::2]]
        upto += [total + x for x in m[1::2]]
        total = upto[-1]
    at = np.searchsorted(upto, np.arange(n_shards) * total / n_shards)
    return np.unique(np.array(place)[at])


def _level_arrays(ctx: np.ndarray, child: np.ndarray, n_ctx: int, c: np.ndarray, c_ctx: np.ndarray, lower: np.ndarray) -> dict[str, np.ndarray]:
    """A shard of a level: entries sorted by context and child; c_ctx: counts of their contexts; lower: log10 of their shorter n-grams."""
    number = np.bincount(ctx, minlength=n_ctx)
    pointer = np.concatenate(([0], np.cumsum(number)))
    last = np.flatnonzero(np.concatenate((ctx[1:] != ctx[:-1], [True])))
    base = np.concatenate(([0], np.cumsum(child[last])))[:-1]
    share = (c - DISCOUNT) / c_ctx
    back = np.maximum(1 - np.bincount(ctx, share, n_ctx), 1e-12)
    back_q = quantised(np.log10(back))
    prob = share + 10.0 ** (back_q[ctx].astype(float) / -STEP + lower)
    return ef_build(pointer, "pointer") | ef_build(child + np.repeat(base, number[ctx[last]]), "child") | {"prob": quantised(np.log10(prob)), "back": back_q}


def train(docs: DataFrame, path: str | None = None, cutoff: int = 1) -> Trie:
    """Counts the documents (doc_id, text) that are not held out and writes the trie under path; bigrams and trigrams of a count below cutoff are left out."""
    spark = docs.sparkSession
    n_shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    trie = Trie(path or work_path(spark, "trie"), n_shards, cutoff)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def write_words(shard, h, c):
        write_arrays(trie.path, f"words-{shard:06d}", ef_build(h, "hash") | coded(c, "count"))
        return {"shard": shard, "n": len(h), "c": int(c.sum()), "marks": _marks(c)}

    got = sorted(tuple(r) for r in _by_shard(cols, lambda h, ends: h, word_fence(n_shards), write_words, "shard long, n long, c long, marks array<long>"))
    trie.sizes, trie.V, trie.N = [(k, n) for k, n, *_ in got], sum(x[1] for x in got), sum(x[2] for x in got)
    if trie.V >= 1 << 32:
        raise ValueError("more than 2**32 - 1 distinct tokens")

    def level(name, keys, n_ids, marks, counts_of, lower_of, counted):
        """Keys are context * n_ids + child; marks: those of the contexts' counts."""
        first, at = [], 0
        for n, m in marks:
            first.append((at, m))
            at += n
        fence = _fence(first, n_shards).astype(U) * U(n_ids)

        def write(shard, key, c):
            if cutoff > 1:
                key, c = key[c >= cutoff], c[c >= cutoff]
            if not len(key):
                return {"shard": shard, "lo": -1, "n": 0, "marks": []}
            a, b = (x.astype(np.int64) for x in np.divmod(key, U(n_ids)))
            lo, new = int(a[0]), np.concatenate(([True], a[1:] != a[:-1]))
            c_ctx = counts_of(a[new])[np.cumsum(new) - 1]
            arrays = _level_arrays(a - lo, b, int(a[-1]) - lo + 1, c, c_ctx, lower_of(b))
            write_arrays(trie.path, f"{name}-{shard:06d}", arrays | (coded(c, "count") if counted else {}))
            return {"shard": shard, "lo": lo, "n": len(key), "marks": _marks(c)}

        rows = _by_shard(cols, keys, fence, write, "shard long, lo long, n long, marks array<long>")
        return sorted((tuple(r) for r in rows if r.n), key=lambda x: x[1])

    def pairs(h, ends):
        w, _, before, *_ = _looked_up(h, ends, trie)
        ok = (before >= 0) & (w >= 0)
        return before[ok].astype(U) * U(trie.V) + w[ok].astype(U)

    total = trie.N + trie.V + 1
    if not trie.V:
        trie.bigrams = trie.trigrams = []
        return trie
    got2 = level("bigrams", pairs, trie.V, [(n, m) for _, n, _, m in got], lambda a: trie.levels()[0].count(a), lambda b: np.log10((trie.levels()[0].count(b) + 1) / total), True)
    n_bigrams = sum(x[2] for x in got2)
    if n_bigrams >= 1 << 32:
        raise ValueError("more than 2**32 - 1 bigrams; raise the cutoff")
    trie.bigrams = [x[:3] for x in got2]

    def triples(h, ends):
        _, _, _, place, *_ = _looked_up(h, ends, trie)
        ok = np.flatnonzero((place[1:] >= 0) & (place[:-1] >= 0)) + 1  # a place is -1 at a document's start
        return place[ok - 1].astype(U) * U(n_bigrams) + place[ok].astype(U)

    got3 = level("trigrams", triples, n_bigrams, [(n, m) for *_, n, m in got2], lambda a: trie.levels()[1].count(a), lambda b: trie.levels()[1].log10(b), False) if n_bigrams else []
    trie.trigrams = [x[:3] for x in got3]
    return trie


def score(h: np.ndarray, ends: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, log10 of the base, log10 of the model) of each token."""
    w, c, before, place, back, prob = _looked_up(h, ends, trie, True)
    level3 = trie.levels()[2]
    base = np.log10((c + 1) / (trie.N + trie.V + 1))
    out = base + np.where(before >= 0, back, 0.0)
    out = np.where(place >= 0, prob, out)
    key, inverse = np.unique(_pairs(np.where(before >= 0, np.concatenate(([-1], place[:-1])), -1), place), return_inverse=True)
    p, b, x = level3.find(*_unpaired(key))
    out = np.where((p >= 0)[inverse], x[inverse], out + b[inverse])
    return c, base, out


def lm_scores(docs: DataFrame, trie: Trie | None = None, cutoff: int = 1) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_token.

    Trained on documents whose crc32(doc_id as text) mod 7 is not 2, whole texts. A null text counts as empty (its end alone); a row without
    an id is a training row; repeated rows count as often as they stand there; no documents give no rows; texts of any length are taken whole; extra
    columns are ignored. cutoff: the least count of bigrams and trigrams that the model keeps; 1 keeps all, as the query does.
    """
    trie = trie or train(docs, cutoff=cutoff)

    def run(batches):
        for ids, h, ends in _parts(batches, False):
            c, base, full = score(h, ends, trie)
            start = np.concatenate(([0], ends[:-1]))
            n = ends - start
            total = np.add.reduceat(full, start)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held_out(d) for d in ids]), pa.array(n.astype(np.int64)), pa.array(np.add.reduceat((c > 0).astype(np.int64), start)), pa.array(np.full(len(ids), trie.N, np.int64)),
                                              pa.array(np.add.reduceat(base, start)), pa.array(total), pa.array(total / n * -np.log2(10))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_token"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_token double")
