"""Token-id output: texts encoded by a public tokenizer, Re-Pair compressed shard files, read back by document.

Documents are range-partitioned by doc_id, so the files in order hold the documents in order. A file is a run of blocks;
each block of at most BLOCK_IDS ids (or one longer document) has its own grammar: frequent neighbouring ids are repeatedly
replaced by nonterminals, many pairs a round. A block stores its rules, the expansion length of each nonterminal, the
compressed sequence and each document's place in it, so a document is decoded without the ones before it.

File format (little-endian): magic b"RPR1"; blocks; index of documents (doc_id int64, block offset int64, n_ids int64,
first symbol int64, last symbol int64); then int64 position of the index, int64 number of documents, magic. Block: int64 base,
n_rules, n_symbols; rules (left, right) uint32; expansion lengths uint32; symbols uint32. base: first nonterminal. A document's end id
ends its symbols: no pair spans two documents.

The tokenizer's own encode of each distinct pre-token is remembered (BPE never crosses pre-tokens), under its bytes. Hashes only tell which
of them a pre-token may be; all are compared with the bytes kept for it, and a stretch with another one of the same hash, like texts with
characters beyond Latin-1 or with a special token's string, goes to the tokenizer as it is.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, materialize, mix, work_path

END = 2
BLOCK_IDS = 1 << 21
MAGIC = b"RPR1"
# Letters, numbers and white space up to U+00FF, and the contractions of the byte-level pre-token pattern.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzªµºÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_NUMBERS = "0123456789²³¹¼½¾"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pre-tokens that a worker remembers, and characters that it splits at once.
CACHE, CHUNK = 1_500_000, 1 << 20

_S, _L, _N, _O = 0, 1, 2, 3
_CLASS = np.full(256, _O, np.uint8)
for _k, _chars in ((_L, _LETTERS), (_N, _NUMBERS), (_S, _SPACES)):
    _CLASS[[ord(c) for c in _chars]] = _k
_LETTER = frozenset(map(ord, _LETTERS))
_BYTE = mix(np.arange(1, 257, dtype=U))
_POWER = np.cumprod(np.concatenate(([U(1)], np.full(CHUNK, U(0xD6E8FEB86659FD93)))))
_UNPOWER = np.cumprod(np.concatenate(([U(1)], np.full(CHUNK, U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))))))


def starts(c: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Where the pre-tokens of Latin-1 texts begin, which stand one after the other from `first` on (one text if None): runs of letters, numbers or
    other characters take one space before them; white space before such a run leaves its last character apart; contractions are cut off."""
    edge = np.zeros(len(c) + 1, bool)  # a text begins or ends
    edge[0] = edge[-1] = True
    if first is not None:
        edge[first] = True
    k = _CLASS[c]
    s = k == _S
    before, after = np.concatenate(([False], s[:-1])) & ~edge[:-1], np.concatenate((s[1:], [True])) | edge[1:]
    out = np.concatenate(([True], k[1:] != k[:-1])) | edge[:-1]  # a run begins
    out &= ~(~s & before & (np.concatenate(([0], c[:-1])) == 0x20))  # its space has been taken
    out |= s & ~after  # the last white space before a run
    for i in np.flatnonzero(out & (c == 0x27)).tolist():
        rest = "" if edge[i + 1] else c[i + 1 : i + (2 if edge[i + 2] else 3)].tobytes().decode("latin-1")
        if n := next((len(x) for x in _CONTRACTIONS if rest.startswith(x)), 0):
            out[i + 1] = False
            if not edge[i + 1 + n] and k[i + 1 + n] == _L:
                out[i + 1 + n] = True
            if n == 2:
                out[i + 2] = False
    return out


class Encoder:
    """A tokenizers file; encode_batch() gives the library's ids of texts."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # byte-level: a character of a token's string is a byte
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        """What is remembered: for each slot the bytes of a pre-token in pool and its ids in flat; slots by hash, in an open-addressed table."""
        self.known, self.keys, self.slots = 0, np.zeros(1 << 17, U), np.zeros(1 << 17, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.pool, self.pooled = np.zeros(1 << 16, np.uint8), 0
        self.at, self.size, self.begin, self.long = (np.zeros(1 << 16, np.int64) for _ in range(4))

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slots of hashes, or -1."""
        out, todo, place, last = np.full(len(key), -1, np.int64), np.arange(len(key)), (key & U(len(self.keys) - 1)).astype(np.int64), len(self.keys) - 1
        while len(todo):
            there = self.keys[place]
            same = there == key[todo]
            out[todo[same]] = self.slots[place[same]]
            go = np.flatnonzero(~same & (there != 0))
            todo, place = todo[go], place[go] + 1 & last
        return out

    def _enter(self, key: np.ndarray, slot: np.ndarray) -> None:
        """Distinct hashes that the table doesn't hold."""
        if 2 * self.known > len(self.keys):
            held = np.flatnonzero(self.keys)
            key, slot = np.concatenate((self.keys[held], key)), np.concatenate((self.slots[held], slot))
            n = len(self.keys)
            while 2 * self.known > n:
                n *= 2
            self.keys, self.slots = np.zeros(n, U), np.zeros(n, np.int32)
        last = len(self.keys) - 1
        place = (key & U(last)).astype(np.int64)
        while len(key):
            free = self.keys[place] == 0
            self.keys[place[free]] = key[free]
            mine = self.keys[place] == key
            self.slots[place[mine]] = slot[mine]
            key, slot, place = key[~mine], slot[~mine], place[~mine] + 1 & last

    @classmethod
    def get(cls, path: str) -> Encoder:
        """One for each Python worker."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pre_tokens: list[bytes], key: np.ndarray) -> None:
        """Encodes pre-tokens of these hashes. Those of a space and letters are joined, as the tokenizer splits them at the spaces again, and told apart by their ids' bytes."""
        plain = np.fromiter((len(x) > 1 and x[0] == 0x20 and x[1] in _LETTER for x in pre_tokens), bool, len(pre_tokens))
        for joined in (False, True):
            all_ = np.flatnonzero(plain == joined)
            for at in range(0, len(all_), 20_000):
                own = all_[at : at + 20_000]
                part = [pre_tokens[i] for i in own.tolist()]
                data, ends = np.frombuffer(b"".join(part), np.uint8), np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
                if joined:
                    flat = np.fromiter(chain.from_iterable(self._ids_of([b"".join(part[k : k + 500]).decode("latin-1") for k in range(0, len(part), 500)])), np.uint32)
                    in_utf8 = ends + np.concatenate(([0], np.cumsum(data >= 0x80)))[ends]
                    upto = np.cumsum(self.n_bytes[flat])
                    last = np.searchsorted(upto, in_utf8)
                    if len(upto) and last[-1] < len(upto) and np.array_equal(upto[last], in_utf8) and upto[-1] == in_utf8[-1]:
                        self._keep(data, ends, key[own], flat, np.diff(np.concatenate(([-1], last))))
                        continue
                ids = self._ids_of([x.decode("latin-1") for x in part])
                self._keep(data, ends, key[own], np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _keep(self, data: np.ndarray, ends: np.ndarray, key: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        def room(a: np.ndarray, size: int) -> np.ndarray:
            return a if len(a) >= size else np.concatenate((a, np.zeros(max(size, 2 * len(a)) - len(a), a.dtype)))

        first, self.known = self.known, self.known + len(n)
        self.flat, self.pool = room(self.flat, self.used + len(flat)), room(self.pool, self.pooled + len(data))
        self.at, self.size, self.begin, self.long = (room(x, self.known) for x in (self.at, self.size, self.begin, self.long))
        self.flat[self.used : self.used + len(flat)] = flat
        self.pool[self.pooled : self.pooled + len(data)] = data
        own = slice(first, self.known)
        self.at[own], self.size[own] = self.used + np.cumsum(n) - n, n
        self.long[own] = np.diff(np.concatenate(([0], ends)))
        self.begin[own] = self.pooled + ends - self.long[own]
        self.used += len(flat)
        self.pooled += len(data)
        self._enter(key, np.arange(first, self.known, dtype=np.int32))

    def _split(self, data: bytes, cuts: list[int]) -> list[np.ndarray] | None:
        """The ids of texts that stand one after the other in data, of at most CHUNK characters; cuts: where they end. None if two pre-tokens have one hash."""
        c = np.frombuffer(data, np.uint8)
        first = np.flatnonzero(starts(c, np.array([0, *cuts[:-1]]))) if len(c) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(c)) if len(c) else first
        total = np.concatenate(([U(0)], np.cumsum(_BYTE[c] * _POWER[: len(c)], dtype=U)))
        size = ends - first
        key = mix((total[ends] - total[first]) * _UNPOWER[first] ^ size.astype(U) << U(48)) | U(1)
        code = self._find(key)
        if len(new := np.flatnonzero(code < 0)):
            own, where = np.unique(key[new], return_index=True)
            self._learn([data[a:b] for a, b in zip(first[new[where]].tolist(), ends[new[where]].tolist(), strict=True)], own)
            code[new] = self._find(key[new])
        if not (np.array_equal(size, self.long[code]) and np.array_equal(c, self.pool[np.arange(len(c)) + np.repeat(self.begin[code] - first, size)])):
            return None
        n = self.size[code]
        stop = np.cumsum(n)
        ids = self.flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.at[code] - stop + n, n)]
        last = np.searchsorted(first, cuts)  # pre-tokens up to each cut
        return np.split(ids, np.concatenate(([0], stop))[last[:-1]]) if len(cuts) > 1 else [ids]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        held, size = [], 0
        if self.known > CACHE:
            self._forget()

        def whole(t: str) -> np.ndarray:
            return np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)

        def flush() -> None:
            nonlocal size
            if held:
                cuts = np.cumsum([len(d) for _, d in held]).tolist()
                split = self._split(b"".join(d for _, d in held), cuts)
                for k, (i, _) in enumerate(held):
                    out[i] = split[k] if split else whole(texts[i])
                held.clear()
                size = 0

        for i, t in enumerate(texts):
            try:
                d = t.encode("latin-1")
            except UnicodeEncodeError:
                d = None
            if d is None or len(d) > CHUNK or any(x in t for x in self.special):
                out[i] = whole(t)
                continue
            if size + len(d) > CHUNK:
                flush()
            held.append((i, d))
            size += len(d)
        flush()
        return out


def re_pair(seq: np.ndarray, base: int, fence: int, least: int = 4, most: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths): round by round the most frequent pairs, about `most` at once, become nonterminals from base on, until no pair stands
    `least` times: a rule takes 12 bytes and saves 4 for each use, so rarer pairs gain nothing.
    Ids equal to fence take no part. Overlapping occurrences are taken from the left, every second one.

    Once a round has taken all pairs that stand `least` times, each occurrence of them is replaced or has lost a side to its neighbour, and others have
    not become more. Only pairs with a symbol of that round can then stand `least` times, so the next round looks at the places beside those alone."""
    s, rules, n_rules, lengths = seq.astype(np.uint32), [], 0, []
    size_of, at = np.ones(base, np.uint32), None  # at: the places of pairs to look at, ascending; None: all
    while len(s) > 1:
        if at is None:
            at = np.flatnonzero((s[:-1] != fence) & (s[1:] != fence))
        else:
            at = at[(s[at] != fence) & (s[at + 1] != fence)]
        wide, deep = (base + n_rules).bit_length(), len(s).bit_length()
        if 2 * wide + deep <= 64:  # pair and place in one number: sorted, each pair's places stand together
            key = s[at].astype(U) << U(wide) | s[at + 1]
            key = np.sort(key << U(deep) | at.astype(U))
            at, key = (key & U((1 << deep) - 1)).astype(np.int64), key >> U(deep)
        else:
            key = s[at].astype(U) << U(32) | s[at + 1]
            order = np.argsort(key, kind="stable")
            at, key, wide = at[order], key[order], 32
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        cut, frequent = least, count[count >= least]
        if not len(frequent):
            break
        if len(frequent) > most:
            cut = int(np.partition(frequent, len(frequent) - most)[len(frequent) - most])
        good = np.flatnonzero(count >= cut)
        pair = key[first[good]]
        name, of = np.zeros(len(s), np.uint32), np.repeat(count >= cut, count)
        at = at[of]
        name[at] = np.repeat(np.arange(base + n_rules, base + n_rules + len(good), dtype=np.uint32), count[good])
        at = np.flatnonzero(name) if len(at) > len(s) >> 4 else np.sort(at)
        gap = np.concatenate(([True], np.diff(at) != 1))  # runs of adjacent occurrences: every second one is taken
        run = np.maximum.accumulate(np.where(gap, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        left, right = (pair >> U(wide)).astype(np.uint32), (pair & U((1 << wide) - 1)).astype(np.uint32)
        new = size_of[left] + size_of[right]
        rules.append(np.stack((left, right), axis=1))
        n_rules += len(good)
        lengths.append(new)
        size_of = np.concatenate((size_of, new))
        s[at] = name[at]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        at -= np.arange(len(at))  # where the new symbols stand now
        if cut > least:
            at = None
        else:
            at = np.stack((at - 1, at), axis=1).reshape(-1)
            at = at[np.concatenate((at[1:] != at[:-1], [True])) & (at >= 0) & (at < len(s) - 1)]
    return s, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), np.concatenate(lengths) if lengths else np.zeros(0, np.uint32)


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of symbols. Rules are written out once, in order: the parts of a rule stand before it."""
    lengths = lengths.astype(np.int64)
    start = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.uint32)
    done = 0
    while done < len(rules):  # all rules whose parts are written out already
        part = rules[done:]
        ready = ((part < base) | (part - np.minimum(part, base) < done)).all(axis=1)
        stop = len(rules) if ready.all() else done + int(np.argmin(ready))
        at = start[done:stop]
        for side in (0, 1):
            x = rules[done:stop, side].astype(np.int64)
            _write_out(flat, at, x, base, flat, start, lengths)
            at = at + np.where(x < base, 1, lengths[np.maximum(x - base, 0)])
        done = stop
    x = symbols.astype(np.int64)
    n = np.where(x < base, 1, lengths[np.maximum(x - base, 0)]) if len(rules) else np.ones(len(x), np.int64)
    out = np.zeros(int(n.sum()), np.uint32)
    _write_out(out, np.cumsum(n) - n, x, base, flat, start, lengths)
    return out


def _write_out(out: np.ndarray, at: np.ndarray, x: np.ndarray, base: int, flat: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> None:
    """Writes the ids of symbols x to out, each from its place on."""
    small = x < base
    out[at[small]] = x[small]
    big, to = x[~small] - base, at[~small]
    if len(big):
        n = lengths[big]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = flat[np.repeat(start[big], n) + step]


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else re.sub(r"^(?:file:)?", "file://", path, count=1))


def write_shard(out, docs: Iterator[tuple[int, np.ndarray]], base: int) -> int:
    """Writes documents (doc_id, ids with the end id) and returns their number of ids."""
    index, block, held, total, pos = [], [], 0, 0, len(MAGIC)
    out.write(MAGIC)

    def flush() -> None:
        nonlocal held, pos
        if not block:
            return
        seq = np.concatenate([ids for _, ids in block])
        symbols, rules, lengths = re_pair(seq, base, END)
        stops = np.flatnonzero(symbols == END)
        ends = np.cumsum(np.concatenate([[0], np.add.reduceat((np.concatenate([ids for _, ids in block]) == END).astype(np.int64), np.cumsum([0] + [len(i) for _, i in block[:-1]]))]))
        for k, (d, ids) in enumerate(block):  # a document's text may hold the end id, too
            lo = int(stops[ends[k] - 1]) + 1 if ends[k] else 0
            index.append((d, pos, len(ids), lo, int(stops[ends[k + 1] - 1]) + 1))
        body = struct.pack("<qqq", base, len(rules), len(symbols)) + rules.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + symbols.astype("<u4").tobytes()
        out.write(body)
        pos += len(body)
        block.clear()
        held = 0

    for d, ids in docs:
        if held and held + len(ids) > BLOCK_IDS:
            flush()
        block.append((d, ids))
        held += len(ids)
        total += len(ids)
    flush()
    out.write(np.array(index, "<i8").tobytes())
    out.write(struct.pack("<qq", pos, len(index)) + MAGIC)
    return total


class ShardReader:
    """Random access to the documents of a shard file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        pos, n, magic = struct.unpack("<qq4s", file.read_at(20, size - 20))
        if magic != MAGIC:
            raise ValueError("not a shard file, or not a whole one")
        self.index = np.frombuffer(file.read_at(40 * n, pos), "<i8").reshape(n, 5)
        self._block: tuple[int, int, np.ndarray, np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.index)

    def _load(self, at: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        if not self._block or self._block[0] != at:
            base, r, m = struct.unpack("<qqq", self.file.read_at(24, at))
            body = self.file.read_at(12 * r + 4 * m, at + 24)
            self._block = at, base, np.frombuffer(body, "<u4", 2 * r).reshape(r, 2), np.frombuffer(body, "<u4", r, 8 * r), np.frombuffer(body, "<u4", m, 12 * r)
        return self._block

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own symbols and the block's rules."""
        _, at, n, lo, hi = (int(x) for x in self.index[k])
        _, base, rules, lengths, symbols = self._load(at)
        out = expand(symbols[lo:hi], base, rules, lengths)
        if len(out) != n:
            raise ValueError("a document's ids are not whole")
        return out

    def __iter__(self) -> Iterator[np.ndarray]:
        """The ids of all documents, block by block."""
        at = self.index[:, 1]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else []
        for a, b in zip(first, [*first[1:], len(at)], strict=True):
            _, base, rules, lengths, symbols = self._load(int(at[a]))
            ids, sizes = expand(symbols, base, rules, lengths), self.index[a:b, 2]
            if len(ids) != sizes.sum():
                raise ValueError("a block's ids are not whole")
            yield from np.split(ids, np.cumsum(sizes)[:-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, n_shards: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) into shard files under path; returns (shard, file, n_docs, n_ids), materialised.

    A null text counts as empty (its end id alone); null ids come first, as id -2**63; rows that repeat an id stay, one after the other.
    A task that runs again writes the same file anew and renames it into place.
    """
    spark = docs.sparkSession
    n_shards = n_shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = keyed.repartitionByRange(n_shards, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def run(batches):
        import uuid

        encoder = Encoder.get(tokenizer)
        base = max(encoder.tokenizer.get_vocab_size(), END + 1)
        shard, end, n_docs = None, np.array([END], np.uint32), 0

        def rows():
            nonlocal shard, n_docs
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    shard = part.column(2)[0].as_py()
                    n_docs += part.num_rows
                    for d, ids in zip(part.column(0).to_pylist(), encoder.encode_batch(part.column(1).to_pylist()), strict=True):
                        yield d, np.concatenate((ids, end))

        docs_ = rows()
        first = next(docs_, None)
        if first is None:
            return
        fs, root = open_store(path)
        fs.create_dir(root, recursive=True)
        name, part = f"{root}/shard-{shard:06d}.rpr", f"{root}/.{uuid.uuid4().hex}"

        def chained():
            yield first
            yield from docs_

        with fs.open_output_stream(part) as out:
            total = write_shard(out, chained(), base)
        fs.move(part, name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [f"shard-{shard:06d}.rpr"], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    return materialize(ordered.mapInArrow(run, "shard long, file string, n_docs long, n_ids long"), "shards")


def read_tokens(shards: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that write_tokens wrote; start counts over all shards.

    The running totals are of one number a shard.
    """
    spark = shards.sparkSession
    totals = sorted(shards.select("shard", "file", "n_ids").collect())
    starts, at = [], 0
    for shard, file, n in totals:
        starts.append((file, at))
        at += n
    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        fs, root = open_store(path)
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    shard = ShardReader(f)
                    ids, begins, sizes, sums = shard.index[:, 0], [], [], []
                    for x in shard:
                        begins.append(start)
                        sizes.append(len(x))
                        sums.append(zlib.crc32(x.astype("<u4").tobytes()))
                        start += len(x)
                null = ids == -(2**63)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(starts, "file string, start long").repartition(len(starts))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes docs to files and reads them back: see write_tokens and read_tokens."""
    path = path or work_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, tokenizer), path)
