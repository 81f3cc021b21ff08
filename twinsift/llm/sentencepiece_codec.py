"""SentencePiece-style encoding and decoding by a relational lattice.

Texts are cut where no piece reaches across (a pair of neighbouring characters that stands in no piece), which gives far fewer distinct
chunks than words. The distinct chunks of the corpus go through the lattice as relations: bounded-length substrings are exploded,
equi-joined to the piece table, grouped by chunk and folded by Viterbi in Spark's higher-order aggregate; the best path has the
least cost, cost(piece) = 5 + ln(2 - score). The chunk table is written to the shared folder as files sorted by hash, which the encoding
tasks map into memory; documents themselves are not shuffled.

Spaces stand for the model's U+2581, and a space is put before the text, as the model has it. Characters in no piece become their
UTF-8 bytes' pieces, U+2581 of a text among them, so decoding gives back every text exactly. The path is that of the lattice, not of
the merges that the model file was made for: ids may differ from the library's, see the README.

Chunks are known by 64-bit hashes. Each text is decoded again where it was encoded; one that does not come back, as two of its chunks
have one hash, is folded by itself.
"""

from __future__ import annotations

import functools
import math
import os
import tempfile
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, mix, settle, work_path
from .token_output import open_store

#: Longer chunks are folded by the same rule in the encoding task, as a fold by arrays copies the path at each step. No word of the given tables
#: is as long; such chunks are runs of one character or data without blanks.
LONG = 256
#: Hashes that a task remembers as sent; beyond, some chunks are sent again and grouped after the shuffle.
SEEN = 1 << 19
#: Partitions of the lattice for each of the session's shuffle partitions.
FINER = 8
#: Codes that are hashed at once.
SPAN = 1 << 18
UNKNOWN = 1_000_000.0
_BASE = U(0xD6E8FEB86659FD93)


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[bytes] = []
        self.byte0, self.table = -1, {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(p[1:-1], 16)
                self.byte0 = i - b
                self.text.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                p = p.replace("▁", " ")
                self.text.append(p.encode())
                self.table[p] = (i, 5 + math.log(2 - sp.get_score(i)))
        self.longest = max(map(len, self.table))
        pairs = sorted({(ord(a), ord(b)) for p in self.table for a, b in zip(p, p[1:], strict=False)})
        self.pairs = np.array([a << 21 | b for a, b in pairs], np.int64)
        self.latin = np.zeros((256, 256), bool)
        for a, b in pairs:
            if a < 256 and b < 256:
                self.latin[a, b] = True

    def cuts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the text after a space, where chunks begin)."""
        try:
            c = np.frombuffer(b" " + text.encode("latin-1"), np.uint8)
            joined = self.latin[c[:-1], c[1:]]
        except UnicodeEncodeError:
            c = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32)
            k = c[:-1].astype(np.int64) << 21 | c[1:]
            at = np.minimum(np.searchsorted(self.pairs, k), len(self.pairs) - 1)
            joined = self.pairs[at] == k
        return c, np.concatenate(([0], np.flatnonzero(~joined) + 1))

    def fold(self, chunk: str) -> list[int]:
        """The ids of a chunk: the lattice's best path, as the relational fold has it."""
        n = len(chunk)
        cost, start, piece = array("d", [0.0]) + array("d", [math.inf]) * n, array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                i, c = self.table.get(chunk[s:e], (-1, UNKNOWN if e - s == 1 else math.inf))
                if cost[s] + c < cost[e]:
                    cost[e], start[e], piece[e] = cost[s] + c, s, i
        out, e = [], n
        while e:
            out.append(piece[e])
            e = start[e]
        return out[::-1]

    def with_bytes(self, chunk: str, ids: list[int]) -> list[int]:
        """ids with each -1 as the bytes of its character."""
        if -1 not in ids:
            return ids
        out, at = [], 0
        for i in ids:
            if i < 0:
                out += [self.byte0 + b for b in chunk[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                out.append(i)
                at += len(self.text[i].decode())
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        return b"".join([text[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


@functools.lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """One for each Python process."""
    return Pieces(path)


_POWER = np.cumprod(np.concatenate(([U(1)], np.full(SPAN + LONG, _BASE))))
_UNPOWER = np.cumprod(np.concatenate(([U(1)], np.full(SPAN + LONG, U(pow(int(_BASE), -1, 1 << 64))))))


def _hashes(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk, a polynomial of its mixed codes and its length; 0 for chunks of more than LONG codes."""
    end = np.append(begin[1:], len(codes))
    out, lo = np.zeros(len(begin), U), 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + SPAN, side="right")))
        first, last = begin[lo:hi], end[lo:hi]
        if hi - lo > 1 or last[0] - first[0] <= LONG:
            c = codes[first[0] : last[-1]]
            total = np.concatenate(([U(0)], np.cumsum(mix(c.astype(U) + U(1)) * _POWER[: len(c)], dtype=U)))
            first, size = first - begin[lo], last - first
            h = mix((total[first + size] - total[first]) * _UNPOWER[first] ^ size.astype(U) << U(48))
            out[lo:hi] = np.where(size <= LONG, np.maximum(h, U(1)), U(0))
        lo = hi
    return out


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("latin-1" if codes.dtype == np.uint8 else "utf-32-le", "surrogatepass" if codes.dtype != np.uint8 else "strict")


def chunks(docs: DataFrame, model: str) -> DataFrame:
    """(h, chunk): the corpus's distinct chunks of at most LONG characters."""

    def run(batches):
        pieces, seen = pieces_of(model), set()

        def rows(keys, texts):
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys, U).view(np.int64)), pa.array(texts, pa.string())], names=["h", "chunk"])

        for b in batches:
            keys, texts = [], []
            for t in b.column(0):
                c, begin = pieces.cuts(t.as_py() or "")
                h, first = np.unique(_hashes(c, begin), return_index=True)
                end = np.append(begin[1:], len(c))
                for k, i in zip(h.tolist(), first.tolist(), strict=True):
                    if k and k not in seen:
                        seen.add(k)
                        keys.append(k)
                        texts.append(_text(c[begin[i] : end[i]]))
                if len(seen) > SEEN:
                    seen.clear()
                if len(keys) > 50_000:
                    yield rows(keys, texts)
                    keys, texts = [], []
            if keys:
                yield rows(keys, texts)
            settle()

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, chunk string")
    # a number of partitions of their own: the lattice makes a hundred rows of each, which their bytes do not show, and sorts them by chunk in memory
    return found.repartition(FINER * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "h").dropDuplicates(["h", "chunk"])


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame([(p, i, c) for p, (i, c) in sorted(pieces.table.items())], "piece string, id int, cost double")


def lattice(chunks_: DataFrame, table: DataFrame, longest: int, most_bytes: int = 32 << 20) -> DataFrame:
    """(h, chunk, ids): each chunk's best path; -1 for a character that no piece holds. The piece table is broadcast below most_bytes."""
    small = table.select(F.sum(F.octet_length("piece") + 40)).first()[0] or 0
    table = F.broadcast(table) if small <= most_bytes else table
    n = F.length("chunk")
    spans = chunks_.withColumn("s", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("e", F.explode(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + F.lit(longest)))))
    spans = spans.withColumn("piece", F.substring("chunk", F.col("s") + 1, F.col("e") - F.col("s")))
    edges = spans.join(table, "piece", "left").filter("id IS NOT NULL OR e = s + 1")
    edge = F.struct("e", "s", F.coalesce("cost", F.lit(UNKNOWN)).alias("c"), F.coalesce("id", F.lit(-1)).alias("i"))
    grouped = edges.groupBy("h", "chunk").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    grouped = grouped.withColumn("path", F.expr("""
        aggregate(edges, array(named_struct('c', 0D, 's', 0, 'i', -1)), (best, x) ->
          CASE WHEN size(best) = x.e THEN concat(best, array(named_struct('c', best[x.s].c + x.c, 's', x.s, 'i', x.i)))
               WHEN best[x.s].c + x.c < best[x.e].c THEN concat(slice(best, 1, x.e), array(named_struct('c', best[x.s].c + x.c, 's', x.s, 'i', x.i)))
               ELSE best END)"""))
    ids = F.expr("""
        aggregate(sequence(1, size(path)), named_struct('at', size(path) - 1, 'ids', CAST(array() AS array<int>)), (a, x) ->
          CASE WHEN a.at = 0 THEN a ELSE named_struct('at', path[a.at].s, 'ids', concat(array(path[a.at].i), a.ids)) END, a -> a.ids)""")
    return grouped.select("h", "chunk", ids.alias("ids"))


def _write_table(encoded: DataFrame, path: str, model: str, n_shards: int) -> list[tuple[int, str]]:
    """Writes the chunk table as one file for each range of hashes: int64 n; hashes (sorted), ends of ids, ids (uint32)."""
    shard = (F.shiftrightunsigned("h", 48) * F.lit(n_shards) / 65536).cast("int")
    dealt = encoded.withColumn("shard", shard).repartition(n_shards, "shard").select("shard", "h", "chunk", "ids").sortWithinPartitions("shard", F.shiftrightunsigned("h", 1), "h")

    def run(batches):
        import uuid

        pieces = pieces_of(model)
        held: dict[int, tuple[list, list]] = {}

        def write(k):
            h, ids = held.pop(k)
            h, order = np.unique(np.array(h, np.int64).view(U), return_index=True)  # one of two chunks of a hash, see encode()
            ids = [ids[i] for i in order]
            fs, root = open_store(path)
            fs.create_dir(root, recursive=True)
            part, name = f"{root}/.{uuid.uuid4().hex}", f"{root}/chunks-{k:06d}"
            with fs.open_output_stream(part) as out:
                out.write(np.array([len(h)], "<i8").tobytes() + h.tobytes() + np.cumsum([len(i) for i in ids]).astype("<i8").tobytes() + np.array([x for i in ids for x in i], "<u4").tobytes())
            fs.move(part, name)
            settle()
            return k

        for b in batches:
            for k, h, chunk, ids in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if k not in held:
                    for old in list(held):
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([write(old)], pa.int32())})
                    held[k] = ([], [])
                held[k][0].append(h)
                held[k][1].append(pieces.with_bytes(chunk, ids))
        for old in list(held):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([write(old)], pa.int32())})

    return sorted((r.shard, f"chunks-{r.shard:06d}") for r in dealt.mapInArrow(run, "shard int").collect())


class ChunkTable:
    """The files of _write_table, mapped into memory; of a store without local paths, copies that vanish with the process."""

    def __init__(self, path: str, files: list[tuple[int, str]], n_shards: int):
        self.n, self.of = n_shards, {}
        fs, root = open_store(path)
        for k, name in files:
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
            self.of[k] = m[8 : 8 + 8 * n].view(U), m[8 + 8 * n : 8 + 16 * n].view("<i8"), m[8 + 16 * n :].view("<u4")

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many for each of the sorted hashes h; 0 for those that the table hasn't)."""
        shard = ((h >> U(48)) * U(self.n) >> U(16)).astype(np.int64)
        n, flat = np.zeros(len(h), np.int64), []
        for k in np.unique(shard).tolist():
            at = np.flatnonzero(shard == k)
            if k not in self.of:
                continue
            keys, ends, ids = self.of[k]
            p = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            ok = keys[p] == h[at]
            at, p = at[ok], p[ok]
            hi, lo = ends[p], np.where(p > 0, ends[np.maximum(p - 1, 0)], 0)
            n[at] = size = hi - lo
            flat.append(ids[np.arange(int(size.sum())) + np.repeat(lo - np.cumsum(size) + size, size)])
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), n


def _encoded(docs: DataFrame, model: str, path: str | None, emit, schema: str) -> DataFrame:
    """emit(doc_ids, list of ids, round trips) as a batch for every 64 rows of docs."""
    spark = docs.sparkSession
    pieces = pieces_of(model)
    path = path or work_path(spark, "chunks")
    n_shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = _write_table(lattice(chunks(docs, model), piece_table(spark, pieces), pieces.longest), path, model, n_shards)

    def run(batches):
        pieces, table = pieces_of(model), ChunkTable(path, files, n_shards)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                cut = [pieces.cuts(t) for t in texts]
                keys = [_hashes(c, begin) for c, begin in cut]
                h, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                flat, n = table.find(h)
                first = np.cumsum(n) - n
                out, ok, k = [], [], 0
                for t, (c, begin), own in zip(texts, cut, keys, strict=True):
                    which = inverse[k : k + len(own)]
                    k += len(own)
                    m = n[which]
                    if (gone := np.flatnonzero(m == 0)).size:  # long chunks
                        end, ids, last = np.append(begin[1:], len(c)), [], 0
                        for g in [*gone.tolist(), len(own)]:
                            w = which[last:g]
                            ids.append(flat[np.arange(int(n[w].sum())) + np.repeat(first[w] - np.cumsum(n[w]) + n[w], n[w])])
                            if g < len(own):
                                chunk = _text(c[begin[g] : end[g]])
                                ids.append(np.array(pieces.with_bytes(chunk, pieces.fold(chunk)), np.uint32))
                            last = g + 1
                        ids = np.concatenate(ids).astype(np.int32)
                    else:
                        ids = flat[np.arange(int(m.sum())) + np.repeat(first[which] - np.cumsum(m) + m, m)].astype(np.int32)
                    if pieces.decode(ids) != t:  # two chunks of one hash
                        whole = [_text(x) for x in np.split(c, begin[1:])]
                        ids = np.array([i for x in whole for i in pieces.with_bytes(x, pieces.fold(x))], np.int32)
                    out.append(ids)
                    ok.append(pieces.decode(ids) == t)
                yield emit(part.column(0), out, ok)
            settle()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, round_trip (whether decoding the ids gives the text) for each row of docs (doc_id, text).

    A null text counts as empty (the space before it alone); null ids and repeated rows stay, each a row; no documents give no rows; texts and
    chunks of any length are encoded whole; of paths of one cost the one with the longer last piece is taken; extra columns are ignored.
    """

    def emit(doc_ids, ids, ok):
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array(ok)], names=["doc_id", "ids", "round_trip"])

    return _encoded(docs, model, path, emit, "doc_id long, ids array<int>, round_trip boolean")


def encode_digest(docs: DataFrame, model: str, path: str | None = None) -> DataFrame:
    """digest(encode(docs, model)), without the ids leaving the encoding task."""
    return _encoded(docs, model, path, _digest, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")


def decode(self, ids: np.ndarray) -> str:
        text = self.text
        return b"".join([text[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


@functools.lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """One for each Python process."""
    return Pieces(path)


_POWER = np.cumprod(np.concatenate(([U(1)], np.full(SPAN + LONG, _BASE))))
_UNPOWER = np.cumprod(np.concatenate(([U(1)], np.full(SPAN + LONG, U(pow(int(_BASE), -1, 1 << 64))))))


def _hashes(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk, a polynomial of its mixed codes and its length; 0 for chunks of more than LONG codes."""
    end = np.append(begin[1:], len(codes))
    out, lo = np.zeros(len(begin), U), 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + SPAN, side="right")))
        first, last = begin[lo:hi], end[lo:hi]
        if hi - lo > 1 or last[0] - first[0] <= LONG:
            c = codes[first[0] : last[-1]]
            total = np.concatenate(([U(0)], np.cumsum(mix(c.astype(U) + U(1)) * _POWER[: len(c)], dtype=U)))
            first, size = first - begin[lo], last - first
            h = mix((total[first + size] - total[first]) * _UNPOWER[first] ^ size.astype(U) << U(48))
            out[lo:hi] = np.where(size <= LONG, np.maximum(h, U(1)), U(0))
        lo = hi
    return out


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("latin-1" if codes.dtype == np.uint8 else "utf-32-le", "surrogatepass" if codes.dtype != np.uint8 else "strict")


def chunks(docs: DataFrame, model: str) -> DataFrame:
    """(h, chunk): the corpus's distinct chunks of at most LONG characters."""

    def run(batches):
        pieces, seen = pieces_of(model), set()

        def rows(keys, texts):
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys, U).view(np.int64)), pa.array(texts, pa.string())], names=["h", "chunk"])

        for b in batches:
            keys, texts = [], []
            for t in b.column(0):
                c, begin = pieces.cuts(t.as_py() or "")
                h, first = np.unique(_hashes(c, begin), return_index=True)
                end = np.append(begin[1:], len(c))
                for k, i in zip(h.tolist(), first.tolist(), strict=True):
                    if k and k not in seen:
                        seen.add(k)
                        keys.append(k)
                        texts.append(_text(c[begin[i] : end[i]]))
                if len(seen) > SEEN:
                    seen.clear()
                if len(keys) > 50_000:
                    yield rows(keys, texts)
                    keys, texts = [], []
            if keys:
                yield rows(keys, texts)
            settle()

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, chunk string")
    # a number of partitions of their own: the lattice makes a hundred rows of each, which their bytes do not show, and sorts them by chunk in memory
    return found.repartition(FINER * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "h").dropDuplicates(["h", "chunk"])


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame([(p, i, c) for p, (i, c) in sorted(pieces.table.items())], "piece string, id int, cost double")


def lattice(chunks_: DataFrame, table: DataFrame, longest: int, most_bytes: int = 32 << 20) -> DataFrame:
    """(h, chunk, ids): each chunk's best path; -1 for a character that no piece holds. The piece table is broadcast below most_bytes."""
    small = table.select(F.sum(F.octet_length("piece") + 40)).first()[0] or 0
    table = F.broadcast(table) if small <= most_bytes else table
    n = F.length("chunk")
    spans = chunks_.withColumn("s", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("e", F.explode(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + F.lit(longest)))))
    spans = spans.withColumn("piece", F.substring("chunk", F.col("s") + 1, F.col("e") - F.col("s")))
    edges = spans.join(table, "piece", "left").filter("id IS NOT NULL OR e = s + 1")
    edge = F.struct("e", "s", F.coalesce("cost", F.lit(UNKNOWN)).alias("c"), F.coalesce("id", F.lit(-1)).alias("i"))
    grouped = edges.groupBy("h", "chunk").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    grouped = grouped.withColumn("path", F.expr("""
        aggregate(edges, array(named_struct('c', 0D, 's', 0, 'i', -1)), (best, x) ->
          CASE WHEN size(best) = x.e THEN concat(best, array(named_struct('c', best[x.s].c + x.c, 's', x.s, 'i', x.i)))
               WHEN best[x.s].c + x.c < best[x.e].c THEN concat(slice(best, 1, x.e), array(named_struct('c', best[x.s].c + x.c, 's', x.s, 'i', x.i)))
               ELSE best END)"""))
    ids = F.expr("""
        aggregate(sequence(1, size(path)), named_struct('at', size(path) - 1, 'ids', CAST(array() AS array<int>)), (a, x) ->
          CASE WHEN a.at = 0 THEN a ELSE named_struct('at', path[a.at].s, 'ids', concat(array(path[a.at].i), a.ids)) END, a -> a.ids)""")
    return grouped.select("h", "chunk", ids.alias("ids"))


def _write_table(encoded: DataFrame, path: str, model: str, n_shards: int) -> list[tuple[int, str]]:
    """Writes the chunk table as one file for each range of hashes: int64 n; hashes (sorted), ends of ids, ids (uint32)."""
    shard = (F.shiftrightunsigned("h", 48) * F.lit(n_shards) / 65536).cast("int")
    dealt = encoded.withColumn("shard", shard).repartition(n_shards, "shard").select("shard", "h", "chunk", "ids").sortWithinPartitions("shard", F.shiftrightunsigned("h", 1), "h")

    def run(batches):
        import uuid

        pieces = pieces_of(model)
        held: dict[int, tuple[list, list]] = {}

        def write(k):
            h, ids = held.pop(k)
            h, order = np.unique(np.array(h, np.int64).view(U), return_index=True)  # one of two chunks of a hash, see encode()
            ids = [ids[i] for i in order]
            fs, root = open_store(path)
            fs.create_dir(root, recursive=True)
            part, name = f"{root}/.{uuid.uuid4().hex}", f"{root}/chunks-{k:06d}"
            with fs.open_output_stream(part) as out:
                out.write(np.array([len(h)], "<i8").tobytes() + h.tobytes() + np.cumsum([len(i) for i in ids]).astype("<i8").tobytes() + np.array([x for i in ids for x in i], "<u4").tobytes())
            fs.move(part, name)
            settle()
            return k

        for b in batches:
            for k, h, chunk, ids in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if k not in held:
                    for old in list(held):
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([write(old)], pa.int32())})
                    held[k] = ([], [])
                held[k][0].append(h)
                held[k][1].append(pieces.with_bytes(chunk, ids))
        for old in list(held):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([write(old)], pa.int32())})

    return sorted((r.shard, f"chunks-{r.shard:06d}") for r in dealt.mapInArrow(run, "shard int").collect())


class ChunkTable:
    """The files of _write_table, mapped into memory; of a store without local paths, copies that vanish with the process."""

    def __init__(self, path: str, files: list[tuple[int, str]], n_shards: int):
        self.n, self.of = n_shards, {}
        fs, root = open_store(path)
        for k, name in files:
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
            self.of[k] = m[8 : 8 + 8 * n].view(U), m[8 + 8 * n : 8 + 16 * n].view("<i8"), m[8 + 16 * n :].view("<u4")

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, how many for each of the sorted hashes h; 0 for those that the table hasn't)."""
        shard = ((h >> U(48)) * U(self.n) >> U(16)).astype(np.int64)
        n, flat = np.zeros(len(h), np.int64), []
        for k in np.unique(shard).tolist():
            at = np.flatnonzero(shard == k)
            if k not in self.of:
                continue
            keys, ends, ids = self.of[k]
            p = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            ok = keys[p] == h[at]
            at, p = at[ok], p[ok]
            hi, lo = ends[p], np.where(p > 0, ends[np.maximum(p - 1, 0)], 0)
            n[at] = size = hi - lo
            flat.append(ids[np.arange(int(size.sum())) + np.repeat(lo - np.cumsum(size) + size, size)])
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), n


def encode(docs: DataFrame, model: str, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, round_trip (whether decoding the ids gives the text) for each row of docs (doc_id, text).

    A null text counts as empty (the space before it alone); null ids and repeated rows stay; extra columns are ignored.
    """
    spark = docs.sparkSession
    pieces = Pieces(model)
    path = path or work_path(spark, "chunks")
    n_shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = _write_table(lattice(chunks(docs, model), piece_table(spark, pieces), pieces.longest), path, model, n_shards)

    def run(batches):
        pieces, table = Pieces(model), ChunkTable(path, files, n_shards)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                cut = [pieces.cuts(t) for t in texts]
                keys = [_hashes(c, begin) for c, begin in cut]
                h, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                flat, n = table.find(h)
                first = np.cumsum(n) - n
                out, ok, k = [], [], 0
                for t, (c, begin), own in zip(texts, cut, keys, strict=True):
                    which = inverse[k : k + len(own)]
                    k += len(own)
                    m = n[which]
                    if (gone := np.flatnonzero(m == 0)).size:  # long chunks
                        end, ids, last = np.append(begin[1:], len(c)), [], 0
                        for g in [*gone.tolist(), len(own)]:
                            w = which[last:g]
                            ids.append(flat[np.arange(int(n[w].sum())) + np.repeat(first[w] - np.cumsum(n[w]) + n[w], n[w])])
                            if g < len(own):
                                chunk = _text(c[begin[g] : end[g]])
                                ids.append(np.array(pieces.with_bytes(chunk, pieces.fold(chunk)), np.uint32))
                            last = g + 1
                        out.append(np.concatenate(ids).astype(np.int32))
                    else:
                        out.append(flat[np.arange(int(m.sum())) + np.repeat(first[which] - np.cumsum(m) + m, m)].astype(np.int32))
                    ok.append(pieces.decode(out[-1]) == t)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out))), pa.array(ok)], names=["doc_id", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of each row of (doc_id, ids); null ids give a null text, null doc_ids and repeated rows stay, no rows give none."""

    def run(batches):
        pieces = pieces_of(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if not x.is_valid else pieces.decode(x.values.to_numpy()) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def _digest(doc_ids, ids, ok) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(ok, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])


def digest(encoded: DataFrame) -> DataFrame:
    """encode's rows as doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip."""

    def run(batches):
        for b in batches:
            yield _digest(b.column(0), [x.values.to_numpy() for x in b.column(1)], b.column(2))

    return encoded.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
