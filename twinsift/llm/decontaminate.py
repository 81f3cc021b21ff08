"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage with block-max WAND.

Items are indexed by the impact of each of their terms, as a share of the item's own score, so one threshold fits all items. Terms are
weighed by their document frequency in the whole corpus that is searched.
Documents are cut into overlapping passages, long enough that any stretch as long as an item lies within one; every passage
is a query, and *all* items at or above the threshold are retrieved. Upper bounds decide what is looked at: first, for all
passages of a document at once, the sum of their terms' block maxima; then, for the passages that are left, WAND pivots over
the postings with block maxima. Retrieved items are verified on the words: the 5-word n-grams of its question and of its
answer that the passage holds.

Items are grouped by length (a passage fits its group). Block maxima stand beside the postings, only for blocks that hold a term. The index is sent
to the executors only below a stated number of bytes; a larger set of items is cut into parts, each a query run of its own over the documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words: ASCII letters, digits and underscore, and all of other scripts but the punctuation below.
_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() or c == 0x5F else 0x20 for c in range(256))
_PUNCTUATION = re.compile("[\u2000-\u206F\u3000-\u303F\uFF01-\uFF0F]")
BLOCK = 8
K1, B = 1.2, 0.75


def words(text: str | None) -> list[bytes]:
    low = (text or "").lower()
    try:
        low.encode("latin-1")
    except UnicodeEncodeError:
        low = _PUNCTUATION.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(_KEEP).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The item's words up to its last question mark, or else without its last sentence; and the rest."""
    cut = text.rfind("?") + 1
    if not 0 < cut < len(text.rstrip()):
        parts = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
        cut = parts[-1] if parts else len(text)
    q, a = words(text[:cut]), words(text[cut:])
    return (q, a) if q else (a, [])


def grams(w: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []


class Index:
    """Items of similar length: postings in blocks with their maxima, as shares of each item's score."""

    def __init__(self, items: list[tuple[int, list[bytes]]], df: dict[bytes, int], total: int):
        self.ids = [i for i, _ in items]
        self.longest = max(len(w) for _, w in items)
        mean = sum(len(w) for _, w in items) / len(items)
        postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, w) in enumerate(items):
            impact = {t: math.log(1 + (max(total, df.get(t, 0)) - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for t, n in Counter(w).items()}
            whole = sum(impact.values())
            for t, x in impact.items():
                postings[t].append((k, x / whole))
        self.terms = {t: i for i, t in enumerate(postings)}
        self.items = [np.array([k for k, _ in p]) for p in postings.values()]
        self.impact = [np.array([x for _, x in p]) for p in postings.values()]
        self.n_blocks = (len(items) + BLOCK - 1) // BLOCK
        blocks, most = [], []  # of each term, the blocks that hold it and its largest impact in each
        for k, x in zip(self.items, self.impact, strict=True):
            first = np.flatnonzero(np.concatenate(([True], np.diff(k // BLOCK) > 0)))
            blocks.append((k[first] // BLOCK).astype(np.int32))
            most.append(np.maximum.reduceat(x, first).astype(np.float32))
        self.from_ = np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.int64)))
        self.blocks, self.most = np.concatenate(blocks), np.concatenate(most)

    def nbytes(self) -> int:
        return sum(x.nbytes + 120 for x in (*self.items, *self.impact)) + self.blocks.nbytes + self.most.nbytes + sum(len(t) + 150 for t in self.terms)

    def passages(self, ids: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
        """(from, to, block) of passages and blocks of items whose upper bounds reach the threshold. ids: terms of a document's words, -1 for none."""
        step = self.longest
        n = len(ids)
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        # each passage is two steps long: a term counts once in each step, which bounds the passage's distinct terms from above
        key = np.unique((at // step) * (len(self.terms) + 1) + ids[at])
        step_of, term = key // (len(self.terms) + 1), key % (len(self.terms) + 1)
        n_steps = (n + step - 1) // step
        out = []
        number = self.from_[term + 1] - self.from_[term]
        if max(n_steps * self.n_blocks, int(number.sum())) <= 1 << 22:
            entry = np.arange(int(number.sum())) + np.repeat(self.from_[term] - np.cumsum(number) + number, number)
            bound = np.bincount(np.repeat(step_of, number) * self.n_blocks + self.blocks[entry], self.most[entry], (n_steps + 1) * self.n_blocks).reshape(n_steps + 1, self.n_blocks)
            two = bound[:-1] + bound[1:]
            for s, block in zip(*np.nonzero(two >= threshold - 1e-4), strict=True):
                out.append((int(s) * step, min(n, int(s + 2) * step), int(block)))
        else:
            half = n_steps // 2 * step  # a very long document: in two parts that share a step
            if half < step:
                return [(0, n, b) for b in range(self.n_blocks)]
            out = self.passages(ids[: half + step], threshold)
            out += [(a + half, b + half, k) for a, b, k in self.passages(ids[half:], threshold)]
        return sorted(set(out))

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items of the block at or above the threshold, for a passage of these distinct terms."""
        lo, hi = block * BLOCK, (block + 1) * BLOCK
        lists = []
        for t in terms:
            k = self.items[t]
            a, b = np.searchsorted(k, (lo, hi))
            if a < b:
                lists.append([k[a:b].tolist(), self.impact[t][a:b].tolist(), float(self.most[self.from_[t] + np.searchsorted(self.blocks[self.from_[t] : self.from_[t + 1]], block)]), 0])
        out = []
        while lists:
            lists.sort(key=lambda x: x[0][x[3]])
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[2]
                if bound >= threshold - 1e-6:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][3]]
            if lists[0][0][lists[0][3]] == item:
                score = 0.0
                for x in lists:
                    if x[0][x[3]] != item:
                        break
                    score += x[1][x[3]]
                    x[3] += 1
                if score >= threshold - 1e-6:
                    out.append((item, score))
            else:
                for x in lists[:pivot]:
                    while x[3] < len(x[0]) and x[0][x[3]] < item:
                        x[3] += 1
            lists = [x for x in lists if x[3] < len(x[0])]
        return out


class Items:
    """A part of the benchmark: its words, the indexes by length, and what verification needs."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int):
        self.rows, self.n = rows, n
        self.of, self.item_id = {}, [i for i, _ in rows]  # by row: ids may repeat or be null
        self.groups: dict[int, list[tuple[int, list[bytes]]]] = defaultdict(list)
        for i, (_, text) in enumerate(rows):
            w = words(text)
            if w:
                q, a = question_answer(text)
                self.of[i] = grams(q, n), grams(a, n)
                self.groups[(len(w) - 1).bit_length() // 2].append((i, w))
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for g in self.groups.values() for _, w in g for t in w}))}

    def weigh(self, df: dict[bytes, int], total: int) -> Items:
        """Builds the indexes; df: documents of the corpus that hold a term, of total."""
        self.indexes, self.local = [Index(g, df, total) for _, g in sorted(self.groups.items())], []
        for x in self.indexes:
            local = np.full(len(self.vocabulary) + 1, -1, np.int64)
            for t, i in x.terms.items():
                local[self.vocabulary[t]] = i
            self.local.append(local)
        return self

    def nbytes(self) -> int:
        """About the bytes that a worker holds of this part."""
        return sum(x.nbytes() for x in self.indexes) + sum(x.nbytes for x in self.local) + sum(250 * (len(q) + len(a)) for q, a in self.of.values()) + sum(2 * len(t) + 100 for _, t in self.rows)

    def halves(self) -> list[Items]:
        """Two parts of about equal size; rows of one id stay together. One if there is but one id."""
        cuts = [k for k in range(1, len(self.rows)) if self.rows[k][0] is None or self.rows[k][0] != self.rows[k - 1][0]]
        if not cuts:
            return [self]
        cut = min(cuts, key=lambda k: abs(2 * k - len(self.rows)))
        return [Items(self.rows[:cut], self.n), Items(self.rows[cut:], self.n)]

    def matches(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int | None, float, float, float]]:
        """(item_id, best score, question overlap, answer overlap) of items that the text holds; rows of one id are one item, those without an id one each."""
        w = words(text)
        if not w or not self.of:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
        found: dict[int, tuple[float, float, float]] = {}
        for index, local in zip(self.indexes, self.local, strict=True):
            own = local[ids]
            for a, b, block in index.passages(own, threshold):
                terms = np.unique(own[a:b])
                for k, score in index.wand(terms[terms >= 0].tolist(), block, threshold):
                    i = index.ids[k]
                    q, ans = self.of[i]
                    have = {g for m in {len(x[0]) for x in (q, ans) if x} for g in grams(w[a:b], m)}
                    in_q = sum(g in have for g in q) / len(q)
                    in_a = sum(g in have for g in ans) / len(ans) if ans else 1.0
                    if in_q >= overlap and in_a >= overlap:
                        found[i] = max(found.get(i, (0.0, 0.0, 0.0)), (score, in_q, in_a))
        best: dict[tuple[bool, int], tuple[float, float, float]] = {}
        for k, x in found.items():
            i = self.item_id[k]
            key = (i is None, k if i is None else i)
            best[key] = max(best.get(key, x), x)
        return [(None if null else i, *x) for (null, i), x in sorted(best.items())]


def parts(benchmark: DataFrame, n: int, most_items: int, most_chars: int):
    """The benchmark's items in parts of bounded size, read one after the other by ranges of item_id; rows of one id stay together."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).filter("t IS NOT NULL")
    held, size = [], 0
    for r in rows.orderBy("i", "t").toLocalIterator(prefetchPartitions=False):
        if held and r.i is not None and held[-1] == (r.i, r.t):
            continue
        if held and (r.i is None or held[-1][0] != r.i) and (len(held) >= most_items or size + len(r.t) > most_chars):
            yield Items(held, n)
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t)
    if held:
        yield Items(held, n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.7, overlap: float = 0.8, n: int = 5, most_items: int = 20_000, most_chars: int = 8_000_000, most_bytes: int = 256 << 20) -> DataFrame:
    """A row for each document and test item that it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    docs: doc_id, text; benchmark: item_id, text. score: the passage's BM25 score as a share of the item's own. Words are \\w+ in lower
    case. Null or empty texts hold nothing; items without words or text are not searched; texts that share an item_id are all searched and give
    one row, of the best; each item without an id gives a row with a null item_id; repeated documents give repeated rows; extra columns are
    ignored; empty tables give no rows; texts of any length are searched whole. most_items, most_chars: bound of the items read at once; most_bytes:
    bound of an index sent to the executors, larger ones are halved first. Only the texts of one item_id may pass them.
    """
    out = None
    for items in parts(benchmark, n, most_items, most_chars):
        df, total = _frequencies(docs, frozenset(items.vocabulary))
        left = [items]
        while left:
            part = left.pop().weigh(df, total)
            if part.nbytes() > most_bytes and len(halves := part.halves()) == 2:
                left += halves[::-1]
                continue
            got = _run(docs, part, threshold, overlap)
            out = got if out is None else out.unionByName(got)
    return out if out is not None else _run(docs, Items([], n).weigh({}, 0), threshold, overlap)


def _frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents that hold each term, and documents in all: a row for each term of the part and task before the sum."""

    def run(batches):
        n: Counter[bytes] = Counter()
        for b in batches:
            n[b""] += b.num_rows
            for t in b.column(0):
                n.update(vocabulary.intersection(words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], names=["term", "n"])

    df = {bytes(r.term): r.n for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return df, df.pop(b"", 0)


def _run(docs: DataFrame, items: Items, threshold: float, overlap: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        items = sent.value
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in items.matches(t.as_py(), threshold, overlap)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a test item. Rows without a doc_id stay."""
    gone = decontaminate(docs, benchmark).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["_gone"], "left_anti")
