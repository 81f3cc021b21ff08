"""License scan: exact set-similarity join of licence templates with the text blocks of documents.

A block is a window of consecutive words as long as the template; it meets the template if at least threshold of the
template's distinct tokens stand in it. Tokens are ordered by document frequency over the whole corpus, rarest first.
 - length filter: a text with fewer words than the tokens asked for can't hold such a block;
 - prefix filter: a block that holds t of m tokens holds one of the m - t + 1 rarest, so only windows that cover such an
   occurrence are looked at (words that are no prefix token of any template cost one look-up);
 - positional filter: a window with too few template tokens around the occurrence is dropped before sets are compared.
Every qualifying block is found: blocks that begin at consecutive words are given as one, from the first start to the last, with the best of
them.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Licence notices and their labels.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def base_places(w: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(start, label) of each place where a phrase's words stand consecutively."""
    line = b" " + b" ".join(w) + b" "
    out = []
    for phrase, label in phrases.items():
        want, at, n, last = b" " + phrase.encode() + b" ", 0, 0, 0
        while (at := line.find(want, at)) >= 0:
            n += line.count(b" ", last, at)
            last = at
            out.append((n, label))
            at += 1
    return sorted(out)


class Matcher:
    """Templates with their tokens in global order, and the prefix index."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.threshold, self.index, self.of = threshold, {}, []
        for label, text in sorted(templates.items()):
            w = tokens(text)
            order = sorted(set(w), key=lambda t: (frequency.get(t, 0), t))
            need = max(1, -(-int(round(threshold * len(order) * 1000)) // 1000))
            for t in order[: len(order) - need + 1]:
                self.index.setdefault(t, []).append(len(self.of))
            self.of.append((label, len(w), frozenset(order), len(order), need))

    def blocks(self, w: list[bytes]) -> list[tuple[str, int, float, int, int]]:
        """(label, best start, containment, first start, last start) of each run of qualifying windows that begin at consecutive words."""
        hits: dict[int, list[int]] = {}
        index = self.index
        for i in [i for i, t in enumerate(w) if t in index]:
            for k in index[w[i]]:
                hits.setdefault(k, []).append(i)
        out = []
        for k, at in hits.items():
            label, size, have, m, need = self.of[k]
            end = max(0, len(w) - size)
            if len(w) < need:
                continue
            spans: list[list[int]] = []  # starts of windows that cover a prefix token
            for i in at:
                lo, hi = max(0, i - size + 1), min(i, end)
                if spans and lo <= spans[-1][1] + 1:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                near = [j for j in range(lo, min(len(w), hi + size)) if w[j] in have]
                if not any(b - a < size for a, b in zip(near, near[need - 1 :], strict=False)):
                    continue  # too few template tokens around the occurrences
                count = Counter(w[j] for j in near if j < lo + size)
                run: list[int] = []  # first start, last start, best count, best start
                for s in range(lo, hi + 1):
                    if s > lo:
                        if (t := w[s - 1]) in count:
                            count[t] -= 1
                            if not count[t]:
                                del count[t]
                        if s + size <= len(w) and (t := w[s + size - 1]) in have:
                            count[t] += 1
                    if (got := len(count)) >= need:
                        if run and run[1] == s - 1:
                            run[1] = s
                            if got > run[2]:
                                run[2:] = got, s
                        else:
                            if run:
                                out.append((label, run[3], run[2] / m, run[0], run[1]))
                            run = [s, s, got, s]
                if run:
                    out.append((label, run[3], run[2] / m, run[0], run[1]))
        return sorted(out, key=lambda x: (x[1], x[0]))


def frequencies(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each template token; as many rows as the templates have tokens."""
    vocabulary = {t for x in templates.values() for t in tokens(x)}

    def run(batches):
        n = dict.fromkeys(sorted(vocabulary), 0)
        for b in batches:
            for t in b.column(0):
                for x in vocabulary.intersection(tokens(t.as_py())):
                    n[x] += 1
        yield pa.RecordBatch.from_pydict({"token": pa.array([t.decode() for t in n]), "n": pa.array(n.values(), pa.int64())})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token.encode(): r.n for r in rows}


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.85) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, places array<struct<start, label>> of the base phrases,
    blocks array<struct<label, start, containment, first, last>> of the templates, whole texts: blocks begin at every word from first to last, the
    best (of equal ones, the first) at start.

    A null text counts as empty; null ids and repeated rows stay, each a row; texts of any length are read whole, in linear time a template; extra
    columns are ignored; an empty table gives no rows.
    """
    templates, phrases = TEMPLATES if templates is None else templates, BASE if phrases is None else phrases
    matcher = Matcher(templates, frequencies(docs, templates), threshold)
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    block = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("containment", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for b in batches:
            n, places, blocks = [], [], []
            for t in b.column(1):
                w = tokens(t.as_py())
                n.append(len(w))
                places.append([{"start": s, "label": x} for s, x in base_places(w, phrases)])
                blocks.append([{"label": x, "start": s, "containment": c, "first": lo, "last": hi} for x, s, c, lo, hi in matcher.blocks(w)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(places, place), pa.array(blocks, block)], names=["doc_id", "n_words", "places", "blocks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, places array<struct<start long, label string>>, blocks array<struct<label string, start long, containment double, first long, last long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """license_scan's rows as doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks."""
    of = lambda c: F.transform(c, lambda x: x["label"])
    text = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    starts = F.transform("places", lambda x: x["start"])
    best = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))
    return scanned.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                          text(of("places")).alias("base_labels"), text(F.concat(of("places"), of("blocks"))).alias("labels"),
                          F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"), F.size("blocks").cast("long").alias("n_blocks"))
