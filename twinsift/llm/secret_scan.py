"""Secret scan: base patterns, and assignment-aware lexing of source and configuration text.

The lexer first finds string literals (one line, triple quotes, back quotes, prefixes, escapes) and comments; a literal that opens in a comment
ends in it. Then it reads name-literal pairs: name = literal, name: literal, "name": "literal", name: type = literal, name string = literal,
map["name"] = literal, --name=literal, <name>literal</name>, #define name literal, name("literal"), f("name", "literal"), and name / value
entries ({"name": "x", "value": "literal"}). Literals that are added or stand side by side are one. A bare value is read again for pairs in it.

Constants are propagated backwards, wherever they are defined: what a sensitive name is assigned from is as sensitive, over any number of steps;
assignments in comments define nothing. A literal is scored by how sensitive its targets are, times how random it looks; one that is added to names
is scored with their literals, of any length and of every definition.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs [0-9a-f]+ of 32 and more
KINDS = ("assign", "access", "hex", "lexed")
# Parts of names and how sensitive they are.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0, "accesskey": 0.9, "access_key": 0.9, "privatekey": 1.0, "private_key": 1.0, "credential": 0.8, "auth": 0.6, "signature": 0.5, "salt": 0.5}

_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.A)
_HINT = re.compile("|".join(dict.fromkeys(k.replace("_", "") for k in SENSITIVE)), re.A)
_BARE = r"""[^\s"',;<>(){}\[\]`]"""
_TYPE = r"[A-Za-z_][\w.]*+(?:\[[^\]\n]*+\]|<[^>\n=]*+>)?\??(?:\x20?\|\x20?[\w.]++)*+"
#: A name and, if one follows, an operator with the blanks behind it; a name alone is passed over as a whole.
_NAME = rf"""["'`]?([A-Za-z_$][\w.$-]*+)(?:(["'`]?)\]?(?:[\x20\t]*+:[\x20\t]*+(?P<type>{_TYPE})(?=[\x20\t]*+=[^=>])|[\x20\t]++(?:string|String|str)(?=[\x20\t]*+=))?[\x20\t]*+(?P<op>===?|!==?|:=|=>|=|:|>|,|\((?=[\x20\t]*+["'`rbfuRBFU]))[\x20\t]*+)?"""
_PAIR = re.compile(rf"""(?:^|(?<=[\s,;{{(\[<"'`-])){_NAME}""", re.A | re.M)
_INNER = re.compile(_NAME, re.A)
_DEFINE = re.compile(r"^[\x20\t]*+#[\x20\t]*+define[\x20\t]++(\w++)[\x20\t]++", re.A | re.M)
_WORD = re.compile(r"[A-Za-z_$][\w.$-]*+", re.A)
_RUN = re.compile(f"{_BARE}+", re.A)
_BLANK, _SPACE = re.compile(r"[\x20\t]*+"), re.compile(r"\s*+")
_PREFIX = re.compile(r"[rRbBfFuU]{1,2}(?=[\"'])")
_OPEN = re.compile(r"""(?<![\w\\])([rRbBfFuU]{1,2}(?=["']))?(\"{3}|'{3}|["'`])|((?:^|(?<=\s))(?:\#|//|--\x20)|/\*|<!--)""", re.A | re.M)
_LINE = {'"': re.compile(r'(?:[^"\\\n]|\\.)*+"'), "'": re.compile(r"(?:[^'\\\n]|\\.)*+'")}
_ENTRY, _VALUE = frozenset("name key id field variable".split()), frozenset("value val content default".split())
_NAMED = re.compile(r"[A-Za-z_$][\w.$-]*+", re.A)
_TEMPLATE = ("${", "{{", "%(", "$(")


def lex(text: str) -> tuple[dict[int, tuple[int, int, int]], list[tuple[int, int]]]:
    """(string literals: place of the prefix or quote -> start and end of the content, end of the literal; comments) of a text."""
    strings: dict[int, tuple[int, int, int]] = {}
    comments: list[tuple[int, int]] = []
    at, limit, unclosed = 0, 0, set()
    while m := _OPEN.search(text, at):
        at = m.end()
        if m[3]:
            if m.start() >= limit:
                close = {"/*": "*/", "<!--": "-->"}.get(m[3], "\n")
                limit = text.find(close, at) if close not in unclosed else -1
                if limit < 0:
                    unclosed.add(close)
                    limit = len(text) if close == "\n" else at  # an open block is no comment
                if limit > at:
                    comments.append((at, limit))
            continue
        q = m[2]
        if q in _LINE:
            e = _LINE[q].match(text, at)
            end = e.end() if e else -1
        else:
            end = text.find(q, at) if q not in unclosed else -1
            if end < 0:
                unclosed.add(q)
            else:
                end += len(q)
        if end < 0 or m.start() < limit < end:  # not closed, or not in its comment
            at = m.start(2) + 1
            continue
        strings[m.start()] = strings[m.start(2)] = at, end - len(q), end
        at = end
    return strings, comments


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: places stay
    at = 0
    while k := _KEYWORD.search(low, at):  # a match starts at a keyword, so the plain search tells where to try
        at = k.start()
        if m := ASSIGN.match(text, at):
            if len(m[2]) >= 8:
                out.append((at, m.end(), "assign"))
            at = m.end()
        else:
            at += 1
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def sensitivity(name: str) -> float:
    low = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_").replace(".", "_")
    flat = low.replace("_", "")
    return max((v for k, v in SENSITIVE.items() if k in low or k in flat), default=0.0)


class _Literal:
    """What the randomness of a literal, and of those that it is added to, hangs on; its length costs nothing once this is read."""

    __slots__ = ("n", "of", "weight", "digit", "space", "other", "camel", "head", "upper", "lower")

    def __init__(self, text: str):
        self.n, self.of = len(text), Counter(text)
        self.weight = sum(c * math.log2(c) for c in self.of.values())
        self.digit, self.space, self.other, self.camel = (bool(re.search(x, text)) for x in (r"[0-9]", r"\s", r"[^A-Za-z]", r"[a-z][A-Z]"))
        self.head, self.upper, self.lower = text[:2] if text[:1] in ("$", "{", "%", "(") else "", "A" <= text[:1] <= "Z", "a" <= text[-1:] <= "z"

    def key(self) -> tuple:
        """Equal for literals that look alike beside any others."""
        return frozenset(self.of.items()), self.head, self.upper, self.lower, self.camel

    def plain(self) -> bool:
        return not (self.other or self.camel)


def _look(parts: list[_Literal]) -> float:
    """The randomness of a literal in quotes, or of several one after the other. One without a digit must mix letters with other characters, or cases;
    blanks and templates are none."""
    parts = [x for x in parts if x.n]
    n = sum(x.n for x in parts)
    if n < 8 or any(x.space for x in parts) or (parts[0].head + (parts[1].head[:1] if len(parts) > 1 and parts[0].n == 1 else "")).startswith(_TEMPLATE):
        return 0.0
    if not any(x.digit for x in parts) and not (n >= 12 and (any(x.other or x.camel for x in parts) or any(x.lower and y.upper for x, y in zip(parts, parts[1:], strict=False)))):
        return 0.0
    most = max(range(len(parts)), key=lambda k: len(parts[k].of))
    of, weight, more = parts[most].of, parts[most].weight, Counter()
    for k, x in enumerate(parts):
        if k != most:
            more.update(x.of)
    for ch, c in more.items():  # only the characters of the others: the part with the most is not gone through again
        b = of.get(ch, 0)
        weight += (b + c) * math.log2(b + c) - (b * math.log2(b) if b else 0.0)
    bits = round(math.log2(n) - weight / n, 9)
    return (1.0 if any(x.digit for x in parts) else 0.9) * min(1.0, bits / 3.0) * min(1.0, n / 12)


def score(name: str, literal: str) -> float:
    """Sensitivity of the name times the randomness of the literal (entropy against 3 bits a character, and length), 0 to 1."""
    return sensitivity(name) * _look([_Literal(literal)])


def _looks(text: str, spans: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The randomness of bare values, which need a digit: prose has none. Those that end at one place, as in a=b=c=value, are read once, from the shortest on."""
    out, end_of, of, at, digit, space = {}, None, Counter(), 0, False, False
    for a, b in sorted(spans, key=lambda s: (s[1], -s[0])):
        if b != end_of:
            end_of, of, at, digit, space = b, Counter(), b, False, False
        more, at = text[a:at], a
        of.update(more)
        digit, space, n = digit or bool(re.search(r"[0-9]", more)), space or bool(re.search(r"\s", more)), b - a
        bits = -sum(c / n * math.log2(c / n) for c in of.values()) if n >= 8 and digit and not space else 0.0
        out[a, b] = min(1.0, bits / 3.0) * min(1.0, n / 12)
    return out


class _Pair:
    __slots__ = ("name", "start", "end", "parts", "refs", "bare", "comment")

    def __init__(self, name: str, start: int, end: int, parts: list, refs: list, bare: tuple[int, int] | None, comment: bool):
        self.name, self.start, self.end, self.parts, self.refs, self.bare, self.comment = name, start, end, parts, refs, bare, comment


def pairs_of(text: str) -> list[_Pair]:
    """The name-literal pairs of a text in order: the literals of the value, the names in it, or a bare value."""
    strings, comments = lex(text)
    inside = [a for a, _ in comments]
    out: list[_Pair] = []
    run_end = stripped = 0

    def value(p: int) -> tuple[list[tuple[int, int]], list[str], int]:
        parts, refs, blank = [], [], _BLANK
        if text[p : p + 1] == "(" and _SPACE.match(text, p + 1).end() in strings:
            p, blank = _SPACE.match(text, p + 1).end(), _SPACE
        while True:
            if p in strings:
                a, b, p = strings[p]
                parts.append((a, b))
            elif (k := _WORD.match(text, p)) and (k.end() == len(text) or text[k.end()] in " \t\n\r+;,)]}"):
                refs.append(k[0])
                p = k.end()
            else:
                break
            q = blank.match(text, p).end()
            if text[q : q + 1] == "+" or text[q : q + 2] == ". " and q > p:
                p = _SPACE.match(text, q + 1).end()
            elif parts and q in strings:
                p = q
            else:
                break
        return parts, refs, p

    def add(name: str, start: int, at: int) -> None:
        nonlocal run_end, stripped
        k = bisect_right(inside, start) - 1
        comment = k >= 0 and start < comments[k][1]
        parts, refs, end = value(at)
        bare = None
        if not parts and at < len(text) and _RUN.match(text[at]):
            if at >= run_end:
                run_end = _RUN.match(text, at).end()
                stripped = at + len(text[at:run_end].rstrip("."))
            bare, end = (at, max(at, stripped)), max(end, run_end)
        if parts or refs or bare:
            out.append(_Pair(name, start, end, parts, refs, bare, comment))

    defines = {m.start(1): m for m in _DEFINE.finditer(text)} if "define" in text else {}
    m = _PAIR.search(text)
    while m:
        name, start, at, op = m[1], m.start(1), m.end(), m["op"]
        if start in defines:
            at, op = defines[start].end(), "define"
        if op == "," and not (m[2] and text[max(0, start - 2) : start] == "(" + m[2] and at in strings):
            op, at = None, m.end(1)
        if op:
            add(name, start, at)
            if m["type"] and (k := _WORD.match(m["type"])):  # or is it a pair within a value, as in note: name = literal?
                add(k[0], m.start("type"), at)
            at = strings[at][0] if at in strings and strings[at][0] > at else at
        m = (_INNER.match(text, at) if op else None) or _PAIR.search(text, at)
    for x, y in zip(out, out[1:], strict=False):
        if x.name.lower() in _ENTRY and y.name.lower() in _VALUE and len(x.parts) == 1 and not re.search(r"\w", text[x.end : y.start]):
            if _NAMED.fullmatch(named := text[slice(*x.parts[0])]):
                out.append(_Pair(named, y.start, y.end, y.parts, y.refs, y.bare, y.comment))
    return out


def lexed_spans(text: str, threshold: float = 0.6) -> list[tuple[int, int, str]]:
    """Spans of literals (without quotes) whose targets' names and look score at least threshold."""
    if not any(x in text for x in "=:>(#") or not _HINT.search(text.lower().replace("_", "").replace("-", "").replace(".", "")):
        return []  # a name that sensitivity() rates holds one of these words once _ - . are gone
    pairs = pairs_of(text)
    of: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(pairs):
        if not x.comment:
            for name in {x.name, x.name.rpartition(".")[2]}:
                of[name].append(i)

    def defined(name: str) -> list[int]:
        return of.get(name) or of.get(name.rpartition(".")[2], [])

    own = {name: sensitivity(name) for name in {x.name for x in pairs}}
    much, expanded = [0.0] * len(pairs), set()
    for i in sorted((i for i, x in enumerate(pairs) if own[x.name] >= threshold), key=lambda i: -own[pairs[i].name]):
        stack, rate = [i], own[pairs[i].name]
        while stack:  # the most sensitive come first, so each pair and each name is reached once, by the highest rate
            j = stack.pop()
            if much[j]:
                continue
            much[j] = rate
            for name in pairs[j].refs:
                if name not in expanded:
                    expanded.add(name)
                    stack += defined(name)

    seen: dict[int, _Literal] = {}
    tries: dict[str, tuple] = {}
    tried: dict[tuple, tuple[bool, bool]] = {}

    def literal(i: int) -> _Literal:
        if i not in seen:
            seen[i] = _Literal("".join(text[a:b] for a, b in pairs[i].parts))
        return seen[i]

    def definitions(name: str) -> tuple[list[int], list[int], list[list[int]], list[list[list[int]]]]:
        """(definitions by literals in order, their starts, those that look alike together, of these the ones not reported yet); of the last two, each plain ones apart."""
        name = name if name in of else name.rpartition(".")[2]
        if name not in tries:
            own = sorted((i for i in of.get(name, []) if pairs[i].parts), key=lambda i: pairs[i].start)
            able = [i for i in own if not literal(i).space]  # one with blanks is never part of a secret
            own = able or own
            alike: dict[tuple, list[int]] = defaultdict(list)
            for i in able:
                alike[literal(i).key()].append(i)
            split = [[g for g in alike.values() if literal(g[0]).plain() == plain] for plain in (False, True)]
            tries[name] = own, [pairs[i].start for i in own], split, [list(x) for x in split]
        return tries[name]

    def composed(i: int, rate: float) -> None:
        """Reports a value and the definitions of the names in it that together look random. A name stands for its last definition before the value, else
        its first; each other definition is tried in its place."""
        x, whole = pairs[i], literal(i)
        names = [r for r in x.refs if definitions(r)[0]]
        reached = {r: definitions(r)[0][max(0, bisect_right(definitions(r)[1], x.start - 1) - 1)] for r in names}

        # all of one look are tried once: what the others would pass with is reported already
        key = rate, whole.key(), tuple(names), tuple(literal(reached[r]).key() for r in names) if len(names) > 1 else ()

        def report(*of_: int) -> None:
            out.update((pairs[k].parts[0][0], pairs[k].parts[-1][1], "lexed") for k in of_)

        def passes(chosen: dict[str, int]) -> bool:
            if rate * _look([*(literal(chosen[r]) for r in names), whole]) < threshold:
                return False
            report(i, *chosen.values())
            return True

        if not names:
            return
        if key in tried:
            if tried[key][0]:
                report(i, *(reached.values() if tried[key][1] else ()))
            return
        hit = together = passes(reached)
        # two plain literals are a mixed one only at a change of case between them; of several names, any may mix
        kinds = (0,) if len(names) == 1 and whole.plain() and not whole.upper else (0, 1)
        for r in dict.fromkeys(names):
            left = definitions(r)[3]
            for k in kinds:
                rest = []
                for g in left[k]:
                    if passes(reached | {r: g[0]}):
                        hit = True
                        report(*g)
                    else:
                        rest.append(g)
                left[k] = rest
        tried[key] = hit or any(passes(reached | {r: g[0]}) for r in dict.fromkeys(names) for k in kinds for g in definitions(r)[2][k]), together and len(names) > 1

    out, bare = set(), {}
    for i, (rate, x) in enumerate(zip(much, pairs, strict=True)):
        if not rate:
            continue
        if x.parts:
            if rate * _look([literal(i)]) >= threshold:
                out.add((x.parts[0][0], x.parts[-1][1], "lexed"))
            elif not literal(i).space:
                composed(i, rate)
        elif x.bare and not any(map(defined, x.refs)):
            bare[x.bare] = max(rate, bare.get(x.bare, 0.0))
    looks = _looks(text, set(bare))
    return sorted(out | {(a, b, "lexed") for (a, b), rate in bare.items() if rate * looks[a, b] >= threshold})


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, spans of the method that no base span of the same place covers)."""
    text = text or ""
    base = base_spans(text)
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    more = [s for s in lexed_spans(text) if not ((k := bisect_right(starts, s[0])) and ends[k - 1] >= s[1])]
    return base, more


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, spans array<struct<kind, start, end>>, base_spans likewise; code points, end exclusive.

    A null text counts as empty and has no spans; null ids and repeated rows stay, each a row; no documents give no rows; texts of any length are
    read whole, in linear time but for literals added to a name that differ in look as often as its definitions do; spans that tie in start and kind stand by their end; extra columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            base, every = [], []
            for t in b.column(1):
                x, more = scan(t.as_py())
                base.append([{"kind": k, "start": s, "end": e} for s, e, k in x])
                every.append([{"kind": k, "start": s, "end": e} for s, e, k in sorted(x + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(every, kind)], names=["doc_id", "base_spans", "spans"])

    one = "array<struct<kind string, start long, end long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, base_spans {one}, spans {one}")


def digest(scanned: DataFrame) -> DataFrame:
    """secret_scan's rows as doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed."""
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *(count("base_spans", k) for k in KINDS[:3]), F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"), count("spans", "lexed"))


def sha256_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
