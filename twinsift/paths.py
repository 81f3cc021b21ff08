"""Paths of documents: `a.b`, `items[]`, `attributes.*`; patterns, rules along a walk, and matching of reported paths."""

from __future__ import annotations

import re

ANY, ELEMENT = "*", "[]"


def parse(pattern: str) -> tuple[str, ...]:
    """Steps of a pattern: field names, ANY and ELEMENT."""
    if not pattern or not pattern.strip():
        raise ValueError("a path must not be blank")
    steps: list[str] = []
    for part in pattern.split("."):
        name = part
        n = 0
        while name.endswith(ELEMENT):
            name, n = name[:-2], n + 1
        if not name or "[" in name or "]" in name or ("*" in name and name != ANY):
            raise ValueError(f"no such path: {pattern!r}")
        steps += [name, *[ELEMENT] * n]
    return tuple(steps)


def addressable(pattern: str) -> bool:
    try:
        parse(pattern)
    except ValueError:
        return False
    return True


def child(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def element(path: str) -> str:
    return path + ELEMENT


class State:
    """A place in the rules: the patterns that still match, as (rule, pattern, steps taken)."""

    __slots__ = ("rules", "live", "ignored", "ordered", "collapses")

    def __init__(self, rules: Rules, live: frozenset[tuple[str, int, int]]):
        self.rules, self.live = rules, live
        ends = {kind for kind, p, n in live if n == len(rules.steps[p])}
        self.ignored, self.ordered = "ignored" in ends, "ordered" in ends
        self.collapses = any(kind == "wildcard" and n == len(rules.steps[p]) - 1 for kind, p, n in live)

    def field(self, name: str) -> State:
        return self.rules.next(self, name, (name, ANY))

    def element(self) -> State:
        return self.rules.next(self, ELEMENT, (ELEMENT,))

    def name(self, path: str, name: str) -> str:
        """The reported path of a field."""
        return child(path, ANY if self.collapses else name)


class Rules:
    """Ignored, order-sensitive and wildcard patterns, followed at once along a document."""

    def __init__(self, ignored=(), ordered=(), wildcards=()):
        self.steps, live = [], set()
        for kind, patterns in (("ignored", ignored), ("ordered", ordered), ("wildcard", wildcards)):
            for p in patterns:
                s = parse(p)
                if kind == "wildcard" and s[-1] != ANY:
                    raise ValueError(f"a wildcard path must end with .*: {p!r}")
                live.add((kind, len(self.steps), 0))
                self.steps.append(s)
        self._known: dict = {}
        self.root = self._state(frozenset(live))

    def _state(self, live: frozenset) -> State:
        if live not in self._known:
            self._known[live] = State(self, live)
        return self._known[live]

    def next(self, state: State, step: str, matching: tuple[str, ...]) -> State:
        if not state.live:
            return state
        return self._state(frozenset((k, p, n + 1) for k, p, n in state.live if n < len(self.steps[p]) and self.steps[p][n] in matching))


class PathMatcher:
    """Whether a reported path, or one it lies below, is among the patterns; ANY matches no ELEMENT; an unreadable path never matches."""

    def __init__(self, patterns=()):
        self.patterns = [parse(p) for p in patterns]

    def __bool__(self) -> bool:
        return bool(self.patterns)

    def regex(self) -> str:
        """The same test as a regular expression, for columns; of no patterns, one that nothing matches."""
        segment = r"(?:\*|[^.\[\]*]+)(?:\[\])*"
        text = lambda p: "".join((r"\[\]" if s == ELEMENT else ("" if i == 0 else r"\.") + (r"(?:\*|[^.\[\]*]+)" if s == ANY else re.escape(s))) for i, s in enumerate(p))
        return rf"^(?={segment}(?:\.{segment})*$)(?:{'|'.join(map(text, self.patterns)) or '(?!)'})(?:$|\.|\[\])"

    def matches(self, path: str) -> bool:
        try:
            steps = parse(path)
        except ValueError:
            return False
        return any(len(p) <= len(steps) and all(a == b or (a == ANY and b != ELEMENT) for a, b in zip(p, steps, strict=False)) for p in self.patterns)
