"""Detection of maps with dynamic keys in a bounded sample of documents."""

from __future__ import annotations

from dataclasses import dataclass

from ..paths import Rules, addressable

# How many more names than fields a map has, and rounds for nested maps.
SPREAD, ROUNDS = 3.0, 3


@dataclass(frozen=True)
class DetectedMap:
    pattern: str
    distinctKeys: int
    averageKeys: float
    documents: int


def detect(docs: list[tuple], ignored=(), ordered=(), known=(), min_distinct: int = 20) -> list[DetectedMap]:
    """Objects with many different names and few fields each; once one is collapsed, its children are looked at together."""
    wild, found = list(known), []
    for _ in range(ROUNDS):
        rules = Rules(ignored, ordered, wild)
        names: dict[str, set[str]] = {}
        times: dict[str, int] = {}
        size: dict[str, int] = {}
        inside: dict[str, set[int]] = {}
        stack = [(d, rules.root, "", i) for i, d in enumerate(docs)]
        while stack:
            v, state, path, i = stack.pop()
            if v[0] == "DOCUMENT":
                if path and not state.collapses:
                    names.setdefault(path, set()).update(n for n, _ in v[1])
                    times[path] = times.get(path, 0) + 1
                    size[path] = size.get(path, 0) + len(v[1])
                    inside.setdefault(path, set()).add(i)
                stack += [(x, s, state.name(path, n), i) for n, x in v[1] if not (s := state.field(n)).ignored]
            elif v[0] == "ARRAY" and not (s := state.element()).ignored:
                stack += [(x, s, path + "[]", i) for x in v[1]]
        new = [DetectedMap(p + ".*", len(n), size[p] / times[p], len(inside[p])) for p, n in sorted(names.items()) if len(n) >= min_distinct and len(n) >= SPREAD * size[p] / times[p] and addressable(p + ".*") and p + ".*" not in wild]
        if not new:
            break
        wild += [m.pattern for m in new]
        found += new
    return found
