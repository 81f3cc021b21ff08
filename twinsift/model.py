"""Settings, thresholds, rates and the report's records."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, is_dataclass, replace
from enum import Enum


class ComparisonError(Exception):
    """The comparison can't be carried out. A RED verdict is a result, not an error."""


class Level(str, Enum):
    GREEN = "GREEN"
    YELLOW = "YELLOW"
    RED = "RED"

    @property
    def rank(self) -> int:
        return list(Level).index(self)

    @staticmethod
    def worst(levels) -> Level:
        return max(levels, key=lambda x: x.rank, default=Level.GREEN)


class MixedKeyPolicy(str, Enum):
    REJECT = "REJECT"
    COMPARE = "COMPARE"


class VerdictBasis(str, Enum):
    POINT = "POINT"
    CONSERVATIVE = "CONSERVATIVE"


# ---- rates ----


@dataclass(frozen=True)
class Rate:
    """An exact rate (count of total) or an estimate with its interval; value is None where the denominator is 0."""

    kind: str
    value: float | None
    count: int | None = None
    total: int | None = None
    lower: float | None = None
    upper: float | None = None
    sampleSize: int | None = None

    @staticmethod
    def exact(count: int, total: int) -> Rate:
        if not 0 <= count <= total:
            raise ValueError(f"count {count} is not within 0 and {total}")
        return Rate("exact", count / total if total else None, count, total)

    @staticmethod
    def estimate(value: float | None, lower: float | None, upper: float | None, size: int) -> Rate:
        return Rate("estimate", value, lower=lower, upper=upper, sampleSize=size)

    def for_basis(self, basis: VerdictBasis, higher_is_better: bool) -> float | None:
        if self.kind == "exact" or basis == VerdictBasis.POINT:
            return self.value
        return self.lower if higher_is_better else self.upper


# ---- thresholds ----


def _fraction(x: float) -> float:
    if not 0 <= x <= 1:
        raise ValueError(f"{x} is not within 0 and 1")
    return float(x)


@dataclass(frozen=True)
class AtLeast:
    """GREEN from `green` on, YELLOW from `yellow` on, else RED."""

    green: float
    yellow: float

    def __post_init__(self):
        if _fraction(self.yellow) > _fraction(self.green):
            raise ValueError("yellow must not be above green")

    def level(self, x: float) -> Level:
        return Level.GREEN if x >= self.green else Level.YELLOW if x >= self.yellow else Level.RED

    def __str__(self) -> str:
        return f"GREEN >= {self.green:.4f}, YELLOW >= {self.yellow:.4f}"


@dataclass(frozen=True)
class Below:
    """GREEN below `green`, YELLOW below `yellow`, else RED."""

    green: float
    yellow: float

    def __post_init__(self):
        if _fraction(self.green) > _fraction(self.yellow):
            raise ValueError("green must not be above yellow")

    def level(self, x: float) -> Level:
        return Level.GREEN if x < self.green else Level.YELLOW if x < self.yellow else Level.RED

    def __str__(self) -> str:
        return f"GREEN < {self.green:.4f}, YELLOW < {self.yellow:.4f}"


@dataclass(frozen=True)
class StructureThresholds:
    typeShareDelta: float = 0.01
    presenceDelta: float = 0.05
    vanishedMinPresence: float = 0.0

    def __post_init__(self):
        for f in fields(self):
            _fraction(getattr(self, f.name))


@dataclass(frozen=True)
class Thresholds:
    keySimilarity: AtLeast = AtLeast(0.99, 0.97)
    unchangedRate: AtLeast = AtLeast(0.95, 0.85)
    maxPathChangeRate: Below = Below(0.05, 0.20)
    structure: StructureThresholds = StructureThresholds()


# ---- settings ----

# Limits of labels.
MAX_LABELS, MAX_LABEL_VALUE = 32, 512
_LABEL_KEY = re.compile(r"[A-Za-z0-9_-]{1,64}")


def check_labels(labels: dict[str, str]) -> dict[str, str]:
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    for k, v in labels.items():
        if not _LABEL_KEY.fullmatch(k):
            raise ValueError(f"label key {k!r} must match {_LABEL_KEY.pattern}")
        if not isinstance(v, str) or not v.strip() or len(v) > MAX_LABEL_VALUE:
            raise ValueError(f"label value of {k!r} must have 1 to {MAX_LABEL_VALUE} characters")
    return dict(labels)


def parse_labels(text: str | list[str]) -> dict[str, str]:
    """k=v or k:v, comma separated; the first separator of each splits."""
    out = {}
    for part in (p for x in ([text] if isinstance(text, str) else text) for p in x.split(",")):
        if part.strip():
            m = re.match(r"\s*([^=:]*?)\s*[=:](.*)", part, re.S)
            if not m:
                raise ValueError(f"label {part!r} is not <key>=<value>")
            out[m[1]] = m[2].strip()
    return check_labels(out)


@dataclass(frozen=True)
class Mode:
    """AUTO, FULL, or SAMPLE of `size` keys a side."""

    type: str = "AUTO"
    size: int | None = None

    def __post_init__(self):
        if self.type not in ("AUTO", "FULL", "SAMPLE") or (self.type == "SAMPLE") != (self.size is not None) or (self.size or 1) < 1:
            raise ValueError(f"no such mode: {self.type} {self.size}")


def _paths(x) -> tuple[str, ...]:
    return tuple(sorted(set(x or ())))


#: Ignored whatever a request says.
ALWAYS_IGNORED = ("_class",)


@dataclass(frozen=True)
class Settings:
    baseline: str = "baseline"
    candidate: str = "candidate"
    keyFields: tuple[str, ...] = ("_id",)
    mode: Mode = Mode()
    matchedOnly: bool = False
    fullScanLimit: int = 5_000_000
    sampleSize: int = 20_000
    sampleSeed: str = "sample"
    verdictBasis: VerdictBasis = VerdictBasis.CONSERVATIVE
    mixedKeyTypes: MixedKeyPolicy = MixedKeyPolicy.REJECT
    ignoredPaths: tuple[str, ...] = ()
    orderSensitivePaths: tuple[str, ...] = ()
    wildcardPaths: tuple[str, ...] = ()
    expectedChangePaths: tuple[str, ...] = ()
    redactedPaths: tuple[str, ...] = ()
    nullEqualsMissing: bool = False
    maxExamples: int = 20
    maxValueExamples: int = 3
    maxTrackedPaths: int = 10_000
    topChangedPaths: int = 50
    mapDetection: bool = True
    mapSampleSize: int = 500
    mapMinDistinctKeys: int = 20
    thresholds: Thresholds = Thresholds()
    labels: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.baseline == self.candidate:
            raise ValueError("a comparison needs two different sides")
        if not self.keyFields or any(not k or "." in k for k in self.keyFields):
            raise ValueError("key fields must be top-level")
        for f in ("ignoredPaths", "orderSensitivePaths", "wildcardPaths", "expectedChangePaths", "redactedPaths"):
            object.__setattr__(self, f, _paths(getattr(self, f)))
        object.__setattr__(self, "ignoredPaths", _paths((*self.ignoredPaths, *ALWAYS_IGNORED)))
        check_labels(self.labels)

    def merged(self, **request) -> Settings:
        """These defaults under a request's options; None leaves a default, labels are merged."""
        given = {k: v for k, v in request.items() if v is not None}
        if "labels" in given:
            given["labels"] = {**self.labels, **given["labels"]}
        return replace(self, **given)


@dataclass(frozen=True)
class Request:
    """The options of one comparison; what is left out keeps the comparator's defaults. Each method gives a new request."""

    given: dict = field(default_factory=dict)

    def options(self, **more) -> Request:
        unknown = more.keys() - {f.name for f in fields(Settings)}
        if unknown:
            raise ValueError(f"no such option: {', '.join(sorted(unknown))}")
        return Request({**self.given, **more})

    def full_scan(self) -> Request:
        return self.options(mode=Mode("FULL"))

    def sample(self, size: int) -> Request:
        return self.options(mode=Mode("SAMPLE", size))

    def matched_only(self, only: bool = True) -> Request:
        return self.options(matchedOnly=only)

    def label(self, key: str, value: str) -> Request:
        return self.options(labels=check_labels({**self.given.get("labels", {}), key: value}))


# ---- progress ----


@dataclass(frozen=True)
class Progress:
    """How far a comparison is: documents read (known once they are counted), tasks done of those submitted so far."""

    baselineDocs: int
    candidateDocs: int
    tasksDone: int
    tasks: int
    seconds: float
    finished: bool = False

    @property
    def docsPerSecond(self) -> float:
        return (self.baselineDocs + self.candidateDocs) / max(self.seconds, 1e-9)


# ---- report ----


@dataclass(frozen=True)
class KeyRef:
    type: str
    value: str


@dataclass(frozen=True)
class RuleResult:
    rule: str
    level: Level
    observed: float | None
    threshold: str
    reason: str
    details: tuple[str, ...] = ()


@dataclass(frozen=True)
class KeyMetrics:
    matched: int
    added: int
    removed: int
    keySimilarity: Rate
    addedRate: Rate
    removedRate: Rate


@dataclass(frozen=True)
class ContentMetrics:
    unchanged: int
    changed: int
    changedExpectedOnly: int
    unchangedRate: Rate
    changedRate: Rate
    unchangedOrExpectedRate: Rate


@dataclass(frozen=True)
class ValueChange:
    key: KeyRef
    baseline: tuple[str, ...]
    candidate: tuple[str, ...]


@dataclass(frozen=True)
class PathChange:
    path: str
    changedDocs: int
    changeRate: Rate
    expected: bool
    examples: tuple[KeyRef, ...] = ()
    valueExamples: tuple[ValueChange, ...] = ()


@dataclass(frozen=True)
class PathPresence:
    path: str
    baselineDocs: int
    candidateDocs: int
    baselinePresence: float
    candidatePresence: float

    @property
    def presenceDelta(self) -> float:
        return self.candidatePresence - self.baselinePresence


@dataclass(frozen=True)
class TypeShare:
    type: str
    docs: int
    share: float


@dataclass(frozen=True)
class TypeShift:
    path: str
    baseline: tuple[TypeShare, ...]
    candidate: tuple[TypeShare, ...]


@dataclass(frozen=True)
class StructureMetrics:
    baselineDocs: int = 0
    candidateDocs: int = 0
    baselinePaths: int = 0
    candidatePaths: int = 0
    newPaths: tuple[PathPresence, ...] = ()
    missingPaths: tuple[PathPresence, ...] = ()
    typeShifts: tuple[TypeShift, ...] = ()
    presenceDeltas: tuple[PathPresence, ...] = ()
    pathCapReached: bool = False
    untrackedPathOccurrences: int = 0


@dataclass(frozen=True)
class Examples:
    changed: tuple[KeyRef, ...] = ()
    added: tuple[KeyRef, ...] = ()
    removed: tuple[KeyRef, ...] = ()


@dataclass(frozen=True)
class Hint:
    kind: str
    path: str | None
    message: str
    property: str | None = None
    cliOption: str | None = None


@dataclass(frozen=True)
class RunMetadata:
    startedAt: str
    finishedAt: str
    durationMillis: int
    baselineCount: int
    candidateCount: int
    baselineDocsRead: int
    candidateDocsRead: int
    settings: Settings
    thresholdSource: str = "configured"
    decisions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Report:
    id: str
    verdict: Level
    rules: tuple[RuleResult, ...]
    keys: KeyMetrics
    content: ContentMetrics
    topChangedPaths: tuple[PathChange, ...]
    structure: StructureMetrics
    examples: Examples
    run: RunMetadata
    warnings: tuple[str, ...] = ()
    hints: tuple[Hint, ...] = ()
    labels: dict = field(default_factory=dict)
    schemaVersion: int = 1


def to_plain(x):
    """Records as dicts and lists for JSON; derived presenceDelta is written, too."""
    if isinstance(x, Enum):
        return x.value
    if isinstance(x, Rate):
        keys = ("kind", "count", "total", "value") if x.kind == "exact" else ("kind", "value", "lower", "upper", "sampleSize")
        return {k: getattr(x, k) for k in keys}
    if is_dataclass(x):
        out = {f.name: to_plain(getattr(x, f.name)) for f in fields(x)}
        return out | ({"presenceDelta": x.presenceDelta} if isinstance(x, PathPresence) else {})
    if isinstance(x, (list, tuple)):
        return [to_plain(y) for y in x]
    if isinstance(x, dict):
        return {k: to_plain(v) for k, v in x.items()}
    return x


