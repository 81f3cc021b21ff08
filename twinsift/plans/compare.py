"""A whole comparison: checks, mode, map detection, pairs, profiles, rates, verdict, hints, report."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import canon
from ..model import ComparisonError, Examples, KeyRef, Mode, PathChange, PathPresence, Progress, Rate, Report, Request, RunMetadata, Settings, StructureMetrics, TypeShare, TypeShift, ValueChange
from ..operators import maps, pairs, rates, summary, verdict
from ..paths import PathMatcher
from ..sources.side import Side, check_documents, check_typed, mixed_keys, read_side

BACKUP_SUFFIX = "_backup"


def backup_sides(spark: SparkSession, dataset: str, keys=("_id",), fmt: str = "parquet", doc: str | None = None, suffix: str = BACKUP_SUFFIX) -> tuple[Side, Side]:
    """A dataset's backup as the baseline and the dataset as the candidate."""
    return tuple(read_side(spark, path, keys, fmt, doc, path) for path in (dataset + suffix, dataset))


def resolve_mode(s: Settings, nb: int, nc: int) -> tuple[Mode, str]:
    """AUTO is FULL up to fullScanLimit rows of the larger side (of the smaller one if only matched rows count), else SAMPLE."""
    if s.mode.type != "AUTO":
        return s.mode, f"mode {s.mode.type} as requested"
    n = min(nb, nc) if s.matchedOnly else max(nb, nc)
    which = "smaller" if s.matchedOnly else "larger"
    if n <= s.fullScanLimit:
        return Mode("FULL"), f"AUTO: FULL, the {which} side has {n} documents, at most {s.fullScanLimit}"
    return Mode("SAMPLE", s.sampleSize), f"AUTO: SAMPLE of {s.sampleSize} keys, the {which} side has {n} documents, more than {s.fullScanLimit}"


@dataclass
class Comparator:
    """Compares sides under settings; keeps reports in a store, learns thresholds from it, and tells listeners."""

    settings: Settings = field(default_factory=Settings)
    store: object | None = None
    adaptive: verdict.Adaptive | None = None
    listeners: list[Callable] = field(default_factory=list)
    group: str = field(default_factory=lambda: f"comparison-{uuid.uuid4()}")
    metrics: dict = field(default_factory=lambda: {"runs": 0, "errors": 0, "seconds": 0.0})
    progress: list[Callable[[Progress], None]] = field(default_factory=list)
    progress_seconds: float = 10.0

    def compare_with_backup(self, spark: SparkSession, dataset: str, keys=("_id",), fmt: str = "parquet", doc: str | None = None, **request) -> Report:
        return self.compare(*backup_sides(spark, dataset, keys, fmt, doc), **request)

    def run(self, base: Side, cand: Side, request: Request) -> Report:
        return self.compare(base, cand, **request.given)

    @contextmanager
    def _watched(self, spark: SparkSession) -> Iterator[dict]:
        """Tells progress listeners from a thread of its own, every progress_seconds, what Spark's status tracker knows of this comparator's jobs."""
        started, docs, ended = time.monotonic(), {"baseline": 0, "candidate": 0}, threading.Event()
        tracker, before = spark.sparkContext.statusTracker(), set()

        def now(finished: bool = False) -> Progress:
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.group) if j not in before]
            stages = [x for j in jobs if j for i in j.stageIds if (x := tracker.getStageInfo(i))]
            return Progress(docs["baseline"], docs["candidate"], sum(x.numCompletedTasks for x in stages), sum(x.numTasks for x in stages), time.monotonic() - started, finished)

        def tell() -> None:
            while not ended.wait(self.progress_seconds):
                for f in self.progress:
                    f(now())

        if not self.progress:
            yield docs
            return
        before.update(tracker.getJobIdsForGroup(self.group))
        watcher = threading.Thread(target=tell, daemon=True)
        watcher.start()
        try:
            yield docs
        finally:
            ended.set()
            watcher.join()
        for f in self.progress:
            f(now(True))

    def cancel(self, spark: SparkSession) -> None:
        """Stops this comparator's running jobs, from another thread; the comparison then fails."""
        spark.sparkContext.cancelJobGroup(self.group)

    def compare(self, base: Side, cand: Side, **request) -> Report:
        """Runs one comparison. Listeners get ("completed", report) or ("failed", error, labels), progress listeners a Progress at intervals and at the end; a report that can't be saved is returned nonetheless."""
        s = self.settings.merged(**{"baseline": base.name, "candidate": cand.name, "keyFields": tuple(base.keys)} | request)
        base.df.sparkSession.sparkContext.setJobGroup(self.group, f"{s.baseline} -> {s.candidate}", True)
        try:
            thresholds, source = s.thresholds, "configured"
            if "thresholds" in request and request["thresholds"] is not None:
                source = "request"
            elif self.adaptive is not None:
                if self.store is None:
                    raise ComparisonError("learned thresholds need a report store")
                thresholds, source = verdict.learned(self.store.history(s.baseline, s.candidate, False, self.adaptive.historySize), s.thresholds, self.adaptive)
            with self._watched(base.df.sparkSession) as docs:
                report = compare(base, cand, replace(s, thresholds=thresholds), source, lambda nb, nc: docs.update(baseline=nb, candidate=nc))
                docs.update(baseline=report.run.baselineDocsRead, candidate=report.run.candidateDocsRead)
        except Exception as e:
            self.metrics["errors"] += 1
            for f in self.listeners:
                f("failed", e, s.labels)
            raise
        self.metrics |= {"runs": self.metrics["runs"] + 1, "seconds": self.metrics["seconds"] + report.run.durationMillis / 1000, "verdict": report.verdict.rank, "keySimilarity": report.keys.keySimilarity.value, "unchangedRate": report.content.unchangedRate.value}
        if self.store is not None:
            try:
                self.store.save(report)
            except OSError as e:
                report = replace(report, warnings=(*report.warnings, f"The report could not be saved: {e}"))
        for f in self.listeners:
            f("completed", report)
        return report


def compare(base: Side, cand: Side, s: Settings, threshold_source: str = "configured", counted: Callable[[int, int], None] = lambda nb, nc: None) -> Report:
    """counted is told both sides' numbers of documents as soon as they are known."""
    started = datetime.now(timezone.utc)
    mixed = mixed_keys(base, cand)  # then only documents' keys compare exactly
    typed = base.typed and cand.typed and not mixed
    native = base.native and cand.native and not mixed
    warnings: list[str] = []
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    try:
        if typed:
            nb, nc = check_typed(base, cand)
            b, c = base.df, cand.df
            by = list(base.keys)
        elif native:
            nb, nc = check_typed(base, cand)
            b, c = base.native_documents(), cand.native_documents()
            by = [f"k{i}" for i in range(len(base.keys))]
        else:
            b, c = keep(base.documents()), keep(cand.documents())
            more, nb, nc = check_documents({"baseline": b, "candidate": c}, s)
            warnings += more
            by = ["_ksort"]
        counted(nb, nc)
        mode, decision = resolve_mode(s, nb, nc)
        decisions = [decision]
        s = replace(s, mode=mode)
        if not typed and s.mapDetection:
            docs = [canon.parse_document(r[0]) for side in (b, c) for r in side.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in by])), *by).limit(s.mapSampleSize).select("_doc").collect()]
            for m in maps.detect(docs, s.ignoredPaths, s.orderSensitivePaths, s.wildcardPaths, s.mapMinDistinctKeys):
                decisions.append(f"wildcard {m.pattern}: {m.distinctKeys} different names, {m.averageKeys:.1f} fields on average in {m.documents} sampled documents")
                s = replace(s, wildcardPaths=(*s.wildcardPaths, m.pattern))
        join = (lambda x, y, how: pairs.typed_pairs(replace(base, df=x), replace(cand, df=y), s, how)) if typed else (lambda x, y, how: pairs.document_pairs(x, y, s, how, tuple(by)))
        whole = dict(zip("bc", (base, cand), strict=True))
        by_schema = typed or (native and all(pairs.profiled(x.df.schema, s) for x in (base, cand)))

        def profile(rows: DataFrame, side: str, every: bool = False) -> DataFrame:
            """Of typed sides from the rows themselves, cut down to the keys of `rows` unless those are all."""
            if not by_schema:
                return pairs.document_profile(rows, s)
            if typed or every:
                return pairs.typed_profile(rows if typed else whole[side].df, s)
            keys = rows.select(*[F.col(k).alias(n) for k, n in zip(by, base.keys, strict=True)])
            return pairs.typed_profile(whole[side].df.join(keys, list(base.keys), "left_semi"), s)

        sampled = lambda df: df.orderBy(F.md5(F.concat(F.concat_ws("|", *[F.col(k).cast("string") for k in by]), F.lit("#" + s.sampleSeed))), *by).limit(mode.size)
        first = nb <= nc
        extra = 0
        if s.matchedOnly:
            # the smaller side is read, its keys are looked up in the other one
            x, y = (b, c) if first else (c, b)
            x = keep(sampled(x)) if mode.type == "SAMPLE" else x
            ours = keep(join(x if first else y, y if first else x, "left_outer" if first else "right_outer"))
            both = x.select(*by).join(y.select(*by), by, "left_semi")
            pb, pc = profile(b.join(both, by, "left_semi"), "b"), profile(c.join(both, by, "left_semi"), "c")
        elif mode.type == "SAMPLE":
            xs, ys = keep(sampled(b)), keep(sampled(c))
            added = keep(ys.join(b.select(*by), by, "left_anti"))
            found = c.join(xs.select(*by), by, "left_semi")
            ours = keep(join(xs, found, "left_outer").unionByName(join(xs.limit(0), added, "full_outer")))
            pb, pc = profile(xs, "b"), profile(found.unionByName(added), "c")
            extra = ys.count()
        else:
            ours = keep(join(b, c, "full_outer"))
            pb, pc = profile(b, "b", True), profile(c, "c", True)
        return _assemble(s, ours, pb, pc, nb, nc, extra, first, warnings, decisions, threshold_source, started)
    finally:
        for df in held:
            df.unpersist()


def _assemble(s, ours, pb, pc, nb, nc, cand_sampled, read_base, warnings, decisions, source, started) -> Report:
    expected = PathMatcher(s.expectedChangePaths)
    n = summary.category_counts(ours, expected).first()
    matched, added, removed = n.matched, n.added, n.removed
    full = s.mode.type == "FULL"
    m = None
    if s.matchedOnly:
        read, missing = (nb, removed) if read_base else (nc, added)
        if full:
            keys = rates.matched_only_full(matched, nb, nc)
        else:
            keys, m = rates.matched_only_sample(matched, matched + missing, nb, nc)
    elif full:
        keys = rates.exact_keys(matched, added, removed)
    else:
        keys, m = rates.sample_keys(matched, removed, added, cand_sampled, nb, nc)
    content = rates.exact_content(n.unchanged, n.changed, n.changed_expected_only) if full else rates.sample_content(n.unchanged, n.changed, n.changed_expected_only, m)

    counted = summary.path_counts(ours)
    top = counted.orderBy(F.desc("docs"), "path").limit(s.maxTrackedPaths).collect()
    if len(top) == s.maxTrackedPaths and (rest := counted.count() - len(top)) > 0:
        warnings.append(f"{rest} changed paths beyond the {s.maxTrackedPaths} most frequent ones are not listed")
    shown = top[: s.topChangedPaths]
    names = [r.path for r in shown]
    keys_of, values_of = {p: [] for p in names}, {p: [] for p in names}
    if names and (s.maxExamples or s.maxValueExamples):
        for r in sorted(summary.path_examples(ours, s.maxExamples, s.maxValueExamples).filter(F.col("path").isin(names)).collect(), key=lambda r: (r["rank"] or 0, r.value_rank or 0)):
            ref = KeyRef(r._ktype, r._kvalue)
            if r["rank"] is not None:
                keys_of[r.path].append(ref)
            else:
                values_of[r.path].append(ValueChange(ref, tuple(r.value.baseline), tuple(r.value.candidate)))

    def change(r) -> PathChange:
        rate = Rate.exact(r.docs, matched) if full else rates.estimate(r.docs, matched)
        docs = r.docs if full else rates.java_round(m * rate.value)
        return PathChange(r.path, docs, rate, expected.matches(r.path), tuple(keys_of[r.path]), tuple(values_of[r.path]))

    paths = tuple(map(change, shown))
    structure, profile, every = _structure(s, pb, pc, matched if s.matchedOnly else nb if full else matched + removed, matched if s.matchedOnly else nc if full else matched + added, warnings)
    judged = verdict.Judged(keys, content, paths, structure, s.thresholds, s.verdictBasis, s.matchedOnly)
    level, results = verdict.evaluate(judged)
    examples: dict[str, list[KeyRef]] = {"changed": [], "added": [], "removed": []}
    for r in sorted(summary.example_keys(ours, s.maxExamples).collect(), key=lambda r: r["rank"]):
        examples[r.status].append(KeyRef(r._ktype, r._kvalue))
    finished = datetime.now(timezone.utc)
    iso = lambda t: t.isoformat(timespec="milliseconds").replace("+00:00", "Z")
    run = RunMetadata(iso(started), iso(finished), int((finished - started).total_seconds() * 1000), nb, nc, nb if full else matched + removed, nc if full else matched + max(added, cand_sampled), s, source, tuple(decisions))
    return Report(str(uuid.uuid4()), level, results, keys, content, paths, structure, Examples(*(tuple(examples[k]) for k in ("changed", "added", "removed"))), run, tuple(warnings), verdict.hints(judged, s, results, profile, every), dict(s.labels))


def _structure(s, pb, pc, base_total, cand_total, warnings):
    """Metrics of the structure, the candidate's profile, and all paths: of the most frequent maxTrackedPaths, with all their types."""
    rows, docs = summary.joined_profiles(pb, pc), F.col("base_docs") + F.col("cand_docs")
    joined = rows.orderBy(F.desc(docs), "path").limit(s.maxTrackedPaths * 8 + 1).collect()
    ranked = sorted((r for r in joined if r.type is None), key=lambda r: (-(r.base_docs + r.cand_docs), r.path))
    over, untracked = len(ranked) - s.maxTrackedPaths, sum(r.base_docs + r.cand_docs for r in ranked[s.maxTrackedPaths :])
    if len(joined) > s.maxTrackedPaths * 8:  # more than was read: paths first, then the types of those that are tracked
        whole = rows.filter("type IS NULL")
        top = whole.orderBy(F.desc(docs), "path").limit(s.maxTrackedPaths)
        ranked = top.collect()
        joined = ranked + rows.filter("type IS NOT NULL").join(top.select("path"), "path", "left_semi").collect()
        n, total = whole.agg(F.count(F.lit(1)), F.sum(docs)).first()
        over, untracked = n - len(ranked), total - sum(r.base_docs + r.cand_docs for r in ranked)
    tracked = {r.path: r for r in ranked[: s.maxTrackedPaths]}
    if over > 0:
        warnings.append(f"More than {s.maxTrackedPaths} distinct paths: new or vanished ones may be missing from the report. Consider wildcard paths for maps with dynamic keys.")
    share = lambda k, n: k / n if n else 0.0
    at = {p: PathPresence(p, r.base_docs, r.cand_docs, share(r.base_docs, base_total), share(r.cand_docs, cand_total)) for p, r in tracked.items()}
    types: dict[str, list] = {p: [] for p in tracked}
    for r in joined:
        if r.type is not None and r.path in types:
            types[r.path].append(r)
    t = s.thresholds.structure
    shifts, utf16 = [], canon._utf16
    for p in sorted(tracked, key=utf16):
        r = tracked[p]
        if r.base_docs and r.cand_docs:
            moved = max((abs(x.base_docs / r.base_docs - x.cand_docs / r.cand_docs) for x in types[p]), default=0.0)
            if moved > t.typeShareDelta or any((not x.base_docs) != (not x.cand_docs) for x in types[p]):
                shares = lambda side, r=r, p=p: tuple(TypeShare(x.type, k, k / r[side]) for k, x in sorted(((x[side], x) for x in types[p] if x[side]), key=lambda y: (-y[0], y[1].type)))
                shifts.append(TypeShift(p, shares("base_docs"), shares("cand_docs")))
    order = sorted(at.values(), key=lambda x: utf16(x.path))
    both = [x for x in order if x.baselineDocs and x.candidateDocs and abs(x.presenceDelta) > t.presenceDelta]
    metrics = StructureMetrics(base_total, cand_total, sum(bool(x.baselineDocs) for x in order), sum(bool(x.candidateDocs) for x in order), tuple(x for x in order if not x.baselineDocs), tuple(x for x in order if not x.candidateDocs), tuple(shifts),
                               tuple(sorted(both, key=lambda x: (-abs(x.presenceDelta), utf16(x.path)))), over > 0, untracked)
    profile = {p: (r.cand_docs, {x.type: x.cand_docs for x in types[p]}) for p, r in tracked.items() if r.cand_docs}
    return metrics, profile, set(tracked)
