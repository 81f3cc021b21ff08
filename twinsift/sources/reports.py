"""Reports: JSON codec, HTML page, and stores in files or in Parquet tables."""

from __future__ import annotations

import itertools
import json
import os
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, fields, is_dataclass
from datetime import datetime, timedelta, timezone
from enum import Enum
from types import UnionType
from typing import Union, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..model import AtLeast, Below, Level, Report, to_plain

# ---- codec ----


def to_json(report: Report, indent: int | None = 2) -> str:
    return json.dumps(to_plain(report), ensure_ascii=False, indent=indent)


def _read(kind, x):
    if x is None:
        return None
    origin = get_origin(kind)
    if origin in (Union, UnionType):
        return _read(next(a for a in get_args(kind) if a is not type(None)), x)
    if origin is tuple:
        return tuple(_read(get_args(kind)[0], y) for y in x)
    if isinstance(kind, type) and issubclass(kind, Enum):
        return kind(x)
    if is_dataclass(kind):
        if not isinstance(x, dict):
            raise ValueError(f"no {kind.__name__}: {x!r}")
        hints = get_type_hints(kind, vars(model))
        return kind(**{f.name: _read(hints[f.name], x[f.name]) for f in fields(kind) if x.get(f.name) is not None or (f.name in x and _optional(hints[f.name]))})
    return x


def _optional(kind) -> bool:
    return get_origin(kind) in (Union, UnionType) and type(None) in get_args(kind)


def from_json(text: str) -> Report:
    """Reads reports of other versions, too: unknown fields are left out, missing ones get their defaults."""
    d = json.loads(text)
    d.setdefault("id", "")
    for k in ("rules", "topChangedPaths"):
        d.setdefault(k, [])
    for k in ("structure", "examples"):
        d.setdefault(k, {})
    d["schemaVersion"] = d.get("schemaVersion") or 1
    run = d.setdefault("run", {})
    s = run.setdefault("settings", {})
    for k in ("baseline", "candidate"):
        v = s.get(k, k)
        s[k] = ".".join(str(v[n]) for n in ("database", "name") if n in v) or k if isinstance(v, dict) else v
    if "keyField" in s and "keyFields" not in s:
        s["keyFields"] = [s["keyField"]]
    for k in ("ignoredPaths", "orderSensitivePaths", "wildcardPaths", "expectedChangePaths", "redactedPaths"):
        s[k] = s.get(k) or []
    if isinstance(s.get("mode"), str):
        s["mode"] = {"type": s["mode"]}
    for k, zero in (("startedAt", ""), ("finishedAt", ""), ("durationMillis", 0), ("baselineCount", 0), ("candidateCount", 0), ("baselineDocsRead", 0), ("candidateDocsRead", 0)):
        run[k] = run.get(k) if run.get(k) is not None else zero
    if isinstance(run.get("thresholdSource"), dict):
        src = run["thresholdSource"]
        run["thresholdSource"] = str(src.get("kind") or src.get("type") or "configured").lower()
    return _read(Report, d)


# ---- HTML ----

_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>Comparison report</title><style>
body{font:14px/1.5 sans-serif;margin:2em auto;max-width:70em;color:#222}table{border-collapse:collapse;width:100%}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left;vertical-align:top}
.GREEN{background:#d9f2d9}.YELLOW{background:#fff3c4}.RED{background:#f8d0d0}h1 span{padding:.1em .5em}</style></head><body><div id="view"></div>
<script type="application/json" id="report-data">@@DATA@@</script><script>
const r=JSON.parse(document.getElementById("report-data").textContent),v=document.getElementById("view");
const el=(t,x,c)=>{const e=document.createElement(t);if(x!==undefined)e.textContent=x;if(c)e.className=c;return e};
const add=(title,head,rows)=>{if(!rows.length)return;v.append(el("h2",title));const t=el("table"),h=el("tr");head.forEach(x=>h.append(el("th",x)));t.append(h);rows.forEach(row=>{const e=el("tr");row.forEach(x=>e.append(x instanceof Node?x:el("td",x==null?"":String(x))));t.append(e)});v.append(t)};
const title=el("h1","Comparison ");title.append(el("span",r.verdict,r.verdict));v.append(title);
v.append(el("p",r.run.settings.baseline+" \\u2192 "+r.run.settings.candidate+", "+r.run.finishedAt+", "+r.run.durationMillis+" ms"));
add("Rules",["rule","level","threshold","reason"],r.rules.map(x=>[x.rule,el("td",x.level,x.level),x.threshold,x.reason]));
add("Keys and content",["metric","value"],[...Object.entries(r.keys),...Object.entries(r.content)].map(([k,x])=>[k,x&&typeof x==="object"?x.value:x]));
add("Changed paths",["path","documents","rate","expected","examples"],r.topChangedPaths.map(x=>[x.path,x.changedDocs,x.changeRate.value,x.expected,x.valueExamples.map(e=>e.key.value+": "+e.baseline.join(", ")+" \\u2192 "+e.candidate.join(", ")).join("\\n")]));
for(const k of ["newPaths","missingPaths","presenceDeltas"])add(k,["path","baseline","candidate"],r.structure[k].map(x=>[x.path,x.baselinePresence,x.candidatePresence]));
add("Type shifts",["path","baseline","candidate"],r.structure.typeShifts.map(x=>[x.path,...["baseline","candidate"].map(s=>x[s].map(t=>t.type+" "+t.share).join(", "))]));
add("Hints",["kind","path","message"],r.hints.map(x=>[x.kind,x.path,x.message]));add("Warnings",["warning"],r.warnings.map(x=>[x]));
</script></body></html>
"""


def to_html(report: Report) -> str:
    """A page that holds the report and needs nothing else; no `<` of the report can end its script element."""
    return _PAGE.replace("@@DATA@@", to_json(report, None).replace("<", "\\u003c"))


# ---- stores ----


#: Reports that a listing shows unless it is told otherwise.
LISTED = 50


@dataclass(frozen=True)
class Summary:
    """A line of a listing."""

    id: str
    baseline: str
    candidate: str
    verdict: str
    finishedAt: str
    labels: dict


class Queries:
    """What both stores answer; newest() gives the reports one by one, the latest first."""

    def newest(self) -> Iterator[Report]:
        raise NotImplementedError

    def all(self) -> list[Report]:
        return list(self.newest())

    def _first(self, n: int, wanted) -> list[Report]:
        return list(itertools.islice(filter(wanted, self.newest()), n))

    def find(self, id: str) -> Report | None:
        return next(iter(self._first(1, lambda r: r.id == id)), None)

    def recent(self, n: int, candidate: str | None = None) -> list[Report]:
        return self._first(n, lambda r: candidate in (None, r.run.settings.candidate))

    def by_labels(self, labels: dict[str, str], n: int) -> list[Report]:
        return self._first(n, lambda r: all(r.labels.get(k) == v for k, v in labels.items()))

    def history(self, baseline: str, candidate: str, include_red: bool, n: int) -> list[Report]:
        return self._first(n, lambda r: (r.run.settings.baseline, r.run.settings.candidate) == (baseline, candidate) and (include_red or r.verdict != Level.RED))

    def summaries(self, labels: dict[str, str] | None = None, n: int = LISTED) -> list[Summary]:
        """The newest reports' summaries, of those with all the labels."""
        return [Summary(r.id, r.run.settings.baseline, r.run.settings.candidate, r.verdict.value, r.run.finishedAt, dict(r.labels)) for r in self.by_labels(labels or {}, n)]


class FileStore(Queries):
    """A file for each report, <finishedAt>_<id>.json, put in place by an atomic rename; files that can't be read are passed over."""

    def __init__(self, directory: str, retention: timedelta | None = None, read_only: bool = False):
        self.directory, self.retention, self.read_only = directory, retention, read_only

    def _name(self, r: Report) -> str:
        return re.sub(r"[^0-9A-Za-z._-]", "-", f"{r.run.finishedAt}_{r.id}") + ".json"

    def save(self, report: Report) -> None:
        if self.read_only:
            raise OSError("the store is read-only")
        os.makedirs(self.directory, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=self.directory, suffix=".tmp", delete=False) as f:
            f.write(to_json(report))
            f.flush()
            os.fsync(f.fileno())
        os.replace(f.name, os.path.join(self.directory, self._name(report)))
        if self.retention is not None:
            limit = (datetime.now(timezone.utc) - self.retention).isoformat()
            for name in self._files():
                if name.split("_")[0] < re.sub(r"[^0-9A-Za-z._-]", "-", limit):
                    os.unlink(os.path.join(self.directory, name))

    def _files(self) -> list[str]:
        return sorted((n for n in os.listdir(self.directory) if n.endswith(".json")), reverse=True) if os.path.isdir(self.directory) else []

    def newest(self) -> Iterator[Report]:
        """By file names, which begin with the time and end with the id: no more files are read than the caller takes reports."""
        for n in self._files():
            try:
                with open(os.path.join(self.directory, n), encoding="utf-8") as f:
                    yield from_json(f.read())
            except (ValueError, TypeError, KeyError, OSError):
                continue


class TableStore(Queries):
    """Reports as rows of a Parquet folder, with columns to query by; saving appends. Reports older than the retention aren't read any more, so no
    file is ever rewritten and a crash loses none."""

    SCHEMA = "id string, baseline string, candidate string, verdict string, finished_at string, labels map<string,string>, report_json string"

    def __init__(self, spark: SparkSession, path: str, retention: timedelta | None = None):
        self.spark, self.path, self.retention = spark, path, retention

    def save(self, report: Report) -> None:
        s = report.run.settings
        row = (report.id, s.baseline, s.candidate, report.verdict.value, report.run.finishedAt, dict(report.labels), to_json(report, None))
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def frame(self) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows if self.retention is None else rows.filter(F.col("finished_at") >= (datetime.now(timezone.utc) - self.retention).isoformat())

    def _reports(self, rows: DataFrame, n: int | None = None) -> list[Report]:
        rows = rows.orderBy(F.desc("finished_at"), F.desc("id"))
        return [from_json(r.report_json) for r in (rows.limit(n) if n is not None else rows).select("report_json").collect()]

    def newest(self) -> Iterator[Report]:
        rows = self.frame().orderBy(F.desc("finished_at"), F.desc("id")).select("report_json")
        return (from_json(r.report_json) for r in rows.toLocalIterator())

    def summaries(self, labels: dict[str, str] | None = None, n: int = LISTED) -> list[Summary]:
        """From the columns; no report is read."""
        rows = self._labelled(labels or {}).orderBy(F.desc("finished_at"), F.desc("id")).limit(n)
        return [Summary(*r[:5], dict(r.labels)) for r in rows.select("id", "baseline", "candidate", "verdict", "finished_at", "labels").collect()]

    def _labelled(self, labels: dict[str, str]) -> DataFrame:
        rows = self.frame()
        for k, v in labels.items():
            rows = rows.filter(F.col("labels")[k] == v)
        return rows

    def find(self, id: str) -> Report | None:
        return next(iter(self._reports(self.frame().filter(F.col("id") == id), 1)), None)

    def recent(self, n: int, candidate: str | None = None) -> list[Report]:
        return self._reports(self.frame().filter(F.col("candidate") == candidate) if candidate else self.frame(), n)

    def by_labels(self, labels: dict[str, str], n: int) -> list[Report]:
        return self._reports(self._labelled(labels), n)

    def history(self, baseline: str, candidate: str, include_red: bool, n: int) -> list[Report]:
        rows = self.frame().filter((F.col("baseline") == baseline) & (F.col("candidate") == candidate))
        return self._reports(rows if include_red else rows.filter("verdict <> 'RED'"), n)


def copy_reports(source: Queries, target: FileStore) -> int:
    """Copies all reports, one by one; those that are there already are written again, with the same content."""
    n = 0
    for n, r in enumerate(source.newest(), 1):  # noqa: B007
        target.save(r)
    return n


__all__ = ["AtLeast", "Below", "FileStore", "Queries", "Summary", "TableStore", "copy_reports", "from_json", "to_html", "to_json"]
