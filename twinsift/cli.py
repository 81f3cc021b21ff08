"""Command line: compare, report, reports, copy-reports, generate. Exit code 0 GREEN, 1 YELLOW, 2 RED, 3 error."""

from __future__ import annotations

import argparse
import json
import sys

from .model import Level, MixedKeyPolicy, Mode, Settings, VerdictBasis, parse_labels, to_plain
from .operators.generate import ChangeSpec, mutate, product_documents
from .operators.verdict import Adaptive
from .plans.compare import BACKUP_SUFFIX, Comparator
from .sources.reports import LISTED, FileStore, TableStore, copy_reports, to_html, to_json
from .sources.side import read_side

EXIT = {Level.GREEN: 0, Level.YELLOW: 1, Level.RED: 2}
ERROR = 3


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _int(text: str) -> int:
    return int(text.replace("_", ""))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinsift", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare", help="compare two datasets, print the report as JSON")
    c.add_argument("--dataset", help="compares <dataset>_backup (baseline) with <dataset> (candidate)")
    c.add_argument("--baseline")
    c.add_argument("--candidate")
    c.add_argument("--format", default="parquet", help="parquet, orc, csv, json, jsonl (documents as they stand), table")
    c.add_argument("--doc", help="column that holds JSON documents")
    c.add_argument("--key", type=_list, default=["_id"])
    for name in ("ignore", "ordered", "wildcard", "expected", "redact"):
        c.add_argument(f"--{name}", type=_list, default=[])
    c.add_argument("--mode", choices=["auto", "full", "sample"])
    c.add_argument("--sample-size", type=_int)
    c.add_argument("--full-scan-limit", type=_int)
    c.add_argument("--matched-only", action="store_true")
    c.add_argument("--null-equals-missing", action="store_true")
    c.add_argument("--mixed-key-types", choices=["reject", "compare"], default="reject")
    c.add_argument("--verdict-basis", choices=["conservative", "point"], default="conservative")
    c.add_argument("--label", action="append", default=[])
    c.add_argument("--persist", action="store_true")
    c.add_argument("--adaptive", action="store_true", help="learn thresholds from stored reports")
    r = sub.add_parser("report", help="print a stored report")
    r.add_argument("--id")
    r.add_argument("--label", action="append", default=[])
    r.add_argument("--candidate")
    z = sub.add_parser("reports", help="list the newest stored reports as JSON")
    z.add_argument("--label", action="append", default=[])
    z.add_argument("--limit", type=_int, default=LISTED)
    y = sub.add_parser("copy-reports", help="copy the reports of a table into files")
    y.add_argument("--table", required=True)
    g = sub.add_parser("generate", help="write a baseline of product documents and a changed copy")
    g.add_argument("--baseline", required=True)
    g.add_argument("--candidate", required=True)
    g.add_argument("--docs", type=_int, default=10_000)
    g.add_argument("--seed", type=_int, default=42)
    g.add_argument("--touch-sync", choices=["true", "false"], default="true")
    g.add_argument("--changes", type=_list, default=[])
    for q in (c, r):
        q.add_argument("--out")
        q.add_argument("--html")
    for q in (c, r, y, z):
        q.add_argument("--report-dir", default="./reports")
    return p


def _emit(report, a) -> int:
    text = to_json(report)
    print(text)
    for path, content in ((a.out, text), (a.html, to_html(report) if a.html else "")):
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(content)
    print(f"{report.verdict.value}: " + "; ".join(x.reason for x in report.rules if x.level != Level.GREEN), file=sys.stderr)
    for h in report.hints:
        print(f"hint: {h.message}" + (f" ({h.cliOption})" if h.cliOption else ""), file=sys.stderr)
    return EXIT[report.verdict]


def _compare(a, spark) -> int:
    base, cand = (a.dataset + BACKUP_SUFFIX, a.dataset) if a.dataset else (a.baseline, a.candidate)
    if not base or not cand:
        raise ValueError("give --dataset, or --baseline and --candidate")
    mode = Mode("SAMPLE", a.sample_size or 20_000) if a.mode == "sample" or a.sample_size else Mode((a.mode or "auto").upper())
    s = Settings(base, cand, tuple(a.key), mode, a.matched_only, ignoredPaths=a.ignore, orderSensitivePaths=a.ordered, wildcardPaths=a.wildcard, expectedChangePaths=a.expected, redactedPaths=a.redact,
                 nullEqualsMissing=a.null_equals_missing, mixedKeyTypes=MixedKeyPolicy(a.mixed_key_types.upper()), verdictBasis=VerdictBasis(a.verdict_basis.upper()), labels=parse_labels(a.label))
    s = s.merged(fullScanLimit=a.full_scan_limit)
    store = FileStore(a.report_dir) if a.persist or a.adaptive else None
    sides = [read_side(spark, path, a.key, a.format, a.doc, path) for path in (base, cand)]
    return _emit(Comparator(s, store, Adaptive() if a.adaptive else None).compare(*sides), a)


def _report(a, spark) -> int:
    store = FileStore(a.report_dir, read_only=True)
    if a.id:
        found = store.find(a.id)
    elif a.label:
        found = next(iter(store.by_labels(parse_labels(a.label), 1)), None)
    else:
        found = next(iter(store.recent(1, a.candidate)), None)
    if found is None:
        raise ValueError("no report matches")
    return _emit(found, a)


def _reports(a, spark) -> int:
    found = FileStore(a.report_dir, read_only=True).summaries(parse_labels(a.label), a.limit)
    print(json.dumps(to_plain(found), ensure_ascii=False, indent=2))
    return 0


def _generate(a, spark) -> int:
    specs = [ChangeSpec.parse(x) for x in a.changes]
    docs = product_documents(spark, a.docs, a.seed)
    docs.write.mode("overwrite").parquet(a.baseline)
    base = spark.read.parquet(a.baseline)
    if a.touch_sync == "true":
        specs = [ChangeSpec("modify", "meta.syncedAt", 1.0), *specs]
    mutate(base, "_id", specs, str(a.seed)).write.mode("overwrite").parquet(a.candidate)
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return ERROR if e.code else 0
    try:
        if spark is None and a.command not in ("report", "reports"):
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("twinsift").getOrCreate()
        if a.command == "copy-reports":
            print(copy_reports(TableStore(spark, a.table), FileStore(a.report_dir)), "reports copied")
            return 0
        return {"compare": _compare, "report": _report, "reports": _reports, "generate": _generate}[a.command](a, spark)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return ERROR


if __name__ == "__main__":
    sys.exit(main())
