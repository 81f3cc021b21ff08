import json
import os
from dataclasses import replace
from datetime import timedelta

import pytest
from conftest import SF
from pyspark.sql import functions as F

from twinsift.cli import main
from twinsift.model import ComparisonError, Level, MixedKeyPolicy, Mode, Report, Request, Settings
from twinsift.operators.generate import ChangeSpec, mutate, product_documents
from twinsift.operators.maps import detect
from twinsift.operators.verdict import Adaptive, learned
from twinsift.plans.compare import Comparator, compare, resolve_mode
from twinsift.sources.reports import FileStore, TableStore, copy_reports, from_json, to_html, to_json
from twinsift.sources.side import Side, key_range, preflight
from twinsift.canon import parse_document


def docs(spark, rows, name="baseline"):
    return Side(spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "doc string"), doc="doc", name=name)


def run(spark, a, b, **k):
    return compare(docs(spark, a), docs(spark, b, "candidate"), Settings(**k))


def rule(r: Report, name: str) -> Level:
    return next(x.level for x in r.rules if x.rule == name)


def test_document_scenarios(spark):
    base = [{"_id": i, "name": f"n{i}", "tags": ["a", "b"], "m": {"v": i}} for i in range(60)]
    r = run(spark, base, [{"m": d["m"], "tags": ["b", "a"], "name": d["name"], "_id": d["_id"]} for d in base])
    assert r.verdict == Level.GREEN and r.content.unchanged == 60
    r = run(spark, base, [dict(d, tags=["b", "a"]) for d in base], orderSensitivePaths=("tags",))
    assert r.content.changed == 60 and r.topChangedPaths[0].path == "tags[]" and r.verdict == Level.RED
    r = run(spark, base, [json.dumps(d).replace(f'"v": {d["_id"]}', f'"v": {d["_id"]}.0') for d in base])
    assert r.content.unchanged == 60 and rule(r, "structure.typeShifts") == Level.RED and r.structure.typeShifts[0].path == "m.v"
    r = run(spark, base, [{k: v for k, v in d.items() if k != "m"} for d in base[:59]] + [{"_id": "new", "x": 1}], mixedKeyTypes=MixedKeyPolicy.COMPARE)
    assert [p.path for p in r.structure.missingPaths] == ["m", "m.v"] and (r.keys.added, r.keys.removed) == (1, 1) and r.warnings
    assert {h.kind for h in r.hints} >= {"INVESTIGATE"} and r.examples.removed[0].value == "59"
    with pytest.raises(ComparisonError, match="several types"):
        run(spark, base, [{"_id": "x"}])
    for bad in ([{"_id": 1}, {"_id": 1.0}], [{"a": 1}], [{"_id": [1]}]):
        with pytest.raises(ComparisonError):
            run(spark, base, bad)


def test_empty_sides(spark):
    assert run(spark, [], []).verdict == Level.GREEN
    assert run(spark, [{"_id": 1}], []).verdict == Level.RED
    r = run(spark, [{"_id": 1}], [{"_id": 2}], matchedOnly=True)
    assert rule(r, "keySimilarity") == Level.RED and r.keys.matched == 0


def test_typed_equals_documents(spark):
    """The Catalyst path and the document path give the same report."""
    b = spark.read.parquet(f"{SF}/orders.parquet").drop("o_orderdate").limit(400)
    c = mutate(b, "o_orderkey", ["modify:o_totalprice:0.1", "set-null:o_orderpriority:0.1", "int-to-double:o_custkey:1", "delete-docs:0.05", "add-docs:0.05"])
    key = ("o_orderkey",)
    s = Settings(keyFields=key, expectedChangePaths=("o_totalprice",), redactedPaths=("o_orderpriority",))
    x = compare(Side(b, key), Side(c, key, name="candidate"), s)
    wrap = lambda d: d.withColumn("empty", F.array().cast("array<int>"))  # noqa: E731  an array column leaves Catalyst's path
    y = compare(Side(wrap(b), key), Side(wrap(c), key, name="candidate"), s)
    assert (x.keys, x.content, x.verdict) == (y.keys, y.content, y.verdict)
    assert [(p.path, p.changedDocs, p.expected) for p in x.topChangedPaths] == [(p.path, p.changedDocs, p.expected) for p in y.topChangedPaths]
    assert [p.valueExamples for p in x.topChangedPaths] == [p.valueExamples for p in y.topChangedPaths]
    assert x.structure.typeShifts == tuple(t for t in y.structure.typeShifts if t.path != "empty")
    assert x.examples == y.examples and x.content.changedExpectedOnly > 0


def test_sample_and_matched_only(spark):
    b = spark.range(6000).select(F.col("id").alias("_id"), (F.col("id") % 50).alias("price"))
    c = mutate(b, "_id", ["modify:price:0.3", "delete-docs:0.02", "add-docs:0.05"])
    full = compare(Side(b), Side(c, name="candidate"), Settings())
    est = compare(Side(b), Side(c, name="candidate"), Settings(mode=Mode("SAMPLE", 1500)))
    again = compare(Side(b), Side(c, name="candidate"), Settings(mode=Mode("SAMPLE", 1500)))
    assert est.keys == again.keys and est.keys.keySimilarity.lower <= full.keys.keySimilarity.value <= est.keys.keySimilarity.upper
    assert est.content.unchangedRate.lower <= full.content.unchangedRate.value <= est.content.unchangedRate.upper
    assert abs(est.topChangedPaths[0].changedDocs - full.topChangedPaths[0].changedDocs) < 300
    part = Side(c.filter("_id % 10 = 0"), name="candidate")
    only = compare(Side(b), part, Settings(matchedOnly=True))
    assert only.keys.matched == b.join(part.df, "_id").count() and only.structure.baselineDocs == only.keys.matched
    assert any(h.kind == "MATCHED_ONLY" for h in compare(Side(b), part, Settings()).hints)
    assert resolve_mode(Settings(fullScanLimit=10), 11, 5)[0] == Mode("SAMPLE", 20_000) and resolve_mode(Settings(fullScanLimit=10, matchedOnly=True), 11, 5)[0] == Mode("FULL")


def test_typed_checks(spark):
    b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "_id int, x double")
    for bad in (b.unionByName(b), b.withColumn("_id", F.col("_id").cast("string")), b.drop("_id"), b.withColumn("_id", F.lit(None).cast("int"))):
        with pytest.raises(ComparisonError):
            compare(Side(b), Side(bad, name="candidate"), Settings())
    odd = spark.createDataFrame([(1, 9007199254740993), (2, 3)], "_id int, x long")
    near = spark.createDataFrame([(1, 9007199254740992.0), (2, 3.0)], "_id int, x double")
    r = compare(Side(odd), Side(near, name="candidate"), Settings())
    assert (r.content.changed, r.content.unchanged) == (1, 1)
    nan = spark.createDataFrame([(1, float("nan")), (2, -0.0)], "_id int, x double")
    assert compare(Side(nan), Side(nan.withColumn("x", F.when(F.col("_id") == 2, 0.0).otherwise(F.col("x"))), name="candidate"), Settings()).content.changed == 0


def test_maps_and_nested(spark):
    sample = [parse_document(json.dumps({"_id": i, "m": {f"k{i % 40}": {f"x{i}": 1}}, "f": {"a": 1}})) for i in range(100)]
    found = detect(sample)
    assert [m.pattern for m in found] == ["m.*", "m.*.*"] and found[0].distinctKeys == 40
    p = product_documents(spark, 80)
    q = mutate(p, "_id", ["modify:category.name:0.2", "shuffle-arrays:1", "modify:attributes:0.3"])
    r = compare(Side(p), Side(q, name="candidate"), Settings(wildcardPaths=("attributes.*",), orderSensitivePaths=("history",)))
    assert {x.path for x in r.topChangedPaths} == {"category.name", "history[].at", "history[].event", "attributes.*"}
    r = compare(Side(p), Side(q, name="candidate"), Settings(ignoredPaths=("category", "attributes", "history")))
    assert r.verdict == Level.GREEN and r.content.unchanged == 80


def test_change_specs():
    assert str(ChangeSpec.parse("modify:a.b:0.5")) == "modify:a.b:0.5" and ChangeSpec.parse("delete-docs:1").path is None
    for bad in ("modify:0.5", "nothing:a:1", "delete-docs:a:1", "modify:a:2", "modify:a:x"):
        with pytest.raises(ValueError):
            ChangeSpec.parse(bad)


def test_reports_and_history(spark, tmp_path):
    b = spark.range(50).select(F.col("id").alias("_id"), (F.col("id") % 7).alias("v"))
    store, seen = FileStore(str(tmp_path / "r")), []
    c = Comparator(Settings(), store, Adaptive(minHistory=2), [lambda *x: seen.append(x[0])])
    for _ in range(3):
        last = c.compare(Side(b), Side(mutate(b, "_id", ["modify:v:0.1"]), name="candidate"), labels={"job": "1"})
    assert last.run.thresholdSource == "learned from 2 runs" and seen == ["completed"] * 3 and c.metrics["runs"] == 3
    with pytest.raises(ComparisonError):
        c.compare(Side(b), Side(b.unionByName(b), name="candidate"))
    assert seen[-1] == "failed" and c.metrics["errors"] == 1
    assert from_json(to_json(last)) == last == store.find(last.id) == store.recent(1)[0] == store.by_labels({"job": "1"}, 9)[0]
    assert len(store.history("baseline", "candidate", True, 9)) == 3 and store.by_labels({"job": "2"}, 9) == []
    (tmp_path / "r" / "broken.json").write_text("{")
    assert len(store.all()) == 3
    html = to_html(replace(last, warnings=("</script><b>",)))
    assert html.startswith("<!doctype html>") and "</script><b>" not in html and html.count("application/json") == 1
    table = TableStore(spark, str(tmp_path / "t"))
    for r in store.all():
        table.save(r)
    assert table.summaries({"job": "1"}, 2) == store.summaries({"job": "1"}, 2) and [x.id for x in store.summaries()] == [r.id for r in store.all()] and store.summaries({"job": "9"}) == []
    assert [r.id for r in table.recent(2)] == [r.id for r in store.recent(2)] and table.find(last.id) == last and table.by_labels({"job": "1"}, 1)[0] == last
    assert copy_reports(table, FileStore(str(tmp_path / "copy"))) == 3 and len(FileStore(str(tmp_path / "copy")).all()) == 3
    old = FileStore(str(tmp_path / "r"), retention=timedelta(0))
    old.save(last)
    assert len([n for n in os.listdir(tmp_path / "r") if n[0] == "2"]) == 0
    with pytest.raises(OSError):
        FileStore(str(tmp_path / "r"), read_only=True).save(last)


def test_learned_thresholds(spark):
    b = spark.range(20).select(F.col("id").alias("_id"))
    r = compare(Side(b), Side(b, name="candidate"), Settings())
    t, source = learned([r] * 5, r.run.settings.thresholds)
    assert source == "learned from 5 runs" and t.keySimilarity.green == pytest.approx(0.99) and t.keySimilarity.yellow == pytest.approx(0.985) and t.maxPathChangeRate.green == pytest.approx(0.01)
    assert learned([r] * 4, r.run.settings.thresholds)[1] == "configured" and learned([replace(r, verdict=Level.RED)] * 9, r.run.settings.thresholds)[1] == "configured"


def test_cli(spark, tmp_path, capsys):
    d = str(tmp_path)
    assert main(["generate", f"--baseline={d}/p_backup", f"--candidate={d}/p", "--docs=1_00", "--changes=modify:price:0.02", "--touch-sync=false"], spark) == 0
    code = main(["compare", f"--dataset={d}/p", f"--out={d}/r.json", f"--html={d}/r.html", "--persist", f"--report-dir={d}/reports", "--label=job=7"], spark)
    report = json.loads(capsys.readouterr().out)
    assert code == {"GREEN": 0, "YELLOW": 1, "RED": 2}[report["verdict"]] and report["labels"] == {"job": "7"} and os.path.exists(f"{d}/r.html")
    assert main(["report", f"--report-dir={d}/reports", "--label=job=7"]) == code and json.loads(capsys.readouterr().out)["id"] == report["id"]
    assert main(["reports", f"--report-dir={d}/reports", "--label=job=7"]) == 0 and [x["id"] for x in json.loads(capsys.readouterr().out)] == [report["id"]]
    assert main(["reports", f"--report-dir={d}/reports", "--label=job=8"]) == 0 and json.loads(capsys.readouterr().out) == []
    assert main(["report", f"--report-dir={d}/none"]) == 3 and main(["compare", "--baseline=x"], spark) == 3 and main(["nothing"]) == 3


def test_backup_and_cancel(spark, tmp_path):
    b = spark.range(30).select(F.col("id").alias("_id"))
    for name in ("x", "x_backup"):
        b.write.parquet(str(tmp_path / name))
    c = Comparator()
    c.cancel(spark)
    r = c.compare_with_backup(spark, str(tmp_path / "x"))
    assert r.verdict == Level.GREEN and r.run.settings.baseline.endswith("x_backup")


def test_stream(spark, tmp_path):
    from twinsift.streaming import compare_stream

    b = spark.range(100).select(F.col("id").alias("_id"), F.col("id").alias("v"))
    mutate(b, "_id", ["modify:v:0.5"]).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(b.schema).parquet(str(tmp_path / "in"))
    compare_stream(stream, Side(b), Settings(), lambda i, r: got.append((i, r)), str(tmp_path / "c")).awaitTermination()
    assert len(got) == 1 and got[0][1].keys.matched == 100 and got[0][1].content.changed > 20


def test_mixed_typed_keys_follow_the_policy(spark):
    b = Side(spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), ("k",))
    c = Side(spark.createDataFrame([("1", "x")], "k string, v string"), ("k",), name="candidate")
    with pytest.raises(ComparisonError):
        compare(b, c, Settings(keyFields=("k",)))
    r = compare(b, c, Settings(keyFields=("k",), mixedKeyTypes=MixedKeyPolicy.COMPARE))
    assert (r.keys.matched, r.keys.added, r.keys.removed) == (0, 1, 2)
    d = Side(spark.createDataFrame([(1.0, "x"), (9007199254740992.0, "z")], "k double, v string"), ("k",), name="candidate")
    e = Side(spark.createDataFrame([(1, "x"), (9007199254740993, "z")], "k long, v string"), ("k",))
    r = compare(e, d, Settings(keyFields=("k",)))
    assert (r.keys.matched, r.keys.added, r.keys.removed, r.content.unchanged) == (1, 1, 1, 1)


def test_documents_are_looked_up_sampled_and_named_when_broken(spark):
    docs = lambda *xs: Side(spark.createDataFrame([(x,) for x in xs], "doc string"), ("_id",), "doc")
    side = docs('{"_id": 1, "a": 2}', '{"_id": "1", "a": 3}', '{"_id": 2}')
    assert [r[0] for r in side.lookup(docs('{"_id": 1.0}', '{"_id": 9}')).df.collect()] == ['{"_id": 1, "a": 2}']
    assert [r[0] for r in side.lookup(spark.createDataFrame([("1",)], "_id string")).df.collect()] == ['{"_id": "1", "a": 3}']
    assert side.sample(2, "s").count() == 2 and side.sample(9, "s").count() == 3 and side.keys_only().count() == 3
    with pytest.raises(Exception, match="baseline: a document can't be read"):
        docs('{"_id": 1', "{}").documents().collect()


def test_request_and_progress(spark):
    b = spark.range(3000).select(F.col("id").alias("_id"), (F.col("id") % 7).alias("v"))
    seen = []
    c = Comparator(progress=[seen.append], progress_seconds=0.05)
    r = c.run(Side(b), Side(mutate(b, "_id", ["modify:v:0.1"]), name="candidate"), Request().sample(500).label("job", "1").label("night", "2"))
    assert r.run.settings.mode == Mode("SAMPLE", 500) and r.labels == {"job": "1", "night": "2"}
    last = seen[-1]
    assert last.finished and not seen[0].finished and last.baselineDocs == r.run.baselineDocsRead == 500 and last.docsPerSecond > 0
    assert all(0 <= p.tasksDone <= p.tasks for p in seen) and any(p.tasks for p in seen) and any(p.baselineDocs == 3000 for p in seen[:-1])
    full = c.run(Side(b), Side(b, name="candidate"), Request().full_scan().matched_only())
    assert full.run.settings.matchedOnly and full.run.settings.mode == Mode("FULL") and seen[-1].baselineDocs == 3000
    with pytest.raises(ValueError, match="nothing"):
        Request().options(nothing=1)
    n = len(seen)
    with pytest.raises(ComparisonError):
        c.compare(Side(b), Side(b.unionByName(b), name="candidate"))
    assert not any(p.finished for p in seen[n:])


def test_preflight_and_key_range(spark):
    b = spark.range(5, 20).select(F.col("id").alias("_id"), F.lit("x").alias("p"))
    far = Side(b.withColumn("_id", F.col("_id") + 100), name="candidate")
    p = preflight(Side(b), far, Settings())
    assert (p.baselineCount, p.candidateCount, p.baselineRange, p.candidateRange) == (15, 15, (5, 19), (105, 119)) and "No key can match" in p.warnings[0]
    assert not preflight(Side(b), Side(b, name="candidate"), Settings()).warnings
    assert tuple(key_range(Side(b.limit(0))).first()) == (None, None) and preflight(Side(b.limit(0)), Side(b, name="candidate"), Settings()).warnings == ()
    assert tuple(map(tuple, key_range(Side(b, ("p", "_id"))).first())) == (("x", 5), ("x", 19))
    mixed = docs(spark, [{"_id": 10}, {"_id": 9}, {"_id": "a"}])
    assert tuple(key_range(mixed).first()) == ("9", '"a"')
    with pytest.raises(ComparisonError, match="several types"):
        preflight(mixed, docs(spark, [{"_id": 1}], "candidate"), Settings())
    assert preflight(mixed, docs(spark, [{"_id": 1}], "candidate"), Settings(mixedKeyTypes=MixedKeyPolicy.COMPARE)).warnings
    with pytest.raises(ComparisonError, match="2 times"):
        preflight(Side(b), Side(b.unionByName(b), name="candidate"), Settings())
