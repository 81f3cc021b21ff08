"""Joins of the two sides and the classification of their pairs.

pairs(): one row for each key: _key (sorts as the key), _ktype, _kvalue, status (unchanged, changed, added, removed), paths (changed
leaf paths, sorted), values (path -> baseline and candidate values). Typed frames go through Catalyst expressions only; documents are
joined by Spark and compared in Arrow batches, changed ones only.
"""

from __future__ import annotations

import json
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import canon
from ..functions.expressions import rendered, same, type_name
from ..model import Settings
from ..paths import PathMatcher, Rules
from ..sources.side import Side, field_text, key_text, mixed_keys, quoted

VALUES = "map<string,struct<baseline:array<string>,candidate:array<string>>>"


def rules_of(s: Settings) -> Rules:
    return Rules(s.ignoredPaths, s.orderSensitivePaths, s.wildcardPaths)


# ---- typed frames ----


def leaf_columns(schema: T.StructType, rules: Rules, skip: tuple[str, ...] = ()) -> list[tuple[str, tuple[str, ...], T.DataType]]:
    """(reported path, column steps, type) of the atomic leaves, without ignored ones and without the fields `skip` of the root."""
    out = []

    def walk(t, state, path, steps):
        for f in t.fields:
            if not steps and f.name in skip:
                continue
            s, p = state.field(f.name), state.name(path, f.name)
            if s.ignored:
                continue
            if isinstance(f.dataType, T.StructType) and f.dataType.fields:
                walk(f.dataType, s, p, (*steps, f.name))
            else:
                out.append((p, (*steps, f.name), f.dataType))

    walk(schema, rules.root, "", ())
    return out


def at(side: str, steps: tuple[str, ...]) -> Column:
    c = F.col(side)
    for s in steps:
        c = c.getField(s)
    return c


def typed_join(base: Side, cand: Side, how: str = "full_outer") -> DataFrame:
    """Rows of both sides as structs b and c, on equal keys k0, k1, ..."""
    keys = [f"k{i}" for i in range(len(base.keys))]
    side = lambda s, name: s.df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(s.keys)], F.struct(*[F.col(f"`{c}`") for c in s.df.columns]).alias(name))
    return side(base, "b").join(side(cand, "c"), keys, how)


def typed_pairs(base: Side, cand: Side, s: Settings, how: str = "full_outer") -> DataFrame:
    """Pairs of typed rows. Keys of different types on the two sides are matched exactly, as documents' keys."""
    if mixed_keys(base, cand):
        return document_pairs(base.documents(), cand.documents(), replace(s, keyFields=tuple(base.keys)), how)
    rules, redacted = rules_of(s), PathMatcher(s.redactedPaths)
    left = {x[1]: x for x in leaf_columns(base.df.schema, rules, base.keys)}
    right = {x[1]: x for x in leaf_columns(cand.df.schema, rules, cand.keys)}
    joined = typed_join(base, cand, how)
    checks = []
    for steps in sorted({*left, *right}):
        path = (left.get(steps) or right[steps])[0]
        b, c = (at("b", steps) if steps in left else F.lit(None)), (at("c", steps) if steps in right else F.lit(None))
        tb, tc = (left[steps][2] if steps in left else None), (right[steps][2] if steps in right else None)
        # a column that one side hasn't is a field that its documents don't have, whatever stands in it on the other side
        equal = same(b, tb, c, tc) if tb and tc else (F.coalesce(b, c).isNull() if s.nullEqualsMissing else F.lit(False))
        checks.append((path, ~equal, b if tb else None, tb, c if tc else None, tc))
    both = F.col("b").isNotNull() & F.col("c").isNotNull()
    changed = F.lit(False)
    for _, x, *_ in checks:
        changed = changed | x
    status = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "removed").when(changed, "changed").otherwise("unchanged")
    hide = F.lit(canon.REDACTED)
    show = lambda path, v, t: F.array().cast("array<string>") if t is None else F.array(hide if redacted.matches(path) else rendered(v, t))
    found = F.array(*[F.when(x, F.struct(F.lit(p).alias("path"), F.struct(show(p, b, tb).alias("baseline"), show(p, c, tc).alias("candidate")).alias("v"))) for p, x, b, tb, c, tc in checks]) if checks else None
    found = F.when(both & (status == "changed"), F.filter(found, lambda x: x.isNotNull())) if checks else F.lit(None).cast("array<struct<path:string,v:struct<baseline:array<string>,candidate:array<string>>>>")
    keys = [f"k{i}" for i in range(len(base.keys))]
    out = joined.select(F.struct(*keys).alias("_key"), *key_text(base, keys), status.alias("status"), F.coalesce(found, F.array().cast("array<struct<path:string,v:struct<baseline:array<string>,candidate:array<string>>>>")).alias("found"))
    paths = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["path"])))
    values = F.map_from_entries(F.transform(F.array_distinct(F.transform("found", lambda x: x["path"])), lambda p: F.struct(p, F.element_at(F.filter("found", lambda x: x["path"] == p), 1)["v"])))
    return out.select("_key", "_ktype", "_kvalue", "status", paths.alias("paths"), values.cast(VALUES).alias("values"))


# ---- documents ----


def document_join(base: DataFrame, cand: DataFrame, how: str = "full_outer", by: tuple[str, ...] = ("_ksort",)) -> DataFrame:
    """Documents of both sides (frames of Side.documents() or native_documents()) on equal keys: _key, _ktype, _kvalue, b, c."""
    cols = (*by, "_ktype", "_kvalue", "_doc")
    b, c = (d.select(*[F.col(x).alias(f"{n}{x}") for x in cols]) for d, n in ((base, "b"), (cand, "c")))
    on = [F.col(f"b{k}") == F.col(f"c{k}") for k in by]
    both = lambda x: F.coalesce(f"b{x}", f"c{x}")
    return b.join(c, on, how).select(F.struct(*[both(k).alias(k) for k in by]).alias("_key"), both("_ktype").alias("_ktype"), both("_kvalue").alias("_kvalue"), F.col("b_doc").alias("b"), F.col("c_doc").alias("c"))


def document_pairs(base: DataFrame, cand: DataFrame, s: Settings, how: str = "full_outer", by: tuple[str, ...] = ("_ksort",)) -> DataFrame:
    """Pairs of documents. Equal texts are equal documents; only the others' texts go to Python."""
    keys, nulls, ignored, ordered, wild, red = s.keyFields, s.nullEqualsMissing, s.ignoredPaths, s.orderSensitivePaths, s.wildcardPaths, s.redactedPaths
    j = document_join(base, cand, how, by)
    simple = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "removed").when(F.col("b") == F.col("c"), "unchanged")
    undecided = lambda c: F.when(simple.isNull(), F.col(c)).alias(c)
    key = j.schema["_key"].dataType
    j = j.select("_key", "_ktype", "_kvalue", simple.alias("status"), undecided("b"), undecided("c"))
    value = pa.map_(pa.string(), pa.struct([("baseline", pa.list_(pa.string())), ("candidate", pa.list_(pa.string()))]))

    def run(batches):
        rules, redacted = Rules(ignored, ordered, wild), PathMatcher(red)
        for t in batches:
            status, paths, values = t.column(3).to_pylist(), [[]] * t.num_rows, [[]] * t.num_rows
            for i in t.column(3).is_null().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
                x, y = (canon.normalize(canon.parse_document(t.column(k)[i].as_py()), rules, keys, nulls) for k in (4, 5))
                status[i] = "unchanged" if x == y else "changed"
                if x != y:
                    found = canon.changed_paths(x, y, rules)
                    paths[i] = sorted(found)
                    values[i] = [(p, {"baseline": u, "candidate": v}) for p, (u, v) in canon.value_changes(x, y, found, rules, redacted).items()]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), pa.array(status, pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array(values, value)], names=["_key", "_ktype", "_kvalue", "status", "paths", "values"])

    schema = T.StructType([T.StructField("_key", key)] + [T.StructField(n, t) for n, t in (("_ktype", T.StringType()), ("_kvalue", T.StringType()), ("status", T.StringType()), ("paths", T.ArrayType(T.StringType())))]).add("values", values_type())
    return j.mapInArrow(run, schema)


def values_type() -> T.MapType:
    """The type of values."""
    return T.MapType(T.StringType(), T.StructType([T.StructField("baseline", T.ArrayType(T.StringType())), T.StructField("candidate", T.ArrayType(T.StringType()))]))


# ---- structure profiles ----


def profiled(schema: T.StructType, s: Settings) -> bool:
    """Whether typed_profile can tell all paths from the schema: it can't where a map's names are paths of their own."""
    rules = rules_of(s)

    def known(t, state) -> bool:
        if state.ignored:
            return True
        if isinstance(t, T.StructType):
            return all(known(f.dataType, state.field(f.name)) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return known(t.elementType, state.element())
        return not isinstance(t, T.VariantType) and (not isinstance(t, T.MapType) or (state.collapses and known(t.valueType, state.field("*"))))

    return known(schema, rules.root)


def typed_profile(df: DataFrame, s: Settings) -> DataFrame:
    """(path, type, docs): rows whose path has the type, key fields included; all paths of the schema in one aggregate, arrays and maps by exists().

    Conditions are SQL text: a column built call by call costs the driver more than a small comparison takes.
    """
    rules = rules_of(s)
    by: dict[tuple[str, str], list[str]] = {}

    def walk(t, state, path, some, depth):
        """some(test): the condition that some value of this node passes the test; test makes a condition of a value's expression."""
        x = f"x{depth}"
        if isinstance(t, T.StructType):
            steps = [(state.field(f.name), state.name(path, f.name), f.dataType, lambda test, n=f.name: some(lambda c: f"({c} IS NOT NULL AND {test(field_text(c, n))})"), s.nullEqualsMissing) for f in t.fields]
        elif isinstance(t, T.ArrayType):
            steps = [(state.element(), path + "[]", t.elementType, lambda test: some(lambda c: f"coalesce(exists({c}, {x} -> {test(x)}), false)"), False)]
        elif isinstance(t, T.MapType):
            steps = [(state.field("*"), state.name(path, "*"), t.valueType, lambda test: some(lambda c: f"coalesce(exists(map_values({c}), {x} -> {test(x)}), false)"), s.nullEqualsMissing)]
        else:
            return
        for st, p, kind, any_of, no_null in steps:
            node(st, p, kind, any_of, no_null, depth + 1)

    def node(st, p, kind, any_of, no_null, depth):
        if not st.ignored:
            by.setdefault((p, type_name(kind)), []).append(any_of(lambda c: f"{c} IS NOT NULL"))
            if not no_null:
                by.setdefault((p, "NULL"), []).append(any_of(lambda c: f"{c} IS NULL"))
            walk(kind, st, p, any_of, depth)

    for f in df.schema.fields:
        node(rules.root.field(f.name), rules.root.name("", f.name), f.dataType, lambda test, n=f.name: test(quoted(n)), s.nullEqualsMissing, 0)
    whole: dict[str, list[str]] = {}
    for (p, _), on in by.items():
        whole.setdefault(p, []).extend(on)
    rows = [(p, t, on) for (p, t), on in by.items()] + [(p, None, on) for p, on in whole.items()]
    if not rows:
        return df.sparkSession.createDataFrame([], "path string, type string, docs long")
    counts = df.selectExpr("array(" + ", ".join(f"count_if({' OR '.join(on)})" for _, _, on in rows) + ") AS docs")
    names = F.from_json(F.lit(json.dumps([{"path": p, "type": t} for p, t, _ in rows])), "array<struct<path:string,type:string>>")
    return counts.select(F.inline(F.arrays_zip(names.alias("name"), F.col("docs")))).select("name.path", "name.type", "docs").filter("docs > 0")


def document_profile(docs: DataFrame, s: Settings) -> DataFrame:
    """The same of documents (column _doc); type is null in the rows that count a path whatever its type. Counts are summed in each task first."""
    nulls, ignored, ordered, wild = s.nullEqualsMissing, s.ignoredPaths, s.orderSensitivePaths, s.wildcardPaths

    def run(batches):
        from collections import Counter

        rules, n = Rules(ignored, ordered, wild), Counter()

        def flush():
            rows = list(n.items())
            n.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for (p, _), _ in rows], pa.string()), pa.array([t for (_, t), _ in rows], pa.string()), pa.array([c for _, c in rows], pa.int64())], names=["path", "type", "docs"])

        for b in batches:
            for d in b.column(0).to_pylist():
                found = canon.node_types(canon.parse_document(d), rules, nulls)
                n.update(found)
                n.update((p, None) for p in {p for p, _ in found})
            if len(n) > 200_000:
                yield flush()
        yield flush()

    return docs.select("_doc").mapInArrow(run, "path string, type string, docs long").groupBy("path", "type").agg(F.sum("docs").alias("docs"))
