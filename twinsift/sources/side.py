"""The two sides of a comparison: typed frames or frames of JSON documents, their keys, checks, samples and lookups."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import canon
from ..functions.expressions import sample_order, type_name
from ..model import ComparisonError, MixedKeyPolicy, Settings

KEY = ("_ksort", "_ktype", "_kvalue", "_kbracket")
_DOC = "_ksort binary, _ktype string, _kvalue string, _kbracket string, _doc string"


@dataclass(frozen=True)
class Side:
    """A keyed frame. doc: the column of JSON documents; None for a typed frame, whose rows are the documents."""

    df: DataFrame
    keys: tuple[str, ...] = ("_id",)
    doc: str | None = None
    name: str = "baseline"

    @property
    def typed(self) -> bool:
        """Whether Catalyst expressions can do it all: atomic leaves, structs at most."""
        flat = lambda t: all(flat(f.dataType) for f in t.fields) if isinstance(t, T.StructType) else not isinstance(t, (T.ArrayType, T.MapType, T.VariantType))
        return self.doc is None and flat(self.df.schema)

    @property
    def native(self) -> bool:
        """Whether the rows are typed and their keys atomic: keys are then compared as columns."""
        atomic = lambda k: k in self.df.columns and not isinstance(self.df.schema[k].dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
        return self.doc is None and all(map(atomic, self.keys))

    def count(self) -> int:
        return self.df.count()

    def keys_only(self) -> DataFrame:
        """The key columns; of documents _ksort, _ktype, _kvalue and _kbracket."""
        return self.df.select(*self.keys) if self.doc is None else self.documents().select(*KEY)

    def lookup(self, keys: DataFrame | Side) -> Side:
        """The rows whose keys are asked for: a frame of the key columns, or a side. Documents are looked up by equal keys of any type."""
        if isinstance(keys, Side) and (self.doc is not None or keys.doc is not None or mixed_keys(self, keys)):
            return self._documents_of(self.documents().join(keys.documents().select("_ksort").distinct(), "_ksort", "left_semi"))
        if self.doc is not None:  # key columns: as documents of their own
            return self.lookup(Side(keys, self.keys))
        keys = keys.keys_only() if isinstance(keys, Side) else keys
        return replace(self, df=self.df.join(keys.select(*self.keys).distinct(), list(self.keys), "left_semi"))

    def _documents_of(self, docs: DataFrame) -> Side:
        return Side(docs.select("_doc"), self.keys, "_doc", self.name)

    def sample(self, n: int, seed: str) -> Side:
        """n rows (all, if there are fewer), without repetition; the same ones in every run."""
        if self.doc is not None:
            return self._documents_of(self.documents().orderBy(sample_order(F.col("_kvalue"), seed), "_ksort").limit(n))
        text = F.concat_ws("|", *[F.col(k).cast("string") for k in self.keys])
        return replace(self, df=self.df.orderBy(sample_order(text, seed), text).limit(n))

    def native_documents(self) -> DataFrame:
        """The key columns k0, k1, ..., _ktype, _kvalue and _doc of each row, made by Spark's own functions."""
        names = [f"k{i}" for i in range(len(self.keys))]
        rows = self.df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(self.keys, names, strict=True)], document_column(self.df.schema).alias("_doc"))
        return rows.select(*names, *key_text(self, names), "_doc")

    def documents(self) -> DataFrame:
        """_ksort, _ktype, _kvalue, _kbracket and _doc (canonical Extended JSON) of each row."""
        keys, doc, name = self.keys, self.doc, self.name
        rows = self.df.select(F.col(doc).cast("string").alias("_doc")) if doc else self.df
        schema = None if doc else rows.schema

        def run(batches):
            for b in batches:
                if doc:
                    docs = b.column(0).to_pylist()
                    raws = [parsed(x, name) if x is not None else ("DOCUMENT", []) for x in docs]
                else:
                    raws = [("DOCUMENT", [(f.name, typed(v, f.dataType)) for f, v in zip(schema.fields, row, strict=True)]) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                    docs = [canon.to_json(r, True) for r in raws]
                out = []
                for r, d in zip(raws, docs, strict=True):
                    k = key_of(r, keys)
                    out.append((canon.key_sort(k) if k and k[0] != "ARRAY" else None, k[0] if k else None, canon.to_json(k) if k else None, canon.bracket(k) if k else None, d))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.string()) for c in cols[1:])], names=[*KEY, "_doc"])

        return rows.mapInArrow(run, _DOC)


def parsed(text: str, side: str) -> tuple:
    """A raw document of a side's text; the error says which side and which text."""
    try:
        return canon.parse_document(text)
    except (ValueError, TypeError, AttributeError, KeyError) as e:
        raise ComparisonError(f"{side}: a document can't be read ({e}): {text[:120]}") from e


def mixed_keys(a: Side, b: Side) -> bool:
    """Whether key columns of one name have types that Spark would compare by widening, or not at all: such sides are compared as documents."""
    if not (a.native and b.native) or len(a.keys) != len(b.keys):
        return False
    integral = lambda t: "integral" if isinstance(t, T.IntegralType) else t
    return any(integral(a.df.schema[x].dataType) != integral(b.df.schema[y].dataType) for x, y in zip(a.keys, b.keys, strict=True))


def key_of(doc: tuple, keys: tuple[str, ...]) -> tuple | None:
    """The key of a raw document; a document of the key's fields if there are several. None if a field is missing."""
    have = dict(doc[1])
    if any(k not in have for k in keys):
        return None
    return have[keys[0]] if len(keys) == 1 else ("DOCUMENT", [(k, have[k]) for k in keys])


def typed(x, t: T.DataType) -> tuple:
    """A raw value of the type that the column has."""
    if x is None:
        return "NULL", None
    if isinstance(t, T.StructType):
        return "DOCUMENT", [(f.name, typed(x[f.name], f.dataType)) for f in t.fields]
    if isinstance(t, T.ArrayType):
        return "ARRAY", [typed(v, t.elementType) for v in x]
    if isinstance(t, T.MapType):
        return "DOCUMENT", [(str(k), typed(v, t.valueType)) for k, v in (x.items() if isinstance(x, dict) else x)]
    return (type_name(t), x) if isinstance(t, T.IntegralType) else canon.raw(x)


def key_text(side: Side, keys: list[str]) -> list[Column]:
    """_ktype and _kvalue of atomic keys, from the columns `keys`."""
    if len(keys) > 1:
        return [F.lit("DOCUMENT").alias("_ktype"), F.to_json(F.struct(*[F.col(k).alias(n) for k, n in zip(keys, side.keys, strict=True)])).alias("_kvalue")]
    name, text = type_name(side.df.schema[side.keys[0]].dataType), F.col(keys[0]).cast("string")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return [F.lit(name).alias("_ktype"), (quoted if name == "STRING" else text).alias("_kvalue")]


def quoted(name: str) -> str:
    """A column's or field's name in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def field_text(c: str, name: str) -> str:
    """SQL text of a struct's field. A subscript can't be taken for a table's column; names that a literal would have to escape are rare."""
    return f"{c}.{quoted(name)}" if "'" in name or "\\" in name else f"{c}['{name}']"


def document_column(schema: T.StructType) -> Column:
    """A row as canonical Extended JSON: numbers with their types, times to the microsecond, nulls as they are. One expression of SQL text."""

    def tagged(c: str, t: T.DataType, depth: int) -> str:
        one = lambda name, x: f"if({c} IS NOT NULL, struct({x} AS {quoted(name)}), NULL)"
        k, x = f"k{depth}", f"x{depth}"
        if isinstance(t, T.StructType):
            return f"if({c} IS NOT NULL, struct({fields(t, lambda n: field_text(c, n), depth)}), NULL)" if t.fields else c
        if isinstance(t, T.ArrayType):
            return f"transform({c}, {x} -> {tagged(x, t.elementType, depth + 1)})"
        if isinstance(t, T.MapType):
            return f"transform_values(transform_keys({c}, ({k}, {x}) -> CAST({k} AS STRING)), ({k}, {x}) -> {tagged(x, t.valueType, depth + 1)})"
        if isinstance(t, T.LongType):
            return one("$numberLong", f"CAST({c} AS STRING)")
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return one("$numberDouble", f"CAST(CAST({c} AS DOUBLE) AS STRING)")
        if isinstance(t, T.DecimalType):
            return one("$numberDecimal", f"CAST({c} AS STRING)")
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            wall = f"to_utc_timestamp({c}, current_timezone())" if isinstance(t, T.TimestampType) else f"CAST({c} AS TIMESTAMP)"
            return one("$date", f"date_format({wall}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")")
        if isinstance(t, T.BinaryType):
            return one("$binary", f"struct(base64({c}) AS base64, '00' AS subType)")
        return c if isinstance(t, (T.IntegralType, T.BooleanType, T.StringType, T.NullType)) else f"CAST({c} AS STRING)"

    def fields(t: T.StructType, at, depth: int) -> str:
        return ", ".join(f"{tagged(at(f.name), f.dataType, depth)} AS {quoted(f.name)}" for f in t.fields)

    return F.expr(f"to_json(struct({fields(schema, quoted, 0)}), map('ignoreNullFields', 'false'))")


# ---- checks ----


def duplicate_keys(df: DataFrame, by: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def key_facts(sides: dict[str, DataFrame], by: list[str]) -> dict[str, tuple[int, int, int, set]]:
    """For each side: rows, most rows of one key, rows without a key, and the keys' type brackets. One job, one shuffle of the keys alone."""
    missing = " OR ".join(f"`{k}` IS NULL" for k in by)
    bracket = "_kbracket" if by == ["_ksort"] else None
    parts = []
    for name, df in sides.items():
        g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.collect_set(bracket).alias("kinds") if bracket else F.array().cast("array<string>").alias("kinds"))
        parts.append(g.agg(F.lit(name).alias("side"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max_by("n", F.when(F.expr(missing), -1).otherwise(F.col("n"))), F.lit(0)).alias("most"),
                           F.coalesce(F.sum(F.when(F.expr(missing), F.col("n"))), F.lit(0)).alias("missing"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return {r.side: (r.rows, r.most, r.missing, set(r.kinds)) for r in rows.collect()}


def _usable(facts: dict[str, tuple[int, int, int, set]]) -> None:
    for name, (_, most, missing, kinds) in facts.items():
        if "ARRAY" in kinds:
            raise ComparisonError(f"{name}: an array can't be a key")
        if missing:
            raise ComparisonError(f"{name}: {missing} documents have no key")
        if most > 1:
            raise ComparisonError(f"{name}: a key occurs {most} times; the key must be unique")


def check_typed(side: Side, other: Side) -> tuple[int, int]:
    """Keys exist, are atomic, never null, unique, and of one family of types on both sides. Returns both sides' numbers of rows."""
    for s in (side, other):
        for k in s.keys:
            if k not in s.df.columns:
                raise ComparisonError(f"{s.name}: there is no key field {k!r}")
            if isinstance(s.df.schema[k].dataType, (T.ArrayType, T.MapType, T.StructType)):
                raise ComparisonError(f"{s.name}: key field {k!r} is of type {s.df.schema[k].dataType.simpleString()}")
    for k in side.keys:
        a, b = (canon.bracket((type_name(s.df.schema[k].dataType), None)) for s in (side, other))
        if a != b:
            raise ComparisonError(f"key field {k!r} is {a} in the baseline and {b} in the candidate")
    facts = key_facts({"baseline": side.keys_only(), "candidate": other.keys_only()}, list(side.keys))
    _usable(facts)
    return facts["baseline"][0], facts["candidate"][0]


def check_documents(docs: dict[str, DataFrame], settings: Settings) -> tuple[list[str], int, int]:
    """The same for documents (frames of Side.documents()): warnings and both numbers. Keys of several type brackets are an error unless settings let them be compared."""
    facts = key_facts(docs, ["_ksort"])
    _usable(facts)
    kinds = set().union(*(f[3] for f in facts.values()))
    warnings = []
    if len(kinds) > 1:
        if settings.mixedKeyTypes == MixedKeyPolicy.REJECT:
            raise ComparisonError("keys have several types: " + ", ".join(sorted(kinds)))
        warnings.append("Keys have several types, compared across types: " + ", ".join(sorted(kinds)))
    return warnings, facts["baseline"][0], facts["candidate"][0]


def key_range(side: Side) -> DataFrame:
    """One row: the least and the greatest key (lo, hi) in the order of keys, null of an empty side. Of several key columns, structs; of documents, the keys' text."""
    if side.doc is not None or not side.native:
        return side.documents().agg(F.min_by("_kvalue", "_ksort").alias("lo"), F.max_by("_kvalue", "_ksort").alias("hi"))
    key = F.col(f"`{side.keys[0]}`") if len(side.keys) == 1 else F.struct(*[f"`{k}`" for k in side.keys])
    return side.df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))


@dataclass(frozen=True)
class Preflight:
    """What is known before a comparison: both sides' numbers of rows, least and greatest keys, and warnings."""

    baselineCount: int
    candidateCount: int
    baselineRange: tuple
    candidateRange: tuple
    warnings: tuple[str, ...] = ()


def preflight(base: Side, cand: Side, settings: Settings) -> Preflight:
    """All checks of a comparison without the comparison; a ComparisonError if the sides can't be compared. Sides whose ranges of keys do not meet give a warning."""
    mixed = mixed_keys(base, cand)
    if base.native and cand.native and not mixed:
        warnings, (nb, nc) = [], check_typed(base, cand)
    else:
        warnings, nb, nc = check_documents({"baseline": base.documents(), "candidate": cand.documents()}, settings)
    ranges = [tuple(key_range(s).first()) for s in (base, cand)]
    if base.native and cand.native and not mixed and nb and nc and (ranges[0][1] < ranges[1][0] or ranges[1][1] < ranges[0][0]):
        warnings.append(f"No key can match: the baseline's are {ranges[0][0]} to {ranges[0][1]}, the candidate's {ranges[1][0]} to {ranges[1][1]}")
    return Preflight(nb, nc, *ranges, tuple(warnings))


# ---- readers ----


def read_side(spark: SparkSession, path: str, keys=("_id",), fmt: str = "parquet", doc: str | None = None, name: str = "baseline", **options) -> Side:
    """A side from files. fmt: parquet, orc, csv, json (typed by Spark), table, or jsonl: one (Extended) JSON document a line, kept as it stands."""
    if fmt == "table":
        return Side(spark.read.table(path), tuple(keys), doc, name)
    if fmt == "jsonl":
        return Side(spark.read.text(path).filter("trim(value) <> ''").withColumnRenamed("value", "doc"), tuple(keys), "doc", name)
    return Side(spark.read.format(fmt).options(**options).load(path), tuple(keys), doc, name)
