"""Test data: product documents, and changes of a copy. Everything derives from hashes of the key, so it is the same in every run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import hit

# Kinds of changes; those of whole documents have no path.
FIELD_KINDS = ("modify", "drop-field", "add-field", "set-null", "int-to-double", "to-string")
DOC_KINDS = ("shuffle-arrays", "delete-docs", "add-docs")


@dataclass(frozen=True)
class ChangeSpec:
    """<kind>[:<path>]:<fraction>"""

    kind: str
    path: str | None
    fraction: float

    @staticmethod
    def parse(text: str) -> ChangeSpec:
        parts = text.strip().split(":")
        kind = parts[0]
        if kind not in FIELD_KINDS + DOC_KINDS or len(parts) != (3 if kind in FIELD_KINDS else 2):
            raise ValueError(f"no such change: {text!r}")
        try:
            f = float(parts[-1])
        except ValueError:
            raise ValueError(f"{text!r}: {parts[-1]!r} is no fraction") from None
        if not 0 <= f <= 1:
            raise ValueError(f"{text!r}: the fraction must be within 0 and 1")
        return ChangeSpec(kind, parts[1] if kind in FIELD_KINDS else None, f)

    def __str__(self) -> str:
        return ":".join(str(x) for x in (self.kind, self.path, f"{self.fraction:g}") if x is not None)


def modified(c: Column, t: T.DataType) -> Column:
    """Another value of the same type; a text for null."""
    if isinstance(t, T.NumericType):
        return (c + F.lit(1)).cast(t)
    if isinstance(t, T.BooleanType):
        return ~c
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return (c + F.expr("INTERVAL 1 DAY")).cast(t)
    if isinstance(t, T.DateType):
        return F.date_add(c, 1)
    if isinstance(t, T.ArrayType):
        return F.array_append(c, F.lit("extra").cast(t.elementType)) if isinstance(t.elementType, T.StringType) else F.concat(c, F.slice(c, 1, 1))
    if isinstance(t, T.MapType) and isinstance(t.valueType, T.StringType):
        return F.map_concat(F.map_filter(c, lambda k, _: k != "changed"), F.create_map(F.lit("changed"), F.lit("true")))
    if isinstance(t, T.StringType):
        return F.coalesce(F.concat(c, F.lit(" (changed)")), F.lit("was null"))
    return c


def _set(df: DataFrame, path: str, change) -> DataFrame:
    """df with change(column, type) in place of a field; a path that isn't there changes nothing."""
    top, *rest = path.split(".")
    if top not in df.columns:
        return df
    t, c = df.schema[top].dataType, F.col(top)

    def inside(col, kind, steps):
        if not steps:
            return change(col, kind)
        if not isinstance(kind, T.StructType) or steps[0] not in kind.fieldNames():
            return col
        return F.when(col.isNotNull(), F.struct(*[(inside(col.getField(f.name), f.dataType, steps[1:]) if f.name == steps[0] else col.getField(f.name)).alias(f.name) for f in kind.fields]))

    return df.withColumn(top, inside(c, t, rest))


def mutate(df: DataFrame, key: str, specs: list[ChangeSpec | str], seed: str = "42") -> DataFrame:
    """A changed copy of df. Columns have one type for all rows: int-to-double and to-string change the whole column's type (the values
    stay), drop-field with fraction 1 drops the column, below it sets null."""
    for n, s in enumerate(specs):
        s = ChangeSpec.parse(s) if isinstance(s, str) else s
        on = hit(F.col(key), f"{seed}|{n}|{s}", s.fraction)
        if s.kind == "modify":
            df = _set(df, s.path, lambda c, t, on=on: F.when(on, modified(c, t)).otherwise(c))
        elif s.kind == "set-null" or (s.kind == "drop-field" and (s.fraction < 1 or "." in s.path)):
            df = _set(df, s.path, lambda c, t, on=on: F.when(~on, c))
        elif s.kind == "drop-field":
            df = df.drop(s.path)
        elif s.kind == "add-field":
            df = df.withColumn(s.path, F.when(on, F.concat(F.lit("added-"), F.pmod(F.xxhash64(key), F.lit(1000)).cast("string"))))
        elif s.kind == "int-to-double":
            df = _set(df, s.path, lambda c, t: c.cast("double") if isinstance(t, T.IntegralType) else c)
        elif s.kind == "to-string":
            df = _set(df, s.path, lambda c, t: c.cast("string"))
        elif s.kind == "shuffle-arrays":
            for f in df.schema.fields:
                if isinstance(f.dataType, T.ArrayType):
                    df = df.withColumn(f.name, F.when(on, F.reverse(f.name)).otherwise(F.col(f.name)))
        elif s.kind == "delete-docs":
            df = df.filter(~on)
        elif isinstance(df.schema[key].dataType, T.NumericType):
            top = df.agg(F.max(key)).first()[0] or 0
            df = df.unionByName(df.filter(on).withColumn(key, (F.col(key) + F.lit(top)).cast(df.schema[key].dataType)))
        else:
            df = df.unionByName(df.filter(on).withColumn(key, F.concat(F.col(key), F.lit("-added"))))
    return df


def product_documents(spark: SparkSession, n: int = 10_000, seed: int = 42) -> DataFrame:
    """n product documents: scalars of many types, a struct, arrays of strings and of structs, a map with dynamic keys."""
    h = lambda name, top: F.pmod(F.xxhash64("i", F.lit(f"{seed}|{name}")), F.lit(top))
    pick = lambda name, xs: F.element_at(F.array(*map(F.lit, xs)), (h(name, len(xs)) + 1).cast("int"))
    words = ["red", "blue", "new", "sale", "eco", "xl"]
    day = F.lit("2024-01-01").cast("timestamp")
    later = lambda name: (day + F.make_interval(days=h(name, 700).cast("int"), secs=h(name + "s", 86400).cast("decimal(18,6)")))
    some = lambda name, xs: F.filter(F.array(*[F.when(h(f"{name}{x}", 2) == 0, F.lit(x)) for x in xs]), lambda x: x.isNotNull())
    return spark.range(n).withColumnRenamed("id", "i").select(
        F.lpad(F.lower(F.hex("i")), 24, "0").alias("_id"), F.format_string("SKU-%07d", "i").alias("sku"), F.concat(F.lit("Product "), F.col("i").cast("string")).alias("name"),
        (h("price", 100_000) / F.lit(100)).cast("decimal(12,2)").alias("price"), h("qty", 500).cast("int").alias("qty"), (h("active", 10) < 9).alias("active"), later("created").alias("createdAt"),
        F.struct(h("cat", 20).cast("int").alias("id"), F.concat(F.lit("Category "), h("cat", 20).cast("string")).alias("name"), F.array(F.lit("all"), F.concat(F.lit("c"), h("cat", 20).cast("string"))).alias("path")).alias("category"),
        some("tags", words).alias("tags"), F.map_from_entries(F.filter(F.array(*[F.when(h("attr" + x, 2) == 0, F.struct(F.lit(x).alias("key"), pick("v" + x, words).alias("value"))) for x in ("colour", "size", "weight", "material", "origin", "brand")]), lambda x: x.isNotNull())).alias("attributes"),
        F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda k: k <= h("variants", 4)), lambda k: F.struct(F.concat(F.lit("V"), k.cast("string")).alias("sku"), (k * 1.5).cast("double").alias("price"), k.cast("bigint").alias("stock"), F.struct((k * 10).alias("w"), (k * 20).alias("h")).alias("dims"))).alias("variants"),
        F.transform(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda k: k <= h("history", 5) + 1), lambda k: F.struct(F.concat(F.lit("event-"), k.cast("string")).alias("event"), (day + F.make_interval(days=k)).alias("at"))).alias("history"),
        F.concat(F.lit("L"), F.lower(F.hex(h("legacy", 1 << 20)))).alias("legacyCode"), F.when(h("note", 4) > 0, pick("note", words)).alias("note"),
        F.struct(day.alias("syncedAt"), F.lit("generator").alias("source"), F.lit(1).alias("version")).alias("meta"))
