"""Aggregates of pairs and profiles: category counts, path changes, examples, structure differences, map statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..paths import PathMatcher


def category_counts(pairs: DataFrame, expected: PathMatcher) -> DataFrame:
    """One row: unchanged, changed, changed_expected_only, added, removed, matched."""
    only = F.lit(False)
    if expected:
        only = (F.col("status") == "changed") & (F.size("paths") > 0) & F.forall("paths", lambda p: p.rlike(expected.regex()))
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return pairs.agg(n("unchanged"), n("changed"), F.count_if(only).alias("changed_expected_only"), n("added"), n("removed"), F.count_if(F.col("status").isin("unchanged", "changed")).alias("matched"))


def path_counts(pairs: DataFrame) -> DataFrame:
    """(path, docs): changed documents for each path."""
    return pairs.filter("status = 'changed'").select(F.explode("paths").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("docs"))


def example_keys(pairs: DataFrame, n: int) -> DataFrame:
    """(status, _ktype, _kvalue, rank): the n first keys of each category in key order; each task sends n rows of a category at most."""
    w = Window.partitionBy("status").orderBy("_key")
    return pairs.filter("status <> 'unchanged'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("status", "_ktype", "_kvalue", "rank")


def path_examples(pairs: DataFrame, n_keys: int, n_values: int) -> DataFrame:
    """(path, _ktype, _kvalue, rank, value, value_rank): for each path its first keys, and its first keys with a value difference."""
    rows = pairs.filter("status = 'changed'").select("_key", "_ktype", "_kvalue", F.explode("paths").alias("path"), "values").withColumn("value", F.try_element_at("values", F.col("path"))).drop("values")
    by = Window.partitionBy("path").orderBy("_key")
    first = rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n_keys).select("path", "_ktype", "_kvalue", "rank", F.lit(None).cast(rows.schema["value"].dataType).alias("value"), F.lit(None).cast("int").alias("value_rank"))
    valued = rows.filter("value IS NOT NULL").withColumn("value_rank", F.row_number().over(by)).filter(F.col("value_rank") <= n_values)
    return first.unionByName(valued.select("path", "_ktype", "_kvalue", F.lit(None).cast("int").alias("rank"), "value", "value_rank"))


# ---- structure ----


def joined_profiles(base: DataFrame, cand: DataFrame) -> DataFrame:
    """(path, type, base_docs, cand_docs) of two profiles (path, type, docs); 0 where a side hasn't it. type is null for a path as such."""
    b, c = (p.select("path", "type", F.col("docs").alias(f"{n}_docs")) for p, n in ((base, "base"), (cand, "cand")))
    on = b["path"].eqNullSafe(c["path"]) & b["type"].eqNullSafe(c["type"])
    j = b.join(c, on, "full_outer")
    return j.select(F.coalesce(b["path"], c["path"]).alias("path"), F.coalesce(b["type"], c["type"]).alias("type"), F.coalesce("base_docs", F.lit(0)).alias("base_docs"), F.coalesce("cand_docs", F.lit(0)).alias("cand_docs"))


def presence(profiles: DataFrame, base_total: int, cand_total: int) -> DataFrame:
    """(path, base_docs, cand_docs, base_presence, cand_presence, delta) of each path."""
    share = lambda c, n: (F.col(c) / F.lit(n) if n else F.lit(0.0))
    return profiles.filter("type IS NULL").select("path", "base_docs", "cand_docs", share("base_docs", base_total).alias("base_presence"), share("cand_docs", cand_total).alias("cand_presence")).withColumn("delta", F.col("cand_presence") - F.col("base_presence"))


def new_paths(p: DataFrame) -> DataFrame:
    return p.filter("base_docs = 0")


def missing_paths(p: DataFrame) -> DataFrame:
    return p.filter("cand_docs = 0")


def presence_deltas(p: DataFrame, least: float) -> DataFrame:
    return p.filter((F.col("base_docs") > 0) & (F.col("cand_docs") > 0) & (F.abs("delta") > least))


def type_shares(profiles: DataFrame) -> DataFrame:
    """(path, type, base_docs, cand_docs, base_share, cand_share): of the documents with the path, those in which it has the type."""
    whole = profiles.filter("type IS NULL").select("path", F.col("base_docs").alias("b"), F.col("cand_docs").alias("c"))
    return profiles.filter("type IS NOT NULL").join(whole, "path").select("path", "type", "base_docs", "cand_docs", F.coalesce(F.try_divide("base_docs", "b"), F.lit(0.0)).alias("base_share"), F.coalesce(F.try_divide("cand_docs", "c"), F.lit(0.0)).alias("cand_share"), "b", "c")


def type_shifts(profiles: DataFrame, least: float) -> DataFrame:
    """(path, shares) of the paths on both sides where a type comes, goes, or moves its share by more than `least`."""
    s = type_shares(profiles).filter("b > 0 AND c > 0")
    g = s.groupBy("path").agg(F.bool_or((F.col("base_docs") == 0) != (F.col("cand_docs") == 0)).alias("set_moved"), F.max(F.abs(F.col("cand_share") - F.col("base_share"))).alias("moved"),
                              F.collect_list(F.struct("type", "base_docs", "base_share", "cand_docs", "cand_share")).alias("shares"))
    return g.filter(F.col("set_moved") | (F.col("moved") > least)).select("path", "moved", "shares")
