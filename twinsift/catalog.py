"""Registered queries of the comparison engine over the given tables, and DuckDB SQL for those that SQL can express.

The candidate of most queries is `orders` with changes that hit fixed shares of the keys (see functions.expressions.hit).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import canon
from .functions.expressions import hit, wilson
from .model import AtLeast, Below, Mode, Settings
from .operators import history, maps, pairs, rates, summary
from .operators.generate import mutate
from .paths import PathMatcher
from .plans.compare import compare, resolve_mode
from .sources.side import Side, duplicate_keys, key_range

SPECS = ["modify:o_totalprice:0.06", "set-null:o_orderpriority:0.08", "modify:o_orderstatus:0.01", "int-to-double:o_custkey:1", "delete-docs:0.01", "add-docs:0.02"]
KEY = ("o_orderkey",)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders")


def changed_orders(spark, sf) -> DataFrame:
    return mutate(orders(spark, sf), "o_orderkey", SPECS)


def sides(spark, sf) -> tuple[Side, Side]:
    return Side(orders(spark, sf), KEY), Side(changed_orders(spark, sf), KEY, name="candidate")


SETTINGS = Settings(keyFields=KEY)
#: For SQL that counts every row: AUTO estimates from a sample beyond fullScanLimit rows.
FULL = replace(SETTINGS, mode=Mode("FULL"))


def order_pairs(spark, sf, s: Settings = SETTINGS, how: str = "full_outer") -> DataFrame:
    return pairs.typed_pairs(*sides(spark, sf), s, how)


def one_row(spark, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def _hit(key: str, spec: str, f: float) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || '#{spec}'), 1, 8))::UBIGINT < {int(f * 4294967296)})"


def _spec(n: int, key: str = "o_orderkey") -> str:
    return _hit(key, f"42|{n}|{SPECS[n]}", float(SPECS[n].rsplit(":", 1)[1]))


#: b and c: the two sides; j: their rows on equal keys with status and changed columns.
CTE = f"""
    WITH b AS (SELECT * FROM orders),
    kept AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, CASE WHEN {_spec(2)} THEN o_orderstatus || ' (changed)' ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN {_spec(0)} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, CASE WHEN NOT {_spec(1)} THEN o_orderpriority END AS o_orderpriority
        FROM orders WHERE NOT {_spec(4)}),
    c AS (SELECT * FROM kept UNION ALL SELECT o_orderkey + (SELECT max(o_orderkey) FROM kept), o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM kept WHERE {_spec(5)}),
    j AS (SELECT coalesce(b.o_orderkey, c.o_orderkey) AS k, b.o_orderkey IS NULL AS is_added, c.o_orderkey IS NULL AS is_removed,
        b.o_totalprice IS DISTINCT FROM c.o_totalprice AS p1, b.o_orderpriority IS DISTINCT FROM c.o_orderpriority AS p2, b.o_orderstatus IS DISTINCT FROM c.o_orderstatus AS p3,
        b.o_totalprice AS b1, c.o_totalprice AS c1, b.o_orderpriority AS b2, c.o_orderpriority AS c2, b.o_orderstatus AS b3, c.o_orderstatus AS c3
        FROM b FULL OUTER JOIN c ON b.o_orderkey = c.o_orderkey),
    s AS (SELECT *, CASE WHEN is_added THEN 'added' WHEN is_removed THEN 'removed' WHEN p1 OR p2 OR p3 THEN 'changed' ELSE 'unchanged' END AS status FROM j),
    u AS (SELECT k, 'o_totalprice' AS path FROM s WHERE status = 'changed' AND p1 UNION ALL SELECT k, 'o_orderpriority' FROM s WHERE status = 'changed' AND p2 UNION ALL SELECT k, 'o_orderstatus' FROM s WHERE status = 'changed' AND p3),
    n AS (SELECT count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
        count(*) FILTER (status IN ('changed', 'unchanged')) AS matched FROM s)
"""
_PATHS = "SELECT path, count(*) AS docs FROM u GROUP BY path"


@query(CTE + "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM c")
def generate_mutations(spark, sf):
    return changed_orders(spark, sf).drop("o_orderdate")


@query(CTE + "SELECT status, count(*) AS n FROM s GROUP BY status")
def key_classification(spark, sf):
    return order_pairs(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(CTE + "SELECT matched, added, removed, matched / (matched + added + removed) AS similarity, added / (matched + added) AS added_rate, removed / (matched + removed) AS removed_rate FROM n")
def key_metrics(spark, sf):
    n = order_pairs(spark, sf).agg(*[F.count_if(F.col("status").isin(*x)).alias(k) for k, x in (("matched", ["changed", "unchanged"]), ("added", ["added"]), ("removed", ["removed"]))])
    m, a, r = F.col("matched"), F.col("added"), F.col("removed")
    return n.select("*", F.try_divide(m, m + a + r).alias("similarity"), F.try_divide(a, m + a).alias("added_rate"), F.try_divide(r, m + r).alias("removed_rate"))


@query(CTE + "SELECT b.o_orderkey, c.o_orderkey IS NOT NULL AS found FROM b LEFT JOIN c USING (o_orderkey)")
def lookup_join(spark, sf):
    b, c = sides(spark, sf)
    return b.keys_only().join(c.keys_only().withColumn("found", F.lit(True)), "o_orderkey", "left").select("o_orderkey", F.coalesce("found", F.lit(False)).alias("found"))


@query(CTE + "SELECT o_orderkey FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def added_keys(spark, sf):
    b, c = sides(spark, sf)
    return c.keys_only().join(b.keys_only(), "o_orderkey", "left_anti")


@query(CTE + "SELECT o_orderkey FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c)")
def removed_keys(spark, sf):
    b, c = sides(spark, sf)
    return b.keys_only().join(c.keys_only(), "o_orderkey", "left_anti")


@query(CTE + "SELECT o_orderkey FROM c WHERE o_orderkey IN (SELECT o_orderkey FROM b)")
def existing_keys(spark, sf):
    b, c = sides(spark, sf)
    return c.lookup(b.keys_only()).keys_only()


@query("WITH b AS (SELECT * FROM orders) SELECT o_orderkey, o_totalprice FROM b WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0)")
def lookup_by_keys(spark, sf):
    b, _ = sides(spark, sf)
    return b.lookup(b.keys_only().filter("o_orderkey % 97 = 0")).df.select("o_orderkey", "o_totalprice")


_TURN = "(CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR))"


@query(f"SELECT CASE WHEN {_hit(_TURN, 'turn', 0.1)} THEN 'changed' WHEN {_hit(_TURN, 'gone', 0.05)} THEN 'removed' ELSE 'unchanged' END AS status, count(*) AS n FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations) GROUP BY 1")
def composite_key_compare(spark, sf):
    b = table(spark, sf, "conversations").dropDuplicates(["conv_id", "turn"])
    k = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    edit = hit(k, "turn", 0.1)
    c = b.filter(edit | ~hit(k, "gone", 0.05)).withColumn("text", F.when(edit, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    keys = ("conv_id", "turn")
    return pairs.typed_pairs(Side(b, keys), Side(c, keys), replace(SETTINGS, keyFields=keys)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys_lineitem(spark, sf):
    return duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def key_bounds(spark, sf):
    return key_range(sides(spark, sf)[0])


@query("SELECT CAST(min(o_orderkey) AS VARCHAR) AS lo, CAST(max(o_orderkey) AS VARCHAR) AS hi FROM orders")
def json_key_bounds(spark, sf):
    return key_range(Side(_json_orders(orders(spark, sf)), doc="doc"))


def _json_orders(df: DataFrame, key: str = "o_orderkey") -> DataFrame:
    return df.select(F.to_json(F.struct(F.col(key).alias("_id"), F.col("o_orderstatus").alias("s"))).alias("doc"))


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'STRING' ELSE 'NUMBER' END AS bracket, count(*) AS n FROM orders GROUP BY 1")
def key_type_brackets(spark, sf):
    o = orders(spark, sf)
    docs = _json_orders(o.filter("o_orderkey % 5 <> 0")).unionByName(_json_orders(o.filter("o_orderkey % 5 = 0").withColumn("k", F.col("o_orderkey").cast("string")), "k"))
    return Side(docs, doc="doc").documents().groupBy(F.col("_kbracket").alias("bracket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'unchanged' ELSE 'removed' END AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'added', count(*) FROM orders WHERE o_orderkey % 3 = 1 HAVING count(*) > 0")
def cross_type_key_join(spark, sf):
    o = orders(spark, sf)
    num = o.filter("o_orderkey % 3 = 0").withColumn("k", F.col("o_orderkey").cast("double"))
    text = o.filter("o_orderkey % 3 = 1").withColumn("k", F.col("o_orderkey").cast("string"))
    b, c = Side(_json_orders(o), doc="doc"), Side(_json_orders(num, "k").unionByName(_json_orders(text, "k")), doc="doc")
    return pairs.document_pairs(b.documents(), c.documents(), Settings()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN o_orderkey % 4 = 3 THEN 'changed' ELSE 'unchanged' END AS status, o_orderkey % 4 AS kind, count(*) AS n FROM orders GROUP BY ALL""")
def numeric_equality(spark, sf):
    """Equal numbers of other types (float and double, long and double, decimals of other scales, decimal and double), and in each fourth row one that differs in its last digit."""
    o, off = orders(spark, sf).select("o_orderkey"), F.when(F.col("o_orderkey") % 4 == 3, 1).otherwise(0)
    key = F.col("o_orderkey")
    b = o.select(key, (key / 8).cast("float").alias("f"), (key * 1000003 + 4503599627370496).alias("l"), (F.lit("10000000000000000000000000.").cast("decimal(38,0)") + key).cast("decimal(38,0)").alias("w"), (key / 10).cast("decimal(20,5)").alias("d"), F.lit("1e-20").cast("double").alias("s"))
    c = o.select(key, (key / 8).cast("double").alias("f"), (key * 1000003 + 4503599627370496 + off).cast("double").alias("l"), (F.lit("10000000000000000000000000").cast("decimal(30,0)") + key).cast("decimal(30,0)").alias("w"), (key / 10).alias("d"), F.lit("0.00000000000000000001").cast("decimal(38,20)").alias("s"))
    p = pairs.typed_pairs(Side(b, ("o_orderkey",)), Side(c, ("o_orderkey",)), SETTINGS)
    return p.groupBy("status", (F.col("_kvalue").cast("long") % 4).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'unchanged' ELSE 'removed' END AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'added', count(*) FROM orders WHERE o_orderkey % 2 = 1 HAVING count(*) > 0")
def typed_cross_type_keys(spark, sf):
    """Long keys against double ones, beyond the doubles that hold every integer: odd keys have no equal double."""
    big = (F.lit(9007199254740992) + F.col("o_orderkey")).alias("o_orderkey")
    even = (F.lit(9007199254740992.0) + (F.col("o_orderkey") - F.col("o_orderkey") % 2).cast("double") + F.when(F.col("o_orderkey") % 2 == 1, 1e12).otherwise(0.0)).alias("o_orderkey")
    b, c = (orders(spark, sf).select(k, "o_orderstatus") for k in (big, even))
    return pairs.typed_pairs(Side(b, ("o_orderkey",)), Side(c, ("o_orderkey",)), SETTINGS).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'o_orderstatus' AS path, 'STRING' AS type, count(*) AS docs FROM orders WHERE o_orderkey % 3 = 0")
def json_lookup(spark, sf):
    """Documents looked up by their keys, and their structure."""
    o = orders(spark, sf)
    side = Side(_json_orders(o), doc="doc").lookup(Side(_json_orders(o.filter("o_orderkey % 3 = 0").withColumn("k", F.col("o_orderkey").cast("double")), "k"), doc="doc"))
    found = side.documents().select(F.get_json_object("_doc", "$.s").alias("s"))
    return found.agg(F.lit("o_orderstatus").alias("path"), F.lit("STRING").alias("type"), F.count("s").alias("docs")).select("path", "type", "docs")


@query("SELECT unchanged, changed, expected, round(500.0 * unchanged / n) AS unchanged_estimate, round(500.0 * (unchanged + expected) / n) - round(500.0 * unchanged / n) AS expected_estimate FROM (SELECT count(*) FILTER (o_orderkey % 5 > 1) AS unchanged, count(*) FILTER (o_orderkey % 5 <= 1) AS changed, count(*) FILTER (o_orderkey % 5 = 0) AS expected, count(*) AS n FROM orders)")
def sample_content(spark, sf):
    """Estimated counts of a sample that stands for 500 matched documents."""
    r = orders(spark, sf).agg(*[F.count(F.when(F.expr(e), 1)).alias(n) for n, e in (("unchanged", "o_orderkey % 5 > 1"), ("changed", "o_orderkey % 5 <= 1"), ("expected", "o_orderkey % 5 = 0"))]).first()
    m = rates.sample_content(r.unchanged, r.changed, r.expected, 500.0)
    return one_row(spark, unchanged=r.unchanged, changed=r.changed, expected=r.expected, unchanged_estimate=float(m.unchanged), expected_estimate=float(m.changedExpectedOnly))


@query(CTE + "SELECT k, status FROM s")
def content_classification(spark, sf):
    return order_pairs(spark, sf).select(F.col("_key.k0").alias("k"), "status")


@query(CTE + "SELECT unchanged, changed, unchanged / matched AS unchanged_rate, changed / matched AS changed_rate FROM n")
def content_metrics(spark, sf):
    n = summary.category_counts(order_pairs(spark, sf), PathMatcher())
    return n.select("unchanged", "changed", F.try_divide("unchanged", "matched").alias("unchanged_rate"), F.try_divide("changed", "matched").alias("changed_rate"))


@query("SELECT n_nationkey, sha256('n_name=' || coalesce('\"' || n_name || '\"', 'null') || chr(10) || 'n_regionkey=' || coalesce(CAST(n_regionkey AS VARCHAR), 'null')) AS content_hash FROM nation")
def content_hash(spark, sf):
    from .functions.expressions import rendered

    df = table(spark, sf, "nation")
    leaves = sorted(x for x in pairs.leaf_columns(df.schema, pairs.rules_of(Settings(keyFields=("n_nationkey",))), ("n_nationkey",)) if x[0] in ("n_name", "n_regionkey"))
    text = F.concat_ws("\n", *[F.concat(F.lit(p + "="), rendered(F.col(s[0]), t)) for p, s, t in leaves])
    return df.select("n_nationkey", F.sha2(text, 256).alias("content_hash"))


def _baskets(spark, sf, edit) -> tuple[Side, Side]:
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    doc = lambda df: Side(df.select(F.to_json(F.struct(F.col("l_orderkey").alias("_id"), "parts")).alias("doc")), doc="doc")
    return doc(items), doc(items.withColumn("parts", edit(F.col("l_orderkey"), F.col("parts"))))


_BASKET = "WITH t AS (SELECT l_orderkey AS k, list_sort(list(l_partkey)) AS x FROM lineitem GROUP BY 1), e AS (SELECT k, x, CASE WHEN k % 2 = 0 THEN list_reverse(x) WHEN k % 7 = 0 THEN list_append(x, 0) ELSE x END AS y FROM t) "


def _edit(k, x):
    return F.when(k % 2 == 0, F.reverse(x)).when(k % 7 == 0, F.array_append(x, F.lit(0).cast("bigint"))).otherwise(x)


@query(_BASKET + "SELECT CASE WHEN list_sort(x) = list_sort(y) THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n FROM e GROUP BY 1")
def array_multiset_equality(spark, sf):
    b, c = _baskets(spark, sf, _edit)
    return pairs.document_pairs(b.documents(), c.documents(), Settings()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(_BASKET + "SELECT CASE WHEN x = y THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n FROM e GROUP BY 1")
def array_order_sensitive(spark, sf):
    b, c = _baskets(spark, sf, _edit)
    return pairs.document_pairs(b.documents(), c.documents(), Settings(orderSensitivePaths=("parts",))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 1 THEN 'changed' ELSE 'unchanged' END AS status FROM orders")
def null_equals_missing(spark, sf):
    o = orders(spark, sf)
    text = lambda x: F.concat(F.lit('{"_id":'), F.col("o_orderkey").cast("string"), x, F.lit("}"))
    b = o.select(text(F.lit(',"a":null')).alias("doc"))
    c = o.select(text(F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, ',"a":1').otherwise(',"a":null')).alias("doc"))
    p = pairs.document_pairs(Side(b, doc="doc").documents(), Side(c, doc="doc").documents(), Settings(nullEqualsMissing=True))
    return p.select(F.col("_kvalue").cast("bigint").alias("k"), "status")


@query(CTE + _PATHS)
def changed_paths(spark, sf):
    return summary.path_counts(order_pairs(spark, sf))


@query(CTE + f"SELECT path, docs, docs / (SELECT matched FROM n) AS rate FROM ({_PATHS}) ORDER BY docs DESC, path LIMIT 2")
def top_changed_paths(spark, sf):
    p = order_pairs(spark, sf)
    matched = p.agg(F.count_if(F.col("status").isin("changed", "unchanged")).alias("matched"))
    return summary.path_counts(p).orderBy(F.desc("docs"), "path").limit(2).crossJoin(F.broadcast(matched)).select("path", "docs", F.try_divide("docs", "matched").alias("rate"))


@query(CTE + f"SELECT path, docs / (SELECT matched FROM n) AS rate FROM ({_PATHS}) WHERE path <> 'o_orderpriority' ORDER BY docs DESC, path LIMIT 1")
def max_path_change_rate(spark, sf):
    p = order_pairs(spark, sf)
    matched = p.agg(F.count_if(F.col("status").isin("changed", "unchanged")).alias("matched"))
    return summary.path_counts(p).filter("path <> 'o_orderpriority'").orderBy(F.desc("docs"), "path").limit(1).crossJoin(F.broadcast(matched)).select("path", F.try_divide("docs", "matched").alias("rate"))


@query(CTE + "SELECT count(*) FILTER (status = 'changed' AND NOT p1 AND NOT p3) AS changed_expected_only, count(*) FILTER (status = 'changed') AS changed FROM s")
def expected_only_changes(spark, sf):
    return summary.category_counts(order_pairs(spark, sf), PathMatcher(["o_orderpriority"])).select("changed_expected_only", "changed")


def _nested(spark, sf, edit) -> tuple[Side, Side]:
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("f"))
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    doc = lambda df: Side(df.select(F.to_json(F.struct(F.col("l_orderkey").alias("_id"), "lines")).alias("doc")), doc="doc")
    return doc(items), doc(items.withColumn("lines", edit(F.col("l_orderkey"), F.col("lines"))))


@query("SELECT 'lines[].q' AS path, count(DISTINCT l_orderkey) AS docs FROM lineitem WHERE l_orderkey % 4 = 0 UNION ALL SELECT 'lines[].f', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 4 = 1")
def nested_array_changed_paths(spark, sf):
    b, c = _nested(spark, sf, lambda k, x: F.reverse(F.transform(x, lambda e: F.struct(e["n"].alias("n"), F.when(k % 4 == 0, e["q"] + 1000).otherwise(e["q"]).alias("q"), F.when(k % 4 == 1, F.lit("Z")).otherwise(e["f"]).alias("f")))))
    return summary.path_counts(pairs.document_pairs(b.documents(), c.documents(), Settings()))


@query("SELECT 'm.*' AS path, count(*) AS docs FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus IS DISTINCT FROM o_orderpriority")
def swapped_values(spark, sf):
    """Two values of a map swap their keys: a change at m.*, though the values are the same."""
    o = orders(spark, sf)
    doc = lambda a, b: Side(o.select(F.to_json(F.struct(F.col("o_orderkey").alias("_id"), F.struct(a.alias("x"), b.alias("y")).alias("m"))).alias("doc")), doc="doc")
    p, q, swap = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey") % 3 == 0
    b, c = doc(p, q), doc(F.when(swap, q).otherwise(p), F.when(swap, p).otherwise(q))
    return summary.path_counts(pairs.document_pairs(b.documents(), c.documents(), Settings(wildcardPaths=("m.*",))))


_EXAMPLE = "coalesce('\"' || {0} || '\"', 'null')"
_TEXT2 = f"SELECT 'o_orderpriority' AS path, k, {_EXAMPLE.format('b2')} AS baseline, {_EXAMPLE.format('c2')} AS candidate FROM s WHERE status = 'changed' AND p2"
_TEXT3 = f"SELECT 'o_orderstatus', k, {_EXAMPLE.format('b3')}, {_EXAMPLE.format('c3')} FROM s WHERE status = 'changed' AND p3"


def _examples(spark, sf, s):
    rows = summary.path_examples(order_pairs(spark, sf, s), 0, 3).filter("value IS NOT NULL AND path <> 'o_totalprice'")
    return rows.select("path", F.col("_kvalue").cast("bigint").alias("k"), F.col("value.baseline")[0].alias("baseline"), F.col("value.candidate")[0].alias("candidate"))


@query(CTE + f"SELECT * FROM ({_TEXT2} UNION ALL {_TEXT3}) QUALIFY row_number() OVER (PARTITION BY path ORDER BY k) <= 3")
def value_examples(spark, sf):
    return _examples(spark, sf, SETTINGS)


@query(CTE + f"SELECT path, k, CASE WHEN path = 'o_orderstatus' THEN '***' ELSE baseline END AS baseline, CASE WHEN path = 'o_orderstatus' THEN '***' ELSE candidate END AS candidate FROM ({_TEXT2} UNION ALL {_TEXT3}) QUALIFY row_number() OVER (PARTITION BY path ORDER BY k) <= 3")
def redacted_examples(spark, sf):
    return _examples(spark, sf, replace(SETTINGS, redactedPaths=("o_orderstatus",)))


@query(CTE + "SELECT status, k, row_number() OVER (PARTITION BY status ORDER BY k) AS rank FROM s WHERE status <> 'unchanged' QUALIFY row_number() OVER (PARTITION BY status ORDER BY k) <= 20")
def example_keys(spark, sf):
    return summary.example_keys(order_pairs(spark, sf), 20).select("status", F.col("_kvalue").cast("bigint").alias("k"), F.col("rank").cast("bigint").alias("rank"))


def _profiles(spark, sf):
    b, c = sides(spark, sf)
    s = replace(SETTINGS, wildcardPaths=())
    base = b.df.drop("o_orderdate")
    cand = c.df.withColumn("extra", F.when(F.col("o_orderkey") % 10 == 0, 1)).withColumnRenamed("o_orderdate", "o_date").drop("o_date")
    return pairs.typed_profile(base.withColumn("legacy", F.lit("x")), replace(s, nullEqualsMissing=True)), pairs.typed_profile(cand, replace(s, nullEqualsMissing=True)), b.count(), c.count()


_TYPES = {"o_orderkey": ("INT64", "INT64"), "o_custkey": ("INT64", "DOUBLE"), "o_orderstatus": ("STRING", "STRING"), "o_totalprice": ("DOUBLE", "DOUBLE"), "o_orderpriority": ("STRING", "STRING")}
_PROFILE = CTE + ", p AS (" + " UNION ALL ".join(
    [f"SELECT '{p}' AS path, '{t[i]}' AS type, {1 - i} * count({p}) AS base_docs, {i} * count({p}) AS cand_docs FROM {'bc'[i]}" for p, t in _TYPES.items() for i in (0, 1)]
    + ["SELECT 'legacy', 'STRING', count(*), 0 FROM b", "SELECT 'extra', 'INT32', 0, count(*) FROM c WHERE o_orderkey % 10 = 0"]
) + "), t AS (SELECT path, type, CAST(sum(base_docs) AS BIGINT) AS base_docs, CAST(sum(cand_docs) AS BIGINT) AS cand_docs FROM p GROUP BY ALL), w AS (SELECT path, CAST(sum(base_docs) AS BIGINT) AS base_docs, CAST(sum(cand_docs) AS BIGINT) AS cand_docs FROM t GROUP BY ALL), z AS (SELECT path, base_docs, cand_docs, base_docs / (SELECT count(*) FROM b) AS base_presence, cand_docs / (SELECT count(*) FROM c) AS cand_presence FROM w)"


def _joined(spark, sf):
    pb, pc, nb, nc = _profiles(spark, sf)
    j = summary.joined_profiles(pb, pc)
    return j, summary.presence(j, nb, nc)


@query(_PROFILE + "SELECT * FROM t WHERE base_docs + cand_docs > 0")
def structure_profile(spark, sf):
    return _joined(spark, sf)[0].filter("type IS NOT NULL")


@query("SELECT path, type, count(*) AS docs FROM (SELECT 'k' AS path, 'INT32' AS type FROM events WHERE json_extract(props, '$.k') IS NOT NULL UNION ALL SELECT 'event_id', 'INT32' FROM events) GROUP BY ALL")
def json_structure_profile(spark, sf):
    docs = table(spark, sf, "events").select(F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(","), F.substring("props", 2, 1 << 30)).alias("doc"))
    return pairs.document_profile(Side(docs, ("event_id",), "doc").documents(), Settings(keyFields=("event_id",))).filter("type IS NOT NULL")


@query(_PROFILE + "SELECT path, cand_docs, cand_presence FROM z WHERE base_docs = 0 AND cand_docs > 0")
def new_paths(spark, sf):
    return summary.new_paths(_joined(spark, sf)[1]).select("path", "cand_docs", "cand_presence")


@query(_PROFILE + "SELECT path, base_docs, base_presence FROM z WHERE cand_docs = 0")
def missing_paths(spark, sf):
    return summary.missing_paths(_joined(spark, sf)[1]).select("path", "base_docs", "base_presence")


@query(_PROFILE + "SELECT path, base_presence, cand_presence, cand_presence - base_presence AS delta FROM z WHERE base_docs > 0 AND cand_docs > 0 AND abs(cand_presence - base_presence) > 0.05")
def presence_deltas(spark, sf):
    return summary.presence_deltas(_joined(spark, sf)[1], 0.05).select("path", "base_presence", "cand_presence", "delta")


@query(_PROFILE + "SELECT t.path, max(abs(t.cand_docs / w.cand_docs - t.base_docs / w.base_docs)) AS moved FROM t JOIN w USING (path) WHERE w.base_docs > 0 AND w.cand_docs > 0 GROUP BY 1 HAVING bool_or((t.base_docs = 0) <> (t.cand_docs = 0)) OR moved > 0.01")
def type_shifts(spark, sf):
    return summary.type_shifts(_joined(spark, sf)[0], 0.01).select("path", "moved")


@query(_PROFILE + "SELECT t.path, t.type, t.base_docs, t.cand_docs, CASE WHEN w.base_docs > 0 THEN t.base_docs / w.base_docs ELSE 0 END AS base_share, CASE WHEN w.cand_docs > 0 THEN t.cand_docs / w.cand_docs ELSE 0 END AS cand_share FROM t JOIN w USING (path) WHERE t.base_docs + t.cand_docs > 0")
def type_shares(spark, sf):
    return summary.type_shares(_joined(spark, sf)[0]).drop("b", "c")


@query("WITH d AS (SELECT 'n' || (o_custkey % 60) AS name FROM orders ORDER BY o_orderkey LIMIT 500) SELECT 'attributes.*' AS pattern, count(DISTINCT name) AS distinct_keys, 1.0::DOUBLE AS average_keys, count(*) AS documents FROM d HAVING count(DISTINCT name) >= 20")
def map_detection(spark, sf):
    """A map whose documents each have one of many names."""
    d = orders(spark, sf).orderBy("o_orderkey").limit(500).select(F.concat(F.lit('{"attributes":{"n'), (F.col("o_custkey") % 60).cast("string"), F.lit('":1}}')).alias("doc"))
    found = maps.detect([canon.parse_document(r.doc) for r in d.collect()])
    return spark.createDataFrame([(m.pattern, m.distinctKeys, m.averageKeys, m.documents) for m in found], "pattern string, distinct_keys long, average_keys double, documents long")


_W = "(({k}::DOUBLE / {n} + 1.9207294103616893 / {n}) / (1 + 3.8414588207233787 / {n}))"
_H = "(1.959963984540054 * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + 3.8414588207233787 / (4.0 * {n} * {n})) / (1 + 3.8414588207233787 / {n}))"


def _wil(k: str, n: str) -> tuple[str, str, str]:
    p, w, h = f"({k}::DOUBLE / {n})", _W.format(k=k, n=n), _H.format(k=k, n=n)
    return p, f"greatest(0, least({p}, {w} - {h}))", f"least(1, greatest({p}, {w} + {h}))"


_p, _lo, _hi = _wil("k", "m")


@query(f"SELECT o_orderstatus, k, m, round({_p}, 9) AS point, round({_lo}, 9) AS lower, round({_hi}, 9) AS upper FROM (SELECT o_orderstatus, count(*) FILTER (o_totalprice > 150000) AS k, count(*) AS m FROM orders GROUP BY 1)")
def wilson_interval(spark, sf):
    g = orders(spark, sf).groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 150000).alias("k"), F.count(F.lit(1)).alias("m"))
    p, lo, hi = wilson(F.col("k"), F.col("m"))
    return g.select("o_orderstatus", "k", "m", F.round(p, 9).alias("point"), F.round(lo, 9).alias("lower"), F.round(hi, 9).alias("upper"))


_SAMPLE = CTE + ", sb AS (SELECT o_orderkey FROM b ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '#sample'), CAST(o_orderkey AS VARCHAR) LIMIT 400), sc AS (SELECT o_orderkey FROM c ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '#sample'), CAST(o_orderkey AS VARCHAR) LIMIT 400)"


@query(_SAMPLE + "SELECT o_orderkey FROM sb")
def sample_keys(spark, sf):
    return Side(orders(spark, sf), KEY).sample(400, "sample").keys_only()


_pr, _lor, _hir = _wil("removed", "m")
_pa, _loa, _hia = _wil("added", "ms")


@query(_SAMPLE + f", q AS (SELECT (SELECT count(*) FROM sb WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c)) AS removed, (SELECT count(*) FROM sb) AS m, (SELECT count(*) FROM sc WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)) AS added, (SELECT count(*) FROM sc) AS ms) SELECT removed, added, round({_pr}, 9) AS removed_rate, round({_lor}, 9) AS removed_lower, round({_hir}, 9) AS removed_upper, round({_pa}, 9) AS added_rate, round({_loa}, 9) AS added_lower, round({_hia}, 9) AS added_upper FROM q")
def sample_metrics(spark, sf):
    b, c = sides(spark, sf)
    sb, sc = b.sample(400, "sample").keys_only(), c.sample(400, "sample").keys_only()
    n = lambda s, other: s.join(other.keys_only().withColumn("x", F.lit(1)), list(KEY), "left").agg(F.count_if(F.col("x").isNull()).alias("k"), F.count(F.lit(1)).alias("n"))
    q = n(sb, c).withColumnsRenamed({"k": "removed", "n": "m"}).crossJoin(n(sc, b).withColumnsRenamed({"k": "added", "n": "ms"}))
    r, a = wilson(F.col("removed"), F.col("m")), wilson(F.col("added"), F.col("ms"))
    return q.select("removed", "added", *[F.round(x, 9).alias(f"{k}_{s}") for k, w in (("removed", r), ("added", a)) for s, x in zip(("rate", "lower", "upper"), w, strict=True)])


_pp, _lop, _hip = _wil("docs", "m")


@query(_SAMPLE + f", sm AS (SELECT * FROM s WHERE k IN (SELECT o_orderkey FROM sb) AND status IN ('changed', 'unchanged')) SELECT path, docs, round({_pp}, 9) AS rate, round({_lop}, 9) AS lower, round({_hip}, 9) AS upper FROM (SELECT path, count(*) AS docs, (SELECT count(*) FROM sm) AS m FROM u WHERE k IN (SELECT k FROM sm) GROUP BY path)")
def sample_path_rates(spark, sf):
    b, c = sides(spark, sf)
    p = pairs.typed_pairs(b.sample(400, "sample"), c, SETTINGS, "left_outer")
    m = p.agg(F.count_if(F.col("status") != "removed").alias("m"))
    point, lo, hi = wilson(F.col("docs"), F.col("m"))
    return summary.path_counts(p).crossJoin(F.broadcast(m)).select("path", "docs", F.round(point, 9).alias("rate"), F.round(lo, 9).alias("lower"), F.round(hi, 9).alias("upper"))


_SUBSET = "WITH b AS (SELECT o_orderkey FROM orders), c AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey % 500 = 1), q AS (SELECT (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM c) AS nc, (SELECT count(*) FROM c WHERE o_orderkey IN (SELECT o_orderkey FROM b)) AS m) "


def _subset(spark, sf) -> tuple[Side, Side]:
    o = orders(spark, sf)
    return Side(o, KEY), Side(o.filter("o_orderkey % 10 = 0").unionByName(o.filter("o_orderkey % 500 = 1").withColumn("o_orderkey", -F.col("o_orderkey"))), KEY, name="candidate")


@query(_SUBSET + "SELECT m AS matched, nc - m AS added, nb - m AS removed, m / (nb + nc - m) AS similarity, (nc - m) / nc AS added_rate, (nb - m) / nb AS removed_rate FROM q")
def matched_only_metrics(spark, sf):
    k = compare(*_subset(spark, sf), replace(SETTINGS, matchedOnly=True)).keys
    return one_row(spark, matched=k.matched, added=k.added, removed=k.removed, similarity=k.keySimilarity.value, added_rate=k.addedRate.value, removed_rate=k.removedRate.value).selectExpr("cast(matched AS long) matched", "cast(added AS long) added", "cast(removed AS long) removed", "similarity", "added_rate", "removed_rate")


_pm, _lom, _him = _wil("m", "n")


@query(_SUBSET + f", x AS (SELECT o_orderkey FROM c ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '#sample'), o_orderkey LIMIT 50), y AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey IN (SELECT o_orderkey FROM b)) AS m FROM x) SELECT n AS sampled, round(nc * {_pm}, 6) AS matched_estimate, round(nc * {_lom}, 6) AS low, round(nc * {_him}, 6) AS high FROM (SELECT n, y.m AS m, nc FROM y, q)")
def matched_only_sample(spark, sf):
    from .operators.rates import wilson as interval

    b, c = _subset(spark, sf)
    r = compare(b, c, replace(SETTINGS, matchedOnly=True, mode=Mode("SAMPLE", 50)))
    nc, n = r.run.candidateCount, r.keys.keySimilarity.sampleSize
    m = round((1 - r.keys.addedRate.value) * n)
    return one_row(spark, sampled=n, **dict(zip(("matched_estimate", "low", "high"), (round(nc * x, 6) for x in interval(m, n)), strict=True))).withColumn("sampled", F.col("sampled").cast("long"))


@query("SELECT t, n, CASE WHEN n <= 10000 THEN 'FULL' ELSE 'SAMPLE' END AS mode FROM (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer)")
def auto_mode(spark, sf):
    rows = [(t, n, resolve_mode(replace(SETTINGS, fullScanLimit=10_000), n, n)[0].type) for t in ("orders", "lineitem", "customer") for n in [table(spark, sf, t).count()]]
    return spark.createDataFrame(rows, "t string, n long, mode string")


_RULES = CTE + f""", x AS (SELECT matched / (matched + added + removed) AS sim, unchanged / matched AS unc, (SELECT max(docs) / (SELECT matched FROM n) FROM ({_PATHS})) AS pth FROM n),
    r AS (SELECT 'keySimilarity' AS rule, sim AS observed, CASE WHEN sim >= 0.99 THEN 0 WHEN sim >= 0.97 THEN 1 ELSE 2 END AS level FROM x
    UNION ALL SELECT 'unchangedRate', unc, CASE WHEN unc >= 0.95 THEN 0 WHEN unc >= 0.85 THEN 1 ELSE 2 END FROM x
    UNION ALL SELECT 'maxPathChangeRate', pth, CASE WHEN pth < 0.05 THEN 0 WHEN pth < 0.20 THEN 1 ELSE 2 END FROM x
    UNION ALL SELECT 'structure.vanishedPaths', 0, 0 UNION ALL SELECT 'structure.newPaths', 0, 0 UNION ALL SELECT 'structure.presenceDeltas', 0, 0
    UNION ALL SELECT 'structure.typeShifts', 2, 2)"""
_LEVEL = "CASE {0} WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' ELSE 'RED' END"


@query(_RULES + f"SELECT rule, round(observed, 9) AS observed, {_LEVEL.format('level')} AS level FROM r")
def rule_levels(spark, sf):
    r = compare(*sides(spark, sf), FULL)
    return spark.createDataFrame([(x.rule, round(float(x.observed), 9), x.level.value) for x in r.rules], "rule string, observed double, level string")


@query(_RULES + f"SELECT {_LEVEL.format('(SELECT max(level) FROM r)')} AS verdict, matched, added, removed, unchanged, changed, round(matched / (matched + added + removed), 9) AS similarity FROM n")
def verdict_(spark, sf):
    r = compare(*sides(spark, sf), FULL)
    row = (r.verdict.value, r.keys.matched, r.keys.added, r.keys.removed, r.content.unchanged, r.content.changed, round(r.keys.keySimilarity.value, 9))
    return spark.createDataFrame([row], "verdict string, matched long, added long, removed long, unchanged long, changed long, similarity double")


QUERIES["verdict"], ORACLE["verdict"] = QUERIES.pop("verdict_"), ORACLE.pop("verdict_")

_HISTORY = "WITH h AS (SELECT 'r' || lpad(CAST(i AS VARCHAR), 3, '0') AS id, 'base' AS baseline, CASE WHEN i % 2 = 0 THEN 'a' ELSE 'b' END AS candidate, CASE WHEN i % 7 = 0 THEN 'RED' WHEN i % 3 = 0 THEN 'YELLOW' ELSE 'GREEN' END AS verdict, i AS finished_at, CAST(i % 3 AS VARCHAR) AS job, 0.9 + (i * 7 % 11) / 200.0 AS similarity, 0.8 + (i * 5 % 13) / 100.0 AS unchanged, (i * 3 % 17) / 400.0 AS path_rate FROM range(60) t(i)) "
_MINE = "m AS (SELECT * FROM h WHERE candidate = 'a' AND verdict <> 'RED' ORDER BY finished_at DESC LIMIT 20) "


def _reports(spark) -> DataFrame:
    i = F.col("id")
    return spark.range(60).select(F.concat(F.lit("r"), F.lpad(i.cast("string"), 3, "0")).alias("id"), F.lit("base").alias("baseline"), F.when(i % 2 == 0, "a").otherwise("b").alias("candidate"), F.when(i % 7 == 0, "RED").when(i % 3 == 0, "YELLOW").otherwise("GREEN").alias("verdict"), i.alias("finished_at"),
                                  F.create_map(F.lit("job"), (i % 3).cast("string")).alias("labels"), (0.9 + (i * 7 % 11) / 200.0).alias("similarity"), (0.8 + (i * 5 % 13) / 100.0).alias("unchanged"), ((i * 3 % 17) / 400.0).alias("path_rate"))


_BAND = "SELECT '{0}' AS metric, count({0}) AS n, avg({0}) AS m, greatest(stddev_samp({0}), 0.005) AS s, {1} AS up FROM m"


@query(_HISTORY + ", " + _MINE + ", x AS (" + " UNION ALL ".join(_BAND.format(c, u) for c, u in (("similarity", "true"), ("unchanged", "true"), ("path_rate", "false"))) + ") SELECT metric, n, round(CASE WHEN up THEN least(1, greatest(0, m - 2 * s)) ELSE least(1, greatest(0, m + 2 * s)) END, 9) AS green, round(CASE WHEN up THEN least(1, greatest(0, m - 3 * s)) ELSE least(1, greatest(0, m + 3 * s)) END, 9) AS yellow FROM x")
def learned_thresholds(spark, sf):
    mine = history.of_pair(_reports(spark), "base", "a", False, 20)
    return history.learned_bands(mine, {"similarity": True, "unchanged": True, "path_rate": False}).select("metric", "n", F.round("green", 9).alias("green"), F.round("yellow", 9).alias("yellow"))


@query(_HISTORY + ", " + _MINE + "SELECT id, verdict, finished_at FROM m")
def report_history(spark, sf):
    return history.of_pair(_reports(spark), "base", "a", False, 20).select("id", "verdict", "finished_at")


@query(_HISTORY + "SELECT id, finished_at FROM h WHERE job = '2' ORDER BY finished_at DESC LIMIT 5")
def reports_by_label(spark, sf):
    return history.of_labels(_reports(spark), {"job": "2"}, 5).select("id", "finished_at")


@query(_HISTORY + "SELECT id, candidate, finished_at FROM h ORDER BY finished_at DESC LIMIT 10")
def recent_reports(spark, sf):
    return history.newest(_reports(spark), 10).select("id", "candidate", "finished_at")


def _hints(spark, sf, b: Side, c: Side, **options) -> DataFrame:
    r = compare(b, c, replace(SETTINGS, keyFields=b.keys, **options))
    return spark.createDataFrame([(h.kind, h.path) for h in r.hints], "kind string, path string")


@query(CTE + f"SELECT 'EXPECTED_CHANGE' AS kind, path FROM ({_PATHS}) WHERE docs / (SELECT matched FROM n) >= 0.05 AND docs / (SELECT matched FROM n) < 0.9")
def hints_expected_change(spark, sf):
    return _hints(spark, sf, *sides(spark, sf))


@query("SELECT 'IGNORE_TECHNICAL_FIELD' AS kind, 'o_orderdate' AS path UNION ALL SELECT 'INVESTIGATE', 'o_totalprice'")
def hints_technical_and_investigate(spark, sf):
    b = orders(spark, sf)
    return _hints(spark, sf, Side(b, KEY), Side(mutate(b, "o_orderkey", ["modify:o_orderdate:1", "modify:o_totalprice:1"]), KEY, name="candidate"))


@query("""WITH b AS (SELECT o_orderkey AS k FROM orders), c AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey ELSE -o_orderkey END AS k FROM orders), q AS (SELECT (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM c) AS nc, (SELECT count(*) FROM b JOIN c USING (k)) AS m)
    SELECT 'INVESTIGATE' AS kind, CAST(NULL AS VARCHAR) AS path FROM q WHERE (nb - m) / nb > 0.5 AND (nc - m) / nc > 0.5""")
def hints_replaced_keys(spark, sf):
    b = orders(spark, sf)
    return _hints(spark, sf, Side(b, KEY), Side(b.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))), KEY, name="candidate"))


@query(_SUBSET + "SELECT 'MATCHED_ONLY' AS kind, CAST(NULL AS VARCHAR) AS path FROM q WHERE m > 0 AND (nb - m) / nb >= 0.5 AND (nc - m) / nc <= 0.05")
def hints_subset(spark, sf):
    return _hints(spark, sf, *_subset(spark, sf))


@query("SELECT 'WILDCARD' AS kind, 'm' AS path FROM orders HAVING count(DISTINCT o_orderkey % 150) >= 100")
def hints_wildcard(spark, sf):
    d = orders(spark, sf).select(F.concat(F.lit('{"_id":'), F.col("o_orderkey").cast("string"), F.lit(',"m":{"k'), F.pmod("o_orderkey", F.lit(150)).cast("string"), F.lit('":1}}')).alias("doc"))
    return _hints(spark, sf, Side(d, doc="doc"), Side(d, doc="doc", name="candidate"), mapDetection=False)


_LITERALS = ['{"a":[1,null]}', '{"n":1.0,"m":{"$numberDecimal":"1.10"}}', '{"d":{"$date":"2024-01-01T00:00:00Z"},"o":{"$oid":"65a000000000000000000001"}}', '{"s":"a\\"b","e":{},"x":[]}']


@query()
def canonical_encoding(spark, sf):
    rows = [(t, canon.encode(canon.normalize(canon.parse_document(t), pairs.rules_of(Settings()))).hex(), canon.content_hash(canon.normalize(canon.parse_document(t), pairs.rules_of(Settings()))).hex()) for t in _LITERALS]
    return spark.createDataFrame(rows, "doc string, encoding string, content_hash string")


@query("SELECT * FROM (VALUES (0, '{\"$minKey\": 1}'), (1, 'null'), (2, '-5'), (3, '1'), (4, '2.5'), (5, '\"a\"'), (6, '\"b\"'), (7, 'true')) t(place, key)")
def bson_key_order(spark, sf):
    docs = ['{"_id":"b"}', '{"_id":1}', '{"_id":null}', '{"_id":true}', '{"_id":2.5}', '{"_id":"a"}', '{"_id":-5}', '{"_id":{"$minKey":1}}']
    rows = Side(spark.createDataFrame([(d,) for d in docs], "doc string"), doc="doc").documents().orderBy("_ksort").select("_kvalue").collect()
    return spark.createDataFrame([(i, r._kvalue) for i, r in enumerate(rows)], "place int, key string")


@query()
def render_values(spark, sf):
    rows = [(n, canon.render(canon.scalar(v) if v[0] not in ("DOCUMENT", "ARRAY") else canon.normalize(("DOCUMENT", [("x", v)]), pairs.rules_of(Settings()))[1][0][1])) for t in _LITERALS for n, v in canon.parse_document(t)[1]]
    return spark.createDataFrame(rows, "name string, rendered string")


@query("SELECT 'AT_LEAST' AS band, x, CASE WHEN x >= 0.99 THEN 'GREEN' WHEN x >= 0.97 THEN 'YELLOW' ELSE 'RED' END AS level FROM (VALUES (0.99), (0.98), (0.97), (0.5)) t(x) UNION ALL SELECT 'BELOW', x, CASE WHEN x < 0.05 THEN 'GREEN' WHEN x < 0.2 THEN 'YELLOW' ELSE 'RED' END FROM (VALUES (0.05), (0.01), (0.2), (0.19)) t(x)")
def threshold_bands(spark, sf):
    up, down = AtLeast(0.99, 0.97), Below(0.05, 0.2)
    rows = [("AT_LEAST", x, up.level(x).value) for x in (0.99, 0.98, 0.97, 0.5)] + [("BELOW", x, down.level(x).value) for x in (0.05, 0.01, 0.2, 0.19)]
    return spark.createDataFrame(rows, "band string, x double, level string")
