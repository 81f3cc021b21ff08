import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest

from twinsift import canon as C
from twinsift.model import AtLeast, Below, KeyRef, Level, Mode, Rate, Settings, VerdictBasis, parse_labels
from twinsift.operators import rates
from twinsift.paths import PathMatcher, Rules, parse


def doc(text):
    return C.parse_document(text.replace("'", '"'))


def norm(text, rules=None, **k):
    return C.normalize(doc(text), rules or Rules(), **k)


def changed(a, b, rules=None):
    r = rules or Rules()
    return C.changed_paths(norm(a, r), norm(b, r), r)


def test_number_typing():
    t = {k: doc(f"{{'x':{k}}}")[1][0][1][0] for k in ("1", "3000000000", "9223372036854775808", "1.0", "1e400", "1.10000000000000001", "-2147483648", "1" * 40)}
    assert list(t.values()) == ["INT32", "INT64", "DECIMAL128", "DOUBLE", "DECIMAL128", "DECIMAL128", "INT32", "DOUBLE"]
    assert doc("{'a':1,'b':2,'a':3}")[1] == [("a", ("INT32", 3)), ("b", ("INT32", 2))]


def test_canonical_numbers_and_types():
    assert norm("{'a':1}") == norm("{'a':1.0}") == norm("{'a':{'$numberDecimal':'1.00'}}") == norm("{'a':{'$numberLong':'1'}}")
    assert norm("{'a':0.1}") == norm("{'a':{'$numberDecimal':'0.1'}}")
    assert norm("{'a':9007199254740993}") != norm("{'a':9007199254740992.0}")
    assert norm("{'a':-0.0}") == norm("{'a':0}")
    assert norm("{'a':{'$date':1000}}") != norm("{'a':1000}")
    assert norm("{'a':{'$date':'1970-01-01T00:00:01Z'}}") == norm("{'a':{'$date':1000}}")
    assert norm("{'a':{'$numberDouble':'NaN'}}") == norm("{'a':{'$numberDecimal':'NaN'}}")


def test_order_null_and_ignored():
    assert norm("{'a':1,'b':[1,2,2]}") == norm("{'b':[2,1,2],'a':1}")
    assert norm("{'b':[1,2]}", Rules(ordered=["b"])) != norm("{'b':[2,1]}", Rules(ordered=["b"]))
    assert norm("{'a':null,'b':[null]}", null_equals_missing=True) == norm("{'b':[null]}")
    assert norm("{'a':null}") != norm("{}")
    assert norm("{'a':{'x':1,'y':2}}", Rules(["a.x"])) == norm("{'a':{'y':2}}")
    assert norm("{'items':[1,2]}", Rules(["items[]"])) == norm("{'items':[]}")
    assert norm("{'_id':1,'a':{'_id':2}}", drop=("_id",)) == norm("{'a':{'_id':2}}")


def test_encoding_pin():
    value = ("doc", (("a", ("arr", (("num", Decimal(1)), ("null", None)))),))
    assert C.encode(value).hex() == "0b00000001" "00000001" "61" "0c00000002" "04" "00000000" "00000001" "01" "01"


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("{'t':[]}", "{'t':['a']}", {"t[]"}), ("{'a':{}}", "{'a':{'x':1}}", {"a.x"}), ("{'a':1}", "{'a':{'x':1}}", {"a", "a.x"}), ("{'a':1,'b':{'c':2}}", "{'a':1,'b':{'c':3}}", {"b.c"}),
        ("{'a':1}", "{'a':1,'n':{'x':{'y':1},'z':[]}}", {"n.x.y", "n.z"}), ("{'i':[{'s':'a','q':1},{'s':'b','q':2}]}", "{'i':[{'s':'b','q':2},{'s':'a','q':5}]}", {"i[].q"}),
        ("{'i':[{'x':1,'y':2},{'x':2,'y':1}]}", "{'i':[{'x':1,'y':1},{'x':2,'y':2}]}", {"i[]"}), ("{'a':[[1],[2]]}", "{'a':[[1],[3]]}", {"a[][]"}), ("{'a':1}", "{'a':1.0}", set()),
    ],
)
def test_changed_paths(a, b, want):
    assert changed(a, b) == want


def test_changed_paths_rules():
    r = Rules(ordered=["s"], wildcards=["m.*"])
    assert changed("{'s':[1,2,3]}", "{'s':[1,3]}", r) == {"s[]"}
    assert changed("{'s':[{'a':1,'b':1},{'a':2}]}", "{'s':[{'a':1,'b':2},{'a':2}]}", r) == {"s[].b"}
    assert changed("{'m':{'colour':'red','size':'blue'}}", "{'m':{'colour':'blue','size':'red'}}", r) == {"m.*"}


def relational(a, b, rules):
    """An independent form: leaf rows keyed by the place of the outermost unordered array above them, compared as multisets."""

    def rows(v, state, path, anchor, inside, out, kinds):
        if v[0] == "arr" and not inside and not state.ordered:
            kinds[anchor] = ("arr", path, v)
            for x in v[1]:
                rows(x, state.element(), path + "[]", anchor, True, out, kinds)
            return
        if C.is_leaf(v):
            if not inside and v[0] in ("doc", "arr"):
                kinds[anchor] = (v[0], path, v)
            if path:
                out[anchor, path][v] += 1
            return
        if not inside:
            kinds[anchor] = (v[0], path, v)
        for i, x in enumerate(v[1]):
            n, x = x if v[0] == "doc" else (i, x)
            s, p = (state.field(n), state.name(path, n)) if v[0] == "doc" else (state.element(), path + "[]")
            rows(x, s, p, anchor if inside else (*anchor, n), inside, out, kinds)

    sides = []
    for v in (a, b):
        out, kinds = defaultdict(Counter), {}
        rows(v, rules.root, "", (), False, out, kinds)
        for anchor, (kind, path, x) in kinds.items():
            if kind == "arr" and not x[1] and path:
                out[anchor, path][x] += 1
        sides.append((out, kinds))
    for (out, kinds), (_, other) in ((sides[0], sides[1]), (sides[1], sides[0])):
        for anchor, (kind, path, x) in kinds.items():
            if not x[1] and anchor in other and other[anchor][0] == kind:
                out.pop((anchor, path), None)
    left, right = sides
    found = {k for k in {*left[0], *right[0]} if left[0].get(k, Counter()) != right[0].get(k, Counter())}
    paths = {p for _, p in found}
    for anchor in left[1].keys() & right[1].keys():
        (k1, path, x), (k2, _, y) = left[1][anchor], right[1][anchor]
        if k1 == k2 == "arr" and x != y and not any(f[0] == anchor for f in found) and not _ordered(path, rules):
            paths.add(path + "[]")
    return paths


def _ordered(path, rules):
    s = rules.root
    for step in parse(path):
        s = s.element() if step == "[]" else s.field(step)
    return s.ordered


def test_changed_paths_equal_the_relational_form():
    rng = random.Random(4)
    rules = Rules(ordered=["o"])

    def value(d):
        k = rng.random()
        if d and k < 0.25:
            return "doc", tuple((n, value(d - 1)) for n in sorted(rng.sample("abc", rng.randint(0, 3))))
        if d and k < 0.5:
            return "arr", tuple(sorted((value(d - 1) for _ in range(rng.randint(0, 3))), key=C.encode))
        return "num", Decimal(rng.randint(0, 2))

    def root():
        return "doc", tuple((n, value(3)) for n in "aow")

    same = 0
    for _ in range(6000):
        a, b = root(), root()
        if C.changed_paths(a, b, rules) == relational(a, b, rules):
            same += 1
    assert same == 6000


def test_value_changes_and_rendering():
    r = Rules()
    a, b = norm("{'t':['x','y','y'],'p':1.50,'q':'secret'}", r), norm("{'t':['y','z'],'p':2,'q':'other'}", r)
    got = C.value_changes(a, b, {"t[]", "p", "q"}, r, PathMatcher(["q"]))
    assert got == {"p": (["1.5"], ["2"]), "q": (["***"], ["***"]), "t[]": (['"x"', '"y"'], ['"z"'])}
    many = C.value_changes(norm("{'t':[1,2,3,4,5,6,7]}"), norm("{'t':[]}"), {"t[]"}, r)
    assert many["t[]"][0][-1] == "… 2 more"
    assert C.render(("str", 'a"\\')) == '"a\\"\\\\"' and len(C.render(("str", "x" * 500))) == 120
    assert C.render(C.scalar(("DATE_TIME", 0))) == "1970-01-01T00:00:00Z" and C.render(("num", Decimal("1E+3"))) == "1000"


def test_key_order_and_refs():
    order = ["{'$minKey':1}", "null", "{'$numberDouble':'NaN'}", "-5", "-0.5", "0", "1", "1.5", "20", "{'$numberDouble':'Infinity'}", "'a'", "'ab'", "'b'", "{'x':1}", "{'x':2}", "{'$oid':'00000000000000000000000a'}", "false", "true", "{'$date':5}", "{'$maxKey':1}"]
    keys = [doc(f"{{'_id':{k}}}")[1][0][1] for k in order]
    enc = [C.key_sort(k) for k in keys]
    assert enc == sorted(enc) and len(set(enc)) == len(enc)
    assert C.key_sort(("INT32", 1)) == C.key_sort(("DOUBLE", 1.0)) == C.key_sort(("DECIMAL128", Decimal("1.0")))
    rng = random.Random(3)
    numbers = [rng.choice([rng.randint(-10**6, 10**6), rng.uniform(-1e3, 1e3), Decimal(rng.randint(-9999, 9999)).scaleb(rng.randint(-8, 8))]) for _ in range(2000)]
    exact = lambda x: Decimal(repr(x)) if isinstance(x, float) else Decimal(x)
    by_bytes = sorted(numbers, key=lambda x: C.key_sort(("DECIMAL128", x) if isinstance(x, Decimal) else C.raw(x)))
    assert [exact(x) for x in by_bytes] == sorted(map(exact, numbers))
    with pytest.raises(ValueError):
        C.key_sort(("ARRAY", []))
    for k in keys:
        assert C.key_sort(C.parse_key_ref(C.key_ref(k))) == C.key_sort(k)
    assert C.key_ref(("INT32", 5)) == KeyRef("INT32", "5")


def test_paths():
    for bad in ("", " ", "a..b", "[]", "a[b]", "a*", "a[]x"):
        with pytest.raises(ValueError):
            parse(bad)
    assert parse("a[].b.*") == ("a", "[]", "b", "*")
    m = PathMatcher(["a.*.c", "items[]"])
    assert m.matches("a.x.c") and m.matches("a.x.c.d[]") and m.matches("items[].q") and not m.matches("items") and not m.matches("a.x") and not m.matches("a[].c") and not m.matches("a..c")
    with pytest.raises(ValueError):
        Rules(wildcards=["a.b"])


def test_path_regex_equals_matcher():
    import re

    rng = random.Random(5)
    parts = ["a", "b.", ".", "[]", "*", "c d", "a[]", ".*", "x+"]
    good = [p for p in ("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(400)) if _addressable(p)]
    for _ in range(300):
        m = PathMatcher(rng.sample(good, 2))
        for _ in range(30):
            path = "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
            assert bool(re.search(m.regex(), path)) == m.matches(path), (m.patterns, path)
    assert not re.search(PathMatcher().regex(), "a")


def _addressable(p):
    from twinsift.paths import addressable

    return addressable(p)


def test_profile_nodes():
    got = C.node_types(doc("{'_id':1,'a':{'x':null,'y':[1,'s',{}]},'e':[]}"), Rules(["e[]"]))
    assert got == {("_id", "INT32"), ("a", "DOCUMENT"), ("a.x", "NULL"), ("a.y", "ARRAY"), ("a.y[]", "INT32"), ("a.y[]", "STRING"), ("a.y[]", "DOCUMENT"), ("e", "ARRAY")}
    assert ("a.x", "NULL") not in C.node_types(doc("{'a':{'x':null}}"), Rules(), True)


def test_rates():
    p, lo, hi = rates.wilson(50, 100)
    assert (round(lo, 4), round(hi, 4)) == (0.4038, 0.5962) and rates.wilson(0, 0) is None
    for n in (1, 7, 40):
        for k in range(n + 1):
            p, lo, hi = rates.wilson(k, n)
            assert 0 <= lo <= p <= hi <= 1
    with pytest.raises(ValueError):
        rates.wilson(3, 2)
    with pytest.raises(ValueError):
        Rate.exact(3, 2)
    assert Rate.exact(0, 0).value is None
    e = Rate.estimate(0.5, 0.4, 0.6, 10)
    assert (e.for_basis(VerdictBasis.CONSERVATIVE, True), e.for_basis(VerdictBasis.CONSERVATIVE, False), e.for_basis(VerdictBasis.POINT, True)) == (0.4, 0.6, 0.5)
    k, m = rates.sample_keys(90, 10, 5, 100, 1000, 2000)
    assert (k.matched, k.added, k.removed, m) == (900, 100, 100, 900.0) and k.keySimilarity.lower <= 900 / 1100 <= k.keySimilarity.upper
    assert rates.sample_keys(0, 0, 0, 0, 0, 0)[0].keySimilarity.value is None
    k, _ = rates.matched_only_sample(0, 0, 5, 9)
    assert (k.matched, k.added, k.removed, k.keySimilarity.value) == (0, 9, 5, None)


def test_settings():
    assert AtLeast(0.9, 0.8).level(0.9) == Level.GREEN and AtLeast(0.9, 0.8).level(0.8) == Level.YELLOW and Below(0.1, 0.2).level(0.1) == Level.YELLOW and Below(0.1, 0.2).level(0.2) == Level.RED
    for bad in (lambda: AtLeast(0.8, 0.9), lambda: Below(0.3, 0.2), lambda: AtLeast(1.1, 0.5), lambda: Settings("a", "a"), lambda: Settings(keyFields=("a.b",)), lambda: Mode("SAMPLE"), lambda: parse_labels("a b=1"), lambda: parse_labels("novalue")):
        with pytest.raises(ValueError):
            bad()
    assert parse_labels("a=1,b:x=y") == {"a": "1", "b": "x=y"}
    s = Settings(ignoredPaths=["b", "a", "a"], labels={"x": "1"}).merged(labels={"y": "2"}, mode=None)
    assert s.ignoredPaths == ("_class", "a", "b") and s.labels == {"x": "1", "y": "2"} and s.mode == Mode()
    assert Level.worst([]) == Level.GREEN and Level.worst([Level.YELLOW, Level.RED, Level.GREEN]) == Level.RED


def test_numbers_of_different_types_compare_as_their_texts(spark):
    """Where numbers are compared natively the result is that of their texts."""
    from itertools import combinations

    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from twinsift.functions.expressions import number_text, same

    values = ["null", "0", "-0.0", "1", "-1", "1.5", "0.1", "127", "2147483647", "-2147483648", "2147483648", "9007199254740991", "9007199254740992", "9007199254740993", "-9007199254740993", "1152921504606846976", "1152921504606846980", "9223372036854775807", "1e-20", "1e25", "NaN", "Infinity"]
    kinds = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.DecimalType(10, 2), T.DecimalType(38, 0), T.DecimalType(38, 20), T.DecimalType(21, 1)]
    whole = spark.createDataFrame([(v,) for v in values], "v string")
    one = whole.select(*[F.col("v").try_cast(k).alias(f"a{i}") for i, k in enumerate(kinds)])
    both = one.crossJoin(one.toDF(*[f"b{i}" for i in range(len(kinds))]))
    checks = []
    for (i, x), (j, y) in combinations(enumerate(kinds), 2):
        for (p, tp), (q, tq) in (((f"a{i}", x), (f"b{j}", y)), ((f"a{j}", y), (f"b{i}", x))):
            checks.append((same(F.col(p), tp, F.col(q), tq) != number_text(F.col(p), tp).eqNullSafe(number_text(F.col(q), tq))).alias(f"{p}_{q}"))
    differ = both.agg(*[F.coalesce(F.count_if(F.coalesce(c, F.lit(True))), F.lit(0)).alias(f"n{k}") for k, c in enumerate(checks)]).first()
    assert [k for k, n in enumerate(differ) if n] == []
