import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidelog.model import EntityId, EventId, ModelError, TimeRange
from tidelog.plans.compile import explain
from tidelog.plans.ir import Binary, Bound, CausalTrace, Field, Literal, Not, Scan, SpatialScan, show
from tidelog.plans.parse import ParseError, dialect, parse, parse_expr
from tidelog.plans.rewrite import simplify, simplify_scan

LINES = "FROM orders\nENTITY 3:77:2\nTIME valid 1500..1900\nKNOWN_AS_OF 1850\nWHERE price <= 12\nSELECT price, sequence, buyer\nLIMIT 9"
COMPACT = "tn:#3:77:2@v1500..1900@k1850?price<=12>price,sequence,buyer!9"
SQL = "SELECT price, sequence, buyer FROM orders WHERE price <= 12 AND known_as_of = 1850 AND valid_time < 1900 AND entity = '#3:77:2' AND valid_time >= 1500 LIMIT 9"


def test_dialects_agree():
    want = Scan(EntityId(3, 77, 2), None, TimeRange(1500, 1900), (), 1850, Binary("<=", Field("price"), Literal(12)), ("price", "sequence", "buyer"), 9)
    assert parse(LINES) == parse(COMPACT) == parse(SQL) == want


def test_causal_spellings():
    assert parse("EVENT 7:3:41 TRACE CAUSES DEPTH 5 LIMIT 11") == CausalTrace(EventId(7, 3, 41), "causes", 5, 11)
    assert parse("tn:$7:3:41<-5") == CausalTrace(EventId(7, 3, 41), "causes", 5)
    assert parse("EVENT 9:1:6 TRACE EFFECTS DEPTH 3") == parse("tn:$9:1:6->3")


def test_boxes():
    assert parse("BOX 20,100..75,300 CHUNK 8 LIMIT 3") == SpatialScan(((20, 100), (75, 300)), 8, 3)
    assert parse("BOX 1,2,3..4,5,6") == SpatialScan(((1, 2, 3), (4, 5, 6))) and parse("BOX ALL LIMIT 2") == SpatialScan(None, 16, 2)
    for bad in ("BOX", "BOX 1..2", "BOX 1,2..3", "BOX 1,2..3,4 CHUNK 0", "BOX 1,2..3,4 DEPTH 2", "BOX a,b..c,d"):
        with pytest.raises(ParseError):
            parse(bad)


def test_dialect_detection():
    assert [dialect(x) for x in ("tn:#1", "#1", "$1:1:1<-2", " select 1", "ENTITY 1")] == ["compact", "compact", "compact", "sql", "lines"]


def test_one_sided_and_strict_bounds_are_kept():
    q = parse("SELECT * FROM log WHERE valid_time > 5 AND valid_time <= 9")
    assert q.bounds == (Bound(">", 5), Bound("<=", 9)) and q.valid is None


def test_precedence():
    assert show(parse_expr("a = 1 OR b = 2 AND NOT c = true")) == "((a = 1) OR ((b = 2) AND (NOT c = true)))"
    assert parse_expr("x && !y || z") == Binary("or", Binary("and", Field("x"), Not(Field("y"))), Field("z"))
    assert parse_expr("v > -3") == Binary(">", Field("v"), Literal(-3))
    assert parse("SELECT a FROM t WHERE (a = 1 AND b = 2) OR c = 3").where.op == "or"


def test_compact_without_projection_or_with_limit_only():
    assert parse("tn:?a = 1").where == Binary("=", Field("a"), Literal(1))
    assert parse("tn:#7!5") == Scan(entity=EntityId(0, 7, 1), limit=5)
    assert parse("tn:>a,b").select == ("a", "b")
    assert parse("tn:?a>b") == Scan(where=Field("a"), select=("b",))
    assert parse("tn:?a != 1!4") == Scan(where=Binary("!=", Field("a"), Literal(1)), limit=4)


@pytest.mark.parametrize("bad", ["", "tn:", "NONSENSE 1", "LIMIT x", "EVENT 1:1 TRACE CAUSES", "EVENT 1:1:1 TRACE UP", "SELECT a", "SELECT a FROM t LIMIT 'x'", "tn:#1:2", "ENTITY a", "TIME valid 1-2", "WHERE a = ", "WHERE a = 1 = 2", "SELECT a FROM t WHERE ("])
def test_errors(bad):
    with pytest.raises((ParseError, ModelError)):
        parse(bad)


def test_bare_entity_and_bounds_of_numbers():
    assert EntityId.parse("#7") == EntityId(0, 7, 1)
    with pytest.raises(ModelError):
        EntityId.parse(f"0:{1 << 63}:0")


def test_explain():
    text = explain(parse("ENTITY 5:6:7\nTIME valid 31..64\nKNOWN_AS_OF 63\nWHERE sequence < 4\nLIMIT 2"))
    for part in ("StorageScan (cost=10)", "entity=5:6:7", "valid_range=31..64", "limit=2", "pushdown_zone_maps=true, pushdown_bloom=true"):
        assert part in text
    assert "CausalWalk (cost=5)" in explain(parse("tn:$1:1:1<-2"))


def test_rewrites():
    cases = (("NOT NOT NOT paid", "NOT paid", 4), ("(paid OR false) AND NOT false", "paid", 2), ("(late OR late) OR (3 > 7)", "late", 2), ("NOT (2 <= 1) OR paid", "true", 1), ("(paid AND 4 != 4) OR late", "late", 2))
    for text, want, cost in cases:
        r = simplify(parse_expr(text))
        assert (show(r.expr), r.cost_after) == (want, cost)
    assert simplify(parse_expr("x = x")).expr == parse_expr("x = x")
    assert simplify(parse_expr("x = x"), frozenset({"x"})).expr == Literal(True)


def test_rewrites_of_scans():
    assert simplify_scan(parse("WHERE 1 = 1\nLIMIT 4")) == Scan(limit=4)
    assert simplify_scan(parse("WHERE a = 1 AND 2 < 1")) is None
    assert simplify_scan(parse("WHERE a = 1 AND 1 < 2")).where == parse_expr("a = 1")
    assert simplify_scan(Scan(limit=1)) == Scan(limit=1)


def test_large_conditions_are_simplified():
    e = parse_expr(" AND ".join(f"(NOT NOT a{k} OR false)" for k in range(300)))
    assert show(simplify(e).expr) == show(parse_expr(" AND ".join(f"a{k}" for k in range(300))))


def saturated(e):
    """Cost of the cheapest expression that single rules reach from a small one, each taken anywhere, in any order."""
    from tidelog.plans.rewrite import _equal_forms, cost

    def neighbours(x):
        yield from _equal_forms(x, frozenset())
        match x:
            case Not(a):
                yield from (Not(y) for y in neighbours(a))
            case Binary(op, a, b):
                yield from (Binary(op, y, b) for y in neighbours(a))
                yield from (Binary(op, a, y) for y in neighbours(b))

    seen, todo = {e}, [e]
    while todo:
        for y in neighbours(todo.pop()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return min(map(cost, seen))


TERMS = st.recursive(st.sampled_from([Field("a"), Field("b"), Literal(True), Literal(False)]), lambda c: st.builds(Not, c) | st.builds(Binary, st.sampled_from(["and", "or"]), c, c), max_leaves=8)


def value(e, env):
    match e:
        case Literal(v):
            return v
        case Field(n):
            return env[n]
        case Not(x):
            return not value(x, env)
        case Binary("and", x, y):
            return value(x, env) and value(y, env)
        case Binary("or", x, y):
            return value(x, env) or value(y, env)


@given(TERMS)
def test_rewrites_keep_the_meaning(e):
    r = simplify(e)
    assert r.cost_after == saturated(e) <= r.cost_before
    for a in (True, False):
        for b in (True, False):
            assert value(e, {"a": a, "b": b}) == value(r.expr, {"a": a, "b": b})
