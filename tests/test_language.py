import pytest

from spindrift.plans import patterns
from spindrift.plans.parser import CreateIndex, CreateTable, ParseError, parse, parse_pattern


@pytest.mark.parametrize(
    "text, paths",
    [
        ("OR(SEQ(Tap p, Swipe q), AND(Tap r, Hold s))", ["pq", "rs", "sr"]),
        ("AND(SEQ(Tap p, Swipe q), Hold r)", ["pqr", "rpq"]),
        ("SEQ(Tap p, OR(Swipe q, AND(Hold r, Tap s)), Swipe t)", ["pqt", "prst", "psrt"]),
        ("AND(OR(Tap p, Hold q), Swipe r)", ["pr", "qr", "rp", "rq"]),
        ("SEQ(AND(Tap p, Tap q), AND(Hold r, Hold s))", ["pqrs", "pqsr", "qprs", "qpsr"]),
        ("SEQ(SEQ(Tap p, ORDER q), SEQ(ANDROID r, Hold s))", ["pqrs"]),
        ("AND(AND(Hold p, Tap q), Swipe r)", ["pqr", "qpr", "rpq", "rqp"]),
        ("Tap p", ["p"]),
    ],
)
def test_paths(text, paths):
    p = parse_pattern(text)
    assert sorted("".join(v.name for v in path) for path in patterns.paths(p)) == sorted(paths)
    assert parse_pattern(str(p)) == p


def test_tree():
    p = parse_pattern("SEQ(AND(A a, B b), OR(C c, SEQ(D d, E e)))")
    assert patterns.length(p) == 4
    assert patterns.types(p) == dict(a="A", b="B", c="C", d="D", e="E")
    assert patterns.in_order(p) == ["a", "AND", "b", "SEQ", "c", "OR", "d", "SEQ", "e"]
    assert patterns.only_at(parse_pattern("SEQ(A a, B b)"), "a", 0) and not patterns.only_at(p, "a", 0)


def test_query():
    q = parse("pattern SEQ(A a, KP(B b), NEG(C x), D d)\nfrom t use SKIP_TILL_NEXT_MATCH where 1 <= a.v < 2.5 AND 3 < d.v AND d.v * 2 - 1 >= a.w / 4 AND a.v = 7 within 12 minutes return COUNT(*)")
    assert (q.strategy, q.within, q.unit, q.count) == ("next", 12, "MIN", True)
    assert [str(r) for r in q.ranges] == ["1 <= a.v < 2.5", "3 < d.v", "7 <= a.v <= 7"]
    assert str(q.compares[0]) == "d.v * 2 - 1 >= a.w * 0.25"
    implied = q.compares[0].implied("a", 4, 8)
    assert (implied.var, implied.low) == ("d", 1.0)


@pytest.mark.parametrize("text", ["", "SELECT 1", "PATTERN SEQ(A a) FROM t USING NOTHING WITHIN 1 hour RETURN x", "PATTERN SEQ(A a, B a) FROM t USING SKIP_TILL_ANY_MATCH WITHIN 1 hour RETURN x", "PATTERN SEQ(A a, NEG(B b)) FROM t USING SKIP_TILL_ANY_MATCH WITHIN 1 RETURN x", "PATTERN SEQ(A a) FROM t USING SKIP_TILL_ANY_MATCH WHERE z.v < 1 WITHIN 1 RETURN x", "CREATE TABLE t (a INT)"])
def test_refused(text):
    with pytest.raises(ValueError):
        parse(text)


def test_statements():
    t = parse("CREATE TABLE synthetic (type TYPE, a1 INT, a3 DOUBLE.2, c CHAR[16], time TIMESTAMP)")
    assert isinstance(t, CreateTable) and t.scales == {"a3": 2} and len(t.columns) == 5
    i = parse("CREATE INDEX x USING BITMAP ON synthetic (a1, a3)")
    assert i == CreateIndex("x", "BITMAP", "synthetic", ("a1", "a3"))
    with pytest.raises(ParseError):
        parse("CREATE INDEX x USING HASH ON t (a)")
