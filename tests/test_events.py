import contextlib
import json
import random

import numpy as np
import pytest
from conftest import SF, compare
from pyspark.sql import functions as F

from spindrift import queries
from spindrift.engine import Engine, same_counts
from spindrift.functions import codecs
from spindrift.operators import matching, pruning, statistics, versions
from spindrift.operators.keyed import Runs, Windows, match_keyed
from spindrift.plans.parser import parse
from spindrift.sources import generate, tables

# Eight events (type, a1, a2, a3, a4, time) and, below, the query over them, whose answers are known.
ROWS = [("TYPE_1", 10, 100, 45.4, 100.5, 1), ("TYPE_9", 10, 100, 45.4, 100.5, 3), ("TYPE_1", 10, 100, 45.4, 100.5, 5), ("TYPE_3", 10, 100, 45.4, 100.5, 7), ("TYPE_0", 10, 100, 45.4, 100.0, 10), ("TYPE_0", 200, 10, 45.4, 118.0, 13), ("TYPE_0", 10, 200, 45.4, 118.0, 14), ("TYPE_0", 10, 100, 45.4, 103.7, 15)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    a, b = compare(spark, SF, queries.QUERIES[name], queries.ORACLES[name])
    assert a == b


@contextlib.contextmanager
def sort_merge(spark):
    """Small tables are joined as large ones are."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def small(spark, rows=ROWS, **how):
    e = Engine(spark, **how)
    e.register("t", spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, type string, a1 int, a2 int, a3 double, a4 double, time long"), "type", "time", "seq")
    return e


def test_eight_rows(spark):
    text = "PATTERN SEQ(TYPE_1 v0, TYPE_3 v1, TYPE_0 v2) FROM t USING SKIP_TILL_{}_MATCH WHERE 0 <= v0.a1 <= 101 AND 0 <= v0.a3 <= 3718.5 AND 0 <= v1.a4 <= 3718.5 AND 0 <= v2.a2 <= 101 AND v0.a1 <= v2.a1 AND v1.a4 <= v2.a4 WITHIN 10 units RETURN tuples"
    found = lambda s: sorted((r.v0__ts, r.v1__ts, r.v2__ts) for r in small(spark).sql(text.format(s)).collect())
    assert found("ANY") == [(5, 7, 13), (5, 7, 15)]
    assert found("NEXT") == [(5, 7, 13)]


@pytest.mark.parametrize("seed", range(4))
def test_random_queries(spark, seed):
    """Ties, repeated types, every strategy, prefilter and number of buckets: the answers of the sequential matcher."""
    rng = random.Random(seed)
    rows = sorted(((f"T{rng.randint(0, 2)}", rng.randint(0, 9), rng.randint(0, 9), 0.0, 0.0, rng.randint(-40, 60)) for _ in range(60)), key=lambda r: r[-1])
    shape = rng.choice(["SEQ(T0 a, T1 b, T2 c)", "AND(T0 a, SEQ(T1 b, T1 c))", "SEQ(T0 a, OR(T1 b, T0 c))"])
    for strategy in ("ANY", "NEXT"):
        text = f"PATTERN {shape} FROM t USING SKIP_TILL_{strategy}_MATCH WHERE a.a1 <= 7 AND c.a1 >= a.a2 AND b.a2 * 2 >= a.a1 - 1 WITHIN {rng.choice((0, 3, 9))} units RETURN tuples"
        q, want = parse(text), []
        events = [{"_type": r[0], "a1": r[1], "a2": r[2], "_ts": r[5], "_seq": i} for i, r in enumerate(rows)]
        for k, path in enumerate(q.paths):
            runs = Runs(path, q.ranges, q.compares, q.within, q.strategy)
            for e in events:
                for m in runs.feed(e):
                    at = dict(zip((v.name for v in path), m, strict=True))
                    want.append((k, *(at[v]["_seq"] if v in at else None for v in "abc")))
        for how in ({}, {"prefilter": "buckets"}, {"prefilter": "intervals"}, {"splits": 3}):
            got = [(r.path, r.a__seq, r.b__seq, r.c__seq) for r in small(spark, rows, **how).match(text).collect()]
            assert sorted(map(str, got)) == sorted(map(str, want)), (text, how)


def test_loop_arrays(spark):
    rows = [("A", 0, 0, 0.0, 0.0, t) if c == "A" else (c, 0, 0, 0.0, 0.0, t) for t, c in enumerate("ABBCBC")]
    text = "PATTERN SEQ(A a, {}(B b), C c) FROM t USING SKIP_TILL_NEXT_MATCH WITHIN 100 units RETURN tuples"
    found = lambda k: sorted((r.b__k, r.b__seqs, r.c__seq) for r in small(spark, rows, arrays=True).match(text.format(k)).collect())
    assert found("KP") == [(1, [1], 3), (2, [1, 2], 3), (3, [1, 2, 4], 5)]
    assert found("KS") == [(0, [], 3), *found("KP")]


def test_intervals(spark):
    # Points, spans and the merged and kept ones.
    points = spark.createDataFrame([(t,) for t in (4, 7, 15, 30, 35)], "ts long")
    spans = pruning.islands(pruning.intervals(points, 3), 6)
    assert sorted(map(tuple, spans.collect())) == [(1, 10), (12, 18), (27, 38)]
    others = spark.createDataFrame([(10, 14), (22, 25), (37, 40)], "lo long, hi long")
    assert sorted(map(tuple, pruning.keep_overlapping(others, spans, 6).collect())) == [(10, 14), (37, 40)]
    spans = spark.createDataFrame([(3, 6), (8, 10), (12, 14), (16, 18), (20, 21), (24, 29), (35, 40), (49, 53)], "lo long, hi long")
    points = spark.createDataFrame([(t,) for t in (1, 9, 13, 19, 24, 49, 52)], "ts long")
    assert sorted(r.ts for r in pruning.keep_points(points, spans, 5).collect()) == [9, 13, 24, 49, 52]
    assert sorted(map(tuple, pruning.keep_spans(spans, points, 5).collect())) == [(8, 10), (12, 14), (24, 29), (49, 53)]


def test_islands_over_stretches(spark):
    points = spark.createDataFrame([(t,) for t in range(0, 3000, 2)] + [(5000,)], "ts long")
    assert sorted(map(tuple, pruning.islands(pruning.intervals(points, 1), 2).collect())) == [(-1, 2999), (4999, 5001)]


def test_versions(spark):
    df = spark.createDataFrame([("A", 1, 1, 5), ("A", 1, 2, None), ("B", 1, 3, 7)], "type string, ts long, seq long, v int")
    assert sorted((r.seq, r.v) for r in versions.latest(df, ["type", "ts"], "seq").collect()) == [(2, None), (3, 7)]
    assert [r.seq for r in versions.without_deleted(df, ["type", "ts"], "seq", F.col("v").isNull()).collect()] == [3]


def test_tables(spark, tmp_path):
    e = Engine(spark)
    e.sql("CREATE TABLE t (type TYPE, a1 INT, a2 DOUBLE.3, a3 CHAR[16], timestamp TIMESTAMP)")
    (tmp_path / "t.csv").write_text("h\nA,7,0.125,north,2\nB,-31,x,south,6\n")
    e.load("t", tables.read_csv(spark, str(tmp_path / "t.csv"), e.schemas["t"]))
    assert [(r.type, r.a1, r.a2) for r in e.tables["t"].df.orderBy("seq").collect()] == [("A", 7, 0.125), ("B", -31, None)]
    e.sql("CREATE INDEX i USING SCAN ON t (a1)")
    assert e.sql("PATTERN SEQ(A x, B y) FROM t USING SKIP_TILL_ANY_MATCH WITHIN 9 RETURN COUNT(*)").first().matches == 1
    tables.write_events(e.tables["t"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert [r.value for r in tables.to_text(e.tables["t"].df, ["type", "a1"]).orderBy("value").collect()] == ["A,7", "B,-31"]
    with pytest.raises(ValueError):
        e.sql("PATTERN SEQ(A x, B y) FROM t USING SKIP_TILL_ANY_MATCH WHERE x.a3 < 1 WITHIN 9 RETURN COUNT(*)")
    assert "path 0" in e.explain("PATTERN SEQ(A x, B y) FROM t USING SKIP_TILL_ANY_MATCH WITHIN 9 RETURN COUNT(*)")


def test_sequence(spark):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("t"))
    assert [r.t for r in tables.with_sequence(df, ["t"]).orderBy("seq").collect()] == list(range(50))


def test_generated(spark, tmp_path):
    df = generate.events(spark, 3000)
    again = generate.events(spark, 3000, shuffle=64)
    assert df.drop("seq").exceptAll(again.drop("seq")).isEmpty() and again.filter("seq + 1747405414 != time").count() > 2000
    share = df.filter("type = 'TYPE_0'").count() / 3000
    assert abs(share - generate.zipf()[0]) < 0.04
    texts = generate.queries(5, within=60) + generate.by_length(1, 2, within=60)
    generate.save_queries(str(tmp_path / "q.json"), texts)
    assert generate.load_queries(str(tmp_path / "q.json")) == texts == json.loads((tmp_path / "q.json").read_text())
    a, b = Engine(spark), Engine(spark, prefilter="buckets")
    for e in (a, b):
        e.register("synthetic", df, "type", "time", "seq")
    assert same_counts(a.run_all(texts[:3]), b.run_all(texts[:3])) == []


def test_islands_of_many_levels(spark):
    """Spans of different lengths, gaps of any size, over stretches of several levels, against a plain pass."""
    rng = random.Random(9)
    spans, at = [], -70_000
    for _ in range(800):
        at += rng.choice((0, 1, 1, 2, 3, 7, 40, 900))
        spans.append((at, at + rng.randint(0, 3)))
    want: list[list[int]] = []
    for lo, hi in sorted(spans):
        if want and lo <= want[-1][1]:
            want[-1][1] = max(want[-1][1], hi)
        else:
            want.append([lo, hi])
    found = pruning.islands(spark.createDataFrame(spans, "lo long, hi long").repartition(5), 3)
    assert sorted(map(list, found.collect())) == want
    assert pruning.islands(spark.createDataFrame([], "lo long, hi long"), 3).count() == 0


def chain(rows, types, window, same=None):
    """The first event of each type after the one before, by plain search; same: an attribute that all share."""
    events = sorted(((r[5], i, r) for i, r in enumerate(rows)), key=lambda x: x[:2])
    out = []
    for ts, i, first in events:
        if first[0] != types[0]:
            continue
        found, at = [i], (ts, i)
        for t in types[1:]:
            later = next((e for e in events if e[:2] > at and e[2][0] == t and (same is None or e[2][same] == first[same])), None)
            if later is None or later[0] > ts + window:
                break
            found.append(later[1])
            at = later[:2]
        if len(found) == len(types):
            out.append(tuple(found))
    return sorted(out)


@pytest.mark.parametrize("splits", [1, 4, 0])
def test_sorted_pass_equals_search(spark, splits):
    """One type for several variables, ties, a key, and one bucket that holds most events."""
    rng = random.Random(splits)
    rows = [(rng.choice("AAB"), rng.randint(0, 2), 0, 0.0, 0.0, rng.choice((5, 6, 7, rng.randint(-30, 60)))) for _ in range(250)]
    for window in (0, 4, 25):
        for where, same in (("", None), ("WHERE a.a1 = b.a1 AND b.a1 = c.a1 AND c.a1 = d.a1", 1)):
            text = f"PATTERN SEQ(A a, B b, A c, A d) FROM t USING SKIP_TILL_NEXT_MATCH {where} WITHIN {window} units RETURN tuples"
            found = small(spark, rows, splits=splits).match(text)
            assert sorted((r.a__seq, r.b__seq, r.c__seq, r.d__seq) for r in found.collect()) == chain(rows, "ABAA", window, same)


def test_sorted_pass_joins_nothing(spark):
    plan = small(spark).explain("PATTERN SEQ(TYPE_1 a, TYPE_3 b, TYPE_0 c) FROM t USING SKIP_TILL_NEXT_MATCH WITHIN 9 units RETURN tuples")
    assert "Join" not in plan and "SinglePartition" not in plan
    plan = small(spark).explain("PATTERN SEQ(TYPE_1 a, TYPE_3 b) FROM t USING STRICT_CONTIGUOUS WITHIN 9 units RETURN tuples")
    assert "SinglePartition" not in plan


def test_strict_equals_search(spark):
    rng = random.Random(4)
    rows = [(rng.choice("AB"), rng.randint(0, 9), 0, 0.0, 0.0, rng.randint(-20, 40)) for _ in range(120)]
    events = sorted(((r[5], i, r) for i, r in enumerate(rows)), key=lambda x: x[:2])
    for window in (0, 2, 7):
        want = sorted((x[1], y[1], z[1]) for x, y, z in zip(events, events[1:], events[2:], strict=False) if (x[2][0], y[2][0], z[2][0]) == ("A", "B", "A") and z[0] <= x[0] + window and x[2][1] <= z[2][1])
        found = small(spark, rows).match(f"PATTERN SEQ(A a, B b, A c) FROM t USING STRICT_CONTIGUOUS WHERE a.a1 <= c.a1 WITHIN {window} units RETURN tuples")
        assert sorted((r.a__seq, r.b__seq, r.c__seq) for r in found.collect()) == want


def test_loops_and_negation_within_keys(spark):
    """The sequential matcher gives the answers of the joins, string keys and keys without matches among them."""
    rng = random.Random(14)
    rows = [(rng.choice("ABCN"), rng.randint(0, 2), rng.randint(0, 5), 0.0, 0.0, rng.randint(0, 80)) for _ in range(160)]
    e = small(spark, rows)
    keyed = e.tables["t"].events(["a1", "a2"]).withColumn("who", F.concat(F.lit("u"), "a1"))
    for shape, where in (("SEQ(A a, KP(N n), C c)", ""), ("SEQ(A a, B b, KS(N n), C c)", " AND n.a2 >= a.a2"), ("SEQ(A a, NEG(N n), C c)", " AND n.a2 > a.a2"), ("SEQ(A a, NEG(N n), B b, KP(N m), C c)", "")):
        for strategy in ("ANY", "NEXT"):
            names = [x for x in "abnmc" if f" {x})" in shape or f" {x}," in shape]
            key = " AND ".join(f"a.a1 = {x}.a1" for x in names[1:])
            q = parse(f"PATTERN {shape} FROM t USING SKIP_TILL_{strategy}_MATCH WHERE {key}{where} WITHIN 12 units RETURN tuples")
            want = e.match(q).drop("path")
            compares = tuple(c for c in q.compares if not c.equality)
            got = match_keyed(keyed, "who", q.paths[0], q.ranges, compares, 12, q.strategy).drop("who").select(*want.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (shape, strategy)
    none = match_keyed(keyed, "who", parse("PATTERN SEQ(X a, Y b) FROM t USING SKIP_TILL_ANY_MATCH WITHIN 1 units RETURN tuples").paths[0], (), (), 1)
    assert none.count() == 0


def test_windows_keep_one_window_of_events():
    path = parse("PATTERN SEQ(A a, KP(N n), C c) FROM t USING SKIP_TILL_NEXT_MATCH WITHIN 5 units RETURN tuples").paths[0]
    windows, most = Windows(path, (), (), 5, "next"), 0
    for i in range(2000):
        windows.feed({"_type": "ANC"[i % 3], "_ts": i, "_seq": i})
        most = max(most, len(windows.events))
    assert most <= 8


def test_prefilters_of_loops_and_negation(spark):
    rng = random.Random(15)
    rows = [(rng.choice("ABCN"), rng.randint(0, 9), 0, 0.0, 0.0, rng.randint(0, 400)) for _ in range(120)]
    for shape in ("SEQ(A a, NEG(N n), C c)", "SEQ(A a, KP(N n), C c)", "SEQ(A a, KS(N n), C c)"):
        text = f"PATTERN {shape} FROM t USING SKIP_TILL_ANY_MATCH WHERE a.a1 <= 4 WITHIN 9 units RETURN tuples"
        found = [sorted(map(str, small(spark, rows, prefilter=p).match(text).collect())) for p in (None, "buckets", "intervals")]
        assert found[0] and found[0] == found[1] == found[2]


def test_packed_codes(spark):
    rng = np.random.default_rng(2)
    for bits in (1, 7, 8, 14, 30, 59):
        x = rng.integers(0, 1 << bits, 700, dtype=np.uint64)
        assert (codecs.unvarint(codecs.varint(x)) == x).all() and (codecs.unsimple8b(codecs.simple8b(x)) == x).all()
    ones = np.ones(361, np.uint64)
    assert len(codecs.simple8b(ones)) == 24 and (codecs.unsimple8b(codecs.simple8b(ones)) == ones).all()
    top = np.array([0, codecs.LARGEST, 5], np.uint64)
    assert (codecs.unsimple8b(codecs.simple8b(top)) == top).all() and codecs.varint(np.array([300])) == bytes((0xAC, 2))
    with pytest.raises(ValueError):
        codecs.simple8b(np.array([codecs.LARGEST + 1], np.uint64))
    df = spark.createDataFrame([([5, 0, 1 << 40],), ([],), (None,)], "x array<bigint>")
    for pack, unpack in ((codecs.varint_pack, codecs.varint_unpack), (codecs.simple8b_pack, codecs.simple8b_unpack)):
        assert [r.y for r in df.select(unpack(pack(F.col("x"))).alias("y")).collect()] == [[5, 0, 1 << 40], [], None]


def test_rates_are_stored(spark, tmp_path):
    rates = statistics.arrival_rates(small(spark).tables["t"].events([]))
    statistics.save_rates(rates, str(tmp_path / "rates"))
    assert sorted(statistics.load_rates(spark, str(tmp_path / "rates")).collect()) == sorted(rates.collect())


def test_index_lays_out_what_is_written(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [("A" if i % 2 else "B", i * 37 % 1000, 0, 0.0, 0.0, i) for i in range(1000)]
    e = small(spark, rows)
    e.sql("CREATE INDEX i USING SCAN ON t (a1)")
    text = "PATTERN SEQ(A x, B y) FROM t USING SKIP_TILL_ANY_MATCH WHERE x.a1 <= 20 AND y.a1 >= 900 WITHIN 50 units RETURN tuples"
    before = sorted(map(str, e.match(text).collect()))
    e.write("t", str(tmp_path / "t"), partitions=8)
    assert before == sorted(map(str, e.match(text).collect()))
    hit = 0
    files = list((tmp_path / "t").glob("*.parquet"))
    for f in files:
        meta = pq.ParquetFile(f).metadata.row_group(0)
        at = {meta.column(i).path_in_schema: meta.column(i).statistics for i in range(meta.num_columns)}
        hit += at["a1"].min <= 20 and at["type"].min <= "A"
    assert hit < len(files) / 2
    assert "PushedFilters" in e.explain(text) and "LessThanOrEqual(a1,20" in e.explain(text).replace(".0", "")


def test_phases(spark):
    found = small(spark).phases("PATTERN SEQ(TYPE_1 v0, TYPE_3 v1, TYPE_0 v2) FROM t USING SKIP_TILL_NEXT_MATCH WITHIN 10 units RETURN tuples")
    assert found["matches"] == 2 and found["events"] and found["buckets"] and all(found[x] > 0 for x in ("filter", "scan", "match"))


def test_splits_follow_the_fullest_window(spark):
    rows = [("A", 0, 0, 0.0, 0.0, 3)] * 50 + [("A", 0, 0, 0.0, 0.0, 100 * i) for i in range(20)]
    e = small(spark, rows, splits=0)
    m = e.matcher("PATTERN SEQ(A x, A y) FROM t USING SKIP_TILL_ANY_MATCH WITHIN 10 units RETURN tuples")
    assert m.splits == 1 and e.splits_for(m, ["A"], 9) == 6


def test_csv_of_many_files_is_in_order(spark, tmp_path):
    e = Engine(spark)
    e.sql("CREATE TABLE c (type TYPE, a1 INT, time TIMESTAMP)")
    n = 0
    for f in range(5):
        lines = [f"A,{n + i},1" for i in range((5 - f) * 40)]
        n += len(lines)
        (tmp_path / f"part{f}.csv").write_text("type,a1,time\n" + "\n".join(lines) + "\n")
    rows = tables.read_csv(spark, str(tmp_path), e.schemas["c"]).orderBy("seq").collect()
    assert [r.a1 for r in rows] == list(range(n)) == [r.seq for r in rows]


# Counts of matches over the events of sf0.01.
GOLDEN = [
    ("SEQ(view a, click b)", "", "1 hour", 5536, 1862),
    ("SEQ(click a, view b)", "", "1 hour", 5471, 1861),
    ("AND(view a, click b)", "", "1 hour", 11007, 3723),
    ("SEQ(view a, view b)", "", "1 hour", 5500, 1861),
    ("SEQ(view a, click b, purchase c)", "", "1 hour", 7504, 1527),
    ("SEQ(view a, click b, purchase c)", "WHERE a.user_id = b.user_id AND b.user_id = c.user_id", "24 hours", 182, 141),
    ("SEQ(view a, click b, purchase c)", "WHERE a.value <= 30 AND b.value >= a.value * 1.003 AND c.value <= b.value * 0.997", "1 hour", 1674, 492),
    ("SEQ(view a, NEG(error n), click b)", "", "1 hour", None, 952),
    ("SEQ(view a, click b, KP(error n), purchase c)", "", "1 hour", None, 2222),
    ("SEQ(view a, click b, KS(error n), purchase c)", "", "1 hour", None, 3749),
]


@pytest.mark.parametrize("pattern, where, within, every, first", GOLDEN)
def test_golden_counts(spark, pattern, where, within, every, first):
    e = queries.engine(spark, "/root/testdata/sf0.01")
    for strategy, want in (("ANY", every), ("NEXT", first)):
        if want is not None:
            assert e.sql(f"PATTERN {pattern} FROM events USING SKIP_TILL_{strategy}_MATCH {where} WITHIN {within} RETURN COUNT(*)").first().matches == want


@pytest.mark.parametrize("shape", ["SEQ(T0 a, T1 b, {}(T1 n), T1 c, T0 d)", "SEQ(T1 a, {}(T1 n), T1 c, T2 d)"])
def test_random_loops(spark, shape):
    """Loops with plain variables around them, ties and repeated types: the answers of the sequential matcher."""
    rng = random.Random(5)
    rows = sorted(((f"T{rng.randint(0, 2)}", rng.randint(0, 9), 0, 0.0, 0.0, rng.randint(-20, 30)) for _ in range(70)), key=lambda r: r[-1])
    events = [{"_type": r[0], "a1": r[1], "_ts": r[5], "_seq": i} for i, r in enumerate(rows)]
    for loop, window in (("KP", 9), ("KS", 9), ("KS", 0)):
        q = parse(f"PATTERN {shape.format(loop)} FROM t USING SKIP_TILL_NEXT_MATCH WHERE a.a1 <= 7 AND n.a1 >= 2 WITHIN {window} units RETURN tuples")
        runs, want, names = Windows(q.paths[0], q.ranges, q.compares, window, q.strategy), [], [v.name for v in q.paths[0]]
        for m in [m for e in events for m in runs.feed(e)] + runs.rest():
            want.append([m[v] and m[v]["_seq"] for v in names] + [m["n#"]])
        for how in ({}, {"splits": 3}):
            got = [[r[f"{v}__seq"] for v in names] + [r.n__k] for r in small(spark, rows, **how).match(q).collect()]
            assert sorted(map(str, got)) == sorted(map(str, want)), (loop, window, how)


@pytest.mark.parametrize("name", ["kleene_plus_buckets", "kleene_plus", "kleene_star", "kleene_plus_intervals", "kleene_star_buckets", "kleene_star_intervals"])
def test_loop_matches_stay_as_written(spark, name):
    """Pairs of a loop are neither sorted nor dealt out nor grouped again: all that is shuffled or sorted is events."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join Inner")[0]
    assert "Join Inner" in plan and "Window" not in above and "Aggregate" not in above and "Sort" not in above


@pytest.mark.parametrize("name", ["kleene_star", "kleene_star_buckets", "kleene_star_intervals"])
def test_loop_events_are_shuffled_once(spark, name):
    """All that a star's matches are made of reads one shuffle of its events."""
    with sort_merge(spark):
        df = queries.QUERIES[name](spark, SF)
        df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("Exchange hashpartitioning(_of#" in x and "ReusedExchange" not in x for x in final.splitlines()) == 1, final


@pytest.mark.parametrize("prefilter", [None, "buckets", "intervals"])
@pytest.mark.parametrize("loop", ["KP", "KS"])
def test_loop_matches_stand_by_last_event(spark, loop, prefilter):
    """The matches that one event ends are written together: an event stands in two buckets at most."""
    rng = random.Random(11)
    rows = [(f"T{rng.randint(0, 3)}", 0, 0, 0.0, 0.0, rng.randint(0, 30)) for _ in range(160)]
    with sort_merge(spark):
        found = small(spark, rows, prefilter=prefilter).match(f"PATTERN SEQ(T0 a, T1 b, {loop}(T2 n), T3 c) FROM t USING SKIP_TILL_NEXT_MATCH WITHIN 20 units RETURN tuples").collect()
    last = [r.n__seq for r in found if r.n__k]
    assert len(last) > 10 * len(set(last)) and sum(a != b for a, b in zip(last, last[1:], strict=False)) < 2 * len(set(last))


@pytest.mark.parametrize("name", ["kleene_plus_buckets", "kleene_star_buckets", "kleene_plus_intervals", "kleene_star_intervals"])
def test_pruning_shuffles_no_events(spark, name):
    """Spans and buckets go to the events: shuffles by bucket are those of the matches, and of what prunes only sums."""
    with sort_merge(spark):
        df = queries.QUERIES[name](spark, SF)
        df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    joins = [x for x in final if "SortMergeJoin" in x]
    assert joins and all("_of#" in x for x in joins), final
    assert any("BroadcastHashJoin" in x and "LeftSemi" in x for x in final), final


def test_matches_of_few_events_keep_all_partitions(spark):
    """Under ANY the joins of a longer path run in every shuffle partition, however few events these hold, without a further shuffle."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        with sort_merge(spark):
            df = queries.QUERIES["seq3_any"](spark, SF)
            tasks = df.rdd.getNumPartitions()
            df.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert tasks == 7 and "AQEShuffleRead coalesced" not in final and final.count("Exchange hashpartitioning(_of#") == 3, final


def test_pruning_by_either_join(spark, monkeypatch):
    """The spans that are sent out are those of every point, and either join keeps the same."""
    rng = random.Random(23)
    points, others = (spark.createDataFrame([(rng.randint(-300, 300),) for _ in range(60)], "ts long") for _ in range(2))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for window in (0, 1, 4, 9):
        for side in (pruning.LEFT, pruning.RIGHT, pruning.MIDDLE):
            spans = pruning.islands(pruning.covered(points, window, side), 3 * window)
            assert rows(spans) == rows(pruning.islands(pruning.intervals(points, window, side), 2 * window))
            assert pruning.covered(points, window, side).filter(f"hi - lo > {3 * window}").count() == 0
        assert rows(pruning.keep_spans(spans, others, 2 * window, few=True)) == rows(pruning.keep_spans(spans, others, 2 * window))
        assert rows(pruning.keep_points(others, spans, 2 * window, few=True)) == rows(pruning.keep_points(others, spans, 2 * window))
    events = [(rng.choice("ABCN"), rng.randint(0, 9), 0, 0.0, 0.0, rng.randint(0, 400)) for _ in range(120)]
    text = "PATTERN SEQ(A a, KS(N n), C c) FROM t USING SKIP_TILL_NEXT_MATCH WHERE a.a1 <= 4 WITHIN 9 units RETURN tuples"
    for prefilter in ("buckets", "intervals"):
        found = []
        for most in (pruning.MOST_BROADCAST, 1):
            monkeypatch.setattr(pruning, "MOST_BROADCAST", most)
            found.append(rows(small(spark, events, prefilter=prefilter).match(text)))
        assert found[0] and found[0] == found[1] == rows(small(spark, events).match(text))


def test_counts_form_no_matches(spark):
    """Counts by sums: those of the matches themselves with ties, repeated types and either order, and no join."""
    rng = random.Random(3)
    e = small(spark, [(f"T{rng.randint(0, 2)}", rng.randint(0, 9), 0, 0.0, 0.0, rng.randint(-20, 30)) for _ in range(90)])
    for shape, window in (("SEQ(T0 a, T1 b, T0 c, T0 d)", 9), ("AND(T1 a, SEQ(T1 b, T2 c))", 7), ("SEQ(T0 a, OR(T1 b, T0 c))", 0), ("SEQ(T0 a)", 5), ("SEQ(T0 a, T9 b)", 5)):
        q = parse(f"PATTERN {shape} FROM t USING SKIP_TILL_ANY_MATCH WHERE a.a1 <= 7 WITHIN {window} units RETURN COUNT(*)")
        assert e.count(q).first().matches == e.match(q).count(), (shape, window)
    tied = "PATTERN SEQ(T0 a, T1 b) FROM t USING SKIP_TILL_ANY_MATCH WHERE b.a1 >= a.a1 WITHIN 9 units RETURN COUNT(*)"
    assert e.count(tied).first().matches == e.match(tied).count()
    assert "Join" not in queries.QUERIES["seq5_any_count"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_subtraction_forms_no_longer_matches(spark):
    """Subtraction as negation: what subtracting formed matches gives, and one join of pairs where there were three."""
    rng = random.Random(7)
    e = small(spark, [(f"T{rng.randint(0, 2)}", rng.randint(0, 9), 0, 0.0, 0.0, rng.randint(-20, 30)) for _ in range(80)])
    text = "PATTERN SEQ({}) FROM t USING SKIP_TILL_ANY_MATCH WHERE {} WITHIN 9 units RETURN tuples"
    for short, longer, a, b in (("T0 a, T1 c", "T0 a, T2 n, T1 c", "a.a1 <= 7", "a.a1 <= 7 AND n.a1 >= 5"), ("T0 a, T1 c", "T0 a, T1 n, T1 c", "a.a1 <= c.a1", "a.a1 <= c.a1"), ("T0 a, T0 c, T1 d", "T0 a, T0 n, T0 c, T1 d", "a.a1 <= d.a1", "a.a1 <= d.a1 AND n.a1 >= 8"), ("T0 a, T1 c", "T0 a, T2 n, T1 c", "a.a1 <= 7", "a.a1 <= 7 AND n.a1 >= a.a1")):
        short, longer = text.format(short, a), text.format(longer, b)
        rows = lambda df: sorted(map(str, df.select(*sorted(c for c in df.columns if c.endswith("__seq"))).collect()))
        assert rows(e.subtract(short, longer, "n")) == rows(matching.subtract(e.match(short), e.match(longer), "n")), longer
    assert queries.QUERIES["neg_subtract"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


@pytest.mark.parametrize("seed", range(3))
def test_listed_matches_equal_joined_ones(spark, monkeypatch, seed):
    """Variables that no comparison ties, last, between and beside tied ones, with ties of time, one type for several variables,
    a missing number or time, lists of three events and any number of buckets: the rows of the joins."""
    rng = random.Random(seed)
    rows = [(i if i % 17 else None, rng.choice(("A", "B", "B", None)), rng.randint(0, 9), rng.choice((None, 1, 2, rng.randint(-15, 25)))) for i in range(70)]
    df = spark.createDataFrame(rows, "seq long, type string, a1 int, time long")
    monkeypatch.setattr(matching, "LIST", 3)
    for shape, where in (("SEQ(A a, B b, B c)", "a.a1 <= 6"), ("SEQ(A a, AND(B b, A c), B d)", "d.a1 >= a.a1 AND b.a1 >= 3"), ("SEQ(B a, B b, A c, B d)", "b.a1 >= a.a1"), ("SEQ(A a, B b, B c)", "c.a1 >= b.a1")):
        text = f"PATTERN {shape} FROM t USING SKIP_TILL_ANY_MATCH WHERE {where} WITHIN {rng.choice((0, 3, 8))} units RETURN tuples"
        for how in rng.sample(({}, {"splits": 3}, {"prefilter": "buckets"}), 1):
            found = []
            for free in (matching.Matcher._free, lambda self, path: []):
                with monkeypatch.context() as m:
                    m.setattr(matching.Matcher, "_free", free)
                    e = Engine(spark, **how)
                    e.register("t", df, "type", "time", "seq")
                    found.append(sorted(map(str, e.match(text).collect())))
            assert found[0] == found[1], (text, how)


@pytest.mark.parametrize("name", ["seq3_any", "and_of_seq", "nested_p3", "bucket_prefilter", "interval_prefilter"])
def test_last_free_variable_rejects_no_event(spark, name):
    """The join that makes a match meets lists, not events; so it offers no event of a bucket that the match cannot hold."""
    with sort_merge(spark):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    last = plan.split("Join Inner")[0]
    assert "Generate explode" in last and "sequence(" in last and "Sort" not in last and "Window" not in last
