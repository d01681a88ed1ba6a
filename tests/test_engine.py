import random
from itertools import product

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.engine import Engine
from tidelog.functions import morton, vectors
from tidelog.model import EVENT, EntityId, EventId, Field, RecordSchema, TimeRange
from tidelog.operators import admit, branches, causal, evolve, index, knowledge, replay, runtime, scan, spans, transform
from tidelog.plans.compile import AnalysisError
from tidelog.plans.ir import Budget
from tidelog.sources.events import backup, backup_manifest, choose_encoding, columnar_export, media_reference, read_log, restore, retire, seal, verify_backup, verify_media, write_log
from tidelog.streaming import subscribe


def event(seq, slot=1, gen=1, ticks=None, schema=1, payload=b"x", causes=(), known=None, shard=0):
    t = seq if ticks is None else ticks
    return (1, 1, seq, shard, slot, gen, schema, 1, t, None, None, 1, t if known is None else known, payload, [(1, 1, c) for c in causes])


def log(spark, rows):
    return spark.createDataFrame(rows, EVENT)


@pytest.fixture(scope="module")
def two(spark):
    """Ten events, alternating between two entities; valid = known = 10 + i."""
    return log(spark, [event(i, 1 + i % 2, ticks=10 + i, payload=bytes([i, 0xAA])) for i in range(10)])


def ids(df, c="sequence"):
    return [r[c] for r in df.collect()]


def test_entity_and_time(spark, two):
    e = Engine(spark, two)
    assert [r["valid_time"] for r in e.query("ENTITY 0:1:1\nTIME valid 10..16").rows.collect()] == [10, 12, 14]
    r = e.query("ENTITY 0:1:1\nTIME valid 10..16", Budget(rows=2))
    assert r.rows.count() == 2 and r.truncated
    assert not e.query("ENTITY 0:1:1\nTIME valid 10..16\nLIMIT 3").truncated


def test_limit_after_filter_and_compat(spark, two):
    e = Engine(spark, two)
    q = "WHERE sequence > 6\nLIMIT 2"
    assert ids(e.query(q).rows) == [7, 8]
    assert ids(e.query(q, compat=True).rows) == []
    assert e.query("LIMIT 0").rows.count() == 0 and e.query("LIMIT 0", compat=True).rows.count() == 1


def test_types_and_names_are_checked(spark, two):
    e = Engine(spark, two)
    for bad in ("WHERE nope = 1", "SELECT nope FROM t", "WHERE entity < 'a'", "WHERE sequence > 1.5", "WHERE NOT sequence", "WHERE sequence"):
        with pytest.raises(AnalysisError):
            e.query(bad)
    assert e.query("WHERE sequence = 'x'").rows.count() == 0 and e.query("WHERE sequence != 'x'").rows.count() == 10
    assert e.query("SELECT sequence, nope FROM t", compat=True).rows.columns == ["sequence"]


def test_empty_and_reversed_ranges(spark, two):
    e = Engine(spark, two)
    assert e.query("TIME valid 12..12").rows.count() == 0
    with pytest.raises(ValueError):
        e.query("TIME valid 13..12")
    with pytest.raises(ValueError):
        Engine(spark, two, clock=2).query("KNOWN_AS_OF 12")


def test_pages_equal_the_whole(spark, two):
    flt, got, cursor = scan.HistoryFilter(EntityId(0, 2, 1)), [], None
    while True:
        page = scan.page(two, flt, 2, cursor)
        got += ids(page.rows)
        cursor = page.cursor
        if cursor is None:
            break
    assert got == [1, 3, 5, 7, 9]
    first = scan.page(two, flt, 2)
    with pytest.raises(scan.CursorError):
        scan.page(two, scan.HistoryFilter(), 2, first.cursor)
    later = two.unionByName(log(spark, [event(11, 2)]))
    assert ids(scan.page(later, flt, 50, first.cursor).rows) == [5, 7, 9]


def test_page_budgets_and_foreign_cursors(spark, two):
    flt = scan.HistoryFilter(EntityId(0, 2, 1))
    size = two.select(scan.event_bytes(two).alias("b")).first()["b"]
    first = scan.page(two, flt, 10, max_bytes=2 * size)
    assert ids(first.rows) == [1, 3] and first.bytes == 2 * size and first.cursor.next == 5
    with pytest.raises(scan.BudgetError):
        scan.page(two, flt, 10, max_bytes=size - 1)
    got, cursor, pages = [], None, 0
    while True:
        page = scan.page(two, flt, 10, cursor, max_scanned=1)
        got, cursor, pages = got + ids(page.rows), page.cursor, pages + 1
        assert page.scanned <= 1
        if cursor is None:
            break
    assert got == [1, 3, 5, 7, 9] and pages == 10
    other = two.withColumn("epoch", F.lit(2).cast("long"))
    with pytest.raises(scan.CursorError):
        scan.page(other, flt, 10, first.cursor)
    assert ids(scan.page(two, flt, 2, scan.cursor_from(4, 10, flt)).rows) == [5, 7]


def test_point_get(two):
    assert scan.get(two, EventId(1, 1, 3))["slot"] == 2
    with pytest.raises(scan.NotFoundError):
        scan.get(two, EventId(1, 1, 99))


def test_admission(spark, two):
    ok = log(spark, [event(10, ticks=19), event(11, ticks=25)])
    assert admit.admit(ok, 10, (1, 19)).count() == 2
    cases = [[], [event(11, ticks=30)], [event(10, ticks=30), event(12, ticks=30)], [event(10, ticks=18)], [event(10, ticks=30), event(11, ticks=29)], [event(10, ticks=30, causes=[10])], [event(10, ticks=30, payload=bytes(admit.MAX_PAYLOAD + 1))], [event(10, ticks=30, causes=range(65))]]
    for rows in cases:
        with pytest.raises(admit.AdmissionError):
            admit.admit(log(spark, rows), 10, (1, 19))
    late = log(spark, [event(10, ticks=1, known=30)])
    assert admit.admit(late, 10, (1, 19)).count() == 1 and admit.late_evidence(late).count() == 1
    e = Engine(spark, two)
    e.append(ok)
    assert e.events.count() == 12
    assert ids(admit.assign_sequences(ok, 40, "known_ticks")) == [40, 41]


def test_regressions_across_spans(spark):
    df = log(spark, [event(i, ticks=t) for i, t in enumerate([5, 6, 4, 7, 3, 9])])
    for span in (2, 3, 100):
        assert sorted(ids(admit.regressions(df, span))) == [2, 4]


def test_stored_log_seal_backup_and_subscription(spark, two, tmp_path):
    path = str(tmp_path / "log")
    write_log(two, path, 4)
    e = Engine(spark, spark.read.parquet(path), path)
    assert e.history().count() == 10
    manifest = seal(spark, path, str(tmp_path / "sealed"), 5)
    assert sorted((r["first"], r["last"]) for r in manifest.collect()) == [(0, 4), (5, 9)]
    saved = backup_manifest(spark, path)
    assert saved.count() == 3 and verify_backup(saved, saved).count() == 0
    assert [r["problem"] for r in verify_backup(saved, saved.withColumn("crc32", F.lit(0))).collect()] == ["differs"] * 3
    assert {r["problem"] for r in verify_backup(saved, saved.limit(1)).collect()} == {"missing"}
    seen = []
    run = e.subscribe("ENTITY 0:1:1", lambda df, n: seen.extend((r["sequence"], r["is_live"]) for r in df.collect()), str(tmp_path / "cp"), from_sequence=2, once=True)
    run.awaitTermination()
    assert sorted(seen) == [(2, False), (4, False), (6, False), (8, False)]
    write_log(log(spark, [event(10, 1), event(11, 2)]), path, 4)
    stream = subscribe.subscription(subscribe.stream_log(spark, path, e.events.schema), "ENTITY 0:1:1", 2, snapshot_end=10)
    run = subscribe.deliver(stream, lambda df, n: seen.extend((r["sequence"], r["is_live"]) for r in df.collect()), str(tmp_path / "cp"), once=True)
    run.awaitTermination()
    assert sorted(seen)[-1] == (10, True) and len(seen) == 5


def test_seal_retire_backup_and_restore(spark, two, tmp_path):
    path, sealed = str(tmp_path / "log"), str(tmp_path / "sealed")
    write_log(two, path, 4)  # buckets 0-3, 4-7 and 8-9, which is not complete
    manifest = seal(spark, path, sealed, 4)
    assert sorted((r["seq_bucket"], r["first"], r["last"]) for r in manifest.collect()) == [(0, 0, 3), (1, 4, 7)]
    files = sorted(p.name for p in (tmp_path / "sealed").rglob("*.parquet"))
    write_log(log(spark, [event(10), event(11)]), path, 4)
    assert seal(spark, path, sealed, 4).count() == 3 and seal(spark, path, sealed, 4).count() == 3
    assert set(files) < {p.name for p in (tmp_path / "sealed").rglob("*.parquet")}  # segments are never rewritten
    assert backup(spark, path, str(tmp_path / "copy")).count() >= 3
    assert retire(spark, path, seal(spark, path, sealed, 4), [(5, 5)]) == [0]
    assert spark.read.parquet(path).agg(F.min("sequence")).first()[0] == 4
    back = restore(spark, str(tmp_path / "copy"), str(tmp_path / "back"))
    assert back.count() == 12
    with pytest.raises(FileExistsError):
        restore(spark, str(tmp_path / "copy"), str(tmp_path / "back"))
    victim = next((tmp_path / "copy").rglob("*.parquet"))
    victim.write_bytes(victim.read_bytes()[:-1] + b"?")
    (victim.parent / f".{victim.name}.crc").unlink()  # the local file system's own checksum
    with pytest.raises(OSError, match="differs"):
        restore(spark, str(tmp_path / "copy"), str(tmp_path / "again"))


def test_subscriptions_project_and_refuse_limits(spark, two, tmp_path):
    path = str(tmp_path / "log")
    write_log(two, path, 4)
    e = Engine(spark, spark.read.parquet(path), path)
    seen = []
    e.subscribe("SELECT entity, known_time FROM log WHERE sequence >= 8", lambda df, n: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted(seen) == [(8, "0:1:1", 18, False), (9, "0:2:1", 19, False)]
    with pytest.raises(ValueError):
        e.subscribe("LIMIT 3", print, str(tmp_path / "cp2"), once=True)
    late = []
    e.subscribe("ENTITY 0:1:1", lambda df, n: late.extend(r["sequence"] for r in df.collect()), str(tmp_path / "cp3"), once=True, from_now=True).awaitTermination()
    assert late == []


def test_two_writers_of_one_log(spark, two, tmp_path):
    path = str(tmp_path / "log")
    write_log(two, path)
    first, second = (Engine(spark, spark.read.parquet(path), path) for _ in range(2))
    first.append(log(spark, [event(10, ticks=30)]))
    with pytest.raises(admit.AdmissionError, match="another writer"):
        second.append(log(spark, [event(10, ticks=31)]))
    again = Engine(spark, spark.read.parquet(path), path)
    again.append(log(spark, [event(11, ticks=31)]))
    assert sorted(ids(again.events)) == list(range(12))
    with pytest.raises(admit.AdmissionError):
        again.append(log(spark, [event(15, ticks=40)]))
    again.append(log(spark, [event(12, ticks=40)]))
    assert again.events.count() == 13


def test_media_references(spark):
    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four")], "id long, body string")
    refs = media_reference(rows, F.concat(F.lit("m/"), F.col("id").cast("string")), "body").select("uri", "content_hash", "byte_size")
    now = spark.createDataFrame([("m/1", "one"), ("m/2", "2wo"), ("m/3", "thre")], "uri string, content string")
    assert {r["uri"]: r["problem"] for r in verify_media(refs, now).collect()} == {"m/2": "hash differs", "m/3": "size differs", "m/4": "missing"}


def test_spans(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)] + [(7, 0)], "v long, k long")
    got = spans.numbered(df, F.expr("v div 10"), [F.col("v")], "at", ["k"])
    for k in range(3):
        own = sorted((r["at"], r["v"]) for r in got.where(F.col("k") == k).collect())
        assert [a for a, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    values = sorted(r["v"] for r in df.collect())
    for n in (1, 9, 50, 102):
        low, below = spans.nth_smallest(df, "v", n)
        assert low == values[n - 1] and below == sum(v < low for v in values)
    with pytest.raises(ValueError):
        spans.nth_smallest(df, "v", 103)
    points = spark.createDataFrame([(5, 90), (20, 30), (60, 61), (None, 99)], "first long, last long")
    targets = spark.createDataFrame([(4, "a"), (5, "b"), (25, "c"), (25, "c"), (99, "d"), (None, "e")], "sequence long, what string")
    found = spans.carried(targets, "sequence", points, "first", F.col("last"), "until", 10)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(4, "a", None), (5, "b", 90), (25, "c", 90), (25, "c", 90), (99, "d", 90), (None, "e", None)], key=str)


def test_handles_run_out(spark):
    df = spark.createDataFrame([(0, 1, 3), (0, 2, 5), (0, 1, 2)], "shard long, slot long, generation long")
    assert {r["slot"]: (r["generation"], r["retired"]) for r in replay.next_handles(df, 5).collect()} == {1: (4, False), 2: (None, True)}


def test_generic_reducer_keeps_only_the_state(spark):
    """Histories longer than a batch, in order, and entities that end without a state."""
    df = log(spark, [event(i, 1 + i % 3) for i in range(300)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    step = lambda s, e: None if e["slot"] == 3 else {"seen": [*(s or {"seen": []})["seen"], int(e["sequence"])]}
    try:
        got = {r["slot"]: r["seen"] for r in replay.reduce_entities(df, step, ["schema_id"], "seen array<long>").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: list(range(0, 300, 3)), 2: list(range(1, 300, 3))}


def test_typed_replay(spark):
    upsert = lambda i, slot, f: (0, slot, 0, i, 1, "upsert", f)
    rows = [upsert(i, i % 2, {"health": str(100 * i if i % 2 == 0 else 200 * i), "active": str(i % 2 == 0 or i > 5).lower()}) for i in range(10)]
    schema = "shard long, slot long, generation long, sequence long, schema_id long, op string, fields map<string,string>"
    state = {(r["slot"], r["field"]): r["value"] for r in replay.schema_state(spark.createDataFrame(rows, schema)).collect()}
    assert state == {(0, "health"): "800", (0, "active"): "true", (1, "health"): "1800", (1, "active"): "true"}
    rows += [(0, 0, 0, 10, 1, "delete", {}), (0, 0, 0, 11, 7, "upsert", {"health": None})]
    out = replay.schema_state(spark.createDataFrame(rows, schema))
    left = {(r["slot"], r["field"]): (r["value"], r["schema_id"], r["is_null"]) for r in out.collect()}
    assert left[(0, "health")] == (None, 7, True) and (0, "active") not in left
    assert [r["slot"] for r in replay.incomplete(out, ["health", "active"]).collect()] == [0]


def test_checkpoint_equals_full_replay(spark, two):
    value = F.hex("payload")
    full = replay.raw_state(two, 9, value)
    resumed = replay.state_from_checkpoint(replay.raw_state(two, 4, value), 4, two, 9, value)
    assert sorted(map(str, full.collect())) == sorted(map(str, resumed.collect()))
    assert replay.latest_checkpoint([2, 5, 8], 7) == 5 and replay.latest_checkpoint([5], 4) is None
    with pytest.raises(replay.ReplayError):
        replay.check_target(two, 10)
    with pytest.raises(replay.ReplayError):
        replay.check_target(two.where("sequence <> 3"), 9)


def test_saved_snapshots(spark, two, tmp_path):
    path, value = str(tmp_path / "cp"), F.hex("payload")
    for at in (3, 6):
        replay.snapshot(replay.raw_state(two, at, value), path, at)
    at, state = replay.load_snapshot(spark, path, 8)
    resumed = replay.state_from_checkpoint(state, at, two, 8, value)
    assert at == 6 and sorted(map(str, resumed.collect())) == sorted(map(str, replay.raw_state(two, 8, value).collect()))
    with pytest.raises(replay.ReplayError):
        replay.load_snapshot(spark, path, 2)


def test_checkpoints_as_of_crosses_spans(spark):
    targets = spark.createDataFrame([(t,) for t in (1, 5, 999_999, 1_000_000, 3_500_000)], "target long")
    found = replay.checkpoints_as_of(targets, spark.createDataFrame([(5,), (900_000,), (3_500_000,)], "checkpoint long"))
    assert {r["target"]: r["checkpoint"] for r in found.collect()} == {1: None, 5: 5, 999_999: 900_000, 1_000_000: 900_000, 3_500_000: 3_500_000}


def test_stale_handles(spark):
    df = log(spark, [event(0, 1, gen=1), event(1, 1, gen=2)])
    handles = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (0, 9, 1)], "shard long, slot long, generation long")
    assert sorted(r["status"] for r in replay.resolve_handles(df, handles).collect()) == ["current", "stale", "unknown"]


def test_filters_reach_the_scan(spark, two, tmp_path):
    path = str(tmp_path / "log")
    write_log(two, path)
    rows = Engine(spark, spark.read.parquet(path), path).query("SELECT sequence FROM t WHERE entity = '0:1:1' AND valid_time >= 10 AND valid_time < 16 AND known_as_of = 15").rows
    execution = rows._jdf.queryExecution()
    plan = execution.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for part in ("EqualTo(slot,1)", "GreaterThanOrEqual(valid_ticks,10)", "LessThan(valid_ticks,16)", "LessThanOrEqual(known_ticks,15)"):
        assert part in plan
    assert "payload" not in plan.split("ReadSchema")[1]


def test_generator_resumes(spark):
    g = replay.SplitMix(42)
    first = [g.uniform() for _ in range(5)]
    h = replay.SplitMix.load((42, *replay.SplitMix(42).save()[1:]))
    assert [h.uniform() for _ in range(5)] == first
    assert [r["value"] for r in replay.random_stream(spark, 42, 5).orderBy("step").collect()] == first


def test_long_chains(spark, monkeypatch):
    """Ancestry and provenance have no depth limit; a wide walk goes on as a table."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "cause long, effect long").persist()
    assert causal.is_ancestor(chain, 0, 60) and not causal.is_ancestor(chain, 60, 0)
    monkeypatch.setattr(causal, "FRONTIER_LIMIT", 3)
    assert causal.is_ancestor(chain.where("effect <= 8"), 0, 8) and not causal.is_ancestor(chain.where("effect <= 8"), 77, 8)


def test_diamond(spark, monkeypatch):
    graph = causal.edges(log(spark, [event(10), event(20, causes=[10]), event(30, causes=[10, 10]), event(40, causes=[20, 30])]))
    assert graph.count() == 4
    depth = {r["node"]: r["depth"] for r in causal.trace(graph, 40).collect()}
    assert depth == {40: 0, 20: 1, 30: 1, 10: 2}
    assert {r["node"] for r in causal.trace(graph, 40, depth=1).collect()} == {40, 20, 30}
    assert causal.is_ancestor(graph, 10, 40) and not causal.is_ancestor(graph, 20, 30) and causal.is_ancestor(graph, 20, 20)
    nodes = spark.createDataFrame([(x,) for x in (10, 20, 30, 40)], "node long")
    assert {r["node"]: r["level"] for r in causal.topological_levels(graph, nodes).collect()} == {10: 0, 20: 1, 30: 1, 40: 2}
    loop = graph.unionByName(spark.createDataFrame([(40, 10)], "cause long, effect long"))
    for limit in (100_000, 0):  # peeled by the driver, and by joins
        monkeypatch.setattr(causal, "FRONTIER_LIMIT", limit)
        with pytest.raises(causal.CycleError):
            causal.topological_levels(loop, nodes)
        got = causal.topological_levels(graph, nodes.union(spark.createDataFrame([(99,)], "node long")))
        assert {r["node"]: r["level"] for r in got.collect()} == {10: 0, 20: 1, 30: 1, 40: 2, 99: 0}
    monkeypatch.setattr(causal, "FRONTIER_LIMIT", 100_000)
    assert [r["node"] for r in causal.topological_order(graph, nodes, 15).orderBy("place").collect()] == [10, 20, 30, 40]
    more = spark.createDataFrame([(40, 50), (10, 50), (40, 50)], "cause long, effect long")
    assert causal.add_edges(graph, more).count() == 6
    with pytest.raises(causal.CycleError):
        causal.add_edges(graph, spark.createDataFrame([(40, 50), (50, 20)], "cause long, effect long"))
    assert [(r["effect"], r["start"]) for r in causal.csr(graph, 15).orderBy("effect").collect()] == [(20, 0), (30, 1), (40, 2)]
    assert {r["effect"]: r["causes"] for r in causal.csr(graph).collect()}[40] == [20, 30]
    wide = causal._wide_trace(graph, spark.createDataFrame([(40, 0)], "node long, depth int"), "effect", "cause", 0, 9)
    assert {r["node"]: r["depth"] for r in wide.collect()} == depth


def test_trace_through_engine(spark):
    e = Engine(spark, log(spark, [event(0), event(1, causes=[0]), event(2, causes=[1]), event(3, causes=[2])]))
    assert ids(e.query("tn:$1:1:3<-2").rows, "node") == [3, 2, 1] and ids(e.query("EVENT 1:1:0 TRACE EFFECTS DEPTH 2 LIMIT 2").rows, "node") == [0, 1]


def test_action_trace(spark):
    k = causal.KINDS
    rows = [event(0, schema=k["percept"]), event(1, schema=k["belief"], causes=[0]), event(2, schema=k["action"], causes=[1]), event(3, schema=k["outcome"], causes=[2])]
    out = causal.action_trace(log(spark, rows), causal.edges(log(spark, rows)), 2)
    assert sorted(r["kind"] for r in out.collect()) == ["action", "belief", "gap: intention selection", "outcome", "percept"]
    rows[0] = event(0, schema=k["percept"], known=99)
    with pytest.raises(causal.LeakageError):
        causal.action_trace(log(spark, rows), causal.edges(log(spark, rows)), 2)
    with pytest.raises(LookupError):
        causal.action_trace(log(spark, rows), causal.edges(log(spark, rows)), 1)


def test_branches(spark):
    known = branches.fork(branches.open_branches(spark), "b1", 0, 2, 5)
    known = branches.fork(known, "b2", 1, 2, 5)
    line = lambda b, **o: [(r["branch"], r["first"], r["last"]) for r in branches.timeline(known, b, **o).collect()]
    assert line(1) == [(0, 0, 2), (1, 3, None)]
    assert line(2) == [(0, 0, 2), (2, 3, None)] and line(2, compat=True) == [(0, 0, 2), (1, 3, 2), (2, 3, None)]
    rows = spark.createDataFrame([(0, s) for s in range(5)] + [(1, 3), (2, 3), (2, 4)], "branch long, sequence long")
    assert sorted(map(tuple, branches.branch_events(rows, branches.timeline(known, 2)).collect())) == [(0, 0), (0, 1), (0, 2), (2, 3), (2, 4)]
    with pytest.raises(branches.BranchError):
        branches.fork(known, "x", 0, 5, 5)
    retired = branches.set_lifecycle(known, 1, "retired")
    with pytest.raises(branches.BranchError):
        branches.fork(retired, "x", 1, 3, 5)
    with pytest.raises(branches.BranchError):
        branches.check_append(retired, 1)
    more = spark.createDataFrame([(30, "b"), (20, "a")], "known_ticks long, what string")
    grown = branches.append(rows, known, 2, more, "known_ticks")
    assert sorted((r["sequence"], r["what"]) for r in grown.where("branch = 2 and what is not null").collect()) == [(5, "a"), (6, "b")]
    fresh = branches.append(rows.where("branch <> 1"), known, 1, more, "known_ticks")
    assert sorted(r["sequence"] for r in fresh.where("branch = 1").collect()) == [3, 4]
    with pytest.raises(branches.BranchError):
        branches.append(rows, retired, 1, more, "known_ticks")
    assert sorted(map(tuple, runtime.branch_holds(known).collect())) == [(0, 0, 2)]
    deeper = branches.fork(known, "b3", 1, 4, 9)
    assert sorted(map(tuple, runtime.branch_holds(deeper).collect())) == [(0, 0, 2), (1, 3, 4)]
    assert runtime.branch_holds(branches.set_lifecycle(retired, 2, "retired")).count() == 0


def test_block_pruning(spark):
    df = log(spark, [event(i, 10 * i, ticks=100 * i) for i in range(100)])
    blocks = index.block_summaries(df, F.col("sequence"), bloom=True)
    flt = scan.HistoryFilter(EntityId(0, 500, 1))
    assert blocks.where(index.must_scan(flt, True)).count() == 1
    assert ids(index.pruned_history(df, F.col("sequence"), blocks, flt)) == [50]
    known = scan.HistoryFilter(range=TimeRange(1000, 1300), known_as_of=1100)
    assert sorted(ids(index.pruned_history(df, F.col("sequence"), blocks, known))) == [10, 11]
    assert index.segment_summaries(blocks, F.expr("block div 10")).count() == 10


def test_projections(spark):
    rows = [(0, 1, 1, 100, 5, 5), (1, 1, 2, 110, 15, 15), (2, 2, 1, 120, 5, 5), (3, 2, 1, 130, 25, 25)]
    df = spark.createDataFrame(rows, "sequence long, slot long, schema_id long, valid_ticks long, x long, y long").withColumns({"shard": F.lit(0), "generation": F.lit(1), "valid_clock": F.lit(1)})
    e1, e2, box = EntityId(0, 1, 1), EntityId(0, 2, 1), ((0, 0), (10, 10))
    got = lambda **o: sorted(ids(index.intersect(df, size=10, **o)))
    assert got() == [] and got(entity=e1) == [0, 1] and got(entity=e1, schema=1) == [0] and got(schema=1) == [0, 2, 3]
    assert got(schema=1, times=TimeRange(100, 120)) == [0, 2] and got(schema=1, box=box) == [0, 2] and got(entity=e2, box=box) == [2] and got(entity=e1, schema=99) == []


def test_boxes(spark):
    r = random.Random(4)
    for axes in (2, 3):
        for _ in range(30):
            low = [r.randrange(0, 90) for _ in range(axes)]
            high = [a + r.randrange(0, 60) for a in low]
            cells = sorted(morton.code_of(c) for c in product(*(range(a // 8, b // 8 + 1) for a, b in zip(low, high))))
            found = morton.box_intervals(low, high, 8)
            assert [c for a, b in found for c in range(a, b + 1)] == cells and all(x[1] + 1 < y[0] for x, y in zip(found, found[1:]))
    assert morton.box_intervals((0, 0), ((1 << 30) - 1, (1 << 30) - 1), 16) == [(0, (1 << 52) - 1)]
    df = spark.createDataFrame([((1 << 60) + 1,), ((1 << 60) - 1,), (17,)], "x long").select(morton.chunk(F.col("x"), 2).alias("c"))
    assert [r["c"] for r in df.collect()] == [1 << 59, (1 << 59) - 1, 8]
    boxes = spark.createDataFrame([(0, 0, 5, 5), (6, 0, 9, 9), (5, 5, 6, 6)], "a long, b long, c long, d long")
    hit = morton.intersects([F.col("a"), F.col("b")], [F.col("c"), F.col("d")], [4, 4], [5, 5])
    assert boxes.where(hit).count() == 2
    e = Engine(spark, spark.createDataFrame([(i, i, i) for i in range(40)], "sequence long, x long, y long"))
    got = e.query("BOX 0,0..20,20 CHUNK 8 LIMIT 5")
    assert ids(got.rows) == [0, 1, 2, 3, 4] and got.truncated and e.query("BOX 0,0..20,20 CHUNK 8").rows.count() == 24


def test_morton(spark):
    points = [(0, 0), (1, 0), (3, 5), (2**31 - 1, 12345), (65535, 65536)]
    df = spark.createDataFrame(points, "x long, y long").withColumn("c", morton.encode2(F.col("x"), F.col("y")))
    x, y = morton.decode2(F.col("c"))
    for r in df.select("x", "y", "c", x.alias("a"), y.alias("b")).collect():
        assert (r["x"], r["y"]) == (r["a"], r["b"]) and r["c"] == morton.code_of((r["x"], r["y"]))
    assert morton.box_intervals((0, 0), (1, 1), 1) == [(0, 3)] and morton.box_intervals((0, 0), (31, 15), 16) == [(0, 1)] and morton.box_intervals((2, 0), (1, 0), 1) == []
    with pytest.raises(ValueError):
        morton.chunk(F.col("x"), 0)


def test_shards(spark):
    df = log(spark, [event(0, ticks=100, shard=0), event(1, ticks=90, shard=1), event(2, ticks=120, schema=2, shard=0), event(3, ticks=110, shard=1)])
    merged = runtime.fan_out(runtime.route(df, 2), runtime.shard_filter(schema=1))
    assert [r["valid_ticks"] for r in merged.collect()] == [90, 100, 110]
    local = runtime.partition_sequences(runtime.route(df, 2), span=2)
    assert sorted((r["vshard"], r["local_sequence"]) for r in local.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert df.where(runtime.shard_filter(low=105)).count() == 4 and df.where(runtime.shard_filter(clock=1, low=105, high=110)).count() == 1


def test_tasks_and_pressure(spark):
    with pytest.raises(LookupError):
        runtime.check_tasks(spark.createDataFrame([(2, 0, "pending")], "id long, class int, status string"), spark.createDataFrame([(2, 9)], "id long, needs long"))
    loop = spark.createDataFrame([(1, 2), (2, 1)], "id long, needs long")
    with pytest.raises(causal.CycleError):
        runtime.check_tasks(spark.createDataFrame([(1, 0, "pending"), (2, 0, "pending")], "id long, class int, status string"), loop)
    tasks = spark.createDataFrame([(1, 4, "completed"), (2, 0, "pending"), (3, 3, "pending"), (4, 4, "pending")], "id long, class int, status string")
    deps = spark.createDataFrame([(2, 1), (4, 3)], "id long, needs long")
    assert ids(runtime.ready_tasks(tasks, deps), "id") == [3, 2]
    assert runtime.missing_dependencies(tasks, spark.createDataFrame([(2, 9)], "id long, needs long")).count() == 1
    levels = spark.createDataFrame([(d,) for d in (0, 39, 40, 70, 90)], "d long").select(runtime.pressure(F.col("d"), F.lit(100)).alias("l"))
    assert ids(levels, "l") == ["normal", "normal", "moderate", "high", "critical"]


def one_by_one(segments, hot, warm):
    """Reference demotion, a step at a time."""
    tiers = {s: ("warm" if t == "cold" and a >= 2 else t) for s, _, t, a, _ in segments}
    info = {s: (b, last) for s, b, _, _, last in segments}
    for tier, cap, down in (("hot", hot, "warm"), ("warm", warm, "cold")):
        while sum(info[s][0] for s, t in tiers.items() if t == tier) > cap:
            tiers[min((s for s, t in tiers.items() if t == tier), key=lambda s: (info[s][1], s))] = down
    return tiers


def test_tiers(spark):
    segments = [(i, 10 + i % 3, ("hot", "warm", "cold")[i % 3], i % 4, (i * 7) % 23) for i in range(20)]
    df = spark.createDataFrame(segments, "segment_id long, bytes long, tier string, accesses int, last_access long")
    for caps in ((35, 60), (0, 0), (1000, 1000)):
        placed = {r["segment_id"]: r["placed"] for r in runtime.place_tiers(df, *caps).collect()}
        assert placed == one_by_one(segments, *caps)


def test_retention(spark, two):
    assert sorted(ids(runtime.reclaimable(two, 20, max_age=5, max_events=8, holds=[(1, 2)]))) == [0, 3, 4]
    gappy = two.where("sequence <> 0")
    assert sorted(ids(runtime.reclaimable(gappy, 0, max_events=7))) == [1, 2]
    frames = spark.createDataFrame([(0, 0, 1, True), (1, 2, 3, True), (2, 4, 5, True)], "frame long, first long, last long, sealed boolean")
    assert ids(runtime.retired_prefix(frames, [(3, 3)]), "frame") == [0] and sorted(ids(runtime.retired_prefix(frames), "frame")) == [0, 1, 2]
    assert sorted(ids(runtime.held(two, spark.createDataFrame([(2, 3), (9, 9)], "first long, last long")))) == [2, 3, 9]


def brute_status(beliefs):
    def norm(p):
        return p.strip().lower()

    def clash(a, b):
        return b == f"not {a}" or a == f"not {b}" or any((x in a and y in b) or (y in a and x in b) for x, y in knowledge.ANTONYMS)

    status, pairs = {}, set()
    for i, p in beliefs:
        hit = [j for j, q in beliefs if j < i and clash(norm(q), norm(p))]
        pairs |= {(j, i) for j in hit}
        active = [j for j in hit if status[j] == "active"]
        status[i] = "contradicted" if active else "active"
        status |= dict.fromkeys(active, "contradicted")
    return status, pairs


def test_contradictions_and_inference(spark):
    words = ["Alive", "dead", "not dead", "door open ", "closed", "open", "calm", "not calm", "calm", "inactive", "true", "false", "not  calm", "critical", "healthy"]
    beliefs = [(i, words[(i * 7) % len(words)]) for i in range(40)]
    df = spark.createDataFrame(beliefs, "id long, proposition string")
    status, pairs = brute_status(beliefs)
    own = {(i, j) for i, j in pairs}
    assert {tuple(r) for r in knowledge.contradictions(df).collect()} == own
    assert {r["id"]: r["status"] for r in knowledge.infer(df).select("id", "status").collect()} == status


def test_inference_along_long_chains(spark):
    """Every belief challenged by the next one: settled by doubling, not level by level."""
    beliefs = [(i, "alive" if i % 2 else "dead") for i in range(150)] + [(200 + i, ("not " if i % 3 == 0 else "") + f"calm {i // 7}") for i in range(120)]
    df = spark.createDataFrame(beliefs, "id long, proposition string")
    status, pairs = brute_status(beliefs)
    assert {r["id"]: r["status"] for r in knowledge.infer(df).select("id", "status").collect()} == status
    first = {}
    for i, j in sorted(pairs, reverse=True):
        first[i] = min(j, first.get(i, j))
    for span in (1_000_000, 16):
        assert {r["id"]: r["by"] for r in knowledge.challengers(df, span).collect()} == first
    pairs = spark.createDataFrame(sorted(pairs), "item_a long, item_b long")
    assert {r["id"]: r["status"] for r in knowledge.infer(df, pairs).select("id", "status").collect()} == status


def test_provenance_of_any_depth(spark):
    beliefs = spark.createDataFrame([(i,) for i in range(80)], "id long")
    premises = spark.createDataFrame([(i + 1, i) for i in range(79)], "id long, premise long")
    assert knowledge.why(beliefs, premises, 79).agg(F.max("depth")).first()[0] == 79


def test_retract_why_and_time(spark):
    beliefs = spark.createDataFrame([(i, "active", i * 10) for i in range(1, 6)], "id long, status string, learned_ticks long")
    premises = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (4, 3), (4, 99)], "id long, premise long")
    gone = knowledge.retract(beliefs, premises, spark.createDataFrame([(2,)], "node long"))
    assert {r["id"] for r in gone.where("status = 'retracted'").collect()} == {2, 3, 4}
    tree = knowledge.why(beliefs, premises, 4)
    assert sorted((r["node"], r["parent"], r["depth"]) for r in tree.collect() if r["depth"]) == [(1, 2, 2), (1, 2, 3), (2, 3, 2), (2, 4, 1), (3, 4, 1)]
    assert sorted(ids(knowledge.active_as_of(gone, 40), "id")) == [1]
    with pytest.raises(LookupError):
        knowledge.why(beliefs, premises, 77)


def test_brier(spark):
    made = spark.createDataFrame([(1, "yes", 0.9, 10), (2, "yes", 0.2, 10), (3, "yes", 0.5, 60)], "id long, predicted_value string, confidence double, emitted_ticks long")
    seen = spark.createDataFrame([(1, " YES ", 20), (2, "no", 20)], "id long, observed_value string, observed_ticks long")
    resolved = knowledge.resolve(made, seen)
    assert knowledge.brier(resolved, 50).first()["brier"] == pytest.approx(0.025)
    assert knowledge.brier(resolved, 15).first()["brier"] is None


def test_knowledge_tiers(spark):
    items = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id long, accesses long")
    assert {r["id"]: r["tier"] for r in knowledge.evict(items, 2).collect()} == {1: "archive", 2: "active", 3: "active"}
    moved, pattern = knowledge.consolidate(items.select("id"), "walk", "a-b", 1)
    assert {r["tier"] for r in moved.collect()} == {"reference"} and pattern.first()["occurrences"] == 1


def test_vectors(spark):
    rows = [(1, [0.9, 0.1, 0.05]), (2, [0.85, 0.15, 0.04]), (3, [0.05, 0.95, 0.8]), (4, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [0.88, 0.12, 0.06])], "query_id long, query array<float>")
    assert [r["vec_id"] for r in vectors.nearest(df, q, 2).orderBy("rank").collect()] == [1, 2]
    odd = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.euclidean(F.col("a"), F.col("b")).alias("e")).first()
    assert odd["d"] == 0 and odd["e"] == float("inf")


def test_nearest_vectors_are_dealt_to_tasks_and_scored_in_full(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0, -1.0]) for _ in range(3)]) for i in range(90)] + [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, 2.0]), (7, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    q = df.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = df.crossJoin(q).where("vec_id <> query_id").select("query_id", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("query")), 9).alias("score"))
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (-r["score"], r["vec_id"])):
        want.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for tile, rows_at_once in ((1024, 4096), (3, 5)):
        monkeypatch.setattr(vectors, "TILE", tile)
        monkeypatch.setattr(vectors, "ROWS", rows_at_once)
        found = vectors.nearest(df, q, 5)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got == {k: v[:5] for k, v in want.items()}
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan  # no expression is evaluated a pair


def test_appends_and_records_have_no_most(spark):
    n = admit.MAX_RECORDS + 10
    known = branches.fork(branches.open_branches(spark), "b1", 0, 2, 5)
    rows = spark.createDataFrame([(0, s, 0) for s in range(5)], "branch long, sequence long, known_ticks long")
    batch = spark.range(n).select((F.lit(3 * n) - F.col("id") * 3).alias("known_ticks")).repartition(7)
    got = branches.append(rows, known, 1, batch, "known_ticks").where("branch = 1")
    facts = got.agg(F.count(F.lit(1)), F.min("sequence"), F.max("sequence"), F.sum(F.abs(F.col("known_ticks") - (F.col("sequence") - 2) * 3))).first()
    assert tuple(facts) == (n, 3, n + 2, 0)
    new = spark.range(n).select(F.format_string("%07d", "id").alias("what")).repartition(7)
    items = knowledge.record(spark.createDataFrame([(4, "a")], "id long, what string"), new, "what").where("id > 4")
    assert tuple(items.agg(F.count(F.lit(1)), F.max("id"), F.sum(F.abs(F.col("id") - 5 - F.col("what").cast("long")))).first()) == (n, n + 4, 0)
    few = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "w string, x int")
    assert [tuple(r) for r in spans.in_order(few, "w", "at").orderBy("at").collect()] == [(None, 3, 0), ("a", 2, 1), ("b", 1, 2)]


def test_small_buckets_make_small_files(spark, two, tmp_path):
    path, copy = str(tmp_path / "log"), str(tmp_path / "copy")
    write_log(two, path, 2)
    assert max(p.stat().st_size for p in (tmp_path / "log").rglob("*.parquet")) < 50_000  # not a mebibyte of Bloom filter
    assert read_log(spark, path).where("slot = 1").count() == 5
    assert backup(spark, path, copy).count() == 5 and restore(spark, copy, str(tmp_path / "back")).count() == 10
    names = lambda folder: sorted(str(p.relative_to(tmp_path / folder)) for p in (tmp_path / folder).rglob("*") if p.is_file())
    assert names("log") == names("copy") == names("back")


def test_a_mirror_reads_as_many_files_as_it_may_hold(spark, two, tmp_path):
    assert subscribe.files_within(1_000_000, 500) == 2000 and subscribe.files_within(10, 500) == 1
    path, sizes = str(tmp_path / "log"), []
    write_log(two, path, 2)
    stream = subscribe.subscription(subscribe.stream_log(spark, path, EVENT, subscribe.files_within(4, 2)), "WHERE sequence >= 0")
    subscribe.deliver(stream, lambda df, n: sizes.append(df.count()), str(tmp_path / "cp"), once=True).awaitTermination()
    assert sum(sizes) == 10 and max(sizes) == 4 and len(sizes) == 3


def test_wide_walks_lose_nothing_that_was_seen_before(spark, monkeypatch):
    """A step that was cut short is wide, though some of its nodes were met earlier."""
    monkeypatch.setattr(causal, "FRONTIER_LIMIT", 8)
    links = [(0, n) for n in range(1, 6)] + [(1, n) for n in range(2, 6)] + [(2, n) for n in range(3, 18)]
    graph = spark.createDataFrame(links, "cause long, effect long")
    for again in range(3):
        got = causal.walk(graph.repartition(again + 1, "effect"), {0}, "effects", None)
        assert {r["node"]: r["depth"] for r in got.collect()} == {0: 0} | dict.fromkeys(range(1, 6), 1) | dict.fromkeys(range(6, 18), 2)


def test_an_append_is_made_by_all_tasks(spark, two, tmp_path):
    path = str(tmp_path / "log")
    write_log(two, path)
    store = Engine(spark, spark.read.parquet(path), path)

    @F.udf("long")
    def task():
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    store.append(log(spark, [event(10 + i, ticks=30) for i in range(6)]).repartition(3).withColumn("schema_id", task()))
    assert store.events.where("sequence >= 10").select("schema_id").distinct().count() > 1


def test_levels_of_large_graphs_come_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    links = sorted({(rng.randrange(max(0, n - 9), n), n) for n in range(1, 120) for _ in range(2)} | {(n // 2, n) for n in range(3, 120, 3)} | {(118, 300), (2, 300)})
    want = dict.fromkeys(range(120), 0)
    for c, e in sorted(links, key=lambda x: x[1]):
        want[e] = max(want.get(e, 0), want[c] + 1)
    graph, nodes = spark.createDataFrame(links + links[:3], "cause long, effect long"), spark.createDataFrame([(n,) for n in [*range(120), 300, 400]], "node long")
    monkeypatch.setattr(causal, "FRONTIER_LIMIT", 0)
    rounds = []
    monkeypatch.setattr(DataFrame, "isEmpty", lambda self, f=DataFrame.isEmpty: rounds.append(1) or f(self))
    for size in (1_000, 40, 7):
        monkeypatch.setattr(causal, "BLOCK_EDGES", size)
        got = causal.topological_levels(graph, nodes)
        assert {r["node"]: r["level"] for r in got.collect()} == want | {400: 0}
    assert not rounds  # no round a level
    order = [r["node"] for r in causal.topological_order(graph, nodes).orderBy("place").collect()]
    assert order == sorted(want | {400: 0}, key=lambda n: (want.get(n, 0), n))


def test_acyclic_graphs_are_not_peeled(spark, monkeypatch):
    tree = spark.createDataFrame([(n // 3, n) for n in range(1, 40)], "cause long, effect long")
    monkeypatch.setattr(causal, "topological_levels", lambda graph, nodes, f=causal.topological_levels: sizes.append(graph.count()) or f(graph, nodes))
    sizes = []
    causal.check_acyclic(tree)
    assert not sizes
    more = lambda *pairs: tree.unionByName(spark.createDataFrame(list(pairs), "cause long, effect long"))
    causal.check_acyclic(more((30, 5)))  # back, but no cycle: 30's ancestors are 10, 3, 1 and 0
    assert sizes == [4]
    for pairs in ([(30, 1)], [(5, 5)], [(30, 5), (17, 30)]):
        with pytest.raises(causal.CycleError):
            causal.check_acyclic(more(*pairs))
    assert max(sizes) < 15


def test_contradictions_of_common_words_are_dealt_out(spark, monkeypatch):
    words = ["alive", "dead", "inactive", "active", "open closed", "closed", "true false", "calm", "not calm", "not not calm", "not alive", "Not dead ", None]
    df = spark.createDataFrame([(n, words[n % 13]) for n in range(90)] + [(5, "closed"), (6, "dead")], "id long, proposition string")
    a, b = (df.select(F.col("id").alias(i), knowledge.normal(F.col("proposition")).alias(p)) for i, p in (("item_a", "p"), ("item_b", "q")))
    want = {tuple(r) for r in a.join(b, F.col("item_a") < F.col("item_b")).where(knowledge.contradicts(F.col("p"), F.col("q"))).select("item_a", "item_b").collect()}
    for group in (2_048, 5, 1):
        monkeypatch.setattr(knowledge, "GROUP", group)
        found = knowledge.contradictions(df)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # the pairs themselves are not held


def test_payloads_are_measured_and_not_carried(spark, two):
    big = two.withColumns({"payload": F.when(F.col("sequence") % 3 == 0, F.repeat(F.lit("x"), admit.MAX_PAYLOAD + 1).cast("binary")).otherwise(F.col("payload")), "causes": F.filter("causes", lambda c: c["sequence"] >= 0)})
    found = admit.violations(big)
    assert sorted(ids(found)) == [0, 3, 6, 9]
    projects = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Project [" in line]
    assert not any("AS payload" in line for line in projects)


def test_streaming_folds_get_plain_rows_in_order(spark, tmp_path):
    path, got = str(tmp_path / "log"), {}
    rows = spark.range(40).select(F.lit(0).cast("long").alias("shard"), (F.col("id") % 3).alias("slot"), F.lit(0).cast("long").alias("generation"), F.col("id").alias("sequence"), F.timestamp_seconds("id").alias("at"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("word"))
    rows.orderBy(F.col("sequence").desc()).coalesce(1).write.parquet(path)

    def step(state, row):
        assert type(row["sequence"]) is int and row["at"].second == row["sequence"] and (row["word"] == "x") == (row["sequence"] % 2 == 0)
        last = (state or {"last": -1, "n": 0})["last"]
        assert row["sequence"] > last
        return {"last": row["sequence"], "n": (state or {"n": 0})["n"] + 1}

    out = subscribe.fold_stream(subscribe.stream_log(spark, path, rows.schema, 1), step, ["at", "word"], "last long, n long")
    keep = lambda df, i: got.update({r["slot"]: (r["last"], r["n"]) for r in df.collect()})
    out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    assert got == {0: (39, 14), 1: (37, 13), 2: (38, 13)}


def test_a_fold_makes_no_table_of_its_rows():
    import inspect

    assert "sort_values" not in inspect.getsource(subscribe.fold_stream) and "to_dict" not in inspect.getsource(subscribe.fold_stream)


def test_transformations(spark, two):
    registry = transform.Registry()
    tight = transform.Manifest("x", "1.0.0", "event_to_observation", transform.Budget(steps=11))
    registry.register(tight, transform.event_to_observation)
    assert {r["outcome"] for r in registry.apply("x", two).collect()} == {"over budget"}
    assert transform.lineage(registry.apply("x", two), tight).count() == 0
    with pytest.raises(LookupError):
        registry.apply("y", two)
    with pytest.raises(ValueError):
        registry.register(transform.Manifest("z", "1", "k"), transform.event_to_observation)


def test_lifecycle():
    c = evolve.Lifecycle()
    for n, b in (("a", 0.2), ("b", 0.1), ("c", 0.01)):
        c.register(n)
        c.propose(n, True)
        c.evaluate(n, b, 10, 10)
    c.promote("a", "me")
    c.promote("b", "me")
    assert c.status["a"] == "superseded" and c.rollback() == "a" and c.status["a"] == "promoted"
    for act in (lambda: c.promote("c", "me"), lambda: c.promote("b", None), lambda: c.evaluate("c", 1, 0, 1), lambda: c.propose("c", False), lambda: evolve.check_action("mutate_evidence"), lambda: evolve.check_action("mutate_constitution")):
        with pytest.raises(evolve.ConstitutionError):
            act()
    assert c.mutate_policy(True, 1.0, 1.1) and not c.mutate_policy(True, 1.0, 1.0)


def test_record_schema(spark):
    schema = RecordSchema(1, 1, (Field(1, "active", "bool", False), Field(0, "health", "u64", False, "points")))
    assert schema.struct().fieldNames() == ["health", "active"] and schema.struct()["health"].metadata["unit"] == "points"
    rows = [(1, "health", "u64", False), (2, "health", "utf8", False), (3, "nope", "u64", False), (4, "active", "bool", True)]
    bad = schema.violations(spark.createDataFrame(rows, "sequence long, field string, value_kind string, is_null boolean"))
    assert {r["sequence"]: r["reason"] for r in bad.collect()} == {2: "type mismatch", 3: "unknown field", 4: "null in a required field"}
    with pytest.raises(ValueError):
        RecordSchema(1, 0, ())


def test_consumer_events(spark, two):
    cause = F.array(F.struct(F.lit(1).cast("long").alias("source"), F.lit(1).cast("long").alias("epoch"), F.col("sequence")))
    own = two.withColumns({"organ_id": F.lit("eye"), "action_id": F.col("sequence").cast("string"), "reward": F.lit(0.5)})
    both = subscribe.convert(own, "percept", "known_ticks").unionByName(subscribe.convert(own, "outcome", "known_ticks", cause))
    assert both.count() == 20 and columnar_export(two).toArrow().num_columns == 7
    rows = {(r["kind"], r["valid_ticks"]): r for r in both.collect()}
    assert rows["percept", 12]["payload"] == b'{"organ_id":"eye"}' and rows["percept", 12]["schema_id"] == 101 and rows["percept", 12]["causes"] == []
    assert rows["outcome", 13]["payload"] == b'{"action_id":"3","reward":0.5}' and rows["outcome", 13]["causes"][0]["sequence"] == 3 and rows["outcome", 13]["observed_ticks"] == 13
    assert subscribe.convert(own, "action", "known_ticks").first()["observed_ticks"] is None
    with pytest.raises(ValueError):
        subscribe.convert(own, "outcome", "known_ticks")
    ticks = subscribe.cadence_ticks(spark.createDataFrame([(2.0,)], "s double"), "s")
    assert {r["clock"]: r["tick"] for r in ticks.collect()} == {1: 240, 2: 40, 3: 2, 4: 0}


def test_streaming_fold(spark, two, tmp_path):
    path = str(tmp_path / "log")
    write_log(two, path, 4)
    stored = spark.read.parquet(path)
    stream = subscribe.subscription(subscribe.stream_log(spark, path, stored.schema, 1), "WHERE sequence >= 0")
    step = lambda s, e: {"n": (s or {"n": 0})["n"] + 1, "last": int(e["sequence"])}
    out = subscribe.fold_stream(stream, step, ["schema_id"], "n long, last long")
    got = {}
    run = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: got.update({r["slot"]: (r["n"], r["last"]) for r in df.collect()})).trigger(availableNow=True).start()
    run.awaitTermination()
    assert got == {1: (5, 8), 2: (5, 9)}


def test_mirrored_sinks(spark, two, tmp_path):
    write = subscribe.dual_sink(str(tmp_path / "a"), str(tmp_path / "b"))
    write(two, 0)
    write(two, 0)
    new_only = subscribe.mirror_sink(str(tmp_path / "c"), str(tmp_path / "d"), "new_only", 10)
    new_only(two, 0)
    assert not (tmp_path / "c").exists() and spark.read.parquet(str(tmp_path / "d")).count() == 10
    with pytest.raises(subscribe.BackpressureError):
        subscribe.mirror_sink(str(tmp_path / "e"), str(tmp_path / "f"), "shadow", 9)(two, 0)
    assert not (tmp_path / "e").exists()
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 10


def test_confidence_and_recording(spark):
    df = spark.createDataFrame([(0.5,), (1.5,)], "c double")
    assert df.where("c < 1").select(knowledge.checked_confidence(F.col("c")).alias("c")).collect()[0]["c"] == 0.5
    with pytest.raises(Exception, match="confidence out of range"):
        df.select(knowledge.checked_confidence(F.col("c")).alias("c")).collect()
    items = knowledge.record(spark.createDataFrame([(4, "a")], "id long, what string"), spark.createDataFrame([("c",), ("b",)], "what string"), "what")
    assert {r["id"]: r["what"] for r in items.collect()} == {4: "a", 5: "b", 6: "c"}


def test_metrics(spark, two, tmp_path):
    path = str(tmp_path / "log")
    write_log(two, path, 4)
    m = Engine(spark, spark.read.parquet(path), path).query("WHERE sequence < 3\nLIMIT 2").metrics()
    assert m["rows"] == 2 and m["truncated"] and 0 < m["events_scanned"] <= 10 and m["bytes_read"] > 0


def test_encoding_choice(spark):
    df = spark.createDataFrame([(1, "rle", 50, 100, 10, 1000), (1, "pack", 60, 100, 10, 0), (2, "rle", 120, 100, 0, 0)], "block long, encoding string, bytes long, raw_bytes long, encode_ns long, decode_ns long")
    assert {r["block"]: r["encoding"] for r in choose_encoding(df).collect()} == {1: "rle", 2: "raw"}
