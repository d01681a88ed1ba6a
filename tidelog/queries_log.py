"""Registered queries about stored logs, admission, streams, and the control tables of the engine, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.engine import Engine
from tidelog.functions import morton
from tidelog.model import EVENT, ENTITY
from tidelog.operators import admit, causal, evolve, knowledge, replay, runtime, scan
from tidelog.plans.parse import dialect
from tidelog.queries import EV, GRAPH, SPAN, _premises, _span, query, scratch
from tidelog.sources import events as log_files
from tidelog.sources.events import bind_events, table, with_causes
from tidelog.streaming import subscribe


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound events as the canonical columns alone, causes included."""
    return with_causes(bind_events(spark, sf_dir)).select(*[F.col(f.name) for f in EVENT.fields])


# --- scans, pages, appends


@query(f"WITH {EV}, {SPAN} SELECT sequence, valid_ticks AS valid_time FROM ev, span WHERE sequence <= n // 2 + 500 AND shard = 7 AND valid_ticks >= a")
def volatile_append(spark, sf_dir):
    """Half of the log in memory, the next 500 events appended to it as a checked batch, and a scan over both."""
    a, _, last = _span(spark, sf_dir)
    log = _canonical(spark, sf_dir)
    engine = Engine(spark, log.where(F.col("sequence") <= last // 2))
    engine.append(log.where((F.col("sequence") > last // 2) & (F.col("sequence") <= last // 2 + 500)))
    return engine.history().where((F.col("shard") == 7) & (F.col("valid_ticks") >= a)).select("sequence", F.col("valid_ticks").alias("valid_time"))


@query(f"WITH {EV} SELECT sequence, slot, schema_id FROM ev WHERE sequence IN (13, 110, 207, 304)")
def volatile_get(spark, sf_dir):
    """Point lookups in a log in memory."""
    engine, found = Engine(spark, _canonical(spark, sf_dir)), None
    for at in (13, 110, 207, 304):
        row = scan.point(engine.events, scan.EventId(1, 1, at))
        found = row if found is None else found.unionByName(row)
    return found.select("sequence", "slot", "schema_id")


@query(f"WITH {EV}, {SPAN} SELECT sequence, payload FROM ev, span WHERE sequence <= n // 2 + 300")
def stored_append(spark, sf_dir):
    """A log written to a folder, and a checked batch appended there."""
    _, _, last = _span(spark, sf_dir)
    path, log = scratch(spark, "log"), _canonical(spark, sf_dir)
    log_files.write_log(log.where(F.col("sequence") <= last // 2), path, 500)
    engine = Engine(spark, log_files.read_log(spark, path).select(*EVENT.fieldNames()), path)
    engine.append(log.where((F.col("sequence") > last // 2) & (F.col("sequence") <= last // 2 + 300)))
    return engine.events.select("sequence", F.decode("payload", "UTF-8").alias("payload"))


COST = f"{scan.EVENT_BYTES} + strlen(payload)"


@query(f"WITH {EV}, own AS (SELECT sequence, sum({COST}) OVER (ORDER BY sequence) AS used FROM ev WHERE shard = 5 AND slot = 13) SELECT sequence FROM own WHERE used <= 1000")
def page_bytes(spark, sf_dir):
    """The first page of an entity within 1000 bytes."""
    return scan.page(bind_events(spark, sf_dir), scan.HistoryFilter(scan.EntityId(5, 13, 0)), 100, max_bytes=1000).rows.select("sequence")


@query(f"WITH {EV} SELECT sequence, sequence // 400 AS page FROM ev WHERE shard = 5 AND slot = 13 AND sequence < 1000")
def page_scanned(spark, sf_dir):
    """An entity's events below 1000, by pages that look at 400 sequences each; pages may be empty."""
    events, flt, out = bind_events(spark, sf_dir).where("sequence < 1000"), scan.HistoryFilter(scan.EntityId(5, 13, 0)), None
    cursor, number = None, 0
    while True:
        page = scan.page(events, flt, 1000, cursor, max_scanned=400)
        rows = page.rows.select("sequence", F.lit(number).cast("long").alias("page"))
        out, cursor, number = rows if out is None else out.unionByName(rows), page.cursor, number + 1
        if cursor is None:
            return out


@query(f"WITH {EV} SELECT sequence FROM ev WHERE schema_id = 2 AND sequence >= 333 ORDER BY sequence LIMIT 12")
def page_from_sequence(spark, sf_dir):
    events = bind_events(spark, sf_dir).where("schema_id = 2")
    end = events.agg(F.max("sequence")).first()[0] + 1
    return scan.page(events, scan.HistoryFilter(), 12, scan.cursor_from(333, end, scan.HistoryFilter(), (1, 1))).rows.select("sequence")


@query(f"WITH {EV} SELECT 'LIMIT 5' AS query, 5::BIGINT AS rows, true AS truncated UNION ALL SELECT 'WHERE schema = 3', count(*), false FROM ev WHERE schema_id = 3 UNION ALL SELECT 'EVENT 1:1:3 TRACE EFFECTS DEPTH 1 LIMIT 2', 2, true UNION ALL SELECT 'tn:$1:1:0<-4', 1, false")
def query_metrics(spark, sf_dir):
    """Rows and truncation of scans and traces."""
    engine, rows = Engine(spark, with_causes(bind_events(spark, sf_dir)).drop("payload")), []
    for text in ("LIMIT 5", "WHERE schema = 3", "EVENT 1:1:3 TRACE EFFECTS DEPTH 1 LIMIT 2", "tn:$1:1:0<-4"):
        m = engine.query(text).metrics()
        rows.append((text, m["rows"], m["truncated"]))
    return spark.createDataFrame(rows, "query string, rows long, truncated boolean")


@query("SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'compact' WHEN 1 THEN 'compact' WHEN 2 THEN 'sql' ELSE 'lines' END AS dialect FROM nation")
def dialects(spark, sf_dir):
    """Which spelling a text about each nation is in."""
    spell = (lambda k: f"tn:#{k}", lambda k: f" ${k}:1:1<-2", lambda k: f"  SeLeCt * FROM t WHERE schema = {k}", lambda k: f"ENTITY {k}")
    rows = [(k, dialect(spell[k % 4](k))) for (k,) in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame(rows, "id int, dialect string")


# --- admission


@query(f"WITH {EV} SELECT sequence, CASE WHEN sequence % 3 = 0 THEN 'payload too large' WHEN sequence % 5 = 0 THEN 'too many causes' ELSE 'cause does not precede' END AS reason FROM ev WHERE sequence % 3 = 0 OR sequence % 5 = 0 OR sequence % 7 = 0")
def admission_violations(spark, sf_dir):
    """Rows spoiled in three ways: a payload over a mebibyte, 65 causes, a cause that is the event itself."""
    s, cause = F.col("sequence"), lambda q: F.struct(F.lit(1).cast("long").alias("source"), F.lit(1).cast("long").alias("epoch"), q.alias("sequence"))
    spoiled = _canonical(spark, sf_dir).withColumns(
        {
            "payload": F.when(s % 3 == 0, F.repeat(F.lit("x"), admit.MAX_PAYLOAD + 1).cast("binary")).otherwise(F.col("payload")),
            "causes": F.when(s % 5 == 0, F.transform(F.sequence(F.lit(1), F.lit(admit.MAX_CAUSES + 1)), lambda i: cause(i.cast("long")))).when(s % 7 == 0, F.array(cause(s))).otherwise(F.col("causes")),
        }
    )
    return admit.violations(spoiled)


@query(f"WITH {EV}, {GRAPH} SELECT (SELECT count(*) FROM links)::BIGINT AS causes, (SELECT count(*) FROM links WHERE cause >= effect)::BIGINT AS late_causes")
def causes_precede(spark, sf_dir):
    log = _canonical(spark, sf_dir)
    late = admit.violations(log).where("reason = 'cause does not precede'").count()
    return log.agg(F.sum(F.size("causes")).alias("causes")).withColumn("late_causes", F.lit(late).cast("long"))


@query(f"WITH {EV} SELECT 'empty' AS batch, 'empty batch' AS answer UNION ALL SELECT 'gap', 'sequences must follow from 500 without a gap' UNION ALL SELECT 'back in time', 'known time goes back' UNION ALL SELECT 'other clock', 'known clock changed' UNION ALL SELECT 'too many', 'more than 100 records' UNION ALL SELECT 'good', 'admitted ' || count(*) FROM ev WHERE sequence BETWEEN 500 AND 599")
def batch_verdicts(spark, sf_dir):
    """What admission says to six batches after event 499."""
    log = _canonical(spark, sf_dir)
    last = log.where("sequence = 499").first()
    good, known = log.where("sequence between 500 and 599"), (last["known_clock"], last["known_ticks"])
    batches = {
        "empty": log.limit(0), "gap": good.where("sequence <> 550"), "back in time": good.withColumn("known_ticks", F.col("known_ticks") - F.col("sequence") * 100_000_000_000),
        "other clock": good.withColumn("known_clock", F.lit(2).cast("long")), "too many": log.where("sequence between 500 and 600"), "good": good,
    }
    rows = []
    for name, batch in batches.items():
        try:
            rows.append((name, f"admitted {admit.admit(batch, 500, known, 100).count()}"))
        except admit.AdmissionError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "batch string, answer string")


@query(f"WITH RECURSIVE {EV}, {GRAPH}, want AS (SELECT n - a AS cause, n - b AS effect FROM (SELECT max(sequence) AS n FROM ev), (VALUES (0, 200), (200, 0), (2, 3), (5, 5), (100, 450)) t(a, b)), reach AS (SELECT cause, effect, effect AS node FROM want UNION SELECT r.cause, r.effect, l.effect FROM reach r JOIN links l ON l.cause = r.node) SELECT cause, effect, NOT bool_or(node = cause) AS accepted FROM reach GROUP BY ALL")
def cycle_check(spark, sf_dir):
    """Declared causes among the last events that would close a cycle are refused."""
    _, _, n = _span(spark, sf_dir)
    graph, rows = causal.edges(with_causes(bind_events(spark, sf_dir))).persist(), []
    for a, b in ((0, 200), (200, 0), (2, 3), (5, 5), (100, 450)):
        try:
            causal.add_edges(graph, spark.createDataFrame([(n - a, n - b)], "cause long, effect long"))
            rows.append((n - a, n - b, True))
        except causal.CycleError:
            rows.append((n - a, n - b, False))
    graph.unpersist()
    return spark.createDataFrame(rows, "cause long, effect long, accepted boolean")


@query("SELECT 'as they are' AS tasks, 'fine' AS answer UNION ALL SELECT 'with a loop', 'cycle' UNION ALL SELECT 'without the first', 'missing'")
def task_checks(spark, sf_dir):
    """Dependencies must exist and be free of cycles."""
    tasks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(1).alias("class"), F.lit("pending").alias("status"))
    deps, rows = _premises(spark, sf_dir).select("id", F.col("premise").alias("needs")), []
    loop = deps.unionByName(spark.createDataFrame([(1, 30)], "id long, needs long"))
    for name, own, needs in (("as they are", tasks, deps), ("with a loop", tasks, loop), ("without the first", tasks.where("id <> 1"), deps)):
        try:
            runtime.check_tasks(own, needs)
            rows.append((name, "fine"))
        except (causal.CycleError, LookupError) as e:
            rows.append((name, "cycle" if isinstance(e, causal.CycleError) else "missing"))
    return spark.createDataFrame(rows, "tasks string, answer string")


# --- stored segments, retirement, backups, snapshots


@query(f"WITH {EV} SELECT sequence // 300 AS bucket, min(sequence) AS first, max(sequence) AS last, count(*) AS records FROM ev GROUP BY 1 HAVING count(*) = 300")
def sealed_segments(spark, sf_dir):
    """Complete buckets of a stored log, sealed twice."""
    path, sealed = scratch(spark, "log"), scratch(spark, "sealed")
    log_files.write_log(_canonical(spark, sf_dir), path, 300)
    log_files.seal(spark, path, sealed, 300)
    return log_files.seal(spark, path, sealed, 300).select(F.col("seq_bucket").cast("long").alias("bucket"), "first", "last", "records")


@query(f"WITH {EV} SELECT sequence FROM ev WHERE sequence >= 600")
def retired_log(spark, sf_dir):
    """What a log still holds after its sealed prefix, up to a hold on event 700, was deleted."""
    path, sealed = scratch(spark, "log"), scratch(spark, "sealed")
    log_files.write_log(_canonical(spark, sf_dir), path, 300)
    log_files.retire(spark, path, log_files.seal(spark, path, sealed, 300), [(700, 700)])
    return log_files.read_log(spark, path).select("sequence")


@query(f"WITH {EV} SELECT sequence, payload FROM ev")
def restored_log(spark, sf_dir):
    """A log copied, checked against its manifest and brought back elsewhere."""
    path, copy = scratch(spark, "log"), scratch(spark, "backup")
    log_files.write_log(_canonical(spark, sf_dir), path, 1000)
    log_files.backup(spark, path, copy)
    return log_files.restore(spark, copy, scratch(spark, "restored")).select("sequence", F.decode("payload", "UTF-8").alias("payload"))


@query(f"WITH {EV}, {SPAN} SELECT shard, slot, generation, max(sequence) AS sequence, arg_max(k, sequence) AS state, any_value(n // 3) AS checkpoint FROM ev, span WHERE sequence <= n // 3 GROUP BY shard, slot, generation")
def saved_snapshot(spark, sf_dir):
    """A state written as a checkpoint, and loaded by a later target."""
    _, _, last = _span(spark, sf_dir)
    path, events = scratch(spark, "snapshots"), bind_events(spark, sf_dir)
    for at in (last // 4, last // 3):
        replay.snapshot(replay.raw_state(events, at, F.col("k")), path, at)
    at, state = replay.load_snapshot(spark, path, last // 2)
    return state.select(*ENTITY, "sequence", "state", F.lit(at).cast("long").alias("checkpoint"))


@query(f"WITH {EV}, {SPAN}, t AS (SELECT unnest([n // 2, n + 1]) AS target, n FROM span) SELECT target::BIGINT AS target, 'whole' AS history, target <= n AS reaches FROM t UNION ALL SELECT n // 2, 'without 40', false FROM span")
def replay_targets(spark, sf_dir):
    """Replay refuses targets that do not exist, and histories with a gap."""
    _, _, last = _span(spark, sf_dir)
    events, rows = bind_events(spark, sf_dir), []
    for target, name, own in ((last // 2, "whole", events), (last + 1, "whole", events), (last // 2, "without 40", events.where("sequence <> 40"))):
        try:
            replay.check_target(own, target)
            rows.append((target, name, True))
        except replay.ReplayError:
            rows.append((target, name, False))
    return spark.createDataFrame(rows, "target long, history string, reaches boolean")


@query("SELECT user_id % 8 AS shard, user_id AS slot, CASE WHEN max(n) < 2 THEN max(n) + 1 END::BIGINT AS generation, max(n) >= 2 AS retired FROM (SELECT user_id, count(*) FILTER (event_type = 'signup') AS n FROM events GROUP BY user_id) GROUP BY ALL")
def slab_next(spark, sf_dir):
    """Handles of the slots' next entities: each signup began a generation, and a slot has two of them at most."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("slot")).agg(F.count(F.when(F.col("event_type") == "signup", 1)).alias("generation"))
    return replay.next_handles(e.withColumn("shard", F.col("slot") % 8), 2)


# --- streams


@query(f"WITH {EV}, {SPAN} SELECT sequence, slot, sequence > n // 2 AS is_live FROM ev, span WHERE schema_id = 3 AND sequence >= 50")
def subscription_phases(spark, sf_dir):
    """A subscription with a projection: past events, then those appended while it stood."""
    _, _, last = _span(spark, sf_dir)
    path, checkpoint, seen, log = scratch(spark, "log"), scratch(spark, "offsets"), scratch(spark, "seen"), _canonical(spark, sf_dir)
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{seen}/batch={n}")
    for part in (log.where(F.col("sequence") <= last // 2), log.where(F.col("sequence") > last // 2)):
        log_files.write_log(part, path, 1 << 40)
        stream = subscribe.stream_log(spark, path, log.schema)
        matches = subscribe.subscription(stream, "SELECT sequence, slot FROM log WHERE schema = 3", 50, last // 2 + 1)
        subscribe.deliver(matches, keep, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(seen).select("sequence", "slot", "is_live")


@query(f"WITH {EV} SELECT shard, slot, generation, count(*) AS n, sum(k)::BIGINT AS total FROM ev GROUP BY shard, slot, generation")
def streamed_fold(spark, sf_dir):
    """A user's fold in the state store, over a log that arrives in files; the last state of each entity."""
    path, out = scratch(spark, "log"), scratch(spark, "states")
    bind_events(spark, sf_dir).select(*ENTITY, "sequence", "k").repartitionByRange(3, "sequence").write.parquet(path)
    stream = subscribe.stream_log(spark, path, spark.read.parquet(path).schema, 1)
    step = lambda s, e: {"n": (s or {"n": 0})["n"] + 1, "total": (s or {"total": 0})["total"] + int(e["k"])}
    folded = subscribe.fold_stream(stream, step, ["k"], "n long, total long")
    keep = lambda df, i: df.withColumn("i", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}")
    folded.writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "offsets")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(*ENTITY).agg(F.max_by("n", "i").alias("n"), F.max_by("total", "i").alias("total"))


@query(f"WITH {EV}, c AS (SELECT unnest(['old', 'new']) AS copy) SELECT copy, sequence FROM ev, c WHERE schema_id = 2")
def mirrored(spark, sf_dir):
    """A stream in shadow mode: the old folder and its mirror hold each event once."""
    path, old, new = scratch(spark, "log"), scratch(spark, "old"), scratch(spark, "new")
    log_files.write_log(_canonical(spark, sf_dir), path, 500)
    stream = subscribe.stream_log(spark, path, EVENT, subscribe.files_within(1_000_000, 500))
    matches = subscribe.subscription(stream, "SELECT sequence FROM log WHERE schema = 2")
    subscribe.deliver(matches, subscribe.mirror_sink(old, new, "shadow", 1_000_000), scratch(spark, "offsets"), once=True).awaitTermination()
    read = lambda folder, name: spark.read.parquet(folder).select(F.lit(name).alias("copy"), "sequence")
    return read(old, "old").unionByName(read(new, "new"))


@query("""SELECT event_id % 4 AS kind, 101 + event_id % 4 AS schema_id, epoch_us(ts) AS known_ticks, CASE WHEN event_id % 4 IN (0, 3) THEN epoch_us(ts) END AS observed_ticks,
  CASE event_id % 4 WHEN 0 THEN '{"organ_id":"' || event_type || '","sensor_id":"' || user_id || '"}' WHEN 1 THEN '{"organ_id":"' || event_type || '","goal_label":"' || user_id || '"}' WHEN 2 THEN '{"action_id":"' || event_id || '"}' ELSE '{"action_id":"' || (event_id - 1) || '"}' END AS payload,
  CASE WHEN event_id % 4 = 3 THEN event_id - 1 END AS cause FROM events""")
def consumer_events(spark, sf_dir):
    """Percepts, intentions, actions and outcomes as canonical events."""
    e = table(spark, sf_dir, "events")
    s, text = F.col("event_id"), lambda c: c.cast("string")
    one = F.lit(1).cast("long")
    own = e.select((F.col("user_id") % 8).alias("shard"), F.col("user_id").alias("slot"), F.lit(0).cast("long").alias("generation"), s, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type"), F.col("user_id"))
    named = {
        "percept": own.where("event_id % 4 = 0").withColumns({"organ_id": F.col("event_type"), "sensor_id": text(F.col("user_id"))}),
        "intention": own.where("event_id % 4 = 1").withColumns({"organ_id": F.col("event_type"), "goal_label": text(F.col("user_id"))}),
        "action": own.where("event_id % 4 = 2").withColumn("action_id", text(s)),
        "outcome": own.where("event_id % 4 = 3").withColumn("action_id", text(s - 1)),
    }
    cause = F.array(F.struct(one.alias("source"), one.alias("epoch"), (s - 1).alias("sequence")))
    parts = [subscribe.convert(df, kind, "at", cause if kind == "outcome" else None) for kind, df in named.items()]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.select((F.col("schema_id") - 101).alias("kind"), "schema_id", "known_ticks", "observed_ticks", F.decode("payload", "UTF-8").alias("payload"), F.get("causes", F.lit(0))["sequence"].alias("cause"))


@query("SELECT event_id AS sequence, clock, floor(event_id / 16.0 * rate)::BIGINT AS tick FROM events, (VALUES (1, 120.0), (2, 20.0), (3, 1.0), (4, 0.1)) c(clock, rate)")
def cadence(spark, sf_dir):
    """How far the four clocks have come at each event, sixteen events a second."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), (F.col("event_id") / 16.0).alias("s"))
    return subscribe.cadence_ticks(e, "s").select("sequence", "clock", "tick")


# --- knowledge and control


@query("SELECT event_id AS id, value / 100.0 AS confidence FROM events WHERE value BETWEEN 0 AND 100")
def confidences(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value between 0 and 100")
    return e.select(F.col("event_id").alias("id"), knowledge.checked_confidence(F.col("value") / 100.0).alias("confidence"))


@query("SELECT p_partkey AS id, p_name AS what FROM part UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY n_name), n_name FROM nation")
def recorded(spark, sf_dir):
    """A batch of observations recorded after the known ones."""
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("what"))
    return knowledge.record(items, table(spark, sf_dir, "nation").select(F.col("n_name").alias("what")), "what")


@query("SELECT 'observation' AS what, o_orderkey AS id, 'reference' AS state FROM orders WHERE o_custkey % 5 = 0 UNION ALL SELECT 'pattern', 7, 'orders of fives: 1'")
def consolidated(spark, sf_dir):
    """An episode's observations in the reference tier, and the pattern it left."""
    own = table(spark, sf_dir, "orders").where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("id"))
    moved, pattern = knowledge.consolidate(own, "orders", "orders of fives", 7)
    made = pattern.select(F.lit("pattern").alias("what"), "id", F.concat_ws(": ", "signature", F.col("occurrences").cast("string")).alias("state"))
    return moved.select(F.lit("observation").alias("what"), "id", F.col("tier").alias("state")).unionByName(made)


@query("""WITH c AS (SELECT n_nationkey AS k, (n_nationkey * 7 % 25) / 100.0 AS benefit FROM nation), p AS (SELECT *, benefit >= 0.05 AS fit FROM c)
SELECT k AS id, CASE WHEN NOT fit THEN 'evaluated' WHEN k = (SELECT max(k) FROM p WHERE fit) THEN 'rolled back' WHEN k = (SELECT max(k) FROM p WHERE fit AND k < (SELECT max(k) FROM p WHERE fit)) THEN 'promoted' ELSE 'superseded' END AS status FROM p""")
def lifecycle(spark, sf_dir):
    """Candidates promoted in turn if their benefit suffices; the last promotion is taken back."""
    c = evolve.Lifecycle()
    keys = sorted(k for (k,) in table(spark, sf_dir, "nation").select("n_nationkey").collect())
    for k in keys:
        c.register(str(k))
        c.propose(str(k), True)
        c.evaluate(str(k), k * 7 % 25 / 100.0, 1000, 1000)
        try:
            c.promote(str(k), "operator")
        except evolve.ConstitutionError:
            continue
    c.rollback()
    return spark.createDataFrame([(k, c.status[str(k)]) for k in keys], "id int, status string")


@query("SELECT n_nationkey AS id, n_regionkey < 4 AND n_nationkey % 2 = 0 AND n_nationkey > 10 AS taken, n_regionkey < 4 AND n_nationkey % 2 = 1 AS refused FROM nation")
def meta_evolution(spark, sf_dir):
    """A new mutation policy is taken if evolution is on, the gate passed, and the yield grew."""
    rows = []
    for k, r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect():
        c = evolve.Lifecycle(evolving=r < 4)
        try:
            rows.append((k, c.mutate_policy(k % 2 == 0, 10.0, float(k)), False))
        except evolve.ConstitutionError:
            rows.append((k, False, True))
    return spark.createDataFrame(rows, "id int, taken boolean, refused boolean")


# --- space and media


@query("SELECT event_id AS sequence FROM events WHERE user_id <= 75 AND user_id + event_id % 10 >= 20 AND event_id % 500 <= 300 AND event_id % 500 + event_id % 7 >= 100")
def boxes_meet(spark, sf_dir):
    """Events whose own box shares a point with a given one."""
    x, y, s = F.col("user_id"), F.col("event_id") % 500, F.col("event_id")
    return table(spark, sf_dir, "events").where(morton.intersects([x, y], [x + s % 10, y + s % 7], [20, 100], [75, 300])).select(s.alias("sequence"))


@query("SELECT event_id AS sequence FROM events WHERE user_id // 16 BETWEEN 20 // 16 AND 75 // 16 AND (event_id % 500) // 16 BETWEEN 100 // 16 AND 300 // 16 ORDER BY event_id LIMIT 40")
def spatial_text(spark, sf_dir):
    """A box as a query text."""
    e = bind_events(spark, sf_dir).withColumns({"x": F.col("slot"), "y": F.col("sequence") % 500})
    return Engine(spark, e).query("BOX 20,100..75,300 CHUNK 16 LIMIT 40").rows.select("sequence")


@query("SELECT 'documents/' || doc_id AS uri, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'hash differs' END AS problem FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND (doc_id % 11 = 0 OR (doc_id % 13 = 0 AND regexp_matches(text, '[b-z]')))")
def media_problems(spark, sf_dir):
    """References to all texts, checked when some are gone and some have other letters."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").withColumn("u", F.concat(F.lit("documents/"), F.col("doc_id").cast("string")))
    references = log_files.media_reference(docs, F.col("u"), "text").select("uri", "content_hash", "byte_size")
    changed = F.when(F.col("doc_id") % 13 == 0, F.translate("text", "bcdefghijklmnopqrstuvwxyz", "a" * 25)).otherwise(F.col("text"))
    return log_files.verify_media(references, docs.where("doc_id % 11 <> 0").select(F.col("u").alias("uri"), changed.alias("content")))
