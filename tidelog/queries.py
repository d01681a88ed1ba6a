"""Registered queries of the history engine, each with its DuckDB SQL.

All run on whole tables. `EV` is the SQL twin of tidelog.sources.events.bind_events, `GRAPH` that of its causes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.engine import Engine
from tidelog.functions import morton, vectors
from tidelog.model import ENTITY, EntityId, EventId, TimeRange
from tidelog.operators import admit, branches, causal, evolve, index, knowledge, replay, runtime, scan, transform
from tidelog.plans.compile import scan_frame, spatial_frame
from tidelog.plans.ir import SpatialScan
from tidelog.plans.parse import parse
from tidelog.sources.events import SCHEMA_IDS, bind_events, choose_encoding, columnar_export, table, with_causes

QUERIES: dict = {}
ORACLES: dict = {}

EV = f"""ev AS (SELECT 1::BIGINT AS source, 1::BIGINT AS epoch, event_id AS sequence, user_id % 8 AS shard, user_id AS slot, 0::BIGINT AS generation,
  CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SCHEMA_IDS.items())} END::BIGINT AS schema_id, 1::BIGINT AS valid_clock,
  epoch_us(ts) - (event_id % 7) * 60000000 AS valid_ticks, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) END AS observed_ticks, 1::BIGINT AS known_clock, epoch_us(ts) AS known_ticks,
  'v=' || round(value, 2)::DECIMAL(20,2)::VARCHAR AS payload, value, (props->>'$.k')::BIGINT AS k, event_type FROM events)"""
GRAPH = """links0 AS (SELECT sequence AS effect, lag(sequence) OVER (PARTITION BY shard, slot, generation ORDER BY sequence) AS cause FROM ev
  UNION SELECT sequence, sequence // 2 FROM ev WHERE sequence > 0),
links AS (SELECT DISTINCT cause, effect FROM links0 WHERE cause IS NOT NULL)"""


def query(sql: str | None):
    """Register a function under its name, with its oracle (None: SQL cannot express it)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _mid(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """First and last known tick, and the last sequence, of the log."""
    r = bind_events(spark, sf_dir).agg(F.min("known_ticks"), F.max("known_ticks"), F.max("sequence")).first()
    return r[0], r[1], r[2]


#: A fixed window that lies within the data at every scale: from a tenth to nine tenths of the known times.
SPAN = "span AS (SELECT min(known_ticks) + (max(known_ticks) - min(known_ticks)) // 10 AS a, min(known_ticks) + (max(known_ticks) - min(known_ticks)) // 10 * 9 AS b, max(sequence) AS n FROM ev)"


def _span(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    low, high, last = _mid(spark, sf_dir)
    tenth = (high - low) // 10
    return low + tenth, low + tenth * 9, last


PSEUDO = "shard || ':' || slot || ':' || generation AS entity, schema_id AS schema, valid_ticks AS valid_time, known_ticks AS known_time, sequence"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bitemporal slice of one entity, in SQL."""
    a, b, _ = _span(spark, sf_dir)
    text = f"SELECT entity, valid_time, sequence FROM events WHERE entity = '#2:10:0' AND valid_time >= {a} AND valid_time < {b} AND known_as_of = {b} LIMIT 32"
    return Engine(spark, bind_events(spark, sf_dir)).query(text).rows


@query(f"WITH {EV}, {SPAN} SELECT shard || ':' || slot || ':' || generation AS entity, valid_ticks AS valid_time, sequence FROM ev, span WHERE shard = 2 AND slot = 10 AND valid_ticks >= a AND valid_ticks < b AND known_ticks <= b ORDER BY sequence LIMIT 32")
def scan_sql(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"WITH {EV}, {SPAN} SELECT sequence, known_ticks AS known_time FROM ev, span WHERE shard = 3 AND slot = 11 AND valid_ticks >= a AND valid_ticks < b AND known_ticks <= b AND schema_id > 1")
def scan_lines(spark, sf_dir):
    a, b, _ = _span(spark, sf_dir)
    return Engine(spark, bind_events(spark, sf_dir)).query(f"FROM log\nENTITY 3:11:0\nTIME valid {a}..{b}\nKNOWN_AS_OF {b}\nWHERE schema > 1\nSELECT sequence, known_time").rows


@query(f"WITH {EV}, {SPAN} SELECT valid_ticks AS valid_time, sequence FROM ev, span WHERE shard = 1 AND slot = 9 AND valid_ticks >= a AND valid_ticks < b AND known_ticks <= b AND schema_id = 5 ORDER BY sequence LIMIT 20")
def scan_compact(spark, sf_dir):
    a, b, _ = _span(spark, sf_dir)
    return Engine(spark, bind_events(spark, sf_dir)).query(f"tn:#1:9:0@v{a}..{b}@k{b}?schema=5>valid_time,sequence!20").rows


@query(f"WITH {EV}, {SPAN} SELECT {PSEUDO} FROM ev, span WHERE valid_ticks >= a AND valid_ticks < b")
def scan_valid_slice(spark, sf_dir):
    a, b, _ = _span(spark, sf_dir)
    return scan_frame(bind_events(spark, sf_dir), parse(f"TIME valid {a}..{b}"))


@query(f"WITH {EV}, {SPAN} SELECT {PSEUDO} FROM ev, span WHERE known_ticks <= a")
def scan_known_as_of(spark, sf_dir):
    a, _, _ = _span(spark, sf_dir)
    return scan_frame(bind_events(spark, sf_dir), parse(f"KNOWN_AS_OF {a}"))


@query(f"WITH {EV}, {SPAN} SELECT {PSEUDO} FROM ev, span WHERE valid_ticks > a AND valid_ticks <= b")
def scan_open_bounds(spark, sf_dir):
    a, b, _ = _span(spark, sf_dir)
    return scan_frame(bind_events(spark, sf_dir), parse(f"SELECT * FROM log WHERE valid_time > {a} AND valid_time <= {b}"))


@query(f"WITH {EV}, {SPAN} SELECT sequence, observed_ticks FROM ev, span WHERE observed_ticks >= a AND observed_ticks < b")
def scan_observed(spark, sf_dir):
    a, b, _ = _span(spark, sf_dir)
    return scan.axis_slice(bind_events(spark, sf_dir), "observed", a, b).select("sequence", "observed_ticks")


@query(f"WITH {EV} SELECT {PSEUDO} FROM ev WHERE schema_id = 3")
def scan_schema(spark, sf_dir):
    return scan_frame(bind_events(spark, sf_dir), parse("SELECT * FROM log WHERE schema = 3"))


@query(f"WITH {EV} SELECT sequence, k FROM ev WHERE schema_id = 1 OR (schema_id = 3 AND NOT (value <= 50.0)) OR k >= 90")
def scan_filter_bool(spark, sf_dir):
    return scan_frame(bind_events(spark, sf_dir), parse("SELECT sequence, k FROM log WHERE schema = 1 OR (schema == 3 && !(value <= 50.0)) OR k >= 90"))


@query(f"WITH {EV} SELECT sequence FROM ev WHERE k > 5")
def scan_type_mismatch(spark, sf_dir):
    return scan_frame(bind_events(spark, sf_dir), parse("SELECT sequence FROM log WHERE schema != 'x' AND NOT (sequence = 1.5) AND k > 5"))


@query(f"WITH {EV} SELECT {PSEUDO} FROM ev WHERE schema_id = 2 ORDER BY sequence LIMIT 7")
def scan_limit(spark, sf_dir):
    return scan_frame(bind_events(spark, sf_dir), parse("SELECT * FROM log WHERE schema = 2 LIMIT 7"))


@query(f"WITH {EV} SELECT sequence, schema_id AS schema FROM (SELECT * FROM ev ORDER BY sequence LIMIT 50) WHERE schema_id = 2")
def scan_limit_compat(spark, sf_dir):
    return scan_frame(bind_events(spark, sf_dir), parse("WHERE schema = 2\nSELECT sequence, schema, missing\nLIMIT 50"), compat=True)


@query(f"WITH {EV} SELECT sequence, known_ticks FROM ev WHERE slot % 8 = 5 AND shard = 5 AND slot = 13 ORDER BY sequence LIMIT 5 OFFSET 5")
def scan_page2(spark, sf_dir):
    flt = scan.HistoryFilter(EntityId(5, 13, 0))
    events = bind_events(spark, sf_dir)
    first = scan.page(events, flt, 5)
    rows = scan.page(events, flt, 5, first.cursor).rows if first.cursor else first.rows.limit(0)
    return rows.select("sequence", "known_ticks")


@query(f"WITH {EV} SELECT sequence, slot, schema_id, payload FROM ev WHERE sequence = 123")
def point_get(spark, sf_dir):
    return scan.point(bind_events(spark, sf_dir), EventId(1, 1, 123)).select("sequence", "slot", "schema_id", F.decode("payload", "UTF-8").alias("payload"))


@query(f"WITH {EV} SELECT sequence, shard, slot, generation, schema_id, valid_ticks, known_ticks FROM ev")
def columnar(spark, sf_dir):
    return columnar_export(bind_events(spark, sf_dir))


@query(f"WITH {EV}, p AS (SELECT sequence, valid_ticks, lag(valid_ticks) OVER (ORDER BY sequence) AS previous_ticks FROM ev) SELECT sequence, previous_ticks, valid_ticks AS known_ticks FROM p WHERE previous_ticks > valid_ticks")
def admission_regressions(spark, sf_dir):
    """Valid times as if they were known times: where an append would be rejected."""
    events = bind_events(spark, sf_dir)
    return admit.regressions(events.withColumn("known_ticks", F.col("valid_ticks")), span=997)


@query(f"WITH {EV} SELECT source, epoch, min(sequence) AS first, max(sequence) AS last, count(*) AS records, true AS contiguous FROM ev GROUP BY source, epoch")
def admission_contiguous(spark, sf_dir):
    return admit.is_contiguous(bind_events(spark, sf_dir))


@query(f"WITH {EV} SELECT schema_id, count(*) AS late, max(known_ticks - valid_ticks) AS most FROM ev WHERE valid_ticks < known_ticks GROUP BY schema_id")
def late_evidence(spark, sf_dir):
    return admit.late_evidence(bind_events(spark, sf_dir)).groupBy("schema_id").agg(F.count(F.lit(1)).alias("late"), F.max(F.col("known_ticks") - F.col("valid_ticks")).alias("most"))


@query(f"WITH {EV}, {SPAN} SELECT shard, slot, generation, max(sequence) AS sequence, arg_max(schema_id, sequence) AS schema_id, arg_max(payload, sequence) AS payload FROM ev, span WHERE sequence <= n // 2 GROUP BY shard, slot, generation")
def state_raw(spark, sf_dir):
    events = bind_events(spark, sf_dir)
    _, _, last = _span(spark, sf_dir)
    return replay.raw_state(events, last // 2).select(*ENTITY, "sequence", "state.schema_id", F.decode("state.payload", "UTF-8").alias("payload"))


def _updates(events: DataFrame) -> DataFrame:
    """Errors delete the entity; other events set a few fields, some to null."""
    amount = F.when(F.col("sequence") % 11 == 0, F.lit(None)).otherwise(F.format_string("%.2f", F.col("value")))
    fields = F.when(F.col("schema_id") == 5, F.create_map(F.lit("k"), F.col("k").cast("string"))).otherwise(F.create_map(F.lit("amount"), amount, F.lit("k"), F.col("k").cast("string")))
    return events.select(*ENTITY, "sequence", "schema_id", F.when(F.col("schema_id") == 2, "delete").otherwise("upsert").alias("op"), fields.alias("fields"))


FIELDS = """live AS (SELECT e.* FROM ev e JOIN (SELECT slot, max(CASE WHEN schema_id = 2 THEN sequence END) AS barrier FROM ev GROUP BY slot) b USING (slot) WHERE schema_id <> 2 AND (barrier IS NULL OR sequence > barrier)),
firsts AS (SELECT shard, slot, generation, arg_min(schema_id, sequence) AS schema_id FROM live GROUP BY ALL),
sets AS (SELECT shard, slot, generation, sequence, 'k' AS field, k::VARCHAR AS value FROM live UNION ALL SELECT shard, slot, generation, sequence, 'amount', CASE WHEN sequence % 11 <> 0 THEN printf('%.2f', value) END FROM live WHERE schema_id <> 5)"""


@query(f"WITH {EV}, {FIELDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY shard, slot, generation, field ORDER BY sequence DESC) AS r FROM sets) SELECT shard, slot, generation, schema_id, field, value, sequence, value IS NULL AS is_null FROM ranked JOIN firsts USING (shard, slot, generation) WHERE r = 1")
def state_schema(spark, sf_dir):
    return replay.schema_state(_updates(bind_events(spark, sf_dir)))


@query(f"WITH {EV}, {FIELDS} SELECT shard, slot, generation FROM sets GROUP BY ALL HAVING arg_max(value IS NULL, sequence) FILTER (field = 'amount') IS DISTINCT FROM false")
def state_incomplete(spark, sf_dir):
    return replay.incomplete(replay.schema_state(_updates(bind_events(spark, sf_dir))), ["amount"])


@query(f"WITH {EV} SELECT shard, slot, generation, max(sequence) AS sequence, arg_max(k, sequence) AS state FROM ev GROUP BY shard, slot, generation")
def state_from_checkpoint(spark, sf_dir):
    events = bind_events(spark, sf_dir)
    _, _, last = _span(spark, sf_dir)
    checkpoint = replay.latest_checkpoint([last // 4, last // 2, last + 1], last)
    state = replay.raw_state(events, checkpoint, F.col("k"))
    return replay.state_from_checkpoint(state, checkpoint, events, last, F.col("k"))


@query(f"WITH {EV} SELECT shard, slot, generation, sum(k * (1 + schema_id))::BIGINT AS total, count(*) AS seen FROM ev GROUP BY shard, slot, generation")
def replay_generic(spark, sf_dir):
    """A user's reducer, folded over each entity's events."""

    def step(state, event):
        state = state or {"total": 0, "seen": 0}
        return {"total": state["total"] + int(event["k"]) * (1 + int(event["schema_id"])), "seen": state["seen"] + 1}

    return replay.reduce_entities(bind_events(spark, sf_dir), step, ["k", "schema_id"], "total long, seen long")


@query(f"WITH {EV} SELECT sequence AS target, CASE WHEN sequence >= 40 THEN (sequence - 40) // 170 * 170 + 40 END AS checkpoint FROM ev")
def checkpoint_as_of(spark, sf_dir):
    """The nearest checkpoint at or before every event; checkpoints are at 40, 210, 380 and so on."""
    targets = bind_events(spark, sf_dir).select(F.col("sequence").alias("target"))
    return replay.checkpoints_as_of(targets, targets.where("target >= 40 and (target - 40) % 170 = 0").select(F.col("target").alias("checkpoint")))


@query("""WITH h AS (SELECT p_partkey % 8 AS shard, p_partkey % 200 AS slot, (p_partkey % 3)::BIGINT AS generation FROM part), e AS (SELECT user_id % 8 AS shard, user_id AS slot, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS newest FROM events GROUP BY ALL)
SELECT shard, slot, generation, CASE WHEN newest IS NULL OR generation > newest THEN 'unknown' WHEN generation < newest THEN 'stale' ELSE 'current' END AS status FROM h LEFT JOIN e USING (shard, slot)""")
def slab_handles(spark, sf_dir):
    """Handles against current entities; a signup reuses its slot under the next generation."""
    events = bind_events(spark, sf_dir).withColumn("generation", F.when(F.col("event_type") == "signup", 1).otherwise(0))
    k = F.col("p_partkey")
    handles = table(spark, sf_dir, "part").select((k % 8).alias("shard"), (k % 200).alias("slot"), (k % 3).cast("long").alias("generation"))
    return replay.resolve_handles(events, handles)


_M64 = "18446744073709551616::UHUGEINT"


@query(f"""WITH s0 AS (SELECT i::BIGINT AS step, ((42::UHUGEINT + {replay.SplitMix.GAMMA}::UHUGEINT * (i + 2)::UHUGEINT) % {_M64})::UBIGINT AS z FROM range(0, 1000) t(i)),
s1 AS (SELECT step, ((xor(z, z >> 30)::UHUGEINT * {replay.SplitMix.FIRST}::UHUGEINT) % {_M64})::UBIGINT AS z FROM s0),
s2 AS (SELECT step, ((xor(z, z >> 27)::UHUGEINT * {replay.SplitMix.SECOND}::UHUGEINT) % {_M64})::UBIGINT AS z FROM s1)
SELECT step, (xor(z, z >> 31) >> 11)::DOUBLE / {1 << 53} AS value FROM s2""")
def random_stream(spark, sf_dir):
    return replay.random_stream(spark, 42, 1000)


@query(f"WITH {EV} SELECT sequence // 250 AS block, count(*) AS records, min(sequence) AS first, max(sequence) AS last, min(valid_ticks) AS valid_min, max(valid_ticks) AS valid_max, min(known_ticks) AS known_min, max(known_ticks) AS known_max, min(shard) AS shard_min, max(shard) AS shard_max, bit_or(1::BIGINT << schema_id::INT) AS schema_mask FROM ev GROUP BY block")
def block_summary(spark, sf_dir):
    blocks = index.block_summaries(bind_events(spark, sf_dir), F.expr("sequence div 250"))
    return blocks.select("block", "records", "first", "last", "valid_min", "valid_max", "known_min", "known_max", F.col("entity_min.shard").alias("shard_min"), F.col("entity_max.shard").alias("shard_max"), "schema_mask")


@query(f"""WITH {EV} SELECT sequence // 2500 AS segment, count(DISTINCT sequence // 250) AS blocks, count(*) AS records, min(sequence) AS first, max(sequence) AS last, min(valid_ticks) AS valid_min, max(valid_ticks) AS valid_max, min(known_ticks) AS known_min, max(known_ticks) AS known_max,
  min(valid_clock) AS valid_clock_min, max(known_clock) AS known_clock_max, min(shard * 1000000 + slot) AS entity_min, max(shard * 1000000 + slot) AS entity_max, bit_or(1::BIGINT << schema_id::INT) AS schema_mask FROM ev GROUP BY segment""")
def segment_summary(spark, sf_dir):
    blocks = index.block_summaries(bind_events(spark, sf_dir), F.expr("sequence div 250"))
    out = index.segment_summaries(blocks, F.expr("block div 10")).withColumn("records", F.col("records").cast("long"))
    ends = {f"entity_{n}": F.col(f"entity_{n}.shard") * 1000000 + F.col(f"entity_{n}.slot") for n in ("min", "max")}
    return out.withColumns(ends).drop("valid_clock_max", "known_clock_min")


@query(f"WITH {EV}, {SPAN} SELECT sequence, slot FROM ev, span WHERE shard = 5 AND slot = 13 AND known_ticks <= b")
def segment_pruning(spark, sf_dir):
    """A scan through the Bloom filters and ranges of segments; equal to the full scan."""
    _, b, _ = _span(spark, sf_dir)
    events = bind_events(spark, sf_dir)
    segments = index.segment_summaries(index.block_summaries(events, F.expr("sequence div 250"), bloom=True), F.expr("block div 4")).withColumnRenamed("segment", "block")
    return index.pruned_history(events, F.expr("sequence div 250 div 4"), segments, scan.HistoryFilter(EntityId(5, 13, 0), known_as_of=b)).select("sequence", "slot")


@query(f"WITH {EV}, {SPAN} SELECT sequence, slot FROM ev, span WHERE shard = 4 AND slot = 12 AND valid_ticks >= a AND valid_ticks < b AND known_ticks <= b")
def block_pruning(spark, sf_dir):
    """A scan through block summaries with Bloom filters; equal to the full scan."""
    a, b, _ = _span(spark, sf_dir)
    events, block = bind_events(spark, sf_dir), F.expr("sequence div 250")
    flt = scan.HistoryFilter(EntityId(4, 12, 0), "valid", TimeRange(a, b), b)
    return index.pruned_history(events, block, index.block_summaries(events, block, bloom=True), flt).select("sequence", "slot")


def _interleave_sql(x: str, y: str, bits: int) -> str:
    return " | ".join(f"((({x} >> {i}) & 1) << {2 * i}) | ((({y} >> {i}) & 1) << {2 * i + 1})" for i in range(bits))


@query(f"WITH {EV} SELECT sequence, {_interleave_sql('slot', 'sequence', 30)} AS code, slot AS x, sequence AS y FROM ev")
def morton2d(spark, sf_dir):
    code = morton.encode2(F.col("slot"), F.col("sequence"))
    x, y = morton.decode2(F.col("code"))
    return bind_events(spark, sf_dir).select("sequence", code.alias("code")).select("sequence", "code", x.alias("x"), y.alias("y"))


@query("WITH p AS (SELECT event_id AS sequence, event_id & 2097151 AS x, user_id & 2097151 AS y, (event_id % 1000)::BIGINT AS z FROM events) SELECT sequence, " + " | ".join(f"(((x >> {i}) & 1) << {3 * i}) | (((y >> {i}) & 1) << {3 * i + 1}) | (((z >> {i}) & 1) << {3 * i + 2})" for i in range(20)) + " AS code, x, y, z FROM p")
def morton3d(spark, sf_dir):
    e = bind_events(spark, sf_dir)
    code = morton.encode3(F.col("sequence"), F.col("slot"), F.col("sequence") % 1000)
    x, y, z = morton.decode3(F.col("code"))
    return e.select("sequence", code.alias("code")).select("sequence", "code", x.alias("x"), y.alias("y"), z.alias("z"))


@query("SELECT event_id AS sequence FROM events WHERE user_id BETWEEN 20 AND 75 AND event_id % 500 BETWEEN 100 AND 300")
def bbox_scan(spark, sf_dir):
    """Exact box, behind the chunk intervals that find it."""
    e = bind_events(spark, sf_dir).withColumn("y", F.col("sequence") % 500)
    near = index.in_chunks(e, ("slot", "y"), (20, 100), (75, 300), 16)
    return near.where(morton.in_box([F.col("slot"), F.col("y")], [20, 100], [75, 300])).select("sequence")


@query("SELECT event_id AS sequence FROM events WHERE user_id // 16 BETWEEN 20 // 16 AND 75 // 16 AND (event_id % 500) // 16 BETWEEN 100 // 16 AND 300 // 16")
def bbox_chunk(spark, sf_dir):
    e = bind_events(spark, sf_dir)
    e = e.withColumn("chunk_code", index.chunk_code(F.col("slot"), F.col("sequence") % 500, 16))
    return spatial_frame(e, SpatialScan(((20, 100), (75, 300)))).select("sequence")


@query(f"WITH {EV} SELECT shard, slot, generation, sequence // 4000 AS span, string_agg(sequence::VARCHAR, ',' ORDER BY sequence) AS sequences FROM ev GROUP BY ALL")
def posting_entity(spark, sf_dir):
    return index.by_entity(bind_events(spark, sf_dir), 4000).withColumn("sequences", F.concat_ws(",", F.col("sequences").cast("array<string>")))


@query(f"WITH p AS (SELECT event_id AS sequence, user_id // 16 AS cx, (event_id % 500) // 16 AS cy FROM events) SELECT {_interleave_sql('cx', 'cy', 20)} AS chunk_code, sequence // 4000 AS span, string_agg(sequence::VARCHAR, ',' ORDER BY sequence) AS sequences FROM p GROUP BY ALL")
def posting_chunk(spark, sf_dir):
    e = bind_events(spark, sf_dir).withColumns({"x": F.col("slot"), "y": F.col("sequence") % 500})
    return index.by_chunk(e, "x", "y", 16, 4000).withColumn("sequences", F.concat_ws(",", F.col("sequences").cast("array<string>")))


@query(f"WITH {EV}, {SPAN} SELECT sequence FROM ev, span WHERE valid_ticks BETWEEN a AND b")
def posting_time(spark, sf_dir):
    a, b, _ = _span(spark, sf_dir)
    return index.at_times(bind_events(spark, sf_dir), 1, a, b)


@query(f"WITH {EV} SELECT schema_id, sequence // 4000 AS span, count(*) AS n, md5(string_agg(sequence::VARCHAR, ',' ORDER BY sequence)) AS digest FROM ev GROUP BY schema_id, span")
def posting_schema(spark, sf_dir):
    lists = index.by_schema(bind_events(spark, sf_dir), 4000)
    return lists.select("schema_id", "span", F.size("sequences").cast("long").alias("n"), F.md5(F.concat_ws(",", F.col("sequences").cast("array<string>")).cast("binary")).alias("digest"))


@query(f"WITH {EV}, {SPAN} SELECT sequence FROM ev, span WHERE shard = 6 AND schema_id = 5 AND valid_ticks BETWEEN a AND b AND slot // 16 BETWEEN 0 AND 6 AND (sequence % 500) // 16 BETWEEN 0 AND 25 AND slot = 14")
def projection_intersect(spark, sf_dir):
    a, b, _ = _span(spark, sf_dir)
    e = bind_events(spark, sf_dir).withColumns({"x": F.col("slot"), "y": F.col("sequence") % 500})
    return index.intersect(e, EntityId(6, 14, 0), 5, TimeRange(a, b), ((0, 0), (100, 400)), 16)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal.edges(with_causes(bind_events(spark, sf_dir)))


@query(f"WITH {EV}, {GRAPH} SELECT cause, effect FROM links")
def causal_edges(spark, sf_dir):
    return _graph(spark, sf_dir)


@query(f"WITH {EV}, {GRAPH} SELECT cause FROM links WHERE effect = 400")
def causes_direct(spark, sf_dir):
    return causal.causes_of(_graph(spark, sf_dir), 400)


@query(f"WITH {EV}, {GRAPH} SELECT effect FROM links WHERE cause = 5")
def effects_direct(spark, sf_dir):
    return causal.effects_of(_graph(spark, sf_dir), 5)


def _walk_sql(root: str, here: str, there: str, depth: int) -> str:
    return f"walk AS (SELECT {root}::BIGINT AS node, 0 AS depth UNION SELECT l.{there}, w.depth + 1 FROM walk w JOIN links l ON l.{here} = w.node WHERE w.depth < {depth})"


@query(f"WITH RECURSIVE {EV}, {GRAPH}, {_walk_sql('900', 'effect', 'cause', 6)} SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def trace_causes(spark, sf_dir):
    events = with_causes(bind_events(spark, sf_dir))
    return Engine(spark, events).query("tn:$1:1:900<-6").rows


@query(f"WITH RECURSIVE {EV}, {GRAPH}, {_walk_sql('3', 'cause', 'effect', 4)} SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def trace_effects(spark, sf_dir):
    events = with_causes(bind_events(spark, sf_dir))
    return Engine(spark, events).query("EVENT 1:1:3 TRACE EFFECTS DEPTH 4").rows


@query(f"WITH RECURSIVE {EV}, {GRAPH}, {_walk_sql('900', 'effect', 'cause', 3)}, seen AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node) SELECT cause, effect FROM links JOIN seen ON node = effect WHERE depth < 3")
def trace_edges(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return causal.traced_edges(graph, causal.trace(graph, 900, "causes", 3), 3)


@query(f"WITH RECURSIVE {EV}, {GRAPH}, {_walk_sql('900', 'effect', 'cause', 1 << 30).replace(', 0 AS depth', '').replace(', w.depth + 1', '').split(' WHERE w.depth')[0]}), pairs AS (SELECT * FROM (VALUES (3), (450), (449), (901), (900)) t(event)) SELECT event::BIGINT AS event, event IN (SELECT node FROM walk) AS ancestor FROM pairs")
def is_ancestor(spark, sf_dir):
    """Whether each of some events is among the causes of event 900, however far."""
    graph = _graph(spark, sf_dir).persist()
    out = spark.createDataFrame([(e, causal.is_ancestor(graph, e, 900)) for e in (3, 450, 449, 901, 900)], "event long, ancestor boolean")
    graph.unpersist()
    return out


LEVELS = "walk AS (SELECT sequence AS node, 0 AS level FROM ev WHERE sequence NOT IN (SELECT effect FROM links) UNION SELECT l.effect, w.level + 1 FROM walk w JOIN links l ON l.cause = w.node), levels AS (SELECT node, max(level) AS level FROM walk GROUP BY node)"


@query(f"WITH RECURSIVE {EV}, {GRAPH}, {LEVELS} SELECT node, level, row_number() OVER (ORDER BY level, node) - 1 AS place FROM levels")
def topo_order(spark, sf_dir):
    """Every event after all its declared causes."""
    events = with_causes(bind_events(spark, sf_dir))
    return causal.topological_order(causal.edges(events), events.select(F.col("sequence").alias("node")), 1000)


@query(f"WITH RECURSIVE {EV}, {GRAPH}, {LEVELS} SELECT node, level FROM levels")
def topo_levels(spark, sf_dir):
    events = with_causes(bind_events(spark, sf_dir))
    return causal.topological_levels(causal.edges(events), events.select(F.col("sequence").alias("node")))


@query(f"WITH {EV}, {GRAPH}, r AS (SELECT effect, string_agg(cause::VARCHAR, ',' ORDER BY cause) AS causes, count(*) AS n FROM links GROUP BY effect) SELECT effect, causes, coalesce(sum(n) OVER (ORDER BY effect ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r")
def csr(spark, sf_dir):
    return causal.csr(_graph(spark, sf_dir), 1000).withColumn("causes", F.concat_ws(",", F.col("causes").cast("array<string>")))


@query(f"""WITH RECURSIVE {EV}, {GRAPH}, act AS (SELECT min(sequence) AS s FROM ev WHERE schema_id = 3 AND sequence >= 500), {_walk_sql('(SELECT s FROM act)', 'effect', 'cause', 32)},
nodes AS (SELECT CASE schema_id WHEN 5 THEN 'percept' WHEN 1 THEN 'intention' WHEN 4 THEN 'belief' END AS kind, sequence, valid_ticks AS ticks FROM ev WHERE sequence IN (SELECT node FROM walk) AND sequence <> (SELECT s FROM act))
SELECT * FROM nodes WHERE kind IS NOT NULL
UNION ALL SELECT 'gap: ' || step, NULL, (SELECT known_ticks FROM ev, act WHERE sequence = s) - back FROM (VALUES ('percept', 'perception', 10), ('intention', 'intention selection', 2)) r(kind, step, back) WHERE kind NOT IN (SELECT kind FROM nodes WHERE kind IS NOT NULL)
UNION ALL SELECT 'action', s, known_ticks FROM act JOIN ev ON sequence = s
UNION ALL SELECT 'outcome', sequence, valid_ticks FROM ev WHERE schema_id = 2 AND sequence IN (SELECT effect FROM links, act WHERE cause = s)""")
def action_trace(spark, sf_dir):
    events = with_causes(bind_events(spark, sf_dir))
    action = events.where("schema_id = 3 and sequence >= 500").agg(F.min("sequence")).first()[0]
    return causal.action_trace(events, causal.edges(events).persist(), action, {"percept": 5, "intention": 1, "action": 3, "outcome": 2, "belief": 4, "gap": 6})


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch for each region off the main line, and one for each nation of region 2 off that region's branch."""
    known = branches.open_branches(spark)
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        known = branches.fork(known, r["r_name"], 0, 100 * (r["r_regionkey"] + 1), 1000)
    for n in table(spark, sf_dir, "nation").where("n_regionkey = 2").orderBy("n_nationkey").collect():
        known = branches.fork(known, n["n_name"], 3, 400 + n["n_nationkey"], 1000)
    return branches.set_lifecycle(branches.set_lifecycle(known, 1, "candidate"), 2, "retired")


BRANCHES = """branches AS (SELECT 0::BIGINT AS id, 'main' AS name, NULL::BIGINT AS parent, NULL::BIGINT AS fork_sequence UNION ALL SELECT r_regionkey + 1, r_name, 0, 100 * (r_regionkey + 1) FROM region
  UNION ALL SELECT 5 + row_number() OVER (ORDER BY n_nationkey), n_name, 3, 400 + n_nationkey FROM nation WHERE n_regionkey = 2)"""
LINE = """chain AS (SELECT id, parent, fork_sequence, NULL::BIGINT AS until FROM branches WHERE id = (SELECT max(id) FROM branches) UNION ALL SELECT b.id, b.parent, b.fork_sequence, c.fork_sequence FROM chain c JOIN branches b ON b.id = c.parent),
timeline AS (SELECT id AS branch, coalesce(fork_sequence + 1, 0) AS first, until AS last FROM chain)"""
#: A third of the events on the main line, on region 2's branch and on that of its last nation.
OWNED = "owned AS (SELECT *, CASE WHEN sequence % 3 = 0 THEN 0 WHEN sequence % 3 = 1 THEN 3 ELSE (SELECT max(id) FROM branches) END AS branch FROM ev)"
ON_LINE = "owned o JOIN timeline t ON o.branch = t.branch AND sequence >= first AND (last IS NULL OR sequence <= last)"


@query(f"WITH {BRANCHES} SELECT id, name, parent, CASE id WHEN 1 THEN 'candidate' WHEN 2 THEN 'retired' ELSE 'active' END AS lifecycle FROM branches")
def branch_list(spark, sf_dir):
    return _branches(spark, sf_dir).select("id", "name", "parent", "lifecycle")


def _timeline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    known = _branches(spark, sf_dir)
    last = known.agg(F.max("id")).first()[0]
    return branches.timeline(known, last), last


@query(f"WITH RECURSIVE {BRANCHES}, {LINE} SELECT branch, first, last FROM timeline")
def timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)[0]


@query(f"""WITH RECURSIVE {BRANCHES}, up AS (SELECT b.id, b.parent, b.fork_sequence AS until FROM branches b WHERE id <> 2 AND parent IS NOT NULL UNION ALL SELECT u.id, b.parent, least(u.until, b.fork_sequence) FROM up u JOIN branches b ON b.id = u.parent WHERE b.parent IS NOT NULL)
SELECT DISTINCT u.parent AS branch, coalesce(b.fork_sequence + 1, 0) AS first, until AS last FROM up u JOIN branches b ON b.id = u.parent WHERE coalesce(b.fork_sequence + 1, 0) <= until""")
def branch_holds(spark, sf_dir):
    return runtime.branch_holds(_branches(spark, sf_dir))


def _owned(spark: SparkSession, sf_dir: str, last: int) -> DataFrame:
    third = F.col("sequence") % 3
    return bind_events(spark, sf_dir).withColumn("branch", F.when(third == 0, 0).when(third == 1, 3).otherwise(last).cast("long"))


@query(f"WITH RECURSIVE {EV}, {BRANCHES}, {LINE}, {OWNED} SELECT sequence, o.branch FROM {ON_LINE}")
def branch_scan(spark, sf_dir):
    line, last = _timeline(spark, sf_dir)
    return branches.branch_events(_owned(spark, sf_dir, last), line).select("sequence", "branch")


@query(f"WITH RECURSIVE {EV}, {BRANCHES}, {LINE}, {OWNED} SELECT shard, slot, generation, max(sequence) AS sequence, arg_max(k, sequence) AS state FROM {ON_LINE} WHERE sequence <= 800 GROUP BY shard, slot, generation")
def branch_state(spark, sf_dir):
    line, last = _timeline(spark, sf_dir)
    return replay.raw_state(branches.branch_events(_owned(spark, sf_dir, last), line), 800, F.col("k"))


@query(f"WITH {EV}, {BRANCHES}, {OWNED}, start AS (SELECT greatest(max(sequence), (SELECT fork_sequence FROM branches WHERE id = 4)) AS s FROM owned WHERE branch = 4) SELECT 4::BIGINT AS branch, coalesce(s, (SELECT fork_sequence FROM branches WHERE id = 4)) + row_number() OVER (ORDER BY p_partkey) AS sequence, p_partkey AS known_ticks FROM part, start")
def branch_append(spark, sf_dir):
    """Parts recorded as a batch of events on region 3's branch, numbered after its fork."""
    known = _branches(spark, sf_dir)
    batch = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("known_ticks"))
    grown = branches.append(_owned(spark, sf_dir, 10).select("branch", "sequence", "known_ticks"), known, 4, batch, "known_ticks")
    return grown.where("branch = 4").select("branch", "sequence", "known_ticks")


@query(f"WITH {EV} SELECT sequence, shard % 3 AS vshard, row_number() OVER (PARTITION BY shard % 3 ORDER BY sequence) - 1 AS local_sequence FROM ev")
def shard_route(spark, sf_dir):
    return runtime.partition_sequences(runtime.route(bind_events(spark, sf_dir), 3), span=1000).select("sequence", "vshard", "local_sequence")


@query(f"WITH {EV} SELECT CASE shard WHEN 1 THEN 2 WHEN 5 THEN 1 ELSE 0 END::BIGINT AS vshard, count(*) AS n FROM ev GROUP BY 1")
def shard_route_map(spark, sf_dir):
    return runtime.route(bind_events(spark, sf_dir), 3, {1: 2, 5: 1}).groupBy("vshard").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV}, {SPAN} SELECT shard % 3 AS vshard, valid_ticks, sequence, row_number() OVER (ORDER BY valid_clock, valid_ticks, source, epoch, sequence) - 1 AS place FROM ev, span WHERE schema_id = 4 AND valid_ticks BETWEEN a AND b")
def shard_fanout(spark, sf_dir):
    a, b, _ = _span(spark, sf_dir)
    merged = runtime.fan_out(runtime.route(bind_events(spark, sf_dir), 3), runtime.shard_filter(schema=4, clock=1, low=a, high=b))
    return runtime.merge_places(merged, 3_600_000_000).select("vshard", "valid_ticks", "sequence", "place")


TASKS = "tasks AS (SELECT p_partkey AS id, p_size % 5 AS class, CASE WHEN p_partkey % 3 = 0 THEN 'completed' ELSE 'pending' END AS status FROM part), deps AS (SELECT p_partkey AS id, p_partkey // 2 AS needs FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey - 1 FROM part WHERE p_partkey > 1 AND p_size > 25)"


@query(f"WITH {TASKS} SELECT id, class FROM tasks t WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM deps d WHERE d.id = t.id AND d.needs NOT IN (SELECT id FROM tasks WHERE status = 'completed'))")
def ready_tasks(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tasks = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("class"), F.when(F.col("p_partkey") % 3 == 0, "completed").otherwise("pending").alias("status"))
    later = part.where("p_partkey > 1")
    deps = later.select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("needs")).union(later.where("p_size > 25").select("p_partkey", F.col("p_partkey") - 1))
    return runtime.ready_tasks(tasks, deps.distinct()).select("id", "class")


LEVEL = "CASE WHEN d >= 90 THEN 'critical' WHEN d >= 70 THEN 'high' WHEN d >= 40 THEN 'moderate' ELSE 'normal' END"


@query(f"WITH p AS (SELECT p_partkey AS id, p_size::BIGINT * 100 // 50 AS d, p_partkey % 5 AS class FROM part), l AS (SELECT *, {LEVEL} AS level FROM p) SELECT id, level, level IN ('critical', 'high') AS throttle, CASE level WHEN 'critical' THEN true WHEN 'high' THEN class <> 4 WHEN 'moderate' THEN class <= 2 ELSE false END AS yields FROM l")
def pressure(spark, sf_dir):
    level = runtime.pressure(F.col("p_size").cast("long"), F.lit(50).cast("long"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), level.alias("level"), (F.col("p_partkey") % 5).alias("class"))
    return part.select("id", "level", runtime.should_throttle(F.col("level")).alias("throttle"), runtime.should_yield(F.col("level"), F.col("class")).alias("yields"))


@query("""WITH s AS (SELECT p_partkey AS id, p_size::BIGINT AS bytes, CASE WHEN p_partkey % 3 = 0 THEN 'hot' WHEN p_partkey % 3 = 1 THEN 'warm' WHEN p_partkey % 2 = 0 THEN 'warm' ELSE 'cold' END AS tier, (p_partkey * 7919) % 10007 AS last FROM part),
h AS (SELECT *, CASE WHEN tier = 'hot' AND sum(bytes) OVER (PARTITION BY tier ORDER BY last DESC, id DESC) > 3000 THEN 'warm' ELSE tier END AS t2 FROM s),
w AS (SELECT *, CASE WHEN t2 = 'warm' AND sum(bytes) OVER (PARTITION BY t2 ORDER BY last DESC, id DESC) > 5000 THEN 'cold' ELSE t2 END AS t3 FROM h)
SELECT t3 AS placed, count(*) AS segments, sum(bytes)::BIGINT AS bytes FROM w GROUP BY t3""")
def tier_lru(spark, sf_dir):
    """Cold segments with an even id were read twice and count as warm."""
    k = F.col("p_partkey")
    tier = F.when(k % 3 == 0, "hot").when(k % 3 == 1, "warm").otherwise("cold")
    segments = table(spark, sf_dir, "part").select(k.alias("segment_id"), F.col("p_size").cast("long").alias("bytes"), tier.alias("tier"), F.when(k % 2 == 0, 2).otherwise(1).alias("accesses"), (k * 7919 % 10007).alias("last_access"))
    return runtime.tier_bytes(runtime.place_tiers(segments, 3000, 5000))


HELD = "NOT (sequence BETWEEN 100 AND 200 OR sequence BETWEEN 450 AND 460)"


@query(f"WITH {EV}, {SPAN} SELECT sequence FROM ev, span WHERE (greatest(b - valid_ticks, 0) > (b - a) // 2 OR sequence < n + 1 - n // 3) AND {HELD}")
def reclaimable(spark, sf_dir):
    a, b, last = _span(spark, sf_dir)
    return runtime.reclaimable(bind_events(spark, sf_dir), b, (b - a) // 2, last // 3, [(100, 200), (450, 460)])


@query(f"WITH {EV}, f AS (SELECT sequence // 50 AS frame, min(sequence) AS first, max(sequence) AS last FROM ev GROUP BY 1) SELECT frame, first, last FROM f WHERE frame < 9")
def retire_prefix(spark, sf_dir):
    """Frames of 50; a hold on 455 stops retirement at frame 9."""
    frames = bind_events(spark, sf_dir).groupBy(F.expr("sequence div 50").alias("frame")).agg(F.min("sequence").alias("first"), F.max("sequence").alias("last")).withColumn("sealed", F.lit(True))
    return runtime.retired_prefix(frames, [(455, 455)]).select("frame", "first", "last")


@query(f"WITH {EV} SELECT sequence, sequence // 300 AS segment, sequence // 300 * 300 AS first FROM ev")
def segment_lookup(spark, sf_dir):
    """The segment of every event."""
    events = bind_events(spark, sf_dir)
    manifest = events.groupBy(F.expr("sequence div 300").alias("segment")).agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"))
    return runtime.segment_of(events.select("sequence"), manifest).select("sequence", "segment", "first")


@query(f"WITH {EV} SELECT sequence FROM ev WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey % 40 = 0 AND sequence BETWEEN p_partkey * 3 AND p_partkey * 3 + p_size)")
def held_events(spark, sf_dir):
    """Events that a table of holds covers."""
    holds = table(spark, sf_dir, "part").where("p_partkey % 40 = 0").select((F.col("p_partkey") * 3).alias("first"), (F.col("p_partkey") * 3 + F.col("p_size")).alias("last"))
    return runtime.held(bind_events(spark, sf_dir), holds)


WORDS = "['alive', 'not alive', 'dead', 'door open', 'door closed', 'healthy', 'critical', 'inactive', 'calm', 'not calm']"
WORD = f"CASE WHEN p_partkey % 40 = 0 THEN {WORDS}[(1 + (p_partkey // 40 * 37 + p_size) % 10)::INT] || ' ' || (p_partkey // 400) ELSE CASE WHEN p_size % 3 = 0 THEN 'Not ' ELSE '' END || 'calm ' || (p_partkey // 12) END"
BELIEFS = f"beliefs AS (SELECT p_partkey AS id, {WORD} AS proposition, lower(trim({WORD})) AS p FROM part)"


def _beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part says something: one in forty a word with antonyms, the others that their dozen is calm, or not."""
    words = F.array(*[F.lit(w) for w in ("alive", "not alive", "dead", "door open", "door closed", "healthy", "critical", "inactive", "calm", "not calm")])
    k = F.col("p_partkey")
    word = F.concat_ws(" ", F.get(words, ((F.expr("p_partkey div 40") * 37 + F.col("p_size")) % 10).cast("int")), F.expr("p_partkey div 400").cast("string"))
    calm = F.concat(F.when(F.col("p_size") % 3 == 0, "Not ").otherwise(""), F.lit("calm "), F.expr("p_partkey div 12").cast("string"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 40 == 0, word).otherwise(calm).alias("proposition"))


CLASH = "(a.p = 'not ' || b.p OR b.p = 'not ' || a.p" + "".join(f" OR (contains(a.p, '{x}') AND contains(b.p, '{y}')) OR (contains(a.p, '{y}') AND contains(b.p, '{x}'))" for x, y in knowledge.ANTONYMS) + ")"


@query(f"WITH {BELIEFS} SELECT a.id AS item_a, b.id AS item_b FROM beliefs a JOIN beliefs b ON a.id < b.id AND {CLASH}")
def contradictions(spark, sf_dir):
    return knowledge.contradictions(_beliefs(spark, sf_dir))


@query(f"""WITH RECURSIVE {BELIEFS}, pairs AS (SELECT CASE WHEN contains(a.p, 'calm') THEN regexp_extract(a.p, '[0-9]+$') ELSE 'words' END AS part, a.id AS item_a, b.id AS item_b FROM beliefs a JOIN beliefs b ON a.id < b.id AND {CLASH}),
steps AS (SELECT part, item_b AS id, list(item_a) AS earlier, row_number() OVER (PARTITION BY part ORDER BY item_b) AS n FROM pairs GROUP BY part, item_b),
fold AS (SELECT DISTINCT part, 0::BIGINT AS n, []::BIGINT[] AS marked FROM steps UNION ALL SELECT f.part, s.n, CASE WHEN len(list_filter(s.earlier, lambda x: NOT list_contains(f.marked, x))) > 0 THEN list_concat(f.marked, list_concat(list_filter(s.earlier, lambda x: NOT list_contains(f.marked, x)), [s.id])) ELSE f.marked END FROM fold f JOIN steps s ON s.part = f.part AND s.n = f.n + 1),
ends AS (SELECT part, unnest(arg_max(marked, n)) AS id FROM fold GROUP BY part)
SELECT id, CASE WHEN id IN (SELECT id FROM ends) THEN 'contradicted' ELSE 'active' END AS status FROM beliefs""")
def infer_status(spark, sf_dir):
    """The SQL folds each number's calm beliefs, and the words with antonyms, by themselves: no others conflict."""
    return knowledge.infer(_beliefs(spark, sf_dir)).select("id", "status")


PREMISES = "premises AS (SELECT p_partkey AS id, p_partkey // 3 AS premise FROM part WHERE p_partkey >= 3 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey >= 2 AND p_size > 40)"


def _premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    thirds = part.where("p_partkey >= 3").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 3").alias("premise"))
    return thirds.union(part.where("p_partkey >= 2 and p_size > 40").select("p_partkey", F.expr("p_partkey div 2"))).distinct()


@query(f"WITH RECURSIVE {PREMISES}, gone AS (SELECT 7::BIGINT AS node UNION SELECT p.id FROM gone g JOIN premises p ON p.premise = g.node) SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT node FROM gone) THEN 'retracted' ELSE 'active' END AS status FROM part")
def retract_cascade(spark, sf_dir):
    beliefs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("active").alias("status"))
    return knowledge.retract(beliefs, _premises(spark, sf_dir), spark.createDataFrame([(7,)], "node long"))


@query(f"WITH RECURSIVE {PREMISES}, tree AS (SELECT 190::BIGINT AS node, NULL::BIGINT AS parent, 0 AS depth, '190' AS path UNION ALL SELECT p.premise, t.node, t.depth + 1, t.path || '>' || p.premise FROM tree t JOIN premises p ON p.id = t.node WHERE p.premise IN (SELECT p_partkey FROM part)) SELECT * FROM tree")
def why_tree(spark, sf_dir):
    beliefs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return knowledge.why(beliefs, _premises(spark, sf_dir), 190).withColumn("path", F.concat_ws(">", F.col("path").cast("array<string>")))


@query("SELECT p_partkey AS id, p_size::BIGINT AS learned_ticks FROM part WHERE p_partkey % 4 <> 0 AND p_size <= 20")
def beliefs_as_of(spark, sf_dir):
    beliefs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("learned_ticks"), F.when(F.col("p_partkey") % 4 == 0, "retracted").otherwise("active").alias("status"))
    return knowledge.active_as_of(beliefs, 20).select("id", "learned_ticks")


PREDICTED = "p AS (SELECT event_id AS id, value / 100.0 AS confidence, epoch_us(ts) AS emitted, CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts) + 1000000 END AS observed, CASE WHEN lower(event_type) = lower(trim(CASE WHEN event_id % 3 = 0 THEN ' VIEW ' ELSE event_type END)) THEN 1.0 ELSE 0.0 END AS hit FROM events WHERE value <= 100)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value <= 100")
    ticks = F.unix_micros(F.col("ts").cast("timestamp"))
    made = e.select(F.col("event_id").alias("id"), (F.col("value") / 100.0).alias("confidence"), ticks.alias("emitted_ticks"), F.col("event_type").alias("predicted_value"))
    seen = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, " VIEW ").otherwise(F.col("event_type")).alias("observed_value"), (ticks + 1000000).alias("observed_ticks"))
    return knowledge.resolve(made, seen)


@query(f"WITH {PREDICTED} SELECT CASE WHEN observed IS NULL THEN 'pending' WHEN hit = 1 THEN 'matched' ELSE 'refuted' END AS outcome, count(*) AS n FROM p GROUP BY 1")
def prediction_outcomes(spark, sf_dir):
    return _predictions(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV}, {SPAN}, {PREDICTED} SELECT count(*) AS resolved, round(avg((confidence - hit) ^ 2), 6) AS brier FROM p, span WHERE observed IS NOT NULL AND emitted <= b AND observed <= b")
def brier(spark, sf_dir):
    _, b, _ = _span(spark, sf_dir)
    return knowledge.brier(_predictions(spark, sf_dir), b).withColumn("brier", F.round("brier", 6))


@query("SELECT p_partkey AS id, CASE WHEN row_number() OVER (ORDER BY p_size, p_partkey) <= (SELECT count(*) FROM part) - 100 THEN 'archive' ELSE 'active' END AS tier FROM part")
def tier_evict(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("accesses"))
    return knowledge.evict(items, 100).select("id", "tier")


TOP = "SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0"


@query(f"WITH s AS ({TOP}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def topk_cosine(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 50."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    # to six digits as SQL does it: of scores with nine digits, one in a thousand lies half-way
    return vectors.nearest(e, queries, 10).withColumn("score", F.round(F.col("score") * 1e6) / 1e6)


@query("SELECT v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dot, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings v, embeddings q WHERE q.vec_id = 0")
def dot_euclid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    own = e.crossJoin(F.broadcast(q))  # one row
    return own.select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("q")), 6).alias("dot"), F.round(vectors.euclidean(F.col("embedding"), F.col("q")), 6).alias("distance"))


@query(f"WITH {EV} SELECT sequence, 'payload' AS feature, CASE WHEN sequence % 9 <> 0 THEN payload END AS value, 10 + CASE WHEN sequence % 9 = 0 THEN 0 ELSE strlen(payload) END AS steps, 'extract' AS transformation, '1.2.0' AS version, sequence % 9 <> 0 AS success FROM ev")
def transform_lineage(spark, sf_dir):
    """A ninth of the payloads is empty: these fail, and leave lineage."""
    registry = transform.Registry()
    manifest = transform.Manifest("extract", "1.2.0", "event_to_observation")
    registry.register(manifest, transform.event_to_observation)
    events = bind_events(spark, sf_dir).withColumn("payload", F.when(F.col("sequence") % 9 != 0, F.col("payload")))
    out = transform.lineage(registry.apply("extract", events), manifest)
    return out.select("sequence", "feature", "value", "steps", "transformation", "version", "success")


@query("WITH e AS (SELECT o_custkey AS episode, count(*) AS n FROM orders GROUP BY o_custkey) SELECT episode, 50 + 5 * n AS steps, 'ok' AS outcome FROM e")
def episode_lineage(spark, sf_dir):
    episodes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("episode")).agg(F.collect_list("o_orderkey").alias("observations")).withColumn("label", F.lit("orders"))
    return transform.episode_consolidation(episodes, transform.Manifest("consolidate", "1.0.0", "episode_to_pattern")).select("episode", "steps", "outcome")


FIT = "round(0.40 * greatest(1.0 - l_extendedprice / (l_extendedprice * 2), 0.0) + 0.30 * (1.0 - least(greatest(l_quantity * 30 / 1000.0, 0.0), 1.0)) + 0.15 * (1.0 - least(greatest(l_partkey / 10000.0, 0.0), 1.0)) + 0.15 * (1.0 - least(greatest(l_tax * 100, 1.0), 5.0) / 5.0), 6)"


@query(f"SELECT l_orderkey, l_linenumber, {FIT} AS fitness FROM lineitem")
def storage_fitness(spark, sf_dir):
    c = F.col
    score = evolve.storage_fitness(c("l_extendedprice") * 2, c("l_extendedprice"), c("l_quantity") * 30, c("l_partkey"), c("l_tax") * 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("fitness"))


@query("SELECT o_orderkey, round(0.35 * (100.0 - o_custkey % 90) / 100.0 + 0.25 * (1000.0 - o_orderkey % 800) / 1000.0 + 0.25 * 0.0 + 0.15 * 0.5 - 0.10 * (o_custkey % 7 - 3.0), 6) AS benefit FROM orders")
def net_benefit(spark, sf_dir):
    c = F.col
    base = {"latency": F.lit(100.0), "memory": F.lit(1000.0), "storage": F.lit(0.0), "amplification": F.lit(2.0), "background": F.lit(3.0)}
    own = {"latency": c("o_custkey") % 90, "memory": c("o_orderkey") % 800, "storage": F.lit(5.0), "amplification": F.lit(1.0), "background": c("o_custkey") % 7}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(evolve.net_benefit(base, own), 6).alias("benefit"))


@query("SELECT p_partkey AS id, round(CASE WHEN p_size % 10 = 0 THEN 0.0 ELSE greatest((p_size % 10) / ((p_size % 10) + p_partkey % 2)::DOUBLE * 0.9 - (p_partkey % 2) * 0.5, 0.0) END, 6) AS score, round(1.0 / (1.0 + p_size * 100 / 2.0 / 5000.0 + 10.0 * (p_partkey / 1000000.0 / (p_size * 100))), 6) AS checkpoint FROM part")
def rule_score(spark, sf_dir):
    c = F.col
    rule = F.round(evolve.rule_score(c("p_size") % 10, c("p_partkey") % 2, F.lit(0.9)), 6)
    checkpoint = F.round(evolve.checkpoint_score(c("p_size") * 100, F.lit(5000.0), c("p_partkey")), 6)
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), rule.alias("score"), checkpoint.alias("checkpoint"))


@query("SELECT p_partkey AS id, violation FROM part, (VALUES ('no mutation operator', 1), ('no rationale', 2), ('incumbent is not promoted', 3)) v(violation, kind) WHERE (kind = 1 AND p_partkey % 10 = 0) OR (kind = 2 AND p_partkey % 15 = 0) OR (kind = 3 AND p_size = 1 AND p_partkey % 2 = 0)")
def constitution_audit(spark, sf_dir):
    k = F.col("p_partkey")
    candidates = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 10 != 0, "swap").alias("operator"), F.when(k % 15 != 0, "faster").otherwise("").alias("rationale"), F.when(k % 2 == 0, "evaluated").otherwise("promoted").alias("status"), (F.col("p_size") == 1).alias("incumbent"))
    return evolve.audit(candidates)


@query("""WITH m AS (SELECT o_custkey AS block, o_orderpriority AS encoding, sum(o_totalprice)::DOUBLE AS bytes, (o_custkey % 9 * 100000)::DOUBLE AS raw, count(*) * 1000 AS encode_ns, count(*) * 900 AS decode_ns FROM orders GROUP BY ALL),
s AS (SELECT *, bytes + 0.001 * decode_ns + 0.0001 * encode_ns AS score FROM m), b AS (SELECT block, min(score) AS low, arg_min(encoding, score) AS encoding, max(raw) AS raw FROM s GROUP BY block)
SELECT block, CASE WHEN low < raw THEN encoding ELSE 'raw' END AS encoding, round(CASE WHEN low < raw THEN low ELSE raw END, 3) AS score FROM b""")
def encoding_choice(spark, sf_dir):
    """Measured candidates against the raw size, by block."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("block"), F.col("o_orderpriority").alias("encoding"))
    measured = o.agg(F.sum("o_totalprice").alias("bytes"), (F.count(F.lit(1)) * 1000).alias("encode_ns"), (F.count(F.lit(1)) * 900).alias("decode_ns"))
    measured = measured.withColumn("raw_bytes", (F.col("block") % 9 * 100000).cast("double"))
    return choose_encoding(measured).withColumn("score", F.round("score", 3))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def media_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation), t AS (SELECT k, unnest([1, 2, 3, 4]) AS rule FROM n)
SELECT CASE rule WHEN 1 THEN 'NOT NOT slot > ' || k WHEN 2 THEN '(slot = ' || k || ' OR false) AND (slot = ' || k || ' AND true)' WHEN 3 THEN k || ' < ' || (k + 1) || ' AND late' ELSE 'late AND ' || k || ' > ' || (k + 1) END AS condition,
  CASE rule WHEN 1 THEN '(slot > ' || k || ')' WHEN 2 THEN '(slot = ' || k || ')' WHEN 3 THEN 'late' ELSE 'false' END AS simplified, CASE rule WHEN 1 THEN 10 WHEN 2 THEN 23 ELSE 10 END AS cost_before, CASE rule WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 3 THEN 2 ELSE 1 END AS cost_after FROM t""")
def rewrite(spark, sf_dir):
    """Four conditions about each nation's number, simplified."""
    from tidelog.plans.ir import show

    rows = []
    for (k,) in table(spark, sf_dir, "nation").select("n_nationkey").collect():
        for text in (f"NOT NOT slot > {k}", f"(slot = {k} OR false) AND (slot = {k} AND true)", f"{k} < {k + 1} AND late", f"late AND {k} > {k + 1}"):
            r = Engine.rewrite(text)
            rows.append((text, show(r.expr), r.cost_before, r.cost_after))
    return spark.createDataFrame(rows, "condition string, simplified string, cost_before int, cost_after int")


@query("""SELECT 'tn:#' || n_regionkey || ':' || n_nationkey || ':0@v' || n_nationkey || '..' || (n_nationkey + 10) || '?schema=5>sequence!' || (n_regionkey + 1) AS query,
  'StorageScan (cost=10)|  entity=' || n_regionkey || ':' || n_nationkey || ':0|  valid_range=' || n_nationkey || '..' || (n_nationkey + 10) || '|  pushdown_filter=(schema = 5)|  projection=[sequence]|  limit=' || (n_regionkey + 1) || '|  pushdown_zone_maps=true, pushdown_bloom=true' AS plan FROM nation""")
def explain_plan(spark, sf_dir):
    """The logical plan of a query about each nation; Engine.explain puts Spark's own plan under it."""
    from tidelog.plans.compile import explain

    rows = []
    for r, n in table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").collect():
        text = f"tn:#{r}:{n}:0@v{n}..{n + 10}?schema=5>sequence!{r + 1}"
        rows.append((text, "|".join(explain(parse(text)).split("\n"))))
    return spark.createDataFrame(rows, "query string, plan string")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder that executors share: under spark.checkpoint.dir, or, in a local session without one, a temporary one."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query(f"WITH {EV} SELECT shard, slot, generation, max(sequence) AS sequence, arg_max(k, sequence) AS k FROM ev WHERE schema_id = 5 AND sequence >= 100 GROUP BY shard, slot, generation")
def subscribe_state(spark, sf_dir):
    """A subscription over a stored log, read as a stream into the last value of each entity."""
    import uuid

    from tidelog.streaming import subscribe as s

    folder = scratch(spark, "stream")
    bind_events(spark, sf_dir).repartitionByRange(4, "sequence").write.parquet(f"{folder}/log")
    log = spark.read.parquet(f"{folder}/log")
    matches = s.subscription(s.stream_log(spark, f"{folder}/log", log.schema, 2), "WHERE schema = 5", 100)
    name = f"last_{uuid.uuid4().hex}"
    run = s.last_values(matches, "k").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


from tidelog import queries_log  # noqa: E402, F401  (registers the queries about stored logs, admission and control)
