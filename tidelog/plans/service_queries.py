"""Queries over the persistence engine, peers and messages, agents, sessions and byte formats."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import event_log, table
from tidelog.functions import messages, security
from tidelog.operators import agents, bloom, crdt, metrics, peers, sessions, sync
from tidelog.operators.engine import Engine
from tidelog.plans import log_queries
from tidelog.plans.other_queries import SESSIONS, _sessions, _signed, over_log, query
from tidelog.sources.shared import folder
from tidelog.streaming import queries as streams

# --- persistence engine: three batches, by seq % 3 ------------------------------------------------------------------

STORED = "id STRING, hlc BIGINT, originator STRING, group_id STRING, session_id STRING, op STRING, key STRING, value DOUBLE"
BATCHES = 3


def _engine(log: DataFrame, batches: int = BATCHES, **options) -> Engine:
    spark = log.sparkSession
    engine = Engine(spark, folder(spark), STORED, **options)
    for b in range(batches):
        engine.append(log.filter(F.col("seq") % BATCHES == b))
    return engine


over_log("engine_replay", "SELECT id, hlc, group_id, key FROM e")(lambda log: _engine(log).replay().select("id", "hlc", "group_id", "key"))
over_log("engine_sequence", "SELECT count(*) AS n, count(*) AS distinct_seq, 0 AS low, count(*) - 1 AS high FROM e")(
    lambda log: _engine(log).log().agg(F.count("*").alias("n"), F.count_distinct("seq").alias("distinct_seq"), F.min("seq").cast("int").alias("low"), F.max("seq").alias("high")))
over_log("engine_replay_from", "SELECT id FROM e WHERE seq % 3 = 2 AND seq > (SELECT max(seq) FROM e WHERE id = '500')")(lambda log: _engine(log.orderBy("seq")).replay_from("500").select("id"))
over_log("engine_replay_range", f"SELECT id FROM e WHERE hlc BETWEEN {log_queries.T0} AND {log_queries.T1}")(lambda log: _engine(log).replay_range(log_queries.T0, log_queries.T1).select("id"))
over_log("wal_replay", "SELECT id, hlc FROM e")(lambda log: _engine(log).wal().select("id", "hlc"))
over_log("wal_rotation", "SELECT count(*) AS entries FROM e GROUP BY seq % 3")(lambda log: _engine(log, segment_bytes=1).wal_stats().select("entries"))
over_log("wal_retention", "SELECT count(*) AS entries FROM e WHERE seq % 3 > 0 GROUP BY seq % 3")(lambda log: _engine(log, segment_bytes=1, max_segments=2).wal_stats().select("entries"))
over_log("snapshot_list", "SELECT 0 AS event_from, CAST(sum(count(*)) OVER (ORDER BY seq % 3) AS BIGINT) AS event_to FROM e GROUP BY seq % 3 ORDER BY 2 DESC LIMIT 2")(
    lambda log: _engine(log, snapshot_interval=1, retention=2).snapshots().select(F.col("event_from").cast("int").alias("event_from"), "event_to"))


@over_log("snapshot_restore", "SELECT id, seq % 3 < 2 AS in_snapshot FROM e")
def snapshot_restore(log: DataFrame) -> DataFrame:
    """A snapshot after two batches, and what the log has beyond it."""
    engine = _engine(log, batches=2)
    upto = engine.snapshot()["event_to"]
    engine.append(log.filter("seq % 3 = 2"))
    return engine.restore_latest().select("id", (F.col("seq") < upto).alias("in_snapshot"))


def _crashed(log: DataFrame) -> Engine:
    """Reopened after a crash between the write-ahead log and the log."""
    engine = _engine(log, batches=2)
    engine.log_ahead(log.filter("seq % 3 = 2"))
    return Engine(log.sparkSession, engine.folder, STORED)


over_log("recover_after_crash", "SELECT id, seq % 3 = 2 AS recovered FROM e")(lambda log: (e := _crashed(log)).log().select("id", (F.col("seq") >= e.manifest["event_count"] - e.recovered).alias("recovered")))


@over_log("manifest_stored", "SELECT 1 AS version, count(*) AS event_count, arg_max(id, hlc) AS last_event_id, max(hlc) AS last_hlc FROM e")
def manifest_stored(log: DataFrame) -> DataFrame:
    m = _crashed(log).manifest
    return log.sparkSession.createDataFrame([(m["version"], m["event_count"], m["last_event_id"], m["last_hlc"])], "version int, event_count long, last_event_id string, last_hlc long")


# --- peers and messages ---------------------------------------------------------------------------------------------

_NO_VERSIONS = "peer_id string, group_id string, originator string, hlc bigint"


def _peers(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = sync.known_peers(log.select(F.col("originator").alias("peer_id"), F.col("event_type").alias("state"), "seq"))
    return known, log.sparkSession.createDataFrame([], _NO_VERSIONS)


_who = lambda log, kind: log.filter(F.col("event_type") == kind).select(F.col("originator").alias("peer_id"))


def _last(log: DataFrame, *kinds: str) -> DataFrame:
    """Originators whose last event is one of ``kinds``."""
    last = log.groupBy("originator").agg(F.max_by("event_type", "seq").alias("k"))
    return last.filter(F.col("k").isin(*kinds)).select(F.col("originator").alias("peer_id"))


_LAST_ERROR = "(SELECT originator FROM e GROUP BY originator HAVING arg_max(event_type, seq) = 'error')"
over_log("peer_register", "SELECT originator AS peer_id, CASE WHEN bool_or(event_type = 'signup') THEN 'idle' ELSE arg_max(event_type, seq) END AS state FROM e GROUP BY ALL")(lambda log: peers.register(*_peers(log), _who(log, "signup"))[0])
over_log("peer_remove", f"SELECT DISTINCT originator AS peer_id FROM e WHERE originator NOT IN {_LAST_ERROR}")(lambda log: peers.remove(*_peers(log), _last(log, "error"))[0].select("peer_id"))
over_log("peer_count", "SELECT count(DISTINCT originator) AS n FROM e")(lambda log: peers.count(_peers(log)[0]))
over_log("peer_get", "SELECT originator AS peer_id, arg_max(event_type, seq) AS state FROM e WHERE originator = 'u3' GROUP BY ALL")(lambda log: peers.get(_peers(log)[0], "u3"))
over_log("peer_set_state", "SELECT originator AS peer_id, CASE WHEN bool_or(event_type = 'error') THEN 'failed' ELSE arg_max(event_type, seq) END AS state FROM e GROUP BY ALL")(
    lambda log: peers.set_state(_peers(log)[0], _who(log, "error").distinct().withColumn("state", F.lit("failed"))))
over_log("peers_delta_all", """SELECT p.peer_id, (SELECT count(*) FROM v WHERE v.peer_id = p.peer_id) AS known, count(*) FILTER (WHERE v.hlc IS NULL OR e.hlc > v.hlc) AS events
 FROM p CROSS JOIN e LEFT JOIN v ON v.peer_id = p.peer_id AND v.group_id = e.group_id AND v.originator = e.originator GROUP BY p.peer_id""",
         "p AS (SELECT 'p' || k AS peer_id FROM range(5) t(k)), v AS (SELECT 'p' || seq % 4 AS peer_id, group_id, originator, max(hlc) AS hlc FROM e WHERE seq % 5 < 3 GROUP BY ALL)")(
    lambda log: peers.delta_all(log, log.sparkSession.range(5).select(F.concat(F.lit("p"), "id").alias("peer_id")),
                                log.filter("seq % 5 < 3").groupBy(F.concat(F.lit("p"), F.col("seq") % 4).alias("peer_id"), "group_id", "originator").agg(F.max("hlc").alias("hlc"))))


@over_log("peer_filter", "SELECT count(DISTINCT group_id) + count(DISTINCT group_id || ':' || originator) AS items, count(DISTINCT group_id) + count(DISTINCT group_id || ':' || originator) AS found FROM e")
def peer_filter(log: DataFrame) -> DataFrame:
    items, size = peers.filter_items(log), bloom.size_for(peers.filter_size(log), 0.001)
    return bloom.contains(items, "item", bloom.build(items, "item", *size), *size).agg(F.count("*").alias("items"), F.count_if("maybe").alias("found"))


over_log("bloom_count", "SELECT count(originator) AS items FROM e")(lambda log: bloom.count(log, "originator"))
over_log("sync_request_json", "SELECT '{\"node_id\":\"n1\",\"groups\":[' || string_agg('\"' || group_id || '\"', ',' ORDER BY group_id) || ']}' AS request FROM (SELECT DISTINCT group_id FROM e)")(lambda log: peers.sync_request(log, "n1"))
over_log("sync_request_read", "SELECT DISTINCT 'n1' AS node_id, group_id FROM e")(lambda log: peers.read_request(peers.sync_request(log, "n1")))
over_log("events_json", """SELECT group_id, count(*) AS n, '[' || string_agg('{"id":"' || id || '","hlc":' || hlc || ',"originator":"' || originator || '","session_id":"' || session_id || '","group_id":"' || group_id || '"}', ',' ORDER BY seq) || ']' AS events FROM e GROUP BY group_id""")(peers.events_json)
over_log("events_json_read", "SELECT id, hlc, originator, session_id, group_id FROM e")(lambda log: peers.read_events(peers.events_json(log)))

# --- byte messages --------------------------------------------------------------------------------------------------


def _bytes(log: DataFrame):
    none = F.lit(None)
    return messages.marshal_event(F.col("id"), none.cast("array<string>"), none.cast("string"), none.cast("binary"), F.col("hlc"), F.col("originator"), none.cast("binary"), F.col("session_id"), F.col("group_id"))


over_log("event_bytes_roundtrip", "SELECT id, hlc, originator, session_id, group_id FROM e")(lambda log: log.select(messages.unmarshal_event(_bytes(log)).alias("x")).select(*(f"x.{c}" for c in peers.EVENT_FIELDS)))


@over_log("event_bytes_corrupt", "SELECT seq % 10 = 0 AS corrupt, count(*) AS n FROM e GROUP BY ALL")
def event_bytes_corrupt(log: DataFrame) -> DataFrame:
    """Every tenth event's bytes lack the last one."""
    rows = log.withColumn("b", _bytes(log)).withColumn("x", messages.unmarshal_event(F.expr("substring(b, 1, length(b) - cast(seq % 10 = 0 as int))")))
    return rows.groupBy(F.col("x._corrupt").isNotNull().alias("corrupt")).agg(F.count("*").alias("n"))


over_log("log_bytes", "SELECT CAST(sum(14 + 10 + 8 + strlen(id) + strlen(originator) + strlen(session_id) + strlen(group_id)) AS BIGINT) AS bytes FROM e")(lambda log: log.select((F.length(_bytes(log)) + 14).alias("n")).agg(F.sum("n").alias("bytes")))


def _payloads(log: DataFrame) -> DataFrame:
    """Events with their payloads as bytes; those of "view" have a type that no one knows."""
    put = messages.marshal_payload("map_set", map_id=F.col("group_id"), key=F.col("key"), value=F.col("session_id").cast("binary"))
    rows = log.select("id", "seq", "op", F.when(F.col("event_type") == "view", "any.v1.Other").when(F.col("op") == "map_set", "any.v1.MapSet").otherwise("any.v1.MapDelete").alias("payload_type"), put.alias("payload"))
    return messages.with_payload(rows.drop("op"))


over_log("payload_fields", "SELECT id, CASE WHEN event_type = 'view' THEN 'unknown' ELSE op END AS op, CASE WHEN event_type <> 'view' THEN coalesce(key, '') END AS key, CASE WHEN event_type <> 'view' AND op = 'map_set' THEN session_id END AS value FROM e")(
    lambda log: _payloads(log).select("id", "op", "key", F.col("value").cast("string").alias("value")))
over_log("payload_corrupt", "SELECT CASE WHEN event_type = 'view' THEN 'unknown' ELSE op END AS op, event_type = 'view' AS corrupt, count(*) AS n FROM e GROUP BY ALL")(
    lambda log: _payloads(log).groupBy("op", F.col("_corrupt").isNotNull().alias("corrupt")).agg(F.count("*").alias("n")))
over_log("id_text", "SELECT id, lower(to_base(hlc, 36)) || '@' || originator AS t FROM e")(lambda log: log.select("id", messages.id_text(F.col("hlc"), F.col("originator")).alias("t")))
over_log("ws_key", "SELECT id, to_base64(CAST(id AS BLOB)) AS key FROM e")(
    lambda log: log.select("id", messages.ws_key(F.concat(F.lit("GET / HTTP/1.1\r\nHost: x\r\nSEC-websocket-KEY: "), F.base64(F.col("id").cast("binary")), F.lit("\r\nUpgrade: websocket\r\n\r\n"))).alias("key")))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", messages.ws_frame(F.coalesce("text", F.lit("")).cast("binary")).alias("f"))


query("ws_frame_size", "SELECT conv_id, turn, n + CASE WHEN n <= 125 THEN 2 WHEN n <= 65535 THEN 4 ELSE 10 END AS bytes FROM (SELECT conv_id, turn, strlen(coalesce(text, '')) AS n FROM conversations)")(
    lambda spark, d: _frames(spark, d).select("conv_id", "turn", F.length("f").cast("long").alias("bytes")))
query("ws_roundtrip", "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations")(lambda spark, d: _frames(spark, d).select("conv_id", "turn", messages.ws_payload(F.col("f")).cast("string").alias("text")))

# --- registers, agents, sessions, metrics ---------------------------------------------------------------------------

over_log("register_reset", """SELECT group_id, value FROM (SELECT e.group_id, value, row_number() OVER (PARTITION BY e.group_id ORDER BY hlc DESC, originator DESC, id DESC) AS rn FROM e
 JOIN (SELECT group_id AS g, max(seq) FILTER (WHERE event_type = 'error') AS r FROM e GROUP BY 1) x ON g = e.group_id WHERE r IS NULL OR seq > r) WHERE rn = 1""")(
    lambda log: crdt.lww_register(crdt.since_reset(log, "group_id", F.col("event_type") == "error"), ["group_id"]))

REGISTRY = """l AS (SELECT originator AS agent_id, arg_max(event_type, seq) AS k FROM e GROUP BY ALL),
 r AS (SELECT agent_id, 'agent ' || agent_id AS name, CASE k WHEN 'view' THEN 'created' ELSE 'running' END AS status FROM l WHERE k IN ('view', 'signup', 'click'))"""


def _registry(log: DataFrame) -> DataFrame:
    """Those that viewed last are registered, those that signed up or clicked spawned."""
    named = lambda *kinds: _last(log, *kinds).select(F.col("peer_id").alias("agent_id"), F.concat(F.lit("agent "), "peer_id").alias("name"))
    empty = log.sparkSession.createDataFrame([], "agent_id string, name string, status string")
    return agents.spawn(agents.register(empty, named("view")), named("signup", "click"))


_gone = lambda log: _last(log, "error", "view").withColumnRenamed("peer_id", "agent_id")
over_log("agent_registry", "SELECT * FROM r", REGISTRY)(_registry)
over_log("agent_unregister", "SELECT * FROM r WHERE status = 'running'", REGISTRY)(lambda log: agents.unregister(_registry(log), _gone(log))[0])
over_log("agent_unregister_unknown", "SELECT agent_id FROM l WHERE k = 'error'", REGISTRY)(lambda log: agents.unregister(_registry(log), _gone(log))[1])
over_log("agent_get", "SELECT * FROM r WHERE agent_id = 'u3'", REGISTRY)(lambda log: agents.get(_registry(log), "u3"))
over_log("agents_list_by_status", "SELECT agent_id FROM r WHERE status = 'running'", REGISTRY)(lambda log: agents.list_by_status(_registry(log), "running").select("agent_id"))
over_log("agent_count", "SELECT count(*) AS n FROM r", REGISTRY)(lambda log: agents.count(_registry(log)))
over_log("agent_metadata", "SELECT originator AS agent_id, key, arg_max(session_id, seq) AS value FROM e GROUP BY ALL")(lambda log: agents.metadata(log.select(F.col("originator").alias("agent_id"), "key", F.col("session_id").alias("value"), "seq")))
query("agent_send", "SELECT 'main' AS board, turn AS seq, 'writer' AS sender, text AS content FROM conversations")(lambda spark, d: table(spark, d, "conversations").select(F.inline(F.array(agents.send("writer", "main", F.col("text"), F.col("turn"))))))
query("stream_board", f"WITH {log_queries.LOG_SQL} SELECT group_id, key, min(seq) AS seq FROM e WHERE op = 'map_set' GROUP BY ALL")(streams.board)

over_log("session_remove", f"SELECT peer_id FROM s WHERE peer_id NOT IN {_LAST_ERROR}", SESSIONS)(lambda log: sessions.remove(_sessions(log), _last(log, "error")).select("peer_id"))
over_log("session_has", "SELECT DISTINCT originator AS peer_id, originator IN (SELECT peer_id FROM s) AS has FROM e", SESSIONS)(lambda log: sessions.has(_sessions(log), log.select(F.col("originator").alias("peer_id"))))
over_log("session_active", "SELECT peer_id FROM s", SESSIONS)(lambda log: sessions.active(_sessions(log)))


@over_log("session_handshake", "SELECT count(DISTINCT originator) AS peers, count(DISTINCT originator) AS agreed FROM e")
def session_handshake(log: DataFrame) -> DataFrame:
    """Each originator's key pair from its name; both sides must come to the same key."""
    mine, base = hashlib.sha256(b"mine").digest(), (9).to_bytes(32, "little")
    own = security.x25519(mine, base)
    hellos = security.spread(log.select(F.col("originator").alias("peer_id")).distinct()).withColumn("private", F.unhex(F.sha2("peer_id", 256)))
    theirs = hellos.select("peer_id", sessions.shared_key(F.col("private"), F.lit(bytearray(own))).alias("theirs"))
    hellos = hellos.select("peer_id", security.x25519_agree(F.col("private"), F.lit(bytearray(base))).alias("public"))
    none = log.sparkSession.createDataFrame([], "peer_id string, key binary, created long")
    return sessions.from_handshake(none, hellos, mine, 7).join(theirs, "peer_id").agg(F.count("*").alias("peers"), F.count_if(F.col("key") == F.col("theirs")).alias("agreed"))


over_log("text_encryption", "SELECT id, session_id AS plain FROM e")(lambda log: log.select("id", security.decrypt_text(security.encrypt_text(F.col("session_id"), F.unhex(F.lit(bytes(range(32)).hex()))), F.unhex(F.lit(bytes(range(32)).hex()))).alias("plain")))


@over_log("verify_first_failure", "SELECT seq, CASE seq % 3 WHEN 1 THEN 'no signature' ELSE 'invalid public key' END AS reason, n AS failures FROM (SELECT min(seq) AS seq, count(*) AS n FROM e WHERE seq % 3 <> 0)")
def verify_first_failure(log: DataFrame) -> DataFrame:
    """All events signed; every third has lost its signature and every third comes with another kind of key."""
    seed = bytes(range(32))
    rows = security.spread(log.select("seq", _signed(log).alias("m"))).withColumn("s", security.ed25519_sign(seed, F.col("m")))
    public, third = F.lit(bytearray(security.public_key(seed))), F.col("seq") % 3
    rows = rows.withColumn("s", F.when(third != 1, F.col("s"))).withColumn("p", F.when(third == 2, F.lit(bytearray(b"short"))).otherwise(public))
    return security.first_failure(rows.select("seq", security.wrong_signature(F.col("p"), F.col("m"), F.col("s")).alias("reason")))


over_log("events_created_applied", "SELECT op AS label, 'u1' AS node, count(*) FILTER (WHERE originator = 'u1') AS created, count(*) FILTER (WHERE originator <> 'u1') AS applied FROM e GROUP BY ALL")(lambda log: metrics.created_applied(log, "u1"))
over_log("snapshots_taken", "SELECT count(*) AS snapshots, max(event_to) AS events FROM d", log_queries.SNAPS)(lambda log: metrics.snapshots_taken(log_queries.due(log)))
