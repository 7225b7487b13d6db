"""Queries over sketches, agents, metrics, security functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import LOG_SQL, event_log, table
from tidelog.functions import security
from tidelog.operators import agents, bloom, metrics, sessions
from tidelog.plans import log_queries
from tidelog.plans.log_queries import MAP_STATE
from tidelog.streaming import queries as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def over_log(name: str, sql: str | None, view: str = ""):
    def register(fn):
        return query(name, sql and f"WITH {LOG_SQL}{', ' + view if view else ''} {sql}")(lambda spark, d: fn(event_log(spark, d)))

    return register


# --- sketches -------------------------------------------------------------------------------------------------------

def filter_size(log: DataFrame) -> tuple[int, int]:
    """Bits and hashes for the distinct originators of ``log`` at a false-positive rate of 0.001."""
    n = log.agg(F.count_distinct("originator")).first()[0]
    return bloom.size_for(n if n >= 10 else 100, 0.001)


@query("bloom_params", "SELECT n, greatest(64, m) AS bits, CAST(greatest(1, round(m / n * ln(2))) AS BIGINT) AS hashes FROM (SELECT n, CAST(ceil(-n * ln(0.001) / (ln(2) * ln(2))) AS BIGINT) AS m FROM (SELECT DISTINCT user_id + 1 AS n FROM events))")
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("n")).distinct()
    bits = F.ceil(-F.col("n") * F.log(F.lit(0.001)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0))))
    return n.select("n", F.greatest(F.lit(64), bits).cast("long").alias("bits"), F.greatest(F.lit(1), F.round(bits / F.col("n") * F.log(F.lit(2.0)))).cast("long").alias("hashes"))


@over_log("bloom_no_false_negatives", "SELECT count(DISTINCT originator) AS items, count(DISTINCT originator) AS found FROM e")
def bloom_no_false_negatives(log: DataFrame) -> DataFrame:
    items = log.select("originator").distinct()
    size = filter_size(log)
    return bloom.contains(items, "originator", bloom.build(items, "originator", *size), *size).agg(F.count("*").alias("items"), F.count_if("maybe").alias("found"))


@over_log("bloom_merge", "SELECT count(DISTINCT originator) AS found FROM e")
def bloom_merge(log: DataFrame) -> DataFrame:
    items = log.select("originator").distinct()
    size = filter_size(log)
    words = bloom.merge(*(bloom.build(r, "originator", *size) for r in log_queries.replicas(log)))
    return bloom.contains(items, "originator", words, *size).agg(F.count_if("maybe").alias("found"))


@over_log("bloom_estimate", None)
def bloom_estimate(log: DataFrame) -> DataFrame:
    size = filter_size(log)
    return bloom.estimate(bloom.build(log.select("originator"), "originator", *size), *size)

# --- agents ---------------------------------------------------------------------------------------------------------

_STEP = """CASE WHEN c = 'start' AND status <> 'running' THEN 'running' WHEN c = 'pause' AND status = 'running' THEN 'paused' WHEN c = 'resume' AND status = 'paused' THEN 'running' WHEN c = 'stop' AND status = 'running' THEN 'stopped' END"""
_CYCLE = f"""WITH RECURSIVE {LOG_SQL}, o AS (SELECT originator AS agent_id, hlc, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'pause' WHEN 'view' THEN 'resume' WHEN 'purchase' THEN 'stop' ELSE 'none' END AS c,
 row_number() OVER (PARTITION BY originator ORDER BY seq) AS i FROM e),
 f AS (SELECT agent_id, CAST(0 AS BIGINT) AS i, 'created' AS status, CAST(0 AS BIGINT) AS errors, CAST(NULL AS BIGINT) AS last_active FROM (SELECT DISTINCT agent_id FROM o)
 UNION ALL SELECT f.agent_id, o.i, coalesce({_STEP}, status), errors + CASE WHEN c <> 'none' AND {_STEP} IS NULL THEN 1 ELSE 0 END, CASE WHEN c = 'start' AND {_STEP} IS NOT NULL THEN hlc ELSE last_active END
 FROM f JOIN o ON o.agent_id = f.agent_id AND o.i = f.i + 1), g AS (SELECT agent_id, arg_max(status, i) AS status, max(errors) AS errors, max(last_active) AS last_active FROM f GROUP BY agent_id)"""


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.lifecycle(agents.commands(event_log(spark, sf_dir)))


query("agent_lifecycle", f"{_CYCLE} SELECT * FROM g")(lifecycle)
query("agents_by_status", f"{_CYCLE} SELECT status, count(*) AS n FROM g GROUP BY ALL")(lambda spark, d: agents.by_status(lifecycle(spark, d)))
query("supervisor_stop_all", f"{_CYCLE} SELECT count(*) FILTER (WHERE status = 'running') AS stopped, count(*) FILTER (WHERE status <> 'running') AS errors FROM g")(lambda spark, d: agents.stop_all(lifecycle(spark, d)))
over_log("agent_memory_snapshot", "SELECT group_id, key, value FROM m WHERE value IS NOT NULL", MAP_STATE)(lambda log: agents.memory(log).select("group_id", F.explode("memory").alias("key", "value")))
query("blackboard_messages", "SELECT conv_id AS board, role || '-' || turn AS key, turn AS seq, role AS sender, text AS content FROM conversations")(
    lambda spark, d: agents.messages((p := table(spark, d, "conversations").select(F.col("conv_id").alias("board"), F.col("turn").alias("seq"), F.col("role").alias("sender"), F.col("text").alias("content"))).unionByName(p)))
over_log("supervisor_duplicates", "SELECT originator AS agent_id, count(*) - 1 AS refused FROM e GROUP BY ALL HAVING count(*) > 1")(lambda log: agents.duplicates(log.select(F.col("originator").alias("agent_id"))))

# --- metrics --------------------------------------------------------------------------------------------------------

over_log("events_by_type_node", "SELECT event_type, originator, count(*) AS n FROM e GROUP BY ALL")(metrics.by_type_node)
over_log("latency_histogram", " UNION ALL ".join(f"SELECT '{b:g}' AS le, count(*) FILTER (WHERE value / 100 <= {b}) AS n FROM e" for b in metrics.BUCKETS) + " UNION ALL SELECT '+Inf', count(value) FROM e")(
    lambda log: metrics.histogram(log.withColumn("s", F.col("value") / 100), "s"))
over_log("event_type_label", "SELECT op AS label, count(*) AS n FROM e GROUP BY ALL")(lambda log: log.groupBy(F.when(F.col("op").isin("text_insert", "text_delete", "map_set", "map_delete"), F.col("op")).otherwise("unknown").alias("label")).agg(F.count("*").alias("n")))
over_log("metrics_exposition", "SELECT 'events_total{type=\"' || event_type || '\",node=\"' || originator || '\"} ' || count(*) AS line FROM e GROUP BY event_type, originator")(lambda log: metrics.exposition(metrics.by_type_node(log), "events_total"))

# --- security -------------------------------------------------------------------------------------------------------

_SIGN_SQL = "id || '|' || id || ',d' || id || '|' || op || '|' || key || '|' || hlc"


def _signed(log: DataFrame):
    return security.sign_bytes(F.col("id"), F.array(F.col("id"), F.concat(F.lit("d"), F.col("id"))), F.col("op"), F.col("key").cast("binary"), F.col("hlc"))


over_log("sign_bytes", f"SELECT id, sha256({_SIGN_SQL}) AS digest FROM e")(lambda log: log.select("id", F.sha2(_signed(log), 256).alias("digest")))
over_log("sha256_rotate", "SELECT originator, sha256(unhex(sha256(originator))) AS key FROM (SELECT DISTINCT originator FROM e)")(
    lambda log: log.select("originator").distinct().select("originator", F.lower(F.hex(security.rotate(security.rotate(F.col("originator").cast("binary"))))).alias("key")))
over_log("capability_serialize", "SELECT id, group_id || '|read,write|' || originator || '|' || session_id || '|' || hlc AS cap FROM e")(
    lambda log: log.select("id", security.serialize_capability(F.col("group_id"), F.array(F.lit("read"), F.lit("write")), F.col("originator"), F.col("session_id"), F.col("hlc")).alias("cap")))
over_log("capability_expired", "SELECT id, seq % 100 * 17000000 > 0 AND 1000000000 > seq % 100 * 17000000 AS expired FROM e")(lambda log: log.select("id", security.expired(F.col("seq") % 100 * 17_000_000, 1_000_000_000).alias("expired")))
over_log("key_needs_rotation", "SELECT id, 1706745600 - hlc // 1000000000 > 86400 AS due FROM e")(lambda log: log.select("id", security.needs_rotation(F.expr("hlc div 1000000000"), 86_400, 1_706_745_600).alias("due")))
over_log("base64url_id", "SELECT id, rtrim(translate(to_base64(CAST(session_id AS BLOB)), '+/', '-_'), '=') AS b FROM e")(lambda log: log.select("id", security.base64url(F.col("session_id").cast("binary")).alias("b")))


@over_log("aes_roundtrip", "SELECT id, session_id AS plain FROM e")
def aes_roundtrip(log: DataFrame) -> DataFrame:
    key = F.unhex(F.lit(bytes(range(32)).hex()))
    return log.select("id", F.aes_decrypt(F.aes_encrypt("session_id", key, F.lit("GCM")), key, F.lit("GCM")).cast("string").alias("plain"))


def _sessions(log: DataFrame) -> DataFrame:
    """A session with every originator that has signed up."""
    peers = log.filter("event_type = 'signup'").groupBy(F.col("originator").alias("peer_id")).agg(F.min(F.expr("hlc div 1000000000")).alias("created"))
    return peers.select("peer_id", F.unhex(F.sha2("peer_id", 256)).alias("key"), "created")


SESSIONS = "s AS (SELECT originator AS peer_id, min(hlc) // 1000000000 AS created, unhex(sha256(originator)) AS key FROM e WHERE event_type = 'signup' GROUP BY ALL)"


@over_log("session_roundtrip", "SELECT e.id, e.session_id AS plain FROM e JOIN s ON s.peer_id = e.originator", SESSIONS)
def session_roundtrip(log: DataFrame) -> DataFrame:
    """Every event's session encrypted for its originator and decrypted again."""
    keys = _sessions(log)
    sealed = sessions.encrypt_for(log.select("id", F.col("originator").alias("peer_id"), F.col("session_id").alias("plain")), keys, "plain")
    return sessions.decrypt_from(sealed, keys, "plain").select("id", F.col("plain").cast("string").alias("plain"))


over_log("session_missing", "SELECT DISTINCT originator AS peer_id FROM e WHERE originator NOT IN (SELECT peer_id FROM s WHERE created < 1704240000)", SESSIONS)(lambda log: sessions.missing(log.select(F.col("originator").alias("peer_id")), _sessions(log).filter("created < 1704240000")))
over_log("session_rotation", "SELECT peer_id, lower(hex(CASE WHEN 1706745600 - created > 2592000 THEN unhex(sha256(key)) ELSE key END)) AS key, CASE WHEN 1706745600 - created > 2592000 THEN 1706745600 ELSE created END AS created FROM s", SESSIONS)(
    lambda log: sessions.rotate((s := _sessions(log)), sessions.overdue(s, 2_592_000, 1_706_745_600), 1_706_745_600).withColumn("key", F.lower(F.hex("key"))))


@over_log("ed25519_verify", "SELECT count(*) AS n, count(*) FILTER (WHERE seq % 2 = 0) AS valid FROM e")
def ed25519_verify(log: DataFrame) -> DataFrame:
    """Signatures of all events; those of odd ones are over other bytes."""
    seed = bytes(range(32))
    rows = security.spread(log.select("seq", _signed(log).alias("m"))).withColumn("s", security.ed25519_sign(seed, F.when(F.col("seq") % 2 == 0, F.col("m")).otherwise(F.lit("tampered").cast("binary"))))
    return rows.agg(F.count("*").alias("n"), F.count_if(security.ed25519_verify(F.lit(bytearray(security.public_key(seed))), F.col("m"), F.col("s"))).alias("valid"))


# --- streams --------------------------------------------------------------------------------------------------------

query("stream_lww_map", log_queries.SQL["lww_map_state"])(streams.lww_map)
query("stream_version_vector", f"WITH {LOG_SQL} SELECT group_id, originator, max(hlc) AS hlc FROM e GROUP BY ALL")(streams.version_vector)
query("stream_counter", log_queries.SQL["pncounter_value"])(streams.counter)
query("stream_windowed_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")(streams.windowed_counts)
query("stream_text", log_queries.SQL["text_fold"])(streams.text)
