"""Queries over the event log: scans, states, replication, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import fixtures
from tidelog.fixtures import LOG_SQL, event_log, table
from tidelog.operators import crdt, persistence, runs, scan, sync

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Two replicas that share events and hold all of them together.
REPLICAS = ("event_type <> 'purchase'", "event_type <> 'view'")
COLS = ["seq", "id", "hlc", "originator", "group_id", "session_id", "op", "key", "value"]
SHOWN = ", ".join(COLS)


def replicas(log: DataFrame) -> list[DataFrame]:
    return [log.filter(r) for r in REPLICAS]


def on_log(name: str, sql: str | None, view: str = ""):
    """Registers a query that takes the log; the SQL sees it as e."""
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir, fn=fn: fn(event_log(spark, sf_dir))
        if sql:
            SQL[name] = f"WITH RECURSIVE {LOG_SQL}{', ' + view if view else ''} {sql}"
        return fn

    return register


def _scan(name: str, where: str, **kwargs) -> None:
    on_log(name, f"SELECT {SHOWN} FROM e {where}")(lambda log: scan.scan(log, **kwargs).select(*COLS))


T0, T1 = 1_704_500_000_000_000_000, 1_705_500_000_000_000_000
_scan("log_scan_all", "")
_scan("log_filter_group", "WHERE group_id = 'room-3'", group_id="room-3")
_scan("log_filter_session", "WHERE session_id = 'u7/2024-01-03'", session_id="u7/2024-01-03")
_scan("log_hlc_range", f"WHERE hlc BETWEEN {T0} AND {T1}", since=T0, until=T1)
_scan("log_after_id_limit", "WHERE seq > (SELECT max(seq) FROM e WHERE id = '500') ORDER BY seq LIMIT 100", after_id="500", limit=100)
_scan("log_before_id", "WHERE seq < (SELECT max(seq) FROM e WHERE id = '500')", before_id="500")
_scan("log_before_id_compat", "WHERE id <> '500' ORDER BY seq LIMIT 50", before_id="500", compat=True, limit=50)
_scan("log_reverse_limit", "ORDER BY seq DESC LIMIT 20", reverse=True, limit=20)
_scan("log_compat_default_limit", "ORDER BY seq LIMIT 1000", compat=True)
_scan("log_conjunction", f"WHERE group_id = 'room-5' AND hlc >= {T0} AND seq > (SELECT max(seq) FROM e WHERE id = '100')", group_id="room-5", since=T0, after_id="100")
on_log("log_get_by_id", f"SELECT {SHOWN} FROM e WHERE id = '42'")(lambda log: scan.get(log, "42").select(*COLS))
on_log("log_stats", "SELECT count(*) AS event_count, arg_min(id, seq) AS oldest_id, arg_max(id, seq) AS newest_id FROM e")(scan.stats)

# --- registers and maps ---------------------------------------------------------------------------------------------


def _last(by: str, order: str, value: str = "value", where: str = "true") -> str:
    return f"SELECT {by}, {value} AS value FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM e WHERE {where}) WHERE rn = 1"


CLOCK = "hlc DESC, originator DESC, id DESC"
MAP_STATE = f"""m AS (SELECT group_id, key, CASE WHEN op = 'map_set' THEN value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY group_id, key ORDER BY {CLOCK}) AS rn,
 count(*) FILTER (WHERE op = 'map_set') OVER (PARTITION BY group_id, key) AS sets FROM e) WHERE rn = 1 AND sets > 0)"""

on_log("lww_register", _last("group_id", CLOCK))(lambda log: crdt.lww_register(log, ["group_id"]))
on_log("lww_register_arrival", _last("group_id", "seq DESC"))(lambda log: crdt.lww_register(log, ["group_id"], order="arrival"))
on_log("lww_map_state", "SELECT * FROM m", MAP_STATE)(crdt.lww_map)
on_log("lww_map_len", "SELECT group_id, count(value) AS live, count(*) AS total FROM m GROUP BY ALL", MAP_STATE)(lambda log: crdt.map_sizes(crdt.lww_map(log)))
on_log("lww_map_keys", "SELECT group_id, list_sort(list(key)) AS keys FROM m WHERE value IS NOT NULL GROUP BY ALL", MAP_STATE)(lambda log: crdt.map_keys(crdt.lww_map(log)))
on_log("lww_map_get", "SELECT * FROM m WHERE group_id = 'room-2' AND key = '17'", MAP_STATE)(lambda log: crdt.lww_map(log.filter("group_id = 'room-2' AND key = '17'")))
TIME = 1_705_276_800_000_000_000
on_log("log_time_travel", "SELECT * FROM m", MAP_STATE.replace("FROM e)", f"FROM e WHERE hlc <= {TIME})"))(lambda log: crdt.lww_map(scan.at_time(log, TIME)))


@on_log("lww_map_merge", _last("group_id, key", CLOCK, where="op = 'map_set'"))
def lww_map_merge(log: DataFrame) -> DataFrame:
    """Two replicas' last writes, merged."""
    sets = log.filter("op = 'map_set'")
    state = lambda rows: rows.groupBy("group_id", "key").agg(F.max_by(F.struct("value", "hlc", "originator", "id"), F.struct("hlc", "originator", "id")).alias("s")).select("group_id", "key", "s.*")
    return crdt.lww_merge(map(state, replicas(sets)), ["group_id", "key"])


@on_log("flagship_group_state", """SELECT g.*, live, total - live AS tombstones FROM (SELECT group_id, count(*) AS events, arg_max(id, seq) AS last_id, max(hlc) AS last_hlc, count(DISTINCT originator) AS originators
 FROM e GROUP BY group_id) g JOIN (SELECT group_id, count(value) AS live, count(*) AS total FROM m GROUP BY group_id) USING (group_id)""", MAP_STATE)
def flagship_group_state(log: DataFrame) -> DataFrame:
    """Replays every group: its events, last event, vector size, live and deleted keys."""
    groups = log.groupBy("group_id").agg(F.count("*").alias("events"), F.max_by("id", "seq").alias("last_id"), F.max("hlc").alias("last_hlc"), F.count_distinct("originator").alias("originators"))
    sizes = crdt.map_sizes(crdt.lww_map(log)).select("group_id", "live", (F.col("total") - F.col("live")).alias("tombstones"))
    return groups.join(sizes, "group_id")


# --- counters -------------------------------------------------------------------------------------------------------

COUNTS = "SELECT group_id, originator, CAST(sum(delta) AS BIGINT) AS count FROM e WHERE delta > 0{} GROUP BY ALL"
up = lambda log: log.filter("delta > 0")
on_log("gcounter_counts", COUNTS.format(""))(lambda log: crdt.gcounter(up(log)))
on_log("gcounter_value", "SELECT group_id, CAST(sum(delta) AS BIGINT) AS value FROM e WHERE delta > 0 GROUP BY ALL")(lambda log: crdt.gcounter_value(crdt.gcounter(up(log))))
on_log("gcounter_merge", f"SELECT group_id, originator, max(count) AS count FROM ({COUNTS.format(" AND event_type <> 'purchase'")} UNION ALL {COUNTS.format(" AND event_type <> 'view'")}) GROUP BY ALL")(
    lambda log: crdt.gcounter_merge(*(crdt.gcounter(up(r)) for r in replicas(log))))
on_log("pncounter_value", "SELECT group_id, CAST(sum(delta) AS BIGINT) AS value FROM e GROUP BY ALL")(lambda log: crdt.pncounter_value(crdt.pncounter(log)))
PN = "SELECT group_id, originator, CAST(sum(CASE WHEN delta >= 0 THEN delta ELSE 0 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS BIGINT) AS negative FROM e WHERE {} GROUP BY ALL"
on_log("pncounter_merge", f"SELECT group_id, originator, max(positive) AS positive, max(negative) AS negative FROM ({PN.format("event_type <> 'purchase'")} UNION ALL {PN.format("event_type <> 'view'")}) GROUP BY ALL")(
    lambda log: crdt.pncounter_merge(*map(crdt.pncounter, replicas(log))))
on_log("counter_rollup", "SELECT group_id, originator, CAST(sum(delta) AS BIGINT) AS value FROM e GROUP BY ROLLUP (group_id, originator)")(lambda log: log.rollup("group_id", "originator").agg(F.sum("delta").alias("value")))

# --- replication ----------------------------------------------------------------------------------------------------

by_type = lambda log: log.withColumn("group_id", F.col("event_type"))
VV = "t AS (SELECT seq, hlc, id, event_type AS group_id, originator FROM e), n AS (SELECT count(*) * 6 // 10 AS cut FROM e), loc AS (SELECT group_id, originator, max(hlc) AS hlc FROM t GROUP BY ALL), peer AS (SELECT group_id, originator, max(hlc) AS hlc FROM t, n WHERE seq <= cut GROUP BY ALL)"


def _peer(log: DataFrame) -> DataFrame:
    return sync.version_vector(log.filter(F.col("seq") <= log.count() * 6 // 10))


on_log("group_ids", "SELECT DISTINCT group_id FROM e")(lambda log: log.select("group_id").distinct())
on_log("group_count", "SELECT count(DISTINCT group_id) AS n FROM e")(lambda log: log.agg(F.count_distinct("group_id").alias("n")))
on_log("group_types", "SELECT group_id, arg_min(op, seq) AS type, count(DISTINCT op) > 1 AS mixed FROM e GROUP BY ALL")(lambda log: log.groupBy("group_id").agg(F.min_by("op", "seq").alias("type"), (F.count_distinct("op") > 1).alias("mixed")))
on_log("version_vector", "SELECT * FROM loc", VV)(lambda log: sync.version_vector(by_type(log)))
on_log("version_vector_last_applied", "SELECT group_id, originator, arg_max(hlc, seq) AS hlc FROM t GROUP BY ALL", VV)(lambda log: sync.version_vector(by_type(log), "last_applied"))
on_log("vv_merge", "SELECT group_id, originator, max(hlc) AS hlc FROM (SELECT * FROM loc UNION ALL SELECT * FROM peer) GROUP BY ALL", VV)(lambda log: sync.merge(sync.version_vector(by_type(log)), _peer(by_type(log))))
on_log("vv_delta", "SELECT l.* FROM loc l LEFT JOIN peer p USING (group_id, originator) WHERE p.hlc IS NULL OR l.hlc > p.hlc", VV)(lambda log: sync.delta(sync.version_vector(by_type(log)), _peer(by_type(log))))
on_log("events_to_send", "SELECT t.seq, t.id, t.group_id, t.originator, t.hlc FROM t LEFT JOIN peer p USING (group_id, originator) WHERE p.hlc IS NULL OR t.hlc > p.hlc", VV)(
    lambda log: sync.events_to_send(by_type(log), _peer(by_type(log))).select("seq", "id", "group_id", "originator", "hlc"))
on_log("sync_response_json", "SELECT 'n1' AS node_id, group_id, '{' || string_agg('\"' || originator || '\":' || hlc, ',' ORDER BY originator) || '}' AS versions, count(*) AS vector_size, CAST(sum(n) AS BIGINT) AS event_count FROM (SELECT group_id, originator, max(hlc) AS hlc, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL", VV)(
    lambda log: sync.sync_response(by_type(log), "n1"))
on_log("sync_response_applied", "SELECT * FROM loc", VV)(lambda log: sync.apply_response(sync.sync_response(by_type(log), "n1")))
on_log("known_peers", "SELECT originator AS peer_id, arg_max(event_type, seq) AS state FROM e GROUP BY ALL")(lambda log: sync.known_peers(log.select(F.col("originator").alias("peer_id"), F.col("event_type").alias("state"), "seq")))

# --- recovery -------------------------------------------------------------------------------------------------------

gap = lambda log: log.filter("event_type <> 'signup'")
on_log("recover_missing", "SELECT id, seq FROM e WHERE event_type = 'signup'")(lambda log: persistence.missing(log, gap(log)).select("id", "seq"))
on_log("recover_log", "SELECT count(*) AS n, CAST(sum(seq) AS BIGINT) AS total FROM e")(lambda log: persistence.recover(log, gap(log)).agg(F.count("*").alias("n"), F.sum("seq").alias("total")))
on_log("dedupe_ids", "SELECT id, min(seq) AS seq FROM (SELECT CAST(seq % 700 AS VARCHAR) AS id, seq FROM e) GROUP BY ALL")(lambda log: scan.dedupe(log.withColumn("id", (F.col("seq") % 700).cast("string"))).select("id", "seq"))
on_log("manifest", "SELECT 1 AS version, count(*) AS event_count, arg_max(id, seq) AS last_event_id, max(hlc) AS last_hlc, arg_max(id, hlc) AS max_hlc_event_id FROM e")(persistence.manifest)
SNAPS = "b AS (SELECT seq // 7 AS batch, count(*) AS rows FROM e GROUP BY ALL), s AS (SELECT batch, rows, CAST(sum(rows) OVER (ORDER BY batch) AS BIGINT) AS event_to FROM b), d AS (SELECT * FROM s WHERE event_to // 100 > (event_to - rows) // 100)"
batches = lambda log: log.groupBy(F.floor(F.col("seq") / 7).alias("batch")).agg(F.count("*").alias("rows"))
due = lambda log: persistence.boundaries(batches(log), 100)
on_log("snapshot_boundaries", "SELECT * FROM d", SNAPS)(due)
on_log("retention_topk", "SELECT * FROM d ORDER BY event_to DESC LIMIT 5", SNAPS)(lambda log: persistence.retained(due(log)))
on_log("snapshot_restore_latest", f"SELECT {SHOWN} FROM e WHERE seq < (SELECT max(event_to) FROM d)", SNAPS)(lambda log: persistence.restore_latest(log, due(log)).select(*COLS))
on_log("wal_segment_stats", "SELECT segment, count(*) AS n, CAST(sum(length(id)) AS BIGINT) AS bytes FROM (SELECT seq // 1000 AS segment, id FROM e) GROUP BY ALL")(
    lambda log: log.groupBy(F.floor(F.col("seq") / 1000).alias("segment")).agg(F.count("*").alias("n"), F.sum(F.length("id")).alias("bytes")))


@on_log("wal_crc_check", "SELECT seq % 100 <> 0 AS crc_ok, count(*) AS n FROM e GROUP BY ALL")
def wal_crc_check(log: DataFrame) -> DataFrame:
    """Entries whose stored checksum is that of their payload; every hundredth was damaged."""
    rows = log.select("seq", F.concat_ws("|", "id", "hlc").cast("binary").alias("payload"))
    stored = rows.withColumn("crc", F.crc32("payload") + F.when(F.col("seq") % 100 == 0, 1).otherwise(0))
    return stored.groupBy((F.crc32("payload") == F.col("crc")).alias("crc_ok")).agg(F.count("*").alias("n"))


# --- texts ----------------------------------------------------------------------------------------------------------


def _inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.turns(spark, sf_dir)


def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's text put in at turn * 7 modulo the length so far."""
    each = _inserts(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("o"))
    step = lambda s, o: crdt.insert(s, o["turn"] * 7 % (F.length(s) + 1), o["text"])
    return each.select("conv_id", F.aggregate("o", F.lit(""), step).alias("text"))


def _fold_sql(step: str) -> str:
    return f"""WITH RECURSIVE o AS (SELECT conv_id, turn, text AS piece, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 f AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS s FROM (SELECT DISTINCT conv_id FROM o) UNION ALL SELECT f.conv_id, o.i, {step} FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
 SELECT conv_id, arg_max(s, i) AS text FROM f GROUP BY conv_id"""


_PUT = "left(s, CAST({p} AS BIGINT)) || piece || substring(s, CAST({p} AS BIGINT) + 1)"
QUERIES["text_fold"], SQL["text_fold"] = text_fold, _fold_sql(_PUT.format(p="((turn * 7) % (length(s) + 1))"))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts at turn * 3, and at every third turn a deletion of 5 characters at turn."""
    cut = F.col("turn") % 3 == 2
    return _inserts(spark, sf_dir).select("conv_id", F.col("turn").alias("seq"), F.when(cut, "text_delete").otherwise("text_insert").alias("op"), F.when(cut, F.col("turn")).otherwise(F.col("turn") * 3).alias("position"), "text", F.lit(5).cast("long").alias("length"))


_EDIT_SQL = _fold_sql(f"CASE WHEN turn % 3 = 2 THEN left(s, turn) || substring(s, turn + 6) ELSE {_PUT.format(p='(turn * 3)')} END")
QUERIES["text_insert_delete"], SQL["text_insert_delete"] = lambda spark, d: crdt.text_fold(_edits(spark, d), "conv_id"), _EDIT_SQL
QUERIES["text_insert_delete_long"], SQL["text_insert_delete_long"] = lambda spark, d: crdt.fold_in_pandas(_edits(spark, d), "conv_id"), _EDIT_SQL
QUERIES["text_len"], SQL["text_len"] = lambda spark, d: text_fold(spark, d).select("conv_id", F.length("text").cast("long").alias("n")), f"SELECT conv_id, length(text) AS n FROM ({SQL['text_fold']})"
QUERIES["log_union_refold"] = lambda spark, d: crdt.text_fold(_edits(spark, d).filter("op = 'text_insert'").unionByName(_edits(spark, d)).dropDuplicates(["conv_id", "seq"]), "conv_id")
SQL["log_union_refold"] = _EDIT_SQL

_RGA_SQL = """WITH a AS (SELECT doc_id, i AS ts, 'a' AS node, ch, false AS removed FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE text <> '')),
 b AS (SELECT doc_id, ts, node, ch, ts % 5 = 0 AS removed FROM a UNION ALL SELECT doc_id, ts, 'b', translate(ch, 'aeiou', 'AEIOU'), false FROM a WHERE ts % 7 = 0), m AS (SELECT doc_id, ts, node, max(ch) AS ch, bool_or(removed) AS removed FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)"""


def _rga(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas' nodes as runs: a has a text's characters, b deletes some of them and adds its own."""
    # a text is moved once, not with each of its runs
    docs = runs.together(table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", "text"))
    run = lambda node, step, chars, removed: F.struct(F.lit(node).alias("node"), F.lit(step).cast("long").alias("first"), F.lit(step).cast("long").alias("step"), chars.alias("chars"), removed.cast("string").alias("removed"))
    text, none = F.col("text"), F.lit(None)
    fifths = F.substring(F.repeat(F.lit("00001"), F.ceil(F.length(text) / 5).cast("int")), F.lit(1), F.length(text))
    sevenths = F.translate(F.regexp_replace(text, r"(?s).{6}(.)|.{1,6}\z", "$1"), "aeiou", "AEIOU")
    return docs.select("doc_id", F.inline(F.array(run("a", 1, text, none), run("a", 1, text, fifths), run("b", 7, sevenths, none))))


QUERIES["rga_state_merge"], SQL["rga_state_merge"] = lambda spark, d: runs.texts(_rga(spark, d), met=True), f"{_RGA_SQL} SELECT doc_id, string_agg(ch, '' ORDER BY ts, node) AS text, count(*) AS length FROM m WHERE NOT removed GROUP BY doc_id"
QUERIES["rga_compact"], SQL["rga_compact"] = lambda spark, d: runs.nodes(_rga(spark, d), met=True), f"{_RGA_SQL} SELECT * FROM m WHERE NOT removed"
