"""Agents as keyed state machines, their memory and message boards as map groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.crdt import lww_map
from tidelog.schema import AGENT_STATES

COMMANDS = {"signup": "start", "click": "pause", "view": "resume", "purchase": "stop", "error": "none"}


def commands(log: DataFrame) -> DataFrame:
    """(agent_id, seq, hlc, command) of the test log: event types stand for commands."""
    command = F.create_map(*(F.lit(x) for kv in COMMANDS.items() for x in kv))
    return log.select(F.col("originator").alias("agent_id"), "seq", "hlc", F.get(F.array(command), F.lit(0))[F.col("event_type")].alias("command"))


def lifecycle(events: DataFrame) -> DataFrame:
    """(agent_id, status, errors, last_active): commands applied in order; one that the status does not allow is an error.

    start works from any status but running, pause and stop from running, resume from paused.
    """
    def step(s: Column, e: Column) -> Column:
        c, st = e["command"], s["status"]
        after = F.when((c == "start") & (st != "running"), "running").when((c == "pause") & (st == "running"), "paused").when((c == "resume") & (st == "paused"), "running").when((c == "stop") & (st == "running"), "stopped")
        known = c.isin("start", "pause", "resume", "stop")
        return F.struct(F.coalesce(after, st).alias("status"), (s["errors"] + F.when(known & after.isNull(), 1).otherwise(0)).alias("errors"),
                        F.when((c == "start") & after.isNotNull(), e["hlc"]).otherwise(s["last_active"]).alias("last_active"))

    first = F.struct(F.lit("created").alias("status"), F.lit(0).alias("errors"), F.lit(None).cast("long").alias("last_active"))
    each = events.groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct("seq", "hlc", "command"))).alias("e"))
    return each.select("agent_id", F.aggregate("e", first, step).alias("s")).select("agent_id", "s.status", F.col("s.errors").cast("long").alias("errors"), "s.last_active")


def by_status(agents: DataFrame) -> DataFrame:
    return agents.groupBy("status").agg(F.count("*").alias("n"))


def stop_all(agents: DataFrame) -> DataFrame:
    """How many stop, and how many errors that gives (agents not running); the registry is empty afterwards."""
    return agents.agg(F.count_if(F.col("status") == "running").alias("stopped"), F.count_if(F.col("status") != "running").alias("errors"))


def memory(log: DataFrame) -> DataFrame:
    """(group_id, memory): the live keys of each memory group."""
    live = lww_map(log).filter("value IS NOT NULL")
    return live.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("memory"))


def messages(posts: DataFrame) -> DataFrame:
    """Posts (board, seq, sender, content) as messages, each key once: the key is sender and place."""
    posts = posts.withColumn("key", F.concat_ws("-", "sender", "seq"))
    return posts.groupBy("board", "key").agg(F.min("seq").alias("seq"), F.min_by("sender", "seq").alias("sender"), F.min_by("content", "seq").alias("content"))


def duplicates(registered: DataFrame) -> DataFrame:
    """Ids registered more than once; all but the first are refused."""
    return registered.groupBy("agent_id").agg(F.count("*").alias("n")).filter("n > 1").select("agent_id", (F.col("n") - 1).alias("refused"))


# --- registry -----------------------------------------------------------------------------------------------------


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` agents (agent_id, name) put in as created; an id that is taken is refused."""
    fresh = new.dropDuplicates(["agent_id"]).join(registry.select("agent_id"), "agent_id", "left_anti")
    return registry.unionByName(fresh.withColumn("status", F.lit(AGENT_STATES[0])))


def spawn(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registered and started."""
    before = registry.select("agent_id", F.lit(True).alias("_old"))
    both = register(registry, new).join(before, "agent_id", "left")
    return both.select("agent_id", "name", F.when(F.col("_old").isNull(), AGENT_STATES[1]).otherwise(F.col("status")).alias("status"))


def unregister(registry: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry without the agents of ``gone``, and those ids that it does not have."""
    return registry.join(gone.select("agent_id"), "agent_id", "left_anti"), gone.select("agent_id").join(registry.select("agent_id"), "agent_id", "left_anti")


def get(registry: DataFrame, agent_id: str) -> DataFrame:
    return registry.filter(F.col("agent_id") == agent_id)


def list_by_status(registry: DataFrame, status: str) -> DataFrame:
    return registry.filter(F.col("status") == status)


def count(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("n"))


def metadata(writes: DataFrame) -> DataFrame:
    """(agent_id, key, value): the last written value of each key."""
    return writes.groupBy("agent_id", "key").agg(F.max_by("value", "seq").alias("value"))


def send(sender: str, board: str, content: Column, seq: Column) -> Column:
    """A post on ``board`` by ``sender``."""
    return F.struct(F.lit(board).alias("board"), seq.alias("seq"), F.lit(sender).alias("sender"), content.alias("content"))
