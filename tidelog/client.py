"""A client's view: sessions, documents, edits and state over a log table, and the message board and peers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import security
from tidelog.operators import crdt, persistence, scan, sync
from tidelog.schema import LogError

ROW = "seq BIGINT, id STRING, causal_deps ARRAY<STRING>, payload_type STRING, hlc BIGINT, originator STRING, signature BINARY, session_id STRING, group_id STRING, op STRING, key STRING, value STRING, position BIGINT, text STRING, length BIGINT"


class EventLog:
    """An append-only log: a Parquet table of ROW. One writer numbers the rows; any number may read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROW).option("ignoreMissingFiles", "true").parquet(self.path) if self.exists() else self.spark.createDataFrame([], ROW)

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def append(self, rows: list[dict]) -> None:
        names = [f.split()[0] for f in ROW.split(", ")]
        start = (self.rows().agg(F.max("seq")).first()[0] or 0) + 1 if self.exists() else 1
        rows = [{"causal_deps": [], **r, "seq": start + i} for i, r in enumerate(rows)]
        scan.append(self.path, self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ROW).coalesce(1))

    def scan(self, **kwargs) -> DataFrame:
        return scan.scan(self.rows(), **kwargs)

    def stats(self) -> DataFrame:
        return scan.stats(self.rows())

    def manifest(self) -> DataFrame:
        return persistence.manifest(self.rows())


class Group:
    """One document or map of a session; its id is session/name."""

    def __init__(self, client: Client, session_id: str, name: str):
        self.client, self.session_id, self.id = client, session_id, f"{session_id}/{name}"

    def _put(self, op: str, **fields) -> dict:
        return self.client.record(op, session_id=self.session_id, group_id=self.id, **fields)

    def insert(self, position: int, text: str) -> dict:
        return self._put("text_insert", position=position, text=text, length=0)

    def delete(self, position: int, length: int) -> dict:
        return self._put("text_delete", position=position, text="", length=length)

    def set(self, key: str, value: str) -> dict:
        return self._put("map_set", key=key, value=value)

    def unset(self, key: str) -> dict:
        return self._put("map_delete", key=key)

    def rows(self) -> DataFrame:
        return self.client.log.rows().filter(F.col("group_id") == self.id)

    def text(self) -> str:
        found = crdt.text_fold(self.rows().filter("op IN ('text_insert', 'text_delete')"), "group_id").first()
        return found["text"] if found else ""

    def get(self, key: str) -> str | None:
        found = crdt.lww_map(self.rows().filter(F.col("key") == key)).first()
        return found["value"] if found else None

    def versions(self) -> dict[str, int]:
        return {r["originator"]: r["hlc"] for r in sync.version_vector(self.rows()).collect()}

    def subscribe(self, fn: Callable[[DataFrame], None], checkpoint: str):
        """Calls ``fn`` with every micro-batch of the group's new rows; returns the query, whose stop() ends it."""
        stream = self.client.spark.readStream.schema(ROW).parquet(self.client.log.path).filter(F.col("group_id") == self.id)
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: fn(df)).start()


class Client:
    def __init__(self, spark: SparkSession, node_id: str, path: str, seed: bytes | None = None, clock: Callable[[], int] = time.time_ns):
        self.spark, self.clock, self.seed = spark, clock, seed
        self.node_id = security.identity(seed) if seed else node_id
        self.log, self._n, self.links = EventLog(spark, path), 0, {}

    def join(self, session_id: str) -> Session:
        return Session(self, session_id)

    def record(self, op: str, **fields) -> dict:
        self._n += 1
        hlc = self.clock()
        event = {"id": f"{self.node_id}-{hlc}-{self._n}", "hlc": hlc, "originator": self.node_id, "op": op, "payload_type": op, **fields}
        if self.seed:
            event["signature"] = security.sign(self.seed, "|".join([event["id"], "", op, _payload(event), str(hlc)]).encode())
        self.log.append([event])
        return event

    def send(self, event: dict) -> dict:
        """Appends a finished event as this node's."""
        self.log.append([{**event, "originator": self.node_id}])
        return event

    def connect(self, peer: EventLog, checkpoint: str, verify: bool = False):
        """Follows the peer's log: every micro-batch of its new rows is taken over. Returns the streaming query.

        One that has failed goes on from its checkpoint when connect is called again.
        """
        old = self.links.get(peer.path)
        if old is not None and old.isActive:
            return old
        stream = self.spark.readStream.schema(ROW).parquet(peer.path)
        self.links[peer.path] = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: self.take(df, verify)).start()
        return self.links[peer.path]

    def close(self) -> None:
        for link in self.links.values():
            link.stop()
        self.links.clear()

    def pull(self, peer: EventLog, verify: bool = False) -> int:
        """Appends the peer's events that this log lacks; with ``verify`` only if all their signatures hold."""
        return self.take(peer.rows(), verify)

    def take(self, rows: DataFrame, verify: bool = False) -> int:
        """Appends those of ``rows`` that this log lacks; their number."""
        new = sync.events_to_send(rows, sync.version_vector(self.log.rows())).join(self.log.rows().select("id"), "id", "left_anti")
        if verify:
            payload = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PAYLOAD))
            signed = security.sign_bytes(F.col("id"), F.array().cast("array<string>"), F.col("op"), payload.cast("binary"), F.col("hlc"))
            if not new.filter(~security.ed25519_verify(security.unbase64url(F.col("originator")), signed, F.col("signature"))).isEmpty():
                raise LogError("an event's signature does not hold")
        start = self.log.rows().agg(F.max("seq")).first()[0] or 0
        # one pull's events are numbered together: seq is one order over all groups
        before = self.log.rows().count()
        numbered = new.selectExpr("*", f"{start} + row_number() OVER (ORDER BY hlc, originator, id) AS _s").drop("seq").withColumnRenamed("_s", "seq")
        numbered.select(*[f.split()[0] for f in ROW.split(", ")]).write.mode("append").parquet(self.log.path)
        return self.log.rows().count() - before


PAYLOAD = ("key", "value", "position", "text", "length")


def _payload(event: dict) -> str:
    return "\u0001".join("" if event.get(c) is None else str(event[c]) for c in PAYLOAD)


class Session:
    def __init__(self, client: Client, session_id: str):
        self.client, self.id = client, session_id

    def document(self, name: str) -> Group:
        return Group(self.client, self.id, name)
