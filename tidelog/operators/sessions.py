"""Key sessions with peers: a table (peer_id, key, created) that payloads are encrypted and decrypted by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import security


def establish(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """``sessions`` with those of ``new`` put in; a peer's older session is replaced."""
    return sessions.join(new.select("peer_id"), "peer_id", "left_anti").unionByName(new)


def rotate(sessions: DataFrame, due: DataFrame, now: int) -> DataFrame:
    """The next key for the peers of ``due`` (peer_id), created at ``now`` seconds."""
    marked = sessions.join(due.select("peer_id", F.lit(True).alias("_due")).distinct(), "peer_id", "left")
    turn = F.col("_due").isNotNull()
    return marked.select("peer_id", F.when(turn, security.rotate(F.col("key"))).otherwise(F.col("key")).alias("key"), F.when(turn, F.lit(now).cast("long")).otherwise(F.col("created")).alias("created"))


def overdue(sessions: DataFrame, max_age: int, as_of: int) -> DataFrame:
    """Peers whose key is older than ``max_age`` seconds."""
    return sessions.filter(security.needs_rotation(F.col("created"), max_age, as_of)).select("peer_id")


def missing(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Peers of ``rows`` that have no session."""
    return rows.select("peer_id").distinct().join(sessions.select("peer_id"), "peer_id", "left_anti")


def encrypt_for(rows: DataFrame, sessions: DataFrame, payload: str) -> DataFrame:
    """``rows`` (with peer_id) with ``payload`` under the peer's key (AES-GCM: nonce, text, tag); those without a session are left out."""
    keyed = rows.join(sessions.select("peer_id", F.col("key").alias("_key")), "peer_id")
    return keyed.withColumn(payload, F.aes_encrypt(F.col(payload), F.col("_key"), F.lit("GCM"))).drop("_key")


def decrypt_from(rows: DataFrame, sessions: DataFrame, payload: str) -> DataFrame:
    """The inverse, as binary; null where the key is not the one it was encrypted with."""
    keyed = rows.join(sessions.select("peer_id", F.col("key").alias("_key")), "peer_id")
    return keyed.withColumn(payload, F.try_aes_decrypt(F.col(payload), F.col("_key"), F.lit("GCM"))).drop("_key")


def from_handshake(sessions: DataFrame, hellos: DataFrame, private: bytes, now: int) -> DataFrame:
    """``sessions`` with those agreed on with the public keys of ``hellos`` (peer_id, public): X25519, hashed to a key.

    The agreement is reckoned in Python, one for each peer, on all cores. A public key of another length is left out.
    """
    good = security.spread(hellos.select("peer_id", "public").filter(F.length("public") == 32))
    return establish(sessions, good.select("peer_id", shared_key(F.lit(bytearray(private)), F.col("public")).alias("key"), F.lit(now).cast("long").alias("created")))


def shared_key(private: Column, public: Column) -> Column:
    return F.unhex(F.sha2(security.x25519_agree(private, public), 256))


def remove(sessions: DataFrame, gone: DataFrame) -> DataFrame:
    return sessions.join(gone.select("peer_id"), "peer_id", "left_anti")


def has(sessions: DataFrame, peers: DataFrame) -> DataFrame:
    """(peer_id, has) for each of ``peers``."""
    known = sessions.select("peer_id", F.lit(True).alias("_has")).distinct()
    return peers.select("peer_id").distinct().join(known, "peer_id", "left").select("peer_id", F.coalesce("_has", F.lit(False)).alias("has"))


def active(sessions: DataFrame) -> DataFrame:
    return sessions.select("peer_id").distinct()
