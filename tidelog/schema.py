"""Canonical schemas and labels."""

from __future__ import annotations

import re

EVENT_LOG = (
    "seq BIGINT, id STRING, causal_deps ARRAY<STRING>, payload_type STRING, payload BINARY, hlc BIGINT, "
    "originator STRING, signature BINARY, session_id STRING, group_id STRING")
WAL = "segment STRING, offset BIGINT, crc_ok BOOLEAN, payload BINARY"
SNAPSHOT_META = "id STRING, path STRING, event_id STRING, hlc BIGINT, size BIGINT, created_at BIGINT, event_from BIGINT, event_to BIGINT"
VERSIONS = "group_id STRING, originator STRING, hlc BIGINT"
MESSAGES = "msg_type INT, group_id STRING, payload BINARY"

# The operations that the engine applies, and the names of states and message types.
OPS = ("text_insert", "text_delete", "map_set", "map_delete")
AGENT_STATES = ("created", "running", "stopped", "paused", "failed")
SYNC_STATES = ("idle", "requested", "in_progress", "complete", "failed")
MESSAGE_TYPES = {1: "event", 2: "sync_request", 3: "sync_response", 4: "ping", 5: "pong", 6: "join", 7: "leave", 8: "key_exchange"}


class LogError(ValueError):
    """A log, snapshot or message that cannot be read or appended."""


EVENT_NOT_FOUND = LogError("event not found")
EMPTY_ID = LogError("empty event id")
NO_SNAPSHOT = LogError("no snapshot")


def label(payload_type: str) -> str:
    """The label of a payload type: its last name in snake case if it is an operation, else unknown."""
    name = re.sub(r"(?<!^)(?=[A-Z])", "_", payload_type.rpartition(".")[2]).lower()
    return name if name in OPS else "unknown"
