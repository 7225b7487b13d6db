"""Byte formats: framed events, write-ahead log entries, snapshots, transport frames."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from tidelog.schema import LogError

# The event frame's magic number and version, and the greatest sizes that a reader takes.
MAGIC, VERSION = 0x4B414952, 1
MOST_EVENT, MOST_WAL = 1 << 30, 16 << 20
# Numbers and wire kinds of an event's fields.
FIELDS = (("id", 1, "s"), ("causal_deps", 2, "r"), ("payload_type", 3, "s"), ("payload", 4, "b"), ("hlc", 5, "i"), ("originator", 6, "s"), ("signature", 7, "b"), ("session_id", 8, "s"), ("group_id", 9, "s"))


def _varint(n: int) -> bytes:
    n, out = n & ((1 << 64) - 1), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data):
            raise LogError("a number is cut off")
        b, at = data[at], at + 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _encode(fields: tuple, values: dict) -> bytes:
    out = b""
    for name, number, kind in fields:
        value = values.get(name)
        if not value:
            continue
        if kind == "i":
            out += _varint(number << 3) + _varint(value)
            continue
        for v in value if kind == "r" else [value]:
            raw = bytes(v) if kind == "b" else v.encode()
            out += _varint(number << 3 | 2) + _varint(len(raw)) + raw
    return out


def _decode(fields: tuple, data: bytes) -> dict:
    out = {name: [] if kind == "r" else b"" if kind == "b" else 0 if kind == "i" else "" for name, _, kind in fields}
    by_number, at = {n: (name, kind) for name, n, kind in fields}, 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        if tag & 7 == 0:
            value, at = _read_varint(data, at)
        elif tag & 7 in (1, 5):
            value, at = None, at + (8 if tag & 7 == 1 else 4)
        elif tag & 7 == 2:
            n, at = _read_varint(data, at)
            if at + n > len(data):
                raise LogError("a field is cut off")
            value, at = data[at : at + n], at + n
        else:
            raise LogError("unknown wire type")
        if (known := by_number.get(tag >> 3)) and value is not None:
            name, kind = known
            if isinstance(value, int) != (kind == "i"):
                raise LogError("a field has the wrong wire type")
            if kind == "i":
                out[name] = value - (1 << 64) if value >> 63 else value
            elif kind == "r":
                out[name].append(value.decode())
            else:
                out[name] = value if kind == "b" else value.decode()
    return out


def encode_event(event: dict) -> bytes:
    return _encode(FIELDS, event)


def decode_event(data: bytes) -> dict:
    return _decode(FIELDS, data)


def frame(event: dict) -> bytes:
    body = encode_event(event)
    return struct.pack(">IHQ", MAGIC, VERSION, len(body)) + body


def frames(f: BinaryIO) -> Iterator[tuple[int, dict]]:
    """(offset, event) of each frame; the file must end between two."""
    at = 0
    while head := f.read(14):
        if len(head) < 14:
            raise LogError("a frame's head is cut off")
        magic, version, n = struct.unpack(">IHQ", head)
        if magic != MAGIC:
            raise LogError("invalid magic number")
        if version != VERSION:
            raise LogError("unsupported version")
        if n > MOST_EVENT:
            raise LogError("event too large")
        body = f.read(n)
        if len(body) < n:
            raise LogError("a frame is cut off")
        yield at, decode_event(body)
        at += 14 + n


def wal_entry(event: dict) -> bytes:
    body = encode_event(event)
    return struct.pack(">II", zlib.crc32(body), len(body)) + body


def wal_entries(f: BinaryIO, mode: str = "FAILFAST") -> Iterator[tuple[int, bool, bytes]]:
    """(offset, crc_ok, payload) of each entry. A torn or wrong one is an error, or ends the segment (DROPMALFORMED);
    PERMISSIVE gives wrong ones with crc_ok false and goes on."""
    at = 0
    while head := f.read(8):
        crc, n = struct.unpack(">II", head) if len(head) == 8 else (0, -1)
        body = f.read(n) if 0 <= n <= MOST_WAL else b""
        whole = len(body) == n
        ok = whole and zlib.crc32(body) == crc
        if not ok:
            if mode == "FAILFAST":
                raise LogError(f"bad entry at {at}")
            if mode == "DROPMALFORMED" or not whole:
                return
        yield at, ok, body
        at += 8 + n


def snapshot(header: dict, events: list[dict]) -> bytes:
    parts = [json.dumps(header, sort_keys=True).encode(), *(encode_event(e) for e in events)]
    return b"".join(struct.pack(">Q", len(p)) + p for p in parts)


def _snapshot_parts(f: BinaryIO) -> Iterator[bytes]:
    while head := f.read(8):
        n = struct.unpack(">Q", head)[0] if len(head) == 8 else MOST_EVENT + 1
        if n > MOST_EVENT or len(body := f.read(n)) < n:
            raise LogError("a snapshot's entry is cut off")
        yield body


def snapshot_events(f: BinaryIO) -> Iterator[tuple[dict, dict]]:
    """(header, event) for each event of a snapshot, read one at a time."""
    header = None
    for part in _snapshot_parts(f):
        if header is None:
            header = json.loads(part)
        else:
            yield header, decode_event(part)
    if header is None:
        raise LogError("a snapshot has a header at least")


def read_snapshot(f: BinaryIO) -> tuple[dict, list[dict]]:
    parts = list(_snapshot_parts(f))
    if not parts:
        raise LogError("a snapshot has a header at least")
    return json.loads(parts[0]), [decode_event(p) for p in parts[1:]]


def message(msg_type: int, group_id: str, payload: bytes) -> bytes:
    group = group_id.encode()
    return struct.pack(">BH", msg_type, len(group)) + group + struct.pack(">I", len(payload)) + payload


def messages(f: BinaryIO) -> Iterator[tuple[int, str, bytes]]:
    while head := f.read(3):
        if len(head) < 3:
            raise LogError("a message is cut off")
        kind, n = struct.unpack(">BH", head)
        group, size = f.read(n), f.read(4)
        if len(group) < n or len(size) < 4:
            raise LogError("a message is cut off")
        payload = f.read(m := struct.unpack(">I", size)[0])
        if len(payload) < m:
            raise LogError("a message is cut off")
        yield kind, group.decode(), payload


# --- payloads -----------------------------------------------------------------------------------------------------

# Numbers and wire kinds of the fields of payload messages, by the operation.
PAYLOADS = {
    "text_insert": (("doc_id", 1, "s"), ("position", 2, "i"), ("text", 3, "s"), ("after_id", 4, "s")),
    "text_delete": (("doc_id", 1, "s"), ("position", 2, "i"), ("length", 3, "i")),
    "map_set": (("map_id", 1, "s"), ("key", 2, "s"), ("value", 3, "b")),
    "map_delete": (("map_id", 1, "s"), ("key", 2, "s")),
}


def encode_payload(op: str, fields: dict) -> bytes:
    return _encode(PAYLOADS[op], fields)


def decode_payload(op: str, data: bytes) -> dict:
    """The fields of a payload message; an operation that is not known is an error."""
    if op not in PAYLOADS:
        raise LogError(f"unknown payload type: {op}")
    return _decode(PAYLOADS[op], data)


# --- web socket frames ----------------------------------------------------------------------------------------------


def ws_frame(payload: bytes) -> bytes:
    """A whole text frame, not masked."""
    n = len(payload)
    head = bytes([n]) if n <= 125 else struct.pack(">BH", 126, n) if n <= 65535 else struct.pack(">BQ", 127, n)
    return b"\x81" + head + payload


def ws_read(data: bytes) -> tuple[int, bytes, int]:
    """(opcode, payload, bytes taken) of the frame that ``data`` begins with."""
    if len(data) < 2:
        raise LogError("a frame's head is cut off")
    n, at = data[1] & 127, 2
    if n > 125:
        width = 2 if n == 126 else 8
        n, at = int.from_bytes(data[2 : 2 + width], "big"), 2 + width
    mask = data[at : at + 4] if data[1] & 128 else b""
    at += len(mask)
    payload = data[at : at + n]
    if len(payload) < n:
        raise LogError("a frame is cut off")
    if mask:
        payload = bytes(b ^ mask[i % 4] for i, b in enumerate(payload))
    return data[0] & 15, payload, at + n
