"""Byte messages as columns: events, payloads and web socket frames, in Arrow batches, with what is wrong in ``_corrupt``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import label
from tidelog.sources import codec

EVENT = "struct<id:string,causal_deps:array<string>,payload_type:string,payload:binary,hlc:bigint,originator:string,signature:binary,session_id:string,group_id:string,_corrupt:string>"
FIELDS = "struct<position:bigint,text:string,length:bigint,key:string,value:binary,_corrupt:string>"


def marshal_event(*columns: Column) -> Column:
    """The bytes of events, from the columns of ``codec.FIELDS`` in their order."""
    def encode(*parts: pd.Series) -> pd.Series:
        names = [n for n, _, _ in codec.FIELDS]
        return pd.Series([codec.encode_event({n: None if v is None or v is pd.NA else list(v) if n == "causal_deps" else int(v) if n == "hlc" else v for n, v in zip(names, row, strict=True)}) for row in zip(*parts, strict=True)], dtype=object)

    return F.pandas_udf(encode, "binary")(*columns)


def _tried(rows: list, blank: dict) -> pd.DataFrame:
    out = []
    for make in rows:
        try:
            out.append({**blank, **make(), "_corrupt": None})
        except ValueError as wrong:
            out.append({**blank, "_corrupt": str(wrong)})
    return pd.DataFrame(out, columns=[*blank, "_corrupt"])


def unmarshal_event(data: Column) -> Column:
    """A struct of the event's fields; where the bytes are none, nulls and the reason in _corrupt."""
    blank = {n: None for n, _, _ in codec.FIELDS}

    def decode(s: pd.Series) -> pd.DataFrame:
        out = _tried([lambda b=b: codec.decode_event(bytes(b if b is not None else b"\xff")) for b in s], blank)
        out["hlc"] = out["hlc"].astype("Int64")
        return out

    return F.pandas_udf(decode, EVENT)(data)


def marshal_payload(op: str, **columns: Column) -> Column:
    names = list(columns)

    def encode(*parts: pd.Series) -> pd.Series:
        kinds = {n: k for n, _, k in codec.PAYLOADS[op]}
        value = lambda n, v: None if v is None or v is pd.NA else int(v) if kinds[n] == "i" else v
        return pd.Series([codec.encode_payload(op, {n: value(n, v) for n, v in zip(names, row, strict=True)}) for row in zip(*parts, strict=True)], dtype=object)

    return F.pandas_udf(encode, "binary")(*columns.values())


def with_payload(df: DataFrame) -> DataFrame:
    """``df`` (payload_type, payload) with op and the fields of its payload: what states are folded from.

    A payload type that the engine does not know has op "unknown" and the reason in _corrupt.
    """
    blank = dict.fromkeys(("position", "text", "length", "key", "value"))

    def decode(kinds: pd.Series, data: pd.Series) -> pd.DataFrame:
        shown = lambda k, b: {n: v for n, v in codec.decode_payload(label(k or ""), bytes(b if b is not None else b"")).items() if n in blank}
        out = _tried([lambda k=k, b=b: shown(k, b) for k, b in zip(kinds, data, strict=True)], blank)
        return out.assign(position=out["position"].astype("Int64"), length=out["length"].astype("Int64"))

    op = F.pandas_udf(lambda s: s.map(lambda k: label(k or "")), "string")
    found = df.withColumn("op", op("payload_type")).withColumn("_p", F.pandas_udf(decode, FIELDS)("payload_type", "payload"))
    return found.select(*[c for c in found.columns if c != "_p"], "_p.*")


def ws_frame(payload: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda b: codec.ws_frame(bytes(b))), "binary")(payload)


def ws_payload(frame: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda b: codec.ws_read(bytes(b))[1]), "binary")(frame)


def ws_key(request: Column) -> Column:
    """The key that a handshake's header names, in any case; null if none."""
    found = F.regexp_extract(request, r"(?im)^sec-websocket-key:[\x20\t]*([^\r\n]*?)[\x20\t]*\r?$", 1)
    return F.when(found != "", found)


def id_text(hlc: Column, node: Column) -> Column:
    """An operation's id as text: the clock in base 36, then the node."""
    return F.concat(F.lower(F.conv(hlc.cast("string"), 10, 36)), F.lit("@"), node)
