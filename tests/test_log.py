"""Fixtures of the log, the byte formats, states and security functions."""

import io
import itertools
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.client import Client, EventLog
from tidelog.functions import security
from tidelog.operators import agents, bloom, crdt, persistence, scan, sessions
from tidelog.schema import LogError, label
from tidelog.sources import codec, formats

EVENT = {"id": "test-id", "causal_deps": ["dep1", "dep2"], "payload_type": "test-type", "payload": b"\0p", "hlc": 12345, "originator": "user1", "signature": b"", "session_id": "s1", "group_id": "g1"}


def log_of(spark, rows):
    return spark.createDataFrame(rows, "seq long, id string, hlc long, originator string, group_id string, session_id string, op string, key string, value string")


def simple(spark, n, ident=str, hlc=lambda i: i):
    return log_of(spark, [(i, ident(i), hlc(i), "n", "g1", "s", "map_set", "k", str(i)) for i in range(n)])


def test_scan_limits_and_places(spark):
    log = simple(spark, 2500)
    assert scan.scan(log).count() == 2500 and scan.scan(log, compat=True).count() == 1000
    assert [r.id for r in scan.scan(log, limit=3, reverse=True).collect()] == ["2499", "2498", "2497"]
    assert [r.id for r in scan.scan(log, reverse=True, compat=True).collect()] == ["2499"]
    assert scan.scan(log, after_id="unknown").count() == 2500 and scan.scan(log, after_id="2490").count() == 9
    assert scan.scan(log, before_id="3").count() == 3 and scan.scan(log, before_id="3", compat=True, limit=5000).count() == 2499


def test_duplicates(spark):
    log = simple(spark, 100, ident=lambda i: f"ev-{i % 10}")
    assert scan.stats(log).first()["event_count"] == 100 and scan.get(log, "ev-2").first()["hlc"] == 92
    assert scan.scan(log, after_id="ev-2").count() == 7 and scan.dedupe(log).count() == 10
    with pytest.raises(LogError):
        scan.get(log, "none", strict=True)


def test_empty_id_rejects_the_batch(spark, tmp_path):
    with pytest.raises(LogError):
        scan.append(str(tmp_path / "log"), spark.createDataFrame([("a",), ("",), ("b",)], "id string"))
    assert not os.path.exists(tmp_path / "log")


def test_map_tombstones_and_ties(spark):
    rows = [(1, "a", 1, "n1", "g", "s", "map_delete", "x", None), (2, "b", 2, "n1", "g", "s", "map_set", "y", "1"), (3, "c", 3, "n1", "g", "s", "map_delete", "y", None),
            (4, "d", 5, "n1", "g", "s", "map_set", "z", "late"), (5, "e", 4, "n1", "g", "s", "map_set", "z", "early"), (6, "f", 9, "n2", "g", "s", "map_set", "t", "n2"), (7, "g", 9, "n1", "g", "s", "map_set", "t", "n1")]
    log = log_of(spark, rows)
    assert {r.key: r.value for r in crdt.lww_map(log).collect()} == {"y": None, "z": "late", "t": "n2"}
    assert {r.key: r.value for r in crdt.lww_map(log, "arrival").collect()} == {"y": None, "z": "early", "t": "n1"}
    assert tuple(crdt.map_sizes(crdt.lww_map(log)).first()) == ("g", 2, 3)


def test_counter_merge_laws(spark):
    state = lambda rows: spark.createDataFrame([("g", *r) for r in rows], "group_id string, originator string, count long")
    a, b = state([("n1", 7)]), state([("n2", 3), ("n1", 7)])
    value = lambda s: crdt.gcounter_value(s).first()["value"]
    assert value(crdt.gcounter_merge(a, b)) == value(crdt.gcounter_merge(b, a)) == value(crdt.gcounter_merge(a, b, b)) == 10


OPS = st.lists(st.tuples(st.sampled_from(["text_insert", "text_delete"]), st.integers(-3, 12), st.text("ab😀é", max_size=4), st.integers(-1, 6)), max_size=8)


@settings(max_examples=15, deadline=None)
@given(st.lists(OPS, min_size=1, max_size=5))
def test_text_folds_agree(spark, docs):
    rows = [(d, i, *op) for d, ops in enumerate(docs) for i, op in enumerate(ops)]
    if not rows:
        return
    df = spark.createDataFrame(rows, "doc long, seq long, op string, position long, text string, length long")
    want = {}
    for d, _, op, p, t, n in rows:
        s = want.get(d, "")
        lo, hi = max(p, 0), max(p + n, 0)
        want[d] = s[:lo] + t + s[lo:] if op == "text_insert" else s if hi <= lo else s[:lo] + s[hi:]
    assert {r.doc: r.text for r in crdt.text_fold(df, "doc").collect()} == want
    assert {r.doc: r.text for r in crdt.fold_in_pandas(df, "doc").collect()} == want


def test_rga_merge_is_symmetric(spark):
    node = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "doc_id long, ts long, node string, ch string, removed boolean")
    a, b = node([(1, "a", "H", False), (2, "a", "x", False)]), node([(2, "a", "x", True), (3, "b", "i", False)])
    texts = {crdt.rga_text(crdt.rga_merge(*p)).first()["text"] for p in itertools.permutations((a, b))}
    assert texts == {"Hi"}


def test_runs_are_merged_like_their_nodes(spark, monkeypatch):
    """Overlapping runs of three states, repeated ids and null, wide characters, texts cut off at every batch; no node is a row of the shuffle."""
    import random

    from tidelog.operators import runs

    r, rows = random.Random(3), []
    for doc in (5, None, 2**62, -1, 7, 7):
        for _ in range(4):
            chars = "".join(r.choice("ab\u00e9\U0001f600\n0") for _ in range(r.randrange(9)))
            rows.append((doc, r.choice("ab\u00e9"), r.randrange(4), r.randrange(1, 3), chars, r.choice([None, "".join(r.choice("01") for _ in chars)])))
    rows.append((8, "a", 1, 1, "xy", "11"))
    node = [(d, f + s * i, n, c, bool(g) and g[i] == "1") for d, n, f, s, chars, g in rows for i, c in enumerate(chars)]
    state = crdt.rga_merge(spark.createDataFrame(node, "doc_id long, ts long, node string, ch string, removed boolean"))
    of = lambda df: sorted(map(tuple, df.collect()), key=repr)
    packed = spark.createDataFrame(rows, f"doc_id long, {runs.SCHEMA}")
    for chars in (1, runs.CHARS):
        monkeypatch.setattr(runs, "CHARS", chars)
        assert of(runs.nodes(packed)) == of(crdt.rga_compact(state).select("doc_id", "ts", "node", "ch", "removed")) and of(runs.texts(packed)) == of(crdt.rga_text(state))
    assert runs.nodes(packed.limit(0)).count() == runs.texts(packed.limit(0)).count() == 0
    from tidelog.plans import log_queries

    plan = log_queries.QUERIES["rga_compact"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Aggregate" not in plan


def test_runs_are_made_where_texts_have_met(spark, tmp_path):
    """The shuffle takes each text once, not with each of its runs; rows of one id, in several files, are still one text."""
    import os

    from oracle import SF, TABLES, compare

    from tidelog.plans import log_queries

    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = [(1, "first text"), (2, "ab\u00e9\n" * 9), (3, ""), (4, None), (1, "FIRST text, longer"), (5, "x" * 70_000), (None, "no id"), (2, "zzz"), (None, "none")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("rga_state_merge", "rga_compact"):
        assert compare(spark, log_queries.QUERIES[name], log_queries.SQL[name], str(tmp_path)) > 0
        plan = log_queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == 1 and plan.index("Generate") < plan.index("RepartitionByExpression")


def test_formats(spark, tmp_path):
    formats.register(spark)
    two = codec.frame(EVENT) + codec.frame({**EVENT, "id": "b", "hlc": -1})
    assert [e["id"] for _, e in codec.frames(io.BytesIO(two))] == ["test-id", "b"]
    (tmp_path / "x.log").write_bytes(two)
    got = spark.read.format("tide_log").load(str(tmp_path)).orderBy("_offset").collect()
    assert got[0]["causal_deps"] == ["dep1", "dep2"] and got[1]["hlc"] == -1
    spark.createDataFrame([EVENT], formats.LOG.split("BIGINT, ", 1)[1]).coalesce(1).write.format("tide_log").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("tide_log").load(str(tmp_path / "out")).first()["payload"] == b"\0p"
    for bad in (two[:-1], b"XXXX" + two[4:], two[:5]):
        with pytest.raises(LogError):
            list(codec.frames(io.BytesIO(bad)))
    header, events = codec.read_snapshot(io.BytesIO(codec.snapshot({"id": "s"}, [EVENT])))
    assert header == {"id": "s"} and events[0] == EVENT
    import gzip

    (tmp_path / "snaps").mkdir()
    (tmp_path / "snaps" / "a.snap").write_bytes(codec.snapshot({"id": "s"}, [EVENT, EVENT]))
    (tmp_path / "snaps" / "b.snap").write_bytes(gzip.compress(codec.snapshot({"id": "t"}, [EVENT])))
    assert sorted((r.snapshot_id, r.id) for r in spark.read.format("tide_snapshot").load(str(tmp_path / "snaps")).collect()) == [("s", "test-id"), ("s", "test-id"), ("t", "test-id")]
    assert list(codec.messages(io.BytesIO(codec.message(1, "test", b"data") + codec.message(8, "", b"")))) == [(1, "test", b"data"), (8, "", b"")]


def test_damaged_wal(spark, tmp_path):
    formats.register(spark)
    data = b"".join(codec.wal_entry({**EVENT, "id": str(i)}) for i in range(10))
    for name, raw in (("1.wal", data), ("2.wal", data[:-1] + bytes([data[-1] ^ 1])), ("3.wal", data[:-3]), ("4.wal", data[:12])):
        (tmp_path / name).write_bytes(raw)
    read = lambda mode: {r.segment: r["count"] for r in spark.read.format("tide_wal").option("mode", mode).load(str(tmp_path)).groupBy("segment").count().collect()}
    assert read("DROPMALFORMED") == {"1.wal": 10, "2.wal": 9, "3.wal": 9} and read("PERMISSIVE")["2.wal"] == 10
    with pytest.raises(Exception, match="bad entry"):
        read("FAILFAST")


def test_bloom(spark):
    bits, k = bloom.size_for(100, 0.01)
    assert (bits, k) == (959, 7) and bloom.size_for(1, 0.5) == (64, 1)
    items = spark.createDataFrame([(f"item-{i}",) for i in range(50)], "s string")
    words = bloom.build(items, "s", bits, k)
    assert bloom.contains(items, "s", words, bits, k).filter("maybe").count() == 50
    assert 30 <= bloom.estimate(words, bits, k).first()["items"] <= 70
    as_dict = {r.word: r.value for r in words.collect()}
    again, b, kk = bloom.deserialize(bloom.serialize(as_dict, bits, k))
    assert (b, kk) == (bits, k) and {i: w for i, w in again.items() if w} == {i: w % 2**64 for i, w in as_dict.items()}
    with pytest.raises(ValueError):
        bloom.deserialize(b"short")


def test_bloom_filter_grows_with_its_items(spark):
    from tidelog.plans import other_queries

    log = spark.range(30_000).select(F.sha2(F.col("id").cast("string"), 256).alias("originator"))  # FNV spreads short names badly
    size = other_queries.filter_size(log)
    got = bloom.estimate(bloom.build(log, "originator", *size), *size).first()
    assert 29_000 < got["items"] < 31_000 and got["false_positive_rate"] < 0.002


def test_agent_lifecycle(spark):
    rows = [("a", i, i, c) for i, c in enumerate(["resume", "start", "pause", "resume", "stop", "stop"])] + [("b", 0, 5, "start"), ("b", 1, 6, "start")]
    got = {r.agent_id: (r.status, r.errors, r.last_active) for r in agents.lifecycle(spark.createDataFrame(rows, "agent_id string, seq long, hlc long, command string")).collect()}
    assert got == {"a": ("stopped", 2, 1), "b": ("running", 1, 5)}


def test_snapshots_over_batches(spark):
    b = spark.createDataFrame([(i, 7) for i in range(4)], "batch long, rows long")
    assert [r.event_to for r in persistence.boundaries(b, 10).orderBy("batch").collect()] == [14, 21]


def test_security(spark, tmp_path):
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert security.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert security.sign(seed, b"").hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert not security.verify(security.public_key(seed), b"x", security.sign(seed, b""))
    u = bytes.fromhex("e6db6867583030db3594c1a424b15f7c726624ec26b3353b10a903a6d0ab1c4c")
    k = bytes.fromhex("a546e36bf0527c9d3b16154b82465edd62144c0ac1fc5a18506a2244ba449ac4")
    assert security.x25519(k, u).hex() == "c3da55379de9c6908e94ea4df28d084f32eccf03491c71f754b4075577a28552"
    cap = {"resource": "session/x", "permissions": ["read", "write"], "issuer": "n1", "subject": "n2", "expires": 99}
    assert security.decode_token(security.encode_token(cap, b"sig")) == (cap, b"sig")
    token, public = security.issue_capability(cap, seed), security.public_key(seed)
    assert security.verify_capability(token, public, 99) and not security.verify_capability(token, public, 100) and not security.verify_capability(token, security.public_key(bytes(32)), 1)
    security.save_identity(str(tmp_path / "keys" / "own.key"), seed)
    assert security.load_identity(str(tmp_path / "keys" / "own.key")) == seed and (tmp_path / "keys" / "own.key").stat().st_mode & 0o777 == 0o600
    df = spark.createDataFrame([(bytearray(bytes(range(n))),) for n in range(5)], "b binary").select("b", security.base64url(F.col("b")).alias("t"))
    assert all(r.x == r.b for r in df.select("b", security.unbase64url(F.col("t")).alias("x")).collect())


def test_curves_of_many_rows_are_those_of_each(spark):
    """One key in many rows and keys in few, damaged and odd signatures, points of the curve, its twist and small order."""
    import random

    from tidelog.functions import curve

    r = random.Random(5)
    seed, other = bytes(range(32)), bytes(32)
    pub, n = security.public_key(seed), curve.OFTEN + 7
    texts = [r.randbytes(r.randrange(70)) for _ in range(n)]
    signed = curve.sign_all(seed, [*texts, None])
    assert signed[-1] is None and signed[:9] == [security.sign(seed, t) for t in texts[:9]]
    flip = lambda s, i, b=1: s[:i] + bytes([s[i] ^ b]) + s[i + 1 :]
    odd = [flip(signed[0], 0), flip(signed[1], 31, 128), flip(signed[2], 40), signed[3][:32] + (int.from_bytes(signed[3][32:], "little") + security.ORDER).to_bytes(32, "little"),
           (security.P + 1).to_bytes(32, "little") + signed[4][32:], (1).to_bytes(32, "little") + bytes(32), b"", None]
    rows = [(pub, t, s) for t, s in zip(texts, odd + signed[len(odd) : n], strict=True)]
    rows += [(security.public_key(other), b"x", security.sign(other, b"x")), (b"short", b"x", signed[0]), (None, b"x", signed[0]), (pub, None, signed[0]), (b"\xff" * 32, b"x", signed[0])]
    want = [security.verify(*row) for row in rows]
    assert curve.verify_all(*map(list, zip(*rows, strict=True))) == want and sum(want) == n - len(odd) + 1
    for u in (9, 0, 1, security.P - 1, security.P + 3, r.getrandbits(255), r.getrandbits(255), r.getrandbits(256)):
        scalars, us = [r.randbytes(32) for _ in range(curve.OFTEN)], [u.to_bytes(32, "little")] * curve.OFTEN
        expected = [security.x25519(k, us[0]) for k in scalars[:12]]
        assert curve.x25519_all(scalars, us)[:12] == expected == curve.x25519_all(scalars[:12], us[:12])
    df = security.spread(spark.createDataFrame([(bytearray(32), bytearray(b"\t" + bytes(31))), (None, bytearray(32)), (bytearray(3), bytearray(32))], "k binary, u binary").coalesce(1))
    got = df.select("k", security.x25519_agree(F.col("k"), F.col("u")).alias("x"), F.spark_partition_id().alias("p")).collect()
    assert df.rdd.getNumPartitions() > 1 and [x.x for x in got if x.k and len(x.k) == 32] == [security.x25519(bytes(32), b"\t" + bytes(31))] and sum(x.x is None for x in got) == 2


def test_first_failure_checks_signatures_once(spark):
    rows = spark.createDataFrame([(3, bytearray(b"m"), bytearray(b"s" * 64)), (1, bytearray(b"m"), None), (0, bytearray(b"m"), bytearray(security.sign(bytes(32), b"m")))], "seq long, m binary, s binary")
    key = F.lit(bytearray(security.public_key(bytes(32))))
    first = lambda df: security.first_failure(df.select("seq", security.wrong_signature(key, F.col("m"), F.col("s")).alias("reason")))
    assert tuple(first(rows).first()) == (1, "no signature", 2) and tuple(first(rows.filter("seq = 0")).first()) == (None, None, 0)
    assert first(rows)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_sessions(spark):
    old = spark.createDataFrame([("a", bytearray(32), 0), ("b", bytearray(b"k" * 32), 50)], "peer_id string, key binary, created long")
    new = spark.createDataFrame([("a", bytearray(b"n" * 32), 90)], "peer_id string, key binary, created long")
    now = sessions.establish(old, new)
    assert sorted((r.peer_id, r.created) for r in now.collect()) == [("a", 90), ("b", 50)]
    rows = spark.createDataFrame([("a", bytearray(b"hello")), ("b", None), ("c", bytearray(b"x"))], "peer_id string, body binary")
    sealed = sessions.encrypt_for(rows, now, "body")
    assert sorted((r.peer_id, r.body) for r in sessions.decrypt_from(sealed, now, "body").collect()) == [("a", b"hello"), ("b", None)]
    assert all(r.body is None for r in sessions.decrypt_from(sealed, old, "body").collect())
    assert [r.peer_id for r in sessions.missing(rows, now).collect()] == ["c"]


def test_labels():
    assert label("any.v1.TextInsert") == "text_insert" and label("any.v1.MapDelete") == "map_delete" and label("other") == "unknown"


def test_client_edits_and_pulls(spark, tmp_path):
    a = Client(spark, "a", str(tmp_path / "a"), seed=bytes(range(32)))
    b = Client(spark, "b", str(tmp_path / "b"))
    doc = a.join("s").document("d")
    doc.insert(0, "Hello")
    doc.insert(5, " World")
    doc.delete(0, 1)
    doc.set("k", "v")
    assert doc.text() == "ello World" and doc.get("k") == "v" and list(doc.versions()) == [a.node_id]
    assert b.pull(a.log, verify=True) == 4 and b.pull(a.log) == 0
    assert b.join("s").document("d").text() == "ello World"
    a.log.append([{"id": "forged", "hlc": 1 << 62, "originator": a.node_id, "op": "map_set", "group_id": "s/d", "key": "k", "value": "x"}])
    with pytest.raises(LogError):
        b.pull(a.log, verify=True)
    from tidelog import replay

    assert replay.main(["--dir", str(tmp_path / "a")], spark)[0][1] == "ello World"
    assert EventLog(spark, str(tmp_path / "none")).rows().count() == 0


def test_pull_numbers_all_groups_together(spark, tmp_path):
    a, b = Client(spark, "a", str(tmp_path / "a")), Client(spark, "b", str(tmp_path / "b"))
    for name in ("d1", "d2"):
        a.join("s").document(name).insert(0, name)
    assert b.pull(a.log) == 2 and sorted(r.seq for r in b.log.rows().collect()) == [1, 2]


def test_client_follows_a_peer(spark, tmp_path):
    a, b = Client(spark, "a", str(tmp_path / "a")), Client(spark, "b", str(tmp_path / "b"))
    a.join("s").document("d").insert(0, "one")
    link = b.connect(a.log, str(tmp_path / "check"))
    link.processAllAvailable()
    a.join("s").document("d").insert(3, " two")
    link.processAllAvailable()
    assert b.join("s").document("d").text() == "one two" and b.connect(a.log, str(tmp_path / "check")) is link
    b.close()
    assert not link.isActive


def test_engine_rotates_snapshots_and_recovers(spark, tmp_path):
    from tidelog.operators.engine import Engine
    from tidelog.schema import LogError

    rows = lambda lo, hi: spark.createDataFrame([(f"e{i}", i) for i in range(lo, hi)], "id string, hlc long").repartition(3)
    at = str(tmp_path / "engine")
    engine = Engine(spark, at, "id STRING, hlc BIGINT", snapshot_interval=10, retention=2, segment_bytes=1)
    for lo in range(0, 35, 7):
        assert engine.append(rows(lo, lo + 7)) == 7
    assert len(engine.segments()) == 5 and engine.segments() == sorted(engine.segments())
    assert [r.event_to for r in engine.snapshots().orderBy("id").collect()] == [21, 35] and len(engine.files.names("snapshots")) == 2
    assert sorted(r.seq for r in engine.log().collect()) == list(range(35))
    with pytest.raises(LogError):
        engine.append(spark.createDataFrame([("", 1)], "id string, hlc long"))
    engine.log_ahead(rows(35, 40))
    again = Engine(spark, at, "id STRING, hlc BIGINT")
    assert again.recovered == 5 and again.stats()["events"] == 40 and again.manifest["last_event_id"] == "e39" and len(again.manifest["snapshots"]) == 2
    assert sorted(r.id for r in again.restore_latest().collect()) == sorted(f"e{i}" for i in range(40))
    assert sorted(r.seq for r in again.log().collect()) == list(range(40)) and Engine(spark, at, "id STRING, hlc BIGINT").recovered == 0
    with pytest.raises(LogError):
        Engine(spark, str(tmp_path / "empty"), "id STRING, hlc BIGINT").restore_latest()


def test_recovery_and_numbering_sort_nothing_in_one_task(spark, tmp_path, monkeypatch):
    """A crash that left many rows: they are numbered in the order of segment, clock and place, without a window over rows."""
    from tidelog.operators import engine as module

    plans, numbered = [], module.numbered
    monkeypatch.setattr(module, "numbered", lambda rows, start: (plans.append((rows, numbered(rows, start))), plans[-1][1])[1])
    rows = lambda lo, hi: spark.range(lo, hi, 1, 3).select(F.concat(F.lit("e"), "id").alias("id"), (F.col("id") * 7 % 1000).alias("hlc"))
    at = str(tmp_path / "engine")
    engine = module.Engine(spark, at, "id STRING, hlc BIGINT", segment_bytes=1)
    engine.append(rows(0, 500))
    engine.log_ahead(rows(500, 1500))
    engine.log_ahead(rows(1400, 2000))
    again = module.Engine(spark, at, "id STRING, hlc BIGINT")
    got = again.log().orderBy("seq").collect()
    assert again.recovered == 1500 and [r.seq for r in got] == list(range(2000)) and [r.id for r in got[:500]] == [f"e{i}" for i in range(500)]
    first, second = sorted(range(500, 1500), key=lambda i: (i * 7 % 1000, i)), sorted(range(1500, 2000), key=lambda i: (i * 7 % 1000, i))
    assert [r.id for r in got[500:]] == [f"e{i}" for i in first + second] and not [n for n in os.listdir(at) if n.startswith("recovered")]
    for given, plan in plans:
        tree = plan._jdf.queryExecution().optimizedPlan().toString()
        assert tree.count("Window [") == 1 and "row_number" not in tree and "row_number" not in given._jdf.queryExecution().optimizedPlan().toString()


def test_segments_sort_by_time_and_are_read_from_an_offset(spark, tmp_path):
    formats.register(spark)
    at = str(tmp_path / "wal")
    for lo in (0, 20):
        df = spark.createDataFrame([{**EVENT, "id": f"{i:03d}"} for i in range(lo, lo + 20)], formats.LOG.split("BIGINT, ", 1)[1]).coalesce(1)
        df.write.format("tide_wal").option("segment_bytes", 400).mode("append").save(at)
    names = formats.files(at, ".wal")
    assert len(names) > 4 and not [f for f in os.listdir(at) if f.endswith(".tmp")]
    ids = lambda path, **o: [codec.decode_event(bytes(r.payload))["id"] for r in spark.read.format("tide_wal").options(**o).load(path).orderBy("segment", "offset").collect()]
    assert ids(at) == [f"{i:03d}" for i in range(40)]
    first = os.path.getsize(names[0])
    assert ids(at, start_offset=first) == ids(at)[len(ids(names[0])) :]
    assert formats.available() == ["tide_frames", "tide_log", "tide_snapshot", "tide_wal"]


def test_streams_go_on_over_batches(spark, tmp_path):
    from tidelog.streaming.queries import materialise

    source, root = str(tmp_path / "in"), str(tmp_path / "stream")
    for n in (1, 2):
        spark.createDataFrame([("a", n), ("b", n)], "k string, v long").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, v long").parquet(source).groupBy("k").agg(F.sum("v").alias("s"))
        got = {r.k: r.s for r in materialise(stream, ("k",), root).collect()}
        assert got == ({"a": 1, "b": 1} if n == 1 else {"a": 3, "b": 3})


def test_bloom_of_nulls(spark):
    items = spark.createDataFrame([("x",), (None,)], "s string")
    assert {r.s: r.maybe for r in bloom.contains(items, "s", bloom.build(items, "s", 64, 3), 64, 3).collect()} == {"x": True, None: False}


def test_web_socket_frames():
    for n in (0, 125, 126, 65_535, 65_536):
        data = codec.ws_frame(b"z" * n)
        assert codec.ws_read(data + b"more") == (1, b"z" * n, len(data))
    masked = bytes([0x82, 0x83]) + b"abcd" + bytes(x ^ y for x, y in zip(b"hey", b"abc", strict=True))
    assert codec.ws_read(masked) == (2, b"hey", 9)
    with pytest.raises(LogError):
        codec.ws_read(codec.ws_frame(b"abc")[:-1])
