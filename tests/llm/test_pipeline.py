"""The queries on the small tables, and the pipeline stage by stage."""

import re

from oracle import SF, compare

import corpus_pipeline
from tidelog.llm import neardup, queries, secrets
from tidelog.llm.common import Scratch, table


def test_queries_cover_whole_tables(spark):
    q = queries.queries()
    for name in ("op1_sharding", "op2_minhash_near_dedup", "op3_toxicity", "op5_pii", "op6_secrets", "op8_fingerprints", "op9_mixing"):
        assert q[name](spark, SF).select("doc_id").distinct().count() == 1000, name
    assert q["op7_nearest_neighbours"](spark, SF).count() == 50
    assert q["op4_best_fit_packing"](spark, SF).select("doc_id").distinct().count() == 1000
    for name, sql in queries.oracle_sql().items():
        assert compare(spark, q[name], sql) > 0


def test_stages(spark):
    docs, scratch = table(spark, SF, "documents"), Scratch(spark)
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, SF))
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == table(spark, SF, "documents").columns
        if name == "toxicity":
            gone = {r.doc_id for r in before.select("doc_id").subtract(docs.select("doc_id")).collect()}
            judged = [labels[i] for i in gone if i in labels]
            assert judged and sum(judged) >= 0.9 * len(judged)
        if name == "minhash_near_dedup":
            again = neardup.near_duplicates(docs).filter("NOT kept AND n_shingles > 0")
            assert again.isEmpty() and docs.count() < before.count()
        if name == "secret_scan":
            assert docs.count() == before.count()
            assert secrets.scan(docs).filter("exists(found, s -> s.class = 'owned')").isEmpty()
    words = {}
    for r in seen["mix_sources"].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    packed = {r.doc_id: r["sum(length)"] for r in seen["best_fit_packing"].groupBy("doc_id").sum("length").collect()}
    assert packed == words
