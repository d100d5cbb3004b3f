"""Registered queries of the package and the pipeline on the driver's smallest tables."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_operator_has_a_query():
    names = [n for n in entry_point.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry_point.queries()


def test_url_rules_match_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(entry_point.oracle_sql()["op5_url_token_rules"]).df()
    got = entry_point.queries()["op5_url_token_rules"](spark, SF).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(tuple, df.astype(object).where(df.notna(), None).to_numpy().tolist()), key=str)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op1_compression_toxicity", "op3_chroma_fingerprints", "op9_decision_list", "op10_page_differencing"])
def test_one_row_for_each_input_row(spark, name):
    source = {"op3": "embeddings", "op10": "pages"}.get(name.split("_")[0], "documents")
    df = entry_point.queries()[name](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry_point.queries()["op6_piece_bpe"](spark, SF).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_pipeline_stages_hold_what_they_promise(spark):
    from barflow.llm import quality, simhash
    from barflow.llm.anchors import merged

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    assert all(d.columns == docs.columns for d in kept[1:-1]) and ids[0] > ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    assert kept[1].exceptAll(docs).count() == 0
    assert quality.judge(kept[1], quality.DecisionList(), keep=["doc_id"]).where("base_failed").count() == 0
    texts = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    order = sorted(ids[3])
    assert all(simhash.similarity(texts[a], texts[b], 5) < 0.8 for i, a in enumerate(order) for b in order[:i])
    assert all(any(simhash.similarity(texts[a], texts[b], 5) >= 0.8 for b in texts if b != a) for a in ids[2] - ids[3])
    raw = {i: texts[i].encode() for i in order}
    count = Counter(t[i : i + 200] for t in raw.values() for i in range(len(t) - 199))
    for r in kept[4].collect():
        t, at, want = raw[r["doc_id"]], 0, b""
        for lo, hi in merged([(i, i + 200) for i in range(len(t) - 199) if count[t[i : i + 200]] > 1]):
            want, at = want + t[at:lo], hi
        assert r["text"] == (want + t[at:]).decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])
