"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import (
    chroma, packing, page_diff, piece_bpe, pieces, quality, repair, ring, simhash, substring, suffix_levels, toxicity, url_rules, whitening,
)
from barflow.llm.common import map_batches, table, text_of

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Largest number of tokens in a training sequence.
SEQUENCE = 4096


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# A document with this score or more is toxic.
TOXIC = 0.7


@query("op1_compression_toxicity")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit_documents(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= TOXIC).cast("int").alias("predicted"),
    )


@query("op2_simhash_anchors")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"), width=4, threshold=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_piece_bpe")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    coded = piece_bpe.decode(piece_bpe.encode(table(spark, sf, "documents"), path), path)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(pieces.settled(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"), SEQUENCE), SEQUENCE)


@query("op9_decision_list")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rules = quality.fit_list(docs, table(spark, sf, "labels"))
    return quality.judge(docs, rules, keep=["doc_id"]).select("doc_id", *quality.BASE, "base_failed", "kept")


@query("op4_suffix_levels")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_levels.remove_bytes(table(spark, sf, "documents"), keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["hi"] - s["lo"]))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_rabin_karp_windows")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# The path rules of the contract, and words whose pages are not wanted.
PATH_RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
]
UNWANTED_WORDS = ["adult", "betting", "casino", "escort", "gambling", "hentai", "poker", "porn", "sex", "slots", "viagra", "warez", "xxx"]
URL_SQL = """
WITH cut AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS raw, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
ruled AS (
  SELECT *, CASE {cases} END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN regexp_matches(translate(host || chr(10) || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])({words})($|[^a-z0-9])') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


def _url_sql() -> str:
    order = sorted(PATH_RULES, key=lambda r: -len(r[0] + r[1]))
    cases = " ".join(f"WHEN ('.' || host) LIKE '%.{host}' AND starts_with(path, '{path}') THEN '{host}{path}'" for host, path, _ in order)
    verdicts = " ".join(f"WHEN rule = '{host}{path}' THEN '{verdict}'" for host, path, verdict in order)
    return URL_SQL.format(cases=cases, verdicts=verdicts, words="|".join(UNWANTED_WORDS))


@query("op5_url_token_rules", _url_sql())
def op5(spark: SparkSession, sf: str) -> DataFrame:
    rules = [url_rules.path_rule(*r) for r in PATH_RULES] + [url_rules.word_rule(w) for w in UNWANTED_WORDS]
    judged = url_rules.apply_rules(table(spark, sf, "pages"), url_rules.rule_table(spark, rules), ["page_id"])
    return judged.select(
        "page_id", "host", "path", F.when(F.col("hit.weight") >= url_rules.PATH_WEIGHT, F.col("hit.rule")).alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"),
    )


@query("op10_page_differencing")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = page_diff.extract(table(spark, sf, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


# Notes of the recordings that vectors are played as: samples of a note, sample rate.
NOTE, RATE = 400, 8000


def played(vectors: DataFrame) -> DataFrame:
    """``vec_id, audio``: each vector as a WAV recording with a note for each component, on a scale of four octaves from its least to its greatest value."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for v in batch.column(1).to_pylist():
            v = np.array([x for x in v or () if x is not None and np.isfinite(x)], float)
            span = float(v.max() - v.min()) if len(v) else 0.0
            pitch = 110.0 * 2 ** (np.round(48 * (v - v.min()) / span) / 12) if span else np.full(len(v), 110.0)
            phase = np.cumsum(np.repeat(2 * np.pi * pitch / RATE, NOTE))
            out.append(chroma.write_wav(0.8 * np.sin(phase), RATE))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "audio"])

    return map_batches(vectors.select("vec_id", "embedding"), run, "vec_id bigint, audio binary", 64)


@query("op3_chroma_fingerprints")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    prints = chroma.fingerprints(played(vectors), "vec_id", settings=chroma.Settings(rate=RATE, frame=2048, hop=NOTE, low=100.0, high=2000.0))
    classes, links = chroma.align(prints, vectors.where("vec_id % 50 = 0").select("vec_id"), "vec_id")
    best = links.groupBy("found").agg(F.count("*").alias("n_links"), F.min(F.struct("errors", "query", "offset")).alias("best"))
    return classes.join(best, F.col("class_id") == F.col("found"), "left").select(
        "vec_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("best.query").alias("best_query"), F.col("best.offset").alias("best_offset"),
        F.round("best.errors", 6).alias("best_errors"),
    )


# Shards of the sharding query.
SHARDS = 8


@query("op11_bounded_ring")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    content = F.encode(text_of(), "utf-8")
    rows = table(spark, sf, "documents").select("doc_id", (F.octet_length(content) + F.lit(1)).cast("bigint").alias("size"), F.crc32(content).alias("text_crc32"))
    return ring.assign(rows, ["doc_id"], SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op12_bit_sliced_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    model = whitening.fit(vectors, "embedding")
    shares = F.expr(f"cast(array({', '.join(f'{v!r}D' for v in model.explained.tolist())}) as array<double>)")
    rows = whitening.transform(vectors, "embedding", model, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


@query("op13_lightest_repair")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(table(spark, sf, "conversations")))
