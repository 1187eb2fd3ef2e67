"""The queries of the training-data operators, and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hazelake.llm import chunks, clusters, decontaminate, mixing, periods, pii, quality, quotes, secrets, simhash, spans, suffix, tokens, toxicity
from hazelake.llm.common import table
from hazelake.session import fresh_path

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


def _digest(found: DataFrame, kinds: list[str], first: str, *more: str) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text."""
    counts = [spans.count_of("base", k).alias(f"n_{k}") for k in kinds]
    digest = F.sha2(spans.listed(F.col("base"), first).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), spans.listed(F.col("spans"), first).alias("spans"), *more)


@query("op1_secret_scans", secrets.sql())
def op1_secret_scans(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return _digest(found, [r.kind for r in secrets.BASE], "start")


@query("op2_benchmark_decontamination", decontaminate.sql())
def op2_benchmark_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    kept = suffix.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared"
    )


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark, sf_dir):
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_quality_rules", quality.sql())
def op5_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op6_token_output")
def op6_token_output(spark, sf_dir):
    folder = fresh_path(spark, "op6")
    tokens.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return tokens.summary(spark, folder)


@query("op7_chat_formatting")
def op7_chat_formatting(spark, sf_dir):
    return quotes.conversations(table(spark, sf_dir, "conversations"))


@query("op8_pii")
def op8_pii(spark, sf_dir):
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _digest(found, list(pii.BASE), "order", spans.count_of("spans", pii.ADDED).alias("n_likely"))


@query("op9_substring_dedup")
def op9_substring_dedup(spark, sf_dir):
    """Documents with passages that also stand elsewhere, and what goes from each."""
    return chunks.repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_repeated", "n_removed")


@query("op10_source_mixing", mixing.SQL)
def op10_source_mixing(spark, sf_dir):
    rows = mixing.assigned(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.col("turns")[0]["position"].alias("first_position"))


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine, share = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    rows = toxicity.scored(docs, machine, share)
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op12_periodic_run_detection", periods.sql())
def op12_periodic_run_detection(spark, sf_dir):
    return periods.summary(periods.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=periods.looped))


@query("op13_centroid_clustering", clusters.sql())
def op13_centroid_clustering(spark, sf_dir):
    rows = clusters.clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
