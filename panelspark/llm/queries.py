"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import (
    arc_warc, conversation_trie, decontaminate, fingerprints, language_model, mixing, near_dedup, quality_gam, secret_scan,
    suffix_dedup, token_alignment, token_counts, toxicity)
from panelspark.llm import sql as S
from panelspark.llm.tables import released, table
from panelspark.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, h = decontaminate.find(docs, table(spark, sf_dir, "benchmark"), n=10, carry=["doc_id"])
    hit = F.col(h)
    return found.select(
        "doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"),
        (hit["n_hit"] > 0).alias("contaminated"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken(mixing.mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored, t = toxicity.score(docs, chain, carry=["doc_id"])
    last = F.col(t)[toxicity.LAST]
    return scored.select(
        "doc_id", (quality_gam.id_part(F.col("doc_id")) == 0).alias("held_out"),
        *[F.col(t)[c].alias(f"p_{c}") for c in chain.names[:-1]], last.alias("score"),
        (last >= toxicity.THRESHOLD).alias("toxic"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_groups(docs, shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut, c = suffix_dedup.cut_repeats(docs, length=100, carry=["doc_id"])
    return cut.select("doc_id", *[F.col(c)[f].alias(f) for f in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted, t = token_counts.count_tokens(docs, "byte_bpe_50k.json", carry=["doc_id"])
    tok = F.col(t)
    return counted.select("doc_id", tok["n_bytes"].alias("n_bytes"), tok["n_tokens"].alias("n_tokens"),
                          token_counts.over_limit(tok["n_tokens"]).alias("over_limit"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, q = quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    value = F.col(q)["score"]
    return scored.select("doc_id", (quality_gam.id_part(F.col("doc_id")) == 0).alias("held_out"), value.alias("score"),
                         (value >= quality_gam.THRESHOLD).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    arc_warc.write_arc(pages, arc)
    arc_warc.convert(spark, arc, warc)
    return arc_warc.page_records(released(arc_warc.read_warc(spark, warc))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, s = secret_scan.find(docs, carry=["doc_id"])
    spans = F.col(s)["spans"]
    return found.select(
        "doc_id", *[secret_scan.count_of(spans, k.name).alias(f"n_{k.name}") for k in secret_scan.KINDS],
        F.sha2(secret_scan.listing(spans, secret_scan.BASE), 256).alias("base_sha256"),
        secret_scan.listing(spans).alias("spans"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trie = conversation_trie.nodes(conversation_trie.spliced(conversation_trie.sequences(turns)))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.lower(F.hex("ends")).alias("ends_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, t = token_alignment.score_links(docs, "byte_bpe_50k.json", "piece_bpe_32k.model", carry=["doc_id"])
    return scored.select("doc_id", *[F.col(t)[f].alias(f) for f in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_decontamination": (op1_decontamination, S.OP1),
    "op2_source_mixing": (op2_source_mixing, S.OP2),
    "op3_toxicity": (op3_toxicity, None),
    "op4_near_dedup": (op4_near_dedup, S.OP4),
    "op5_suffix_dedup": (op5_suffix_dedup, S.OP5),
    "op6_token_counts": (op6_token_counts, None),
    "op7_fingerprints": (op7_fingerprints, None),
    "op8_lm_scoring": (op8_lm_scoring, None),
    "op9_quality_classifier": (op9_quality_classifier, None),
    "op10_warc": (op10_warc, S.OP10),
    "op11_secret_scan": (op11_secret_scan, S.OP11),
    "op12_conversation_trie": (op12_conversation_trie, S.OP12),
    "op13_token_alignment": (op13_token_alignment, None),
    "pipeline": (pipeline, corpus_pipeline.ORACLE_SQL),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s.strip() for k, (_, s) in _QUERIES.items() if s}
