"""The queries of the operators over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotmill.llm import bpe, chat, collocations, mixing, oracles, packing, token_counts, topk, toxicity, whitening
from glotmill.llm.common import held_out, shared_folder, table
from glotmill.llm.exact_dedup import exact_groups
from glotmill.llm.pii import KINDS, personal_spans
from glotmill.llm.secrets import RULES, findings_by_path, update_ledger
from glotmill.llm.simhash import near_duplicates
from glotmill.llm.spans import of_kind, spelled

#: Scores from here on are predictions of label 1.
TOXIC = 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fold; edge cases as in ``toxicity.with_scores``."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; edge cases as in ``simhash.near_duplicates``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """Findings of all documents. ``ledger`` is the folder of a ledger to use and append to; by default a new one."""
    docs = table(spark, sf_dir, "documents")
    seen = update_ledger(docs, ledger or f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}")
    found = findings_by_path(docs, seen)
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in RULES if r.base]))
    return found.withColumn("base", base).select(
        F.col("path").alias("doc_id"),
        *[of_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


def vocabulary(name: str, path: str | None = None) -> str:
    """Place of a public tokeniser file; another place can be given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return path


def definition(name: str) -> str:
    """Text of a tokeniser file."""
    with open(vocabulary(name), encoding="utf-8") as f:
        return f.read()


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests; edge cases as in ``bpe.round_trip_digests``."""
    from public_tokenizers import PATTERN

    entries = bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), entries, PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; edge cases as in ``packing.pack_documents``."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), definition("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; edge cases as in ``token_counts.token_counts``."""
    from public_tokenizers import PATTERN

    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, definition("byte_bpe_50k.json"), PATTERN, ("<|endoftext|>",))


def op9_quotation_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in reply order and without its quotes; edge cases as in ``chat.format_conversations``."""
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole threads of the conversations, after their messages have been made to quote what they answer."""
    told = chat.thread_texts(chat.format_conversations(chat.with_quotes(table(spark, sf_dir, "conversations"))))
    return told.select("conv_id", "thread", "n_messages", F.sha2("text", 256).alias("text_sha256"))


def op10_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every 20th vector; edge cases and repeated rows as in ``topk.exact_top_k``."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document; edge cases as in ``pii.personal_spans``."""
    found = personal_spans(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"),
        *[of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.concat("base", "terms")).alias("spans"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays for every document; edge cases and repeated rows as in ``exact_dedup.exact_groups``."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language of ``documents``; edge cases as in ``collocations.frequent_phrases``."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable row of ``embeddings``; edge cases as in ``whitening.whiten``."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document a mix by target weights takes; edge cases as in ``mixing.mixture``."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_secret_scan": op3_secret_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_disclosure": op5_disclosure,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_quotation_chat": op9_quotation_chat,
    "op10_kd_top_k": op10_kd_top_k,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_mixture": op13_mixture,
    "quoted_threads": quoted_threads,
}
#: Training, fingerprints, tokenisers, co-occurrence terms, linking and eigenvectors have no SQL form; tests hold them against brute force.
ORACLES = {"op3_secret_scan": oracles.SECRETS, "op6_exact_dedup": oracles.EXACT, "op10_kd_top_k": oracles.TOP_K, "op11_collocations": oracles.COLLOCATIONS, "op13_mixture": oracles.MIXTURE}
