"""The operators of this subpackage as queries over the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    chat, decontaminate, filter_audit, licenses, mixing, ngram_join, pipeline as stages, quality, secret_scan, sharding, structure, token_files,
    topk, toxicity,
)
from ledgerloom.llm.common import read, shared_folder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the output shards draw of each document."""
    drawn = mixing.counted(mixing.plan(read(spark, sf_dir, "documents")), shards=8)
    return drawn.select("doc_id", "size", "source_size", "target", "taken", "source", "passes", "shards")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with a ledger that is empty at first; spans are the base spans."""
    docs = read(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, shared_folder(spark, "ledger"))
    findings = F.coalesce("findings", F.array().cast(secret_scan.FINDINGS))
    spans = F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(findings, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind, *_ in secret_scan.RULES),
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
        "blob",
    )


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from the output."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    formatted = chat.format_trees(chat.threads(turns.unionByName(added)), unique=True)
    whole = F.col("formatted")
    texts = F.arrays_zip(chat.read_back(whole, 1).alias("role"), chat.read_back(whole, 2).alias("text"))
    said = F.concat_ws("", F.transform(texts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = chat.loss_text(whole, F.col("loss_spans"))
    return formatted.select(
        "conv_id",
        F.size(chat.read_back(whole, 1)).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length(whole).cast("long").alias("formatted_chars"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(read(spark, sf_dir, "documents"), shards=8)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join_documents(read(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return joined.select("doc_id", "n_shingles", "component_id", "n_links")


def op11_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with planted faults, audited and repaired."""
    return structure.audit(structure.damaged(read(spark, sf_dir, "conversations"))).drop("n_rows")


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents' ids in the shared folder and reads the files back."""
    import public_tokenizers

    folder = shared_folder(spark, "token-ids")
    token_files.write(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_topk, op3_quality, op4_mixing, op5_decontaminate, op6_secrets, op7_chat, op8_licenses,
        op9_sharding, op10_ngram_join, op11_structure, op12_filters, op13_token_files, pipeline,
    )
}
