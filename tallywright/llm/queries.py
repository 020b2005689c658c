"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.llm import (
    bilinear_lm,
    byte_network,
    chat_snapshots,
    domain_mixing,
    flat_graph,
    minhash,
    packing,
    personal_data,
    prefix_tries,
    quality_rules,
    shuffle_shards,
    spelling_variants,
    toxicity,
)
from tallywright.llm.labelled import id_remainder
from tallywright.llm.registry import ORACLES, QUERIES, query, spread, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """Where this machine keeps the public tokenizers; the same on all executors."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


__all__ = ["ORACLES", "QUERIES"]


@query("op1_embedding_neardup")
def _(spark, sf_dir):
    return flat_graph.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.9, spread)


@query("op2_chat_formatting", chat_snapshots.SQL, native=True)
def _(spark, sf_dir):
    return chat_snapshots.format_chats(table(spark, sf_dir, "conversations"))


@query("op3_quality_classifier")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    taught = table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 4) != 2)
    return byte_network.byte_quality(spread(docs), byte_network.train(docs, taught), 4, 2)


@query("op4_toxicity")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    taught = table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 5) != 0)
    return toxicity.toxicity(spread(docs), toxicity.train(docs, taught), 5, 0)


@query("op5_minhash")
def _(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 4, 80, spread)


@query("op6_lm_scoring")
def _(spark, sf_dir):
    return bilinear_lm.score_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), 7, 2)


@query("op7_packing")
def _(spark, sf_dir):
    return packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_path())


@query("op9_quality_rules")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(spread(docs), rules)


@query("op8_sharding", native=True)
def _(spark, sf_dir):
    return shuffle_shards.shard_digest(table(spark, sf_dir, "documents"), 8)


@query("op10_mixing", native=True)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    labelled = labelled.select("doc_id", F.col("lang").alias("domain"))
    mixed, domains = domain_mixing.mix(docs.select("doc_id", "text"), labelled)
    shares = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)]
    return mixed.select("record.doc_id", "tokens", *shares, "rate", "miss")


@query("op11_personal_data")
def _(spark, sf_dir):
    return personal_data.digest(personal_data.find_personal_data(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


@query("op12_prefix_tries", prefix_tries.SQL)
def _(spark, sf_dir):
    return prefix_tries.prefix_tree(table(spark, sf_dir, "conversations"))


@query("op13_spelling_variants")
def _(spark, sf_dir):
    return spelling_variants.spelling_variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
