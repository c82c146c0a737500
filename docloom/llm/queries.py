"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import chat, html_text, language_model, mixing, nearest, ngram_join, packing, phrases, prefix_trie, quality_crf, quality_rules, simhash, token_counts
from docloom.llm.once import written
from docloom.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame) -> DataFrame:
    """``docs`` packed under the byte-level vocabulary."""
    import public_tokenizers

    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of ``documents`` without its texts, written once to the shared folder; policies and ablations read it."""
    return written(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.apply_policy(stored_ledger(spark, sf_dir))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


@query
def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(stored_ledger(spark, sf_dir))


@query
def quality_policy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.compare(stored_ledger(spark, sf_dir), list(quality_rules.POLICIES))


ORACLES |= {"op4_quality_rules": quality_rules.SQL, "quality_rule_ablations": quality_rules.ABLATIONS_SQL, "quality_policy_versions": quality_rules.COMPARE_SQL}


@query
def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality_crf.remainder(F.col("doc_id"), quality_crf.HELD_OUT_OF) == quality_crf.HELD_OUT, F.lit(False))
    return quality_crf.classify(docs, field).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return mixed.select("doc_id", "p_clean", "p_low", "p_toxic", "n_tokens", "rate", "gap", "copies")


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


ORACLES["op7_chat"] = chat.SQL


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality_crf.remainder(F.col("doc_id"), language_model.TRAIN_OF) == language_model.HELD_OUT
    return language_model.score(docs, held_out)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLES["op11_collocations"] = phrases.SQL


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = prefix_trie.SQL


@query
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op12_ngram_join"] = ngram_join.SQL
