"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import bin_completion, collocations, conversation_trie, golay_simhash, importance_resampling, js_quality, permutation_ann, ppm_langid, quote_linking, sentencepiece_lattice, suffix_dedup, toxicity_chain, url_digest
from punctual.llm.common import ship, table


def op1_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, a digest of the ids and whether they decode to the text, of every document; see `sentencepiece_lattice.summarise`."""
    return sentencepiece_lattice.summarise(table(spark, sf_dir, "documents"), bin_completion.tokenizer_path("piece_bpe_32k.model"))


def op2_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out; see `ppm_langid.identify`."""
    ship(spark)
    return ppm_langid.identify(table(spark, sf_dir, "documents"))


def op3_js_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances and verdict of every document, distances to six digits; see `js_quality.quality`."""
    found = js_quality.quality(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("js_chars", "js_common", "js")})


def op4_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see `golay_simhash.near_duplicates`."""
    ship(spark)
    return golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, with its parent and place in its thread; see `quote_linking.link`."""
    return quote_linking.link(table(spark, sf_dir, "conversations"))


def op6_url_digest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; see `url_digest.judge`."""
    ship(spark)
    return url_digest.judge(table(spark, sf_dir, "pages"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn by the ratio of the labelled good ones' model to that of all; see `importance_resampling.resample`."""
    ship(spark)
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences; see `bin_completion.pack`."""
    ship(spark)
    return bin_completion.pack(table(spark, sf_dir, "documents"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others of every twentieth vector; see `permutation_ann.nearest`."""
    ship(spark)
    return permutation_ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdicts of every document; see `toxicity_chain.classify`."""
    return toxicity_chain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language of all documents; see `collocations`."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after all repeated strings of 200 bytes are removed; see `suffix_dedup`."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations; see `conversation_trie`."""
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_sentencepiece_lattice,
        op2_ppm_language_id,
        op3_js_quality_rules,
        op4_golay_simhash,
        op5_quotation_linking,
        op6_url_digest_filter,
        op7_importance_resampling,
        op8_bin_completion_packing,
        op9_permutation_index,
        op10_toxicity_chain,
        op11_phrase_collocations,
        op12_suffix_array_dedup,
        op13_conversation_trie,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_js_quality_rules": js_quality.sql(), "op5_quotation_linking": quote_linking.SQL, "op6_url_digest_filter": url_digest.SQL, "op11_phrase_collocations": collocations.SQL, "op12_suffix_array_dedup": suffix_dedup.SQL, "op13_conversation_trie": conversation_trie.SQL}
