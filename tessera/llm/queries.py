"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import oracles
from tessera.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(table(spark, sf_dir, "documents"), n=5, percent=75)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_store import tokenize_to_store

    rows = tokenize_to_store(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import score_quality

    held_out = fold(F.col("doc_id"), 3) == 1
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, threshold=0.5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score_toxicity

    held_out = fold(F.col("doc_id"), 4) == 2
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, threshold=0.3)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import find_contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = ("assign", "access", "hex")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("secret_spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    base_text = told(F.filter("secret_spans", lambda s: s["kind"].isin(*base)))
    return found.select("doc_id", *counts, F.sha2(base_text.cast("binary"), 256).alias("base_sha256"), told(F.col("secret_spans")).alias("spans"))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import archive_pages

    index = archive_pages(table(spark, sf_dir, "pages"), least_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)[1]


def op9_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts in which every third turn has lost its marker, and chunks don't end where turns do; the model is learnt from the roles of conversations whose crc32 mod 4 isn't 0."""
    from tessera.llm.chat import PAIR, as_transcript, learn_roles, parse_transcripts, with_markers
    from tessera.llm.common import materialize

    turns = materialize(with_markers(table(spark, sf_dir, "conversations"), unmarked=3), "turns")
    model = learn_roles(turns.filter(fold(F.col("conv_id"), 4) != 0))
    found = parse_transcripts(as_transcript(turns, lines=4), model, block=16 * PAIR)
    return found.select("conv_id", "turn_no", "role", F.col("n_lines").cast("long").alias("n_lines"), F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import judge_documents

    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), slip=199, least_chars=6, least_n=5, times=5)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.wrappers import extract_pages

    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fim import fill_in_middle, restored

    rows = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    output, form = F.col("output"), F.col("form")
    return rows.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha(output).alias("output_sha256"), sha(restored(output, form)).alias("restored_sha256"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can say: all but the spans of the method's own kinds."""
    return op6_secret_scan(spark, sf_dir).drop("spans")


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can say: all but the trees' score and verdict."""
    return op10_quality_rules(spark, sf_dir).drop("tree_score", "kept")


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_token_store": op2_token_store,
        "op3_quality_score": op3_quality_score,
        "op4_toxicity": op4_toxicity,
        "op5_decontamination": op5_decontamination,
        "op6_secret_scan": op6_secret_scan,
        "op7_warc_index": op7_warc_index,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_chat_turns": op9_chat_turns,
        "op10_quality_rules": op10_quality_rules,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_html_extraction": op12_html_extraction,
        "op13_fill_in_middle": op13_fill_in_middle,
        "secret_base_spans": secret_base_spans,
        "quality_rule_counts": quality_rule_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": oracles.OP1, "op5_decontamination": oracles.OP5, "op7_warc_index": oracles.OP7, "secret_base_spans": oracles.SECRET_BASE, "quality_rule_counts": oracles.RULE_COUNTS, "op13_fill_in_middle": oracles.OP13}
