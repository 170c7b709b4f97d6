"""The operators' queries over the synthetic tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.toxicity import held_out, learn, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textloom.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.decontaminate import find_overlaps, is_contaminated

    found = find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.spotsigs import edited_neighbours

    return edited_neighbours(table(spark, sf_dir, "documents"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.near_dup import near_duplicates

    classes = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", kept.alias("is_representative"), "class_size", "n_links")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.warc import read_warc, scratch_folder, write_warc

    files = write_warc(table(spark, sf_dir, "pages"), scratch_folder(spark))
    return read_warc(files, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.secrets import BASE, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.line_dedup import clean_pages

    cleaned = clean_pages(table(spark, sf_dir, "pages"))
    return cleaned.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def line_dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the pipeline has it: documents, with their source as the site."""
    from textloom.llm.line_dedup import drop_boilerplate

    cleaned = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.lexical import search_documents

    found = search_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.filter_audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op13_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.bit_sliced import top_products

    found = top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_url_filter": op2_url_filter,
        "op3_token_counts": op3_token_counts,
        "op4_mixing": op4_mixing,
        "op5_decontamination": op5_decontamination,
        "op6_spotsigs": op6_spotsigs,
        "op7_near_dup": op7_near_dup,
        "op8_warc": op8_warc,
        "op9_secrets": op9_secrets,
        "op10_line_dedup": op10_line_dedup,
        "line_dedup_by_source": line_dedup_by_source,
        "op11_lexical_search": op11_lexical_search,
        "op12_filter_audit": op12_filter_audit,
        "op13_bit_sliced": op13_bit_sliced,
    }


def oracle_sql() -> dict[str, str]:
    from textloom.llm.sql import ORACLES

    return ORACLES
