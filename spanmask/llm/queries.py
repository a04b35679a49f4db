"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmask.llm import bpe, collocations, html_extract, language_id, mixing, packing, quality_classifier, quality_rules, simhash, source_divergence, substring_dedup, url_filter, vector_search
from spanmask.llm.features import held_out

TOKENIZER_FILE = "word_bpe_49k.json"
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "lang")
    out = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vector_search.search(rows, F.col("vec_id") % 100 == 0, k=10)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = quality_rules.judge(docs, quality_rules.fit(docs, _labels(spark, sf_dir)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_documents(spark, sf_dir), "text", 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path())


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_extract.extract(pages, "html").select("page_id", "url", "text", "n_chars")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = quality_classifier.score(docs, quality_classifier.fit(docs, _labels(spark, sf_dir)))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), "text", "doc_id", k=3, radius=3).select("doc_id", "fingerprint", "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_documents(spark, sf_dir, "source"))
    return out.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_slot", "second_slot")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir, "lang"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_documents(spark, sf_dir), tokenizer_path()).select("doc_id", "ids")
    digests = ("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    return bpe.decode(ids, tokenizer_path()).select(*digests, F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_documents(spark, sf_dir, "lang", "source"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_vector_search": op2_vector_search,
        "op3_quality_rules": op3_quality_rules,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_html_extract": op7_html_extract,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_simhash": op9_simhash,
        "op10_mixing": op10_mixing,
        "op11_collocations": op11_collocations,
        "op12_bpe": op12_bpe,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from spanmask.llm.oracle import ORACLE

    return dict(ORACLE)
