"""The training-data operators as registered queries."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, jaccard, lm_score, mixing, quality, secrets, sharding, spelling, substring_dedup, token_store, vector_codes, vector_dedup, warc
from cairn.llm.common import table

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once, where they would not find it by themselves."""
    package = Path(__file__).resolve().parents[1]
    known = [Path(p or ".").resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if package.parent in known or (Path.cwd() / package.name).exists() or spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="cairn-")) / "cairn_package.zip"  # Spark serves it from there
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def _over(name: str, operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return operator(table(spark, sf_dir, name))

    return query


def op3_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = decontaminate.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op4_token_store(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return token_store.document_tokens(table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {
    "op1_product_quantisation": _over("embeddings", vector_dedup.vector_duplicates),
    "op2_bloom_lm": _over("documents", lm_score.scores),
    "op3_suffix_automaton": op3_suffix_automaton,
    "op4_token_store": op4_token_store,
    "op5_hilbert_sharding": _over("documents", sharding.document_shards),
    "op6_flow_mixing": _over("documents", mixing.document_mix),
    "op7_warc_index": _over("pages", warc.page_records),
    "op8_sparse_product": _over("documents", jaccard.near_duplicates),
    "op9_kneser_ney": op9_kneser_ney,
    "op10_randomness_battery": _over("documents", secrets.secret_spans),
    "op11_levenshtein_trie": _over("documents", spelling.spelling_variants),
    "op12_difference_cover": op12_difference_cover,
    "op13_elkan_lloyd": _over("embeddings", vector_codes.vector_codes),
}

ORACLE_SQL: dict[str, str] = {}
