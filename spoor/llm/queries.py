"""The registered queries of this folder: name -> (spark, table folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.llm.caps import link_vectors
from spoor.llm.common import table
from spoor.llm.decontaminate import find_leaks
from spoor.llm.fuzzy import group_near
from spoor.llm.manifest import manifest
from spoor.llm.packing import pack
from spoor.llm.pages import extract_pages
from spoor.llm.pseudonyms import pseudonymise
from spoor.llm.quality import measure_quality
from spoor.llm.ranked import search
from spoor.llm.repeats import repeat_digests
from spoor.llm.secrets import secret_digests
from spoor.llm.sharding import shard
from spoor.llm.toxicity import score_toxicity


def secret_key(spark) -> str:
    """The key of pseudonyms; a run on real data sets its own, the default is for test tables."""
    return spark.conf.get("spoor.pseudonyms.key", "spoor")


def op1_secrets(spark, sf_dir):
    return secret_digests(table(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return group_near(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pseudonymise(docs, key=secret_key(spark), kinds="kinds").select("doc_id", "text", "kinds")


def op8_quality(spark, sf_dir):
    return measure_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op9_pages(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_repeats(spark, sf_dir):
    return repeat_digests(table(spark, sf_dir, "documents"))


def op11_ranked(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_manifest(spark, sf_dir):
    """Every document proved against the root; of every seventh a copy with one character more."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    n_chars = F.when(changed, more).otherwise(F.col("n_chars"))
    return manifest(table(spark, sf_dir, "documents"), presented={"n_chars": n_chars})


def op13_caps(spark, sf_dir):
    return link_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_quality": op8_quality,
    "op9_pages": op9_pages,
    "op10_repeats": op10_repeats,
    "op11_ranked": op11_ranked,
    "op12_manifest": op12_manifest,
    "op13_caps": op13_caps,
}
