"""The registered queries: name -> (spark, table folder) -> DataFrame."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from spoor.functions.labels import clean_label, expected_label
from spoor.functions.vectors import l2_normalise
from spoor.operators import episodes as ep
from spoor.operators.dense import dense_ranks, dense_topk, pooled
from spoor.operators.encode import (
    VectorStore,
    embed_mean,
    embed_rules,
    embed_whole,
    encode_distinct,
    hashed_encoder,
)
from spoor.operators.flatten import entries, ordered_distinct, parse_documents, render
from spoor.operators.overlap import overlap_ranks, overlap_topk
from spoor.operators.pooling import mean_vectors
from spoor.operators.profiles import last_wins, profile_sizes
from spoor.operators.ranking import retrieval_metrics
from spoor.operators.stats import (
    corpus_counts,
    corpus_sketches,
    estimated_counts,
    reduction_stats,
    reduction_summary,
    sketch_error,
)
from spoor.operators.whiten import fit_leading, fit_whitening
from spoor.plans.compaction import ORDER, compact
from spoor.plans.evaluation import summarise
from spoor.plans.retrieval import rank_sets
from spoor.plans.whitening import Whitening
from spoor.session import shared_dir, stored
from spoor.sources.banks import query_bank, reference_bank, resolve_bank
from spoor.sources.profiles import rule_lines
from spoor.streaming.late import STORE
from spoor.streaming.runtime import (
    match_stream, match_windows, match_windows_by_meaning, read_late, read_matches,
)

ENCODER_DIM = 32
# Small enough that every rule of the test tables counts as hot.
LOW_BUDGET = 50
# Small enough that the test banks take several tiles.
SMALL_TILE = 120
WINDOW, DELAY = "7 days", "1 day"


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


# ------------------------------------------------ texts and documents


def _document_lines(spark, sf_dir) -> DataFrame:
    lines = rule_lines(views.documents(spark, sf_dir), "doc_id")
    return ordered_distinct(lines, ["doc_id"], ["pos"])


def ordered_distinct_lines(spark, sf_dir):
    return _document_lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long"), "line")


def document_reduction(spark, sf_dir):
    return reduction_stats(
        views.documents(spark, sf_dir), _document_lines(spark, sf_dir), "doc_id"
    )


def document_reduction_summary(spark, sf_dir):
    return reduction_summary(document_reduction(spark, sf_dir))


def render_rules(spark, sf_dir):
    good, _ = parse_documents(views.profile_documents(spark, sf_dir))
    found = render(entries(good, "doc_id"), "doc_id")
    return found.select(
        "doc_id", F.col("acl_pos").cast("long"), F.col("ace_pos").cast("long"), "line"
    )


def compact_profiles(spark, sf_dir):
    lines = compact(views.profile_documents(spark, sf_dir), "doc_id").lines
    return lines.select("doc_id", *[F.col(c).cast("long") for c in ORDER], "line")


def compact_profile_stats(spark, sf_dir):
    return compact(views.profile_documents(spark, sf_dir), "doc_id").stats


def quarantined_profiles(spark, sf_dir):
    bad = compact(views.profile_documents(spark, sf_dir), "doc_id").quarantine
    return bad.select("doc_id", F.length("text").alias("n_chars"))


# ------------------------------------------------ profiles and labels


def corpus_rule_counts(spark, sf_dir):
    return corpus_counts(views.flows(spark, sf_dir).select("entity", "line"), "entity")


def corpus_sketch(spark, sf_dir):
    """Counts from a stored sketch per day of flows, beside the exact ones.

    An estimate may be off by four standard errors.
    """
    flows = views.flows(spark, sf_dir)
    days = flows.select("entity", "line", F.to_date("ts").alias("day"))
    merged = estimated_counts(stored(corpus_sketches(days, "entity", "day")))
    exact = corpus_counts(flows.select("entity", "line"), "entity")

    def near(name):
        off = F.abs(F.col(f"guess.{name}") - F.col(f"exact.{name}"))
        return (off <= 4 * sketch_error() * F.col(f"exact.{name}") + 1).alias(f"{name}_near")

    # One row each.
    both = merged.withColumn("one", F.lit(1)).alias("guess").join(
        exact.withColumn("one", F.lit(1)).alias("exact"), "one"
    )
    return both.select(
        "guess.rule_instances", "exact.unique_rules", "exact.profiles", near("unique_rules"),
        near("profiles"),
    )


def profile_sets(spark, sf_dir):
    return profile_sizes(views.flows(spark, sf_dir).select("entity", "line"), "entity")


def last_profile_wins(spark, sf_dir):
    """The last day of a user replaces the earlier days."""
    days = views.flows(spark, sf_dir).select(
        "entity", F.date_format("ts", "yyyy-MM-dd").alias("day"), "line"
    )
    return last_wins(days.distinct(), "entity", "day")


def clean_labels(spark, sf_dir):
    names = views.table(spark, sf_dir, "documents").select("doc_id", _variant_name())
    return names.select("doc_id", "name", clean_label(F.col("name")).alias("label"))


def _variant_name():
    """Source names with the suffixes of the rule files, several on some."""
    tail = F.element_at(
        F.array(*[F.lit(x) for x in (
            "", "_compact", "_test_3", "_loo_1_compact", "_family_x_test_2", "_ipbits24",
            "_ipbits8_family_y", "_compact_v2",
        )]),
        (F.col("doc_id") % 8 + 1).cast("int"),
    )
    return F.concat("source", tail).alias("name")


def expected_labels(spark, sf_dir):
    names = views.table(spark, sf_dir, "documents").select("doc_id", "lang", _variant_name())
    path = (
        F.when(F.col("doc_id") % 3 == 0, F.concat("name", F.lit(".txt")))
        .when(F.col("doc_id") % 3 == 1, F.concat("name", F.lit("/"), "lang", F.lit(".txt")))
        .otherwise(F.concat("lang", F.lit("_loo_9/deep/"), "name", F.lit(".v1.txt")))
    )
    return names.select("doc_id", path.alias("path")).withColumn(
        "expected", expected_label(F.col("path"))
    )


# ------------------------------------------------ exact overlap


def _sets(spark, sf_dir):
    queries = views.query_sets(spark, sf_dir)
    expected = queries.select("query", "expected").distinct()
    return queries, views.reference_sets(spark, sf_dir), expected


def _overlap_top(method, **options):
    def query(spark, sf_dir):
        queries, references, _ = _sets(spark, sf_dir)
        found = overlap_topk(queries, references, method, **options)
        return _rounded(found.withColumn("rank", F.col("rank").cast("long")), "score")

    return query


def _overlap_rank(method, **options):
    def query(spark, sf_dir):
        found = overlap_ranks(*_sets(spark, sf_dir), method, **options)
        return _rounded(found, "score")

    return query


def _overlap_metrics(method):
    def query(spark, sf_dir):
        ranks = overlap_ranks(*_sets(spark, sf_dir), method)
        return _rounded(retrieval_metrics(ranks), "top1", "topk", "mrr", "mean_rank")

    return query


def exact_report(spark, sf_dir):
    """Rank of the expected profile and the best five, flat."""
    queries, references, _ = _sets(spark, sf_dir)
    report = rank_sets(queries, references).report()
    best = report.select("query", "expected", "rank", F.posexplode("top").alias("place", "best"))
    return best.select(
        "query", "expected", "rank", F.col("place").cast("long"),
        F.col("best.device").alias("device"), F.round("best.score", 6).alias("score"),
        F.col("best.hit_count").alias("hit_count"),
    )


# ------------------------------------------------ vectors


def l2_normalised(spark, sf_dir):
    rows = views.bank(spark, sf_dir).select(
        "row_id", F.posexplode(l2_normalise(F.col("embedding"))).alias("dim", "value")
    )
    return _rounded(rows.withColumn("dim", F.col("dim").cast("long")), "value")


def mean_pooled(spark, sf_dir):
    pooled_rows = mean_vectors(views.bank(spark, sf_dir), "device")
    rows = pooled_rows.select("device", F.posexplode("embedding").alias("dim", "value"))
    return _rounded(rows.withColumn("dim", F.col("dim").cast("long")), "value")


def _banks(spark, sf_dir):
    queries = query_bank(resolve_bank(views.variant_bank(spark, sf_dir)))
    return queries, reference_bank(resolve_bank(views.bank(spark, sf_dir))).drop("text")


def _dense_top(prepare, **options):
    def query(spark, sf_dir):
        found = dense_topk(*prepare(spark, sf_dir), **options).drop("method")
        return _rounded(found.withColumn("rank", F.col("rank").cast("long")), "score")

    return query


def _dense_rank(prepare, **options):
    def query(spark, sf_dir):
        return _rounded(dense_ranks(*prepare(spark, sf_dir), **options).drop("method"), "score")

    return query


def _pooled_banks(spark, sf_dir):
    return pooled(*_banks(spark, sf_dir))


def maxsim_metrics(spark, sf_dir):
    ranks = dense_ranks(*_banks(spark, sf_dir))
    return _rounded(retrieval_metrics(ranks), "top1", "topk", "mrr", "mean_rank")


def _semantic_banks(spark, sf_dir):
    """Behaviour rules before and after the split date, embedded."""
    encoder = hashed_encoder(ENCODER_DIM)
    queries, references, _ = _sets(spark, sf_dir)
    texts = queries.select("line").union(references.select("line")).distinct()
    vectors = encoder(texts.withColumnRenamed("line", "text")).withColumnRenamed("text", "line")
    row_id = F.xxhash64("entity", "line").alias("row_id")
    q = queries.withColumn("entity", F.col("query")).join(vectors, "line")
    r = references.withColumn("entity", F.col("device")).join(vectors, "line")
    # Banks are made once and read several times.
    return (
        stored(q.select("query", "expected", row_id, "embedding")),
        stored(r.select("device", row_id, "embedding")),
    )


# ------------------------------------------------ episodes


def _episodes(mode):
    def query(spark, sf_dir):
        found = ep.sample_episodes(views.bank(spark, sf_dir), mode)
        return found.withColumn("pos", F.col("pos").cast("long"))

    return query


def masked_reference(spark, sf_dir):
    bank = views.bank(spark, sf_dir)
    return ep.masked_counts(bank, ep.sample_episodes(bank, ep.PARTIAL))


def masked_own_profile(spark, sf_dir):
    bank = views.bank(spark, sf_dir)
    return ep.masked_own_profile(bank, ep.sample_episodes(bank, ep.PARTIAL))


def _episode_top(mode, **options):
    def query(spark, sf_dir):
        bank = views.bank(spark, sf_dir)
        found = ep.episode_topk(bank, ep.sample_episodes(bank, mode), **options)
        return found.withColumn("rank", F.col("rank").cast("long"))

    return query


def _episode_ranks(mode, **options):
    def query(spark, sf_dir):
        bank = views.bank(spark, sf_dir)
        found = ep.episode_ranks(bank, ep.sample_episodes(bank, mode), **options)
        return _rounded(found, "score")

    return query


def _episode_summary(mode):
    def query(spark, sf_dir):
        bank = views.bank(spark, sf_dir)
        ranks = ep.episode_ranks(bank, ep.sample_episodes(bank, mode))
        return _rounded(summarise(ranks), "top1", "topk", "mrr", "mean_rank")

    return query


def episode_counts(spark, sf_dir):
    return ep.episode_counts(ep.sample_episodes(views.bank(spark, sf_dir)))


# ------------------------------------------------ whitening


def whiten_metadata(spark, sf_dir):
    bank = views.bank(spark, sf_dir)
    model = fit_whitening(bank)
    meta = bank.agg(F.count(F.lit(1)).alias("input_rows"))
    values = model.metadata(0)
    names = ("reference_rows", "input_dim", "rank", "k")
    return meta.select("*", *[F.lit(values[n]).cast("long").alias(n) for n in names])


def whiten_apply(spark, sf_dir):
    bank = views.bank(spark, sf_dir).select("row_id", "embedding")
    white = fit_whitening(bank).transform(bank, 16)
    return white.select("row_id", F.posexplode("embedding").alias("dim", "value"))


def whiten_maxsim(spark, sf_dir):
    queries, references = _banks(spark, sf_dir)
    model = fit_whitening(references)
    return dense_topk(model.transform(queries, 32), model.transform(references, 32)).drop("method")


def whiten_covariance(spark, sf_dir):
    """Covariance of the whitened vectors before their last scaling, every entry."""
    bank = views.bank(spark, sf_dir).select("row_id", "embedding")
    return _covariance(fit_whitening(bank).project(bank))


def whiten_leading(spark, sf_dir):
    """The same for the 16 leading directions, fitted without the others."""
    bank = views.bank(spark, sf_dir).select("row_id", "embedding")
    return _covariance(fit_leading(bank, 16).project(bank, 16))


def whiten_stage(spark, sf_dir):
    """Lengths of the vectors that a fitted, written and reread pipeline stage gives."""
    bank = views.bank(spark, sf_dir).select("row_id", "embedding")
    path = f"{shared_dir(spark)}/whitening-{uuid.uuid4().hex}"
    Pipeline(stages=[Whitening(k=16)]).fit(bank).write().save(path)
    white = PipelineModel.load(path).transform(bank)
    length = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    return white.select(
        "row_id", F.size("embedding").cast("long").alias("dim"),
        F.round(F.sqrt(length), 5).alias("length"),
    )


def _covariance(white):
    dim = len(white.first()["embedding"])
    # d x d sums, added up per task: each row adds the products of its entries.
    rows = white.select(
        "embedding", F.posexplode("embedding").alias("i", "x")
    ).select("i", "x", F.posexplode("embedding").alias("j", "y"))
    sums = rows.groupBy("i", "j").agg(
        F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum("x").alias("x"), F.sum("y").alias("y"),
        F.count(F.lit(1)).alias("n"),
    )
    covariance = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1)
    # Zero rounds to either sign of zero.
    return sums.select(
        F.col("i").cast("long"), F.col("j").cast("long"),
        (F.round(covariance, 5) + F.lit(0.0)).alias("covariance"), F.lit(dim).cast("long").alias("dim"),
    )


def whiten_energy(spark, sf_dir):
    """Sums of the second and fourth powers of the singular values."""
    bank = views.bank(spark, sf_dir)
    values = fit_whitening(bank).singular_values
    meta = bank.agg(F.count(F.lit(1)).alias("rows"))
    return meta.select(
        "rows",
        F.round(F.lit(float((values**2).sum())), 4).alias("second"),
        F.round(F.lit(float((values**4).sum())), 2).alias("fourth"),
    )


# ------------------------------------------------ embedding


def _exploded(vectors: DataFrame, *keys: str) -> DataFrame:
    """Non-zero entries of the vectors, one row each."""
    rows = vectors.select(*keys, F.posexplode("embedding").alias("dim", "value"))
    rows = rows.filter("value <> 0").withColumn("dim", F.col("dim").cast("long"))
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


def embed_per_rule(spark, sf_dir):
    lines = rule_lines(views.documents(spark, sf_dir), "doc_id")
    vectors = embed_rules(lines, hashed_encoder(ENCODER_DIM), "doc_id", ["pos"])
    return _exploded(vectors.withColumn("pos", F.col("pos").cast("long")), "doc_id", "pos")


def embed_in_runs(spark, sf_dir):
    """Rules encoded in one run per language, where a run reuses the vectors of those before."""
    store = VectorStore(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    encoder = hashed_encoder(ENCODER_DIM)
    rows = views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lines = stored(rule_lines(rows, "doc_id", "lang"))
    languages = [r["lang"] for r in lines.select("lang").distinct().orderBy("lang").collect()]
    found = [
        store.encode(lines.filter(F.equal_null("lang", F.lit(name))), encoder, "line")
        for name in languages
    ]
    vectors = reduce(DataFrame.unionByName, found)
    return _exploded(vectors.withColumn("pos", F.col("pos").cast("long")), "doc_id", "pos")


def embed_mean_rules(spark, sf_dir):
    lines = rule_lines(views.documents(spark, sf_dir), "doc_id")
    return _exploded(embed_mean(lines, hashed_encoder(ENCODER_DIM), "doc_id"), "doc_id")


def embed_whole_text(spark, sf_dir):
    files = views.documents(spark, sf_dir)
    return _exploded(embed_whole(files, hashed_encoder(ENCODER_DIM), "doc_id"), "doc_id")


# ------------------------------------------------ windows


def runtime_window_match(spark, sf_dir):
    found = match_windows(
        views.flows(spark, sf_dir), views.reference_sets(spark, sf_dir), WINDOW
    )
    return _windows_out(found)


def _windows_out(found):
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    found = found.withColumns({"window_start": start, "rank": F.col("rank").cast("long")})
    return _rounded(found, "score")


def runtime_window_meaning(spark, sf_dir):
    """Windows of all flows by the vectors of their rules, against the reference rules'."""
    encoder = hashed_encoder(ENCODER_DIM)
    references = views.reference_sets(spark, sf_dir)
    bank = encode_distinct(references, encoder, "line").select(
        "device", F.xxhash64("device", "line").alias("row_id"), "embedding"
    )
    flows = views.flows(spark, sf_dir)
    return _windows_out(match_windows_by_meaning(flows, stored(bank), encoder, WINDOW))


def runtime_stream_match(spark, sf_dir):
    """The same from a stream over the events, for the windows it has closed."""
    schema = views.table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    base = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    query = match_stream(
        views.event_flows(events),
        views.reference_sets(spark, sf_dir),
        WINDOW, DELAY, f"{base}/out", f"{base}/state",
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    return _windows_out(read_matches(spark, f"{base}/out"))


def runtime_stream_late(spark, sf_dir):
    """Flows that came after their window had closed: all from before the split, as they are
    delivered after those from the split on."""
    events = views.table(spark, sf_dir, "events")
    base = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    early = F.col("ts") < F.to_timestamp(F.lit(views.SPLIT))
    store = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        for arrived in (events.filter(~early), events.filter(early)):
            arrived.write.mode("append").parquet(f"{base}/in")
            query = match_stream(
                views.event_flows(spark.readStream.schema(events.schema).parquet(f"{base}/in")),
                views.reference_sets(spark, sf_dir),
                WINDOW, DELAY, f"{base}/out", f"{base}/state",
                trigger={"availableNow": True}, late=True,
            )
            query.awaitTermination()
    finally:
        spark.conf.set(STORE[0], store)
    late = read_late(spark, f"{base}/out").groupBy("window_start", "entity", "line").agg(
        F.sum("flows").alias("flows")
    )
    return late.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {
    "ordered_distinct_lines": ordered_distinct_lines,
    "reduction_stats": document_reduction,
    "reduction_summary": document_reduction_summary,
    "render_rules": render_rules,
    "compact_profiles": compact_profiles,
    "compact_profile_stats": compact_profile_stats,
    "quarantined_profiles": quarantined_profiles,
    "corpus_counts": corpus_rule_counts,
    "corpus_sketch": corpus_sketch,
    "profile_sets": profile_sets,
    "last_wins": last_profile_wins,
    "clean_labels": clean_labels,
    "expected_labels": expected_labels,
    "jaccard_topk": _overlap_top("jaccard"),
    "jaccard_topk_hot": _overlap_top("jaccard", pair_budget=LOW_BUDGET),
    "hit_topk": _overlap_top("exact_hit_count"),
    "jaccard_expected_rank": _overlap_rank("jaccard"),
    "jaccard_expected_rank_hot": _overlap_rank("jaccard", pair_budget=LOW_BUDGET, max_hot=8),
    "hit_expected_rank": _overlap_rank("exact_hit_count"),
    "hit_expected_rank_hot": _overlap_rank("exact_hit_count", pair_budget=LOW_BUDGET, max_hot=8),
    "jaccard_metrics": _overlap_metrics("jaccard"),
    "hit_metrics": _overlap_metrics("exact_hit_count"),
    "exact_report": exact_report,
    "l2_normalise": l2_normalised,
    "mean_pool": mean_pooled,
    "mean_pool_topk": _dense_top(_pooled_banks),
    "mean_pool_expected_rank": _dense_rank(_pooled_banks),
    "maxsim_topk": _dense_top(_banks),
    "maxsim_topk_tiled": _dense_top(_banks, tile_rows=SMALL_TILE),
    "maxsim_expected_rank": _dense_rank(_banks),
    "maxsim_expected_rank_tiled": _dense_rank(_banks, tile_rows=SMALL_TILE),
    "maxsim_metrics": maxsim_metrics,
    "semantic_topk": _dense_top(_semantic_banks),
    "semantic_expected_rank": _dense_rank(_semantic_banks),
    "episodes_strict": _episodes(ep.STRICT),
    "episodes_partial": _episodes(ep.PARTIAL),
    "masked_reference": masked_reference,
    "masked_own_profile": masked_own_profile,
    "episode_counts": episode_counts,
    "episode_topk_strict": _episode_top(ep.STRICT),
    "episode_topk_partial": _episode_top(ep.PARTIAL),
    "episode_ranks_strict": _episode_ranks(ep.STRICT),
    "episode_ranks_partial": _episode_ranks(ep.PARTIAL),
    "episode_ranks_partial_tiled": _episode_ranks(ep.PARTIAL, tile_rows=40),
    "episode_summary_strict": _episode_summary(ep.STRICT),
    "episode_summary_partial": _episode_summary(ep.PARTIAL),
    "whiten_metadata": whiten_metadata,
    "whiten_covariance": whiten_covariance,
    "whiten_energy": whiten_energy,
    "whiten_leading": whiten_leading,
    "whiten_stage": whiten_stage,
    "whiten_apply": whiten_apply,
    "whiten_maxsim": whiten_maxsim,
    "embed_per_rule": embed_per_rule,
    "embed_in_runs": embed_in_runs,
    "embed_mean": embed_mean_rules,
    "embed_whole": embed_whole_text,
    "runtime_window_meaning": runtime_window_meaning,
    "runtime_window_match": runtime_window_match,
    "runtime_stream_match": runtime_stream_match,
    "runtime_stream_late": runtime_stream_late,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five reference profiles per query profile, by Jaccard overlap."""
    return QUERIES["jaccard_topk"](spark, sf_dir)
