"""Registered queries of this package: one ``opN_<name>`` per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.llm import (op1_fingerprints, op2_html, op3_mixing, op4_quality, op5_pieces, op6_jaccard,
                                op7_neighbours, op8_urls, op9_warc, op10_suffix_tree, op11_lines,
                                op12_negatives, op13_search)
from evidence_spark.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@register("op1_weighted_fingerprints")
def op1_weighted_fingerprints(spark, sf_dir):
    return op1_fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))


@register("op2_html_blocks")
def op2_html_blocks(spark, sf_dir):
    return op2_html.extract_text(read(spark, sf_dir, "pages"))


@register("op3_poisson_mixing", op3_mixing.oracle())
def op3_poisson_mixing(spark, sf_dir):
    return op3_mixing.poisson_mix(read(spark, sf_dir, "documents"))


@register("op4_quality_rules")
def op4_quality_rules(spark, sf_dir):
    return op4_quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op5_sampled_pieces")
def op5_sampled_pieces(spark, sf_dir):
    return op5_pieces.encode_decode(read(spark, sf_dir, "documents"))


@register("op6_parity_join")
def op6_parity_join(spark, sf_dir):
    return op6_jaccard.jaccard_components(read(spark, sf_dir, "documents"))


@register("op7_adaptive_scan")
def op7_adaptive_scan(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return op7_neighbours.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@register("op8_url_filter")
def op8_url_filter(spark, sf_dir):
    return op8_urls.filter_urls(read(spark, sf_dir, "pages"))


@register("op9_warc_revisits", op9_warc.ORACLE)
def op9_warc_revisits(spark, sf_dir):
    return op9_warc.roundtrip(read(spark, sf_dir, "pages"))


@register("op10_suffix_tree")
def op10_suffix_tree_scores(spark, sf_dir):
    return op10_suffix_tree.score_texts(read(spark, sf_dir, "documents"))


@register("op11_line_frequency", op11_lines.ORACLE)
def op11_line_frequency(spark, sf_dir):
    return op11_lines.judge_lines(read(spark, sf_dir, "documents"))


@register("op12_tree_negatives", op12_negatives.ORACLE)
def op12_tree_negatives(spark, sf_dir):
    return op12_negatives.mine_negatives(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=op12_negatives.shifted_label())


@register("op13_interval_search", op13_search.ORACLE)
def op13_interval_search(spark, sf_dir):
    return op13_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
