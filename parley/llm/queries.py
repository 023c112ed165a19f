"""The corpus queries over their whole tables, and the SQL that checks some of them."""

from parley.llm import (codebooks, decontaminate, html, licences, lines, manifest, mixing, near, quality, search, tokens,
                        toxicity, urls)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark, sf_dir):
    return html.main_text(_table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark, sf_dir):
    return near.report(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark, sf_dir):
    return mixing.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark, sf_dir):
    return lines.report(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark, sf_dir):
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_url_filter(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages"), rounds=None)


def op8_token_counts(spark, sf_dir):
    return tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality.report(_table(spark, sf_dir, "documents"))


def op10_licence_scan(spark, sf_dir):
    return licences.report(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return codebooks.report(_table(spark, sf_dir, "embeddings"))


def op12_exact_top_k(spark, sf_dir):
    return search.top_k(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark, sf_dir):
    return manifest.manifest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_main_text, op2_jaccard_join, op3_mix_sources, op4_line_dedup, op5_decontaminate, op6_toxicity, op7_url_filter,
    op8_token_counts, op9_quality_rules, op10_licence_scan, op11_vector_codes, op12_exact_top_k, op13_merkle_manifest)}

ORACLE = {"op4_line_dedup": lines.ORACLE, "op11_vector_codes": codebooks.ORACLE, "op12_exact_top_k": search.ORACLE,
          "op13_merkle_manifest": manifest.ORACLE}
