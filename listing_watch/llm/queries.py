"""The registered queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_stable, bloom_rank, bpe_automaton, covering_simhash, html_blocks, lang_crf, license_scan, line_bloom, pii_crf, qd_whiten, source_mix, wavelet, weak_quality
from .common import table


def _vocab(name: str) -> str:
    """Where the public tokenizers' files are; only their place is used, never a copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = wavelet.encode_and_read(table(spark, sf_dir, "documents").select("doc_id", "text"), _vocab("word_bpe_49k.json"))
    return d.select(F.col("wm_id").alias("doc_id"), F.col("wm_start").alias("start"), F.col("wm_n").alias("n_tokens"), F.col("wm_crc32").alias("ids_crc32"))


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii_crf.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("pi_base", lambda s: s["kind"] == k)).cast("long")
    return d.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in pii_crf.KINDS],
        F.sha2(written("pi_base"), 256).alias("base_sha256"),
        written("pi_spans").alias("spans"),
    )


def op3_stable_kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ann_stable.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return d.select(F.col("an_query").alias("query_id"), F.col("an_rank").alias("rank"), F.col("an_id").alias("vec_id"), F.col("an_score").alias("score"))


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = html_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", F.col("hb_text").alias("text"), F.length("hb_text").cast("long").alias("n_chars"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = weak_quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id",
        *[F.col(f"wq_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")],
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("ls_license").alias("license"), F.col("ls_dice").alias("dice"), F.col("ls_matches").alias("n_matches"))


def op7_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = covering_simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("sh_fp")), 16, "0").alias("fingerprint"), F.col("sh_component").alias("component_id"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = source_mix.taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select(F.col("mx_id").alias("doc_id"), *[F.col(f"mx_{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bpe_automaton.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), _vocab("byte_bpe_50k.json"))
    return d.select("doc_id", F.col("bpe_n").alias("n_tokens"), F.col("bpe_ids_sha256").alias("ids_sha256"), F.col("bpe_decoded_sha256").alias("decoded_sha256"))


def op10_lang_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lang_crf.learn_and_predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return d.select("doc_id", lang_crf.held_out(F.col("doc_id")).alias("held_out"), F.col("lc_lang").alias("lang_pred"), F.col("lc_score").alias("score"))


def op11_line_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_bloom.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return d.select("doc_id", F.col("ld_n_lines").alias("n_lines"), F.col("ld_n_dropped").alias("n_dropped"), F.sha2("ld_text", 256).alias("kept_sha256"))


def op12_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = qd_whiten.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return d.select("vec_id", *[F.col(f"qw_{c}").alias(c) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")])


def op13_bloom_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bloom_rank.rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return d.select(F.col("br_item").alias("item_id"), F.col("br_rank").alias("rank"), F.col("br_id").alias("doc_id"), F.col("br_score").alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_wavelet_tokens,
        op2_pii_crf,
        op3_stable_kd,
        op4_html_blocks,
        op5_weak_quality,
        op6_license_scan,
        op7_covering_simhash,
        op8_source_mix,
        op9_bpe_automaton,
        op10_lang_crf,
        op11_line_bloom,
        op12_qd_whitening,
        op13_bloom_rank,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_license_scan": license_scan.oracle(), "op11_line_bloom": line_bloom.oracle(), "op13_bloom_rank": bloom_rank.oracle()}
