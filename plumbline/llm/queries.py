"""The registered queries of this package and their SQL. Thin: each derives its columns from an operator's result."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm import (
    chat_format,
    decontaminate,
    html_extract,
    idfiles,
    jaccard_join,
    merkle,
    packing,
    pii,
    quality_rules,
    secret_scan,
    spelling,
    token_counts,
    url_filter,
)
from plumbline.llm.oracles import ORACLES  # noqa: F401
from plumbline.llm.rowkeys import prepare, table
from plumbline.scale import materialise

QUERIES = {}


def register(fn):
    def run(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


@register
def op2_quality_rules(spark, sf_dir):
    judged = quality_rules.ledger(table(spark, sf_dir, "documents"))
    rows = quality_rules.with_ablation(materialise(judged.select("doc_id", "measures", "fail_bits"), "ledger"), "v2")
    counts = [F.col(f"measures.{m}").alias(m) for m in quality_rules.MEASURES if m not in ("n_lines", "n_stutters")]
    base_failed = ~quality_rules.passes("base")
    return rows.select(
        "doc_id", *counts, base_failed.alias("base_failed"), quality_rules.passes("v2").alias("kept"), "fail_bits",
        "only_rule", "only_rule_failed", "only_rule_rows",
    )


@register
def op4_cost_balanced_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))


#: Words in a host that put its pages on the list of blocked URLs.
LISTED_HOSTS = r"(^|[.-])(spam|adult|cheap|casino|free|ads)[.-]"


@register
def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    listed = url_filter.url_list(pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS)))
    return url_filter.judge_urls(pages, url_filter.rule_list(spark).unionByName(listed))


@register
def op7_chat_format(spark, sf_dir):
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest(chat_format.format_chats(turns))


@register
def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"), n=3, percent=90)


@register
def op8_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register
def op10_personal_data(spark, sf_dir):
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


@register
def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_counts.digest(
        token_counts.count_tokens(docs, public_tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    )


@register
def op6_decontaminate(spark, sf_dir):
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op11_spelling_variants(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@register
def op12_token_files(spark, sf_dir):
    return idfiles.round_trip(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))


@register
def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    written = merkle.leaves_of(docs, keep=["doc_id", "lang"], _presented=merkle.tampered())
    manifest = merkle.build(written, "lang", "doc_id")
    return merkle.digest(merkle.proofs(manifest), manifest.root)
