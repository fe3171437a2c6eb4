"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import filter_audit, line_rules, spelling
from seqloom.sources.surrogates import table


def op1_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.prefix_free import removals

    return removals(table(spark, sf_dir, "documents"))


def op2_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.quotations import reply_order

    return reply_order(table(spark, sf_dir, "conversations"))


def op3_steady_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.multi_index import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.line_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.tree_bpe import digests, encode_documents

    return digests(encode_documents(table(spark, sf_dir, "documents")))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.id_files import through_files

    return through_files(table(spark, sf_dir, "documents"))


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.html_layout import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.dart_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op13_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.language_spans import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


QUERIES = {
    f.__name__: f
    for f in (
        op1_prefix_free_repeats, op2_quotations, op3_steady_toxicity, op4_multi_index, op5_line_rules,
        op6_best_fit_packing, op7_tree_bpe, op8_id_files, op9_html_layout, op10_dart_minhash,
        op11_filter_audit, op12_spelling_variants, op13_language_spans,
    )
}
SQL: dict[str, str] = {"op5_line_rules": line_rules.SQL, "op11_filter_audit": filter_audit.SQL, "op12_spelling_variants": spelling.SQL}
