"""One query per operator of this subpackage, each over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@_query
def op1_html_extract(spark, sf):
    from tabwright.llm.html_extract import extract_main_text
    return extract_main_text(_table(spark, sf, "pages"))


@_query
def op2_decontamination(spark, sf):
    from tabwright.llm.decontaminate import find_leaks
    return find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


@_query
def op3_suffix_dedup(spark, sf):
    from tabwright.llm.suffix_dedup import remove_repeats
    return remove_repeats(_table(spark, sf, "documents"))


@_query
def op4_toxicity(spark, sf):
    from tabwright.llm.toxicity import score_toxicity
    return score_toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@_query
def op5_packing(spark, sf):
    from tabwright.llm.packing import pack
    return pack(_table(spark, sf, "documents"))


@_query
def op6_pii(spark, sf):
    from tabwright.llm.pii import find_personal_data
    return find_personal_data(_table(spark, sf, "documents")).drop("sanitised")


@_query
def op7_jaccard_join(spark, sf):
    from tabwright.llm.jaccard_join import link_components
    return link_components(_table(spark, sf, "documents"))


@_query
def op8_line_dedup(spark, sf):
    from tabwright.llm.line_dedup import line_dedup
    return line_dedup(_table(spark, sf, "documents"))


@_query
def op9_quality(spark, sf):
    from tabwright.llm.quality import judge
    return judge(_table(spark, sf, "documents")).drop("p_good")


@_query
def op10_warc(spark, sf):
    from tabwright.llm.warc import round_trip
    return round_trip(_table(spark, sf, "pages"))


@_query
def op11_conversation_repair(spark, sf):
    from tabwright.llm.conversation_repair import damage_and_repair
    return damage_and_repair(_table(spark, sf, "conversations"))


@_query
def op12_collocations(spark, sf):
    from tabwright.llm.collocations import collocations
    return collocations(_table(spark, sf, "documents"))


@_query
def op13_url_filter(spark, sf):
    from tabwright.llm.url_filter import judge_urls
    return judge_urls(_table(spark, sf, "pages"))


def _oracles():
    from tabwright.llm import collocations, conversation_repair, line_dedup, url_filter, warc
    ORACLE["op11_conversation_repair"] = conversation_repair.ORACLE
    ORACLE["op12_collocations"] = collocations.ORACLE
    ORACLE["op13_url_filter"] = url_filter.ORACLE
    ORACLE["op8_line_dedup"] = line_dedup.ORACLE
    ORACLE["op10_warc"] = warc.ORACLE


_oracles()
