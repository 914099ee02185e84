"""One query for each operator of the package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeframe.llm import (
    alignment,
    buckets,
    decontaminate,
    exact_dedup,
    langid,
    licenses,
    lm,
    merkle,
    ngram_join,
    packing,
    quality,
    substring_dedup,
    suffix_dedup,
)
from gradeframe.llm.rows import prepared

#: The file of the public tokenizers that sequences are counted with.
TOKENIZER = "word_bpe_49k.json"
#: Byte-level pieces, and pieces with byte fallback.
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(name: str):
    def add(fn):
        QUERIES[name] = lambda spark, sf: fn(lambda table: prepared(spark).read.parquet(f"{sf}/{table}.parquet"))
        return fn

    return add


@_query("op1_decontaminate")
def op1(read):
    return decontaminate.digest(read("documents"), read("benchmark"))


@_query("op2_exact_dedup")
def op2(read):
    return exact_dedup.digest(read("documents"))


@_query("op3_ngram_join")
def op3(read):
    return ngram_join.digest(read("documents"))


@_query("op4_substring_dedup")
def op4(read):
    return substring_dedup.digest(read("documents"))


@_query("op5_licences")
def op5(read):
    return licenses.digest(read("documents"))


@_query("op6_quality")
def op6(read):
    return quality.digest(read("documents"), read("labels"))


@_query("op7_suffix_dedup")
def op7(read):
    return suffix_dedup.digest(read("documents"))


@_query("op8_packing")
def op8(read):
    return packing.digest(read("documents"), tokenizer_path())


@_query("op9_language")
def op9(read):
    return langid.digest(read("documents"))


@_query("op10_lm_score")
def op10(read):
    return lm.digest(read("documents"))


@_query("op11_alignment")
def op11(read):
    return alignment.digest(read("documents"), tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER))


@_query("op12_power_packing")
def op12(read):
    return buckets.digest(read("documents"), tokenizer_path(BYTE_TOKENIZER))


@_query("op13_merkle")
def op13(read):
    return merkle.digest(read("documents"))
