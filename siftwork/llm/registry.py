"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import bpe, decontaminate, langid, merkle, near_dedup, pii, quality, substring_dedup, suffix_lm, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_langid": langid.op3_langid,
        "op4_bpe": bpe.op4_bpe,
        "op5_warc": warc.op5_warc,
        "op6_pii": pii.op6_pii,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_suffix_lm": suffix_lm.op8_suffix_lm,
        "op9_quality": quality.op9_quality,
        "op10_fingerprints": merkle.op10_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": near_dedup.ORACLE,
        "op2_substring_dedup": substring_dedup.ORACLE,
        "op5_warc": warc.ORACLE,
        "op7_decontaminate": decontaminate.ORACLE,
    }
