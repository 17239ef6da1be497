"""Queries of this package and the SQL that checks them, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, html_extract, media, mixing, near_dedup, quality, records, secrets, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        quality.op1_quality_classifier,
        decontam.op2_decontaminate,
        secrets.op3_secret_scan,
        suffix_dedup.op4_suffix_dedup,
        records.op5_token_records,
        html_extract.op6_html_extract,
        near_dedup.op7_near_dedup,
        mixing.op8_mix_sources,
        chat.op9_chat_format,
        media.op10_telephony_media,
    )
}

ORACLES: dict[str, str] = {
    "op3_secret_scan": secrets.oracle(),
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op7_near_dedup": near_dedup.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op9_chat_format": chat.ORACLE,
}
