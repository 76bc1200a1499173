"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import avi, bpe, jaccard, langid, lengths, licences, mixing, quality, secrets, urlrules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_avi_media": avi.op2_avi_media,
    "media_clips": avi.media_clips,
    "op3_licence_scan": licences.op3_licence_scan,
    "op4_fair_mix": mixing.op4_fair_mix,
    "op5_language_id": langid.op5_language_id,
    "op6_bpe_roundtrip": bpe.op6_bpe_roundtrip,
    "op7_url_rules": urlrules.op7_url_rules,
    "op8_token_counts": lengths.op8_token_counts,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
}
ORACLE_SQL: dict[str, str] = {"op7_url_rules": urlrules.OP7_SQL, "op9_quality_rules": quality.OP9_SQL, "op10_jaccard_join": jaccard.OP10_SQL}
