"""The queries of this subpackage, by the name under which the entry module registers them, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, langid, licenses, merkle, packing, quality, raking, repair, secret_scan, simhash, tiff, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_simhash": simhash.op2_simhash,
    "op3_packing": packing.op3_packing,
    "op4_warc": warc.op4_warc,
    "op5_language_id": langid.op5_language_id,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_source_mixing": raking.op9_source_mixing,
    "op10_tiff": tiff.op10_tiff,
    "op11_chat_parts": chat.op11_chat_parts,
    "op12_turn_repair": repair.op12_turn_repair,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    # what of three of them SQL can express
    "license_places": licenses.license_places,
    "secret_counts": secret_scan.secret_counts,
    "tiff_payloads": tiff.tiff_payloads,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op11_chat_parts": chat.ORACLE_SQL,
    "op12_turn_repair": repair.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
    "license_places": licenses.PLACES_SQL,
    "secret_counts": secret_scan.COUNTS_SQL,
    "tiff_payloads": tiff.PAYLOADS_SQL,
}
