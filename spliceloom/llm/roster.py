"""The corpus queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from spliceloom.llm import audit, dac, licenses, mixing, packing, quality, secretscan, simhash, substring, tiers, topk, urlrep, whitening


def queries(pipeline: Callable) -> dict[str, Callable]:
    """The queries; ``pipeline`` is the run of all stages."""
    return {
        "op1_suffix_dedup": substring.op1_suffix_dedup,
        "op2_license_scans": licenses.op2_license_scans,
        "op3_mixing": mixing.op3_mixing,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_top_k_search": topk.op5_top_k_search,
        "op6_url_filters": urlrep.op6_url_filters,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_simhash": simhash.op8_simhash,
        "op9_token_files": dac.op9_token_files,
        "op10_secret_scans": secretscan.op10_secret_scans,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_multi_length_packing": tiers.op12_multi_length_packing,
        "op13_filter_audit": audit.op13_filter_audit,
        "pipeline": pipeline,
    }


def oracle_sql(pipeline: str | None = None) -> dict[str, str]:
    """SQL of the queries that SQL can express; ``pipeline`` is that of the run of all stages."""
    out = {"op3_mixing": mixing.OP3_SQL, "op5_top_k_search": topk.OP5_SQL, "op6_url_filters": urlrep.OP6_SQL, "op13_filter_audit": audit.OP13_SQL}
    return out | ({"pipeline": pipeline} if pipeline else {})
