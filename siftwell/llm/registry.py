"""All queries of this subpackage and the SQL that some of them have."""

from importlib import import_module

MODULES = ["op1_quality", "op2_secrets", "op3_decontamination", "op4_sharding", "op5_tokenfile", "op6_mixing", "op7_html", "op8_tokencount", "op9_substrings", "op10_jaccard"]


def _all(kind: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), kind).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
