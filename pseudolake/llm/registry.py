"""The queries of this subpackage and their SQL."""

from . import ann, chat, clusters, decontaminate, html, language, manifest, packing, pii, quality, simhash, substring, toxicity

MODULES = (decontaminate, toxicity, pii, quality, language, substring, simhash, packing, html, ann, clusters, manifest, chat)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
