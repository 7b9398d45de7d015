"""Named queries over the tables, each with the SQL that checks it."""

from attesta.plans import extraction, landing, reporting, retrieval, review

MODULES = [retrieval, review, extraction, reporting, landing]


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.SQL.items()}
