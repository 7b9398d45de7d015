"""Citable ids: grammar and adjacency of each kind of corpus, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The names of the corpora and the grammar of their ids. Corpora that aren't listed match exactly only.
GRAMMAR = {
    "bhagavad_gita": "chapter", "guru_granth_sahib": "ang", "dhammapada": "dotted", "yoga_sutras": "dotted",
    "ramayana": "dotted", "mahabharata": "dotted", "thirukkural": "flat", "bible": "book",
}


def _long(x: Column) -> Column:
    return x.try_cast("long")


def parse(id_: Column, grammar: str) -> Column:
    """struct<prefix string, n long>: ids of one prefix are neighbours by n; both null where the id doesn't parse."""
    if grammar == "dotted":
        prefix, n = F.regexp_extract(id_, r"^(.+)\.([^.]*)$", 1), _long(F.regexp_extract(id_, r"^(.+)\.([^.]*)$", 2))
    elif grammar == "chapter":
        pattern = r"^\s*(\d+)\.(\d+)\s*$"
        prefix, n = _long(F.regexp_extract(id_, pattern, 1)).cast("string"), _long(F.regexp_extract(id_, pattern, 2))
    elif grammar == "ang":
        pattern = r"^\s*ang\.(\d+)\.(\d+)\s*$"
        prefix, n = _long(F.regexp_extract(id_, pattern, 1)).cast("string"), _long(F.regexp_extract(id_, pattern, 2))
    elif grammar == "flat":
        prefix, n = F.lit("-"), _long(F.trim(id_))
    elif grammar == "book":
        pattern = r"^\s*(.+?)\s+(\d+):(\d+)\s*$"
        prefix = F.concat_ws(" ", F.regexp_extract(id_, pattern, 1), F.regexp_extract(id_, pattern, 2))
        n = _long(F.regexp_extract(id_, pattern, 3))
    else:
        prefix, n = F.lit(None).cast("string"), F.lit(None).cast("long")
    whole = n.isNotNull() & prefix.isNotNull() & (prefix != "")
    return F.struct(F.when(whole, prefix).alias("prefix"), F.when(whole, n).alias("n"))


def adjacent(a: Column, b: Column, grammar: str | None, tol: int = 1) -> Column:
    """Equal, or of one prefix with numbers at most tol apart. Ids that don't parse are compared as they stand."""
    if grammar is None:
        return a == b
    x, y = parse(a, grammar), parse(b, grammar)
    return (a == b) | F.coalesce((x["prefix"] == y["prefix"]) & (F.abs(x["n"] - y["n"]) <= tol), F.lit(False))


def match(a: Column, b: Column, corpus: Column, tol: int = 1) -> Column:
    """Adjacency under the rule of the row's corpus."""
    out = a == b
    for name in dict.fromkeys(GRAMMAR.values()):
        of = [c for c, g in GRAMMAR.items() if g == name]
        out = F.when(corpus.isin(*of), adjacent(a, b, name, tol)).otherwise(out)
    return out


def container(id_: Column) -> Column:
    return F.regexp_replace(id_, r"[.: ]?\d+$", "")


def normalise_cite(raw: Column) -> Column:
    """Exact form of a cited id: without brackets and what follows a dash."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^\[|\]", ""), r"\s+[—–-].*$", ""))


def compat_cite(raw: Column) -> Column:
    """First run of word characters, dots and colons; ids with spaces are cut there."""
    return F.regexp_extract(raw, r"[\w.:]+", 0)


def consistent(id_: Column, *fields: Column) -> Column:
    """Whether a dotted id has just the numbers that its fields hold; false where either lacks."""
    parts = F.split(id_, r"\.")
    same = [F.coalesce(F.get(parts, F.lit(i)).try_cast("long") == f.cast("long"), F.lit(False)) for i, f in enumerate(fields)]
    return F.coalesce(F.size(parts) == len(fields), F.lit(False)) & F.least(F.lit(True), F.lit(True), *same)
