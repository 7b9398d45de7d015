"""Parsers of labels and model output, as Column expressions where these can express them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F


def balanced_json(text: Column) -> Column:
    """The first balanced {...} of a model's answer, code fences or not; null without one. Braces count wherever they
    stand, strings included."""

    def first(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            found, depth, start = None, 0, -1
            for i, c in enumerate(x or ""):
                if c == "{":
                    start, depth = (i, 1) if depth == 0 else (start, depth + 1)
                elif c == "}" and depth:
                    depth -= 1
                    if depth == 0:
                        found = x[start : i + 1]
                        break
            out.append(found)
        return pd.Series(out, dtype="object")

    return F.pandas_udf(first, "string")(text)


def strip_marks(text: Column) -> Column:
    """Text without combining marks, decomposed first."""

    def plain(texts: pd.Series) -> pd.Series:
        import unicodedata

        return texts.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))

    return F.pandas_udf(plain, "string")(text)


def numbers_prefix(text: Column) -> Column:
    """array<int>: numbers before a paragraph, `58, 59. text` -> [58, 59]; empty without."""
    head = F.regexp_extract(text, r"^\s*(\d+(?:\s*,\s*\d+)*)\.", 1)
    return F.filter(F.transform(F.split(head, r"\s*,\s*"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def article_key(number: Column) -> Column:
    """struct<base, suffix>: `239 A A` sorts after 239 and 239A."""
    bare = F.replace(F.trim(number), F.lit(" "), F.lit(""))
    return F.struct(F.regexp_extract(bare, r"^(\d+)", 1).try_cast("int").alias("base"), F.regexp_extract(bare, r"^\d+([A-Z]*)", 1).alias("suffix"))


def repealed(text: Column) -> Column:
    """Whether a provision's text says that it was repealed or omitted."""
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(r"(?i)^\s*\[?\s*(repealed|omitted|\d+[a-z]*\.?\s*\[?(repealed|omitted))"))


def in_language(translations: Column, language: str, field: str, default: Column) -> Column:
    """A field of a translation; the default where it is missing or blank."""
    return F.coalesce(F.nullif(F.trim(F.try_element_at(translations, F.lit(language))[field]), F.lit("")), default)


def first_text(*fields: Column) -> Column:
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], F.lit(""))


def alnum_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def answer_text(answer: Column) -> Column:
    """A model's answer, given as JSON, as text: lists and objects become their values with spaces between, at any depth;
    a null in them is empty. Text that isn't JSON stays; null is empty."""

    def flat(answers: pd.Series) -> pd.Series:
        def one(x):
            try:
                rest = [json.loads(x)]
            except (TypeError, ValueError, RecursionError):
                return x or ""
            out = []
            while rest:
                v = rest.pop()
                if isinstance(v, list | dict):
                    rest += reversed(list(v.values()) if isinstance(v, dict) else v)
                else:
                    out.append("" if v is None else str(v))
            return " ".join(out)

        return answers.map(one)

    return F.pandas_udf(flat, "string")(answer)
