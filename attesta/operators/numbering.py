"""Numbers of units: labels read by a table of rules, paragraphs appended to accepted numbers, lines before a marker."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F


class Rule(NamedTuple):
    """One form of a scheme's labels. pattern fits a whole label; path says with $1, $2, ... and constants where its
    numbers go, dots between, the unit's own number last: `2.$1.$2`."""

    scheme: str
    pattern: str
    path: str


# How editions label units. A scheme's rules are tried in order.
RULES = (
    Rule("flat", r"(\d+)", "$1"),
    Rule("two", r"(\d+)\.(\d+)", "$1.$2"),
    Rule("six_sections_in_two", r"0*([1-3])\.(\d+)", "1.$1.$2"),
    Rule("six_sections_in_two", r"(\d+)\.(\d+)", "2.$1.$2"),
    Rule("three_or_first", r"(\d+),(\d+)\.(\d+)", "$1.$2.$3"),
    Rule("three_or_first", r"(\d+)\.(\d+)", "$1.1.$2"),
)


def label_key(label: Column, scheme: Column, rules: Sequence[Rule] = RULES) -> Column:
    """struct<section array<long>, number long>: a label's path by the first rule of its scheme that fits; null where
    none does, or where a number doesn't fit a long."""
    whole = F.trim(label)
    cases = [F.when((scheme == r.scheme) & F.rlike(whole, F.lit(rf"\A(?:{r.pattern})\z")), F.regexp_replace(whole, rf"\A(?:{r.pattern})\z", r.path)) for r in rules]
    path = F.transform(F.split(F.coalesce(*cases), r"\."), lambda x: x.try_cast("long"))
    key = F.struct(F.slice(path, F.lit(1), F.size(path) - 1).alias("section"), F.element_at(path, -1).alias("number"))
    return F.when(path.isNotNull() & F.forall(path, lambda x: x.isNotNull()), key)


def label_of(key: Column) -> Column:
    """The dotted path of a key."""
    return F.array_join(F.concat(key["section"], F.array(key["number"])), ".")


def accepted_units(paragraphs: DataFrame, group: Sequence[str], order: str, text: str = "text", *, jump: int = 4, pattern: str = r"(?s)^(\d+)\s*\.\s*(.*)$") -> DataFrame:
    """group..., n, text: numbered paragraphs in sequence, each with the unnumbered ones that follow.

    The first accepted number is 1, each further one exceeds the last accepted by at most `jump`. A number out of
    sequence changes nothing: its paragraph is dropped, and unnumbered ones after it still belong to the last accepted.
    What stands before 1, and blank or null paragraphs, are dropped; ties of `order` follow the text. A group's numbers
    are folded as one array, its texts are joined unit by unit."""
    group = list(group)
    bare = F.trim(F.col(text))
    digits = F.regexp_extract(bare, pattern, 1)
    own = paragraphs.where(bare != "").select(*group, F.struct(F.col(order).alias("at"), F.when(digits != "", F.coalesce(digits.try_cast("long"), F.lit(-1).cast("long"))).alias("n"), F.when(digits != "", F.trim(F.regexp_extract(bare, pattern, 2))).otherwise(bare).alias("t")).alias("_p"))
    own = own.groupBy(*group).agg(F.array_sort(F.collect_list("_p"), lambda a, b: _compare(a, b)).alias("_s"))

    def step(s: Column, p: Column) -> Column:
        ok = p["n"].isNotNull() & (((s["last"] == 0) & (p["n"] == 1)) | ((s["last"] > 0) & (p["n"] > s["last"]) & (p["n"] <= s["last"] + jump)))
        last = F.when(ok, p["n"]).otherwise(s["last"])
        return F.struct(last.alias("last"), F.array_append(s["of"], F.when((ok | p["n"].isNull()) & (last > 0), last)).alias("of"))

    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<long>").alias("of"))
    of = F.aggregate("_s", start, step, lambda s: s["of"])
    own = own.select(*group, F.inline(F.arrays_zip(of.alias("n"), F.col("_s").alias("p")))).where("n is not null")
    own = own.groupBy(*group, "n").agg(F.array_sort(F.collect_list("p"), lambda a, b: _compare(a, b)).alias("_s"))
    return own.select(*group, "n", F.trim(F.array_join(F.transform("_s", lambda p: p["t"]), " ")).alias("text"))


def _compare(a: Column, b: Column) -> Column:
    """Order of paragraphs: by place, then by text; numbered or not doesn't matter."""
    by = [F.when(a[c] < b[c], -1).when(a[c] > b[c], 1) for c in ("at", "t")]
    return F.coalesce(*by, F.lit(0))


# A unit's label between bars, the signs that verse lines hold, and what opens or closes a section.
MARKER = r"[|/]{2}\s*[A-Za-z]+_([0-9][0-9,.]*)\s*[|/]{2}"
VERSE = r"[|/]"
COLOPHONS = (r"[|/]{2}\s*iti[^|/]*+[|/]{2}", r"[|/]{2}\s*atha[^|/]*+[|/]{2}")


def before_markers(lines: DataFrame, group: Sequence[str], order: str, text: str = "text", *, marker: str = MARKER, verse: str = VERSE, dropped: Sequence[str] = COLOPHONS) -> DataFrame:
    """group..., label, text: the lines that a marker closes, its own line's beginning included; group 1 of `marker` is
    the label, and only a line's first marker counts.

    Lines without a marker count if they hold `verse`, as does what follows a marker in its line, which opens the next
    unit. Parts that fit `dropped` go, then bars at both ends. What no marker closes is dropped; of a label that comes
    twice the last unit stays. A group (a source file) is read in order by one task."""
    group = list(group)
    bare = F.trim(F.col(text))
    label = F.nullif(F.regexp_extract(bare, marker, 1), F.lit(""))
    sides = F.split(bare, marker, 2)
    spoken = lambda c: F.when(F.rlike(c, F.lit(verse)), c)
    before = F.when(label.isNull(), spoken(bare)).otherwise(sides[0])
    own = lines.where(bare != "").select(*group, F.col(order).alias("_at"), label.alias("_label"), before.alias("_before"), F.when(label.isNotNull(), spoken(F.get(sides, F.lit(1)))).alias("_after"))
    w = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_unit", F.count("_label").over(w))
    part = lambda u, p, t, l: F.struct(u.alias("u"), F.lit(p).alias("p"), F.trim(t).alias("t"), l.cast("string").alias("label"))  # noqa: E731, E741
    parts = F.array(part(F.col("_unit"), 1, F.col("_before"), F.col("_label")), part(F.col("_unit") + 1, 0, F.col("_after"), F.lit(None)))
    own = own.select(*group, "_at", F.inline(parts)).groupBy(*group, "u")
    own = own.agg(F.max("label").alias("label"), F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("_at", "p", "t")))).alias("_s"))
    joined = F.array_join(F.transform("_s", lambda x: x["t"]), " ")
    clean = functools.reduce(lambda c, d: F.regexp_replace(c, d, " "), dropped, joined)
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(clean), r"^[|/]++|[|/]++$", ""), r"\s++", " "))
    own = own.where("label is not null").select(*group, "label", "u", clean.alias("text"))
    return own.groupBy(*group, "label").agg(F.max_by("text", "u").alias("text"))
