"""Benchmark decontamination over canonical templates, in DataFrame operations alone.

Numbers, units and names become typed placeholders, so that a question with other numbers or names keeps its
template. Every text has two templates: one where capitalised words are names, and a folded one without names, which
copies in another case share. Windows of template words are joined by hash; a document that may hold enough of an
item's windows is looked at again: those that lie at about one offset must be enough, and the values in their slots must
go together with the item's: one value there for each value here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import durable, let, release

#: Words of a window, and the share of an item's windows from which on a document leaks it.
WINDOW, COVER = 5, 0.8
#: Share of an item's slot values that must map to one value each.
CONSISTENT = 0.8
#: Windows of the benchmark that are still sent to every executor; more are joined by shuffle.
BROADCAST_WINDOWS = 200_000

# Units that may follow a number, and words for numbers.
UNITS = (
    "percent % dollar dollars euro euros pound pounds cent cents second seconds minute minutes hour hours day days week weeks month months year years "
    "kilometer kilometers kilometre kilometres meter meters metre metres centimeter centimeters centimetre centimetres mile miles feet foot inch inches yard yards "
    "kilogram kilograms gram grams ton tons tonne tonnes ounce ounces liter liters litre litres gallon gallons km kg cm mm mg ml mph lb lbs oz ft min hr hrs m g l h s"
).split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
TOKEN = r"[0-9]++(?:[.,:][0-9]++)*+|[\p{L}\p{M}]++[.!?]?+|%|[\p{N}&&[^0-9]]++"
SLOTS = ("§n", "§u", "§d")


def tokens(text: Column) -> Column:
    """Runs of letters, with the mark that ends a sentence behind them, numbers, and percent signs."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _folded(low: Column) -> Column:
    """The word of each token in the folded template: §d for numbers, in digits or words, §u for units after one."""

    def number(x: Column) -> Column:
        return (x >= "0") & (x < ":") | x.isin(*NUMBER_WORDS)

    def one(x: Column, i: Column) -> Column:
        return F.when(number(x), F.lit("§d")).when(x.isin(*UNITS) & (i > 0) & number(F.get(low, i - 1)), F.lit("§u")).otherwise(x)

    return F.transform(low, one)


def _cased(codes: Column, low: Column, bare: Column) -> Column:
    """The folded words, but §n for those with capitals (names, and whatever begins a sentence, alike on both sides)."""
    return F.transform(codes, lambda c, i: F.when((F.get(bare, i) != F.get(low, i)) & ~c.isin("§d", "§u"), F.lit("§n")).otherwise(c))


class _Words:
    """Arrays of a text's tokens: as they stand, without marks, and in lower case."""

    def __init__(self, words: Column, bare: Column, low: Column):
        self.words, self.bare, self.low = words, bare, low

    def ends(self, codes: Column, i: Column) -> Column:
        """Whether a token ends its run: names in one sentence beside each other are one, and so are words of a number."""
        letters = lambda j: F.get(self.low, j) > "9\uffff"
        code, open_ = F.get(codes, i), F.get(self.words, i) == F.get(self.bare, i)
        joined = ((code == "§n") | (code == "§d") & letters(i) & letters(i + 1)) & (F.get(codes, i + 1) == code) & open_
        return ~F.coalesce(joined, F.lit(False))

    def joined(self, codes: Column, of: Column) -> Column:
        return F.filter(of, lambda _, i: self.ends(codes, i))


def _read(text: Column, body: Callable[[_Words], Column]) -> Column:
    bare = lambda words: F.transform(words, lambda w: F.rtrim(w, F.lit(".!?")))
    return let(tokens(text), lambda words: let(bare(words), lambda b: let(F.transform(b, lambda w: F.lower(w)), lambda low: body(_Words(words, b, low)))))


def _coded(text: Column, cased: bool, of: Callable[[_Words, Column], Column]) -> Column:
    def body(w: _Words) -> Column:
        return let(_folded(w.low), lambda codes: let(_cased(codes, w.low, w.bare), lambda named: w.joined(named, of(w, named))) if cased else w.joined(codes, of(w, codes)))

    return _read(text, body)


def template(text: Column, cased: bool = True) -> Column:
    """The words of a text's template."""
    return _coded(text, cased, lambda w, codes: codes)


def values(text: Column, cased: bool = True) -> Column:
    """What each word of the template stands for, in lower case: of a run the last word."""
    return _coded(text, cased, lambda w, codes: w.low)


def plain(text: Column) -> Column:
    """A text's words in lower case, numbers left out."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")


def windows(words: Column, holding: str | None = None) -> Column:
    """Hashes of all windows of WINDOW template words, in order; with `holding` only of those that hold this word."""

    def all_of(h: Column) -> Column:
        def one(i: Column) -> Column:
            parts = [F.get(h, i + j) for j in range(WINDOW)]
            if holding is None:
                return F.xxhash64(*parts)
            there = F.xxhash64(F.lit(holding))
            return F.when(there.isin(*parts), F.xxhash64(*parts))

        out = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), one)
        return out if holding is None else F.filter(out, lambda w: w.isNotNull())

    return F.when(F.size(words) >= WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), all_of)).otherwise(F.array().cast("array<bigint>"))


def _short(text: Column) -> Column:
    """The window of a text of few words: all of its plain ones."""
    return F.xxhash64(F.lit("short"), F.array_join(plain(text), " "))


def _hashes(text: Column) -> Column:
    """The hashes to look a document up by: windows of the folded template, those windows of the cased one that hold a
    name (the others are among the former), and one for a text of few words."""

    none = F.array().cast("array<bigint>")

    def both(w: _Words) -> Column:
        def coded(codes: Column) -> Column:
            cased = let(_cased(codes, w.low, w.bare), lambda named: let(w.joined(named, named), lambda kept: windows(kept, "§n")))
            return F.concat(let(w.joined(codes, codes), lambda kept: windows(kept)), F.when(F.rlike(text, F.lit(r"\p{Lu}")), cased).otherwise(none))

        short = F.when(F.size(w.words) < 2 * WINDOW, F.array(_short(text))).otherwise(none)
        return F.concat(let(_folded(w.low), coded), short)

    return _read(text, both)


def _templates(rows: DataFrame, text: str) -> DataFrame:
    """rows twice, with `cased`, `words` and `said`: template and values."""
    pair = [F.struct(F.lit(c).alias("cased"), template(F.col(text), c).alias("words"), values(F.col(text), c).alias("said")) for c in (False, True)]
    return rows.select("*", F.inline(F.array(*pair)))


def _asked(benchmark: DataFrame) -> DataFrame:
    """item_id, cased, window, at, n_words, short: the windows of all items, in both templates, with two plain words or more."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("asked"))
    twice = _templates(own, "asked")
    long_ = twice.select("item_id", "cased", F.size("words").alias("n_words"), F.lit(False).alias("short"), F.posexplode(windows(F.col("words"))).alias("at", "window"), "words")
    long_ = long_.where(F.size(F.filter(F.slice("words", F.col("at") + 1, F.lit(WINDOW)), lambda w: ~w.isin(*SLOTS))) >= 2).drop("words")
    few = twice.where((F.size("words") < WINDOW) & ~F.col("cased") & (F.size(plain(F.col("asked"))) >= 2))
    few = few.select("item_id", "cased", F.size("words").alias("n_words"), F.lit(True).alias("short"), F.lit(0).alias("at"), _short(F.col("asked")).alias("window"))
    return long_.unionByName(few)


def leaks(docs: DataFrame, benchmark: DataFrame, *, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it leaks: key, mark (see `clean`), doc_id, item_id, n_windows (distinct
    windows of the item), n_found (of these, at about one offset of the document), coverage, n_slots (distinct slot
    values of the item there), n_consistent; of the better of both templates.

    A document must hold `cover` of an item's windows. Words that touch a passage without a space count as its first
    and last one if they end or begin so. Offsets within a passage may differ by a quarter of the item's words.

    benchmark: item_id, text. Null and empty texts leak nothing; items whose windows are all placeholders (under two
    other words) are never found; items under WINDOW words are found only in documents of the same words; null ids
    are kept; rows that repeat are reported once; empty tables give no rows; other columns are not read.
    """
    placed = durable(_asked(benchmark), "windows")
    own_windows = placed.select("item_id", "cased", "window").distinct()
    sizes = own_windows.groupBy("item_id", "cased").agg(F.count(F.lit(1)).alias("n_windows"))
    if placed.count() <= BROADCAST_WINDOWS:
        own_windows, sizes = F.broadcast(own_windows), F.broadcast(sizes)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    own = docs.select(key.alias("key"), F.xxhash64(text).alias("mark"), F.col(id_col).cast("long").alias("doc_id"), text.alias("body"))
    seen = own.select("key", "mark", F.explode(_hashes(F.col("body"))).alias("window"))
    maybe = seen.join(own_windows, "window").groupBy("key", "mark", "item_id", "cased").agg(F.count_distinct("window").alias("n"))
    maybe = maybe.join(sizes, ["item_id", "cased"]).where((F.col("n") >= cover * F.col("n_windows")) | (F.col("n_windows") >= WINDOW) & (F.col("n") >= cover * F.col("n_windows") - 2))
    maybe = durable(maybe.select("key", "mark", "item_id", "cased", "n_windows"), "maybe")

    # those documents again, word by word
    again = own.join(maybe.select("key", "mark").distinct(), ["key", "mark"], "left_semi").dropDuplicates(["key", "mark"])
    bodies = durable(_templates(again, "body").select("key", "mark", "doc_id", "cased", "words", "said", _short(F.col("body")).alias("whole")), "bodies")
    asked = _templates(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("asked")), "asked")
    theirs = asked.select("item_id", "cased", F.col("words").alias("item_words"), F.col("said").alias("item_said"))
    own_hashes = F.concat(F.transform(windows(F.col("words")), lambda w, i: F.struct(i.alias("q"), w.alias("window"))), F.array(F.struct(F.lit(0).alias("q"), F.col("whole").alias("window"))))
    hits = bodies.select("key", "mark", "cased", F.inline(own_hashes)).join(maybe, ["key", "mark", "cased"]).join(placed, ["item_id", "cased", "window"])

    # hits of one passage lie at about one offset: in the same of two bins that overlap by half
    spread = F.greatest(F.lit(4), F.floor(F.col("n_words") / 4))
    offset = F.col("q") - F.col("at")
    bins = F.array(*[F.struct(F.lit(s).alias("side"), F.floor((offset + s * spread) / (2 * spread)).alias("place")) for s in (0, 1)])
    hits = hits.withColumn("offset", offset).select("*", F.inline(bins))
    group = ["key", "mark", "item_id", "cased", "side", "place"]
    found = hits.groupBy(*group).agg(
        F.count_distinct("window").alias("n_found"), F.first("n_windows").alias("n_windows"), F.first("n_words").alias("n_words"), F.first("short").alias("short"),
        F.min(F.struct("at", "q")).alias("first"), F.max(F.struct("at", "q")).alias("last"), F.mode("offset", True).alias("usual"),
    )
    found = found.join(bodies.select("key", "mark", "doc_id", "cased", "words", "said"), ["key", "mark", "cased"]).join(theirs, ["item_id", "cased"])
    # a word that touches the passage without a space spoils its first or last window alone
    edge = F.when((F.col("first.at") == 1) & F.endswith(F.get("said", F.col("first.q") - 1), F.get("item_said", F.lit(0))), 1).otherwise(0)
    edge += F.when((F.col("last.at") == F.col("n_words") - WINDOW - 1) & F.startswith(F.get("said", F.col("last.q") + WINDOW), F.get("item_said", F.col("n_words") - 1)), 1).otherwise(0)
    found = found.withColumn("n_found", F.least("n_windows", F.col("n_found") + F.when(F.col("short"), 0).otherwise(edge)))
    found = found.where(F.col("n_found") >= cover * F.col("n_windows"))

    # each slot of the item beside the word at its place there
    slots = F.filter(F.transform("item_words", lambda w, i: F.struct(i.alias("i"), w.alias("slot"))), lambda s: s["slot"].isin(*SLOTS))
    slots = found.where(~F.col("short")).select(*group, "usual", F.inline(slots), "item_said")
    slots = slots.withColumn("here", F.get("item_said", F.col("i"))).drop("item_said")
    over = hits.select(*group, "offset", F.explode(F.sequence(F.col("at"), F.col("at") + (WINDOW - 1))).alias("i")).distinct()
    best = slots.join(over, [*group, "i"]).groupBy(*group, "slot", "here", "i").agg(F.min_by("offset", F.struct(F.abs(F.col("offset") - F.col("usual")).alias("d"), "offset")).alias("offset"))
    best = best.join(bodies.select("key", "mark", "cased", "said"), ["key", "mark", "cased"]).withColumn("there", F.get("said", (F.col("i") + F.col("offset")).cast("int")))
    one = best.groupBy(*group, "slot", "here").agg((F.count_distinct("there") == 1).alias("one")).groupBy(*group).agg(F.count(F.lit(1)).alias("n_slots"), F.count_if("one").alias("n_consistent"))
    out = found.join(one, group, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_slots", "n_consistent")})
    out = out.where(F.col("n_consistent") >= CONSISTENT * F.col("n_slots")).withColumn("coverage", F.col("n_found") / F.col("n_windows"))
    kept = F.struct("coverage", F.col("n_consistent") / F.greatest("n_slots", F.lit(1)), "cased", "n_slots")
    columns = F.struct("doc_id", "n_windows", "n_found", "coverage", "n_slots", "n_consistent")
    out = durable(out.groupBy("key", "mark", "item_id").agg(F.max_by(columns, kept).alias("b")), "leaks")
    release(placed, maybe, bodies)
    return out.select("key", "mark", "b.doc_id", "item_id", "b.n_windows", "b.n_found", "b.coverage", "b.n_slots", "b.n_consistent")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the documents that leak an item."""
    found = leaks(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("key").alias("_key"), F.col("mark").alias("_mark")).distinct()
    key = F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63)))
    mark = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(found, (key == found["_key"]) & (mark == found["_mark"]), "left_anti")
