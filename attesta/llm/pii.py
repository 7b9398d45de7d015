"""Sanitisation by information content, in DataFrame operations alone.

Patterns find protected entities (mail addresses, IP addresses, card and phone numbers). Words of texts that hold an
entity are weighed by how much they tell of it: with counts over all different texts, pointwise mutual information of
word and entity as a share of the entity's own information content. Words at or above a disclosure threshold are
generalised or, if they all but name the entity, removed. Away from the entity a word must also come in different
surroundings, or edited copies of one text would lose all their rare words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import durable, let

# The patterns of the entities, in the order in which they are listed. Possessive forms and look-behinds
# find the same matches as the plain forms, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
#: Code points on either side of an entity in which words are weighed.
CONTEXT = 80
#: Shares of an entity's information from which a word is generalised, and removed; documents that must agree.
GENERALISE, REMOVE, SUPPORT = 0.5, 0.95, 2
#: Share of the texts with a word that must hold the entity, and, away from entities, of a word's places that must differ
#: in the words around it: what an edited copy repeats isn't evidence.
KNOWN, VARIED = 0.5, 0.5
#: Tasks over which rows of one text are spread.
SALTS = 16
WORD = r"\p{L}{2,}"
NO_WORD = r"[^\p{L}]+"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost matches, in code points.

    The texts between matches give the places: a match starts after all texts and matches before it. Sums are taken
    over blocks of about the square root of their number, so that many matches in one text stay affordable.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def placed(v: Column) -> Column:
        found, between = v["found"], v["between"]
        n = F.size(found)

        def blocks(w: Column) -> Column:
            lens, block = w["lens"], w["block"]
            count = F.ceil(F.size(lens) / block).cast("int")
            sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(lens, b * block + 1, block)))

            def starts(sums_: Column) -> Column:
                before = F.transform(F.sequence(F.lit(0), F.size(sums_) - 1), lambda b: total(F.slice(sums_, F.lit(1), b)))

                def each(before_: Column) -> Column:
                    def one(i: Column) -> Column:
                        b = F.floor(i / block).cast("int")
                        start = F.get(before_, b) + total(F.slice(lens, b * block + 1, i - b * block)) + F.length(F.get(between, i))
                        value = F.get(found, i)
                        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

                    return F.transform(F.sequence(F.lit(0), F.size(lens) - 1), one)

                return let(before, each)

            return let(sums, starts)

        lens = F.transform(found, lambda x, i: F.length(x) + F.length(F.get(between, i)))
        w = F.struct(lens.alias("lens"), F.ceil(F.sqrt(n.cast("double"))).cast("int").alias("block"))
        return F.when(n > 0, let(w, blocks)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return let(pair, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.when(F.length(short(p)) <= 3, short(p)).otherwise("999").cast("int") <= 255))


def _luhn(value: Column) -> Column:
    def check(d: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return s + F.when(i % 2 == 1, twice).otherwise(x)

        right = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0
        return F.when(F.length(d).between(13, 19), right).otherwise(F.lit(False))

    return let(_digits(value), check)


def entities(text: Column) -> Column:
    """array<struct<kind, start, end, value>>: valid matches of all kinds, by kind, then start. kind counts from 0."""
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")

    def of(kind: int, pattern: str, there: Column, valid: Callable[[Column], Column] | None) -> Column:
        found = matches(text, pattern)
        if valid:
            found = F.filter(found, lambda m: valid(m["value"]))
        found = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(there, found).otherwise(empty)

    return F.concat(
        of(0, EMAIL, F.contains(text, F.lit("@")), None),
        of(1, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]")), _octets),
        of(2, CARD, F.rlike(text, F.lit(r"(?:[0-9][ -]?){13}")), _luhn),
        of(3, PHONE, F.rlike(text, F.lit(r"\+[0-9]")), lambda v: F.length(_digits(v)).between(9, 15)),
    )


def _near(text: Column, span: Column) -> Column:
    """array<struct<start, end, term>>: whole words beside a span."""

    def side(begin: Column, end: Column) -> Column:
        cut_left, cut_right = begin > 0, end < F.length(text)
        part = F.substr(text, begin + 1, end - begin)
        inside = F.filter(matches(part, WORD), lambda m: ((m["start"] > 0) | ~cut_left) & ((m["end"] < end - begin) | ~cut_right))
        return F.transform(inside, lambda m: F.struct((m["start"] + begin).alias("start"), (m["end"] + begin).alias("end"), F.lower(m["value"]).alias("term")))

    left = F.greatest(span["start"] - CONTEXT, F.lit(0))
    right = F.least(span["end"] + CONTEXT, F.length(text))
    return F.concat(side(left, span["start"]), side(span["end"], right))


def _keyed(docs: DataFrame, id_col: str, text_col: str):
    text, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    return text, key, F.xxhash64(text)


def _signature(name: str) -> list[Column]:
    """What tells sets of texts apart, whatever their order: two hashes and a count."""
    return [F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.lit(1), "mark")).alias("a"), F.bit_xor(F.xxhash64(F.lit(2), "mark")).alias("b")).alias(name)]


def _told(pairs: DataFrame, total: float) -> DataFrame:
    """pairs (n_both, n_entity, n_term) that disclose, with share: their information as a share of the entity's own."""
    own = F.log(F.lit(total) / F.col("n_entity"))
    share = F.log(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term"))) / own
    sure = (own > 0) & (F.col("n_both") >= KNOWN * F.col("n_term"))
    return pairs.where(sure).withColumn("share", share).where(F.col("share") >= GENERALISE)


def _far_words(texts: DataFrame, of_term: DataFrame) -> DataFrame:
    """mark, term, n_term, around (a hash of the words on both sides, at one of its places) of the words of each text
    that may disclose one of its entities: those that aren't in too many texts for its most frequent one."""
    words = F.split(F.lower("text"), NO_WORD)
    placed = let(words, lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("term"), F.xxhash64(F.get(ws, i - 1), F.lit(0), F.get(ws, i + 1)).alias("around"))))
    own = texts.select("mark", "reach", F.inline(placed)).where(F.length("term") >= 2).join(of_term, "term")
    return own.where(F.col("n_term") * KNOWN <= F.col("reach")).groupBy("mark", "term", "n_term").agg(F.min("around").alias("around"))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, mark, spans of the rows that hold an entity, once each."""
    text, key, mark = _keyed(docs, id_col, text_col)
    own = docs.select(key.alias("key"), mark.alias("mark"), text.alias("text"))
    found = own.withColumn("base", entities(F.col("text"))).where(F.size("base") > 0)
    named = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.concat_ws(":", s["kind"].cast("string"), F.when(s["kind"] == 0, F.lower(s["value"])).otherwise(_digits(s["value"]))).alias("entity"), F.transform(_near(F.col("text"), s), lambda w: w["term"]).alias("near")))
    found = durable(found.select("key", "mark", "text", named.alias("base")), "entities")

    # counts are of different texts, so that copies of one text say nothing twice
    each = found.dropDuplicates(["mark"])
    of_term = own.dropDuplicates(["mark"]).select(F.explode(F.array_distinct(F.split(F.lower("text"), NO_WORD))).alias("term")).where(F.length("term") >= 2)
    of_term = durable(of_term.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term") >= SUPPORT), "terms")
    total = float(own.select("mark").distinct().count())
    holds = each.select("mark", F.explode(F.array_distinct(F.transform("base", lambda s: s["entity"]))).alias("entity"))
    of_entity = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), *_signature("of_e")).where(F.col("n_entity") >= SUPPORT)
    holds = durable(holds.join(of_entity, "entity"), "holds")

    # words beside an entity
    pair = F.array_distinct(F.flatten(F.transform("base", lambda s: F.transform(s["near"], lambda w: F.struct(s["entity"].alias("entity"), w.alias("term"))))))
    beside = each.select(F.explode(pair).alias("p")).groupBy("p.entity", "p.term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= SUPPORT)
    beside = _told(beside.join(holds.select("entity", "n_entity").distinct(), "entity").join(of_term, "term"), total).select("entity", "term", "share")

    # words anywhere in a text that holds an entity, if they come in many surroundings and not as part of one passage
    far = _far_words(each.join(holds.groupBy("mark").agg(F.max("n_entity").alias("reach")), "mark"), of_term)
    of_far = far.groupBy("term").agg(F.count_distinct("around").alias("n_around"), F.count(F.lit(1)).alias("n_here"), *_signature("of_t"))
    of_far = of_far.where((F.col("n_around") >= SUPPORT) & (F.col("n_around") >= VARIED * F.col("n_here"))).drop("n_around", "n_here")
    far = durable(far.drop("around").join(of_far, "term"), "far")
    # entities of the same texts are one, and so are words: pairs are of such classes
    sides = holds.select("mark", "of_e", "n_entity").distinct().join(far.select("mark", "of_t", "n_term").distinct(), "mark")
    both = sides.where(F.col("n_term") * KNOWN <= F.col("n_entity")).groupBy("of_e", "of_t", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_both"))
    anywhere = _told(both.where(F.col("n_both") >= SUPPORT), total).select("of_e", "of_t", "share")

    # a word that discloses an entity goes wherever it stands in a text that holds the entity
    has = each.select("mark", F.explode(F.array_distinct(F.split(F.lower("text"), NO_WORD))).alias("term"))
    terms = holds.select("mark", "entity").join(beside, "entity").groupBy("mark", "term").agg(F.max("share").alias("share")).join(has, ["mark", "term"])
    more = holds.select("mark", "of_e").distinct().join(anywhere, "of_e").groupBy("mark", "of_t").agg(F.max("share").alias("share"))
    terms = terms.select("mark", "term", "share").unionByName(more.join(far, ["mark", "of_t"]).select("mark", "term", "share"))
    terms = terms.groupBy("mark", "term").agg(F.max("share").alias("share"))
    terms = terms.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("term", F.col("share") >= REMOVE))).alias("terms"))
    # copies of one text may be very many rows
    terms = terms.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    kind = "array<struct<kind:int,start:int,end:int,value:string,removed:boolean>>"
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(False).alias("removed")))
    places = F.filter(F.transform(matches(F.col("text"), WORD), lambda m: F.struct(F.lit(4).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lower(m["value"]).alias("value"), F.element_at("terms", F.lower(m["value"])).alias("removed"))), lambda m: m["removed"].isNotNull())
    # a word inside an entity is hidden with it
    free = F.filter(places, lambda m: ~F.exists("base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    added = F.when(F.col("terms").isNotNull(), free.cast(kind)).otherwise(F.array().cast(kind))
    found = found.dropDuplicates(["key", "mark"]).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return found.join(terms, ["mark", "salt"], "left").select("key", "mark", F.array_sort(F.concat(base.cast(kind), added)).alias("spans"))


def analyse(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", into: str = "spans") -> DataFrame:
    """Every row of docs with its columns, and `into`: array<struct<kind, start, end, value, removed>> by kind and start
    (kinds count from 0 as in KINDS; the last are words that the method adds; code points, end exclusive).

    Words are weighed beside an entity and, if their surroundings differ, anywhere in a text that holds it; those that
    disclose it are marked wherever they stand in such a text. Null texts count as empty; null ids are documents like others; rows that repeat get the same spans; an
    empty table gives no rows; other columns may have any name but `into`, which is replaced.
    """
    _, key, mark = _keyed(docs, id_col, text_col)
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string,removed:boolean>>")
    rows = docs.drop(into).select(F.struct("*").alias("row"), key.alias("key"), mark.alias("mark"))
    return rows.join(_spans(docs, id_col, text_col), ["key", "mark"], "left").select("row.*", F.coalesce("spans", none).alias(into))


def sanitised(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, whatever their names, with sanitised texts; null texts stay null. The cases of `analyse`."""
    _, key, mark = _keyed(docs, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), mark.alias("mark"))
    found = rows.join(_spans(docs, id_col, text_col), ["key", "mark"], "left")
    text = F.col("row")[text_col].cast("string")
    clean = F.when(F.col("spans").isNotNull(), sanitise(text, F.col("spans"))).otherwise(text)
    return found.select(F.col("row").withField(f"`{text_col}`", clean).alias("row")).select("row.*")


def sanitise(text: Column, spans: Column) -> Column:
    """text with its spans replaced by [EMAIL], [IP], [CARD], [PHONE] and [TERM]; removed words leave nothing. Where spans
    overlap, the one that starts first stands for all."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["removed"].alias("removed"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(a: Column, s: Column) -> Column:
        free = s["start"] >= a["at"]
        put = F.when(s["removed"], "").otherwise(F.get(names, s["kind"]))
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(free, F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), put)).otherwise(a["out"]).alias("out"),
        )

    end = lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text)))
    done = F.aggregate(by_place, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest(analysed: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (as kind:start:end, comma-joined)."""
    names = F.array(*map(F.lit, KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return analysed.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
