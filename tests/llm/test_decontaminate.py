import random
from collections import Counter, defaultdict

import regex

from attesta.llm import decontaminate
from tests.llm.conftest import prose


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(docs, spark, rows, items, **more):
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs(rows), bench(spark, items), **more).collect()}


TOKEN = regex.compile(r"[0-9]++(?:[.,:][0-9]++)*+|[\p{L}\p{M}]++[.!?]?+|%")
W = decontaminate.WINDOW


def plain_template(text, cased):
    """(template words, values) by one loop over the tokens."""
    raw, out = TOKEN.findall(text or ""), []
    words = [w.rstrip(".!?") for w in raw]
    for i, w in enumerate(words):
        low = w.lower()
        digits = low[0].isdigit()
        number = digits or low in decontaminate.NUMBER_WORDS
        before = words[i - 1].lower() if i else ""
        after_number = before[:1].isdigit() or before in decontaminate.NUMBER_WORDS
        code = "§d" if number else "§u" if low in decontaminate.UNITS and after_number else "§n" if cased and low != w else low
        if out and code == out[-1][0] and raw[i - 1] == words[i - 1] and (code == "§n" or code == "§d" and not digits and not out[-1][1][0].isdigit()):
            out.pop()
        out.append((code, low))
    return [c for c, _ in out], [v for _, v in out]


def plain(text, item):
    """(windows, found, slots, consistent) of the best template and offset, or None."""
    best = None
    for cased in (False, True):
        ours, our_values = plain_template(text, cased)
        theirs, their_values = plain_template(item, cased)
        at = defaultdict(list)
        for p in range(len(theirs) - W + 1):
            w = tuple(theirs[p : p + W])
            if sum(x[0] != "§" for x in w) >= 2:
                at[w].append(p)
        hits = [(p, q, tuple(ours[q : q + W])) for q in range(len(ours) - W + 1) for p in at.get(tuple(ours[q : q + W]), ())]
        spread = max(4, len(theirs) // 4)
        for side in (0, 1):
            places = defaultdict(list)
            for p, q, w in hits:
                places[(q - p + side * spread) // (2 * spread)].append((p, q, w))
            for own in places.values():
                n = len({w for _, _, w in own})
                first, last = min(own), max(own)
                n += first[0] == 1 and first[1] > 0 and our_values[first[1] - 1].endswith(their_values[0])
                n += last[0] == len(theirs) - W - 1 and last[1] + W < len(ours) and our_values[last[1] + W].startswith(their_values[-1])
                n = min(n, len(at))
                if n < decontaminate.COVER * len(at):
                    continue
                counts = Counter(q - p for p, q, _ in own)
                usual = min(counts, key=lambda d: (-counts[d], d))
                pairs = defaultdict(set)
                for i, slot in enumerate(theirs):
                    d = [q - p for p, q, _ in own if p <= i < p + W]
                    if slot in decontaminate.SLOTS and d:
                        pairs[slot, their_values[i]].add(our_values[i + min(d, key=lambda x: (abs(x - usual), x))])
                one = sum(len(v) == 1 for v in pairs.values())
                if one >= decontaminate.CONSISTENT * len(pairs):
                    row = (n / len(at), one / max(len(pairs), 1), cased, len(pairs), (len(at), n, len(pairs), one))
                    best = max(best or row, row)
    return best and best[-1]


NAMES = ["Tom", "Mary", "Anna Lee", "Karl", "Zoë", "Ben"]


def question(r):
    """A question over names, numbers and units, as a function of its values."""
    parts = [prose(r.randrange(2, 6), r.random()) for _ in range(8)]
    unit = r.choice(["kg", " dollars", " percent", ""])

    def say(a, b, n, m, word=str):
        return f"{a} {parts[0]} {word(n)}{unit} {parts[1]} {b} {parts[2]} {word(m)}{unit} {parts[3]}. {b} {parts[4]} {word(n)} {parts[5]} {a} {parts[6]}, {parts[7]}?"

    return say


def test_leaks_against_brute_force(spark, docs):
    r = random.Random(1)
    asked = [question(r) for _ in range(8)]
    items = [(i, q("Tom", "Mary", 12, 5)) for i, q in enumerate(asked)]
    rows = []
    for i in range(220):
        q = r.choice(asked)
        a, b, c = r.sample(NAMES, 3)
        text = r.choice([q("Tom", "Mary", 12, 5), q(a, b, r.randrange(6, 99), 4), q(a, b, 7, 7).replace(b, c, 1), q(a, b, 31, 8).lower()])
        words = text.split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            k = r.randrange(len(words))
            words[k : k + r.choice([0, 1])] = [prose(1, r.random())]
        text = r.choice(["", "x", prose(3, i) + " "]) + " ".join(words) + r.choice(["", "y", " " + prose(5, i)])
        rows.append((i, r.choice([str, str.lower, str.upper])(text) if r.random() < 0.4 else text))
    want = {(i, j): got for i, t in rows for j, item in items if (got := plain(t, item))}
    got = {k: (v["n_windows"], v["n_found"], v["n_slots"], v["n_consistent"]) for k, v in found(docs, spark, rows, items).items()}
    assert got == want
    assert 60 < len(want) < 200


def test_long_runs(spark, docs):
    """Very many capitals, numbers, and numbers joined by signs end, and are linear."""
    n = 200_000
    item = (1, prose(25, 5))
    rows = [(1, "Aa " * n), (2, "Aa" * n), (3, "7 " * n), (4, "7," * n), (5, "7 kg " * n), (6, "twenty " * n), (7, "Aa 7 " * n + item[1]), (8, ("7," * n) + " " + item[1].upper())]
    assert set(found(docs, spark, rows, [item, (2, "Tom has 12 apples and gives 5 of them to Mary")])) == {(7, 1), (8, 1)}


def test_other_cases_and_number_words(spark, docs):
    item = "Tom has 12 apples and gives 5 apples to Mary. Mary buys 20 more at the shop. How many apples does Tom have now?"
    words = item.replace("12", "twelve").replace(" 5 ", " five ").replace("20", "Twenty-two")
    rows = [(1, item), (2, item.lower()), (3, item.upper()), (4, words), (5, words.lower()), (6, prose(30, 1) + " " + item.upper() + " " + prose(30, 2)), (7, item.lower().replace("12", "40").replace(" 5 ", " 9 ")), (8, item.lower().replace("tom", "anna", 1)), (9, item.title())]
    got = found(docs, spark, rows, [(1, item)])
    assert set(got) == {(i, 1) for i in range(1, 10)}
    assert all(r["n_slots"] == r["n_consistent"] > 0 for r in got.values())


def test_windows_must_stand_together(spark, docs):
    words = prose(40, 3).split(" ")
    pieces = [" ".join(words[i : i + 9]) for i in range(0, 36, 4)]  # all windows, but each piece far from the next
    rows = [(1, " ".join(f"{p} {prose(60, 100 + i)}" for i, p in enumerate(pieces))), (2, prose(500, 9) + " " + " ".join(words) + " " + prose(500, 10)), (3, " ".join(words[:20] + ["so", "to", "say"] + words[20:]))]
    assert set(found(docs, spark, rows, [(1, " ".join(words))])) == {(2, 1), (3, 1)}


def test_item_after_a_like_phrase(spark, docs):
    """Slots are compared at the passage's own offset, not where a window stands first."""
    say = lambda a, n, m: f"After {a} pays {n} dollars for the red bag and {m} dollars for the hat how much money does {a} have at the end of that day"
    rows = [(1, f"Before that, tell us how much money does Karl have at the end of that day and {prose(20, 1)}. " + say("Anna", 9, 8)), (2, say("Anna", 9, 8) + " " + prose(9, 2) + ". " + say("Karl", 4, 3))]
    rows.append((3, say("Anna", 9, 8).replace("does Anna", "does Karl").replace("9 dollars", "9 euros")))
    assert set(found(docs, spark, rows, [(1, say("Tom", 5, 7))])) == {(1, 1), (2, 1)}


def test_cover_of_short_items(spark, docs):
    """Of five windows four are needed, unless what touches the passage ends and begins as the item does."""
    words = prose(9, 4).split(" ")
    text = " ".join(words)
    rows = [(1, f"x{text}y"), (2, " ".join(["zz", *words[1:8], "zz"])), (3, " ".join([*words[:8], "zz"])), (4, f"q{text}"), (5, text.replace(words[4], "zz"))]
    assert set(found(docs, spark, rows, [(1, text)])) == {(1, 1), (3, 1), (4, 1)}


def test_clean_keeps_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    names = ("_key", "_mark", "words", "said", "cased", "whole", "item_id", "at", "q")
    own = docs([(1, prose(30, 1)), (2, prose(30, 2)), (None, prose(30, 2)), (3, None)]).withColumns({c: F.lit("x") for c in names})
    kept = decontaminate.clean(own, bench(spark, [(1, prose(30, 2))]))
    assert sorted((r["doc_id"], r["_key"]) for r in kept.collect()) == [(1, "x"), (3, "x")] and kept.columns == own.columns
