import random
import unicodedata

from pyspark.sql import functions as F

from attesta.functions import script


def both_ways(spark, texts):
    own = spark.createDataFrame([(t,) for t in texts], "t string")
    return [tuple(r) for r in own.select("t", script.to_devanagari(F.col("t")), script.to_iast(script.to_devanagari(F.col("t"))), script.to_iast(F.col("t")), script.to_devanagari(script.to_iast(F.col("t")))).collect()]


def plain(text):
    """One character class after the other, as a machine with a state: whether a consonant waits for its vowel."""
    text = unicodedata.normalize("NFC", text.lower())
    vowels = {a: (b, c) for a, b, c in script.VOWELS} | {"ï": ("इ", "ि"), "ü": ("उ", "ु")}
    consonants, signs = dict(script.CONSONANTS), dict(script.SIGNS)
    out, waits, i, before = "", False, 0, ""
    while i < len(text):
        x = next(k for n in (2, 1) if (k := text[i : i + n]) in vowels or k in consonants or k in signs or n == 1)
        after = text[i + 1 : i + 2]
        if x == ":" and (before in script.ASPIRATED and after == "h" or before == "a" and after in ("i", "u") and text[i + 1 : i + 3] not in vowels):
            i += 1
            continue
        if x in vowels:
            out, waits = out + vowels[x][waits], False
        else:
            out += (script.VIRAMA if waits else "") + consonants.get(x, signs.get(x, x))
            waits = x in consonants
        before = x
        i += len(x)
    return out + (script.VIRAMA if waits else "")


def test_known_words(spark):
    known = {
        "dharmakṣetre kurukṣetre": "धर्मक्षेत्रे कुरुक्षेत्रे", "oṃ namaḥ śivāya |": "ओं नमः शिवाय ।", "prauga": "प्रौग", "pra:uga": "प्रउग", "tat tvam asi ||12||": "तत् त्वम् असि ॥१२॥",
        "'pi": "ऽपि", "vāk:hariḥ": "वाक्हरिः", "ṝkāraḥ ḷ": "ॠकारः ऌ", "": "", "f q x": "f q x",
    }
    for t, got, back, _, _ in both_ways(spark, known):
        assert got == known[t] and back == t, (t, got, back)
    mixed = both_ways(spark, ["DharMa", unicodedata.normalize("NFD", "ṝṣi śāstra"), "naï", None])
    assert [r[1] for r in mixed] == ["धर्म", "ॠषि शास्त्र", "नइ", None]


def test_against_a_machine(spark):
    r = random.Random(1)
    letters = [a for a, _, _ in script.VOWELS] + [a for a, _ in script.CONSONANTS] + [a for a, _ in script.SIGNS if a != "m̐"] + [":", " ", "z", "-", "ï", "ü", "é", "\n"]
    texts = ["".join(r.choices(letters, k=r.randrange(1, 40))) for _ in range(300)]
    for t, got, *_ in both_ways(spark, texts):
        assert got == plain(t), t


def test_round_trip_of_devanagari(spark):
    """Every cluster of two consonants, every hiatus, and random words come back as they were."""
    r = random.Random(2)
    c, v = [b for _, b in script.CONSONANTS], [(b, s) for _, b, s in script.VOWELS]
    words = [x + script.VIRAMA + y for x in c for y in c] + [a + b for a, _ in v for b, _ in v] + [x + s + b for x in c[:5] for _, s in v for b, _ in v]
    syllable = lambda: script.VIRAMA.join(r.choices(c, k=r.choice((1, 1, 2, 3)))) + r.choice(v)[1] + r.choice(("", "", "ं", "ः"))
    words += ["".join(syllable() for _ in range(r.randrange(1, 6))) + r.choice(("", " ।", " ॥१०॥", c[0] + script.VIRAMA)) for _ in range(300)]
    for t, _, _, iast, back in both_ways(spark, words):
        assert back == t, (t, iast, back)
