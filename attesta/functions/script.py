"""Sanskrit between Latin letters (IAST, with the colon of ISO 15919) and Devanagari, as Column expressions.

A consonant carries an inherent a that a vowel sign replaces and a virama removes. That state is written into the text
as a mark behind the consonant, so that every rule is a plain replacement, longer letters first, and all of it runs in
generated code over bytes instead of once for each character.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# The letters of the scheme. Vowels have an independent form and a sign after consonants.
VOWELS = (
    ("a", "अ", ""), ("ā", "आ", "ा"), ("i", "इ", "ि"), ("ī", "ई", "ी"), ("u", "उ", "ु"), ("ū", "ऊ", "ू"), ("ṛ", "ऋ", "ृ"), ("ṝ", "ॠ", "ॄ"),
    ("ḷ", "ऌ", "ॢ"), ("ḹ", "ॡ", "ॣ"), ("e", "ए", "े"), ("ai", "ऐ", "ै"), ("o", "ओ", "ो"), ("au", "औ", "ौ"),
)
CONSONANTS = (
    ("k", "क"), ("kh", "ख"), ("g", "ग"), ("gh", "घ"), ("ṅ", "ङ"), ("c", "च"), ("ch", "छ"), ("j", "ज"), ("jh", "झ"), ("ñ", "ञ"),
    ("ṭ", "ट"), ("ṭh", "ठ"), ("ḍ", "ड"), ("ḍh", "ढ"), ("ṇ", "ण"), ("t", "त"), ("th", "थ"), ("d", "द"), ("dh", "ध"), ("n", "न"),
    ("p", "प"), ("ph", "फ"), ("b", "ब"), ("bh", "भ"), ("m", "म"), ("y", "य"), ("r", "र"), ("l", "ल"), ("v", "व"), ("ś", "श"), ("ṣ", "ष"), ("s", "स"), ("h", "ह"),
)
SIGNS = (("ṃ", "ं"), ("ḥ", "ः"), ("m̐", "ँ"), ("'", "ऽ"), ("||", "॥"), ("|", "।"), *zip("0123456789", "०१२३४५६७८९"))
VIRAMA = "्"
#: Between letters that would else be read as one: k:h, a:i.
APART = ":"
ASPIRATED = tuple(c for c, _ in CONSONANTS if f"{c}h" in dict(CONSONANTS))


def _forms(letter: str) -> dict[str, None]:
    """A letter composed, decomposed and half so."""
    parts = unicodedata.normalize("NFD", letter)
    return dict.fromkeys([letter, parts, *(unicodedata.normalize("NFC", parts[:i]) + parts[i:] for i in range(1, len(parts)))])


#: Behind a consonant whose vowel is still open, and behind an independent a.
OPEN, AFTER_A = "\ue000", "\ue001"


def _replaced(text: Column, pairs: dict[str, str]) -> Column:
    for a in sorted(pairs, key=len, reverse=True):
        text = F.replace(text, F.lit(a), F.lit(pairs[a]))
    return text


def to_devanagari(text: Column) -> Column:
    """Devanagari of IAST, in any case, composed or not. Letters beyond the scheme, spaces and signs stay as they are;
    : between a stop and h, or a and i or u, keeps them apart, and so does a diaeresis on i or u."""
    vowels = (*VOWELS, ("ï", "इ", "ि"), ("ü", "उ", "ु"))
    letters = dict(CONSONANTS)
    candra, rest = {a: b for a, b in SIGNS if a == "m̐"}, {a: b for a, b in SIGNS if a != "m̐"}
    x = _replaced(F.lower(text), {form: a for a in (*[v[0] for v in vowels], *letters, *rest) for form in _forms(a) if form != a})
    x = _replaced(x, {f"a{APART}i": "aï", f"a{APART}u": "aü", **candra})
    x = _replaced(x, {a: f"{b}{OPEN}" for a, b in letters.items()})
    x = _replaced(x, {f"{letters[a]}{OPEN}{APART}ह": f"{letters[a]}{OPEN}ह" for a in ASPIRATED})
    x = _replaced(x, {f"{OPEN}{a}": sign for a, _, sign in vowels})
    return _replaced(_replaced(x, {a: b for a, b, _ in vowels}), {OPEN: VIRAMA, **rest})


def to_iast(text: Column) -> Column:
    """IAST of Devanagari, composed; other characters stay as they are."""
    x = _replaced(text, {b: f"{a}a{OPEN}" for a, b in CONSONANTS} | {"अ": f"a{AFTER_A}"})
    x = _replaced(x, {f"{c}a{OPEN}{VIRAMA}h": f"{c}{APART}h" for c in ASPIRATED})
    x = _replaced(x, {f"a{OPEN}{s}": a for a, _, s in VOWELS if s} | {f"a{OPEN}{VIRAMA}": ""})
    x = _replaced(x, {f"{mark}{b}": f"{APART}{a}" for mark in (OPEN, AFTER_A) for a, b, _ in VOWELS if a in "iu"})
    x = _replaced(x, {b: a for a, b, _ in VOWELS} | {s: a for a, _, s in VOWELS if s} | {b: a for a, b in SIGNS})
    return _replaced(x, {OPEN: "", AFTER_A: "", VIRAMA: ""})
