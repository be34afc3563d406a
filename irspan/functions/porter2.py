"""The Snowball English stemmer (Porter2), from its published description."""

from __future__ import annotations

import re

# The word and suffix lists of the published algorithm.
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_INVARIANT_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
_LI_ENDINGS = frozenset("cdeghkmnrt")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_VOWEL = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _after(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _has_vowel(text: str) -> bool:
    return any(c in _VOWEL for c in text)


def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.removeprefix("'")
    # A y at the start or behind a vowel is a consonant, written Y.
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWEL) else c for i, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _after(w, 0)
    r2 = _after(w, r1)

    w = w[: len(w) - len(_longest(w, ("'", "'s", "'s'")))]

    found = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if found == "sses":
        w = w[:-2]
    elif found in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif found == "s" and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in _INVARIANT_1A:
        return w

    found = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if found in ("eed", "eedly"):
        if len(w) - len(found) >= r1:
            w = w[: len(w) - len(found)] + "ee"
    elif found and _has_vowel(w[: len(w) - len(found)]):
        w = w[: len(w) - len(found)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"

    found = _longest(w, (*_STEP2, "ogi", "li"))
    if found and len(w) - len(found) >= r1:
        base = w[: len(w) - len(found)]
        if found == "ogi":
            w = w[:-1] if base.endswith("l") else w
        elif found == "li":
            w = base if base[-1:] in _LI_ENDINGS else w
        else:
            w = base + _STEP2[found]

    found = _longest(w, (*_STEP3, "ative"))
    if found and len(w) - len(found) >= r1:
        base = w[: len(w) - len(found)]
        if found == "ative":
            w = base if len(base) >= r2 else w
        else:
            w = base + _STEP3[found]

    found = _longest(w, (*_STEP4, "ion"))
    if found and len(w) - len(found) >= r2:
        base = w[: len(w) - len(found)]
        if found != "ion" or base[-1:] in ("s", "t"):
            w = base

    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
