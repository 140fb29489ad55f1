"""English stems: the published Porter2 rules, on lower-case words."""

from __future__ import annotations

from functools import lru_cache

from xylem.functions.values import StaticError

VOWELS = set("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the algorithm.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def after_vowel_consonant(w: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel."""
    for k in range(start + 1, len(w)):
        if w[k] not in VOWELS and w[k - 1] in VOWELS:
            return k + 1
    return len(w)


def ends_short(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS and w[-1] not in "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


@lru_cache(1 << 17)
def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = "".join("Y" if c == "y" and (k == 0 or word[k - 1] in VOWELS and (k < 2 or word[k - 1] != "y")) else c for k, c in enumerate(word))
    one = next((len(x) for x in ("gener", "commun", "arsen") if w.startswith(x)), after_vowel_consonant(w, 0))
    two = after_vowel_consonant(w, one)
    has_vowel = lambda x: any(c in VOWELS for c in x)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in FINAL:
        return w
    if w.endswith(("eed", "eedly")):
        stop = len(w) - (3 if w.endswith("eed") else 5)
        w = w[:stop] + "ee" if stop >= one else w
    else:
        end = next((x for x in ("ingly", "edly", "ing", "ed") if w.endswith(x)), None)
        if end and has_vowel(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif ends_short(w) and one >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    end = next((x for x in sorted(STEP_2, key=len, reverse=True) if w.endswith(x)), None)
    if end and len(w) - len(end) >= one:
        head = w[: -len(end)]
        if end == "ogi":
            w = head + "og" if head.endswith("l") else w
        elif end == "li":
            w = head if head and head[-1] in "cdeghkmnrt" else w
        else:
            w = head + STEP_2[end]
    end = next((x for x in sorted(STEP_3, key=len, reverse=True) if w.endswith(x)), None)
    if end and len(w) - len(end) >= one and (end != "ative" or len(w) - len(end) >= two):
        w = w[: -len(end)] + STEP_3[end]
    end = next((x for x in STEP_4 if w.endswith(x)), None)
    if end and len(w) - len(end) >= two and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        at = len(w) - 1
        if at >= two or at >= one and not ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= two:
        w = w[:-1]
    return w.lower()


STEMMERS = {"en": english, "english": english}


def stemmer(language: str):
    """The stem function of a language."""
    if language not in STEMMERS:
        raise StaticError("SE3022", f"no stemming for {language!r}; there is {', '.join(sorted(STEMMERS))}")
    return STEMMERS[language]
