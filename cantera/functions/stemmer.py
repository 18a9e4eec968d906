"""English stemming by the published Porter2 (Snowball English) algorithm, in plain Python."""

from __future__ import annotations

from functools import lru_cache

#: Fixed values of the algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"),
    ("ness", ""), ("ful", ""),
)
STEP_4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic",
)


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1) if r1 < len(w) else len(w)


def _short_end(w: str) -> bool:
    """Whether w ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def _has_vowel(w: str) -> bool:
    return any(c in VOWELS for c in w)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    # Endings of possession and number.
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in UNCHANGED_AFTER_PLURAL:
        return w
    # Past and progressive.
    ending = next((s for s in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(s)), None)
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: -len(ending)] + "ee"
    elif ending and _has_vowel(w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # Derivational endings, longest first.
    for s, new in STEP_2:
        if w.endswith(s):
            base = w[: -len(s)]
            if len(base) >= r1 and (s != "ogi" or base.endswith("l")) and (s != "li" or base[-1:] in LI_ENDINGS):
                w = base + new
            break
    for s, new in STEP_3:
        if w.endswith(s):
            base = w[: -len(s)]
            if len(base) >= r1 and (s != "ative" or len(base) >= r2):
                w = base + new
            break
    for s in STEP_4:
        if w.endswith(s):
            base = w[: -len(s)]
            if len(base) >= r2 and (s != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: The usual English stop words of stemmed search (fixed values); their stems are dropped.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
STOP_STEMS = frozenset(stem(w) for w in STOP_WORDS)
