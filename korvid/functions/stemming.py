"""Stemmers for English and Spanish, from the published Snowball descriptions."""

from __future__ import annotations

import re

# -- English (Porter2) ---------------------------------------------------------------------------

_V = "aeiouy"
#: Fixed values of the published algorithm.
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
    "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _after_vowel_pair(word: str, start: int, vowels: str) -> int:
    """The place after the first non-vowel that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _short(word: str, r1: int) -> bool:
    if r1 < len(word):
        return False
    if len(word) == 2:
        return word[0] in _V and word[1] not in _V
    return len(word) > 2 and word[-1] not in _V + "wxY" and word[-2] in _V and word[-3] not in _V


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _V) else c for i, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _after_vowel_pair(w, 0, _V) if r1 is None else r1
    r2 = _after_vowel_pair(w, r1, _V)

    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w.lower()
    # past and participles
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), None)
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in _V for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif _short(w, r1):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # derivational endings
    end = next((e for e in sorted(_STEP2, key=len, reverse=True) if w.endswith(e)), None)
    if end:
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + _STEP2[end]
    elif w.endswith("ogi"):
        if len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
    elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
        w = w[:-2]
    end = next((e for e in sorted(_STEP3, key=len, reverse=True) if w.endswith(e)), None)
    if end:
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + _STEP3[end]
    elif w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    end = next((e for e in _STEP4 if w.endswith(e)), None)
    if end:
        if len(w) - len(end) >= r2:
            w = w[: -len(end)]
    elif w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
        w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1], len(w) - 1 if r1 <= len(w) - 1 else r1):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


# -- Spanish -------------------------------------------------------------------------------------

_ES = "aeiouáéíóúü"
#: Fixed values of the published algorithm.
_PRONOUN = re.compile(r"(?:selas|selos|sela|selo|las|les|los|nos|me|se|la|le|lo)$")
_ES_STEP1 = (
    (("amientos", "imientos", "amiento", "imiento", "anzas", "ismos", "ables", "ibles", "istas", "anza", "icos", "icas", "ismo", "able", "ible", "ista", "osos", "osas", "ico", "ica", "oso", "osa"), "r2"),
    (("adoras", "adores", "aciones", "adora", "ador", "ación", "antes", "ancias", "ante", "ancia"), "ic"),
    (("logías", "logía"), "log"),
    (("uciones", "ución"), "u"),
    (("encias", "encia"), "ente"),
    (("amente",), "amente"),
    (("mente",), "mente"),
    (("idades", "idad"), "idad"),
    (("ivas", "ivos", "iva", "ivo"), "iv"),
)
_ES_Y = ("yeron", "yendo", "yamos", "yais", "yan", "yen", "yas", "yes", "ya", "ye", "yo", "yó")
_ES_GU = ("en", "es", "éis", "emos")
_ES_VERB = tuple(
    """aríamos eríamos iríamos iéramos iésemos aríais aremos eríais eremos iríais iremos ierais ieseis asteis isteis ábamos áramos
    ásemos arían arías aréis erían erías eréis irían irías iréis ieran iesen ieron iendo ieras ieses abais arais aseis íamos arán
    arás aría erán erás ería irán irás iría iera iese aste iste aban aran asen aron ando abas adas idas aras ases íais ados idos
    amos imos ará aré erá eré irá iré aba ada ida ara ase ían ado ido ías áis ía ad ed id an ió ar er ir as ís""".split()
)
_ES_RESIDUAL = ("os", "a", "o", "á", "í", "ó")


def _es_regions(w: str) -> tuple[int, int, int]:
    r1 = _after_vowel_pair(w, 0, _ES)
    r2 = _after_vowel_pair(w, r1, _ES)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in _ES:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in _ES), len(w))
        elif w[0] in _ES:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in _ES), len(w))
        else:
            rv = 3
    return r1, r2, rv


def _plain(w: str) -> str:
    return w.translate(str.maketrans("áéíóú", "aeiou"))


def spanish(word: str) -> str:
    w = word
    r1, r2, rv = _es_regions(w)

    def ends(options, low: int) -> str | None:
        """The longest ending; None if there is none or it begins before the region."""
        found = max((e for e in options if w.endswith(e)), key=len, default=None)
        return found if found is not None and len(w) - len(found) >= low else None

    # pronouns attached to a verb
    m = _PRONOUN.search(w)
    if m and m.start() >= rv:
        stem = w[: m.start()]
        accented = max((e for e in ("iéndo", "ándo", "ár", "ér", "ír") if stem.endswith(e)), key=len, default=None)
        bare = max((e for e in ("iendo", "ando", "ar", "er", "ir") if stem.endswith(e)), key=len, default=None)
        if accented and len(stem) - len(accented) >= rv:
            w = stem[: -len(accented)] + _plain(accented)
        elif bare and len(stem) - len(bare) >= rv:
            w = stem
        elif stem.endswith("uyendo") and len(stem) - 5 >= rv:
            w = stem
    before = w
    # standard endings
    everything = {e: what for group, what in _ES_STEP1 for e in group}
    end = max((e for e in everything if w.endswith(e)), key=len, default=None)
    if end:
        what, at = everything[end], len(w) - len(end)
        if what == "amente":
            if at >= r1:
                w = w[:at]
                if w.endswith("iv") and len(w) - 2 >= r2:
                    w = w[:-2]
                    if w.endswith("at") and len(w) - 2 >= r2:
                        w = w[:-2]
                elif w.endswith(("os", "ic", "ad")) and len(w) - 2 >= r2:
                    w = w[:-2]
        elif at >= r2:
            w = w[:at]
            if what in ("log", "u", "ente"):
                w += what
            elif what == "ic" and w.endswith("ic") and len(w) - 2 >= r2:
                w = w[:-2]
            elif what == "mente":
                tail = next((e for e in ("ante", "able", "ible") if w.endswith(e)), None)
                if tail and len(w) - 4 >= r2:
                    w = w[:-4]
            elif what == "idad":
                tail = next((e for e in ("abil", "ic", "iv") if w.endswith(e)), None)
                if tail and len(w) - len(tail) >= r2:
                    w = w[: -len(tail)]
            elif what == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
    # verbs
    if w == before:
        end = ends([e for e in _ES_Y if len(w) - len(e) >= rv], rv)
        if end and w[-len(end) - 1 : -len(end)] == "u":
            w = w[: -len(end)]
        else:
            end = ends([e for e in (*_ES_VERB, *_ES_GU) if len(w) - len(e) >= rv], rv)
            if end:
                w = w[: -len(end)]
                if end in _ES_GU and w.endswith("gu"):
                    w = w[:-1]
    # what is left
    end = ends([e for e in _ES_RESIDUAL if len(w) - len(e) >= rv], rv)
    if end:
        w = w[: -len(end)]
    elif w[-1:] in ("e", "é") and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return _plain(w)


STEMMERS = {"english": english, "spanish": spanish}
