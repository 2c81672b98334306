"""Text analysis: tokens, stop words, stems. The rules are plain functions; the columns run them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from korvid.functions.stemming import STEMMERS

#: A term's longest length in UTF-8 bytes.
LONGEST = 255
_ACCENTS = str.maketrans("áéíóúü", "aeiouu")
_L, _A = r"[^\W\d_]", r"[^\W_]"
_TOKEN = re.compile(rf"(?P<acronym>(?<!{_A}){_L}(?:\.{_L})+(?!{_A})\.?)|(?P<decimal>\d+(?:[.,]\d+)+)|(?P<word>{_A}+(?:'{_A}+)*)")
#: The same for Spark's regular expressions, words only.
WORDS = r"[\p{L}\p{N}]+"


def tokenize(text: str) -> list[str]:
    """Acronyms lose their dots, decimals get a point, words keep inner apostrophes."""
    text = unicodedata.normalize("NFC", text or "").lower().replace("’", "'")
    out = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "acronym":
            out.append(m[0].replace(".", ""))
        elif m.lastgroup == "decimal":
            out.append(m[0].replace(",", "."))
        else:
            out.append(m[0])
    return out


_WORD = re.compile(_A + "+")


def simple_words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, as `tokens` finds them in the JVM."""
    return _WORD.findall(text.lower())


def plain(token: str) -> str:
    """Without accents; ñ stays."""
    return token.translate(_ACCENTS)


def stop_words(language: str | None) -> frozenset[str]:
    """The language's stop words as Spark ships them, without accents; needs a running session."""
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(plain(w) for w in StopWordsRemover.loadDefaultStopWords(language)) if language in STEMMERS else frozenset()


def analyse(text: str, language: str | None, stops: frozenset[str], known: dict[str, str] | None = None) -> list[str]:
    """Tokens without stop words, stemmed and without accents; with no language the bare tokens.

    known: stems found before, to stem each distinct token once.
    """
    if language is None:
        return tokenize(text)
    stem, known = STEMMERS[language], {} if known is None else known
    out = []
    for t in tokenize(text):
        if plain(t) not in stops:
            if t not in known:
                known[t] = plain(stem(t))
            out.append(known[t])
    return out


def tokens(text: Column) -> Column:
    """array<string>: the simple analysis, in the JVM: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORDS})"), F.lit(1))


def analysed(text: Column, language: str, spark: SparkSession) -> Column:
    """array<string>: the full analysis, batch by batch."""
    stops = stop_words(language)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return texts.map(lambda t: analyse(t, language, stops, known) if t is not None else [])

    return run(text)


#: Letters with the accents of Western European languages, and the letters without them.
ACCENTED, BARE = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def without_accents(text: Column) -> Column:
    """Lower-cased, without accents, composed or not."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}", ""), ACCENTED, BARE)


def evaluated(expression: Column):
    """The value of an expression without columns."""
    return SparkSession.getActiveSession().range(1).select(expression).first()[0]
