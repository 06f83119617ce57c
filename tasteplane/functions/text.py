"""Title normalisation and trigram similarity as column expressions.

``normalize`` is exact for every text: texts in printable ASCII stay in the JVM; the rest go through
an Arrow UDF for the two steps Spark has no function for (compatibility composition and case folding).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: dash-like signs, numerals, words without weight, variant threshold
DASHES = "‐‑‒–—―−－"
NUMERALS = {
    "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10",
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}
LIGHT_WORDS = ("the", "a", "an", "of", "and", "or", "in", "on", "at", "to", "for", "part", "vol", "volume")
SPELLING_VARIANT = 0.4
EXACT_TITLE = 0.999


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).translate({ord(d): "-" for d in DASHES}).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def _casefolded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t.strip().casefold(), na_action="ignore")


def folded(name: Column) -> Column:
    """Trimmed and case-folded; texts in printable ASCII stay in the JVM."""
    return F.when(name.rlike(r"^[\x20-\x7e]*$"), F.lower(F.trim(name))).otherwise(_casefolded(name))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used (inside other lambdas, too)."""
    return F.get(F.transform(F.array(value), then), 0)


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_ascii(title: Column) -> Column:
    """For texts known to be ASCII (plus dashes): no Python."""
    return _collapsed(F.lower(F.translate(title, DASHES, "-" * len(DASHES))))


def normalize(title: Column) -> Column:
    return F.when(title.rlike(r"^[\x20-\x7e]*$"), normalize_ascii(title)).otherwise(_collapsed(_folded(title)))


def loose(normal: Column) -> Column:
    """Signs other than letters, digits and underscores become spaces; takes normalised text."""
    return _collapsed(F.regexp_replace(normal, r"(?U)[^\w\s]", " "))


def without_article(normal: Column) -> Column:
    return F.regexp_replace(normal, "^(the|a|an) ", "")


def comparison_forms(normal: Column) -> Column:
    """Distinct non-empty ways to write a normalised title, the plainest first."""
    plain = loose(normal)
    return F.array_distinct(F.filter(F.array(normal, plain, without_article(normal), without_article(plain)), lambda f: f != ""))


def tokens(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _numeral(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$") | token.isin(*NUMERALS)


def markers(toks: Column) -> Column:
    """Distinct numerals of a token list, roman numerals and number words as digits, sorted."""
    names = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(F.filter(toks, _numeral), lambda t: F.coalesce(F.try_element_at(names, t), t))))


def heavy_words(toks: Column) -> Column:
    return F.array_distinct(F.filter(toks, lambda t: ~t.isin(*LIGHT_WORDS) & ~_numeral(t)))


def trigrams(text: Column) -> Column:
    """Distinct three-grams of each word, padded by two spaces before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def titles_distinct(query: Column, candidate: Column) -> Column:
    """Whether two normalised titles that score alike name different films (asymmetric)."""
    qt, ct = tokens(query), tokens(candidate)
    qm, cm = markers(qt), markers(ct)
    other_part = (F.size(F.array_except(qm, cm)) > 0) | ((F.size(qm) > 0) & (F.size(cm) > 0) & (qm != cm))
    reordered = (qt != ct) & (F.array_sort(qt) == F.array_sort(ct))
    cw = heavy_words(ct)
    # words that the candidate lacks, and the grams of those it has
    words = F.struct(F.transform(F.array_except(heavy_words(qt), cw), trigrams).alias("lacking"), F.transform(cw, trigrams).alias("held"))
    lacking = _let(words, lambda x: F.exists(x["lacking"], lambda w: ~F.exists(x["held"], lambda o: jaccard(w, o) >= SPELLING_VARIANT)))
    return other_part | reordered | lacking


def best_similarity(query: Column, titles: Column) -> Column:
    """Best similarity of any form of a normalised query with any form of normalised titles; 0 if there is none."""
    forms = F.struct(F.transform(comparison_forms(query), trigrams).alias("q"), F.transform(F.flatten(F.transform(titles, comparison_forms)), trigrams).alias("c"))
    best = _let(forms, lambda x: F.array_max(F.transform(x["q"], lambda q: F.array_max(F.transform(x["c"], lambda c: jaccard(q, c))))))
    return F.coalesce(best, F.lit(0.0))
