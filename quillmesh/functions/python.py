"""The few functions that built-ins can't express, as Arrow-batched pandas functions."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = re.compile(r"\s+")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def compact(text: pd.Series) -> pd.Series:
    """Compatibility form (NFKC) without any space."""
    return text.map(lambda x: None if x is None else _SPACE.sub("", unicodedata.normalize("NFKC", x)))


def snippet_of(body: str, terms: list[str], size: int = 120, before: int = 41) -> str:
    """The window around a term that holds most distinct terms; the earliest of several; else the beginning."""
    best = None
    for term in terms:
        at = body.find(term)
        while at >= 0:
            start = max(0, at - before)
            window = body[start : start + size]
            key = (-sum(t in window for t in terms), start)
            if best is None or key < best[0]:
                best = (key, window)
            at = body.find(term, at + len(term))
    return best[1] if best else body[:size]


@F.pandas_udf(T.StringType())
def snippet(body: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else snippet_of(b, list(t)) for b, t in zip(body, terms, strict=True)], dtype=object)


#: What counts as a word of an extracted text, and the covered share from which no closer look is needed.
EVIDENCE_WORD = re.compile("[0-9A-Za-z가-힣]{2,}")
ENOUGH = 0.6


@F.pandas_udf(T.DoubleType())
def covered(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """The share of the expected words, repeats counted, that the other text has; 0 without any word."""
    want, have = (s.map(lambda x: Counter(EVIDENCE_WORD.findall(x))) for s in (expected, actual))
    return pd.Series([(w & h).total() / max(1, w.total()) for w, h in zip(want, have, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def alike(expected: pd.Series, actual: pd.Series, share: pd.Series) -> pd.Series:
    """How far two texts match as sequences of characters; 0 where the share of words says enough."""
    low = share < ENOUGH
    return pd.Series([difflib.SequenceMatcher(None, e, a, autojunk=False).ratio() if x else 0.0 for e, a, x in zip(expected, actual, low, strict=True)], dtype=float)


def similarity(expected: Column, actual: Column) -> Column:
    """1 if nothing is expected or all of it is there as it stands; else the share of words or, where that is low, the better
    of it and the match of characters. White space counts as single spaces."""
    e, a = (F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")) for c in (expected, actual))
    there = (e == "") | a.contains(e)
    share = F.when(there, F.lit(1.0)).otherwise(covered(e, a))
    return F.greatest(share, alike(e, a, share))
