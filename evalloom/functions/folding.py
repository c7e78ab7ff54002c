"""Normal forms that need Unicode decomposition, which the engine lacks: Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ARTICLES = re.compile(r"\b(?:a|an|the)\b")
# Words that answers are compared without.
_STOP = frozenset("the a an of in on at to and is was for by it its as with from that".split())


def _ascii(text: str | None) -> str:
    return unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()


def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(re.sub(r"[^a-z0-9]+", " ", _ARTICLES.sub(" ", _ascii(t))).split()))


def _folded_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(w for w in re.sub(r"[^a-z0-9]+", " ", _ascii(t)).split() if w not in _STOP))


def _trimmed(texts: pd.Series, budgets: pd.Series) -> pd.Series:
    token = re.compile(r"[A-Za-z]{1,6}|\d{1,3}|[^\sA-Za-z\d]")

    def one(text, budget):
        used, end = 0, 0
        for m in re.finditer(r"\S+", text or ""):
            used += len(token.findall(m[0]))
            if used > budget:
                break
            end = m.end()
        return (text or "")[:end]

    return pd.Series([one(t, b) for t, b in zip(texts, budgets, strict=True)])


def folded(text) -> Column:
    """ASCII letters and digits, lower case, without articles; accents are dropped, not the letters under them."""
    return F.pandas_udf(_folded, "string")(text)


def folded_words(text) -> Column:
    """As folded, without stop words; repeated words stay."""
    return F.pandas_udf(_folded_words, "string")(text)


def trimmed(text, budget) -> Column:
    """The longest beginning of whole words within a budget of tokens."""
    return F.pandas_udf(_trimmed, "string")(text, budget)
