"""Texts that need code outside Catalyst: cuts at good places, likeness of strings, file names; Arrow batches only."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.functions import pandas_udf

# Where a text is best cut, in order of preference, and from which share of the limit on.
CUTS = ["\n\n", "\n", ". ", " "]
LEAST_SHARE = 0.6


def cut_points(text: str, limit: int, share: float = LEAST_SHARE) -> list[str]:
    """Pieces of at most `limit` characters, cut after the last good place beyond `share` of the limit, else hard."""
    pieces, start = [], 0
    while len(text) - start > limit:
        window = text[start : start + limit]
        at = next((p + len(c) for c in CUTS if (p := window.rfind(c)) >= limit * share), limit)
        pieces.append(window[:at].rstrip())
        start += at
    pieces.append(text[start:])
    return [p for p in pieces if p]


def pieces(limit: int, share: float = LEAST_SHARE):
    """A column function: the pieces of a text."""

    @pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut_points(t or "", limit, share))

    return cut


@pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp likeness of two lower-cased strings, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)])


@pandas_udf(T.StringType())
def file_name(names: pd.Series) -> pd.Series:
    """A safe file name: compatibility-normalised, words joined by '_', at most 80 characters."""
    return names.map(lambda n: re.sub(r"[^\w.-]+", "_", unicodedata.normalize("NFKC", n or "").strip()).strip("._")[:80] or "file")


def within(lengths, rows_limit: int, chars_limit: int):
    """How many of an array of row lengths are shown: at most rows_limit, then fewer by a tenth (5 at least) until they fit into chars_limit; 1 at least."""
    kept = F.least(F.size(lengths), F.lit(rows_limit))
    total = lambda n: F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0).cast("bigint"), lambda a, x: a + x)
    # a step leaves nine tenths at most, so 80 steps bring 500 rows to one
    return F.aggregate(F.sequence(F.lit(1), F.lit(80)), kept, lambda n, _: F.when((n > 1) & (total(n) > chars_limit), F.greatest(F.lit(1), n - F.greatest(F.lit(5), F.floor(n / 10).cast("int")))).otherwise(n))
