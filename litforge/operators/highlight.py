"""Where a snippet stands in a text: an exact find, else the window with most words in common."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\S+")


def find_snippet(text: str | None, snippet: str | None, least: float = 0.5) -> tuple[int, int] | None:
    """Byte range in the text's UTF-8 form, None if no window shares at least half of the words."""
    if not text or not snippet or not snippet.strip():
        return None
    spots = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
    wanted = [w.lower() for w in snippet.split()]
    joined = " ".join(w for _, _, w in spots)
    at = joined.find(" ".join(wanted))
    if at >= 0:
        first = joined[:at].count(" ")
        skip = at - (joined.rfind(" ", 0, at) + 1)
        last = first + joined[at : at + len(" ".join(wanted))].count(" ")
        tail = at + len(" ".join(wanted))
        left = spots[first][0] + skip
        right = spots[last][0] + tail - (joined.rfind(" ", 0, tail) + 1) if last > first or skip else spots[last][0] + len(wanted[-1])
    else:
        n, words, best, place = min(len(wanted), len(spots)), set(wanted), 0.0, None
        for i in range(len(spots) - n + 1):
            share = len(words & {w for _, _, w in spots[i : i + n]}) / len(words)
            if share > best:
                best, place = share, i
        if place is None or best < least:
            return None
        left, right = spots[place][0], spots[place + n - 1][1]
    return len(text[:left].encode()), len(text[:right].encode())


def snippet_range(text: Column, snippet: Column) -> Column:
    """Struct of the byte range, null fields where nothing is found."""

    def run(texts: pd.Series, snippets: pd.Series) -> pd.DataFrame:
        found = [find_snippet(t, s) or (None, None) for t, s in zip(texts, snippets, strict=True)]
        return pd.DataFrame(found, columns=["start", "end"]).astype("Int64")

    return F.pandas_udf(run, "start long, end long")(text, snippet)
