"""Text in columns: normal forms, keys, fallbacks."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"[\s ]+", " "))


def optional(text: Column | str) -> Column:
    """Trimmed, with null for empty."""
    return F.nullif(F.trim(_col(text)), F.lit(""))


def suggestion_key(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.trim(_col(text)), r"\s+", ""))


def display_name(merchant: Column | str, description: Column | str, fallback: Column | str) -> Column:
    """First of these that is neither null nor empty."""
    return F.coalesce(F.nullif(_col(merchant), F.lit("")), F.nullif(_col(description), F.lit("")), _col(fallback))


def join_tokens(tokens: Column | str) -> Column:
    """Tokens joined, with a space only between ASCII letters or digits."""
    alnum = r"[A-Za-z0-9]"

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(F.right(acc, F.lit(1)).rlike(alnum) & F.left(x, F.lit(1)).rlike(alnum), F.lit(" ")).otherwise(F.lit(""))
        return F.concat(acc, gap, x)

    return F.aggregate(_col(tokens), F.lit(""), step)


def _match_keys(text: pd.Series) -> pd.Series:
    return text.map(lambda s: "".join(c for c in unicodedata.normalize("NFKC", s).casefold() if c.isalnum()), na_action="ignore")


def match_key(text: Column | str) -> Column:
    """NFKC, case-folded, letters and digits only. Apply it to distinct strings."""
    return F.pandas_udf(_match_keys, "string")(text)


#: Keys of up to so many characters are measured all at once, a step for each character; longer ones one by one.
_AT_ONCE = 48


def _one_similarity(x: str, y: str) -> float:
    if not x or not y:
        return 0.0
    return 1.0 if x in y or y in x else SequenceMatcher(None, x, y, autojunk=False).ratio()


def _characters(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each text, and the lengths."""
    found = np.array(texts.to_list(), dtype="U")
    return found.view(np.uint32).reshape(len(found), -1).astype(np.int32), texts.str.len().to_numpy(dtype=np.int32)


def _ratios(a: pd.Series, b: pd.Series) -> np.ndarray:
    """``_one_similarity`` of short keys that are not empty. As SequenceMatcher does, takes the longest match (the first in a, then in b)
    and goes on with what lies on its left and on its right, here for all pairs at once."""
    (x, n_x), (y, n_y) = _characters(a), _characters(b)
    matched, whole = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    zero = np.zeros(len(x), dtype=np.int32)
    parts, first = (np.arange(len(x)), zero, n_x, zero, n_y), True
    while len(parts[0]):
        pair, x_from, x_to, y_from, y_to = parts
        x_at, y_at = np.arange(x_to.max()), np.arange(y_to.max())
        left = np.where((x_at >= x_from[:, None]) & (x_at < x_to[:, None]), x[pair, : len(x_at)], -1)
        right = np.where((y_at >= y_from[:, None]) & (y_at < y_to[:, None]), y[pair, : len(y_at)], -2)
        run, longer = np.zeros((len(pair), len(y_at) + 1), dtype=np.int8), np.empty((len(pair), len(y_at) + 1), dtype=np.int8)
        longer[:, 0] = 0
        size, x_end, y_end, row = np.zeros(len(pair), dtype=np.int32), np.zeros(len(pair), dtype=np.int32), np.zeros(len(pair), dtype=np.int32), np.arange(len(pair))
        for i in x_at:
            np.multiply(run[:, :-1] + 1, left[:, i, None] == right, out=longer[:, 1:])
            run, longer = longer, run
            longer[:, 0] = 0
            at = run.argmax(axis=1)
            best = run[row, at]
            more = best > size
            size[more], x_end[more], y_end[more] = best[more], i + 1, at[more]
        if first:
            whole, first = size == np.minimum(n_x, n_y), False
        np.add.at(matched, pair, size)
        sides = [(pair, x_from, x_end - size, y_from, y_end - size), (pair, x_end, x_to, y_end, y_to)]
        kept = [(size > 0) & ~whole[pair] & (s[1] < s[2]) & (s[3] < s[4]) for s in sides]
        parts = tuple(np.concatenate([side[k][keep] for side, keep in zip(sides, kept)]) for k in range(5))
    return np.where(whole, 1.0, 2.0 * matched / (n_x + n_y))


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    a, b = a.fillna("").reset_index(drop=True), b.fillna("").reset_index(drop=True)
    out = np.zeros(len(a), dtype="float64")
    some = ((a != "") & (b != "")).to_numpy()
    # an array of texts has no zero bytes at their ends
    short = some & (np.maximum(a.str.len(), b.str.len()) <= _AT_ONCE).to_numpy() & ~(a.str.endswith("\0") | b.str.endswith("\0")).to_numpy()
    if short.any():
        out[short] = _ratios(a[short], b[short])
    for i in np.flatnonzero(some & ~short):
        out[i] = _one_similarity(a[i], b[i])
    return pd.Series(out)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Ratio of matching blocks of two keys, 1 if one holds the other. Apply it to distinct pairs."""
    return F.pandas_udf(_similarities, "double")(a, b)
