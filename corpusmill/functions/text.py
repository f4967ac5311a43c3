"""Text expressions on columns, evaluated in the JVM; only nfc() and folded() need Arrow."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.words import BRACKETS

#: White space as Python sees it, for a character class.
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
#: Fixed value: the leaf that stands for a line end in parses.
NEWLINE = "Ċ"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + SPACE + "]"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, bracket escapes and the line-end leaf as what they stand for, case folded: the exact profile of body()."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKC", t)
        for escape, mark in {**BRACKETS, NEWLINE: "\n"}.items():
            t = t.replace(escape, mark)
        return t.casefold()

    return text.map(one)


def replaced(text: Column, table: dict[str, str]) -> Column:
    for before, after in table.items():
        text = F.replace(text, F.lit(before), F.lit(after))
    return text


def brackets(text: Column) -> Column:
    """Bracket escapes of tree banks as brackets, wherever they stand; spacing is kept."""
    return replaced(text, BRACKETS)


def lower(text: Column) -> Column:
    """Lower case; a final sigma is like any other."""
    return F.translate(F.lower(text), "ς", "σ")


def tokens(text: Column) -> Column:
    """Word runs and single other marks of the lower-cased text (the SQL profile of matching)."""
    return F.regexp_extract_all(lower(brackets(text)), F.lit(TOKEN), F.lit(0))


def body(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def content_key(text: Column) -> Column:
    """SHA-256 of the NFC text with white space collapsed."""
    return F.sha2(squeezed(nfc(text)), 256)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it: inside a lambda of an array of one,
    where the optimizer can't put the expression in place of the variable."""
    return F.element_at(F.transform(F.array(value), f), 1)


def grams(words: Column, n: int) -> Column:
    """Runs of n words, in order of place; none if there are fewer."""

    def runs(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(words, runs)
