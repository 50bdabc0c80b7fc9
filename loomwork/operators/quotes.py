"""Verbatim quotes: where documents hold given items, whatever their blanks and case."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.needles import held
from loomwork.sources.shared import written

SHORTEST = 12
_BLANKS = re.compile(r"\s+")


def wanted(quote: str) -> str | None:
    """A quote as it is looked for: without quote marks, blanks as one, in lower case; None if it is too short to prove anything."""
    quote = quote.strip().strip("\"“”'")
    return _BLANKS.sub(" ", quote).strip().lower() if len(quote) >= SHORTEST else None


def flattened(text: str) -> tuple[str, list[int]]:
    """The text in lower case, with runs of white space as one blank and none at its begin, and where each character comes from. A character that lower case makes longer counts once for each."""
    out, places, blank = [], [], True
    for i, c in enumerate(text):
        if c.isspace():
            if not blank:
                out.append(" ")
                places.append(i)
            blank = True
        else:
            low = c.lower()
            out.append(low)
            places += [i] * len(low)
            blank = False
    return "".join(out), places


def find(text: str, quote: str) -> tuple[int, int] | None:
    """The first place of a quote, in the text's own offsets."""
    needle = wanted(quote)
    flat, places = flattened(text)
    at = flat.find(needle) if needle else -1
    return None if at < 0 else (places[at], places[at + len(needle) - 1] + 1)


def flat(text: str) -> str:
    """flattened without the places. A capital sigma is the one letter whose lower case depends on what stands beside it."""
    return flattened(text)[0] if "Σ" in text else _BLANKS.sub(" ", text).lstrip().lower()


def quoted(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, first, end) of the first place of every item in every document.

    Items and documents meet by each item's rarest gram, see needles.held: the plan is the same for any number of items, and
    a text is gone through once for all items that may be in it. Items without an id or a text are left out.
    """
    needle = F.udf(wanted, "string", useArrow=True)
    own = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("words")).where("item is not null and words is not null")
    own = written(own.select("item", needle("words").alias("needle")).where("needle is not null"), "items")

    def places(text: str, needles: list[str]) -> list[tuple[str, int, int]]:
        plain, at = flattened(text)
        return [(n, at[k], at[k + len(n) - 1] + 1) for n in needles if (k := plain.find(n)) >= 0]

    fields = [T.StructField("needle", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]
    found = held(documents, own, flat, places, fields, id_col, text_col)
    return found.join(own, "needle").select(id_col, "item", "first", "end")
