"""Text functions: names, identifiers, references, handles, Markdown; and the few that need Python."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HONORIFICS = (
    "mr mrs ms miss mx dr prof professor sir dame lord lady cllr councillor councilor mayor deputy sen senator rep "
    "representative gov governor hon honourable honorable rev reverend capt captain col colonel lt lieutenant sgt sergeant "
    "gen general chair chairman chairwoman president director minister"
).split()
ARTICLES = "the a an".split()
SUFFIXES = "jr sr ii iii iv phd md esq".split()
LEXICAL_SCORES = {"exact": 1.0, "prefix": 0.95, "alias": 0.9, "substring": 0.85}
MOST_IDENTIFIER = 63
LONGEST_POST = {"twitter": 280, "reddit": 10_000}


def nfkc(text: Column) -> Column:
    """Unicode normal form KC, which Spark has no function for. ASCII is its own, so only texts beyond it go to Python, which takes few at once."""

    def normal(texts: pa.Array) -> pa.Array:
        parts = [texts.slice(a, 64).to_pylist() for a in range(0, len(texts), 64)]
        done = [pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part], pa.string()) for part in parts]
        return pa.concat_arrays([pa.array([], pa.string()), *done])

    return F.coalesce(F.arrow_udf(normal, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalised_name(name: Column) -> Column:
    """Lower case, punctuation as blanks, without leading titles and articles and without trailing suffixes, however many. Other alphabets: apply nfkc first."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))
    bare = F.regexp_replace(plain, rf"^(?:(?:{'|'.join(HONORIFICS + ARTICLES)})(?: |$))+", "")
    return F.trim(F.regexp_replace(bare, rf"(?:(?:^| )(?:{'|'.join(SUFFIXES)}))+$", ""))


def tokens(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda t: t != "")


def is_alias(left: Column, right: Column) -> Column:
    """One name is the end of the other, by two tokens or more; equal names are, unless empty."""
    a, b = tokens(left), tokens(right)
    short, long = F.when(F.size(a) < F.size(b), a).otherwise(b), F.when(F.size(a) < F.size(b), b).otherwise(a)
    ends = F.slice(long, F.greatest(F.size(long) - F.size(short) + 1, F.lit(1)), F.greatest(F.size(short), F.lit(1))) == short
    return F.when((F.size(a) == 0) | (F.size(b) == 0), False).when(a == b, True).otherwise((F.size(short) >= 2) & ends)


def token_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of token sets; 1 if one holds the other, 0 if one is empty."""
    a, b = F.array_distinct(tokens(left)), F.array_distinct(tokens(right))
    common = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when((common == F.size(a)) | (common == F.size(b)), 1.0)
        .otherwise(common / F.size(F.array_union(a, b)))
    )


def grounded_in(normalised: Column, text: Column) -> Column:
    """Every token of the name occurs in the text, in lower case."""
    low = F.lower(text)
    return F.forall(tokens(normalised), lambda t: F.contains(low, t))


def identifier(name: Column, upper_first: bool = True) -> Column:
    """PascalCase or UPPER_SNAKE of the words, camel case split first, 63 characters at most; empty if it doesn't begin with a letter."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z]+", " "), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    parts = F.filter(F.split(spaced, " "), lambda p: p != "")
    capital = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))
    joined = F.array_join(F.transform(parts, capital), "") if upper_first else F.array_join(F.transform(parts, F.upper), "_")
    return F.when(joined.rlike("^[A-Za-z]"), F.substring(joined, 1, MOST_IDENTIFIER)).otherwise("")


def attribute_names(names: Column) -> Column:
    """snake_case names that begin with a letter, each once, in order of appearance."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.lower(identifier(n, upper_first=False))), lambda n: n != ""))


def labelled(values: Column, kind: str) -> Column:
    """[(kind, value)] of the values."""
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value")))


def references(text: Column) -> Column:
    """[(kind, value)] of what reads like a reference to a post, an agent, a round or a handle, in this order of kinds."""
    # Fixed values.
    patterns = {
        "post": r"(?i)\bposts?[\s_#]*(?:id)?[\s#]*(\d+)", "agent": r"(?i)\b(?:agents?|users?)[\s_#]*(?:id)?[\s#]*(\d+)",
        "round": r"(?i)\brounds?[\s_#]*(\d+)", "username": r"@([A-Za-z0-9_]{2,32})",
    }
    return F.concat(*[labelled(F.regexp_extract_all(text, F.lit(p), 1), kind) for kind, p in patterns.items()])


def slug(name: Column, default: str, length: int = 24) -> Column:
    """Lower case, all else as one underscore, none at the ends; default if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, length), F.lit("")), F.lit(default))


def collapsed(text: Column, length: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, length)


def match_kind(needle: str | Column, name: Column, normalised: Column) -> Column:
    n = F.lit(needle)  # a column stays one
    return (
        F.when((F.lower(name) == n) | (normalised == n), "exact")
        .when(F.lower(name).startswith(n) | normalised.startswith(n), "prefix")
        .when(F.contains(F.lower(name), n) | F.contains(normalised, n), "substring")
        .otherwise("alias")
    )


def match_score(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in LEXICAL_SCORES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def without_invisible(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[­​‌‍⁠﻿]", ""), " ", " ")


def normalised_text(text: Column, dehyphenate: bool = False) -> Column:
    """Line ends as \\n, invisible characters gone, normal form KC, no trailing blanks, no more than one empty line, trimmed."""
    out = nfkc(without_invisible(F.regexp_replace(text, r"\r\n?", "\n")))
    if dehyphenate:
        out = F.regexp_replace(out, r"([a-z])-\n([a-z])", "$1$2")
    out = F.regexp_replace(F.regexp_replace(out, r"(?dm)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+\z", "")


#: What Markdown loses, in order, and what takes its place (fixed values).
MARKDOWN = [
    (r"(?ms)^[ \t]*(```|~~~).*?^[ \t]*\1[ \t]*$", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?m)^[ \t]*\[[^\]]+\]:[ \t]*\S+.*$", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\[[^\]]*\]", "$1"),
    (r"<(https?://[^>]+)>", ""),
    (r"\bhttps?://\S+", ""),
    (r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$", ""),
    (r"(?m)^[ \t]*([-*_])(?:[ \t]*\1){2,}[ \t]*$", ""),
    (r"(?m)^[ \t]*(=+|-{2,})[ \t]*$", ""),
    (r"(?m)^[ \t]*#{1,6}[ \t]*", ""),
    (r"(?m)^[ \t]*>[ \t]?", ""),
    (r"(?m)^[ \t]*(?:[-*+]|\d+[.)])[ \t]+", ""),
    (r"`([^`]*)`", "$1"),
    (r"(?s)(\*{1,3}|_{1,3})(\S.*?\S|\S)\1", "$2"),
    (r"</?[A-Za-z][^>]*>", ""),
    (r"[ \t]*\|[ \t]*", " "),
]


def normalised_markdown(text: Column) -> Column:
    """The words of Markdown: labels, headings and items stay, code, addresses, rules and markup go."""
    for pattern, put in MARKDOWN:
        text = F.regexp_replace(text, "(?d)" + pattern, put)  # a line ends at \\n alone
    return normalised_text(text)


def salvaged(text: Column) -> Column:
    """The first whole JSON object or array in a text, whatever stands around it; null if there is none. Braces inside strings don't count."""

    def first(t: str) -> str | None:
        closers: list[str] = []
        begin, quoted, k = -1, False, 0
        while k < len(t):
            c = t[k]
            if quoted:
                k += c == "\\"
                quoted = c != '"'
            elif c in "{[":
                begin = k if not closers else begin
                closers.append("}" if c == "{" else "]")
            elif closers and c == '"':
                quoted = True
            elif closers and c in "}]":
                if closers.pop() != c:
                    closers, k = [], begin  # not balanced: the next opening is tried
                elif not closers:
                    return t[begin : k + 1]
            k += 1
        return None

    return F.pandas_udf(lambda texts: texts.map(first, na_action="ignore"), "string")(text)


def suggestion(word: Column, known: list[str], least: float = 0.6) -> Column:
    """The known word that is most like it, if any is like enough."""

    def closest(words: pd.Series) -> pd.Series:
        found = {w: (difflib.get_close_matches(w, sorted(known), n=1, cutoff=least) or [None])[0] for w in words.dropna().unique()}
        return words.map(found, na_action="ignore")

    return F.pandas_udf(closest, "string")(word)


def is_identifier(name: Column) -> Column:
    """Whether a name may stand in a query unquoted: letters, digits and underscores, no digit first, 63 characters at most."""
    return F.coalesce(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (F.length(name) <= MOST_IDENTIFIER), F.lit(False))


def shortened(text: Column, length: int) -> Column:
    """Blanks collapsed; what is longer is cut and ends in an ellipsis, within the length."""
    plain = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(plain) <= length, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, length - 1)), F.lit("…")))


def defanged(text: Column) -> Column:
    return F.replace(text, F.lit("```"), F.lit("'''"))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
