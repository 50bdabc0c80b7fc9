"""Vectors, hashes and the coercion of loosely written values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NAMESPACE = "6f5c1a2e-2f3d-4c5b-9a7e-0d1b2c3d4e5f"
LEVEL_WORDS = {"very low": 0.1, "low": 0.25, "below average": 0.35, "moderate": 0.5, "medium": 0.5, "average": 0.5, "above average": 0.65, "high": 0.75, "very high": 0.9}
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40,
    "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
DECADES = {"twenties": 20, "thirties": 30, "forties": 40, "fifties": 50, "sixties": 60, "seventies": 70, "eighties": 80}
LEAST_AGE, MOST_AGE = 16, 99
ACTIVITY_WORDS = {"low": "low", "moderate": "moderate", "high": "high", "medium": "moderate", "average": "moderate", "very high": "high", "very active": "high", "prolific": "high", "very low": "low", "rare": "low", "lurker": "low", "inactive": "low"}
MBTI_THRESHOLD = 0.5


def dot(a: Column, b: Column) -> Column:
    """In double precision; arrays of different lengths are an error."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def derived_uuid(*parts: Column) -> Column:
    """The UUID of version 5 of the parts, joined by bars, as 32 hexadecimal digits."""
    space = F.unhex(F.lit(NAMESPACE.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(F.concat_ws("|", *parts), "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def cache_key(model: str, dim: int, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}|{dim}|"), text), 256)


def _looked_up(key: Column, words: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[key]


def unit_interval(value: Column) -> Column:
    """Between 0 and 1: words, percentages, scales of ten and of a hundred; null if there's no number. A percentage is divided once."""
    text = F.regexp_replace(F.lower(F.trim(value)), "%+$", "")
    number = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0)
    n = F.nullif(number, F.lit("")).cast("double") / F.when(F.contains(value, F.lit("%")), 100).otherwise(1)
    # Each use of n is a copy of its expression, so there are few; what lies between 1 and 2 is cut to 1.
    scaled = n / F.when(n < 2, 1).when(n <= 10, 10).otherwise(100)
    return F.coalesce(_looked_up(text, LEVEL_WORDS), F.when(number != "", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))))


def age(value: Column) -> Column:
    """An age from digits, a decade or number words; null unless it is 16 to 99."""
    text = F.lower(F.trim(value))
    digits = F.nullif(F.regexp_extract(text, r"\d{1,3}", 0), F.lit("")).cast("int")
    words = F.regexp_replace(text, "[-_]", " ")
    decade = _looked_up(F.nullif(F.regexp_extract(words, "|".join(DECADES), 0), F.lit("")), DECADES)
    nudge = F.when(F.contains(words, F.lit("early")), 2).when(F.contains(words, F.lit("late")), 8).otherwise(5)
    known = F.filter(F.transform(F.split(words, r"\s+"), lambda w: _looked_up(w, NUMBER_WORDS)), lambda n: n.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0), lambda s, n: s + n))
    n = F.coalesce(digits, decade + nudge, total)
    return F.when(n.between(LEAST_AGE, MOST_AGE), n)


def activity_level(value: Column) -> Column:
    text = F.lower(F.trim(value))
    score = unit_interval(text)
    return F.coalesce(_looked_up(text, ACTIVITY_WORDS), F.when(score < 0.34, "low").when(score > 0.66, "high").otherwise("moderate"))


def listed(value: Column) -> Column:
    """A list written in one text: split at commas, semicolons and the word and; blanks dropped."""
    return F.filter(F.transform(F.split(value, r"[,;]|\band\b"), lambda x: F.trim(x)), lambda x: x != "")


def mbti(openness: Column, conscientiousness: Column, extraversion: Column, agreeableness: Column) -> Column:
    letter = lambda c, high, low: F.when(c >= MBTI_THRESHOLD, high).otherwise(low)
    return F.concat(letter(extraversion, "E", "I"), letter(openness, "N", "S"), letter(agreeableness, "F", "T"), letter(conscientiousness, "J", "P"))


def participation(level: Column) -> Column:
    return F.when(level == "low", 0.20).when(level == "high", 0.90).otherwise(0.55)


def uniform(*keys: Column, seed: int = 0) -> Column:
    """Between 0 and 1, by the first 32 bits of a digest: the same for the same keys, wherever and however often it runs, and in any engine that has MD5. Null keys are left out."""
    digest = F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]), "utf-8"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / (1 << 32)


def run_id(at: Column, key: Column, kind: str = "sim") -> Column:
    """The name of a run or report: its time to the second, and six hexadecimal digits of the key's hash."""
    return F.concat(F.lit(f"{kind}-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.sha2(key.cast("string"), 256), 1, 6))


def cutoff(now: Column, days: Column) -> Column:
    """What ended before this may go."""
    return F.timestamp_micros(F.unix_micros(now) - days.cast("long") * 86_400_000_000)


def round_time(start: Column, hours: Column, index: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + (hours * 3_600_000_000 * index).cast("long"))
