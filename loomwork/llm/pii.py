"""Personal data: base patterns, and a semi-Markov conditional random field that adds what they miss.

The field splits a zone of text around digits, at-signs and spelled-out addresses into segments: single tokens outside, or
entities of up to MOST_TOKENS tokens, where a long run as secrets have counts as one. Features see a whole candidate span and what stands beside it. It learns from the base
spans of a bounded sample, from variants of them that the patterns don't match, and from all else there as counterexamples.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import columns_added, texts_of
from loomwork.llm.training import sampled

KINDS = ("email", "ip", "card", "phone")
#: The kinds that the field knows, in the order in which equal starts are listed.
ALL_KINDS = (*KINDS, "secret")
#: Documents, zones of each, and zones in all that the field learns from, at most.
TRAIN_DOCS, ZONES_EACH, TRAIN_ZONES = 3_000, 8, 1_500
#: Longer zones are learned from in parts.
LONGEST = 600
MOST_TOKENS = 24
#: Digits of a number that may be a card's or a phone's, at most.
MOST_DIGITS = 19
#: Characters that a zone reaches beyond a trigger.
REACH = 40
#: An added span must beat the best split without it by so much in log-probability.
MARGIN = 3.0

# The same matches as the plain patterns: no run of digits can match from its middle, and what a possessive part gives up never helps.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_ANY = re.compile(r"[0-9@]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by start, then kind. Each pattern takes time in proportion to the text."""
    if not _ANY.search(text):
        return []
    out: list[Span] = []
    last, at, before = 0, text.find("@"), 0
    while at >= 0:
        low = max(last, before)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            last = m.end()
        before, at = at + 1, text.find("@", at + 1)
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return ordered(out)


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[0], ALL_KINDS.index(s[2]), s[1]))


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# ---- zones, tokens and features ------------------------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@]|(?i:[\[(](?:at|dot)[\])]|(?<= )dot(?= )|(?<= )at(?= [a-z0-9-]+\.[a-z0-9-]))")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
_AT = re.compile(r"@|(?i:\s?[\[(]at[\])]\s?|\sat\s)")
_MAIL_LIKE = re.compile(r"(?i)[a-z0-9._%+-]+(?:@|\s?[\[(]at[\])]\s?|\sat\s)[a-z0-9-]+(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[a-z0-9-]+)+")
_SECRET = re.compile(r"[A-Za-z0-9_/+=-]{16,}")
#: What an address, a number or a secret may hold without a blank: no zone begins or ends inside such a run.
_RUN, _RUN_MARKS = re.compile(r"[A-Za-z0-9_/+=.%@-]*"), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_/+=.%@-"
_KEY_WORD = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|key|credential)s?[\"']?\s*[:=]\s*[\"']?$")
_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().\-/]*[0-9]")
#: Four numbers with the same between them: a dot, as such, in a word or in brackets, or a blank.
_SPELLED_IP = re.compile(r"(?i)[0-9]+(\s?[\[(](?:dot|\.)[\])]\s?|\sdot\s|\s?\.\s?|\s)[0-9]+(?:\1[0-9]+){2}")
#: Tokens that numbers, addresses and secrets may have.
_IN_NUMBER, _IN_MAIL, _IN_SECRET = re.compile(r"(?i)[0-9]+|\s+|[().\-/+\[\]]|dot"), re.compile(r"[A-Za-z0-9]+|\s|[._%+\-@\[\]()]"), re.compile(r"[A-Za-z0-9]+|[_/+=\-]")


@dataclass
class Zone:
    """A stretch of a text: tokens (begin, end), and spans that stand for themselves. blocked: their tokens, which no new entity may touch."""

    text: str
    tokens: list[tuple[int, int]]
    blocked: list[bool]
    gold: list[Span] = field(default_factory=list)


def zones(text: str, base: list[Span]) -> Iterator[tuple[int, str]]:
    """(begin, text) of the stretches around triggers, joined if they meet. None begins or ends inside a run of letters, digits and marks that addresses and secrets have."""
    begin = end = -1
    for m in _TRIGGER.finditer(text):
        if m.end() + REACH <= end:
            continue
        low = max(0, m.start() - REACH)
        if end < 0 or low > end:
            floor = max(end, 0)
            low = floor + len(text[floor:low].rstrip(_RUN_MARKS))
        if end >= 0 and low > end:
            yield begin, text[begin:end]
            begin = low
        elif end < 0:
            begin = low
        end = min(len(text), m.end() + REACH)
        end = _RUN.match(text, end).end() if text[end - 1] in _RUN_MARKS else end
    if end >= 0:
        yield begin, text[begin:end]


def zone(text: str, fixed: list[Span]) -> Zone:
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    cuts = sorted({x for a, b, _ in fixed for x in (a, b)})
    out: list[tuple[int, int]] = []
    for a, b in tokens:
        inner = [a, *[c for c in cuts if a < c < b], b]
        out += zip(inner, inner[1:], strict=False)
    covered = np.zeros(len(text) + 1, bool)
    for a, b, _ in fixed:
        covered[max(a, 0) : b] = True
    return Zone(text, out, [bool(covered[a]) for a, _ in out])


def _long_runs(z: Zone) -> tuple[dict[int, int], dict[int, int]]:
    """For runs of more than MOST_TOKENS tokens: the token after the last by the first one, and the same by each token inside."""
    at, inside = {}, {}
    for m in _SECRET.finditer(z.text):
        first = bisect_left(z.tokens, (m.start(),))
        last = bisect_left(z.tokens, (m.end(),))
        if last - first > MOST_TOKENS:
            at[first] = last
            inside |= dict.fromkeys(range(first + 1, last), last)
    return at, inside


def _ends(i: int, stop: int, run_at: dict[int, int], run_inside: dict[int, int]) -> Iterator[int]:
    """Tokens after the last of candidates from token i: up to MOST_TOKENS on, then only those that cut no long run, each such run counting as one."""
    near = min(stop, i + MOST_TOKENS)
    yield from range(i + 1, near + 1)
    if not run_at or i in run_inside:
        return
    j, units = i, 0
    while j < stop and units < MOST_TOKENS:
        j, units = run_at.get(j, j + 1), units + 1
        if near < j <= stop:
            yield j


def candidates(z: Zone, use_blocked: bool = False) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(first token, token after the last, kind, features) of every segment that could be an entity: MOST_TOKENS at most, or as many where a run counts as one and isn't cut."""
    out = []
    run_at, run_inside = _long_runs(z)
    free = [len(z.tokens)] * (len(z.tokens) + 1)  # where the next blocked token is
    for i in range(len(z.tokens) - 1, -1, -1) if not use_blocked else ():
        free[i] = i if z.blocked[i] else free[i + 1]
    pieces = [z.text[a:b] for a, b in z.tokens]
    # Up to where tokens are of a kind, where the next at-sign is, and digits so far: what can't be an entity is never looked at.
    number, mail, secret = (_reach(pieces, kind) for kind in (_IN_NUMBER, _IN_MAIL, _IN_SECRET))
    sign, digits = [len(pieces)] * (len(pieces) + 1), [0]
    for i in range(len(pieces) - 1, -1, -1):
        sign[i] = i if pieces[i] == "@" or pieces[i].lower() == "at" else sign[i + 1]
    for p in pieces:
        digits.append(digits[-1] + (len(p) if p.isascii() and p.isdigit() else 0))
    for i, (a, _) in enumerate(z.tokens):
        if z.blocked[i] and not use_blocked or z.text[a].isspace():
            continue
        head = z.text[a]
        if not (head.isalnum() and head.isascii() or head in "+(_-%."):
            continue
        address = mail[i] if sign[i] < mail[i] else i
        stop = min(free[i], max(number[i], address, secret[i]))
        for j in _ends(i, stop, run_at, run_inside):
            n = digits[j] - digits[i]
            if not (j <= number[i] and 4 <= n <= MOST_DIGITS or sign[i] < j <= address or j <= secret[i] and n):
                if j > max(address, secret[i]) and n > MOST_DIGITS:
                    break
                continue
            b = z.tokens[j - 1][1]
            tail = z.text[b - 1]
            if not (tail.isascii() and tail.isalnum() or tail in "=_-"):
                continue
            s = z.text[a:b]
            for kind, features in span_features(s, z.text[max(0, a - 16) : a], z.text[b : b + 2]):
                out.append((i, j, kind, features))
    return out


def _reach(pieces: list[str], kind: re.Pattern) -> list[int]:
    """For each token the next one that isn't of the kind."""
    out = [len(pieces)] * (len(pieces) + 1)
    for i in range(len(pieces) - 1, -1, -1):
        out[i] = out[i + 1] if kind.fullmatch(pieces[i]) else i
    return out


def span_features(s: str, left: str, right: str) -> Iterator[tuple[str, tuple[str, ...]]]:
    """What tells of a whole candidate, for each kind that it might be."""
    clean = ("open" if left[-1:].isalnum() or left[-1:] in ("@", "+") else "edge") + ("open" if right[:1].isalnum() or right[:1] == "@" else "edge")
    digits = _digits(s)
    if _AT.search(s) and (m := _MAIL_LIKE.fullmatch(s)):
        end = re.split(r"[.\s\])]", s)[-1]
        more = re.match(r"(?i)(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[a-z0-9]", right + "  ") is not None
        yield "email", (clean, "sign" if "@" in s else "bracket" if "[" in s or "(" in s else "word", "top" if 2 <= len(end) <= 6 and end.isalpha() else "no top", "goes on" if more or right[:1] == "." and right[1:2].isalnum() else "ends", "digits" if digits else "letters")
    near = "number" if re.search(r"[0-9+][ .()-]?$", left) or left[-1:] == "(" and right[:1] != ")" or re.match(r"[ .()-]?[0-9]", right) else "alone"
    if 4 <= len(digits) <= MOST_DIGITS and _NUMBER.fullmatch(s):
        n, marked = len(digits), set(s) - set("0123456789")
        size = "few" if n < 7 else "local" if n < 10 else "phone" if n <= 13 else "card"
        marks = "plain" if not marked else "dots" if marked == {"."} else "dashes" if marked <= {" ", "-"} else "slashes" if marked <= {" ", "/"} else "mixed"
        start = "plus" if s[0] == "+" else "round" if s[0] == "(" else "digit"
        start = start if s.count("(") == s.count(")") else "torn"
        groups = ".".join(str(len(x)) for x in re.split(r"[^0-9]+", s) if x)
        if n >= 7 and s[0] != "0":
            yield "phone", (clean, size, marks, start, near, "groups " + groups[-7:])
        if 12 <= n and start == "digit":
            yield "card", (clean, size, marks, near, "luhn" if luhn(digits) else "no luhn", "fours" if groups.startswith("4.4.4") else "other")
    if digits and s[0].isdigit() and _SPELLED_IP.fullmatch(s) and all(map(_small, parts := re.findall("[0-9]+", s))):
        words = "words" if re.search("[a-zA-Z]", s) else "brackets" if "[" in s or "(" in s else "dots" if s.count(".") == 3 and not re.search(r"\s", s) else "gaps"
        yield "ip", (clean, near, words, "short" if all(len(p) < 2 for p in parts) else "long")
    if len(s) >= 16 and digits and _SECRET.fullmatch(s):
        hexes = sum(c in "0123456789abcdefABCDEF" for c in s) / len(s)
        yield "secret", (clean, "hex" if hexes == 1 else "word" if hexes < 0.5 else "mixed", "named" if _KEY_WORD.search(left) else "unnamed", "long" if len(s) >= 28 else "short", "quoted" if left[-1:] in "\"'" and right[:1] in ("'", '"') and left else "bare", "number" if s.isdigit() else "letters")


@dataclass
class Field:
    """Weights by (kind, feature); a token outside weighs nothing, so an entity's score is its log-odds against being outside."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)

    def score(self, kind: str, features: tuple[str, ...]) -> float:
        w = self.weights
        return w.get((kind, ""), -4.0) + sum([w.get((kind, f), -0.5) for f in features])

    def best(self, z: Zone, margin: float = MARGIN) -> list[Span]:
        """The best split of a zone into entities and tokens outside, by dynamic programming over segment ends."""
        by_end: dict[int, list[tuple[int, str, float]]] = {}
        for i, j, kind, features in candidates(z):
            if (s := self.score(kind, features) - margin) > 0:
                by_end.setdefault(j, []).append((i, kind, s))
        if not by_end:
            return []
        best, back = [0.0] * (len(z.tokens) + 1), [None] * (len(z.tokens) + 1)
        for j in range(1, len(best)):
            best[j] = best[j - 1]
            for i, kind, s in by_end.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        out, j = [], len(best) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                out.append((z.tokens[i][0], z.tokens[j - 1][1], kind))
                j = i
        return out[::-1]


def trained(examples: list[Zone], rounds: int = 40, rate: float = 0.5, ridge: float = 0.005) -> Field:
    """Conditional likelihood by gradient steps; expectations come from forward and backward sums over segments, token by token for all zones at once."""
    names: dict[tuple[str, str], int] = {}
    zone_of, begin, end, right, flat, many = [], [], [], [], [], []
    for n, z in enumerate(examples):
        gold = {(a, b, k) for a, b, k in z.gold}
        for i, j, kind, features in candidates(z, use_blocked=True):
            zone_of.append(n)
            begin.append(i)
            end.append(j)
            flat += [names.setdefault((kind, f), len(names)) for f in ("", *features)]
            many.append(1 + len(features))
            right.append((z.tokens[i][0], z.tokens[j - 1][1], kind) in gold)
    if not many:
        return Field()
    zone_of, begin, end, flat, many = (np.array(x) for x in (zone_of, begin, end, flat, many))
    right, first = np.array(right, float), np.r_[0, np.cumsum(many)[:-1]]
    last = int(end.max())
    by_end, by_begin = np.argsort(end, kind="stable"), np.argsort(begin, kind="stable")
    ends, begins = (np.searchsorted(x[o], np.arange(last + 2)) for x, o in ((end, by_end), (begin, by_begin)))
    w = np.zeros(len(names))
    for name, k in names.items():
        w[k] = -1.0 if name[1] == "" else 0.0
    moment = np.zeros(len(w))
    for _ in range(rounds):
        scores = np.add.reduceat(w[flat], first)
        ahead, behind = np.zeros((last + 1, len(examples))), np.zeros((last + 1, len(examples)))
        for j in range(1, last + 1):
            ahead[j] = ahead[j - 1]
            c = by_end[ends[j] : ends[j + 1]]
            np.logaddexp.at(ahead[j], zone_of[c], ahead[begin[c], zone_of[c]] + scores[c])
        for i in range(last - 1, -1, -1):
            behind[i] = behind[i + 1]
            c = by_begin[begins[i] : begins[i + 1]]
            np.logaddexp.at(behind[i], zone_of[c], behind[end[c], zone_of[c]] + scores[c])
        expected = np.exp(np.minimum(ahead[begin, zone_of] + scores + behind[end, zone_of] - ahead[last, zone_of], 0))
        gradient = ridge * w + np.bincount(flat, np.repeat((expected - right) / 20, many), len(w))
        moment += gradient**2
        w -= rate * gradient / (np.sqrt(moment) + 1e-8)
    return Field({name: float(w[k]) for name, k in names.items()})


#: Letters of hexadecimal digits as others, of both cases: keys of another alphabet.
_BEYOND_HEX = str.maketrans("abcdefABCDEF", "gKpXtMHrWnQz")


def _variants(span: str, kind: str) -> list[str]:
    """Other ways to write a span, which the patterns miss, or other kinds of keys."""
    if kind == "email":
        name, _, domain = span.partition("@")
        return [f"{name} at {domain.replace('.', ' dot ')}", f"{name}[at]{domain.replace('.', '[dot]')}", f"{name} (at) {domain.replace('.', ' (dot) ')}", f"{name} [at] {domain}"]
    if kind == "phone":
        digits = _digits(span)[-10:]
        return [f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:]}"]
    if kind == "card":
        digits = _digits(span)
        return [mark.join(digits[k : k + 4] for k in range(0, len(digits), 4)) for mark in (".", "/", " - ", "  ", " / ", ". ")]
    if kind == "ip":
        parts = span.split(".")
        return [mark.join(parts) for mark in (" dot ", "[.]", " [dot] ", "(.)", "[dot]", " . ")]
    if kind == "secret" and len(span) > 22 and not span.isalpha():
        other = span.translate(_BEYOND_HEX)
        return [other[:22], other] if _digits(other[:22]) else []
    return []


def examples(texts: Iterable[tuple[int, str]], most: int = TRAIN_ZONES) -> list[Zone]:
    """Zones with their base spans and secrets that are named as such as gold, and once more with a variant in a span's place."""
    out: list[Zone] = []
    for n, text in islice(texts, most):
        gold: list[Span] = []
        for s in [*base_spans(text), *[(*m.span(), "secret") for m in _SECRET.finditer(text) if _KEY_WORD.search(text[max(0, m.start() - 16) : m.start()])]]:
            if all(s[1] <= a or b <= s[0] for a, b, _ in gold):
                gold.append(s)
        z = zone(text, gold)
        z.gold = gold
        out.append(z)
        a, b, kind = gold[n % len(gold)] if gold else (0, 0, "")
        if ways := _variants(text[a:b], kind):
            for new in dict.fromkeys((ways[n % len(ways)], ways[(n + 1) % len(ways)])):
                # Some stand in round brackets, as any span may.
                before, after = "()" if n % 4 == 3 else ("", "")
                at, more = a + len(before), len(before + new + after) - (b - a)
                shifted = [s for s in gold if s[1] <= a] + [(at, at + len(new), kind)] + [(x + more, y + more, k) for x, y, k in gold if x >= b]
                z = zone(text[:a] + before + new + after + text[b:], shifted)
                z.gold = shifted
                out.append(z)
    return out


def fit(documents: DataFrame, docs: int = TRAIN_DOCS, most: int = TRAIN_ZONES, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Learns from the zones of at most docs documents, chosen by their texts' hashes; without any, the field adds nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t for text in texts_of(batch.column(0)) for t in _some({part for _, x in zones(text, []) for part in _parts(x)})]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["zone"])

    rows = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sample = sampled(rows.where("text rlike '[0-9@]'"), docs, "doc_id", "text").select("text")
    chosen = sample.mapInArrow(run, "zone string").distinct().orderBy(F.xxhash64("zone"), "zone").limit(most).collect()
    return trained(examples(enumerate(r.zone for r in chosen), most))


def _parts(text: str) -> Iterator[str]:
    """A long zone in parts of LONGEST characters at most, cut at white space where there is some."""
    while len(text) > LONGEST:
        cut = max(text.rfind(c, 1, LONGEST) for c in " \n\t")
        cut = cut if cut > 0 else LONGEST
        yield text[:cut]
        text = text[cut:]
    yield text


def _some(found: set[str]) -> list[str]:
    """ZONES_EACH of a document's zones at most, by hash, wherever they stand."""
    return sorted(found, key=lambda t: hashlib.sha256(t.encode("utf-8", "replace")).digest())[:ZONES_EACH]


def all_spans(text: str, model: Field) -> tuple[list[Span], list[Span]]:
    """(base, all) spans: the field adds those that touch no base span."""
    base = base_spans(text)
    if not _TRIGGER.search(text):
        return base, base
    more: list[Span] = []
    for begin, part in zones(text, base):
        fixed = [(max(a - begin, 0), min(b - begin, len(part)), k) for a, b, k in base if a < begin + len(part) and b > begin]
        more += [(a + begin, b + begin, k) for a, b, k in model.best(zone(part, fixed))]
    return base, ordered([*base, *more])


SPAN = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])


def with_spans(documents: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """documents with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, and masked, the text with each stretch that spans cover replaced by its first kind in brackets.

    Null texts have no spans, and null stays null in masked. New columns replace documents' of their names; rows are treated one by one.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = [*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], *[T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", "masked")]]

    def make():
        def apply(column):
            out = {f.name: [] for f in fields}
            for text in column.to_pylist():
                base, spans = all_spans(text or "", shared.value)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(spans))
                out["masked"].append(text and masked(text, spans))
            return out

        return apply

    return columns_added(documents, [text_col], fields, make)


def masked(text: str, spans: list[Span]) -> str:
    parts, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < b:
            k += 1
            b = max(b, spans[k][1])
        parts += [text[at:a], f"[{kind.upper()}]"]
        at, k = b, k + 1
    return "".join([*parts, text[at:]])


def personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; see with_spans."""
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_spans(docs, fit(docs)).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")


def without_personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents, with the columns they had, with what spans cover replaced in text, and n_chars, where there is such a column, counted anew.

    Null texts stay null, and so does their length; empty texts stay empty. Repeated rows stay, each masked alike. An empty table gives no rows.
    """
    model = fit(documents, id_col=id_col, text_col=text_col)
    out = with_spans(documents.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("text")), model)
    row = F.col("row").withField(f"`{text_col}`", F.col("masked"))
    if length_col in documents.columns:
        row = row.withField(f"`{length_col}`", F.length("masked").cast(documents.schema[length_col].dataType))
    return out.select(row.alias("row")).select("row.*")
