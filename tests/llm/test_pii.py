import random
import re

import pyarrow.parquet as pq
import pytest

from loomwork.llm import pii
from tests.llm.helpers import awkward

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    texts = ["a@b.c@d.e", "x@y", "a@@b.cc", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "+1 (499) 555-6503, 4111 1111 1111 1111", "4111-1111-1111-1111-", "+12345678901234567890", "é a.b+c@d-e.f9 \U0001f642 10.0.0.1"]
    texts += ["".join(rng.choice("0123456789  ..@@+-()ab") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text in texts:
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "@" * 300_000, "a@" * 100_000, "1 " * 150_000):
        pii.base_spans(text)


def test_learned_spans_and_rows(spark):
    rng = random.Random(2)
    texts = []
    for k in range(120):
        found = rng.choice([f"jo{k}.li@mail{k % 7}.example.com", f"+1 (4{k % 10}9) 555-{1000 + k}", f"10.0.{k}.7", f'token = "{rng.randbytes(20).hex()}"', f"in {1900 + k} or {k * 37}", "12/03/2019"])
        texts.append(f"some words here {found} and more words")
    docs = awkward(spark, texts, clashing=True)
    rows = pii.personal_data(docs).collect()
    assert len(rows) == docs.count()
    assert pii.personal_data(docs.limit(0)).count() == 0
    for r, text in ((r, texts[r.doc_id - 100]) for r in rows if (r.doc_id or 0) >= 100):
        base = pii.listed(pii.base_spans(text))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    model = pii.fit(docs)
    kinds = lambda t: [k for *_, k in pii.all_spans(t, model)[1]]
    assert kinds('token = "1eb9c654e721b4f812088970e66a6345cee33dd6" end') == ["secret"]
    assert kinds("in 2019 there were 1234567 of 12/03/2019") == []
    masked = pii.without_personal_data(docs)
    assert masked.schema.names == docs.schema.names and masked.where("text rlike '@mail'").isEmpty()
    assert masked.where("n_chars <> length(text)").isEmpty()


def test_masking():
    assert pii.masked("ab cd ef", [(0, 2, "email"), (1, 5, "ip"), (6, 8, "card")]) == "[EMAIL] [CARD]"


def test_long_keys_and_spelled_out_addresses(spark):
    rng = random.Random(5)
    texts = []
    for k in range(160):
        found = rng.choice([f"jo.li{k}@mail{k % 7}.example.com", f"jo.li@mail{k % 7}.example.com", f'token = "{rng.randbytes(20).hex()}"', f"in {1900 + k} or {k * 37}", "12/03/2019"])
        texts.append(f"some words here {found} and more words")
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for key in ("f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "1a2b3c4d5e" * 4, "f0e1d2c3" * 8, "a1" * 40):
        text = f'see token = "{key}" end'
        assert pii.all_spans(text, model)[1] == [(13, 13 + len(key), "secret")], key
    key = "abcDEF1234567890ghijkl"
    assert pii.all_spans(f'api_key = "{key}" end', model)[1] == [(11, 11 + len(key), "secret")]
    for address in ("jane.roe at example.com", "jane.roe at example DOT com", "jane.roe AT example dot com"):
        z = pii.zone(*[(t, []) for _, t in pii.zones(f"write to {address} today", [])][0])
        assert address in {z.text[z.tokens[i][0] : z.tokens[j - 1][1]] for i, j, kind, _ in pii.candidates(z) if kind == "email"}, address
    assert not list(pii.zones("we met at home. Then", []))


def test_zones_do_not_cut_runs():
    key = "abcDEF" * 20 + "7" + "ghiJKL" * 20
    assert [text[begin : begin + len(part)] == part and key in part for text in (f"a key {key} and words " * 2,) for begin, part in pii.zones(text, [])] == [True, True]
    text = "1a" * 50_000 + "." + "b" * 50_000 + "2"
    assert sum(len(part) for _, part in pii.zones(text, [])) == len(text)
    assert len(pii.candidates(pii.zone("1a" * 4000, []), True)) < 8000 * 25


def test_different_zones_are_learned_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "trained", lambda examples: seen.append([z.text for z in examples]) or pii.Field())
    texts = [f"alone in {1000 + k} here" for k in range(40)] + ["one copied text of 1999"] * 60 + [(" " * 100).join(f"place {k}" for k in range(10, 40))]
    pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=49)
    assert len(seen[0]) == len(set(seen[0])) == 49 and sum("copied" in t for t in seen[0]) == 1
    assert sum("place" in t for t in seen[0]) == 8 and any(int(re.search("[0-9]+", t)[0]) >= 18 for t in seen[0] if "place" in t)
    assert len(pii.examples(((k, f"a{k}@b.com") for k in range(9)), 9)) == 27  # two variants of each take no zone's place


def test_zones_hold_whole_addresses():
    text = "x" * 60 + ".smith at example dot com"
    assert [begin for begin, _ in pii.zones(text, [])] == [0]
    text = "call " + ".".join(["part"] * 30) + "@mail.example.com now"
    assert any(text[5:-4] in part for _, part in pii.zones(text, []))


def test_best_split_against_all_splits():
    rng = random.Random(9)
    words = ["a1b2", "7", "at", "jo", "@", "x.com", "555-1234", "2019", "(", ")", "+1", "dot", "com", "-", "10.0.0.1"]
    for _ in range(150):
        z = pii.zone(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))), [])
        found = pii.candidates(z)
        names = {(kind, f) for *_, kind, features in found for f in ("", *features)}
        field = pii.Field({name: rng.uniform(-1, 2) for name in names})

        def best(at, z=z, found=found, field=field):
            """The highest sum from token at on, over all splits."""
            if at == len(z.tokens):
                return 0.0
            return max([best(at + 1), *[field.score(kind, f) - pii.MARGIN + best(j) for i, j, kind, f in found if i == at]])

        scores = {(z.tokens[i][0], z.tokens[j - 1][1], kind): field.score(kind, f) - pii.MARGIN for i, j, kind, f in found}
        spans = field.best(z)
        assert abs(sum(scores[s] for s in spans) - best(0)) < 1e-9
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.fixture(scope="module")
def field():
    """Learned from the base spans of documents, as fit does."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    found = sorted({part for t in texts for _, z in pii.zones(t or "", []) for part in pii._parts(z)})
    return pii.trained(pii.examples(enumerate(found)))


def card(rng):
    digits = "".join(str(rng.randrange(1, 10)) for _ in range(15))
    return next(digits + str(c) for c in range(10) if pii.luhn(digits + str(c)))


FORMS = {
    "email": ["jo.li{0} at mail{1} dot example dot com", "jo.li{0}[at]mail{1}[dot]example[dot]com", "jo.li{0} (at) mail{1} (dot) example (dot) com", "jo.li{0} [at] mail{1}.example.com"],
    "phone": ["({2}) {3}-{4}", "{2}-{3}-{4}", "{2}.{3}.{4}"],
    "ip": [mark.join(["{0}", "{1}", "{5}", "{6}"]) for mark in (" dot ", "[.]", " [dot] ", "(.)", "[dot]", " . ")],
    "card": [mark.join(["{7}", "{8}", "{9}", "{10}"]) for mark in (".", "/", " - ", "  ", " / ", ". ")],
}


@pytest.mark.parametrize("kind", sorted(FORMS))
def test_recall_of_added_spans(field, kind):
    """What the base patterns miss: spelled-out, bracketed and dotted, each form in several places."""
    rng = random.Random(kind)
    around = ["Please reach us: {} before noon.", "the record {} was kept", "{} is on file, thanks", "call or write ({}) today", "see {}"]
    for form in FORMS[kind]:
        hits = 0
        for k in range(60):
            c = card(rng)
            span = form.format(rng.randrange(256), rng.randrange(256), rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999), rng.randrange(256), rng.randrange(256), *(c[i : i + 4] for i in range(0, 16, 4)))
            text = around[k % 5].format(span)
            hits += (text.index(span), text.index(span) + len(span), kind) in pii.all_spans(text, field)[1]
        assert hits >= 57, (form, hits)


def test_numbers_that_tell_of_nobody(field):
    for text in (
        "In 2019 there were 1234567 people and 12/03/2019 was a Monday, 3.14159 times 2.", "version 1.2.3 and 10.4.2.1-beta of 2020-05-06 07:08:09", "order 1234/5678 of 24 items at 19.99 each, total 479.76",
        "room 12, floor 3, page 456 of 789; chapters 1, 2, 3, 4, 5", "ISBN 978-3-16-148410-0 and DOI 10.1000/182", "score 21-14, 35-28, 7-0; 100 200 300 400 500", "from 1990 to 2020 the rate rose 4.5 5.6 7.8 9.1 percent",
    ):
        base, spans = pii.all_spans(text, field)
        assert spans == base


def test_candidates_leave_out_nothing():
    """Against every stretch of tokens."""
    rng = random.Random(6)
    words = ["a1b2c3d4e5f6a7b8", "7", " at ", "jo", "@", "x.com", "555-1234", "2019", "(", ")", "+1", " dot ", "[dot]", "com", "-", "/", "10.0.0.1", "4111", " ", ", ", "é"]
    for _ in range(300):
        z = pii.zone("".join(rng.choice(words) for _ in range(rng.randrange(1, 12))), [])
        every = []
        for i, (a, _) in enumerate(z.tokens):
            for j in range(i + 1, min(len(z.tokens), i + pii.MOST_TOKENS) + 1):
                b = z.tokens[j - 1][1]
                if (z.text[a].isascii() and z.text[a].isalnum() or z.text[a] in "+(_-%.") and (z.text[b - 1].isascii() and z.text[b - 1].isalnum() or z.text[b - 1] in "=_-"):
                    every += [(i, j, *f) for f in pii.span_features(z.text[a:b], z.text[max(0, a - 16) : a], z.text[b : b + 2])]
        assert [c for c in pii.candidates(z) if c[1] - c[0] <= pii.MOST_TOKENS] == every


def test_long_zones_are_cut_at_blanks():
    text = " ".join(f"{k * 7919}" for k in range(900))
    parts = list(pii._parts(text))
    assert "".join(parts) == text and max(map(len, parts)) <= pii.LONGEST and all(p.startswith(" ") for p in parts[1:])
    assert "".join(pii._parts("1" * 2000)) == "1" * 2000
