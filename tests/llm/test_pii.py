"""The anchor-expansion parsers against the base patterns run by ``re``."""
import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from stargraph.llm import pii

ANCHORS = pii.automaton()


def brute(text):
    out = {kind: [m.span() for m in re.finditer(pattern, text)] for kind, pattern in pii.BASE.items()}
    digits = lambda a, b: re.sub("[^0-9]", "", text[a:b])
    out["ip"] = [(a, b) for a, b in out["ip"] if all(int(x) <= 255 for x in text[a:b].split("."))]
    out["card"] = [(a, b) for a, b in out["card"] if 16 <= len(digits(a, b)) <= 19 and luhn(digits(a, b))]
    out["phone"] = [(a, b) for a, b in out["phone"] if 8 <= len(digits(a, b)) <= 15]
    return out


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (2 if i % 2 else 1)
        s += v if v < 10 else v - 9
    return s % 10 == 0


def check(text):
    found = pii.spans(text, ANCHORS)
    assert {k: found[k] for k in pii.BASE} == brute(text), text


PIECES = ["a", "Z.", "@", "@@", ".", "..", "1", "255", "256.", "0", "+", "+1", " ", "-", "(555)", "4111111111111111", "x@y.z",
          "1.2.3.4", "é", "\n", "_%", "12 34-56", "mail9.example.com", "//", ":", "+49 30 1234567", "٣", "𝟙"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_base_kinds_match_the_patterns(pieces):
    check("".join(pieces))


def test_fixed_cases():
    for text in ["", "a@b.c@d.e", "a@b@c.d", "x@y.z.@q.w", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "+1 (643) 555-5742",
                 "+1", "+12", "+123", "+1.2", "+1 ", "999.1.1.1 1.1.1.1", "00000000255.1.1.1", "9" * 5000, "1." * 3000, "@" * 3000]:
        check(text)


def test_long_texts_stay_linear():
    for text in ["a" * 400_000, "1" * 400_000, "1 " * 200_000, "+1" * 200_000, "a@" * 200_000, "://" * 100_000]:
        pii.spans(text, ANCHORS)


def test_added_kinds():
    text = "See https://user@shop.example.com:8080/a?b=1). IBAN: DE89 3704 0044 0532 0130 00 and account no 12-345678; iban x"
    found = pii.spans(text, ANCHORS)
    assert [text[a:b] for a, b in found["address"]] == ["https://user@shop.example.com:8080/a?b=1"]
    assert [text[a:b] for a, b in found["account"]] == ["DE89 3704 0044 0532 0130 00", "12-345678"]
    assert not any(pii.spans("The account of the iban was http:// and compte le", ANCHORS).values())


def test_cues_of_any_case_and_grouped_accounts():
    cases = {
        "Customer ID: 12345678": "12345678", "Tax ID 123456789": "123456789", "\u0130\u0130 cUSTOMER iD 99887766, x": "99887766",
        "Account 1234 5678 9012": "1234 5678 9012", "SSN 123 45 6789.": "123 45 6789", "account no: 123456 789012 now": "123456 789012",
        "Account 1234 5678 9012 3rd USD": "1234 5678 9012", "Account 12345678 USD 500": "12345678", "ssn 123-45-6789 2024": "123-45-6789",
    }
    for text, value in cases.items():
        assert [text[a:b] for a, b in pii.spans(text, ANCHORS)["account"]] == [value], text


def test_report(spark):
    rows = [(1, "mail a.b@c.de now 1.2.3.4", "x"), (2, None, "x"), (None, "", "y"), (1, "mail a.b@c.de now 1.2.3.4", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = {(r.doc_id, r.spans): r for r in pii.report(docs).collect()}
    assert len(pii.report(docs).collect()) == 4
    row = got[(1, "email:5:13,ip:18:25")]
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 0, 0)
    assert row.base_sha256 == hashlib.sha256(b"email:5:13,ip:18:25").hexdigest()
    assert got[(2, "")].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.report(docs.limit(0)).count() == 0
