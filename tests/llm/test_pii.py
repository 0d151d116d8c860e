from __future__ import annotations

import hashlib
import random
import re
import string
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from twinkeep.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = [int(c) for c in digits(m[0])][::-1]
        if 13 <= len(d) <= 19:
            doubled = [sum(divmod(2 * x, 10)) for x in d[1::2]]
            if (sum(d[::2]) + sum(doubled)) % 10 == 0:
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def base(text):
    return [(s.kind, s.start, s.end) for s in pii.spans(text) if s.kind in pii.BASE_KINDS]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a0125.@+-() %é\n", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert base(text) == brute(text)


def test_long_numbers_match_the_patterns():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789 -.+()x") for _ in range(rng.randint(1, 80)))
        assert base(text) == brute(text)


def test_hard_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1 " * 100_000, "1." * 100_000, "AB12AAAA " * 50_000):
        pii.spans(text)


def test_added_kinds_and_context():
    iban = "IBAN GB82 WEST 1234 5698 7654 32 end"
    assert [s.kind for s in pii.spans(iban)] == ["iban"]
    assert not [s for s in pii.spans(iban.replace("82", "83")) if s.kind == "iban"]
    assert [s.kind for s in pii.spans("social security 123-45-6789")] == ["ssn"]
    assert pii.spans("code 123-45-6789") == []
    near, far = pii.spans("mail a@b.cd"), pii.spans("x a@b.cd")
    assert near[0].score > far[0].score


def test_frame(spark):
    long = "word " * 50_000 + "x@y.zz"
    data = [(1, "a@b.cd and é +1 555 123 4567", "k"), (1, "a@b.cd and é +1 555 123 4567", "k"),
            (2, None, None), (None, "", None), (3, long, "k")]
    docs = spark.createDataFrame(data, "doc_id long, text string, pii string")
    rows = pii.digest(pii.find_pii(docs)).collect()
    assert len(rows) == 5
    by = {r.doc_id: r for r in rows}
    assert by[1].n_email == by[1].n_phone == 1
    assert by[1].base_sha256 == hashlib.sha256(b"email:0:6,phone:13:28").hexdigest()
    assert by[2].n_email == 0 and by[None].spans == ""
    assert by[3].spans == "email:250000:250006"
    out = pii.find_pii(docs, mask=True).select("doc_id", "masked").collect()
    assert [r.masked for r in out][:4] == ["[EMAIL] and é [PHONE]"] * 2 + [None, ""]
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_masks_join_overlaps():
    spans = [pii.Span("card", 0, 10, 1), pii.Span("phone", 5, 12, 1), pii.Span("ip", 13, 14, 1)]
    assert pii.masked(string.ascii_letters[:16], spans) == "[CARD]m[IP]op"


def test_accounts_end_before_the_next_word():
    for account, after in (
        ("DE89 3704 0044 0532 0130 00", " Please pay"),
        ("DE89370400440532013000", " Bank"),
        ("DE89370400440532013000", " BIC COBADEFF"),
        ("FR14 2004 1010 0505 0001 3M02 606", " Paris"),
        ("GB82 WEST 1234 5698 7654 32", " 2024-01-02"),
        ("DE89370400440532013000", ""),
    ):
        text = f"IBAN {account}{after}"
        assert [(s.start, s.end) for s in pii.spans(text) if s.kind == "iban"] == [(5, 5 + len(account))]
        assert pii.masked(text, pii.spans(text)) == f"IBAN [IBAN]{after}"
        assert not [s for s in pii.spans(f"IBAN {account}X{after}") if s.kind == "iban"]


def test_accounts_in_a_row():
    text = "DE89370400440532013000 FR1420041010050500013M02606 GB82 WEST 1234 5698 7654 32 AB12"
    assert [text[s.start : s.end] for s in pii.spans(text) if s.kind == "iban"] == [
        "DE89370400440532013000", "FR1420041010050500013M02606", "GB82 WEST 1234 5698 7654 32",
    ]


def test_long_runs_of_digits_do_not_stop_a_task():
    for digit in "09":
        run = digit * 5000
        for text in (f"{run}.1.2.3", f"1.2.3.{run}", f"+{run}", f"4111 1111 1111 1111 {run}", f"DE{run}", f"a@{run}.{run}"):
            assert [s for s in pii.spans(text) if s.kind in pii.BASE_KINDS] is not None
    zeros = "0" * 5000 + ".1.2.3"
    assert [(s.kind, s.start, s.end) for s in pii.spans(zeros) if s.kind == "ip"] == [("ip", 0, len(zeros))]


def secrets(text):
    return [text[s.start : s.end] for s in pii.spans(text) if s.kind == "secret"]


def test_secrets():
    rng = random.Random(2)
    value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    for text in (f'token = "{value}"', f"API_KEY={value}", f"password: '{value}' x", f"Bearer {value}", f"authToken={value};",
                 f"client_secret := {value}.", f"the version and token = {value}"):
        assert secrets(text) == [value]
        assert value not in pii.masked(text, pii.spans(text)) and "[SECRET]" in pii.masked(text, pii.spans(text))
    issued = ["AKIA" + "ABCD1234" * 2, "ghp_" + "aB3" * 12, "eyJhbGciOi12.eyJzdWIiOi12.sig-nature1"]
    assert secrets(" ".join(issued)) == issued
    block = "-----BEGIN RSA PRIVATE KEY-----\nMIIab12\nxyz=\n-----END RSA PRIVATE KEY-----"
    assert secrets(f"a {block} b") == [block]
    for text in ("token = short1", f"commit {value}", "password: correcthorsebatterystaple", "token = " + "1" * 40,
                 "secret = a1a1a1a1a1a1a1a1a1", "the tokens of the parser are kept in a list of 16 items"):
        assert secrets(text) == []


def test_hard_secrets_stay_linear():
    for text in ("token" * 60_000, "token=" * 50_000, "token-" * 50_000, "eyJa" * 70_000, "xoxa-" * 60_000, "token " * 50_000,
                 "-----BEGIN PRIVATE KEY-----" * 10_000, "eyJaaaaaaaa1." * 20_000):
        began = time.perf_counter()
        pii.spans(text + " 1")
        assert time.perf_counter() - began < 4
