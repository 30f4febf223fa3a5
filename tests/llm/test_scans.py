"""Spans of personal data and secrets: added kinds against plain patterns, awkward rows, and time on large texts."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depscope.llm import decontam, exact, langid, near, packing, pii, quality, rangecode, repeats, secretscan

SCHEMA = "doc_id long, text string, id string, spans int, kind string, start int"
BITS = ["token", "secret", "api_key", ": ", "=", '"', "abc", "eyJ", ".", "AKIA", "Q9", "a1b2", " ", "password", "ghp_", "-----BEGIN RSA PRIVATE KEY-----", "0" * 9, "f" * 13, "é"]
PERSONAL = ["account", "Acct", "iban", " no. ", " ", "-", ":", "DE12", "3456", "7890", "x", "http://", "ssh://", "u", ":p", "@", "h.org", ":80", "/", "é", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=30))
def test_secrets_are_those_of_the_patterns(bits):
    data = "".join(bits).encode()
    want = sorted(
        (m.start(), k, m.end())
        for k, r in enumerate(secretscan.RULES)
        for m in re.finditer(r.pattern.encode(), data, re.IGNORECASE if r.ignore_case else 0)
        if r.check is None or r.check(m[0])
    )
    assert scanner().spans(data) == want


def scanner(made=[]):  # noqa: B006
    if not made:
        made.append(secretscan.Scanner())
    return made[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PERSONAL), max_size=30))
def test_urls_and_accounts_are_those_of_the_patterns(bits):
    """Left to right: an address with credentials; a cue at a word's start and an identifier of 8 signs, 6 of them digits."""
    text = "".join(bits)
    want, done = [], 0
    for m in re.finditer(r"(https?|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://", text):
        if m.start() >= done and (n := re.compile(r"[A-Za-z0-9._~%+-]+:[^\s@/]+@[A-Za-z0-9.-]+(:[0-9]+)?").match(text, m.end())):
            want.append(("url", m.start(), n.end()))
            done = n.end()
    done = 0
    for m in re.finditer(r"(?<!\w)(iban|IBAN|Iban|account|Account|ACCOUNT|acct|Acct|ACCT)", text):
        n = re.compile(r" ?(no\.?|number|nr\.?|#)? ?[:=#]? ?").match(text, m.end())
        lead = [re.compile(p).match(text, m.end()) for p in (r" ?(?:no\.?|number|nr\.?|#) ?[:=#]? ?(?=[A-Za-z0-9])", r" ?[:=#]? ?(?=[A-Za-z0-9])")]
        n = next((x for x in lead if x), None)
        if m.start() < done or n is None:
            continue
        words = re.compile(r"[A-Za-z0-9]+(?:[ -][A-Za-z0-9]+)*").match(text, n.end())[0]
        parts = re.split("([ -])", words)
        upto = next((k for k in range(2, len(parts), 2) if not re.search("[0-9]", parts[k])), len(parts) + 1) - 1
        value = "".join(parts[:upto])
        signs = re.sub("[ -]", "", value)
        if len(signs) >= 8 and sum(c.isdigit() for c in signs) >= 6:
            want.append(("account", n.end(), n.end() + len(value)))
            done = n.end() + len(value)
    got = [(pii.KINDS[k], s, e) for s, k, e in pii.Finder().spans(text) if k >= 4]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("text", ["account x ", "acct1 acct1 ", "iban-", "+1( ", "a@", "1.2.3.", "http://a:", "token: ", "eyJa.", "token=token", "AKIA", "ab", "password  "])
def test_large_texts_take_linear_time(text):
    both = []
    for size in (1 << 17, 1 << 20):
        t = text * (size // len(text))
        start = time.process_time()
        pii.Finder().spans(t)
        scanner().spans(t.encode())
        both.append(time.process_time() - start)
    assert both[1] < 24 * max(both[0], 0.05)  # 8 times the text; a square would take 64 times as long


def test_secret_behind_a_consumed_cue():
    data = b"token: token: " + b"b" * (1 << 20)
    assert [(s, e) for s, k, e in scanner().spans(data) if k == 0] == []
    assert [(s, e) for s, k, e in scanner().spans(b"token: abcdef token: " + b"g" * 9) if k == 0] == [(0, 13), (14, 30)]


def test_awkward_rows(spark):
    rows = [(1, None, "x", 1, "k", 2), (2, "", None, None, None, None), (None, "a@b.co", "x", 1, "k", 2), (3, "a@b.co", "x", 1, "k", 2), (3, "a@b.co", "x", 1, "k", 2), (4, "é " * 300000 + "AKIA" + "B" * 16 + " a@b.co", "x", 1, "k", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for find, kinds in ((pii.find_personal_data, pii.KINDS[:4]), (secretscan.find_secrets, secretscan.BASE)):
        found = pii.span_columns(find(docs), kinds)
        got = sorted((r["doc_id"] or -1, r["spans"]) for r in found.collect())
        mail, key = ("email:0:6", "email:600021:600027") if find is pii.find_personal_data else ("", "access:600000:600020")
        assert got == [(-1, mail), (1, ""), (2, ""), (3, mail), (3, mail), (4, key)]
        assert pii.span_columns(find(docs.limit(0)), kinds).count() == 0


def test_ids_of_another_type_are_refused_at_once(spark):
    from depscope.llm.queries import tokenizer_file

    docs = spark.createDataFrame([("a", "text", "en")], "doc_id string, text string, lang string")
    bench = spark.createDataFrame([("b", "text")], "item_id string, text string")
    file = tokenizer_file("word_bpe_49k.json")
    model = {"dicts": {}, "counts": {}}
    for call in (
        lambda: langid.predict(docs, model), lambda: pii.find_personal_data(docs), lambda: quality.predict(docs, {}), lambda: repeats.remove_repeats(docs), lambda: near.near_duplicates(docs),
        lambda: exact.exact_dedup(docs), lambda: decontam.find_benchmark(docs, bench), lambda: secretscan.find_secrets(docs), lambda: rangecode.id_columns(docs, file), lambda: packing.pack_documents(docs, file),
    ):
        with pytest.raises(TypeError):
            call()
