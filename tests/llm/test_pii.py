import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import pii, queries

FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in FIXED.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(d) <= 19 and pii.luhn(d),
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [(s.kind, s.start, s.end) for s in pii.spans(text) if s.kind in pii.BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+_%1234567890 ()xé", max_size=60))
def test_base_is_the_plain_reading(text):
    assert base(text) == brute(text)


def test_query(spark, docs):
    got = {r["doc_id"]: r for r in queries.op3_pii(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        want = brute(r["text"])
        g = got[r["doc_id"]]
        assert [g[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS]
        assert g["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % x for x in want).encode()).hexdigest()


def test_checksums_and_context():
    assert [s.kind for s in pii.spans("iban GB82 WEST 1234 5698 7654 32.")] == ["iban"]
    assert pii.spans("GB83 WEST 1234 5698 7654 32") == []
    assert [s.kind for s in pii.spans("social security 123-45-6789")] == ["ssn"]
    assert pii.spans("part 123-45-6789 of") == []
    assert pii.redact("call +44 20 7946 0958 or jo@ex.org") == "call <PHONE> or <EMAIL>"


def test_iban_before_other_words():
    for iban in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"):
        for before in ("", "AB12 ", "REF 2024 DE12 "):
            for after in ("", " BIC COBADEFFXXX", " I said", " 00 2024", " 2024.", " MT84 MALT 0110 0001 2345 MTLC AST0 01S", " " + iban):
                found = [(s.start, s.end) for s in pii.spans(before + iban + after) if s.kind == "iban"]
                assert (len(before), len(before + iban)) == found[0]
                assert len(found) == (2 if len(after) > 17 else 1)
    assert pii.redact("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX") == "<IBAN> BIC COBADEFFXXX"


def test_linear_on_many_iban_starts():
    pii.spans("DE12 " * 40_000 + "ZZ12 " * 40_000)


def test_linear_on_long_runs():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1" + " " * 100_000, "A1" * 100_000, "1-" * 100_000):
        pii.spans(t)


def test_odd(odd, empty):
    rows = pii.summary(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["pii"]["base_sha256"] for r in rows)
    assert pii.redacted(empty).count() == 0 and pii.find(odd).count() == odd.count()
    assert [r["text"] for r in pii.redacted(odd.filter("doc_id = 3")).collect()] == [None]
