import hashlib
import random
import re

import pytest
from cases import DOCS, docs, write

from tallyrock.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    "a@b.com_x@d.org 1.2.3.4.5.6.7.8 001.2.3.4 999.1.1.1 0000256.1.1.1 4111 1111 1111 1111, +1 (212) 555-0100 a@b.com", "é@x.y ünï a@b.c.d. 0000000000000000 ++12345678 +1-2-3-4-5-6-7-8 -", "1 2 " * 4000, "9" * 20000 + "@" * 5, " ".join(f"u{i}@h.com" for i in range(700)),
    "4111-1111-1111-1111 5500 0000 0000 0004 1.1.1.1.+49 30 1234567", "a@b", "@@ . +", "x" * 30000 + "@y.zz", "\n1.2.3.4\n\t+123456789\r\n",
]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + k, t) for k, (_, t) in enumerate(DOCS)]
    for r in pii.find_spans(docs(spark, rows)).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii_spans if s.kind in pii.BASE] == brute(r.text), r.doc_id


@pytest.mark.parametrize("text, kinds", [
    ("IBAN: DE89370400440532013000", ["iban"]), ("pay to DE89 3704 0044 0532 0130 00 now", ["iban"]), ("DE88370400440532013000 is no account", []), ("SSN 123-45-6789", ["id_number"]), ("part 123-45-6789", []),
    ("call (212) 555-0100 today", ["local_phone"]), ("order 212 555 0100", []), ("serial DE89370400440532013000", []), ("account, serial DE89370400440532013000", ["iban"]), ("serial no or ssn 123-45-6789", []), ("call for sku 212 555 0100", []),
])
def test_scored_kinds(spark, text, kinds):
    spans = pii.find_spans(docs(spark, [(1, text)])).first().pii_spans
    assert [s.kind for s in spans if s.kind not in pii.BASE] == kinds


SCORED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}


def mod97(m):
    plain = m.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def brute_scored(text):
    out = []
    for kind, pattern in SCORED.items():
        end = 0
        for m in re.finditer(pattern, text):
            before, end = text[end : m.start()][-40:].lower(), m.end()
            points = {"iban": 10, "id_number": 30, "local_phone": 20}[kind] + (60 if kind == "iban" and mod97(m[0]) else 0)
            points += {"iban": 20, "id_number": 50, "local_phone": 50}[kind] * any(w in before for w in {"iban": ("iban", "account", "konto", "compte", "cuenta"), "id_number": ("ssn", "social security", "security number"), "local_phone": ("phone", "call", "tel", "mobile", "fax")}[kind])
            points -= 20 * any(w in before for w in ("serial", "model", "version", "order no", "part no", "sku", "isbn", "checksum"))
            if points >= 70 and (kind != "iban" or mod97(m[0])):
                out.append((kind, m.start(), m.end()))
    return out


def test_scored_kinds_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["iban", "konto ", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE88370400440532013000", "ssn", "123-45-6789", "phone:", "(212) 555-0100", "212.555.0100", "serial ", "sku", "model", "tel", "é", "a much longer piece of text that keeps words away", "x", ",", "FR14 2004 1010 0505 0001 3M02 606"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))) for i in range(400)]
    met = set()
    for r in pii.find_spans(docs(spark, rows)).collect():
        got = [(s.kind, s.start, s.end) for s in r.pii_spans if s.kind not in pii.BASE]
        assert got == brute_scored(r.text), r.text
        met.update(k for k, *_ in got)
    assert met == set(SCORED)


def test_redaction(spark):
    rows = [(1, "mail a@b.com or +1 (212) 555-0100, 1.2.3.4!"), (2, None), (3, ""), (4, "4111111111111111"), (5, "😀 x@y.zz 😀")]
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redacted(docs(spark, rows, clashes=True)).collect()}
    assert got[1] == ("mail [EMAIL] or [PHONE], [IP]!", 30) and got[2] == (None, 0) and got[3] == ("", 0) and got[4] == ("[CARD]", 6) and got[5][0] == "😀 [EMAIL] 😀"


def test_query(spark, tmp_path):
    rows = [*DOCS, (50, TEXTS[0])]
    d = write(spark, tmp_path, documents=docs(spark, rows, clashes=True))
    got = pii.op8_pii(spark, d).collect()
    assert len(got) == len(rows)
    r = next(x for x in got if x.doc_id == 50)
    spans = brute(TEXTS[0])
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest() and r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert r.n_email == 3 and write(spark, tmp_path / "e", documents=docs(spark, [])) and pii.op8_pii(spark, str(tmp_path / "e")).count() == 0


def test_no_python_in_plan(spark):
    assert "Python" not in pii.find_spans(docs(spark))._jdf.queryExecution().toString()
