import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelforge.llm import queries as Q
from panelforge.llm import secrets as S
from panelforge.llm.pii import pseudonymise, pseudonymised_documents

from .helpers import ODD, docs

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def plain_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def said(spans):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


TRICKY = [
    (60, 'token: token: abcdefghijklmnop', None, None),
    (61, 'API_KEY = "abcDEF123456" apikey:\'x.y-z_1234567\' 日本 Secret=é PASSWD=aaaaaaaaaaaa', None, None),
    (62, "AKIAAKIA AKIA" + "A" * 13 + " AKIA" + "B" * 14 + "x" + "0123456789abcdef" * 3, None, None),
    (63, "\U0001f600 password=deadbeefdeadbeef00 \U0001f600 " + "ab" * 5000, None, None),
    (64, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### 4785380592391139', None, None),
    (65, "password= =x secret:   'zzzzzzzzzzzz", None, None),
]


def test_base_spans(spark):
    rows = [*ODD, *TRICKY]
    d = docs(spark, rows)
    found = S.scan(d).select("row.doc_id", F.size("assign").alias("a"), F.size("access").alias("k"), F.size("hex").alias("h"), S.listed("assign", "access", "hex").alias("base")).collect()
    assert len(found) == len(rows)
    by = {}
    for i, t, *_ in rows:
        by.setdefault(i, []).append(said(plain_base(t)))
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(r.base)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by.items()}
    assert S.scan(d.where("false")).count() == 0


def test_query_against_plain(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op7_randomness_battery(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(said(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert {*filter(None, said(base).split(","))} <= {*r.spans.split(",")}


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def plain_battery(token):
    """(length, p) straight from the definition; None if too short."""
    body = re.sub("[=_-]", "", token)
    if len(body) < 16:
        return None
    up, low, dig = string.ascii_uppercase, string.ascii_lowercase, string.digits
    alphabet = next(a for a, of in ((dig, dig), (dig + "abcdef", dig + "abcdef"), (dig + "ABCDEF", dig + "ABCDEF"), (low, low), (up, up), (up + "234567", up + "234567"), (dig + up, dig + up), (dig + low, dig + low), (up + low, up + low), (up + low + dig, up + low + dig), (up + low + dig + "+/", up + low + dig + "+/")) if set(body) <= set(of))
    n, k = len(body), len(alphabet)
    off = 1.0 if k <= 16 else 0.06 * k - 1
    chi2 = sum(c * c for c in Counter(body).values()) * k / n - n
    lam, df = n * off, k - 1
    scale, dof = (df + 2 * lam) / (df + lam), (df + lam) ** 2 / (df + 2 * lam)
    p_chi = phi((max(chi2 / scale / dof, 1e-9) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof)))
    v = [alphabet.index(c) for c in body]
    high = [2 * x >= k for x in v]
    changes = sum(a != b for a, b in zip(high, high[1:]))
    sd = math.sqrt((n - 1) * 0.16)
    p_runs = max(1 - phi((changes - 0.2 * (n - 1)) / sd), 1 - phi((0.8 * (n - 1) - changes) / sd))
    mean = sum(v) / n
    own = sum((x - mean) ** 2 for x in v)
    if not own:
        return n, 1.0
    r = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / own
    return n, max(p_chi, p_runs, phi((r - 0.6) * math.sqrt(n) / 0.8), phi((-r - 0.6) * math.sqrt(n) / 0.8))


def plain_spans(texts):
    """Every random span by the plain battery and the exact Benjamini-Hochberg procedure."""
    tested = []
    for i, t in texts.items():
        base = plain_base(t)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", t or ""):
            if (got := plain_battery(m[0])) and not any(s <= m.start() and e >= m.end() for s, _, e in base):
                tested.append((*got, i, m.start(), m.end()))
    out = {}
    for lo, hi in ((0, 31), (31, 47), (47, 79), (79, 10**9)):
        own = sorted(x[1:] for x in tested if lo < x[0] <= hi)
        passed = max((k for k, x in enumerate(own, 1) if x[0] <= 0.05 * k / len(own)), default=0)
        for p, i, s, e in own[:passed]:
            out.setdefault(i, set()).add((s, e))
    return out


def planted():
    """Texts with keys no base pattern finds, and texts with long ordinary tokens."""
    r = random.Random(3)
    chars = string.ascii_letters + string.digits
    take = lambda a, n: "".join(r.choices(a, k=n))
    strong, weak = [], []
    for _ in range(40):
        strong += [take(chars, 40), "sk_live_" + take(chars, 32), take(string.ascii_letters, 48), take(string.ascii_uppercase + "234567", 52), "_".join(take(string.digits, 12) for _ in range(5)), take(chars + "+/", 43) + "=", "-".join(take("0123456789ABCDEF", n) for n in (12, 12, 12, 12))]
    weak = ["ab1" * 16, "a1" * 24, "0123456789abcdefghij0123456789abcdefghij", "x" * 30 + "1" * 10, "aaaaaaaaaabbbbbbbbbbcccccccccc1111111111", "https/www/example/images/of-the-summer-holidays", "getUserAccountInformationByIdentifier", "this-is-a-rather-long-title-of-a-page-2021-10", "internationalization_of_the_application", "/usr/local/share/applications/settings/defaults", "1234567890123456789012345678901234567890", "2021-01-01-2021-12-31-2022-01-01-2022-12-31"] * 20
    return [f"see {t} here" for t in strong], [f"see {t} here" for t in weak]


def test_battery_adds_planted_keys_and_leaves_ordinary_tokens(spark):
    strong, weak = planted()
    texts = dict(enumerate(strong + weak))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: {(s.start, s.end) for s in x.random} for x in S.scan(d).select("row.doc_id", "random").collect()}
    found = sum(bool(got[i]) for i in range(len(strong)))
    wrong = sum(bool(got[i]) for i in range(len(strong), len(texts)))
    print(found, "of", len(strong), "planted keys;", wrong, "of", len(weak), "ordinary tokens")
    assert found >= 0.9 * len(strong) and wrong <= 0.05 * (found + wrong)
    want = plain_spans(texts)
    differ = [i for i in texts if got[i] != want.get(i, set())]
    assert len(differ) <= 0.01 * len(texts)  # thresholds are ends of bins: never above the exact ones
    assert all(got[i] <= want.get(i, set()) for i in texts)


def test_battery_equals_the_plain_one(spark):
    strong, weak = planted()
    tokens = sorted({t.split()[1] for t in strong + weak})
    d = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = {r.t: r.b for r in d.select("t", S.battery(F.col("t")).alias("b")).collect()}
    for t in tokens:
        n, p = plain_battery(t)
        assert got[t].n == n and abs(got[t].p - p) < 1e-6


def test_many_matches_and_clashing_names(spark):
    text = "deadbeefdeadbeef00 " * 32_000
    d = spark.createDataFrame([(1, text, "x", "y")], "doc_id long, text string, assign string, token string")
    start = time.monotonic()
    row = S.scan(d).select("row.*", "hex").first()
    assert len(row.hex) == 32_000 and (row.hex[-1].start, row.hex[-1].end) == (19 * 31_999, 19 * 31_999 + 18)
    assert row.assign == "x" and row.token == "y"
    assert time.monotonic() - start < 60


# ------------------------------------------------------------------ PII
def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        x = int(c)
        t += (2 * x - 9 * (x > 4)) if i % 2 else x
    return t % 10 == 0


def one(spark, texts, key="k"):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.row.doc_id: r for r in pseudonymise(d, key).collect()}


def test_formats_and_links(spark):
    texts = [
        "mail Jo.Do7@mail3.example.com### card 4785380592391139$$$ ip 152.143.123.131, tel +1 (743) 555-3824.",
        "again 4785-3805-9239-1139 and Jo.Do7@mail3.example.com",
        "ssn 123-45-6789 no 000-12-3456 born 2001-02-28, 29.02.2000 or 12/31/1999 or 31/12/1999, not 2001-02-30",
        "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 not DE88370400440532013000",
        "no pii: 1234567890123456, 300.1.1.1, 2.1, v1.2.3, 3.84.50, password=7088f6575978b7e80d",
        "call +44 20 7946 0958 or (212) 555-0100 or 212-555-0100",
    ]
    r = one(spark, texts)
    m = re.fullmatch(r"mail ([A-Z][a-z]\.[A-Z][a-z][0-9])@mail3\.example\.com### card ([0-9]{16})\$\$\$ ip ([0-9.]+), tel \+1 \(([2-9][0-9]{2})\) ([2-9][0-9]{2})-([0-9]{4})\.", r[0].text)
    assert m and m[1] != "Jo.Do7" and m[2] != "4785380592391139" and luhn(m[2]) and m[2][0] == "4"
    assert all(0 <= int(x) <= 255 for x in m[3].split(".")) and m[3] != "152.143.123.131"
    card = "-".join(m[2][i : i + 4] for i in range(0, 16, 4))
    assert r[1].text == f"again {card} and {m[1]}@mail3.example.com"
    n = re.fullmatch(r"ssn ([0-9]{3})-([0-9]{2})-([0-9]{4}) no 000-12-3456 born ([0-9]{4}-[0-9]{2}-[0-9]{2}), ([0-9]{2}\.[0-9]{2}\.[0-9]{4}) or ([0-9]{2}/[0-9]{2}/[0-9]{4}) or ([0-9]{2})/([0-9]{2})/([0-9]{4}), not 2001-02-30", r[2].text)
    assert n and n[1] not in ("000", "666") and n[2] != "00" and int(n[7]) > 12 and n[4] != "2001-02-28"
    ibans = re.fullmatch(r"iban (DE[0-9]{2}(?: [0-9]{4}){4} [0-9]{2}) and (GB[0-9]{2}WEST[0-9]{14}) not DE88370400440532013000", r[3].text)
    for x in ibans.groups():
        x = x.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert r[4].text == texts[4] and r[4].found == []
    assert re.fullmatch(r"call \+44 [0-9]{2} [0-9]{4} [0-9]{4} or \([0-9]{3}\) [0-9]{3}-[0-9]{4} or [0-9]{3}-[0-9]{3}-[0-9]{4}", r[5].text) and r[5].text != texts[5]
    assert [(f.kind, texts[0][f.start : f.end]) for f in r[0].found] == [("email", "Jo.Do7@mail3.example.com"), ("card", "4785380592391139"), ("ip", "152.143.123.131"), ("phone", "+1 (743) 555-3824")]
    other = one(spark, texts[:1], key="another")
    assert other[0].text != r[0].text


@pytest.mark.parametrize("form", ["ssn", "phone", "odd", "date", "card"])
def test_one_to_one(spark, form):
    r = random.Random(1)
    make = {
        "ssn": lambda i: f"{1 + i % 600:03d}-{1 + i % 99:02d}-{1 + i:04d}",
        "phone": lambda i: f"(212) 555-{i:04d}",
        "odd": lambda i: f"+1 ({i % 200:03d}) 555-{i:04d}",
        "date": lambda i: f"{1950 + i // 300}-{1 + i // 25 % 12:02d}-{1 + i % 25:02d}",
        "card": lambda i: next(s for c in "0123456789" if luhn(s := f"4000{i:011d}{c}")),
    }[form]
    values = sorted({make(i) for i in r.sample(range(1, 3000), 400)})
    out = one(spark, values)
    assert len({x.text for x in out.values()}) == len(values)
    assert sum(out[i].text == v for i, v in enumerate(values)) <= 1


def test_odd_rows(spark):
    rows = [*ODD, (70, "a@b.co " * 2000 + "\U0001f600 x@y.zz", "en", "a")]
    d = docs(spark, rows)
    out = pseudonymised_documents(d, "k")
    assert out.columns == d.columns
    texts = sorted((x.text or "", x.text is None) for x in out.collect() if x.doc_id != 70)
    assert texts == sorted((t or "", t is None) for i, t, *_ in rows if i != 70)
    last = pseudonymise(d, "k").where("row.doc_id = 70").first()
    assert len(last.found) == 2001 and all(rows[-1][1][f.start : f.end] in ("a@b.co", "x@y.zz") for f in last.found)
    assert pseudonymise(d.where("false"), "k").count() == 0


def test_query_leaves_no_value(spark, sf):
    rows = Q.op5_feistel_pseudonyms(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    find = re.compile(r"[\w.+-]+@[\w.-]+\.[a-z]{2,}|\b[0-9]{16}\b|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}")
    changed = 0
    for r in rows:
        values = [v for v in find.findall(texts[r.doc_id]) if not re.fullmatch("[0-9]{16}", v) or luhn(v)]
        assert not any(v in r.text for v in values)
        changed += bool(values)
        if not values and not r.n_found:
            assert r.text == texts[r.doc_id]
    assert changed > 5 and len(rows) == len(texts)


def test_emails_after_signs_are_found(spark):
    text = "_jo@x.com_ and -jo@x.com or ...jo@x.com, jo@x.com_jo@x.com"
    row = pseudonymise(docs(spark, [(1, text)]), "k").first()
    assert [(f.kind, text[f.start : f.end]) for f in row.found] == [("email", "jo@x.com")] * 5
    values = re.findall(r"[a-z]+@x\.com", row.text)
    assert len(values) == 5 and len(set(values)) == 1
    assert re.sub(r"[a-z]+@", "jo@", row.text) == text


def plain_digits(d, key, rounds=8):
    """The Feistel permutation of a string of digits, straight from the definition."""
    n = len(d)
    a, b = 10 ** -(-n // 2), 10 ** (n // 2)
    f = lambda i, v: int(hashlib.sha256(f"{key}:{i}:{v}".encode()).hexdigest()[:15], 16)
    left, right = divmod(int(d), b)
    for i in range(rounds):
        if i % 2 == 0:
            left = (left + f(i, right)) % a
        else:
            right = (right + f(i, left)) % b
    return str(left * b + right).rjust(n, "0")


def test_cards_equal_the_plain_network(spark):
    r = random.Random(2)
    cards = []
    while len(cards) < 50:
        d = "".join(r.choices("0123456789", k=r.choice((13, 15, 16, 19))))
        if luhn(d):
            cards.append(d)
    out = one(spark, [f"card {c}." for c in cards])
    for i, c in enumerate(cards):
        body = c[0] + plain_digits(c[1:-1], "kcard")
        want = next(body + x for x in "0123456789" if luhn(body + x))
        assert out[i].text == f"card {want}."


def test_many_values_in_one_text(spark):
    start = time.monotonic()
    row = pseudonymise(spark.createDataFrame([(1, "a@b.co " * 8_000)], "doc_id long, text string"), "k").first()
    assert len(row.found) == 8_000 and (row.found[-1].start, row.found[-1].end) == (7 * 7_999, 7 * 7_999 + 6)
    assert len(set(row.text.split())) == 1
    print(round(time.monotonic() - start, 1), "s for 8,000 addresses")
    with pytest.raises(ValueError):
        pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")
