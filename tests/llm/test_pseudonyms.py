import datetime
import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from driftwell.llm import pseudonyms
from tests.llm.helpers import frame


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_ok(text):
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def shape(text):
    return re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", text)))


VALUES = {
    "email": ["und.34@mail7.example.com", "A.b+c@x-y.org"],
    "date": ["2024-02-29", "31.12.1999", "05/11/2001", "12/31/2001"],
    "ip": ["233.254.104.120", "1.2.3.4"],
    "ssn": ["123-45-6789", "899-01-0001"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "card": ["4111 1111 1111 1111", "9807915762804490", "378282246310005", "4111-1111-1111-1111"],
    "phone": ["+1 (017) 555-7713", "+49 30 1234 5678", "(030) 123 4567", "555-123-4567"],
}
NOT = ["2023-02-29", "31/31/2001", "300.1.2.3", "000-12-3456", "DE89 3704 0044 0532 0130 01x", "v1.2.3.4.5", "b44e15e09fd311c3", "12345", "1,234,567", "a1b2"]


def clean(spark, texts):
    out = pseudonyms.pseudonymised(frame(spark, list(enumerate(texts)))).collect()
    return [r for r in sorted(out, key=lambda r: r.doc_id)]


def test_formats_checks_and_links(spark):
    texts, want = [], []
    for kind, values in VALUES.items():
        for v in values:
            texts += [f"Before {v}, after.\n", f"{v}!! {v}%%%"]
            want += [(kind, v)] * 2
    for row, (kind, v), text in zip(clean(spark, texts), want, texts, strict=True):
        times = text.count(v)
        assert row[f"n_{kind}"] == row.n_found == times, (kind, v, row)
        new = re.fullmatch(re.escape(text).replace(re.escape(v), "(.*?)"), row.clean_text, re.S)
        assert new and len(set(new.groups())) == 1, (text, row.clean_text)
        got = new.group(1)
        assert got != v
        if kind != "ip":
            assert shape(got) == shape(v), (v, got)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", got)) or not luhn(re.sub(r"\D", "", v))
        if kind == "iban":
            assert iban_ok(got)
        if kind == "ip":
            assert all(0 <= int(x) <= 255 for x in got.split("."))
        if kind == "date":
            form = {"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y" if v == "12/31/2001" else "%d/%m/%Y"}[next(c for c in v if not c.isdigit())]
            datetime.datetime.strptime(got, form)
        if kind == "ssn":
            assert not re.match(r"000|666|9|...-00|...-..-0000", got)


def test_what_does_not_check_stays(spark):
    texts = [f"x {v} y" for v in NOT] + [None, "", "no numbers", "é" * 3000]
    for row, text in zip(clean(spark, texts), texts, strict=True):
        assert (row.clean_text, row.n_found) == (text, 0)


def test_permutations_never_collide(spark):
    small = spark.range(73048).select(pseudonyms.feistel(F.col("id"), 184, 397, "t", "k").alias("x"))
    assert small.agg(F.min("x"), F.max("x"), F.count_distinct("x")).first() == (0, 73047, 73048)
    for n in (1, 3, 4):
        digits = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        out = digits.select(pseudonyms.permuted_digits(F.col("d"), "t", "k").alias("x")).agg(F.count_distinct("x"), F.min(F.length("x")), F.max(F.length("x"))).first()
        assert out == (10**n, n, n)
    rng = random.Random(1)
    cards = [("".join(rng.choices("0123456789", k=16)),) for _ in range(2000)]
    out = spark.createDataFrame(cards, "c string").select(pseudonyms.permuted_digits(F.col("c"), "t", "k").alias("x")).distinct().count()
    assert out == len(set(cards))


def test_keys_differ_and_odd_tables(spark):
    df = frame(spark, [(1, "card 4111 1111 1111 1111"), (1, "card 4111 1111 1111 1111"), (None, "1.2.3.4"), (2, "word " * 100000 + "1.2.3.4")])
    df = df.withColumns({c: F.lit("z") for c in ("matches", "known", "clean_text", "n_ip")})
    a, b = pseudonyms.pseudonymised(df).collect(), pseudonyms.pseudonymised(df, "other").collect()
    by = lambda rows: {(r.doc_id, r.clean_text[-30:]) for r in rows}
    assert len(a) == 4 and len(by(a)) == 3 and not by(a) & by(b)
    ips = [r.clean_text.split()[-1] for r in a if r.n_ip]
    assert len(ips) == 2 and ips[0] == ips[1]
    assert pseudonyms.pseudonymised(frame(spark, [])).count() == 0


def undone(address, key=pseudonyms.KEY):
    """The address an e-mail pseudonym stands for."""
    head = re.match(r".*?@[^.]*", address).group()
    rest, low = address[len(head):], head.lower()
    tweak = re.sub("[0-9]", "9", re.sub("[a-z]", "a", low)) + rest.lower()
    symbols = re.sub("[^a-z0-9]", "", low)
    halves = [symbols[:len(symbols) // 2], symbols[len(symbols) // 2:]]
    for i in reversed(range(pseudonyms.ROUNDS)):
        half, other = halves[i % 2], halves[1 - i % 2]
        digests = (hashlib.sha512(f"{key}|email|{tweak}|{i}|{n}|{other}".encode()).hexdigest() for n in range(len(half) // 32 + 1))
        stream = "".join(digests)
        by = [int(stream[at * 4:at * 4 + 4], 16) for at in range(len(half))]
        halves[i % 2] = "".join(str((int(c) - n) % 10) if c.isdigit() else chr((ord(c) - 97 - n) % 26 + 97) for c, n in zip(half, by, strict=True))
    back = iter("".join(halves))
    return "".join((next(back).upper() if c.isupper() else next(back)) if c.isalnum() else c for c in head) + rest


def test_addresses_never_collide_and_can_be_undone(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    addresses = [f"{a}{b}@{c}.org" for a, b, c in itertools.product(letters, repeat=3)] + [f"{i:03}@qq.com" for i in range(1000)]
    addresses += ["A.b+c@X-y.org", "a.b+c@x-y.org", "_@-.org", "a@-.org", "Z" * 90 + "7@" + "q1" * 50 + ".Example.COM"]
    df = spark.createDataFrame([(a,) for a in addresses], "a string").select("a", pseudonyms.email_pseudonym(F.col("a"), pseudonyms.KEY).alias("x"))
    got = {r.a: r.x for r in df.collect()}
    assert len(set(got.values())) == len(addresses)
    assert all(shape(x) == shape(a) and undone(x) == a for a, x in got.items())
    assert got["A.b+c@X-y.org"].lower() == got["a.b+c@x-y.org"]  # one mailbox in either spelling stays linked


IBANS = ["ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "SE45 5000 0000 0583 9825 7466",
         "HU42 1177 3016 1111 1018 0000 0000", "PL61 1090 1014 0000 0712 1981 2874", "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32"]
LONG = next(n for n in (f"6200 0000 0000 0001 23{d}" for d in range(10)) if luhn(n.replace(" ", "")))
CARDS = ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "378282246310005"]


def test_values_before_capitals_and_digits(spark):
    after = [".", " BIC CAIXESBB", " EUR 50", " EUR", " 2024", " 12", " A1"]
    texts = [f"to {v}{a}" for v in IBANS for a in after]
    rows = clean(spark, texts)
    for i, v in enumerate(IBANS):
        own = rows[i * len(after):(i + 1) * len(after)]
        new = own[0].clean_text[3:-1]
        assert iban_ok(new) and new != v
        assert [(r.clean_text, r.n_iban, r.n_found) for r in own] == [(f"to {new}{a}", 1, 1) for a in after]
    after = [".", " 123", " 1234", " EUR 50", " 12 27", " 7"]
    rows = clean(spark, [f"card {v}{a}" for v in CARDS + [LONG] for a in after])
    for i, v in enumerate(CARDS + [LONG]):
        own = rows[i * len(after):(i + 1) * len(after)]
        new = own[0].clean_text[5:-1]
        assert luhn(re.sub(r"\D", "", new)) and new != v
        assert [(r.clean_text, r.n_card, r.n_found) for r in own] == [(f"card {new}{a}", 1, 1) for a in after], v


def test_values_one_after_another(spark):
    text = f"\ufdd0 {CARDS[3]} {CARDS[0]} 123 \ufdd0\ufdd2{CARDS[3]} {CARDS[3]} {CARDS[3]} {CARDS[0]} 7 {IBANS[2]} {CARDS[0]} 1.2.3.4"
    alone = [r.clean_text for r in clean(spark, [CARDS[0], CARDS[3], IBANS[2], "1.2.3.4"])]
    row, = clean(spark, [text])
    want = text.replace(CARDS[0], alone[0]).replace(CARDS[3], alone[1]).replace(IBANS[2], alone[2]).replace("1.2.3.4", alone[3])
    assert (row.clean_text, row.n_card, row.n_iban, row.n_ip) == (want, 7, 1, 1)
