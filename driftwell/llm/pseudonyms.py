"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Numbers and dates that pass their checks are replaced by others of the same format: every format is a range of whole
numbers, and a Feistel network of keyed rounds permutes that range. Equal values get equal pseudonyms in all
documents, so they stay linked; different values never collide; and who holds the key can undo it.

What is found, the first that fits at a place:
    email     local part and first label of the domain: their letters and digits together are permuted by a Feistel
              network, a permutation for each shape and rest of the domain; letters keep their case
    date      a calendar day between 1900 and 2099, as 2024-01-31, 31.01.2024, 31/01/2024 or 01/31/2024
    ip        four numbers up to 255, permuted as one 32-bit number
    ssn       three, two and four digits with hyphens, outside the ranges that are never given out
    iban      two letters and two check digits that agree, as long as the country's are, or of any length for other
              countries; letters stay, digits move, check digits are made anew
    card      13 to 19 digits, with blanks or hyphens; where the Luhn check holds it also holds afterwards. Groups after
              a blank are only part of it if the check holds with them or with no shorter end
    phone     ten to fifteen digits with a plus sign or a bracketed area code; the country code stays
Digits that are part of a longer run of letters or digits are left alone.

All of it is column expressions. Texts without a match pass through unchanged and undecoded.

Defined cases: a null text stays null with no matches; dates that do not exist, addresses with numbers above 255 and
the like are not matches; a repeated row gives a repeated result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import pick

KEY = "driftwell"
ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73048  # 1900-01-01 to 2099-12-30: 184 x 397 days, an exact product
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"
IP = rf"{OCTET}(?:\.{OCTET}){{3}}"
SSN = r"\d{3}-\d{2}-\d{4}"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
OF_COUNTRY = "|".join(rf"(?:{codes.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
                      for n, codes in IBAN_LENGTHS.items())
IBAN = rf"(?:{OF_COUNTRY}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)"
CARD = r"\d(?:[ -]?\d){12,18}"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}|\d{3}[.-]\d{3}[.-]\d{4}"
EDGE, END = r"(?<![A-Za-z0-9.@+/-])", r"(?![A-Za-z0-9@]|[./-]\d)"
# A place is only looked at closely if a word begins there, or a number.
FOUND = rf"{EMAIL}|(?=[0-9(+]|[A-Z]{{2}}[0-9]){EDGE}(?:{IBAN}|{DATE}|{IP}|{SSN}|{PHONE}|{CARD}){END}"
# Where a card ends inside its match; a text that holds the first of these characters itself has it as OWN.
MARK, OWN, FIRST = "\ufdd0\ufdd2", "\ufdd0\ufdd1", "\ufdd0"
KINDS = ("email", "date", "ip", "ssn", "iban", "card", "phone")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keyed(value: Column, label: str, key: str) -> Column:
    """52 bits of a keyed digest, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{label}|"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def feistel(value: Column, left: int, right: int, label: str, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the numbers below left x right, by alternating modular additions.

    A struct runs through an aggregate, so every half is computed once per round.
    """

    def turn(half: Column, i: Column) -> Column:
        a, b = half["a"], half["b"]
        even = F.struct(((a + keyed(F.concat_ws(":", i, b), label, key)) % F.lit(left)).cast("long").alias("a"), b.cast("long").alias("b"))
        odd = F.struct(a.cast("long").alias("a"), ((b + keyed(F.concat_ws(":", i, a), label, key)) % F.lit(right)).cast("long").alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    numbers = F.array(*(F.lit(i) for i in range(rounds)))
    start = F.struct(F.floor(value / F.lit(right)).cast("long").alias("a"), (value % F.lit(right)).cast("long").alias("b"))
    return F.aggregate(numbers, start, turn, lambda h: (h["a"] * F.lit(right) + h["b"]).cast("long"))


def permuted_digits(digits: Column, label: str, key: str) -> Column:
    """Digits of any length up to 34 as other digits of the same length: a permutation for each length.

    The two halves have at most 17 digits, so they and their sums fit into decimals exactly.
    """
    n = F.length(digits)
    cut = (n / 2).cast("int")
    start = F.struct(F.substr(digits, F.lit(1), cut).alias("a"), F.substr(digits, cut + 1).alias("b"))

    def moved(half: Column, other: Column, i: Column) -> Column:
        size = F.length(half)
        far = (half.cast("decimal(18,0)") + keyed(F.concat_ws(":", n, i, other), label, key).cast("decimal(18,0)")).cast("string")
        # Addition modulo a power of ten: the last digits of the sum.
        return F.when(size == 0, half).otherwise(F.right(F.lpad(far, 20, "0"), size))

    def turn(half: Column, i: Column) -> Column:
        even = F.struct(moved(half["a"], half["b"], i).alias("a"), half["b"].alias("b"))
        odd = F.struct(half["a"].alias("a"), moved(half["b"], half["a"], i).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn, lambda h: F.concat(h["a"], h["b"]))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def refilled(shape: Column, digits: Column, what: str = "^[0-9]$") -> Column:
    """The shape with its digits (or what else is asked for) replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(state: Column, c: Column) -> Column:
        digit = c.rlike(what)
        n = state["n"] + F.when(digit, 1).otherwise(0)
        new = F.when(digit, F.substr(digits, n, F.lit(1))).otherwise(c)
        return F.struct(F.concat(state["out"], new).alias("out"), n.alias("n"))

    return F.aggregate(F.split(shape, ""), start, put, lambda s: s["out"])


def luhn_digit(body: Column) -> Column:
    """The digit that makes the Luhn sum of body and digit a multiple of ten."""
    marks = F.split(F.reverse(body), "")
    total = F.aggregate(F.transform(F.filter(marks, lambda c: c != ""), lambda c, i: F.when(
        i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))), F.lit(0), lambda a, b: a + b)
    return ((10 - total % 10) % 10).cast("string")


def day_of(text: Column) -> Column:
    """The calendar day of a date in one of the formats; null if there is none."""
    parse = lambda f: F.try_to_timestamp(text, F.lit(f)).cast("date")
    iso = F.when(text.rlike(r"^\d{4}-"), parse("yyyy-MM-dd"))
    german = F.when(text.contains("."), parse("dd.MM.yyyy"))
    slashed = F.when(text.contains("/"), F.coalesce(parse("dd/MM/yyyy"), parse("MM/dd/yyyy")))
    return F.coalesce(iso, german, slashed)


def date_pseudonym(text: Column, key: str) -> Column:
    number = F.date_diff(day_of(text), F.lit(FIRST_DAY).cast("date"))
    month_first = F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).isNull()
    form = F.when(text.rlike(r"^\d{4}-"), "yyyy-MM-dd").when(text.contains("."), "dd.MM.yyyy").when(month_first, "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    moved = feistel(number.cast("long"), 184, 397, "date", key).cast("int")
    return F.call_function("date_format", F.date_add(F.lit(FIRST_DAY).cast("date"), moved).cast("timestamp"), form)


def iban_check(country: Column, body: Column) -> Column:
    """The two check digits of country and body."""
    plain = F.concat(body, country, F.lit("00"))
    numbers = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    rest = F.aggregate(F.filter(F.split(F.array_join(numbers, ""), ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def iban_pseudonym(text: Column, key: str) -> Column:
    plain = F.replace(text, F.lit(" "), F.lit(""))
    body = F.substr(plain, F.lit(5))
    moved = let(body, lambda b: refilled(b, permuted_digits(digits_of(b), "iban", key)))
    return let(moved, lambda new: refilled(text, F.concat(iban_check(F.left(plain, F.lit(2)), new), digits_of(new))))


def kind_of(text: Column) -> Column:
    """Which kind a match is; null if its checks fail."""
    digits = digits_of(text)
    plain = F.replace(text, F.lit(" "), F.lit(""))
    day = day_of(text)
    ssn = text.rlike(f"^{SSN}$") & ~text.rlike(r"^(?:000|666|9\d\d)-|-00-|-0000$")
    iban = text.rlike(f"^{IBAN}$") & (F.substr(plain, F.lit(3), F.lit(2)) == iban_check(F.left(plain, F.lit(2)), F.substr(plain, F.lit(5))))
    return (F.when(text.contains("@"), "email")
            .when(text.rlike(f"^(?:{DATE})$"), F.when(day.between(F.lit(FIRST_DAY), F.date_add(F.lit(FIRST_DAY).cast("date"), DAYS - 1)), "date"))
            .when(text.rlike(f"^{IP}$"), "ip")
            .when(text.rlike(f"^{SSN}$"), F.when(ssn, "ssn"))
            .when(text.rlike(r"^[A-Z]{2}"), F.when(iban, "iban"))
            .when(text.rlike(f"^(?:{PHONE})$") & F.length(digits).between(9, 15), "phone")
            .when(text.rlike(f"^{CARD}$") & F.length(digits).between(13, 19), "card"))


def ip_pseudonym(text: Column, key: str) -> Column:
    """The address as one 32-bit number, permuted."""
    parts = F.split(text, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, c: a * 256 + c.cast("long"))
    octets = lambda new: F.concat_ws(".", *((F.shiftright(new, s) % 256).cast("string") for s in (24, 16, 8, 0)))
    return let(feistel(number, 1 << 16, 1 << 16, "ip", key), octets)


def permuted_symbols(symbols: Column, tweak: Column, label: str, key: str) -> Column:
    """Small letters and digits as others, each of its own sort: a permutation for each sequence of sorts and each tweak.

    The two halves take turns: every symbol of one moves on within its alphabet by a keyed digest of the other half, so
    a round is undone by moving back.
    """
    cut = (F.length(symbols) / 2).cast("int")
    start = F.struct(F.substr(symbols, F.lit(1), cut).alias("a"), F.substr(symbols, cut + 1).alias("b"))

    def moved(half: Column, other: Column, i: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.length(half) / 32).cast("int"))  # a digest serves 32 symbols
        digests = F.transform(blocks, lambda n: F.sha2(F.concat(F.lit(f"{key}|{label}|"), F.concat_ws("|", tweak, i, n, other)), 512))

        def shifted(stream: Column) -> Column:
            def put(c: Column, at: Column) -> Column:
                by = F.conv(F.substr(stream, at * 4 + 1, F.lit(4)), 16, 10).cast("int")
                return F.when(c.rlike("[0-9]"), ((c.cast("int") + by) % 10).cast("string")).otherwise(F.char((F.ascii(c) - ord("a") + by) % 26 + ord("a")))

            return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), put), "")

        return let(F.array_join(digests, ""), shifted)

    def turn(half: Column, i: Column) -> Column:
        even = F.struct(moved(half["a"], half["b"], i).alias("a"), half["b"].alias("b"))
        odd = F.struct(half["a"].alias("a"), moved(half["b"], half["a"], i).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn, lambda h: F.concat(h["a"], h["b"]))


def email_pseudonym(text: Column, key: str) -> Column:
    """Letters and digits of the local part and the first label, permuted together without regard to case."""
    head = F.regexp_extract(text, r"^(.*?@[^.]*)", 1)
    rest = F.substr(text, F.length(head) + 1)
    shape = F.regexp_replace(F.regexp_replace(F.lower(head), "[a-z]", "a"), "[0-9]", "9")
    symbols = F.regexp_replace(F.lower(head), "[^a-z0-9]", "")
    new = let(symbols, lambda s: permuted_symbols(s, F.concat(shape, F.lower(rest)), "email", key))
    filled = let(new, lambda n: refilled(head, n, "^[A-Za-z0-9]$"))
    cased = F.transform(F.filter(F.split(filled, ""), lambda c: c != ""), lambda c, i: F.when(
        F.substr(head, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c))
    return F.concat(F.array_join(cased, ""), rest)


def card_digits(digits: Column, key: str) -> Column:
    """A number whose Luhn check holds keeps that; the check digit follows from the others."""
    body = F.left(digits, F.length(digits) - 1)
    checked = let(permuted_digits(body, "card", key), lambda new: F.concat(new, luhn_digit(new)))
    return F.when(luhn_digit(body) == F.right(digits, F.lit(1)), checked).otherwise(permuted_digits(digits, "number", key))


def ssn_digits(digits: Column, key: str) -> Column:
    """Area, group and serial stay within what is given out."""
    area = F.substr(digits, F.lit(1), F.lit(3)).cast("long")
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    number = (place * 99 + F.substr(digits, F.lit(4), F.lit(2)).cast("long") - 1) * 9999 + F.substr(digits, F.lit(6)).cast("long") - 1

    def spelled(new: Column) -> Column:
        other = F.floor(new / (9999 * 99)).cast("long") + 1
        parts = ((other + F.when(other >= 666, 1).otherwise(0), 3), (F.floor(new / 9999).cast("long") % 99 + 1, 2), (new % 9999 + 1, 4))
        return F.concat(*(F.lpad(x.cast("string"), n, "0") for x, n in parts))

    return let(feistel(number, 898 * 99, 9999, "ssn", key), spelled)


def number_pseudonym(text: Column, kind: Column, key: str) -> Column:
    """Social security, phone and card numbers in their own shape."""
    code = F.length(F.regexp_extract(text, r"^\+(\d{1,3})(?=[ .(-])", 1))
    phone = lambda digits: let(code, lambda n: F.concat(F.left(digits, n), permuted_digits(F.substr(digits, n + 1), "phone", key)))
    chosen = lambda digits: F.when(kind == "ssn", ssn_digits(digits, key)).when(kind == "phone", phone(digits)).otherwise(card_digits(digits, key))
    return refilled(text, let(digits_of(text), chosen))


def pseudonym(text: Column, kind: Column, key: str) -> Column:
    return (F.when(kind == "email", email_pseudonym(text, key)).when(kind == "date", date_pseudonym(text, key)).when(kind == "ip", ip_pseudonym(text, key))
            .when(kind == "iban", iban_pseudonym(text, key)).when(kind.isNotNull(), number_pseudonym(text, kind, key)).otherwise(text))


def card_end(text: Column) -> Column:
    """Characters of a match up to the end of its card; all of them if it is none or no end before a blank checks.

    Where several ends check, the issuer's own length goes first, then the longest.
    """
    groups = F.split(text, " ")
    heads = F.transform(groups, lambda g, i: F.array_join(F.slice(groups, F.lit(1), i + 1), " "))

    def checks(head: Column) -> Column:
        return let(digits_of(head), lambda d: F.length(d).between(13, 19) & (luhn_digit(F.left(d, F.length(d) - 1)) == F.right(d, F.lit(1))))

    digits = digits_of(text)
    usual = F.when(digits.rlike("^3[47]"), 15).when(digits.rlike("^3(?:0[0-5]|[689])"), 14).when(digits.rlike("^(?:4|5[1-5]|2[2-7])"), 16)
    end = let(F.filter(heads, checks), lambda found: F.length(F.coalesce(
        F.get(F.filter(found, lambda h: F.length(digits_of(h)) == usual), F.lit(0)), F.get(F.reverse(found), F.lit(0)), text)))
    card = text.contains(" ") & text.rlike(f"^{CARD}$")
    return F.when(card, end).otherwise(F.length(text))


def marked(text: Column) -> Column:
    """The text with a mark after every card that ends before its match does, so that what follows is looked at afresh."""

    def turn(state: Column, _: Column) -> Column:
        def woven(new: Column) -> Column:
            between = F.split(state["text"], FOUND, -1)
            return F.array_join(F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.get(new, i), F.lit("")))), "")

        cut = lambda m: let(card_end(m), lambda n: F.when(n < F.length(m), F.concat(F.left(m, n), F.lit(MARK), F.substr(m, n + 1))).otherwise(m))
        new = F.transform(F.regexp_extract_all(state["text"], F.lit(f"({FOUND})"), F.lit(1)), cut)
        after = let(let(new, woven), lambda t: F.struct(t.alias("text"), (t != state["text"]).alias("more")))
        return F.when(state["more"], after).otherwise(state)

    # Every turn but the last ends a card of at least 13 digits.
    turns = F.sequence(F.lit(0), F.floor(F.length(digits_of(text)) / 13).cast("int"))
    start = F.struct(F.replace(text, F.lit(FIRST), F.lit(OWN)).alias("text"), F.lit(True).alias("more"))
    return F.aggregate(turns, start, turn, lambda s: s["text"])


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Per input row: doc_id, clean_text, n_found, and the number of each kind (n_email, n_date, ...)."""
    rows = pick(docs, "doc_id", "text")
    # Most texts hold neither a digit nor an at sign.
    matches = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(f"({FOUND})"), F.lit(1)))
    rows = rows.select("doc_id", "text", matches.alias("matches"))
    # Few texts hold a card with more digits behind it.
    rows = rows.withColumn("marked", F.when(F.exists("matches", lambda m: card_end(m) < F.length(m)), marked(F.col("text"))))
    rows = rows.withColumn("matches", F.when(F.col("marked").isNull(), F.col("matches")).otherwise(F.regexp_extract_all("marked", F.lit(f"({FOUND})"), F.lit(1))))
    rows = rows.withColumn("text", F.coalesce("marked", "text"))
    # Match by match, in order; what the matches leave is the text between them.
    known = F.transform("matches", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    rows = rows.withColumn("known", F.when(F.size("matches") > 0, known)).drop("matches")
    new = F.transform("known", lambda k: pseudonym(k["m"], k["kind"], key))
    rows = rows.withColumn("new", F.when(F.col("known").isNotNull(), new))
    between = F.when(F.col("known").isNotNull(), F.split("text", FOUND, -1))
    rows = rows.withColumn("between", between)
    woven = F.array_join(F.transform("between", lambda t, i: F.concat(t, F.coalesce(F.get("new", i), F.lit("")))), "")
    woven = F.when(F.col("marked").isNull(), woven).otherwise(F.replace(F.replace(woven, F.lit(MARK), F.lit("")), F.lit(OWN), F.lit(FIRST)))
    count = lambda kind: F.coalesce(F.size(F.filter("known", lambda k: k["kind"] == kind)), F.lit(0)).cast("long")
    counts = {k: F.when(F.col("known").isNotNull(), count(k)).otherwise(0).cast("long") for k in KINDS}
    out = rows.select("doc_id", F.when(F.col("known").isNotNull(), woven).otherwise(F.col("text")).alias("clean_text"),
                      *(c.alias(f"n_{k}") for k, c in counts.items()))
    return out.withColumn("n_found", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)).cast("long"))


def op2_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymised(spark.read.parquet(f"{folder}/documents.parquet"))
