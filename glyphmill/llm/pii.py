r"""Format-preserving pseudonyms for personal data, by keyed Feistel networks (DataFrame functions only).

Candidates are found by one pattern and validated: card numbers by issuer prefix and Luhn sum, IBANs by their
mod-97 check, IPv4 addresses by octets, US social security numbers by area, group and serial, dates by the
calendar, telephone numbers by their form and digit count, mail addresses by form. What doesn't validate stays
as it is. A valid value is permuted within its format: separators, lengths, issuer prefix, country code, mail
domain and kinds of characters stay, check digits are made anew, so the pseudonym validates too. Of a date the order of
its fields, their widths and its span of 200 years stay; a slashed date that is none with the month first
is read with the day first, and its day stays beyond 12. The permutation depends on the key and the kind of
value only: equal values stay equal in all documents. Who has the key can invert it, so it has no default.

Domains that are no product of two ranges (dates, social security numbers) are walked: the network is
applied again until its output is valid, which keeps it a permutation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

#: Setting that holds the key of op8_pii and the pipeline, and their key where it is unset, for tables that are invented.
KEY_SETTING, TEST_KEY = "spark.glyphmill.pii.key", "glyphmill pseudonyms"
ROUNDS = 8
#: The alphabets within which characters of mail names and IBANs are moved.
ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
#: Dates move within spans of so many years, of which one begins in this year.
SPAN, FIRST_YEAR = 200, 1900
_STEPS = 24

EMAIL = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+"
IBAN = r"(?<![\p{L}0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?)(?![\p{L}0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])(?!\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (
    r"(?<![0-9+])(?:(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?:\+1[ .-]?)?(?<![0-9]-)[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-]?[0-9])"
    r"|\+[0-9]{8,15}(?![0-9])|\+[0-9]{1,3}(?:[ -][0-9]{2,4}){3,4}(?![0-9]))"
)
CARD = r"(?<![\p{L}0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}0-9])"
PATTERN = "|".join((EMAIL, IBAN, IP, DATE, SSN, PHONE, CARD))


def _draw(key: str, tag: str, i: Column, *x: Column) -> Column:
    """A keyed 52-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), *[v.cast("string") for v in x]).cast("binary"), 256), 1, 13), 16, 10).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """A permutation of 0 to a * b - 1: halves in turn get a keyed function of the other one added."""
    zero = F.struct(((value - value % b) / b).cast("long").alias("l"), (value % b).alias("r"))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, (s["l"] + _draw(key, tag, i, a, s["r"])) % a).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise((s["r"] + _draw(key, tag, i, b, s["l"])) % b).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), zero, step, lambda s: s["l"] * b + s["r"])


def walked(value: Column, a: Column, b: Column, valid: Callable[[Column], Column], key: str, tag: str) -> Column:
    """feistel(), applied again until the output is valid."""
    once = lambda v: feistel(v, a, b, key, tag)
    # the state holds whether a valid output has been reached
    zero = F.struct(value.cast("long").alias("v"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        moved = F.when(s["done"], s["v"]).otherwise(once(s["v"]))
        return F.transform(F.array(moved), lambda m: F.struct(m.alias("v"), (s["done"] | valid(m)).alias("done")))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), zero, step, lambda s: s["v"])


def moved_letters(text: Column, key: str, tag: str) -> Column:
    """A Feistel network on the characters: each moves within its alphabet, others stay."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    half = F.floor(F.char_length(text) / 2).cast("int")

    def shift(c: Column, by: Column) -> Column:
        out = c
        for letters in reversed(ALPHABETS):
            at = F.instr(F.lit(letters), c)
            out = F.when(at > 0, F.substring(F.lit(letters), ((at - 1 + by) % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    def turned(own: Column, other: Column, i: Column) -> Column:
        word = F.array_join(other, "")
        return F.transform(own, lambda c, j: shift(c, _draw(key, tag, i, F.size(own), j, word)))

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, turned(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(turned(s["r"], s["l"], i)).alias("r")
        )

    zero = F.struct(F.slice(chars, F.lit(1), half).alias("l"), F.slice(chars, half + 1, F.char_length(text) - half).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), zero, step, lambda s: F.concat(F.array_join(s["l"], ""), F.array_join(s["r"], "")))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _poured(form: Column, digits: Column) -> Column:
    """form with its digits replaced by these, in order."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(c.between("0", "9"), F.substring(digits, F.char_length(_digits(F.substring(form, F.lit(1), i + 1))), F.lit(1))).otherwise(c),
        ),
        "",
    )


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def _moved_digits(digits: Column, key: str, tag: str) -> Column:
    """digits (at most 18) permuted among the numbers of as many digits."""
    n = F.char_length(digits)
    low = F.ceil(n / 2).cast("int")
    moved = feistel(F.when(n > 0, digits).otherwise(F.lit("0")).cast("long"), _power(n - low), _power(low), key, tag)
    return F.when(n > 0, F.lpad(moved.cast("string"), n, F.lit("0"))).otherwise(F.lit(""))


def _with_check(head: Column) -> Column:
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), lambda x: F.call_function("luhn_check", x))[0]


def _mod97(compact: Column) -> Column:
    turned = F.concat(F.substring(compact, F.lit(5), F.char_length(compact)), F.substring(compact, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda m, c: F.when(value(c) > 9, (m * 100 + value(c)) % 97).otherwise((m * 10 + value(c)) % 97).cast("int"))


def _card(x: Column, key: str) -> Column:
    d = _digits(x)
    issuer = d.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|6[45])")
    keep = F.when(d.startswith("4"), 1).when(d.startswith("6"), 4).otherwise(2)
    payload = F.substring(d, keep + 1, F.char_length(d) - keep - 1)
    new = _with_check(F.concat(F.substring(d, F.lit(1), keep), _moved_digits(payload, key, "card")))
    return F.when(issuer & F.char_length(d).between(13, 19) & F.call_function("luhn_check", d), _poured(x, new))


def _phone(x: Column, key: str) -> Column:
    d = _digits(x)
    keep = F.when(x.startswith("+1"), 1).when(x.startswith("+"), 2).otherwise(0)
    new = F.concat(F.substring(d, F.lit(1), keep), _moved_digits(F.substring(d, keep + 1, F.char_length(d)), key, "phone"))
    return F.when(F.char_length(d).between(8, 15), _poured(x, new))


def _ip(x: Column, key: str) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    valid = F.forall(parts, lambda p: p <= 255) & ~x.rlike(r"(^|\.)0[0-9]")
    size = F.lit(1 << 16).cast("long")
    moved = feistel(F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p), size, size, key, "ip")
    return F.when(valid, F.array_join(F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]), lambda s: (F.call_function("shiftright", moved, s).bitwiseAND(F.lit(255))).cast("string")), "."))


def _ssn(x: Column, key: str) -> Column:
    valid = lambda n: ~F.floor(n / 1_000_000).cast("int").isin(0, 666) & (n < 900_000_000) & (F.floor(n / 10_000) % 100 != 0) & (n % 10_000 != 0)
    d = _digits(x)
    moved = walked(d.cast("long"), F.lit(100_000).cast("long"), F.lit(10_000).cast("long"), valid, key, "ssn")
    return F.when(valid(d.cast("long")), _poured(x, F.lpad(moved.cast("string"), 9, "0")))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _real(y: Column, m: Column, d: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= last)


def _date(x: Column, key: str) -> Column:
    def read(parts: Column) -> Column:
        iso = x.contains("-")
        late = x.contains("/") & (parts[0].cast("int") > 12)  # the day first, beyond 12
        month_first = x.contains("/") & ~late
        year, month = F.when(iso, parts[0]).otherwise(parts[2]), F.when(month_first, parts[0]).otherwise(parts[1])
        day = F.when(iso, parts[2]).when(month_first, parts[1]).otherwise(parts[0])
        return F.struct(iso.alias("iso"), late.alias("late"), month_first.alias("month_first"), year.alias("y"), month.alias("m"), day.alias("d"))

    def ranges(s: Column) -> Column:
        span = (F.floor((s["y"].cast("int") - FIRST_YEAR) / SPAN) * SPAN + FIRST_YEAR).cast("long")
        months = F.when(F.char_length(s["m"]) == 1, 9).otherwise(12).cast("long")
        days = F.when(s["late"], 19).when(F.char_length(s["d"]) == 1, 9).otherwise(31).cast("long")
        return F.struct(s.alias("s"), span.alias("span"), months.alias("months"), days.alias("days"), F.when(s["late"], 13).otherwise(1).cast("long").alias("least"))

    def moved(r: Column) -> Column:
        s, a_year = r["s"], r["months"] * r["days"]
        of = lambda n: (r["span"] + ((n - n % a_year) / a_year).cast("long"), ((n % a_year - n % r["days"]) / r["days"]).cast("long") + 1, n % r["days"] + r["least"])
        own = [s[c].cast("long") for c in ("y", "m", "d")]
        number = ((own[0] - r["span"]) * r["months"] + own[1] - 1) * r["days"] + own[2] - r["least"]

        def written(n: Column) -> Column:
            y, m, d = (F.lpad(v.cast("string"), F.char_length(s[c]), "0") for v, c in zip(of(n), ("y", "m", "d"), strict=True))
            return F.when(s["iso"], F.concat_ws("-", y, m, d)).when(s["late"], F.concat_ws("/", d, m, y)).when(s["month_first"], F.concat_ws("/", m, d, y)).otherwise(F.concat_ws(".", d, m, y))

        return F.when(_real(*own), _bound(walked(number, F.lit(SPAN).cast("long"), a_year, lambda n: _real(*of(n)), key, "date"), written))

    return _bound(F.split(x, "[-/.]"), lambda parts: _bound(read(parts), lambda s: _bound(ranges(s), moved)))


def _iban(x: Column, key: str) -> Column:
    compact = F.replace(x, F.lit(" "), F.lit(""))
    country = F.substring(compact, 1, 2)
    account = moved_letters(F.substring(compact, F.lit(5), F.char_length(compact)), key, "iban")
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    new = F.concat(country, check, account)
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    spaced = F.array_join(
        F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, F.char_length(F.replace(F.substring(x, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), ""
    )
    return F.when(_mod97(compact) == 1, spaced)


def _email(x: Column, key: str) -> Column:
    at = F.instr(x, "@")
    return F.concat(moved_letters(F.substring(x, F.lit(1), at - 1), key, "mail"), F.substring(x, at, F.char_length(x)))


KINDS: tuple[tuple[str, str, Callable[[Column, str], Column]], ...] = (
    ("mail", EMAIL, _email), ("iban", IBAN, _iban), ("ip", IP, _ip), ("date", DATE, _date), ("ssn", SSN, _ssn), ("phone", PHONE, _phone), ("card", CARD, _card),
)


def pseudonym(value: Column, key: str) -> Column:
    """The value's pseudonym; the value itself where it is no valid item of any kind."""
    out = F.lit(None).cast("string")
    for _, pattern, made in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{pattern})$"), made(value, key)).otherwise(out)
    return F.coalesce(out, value)


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with the column `text` rewritten and n_replaced (values that got a pseudonym).

    Null texts stay null, with n_replaced 0; empty and long texts are treated alike; a row in, a row out, repeated ones
    repeat. A column named n_replaced is replaced, all others stay. An empty table gives an empty one. ValueError
    for an empty key.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    df = without(df, "n_replaced")
    taken = {c.lower() for c in df.columns}
    hits_name, new_name = (next(c for i in range(len(taken) + 1) if (c := f"{n}{i}") not in taken) for n in ("hits", "new"))
    hits = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    # a text without a digit or @ holds no candidate; gaps are what stands between the hits
    found = df.withColumn(hits_name, F.when(F.col(text).rlike("[0-9@]"), hits).otherwise(F.array().cast("array<string>")))
    found = found.withColumn(new_name, F.transform(hits_name, lambda x: pseudonym(x, key)))
    gaps = F.split(F.col(text), PATTERN, -1)
    rewritten = F.array_join(F.zip_with(gaps, F.col(new_name), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(hits_name, new_name, lambda a, b: a != b), lambda x: x))
    return found.select(
        *[F.when(F.size(hits_name) > 0, rewritten).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in df.columns],
        F.coalesce(F.when(F.col(hits_name).isNotNull(), changed), F.lit(0)).cast("long").alias("n_replaced"),
    )


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
