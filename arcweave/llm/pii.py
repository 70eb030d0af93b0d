"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Finds e-mail addresses, card numbers (Luhn-valid), IPv4 addresses, phone
numbers, social security numbers, IBANs (mod 97), calendar dates and long
hexadecimal secrets. Each is read as a vector of symbols with a radix each
(digits, letters, octets, the two parts of a day number), and an alternating
Feistel network of eight keyed rounds permutes the vectors of one shape. The
result is written back into the same format, check digits recomputed, so it is
valid again, equal values get equal pseudonyms in all documents, and the holder
of the key can invert it. Strings that only look like such a number stay.

Only column expressions are used; the costly part runs on matches alone.

There is no built-in key: whoever has the key can invert the pseudonyms, so
the caller keeps it. A social security number has an area of 001 to 665 or 667
to 899 (or 900 to 999, as for taxpayers without one), a group and a serial
number other than zero; pseudonyms keep these rules, other numbers stay.

Kept as they are: separators, an address's domain, a phone's country code, an
IBAN's country. Dates are permuted among the days of 1800 to 2199 (ISO,
day.month.year, month/day/year); others stay.

Defined results: a null text stays null, an empty one empty; a text without
matches is returned unchanged; the shortest vectors (one symbol) are shifted by
a keyed amount; a value may map to itself as in any permutation; repeated rows
are treated alike; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.text import let

ROUNDS = 8

# Patterns, in the order they are tried at a place.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![./-]?\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
SECRET = r"(?<![A-Za-z0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])"
CARD = r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
PATTERN = "|".join((EMAIL, IP, DATE, IBAN, PHONE, SSN, SECRET, CARD))
MAYBE = r"[0-9@]"

FIRST_DAY = "1800-01-01"
DAYS = 146097  # 400 years
DAY_PARTS = (189, 773)  # their product is DAYS


def _keyed(key: str, step: Column, half: Column, i: Column) -> Column:
    """A pseudo-random number below 2^52 from the other half's symbols."""
    text = F.concat_ws("|", F.lit(key), step.cast("string"), F.array_join(F.transform(half, lambda x: x["v"].cast("string")), ","), i.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


def permute(symbols: Column, key: str) -> Column:
    """Keyed permutation of an array of (v, r) with 0 <= v < r; equal radixes come back in place."""

    def moved(own: Column, other: Column, step: Column) -> Column:
        return F.transform(own, lambda x, i: F.struct(F.pmod(x["v"] + _keyed(key, step, other, i), x["r"]).alias("v"), x["r"].alias("r")))

    def run(all_: Column) -> Column:
        cut = F.floor(F.size(all_) / 2).cast("int")
        start = F.struct(F.slice(all_, 1, cut).alias("a"), F.slice(all_, cut + 1, F.size(all_) - cut).alias("b"))

        def step(acc: Column, k: Column) -> Column:
            even = F.struct(moved(acc["a"], acc["b"], k).alias("a"), acc["b"].alias("b"))
            odd = F.struct(acc["a"].alias("a"), moved(acc["b"], acc["a"], k).alias("b"))
            return F.when(k % 2 == 0, even).otherwise(odd)

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))

    return let(symbols, run)


def _symbol(value: Column, radix: Column) -> Column:
    return F.struct(value.cast("bigint").alias("v"), radix.cast("bigint").alias("r"))


ALPHABETS = {"0123456789": 10, "abcdefghijklmnopqrstuvwxyz": 26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ": 26}
HEX = {"0123456789abcdef": 16}


def _write(text: Column, key: str, alphabets: dict[str, int], change: Callable[[Column], Column] | None = None) -> Column:
    """``text`` with its symbols permuted (or changed by ``change``) and all other characters in place."""
    change = change or (lambda symbols: permute(symbols, key))

    def radix(c: Column) -> Column:
        out = F.when(F.lit(False), F.lit(0))
        for letters, r in alphabets.items():
            out = out.when(F.instr(F.lit(letters), c) > 0, r)
        return out.otherwise(0)

    def value(c: Column) -> Column:
        out = F.when(F.lit(False), F.lit(0))
        for letters in alphabets:
            out = out.when(F.instr(F.lit(letters), c) > 0, F.instr(F.lit(letters), c) - 1)
        return out.otherwise(0)

    def letter(c: Column, v: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for letters in alphabets:
            out = out.when(F.instr(F.lit(letters), c) > 0, F.substring(F.lit(letters), v.cast("int") + 1, F.lit(1)))
        return out

    def rebuild(chars: Column) -> Column:
        symbols = F.transform(F.filter(chars, lambda c: radix(c) > 0), lambda c: _symbol(value(c), radix(c)))

        def fill(new: Column) -> Column:
            start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
            step = lambda acc, c: F.when(radix(c) > 0, F.struct(F.concat(acc["s"], letter(c, F.get(new, acc["k"])["v"])).alias("s"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))
            return F.aggregate(chars, start, step, lambda acc: acc["s"])

        return let(change(symbols), fill)

    return let(F.split(text, ""), rebuild)


def _digit_sum(digits: Column, odd_from_right: int) -> Column:
    """Luhn sum of an array of (v, r); digits at an odd place from the right, counted from ``odd_from_right``, are doubled."""
    terms = F.transform(F.reverse(digits), lambda x, i: F.when((i + odd_from_right) % 2 == 1, F.when(x["v"] > 4, 2 * x["v"] - 9).otherwise(2 * x["v"])).otherwise(x["v"]))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: F.instr(F.lit("0123456789"), c) > 0), lambda c: _symbol(c.cast("int"), F.lit(10)))


def card(text: Column, key: str) -> Column:
    """A Luhn-valid number with its check digit made anew; any other string stays."""

    def change(digits: Column) -> Column:
        body = permute(F.slice(digits, 1, F.size(digits) - 1), key + "/card")
        return let(body, lambda b: F.concat(b, F.array(_symbol(F.pmod(10 - _digit_sum(b, 1) % 10, F.lit(10)), F.lit(10)))))

    return F.when(_digit_sum(_digits(text), 0) % 10 == 0, _write(text, key, {"0123456789": 10}, change)).otherwise(text)


def _mod97(text: Column) -> Column:
    """An IBAN's characters, moved as the standard says, modulo 97."""
    moved = F.split(F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4)), "")
    code = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(code(c) > 9, (a * 100 + code(c)) % 97).otherwise((a * 10 + code(c)) % 97))


def iban(text: Column, key: str) -> Column:
    """A valid IBAN, in one piece or in groups of four, with its account permuted and its check digits made anew; any other string stays."""
    country = F.substring(text, 1, 2)
    account = _write(F.substring(text, 5, 50), key + "/iban", ALPHABETS)
    closed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    new = let(account, lambda a: F.concat(country, F.lpad((98 - _mod97(closed(F.concat(country, F.lit("00"), a)))).cast("string"), 2, "0"), a))
    return F.when(_mod97(closed(text)) == 1, new).otherwise(text)


def ssn(text: Column, key: str) -> Column:
    """A number of valid area, group and serial as another one, of 900 and above as such; any other string stays."""
    area, group, serial = (F.substring(text, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    high = area >= 900
    # areas in use are counted without 000 and 666
    place = F.when(high, area - 900).otherwise(area - 1 - (area > 666).cast("int"))
    symbols = F.array(_symbol(place, F.when(high, 100).otherwise(898)), _symbol(group - 1, F.lit(99)), _symbol(serial - 1, F.lit(9999)))

    def written(p: Column) -> Column:
        new = F.when(high, p[0]["v"] + 900).otherwise(p[0]["v"] + 1 + (p[0]["v"] >= 665).cast("int"))
        return F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((p[1]["v"] + 1).cast("string"), 2, "0"), F.lpad((p[2]["v"] + 1).cast("string"), 4, "0"))

    valid = ~area.isin(0, 666) & (group > 0) & (serial > 0)
    return F.when(valid, let(permute(symbols, key + "/ssn"), written)).otherwise(text)


def ip(text: Column, key: str) -> Column:
    octets = F.transform(F.split(text, "\\."), lambda o: _symbol(o.cast("int"), F.lit(256)))
    return F.array_join(F.transform(permute(octets, key + "/ip"), lambda x: x["v"].cast("string")), ".")


def date(text: Column, key: str) -> Column:
    """A day of 1800 to 2199 as another one, in the same notation; any other string stays."""
    def other(notation: str) -> Callable[[Column], Column]:
        def shifted(day: Column) -> Column:
            n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
            parts = F.array(_symbol(F.floor(n / DAY_PARTS[1]), F.lit(DAY_PARTS[0])), _symbol(n % DAY_PARTS[1], F.lit(DAY_PARTS[1])))
            new = let(permute(parts, key + "/date"), lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p[0]["v"] * DAY_PARTS[1] + p[1]["v"]).cast("int")))
            return F.when(day.isNotNull() & (n >= 0) & (n < DAYS), F.date_format(new, notation)).otherwise(text)

        return shifted

    out = text
    for mark, notation in (("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"), ("/", "MM/dd/yyyy")):
        out = F.when(F.instr(text, mark) > 0, let(F.try_to_timestamp(text, F.lit(notation)).cast("date"), other(notation))).otherwise(out)
    return out


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one match of ``PATTERN``."""
    whole = lambda p: found.rlike(f"^(?:{p})$")
    plain = {"0123456789": 10}
    at = F.instr(found, "@")
    return (
        F.when(at > 0, F.concat(_write(F.substring(found, F.lit(1), at - 1), key + "/mail", ALPHABETS), F.substring(found, at, F.length(found))))
        .when(whole(IP), ip(found, key))
        .when(whole(DATE), date(found, key))
        .when(whole(IBAN), iban(found, key))
        .when(found.startswith("+"), F.concat(F.regexp_extract(found, r"^\+\d{1,3}", 0), _write(F.regexp_replace(found, r"^\+\d{1,3}", ""), key + "/phone", plain)))
        .when(whole(SSN), ssn(found, key))
        .when(whole(PHONE), _write(found, key + "/phone", plain))
        .when(whole(SECRET) & found.rlike("[a-f]"), _write(found, key + "/secret", HEX))
        .when(whole(CARD), card(found, key))
        .otherwise(found)
    )


def pseudonymize(text: Column, key: str) -> Column:
    """Struct of the text with its personal data replaced, and how many matches changed."""
    if not key:
        raise ValueError("a secret key is needed")
    found = F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def replaced(old: Column) -> Column:
        new = F.transform(old, lambda m: pseudonym(m, key))

        def joined(new: Column) -> Column:
            gaps = F.split(text, PATTERN, -1)
            whole = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")
            changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))
            return F.struct(whole.alias("text"), changed.cast("long").alias("n_replaced"))

        return F.when(F.size(old) > 0, let(new, joined)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_replaced")))

    return let(found, replaced)


def pseudonymize_documents(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The table with personal data in ``text`` replaced, and ``n_replaced`` beside it."""
    others = [c for c in docs.columns if c not in (text_col, "n_replaced")]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others])
    done = docs.select(row.alias("_row"), pseudonymize(F.col(f"`{text_col}`").cast("string"), key).alias("_done"))
    return done.select(*[F.col("_row")[c].alias(c) for c in others], F.col("_done.text").alias(text_col), "_done.n_replaced")
