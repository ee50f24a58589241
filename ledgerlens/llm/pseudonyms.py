"""Format-preserving pseudonyms for validated numbers and dates.

A value is found by its shape, validated, and replaced by a keyed permutation (alternating Feistel
rounds with a keyed SHA-256) of its own domain, so its format stays, and equal values have equal
pseudonyms in every document whatever separators they are written with:

* card numbers (13 to 19 digits, Luhn-valid): all digits but the last are permuted, the check digit follows.
  In a run of numbers every part of 13 to 19 digits that begins and ends with a number is tested; where
  valid parts overlap, 16 digits go before 15 and these before others, then the earlier one
* phone numbers with country code, in groups, compact or with a long last group, and North American ones
  in brackets, with dashes or dots: the digits after the country code
* social security numbers with a valid area, group and serial: within the valid ones
* IPv4 addresses: within all addresses
* dates from 1900-01-01 to 2100-01-31 (year first, also before a time, or day first with slashes or dots, or
  month first with slashes where that is the only reading): within these days
* mail addresses are no numbers: their local part becomes as many keyed letters

Numbers without any sign of their kind (ten digits in a row, groups by blanks without a country code) are
no phone numbers. What fails its validation is left as it is. Null text counts as empty. The key is a parameter; the
default is for tests only. Everything is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import whole

ROUNDS = 8
TEST_KEY = "test-key"
FIRST_DAY = "1900-01-01"
DAY_SIDES = (252, 290)  # 73,080 days

# Shapes. Runs are possessive, so a long run is read once.
_CODE = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
SHAPES = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]\d{1,2})(?:[ .-]\d{2}){4}(?!\d)"
    r"|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?|\d{1,5}[ .-])\d{5,10}(?!\d)"
    r"|(?<![\w+])\+\d{1,3}[ .-]\d{7,12}(?!\d)"
    r"|(?<![\w+])\+\d{8,15}(?!\w)"
    r"|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w.+-])(?:1-)?\d{3}-\d{3}-\d{4}(?![\w-])"
    r"|(?<![\w.+-])(?:1\.)?\d{3}\.\d{3}\.\d{4}(?![\w-]|\.\d)",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}(?:(?=T\d)|(?![\w/-]|\.\d))|(?:\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d))",
}
# Numbers of 13 digits or more in all, up to where another value begins.
_OTHER = "|".join(SHAPES[k] for k in ("phone", "ip", "ssn", "date"))
SHAPES["card"] = rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}})\d++(?!\w)(?:[ -](?!{_OTHER})\d++(?!\w))*+"


def _keyed(key: str, label: str, turn: Column, value: Column, modulus: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), F.lit(label), turn.cast("string"), value.cast("string"))
    number = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return F.pmod(number, modulus)


def feistel(key: str, label: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """(l, r) permuted within 0..a-1 and 0..b-1: each round adds a keyed function of the other side."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def turn(state: Column, i: Column) -> Column:
        l, r = state["l"], state["r"]  # noqa: E741
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(l + _keyed(key, label, i, r, a), a)).otherwise(l).alias("l"),
            F.when(even, r).otherwise(F.pmod(r + _keyed(key, label, i, l, b), b)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _then(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value once, so that what uses it does not repeat its expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _padded(number: Column, width: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), width - F.length(text)), text)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _permute_digits(key: str, label: str, digits: Column) -> Column:
    """As many digits, permuted among all strings of that length."""

    def use(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        rest = n - half
        a = F.round(F.pow(F.lit(10.0), half)).cast("bigint")
        b = F.round(F.pow(F.lit(10.0), rest)).cast("bigint")
        left, right = d.substr(F.lit(1), half), d.substr(half + 1, rest)
        state = feistel(key, label, left.cast("bigint"), right.cast("bigint"), a, b)
        return _then(state, lambda s: F.concat(_padded(s["l"], half), _padded(s["r"], rest)))

    return _then(digits, use)


def _into_shape(shape: Column, digits: Column) -> Column:
    """The digits written in the places of the digits of ``shape``."""
    signs = F.split(shape, "")
    empty = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(state: Column, sign: Column) -> Column:
        is_digit = sign.between("0", "9") & (sign != "")
        return F.struct(
            F.concat(state["out"], F.when(is_digit, digits.substr(state["at"], F.lit(1))).otherwise(sign)).alias("out"),
            F.when(is_digit, state["at"] + 1).otherwise(state["at"]).alias("at"),
        )

    return F.aggregate(signs, empty, put, lambda s: s["out"])


def _luhn_sum(digits: Column) -> Column:
    """Sum over the digits, each second one from the right doubled; the last digit counts once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(key: str, value: Column) -> Column:
    def checked(d: Column) -> Column:
        body = _permute_digits(key, "card", d.substr(F.lit(1), F.length(d) - 1))

        def closed(b: Column) -> Column:
            check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10))
            return _into_shape(value, F.concat(b, check.cast("string")))

        valid = (F.pmod(_luhn_sum(d), F.lit(10)) == 0) & F.length(d).between(13, 19) & (F.regexp_replace(d, "0", "") != "")
        return F.when(valid, _then(body, closed)).otherwise(value)

    return _then(_digits(value), checked)


def _cards(key: str, value: Column) -> Column:
    """Every valid card in a run of numbers, each part of 13 to 19 digits tested on the numbers' borders."""

    def joined(numbers: Column, first: Column, last: Column) -> Column:
        return F.array_join(F.slice(numbers, first, last - first + 1), "")

    def best(numbers: Column, n: Column, i: Column) -> Column:
        """(rank, last) of the best part that begins at number ``i``; null without one."""

        def part(j: Column) -> Column:
            def ranked(d: Column) -> Column:
                valid = F.length(d).between(13, 19) & (F.regexp_replace(d, "0", "") != "")
                valid = F.when(valid, F.pmod(_luhn_sum(d), F.lit(10)) == 0).otherwise(False)
                rank = F.when(F.length(d) == 16, 0).when(F.length(d) == 15, 1).otherwise(2)
                return F.when(valid, F.struct(rank.alias("rank"), j.alias("last")))

            return _then(_digits(joined(numbers, i, j)), ranked)

        return F.array_min(F.filter(F.transform(F.sequence(i, F.least(i + 18, n)), part), lambda x: x.isNotNull()))

    def use(numbers: Column) -> Column:
        n = F.size(numbers)
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))

        def replaced(parts: Column) -> Column:
            def put(state: Column, i: Column) -> Column:
                own = F.element_at(parts, i)
                later = F.slice(parts, i + 1, F.coalesce(own["last"] - i, F.lit(0)))
                chosen = own.isNotNull() & ~F.coalesce(F.exists(later, lambda x: F.coalesce(x["rank"] < own["rank"], F.lit(False))), F.lit(False))
                new = F.when(chosen, _card(key, joined(numbers, i, own["last"]))).otherwise(F.element_at(numbers, i))
                inside = i <= state["done"]
                return F.struct(
                    F.concat(state["out"], F.when(inside, F.lit("")).otherwise(new)).alias("out"),
                    F.when(~inside & chosen, own["last"]).otherwise(state["done"]).alias("done"),
                )

            return F.aggregate(F.sequence(F.lit(1), n), start, put, lambda s: s["out"])

        return _then(F.transform(F.sequence(F.lit(1), n), lambda i: best(numbers, n, i)), replaced)

    return _then(F.regexp_extract_all(value, F.lit(r"[ -]?\d+"), F.lit(0)), use)


def _phone(key: str, value: Column) -> Column:
    code = F.regexp_extract(value, rf"^(?:{_CODE}[ .-]?|1[.-])", 0)

    def local(rest: Column) -> Column:
        return _into_shape(rest, _permute_digits(key, "phone", _digits(rest)))

    rest = value.substr(F.length(code) + 1, F.length(value))
    return F.concat(code, _then(rest, local))


def _ip(key: str, value: Column) -> Column:
    def use(p: Column) -> Column:
        part = [F.element_at(p, i).cast("bigint") for i in range(1, 5)]
        valid = (part[0] < 256) & (part[1] < 256) & (part[2] < 256) & (part[3] < 256)
        side = F.lit(65536).cast("bigint")
        state = feistel(key, "ip", part[0] * 256 + part[1], part[2] * 256 + part[3], side, side)
        high, low = (lambda s: F.floor(s / 256).cast("bigint").cast("string")), (lambda s: (s % 256).cast("string"))
        out = _then(state, lambda s: F.concat_ws(".", high(s["l"]), low(s["l"]), high(s["r"]), low(s["r"])))
        return F.when(valid, out).otherwise(value)

    return _then(F.split(value, r"\."), use)


def _ssn(key: str, value: Column) -> Column:
    area, group, serial = value.substr(1, 3).cast("int"), value.substr(5, 2).cast("int"), value.substr(8, 4).cast("int")
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    rest = (group - 1) * 9999 + serial - 1
    state = feistel(key, "ssn", place, rest, F.lit(898).cast("bigint"), F.lit(99 * 9999).cast("bigint"))

    def written(s: Column) -> Column:
        new = F.when(s["l"] >= 665, s["l"] + 2).otherwise(s["l"] + 1)
        return F.concat_ws(
            "-",
            _padded(new, F.lit(3)),
            _padded(F.floor(s["r"] / 9999).cast("bigint") + 1, F.lit(2)),
            _padded(s["r"] % 9999 + 1, F.lit(4)),
        )

    return F.when(valid, _then(state, written)).otherwise(value)


def _date(key: str, value: Column) -> Column:
    is_iso = value.substr(5, 1) == "-"
    year, first, second = value.substr(7, 4), value.substr(1, 2), value.substr(4, 2)
    day_first, month_first = F.concat_ws("-", year, second, first), F.concat_ws("-", year, first, second)
    is_month_first = ~is_iso & day_first.try_cast("date").isNull() & (value.substr(3, 1) == "/")
    iso = F.when(is_iso, value).when(is_month_first, month_first).otherwise(day_first)
    sides = [F.lit(x).cast("bigint") for x in DAY_SIDES]

    def use(day: Column) -> Column:
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        state = feistel(key, "date", F.floor(n / DAY_SIDES[1]), n % DAY_SIDES[1], *sides)
        new = _then(state, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAY_SIDES[1] + s["r"]).cast("int")))
        sign = value.substr(3, 1)

        def turned(t: Column) -> Column:
            day, month = t.substr(9, 2), t.substr(6, 2)
            head = F.when(is_month_first, F.concat(month, sign, day)).otherwise(F.concat(day, sign, month))
            return F.concat(head, sign, t.substr(1, 4))

        text = _then(new.cast("string"), lambda t: F.when(is_iso, t).otherwise(turned(t)))
        valid = day.isNotNull() & n.between(0, DAY_SIDES[0] * DAY_SIDES[1] - 1)
        return F.when(valid, text).otherwise(value)

    return _then(iso.try_cast("date"), use)


def _mail(key: str, value: Column) -> Column:
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    keyed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(value)), 256)
    letters = F.translate(F.repeat(keyed, F.ceil(F.length(local) / 64).cast("int")), "0123456789", "ghijklmnop")
    return F.concat(letters.substr(F.lit(1), F.length(local)), F.lit("@"), host)


_MAKERS = {"mail": _mail, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date, "card": _cards}


def pseudonymise(docs: DataFrame, key: str = TEST_KEY, text: str = "text") -> DataFrame:
    """(row, text, values): the row as a struct, its text with pseudonyms, and each value's kind and
    whether it was replaced."""
    pattern = "|".join(f"(?:{p})" for p in SHAPES.values())
    rows = docs.select(F.struct("*").alias("row"), whole(text).alias("_text"))
    found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))

    def replaced(m: Column) -> Column:
        out = None
        for kind, shape in SHAPES.items():
            here = F.struct(F.lit(kind).alias("kind"), _MAKERS[kind](key, m).alias("new"))
            is_kind = m.rlike(f"^(?:{shape})$")
            out = F.when(is_kind, here) if out is None else out.when(is_kind, here)
        return out

    rows = rows.withColumn("_found", found)
    rows = rows.withColumn("_new", F.transform("_found", replaced))
    pieces = F.split("_text", pattern, -1)
    new = F.transform("_new", lambda x: x["new"])
    joined = F.array_join(F.zip_with(pieces, new, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    values = F.zip_with("_found", "_new", lambda m, x: F.struct(x["kind"].alias("kind"), (m != x["new"]).alias("replaced")))
    return rows.select("row", F.when(F.size("_found") == 0, F.col("_text")).otherwise(joined).alias("text"), values.alias("values"))
