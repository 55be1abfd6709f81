"""Format-preserving pseudonyms for personal data, in SQL functions only.

A value is found by its shape, validated (check digit, calendar, number plan, octets), numbered within the set of all
valid values of its shape, moved by a keyed Feistel permutation of that set, and written back in the shape it had. So
a pseudonym is valid, two values never share one, and equal values have equal pseudonyms in all documents. Addresses of
mail and secrets have no such numbering and take letters of a keyed digest.

The permutation works on pairs (a, b), a < A and b < B: in turn a += F(b) mod A and b += F(a) mod B, where F is the
keyed SHA-256 of the round, the shape and the other half. Each step is invertible, so no value has to be walked.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlake.llm.common import fresh

#: Steps of the permutation, five for each half.
ROUNDS = 10
#: The setting of the session that holds the key; by its name Spark blanks it out in its own pages.
KEY_SETTING = "spark.martlake.pii.secret"
_drawn: dict[str, str] = {}

#: The shapes, in the order in which they're tried at a place. Repeated groups are possessive or bounded, so that no text
#: makes the matcher recurse.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+\-\p{L}\p{N}])[A-Za-z0-9_\p{L}\p{N}][A-Za-z0-9._%+\-\p{L}\p{N}\p{M}]*+@[A-Za-z0-9\-\p{L}\p{N}\p{M}]++(?:\.[A-Za-z0-9\-\p{L}\p{N}\p{M}]++)++",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey)\s?[=:]\s?[\"']?[A-Za-z0-9_+/!@#$%^&*-]{8,}+[\"']?",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}+\.){3}[0-9]{1,3}+(?!\.?[0-9])",
    "date": r"(?<![0-9.\-/])(?:[0-9]{4}(?<dy>[./-])[0-9]{2}\k<dy>[0-9]{2}|[0-9]{2}(?<ds>[./-])[0-9]{2}\k<ds>[0-9]{4})(?![0-9\-/])",
    "phone": r"(?<![0-9+])(?:(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}"
    r"|(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])|(?:1[ .-]?)?\([0-9]{3}\) ?)[0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|\b[Ss][Ss][Nn][ :#]{1,3}[0-9]{9}(?![0-9-])",
    "foreign_phone": r"(?<![0-9A-Za-z+])\+[2-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,5}\))?(?:[ .-]?[0-9]{2,5}){2,4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?<cs>[ -])[0-9]{4}\k<cs>[0-9]{4}\k<cs>[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9-])",
}
PATTERN = "|".join(f"(?:{x})" for x in SHAPES.values())

#: Days of the 400-year Gregorian cycle from 1800-01-01, 146097 = 189 * 773; and its first day.
CYCLE, CYCLE_A, CYCLE_B, CYCLE_START = 146097, 189, 773, "1800-01-01"
#: Days of the cycle after the twelfth of their month, 146097 - 12 * 4800 = 88497 = 9 * 9833.
LATE_A, LATE_B = 9, 9833


def key_of(spark: SparkSession) -> str:
    """The session's key. Where none is set, one is drawn that lasts as long as the session: equal values are linked in
    all its documents, but nobody can undo the pseudonyms later, or link them to those of another session."""
    key = spark.conf.get(KEY_SETTING, None)
    return key or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _long(x: Column) -> Column:
    return x.cast("long")


def _is(x: Column, shape: str) -> Column:
    return x.rlike(f"^(?:{SHAPES[shape]})$")


def permute(a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column, key: str, inverse: bool = False) -> Column:
    """The struct (a, b) that a pair is moved to among all pairs below the sizes (a thousand millions at most)."""

    def step(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        other = F.when(odd, s["b"]).otherwise(s["a"])
        size = F.when(odd, size_a).otherwise(size_b)
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), other.cast("string")), 256)
        shift = _long(F.conv(F.substring(digest, 1, 15), 16, 10)) % size
        own = F.when(odd, s["a"]).otherwise(s["b"])
        moved = (own + (size - shift if inverse else shift)) % size
        return F.struct(F.when(odd, moved).otherwise(s["a"]).alias("a"), F.when(odd, s["b"]).otherwise(moved).alias("b"))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, F.struct(_long(a).alias("a"), _long(b).alias("b")), step)


def fill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order, by those given."""

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["done"], F.when(digit, F.substring(s["rest"], 1, 1)).otherwise(c)).alias("done"),
            F.when(digit, F.substring(s["rest"], 2, 99)).otherwise(s["rest"]).alias("rest"),
        )

    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("done"), digits.alias("rest")), step)["done"]


def _luhn(x: Column) -> Column:
    return F.call_function("luhn_check", x)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once: as the variable of a lambda."""
    return F.transform(F.array(value), use)[0]


def _permuted_digits(d: Column, shape: str, key: str, inverse: bool) -> Column:
    """Up to 18 digits, moved among all numbers of as many digits."""
    n = F.length(d)
    low = F.floor(n / 2).cast("int")
    size_b = _long(F.pow(F.lit(10), low))
    size_a = _long(F.pow(F.lit(10), n - low))
    moved = permute(_long(d.substr(F.lit(1), n - low)), _long(d.substr(n - low + 1, low)), size_a, size_b, F.concat(F.lit(shape), n.cast("string")), key, inverse)
    return _with(moved, lambda p: F.concat(_padded(p["a"], n - low), _padded(p["b"], low)))


def _foreign_phone(m: Column, key: str, inverse: bool) -> Column:
    """Eight to fifteen digits; the first two, with the country's code, stay."""

    def of(d: Column) -> Column:
        moved = F.concat(F.substring(d, 1, 2), _permuted_digits(F.substring(d, 3, 13), "phone", key, inverse))
        return F.when((F.length(d) >= 8) & (F.length(d) <= 15), fill(m, moved)).otherwise(m)

    return _with(_digits(m), of)


def _mod97(x: Column) -> Column:
    """Of an account number in its check's order, with letters as numbers from 10 on."""

    def step(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)

    return F.aggregate(F.split(x, ""), F.lit(0), lambda r, c: step(r, c).cast("int"))


def _iban(m: Column, key: str, inverse: bool) -> Column:
    """The last digits of the account (18 at most) are moved and the check digits follow; country and letters stay."""

    def of(x: Column) -> Column:
        account = F.substring(x, 5, 30)
        digits = _digits(account)
        kept = F.greatest(F.length(digits) - 18, F.lit(0))
        moved = F.concat(digits.substr(F.lit(1), kept), _permuted_digits(digits.substr(kept + 1, F.lit(18)), "iban", key, inverse))

        def checked(new: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(new, F.substring(x, 1, 2), F.lit("00")))).cast("string"), 2, "0")
            return fill(m, F.concat(check, _digits(new)))

        valid = (F.length(x) >= 15) & (F.length(x) <= 34) & (F.length(digits) >= 4) & (_mod97(F.concat(account, F.substring(x, 1, 4))) == 1)
        return F.when(valid, _with(fill(account, moved), checked)).otherwise(m)

    return _with(F.regexp_replace(m, " ", ""), of)


def _card(m: Column, key: str, inverse: bool) -> Column:
    def of(d: Column) -> Column:
        n = F.length(d) - 1  # without the check digit
        whole = _permuted_digits(d.substr(F.lit(1), n), "card", key, inverse)
        return _with(whole, lambda w: F.concat(w, F.filter(F.array(*(F.lit(str(k)) for k in range(10))), lambda c: _luhn(F.concat(w, c)))[0]))

    return _with(_digits(m), lambda d: F.when(_luhn(d), fill(m, of(d))).otherwise(m))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    """Ten digits; the country code stays. Numbers of the plan (area and exchange from 200 to 999) are moved among each
    other, and so are all others."""

    def of(d: Column) -> Column:
        part = lambda k, n: _long(F.substring(d, k, n))
        area, exchange, line = part(-10, 3), part(-7, 3), part(-4, 4)
        plan = (area >= 200) & (exchange >= 200)
        ten = lambda a, e, n: F.concat(_padded(a, 3), _padded(e, 3), _padded(n, 4))

        def planned(p: Column) -> Column:
            y = p["a"] * 80000 + p["b"]
            return ten(F.floor(y / 8_000_000) + 200, F.floor(y / 10000) % 800 + 200, y % 10000)

        def other(p: Column) -> Column:  # areas below 200 with any exchange, then the other areas with exchanges below 200
            y = p["a"] * 60000 + p["b"]
            rest = F.floor(y / 10000) - 200_000
            low = y < 2_000_000_000
            return ten(F.when(low, F.floor(y / 10_000_000)).otherwise(F.floor(rest / 200) + 200), F.when(low, F.floor(y / 10000) % 1000).otherwise(rest % 200), y % 10000)

        def moved(x: Column, size: int, tweak: str, text) -> Column:
            return _with(x, lambda v: _with(permute(F.floor(v / size), v % size, F.lit(size), F.lit(size), F.lit(tweak), key, inverse), text))

        ordinary = ((area - 200) * 800 + exchange - 200) * 10000 + line
        odd = F.when(area < 200, (area * 1000 + exchange) * 10000 + line).otherwise(2_000_000_000 + ((area - 200) * 200 + exchange) * 10000 + line)
        whole = F.when(plan, moved(ordinary, 80000, "phone", planned)).otherwise(moved(odd, 60000, "other phone", other))
        return F.concat(F.substring(d, 1, 1).substr(F.lit(1), F.length(d) - 10), whole)

    return _with(_digits(m), lambda d: fill(m, of(d)))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""

    def of(d: Column) -> Column:
        area, group, serial = (_long(F.substring(d, k, n)) for k, n in ((1, 3), (4, 2), (6, 4)))
        index = F.when(area > 666, area - 2).otherwise(area - 1)
        moved = permute(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key, inverse)

        def text(p: Column) -> Column:
            k = F.floor(p["a"] / 99)
            return F.concat(_padded(F.when(k >= 665, k + 2).otherwise(k + 1), 3), _padded(p["a"] % 99 + 1, 2), _padded(p["b"] + 1, 4))

        return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), fill(m, _with(moved, text))).otherwise(m)

    return _with(_digits(m), of)


def _ip(m: Column, key: str, inverse: bool) -> Column:
    def of(o: Column) -> Column:
        moved = permute(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit("ip"), key, inverse)
        text = lambda p: F.concat_ws(".", *((F.floor(p[h] / 256) if k == 0 else p[h] % 256).cast("string") for h in "ab" for k in (0, 1)))
        plain = F.concat_ws(".", F.transform(o, lambda x: x.cast("string"))) == m  # no leading zeros
        return F.when(plain & F.forall(o, lambda x: x < 256), _with(moved, text)).otherwise(m)

    return _with(F.transform(F.split(m, "\\."), _long), of)


def _date(m: Column, key: str, inverse: bool) -> Column:
    """A day of the Gregorian cycle from 1800 to 2199. Where the year comes last, the day is before the month; if that
    makes no date, the month is before the day. These have days after the twelfth, and are moved among each other."""
    plain, start = F.translate(m, "./-", "---"), F.lit(CYCLE_START).cast("date")
    year_first = F.substring(plain, 5, 1) == "-"
    parsed = lambda form: F.try_to_timestamp(plain, F.lit(form)).cast("date")
    first = F.when(year_first, parsed("yyyy-MM-dd")).otherwise(parsed("dd-MM-yyyy"))
    second = F.when(~year_first, parsed("MM-dd-yyyy"))
    written = lambda day, form: fill(m, F.date_format(day, form))

    def of(n: Column) -> Column:
        moved = permute(F.floor(n / CYCLE_B), n % CYCLE_B, F.lit(CYCLE_A), F.lit(CYCLE_B), F.lit("date"), key, inverse)
        day = lambda p: F.date_add(start, (p["a"] * CYCLE_B + p["b"]).cast("int"))
        text = lambda p: F.when(year_first, written(day(p), "yyyyMMdd")).otherwise(written(day(p), "ddMMyyyy"))
        return F.when((n >= 0) & (n < CYCLE), _with(moved, text)).otherwise(m)

    month = lambda q: F.add_months(start, q.cast("int"))
    late_before = lambda q: _long(F.datediff(month(q), start)) - 12 * q  # noqa: E731  days after the twelfth in q months

    def late(day: Column) -> Column:
        months = _long((F.year(day) - 1800) * 12 + F.month(day) - 1)
        index = _long(F.datediff(day, start)) - 12 * (months + 1)
        moved = permute(F.floor(index / LATE_B), index % LATE_B, F.lit(LATE_A), F.lit(LATE_B), F.lit("late date"), key, inverse)

        def text(i: Column) -> Column:
            near = F.floor(i * 4800 / (LATE_A * LATE_B))
            at = F.array_max(F.filter(F.sequence(near - 3, near + 3), lambda q: (q >= 0) & (late_before(q) <= i)))
            return _with(at, lambda q: written(F.date_add(month(q), (12 + i - late_before(q)).cast("int")), "MMddyyyy"))

        inside = (F.year(day) >= 1800) & (F.year(day) < 2200)
        return F.when(inside, _with(moved, lambda p: _with(p["a"] * LATE_B + p["b"], text))).otherwise(m)

    return F.when(first.isNotNull(), _with(_long(F.datediff(first, start)), of)).when(second.isNotNull(), _with(second, late)).otherwise(m)


def _letters(digest: Column) -> Column:
    return F.translate(digest, "0123456789", "ghijklmnop")


def _email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(_letters(F.substring(digest, 1, 16)), F.lit("@"), _letters(F.substring(digest, 17, 8)), F.lit(".example"))


def _secret(m: Column, key: str) -> Column:
    """What follows the label becomes hexadecimal digits of a keyed digest, in the same number up to 64."""
    label = F.regexp_extract(m, r"^(AKIA|[A-Za-z_]+\s?[=:]\s?[\"']?)", 1)
    end = F.regexp_extract(m, r"([\"']?)$", 1)
    value = m.substr(F.length(label) + 1, F.length(m) - F.length(label) - F.length(end))
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256)
    own = F.substring(digest, 1, 64).substr(F.lit(1), F.least(F.length(value), F.lit(64)))
    return F.concat(label, F.when(label == "AKIA", F.upper(own)).otherwise(own), end)


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a value of one of the shapes; the value itself if it isn't valid. The inverse undoes numbers and
    dates; mail and secrets stay as they are then."""
    out = F.when(_is(value, "email"), value if inverse else _email(value, key)).when(_is(value, "secret"), value if inverse else _secret(value, key))
    for shape, move in (("ip", _ip), ("date", _date), ("phone", _phone), ("ssn", _ssn), ("foreign_phone", _foreign_phone), ("iban", _iban), ("card", _card)):
        out = out.when(_is(value, shape), move(value, key, inverse))
    return out.otherwise(value)


def _replaced(docs: DataFrame, key: str, count: str) -> DataFrame:
    """``docs`` with its text replaced and a column of the number of values that changed."""
    found, moved = fresh(docs, "found", "moved")
    text = F.col("text").cast("string")
    out = docs.withColumn(found, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    out = out.withColumn(moved, F.transform(found, lambda m: pseudonym(m, key)))
    between = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(between, F.array_append(moved, F.lit("")), lambda a, b: F.concat(a, b)), "")
    changed = F.size(F.filter(F.zip_with(found, moved, lambda a, b: a != b), lambda x: x))
    hit = F.size(found) > 0
    counted = out.withColumn(count, F.when(hit, changed).otherwise(0).cast("long"))
    return counted.withColumn("text", F.when(hit, joined).otherwise(F.col("text"))).drop(found, moved)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with all columns; personal data in ``text`` are replaced and ``n_chars``, if there, follows the text.

    A null text stays null, a text without valid values stays as it is. Rows are independent: there is no shuffle, and
    repeated rows, empty tables, null ids and further columns of any name need no care. Values that fail validation (a
    wrong check digit, the 30th of February, an octet of 256) are left alone.
    """
    (count,) = fresh(docs, "changed")
    out = _replaced(docs, key, count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text (null stays null), n_pii (values replaced; 0 for a null text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _replaced(plain, key, "n_pii").select("doc_id", "text", "n_pii")
