"""Format-preserving pseudonyms for personal data, by Feistel networks in SQL.

Candidates are found by one pattern, validated, and permuted within their format
under a key: the digits of a card number (a Luhn number stays one), of a telephone
number (punctuation and country code stay), of a social security number, an
Internet address (its 32 bits), a calendar date (its day number between 1900 and
2099) and the hex digits of a secret. An e-mail address gets a keyed name of the
same kind. Pseudonyms depend on the value and the key alone, so equal values stay
equal in and across documents, and as the number networks are permutations,
different values stay different.

Numbers that don't validate (a card number with a wrong check digit, an octet over
255, the 31st of April) are left as they are.

Only DataFrame functions are used. Defined results: a null text stays null and has
no finds; no text is too long, whatever runs of digits, labels or signs it holds, since no
pattern recurses without a limit (of a name of more than 127 labels the first ones
count); other columns pass through; columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Production keys come from the caller; this one is for tests and queries over synthetic data.
DEMO_KEY = "demonstration key"

_CARD = r"(?<![\p{L}\p{N}_])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}_])"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\p{N}+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{N}.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{N}-])"
_SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
_IP = r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\p{N})"
_DATE = r"(?<![\p{N}/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\p{N}/-])"
_SECRET = r"(?<![\p{L}\p{N}])(?=[0-9a-f]{0,63}\d)[0-9a-f]{32,128}(?![\p{L}\p{N}])"
#: Names have 127 labels at most. The limit is needed: a group that repeats without one is matched by recursion, as deep as the text is long.
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
_EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@{_LABEL}(?:\.{_LABEL}){{0,125}}\.\p{{L}}{{2,}}"
#: One look at the next character decides which alternatives are tried at all.
CANDIDATE = rf"(?=[0-9+(])(?:{'|'.join((_DATE, _SSN, _IP, _PHONE, _CARD))})|(?=[0-9a-f]){_SECRET}|{_EMAIL}"
#: What every candidate has.
_NEEDED = "[0-9@]"


def _digest52(*parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("long")


def _power10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_number(value: Column, left: Column, right: Column, tag: Column, key: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1 by a Feistel network with uneven halves.

    ``left`` and ``right`` are at most 10**9; ``tag`` keeps formats apart.
    """
    start = F.struct(((value - F.pmod(value, right)) / right).cast("long").alias("a"), F.pmod(value, right).alias("b"))

    def turn(acc: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, left).otherwise(right)
        mixed = F.pmod(acc["a"] + _digest52(F.lit(key), tag, i.cast("string"), acc["b"].cast("string")), size)
        return F.struct(acc["b"].alias("a"), mixed.alias("b"))

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])  # an even number, so the halves end where they began
    return F.aggregate(rounds, start, turn, lambda acc: acc["a"] * right + acc["b"])


def permute_digits(digits: Column, tag: str, key: str) -> Column:
    """A keyed permutation of the digit strings of each length up to 18, and of longer ones' last 18 digits."""
    n = F.least(F.length(digits), F.lit(18))
    head = F.substring(digits, F.lit(1), F.length(digits) - n)
    low = F.right(digits, n).cast("long")
    half = F.floor(n / 2)
    label = F.concat(F.lit(tag + ":"), n.cast("string"), F.lit(":"), head)
    moved = permute_number(low, _power10(half), _power10(n - half), label, key)
    return F.concat(head, F.lpad(moved.cast("string"), n, F.lit("0")))


def permute_hex(text: Column, key: str) -> Column:
    """A keyed permutation of the hex strings of each length, on halves of up to 64 digits."""
    n = F.floor(F.length(text) / 2)
    m = F.length(text) - n
    start = F.struct(F.substring(text, F.lit(1), n).alias("a"), F.substring(text, n + 1, m).alias("b"))

    def xor(a: Column, b: Column) -> Column:
        digits = F.transform(
            F.sequence(F.lit(1), F.length(a)),
            lambda i: F.lower(F.hex(F.conv(F.substring(a, i, F.lit(1)), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, i, F.lit(1)), 16, 10).cast("long")))),
        )
        return F.array_join(digits, "")

    def turn(acc: Column, i: Column) -> Column:
        pad = F.sha2(F.concat_ws("|", F.lit(key), F.lit("hex"), i.cast("string"), acc["b"]), 256)
        return F.struct(acc["b"].alias("a"), xor(acc["a"], pad).alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _with_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""
    chars = F.split(shape, "")
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        new = F.when(is_digit, F.substring(digits, acc["k"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.when(is_digit, acc["k"] + 1).otherwise(acc["k"]).alias("k"), F.concat(acc["out"], new).alias("out"))

    return F.aggregate(chars, start, put, lambda acc: acc["out"])


def luhn_sum(digits: Column, shift: int = 0) -> Column:
    """The Luhn sum; ``shift`` 1 counts as if a check digit followed."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(F.pmod(i + shift, F.lit(2)) == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), one), F.lit(0), lambda a, b: a + b)


def _card(c: Column, key: str) -> Column:
    digits = _digits(c)
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    moved = permute_digits(payload, "card", key)
    return F.element_at(
        F.transform(
            F.array(moved),
            lambda p: _with_digits(c, F.concat(p, F.pmod(F.lit(10) - F.pmod(luhn_sum(p, 1), F.lit(10)), F.lit(10)).cast("string"))),
        ),
        1,
    )


def _is_card(c: Column) -> Column:
    d = _digits(c)
    return F.length(d).between(13, 19) & ~d.rlike("^0+$") & (F.pmod(luhn_sum(d), F.lit(10)) == 0)


def _phone(c: Column, key: str) -> Column:
    code = F.regexp_extract(c, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(c, F.length(code) + 1, F.length(c))
    return F.concat(code, _with_digits(rest, permute_digits(_digits(rest), "phone", key)))


def _ip(c: Column, key: str) -> Column:
    parts = F.split(c, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))
    moved = permute_number(value, F.lit(65536).cast("long"), F.lit(65536).cast("long"), F.lit("ip"), key)
    return F.element_at(
        F.transform(F.array(moved), lambda v: F.array_join(F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]), lambda s: F.call_function("shiftright", v, s).bitwiseAND(255).cast("string")), ".")), 1
    )


def _date(c: Column) -> Column:
    """The date that is written, or null."""
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "dd/MM/yyyy"), F.try_to_date(c, "dd.MM.yyyy"), F.try_to_date(c, "MM/dd/yyyy"))


_FIRST_DAY, _DAYS = "1900-01-01", 73049  # to 2099-12-31


def _moved_date(c: Column, key: str) -> Column:
    # 73049 = 283 * 258 + 35: the network permutes 283 * 259 numbers, walked until a day of the range comes up
    left, right = F.lit(283).cast("long"), F.lit(259).cast("long")
    start = F.datediff(_date(c), F.lit(_FIRST_DAY).cast("date")).cast("long")

    def step(v: Column, i: Column) -> Column:
        return F.when((i > 0) & (v < _DAYS), v).otherwise(permute_number(v, left, right, F.lit("date"), key))

    day = F.aggregate(F.array(*[F.lit(i) for i in range(8)]), start, step)
    # month first: only if day first isn't a date
    american = F.try_to_date(c, "dd/MM/yyyy").isNull() & c.contains("/")
    out = F.date_add(F.lit(_FIRST_DAY).cast("date"), day.cast("int"))
    return (
        F.when(c.contains("-"), F.date_format(out, "yyyy-MM-dd"))
        .when(american, F.date_format(out, "MM/dd/yyyy"))
        .when(c.contains("/"), F.date_format(out, "dd/MM/yyyy"))
        .otherwise(F.date_format(out, "dd.MM.yyyy"))
    )


def kind_of(c: Column) -> Column:
    """The kind of a candidate, or null if it doesn't validate."""
    octets = F.forall(F.split(c, r"\."), lambda p: p.cast("int") <= 255)
    ssn = ~c.rlike("^(000|666|9)") & ~c.rlike("-00-") & ~c.rlike("-0000$")
    days = F.datediff(_date(c), F.lit(_FIRST_DAY).cast("date"))
    return (
        F.when(c.contains("@"), F.lit("email"))
        .when(c.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$"), F.when(days.between(0, _DAYS - 1), F.lit("date")))
        .when(c.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(ssn, F.lit("ssn")))
        .when(c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(octets, F.lit("ip")))
        .when(c.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), F.when(F.length(_digits(c)).between(8, 15), F.lit("phone")))
        .when(c.rlike(r"^\d(?:[ -]?\d){12,18}$"), F.when(_is_card(c), F.lit("card")))
        .when(c.rlike(r"^[0-9a-f]{32,128}$"), F.lit("secret"))
    )


def pseudonym(c: Column, key: str) -> Column:
    """The pseudonym of a candidate, or the candidate if it doesn't validate."""
    kind = kind_of(c)
    name = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(c)), 256), 1, 16), F.lit("@mail.example.invalid"))
    return (
        F.when(kind == "email", name)
        .when(kind == "date", _moved_date(c, key))
        .when(kind == "ssn", _with_digits(c, permute_digits(_digits(c), "ssn", key)))
        .when(kind == "ip", _ip(c, key))
        .when(kind == "phone", _phone(c, key))
        .when(kind == "card", _card(c, key))
        .when(kind == "secret", permute_hex(c, key))
        .otherwise(c)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in text replaced, and ``n_pii``: how many values were."""
    candidates = F.when(F.col("text").rlike(_NEEDED), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    found = docs.drop("n_pii").withColumn("__found", candidates)
    some = F.coalesce(F.size("__found"), F.lit(0)) > 0
    new = F.transform("__found", lambda c: pseudonym(c, key))
    kinds = F.size(F.filter("__found", lambda c: kind_of(c).isNotNull()))
    between = F.split("text", CANDIDATE, -1)
    joined = F.array_join(F.zip_with(F.col("__between"), F.concat(F.col("__new"), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return (
        found.withColumn("__between", F.when(some, between))
        .withColumn("__new", F.when(some, new))
        .withColumn("n_pii", F.when(some, kinds).otherwise(0).cast("long"))
        .withColumn("text", F.when(some, joined).otherwise(F.col("text")))
        .drop("__found", "__between", "__new")
        .select(*[x for x in docs.columns if x != "n_pii"], "n_pii")
    )
