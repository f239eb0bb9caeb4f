"""Format-preserving pseudonyms for personal data, with built-in functions only.

E-mail addresses, telephone and card numbers, IPv4 addresses, dates, passwords and keys are found,
validated, and replaced by a keyed permutation of all valid values of the same format: a Feistel
network whose round function is SHA-256 of the key. Equal values get equal pseudonyms in all
documents, different values different ones, and punctuation stays where it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Longest run of symbols that is permuted as one number, by the size of their alphabet; a longer one
#: is permuted in pieces. Half a piece stays below the 52 bits that a round draws.
PIECES = {10: 24, 16: 24, 36: 20, 62: 16}
#: Fixed value: the symbols in the order of their numbers.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters that are put back into their places together.
STRIDE = 256
#: Names of secrets, in any case and perhaps quoted.
NAME = r"(?i:password|passwd|pwd|secret|api[_-]?key|access_token)[\x22']?+[ \t]*+"
NAMED = NAME + "[=:]"
VALUE = r"[^\s\x22'<>]{6,}+"
#: What follows a colon without a quote is taken for a secret only if it does not look like prose.
UNLIKE_PROSE = r"(?=[^\s\x22'<>]*(?:[0-9!@#$%^&*_+=~|/\\]|[a-z][A-Z]))"
#: The accepted forms. An address starts where its run of characters does, so that
#: a long text without spaces is read once.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"(?<![\w+(])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\w)",
    "date": r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "password": r"(?<![0-9A-Za-z_])" + NAME + r"(?:=[ \t]*+[\x22']?+|:[ \t]*+(?:[\x22']|" + UNLIKE_PROSE + "))" + VALUE,
    "access_key": r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "key": r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
ANY = "|".join(FORMS.values())
#: What a text with any form has somewhere.
HINT = r"[@0-9]|[a-f]{32}|A[KS]IA|" + NAMED
DATE_FORMS = {"-": "yyyy-MM-dd", ".": "dd.MM.yyyy", "/": "MM/dd/yyyy"}
#: Days of the Gregorian cycle of 400 years, 189 * 773, from the first of 1800.
FIRST_DAY, DAYS, DAY_RADIX = "1800-01-01", 146_097, 773


def _feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str, tweak: Column) -> Column:
    """Permute the pair (left, right) of left_size * right_size values; a struct of both."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        seen = F.when(even, pair["r"]).otherwise(pair["l"])
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), tweak.cast("string"), i.cast("string"), seen.cast("string")), 256)
        drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
        return F.struct(
            F.when(even, (pair["l"] + drawn) % left_size).otherwise(pair["l"]).alias("l"),
            F.when(even, pair["r"]).otherwise((pair["r"] + drawn) % right_size).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _number(symbols: Column, radix: int) -> Column:
    if radix <= 36:
        return F.when(F.length(symbols) > 0, F.conv(symbols, radix, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    each = F.filter(F.split(symbols, ""), lambda c: c != "")
    return F.aggregate(each, F.lit(0).cast("long"), lambda n, c: n * radix + F.position(c, F.lit(ALPHABET)) - 1)


def _symbols(number: Column, length: Column, radix: int) -> Column:
    if radix <= 36:
        text = F.lower(F.conv(number.cast("string"), 10, radix))
        return F.when(length > 0, F.lpad(text, length, "0")).otherwise(F.lit(""))
    places = F.filter(F.sequence(length - 1, F.lit(-1), F.lit(-1)), lambda i: i >= 0)
    at = lambda i: (F.floor(_over(number, _power(radix, i))) % radix).cast("int") + 1
    return F.array_join(F.transform(places, lambda i: F.substring(F.lit(ALPHABET), at(i), F.lit(1))), "")


def _over(number: Column, by: Column) -> Column:
    """Whole quotient of longs, without doubles."""
    return F.call_function("div", number, by)


def _power(radix: int, exponent: Column) -> Column:
    """radix ** exponent, exact, for an exponent of up to half a piece."""
    powers = F.array(*[F.lit(radix**i).cast("long") for i in range(PIECES[radix] // 2 + 1)])
    return F.element_at(powers, exponent + 1)


def _permute(symbols: Column, radix: int, key: str, kind: str) -> Column:
    """Permute strings of any length over the first ``radix`` symbols of ``ALPHABET``."""
    width = PIECES[radix]

    def piece(i: Column) -> Column:
        part = F.substring(symbols, i * width + 1, F.lit(width))
        size = F.length(part)
        split = F.floor(size / 2).cast("int")
        left, right = F.substring(part, F.lit(1), split), F.substring(part, split + 1, F.lit(width))
        both = _feistel(
            _number(left, radix), _number(right, radix), _power(radix, split), _power(radix, size - split), key, kind,
            F.concat_ws(",", i.cast("string"), F.length(symbols).cast("string")),
        )
        # aggregate() is evaluated once: its fields are read in a lambda over a one-element array
        return F.element_at(
            F.transform(F.array(both), lambda b: F.concat(_symbols(b["l"], split, radix), _symbols(b["r"], size - split, radix))), 1
        )

    last = F.floor((F.length(symbols) - 1) / width).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), piece), "")


def _put_back(layout: Column, symbols: Column, slot: str) -> Column:
    """``layout`` with its characters of class ``slot`` replaced by ``symbols`` in order."""

    def cut(both: Column, at: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(both["layout"], F.lit(1), at), f"[^{slot}]", ""))
        return F.struct(
            F.substring(both["layout"], at + 1, F.lit(STRIDE)).alias("layout"), F.substring(both["symbols"], before + 1, F.lit(STRIDE)).alias("symbols")
        )

    def fill(both: Column) -> Column:
        def place(c: Column, i: Column) -> Column:
            before = F.length(F.regexp_replace(F.substring(both["layout"], F.lit(1), i), f"[^{slot}]", ""))
            return F.when(c.rlike(f"[{slot}]"), F.substring(both["symbols"], before + 1, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(both["layout"], ""), lambda c: c != ""), place), "")

    def whole(both: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(both["layout"]) - 1, F.lit(0)), F.lit(STRIDE))
        return F.array_join(F.transform(F.transform(starts, lambda at: cut(both, at)), fill), "")

    # evaluated once, then read in a lambda over a one-element array
    return F.element_at(F.transform(F.array(F.struct(layout.alias("layout"), symbols.alias("symbols"))), whole), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled_from_end: int) -> Column:
    """Luhn sum; the digit at place ``doubled_from_end`` from the end (1: last) and every second
    one before it are doubled."""
    numbers = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    parts = F.transform(
        numbers,
        lambda d, i: F.when((i + 1 - doubled_from_end) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d),
    )
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d)


def _email(text: Column, key: str) -> Column:
    """The local part is permuted over letters and digits (case folded); the domain stays."""
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    plain = F.lower(F.regexp_replace(local, "[^0-9A-Za-z]", ""))
    changed = F.when(F.length(plain) > 0, _put_back(local, _permute(plain, 36, key, "email"), "0-9A-Za-z")).otherwise(local)
    return F.concat(changed, F.lit("@"), domain)


def _phone(text: Column, key: str) -> Column:
    """Area and exchange start with 2 to 9: 800 * 8,000,000 numbers. A leading 1 stays."""
    all_digits = _digits(text)
    ten = F.substring(all_digits, F.length(all_digits) - 9, F.lit(10))
    area = F.substring(ten, 1, 3).cast("long") - 200
    rest = F.substring(ten, 4, 7).cast("long") - 2_000_000
    both = _feistel(area, rest, F.lit(800), F.lit(8_000_000), key, "phone", F.lit(0))
    prefix = F.substring(all_digits, F.lit(1), F.length(all_digits) - 10)
    digits = F.transform(F.array(both), lambda b: F.concat((b["l"] + 200).cast("string"), (b["r"] + 2_000_000).cast("string")))
    return _put_back(text, F.concat(prefix, F.element_at(digits, 1)), "0-9")


def _card(text: Column, key: str) -> Column:
    """The first digit stays, the others but the last are permuted, the last is the Luhn check
    digit. Numbers that fail the check are left alone."""
    digits = _digits(text)
    body = F.substring(digits, F.lit(2), F.length(digits) - 2)
    fresh = F.concat(F.substring(digits, 1, 1), _permute(body, 10, key, "card"))
    whole = F.element_at(
        F.transform(F.array(fresh), lambda d: F.concat(d, F.pmod(-_luhn_sum(d, 1), F.lit(10)).cast("string"))), 1
    )
    return F.when(_luhn_sum(digits, 2) % 10 == 0, _put_back(text, whole, "0-9"))


def _ip(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, "\\."), lambda p: p.cast("int"))
    part = lambda i: F.element_at(parts, i).cast("long")
    both = _feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65_536), F.lit(65_536), key, "ip", F.lit(0))
    joined = F.transform(
        F.array(both),
        lambda b: F.concat_ws(".", *[n.cast("string") for n in (F.floor(b["l"] / 256), b["l"] % 256, F.floor(b["r"] / 256), b["r"] % 256)]),
    )
    return F.when(F.forall(parts, lambda p: p <= 255), F.element_at(joined, 1))


def _date(text: Column, key: str) -> Column:
    """A valid day of 1800 to 2199 becomes another one, written in the same form."""
    out = F.lit(None).cast("string")
    for mark, form in DATE_FORMS.items():
        day = F.datediff(F.try_to_timestamp(text, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
        both = _feistel(F.floor(day / DAY_RADIX), day % DAY_RADIX, F.lit(DAYS // DAY_RADIX), F.lit(DAY_RADIX), key, "date", F.lit(0))
        fresh = F.element_at(
            F.transform(
                F.array(both),
                lambda b: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (b["l"] * DAY_RADIX + b["r"]).cast("int")), form),  # noqa: B023
            ),
            1,
        )
        out = F.when(F.contains(text, F.lit(mark)) & day.between(0, DAYS - 1), fresh).otherwise(out)
    return out


def _key(text: Column, key: str) -> Column:
    return _permute(text, 16, key, "key")


def _access_key(text: Column, key: str) -> Column:
    """The four letters in front stay; the others are permuted over digits and capitals."""
    return F.concat(F.substring(text, 1, 4), F.upper(_permute(F.lower(F.substring(text, 5, 16)), 36, key, "access_key")))


def _password(text: Column, key: str) -> Column:
    """The name, its sign and a quote stay; letters and digits of the value are permuted, so values that
    differ in case only stay different. Other characters, those beyond ASCII too, stay."""
    name = F.regexp_extract(text, r"^[\w-]+[\x22']?[ \t]*[=:][ \t]*[\x22']?", 0)
    value = F.substring(text, F.length(name) + 1, F.length(text))
    plain = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    return F.when(F.length(plain) > 0, F.concat(name, _put_back(value, _permute(plain, 62, key, "password"), "0-9A-Za-z")))


KINDS = {
    "email": _email, "phone": _phone, "date": _date, "ip": _ip, "password": _password, "access_key": _access_key, "key": _key,
    "card": _card,
}


def _pseudonym(found: Column, key: str) -> Column:
    """kind and text of the pseudonym; both null where the value is not valid."""
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, make in reversed(KINDS.items()):
        fits = found.rlike(f"^(?:{FORMS[name]})$")
        text = F.when(fits, make(found, key)).otherwise(text)
        kind = F.when(fits, F.lit(name)).otherwise(kind)
    return F.struct(F.when(text.isNotNull(), kind).alias("kind"), text.alias("text"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_pii and the number of each kind (n_email, ...).

    Values that fail their check (Luhn, octets, calendar) stay as they are and are not counted. So do
    passwords of fewer than six characters, and what follows a colon without quotes and looks like
    prose (letters of one case). E-mail names are told apart without regard to case.
    A null text stays null with zero counts; an empty one stays empty. Rows are independent of
    each other: repeated rows and equal values give equal results. Columns other than doc_id and
    text are not looked at.
    """
    split = docs.select(
        "doc_id",
        "text",
        F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(f"({ANY})"))).alias("found"),
    )
    swapped = split.select(
        "doc_id", "text", "found",
        F.when(F.size("found") > 0, F.transform("found", lambda v: _pseudonym(v, key))).alias("fresh"),
    )
    pieces = F.zip_with(
        F.split("text", ANY, -1),
        F.zip_with("fresh", "found", lambda new, old: F.coalesce(new["text"], old)),
        lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))),
    )
    kinds = F.transform("fresh", lambda f: f["kind"])
    number = lambda kind: F.coalesce(F.size(F.filter(kinds, lambda k: k == kind)), F.lit(0)).cast("long")
    counts = {f"n_{kind}": F.when(F.col("fresh").isNotNull(), number(kind)).otherwise(F.lit(0).cast("long")) for kind in KINDS}
    return swapped.select(
        "doc_id",
        F.when(F.col("fresh").isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"),
        sum(counts.values(), F.lit(0).cast("long")).alias("n_pii"),
        *[c.alias(name) for name, c in counts.items()],
    )
