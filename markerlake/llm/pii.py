"""PII pseudonyms by format-preserving Feistel permutations, in DataFrame functions only.

Found values are replaced by values of the same format that a key permutes: equal values get equal pseudonyms in
every document, however their digits are grouped, and no two values of one kind and length share one. A value is a row
of symbols, each with a base; its marks and groups are laid back afterwards. The row is halved, and in each of `ROUNDS`
rounds one half is shifted, symbol by symbol, by a keyed SHA-256 stream of the other half. Costs grow with a value's
length, whatever it is.

| kind | is checked by | symbols | keeps |
| card | 13-19 digits, or four groups of four, with a right Luhn digit | digits but the last | grouping, a right Luhn digit |
| ip | four octets up to 255 | octets | dots |
| date | a real day of 1800 to 2199 (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy) | the day's number | format; stays a real day of these years |
| phone | 3, 3 and 4 digits in phone grouping, with or without a country code | the last ten digits | country code, grouping |
| ssn | 3, 2 and 4 digits; no group of zeros, first group not 666 nor 900 on | the three groups | grouping; stays a valid number |
| email | a name, @ and a domain with a dot | letters and digits | letters' case, marks, top domain |
| secret | 32 to 64 hex characters of one case with a digit and a letter | hex characters | length, case |

Names, postal addresses, account numbers by country and IPv6 addresses are not looked for.

The key is a secret: whoever has it can undo the pseudonyms. Queries take it from the session's configuration
(`KEY_SETTING`); where that is unset, one is drawn for the application, so values stay linked within it only. It is
part of the plan; keep it out of logs by spark.redaction.string.regex.

Cases: null text stays null and counts nothing; empty text stays empty; a number that fails its check stays, and
so does a text without values, byte by byte; values side by side are found each; repeated rows change alike;
columns called n_found or n_<kind> are replaced, other columns are kept.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import bound
from .shared import table

KEY_SETTING = "spark.markerlake.pii.secret"
ROUNDS, DAYS = 8, 146_097  # days of 1800-01-01 to 2199-12-31: 189 * 773
KINDS = ("card", "ip", "date", "phone", "ssn", "email", "secret")
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
DATE = r"(?<![0-9A-Za-z.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?!\.?[0-9A-Za-z])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|(?<=\+[0-9]{1,3}[ .-]?)[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z.+-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IP = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![0-9A-Za-z])"
#: Card first, as its back reference counts groups from the start.
PATTERN = "|".join((CARD, EMAIL, SECRET, DATE, PHONE, SSN, IP))


@bound
def feistel(values: Column, bases: Column, key: str, kind: str) -> Column:
    """The keyed permutation of an array of symbols below their bases."""
    n = F.size(values)
    half = F.floor((n + 1) / 2).cast("int")
    symbols = F.zip_with(values, bases, lambda v, b: F.struct(v.cast("int").alias("v"), b.cast("int").alias("b")))
    start = F.struct(F.slice(symbols, F.lit(1), half).alias("l"), F.slice(symbols, half + 1, n).alias("r"))

    def shifted(own: Column, other: Column, r: Column) -> Column:
        text = F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ",")
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), r.cast("string"), text), 256)

        def one(d: Column) -> Column:
            draw = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", d, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
            return F.transform(own, lambda x, i: F.struct(F.pmod(x["v"] + F.pmod(draw(i), x["b"]), x["b"]).cast("int").alias("v"), x["b"].alias("b")))

        return F.get(F.transform(F.array(digest), one), F.lit(0))  # one digest of the other half a round

    def step(s: Column, r: Column) -> Column:
        even = F.struct(shifted(s["l"], s["r"], r).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], r).alias("r"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.transform(F.concat(s["l"], s["r"]), lambda x: x["v"]))


@bound
def _split(m: Column) -> Column:
    """The characters of m; those beyond the basic plane are no symbols and come as they are."""
    return F.filter(F.split(m, ""), lambda c: c != "")


@bound
def _email(m: Column, key: str) -> Column:
    """Letters and digits of a name and domain permuted within their classes."""
    code = F.ascii
    digit, low, up = (lambda c: code(c).between(48, 57)), (lambda c: code(c).between(97, 122)), (lambda c: code(c).between(65, 90))

    @bound
    def moved(chars: Column) -> Column:
        value = F.transform(chars, lambda c: F.when(digit(c), code(c) - 48).when(low(c), code(c) - 97).when(up(c), code(c) - 65).otherwise(0))
        base = F.transform(chars, lambda c: F.when(digit(c), 10).when(low(c) | up(c), 26).otherwise(1))
        shown = lambda c, v: F.coalesce(F.char(F.when(digit(c), v + 48).when(low(c), v + 97).when(up(c), v + 65)), c)
        return F.array_join(F.zip_with(chars, feistel(value, base, key, "email"), shown), "")

    return moved(_split(m))


@bound
def _hex(m: Column, key: str) -> Column:
    low = F.transform(_split(F.lower(m)), lambda c: F.ascii(c) - F.when(F.ascii(c) > 57, 87).otherwise(48))
    new = F.transform(feistel(low, F.transform(low, lambda v: F.lit(16)), key, "secret"), lambda v: F.substring(F.lit("0123456789abcdef"), v + 1, F.lit(1)))
    text = F.array_join(new, "")
    return F.when(m.rlike("[A-F]"), F.upper(text)).otherwise(text)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


@bound
def _permuted(digits: Column, key: str, kind: str) -> Column:
    """A string of digits, permuted."""
    values = _split(digits).cast("array<int>")
    return F.array_join(feistel(values, F.transform(values, lambda v: F.lit(10)), key, kind).cast("array<string>"), "")


@bound
def _laid(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order; m is short."""
    before = lambda i: F.length(_digits(F.substring(m, F.lit(1), i)))
    return F.array_join(F.transform(_split(m), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, before(i) + 1, F.lit(1))).otherwise(c)), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, doubling from the second on the right."""
    d = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    worth = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int"))))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


@bound
def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    new = _permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(-_luhn(F.concat(new, F.lit("0"))), F.lit(10))
    return _laid(m, F.concat(new, check.cast("string")))


@bound
def _phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    return _laid(m, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), _permuted(F.substring(digits, -10, 10), key, "phone")))


@bound
def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (m.substr(a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    new = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")

    def shown(v: Column) -> Column:
        at = lambda k: F.get(v, F.lit(k))
        return F.concat_ws("-", F.lpad((at(0) + F.when(at(0) > 664, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((at(1) + 1).cast("string"), 2, "0"), F.lpad((at(2) + 1).cast("string"), 4, "0"))

    return F.get(F.transform(F.array(new), shown), F.lit(0))


@bound
def _ip(m: Column, key: str) -> Column:
    octets = F.split(m, r"\.").cast("array<int>")
    return F.array_join(feistel(octets, F.array(*[F.lit(256)] * 4), key, "ip").cast("array<string>"), ".")


def _day(m: Column) -> Column:
    """Days since 1800-01-01; null if m is no day of the years."""
    iso = F.when(m.substr(5, 1) == "-", m).otherwise(F.concat_ws("-", m.substr(7, 4), m.substr(4, 2), m.substr(1, 2)))
    day = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit("1800-01-01").cast("date"))
    return F.when(day.between(0, DAYS - 1), day)


@bound
def _date(m: Column, key: str) -> Column:
    day = _day(m)
    new = feistel(F.array(F.floor(day / 773).cast("int"), F.pmod(day, F.lit(773))), F.array(F.lit(189), F.lit(773)), key, "date")

    def shown(v: Column) -> Column:
        d = F.date_add(F.lit("1800-01-01").cast("date"), F.get(v, F.lit(0)) * 773 + F.get(v, F.lit(1)))
        return F.when(m.substr(5, 1) == "-", F.date_format(d, "yyyy-MM-dd")).when(m.substr(3, 1) == ".", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))

    return F.get(F.transform(F.array(new), shown), F.lit(0))


def _kind(m: Column) -> Column:
    """The kind of a match, null if it fails its check."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    full = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(full("[0-9a-f]{32,64}|[0-9A-F]{32,64}"), F.when(m.rlike("[0-9]") & m.rlike("[A-Fa-f]"), "secret"))
        .when(full("[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"), F.when(_luhn(digits) % 10 == 0, "card"))
        .when(full(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}"), F.when(_day(m).isNotNull(), "date"))
        .when(full(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), "ssn"))
        .when(full(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"), F.when(~F.exists(F.split(m, r"\."), lambda x: x.cast("int") > 255), "ip"))
        .when(F.length(digits).between(10, 15), "phone")
    )


def _pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "card", _card(m, key))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "email", F.concat(_email(F.regexp_extract(m, r"^(.*)\.[^.]+$", 1), key), F.regexp_extract(m, r"\.[^.]+$", 0)))
        .when(kind == "secret", _hex(m, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with the values of `text` replaced, n_found, and n_<kind> of each kind."""
    drop = {"n_found", *(f"n_{k}" for k in KINDS)}
    keep = [c for c in docs.columns if c not in drop]
    # Digits or an @ are in every value: other texts skip the search.
    matches = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(PATTERN), 0))
    found = docs.select(*keep, F.transform(matches, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind"))).alias("_found"))
    some = F.exists("_found", lambda x: x["kind"].isNotNull())
    new = F.transform("_found", lambda x: _pseudonym(x["m"], x["kind"], key))
    gaps = F.split("text", PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, v: F.array(F.coalesce(g, F.lit("")), F.coalesce(v, F.lit(""))))), "")
    text = F.when(F.coalesce(some, F.lit(False)), joined).otherwise(F.col("text"))
    kinds = F.coalesce(F.array_compact(F.transform("_found", lambda x: x["kind"])), F.array().cast("array<string>"))
    counts = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in KINDS}
    total = F.size(kinds).cast("long")
    return found.select(*(text.alias("text") if c == "text" else F.col(c) for c in keep), total.alias("n_found"), *(c.alias(n) for n, c in counts.items()))


_drawn: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key of the session's configuration, or one drawn for the application."""
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
