"""Personal data replaced by pseudonyms of the same format.  DataFrame functions only.

Matches are validated (card numbers by Luhn, bank accounts modulo 97, dates by the calendar, addresses by range) and
then permuted by a keyed Feistel network on just the set of valid values of their format, so a value keeps its format
and validity, equal values stay equal in all documents, whatever separators they are written with, and whoever holds
the key can invert it.  Mail names and secrets have no such format; they become keyed hashes, which link just as well.

Patterns repeat single characters only where the number isn't bounded, and start where their run of characters starts, so
a text of any length and content is searched in time in proportion to its length and without deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Demonstration key; a deployment passes its own, see `pseudonymise`.
KEY = "contactsheet-demonstration-key"
ROUNDS = 8

MAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9.\-]*[A-Za-z0-9\-]\.[A-Za-z]{2,}"
SECRET = r"(?i:\b(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)\s*[=:]\s*[\x22']?)[A-Za-z0-9_\-/+]{16,}"
ACCOUNT = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b"
DATE = r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d\-/])"
SOCIAL = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.]*\d)"
CARD = r"(?<![\d])\d(?:[ \-]?\d){12,18}(?!\d)"
#: A card number's start: groups of at least four digits, and a last one that may be shorter.
GROUPS = r"\d{4,19}(?:[ \-]\d{4,19}){0,3}(?:[ \-]\d{1,3})?"
#: Characters of an account number by country, as registered.
LENGTHS = {
    country: int(n)
    for n, countries in (x.split(":") for x in "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU".split())
    for country in countries.split(",")
}

#: How telephone country codes of one and two digits start; all others have three.
ONE_DIGIT = "17"
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

#: Bounds matches while a text is taken apart, and what stands for it and for itself where a text holds it already.
MARK, STAND_IN = "\ue000", "\ue001"


def _noise(key: Column, kind: str, turn: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", key, F.lit(kind), turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, kind: str) -> Column:
    """A permutation of the pairs (left < a, right < b), as a struct l, r.  The moduli swap sides each round."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + _noise(key, kind, i, s["r"]), s["a"]).alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def permute_digits(digits: Column, key: Column, kind: str) -> Column:
    """A permutation of the digit strings of each length from 2 to 36."""
    u = F.floor(F.length(digits) / 2).cast("int")
    v = F.length(digits) - u
    ten = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("bigint")
    pair = feistel(F.substr(digits, F.lit(1), u).cast("bigint"), F.substr(digits, u + 1).cast("bigint"), ten(u), ten(v), key, kind)
    return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), u, "0"), F.lpad(p["r"].cast("string"), v, "0")))


def _refill(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced by `digits` from left to right."""
    at = F.sequence(F.lit(1), F.length(shape))

    def one(i: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(shape, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(at, one), "")


def luhn_sum(digits: Column) -> Column:
    """Sum modulo 10 with every second digit from the right doubled, the last one not."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return s + F.when((n - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _card(s: Column, key: Column) -> Column:
    def change(d: Column) -> Column:
        head = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        return _let(head, lambda h: F.concat(h, ((10 - luhn_sum(F.concat(h, F.lit("0")))) % 10).cast("string")))

    return _let(_digits(s), lambda d: F.when(luhn_sum(d) == 0, _refill(s, change(d))).otherwise(s))


def _mod97(code: Column) -> Column:
    """An account number (four first characters last, letters as 10 to 35) modulo 97."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def add(s: Column, i: Column) -> Column:
        c = F.substr(turned, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _account(s: Column, key: Column) -> Column:
    def change(c: Column) -> Column:
        body = F.substr(c, F.lit(5))
        fresh = _let(_digits(body), lambda d: F.when(F.length(d) >= 2, _refill(body, permute_digits(d, key, "account"))).otherwise(body))
        country = F.substr(c, F.lit(1), F.lit(2))
        return _let(fresh, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b))

    def respaced(c: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(s))
        one = lambda i: F.when(F.substr(s, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substr(c, F.length(F.replace(F.substr(s, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))
        return F.array_join(F.transform(at, one), "")

    return _let(F.replace(s, F.lit(" "), F.lit("")), lambda c: F.when(_mod97(c) == 1, _let(change(c), respaced)).otherwise(s))


#: Days of 1800 to 2199, a whole cycle of the calendar: 146,097 = 189 * 773.
FIRST_DAY, LEFT_DAYS, RIGHT_DAYS = "1800-01-01", 189, 773


#: Turns that a day number walks at most; each ends the walk with a chance of 0.39 at least.
TURNS = 96


def _walked(n: Column, key: Column) -> Column:
    """The next day number of its own kind on n's cycle of the permutation; kinds are days of the month up to 12 and later.

    So a date that can only be read with the day first stays one, and equal dates stay equal in all notations.
    """
    early = lambda x: F.day(F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))) <= 12

    def turn(s: Column, _: Column) -> Column:
        pair = feistel(F.floor(s["n"] / RIGHT_DAYS), s["n"] % RIGHT_DAYS, F.lit(LEFT_DAYS), F.lit(RIGHT_DAYS), key, "date")
        step = _let(_let(pair, lambda p: p["l"] * RIGHT_DAYS + p["r"]), lambda y: F.struct(y.alias("n"), (early(y) == s["early"]).alias("done"), s["early"].alias("early")))
        return F.when(s["done"], s).otherwise(step)

    start = F.struct(n.cast("bigint").alias("n"), F.lit(False).alias("done"), early(n).alias("early"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), start, turn, lambda s: F.when(s["done"], s["n"]))


def _date(s: Column, key: Column) -> Column:
    """Dates with slashes are read with the month first if they can be, else with the day first."""

    def shown(form: str) -> Callable[[Column], Column]:
        return lambda n: F.when((n >= 0) & (n < LEFT_DAYS * RIGHT_DAYS), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), _walked(n, key).cast("int")), form))

    def fresh(form: str) -> Column:
        day = F.try_to_timestamp(s, F.lit(form)).cast("date")
        return _let(F.datediff(day, F.lit(FIRST_DAY).cast("date")), shown(form))

    forms = [(r"^\d{4}-", ("yyyy-MM-dd",)), (r"^\d{4}/", ("yyyy/MM/dd",)), (r"^\d{2}\.", ("dd.MM.yyyy",)), (r"^\d{2}/", ("MM/dd/yyyy", "dd/MM/yyyy"))]
    out = s
    for shape, read in forms:
        out = F.when(s.rlike(shape), F.coalesce(*map(fresh, read), s)).otherwise(out)
    return out


def _social(s: Column, key: Column) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substr(s, F.lit(x), F.lit(n)).cast("int") for x, n in ((1, 3), (5, 2), (8, 4)))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - (area > 666).cast("int")

    def show(p: Column) -> Column:
        a = F.floor(p["l"] / 99) + 1
        a = a + (a >= 666).cast("int")
        return F.format_string("%03d-%02d-%04d", a, p["l"] % 99 + 1, p["r"] + 1)

    return F.when(good, _let(feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "social"), show)).otherwise(s)


def _phone(s: Column, key: Column) -> Column:
    """All digits but those of the country code, which is told by its first digits, not by what separates it."""

    def change(d: Column) -> Column:
        first = lambda n: F.substr(d, F.lit(1), F.lit(n))
        code = F.when(~s.startswith("+"), 0).when(first(1).isin(*ONE_DIGIT), 1).when(first(2).isin(*TWO_DIGITS), 2).otherwise(3)
        own = _let(code, lambda n: F.concat(F.substr(d, F.lit(1), n), permute_digits(F.substr(d, n + 1), key, "phone")))
        return F.when((F.length(d) - code).between(6, 15), _refill(s, own)).otherwise(s)

    return _let(_digits(s), change)


def _address(s: Column, key: Column) -> Column:
    def change(o: Column) -> Column:
        good = F.forall(o, lambda x: x.between(0, 255))
        pair = feistel(F.element_at(o, 1) * 256 + F.element_at(o, 2), F.element_at(o, 3) * 256 + F.element_at(o, 4), F.lit(65536), F.lit(65536), key, "address")
        show = lambda p: F.concat_ws(".", *(x.cast("bigint").cast("string") for h in (p["l"], p["r"]) for x in (F.floor(h / 256), h % 256)))
        return F.when(good, _let(pair, show)).otherwise(s)

    return _let(F.transform(F.split(s, r"\."), lambda x: x.cast("int")), change)


def _mail(s: Column, key: Column) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("mail"), F.lower(s)), 256), 1, 12), F.lit("@example.invalid"))


def _secret(s: Column, key: Column) -> Column:
    value = F.regexp_extract(s, r"[A-Za-z0-9_\-/+]+$", 0)
    digest = F.sha2(F.concat_ws("|", key, F.lit("secret"), value), 256)
    digest = F.when(value == F.upper(value), F.upper(digest)).otherwise(digest)
    return F.concat(F.substr(s, F.lit(1), F.length(s) - F.length(value)), F.rpad(digest, F.length(value), digest))


def _replace(s: Column, key: Column) -> Column:
    whole = lambda p: s.rlike(f"^(?:{p})$")
    return (
        F.when(s.contains("@"), _mail(s, key))
        .when(whole(SECRET), _secret(s, key))
        .when(s.rlike("^[A-Z]"), _account(s, key))
        .when(whole(DATE), _date(s, key))
        .when(whole(SOCIAL), _social(s, key))
        .when(s.rlike(r"^[+(]"), _phone(s, key))
        .when(s.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _address(s, key))
        .otherwise(_card(s, key))
    )


def _starts(s: Column, least: int) -> Column:
    """`s` cut at each of its separators, and whole, the longest first; those of at least `least` digits and letters."""
    size = lambda x: F.length(F.regexp_replace(x, "[ \\-]", ""))
    ends = F.filter(F.sequence(F.length(s), F.lit(1), F.lit(-1)), lambda i: (i == F.length(s)) | F.substr(s, i + 1, F.lit(1)).isin(" ", "-"))
    return F.filter(F.transform(ends, lambda i: F.substr(s, F.lit(1), i)), lambda x: size(x) >= least)


def _accounts(text: Column) -> Column:
    """Valid account numbers of a text: at each start that of the country's length, else the longest that is valid.

    A country without a registered length may end at any space, others only where the match as a whole does.
    """
    size = F.create_map(*(F.lit(x) for pair in LENGTHS.items() for x in pair))

    def valid(s: Column) -> Column:
        own = F.element_at(size, F.substr(s, F.lit(1), F.lit(2)))
        bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
        good = F.filter(_starts(s, 15), lambda x: (own.isNull() | (x == s) | (F.length(bare(x)) == own)) & (_mod97(bare(x)) == 1))
        return _let(good, lambda g: F.concat(F.filter(g, lambda x: F.length(bare(x)) == own), g))

    return F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?=({ACCOUNT}))"), F.lit(1))), valid))


def _cards(text: Column) -> Column:
    """Valid card numbers of a text: at each start those in groups of four digits or more, the longest first, then longest matches as they are."""
    valid = lambda s: luhn_sum(_digits(s)) == 0
    whole = lambda x: ~x.rlike(r"[ \-]\d{1,3}$")
    grouped = F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<!\d)(?=({GROUPS})(?!\d))"), F.lit(1))), lambda s: _starts(s, 13)))
    grouped = F.filter(grouped, lambda s: (F.length(_digits(s)) <= 19) & valid(s))
    as_is = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({CARD})"), F.lit(1))), valid)
    return _let(grouped, lambda g: F.concat(F.filter(g, whole), F.filter(g, lambda s: ~whole(s)), as_is))


#: Characters by which values are told apart one after another; all values have more.
SHARED = 12


def _branches(values: Column) -> Column:
    """A pattern of all values that looks at each of their first characters once, however many values begin with it.

    Values in order of these characters are written as one tree: between two neighbours the branches close and open in which
    they differ.  So how long a place of a text is looked at doesn't grow with their number.  Values that agree in all of
    these characters stay in their order, and no two branches match at one place.
    """
    head = lambda v: F.substr(v, F.lit(1), F.lit(SHARED))
    ordered = F.array_sort(F.transform(values, lambda v, i: F.struct(head(v).alias("h"), i.alias("i"), F.substr(v, F.lit(SHARED + 1)).alias("rest"))))

    def written_out(s: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.element_at(s, i)["h"]).otherwise("")
            alike = F.size(F.filter(F.sequence(F.lit(1), F.lit(SHARED)), lambda n: F.substr(before, F.lit(1), n) == F.substr(x["h"], F.lit(1), n)))
            alike = F.when(i > 0, alike).otherwise(0)
            opened = lambda n: F.concat(F.when(i > 0, F.concat(F.repeat(F.lit(")"), SHARED - n), F.lit("|"))).otherwise(""), F.regexp_replace(F.substr(x["h"], n + 1), "(.)", "$1(?:"))
            return F.concat(_let(alike, opened), x["rest"])

        return F.concat(F.array_join(F.transform(s, piece), ""), F.lit(")" * SHARED))

    return _let(ordered, written_out)


def _pattern(text: Column) -> Column:
    """What to look for in a text.  Accounts and cards go in as the valid ones that it holds, so what fails hides nothing behind it."""
    numbers = lambda found, before, after: F.when(F.size(found) > 0, F.concat(F.lit(f"|{before}(?:"), _branches(F.array_distinct(found)), F.lit(f"){after}"))).otherwise("")
    accounts = F.when(text.rlike(ACCOUNT), _let(_accounts(text), lambda found: numbers(found, r"\b(?=[A-Z]{2}\d)", r"\b"))).otherwise("")
    cards = F.when(text.rlike(CARD), _let(_cards(text), lambda found: numbers(found, r"(?<!\d)(?=\d)", r"(?!\d)"))).otherwise("")
    fixed = lambda *patterns: "|".join(f"(?:{p})" for p in patterns)
    return F.concat(F.lit("(" + fixed(MAIL, SECRET)), accounts, F.lit("|" + fixed(DATE, SOCIAL, PHONE, ADDRESS)), cards, F.lit(")"))


def _parts(text: Column) -> Column:
    """The text taken apart: matches at even places (the second, the fourth ...), what lies between at odd ones."""
    safe = F.when(text.contains(MARK) | text.contains(STAND_IN), F.replace(F.replace(text, F.lit(STAND_IN), F.lit(STAND_IN + "b")), F.lit(MARK), F.lit(STAND_IN + "a"))).otherwise(text)
    return F.split(_let(safe, lambda s: F.regexp_replace(s, _pattern(s), F.lit(f"{MARK}$1{MARK}"))), MARK)


def _whole(parts: Column) -> Column:
    text = F.array_join(parts, "")
    return F.when(text.contains(STAND_IN), F.replace(F.replace(text, F.lit(STAND_IN + "a"), F.lit(MARK)), F.lit(STAND_IN + "b"), F.lit(STAND_IN))).otherwise(text)


def pseudonymise(docs: DataFrame, key: str | Column = KEY, column: str = "text") -> DataFrame:
    """`docs` with personal data in `column` replaced; all other columns and rows stay.

    Null stays null and empty stays empty; a text without matches stays as it is, to the character; repeated rows get
    equal results.  What fails validation (a number that fails Luhn, a date that isn't one) stays too, and what is valid
    within it or before it is found all the same.  Texts may be of any length.  A key that is given as text shows in the
    plan, and so in logs; a column, such as `keys.select("key").scalar()` of a guarded table of one row, doesn't.
    """
    text, hidden = F.col(column), "_key"
    while hidden in docs.columns:
        hidden += "_"
    changed = F.transform(_parts(text), lambda x, i: F.when(i % 2 == 1, _replace(x, F.col(hidden))).otherwise(x))
    keyed = docs.withColumn(hidden, F.lit(key) if isinstance(key, str) else key)
    return keyed.withColumn(column, F.when(text.rlike("[0-9@=:]"), _whole(changed)).otherwise(text)).drop(hidden)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, and whether the text was changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("_was"))
    return pseudonymise(docs).select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("_was"))).alias("changed"))
