"""PII: format-preserving Feistel pseudonyms, in Spark expressions only.

Values are found by pattern, validated, and permuted within their format by a keyed Feistel network over a product of two ranges: so equal values get equal
pseudonyms in all documents, different values different ones, and with the key the permutation can be undone. A card number stays valid by Luhn's rule, with its
spacing; a phone number, by North American groups or in any international form from a plus on, keeps its country code and marks; an IPv4 address stays one; a social security number stays in the valid ranges; a
date of the years 1 to 9999 stays a date of its notation, within its 73,200 days; an IBAN keeps country and form and gets check digits that hold. The name of a mail address is permuted letter for letter and
digit for digit, in its case; its domain stays.

Values that fail validation (Luhn, octets over 255, dates that do not exist, check digits of an IBAN) are left as they are, as are IPv6 addresses. Of a run of digit groups every span of whole groups of 13 to 19
digits is tried as a card: unbroken ones and the groups 4-4-4-4 and 4-6-5 first, then longer and earlier ones. Where card numbers stand beside other groups, a
pseudonym may by chance make another span valid, which undo then takes; equal card numbers keep equal pseudonyms. Slash dates are mm/dd/yyyy, or dd/mm/yyyy if the first number is over 12.

Defined results: a null text stays null, an empty one empty; rows are handled each for itself, so ties, repeated rows and null ids keep all rows; texts of any length are handled
whole; an empty table gives no rows; other columns pass through in pseudonymise, and the counts behind them get underscores where names clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, own_name, table

ROUNDS = 8
#: The key of the registered query alone; whoever else pseudonymises has to give one.
DEMO_KEY = "rillstone-demo-key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
ISO = r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\d-])"
LOCAL = r"(?<![\w./])\d{1,2}[./]\d{1,2}[./]\d{4}(?![\d/])"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
#: Any number from a plus on, of 8 to 15 digits.
ABROAD = r"(?<![\w+.-])\+[1-9](?:[ .-]?\(?\d\)?){7,14}(?!\d)"
#: Country codes of one and of two digits; the others have three.
CODES = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
#: A run of digit groups of any length; a group that begins another kind of value is not of it.
CARD = r"(?<![\w-])\d(?:(?:[ -](?!\d{4}-\d{2}-\d{2}(?![\d-])|\d{3}-\d{2}-\d{4}(?![\w-])|\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|\d{1,2}[./]\d{1,2}[./]\d{4}(?![\d/])|\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)|[A-Za-z0-9._%+-]++@))?\d){12,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ANY = "|".join((EMAIL, IBAN, PHONE, ABROAD, SSN, ISO, LOCAL, IP, CARD))
KINDS = ("email", "phone", "ssn", "date", "ip", "card", "iban")
#: Dates are permuted in spans of 200 x 366 days, one of which begins on the first day; the earliest and latest date, in days from it.
FIRST_DAY, YEARS, DAYS = "1900-01-01", 200, 366
EARLIEST, LATEST = -693_595, 2_958_463
#: Fixed classes of characters, within which names and account numbers are permuted.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str, undo: bool = False) -> Column:
    """struct(l, r): a permutation of Z_a x Z_b (bigints up to 10^9)."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    a, b = a.cast("long"), b.cast("long")

    def f(i: Column, half: Column, size: Column) -> Column:
        word = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256), 1, 14), 16, 10).cast("long")
        return F.pmod(word, size)

    def turn(acc: Column, i: Column) -> Column:
        step = (lambda x, y, n: F.pmod(x - y, n)) if undo else (lambda x, y, n: F.pmod(x + y, n))
        even = i % 2 == 0
        return F.struct(
            F.when(even, step(acc["l"], f(i, acc["r"], a), a)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(step(acc["r"], f(i, acc["l"], b), b)).alias("r"),
        )

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def permuted(text: Column, key: str, kind: str, undo: bool = False) -> Column:
    """text with each digit and letter changed within its class: a Feistel network over the halves of the text, which add to each other class by class."""
    half = F.floor((F.length(text) + 1) / 2).cast("int")

    def shifted(x: Column, other: Column, i: Column) -> Column:
        word = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 256)

        def at(c: Column, j: Column) -> Column:
            by = F.conv(F.substring(word, (j % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for letters in CLASSES:
                n, place = len(letters), F.instr(F.lit(letters), c) - 1
                moved = F.pmod(place - by if undo else place + by, F.lit(n))
                out = F.when(place >= 0, F.substring(F.lit(letters), moved + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), at), "")

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, shifted(acc["l"], acc["r"], i)).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(shifted(acc["r"], acc["l"], i)).alias("r"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    return F.aggregate(order, start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def mod97(text: Column) -> Column:
    """Of letters and digits, letters as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda n, c: F.pmod(n * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _iban_sound(m: Column) -> Column:
    x = F.replace(m, F.lit(" "), F.lit(""))
    return mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1


def _iban(m: Column, key: str, undo: bool) -> Column:
    """Spaces keep their places, as they take no part in the permutation."""
    x = F.replace(m, F.lit(" "), F.lit(""))
    land, body = F.substring(x, 1, 2), permuted(F.substring(x, F.lit(5), F.length(x)), key, "iban", undo)
    new = F.concat(land, _pad(98 - mod97(F.concat(body, land, F.lit("00"))), 2), body)
    at = lambda i: F.length(F.replace(F.substring(m, F.lit(1), i), F.lit(" "), F.lit("")))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substring(m, i, F.lit(1)) == " ", " ").otherwise(F.substring(new, at(i), F.lit(1)))), "")


def luhn_sum(d: Column) -> Column:
    """Luhn's sum of a string of digits whose last one is not doubled."""
    n = F.length(d)

    def value(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i))


def refill(m: Column, new: Column) -> Column:
    """m with its digits replaced by those of new, in order."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(m)),
            lambda i: F.when(F.substring(m, i, F.lit(1)).rlike("[0-9]"), F.substring(new, F.length(digits(F.substring(m, F.lit(1), i))), F.lit(1))).otherwise(F.substring(m, i, F.lit(1))),
        ),
        "",
    )


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def _card(m: Column, key: str, undo: bool) -> Column:
    d = digits(m)
    n = F.length(d) - 1
    u = F.floor(n / 2).cast("int")
    v = n - u
    x = feistel(F.substring(d, F.lit(1), u).cast("long"), F.substring(d, u + 1, v).cast("long"), F.pow(F.lit(10.0), u).cast("long"), F.pow(F.lit(10.0), v).cast("long"), key, "card", undo)
    body = F.concat(_pad(x["l"], u), _pad(x["r"], v))
    return refill(m, F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))


def _cards(m: Column) -> Column:
    """The card numbers in a run of digit groups: array of struct(s, e), offsets in m, in order and without overlap."""
    groups = F.split(m, "[ -]")
    lens = F.transform(groups, F.length)

    def spans(g: Column) -> Column:
        """Of groups struct(n, s): those from one on that hold 13 to 19 digits."""

        def span(i: Column, k: Column) -> Column:
            part = F.slice(g, i + 1, k)
            sizes = F.transform(part, lambda x: x["n"])
            s, e = F.get(g, i)["s"], F.get(g, i + k - 1)["s"] + F.get(g, i + k - 1)["n"]
            common = (k == 1) | (sizes == F.array(*[F.lit(4)] * 4)) | (sizes == F.array(F.lit(4), F.lit(6), F.lit(5)))
            return F.struct(F.when(common, 0).otherwise(1).alias("rank"), (-F.aggregate(sizes, F.lit(0), lambda a, x: a + x)).alias("size"), s.alias("s"), e.alias("e"))

        n = F.size(g)
        made = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(19), n - i)), lambda k: span(i, k))))
        valid = F.filter(made, lambda x: x["size"].between(-19, -13))
        return F.array_sort(F.filter(valid, lambda x: luhn_sum(digits(F.substring(m, x["s"] + 1, x["e"] - x["s"]))) % 10 == 0))

    at = F.transform(lens, lambda n, i: F.struct(n.alias("n"), (F.aggregate(F.slice(lens, F.lit(1), i), F.lit(0), lambda a, x: a + x) + i).alias("s")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))
    own = F.transform(F.array(at), spans)
    return F.array_sort(F.aggregate(F.get(own, F.lit(0)), none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))).otherwise(kept)))


def _run(m: Column, cards: Column, key: str, undo: bool) -> Column:
    """m with its card numbers replaced."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        cards,
        start,
        lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(m, a["at"] + 1, x["s"] - a["at"]), _card(F.substring(m, x["s"] + 1, x["e"] - x["s"]), key, undo)).alias("out")),
        lambda a: F.concat(a["out"], F.substring(m, a["at"] + 1, F.length(m))),
    )
    return done


def _abroad(m: Column, key: str, undo: bool) -> Column:
    d = digits(m)
    code = F.regexp_extract(d, CODES, 0)
    rest = F.substring(d, F.length(code) + 1, F.length(d))
    u = F.floor(F.length(rest) / 2).cast("int")
    v = F.length(rest) - u
    x = feistel(F.substring(rest, F.lit(1), u).cast("long"), F.substring(rest, u + 1, v).cast("long"), F.pow(F.lit(10.0), u).cast("long"), F.pow(F.lit(10.0), v).cast("long"), key, "phone", undo)
    return refill(m, F.concat(code, _pad(x["l"], u), _pad(x["r"], v)))


def _phone(m: Column, key: str, undo: bool) -> Column:
    d = digits(m)
    n = F.length(d)
    x = feistel(F.substring(d, n - 9, F.lit(5)).cast("long"), F.substring(d, n - 4, F.lit(5)).cast("long"), 100_000, 100_000, key, "phone", undo)
    return refill(m, F.concat(F.substring(d, F.lit(1), n - 10), _pad(x["l"], 5), _pad(x["r"], 5)))


def _ssn(m: Column, key: str, undo: bool) -> Column:
    area = F.substring(m, 1, 3).cast("long")
    area = F.when(area < 666, area - 1).otherwise(area - 2)
    rest = (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1
    x = feistel(area, rest, 898, 99 * 9999, key, "ssn", undo)
    area = F.when(x["l"] < 665, x["l"] + 1).otherwise(x["l"] + 2)
    return F.concat(_pad(area, 3), F.lit("-"), _pad(F.floor(x["r"] / 9999) + 1, 2), F.lit("-"), _pad(x["r"] % 9999 + 1, 4))


def _ip(m: Column, key: str, undo: bool) -> Column:
    o = F.split(m, r"\.")
    part = lambda i: F.get(o, F.lit(i)).cast("long")
    x = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536, key, "ip", undo)
    return F.concat_ws(".", *[e.cast("string") for h in ("l", "r") for e in (F.floor(x[h] / 256), x[h] % 256)])


def _day(m: Column) -> Column:
    """The date meant, or null. Of dd.mm.yyyy and mm/dd/yyyy the mark tells which, of dd/mm/yyyy a first number over 12."""
    s = F.split(m, "[./]")
    part = lambda i: F.get(s, F.lit(i)).try_cast("int")
    month_first = m.contains("/") & (part(0) <= 12)
    local = F.try_to_date(F.format_string("%04d-%02d-%02d", part(2), F.when(month_first, part(0)).otherwise(part(1)), F.when(month_first, part(1)).otherwise(part(0))), "yyyy-MM-dd")
    day = F.when(m.rlike("^[0-9]{4}-"), F.try_to_date(m, "yyyy-MM-dd")).otherwise(local)
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when(n.between(EARLIEST, LATEST), n)


def _date(m: Column, key: str, undo: bool) -> Column:
    n = _day(m)

    span = YEARS * DAYS

    def step(n: Column) -> Column:
        own = F.pmod(n, F.lit(span))
        return F.get(F.transform(F.array(feistel(F.floor(own / DAYS), own % DAYS, YEARS, DAYS, key, "date", undo)), lambda x: (n - own + x["l"] * DAYS + x["r"]).cast("int")), F.lit(0))

    date = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n)
    # The permutation goes on until the day is one of the years 1 to 9999 (the first and last span reach beyond) and, for dd/mm/yyyy, over 12 again: a round fails with at most 0.8.
    walk = lambda good: F.aggregate(F.sequence(F.lit(1), F.lit(199)), step(n), lambda a, _: F.when(good(a), a).otherwise(step(a)))
    inside = lambda a: a.between(EARLIEST, LATEST)
    edge = ~n.between(-9 * span, 40 * span - 1)
    slash = m.rlike("^(?:1[3-9]|[2-9][0-9])/")
    day = date(F.when(slash, walk(lambda a: inside(a) & (F.dayofmonth(date(a)) > 12))).when(edge, walk(inside)).otherwise(step(n)))
    return F.when(m.rlike("^[0-9]{4}-"), F.date_format(day, "yyyy-MM-dd")).when(slash, F.date_format(day, "dd/MM/yyyy")).when(m.contains("/"), F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))


def kind_of(m: Column, cards: Column) -> Column:
    """Which of KINDS m is, or null if it fails validation; cards are those in m."""
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[A-Z]"), F.when(_iban_sound(m), "iban"))
        .when(m.rlike(rf"^(?:{SSN})$"), F.when(~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"), "ssn"))
        .when(m.rlike(rf"^(?:{ISO})$") | m.rlike(rf"^(?:{LOCAL})$"), F.when(_day(m).isNotNull(), "date"))
        .when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), F.when(octets, "ip"))
        .when(m.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(m.rlike(rf"^(?:{ABROAD})$"), "abroad")
        .when(F.size(cards) > 0, "card")
    )


def pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """struct(kind, new, n) of a match, n the values replaced in it."""
    mail = F.concat(permuted(F.substring_index(m, "@", 1), key, "email", undo), F.lit("@"), F.substring_index(m, "@", -1))

    def replaced(known: Column) -> Column:
        kind, cards = known["kind"], known["cards"]
        new = F.when(kind == "email", mail).when(kind == "phone", _phone(m, key, undo)).when(kind == "abroad", _abroad(m, key, undo)).when(kind == "ssn", _ssn(m, key, undo)).when(kind == "date", _date(m, key, undo)).when(kind == "ip", _ip(m, key, undo)).when(kind == "card", _run(m, cards, key, undo)).when(kind == "iban", _iban(m, key, undo)).otherwise(m)
        return F.struct(F.when(kind == "abroad", "phone").otherwise(kind).alias("kind"), new.alias("new"), F.when(kind == "card", F.size(cards)).otherwise(1).alias("n"))

    # Bound by transforms, so that neither is evaluated for each use.
    cards = F.when(m.rlike("^[0-9](?:[ -]?[0-9]){12,}+$"), _cards(m)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    known = F.transform(F.array(cards), lambda c: F.struct(kind_of(m, c).alias("kind"), c.alias("cards")))
    return F.get(F.transform(known, replaced), F.lit(0))


def pseudonymise(docs: DataFrame, key: str, undo: bool = False, counts: bool = False) -> DataFrame:
    """docs with text replaced; with counts, n_<kind> of values replaced come behind."""
    found, pieces = own_name(docs, "found"), own_name(docs, "pieces")
    rows = docs.withColumn(found, once(F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))))
    rows = rows.withColumn(pieces, F.when(F.size(found) > 0, F.split("text", ANY, -1))).withColumn(found, once(F.transform(found, lambda m: pseudonym(m, key, undo))))
    text = F.when(F.size(found) > 0, F.array_join(F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(m["new"], F.lit("")))), "")).otherwise(F.col("text"))
    n = lambda kind: F.coalesce(F.aggregate(F.filter(found, lambda m: m["kind"] == kind), F.lit(0), lambda a, m: a + m["n"]), F.lit(0)).cast("long")
    more = [n(kind).alias(own_name(docs, f"n_{kind}")) for kind in KINDS] if counts else []
    return rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], *more)


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY, counts=True)
