"""PII by format-preserving Feistel pseudonyms, in DataFrame functions only.

Values are found by pattern and validated (card by Luhn, IBAN by its check digits, IP
octets, calendar dates written yyyy-mm-dd, yyyy/mm/dd or dd.mm.yyyy, social security ranges;
phone numbers have any area and exchange, but from 200 on where only blanks part them, or
a country code and groups of digits). A valid value is permuted
within its own format by a keyed Feistel network, so equal values get equal pseudonyms in
every document, different ones stay different, and the result is again a valid value.
The halves of a network are numbers modulo a and b (any two), so no value leaves its
domain; letters of mail addresses are shifted within their class by the other half.

The key has no default: whoever holds it can undo the permutation. Invalid values are
left as they are. A date is the same day's pseudonym in each way of writing.

Defined cases: null text stays null with no findings; empty texts have
none; null ids are kept; repeated rows get equal results; where patterns overlap the first
place and then the first kind listed wins; very long texts are read whole; an empty table
gives an empty result; other columns are carried, but for pii and new_text, which `find`
replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import shared
from readloom.llm.shared import let

KINDS = ("email", "ip", "date", "ssn", "iban", "card", "phone")
#: In the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|[0-9]{4}/[0-9]{2}/[0-9]{2}(?![0-9/])|[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9]))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"(?<![0-9(+])\+(?:[2-7][0-9]{0,2}|[89][0-9]{1,2})(?:[ .-][0-9]{2,4}){2,5}(?![0-9])|(?<![0-9(])(?:\+1[ .-]?[0-9]{3}[ .-][0-9]{3}[ .-]|(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]|[0-9]{3}[.-][0-9]{3}[ .-]|[0-9]{3} [0-9]{3}[.-]|[2-9][0-9]{2} [2-9][0-9]{2} ))[0-9]{4}(?![0-9])",
}
PATTERN = "|".join(PATTERNS.values())
ROUNDS = 8
#: Dates from 1900-01-01 that are permuted: 200 times 365 days.
FIRST_DAY, DATE_HALVES = "1900-01-01", (200, 365)


def keyed(key: str, tag: str, turn: Column, value: Column, modulus: int) -> Column:
    """A pseudorandom number below `modulus`."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), turn.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(modulus))


def feistel(left: Column, right: Column, a: int, b: int, key: str, tag: str) -> Column:
    """struct<l, r>: a keyed permutation of the pairs below (a, b)."""

    def turn(acc: Column, t: Column) -> Column:
        first = F.struct(F.pmod(acc["l"] + keyed(key, tag, t, acc["r"], a), F.lit(a)).alias("l"), acc["r"].alias("r"))
        second = F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + keyed(key, tag, t, acc["l"], b), F.lit(b)).alias("r"))
        return F.when(t % 2 == 0, first).otherwise(second)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def zeros(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def number(text: Column, start: int, size: int) -> Column:
    return F.coalesce(F.try_to_number(F.substring(text, start, size), F.lit("9" * size)).cast("long"), F.lit(0).cast("long"))


def refill(value: Column, new: Column) -> Column:
    """`value` with its digits replaced in turn by those of `new`."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substr(new, acc["i"], F.lit(1))).alias("out"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i")))
    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step)["out"]


def luhn_sum(text: Column) -> Column:
    """Luhn's sum of a digit string, its last digit counted once."""
    step = lambda acc, c: F.struct((acc["s"] + F.when(acc["twice"], F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))).alias("s"), (~acc["twice"]).alias("twice"))
    return F.aggregate(F.split(F.reverse(text), ""), F.struct(F.lit(0).alias("s"), F.lit(False).alias("twice")), step)["s"]


def _whole(d: Column, size: int, key: str, tag: str = "card") -> Column:
    """A permutation of the numbers of `size` digits, leading zeros kept."""
    a, b = size // 2, size - size // 2
    return let(feistel(number(d, 1, a), number(d, a + 1, b), 10**a, 10**b, key, f"{tag}{size}"), lambda x: F.concat(zeros(x["l"], a), zeros(x["r"], b)))


def _card(value: Column, key: str) -> Column:
    """Permutes all digits but the last, which is Luhn's check digit again."""

    def body(d: Column) -> Column:
        n = F.length(d) - 1
        out = F.lit(None).cast("string")
        for size in range(12, 19):  # digits without the check digit
            out = F.when(n == size, _whole(d, size, key)).otherwise(out)
        return let(out, lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

    valid = luhn_sum(digits(value)) % 10 == 0
    return F.when(valid, refill(value, let(digits(value), body)))


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))

    def body(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        new = feistel(at(0) * 256 + at(1), at(2) * 256 + at(3), 65536, 65536, key, "ip")
        joined = let(new, lambda x: F.concat_ws(".", *[y.cast("string") for y in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256)]))
        return F.when(F.forall(p, lambda x: x < 256), joined)

    return let(parts, body)


def _date(value: Column, key: str) -> Column:
    a, b = DATE_HALVES
    dotted, sep = F.substring(value, 3, 1) == ".", F.substring(value, 5, 1)
    year_first = F.when(dotted, F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2))).otherwise(F.replace(value, F.lit("/"), F.lit("-")))

    def written(day: Column) -> Column:
        parts = [F.substring(day, 1, 4), F.substring(day, 6, 2), F.substring(day, 9, 2)]
        return F.when(dotted, F.concat_ws(".", *reversed(parts))).otherwise(F.concat(parts[0], sep, parts[1], sep, parts[2]))

    def body(day: Column) -> Column:
        new = feistel(F.floor(day / b), day % b, a, b, key, "date")
        return F.when((day >= 0) & (day < a * b), let(let(new, lambda x: F.date_add(F.to_date(F.lit(FIRST_DAY)), (x["l"] * b + x["r"]).cast("int")).cast("string")), written))

    return let(F.datediff(F.try_to_date(year_first, "yyyy-MM-dd"), F.to_date(F.lit(FIRST_DAY))), body)


def _ssn(value: Column, key: str) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = number(value, 1, 3), number(value, 5, 2), number(value, 8, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    back = lambda p: F.when(p >= 665, p + 2).otherwise(p + 1)
    new = feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
    return F.when(valid, let(new, lambda x: F.concat_ws("-", zeros(back(F.floor(x["l"] / 99)), 3), zeros(x["l"] % 99 + 1, 2), zeros(x["r"] + 1, 4))))


def _phone(value: Column, key: str) -> Column:
    """Area, exchange and line; a leading 1 stays. Pairs of area and exchange from 200 on are permuted among
    themselves, and so are all others, so that digits parted by blanks alone stay in the range they are known by."""

    def body(d: Column) -> Column:
        def ten(t: Column) -> Column:
            area, exchange, line = number(t, 1, 3), number(t, 4, 3), number(t, 7, 4)
            assigned = feistel((area - 200) * 800 + exchange - 200, line, 640_000, 10_000, key, "phone")
            other = feistel(F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange), line, 360_000, 10_000, key, "phone other")
            joined = lambda a, e, x: F.concat(zeros(a, 3), zeros(e, 3), zeros(x["r"], 4))
            low = lambda x: F.when(x["l"] < 200_000, joined(F.floor(x["l"] / 1000), x["l"] % 1000, x)).otherwise(joined(F.floor((x["l"] - 200_000) / 200) + 200, x["l"] % 200, x))
            return F.when((area >= 200) & (exchange >= 200), let(assigned, lambda x: joined(F.floor(x["l"] / 800) + 200, x["l"] % 800 + 200, x))).otherwise(let(other, low))

        return let(F.when(F.length(d) == 11, F.substring(d, 2, 10)).otherwise(d), lambda t: F.concat(F.when(F.length(d) == 11, F.lit("1")).otherwise(F.lit("")), ten(t)))

    def abroad(d: Column) -> Column:
        """The digits behind the country code, permuted among those of their number."""
        out = F.lit(None).cast("string")
        for size in range(4, 21):
            out = F.when(F.length(d) == size, _whole(d, size, key, "phone abroad")).otherwise(out)
        return out

    code = F.regexp_extract(value, r"^(\+[0-9]+)[ .-]", 1)
    rest = F.substr(value, F.length(code) + 1, F.length(value))
    return F.when((code != "") & (code != "+1"), F.concat(code, refill(rest, let(digits(rest), abroad)))).otherwise(refill(value, let(digits(value), body)))


def _shift(text: Column, other: Column, key: str, tag: str, turn: Column) -> Column:
    """Letters and digits of `text`, moved within their class by amounts that `other` gives."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), turn.cast("string"), other), 512)

    def body(s: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substr(s, F.pmod(i * 2, F.lit(126)) + 1, F.lit(3)), 16, 10).cast("int") + F.floor(i / 63).cast("int")
            moved = lambda first, size: F.char(F.pmod(F.ascii(c) - first + by, F.lit(size)) + first)
            return F.when(c.rlike("[a-z]"), moved(97, 26)).when(c.rlike("[A-Z]"), moved(65, 26)).when(c.rlike("[0-9]"), moved(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return F.when(F.length(text) > 0, let(stream, body)).otherwise(text)


def letters(value: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the strings with the same letter, digit and other places."""

    def turn(acc: Column, t: Column) -> Column:
        return F.when(t % 2 == 0, F.struct(_shift(acc["l"], acc["r"], key, tag, t).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), _shift(acc["r"], acc["l"], key, tag, t).alias("r")))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1, F.length(value)).alias("r"))
    return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda x: F.concat(x["l"], x["r"]))


def _email(value: Column, key: str) -> Column:
    """All but the last label of the domain."""
    name = F.regexp_extract(value, r"^(.*)\.[^.]*$", 1)
    return F.concat(letters(name, key, "email"), F.lit("."), F.substring_index(value, ".", -1))


def mod97(text: Column) -> Column:
    """The value of letters and digits modulo 97, A as 10 to Z as 35."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(value: Column, key: str) -> Column:
    """The account part within its classes, and the check digits anew."""
    country, account = F.substring(value, 1, 2), F.substr(value, F.lit(5), F.length(value))
    valid = mod97(F.concat(account, F.substring(value, 1, 4))) == 1
    return F.when(valid, let(letters(account, key, "iban"), lambda x: F.concat(country, zeros(98 - mod97(F.concat(x, country, F.lit("00"))), 2), x)))


_NEW = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "iban": _iban, "card": _card, "phone": _phone}


def pseudonym(value: Column, key: str) -> Column:
    """struct<kind, new> of a match; kind is null and the value kept if it is not valid."""
    kind = F.lit(None).cast("string")
    new = F.lit(None).cast("string")
    for k in reversed(KINDS):
        whole = value.rlike("^(?:" + PATTERNS[k] + ")$")
        kind = F.when(whole, F.lit(k)).otherwise(kind)
    pick = lambda k: F.coalesce(*[F.when(k == name, _NEW[name](value, key)) for name in KINDS], new)
    return let(kind, lambda k: let(pick(k), lambda n: F.struct(F.when(n.isNotNull(), k).alias("kind"), F.coalesce(n, value).alias("new"))))


def find(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """`docs`, without columns of these names, with `pii` (array<struct<kind, start, end, new>>, valid values only) and `new_text`.

    start and end are code points of the original, the end exclusive.
    """
    docs = docs.drop("pii", "new_text")
    text = F.col(column)
    hits = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))

    def body(items: Column) -> Column:
        pieces = F.arrays_zip(F.split(text, PATTERN, -1).alias("gap"), items.alias("hit"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["hit"]["old"])
            one = F.array(F.struct(x["hit"]["kind"].alias("kind"), start.alias("start"), end.alias("end"), x["hit"]["new"].alias("new")))
            return F.struct(F.coalesce(end, start).alias("at"), F.when(x["hit"]["kind"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
        new = F.array_join(F.flatten(F.transform(pieces, lambda x: F.array(x["gap"], F.coalesce(x["hit"]["new"], F.lit(""))))), "")
        return F.struct(found.alias("pii"), new.alias("new_text"))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,new:string>>")
    items = F.transform(hits, lambda m: let(pseudonym(m, key), lambda p: F.struct(m.alias("old"), p["kind"].alias("kind"), p["new"].alias("new"))))
    done = F.when(text.rlike(PATTERN), let(items, body)).otherwise(F.struct(none.alias("pii"), text.alias("new_text")))
    name = shared.free_name(docs, "found")
    return docs.withColumn(name, done).select(*docs.columns, f"{name}.pii", f"{name}.new_text")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with the values in `text` replaced."""
    done = find(docs.select(F.struct(*docs.columns).alias("__row"), "text"), key)
    return done.select(*[F.col("new_text").alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], listed.alias("spans"), F.col("new_text").alias("text"))
