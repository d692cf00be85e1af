"""Format-preserving pseudonyms: validated numbers, dates and mail addresses are permuted, under a key, within their format.

A value is validated first (check digits, octets, calendar, number plan), then mapped by a Feistel network onto another valid
value of the same format: a number is split into two halves (a, b) with moduli (ma, mb) whose product is exactly the number
of valid values, and each round maps (a, b) to (b, (a + F(round, b)) mod ma). No walking back into range is needed, and check
digits are worked out anew. F is SHA-256 of key, format, round and half. The map is a permutation, so equal values, however
they are punctuated, get equal pseudonyms in all documents, and different values different ones. What fails validation stays.

Only DataFrame functions are used. A text is cut at the matches of one pattern and put together again around their pseudonyms;
texts without a digit or an @ are left out of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.chunks import fresh

ROUNDS = 10
FIRST_DAY, DAYS = "1900-01-01", 73049  # to the end of 2099; 73049 = 17 * 4297

# Candidates, longest forms first; no letter, digit or joining character may touch them.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
#: Characters of an IBAN by country: the registry's and those in partial use. A match ends there, so that a word behind it isn't taken in.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(size: int, countries: str) -> str:
    fours, more = divmod(size - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{more}}}" if more else "")


IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join(_iban_of(*x) for x in IBAN_SIZES.items())})(?![A-Za-z0-9])"
DATE = r"(?<![\w.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?:(?![\w\-/]|\.\d)|(?=T\d{2}:?\d{2}))"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
IPV4 = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
# 19 digits before 16; the last three of them may also begin a phone number.
_TAIL = r"(?![2-9]\d{2}[ .\-][2-9]\d{2}[ .\-]\d{4}(?![\w\-]|\.\d))\d{3}"
_FOURS = "|".join((rf"(?:\d{{4}} ){{4}}{_TAIL}", r"(?:\d{4}-){4}\d{3}", r"(?:\d{4} ){3}\d{4}", r"(?:\d{4}-){3}\d{4}", r"\d{4} \d{6} \d{4,5}", r"\d{4}-\d{6}-\d{4,5}", r"\d{13,19}"))
CARD = rf"(?<![\w+\-.])(?:{_FOURS})(?![\w\-]|\.\d)"
PHONE = r"(?<![\w+.\-])(?:\+1[ .\-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .\-])[2-9]\d{2}[ .\-]\d{4}(?![\w\-]|\.\d)"
#: + and 8 to 15 digits, in groups or not.
WORLD = r"(?<![\w+.\-])\+[1-9](?:[ .\-()]{0,2}\d){7,14}(?![\w\-]|\.\d)"
#: Calling codes of one and two digits; all others have three.
CODE_1, CODE_2 = "^[17]", "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
PATTERN = "|".join((MAIL, IBAN, DATE, SSN, IPV4, CARD, PHONE, WORLD))


def _hash(key: str, tag, i: Column, half: Column) -> Column:
    text = F.concat(F.lit(key + "|"), F.lit(tag) if isinstance(tag, str) else tag, F.lit("|"), i.cast("string"), F.lit("|"), half.cast("string"))
    return F.sha2(text.cast("binary"), 256)


def permute(key: str, tag, a: Column, b: Column, ma: Column, mb: Column) -> Column:
    """struct(a, b) after the network; a < ma, b < mb."""
    begin = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), ma.cast("long").alias("ma"), mb.cast("long").alias("mb"))

    def round_(s, i):
        f = F.conv(F.substring(_hash(key, tag, i, s["b"]), 1, 12), 16, 10).cast("long")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + f, s["ma"]).alias("b"), s["mb"].alias("ma"), s["ma"].alias("mb"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, round_)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _refill(m: Column, new: Column, pattern: str) -> Column:
    """m with the characters that match pattern replaced, in turn, by those of new."""
    put = F.aggregate(F.split(m, ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), lambda s, c: F.when(c.rlike(pattern), F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], F.substr(new, s["at"], F.lit(1))).alias("out"))).otherwise(F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out"))))
    return put["out"]


def _luhn(digits: Column) -> Column:
    """Sum of Luhn for digits whose last one is the check digit: 0 mod 10 for valid numbers."""
    n = F.length(digits)
    value = lambda c, i: F.when((n - i) % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda s, x: s + x) % 10


def _pad(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0"))


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _ten(key: str, tag, digits: Column) -> Column:
    """A string of up to 18 digits, onto one of the same length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    a, b = F.coalesce(F.when(u > 0, F.substr(digits, F.lit(1), u).cast("long")), F.lit(0)), F.substr(digits, u + 1, n - u).cast("long")
    s = permute(key, tag, a, b, _pow10(u), _pow10(n - u))
    return F.when(u > 0, F.concat(_pad(s["a"], u), _pad(s["b"], n - u))).otherwise(_pad(s["b"], n))


def card(key: str, m: Column) -> Column:
    d = _digits(m)
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    new = _ten(key, F.concat(F.lit("card"), F.length(d).cast("string")), body)
    check = (10 - _luhn(F.concat(new, F.lit("0")))) % 10
    return F.when(_luhn(d) == 0, _refill(m, F.concat(new, check.cast("string")), r"\d"))


def phone(key: str, m: Column) -> Column:
    """Numbers of the North American plan keep that plan; of others the calling code and the digit behind it stay."""
    all_ = _digits(m)
    d = F.substr(all_, F.length(all_) - 9, F.lit(10))
    at = lambda i, n: F.substr(d, F.lit(i), F.lit(n)).cast("long")
    s = permute(key, "phone", at(1, 3) - 200, (at(4, 3) - 200) * 10000 + at(7, 4), F.lit(800), F.lit(8_000_000))
    new = F.concat((s["a"] + 200).cast("string"), (F.floor(s["b"] / 10000) + 200).cast("string"), _pad(s["b"] % 10000, F.lit(4)))
    plus = F.startswith(m, F.lit("+"))
    stay = F.when(all_.rlike(CODE_1), 2).when(all_.rlike(CODE_2), 3).otherwise(4)
    rest = F.substr(all_, stay + 1, F.length(all_) - stay)
    world = F.concat(F.substr(all_, F.lit(1), stay), _ten(key, F.concat(F.lit("world"), F.substr(all_, F.lit(1), stay), F.length(rest).cast("string")), rest))
    american = all_.rlike(r"^1[2-9]\d{2}[2-9]\d{6}$")
    return _refill(m, F.when(~plus, new).when(american, F.concat(F.lit("1"), new)).when(~all_.rlike("^1"), world), r"\d")


def ssn(key: str, m: Column) -> Column:
    d = _digits(m)
    at = lambda i, n: F.substr(d, F.lit(i), F.lit(n)).cast("long")
    area, group, serial = at(1, 3), at(4, 2), at(6, 4)
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    s = permute(key, "ssn", (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))
    new_area = F.floor(s["a"] / 99) + 1
    new_area = F.when(new_area >= 666, new_area + 1).otherwise(new_area)
    return F.when(ok, F.concat(_pad(new_area, F.lit(3)), F.lit("-"), _pad(s["a"] % 99 + 1, F.lit(2)), F.lit("-"), _pad(s["b"] + 1, F.lit(4))))


def ipv4(key: str, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    s = permute(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
    return F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)])


#: Of the 2,400 months' days those after the 12th: with the day first, nobody takes one of these for a month.
LATE = DAYS - 12 * 2400


def _month(i: Column) -> Column:
    return F.add_months(F.lit(FIRST_DAY).cast("date"), i.cast("int"))


def _late(key: str, y: Column, mo: Column, da: Column) -> Column:
    """The pseudonym of a date whose day is after the 12th, onto another one, as ddMMyyyy."""
    first = F.lit(FIRST_DAY).cast("date")
    months = (y - 1900) * 12 + mo - 1
    n = F.datediff(F.make_date(y, mo, da), first) - 12 * (months + 1)

    def turned(x):
        s = permute(key, "late", F.floor(x / 250), x % 250, F.lit(177), F.lit(250))
        return s["a"] * 250 + s["b"]

    # 177 * 250 is one more than there are dates: what lands there takes another turn.
    once = F.transform(F.array(turned(n)), lambda x: F.when(x == LATE, turned(x)).otherwise(x))
    before = lambda i: F.datediff(_month(i), first) - 12 * i
    near = lambda x: F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda o: F.greatest(F.lit(0), F.least(F.lit(2399), F.floor(x * 2400 / LATE) + o)))
    found = F.transform(once, lambda x: F.transform(F.array(F.array_max(F.filter(near(x), lambda i: before(i) <= x))), lambda i: F.date_add(_month(i), (x - before(i) + 12).cast("int")))[0])
    return F.date_format(found[0], "ddMMyyyy")


def date(key: str, m: Column) -> Column:
    """Between slashes the month comes first where it can, else the day."""
    d = _digits(m)
    at = lambda i, n: F.substr(d, F.lit(i), F.lit(n)).cast("int")
    iso, us = m.rlike(r"^\d{4}"), F.contains(m, F.lit("/"))
    y = F.when(iso, at(1, 4)).otherwise(at(5, 4))
    mo = F.when(iso, at(5, 2)).when(us, at(1, 2)).otherwise(at(3, 2))
    da = F.when(iso, at(7, 2)).when(us, at(3, 2)).otherwise(at(1, 2))
    real = lambda mo, da: F.when(y.between(1900, 2099) & mo.between(1, 12), da.between(F.lit(1), F.dayofmonth(F.last_day(F.make_date(y, mo, F.lit(1))))))
    n = F.datediff(F.make_date(y, mo, da), F.lit(FIRST_DAY).cast("date"))
    s = permute(key, "date", F.floor(n / 4297), n % 4297, F.lit(17), F.lit(4297))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * 4297 + s["b"]).cast("int"))
    text = F.when(iso, F.date_format(new, "yyyyMMdd")).when(us, F.date_format(new, "MMddyyyy")).otherwise(F.date_format(new, "ddMMyyyy"))
    turned = us & ~iso & (at(1, 2) > 12) & F.coalesce(real(at(3, 2), at(1, 2)), F.lit(False))
    return F.when(turned, _refill(m, _late(key, y, at(3, 2), at(1, 2)), r"\d")).when(real(mo, da), _refill(m, text, r"\d"))


def _mod97(text: Column) -> Column:
    """The remainder that IBANs are checked with: letters count as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(text, ""), value), F.lit(0), lambda s, x: F.when(x > 9, (s * 100 + x) % 97).otherwise((s * 10 + x) % 97))


def iban(key: str, m: Column) -> Column:
    """The account's digits are permuted, 18 at a time, its letters stay, and the check digits are worked out."""
    flat = F.regexp_replace(m, " ", "")
    body, country = F.substr(flat, F.lit(5), F.length(flat) - 4), F.substring(flat, 1, 2)
    d = _digits(body)
    some = F.filter(F.array(*[F.substr(d, F.lit(1 + 18 * k), F.lit(18)) for k in range(2)]), lambda x: x != "")
    new = F.array_join(F.transform(some, lambda x, i: _ten(key, F.concat(F.lit("iban"), i.cast("string"), country, F.length(x).cast("string")), x)), "")
    new_body = _refill(body, new, r"\d")
    check = 98 - _mod97(F.concat(new_body, country, F.lit("00")))
    ok = (_mod97(F.concat(body, F.substring(flat, 1, 4))) == 1) & (d != "")
    return F.when(ok, _refill(m, F.concat(country, _pad(check, F.lit(2)), new_body), "[A-Z0-9]"))


def mail(key: str, m: Column) -> Column:
    """The local part, letter by letter: letters stay letters of their case, digits digits. Each half shifts by a hash of the other."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    n = F.length(local)
    u = F.floor(n / 2).cast("int")
    begin = F.struct(F.substr(local, F.lit(1), u).alias("a"), F.substr(local, u + 1, n - u).alias("b"))

    def shifted(text, h):
        def one(c, j):
            k = F.conv(F.substr(h, (j % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            turn = lambda first, size: F.chr(F.lit(first) + F.pmod(F.ascii(c) - first + k, F.lit(size)))
            return F.when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).when(c.rlike("[0-9]"), turn(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    s = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, lambda s, i: F.struct(s["b"].alias("a"), shifted(s["a"], _hash(key, F.concat(F.lit("mail"), n.cast("string")), i, s["b"])).alias("b")))
    return F.concat(s["a"], s["b"], F.lit("@"), domain)


KINDS = ("mail", "iban", "date", "ssn", "ipv4", "card", "phone")


def _kind(m: Column) -> Column:
    whole = lambda p: m.rlike(r"^(?:" + p + r")$")
    return (
        F.when(F.contains(m, F.lit("@")), "mail").when(m.rlike("^[A-Z]"), "iban").when(whole(r"\d{4}[-/]\d{2}[-/]\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"), "date")
        .when(whole(r"\d{3}-\d{2}-\d{4}"), "ssn").when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), "ipv4").when((F.length(_digits(m)) >= 13) & ~F.startswith(m, F.lit("+")), "card").otherwise("phone")
    )


def _value(m: Column) -> Column:
    """struct(value, rest) of a match: four fours and a three whose 19 digits don't validate are a card of 16 and a number behind it."""
    short = F.when(m.rlike(r"^(?:\d{4}[ \-]){4}\d{3}$"), _luhn(_digits(m)) != 0).otherwise(F.lit(False))
    return F.struct(F.when(short, F.substring(m, 1, 19)).otherwise(m).alias("value"), F.when(short, F.substring(m, 20, 4)).otherwise(F.lit("")).alias("rest"))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate, or null where it doesn't validate."""
    kind, out = _kind(m), F.lit(None).cast("string")
    for name, f in (("mail", mail), ("iban", iban), ("date", date), ("ssn", ssn), ("ipv4", ipv4), ("card", card), ("phone", phone)):
        out = F.when(kind == name, f(key, m)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with text_col's validated values replaced, and a column of structs (kind, value, pseudonym) for each of them: found.

    Null text stays null and an empty one empty, with nothing found. Other columns pass through; a column called found is
    replaced. Ten digits without a separator or a plus are not taken for a phone number: too many other numbers look like that. Texts may have any length: work is in proportion to it, and to the number of candidates.
    """
    text = F.col(text_col).cast("string")
    some = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    matches = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), _value)
    found = F.transform(matches, lambda m: F.struct(_kind(m["value"]).alias("kind"), m["value"].alias("value"), pseudonym(m["value"], key).alias("pseudonym"), m["rest"].alias("rest")))
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string,rest:string>>")
    (every,) = fresh([*docs.columns, "found"], "feistel_all")
    out = docs.withColumn(every, F.when(some, found).otherwise(none))
    around = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(around, F.transform(F.col(every), lambda x: F.concat(F.coalesce(x["pseudonym"], x["value"]), x["rest"])), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    out = out.withColumn(text_col, F.when(F.size(every) > 0, joined).otherwise(text))
    kept = F.filter(every, lambda x: x["pseudonym"].isNotNull())
    return out.withColumn("found", F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["pseudonym"].alias("pseudonym")))).drop(every)
