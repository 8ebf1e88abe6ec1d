"""Personal data to format-preserving pseudonyms by a keyed Feistel network, in DataFrame functions only.

Found are e-mail addresses, telephone numbers, payment cards (Luhn), IBANs (mod 97), social security numbers, IPv4
addresses, calendar dates, and access keys and secrets. Numbers and dates are validated; what fails is left alone. A
value becomes a list of digits in mixed radix, the Feistel network permutes all lists of its format, and the result is
written in the same format, with check digits made anew. So a pseudonym is valid, equal values stay equal in all
documents, different values stay different, and the key holder can invert it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

ROUNDS = 10
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

# Formats. The order is that of preference at one place in the text.
FORMATS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?:password|passwd|secret|token|api_key)\s?[=:]\s?\"?[0-9a-f]{16,})",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z]|-[0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])",
}
#: Lengths of IBANs by country; of other countries all lengths of the format are tried.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
IBANS = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
#: Groups of 13 digits or more in all; cards are looked for from group to group.
RUN = r"[0-9](?=(?:[ -]?[0-9]){12})[0-9 -]*[0-9](?![0-9A-Za-z]|\.[0-9])"


def _any(**formats) -> str:
    """A number does not begin inside another number or word."""
    return r"(?<![0-9A-Za-z_])(?:" + "|".join(x for x in (FORMATS | formats).values() if x) + ")"


#: What is searched first, in what no IBAN begins, and beside the cards of a run.
ANY = _any(iban=rf"(?:{IBANS})(?![0-9A-Za-z])|{FORMATS['iban']}", card=RUN)
#: Cards as they are printed; such go before other groups that pass the check by chance.
PRINTED = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})\z"
NO_IBAN, NO_CARD = _any(iban="", card=RUN), _any(iban="", card="")
#: Days from 1900-01-01 to 2099-12-31, which are 17 * 4297.
DAYS, DAY_RADIX = 73049, (17, 4297)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ints(*values) -> Column:
    return F.array(*[v.cast("int") if isinstance(v, Column) else F.lit(v).cast("int") for v in values])


def permute(values: Column, radices: Column, tweak: Column, key: Column | str) -> Column:
    """The Feistel network: `values[i] < radices[i]` to as many numbers in the same ranges, one to one for each key and tweak."""
    key = F.lit(key) if isinstance(key, str) else key
    size = F.size(values)
    half = F.floor(size / 2).cast("int")
    left_radix, right_radix = F.slice(radices, 1, half), F.slice(radices, half + 1, size - half)

    def moved(other: Column, own: Column, radix: Column, i: Column) -> Column:
        seed = F.concat_ws("|", key, tweak, i.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))

        def shifted(x: Column, j: Column) -> Column:
            block = F.sha2(F.concat(seed, F.lit("|"), F.floor(j / 8).cast("string")), 256)
            noise = F.conv(F.substring(block, F.pmod(j, F.lit(8)) * 8 + 1, F.lit(7)), 16, 10).cast("long")
            return F.pmod(x.cast("long") + noise, F.get(radix, j).cast("long")).cast("int")

        return F.transform(own, shifted)

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(s["l"].alias("l"), moved(s["l"], s["r"], right_radix, i).alias("r"))).otherwise(F.struct(moved(s["r"], s["l"], left_radix, i).alias("l"), s["r"].alias("r")))

    start = F.struct(F.slice(values, 1, half).alias("l"), F.slice(values, half + 1, size - half).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _permute_chars(text: Column, tweak: Column, key: Column, hexadecimal: bool = False, telephone: bool = False) -> Column:
    """Digits to digits and letters to letters of the same case (or hex digits to hex digits); all else stays.

    telephone: a digit of 2 or more at the start of a group stays one, since areas and exchanges begin so.
    """
    alphabets = [HEX] if hexadecimal else [DIGITS, LOWER, UPPER]

    def alphabet(c: Column, index: int) -> Column:
        return F.instr(F.lit(alphabets[index]), c)

    def leads(chars: Column, i: Column) -> Column:
        if not telephone:
            return F.lit(False)
        return F.get(chars, i).between("2", "9") & ~F.coalesce(F.get(chars, i - 1).between("0", "9"), F.lit(False))

    def value(c: Column) -> Column:
        return F.greatest(*[alphabet(c, k) for k in range(len(alphabets))], F.lit(0)) - 1

    def radix(c: Column) -> Column:
        return F.lit(16) if hexadecimal else F.when(alphabet(c, 0) > 0, F.lit(10)).otherwise(F.lit(26))

    def body(chars: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: value(F.get(chars, i)) >= 0)
        low = lambda i: F.when(leads(chars, i), F.lit(2)).otherwise(F.lit(0))
        values = F.transform(at, lambda i: (value(F.get(chars, i)) - low(i)).cast("int"))
        radices = F.transform(at, lambda i: (radix(F.get(chars, i)) - low(i)).cast("int"))

        def written(new: Column) -> Column:
            def char(c: Column, i: Column) -> Column:
                def at_place(k: Column) -> Column:
                    n = F.get(new, k - 1) + low(i) + 1
                    found = F.when(k == 0, c)
                    for j, letters in enumerate(alphabets):
                        found = found.when(alphabet(c, j) > 0, F.substring(F.lit(letters), n, F.lit(1)))
                    return found

                return _let(F.array_position(at, i).cast("int"), at_place)

            return F.array_join(F.transform(chars, char), "")

        return F.when(F.size(at) == 0, F.array_join(chars, "")).otherwise(_let(permute(values, radices, tweak, key), written))

    return _let(_chars(text), body)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last is in an undoubled place."""
    n = F.length(digits)

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(n - 1 - i, F.lit(2)) == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), term), F.lit(0), lambda s, x: s + x)


def _mod97(text: Column) -> Column:
    """The number with letters as 10 to 35, modulo 97."""
    value = lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1
    return F.aggregate(_chars(text), F.lit(0), lambda s, c: F.pmod(F.when(value(c) > 9, s * 100).otherwise(s * 10) + value(c), F.lit(97)).cast("int"))


def _fill(template: Column, digits: Column, pattern: str = "[0-9A-Za-z]") -> Column:
    """The template with its digits and letters replaced, in order, by the characters of `digits`."""
    def body(chars: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: F.get(chars, i).rlike(pattern))
        return F.array_join(F.transform(chars, lambda c, i: _let(F.array_position(at, i).cast("int"), lambda k: F.when(k == 0, c).otherwise(F.substring(digits, k, F.lit(1))))), "")

    return _let(_chars(template), body)


def _card(m: Column, key: Column) -> Column:
    def body(digits: Column) -> Column:
        payload = F.substring(digits, F.lit(1), F.length(digits) - 1)

        def new(p: Column) -> Column:
            check = F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")
            return _fill(m, F.concat(p, check))

        return F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, _let(_permute_chars(payload, F.lit("card"), key), new)).otherwise(m)

    return _let(F.regexp_replace(m, "[^0-9]", ""), body)


def _iban(m: Column, key: Column) -> Column:
    def body(s: Column) -> Column:
        country, own = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))

        def new(b: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            return _fill(m, F.concat(country, check, b))

        return F.when(_mod97(F.concat(own, F.substring(s, 1, 4))) == 1, _let(_permute_chars(own, F.concat(F.lit("iban"), country), key), new)).otherwise(m)

    return _let(F.regexp_replace(m, " ", ""), body)


def _date(m: Column, key: Column) -> Column:
    """Year first with hyphens; else day first, or month first where only that is a date.

    Month-first dates are those with a day over 12. To stay so, they walk along the permutation to the next such date.
    """
    part = lambda a, n: F.substring(m, a, n)
    read = lambda *parts: F.try_to_timestamp(F.concat_ws("-", *parts), F.lit("yyyy-MM-dd")).cast("date")
    iso, separator = F.substring(m, 5, 1) == "-", F.substring(m, 3, 1)
    day_first, month_first = read(part(7, 4), part(4, 2), part(1, 2)), read(part(7, 4), part(1, 2), part(4, 2))
    parsed = F.when(iso, read(part(1, 4), part(6, 2), part(9, 2))).otherwise(F.coalesce(day_first, month_first))
    american = ~iso & day_first.isNull()
    epoch = F.lit("1900-01-01").cast("date")
    of_day = lambda n: F.date_add(epoch, n)

    def moved(n: Column) -> Column:
        values = _ints(F.floor(n / DAY_RADIX[1]), F.pmod(n, F.lit(DAY_RADIX[1])))
        return _let(permute(values, _ints(*DAY_RADIX), F.lit("date"), key), lambda v: F.get(v, F.lit(0)) * DAY_RADIX[1] + F.get(v, F.lit(1)))

    def body(n: Column) -> Column:
        walk = lambda s, i: F.when((i > 0) & (~american | (F.day(of_day(s)) > 12)), s).otherwise(moved(s).cast("int"))
        new = _let(F.aggregate(F.sequence(F.lit(0), F.lit(63)), n, walk), of_day)
        field = lambda d, f: F.date_format(d, f)
        text = _let(new, lambda d: F.when(iso, field(d, "yyyy-MM-dd")).when(american, F.concat(field(d, "MM"), separator, field(d, "dd"), separator, field(d, "yyyy"))).otherwise(F.concat(field(d, "dd"), separator, field(d, "MM"), separator, field(d, "yyyy"))))
        return F.when(n.between(0, DAYS - 1), text).otherwise(m)

    return F.coalesce(_let(F.datediff(parsed, epoch), body), m)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = _ints(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)

    def written(v: Column) -> Column:
        a = F.get(v, F.lit(0))
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.get(v, F.lit(1)) + 1).cast("string"), 2, "0"), F.lpad((F.get(v, F.lit(2)) + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(permute(values, _ints(898, 99, 9999), F.lit("ssn"), key), written)).otherwise(m)


def _ip(m: Column, key: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return _let(permute(octets, _ints(256, 256, 256, 256), F.lit("ip"), key), lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), "."))


def _prefixed(m: Column, prefix: str, change) -> Column:
    """The match of `prefix` at the start, and the changed rest."""
    return _let(F.regexp_extract(m, prefix, 0), lambda p: F.concat(p, change(F.substring(m, F.length(p) + 1, F.length(m)))))


def pseudonym(m: Column, key: Column | str) -> Column:
    """The pseudonym of one match of `ANY`."""
    whole = lambda kind: m.rlike(r"^(?:" + FORMATS[kind] + r")\z")
    chars = lambda kind, **how: lambda rest: _permute_chars(rest, F.lit(kind), key, **how)
    local = F.substring_index(m, "@", 1)
    return (
        F.when(whole("email"), F.concat(_permute_chars(local, F.lit("email"), key), F.substring(m, F.length(local) + 1, F.length(m))))
        .when(whole("secret") & m.startswith("AKIA"), _prefixed(m, "^AKIA", chars("secret")))
        .when(whole("secret"), _prefixed(m, r"^[a-z_]+\s?[=:]\s?\"?", chars("secret", hexadecimal=True)))
        .when(whole("iban"), _iban(m, key))
        .when(whole("ip"), _ip(m, key))
        .when(whole("date"), _date(m, key))
        .when(whole("ssn"), _ssn(m, key))
        .when(whole("phone"), _prefixed(m, r"^(?:\+[0-9]{1,3})?", chars("phone", telephone=True)))
        .when(whole("card"), _card(m, key))
        .otherwise(m)
    )


def _marked(text: Column, found: Column, pattern: str, pieces) -> Column:
    """The text in pieces: "T" and what lies between matches, and `pieces` of each match, of which those to change begin with "C"."""
    gaps = F.split(text, pattern, -1)
    return F.flatten(F.transform(gaps, lambda g, i: F.concat(F.array(F.concat(F.lit("T"), g)), F.when(i < F.size(found), pieces(F.get(found, i))).otherwise(F.array().cast("array<string>")))))


def _again(text: Column, pattern: str, pieces) -> Column:
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _marked(text, found, pattern, pieces))


def _change(m: Column) -> Column:
    return F.array(F.concat(F.lit("C"), m))


def _valid_card(x: Column, shape: str = r"^[0-9](?:[ -]?[0-9]){12,18}\z") -> Column:
    return x.rlike(shape) & (F.pmod(luhn_sum(F.regexp_replace(x, "[^0-9]", "")), F.lit(10)) == 0)


def _valid_iban(x: Column) -> Column:
    return _let(F.regexp_replace(x, " ", ""), lambda s: _mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)


def _cards(run: Column, valid_card, rest_pattern: str, rest_pieces) -> Column:
    """A run in pieces: from each group on the longest valid card that ends with a group, else the group is passed over and left to `rest_pattern`."""
    trimmed = lambda x: F.regexp_replace(x, r"[ -]+\z", "")

    def body(groups: Column) -> Column:
        ends = lambda i: F.transform(F.sequence(i, F.least(i + 18, F.size(groups) - 1)), lambda j: F.array_join(F.slice(groups, i + 1, j - i + 1), ""))

        def step(s: Column, i: Column) -> Column:
            def longest(valid: Column) -> Column:
                n = F.size(valid)
                card, own = F.get(valid, n - 1), F.get(groups, i)
                taken = F.size(F.regexp_extract_all(card, F.lit("[0-9]+"), F.lit(0)))
                hit = F.struct(F.concat(s["done"], F.array(F.concat(F.lit("T"), s["rest"]), F.concat(F.lit("C"), trimmed(card)))).alias("done"), F.regexp_extract(card, r"[ -]*\z", 0).alias("rest"), (i + taken).cast("int").alias("next"))
                return F.when(n > 0, hit).otherwise(F.struct(s["done"].alias("done"), F.concat(s["rest"], own).alias("rest"), s["next"].alias("next")))

            return F.when(i < s["next"], s).otherwise(_let(F.filter(ends(i), lambda x: valid_card(trimmed(x))), longest))

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("rest"), F.lit(0).alias("next"))
        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda s: F.concat(s["done"], F.array(F.concat(F.lit("T"), s["rest"]))))

    found = _let(F.regexp_extract_all(run, F.lit("[0-9]+[ -]*"), F.lit(0)), body)
    return F.flatten(F.transform(found, lambda x: F.when(x.startswith("C"), F.array(x)).otherwise(_again(F.substring(x, F.lit(2), F.length(x)), rest_pattern, rest_pieces))))


def _but_iban(m: Column) -> Column:
    is_run = m.rlike(r"^(?:" + RUN + r")\z")
    printed = lambda x: _valid_card(x, PRINTED)
    other = lambda r: F.when(r.rlike(r"^(?:" + RUN + r")\z"), _cards(r, _valid_card, NO_CARD, _change)).otherwise(_change(r))
    return F.when(~is_run | printed(m), _change(m)).otherwise(_cards(m, printed, NO_IBAN, other))


def _pieces(m: Column) -> Column:
    """A match of `ANY` in pieces: what fails its check digits is tried in shorter parts, and what is left is searched again."""
    def prefix(valid: Column) -> Column:
        p = F.coalesce(F.get(valid, F.size(valid) - 1), F.lit(""))
        return F.concat(F.when(p == "", F.array().cast("array<string>")).otherwise(_change(p)), _again(F.substring(m, F.length(p) + 1, F.length(m)), NO_IBAN, _but_iban))

    def tried(groups: Column) -> Column:
        heads = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
        return F.filter(heads, lambda x: x.rlike(r"^(?:" + FORMATS["iban"] + r")\z") & _valid_iban(x))

    iban = m.rlike(r"^(?:" + FORMATS["iban"] + r")\z")
    return F.when(iban & _valid_iban(m), _change(m)).when(iban, _let(_let(F.split(m, " "), tried), prefix)).otherwise(_but_iban(m))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """`docs` with pseudonyms in the text, all other columns as they are; `count_col`: also the number of values changed.

    Null texts stay null and have 0; empty texts stay empty. Row by row, so repeated rows get the same result, a row of
    any length is handled in place, and nothing is shuffled. Only texts with a digit, an `@` or a secret are searched. The
    key is read from a table of one row by a subquery, so that it stands in no plan, event log or web page.
    """
    maybe = F.col(text_col).rlike("[0-9@]|" + FORMATS["secret"])
    matches, pieces, new, secret = free_names(docs, "matches", "pieces", "new", "secret")
    found = docs.withColumn(secret, docs.sparkSession.createDataFrame([(key,)], "secret string").scalar())
    found = found.withColumn(matches, F.when(maybe, F.regexp_extract_all(text_col, F.lit(ANY), F.lit(0))))
    found = found.withColumn(pieces, F.when(F.size(matches) > 0, _marked(F.col(text_col), F.col(matches), ANY, _pieces)))
    plain = lambda x: F.substring(x, F.lit(2), F.length(x))
    found = found.withColumn(new, F.transform(pieces, lambda x: F.when(x.startswith("C"), pseudonym(plain(x), F.col(secret))).otherwise(plain(x))))
    text = F.coalesce(F.array_join(new, ""), F.col(text_col))
    changed = F.size(F.filter(F.zip_with(pieces, new, lambda x, y: plain(x) != y), lambda x: x))
    counted = {count_col: F.when(F.size(matches) > 0, changed).otherwise(0).cast("long")} if count_col else {}
    return found.withColumns({text_col: text} | counted).drop(matches, pieces, new, secret)
