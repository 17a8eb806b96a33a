"""PII: format-preserving Feistel pseudonyms, in DataFrame functions alone.

A text is cut by one pattern into what lies between findings and the findings. Each finding is checked (check digits,
ranges, calendar) and, if valid, moved within its own format by a keyed Feistel network; all else stays as it is. The
network is a bijection on the format, so equal values get equal pseudonyms in every document and different values
different ones, and whoever has the key can go back with ``restore`` (numbers of an address come back without leading zeros).
The key stands in a table of one row, which is broadcast, so no plan, page or log shows it.

=========  ======================================  =============================================================
kind       valid if                                what moves
=========  ======================================  =============================================================
card       issuer prefix, length, Luhn             digits between the issuer digit and the check digit; the check
                                                   digit is set anew
iban       letters, length, modulo 97; in one, or  all after the country, class by class; check digits anew
           in groups of four if the country's
           length is known
phone      +1 and ten digits, exchange from 2, an  area code, exchange and line number
           area code other than 000; without +,    (other countries: the digits after the first two)
           area code and exchange from 2;
           +country, 8 to 15 digits in any groups
ssn        area, group and serial in use           all three, among valid ones
date       YYYY-MM-DD, DD/MM/YYYY in the calendar  the day, within its 400 years (146,097 days); in
           or, if not, MM/DD/YYYY                  MM/DD/YYYY among the days from 13
ip         four numbers to 255                     all 32 bits
email      local part, host with a top level       local part and host names, class by class; top level stays
secret     value of token/secret/password/api key  letters and digits, class by class, to its end
=========  ======================================  =============================================================

Defined results: null text stays null with no finding; empty text stays empty; a finding that isn't valid stays;
rows are kept one for one, whatever their id; other columns are handed through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10

EMAIL = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9._%+\-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z])(?:[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy])\s{0,4}[=:]\s{0,4}[\"']?[A-Za-z0-9+/_\-]{16,}"
#: Lengths of the countries' IBANs, so that a printed one ends where its country's do, whatever follows.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# whole groups of digits after whole groups come along, since a card may begin before them
_PRINTED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "(?: [0-9]{4}(?![A-Za-z0-9])){0,4}") for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|(?=[A-Z]{{2}}[0-9]{{2}} )(?:{_PRINTED}))(?![A-Za-z0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/\-])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = r"\+1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])|\+[2-9](?:[ .\-]?\(?[0-9]\)?){7,14}(?![0-9])|(?<![0-9+(\-])(?:1[\-. ])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[\-. ])[2-9][0-9]{2}[\-. ][0-9]{4}(?![0-9\-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])"
#: The order counts: what is found first takes its characters.
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "ip": IP, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(text: Column) -> Column:
    return text.cast("decimal(19,0)").cast("long")


class Key:
    """The secret as a column (or a literal, for tests), and whether to go back."""

    def __init__(self, secret: str | Column, back: bool = False):
        self.secret, self.back = secret if isinstance(secret, Column) else F.lit(secret), back

    def rounds(self) -> Column:
        return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if self.back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def _as_key(key: Key | str) -> Key:
    return key if isinstance(key, Key) else Key(key)


def _noise(key: Key, kind: str, i: Column, value: Column) -> Column:
    """52 bits from the key, the kind, the round and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key.secret, F.lit(kind), i.cast("string"), value.cast("string")), 256), 1, 13), 16, 10).cast("long")


def feistel(key: Key | str, kind: str, a: Column, b: Column, size_a: int | Column, size_b: int | Column) -> Column:
    """struct<a, b>: a keyed permutation of the pairs with a < size_a and b < size_b."""
    key = _as_key(key)
    size_a, size_b = (x if isinstance(x, Column) else F.lit(x) for x in (size_a, size_b))
    moved = lambda x, noise, size: F.pmod(x - noise, size) if key.back else (x + noise) % size

    def one(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, moved(acc["a"], _noise(key, kind, i, acc["b"]), size_a)).otherwise(acc["a"]).cast("long").alias("a"),
            F.when(even, acc["b"]).otherwise(moved(acc["b"], _noise(key, kind, i, acc["a"]), size_b)).cast("long").alias("b"),
        )

    return F.aggregate(key.rounds(), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), one)


def feistel_number(key: Key | str, kind: str, x: Column, size_a: int, size_b: int) -> Column:
    """A keyed permutation of the numbers below size_a * size_b."""
    return _let(feistel(key, kind, F.floor(x / F.lit(size_b)), x % size_b, size_a, size_b), lambda p: p["a"] * size_b + p["b"])


def feistel_text(key: Key | str, kind: str, text: Column) -> Column:
    """Letters move among letters of their case and digits among digits; all else stays. Halves are moved in turn."""
    key = _as_key(key)

    def shift(half: Column, other: Column, i: Column) -> Column:
        # 128 hex digits, two for each character, so long halves get more blocks, each for its 64 characters
        def block(k: Column) -> Column:
            stream = F.sha2(F.concat_ws("|", key.secret, F.lit(kind), i.cast("string"), k.cast("string"), other), 512)
            return _let(F.struct(stream.alias("stream"), F.substring(half, k * 64 + 1, F.lit(64)).alias("part")), lambda x: moved(x["stream"], x["part"]))

        def moved(stream: Column, part: Column) -> Column:
            def char(j: Column) -> Column:
                c = F.substring(part, j, F.lit(1))
                by = F.conv(F.substring(stream, j * 2 - 1, F.lit(2)), 16, 10).cast("int")
                by = -by if key.back else by
                at = lambda alphabet: F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))
                return F.when(c.between("a", "z"), at(LOWER)).when(c.between("A", "Z"), at(UPPER)).when(c.between("0", "9"), at(DIGITS)).otherwise(c)

            return F.when(F.length(part) == 0, part).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), char), ""))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(half) / 64).cast("int")), block), "")

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substring(text, cut + 1, F.length(text)).alias("b"))

    def one(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, shift(acc["a"], acc["b"], i)).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(shift(acc["b"], acc["a"], i)).alias("b"))

    return _let(F.aggregate(key.rounds(), start, one), lambda p: F.concat(p["a"], p["b"]))


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """The finding with its digits replaced one by one."""
    chars = F.split(m, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def one(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9") & (F.length(c) == 1)
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(chars, start, one, lambda acc: acc["out"])


def _luhn_check_digit(body: Column) -> Column:
    """The digit that makes ``body`` with it valid."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)), F.lit(0), lambda acc, x: acc + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def luhn_valid(digits: Column) -> Column:
    n = F.length(digits)
    return _luhn_check_digit(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1))


def _mod97(text: Column) -> Column:
    """The IBAN remainder of a text of capital letters and digits."""

    def one(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, acc * 10 + (v - 48)).otherwise(acc * 100 + (v - 55)) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), one)


def _card(key: Key, m: Column) -> Column:
    issuer = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12})$"

    def use(d: Column) -> Column:
        n = F.length(d)
        head = F.when(d.startswith("4"), F.lit(1)).otherwise(F.lit(4))
        middle = F.substring(d, head + 1, n - head - 1)

        def moved(mid: Column) -> Column:
            size = F.length(mid)
            left = F.floor(size / 2).cast("int")
            p = feistel(key, "card", _number(F.substring(mid, F.lit(1), left)), _number(F.substring(mid, left + 1, size)), F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), size - left).cast("long"))
            return _let(p, lambda p: F.concat(F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), size - left, "0")))

        body = F.concat(F.substring(d, F.lit(1), head), _let(middle, moved))
        return F.when(d.rlike(issuer) & luhn_valid(d), _refill(m, _let(body, lambda b: F.concat(b, _luhn_check_digit(b))))).otherwise(m)

    return _let(_only_digits(m), use)


def _iban(key: Key, m: Column) -> Column:
    printed = F.contains(m, F.lit(" "))
    lengths = F.create_map(*[F.lit(x) for n, names in IBAN_LENGTHS.items() for c in names.split() for x in (c, n + (n - 1) // 4)])
    size = F.when(printed, lengths[F.substring(m, 1, 2)]).otherwise(F.length(m))

    def use(d: Column) -> Column:
        country = F.substring(d, 1, 2)

        def fill(rest: Column) -> Column:
            check = F.lit(98) - _mod97(F.concat(rest, country, F.lit("00")))
            whole = F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)
            after = _card_within(key, F.substring(m, size + 1, F.length(m)))
            return F.when(printed, F.concat(F.regexp_replace(whole, "(.{4})(?=.)", "$1 "), after)).otherwise(whole)

        valid = _mod97(F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))) == 1
        # groups that only look like a printed IBAN may still hold a card
        other = F.when(printed, _card_within(key, m)).otherwise(m)
        return F.when(valid, _let(feistel_text(key, "iban", F.substring(d, F.lit(5), F.length(d))), fill)).otherwise(other)

    return _let(F.regexp_replace(F.substring(m, F.lit(1), size), " ", ""), use)


def _card_within(key: Key, m: Column) -> Column:
    """``m`` with its first card number replaced."""

    def use(card: Column) -> Column:
        at = F.instr(m, card)
        return F.when(card == "", m).otherwise(F.concat(F.substring(m, F.lit(1), at - 1), _card(key, card), F.substring(m, at + F.length(card), F.length(m))))

    return _let(F.regexp_extract(m, CARD, 0), use)


def _phone(key: Key, m: Column) -> Column:
    def use(d: Column) -> Column:
        plus = m.startswith("+")
        national = F.when(plus & d.startswith("1") & (F.length(d) == 11), F.substring(d, 2, 10)).when(~plus & (F.length(d) == 10), d).when(~plus & d.startswith("1") & (F.length(d) == 11), F.substring(d, 2, 10))
        prefix = F.when(plus | (F.length(d) == 11), F.lit("1")).otherwise(F.lit(""))

        def american(x: Column) -> Column:
            # area codes from 200 stay such, and those below; the exchange stays from 200
            area, rest = _number(F.substring(x, 1, 3)), _number(F.substring(x, 4, 7))
            low, size = F.when(area >= 200, 200).otherwise(1), F.when(area >= 200, 800).otherwise(199)
            p = feistel(key, "phone", area - low, rest - 2_000_000, size, 8_000_000)
            return _let(p, lambda p: F.concat(prefix, F.lpad((p["a"] + low).cast("string"), 3, "0"), (p["b"] + 2_000_000).cast("string")))

        rest = F.substring(d, 3, 13)
        left = F.floor(F.length(rest) / 2).cast("int")
        right = F.length(rest) - left

        def abroad(p: Column) -> Column:
            return F.concat(F.substring(d, 1, 2), F.lpad(p["a"].cast("string"), left, "0"), F.lpad(p["b"].cast("string"), right, "0"))

        world = _let(feistel(key, "tel", _number(F.substring(rest, F.lit(1), left)), _number(F.substring(rest, left + 1, right)), F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), right).cast("long")), abroad)
        valid = national.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") | plus & national.rlike("^(?!000)[0-9]{3}[2-9][0-9]{6}$")
        digits = F.when(valid, _let(national, american)).when(plus & ~d.startswith("1") & F.length(d).between(8, 15), world)
        return F.when(digits.isNotNull(), _refill(m, digits)).otherwise(m)

    return _let(_only_digits(m), use)


def _ssn(key: Key, m: Column) -> Column:
    area, group, serial = (_number(F.substring(m, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    p = feistel(key, "ssn", area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)

    def show(p: Column) -> Column:
        a = p["a"] + 1
        a = a + (a >= 666).cast("long")
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(p, show)).otherwise(m)


def _date(key: Key, m: Column) -> Column:
    iso = m.substr(5, 1) == "-"
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(m, "dd/MM/yyyy"))
    first = F.lit("1800-01-01").cast("date")

    def use(d: Column, month_first: bool) -> Column:
        # 400 Gregorian years have 146,097 = 189 * 773 days; the span that holds 1970 begins on 1800-01-01
        n = F.datediff(d, first).cast("long")
        span = F.floor(n / 146097)
        at = lambda x: F.date_add(first, (x + span * 146097).cast("int"))
        move = lambda x: feistel_number(key, "date", x, 189, 773)
        if not month_first:
            return _let(move(n - span * 146097), lambda x: F.when(iso, F.date_format(at(x), "yyyy-MM-dd")).otherwise(F.date_format(at(x), "dd/MM/yyyy")))
        # days from 13 stay among themselves, so no pseudonym reads as one of the day-first form: on while the day is lower
        late = F.aggregate(F.sequence(F.lit(1), F.lit(64)), move(n - span * 146097), lambda x, _: F.when(F.dayofmonth(at(x)) <= 12, move(x)).otherwise(x))
        return _let(late, lambda x: F.date_format(at(x), "MM/dd/yyyy"))

    def known(d: Column) -> Column:
        return d.between("1000-01-01", "9799-12-31")

    american = F.when(~iso & day.isNull(), F.try_to_date(m, "MM/dd/yyyy"))
    return F.when(known(day), _let(day, lambda d: use(d, False))).when(known(american), _let(american, lambda d: use(d, True))).otherwise(m)


def _ip(key: Key, m: Column) -> Column:
    def use(o: Column) -> Column:
        p = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        show = lambda p: F.concat_ws(".", *[x.cast("string") for half in (p["a"], p["b"]) for x in (F.floor(half / 256), half % 256)])
        return F.when(F.forall(o, lambda x: x < 256), _let(p, show)).otherwise(m)

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), use)


def _email(key: Key, m: Column) -> Column:
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    names = F.split(host, r"\.")
    last = F.size(names)
    moved = F.transform(names, lambda x, i: F.when(i == last - 1, x).otherwise(feistel_text(key, "host", x)))
    return F.concat(feistel_text(key, "mail", local), F.lit("@"), F.array_join(moved, "."))


def _secret(key: Key, m: Column) -> Column:
    value = F.regexp_extract(m, "([A-Za-z0-9+/_-]{16,})$", 1)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), feistel_text(key, "secret", value))


_MOVE = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(key: Key | str, found: Column) -> Column:
    """The pseudonym of one finding; the finding itself if it isn't valid."""
    key, out = _as_key(key), found
    for kind in reversed(KINDS):
        out = F.when(found.rlike(f"^(?:{KINDS[kind]})$"), _MOVE[kind](key, found)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with ``text_col`` pseudonymized; ``count_col`` gets the number of replaced findings."""
    return _replaced(docs, key, text_col, count_col, False)


def restore(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the pseudonyms in ``text_col`` turned back into what they stand for."""
    return _replaced(docs, key, text_col, count_col, True)


def _key_table(spark: SparkSession, secret: str) -> DataFrame:
    """One row, made in the JVM: plans show the column's name, not its value."""
    jvm, cells = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Object, 1)
    cells[0] = secret
    rows = jvm.java.util.ArrayList()
    rows.add(jvm.org.apache.spark.sql.RowFactory.create(cells))
    return DataFrame(spark._jsparkSession.createDataFrame(rows, jvm.org.apache.spark.sql.types.StructType.fromDDL("_key STRING")), spark)


def _replaced(docs: DataFrame, secret: str, text_col: str, count_col: str | None, back: bool) -> DataFrame:
    rows = docs.select(F.struct("*").alias("_row")).crossJoin(F.broadcast(_key_table(docs.sparkSession, secret)))  # one row
    key, text = Key(F.col("_key"), back), F.col("_row").getField(text_col)
    # texts without a digit, an @ or a sign of a secret have no finding; only the others meet the large pattern
    maybe = text.rlike(r"[0-9@]|[=:]")
    found = F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_found", found)
    rows = rows.withColumn("_new", F.transform("_found", lambda m: pseudonym(key, m)))
    between = F.split(text, ANY, -1)
    whole = F.concat(F.get(between, F.lit(0)), F.array_join(F.zip_with(F.col("_new"), F.slice(between, F.lit(2), F.greatest(F.size(between), F.lit(1))), lambda a, b: F.concat(a, b)), ""))
    rows = rows.withColumn("_text", F.when(F.size("_found") > 0, whole).otherwise(text))
    columns = [F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns if c != count_col]
    if count_col:
        changed = F.size(F.filter(F.zip_with("_found", "_new", lambda a, b: a != b), lambda x: x))
        columns.append(F.when(text.isNull(), F.lit(0)).otherwise(changed).cast("long").alias(count_col))
    return rows.select(*columns)
