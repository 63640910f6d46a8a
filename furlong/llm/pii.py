"""PII: format-preserving Feistel pseudonyms of validated numbers, dates, addresses and secrets."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, let

#: The Spark setting that holds the key where none is given.
KEY_SETTING = "spark.furlong.pii.key"
ROUNDS = 8
#: What may be personal, most specific first; each is validated by its kind below. Groups repeat
#: a bounded number of times (a domain has 127 labels at most), since the matcher recurses for each.
_EDGE, _END = r"(?<![0-9A-Za-z_.@+-])", r"(?![0-9A-Za-z_@])"
PATTERNS = {
    "email": r"(?<![0-9A-Za-z_.@+%-])[0-9A-Za-z][0-9A-Za-z_.+%-]*@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+){0,126}\.[A-Za-z]{2,}(?![0-9A-Za-z_@])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])",
    "access": r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "date": _EDGE + r"(?:1[89]|2[01])[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])" + _END,
    "ip": _EDGE + r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])" + _END + r"(?!\.[0-9])",
    "ssn": _EDGE + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + _END + r"(?!-[0-9])",
    "phone": r"(?<![0-9A-Za-z_+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}" + _END,
    "number": _EDGE + r"[0-9](?:[ -]?[0-9]){12,18}" + _END,
}
FOUND = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The proleptic Gregorian calendar repeats after 400 years: 146097 = 189 * 773 days.
DAY_ONE, DAY_RADIXES = "1800-01-01", (189, 773)


def feistel(values: Column, radixes: Column, key: str, kind: str) -> Column:
    """Permute an array of digits, each below its radix, under the key.

    The halves in turn are shifted, digit by digit modulo their radixes, by a keyed hash of
    the other half; so the map is a bijection of the format, whatever the radixes.
    """
    cut = F.floor(F.size(values) / 2).cast("int")
    halves = lambda a: (F.slice(a, 1, cut), F.slice(a, cut + 1, F.size(a)))
    (left, right), (left_radix, right_radix) = halves(values), halves(radixes)

    def shifted(half, radix, other, r):
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 512)
        each = F.zip_with(half, radix, lambda x, m: F.struct(x.alias("x"), m.alias("m")))  # so the radixes are made once
        part = lambda h, j: F.conv(F.substring(h, (j % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return let(h, lambda h: F.transform(each, lambda e, j: ((e["x"] + part(h, j)) % e["m"]).cast("int")))

    step = lambda acc, r: F.struct(F.when(r % 2 == 0, shifted(acc["l"], left_radix, acc["r"], r)).otherwise(acc["l"]).alias("l"), F.when(r % 2 == 1, shifted(acc["r"], right_radix, acc["l"], r)).otherwise(acc["r"]).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.alias("l"), right.alias("r")), step, lambda acc: F.concat(acc["l"], acc["r"]))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _refill(s: Column, chars: str, new: Column) -> Column:
    """s with its characters of the class `chars` replaced, in order, by the strings in new."""
    between = F.split(s, f"[{chars}]", -1)
    return F.array_join(F.zip_with(between, new, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")


def _digits(s: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("int"))


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn terms of an array of digits, the last of them counted once."""
    n = F.size(digits)
    return F.aggregate(F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)), F.lit(0), lambda a, x: a + x)


def _strings(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("string"))


def _tens(values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(10))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, in the match's own format; equal values have equal ones."""
    digits = _digits(m)
    tens = lambda d, kind: feistel(d, _tens(d), key, kind)
    checked = lambda d: F.concat(d, F.array((10 - luhn_sum(F.concat(d, F.array(F.lit(0)))) % 10) % 10))
    payload = F.slice(digits, 1, F.greatest(F.size(digits) - 1, F.lit(0)))
    card = _refill(m, "0-9", _strings(let(let(payload, lambda d: tens(d, "card")), checked)))
    # a number that fails the check keeps failing it: how far its last digit is off (1 to 9) is permuted with the others
    off = lambda d: (F.element_at(digits, -1) - F.element_at(checked(d), -1) + 10) % 10
    odd = lambda d: feistel(F.concat(d, F.array(off(d) - 1)), F.concat(_tens(d), F.array(F.lit(9))), key, "number")
    wrong = lambda x: let(F.slice(x, 1, F.size(x) - 1), lambda d: F.concat(d, F.array((F.element_at(checked(d), -1) + F.element_at(x, -1) + 1) % 10)))
    number = _refill(m, "0-9", _strings(let(let(payload, odd), wrong)))
    # area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    ssn = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    ssn = let(feistel(ssn, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn"), lambda x: F.format_string("%03d-%02d-%04d", x[0] + F.when(x[0] >= 665, 2).otherwise(1), x[1] + 1, x[2] + 1))
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])|^\+1|^\+[0-9]{2}", 0)
    local = F.substring(m, F.length(country) + 1, F.length(m))
    phone = F.concat(country, _refill(local, "0-9", _strings(let(_digits(local), lambda d: tens(d, "phone")))))
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    ip = F.array_join(_strings(feistel(octets, F.transform(octets, lambda _: F.lit(256)), key, "ip")), ".")
    day = F.datediff(F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date"), F.lit(DAY_ONE).cast("date"))
    a, b = DAY_RADIXES
    place = feistel(F.array((day / b).cast("int"), (day % b).cast("int")), F.array(F.lit(a), F.lit(b)), key, "date")
    date = F.date_format(F.date_add(F.lit(DAY_ONE).cast("date"), F.element_at(place, 1) * b + F.element_at(place, 2)), "yyyy-MM-dd")
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    is_digit = lambda x: x < 58
    permuted = lambda low, radix, kind: F.zip_with(feistel(F.transform(low, lambda x: F.when(is_digit(x), x - 48).otherwise(x - 97)), radix, key, kind), radix, lambda x, r: F.char(F.when(r == 10, x + 48).otherwise(x + 97)))
    low = lambda s: F.transform(_chars(F.regexp_replace(F.lower(s), "[^0-9a-z]", "")), lambda c: F.ascii(c))
    letters = lambda s, kind: let(low(s), lambda low: let(F.transform(low, lambda x: F.when(is_digit(x), 10).otherwise(26)), lambda radix: permuted(low, radix, kind)))
    access = F.concat(F.substring(m, 1, 4), F.upper(F.array_join(letters(F.substring(m, 5, 16), "access"), "")))
    email = F.concat(_refill(name, "0-9A-Za-z", letters(name, "email")), F.lit("@"), host)
    email = F.when(m == F.upper(m), F.upper(email)).otherwise(email)
    hexes = F.transform(_chars(m), lambda c: F.conv(c, 16, 10).cast("int"))
    secret = F.array_join(F.transform(let(hexes, lambda h: feistel(h, F.transform(h, lambda _: F.lit(16)), key, "secret")), lambda x: F.lower(F.hex(x))), "")
    secret = F.when(m.rlike("[A-F]"), F.upper(secret)).otherwise(secret)
    kind = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    return (
        F.when(kind("email"), email).when(kind("secret"), secret).when(kind("access"), access).when(kind("date"), F.coalesce(date, m)).when(kind("ip"), ip).when(kind("ssn"), ssn)
        .when(kind("phone"), phone).when(luhn_sum(digits) % 10 == 0, card).otherwise(number)
    )


def pseudonymise(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace personal values by keyed pseudonyms of the same format.

    Returns one row per document: doc_id, n_found, text. Covered are e-mail addresses (the
    name is permuted, letters and digits each in place), long hexadecimal secrets, access keys, ISO dates
    (permuted within 400 years, if they exist), IPv4 addresses, social security numbers,
    international phone numbers (the country code stays) and numbers of 13 to 19 digits:
    those that pass Luhn's check pass it again, those that fail it fail it again, so a pseudonym
    of one kind never equals one of the other. Social security numbers stay in their valid
    ranges. The key is the argument or the setting KEY_SETTING; there is no default, since
    whoever has the key can reverse the permutation. The permutation
    depends on the value's digits or letters, not on its punctuation or case, so a value has
    one pseudonym in all documents.

    It runs in the scan, row by row: no shuffle, so no key can be hot. Null text is empty;
    null ids and repeated rows pass through; an empty table gives an empty result; other
    columns are ignored. A long text costs in proportion to its length.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"give a key or set {KEY_SETTING}")
    texts = id_and_text(docs, id_col, text_col)
    parts = texts.select("doc_id", "text", F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)).alias("hits"))
    new = F.concat(F.array(F.lit("")), F.transform("hits", lambda m: pseudonym(m, key)))
    joined = F.array_join(F.zip_with(new, F.split("text", FOUND, -1), lambda n, g: F.concat(n, g)), "")
    return parts.select("doc_id", F.size("hits").cast("long").alias("n_found"), F.when(F.size("hits") == 0, F.col("text")).otherwise(joined).alias("text"))
