"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Patterns find candidates; each is validated (Luhn, mod 97, octets, calendar,
number plans) and then permuted inside its own format by a keyed Feistel network.
Card and account numbers are looked for from every place where one may begin, at every
length it may have, because other digits or capital words may stand beside them.
The permutation depends on key and kind alone, so a value gets the same pseudonym in
every document and different values stay different.

* Numbers and dates are pairs of residues; each round adds a keyed function of one
  half to the other, modulo the half's size.
* Strings are halves of characters; each round shifts every digit and letter of one
  half within its own class by a keyed function of the other half.

* Numbers abroad keep their country code; the digits after it are one string.  Where
  ``PHONE_LENGTHS`` knows a country's number length, a number ends there, so digits that
  follow it do not change its pseudonym; elsewhere it ends where its digits end.

Kept: separators, letter case, a card's first digit, a mail address's domain, an
account's and a phone number's country, the fixed beginning of an access token.  Recomputed: check digits.  Left as it is: what fails validation.

Defined results: a null text stays null with zero replacements; columns named
``pii_found`` are replaced; all other columns pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: First day and number of days of the calendar that dates are permuted in: 1900 to 2099.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)

# Digits after the country code, for countries where all numbers have as many.
PHONE_LENGTHS = {
    8: ["45", "47", "65", "370", "371", "372", "852"],
    9: ["27", "31", "33", "34", "40", "41", "48", "56", "61", "212", "254", "351", "375", "380", "420", "421", "966"],
    10: ["7", "30", "44", "52", "54", "57", "63", "90", "91", "92"],
}
# Country codes of one and of two digits; all others have three.
COUNTRY_CODE = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Numbers of known length, which end there whatever follows.
ABROAD = r"\+(?:" + "|".join(
    rf"(?:{'|'.join(codes)})(?:[ .-]?[0-9]){{{n}}}" for n, codes in PHONE_LENGTHS.items()) + ")(?![0-9A-Za-z])"
# What access tokens begin with, and what may follow.
TOKENS = "|".join([
    "AKIA[0-9A-Z]{16}", "gh[pousr]_[0-9A-Za-z]{36,255}", "xox[abprs]-[0-9A-Za-z-]{10,200}",
    r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{16,}"])
TOKEN_HEAD = "^(AKIA|gh[pousr]_|xox[abprs]-|eyJ|)"

# Fixed formats, in order of preference where several match at one place.
PATTERNS = {
    "mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": rf"(?<![A-Za-z0-9])(?:{TOKENS})(?![A-Za-z0-9])|" r"(?<=(?:password|passwd|secret|token|api_key)[ ]?[=:][ ]?[\"']?)[A-Za-z0-9]{8,}",
    "address": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/]|[.-][0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": rf"{ABROAD}|" r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])|\+[0-9](?:[ .-]?[0-9]){7,14}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
END = "(?![0-9A-Za-z])"
#: From each place where a number may begin, its longest text and one character more.
CARD_FROM = r"(?<![0-9A-Za-z+])(?<!\+[0-9]{1,3}[ -])(?=([0-9](?:[ -]?[0-9]){12,18}[0-9A-Za-z]?))"
IBAN_FROM = r"(?<![0-9A-Za-z])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}[0-9A-Za-z]?))"
#: Groups that card numbers are written in, tried before any others.
CARD_GROUPS = [r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{3}", r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}",
               r"[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}", r"[0-9]{13,19}"]
#: Other groups, of three digits or more, longest first.
CARD_OTHERS = [rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1)]
CARD_SHAPE = "^[0-9]{3,}(?:[ -][0-9]{3,})*$"
#: Length of account numbers by country; others are taken in groups of four.
IBAN_LENGTHS = dict(re.findall("([A-Z]{2})([0-9]{2})", """
    AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24
    FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32
    LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24
    RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"""))
IBAN_GROUPS = "^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"


def _int(c: Column) -> Column:
    return c.cast("bigint")


def _with(value: Column, then) -> Column:
    """Evaluate ``value`` once and hand it to ``then``."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _keyed(key: str, kind: str, round_no: Column, half: Column) -> Column:
    """A keyed number below 2**48."""
    return _int(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(f"{key}/{kind}"), round_no.cast("string"), half.cast("string")), 256), 1, 12), 16, 10))


def feistel_pair(a: Column, size_a: int, b: Column, size_b: int, key: str, kind: str) -> Column:
    """struct(a, b): a keyed permutation of the pairs (0..size_a-1, 0..size_b-1)."""
    def state(x: Column, nx: Column, y: Column, ny: Column) -> Column:
        return F.struct(_int(x).alias("x"), _int(nx).alias("nx"), _int(y).alias("y"), _int(ny).alias("ny"))

    def turn(s: Column, i: Column) -> Column:
        return state(s["y"], s["ny"], F.pmod(s["x"] + _keyed(key, kind, i, s["y"]), s["nx"]), s["nx"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(a, F.lit(size_a), b, F.lit(size_b)), turn,
                       lambda s: F.struct(s["x"].alias("a"), s["y"].alias("b")))


def _shift(text: Column, other: Column, key: str, kind: str, round_no: Column) -> Column:
    """Shift each digit and letter of ``text`` within its class by a keyed function of ``other``."""
    def one(c: Column, i: Column) -> Column:
        low = F.when(c.rlike("[0-9]"), F.lit(48)).when(c.rlike("[A-Z]"), F.lit(65)).when(c.rlike("[a-z]"), F.lit(97))
        size = F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(26))
        moved = F.pmod(F.ascii(c) - low + F.pmod(_keyed(key, kind, round_no, F.concat_ws(":", i.cast("string"), other)), size), size)
        return F.when(c.rlike("[0-9A-Za-z]"), F.char(_int(low + moved))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings with the same pattern of digits, cases and other characters."""
    def whole(t: Column) -> Column:
        cut = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substr(t, F.lit(1), cut).alias("x"), F.substr(t, cut + 1).alias("y"))

        def turn(s: Column, i: Column) -> Column:
            moved = F.when(i % 2 == 1, _shift(s["x"], s["y"], key, kind, i)).otherwise(s["x"])
            other = F.when(i % 2 == 0, _shift(s["y"], s["x"], key, kind, i)).otherwise(s["y"])
            return F.struct(moved.alias("x"), other.alias("y"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["x"], s["y"]))

    return _with(text, whole)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, one after another."""
    def one(c: Column, i: Column) -> Column:
        nth = F.length(_digits(F.substr(m, F.lit(1), i + 1)))
        return F.when(c.rlike("[0-9]"), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(m, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""
    def add(s: Column, c: Column) -> Column:
        d = _int(c)
        doubled = F.when(s["odd"] == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
        return F.struct((s["sum"] + doubled).alias("sum"), (F.lit(1) - s["odd"]).alias("odd"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(1).alias("odd")),
                       add, lambda s: s["sum"])


def _mod97(chars: Column) -> Column:
    """An account number, country and check digits moved to the end, modulo 97."""
    moved = F.concat(F.substr(chars, F.lit(5)), F.substr(chars, F.lit(1), F.lit(4)))

    def add(r: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (r * 10 + _int(c)) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0).cast("bigint"), lambda r, c: _int(add(r, c)))


def _two(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def _card(m: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        body = F.concat(F.substr(d, F.lit(1), F.lit(1)), feistel_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        return _with(body, lambda b: refill(m, F.concat(b, F.pmod(F.lit(10) - _luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string"))))

    return _with(_digits(m), lambda d: F.when(_luhn_sum(d) % 10 == 0, valid(d)).otherwise(m))


def _iban(m: Column, key: str) -> Column:
    def new(c: Column) -> Column:
        body = feistel_text(F.substr(c, F.lit(5)), key, "iban")
        country = F.substr(c, F.lit(1), F.lit(2))
        plain = _with(body, lambda b: F.concat(country, _two(F.lit(98) - _mod97(F.concat(country, F.lit("00"), b)), 2), b))
        def one(x: Column, i: Column, p: Column) -> Column:
            nth = F.length(F.replace(F.substr(m, F.lit(1), i + 1), F.lit(" "), F.lit("")))
            return F.when(x == " ", x).otherwise(F.substr(p, nth, F.lit(1)))
        return _with(plain, lambda p: F.array_join(F.transform(F.split(m, ""), lambda x, i: one(x, i, p)), ""))

    return _with(F.replace(m, F.lit(" "), F.lit("")), lambda c: F.when(F.length(c).between(15, 34) & (_mod97(c) == 1), new(c)).otherwise(m))


def _address(m: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        o = [_int(F.element_at(o, i)) for i in range(1, 5)]
        pair = feistel_pair(o[0] * 256 + o[1], 1 << 16, o[2] * 256 + o[3], 1 << 16, key, "address")
        return _with(pair, lambda p: F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(p[h] / 256), p[h] % 256)]))

    return _with(F.split(m, r"\."), lambda o: F.when(F.forall(o, lambda x: _int(x) <= 255), new(o)).otherwise(m))


def _date(m: Column, key: str) -> Column:
    iso, slash = m.rlike("^[0-9]{4}-"), m.contains("/")
    parts = F.split(m, "[-/.]")
    p = [F.element_at(parts, i) for i in (1, 2, 3)]
    day_first = _int(p[1]) <= 12  # otherwise month first, where slashes stand
    written = (F.when(iso, m).when(day_first, F.concat_ws("-", p[2], p[1], p[0]))
               .when(slash, F.concat_ws("-", p[2], p[0], p[1])))
    number = F.datediff(F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))

    def new(n: Column) -> Column:
        pair = feistel_pair(F.floor(n / DAYS[1]), DAYS[0], n % DAYS[1], DAYS[1], key, "date")
        day = _with(pair, lambda q: F.date_add(F.lit(FIRST_DAY).cast("date"), (q["a"] * DAYS[1] + q["b"]).cast("int")))
        return _with(day, lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd"))
                     .when(day_first, F.concat(F.date_format(d, "dd"), F.when(slash, "/").otherwise("."), F.date_format(d, "MM"), F.when(slash, "/").otherwise("."), F.date_format(d, "yyyy")))
                     .otherwise(F.date_format(d, "MM/dd/yyyy")))

    return _with(number, lambda n: F.when(n.between(0, DAYS[0] * DAYS[1] - 1), new(n)).otherwise(m))


def _social(m: Column, key: str) -> Column:
    area, group, serial = (_int(F.substring(m, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    index = area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1))  # 0..897
    pair = feistel_pair(index * 99 + group - 1, 898 * 99, serial - 1, 9999, key, "social")

    def new(p: Column) -> Column:
        i = _int(F.floor(p["a"] / 99))
        return F.concat_ws("-", _two(i + F.when(i >= 665, F.lit(2)).otherwise(F.lit(1)), 3), _two(p["a"] % 99 + 1, 2), _two(p["b"] + 1, 4))

    return F.when(valid, _with(pair, new)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """Numbers of the North American plan keep the plan; others keep their country code."""
    def american(d: Column) -> Column:
        n = F.right(d, F.lit(10))
        area, exchange, line = (_int(F.substring(n, a, k)) for a, k in ((1, 3), (4, 3), (7, 4)))
        pair = feistel_pair((area - 200) * 800 + exchange - 200, 640_000, line, 10_000, key, "phone")
        head = F.substr(d, F.lit(1), F.length(d) - 10)
        new = _with(pair, lambda p: F.concat(head, _two(_int(F.floor(p["a"] / 800)) + 200, 3), _two(p["a"] % 800 + 200, 3), _two(p["b"], 4)))
        return _with(new, lambda x: refill(m, x))

    def valid(d: Column) -> Column:
        n = F.right(d, F.lit(10))
        return (F.length(d).isin(10, 11)) & n.rlike("^[2-9][0-9]{2}[2-9]") & ((F.length(d) == 10) | d.startswith("1"))

    def abroad(d: Column) -> Column:
        own = F.regexp_replace(d, COUNTRY_CODE, "")
        code = F.substr(d, F.lit(1), F.length(d) - F.length(own))
        return _with(F.concat(code, feistel_text(own, key, "phone")), lambda x: refill(m, x))

    return _with(_digits(m), lambda d: F.when(valid(d), american(d))
                 .when(m.startswith("+") & ~m.startswith("+1") & F.length(d).between(8, 15), abroad(d)).otherwise(m))


def _mail(m: Column, key: str) -> Column:
    return _with(F.split(m, "@"), lambda p: F.concat(feistel_text(F.element_at(p, 1), key, "mail"), F.lit("@"), F.element_at(p, 2)))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, TOKEN_HEAD, 1)
    return F.concat(head, feistel_text(F.substr(m, F.length(head) + 1), key, "secret"))


#: What replaces a match of each pattern.
NEW = {"mail": _mail, "secret": _secret, "address": _address, "date": _date, "social": _social, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: str, names: list[str]) -> Column:
    """The pseudonym of one match of the named ``PATTERNS``, the last one taken without a look."""
    out = NEW[names[-1]](m, key)
    for n in reversed(names[:-1]):
        out = F.when(m.contains("@") if n == "mail" else m.rlike(f"^(?:{PATTERNS[n]})$"), NEW[n](m, key)).otherwise(out)
    return out


def _piece(text: Column, new: Column | None = None) -> Column:
    return F.struct(text.alias("t"), (F.lit(None).cast("string") if new is None else new).alias("new"))


def _cut(pieces: Column, body) -> Column:
    """``pieces`` with ``body`` run over the text of those without a pseudonym."""
    return F.flatten(F.transform(pieces, lambda p: F.when(p["new"].isNull(), body(p["t"])).otherwise(F.array(p))))


def _by_pattern(names: list[str], key: str):
    """Cut a text at all matches of some of ``PATTERNS``; what fails validation gets no pseudonym."""
    any_of = "|".join(f"(?:{PATTERNS[n]})" for n in names)

    def body(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(any_of), F.lit(0)),
                            lambda m: _with(pseudonym(m, key, names), lambda new: _piece(m, F.when(new != m, new))))
        pairs = F.zip_with(F.split(t, any_of, -1), found, lambda a, b: F.filter(F.array(_piece(a), b), lambda p: p.isNotNull()))
        return F.when(t.rlike(any_of), F.flatten(pairs)).otherwise(F.array(_piece(t)))

    return body


def _by_value(begins: str, valid, new):
    """Cut a text at the first valid span from each place where ``begins`` finds one."""
    def split(state: Column, v: Column) -> Column:
        at = F.concat(F.lit(r"(?<![0-9A-Za-z])\Q"), v["t"], F.lit(rf"\E{END}"))
        return _cut(state, lambda t: F.flatten(F.transform(
            F.split(t, at, -1), lambda a, i: F.when(i == 0, F.array(_piece(a))).otherwise(F.array(v, _piece(a))))))

    def body(t: Column) -> Column:
        spans = F.transform(F.regexp_extract_all(t, F.lit(begins), F.lit(1)), lambda w: F.get(valid(w), F.lit(0)))
        values = F.transform(F.array_distinct(F.filter(spans, lambda v: v.isNotNull())), lambda v: _piece(v, new(v)))
        return F.when(t.rlike(begins), F.aggregate(values, F.array(_piece(t)), split)).otherwise(F.array(_piece(t)))

    return body


def _card_spans(formats: list[str]):
    def valid(w: Column) -> Column:
        spans = F.array(*[F.regexp_substr(w, F.lit(f"^{p}{END}")) for p in formats])
        return F.filter(spans, lambda s: s.isNotNull() & s.rlike(CARD_SHAPE) & (_luhn_sum(_digits(s)) % 10 == 0))

    return valid


def _iban_spans(w: Column) -> Column:
    lengths = F.create_map(*[F.lit(x) for c, n in IBAN_LENGTHS.items() for x in (c, int(n))])
    own = F.try_element_at(lengths, F.substr(w, F.lit(1), F.lit(2)))

    def span(n: Column) -> Column:
        return F.regexp_substr(w, F.concat(F.lit("^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){"), (n - 4).cast("string"), F.lit("}" + END)))

    return _with(own, lambda n: F.filter(
        F.transform(F.when(n.isNotNull(), F.array(n)).otherwise(F.sequence(F.lit(34), F.lit(15), F.lit(-1))), span),
        lambda s: s.isNotNull() & (n.isNotNull() | s.rlike(IBAN_GROUPS)) & (_mod97(F.replace(s, F.lit(" "), F.lit(""))) == 1)))


def pseudonymise(docs: DataFrame, key: str = "tidemark", column: str = "text") -> DataFrame:
    """``docs`` with personal data of ``column`` permuted, and ``pii_found`` replacements."""
    own = [c for c in docs.columns if c != "pii_found"]
    text = F.col(column)
    suspect = text.rlike("[0-9@]|(?:password|passwd|secret|token|api_key)[ ]?[=:]")
    steps = [
        _by_pattern(["mail", "secret"], key),
        _by_value(IBAN_FROM, _iban_spans, lambda v: _iban(v, key)),
        _by_value(CARD_FROM, _card_spans(CARD_GROUPS), lambda v: _card(v, key)),
        _by_pattern(["address", "date", "social", "phone"], key),
        _by_value(CARD_FROM, _card_spans(CARD_OTHERS), lambda v: _card(v, key)),
        _by_pattern(["card"], key),
    ]
    # own columns travel as one struct, so none of their names clashes with a working column
    found = docs.select(F.struct(*own).alias("row"), F.when(suspect, F.array(_piece(text))).alias("pieces"))
    for step in steps:
        found = found.withColumn("pieces", _cut(F.col("pieces"), step))
    changed = F.size(F.filter("pieces", lambda p: p["new"] != p["t"]))
    row = F.col("row")
    out = F.when(F.col("pieces").isNotNull(), F.array_join(F.transform("pieces", lambda p: F.coalesce(p["new"], p["t"])), "")).otherwise(row[column])
    return found.select(*[(out if c == column else row[c]).alias(c) for c in own],
                        F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(changed).cast("bigint").alias("pii_found"))
