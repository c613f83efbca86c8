"""Format-preserving pseudonyms for personal data, with SQL functions only.

Values are found by pattern, validated (Luhn check of card numbers, IBAN
remainder, real calendar dates, octets up to 255, SSN allocation) and replaced
by a keyed Feistel permutation of their own format: digits stay digits,
separators stay, card numbers keep a valid check digit, dates stay dates. Equal
values get equal pseudonyms in all documents; the permutation can be undone with
the key. Values that fail validation and all other text are left unchanged.

Within a run of digit groups (single spaces or hyphens between) each stretch of
whole groups with 13 to 19 digits is tried as a card number: first those of an
issuer's first digit and length, then the others; from left to right, the longest
first, none overlapping. A run ends before a date, SSN, address or phone number.
IBANs in groups of four have their country's registered length. Addresses of IP
version 6 keep their groups; they, and names of e-mail, come out in lower case.

Each permutation has two parts A and B that change in turn, A by a keyed hash of
B and B by one of A, digit by digit modulo the digit's radix. Dates are days of
the 400 years from 1800 as a pair below 189 and 773 (their product is the days
of 400 Gregorian years); dates outside them stay. A date with the year last reads
day first, and gives one that reads day first, if its parts allow that; else its
day above 12 and its month are permuted together, so that it still reads month
first. A date with a one-digit day or month gives such a date, without zeros in
front. E-mail names are permuted as base-36 strings in lower case (undoing gives
lower case), those with letters beyond ASCII over Latin, Greek and Cyrillic ones
too (other scripts stay); the domain stays. Secrets (assignments to a name of
LABEL, quoted or not, of eight letters and digits or more, also between + / _ = ~
. and -; what follows bearer; passwords in addresses; tokens of forges; 40
hexadecimal digits; access key ids) are permuted over their alphabet; other
characters stay. Values of any length
are replaced whole, longer ones in parts of PART characters.

Defined cases: a null text stays null; an empty or clean text is unchanged; texts
and values of any length are searched and replaced whole; rows that repeat or
have a null id are each replaced alike; other columns are kept, whatever their
names, but one called n_pii is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY, ROUNDS, PART = "change-this-key", 8, 64
ALPHABETS = {"digit": "0123456789", "hex": "0123456789abcdef", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base62": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
#: Lower-case letters of names beyond ASCII: Latin with marks, Greek, Cyrillic.
ALPHABETS["letters"] = ALPHABETS["base36"] + "".join(chr(c) for a, b in ((0xDF, 0xF6), (0xF8, 0x17E), (0x3AC, 0x3CE), (0x430, 0x45F)) for c in range(a, b + 1) if chr(c).islower())

# Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _grouped_ibans() -> str:
    """Pattern of IBANs in groups of four with single spaces."""
    each = [f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, lands in IBAN_LENGTHS.items()]
    return r"(?<![\w])(?:" + "|".join(each) + r")(?![\w])"


#: What names a secret, with quotes or marks up to it; words before one that holds a digit; the user part of an address; a forge's token.
LABEL = r"(?i:(?:access|auth|api|secret|private|client)[_-]?(?:key|token|secret)|password|passwd|passphrase|pwd|token|secret)[\x22']?\s*+[=:]\s*+[\x22']?"
BEARER = r"(?i:bearer)\s++(?=[A-Za-z0-9+/_=~.-]*[0-9])"
USER = r"(?:https?|ftps?|sftp|ssh|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|git)://[^\s/@:\x22'<>]{1,128}:"
FORGE = "gh[pousr]_"
_LONG = r"(?=(?:[+/_=~.-]*+[A-Za-z0-9]){8})[A-Za-z0-9+/_=~.-]*[A-Za-z0-9+/=]"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: Patterns by kind, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\w\p{L}.+-])[A-Za-z0-9\p{L}][\w\p{L}.+-]*+(?<=[A-Za-z0-9_\p{L}])@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "secret": rf"(?<![\w])(?:{LABEL}|{BEARER}){_LONG}|(?<![\w]){USER}[^\s/@\x22'<>]{{1,256}}(?=@)|(?<![\w]){FORGE}[A-Za-z0-9]{{20,255}}(?![\w])|(?<![\w])[0-9a-f]{{40}}(?![\w])|(?<![\w])AKIA[A-Z0-9]{{16}}(?![\w])",
    "iban": r"(?<![\w])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![\w])|" + _grouped_ibans(),
    "phone": "|".join([
        r"(?<![\w+])\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3}[ -]?[0-9]{4}(?![\w])",
        r"(?<![\w+])\+[0-9]{10,14}(?![\w])",
        r"(?<![\w+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![\w])",
        r"(?<![\w+])\+[0-9]{2,3} [0-9](?: [0-9]{2}){4}(?![\w])",
        r"(?<![\w+])\+[0-9]{1,3}[ .-][0-9]{1,4}[ .-][0-9]{3,4}[ .-]?[0-9]{3,5}(?![\w])",
        r"(?<![\w+])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\w])",
        r"(?<![\w+.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w]|-[0-9])",
        r"(?<![\w+.-])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![\w]|\.[0-9])",
        r"(?<![\w+.-])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?![\w]|[ -][0-9])",
        r"(?<![\w+.-])0[0-9]{2,4}[/-][0-9]{3,4}[ -]?[0-9]{3,5}(?![\w]|[ -][0-9])",
        r"(?<![\w+.-])(?<![0-9] )0[0-9]{2,4} [0-9]{3,4}[ -]?[0-9]{3,5}(?![\w]|[ -][0-9])",
        r"(?<![\w+.-])(?<![0-9] )0[0-9](?: [0-9]{2}){4}(?![\w]|[ -][0-9])",
        r"(?<![\w+.-])0[0-9](?:\.[0-9]{2}){4}(?![\w]|\.[0-9])",
    ]),
    "date": r"(?<![\w.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?![\w-])|(?=T[0-9]{2}))|(?<![\w./-])[0-9]{4}/[0-9]{2}/[0-9]{2}(?![\w/])|(?<![\w./])(?:[0-9]{2}[./][0-9]{2}[./]|[0-9]{1,2}(?:/[0-9]{1,2}/|\.[0-9]{1,2}\.))[0-9]{4}(?![\w/])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "ipv6": rf"(?<![\w:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[0-9A-Fa-f:]*[0-9])(?:{_GROUP}:){{2,6}}(?::{_GROUP}){{1,5}}|(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{{3,4}}:(?::{_GROUP}){{1,6}}|(?:{_GROUP}:){{2,7}}:)(?![\w:])",
    "ipv4": r"(?<![\w.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![\w]|\.[0-9])",
}
# A whole run of groups; possessive, so that a long one is passed in a loop and without going back.
PATTERNS["card"] = r"(?<![\w-])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?!\w)(?:[ -](?!" + "|".join(PATTERNS[k] for k in ("phone", "date", "ssn", "ipv4")) + r")[0-9]++(?!\w))*+"
# First digits and lengths that card numbers are issued with; both stay in a pseudonym.
ISSUED = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|[25][0-9]{15}|3[0-9]{13,15}|6[0-9]{15,18})$"
# What stays of a phone number: its country code, or the 0 before an area code.
PHONE_HEAD = r"^\+[0-9]{1,3}(?=[ .-]?\(|[ .-])|^\+[0-9]{2}|^0(?![0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}$)"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stream(text: Column, radix: Column) -> Column:
    """One number below each radix, from a hash of text."""
    return let(F.sha2(text, 512), lambda digest: F.transform(radix, lambda r, i: F.conv(F.substring(digest, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % r))


def permute(values: Column, radix: Column, kind: str, key: str = KEY, undo: bool = False) -> Column:
    """A keyed permutation of arrays of up to 64 numbers, each below its radix."""
    half = F.floor(F.size(values) / 2).cast("int")
    sign = -1 if undo else 1
    first, second = F.slice(values, F.lit(1), half), F.slice(values, half + 1, F.size(values) - half)
    ra, rb = F.slice(radix, F.lit(1), half), F.slice(radix, half + 1, F.size(radix) - half)
    start = F.struct(first.alias("a"), second.alias("b"))

    def shift(x: Column, other: Column, r: Column, n: Column) -> Column:
        salted = F.concat_ws("|", F.lit(f"{key}|{kind}"), n.cast("string"), F.size(values).cast("string"), F.array_join(F.transform(other, lambda o: o.cast("string")), ","))
        return F.zip_with(F.zip_with(x, _stream(salted, r), lambda p, q: p + sign * q), r, lambda p, q: F.pmod(p, q))

    def step(s: Column, n: Column) -> Column:
        a = F.when(n % 2 == 0, shift(s["a"], s["b"], ra, n)).otherwise(s["a"])
        b = F.when(n % 2 == 1, shift(s["b"], s["a"], rb, n)).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: F.concat(s["a"], s["b"]))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _locate(c: Column, letters: str) -> Column:
    return F.call_function("locate", c, F.lit(letters))


def _refill(chars: Column, letters: str, new: Column) -> Column:
    """The text of chars, those in letters replaced in turn by the numbered letters of new."""

    def fill(own: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            put = F.substring(F.lit(letters), F.get(own, s["k"]).cast("int") + 1, F.lit(1))
            ours = _locate(c, letters) > 0
            return F.struct(F.concat(s["t"], F.when(ours, put).otherwise(c)).alias("t"), (s["k"] + F.when(ours, 1).otherwise(0)).alias("k"))

        return F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(0).alias("k")), step, lambda s: s["t"])

    return let(new, fill)


def _numbers(chars: Column, letters: str) -> Column:
    return F.filter(F.transform(chars, lambda c: (_locate(c, letters) - 1).cast("int")), lambda v: v >= 0)


def permute_text(text: Column, alphabet: str, kind: str, key: str = KEY, undo: bool = False) -> Column:
    """Permutes the characters of text that are in the alphabet, in parts of PART if it is longer; others stay in place."""
    letters = ALPHABETS[alphabet]
    radix = lambda own: F.transform(own, lambda _: F.lit(len(letters)))
    one = lambda t: let(_characters(t), lambda chars: let(_numbers(chars, letters), lambda own: _refill(chars, letters, permute(own, radix(own), kind, key, undo))))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), one), "")


def _card(text: Column, key: str, undo: bool) -> Column:
    """First digit and validity stay: the digits between are permuted and the check digit is chosen anew."""
    digits = F.regexp_replace(text, "[^0-9]", "")

    def body(d: Column) -> Column:
        head = F.concat(F.substring(d, 1, 1), permute_text(F.substring(d, F.lit(2), F.length(d) - 2), "digit", "card", key, undo))
        valid = let(head, lambda h: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(h, c.cast("string"))), lambda n: F.call_function("luhn_check", n)), 1))
        full = let(valid, lambda v: _refill(_characters(text), ALPHABETS["digit"], _numbers(_characters(v), ALPHABETS["digit"])))
        return F.when(F.call_function("luhn_check", d), full).otherwise(text)

    return let(digits, body)


def _cards(run: Column, key: str, undo: bool) -> Column:
    """text and n: a run of digit groups with its card numbers replaced, and how many of them changed."""

    def valid(window: Column) -> Column:
        """Numbers of groups from the window's start that make a card number, with whether it is of an issued form."""
        tried = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.translate(F.array_join(F.slice(parts, F.lit(1), k), ""), " -", "").alias("d")))
        good = F.filter(let(F.regexp_extract_all(window, F.lit("[0-9]+[ -]?"), F.lit(0)), tried), lambda t: F.length(t["d"]).between(13, 19) & F.call_function("luhn_check", t["d"]))
        return F.transform(good, lambda t: F.struct(t["k"].alias("k"), t["d"].rlike(ISSUED).alias("issued")))

    none = F.expr("cast(array() as array<struct<i: int, k: int>>)")

    def issued(starts: Column) -> Column:
        """i and k of the cards of issued forms."""

        def step(s: Column, x: Column) -> Column:
            fit = F.filter(x["valid"], lambda v: v["issued"] & (x["i"] >= s["free"]))
            k = F.array_max(fit)["k"]
            more = F.struct(F.concat(s["taken"], F.array(F.struct(x["i"].alias("i"), k.alias("k")))).alias("taken"), (x["i"] + k).alias("free"))
            return F.when(F.size(fit) > 0, more).otherwise(s)

        return F.aggregate(starts, F.struct(none.alias("taken"), F.lit(0).alias("free")), step, lambda s: s["taken"])

    def others(starts: Column, first: Column) -> Column:
        """Those of issued forms and, between them, the rest."""

        def step(s: Column, x: Column) -> Column:
            ahead = F.get(first, s["next"])["i"]
            at = F.coalesce(ahead == x["i"], F.lit(False))
            fit = F.filter(x["valid"], lambda v: (x["i"] >= s["free"]) & F.coalesce(x["i"] + v["k"] <= ahead, F.lit(True)))
            k = F.when(at, F.get(first, s["next"])["k"]).otherwise(F.array_max(fit)["k"])
            more = F.struct(F.concat(s["taken"], F.array(F.struct(x["i"].alias("i"), k.alias("k")))).alias("taken"), (x["i"] + k).alias("free"), (s["next"] + at.cast("int")).alias("next"))
            return F.when(at | (F.size(fit) > 0), more).otherwise(s)

        return F.aggregate(starts, F.struct(none.alias("taken"), F.lit(0).alias("free"), F.lit(0).alias("next")), step, lambda s: s["taken"])

    def body(parts: Column) -> Column:
        windows = F.regexp_extract_all(run, F.lit("(?<![0-9])(?=((?:[0-9]++[ -]?+){1,19}))[0-9]"), F.lit(1))
        starts = F.filter(F.transform(windows, lambda w, i: F.struct(i.alias("i"), valid(w).alias("valid"))), lambda x: F.size(x["valid"]) > 0)
        taken = let(starts, lambda x: let(issued(x), lambda first: others(x, first)))

        def step(s: Column, t: Column) -> Column:
            old = F.array_join(F.slice(parts, t["i"] + 1, t["k"]), "")
            return let(F.struct(old.alias("old"), _card(old, key, undo).alias("new")), lambda c: F.struct(
                F.concat(s["out"], F.array(F.array_join(F.slice(parts, s["at"] + 1, t["i"] - s["at"]), ""), c["new"])).alias("out"),
                (t["i"] + t["k"]).alias("at"),
                (s["n"] + F.when(c["old"] != c["new"], 1).otherwise(0)).alias("n"),
            ))

        start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("n"))
        tail = lambda s: F.array_join(F.slice(parts, s["at"] + 1, F.size(parts)), "")
        return F.aggregate(taken, start, step, lambda s: F.struct(F.concat(F.array_join(s["out"], ""), tail(s)).alias("text"), s["n"].alias("n")))

    return let(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0)), body)


def mod97(text: Column) -> Column:
    """Remainder of an IBAN whose first four characters stand at its end; letters count from 10."""
    values = F.transform(_characters(text), lambda c: (_locate(c, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") - 1).cast("int"))
    return F.aggregate(values, F.lit(0), lambda acc, v: F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97))


def _iban(text: Column, key: str, undo: bool) -> Column:
    land, rest = F.substring(text, 1, 2), F.substring(text, F.lit(5), F.length(text))
    close = lambda t: F.replace(t, F.lit(" "), F.lit(""))
    valid = mod97(close(F.concat(rest, F.substring(text, 1, 4)))) == 1
    new = let(permute_text(rest, "digit", "iban", key, undo), lambda r: F.concat(land, F.lpad((F.lit(98) - mod97(close(F.concat(r, land, F.lit("00"))))).cast("string"), 2, "0"), r))
    return F.when(valid, new).otherwise(text)


def _date(text: Column, key: str, undo: bool) -> Column:
    """Days since 1800-01-01 as 189 times 773; of dates that only read month first, the month and the day above 12."""
    plain = F.regexp_replace(text, "[/.]", "-")
    mark = F.regexp_extract(text, "[-/.]", 0)
    first, days = F.to_date(F.lit("1800-01-01")), 189 * 773

    one_digit = lambda d: (F.month(d) < 10) | (F.dayofmonth(d) < 10)

    def month_first(when: Column, short: bool) -> Column:
        """Permutes 4800 months by 19 days until a real date comes out (97 in 100 are; of the same writing), which is a permutation of those."""
        month = (F.year(when) - 1800) * 12 + F.month(when) - 1
        radix = F.array(F.lit(4800), F.lit(19))
        turn = lambda p: permute(p, radix, "month-first", key, undo)
        real = lambda p: F.try_to_date(F.format_string("%04d-%02d-%02d", (p[0] / 12).cast("int") + 1800, p[0] % 12 + 1, p[1] + 13), "yyyy-MM-dd")
        good = lambda p: real(p).isNotNull() & ((p[0] % 12 < 9) if short else F.lit(True))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(20 if short else 12)), turn(F.array(month, F.dayofmonth(when) - 13)), lambda p, _: F.when(good(p), p).otherwise(turn(p)))
        return let(found, real)

    def any_day(when: Column, short: bool) -> Column:
        age = F.datediff(when, first)
        start, radix = F.array((age / 773).cast("int"), (age % 773).cast("int")), F.array(F.lit(189), F.lit(773))
        turn = lambda p: permute(p, radix, "date", key, undo)
        day = lambda p: F.date_add(first, p[0] * 773 + p[1])
        if not short:
            return let(turn(start), day)
        return let(F.aggregate(F.sequence(F.lit(1), F.lit(16)), turn(start), lambda p, _: F.when(one_digit(day(p)), p).otherwise(turn(p))), day)

    def by(forms: list, short: bool) -> Column:
        out = text
        for form, change in forms:  # the last that parses holds
            when = F.try_to_date(plain, form)
            age = F.datediff(when, first)
            out = F.when(when.isNotNull() & (age >= 0) & (age < days), F.replace(F.date_format(change(when, short), form), F.lit("-"), mark)).otherwise(F.when(when.isNotNull(), text).otherwise(out))
        return out

    padded = by([("MM-dd-yyyy", month_first), ("dd-MM-yyyy", any_day), ("yyyy-MM-dd", any_day)], False)
    return F.when(text.rlike("(?<![0-9])[0-9](?![0-9])"), by([("M-d-yyyy", month_first), ("d-M-yyyy", any_day)], True)).otherwise(padded)


def _ssn(text: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.regexp_extract(text, r"^(\d+)-(\d+)-(\d+)$", i).cast("int") for i in (1, 2, 3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    back = lambda v: F.when(v > 664, v + 2).otherwise(v + 1)
    new = let(permute(F.array(index, group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key, undo), lambda p: F.format_string("%03d-%02d-%04d", back(p[0]), p[1] + 1, p[2] + 1))
    return F.when(valid, new).otherwise(text)


def _mailbox(name: Column, key: str, undo: bool) -> Column:
    """ASCII names over letters and digits, others over more letters, again until a letter beyond ASCII comes out."""
    wide = lambda t: permute_text(t, "letters", "email", key, undo)
    other = F.aggregate(F.sequence(F.lit(1), F.lit(16)), wide(name), lambda t, _: F.when(t.rlike(r"[^\x00-\x7F]"), t).otherwise(wide(t)))
    return F.when(name.rlike(r"[^\x00-\x7F]"), other).otherwise(permute_text(name, "base36", "email", key, undo))


def _ipv4(text: Column, key: str, undo: bool) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    new = let(parts, lambda p: F.array_join(F.transform(permute(p, F.array(*[F.lit(256)] * 4), "ipv4", key, undo), lambda x: x.cast("string")), "."))
    return F.when(F.forall(parts, lambda x: x < 256), new).otherwise(text)


def _after(text: Column, prefix: str, alphabet, kind: str, key: str, undo: bool) -> Column:
    """Permutes what follows the longest match of prefix at the start."""
    return let(F.regexp_extract(text, prefix, 0), lambda head: F.concat(head, permute_text(F.substring(text, F.length(head) + 1, F.length(text)), alphabet, kind, key, undo)))


def pseudonym(value: Column, key: str = KEY, undo: bool = False) -> Column:
    """The pseudonym of a found value, or (undo) the value of a pseudonym; unchanged if it isn't valid."""
    return _replaced(value, key, undo)["text"]


def _replaced(value: Column, key: str, undo: bool) -> Column:
    """text: the pseudonym of a found value; n: the number of values in it that changed."""
    is_ = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    name = F.substring_index(value, "@", 1)
    label = f"^(?:{LABEL}|{BEARER}|{USER}|{FORGE})"
    secret = (
        F.when(value.startswith("AKIA"), _after(value, "^AKIA", "upper36", "key", key, undo))
        .when(value.rlike(f"{label}[0-9a-f]+$|^[0-9a-f]+$"), _after(value, f"(?:{label})?", "hex", "secret", key, undo))
        .otherwise(_after(value, label, "base62", "secret", key, undo))
    )
    single = (
        F.when(is_("email"), F.concat(_mailbox(F.lower(name), key, undo), F.substring(value, F.length(name) + 1, F.length(value))))
        .when(is_("secret") | value.rlike(f"^{USER}"), secret)
        .when(is_("iban"), _iban(value, key, undo))
        .when(is_("phone"), _after(value, PHONE_HEAD, "digit", "phone", key, undo))
        .when(is_("date"), _date(value, key, undo))
        .when(is_("ssn"), _ssn(value, key, undo))
        .when(is_("ipv6"), permute_text(F.lower(value), "hex", "ipv6", key, undo))
        .when(is_("ipv4"), _ipv4(value, key, undo))
        .otherwise(value)
    )
    one = let(single, lambda new: F.struct(new.alias("text"), F.when(new != value, 1).otherwise(0).alias("n")))
    first = [k for k in PATTERNS if k != "card"]
    return F.when(is_("card") & ~F.coalesce(value.rlike("^(?:" + "|".join(PATTERNS[k] for k in first) + ")$"), F.lit(False)), _cards(value, key, undo)).otherwise(one)


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with text replaced and n_pii, the number of replaced values."""
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    between = F.split("text", ANY, -1)
    new = F.transform(found, lambda m: F.when(F.length(m) > 0, _replaced(m, key, False)))
    joined = let(new, lambda x: F.struct(
        F.array_join(F.zip_with(between, x, lambda a, b: F.concat(a, F.coalesce(b["text"], F.lit("")))), "").alias("text"),
        F.aggregate(x, F.lit(0).cast("long"), lambda n, b: n + F.coalesce(b["n"], F.lit(0))).alias("n"),
    ))
    # Every pattern needs one of these characters.
    plain = F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("n"))
    kept = [c for c in docs.columns if c != "n_pii"]
    done = "pii"
    while done in docs.columns:
        done += "_"
    rows = docs.withColumn(done, F.when(F.col("text").rlike("[0-9@=:]"), joined).otherwise(plain))
    return rows.select(*[F.col(f"{done}.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in kept], F.col(f"{done}.n").alias("n_pii"))
