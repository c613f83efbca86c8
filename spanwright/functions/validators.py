"""Checksums and structure of personal numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(digits: Column) -> Column:
    """valid, checksum or malformed (not 2 to 19 digits)."""
    return F.when(~digits.rlike("^[0-9]{2,19}$"), "malformed").when(F.call_function("luhn_check", digits), "valid").otherwise("checksum")


def mod97(text: Column) -> Column:
    """Remainder of the digits of an IBAN, rearranged, letters counting from 10; folded so that nothing overflows."""
    moved = F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    value = lambda c: (F.call_function("locate", c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1).cast("int")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97))


def iban(text: Column) -> Column:
    return F.when(~text.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), "malformed").when(mod97(text) == 1, "valid").otherwise("checksum")


def ssn(digits: Column) -> Column:
    """Whether nine digits can be an allocated number."""
    area, group, serial = F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4)
    bad = area.isin("000", "666") | area.startswith("9") | (group == "00") | (serial == "0000")
    return F.when(~digits.rlike("^[0-9]{9}$"), "malformed").when(bad, "unallocated").otherwise("valid")


def card_brand(digits: Column) -> Column:
    head = F.substring(digits, 1, 2).cast("int")
    return F.when(digits.startswith("4"), "visa").when(head.between(51, 55), "mastercard").when(head.isin(34, 37), "amex").otherwise("other")
