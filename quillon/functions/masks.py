"""Masks: what a sensitive value is replaced by. Each is a function from columns to a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import mask_date

Mask = Callable[..., Column]


def _stars(n: Column, char: str = "*") -> Column:
    return F.repeat(F.lit(char), F.greatest(n, F.lit(0)))


def mask(value: Column, char: str = "*", n: int | None = None, from_end: bool = False) -> Column:
    """All of up to four characters, else n of them (by default all but four) from one end."""
    size = F.length(value)
    hidden = F.least(F.lit(n) if n is not None else size - 4, size)
    part = F.concat(F.left(value, size - hidden), _stars(hidden, char)) if from_end else F.concat(_stars(hidden, char), F.right(value, size - hidden))
    return F.when(size <= 4, _stars(size, char)).otherwise(part)


def keep_ends(value: Column, start: int, end: int, char: str = "*", strict: bool = False) -> Column:
    """All but the first and last characters. A value with no character between stays as it is, or, if strict, is hidden."""
    size = F.length(value)
    short = _stars(size, char) if strict else value
    return F.when(size <= start + end, short).otherwise(F.concat(F.left(value, F.lit(start)), _stars(size - start - end, char), F.right(value, F.lit(end))))


def mask_email(value: Column, char: str = "*") -> Column:
    """The first character and the domain stay."""
    user, domain = F.substring_index(value, "@", 1), F.substr(value, F.instr(value, "@") + 1)
    hidden = F.when(user == "", F.lit(char)).otherwise(F.concat(F.left(user, F.lit(1)), _stars(F.greatest(F.length(user) - 1, F.lit(1)), char)))
    return F.concat(hidden, F.lit("@"), domain)


def replace(value: Column, kind: Column | None = None, new: str | None = None) -> Column:
    """A fixed text, or the type in brackets."""
    return F.lit(new) if new is not None else F.concat(F.lit("["), kind, F.lit("]"))


def redact(value: Column) -> Column:
    return F.lit("")


def hashed(value: Column, how: str = "md5") -> Column:
    """The first 8 hexadecimal digits of the MD5, or 16 of the SHA-256."""
    return F.left(F.sha2(value, 256), F.lit(16)) if how == "sha256" else F.left(F.md5(value), F.lit(8))


def encrypt(value: Column, key: str = "default_key") -> Column:
    """Bytes of an ASCII value xor the key's, base64, cut at 16 characters: a one-way token. Other values are refused with null."""
    codes = F.array(*[F.lit(ord(c)) for c in key])
    mixed = F.transform(F.split(value, ""), lambda c, i: F.lpad(F.hex(F.ascii(c).bitwiseXOR(F.element_at(codes, F.pmod(i, F.lit(len(key))) + 1))), 2, "0"))
    return F.when(value.rlike(r"^[\x00-\x7F]+$"), F.concat(F.left(F.base64(F.unhex(F.array_join(mixed, ""))), F.lit(16)), F.lit("...")))


def mask_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\p{Nd}", "*")


def mask_digits_keep_year(value: Column) -> Column:
    """Every digit but those of a date's year."""
    # years are set apart by a mark that no text has, then all other digits go
    set_apart = F.regexp_replace(value, r"(?<![0-9])([12][0-9])([0-9]{2})(?=[-/年])", "\uE000$1\uE001$2")
    hidden = F.regexp_replace(set_apart, r"(?<!\uE000)(?<!\uE000[0-9])(?<!\uE001)(?<!\uE001[0-9])[0-9]", "*")
    return F.translate(hidden, "\uE000\uE001", "")


def mask_identifier(value: Column) -> Column:
    """All but white space."""
    return F.regexp_replace(value, r"(?U)\S", "*")


def mask_typed(kind: Column, value: Column) -> Column:
    """The mask of each format: identity numbers keep 6 + 4 characters, mobile numbers 3 + 4, credit codes 8 + 2, cards 4 + 4."""
    size = F.length(value)
    all_ = _stars(size)
    return (
        F.when((kind == "CN_ID_CARD") & (size >= 10), keep_ends(value, 6, 4))
        .when((kind == "CN_PHONE") & (size == 11), keep_ends(value, 3, 4))
        .when((kind == "CN_CREDIT_CODE") & (size >= 10), keep_ends(value, 8, 2))
        .when((kind == "CN_BANK_CARD") & (size >= 8), keep_ends(value, 4, 4))
        .when((kind == "EMAIL_ADDRESS") & F.contains(value, F.lit("@")), mask_email(value))
        .when(kind == "AMOUNT", "[金额]")
        .when(kind == "DATE", mask_date(value))
        .otherwise(all_)
    )


def mask_default(kind: Column, value: Column) -> Column:
    """What a type is replaced by if nothing else is asked for."""
    return (
        F.when(kind == "PERSON", "[姓名]")
        .when(kind.isin("ORGANIZATION", "COMPANY", "BANK_NAME", "ACCOUNT_NAME", "ALIAS", "PROJECT"), "[机构]")
        .when(kind.isin("LOCATION", "ADDRESS"), "[地址]")
        .when(kind.isin("GOVERNMENT", "COURT"), "[政府机构]")
        .when(kind.isin("CONTRACT_NO", "CASE_NO"), mask_identifier(value))
        .otherwise(mask(value))
    )


def person_alias(name: Column) -> Column:
    """The family name and 某; of names of three and more characters the last stays too; 某 alone for one or none."""
    plain = F.regexp_replace(name, r"(?U)\s+", "")
    first = F.concat(F.left(plain, F.lit(1)), F.lit("某"))
    return F.when(F.length(plain) <= 1, "某").when(F.length(plain) == 2, first).otherwise(F.concat(first, F.right(plain, F.lit(1))))


def company_alias(name: Column) -> Column:
    """The second letter, digit or ideograph hidden; a lone one, or a name without any, is followed by 某."""
    plain = F.regexp_replace(name, r"(?U)\s+", "")
    seen, other = "[一-鿿A-Za-z0-9]", "[^一-鿿A-Za-z0-9]"
    two = f"^({other}*{seen}{other}*){seen}"
    return (
        F.when(plain == "", "").when(plain.rlike(two), F.regexp_replace(plain, two, "$1某"))
        .when(plain.rlike(seen), F.regexp_replace(plain, f"^({other}*{seen})", "$1某")).otherwise(F.concat(plain, F.lit("某")))
    )


REGISTRY: dict[str, Mask] = {
    "mask": mask, "keep_ends": keep_ends, "email": mask_email, "replace": replace, "redact": redact, "hash": hashed, "encrypt": encrypt,
    "digits": mask_digits, "digits_keep_year": mask_digits_keep_year, "identifier": mask_identifier,
}


def register(name: str, function: Mask) -> None:
    REGISTRY[name] = function
