"""Hosts of URLs as browsers read them, inside the JVM.

Most URLs are normal already and are told by one pattern. Others go through the steps of the URL standard for http and
https: outer blanks and inner tabs and line ends go, any number of slashes or backslashes may follow the scheme, the last
@ ends the credentials, a port is a number up to 65,535, percent signs are decoded, names are made ASCII, characters that
no host may have are refused, and IPv4 and IPv6 addresses are written in their normal form.

Names outside ASCII are mapped by the JVM's own rules, which are those of 2003: they write a sharp s as ss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = "^https?://((?:[a-z0-9_-]+\\.)+[a-z][a-z0-9-]*)(?::[0-9]{1,4})?(?:[/?#]|$)"
# Characters that no domain may have.
_REFUSED = "[\\x00-\\x20#%/:<>?@\\[\\\\\\]^|\\x7F]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(part: Column) -> Column:
    """A part of an IPv4 address: decimal, octal after a zero, hexadecimal after 0x; null if it is none."""
    digits = lambda base, text: F.conv(F.when(text == "", "0").otherwise(text), base, 10)
    value = (
        F.when(part.rlike("^0[xX][0-9a-fA-F]*$"), digits(16, F.substr(part, F.lit(3))))
        .when(part.rlike("^0[0-7]+$"), digits(8, part))
        .when(part.rlike("^(?:0|[1-9][0-9]*)$"), digits(10, part))
    )
    return value.try_cast("decimal(20,0)")


def _ipv4(labels: Column) -> Column:
    """One to four numbers as an address: all but the last are bytes, the last fills what is left; null if they don't."""
    numbers, n = F.transform(labels, _number), F.size(labels)

    def address(values: Column) -> Column:
        last = F.element_at(values, -1)
        fits = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(F.slice(values, 1, n - 1), lambda v: v < 256) & (last < F.pow(F.lit(256), 5 - n))
        places = F.array(*[F.lit(256**k).cast("long") for k in (3, 2, 1)])
        high = F.aggregate(F.zip_with(F.slice(values, 1, n - 1), F.slice(places, 1, n - 1), lambda v, p: v.cast("long") * p), F.lit(0).cast("long"), lambda sum_, x: sum_ + x)
        whole = high + last.cast("long")
        octets = F.array(*[F.shiftright(whole, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
        return F.when(fits, F.array_join(octets, "."))

    return _let(numbers, address)


def _ipv6(text: Column) -> Column:
    """An address in brackets, with the first of its longest runs of zeros left out; null if it is none."""
    quad = F.regexp_extract(text, "(?:^|:)([0-9]{1,3}(?:\\.[0-9]{1,3}){3})$", 1)
    bytes_ = F.transform(F.split(quad, "\\."), lambda b: b.cast("int"))
    tail = F.concat_ws(":", *[F.lower(F.hex(F.get(bytes_, F.lit(k)) * 256 + F.get(bytes_, F.lit(k + 1)))) for k in (0, 2)])
    good = (quad == "") | (F.forall(bytes_, lambda b: b < 256) & ~quad.rlike("(?:^|\\.)0[0-9]"))
    plain = F.when(quad == "", text).otherwise(F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(quad)), tail))

    def expand(address: Column) -> Column:
        halves = F.split(address, "::", -1)
        words = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))
        left, right = words(F.get(halves, F.lit(0))), words(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        given = F.size(left) + F.size(right)
        filled = F.when(F.size(halves) == 2, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), right)).otherwise(left)
        fits = (F.size(halves) <= 2) & (F.size(filled) == 8) & F.when(F.size(halves) == 2, given <= 7).otherwise(True) & F.forall(filled, lambda w: w.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(good & fits, F.array_join(F.transform(filled, lambda w: F.lower(F.regexp_replace(w, "^0+(?=.)", ""))), ":"))

    def compress(full: Column) -> Column:
        short = F.lit(None).cast("string")
        for k in range(2, 9):  # the longest run is asked for first
            run = ":".join(["0"] * k)
            short = F.when(full.rlike(f"(?:^|:){run}(?::|$)"), F.regexp_replace(full, f"^(.*?)(?:^|:){run}(?::|$)(.*)$", "$1::$2")).otherwise(short)
        return F.concat(F.lit("["), F.coalesce(short, full), F.lit("]"))

    return _let(_let(plain, expand), lambda full: F.when(full.isNotNull(), _let(full, compress)))


def _domain(name: Column) -> Column:
    """A host that isn't in brackets, or null."""
    decoded = F.when(F.contains(name, F.lit("%")), F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)
    ascii_ = _let(decoded, lambda d: F.when(d.rlike("^[\\x00-\\x7F]*$"), F.lower(d)).otherwise(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), d))))

    def checked(host: Column) -> Column:
        labels = F.split(F.regexp_replace(host, "\\.$", ""), "\\.", -1)
        number = F.element_at(labels, -1).rlike("^(?:[0-9]+|0[xX][0-9a-fA-F]*)$")
        return F.when(host.rlike(_REFUSED) | (host == ""), F.lit(None).cast("string")).when(number, _ipv4(labels)).otherwise(host)

    return _let(ascii_, checked)


def _odd(url: Column) -> Column:
    clean = F.regexp_replace(url, "^[\\x00-\\x20]+|[\\x00-\\x20]+$|[\\t\\n\\r]+", "")
    authority = F.regexp_extract(clean, "(?is)^https?:[/\\\\]*([^/\\\\?#]*)", 1)
    place = F.regexp_extract(authority, "(?s)^(?:.*@)?(.*)$", 1)

    def host(place: Column) -> Column:
        port = F.regexp_extract(place, "(?s)^(?:\\[[^\\]]*\\]|[^:\\[\\]]*):([0-9]*)$", 1)
        fits = place.rlike("(?s)^(?:\\[[^\\]]*\\]|[^:\\[\\]]+)(?::[0-9]*)?$") & F.coalesce(port.try_cast("decimal(38,0)") <= 65_535, port == "")
        bracket = F.regexp_extract(place, "^\\[([0-9A-Fa-f:.]*)\\]", 1)
        name = F.regexp_extract(place, "(?s)^([^:\\[\\]]+)", 1)
        return F.when(fits & place.startswith("["), _ipv6(bracket)).when(fits, _domain(name))

    return _let(place, host)


def host(url: Column) -> Column:
    """Host of an http or https URL in its normal form, without port and user; null for anything else."""
    return F.when(url.rlike(_NORMAL), F.regexp_extract(url, _NORMAL, 1)).when(url.rlike("(?i)h[\\t\\n\\r]*t[\\t\\n\\r]*t[\\t\\n\\r]*p"), _odd(url))
