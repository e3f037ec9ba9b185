"""Text of numbers, identities and readings, as columns where plain expressions do, else as small Python helpers."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\x0c"


def trimmed(column: str) -> Column:
    return F.trim(F.col(column), F.lit(BLANKS))


def parsed_long(column: str) -> Column:
    """A whole trimmed text as a long, or null."""
    return F.when(trimmed(column).rlike(r"^-?[0-9]+$"), trimmed(column).try_cast("long"))


def parsed_u64(column: str) -> Column:
    value = F.when(trimmed(column).rlike(r"^[0-9]+$"), trimmed(column).try_cast("decimal(38,0)"))
    return F.when(value < F.lit(2**64).cast("decimal(38,0)"), value.cast("decimal(20,0)"))


def parsed_double(column: str) -> Column:
    return F.when(trimmed(column).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), trimmed(column).try_cast("double"))


def parsed_bool(column: str) -> Column:
    text = F.lower(trimmed(column))
    return F.when(text.isin("true", "1", "yes", "on"), True).when(text.isin("false", "0", "no", "off"), False)


def metric_id(family: str = "family", name: str = "name") -> Column:
    return F.concat_ws(":", family, name)


def link(link_id: str = "link_id", generation: str = "link_generation") -> Column:
    return F.concat(F.col(link_id), F.lit("/gen"), F.col(generation).cast("string"))


def source(source_id: str = "source_id", incarnation: str = "source_incarnation") -> Column:
    return F.concat(F.col(source_id), F.lit("@"), F.col(incarnation).cast("string"))


def lane(column: str = "lane") -> Column:
    return F.coalesce(F.concat(F.lit("lane"), F.col(column).cast("string")), F.lit("aggregate"))


def split_link(column: str) -> tuple[Column, Column]:
    """(id, generation) of ``id/genN``; a text without suffix is generation 1."""
    g = F.regexp_extract(column, r"^(.*)/gen([0-9]+)$", 2)
    return F.when(g == "", F.col(column)).otherwise(F.regexp_extract(column, r"^(.*)/gen([0-9]+)$", 1)), F.when(g == "", F.lit(1)).otherwise(g.try_cast("long")).cast("long")


def split_source(column: str) -> tuple[Column, Column]:
    """(id, incarnation) of ``id@N``; a text without suffix is incarnation 1."""
    g = F.regexp_extract(column, r"^(.*)@([0-9]+)$", 2)
    return F.when(g == "", F.col(column)).otherwise(F.regexp_extract(column, r"^(.*)@([0-9]+)$", 1)), F.when(g == "", F.lit(1)).otherwise(g.try_cast("long")).cast("long")


def number(value: float) -> str:
    """Shortest text that reads back as ``value``: fixed or scientific, whichever is shorter, fixed on ties.

    A text without point or exponent gets ``.0``; infinities and NaN are inf, -inf and nan.
    """
    if math.isnan(value):
        return "nan"
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    sign = "-" if math.copysign(1.0, value) < 0 else ""
    digits, exponent = re.fullmatch(r"(\d(?:\.\d+)?)e([+-]\d+)", f"{abs(value):.17e}" if value == 0 else _shortest(abs(value))).groups()
    digits, e = digits.replace(".", "").rstrip("0") or "0", int(exponent)
    if e >= len(digits) - 1:
        fixed = digits + "0" * (e - len(digits) + 1)
    else:
        fixed = f"{digits[: e + 1]}.{digits[e + 1 :]}" if e >= 0 else "0." + "0" * (-e - 1) + digits
    science = f"{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{'-' if e < 0 else '+'}{abs(e):02d}"
    out = fixed if len(fixed) <= len(science) else science
    return sign + (out if "." in out or "e" in out else out + ".0")


def _shortest(value: float) -> str:
    for p in range(17):
        if float(out := f"{value:.{p}e}") == value:
            return out
    return f"{value:.17e}"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def short_double(column: str | Column) -> Column:
    """Text of a double as ``number`` writes it, from the digits and the exponent of Spark's own text."""
    value = F.col(column) if isinstance(column, str) else column

    def cut(plain: Column) -> Column:
        mantissa, exponent = F.substring_index(plain, "E", 1), F.when(F.contains(plain, F.lit("E")), F.substring_index(plain, "E", -1)).otherwise("0")
        return F.struct(F.substring_index(mantissa, ".", 1).alias("whole"), F.substring_index(mantissa, ".", -1).alias("rest"), exponent.cast("int").alias("power"))

    def scaled(p: Column) -> Column:
        whole, rest = p["whole"], p["rest"]
        digits = F.rtrim(F.ltrim(F.concat(whole, rest), F.lit("0")), F.lit("0"))
        zeros = F.length(rest) - F.length(F.ltrim(rest, F.lit("0")))
        e = p["power"] + F.when(whole != "0", F.length(whole) - 1).otherwise(-zeros - 1)
        return F.struct(digits.alias("digits"), e.alias("e"), F.length(digits).alias("n"))

    def both(p: Column) -> Column:
        digits, e, n = p["digits"], p["e"], p["n"]
        fixed = (
            F.when(e >= n - 1, F.concat(digits, F.repeat(F.lit("0"), e - n + 1)))
            .when(e >= 0, F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
        )
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
        size = F.abs(e).cast("string")
        size = F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size)
        science = F.concat(F.substring(digits, F.lit(1), F.lit(1)), tail, F.when(e < 0, "e-").otherwise("e+"), size)
        return F.struct(F.when(n == 0, "0.0").otherwise(fixed).alias("fixed"), F.when(n == 0, "0.0e+00").otherwise(science).alias("science"))

    def shorter(p: Column) -> Column:
        return F.when(F.length(p["fixed"]) <= F.length(p["science"]), p["fixed"]).otherwise(p["science"])

    def pointed(short: Column) -> Column:
        return F.when(short.rlike("[.e]"), short).otherwise(F.concat(short, F.lit(".0")))

    finite = _let(_let(_let(_let(_let(F.abs(value).cast("string"), cut), scaled), both), shorter), pointed)
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, F.lower(F.replace(value.cast("string"), F.lit("Infinity"), F.lit("inf")))).otherwise(F.when(value.isNotNull(), F.concat(sign, finite)))


def split_metric(column: str) -> tuple[Column, Column]:
    """(family, name) of ``family:name``; both null if the text isn't one."""
    fits = F.col(column).rlike(r"^[a-z-]+:[a-z0-9_-]+(\.[a-z0-9_-]+)*$")
    return F.when(fits, F.substring_index(column, ":", 1)), F.when(fits, F.regexp_extract(column, ":(.*)$", 1))


def known(column: str, names: tuple[str, ...]) -> Column:
    """The name of an enumeration that a text stands for, blanks and case aside, or null."""
    plain = F.lower(trimmed(column))
    out = F.lit(None).cast("string")
    for name in names:
        out = F.when(plain == name.lower(), name).otherwise(out)
    return out


def fnv1a64(column: str) -> Column:
    """The 64-bit FNV-1a hash of a text's bytes, as 16 hexadecimal digits."""
    # fixed values: offset basis and prime; decimals hold what a long can't
    big = "decimal(38,0)"
    number = lambda x: F.lit(str(x)).cast(big)
    digits = F.hex(F.encode(column, "UTF-8"))
    bytes_ = F.filter(F.sequence(F.lit(0), F.length(digits).cast("int")), lambda i: i * 2 < F.length(digits))

    def mixed(h: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        low = F.pmod(h, number(256))
        return F.pmod((h - low + low.cast("int").bitwiseXOR(byte).cast(big)).cast("decimal(20,0)") * F.lit("1099511628211").cast("decimal(17,0)"), number(2**64)).cast(big)

    h = F.aggregate(bytes_, number(14695981039346656037), mixed)
    low = F.pmod(h, number(2**32))
    high, low = ((h - low) / number(2**32)).cast("long"), low.cast("long")
    return F.lower(F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0")))


def crc32c(column: str) -> Column:
    """The CRC-32C of a text's bytes, as 8 hexadecimal digits."""
    digits = F.hex(F.encode(column, "UTF-8"))
    bytes_ = F.filter(F.sequence(F.lit(0), F.length(digits).cast("int")), lambda i: i * 2 < F.length(digits))
    # fixed value: the reflected polynomial
    bit = lambda c, _: F.when(c % 2 == 1, F.shiftright(c, 1).bitwiseXOR(F.lit(0x82F63B78).cast("long"))).otherwise(F.shiftright(c, 1))

    def byte(c: Column, i: Column) -> Column:
        own = F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), c.bitwiseXOR(own), bit)

    out = F.aggregate(bytes_, F.lit(0xFFFFFFFF).cast("long"), byte).bitwiseXOR(F.lit(0xFFFFFFFF).cast("long"))
    return F.lower(F.lpad(F.hex(out), 8, "0"))


def reading() -> Column:
    """Text of a gauge (``-3.0 dBm``) or counter (``15 count (u64) reset-declared``) reading."""
    gauge = F.concat_ws(" ", short_double("gauge_value"), "unit")
    counter = F.concat(
        F.col("counter_value").cast("string"), F.lit(" "), F.col("unit"), F.lit(" ("), F.coalesce("counter_width", F.lit("unspecified")), F.lit(")"),
        F.when(F.coalesce("reset_declared", F.lit(False)), " reset-declared").otherwise(""),
    )
    return F.when(F.col("semantics") == "gauge", gauge).when(F.col("semantics") == "counter", counter).otherwise("no-reading")


def record_line() -> Column:
    """A stored reading as one line: who, what, and named fields in a fixed order."""
    clock = F.concat(F.col("observed_ns").cast("string"), F.when(F.col("observed_synchronized"), "s").otherwise("u"))
    # fixed values: the names of the fields and their order
    fields = {
        "lane": lane(), "value": reading(), "observed": clock, "received": F.col("received_wall_ns"), "origin": F.col("origin"),
        "class": F.col("evidence_class"), "authority": F.col("authority"),
    }
    named = (F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in fields.items())
    return F.concat_ws(" ", F.lit("evidence"), link(), source(), F.concat(F.lit("seq="), F.col("sequence").cast("string")), metric_id(), *named)
