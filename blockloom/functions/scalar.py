"""Scalar functions: sizes, units, ranges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bytes of each unit by its names (fixed values of the format).
UNITS = {
    ("b", "byte"): 1, ("s", "sector"): 512,
    ("k", "KiB", "kibibyte"): 1 << 10, ("m", "MiB", "mebibyte"): 1 << 20, ("g", "GiB", "gibibyte"): 1 << 30,
    ("t", "TiB", "tebibyte"): 1 << 40, ("p", "PiB", "pebibyte"): 1 << 50, ("e", "EiB", "exbibyte"): 1 << 60,
    ("K", "kB", "kilobyte"): 10**3, ("M", "MB", "megabyte"): 10**6, ("G", "GB", "gigabyte"): 10**9,
    ("T", "TB", "terabyte"): 10**12, ("P", "PB", "petabyte"): 10**15, ("E", "EB", "exabyte"): 10**18,
}
#: Labels of printed sizes, as they are spelled (fixed values of the format).
LABELS = ["b", "KiB", "MiB", "GiB", "Tib", "PiB", "EiB"]
MOST = (1 << 64) - 1


def unit_bytes(unit: Column) -> Column:
    """Bytes of a unit's name as DECIMAL(20,0); null for no unit known."""
    out = F.lit(None).cast("decimal(20,0)")
    for names, n in UNITS.items():
        out = F.when(unit.isin(*names), F.lit(str(n)).cast("decimal(20,0)")).otherwise(out)
    return out


def parse_size(text: Column) -> Column:
    """Bytes of '<number><unit>' as DECIMAL(38,0); sectors without a unit; null if malformed or over 64 bits."""
    digits = F.regexp_extract(text, r"^0*([0-9]{1,20})([A-Za-z]*)$", 1)
    unit = F.regexp_extract(text, r"^0*([0-9]{1,20})([A-Za-z]*)$", 2)
    n, one = F.when(digits != "", digits.cast("decimal(20,0)")), unit_bytes(F.when(unit == "", F.lit("s")).otherwise(unit))
    most = F.lit(str(MOST)).cast("decimal(20,0)")
    # Compared by division first: the product itself may be too long.
    return F.when(n <= F.floor(most / one), (n * one).cast("decimal(38,0)"))


def pretty_size(n: Column) -> Column:
    """A size in the unit in which it is at most 8192, rounded half up where the unit is stepped up."""
    out = None
    for i in range(len(LABELS)):
        # Unit i holds sizes of 2^(10 (i + 1)) up to 2^(10 (i + 2)), the first also those below.
        here = F.shiftright(n, 10 * i) if i else n
        text = F.concat(here.cast("string"), F.lit(LABELS[i]))
        if i + 1 < len(LABELS):
            up = F.floor(here / 1024.0 + 0.5).cast("string")
            text = F.when(here > 8192, F.concat(up, F.lit(LABELS[i + 1]))).otherwise(text)
            limit = (1 << 10 * (i + 2)) if 10 * (i + 2) < 63 else None
        else:
            limit = None
        if out is None:
            out = F.when(n < limit, text)
        elif limit is None:
            return out.otherwise(text)
        else:
            out = out.when(n < limit, text)
    return out


def to_unit(n: Column, unit: str) -> Column:
    """Bytes in a unit as DOUBLE."""
    size = next((v for names, v in UNITS.items() if unit in names), None)
    if size is None:
        raise ValueError("Invalid unit specifier")
    return n.cast("double") / F.lit(float(size))


def format_units(value: Column) -> Column:
    """Whole numbers bare, others of 1 or more with two decimals."""
    whole = value == F.floor(value)
    return F.when(whole, F.floor(value).cast("string")).when(value >= 1, F.format_string("%.2f", value)).otherwise(value.cast("string"))


def div_up(a: Column, b: Column) -> Column:
    return F.call_function("div", a + b - 1, b)


def thin_metadata_bytes(pool_bytes: Column, block_bytes: Column, max_thins: Column) -> Column:
    """Bytes of metadata a pool needs: one block, leaves of 126 mappings, one block for each volume."""
    n = F.call_function("div", pool_bytes, block_bytes)
    return F.least(F.lit(1) + div_up(n, F.lit(126)) + max_thins, F.lit(4161600)) * 4096


def cache_metadata_bytes(device_bytes: Column, block_bytes: Column, hint_bytes: int = 4) -> Column:
    """Bytes of metadata a cache needs: 4 MiB, 16 for each mapping, a hint and 8 for each."""
    n = div_up(device_bytes, block_bytes)
    return F.least(F.lit(4 << 20) + n * 16 + n * (hint_bytes + 8), F.lit(4161600 * 4096))


def parse_range(text: Column) -> Column:
    """Struct (begin, end) of 'a..b'; null if malformed, over 64 bits or b <= a. Ends of 2^63 or more, which LONG cannot hold, raise."""
    p = r"^0*([0-9]{1,20})\.\.0*([0-9]{1,20})$"
    a, b = (F.when(text.rlike(p), F.regexp_extract(text, p, k).cast("decimal(20,0)")) for k in (1, 2))
    long = lambda x: F.when(x < F.lit(str(1 << 63)).cast("decimal(20,0)"), x.cast("long")).otherwise(F.raise_error(F.lit("number of 2^63 or more")).cast("long"))
    return F.when((b > a) & (b <= F.lit(str(MOST)).cast("decimal(20,0)")), F.struct(long(a).alias("begin"), long(b).alias("end")))
