"""Scalar expressions: slices, pixels, verdicts, small statistics. All are built-in functions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % critical values of Student's t for 1 to 10 degrees of freedom (fixed values); 2.0 beyond.
T_CRITICAL = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228)


def t_critical(n: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, T_CRITICAL)), (n - 2).cast("int")), F.lit(2.0))


def resolve(index: int | None, count: Column, default: Column) -> Column:
    """A slice bound as a position: negative ones count from the end, none is the default."""
    if index is None:
        return default
    return F.greatest(count + index, F.lit(0)) if index < 0 else F.lit(index)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def ordered_name(position: Column, path: Column) -> Column:
    """At least four digits and the lower-cased suffix."""
    return F.format_string("%04d%s", position, suffix(path))


def core_count(name: Column) -> Column:
    found = F.regexp_extract(name, r"(\d+)c", 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no core count in "), name)).cast("int")).otherwise(found.cast("int"))


def flag(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1"), F.lit(False))


def gray(b: Column, g: Column, r: Column) -> Column:
    """0.114 b + 0.587 g + 0.299 r, rounded, in the usual 14-bit fixed point."""
    return F.shiftright((b * 1868 + g * 9617 + r * 4899 + 8192).cast("int"), 14)


def blend(a: Column, b: Column, has_a: Column, has_b: Column) -> Column:
    """Mean cut to an integer where both frames have a pixel, the one there is where one has, else 0."""
    return F.when(has_a & has_b, F.floor((a + b) / 2)).when(has_a, a).when(has_b, b).otherwise(F.lit(0))


def psnr(mse: Column) -> Column:
    return F.when(mse > 0, 10 * F.log10(F.lit(255.0 * 255.0) / mse))


def pixel_verdict(largest: Column, psnr_db: Column) -> Column:
    return F.when(largest == 0, "Bit-identical").when(largest <= 1, "Numerically equivalent").when(psnr_db > 40, "Visually identical").otherwise("Different")


def window_verdict(passing: Column, anchored: Column) -> Column:
    return F.when(passing == 0, "EMPTY").when(anchored, "CONNECTED").otherwise("PARTIAL")
