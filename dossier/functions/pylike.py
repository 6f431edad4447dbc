"""Column functions that agree with Python's built-ins where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(x: Column, digits: int) -> Column:
    """round() of the exact binary value, ties to even."""
    return F.regexp_replace(F.format_number(x, digits), ",", "").cast("double") + F.lit(0.0)


def py_str(x: Column) -> Column:
    """str() of a double; null reads None."""
    text = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    mantissa, power = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.substring_index(text, "E", -1)
    science = F.concat(mantissa, F.when(power.startswith("-"), "e-").otherwise("e+"), F.lpad(F.replace(power, F.lit("-"), F.lit("")), 2, "0"))
    # Longer exponents than two digits aren't padded, nor cut.
    science = F.when(F.length(F.replace(power, F.lit("-"), F.lit(""))) > 2, F.concat(mantissa, F.when(power.startswith("-"), "e").otherwise("e+"), power)).otherwise(science)
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    usual = (F.abs(x) >= 1e-4) & (F.abs(x) < 1e16)
    return F.when(x.isNull(), "None").otherwise(F.coalesce(odd, F.when(~text.contains("E"), text).when(usual, plain).otherwise(science)))


def strip(x: Column) -> Column:
    """strip() of Unicode white space."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def falsy(x: Column, default: str) -> Column:
    """x, or the default where x is null or empty."""
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit(default))


def hash_id(*parts: Column | str) -> Column:
    """16 hex digits of the SHA-256 of the parts joined by colons; a null part reads None."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(":", *cols), 256), 1, 16)


def pad_cik(cik: Column) -> Column:
    """Zeros on the left up to ten characters; longer ones stay whole."""
    text = cik.cast("string")
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    from dossier.functions.fixed import ARCHIVE_URL

    short = F.regexp_replace(pad_cik(cik), "^0+", "")
    return F.concat_ws("/", F.lit(ARCHIVE_URL), F.when(short == "", "0").otherwise(short), F.replace(accession, F.lit("-"), F.lit("")), document)


def archive_path(accession: Column, day: Column, document: Column) -> Column:
    """Relative place of a raw document; null for names that would leave the archive."""
    unsafe = document.startswith("/") | document.rlike(r"(^|/)\.\.(/|$)") | (document == "")
    return F.when(~unsafe, F.concat_ws("/", F.lit("filing_document"), F.replace(accession, F.lit("-"), F.lit("")), F.date_format(day, "yyyy-MM-dd"), document))
