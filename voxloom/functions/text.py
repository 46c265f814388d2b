"""String columns: names, lists, URIs, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def case_id(name: Column) -> Column:
    return F.translate(name, "- ", "__")


def file_name(name: Column) -> Column:
    return F.translate(F.lower(name), "- ", "__")


def list_items(text: Column) -> Column:
    """"[a, b]" as an array of trimmed items."""
    return F.transform(F.split(F.regexp_replace(text, r"^\[|\]$", ""), ","), lambda x: F.trim(x))


def without_scheme(path: Column) -> Column:
    return F.regexp_replace(path, "^local://", "")


def _part(uri: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(uri, pattern, 1), F.lit(""))


def tomogram_uri(uri: Column) -> Column:
    """type@spacing as (tomo_type, voxel_spacing); an error if malformed."""
    ok = uri.rlike(r"^[^@]+@[0-9]+(\.[0-9]+)?$")
    parsed = F.struct(_part(uri, "^([^@]+)@").alias("tomo_type"), _part(uri, "@(.+)$").try_cast("double").alias("voxel_spacing"))
    return F.when(ok, parsed).otherwise(F.raise_error(F.concat(F.lit("malformed tomogram URI: "), uri)))


def segmentation_uri(uri: Column) -> Column:
    """name[:user[/session]][@spacing] as a struct; a part left out is null and stands for any."""
    return F.struct(
        _part(uri, "^([^:@]+)").alias("name"),
        _part(uri, "^[^:@]+:([^/@]+)").alias("user_id"),
        _part(uri, "^[^:@]+:[^/@]+/([^@]+)").alias("session_id"),
        _part(uri, "@(.+)$").try_cast("double").alias("voxel_spacing"),
    )


def target(text: Column) -> Column:
    """name or name,user,session as an array of three; an error for another number of parts."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    three = F.array(F.get(parts, 0), F.get(parts, 1), F.get(parts, 2))
    return F.when(F.size(parts).isin(1, 3), three).otherwise(F.raise_error(F.concat(F.lit("a target has one or three parts: "), text)))


def output_name(base: Column, low_pass: Column, high_pass: Column, override: Column) -> Column:
    """base-lp{}A-hp{}A, cutoffs rounded half to even, a side with cutoff 0 left out; the override wins."""
    side = lambda name, f: F.when(f > 0, F.concat(F.lit(f"-{name}"), F.bround(f, 0).cast("long").cast("string"), F.lit("A"))).otherwise("")
    return F.coalesce(override, F.concat(base, side("lp", low_pass), side("hp", high_pass)))


def filter_problem(apix: Column, low_pass: Column, high_pass: Column) -> Column:
    """What is wrong with a filter's cutoffs in angstrom, or null: none is set, one is finer than two pixels, or the
    high-pass isn't above the low-pass."""
    return (
        F.when((low_pass == 0) & (high_pass == 0), "no cutoff")
        .when((low_pass > 0) & (low_pass < 2 * apix), "low-pass beyond Nyquist")
        .when((high_pass > 0) & (high_pass < 2 * apix), "high-pass beyond Nyquist")
        .when((low_pass > 0) & (high_pass > 0) & (high_pass <= low_pass), "empty band")
    )


def cache_key(source: Column, box: list[Column], spacing: Column, background: Column, kind: Column) -> Column:
    """{source}_{d}x{h}x{w}_{spacing}[_with_bg].{kind}"""
    shape = F.concat_ws("x", *[b.cast("string") for b in box])
    return F.concat(source, F.lit("_"), shape, F.lit("_"), spacing.cast("string"), F.when(background, "_with_bg").otherwise(""), F.lit("."), kind)


def rescaled(n: Column, spacing: Column, to: Column) -> Column:
    """A dimension after rescaling, half to even, made even; an error for a finer spacing."""
    size = F.bround(n * spacing / to, 0).cast("int")
    return F.when(to >= spacing, size - size % 2).otherwise(F.raise_error(F.lit("only coarser spacings")))


def nanometres(angstrom: Column) -> Column:
    """A spacing in the unit that image headers take."""
    return angstrom / 10.0
