"""Small string helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: predicates that hold one value where nothing is declared
FALLBACK_SINGLE = (
    "title owner lead driver source part_of do_on valid_until estimate_hours created_at updated_at name body created_by "
    "committed outcome abandoned superseded_by merged_into session_of start_time end_time clockify_id"
).split()


def slugify(c: Column) -> Column:
    """Lower case, other characters than letters and digits as one _, none at the ends, 60 characters at most; else untitled."""
    base = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.regexp_replace(F.substring(base, 1, 60), "_+$", "")
    return F.when(cut == "", "untitled").otherwise(cut)


def split_kv(c: Column) -> Column:
    """The first word and what follows it, of a trimmed line."""
    line = F.regexp_replace(c, r"^\s+|\s+$", "")
    both = line.rlike(r"^\S+\s+.*$")
    part = lambda k: F.regexp_extract(line, r"^(\S+)\s+(.*)$", k)
    return F.struct(F.when(both, part(1)).otherwise(line).alias("k"), F.when(both, part(2)).otherwise("").alias("v"))


def split_comma(c: Column) -> Column:
    return F.array_remove(F.transform(F.split(c, ","), lambda x: F.trim(x)), "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def dashed_id(c: Column) -> Column:
    """Digits yyyymmddhhmmss as yyyy-mm-dd-hhmmss."""
    return F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2), F.substring(c, 9, 6))


def repeated(c: Column, times: Column) -> Column:
    return F.repeat(c, F.greatest(times, F.lit(0)).cast("int"))


def index_of(c: Column, part: Column) -> Column:
    """Where part first stands, counted from 0; null if nowhere."""
    at = F.position(part, c)
    return F.when(at > 0, at - 1)


def is_iso_datetime(c: Column, seconds: bool = True) -> Column:
    """yyyy-mm-ddThh:mm, with :ss if seconds."""
    return c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}" + (r":\d{2}" if seconds else "") + r"\z")


def strip_at(c: Column) -> Column:
    return F.regexp_replace(c, "^@", "")


def is_reference(c: Column) -> Column:
    """An at sign and a name without white space."""
    return c.rlike(r"^@[^\t\n\x0b\f\r ]+\z")


def as_reference(c: Column, value_kind: Column) -> Column:
    """The value of a predicate of the kind ref with its at sign; what has white space or is empty stays."""
    bare = (value_kind == "ref") & ~F.startswith(c, F.lit("@")) & ~c.rlike(r"[\t\n\x0b\f\r ]") & (F.trim(c) != "")
    return F.when(bare, F.concat(F.lit("@"), c)).otherwise(c)


def is_single(predicate: Column, declared: Column, configured: Column) -> Column:
    """Whether a predicate holds one value: as declared (single, multi or null), else if configured or by its name."""
    by_name = predicate.isin(FALLBACK_SINGLE) | F.startswith(predicate, F.lit("emoji_"))
    return F.when(declared.isNotNull(), declared == "single").otherwise(configured | by_name)


def encoded_lease(holder: Column, expires: Column, epoch: Column) -> Column:
    return F.concat_ws("|", holder, expires.cast("string"), epoch.cast("string"))


def decoded_lease(c: Column) -> Column:
    """holder, expires, epoch of holder|number|number; null for anything else."""
    parts = F.split(c, r"\|", -1)
    expires, epoch = F.get(parts, F.lit(1)).try_cast("bigint"), F.get(parts, F.lit(2)).try_cast("bigint")
    return F.when((F.size(parts) == 3) & expires.isNotNull() & epoch.isNotNull(), F.struct(F.get(parts, F.lit(0)).alias("holder"), expires.alias("expires"), epoch.alias("epoch")))
