"""Scalar text functions with the semantics of whole Unicode, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no evidence, in English and French.
STOP_WORDS = sorted(
    set("a an and are at by can do does for how in is of on or the to was were what which with".split())
    | set("avec comment dans de des du est la le les pour que quel quelle quelles quels qui sont un une".split())
)


#: White space of any script, as strip_ws() has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_ws(x: Column) -> Column:
    """x without white space (of any script) at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def tokens_ws(x: Column) -> Column:
    """array<string>: what stands between runs of white space; no empty strings."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def collapse_ws(x: Column) -> Column:
    """x with each run of white space as one space, and none at its ends."""
    return F.array_join(tokens_ws(x), " ")


def first_filled(*xs: Column) -> Column:
    """The first of xs that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))


def terms(x: Column) -> Column:
    """array<string>: runs of letters, digits and underscores."""
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./\\]+)$", 1)


def content_hash(*xs: Column) -> Column:
    """SHA-256 of the first filled of xs."""
    return F.sha2(first_filled(*xs), 256)


_NAMESPACES = {"dns": "6ba7b8109dad11d180b400c04fd430c8", "url": "6ba7b8119dad11d180b400c04fd430c8"}


def uuid5(name: Column, namespace: str = "dns") -> Column:
    """RFC 4122 name-based UUID (SHA-1)."""
    h = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACES[namespace])), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def clip_text(x: Column, most: int = 160) -> Column:
    """x without tags, white space collapsed, cut to `most` characters with an ellipsis; null gives ''."""
    t = collapse_ws(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", ""))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(most))), F.lit("…")))


def clip01(x: Column) -> Column:
    """x between 0 and 1; null for null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def scale01(x: Column) -> Column:
    """Scores given out of 100 as shares: over 1 up to 100 are divided by it, greater ones are 1."""
    return F.when(x > 100, 1.0).when(x > 1, x / 100).otherwise(x)


def title_of(metadata_title: Column, text: Column, markdown: Column, kind: Column) -> Column:
    """A node's name in paths: its title, text, Markdown or type, the first that is filled."""
    return strip_ws(first_filled(metadata_title, text, markdown, kind))


def parent_path(path: Column) -> Column:
    """A path without its closing [number]; null where it has none."""
    return F.when(F.rlike(path, F.lit(r"\[\d+\]$")), F.regexp_replace(path, r"\[\d+\]$", ""))


def path_norm(path: Column) -> Column:
    """Slashes one way, leading dots and slashes gone."""
    return F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("./"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
