"""Column helpers for catalogue text: search keys, natural order, titles, names, languages, links, hashes."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Spelt-out forms of Latin letters in search keys.
LATIN_EXPANSIONS = {"ä": "ae", "ö": "oe", "ø": "oe", "œ": "oe", "ü": "ue", "ß": "ss", "æ": "ae"}
#: Letters with marks that a search key holds without them.
MARKED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"
#: Three-letter language codes and their two-letter forms.
LANGUAGES = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "jpn": "ja", "zho": "zh", "chi": "zh", "kor": "ko", "por": "pt", "rus": "ru", "nld": "nl", "dut": "nl"}


def fold(text: Column) -> Column:
    """The search key of a text: lower case, marks dropped, only a-z and 0-9 kept. Stays in the JVM."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]", "")


@F.arrow_udf(StringType())
def _decomposed(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, form="NFKD")


def fold_any(text: Column) -> Column:
    """text in lower case without the marks of any script: compatibility decomposition in Arrow batches, the rest in the JVM."""
    return F.lower(F.regexp_replace(_decomposed(text), r"\p{Mn}+", ""))


def expand_latin(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LATIN_EXPANSIONS.items(), F.lower(text))


def search_key(*fields: Column) -> Column:
    """fold() of all fields; behind a bar the key of their spelt-out form, if that differs."""
    text = F.concat_ws(" ", *fields)
    plain, spelt = fold(text), fold(expand_latin(text))
    return F.when(plain == spelt, plain).otherwise(F.concat(plain, F.lit("|"), spelt))


def natural_key(text: Column) -> Column:
    """A string that sorts as the natural order: digit runs by value, the rest by code point. A run's count of digits stands before it, so runs of any length compare by value."""
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    value = lambda x: F.concat(F.lpad(F.length(bare(x)).cast("string"), 10, "0"), bare(x))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), value(x)).otherwise(x)), "")


def leading_zeros(text: Column) -> Column:
    """Zeros in front of the digit runs: the second key of the natural order, fewer first."""
    return F.length(F.array_join(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])(0*)[0-9]"), F.lit(1)), ""))


def normal_title(text: Column) -> Column:
    """Without byte-order and zero-width marks; white space runs as one blank; trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "﻿​‌‍", ""), r"\s+", " "))


def without_suffix(text: Column) -> Column:
    """Without one closing (...)."""
    return F.regexp_replace(text, r"\s*\([^()]*\)$", "")


def normal_language(tag: Column) -> Column:
    """Two-letter base language of a tag; Chinese with its script."""
    parts = F.split(F.replace(F.lower(tag), F.lit("_"), F.lit("-")), "-")
    base = F.get(parts, 0)
    codes = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    base = F.coalesce(F.element_at(codes, base), base)
    rest = F.slice(parts, 2, 9)
    traditional = F.arrays_overlap(rest, F.array(*map(F.lit, ("hant", "tw", "hk", "mo"))))
    return F.when((base == "zh") & traditional, "zh-Hant").when((base == "zh") & (F.size(parts) > 1), "zh-Hans").otherwise(base)


def display_name(name: Column) -> Column:
    """'Surname, Given' as 'Given Surname'; closing marks of rank stay; names in Han or kana stay."""
    parts = F.transform(F.split(name, ","), lambda x: F.trim(x))
    rank = F.lower(F.get(parts, 1)).rlike(r"^(jr|sr|ii|iii|iv|phd|md)\.?$")
    return F.when(name.rlike(r"[぀-ヿ一-鿿]") | (F.size(parts) != 2) | rank, F.trim(name)).otherwise(F.concat_ws(" ", F.get(parts, 1), F.get(parts, 0)))


def canonical_tags(tags: Column) -> Column:
    """Trimmed, lower case, not empty, first of equals kept."""
    return F.array_distinct(F.filter(F.transform(tags, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each ended by a NUL."""
    return F.sha2(F.concat(*(F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\u0000")) for p in parts)).cast("binary"), 256)


def href_kind(href: Column) -> Column:
    return (
        F.when(href.isNull() | (F.trim(href) == ""), "none").when(href.startswith("#"), "fragment").when(href.rlike(r"(?i)^(https?|ftp)://"), "external").when(href.rlike(r"^//"), "external")
        .when(href.rlike(r"(?i)^(mailto|tel|javascript|data):"), "other").otherwise("chapter")
    )


def resolve_path(base: Column, href: Column) -> Column:
    """href against the folder of base, with . and .. taken out; a path cannot climb above the root."""
    whole = F.when(href.startswith("/"), href).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), href))
    steps = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/"))


def visible_text(html: Column) -> Column:
    """Text of an HTML source: scripts, styles, ruby brackets, comments and tags dropped, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<rp\b.*?</rp\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\n\f\r]+", " "))


def glob_regex(pattern: str) -> str:
    """A case-blind glob with * and ? as a regular expression."""
    special = {"*": ".*", "?": "."}
    return "(?is)^" + "".join(special.get(c) or ("\\" + c if not c.isalnum() else c) for c in pattern) + "$"


def like_escaped(text: str) -> str:
    """text with LIKE's signs escaped by a backslash."""
    return "".join("\\" + c if c in "\\%_" else c for c in text)
