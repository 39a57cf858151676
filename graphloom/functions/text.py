"""String expressions that the operators share."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; those of 40 bytes and more are left out."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.octet_length(t) < 40)


def dirname(path: Column) -> Column:
    """What stands before the last slash, empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name; empty without one, or for a name that begins with its only dot."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def sanitize(text: Column) -> Column:
    """Underscores for all but letters, digits and underscores."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]", "_")


def ascii_capital(text: Column) -> Column:
    first = F.substring(text, 1, 1)
    return F.concat(F.when(first.rlike("^[a-z]$"), F.upper(first)).otherwise(first), F.substring(text, 2, 1 << 30))


def simplify_type(name: Column) -> Column:
    """The type within Promise<>, Array<> and [], and the first part of a union that isn't null, undefined or void."""

    def inner(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r"\|"), lambda p: F.trim(p)), lambda p: ~p.isin("null", "undefined", "void"))
        return (
            F.when(t.rlike(r"^Promise<.*>$"), F.trim(F.regexp_extract(t, r"^Promise<(.*)>$", 1)))
            .when(t.rlike(r"^Array<.*>$"), F.trim(F.regexp_extract(t, r"^Array<(.*)>$", 1)))
            .when(t.endswith("[]"), F.trim(F.regexp_replace(t, r"\[\]$", "")))
            .when(t.contains("|") & (F.size(parts) > 0), F.try_element_at(parts, F.lit(1)))
            .otherwise(t)
        )

    # each level takes two characters at least, so this many rounds reach the innermost
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), (F.char_length(name) / 2).cast("int")))
    return F.aggregate(rounds, F.trim(name), lambda t, _: inner(t))


def clean_rust_type(name: Column) -> Column:
    """A Rust type's own name: without references, mut, generics and the path before it."""
    out = F.regexp_replace(F.trim(name), r"^&+\s*('\w+\s+)?", "")
    out = F.regexp_replace(out, r"^mut\s+", "")
    out = F.trim(F.regexp_replace(out, r"<.*$", ""))
    out = F.regexp_replace(out, r"^(crate|self|super)::", "")
    return F.element_at(F.split(out, "::"), -1)


def suffixes(path: Column) -> Column:
    """All suffixes of a path at slashes, the longest first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, k, n), "/"))


def glob_regex(pattern: str) -> str:
    """A pattern in which * stands for any characters, slashes too, as an anchored regex."""
    import re

    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def percent_decode(text: str) -> str:
    from urllib.parse import unquote

    return unquote(text)


def percent_encode(text: str) -> str:
    from urllib.parse import quote

    return quote(text, safe="-_.~")
