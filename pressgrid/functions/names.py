"""Names: canonical and natural forms, slugs, letters, folded tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F, types as T

#: Latin letters with marks, and the letters they fold to.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸàáâãäåçèéêëìíîïñòóôõöùúûüýÿŠšŽžČčĚěŘřŮůĞğŞşİ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYYaaaaaaceeeeiiiinooooouuuuyySsZzCcEeRrUuGgSsI"
#: The marked forms that a letter's list takes in.
LETTER_FORMS = {"A": "ÀÁÂÃÄÅ", "C": "Ç", "E": "ÈÉÊË", "I": "ÌÍÎÏ", "N": "Ñ", "O": "ÒÓÔÕÖ", "U": "ÙÚÛÜ", "Y": "ÝŸ"}


def _tokens(name: Column) -> Column:
    return F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda x: x != "")


def canonical_name(name: Column) -> Column:
    """``Last, Rest`` for two tokens or more, else the token itself."""
    parts = _tokens(name)
    n = F.size(parts)
    return F.when(n >= 2, F.concat_ws(", ", F.element_at(parts, -1), F.array_join(F.slice(parts, 1, n - 1), " "))).when(n == 1, parts[0]).otherwise("")


def fold(text: Column) -> Column:
    """Lower case without marks on Latin letters, inside the JVM."""
    return F.lower(F.translate(text, MARKED, PLAIN))


@F.pandas_udf(T.StringType())
def fold_any(text):
    """:func:`fold` for every script: compatibility decomposition without combining marks."""
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower())


def tokens(text: Column) -> Column:
    """Folded alphanumeric tokens in order."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def slug(name: Column) -> Column:
    """Folded canonical name with every other run of characters as one hyphen; nothing left gives ``unknown``."""
    text = F.regexp_replace(F.regexp_replace(fold(canonical_name(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(text == "", "unknown").otherwise(text)


def natural_name(name: Column, aliases: Column) -> Column:
    """First alias if there is one, else ``Last, First`` turned round."""
    return F.coalesce(F.try_element_at(aliases, F.lit(1)), inverted_name(name), name)


def inverted_name(name: Column) -> Column:
    """``First Last`` of ``Last, First``; null without a comma."""
    cut = F.split(name, ",", 2)
    return F.when(F.contains(name, F.lit(",")), F.concat_ws(" ", F.trim(F.try_element_at(cut, F.lit(2))), F.trim(cut[0])))


def name_variants(name: Column, aliases: Column) -> Column:
    """Canonical, turned round, then all aliases, without empty ones."""
    return F.filter(F.concat(F.array(name, inverted_name(name)), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))


def bucket_letter(name: Column) -> Column:
    """First letter folded and upper-case, ``#`` where it isn't A to Z (P5)."""
    first = F.upper(fold(F.substring(name, 1, 1)))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("#")


def in_letter(name: Column, letter: str) -> Column:
    """Whether a name is listed under a letter, case counting for marked letters only; ``#`` takes the rest."""
    own = F.substring(name, 1, 1)

    def listed(x: str) -> Column:
        return own.isin(x, x.lower(), *LETTER_FORMS.get(x, ""))

    if letter == "#":
        known = [y for x in map(chr, range(65, 91)) for y in (x, x.lower(), *LETTER_FORMS.get(x, ""))]
        return ~own.isin(known)
    return listed(letter.upper())


def sort_key(name: Column) -> Column:
    """First name, then last, for ``Last, First``; names without a comma as they are."""
    return F.coalesce(inverted_name(name), name)


def surname_key(name: Column) -> Column:
    """What stands before the comma, trimmed and in lower case."""
    return F.lower(F.trim(F.split_part(name, F.lit(","), F.lit(1))))
