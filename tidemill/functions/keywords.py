"""Keyword lists found in text, by one regular expression for each list and the configured spelling of every hit."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _escaped(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def _unique(keywords) -> list[str]:
    return list(dict.fromkeys(k.strip() for k in keywords if k and k.strip()))


def _longest_first(keywords: list[str]) -> list[str]:
    return sorted(keywords, key=lambda k: (-len(k), k))


def phrase_pattern(keywords) -> str:
    """An alternation, the longest first; any white space between words, word boundaries beside letters and digits only."""
    each = []
    for k in _longest_first(_unique(keywords)):
        body = r"\s+".join(map(_escaped, k.split()))
        each.append((r"\b" if k[0].isalnum() else "") + body + (r"\b" if k[-1].isalnum() else ""))
    return "|".join(each)


def phrases(text: Column, keywords) -> Column:
    """Those of the keywords that text has, spelled and ordered as in the list.

    Of overlapping keywords the longest counts. Case and the width of white space do not matter. Null is no text.
    """
    known = _unique(keywords)
    if not known:
        return F.array().cast("array<string>")
    spelled: dict[str, str] = {}
    for k in known:
        spelled.setdefault(re.sub(r"\s+", "", k.lower()), k)
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iuU){phrase_pattern(known)}"), F.lit(0))
    squeezed = F.transform(hits, lambda h: F.lower(F.regexp_replace(h, r"(?U)\s+", "")))
    # the intersection keeps the order of the list
    return F.transform(F.array_intersect(F.array(*map(F.lit, spelled)), squeezed), lambda k: F.try_element_at(_literal_map(spelled), k))


def inflected_pattern(keywords) -> str:
    """Whole words with a plural ending; a final y also as ies, a space also as hyphen or no-break space, a hyphen also as dash or space."""
    each = []
    for k in _longest_first(_unique(keywords)):
        ending = len(k) > 3 and k.endswith("y") and k[-2].lower() not in "aeiou"
        body = r"[\s -]+".join(_escaped(w).replace(r"\-", r"[-–—\s]") for w in (k[:-1] if ending else k).split())
        each.append(body + ("(?:y|ies)" if ending else ""))
    return rf"(?<!\w)(?:{'|'.join(each)})(?:e?s)?(?!\w)"


def _squashed(text: Column) -> Column:
    """Without separators and final s: two spellings of one keyword are equal then."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s ‐-―-]+", ""), "s+$", "")


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs.items())))


def inflected(text: Column, keywords) -> Column:
    """The distinct keywords of the list that text has, as configured; hits are reduced to dictionary forms.

    The last word of a hit is tried as it is, with -y for -ies, without -es and without -s; what none of them finds is
    compared by its letters alone. Null is no text.
    """
    known = _longest_first(_unique(keywords))
    if not known:
        return F.array().cast("array<string>")
    exact, loose = {}, {}
    for k in known:
        exact.setdefault(k.lower(), k)
        loose.setdefault(re.sub(r"[\s ‐-―-]+", "", k.lower()).rstrip("s"), k)
    exact_map, loose_map = _literal_map(exact), _literal_map(loose)

    def canonical(hit: Column) -> Column:
        norm = F.lower(F.trim(F.regexp_replace(hit, r"[\s ]+", " ")))
        last = F.length(F.element_at(F.split(norm, " "), -1))
        forms = [norm]
        for end, put, least in (("ies", "y", 4), ("es", "", 3), ("s", "", 2)):
            forms.append(F.when(norm.endswith(end) & (last > least), F.concat(F.left(norm, F.length(norm) - len(end)), F.lit(put))))
        return F.coalesce(*(F.try_element_at(exact_map, F.coalesce(f, F.lit(""))) for f in forms), F.try_element_at(loose_map, _squashed(norm)))

    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iuU){inflected_pattern(known)}"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(hits, canonical), lambda k: k.isNotNull()))


def mentions(text: Column, keywords) -> Column:
    """Whether text has any of the keywords in the sense of inflected()."""
    return F.coalesce(text, F.lit("")).rlike(f"(?iuU){inflected_pattern(keywords)}") if _unique(keywords) else F.lit(False)
