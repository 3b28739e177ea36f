"""English stems: the published Snowball "English" algorithm, as one column expression.

The rules are held as data that both engines read: a word takes the first rule of a step
whose test it meets, and is changed where the rule's pattern holds.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_V, _C = "[aeiouy]", "[^aeiouy]"
_FIRST = f"(?:{_C}*{_V}+{_C}|[GKA])"  # what stands before the first region; G, K, A: see _PREFIXES
_SECOND = f"{_FIRST}{_C}*{_V}+{_C}"
_R1, _R2 = f"{_FIRST}.*", f"{_SECOND}.*"
_VOWEL = "[aeiouyGKA]"
_SHORT = f"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})"

#: Fixed values of the algorithm: prefixes after which the first region begins, and words with stems of their own.
_PREFIXES = {"gener": "G", "commun": "K", "arsen": "A"}
_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_OWN |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_OWN |= {w + s: w for w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed") for s in ("", "s")}


def _ends(suffixes: str, to: str, before: str) -> list[tuple[str, str, str]]:
    return [(f"(?:{s})$", f"^({before})(?:{s})$", to) for s in suffixes.split()]


def _after(region: str, last: str) -> str:
    """A beginning that reaches the region and ends in one of `last`."""
    return f"(?:{region[: -len(_C)] if region is _SECOND else f'{_C}*{_V}+'}{last}|{region}.*{last})"


#: (test, pattern, what stands in place of the end): steps 1a, 1b, its repair, 1c, 2, 3, 4, 5. "#": an ending went.
STEPS = [
    [*_ends("sses", "ss", ".*"), ("..ie[ds]$", "^(.*)ie[ds]$", "i"), ("ie[ds]$", "^(.*)ie[ds]$", "ie"), ("[us]s$", "^(.*)$", ""), *_ends("s", "", f".*{_VOWEL}.+")],
    [*_ends("eed|eedly", "ee", _R1), *_ends("ed|edly|ing|ingly", "#", f".*{_VOWEL}.*")],
    [("(?:at|bl|iz)#$", "^(.*)#$", "e"), ("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)#$", "^(.*).#$", ""), (f"^(?:[^aeiouyGKA]+{_V}[^aeiouywxY]|{_V}{_C})#$", "^(.*)#$", "e"), ("#$", "^(.*)#$", "")],
    _ends("[yY]", "i", f".+{_C}"),
    [
        *_ends("ization", "ize", _R1), *_ends("ational", "ate", _R1), *_ends("fulness", "ful", _R1), *_ends("ousness", "ous", _R1), *_ends("iveness", "ive", _R1), *_ends("tional", "tion", _R1),
        *_ends("biliti", "ble", _R1), *_ends("lessli", "less", _R1), *_ends("entli", "ent", _R1), *_ends("ation", "ate", _R1), *_ends("alism aliti", "al", _R1), *_ends("ousli", "ous", _R1),
        *_ends("iviti", "ive", _R1), *_ends("fulli", "ful", _R1), *_ends("enci", "ence", _R1), *_ends("anci", "ance", _R1), *_ends("abli", "able", _R1), *_ends("izer", "ize", _R1),
        *_ends("ator", "ate", _R1), *_ends("alli", "al", _R1), *_ends("bli", "ble", _R1), *_ends("ogi", "og", _after(_FIRST, "l")), *_ends("li", "", _after(_FIRST, "[cdeghkmnrt]")),
    ],
    [*_ends("ational", "ate", _R1), *_ends("tional", "tion", _R1), *_ends("alize", "al", _R1), *_ends("icate iciti ical", "ic", _R1), *_ends("ative", "", _R2), *_ends("ful ness", "", _R1)],
    [*_ends("ement ance ence able ible ment ant ent ism ate iti ous ive ize", "", _R2), *_ends("ion", "", _after(_SECOND, "[st]")), *_ends("al er ic", "", _R2)],
    [(f"^{_R2}e$", "^(.*)e$", ""), (f"{_SHORT}e$", "^(.*)$", ""), *_ends("e", "", _R1), ("ll$", f"^({_after(_SECOND, 'l')})l$", "")],
]


def _meets(x: str, test: str) -> str:
    """Plain endings are compared as such, several times faster than by a pattern."""
    endings = re.fullmatch(r"\(\?:([a-z|]+)\)\$", test)
    return " OR ".join(f"endswith({x}, '{e}')" for e in endings[1].split("|")) if endings else f"rlike({x}, '{test}')"


@cache
def _stemmer() -> str:
    """The rules as a lambda of Spark's SQL: read in one go, where columns put together rule by rule take seconds in each plan."""
    x = f"regexp_replace(regexp_replace(w, '^y', 'Y'), '({_V})y', '$1Y')"
    for full, mark in _PREFIXES.items():
        x = f"regexp_replace({x}, '^{full}', '{mark}')"
    for rules in STEPS:  # an array of one, so that the word of a step is worked out once
        cases = " ".join(f"WHEN {_meets('x', test)} THEN regexp_replace(x, '{pattern}', '$1{to}')" for test, pattern, to in rules)
        x = f"get(transform(array({x}), x -> CASE {cases} ELSE x END), 0)"
    x = f"replace({x}, 'Y', 'y')"
    for full, mark in _PREFIXES.items():
        x = f"regexp_replace({x}, '^{mark}', '{full}')"
    own = ", ".join(f"'{a}', '{b}'" for a, b in _OWN.items())
    return f"w -> CASE WHEN rlike(w, '^[^0-9]{{3,}}$') THEN coalesce(element_at(map({own}), w), {x}) ELSE w END"


def stem(word: Column) -> Column:
    """The stem of a lower-case word. Words with digits, or of one or two letters, are left; null stays null."""
    return F.get(F.call_function("transform", F.array(word), F.expr(_stemmer())), F.lit(0))


def stem_sql(word: str) -> str:
    """`stem` in DuckDB's SQL; `word` is a column's name."""
    x = f"regexp_replace(regexp_replace({word}, '^y', 'Y'), '({_V})y', '\\1Y', 'g')"
    for full, mark in _PREFIXES.items():
        x = f"regexp_replace({x}, '^{full}', '{mark}')"
    for rules in STEPS:
        cases = " ".join(f"WHEN regexp_matches(x, '{test}') THEN regexp_replace(x, '{pattern}', '\\1{to}')" for test, pattern, to in rules)
        x = f"([CASE {cases} ELSE x END FOR x IN [{x}]])[1]"
    x = f"replace({x}, 'Y', 'y')"
    for full, mark in _PREFIXES.items():
        x = f"regexp_replace({x}, '^{mark}', '{full}')"
    own = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _OWN.items())
    return f"CASE WHEN regexp_matches({word}, '^[^0-9]{{3,}}$') THEN coalesce(CASE {word} {own} END, {x}) ELSE {word} END"
