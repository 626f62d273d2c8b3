"""Porter's suffix stripping (1980) as a machine of rules over columns, and a stop list.

A step's rules are tried by falling length of their endings; the first ending that a word has decides, and its replacement is made if
what stands before it fulfils the condition. Meant for distinct words: each step looks at every ending.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conditions on what stands before an ending, as patterns: its number of vowel-consonant sequences, a vowel in it, its last letters.
# A first y is a consonant, so a word that begins with a vowel begins with one of the five.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_TO_V = f"^({_C}{_V}|[aeiou]+)"
CONDITIONS = {
    "": None,
    "one": f"{_TO_V}{_C}",
    "two": f"{_TO_V}{_C}{_V}{_C}",
    "vowel": f"^({_C}[aeiouy]|[aeiou])",
    "two, s or t": f"{_TO_V}{_C}{_V}{_C}",
    "short": f"^{_C}[aeiouy][^aeiouwxy]$",
    "just one": f"{_TO_V}{_C}({_V})?$",
}
Rule = tuple[str, str, str]  # ending, replacement, condition

# The rules of the published algorithm, by step.
PLURALS: list[Rule] = [("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", "")]
PAST: list[Rule] = [("eed", "ee", "one"), ("ed", "", "vowel"), ("ing", "", "vowel")]
LAST_Y: list[Rule] = [("y", "i", "vowel")]
DOUBLE_ENDINGS: list[Rule] = [
    ("ational", "ate", "one"), ("tional", "tion", "one"), ("enci", "ence", "one"), ("anci", "ance", "one"), ("izer", "ize", "one"),
    ("abli", "able", "one"), ("alli", "al", "one"), ("entli", "ent", "one"), ("eli", "e", "one"), ("ousli", "ous", "one"),
    ("ization", "ize", "one"), ("ation", "ate", "one"), ("ator", "ate", "one"), ("alism", "al", "one"), ("iveness", "ive", "one"),
    ("fulness", "ful", "one"), ("ousness", "ous", "one"), ("aliti", "al", "one"), ("iviti", "ive", "one"), ("biliti", "ble", "one"),
]
ENDINGS: list[Rule] = [("icate", "ic", "one"), ("ative", "", "one"), ("alize", "al", "one"), ("iciti", "ic", "one"), ("ical", "ic", "one"), ("ful", "", "one"), ("ness", "", "one")]
LAST_ENDINGS: list[Rule] = [
    ("al", "", "two"), ("ance", "", "two"), ("ence", "", "two"), ("er", "", "two"), ("ic", "", "two"), ("able", "", "two"), ("ible", "", "two"), ("ant", "", "two"),
    ("ement", "", "two"), ("ment", "", "two"), ("ent", "", "two"), ("sion", "s", "two, s or t"), ("tion", "t", "two, s or t"), ("ou", "", "two"), ("ism", "", "two"),
    ("ate", "", "two"), ("iti", "", "two"), ("ous", "", "two"), ("ive", "", "two"), ("ize", "", "two"),
]

# English function words, which carry no content.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below",
    "between", "both", "but", "by", "can", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "having",
    "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my",
    "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should",
    "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too",
    "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "you", "your", "yours",
    "yourself", "yourselves",
)


def before(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def fulfils(stem: Column, condition: str) -> Column:
    pattern = CONDITIONS[condition]
    return F.lit(True) if pattern is None else stem.rlike(pattern)


def applied(word: Column, rules: list[Rule]) -> Column:
    out = word
    for ending, replacement, condition in sorted(rules, key=lambda r: len(r[0])):
        # sion and tion keep their first letter, which the condition sees.
        kept = before(word, len(ending) - len(replacement)) if condition == "two, s or t" else before(word, len(ending))
        made = kept if condition == "two, s or t" else F.concat(kept, F.lit(replacement))
        out = F.when(word.endswith(ending), F.when(fulfils(kept, condition), made).otherwise(word)).otherwise(out)
    return out


def past(word: Column) -> Column:
    """What ed and ing leave gets an e, or loses one of two equal letters."""
    kept = F.when(word.endswith("ing"), before(word, 3)).otherwise(before(word, 2))
    mended = (
        F.when(kept.rlike("(at|bl|iz)$"), F.concat(kept, F.lit("e")))
        .when((F.right(kept, F.lit(1)) == F.substring(kept, F.length(kept) - 1, F.lit(1))) & kept.rlike("[^aeiouylsz]$") & (F.length(kept) > 1), before(kept, 1))
        .when(fulfils(kept, "short"), F.concat(kept, F.lit("e")))
        .otherwise(kept)
    )
    cut = ~word.endswith("eed") & word.rlike("(ed|ing)$") & fulfils(kept, "vowel")
    return F.when(cut, mended).otherwise(applied(word, PAST[:1]))


def last_e(word: Column) -> Column:
    kept = before(word, 1)
    bare = F.when(word.endswith("e") & (fulfils(kept, "two") | fulfils(kept, "just one") & ~fulfils(kept, "short")), kept).otherwise(word)
    return F.transform(F.array(bare), lambda w: F.when(w.endswith("ll") & fulfils(before(w, 1), "two"), before(w, 1)).otherwise(w))[0]


STEPS = (
    lambda w: applied(w, PLURALS),
    past,
    lambda w: applied(w, LAST_Y),
    lambda w: applied(w, DOUBLE_ENDINGS),
    lambda w: applied(w, ENDINGS),
    lambda w: applied(w, LAST_ENDINGS),
    last_e,
)


def porter(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters stay."""
    out = F.array(word)
    for step in STEPS:  # a lambda names a step's word, so that no step is written out twice
        out = F.transform(out, step)
    return F.when(F.length(word) > 2, out[0]).otherwise(word)


# The same rules on one word, for walks inside tasks.

_PATTERNS = {name: re.compile(pattern) for name, pattern in CONDITIONS.items() if pattern}
_BY_LENGTH = [sorted(rules, key=lambda r: -len(r[0])) for rules in (PLURALS, PAST[:1], LAST_Y, DOUBLE_ENDINGS, ENDINGS, LAST_ENDINGS)]


def _fulfils(kept: str, condition: str) -> bool:
    return not condition or _PATTERNS[condition].search(kept) is not None


def _applied(word: str, rules: list[Rule]) -> str:
    for ending, replacement, condition in rules:
        if word.endswith(ending):
            if condition == "two, s or t":
                made = kept = word[: len(word) - len(ending) + len(replacement)]
            else:
                kept = word[: len(word) - len(ending)]
                made = kept + replacement
            return made if _fulfils(kept, condition) else word
    return word


def _past(word: str) -> str:
    kept = word[:-3] if word.endswith("ing") else word[:-2]
    if word.endswith("eed") or not word.endswith(("ed", "ing")) or not _fulfils(kept, "vowel"):
        return _applied(word, _BY_LENGTH[1])
    if kept.endswith(("at", "bl", "iz")):
        return kept + "e"
    if len(kept) > 1 and kept[-1] == kept[-2] and kept[-1] not in "aeiouylsz":
        return kept[:-1]
    return kept + "e" if _fulfils(kept, "short") else kept


def _last_e(word: str) -> str:
    kept = word[:-1]
    if word.endswith("e") and (_fulfils(kept, "two") or _fulfils(kept, "just one") and not _fulfils(kept, "short")):
        word = kept
    return word[:-1] if word.endswith("ll") and _fulfils(word[:-1], "two") else word


@functools.lru_cache(1 << 17)
def stem_of(word: str) -> str | None:
    """porter() of one lower-case word; null for a stop word. A worker keeps the last words it met."""
    if word in _STOP:
        return None
    if len(word) < 3:
        return word
    word = _past(_applied(word, _BY_LENGTH[0]))
    for rules in _BY_LENGTH[2:]:
        word = _applied(word, rules)
    return _last_e(word)


_STOP = frozenset(STOP_WORDS)
