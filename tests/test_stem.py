"""The stemmer's rules against a plain walk over letters, on all words of the corpus."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docgrain.functions import stem

DATA = "/root/testdata/sf0.01"


def consonant(word, i):
    c = word[i]
    return c not in "aeiou" and (c != "y" or i == 0 or not consonant(word, i - 1))


def measure(word):
    kinds = "".join("c" if consonant(word, i) else "v" for i in range(len(word)))
    return sum(x + y == "vc" for x, y in zip(kinds, kinds[1:], strict=False))


def has_vowel(word):
    return any(not consonant(word, i) for i in range(len(word)))


def double(word):
    return len(word) > 1 and word[-1] == word[-2] and consonant(word, len(word) - 1)


def cvc(word):
    n = len(word)
    return n > 2 and consonant(word, n - 3) and not consonant(word, n - 2) and consonant(word, n - 1) and word[-1] not in "wxy"


def rewritten(word, rules, least):
    for ending, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(ending):
            kept = word[: -len(ending)]
            return kept + new if measure(kept) > least else word
    return word


def plain_stem(word):
    if len(word) < 3:
        return word
    word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1] if word.endswith("s") else word
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            kept = word[: -len(ending)]
            if word.endswith(ending) and has_vowel(kept):
                if kept.endswith(("at", "bl", "iz")):
                    kept += "e"
                elif double(kept) and kept[-1] not in "lsz":
                    kept = kept[:-1]
                elif measure(kept) == 1 and cvc(kept):
                    kept += "e"
                word = kept
                break
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = rewritten(word, [(e, r) for e, r, _ in stem.DOUBLE_ENDINGS], 0)
    word = rewritten(word, [(e, r) for e, r, _ in stem.ENDINGS], 0)
    for ending in sorted([*(e for e, _, _ in stem.LAST_ENDINGS if not e.endswith("sion") and not e.endswith("tion")), "ion"], key=len, reverse=True):
        if word.endswith(ending):
            kept = word[: -len(ending)]
            if measure(kept) > 1 and (ending != "ion" or kept[-1:] in ("s", "t")):
                word = kept
            break
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not cvc(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


KNOWN = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubling": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "operator": "oper", "hopefulness": "hope", "triplicate": "triplic", "formalize": "formal",
    "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll",
    "agreement": "agreement", "agreements": "agreement", "licensing": "licens", "obligations": "oblig", "y": "y", "yes": "ye", "eed": "eed", "ing": "ing", "ions": "ion", "ll": "ll",
}


def test_stems_of_known_words(spark):
    rows = spark.createDataFrame(list(KNOWN.items()), "word string, want string").select("word", "want", stem.porter(F.col("word")).alias("got")).collect()
    assert {r["word"]: r["got"] for r in rows} == KNOWN
    assert {w: plain_stem(w) for w in KNOWN} == KNOWN


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stems_of_the_corpus(spark):
    words = spark.read.parquet(f"{DATA}/documents.parquet").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("word")).distinct()
    endings = [e for rules in (stem.PLURALS, stem.PAST, stem.LAST_Y, stem.DOUBLE_ENDINGS, stem.ENDINGS, stem.LAST_ENDINGS) for e, _, _ in rules]
    made = words.limit(1500).select(F.explode(F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat("word", e))).alias("word"))
    rows = words.unionByName(made).select("word", stem.porter(F.col("word")).alias("got")).collect()
    assert len(rows) > 10_000
    assert [(r["word"], r["got"]) for r in rows if r["got"] != plain_stem(r["word"])] == []


def test_one_word_at_a_time(spark):
    """The walk inside tasks makes the stems of the columns' rules."""
    rng = random.Random(6)
    endings = sorted({r[0] for rules in (stem.PLURALS, stem.PAST, stem.LAST_Y, stem.DOUBLE_ENDINGS, stem.ENDINGS, stem.LAST_ENDINGS) for r in rules} | {"e", "ll", "y", "tt", "🙂", "ß"})
    words = sorted({"".join(rng.choice("aeiouybcstlzwx") for _ in range(rng.randrange(0, 7))) + "".join(rng.choice(endings) for _ in range(rng.randrange(0, 3))) for _ in range(20_000)} - {""})
    words += list(stem.STOP_WORDS)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["s"] for r in df.select("w", stem.porter(F.col("w")).alias("s")).collect()}
    assert {w: stem.stem_of(w) for w in words} == {w: None if w in stem.STOP_WORDS else s for w, s in got.items()}
