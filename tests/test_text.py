import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from critiq.functions import text as T

POOL = (
    list("abzAZ09_ -.,'\"\\")
    + [chr(c) for c in (0xDF, 0x1E9E, 0x130, 0x131, 0x3A3, 0x3C2, 0x3C3, 0xB5, 0xFB01, 0xFF21)]
    + [chr(c) for c in (0xB2, 0x2460, 0x301, 0x1F600, 0x4E2D, 0x3042, 0x212A, 0x17F, 0x149)]
    + list(T.WHITESPACE)
)


def _strings(n=1500, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(POOL, k=rng.randint(0, 14))) for _ in range(n)]


def _apply(spark, strings, expression):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    rows = df.select("i", expression(F.col("s")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_strip_and_clean_follow_unicode_white_space(spark):
    strings = _strings()
    assert _apply(spark, strings, T.strip) == [s.strip() for s in strings]
    assert _apply(spark, strings, T.clean_text) == [s.strip() or None for s in strings]


def test_case_folding_is_full(spark):
    strings = _strings(seed=8) + ["Straße", "ΣΊΣΥΦΟΣ", "ŉ", "ﬁne", "İstanbul"]
    folded = [s.casefold() for s in strings]
    assert _apply(spark, strings, T.casefold) == folded
    assert _apply(spark, strings, T.casefold_label) == folded


def test_every_special_fold(spark):
    strings = [c for c in T._special_folds() if unicodedata.category(c) != "Cs"]
    assert _apply(spark, strings, T.casefold_label) == [c.casefold() for c in strings]


def test_plain_characters_fold_to_lower_case_on_both_sides(spark):
    characters = [chr(c) for low, high in T._PLAIN_RANGES for c in range(low, high + 1)]
    for c in characters:
        assert unicodedata.normalize("NFKC", c).casefold() == c.lower()
        assert unicodedata.combining(c) == 0
    chunks = ["".join(characters[i : i + 500]) for i in range(0, len(characters), 500)]
    assert _apply(spark, chunks, F.lower) == [s.casefold() for s in chunks]
    assert all(_apply(spark, chunks, T._is_plain))


def test_tokens_match_the_word_rule(spark):
    word = re.compile(r"\b[^\W_]{2,}\b")
    strings = _strings(3000, seed=9) + ["foo_bar baz", "a b cc", "ＣＲＩＳＰＹ crust", "", "x²"]
    expected = [word.findall(unicodedata.normalize("NFKC", s).casefold()) for s in strings]
    assert _apply(spark, strings, T.tokens) == expected


def test_line_breaks(spark):
    breaks = ["\n", "\r\n", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    strings = [f"a{b}b{b}{b}c\x1fd" for b in breaks]
    got = _apply(spark, strings, lambda s: F.split(s, T.LINE_BREAK, -1))
    assert got == [s.splitlines() for s in strings]


def test_plain_name_in_python_and_on_columns(spark):
    names = ["Order ID", "order_id", "Größe", "ſtar", "名前", "K"]
    assert _apply(spark, names, T.plain_name_col) == [T.plain_name(n) for n in names]
    assert T.plain_name("Größe") == "grsse"
    assert sys.maxunicode == 0x10FFFF
