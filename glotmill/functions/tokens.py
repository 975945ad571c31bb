"""Tokens, counters and the syllable rule as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glotmill.functions.text import fold_accents
from glotmill.lexicon import LETTERS, NUCLEI, VIET_CHARS

WORDISH = r"[\p{L}\p{N}_]"


def _ranges(chars: str) -> str:
    """Characters in either case as the ranges of a class: neighbours share a test, which a long list of single ones does not."""
    points, runs = sorted({ord(c) for c in chars + chars.upper()}), []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs)


# A class of many ranges is only gone through for characters between its first and last: others fail at one comparison.
VIET = rf"[\x{{C0}}-\x{{1EF9}}&&[{_ranges(VIET_CHARS)}]]"

# Patterns of the detectors.
URL = r"(?i)[hw](?:(?<=h)ttps?://|(?<=w)ww\.)\S+"
# What stands before the mark is looked at behind it, so that only marks are looked at.
MENTION = rf"@(?<!{WORDISH}@)[\p{{L}}\p{{N}}_.]+"
MENTION_V1 = rf"@(?<!{WORDISH}@){WORDISH}+"
HASHTAG = rf"#(?<!{WORDISH}#){WORDISH}+"
TAG = r"<[^>]{1,15}>"
TOKEN = rf"[{LETTERS}]+(?:['\-][{LETTERS}]+)*|\p{{Nd}}+|[^\p{{L}}\p{{N}}_\s]"
TOKEN_V1 = rf"[{LETTERS}]+(?:[\-'][{LETTERS}]+)?"
EMOJI = r"[\x{2190}-\x{1FAFF}&&[\x{1F000}-\x{1FAFF}←-⇿⌀-⏿☀-⛿✀-➿️⬀-⯿]]"
EMOJI_V1 = r"[\x{1F300}-\x{1FAFF}✀-➿☀-⛿]+"
NON_LATIN = r"[Ѐ-힯&&[Ѐ-ӿ؀-ۿ฀-๿぀-ヿ㐀-䶿一-鿿가-힯]]"
LAUGH = r"(?iu)^(?:(?:h[aeiouyăâêôơư]{1,2}){2,}|(?:hj){2,}|(?:jz){2,}|(?:ck){2,}|k{2,}|z{3,}|w+k+w*|lol|lmao|lmfao|rofl|jaja|khkh|khjkhj)$"
LAUGH_STARTS = "hjckzwlr"  # what a laugh of a to z begins with
LONGEST_SYLLABLE = 9  # three letters, three vowels, two letters and a line feed, which the pattern lets stand
SYLLABLE = r"^(ngh|ng|nh|ch|gh|gi|kh|ph|th|tr|qu|[bcdghklmnprstvx])?([aeiouy]{1,3})(ng|nh|ch|c|m|n|p|t)?$"
SCRIPTS = {
    "chinese_script": r"[一-鿿㐀-䶿]", "japanese": r"[぀-ヿ]", "korean": r"[가-힯ᄀ-ᇿ]",
    "cyrillic": r"[Ѐ-ӿ]", "thai": r"[฀-๿]",
}
HAN_RUN, HANGUL_RUN, KANA_RUN = r"[㐀-䶿一-鿿豈-﫿]+", r"[가-힣]+", r"[぀-ヿ]+"


def every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def cleaned(text: Column) -> Column:
    """Short tags, links, mentions and hashtags become a space."""
    found = text
    for p in (TAG, URL, MENTION, HASHTAG):
        found = F.regexp_replace(found, p, " ")
    # a text with none of what these begin with, or of a link's further signs, is not gone through four times
    some = F.lit(False)
    for mark in ("<", "@", "#", "://"):
        some = some | text.contains(mark)
    return F.when(some | F.lower(text).contains("www."), found).otherwise(text)


def tokens(text: Column) -> Column:
    """D3."""
    return every(cleaned(text), TOKEN)


def word_tokens(tokens_: Column) -> Column:
    """Tokens with a letter; most show at their first character."""
    first = lambda t, a, b: (t >= a) & (t < b)
    return F.filter(tokens_, lambda t: first(t, "a", "{") | first(t, "A", "[") | ((F.octet_length(t) > 1) & t.rlike(f"[{LETTERS}]")))


def diacritics(text: Column) -> Column:
    return count_of(text, VIET)


def is_plain_syllable(word: Column) -> Column:
    """The syllable rule for lower-case words of a to z; where nothing matches, the empty string is no nucleus."""
    return F.regexp_extract(word, SYLLABLE, 2).isin(NUCLEI)


def is_syllable(token: Column) -> Column:
    """A possible Vietnamese syllable, once diacritics are gone."""
    return is_plain_syllable(fold_accents(token))


def is_laugh(token: Column) -> Column:
    return token.rlike(LAUGH)


def noise_counts(text: Column) -> dict[str, Column]:
    """D1, on the raw text; emoji are counted by code points."""
    return {
        "n_url": count_of(text, URL), "n_mention": count_of(text, MENTION), "n_hashtag": count_of(text, HASHTAG),
        "n_emoji": count_of(text, EMOJI), "n_non_latin": count_of(text, NON_LATIN),
    }


def script_counts(text: Column) -> dict[str, Column]:
    """D20."""
    return {k: count_of(F.coalesce(text, F.lit("")), p) for k, p in SCRIPTS.items()}
