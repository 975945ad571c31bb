"""Text normalisation as column expressions.

Java's \\w, \\s and \\b know ASCII only, so classes are spelled out. Rewrites with a fixed order are folds of
``regexp_replace``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glotmill.functions import rewriting
from glotmill.lexicon import EMOJI_WORDS, TEEN_WORDS, fold_pairs

# Ordered rewrites for repeated marks and HTML entities (entities come after the collapse of marks).
COMMON_REWRITES = [
    (r"\)\)+", "))"), (r"\(\(+", "(("), (r"\]\]+", "]]"), (r">+", ">"), (r"=+", "="), (r":+", ":"), (r"\?+", "?"), (r"!+", "!"),
    (r"kk+", "haha"), (r"\.\.\.+", "..."), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&nbsp;", " "), ("<br>", "\n"),
]

SPACES = r"[\s   -     　\x1c-\x1f\x85]+"
WORD = r"[\p{L}\p{N}_À-ỹ]+"


def normalize_common(text: Column) -> Column:
    """Repeated marks and entities."""
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1].replace("$", r"\$")), COMMON_REWRITES, text)


def clean_spaces(text: Column) -> Column:
    """T4: white space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def replace_words(text: Column, words: dict[str, str] = TEEN_WORDS) -> Column:
    """Each word once, by its lower-case form; other text stays. Keys that are not single words never match."""
    parts = F.regexp_extract_all(text, F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}_À-ỹ]+"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    # a set tells by a hash whether a word is a key; only then is the map gone through
    return F.array_join(F.transform(parts, lambda p: F.when(F.lower(p).isin(list(words)), F.try_element_at(table, F.lower(p))).otherwise(p)), "")


def replace_words_cascading(text: Column, words: dict[str, str]) -> Column:
    """T8's dictionary: whole words, as if replaced one after another in the order given, so results can be replaced again."""
    return rewriting.replace_words(text, list(words.items()))


def replace_literals(text: Column, table: dict[str, str] = EMOJI_WORDS, longest_first: bool = True) -> Column:
    """Literal replacements by a description between spaces; T2 takes longer keys first."""
    keys = sorted(table, key=len, reverse=True) if longest_first else list(table)
    return rewriting.replace_literals(text, [(k, f" {table[k]} ") for k in keys])


def preprocess(text: Column, scenario: str) -> Column:
    """T5: s1 marks and words, s2 with emoticons too, s3 marks only."""
    common = normalize_common(text)
    if scenario == "s1":
        return clean_spaces(replace_words(common))
    if scenario == "s2":
        return clean_spaces(replace_words(replace_literals(common)))
    if scenario == "s3":
        return clean_spaces(common)
    raise ValueError(f"unknown scenario {scenario!r}")


def normalized_or_fallback(text: Column, normalizer=None) -> Column:
    """A neural normaliser given as a Column function, else marks, words and spaces."""
    return clean_spaces(replace_words(normalize_common(text))) if normalizer is None else clean_spaces(normalizer(normalize_common(text)))


def collapse_letters(text: Column) -> Column:
    """Runs of one letter to a single letter."""
    return F.regexp_replace(text, r"(\p{L})\1+", "$1")


def shorten_runs(text: Column) -> Column:
    """Runs of three or more of a character to two."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


def newline_rules(text: Column) -> Column:
    """A line feed after no mark becomes a full stop, others a space before the mark that follows."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<![.,!?;:])\n", ". "), r"\n([.,!?;:])?", " $1")


def model_text(text: Column, words: dict[str, str] | None = None, emoji: dict[str, str] | None = None, rewrites: list[tuple[str, str]] | None = None, capital_guard: bool = False) -> Column:
    """T8 (S1), T9 (S2, with ``emoji``) and T11 (``capital_guard``): the form that models are trained on."""
    out = reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), COMMON_REWRITES if rewrites is None else rewrites, F.lower(text))
    out = F.regexp_replace(collapse_letters(out), r"([\x{1F300}-\x{1FAFF}☀-➿])\1+", "$1")
    if emoji:
        out = replace_literals(out, emoji, longest_first=False)
    out = replace_words_cascading(out, words or {})
    if capital_guard:
        return clean_spaces(newline_rules(F.regexp_replace(out, r"(?<![A-Z])([.,!?;])(?![A-Z])", " $1 ")))
    return clean_spaces(F.regexp_replace(newline_rules(out), r"([.,!?;:])", " $1 "))


def fold_accents(text: Column, lower: bool = True) -> Column:
    """Letters without diacritics, combining marks dropped."""
    source, target = fold_pairs()
    folded = F.regexp_replace(F.translate(text, source, target), r"\p{Mn}", "")
    return F.lower(folded) if lower else folded


def with_scenarios(df, text_col: str = "text"):
    """text_s1, text_s2, text_s3 beside the text."""
    return df.withColumns({f"text_{s}": preprocess(F.coalesce(F.col(text_col), F.lit("")), s) for s in ("s1", "s2", "s3")})


def task_prefix(text: Column, prefix: str = "classification: ") -> Column:
    """T16."""
    return F.concat(F.lit(prefix), text)
