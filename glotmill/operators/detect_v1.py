"""Detector v1: English-like words, Chinese and other scripts (D15 to D19). A projection; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.functions import tokens as T
from glotmill.functions.text import fold_accents
from glotmill.lexicon import V1_ENGLISH, V1_EXCLUDE, V1_PINYIN, V1_SUFFIX


def is_english_like(token: Column) -> Column:
    low = F.lower(token)
    return token.rlike("^[A-Za-z]+$") & (F.length(token) > 2) & (low.isin(V1_ENGLISH) | (~low.isin(V1_EXCLUDE) & low.rlike(V1_SUFFIX)))


def chinese_tokens(text: Column, folded: Column) -> Column:
    """Runs of Han, then the label of each pinyin phrase in the folded text, once. One pass tells whether any is there."""
    pattern = {p: r"\s*".join(p.split()) for p in V1_PINYIN}
    found = F.array_compact(F.array(*[F.when(folded.rlike(rf"(?U)\b{r}\b"), F.lit(p)) for p, r in pattern.items()]))
    some = folded.rlike(rf"(?U)\b(?:{'|'.join(pattern.values())})\b")
    return F.concat(T.every(text, T.HAN_RUN), F.when(some, found).otherwise(F.expr("cast(array() as array<string>)")))


def annotate(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the eighteen v1 columns; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lists = df.withColumn("__folded", fold_accents(text)).withColumns(
        {
            "__words": T.every(text, T.TOKEN_V1), "__zh": chinese_tokens(text, F.col("__folded")),
            "__other": F.concat(T.every(text, T.HANGUL_RUN), T.every(text, T.KANA_RUN)),
        }
    ).withColumn("__en", F.filter("__words", is_english_like))
    joined = lambda c: F.array_join(F.slice(c, 1, 20), ", ")
    n, en, zh, other = F.size("__words"), F.size("__en"), F.size("__zh"), F.size("__other")
    langs = F.array_compact(F.array(F.when(en > 0, F.lit("en")), F.when(zh > 0, F.lit("zh")), F.when(other > 0, F.lit("other"))))
    group = (
        F.when(F.size(langs) == 0, "pure_vi").when(F.size(langs) > 1, "multi_mixed")
        .when(en > 0, "english_mixed").when(zh > 0, "chinese_mixed").otherwise("other_foreign")
    )
    return lists.withColumns(
        {
            "num_tokens": n, "has_vietnamese_diacritic": text.rlike(T.VIET), "has_english": en > 0, "english_count": en,
            "english_ratio": en / F.greatest(n, F.lit(1)), "english_tokens": joined("__en"), "has_chinese": zh > 0, "chinese_count": zh,
            "chinese_tokens": joined("__zh"), "has_other_foreign": other > 0, "other_foreign_tokens": joined("__other"), "foreign_langs": F.array_join(langs, ", "),
            "emoji_count": T.count_of(text, T.EMOJI_V1), "url_count": T.count_of(text, T.URL.removeprefix("(?i)")), "mention_count": T.count_of(text, T.MENTION_V1),
            "hashtag_count": T.count_of(text, T.HASHTAG), "is_code_switched": F.size(langs) > 0, "cs_group": group,
        }
    ).drop("__words", "__zh", "__other", "__en", "__folded")
