"""Detector v3: annotations from a language model's cache, filtered by rules and merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.functions import tokens as T
from glotmill.functions.text import fold_accents
from glotmill.lexicon import V3_COMMON, V3_KEEP, strip_marks, unique

CACHE_SCHEMA = "id string, text string, _tag string, has_cs boolean, langs array<string>, tokens array<struct<text:string,type:string,gloss:string>>, confidence double, _seq bigint"
STRICT_TYPES = ["english", "chinese_script", "chinese_translit", "other_foreign"]
COUNTS = ["n_english", "n_chinese", "n_translit", "n_loanword", "n_proper_noun", "n_cs_tokens"]


def keep_last(cache: DataFrame, tag: str | None = None) -> DataFrame:
    """Of each (id, _tag) the entry written last, the greatest ``_seq`` (a number or a struct of several parts).

    One aggregation, so a hot id is combined before the shuffle. Of entries with one ``_seq`` the same one stays each time.
    """
    rows = cache if tag is None else cache.where(F.col("_tag") == tag)
    entry = F.struct(*[c for c in cache.columns if c not in ("id", "_tag")])
    return rows.groupBy("id", "_tag").agg(F.max_by(entry, F.struct(F.col("_seq"), F.xxhash64(entry))).alias("r")).select("id", "_tag", "r.*")


def to_do(df: DataFrame, cache: DataFrame, tag: str, id_col: str = "id") -> DataFrame:
    """Rows without an entry for the tag."""
    done = cache.where(F.col("_tag") == tag).select(F.col("id").alias("__done")).distinct()
    return df.join(done, df[id_col].cast("string") == F.col("__done"), "left_anti")


def cache_status(df: DataFrame, cache: DataFrame, tag: str, id_col: str = "id") -> DataFrame:
    """One row with the numbers of rows done, needed and missing."""
    done = cache.where(F.col("_tag") == tag).select(F.col("id").alias("__done")).distinct()
    marked = df.join(done, df[id_col].cast("string") == F.col("__done"), "left")
    return marked.agg(F.count("__done").alias("done"), F.count(F.lit(1)).alias("needed"), F.count_if(F.col("__done").isNull()).alias("missing"))


def _bare_too(words) -> list[str]:
    """Words with and without their diacritics."""
    return unique([*words, *map(strip_marks, words)])


def is_vietnamese_word(word: Column, more_english: Column | None = None, common=tuple(V3_COMMON), keep=tuple(V3_KEEP)) -> Column:
    """D29; ``more_english`` says where a frequency list finds the word far commoner in English."""
    low = F.lower(F.trim(word))
    syllable = T.is_syllable(low) if more_english is None else T.is_syllable(low) & ~more_english
    return F.when(low == "", False).when(low.isin(list(keep)), False).otherwise(low.rlike(T.VIET) | low.isin(_bare_too(common)) | syllable)


def checked_type(token: Column, common=tuple(V3_COMMON), keep=tuple(V3_KEEP)) -> Column:
    """The type after the rules, null where the token is dropped; ``common`` and ``keep`` are word lists of D29."""
    text, gloss, kind = F.trim(F.coalesce(token["text"], F.lit(""))), F.coalesce(token["gloss"], F.lit("")), F.coalesce(token["type"], F.lit(""))
    parts = F.filter(F.split(text, r"[\s\-_/]+"), lambda p: p != "")
    upper = F.substring(text, 1, 1) != F.lower(F.substring(text, 1, 1))
    han = rf"{T.SCRIPTS['chinese_script']}"
    english = (
        F.when(text.rlike(T.VIET), F.when(upper, "proper_noun"))
        .when(~F.forall(parts, lambda p: p.rlike("^[A-Za-z]+$")), None)
        .when(F.forall(parts, lambda p: is_vietnamese_word(p, None, common, keep)), F.when(upper & (F.size(parts) >= 2), "proper_noun"))
        .when(F.length(text) > 2, "english")
    )
    listed = _bare_too(common)
    is_common = lambda w: w.isin(listed) | fold_accents(w).isin(listed)
    foreign = (
        F.when(text.rlike(han), "chinese_script")
        .when(F.forall(parts, lambda p: is_common(F.lower(p))) | is_common(F.lower(text)), None)
        .when((kind == "chinese_translit") & ~gloss.rlike(han), None)
        .otherwise(kind)
    )
    return (
        F.when(text == "", None).when(kind == "english", english).when(kind == "chinese_script", F.when(text.rlike(han), kind))
        .when(kind.isin("chinese_translit", "other_foreign"), foreign).otherwise(kind)
    )


def clean_cache(cache: DataFrame, common=tuple(V3_COMMON), keep=tuple(V3_KEEP)) -> DataFrame:
    """Rules on every token, then has_cs and the sorted languages anew; word lists as in ``checked_type``."""
    empty = F.expr("cast(array() as array<struct<text:string,type:string,gloss:string>>)")
    typed = F.transform(F.coalesce("tokens", empty), lambda t: F.struct(t["text"].alias("text"), checked_type(t, common, keep).alias("type"), t["gloss"].alias("gloss")))
    strict = F.filter("tokens", lambda t: t["type"].isin(STRICT_TYPES))
    lang = lambda t: F.when(t["type"].contains("chinese"), "zh").when(t["type"] == "english", "en").otherwise("other")
    return cache.withColumn("tokens", F.filter(typed, lambda t: t["type"].isNotNull())).withColumns({"has_cs": F.size(strict) > 0, "langs": F.array_sort(F.array_distinct(F.transform(strict, lang)))})


def summarise(cache: DataFrame, min_confidence: float = 0.5, count_loanword: bool = False) -> DataFrame:
    """One row of counts and joined tokens per cache entry."""
    kept = [*STRICT_TYPES, *(["loanword_naturalized"] if count_loanword else [])]
    texts = lambda *types: F.transform(F.filter("tokens", lambda t: t["type"].isin(list(types))), lambda t: F.coalesce(t["text"], F.lit("")))
    # tokens stand by type, types in the order in which the entry has them
    order = F.array_distinct(F.transform("tokens", lambda t: t["type"]))
    by_type = F.flatten(F.transform(F.filter(order, lambda k: k.isin(kept)), lambda k: F.transform(F.filter("tokens", lambda t: t["type"] == k), lambda t: F.coalesce(t["text"], F.lit("")))))
    conf = F.coalesce("confidence", F.lit(0.0))
    has = F.coalesce("has_cs", F.lit(False)) & (conf >= min_confidence)
    has = has | (F.size(texts("loanword_naturalized")) > 0) if count_loanword else has
    rows = cache.withColumn("tokens", F.coalesce("tokens", F.expr("cast(array() as array<struct<text:string,type:string,gloss:string>>)")))
    return rows.select(
        F.col("id").cast("string").alias("id"), (has & (F.size(by_type) > 0)).alias("llm_has_cs"), conf.alias("llm_confidence"), F.concat_ws(",", "langs").alias("llm_langs"),
        F.size(texts("english")).alias("n_english"), F.size(texts("chinese_script", "chinese_translit")).alias("n_chinese"),
        F.size(texts("chinese_translit", "other_foreign")).alias("n_translit"), F.size(texts("loanword_naturalized")).alias("n_loanword"),
        F.size(texts("proper_noun")).alias("n_proper_noun"), F.size(by_type).alias("n_cs_tokens"), F.array_join(F.slice(by_type, 1, 20), " | ").alias("cs_tokens"),
        F.array_join(F.slice(texts("english"), 1, 20), " ").alias("english_tokens"),
        F.array_join(F.slice(F.concat(texts("chinese_script"), texts("chinese_translit")), 1, 20), " ").alias("chinese_tokens"),
    )


def merge(df: DataFrame, features: DataFrame, id_col: str = "id", heavy_min: int = 3, heavy_ratio: float = 0.25) -> DataFrame:
    """Annotations with the cache's features; rows without an entry are not code-switched.

    ``features`` has one row per id (see ``keep_last``). Confidence stays null for rows without an entry.
    """
    new = [c for c in features.columns if c != "id"]
    base = df.drop(*[c for c in new if c in df.columns]).withColumn(id_col, F.col(id_col).cast("string"))
    joined = base.join(features.withColumnRenamed("id", "__fid"), F.col(id_col) == F.col("__fid"), "left").drop("__fid")
    filled = joined.withColumns({"llm_has_cs": F.coalesce("llm_has_cs", F.lit(False)), **{c: F.coalesce(c, F.lit(0)) for c in COUNTS}})
    words = F.col("n_word_tokens") if "n_word_tokens" in df.columns else F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
    strict, ratio = F.col("llm_has_cs"), F.col("n_cs_tokens") / F.greatest(words, F.lit(1))
    group = (
        F.when(strict & (F.col("n_chinese") > 0), "chinese_mixed").when(strict, "english_mixed").when(flag("has_teencode"), "teencode_slang")
        .when(flag("has_emoji"), "emoji_only").when(flag("has_noise"), "other_noise").otherwise("pure_vi")
    )
    level = F.when(~strict, "none").when((F.col("n_cs_tokens") >= heavy_min) | (ratio >= heavy_ratio), "heavy").otherwise("light")
    return filled.withColumns({"english_ratio": ratio, "is_cs_strict": strict, "is_cs_broad": strict | flag("has_teencode"), "cs_group": group, "cs_level": level})


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with n, the four cells, agreement and Cohen's kappa of two flags."""
    x, y = F.coalesce(F.col(a).cast("boolean"), F.lit(False)), F.coalesce(F.col(b).cast("boolean"), F.lit(False))
    cells = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("both_true"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    po = (F.col("both_true") + F.col("neither")) / F.col("n")
    pa, pb = (F.col("both_true") + F.col("only_a")) / F.col("n"), (F.col("both_true") + F.col("only_b")) / F.col("n")
    pe = pa * pb + (1 - pa) * (1 - pb)
    return cells.withColumns({"agreement": po, "kappa": F.when(pe < 1, (po - pe) / (1 - pe))})


def two_annotators(cache: DataFrame, tag_a: str, tag_b: str) -> DataFrame:
    """Agreement of two tags on the ids that both have."""
    side = lambda tag, name: keep_last(cache, tag).select("id", F.col("has_cs").alias(name))
    return agreement(side(tag_a, "a").join(side(tag_b, "b"), "id"), "a", "b")


def review_score(df: DataFrame, gold: str = "gold_has_cs", group: str = "cs_group") -> DataFrame:
    """Precision, recall and F1 over rows whose gold column is 0 or 1."""
    g, p = F.trim(F.col(gold).cast("string")), F.col(group).isin("english_mixed", "chinese_mixed")
    c = df.where(g.isin("0", "1")).agg(F.count(F.lit(1)).alias("n"), F.count_if((g == "1") & p).alias("tp"), F.count_if((g == "0") & p).alias("fp"), F.count_if((g == "1") & ~p).alias("fn"))
    c = c.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))})
    return c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))


def parse_response(raw: Column) -> Column:
    """The annotations in a model's answer: fences and reasoning go, then the outer list, or a list within an object."""
    plain = F.regexp_replace(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    item = "array<struct<id:string,has_cs:boolean,langs:array<string>,tokens:array<struct<text:string,type:string,gloss:string>>,confidence:double>>"
    outer = F.from_json(F.regexp_extract(plain, r"(?s)\[.*\]", 0), item)
    keys = ["results", "data", "items", "output", "sentences"]
    inner = F.from_json(F.regexp_extract(plain, r"(?s)\{.*\}", 0), "struct<" + ",".join(f"{k}:{item}" for k in keys) + ">")
    return F.coalesce(*[inner[k] for k in keys], outer)


def prompt_of(batch: list[tuple[str, str]], examples: list[tuple[str, dict]]) -> str:
    """Worked examples, then one JSON line for each row (id, text) of the batch."""
    import json

    written = lambda o: json.dumps(o, ensure_ascii=False)
    shown = "".join(f"Text: {t}\nJSON: {written(o)}\n" for t, o in examples)
    asked = "\n".join(written({"id": str(i), "text": t}) for i, t in batch)
    return f"{shown}\nAnswer with a JSON array of {len(batch)} objects, one for each line, with its id:\n{asked}"


def aligned(ids: list[str], answers: list[dict]) -> list[dict]:
    """Each id's answer: the one that carries the id, else the one in its place."""
    by_id = {str(a.get("id")): a for a in answers}
    return [by_id.get(k, answers[i]) for i, k in enumerate(ids)]


def annotate_with(df: DataFrame, backend: Callable[[list[str]], list[dict]], tag: str, id_col: str = "id", batch: int = 15, attempts: int = 3) -> DataFrame:
    """Annotations from any backend (texts in, one dict a text out), in batches.

    Answers go to their rows by id, else by place. An answer of another length, or one that fails, is asked for again
    after 1, 2, 4 and so on seconds; a batch without answer after ``attempts`` times gives no rows, so that ``to_do``
    finds them again, and a warning in the task's log.
    """

    def run(frames: Iterator) -> Iterator:
        import logging
        import time

        import pandas as pd

        for f in frames:
            out, failed, why = [], 0, ""
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                for attempt in range(attempts):
                    try:
                        answers = backend(part["text"].tolist())
                    except Exception as e:  # whatever a remote backend raises
                        answers, said = [], repr(e)
                    else:
                        said = f"{len(answers)} answers for {len(part)} rows"
                    if len(answers) == len(part):
                        answers = aligned(part["id"].tolist(), answers)
                        out += [{"id": k, "text": t, "_tag": tag, "has_cs": bool(a.get("has_cs")), "langs": a.get("langs") or [], "tokens": a.get("tokens") or [], "confidence": float(a.get("confidence") or 0)} for k, t, a in zip(part["id"], part["text"], answers)]
                        break
                    if attempt == attempts - 1:
                        failed, why = failed + len(part), said
                    else:
                        time.sleep(2**attempt)
            if failed:
                logging.getLogger(__name__).warning("no annotations for %d of %d rows: %s", failed, len(f), why)
            yield pd.DataFrame(out, columns=["id", "text", "_tag", "has_cs", "langs", "tokens", "confidence"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, CACHE_SCHEMA.removesuffix(", _seq bigint"))


