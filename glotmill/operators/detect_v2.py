"""Detector v2: token classes by lexicon and phonotactics.

Rows are annotated where they are: classes are an expression over the row's tokens, lexicons are hash sets in the plan,
and nothing is shuffled. ``classify_distinct`` is the other way round for corpora with few distinct words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.functions import tokens as T
from glotmill.functions.text import collapse_letters, fold_accents, shorten_runs
from glotmill.lexicon import DetectorConfig
from glotmill.operators.lineage import kept

COLUMNS = (
    "n_chars n_tokens n_word_tokens has_diacritics diacritic_ratio n_english english_ratio english_tokens n_english_guess english_guess_tokens n_teencode "
    "teencode_ratio teencode_tokens n_laugh laugh_tokens n_foreign_other foreign_other_tokens n_emoji n_url n_mention n_hashtag n_non_latin has_english "
    "has_teencode has_emoji has_noise is_cs_strict is_cs_broad cs_group cs_level"
).split()


def spelled(token: Column) -> Column:
    """A token with its lower-case form and, where a letter stands three times or more in a row, two shorter spellings."""
    return _with_runs(_lowered(token))


def _lowered(token: Column) -> Column:
    return F.struct(token.alias("w"), F.lower(token).alias("low"))


def _with_runs(word: Column) -> Column:
    """The spellings of a struct from ``_lowered``; apart, as values within a row's function are computed at each mention."""
    low = word["low"]
    long = (F.length(low) > 2) & low.rlike(r"(.)\1\1")
    return F.struct(word["w"].alias("w"), low.alias("low"), F.when(long, F.struct(shorten_runs(low).alias("twice"), collapse_letters(low).alias("once"))).alias("runs"))


def classify(word: Column, config: DetectorConfig = DetectorConfig(), known_by_table: Column | None = None) -> Column:
    """D8 for a struct from ``spelled``; computing spellings once keeps the decision list to set lookups and short patterns.

    ``known_by_table`` says whether a lexicon table has one of the word's spellings, beside the lists of ``config``.
    """
    token, low, runs = word["w"], word["low"], word["runs"]
    teen, lexicon = config.teencode_lexicon, config.english_lexicon
    # a run of three or more gives two more spellings to look up; other words only have their own
    some = lambda test: test(low) | F.when(runs.isNotNull(), test(runs["twice"]) | test(runs["once"])).otherwise(False)
    marked = low.isin(teen) if config.strict_teencode else low.isin(teen) | fold_accents(low).isin(teen)
    # lengths and first letters are cheap and spare most words the patterns that no such word can match
    shape, known = some(lambda w: (F.length(w) <= T.LONGEST_SYLLABLE) & T.is_plain_syllable(w)), some(lambda w: w.isin(lexicon))
    laugh = F.substring(low, 1, 1).isin(list(T.LAUGH_STARTS)) & T.is_laugh(low)
    known = known if known_by_table is None else known | (F.coalesce(known_by_table, F.lit(False)) & ~low.isin(list(config.blacklist)))
    return (
        F.when((F.octet_length(low) > F.length(low)) | ~low.rlike("^[a-z]+$"), F.when(token.rlike(T.VIET), F.when(marked, "teencode").otherwise("vi")).otherwise("other"))
        .when(laugh, "laugh")
        .when(some(lambda w: w.isin(teen)), "teencode")
        .when(low.isin(list(config.blacklist)), "vi")
        .when(some(lambda w: w.isin(list(config.loans))), "en")
        .when(known, F.when(shape, "en_ambiguous").otherwise("en"))
        .when(shape, "vi")
        .when(F.length(low) < 3, "other")
        .when(F.substring(token, 1, 1) != F.substring(low, 1, 1), "foreign")
        .otherwise("en_guess")
    )


def classify_token(token: Column, config: DetectorConfig = DetectorConfig()) -> Column:
    """Vi, en, en_ambiguous, en_guess, teencode, laugh, foreign or other; the first rule that holds decides."""
    return classify(spelled(token), config)


def classify_distinct(df: DataFrame, text_col: str = "text", config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(token, class, n): every distinct word token with its class and frequency."""
    words = df.select(F.explode(T.word_tokens(T.tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("__w", spelled(F.col("token"))).withColumn("class", classify(F.col("__w"), config)).drop("__w")


def top_words(frequencies: DataFrame, top_n: int = 30_000, least_length: int = 3, word: str = "word", count: str = "n") -> DataFrame:
    """The lexicon (column w) of the ``top_n`` commonest lower-cased words of letters, ties to the smaller word.

    Other entries of the frequency table do not count towards ``top_n``. A partial limit runs before the shuffle.
    """
    low = frequencies.groupBy(F.lower(word).alias("w")).agg(F.sum(count).alias("n"))
    return low.where(F.col("w").rlike(r"^\p{L}+$") & (F.length("w") >= least_length)).orderBy(F.desc("n"), "w").limit(top_n).select("w")


def classify_by_table(df: DataFrame, lexicon: DataFrame, text_col: str = "text", config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(token, class, n) like ``classify_distinct``, with a lexicon table (column w) of any size beside the short lists.

    Every distinct token is looked up once, by all its spellings, in a join; the plan does not grow with the lexicon.
    """
    words = df.select(F.explode(T.word_tokens(T.tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("token"))
    distinct = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("__w", spelled(F.col("token")))
    spellings = F.array_distinct(F.array_compact(F.array("__w.low", "__w.runs.twice", "__w.runs.once")))
    asked = distinct.select("token", "n", "__w", F.explode(spellings).alias("__spelling"))
    known = lexicon.select(F.col("w").alias("__spelling"), F.lit(True).alias("__known")).distinct()
    met = asked.join(known, "__spelling", "left").groupBy("token", "n", "__w").agg(F.max(F.coalesce("__known", F.lit(False))).alias("__known"))
    return met.select("token", classify(F.col("__w"), config, F.col("__known")).alias("class"), "n")


#: Classes of so many of the commonest tokens are sent to all tasks; rarer tokens meet theirs in a join.
COMMONEST = 50_000


def annotate_by_table(df: DataFrame, lexicon: DataFrame, id_col: str = "id", text_col: str = "text", config: DetectorConfig = DetectorConfig(), commonest: int = COMMONEST) -> DataFrame:
    """``annotate`` with a lexicon table (J6). ``id_col`` tells rows apart; rows with a null id get the columns of an empty text.

    Tokens are classified once each. A row's tokens meet their classes by a bounded broadcast table of the commonest
    tokens, which hold most occurrences and all hot keys, and by a join for the rest.
    """
    classes = kept(classify_by_table(df, lexicon, text_col, config))
    often = classes.orderBy(F.desc("n"), "token").limit(commonest)
    words = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.posexplode(T.word_tokens(T.tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("__at", "token"))
    first = words.join(F.broadcast(often.select("token", F.col("class").alias("__k"))), "token", "left")
    rest = first.where("__k is null").drop("__k").join(classes.select("token", F.col("class").alias("__k")), "token")
    placed = first.where("__k is not null").unionByName(rest)
    # in the order of the text
    kinds = placed.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), F.col("token").alias("w"), F.col("__k").alias("k")))).alias("__placed"))
    joined = df.join(kinds, df[id_col] == kinds["__id"], "left").drop("__id")
    empty = F.expr("cast(array() as array<struct<w:string,k:string>>)")
    lists = joined.withColumn("__kinds", F.coalesce(F.transform("__placed", lambda x: F.struct(x["w"].alias("w"), x["k"].alias("k"))), empty)).drop("__placed")
    lists = lists.withColumn("__tokens", F.when(F.col(id_col).isNull(), F.expr("cast(array() as array<string>)")).otherwise(T.tokens(F.coalesce(F.col(text_col), F.lit("")))))
    return _features(lists.withColumn("__words", F.transform("__kinds", lambda x: x["w"])), df.columns, text_col, config)


def annotate(df: DataFrame, text_col: str = "text", config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Adds the thirty v2 columns; a null text gives zeros, empty strings, ``pure_vi`` and ``none``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lists = df.withColumn("__tokens", T.tokens(text)).withColumn("__words", T.word_tokens(F.col("__tokens")))
    lists = lists.withColumn("__kinds", F.transform(F.transform(F.transform("__words", _lowered), _with_runs), lambda x: F.struct(x["w"].alias("w"), classify(x, config).alias("k"))))
    return _features(lists, df.columns, text_col, config)


def _features(lists: DataFrame, columns: list[str], text_col: str, config: DetectorConfig) -> DataFrame:
    """D9 to D12 from the row's tokens, words and their classes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = lambda kind: F.transform(F.filter("__kinds", lambda x: x["k"] == kind), lambda x: x["w"])
    lists = lists.withColumns({f"__{k}": of(k) for k in ("en", "en_ambiguous", "en_guess", "teencode", "laugh", "foreign")})
    # words of either language count as English beside a sure English word, and stand after the sure ones
    lists = lists.withColumn("__sure", F.when(F.size("__en") > 0, F.concat("__en", "__en_ambiguous")).otherwise(F.col("__en")))
    n_words = F.size("__words")
    share = lambda n: n / F.greatest(F.col("n_word_tokens"), F.lit(1))
    joined = lambda c, k: F.array_join(F.slice(c, 1, k), " ")
    lower = lambda c: F.transform(c, F.lower)
    counts = lists.withColumns(
        {
            "n_chars": F.length(text), "n_tokens": F.size("__tokens"), "n_word_tokens": n_words, **T.noise_counts(text), "__marks": T.diacritics(text),
            "n_english": F.size("__sure") + (F.size("__en_guess") if config.count_guess_as_english else F.lit(0)), "n_english_guess": F.size("__en_guess"),
            "n_teencode": F.size("__teencode"), "n_laugh": F.size("__laugh"), "n_foreign_other": F.size("__foreign"),
            "english_tokens": joined("__sure", 30), "english_guess_tokens": joined("__en_guess", 30), "teencode_tokens": joined(lower("__teencode"), 30),
            "laugh_tokens": joined(lower("__laugh"), 20), "foreign_other_tokens": joined("__foreign", 20),
        }
    )
    ratios = counts.withColumns({"english_ratio": share(F.col("n_english")), "teencode_ratio": share(F.col("n_teencode")), "diacritic_ratio": F.col("__marks") / F.greatest("n_chars", F.lit(1)), "has_diacritics": F.col("__marks") > 0})
    flags = ratios.withColumns(
        {
            "has_english": (F.col("n_english") >= config.min_english_count) & (F.col("english_ratio") >= config.min_english_ratio), "has_teencode": F.col("n_teencode") > 0,
            "has_emoji": F.col("n_emoji") > 0, "has_noise": F.col("n_url") + F.col("n_mention") + F.col("n_hashtag") > 0,
        }
    )
    done = flags.withColumns(
        {
            "is_cs_strict": F.col("has_english"), "is_cs_broad": F.col("has_english") | F.col("has_teencode"),
            "cs_group": F.when(F.col("has_english"), "english_mixed").when(F.col("has_teencode"), "teencode_slang").when(F.col("has_emoji"), "emoji_only")
            .when(F.col("has_noise") | (F.col("n_laugh") > 0), "other_noise").otherwise("pure_vi"),
            "cs_level": F.when(~F.col("has_english"), "none").when((F.col("english_ratio") >= config.heavy_ratio) | (F.col("n_english") >= config.heavy_count), "heavy").otherwise("light"),
        }
    )
    return done.select(*[F.col(c) for c in columns if c not in COLUMNS], *COLUMNS)
