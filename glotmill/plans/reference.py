"""Queries over the standard tables with their SQL. Documents stand for comments; splits come from the id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotmill.functions import text as X
from glotmill.functions import tokens as T
from glotmill.functions.labels import multi_hot, parse_label_list, primary_label
from glotmill.lexicon import TEEN_WORDS
from glotmill.operators import detect_v1, detect_v2, detect_v3, metrics, stats, subsets
from glotmill.operators.lineage import kept
from glotmill.plans import sql as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores is dealt over the cores before work per row; larger ones are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def docs(spark: SparkSession, sf: str) -> DataFrame:
    r = F.pmod("doc_id", F.lit(10))
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "text", F.when(r == 8, "val").when(r == 9, "test").otherwise("train").alias("split"))


def v1(spark: SparkSession, sf: str) -> DataFrame:
    return detect_v1.annotate(docs(spark, sf))


def v2(spark: SparkSession, sf: str) -> DataFrame:
    return detect_v2.annotate(docs(spark, sf)).withColumnRenamed("doc_id", "id")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Detector v1


@query(f"WITH {S.V1} SELECT doc_id, num_tokens, has_vietnamese_diacritic, english_count, round(english_ratio, 6) AS english_ratio, english_tokens, chinese_tokens, is_code_switched, cs_group FROM v1")
def v1_annotate_docs(spark, sf):
    return rounded(v1(spark, sf), "english_ratio").select("doc_id", "num_tokens", "has_vietnamese_diacritic", "english_count", "english_ratio", "english_tokens", "chinese_tokens", "is_code_switched", "cs_group")


_V1_FLAGS = {"code_switched": "is_code_switched", "has_english": "has_english", "has_chinese": "has_chinese", "has_other_foreign": "has_other_foreign"}


@query(
    f"WITH {S.V1} SELECT split, count(*) AS n, {', '.join(f'count_if({c}) AS {a}' for a, c in _V1_FLAGS.items())}, round(avg(english_ratio), 6) AS avg_english_ratio, "
    f"{', '.join(f'round(100 * count_if({c}) / count(*), 6) AS {a}_pct' for a, c in _V1_FLAGS.items())} FROM v1 GROUP BY split"
)
def v1_summary_by_split(spark, sf):
    return rounded(stats.summary_v1(v1(spark, sf)), "avg_english_ratio", *[f"{a}_pct" for a in _V1_FLAGS])


@query(f"WITH {S.V1}, t AS (SELECT unnest(string_split(english_tokens, ',')) AS x FROM v1) SELECT lower(trim(x)) AS token, count(*) AS count FROM t WHERE trim(x) <> '' GROUP BY 1 ORDER BY count DESC, token LIMIT 50")
def v1_top_english_tokens(spark, sf):
    return stats.top_tokens(v1(spark, sf), "english_tokens", 50, ",", lower=True)


@query(f"WITH {S.V1}, c AS (SELECT coalesce(split, 'All') AS split, coalesce(cs_group, 'All') AS g, count(*) AS n FROM v1 GROUP BY CUBE (split, cs_group)) SELECT split, {', '.join(f'''coalesce(sum(n) FILTER (WHERE g = '{g}'), 0)::BIGINT AS "{g}"''' for g in ('pure_vi', 'english_mixed', 'chinese_mixed', 'other_foreign', 'multi_mixed', 'All'))} FROM c GROUP BY split")
def v1_group_crosstab(spark, sf):
    return stats.crosstab(v1(spark, sf), "split", "cs_group", ["pure_vi", "english_mixed", "chinese_mixed", "other_foreign", "multi_mixed"])


# Detector v2


@query(f"WITH {S.TOKENS} SELECT doc_id, len(tokens) AS n_tokens, len(words) AS n_word_tokens FROM tok")
def v2_token_counts(spark, sf):
    found = docs(spark, sf).select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return found.select("doc_id", F.size("t").alias("n_tokens"), F.size(T.word_tokens(F.col("t"))).alias("n_word_tokens"))


@query(f"WITH {S.DOCS} SELECT doc_id, len(regexp_extract_all(text, '(?i)[{S.VIET_CHARS}]')) AS n_marks, round(len(regexp_extract_all(text, '(?i)[{S.VIET_CHARS}]')) / greatest(length(text), 1), 6) AS diacritic_ratio FROM docs")
def v2_diacritic_ratio(spark, sf):
    d = docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rounded(d.select("doc_id", T.diacritics(F.col("text")).alias("n_marks"), (T.diacritics(F.col("text")) / F.greatest(F.length("text"), F.lit(1))).alias("diacritic_ratio")), "diacritic_ratio")


@query(f"WITH {S.TOKENS}, d AS (SELECT DISTINCT t FROM (SELECT unnest(words) AS t FROM tok)) SELECT t AS token, {S.is_syllable('strip_accents(lower(t))')} AS is_syllable FROM d")
def v2_syllable_check(spark, sf):
    words = docs(spark, sf).select(F.explode(T.word_tokens(T.tokens(F.coalesce("text", F.lit(""))))).alias("token")).distinct()
    return words.select("token", T.is_syllable(F.col("token")).alias("is_syllable"))


@query(f"WITH {S.TOKENS}, d AS (SELECT unnest(words) AS t FROM tok) SELECT lower(t) AS token, count(*) AS n FROM d WHERE regexp_matches(lower(t), '{S.LAUGH}') GROUP BY 1")
def v2_laugh_tokens(spark, sf):
    words = docs(spark, sf).select(F.explode(T.word_tokens(T.tokens(F.coalesce("text", F.lit(""))))).alias("token"))
    return words.where(T.is_laugh(F.col("token"))).groupBy(F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.CLASSES} SELECT t AS token, n, class FROM cls")
def v2_classify_distinct(spark, sf):
    return detect_v2.classify_distinct(docs(spark, sf))


_V2 = ["n_tokens", "n_word_tokens", "n_english", "english_tokens", "n_english_guess", "n_teencode", "teencode_tokens", "n_laugh", "laugh_tokens", "n_foreign_other", "n_emoji", "n_url", "n_mention", "n_hashtag", "is_cs_strict", "is_cs_broad", "cs_group", "cs_level"]


@query(f"WITH {S.V2} SELECT doc_id AS id, {', '.join(_V2)}, round(english_ratio, 6) AS english_ratio, round(teencode_ratio, 6) AS teencode_ratio, round(diacritic_ratio, 6) AS diacritic_ratio FROM v2")
def v2_annotate_docs(spark, sf):
    return rounded(v2(spark, sf), "english_ratio", "teencode_ratio", "diacritic_ratio").select("id", *_V2, "english_ratio", "teencode_ratio", "diacritic_ratio")


_GROUPS = ["pure_vi", "english_mixed", "teencode_slang", "emoji_only", "other_noise"]


@query(f"WITH {S.V2}, c AS (SELECT coalesce(split, 'All') AS split, coalesce(cs_group, 'All') AS g, count(*) AS n FROM v2 GROUP BY CUBE (split, cs_group)) SELECT split, {', '.join(f'''coalesce(sum(n) FILTER (WHERE g = '{g}'), 0)::BIGINT AS "{g}"''' for g in [*_GROUPS, 'All'])} FROM c GROUP BY split")
def v2_group_crosstab(spark, sf):
    return stats.crosstab(v2(spark, sf), "split", "cs_group", _GROUPS)


_V2_FLAGS = {"cs_strict": "is_cs_strict", "cs_broad": "is_cs_broad", "has_english": "has_english", "has_teencode": "has_teencode", "has_emoji": "has_emoji"}


@query(
    f"WITH {S.V2} SELECT split, count(*) AS n, {', '.join(f'count_if({c}) AS {a}' for a, c in _V2_FLAGS.items())}, count_if(n_laugh > 0) AS has_laugh, round(avg(english_ratio), 6) AS avg_english_ratio, "
    f"round(avg(teencode_ratio), 6) AS avg_teencode_ratio, round(avg(n_word_tokens), 6) AS avg_word_tokens, {', '.join(f'round(100 * count_if({c}) / count(*), 6) AS {a}_pct' for a, c in _V2_FLAGS.items())} FROM v2 GROUP BY split"
)
def v2_summary_by_split(spark, sf):
    return rounded(stats.summary_v2(v2(spark, sf)), "avg_english_ratio", "avg_teencode_ratio", "avg_word_tokens", *[f"{a}_pct" for a in _V2_FLAGS])


@query(f"WITH {S.V2}, t AS (SELECT unnest(string_split(english_tokens, ' ')) AS token FROM v2) SELECT token, count(*) AS count FROM t WHERE token <> '' GROUP BY token ORDER BY count DESC, token LIMIT 200")
def v2_top_english_tokens(spark, sf):
    return stats.top_tokens(v2(spark, sf), "english_tokens", 200)


# Labels and tiers


def labelled(spark, sf) -> DataFrame:
    """Annotations with a two-label vocabulary (quality, toxic) from ``labels``; documents without labels have none."""
    lab = read(spark, sf, "labels").select(F.col("doc_id").alias("lid"), F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit(0)), F.when(F.col("toxic") == 1, F.lit(1)))).alias("label_ids"))
    d = v2(spark, sf)
    # queries over this use it several times; what is kept is narrow
    d = kept(d.select("id", "split", "n_word_tokens", "english_ratio", "is_cs_strict", "is_cs_broad", "cs_group", "cs_level"))
    joined = d.join(lab, d["id"] == lab["lid"], "left").drop("lid").withColumn("label_ids", F.coalesce("label_ids", F.expr("cast(array() as array<int>)")))
    return joined.withColumns({"n_labels": F.size("label_ids"), "primary_label": primary_label(F.col("label_ids"))})


_LABELLED = f"""{S.V2}, rows_ AS (SELECT v2.*, coalesce(list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END], lambda x: x IS NOT NULL), []) AS label_ids,
  CASE WHEN quality = 1 THEN 0 WHEN toxic = 1 THEN 1 ELSE -1 END AS primary_label FROM v2 LEFT JOIN labels USING (doc_id))"""


@query(f"WITH {_LABELLED}, {S.TIERS}, t AS (SELECT subset, split, count(*) AS n, avg(n_word_tokens) AS a, avg(english_ratio) AS e, avg(len(label_ids)) AS l FROM tiers GROUP BY subset, split) SELECT subset, split, n, round(100 * n / max(CASE WHEN subset = 'all' THEN n END) OVER (PARTITION BY split), 6) AS pct_of_split, round(a, 6) AS avg_tokens, round(e, 6) AS avg_english_ratio, round(l, 6) AS avg_labels_per_sample FROM t")
def tier_index(spark, sf):
    return rounded(stats.tier_index(labelled(spark, sf)), "avg_tokens", "avg_english_ratio", "avg_labels_per_sample", "pct_of_split")


@query(f"WITH {_LABELLED}, {S.TIERS} SELECT subset, count_if(split = 'train') AS train, count_if(split = 'val') AS val, count_if(split = 'test') AS test, count(*) AS total FROM tiers GROUP BY subset")
def subset_sizes(spark, sf):
    return stats.subset_sizes(v2(spark, sf))


@query("SELECT doc_id, quality::INT AS l0, toxic::INT AS l1, CASE WHEN quality = 1 THEN 0 WHEN toxic = 1 THEN 1 ELSE -1 END AS primary_label, (quality + toxic)::INT AS n_labels FROM labels")
def label_multihot(spark, sf):
    text = F.concat(F.lit("["), F.concat_ws(", ", F.when(F.col("quality") == 1, F.lit("0")), F.when(F.col("toxic") == 1, F.lit("1"))), F.lit("]"))
    # a vocabulary of 28 tells id lists from one-hot lists
    rows = read(spark, sf, "labels").withColumn("ids", parse_label_list(text))
    hot = multi_hot(F.col("ids"))
    return rows.select("doc_id", hot[0].cast("int").alias("l0"), hot[1].cast("int").alias("l1"), primary_label(F.col("ids")).alias("primary_label"), F.size("ids").alias("n_labels"))


_DIST = f"""{_LABELLED}, {S.TIERS}, grid AS (SELECT * FROM (VALUES ('all'), ('cs_strict'), ('cs_broad'), ('pure_vi')) a(subset), (VALUES (0, 'quality'), (1, 'toxic')) b(label_id, label)),
tot AS (SELECT subset, count(*) AS n_tier FROM tiers GROUP BY subset), sup AS (SELECT subset, unnest(label_ids) AS label_id, count(*) AS support FROM tiers GROUP BY 1, 2),
dist_ AS (SELECT subset, label_id, label, coalesce(support, 0) AS support, coalesce(n_tier, 0) AS n_tier, round(CASE WHEN coalesce(n_tier, 0) = 0 THEN 0 ELSE coalesce(support, 0) / n_tier END, 6) AS ratio FROM grid LEFT JOIN tot USING (subset) LEFT JOIN sup USING (subset, label_id))"""


@query(f"WITH {_DIST} SELECT * FROM dist_")
def label_distribution_by_tier(spark, sf):
    return rounded(stats.label_distribution(labelled(spark, sf), names=["quality", "toxic"]), "ratio")


@query(f"""WITH {_DIST}, w AS (SELECT label_id, label, max(ratio) FILTER (WHERE subset = 'all') AS "all", max(ratio) FILTER (WHERE subset = 'cs_strict') AS cs_strict, max(ratio) FILTER (WHERE subset = 'cs_broad') AS cs_broad, max(ratio) FILTER (WHERE subset = 'pure_vi') AS pure_vi FROM dist_ GROUP BY 1, 2) SELECT *, round(cs_strict - pure_vi, 6) AS cs_minus_pure FROM w""")
def label_shift(spark, sf):
    return rounded(stats.label_shift(rounded(stats.label_distribution(labelled(spark, sf), names=["quality", "toxic"]), "ratio")), "cs_minus_pure")


@query(f"WITH {S.V1}, j AS (SELECT v1.*, coalesce(list_filter([CASE WHEN quality = 1 THEN '0' END, CASE WHEN toxic = 1 THEN '1' END], lambda x: x IS NOT NULL), []) AS ids FROM v1 LEFT JOIN labels USING (doc_id)), e AS (SELECT *, unnest(CASE WHEN len(ids) = 0 THEN ['nan'] ELSE ids END) AS label FROM j) SELECT label, count(*) AS n, count_if(is_code_switched) AS code_switched, count_if(has_english) AS english_mixed, count_if(has_chinese) AS chinese_mixed, round(count_if(is_code_switched) / count(*) * 100, 6) AS code_switched_pct FROM e GROUP BY label")
def cs_by_label(spark, sf):
    lab = read(spark, sf, "labels").select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit(0)), F.when(F.col("toxic") == 1, F.lit(1)))).alias("label_list"))
    return rounded(stats.by_label(v1(spark, sf).join(lab, "doc_id", "left")), "code_switched_pct")


# Text


_COMMON = reduce(lambda x, r: "regexp_replace({}, '{}', '{}', 'g')".format(x, r[0].replace("'", "''"), r[1].replace("'", "''")), X.COMMON_REWRITES[:10], "coalesce(html, '')")
_COMMON = reduce(lambda x, r: "replace({}, '{}', {})".format(x, r[0], "chr(10)" if r[1] == "\n" else "'" + r[1].replace("'", "''") + "'"), X.COMMON_REWRITES[10:], _COMMON)


@query(rf"SELECT page_id, md5(trim(regexp_replace({_COMMON}, '[\s   -     　\x1c-\x1f\x85\x0b]+', ' ', 'g'))) AS clean FROM pages")
def norm_entities_pages(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(X.clean_spaces(X.normalize_common(F.coalesce("html", F.lit(""))))).alias("clean"))


_TEEN = "CASE lower(p) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TEEN_WORDS.items()) + " ELSE p END"


@query(rf"WITH {S.DOCS}, p AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_À-ỹ]+|[^\p{{L}}\p{{N}}_À-ỹ]+') AS parts FROM docs) SELECT doc_id, md5(array_to_string(list_transform(parts, lambda p: {_TEEN}), '')) AS text_norm FROM p")
def norm_teencode(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.replace_words(F.coalesce("text", F.lit("")))).alias("text_norm"))


@query(f"WITH {S.TOKENS}, d AS (SELECT DISTINCT lower(t) AS low FROM (SELECT unnest(words) AS t FROM tok) WHERE regexp_full_match(lower(t), '[a-z]+')) SELECT low AS token, {S._runs('{3,}', 2)} AS twice, {S._runs('+', 1)} AS once FROM d")
def elongation(spark, sf):
    words = docs(spark, sf).select(F.explode(T.word_tokens(T.tokens(F.coalesce("text", F.lit(""))))).alias("t")).select(F.lower("t").alias("token")).where(F.col("token").rlike("^[a-z]+$")).distinct()
    return words.select("token", X.shorten_runs(F.col("token")).alias("twice"), X.collapse_letters(F.col("token")).alias("once"))



# Samples


@query(
    f"""WITH {_LABELLED}, c AS (SELECT split, count_if(is_cs_strict) AS cs, count_if(cs_group = 'pure_vi') AS pure FROM rows_ GROUP BY split), tg AS (SELECT *, least(cs, pure) AS target FROM c WHERE least(cs, pure) > 0),
q AS (SELECT split, primary_label, round_even(count(*) / any_value(cs) * any_value(target), 0)::INT AS quota FROM rows_ JOIN tg USING (split) WHERE is_cs_strict GROUP BY split, primary_label),
r AS (SELECT doc_id, split, quota, md5('42:' || doc_id) AS h, row_number() OVER (PARTITION BY split, primary_label ORDER BY md5('42:' || doc_id), doc_id) AS r FROM rows_ LEFT JOIN q USING (split, primary_label) WHERE cs_group = 'pure_vi'),
t AS (SELECT *, coalesce(r <= quota, false) AS taken FROM r), need AS (SELECT split, any_value(target) - count_if(taken) AS deficit FROM t JOIN tg USING (split) GROUP BY split),
rest AS (SELECT doc_id, row_number() OVER (PARTITION BY split ORDER BY h, doc_id) AS k, deficit FROM t JOIN need USING (split) WHERE NOT taken)
SELECT doc_id AS id, split, primary_label FROM rows_ WHERE doc_id IN (SELECT doc_id FROM t JOIN tg USING (split) WHERE taken UNION ALL SELECT doc_id FROM rest WHERE k <= deficit)"""
)
def matched_control(spark, sf):
    return subsets.matched_control(labelled(spark, sf)).where("control_pure_vi").select("id", "split", "primary_label")


@query(f"WITH {S.V2}, r AS (SELECT doc_id, cs_group, row_number() OVER (PARTITION BY cs_group ORDER BY md5('42:' || doc_id), doc_id) AS r FROM v2) SELECT doc_id AS id, cs_group FROM r WHERE r <= 40")
def stratified_sample(spark, sf):
    return subsets.stratified_sample(v2(spark, sf)).select("id", "cs_group")


@query(
    f"""WITH {S.V2}, d AS (SELECT doc_id, cs_group, {S.pseudo('conf')} AS llm_confidence FROM v2), r AS (SELECT *, row_number() OVER (PARTITION BY cs_group ORDER BY md5('42:' || doc_id), doc_id) AS r FROM d),
w AS (SELECT *, 0 AS r FROM d WHERE llm_confidence BETWEEN 0.01 AND 0.7 ORDER BY md5('43:' || doc_id), doc_id LIMIT 40) SELECT DISTINCT doc_id AS id, cs_group, '' AS gold_has_cs FROM (SELECT * FROM r WHERE r <= 50 UNION ALL SELECT * FROM w)"""
)
def review_sample(spark, sf):
    d = v2(spark, sf).select("id", "cs_group", pseudo("id", "conf").alias("llm_confidence"))
    return subsets.review_sample(d, groups=4).select("id", "cs_group", "gold_has_cs")


# Cache


@query("SELECT conv_id, role, turn, md5(text) AS text_md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def cache_keep_last(spark, sf):
    cache = read(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("_tag"), F.col("turn").alias("_seq"), "text")
    return detect_v3.keep_last(cache).select(F.col("id").alias("conv_id"), F.col("_tag").alias("role"), F.col("_seq").alias("turn"), F.md5("text").alias("text_md5"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def todo_antijoin(spark, sf):
    cache = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("_tag"))
    return detect_v3.to_do(docs(spark, sf), cache, "system", "doc_id").select("doc_id")


CACHE_ROWS = [
    ("0", "a", "t", True, ["en"], [("deadline", "english", ""), ("ok", "english", "")], 0.9, 1),
    ("1", "b", "t", True, ["zh"], [("你好", "chinese_script", ""), ("ni hao", "chinese_translit", "你好"), ("cố lên", "english", "")], 0.8, 2),
    ("2", "c", "t", True, [], [], 0.9, 3),
    ("3", "d", "t", True, ["en"], [("show", "loanword_naturalized", "")], 0.9, 4),
    ("4", "e", "t", True, ["en"], [("Facebook", "proper_noun", ""), ("Ban Mai", "english", "")], 0.3, 5),
    ("5", "f", "t", False, ["other"], [("arigatou", "other_foreign", ""), ("gia đình", "chinese_translit", "家庭")], 0.7, 6),
    ("5", "f", "t", True, ["other"], [("arigatou", "other_foreign", ""), ("xie xie", "chinese_translit", "")], 0.7, 7),
]


def cache_rows(spark) -> DataFrame:
    return spark.createDataFrame(CACHE_ROWS, detect_v3.CACHE_SCHEMA)


_CACHE = "cache(id, seq, has_cs, conf, tokens) AS (VALUES " + ", ".join(
    f"('{r[0]}', {r[7]}, {str(r[3]).lower()}, {r[6]}::DOUBLE, [{', '.join(f'''{{'x': '{t[0]}', 'k': '{t[1]}'}}''' for t in r[5])}]::STRUCT(x VARCHAR, k VARCHAR)[])" for r in CACHE_ROWS
) + ")"


@query(
    f"""WITH {S.DOCS}, {_CACHE}, f AS (SELECT id, has_cs AND conf >= 0.5 AND len(list_filter(tokens, lambda t: t.k IN ('english', 'chinese_script', 'chinese_translit', 'other_foreign'))) > 0 AS llm_has_cs, conf AS llm_confidence,
 len(list_filter(tokens, lambda t: t.k = 'english')) AS n_english, len(list_filter(tokens, lambda t: t.k IN ('chinese_script', 'chinese_translit'))) AS n_chinese, len(list_filter(tokens, lambda t: t.k = 'proper_noun')) AS n_proper_noun,
 len(list_filter(tokens, lambda t: t.k IN ('english', 'chinese_script', 'chinese_translit', 'other_foreign'))) AS n_cs_tokens FROM cache QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
 j AS (SELECT doc_id::VARCHAR AS id, coalesce(llm_has_cs, false) AS llm_has_cs, llm_confidence, coalesce(n_english, 0)::INT AS n_english, coalesce(n_chinese, 0)::INT AS n_chinese, coalesce(n_proper_noun, 0)::INT AS n_proper_noun, coalesce(n_cs_tokens, 0)::INT AS n_cs_tokens,
  coalesce(n_cs_tokens, 0) / greatest(len(regexp_extract_all(text, '[^\\s\\x0b]+')), 1) AS ratio FROM docs LEFT JOIN f ON doc_id::VARCHAR = f.id)
 SELECT * EXCLUDE (ratio), round(ratio, 6) AS english_ratio, CASE WHEN NOT llm_has_cs THEN 'none' WHEN n_cs_tokens >= 3 OR ratio >= 0.25 THEN 'heavy' ELSE 'light' END AS cs_level, CASE WHEN llm_has_cs AND n_chinese > 0 THEN 'chinese_mixed' WHEN llm_has_cs THEN 'english_mixed' ELSE 'pure_vi' END AS cs_group FROM j"""
)
def llm_merge(spark, sf):
    features = detect_v3.summarise(detect_v3.keep_last(cache_rows(spark)))
    merged = detect_v3.merge(docs(spark, sf).withColumnRenamed("doc_id", "id"), features)
    return rounded(merged, "english_ratio").select("id", "llm_has_cs", "llm_confidence", "n_english", "n_chinese", "n_proper_noun", "n_cs_tokens", "cs_group", "cs_level", "english_ratio")


# Evaluation


def pseudo(id_col: str, salt: str):
    return F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{salt}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def evaluated(spark, sf, model: str = "m") -> DataFrame:
    """Labelled documents with pseudo-probabilities, once for ``all`` and once for the remainder of their id by three."""
    lab = read(spark, sf, "labels")
    rows = lab.select(F.col("doc_id").alias("id"), F.array(F.col("quality").cast("tinyint"), F.col("toxic").cast("tinyint")).alias("y_true"), F.array(pseudo("doc_id", f"{model}0"), pseudo("doc_id", f"{model}1")).alias("y_prob"))
    return rows.withColumn("y_pred", metrics.predict(F.col("y_prob"), 0.5)).withColumn("subset", F.explode(F.array(F.lit("all"), F.concat(F.lit("r"), F.pmod("id", F.lit(3)).cast("string")))))


@query(f"""WITH {S.EVAL}, {S.counts()}, r AS (SELECT subset, doc_id, min((y = (p >= 0.5)::INT)::INT) AS eq, sum((p >= 0.5)::INT) AS np FROM ev GROUP BY subset, doc_id), a AS (SELECT subset, avg(eq) AS acc, avg(np) AS np FROM r GROUP BY subset)
SELECT subset, n_samples, round(coalesce(micro_f1, 0), 6) AS micro_f1, round(macro_f1, 6) AS macro_f1, round(coalesce(weighted_f1, 0), 6) AS weighted_f1, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(hamming_loss, 6) AS hamming_loss, round(acc, 6) AS subset_accuracy, round(np, 6) AS avg_pred_per_sample FROM mt JOIN a USING (subset) WHERE n_samples >= 5""")
def subset_metrics(spark, sf):
    cols = ["micro_f1", "macro_f1", "weighted_f1", "macro_precision", "macro_recall", "hamming_loss", "subset_accuracy", "avg_pred_per_sample"]
    return rounded(metrics.subset_metrics(evaluated(spark, sf), ["subset"]), *cols).select("subset", "n_samples", *cols)


@query(f"WITH {S.EVAL}, {S.counts()} SELECT subset, label_id, support::BIGINT AS support, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(f1, 6) AS f1 FROM sc")
def per_label_metrics(spark, sf):
    return rounded(metrics.with_label_scores(metrics.label_counts(evaluated(spark, sf), ["subset"])), "precision", "recall", "f1").select("subset", "label_id", "support", "precision", "recall", "f1")


@query(f"WITH {S.EVAL}, {S.counts()} SELECT subset, label_id, round(f1, 6) AS f1, row_number() OVER (PARTITION BY subset ORDER BY f1, label_id) AS rank FROM sc QUALIFY rank <= 10")
def worst_labels_topk(spark, sf):
    return rounded(metrics.worst_labels(metrics.label_counts(evaluated(spark, sf), ["subset"]), ["subset"]), "f1").select("subset", "label_id", "f1", "rank")


@query(f"WITH {S.EVAL}, gr AS (SELECT i, 0.10::DOUBLE + 0.02::DOUBLE * i AS th FROM range(31) g(i)), ex AS (SELECT * FROM ev CROSS JOIN gr), {S.counts('th', 'subset, i, th', 'ex')} SELECT subset, round(CASE WHEN macro_f1 > 0 THEN th ELSE 0.5 END, 6) AS threshold, round(macro_f1, 6) AS best FROM mt QUALIFY row_number() OVER (PARTITION BY subset ORDER BY round(macro_f1, 12) DESC, th) = 1")
def threshold_tuning(spark, sf):
    return rounded(metrics.tune_threshold(evaluated(spark, sf), keys=["subset"]), "threshold", "best")


@query("WITH l AS (SELECT 0 AS label_id, quality AS y FROM labels UNION ALL SELECT 1, toxic FROM labels) SELECT label_id, sum((y = 1)::INT)::BIGINT AS pos, sum((y <> 1)::INT)::BIGINT AS neg, round(least(greatest(sum((y <> 1)::INT) / greatest(sum((y = 1)::INT), 1), 1), 50), 6) AS pos_weight FROM l GROUP BY label_id")
def pos_weight(spark, sf):
    return rounded(metrics.pos_weight(evaluated(spark, sf).where("subset = 'all'")), "pos_weight")


@query(f"""WITH l AS (SELECT 0 AS label_id, quality AS y, 6 * {S.pseudo('m0')} - 3 AS x FROM labels UNION ALL SELECT 1, toxic, 6 * {S.pseudo('m1')} - 3 FROM labels), w AS (SELECT label_id, least(greatest(sum((y <> 1)::INT) / greatest(sum((y = 1)::INT), 1), 1), 50) AS w FROM l GROUP BY label_id)
SELECT round(avg(-(w * y * -ln(1 + exp(-x)) + (1 - y) * -ln(1 + exp(x)))), 6) AS loss FROM l JOIN w USING (label_id)""")
def weighted_bce(spark, sf):
    rows = evaluated(spark, sf).where("subset = 'all'")
    return rounded(metrics.weighted_bce(rows.withColumn("y_logit", F.transform("y_prob", lambda p: 6 * p - 3)), metrics.pos_weight(rows)), "loss")


@query(f"WITH {S.EVAL}, {S.counts()} SELECT round(avg(a.f1), 6) AS f1_a, round(avg(b.f1), 6) AS f1_b, count(*) AS n_labels FROM sc a JOIN sc b USING (label_id) WHERE a.subset = 'r0' AND b.subset = 'r1' AND a.support >= 5 AND b.support >= 5")
def shared_label_macro(spark, sf):
    return rounded(metrics.shared_label_macro(metrics.label_counts(evaluated(spark, sf), ["subset"]), "subset", "r0", "r1"), "f1_a", "f1_b")


@query(f"WITH {S.V1}, {S.V2.removeprefix(S.DOCS + ', ')}, c AS (SELECT v1.is_code_switched AS a, v2.is_cs_strict AS b FROM v1 JOIN v2 USING (doc_id)), k AS (SELECT count(*) AS n, count_if(a AND b) AS both_true, count_if(a AND NOT b) AS only_a, count_if(NOT a AND b) AS only_b, count_if(NOT a AND NOT b) AS neither FROM c), e AS (SELECT *, (both_true + neither) / n AS po, ((both_true + only_a) / n) * ((both_true + only_b) / n) + (1 - (both_true + only_a) / n) * (1 - (both_true + only_b) / n) AS pe FROM k) SELECT n, both_true, only_a, only_b, neither, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM e")
def kappa_two_detectors(spark, sf):
    a, b = v1(spark, sf).select("doc_id", F.col("is_code_switched").alias("a")), v2(spark, sf).select(F.col("id").alias("doc_id"), F.col("is_cs_strict").alias("b"))
    return rounded(detect_v3.agreement(a.join(b, "doc_id"), "a", "b"), "agreement", "kappa")


@query("WITH d AS (SELECT toxic = 1 AS g, quality = 1 AS p FROM labels), c AS (SELECT count(*) AS n, count_if(g AND p) AS tp, count_if(NOT g AND p) AS fp, count_if(g AND NOT p) AS fn FROM d), s AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS rc FROM c) SELECT n, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / greatest(pr + rc, 1e-9), 6) AS f1 FROM s")
def review_score(spark, sf):
    rows = read(spark, sf, "labels").select(F.col("toxic").cast("string").alias("gold_has_cs"), F.when(F.col("quality") == 1, "english_mixed").otherwise("pure_vi").alias("cs_group"))
    return rounded(detect_v3.review_score(rows), "precision", "recall", "f1")


def scores(spark, sf) -> DataFrame:
    """Metrics of three pseudo-models."""
    parts = [metrics.subset_metrics(evaluated(spark, sf, m), ["subset"]).withColumn("model", F.lit(f"{m}-s1")) for m in ("m", "k", "q")]
    return reduce(DataFrame.unionByName, parts)


def _scores_sql() -> str:
    one = lambda m: f"SELECT doc_id, 0 AS label_id, quality AS y, {S.pseudo(m + '0')} AS p, '{m}-s1' AS model FROM labels UNION ALL SELECT doc_id, 1, toxic, {S.pseudo(m + '1')}, '{m}-s1' FROM labels"
    return f"l AS ({' UNION ALL '.join(map(one, ('m', 'k', 'q')))}), ev AS (SELECT l.*, s.subset FROM l CROSS JOIN (VALUES ('all'), ('r0'), ('r1'), ('r2')) s(subset) WHERE s.subset = 'all' OR s.subset = 'r' || (doc_id % 3)), {S.counts(keys='model, subset')}"


@query(f"""WITH {_scores_sql()} SELECT subset, min(n_samples) AS n, round(max(macro_f1) FILTER (WHERE model = 'm-s1'), 4) AS "m-s1", round(max(macro_f1) FILTER (WHERE model = 'k-s1'), 4) AS "k-s1", round(max(macro_f1) FILTER (WHERE model = 'q-s1'), 4) AS "q-s1" FROM mt WHERE n_samples >= 5 GROUP BY subset""")
def model_subset_pivot(spark, sf):
    return metrics.compare(scores(spark, sf))


@query(f"""WITH {_scores_sql()} SELECT subset, min(n_samples) AS n, round(max(macro_f1) FILTER (WHERE model = 'm-s1'), 4) AS "m-s1", round(max(macro_f1) FILTER (WHERE model = 'k-s1'), 4) AS "k-s1", round(max(macro_f1) FILTER (WHERE model = 'q-s1'), 4) AS "q-s1" FROM mt WHERE n_samples >= 5 AND subset IN ('r2', 'r0') GROUP BY subset""")
def named_subset_pivot(spark, sf):
    return metrics.compare(scores(spark, sf), only=["r2", "r0", "no such subset"])


@query(f"""WITH {_scores_sql()}, w AS (SELECT model, max(macro_f1) FILTER (WHERE subset = 'all') AS a, max(macro_f1) FILTER (WHERE subset = 'r0') AS r0, max(macro_f1) FILTER (WHERE subset = 'r1') AS r1 FROM mt GROUP BY model), g AS (SELECT model, 'r0-r1' AS gap, r0 - r1 AS value FROM w UNION ALL SELECT model, 'r0-all', r0 - a FROM w)
SELECT model, gap, round(value, 6) AS value FROM (SELECT * FROM g UNION ALL SELECT 'mean', gap, avg(value) FROM g GROUP BY gap)""")
def gaps(spark, sf):
    return rounded(metrics.gaps(scores(spark, sf), [("r0", "r1"), ("r0", "all")]), "value").select("model", "gap", "value")


# Lengths and equality


@query(f"WITH {S.DOCS}, h AS (SELECT least(floor(length(text) / 50), 20)::INT AS bucket, count(*) AS n, count_if(length(text) <= 200) AS s FROM docs GROUP BY 1) SELECT bucket, n, round(sum(s) OVER () / sum(n) OVER (), 6) AS share_short FROM h")
def length_coverage(spark, sf):
    return rounded(stats.length_coverage(docs(spark, sf)), "share_short")


@query("WITH d AS (SELECT coalesce(text, '') AS a, lower(coalesce(text, '')) AS b, replace(coalesce(text, ''), 'haha', '') AS c FROM documents), e AS (SELECT count(*) AS n, count_if(a = b) AS ab, count_if(a = c) AS ac, count_if(b = c) AS bc FROM d), r AS (SELECT 'text' AS a, 'low' AS b, ab AS equal, n FROM e UNION ALL SELECT 'text', 'plain', ac, n FROM e UNION ALL SELECT 'low', 'plain', bc, n FROM e) SELECT *, round(equal / n, 6) AS share, n - equal AS changed FROM r")
def pairwise_text_equality(spark, sf):
    d = docs(spark, sf).select(F.coalesce("text", F.lit("")).alias("text")).withColumns({"low": F.lower("text"), "plain": F.replace("text", F.lit("haha"), F.lit(""))})
    return rounded(stats.pairwise_equality(d, ["text", "low", "plain"]), "share")


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def event_value_counts(spark, sf):
    return rounded(stats.value_counts(read(spark, sf, "events"), "event_type"), "share")
