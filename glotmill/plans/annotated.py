"""Queries over token rules, model answers, annotation runs, model inference and dictionary files, with their SQL.

The given tables hold Latin text without faces, foreign scripts or model output, so these are derived from them by rule.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from glotmill.functions import text as X
from glotmill.functions import tokens as T
from glotmill.lexicon import V3_COMMON, V3_KEEP, strip_marks
from glotmill.operators import detect_v2, detect_v3, inference
from glotmill.operators.annotation_run import annotate_in_waves, cached
from glotmill.plans import sql as S
from glotmill.plans.loading import scratch
from glotmill.plans.reference import docs, query, read, rounded
from glotmill.sources.readers import discover_models, read_lexicon

# Scripts, noise and the model's form of texts


_LETTERS, _SIGNS = "aeioutnrs", "一ひ한Жก漢ナ다я"


@query(f"WITH {S.DOCS}, t AS (SELECT doc_id, translate(text, '{_LETTERS}', '{_SIGNS}') AS text FROM docs) SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in T.SCRIPTS.items()) + " FROM t")
def script_scan(spark, sf):
    """Characters of each script in documents whose commonest letters stand for signs of several scripts."""
    signs = docs(spark, sf).select("doc_id", F.translate(F.coalesce("text", F.lit("")), _LETTERS, _SIGNS).alias("text"))
    return signs.select("doc_id", *[c.alias(k) for k, c in T.script_counts(F.col("text")).items()])


_NOISY = "coalesce(html, '') || ' ' || coalesce(url, '') || ' @user.' || page_id || ' a@b #tag' || page_id || ' 😂❤️→ привет 谢谢'"


@query(rf"WITH t AS (SELECT page_id, {_NOISY} AS text FROM pages) SELECT page_id, len(regexp_extract_all(text, '(?i)https?://\S+|www\.\S+')) AS n_url, len(regexp_extract_all(text, '(^|[^\p{{L}}\p{{N}}_])@[\p{{L}}\p{{N}}_.]+')) AS n_mention, len(regexp_extract_all(text, '(^|[^\p{{L}}\p{{N}}_])#[\p{{L}}\p{{N}}_]+')) AS n_hashtag, len(regexp_extract_all(text, '[\x{{1F000}}-\x{{1FAFF}}←-⇿⌀-⏿☀-⛿✀-➿\x{{FE0F}}⬀-⯿]')) AS n_emoji, len(regexp_extract_all(text, '[Ѐ-ӿ؀-ۿ฀-๿぀-ヿ㐀-䶿一-鿿가-힯]')) AS n_non_latin FROM t")
def noise_counters(spark, sf):
    """Links, mentions, hashtags, emoji and foreign letters of web pages, to each of which some are added."""
    page = F.col("page_id").cast("string")
    text = F.concat(F.coalesce("html", F.lit("")), F.lit(" "), F.coalesce("url", F.lit("")), F.lit(" @user."), page, F.lit(" a@b #tag"), page, F.lit(" 😂❤️→ привет 谢谢"))
    return read(spark, sf, "pages").select("page_id", text.alias("text")).select("page_id", *[c.alias(k) for k, c in T.noise_counts(F.col("text")).items()])


_CASCADE = {"ko": "không", "dc": "được", "và": "and", "and": "&", "la": "le", "le": "les", "les": "the"}


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _model_text_sql() -> str:
    """Documents in the model's form; runs of a letter and line feeds are judged character by character."""
    low = "lower(text)"
    for i, (pattern, to) in enumerate(X.COMMON_REWRITES):
        low = f"regexp_replace({low}, {_sql_text(pattern)}, {_sql_text(to)}, 'g')" if i < 10 else f"replace({low}, {_sql_text(pattern)}, {'chr(10)' if to == chr(10) else _sql_text(to)})"
    word = "CASE p " + " ".join(f"WHEN '{k}' THEN '{_closed(k)}'" for k in _CASCADE) + " ELSE p END"
    spaces = X.SPACES.replace("]+", r"\x0b]+")
    return rf"""{S.DOCS}, a AS (SELECT doc_id, string_split({low}, '') AS c FROM docs),
b AS (SELECT doc_id, array_to_string([c[i] for i in range(1, len(c) + 1) if NOT (i > 1 AND c[i] = c[i - 1] AND regexp_matches(c[i], '^\p{{L}}$'))], '') AS t FROM a),
w AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), lambda p: {word}), '') AS t FROM b),
l AS (SELECT doc_id, string_split(t, '') AS c FROM w),
n AS (SELECT doc_id, array_to_string([CASE WHEN c[i] = chr(10) AND (i = 1 OR c[i - 1] NOT IN ('.', ',', '!', '?', ';', ':')) THEN '. ' ELSE c[i] END for i in range(1, len(c) + 1)], '') AS t FROM l),
m AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\n([.,!?;:])?', ' \1', 'g'), '([.,!?;:])', ' \1 ', 'g'), '{spaces}', ' ', 'g')) AS t FROM n)"""


def _closed(key: str) -> str:
    """What a key becomes when the later ones have had their turn."""
    order = list(_CASCADE)
    value = _CASCADE[key]
    for later in order[order.index(key) + 1 :]:
        value = " ".join(_CASCADE[later] if w == later else w for w in value.split(" "))
    return value


@query(f"WITH {_model_text_sql()} SELECT doc_id, md5(t) AS model_text FROM m")
def scenarios(spark, sf):
    """The form that models are trained on, with a dictionary whose words follow from each other; ``scenario_texts`` has S1 to S3."""
    return docs(spark, sf).select("doc_id", F.md5(X.model_text(F.coalesce("text", F.lit("")), _CASCADE)).alias("model_text"))


@query("WITH k AS (SELECT n_name AS key, n_nationkey AS i FROM nation UNION ALL SELECT lower(n_name), 100 + n_nationkey FROM nation) SELECT row_number() OVER (ORDER BY i) - 1 AS place, key, 'nation ' || i AS value FROM k")
def lexicon_file(spark, sf):
    """A dictionary of names in both cases, written as JSON and read again in its order."""
    names = read(spark, sf, "nation").select("n_nationkey", "n_name")
    both = names.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("key")).unionByName(names.select((F.col("n_nationkey") + 100).alias("i"), F.lower("n_name").alias("key")))
    pair = F.concat(F.to_json(F.struct("key")).substr(F.lit(8), F.length(F.to_json(F.struct("key"))) - 8), F.lit(": "), F.concat(F.lit('"nation '), F.col("i").cast("string"), F.lit('"')))
    lines = both.select("i", pair.alias("line")).agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("all"))  # one row for each name of the word list
    path = f"{scratch(spark)}/names.json"
    lines.select(F.concat(F.lit("{"), F.array_join(F.transform("all", lambda x: x["line"]), ",\n"), F.lit("}")).alias("value")).coalesce(1).write.text(path)
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(read_lexicon(spark, path).items())], "place long, key string, value string")


# Lexicons of table size


_TABLE = S.CLASSES.replace(S.quoted(S.CONFIG.english_lexicon), f"SELECT w FROM lx WHERE w NOT IN ({S.quoted(S.CONFIG.blacklist)}) UNION ALL SELECT unnest([{S.quoted(S.CONFIG.english_lexicon)}])")
_LEXICON = """fq AS (SELECT lower(w) AS w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[\\p{L}]+')) AS w FROM documents WHERE lang = 'en') GROUP BY 1),
lx AS (SELECT w FROM fq WHERE length(w) >= 3 ORDER BY n DESC, w LIMIT 30000)"""


def lexicon_of(spark, sf):
    """The 30,000 commonest words of the English documents."""
    english = read(spark, sf, "documents").where("lang = 'en'").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return detect_v2.top_words(english.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {_LEXICON}, {_TABLE} SELECT t AS token, n, class FROM cls")
def v2_classify_by_table(spark, sf):
    """Every distinct token's class, with a lexicon taken from the documents."""
    return detect_v2.classify_by_table(docs(spark, sf), lexicon_of(spark, sf))


# Model answers and runs


@query("""WITH a AS (SELECT conv_id, turn, turn % 4 AS kind, text FROM conversations)
SELECT conv_id, turn, conv_id || '-' || turn AS id, length(text) % 2 = 0 AS has_cs, 1 AS n_tokens, round((length(text) % 100) / 100, 6) AS confidence FROM a WHERE kind < 3""")
def llm_answers(spark, sf):
    """What is read from answers in three forms (fenced list, reasoning and an object, plain list); every fourth has none."""
    said = read(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") % 4).alias("kind"), "text", F.concat_ws("-", "conv_id", "turn").alias("id"))
    token = F.struct(F.substring("text", 1, 5).alias("text"), F.lit("english").alias("type"), F.lit("").alias("gloss"))
    answer = F.struct("id", (F.length("text") % 2 == 0).alias("has_cs"), F.array(F.lit("en")).alias("langs"), F.array(token).alias("tokens"), ((F.length("text") % 100) / 100).alias("confidence"))
    listed = F.to_json(F.array(answer))
    raw = (
        F.when(F.col("kind") == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
        .when(F.col("kind") == 1, F.concat(F.lit("<think>perhaps [1]</think>"), F.lit('{"results": '), listed, F.lit("}")))
        .when(F.col("kind") == 2, listed).otherwise("no answer")
    )
    rows = said.select("conv_id", "turn", F.explode(detect_v3.parse_response(raw)).alias("r"))
    return rounded(rows.select("conv_id", "turn", "r.id", "r.has_cs", F.size("r.tokens").alias("n_tokens"), "r.confidence"), "confidence")


_KINDS = ("english", "other_foreign", "chinese_script", "chinese_translit", "proper_noun")
_TOKENS = r"[\p{L}]+(?:[\-'][\p{L}]+)*"
_HAN = T.SCRIPTS["chinese_script"]


def _postfilter_sql() -> str:
    bare = lambda words: S.quoted([*words, *map(strip_marks, words)])
    vn = f"(lower(p) NOT IN ({S.quoted(V3_KEEP)}) AND (regexp_matches(lower(p), '(?i)[{S.VIET_CHARS}]') OR lower(p) IN ({bare(V3_COMMON)}) OR {S.is_syllable('strip_accents(lower(p))')}))"
    common = lambda w: f"(lower({w}) IN ({bare(V3_COMMON)}) OR strip_accents(lower({w})) IN ({bare(V3_COMMON)}))"
    every = lambda test: f"len(list_filter(parts, lambda p: NOT {test})) = 0"
    upper = "x[1] <> lower(x[1])"
    return rf"""{S.DOCS}, w AS (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKENS.replace("'", "''")}')[1:40] AS ws FROM docs)),
k AS (SELECT doc_id, i, CASE i % 7 WHEN 2 THEN x || '漢' ELSE x END AS x, {list(_KINDS)}[i % 5 + 1] AS kind, CASE WHEN i % 2 = 0 THEN '漢' ELSE '' END AS gloss FROM w),
q AS (SELECT *, list_filter(string_split_regex(x, '[\s\-_/]+'), lambda p: p <> '') AS parts FROM k),
t AS (SELECT doc_id, i, x, CASE WHEN kind = 'english' THEN CASE WHEN regexp_matches(x, '(?i)[{S.VIET_CHARS}]') THEN CASE WHEN {upper} THEN 'proper_noun' END WHEN NOT {every("regexp_full_match(p, '[A-Za-z]+')")} THEN NULL
    WHEN {every(vn)} THEN CASE WHEN {upper} AND len(parts) >= 2 THEN 'proper_noun' END WHEN length(x) > 2 THEN 'english' END
  WHEN kind = 'chinese_script' THEN CASE WHEN regexp_matches(x, '{_HAN}') THEN kind END
  WHEN kind IN ('chinese_translit', 'other_foreign') THEN CASE WHEN regexp_matches(x, '{_HAN}') THEN 'chinese_script' WHEN {every(common('p'))} OR {common('x')} THEN NULL WHEN kind = 'chinese_translit' AND NOT regexp_matches(gloss, '{_HAN}') THEN NULL ELSE kind END
  ELSE kind END AS kind FROM q),
g AS (SELECT doc_id, string_agg(x || '/' || kind, ' ' ORDER BY i) FILTER (kind IS NOT NULL) AS tokens, count_if(kind IN ('english', 'chinese_script', 'chinese_translit', 'other_foreign')) > 0 AS has_cs,
  list_sort(list_distinct(list(CASE WHEN kind LIKE '%chinese%' THEN 'zh' WHEN kind = 'english' THEN 'en' ELSE 'other' END) FILTER (kind IN ('english', 'chinese_script', 'chinese_translit', 'other_foreign')))) AS langs FROM t GROUP BY doc_id)"""


@query(f"WITH {_postfilter_sql()} SELECT docs.doc_id, coalesce(has_cs, false) AS has_cs, coalesce(array_to_string(langs, ','), '') AS langs, md5(coalesce(tokens, '')) AS tokens FROM docs LEFT JOIN g USING (doc_id)")
def llm_postfilter(spark, sf):
    """The rules on the first forty words of every document, which get a kind and a gloss by their place."""
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_TOKENS), F.lit(0)), 1, 40)
    kind = lambda i: F.element_at(F.array(*map(F.lit, _KINDS)), (i % 5 + 1).cast("int"))
    tokens = F.transform(words, lambda x, i: F.struct(F.when(i % 7 == 2, F.concat(x, F.lit("漢"))).otherwise(x).alias("text"), kind(i).alias("type"), F.when(i % 2 == 0, F.lit("漢")).otherwise("").alias("gloss")))
    clean = detect_v3.clean_cache(docs(spark, sf).select("doc_id", tokens.alias("tokens")))
    return clean.select("doc_id", "has_cs", F.array_join("langs", ",").alias("langs"), F.md5(F.array_join(F.transform("tokens", lambda t: F.concat_ws("/", t["text"], t["type"])), " ")).alias("tokens"))


def _mock(refuse: bool):
    """A deterministic backend; with ``refuse`` it has no answer for texts of some lengths."""

    def backend(texts: list[str]) -> list[dict]:
        found = [{"has_cs": "haha" in t, "langs": ["vi"], "tokens": [], "confidence": len(t) % 100 / 100} for t in texts]
        return found if not refuse or all(len(t) % 3 for t in texts) else []

    return backend


@query("SELECT doc_id::VARCHAR AS id, contains(coalesce(text, ''), 'haha') AS has_cs, round((length(coalesce(text, '')) % 100) / 100, 6) AS confidence, CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN 2 ELSE 1 END AS run FROM documents")
def annotation_run(spark, sf):
    """A run whose backend leaves rows without an answer, and a second one that asks for these only."""
    path, rows = scratch(spark), read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    for refuse in (True, False):
        annotate_in_waves(rows, _mock(refuse), "mock", path, wave_rows=2000, batch=1, attempts=1)
    return rounded(cached(spark, path, "mock").select("id", "has_cs", "confidence", F.col("_seq").alias("run")), "confidence")


# Models


_FOLDERS = ("s1-XLM-R", "ViSoBERT_s2", "PhoBERT-S3", "vit5", "other-s1")
_GUESSED = "CASE c_custkey % 5 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} ELSE {} END"


@query(f"""WITH f AS (SELECT c_custkey, 'out/' || c_name || '/' || {_GUESSED.format(*map(_sql_text, _FOLDERS))} AS path, {_GUESSED.format("'xlmr'", "'visobert'", "'phobert'", "'vit5'", 'NULL')} AS arch, {_GUESSED.format("'s1'", "'s2'", "'s3'", 'NULL', "'s1'")} AS scenario FROM customer),
t AS (SELECT *, concat_ws('-', arch, coalesce(scenario, 's0')) AS base FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS r FROM t) SELECT path, arch, scenario, CASE WHEN r > 1 THEN base || '-' || r ELSE base END AS tag FROM r""")
def model_folders(spark, sf):
    """Architecture, scenario and tag of one result folder a customer, by its name; a repeated tag gets a number."""
    name = F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return discover_models(read(spark, sf, "customer").select(F.concat(F.lit("out/"), F.col("c_name"), F.lit("/"), name).alias("path"))).select("path", "arch", "scenario", "tag")


def _letters_model() -> inference.Model:
    """A stand-in for a trained model: probabilities from a text's length and letters."""
    return lambda texts: np.array([[len(t) % 997 / 997, t.count("e") / max(len(t), 1)] for t in texts])


_PROB = "CASE label_id WHEN 0 THEN (length(text) % 997) / 997 ELSE (length(text) - length(replace(text, 'e', ''))) / greatest(length(text), 1) END"


@query(f"""WITH {S.DOCS}, lb AS (SELECT docs.doc_id, split, lang AS subset, label_id, CASE label_id WHEN 0 THEN quality ELSE toxic END AS y, {_PROB} AS p FROM docs JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) JOIN labels USING (doc_id), range(2) l(label_id)),
best AS (WITH ex AS (SELECT lb.*, i, 0.10::DOUBLE + 0.02::DOUBLE * i AS th FROM lb, range(31) g(i) WHERE split = 'val'), {S.counts('th', 'i, th', 'ex')} SELECT CASE WHEN macro_f1 > 0 THEN th ELSE 0.5 END AS th FROM mt QUALIFY row_number() OVER (ORDER BY round(macro_f1, 12) DESC, th) = 1),
te AS (SELECT * FROM lb, best WHERE split = 'test'), {S.counts('th', 'subset, th', 'te')} SELECT subset, round(th, 6) AS threshold, n_samples, round(macro_f1, 6) AS macro_f1, round(coalesce(micro_f1, 0), 6) AS micro_f1, round(hamming_loss, 6) AS hamming_loss FROM mt WHERE n_samples >= 5""")
def model_predictions(spark, sf):
    """A model's predictions for labelled documents: its threshold is tuned on one split and scored on another by language."""
    lab = read(spark, sf, "labels").select("doc_id", F.array(F.col("quality").cast("tinyint"), F.col("toxic").cast("tinyint")).alias("y_true"))
    lang = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("subset"))
    rows = docs(spark, sf).join(lab, "doc_id").join(lang, "doc_id")
    scored = inference.with_probabilities(rows, _letters_model, 2, batch_size=256).select("split", "subset", "y_true", "y_prob")
    return rounded(inference.evaluated_at_best(scored, ["subset"]), "threshold", "macro_f1", "micro_f1", "hamming_loss").select("subset", "threshold", "n_samples", "macro_f1", "micro_f1", "hamming_loss")
