"""Queries over evaluation, annotator comparison and label helpers; pseudo-random columns come from a hash of the id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotmill.functions import labels as L
from glotmill.functions import text as X
from glotmill.lexicon import EMOJI_WORDS
from glotmill.operators import detect_v3, metrics, resampling, stats, subsets
from glotmill.plans import sql as S
from glotmill.plans.reference import _COMMON, _TEEN, _scores_sql, docs, evaluated, pseudo, query, read, rounded, scores
from glotmill.sources.writers import prediction_columns

# Two annotators of documents


def annotators(spark, sf) -> DataFrame:
    """A rule's and a model's verdict on every document, and what the model found."""
    low = F.pmod("id", F.lit(4)) > 0
    return docs(spark, sf).select(F.col("doc_id").alias("id"), "split").select(
        "id", "split", (pseudo("id", "rule") < 0.3).alias("is_cs_rule"), (pseudo("id", "llm") < 0.35).alias("is_cs_strict"),
        F.floor(pseudo("id", "zh") * 1.2).alias("n_chinese"), F.floor(pseudo("id", "tr") * 1.3).alias("n_translit"), F.when(low, pseudo("id", "conf")).alias("llm_confidence"),
    )


_TWO = f"""{S.DOCS}, two AS (SELECT doc_id AS id, split, {S.pseudo('rule')} < 0.3 AS is_cs_rule, {S.pseudo('llm')} < 0.35 AS is_cs_strict, floor({S.pseudo('zh')} * 1.2) AS n_chinese,
  floor({S.pseudo('tr')} * 1.3) AS n_translit, CASE WHEN doc_id % 4 > 0 THEN {S.pseudo('conf')} END AS llm_confidence FROM docs)"""


@query(f"WITH {_TWO} SELECT split, count(*) AS n, count_if(is_cs_strict) AS cs, count_if(is_cs_rule) AS cs_rule, count_if(n_chinese > 0) AS chinese, count_if(n_translit > 0) AS translit, round(avg(llm_confidence), 6) AS avg_confidence FROM two GROUP BY split")
def v3_summary_by_split(spark, sf):
    return rounded(stats.summary_v3(annotators(spark, sf)), "avg_confidence")


@query(f"WITH {_TWO} SELECT count(*) AS n, count_if(is_cs_rule) AS rule, count_if(is_cs_strict) AS llm, count_if(is_cs_strict) - count_if(is_cs_rule) AS difference FROM two")
def rule_against_llm(spark, sf):
    return stats.rule_against_llm(annotators(spark, sf))


_KINDS = {"llm_only": "is_cs_strict AND NOT is_cs_rule", "rule_only": "is_cs_rule AND NOT is_cs_strict", "chinese": "n_chinese > 0", "translit": "n_translit > 0"}


@query(f"WITH {_TWO} " + " UNION ALL ".join(f"(SELECT '{k}' AS kind, id FROM two WHERE {c} ORDER BY id LIMIT 200)" for k, c in _KINDS.items()))
def disagreement_samples(spark, sf):
    found = subsets.disagreements(annotators(spark, sf))
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("kind"), "id") for k, d in found.items()])


@query("SELECT count(DISTINCT lang) AS n_langs, count(DISTINCT source) AS n_sources FROM documents")
def distinct_groups(spark, sf):
    return read(spark, sf, "documents").agg(F.count_distinct("lang").alias("n_langs"), F.count_distinct("source").alias("n_sources"))


@query(
    """WITH k AS (SELECT conv_id, role, length(text) % 2 = 0 AS has_cs FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1),
j AS (SELECT a.has_cs AS a, b.has_cs AS b FROM k a JOIN k b USING (conv_id) WHERE a.role = 'user' AND b.role = 'assistant'), c AS (SELECT count(*) AS n, count_if(a AND b) AS both_true, count_if(a AND NOT b) AS only_a, count_if(NOT a AND b) AS only_b, count_if(NOT a AND NOT b) AS neither FROM j),
e AS (SELECT *, (both_true + neither) / n AS po, ((both_true + only_a) / n) * ((both_true + only_b) / n) + (1 - (both_true + only_a) / n) * (1 - (both_true + only_b) / n) AS pe FROM c)
SELECT n, both_true, only_a, only_b, neither, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM e"""
)
def two_annotators(spark, sf):
    cache = read(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("_tag"), F.col("turn").alias("_seq"), (F.length("text") % 2 == 0).alias("has_cs"))
    return rounded(detect_v3.two_annotators(cache, "user", "assistant"), "agreement", "kappa")


@query("WITH d AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') SELECT count(conv_id) AS done, count(*) AS needed, count_if(conv_id IS NULL) AS missing FROM documents LEFT JOIN d ON doc_id = conv_id")
def cache_status(spark, sf):
    cache = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("_tag"))
    return detect_v3.cache_status(docs(spark, sf), cache, "system", "doc_id")


# Predictions


@query(f"""WITH {S.EVAL}, r AS (SELECT subset, doc_id, sum((y = 1 AND p >= 0.5)::INT) AS tp, sum((p >= 0.5)::INT) AS pp, sum((y = 1)::INT) AS t FROM ev GROUP BY subset, doc_id)
SELECT subset, round(avg(CASE WHEN pp = 0 THEN 0 ELSE tp / pp END), 6) AS samples_precision, round(avg(CASE WHEN t = 0 THEN 0 ELSE tp / t END), 6) AS samples_recall, round(avg(CASE WHEN pp + t = 0 THEN 0 ELSE 2 * tp / (pp + t) END), 6) AS samples_f1 FROM r GROUP BY subset""")
def sample_averages(spark, sf):
    return rounded(metrics.sample_averages(evaluated(spark, sf), ["subset"]), "samples_precision", "samples_recall", "samples_f1")


@query(f"WITH {S.EVAL}, r AS (SELECT subset, doc_id, sum((y = 1)::INT) AS gold FROM ev GROUP BY subset, doc_id) SELECT subset, round(avg(gold), 6) AS avg_gold_per_sample FROM r GROUP BY subset")
def gold_per_sample(spark, sf):
    return rounded(metrics.subset_metrics(evaluated(spark, sf), ["subset"], least=0), "avg_gold_per_sample").select("subset", "avg_gold_per_sample")


_WRITTEN = "concat_ws(', ', CASE WHEN {0} = 1 THEN 'quality' END, CASE WHEN {1} = 1 THEN 'toxic' END)"


@query(f"WITH e AS (SELECT doc_id AS id, quality, toxic, ({S.pseudo('m0')} >= 0.5)::INT AS q, ({S.pseudo('m1')} >= 0.5)::INT AS t FROM labels) SELECT id, {_WRITTEN.format('quality', 'toxic')} AS gold, {_WRITTEN.format('q', 't')} AS predicted FROM e WHERE quality <> q OR toxic <> t")
def prediction_errors(spark, sf):
    wrong = metrics.errors(evaluated(spark, sf).where("subset = 'all'"))
    ids = lambda c: F.filter(F.sequence(F.lit(0), F.lit(1)), lambda i: F.element_at(c, i + 1) == 1)
    named = lambda c: F.array_join(L.label_names(ids(F.col(c)), ["quality", "toxic"]), ", ")
    return wrong.select("id", named("y_true").alias("gold"), named("y_pred").alias("predicted"))


@query(f"SELECT doc_id AS id, quality::INT AS true_quality, toxic::INT AS true_toxic, round({S.pseudo('m0')}, 6) AS prob_quality, round({S.pseudo('m1')}, 6) AS prob_toxic, ({S.pseudo('m0')} >= 0.5)::INT AS pred_quality, ({S.pseudo('m1')} >= 0.5)::INT AS pred_toxic FROM labels")
def prediction_dump(spark, sf):
    wide = prediction_columns(evaluated(spark, sf).where("subset = 'all'").drop("subset"), ["quality", "toxic"])
    whole = {c: F.col(c).cast("int") for c in wide.columns if c.startswith(("true_", "pred_"))}
    return rounded(wide.withColumns(whole), "prob_quality", "prob_toxic")


@query(f"""WITH {S.EVAL}, c AS (SELECT subset, label_id, avg((y = (p >= 0.5)::INT)::INT) AS eq FROM ev GROUP BY 1, 2), r AS (SELECT subset, doc_id, sum((p >= 0.5)::INT) AS np FROM ev GROUP BY 1, 2)
SELECT subset, round(avg(eq), 6) AS label_accuracy, any_value(dense) AS dense FROM c JOIN (SELECT subset, avg(np) >= 10 AS dense FROM r GROUP BY subset) USING (subset) GROUP BY subset""")
def label_accuracy(spark, sf):
    m = metrics.subset_metrics(evaluated(spark, sf), ["subset"], least=0)
    return rounded(m, "label_accuracy").select("subset", "label_accuracy", (F.col("avg_pred_per_sample") >= 10).alias("dense"))


@query("WITH l AS (SELECT 0 AS label_id, quality AS y FROM labels UNION ALL SELECT 1, toxic FROM labels) SELECT label_id, round(sum((y <> 1)::INT) / greatest(sum((y = 1)::INT), 1), 6) AS pos_weight FROM l GROUP BY label_id")
def pos_weight_unclipped(spark, sf):
    return rounded(metrics.pos_weight(evaluated(spark, sf).where("subset = 'all'"), clip=False), "pos_weight").select("label_id", "pos_weight")


@query(f"SELECT doc_id, round(1 / (1 + exp(-(6 * {S.pseudo('m0')} - 3))), 6) AS p FROM labels")
def sigmoid(spark, sf):
    return rounded(read(spark, sf, "labels").select("doc_id", metrics.sigmoid(6 * pseudo("doc_id", "m0") - 3).alias("p")), "p")


_PUBLISHED = [("m", "s1", 40.0), ("k", "s1", 35.5), ("q", "s1", 90.0)]


@query(f"""WITH {_scores_sql()}, pub(arch, scenario, paper) AS (VALUES {', '.join(f"('{a}', '{s}', {p}::DOUBLE)" for a, s, p in _PUBLISHED)}), g AS (SELECT split_part(model, '-', 1) AS arch, split_part(model, '-', 2) AS scenario, round(100 * macro_f1, 2) AS got FROM mt WHERE subset = 'all')
SELECT arch, scenario, got, paper, round(got - paper, 2) AS diff, abs(round(got - paper, 2)) <= 3 AS ok FROM g LEFT JOIN pub USING (arch, scenario)""")
def paper_check(spark, sf):
    parts = scores(spark, sf).withColumns({"arch": F.regexp_extract("model", "^(.*)-([^-]*)$", 1), "scenario": F.regexp_extract("model", "^(.*)-([^-]*)$", 2)})
    return metrics.paper_check(parts, spark.createDataFrame(_PUBLISHED, "arch string, scenario string, paper double"))


_MODELS = "mkqxyz"
_SIX = f"""md(model) AS (VALUES {', '.join(f"('{m}')" for m in _MODELS)}), lb AS (SELECT doc_id, model, 0 AS label_id, quality AS y, {S.pseudo("' || model || '0")} AS p FROM labels CROSS JOIN md
  UNION ALL SELECT doc_id, model, 1, toxic, {S.pseudo("' || model || '1")} FROM labels CROSS JOIN md), ev AS (SELECT *, 'all' AS subset FROM lb UNION ALL SELECT *, 'r' || (doc_id % 3) FROM lb)"""


@query(f"""WITH {_SIX}, {S.counts(keys='model, subset')}, w AS (SELECT model, max(macro_f1) FILTER (WHERE subset = 'all') AS a, max(macro_f1) FILTER (WHERE subset = 'r0') AS r0, max(macro_f1) FILTER (WHERE subset = 'r1') AS r1 FROM mt GROUP BY model),
g AS (SELECT model, 'r0-r1' AS gap, r0 - r1 AS value FROM w UNION ALL SELECT model, 'r0-all', r0 - a FROM w),
d AS (SELECT gap, value, row_number() OVER (PARTITION BY gap ORDER BY model) - 1 AS i, 2 * rank() OVER (PARTITION BY gap ORDER BY abs(value)) + count(*) OVER (PARTITION BY gap, abs(value)) - 1 AS r2 FROM g WHERE value <> 0),
st AS (SELECT gap, least(sum(r2 * (value > 0)::INT), sum(r2 * (value < 0)::INT)) AS low FROM d GROUP BY gap),
signs AS (SELECT gap, s.pattern, sum(r2 * ((s.pattern >> d.i) & 1)) AS v FROM d CROSS JOIN range({2 ** len(_MODELS)}) s(pattern) GROUP BY gap, s.pattern),
pv AS (SELECT gap, least(1, 2 * count_if(v <= low) / count(*)) AS p FROM signs JOIN st USING (gap) GROUP BY gap)
SELECT gap, count(*)::INT AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count_if(value > 0)::INT AS positive, round(any_value(p), 6) AS p_value FROM g JOIN pv USING (gap) GROUP BY gap""")
def signed_rank(spark, sf):
    """Tests of subset gaps over six pseudo-models; the SQL lists all patterns of signs."""
    parts = [metrics.subset_metrics(evaluated(spark, sf, m), ["subset"]).withColumn("model", F.lit(m)) for m in _MODELS]
    return rounded(resampling.signed_rank_table(metrics.gaps(reduce(DataFrame.unionByName, parts), [("r0", "r1"), ("r0", "all")])), "mean", "sd", "p_value")


# Training histories


def history(spark, sf) -> DataFrame:
    """Twelve epochs of three runs, scored by means of pseudo-random numbers."""
    rows = read(spark, sf, "labels").select(F.concat(F.lit("run"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("model"), F.pmod("doc_id", F.lit(12)).alias("epoch"), pseudo("doc_id", "h").alias("x"))
    return rows.groupBy("model", "epoch").agg(F.round(F.avg("x"), 6).alias("macro_f1"))


_HISTORY = f"h AS (SELECT 'run' || (doc_id % 3) AS model, doc_id % 12 AS epoch, round(avg({S.pseudo('h')}), 6) AS macro_f1 FROM labels GROUP BY 1, 2)"


@query(f"WITH {_HISTORY} SELECT model, epoch, macro_f1 FROM h QUALIFY row_number() OVER (PARTITION BY model ORDER BY macro_f1 DESC, epoch) = 1")
def best_epoch(spark, sf):
    return metrics.best_epoch(history(spark, sf))


# Labels and text


_LIST = "'[' || concat_ws(', ', CASE WHEN quality = 1 THEN '''quality''' END, CASE WHEN toxic = 1 THEN '''toxic''' END) || ']'"


@query(f"SELECT doc_id, {_LIST} AS written, {_WRITTEN.format('quality', 'toxic')} AS names, concat_ws(',', CASE WHEN quality = 1 THEN '0' END, CASE WHEN toxic = 1 THEN '1' END) AS ids, (quality = 1)::INT AS label_quality, (toxic = 1)::INT AS label_toxic FROM labels")
def label_names(spark, sf):
    names = ["quality", "toxic"]
    quoted = F.concat_ws(", ", *[F.when(F.col(n) == 1, F.lit(f"'{n}'")) for n in names])
    rows = read(spark, sf, "labels").select("doc_id", F.concat(F.lit("["), quoted, F.lit("]")).alias("written"))
    ids = L.encode_labels(F.col("written"), names)
    wide = [c.cast("int").alias(k) for k, c in L.wide_labels(ids, names).items()]
    return rows.select("doc_id", "written", F.array_join(L.split_labels(F.col("written")), ", ").alias("names"), F.array_join(ids.cast("array<string>"), ",").alias("ids"), *wide)


_EMOJI_SQL = reduce(lambda x, k: "replace({}, '{}', ' {} ')".format(x, k.replace("'", "''"), EMOJI_WORDS[k].replace("'", "''")), sorted(EMOJI_WORDS, key=len, reverse=True), "text")


_FACES = "translate(text, 'ehaoiunm', '😂😍😢😡❤:)(')"


@query(f"WITH {S.DOCS}, t AS (SELECT doc_id, {_FACES} AS text FROM docs) SELECT doc_id, md5({_EMOJI_SQL}) AS named FROM t")
def emoji_names(spark, sf):
    """Documents whose commonest letters stand for faces and emoticons, with these named."""
    return docs(spark, sf).select("doc_id", F.md5(X.replace_literals(F.translate(F.coalesce("text", F.lit("")), "ehaoiunm", "😂😍😢😡❤:)("))).alias("named"))


def _words_sql(text: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_À-ỹ]+|[^\p{{L}}\p{{N}}_À-ỹ]+'), lambda p: {_TEEN}), '')"


def _spaces_sql(text: str) -> str:
    return "trim(regexp_replace({}, '{}', ' ', 'g'))".format(text, X.SPACES.replace("]+", r"\x0b]+"))


@query(f"""WITH {S.DOCS}, c AS (SELECT doc_id, {_COMMON.replace("coalesce(html, '')", "text")} AS text FROM docs), e AS (SELECT doc_id, text, {_EMOJI_SQL} AS named FROM c)
SELECT doc_id, md5({_spaces_sql(_words_sql('text'))}) AS text_s1, md5({_spaces_sql(_words_sql('named'))}) AS text_s2, md5({_spaces_sql('text')}) AS text_s3 FROM e""")
def scenario_texts(spark, sf):
    """The three scenarios of every document; ``scenarios`` adds the model's form, which has no SQL."""
    return X.with_scenarios(docs(spark, sf)).select("doc_id", *[F.md5(f"text_{k}").alias(f"text_{k}") for k in ("s1", "s2", "s3")])


@query("SELECT page_id, md5('classification: ' || lower(coalesce(html, ''))) AS prefixed FROM pages")
def task_prefix(spark, sf):
    """The lower-cased model form with a task prefix."""
    return read(spark, sf, "pages").select("page_id", F.md5(X.task_prefix(F.lower(F.coalesce("html", F.lit(""))))).alias("prefixed"))
