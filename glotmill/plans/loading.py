"""Queries over readers, writers and what loading checks, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotmill.functions.labels import strict_label_vector
from glotmill.operators import metrics
from glotmill.operators.lineage import kept, shared_folder
from glotmill.plans import sql as S
from glotmill.plans.reference import _scores_sql, docs, evaluated, pseudo, query, read, rounded, scores, spread
from glotmill.sources.readers import drop_annotations, load_annotations, read_cache, read_excel, read_metrics, read_table
from glotmill.sources.writers import append_cache, run_config, write_by_split, write_csv, write_jsonl, write_report, write_workbooks


def scratch(spark: SparkSession) -> str:
    """A new folder in the session's shared one."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def told(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), "lang", F.col("n_chars").cast("long").alias("n_chars"))


_TOLD = "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents"


@query(_TOLD)
def csv_round_trip(spark, sf):
    path = f"{scratch(spark)}/docs.csv"
    write_csv(read(spark, sf, "documents"), path)
    return told(read_table(spark, path))


@query(_TOLD)
def jsonl_round_trip(spark, sf):
    path = f"{scratch(spark)}/docs.jsonl"
    write_jsonl(read(spark, sf, "documents"), path)
    return told(read_table(spark, path))


@query("SELECT conv_id AS id, role AS _tag, md5(text) AS text_md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn % 2, turn DESC) = 1")
def cache_round_trip(spark, sf):
    """Two runs append to a cache, the even turns after the odd ones; within a run the last turn of each id and tag is sent."""
    said, path = read(spark, sf, "conversations"), f"{scratch(spark)}/cache.jsonl"
    for run, odd in ((1, 1), (2, 0)):
        part = said.where(F.col("turn") % 2 == odd).groupBy(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("_tag")).agg(F.max_by("text", "turn").alias("text"))
        append_cache(part, path, run)
    return read_cache(spark, path).select(F.col("id").cast("long").alias("id"), "_tag", F.md5("text").alias("text_md5"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '1,0,1' WHEN 1 THEN '0,0,1' WHEN 2 THEN '0,1,0' WHEN 3 THEN '1,1,0' ELSE '0,0,0' END AS vector FROM documents""")
def label_vector_strict(spark, sf):
    """One-hot, negative number, written list with items out of range, loose text, null."""
    written = F.element_at(F.array(F.lit("[1, 0, 1.0]"), F.lit("-1"), F.lit("['1', 7, -2]"), F.lit("0;1"), F.lit(None).cast("string")), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.transform(strict_label_vector(written, 3), lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query(f"WITH {S.EVAL}, r AS (SELECT subset, doc_id, sum((p >= 0.5)::INT) AS np FROM ev GROUP BY 1, 2) SELECT subset, round(avg(np), 6) AS avg_pred_per_sample, avg(np) < 10 AS plausible FROM r GROUP BY subset")
def density_check(spark, sf):
    return rounded(metrics.density_check(evaluated(spark, sf), ["subset"]), "avg_pred_per_sample")


@query(f"WITH {S.DOCS} SELECT split AS subset, round(avg({S.pseudo('width')} * 0.1), 6) AS ci_width FROM docs GROUP BY split")
def ci_width(spark, sf):
    rows = docs(spark, sf).select("split", F.col("doc_id").alias("id"))
    scored = rows.select(F.col("split").alias("subset"), F.lit(0.0).alias("macro_f1_lo"), (pseudo("id", "width") * 0.1).alias("macro_f1_hi"))
    return rounded(metrics.mean_ci_width(scored), "ci_width")


# Workbooks, folders and reports


@query("SELECT doc_id, md5(text) AS text_md5, lang, n_chars, CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM documents")
def workbook_round_trip(spark, sf):
    """All documents as workbooks with a sheet for each split, read as one table."""
    r, path = F.pmod("doc_id", F.lit(10)), f"{scratch(spark)}/books"
    rows = spread(read(spark, sf, "documents")).select("doc_id", "text", "lang", "n_chars", F.when(r == 8, "dev").when(r == 9, "Test").otherwise("train").alias("set"))
    write_workbooks(rows, path, sheet="set")
    return read_excel(spark, path).select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars", "split")


@query(f"WITH {_scores_sql()} SELECT model, subset, n_samples::BIGINT AS n_samples, round(macro_f1, 4) AS macro_f1, round(micro_f1, 4) AS micro_f1 FROM mt WHERE n_samples >= 5")
def report_workbook(spark, sf):
    """Scores and their pivot as sheets of one workbook; its first sheet, read again."""
    path = f"{scratch(spark)}/report.xlsx"
    found = kept(scores(spark, sf).select("model", "subset", "n_samples", "macro_f1", "micro_f1"))
    write_report({"detail": found, "macro_f1": metrics.compare(found)}, path)
    return read_excel(spark, path)


@query(f"WITH {_scores_sql()} SELECT split_part(model, '-', 1) AS arch, split_part(model, '-', 2) AS scenario, subset, round(macro_f1, 6) AS macro_f1 FROM mt WHERE model <> 'q-s1' AND n_samples >= 5")
def metric_folders(spark, sf):
    """A folder with a metrics file for each of two models, read as one table."""
    root, found = scratch(spark), kept(scores(spark, sf).select("model", "subset", "macro_f1"))
    for model in ("m-s1", "k-s1"):
        write_csv(found.where(F.col("model") == model), f"{root}/{model}/metrics.csv")
    return rounded(read_metrics(spark, root), "macro_f1").select("arch", "scenario", "subset", "macro_f1")


@query(f"WITH {S.DOCS}, l AS (SELECT doc_id, quality, toxic FROM labels) SELECT doc_id, md5(lower(text)) AS text_md5, quality || ',' || toxic || ',0' AS y FROM docs JOIN l USING (doc_id) WHERE split = 'val'")
def annotation_reload(spark, sf):
    """Labelled documents stored by split; one split is read again, with another column as its text and written label lists.

    Of three labels, so that no list of both others is as long as the vocabulary: that would be a one-hot list.
    """
    labelled = docs(spark, sf).join(read(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    ids = F.concat(F.lit("["), F.concat_ws(", ", F.when(F.col("quality") == 1, "0"), F.when(F.col("toxic") == 1, "1")), F.lit("]"))
    path = f"{scratch(spark)}/annotated.parquet"
    write_by_split(labelled.select("doc_id", "text", F.lower("text").alias("plain"), "split", ids.alias("label_ids")), path)
    back = load_annotations(spark, path, "val", text_col="plain", labels=["quality", "toxic", "other"])
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.array_join(F.transform("y_true", lambda x: x.cast("string")), ",").alias("y"))


@query("SELECT doc_id, md5(text) AS text_md5, lang, source FROM documents")
def reannotation_columns(spark, sf):
    """What an earlier annotation left (here a group, and ``n_chars`` by its name) goes before the next one."""
    left = drop_annotations(read(spark, sf, "documents").withColumn("cs_group", F.col("lang")).withColumn("is_cs_strict", F.lit(True)))
    return left.select(*["doc_id", F.md5("text").alias("text_md5")], *[c for c in left.columns if c not in ("doc_id", "text")])


@query("SELECT 'lang' AS argument, (SELECT count(*) FROM documents)::BIGINT AS n_rows, lang AS cs_group, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def run_configuration(spark, sf):
    """The run's JSON with languages as groups, taken apart again."""
    told_ = run_config(read(spark, sf, "documents").withColumn("cs_group", F.col("lang")), {"argument": "lang"})
    parsed = spark.createDataFrame([(told_,)], "j string").select(F.from_json("j", "argument string, n_rows long, cs_group map<string,long>").alias("j")).select("j.*")
    return parsed.select("argument", "n_rows", F.explode("cs_group").alias("cs_group", "n"))
