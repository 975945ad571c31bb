"""Readers for loosely formatted comment tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names that stand for a column, first match first, and spellings of splits.
ALIASES = {
    "text": ["comment", "sentence", "content", "clean_text", "raw_text", "cmt"],
    "labels": ["label", "emotion", "emotions", "target", "targets", "y"],
    "split": ["set", "data_split", "partition"],
}
VAL = ["validation", "valid", "dev", "eval"]
SHEETS = ["train", "val", "dev", "validation", "test"]
SUFFIXES = ("csv", "tsv", "parquet", "json", "jsonl", "xlsx", "xls")
REANNOTATED = ("cs_", "has_", "n_", "english_", "teencode_", "is_cs", "emoji_", "url_", "mention_", "hashtag_")


def normal_split(split: Column) -> Column:
    """S16."""
    s = F.lower(F.trim(split))
    return F.when(s.isin(VAL), "val").otherwise(s)


def standardise(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Renames by alias, case-insensitively, where the canonical name is missing; ``text`` must be there."""
    names: dict[str, str] = {}
    for canonical, others in aliases.items():
        by_lower = {c.lower(): c for c in reversed(df.columns)}
        if canonical not in df.columns:
            found = next((by_lower[a] for a in [canonical, *others] if a in by_lower and by_lower[a] not in names), None)
            if found:
                names[found] = canonical
    out = df.withColumnsRenamed(names)
    if "text" not in out.columns:
        raise ValueError(f"no text column among {df.columns}")
    return out.withColumn("split", normal_split(F.col("split"))) if "split" in out.columns else out


def read_excel(spark: SparkSession, path: str, strict: bool = False, infer: bool = True) -> DataFrame:
    """A workbook or a folder of them. Sheets named after splits are one table with that split; of a workbook
    without such sheets the first counts. Columns are united by name.

    Headings are read by a job over the workbooks, rows with a sheet a partition. Types hold for all rows of a column:
    whole numbers, numbers and booleans where every cell is one, text otherwise; finding them reads the sheets once
    more (``infer=False``: all text).
    """
    from glotmill.sources.workbook import FORMAT, Sheet, WorkbookSource, find_sheets, find_workbooks

    spark.dataSource.register(WorkbookSource)
    paths = find_workbooks(path)
    if not paths or not all(p.endswith(".xlsx") for p in paths):
        raise ValueError(f"no .xlsx workbook: {path}")

    def sheets_in(frames):
        import pandas as pd

        for frame in frames:
            found = [[json.dumps(vars(s)) for s in find_sheets(p)] for p in frame["path"]]
            yield pd.DataFrame({"place": frame["place"], "sheets": found})

    books = spark.createDataFrame(list(enumerate(paths)), "place long, path string").repartition(min(len(paths), 1000))
    listed = [[Sheet(**json.loads(s)) for s in r.sheets] for r in sorted(books.mapInPandas(sheets_in, "place long, sheets array<string>").collect())]
    plain = (lambda name: name) if strict else (lambda name: name.lower().strip())
    named = [[s for s in book if plain(s.name) in SHEETS] for book in listed]
    if strict and not {"train", "val", "test"} <= {s.name for book in named for s in book}:
        raise ValueError("sheets train, val and test are needed")
    chosen = [s for book, of_splits in zip(listed, named) for s in (of_splits or book[:1])]
    columns = list(dict.fromkeys(c for s in chosen for c in s.columns))
    quoted = {c: f"`{c.replace('`', '``')}`" for c in columns}
    rows = spark.read.format(FORMAT).option("path", path).option("sheets", json.dumps([vars(s) for s in chosen]))
    types = dict.fromkeys(columns, "string")
    if infer and columns:
        text = ", ".join(f"{q} string" for q in quoted.values())
        kinds = rows.schema(text).option("kinds", "true").load().agg(*[F.collect_set(q).alias(f"k{i}") for i, q in enumerate(quoted.values())]).first()
        of = {("i",): "bigint", ("n",): "double", ("i", "n"): "double", ("b",): "boolean"}
        types = {c: of.get(tuple(sorted(k)), "string") for c, k in zip(columns, kinds)}
    df = rows.schema(", ".join(["_sheet string", *[f"{quoted[c]} {t}" for c, t in types.items()]])).option("kinds", "false").load()
    if any(named):
        sheet = F.col("_sheet") if strict else F.lower(F.trim("_sheet"))
        df = df.withColumn("split", F.when(sheet.isin(SHEETS), normal_split(sheet)))
    return df.drop("_sheet")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """S1 to S6, by suffix. Comments hold line feeds and quotes, so a CSV file is one task, however large: a table of that
    size should come in many files, or as Parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    text = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    if suffix in ("csv", "tsv"):
        return spark.read.options(**text, sep="\t" if suffix == "tsv" else ",").csv(path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("json", "jsonl"):
        return spark.read.option("multiLine", suffix == "json").json(path)
    if suffix in ("xlsx", "xls"):
        return read_excel(spark, path)
    raise ValueError(f"unknown kind of file: {path}")


def from_frames(spark: SparkSession, train, val, test) -> DataFrame:
    """Three in-memory frames as one table with their split (files of pickled objects are not read)."""
    parts = [spark.createDataFrame(f).withColumn("split", F.lit(s)) for s, f in (("train", train), ("val", val), ("test", test))]
    return standardise(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def split_from_path(path: Column) -> Column:
    """The split that a file's name tells."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.contains("train"), "train").when(name.rlike("val|dev"), "val").when(name.contains("test"), "test")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """All files below a directory; tables that bring their own split win over those whose split is in the name."""
    kinds = {"csv": {"header": True, "multiLine": True, "quote": '"', "escape": '"'}, "tsv": {"header": True, "multiLine": True, "quote": '"', "escape": '"', "sep": "\t"}, "parquet": {}, "json": {"multiLine": True}, "jsonl": {}}
    own, named = [], []
    for kind, options in kinds.items():
        reader = spark.read.options(recursiveFileLookup=True, pathGlobFilter=f"*.{kind}", ignoreCorruptFiles=True, **options)
        fmt = {"tsv": "csv", "jsonl": "json"}.get(kind, kind)
        try:
            df = reader.format(fmt).load(path)
            if not df.columns or df.isEmpty():
                continue
            table = standardise(df.withColumn("__path", F.input_file_name()))
        except Exception as e:  # no file of this kind, or none with a text
            if "UNABLE_TO_INFER_SCHEMA" in str(e) or "no text column" in str(e):
                continue
            raise
        (own if "split" in table.columns else named).append(table)
    tables = own or [t.withColumn("split", F.coalesce(split_from_path(F.col("__path")), F.lit("unknown"))) for t in named]
    if not tables:
        raise ValueError(f"no readable table below {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).drop("__path")


def require_splits(df: DataFrame, needed=("train", "val", "test")) -> DataFrame:
    """S10."""
    found = {r[0] for r in df.select("split").distinct().limit(100).collect()}
    if not set(needed) <= found:
        raise ValueError(f"splits {sorted(set(needed) - found)} are missing")
    return df


def with_ids(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows with text, with a string id; missing ids are 0 to n - 1 in order of position.

    Positions come from the partitions' sizes (one small count each), not from a sort into one task.
    """
    rows = df.where(F.col("text").isNotNull())
    if "id" in rows.columns:
        return rows.withColumn("id", F.col("id").cast("string"))
    marked = rows.withColumn("__m", F.monotonically_increasing_id())
    part, local = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__o"))  # a row per partition
    return marked.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn("id", (F.col("__o") + local).cast("string")).drop("__m", "__p", "__o")


def drop_annotations(df: DataFrame) -> DataFrame:
    """S18."""
    return df.drop(*[c for c in df.columns if c.startswith(REANNOTATED)])


def load_annotations(spark: SparkSession, path: str, split: str, text_col: str = "text", labels: list[str] | None = None) -> DataFrame:
    """Annotated rows of one split, another text column on demand, labels as ``y_true``."""
    from glotmill.functions.labels import multi_hot, parse_label_list
    from glotmill.lexicon import LABELS

    names = labels or LABELS
    df = read_table(spark, path).where(F.col("split") == split)
    if text_col not in df.columns:
        raise KeyError(text_col)
    df = df.withColumn("text", F.col(text_col))
    wide = [f"label_{n}" for n in names]
    true = F.array(*[F.col(c).cast("tinyint") for c in wide]) if set(wide) <= set(df.columns) else multi_hot(parse_label_list(F.col("label_ids"), len(names)), len(names))
    return df.withColumn("y_true", true)


def read_cache(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """Annotation cache lines; malformed ones are dropped, of each (id, _tag) the last stays.

    Entries that ``append_cache`` wrote are in the order of their runs. Lines without a run are older than those; among
    them the time of the file counts, then its name and the place in it.
    """
    from glotmill.operators.detect_v3 import CACHE_SCHEMA, keep_last

    rows = spark.read.schema(CACHE_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("id is not null")
    # within a split of a file lines have rising ids; splits are told apart by where they start
    place = [F.col(f"_metadata.{c}") for c in ("file_modification_time", "file_path", "file_block_start")]
    rows = rows.withColumn("_seq", F.struct(F.coalesce("_seq", F.lit(-1)).alias("run"), *place, F.monotonically_increasing_id().alias("line")))
    return keep_last(rows, tag).withColumn("_seq", F.col("_seq.run"))


def read_lexicon(spark: SparkSession, path: str) -> dict[str, str]:
    """A dictionary file, tab-separated or JSON, in the file's order and with its keys' case.

    It is of a word list's size, so it is read whole. Lines without a tab are left out, of a repeated key the last value
    counts (at the key's first place), and values that are no strings are written as JSON.
    """
    rows = spark.read.text(path, wholetext=True).orderBy(F.input_file_name()).collect()
    text = "\n".join(r[0] for r in rows)
    if path.endswith(".json"):
        return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in json.loads(text).items()}
    pairs = (line.strip("\r").split("\t", 1) for line in text.split("\n"))
    return {p[0].strip(): p[1].strip() for p in pairs if len(p) == 2}


def read_metrics(spark: SparkSession, root: str, name: str = "metrics.csv") -> DataFrame:
    """All models' metric files; a tag ``arch-scenario`` is cut at its last hyphen."""
    df = spark.read.csv(f"{root}/*/{name}", header=True, inferSchema=True)
    return df.withColumns({"arch": F.regexp_extract("model", "^(.*)-([^-]*)$", 1), "scenario": F.regexp_extract("model", "^(.*)-([^-]*)$", 2)})


# Which piece of a directory's name tells the architecture, in order.
ARCHITECTURES = [("visobert", "visobert"), ("cafebert", "cafebert"), ("phobert", "phobert"), ("bartpho", "bartpho"), ("vit5", "vit5"), ("vibert", "vibert"), ("mbert", "mbert"), ("bertbasemultilingual", "mbert"), ("xlmr", "xlmr"), ("xlmroberta", "xlmr")]


def guess_model(name: Column) -> Column:
    """Struct of arch and scenario from a directory's name; the first piece that is in it counts."""
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    arch = F.coalesce(*[F.when(plain.contains(k), F.lit(v)) for k, v in ARCHITECTURES])
    scenario = F.coalesce(*[F.when(F.lower(name).rlike(rf"(^|[^a-z0-9]){s}([^a-z0-9]|$)"), F.lit(s)) for s in ("s1", "s2", "s3")])
    return F.struct(arch.alias("arch"), scenario.alias("scenario"))


def discover_models(names: DataFrame) -> DataFrame:
    """(path, arch, scenario, tag) of directory names; unmatched ones have null arch, repeated tags a suffix."""
    from glotmill.operators.stats import dense_tags

    found = names.select("path", guess_model(F.element_at(F.split("path", "/"), -1)).alias("g")).select("path", "g.*")
    return dense_tags(found.withColumn("tag", F.concat_ws("-", "arch", F.coalesce("scenario", F.lit("s0")))))
