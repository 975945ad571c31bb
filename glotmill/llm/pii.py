"""Personal data: pattern spans, and terms that give a protected entity away, in DataFrame functions only.

The patterns find e-mail addresses, IP addresses, payment cards and telephone numbers. What else a text says can still
reveal such an entity, so the corpus itself says how strongly: with n(t), n(e) and n(t, e) the numbers of documents that
hold the term, the entity, and both (wherever they stand in it), and N that of all documents,

    disclosure(t, e) = PMI(t, e) / IC(e) = log(N p(e | t) / n(e)) / log(N / n(e)),    p(e | t) = n(t, e) / n(t),

the share of the entity's information that the term gives. For p(e | t) its lower bound at ``evidence`` standard errors
(Wilson's) is taken, so that rare terms and entities count by the evidence there is, and no number of documents is
asked for. Candidates are terms that somewhere stand within ``window`` words of the entity. Those over the threshold
become spans of kind ``term`` at every place where they stand in any document that holds the entity. Entities are
generalised to their kind, terms to ``[TERM]``, or removed.

All counts cover all documents. As n(t, e) is at most n(t) and n(e), most candidates are out before pairs are counted;
a pair is counted over the documents of its rarer part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import cut_lineage
from glotmill.llm.spans import NONE, find_spans, let, pieces_of, running, stretch


@dataclass(frozen=True)
class Disclosure:
    window: int = 8  # words on either side of an entity in which candidates are looked for
    evidence: float = 1.64  # standard errors by which p(e | t) is lowered
    threshold: float = 0.7  # share of the entity's information


#: Kinds in the order of the contract. The repeated groups of the stated patterns are written as repeated characters
#: (see spans.py); possessive runs and lookbehinds keep long runs of letters or digits linear.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=[0-9](?:[\x20-]?[0-9]){12})[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])*"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column) -> Column:
    """True for a digit string that passes Luhn's test; every second digit from the right counts double."""
    turned = F.reverse(value)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(value)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(turned, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(sum(divmod(2 * d, 10))) for d in range(10)]), F.substring(turned, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def ip_ok(value: Column) -> Column:
    """Each part at most 255; leading zeros count for nothing."""
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> dict[str, Column]:
    n = lambda m: F.length(digits(m))
    return {
        "email": find_spans(text, "email", 0, EMAIL),
        "ip": find_spans(text, "ip", 1, IP, lambda m, _: ip_ok(m)),
        "card": find_spans(text, "card", 2, CARD, lambda m, _: F.when(n(m).between(13, 19), luhn(digits(m))).otherwise(F.lit(False))),
        "phone": find_spans(text, "phone", 3, PHONE, lambda m, _: n(m).between(9, 15)),
    }


def entity_key(span: Column) -> Column:
    """Spellings of one entity: e-mail addresses in any case, cards and telephone numbers by digits, IP addresses as they stand."""
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(digits(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def marked(text: Column, base: Column) -> Column:
    """Entities and the terms that overlap none of them, by place; array of spans."""
    every = F.array_sort(F.concat(base, find_spans(text, "term", len(KINDS), TERM)))

    def apart(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda x: F.when(is_entity(x), x["stop"]).otherwise(F.lit(0))), "int", F.greatest)

        def free(x: Column, i: Column, e: Column) -> Column:
            # terms do not overlap each other, so what starts inside one is an entity and stands next to it
            following = F.get(spans, i + 1)
            return (F.element_at(e, i + 1) <= x["start"]) & ~F.coalesce(following["start"] < x["stop"], F.lit(False))

        return let(ends, lambda e: F.filter(spans, lambda x, i: is_entity(x) | free(x, i, e)))

    return let(every, apart)


def is_entity(span: Column) -> Column:
    return span["ord"] < len(KINDS)


def scan(docs: DataFrame, config: Disclosure, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: row key, id, base spans; where there are any also the entities, (entity, t) for the
    terms near each, and all terms with their places.
    """
    found = base_spans(F.col("text"))
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("base", F.concat(*[found[k] for k in KINDS]))
    rows = rows.withColumn("all", F.when(F.size("base") > 0, marked(F.col("text"), F.col("base"))).otherwise(F.expr(NONE)))

    def near(every: Column) -> Column:
        def around(x: Column, i: Column) -> Column:
            first = F.greatest(i - config.window, F.lit(0))
            terms = F.filter(F.slice(every, first + 1, i + config.window + 1 - first), lambda y: ~is_entity(y))
            return F.transform(terms, lambda y: F.struct(entity_key(x).alias("entity"), F.lower(y["value"]).alias("t")))

        return F.flatten(F.transform(every, lambda x, i: F.when(is_entity(x), around(x, i)).otherwise(F.expr("cast(array() as array<struct<entity:string,t:string>>)"))))

    marks = F.transform(F.filter("all", lambda x: ~is_entity(x)), lambda x: F.struct(F.lower(x["value"]).alias("t"), x["start"].alias("start"), x["stop"].alias("stop")))
    return rows.select(
        row_key(F.col("doc"), F.col("text")).alias("row"), "doc", "base",
        F.array_distinct(F.transform("base", entity_key)).alias("entities"), let(F.col("all"), near).alias("near"), marks.alias("marks"),
    )


def row_key(doc: Column, text: Column) -> Column:
    """Tells rows apart by id and text; rows that repeat both are one document in the statistics."""
    return F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("-")), F.xxhash64(text).cast("string"))


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(t, n_t): in how many rows of ``docs`` each term stands; a task sends one row per distinct term of its texts."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TERM), F.lit(0)))
    return docs.select(F.explode(words).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))


def disclosed_share(n_te: Column, n_t: Column, n_e: Column, total: Column, evidence: float) -> Column:
    """Share of the entity's information that the term gives, by the lower bound of p(e | t); all counts as doubles."""
    n, p, z2 = n_t.cast("double"), n_te / n_t.cast("double"), evidence * evidence
    low = (p + z2 / (2 * n) - evidence * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    scale = total.cast("double") / n_e
    return F.when(scale > 1, F.log(low * scale) / F.log(scale)).otherwise(F.lit(0.0))


def disclosing_terms(docs: DataFrame, scanned: DataFrame, config: Disclosure, text_col: str = "text") -> DataFrame:
    """(row, risky): for rows that have any, the terms over the threshold for an entity of the row. ``scanned`` is read
    several times.
    """
    holders = scanned.select("row", F.explode("entities").alias("entity")).distinct()
    words = scanned.select("row", F.explode(F.array_distinct(F.transform("marks", lambda m: m["t"]))).alias("t")).distinct()
    near = scanned.select(F.explode("near").alias("n")).select("n.*").groupBy("entity", "t").agg(F.lit(1).alias("one")).drop("one")
    total = scanned.agg(F.count(F.lit(1)).alias("total"))
    share = lambda n_te: disclosed_share(n_te, F.col("n_t"), F.col("n_e"), F.col("total"), config.evidence)
    known = (
        near.join(holders.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")), "entity")
        .join(document_frequencies(docs, text_col), "t")
        .join(F.broadcast(total))  # one row
    )
    pairs = cut_lineage(known.where(share(F.least("n_e", "n_t")) >= config.threshold))
    # each pair meets the documents of its rarer part, and stays where the other part stands too
    by_entity = pairs.where("n_e <= n_t").join(holders, "entity").join(words, ["row", "t"], "left_semi")
    by_term = pairs.where("n_e > n_t").join(words, "t").join(holders, ["row", "entity"], "left_semi")
    met = cut_lineage(by_entity.unionByName(by_term))
    risky = met.groupBy("entity", "t").agg(F.count(F.lit(1)).alias("n_te"), *[F.first(c).alias(c) for c in ("n_t", "n_e", "total")])
    risky = risky.where(share(F.col("n_te")) >= config.threshold).select("entity", "t")
    return met.join(risky, ["entity", "t"], "left_semi").groupBy("row").agg(F.collect_set("t").alias("risky"))


def places(marks: Column, risky: Column) -> Column:
    """Spans of the ``marks`` (sorted by place) whose term is among ``risky``; both are sorted together, not compared."""
    at = lambda t, own, start, stop: F.struct(t.alias("t"), F.lit(own).alias("own"), start.alias("start"), stop.alias("stop"))
    asked = F.transform(risky, lambda t: at(t, 0, F.lit(0), F.lit(0)))
    every = F.array_sort(F.concat(asked, F.transform(marks, lambda m: at(m["t"], 1, m["start"], m["stop"]))))

    def chosen(rows: Column) -> Column:
        last = running(F.transform(rows, lambda x: F.when(x["own"] == 0, x["t"])), "string", lambda a, b: F.coalesce(b, a))
        return let(last, lambda e: F.filter(rows, lambda x, i: (x["own"] == 1) & F.coalesce(F.element_at(e, i + 1) == x["t"], F.lit(False))))

    span = lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("ord"), x["stop"].alias("stop"), F.lit("term").alias("kind"), x["t"].alias("value"))
    return F.array_sort(F.transform(let(every, chosen), span))


def personal_spans(docs: DataFrame, config: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: row, doc, base (pattern spans by kind, then start), terms (term spans by start).

    Null and empty texts have no spans, repeated rows get the spans of their text, a null id keeps its row, an empty
    table gives an empty result, and other columns are not read.
    """
    scanned = cut_lineage(scan(docs, config, id_col, text_col))
    found = scanned.join(disclosing_terms(docs, scanned, config, text_col), "row", "left")
    return found.select("row", "doc", "base", F.when(F.col("risky").isNotNull(), places(F.col("marks"), F.col("risky"))).otherwise(F.expr(NONE)).alias("terms"))


def sanitise(docs: DataFrame, config: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text", remove_terms: bool = False) -> DataFrame:
    """``docs`` with every entity generalised to ``[KIND]`` and every disclosing term to ``[TERM]`` (or removed).

    Where spans overlap, the one that starts first (of these the longest) is written and the text of the others goes
    with it. Rows without spans keep their text, null texts stay null.
    """
    found = personal_spans(docs, config, id_col, text_col).where(F.size("base") + F.size("terms") > 0)
    spans = found.dropDuplicates(["row"]).select(F.col("row").alias("__row"), F.concat("base", "terms").alias("__spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct("*").alias("__doc"), row_key(F.col(id_col), text).alias("__row"), F.col(text_col).alias("__text")).join(spans, "__row", "left")
    clean = F.when(F.col("__spans").isNull(), F.col("__text")).otherwise(rewritten(F.coalesce("__text", F.lit("")), F.col("__spans"), remove_terms))
    return keyed.withColumn("__clean", clean).select(*[F.col("__clean").alias(c) if c == text_col else F.col("__doc")[c].alias(c) for c in docs.columns])


def rewritten(text: Column, spans: Column, remove_terms: bool = False) -> Column:
    """``text`` with its spans generalised; there is at least one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("low"), s["kind"].alias("kind"))))
    label = lambda kind: F.when((kind == "term") & F.lit(remove_terms), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))

    def written(rows: Column, pieces: Column) -> Column:
        def join(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            kept = F.transform(rows, lambda x, i: F.when(x["start"] >= before(i), F.concat(stretch(pieces, before(i), x["start"]), label(x["kind"]))).otherwise(F.lit("")))
            return F.concat(F.array_join(kept, ""), stretch(pieces, F.element_at(ends, -1), F.length(text)))

        return let(running(F.transform(rows, lambda x: -x["low"]), "int", F.greatest), join)

    return let(ordered, lambda rows: let(pieces_of(text), lambda pieces: written(rows, pieces)))
