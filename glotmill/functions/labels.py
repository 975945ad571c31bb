"""Label lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glotmill.lexicon import LABELS


def parse_label_list(labels: Column, size: int = len(LABELS)) -> Column:
    """L1: a written list, one-hot list or number to label ids.

    Null gives no labels; a one-hot list of the vocabulary's length its positions; other lists the whole numbers in
    range; a list of names none. Numbers out of range are dropped.
    """
    text = F.trim(labels.cast("string"))
    literal = F.from_json(text, "array<string>")
    items = F.when(text.startswith("["), literal)
    numbers = F.coalesce(
        F.transform(F.filter(items, lambda s: s.rlike(r"^\s*-?\d+(\.0*)?\s*$")), lambda s: s.cast("double").cast("int")),
        F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda s: s.try_cast("int")),
    )
    one_hot = (F.size(items) == size) & F.forall(items, lambda s: s.rlike(r"^\s*[01]\s*$"))
    positions = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.trim(F.element_at(items, i + 1)) == "1")
    ids = F.when(one_hot, positions).otherwise(F.filter(numbers, lambda v: (v >= 0) & (v < size)))
    return F.when(labels.isNull(), F.expr("cast(array() as array<int>)")).otherwise(ids)


def strict_label_vector(labels: Column, size: int = len(LABELS)) -> Column:
    """L4: a written list, one-hot list or number to a 0/1 vector, as training reads it.

    Of a list, whole numbers in range count and others are dropped, but an item that is no number fails the query. A
    single number counts from the end if it is negative; out of range, null or empty, nothing is set.
    """
    text = F.trim(labels.cast("string"))
    listed, single = text.rlike(r"^[\[(].*[\])]$"), text.rlike(r"^[+-]?\d+(\.\d*)?$")
    items = F.filter(F.transform(F.split(F.regexp_replace(text, r"^[\[(]|[\])]$|['\"]", ""), ","), lambda s: F.trim(s)), lambda s: s != "")
    number = lambda s: F.when(s.rlike(r"^[+-]?\d+(\.\d*)?$"), s.try_cast("double").cast("int")).otherwise(F.raise_error(F.concat(F.lit("no label number: "), s)).cast("int"))
    zero = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.lit(0.0))
    hot = (F.size(items) == size) & F.forall(items, lambda s: s.rlike(r"^[01](\.0*)?$"))
    marked = lambda ids: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(ids, i).cast("double"))
    one = F.array(F.try_to_number(text, F.lit("S999999999")).cast("int"))
    from_one = marked(F.transform(one, lambda v: F.when(v < 0, v + size).otherwise(v)))
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda s: s.try_cast("int"))
    return (
        F.when(text.isNull(), zero)
        .when(listed & hot, F.transform(items, lambda s: s.cast("double")))
        .when(listed, marked(F.transform(items, number)))
        .when(single, from_one)
        .otherwise(F.coalesce(marked(found), zero))
    )


def multi_hot(ids: Column, size: int = len(LABELS)) -> Column:
    """L2: label ids to a 0/1 vector."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(ids, i).cast("tinyint"))


def primary_label(ids: Column) -> Column:
    """L3: the first label, -1 without labels."""
    return F.coalesce(F.try_element_at(ids, F.lit(1)), F.lit(-1))


def wide_labels(ids: Column, names: list[str] = LABELS) -> dict[str, Column]:
    return {f"label_{n}": F.array_contains(ids, i).cast("tinyint") for i, n in enumerate(names)}


def split_labels(labels: Column) -> Column:
    """Label strings of a written list."""
    return F.filter(F.transform(F.split(F.translate(F.coalesce(labels, F.lit("")), "[]'\"", ""), ","), lambda s: F.trim(s)), lambda s: s != "")


def encode_labels(labels: Column, names: list[str] = LABELS) -> Column:
    """Ids from a list of ids or of names, as its first item decides; unknown names are dropped."""
    items = split_labels(labels)
    table = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    by_name = F.filter(F.transform(items, lambda s: F.try_element_at(table, s)), lambda v: v.isNotNull())
    return F.when(F.try_element_at(items, F.lit(1)).rlike(r"^\d+$"), F.filter(F.transform(items, lambda s: s.try_cast("int")), lambda v: v.isNotNull() & (v < len(names)))).otherwise(by_name)


def label_names(ids: Column, names: list[str] = LABELS) -> Column:
    """L7."""
    return F.transform(ids, lambda i: F.element_at(F.array(*map(F.lit, names)), i + 1))
