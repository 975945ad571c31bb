"""Chat formatting by quotation linking.

Messages quote others by leading ``>`` marks, one per level. Consecutive lines of one level are a passage; its marks,
case and white space go, line breaks included, so that it reads the same however a mail program wrapped it. Passages and
what messages say first-hand are compared by hashes of their pieces: every run of ``WINDOW`` words, and for shorter
passages the whole, which must be a line, a sentence or a paragraph of the other message. A join of the hashes within
each conversation finds who said a piece first, before the quoting message; a short piece that several messages say
links to nobody. A passage is linked to the message that most of its pieces come from, if that is half of them at least.

A message replies to the message that most pieces of its outermost linked passages come from (the later one, where two
give as many); without a link it starts a thread of its own. Messages then stand in reply order, each after the one it
replies to, and their texts no longer hold the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.llm.common import cut_lineage
from glotmill.llm.spans import let

#: Single characters only, as Java's engine calls itself once per turn of a longer group.
MARKS = r"^[\x20\t]*+(>[>\x20\t]*+)"
WINDOW, SALTS = 5, 16


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", ""))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def paragraphs(lines: Column) -> Column:
    """Normalised stretches between blank lines."""
    return F.filter(F.transform(F.split(F.array_join(lines, "\n"), r"\n[\x20\t]*(?=\n)"), normal), lambda p: p != "")


def first_hand(text: Column) -> Column:
    """The lines of a text, quoted ones blank."""
    return F.transform(lines_of(text), lambda line: F.when(line.rlike(MARKS), F.lit("")).otherwise(line))


def passages(text: Column) -> Column:
    """Quoted passages as structs of level and normalised text."""
    marked = F.transform(lines_of(text), lambda line: F.struct(quote_level(line).alias("level"), F.regexp_replace(line, MARKS, "").alias("line")))

    def of_levels(rows: Column) -> Column:
        levels = F.filter(F.array_distinct(F.transform(rows, lambda m: m["level"])), lambda n: n > 0)
        of_level = lambda n: paragraphs(F.transform(rows, lambda m: F.when(m["level"] == n, m["line"]).otherwise(F.lit(""))))
        return F.flatten(F.transform(levels, lambda n: F.transform(of_level(n), lambda p: F.struct(n.alias("level"), p.alias("text")))))

    return let(marked, of_levels)


def pieces(text: Column) -> Column:
    """Hashes of all runs of ``WINDOW`` words of a normalised text, or of the whole if it has fewer; with its length."""
    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, WINDOW), " ")))

    return F.array_distinct(let(F.split(text, " "), runs))


def is_short(text: Column) -> Column:
    return F.size(F.split(text, " ")) < WINDOW


def said_pieces(text: Column) -> Column:
    """Pieces that a message says first-hand: of its paragraphs, and its short lines and sentences whole."""
    def both(own: Column, whole: Column) -> Column:
        parts = F.concat(F.transform(own, normal), F.flatten(F.transform(whole, lambda p: F.split(p, r"(?<=[.!?])\x20"))))
        short = F.transform(F.filter(parts, lambda p: (p != "") & is_short(p)), lambda p: F.xxhash64(p))
        return F.array_distinct(F.concat(F.flatten(F.transform(whole, pieces)), short))

    return let(first_hand(text), lambda own: let(paragraphs(own), lambda whole: both(own, whole)))


def without_quotes(text: Column) -> Column:
    """The text without quoted lines and without blank space at either end."""
    kept = F.filter(lines_of(text), lambda line: ~line.rlike(MARKS))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def reply_links(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, n_quoted, n_linked, reply_to) for messages that hold quotes; n_ are numbers of passages."""
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text"))
    found = rows.where(F.col("text").rlike(f"(?m){MARKS}")).select("conv", "turn", F.posexplode(passages(F.col("text"))).alias("p", "q"))
    quoted = cut_lineage(found.select("conv", "turn", "p", "q.level", is_short(F.col("q.text")).alias("short"), pieces(F.col("q.text")).alias("pieces")))
    # only conversations with quotes matter; one that holds most messages meets its own by salt
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    wanted = quoted.select("conv").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sources = rows.select("*", salt("turn")).join(wanted, ["conv", "salt"], "left_semi")
    said = sources.select("conv", "turn", F.explode(said_pieces(F.col("text"))).alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("source"), F.max("turn").alias("latest"))
    asked = quoted.select("conv", "turn", "p", "level", "short", F.size("pieces").alias("n_pieces"), F.explode("pieces").alias("hash"))
    met = asked.join(said, ["conv", "hash"]).where((F.col("source") < F.col("turn")) & (~F.col("short") | (F.col("source") == F.col("latest"))))
    votes = met.groupBy("conv", "turn", "p", "level", "n_pieces", "source").agg(F.count(F.lit(1)).alias("n"))
    linked = votes.groupBy("conv", "turn", "p", "level", "n_pieces").agg(F.max(F.struct("n", "source")).alias("best")).where(2 * F.col("best.n") >= F.col("n_pieces"))
    linked = linked.select("conv", "turn", "level", "best.*")
    # of the outermost level, the source with most pieces
    outer = linked.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_linked"), F.min("level").alias("level"))
    totals = linked.join(outer, ["conv", "turn", "level"]).groupBy("conv", "turn", "n_linked", "source").agg(F.sum("n").alias("n"))
    chosen = totals.groupBy("conv", "turn", "n_linked").agg(F.max(F.struct("n", "source")).alias("best"))
    counts = quoted.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_quoted"))
    return counts.join(chosen, ["conv", "turn"], "left").select("conv", "turn", "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("best.source").alias("reply_to"))


def reply_paths(parents: DataFrame) -> DataFrame:
    """(conv, turn, path, depth) from (conv, turn, parent): turns from the thread's first message to this one.

    Paths double each round (the path to the parent is put before one's own), so rounds grow with the logarithm of the
    longest thread.
    """
    step = lambda t: F.lpad(t.cast("string"), 12, "0")
    paths = parents.select("conv", "turn", F.col("parent").alias("up"), step(F.col("turn")).alias("path"), F.lit(0).alias("depth"))
    while True:
        paths = cut_lineage(paths)
        if paths.where("up is not null").isEmpty():
            return paths.select("conv", "turn", "path", "depth")
        above = paths.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("depth").alias("depth2"))
        paths = paths.join(above, ["conv", "up"], "left").select(
            "conv", "turn", F.col("up2").alias("up"),
            F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat_ws("/", "path2", "path")).alias("path"),
            F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.col("depth") + F.coalesce("depth2", F.lit(0)) + 1).alias("depth"),
        )


def format_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, reply_to, path, depth, n_quoted, n_linked, content, formatted.

    Sorting a conversation by ``path`` gives its reply order. Null texts are empty messages, null roles are ``user``.
    Messages with a null conversation or turn, and repeats of a (conversation, turn), are links' ends for nobody: they
    keep their rows, repeats share the place of their turn, and null ones have no path. An empty table gives an empty
    result.
    """
    whole = messages.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    links = cut_lineage(reply_links(whole, "conv", "turn", "text"))
    parents = links.where("reply_to is not null").select("conv", "turn", F.col("reply_to").alias("parent"))
    # messages that nobody links are threads of one; only the others need paths
    ends = parents.select("conv", F.col("parent").alias("turn")).distinct().join(parents, ["conv", "turn"], "left_anti").withColumn("parent", F.lit(None).cast("long"))
    paths = reply_paths(parents.unionByName(ends))
    content = without_quotes(F.col("text"))
    return (
        whole.join(links, ["conv", "turn"], "left")
        .join(paths, ["conv", "turn"], "left")
        .select(
            F.col("conv").alias("conv_id"), "turn", "reply_to",
            F.coalesce("path", F.when(F.col("conv").isNotNull(), F.lpad(F.col("turn").cast("string"), 12, "0"))).alias("path"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
            F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            content.alias("content"),
            F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), content, F.lit("\n")).alias("formatted"),
        )
    )


def thread_texts(formatted: DataFrame) -> DataFrame:
    """(conv_id, thread, n_messages, text): each thread of ``format_conversations`` as one text in reply order.

    A thread's first turn names it. A thread is one row, so this is for threads that fit one; messages without a path
    are left out, as they are in no thread.
    """
    rows = formatted.where("path is not null").withColumn("thread", F.split("path", "/")[0].cast("long"))
    told = rows.groupBy("conv_id", "thread").agg(F.count(F.lit(1)).alias("n_messages"), F.array_sort(F.collect_list(F.struct("path", "formatted"))).alias("all"))
    return told.select("conv_id", "thread", "n_messages", F.array_join(F.transform("all", lambda m: m["formatted"]), "").alias("text"))


def answered(conv: Column, turn: Column) -> Column:
    """The turn that a message answers, by a hash of its place: none, the one before it, or the one before that."""
    h = F.pmod(F.xxhash64(conv, turn), F.lit(4))
    return F.when((h > 0) & (turn > 0), turn - F.when((h == 3) & (turn > 1), 2).otherwise(1))


def with_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with their texts as mail programs would send them, below the whole text of what they answer.

    For tables whose messages hold no quotes: ``answered`` says which message each one answers, and one level deeper
    stands the message that that one answers. Rows, columns and null texts of messages that answer nobody stay; of a
    repeated place the smallest text is quoted, and a place without a message is not.
    """
    said = messages.groupBy(F.col(conv).alias("__c"), F.col(turn).alias("__t")).agg(F.min(text).alias("__said"))
    of = lambda n: said.select(F.col("__c").alias(f"__c{n}"), F.col("__t").alias(f"__t{n}"), F.col("__said").alias(f"__said{n}"))
    first = answered(F.col(conv), F.col(turn))
    rows = messages.withColumns({"__up1": first, "__up2": answered(F.col(conv), first)})
    for n in (1, 2):
        rows = rows.join(of(n), (F.col(conv) == F.col(f"__c{n}")) & (F.col(f"__up{n}") == F.col(f"__t{n}")), "left")
    quote = lambda body, marks: F.array_join(F.transform(lines_of(body), lambda line: F.concat(F.lit(marks), line)), "\n")
    deep, near = F.when(F.col("__said2").isNotNull(), quote(F.col("__said2"), ">> ")), F.when(F.col("__said1").isNotNull(), quote(F.col("__said1"), "> "))
    whole = F.when(F.col("__said1").isNull(), F.col(text)).otherwise(F.concat_ws("\n", deep, near, F.lit(""), F.coalesce(F.col(text), F.lit(""))))
    return rows.withColumn("__whole", whole).select(*[F.col("__whole").alias(c) if c == text else F.col(c) for c in messages.columns])
