"""SimHash near-duplicate detection by anchor-point covering.

Fingerprints are compared at anchors, the code words of a covering code. Every fingerprint has a home anchor within the
covering radius and is replicated to every anchor within radius plus threshold; two fingerprints within the threshold
then meet at the home of either one, so that comparing homes with replicas, anchor by anchor, misses nothing.

The code is the perfect Golay code on each of two blocks of 23 bits: 2^24 anchors and about 61 replicas of a fingerprint
at threshold 2. Work per anchor stays small as long as there are not many more distinct fingerprints than anchors, so
beyond 2^24 of them the other 18 bits are a third block. Its words come home to 3,328 anchors unevenly, so random
fingerprints meet 476 times fewer others at an anchor, for about twice the replicas (119). The links are the same.
Equal fingerprints are one node, whatever the number of their documents, and a node has at most
C(64,1) + C(64,2) = 2,080 others within two bits, so links grow with the input, not with the square of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotmill.llm import golay
from glotmill.llm.common import cut_lineage, cut_lineage_counted
from glotmill.llm.components import connected_components

SEED = 42
BATCH = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """Words between the white space [\\x20\\x09-\\x0D], A-Z lower-cased; bytes methods know exactly these."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(size)])))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bytes of the fingerprint: a bit is 1 if it is set in over half of the rows of ``hashes`` (bytes, big-endian)."""
    total = np.zeros(hashes.shape[1] * 8, dtype=np.int64)
    for i in range(0, len(hashes), BATCH):
        total += np.unpackbits(hashes[i : i + BATCH], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes))


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 bits over all shingles, repeats included; 0 for a text without words."""
    parts = shingles(words_of(text), size)
    if not parts:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), dtype=np.uint64, count=len(parts)).astype(">u8")
    return int.from_bytes(majority(h.view(np.uint8).reshape(-1, 8)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp) with the fingerprint as a signed long; whole texts, null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc long, fp long")


def _blocks(fps: np.ndarray, n: int) -> list[np.ndarray]:
    """The lowest n blocks of 23 bits; of the third there are 18, and zeros."""
    bits = fps.view(np.uint64)
    return [(bits >> np.uint64(i * golay.LENGTH) & np.uint64(golay.MASK)).astype(np.int64) for i in range(n)]


def near_links(nodes: DataFrame, threshold: int = 2, blocks: int = 2) -> DataFrame:
    """(a, b): pairs of different fingerprints (column fp, no repeats) at ``threshold`` or fewer differing bits.

    ``blocks`` (1 to 3) sets the number of anchors, 4,096 to that power at most; links do not depend on it.
    """

    def replicate(reach: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                every = b.column(0).to_numpy(zero_copy_only=False)
                for i in range(0, len(every), 4096):
                    fps = every[i : i + 4096]
                    rows, at = golay.anchors(_blocks(fps, blocks), reach)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(fps[rows])], names=["anchor", "fp"])

        return run

    homes = nodes.select("fp").mapInArrow(replicate(0), "anchor long, fp long").select("anchor", F.col("fp").alias("a"))
    copies = nodes.select("fp").mapInArrow(replicate(threshold), "anchor long, fp long").select("anchor", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return homes.join(copies, (homes["anchor"] == copies["anchor"]) & close).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest id reachable over links, itself included).

    Texts with fewer than ``size`` words are one shingle; texts without words (null and empty ones too) have
    fingerprint 0 and are linked to each other like any other. Repeated rows fall together. A null id keeps its row and
    counts for no component's smallest id. An empty table gives an empty result; other columns are not read.
    """
    rows = cut_lineage(fingerprints(docs, size, id_col, text_col))
    nodes, n = cut_lineage_counted(rows.groupBy("fp").agg(F.min("doc").alias("first")), PER_TASK)
    roots = connected_components(near_links(nodes, threshold, blocks=2 if n <= 1 << 24 else 3))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = labelled.join(smallest, "root").select(F.col("fp").alias("c_fp"), "component_id")
    return rows.join(classes, F.col("fp") == F.col("c_fp")).select(F.col("doc").alias("doc_id"), "fp", "component_id")


# Near copies at a given similarity. Word shingles as sets, 256 bits: the expected share of differing bits is the angle
# between the two sets over pi, so a similarity stands for a number of bits. Fingerprints propose, sets decide.

WIDE = 256
LANES = ["f0", "f1", "f2", "f3"]
BLOCK, HUBS = 256, 4
PER_TASK = 5000  # fingerprints whose anchors a task lists, at least


def bits_at(similarity: float, deviations: float = 1.5) -> int:
    """Differing bits of 256 up to which a pair counts: what is expected at this Jaccard similarity, and a margin."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.floor(WIDE * p + deviations * math.sqrt(WIDE * p * (1 - p)))


def wide_fingerprint(text: str | None, size: int = 5) -> tuple[bytes, int]:
    """The fingerprint, and a hash of the set of shingles itself (0 for a text without words)."""
    parts = set(shingles(words_of(text), size))
    if not parts:
        return bytes(WIDE // 8), 0
    joined = b"".join(xxhash.xxh3_128_digest(p, SEED) + xxhash.xxh3_128_digest(p, SEED + 1) for p in parts)
    own = np.frombuffer(joined, dtype=np.int64).reshape(len(parts), 4)[:, 0].sum()
    return majority(np.frombuffer(joined, dtype=np.uint8).reshape(len(parts), WIDE // 8)).tobytes(), int(own)


def text_check(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def wide_fingerprints(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, check, node, f0, f1, f2, f3); texts with the same node have the same set of shingles, ``check`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [wide_fingerprint(t, size) for t in b.column(2).to_pylist()]
            fps = np.frombuffer(b"".join(fp for fp, _ in found), dtype=np.int64).reshape(-1, 4)
            own = pa.array([own for _, own in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), own, *[pa.array(fps[:, i].copy()) for i in range(4)]], names=["doc", "check", "node", *LANES])

    schema = "doc long, check long, node long, " + ", ".join(f"{x} long" for x in LANES)
    return docs.select(F.col(id_col).cast("long").alias("doc"), text_check(F.col(text_col)).alias("check"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _band_anchors(b: pa.RecordBatch, bands: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of ``bands`` separate blocks of 23 bits (row, anchor), the band in the anchor."""
    weights = 1 << np.arange(golay.LENGTH, dtype=np.int64)
    bits = np.unpackbits(np.ascontiguousarray(_lanes(b)).view(np.uint8), axis=1)
    for band in range(bands):
        rows, at = golay.anchors([bits[:, band * golay.LENGTH : (band + 1) * golay.LENGTH] @ weights], reach)
        yield rows, at | band << golay.LENGTH


def _lanes(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in LANES], axis=1)


def _banded(nodes: DataFrame, name: str, bands: int, reach: int) -> DataFrame:
    """(anchor, node column ``name``, lanes): one row for every anchor of every band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                for rows, anchors in _band_anchors(part, bands, reach):
                    taken = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(anchors), *[part.column(c).take(taken) for c in (name, *LANES)]], names=["anchor", name, *LANES])

    schema = f"anchor long, {name} long, " + ", ".join(f"{x} long" for x in LANES)
    return nodes.select(name, *LANES).mapInArrow(run, schema)


def _star_links(nodes: DataFrame, few: pa.Table, limit: int, bands: int, reach: int) -> DataFrame:
    """(a, b): each node with one of the chosen centres ``few`` that it is close to, and that one with the others.

    So the links of a large group are about as many as its nodes, however many centres they meet.
    """
    order = np.argsort(few.column("anchor").to_numpy(), kind="stable")
    at, ids = few.column("anchor").to_numpy()[order], few.column("node").to_numpy()[order]
    sent = nodes.sparkSession.sparkContext.broadcast((at, ids, _lanes(few)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, centres, lanes = sent.value
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                own, mine, met = part.column("node").to_numpy(zero_copy_only=False), _lanes(part), []
                for rows, wanted in _band_anchors(part, bands, reach):
                    low, high = np.searchsorted(anchors, wanted), np.searchsorted(anchors, wanted, side="right")
                    n = high - low
                    row, centre = np.repeat(rows, n), np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    close = np.bitwise_count((mine[row] ^ lanes[centre]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= limit
                    close &= own[row] != centres[centre]
                    met.append(np.stack([row[close], centres[centre[close]]], axis=1))
                # by row, then centre; a row's first centre is its star
                pairs = np.unique(np.concatenate(met), axis=0)
                new = np.append(True, pairs[1:, 0] != pairs[:-1, 0])[: len(pairs)]
                star = pairs[np.flatnonzero(new)[np.cumsum(new) - 1], 1] if len(pairs) else pairs[:, 1]
                links = np.unique(np.concatenate([np.stack([star[new], own[pairs[new, 0]]], axis=1), np.stack([star[~new], pairs[~new, 1]], axis=1)]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return nodes.select("node", *LANES).mapInArrow(run, "a long, b long")


def _rough_groups(nodes: DataFrame, limit: int, bands: int, reach: int, centres: int) -> DataFrame:
    """(node, root): groups joined by chains of fingerprints that meet at an anchor and differ in ``limit`` bits or fewer."""
    close = sum((F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) for x in LANES), F.lit(0)) <= limit
    spot = F.struct(F.xxhash64("node").alias("order"), "node", *LANES)
    slot = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(centres)).alias("slot")
    # at most 4,096 x bands x centres rows, whatever the input
    few = _banded(nodes, "node", bands, 0).groupBy("anchor", slot).agg(F.min(spot).alias("c")).select("anchor", "c.node", *[f"c.{x}" for x in LANES]).toArrow()
    roots, _ = cut_lineage_counted(connected_components(_star_links(nodes, few, limit, bands, reach)))
    marked, _ = cut_lineage_counted(nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), *LANES), PER_TASK)
    left, right = _banded(marked, "root", bands, 0).alias("a"), _banded(marked, "root", bands, reach).alias("b")
    more = left.join(right, (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.root") != F.col("b.root")) & close)
    merged = connected_components(more.select(F.col("a.root").alias("a"), F.col("b.root").alias("b")).distinct()).select(F.col("node").alias("root"), F.col("root").alias("top"))
    final = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return final.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, set) of (text): hashes of the distinct shingles, by the same node as ``wide_fingerprints``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                sets = []
                for t in b.column(0).slice(i, 256).to_pylist():
                    parts = set(shingles(words_of(t), size))
                    sets.append(np.frombuffer(b"".join(xxhash.xxh3_128_digest(p, SEED)[:8] for p in parts), dtype=np.int64))
                own = pa.array([int(s.sum()) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([own, pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return texts.select("text").mapInArrow(run, "node long, set array<long>").groupBy("node").agg(F.max("set").alias("set"))


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Matrix of the pairs that have at least this Jaccard similarity, by counts of their common elements."""
    m, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.float64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # what only one set holds is in no intersection
    column = (np.cumsum(n > 1) - 1)[at]
    taken = np.flatnonzero(n[at] > 1)
    taken = taken[np.argsort(column[taken], kind="stable")]
    owner, column = owner[taken], column[taken]
    shared = np.zeros((m, m))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        dense = np.zeros((m, 4096), dtype=np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        shared += dense @ dense.T
    # shared / (all of both - shared) >= similarity, with room for rounding
    return shared * (1 + similarity) + 1e-9 >= (sizes[:, None] + sizes[None, :]) * similarity


def _compared(units: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): in each unit (root, kind, i, j) of rows (node, block), links that join what its similar pairs join.

    A unit with two blocks compares members of different blocks, one with a single block all its members. It sends one
    link a member at most, however many of its pairs are similar.
    """

    def run(table: pa.Table) -> pa.Table:
        node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        found = similar_sets([np.asarray(x.values) for x in table.column("set").combine_chunks()], similarity)
        if block.min() != block.max():
            found &= block[:, None] != block[None, :]
        np.fill_diagonal(found, True)
        label = np.arange(len(node))
        while True:
            lower = np.where(found, label[None, :], len(node)).min(axis=1)
            if (lower == label).all():
                break
            label = lower
        linked = label != np.arange(len(node))
        return pa.table({"a": node[label[linked]], "b": node[linked]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return units.join(sets, "node").groupBy("root", "kind", "i", "j").applyInArrow(run, "a long, b long")


def _numbers(n: Column) -> Column:
    return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)")))


def verified_links(rough: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join what chains of pairs of this similarity join, all pairs of a rough group being compared.

    A group's members are dealt over blocks of about ``BLOCK``. First each block is compared by itself and with ``HUBS``
    members of the group, which leaves a group of near copies in few components. Then, in groups of several blocks, only
    pairs of different components can still matter: members outside the largest component meet all blocks. So a task
    holds two blocks, and a group of n members with m outside sends about n + 2 n m / ``BLOCK`` sets.
    """
    sizes = rough.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed, _ = cut_lineage_counted(rough.join(sizes, "root").select("node", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")))
    unit = lambda kind, i, j: (F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    own = placed.select("node", "root", F.lit(0).alias("block"), *unit("own", F.col("block"), F.col("block")))
    large = placed.where("blocks > 1")
    few = large.groupBy("root", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(HUBS)).alias("slot")).agg(F.min(F.struct(F.xxhash64("node", F.lit(2)), "node")).alias("c"), F.first("blocks").alias("blocks"))
    spread = few.select(F.col("c.node").alias("node"), "root", "blocks", _numbers(F.col("blocks")).alias("at")).where(F.col("at") != F.pmod(F.xxhash64("node"), F.col("blocks")))
    hubs = spread.select("node", "root", F.lit(0).alias("block"), *unit("own", F.col("at"), F.col("at")))
    links, _ = cut_lineage_counted(_compared(own.unionByName(hubs), sets, similarity))
    if not large.agg(F.count(F.lit(1))).first()[0]:
        return links
    inside, _ = cut_lineage_counted(large.join(connected_components(links).withColumnRenamed("root", "top"), "node", "left").select("node", "root", F.coalesce("top", "node").alias("part")))
    parts = inside.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("n_main"), (F.sum("n") - F.max("n")).alias("n_rest")).where("n_rest > 0")
    sized = main.select("root", "main", F.ceil(F.col("n_main") / BLOCK).cast("int").alias("mains"), F.ceil(F.col("n_rest") / BLOCK).cast("int").alias("rests"))
    member, n = cut_lineage_counted(inside.join(sized, "root"))
    if not n:
        return links
    rest, most = (member.where(c) for c in ("part <> main", "part = main"))
    number = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    across = [
        rest.select("node", "root", F.lit(1).alias("block"), number(F.col("rests")).alias("x"), _numbers(F.col("mains")).alias("y")),
        most.select("node", "root", F.lit(2).alias("block"), number(F.col("mains")).alias("y"), _numbers(F.col("rests")).alias("x")),
    ]
    among = rest.select("node", "root", number(F.col("rests")).alias("block"), _numbers(F.col("rests")).alias("y"))
    units = [u.select("node", "root", "block", *unit("across", F.col("x"), F.col("y"))) for u in across]
    units.append(among.select("node", "root", "block", *unit("among", F.least("block", "y"), F.greatest("block", "y"))))
    return links.unionByName(_compared(units[0].unionByName(units[1]).unionByName(units[2]), sets, similarity))


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, bands: int = 11, reach: int = 1, centres: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, check, component, kept): documents in groups of two or more near copies, and the smallest id of the group.

    Two texts are near copies if their sets of shingles have the similarity. Fingerprints propose: those that differ
    in at most ``bits_at(similarity, 3.0)`` of 256 bits and meet at an anchor of some band (radius 3 plus ``reach``) fall
    into a rough group, and within rough groups all pairs are compared by their sets. Rough groups of any size give few
    rows: first every fingerprint is held against ``centres`` members of each anchor (at most 4,096 x bands x centres
    rows, a fixed number, broadcast), which already joins large groups; then homes meet replicas, and only pairs from
    different groups leave the join. Work at an anchor grows with the square of its fingerprints; more input wants
    longer anchors, at some cost of recall. What comparing a rough group costs, ``verified_links`` says.

    A document is an id and a text (``check`` hashes the text), so other texts of a repeated id have groups of their own.
    ``kept`` is true for the document with the smallest id, then the smallest ``check``, of each group; rows that repeat
    both id and text are one document. Null ids are in no group. Texts without words (null and empty ones too) are one
    group, as are texts with equal sets of shingles. An empty table gives no rows; other columns are not read.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).withColumn("check", text_check(F.col("text")))
    rows = cut_lineage(wide_fingerprints(texts, size, "doc"))
    # equal sets have equal fingerprints
    nodes, _ = cut_lineage_counted(rows.groupBy("node").agg(F.min(F.struct("doc", "check")).alias("first"), F.count(F.lit(1)).alias("docs"), *[F.max(x).alias(x) for x in LANES]), PER_TASK)
    rough, _ = cut_lineage_counted(_rough_groups(nodes, bits_at(similarity, 3.0), bands, reach, centres))
    many = rough.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    asked = rough.join(many, "root", "left_semi").join(nodes, "node").select("first.doc", "first.check").distinct()
    sets = cut_lineage(shingle_sets(texts.join(asked, ["doc", "check"], "left_semi"), size))
    roots = connected_components(verified_links(rough, sets, similarity))
    named, _ = cut_lineage_counted(nodes.join(roots, "node", "left").select("node", "first", "docs", F.coalesce("root", "node").alias("root")))
    groups = named.groupBy("root").agg(F.min("first").alias("component"), F.sum("docs").alias("n")).where("n > 1").select("root", "component")
    grouped = rows.select("doc", "check", "node").join(named.join(groups, "root").select("node", "component"), "node")
    return grouped.select("doc", "check", F.col("component.doc").alias("component"), (F.struct("doc", "check") == F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns: of each group one document stays.

    That is the one with the smallest id, then (of a repeated id with several near-equal texts) the smallest hash of the
    text. Rows that repeat an id with an unrelated text are judged by their own text. Rows with a null id stay; rows that
    repeat id and text share their fate. See ``similar_groups`` for null, empty and very long texts.
    """
    gone = similar_groups(docs, size, similarity, id_col=id_col, text_col=text_col).where("not kept").select(F.col("doc").alias("__gone"), F.col("check").alias("__check")).distinct()
    return docs.join(gone, (docs[id_col] == F.col("__gone")) & (text_check(docs[text_col]) == F.col("__check")), "left_anti")
