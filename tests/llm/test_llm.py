"""The ten operators against brute force, round trips and held-out labels, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from glotmill.llm import bpe, chat, exact_dedup, golay, packing, pii, queries, secrets, simhash, token_counts, topk, toxicity  # noqa: E402
from glotmill.llm.components import connected_components  # noqa: E402

LONG = "1 2 3 " * 20_000
TEXTS = [None, "", " \n", "a", "password=token:abcdef", "AKIA" + "A" * 16, "x" * 70_000, LONG, "same text here now", "same text  here now", "same text here now", "mail a.b@c.de_f@g.hi, +1 (988) 555-2485, 42.144.35.254, 4041894974608795", "<|endoftext|> a  <|endoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeats, and a clashing extra column."""
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "y"), (3, "a", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, label string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_empty_tables(spark, empty):
    d = queries.definition("byte_bpe_50k.json")
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert secrets.secrets_by_path(empty).count() == 0
    assert pii.personal_spans(empty).count() == 0 and pii.sanitise(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0
    assert token_counts.token_counts(empty, d, public_tokenizers.PATTERN).count() == 0
    assert packing.pack_documents(empty, queries.definition("word_bpe_49k.json")).count() == 0
    model = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.with_scores(empty, model).count() == 0
    none = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [])], "vec_id long, embedding array<double>")
    assert topk.exact_top_k(none, lambda v: v % 1 == 0).count() == 0
    assert bpe.round_trip_digests(empty, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).count() == 0


def test_exact(odd):
    r = {(x.doc_id, i): x for i, x in enumerate(exact_dedup.exact_groups(odd).collect())}
    by = {k[0]: v for k, v in r.items()}
    assert len(r) == len(TEXTS) + 2
    assert (by[8].keep_id, by[8].kept, by[9].kept, by[10].group_size) == (9, False, True, 3)
    assert (by[0].keep_id, by[0].group_size, by[2].kept) == (2, 3, True)
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == [2, 3, 4, 5, 6, 7, 9, 11, 12]


def spans_by_re(text):
    out = []
    for m in re.finditer(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(x for *_, x in sorted(out))


def test_exact_repeated_ids(spark):
    df = spark.createDataFrame([(1, "x yz"), (2, "abc"), (2, "xyz")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.drop_exact_copies(df).collect())) == [(1, "x yz"), (2, "abc")]


def test_exact_stage_repeated_rows(spark):
    """A table taken in twice leaves the stage with one row of each group, null ids and null texts included."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "x yz"), (2, "xyz"), (3, "a b"), (3, "ab "), (3, "other"), (None, "n"), (None, "n"), (4, None), (5, "once")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows * 2], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.without_exact_copies(spark, df, "").collect()
    assert sorted((str(r.doc_id), re.sub(r"\s", "", r.text or "")) for r in out) == [("1", "xyz"), ("3", "ab"), ("3", "other"), ("4", ""), ("5", "once"), ("None", "n")]


def test_secrets(spark, odd):
    rng = random.Random(5)
    bits = ["password", "=", "token", ":", " ", "abcdef", "'", "AKIA", "A" * 16, "é", "f" * 12, "API_KEY", "0" * 12, "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = ["assign", "access", "hex"]
    got = {r.path: ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.spans if s.kind in base) for r in secrets.secrets_by_path(df).collect()}
    assert got == {i: spans_by_re(t) for i, t in enumerate(texts)}
    assert secrets.secrets_by_path(odd).count() == len(TEXTS) + 2


def test_ledger(odd):
    ledger = secrets.scan_blobs(odd)
    assert ledger.count() == len(set((t or "") for t in [*TEXTS, "null id"])) * len(secrets.RULES)
    assert secrets.scan_blobs(odd, ledger=ledger).count() == 0
    newer = (secrets.Rule("hex", "[0-9a-f]{24,}", version=2), *secrets.RULES[:2])
    assert {r.rule for r in secrets.scan_blobs(odd, ledger=ledger, rules=newer).select("rule").distinct().collect()} == {"hex"}
    plain = lambda df: sorted((str(r.path), str(r.spans)) for r in df.collect())
    assert plain(secrets.secrets_by_path(odd, ledger=ledger)) == plain(secrets.secrets_by_path(odd))


def test_ledger_versions(spark, odd, tmp_path):
    """A second version of the table scans only what is new in it; findings reach all its rows."""
    folder = str(tmp_path / "ledger")
    first = secrets.update_ledger(odd.where("doc_id < 8"), folder)
    before = first.count()
    both = secrets.update_ledger(odd, folder)
    assert both.count() - before == len({t or "" for t in TEXTS[8:]} | {"null id"}) * len(secrets.RULES) and secrets.update_ledger(odd, folder).count() == both.count()
    plain = lambda df: sorted((str(r.path), str(r.spans)) for r in df.collect())
    assert plain(secrets.findings_by_path(odd, both)) == plain(secrets.secrets_by_path(odd))


def test_web_tokens(spark):
    """Runs with several starts, in the middle of words, and cut short, against the plain pattern."""
    rng = random.Random(8)
    bits = ["eyJ", "eyJabcdefgh", ".", "abcdefgh", "-", "x", " ", "é", "eyJeyJabcde.12345678.z", "..."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(10))) for _ in range(400)]
    got = {r.path: [(s.start, s.stop, s.value) for s in r.spans if s.kind == "jwt"] for r in secrets.secrets_by_path(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: [(*m.span(), m[0]) for m in re.finditer(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", t)] for i, t in enumerate(texts)}


def test_spans_of_long_texts(spark):
    """Many matches in one text take time in proportion to it (squares of these sizes would take hours)."""
    texts = ["token=abcdefg " * 20_000, "eyJabc" * 100_000, "a@b.cd word " * 20_000, "1.2.3.4 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.path: [(s.start, s.stop) for s in r.spans] for r in secrets.secrets_by_path(df).collect()}
    assert found[0] == [(14 * i, 14 * i + 13) for i in range(20_000)] and found[1] == []
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[0] == texts[0] and re.fullmatch(r"(\[EMAIL\] (word|\[TERM\]) ){20000}", clean[2]) and clean[3] == "[IP] " * 20_000


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def pii_by_re(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_pii_spans(spark, odd):
    rng = random.Random(6)
    bits = ["a", "@", ".", "b.c", "1", "23", "255.", "256", " ", "-", "+1", "(9) ", "4041894974608795", "4111 1111-1111 1111", "_", "é", "000"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: [(s.kind, s.start, s.stop) for s in r.base] for r in pii.personal_spans(df).collect()}
    assert got == {i: pii_by_re(t) for i, t in enumerate(texts)}
    clean = {r.doc_id: r.text for r in pii.sanitise(odd).collect()}
    assert clean[11].startswith("mail [EMAIL]") and clean[11].endswith("[PHONE], [IP], [CARD]") and clean[0] is None and clean[7] == LONG


def test_disclosure(spark):
    """A rare term beside one address gives it away; a common term and a term seen twice do not."""
    rows = [(i, f"common words zebra mail x.y@z.org common words {'twice' if i < 2 else ''}") for i in range(5)] + [(i, "common words only") for i in range(5, 60)]
    found = {r.doc: {s.value for s in r.terms} for r in pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == {"zebra", "mail"} and found[59] == set()


def disclosed_by_hand(texts, window=8, z=1.64, threshold=0.7):
    """{doc: [(start, stop), ...]} of the disclosing terms, by the definitions alone."""
    held, near, places = {}, set(), {}
    for d, text in enumerate(texts):
        base = [(a, b, k, text[a:b]) for k, a, b in pii_by_re(text)]
        name = lambda k, v: (k, v.lower() if k == "email" else v if k == "ip" else re.sub(r"\D", "", v))
        terms = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text) if not any(a < m.end() and m.start() < b for a, b, *_ in base)]
        held[d], places[d] = {name(k, v) for *_, k, v in base}, terms
        line = sorted([(a, 0, b, name(k, v)) for a, b, k, v in base] + [(a, 1, b, t) for a, b, t in terms])
        for i, (_, kind, _, e) in enumerate(line):
            near |= {(e, t) for _, k, _, t in line[max(0, i - window) : i + window + 1] if k == 1 and kind == 0}
    words = [{m[0].lower() for m in re.finditer(r"[^\W_]+", t)} for t in texts]
    n, out = len(texts), {d: [] for d in held}
    for e, t in near:
        docs = [d for d in held if e in held[d] and any(t == x for *_, x in places[d])]
        n_e, n_t, n_te = sum(e in h for h in held.values()), sum(t in w for w in words), len(docs)
        p = n_te / n_t
        low = (p + z * z / (2 * n_t) - z * (p * (1 - p) / n_t + z * z / (4 * n_t * n_t)) ** 0.5) / (1 + z * z / n_t)
        if n_e < n and np.log(low * n / n_e) / np.log(n / n_e) >= threshold:
            for d in docs:
                out[d] += [(a, b) for a, b, x in places[d] if x == t]
    return {d: sorted(set(s)) for d, s in out.items()}


def test_disclosure_by_hand(spark):
    """Terms of every length and place, entities of one and of many documents, 10.1.1.1 apart from 101.1.1."""
    rng = random.Random(12)
    entities = {"kim@x.org": "Kim", "KIM@x.org": "李", "1.2.3.4": "x1", "12.3.4.0": "host", "+1 (988) 555-2485": "Li", "4041894974608795": "account77", "a@b.c": "naïve"}
    texts = []
    for d in range(300):
        line = [rng.choice(["the", "of", "word", "and", f"rare{rng.randrange(60)}", f"once{d}"]) for _ in range(rng.randrange(40))]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            e = rng.choice([*entities])
            line.insert(rng.randrange(len(line) + 1), e)
            for _ in range(rng.randrange(4)):
                line.insert(rng.randrange(len(line) + 1), entities[e])
        texts.append(rng.choice([" ", ", ", "-"]).join(line))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: [(s.start, s.stop) for s in r.terms] for r in pii.personal_spans(df).collect()}
    want = disclosed_by_hand(texts)
    assert got == want and sum(map(len, want.values())) > 20


def test_sanitised_columns(spark):
    """Columns of any name stay as they are; overlapping spans are written once."""
    df = spark.createDataFrame([(1, "mail a@b.c, +1.2.3.4.5.6.7.8.9 end", "x", 3)], "doc_id long, text string, __row string, __clean int")
    out = pii.sanitise(df)
    assert out.columns == df.columns and tuple(out.first()) == (1, "mail [EMAIL], [PHONE] end", "x", 3)


def test_golay():
    patterns, excess = golay.error_table(2)
    assert patterns.shape[0] == 2048 and ((excess == 0).sum(axis=1) == 1).all()
    words = np.arange(0, 1 << 23, 977)
    assert (np.bitwise_count((golay.home(words) ^ words).astype(np.uint64)) <= 3).all() and (golay.syndrome(golay.home(words)) == 0).all()


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_near_links(spark, blocks):
    """Every pair within two bits, and no other, whatever the number of anchors."""
    rng = np.random.default_rng(3)
    seeds = rng.integers(-(2**62), 2**62, 60)
    flips = [int(x) ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False)) for x in seeds for n in (1, 2, 3)]
    fps = sorted({*map(int, seeds), *flips})
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), blocks=blocks).collect()}
    assert got == want


def test_near_duplicates(spark, odd):
    r = {x.doc_id: x for x in simhash.near_duplicates(odd).collect() if x.doc_id is not None}
    assert r[0].fp == r[1].fp == r[2].fp == 0 and r[2].component_id == 0 and r[10].component_id == 8
    base = [f"w{i}" for i in range(300)]
    near = " ".join([*base[:150], "changed", *base[151:]])
    df = spark.createDataFrame([(5, " ".join(base)), (6, near), (7, " ".join(base[::-1])), (None, near)], "doc_id long, text string")
    assert sorted(str(x.doc_id) for x in simhash.drop_near_copies(df).collect()) == ["5", "7", "None"]


def test_similar_groups(spark):
    rng, texts = random.Random(5), []
    for family in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(6):
            edits = {rng.randrange(len(base)) for _ in range(rng.randrange(1 + len(base) // 20))}
            texts.append(" ".join(f"e{rng.randrange(5000)}" if i in edits else w for i, w in enumerate(base)))
    sets = [set(simhash.shingles(simhash.words_of(t), 5)) for t in texts]
    links = [(a, b) for f in range(0, len(texts), 6) for a in range(f, f + 6) for b in range(a + 1, f + 6) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    true = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("node", "a", "set", "component")})
    found = {r.doc: r.component for r in simhash.similar_groups(df).collect()}
    # nothing is grouped that no chain of links joins; nearly all links are found
    assert all(true.get(d) == true.get(c) and d in true for d, c in found.items())
    assert sum(a in found and found.get(a) == found.get(b) for a, b in links) >= 0.97 * len(links)


def test_similar_groups_isolated(spark):
    """Pairs at a similarity of 90 / 110 that no third text joins."""
    rng, texts = random.Random(9), []
    for _ in range(300):
        base = [f"w{rng.randrange(100000)}" for _ in range(104)]
        texts += [" ".join(base), " ".join(f"e{w}" if i in (30, 70) else w for i, w in enumerate(base))]
    found = {r.doc: r.component for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(found[d] == d // 2 * 2 for d in found) and len(found) >= 0.985 * len(texts)


def test_large_group(spark, monkeypatch):
    """Groups of many blocks with families that only some pairs join, against all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng, sets = random.Random(3), {}
    for i in range(150):
        family, far = rng.choice([0, 0, 0, 1, 2, 3]), rng.randrange(0, 14)
        sets[i] = sorted({*range(100 * family, 100 * family + 100 - far), *(10_000 + 100 * i + x for x in range(far))})
    rough = spark.createDataFrame([(i, 0 if i < 120 else i // 3) for i in sets], "node long, root long")
    links = simhash.verified_links(rough, spark.createDataFrame([*sets.items()], "node long, set array<long>"), 0.8)
    found = {r.node: r.root for r in connected_components(links).collect()}
    alike = lambda a, b: len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})
    group = lambda i: 0 if i < 120 else i // 3
    true = [(a, b) for a in sets for b in sets if a < b and group(a) == group(b) and alike(a, b)]
    assert found == {r.node: r.root for r in connected_components(spark.createDataFrame(true, "a long, b long")).collect()}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    entries = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={e: i for i, e in enumerate(entries)}, special_tokens={})


def test_bpe(codec, library):
    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t,.'!ab1é²中😀\x1c\x85　"), st.characters(exclude_categories=["Cs"])), max_size=40))
    def same(text):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and codec.decode(ids) == text.encode()

    same()


def test_bpe_documents(spark, odd):
    r = bpe.round_trip_digests(odd, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).collect()
    assert len(r) == len(TEXTS) + 2 and all(x.decoded_sha256 == hashlib.sha256((TEXTS[x.doc_id] or "").encode()).hexdigest() for x in r if x.doc_id is not None)


def test_token_counts(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for most in (3, 150_000):  # rare pre-tokens by a join, and by the table
        r = token_counts.token_counts(odd, queries.definition("byte_bpe_50k.json"), public_tokenizers.PATTERN, ("<|endoftext|>",), most=most).collect()
        assert len(r) == len(TEXTS) + 2
        for x in r:
            if x.doc_id is not None:
                text = TEXTS[x.doc_id] or ""
                assert (x.n_tokens, x.n_bytes) == (len(t.encode(text, add_special_tokens=False).ids), len(text.encode()))


def test_packing_of_many_tasks(spark, sf):
    """The short windows of all tasks are packed once more, so 24 tasks need no more than one window beyond the fewest; every piece stays."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = packing.pack_documents(docs.repartition(24), queries.definition("word_bpe_49k.json")).toPandas()
    used = rows.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and used.size <= -(-rows.length.sum() // 2048) + 1
    at = rows.sort_values(["sequence_id", "offset"])
    assert (at.groupby("sequence_id").length.cumsum() - at.length == at.offset).all()
    pieces = rows.sort_values(["doc_id", "start"])
    assert (pieces.groupby("doc_id").length.cumsum() - pieces.length == pieces.start).all()
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all() and rows.doc_id.nunique() == docs.count()


def test_packing(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack_documents(odd, queries.definition("word_bpe_49k.json")).collect()
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        if i != 3:  # an id that two rows have
            assert sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
            assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_word_tokens():
    """Batches of mixed scripts, capitals, apostrophes and added tokens against the library, words kept in between."""
    from tokenizers import Tokenizer

    definition = queries.definition("word_bpe_49k.json")
    t, mine = Tokenizer.from_str(definition), packing.WordTokens(definition)
    bits = ["İstanbul", "Don't", "don't", "CAN'T", "İ", "ß", "ǅ", "Σας", "x's", "it'll", "1st", "٣", "½", "e\u0301", "\u0301", "中文", "привет", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "a.b,c", ",", ".", "?.", "ªº", "Å", "\u2126", "한국", "ﬁ", "\x1c", "\x00", "\u200b", "o'İ's", "cafe'S"]
    gaps = ["", " ", "\n", "\xa0", "\u2003", "\x85", "\t"]

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(st.tuples(st.one_of(st.sampled_from(bits), st.text(st.characters(exclude_categories=["Cs"]), max_size=4), st.text("abcé'.,1 ", max_size=6)), st.sampled_from(gaps)), max_size=6), max_size=6))
    def same(parts):
        texts = ["".join(a + b for a, b in p) for p in parts]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in mine.encode_batch(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]

    same()


def test_repeated_words_are_looked_up_once(monkeypatch):
    """Lookups follow the distinct words of a step, not all words; steps of one text, a full table and odd texts change no ids."""
    from tokenizers import Tokenizer

    definition = queries.definition("word_bpe_49k.json")
    t, mine, looked = Tokenizer.from_str(definition), packing.WordTokens(definition), []

    class Counted(packing.Memo):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    texts = ["Ab cd, Éa.b\xa0" * 5000, "", "x" * 100 + " ab", "cd ?. ab", "привет ab", "<|endoftext|> cd", "ÿ,\x85µ ª 1st\x1c", ", a"]
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    mine.words = Counted(mine.whole, packing.MEMO)
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode_batch(texts)] == ids and len(looked) < 50
    mine.words = Counted(mine.whole, 3)
    monkeypatch.setattr(packing, "LETTERS", 1)
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode_batch(texts)] == ids


def test_packing_holds_little_at_once():
    """A batch of 10,000 texts is taken in small steps; words that come again stay known when the table is full."""
    import tracemalloc

    mine, told = packing.WordTokens(queries.definition("word_bpe_49k.json")), []
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    texts = [" ".join(words[(7 * i + j) % len(words)] for j in range(300)) for i in range(10_000)]
    tracemalloc.start()
    assert sum(map(len, mine.encode_batch(texts))) > 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20

    mine.words, joined = packing.Memo(mine.whole, 3), mine.joined
    mine.joined = lambda certain, tokenizer: (told.extend(w for w, _ in certain), joined(certain, tokenizer))
    for i in range(0, 20, 2):
        mine.prepare(["often", words[i], words[i + 1]])
    assert told.count("often") == 1 and len(mine.words) + len(mine.former) <= 6


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(0, 40))
def test_fill(counts, space):
    sums = {0}
    for n, k in counts.items():
        sums |= {s + n * j for s in sums for j in range(k + 1)}
    used = packing.fill(counts, sorted(counts), space)
    assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= space) and all(k <= counts[n] for n, k in used.items())


def test_top_k(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(400, 6))
    points[100:250] = points[0]  # ties
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(900, [1.0]), (7, [float(x) for x in points[7]])], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.exact_top_k(df, lambda v: v % 20 == 0, k=5, shard=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    v = np.floor(64 * points).astype(int)
    for q in range(0, 400, 20):
        s = v @ v[q]
        want = sorted((-int(x), i) for i, x in [*enumerate(s), (7, s[7])] if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(want)]


def test_top_k_large(spark):
    """Scores beyond 2^53 and beyond 64 bits, across shards, against Python's integers."""
    rng = random.Random(2)
    big = [[float(rng.choice([1, 2, 3])) for _ in range(3)] for _ in range(60)] + [[float(2**46 + rng.randrange(9)), 1.0, float(-(2**40))] for _ in range(40)] + [[float(2**56 + 2**20 * rng.randrange(9)), 0.5, 1.0] for _ in range(20)]
    rows = [(i, v) for i, v in enumerate(big)] + [(500, [1e30, 1.0, 1.0]), (501, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows[:120]}
    got = {}
    for r in topk.exact_top_k(df, lambda v: v % 20 == 0, k=7, shard=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 120, 20):
        s = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        if -s[0][0] < 2**63:
            assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(s[:7])]
        else:
            assert len(got[q]) == 7 and got[q][0][2] <= 2**63 - 1


def by_sql(sql, **tables):
    import duckdb

    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    out = c.execute(sql)
    names = [d[0] for d in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=str)


def plain(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard", [5, 1000])
def test_top_k_repeats(spark, shard):
    """Repeated rows, ids with several vectors and null ids, as candidates and as queries, equal to the SQL."""
    rng = random.Random(shard)
    rows = [(rng.randrange(50), [float(rng.randrange(4)), float(rng.randrange(3))]) for _ in range(150)]
    rows += [(20, [1.0, 2.0])] * 30 + [(7, [3.0, 2.0])] * 40 + [(None, [3.0, 2.0])] * 3 + [(40, None), (60, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert plain(topk.exact_top_k(df, lambda v: v % 20 == 0, shard=shard)) == by_sql(queries.oracles.TOP_K, embeddings=df)


def test_exact_repeats(spark, odd, monkeypatch):
    """One row of each group is kept, whatever repeats, equal to the SQL."""
    monkeypatch.setattr(exact_dedup, "STEP", 3)
    rows = [(1, "x yz"), (2, "xyz"), (3, "a b"), (3, "ab "), (3, "other"), (None, "n"), (None, "n"), (None, "n "), (4, None), (5, "once"), (None, "ab")] * 5
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), odd):
        got = exact_dedup.exact_groups(df)
        assert plain(got) == by_sql(queries.oracles.EXACT, documents=df)
        assert got.where("kept").count() == got.select("text_sha256").distinct().count() == exact_dedup.drop_exact_copies(df).count()


def test_near_copies_of_repeated_ids(spark):
    """Rows of one id are judged each by its own text: a near copy goes, an unrelated text stays."""
    base = [f"w{i}" for i in range(300)]
    near, other = " ".join([*base[:150], "changed", *base[151:]]), " ".join(base[::-1])
    rows = [(5, " ".join(base)), (7, near), (7, other), (8, near), (8, " ".join(base)), (9, None), (9, ""), (9, "alone"), (None, near)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, check string")
    kept = sorted((str(r.doc_id), r.text or "") for r in simhash.drop_near_copies(df).collect())
    assert kept == sorted([("5", " ".join(base)), ("7", other), ("9", ""), ("9", ""), ("9", "alone"), ("None", near)])
    two = spark.createDataFrame([(3, near), (3, " ".join(base)), (3, other)], "doc_id long, text string")
    assert {r.text == other for r in simhash.drop_near_copies(two).collect()} == {True, False} and simhash.drop_near_copies(two).count() == 2


def test_toxicity(spark, sf):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = [(i, " ".join([word() for _ in range(60)] + (["zzbad" + word()] * 2 if i % 8 == 0 else []))) for i in range(1600)]
    table = spark.createDataFrame([*docs, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in docs if i % 2 == 0] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    out = toxicity.with_scores(table, model).collect()
    tested = [r for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(out) == 1601 and sum((r.score >= 0.7) != (r.doc_id % 8 == 0) for r in tested) <= 0.02 * len(tested)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=1, max_size=6), st.lists(st.floats(-4, 4), min_size=1, max_size=6), st.floats(0.05, 0.5))
def test_risk_slopes(zp, zu, prior):
    """Slopes against differences of the risk, p R+(P) + R-(U) - p R-(P) above zero and its clean part turned round below."""
    s = lambda z: 1 / (1 + np.exp(-np.asarray(z, dtype=float)))
    config = toxicity.NnPU(gamma=0.5)
    clean = lambda zp, zu: s(zu).mean() - prior * s(zp).mean()
    negative = clean(zp, zu) < 0
    risk = (lambda zp, zu: -0.5 * clean(zp, zu)) if negative else (lambda zp, zu: prior * (1 - s(zp)).mean() + clean(zp, zu))
    got = np.concatenate(toxicity.slopes(s(zp), s(zu), prior, config))
    both, h = [*zp, *zu], 1e-5
    for i, slope in enumerate(got):
        up, down = [[x + d * (j == i) for j, x in enumerate(both)] for d in (h, -h)]
        want = (risk(up[: len(zp)], up[len(zp) :]) - risk(down[: len(zp)], down[len(zp) :])) / (2 * h)
        assert abs(want - slope) < 1e-6


def test_toxicity_edges(spark):
    """Null, empty and very long texts and repeats are scored like others; a column with the score's name is replaced."""
    rows = [(1, "bad words"), (1, "bad words"), (2, None), (None, ""), (3, "word " * 60_000)]
    df = spark.createDataFrame([(*r, "x", 5.0) for r in rows], "doc_id long, text string, label string, score double")
    model = toxicity.fit(df, spark.createDataFrame([(1, 1), (1, 1), (2, None), (9, 1)], "doc_id long, toxic int"))
    out = toxicity.with_scores(df, model)
    scores = [r.score for r in out.collect()]
    assert out.columns == df.columns and len(scores) == len(rows) and all(0 <= x <= 1 for x in scores) and scores[2] == scores[3]


def test_chat(spark):
    rows = [
        ("c", 0, "user", "Where is it?\nTell me."), ("c", 1, "assistant", "> Where is it?\nIn the box."), ("c", 2, "user", "Other matter."),
        ("c", 3, "user", "> > where  is it?\n> In the box.\nThanks"), ("c", 4, "user", "> never said\nhm"), ("c", 5, None, None),
    ]
    df = spark.createDataFrame([(1, *r[1:]) for r in rows] + [(None, 0, "user", "lost")], "conv_id long, turn long, role string, text string")
    r = {x.turn: x for x in chat.format_conversations(df).where("conv_id is not null").collect()}
    assert [r[i].reply_to for i in range(6)] == [None, 0, None, 1, None, None]
    assert (r[3].depth, r[3].content, r[3].n_quoted, r[3].n_linked, r[4].n_linked) == (2, "Thanks", 2, 2, 0)
    assert [x.turn for x in sorted(r.values(), key=lambda x: x.path)] == [0, 1, 3, 2, 4, 5]
    assert r[5].formatted == "<|user|>\n\n" and chat.format_conversations(df).count() == 7


def test_chat_threads(spark):
    """Generated threads: nested, re-wrapped, partial and interleaved quotes lead to the message that was answered."""
    rng, rows, parents, bodies = random.Random(11), [], {}, {}
    sentence = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(6, 20))) + "."

    def wrapped(text, width):
        out, line = [], ""
        for word in text.split():
            if len(line) + len(word) > width:
                out, line = [*out, line], ""
            line = f"{line} {word}".strip()
        return [*out, line]

    texts = {}
    for conv in range(12):
        for turn in range(12):
            body = [sentence() for _ in range(rng.randrange(1, 4))]
            bodies[conv, turn] = "\n\n".join("\n".join(wrapped(s, 60)) for s in body)
            parent = rng.randrange(turn) if turn and rng.random() < 0.8 else None
            if parent is None:
                texts[conv, turn] = bodies[conv, turn]
            elif rng.random() < 0.3:  # a stretch of one sentence
                words = bodies[conv, parent].split("\n\n")[0].split()
                cut = " ".join(words[: max(6, len(words) - 2)][-9:])
                texts[conv, turn] = f"> {cut.upper()}\n{bodies[conv, turn]}"
            else:
                lines = [x for line in texts[conv, parent].split("\n") for x in ([line] if line.startswith(">") or not line else wrapped(line, 30))]
                quote = "\n".join("> " + x for x in lines)
                answer = bodies[conv, turn].split("\n\n")
                texts[conv, turn] = "\n".join([answer[0], quote, *answer[1:]])
            parents[conv, turn] = parent
            rows.append((conv, turn, "user", texts[conv, turn]))
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert {k: r.reply_to for k, r in got.items()} == parents
    assert all(">" not in r.content and r.content.split() == bodies[k].split() for k, r in got.items())
    depth = lambda k: 0 if parents[k] is None else 1 + depth((k[0], parents[k]))
    assert all(r.depth == depth(k) for k, r in got.items())
    threads = chat.thread_texts(out).collect()
    assert sum(t.n_messages for t in threads) == len(rows) and len(threads) == sum(p is None for p in parents.values())
    for t in threads:
        seen = [next(k[1] for k, b in bodies.items() if k[0] == t.conv_id and b.split() == part.split()) for part in t.text.split("<|user|>\n")[1:]]
        assert seen[0] == t.thread and all(parents[t.conv_id, m] in seen[:i] for i, m in enumerate(seen) if i)


def test_chat_edges(spark):
    """Null, empty and very long texts, repeats, extra columns; a short line that two messages say links to neither."""
    rows = [(1, 0, "Thanks"), (1, 1, "Thanks"), (1, 2, "> thanks\nyes"), (1, 2, "> thanks\nyes"), (1, None, "> Thanks"), (None, 3, "> Thanks"), (2, 0, None), (2, 1, ""), (2, 2, "a b " * 50_000), (2, 3, "> a b a b a b\n" + ">" * 3000 + " x")]
    df = spark.createDataFrame([(*r, "user", "x", 1) for r in rows], "conv_id long, turn long, text string, role string, conv string, source int")
    out = chat.format_conversations(df)
    r = {(x.conv_id, x.turn): x for x in out.collect()}
    assert out.count() == len(rows) and chat.format_conversations(df.where("false")).count() == 0
    assert (r[1, 2].reply_to, r[1, 2].n_quoted, r[1, 2].n_linked) == (None, 2, 0) and r[2, 3].reply_to == 2 and r[2, 0].content == ""


def replies_by_hand(messages):
    """{(conv, turn): reply_to} of (conv, turn, text), by the module's definitions in plain Python."""
    blank = lambda s: " ".join(re.split(r"[\x20\x09-\x0D]+", s)).strip(" ").lower()
    marks = lambda line: (m[1].count(">") if (m := re.match(r"[ \t]*(>[> \t]*)", line)) else 0)
    bare = lambda line: re.sub(r"^[ \t]*>[> \t]*", "", line)
    paragraphs = lambda lines: [p for p in map(blank, re.split(r"\n[ \t]*(?=\n)", "\n".join(lines))) if p]
    runs = lambda p: {" ".join(p.split(" ")[i : i + 5]) for i in range(max(1, len(p.split(" ")) - 4))}
    short = lambda p: len(p.split(" ")) < 5
    said = {}
    for conv, turn, text in messages:
        own = ["" if marks(x) else x for x in re.split(r"\r?\n", text or "")]
        whole = paragraphs(own)
        parts = [*map(blank, own), *[s for p in whole for s in re.split(r"(?<=[.!?]) ", p)]]
        for piece in {x for p in whole for x in runs(p)} | {p for p in parts if p and short(p)}:
            said.setdefault((conv, piece), set()).add(turn)
    out = {}
    for conv, turn, text in messages:
        lines, votes = re.split(r"\r?\n", text or ""), []
        for level in sorted({marks(x) for x in lines} - {0}):
            for p in paragraphs([bare(x) if marks(x) == level else "" for x in lines]):
                seen = [min(s) for x in runs(p) if (s := said.get((conv, x))) and min(s) < turn and (not short(p) or len(s) == 1)]
                best = max(((seen.count(s), s) for s in set(seen)), default=(0, None))
                if best[0] and 2 * best[0] >= len(runs(p)):
                    votes.append((level, *best))
        outer = [(n, s) for level, n, s in votes if level == min(votes)[0]]
        out[conv, turn] = max(((sum(n for n, x in outer if x == s), s) for _, s in outer), default=(0, None))[1]
    return out


def test_links_of_the_given_conversations(spark, sf):
    """Messages made to quote what they answer, against a linker that looks at every message of a conversation."""
    messages = chat.with_quotes(spark.read.parquet(f"{sf}/conversations.parquet"))
    rows = [(r.conv_id, r.turn, r.text) for r in messages.collect()]
    out = chat.format_conversations(messages)
    found = {(r.conv_id, r.turn): r.reply_to for r in out.collect()}
    assert found == replies_by_hand(rows)
    answers = spark.createDataFrame([(c, t) for c, t, _ in rows], "c long, t long").select("c", "t", chat.answered(F.col("c"), F.col("t")).alias("up")).collect()
    linked = [(found[r.c, r.t], r.up) for r in answers if r.up is not None]
    # texts that several messages share can't tell whom a message answers
    assert len(linked) > 30 and sum(a == b for a, b in linked) >= 0.8 * len(linked)
    threads = chat.thread_texts(out).collect()
    assert sum(t.n_messages for t in threads) == len(rows) and not any(line.startswith(">") for t in threads for line in t.text.split("\n"))


def test_pipeline(spark, sf):
    """Each stage on its own input: what it must drop goes, the rest stays."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            out = out.persist()
            assert out.columns == corpus_pipeline.COLUMNS and 0 < out.count() <= docs.count()
            if name == "exact_dedup":
                assert out.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "")).distinct().count() == out.count()
            docs = out
        else:
            assert out.select("doc_id").distinct().count() == docs.count()


def test_pipeline_odd(spark, odd, tmp_path):
    """Each stage on an empty table and on one with nulls, very long texts and repeats: no crash, columns kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.col("label").alias("source"), F.length("text").cast("long").alias("n_chars"))
    spark.createDataFrame([(3, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table, most in ((docs.where("false"), 0), (docs, len(TEXTS) + 2)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            table = stage(spark, table, str(tmp_path)).persist()
            assert table.count() <= most or i == 4
            assert i == 4 or table.columns == corpus_pipeline.COLUMNS


def test_quick_looks_at_texts_agree_with_the_patterns():
    import random

    from glotmill.llm import pretokens as P

    rng = random.Random(3)
    signs = ["a", "é", "9", "²", ",", ".", "\n", " ", "\t", "\0", "\x85", "　", "×", "漢", "\x1c"]
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 8)))
        assert P._unsafe(text) == bool(P.UNSAFE.search(text)) and P._odd(text) == bool(P.ODD.search(text))
    assert all(P.regex.fullmatch(f"[{P.SPACE}]", c) for c in P.SPACES) and len(P.SPACES) == sum(P.regex.fullmatch(f"[{P.SPACE}]", chr(c)) is not None for c in range(0x3100))
