"""SQL (DuckDB's dialect) for the operators that it can express."""

from __future__ import annotations

BLANKS = r"[\x20\x09-\x0D]+"

EXACT = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '{BLANKS}', '', 'g') AS c FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY c ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY c) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY c ORDER BY chars DESC, doc_id) = 1 AS kept, sha256(c) AS text_sha256 FROM w
"""


def _spans(rules: list[tuple[str, str, str]]) -> str:
    """Spans of (kind, pattern, condition on m and part): running lengths of gaps and matches give positions."""
    parts = []
    for i, (kind, pattern, keep) in enumerate(rules):
        p = pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, '{kind}' AS kind, {i} AS ord, m, part, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, {keep} AS ok FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(parts) AS part, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {2 if kind == 'assign' else 0}) AS parts, string_split_regex(text, '{p}') AS gaps FROM d))"""
        )
    return "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT *, stop - length(m) AS start FROM (" + " UNION ALL ".join(parts) + ") WHERE ok)"


_SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(part) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "true"),
]

SECRETS = f"""
WITH {_spans(_SECRETS)}, a AS (
  SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY rank <= 20
"""

COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) t(k) WHERE len(w) >= k),
f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 10),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
u AS (SELECT *, unnest(range(1, words)) AS k FROM c),
s AS (SELECT u.lang, u.phrase, u.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM u
  JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:k], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[k + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE words = 3) GROUP BY 1, 2)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, m.phrase) AS rank, m.phrase, m.a, m.l, m.r, n, score
FROM m JOIN t USING (lang) LEFT JOIN i ON i.lang = m.lang AND i.part = m.phrase WHERE longer IS NULL OR 100 * longer < 50 * m.a QUALIFY rank <= 2000
"""


def _mixture(rounds: int = 3, bins: int = 4096) -> str:
    """Rounds of taking documents in order while they fit, each over the bins that the one before left open."""
    parts = [
        r"""d AS (SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents)""",
        "w AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source)",
        "c AS (SELECT *, 1.5 * sum(source_size) OVER ()::DOUBLE AS total, 2.0 * (sum(source_size) OVER o - source_size)::DOUBLE AS filled, sum(weight) OVER () - (sum(weight) OVER o - weight) AS open FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING))",
        "f AS (SELECT *, weight * ((total - filled) / open) > 2 * source_size AS is_full FROM c)",
        "e AS (SELECT (1.5 * coalesce(sum(source_size), 0)::DOUBLE - 2.0 * coalesce(sum(source_size) FILTER (is_full), 0)::DOUBLE) / sum(weight) FILTER (NOT is_full) AS each FROM f)",
        "t AS (SELECT source, source_size, CASE WHEN is_full THEN 2 * source_size::DOUBLE ELSE weight * each END AS target FROM f, e)",
        "s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole, target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END) * source_size AS rest FROM t)",
        "p AS (SELECT d.*, source_size, target, whole, least(greatest(CASE WHEN source_size > 0 THEN rest / source_size ELSE 0 END, 1e-12), 1 - 1e-12) AS p FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)",
        "k AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS rank FROM p)",
        f"r AS (SELECT *, least(floor(rank / (1 + rank) * {bins}), {bins - 1})::INT AS bin FROM k)",
        "st0 AS (SELECT source, 0 AS open, rest AS gap, (1::BIGINT << 62)::DOUBLE AS most FROM s)",
    ]
    for i in range(rounds):
        parts += [
            f"o{i} AS (SELECT r.* FROM r JOIN st{i} st ON r.source IS NOT DISTINCT FROM st.source WHERE r.bin >= st.open AND r.size <= st.most)",
            f"b{i} AS (SELECT source, bin, (sum(sum(size)) OVER (PARTITION BY source ORDER BY bin))::BIGINT AS upto FROM o{i} GROUP BY source, bin)",
            f"n{i} AS (SELECT st.source, st.gap, coalesce(min(b.bin) FILTER (b.upto > st.gap), {bins}) AS stop, coalesce(max(b.upto) FILTER (b.upto <= st.gap), 0) AS before FROM st{i} st LEFT JOIN b{i} b ON b.source IS NOT DISTINCT FROM st.source GROUP BY st.source, st.gap)",
            f"e{i} AS (SELECT o.row, o.source, n.gap, n.before + (sum(o.size) OVER (PARTITION BY o.source ORDER BY o.rank, o.doc_id NULLS FIRST, o.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM o{i} o JOIN n{i} n ON o.source IS NOT DISTINCT FROM n.source AND o.bin = n.stop)",
            f"m{i} AS (SELECT source, max(upto) AS most FROM e{i} WHERE upto <= gap GROUP BY source)",
            f"st{i + 1} AS (SELECT n.source, n.stop + 1 AS open, n.gap - coalesce(m.most, n.before) AS gap, floor(n.gap - coalesce(m.most, n.before)) AS most FROM n{i} n LEFT JOIN m{i} m ON n.source IS NOT DISTINCT FROM m.source)",
            f"g{i} AS (SELECT row FROM o{i} o JOIN n{i} n ON o.source IS NOT DISTINCT FROM n.source AND o.bin < n.stop UNION ALL SELECT row FROM e{i} WHERE upto <= gap)",
        ]
    drawn = " UNION ALL ".join(f"SELECT row FROM g{i}" for i in range(rounds))
    parts.append(f"x AS ({drawn})")
    copies = "(whole + (row IN (SELECT row FROM x))::INT)"
    return f"WITH {', '.join(parts)} SELECT doc_id, size, source_size, target, (size * {copies})::BIGINT AS taken, source, {copies}::INT AS copies FROM r"


MIXTURE = _mixture()
