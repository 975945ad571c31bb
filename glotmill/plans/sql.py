"""Building blocks of the SQL (DuckDB's dialect) that says what the queries compute."""

from __future__ import annotations

from glotmill.lexicon import LETTERS, NUCLEI, V1_ENGLISH, V1_EXCLUDE, V1_PINYIN, V1_SUFFIX, VIET_CHARS, DetectorConfig

CONFIG = DetectorConfig()


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words))


DOCS = """docs AS (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM documents)"""

V1 = rf"""{DOCS}, v1w AS (
  SELECT doc_id, split, text, regexp_extract_all(text, '[{LETTERS}]+(?:[\-''][{LETTERS}]+)?') AS words, strip_accents(lower(text)) AS folded FROM docs
), v1l AS (
  SELECT *, list_filter(words, lambda t: regexp_full_match(t, '[A-Za-z]+') AND length(t) > 2 AND (lower(t) IN ({quoted(V1_ENGLISH)})
      OR (lower(t) NOT IN ({quoted(V1_EXCLUDE)}) AND regexp_matches(lower(t), '{V1_SUFFIX}')))) AS en,
    list_concat(regexp_extract_all(text, '[㐀-䶿一-鿿豈-﫿]+'), list_filter([{', '.join(rf"CASE WHEN regexp_matches(folded, '(^|[^\p{{L}}\p{{N}}_]){r'\s*'.join(p.split())}($|[^\p{{L}}\p{{N}}_])') THEN '{p}' END" for p in V1_PINYIN)}], lambda x: x IS NOT NULL)) AS zh,
    list_concat(regexp_extract_all(text, '[가-힣]+'), regexp_extract_all(text, '[぀-ヿ]+')) AS other
  FROM v1w
), v1 AS (
  SELECT doc_id, split, len(words) AS num_tokens, regexp_matches(text, '(?i)[{VIET_CHARS}]') AS has_vietnamese_diacritic, len(en) > 0 AS has_english, len(en) AS english_count,
    len(en) / greatest(len(words), 1) AS english_ratio, array_to_string(en[1:20], ', ') AS english_tokens, len(zh) > 0 AS has_chinese, array_to_string(zh[1:20], ', ') AS chinese_tokens, len(other) > 0 AS has_other_foreign,
    (len(en) + len(zh) + len(other)) > 0 AS is_code_switched,
    CASE WHEN (len(en) > 0)::INT + (len(zh) > 0)::INT + (len(other) > 0)::INT = 0 THEN 'pure_vi' WHEN (len(en) > 0)::INT + (len(zh) > 0)::INT + (len(other) > 0)::INT > 1 THEN 'multi_mixed'
      WHEN len(en) > 0 THEN 'english_mixed' WHEN len(zh) > 0 THEN 'chinese_mixed' ELSE 'other_foreign' END AS cs_group
  FROM v1l
)"""


def _runs(pattern: str, to: int) -> str:
    """Runs of each letter a to z, one letter after another: the dialect has no backreferences."""
    out = "low"
    for c in "abcdefghijklmnopqrstuvwxyz":
        out = f"regexp_replace({out}, '{c}{pattern}', '{c * to}', 'g')"
    return out


SYLLABLE = "^(ngh|ng|nh|ch|gh|gi|kh|ph|th|tr|qu|[bcdghklmnprstvx])?([aeiouy]{1,3})(ng|nh|ch|c|m|n|p|t)?$"


def is_syllable(word: str) -> str:
    return f"(regexp_matches({word}, '{SYLLABLE}') AND regexp_extract({word}, '{SYLLABLE}', 2) IN ({quoted(NUCLEI)}))"


LAUGH = "^(?:(?:h[aeiouyăâêôơư]{1,2}){2,}|(?:hj){2,}|(?:jz){2,}|(?:ck){2,}|k{2,}|z{3,}|w+k+w*|lol|lmao|lmfao|rofl|jaja|khkh|khjkhj)$"


def _any(test: str) -> str:
    each = [test.replace("@", w) for w in ("low", "twice", "once")]
    return f"({each[0]} OR (twice <> low AND ({each[1]} OR {each[2]})))"


TEEN = quoted(CONFIG.teencode_lexicon)
CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]{1,15}>', ' ', 'g'), '(?i)https?://\S+|www\.\S+', ' ', 'g'),
  '(^|[^\p{L}\p{N}_])@[\p{L}\p{N}_.]+', '\1 ', 'g'), '(^|[^\p{L}\p{N}_])#[\p{L}\p{N}_]+', '\1 ', 'g')"""

TOKENS = rf"""{DOCS}, tok AS (
  SELECT *, list_filter(tokens, lambda t: regexp_matches(t, '[{LETTERS}]')) AS words FROM (
    SELECT doc_id, split, text, regexp_extract_all({CLEAN}, '[{LETTERS}]+(?:[''\-][{LETTERS}]+)*|\p{{Nd}}+|[^\p{{L}}\p{{N}}_\s]') AS tokens FROM docs)
)"""

CLASSES = rf"""{TOKENS}, wd AS (SELECT doc_id, unnest(words) AS t, unnest(range(1, len(words) + 1)) AS pos FROM tok),
dist AS (SELECT t, count(*) AS n FROM wd GROUP BY t),
low AS (SELECT t, n, lower(t) AS low, strip_accents(lower(t)) AS folded FROM dist),
cand AS (SELECT *, {_runs('{3,}', 2)} AS twice, {_runs('+', 1)} AS once FROM low),
cls AS (SELECT t, n, CASE
  WHEN regexp_matches(t, '(?i)[{VIET_CHARS}]') THEN CASE WHEN low IN ({TEEN}) OR folded IN ({TEEN}) THEN 'teencode' ELSE 'vi' END
  WHEN NOT regexp_full_match(low, '[a-z]+') THEN 'other'
  WHEN regexp_matches(low, '{LAUGH}') THEN 'laugh'
  WHEN {_any(f"@ IN ({TEEN})")} THEN 'teencode'
  WHEN low IN ({quoted(CONFIG.blacklist)}) THEN 'vi'
  WHEN {_any(f"@ IN ({quoted(CONFIG.loans)})")} THEN 'en'
  WHEN {_any(f"@ IN ({quoted(CONFIG.english_lexicon)})")} THEN CASE WHEN {_any(is_syllable("@"))} THEN 'en_ambiguous' ELSE 'en' END
  WHEN {_any(is_syllable("@"))} THEN 'vi'
  WHEN length(low) < 3 THEN 'other'
  WHEN t[1] <> lower(t[1]) THEN 'foreign' ELSE 'en_guess' END AS class FROM cand)"""


def _list(kind: str, value: str = "wd.t") -> str:
    return f"coalesce(list({value} ORDER BY pos) FILTER (WHERE class = '{kind}'), [])"


V2 = rf"""{CLASSES}, agg AS (
  SELECT doc_id, {_list('en')} AS en, {_list('en_ambiguous')} AS amb, {_list('en_guess')} AS guess, {_list('teencode', 'lower(wd.t)')} AS teen,
    {_list('laugh', 'lower(wd.t)')} AS laugh, {_list('foreign')} AS foreign_ FROM wd JOIN cls USING (t) GROUP BY doc_id
), v2a AS (
  SELECT tok.doc_id, split, length(text) AS n_chars, len(tokens) AS n_tokens, len(words) AS n_word_tokens, len(regexp_extract_all(text, '(?i)[{VIET_CHARS}]')) AS n_marks,
    len(regexp_extract_all(text, '[\x{{1F000}}-\x{{1FAFF}}←-⇿⌀-⏿☀-⛿✀-➿\x{{FE0F}}⬀-⯿]')) AS n_emoji, len(regexp_extract_all(text, '(?i)https?://\S+|www\.\S+')) AS n_url,
    len(regexp_extract_all(text, '(^|[^\p{{L}}\p{{N}}_])@[\p{{L}}\p{{N}}_.]+')) AS n_mention, len(regexp_extract_all(text, '(^|[^\p{{L}}\p{{N}}_])#[\p{{L}}\p{{N}}_]+')) AS n_hashtag,
    CASE WHEN len(en) > 0 THEN list_concat(en, amb) ELSE coalesce(en, []) END AS sure, coalesce(guess, []) AS guess, coalesce(teen, []) AS teen, coalesce(laugh, []) AS laugh, coalesce(foreign_, []) AS foreign_
  FROM tok LEFT JOIN agg USING (doc_id)
), v2b AS (
  SELECT *, len(sure) + len(guess) AS n_english, len(guess) AS n_english_guess, len(teen) AS n_teencode, len(laugh) AS n_laugh, len(foreign_) AS n_foreign_other,
    (len(sure) + len(guess)) / greatest(n_word_tokens, 1) AS english_ratio, len(teen) / greatest(n_word_tokens, 1) AS teencode_ratio, n_marks / greatest(n_chars, 1) AS diacritic_ratio,
    array_to_string(sure[1:30], ' ') AS english_tokens, array_to_string(teen[1:30], ' ') AS teencode_tokens, array_to_string(laugh[1:20], ' ') AS laugh_tokens FROM v2a
), v2 AS (
  SELECT *, n_english >= 1 AS has_english, n_teencode > 0 AS has_teencode, n_emoji > 0 AS has_emoji, n_english >= 1 AS is_cs_strict, (n_english >= 1 OR n_teencode > 0) AS is_cs_broad,
    CASE WHEN n_english >= 1 THEN 'english_mixed' WHEN n_teencode > 0 THEN 'teencode_slang' WHEN n_emoji > 0 THEN 'emoji_only' WHEN n_url + n_mention + n_hashtag > 0 OR n_laugh > 0 THEN 'other_noise' ELSE 'pure_vi' END AS cs_group,
    CASE WHEN n_english < 1 THEN 'none' WHEN english_ratio >= 0.25 OR n_english >= 3 THEN 'heavy' ELSE 'light' END AS cs_level FROM v2b
)"""

TIERS = """tiers AS (
  SELECT unnest(list_filter(['all', cs_group, CASE WHEN is_cs_strict THEN 'cs_strict' END, CASE WHEN is_cs_broad THEN 'cs_broad' END,
    CASE cs_level WHEN 'heavy' THEN 'cs_heavy' WHEN 'light' THEN 'cs_light' END], lambda x: x IS NOT NULL)) AS subset, r.* FROM rows_ r
)"""


def pseudo(salt: str) -> str:
    """A reproducible number in [0, 1) for (doc_id, salt)."""
    return f"('0x' || substr(md5(doc_id::VARCHAR || ':{salt}'), 1, 8))::BIGINT / 4294967296.0"


EVAL = f"""ev AS (
  SELECT doc_id, s.subset, l.label_id, l.y, l.p FROM (SELECT doc_id, 0 AS label_id, quality AS y, {pseudo('m0')} AS p FROM labels UNION ALL SELECT doc_id, 1, toxic, {pseudo('m1')} FROM labels) l
  CROSS JOIN (VALUES ('all'), ('r0'), ('r1'), ('r2')) s(subset) WHERE s.subset = 'all' OR s.subset = 'r' || (doc_id % 3)
)"""


def counts(threshold: str = "0.5", keys: str = "subset", source: str = "ev") -> str:
    return f"""cnt AS (SELECT {keys}, label_id, sum((y = 1 AND p >= {threshold})::INT) AS tp, sum((y <> 1 AND p >= {threshold})::INT) AS fp, sum((y = 1 AND p < {threshold})::INT) AS fn,
  sum((y = 1)::INT) AS support, count(*) AS n FROM {source} GROUP BY {keys}, label_id),
sc AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision_, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall_,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM cnt),
mt AS (SELECT {keys}, max(n) AS n_samples, 2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS micro_f1, avg(f1) AS macro_f1, sum(support * f1) / nullif(sum(support), 0) AS weighted_f1,
  avg(precision_) AS macro_precision, avg(recall_) AS macro_recall, (sum(fp) + sum(fn)) / sum(n) AS hamming_loss FROM sc GROUP BY {keys})"""
