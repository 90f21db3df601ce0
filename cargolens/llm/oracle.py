"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

import hashlib
import re

import regex

from cargolens.llm.licenses import COPYRIGHT_LINE, LICENSES, SPELLINGS

SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
#: characters that white space trimming takes
TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
DOCS = "d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text, lang, source FROM documents)"
#: A-Z in lower case and nothing else
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""WITH {DOCS}, n AS (SELECT doc_id, regexp_replace(text, '{SPACE}+', ' ', 'g') AS t FROM d),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""

LINES = f"""WITH {DOCS}, a AS (SELECT uid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, {LOWER.format(f'trim(line, {TRIM})')} AS key FROM a),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT uid) >= 10),
m AS (SELECT uid, doc_id, line, i, key IN (SELECT key FROM f) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY uid, doc_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), g AS (SELECT html, max(page_id) AS first FROM p GROUP BY html),
h AS (SELECT page_id, html, first, CAST(CAST(from_hex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p JOIN g USING (html))
SELECT page_id, strlen(html) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM h"""

QUALITY = f"""WITH {DOCS}, w AS (SELECT uid, doc_id, source, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
x AS (SELECT uid, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
v AS (SELECT uid, i, array_to_string(words[i:i + 4], ' ') AS win FROM x),
r AS (SELECT uid, i FROM v QUALIFY count(*) OVER (PARTITION BY uid, win) > 1),
c AS (SELECT uid, count(DISTINCT p) AS n_repeat_words FROM (SELECT uid, unnest(range(i, i + 5)) AS p FROM r) GROUP BY uid),
l AS (SELECT uid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY uid),
m AS (SELECT doc_id, source, len(words) AS n_words, CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN l USING (uid) LEFT JOIN c USING (uid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b GROUP BY source),
t AS (SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(sum(f) AS DOUBLE) / sum(n) AS m, count(*) AS hosts FROM h),
q AS (SELECT any_value(m) AS m, sum(n * (f / n - m) * (f / n - m)) AS spread, any_value(hosts) - 1 AS free, sum((1 - n / total) * (n - 1)) AS weight FROM h, t),
a AS (SELECT m, CASE WHEN m > 0 AND m < 1 AND weight > 1e-9 THEN greatest(0, least(1, (spread / (m * (1 - m)) - free) / weight)) ELSE 0 END AS rho FROM q),
z AS (SELECT source, (f * rho + m * (1 - rho)) / (n * rho + 1 - rho) AS rate FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate + 1e-9, 4) AS host_rate, NOT base_failed AND rate <= 0.5 AS kept FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source"""


def _spans(kind: int, name: str, pattern: str, value: int, least: int, more: str = "true") -> str:
    """Spans of a pattern's matches whose value (a group) is long enough, their places added up from what lies between them."""
    return (
        f"SELECT uid, source, lang, {kind} AS kind, '{name}' AS name, list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS s, length(hits[k]) AS size, vals[k] AS val FROM ("
        f"SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT uid, source, lang, regexp_split_to_array(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {value}) AS vals FROM d)) WHERE length(vals[k]) >= {least} AND {more}"
    )


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
MIXED = "regexp_matches(vals[k], '[a-z]') AND regexp_matches(vals[k], '[A-Z]') AND regexp_matches(vals[k], '[0-9]')"
SECRETS = f"""WITH {DOCS}, base AS ({_spans(0, 'assign', ASSIGN, 2, 6)} UNION ALL {_spans(1, 'access', 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_spans(2, 'hex', '[0-9a-f]+', 0, 24)}),
o AS ({_spans(3, 'opaque', '[A-Za-z0-9+/_-]{24,}', 0, 24, MIXED)}),
alone AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.uid = o.uid AND base.s < o.s + o.size AND o.s < base.s + base.size)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM alone),
owners AS (SELECT val, count(DISTINCT coalesce(source, '<null>')) AS n_owners, count(DISTINCT coalesce(source, '<null>') || '/' || coalesce(lang, '<null>')) AS n_repos FROM every GROUP BY val),
told AS (SELECT e.*, n_owners <= 1 AS live, name || ':' || s || ':' || (s + size) AS span FROM every e JOIN owners USING (val)),
g AS (SELECT uid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS b,
  string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3 OR live) AS spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE kind < 3 AND NOT live) AS n_example FROM told GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (uid)"""

def _canonical(text: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({text}), '(?m){COPYRIGHT_LINE}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for word, instead in SPELLINGS.items():
        out = f"regexp_replace({out}, '\\b{word}\\b', '{instead}', 'g')"
    return out


def known_forms() -> dict[str, str]:
    """Digest of each known text's canonical form, made here in plain Python, to its smallest identifier."""
    found: dict[str, str] = {}
    for name, text in LICENSES:
        form = regex.sub(r"[^\p{L}\p{N}\n]+", " ", regex.sub("(?m)" + COPYRIGHT_LINE, "", text.lower()))
        for word, instead in SPELLINGS.items():
            form = re.sub(rf"\b{word}\b", instead, form)
        digest = hashlib.sha256(re.sub("[ \n]+", " ", form).strip(" ").encode()).hexdigest()
        found[digest] = min(name, found.get(digest, name))
    return found


LICENSE_TWIN = f"""WITH {DOCS}, known AS (SELECT * FROM (VALUES {', '.join(f"('{d}', '{i}')" for d, i in known_forms().items())}) k(digest, license_id)),
c AS (SELECT uid, doc_id, {_canonical('text')} AS form FROM d),
l AS (SELECT uid, trim(line) AS line FROM (SELECT uid, unnest(string_split(form, chr(10))) AS line FROM c)),
n AS (SELECT uid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids, count(*) AS n_notices FROM l JOIN known ON sha256(line) = digest WHERE line <> '' GROUP BY uid)
SELECT doc_id, sha256(trim(regexp_replace(form, '[ \\n]+', ' ', 'g'))) AS text_digest, license_id, coalesce(notice_ids, '') AS notice_ids, coalesce(n_notices, 0) AS n_notices
FROM c LEFT JOIN n USING (uid) LEFT JOIN known ON sha256(trim(regexp_replace(form, '[ \\n]+', ' ', 'g'))) = digest"""


def _fill(level: str, parent: str, weight: str, budget: str, source: str) -> str:
    """A level's budgets: the water level at the first node that stays below its capacity."""
    over = f"PARTITION BY {parent} ORDER BY cap / w, {level}" if parent else f"ORDER BY cap / w, {level}"
    all_ = f"PARTITION BY {parent} ORDER BY cap / w, {level}" if parent else f"ORDER BY cap / w, {level}"
    keys = f"{parent}, {level}" if parent else level
    return (
        f"{level}_n AS (SELECT {keys}, CAST(3 * sum(tokens) AS BIGINT) AS cap, CASE {level} {weight} END AS w FROM leaves GROUP BY ALL), {level}_b AS (SELECT n.*, {budget} AS b FROM {level}_n n {source}), "
        f"{level}_l AS (SELECT *, (b - coalesce(sum(cap) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM {level}_b), "
        f"{level}_t AS (SELECT *, first(CASE WHEN lv < cap / w THEN lv END IGNORE NULLS) OVER ({all_} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tl FROM {level}_l), "
        f"{level}_g AS (SELECT {keys}, CAST(greatest(CASE WHEN tl IS NULL OR cap / w <= tl THEN cap ELSE floor(tl * w) END, 0) AS BIGINT) AS given FROM {level}_t)"
    )


MIX = f"""WITH d AS (SELECT doc_id, 'domain' || coalesce(CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 AS VARCHAR), '-') AS domain, coalesce(lang, '<null>') AS lang, coalesce(source, '<null>') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL), total AS (SELECT CAST(floor(sum(tokens) * 0.8) AS BIGINT) AS budget FROM leaves),
{_fill('domain', '', "WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 2 WHEN 'domain2' THEN 2 ELSE 1", '(SELECT budget FROM total)', '')},
{_fill('lang', 'domain', "WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1", 'g.given', 'JOIN domain_g g USING (domain)')},
{_fill('source', 'domain, lang', "WHEN '' THEN 1 ELSE 1", 'g.given', 'JOIN lang_g g USING (domain, lang)')},
plan AS (SELECT domain, lang, source, given, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole, given - CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END * tokens AS rest FROM source_g JOIN leaves USING (domain, lang, source)),
k AS (SELECT d.*, given, whole, rest, md5('7:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM d JOIN plan USING (domain, lang, source)),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest AS inside FROM k)
SELECT doc_id, domain, lang, source, n_tokens, given AS leaf_budget, unnest(range(0, whole + CASE WHEN inside AND rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM c"""

PACK = f"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1 AS epoch, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS total FROM documents),
p AS (SELECT doc_id, epoch, piece_no, 2048 * piece_no AS start_token, least(2048, total - 2048 * piece_no) AS n_tokens, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || piece_no) AS key FROM (SELECT *, unnest(range(0, CAST(greatest(ceil(total / 2048), 1) AS BIGINT))) AS piece_no FROM d)),
h AS (SELECT n_tokens AS l, CAST(count(*) AS BIGINT) AS c, row_number() OVER (ORDER BY n_tokens) AS j FROM p WHERE n_tokens > 0 GROUP BY 1),
s AS (SELECT 0 AS j, 0 AS l, 0 AS hc, 0 AS tc UNION ALL SELECT j, l, sum(c) OVER (ORDER BY j), sum(c * l) OVER (ORDER BY j) FROM h),
dp AS (SELECT 1 AS k, j, CAST(l * hc - tc AS BIGINT) AS cost, CAST(0 AS BIGINT) AS cut FROM s WHERE j > 0
  UNION ALL SELECT min(dp.k) + 1, b.j, least(min(dp.cost + b.l * (b.hc - a.hc) - (b.tc - a.tc)), any_value(o.cost)), CASE WHEN min(dp.cost + b.l * (b.hc - a.hc) - (b.tc - a.tc)) < any_value(o.cost) THEN arg_min(dp.j, (dp.cost + b.l * (b.hc - a.hc) - (b.tc - a.tc), dp.j)) ELSE -1 END
  FROM dp JOIN s a ON a.j = dp.j JOIN s b ON b.j > a.j JOIN dp o ON o.j = b.j WHERE dp.k < 8 GROUP BY b.j),
back AS (SELECT k, j FROM dp WHERE j = (SELECT max(j) FROM h) AND k = (SELECT max(k) FROM dp) UNION ALL SELECT dp.k - 1, CASE WHEN dp.cut > 0 THEN dp.cut ELSE dp.j END FROM back JOIN dp ON dp.k = back.k AND dp.j = back.j WHERE dp.k > 1),
e AS (SELECT DISTINCT l AS bucket_len FROM back JOIN h ON h.j = back.j JOIN dp ON dp.k = back.k AND dp.j = back.j),
q AS (SELECT p.*, (SELECT min(bucket_len) FROM e WHERE bucket_len >= n_tokens) AS bucket_len FROM p WHERE n_tokens > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket_len, epoch ORDER BY key, doc_id, piece_no, n_tokens) - 1 AS place FROM q),
m AS (SELECT bucket_len, epoch, coalesce(sum(ceil(count(*) / (16384 // bucket_len))) OVER (PARTITION BY bucket_len ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_batch FROM q GROUP BY bucket_len, epoch)
SELECT doc_id, epoch, piece_no, start_token, n_tokens, bucket_len, CAST(first_batch + place // (16384 // bucket_len) AS BIGINT) AS batch_no, place % (16384 // bucket_len) AS slot, bucket_len - n_tokens AS padding FROM r JOIN m USING (bucket_len, epoch)
UNION ALL SELECT doc_id, epoch, piece_no, start_token, n_tokens, NULL, NULL, NULL, NULL FROM p WHERE n_tokens = 0"""

COLLOCATIONS = f"""WITH d AS (SELECT row_number() OVER () AS uid, coalesce(lang, 'und') AS lang, {LOWER.format("coalesce(text, '')")} AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
t AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE i + size - 1 <= len(words)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
q AS (SELECT lang, phrase, size, a, k, array_to_string(words[1:k], ' ') AS x, array_to_string(words[k + 1:size], ' ') AS y FROM k),
v AS (SELECT q.lang, q.phrase, a, k, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM q JOIN f l ON l.lang = q.lang AND l.phrase = x JOIN f r ON r.lang = q.lang AND r.phrase = y JOIN t ON t.lang = q.lang),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a AS longer, words, size, unnest(range(1, size)) AS i FROM c WHERE size > 2),
o AS (SELECT lang, longer, array_to_string(words[i:i + m - 1], ' ') AS phrase FROM i, (SELECT unnest([2, 3, 4]) AS m) WHERE m < size AND i + m - 1 <= size),
x AS (SELECT lang, phrase, max(longer) AS longer FROM o GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.longer IS NULL OR 100 * x.longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM z QUALIFY rank <= 2000"""

ORACLES: dict[str, str] = {
    "op1_length_buckets": PACK,
    "op3_exact_dedup": EXACT,
    "op4_license_digests": LICENSE_TWIN,
    "op5_line_dedup": LINES,
    "op6_warc_round_trip": WARC,
    "op7_host_quality": QUALITY,
    "op8_secret_ownership": SECRETS,
    "op9_source_mix": MIX,
    "op12_collocations": COLLOCATIONS,
}
