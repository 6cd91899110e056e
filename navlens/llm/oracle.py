"""DuckDB SQL of this package's queries (lambda syntax of DuckDB 1.3 and later)."""

from __future__ import annotations

from navlens.llm import licenses

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

# CRC-32 (reflected, polynomial 0xEDB88320) of a text's UTF-8 bytes, by a table that SQL makes.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                          b::BIGINT) ORDER BY b) AS t
  FROM range(256) r(b))"""


def _crc32(text: str) -> str:
    bytes_ = (f"list_transform(range(1, octet_length(encode({text})) + 1),"
              f" lambda i: ('0x' || substr(hex(encode({text})), (2 * i - 1)::BIGINT, 2))::BIGINT)")
    return (f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT),"
            " 4294967295)")


_QUALITY_VOTES = """[
    CASE WHEN n_symbols = 0 THEN 1 WHEN 10 * n_symbols > n_words THEN -1 ELSE 0 END,
    CASE WHEN 10 * word_chars > 75 * n_words OR 10 * word_chars < 30 * n_words THEN -1 ELSE 0 END,
    CASE WHEN 10 * n_upper > 4 * word_chars THEN -1 ELSE 0 END,
    CASE WHEN 5 * n_shouts > n_words THEN -1 ELSE 0 END,
    CASE WHEN n_lines >= 5 AND 10 * n_dup_lines > 4 * n_lines THEN -1 ELSE 0 END,
    CASE WHEN 100 * n_repeat_words > 30 * n_words THEN -1 WHEN n_repeat_words = 0 THEN 1 ELSE 0 END,
    CASE WHEN n_words < 40 THEN -1 ELSE 1 END]"""


def _posterior(votes: str, prior: str, odds: str) -> str:
    return (f"(1.0 / (1.0 + exp(-(ln({prior} / (1.0 - {prior})) + list_sum(list_transform(range(1, 8),"
            f" lambda j: {odds}[j][{votes}[j] + 2]))))))")


def _estimate(rows: str) -> str:
    """(prior, odds) from rows = list of structs (votes, n, good), as columns of a SELECT."""
    good, bad = (f"list_sum(list_transform({rows}, lambda r: r.good))",
                 f"list_sum(list_transform({rows}, lambda r: r.n - r.good))")

    def of_vote(v: int) -> str:
        def share(what: str, total: str) -> str:
            return (f"((coalesce(list_sum(list_transform(list_filter({rows}, lambda r: r.votes[j] = {v}),"
                    f" lambda r: {what})), 0.0) + 0.5) / ({total} + 1.0))")
        return f"ln({share('r.good', good)} / {share('r.n - r.good', bad)})"

    return (f"({good} + 0.5 + 0.4 * ({good} + {bad})) / (1.5 * ({good} + {bad}) + 1.0) AS prior, list_transform(range(1, 8), lambda j:"
            f" [least({of_vote(-1)}, -0.1), 0.0, greatest({of_vote(1)}, 0.1)]) AS odds")


OP1 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         {_WORDS.format("coalesce(text, '')")} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
wins AS (SELECT rid, i, ws[i:i + 7] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM wins) WHERE n > 1),
cover AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
          FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM again) GROUP BY rid),
f AS (
  SELECT d.rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts
  FROM d LEFT JOIN cover ON d.rid = cover.rid),
v AS (SELECT *, {_QUALITY_VOTES} AS votes FROM f),
p AS (SELECT list({{'votes': votes, 'n': n}} ORDER BY votes) AS p
      FROM (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes)),
em AS (
  SELECT 0 AS it, {_estimate('s')}
  FROM (SELECT list_transform(p, lambda r: {{'votes': r.votes, 'n': r.n, 'good': r.n *
          CASE WHEN list_contains(r.votes, -1) THEN 1.0 - 0.999 ELSE 0.999 END}}) AS s FROM p)
  UNION ALL
  SELECT it + 1, {_estimate('s')}
  FROM (SELECT it, list_transform(p, lambda r: {{'votes': r.votes, 'n': r.n, 'good': r.n *
          {_posterior('r.votes', 'prior', 'odds')}}}) AS s FROM em, p WHERE it < 30)),
m AS (SELECT prior, odds FROM em WHERE it = 30)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND round({_posterior('votes', 'prior', 'odds')}, 6) >= 0.5 AS kept,
       round({_posterior('votes', 'prior', 'odds')}, 6) AS quality
FROM v, m
"""

OP2 = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, text, coalesce(octet_length(encode(text)), 0) + 16 AS size, coalesce(md5(text), '') AS h
      FROM documents),
g AS (SELECT h, bytes, (sum(bytes) OVER (ORDER BY h))::BIGINT AS upto
      FROM (SELECT h, sum(size)::BIGINT AS bytes FROM d GROUP BY h)),
a AS (SELECT list(upto ORDER BY upto) AS ends, max(upto) AS total, max(bytes) AS largest FROM g),
-- binary search for the smallest capacity; each row advances the greedy check of one probe by one shard
s AS (
  SELECT greatest(largest, (total + 39) // 40) AS lo, total AS hi, 0::BIGINT AS pos, 0 AS k, ends, total FROM a
  UNION ALL
  SELECT CASE WHEN nxt <> total AND k = 39 THEN mid + 1 ELSE lo END, CASE WHEN nxt = total THEN mid ELSE hi END,
         CASE WHEN nxt = total OR k = 39 THEN 0 ELSE nxt END, CASE WHEN nxt = total OR k = 39 THEN 0 ELSE k + 1 END,
         ends, total
  FROM (SELECT *, coalesce(list_max(list_filter(ends, lambda e: e <= pos + mid)), 0) AS nxt
        FROM (SELECT *, (lo + hi) // 2 AS mid FROM s WHERE lo < hi))),
c AS (SELECT min(lo) AS capacity, any_value(ends) AS ends, any_value(total) AS total FROM s WHERE lo = hi),
-- what k shards must hold together, from the last cut back
b AS (
  SELECT 39 AS k, CASE WHEN total <= capacity THEN 0
                       ELSE list_min(list_filter(ends, lambda e: e >= total - capacity)) END AS least FROM c
  UNION ALL
  SELECT k - 1, CASE WHEN least <= capacity THEN 0
                     ELSE list_min(list_filter(ends, lambda e: e >= least - capacity)) END FROM b, c WHERE k > 1),
bl AS (SELECT list(least ORDER BY k) AS least FROM b),
cuts AS (
  SELECT 0 AS k, 0::BIGINT AS pos
  UNION ALL
  SELECT k + 1, greatest(least[k + 1],
                         coalesce(list_max(list_filter(ends, lambda e: e <= pos + (total - pos + 39 - k) // (40 - k))), 0),
                         list_min(list_filter(ends, lambda e: e >= least(pos + 1, total))))
  FROM cuts, bl, c WHERE k < 39),
cl AS (SELECT list(pos) AS cuts FROM cuts WHERE k > 0),
placed AS (SELECT doc_id, text, size, d.h, len(list_filter(cuts, lambda x: x < upto))::INTEGER AS shard
           FROM d JOIN g ON d.h = g.h, cl)
SELECT doc_id, size::BIGINT AS size,
       CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {_crc32('text')} END::BIGINT AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM placed, crc_table
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws,
             list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+(?:\s+|$)|\n+'),
                         lambda s: regexp_extract_all(lower(s), '[\p{L}\p{N}]+')), lambda s: len(s) > 0) AS parts
      FROM benchmark),
tf AS (SELECT item, term, count(*)::DOUBLE AS tf FROM (SELECT item, unnest(ws) AS term FROM i) GROUP BY ALL),
le AS (SELECT item, sum(tf) AS len FROM tf GROUP BY item),
st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg_len FROM le),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT item, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
             / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS w
      FROM tf JOIN le USING (item) JOIN df USING (term), st),
im AS (SELECT item, term, w / sum(w) OVER (PARTITION BY item) AS impact FROM w),
tok AS (SELECT rid, len(ws) AS n, p - 1 AS p, ws[p] AS term FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
pas AS (SELECT DISTINCT rid, passage, term
        FROM (SELECT rid, n, term, unnest([p // 16, p // 16 - 1]) AS passage FROM tok)
        WHERE passage >= 0 AND (passage = 0 OR passage * 16 < n - 16)),
best AS (SELECT rid, item, max(score) AS score
         FROM (SELECT rid, passage, item, sum(impact) AS score FROM pas JOIN im USING (term) GROUP BY ALL)
         WHERE score >= 0.35 - 1e-9 GROUP BY ALL),
qa AS (SELECT item, item_id,
              CASE WHEN len(parts) > 1 THEN flatten(parts[1:-2]) ELSE ws[1:(len(ws) + 1) // 2] END AS q,
              CASE WHEN len(parts) > 1 THEN parts[-1] ELSE ws[(len(ws) + 1) // 2 + 1:] END AS a FROM i),
sh AS (SELECT item, item_id, least(len(q), 5) AS qk, least(len(a), 5) AS ak,
              list_distinct(list_transform(range(1, len(q) - least(len(q), 5) + 2),
                                           lambda j: q[j:j + least(len(q), 5) - 1])) AS q,
              list_distinct(list_transform(range(1, len(a) - least(len(a), 5) + 2),
                                           lambda j: a[j:j + least(len(a), 5) - 1])) AS a FROM qa),
o AS (SELECT doc_id, item_id, round(score, 6) AS bm25_share,
             CASE WHEN qk = 0 THEN 1.0 ELSE len(list_filter(q, lambda s: list_contains(list_transform(
               range(1, len(ws) - qk + 2), lambda j: ws[j:j + qk - 1]), s))) / len(q) END AS question_overlap,
             CASE WHEN ak = 0 THEN 1.0 ELSE len(list_filter(a, lambda s: list_contains(list_transform(
               range(1, len(ws) - ak + 2), lambda j: ws[j:j + ak - 1]), s))) / len(a) END AS answer_overlap
      FROM best JOIN d USING (rid) JOIN sh USING (item))
SELECT * FROM o WHERE question_overlap >= 0.8 AND answer_overlap >= 0.8
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
                            {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
             ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) END AS sh FROM d),
u AS (SELECT rid, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (SELECT a, b FROM (SELECT p.rid AS a, q.rid AS b, p.n AS pn, q.n AS qn, count(*) AS shared
                            FROM u p JOIN u q ON p.x = q.x AND p.rid <> q.rid GROUP BY ALL)
          WHERE 100 * shared >= 90 * (pn + qn - shared)),
reach AS (SELECT rid AS a, rid AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.component_id,
       (SELECT count(*) FROM links l WHERE l.a = s.rid)::BIGINT AS n_links
FROM s JOIN (SELECT r.a, min(o.doc_id) AS component_id FROM reach r JOIN s o ON r.b = o.rid GROUP BY r.a) c ON s.rid = c.a
"""


def _op6() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in licenses.KNOWN.items())
    chain = "SELECT rid, sentence_ids AS rest, []::VARCHAR[] AS found FROM ids"
    for ids, licence in licenses.RULES:  # one nested SELECT for each rule
        seq = "".join(f"<{i}>" for i in ids)
        chain = (f"SELECT rid, replace(rest, '{seq}', '|') AS rest, CASE WHEN contains(rest, '{seq}')"
                 f" AND NOT list_contains(found, '{licence}') THEN list_append(found, '{licence}') ELSE found END AS found"
                 f" FROM ({chain})")
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_replace({_LOWER.format("coalesce(text, '')")}, '[.!?]+([\x20\x09-\x0D]+|$)', chr(10) || chr(10), 'g') AS t
      FROM documents),
b AS (SELECT rid, doc_id, list_filter(list_transform(regexp_split_to_array(
                 regexp_replace(t, '[^a-z0-9\n]+', ' ', 'g'), '\n *\n[ \n]*'), lambda x: trim(x, ' ' || chr(10))),
                 lambda x: x <> '') AS blocks FROM d),
ks AS (SELECT list(sentence) AS ks FROM known),
s AS (SELECT rid, doc_id, flatten(list_transform(blocks, lambda x: CASE
                 WHEN NOT contains(x, chr(10)) OR list_contains(ks, regexp_replace(x, ' *\n *', ' ', 'g'))
                 THEN [regexp_replace(x, ' *\n *', ' ', 'g')] ELSE regexp_split_to_array(x, ' *\n *') END)) AS all_ FROM b, ks),
e AS (SELECT rid, i, all_[i] AS sentence FROM (SELECT rid, all_, unnest(range(1, len(all_) + 1)) AS i FROM s)),
m AS (SELECT rid, count(id) AS n_known, count(*) FILTER (id IS NULL AND regexp_matches(e.sentence,
             '(^| )(licen[sc]ed?|copyright|warranty|redistribut[a-z]*|spdx)( |$)')) AS n_unknown,
             string_agg('<' || id || '>', '' ORDER BY i) AS sentence_ids
      FROM e LEFT JOIN known ON e.sentence = known.sentence GROUP BY rid),
ids AS (SELECT s.rid, doc_id, len(all_) AS n, coalesce(n_known, 0) AS n_known, coalesce(n_unknown, 0) AS n_unknown,
               coalesce(sentence_ids, '') AS sentence_ids FROM s LEFT JOIN m ON s.rid = m.rid),
r AS ({chain})
SELECT doc_id, n::INTEGER AS n_sentences, n_known::INTEGER AS n_known, n_unknown::INTEGER AS n_unknown, sentence_ids,
       coalesce(array_to_string(found, ','), '') AS licenses, found[1] AS license
FROM ids JOIN r ON ids.rid = r.rid
"""


def _terms(words: str) -> str:
    return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::INTEGER" for w in words.split())


OP8 = f"""
WITH p AS (
  SELECT page_id, coalesce({_LOWER.format("url")}, '') AS u,
         coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/')
        THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/')
        THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    {_terms('casino porn xxx viagra escort warez phishing malware')} AS n_strict,
    {_terms('win bet poker bonus jackpot loan sex adult pills torrent crack free hack dating')} AS n_soft
  FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block' WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict,
       n_strict, n_soft
FROM r
"""

OP9 = f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, {_crc32('doc_id::VARCHAR')} % 10 = 0 AS held_out,
             list_append({_WORDS.format(_LOWER.format("coalesce(text, '')"))}, ' ') AS ws
      FROM documents, crc_table),
t AS (SELECT rid, held_out, p, ws[p] AS w, CASE WHEN p = 1 THEN '  ' ELSE ws[p - 1] END AS h,
             CASE WHEN p = 2 THEN '  ' WHEN p > 2 THEN ws[p - 2] END AS g
      FROM (SELECT rid, held_out, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
uni AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
bi AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY ALL),
tri AS (SELECT g, h, w, count(*) AS c FROM t WHERE NOT held_out AND g IS NOT NULL GROUP BY ALL),
st AS (SELECT h, count(*) AS c FROM t WHERE NOT held_out GROUP BY h),
st2 AS (SELECT g, h, sum(c)::BIGINT AS c FROM tri GROUP BY ALL),
a AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM uni),
x AS (SELECT t.rid, coalesce(uni.c, 0) AS cw, coalesce(bi.c, 0) AS cb, coalesce(st.c, 0) AS ch,
             coalesce(tri.c, 0) AS ct, coalesce(st2.c, 0) AS cg,
             (coalesce(uni.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p, n
      FROM t LEFT JOIN uni ON t.w = uni.w LEFT JOIN bi ON t.h = bi.h AND t.w = bi.w LEFT JOIN st ON t.h = st.h
      LEFT JOIN tri ON t.g = tri.g AND t.h = tri.h AND t.w = tri.w LEFT JOIN st2 ON t.g = st2.g AND t.h = st2.h, a)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (cw > 0) AS n_known, any_value(n) AS train_tokens,
       round(sum(log10(p)), 6) AS base_score,
       round(sum(log10((ct + 3.0::DOUBLE * (cb + 300.0::DOUBLE * p) / (ch + 300.0::DOUBLE)) / (cg + 3.0::DOUBLE))), 6) AS score
FROM x JOIN d USING (rid) GROUP BY rid, doc_id, held_out
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op2_sharding": OP2,
    "op3_decontamination": OP3,
    "op5_jaccard_join": OP5,
    "op6_license_scan": _op6(),
    "op8_url_filter": OP8,
    "op9_lm_score": OP9,
}
