"""DuckDB SQL for the queries that SQL can express, over whole tables."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _covered(size: int) -> str:
    """Words of each row in windows of ``size`` words that occur twice or more."""
    return f"""(SELECT rid, count(DISTINCT pos) AS n FROM (
        SELECT rid, unnest(range(i, i + {size})) AS pos FROM (
          SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM (
            SELECT rid, i, array_to_string(ws[i:i + {size} - 1], ' ') AS s
            FROM (SELECT rid, ws, unnest(range(1, len(ws) - {size} + 2)) AS i FROM w)))
        WHERE c > 1) GROUP BY rid)"""


QUALITY = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
counts AS (
  SELECT rid, doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM w),
all_ AS (
  SELECT c.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(v.n, 0) AS n_covered, l.n IS NOT NULL AS long_repeat
  FROM counts c LEFT JOIN {_covered(8)} r USING (rid) LEFT JOIN {_covered(4)} v USING (rid)
  LEFT JOIN (SELECT DISTINCT rid, 1 AS n FROM (
    SELECT rid, count(*) OVER (PARTITION BY rid, s) AS c FROM (
      SELECT rid, md5(array_to_string(ws[i:i + 200], ' ')) AS s
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 199)) AS i FROM w WHERE len(ws) > 200))) WHERE c > 1) l USING (rid)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN n_covered / n_words ELSE 0.0 END AS covered FROM all_)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered::DOUBLE AS covered, base_failed,
  NOT base_failed AND covered <= 0.4 AND NOT long_repeat AS kept FROM judged"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT rid, doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT *, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS i FROM d)),
first_ AS (SELECT s, min(doc_id) AS low FROM starts GROUP BY s HAVING count(*) > 1),
hits AS (SELECT rid, i FROM starts JOIN first_ USING (s) WHERE doc_id > low),
runs AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM (
  SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hits)),
spans AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY rid, run),
pieces AS (SELECT s.rid, a, b, coalesce(lag(b) OVER (PARTITION BY s.rid ORDER BY a), 0) AS since, h FROM spans s JOIN d USING (rid)),
cut AS (SELECT rid, sum(b - a) AS gone, count(*) AS n, max(b) AS last,
  string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM pieces GROUP BY rid)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)"""

FOLDED = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {FOLDED} AS ws FROM documents),
items AS (SELECT item_id, ws, least(len(ws), 10) AS size FROM (SELECT item_id, {FOLDED} AS ws FROM benchmark) WHERE len(ws) > 0),
wins AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, size, array_to_string(ws[i:i + size - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM items)),
places AS (SELECT rid, size, i, array_to_string(ws[i:i + size - 1], ' ') AS s FROM (
  SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM wins) sizes)),
hits AS (SELECT rid, item, i, p.size FROM places p JOIN wins USING (size, s)),
hit_words AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (
  SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words hw USING (rid) LEFT JOIN hit_items hi USING (rid)"""


def _crc32(column: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes; ``crc_table`` has one row."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        range(0, CAST(octet_length(encode({column})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({column})), 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, bytes_[(xor(c, b) & 255) + 1])))"""


def _crc_steps(n: int = 8) -> str:
    return "k" if n == 0 else f"list_transform({_crc_steps(n - 1)}, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"


CRC_TABLE = f"crc_table AS (SELECT {_crc_steps()} AS bytes_ FROM (SELECT range(0, 256) AS k))"

SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT run, crc, count(*) AS n FROM (
  SELECT r.run, {_crc32("coalesce(CAST(r.doc_id AS VARCHAR), '') || ':' || r.run")} AS crc FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) r, crc_table) GROUP BY ALL),
typed AS (SELECT CASE WHEN crc % 31 = 0 THEN left(run, CAST(crc % length(run) AS BIGINT)) || substr(run, CAST(crc % length(run) AS BIGINT) + 2)
  ELSE run END AS word, n FROM runs),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cut c JOIN words w ON c.rest = w.word),
pairs AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, {{'n': -n, 'w': b}}) AS best, max(n) AS best_n FROM pairs JOIN words ON b = word GROUP BY a),
judged AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form,
  CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, word FROM judged UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON c.root = j.word WHERE j.form IS NOT NULL)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c USING (word)
JOIN judged e ON e.word = c.root WHERE e.form IS NULL"""

IMPORTANCE = rf"""
WITH {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS rid, doc_id, {FOLDED} AS ws FROM documents),
tests AS (SELECT unnest({FOLDED}) AS w FROM benchmark),
vocabulary AS MATERIALIZED (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM (
  SELECT unnest(ws) AS w FROM docs UNION ALL SELECT w FROM tests)), crc_table),
s AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(ws) AS w FROM docs) JOIN vocabulary USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM tests JOIN vocabulary USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s, (SELECT coalesce(sum(n), 0) FROM t) AS t),
gains AS (SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (sums.s + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1) * (sums.t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(0, 10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
sums_of AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS total FROM (SELECT rid, unnest(ws) AS w FROM docs)
  JOIN vocabulary USING (w) JOIN gains USING (bucket) GROUP BY rid),
weighed AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE CAST(floor(total::DOUBLE / len(ws)) AS BIGINT) END AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM docs LEFT JOIN sums_of USING (rid)),
scored AS (SELECT rid, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, rid) AS place,
    count(*) OVER () * 10 // 100 AS wanted FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM scored LEFT JOIN placed USING (rid)"""


def _licenses() -> str:
    """Base phrases and templates as lists of words; blocks as in the operator."""
    from vigilo.llm import licenses as li
    made = li.prepared(li.TEMPLATES)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({t['template']}, {quoted(t['label'])}, {t['k']}, {t['need']}, [{', '.join(map(quoted, t['words']))}])" for t in made)
    phrases = ", ".join(f"({quoted(p)}, {quoted(of)}, {len(p.split())})" for p, of in li.PHRASES)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {FOLDED} AS ws FROM documents),
templates(id, label, k, need, tws) AS (VALUES {templates}),
phrases(phrase, label, size) AS (VALUES {phrases}),
places AS (SELECT rid, label, i FROM (SELECT rid, ws, label, size, phrase, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, phrases)
  WHERE array_to_string(ws[i:i + size - 1], ' ') = phrase),
base AS (SELECT rid, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY rid),
known AS (SELECT rid, i, ws[i + 1] AS w FROM (SELECT rid, ws, unnest(range(0, len(ws))) AS i FROM docs)
  WHERE ws[i + 1] IN (SELECT unnest(tws) FROM templates)),
blocks AS (SELECT DISTINCT rid, k, cell - back AS block, w FROM (SELECT rid, k, i >> k AS cell, w FROM known, (SELECT DISTINCT k FROM templates)),
  (VALUES (0), (1)) b(back) WHERE cell >= back),
pairs AS (SELECT rid, block << t.k AS a, (block + 2) << t.k AS z, t.id, t.label, t.tws, count(*)::DOUBLE / len(t.tws) AS share
  FROM blocks b JOIN (SELECT *, unnest(tws) AS w FROM templates) t ON b.k = t.k AND b.w = t.w GROUP BY rid, block, t.k, t.id, t.label, t.tws, t.need HAVING count(*) >= t.need),
own AS (SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs o WHERE o.rid = p.rid AND o.a < p.z AND p.a < o.z
  AND len(o.tws) > len(p.tws) AND list_has_all(o.tws, p.tws))),
more AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS share FROM own GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM docs LEFT JOIN base b USING (rid) LEFT JOIN more m USING (rid)"""


LICENSES = _licenses()
