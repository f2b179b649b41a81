"""SQL twins of the corpus queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
firsts AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first_id FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS q FROM firsts WHERE first_id < doc_id),
runs AS (SELECT doc_id, q, q - lag(q, 1, -1) OVER (PARTITION BY doc_id ORDER BY q) AS step FROM gone),
lists AS (SELECT doc_id, list(q) AS qs, count(*) AS n, count_if(step <> 1)::BIGINT AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(qs, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id
"""

OP4 = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
windows AS (SELECT doc_id, p, md5(substr(x, 2 * p - 1, 200)) AS g FROM (SELECT doc_id, x, unnest(generate_series(1, n - 99)) AS p FROM d WHERE n >= 100)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
gaps AS (SELECT doc_id, p, p - lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) > 100 AS new FROM later),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 99 AS b FROM (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM gaps) GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
lists AS (SELECT doc_id, count(*) AS k, sum(b - a + 1)::BIGINT AS gone, list(struct_pack(s := before, e := a) ORDER BY a) AS kept, max(b) AS last FROM cut GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(k, 0) AS n_spans,
  sha256(unhex(CASE WHEN k IS NULL THEN x ELSE array_to_string(list_transform(kept, lambda c: substr(x, (2 * c.s + 1)::BIGINT, (2 * (c.e - 1 - c.s))::BIGINT)), '') || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id
"""

#: Not the method, but the truth it has to find: the given tables' pages mark their article by one element, of paragraphs and headings.
OP7 = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS x FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
decoded AS (SELECT page_id, url, regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g') AS x FROM plain),
texts AS (SELECT page_id, url, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""

OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * g::INT, 5))::BIGINT >> s) & 31)::INT, 1)), '')), '') AS payload_digest FROM p),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM firsts
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
tests AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS i FROM b)),
places AS (SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM tests) WHERE len(w) >= k)),
hits AS (SELECT doc_id, p, k, item FROM places JOIN tests USING (k, g)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""

#: The checksum CRC-32 of a text's bytes, from its polynomial.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i))) AS crc_table"


def _crc(text: str) -> str:
    pairs = f"list_transform(range(length(hex(encode({text}))) // 2), lambda j: ('0x' || substr(hex(encode({text})), (2 * j + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce({pairs}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


OP13 = f"""
WITH sales_ AS (SELECT sale_id, {_crc('sale_id::VARCHAR')} % 5 = 0 AS own FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL), (SELECT {_CRC_TABLE})),
l AS (SELECT CASE WHEN own THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN own THEN -1 ELSE coalesce(item_id % 2, -1) END AS part, CASE WHEN own THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month,
  sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity, floor(quantity / 10)::BIGINT AS tens, floor(100 * discount + 0.5)::BIGINT AS percent, floor(100 * amount + 0.5)::BIGINT AS amount_cents
  FROM sale_lines LEFT JOIN sales_ USING (sale_id)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
  dense_rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST) AS place, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM l)
SELECT vendor_id, part::BIGINT AS part, month::BIGINT AS month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM ranks WHERE place <= 5
"""

OP12 = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents),
summed AS (SELECT run, n, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL), (SELECT {_CRC_TABLE})),
slipped AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(generate_series(1, length(word))) AS p FROM v),
blanked AS (SELECT word, n, substr(word, 1, p - 1) || '*' || substr(word, p + 1) AS k FROM places),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, p - 1) || substr(word, p + 1) AS k FROM places),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM blanked a JOIN blanked b USING (k) WHERE a.word <> b.word
  UNION ALL SELECT s.word, s.n, v.word, v.n FROM shorter s JOIN v ON s.k = v.word UNION ALL SELECT v.word, v.n, s.word, s.n FROM shorter s JOIN v ON s.k = v.word),
best AS (SELECT word, n, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS nth FROM pairs),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best b ON v.word = b.word AND nth = 1),
chain AS (SELECT word, word AS tip FROM forms UNION ALL SELECT chain.word, form FROM chain JOIN forms ON tip = forms.word WHERE form IS NOT NULL),
ends AS (SELECT chain.word, tip AS root FROM chain JOIN forms ON tip = forms.word WHERE form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN ends USING (word)
"""
