"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from spectralake.llm import url_filters


def _op9() -> str:
    terms = lambda names: "|".join(sorted(names))
    soft = " + ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {w} ELSE 0 END" for t, w in sorted(url_filters.SOFT.items()))
    return f"""
    WITH a AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
    b AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
                 CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM a),
    c AS (SELECT page_id, u, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM b),
    d AS (SELECT page_id, u, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM c),
    e AS (SELECT *, CASE
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM d)
    SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(u, '(^|[^a-z0-9])({terms(url_filters.STRICT)})([^a-z0-9]|$)') THEN 'block'
            WHEN {soft} >= {url_filters.THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
    FROM e"""


#: Words of a text, and those left after a set of places went.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP3 = f"""
    WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS k FROM w, unnest(range(1, len(w) - 11)) t(i)),
    f AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
    hit AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN f USING (k), range(0, 13) r(j) WHERE low < doc_id),
    gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
    word AS (SELECT doc_id, p, w[p] AS x FROM w, unnest(range(1, len(w) + 1)) t(p)),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS x FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
    FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_OP8 = """
    WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
    g AS (SELECT doc_id, i, md5(substr(b, 2 * i + 1, 400)) AS k FROM b, unnest(range(0, n - 199)) t(i)),
    hit AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY k) > 1),
    run AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    num AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM run),
    span AS (SELECT doc_id, r, min(i) AS a, max(i) + 200 AS z FROM num GROUP BY 1, 2),
    edge AS (SELECT doc_id, n, b, r, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY r) AS before FROM span JOIN b USING (doc_id)),
    left_ AS (SELECT doc_id, count(*) AS spans, sum(z - a)::BIGINT AS removed, string_agg(substr(b, 2 * before + 1, 2 * (a - before)), '' ORDER BY r) || substr(any_value(b), 2 * max(z) + 1) AS x FROM edge GROUP BY doc_id)
    SELECT b.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, b))) AS kept_sha256 FROM b LEFT JOIN left_ USING (doc_id)"""

_OP10 = r"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
    dw AS (SELECT doc_id, len(w) AS nd, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d),
    bw AS (SELECT item_id, len(w) AS nb, least(13, len(w)) AS width, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS q FROM b),
    m AS (SELECT doc_id, item_id, nd, nb, width, p - q AS shift, q FROM dw JOIN bw USING (x)),
    line AS (SELECT doc_id, item_id, shift, any_value(nd) AS nd, any_value(nb) AS nb, any_value(width) AS width, list(q) AS qs FROM m GROUP BY 1, 2, 3 HAVING count(*) * 100 >= 80 * any_value(width)),
    win AS (SELECT doc_id, item_id, shift, width, s, len(list_filter(qs, lambda q: q >= s AND q < s + width)) AS eq
            FROM line, unnest(range(greatest(0, -shift), least(nb, nd - shift) - width + 1)) t(s)),
    good AS (SELECT doc_id, item_id, shift, count(*) AS n, max(eq) AS best FROM win WHERE eq * 100 >= 80 * width GROUP BY 1, 2, 3)
    SELECT doc_id, item_id, max(n)::BIGINT AS n_windows, max(best)::BIGINT AS best FROM good GROUP BY 1, 2"""


#: CRC-32 by its table of 256 entries, which list_reduce works out bit by bit. Words that are near share a word with one letter left out.
_OP11 = r"""
    WITH RECURSIVE entry AS (SELECT c, list_reduce(list_prepend(c, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) t(c)),
    crc AS (SELECT list(v ORDER BY c) AS tab FROM entry),
    run AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
    own AS (SELECT d, r, count(*) AS k FROM run GROUP BY 1, 2),
    hexed AS (SELECT *, hex(encode(d || ':' || r)) AS x FROM own),
    byte AS (SELECT *, list_transform(range(length(x) // 2), lambda i: (strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) AS bs FROM hexed),
    hashed AS (SELECT r, k, xor(list_reduce(list_prepend(4294967295, bs), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h FROM byte, crc),
    made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, k FROM hashed),
    v AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
    cut AS (SELECT word, n, length(word) AS l, i, substr(word, 1, i) || substr(word, i + 2) AS c FROM v, unnest(range(0, length(word))) t(i)),
    pair AS (SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.c = b.c AND a.l = b.l AND a.i = b.i AND a.word <> b.word
             UNION SELECT c, word FROM cut WHERE c IN (SELECT word FROM v) UNION SELECT word, c FROM cut WHERE c IN (SELECT word FROM v)),
    near AS (SELECT x, count(*) AS n_near, first(y ORDER BY v.n DESC, y) AS w, max(v.n) AS m FROM pair JOIN v ON y = v.word GROUP BY x),
    judged AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN w END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN near ON x = word),
    walk AS (SELECT word, word AS z, 0 AS steps FROM judged UNION ALL SELECT walk.word, form, steps + 1 FROM walk JOIN judged ON z = judged.word WHERE form IS NOT NULL)
    SELECT judged.word, form, root, n, n_near, form_n FROM judged JOIN (SELECT word, arg_max(z, steps) AS root FROM walk GROUP BY word) USING (word)"""


_OP12 = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM w),
    s AS (SELECT DISTINCT doc_id, s FROM g),
    size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM met JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
    far AS (SELECT a, b FROM link UNION SELECT far.a, link.b FROM far JOIN link ON far.b = link.a)
    SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id
    FROM w LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM far GROUP BY a) ON a = w.doc_id"""


def _op13() -> str:
    """Rounds written out one after the other: sums by part and entry, floors of means, unused entries as they were."""
    nearest = """
    d{r} AS (SELECT vec_id, r, p, e, sum((x - c) * (x - c))::BIGINT AS s FROM part JOIN book{r} USING (p, q) GROUP BY ALL),
    at{r} AS (SELECT vec_id, r, p, min(s) AS s, arg_min(e, (s, e)) AS e FROM d{r} GROUP BY vec_id, r, p)"""
    mean = """
    book{n} AS (SELECT b.p, b.e, b.q, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
        SELECT p, e, q, floor(sum(x) / count(*))::BIGINT AS c FROM part JOIN at{r} USING (vec_id, r, p) GROUP BY p, e, q) m ON b.p = m.p AND b.e = m.e AND b.q = m.q)"""
    steps = ",".join(nearest.format(r=r) + "," + mean.format(r=r, n=r + 1) for r in range(2)) + "," + nearest.format(r=2)
    return f"""
    WITH kept AS (SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id, embedding) AS r FROM embeddings
                  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    item AS (SELECT vec_id, r, len(v) // 16 AS w, unnest(v) AS f, generate_subscripts(v, 1) - 1 AS i FROM kept),
    part AS (SELECT vec_id, r, (i // w)::INTEGER AS p, (i % w)::INTEGER AS q, floor(f::DOUBLE * 256)::BIGINT AS x FROM item),
    book0 AS (SELECT p, (r - 1)::INTEGER AS e, q, x AS c FROM part WHERE r <= 64),{steps},
    code AS (SELECT vec_id, r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(s)::BIGINT AS error FROM at2 GROUP BY vec_id, r)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, q)) FROM book2) AS codebooks_sha256
    FROM code JOIN kept USING (vec_id, r)"""


def oracles() -> dict[str, str]:
    return {"op3_substring_dedup": _OP3, "op8_suffix_dedup": _OP8, "op9_url_filters": _op9(), "op10_decontamination": _OP10, "op11_spelling_variants": _OP11, "op12_ngram_jaccard": _OP12, "op13_vector_codes": _op13()}
