"""DuckDB SQL of the queries that SQL can express, written by other means than
the operators: pairs by joins, windows by enumeration, components by recursion."""

from __future__ import annotations

#: Smallest id reachable over the (a, b) of a CTE "link"; ids from a CTE "ids".
_REACH = """reach AS (
  SELECT id, id AS c FROM ids
  UNION
  SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.c
), comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

OP1 = f"""WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), ids AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT i.id AS vec_id, (SELECT count(*) FROM link WHERE a = i.id) AS n_links, c.component_id,
  i.id = c.component_id AS kept
FROM ids i JOIN comp c ON c.id = i.id"""

OP2 = """WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    ((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, true AS verified
FROM g"""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP3 = f"""WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), ids AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT i.id AS doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, i.id = c.component_id AS kept
FROM ids i JOIN comp c ON c.id = i.id LEFT JOIN n ON n.doc_id = i.id"""

OP7 = f"""WITH w AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM w WHERE len(w) >= 35)
), rep AS (
  SELECT doc_id, list(i) AS starts FROM (SELECT *, count(*) OVER (PARTITION BY h) AS k FROM win) WHERE k > 1 GROUP BY doc_id
), pos AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM (SELECT doc_id, unnest(starts) AS s FROM rep)
), gone AS (SELECT doc_id, list(i) AS gone FROM pos GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n
  FROM words x ANTI JOIN pos p ON p.doc_id = x.doc_id AND p.i = x.i GROUP BY x.doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id"""

OP8 = """WITH b AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h
  FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM b WHERE n >= 200)
), rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS k FROM win) WHERE k > 1),
runs AS (
  SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (
      SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM rep))
  GROUP BY doc_id, r
), cuts AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his
  FROM runs GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN b.x ELSE
    array_to_string(list_transform(range(0, c.n_spans + 1), lambda j:
      substr(b.x, 2 * coalesce(c.his[j], 0) + 1, 2 * (coalesce(c.los[j + 1], b.n) - coalesce(c.his[j], 0)))), '') END)) AS kept_sha256
FROM b LEFT JOIN cuts c ON c.doc_id = b.doc_id"""

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = f"""WITH l AS MATERIALIZED (
  SELECT doc_id, i, x[i] AS line, translate(trim(x[i], {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
), r AS (
  SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), j AS (SELECT l.*, r.first IS NOT NULL AND l.doc_id > r.first AS gone FROM l LEFT JOIN r ON r.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


def _op12() -> str:
    """The states' best paths as strings: six digits of cost, then the audit, so
    that the least string is the cheapest and then ASCII-least path; ``~`` is no path."""
    def step(state, cost, letter):
        return (f"CASE WHEN {state} = '~' THEN '~' ELSE lpad((substr({state}, 1, 6)::INT + {cost})::VARCHAR, 6, '0') "
                f"|| substr({state}, 7) || '{letter}' END")

    def put(n, s, u, a):
        """After the insertions that can pay."""
        once = f"least({u}, {step(n, 2, 'I')}, {step(s, 2, 'I')}, {step(a, 2, 'I')})"
        return once, f"least({a}, {step(once, 2, 'I')})"

    def may(test, x):
        return f"CASE WHEN {test} THEN {x} ELSE '~' END"

    kept = {
        "n0": step("n", 3, "D"),
        "s0": f"least({step('s', 3, 'D')}, {may('ok AND c = ' + repr('s'), step('n', 't', 'K'))})",
        "u0": "least({}, {})".format(step("u", 3, "D"), ", ".join(
            may("ok AND c = 'u'", step(x, "t", "K")) + ", " + may("ok", step(x, "(2 + t)", "R")) for x in "nsa")),
        "a0": f"least({step('a', 3, 'D')}, {may('ok AND c = ' + repr('a'), step('u', 't', 'K'))}, {may('ok', step('u', '(2 + t)', 'R'))})",
    }
    u1, a1 = put("n0", "s0", "u0", "a0")
    space = _SPACE
    return f"""WITH RECURSIVE base AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), crc AS (
  SELECT DISTINCT key, 0 AS i, 4294967295::BIGINT AS c FROM base
  UNION ALL
  SELECT key, i + 1, xor(x >> 1, 3988292384 * (x & 1)) FROM (
    SELECT key, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(key, 1 + i // 8, 1))) ELSE c END AS x FROM crc WHERE i < 8 * length(key))
), damaged AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT b.*, xor(c, 4294967295) % 20 AS k FROM base b JOIN crc ON crc.key = b.key AND crc.i = 8 * length(b.key)),
    LATERAL (SELECT unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy)
), m AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, substr(role, 1, 1) AS c,
    trim(text, {space}) AS body, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS c_before
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)
), f AS MATERIALIZED (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM m
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE c_before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), dp AS (
  SELECT conv_id, 0 AS i, '000000' AS n, '~' AS s, '000002I' AS u, '000004II' AS a FROM sums
  UNION ALL
  SELECT conv_id, i, n0, s0, u1, a1 FROM (SELECT *, {a1.replace(u1, 'u1')} AS a1 FROM (SELECT *, {u1} AS u1 FROM (
    SELECT conv_id, i, {', '.join(f'{v} AS {k}' for k, v in kept.items())} FROM (
      SELECT d.conv_id, f.i, d.n, d.s, d.u, d.a, f.c, f.fault NOT IN ('blank', 'duplicate') AS ok,
        CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END AS t
      FROM dp d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1))))
), best AS (
  SELECT d.conv_id, substr(least(d.n, d.a), 1, 6)::BIGINT AS cost, substr(least(d.n, d.a), 7) AS audit
  FROM dp d JOIN sums x ON x.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = x.n
), fixed AS (
  SELECT conv_id, audit, 0 AS p, 0 AS i, '' AS now, '' AS body FROM best
  UNION ALL
  SELECT conv_id, audit, p, i, CASE WHEN e = 'D' THEN now ELSE role[1:1] END,
    CASE WHEN e = 'D' THEN body ELSE body || CASE WHEN now = '' THEN '' ELSE chr(10) END || role || ':' || text END
  FROM (
    SELECT x.conv_id, audit, p + 1 AS p, CASE WHEN e = 'I' THEN x.i ELSE x.i + 1 END AS i, now, x.body, e,
      CASE WHEN e = 'K' THEN f.role WHEN now = 'u' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN e = 'I' THEN '' ELSE f.text END AS text
    FROM (SELECT *, audit[p + 1:p + 1] AS e FROM fixed WHERE p < length(audit)) x
    LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i + 1)
)
SELECT o.conv_id, coalesce(x.gaps, 0) AS gaps, coalesce(x.blank, 0) AS blank, coalesce(x.duplicate, 0) AS duplicate,
  coalesce(x.truncated, 0) AS truncated, coalesce(x.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(r.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN fixed r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.p = length(r.audit)"""


OP12 = _op12()


def _op13(rounds: int = 10) -> str:
    """Every round in full: all distances, then sums by component."""
    def assigned(i):
        return f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT x.r, x.vec_id, x.v, y.c, list_sum(list_transform(range(1, 65), lambda j: (x.v[j] - y.v[j]) * (x.v[j] - y.v[j])))::BIGINT AS d
    FROM kept x, c{i} y) GROUP BY ALL)"""

    def moved(i):
        return f"""c{i} AS MATERIALIZED (
  SELECT y.c, coalesce(m.v, y.v) AS v FROM c{i - 1} y LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM (
      SELECT best.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{i - 1}, range(1, 65) t(j) GROUP BY 1, 2) GROUP BY c) m ON m.c = y.c)"""

    steps = ", ".join(f"{assigned(i)}, {moved(i + 1)}" for i in range(rounds))
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
    SELECT sha256('3:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 8)
), {steps}, {assigned(rounds)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
  sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(y.v, ',')) AS centroid_sha256
FROM a{rounds} x JOIN c{rounds} y ON y.c = x.best.c"""


OP13 = _op13()
