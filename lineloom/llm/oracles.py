"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

# A-Z only
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return _LOWER.format(text)


OP1 = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM windows WHERE h IN (SELECT h FROM repeated)),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs WHERE len(w) > 0),
judged AS (
    SELECT p.*, g.pos IS NOT NULL AS removed FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos),
done AS (
    SELECT doc_id, count(*) AS n_words, CAST(sum(CASE WHEN removed THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
           string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed) AS kept
    FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN done USING (doc_id)
"""

OP2 = f"""
WITH lines AS (
    SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT *, {_lower(f"trim(line, {_BLANKS})")} AS key FROM lines),
shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
    SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_RULES = (("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"),
          ("net", "/fr/", "block"), ("com", "/", "allow"))


def _rule(value) -> str:
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'"
        for h, p, v in _RULES
    ) + " END"


def _strength(children: str, parent: str) -> str:
    return f"""
    SELECT (1 - rho) / rho AS m FROM (SELECT CASE WHEN coalesce(room, 0) > 0
        THEN least(0.5, greatest(0.001, excess / room)) ELSE 0.001 END AS rho FROM (
        SELECT sum((squares - k * r) / (r * (1 - r)) - (c - 1)) AS excess, sum(n - sizes / n - (c - 1)) AS room FROM (
            SELECT *, k / n AS r FROM (
                SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k, count(*) AS c,
                       sum(CAST(k AS DOUBLE) * k / n) AS squares, CAST(sum(n * n) AS DOUBLE) AS sizes
                FROM {children} GROUP BY {parent}) WHERE c > 1) WHERE r > 0 AND r < 1))"""


OP4 = f"""
WITH parts AS (
    SELECT page_id, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE ''
          END AS rest FROM pages)),
counts AS (
    SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k FROM parts
    LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS good FROM labels) l
    ON page_id = doc_id GROUP BY host),
hosts AS (
    SELECT host, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k,
           array_to_string(list_slice(ls, greatest(1, len(ls) - w + 1), len(ls)), '.') AS suffix,
           array_to_string(list_slice(ls, greatest(1, len(ls) - w), len(ls)), '.') AS domain
    FROM (SELECT *, CASE WHEN len(ls) > 2 AND length(ls[-1]) = 2
                 AND ls[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS w
          FROM (SELECT *, string_split(host, '.') AS ls FROM counts))),
seen AS (SELECT * FROM hosts WHERE n > 0),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM seen GROUP BY domain, suffix),
suffixes AS (SELECT suffix, 'all' AS root, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
base AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 1) / CAST(sum(n) + 2 AS DOUBLE) ELSE 0.5 END AS p FROM suffixes),
m0 AS ({_strength("suffixes", "root")}), m1 AS ({_strength("domains", "suffix")}), m2 AS ({_strength("seen", "domain")}),
s AS (SELECT suffix, (k + m * p) / (n + m) AS suffix_rate FROM suffixes, m0, base),
d AS (SELECT domain, (k + m * suffix_rate) / (n + m) AS domain_rate FROM domains JOIN s USING (suffix), m1),
rated AS (
    SELECT host, n, m, (k + m * coalesce(domain_rate, suffix_rate, p)) / (n + m) AS rate
    FROM hosts LEFT JOIN s USING (suffix) LEFT JOIN d USING (domain), m2, base)
SELECT page_id, host, path, {_rule(lambda h, p, v: h + p)} AS rule,
       coalesce({_rule(lambda h, p, v: v)},
                CASE WHEN rate + sqrt(rate * (1 - rate) / (n + m + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts JOIN rated USING (host)
"""

OP8 = f"""
WITH item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower("coalesce(text, '')")}, '{_PLAIN}') AS w
    FROM benchmark),
windows AS (
    SELECT item, len(w) AS size, array_to_string(w, ' ') AS pattern FROM item_words WHERE len(w) BETWEEN 1 AND 9
    UNION ALL
    SELECT item, 10, array_to_string(list_slice(w, i, i + 9), ' ')
    FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM item_words WHERE len(w) >= 10)),
patterns AS (SELECT DISTINCT * FROM windows),
sizes AS (SELECT DISTINCT size FROM patterns),
docs AS (
    SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_PLAIN}') AS w FROM documents),
places AS (
    SELECT doc_id, size, start, array_to_string(list_slice(w, start, start + size - 1), ' ') AS pattern
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS start FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, start, p.size, item FROM places JOIN patterns p USING (size, pattern)),
hit AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit
    FROM (SELECT doc_id, unnest(range(start, start + size)) AS word FROM found) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


OP9 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM pairs p JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
    WHERE 100 * common >= 85 * (a.n + b.n - common)),
reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


OP11 = r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
judged AS (
    SELECT doc_id, part,
           CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
           || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
    FROM texts JOIN firsts USING (t)),
marked AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
classes AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM judged LEFT JOIN marked USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
         JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (
    SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS own, left(filter_order, i - 1) AS earlier
    FROM orders, unnest(range(1, 6)) AS u(i)),
crossed AS (
    SELECT c.*, s.*, contains(fails, own) AS bad,
           length(translate(fails, earlier, '')) < length(fails) AS gone
    FROM classes c, steps s),
counted AS (
    SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT bad), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE bad AND NOT gone), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE bad AND gone), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE fails = own), 0) AS unique_fails,
           coalesce(sum(good) FILTER (WHERE bad AND NOT gone), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE bad AND NOT gone), 0) AS toxic_lost
    FROM crossed GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""


def _transitions() -> str:
    """Edits of a row as SQL rows: state, initial, next state, cost, letters; states: 0 nothing yet, 1 after s, 2 after u, 3 after a."""
    follows = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    rows = []
    for state in range(4):
        at, cost, letters = state, 0, ""
        for _ in range(3):
            role = "a" if at == 2 else "u"
            rows.append((state, "D", "", at, cost + 3, letters + "D"))
            rows.append((state, "R", "", follows[at, role], cost + 2, letters + "R"))
            rows += [(state, "K", i, follows[at, i], cost, letters + "K") for i in "sua" if (at, i) in follows]
            if at in (0, 3):
                rows.append((state, "end", "", at, cost, letters))
            at, cost, letters = follows[at, role], cost + 2, letters + "I"
    return ", ".join(f"({s}, '{e}', '{i}', {t}, {c}, '{x}')" for s, e, i, t, c, x in rows)


# the bits of a checksum, byte by byte
_CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR k IN range(8)]), "
    "lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)

OP12 = rf"""
WITH RECURSIVE edits(state, edit, initial, next, cost, letters) AS (VALUES {_transitions()}),
told AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
    FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM told WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           left(role, 1) AS initial, rtrim(text, {_BLANKS}) AS kept
    FROM damaged),
judged AS (
    SELECT *, kept = '' AS blank, kept <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier
    FROM placed),
faults AS (
    SELECT *, NOT blank AND NOT duplicate AND right(kept, 1) NOT IN ('.', '!', '?') AS truncated FROM judged),
counted AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
           count(*) FILTER (WHERE truncated) AS truncated,
           count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id),
-- the cheapest way to each state after each row, the least letters among equals
way AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS turns FROM counted
    UNION ALL
    SELECT conv_id, i, next AS state, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(turns, (cost, audit)) AS turns
    FROM (
        SELECT w.conv_id, f.i, e.next, w.cost + e.cost + CASE WHEN f.truncated AND e.edit <> 'D' THEN 1 ELSE 0 END AS cost,
               w.audit || e.letters AS audit,
               list_concat(
                   list_concat(w.turns, list_transform(
                       range(length(e.letters) - 1),
                       lambda k: CASE WHEN (w.state = 2) = (k % 2 = 0) THEN 'assistant:' ELSE 'user:' END)),
                   CASE e.edit WHEN 'K' THEN [f.role || ':' || f.text]
                        WHEN 'R' THEN [CASE e.next WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] ELSE [] END) AS turns
        FROM way w JOIN faults f ON f.conv_id = w.conv_id AND f.i = w.i + 1
             JOIN edits e ON e.state = w.state AND (e.edit = 'D' OR NOT (f.blank OR f.duplicate)
                             AND (e.edit = 'R' OR e.edit = 'K' AND e.initial = f.initial)) ) steps
    GROUP BY conv_id, i, next),
ended AS (
    SELECT w.conv_id, w.cost + e.cost AS cost, w.audit || e.letters AS audit,
           list_concat(w.turns, list_transform(range(length(e.letters)),
                       lambda k: CASE WHEN (w.state = 2) = (k % 2 = 0) THEN 'assistant:' ELSE 'user:' END)) AS turns
    FROM way w JOIN counted c ON c.conv_id = w.conv_id AND c.n = w.i JOIN edits e ON e.state = w.state AND e.edit = 'end'),
best AS (
    SELECT conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(turns, (cost, audit)) AS turns
    FROM ended GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted USING (conv_id) LEFT JOIN best USING (conv_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1,
        "op2_line_dedup": OP2,
        "op4_url_reputation": OP4,
        "op8_benchmark_decontamination": OP8,
        "op9_minhash_near_dedup": OP9,
        "op11_filter_audit": OP11,
        "op12_conversation_repair": OP12,
    }
