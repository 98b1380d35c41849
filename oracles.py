"""DuckDB statements that the registered queries are compared with."""

from __future__ import annotations

# White space as the JVM's Unicode class has it.
_WS = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Where template tokens end.
_D = r"""\s,!;:=|"''\[\](){}.\-+@#$%&"""


def _case(values: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _gsub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def _correction_rules() -> dict[str, object]:
    def tokens(s, change):
        return f"array_to_string(list_transform(regexp_extract_all({s}, '[^{_D}]+|[{_D}]'), lambda t: {change}), '')"

    def twice(s, old, new):
        once = f"replace({s}, '{old}', '{new}')"
        return f"replace({once}, '{old}', '{new}')"

    def joined(s):
        for joint in (":", "#", "/", "@", r"\."):
            s = _gsub(s, rf"<\*>({joint}<\*>)+", "<*>")
        return s

    return {
        "E1a_double_space": lambda s: _gsub(_gsub(s, f"^[{_WS}]+|[{_WS}]+$", ""), f"[{_WS}]+", " "),
        "E1b_digit_token": lambda s: tokens(s, r"CASE WHEN regexp_full_match(t, '\d+') THEN '<*>' ELSE t END"),
        "E1c_word_with_variable": lambda s: tokens(
            s, "CASE WHEN contains(t, '<*>') AND NOT contains(t, '/') THEN '<*>' ELSE t END"
        ),
        "E1d_dotted_consecutive": lambda s: _gsub(_gsub(s, r"<\*>(\.<\*>)+", "<*>"), r"(<\*>){2,}", "<*>"),
        "E1e_hash_wrapped": lambda s: twice(twice(s, " #<*># ", " <*> "), " #<*> ", " <*> "),
        "E1f_joined": joined,
        "E1g_quoted": lambda s: _gsub(
            twice(twice(s, ' "<*>" ', " <*> "), " ''<*>'' ", " <*> "), r"(<\*>){2,}", "<*>"
        ),
    }


def build(sentences: dict, templates: dict, wanted: list, keep_words: tuple) -> dict[str, str]:
    content = _case({
        k: "'" + s.replace("{K}", "' || k || '").replace("{U}", "' || user_id || '") + "'" for k, s in sentences.items()
    })
    template = _case({k: f"'{t}'" for k, t in templates.items()})
    order = _case({k: str(i) for i, k in enumerate(sentences)})
    lines = f"""
        ev AS (
            SELECT event_id AS LineId, event_type, user_id, regexp_extract(props, '[0-9]+') AS k,
                   substr(CAST(ts AS VARCHAR), 1, 19) AS tss
            FROM events),
        ln AS (
            SELECT *, {content} AS content, {template} AS template, {order} AS place,
                   tss || ' ' || upper(event_type) || ' svc' || (user_id % 5) || ': ' || {content} AS value
            FROM ev)"""
    w = f"WITH {lines} "
    words = r"regexp_extract_all({}, '\s+|\S+')"
    pair = f", pr AS (SELECT *, {words.format('template')} AS t, {words.format('content')} AS m FROM ln) "
    kinds = list(templates)
    other = _case({k: f"'{templates[kinds[(i + 1) % len(kinds)]]}'" for i, k in enumerate(kinds)})
    crossed = f""",
        be AS (SELECT LineId, content, 0 AS Pair, template AS beside FROM ln
               UNION ALL SELECT LineId, content, 1, {other} FROM ln
               UNION ALL SELECT LineId, content, 2, {other} || ' ' || template FROM ln),
        pr AS (SELECT *, {words.format('beside')} AS t, {words.format('content')} AS m FROM be) """
    position = "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = m[i] AND t[i] <> '<*>')) / len(t)"
    jaccard = "len(list_intersect(t, m)) / len(list_distinct(list_concat(t, m)))"

    def gram_ratio(n: int) -> str:
        """Shared n-grams of these pairs are unique and keep their order, so all of them match."""
        a, b = (
            f"list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i + {n - 1}], chr(1)))"
            for x in ("t", "m")
        )
        return f"2 * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"

    described = f"""
        l AS (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS pos
              FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
        m AS (SELECT doc_id * 4294967296 + pos - 1 AS id, regexp_extract_all(x[pos], '[^{_WS}]+') AS t FROM l),
        c AS (SELECT id, p, t[p] AS word FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS p FROM m)),
        f AS (SELECT p, word FROM c GROUP BY p, word HAVING count(*) > 20),
        d AS (SELECT id, list(CASE WHEN f.word IS NULL THEN '<*>' ELSE c.word END ORDER BY p) AS t
              FROM c LEFT JOIN f USING (p, word) GROUP BY id HAVING count(f.word) > 0),
        k AS (SELECT t, count(*) AS n, min(id) AS id, len(list_filter(t, lambda x: x <> '<*>')) AS constants
              FROM d GROUP BY t HAVING count(*) > 20)"""
    matches = "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = m[i] AND t[i] <> '<*>'))"
    fields = (
        "substr(tss, 1, 10) AS \"Date\", substr(tss, 12, 8) AS \"Time\", upper(event_type) AS \"Level\", "
        "'svc' || (user_id % 5) AS Component"
    )
    counts = (
        w + "SELECT substr(md5(template), 1, 8) AS EventId, template AS EventTemplate, count(*) AS Occurrences "
        "FROM ln GROUP BY ALL"
    )
    assigned = w + "SELECT LineId, substr(md5(template), 1, 8) AS EventId, template AS EventTemplate FROM ln"
    said = "'say \"' || event_type || '\", then <*>'"

    rough = r"""
        SELECT page_id, '  got  ' || regexp_replace(url, '[0-9]+', '<*>', 'g')
            || ' at 10.0.<*>.7:80 #<*># #<*> #<*># x' || page_id
            || ' "<*>" ''<*>'' "<*>" <*>#<*>@<*>:<*>/<*> v<*> 12 <*><*>.<*> n=' || page_id || ',5!' || chr(9) AS x
        FROM pages"""
    rules = _correction_rules()

    def staged(source: str, key: str) -> str:
        """All rules, one sub-query each, so that every stage is computed once."""
        query = source
        for rule in rules.values():
            query = f"SELECT {key}, {rule('x')} AS x FROM ({query})"
        return query

    url_tokens = r"regexp_extract_all(url, '[?=&.]|[^?=&.]+')"
    url_mask = "SELECT page_id, array_to_string({}, '|') AS tokens FROM (SELECT page_id, " + url_tokens + " AS t FROM pages)"
    specials = " + ".join(f"(CASE WHEN contains(x, '{c}') THEN 1 ELSE 0 END)" for c in "/:@#_")
    repeated = " OR ".join(f"length(x) - length(replace(x, '{c}', '')) >= 3" for c in "/:@#_")
    special = f"(({specials}) >= 2 OR {repeated})"
    mask = "list_transform(t, lambda x: CASE WHEN {} THEN '<*>' ELSE x END)"
    assignment = r"list_transform(t, lambda x, i: CASE WHEN i > 1 AND t[i - 1] = '=' AND regexp_matches(x, '^\w') THEN '<*>' ELSE x END)"

    punct = r"""!"#$%&''()+,\-/:;=?@.\[\\\]\^_`{|}~"""
    dropped = r"""[!"#$%&''+,\-/:;?@.\[\\\]\^_`{}~ ]"""

    def message_tokens(text: str) -> str:
        """Words of a message, as three nested lists: pieces, cleaned pieces, and without repeated wildcards."""
        pieces = rf"regexp_extract_all({text}, '[\s{punct}]+|[^\s{punct}]+')"
        cleaned = (
            f"list_filter(list_transform({pieces}, lambda p: CASE WHEN contains(p, '<*>') THEN '<*>' "
            f"ELSE regexp_replace(p, '{dropped}', '', 'g') END), lambda p: p <> '')"
        )
        return f"list_transform({cleaned}, lambda p: trim(p))"

    def collapse(words: str) -> str:
        return f"list_filter({words}, lambda p, i: NOT (p = '<*>' AND i > 1 AND {words}[i - 1] = '<*>'))"

    truth = """
        tr AS (SELECT event_id AS LineId,
                      CASE WHEN event_id % 97 <> 0 THEN event_type || ' ' || (user_id % 7) || ' <*>' END AS truth
               FROM events),
        pa AS (SELECT event_id AS LineId,
                      CASE WHEN event_type = 'signup' AND event_id % 89 = 0 THEN NULL
                           WHEN user_id % 7 = 3 THEN event_type || ' 3<*> <*>'
                           WHEN user_id % 7 >= 5 THEN event_type || ' 5 <*>'
                           WHEN event_type = 'view' AND user_id % 7 = 1 THEN 'view 1 ' || (event_id % 3) || ' <*>'
                           ELSE event_type || ' ' || (user_id % 7) || ' <*>' END AS parsed
               FROM events),
        va AS (SELECT LineId, truth, parsed FROM tr JOIN pa USING (LineId) WHERE truth IS NOT NULL),
        sz AS (SELECT parsed, count(*) AS size FROM va WHERE parsed IS NOT NULL GROUP BY parsed),
        gt AS (SELECT truth, count(*) AS n, count(DISTINCT parsed) AS kinds, max(parsed) AS parsed FROM va GROUP BY truth),
        ok AS (SELECT gt.* FROM gt JOIN sz USING (parsed) WHERE kinds = 1 AND n = size),
        pg AS (SELECT parsed, list(DISTINCT truth) AS labels FROM va WHERE parsed IS NOT NULL GROUP BY parsed)"""
    listed = "(" + ", ".join(f"'{t}'" for t in wanted) + ")"
    many = len(wanted)
    ga = """
        gm AS (SELECT (SELECT coalesce(sum(n), 0) FROM ok) / (SELECT count(*) FROM va) AS GA,
                      (SELECT count(*) FROM ok) / (SELECT count(*) FROM sz) AS PGA,
                      (SELECT count(*) FROM ok) / (SELECT count(*) FROM gt) AS RGA)"""
    fga = "CASE WHEN PGA <> 0 OR RGA <> 0 THEN 2 * (PGA * RGA) / (PGA + RGA) ELSE 0.0 END AS FGA"
    ta = """
        tm AS (SELECT (SELECT count(*) FROM pg) AS Identified, (SELECT count(*) FROM gt) AS GroundTruth,
                      (SELECT count(*) FROM pg WHERE labels = [parsed]) AS hits)"""
    ta_out = """
        tq AS (SELECT Identified, GroundTruth, hits / Identified AS PTA, hits / GroundTruth AS RTA FROM tm)"""
    fta = "CASE WHEN PTA <> 0 OR RTA <> 0 THEN 2 * (PTA * RTA) / (PTA + RTA) ELSE 0.0 END AS FTA"
    lenient = "array_to_string(list_transform(string_split(truth, ' '), lambda p: CASE WHEN contains(p, '<*>') THEN '<*>' ELSE p END), ' ') = parsed"

    def share(test: str, where: str = "true") -> str:
        return f"SELECT count(*) FILTER (WHERE {test}) / count(*) AS PA FROM va WHERE {where}"

    sql = {
        "A1_read_log_lines": w + "SELECT value FROM ln",
        "A2_line_id_physical": w + "SELECT row_number() OVER (ORDER BY LineId) AS LineId, value FROM ln",
        "A2_line_id_matched": w + "SELECT row_number() OVER (ORDER BY LineId) AS LineId, value FROM ln WHERE event_type = 'error'",
        "A4_parse_log_lines": w + f"SELECT LineId, {fields}, content AS Content FROM ln",
        "A4_optional_header": w + """
            SELECT LineId, CASE WHEN event_type = 'error' THEN 'sshd' ELSE 'kernel' END AS Component,
                   CASE WHEN event_type = 'error' THEN k END AS PID, value AS Content FROM ln""",
        "A5_load_log": w + f"""
            SELECT LineId // 500 AS FileNumber,
                   2 * row_number() OVER (PARTITION BY LineId // 500 ORDER BY LineId) - 1 AS LineId,
                   {fields}, regexp_replace(content || ' café ☃☃ naïve', '[^\\x00-\\x7F]+', '<N/ASCII>', 'g') AS Content
            FROM ln""",
        "A6_load_report": """
            SELECT count(*) AS LinesRead, count(*) FILTER (WHERE event_type = 'error') AS LinesLoaded,
                   count(*) FILTER (WHERE event_type <> 'error') AS LinesSkipped,
                   count(*) FILTER (WHERE event_type = 'error') / count(*) AS LoadingRate FROM events""",
        "A8_read_structured_csv": w + f"""
            SELECT LineId, 'say "' || event_type || '", then ' || k AS Content,
                   substr(md5(event_type), 1, 8) AS EventId, {said} AS EventTemplate FROM ln""",
        "A8_read_templates_csv": f"""
            SELECT DISTINCT substr(md5(event_type), 1, 8) AS EventId, {said} AS EventTemplate FROM events""",
        "A9_write_structured": w + "SELECT LineId, '[\"' || k || '\"]' AS ParameterList, k AS \"First\" FROM ln",
        "A10_write_templates": f"""
            SELECT substr(md5({said}), 1, 8) AS EventId, {said} AS EventTemplate, count(*) AS Occurrences
            FROM events GROUP BY ALL""",
        "A11_correct_templates_batch": f"""
            SELECT Dataset, x AS EventTemplate FROM ({staged(rough, 'page_id')}), (VALUES ('HDFS'), ('Apache')) v(Dataset)""",
        "A12_read_messages": w + "SELECT value AS message FROM ln UNION ALL SELECT value FROM ln",
        "B1_mask_patterns": w + r"""
            SELECT LineId, regexp_replace(regexp_replace(regexp_replace(value, '\d{2}:\d{2}:\d{2}', '<*>', 'g'),
                   'svc\d', '<*>', 'g'), '(\d+-)+\d+', '<*>', 'g') AS masked FROM ln""",
        "B2_tokenize": r"""
            SELECT page_id, array_to_string(t, '|') AS tokens, len(t) AS n_tokens
            FROM (SELECT page_id, regexp_extract_all(url, '[/?=&#]|[^/?=&#]+') AS t FROM pages)""",
        "B2_tokenize_documents": r"""
            SELECT doc_id, pos - 1 AS pos, array_to_string(t, '|') AS tokens, len(t) AS n_tokens
            FROM (SELECT doc_id, pos, regexp_extract_all(lines[pos], '[^ ,.]+') AS t
                  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
                        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))""",
        "B3_mask_assignment": url_mask.format(assignment),
        "B4_mask_user": w + """
            SELECT LineId, 'for| |user| |<*>| |from| |User| |(root)| |then| |user| |in| |' || event_type
                   || '| |USER| |<*>' AS tokens FROM ln""",
        "B5_mask_leading_digit": url_mask.format(mask.format(r"regexp_matches(x, '^\d')")),
        "B6_mask_special_chars": url_mask.format(mask.format(special)),
        "B7_mask_path_dash": url_mask.format(mask.format("contains(x, '/') OR contains(x, '-')")),
        "B8_preprocess": rf"""
            WITH a AS (SELECT page_id, regexp_replace('GET = 7up [a_b] ' || url || ' size=' || page_id,
                              'example\.\w+', '<*>', 'g') AS s FROM pages),
                 b AS (SELECT page_id, regexp_extract_all(s, '\s+|[=\[\]]|[^\s=\[\]]+') AS t FROM a),
                 c AS (SELECT page_id, {assignment} AS t FROM b),
                 d AS (SELECT page_id, {mask.format(rf"regexp_matches(x, '^\d') OR {special} OR contains(x, '/') OR contains(x, '-')")} AS t FROM c)
            SELECT page_id, array_to_string(t, '|') AS tokens, len(t) AS NTokens FROM d""",
        "C1_position_similarity": w + crossed + f"""
            SELECT LineId, Pair, {position} AS similarity, len(list_filter(t, lambda x: x = '<*>')) AS wildcards FROM pr""",
        "C2_ngram_similarity": w + crossed + f"SELECT LineId, Pair, {gram_ratio(2)} AS similarity FROM pr",
        "C3_jaccard_similarity": w + crossed + f"SELECT LineId, Pair, {jaccard} AS similarity FROM pr",
        "C4_combined_similarity": w + crossed + f"""
            SELECT LineId, Pair, greatest({position}, {jaccard}, {gram_ratio(3)}) AS similarity FROM pr""",
        "C5_message_tokens": f"""
            WITH a AS (SELECT page_id, {message_tokens("regexp_replace(url, '[0-9]+', '<*>', 'g') || ' <*> (<*>) a|b ''c'''")} AS c FROM pages),
                 b AS (SELECT page_id, {collapse('c')} AS t FROM a)
            SELECT page_id, array_to_string(t, '|') AS tokens, len(t) AS n_tokens FROM b""",
        "C6_template_similarity": w + crossed + f""",
            a AS (SELECT LineId, Pair, {message_tokens('beside')} AS c1, {message_tokens('content')} AS c2 FROM be),
            b AS (SELECT LineId, Pair, {collapse('c1')} AS x, {collapse('c2')} AS y FROM a),
            c AS (SELECT LineId, Pair, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS s FROM b)
            SELECT LineId, Pair, s / (nx + ny - s) AS similarity FROM c""",
        "C7_event_id": "SELECT doc_id, substr(md5(text), 1, 8) AS event_id FROM documents",
        "C8_render_template": w + "SELECT LineId, content AS text FROM ln",
        "C9_lenient_template_equal": w + "SELECT LineId, true AS loose_truth, event_type <> 'view' AS loose_parsed FROM ln",
        "C10_convert_date": w + "SELECT LineId, strftime(CAST(substr(tss, 1, 10) AS DATE), '%d/%m/%Y') AS date FROM ln",
        "D2_mine_sequential": assigned,
        "D3_mine_leader": counts,
        "D3_mine_leader_jaccard": counts,
        "D3_mine_leader_combined": counts,
        "D4_merge_template": w + """
            SELECT template AS EventTemplate, count(*) AS n, max(LineId) AS "Last" FROM ln GROUP BY template""",
        "D5_assign_templates": assigned,
        "D6_template_counts": f"""
            SELECT substr(md5({said}), 1, 8) AS EventId, {said} AS EventTemplate, count(*) AS Occurrences
            FROM events GROUP BY ALL""",
        "D7_extract_parameters": w + """
            SELECT LineId, CASE WHEN event_type IN ('view', 'click') THEN k || '|' || user_id ELSE user_id || '|' || k END
                   AS parameters, 2 AS n FROM ln""",
        "D7_extract_parameters_documents": rf"""
            WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
                 m AS (SELECT (doc_id << 32) + i - 1 AS LineId, lines[i] AS c, regexp_extract_all(lines[i], '[^{_WS}]+') AS t
                       FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)),
                 p AS (SELECT LineId, c, array_to_string(list_transform(range(1, len(t) + 1),
                              lambda i: CASE WHEN (i - 1) % (len(t) // 8 + 1) = len(t) // 8 THEN '<*>' ELSE t[i] END), ' ') AS tpl FROM m),
                 q AS (SELECT LineId, c, string_split(regexp_replace(tpl, '<.{{1,5}}>', '<*>', 'g'), '<*>') AS parts FROM p),
                 r AS (SELECT LineId, c, len(parts) - 1 AS n,
                              '^' || array_to_string(list_transform(parts, lambda x: replace(
                                  regexp_replace(x, '([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e])', '\\\1', 'g'), ' ', '[{_WS}]+')), '(.*?)') || '$' AS pattern FROM q)
            SELECT LineId, CAST(CASE WHEN n > 0 AND regexp_matches(c, pattern) THEN n ELSE 0 END AS INTEGER) AS n,
                   md5(CASE WHEN n > 0 AND regexp_matches(c, pattern)
                       THEN regexp_replace(c, pattern, left('\1|\2|\3|\4|\5|\6|\7|\8|\9', 3 * n - 1)) ELSE '' END) AS parameters
            FROM r""",
        "D7_adjacent_wildcards": w + """
            SELECT 'collapsed' AS Mode, LineId, k || ' ' || event_type AS parameters FROM ln
            UNION ALL SELECT 'separate', LineId, k || '|' || event_type FROM ln""",
        "D8_parse_files": w + """
            SELECT LineId // 500 AS FileNumber,
                   2 * row_number() OVER (PARTITION BY LineId // 500 ORDER BY LineId) - 1 AS LineId,
                   content AS Content, substr(md5(template), 1, 8) AS EventId, template AS EventTemplate,
                   CASE WHEN event_type IN ('view', 'click') THEN k || '|' || user_id ELSE user_id || '|' || k END
                   AS ParameterList FROM ln""",
        "D8_parse_logs": w + f"""
            SELECT LineId, {fields}, content AS Content, substr(md5(template), 1, 8) AS EventId, template AS EventTemplate,
                   CASE WHEN event_type IN ('view', 'click') THEN k || '|' || user_id ELSE user_id || '|' || k END
                   AS ParameterList FROM ln""",
        "D9_match_templates": w + pair + f"SELECT LineId, place AS ClusterId, {matches} / len(t) AS Score FROM pr",
        "E1_correct_template": f"SELECT page_id, x AS template FROM ({staged(rough, 'page_id')})",
        "E1_correct_documents": f"""
            SELECT doc_id, md5(x) AS digest FROM ({staged('SELECT doc_id, text AS x FROM documents', 'doc_id')})""",
        "E2_correct_templates": f"SELECT page_id, x AS EventTemplate FROM ({staged(rough, 'page_id')})",
        "F1_valid_rows": f"WITH {truth} SELECT LineId, truth AS Truth, parsed AS Parsed FROM va",
        "F2_grouping_accuracy": f"WITH {truth}, {ga} SELECT GA FROM gm",
        "F3_pga_rga_fga": f"WITH {truth}, {ga} SELECT PGA, RGA, {fga} FROM gm",
        "F4_template_accuracy": f"WITH {truth}, {ta}, {ta_out} SELECT *, {fta} FROM tq",
        "F5_parsing_accuracy": f"WITH {truth} {share('truth = parsed')}",
        "F6_parsing_accuracy_lenient": f"WITH {truth} {share(lenient)}",
        "F7_exact_match_accuracy": f"""
            WITH {truth} SELECT count(*) FILTER (WHERE truth = coalesce(parsed, 'nan')) / count(*) AS ExactMatch FROM va""",
        "F8_filtered_grouping": f"""
            WITH {truth},
                 gm AS (SELECT (SELECT coalesce(sum(n), 0) FROM ok WHERE truth IN {listed})
                               / (SELECT count(*) FROM va WHERE truth IN {listed}) AS GA,
                               (SELECT count(*) FROM ok WHERE truth IN {listed})
                               / (SELECT count(DISTINCT parsed) FROM va WHERE truth IN {listed}) AS PGA,
                               (SELECT count(*) FROM ok WHERE truth IN {listed}) / {many} AS RGA)
            SELECT GA, PGA, RGA, {fga} FROM gm""",
        "F8_filtered_template": f"""
            WITH {truth},
                 tm AS (SELECT (SELECT count(DISTINCT parsed) FROM va WHERE truth IN {listed}) AS Identified,
                               {many} AS GroundTruth,
                               (SELECT count(*) FROM pg WHERE labels = [parsed] AND parsed IN {listed}) AS hits),
                 {ta_out} SELECT *, {fta} FROM tq""",
        "F8_filtered_parsing": f"WITH {truth} {share('truth = parsed', f'truth IN {listed}')}",
        "F8_filtered_lenient": f"WITH {truth} {share(lenient, f'truth IN {listed}')}",
        "F9_evaluate": f"""
            WITH {truth}, {ga}, {ta}, {ta_out}
            SELECT GA, {fga}, {fta}, PTA, RTA FROM gm, tq""",
        "F10_evaluate_full": f"""
            WITH {truth}, {ga}, {ta}, {ta_out}, le AS ({share(lenient)})
            SELECT GA, PA, {fga}, {fta}, PTA, RTA FROM gm, tq, le""",
        "F11_benchmark_suite": """
            WITH g AS (SELECT round(count(*) FILTER (WHERE event_type NOT IN ('view', 'error')) / count(*), 3) AS x FROM events),
                 r AS (SELECT 'labelled' AS Dataset, 1.0::DOUBLE AS GA, 1.0::DOUBLE AS FGA, 1.0::DOUBLE AS FTA,
                              1.0::DOUBLE AS PTA, 1.0::DOUBLE AS RTA
                       UNION ALL
                       SELECT 'mislabelled', x, round(2 * 0.6 * 0.75 / 1.35, 3), round(2 * 0.8 / 1.8, 3), 0.8, 1.0 FROM g)
            SELECT * FROM r
            UNION ALL SELECT 'Average', round(avg(GA), 3), round(avg(FGA), 3), round(avg(FTA), 3), round(avg(PTA), 3),
                             round(avg(RTA), 3) FROM r""",
        "G1_mine_stream": assigned,
        "G1_mine_stream_state": w + "SELECT LineId, template AS Template FROM ln",
        "G2_template_counts_stream": """
            SELECT substr(md5(event_type), 1, 8) AS EventId, event_type AS EventTemplate, count(*) AS Occurrences
            FROM events GROUP BY ALL""",
        "H1_mine_slct": counts,
        "H1_mine_slct_documents": f"""
            WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
                 m AS (SELECT row_number() OVER () AS id, regexp_extract_all(line, '[^{_WS}]+') AS t FROM l),
                 c AS (SELECT id, p, t[p] AS word FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS p FROM m)),
                 f AS (SELECT p, word FROM c GROUP BY p, word HAVING count(*) > 20),
                 d AS (SELECT id, string_agg(CASE WHEN f.word IS NULL THEN '<*>' ELSE c.word END, ' ' ORDER BY p) AS tpl
                       FROM c LEFT JOIN f USING (p, word) GROUP BY id HAVING count(f.word) > 0)
            SELECT substr(md5(tpl), 1, 8) AS EventId, tpl AS EventTemplate, count(*) AS Occurrences
            FROM d GROUP BY tpl HAVING count(*) > 20""",
        "H1_slct_combined": f"""
            WITH {described},
                 b AS (SELECT a.n, g.t, row_number() OVER (PARTITION BY a.id ORDER BY g.constants, g.n DESC, g.id) AS place
                       FROM k a JOIN k g ON len(a.t) = len(g.t) AND len(list_filter(range(1, len(a.t) + 1),
                            lambda i: g.t[i] <> '<*>' AND g.t[i] <> a.t[i])) = 0),
                 o AS (SELECT array_to_string(t, ' ') AS tpl, n FROM b WHERE place = 1)
            SELECT substr(md5(tpl), 1, 8) AS EventId, tpl AS EventTemplate, CAST(sum(n) AS BIGINT) AS Occurrences
            FROM o GROUP BY tpl""",
        "H1_slct_outliers": f"""
            WITH {described} SELECT id AS LineId FROM m WHERE id NOT IN (SELECT d.id FROM d JOIN k USING (t))""",
        "H2_mine_iplom": counts,
        "H3_mine_drain": counts,
        "H4_mine_spell": counts,
    }
    for name, rule in rules.items():
        sql[name] = f"SELECT page_id, {rule('x')} AS template FROM ({rough})"
    return sql
