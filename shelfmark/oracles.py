"""The same queries as SQL for DuckDB, over views of the same tables."""

from __future__ import annotations

import re

from shelfmark.fixed import CONCEPTS, DEFAULT_ROUTE, PIPELINE_CUES, QUESTION_CUES, ROUTES, STOP_WORDS

ENTRIES = """entries AS (
  SELECT *, type || ':' || name AS id, type || ' ' || lower(name) AS ord, visibility <> 'ready' AS excluded FROM (
    SELECT d.doc_id, d.lang || (d.doc_id // 12) || '-' || d.doc_id AS name,
           CASE d.doc_id % 20 WHEN 0 THEN 'mcp' WHEN 1 THEN 'connector' WHEN 2 THEN 'agent' ELSE 'skill' END AS type,
           text AS description, list_slice(regexp_extract_all(lower(text), '[a-z]{5,}'), 1, 3) AS triggers, source, text AS full_text,
           n_chars > 1500 AS has_references, CASE WHEN toxic = 1 THEN 'blocked' WHEN toxic IS NULL THEN 'off-list' ELSE 'ready' END AS visibility, quality = 1 AS agent_bound
    FROM documents d LEFT JOIN labels l USING (doc_id)))"""
QUERIES = "queries AS (SELECT item_id AS qid, text AS query FROM benchmark)"
EVENTS = """hits AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'chat' WHEN 'signup' THEN 'pipeline' WHEN 'purchase' THEN 'adopt' ELSE 'search' END AS kind,
  'q' || (user_id % 37) AS query, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS n_hits, 'k' || json_extract_string(props, '$.k') AS skill, user_id, value FROM events)"""
DEPENDENCIES = "deps AS (SELECT a.id AS source, b.id AS target, 'depends_on' AS type, 'directed' AS direction, CAST(0.8 AS DOUBLE) AS weight FROM entries a JOIN entries b ON b.doc_id = a.doc_id // 3 WHERE a.doc_id > 0)"
NAMESPACE = "nsp AS (SELECT *, lower(regexp_split_to_array(name, '[-_.]')[1]) AS ns FROM entries WHERE len(regexp_split_to_array(name, '[-_.]')) >= 2 AND len(regexp_split_to_array(name, '[-_.]')[1]) >= 3)"
FAMILY = f"""{NAMESPACE}, fam AS (SELECT ns, count(*) AS n, min(id) AS root FROM nsp GROUP BY ns HAVING count(*) BETWEEN 2 AND 40),
family AS (SELECT a.id AS source, b.id AS target FROM nsp a JOIN nsp b ON a.ns = b.ns AND a.id < b.id JOIN fam f ON f.ns = a.ns WHERE f.n <= 6
  UNION ALL SELECT f.root, a.id FROM nsp a JOIN fam f ON f.ns = a.ns WHERE f.n > 6 AND a.id <> f.root)"""
CONTAINS = """csk AS (SELECT * FROM nsp WHERE type = 'skill'),
croot AS (SELECT ns, arg_min(id, (len(name), ord)) AS s FROM csk GROUP BY ns HAVING count(*) >= 2),
cexact AS (SELECT lower(name) AS ns, arg_max(id, ord) AS e FROM entries WHERE type = 'skill' GROUP BY 1),
contains_e AS (SELECT DISTINCT coalesce(x.e, r.s) AS source, c.id AS target FROM csk c JOIN croot r ON r.ns = c.ns LEFT JOIN cexact x ON x.ns = c.ns WHERE c.id <> coalesce(x.e, r.s))"""
GRAPH = f"""{ENTRIES}, {DEPENDENCIES}, {FAMILY}, {CONTAINS},
edges AS (SELECT source, target, 'family' AS type, CAST(1.0 AS DOUBLE) AS weight FROM family UNION ALL SELECT source, target, 'contains', CAST(0.7 AS DOUBLE) FROM contains_e UNION ALL SELECT source, target, type, weight FROM deps),
ways AS (SELECT source AS node, target AS other, type, weight FROM edges UNION ALL SELECT target, source, type, weight FROM edges)"""


def terms(text: str) -> str:
    """Distinct terms of a text expression; CJK runs give two- and three-grams."""
    low = f"lower(coalesce({text}, ''))"
    grams = f"flatten(list_transform(regexp_extract_all({low}, '[一-鿿]+'), lambda r: list_concat(list_transform(range(1, greatest(len(r), 1)), lambda i: substr(r, i, 2)), list_transform(range(1, greatest(len(r) - 1, 1)), lambda i: substr(r, i, 3)))))"
    return f"list_distinct(list_concat(regexp_extract_all({low}, '[a-z0-9]{{2,}}'), {grams}))"


def latin(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]{{2,}}'))"


ALL_TEXT = "name || ' ' || description || ' ' || array_to_string(triggers, ' ')"
ENTRY_TERMS = f"et AS (SELECT id, unnest({latin(ALL_TEXT)}) AS term FROM entries)"
SCORED = f"""{ENTRIES}, {QUERIES}, pool AS (SELECT * FROM entries WHERE NOT excluded), n AS (SELECT count(*) AS n FROM pool),
raw AS (SELECT id, unnest({latin('name')}) AS term, 0 AS loc FROM pool UNION ALL SELECT id, unnest({latin("array_to_string(triggers, ' ')")}), 1 FROM pool UNION ALL SELECT id, unnest({latin('description')}), 2 FROM pool),
post AS (SELECT id, term, min(loc) AS loc FROM raw GROUP BY id, term),
idf AS (SELECT term, greatest(0.1, 1.0 + (n - count(*) + 0.5) / (count(*) + 0.5))::DOUBLE AS idf FROM post, n GROUP BY term, n),
qt AS (SELECT *, instr(low, term) AS pos FROM (SELECT qid, lower(query) AS low, unnest({latin('query')}) AS term FROM queries)),
cov AS (SELECT a.qid, a.term, b.term AS o FROM qt a JOIN qt b ON a.qid = b.qid AND a.term <> b.term AND (contains(b.term, a.term) OR (a.pos > 0 AND b.pos > 0 AND (len(b.term) > len(a.term) OR (len(b.term) = len(a.term) AND b.term < a.term))
  AND 2 * (least(a.pos + len(a.term), b.pos + len(b.term)) - greatest(a.pos, b.pos)) > least(len(a.term), len(b.term))))),
ov AS (SELECT qid, id, term, loc, idf FROM qt JOIN post USING (term) JOIN idf USING (term)),
hid AS (SELECT DISTINCT x.qid, x.id, x.term FROM ov x JOIN cov c ON c.qid = x.qid AND c.term = x.term JOIN ov y ON y.qid = x.qid AND y.id = x.id AND y.term = c.o),
mx AS (SELECT ov.* FROM ov ANTI JOIN hid USING (qid, id, term)),
ev AS (SELECT qid, id, sum(least(idf, 25.0) * CASE loc WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.5 END)::DOUBLE AS ev, string_agg(term, ' ' ORDER BY term) AS evidence FROM mx GROUP BY qid, id),
nb AS (SELECT qid, id, max(CASE WHEN loc = 0 THEN idf END) AS nm FROM ov GROUP BY qid, id),
scored AS (SELECT qid, name, ord, round(ev + CASE WHEN nm IS NULL THEN 0 ELSE least(nm, 25.0) * 2 END + CASE WHEN has_references THEN 0.5 ELSE 0 END, 6)::DOUBLE AS score, round(ev, 6)::DOUBLE AS ev, evidence
  FROM nb LEFT JOIN ev USING (qid, id) JOIN pool USING (id), n WHERE ev >= 6.0 * least(1.0, n / 200.0) OR nm IS NOT NULL)"""
TOP = f"""{SCORED}, cut AS (SELECT *, max(ev) OVER (PARTITION BY qid) AS most FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM cut WHERE score >= greatest(0.35, 0.25 * most)),
top AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM ranked WHERE rank <= 8)"""
OVERLAP = f"""{ENTRIES}, sk AS (SELECT * FROM entries WHERE type = 'skill'), st AS (SELECT id, unnest({latin(ALL_TEXT)}) AS term FROM sk),
sdf AS (SELECT term FROM st GROUP BY term HAVING count(*) BETWEEN 2 AND 40), rare AS (SELECT * FROM st JOIN sdf USING (term)),
cand AS (SELECT a.id AS u, b.id AS v, count(*) AS shared FROM rare a JOIN rare b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2),
sz AS (SELECT id, list(term) AS t FROM st GROUP BY id),
jac AS (SELECT u, v, shared, shared::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS j FROM cand JOIN sz a ON a.id = u JOIN sz b ON b.id = v),
over AS (SELECT u, v, shared, round_even(j, 3)::DOUBLE AS weight FROM jac WHERE j >= 0.12)"""
FILES = "files AS (SELECT source AS skill, source || '/' || doc_id || '.txt' AS file, string_split(text, chr(10)) AS lines FROM documents)"
PLAIN = f"""{FILES}, w AS (SELECT skill, file, lines, unnest(range(0, CASE WHEN len(lines) <= 50 THEN 1 ELSE CAST(ceil((len(lines) - 50) / 45.0) AS BIGINT) + 1 END)) AS w FROM files WHERE len(list_filter(lines, lambda x: trim(x) <> '')) > 0),
cut AS (SELECT skill, file, lines, CAST(w * 45 + 1 AS INT) AS s, CAST(least(w * 45 + 50, len(lines)) AS INT) AS e FROM w),
chunks AS (SELECT skill, file, s, e, substr(coalesce(list_filter(list_transform(lines[s:e], lambda x: trim(x)), lambda x: x <> '')[1], ''), 1, 80) AS summary, array_to_string(lines[s:e], chr(10)) AS text FROM cut)"""
CHUNK_TERMS = f"ct AS (SELECT skill, file, s, e, unnest({latin('''summary || ' ' || file || ' ' || skill || ' ' || text''')}) AS term FROM chunks)"
DENSE = """name || '[' || CASE type WHEN 'skill' THEN 's' WHEN 'agent' THEN 'a' WHEN 'connector' THEN 'c' ELSE 'm' END || CASE WHEN has_references THEN 'R' ELSE '' END || ']: '
  || CASE WHEN len(one) > 400 THEN substr(one, 1, 400) || '…' ELSE one END || CASE WHEN len(triggers) > 0 THEN ' | 触发: ' || array_to_string(list_slice(triggers, 1, 8), '、') ELSE '' END"""
LINES = f"{ENTRIES}, one AS (SELECT *, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS one FROM entries WHERE NOT excluded), dense AS (SELECT *, {DENSE} AS line FROM one)"
QUESTIONS = "questions(n, question) AS (VALUES (1, '如何 重算 excel 公式'), (2, '帮我写一个周报'), (3, '为什么 pipeline 失败'), (4, 'code review')), asked AS (SELECT item_id AS qid, question || ' ' || text AS query FROM benchmark JOIN questions ON n = item_id % 4 + 1)"
PAIRS = ", ".join(f"('{zh}', '{en}')" for zh, ens in CONCEPTS.items() for en in ens)
STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

ORACLES: dict[str, str] = {
    "catalog_entries": f"WITH {ENTRIES} SELECT id, name, type, visibility, excluded, has_references, agent_bound, CAST(len(description) AS INT) AS description_chars, array_to_string(triggers, '|') AS triggers FROM entries",
    "catalog_list_ready": f"WITH {ENTRIES} SELECT name, type, visibility FROM entries WHERE type = 'skill' AND visibility = 'ready' AND has_references",
    "catalog_lookup": f"WITH {ENTRIES} SELECT id, name, type, visibility FROM entries WHERE doc_id % 50 = 7",
    "pool_truth_flags": f"""WITH {ENTRIES} SELECT 'default' AS flag, name FROM entries WHERE NOT excluded UNION ALL SELECT 'off_list', name FROM entries WHERE NOT excluded OR visibility = 'off-list'
      UNION ALL SELECT 'agent_only', name FROM entries WHERE NOT excluded AND agent_bound IS DISTINCT FROM false UNION ALL SELECT 'all', name FROM entries""",
    "exclude_glob": f"WITH {ENTRIES} SELECT name, reason FROM (SELECT name, CASE WHEN lower(name) GLOB 'en1*' THEN 'first' WHEN lower(name) GLOB '*-?7' THEN 'second' WHEN lower(name) GLOB '[fd]?2*' THEN 'third' END AS reason FROM entries) WHERE reason IS NOT NULL",
    "terms_explode": f"WITH {ENTRIES}, {ENTRY_TERMS} SELECT id, term FROM et",
    "term_df": f"WITH {ENTRIES}, {ENTRY_TERMS} SELECT term, count(*) AS df FROM et GROUP BY term",
    "term_idf": f"WITH {ENTRIES}, {ENTRY_TERMS}, n AS (SELECT count(*) AS n FROM entries WHERE NOT excluded) SELECT term, round(greatest(0.1, 1.0 + (n - count(*) + 0.5) / (count(*) + 0.5))::DOUBLE, 6) AS idf FROM et JOIN entries USING (id), n WHERE NOT excluded GROUP BY term, n",
    "stop_terms": f"WITH {QUESTIONS} SELECT qid, term FROM (SELECT qid, unnest({terms('query')}) AS term FROM asked) WHERE len(list_filter({STOPS}, lambda s: contains(term, s))) = 0",
    "bridge_terms": f"WITH {QUESTIONS}, t AS (SELECT qid, unnest({terms('query')}) AS term FROM asked), p(zh, en) AS (VALUES {PAIRS}) SELECT qid, term FROM t UNION SELECT qid, en FROM t JOIN p ON zh = term UNION SELECT qid, zh FROM t JOIN p ON en = term",
    "gap_notice": f"""WITH {ENTRIES}, gaps(n, question, found) AS (VALUES (1, '代码审查', ['decision', 'review']), (2, '代码审查', ['代码']), (3, 'code review', ['code']), (4, '合同管理', ['合同双']), (5, '合同', CAST([] AS VARCHAR[]))),
      g AS (SELECT id, list_filter({terms("question || ' ' || array_to_string(triggers, ' ')")}, lambda t: regexp_matches(t, '[一-鿿]')) AS cjk, list_concat(found, CASE WHEN n = 5 THEN [] ELSE triggers END) AS ev FROM entries JOIN gaps ON n = doc_id % 5 + 1)
      SELECT id, len(cjk) > 0 AND len(ev) > 0 AND len(list_filter(cjk, lambda t: len(list_filter(ev, lambda e: contains(e, t) OR contains(t, e))) > 0)) = 0 AS gap FROM g""",
    "list_mirror": f"""WITH {ENTRIES}, i AS (SELECT doc_id, source || substr('/:?', CAST(doc_id % 3 + 1 AS BIGINT), 1) || (doc_id // 9) AS name, source || '_' || (doc_id // 9) AS safe, has_references AND length(trim(full_text)) > 40 AS whole FROM entries),
      r AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY doc_id) AS n FROM i)
      SELECT CASE WHEN n = 1 THEN safe ELSE safe || '-' || n END AS dirname, name, NOT whole AS stub, CASE WHEN doc_id % 4 = 0 THEN 'updated' ELSE 'kept' END AS change FROM r""",
    "search_candidates": f"WITH {SCORED} SELECT qid, name, count(*) AS n_terms, CAST(min(loc) AS INT) AS best_place FROM ov JOIN pool USING (id) GROUP BY qid, name",
    "search_evidence": f"WITH {SCORED} SELECT qid, name, score, ev, evidence FROM scored",
    "search_topk": f"WITH {TOP} SELECT qid, CAST(rank AS INT) AS rank, name, score FROM top",
    "search_ties": f"WITH {TOP} SELECT qid, CAST(rank AS INT) AS rank, name FROM (SELECT *, count(*) FILTER (score >= 0.95 * best) OVER (PARTITION BY qid) AS g FROM top) WHERE g >= 2 AND score >= 0.95 * best AND rank <= 4",
    "single_char_search": f"""WITH {ENTRIES}, q(qid, raw) AS (VALUES (CAST(1 AS BIGINT), 'q'), (2, 'z'), (3, '7')),
      s AS (SELECT qid, name, CASE WHEN contains(lower(name), raw) THEN 6.0 WHEN contains(lower(array_to_string(triggers, ' ')), raw) THEN 3.0 WHEN contains(lower(description), raw) THEN 1.5 END::DOUBLE AS score FROM entries, q WHERE NOT excluded)
      SELECT qid, CAST(rank AS INT) AS rank, name, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, lower(name)) AS rank FROM s WHERE score IS NOT NULL) WHERE rank <= 8""",
    "name_twins": f"""WITH {ENTRIES}, e AS (SELECT name, ord, excluded FROM entries UNION ALL SELECT string_split(name, '-')[1], type || ' ' || lower(string_split(name, '-')[1]), excluded FROM entries WHERE doc_id % 12 = 0),
      p AS (SELECT a.name AS name, b.name AS twin, b.ord FROM e a JOIN e b ON (starts_with(lower(b.name), lower(a.name) || '-') OR starts_with(lower(a.name), lower(b.name) || '-')) WHERE NOT b.excluded)
      SELECT name, twin FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS n FROM p) WHERE n <= 3""",
    "overlap_candidates": f"WITH {OVERLAP} SELECT u, v, shared, weight FROM over",
    "family_edges": f"WITH {ENTRIES}, {FAMILY} SELECT source, target, 'family' AS type, 'undirected' AS direction, CAST(1.0 AS DOUBLE) AS weight FROM family",
    "contains_edges": f"WITH {ENTRIES}, {FAMILY}, {CONTAINS} SELECT source, target, 'contains' AS type, 'directed' AS direction, CAST(0.7 AS DOUBLE) AS weight FROM contains_e",
    "name_refs": f"""WITH {ENTRIES}, r AS (SELECT a.id AS source, lower('uses ' || b.name || CASE WHEN a.doc_id % 3 = 0 THEN 'x' ELSE '' END || '. ' || a.description || ' ' || array_to_string(a.triggers, ' ')) AS body, a.type FROM entries a JOIN entries b ON b.doc_id = a.doc_id // 2),
      w AS (SELECT DISTINCT source, unnest(regexp_extract_all(body, '[a-z0-9_-]+')) AS low FROM r WHERE type = 'skill')
      SELECT DISTINCT w.source, e.id AS target FROM w JOIN entries e ON lower(e.name) = w.low WHERE e.type IN ('skill', 'mcp') AND e.id <> w.source""",
    "similar_pairs": f"""WITH {ENTRIES}, p AS (SELECT name AS skill, unnest({latin('description')}) AS term FROM entries), n AS (SELECT count(DISTINCT skill) AS n FROM p), f AS (SELECT term, count(*) AS df FROM p GROUP BY term HAVING count(*) BETWEEN 2 AND 40),
      r AS (SELECT skill, term, greatest(0.1, 1.0 + (n - df + 0.5) / (df + 0.5))::DOUBLE AS idf FROM p JOIN f USING (term), n), t AS (SELECT skill, sum(idf) AS w FROM r GROUP BY skill)
      SELECT u, v, shared, round(s / (a.w + b.w - s), 6) AS weight FROM (SELECT x.skill AS u, y.skill AS v, count(*) AS shared, sum(x.idf) AS s FROM r x JOIN r y ON x.term = y.term AND x.skill < y.skill GROUP BY 1, 2 HAVING count(*) >= 3) JOIN t a ON a.skill = u JOIN t b ON b.skill = v""",
    "related_top5": f"""WITH {GRAPH}, b AS (SELECT w.*, e.ord, row_number() OVER (PARTITION BY node, other ORDER BY weight DESC, w.type) AS r FROM ways w JOIN entries e ON e.id = other WHERE NOT e.excluded)
      SELECT node, CAST(rank AS INT) AS rank, other, type, weight FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, ord) AS rank FROM b WHERE r = 1) WHERE rank <= 5""",
    "one_hop": f"WITH {GRAPH} SELECT node, other, w.type, weight, name FROM ways w LEFT JOIN entries e ON e.id = other",
    "impact_two_hop": f"WITH {ENTRIES}, {DEPENDENCIES} SELECT target AS node, source AS dependent, 1 AS level FROM deps UNION ALL SELECT * FROM (SELECT DISTINCT a.target, b.source, 2 FROM deps a JOIN deps b ON b.target = a.source WHERE a.target <> b.source AND NOT EXISTS (SELECT 1 FROM deps c WHERE c.target = a.target AND c.source = b.source))",
    "graph_degree": f"WITH {GRAPH} SELECT node, count(*) AS degree FROM ways GROUP BY node",
    "graph_isolated": f"WITH {ENTRIES}, {FAMILY} SELECT id FROM entries WHERE id NOT IN (SELECT source FROM family UNION SELECT target FROM family)",
    "graph_hubs": f"WITH {GRAPH}, m AS (SELECT avg(n) AS mean FROM (SELECT count(*) AS n FROM ways GROUP BY node)) SELECT node, count(*) AS degree FROM ways, m GROUP BY node, mean HAVING count(*) > 3 * mean AND count(*) >= 5",
    "graph_dangling": f"WITH {ENTRIES}, {FAMILY}, {CONTAINS}, keep AS (SELECT id FROM entries WHERE doc_id % 9 <> 0) SELECT source, target FROM contains_e WHERE source NOT IN (SELECT id FROM keep) OR target NOT IN (SELECT id FROM keep)",
    "plain_chunks": f"WITH {PLAIN} SELECT skill, file, s, e, summary, CAST(len(text) AS INT) AS chars FROM chunks",
    "chunk_postings": f"WITH {PLAIN}, {CHUNK_TERMS} SELECT term, count(*) AS n FROM ct GROUP BY term",
    "content_search": f"""WITH {PLAIN}, {CHUNK_TERMS}, {QUERIES}, n AS (SELECT count(*) AS n FROM chunks), qt AS (SELECT qid, unnest({latin('query')}) AS term FROM queries),
      f AS (SELECT term, greatest(0.1, 1.0 + (n - count(*) + 0.5) / (count(*) + 0.5))::DOUBLE AS idf FROM ct, n GROUP BY term, n), ov AS (SELECT qid, skill, file, s, e, term, idf FROM qt JOIN ct USING (term) JOIN f USING (term)),
      cov AS (SELECT a.qid, a.term, b.term AS o FROM qt a JOIN qt b ON a.qid = b.qid AND a.term <> b.term AND contains(b.term, a.term)),
      hid AS (SELECT DISTINCT x.qid, x.file, x.s, x.term FROM ov x JOIN cov c ON c.qid = x.qid AND c.term = x.term JOIN ov y ON y.qid = x.qid AND y.file = x.file AND y.s = x.s AND y.term = c.o),
      mx AS (SELECT ov.* FROM ov ANTI JOIN hid USING (qid, file, s, term)),
      sc AS (SELECT qid, skill, file, s, e, round(sum(idf) + CASE WHEN bool_or(list_contains({latin('file')}, term)) THEN 2.0 ELSE 0.0 END, 6)::DOUBLE AS score FROM mx GROUP BY qid, skill, file, s, e)
      SELECT qid, CAST(rank AS INT) AS rank, skill, file, s, e, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, skill, file, s, e) AS rank FROM sc) WHERE rank <= 5""",
    "coverage": f"""WITH {ENTRIES} SELECT count(*) AS total, CAST(sum((type = 'skill')::INT) AS BIGINT) AS skills, CAST(sum((type = 'mcp')::INT) AS BIGINT) AS mcps, CAST(sum((type = 'connector')::INT) AS BIGINT) AS connectors, CAST(sum((type = 'agent')::INT) AS BIGINT) AS agents,
      CAST(sum((visibility = 'ready')::INT) AS BIGINT) AS ready, CAST(sum((visibility = 'blocked')::INT) AS BIGINT) AS blocked, CAST(sum((visibility = 'off-list')::INT) AS BIGINT) AS off_list, CAST(sum(excluded::INT) AS BIGINT) AS excluded, CAST(sum(has_references::INT) AS BIGINT) AS with_references,
      CAST(sum((len(triggers) > 0)::INT) AS BIGINT) AS with_triggers, CAST(sum((agent_bound IS NOT DISTINCT FROM false)::INT) AS BIGINT) AS unbound, CAST(sum(len(full_text)) AS BIGINT) AS full_text_chars FROM entries""",
    "coverage_rollup": f"WITH {ENTRIES} SELECT type, visibility, count(*) AS n, CAST(sum(len(full_text)) AS BIGINT) AS chars, CAST(grouping(type, visibility) AS BIGINT) AS level FROM entries GROUP BY ROLLUP (type, visibility)",
    "coverage_cube": f"WITH {ENTRIES} SELECT source, type, count(*) AS n, CAST(sum(len(full_text)) AS BIGINT) AS chars, CAST(grouping(source, type) AS BIGINT) AS level FROM entries GROUP BY CUBE (source, type)",
    "token_economy": f"""WITH {LINES}, t AS (SELECT count(*) AS n, CAST(sum(len(full_text)) AS BIGINT) AS full_chars, CAST(sum(len(line) + 1) AS BIGINT) AS l1_chars, CAST(sum(len(name) + 1) AS BIGINT) AS l0_chars FROM dense)
      SELECT n, full_chars, l1_chars, l0_chars, CAST(round_even(full_chars / 4.0, 0) AS BIGINT) AS full_tokens, CAST(round_even(l1_chars / 4.0, 0) AS BIGINT) AS l1_tokens, round(full_chars / l1_chars, 6) AS density, round(l1_chars / n, 6) AS average_line, round(100.0::DOUBLE * (1 - least(8, n) / n), 6) AS inject_saving FROM t""",
    "dense_lines": f"WITH {LINES} SELECT id, line FROM dense",
    "heaviest_entries": f"WITH {ENTRIES} SELECT name, CAST(len(full_text) AS INT) AS chars FROM entries ORDER BY chars DESC, name LIMIT 10",
    "doctor_findings": f"""WITH {ENTRIES}, e AS (SELECT name, type, description, triggers, full_text FROM entries UNION ALL SELECT name, 'mcp', description, triggers, full_text FROM entries WHERE doc_id % 97 = 3),
      s AS (SELECT *, trim(description, ' ') AS d FROM e WHERE type = 'skill')
      SELECT CASE WHEN len(d) + len(regexp_replace(d, '[\\x00-\\x{{2e80}}]', '', 'g')) < 15 THEN 'bad_description' WHEN len(triggers) = 0 THEN 'no_triggers' ELSE 'no_zh_description' END AS finding, name FROM s
      UNION ALL SELECT 'oversized', name FROM s WHERE octet_length(encode(full_text)) > 20000 UNION ALL SELECT 'duplicate', lower(name) FROM e GROUP BY lower(name) HAVING count(*) > 1""",
    "merge_incremental": f"""WITH {ENTRIES} SELECT name AS path, CASE WHEN doc_id % 10 = 1 THEN 'added' WHEN doc_id % 10 = 2 THEN 'removed' WHEN doc_id % 10 = 3 THEN 'updated' ELSE 'kept' END AS change FROM entries""",
    "merge_registry": f"""WITH {ENTRIES}, r AS (SELECT name, visibility, CASE WHEN doc_id % 4 = 0 THEN '' ELSE description END AS rd FROM entries WHERE visibility <> 'off-list'), d AS (SELECT name, description AS dd FROM entries WHERE doc_id % 5 <> 0)
      SELECT coalesce(r.name, d.name) AS name, coalesce(CASE WHEN len(rd) > 0 THEN rd END, dd) AS description, coalesce(r.visibility, 'off-list') AS visibility, coalesce(r.visibility, 'off-list') <> 'ready' AS excluded, CASE WHEN r.name IS NULL THEN 'disk' ELSE 'registry' END AS origin FROM r FULL JOIN d ON r.name = d.name""",
    "upsert_import": f"""WITH {ENTRIES}, b AS (SELECT doc_id, name, description AS description, source AS path FROM entries), o AS (SELECT * FROM b WHERE doc_id % 4 <> 0), n AS (SELECT doc_id, name, CASE WHEN doc_id % 3 = 1 THEN 'new ' || description ELSE description END AS description, path FROM b WHERE doc_id % 3 <> 0)
      SELECT coalesce(o.name, n.name) AS name, CASE WHEN n.name IS NULL THEN o.description ELSE n.description END AS description, coalesce(o.path, n.path) AS path, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL OR o.description = n.description THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n USING (doc_id)""",
    "registry_backfill": f"""WITH {ENTRIES}, b AS (SELECT doc_id, name, description AS description, source AS category, visibility AS status FROM entries)
      SELECT name, description, CASE WHEN doc_id % 4 <> 0 THEN category END AS category, status, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 AND doc_id % 2 = 0 THEN 'a,b,c' WHEN doc_id % 3 = 0 THEN 'b,c' ELSE 'a,b' END AS agents
      FROM b WHERE doc_id % 3 = 0 OR (doc_id % 4 <> 0 AND doc_id % 2 = 0)""",
    "variants": f"""WITH {ENTRIES}, o AS (SELECT name || '-v2' AS name, {latin('''name || '-v2 ' || description || ' ' || array_to_string(triggers, ' ')''')} AS t FROM entries WHERE doc_id % 6 = 1), r AS (SELECT name, ord, {latin(ALL_TEXT)} AS t FROM entries WHERE visibility = 'ready'),
      p AS (SELECT o.name, r.name AS variant_of, r.ord, len(list_intersect(o.t, r.t)) AS i, len(list_distinct(list_concat(o.t, r.t))) AS u FROM o JOIN r ON starts_with(o.name, r.name || '-') AND len(r.name) >= 4)
      SELECT name, variant_of, round_even(i::DOUBLE / u, 6)::DOUBLE AS jaccard FROM p WHERE i >= 2 AND i::DOUBLE / u >= 0.12""",
    "nearest_documents": """WITH e AS (SELECT doc_id, lang || doc_id AS name, '/r/' || (doc_id // 100) || '/' || (doc_id // 10) AS folder FROM documents),
      r AS (SELECT '/r/' || (doc_id // 100) || '/' || (doc_id // 10) AS folder, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(ltrim(trim(x), '#'))), lambda x: len(x) >= 7 AND x[1] NOT IN ('[', '!'))[1] AS line FROM documents WHERE doc_id % 30 = 0),
      p AS (SELECT doc_id // 100 AS h, 'package ' || lang || doc_id AS line FROM documents WHERE doc_id % 100 = 5)
      SELECT e.doc_id, e.name, CASE WHEN e.doc_id % 10 = 2 THEN e.folder || '/skills/' || e.name || '/SKILL.md' WHEN r.line IS NOT NULL THEN e.folder || '/README.md' WHEN p.line IS NOT NULL THEN '/r/' || (e.doc_id // 100) || '/package.json' END AS found,
        CASE WHEN e.doc_id % 10 = 2 THEN 'the skill of ' || e.name ELSE coalesce(r.line, p.line) END AS found_description
      FROM e LEFT JOIN r ON r.folder = e.folder LEFT JOIN p ON p.h = e.doc_id // 100""",
    "synthesized_triggers": f"""WITH {ENTRIES}, t AS (SELECT id, triggers, name || '_Extra' || triggers[1] AS name FROM entries WHERE len(triggers) > 0),
      w AS (SELECT id, list_concat(list_transform(triggers[1:2], lambda x: upper(x[1]) || x[2:]), [name], list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[-_:. /]+'), lambda x: len(x) > 1), list_reverse(triggers)) AS found FROM t),
      u AS (SELECT id, unnest(found) AS t, generate_subscripts(found, 1) AS i FROM w),
      f AS (SELECT id, arg_min(t, i) AS t, min(i) AS i FROM u GROUP BY id, lower(t)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM f)
      SELECT id, string_agg(t, '|' ORDER BY i) AS triggers FROM r WHERE n <= 8 GROUP BY id""",
    "cross_feed": """WITH f AS (SELECT source AS skill, CASE WHEN doc_id % 50 = 0 THEN source || '/' || doc_id || '/SKILL.md' ELSE source || '/' || doc_id || '.txt' END AS file, doc_id % 50 = 0 AS main, string_split(text, chr(10)) AS lines FROM documents),
      w AS (SELECT *, unnest(range(0, CAST(greatest(1, ceil(len(lines) / 12.0)) AS BIGINT))) AS w FROM f WHERE len(list_filter(lines, lambda x: trim(x) <> '')) > 0),
      c AS (SELECT skill, file, main, CAST(w * 12 + 1 AS INT) AS s, CAST(least(w * 12 + 12, len(lines)) AS INT) AS e FROM w),
      r AS (SELECT *, dense_rank() OVER (PARTITION BY skill, main ORDER BY file) AS fr, row_number() OVER (PARTITION BY skill ORDER BY main DESC, file, s) AS n FROM c),
      o AS (SELECT * FROM r WHERE (main OR fr <= 5) AND n <= 50),
      e AS (SELECT DISTINCT source, 'src' || t AS target, CASE WHEN t % 2 = 0 THEN 'contains' ELSE 'depends_on' END AS type FROM (SELECT source, unnest([CAST(substr(source, 4) AS INT) + 1, CAST(substr(source, 4) AS INT) + 2]) AS t FROM documents)),
      d AS (SELECT source AS to_, target AS skill FROM e UNION SELECT target, source FROM e WHERE type = 'contains'),
      x AS (SELECT d.to_, o.*, row_number() OVER (PARTITION BY to_ ORDER BY o.skill, o.n) AS rr FROM o JOIN d ON d.skill = o.skill AND d.to_ <> d.skill)
      SELECT to_ AS skill, file, s, e, skill AS fed_from FROM x WHERE rr <= 50""",
    "front_matter": r"""WITH l AS (SELECT doc_id, doc_id % 4 AS k, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS lines FROM documents)
      SELECT doc_id, CASE WHEN k = 3 THEN 'Entry ' ELSE 'entry ' END || doc_id AS name, 'Entry ' || doc_id AS h1,
        CASE k WHEN 0 THEN array_to_string(lines, ' ') WHEN 1 THEN array_to_string(lines, chr(10)) WHEN 2 THEN regexp_replace(lines[1], '["''\\]', '', 'g') ELSE '' END AS description FROM l WHERE len(lines) > 0""",
    "reconcile": f"""WITH {ENTRIES}, l AS (SELECT unnest([1, 2]) AS run, doc_id, name, description, triggers, ord, visibility, type FROM entries),
      li AS (SELECT run, name, CASE WHEN doc_id % 10 = 5 AND run = 2 THEN description || ' rewritten' ELSE description END AS description, triggers, ord, visibility FROM l WHERE visibility <> 'off-list' AND doc_id % 10 <> run),
      di AS (SELECT run, doc_id, CASE WHEN doc_id % 6 = 1 THEN name || '-v2' ELSE name END AS name, description, triggers, ord, doc_id % 11 = 3 AND run = 2 AS touched FROM l WHERE doc_id % 7 <> run),
      off AS (SELECT di.* FROM di ANTI JOIN li ON li.run = di.run AND lower(li.name) = lower(di.name)),
      tx AS (SELECT run, name, ord, {latin("description || ' ' || array_to_string(triggers, ' ')")} AS t FROM li WHERE visibility = 'ready'),
      pr AS (SELECT o.run, o.name, tx.name AS base, tx.ord, len(list_intersect({latin("o.description || ' ' || array_to_string(o.triggers, ' ')")}, tx.t)) AS i, len(list_distinct(list_concat({latin("o.description || ' ' || array_to_string(o.triggers, ' ')")}, tx.t))) AS u
        FROM off o JOIN tx ON tx.run = o.run AND least(len(o.name), len(tx.name)) >= 4 AND (starts_with(lower(o.name), lower(tx.name) || '-') OR starts_with(lower(tx.name), lower(o.name) || '-'))),
      va AS (SELECT run, name, base FROM (SELECT *, row_number() OVER (PARTITION BY run, name ORDER BY i::DOUBLE / u DESC, ord) AS r FROM pr WHERE i >= 2 AND i::DOUBLE / u >= 0.12) WHERE r = 1),
      ix AS (SELECT o.*, lower(va.base) AS variant_of FROM off o LEFT JOIN va ON va.run = o.run AND va.name = o.name)
      SELECT coalesce(n.name, o.name) AS name, 'list' AS origin, CASE WHEN coalesce(n.visibility, o.visibility) = 'ready' THEN 'ready' ELSE 'blocked' END AS visibility, coalesce(n.visibility, o.visibility) <> 'ready' AS excluded, CAST(NULL AS VARCHAR) AS variant_of,
        CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN n.description = o.description THEN 'kept' ELSE 'updated' END AS change
      FROM (SELECT * FROM li WHERE run = 2) n FULL JOIN (SELECT * FROM li WHERE run = 1) o ON o.name = n.name
      UNION ALL SELECT coalesce(n.name, o.name), 'disk', CASE WHEN CASE WHEN n.name IS NULL THEN o.variant_of ELSE n.variant_of END IS NULL THEN 'off-list' ELSE 'ready' END,
        CASE WHEN n.name IS NULL THEN o.variant_of ELSE n.variant_of END IS NULL, CASE WHEN n.name IS NULL THEN o.variant_of ELSE n.variant_of END,
        CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN (n.variant_of IS NULL) <> (o.variant_of IS NULL) OR (n.touched AND n.variant_of IS NULL) THEN 'updated' ELSE 'kept' END
      FROM (SELECT * FROM ix WHERE run = 2) n FULL JOIN (SELECT * FROM ix WHERE run = 1) o ON o.name = n.name""",
    "index_generations": f"""WITH {ENTRIES}, g AS (SELECT unnest([1, 2]) AS generation, * FROM entries), ge AS (SELECT * FROM g WHERE generation = 2 OR doc_id % 3 <> 0),
      ns AS (SELECT *, lower(regexp_split_to_array(name, '[-_.]')[1]) AS ns FROM ge WHERE len(regexp_split_to_array(name, '[-_.]')) >= 2 AND len(regexp_split_to_array(name, '[-_.]')[1]) >= 3),
      fm AS (SELECT generation, ns, count(*) AS n, min(id) AS root FROM ns GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40),
      ed AS (SELECT a.generation, a.id AS source FROM ns a JOIN ns b ON a.generation = b.generation AND a.ns = b.ns AND a.id < b.id JOIN fm f ON f.generation = a.generation AND f.ns = a.ns WHERE f.n <= 6
        UNION ALL SELECT f.generation, f.root FROM ns a JOIN fm f ON f.generation = a.generation AND f.ns = a.ns WHERE f.n > 6 AND a.id <> f.root)
      SELECT CAST(generation AS BIGINT) AS generation, id, type, visibility, (SELECT count(*) FROM ed WHERE ed.generation = ge.generation AND ed.source = ge.id) AS edges FROM ge""",
    "content_update": """WITH k AS (SELECT doc_id % 4 AS k, doc_id % 8 AS m FROM documents), c AS (
      SELECT 1 AS run, 'added' AS change FROM k WHERE k <> 3
      UNION ALL SELECT 2, CASE k WHEN 0 THEN 'kept' WHEN 1 THEN 'updated' WHEN 2 THEN 'removed' ELSE 'added' END FROM k WHERE k <> 3 OR m = 3 UNION ALL SELECT 2, 'added' FROM k WHERE k = 2
      UNION ALL SELECT 3, CASE WHEN k <> 3 OR m = 3 THEN 'kept' ELSE 'added' END FROM k) SELECT CAST(run AS BIGINT) AS run, change, count(*) AS files FROM c GROUP BY run, change""",
    "ledger_gap": f"WITH {EVENTS} SELECT query, count(*) AS n FROM hits WHERE kind = 'search' AND n_hits = 0 GROUP BY query ORDER BY n DESC, query LIMIT 10",
    "ledger_hits": f"WITH {EVENTS} SELECT skill, count(*) AS n FROM hits WHERE n_hits > 0 AND kind <> 'adopt' GROUP BY skill",
    "ledger_adopt": f"WITH {EVENTS} SELECT skill, count(*) AS n FROM hits WHERE kind = 'adopt' GROUP BY skill",
    "ledger_zombies": f"WITH {EVENTS} SELECT 'k' || range AS name FROM range(200) WHERE 'k' || range NOT IN (SELECT skill FROM hits WHERE n_hits > 0 AND kind <> 'adopt' AND skill IS NOT NULL)",
    "promotion": f"WITH {EVENTS} SELECT skill, count(*) AS uses FROM hits WHERE kind IN ('adopt', 'chat') AND skill NOT IN ('k1', 'k2') GROUP BY skill HAVING count(*) >= 3",
    "usage_summary": f"WITH {EVENTS} SELECT kind AS cmd, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS chars FROM hits GROUP BY kind",
    "ledger_tumbling": f"WITH {EVENTS} SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS stop, kind, count(*) AS n, count(*) FILTER (n_hits = 0) AS zero FROM hits GROUP BY ALL",
    "ledger_sliding": f"WITH {EVENTS}, w AS (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS start, kind, n_hits FROM hits) SELECT start, start + INTERVAL 2 DAY AS stop, kind, count(*) AS n, count(*) FILTER (n_hits = 0) AS zero FROM w GROUP BY ALL",
    "ledger_session": f"""WITH {EVENTS}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM hits), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k""",
    "dag_layers": f"WITH RECURSIVE {ENTRIES}, {DEPENDENCIES}, l(id, layer) AS (SELECT id, CAST(1 AS BIGINT) FROM entries WHERE doc_id = 0 UNION ALL SELECT d.source, l.layer + 1 FROM deps d JOIN l ON l.id = d.target) SELECT id, layer, false AS cyclic FROM l",
    "graph_conflicts": f"WITH {ENTRIES}, {DEPENDENCIES}, every AS (SELECT source, target FROM deps UNION SELECT target, source FROM deps WHERE len(source) % 4 = 0) SELECT a.source, a.target FROM every a JOIN every b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target",
    "all_edges": f"""WITH {OVERLAP}, {FAMILY}, {CONTAINS}, w AS (SELECT DISTINCT id AS source, unnest(regexp_extract_all(lower(description || ' ' || array_to_string(triggers, ' ')), '[a-z0-9_-]+')) AS low FROM entries WHERE type = 'skill')
      SELECT source, target, 'family' AS type, 'undirected' AS direction, CAST(1.0 AS DOUBLE) AS weight FROM family UNION ALL SELECT source, target, 'contains', 'directed', CAST(0.7 AS DOUBLE) FROM contains_e UNION ALL SELECT u, v, 'overlap', 'undirected', weight FROM over
      UNION ALL SELECT DISTINCT w.source, e.id, 'depends_on', 'directed', CAST(0.8 AS DOUBLE) FROM w JOIN entries e ON lower(e.name) = w.low WHERE e.type IN ('skill', 'mcp') AND e.id <> w.source""",
    "python_chunks": """WITH d AS (SELECT source AS skill, doc_id, doc_id || '.py' AS file, len(string_split(text, chr(10))) AS n FROM documents),
      plain AS (SELECT skill, file, n, unnest(range(0, CASE WHEN n + 9 <= 50 THEN 1 ELSE CAST(ceil((n + 9 - 50) / 45.0) AS BIGINT) + 1 END)) AS w FROM d WHERE doc_id % 5 = 0)
      SELECT skill, file, 1 AS s, CAST(n + 2 AS INT) AS e, 'import os' AS summary FROM d WHERE doc_id % 5 <> 0 UNION ALL SELECT skill, file, CAST(n + 3 AS INT), CAST(n + 9 AS INT), 'f_' || doc_id FROM d WHERE doc_id % 5 <> 0
      UNION ALL SELECT p.skill, p.file, CAST(w * 45 + 1 AS INT), CAST(least(w * 45 + 50, p.n + 9) AS INT), CASE WHEN w = 0 THEN 'import os' ELSE substr(list_filter(list_transform(list_concat(['import os'], list_transform(string_split(text, chr(10)), lambda x: '# ' || regexp_replace(x, '[^ -~]', '', 'g')), ['', 'def f_' || doc_id || '(x):', 'a = x', 'b = a', 'c = b', 'return c', 'y = 1', 'def broken('])[w * 45 + 1 : w * 45 + 50], lambda x: trim(x)), lambda x: x <> '')[1], 1, 80) END
      FROM plain p JOIN documents ON doc_id || '.py' = p.file""",
    "file_outline": f"""WITH {PLAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY skill, file ORDER BY s, e) AS r FROM chunks)
      SELECT skill, file, count(*) AS n, string_agg('L' || s || '-' || e || ': ' || summary, chr(10) ORDER BY r) FILTER (r <= 8) AS sections FROM r GROUP BY skill, file""",
    "markdown_chunks": """WITH f AS (SELECT source AS skill, source || '/' || doc_id || '.txt' AS file, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 7 = 3 THEN '## ' || x ELSE x END) AS lines FROM documents),
      g AS (SELECT *, len(lines) AS n, list_distinct(list_concat([1], list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '^#{1,6}\\s')))) AS st FROM f WHERE len(list_filter(lines, lambda x: trim(x) <> '')) > 0),
      s AS (SELECT skill, file, lines, n, unnest(list_sort(st)) AS s FROM g), e AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY file ORDER BY s) - 1, n) AS e, row_number() OVER (PARTITION BY file ORDER BY s) AS k FROM s),
      h AS (SELECT *, sum(CASE WHEN k = 1 OR e - s + 1 >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s) AS grp FROM e), m AS (SELECT skill, file, any_value(lines) AS lines, min(s) AS s, max(e) AS e FROM h GROUP BY skill, file, grp)
      SELECT skill, file, CAST(s AS INT) AS s, CAST(e AS INT) AS e, substr(coalesce(list_filter(list_transform(lines[s:e], lambda x: trim(regexp_replace(x, '^#{1,6}\\s+', ''))), lambda x: x <> '')[1], ''), 1, 80) AS summary FROM m""",
    "route_intents": f"""WITH t AS (SELECT conv_id, turn, ['find ', 'export the ', 'plan for ', 'what is ', '@alpha '][CAST(conv_id % 5 + 1 AS INT)] || text AS text FROM conversations WHERE role = 'user'),
      m AS (SELECT *, list_filter([{", ".join("CASE WHEN regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for p in ps) + f"') THEN '{c}' END" for c, ps in ROUTES)}], lambda x: x IS NOT NULL) AS found FROM t),
      a AS (SELECT *, CASE WHEN regexp_matches(text, '@[a-zA-Z0-9_-]+') THEN list_append(found, 'explain') ELSE found END AS every FROM m),
      f AS (SELECT *, CASE WHEN len(every) > 0 THEN list_slice(every, 1, 3) WHEN regexp_matches(lower(text), '{"|".join(map(re.escape, PIPELINE_CUES))}') THEN ['pipeline', 'chat', 'search'] WHEN regexp_matches(lower(text), '{"|".join(map(re.escape, QUESTION_CUES))}') THEN ['chat', 'search'] ELSE ['{DEFAULT_ROUTE}'] END AS final FROM a)
      SELECT conv_id, turn, final[1] AS command, array_to_string(final, ',') AS alternatives FROM f""",
}

ORACLES |= {"content_frequencies": ORACLES["chunk_postings"], "content_search_kept": ORACLES["content_search"]}
