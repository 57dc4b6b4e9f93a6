"""DuckDB SQL for the queries of the catalog: written on their own, over the same tables."""

from __future__ import annotations

CAT = "(['DEADLINE','EXAM','FEES','REGISTRATION','NOTICE','EVENT','HOLIDAY','CALENDAR'])"
NOW = "TIMESTAMP '1998-06-01'"
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def ts(x: str, name: str | None = None) -> str:
    return f"{TS.format(x)} AS {name or x.split('.')[-1]}"


ITEMS = f"""items AS (
  SELECT 'info:' || o_orderkey AS id, o_orderkey AS k, 'claim:' || o_orderkey AS claim_id, {CAT}[1 + (o_orderkey % 8)::INT] AS category,
    lower({CAT}[1 + (o_orderkey % 8)::INT]) || ' notice for ' || lower(c_mktsegment) AS title, 'Order ' || o_orderkey || ' by ' || c_name || ' of ' || lower(n_name) || '.' AS summary,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS program, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE n_name END AS branch,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 1 + c_custkey % 4 END AS yr, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 1 + c_custkey % 8 END AS semester,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'NORMAL' ELSE 'LOW' END AS importance,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 WHEN '3' THEN 1 ELSE 0 END AS rnk,
    CASE WHEN o_orderstatus IN ('F','O') THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS state, 'Priority ' || lower(o_orderpriority) || ' order for clerk ' || o_orderkey % 50 AS statement,
    o_orderdate AS published_at, o_orderdate AS effective_from, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 90 DAY END AS effective_until,
    CASE WHEN o_orderkey % 8 IN (0,1,2,3) THEN o_orderdate + (o_orderkey % 120)::INT * INTERVAL 1 DAY END AS due_at, CASE WHEN o_orderkey % 8 IN (5,6,7) THEN o_orderdate + (o_orderkey % 90)::INT * INTERVAL 1 DAY END AS starts_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
EDGES = """edges AS (SELECT 'info:' || (o_orderkey - 1) AS old_id, 'info:' || o_orderkey AS new_id, CASE o_orderkey % 3 WHEN 0 THEN 'SUPERSEDES' WHEN 1 THEN 'CHANGED' ELSE 'CORRECTS' END AS kind, o_orderdate AS created_at, o_orderkey
  FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey > 0)"""
LIVE = f"""live AS (SELECT * FROM items i WHERE state = 'VERIFIED' AND (effective_from IS NULL OR effective_from <= {NOW}) AND (effective_until IS NULL OR effective_until > {NOW})
  AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.old_id = i.id AND e.kind = 'SUPERSEDES'))"""
SCOPED = "(program IS NULL OR program = 'BUILDING') AND (yr IS NULL OR yr = 2)"
BASE = f"WITH {ITEMS}, {EDGES}, {LIVE}"
COLS = "id, category, importance, title"
NEWEST = "ORDER BY published_at DESC, id"
RELEVANT = "ORDER BY rnk DESC, published_at DESC, id"
USERS = """users AS (SELECT c_custkey AS user_id, c_custkey % 10 <> 0 AS active, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS program, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_name END AS branch,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 1 + c_custkey % 4 END AS yr, CASE c_custkey % 3 WHEN 1 THEN ['DEADLINE','EXAM'] ELSE []::VARCHAR[] END AS cats,
  c_custkey % 5 <> 0 AS reminders, c_custkey % 7 <> 0 AS digest, c_custkey % 13 = 0 AS muted, c_custkey % 6 = 0 AS quiet FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
MEETS = "(len(u.cats) = 0 OR list_contains(u.cats, i.category)) AND (u.program IS NULL OR i.program IS NULL OR u.program = i.program) AND (u.branch IS NULL OR i.branch IS NULL OR u.branch = i.branch) AND (u.yr IS NULL OR i.yr IS NULL OR u.yr = i.yr)"
NORM = r"array_to_string(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+'), ' ')"
TOKS = r"list_distinct(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+'))"
TEXT_CLAIMS = f"c AS (SELECT doc_id AS pos, 'claim:' || doc_id AS id, source, sha256({NORM.format('text')}) AS fp, {TOKS.format('text')} AS toks FROM documents)"
EVIDENCE = "e AS (SELECT source AS source_id, sha256(text) AS content_hash, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS fetched_at, doc_id, doc_id % 17 = 0 AS failed, text FROM documents)"
NOTICES = r"""notices AS (SELECT o_orderkey AS k, 'source' || o_orderkey % 6 AS source_id, 'https://source' || o_orderkey % 6 || '.example.org/n/' || o_orderkey AS url, CASE o_orderkey % 8
  WHEN 0 THEN 'Exam form submission closes on ' || strftime(d, '%-d %B %Y') || '. Late fee applies after ' || strftime(d, '%Y-%m-%d') || '!'
  WHEN 1 THEN 'The workshop on data is on ' || strftime(d, '%Y-%m-%d') || '. Registration deadline is ' || strftime(d, '%-d/%-m/%Y') || '! Submit by ' || strftime(d, '%-d %b %Y') || ' or 1-1-2030'
  WHEN 2 THEN 'Holiday notice: closed on ' || strftime(d, '%d.%m.%Y') || chr(10) || chr(10) || 'Seminar   from ' || strftime(d, '%-d %b %Y') || ' to 31 December 2035'
  WHEN 3 THEN 'Fees due by 31 February 2026 or payment due 2026-13-01' WHEN 4 THEN 'General circular for information'
  WHEN 5 THEN 'Academic calendar' || chr(10) || 'Semester classes ' || strftime(d, '%-d %B %Y') || ' to 2 Sept 2034' || chr(10) || ' ' || strftime(d, '%-d %B %Y') || ' ' || chr(10) || 'no date here'
  WHEN 6 THEN 'Straße event EVENT ' || strftime(d, '%-d-%-m-%Y') || '? Orientation ' || strftime(d, '%-d %B %Y') ELSE 'Order ' || o_orderkey || ' due' END AS text
  FROM (SELECT o_orderkey, o_orderdate::DATE + INTERVAL 240 MONTH AS d FROM orders))"""
SENT = r"s AS (SELECT k, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), 1) AS sn FROM notices)"
LINES = r"s AS (SELECT k, source_id, url, trim(unnest(string_split(text, chr(10)))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS sn FROM notices)"
MONTH = "CASE WHEN regexp_matches(m, '^[0-9]') THEN m::INT ELSE list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(lower(m), 1, 3)) END"
DAY = r"\b([0-9]{1,2})[\s./-]+([A-Za-z]{3,9}|[0-9]{1,2})[\s./-]+(20[0-9]{2})\b"


def dates(source: str, key: str) -> str:
    """CTE found(key columns, value, src, conf): the dates of source.s."""
    return rf"""raw AS (SELECT {key}, s, unnest(regexp_extract_all(s, '{DAY}')) AS src, 0.95 AS conf FROM {source}
    UNION ALL SELECT {key}, s, unnest(regexp_extract_all(s, '\b20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}\b')), 0.99 FROM {source}),
  cut AS (SELECT *, CASE WHEN conf = 0.99 THEN substr(src, 1, 4) ELSE regexp_extract(src, '{DAY}', 3) END AS y, CASE WHEN conf = 0.99 THEN substr(src, 6, 2) ELSE regexp_extract(src, '{DAY}', 2) END AS m, CASE WHEN conf = 0.99 THEN substr(src, 9, 2) ELSE regexp_extract(src, '{DAY}', 1) END AS d FROM raw),
  found AS (SELECT DISTINCT {key}, s, src, conf, try_cast(y || '-' || lpad(({MONTH})::VARCHAR, 2, '0') || '-' || lpad(d, 2, '0') AS TIMESTAMP) AS value FROM cut),
  dated AS (SELECT * FROM found WHERE value IS NOT NULL)"""


def has(terms: str) -> str:
    return "(" + " OR ".join(f"contains(lower(s), '{t}')" for t in terms.split("|")) + ")"


DEADLINE, EVENT = has("deadline|due|last date|closes|closing date|submit by|submission"), has("event|seminar|workshop|webinar|orientation|fest|conference|ceremony")
TITLE = r"regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '^[ .:-]+|[ .:-]+$', '', 'g')"


def statements(test: str, first: bool) -> str:
    pick = "QUALIFY row_number() OVER (PARTITION BY k, sn ORDER BY value, src) = 1" if first else ""
    return f"""WITH {NOTICES}, {SENT}, {dates('s', 'k, sn')}, picked AS (SELECT k, sn, s, value, src, {TITLE} AS title FROM dated WHERE {test} {pick}),
  kept AS (SELECT * FROM picked QUALIFY row_number() OVER (PARTITION BY k, value, title ORDER BY sn, src) = 1)
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY sn, value, src) - 1 AS n, title, {ts('value', 'at')}, trim(s) AS source_text FROM kept"""


TERMS = (
    ("EXAMINATION", "exam|examination|semester end|date sheet|admit card"), ("FEES", "fee|fees|payment|tuition|scholarship fee"), ("REGISTRATION", "registration|register|enrolment|enrollment|form submission"),
    ("HOLIDAY", "holiday|holidays|vacation|closed"), ("EVENT", "event|seminar|workshop|webinar|orientation|fest|conference|ceremony"), ("ACADEMIC", "academic calendar|semester|session|academic year|classes"), ("GENERAL", "notice|circular|notification|information"),
)


def category(h: str) -> str:
    count = lambda terms: " + ".join(f"(length({h}) - length(replace({h}, '{t}', ''))) // {len(t)}" for t in terms.split("|"))
    listed = ", ".join(f"({count(terms)})::INT" for _, terms in TERMS)
    names = ", ".join(f"'{n}'" for n, _ in TERMS)
    return f"CASE WHEN list_max([{listed}]) = 0 THEN 'UNKNOWN' ELSE ([{names}])[list_position([{listed}], list_max([{listed}]))] END"


def jaccard_pairs(threshold: float, same: bool) -> str:
    test = "a.source = b.source AND a.fp <> b.fp" if same else "a.source <> b.source"
    return f"""WITH {TEXT_CLAIMS}, t AS (SELECT pos, unnest(toks) AS t FROM c), df AS (SELECT t, count(*) AS df FROM t GROUP BY t),
  r AS (SELECT t.pos, t.t, row_number() OVER (PARTITION BY t.pos ORDER BY df, t.t) AS rn, len(c.toks) AS n FROM t JOIN df USING (t) JOIN c USING (pos)),
  p AS (SELECT * FROM r WHERE rn <= n - ceil(n * {threshold} - 1e-9) + 1),
  m AS (SELECT DISTINCT x.pos AS l, y.pos AS r FROM p x JOIN p y ON x.t = y.t AND x.pos < y.pos),
  j AS (SELECT a.id AS "left", b.id AS "right", len(list_intersect(a.toks, b.toks)) AS i, len(a.toks) AS na, len(b.toks) AS nb, a.fp = b.fp AS identical FROM m JOIN c a ON a.pos = m.l JOIN c b ON b.pos = m.r WHERE {test}
    UNION ALL SELECT a.id, b.id, 0, 0, 0, true FROM c a JOIN c b ON a.pos < b.pos AND len(a.toks) = 0 AND len(b.toks) = 0 WHERE {test}),
  s AS (SELECT "left", "right", CASE WHEN na + nb = 0 THEN 1.0 ELSE i / (na + nb - i)::DOUBLE END AS similarity, identical FROM j)
  SELECT "left", "right", round(similarity, 6) AS similarity{'' if same else ', identical'} FROM s WHERE similarity >= {threshold}"""


STOP = "['a','an','and','are','be','by','for','from','in','is','of','on','or','that','the','this','to','with','notice','please']"
CONTENT = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda x: length(x) >= 2 AND NOT list_contains(" + STOP + ", x))"
SCORED = f"""subs AS (SELECT conv_id || ':' || turn AS sid, {CONTENT.format('text')} AS ta FROM conversations WHERE role = 'user'),
  arch AS (SELECT 'info:' || item_id AS iid, item_id % 2 = 0 AS bad, {CONTENT.format("text || ' item ' || item_id")} AS tb FROM benchmark),
  ov AS (SELECT sid, iid, bad, len(list_intersect(ta, tb)) AS n, len(ta) AS na, len(tb) AS nb FROM subs, arch WHERE len(ta) > 0 AND len(tb) > 0),
  sc AS (SELECT sid, iid, bad, n, least(1.0, 0.55 * n / (na + nb - n) + 0.30 * n / na) AS score FROM ov WHERE n > 0),
  scored AS (SELECT * FROM sc WHERE score >= 0.15),
  verdicts AS (SELECT sid, CASE WHEN count(*) FILTER (score >= 0.2) = 0 THEN 'UNVERIFIED' WHEN bool_or(bad AND score >= 0.2) THEN 'CONFLICTING' ELSE 'MATCHED' END AS verdict FROM subs LEFT JOIN scored USING (sid) GROUP BY sid)"""
STATES = "['UNVERIFIED','VERIFIED','CONFLICTING','EXPIRED','SUPERSEDED','REMOVED']"
LEGAL = "({0} = {1} OR {0} || '>' || {1} IN ('UNVERIFIED>VERIFIED','UNVERIFIED>CONFLICTING','UNVERIFIED>REMOVED','VERIFIED>CONFLICTING','VERIFIED>SUPERSEDED','VERIFIED>EXPIRED','VERIFIED>REMOVED','CONFLICTING>VERIFIED','CONFLICTING>SUPERSEDED','CONFLICTING>EXPIRED','CONFLICTING>REMOVED','EXPIRED>VERIFIED','EXPIRED>REMOVED'))"
SHORT = "substr(sha256({0}), 1, {1})"
CANON = r"CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) || CASE WHEN regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') LIKE '/%' THEN '' ELSE '/' END || regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') ELSE u END"
AHEAD = f"due_at >= {NOW} AND due_at < {NOW} + INTERVAL 14 DAY"
NEAR = f"""cand AS (SELECT * FROM live i WHERE {AHEAD} AND EXISTS (SELECT 1 FROM items o WHERE o.id <> i.id AND o.state = 'VERIFIED' AND {AHEAD.replace('due_at', 'o.due_at')}
  AND abs(epoch(o.due_at) - epoch(i.due_at)) <= 86400 AND o.effective_from <= {NOW} AND (o.effective_until IS NULL OR o.effective_until > {NOW})) ORDER BY due_at, id LIMIT 30)"""


def changes(f: str) -> str:
    return f"""WITH {EVIDENCE}, b AS (SELECT source_id, content_hash, fetched_at, doc_id, failed, text FROM e {f}),
  g AS (SELECT *, min(CASE WHEN NOT failed THEN (fetched_at, doc_id) END) OVER (PARTITION BY source_id, content_hash) AS f1, min(CASE WHEN NOT failed THEN (fetched_at, doc_id) END) OVER (PARTITION BY source_id) AS f0,
    last_value(CASE WHEN NOT failed THEN content_hash END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY fetched_at, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b),
  st AS (SELECT *, CASE WHEN failed THEN 'FAILED' WHEN (fetched_at, doc_id) = f0 THEN 'FETCHED' WHEN (fetched_at, doc_id) > f1 THEN 'UNCHANGED' ELSE 'CHANGED' END AS status, coalesce(NOT failed AND (fetched_at, doc_id) > f1 AND prev <> content_hash, false) AS reverted FROM g)"""


def calendar_dates(rows: str) -> str:
    """Start and end dates of calendar rows."""
    return f"""WITH r AS ({rows}) SELECT k, id, start_at AS value, label, confidence FROM r UNION ALL SELECT k, id, end_at, label || ' end', confidence FROM r WHERE end_at IS NOT NULL"""


SQL = {
    "latest": f"{BASE} SELECT {COLS}, {ts('published_at')} FROM live WHERE {SCOPED} AND category IN ('DEADLINE','EXAM','FEES','REGISTRATION') {NEWEST} LIMIT 8",
    "public_feed": f"{BASE} SELECT {COLS}, {ts('published_at')} FROM live WHERE category = 'EXAM' {NEWEST} LIMIT 20",
    "upcoming": f"{BASE} SELECT {COLS}, {ts('due_at')}, {ts('starts_at')} FROM live WHERE coalesce(due_at, starts_at) BETWEEN {NOW} AND {NOW} + INTERVAL 30 DAY ORDER BY coalesce(due_at, live.starts_at), id LIMIT 8".replace("coalesce(due_at, live.starts_at)", "coalesce(live.due_at, live.starts_at)"),
    "search_all_tokens": f"{BASE} SELECT {COLS} FROM live WHERE contains(lower(title || chr(1) || summary || chr(1) || statement), 'notice') AND contains(lower(title || chr(1) || summary || chr(1) || statement), 'nation_19') {RELEVANT} LIMIT 8",
    "search_any_token": f"{BASE} SELECT {COLS} FROM live WHERE regexp_matches(lower(title || chr(1) || summary || chr(1) || statement), 'germany|france|exam') {NEWEST} LIMIT 30",
    "natural_week": f"{BASE} SELECT {COLS} FROM live WHERE category = 'EXAM' AND coalesce(due_at, starts_at, effective_from, published_at) >= {NOW} AND coalesce(due_at, starts_at, effective_from, published_at) < {NOW} + INTERVAL 7 DAY ORDER BY coalesce(due_at, starts_at, effective_from, published_at), id LIMIT 10",
    "retrieval_candidates": f"{BASE} SELECT {COLS} FROM live WHERE {SCOPED} {RELEVANT} LIMIT 30",
    "changes_timeline": f"{BASE} SELECT i.id, i.category, i.importance, i.title, e.kind AS change_kind, {ts('e.created_at', 'changed_at')}, o.title AS old_title FROM edges e JOIN items i ON i.id = e.new_id LEFT JOIN items o ON o.id = e.old_id WHERE i.state = 'VERIFIED' AND e.created_at BETWEEN {NOW} - INTERVAL 30 DAY AND {NOW} AND i.effective_from <= {NOW} AND (i.effective_until IS NULL OR i.effective_until > {NOW}) ORDER BY e.created_at DESC, i.id LIMIT 10",
    "calendar_items": f"{BASE} SELECT {COLS}, {ts('live.starts_at')} FROM live WHERE {SCOPED} AND category IN ('EVENT','HOLIDAY','CALENDAR') AND coalesce(live.starts_at, due_at) >= {NOW} AND coalesce(live.starts_at, due_at) < {NOW} + INTERVAL 15 DAY ORDER BY coalesce(live.starts_at, due_at), id LIMIT 20",
    "calendar_feed": f"{BASE} SELECT {COLS}, {ts('live.due_at')}, {ts('live.starts_at')} FROM live WHERE {SCOPED} AND category IN ('DEADLINE','EXAM','REGISTRATION','EVENT','HOLIDAY','CALENDAR') AND coalesce(live.starts_at, live.due_at) >= {NOW} AND coalesce(live.starts_at, live.due_at) < {NOW} + INTERVAL 90 DAY ORDER BY coalesce(live.starts_at, live.due_at), id LIMIT 100",
    "important_documents": f"{BASE} SELECT {COLS} FROM live WHERE {SCOPED} AND category IN ('NOTICE','CALENDAR') AND importance IN ('HIGH','CRITICAL') {RELEVANT} LIMIT 8",
    "deadline_conflicts": f"{BASE}, {NEAR} SELECT {COLS}, {ts('cand.due_at')} FROM cand",
    "deadline_groups": BASE.replace("WITH", "WITH RECURSIVE", 1) + f""", {NEAR}, o AS (SELECT id, due_at, row_number() OVER (ORDER BY due_at, id) AS rn FROM cand),
      w AS (SELECT rn, id, due_at, due_at AS anchor, 1 AS g FROM o WHERE rn = 1 UNION ALL SELECT o.rn, o.id, o.due_at, CASE WHEN epoch(o.due_at) - epoch(w.anchor) <= 86400 THEN w.anchor ELSE o.due_at END, CASE WHEN epoch(o.due_at) - epoch(w.anchor) <= 86400 THEN w.g ELSE w.g + 1 END FROM w JOIN o ON o.rn = w.rn + 1),
      m AS (SELECT g, string_agg(id, '|' ORDER BY rn) AS members FROM w GROUP BY g HAVING count(*) > 1)
      SELECT row_number() OVER (ORDER BY g) - 1 AS group_no, members FROM m""",
    "archive_search_default": f"{BASE} SELECT id, importance FROM items WHERE {SCOPED} ORDER BY rnk DESC, published_at DESC, id LIMIT 50",
    "archive_search_query": f"""{BASE}, t AS (SELECT *, {TOKS.format('title')} AS tt, {TOKS.format('summary')} AS st FROM items)
      SELECT id, importance FROM t WHERE len(list_filter(['exam','notice','nation','19'], lambda x: NOT list_contains(list_concat(tt, st), x))) = 0
      ORDER BY len(list_intersect(['exam','notice','nation','19'], tt)) DESC, len(list_intersect(['exam','notice','nation','19'], st)) DESC, rnk DESC, published_at DESC, id LIMIT 50""",
    "archive_search_at": f"{BASE} SELECT id, {ts('items.due_at')} FROM items WHERE category = 'EXAM' AND effective_from <= {NOW} AND (effective_until IS NULL OR effective_until > {NOW}) ORDER BY items.due_at IS NULL, coalesce(items.due_at, starts_at, effective_from) NULLS LAST, rnk DESC, id LIMIT 50",
    "evidence_append": f"WITH {EVIDENCE} SELECT source_id, content_hash, min(doc_id) AS doc_id FROM e n WHERE doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.doc_id % 3 = 0 AND o.source_id = n.source_id AND o.content_hash = n.content_hash) GROUP BY ALL",
    "evidence_latest": f"WITH {EVIDENCE} SELECT source_id, {ts('fetched_at')}, content_hash, doc_id FROM e QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY e.fetched_at DESC, doc_id DESC) = 1",
    "evidence_history": f"WITH {EVIDENCE} SELECT doc_id, {ts('fetched_at')} FROM e WHERE source_id = 'src1'",
    "acquisition_status": changes("UNION ALL SELECT source_id, content_hash, fetched_at + INTERVAL 30 DAY, doc_id + 10000000, failed, text FROM e WHERE doc_id % 5 = 0") + " SELECT doc_id, source_id, status, reverted FROM st",
    "source_health_streak": f"WITH {EVIDENCE}, l AS (SELECT *, max(CASE WHEN NOT failed THEN fetched_at END) OVER (PARTITION BY source_id) AS ok FROM e) SELECT source_id, count(*) FILTER (failed AND (ok IS NULL OR fetched_at > ok)) AS consecutive_failures, {ts('max(ok)', 'last_success_at')} FROM l GROUP BY source_id",
    "run_rollup": changes("") + " SELECT count(*) AS sources, count(*) FILTER (status = 'FETCHED') AS fetched, count(*) FILTER (status = 'CHANGED') AS changed, count(*) FILTER (status = 'FAILED') AS failed, sum(strlen(text))::BIGINT AS total_bytes, CASE WHEN count(*) FILTER (status = 'FAILED') = count(*) THEN 'FAILED' WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status FROM st",
    "source_registry": """WITH s AS (SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')) AS site, count(*) AS n FROM pages GROUP BY 1)
      SELECT site AS id, split_part(site, '://', 2) AS name, site || '/' AS base_url, true AS enabled FROM s WHERE site <> '' AND n >= 2
      UNION ALL SELECT 'source' || i, 'Source ' || i, 'https://source' || i || '.example.org/', true FROM range(3) t(i)""",
    "normalize_text": r"SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(regexp_replace(x, '[\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS sha256 FROM documents",
    "statement_fingerprint": f"SELECT doc_id, sha256({NORM.format('text')}) AS fingerprint, len({TOKS.format('text')}) AS tokens FROM documents",
    "claim_ids": f"""WITH c AS (SELECT o_orderkey AS k, 'claim:' || o_orderkey AS id, 'doc:' || o_orderkey AS d, 'source' || o_orderkey % 6 AS src, sha256({NORM.format("'Priority ' || lower(o_orderpriority) || ' order for clerk ' || o_orderkey % 50")}) AS fp FROM orders)
      SELECT k, 'claim:' || d || ':' || substr(fp, 1, 24) AS claim_id, sha256(src || ':' || fp) AS evidence_id, 'rel:' || {SHORT.format("'SIMILAR' || chr(0) || least(id, d) || chr(0) || greatest(id, d)", 32)} AS rel_id, src || ':' || {SHORT.format("src || chr(0) || 'u' || chr(0) || k", 24)} AS rel_source_id FROM c""",
    "extract_dates": f"WITH {NOTICES}, s AS (SELECT k, text AS s FROM notices), {dates('s', 'k')} SELECT k, row_number() OVER (PARTITION BY k ORDER BY dated.value, src) - 1 AS n, {ts('dated.value')}, src AS source_text, conf::DOUBLE AS confidence FROM dated",
    "extract_deadlines": statements(DEADLINE, False),
    "extract_events": statements(EVENT, True),
    "classify_notice": f"WITH {NOTICES}, h AS (SELECT k, lower(source_id || ' ' || text) AS h FROM notices) SELECT k, {category('h')} AS category FROM h",
    "category_map": f"WITH {NOTICES}, h AS (SELECT k, lower(' ' || text) AS h FROM notices), c AS (SELECT k, {category('h')} AS c FROM h) SELECT k, CASE c WHEN 'ACADEMIC' THEN 'CALENDAR' WHEN 'EXAMINATION' THEN 'EXAM' WHEN 'GENERAL' THEN 'NOTICE' WHEN 'UNKNOWN' THEN 'NOTICE' ELSE c END AS category FROM c",
    "academic_calendar": f"""WITH {NOTICES}, {LINES}, {dates('s', 'k, sn, source_id, url')}, l AS (SELECT k, sn, source_id, url, s, list(src ORDER BY value, src) AS srcs, list(value ORDER BY value, src) AS vs FROM dated GROUP BY ALL),
      b AS (SELECT *, list_reduce(list_concat([s], srcs), lambda acc, x: replace(acc, x, ' ')) AS bare FROM l),
      r AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(bare, '(?i)\\b(?:to|through|until)\\b', ' ', 'g'), '\\s+', ' ', 'g'), '^[ :|\\t–—-]+|[ :|\\t–—-]+$', '', 'g') AS lab0 FROM b),
      q AS (SELECT *, CASE WHEN lab0 = '' THEN 'Academic calendar entry' ELSE lab0 END AS label FROM r),
      z AS (SELECT k, source_id || ':' || {SHORT.format("source_id || chr(0) || url || chr(0) || sha256(strftime(vs[1], '%Y-%m-%dT%H:%M:%S') || ':' || coalesce(strftime(vs[2], '%Y-%m-%dT%H:%M:%S'), '') || ':' || lower(label))", 24)} AS id, sn, s, vs, label FROM q)
      SELECT k, id, {ts('vs[1]', 'start_at')}, {ts('vs[2]', 'end_at')}, label, CASE WHEN len(vs) > 1 THEN 0.94 ELSE 0.82 END::DOUBLE AS confidence, s AS source_text FROM z QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY sn DESC) = 1""",
    "claims_from_documents": f"""WITH d AS ({statements(DEADLINE, False)}), v AS ({statements(EVENT, True)}), {NOTICES}, st AS (SELECT k, source_text AS s, "at" FROM d UNION ALL SELECT k, source_text, "at" FROM v),
      a AS (SELECT * FROM st UNION ALL SELECT k, substr(text, 1, 1000), NULL FROM notices WHERE k NOT IN (SELECT k FROM st) AND trim(text) <> ''),
      f AS (SELECT *, {NORM.format('s')} AS norm FROM a)
      SELECT 'claim:doc:' || k || ':' || {SHORT.format('norm', 24)} AS id, 'doc:' || k AS document_id, trim(s) AS statement, norm AS normalized_statement, sha256(norm) AS fingerprint, "at" AS effective_from FROM f""",
    "dedupe_claims": f"WITH {TEXT_CLAIMS} SELECT id, fp AS fingerprint FROM c QUALIFY row_number() OVER (PARTITION BY fp ORDER BY pos) = 1",
    "same_content_pairs": f'WITH {TEXT_CLAIMS} SELECT a.id AS "left", b.id AS "right" FROM c a JOIN c b ON a.fp = b.fp AND a.pos < b.pos',
    "content_classes": f"WITH {TEXT_CLAIMS} SELECT id, first_value(id) OVER (PARTITION BY fp ORDER BY pos) AS class_id, count(*) OVER (PARTITION BY fp) AS members FROM c",
    "cross_source_similarity": jaccard_pairs(0.80, False),
    "same_source_conflicts": jaccard_pairs(0.65, True),
    "url_canonical": f"WITH p AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages), c AS (SELECT page_id, {CANON} AS canonical FROM p) SELECT page_id, canonical, regexp_replace(canonical, '/+$', '') AS identity FROM c",
    "url_replacements": f"""WITH p AS (SELECT page_id % 100000 AS key, url FROM pages), n AS (SELECT key, url AS old_url, CASE key % 4 WHEN 0 THEN split_part(url, '#', 1) || '/' WHEN 1 THEN url || 'x' ELSE url END AS new_url FROM p),
      i AS (SELECT *, (SELECT regexp_replace({CANON}, '/+$', '') FROM (SELECT split_part(old_url, '#', 1) AS u)) AS a, (SELECT regexp_replace({CANON}, '/+$', '') FROM (SELECT split_part(new_url, '#', 1) AS u)) AS b FROM n) SELECT key, old_url, new_url FROM i WHERE a <> b""",
    "verify_claims": "SELECT 'claim:' || o_orderkey AS claim_id, CASE WHEN (o_orderkey % 1000) % 3 <> 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS state, 'ev:' || o_orderkey % 1000 AS evidence_id, CASE WHEN (o_orderkey % 1000) % 3 <> 0 THEN 'claim is traceable to an available evidence record' ELSE 'no available evidence record matches the claim' END AS reason FROM orders",
    "publishable": "SELECT 'claim:' || o_orderkey AS id, 'ev:' || o_orderkey % 1000 AS evidence_id FROM orders WHERE o_orderstatus IN ('F','O') AND (o_orderkey % 1000) % 3 <> 0",
    "state_transitions": f"WITH m AS (SELECT o_orderkey AS k, ({STATES})[1 + (o_orderkey % 6)::INT] AS a, ({STATES})[1 + ((o_orderkey // 6) % 6)::INT] AS b FROM orders) SELECT k, a AS state, b AS next_state, ({LEGAL.format('a', 'b')})::INT AS accepted FROM m".replace(STATES, "['UNVERIFIED','VERIFIED','CONFLICTING','EXPIRED','SUPERSEDED','REMOVED']"),
    "resolve_state": f"""WITH c AS (SELECT 'claim:' || o_orderkey AS id, o_orderkey AS k, CASE WHEN o_orderstatus IN ('F','O') THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 90 DAY END AS u FROM orders),
      r AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'CONFLICTING' WHEN k % 7 = 0 THEN 'SUPERSEDED' WHEN u <= {NOW} THEN 'EXPIRED' ELSE a END AS b FROM c) SELECT id, a AS state, b AS next_state, ({LEGAL.format('a', 'b')})::INT AS accepted FROM r""",
    "expiration": f"SELECT 'claim:' || o_orderkey AS id, {ts('o_orderdate + INTERVAL 90 DAY', 'effective_until')} FROM orders WHERE o_orderkey % 3 = 0 AND o_orderdate + INTERVAL 90 DAY <= {NOW}",
    "provenance": """WITH c AS (SELECT o_orderkey AS k, o_orderkey % 1000 AS e, o_orderkey % 6 AS s, CASE WHEN o_orderstatus IN ('F','O') THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS state FROM orders)
      SELECT 'claim:' || k AS claim_id, state, 'ev:' || e AS evidence_id, sha256(e::VARCHAR) AS content_hash, 'Source ' || s AS source_name, 'Source ' || s || ': https://source' || s || '.example.org/, fetched ' || strftime(TIMESTAMP '2024-01-01' + e::INT * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M') || ', sha256 ' || substr(sha256(e::VARCHAR), 1, 12) AS summary FROM c""",
    "evidence_links": "SELECT 'claim:' || o_orderkey AS claim_id, 'ev:' || o_orderkey % 1000 AS evidence_id, 'primary evidence' AS role FROM orders",
    "derive_priority": f"""WITH {ITEMS}, t AS (SELECT *, coalesce(due_at, starts_at) AS t FROM items), u AS (SELECT *, CASE WHEN t IS NULL THEN 'NONE' WHEN t < {NOW} THEN 'OVERDUE' WHEN t <= {NOW} + INTERVAL 2 DAY THEN 'IMMEDIATE' WHEN t <= {NOW} + INTERVAL 7 DAY THEN 'SOON' ELSE 'UPCOMING' END AS urgency, category IN ('EXAM','FEES','REGISTRATION','DEADLINE') AS heavy FROM t)
      SELECT id, CASE WHEN urgency = 'OVERDUE' OR urgency = 'IMMEDIATE' AND heavy THEN 'CRITICAL' WHEN k % 9 = 0 OR heavy THEN 'HIGH' WHEN (program IS NOT NULL)::INT + (branch IS NOT NULL)::INT + (yr IS NOT NULL)::INT + (semester IS NOT NULL)::INT >= 3 THEN 'HIGH' WHEN category IN ('NOTICE','CALENDAR') THEN 'NORMAL' ELSE 'LOW' END AS importance, urgency FROM u""",
    "build_items": f"""WITH c AS (SELECT o_orderkey AS k, 'claim:' || o_orderkey AS cid, (['FEES','EVENT','NOTICE'])[1 + (o_orderkey % 3)::INT] AS category, o_orderdate AS d, contains(o_orderpriority, 'URGENT') AS said FROM orders WHERE o_orderstatus IN ('F','O')),
      u AS (SELECT *, CASE WHEN d < {NOW} THEN 'OVERDUE' WHEN d <= {NOW} + INTERVAL 2 DAY THEN 'IMMEDIATE' WHEN d <= {NOW} + INTERVAL 7 DAY THEN 'SOON' ELSE 'UPCOMING' END AS urgency FROM c)
      SELECT 'info:' || {SHORT.format("cid || ':' || category", 24)} AS id, cid AS claim_id, 'Title ' || k AS title, category, CASE WHEN urgency = 'OVERDUE' OR urgency = 'IMMEDIATE' AND category = 'FEES' THEN 'CRITICAL' WHEN category = 'FEES' OR said THEN 'HIGH' WHEN category = 'NOTICE' THEN 'NORMAL' ELSE 'LOW' END AS importance, urgency, {ts('d', 'starts_at')}, 'https://x.example.org/' || k || '|https://y.example.org/' AS source_links FROM u""",
    "scope_match": f"WITH {ITEMS}, {USERS} SELECT u.user_id, i.id FROM users u JOIN items i ON u.user_id = i.k % 1500 WHERE (u.program IS NULL OR i.program IS NULL OR u.program = i.program) AND (u.branch IS NULL OR i.branch IS NULL OR u.branch = i.branch) AND (u.yr IS NULL OR i.yr IS NULL OR u.yr = i.yr)",
    "scope_specificity": f"WITH {ITEMS} SELECT id, (program IS NOT NULL)::INT + (branch IS NOT NULL)::INT + (yr IS NOT NULL)::INT + (semester IS NOT NULL)::INT AS specificity FROM items",
    "item_relationships": " UNION ALL ".join(f"SELECT '{p}:info:' || (o_orderkey - 1) || ':info:' || o_orderkey AS id, 'info:' || (o_orderkey - 1) AS old_item_id, 'info:' || o_orderkey AS new_item_id, '{kind}' AS kind FROM orders WHERE o_orderkey % {m} = 0" for p, kind, m in (("change", "CHANGED", 2), ("supersedes", "SUPERSEDES", 3), ("corrects", "CORRECTS", 5))),
    "retract_sources": "SELECT 'info:' || o_orderkey AS id, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 AND NOT ((o_orderkey - 1) % 6 = 5 AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders)) THEN 'info:' || (o_orderkey - 1) END AS changed_from_item_id FROM orders WHERE o_orderkey % 6 <> 5",
    "retract_edges": f"WITH {EDGES} SELECT 'rel:' || o_orderkey AS id, old_id AS old_item_id, new_id AS new_item_id FROM edges WHERE o_orderkey % 6 <> 5 AND NOT ((o_orderkey - 1) % 6 = 5 AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders))",
    "facts_grouped": "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS pos, 'part ' || l_partkey % 100 AS title, 'u' || l_suppkey % 5 AS url, l_returnflag || l_linestatus || l_linenumber AS fact FROM lineitem), d AS (SELECT title, url, fact, min(pos) AS pos FROM r GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY title, url ORDER BY pos, fact) AS rn FROM d) SELECT title, url, string_agg(fact, '|' ORDER BY rn) FILTER (rn <= 12) AS facts, min(pos) AS first_pos FROM n GROUP BY title, url",
    "item_lines": f"""WITH {ITEMS} SELECT id, '[' || CASE state WHEN 'VERIFIED' THEN 'Verified' ELSE 'Unverified' END || '] ' || title || ' (' || CASE WHEN program IS NULL AND branch IS NULL AND yr IS NULL AND semester IS NULL THEN 'everyone' ELSE concat_ws(', ', program, branch, 'year ' || yr, 'semester ' || semester) END || '), ' || coalesce(strftime(coalesce(due_at, starts_at), '%Y-%m-%d'), 'no date') AS line FROM items""",
    "conflict_membership": f"WITH {ITEMS}, x AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 22 = 0 UNION SELECT o_orderkey + 1 FROM orders WHERE o_orderkey % 22 = 0) SELECT id FROM items WHERE k IN (SELECT k FROM x)",
    "upsert_latest": f"SELECT o_orderkey % 5000 AS k, max(o_orderkey) AS version, {ts('arg_min(o_orderdate, o_orderkey)', 'first_seen_at')}, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY o_orderkey % 5000",
    "insert_if_absent": "SELECT o_custkey AS k, min(o_orderkey) AS pos, arg_min(o_orderstatus, o_orderkey) AS state FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY o_custkey",
    "upsert_odd_versions": """SELECT o_orderkey % 3000 AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 5 END AS version, o_orderkey AS id, o_orderstatus AS state FROM orders
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY version IS NULL, version DESC, o_orderkey % 2 DESC, o_orderkey DESC) = 1""",
    "update_repeated_keys": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'PAUSED' WHEN c_custkey % 10 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status FROM customer",
    "replace_rows": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS state, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS priority FROM orders UNION ALL SELECT -1, 'X', NULL",
    "replace_cascade": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)",
    "delete_by_key": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 10 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status FROM customer WHERE c_custkey % 4 <> 0",
    "retract_links": "SELECT 'claim:' || l_orderkey AS claim_id, 'ev:' || l_partkey AS evidence_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 2)",
    "health_probe": """WITH c AS (SELECT 'documents' AS dependency, count(*) AS n_rows FROM documents UNION ALL SELECT 'pages', count(*) FROM pages
        UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'no_such_table', 0)
      SELECT dependency, (n_rows > 0)::INT AS ok, n_rows FROM c UNION ALL SELECT 'service', 0, min(n_rows) FROM c""",
    "user_preferences": f"""WITH {USERS} SELECT user_id, CASE WHEN active THEN 'ACTIVE' ELSE 'PAUSED' END AS status, program, branch, yr AS "year", array_to_string(cats, '|') AS categories, reminders::INT AS reminders, digest::INT AS digest, muted::INT AS muted,
      CASE WHEN quiet THEN '22:00' END AS quiet_start, CASE WHEN quiet THEN '07:00' END AS quiet_end FROM users WHERE user_id % 11 <> 0""",
    "preferences_of_user": f"""WITH {USERS} SELECT user_id, CASE WHEN active THEN 'ACTIVE' ELSE 'PAUSED' END AS status, program, yr AS "year" FROM users WHERE user_id = 7""",
    "feed_other_categories": f"""{BASE}, {USERS}, other AS (SELECT * REPLACE (CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'SPORT' ELSE category END AS category) FROM live)
      SELECT u.user_id, row_number() OVER (PARTITION BY u.user_id ORDER BY i.published_at DESC, i.id) AS rank, i.id AS item_id FROM users u JOIN other i ON {MEETS} WHERE u.active QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY i.published_at DESC, i.id) <= 4""",
    "delivery_status": f"""WITH RECURSIVE e AS (SELECT user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, ts, ['PENDING','SENT','FAILED','SKIPPED'][1 + (event_id % 4)::INT] AS mark,
        row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) AS n FROM events),
      w AS (SELECT DISTINCT user_id, week, 0::BIGINT AS n, 'PENDING' AS status, NULL::TIMESTAMP AS sent_at FROM e
        UNION ALL SELECT x.user_id, x.week, x.n2, CASE WHEN x.ok THEN x.mark ELSE x.status END, CASE WHEN x.ok AND x.mark IN ('SENT', 'FAILED') THEN x.ts ELSE x.sent_at END
        FROM (SELECT w.user_id, w.week, w.status, w.sent_at, m.mark, m.ts, m.n AS n2, (w.status = 'PENDING' AND m.mark <> 'PENDING') OR (w.status IN ('FAILED', 'SKIPPED') AND m.mark = 'PENDING') AS ok
          FROM w JOIN e m ON m.user_id = w.user_id AND m.week = w.week AND m.n = w.n + 1) x)
      SELECT user_id, week, status, {ts('sent_at', 'delivered_at')} FROM w QUALIFY row_number() OVER (PARTITION BY user_id, week ORDER BY n DESC) = 1""",
    "update_by_key": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'BLOCKED' WHEN c_custkey % 10 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status, CASE WHEN c_custkey % 6 = 0 THEN '22:00' END AS quiet_start FROM customer",
    "blob_chunks": "SELECT doc_id, i AS chunk_index, sha256(array_slice(encode(text), i * 1000 + 1, i * 1000 + 1000)) AS sha256 FROM (SELECT doc_id, text, unnest(range(greatest(1, (strlen(text) + 999) // 1000))) AS i FROM documents)",
    "blob_reassembly": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "constraint_violations": "SELECT 'state' AS rule, 0 AS violations UNION ALL SELECT 'statement', 0 UNION ALL SELECT 'window', 0 UNION ALL SELECT 'odd_key', count(*) FILTER (o_orderkey % 2 <> 0) FROM orders",
    "submission_scores": f"WITH {SCORED} SELECT sid AS submission_id, iid AS item_id, round(score, 6)::DOUBLE AS score, n AS shared FROM scored",
    "submission_best": f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, iid) AS rk FROM scored) SELECT sid AS submission_id, iid AS item_id, rk AS rank, n || ' shared tokens' AS reason FROM r WHERE rk <= 5",
    "submission_classify": f"WITH {SCORED} SELECT sid AS submission_id, verdict FROM verdicts",
    "review_queue": f"WITH {SCORED}, t AS (SELECT sid, max(score) AS s FROM scored GROUP BY sid) SELECT sid AS submission_id, verdict, round(coalesce(s, 0), 6)::DOUBLE AS top_score FROM verdicts LEFT JOIN t USING (sid) WHERE verdict = 'CONFLICTING' OR verdict = 'UNVERIFIED' AND s IS NOT NULL",
    "verification_matches": f"""{BASE}, q AS (SELECT {CONTENT.format("'Please check the exam notice for building orders of germany'")} AS ta), near AS (SELECT * FROM live WHERE regexp_matches(lower(title || chr(1) || summary || chr(1) || statement), 'check|exam|building|orders|germany') {NEWEST} LIMIT 30),
      o AS (SELECT id, ta, {CONTENT.format("title || ' ' || summary")} AS tb FROM near, q), n AS (SELECT id, len(list_intersect(ta, tb)) AS n, len(ta) AS na, len(tb) AS nb FROM o),
      s AS (SELECT id, n, 0.55 * n / (na + nb - n) + 0.30 * n / na AS score FROM n WHERE n > 0), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rk FROM s WHERE score >= 0.15)
      SELECT id AS item_id, round(score, 6)::DOUBLE AS score, rk AS rank, n || ' shared tokens' AS reason FROM r WHERE rk <= 5""",
    "vector_topk": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE id = 0) SELECT id, round(array_cosine_similarity(e, qe), 6) AS score FROM v, q ORDER BY array_cosine_similarity(e, qe) DESC, id LIMIT 6",
    "semantic_topk": f"""{BASE}, c AS (SELECT id, k % 500 AS v FROM live {RELEVANT} LIMIT 20), q AS (SELECT embedding::DOUBLE[64] AS qe FROM embeddings WHERE vec_id = 0)
      SELECT c.id, round(array_cosine_similarity(e.embedding::DOUBLE[64], qe), 6) AS score FROM c JOIN embeddings e ON e.vec_id = c.v, q ORDER BY array_cosine_similarity(e.embedding::DOUBLE[64], qe) DESC, c.id LIMIT 6""",
    "embedding_cache": "SELECT vec_id AS id, 'info:7' AS item_id, 'm1' AS model FROM embeddings WHERE vec_id % 50 = 7 AND label % 2 = 1 AND vec_id % 7 = 3",
    "calendar_token_user": f"SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 20 = 3 AND TIMESTAMP '1998-05-01' + (c_custkey % 90)::INT * INTERVAL 1 DAY > {NOW}",
    "stream_queue": f"WITH {SCORED} SELECT sid AS submission_id, verdict FROM verdicts",
    "citation_check": "SELECT o_orderkey AS k, (o_orderkey % 5 <= 2)::INT AS ok FROM orders",
    "json_from_fence": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "personal_feed_all_users": f"{BASE}, {USERS} SELECT u.user_id, row_number() OVER (PARTITION BY u.user_id ORDER BY coalesce(i.due_at, i.starts_at) NULLS LAST, i.id) AS rank, i.id AS item_id FROM users u JOIN live i ON {MEETS} WHERE u.active QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY coalesce(i.due_at, i.starts_at) NULLS LAST, i.id) <= 3",
    "notification_users": f"WITH {USERS} SELECT user_id, program, array_to_string(cats, '|') AS categories FROM users WHERE active",
    "quiet_hours": "WITH r AS (SELECT event_id, strftime(ts, '%H:%M') AS c FROM events) SELECT event_id, CASE event_id % 3 WHEN 0 THEN c >= '22:00' OR c < '07:00' WHEN 1 THEN c >= '08:00' AND c < '12:00' ELSE true END::INT AS quiet, 1 AS valid FROM r",
    "reminders_due": f"{BASE}, {USERS} SELECT u.user_id, i.id AS item_id, 'REMINDER' AS kind, strftime(i.due_at, '%Y-%m-%dT%H') AS key FROM users u JOIN live i ON {MEETS} WHERE u.active AND u.reminders AND NOT u.muted AND NOT u.quiet AND i.due_at > {NOW} AND i.due_at <= {NOW} + INTERVAL 3 DAY QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY i.due_at, i.id) <= 5",
    "weekly_digest": f"{BASE}, {USERS}, r AS (SELECT u.user_id, row_number() OVER (PARTITION BY u.user_id ORDER BY coalesce(i.due_at, i.starts_at), i.id) AS rk FROM users u JOIN live i ON {MEETS} WHERE u.active AND u.digest AND NOT u.muted AND NOT u.quiet AND coalesce(i.due_at, i.starts_at) BETWEEN {NOW} + INTERVAL 185 MINUTE AND {NOW} + INTERVAL 185 MINUTE + INTERVAL 7 DAY) SELECT user_id, count(*) AS n_items, 'DIGEST' AS kind, '1998-W23' AS key FROM r WHERE rk <= 10 GROUP BY user_id",
    "notification_ledger": """WITH l AS (SELECT event_id, ts, user_id, 'info:' || event_id % 500 AS item, CASE WHEN event_id % 4 = 0 THEN 'DIGEST' ELSE 'REMINDER' END AS kind, strftime(ts, '%Y-%m-%dT%H') AS key, (['PENDING','SENT','FAILED','SKIPPED'])[1 + (event_id % 4)::INT] AS status FROM events),
      h AS (SELECT * FROM l WHERE event_id % 3 = 0 AND (status = 'SENT' OR status = 'PENDING' AND ts >= TIMESTAMP '2024-01-08'))
      SELECT DISTINCT 'notification:' || user_id || ':' || kind || ':' || item || ':' || key AS id, 'PENDING' AS status FROM l w WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = w.user_id AND h.item = w.item AND h.kind = w.kind AND h.key = w.key)""",
    "iso_week_key": "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, strftime(o_orderdate, '%Y-%m-%dT%H') AS hour FROM orders",
    "message_parts": "SELECT doc_id, 1 AS fits, length(replace(text, chr(10), '')) AS chars FROM documents",
    "sitemap_urls": "SELECT page_id, url FROM pages",
    "robots_allowed": "SELECT page_id FROM pages WHERE NOT starts_with(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '/en/')",
    "robots_gate": r"""WITH p AS (SELECT page_id, length(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+')) AS n, regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', '') AS path FROM pages)
      SELECT page_id, CASE WHEN n = 0 OR n % 5 = 2 THEN 'FAILED' WHEN n % 5 = 0 AND starts_with(path, '/en/') THEN 'REFUSED'
        WHEN n % 5 = 1 AND starts_with(path, '/de/') AND NOT starts_with(path, '/de/7') THEN 'REFUSED' ELSE 'ALLOWED' END AS robots_verdict FROM p""",
    "stream_once_only": "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "stream_new_content": "SELECT DISTINCT source AS source_id, sha256(text) AS content_hash FROM documents",
    "stream_ledger": "SELECT user_id, 'info:' || event_id % 500 AS item_id, 'REMINDER' AS kind, strftime(ts, '%Y-%m-%dT%H') AS key, arg_max((['PENDING','SENT','FAILED','SKIPPED'])[1 + (event_id % 4)::INT], (ts, event_id)) AS status FROM events GROUP BY ALL",
}
SQL["calendar_dates"] = calendar_dates(SQL["academic_calendar"])


def ics(x: str) -> str:
    return rf"replace(replace(replace(replace({x}, '\', '\\'), ';', '\;'), ',', '\,'), chr(10), '\n')"


RAW_DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},\s+\d{4})\b"
CRLF, UTC, ISO = "chr(13) || chr(10)", "'%Y%m%dT%H%M%SZ'", "'%Y-%m-%dT%H:%M:%SZ'"
START = "coalesce(starts_at, due_at)"
URL = "'https://source' || k % 6 || '.example.org/items/' || k"
VEVENT = f""" || {CRLF} || """.join((
    "'BEGIN:VEVENT'", "'UID:' || id", f"'DTSTAMP:' || strftime({NOW}, {UTC})", f"'DTSTART:' || strftime({START}, {UTC})", f"'DTEND:' || strftime({START} + INTERVAL 1 HOUR, {UTC})",
    f"'SUMMARY:' || {ics('title')}", f"'DESCRIPTION:' || {ics('summary')}", f"'URL:' || {URL}", "'END:VEVENT'",
))
JSON_ITEM = "{'id': id, 'title': title, 'summary': summary, 'category': category, 'importance': importance, 'program': program, 'branch': branch, 'year': yr, 'semester': semester, " + ", ".join(
    f"'{c}': strftime({c}, {ISO})" for c in ("published_at", "effective_from", "effective_until", "due_at", "starts_at")) + f", 'ends_at': NULL, 'primary_source_url': {URL}}}"
NEXT = "['VERIFIED','CONFLICTING','EXPIRED','SUPERSEDED','REMOVED'][1 + (event_id % 5)::INT]"
ALL_DATES = dates("s", "k")

SQL |= {
    "public_feed_json": f"""{BASE}, x AS (SELECT * FROM live WHERE category = 'EXAM' {NEWEST} LIMIT 20)
      SELECT to_json({{'ok': true, 'trust': 'verified', 'generated_at': strftime({NOW}, {ISO}), 'items': list({JSON_ITEM} {NEWEST})}})::VARCHAR AS feed FROM x""",
    "evidence_late": f"""WITH {EVIDENCE}, h AS (SELECT * FROM e WHERE doc_id % 3 <> 0), f AS (SELECT * REPLACE (fetched_at - INTERVAL 1 DAY AS fetched_at) FROM e WHERE doc_id % 3 = 0),
      fresh AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source_id = f.source_id AND h.content_hash = f.content_hash) QUALIFY row_number() OVER (PARTITION BY source_id, content_hash ORDER BY fetched_at, doc_id) = 1),
      l AS (SELECT source_id, doc_id AS latest_doc FROM (FROM h UNION ALL FROM fresh) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, doc_id DESC) = 1)
      SELECT source_id, doc_id, latest_doc FROM f JOIN l USING (source_id) WHERE f.fetched_at < (SELECT max(fetched_at) FROM h WHERE h.source_id = f.source_id)""",
    "run_manifest": """WITH r AS (SELECT coalesce(CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END::VARCHAR, chr(0)) || chr(1) || o_orderkey || chr(1) || o_orderstatus AS r FROM orders)
      SELECT sha256(count(*) || ':' || sum(('0x' || substr(sha256(r), 1, 15))::BIGINT)) AS manifest_sha256, count(*) AS objects FROM r""",
    "duplicate_ids": "SELECT l_orderkey, l_suppkey % 3 AS shelf, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "content_gate": """SELECT page_id, ['text/html','application/pdf','text/plain','application/json','application/xhtml+xml','image/png',NULL][1 + (page_id % 7)::INT] AS media_type,
      (page_id % 7 < 2)::INT AS accepted, ['html','pdf','text','text','html',NULL,NULL][1 + (page_id % 7)::INT] AS extractor FROM pages""",
    "text_documents": "SELECT doc_id, sha256(text) AS sha256, CASE WHEN length(trim(text)) > 0 THEN 'MEDIUM' ELSE 'FAILED' END AS level, CASE WHEN length(trim(text)) > 0 THEN 0.8 ELSE 0 END::DOUBLE AS score, 'text' AS extraction_kind FROM documents",
    "date_tokens": f"""WITH {NOTICES}, s AS (SELECT k, text || ' 3/4/26, May 5, 2026 and 40-13-99' AS s FROM notices), {ALL_DATES}, a AS (SELECT k, list(strftime(value, '%Y-%m-%d')) AS a FROM dated GROUP BY k)
      SELECT k, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), list_transform(regexp_extract_all(s, '{RAW_DATE}'), lambda x: lower(x))))), '|') AS tokens FROM s LEFT JOIN a USING (k)""",
    "submission_dates": """WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE + INTERVAL 240 MONTH AS d FROM orders)
      SELECT 's:' || a.k AS submission_id, 'info:' || b.k AS item_id, 0.15::DOUBLE AS score, 0 AS shared, 1 AS date_hit FROM o a JOIN o b ON a.d = b.d WHERE a.k % 8 = 0 AND b.k % 8 = 1""",
    "submission_batch": """SELECT 'submission' AS part, conv_id || ':' || turn AS id, conv_id AS user_id, CASE WHEN conv_id % 2 = 0 THEN 'up/' || conv_id || ':' || turn END AS object_key,
        CASE WHEN conv_id % 2 = 0 THEN 'file:///objects/' || conv_id || ':' || turn END AS object_file, NULL AS title, NULL AS left_claim_id, NULL AS kind FROM conversations WHERE role = 'user'
      UNION ALL SELECT 'item', 'info:' || item_id, NULL, NULL, NULL, text, NULL, NULL FROM benchmark
      UNION ALL SELECT 'conflict', NULL, NULL, NULL, NULL, NULL, 'info:' || item_id, 'CONFLICTS' FROM benchmark WHERE item_id % 2 = 0""",
    "grounded_prompts": """WITH e AS (SELECT l_orderkey AS k, string_agg('[e' || l_linenumber || '] part <' || l_partkey || '> & more: ' || l_returnflag, chr(10) ORDER BY 'e' || l_linenumber, 'part <' || l_partkey || '>', l_returnflag) AS e FROM lineitem GROUP BY l_orderkey),
      p AS (SELECT k, 'Answer only from the evidence and cite ids.' || chr(10) || e || chr(10) || 'Question: What of order ' || k || '?' AS prompt FROM e) SELECT k, prompt, replace(replace(replace(prompt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM p""",
    "file_names": "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), 1, 100) AS name FROM pages",
    "ics_feed": f"""{BASE}, {USERS}, r AS (SELECT u.user_id, i.*, row_number() OVER (PARTITION BY u.user_id ORDER BY coalesce(i.starts_at, i.due_at), i.id) AS rank FROM users u JOIN live i ON {MEETS}
        WHERE u.active AND coalesce(i.due_at, i.starts_at) >= {NOW} QUALIFY rank <= 5)
      SELECT user_id, 'BEGIN:VCALENDAR' || {CRLF} || 'VERSION:2.0' || {CRLF} || 'PRODID:-//notices//EN' || {CRLF} || 'X-WR-CALNAME:Notices' || {CRLF} || string_agg({VEVENT}, {CRLF} ORDER BY rank) || {CRLF} || 'END:VCALENDAR' || {CRLF} AS ics FROM r GROUP BY user_id""",
    "stream_claim_state": f"""WITH RECURSIVE e AS (SELECT 'claim:' || user_id AS claim_id, ts, {NEXT} AS mark, row_number() OVER (PARTITION BY user_id ORDER BY ts, {NEXT}) AS n FROM events),
      w AS (SELECT DISTINCT claim_id, NULL::TIMESTAMP AS ts, 0::BIGINT AS n, 'UNVERIFIED' AS state, true AS accepted FROM e
        UNION ALL SELECT x.claim_id, x.ts, x.n, CASE WHEN x.ok THEN x.mark ELSE x.state END, x.ok FROM (SELECT e.claim_id, e.ts, e.n, e.mark, w.state, {LEGAL.format('w.state', 'e.mark')} AS ok FROM w JOIN e ON e.claim_id = w.claim_id AND e.n = w.n + 1) x)
      SELECT claim_id, {ts('w.ts')}, state, accepted FROM w WHERE n > 0""",
}

# Keyed state. The stream's end is the latest event less the delay; what lies before it has come out.
END = "(SELECT date_trunc('second', max(ts)) - INTERVAL 2 DAY FROM events)"
CAN_EXPIRE = "('VERIFIED', 'CONFLICTING')"
SQL |= {
    "stream_claim_expiry": f"""WITH RECURSIVE
      given AS (SELECT 'claim:' || event_id % 400 AS claim_id, date_trunc('second', ts) AS ts, event_id,
        CASE WHEN event_id % 97 = 0 THEN 'SUPERSEDED' WHEN event_id % 101 = 0 THEN 'REMOVED' ELSE ['VERIFIED','CONFLICTING','VERIFIED','EXPIRED','VERIFIED','CONFLICTING'][1 + (event_id % 6)::INT] END AS mark FROM events),
      e AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ts, mark, until NULLS FIRST) AS n
        FROM (SELECT *, CASE WHEN event_id % 5 < 2 THEN ts + to_hours(event_id % 90 - 5) END AS until FROM given) WHERE ts < {END}),
      w AS (SELECT DISTINCT claim_id, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, 'UNVERIFIED' AS state, true AS ok, NULL::TIMESTAMP AS alarm, NULL::TIMESTAMP AS expired FROM e
        UNION ALL
        SELECT claim_id, n, ts, CASE WHEN ok THEN mark ELSE was END, ok, CASE WHEN until IS NOT NULL THEN greatest(until, ts) WHEN NOT rings THEN alarm END, CASE WHEN rings AND can THEN alarm END
        FROM (SELECT *, {LEGAL.format('was', 'mark')} AS ok
          FROM (SELECT e.*, w.alarm, coalesce(w.alarm <= e.ts, false) AS rings, w.state IN {CAN_EXPIRE} AS can, CASE WHEN w.alarm <= e.ts AND w.state IN {CAN_EXPIRE} THEN 'EXPIRED' ELSE w.state END AS was
            FROM w JOIN e ON e.claim_id = w.claim_id AND e.n = w.n + 1))),
      last AS (SELECT * FROM w QUALIFY n = max(n) OVER (PARTITION BY claim_id))
      SELECT claim_id, {ts('t', 'ts')}, state, accepted, cause FROM (
        SELECT claim_id, ts AS t, state, ok AS accepted, 'event' AS cause FROM w WHERE n > 0
        UNION ALL SELECT claim_id, expired, 'EXPIRED', true, 'expiry' FROM w WHERE expired IS NOT NULL
        UNION ALL SELECT claim_id, alarm, 'EXPIRED', true, 'expiry' FROM last WHERE alarm < {END} AND state IN {CAN_EXPIRE})""",
    "stream_change_status": """WITH f AS (SELECT source AS source_id, doc_id, TIMESTAMP '2024-01-01' + to_minutes(7 * doc_id) AS since, substr(sha256(text), 1, 2) AS h,
        CASE WHEN doc_id % 9 = 0 THEN 500 WHEN doc_id % 7 = 0 THEN 304 ELSE 200 END AS code FROM documents),
      g AS (SELECT *, CASE WHEN code = 200 THEN h END AS shown FROM f),
      p AS (SELECT *, last_value(shown IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY since, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        CASE WHEN shown IS NOT NULL THEN row_number() OVER (PARTITION BY source_id, shown ORDER BY since, doc_id) END AS time_shown FROM g)
      SELECT source_id, doc_id, CASE WHEN code = 500 OR (code = 304 AND before IS NULL) OR (code = 200 AND h IS NULL) THEN 'FAILED' WHEN code = 304 THEN 'UNCHANGED' WHEN before IS NULL THEN 'FETCHED' WHEN time_shown > 1 THEN 'UNCHANGED' ELSE 'CHANGED' END AS status,
        coalesce(code = 200 AND time_shown > 1 AND before <> h, false) AS reverted, coalesce(shown, before) AS last_good
      FROM p WHERE since < (SELECT max(since) - INTERVAL 6 HOUR FROM f)""",
    "stream_delivery": f"""WITH RECURSIVE
      e AS (SELECT 'notification:' || event_id % 700 AS id, date_trunc('second', ts) AS ts, event_id, ['CLAIM','SENT','CLAIM','FAILED','CLAIM','SKIPPED'][1 + ((event_id * 7 + event_id // 700) % 6)::INT] AS mark,
        row_number() OVER (PARTITION BY event_id % 700 ORDER BY date_trunc('second', ts), event_id) AS n FROM events WHERE date_trunc('second', ts) < {END}),
      w AS (SELECT DISTINCT id, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, NULL::BIGINT AS event_id, NULL::VARCHAR AS status, NULL::TIMESTAMP AS since, 0 AS attempt, true AS ok, NULL::TIMESTAMP AS lapsed, 0 AS lapsed_attempt FROM e
        UNION ALL
        SELECT id, n, ts, event_id, CASE WHEN NOT ok THEN s WHEN mark = 'CLAIM' THEN 'PENDING' ELSE mark END, CASE WHEN ok THEN ts ELSE a END, c + (ok AND mark = 'CLAIM')::INT, ok, lapsed, lapsed_attempt
        FROM (SELECT *, CASE WHEN mark = 'CLAIM' THEN s IS NULL OR s IN ('FAILED', 'SKIPPED', 'LAPSED') ELSE coalesce(s = 'PENDING' OR (s = 'LAPSED' AND mark = 'SENT'), false) END AS ok
          FROM (SELECT *, CASE WHEN gone THEN NULL ELSE s1 END AS s, CASE WHEN gone THEN NULL ELSE a1 END AS a, CASE WHEN gone THEN 0 ELSE c1 END AS c
            FROM (SELECT *, coalesce(s1 <> 'PENDING' AND a1 + INTERVAL 5 DAY <= ts, false) AS gone
              FROM (SELECT e.*, CASE WHEN lapses THEN 'LAPSED' ELSE w.status END AS s1, CASE WHEN lapses THEN w.since + INTERVAL 3 DAY ELSE w.since END AS a1, w.attempt AS c1, CASE WHEN lapses THEN w.since + INTERVAL 3 DAY END AS lapsed, w.attempt AS lapsed_attempt
                FROM w JOIN e ON e.id = w.id AND e.n = w.n + 1 CROSS JOIN LATERAL (SELECT coalesce(w.status = 'PENDING' AND w.since + INTERVAL 3 DAY <= e.ts, false) AS lapses)))))),
      last AS (SELECT * FROM w QUALIFY n = max(n) OVER (PARTITION BY id))
      SELECT id AS notification_id, {ts('t', 'ts')}, event_id, status, attempt, ok AS accepted FROM (
        SELECT id, ts AS t, event_id, status, attempt, ok FROM w WHERE n > 0
        UNION ALL SELECT id, lapsed, NULL, 'LAPSED', lapsed_attempt, true FROM w WHERE lapsed IS NOT NULL
        UNION ALL SELECT id, since + INTERVAL 3 DAY, NULL, 'LAPSED', attempt, true FROM last WHERE status = 'PENDING' AND since + INTERVAL 3 DAY < {END})""",
}

# Stored tables.
TICKS = f"ticks AS (SELECT TIMESTAMP '1998-06-01 02:45:00' + to_minutes(15 * r_regionkey) AS now FROM region)"
REACHED = "u.active AND NOT u.muted AND NOT u.quiet"
SQL |= {
    "stored_upsert": f"SELECT o_orderkey % 5000 AS k, max(o_orderkey) AS version, {ts('arg_min(o_orderdate, o_orderkey)', 'first_seen_at')}, arg_max(o_orderstatus, o_orderkey) AS state FROM orders WHERE o_orderkey % 5000 % 11 <> 0 GROUP BY o_orderkey % 5000",
    "stored_replace": """SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, (c_custkey % 2 = 0)::INT AS before
      FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 < 3""",
    "stream_reminders": f"""{BASE}, {USERS}, {TICKS},
      due AS (SELECT u.user_id, i.id AS item_id, 'REMINDER' AS kind, strftime(i.due_at, '%Y-%m-%dT%H') AS key, now FROM ticks JOIN users u ON {REACHED} AND u.reminders
        JOIN live i ON {MEETS} WHERE i.due_at > now AND i.due_at <= now + INTERVAL 1 DAY QUALIFY row_number() OVER (PARTITION BY now, u.user_id ORDER BY i.due_at, i.id) <= 5),
      digest AS (SELECT DISTINCT u.user_id, '__WEEKLY_DIGEST__' AS item_id, 'WEEKLY_DIGEST' AS kind, '1998-W23' AS key, now FROM ticks JOIN users u ON {REACHED} AND u.digest
        JOIN live i ON {MEETS} WHERE hour(now) = 3 AND minute(now) < 15 AND coalesce(i.due_at, i.starts_at) BETWEEN now AND now + INTERVAL 7 DAY),
      sent AS (SELECT user_id, item_id, kind, key, CASE WHEN user_id % 9 = 0 THEN max(now) ELSE min(now) END AS t FROM (FROM due UNION ALL FROM digest) GROUP BY user_id, item_id, kind, key)
      SELECT 'notification:' || user_id || ':' || kind || ':' || item_id || ':' || key AS id, user_id, item_id, kind, key, CASE WHEN user_id % 9 = 0 THEN 'FAILED' ELSE 'SENT' END AS status, {ts('t', 'ts')}, {ts('t', 'delivered_at')} FROM sent""",
}
SQL |= {
    "gap_groups": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      w AS (SELECT user_id, n, event_id, t AS anchor FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.t - w.anchor <= 21600 THEN w.anchor ELSE e.t END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
      SELECT user_id, anchor, count(*) AS events, max(event_id) AS last_event FROM w GROUP BY ALL""",
}
SQL |= {
    "scan_outcomes": """WITH r AS (SELECT doc_id, source || ':' || doc_id % 50 AS source_id, substr(sha256(text), 1, 1) AS h FROM documents),
      e AS (SELECT * FROM r WHERE doc_id % 2 = 0 AND doc_id % 50 < 40), l AS (SELECT source_id, arg_max(h, doc_id) AS last FROM e GROUP BY source_id),
      f AS (SELECT *, CASE WHEN doc_id % 10 = 1 THEN 304 WHEN doc_id % 14 = 3 THEN 503 ELSE 200 END AS code, doc_id % 22 = 5 AS wrong FROM r WHERE doc_id % 2 = 1),
      o AS (SELECT f.*, last, wrong OR code = 503 OR (code = 304 AND last IS NULL) OR (code = 200 AND h IS NULL) AS failed, EXISTS (SELECT 1 FROM e WHERE e.source_id = f.source_id AND e.h = f.h) AS had FROM f LEFT JOIN l USING (source_id))
      SELECT doc_id, source_id, CASE WHEN failed THEN 'FAILED' WHEN code = 304 THEN 'UNCHANGED' WHEN last IS NULL THEN 'FETCHED' WHEN had THEN 'UNCHANGED' ELSE 'CHANGED' END AS status,
        CASE WHEN failed OR code = 304 THEN last ELSE h END AS last_good FROM o""",
}

HAY = "lower(title || chr(1) || summary || chr(1) || statement)"
SQL |= {
    "indexed_all_tokens": f"{BASE} SELECT {COLS} FROM live WHERE contains({HAY}, 'nation_1') AND contains({HAY}, 'clerk 1') AND contains({HAY}, 'u')",
    "indexed_any_token": f"{BASE} SELECT {COLS} FROM live WHERE regexp_matches({HAY}, 'customer#00000001|calendar notice|no such word')",
    "nearest_vectors": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS e FROM embeddings), s AS (SELECT q.id AS query_id, v.id, array_cosine_similarity(v.e, q.e) AS s FROM v JOIN v q ON q.id % 50 = 0)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank, id, round(s, 6) AS score FROM s QUALIFY rank <= 6""",
}


def class_members(threshold: float, same: bool) -> str:
    """A document's class of equal token sets, and the pairs of the similarity join that it is in."""
    by = "list_sort(toks), source" if same else "list_sort(toks)"
    return f"""WITH pairs AS ({jaccard_pairs(threshold, same)}), {TEXT_CLAIMS}, ends AS (SELECT "left" AS id FROM pairs UNION ALL SELECT "right" FROM pairs), n AS (SELECT id, count(*) AS links FROM ends GROUP BY id)
      SELECT id, first_value(id) OVER (PARTITION BY {by} ORDER BY pos) AS class_id, count(*) OVER (PARTITION BY {by}) AS members, coalesce(links, 0) AS links FROM c LEFT JOIN n USING (id)"""


SQL |= {
    "similarity_classes": class_members(0.80, False),
    "conflict_classes": class_members(0.65, True),
    "similarity_class_links": f"""WITH {TEXT_CLAIMS.replace("c AS", "docs AS", 1)}, c AS (SELECT min(pos) AS pos, arg_min(id, pos) AS id, min(pos)::VARCHAR AS source, min(pos)::VARCHAR AS fp, any_value(toks) AS toks FROM docs GROUP BY list_sort(toks)),
      {jaccard_pairs(0.80, False).split(TEXT_CLAIMS + ", ")[1].replace(", identical FROM s", " FROM s")}""",
}

STATED = """['CORRECTS','SUPERSEDES','CONFLICTS'][1 + ((o_orderkey // 9) % 3)::INT]"""
REASON = "['new claim explicitly corrects an earlier claim','new claim supersedes the earlier claim','claims describe the same logical subject with incompatible statements'][1 + ((o_orderkey // 9) % 3)::INT]"
HTML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
LF = "chr(10)"
WHEN = "strftime({0}, '%Y-%m-%d %H:%M')"
FIRST_FIVE = """o AS (SELECT o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, o_orderkey AS k, 'kind &lt;' || o_orderkey % 2 || '&gt;' AS title, 'https://x.example.org/?a=1&amp;b=' || o_orderkey % 3 % 2 AS url,
  [o_orderstatus, 'by ' || o_orderpriority, o_orderstatus] AS facts, o_orderdate AS d FROM orders QUALIFY rank <= 5)"""
SQL |= {
    "explicit_edges": f"""WITH p AS (SELECT 'claim:' || o_orderkey AS a, 'claim:' || (o_orderkey + 1) AS b, {STATED} AS kind, {REASON} AS reason FROM orders WHERE o_orderkey % 9 = 0)
      SELECT 'rel:' || {SHORT.format("kind || chr(0) || least(a, b) || chr(0) || greatest(a, b)", 32)} AS id, a AS left_claim_id, b AS right_claim_id, kind, {ts(NOW, 'created_at')}, reason FROM p""",
    "message_part_texts": f"""WITH RECURSIVE d AS (SELECT doc_id, replace(text, '. ', '.' || {LF} || {LF}) AS w FROM documents), s AS (SELECT doc_id, w, string_split(w, {LF} || {LF}) AS bs FROM d WHERE length(w) > 300),
      r AS (SELECT doc_id, 0 AS i, '' AS held, []::VARCHAR[] AS parts FROM s UNION ALL
        SELECT doc_id, i + 1, CASE WHEN length(j) <= 300 THEN j WHEN length(b) > 300 THEN '' ELSE b END,
          CASE WHEN length(j) <= 300 THEN parts ELSE list_concat(parts, CASE WHEN held = '' THEN [] ELSE [held] END, CASE WHEN length(b) > 300 THEN list_transform(range(0, length(b), 300), lambda o: substr(b, o + 1, 300)) ELSE [] END) END
        FROM (SELECT r.*, bs[i + 1] AS b, CASE WHEN held = '' THEN bs[i + 1] ELSE held || {LF} || {LF} || bs[i + 1] END AS j FROM r JOIN s USING (doc_id) WHERE i < len(bs)) x),
      p AS (SELECT doc_id, list_concat(parts, CASE WHEN held = '' THEN [] ELSE [held] END) AS parts FROM r JOIN s USING (doc_id) WHERE i = len(bs) UNION ALL SELECT doc_id, [w] FROM d WHERE length(w) <= 300)
      SELECT doc_id, unnest(range(0, len(parts))) AS n, sha256(unnest(parts)) AS sha256 FROM p""",
    "list_messages": f"""WITH {FIRST_FIVE}, f AS (SELECT user_id, rank, title, url, unnest(facts) AS fact, unnest([0, 1, 2]) AS n FROM o),
      g AS (SELECT *, min(rank) OVER (PARTITION BY user_id, title, url) AS first, row_number() OVER (PARTITION BY user_id, title, url, fact ORDER BY rank, n) AS seen FROM f),
      b AS (SELECT user_id, title, url, first, string_agg('• ' || fact, {LF} ORDER BY rank, n) AS facts FROM g WHERE rank = first OR seen = 1 GROUP BY ALL),
      s AS (SELECT b.*, row_number() OVER (PARTITION BY b.user_id ORDER BY first) AS no, array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'A&amp;B' END, CASE WHEN k % 5 <> 0 THEN 'Year ' || k % 5 END], lambda x: x IS NOT NULL), ' · ') AS scope,
        array_to_string(list_filter([CASE WHEN k % 7 > 0 THEN 'Due: ' || {WHEN.format('d')} END, CASE WHEN k % 4 = 0 THEN 'Ends: ' || {WHEN.format('d')} END], lambda x: x IS NOT NULL), ' · ') AS dates FROM b JOIN o ON o.user_id = b.user_id AND o.rank = b.first),
      m AS (SELECT user_id, string_agg('<b>' || no || '. ' || title || '</b>' || {LF} || facts || CASE WHEN scope <> '' THEN {LF} || 'Applies to: ' || scope ELSE '' END || CASE WHEN dates <> '' THEN {LF} || dates ELSE '' END || {LF} || '✓ Officially verified' || {LF} || '🔗 <a href="' || url || '">Official source</a>', {LF} || {LF} ORDER BY no) AS listed FROM s GROUP BY user_id)
      SELECT c_custkey AS user_id, CASE WHEN listed IS NULL THEN '<b>Verified ORDER results</b>' || {LF} || 'No matching verified information found.' ELSE '<b>Verified order information</b>' || {LF} || {LF} || listed END AS message FROM customer LEFT JOIN m ON c_custkey = user_id""",
    "item_texts": f"""WITH {ITEMS}, x AS (SELECT *, concat_ws(' · ', program, branch, 'Year ' || yr, 'Semester ' || semester) AS scope, concat_ws(' · ', 'Due: ' || {WHEN.format('due_at')}, 'Starts: ' || {WHEN.format('starts_at')}) AS dates FROM items)
      SELECT id, concat_ws({LF}, '<b>' || title || '</b>', summary, CASE WHEN scope <> '' THEN '<b>Applies to:</b> ' || scope END, CASE WHEN dates <> '' THEN dates END,
        'State: ' || CASE WHEN k % 3 = 0 THEN 'Supersedes an earlier item' WHEN k % 2 = 0 THEN 'Changed from an earlier item' WHEN k % 5 = 0 THEN 'Corrects an earlier item' ELSE 'Current' END,
        'Source: <a href="https://source' || k % 6 || '.example.org/items/' || k || '">official source</a>') AS message FROM x""",
    "preference_texts": f"""WITH {USERS} SELECT user_id, concat_ws({LF}, '<b>Your settings</b>', 'Program: ' || coalesce(program, 'not set'), 'Branch: ' || coalesce(branch, 'not set'), 'Year: ' || coalesce(yr::VARCHAR, 'not set'), 'Semester: not set',
      'Categories: ' || CASE WHEN len(cats) = 0 THEN 'none' ELSE array_to_string(cats, ', ') END, 'Reminders: ' || CASE WHEN reminders THEN 'on' ELSE 'off' END, 'Weekly digest: ' || CASE WHEN digest THEN 'on' ELSE 'off' END,
      'Muted: ' || CASE WHEN muted THEN 'yes' ELSE 'no' END, 'Quiet hours: ' || CASE WHEN quiet THEN '22:00–07:00 (UTC)' ELSE 'off' END) AS message FROM users""",
    "answer_texts": f"""WITH c AS (SELECT o_orderkey, o_orderstatus, [o_orderkey % 4, o_orderkey % 3] AS cs FROM orders)
      SELECT o_orderkey, '<b>Answer</b>' || {LF} || {LF} || 'Status is &lt;' || o_orderstatus || '&gt;' || {LF} || {LF} || '<b>Verified evidence</b>' || {LF} ||
        array_to_string(list_transform(list_filter(cs, lambda n: n < 3), lambda n: '• <a href="https://x.example.org/?n=' || n || '&amp;m">Note ' || n || ' &lt;of&gt; ' || o_orderkey || '</a>'), {LF}) AS message FROM c""",
    "whole_numbers": "SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 3) AND event_id % 13 BETWEEN 1 AND 10 THEN event_id % 13 END AS year FROM events",
    "claims_all_publishable": SQL["publishable"],
}

PAGES = NOTICES.replace("notices AS", "plain AS", 1) + r""", notices AS (SELECT k, source_id, url, source_id || chr(10) || array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM plain)"""


def of_pages(sql: str) -> str:
    return sql.replace(NOTICES, PAGES)


SQL["html_structure"] = f"""WITH {PAGES}, h AS (SELECT k, lower(source_id || ' ' || text) AS h FROM notices), a AS ({of_pages(SQL['extract_dates'])}), dl AS ({of_pages(statements(DEADLINE, False))}), ev AS ({of_pages(statements(EVENT, True))}),
  cl AS (WITH {LINES}, {dates('s', 'k, sn')} SELECT k, count(DISTINCT sn) AS n FROM dated GROUP BY k),
  d AS (SELECT k, string_agg(substr("at", 1, 10) || ' ' || title, '|' ORDER BY n) AS x FROM dl GROUP BY k), e AS (SELECT k, string_agg(substr("at", 1, 10) || ' ' || title, '|' ORDER BY n) AS x FROM ev GROUP BY k), c AS (SELECT k, count(*) AS n FROM a GROUP BY k)
  SELECT k, source_id AS title, sha256(text) AS sha256, coalesce(c.n, 0) AS dates, coalesce(d.x, '') AS deadlines, coalesce(e.x, '') AS events, coalesce(cl.n, 0) AS calendar, {category('h')} AS notice_category
  FROM notices JOIN h USING (k) LEFT JOIN c USING (k) LEFT JOIN d USING (k) LEFT JOIN e USING (k) LEFT JOIN cl USING (k)"""
