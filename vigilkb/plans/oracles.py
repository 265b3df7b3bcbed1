"""The registered queries as plain SQL over the same tables, for comparison."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

SPACE = r"[\s\x0b\x{85}\p{Z}]+"

LOG = """
log AS (
  SELECT event_id + 1 AS seq,
         CASE event_type WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'insert' END AS op,
         'u' || user_id AS doc_id
  FROM events),
stamped AS (
  SELECT *, min(CASE WHEN op IN ('update', 'delete') THEN seq END) OVER
    (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS valid_to
  FROM log)"""

_CHUNKS = """
arr AS (
  SELECT v.event_id + 1 AS seq, d.doc_id AS text_id,
         CASE v.event_type WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'insert' END AS op,
         'u' || v.user_id AS doc_id, strftime(v.ts, '%Y-%m-%d') AS day,
         CASE WHEN v.event_type = 'signup' THEN ['u' || regexp_extract(v.props, '([0-9]+)', 1)]
              ELSE []::VARCHAR[] END AS derived_from,
         d.text, d.source AS source_id, d.lang AS topic, 'label-' || e.label AS entity,
         e.embedding::DOUBLE[] AS vec,
         coalesce(regexp_extract(p.html, '<title>([^<]*)</title>', 1), '') AS title
  FROM events v JOIN embeddings e ON e.vec_id = {vec} JOIN documents d ON d.doc_id = {text}
  LEFT JOIN pages p ON p.page_id = {page}),
chunks AS (
  SELECT *, seq AS valid_from FROM (
    SELECT *, min(CASE WHEN op IN ('update', 'delete') THEN seq END) OVER
      (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS valid_to
    FROM arr) WHERE op <> 'delete')"""

_AROUND = "v.event_id % (SELECT count(*) FROM {})"


def _paired(vec: str, text: str, page: str) -> str:
    return _CHUNKS.replace("{vec}", vec).replace("{text}", text).replace("{page}", page)


# every event takes part; the shorter tables are gone through again and again
CHUNKS = _paired(*[_AROUND.format(t) for t in ("embeddings", "documents", "pages")])


def live(c: str, at: str) -> str:
    return f"{c}.valid_from < {at} AND ({c}.valid_to IS NULL OR {c}.valid_to > {at})"


def knn(k: int = 5, name: str = "knn") -> str:
    return f"""
{name} AS (
  SELECT seq, cand, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, cand) AS rank FROM (
      SELECT q.seq, c.seq AS cand, round(list_dot_product(q.vec, c.vec), 6) AS score
      FROM chunks q JOIN chunks c ON {live('c', 'q.seq')}))
  WHERE rank <= {k})"""


FACETS = """
f AS (
  SELECT seq, doc_id, valid_from, valid_to, 'entity' AS kind, entity AS value FROM chunks
  UNION ALL SELECT seq, doc_id, valid_from, valid_to, 'date', day FROM chunks
  UNION ALL SELECT seq, doc_id, valid_from, valid_to, 'topic', topic FROM chunks
  UNION ALL SELECT seq, doc_id, valid_from, valid_to, 'source', coalesce(nullif(source_id, ''), doc_id) FROM chunks
  UNION ALL SELECT DISTINCT seq, doc_id, valid_from, valid_to, 'title', tok FROM (
    SELECT seq, doc_id, valid_from, valid_to, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS tok FROM chunks)
  WHERE length(tok) > 2 AND tok NOT IN
    ('the','a','an','of','for','to','and','in','on','at','by','with','is','are','as','or'))"""

WEIGHTS = f"""
pop AS (
  SELECT r.seq, count(c.seq) AS nc, count(DISTINCT c.doc_id) AS nd
  FROM chunks r LEFT JOIN chunks c ON {live('c', 'r.seq')} GROUP BY r.seq),
w AS (
  SELECT g.seq, kind, value, CASE WHEN kind = 'source' THEN dd ELSE dc END AS df,
         greatest(CASE WHEN kind = 'source' THEN nd ELSE nc END, 1) AS n
  FROM (SELECT r.seq, r.kind, r.value, count(c.seq) AS dc, count(DISTINCT c.doc_id) AS dd
        FROM f r LEFT JOIN f c ON c.kind = r.kind AND c.value = r.value AND {live('c', 'r.seq')}
        GROUP BY r.seq, r.kind, r.value) g JOIN pop USING (seq)),
wi AS (SELECT *, ln((n + 1.0) / (df + 1.0)) + 1 AS idf FROM w)"""

METADATA = f"""
meta AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, cand) AS rank FROM (
      SELECT w.seq, c.seq AS cand, round(sum(w.idf), 6) AS score, count(*) AS shared
      FROM wi w JOIN f c ON c.kind = w.kind AND c.value = w.value AND {live('c', 'w.seq')}
      GROUP BY w.seq, c.seq)) WHERE rank <= 5)"""

GRAPH = """
frozen AS (
  SELECT k.seq, k.cand, k.score, a.valid_from,
         CASE WHEN a.valid_to IS NULL THEN b.valid_to WHEN b.valid_to IS NULL THEN a.valid_to
              ELSE least(a.valid_to, b.valid_to) END AS valid_to
  FROM knn k JOIN chunks a ON a.seq = k.seq JOIN chunks b ON b.seq = k.cand WHERE k.score > 0),
docs AS (SELECT doc_id, min(seq) AS doc_from FROM chunks GROUP BY doc_id),
edges AS (
  SELECT 'doc:' || doc_id AS src, 'chunk:' || seq AS dst, 'contains' AS relation, 'structural' AS tier,
         1.5::DOUBLE AS weight, valid_from, NULL::BIGINT AS valid_to FROM chunks
  UNION ALL SELECT 'chunk:' || seq, 'date:' || day, 'on_date', 'structural', 0.4, valid_from, NULL FROM chunks
  UNION ALL SELECT 'chunk:' || seq, 'topic:' || topic, 'has_topic', 'structural', 0.7, valid_from, NULL FROM chunks
  UNION ALL SELECT 'chunk:' || seq, 'ent:' || entity, 'mentions', 'structural', 0.5, valid_from, NULL FROM chunks
  UNION ALL SELECT 'chunk:' || c.seq, 'doc:' || d.doc_id, 'derived_from', 'structural', 2.5, c.valid_from, NULL
    FROM (SELECT seq, valid_from, unnest(derived_from) AS k FROM chunks) c
    JOIN docs d ON d.doc_id = c.k AND d.doc_from <= c.valid_from
  UNION ALL SELECT 'chunk:' || seq, 'chunk:' || cand, 'similar_to', 'semantic', score, valid_from, valid_to FROM frozen
  UNION ALL SELECT 'chunk:' || cand, 'chunk:' || seq, 'similar_to', 'semantic', score, valid_from, valid_to FROM frozen)"""

NODES = """
made AS (
  SELECT 'chunk:' || seq AS node_id, 'chunk' AS type, valid_from, 0 AS stage, valid_to FROM chunks
  UNION ALL SELECT 'doc:' || doc_id, 'document', valid_from, 1, NULL FROM chunks
  UNION ALL SELECT 'date:' || day, 'date', valid_from, 2, NULL FROM chunks
  UNION ALL SELECT 'topic:' || topic, 'topic', valid_from, 3, NULL FROM chunks
  UNION ALL SELECT 'ent:' || entity, 'entity', valid_from, 4, NULL FROM chunks),
nodes AS (
  SELECT node_id, type, valid_from, valid_to,
         row_number() OVER (ORDER BY valid_from, stage, node_id) - 1 AS ord
  FROM (SELECT node_id, min(type) AS type, min(valid_from) AS valid_from, min(stage) AS stage,
               max(valid_to) AS valid_to FROM made GROUP BY node_id))"""

ANCHORS = """
anchors AS (
  SELECT c.seq, n.node_id FROM chunks c JOIN nodes n
    ON n.node_id IN ('date:' || c.day, 'topic:' || c.topic, 'ent:' || c.entity) AND n.valid_from < c.seq
  UNION ALL
  SELECT q.seq, 'doc:' || arg_max(c.doc_id, c.seq) FROM chunks q JOIN chunks c
    ON c.source_id = q.source_id AND c.seq < q.seq GROUP BY q.seq)"""

LINKS = """
links AS (
  SELECT src AS n, dst AS o, valid_from, valid_to FROM edges
  UNION ALL SELECT dst, src, valid_from, valid_to FROM edges)"""

SEEDS = f"""
seeds AS (
  SELECT a.seq, a.node_id, 1.0 / (1 + count(DISTINCT l.o)) AS mass
  FROM anchors a JOIN links l ON l.n = a.node_id AND {live('l', 'a.seq')} GROUP BY a.seq, a.node_id)"""

HYBRID = """
hseeds AS (
  SELECT seq, 'vector' AS population, 'chunk:' || cand AS node_id, 1::BIGINT AS members, score * score AS mass
    FROM knn WHERE score > 0
  UNION ALL
  SELECT c.seq, 'entity', 'ent:' || c.entity, 1, 1.0 / (1 + count(*))
    FROM chunks c JOIN chunks m ON m.entity = c.entity AND m.seq < c.seq GROUP BY c.seq, c.entity
  UNION ALL
  SELECT c.seq, 'prior', 'doc:' || c.doc_id, count(*), 3.0 * count(*)
    FROM chunks c JOIN chunks m ON m.doc_id = c.doc_id AND m.seq < c.seq GROUP BY c.seq, c.doc_id)"""


GOLD = """
firsts AS (SELECT entity, arg_min(doc_id, seq) AS first_doc FROM arr GROUP BY entity),
gold AS (
  SELECT seq, seq - 1 AS position, op, doc_id, expected_label,
         CASE WHEN expected_label = 'clean' THEN []::VARCHAR[]
              WHEN len(derived_from) = 0 OR derived_from[1] = first_doc THEN [first_doc]
              ELSE [derived_from[1], first_doc] END AS implicates
  FROM (SELECT a.*, first_doc,
               CASE WHEN l.toxic = 1 THEN 'contradiction' WHEN l.quality = 0 THEN 'duplicate'
                    WHEN len(a.derived_from) > 0 THEN 'supersedes' ELSE 'clean' END AS expected_label
        FROM arr a JOIN firsts USING (entity) LEFT JOIN labels l ON l.doc_id = a.text_id))"""


def judged(name: str = "calls", source: str = "knn") -> str:
    return f"""
{name} AS (
  SELECT g.seq, any_value(g.doc_id) AS doc_id,
         CASE WHEN count(c.doc_id) FILTER (WHERE list_contains(g.implicates, c.doc_id)) > 0
              THEN any_value(g.expected_label) ELSE 'clean' END AS label,
         coalesce(list_sort(list(DISTINCT c.doc_id) FILTER (WHERE c.doc_id IS NOT NULL)), []::VARCHAR[]) AS candidate_docs,
         coalesce(list_sort(list(DISTINCT c.doc_id) FILTER (WHERE list_contains(g.implicates, c.doc_id))), []::VARCHAR[]) AS implicated_docs,
         coalesce(list_sort(list(c.seq) FILTER (WHERE list_contains(g.implicates, c.doc_id))), []::BIGINT[]) AS implicated_ids
  FROM gold g LEFT JOIN {source} k ON k.seq = g.seq LEFT JOIN chunks c ON c.seq = k.cand
  WHERE g.op <> 'delete' GROUP BY g.seq)"""


def records(name: str = "rec", calls: str = "calls") -> str:
    return f"""
{name} AS (
  SELECT g.position, g.seq, g.doc_id, g.op AS event_type, g.expected_label, g.implicates,
         coalesce(c.candidate_docs, []::VARCHAR[]) AS candidate_docs, c.label AS verdict,
         coalesce(c.implicated_docs, []::VARCHAR[]) AS implicated_found,
         coalesce(c.label <> 'clean' AND list_has_any(g.implicates, c.implicated_docs), false) AS detected
  FROM gold g LEFT JOIN {calls} c USING (seq))"""


def summary(rec: str = "rec") -> str:
    return f"""
  SELECT 'vector-only' AS baseline,
    count(*) FILTER (WHERE expected_label <> 'clean') AS n_conflict_events,
    count(*) FILTER (WHERE expected_label = 'clean') AS n_clean_events,
    count(*) FILTER (WHERE expected_label <> 'clean' AND detected) AS detected_count,
    round(count(*) FILTER (WHERE expected_label <> 'clean' AND detected)::DOUBLE / count(*) FILTER (WHERE expected_label <> 'clean'), 4) AS detect_rate,
    round((sum(len(list_intersect(implicated_found, implicates))) FILTER (WHERE expected_label <> 'clean'))::DOUBLE
          / sum(len(implicates)) FILTER (WHERE expected_label <> 'clean'), 4) AS affected_recall,
    round((sum(len(candidate_docs)) FILTER (WHERE expected_label = 'clean'))::DOUBLE / count(*) FILTER (WHERE expected_label = 'clean'), 4) AS fp_pressure_mean,
    (sum(len(candidate_docs)) FILTER (WHERE expected_label = 'clean'))::BIGINT AS fp_pressure_total
  FROM {rec}"""


def labels_of(rec: str = "rec") -> str:
    return f"""
  SELECT 'vector-only' AS baseline, expected_label, count(*) AS total, count(*) FILTER (WHERE detected) AS detected,
         round(count(*) FILTER (WHERE detected)::DOUBLE / count(*), 4) AS rate
  FROM {rec} WHERE expected_label <> 'clean' GROUP BY expected_label"""


def sql(name: str, *ctes: str, body: str, recursive: bool = False) -> None:
    head = "WITH RECURSIVE " if recursive else "WITH "
    ORACLES[name] = (head + ",".join(ctes) if ctes else "") + "\n" + body


# ----------------------------------------------------------------- log and lifecycle

sql("event_log_seq", body="""
SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_id,
       CASE event_type WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'insert' END AS op,
       'u' || user_id AS doc_id FROM events""")
sql("log_roundtrip", LOG, body="SELECT seq, op AS type, doc_id FROM log")
sql("doc_lifecycle", LOG, body="""
SELECT seq, doc_id, op, seq AS valid_from, valid_to, (valid_to IS NULL)::INTEGER AS live
FROM stamped WHERE op <> 'delete'""")
sql("state_at_seq", LOG, body="""
SELECT seq, doc_id, seq AS valid_from, valid_to FROM stamped, (SELECT count(*) // 2 AS h FROM events)
WHERE op <> 'delete' AND seq <= h AND (valid_to IS NULL OR valid_to > h)""")
TIMELINE = """
timeline AS (
  SELECT seq, (sum(delta) OVER (ORDER BY seq))::BIGINT AS active_docs FROM (
    SELECT seq, (op <> 'delete')::INT
             - coalesce((lag(op) OVER (PARTITION BY doc_id ORDER BY seq) <> 'delete')::INT, 0) AS delta
    FROM %s))"""
sql("active_doc_count_timeline", LOG, TIMELINE % "log", body="SELECT * FROM timeline")
sql("source_id_default", body="""
SELECT doc_id, coalesce(nullif(CASE lang WHEN 'en' THEN source WHEN 'de' THEN '' END, ''), doc_id::VARCHAR) AS source_id
FROM documents""")

# ----------------------------------------------------------------- scalar functions

KEY = rf"lower(trim(regexp_replace(text, '{SPACE}', ' ', 'g')))"
sql("normalize_entity", body=f"SELECT doc_id, md5({KEY}) AS key_md5 FROM documents")
sql("normalize_topic", body="""
SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug_md5
FROM documents""")
sql("normalize_date", body="""
SELECT event_id, CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%d') WHEN 'view' THEN strftime(ts, '%m-%d')
  WHEN 'signup' THEN NULL ELSE 'early-term-' || user_id END AS date_key FROM events""")
sql("title_tokens", body="""
SELECT DISTINCT page_id, token FROM (
  SELECT page_id, unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z0-9]+')) AS token FROM pages)
WHERE length(token) > 2 AND token NOT IN
  ('the','a','an','of','for','to','and','in','on','at','by','with','is','are','as','or')""")
sql("mention_signature", body=f"SELECT doc_id, md5(lang || '|' || {KEY}) AS sig_md5 FROM documents")
sql("node_ids", body="""
SELECT doc_id, 'chunk:' || doc_id AS chunk_node, 'doc:' || source AS doc_node, 'topic:' || lang AS topic_node FROM documents""")


def _lexicon_values() -> str:
    from vigilkb.functions.lexicon import DATES, ORGS, PERSONS, TOPICS

    rows, place = [], 0
    q = lambda s: "'" + s.replace("'", "''") + "'"
    for kind, book in (("person", PERSONS), ("org", ORGS)):
        for name, (patterns, context) in book.items():
            rows += [(place, kind, name, context, i, p, "") for i, p in enumerate(patterns)]
            place += 1
    for slug, patterns in TOPICS.items():
        rows += [(place, "topic", p, "", i, p, slug) for i, p in enumerate(patterns)]
        place += 1
    for shown, patterns in DATES.items():
        rows += [(place, "date", shown, "", i, p, "") for i, p in enumerate(patterns)]
        place += 1
    return "lex(place, type, surface, context, i, pattern, slug) AS (VALUES " + ", ".join(
        f"({pl}, {q(k)}, {q(s)}, {q(c)}, {i}, {q(p)}, {q(g)})" for pl, k, s, c, i, p, g in rows
    ) + ")"


sql("lexicon_mentions", _lexicon_values(), body="""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos, type, surface, context FROM (
  SELECT doc_id, place, type, arg_min(surface, i) AS surface, any_value(context) AS context
  FROM documents JOIN lex ON contains(lower(text), pattern) GROUP BY doc_id, place, type)""")
sql("topic_snap", _lexicon_values(), body=f"""
SELECT doc_id, coalesce(slug, '-') AS slug FROM documents LEFT JOIN (
  SELECT doc_id, arg_min(slug, place) AS slug FROM documents JOIN lex ON type = 'topic' AND contains({KEY}, pattern)
  GROUP BY doc_id) USING (doc_id)""")
NO_KNN = "knn AS (SELECT 0::BIGINT AS seq, 0::BIGINT AS cand, 0.0::DOUBLE AS score, 1::BIGINT AS rank WHERE false)"
sql("edge_tiers", CHUNKS, NO_KNN, GRAPH, body="""
SELECT relation, tier, count(*) AS n, round(sum(weight), 6) AS weight FROM edges GROUP BY relation, tier""")

# ----------------------------------------------------------------- vectors

sql("knn_candidates", CHUNKS, knn(), body="SELECT * FROM knn")
EMBED = """
tok AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents
  UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM benchmark),
slots AS (SELECT side, id, ('0x' || substr(md5(t), 1, 4))::INT % 64 AS slot, count(*)::DOUBLE AS n FROM tok GROUP BY ALL),
norms AS (SELECT side, id, sqrt(sum(n * n)) AS norm FROM slots GROUP BY side, id)"""
sql("knn_query_topk", EMBED, body="""
SELECT item_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.n / nq.norm * d.n / nd.norm), 6) AS score
    FROM slots q JOIN slots d ON d.slot = q.slot AND d.side = 'd' AND q.side = 'q'
    JOIN norms nq ON nq.side = 'q' AND nq.id = q.id JOIN norms nd ON nd.side = 'd' AND nd.id = d.id
    GROUP BY q.id, d.id)) WHERE rank <= 5""")
sql("similar_to_freeze", CHUNKS, knn(), GRAPH, body="SELECT seq, cand, score, valid_from, valid_to FROM frozen")
sql("neighbour_snippets", CHUNKS, knn(), body="""
SELECT k.seq, md5('NEW CHUNK (chunk_id=' || k.seq || '):' || chr(10) || any_value(q.text) || chr(10) || chr(10) || 'NEIGHBORS:' || chr(10)
  || string_agg('  [chunk_id=' || k.cand || '] ' || substr(c.text, 1, 300), chr(10) ORDER BY k.rank)) AS prompt_md5
FROM knn k JOIN chunks q ON q.seq = k.seq JOIN chunks c ON c.seq = k.cand GROUP BY k.seq""")

# ----------------------------------------------------------------- metadata

sql("facets_long", CHUNKS, FACETS, body="SELECT seq, kind, value FROM f")
sql("facet_idf", CHUNKS, FACETS, WEIGHTS, body="SELECT seq, kind, value, df, n, round(idf, 6) AS idf FROM wi")
sql("metadata_candidates", CHUNKS, FACETS, WEIGHTS, METADATA, body="SELECT seq, cand, score, rank FROM meta")
sql("facet_shared", CHUNKS, FACETS, WEIGHTS, METADATA, body="SELECT seq, cand, shared FROM meta")

# ----------------------------------------------------------------- entities

PAIRS = """
m AS (SELECT vec_id + 1 AS id, 't' || label AS type, vec_id, embedding::DOUBLE[] AS vec FROM embeddings),
near AS (
  SELECT q.id, c.id AS ent, q.type, round(list_dot_product(q.vec, c.vec), 6) AS score
  FROM m q JOIN m c ON c.type = q.type AND c.id < q.id)"""
sql("entity_block_topk", PAIRS, body="""
SELECT id, ent, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ent) AS rank FROM near WHERE score >= 0.1)
WHERE rank <= 10""")
sql("three_band", PAIRS, body="""
SELECT m.id, max(n.score) AS score,
  CASE WHEN max(n.score) IS NULL OR max(n.score) < 0.22 THEN 'low' WHEN max(n.score) >= 0.30 THEN 'high' ELSE 'gray' END AS band
FROM m LEFT JOIN near n USING (id) GROUP BY m.id""")
FOLD = """
close AS (SELECT id, list(ent) AS ents FROM near WHERE score >= 0.30 GROUP BY id),
step(i, canon) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT s.i + 1, CASE WHEN coalesce(list_has_any(s.canon, c.ents), false) THEN s.canon ELSE list_append(s.canon, s.i + 1) END
  FROM step s LEFT JOIN close c ON c.id = s.i + 1 WHERE s.i < (SELECT count(*) FROM m)),
canon AS (SELECT unnest(canon) AS id FROM step WHERE i = (SELECT count(*) FROM m)),
ents AS (SELECT id, type, type || '-' || row_number() OVER (PARTITION BY type ORDER BY id) AS canonical_id FROM canon JOIN m USING (id)),
top AS (SELECT n.id, max(n.score) AS score, arg_max(e.canonical_id, (n.score, -e.id)) AS top_id
        FROM near n JOIN ents e ON e.id = n.ent GROUP BY n.id),
res AS (
  SELECT m.id AS seq, m.type, m.vec_id,
    CASE WHEN score IS NULL OR score < 0.22 THEN 'low' WHEN score >= 0.30 THEN 'high' ELSE 'gray' END AS band,
    CASE WHEN score >= 0.30 THEN top_id END AS matched,
    coalesce(CASE WHEN score >= 0.30 THEN top_id END, e.canonical_id) AS canonical_id
  FROM m LEFT JOIN top USING (id) LEFT JOIN ents e USING (id))"""
sql("entity_fold", PAIRS, FOLD, recursive=True, body="SELECT seq, type, band, matched, canonical_id FROM res")
sql("alias_clusters", PAIRS, FOLD, recursive=True, body="""
SELECT e.canonical_id, 'Name ' || (e.id - 1) AS name, e.type, string_agg('Name ' || r.vec_id, '|' ORDER BY 'Name ' || r.vec_id) AS aliases
FROM res r JOIN ents e USING (canonical_id) GROUP BY e.canonical_id, e.id, e.type""")
sql("resolution_log", PAIRS, FOLD, recursive=True, body="""
SELECT CASE WHEN matched IS NULL THEN 'entity_create' ELSE 'entity_merge' END AS event, type, band, count(*) AS n
FROM res GROUP BY ALL""")

sql("node_attributes_at", PAIRS, FOLD, recursive=True, body="""
SELECT r.seq, e.canonical_id, 'Name ' || (e.id - 1) AS name, e.type, e.id AS first_seq,
       string_agg('Name ' || a.vec_id, '|' ORDER BY 'Name ' || a.vec_id) AS aliases
FROM res r JOIN ents e ON e.canonical_id = r.matched JOIN res a ON a.canonical_id = r.matched AND a.seq < r.seq
GROUP BY r.seq, e.canonical_id, e.id, e.type""")
# one chunk of up to three mentions after another; the state is the list of signatures that have minted
ADJUDICATED = """
n AS (SELECT count(*) * 4 // 5 AS n FROM embeddings),
v AS (SELECT vec_id AS s, 't' || label AS type, embedding::DOUBLE[] AS vec FROM embeddings, n WHERE vec_id < n),
said AS (
  SELECT vec_id // 3 + 1 AS seq, vec_id % 3 AS pos, s, type, CASE WHEN vec_id < n THEN 'Name ' ELSE 'Alias ' END || s AS surface
  FROM embeddings e, n JOIN v ON v.s = e.vec_id % n),
near AS (
  SELECT q.s, list({'e': c.s, 'score': round(list_dot_product(q.vec, c.vec), 6)} ORDER BY round(list_dot_product(q.vec, c.vec), 6) DESC, c.s) AS near
  FROM v q JOIN v c ON c.type = q.type AND c.s <> q.s WHERE round(list_dot_product(q.vec, c.vec), 6) >= 0.18 GROUP BY q.s),
chunk AS (
  SELECT seq, list({'s': s, 'near': coalesce(near, [])} ORDER BY pos) AS m
  FROM (SELECT seq, s, min(pos) AS pos FROM said GROUP BY seq, s) LEFT JOIN near USING (s) GROUP BY seq),
step(seq, canon) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT c.seq, list_concat(step.canon, list_transform(list_filter(c.m, lambda y: NOT list_contains(step.canon, y.s) AND coalesce(
    CASE WHEN list_filter(y.near, lambda x: list_contains(step.canon, x.e))[1].score >= 0.30 THEN false
         WHEN list_filter(y.near, lambda x: list_contains(step.canon, x.e))[1].score >= 0.22
         THEN (y.s + list_filter(y.near, lambda x: list_contains(step.canon, x.e))[1].e) % 2 = 1 ELSE true END, true)), lambda y: y.s))
  FROM step JOIN chunk c ON c.seq = step.seq + 1),
minted AS (
  SELECT s, (SELECT min(seq) FROM step t WHERE list_contains(t.canon, s)) AS since, place
  FROM (SELECT unnest(canon) AS s, generate_subscripts(canon, 1) AS place FROM step WHERE seq = (SELECT max(seq) FROM step))),
ents AS (
  SELECT s, since, type, type || '-' || row_number() OVER (PARTITION BY type ORDER BY place) AS canonical_id FROM minted JOIN v USING (s)),
tops AS (
  SELECT m.seq, m.pos, arg_max(e.canonical_id, (round(list_dot_product(q.vec, c.vec), 6), -e.since)) AS top_id,
         arg_max(e.s, (round(list_dot_product(q.vec, c.vec), 6), -e.since)) AS top, max(round(list_dot_product(q.vec, c.vec), 6)) AS score
  FROM said m JOIN v q USING (s) JOIN ents e ON e.type = m.type AND e.since < m.seq AND e.s <> m.s JOIN v c ON c.s = e.s
  WHERE round(list_dot_product(q.vec, c.vec), 6) >= 0.18 GROUP BY m.seq, m.pos),
res AS (
  SELECT m.seq, m.pos, 'name ' || m.s AS sig, m.type, m.surface,
         CASE WHEN o.since < m.seq THEN 'high' WHEN coalesce(score, 0) < 0.22 THEN 'low' WHEN score >= 0.30 THEN 'high' ELSE 'gray' END AS band,
         CASE WHEN o.since < m.seq THEN o.canonical_id WHEN score >= 0.30 OR (score >= 0.22 AND (m.s + top) % 2 = 0) THEN top_id END AS matched,
         o.canonical_id AS own
  FROM said m LEFT JOIN tops t ON t.seq = m.seq AND t.pos = m.pos LEFT JOIN ents o ON o.s = m.s)"""
sql("entity_fold_adjudicated", ADJUDICATED, """
log AS (
  SELECT seq, pos, CASE WHEN matched IS NULL THEN 'entity_create' ELSE 'entity_merge' END AS event, seq::VARCHAR AS chunk_id, surface AS surface_form,
         CASE WHEN matched IS NOT NULL THEN CASE WHEN band = 'gray' THEN 0.5 ELSE 1.0 END END::DOUBLE AS confidence,
         CASE WHEN matched IS NOT NULL THEN CASE WHEN band = 'gray' THEN 'even' ELSE 'auto-merge (high)' END END AS rationale
  FROM (SELECT *, row_number() OVER (PARTITION BY seq, coalesce(matched, own) ORDER BY pos) AS nth FROM res) WHERE matched IS NOT NULL OR nth = 1)""",
    recursive=True, body="""
SELECT seq, pos, sig, type, band, matched, coalesce(matched, own) AS canonical_id, event, chunk_id, surface_form, confidence, rationale
FROM res LEFT JOIN log USING (seq, pos)""")

# ----------------------------------------------------------------- graph

G = (CHUNKS, knn(), GRAPH)
sql("graph_nodes", CHUNKS, NODES, body="SELECT node_id, type, valid_from, valid_to, ord FROM nodes")
for _name in ("graph_edges", "rebuild_from_log"):
    sql(_name, *G, body="SELECT src, dst, relation, tier, round(weight, 6) AS weight, valid_from, valid_to FROM edges")
sql("edge_weights", *G, body="SELECT relation, count(*) AS n, round(sum(weight), 4) AS weight FROM edges GROUP BY relation")
sql("undirected_projection", *G, body="""
SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(weight), 6) AS weight
FROM edges WHERE valid_to IS NULL GROUP BY ALL""")
sql("walk_digraph", *G, body="""
SELECT src, dst, round(sum(weight), 6) AS weight FROM (
  SELECT src, dst, weight FROM edges WHERE valid_to IS NULL
  UNION ALL SELECT dst, src, weight FROM edges WHERE valid_to IS NULL AND relation NOT IN ('similar_to', 'on_date'))
GROUP BY src, dst""")
sql("degree", *G, body="""
SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node_id""")
sql("anchors_for", CHUNKS, NODES, ANCHORS, body="SELECT seq, node_id FROM anchors")
sql("latest_source_anchor", CHUNKS, NODES, ANCHORS, body="SELECT seq, node_id FROM anchors WHERE node_id LIKE 'doc:%'")
sql("chunk_nodes_for_doc", CHUNKS, body="SELECT 'doc:' || doc_id AS doc_node, 'chunk:' || seq AS chunk_node FROM chunks")
sql("retire_revoke", *G, body="""
SELECT src, dst, relation, valid_to AS revoked_seq FROM edges WHERE tier = 'semantic' AND valid_to IS NOT NULL""")
sql("live_successors", *G, body="""
SELECT DISTINCT e.valid_to AS retired_at, c.seq FROM edges e JOIN chunks c ON 'chunk:' || c.seq IN (e.src, e.dst)
WHERE e.tier = 'semantic' AND e.valid_to IS NOT NULL AND (c.valid_to IS NULL OR c.valid_to > e.valid_to)""")
sql("active_view", *G, NODES, body="""
SELECT src, dst, relation FROM edges e WHERE valid_to IS NULL
  AND src IN (SELECT node_id FROM nodes WHERE valid_to IS NULL) AND dst IN (SELECT node_id FROM nodes WHERE valid_to IS NULL)""")
sql("graph_state_at", *G, NODES, """
h AS (SELECT count(*) // 2 AS h FROM events),
alive AS (SELECT node_id FROM nodes, h WHERE valid_from <= h AND (valid_to IS NULL OR valid_to > h))""", body="""
SELECT src, dst, relation FROM edges, h WHERE valid_from <= h AND (valid_to IS NULL OR valid_to > h)
  AND src IN (SELECT node_id FROM alive) AND dst IN (SELECT node_id FROM alive)""")
sql("graph_snapshot", *G, NODES, body="""
SELECT 'node:' || type AS item, count(*) FILTER (WHERE valid_to IS NULL) AS active,
       count(*) FILTER (WHERE valid_to IS NOT NULL) AS tombstoned FROM nodes GROUP BY type
UNION ALL SELECT 'edge:' || tier, count(*) FILTER (WHERE valid_to IS NULL), count(*) FILTER (WHERE valid_to IS NOT NULL) FROM edges GROUP BY tier
UNION ALL SELECT 'edge:all', count(*) FILTER (WHERE valid_to IS NULL), count(*) FILTER (WHERE valid_to IS NOT NULL) FROM edges""")
sql("entity_cluster_sizes", CHUNKS, body="""
SELECT 'ent:' || entity AS node_id, entity AS key, count(*) FILTER (WHERE valid_to IS NULL) AS active_chunk_count
FROM chunks GROUP BY entity""")
sql("chunk_components", *G, """
pairs AS MATERIALIZED (
  SELECT DISTINCT substr(e.src, 7)::BIGINT AS a, substr(e.dst, 7)::BIGINT AS b FROM edges e
  WHERE e.tier = 'semantic' AND e.valid_to IS NULL),
reach(id, r) AS (
  SELECT seq, seq FROM chunks WHERE valid_to IS NULL
  UNION SELECT reach.id, p.b FROM reach JOIN pairs p ON p.a = reach.r)""", recursive=True, body="""
SELECT component, count(*) AS size FROM (SELECT id, min(r) AS component FROM reach GROUP BY id) GROUP BY component""")
sql("bfs_khop", *G, NODES, ANCHORS, LINKS, f"""
h1 AS (SELECT DISTINCT a.seq, l.o FROM anchors a JOIN links l ON l.n = a.node_id AND {live('l', 'a.seq')}
       WHERE NOT EXISTS (SELECT 1 FROM anchors x WHERE x.seq = a.seq AND x.node_id = l.o)),
c1 AS (SELECT h.seq, n.node_id, n.ord FROM h1 h JOIN nodes n ON n.node_id = h.o
       WHERE n.type = 'chunk' AND (n.valid_to IS NULL OR n.valid_to > h.seq)),
full1 AS (SELECT seq FROM c1 GROUP BY seq HAVING count(*) >= 5),
h2 AS (SELECT DISTINCT h.seq, l.o FROM h1 h JOIN links l ON l.n = h.o AND {live('l', 'h.seq')}
       WHERE h.seq NOT IN (SELECT seq FROM full1)
         AND NOT EXISTS (SELECT 1 FROM anchors x WHERE x.seq = h.seq AND x.node_id = l.o)
         AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seq = h.seq AND x.o = l.o)),
c2 AS (SELECT h.seq, n.node_id, n.ord FROM h2 h JOIN nodes n ON n.node_id = h.o
       WHERE n.type = 'chunk' AND (n.valid_to IS NULL OR n.valid_to > h.seq))""", body="""
SELECT seq, cand, hop, rank FROM (
  SELECT seq, substr(node_id, 7)::BIGINT AS cand, hop, row_number() OVER (PARTITION BY seq ORDER BY hop, ord) AS rank
  FROM (SELECT *, 1::BIGINT AS hop FROM c1 UNION ALL SELECT *, 2::BIGINT FROM c2)) WHERE rank <= 5""")
GS = (*G, NODES, ANCHORS, LINKS, SEEDS)
sql("graph_seeds", *GS, body="SELECT seq, node_id, round(mass, 6) AS mass FROM seeds")
sql("hybrid_seeds", *G, HYBRID, body="SELECT seq, population, node_id, members, round(mass, 6) AS mass FROM hseeds")

# ----------------------------------------------------------------- judging and evaluation

J = (CHUNKS, knn(), GOLD, judged())
sql("oracle_judge", *J, body="""
SELECT seq, doc_id, label, array_to_string(candidate_docs, '|') AS candidate_docs,
       array_to_string(implicated_docs, '|') AS implicated_docs,
       CASE WHEN label = 'clean' THEN 'insert' ELSE 'replace_old' END AS proposed_action FROM calls""")
sql("recency_decisions", *J, body="""
SELECT 'report-' || seq AS report_id, seq, 'update' AS action, unnest(implicated_ids) AS removed FROM calls WHERE label <> 'clean'""")
sql("insert_only_decisions", *J, body="""
SELECT 'report-' || seq AS report_id, seq, 'insert' AS action, 0::BIGINT AS removed FROM calls WHERE label <> 'clean'""")
sql("human_pending", *J, body="""
SELECT 'report-' || seq AS report_id, seq, label FROM calls WHERE label NOT IN ('clean', 'contradiction')""")
sql("judge_call_merge", CHUNKS, knn(1, "k1"), knn(5, "k5"), GOLD, judged("a", "k1"), judged("b", "k5"), body="""
SELECT a.seq, CASE WHEN a.label <> 'clean' THEN a.label ELSE b.label END AS label,
       array_to_string(list_sort(list_distinct(list_concat(a.candidate_docs, b.candidate_docs))), '|') AS candidate_docs,
       array_to_string(list_sort(list_distinct(list_concat(a.implicated_docs, b.implicated_docs))), '|') AS implicated_docs
FROM a JOIN b USING (seq)""")
R = (*J, records())
sql("eval_records", *R, TIMELINE % "arr", body="""
SELECT 'vector-only' AS baseline, position, r.seq, doc_id, event_type, expected_label, array_to_string(implicates, '|') AS implicates,
       len(candidate_docs) AS n_candidates, array_to_string(candidate_docs, '|') AS candidate_docs, verdict,
       array_to_string(implicated_found, '|') AS implicated_found, detected::INTEGER AS detected, t.active_docs AS corpus_size
FROM rec r JOIN timeline t ON t.seq = r.seq""")
sql("summary_by_baseline", *R, body=summary())
sql("summary_by_label", *R, body=labels_of())
sql("temporal_quartiles", *R, """
c AS (SELECT * FROM rec WHERE expected_label <> 'clean'),
s AS (SELECT max(position) AS last, greatest(max(position) // 4, 1) AS size FROM c),
q AS (SELECT g AS quartile, (g - 1) * size AS lo, CASE WHEN g < 4 THEN g * size ELSE last + 1 END AS hi FROM s, generate_series(1, 4) t(g))""", body="""
SELECT 'vector-only' AS baseline, quartile, lo, hi, count(c.seq) AS n_conflicts, count(c.seq) FILTER (WHERE c.detected) AS detected,
       CASE WHEN count(c.seq) > 0 THEN round(count(c.seq) FILTER (WHERE c.detected)::DOUBLE / count(c.seq), 4) ELSE 0.0 END AS rate
FROM q LEFT JOIN c ON c.position >= lo AND c.position < hi GROUP BY quartile, lo, hi""")


def _shown(items: str, width: int) -> str:
    s = f"array_to_string({items}, ', ')"
    return f"CASE WHEN len({items}) = 0 THEN '-' WHEN length({s}) <= {width} THEN {s} ELSE substr({s}, 1, {width - 1}) || '~' END"


sql("audit_marks", *R, body=f"""
SELECT seq, {_shown('implicates', 50)} AS implicates, {_shown('candidate_docs', 34)} AS candidates, coalesce(verdict, '(no judge call)') AS verdict,
  CASE WHEN verdict IS NULL THEN '-'
       WHEN CASE WHEN expected_label <> 'clean' THEN verdict <> 'clean' AND list_has_any(implicates, implicated_found) ELSE verdict = 'clean' END
       THEN 'OK' ELSE 'MISS' END AS mark FROM rec""")
sql("audit_summary", *R, body="""
SELECT 'vector-only' AS baseline, count(*) FILTER (WHERE verdict <> 'clean' AND found > 0) AS detected, count(*) AS conflicts,
  round(count(*) FILTER (WHERE verdict <> 'clean' AND found > 0)::DOUBLE / count(*), 4) AS detect_rate,
  round(sum(found)::DOUBLE / sum(len(implicates)), 4) AS affected_recall
FROM (SELECT *, len(list_intersect(candidate_docs, implicates)) AS found FROM rec WHERE expected_label <> 'clean')""")
THREE = (CHUNKS, *[knn(k, f"k{k}") for k in (1, 3, 5)], GOLD, *[judged(f"c{k}", f"k{k}") for k in (1, 3, 5)],
         *[records(f"r{k}", f"c{k}") for k in (1, 3, 5)])
sql("aggregate_shuffles", *THREE, "s AS (" + " UNION ALL ".join(summary(f"r{k}") for k in (1, 3, 5)) + ")", body="""
SELECT 'vector-only' AS baseline, metric, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std,
       round(min(v), 4) AS min, round(max(v), 4) AS max
FROM (UNPIVOT s ON detect_rate, affected_recall, fp_pressure_mean INTO NAME metric VALUE v) GROUP BY metric""")
sql("aggregate_label_rates", *THREE, "s AS (" + " UNION ALL ".join(labels_of(f"r{k}") for k in (1, 3, 5)) + ")", body="""
SELECT baseline, expected_label, round(avg(rate), 4) AS mean, round(coalesce(stddev_samp(rate), 0), 4) AS std
FROM s GROUP BY baseline, expected_label""")
DAG = """
dag AS (
  SELECT prev AS pred, seq AS succ FROM (
    SELECT seq, op, lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS prev FROM gold) WHERE op = 'update' AND prev IS NOT NULL
  UNION ALL
  SELECT f.first_seq, i.seq FROM (SELECT seq, unnest(implicates) AS d FROM gold) i
    JOIN (SELECT doc_id, min(seq) AS first_seq FROM gold GROUP BY doc_id) f ON f.doc_id = i.d WHERE f.first_seq <> i.seq)"""
sql("order_dag_edges", CHUNKS, GOLD, DAG, body="SELECT pred, succ FROM dag")
sql("dag_in_degree", CHUNKS, GOLD, DAG, body="""
SELECT g.seq, count(d.succ) AS in_degree FROM gold g LEFT JOIN dag d ON d.succ = g.seq GROUP BY g.seq""")
sql("conflict_positions", CHUNKS, GOLD, body="""
SELECT min(p) AS first, max(p) AS last, list_sort(list(p))[count(*) // 2 + 1] AS median
FROM (SELECT seq - 1 AS p FROM gold WHERE expected_label <> 'clean')""")
sql("label_histogram", CHUNKS, GOLD, body="SELECT expected_label, count(*) AS n FROM gold GROUP BY expected_label")
# the least order that respects the constraints: an event's key is the largest of its own
# random one and, along every chain of predecessors, theirs plus the steps between
sql("shuffle_valid", CHUNKS, GOLD, DAG, """
step AS (SELECT DISTINCT pred, succ FROM dag),
lifted AS (
  SELECT seq, ('0x' || substr(md5('42:' || seq), 1, 12))::BIGINT AS key FROM gold
  UNION SELECT s.succ, l.key + 1 FROM lifted l JOIN step s ON s.pred = l.seq)""", recursive=True, body="""
SELECT seq, row_number() OVER (ORDER BY max(key), seq) AS position FROM lifted GROUP BY seq""")
