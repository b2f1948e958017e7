"""SQL for the oracle: the model's views over the driver's tables, and helpers to build queries.

Only what a query names is put in front of it.
"""

from __future__ import annotations

import re

from mnemosea.functions import text as tx
from mnemosea.functions.vectors import FNV_OFFSET, FNV_PRIME

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def contains_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def chunk_kind(column: str) -> str:
    low = f"lower({column})"
    return (
        f"CASE WHEN {contains_any(low, tx.DECISION_WORDS)} THEN 'decision' WHEN {contains_any(low, tx.RATIONALE_WORDS)} THEN 'rationale' "
        f"WHEN {contains_any(low, tx.TASK_WORDS)} THEN 'task_candidate' WHEN {contains_any(low, tx.DEBUG_WORDS)} THEN 'debug_trace' ELSE 'qa_pair' END"
    )


def index_tokens(column: str) -> str:
    return rf"list_filter(string_split_regex(translate(lower({column}), '{tx.ACCENTED}', '{tx.FOLDED}'), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: t <> '')"


def tokens(column: str) -> str:
    return rf"list_filter(string_split_regex(lower({column}), '[^\p{{L}}\p{{Nd}}]+'), lambda t: t <> '' AND NOT list_contains([{_STOP}], t))"


def search_terms(column: str) -> str:
    split = rf"list_filter(string_split_regex(lower({column}), '[\t\n\x0B\f\r\x{{85}}\p{{Z}}\p{{P}}]+'), lambda t: strlen(t) >= 2)"
    return f"list_transform(list_filter(list_zip({split}, range(1, len({split}) + 1)), lambda p: list_position({split}, p[1]) = p[2]), lambda p: p[1])"


def bucket8(column: str) -> str:
    h = f"hex(encode({column}))"
    return f"list_reduce(list_transform(range(1, (len({h}) // 2 + 1)), lambda i: (instr('0123456789ABCDEF', substr({h}, (2 * i)::INTEGER, 1)) - 1) & 7), lambda a, b: (xor(a, b) * {FNV_PRIME & 7}) & 7, {FNV_OFFSET & 7}::BIGINT)"


def newton(column: str) -> str:
    return f"list_reduce(range(1, 13)::DOUBLE[], lambda x, i: (x + {column} / x) * 0.5::DOUBLE, {column})"


def redact(column: str, strict: bool = False) -> str:
    out = rf"regexp_replace({column}, '(?i)\b(api[_-]?key|token|password|secret)\b\s*[:=]\s*\S+', '\1=[REDACTED]', 'g')"
    out = rf"regexp_replace({out}, '(?i)\bbearer\s+[a-z0-9._-]+', 'Bearer [REDACTED]', 'g')"
    out = rf"regexp_replace({out}, 'file://[^\s""'']+', 'file://[REDACTED_PATH]', 'g')"
    out = rf"regexp_replace({out}, '/(Users|home)/[^\s""'']+', '[REDACTED_PATH]', 'g')"
    return f"replace(replace({out}, 'http://', ''), 'https://', '')" if strict else out


VIEWS = {
    "b_messages": """SELECT 's' || conv_id AS session_id, turn AS seq, role,
      text || CASE (conv_id * 7 + turn) % 6 WHEN 0 THEN ' decision: adopt https://example.com/spec/' || conv_id WHEN 1 THEN ' the reason is a tradeoff' WHEN 2 THEN ' TODO next step'
        WHEN 3 THEN ' error in /tmp/log/' || turn || '.txt' WHEN 4 THEN ' api_key=abc' ELSE '' END AS content,
      1704067200000 + conv_id * 60000 + turn * 1000 AS authored_at_ms, 'team/' || (conv_id % 4) AS namespace, 'proj-' || (conv_id % 3) AS project_key,
      CASE WHEN conv_id % 2 = 0 THEN 'main' ELSE 'dev' END AS branch_name FROM conversations""",
    "b_segments": """SELECT *, (sum(CASE WHEN role = 'user' OR seen = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq))::BIGINT AS chunk_seq
      FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY seq) AS seen FROM b_messages)""",
    "b_chunks": f"""SELECT session_id || ':v2:' || chunk_seq AS chunk_id, session_id, chunk_seq, start_seq, end_seq, authored_at_ms, namespace, project_key, branch_name, text,
      {chunk_kind("text")} AS chunk_kind, CASE WHEN regexp_matches(text, '{tx.SECRET}') THEN 'secret' ELSE 'private' END AS sensitivity, sha256(text) AS content_hash
      FROM (SELECT session_id, chunk_seq, min(seq) AS start_seq, max(seq) AS end_seq, max(authored_at_ms) AS authored_at_ms, min(namespace) AS namespace, min(project_key) AS project_key,
        min(branch_name) AS branch_name, string_agg(role || ': ' || content, chr(10) ORDER BY seq) AS text FROM b_segments GROUP BY ALL)""",
    "b_chunk_versions": """SELECT *, 2 AS chunk_strategy_version FROM b_chunks UNION ALL
      SELECT * REPLACE (replace(chunk_id, ':v2:', ':v1:') AS chunk_id), 1 FROM b_chunks WHERE substr(session_id, 2)::BIGINT % 5 = 0""",
    "b_nodes": """SELECT 'm' || doc_id AS memory_id, CASE WHEN doc_id % 3 = 0 THEN 'private' ELSE 'shared' END AS memory_space, 'team/' || lang AS namespace,
      ['decision', 'fact', 'rationale', 'task_candidate', 'note'][doc_id % 5 + 1] AS memory_type, substr(split_part(text, chr(10), 1), 1, 80) AS subject, text AS body, source AS origin_peer_id,
      1704067200000 + doc_id * 1000 AS authored_at_ms, doc_id % 11 <> 0 AS has_signature, CASE WHEN doc_id % 4 = 0 THEN 'docs/' || doc_id || '.md' ELSE '' END AS source_uri,
      'active' AS lifecycle_state FROM documents""",
    "b_verification": """SELECT 'm' || doc_id AS memory_id, CASE WHEN toxic = 1 THEN 'invalid_signature' WHEN quality = 0 THEN 'missing_signature' ELSE 'valid' END AS signature_status FROM labels""",
    "b_peers": """SELECT source AS peer_id, 0.5::DOUBLE + (n % 11) / 20.0::DOUBLE AS trust_weight, CASE WHEN n % 7 = 6 THEN 'block' ELSE 'allow' END AS trust_state
      FROM (SELECT DISTINCT source, regexp_extract(source, '([0-9]+)$', 1)::BIGINT AS n FROM documents WHERE source <> 'src19')""",
    "b_d": "SELECT count(*) AS d FROM documents",
    "b_edges": """SELECT 'e' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS edge_id, 'm' || (l_orderkey % d) AS from_memory_id, 'm' || ((l_partkey * 3) % (d + 50)) AS to_memory_id,
      ['supports', 'contradicts', 'derived_from', 'about', 'caused_by', 'references'][l_linenumber % 6 + 1] AS relation_type, l_discount * 10.0::DOUBLE AS weight, epoch_us(l_shipdate) // 1000 AS authored_at_ms
      FROM lineitem, b_d WHERE l_quantity <= 2""",
    "b_signals": """SELECT 'g' || event_id AS signal_id, 'm' || (event_id % (d + 20)) AS memory_id,
      CASE event_type WHEN 'click' THEN 'reinforce' WHEN 'view' THEN 'bookmark' WHEN 'purchase' THEN 'confirm' WHEN 'signup' THEN 'pin' WHEN 'error' THEN 'deny' END AS signal_type, value, epoch_us(ts) // 1000 AS authored_at_ms
      FROM events, b_d""",
    "b_artifacts": """SELECT sha256(url) AS artifact_id, url AS uri, 'team/' || (page_id % 4) AS namespace, string_split(url, '/')[-1] AS title FROM pages""",
    "b_spans": """SELECT 'p' || page_id AS span_id, sha256(url) AS artifact_id, 'm' || ((page_id * 3) % d) AS memory_id, 0::BIGINT AS start_offset, length(url)::BIGINT AS end_offset,
      CASE WHEN page_id % 2 = 0 THEN '' ELSE sha256(url) END AS quote_hash, 1704067200000 + page_id AS authored_at_ms FROM pages, b_d""",
    "b_changes": """SELECT 'memory_nodes' AS tbl, 'm' || user_id AS pk, event_type AS cid, printf('%.4f', value) AS val, 'real' AS kind, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS col_version, event_id AS db_version,
      (event_id % 3)::VARCHAR AS site_id, CASE WHEN user_id % 10 = 0 AND event_id % 97 = 0 THEN 2 ELSE 1 END::BIGINT AS cl, 'team/' || (user_id % 4) AS namespace, epoch_us(ts) // 1000 AS changed_at_ms FROM events""",
    "b_units": """SELECT memory_id AS unit_id, memory_space || '_memory' AS source_type, memory_id AS source_id, memory_space, namespace, memory_type AS unit_kind, subject AS title, body, 'private' AS sensitivity, 'active' AS state,
      source_uri, '' AS project_key, '' AS branch_name, authored_at_ms FROM b_nodes UNION ALL
      SELECT chunk_id, 'transcript_chunk', chunk_id, 'transcript', namespace, chunk_kind, '', text, sensitivity, 'active', '', project_key, branch_name, authored_at_ms FROM b_chunks""",
    "b_index": """SELECT unit_id, title, CASE WHEN state = 'active' AND sensitivity <> 'secret' THEN body ELSE '' END AS body FROM b_units""",
    "b_queries": """SELECT item_id AS query_id, array_to_string(list_slice(string_split(replace(text, chr(10), ' '), ' '), 1, 8), ' ') AS query FROM benchmark""",
    "b_queue": """SELECT unit_id, memory_space, authored_at_ms AS enqueued_at_ms, CASE WHEN length(unit_id) % 4 <> 0 THEN authored_at_ms + 500 ELSE 0 END::BIGINT AS processed_at_ms FROM b_units""",
    # Search: postings are made for the terms of the queries.
    "s_docs": f"SELECT unit_id, list_concat({index_tokens('title')}, {index_tokens('body')}) AS tokens FROM b_index",
    "s_len": "SELECT unit_id, len(tokens)::BIGINT AS doc_len, tokens FROM s_docs",
    "s_terms": f"SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(flatten(list_transform({search_terms('query')}, lambda x: {index_tokens('x')}))) AS term FROM b_queries)",
    "s_post": "SELECT unit_id, doc_len, term, count(*) AS tf FROM (SELECT unit_id, doc_len, unnest(tokens) AS term FROM s_len) WHERE term IN (SELECT term FROM s_terms) GROUP BY ALL",
    "s_stat": "SELECT count(*)::DOUBLE AS n, avg(doc_len)::DOUBLE AS avg_len FROM s_len",
    "s_idf": "SELECT term, CASE WHEN x <= 0 THEN 1e-6::DOUBLE ELSE x END AS idf FROM (SELECT term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS x FROM (SELECT term, count(*)::DOUBLE AS df FROM s_post GROUP BY term), s_stat)",
    "s_bm25": """SELECT query_id, unit_id, -round(sum(idf * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len)))), 6) AS bm25
      FROM s_post JOIN s_idf USING (term) JOIN s_terms USING (term), s_stat GROUP BY ALL""",
    "s_lex": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25, unit_id) AS lexical_rank FROM s_bm25) WHERE lexical_rank <= 100",
    "s_like": f"""SELECT query_id, unit_id, matches, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, unit_id) AS lexical_rank FROM (
      SELECT query_id, unit_id, len(list_filter(terms, lambda t: contains(low, t)))::BIGINT AS matches
      FROM (SELECT unit_id, lower(title || ' ' || body) AS low FROM b_index), (SELECT query_id, {search_terms('query')} AS terms FROM b_queries)) WHERE matches > 0""",
    "s_text": """SELECT query_id, unit_id, lexical_rank FROM s_lex UNION ALL SELECT query_id, unit_id, lexical_rank FROM s_like
      WHERE lexical_rank <= 100 AND query_id NOT IN (SELECT query_id FROM s_lex)""",
    "s_found": "SELECT query_id, unit_id, lexical_rank, 0 AS semantic_rank FROM s_text",
    # Nearest units by local embeddings.
    "v_tokens": f"""SELECT 'u' || unit_id AS id, {tokens("title || chr(10) || body")} AS toks FROM b_units WHERE state = 'active' AND sensitivity <> 'secret'
      UNION ALL SELECT 'q' || query_id, {tokens("query")} FROM b_queries""",
    "n_near": """SELECT query_id, unit_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, unit_id) AS semantic_rank FROM (
      SELECT query_id, unit_id, round(sqrt(list_sum(list_transform(range(1, 9), lambda i: (u.embedding[i] - q.embedding[i]) * (u.embedding[i] - q.embedding[i])))), 6) AS distance
      FROM (SELECT substr(id, 2)::BIGINT AS query_id, embedding FROM v_embedded WHERE id[1] = 'q') q, (SELECT substr(id, 2) AS unit_id, embedding FROM v_embedded WHERE id[1] = 'u') u)""",
    "n_found": """SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.unit_id, b.unit_id) AS unit_id, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(semantic_rank, 0) AS semantic_rank
      FROM (SELECT * FROM n_near WHERE semantic_rank <= 100) a FULL JOIN s_text b ON a.query_id = b.query_id AND a.unit_id = b.unit_id""",
    # Local embeddings of dimension 8.
    "v_sums": f"""SELECT id, list_transform(range(0, 8), lambda k: list_sum(list_transform(list_filter(parts, lambda p: p.b = k), lambda p: p.w))) AS sums FROM (
      SELECT id, list_concat(list_transform(toks, lambda t: {{'b': {bucket8('t')}, 'w': 1.0::DOUBLE + CASE WHEN strlen(t) >= 6 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(t, '\\p{{Nd}}') THEN 0.15::DOUBLE ELSE 0 END}}),
        list_transform(range(1, len(toks)), lambda j: {{'b': {bucket8("(toks[j] || ' ' || toks[j + 1])")}, 'w': 0.5::DOUBLE}})) AS parts FROM v_tokens)""",
    "v_filled": "SELECT id, list_transform(sums, lambda x: coalesce(x, 0)::DOUBLE) AS sums FROM v_sums",
    "v_total": "SELECT id, sums, list_sum(list_transform(sums, lambda x: x * x)) AS total FROM v_filled",
    "v_embedded": f"SELECT id, CASE WHEN total > 0 THEN list_transform(sums, lambda x: x * (1.0::DOUBLE / {newton('total')})) ELSE sums END AS embedding FROM v_total",
    # Features.
    "g_ends": "SELECT from_memory_id AS memory_id, relation_type, weight FROM b_edges UNION ALL SELECT to_memory_id, relation_type, weight FROM b_edges",
    "g_stats": """SELECT memory_id, count(*) AS edge_count, round(sum(CASE WHEN relation_type IN ('contradicts', 'contradiction', 'denies') THEN 0 ELSE weight END), 6) AS support_weight,
      round(sum(CASE WHEN relation_type IN ('contradicts', 'contradiction', 'denies') THEN weight ELSE 0 END), 6) AS contradict_weight FROM g_ends GROUP BY memory_id""",
    "a_stats": "SELECT memory_id, count(*) AS span_count, count(*) FILTER (quote_hash <> '') AS quote_count FROM b_spans GROUP BY memory_id",
    "g_orphans": """SELECT edge_id, from_memory_id AS memory_id, trim(CASE WHEN s.memory_id IS NULL THEN 'missing_from ' ELSE '' END || CASE WHEN t.memory_id IS NULL THEN 'missing_to' ELSE '' END) AS detail
      FROM b_edges e LEFT JOIN b_nodes s ON s.memory_id = e.from_memory_id LEFT JOIN b_nodes t ON t.memory_id = e.to_memory_id WHERE s.memory_id IS NULL OR t.memory_id IS NULL""",
    "r_rows": """SELECT c.query_id, c.unit_id, c.lexical_rank, c.semantic_rank, u.memory_space, u.namespace, u.unit_kind, u.title AS subject, u.body, u.source_uri, u.authored_at_ms, coalesce(v.signature_status, '') AS signature_status,
      CASE WHEN u.memory_space = 'shared' THEN coalesce(n.has_signature, false) ELSE false END AS has_signature, CASE WHEN u.memory_space = 'shared' THEN coalesce(p.trust_weight, 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS trust_weight,
      CASE WHEN u.memory_space = 'shared' THEN coalesce(n.origin_peer_id, '') ELSE '' END AS origin_peer_id
      FROM s_found c JOIN b_units u USING (unit_id) LEFT JOIN b_nodes n ON n.memory_id = c.unit_id LEFT JOIN b_verification v ON v.memory_id = c.unit_id LEFT JOIN b_peers p ON p.peer_id = n.origin_peer_id
      WHERE coalesce(v.signature_status, '') <> 'invalid_signature'""",
    "r_features": """SELECT r.*, coalesce(g.edge_count, 0) AS edge_count, coalesce(g.support_weight, 0) AS support_weight, coalesce(g.contradict_weight, 0) AS contradict_weight, coalesce(a.span_count, 0) AS span_count, coalesce(a.quote_count, 0) AS quote_count, q.query
      FROM r_rows r LEFT JOIN g_stats g ON g.memory_id = r.unit_id LEFT JOIN a_stats a ON a.memory_id = r.unit_id JOIN b_queries q USING (query_id)""",
}


def bucket() -> str:
    return "CASE WHEN memory_space = 'private' OR signature_status = 'valid' THEN 0 WHEN signature_status = 'unknown_peer' THEN 2 ELSE 1 END"


def recency(column: str, as_of: int) -> str:
    return f"CASE WHEN {column} <= 0 THEN 0::DOUBLE WHEN {column} > {as_of} THEN 1::DOUBLE ELSE 1::DOUBLE / (1::DOUBLE + ({as_of}::DOUBLE - {column}) / 3600000::DOUBLE / 24::DOUBLE) END"


def score(p, as_of: int, semantic: str = "semantic_rank") -> str:
    exact = "CASE WHEN trim(lower(query)) = '' THEN 0 WHEN contains(lower(subject), trim(lower(query))) THEN 1.0 WHEN contains(lower(body), trim(lower(query))) THEN 0.75 ELSE 0 END::DOUBLE"
    return (
        f"round((3 - {bucket()}) * 1000::DOUBLE + trust_weight * 100::DOUBLE"
        f" + (CASE WHEN {semantic} > 0 THEN {p.semantic}::DOUBLE / {semantic} ELSE 0 END + CASE WHEN lexical_rank > 0 THEN {p.lexical}::DOUBLE / lexical_rank ELSE 0 END) * {p.source}::DOUBLE"
        f" + greatest(0::DOUBLE, least(1::DOUBLE, 0.15::DOUBLE * edge_count + 0.2::DOUBLE * support_weight - 0.25::DOUBLE * contradict_weight)) * {p.graph}::DOUBLE"
        f" + least(1::DOUBLE, 0.25::DOUBLE * span_count + 0.15::DOUBLE * quote_count) * {p.artifact}::DOUBLE"
        f" + ({recency('authored_at_ms', as_of)}) * {p.recency}::DOUBLE + ({exact}) * {p.exact}::DOUBLE"
        f" + CASE WHEN memory_space = 'transcript' THEN {p.transcript}::DOUBLE ELSE 0 END, 6)"
    )


def sql(body: str, **extra: str) -> str:
    """``body`` with the views that it needs in front, each after those that it needs itself."""
    views = VIEWS | extra
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z]_[a-z0-9_]+\b", text)):
            if name in views and name not in order:
                need(views[name])
                if name not in order:
                    order.append(name)

    need(body)
    head = ", ".join(f"{n} AS {'MATERIALIZED ' if n.startswith(('s_', 'n_', 'v_embedded')) else ''}({views[n]})" for n in order)
    return f"WITH {head} {body}" if order else body
