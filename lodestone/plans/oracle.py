"""SQL for DuckDB that gives the rows of the retrieval queries."""

from __future__ import annotations

_D = "coalesce(1 - list_inner_product(a.embedding::DOUBLE[], b.v) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.v, b.v))), NULL)"
_ONE = "b AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
_MANY = "q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0)"
_SCORE = "greatest(0.0, least(1.0, 1 - distance))"
_C = """c AS (SELECT e.vec_id AS id, e.embedding, CAST(e.label AS VARCHAR) AS category, d.text, d.source, d.lang AS title, p.url AS source_url
    FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN pages p ON p.page_id = e.vec_id)"""
_GOOD = "trim(coalesce(text, '')) <> '' AND (starts_with(coalesce(trim(source_url), ''), 'http://') OR starts_with(coalesce(trim(source_url), ''), 'https://'))"


def _routed(explicit: str) -> str:
    """Common tables of the routed search; `r` has qid, stage, place and the row."""
    return f"""
    WITH {_C}, {_MANY}, x AS (SELECT qid, v, {explicit} AS explicit FROM q),
    n AS (SELECT b.qid, a.*, {_D} AS distance FROM c AS a, x AS b),
    p0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM n),
    p AS (SELECT *, {_SCORE} AS score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM p0 WHERE rank <= 20 AND {_GOOD}),
    v AS (SELECT qid, category, sum(greatest(score, 0.01) / place) AS votes, min(place) AS first FROM p WHERE category IS NOT NULL GROUP BY qid, category),
    w AS (SELECT qid, arg_min(category, k) AS category FROM (SELECT qid, category, row_number() OVER (PARTITION BY qid ORDER BY round(votes, 12) DESC, first) AS k FROM v) GROUP BY qid),
    z AS (SELECT x.qid, coalesce(x.explicit, w.category) AS wanted FROM x LEFT JOIN w ON w.qid = x.qid),
    s0 AS (SELECT n.*, row_number() OVER (PARTITION BY n.qid ORDER BY distance, id) AS rank FROM n JOIN z ON z.qid = n.qid AND z.wanted = n.category),
    s AS (SELECT *, {_SCORE} AS score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM s0 WHERE rank <= 5 AND {_GOOD}),
    u AS (SELECT 1 AS stage, * FROM s UNION ALL BY NAME SELECT 2 AS stage, p.* FROM p JOIN x ON x.qid = p.qid WHERE CASE WHEN x.explicit IS NULL THEN place ELSE rank END <= 5),
    r AS (SELECT * FROM u QUALIFY stage = min(stage) OVER (PARTITION BY qid))
    """


_FOLD = "replace(lower({0}), 'ß', 'ss')"


_COMPACT = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^0-9a-z가-힣]', '', 'g')"
_RUNS = "list_transform(range(1, length({0}) - {1} + 2), lambda i: substring({0}, i, {1}))"


def _bm25(top: int = 10, grams: bool = False) -> str:
    """Common tables of BM25 over documents for benchmark questions; `m` has qid, id, score, rank."""
    words = "list_filter(regexp_split_to_array(replace(lower(text), 'ß', 'ss'), '\\s+'), lambda w: w <> '')"
    if grams:
        words = f"list_concat({words}, {', '.join(_RUNS.format('compact', n) for n in (2, 3, 4))})"
    of = lambda table: f"(SELECT *, {_COMPACT.format('text')} AS compact FROM {table})" if grams else table
    return f"""
    t AS (SELECT doc_id AS id, {words} AS t FROM {of('documents')}),
    corpus AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
    tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM t) GROUP BY id, len, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    asked AS (SELECT DISTINCT qid, term FROM (SELECT item_id AS qid, unnest({words}) AS term FROM {of('benchmark')})),
    sc AS (SELECT asked.qid, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.len / mean))), 6) AS score
        FROM asked JOIN tf ON tf.term = asked.term JOIN df ON df.term = asked.term, corpus GROUP BY asked.qid, tf.id),
    m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {top})
    """


def _dense(top: int = 10) -> str:
    """`dn` has qid, id, distance, rank of the vectors nearest to the benchmark questions' vectors."""
    return f"""
    dn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (
        SELECT b.qid, a.vec_id AS id, {_D} AS distance FROM embeddings AS a,
        (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) AS b) QUALIFY rank <= {top})
    """


_DENSE = _dense()
_POSTS = """posts AS (SELECT event_type AS topic, event_id AS id, CASE WHEN event_id % 10 <> 3 THEN ts END AS published, ts AS crawled, event_id AS ordinal,
    CAST(user_id AS VARCHAR) AS url, 's' || (user_id % 4) AS source, CASE WHEN event_id % 17 = 0 THEN 'static' ELSE 'notice' END AS document_type FROM events)"""
#: Notices compete for latest; static and historical documents only count.
_NOTICE = "document_type NOT IN ('static', 'historical')"
_LATEST = f"""latest AS (SELECT t.topic, id AS latest_id, published AS latest_at, n AS posts FROM (SELECT topic, count(*) AS n FROM posts GROUP BY topic) t LEFT JOIN (
    SELECT * FROM posts WHERE {_NOTICE} QUALIFY row_number() OVER (PARTITION BY topic ORDER BY published IS NULL, coalesce(published, crawled) DESC, crawled DESC, ordinal) = 1) p ON p.topic = t.topic)"""
#: Classes in order, with their phrases; the longest phrase found decides.
_RULES = (("english", ("of the", "and the")), ("german", ("der", "und die")), ("french", ("la", "dans les")), ("licence", ("license", "all rights reserved")), ("other", ("lorem",)))
_NORMAL = "trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_TOPIC = "CASE " + " ".join(f"WHEN contains({_NORMAL}, '{p}') THEN '{k}'" for _, _, p, k in sorted((-len(p), n, p, k) for n, (k, ps) in enumerate(_RULES) for p in ps)) + " ELSE 'other' END"
_folded = lambda x: _NORMAL.replace("lower(text)", f"lower({x})")
_kind = lambda x: f"CASE WHEN contains({_folded(x)}, 'rights reserved') THEN 'terms' WHEN contains({_folded(x)}, 'license') THEN 'terms' WHEN contains({_folded(x)}, 'and the') THEN 'report' WHEN contains({_folded(x)}, 'und die') THEN 'notice' WHEN contains({_folded(x)}, 'of the') THEN 'report' WHEN contains({_folded(x)}, 'lorem') THEN 'information' WHEN contains({_folded(x)}, 'der') THEN 'notice' END"
_intent = lambda x: f"CASE WHEN contains({_folded(x)}, 'and the') OR contains({_folded(x)}, 'of the') THEN 'english.parts' WHEN contains({_folded(x)}, 'was') OR contains({_folded(x)}, 'is') THEN 'english.main' END"
_HITS = " UNION ALL ".join(f"SELECT doc_id AS id, {n} AS n, '{k}' AS key, " + " + ".join(f"CAST(contains(f, '{p}') AS BIGINT)" for p in ps) + " AS hits FROM f" for n, (k, ps) in enumerate(_RULES))
_RANKED = f"f AS (SELECT doc_id, {_NORMAL} AS f FROM documents), h AS ({_HITS}), top3 AS (SELECT id, key, hits, row_number() OVER (PARTITION BY id ORDER BY hits DESC, n) AS place FROM h WHERE hits > 0 QUALIFY place <= 3)"
_UNSAFE = (
    ("line_break", r"[\r\n]"),
    ("markup", r"(?i)</?[a-z][^>]*>|<!doctype\s+html"),
    ("trace", r"(?i)\b(?:traceback|stack\s+trace)\b"),
    ("setting", r"(?i)(?:API_KEY|PASSWORD|SECRET|TOKEN)\s*[:=]\s*\S+"),
    ("token", r"(?i)\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}"),
    ("error_name", r"(?i)\b(?:Error|Exception|[A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception))\s*:"),
    ("header", r"(?i)\b(?:authorization|cookie)\s*:"),
    ("bearer", r"(?i)\bbearer\s+\S+"),
    ("windows_path", r"(?i)(?:^|[^\w])[A-Za-z]:[\\/]"),
)
_STATES = "st AS (SELECT a.x AS store, b.x AS keys, c.x AS compatible, d.n AS n FROM (VALUES (false), (true)) a(x), (VALUES (false), (true)) b(x), (VALUES (false), (true)) c(x), (VALUES (0), (7)) d(n))"
_TITLED = f"{_bm25()}, td AS (SELECT m.qid, m.id, m.score, b.text AS question, array_to_string(list_slice(string_split(d.text, ' '), 1, 8), ' ') AS title FROM m JOIN documents d ON d.doc_id = m.id JOIN benchmark b ON b.item_id = m.qid)"
_WORDS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[0-9a-z가-힣]+')"
_RESULTS = f"""res AS (SELECT l.doc_id, {_TOPIC} = 'english' AS topic_match,
    ((quality = 1) = (n_chars > 500)) AND ((n_chars > 500) = (l.doc_id % 9 <> 0)) AS grounded_match,
    CASE WHEN toxic = 0 THEN l.doc_id % 3 <> 2 END AS latest_only_match,
    CASE WHEN l.doc_id % 2 = 0 THEN contains(lang, 'src1') OR contains(source, 'src1') END AS source_title_match
    FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
_EVIDENCE_Q = "CASE WHEN qid % 4 = 1 THEN '2024 ' || question WHEN qid % 4 = 2 THEN '1학기 ' || question ELSE question END"
_EVIDENCE_T = "CASE WHEN id % 3 = 1 THEN '2024년 ' || title WHEN id % 3 = 2 THEN '2023 2 학기 ' || title ELSE title END"


def _year(x: str) -> str:
    return f"CAST(nullif(regexp_extract({x}, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:학년도|년)?(?:[^0-9]|$)', 1), '') AS INTEGER)"


def _term(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '여름\\s*계절(?:학기|수업)?') THEN 'summer' WHEN regexp_matches({x}, '겨울\\s*계절(?:학기|수업)?') THEN 'winter' WHEN regexp_matches({x}, '1\\s*학기') THEN 'first' WHEN regexp_matches({x}, '2\\s*학기') THEN 'second' END"


SQL: dict[str, str] = {
    "knn_topk": f"WITH {_ONE}, n AS (SELECT a.vec_id AS id, {_D} AS distance FROM embeddings AS a, b) SELECT id, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank, round(distance, 6) + 0.0 AS distance, round({_SCORE}, 6) AS score FROM n QUALIFY rank <= 5",
    "knn_category_filter": f"WITH {_ONE}, n AS (SELECT a.vec_id AS id, {_D} AS distance FROM embeddings AS a, b WHERE a.label = 3) SELECT id, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank, round(distance, 6) + 0.0 AS distance FROM n QUALIFY rank <= 10",
    "knn_batch": f"WITH {_MANY}, n AS (SELECT b.qid, a.vec_id AS id, {_D} AS distance FROM embeddings AS a, q AS b) SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank, round(distance, 6) + 0.0 AS distance FROM n QUALIFY rank <= 5",
    "score_clamp": f"WITH {_ONE}, n AS (SELECT a.vec_id AS id, {_D} AS distance FROM embeddings AS a, b) SELECT id, round({_SCORE}, 6) AS score FROM n",
    "category_vote": f"WITH {_ONE}, n AS (SELECT a.vec_id AS id, CAST(label AS VARCHAR) AS category, {_D} AS distance FROM embeddings AS a, b), p AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM n QUALIFY rank <= 20) SELECT category, round(sum(greatest({_SCORE}, 0.01) / rank), 6) AS votes, CAST(min(rank) AS INTEGER) AS first FROM p GROUP BY category",
    "category_routed_search": f"{_routed('CAST(NULL AS VARCHAR)')} SELECT qid, stage, CAST(place AS INTEGER) AS place, id, category, round(score, 6) AS score, title, trim(source_url) AS url, source FROM r WHERE qid = 0",
    "routed_search_fallback": f"{_routed(chr(39).join(('CASE WHEN qid % 200 = 100 THEN ', 'none', ' END')))} SELECT qid, stage, CAST(place AS INTEGER) AS place, id, round(score, 6) AS score FROM r",
    "no_answer_rows": f"{_routed('CAST(NULL AS VARCHAR)')} SELECT q.qid, CASE WHEN count(r.id) > 0 THEN 'answer' ELSE 'no_answer' END AS response_type, count(r.id) > 0 AS grounded, count(r.id) AS n_sources FROM q LEFT JOIN r ON r.qid = q.qid GROUP BY q.qid",
    "context_assembly": f"""{_routed('CAST(NULL AS VARCHAR)')}, o AS (SELECT q.qid, coalesce(string_agg('[자료 ' || place || ']' || chr(10) || '제목: ' || title || chr(10) || '게시일: 알 수 없음' || chr(10) || '내용:' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY place), '') AS context FROM q LEFT JOIN r ON r.qid = q.qid GROUP BY q.qid)
        SELECT qid, md5(context) AS context_md5, length(context) AS n FROM o""",
    "post_limit_drop": f"WITH {_C}, {_ONE}, n AS (SELECT a.*, {_D} AS distance FROM c AS a, b), p AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM n QUALIFY rank <= 50) SELECT id, CAST(rank AS INTEGER) AS rank, trim(source_url) AS url FROM p WHERE {_GOOD}",
    "metadata_defaults": f"WITH {_C} SELECT id, coalesce(nullif(nullif(title, 'en'), ''), 'Untitled notice') AS title, coalesce(nullif(source, ''), 'Chroma data') AS source, category FROM c",
    "int_coercion": "WITH x AS (SELECT doc_id, trim(CASE doc_id % 5 WHEN 0 THEN ' ' || n_chars || ' ' WHEN 1 THEN '-' || n_chars WHEN 2 THEN n_chars || '.0' WHEN 3 THEN '' ELSE CAST(n_chars AS VARCHAR) END) AS raw FROM documents) SELECT doc_id, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN TRY_CAST(raw AS BIGINT) END AS value FROM x",
    "question_validation": "SELECT conv_id, turn, length(text) BETWEEN 2 AND 500 AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 2 AS valid, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM conversations WHERE role = 'user'",
    "explicit_category": "WITH x AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', '', 'g') AS t FROM conversations) SELECT conv_id, turn, CASE WHEN (contains(t, 'the') OR contains(t, 'der')) AND (contains(t, 'how') OR contains(t, 'wie') OR contains(t, 'and')) THEN 'review' END AS category FROM x",
    "index_inspect": """WITH m(model, chunk, ok) AS (VALUES ('embed-a', '500', true), ('embed-a', ' 500 ', true), ('embed-b', '500', false), ('embed-a', '500.0', false), ('embed-a', '-500', false), ('embed-a', NULL, false)), n AS (SELECT count(*) AS n FROM embeddings)
        SELECT model, chunk, n AS count, n > 0 AND ok AS compatible, CASE WHEN n = 0 THEN 'empty_index' WHEN ok THEN 'compatible' ELSE 'configuration_mismatch' END AS reason FROM m, n""",
    "health_status": f"WITH {_STATES} SELECT *, CASE WHEN NOT store THEN 'unavailable' WHEN NOT keys THEN 'needs_configuration' WHEN n = 0 THEN 'needs_index' WHEN NOT compatible THEN 'needs_reindex' ELSE 'ready' END AS status FROM st",
    "chat_guard": f"WITH {_STATES} SELECT st.*, failure, CASE WHEN NOT keys THEN 503 WHEN NOT store THEN 503 WHEN n = 0 THEN 409 WHEN NOT compatible THEN 409 WHEN failure IN ('authentication', 'api') THEN 502 WHEN failure = 'search' THEN 503 WHEN failure <> 'none' THEN 500 ELSE 200 END AS code FROM st, (VALUES ('none'), ('authentication'), ('api'), ('search'), ('value')) f(failure)",
    "strict_compat": "SELECT range AS id, CASE WHEN range & 1 = 0 THEN 'index_unavailable' WHEN range & 2 = 0 THEN 'empty_index' WHEN range & 4 = 0 THEN 'missing_manifest' WHEN range & 8 = 0 THEN 'invalid_manifest' WHEN range & 16 = 0 THEN 'settings_mismatch' WHEN range & 32 = 0 THEN 'content_mismatch' WHEN range & 64 = 0 THEN 'chunk_count_mismatch' ELSE 'compatible' END AS reason FROM range(128)",
    "fingerprint": """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS sha256 FROM documents""",
    "bulletize": """WITH x AS (SELECT conv_id, turn, list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')) AS l FROM conversations WHERE role = 'assistant'),
        y AS (SELECT conv_id, turn, list_transform(l, lambda s: CASE WHEN starts_with(s, '- ') THEN s WHEN trim(regexp_replace(s, '^[-*• ]+', '')) <> '' THEN '- ' || trim(regexp_replace(s, '^[-*• ]+', '')) END) AS l FROM x)
        SELECT conv_id, turn, coalesce(array_to_string(list_filter(l, lambda s: s IS NOT NULL), chr(10)), '') AS answer FROM y""",
    "answer_line_classes": """WITH x AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS s FROM documents)
        SELECT doc_id, CASE WHEN s = '' THEN 'spacer' WHEN s IN ('확인한 최신 공지', '핵심 내용', '원문 확인') THEN 'section' WHEN regexp_matches(s, '^[0-9]+\\.\\s') THEN 'notice' WHEN regexp_matches(s, '^(?:분류|게시일)\\s*·') THEN 'meta' WHEN starts_with(s, '- ') THEN 'bullet' WHEN regexp_matches(s, '^출처\\s*·') THEN 'citation' ELSE 'line' END AS class, count(*) AS lines FROM x GROUP BY 1, 2""",
    "response_contract": """WITH x AS (SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'clarification' WHEN 2 THEN 'no_answer' WHEN 3 THEN NULL ELSE 'answer' END AS kind, page_id % 11 = 0 AS blank, page_id % 3 = 0 AS has, page_id % 3 = 0 AND page_id % 7 = 3 AS bad, page_id % 4 = 0 AS grounded, page_id % 2 = 0 AS intent FROM pages)
        SELECT page_id, CASE WHEN kind IS NULL THEN 'type' WHEN blank THEN 'answer' WHEN bad THEN 'source' WHEN kind = 'clarification' AND (grounded OR has OR NOT intent) THEN 'clarification' WHEN kind = 'no_answer' AND (grounded OR has) THEN 'no_answer' END AS fault FROM x""",
    "url_validity": "WITH x AS (SELECT page_id, CASE page_id % 5 WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN 'ftp://example.org/a' WHEN 3 THEN '' ELSE url END AS u FROM pages) SELECT page_id, regexp_matches(u, '^https?://[^/@]+(?:/[^\\s]*)?$') AS valid, starts_with(u, 'http://') OR starts_with(u, 'https://') AS web FROM x",
    "topic_classify": f"SELECT doc_id, CASE WHEN source = 'src1' THEN 'licence' ELSE {_TOPIC} END AS topic FROM documents",
    "intent_top3": f"WITH {_RANKED} SELECT id, key, hits, CAST(place AS INTEGER) AS place FROM top3",
    "intent_confirm": f"WITH {_RANKED} SELECT d.doc_id AS id, CASE WHEN count(*) FILTER (key = 'english') > 0 THEN 'english' END AS confirmed FROM documents d LEFT JOIN top3 ON top3.id = d.doc_id GROUP BY d.doc_id",
    "latest_per_topic": f"WITH {_POSTS}, {_LATEST} SELECT topic, latest_id, CAST(floor(epoch(latest_at)) AS BIGINT) AS latest_at, posts FROM latest",
    "recent_notices": f"WITH {_POSTS}, o AS (SELECT *, CASE WHEN topic = 'click' THEN 0 ELSE 1 END AS f FROM posts WHERE published IS NOT NULL AND {_NOTICE}), u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY url ORDER BY f, published DESC, id) = 1) SELECT topic, id, url FROM u ORDER BY f, published DESC, id LIMIT 3",
    "freshest_per_intent": f"WITH {_POSTS} SELECT source AS qid, topic AS intent, id FROM posts WHERE {_NOTICE} AND (source <> 's1' OR published IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY source, topic ORDER BY published IS NULL, published DESC, id % 13 DESC, id) = 1",
    "chunk_fixed": "WITH w AS (SELECT doc_id, text, unnest(range(0, CAST(floor((greatest(length(text) - 150, 1) - 1) / 750) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0) SELECT doc_id AS id, k AS chunk_no, k * 750 AS start, md5(substring(text, k * 750 + 1, 900)) AS text_md5 FROM w",
    "char_ngrams": f"WITH x AS (SELECT item_id, {_COMPACT.format('text')} AS t FROM benchmark), g AS (SELECT item_id, substring(t, i, n) AS g FROM x, (VALUES (2), (3), (4)) s(n), LATERAL (SELECT unnest(range(1, length(t) - n + 2)) AS i)) SELECT x.item_id, count(g) AS grams, count(DISTINCT g) AS kinds FROM x LEFT JOIN g ON g.item_id = x.item_id GROUP BY x.item_id",
    "bm25_topk": f"WITH {_bm25()} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM m",
    "rrf_fusion": f"WITH {_bm25()}, {_DENSE}, f AS (SELECT coalesce(m.qid, dn.qid) AS qid, coalesce(m.id, dn.id) AS id, m.rank AS l, dn.rank AS d FROM m FULL JOIN dn ON dn.qid = m.qid AND dn.id = m.id), s AS (SELECT *, coalesce(1.0::DOUBLE / (60 + l), 0) + coalesce(1.0::DOUBLE / (60 + d), 0) AS fused FROM f) SELECT qid, id, CAST(l AS INTEGER) AS lexical_rank, CAST(d AS INTEGER) AS dense_rank, round(fused, 9) AS fused, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(fused, 12) DESC, id) AS INTEGER) AS place FROM s",
    "fused_verification": f"WITH {_DENSE} SELECT qid, id, id % 3 = 0 AS forged FROM dn",
    "candidate_consistency": "SELECT doc_id AS id, CAST(2 AS BIGINT) AS versions FROM documents WHERE source = 'src3' AND lang <> 'xx'",
    "rerank_boost": f"WITH {_TITLED}, x AS (SELECT qid, id, score, list_distinct({_WORDS.format('question')}) AS w, {_COMPACT.format('title')} AS t FROM td), y AS (SELECT *, len(list_filter(w, lambda s: length(s) >= 4 AND length(s) <= length(t) AND contains(t, s))) AS a, len(list_filter(w, lambda s: length(s) >= 2 AND length(s) <= length(t) AND contains(t, s))) AS b FROM x) SELECT qid, id, round(least(1.0, score / 100 + 0.08::DOUBLE * a + least(0.24::DOUBLE, 0.12::DOUBLE * b)), 6) AS score FROM y",
    "score_gate": f"WITH {_bm25()} SELECT qid, id, score FROM m WHERE score >= 0.1 QUALIFY score >= 0.75 * max(score) OVER (PARTITION BY qid)",
    "relevance_gate": f"WITH {_bm25()}, {_DENSE}, f AS (SELECT coalesce(m.qid, dn.qid) AS qid, coalesce(m.id, dn.id) AS id, m.rank AS l, dn.rank AS d FROM m FULL JOIN dn ON dn.qid = m.qid AND dn.id = m.id) SELECT qid, id, CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN 'irrelevant' WHEN (id % 2 = 0 OR id % 3 = 0) AND l IS NOT NULL AND d IS NOT NULL THEN 'relevant' WHEN id % 2 = 0 AND l IS NOT NULL THEN 'relevant' ELSE 'ambiguous' END AS relevance FROM f",
    "evidence_decision": f"""WITH {_TITLED}, x AS (SELECT qid, id, {_EVIDENCE_Q} AS q, {_EVIDENCE_T} AS t FROM td),
        y AS (SELECT *, {_year('q')} AS qy, {_year('t')} AS ty, {_term('q')} AS qt, {_term('t')} AS tt, list_filter(list_distinct({_WORDS.format('q')}), lambda w: length(w) >= 2) AS w, {_COMPACT.format('t')} AS f FROM x),
        z AS (SELECT *, list_filter(w, lambda s: s <> '학기' AND contains(f, s)) AS o FROM y)
        SELECT qid, id, CASE WHEN qy IS NOT NULL AND ty IS NULL THEN 'missing_temporal_evidence' WHEN qy <> ty THEN 'year_mismatch' WHEN qt IS NOT NULL AND tt IS NULL THEN 'missing_temporal_evidence' WHEN qt <> tt THEN 'semester_mismatch'
            WHEN qid % 5 = 0 AND id % 2 = 0 THEN 'accepted_general_latest' WHEN contains(f, 'license') AND len(list_filter(w, lambda s: contains(s, 'license') OR contains('license', s))) > 0 THEN 'accepted_topic_marker'
            WHEN len(o) >= 2 OR len(list_filter(o, lambda s: length(s) >= 5)) > 0 THEN 'accepted_title_overlap' ELSE 'insufficient_title_evidence' END AS reason FROM z""",
    "year_term_extract": f"WITH x AS (SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN (1990 + doc_id % 40) || '학년도 ' ELSE '12024 ' END) || (CASE doc_id % 4 WHEN 0 THEN '여름 계절학기' WHEN 1 THEN '겨울계절' WHEN 2 THEN '2 학기' ELSE '' END) AS t FROM documents) SELECT doc_id, {_year('t')} AS year, {_term('t')} AS term FROM x",
    "query_plan": "WITH x AS (SELECT item_id AS qid, '2024 1학기 ' || substring(text, 1, 20) AS q FROM benchmark) SELECT qid, q || '|2024 first label 공식 공지|제목: 2024 first label 공식 공지' || chr(10) || '본문: example' AS variants FROM x",
    "contact_lines": r"""WITH x AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]|0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}|\+[0-9][0-9 ().-]{7,}|(?i:contact:)|연락처')) AS l FROM documents) SELECT doc_id, md5(array_to_string(l, chr(10))) AS text_md5 FROM x""",
    "hash_embedding": f"""WITH w AS (SELECT item_id, unnest({_WORDS.format('text')}) AS w FROM benchmark), b AS (SELECT item_id, CAST('0x' || substring(md5(w), 1, 2) AS INTEGER) AS h FROM w),
        v AS (SELECT item_id, h % 64 AS bucket, sum(CASE WHEN h >= 128 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM b GROUP BY 1, 2), n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM v GROUP BY 1)
        SELECT v.item_id, bucket, round(v / n, 6) AS value FROM v JOIN n ON n.item_id = v.item_id WHERE v <> 0""",
    "page_text": "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS text_md5 FROM pages WHERE starts_with(url, 'http://') OR starts_with(url, 'https://')",
    "upsert_latest": "SELECT doc_id AS id, CASE WHEN source = 'src1' THEN 'newest' ELSE source END AS source FROM documents",
    "filtered_chunks": "SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND source = 'src5'",
    "row_count": "SELECT count(*) AS count FROM embeddings",
    "source_label": "SELECT doc_id, CASE WHEN source = 'src0' THEN 'A' ELSE 'B' END AS label FROM documents",
    "audit_sources": f"WITH {_POSTS} SELECT source, count(*) AS posts FROM posts GROUP BY source",
    "audit_topics": f"WITH {_POSTS}, {_LATEST} SELECT k.topic, coalesce(posts, 0) AS posts, latest_id FROM (VALUES ('click'), ('purchase'), ('nothing')) k(topic) LEFT JOIN latest ON latest.topic = k.topic",
    "audit_issues": f"""WITH {_POSTS}, {_LATEST}, k(topic) AS (VALUES ('click'), ('purchase'), ('nothing'))
        SELECT 'missing_source' AS code, r.source, CAST(NULL AS VARCHAR) AS topic, CAST(NULL AS BIGINT) AS post_id FROM (VALUES ('s0'), ('s9')) r(source) WHERE r.source NOT IN (SELECT source FROM posts)
        UNION ALL SELECT 'missing_published_at', source, topic, id FROM posts WHERE published IS NULL AND {_NOTICE}
        UNION ALL SELECT 'topic_override_mismatch', source, topic, id FROM posts WHERE topic IN (SELECT topic FROM k) AND id % 19 = 0 AND topic <> 'click'
        UNION ALL SELECT 'empty_topic', NULL, topic, NULL FROM k WHERE topic NOT IN (SELECT topic FROM latest WHERE latest_id IS NOT NULL)
        UNION ALL SELECT 'stale_topic', p.source, l.topic, l.latest_id FROM latest l JOIN k ON k.topic = l.topic JOIN posts p ON p.id = l.latest_id WHERE epoch(TIMESTAMP '2024-06-01') - floor(epoch(l.latest_at)) > 180 * 86400""",
    "staleness": f"WITH {_POSTS} SELECT id, epoch(TIMESTAMP '2024-06-01') - floor(epoch(published)) > 30 * 86400 AS stale, document_type NOT IN ('static', 'historical') AS competes FROM posts",
    "date_parsing": "WITH x AS (SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS d FROM documents) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(epoch(d) AS BIGINT) WHEN 1 THEN CAST(epoch(d) AS BIGINT) + 37230 END AS at FROM x",
    "eval_checks": f"WITH {_RESULTS} SELECT *, topic_match AND grounded_match AND coalesce(latest_only_match, true) AND coalesce(source_title_match, true) AS passed FROM res",
    "eval_metrics": f"WITH {_RESULTS} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, count(*) FILTER ({c}) AS passed, count({c}) AS total, CASE WHEN count({c}) > 0 THEN round(count(*) FILTER ({c})::DOUBLE / count({c}), 4) END AS rate FROM res" for c in ("topic_match", "grounded_match", "latest_only_match", "source_title_match")),
    "case_validation": "WITH x AS (SELECT 'case-' || conv_id || '-' || CASE WHEN turn % 5 = 4 THEN 'X' ELSE CAST(turn // 2 AS VARCHAR) END AS id, text, turn % 3 = 0 AS g, turn % 2 = 0 AS t FROM conversations), y AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM x), z AS (SELECT id, CASE WHEN NOT regexp_full_match(id, '[a-z0-9]+(?:-[a-z0-9]+)*') THEN 'id' WHEN n > 1 THEN 'repeated_id' WHEN length(text) NOT BETWEEN 2 AND 500 THEN 'question' WHEN NOT g AND t THEN 'titles' END AS rule FROM y) SELECT * FROM z WHERE rule IS NOT NULL",
    "notice_kinds": f"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS l, split_part(text, chr(10), 1) AS title FROM documents),
        k AS (SELECT doc_id, coalesce({_kind('title')}, list_filter(list_transform(l, lambda x: {_kind('x')}), lambda x: x IS NOT NULL)[1], 'information') AS kind FROM s)
        SELECT doc_id, kind, CASE WHEN doc_id % 3 = 0 THEN kind = 'report' ELSE true END AS compatible FROM k""",
    "intent_classify": f"""WITH s AS (SELECT *, split_part(text, chr(10), 1) AS title FROM documents)
        SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN doc_id % 10 = 0 THEN 'english.parts' ELSE coalesce({_intent('title')}, {_intent('text')}, 'english.main') END WHEN lang = 'de' THEN 'licence.all' END AS intent FROM s""",
    "title_first_topic": f"""WITH s AS (SELECT doc_id, {_folded('text')} AS f, {_folded('split_part(text, chr(10), 1)')} AS t, list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: {_folded('x')}) AS l FROM documents)
        SELECT doc_id, CASE WHEN contains(t, 'license') THEN 'licence' WHEN contains(t, 'of the') THEN 'english' WHEN contains(t, 'lorem') THEN 'other' WHEN contains(t, 'der') THEN 'german' WHEN contains(t, 'la') THEN 'french'
            WHEN contains(t, 'ing') THEN 'english' WHEN len(list_filter(l, lambda x: contains(x, 'license') AND contains(x, 'is'))) > 0 THEN 'licence' ELSE 'other' END AS topic FROM s""",
    "labels_allowed": "SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'other' END AS label FROM documents",
    "intent_matches": "WITH e AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS s FROM events GROUP BY user_id) SELECT user_id, CASE user_id % 3 WHEN 0 THEN s = ['click'] WHEN 1 THEN len(s) = 1 END AS intent_match FROM e",
    "report_summary": "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality <> 1) AS failed FROM labels",
    "best_chunk": "SELECT doc_id % 5 AS qid, source || '/' || lang AS url, doc_id AS id, round(n_chars % 1000 / 1000.0::DOUBLE, 6) AS score FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 5, source, lang ORDER BY n_chars % 1000 DESC, doc_id) = 1",
    "latest_flags": f"WITH {_POSTS}, {_LATEST} SELECT topic, latest_id, CAST(1 AS BIGINT) AS latest FROM latest",
    "latest_urls": f"WITH {_POSTS}, {_LATEST}, u AS (SELECT l.topic, p.url FROM latest l JOIN posts p ON p.id = l.latest_id) SELECT topic, url AS urls FROM u UNION ALL SELECT '*', string_agg(DISTINCT url, ',' ORDER BY url) FROM u",
    "latest_of_all": f"WITH {_POSTS}, {_LATEST} SELECT p.topic, p.id, p.url FROM latest l JOIN posts p ON p.id = l.latest_id ORDER BY published IS NULL, coalesce(published, crawled) DESC, crawled DESC, ordinal LIMIT 1",
    "listed_pages": "SELECT page_id FROM pages WHERE page_id % 3 < 2 AND page_id % 4 <> 0",
    "variant_scores": "SELECT doc_id % 7 AS qid, doc_id % 50 AS id, round(max(n_chars % 100) / 100.0::DOUBLE, 6) AS score FROM documents GROUP BY 1, 2",
    "newest_supported": f"WITH {_POSTS}, f AS (SELECT source AS qid, topic AS intent, id FROM posts WHERE {_NOTICE} QUALIFY row_number() OVER (PARTITION BY source, topic ORDER BY published IS NULL, published DESC, id % 13 DESC, id) = 1) SELECT qid, intent, id FROM f WHERE id % 2 = 0",
}
SQL["secret_scan"] = "WITH x AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in _UNSAFE) + " WHEN regexp_matches(regexp_replace(t, '(?i)https?://[^\\s<>\"'']+', '', 'g'), '(?:^|[^\\w])/(?:[^/]|$)') THEN 'posix_path' END AS unsafe, false AS safe FROM x"
SQL["error_detail"] = "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '오류 ' || role WHEN turn % 3 = 0 THEN '안내 ' || role ELSE 'fallback' END AS message FROM conversations"
_SENT = "list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
SQL["context_compression"] = f"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS i FROM documents),
    h AS (SELECT *, len(list_intersect(list_distinct({_WORDS.format('s')}), ['the', 'der', 'la', 'of'])) AS h FROM s),
    t AS (SELECT * FROM h WHERE h > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, i) <= 3),
    c AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS c FROM t GROUP BY doc_id)
    SELECT d.doc_id AS id, md5(coalesce(c.c, d.text)) AS context_md5 FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id"""
SQL["line_dedup"] = f"""WITH a AS (SELECT DISTINCT id, line, list_distinct({_WORDS.format('line')}) AS w FROM (SELECT item_id AS id, unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE len({_WORDS.format('line')}) >= 8),
    b AS (SELECT DISTINCT id, line, list_distinct({_WORDS.format('line')}) AS w FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE len({_WORDS.format('line')}) >= 8),
    p AS (SELECT a.id AS a_id, b.id AS b_id, a.line AS al, b.line AS bl, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM a JOIN b ON len(a.w) BETWEEN 0.8 * len(b.w) AND 1.25 * len(b.w))
    SELECT a_id, b_id, count(*) AS pairs, round(max(i::DOUBLE / (n - i)), 6) AS share FROM p WHERE i::DOUBLE / (n - i) >= 0.8 GROUP BY a_id, b_id"""
SQL["match_terms"] = f"""WITH x AS (SELECT item_id AS qid, list_filter({_WORDS.format('text')}, lambda s: length(s) >= 2) AS t, {_COMPACT.format('text')} AS c FROM benchmark)
    SELECT qid, array_to_string(list_sort(list_distinct(list_concat(t, [c], CASE WHEN contains(c, 'thon') OR contains(c, 'ntion') THEN ['thon', 'ntion'] ELSE [] END))), ' ') AS terms,
        array_to_string(list_sort(list_filter(list_distinct(t), lambda s: s NOT IN ('latest', 'is', 'that', '학년도', '학기', '여름계절', '겨울계절') AND NOT regexp_full_match(s, '[0-9]+'))), ' ') AS distinctive FROM x"""
SQL["suggested_questions"] = f"SELECT doc_id, CASE WHEN {_TOPIC} = 'english' THEN 'What is new?|Who is here?|Where is it?' ELSE 'Where is it?|What is new?|When is it?' END AS questions FROM documents"
SQL["query_plan_whole"] = SQL["query_plan"].replace("substring(text, 1, 20)", "text")
SQL["hybrid_search"] = f"""WITH {_bm25(100, grams=True)}, {_dense(100)}, f AS (SELECT coalesce(m.qid, dn.qid) AS qid, coalesce(m.id, dn.id) AS id, m.rank AS l, dn.rank AS d FROM m FULL JOIN dn ON dn.qid = m.qid AND dn.id = m.id),
    s AS (SELECT *, coalesce(1.0::DOUBLE / (60 + l), 0) + coalesce(1.0::DOUBLE / (60 + d), 0) AS fused FROM f)
    SELECT qid, id, CAST(l AS INTEGER) AS lexical_rank, CAST(d AS INTEGER) AS dense_rank, round(fused, 9) AS fused, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(fused, 12) DESC, id) AS INTEGER) AS place FROM s QUALIFY place <= 10"""

SQL["knn_indexed"] = SQL["knn_batch"]
SQL["knn_indexed_category"] = f"""WITH q AS (SELECT vec_id AS qid, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), n AS (SELECT b.qid, a.vec_id AS id, {_D} AS distance FROM embeddings AS a JOIN q AS b ON b.label = a.label)
    SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank, round(distance, 6) + 0.0 AS distance FROM n QUALIFY rank <= 5"""
SQL["bm25_indexed"] = SQL["bm25_topk"]


def _tree(rows: str, key: str = "") -> str:
    """Levels of a digest tree over `rows`, a query that gives `d` (and the key's column)."""
    k, by = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return f"""l AS (SELECT {k}substring(d, 1, 4) AS range, count(*) AS rows, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM ({rows}) GROUP BY {k}substring(d, 1, 4)),
    g AS (SELECT {k}substring(range, 1, 2) AS range, CAST(sum(rows) AS BIGINT) AS rows, sha256(string_agg(digest, '' ORDER BY l.range)) AS digest FROM l GROUP BY {k}substring(range, 1, 2)),
    t AS (SELECT {k}CAST(2 AS BIGINT) AS level, range, rows, digest FROM l UNION ALL SELECT {k}1, range, rows, digest FROM g UNION ALL SELECT {k}0, '', CAST(coalesce(sum(rows), 0) AS BIGINT), sha256(coalesce(string_agg(digest, '' ORDER BY range), '')) FROM g {by})"""


_WHOLE = "array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(x::DOUBLE * 1024) AS BIGINT) AS VARCHAR)), ',')"
SQL["content_digest"] = " UNION ALL ".join(
    f"SELECT '{n}' AS name, * FROM (WITH {_tree(f'SELECT sha256(CAST(to_json({r}) AS VARCHAR)) AS d FROM {n}')} SELECT * FROM t)"
    for n, r in (("documents", "{'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text}"), ("embeddings", f"{{'label': label, 'vec_id': vec_id, 'whole': {_WHOLE}}}"))
)
SQL["strict_reasons"] = f"""WITH d AS (SELECT *, CAST(substring(source, 4) AS INTEGER) % 8 AS n FROM documents),
    a AS (WITH {_tree("SELECT source, sha256(CAST(to_json({'doc_id': doc_id, 'text': text || CASE WHEN n = 2 AND doc_id % 2 = 0 THEN '!' ELSE '' END}) AS VARCHAR)) AS d FROM d", "source")} SELECT * FROM t WHERE level = 0),
    b AS (WITH {_tree("SELECT source, sha256(CAST(to_json({'doc_id': doc_id, 'text': text}) AS VARCHAR)) AS d FROM d WHERE n <> 6", "source")} SELECT * FROM t WHERE level = 0),
    x AS (SELECT a.source, CAST(substring(a.source, 4) AS INTEGER) % 8 AS n, coalesce(b.rows, 0) AS count, a.rows AS then_rows, a.digest = b.digest AS same FROM a LEFT JOIN b ON b.source = a.source)
    SELECT source, count, CASE WHEN n = 7 THEN 'index_unavailable' WHEN count = 0 THEN 'empty_index' WHEN n = 5 THEN 'missing_manifest' WHEN n = 4 THEN 'invalid_manifest' WHEN n = 3 THEN 'settings_mismatch'
        WHEN NOT coalesce(same, false) THEN 'content_mismatch' WHEN then_rows + CASE WHEN n = 1 THEN 1 ELSE 0 END <> count THEN 'chunk_count_mismatch' ELSE 'compatible' END AS reason FROM x"""
SQL["topic_automaton"] = SQL["topic_classify"]
SQL["json_shapes"] = """WITH b AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '[' || props || ']' WHEN 1 THEN substring(props, 2) WHEN 2 THEN 'null' WHEN 3 THEN CAST(value AS VARCHAR) WHEN 4 THEN '"' || event_type || '"' ELSE props END AS b FROM events),
    k AS (SELECT event_id, b, CASE WHEN NOT json_valid(b) THEN 'broken' WHEN json_type(b) = 'OBJECT' THEN 'object' WHEN json_type(b) = 'ARRAY' THEN 'array' WHEN json_type(b) = 'NULL' THEN 'null' ELSE 'scalar' END AS kind FROM b WHERE b IS NOT NULL)
    SELECT e.event_id, kind, CASE WHEN kind = 'object' THEN TRY_CAST(json_extract(b, '$.k') AS BIGINT) END AS k FROM events e LEFT JOIN k ON k.event_id = e.event_id"""
SQL["rerank_order"] = f"""WITH {_dense(20)}, f AS (SELECT dn.qid, dn.id, floor((1 - distance) * 4) AS score, lang = 'en' AS tm, n_chars > 1500 AS bm, dn.id % 3 <> 0 AS te, dn.id % 5 = 0 AS co, CASE WHEN dn.id % 4 <> 0 THEN dn.id % 10 END AS published FROM dn JOIN documents d ON d.doc_id = dn.id)
    SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY co, NOT tm, NOT bm, NOT te, score DESC, published DESC NULLS LAST, id) AS INTEGER) AS place FROM f"""
SQL["chunk_headers"] = """WITH w AS (SELECT doc_id, lang, text, unnest(range(0, CAST(floor((greatest(length(text) - 150, 1) - 1) / 750) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0)
    SELECT doc_id AS id, k AS chunk_no, md5('제목: ' || coalesce(lang, '') || chr(10) || '작성일: ' || CASE WHEN doc_id % 3 > 0 THEN '2024-01-0' || (doc_id % 9 + 1) ELSE '' END || chr(10) || CASE WHEN doc_id % 19 = 0 THEN '문서 상태: 역사 정보 (현재 수치·현황 아님)' || chr(10) ELSE '' END || '본문: ' || substring(text, k * 750 + 1, 900)) AS text_md5 FROM w"""
#: A window ends behind the last line end, sentence end or space that begins within its last fifth; the walk is recursive.
SQL["chunk_boundary"] = """WITH RECURSIVE d AS (SELECT doc_id AS id, text, length(text) AS n FROM documents WHERE length(text) > 0),
    c AS (SELECT id, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS start, {end0} AS stop FROM d
        UNION ALL SELECT id, chunk_no + 1, here, {end1} FROM (SELECT c.id, c.chunk_no, greatest(c.start + 1, c.stop - 150) AS here, d.text, d.n FROM c JOIN d ON d.id = c.id WHERE c.stop < d.n))
    SELECT c.id, chunk_no, CAST(start AS INTEGER) AS start, substring(d.text, start + 1, stop - start) AS text FROM c JOIN d ON d.id = c.id"""


def _stop(at: str) -> str:
    """Where the window from `at` ends: of the text's 900 characters the last 180 (and a mark's length before) may end it."""
    tail = lambda m: f"substring(text, {at} + 720 - {m} + 1, 180 + {m})"
    last = lambda mark, m: f"CASE WHEN contains({tail(m)}, {mark}) THEN {at} + 720 - {m} + length({tail(m)}) - instr(reverse({tail(m)}), reverse({mark})) + 1 END"
    return f"CASE WHEN {at} + 900 >= n THEN n ELSE coalesce({last('chr(10)', 1)}, {last(chr(39) + '. ' + chr(39), 2)}, {last(chr(39) + ' ' + chr(39), 1)}, {at} + 900) END"


SQL["chunk_boundary"] = SQL["chunk_boundary"].format(end0=_stop("CAST(0 AS BIGINT)"), end1=_stop("here"))
_ANSWERS = "['latest', 'is', 'that', '학년도', '학기', '여름계절', '겨울계절']"
SQL["accuracy_pipeline"] = f"""WITH {_bm25(100, grams=True)}, {_dense(100)}, fu AS (SELECT coalesce(m.qid, dn.qid) AS qid, coalesce(m.id, dn.id) AS id, m.rank AS l, dn.rank AS r FROM m FULL JOIN dn ON dn.qid = m.qid AND dn.id = m.id),
    su AS (SELECT *, coalesce(1.0::DOUBLE / (60 + l), 0) + coalesce(1.0::DOUBLE / (60 + r), 0) AS fused FROM fu),
    hy AS (SELECT * FROM su QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(fused, 12) DESC, id) <= 10),
    ki AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'static' WHEN doc_id % 19 = 0 THEN 'historical' ELSE 'notice' END AS kind FROM documents),
    ch AS (SELECT doc_id AS id, text, split_part(text, chr(10), 1) AS title, source || '/' || (doc_id // 2) AS url, CASE WHEN doc_id % 10 <> 3 AND kind = 'notice' THEN doc_id % 365 END AS published, lang AS intent, kind FROM ki),
    qu AS (SELECT item_id AS qid, text AS question, item_id % 5 = 0 AS general, CASE WHEN item_id % 4 = 1 THEN 'en' END AS asked, item_id % 3 = 0 AS recency, {_COMPACT.format('text')} AS c,
        list_filter({_WORDS.format('text')}, lambda s: length(s) >= 2) AS w FROM benchmark),
    qt AS (SELECT *, list_distinct(list_concat(w, [c], CASE WHEN contains(c, 'thon') OR contains(c, 'ntion') THEN ['thon', 'ntion'] ELSE [] END)) AS terms,
        list_filter(list_distinct(w), lambda s: NOT list_contains({_ANSWERS}, s) AND NOT regexp_full_match(s, '[0-9]+')) AS dist FROM qu),
    ca AS (SELECT hy.qid, hy.id, l, r, fused, ch.* EXCLUDE (id), qt.* EXCLUDE (qid, c, w), {_COMPACT.format('title')} AS flat, {_COMPACT.format('ch.text')} AS body FROM hy JOIN ch ON ch.id = hy.id JOIN qt ON qt.qid = hy.qid),
    sk AS (SELECT *, least(1.0::DOUBLE, fused / (2.0::DOUBLE / 61) + 0.08::DOUBLE * len(list_filter(dist, lambda s: length(s) >= 4 AND length(s) <= length(flat) AND contains(flat, s)))
            + least(0.24::DOUBLE, 0.12::DOUBLE * len(list_filter(terms, lambda s: length(s) >= 2 AND length(s) <= length(flat) AND contains(flat, s))))) AS score,
        len(list_filter(['the', 'der', 'les', 'license'], lambda k: contains(flat, k) AND len(list_filter(terms, lambda t: length(t) >= 2 AND (contains(t, k) OR contains(k, t)))) > 0)) > 0 AS marked,
        list_filter(dist, lambda s: length(s) >= 2 AND contains(flat, s)) AS o, len(list_filter(dist, lambda s: contains(body, s))) > 0 AS in_body,
        {_year('question')} AS qy, {_year('title')} AS ty, {_term('question')} AS qt, {_term('title')} AS tt FROM ca),
    ju AS (SELECT *, CASE WHEN qy IS NOT NULL AND ty IS NULL OR qy <> ty OR qt IS NOT NULL AND tt IS NULL OR qt <> tt THEN 'time' WHEN general AND recency OR marked OR len(o) >= 2 OR len(list_filter(o, lambda s: length(s) >= 5)) > 0 THEN 'accepted' ELSE 'weak' END AS reason FROM sk),
    re AS (SELECT * FROM ju WHERE NOT coalesce(asked <> intent, false) AND reason <> 'time' AND ((reason = 'accepted' OR in_body) AND l IS NOT NULL AND r IS NOT NULL OR reason = 'accepted' AND l IS NOT NULL) AND score >= 0.1),
    ga AS (SELECT * FROM re QUALIFY score >= 0.75 * max(score) OVER (PARTITION BY qid)),
    pa AS (SELECT * FROM ga QUALIFY row_number() OVER (PARTITION BY qid, url ORDER BY score DESC, id) = 1),
    ne AS (SELECT * FROM pa WHERE kind = 'notice' AND (published IS NOT NULL OR NOT recency) QUALIFY row_number() OVER (PARTITION BY qid, intent ORDER BY published IS NULL, published DESC, score DESC, id) = 1),
    ev AS (SELECT *, 'newest' AS evidence FROM ne WHERE NOT general OR len(dist) = 0 OR len(list_filter(dist, lambda s: contains(flat || ' ' || body, s))) > 0 UNION ALL SELECT *, 'reference' FROM pa WHERE kind <> 'notice' AND NOT recency),
    se AS (SELECT qid, id, terms, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS i FROM ev),
    hi AS (SELECT *, len(list_intersect(list_distinct({_WORDS.format('s')}), terms)) AS h FROM se),
    to_ AS (SELECT * FROM hi WHERE h > 0 QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY h DESC, i) <= 3),
    co AS (SELECT qid, id, string_agg(s, ' ' ORDER BY i) AS c FROM to_ GROUP BY qid, id)
    SELECT ev.qid, ev.id, intent, evidence, round(score, 6) + 0.0 AS score, md5(coalesce(co.c, ev.text)) AS context_md5 FROM ev LEFT JOIN co ON co.qid = ev.qid AND co.id = ev.id"""
