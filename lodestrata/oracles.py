"""DuckDB SQL that gives the same rows as the queries of the same name."""

from __future__ import annotations

from .config import INTENT_COLLECTIONS
from .functions.text import ENTITIES

_COS = "round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_DOT = "round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_L2 = "round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_HITS = f"SELECT v.vec_id, v.label, {_COS} AS score, q.label AS query_label, q.vec_id AS query_id FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id"
_WORDS = r"regexp_extract_all(text, '[^\t\n\f\r\x0B ]+')"
_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
_SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])[\t\n\f\r\x0B ]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"


def _pieces(parts: str) -> str:
    return f"""
        WITH p AS (SELECT doc_id, {parts} AS ps FROM documents),
        u AS (SELECT doc_id, unnest(range(len(ps)))::INTEGER AS idx, unnest(ps) AS piece FROM p)
        SELECT doc_id, idx, length(piece)::INTEGER AS length, sha256(piece) AS hash FROM u"""


def _pack(parts: str, sep: str, fresh: str = "x") -> str:
    last = "string_split(acc, chr(2))[-1]"
    return f"string_split(list_reduce({parts}, lambda acc, x: CASE WHEN length({last}) + {sep} + length(x) <= 512 THEN acc || {{sep}} || x ELSE acc || chr(2) || {fresh} END), chr(2))"


_TAIL = f"array_to_string(({_WORDS.replace('text', 'string_split(acc, chr(2))[-1]')})[-3:], ' ')"
_NL2 = "chr(10) || chr(10)"

_HTML = "html"
for _p, _r in (
    (r"(?is)<script[^>]*>.*?</script>", "' '"), (r"(?is)<style[^>]*>.*?</style>", "' '"), (r"(?s)<!--.*?-->", "' '"), (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</?p(?:\s[^>]*)?>", "chr(10)"), (r"<[^>]+>", "' '"),
):
    _HTML = f"regexp_replace({_HTML}, '{_p}', {_r}, 'g')"
_REFS = "MAP {" + ", ".join("'" + n + "': '" + c.replace("'", "''") + "'" for n, c in ENTITIES.items()) + "}"


def _unescape(t: str) -> str:
    """Parts begin behind ampersands; the first is kept as it is."""
    ref = r"regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});', 1)"
    code = f"CASE WHEN lower({ref}) LIKE '#x%' THEN ('0x' || substr({ref}, 3))::BIGINT WHEN {ref} LIKE '#%' THEN substr({ref}, 2)::BIGINT END"
    char = f"CASE WHEN {ref} = '' THEN NULL WHEN {ref} LIKE '#%' THEN CASE WHEN {code} > 0 AND {code} < 1114112 AND NOT {code} BETWEEN 55296 AND 57343 THEN chr(({code})::INTEGER) END ELSE refs[{ref}] END"
    read = f"CASE WHEN {char} IS NULL THEN '&' || p ELSE {char} || substr(p, length({ref}) + 2) END"
    return f"array_to_string([string_split({t}, '&')[1]] || list_transform(string_split({t}, '&')[2:], lambda p: {read}), '')"


_HTML = f"(SELECT {_unescape('h')} FROM (SELECT {_HTML} AS h))"
_HTML = rf"regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"

_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_LINKS = rf"""
    l AS (SELECT page_id, url, list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["\x27]([^"\x27]+)["\x27]', 1), lambda x: regexp_replace(x, '[?#].*$', '')) AS hs FROM pages),
    u AS (SELECT page_id, url, unnest(range(len(hs))) AS raw, unnest(hs) AS href FROM l),
    a AS (SELECT page_id, url, raw, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) || '://' || {_HOST} AS site, href FROM u),
    b AS (SELECT page_id, url, raw, CASE WHEN href = '' THEN site || {_PATH} WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
            WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) || ':' || href WHEN starts_with(href, '/') THEN site || href
            ELSE site || CASE WHEN regexp_replace({_PATH}, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '[^/]*$', '') END || href END AS link FROM a),
    f AS (SELECT page_id, url, link, min(raw) AS raw FROM b WHERE regexp_matches(link, '^https?://[^/]') GROUP BY ALL),
    k AS (SELECT page_id, url, link, (row_number() OVER (PARTITION BY page_id ORDER BY raw) - 1)::INTEGER AS pos FROM f)"""
_EDGES = rf"""{_LINKS},
    s0 AS (SELECT {_HOST} || {_PATH} AS src, pos, link AS url FROM k),
    e AS (SELECT src, pos, {_HOST} || {_PATH} AS dst FROM s0)"""



def _bag(item: str) -> str:
    return f"printf('%012x', (coalesce(sum(('0x' || substr(sha256({item}), 1, 12))::BIGINT), 0) % 281474976710656)::BIGINT)"


_COVERED = "c AS (SELECT d.doc_id, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"
_COVERAGE = f"""WITH {_COVERED},
    g AS (SELECT source, count(*) AS total, count(quality) AS documented, round(avg(coalesce(quality, 0)), 6) AS avg_completeness FROM c GROUP BY source),
    s AS (SELECT *, round(documented * 100.0::DOUBLE / total, 6) AS coverage_pct FROM g)"""
_DAILY = """WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS total, count(*) FILTER (WHERE value >= 10) AS good FROM events GROUP BY ALL),
    r AS (SELECT day, event_type, round(good * 100.0::DOUBLE / total, 6) AS coverage FROM g),
    p AS (SELECT *, lag(coverage) OVER (PARTITION BY event_type ORDER BY day) AS previous FROM r),
    x AS (SELECT *, round(previous - coverage, 2) AS drop FROM p)"""
_US = "epoch_us(ts)"


def _trailing(by: str, seconds: int) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY us RANGE BETWEEN {seconds}000000 PRECEDING AND CURRENT ROW)"
    return f"SELECT *, count(*) {w} AS recent, min(us) {w} AS oldest, us - lag(us) OVER (PARTITION BY {by} ORDER BY us) AS gap_us FROM (SELECT *, {_US} AS us FROM events)"


_GOLDEN = r"""
    w AS (SELECT doc_id AS id, 'd' AS kind, unnest(list_distinct(regexp_extract_all(lower(text), '[^\t\n\f\r\x0B ]+'))) AS w FROM documents
          UNION ALL SELECT item_id, 'i', unnest(list_distinct(regexp_extract_all(lower(text), '[^\t\n\f\r\x0B ]+'))) FROM benchmark),
    o AS (SELECT i.id AS item_id, d.id AS doc_id, count(*) AS overlap FROM w i JOIN w d ON i.w = d.w AND i.kind = 'i' AND d.kind = 'd' GROUP BY ALL),
    r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM o),
    e AS (SELECT i.item_id, d.doc_id FROM benchmark i JOIN documents d ON contains(d.text, i.text))"""


def _recall(k: int, name: str) -> str:
    return f"""{name} AS (SELECT b.item_id, (SELECT count(*) FROM e WHERE e.item_id = b.item_id) AS n_expected,
        (SELECT count(*) FROM e JOIN r USING (item_id, doc_id) WHERE e.item_id = b.item_id AND r.rank <= {k}) AS n_hits FROM benchmark b),
    {name}r AS (SELECT *, CASE WHEN n_expected > 0 THEN round(n_hits::DOUBLE / n_expected, 6) ELSE 0.0 END AS recall FROM {name})"""


_INTENT = r"""CASE WHEN regexp_matches(t, '^/stats') THEN 'stats' WHEN regexp_matches(t, '^/(survie|help_me_survive)') THEN 'survival' WHEN regexp_matches(t, '^/recipe') THEN 'recipe'
    WHEN regexp_matches(t, '^/(moddoc|luaapi|javaapi)') THEN 'moddoc' WHEN regexp_matches(t, '^/search') THEN 'search' WHEN regexp_matches(t, 'stats?\s*(?:de\s*)?([a-z]+\.[a-z]+)') THEN 'stats'
    WHEN contains(t, 'recette') OR contains(t, 'craft') OR contains(t, 'artisanat') THEN 'recipe'
    WHEN contains(t, 'moddoc') OR contains(t, 'lua api') OR contains(t, 'java api') OR contains(t, 'modding') OR contains(t, 'hook') THEN 'moddoc' ELSE 'search' END"""
_SEGMENTS = "(VALUES ('AUTOMOBILE', 300), ('BUILDING', 300), ('FURNITURE', 300), ('HOUSEHOLD', 300), ('MACHINERY', 300), ('UNKNOWN', 10)) AS s(segment, expected)"

ORACLES: dict[str, str] = {
    "cosine_topk": f"SELECT vec_id, label, score AS similarity FROM ({_HITS}) WHERE query_id = 0 ORDER BY score DESC, vec_id LIMIT 5",
    "dot_topk": f"SELECT v.vec_id, v.label, {_DOT} AS score FROM embeddings v JOIN embeddings q ON q.vec_id = 0 AND v.vec_id <> 0 ORDER BY score DESC, v.vec_id LIMIT 5",
    "euclid_topk": f"SELECT v.vec_id, v.label, {_L2} AS distance FROM embeddings v JOIN embeddings q ON q.vec_id = 0 AND v.vec_id <> 0 ORDER BY distance, v.vec_id LIMIT 5",
    "cosine_threshold": f"SELECT vec_id, label, score FROM ({_HITS}) WHERE query_id = 0 AND score >= 0.2",
    "collection_filtered_topk": f"SELECT vec_id, label, score FROM ({_HITS}) WHERE query_id = 0 AND label = query_label ORDER BY score DESC, vec_id LIMIT 5",
    "cross_collection_topk": f"SELECT label AS collection, vec_id, score FROM ({_HITS}) WHERE query_id = 0 ORDER BY score DESC, vec_id LIMIT 10",
    "quota_topk": f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM ({_HITS}) WHERE query_id = 0)
        SELECT label AS collection, vec_id, score FROM h WHERE rn <= greatest(1, 10 // (SELECT count(DISTINCT label) FROM embeddings)) ORDER BY score DESC, vec_id LIMIT 10""",
    "batch_query_topk": f"""WITH h AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM ({_HITS}) WHERE query_id BETWEEN 0 AND 4)
        SELECT query_id, rank, vec_id, score FROM h WHERE rank <= 5""",
    "exact_or_semantic": f"""WITH n AS (SELECT vec_id FROM ({_HITS}) WHERE query_id = 0 ORDER BY score DESC, vec_id LIMIT 1)
        SELECT r.id::BIGINT AS requested_id, coalesce(e.vec_id, n.vec_id) AS vec_id, CASE WHEN e.vec_id IS NULL THEN 'semantic' ELSE 'exact' END AS match
        FROM (VALUES (3), (-1)) r(id) LEFT JOIN embeddings e ON e.vec_id = r.id, n""",
    "point_lookup": "SELECT vec_id, label, len(embedding)::INTEGER AS dim FROM embeddings WHERE vec_id IN (1, 2, 3)",
    "collection_counts": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
    "metadata_filter_and": "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1'",
    "metadata_filter_or": "SELECT doc_id FROM documents WHERE lang = 'es' OR source = 'src3'",
    "version_not_filter": "SELECT doc_id, lang AS game_version FROM documents WHERE lang <> 'en'",
    "blank_filter": "SELECT source, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY source",
    "prose_truncate": "SELECT doc_id, length(text) AS full_length, length(left(text, 3000)) AS cut_length, sha256(left(text, 3000)) AS cut_hash FROM documents",
    "metadata_merge": "SELECT doc_id, 'lang=' || lang || ';size=' || n_chars || ';source=' || source || ';tier=bulk' AS meta FROM documents",
    "required_fields": """SELECT doc_id, 'n_chars must be at least 50' AS message FROM documents WHERE NOT n_chars >= 50
        UNION ALL SELECT doc_id, 'lang is not supported' FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
        UNION ALL SELECT doc_id, 'text is blank' FROM documents WHERE trim(text) = ''""",
    "entity_rules": r"""SELECT p_partkey, 'brand has no number' AS message FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-9][0-9]?$')
        UNION ALL SELECT p_partkey, 'size is too large' FROM part WHERE p_size > 45
        UNION ALL SELECT p_partkey, 'price is too low' FROM part WHERE p_retailprice < 905
        UNION ALL SELECT p_partkey, 'name has no two words' FROM part WHERE NOT regexp_matches(p_name, '^[a-z]+ [a-z]+$')""",
    "classify_entity": """SELECT CASE WHEN contains(lower(p_type), 'promo') OR contains(lower(p_type), 'large') THEN 'premium' WHEN contains(lower(p_type), 'economy') OR contains(lower(p_type), 'small') THEN 'basic'
        WHEN contains(lower(p_type), 'standard') THEN 'common' ELSE 'other' END AS kind, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1""",
    "intent_routing": rf"""WITH x AS (SELECT conv_id, turn, text, lower(trim(text)) AS t FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, {_INTENT} AS intent, nullif(regexp_extract(text, '\b([A-Z][a-zA-Z]+\.[A-Z][a-zA-Z]+)\b', 1), '') AS item_id,
            length(trim(regexp_replace(trim(text), '^/[A-Za-z_]+\s*', ''))) AS query_length FROM x""",
    "tier_classify": """SELECT doc_id, CASE WHEN toxic = 1 THEN 'red' WHEN quality = 0 THEN 'orange' ELSE 'green' END AS tier,
        NOT (toxic = 1 OR quality = 0) AS auto_publish, toxic = 1 AS escalate FROM labels""",
    "paragraph_split": f"""WITH p AS (SELECT doc_id, text, {_LINES} AS ps FROM documents),
        u AS (SELECT doc_id, text, unnest(range(len(ps)))::INTEGER AS idx, unnest(ps) AS piece FROM p)
        SELECT doc_id, idx, length(piece)::INTEGER AS length, (strpos(text, piece) - 1)::INTEGER AS start_offset FROM u""",
    "chunk_offsets": """WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
        o AS (SELECT doc_id, i, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(x) - length(ltrim(x)) AS s, length(trim(x)) AS n FROM l),
        k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, s, n FROM o WHERE n > 0),
        p AS (SELECT doc_id, r, 0 AS idx, s AS b, s + n AS e, n AS size FROM k WHERE r = 1
              UNION ALL SELECT k.doc_id, k.r, p.idx + (p.size + 2 + k.n > 512)::INTEGER, CASE WHEN p.size + 2 + k.n > 512 THEN k.s ELSE p.b END, k.s + k.n,
                     CASE WHEN p.size + 2 + k.n > 512 THEN k.n ELSE p.size + 2 + k.n END FROM p JOIN k ON k.doc_id = p.doc_id AND k.r = p.r + 1)
        SELECT doc_id, idx::INTEGER AS idx, min(b)::INTEGER AS start_offset, max(e)::INTEGER AS end_offset, max(size)::INTEGER AS length FROM p GROUP BY doc_id, idx""",
    "card_pieces": f"""WITH RECURSIVE h AS (SELECT doc_id, text, 'Item: ' || source AS head, {_WORDS.replace('text', "('Item: ' || source)")} AS hw FROM documents),
        w AS (SELECT doc_id, head, 60 - len(hw) AS budget, text, len({_WORDS}) + len(hw) + len({_LINES}) AS total FROM h),
        l AS (SELECT doc_id, head, budget, unnest(range(len(a))) AS i, trim(regexp_replace(unnest(a), '^\\s+|\\s+$', '', 'g')) AS x FROM (SELECT *, string_split(text, chr(10)) AS a FROM w)),
        m AS (SELECT *, {_WORDS.replace('text', 'x')} AS ws FROM l WHERE x <> ''),
        u AS (SELECT doc_id, head, budget, i, j, CASE WHEN len(ws) <= budget THEN x ELSE array_to_string(ws[j * budget + 1 : (j + 1) * budget], ' ') END AS x,
                     CASE WHEN len(ws) <= budget THEN len(ws) ELSE least(budget, len(ws) - j * budget) END AS n
              FROM (SELECT *, unnest(range(CASE WHEN len(ws) <= budget THEN 1 ELSE (len(ws) + budget - 1) // budget END)) AS j FROM m)),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS r FROM u),
        p AS (SELECT doc_id, head, budget, r, 0 AS idx, n, x AS body FROM k WHERE r = 1
              UNION ALL SELECT k.doc_id, k.head, k.budget, k.r, p.idx + (p.n + k.n > k.budget)::INTEGER, CASE WHEN p.n + k.n > k.budget THEN k.n ELSE p.n + k.n END,
                     CASE WHEN p.n + k.n > k.budget THEN k.x ELSE p.body || chr(10) || k.x END FROM p JOIN k ON k.doc_id = p.doc_id AND k.r = p.r + 1),
        f AS (SELECT doc_id, idx::INTEGER AS idx, any_value(head) || chr(10) || chr(10) || arg_max(body, r) AS piece FROM p GROUP BY doc_id, idx),
        c AS (SELECT doc_id, 'Item: ' || source || chr(10) || '---' || chr(10) || replace(text, chr(10), chr(10) || '---' || chr(10)) AS card FROM documents),
        g AS (SELECT c.doc_id, card, len({_WORDS.replace('text', 'card')}) > 60 AS cut FROM c),
        out AS (SELECT f.doc_id, f.idx, f.piece FROM f JOIN g USING (doc_id) WHERE g.cut UNION ALL SELECT doc_id, 0, card FROM g WHERE NOT cut)
        SELECT doc_id, idx, len({_WORDS.replace('text', 'piece')})::INTEGER AS n_words, sha256(piece) AS hash FROM out""",
    "stored_upsert": """SELECT d.doc_id, d.lang AS state, 1 AS version FROM documents d ANTI JOIN labels USING (doc_id)
        UNION ALL SELECT doc_id, 'q' || quality, 2 FROM labels UNION ALL SELECT -doc_id - 1, 'new', 2 FROM labels WHERE toxic = 1""",
    "raw_records": r"""WITH b AS (SELECT s_nationkey, s_name, s_suppkey || '|' || s_name || '|' || s_nationkey AS body FROM supplier)
        SELECT DISTINCT s_nationkey || '/' || left(sha256(body), 12) || '_' || left(regexp_replace(lower(trim(s_name)), '[^a-z0-9._-]+', '_', 'g'), 80) || '.json' AS file,
            sha256(body) AS hash, octet_length(encode(body))::BIGINT AS length FROM b""",
    "stream_file_versions": """WITH b AS (SELECT 's' || s_suppkey || '.txt' AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'again|' || s_suppkey ELSE s_name || '|' || s_nationkey END AS body FROM supplier)
        SELECT name, octet_length(encode(body))::BIGINT AS length, sha256(body) AS file_hash FROM b""",
    "stream_breaker": """SELECT user_id, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts), 2) OVER (PARTITION BY user_id ORDER BY ts) <= 172800000000, false) AS open
        FROM events WHERE event_type = 'error'""",
    "stream_heartbeat": """WITH b AS (SELECT user_id, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 86400000000, false) AS fresh FROM events),
        r AS (SELECT user_id, us, count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS restarts FROM b)
        SELECT user_id, us, restarts, restarts > 2 AS alert FROM r""",
    "heading_sections": f"""WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS place, ' ' || unnest(a) AS line
            FROM (SELECT doc_id, list_transform(string_split(replace(text, '```', '~~~'), chr(10)), lambda x: regexp_replace(x, '\\r$', '')) AS a FROM documents))
        SELECT doc_id::VARCHAR AS heading, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, {_bag("place || chr(10) || line")} AS lines_hash FROM l GROUP BY doc_id""",
    "csv_rows": """WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS t FROM documents)
        SELECT doc_id, length(t) AS n_chars, sha256(t) AS text_hash FROM t""",
    "stored_insert": "SELECT doc_id, 'base' AS origin FROM labels UNION ALL SELECT doc_id, 'batch' FROM documents d ANTI JOIN labels USING (doc_id)",
    "stored_delete": "SELECT doc_id, source FROM documents d ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id) WHERE source IS DISTINCT FROM 'src2'",
    "greedy_chunks": _pieces(_pack(_LINES, "2").replace("{sep}", _NL2)),
    "overlap_chunks": _pieces(_pack(_LINES, "2", f"{_TAIL} || {_NL2} || x").replace("{sep}", _NL2)),
    "sentence_split": _pieces(_SENTENCES),
    "sentence_chunks": _pieces(_pack(_SENTENCES, "1").replace("{sep}", "' '")),
    "fixed_chunks": _pieces("list_transform(range((length(text) + 511) // 512), lambda i: substr(text, i * 512 + 1, 512))"),
    "chunk_ids": f"""WITH p AS (SELECT doc_id, source, {_LINES} AS ps FROM documents), u AS (SELECT doc_id, source, unnest(range(len(ps)))::INTEGER AS idx FROM p)
        SELECT doc_id, idx, source || '::chunk::' || idx AS chunk_id, left(sha256(source || '.' || doc_id || '.' || idx), 32) AS entity_id FROM u""",
    "word_counts": f"SELECT lang, count(*) AS n_docs, sum(len({_WORDS}))::BIGINT AS n_words FROM documents GROUP BY lang",
    "content_hash_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "incremental_skip": "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0",
    "upsert_latest": """SELECT d.doc_id, d.lang AS state, 1 AS version FROM documents d ANTI JOIN labels USING (doc_id)
        UNION ALL SELECT doc_id, 'q' || quality, 2 FROM labels UNION ALL SELECT -doc_id - 1, 'new', 2 FROM labels WHERE toxic = 1""",
    "insert_ignore": "SELECT doc_id, 'base' AS origin FROM labels UNION ALL SELECT doc_id, 'batch' FROM documents ANTI JOIN labels USING (doc_id)",
    "delete_rows": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "directory_fingerprint": f"SELECT source, {_bag("doc_id || ':' || sha256(text)")} AS fingerprint FROM documents GROUP BY source",
    "batch_bytes": """WITH d AS (SELECT source, doc_id, n_chars + 512 AS bytes FROM documents),
        c AS (SELECT *, sum(bytes) OVER (PARTITION BY source ORDER BY doc_id) AS cum FROM d)
        SELECT source, ((cum - 1) // 100000)::BIGINT AS batch_no, count(*) AS n_rows, sum(bytes)::BIGINT AS n_bytes FROM c GROUP BY ALL""",
    "trigram_similarity": """WITH n AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part),
        p AS (SELECT name, '  ' || lower(name) || ' ' AS s FROM n), g AS (SELECT name, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS g FROM p)
        SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(a.g || b.g)), 6) AS similarity FROM g a JOIN g b ON a.name < b.name
        WHERE round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(a.g || b.g)), 6) >= 0.3""",
    "html_text": f"WITH m AS (SELECT {_REFS} AS refs), t AS (SELECT page_id, {_HTML} AS t FROM pages, m) SELECT page_id, length(t) AS text_length, left(t, 100) AS head, sha256(t) AS text_hash FROM t",
    "html_title": rf"""WITH m AS (SELECT {_REFS} AS refs), x AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS h, refs FROM pages, m),
        t AS (SELECT page_id, trim(regexp_replace({_unescape('h')}, '\s+', ' ', 'g')) AS t FROM x)
        SELECT page_id, CASE WHEN t = '' THEN 'Untitled' ELSE t END AS title FROM t""",
    "html_links": f"WITH {_LINKS} SELECT page_id, pos, link FROM k",
    "challenge_filter": """SELECT regexp_matches(lower(html), 'just a moment|/cdn-cgi/challenge-platform') AS challenge,
        regexp_matches(url, '^https?://[a-zA-Z0-9]') AS is_url, count(*) AS n FROM pages GROUP BY ALL""",
    "domain_counts": f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1",
    "link_graph": f"WITH {_EDGES} SELECT regexp_extract(src, '^[^/]*') AS site, regexp_extract(dst, '/.*$') AS path, count(*) AS n FROM e GROUP BY ALL",
    "crawl_bfs": f"""WITH RECURSIVE {_EDGES},
        o AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY pos, dst) AS rn FROM e WHERE string_split(src, '/')[1] = string_split(dst, '/')[1]) WHERE rn <= 20),
        s AS (SELECT min({_HOST} || {_PATH}) AS node FROM pages GROUP BY {_HOST}),
        c AS (SELECT node, 0 AS depth FROM s UNION SELECT o.dst, c.depth + 1 FROM c JOIN o ON o.src = c.node WHERE c.depth < 3),
        m AS (SELECT node, min(depth)::INTEGER AS depth FROM c GROUP BY node)
        SELECT node, depth FROM m QUALIFY row_number() OVER (PARTITION BY string_split(node, '/')[1] ORDER BY depth, node) <= 200""",
    "link_histogram": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "latest_artifact": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F')
        SELECT c_custkey, c_name, n_name, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ordered_on FROM l JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE rn = 1""",
    "success_rate_left_join": """WITH m AS (SELECT max(o_orderdate) AS m FROM orders)
        SELECT c_custkey, count(o_orderkey) AS total_runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS successes, round(avg(epoch(m) - epoch(o_orderdate)), 6) AS avg_seconds,
               round(round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0::DOUBLE / nullif(count(o_orderkey), 0), 2), 2) AS success_rate
        FROM customer CROSS JOIN m LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate > m - INTERVAL 365 DAY GROUP BY c_custkey""",
    "validation_trends": """WITH e AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY)
        SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS level, count(*) AS total, count(*) FILTER (WHERE value >= 10) AS passed, round(count(*) FILTER (WHERE value >= 10) * 100.0::DOUBLE / count(*), 6) AS pass_rate FROM e GROUP BY ALL""",
    "ingestion_health": """WITH e AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY)
        SELECT user_id % 10 AS source_type, event_type AS status, count(*) AS runs, round(avg(value), 6) AS avg_duration, sum((props->>'$.k')::BIGINT)::BIGINT AS chunks, count(*) FILTER (WHERE value < 5) AS failures FROM e GROUP BY ALL""",
    "project_stats": """SELECT user_id, count(*) AS total_runs, count(*) FILTER (WHERE event_type = 'purchase') AS success_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_run_at
        FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY user_id""",
    "coverage_summary": f"{_COVERAGE} SELECT *, CASE WHEN coverage_pct >= 95 THEN 'OK' WHEN coverage_pct >= 80 THEN 'WARN' ELSE 'FAIL' END AS status FROM s",
    "coverage_rollup": f"WITH {_COVERED} SELECT lang, source, count(*) AS total, count(quality) AS documented FROM c GROUP BY ROLLUP (lang, source)",
    "missing_labels": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "broken_references": """SELECT 'PART_' || l_partkey AS ref, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1""",
    "status_set_ops": """(SELECT o_custkey, 'both' AS op FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'O')
        UNION ALL (SELECT o_custkey, 'only' FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, 'only' FROM orders WHERE o_orderstatus = 'P')""",
    "expected_totals_join": f"""WITH x AS (SELECT segment, expected::BIGINT AS expected, (SELECT count(*) FROM customer WHERE c_mktsegment = segment) AS actual FROM {_SEGMENTS}),
        y AS (SELECT *, round(actual * 100.0::DOUBLE / expected, 6) AS share FROM x)
        SELECT *, CASE WHEN share >= 95 THEN 'OK' WHEN share >= 80 THEN 'WARN' ELSE 'FAIL' END AS status FROM y""",
    "class_refs": """WITH r AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM part)
        SELECT token, count(*) AS n, min(p_partkey) AS first_key FROM r WHERE token IN (SELECT string_split(p_name, ' ')[-1] FROM part) GROUP BY token""",
    "golden_recall": f"WITH {_GOLDEN}, {_recall(5, 'a')} SELECT * FROM ar",
    "missing_ids": f"WITH {_GOLDEN} SELECT e.item_id, e.doc_id FROM e LEFT JOIN (SELECT * FROM r WHERE rank <= 5) x USING (item_id, doc_id) WHERE x.rank IS NULL",
    "gate_result": f"""WITH {_GOLDEN}, {_recall(5, 'a')}
        SELECT count(*) AS questions, round(avg(recall), 6) AS avg_recall, min(recall) AS min_recall, count(*) FILTER (WHERE recall >= 0.75) AS n_pass, count(*) FILTER (WHERE recall < 0.75) AS n_fail,
               count(*) FILTER (WHERE recall = 1) AS n_perfect, round(avg(recall), 6) >= 0.75 AS passed FROM ar""",
    "regression_compare": f"""WITH {_GOLDEN}, {_recall(5, 'a')}, {_recall(3, 'b')},
        x AS (SELECT item_id, br.recall, ar.recall AS old_recall, round(br.recall - ar.recall, 6) AS delta FROM br JOIN ar USING (item_id))
        SELECT *, CASE WHEN delta < -0.1 THEN 'regression' WHEN delta > 0.1 THEN 'improvement' ELSE 'stable' END AS status FROM x""",
    "mode_filter": "SELECT lang, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY lang ORDER BY n DESC, first_seen LIMIT 1",
    "coverage_drop": f"{_DAILY} SELECT day, event_type, coverage, previous, drop FROM x QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) = 1",
    "coverage_sweep": f"{_DAILY} SELECT day, event_type, coverage, previous, drop, CASE WHEN drop >= 25 THEN 'critical' ELSE 'warning' END AS severity FROM x WHERE drop >= 10",
    "recent_runs": """SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INTEGER AS rank, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at
        FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 10""",
    "retention_keep_n": """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INTEGER AS rank
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 5""",
    "circuit_breaker": f"SELECT event_id, event_type, recent FROM ({_trailing('event_type', 60)}) WHERE recent >= 3",
    "rate_limit": f"SELECT event_id, user_id, recent, round(greatest(0.5::DOUBLE, 3600.0::DOUBLE - (us - oldest) / 1000000.0::DOUBLE), 6) AS delay FROM ({_trailing('user_id', 3600)}) WHERE recent >= 3",
    "restart_alerts": f"SELECT event_id, user_id, recent, gap_us, coalesce(gap_us < 600000000, false) AS cool_down FROM ({_trailing('user_id', 3600)}) WHERE recent > 2",
    "consecutive_failures": """WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
        c AS (SELECT user_id, island, count(*) FILTER (WHERE event_type = 'error') AS n FROM i GROUP BY ALL)
        SELECT user_id, max(n) AS longest, max(n) >= 3 AS open FROM c GROUP BY user_id""",
    "stale_sources": """WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1),
        a AS (SELECT user_id, last, ((epoch_us((SELECT max(ts) FROM events)) // 1000000 - epoch_us(last) // 1000000) // 3600)::BIGINT AS age_hours FROM l)
        SELECT user_id, strftime(last, '%Y-%m-%d %H:%M:%S.%f') AS last_at, age_hours FROM a WHERE age_hours > 12""",
    "alert_rules": f"""{_COVERAGE}, l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
        SELECT 'critical' AS level, segment AS subject FROM {_SEGMENTS.replace(' AS s(', ' AS sg(')} WHERE segment NOT IN (SELECT c_mktsegment FROM customer)
        UNION ALL SELECT 'warning', source FROM s WHERE coverage_pct > 0 AND coverage_pct < 50
        UNION ALL SELECT 'info', user_id::VARCHAR FROM l WHERE (epoch_us((SELECT max(ts) FROM events)) // 1000000 - epoch_us(last) // 1000000) // 3600 > 12""",
    "backoff_delay": "SELECT conv_id, turn, 5.0::DOUBLE * power(2.0::DOUBLE, turn) AS delay FROM conversations",
    "json_extract": "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS sum_k, max((props->>'$.k')::BIGINT) AS max_k FROM events GROUP BY 1",
    "tumbling_window": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS win_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "sliding_window": """WITH w AS (SELECT strftime(date_trunc('day', ts) - to_days(i::INTEGER), '%Y-%m-%d %H:%M:%S') AS win_start, event_type, value FROM events, range(7) r(i))
        SELECT win_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL""",
    "session_window": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, sid""",
    "stream_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS win_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "stream_dedup_upsert": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "validation_chain": """WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events),
        f AS (SELECT *, coalesce(sum((event_type = 'error')::INTEGER) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
        SELECT user_id, day, count(*) AS steps, count(*) FILTER (WHERE event_type = 'error') AS failures FROM f WHERE before = 0 GROUP BY ALL""",
    "validation_report": """WITH v AS (SELECT * FROM (VALUES ('null text', (SELECT round(avg((text IS NULL)::INTEGER), 6) FROM documents), 0.0, 0.01),
            ('short text', (SELECT round(avg((n_chars < 100)::INTEGER), 6) FROM documents), 0.01, 0.5), ('not english', (SELECT round(avg((lang <> 'en')::INTEGER), 6) FROM documents), 0.1, 0.3),
            ('no source', (SELECT round(avg((source IS NULL)::INTEGER), 6) FROM documents), 0.0, 0.0)) t(c, v, w, f))
        SELECT c AS "check", v AS value, CASE WHEN v <= w THEN 'PASS' WHEN v <= f THEN 'WARN' ELSE 'FAIL' END AS status FROM v""",
    "latest_turn": "SELECT conv_id, turn, role, length(text) AS length FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) = 1",
    "prompt_context": f"""WITH l AS (SELECT conv_id, role || ': ' || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations)
        SELECT conv_id, count(*) AS turns, (sum(length(line)) + count(*) - 1)::BIGINT AS length, {_bag("place || chr(10) || line")} AS context_hash FROM l GROUP BY conv_id""",
    "intent_collections": f"""WITH x AS (SELECT lower(trim(text)) AS t FROM conversations WHERE role = 'user'), i AS (SELECT {_INTENT} AS intent, count(*) AS n FROM x GROUP BY 1)
        SELECT collection, sum(n)::BIGINT AS n, count(*) AS intents FROM i JOIN (VALUES {", ".join(f"('{i}', '{c}')" for i, cs in INTENT_COLLECTIONS.items() for c in cs)}) r(intent, collection) USING (intent) GROUP BY collection""",
    "link_lookup": """SELECT DISTINCT p_brand AS source_name, p_type AS target_name, round(p_size / 50.0::DOUBLE, 6) AS confidence FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)""",
    "mean_coverage": f"{_COVERAGE} SELECT count(*) AS categories, round(avg(coverage_pct), 6) AS mean_coverage, min(coverage_pct) AS least_coverage FROM s",
    "pipeline_totals": """WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS stage, count(*) FILTER (WHERE value >= 5) AS done, count(*) FILTER (WHERE value < 5) AS bad FROM events GROUP BY ALL),
        s AS (SELECT *, CASE WHEN bad > done / 4.0::DOUBLE THEN bad ELSE 0 END AS failed FROM g)
        SELECT day, count(*) AS stages, sum(done)::BIGINT AS done, sum(failed)::BIGINT AS failed, count(*) FILTER (WHERE failed > 0) AS n_failures,
               coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (WHERE failed > 0), '') AS failures FROM s GROUP BY day""",
    "stream_changed_files": """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS version, sha256(CASE WHEN l.doc_id IS NULL THEN '1:' ELSE '2:' END || text) AS hash
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""",
    "status_replay": """WITH RECURSIVE e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type = 'purchase' AS passed, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS k FROM events),
        r AS (SELECT DISTINCT user_id, day, 0::BIGINT AS k, 'planning' AS status, 0 AS retries FROM e
              UNION ALL SELECT user_id, day, k, status, retries + (status = 'fixing')::INTEGER FROM (
                  SELECT e.user_id, e.day, e.k, r.retries, CASE r.status WHEN 'planning' THEN 'building' WHEN 'building' THEN 'validating' WHEN 'fixing' THEN 'validating' WHEN 'packaging' THEN 'done'
                      WHEN 'validating' THEN CASE WHEN e.passed THEN 'packaging' WHEN r.retries >= 2 THEN 'escalated' ELSE 'fixing' END ELSE r.status END AS status
                  FROM r JOIN e ON e.user_id = r.user_id AND e.day = r.day AND e.k = r.k + 1))
        SELECT user_id, day, status, retries, k::INTEGER AS events FROM r QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY k DESC) = 1""",
}
