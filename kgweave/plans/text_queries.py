"""Queries over texts, files, conversations, exports and the watcher, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgweave.functions import text as X
from kgweave.operators import context
from kgweave.plans.graph_queries import G, _PAIRS, QUESTION, built, communities, stored
from kgweave.plans.graph_queries import ORACLE as GRAPH_ORACLE
from kgweave.runtime import table
from kgweave.sinks import export, page, stores, vault
from kgweave.sources import code, detect, extract, ingest
from kgweave.streaming import watcher


def label_functions(spark, d):
    n = table(spark, d, "nodes").select("label").distinct()
    return n.select("label", X.normalize_for_search("label").alias("normalized"), X.sanitize_label("label").alias("sanitized"), X.token_estimate("label").alias("tokens"), X.capitalize("label").alias("capitalized"),
                    X.safe_name("label").alias("safe"), X.cypher_escape("label").alias("cypher"), X.file_name("label").alias("file_name"), X.match_score("label", X.query_terms(QUESTION)).alias("matches"))


def path_functions(spark, d):
    f = table(spark, d, "files").select("path").distinct()
    return f.select("path", X.basename("path").alias("basename"), X.stem("path").alias("stem"), X.dirname("path").alias("dirname"), X.file_base_name("path").alias("base_name"), X.short_path("path").alias("short_path"),
                    X.code_category("path").alias("category"), detect.extension().alias("ext"), detect.in_ignored_dir().alias("ignored"))


def path_hashes(spark, d):
    return table(spark, d, "files").select("path").distinct().select("path", X.stub_id("path").alias("stub_id"))


def url_functions(spark, d):
    n = table(spark, d, "nodes").where("source_url is not null").select("source_url").distinct()
    return n.select("source_url", X.url_type("source_url").alias("url_type"), X.url_filename("source_url").alias("file_name"), X.valid_url("source_url").alias("valid"))


def token_savings(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", X.token_estimate("text").alias("tokens"), F.size(X.words("text")).alias("n_words"), F.round(X.token_savings(X.token_estimate("text") / 500, F.size(X.words("text"))), 6).alias("savings"))


def paper_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", X.paper_score("text").alias("score"))


def document_headers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.headers("text")).alias("h")).select("doc_id", "h.level", "h.title", "h.line")


def document_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.tags("text")).alias("tag"))


def document_links(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.wiki_links("text")).alias("link"))


def document_graph(spark, d):
    docs = table(spark, d, "files").where(F.col("path").endswith(".md")).select("path", "content")
    return extract.document_edges(docs).select("source", "target", "relation", "confidence", "confidence_score", "source_file", "source_location")


def file_categories(spark, d):
    return detect.category_counts(table(spark, d, "files"))


def file_routes(spark, d):
    return detect.route(table(spark, d, "files").select("path").distinct()).select("path", "extractor", "server", detect.sensitive().alias("sensitive"))


def server_groups(spark, d):
    return detect.server_groups(table(spark, d, "files"))


def haskell_declarations(spark, d):
    return extract.haskell_lines(table(spark, d, "files").where("ext = 'hs'").select("path", "content")).select("path", "line", "part", "name", "kind")


def python_definitions(spark, d):
    return extract.python_definitions(table(spark, d, "files").where("ext = 'py'").select("path", "content").distinct())


def stub_nodes(spark, d):
    return extract.stub_nodes(table(spark, d, "files")).select("id", "label", "source_file")


def cache_split(spark, d):
    f = table(spark, d, "files").select("path", "content", "extraction_seq")
    cache = f.where("extraction_seq <= 4").select(detect.content_key().alias("key")).distinct()
    hits, misses = detect.cache_split(f.select("path", "content").distinct(), cache)
    return hits.select("path", F.lit("hit").alias("part")).unionByName(misses.select("path", F.lit("miss").alias("part")))


def manifest_changes(spark, d):
    f = table(spark, d, "files")
    latest = lambda rows: rows.groupBy("path").agg(F.max_by("content", F.struct("extraction_seq", "content")).alias("content"))
    old = latest(f.where("extraction_seq <= 4")).select("path", F.sha2("content", 256).alias("hash"))
    return detect.changed_files(latest(f.where("extraction_seq > 4")), old)


def conversation_nodes(spark, d):
    return context.conversation_nodes(table(spark, d, "conversations")).select("id", "label", "source_file", "captured_at", "kind")


def conversation_edges(spark, d):
    return context.conversation_edges(table(spark, d, "conversations")).select("source", "target", "relation", "confidence_score")


def conversation_search(spark, d):
    return context.search_conversations(table(spark, d, "conversations"), QUESTION)


def chat_community(spark, d):
    return context.with_chat_community(communities(spark, d), table(spark, d, "conversations"))


def cypher_nodes(spark, d):
    return export.cypher_nodes(built(spark, d).nodes)


def cypher_edges(spark, d):
    return export.cypher_edges(built(spark, d).edges)


def push_batches(spark, d):
    return export.push_batches(export.cypher_nodes(built(spark, d).nodes)).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("statement").alias("first"))


def graphml(spark, d):
    return export.graphml_lines(stored(spark, d))


def svg_positions(spark, d):
    return export.svg_positions(stored(spark, d), communities(spark, d)).select("id", "idx", "x", "y", "colour")


def vault_notes(spark, d):
    return export.vault_notes(stored(spark, d), communities(spark, d)).select("id", "file", "content")


def page_nodes(spark, d):
    return export.page_nodes(stored(spark, d), communities(spark, d)).select("id", "label", "file", "group", "degree")


def page_edges(spark, d):
    return export.page_edges(stored(spark, d))


def note_search(spark, d):
    return export.search_notes(built(spark, d).nodes, "parser")


def one_hop(spark, d):
    g = stored(spark, d)
    return export.one_hop(g, export.search_notes(g.nodes, "parser"))


def node_details(spark, d):
    return export.node_details(stored(spark, d), communities(spark, d))


def conversation_notes(spark, d):
    return export.conversation_note(table(spark, d, "conversations")).select("id", "file", "content")


def watch_batches(spark, d):
    e = table(spark, d, "events").select("ts", F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"))
    return watcher.change_batches(e, "1 hour").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_paths", "paths")


def code_declarations(spark, d):
    return code.code_declarations(table(spark, d, "files"))


def code_graph(spark, d):
    return code.code_edges(table(spark, d, "files")).select("source", "target", "relation", "source_location")


def url_notes(spark, d):
    return ingest.url_notes(table(spark, d, "nodes").select(F.col("source_url").alias("url"), "captured_at", "author", "contributor"))


def community_notes(spark, d):
    return vault.community_notes(stored(spark, d), communities(spark, d)).select("community_id", "file", "part", "pos", "line")


def canvas(spark, d):
    return vault.canvas(stored(spark, d), communities(spark, d))


def community_focus(spark, d):
    n, e = page.community_focus(stored(spark, d), communities(spark, d), FOCUS)
    return n.select(F.lit("node").alias("part"), F.col("id").alias("key"), F.col("label").alias("text")).unionByName(e.select(F.lit("edge").alias("part"), F.concat("source", F.lit("->"), "target").alias("key"), F.col("relation").alias("text")))


def cypher_communities(spark, d):
    return export.cypher_communities(stored(spark, d), communities(spark, d))


def token_sums(spark, d):
    return export.token_sums(table(spark, d, "conversations"))


def related_conversations(spark, d):
    c = table(spark, d, "conversations")
    return context.related_nodes(c, context.search_conversations(c, QUESTION))


def server_files(spark, d):
    return detect.server_files(table(spark, d, "files"))


def file_manifest(spark, d):
    return stores.manifest(table(spark, d, "files"))


def cached_rows(spark, d):
    return stores.cache_rows(table(spark, d, "files"), table(spark, d, "nodes").select("source_file", "id", "label").distinct()).select("path", "key", "n_rows")


def snapshot_changes(spark, d):
    f = table(spark, d, "files").select("path", "mtime", "n_bytes", "extraction_seq")
    return watcher.changes(f.where("extraction_seq <= 4"), f.where("extraction_seq > 4"))


FOCUS = 1

QUERIES = {
    f.__name__: f
    for f in (
        label_functions, path_functions, path_hashes, url_functions, token_savings, paper_scores, document_headers, document_tags, document_links, document_graph, file_categories, file_routes, server_groups,
        haskell_declarations, python_definitions, stub_nodes, cache_split, manifest_changes, conversation_nodes, conversation_edges, conversation_search, chat_community, cypher_nodes, cypher_edges, push_batches,
        graphml, svg_positions, vault_notes, page_nodes, page_edges, note_search, one_hop, node_details, conversation_notes, watch_batches,
        code_declarations, code_graph, url_notes, community_notes, canvas, community_focus, cypher_communities, token_sums, related_conversations, server_files, file_manifest, cached_rows, snapshot_changes,
    )
}

_WORDS = lambda c: f"len(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> ''))"
_HTML = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_M = lambda c: " + ".join(f"coalesce(contains(lower({c}), '{t}')::INT, 0)" for t in X.query_terms(QUESTION))
_MATCHES = _M("label")
_B = lambda c: f"string_split({c}, '/')[-1]"
_EXT = lambda c: f"regexp_extract({_B(c)}, '[^.]\\.([^.]+)$', 1)"
_FBN = lambda c: f"coalesce(nullif(regexp_extract({_B(c)}, '([^.]*)\\.[^.]{{1,5}}$', 1), ''), {_B(c)})"
_IGNORED = ", ".join(f"'{x}'" for x in detect.IGNORED_DIRS)
_CATS = ", ".join(f"('{e}', '{c}')" for c, es in detect.CATEGORIES.items() for e in es)
_case = lambda m, x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items())
_HASH = "lpad(list_reduce(list_prepend(0, list_transform(string_split(regexp_extract({0}, '^(.*/)?', 0), ''), lambda x: CASE WHEN x = '' THEN NULL ELSE unicode(x) END)), lambda a, x: CASE WHEN x IS NULL THEN a ELSE (a * 31 + x) % 65536 END)::VARCHAR, 5, '0')"
_HEADS = """h AS (SELECT {0} AS k, i AS line, x FROM (SELECT {0}, unnest(string_split({1}, chr(10))) AS x, unnest(range(1, len(string_split({1}, chr(10))) + 1)) AS i FROM {2} WHERE {1} IS NOT NULL)),
  hd AS (SELECT k, line, len(regexp_extract(x, '^ *(#{{1,4}})(.*)$', 1)) AS level, trim(regexp_extract(x, '^ *(#{{1,4}})(.*)$', 2)) AS title FROM h WHERE regexp_matches(x, '^ *#'))"""
_CL = "regexp_replace(title, '[^\\p{L}\\p{N}]', '', 'g')"
_SERVER = _case(detect.SERVERS, _EXT("path")) + " END"
_cy = lambda c: f"'''' || replace(replace(coalesce({c}, ''), '\\', '\\\\'), '''', '''''') || ''''"
_sens = " OR ".join([f"contains(n, '{p}')" for p in detect.SENSITIVE_NAMES] + [f"contains(d, '{p}')" for p in detect.SENSITIVE_DIRS])

ORACLE = {
    "path_functions": f"""SELECT path, {_B('path')} AS basename, string_split({_B('path')}, '.')[1] AS stem, regexp_extract(path, '^(.*/)?', 0) AS dirname, {_FBN('path')} AS base_name,
        array_to_string(string_split(path, '/')[-2:], '/') AS short_path, CASE WHEN regexp_matches(lower(path), '\\.(py|ts|js|go|rs|java|c|cpp|rb|cs|kt|scala|php|swift|lua|zig|hs|ex|m|jl)$') THEN 'code' WHEN suffix(lower(path), '.pdf') THEN 'paper' ELSE 'document' END AS category,
        {_EXT('path')} AS ext, len(list_filter(string_split(path, '/')[:-2], lambda x: x IN ({_IGNORED}))) > 0 AS ignored FROM (SELECT DISTINCT path FROM files)""",
    "label_functions": f"""SELECT label, lower(translate(label, '{X.ACCENTED}', '{X.PLAIN}')) AS normalized, left({_HTML("regexp_replace(label, '[\\x00-\\x1f\\x7f]', '', 'g')")}, 256) AS sanitized, ceil({_WORDS('label')} * 1.33)::BIGINT AS tokens,
        CASE WHEN regexp_matches(label, '^[a-z]') THEN upper(label[1]) || label[2:] ELSE label END AS capitalized, regexp_replace(label, '[\\n\\r"''`]', '', 'g') AS safe, replace(replace(label, '\\', '\\\\'), '''', '''''') AS cypher,
        regexp_replace(label, '[/\\\\:*?"<>|]', '_', 'g') AS file_name, {_MATCHES} AS matches FROM (SELECT DISTINCT label FROM nodes)""",
    "path_hashes": f"SELECT path, {_HASH.format('path')} || '_' || string_split({_B('path')}, '.')[1] AS stub_id FROM (SELECT DISTINCT path FROM files)",
    "url_functions": """SELECT source_url, CASE WHEN contains(source_url, 'twitter.com') OR contains(source_url, 'x.com') THEN 'twitter' WHEN contains(source_url, 'arxiv.org') THEN 'arxiv' WHEN suffix(source_url, '.pdf') THEN 'pdf'
        WHEN regexp_matches(source_url, '\\.(png|jpg|webp)$') THEN 'image' WHEN contains(source_url, 'youtube.com') OR contains(source_url, 'youtu.be') THEN 'youtube' ELSE 'webpage' END AS url_type,
        translate(right(source_url, 40), '/\\:*?.', '______') || '.md' AS file_name, regexp_matches(source_url, '^https?://') AS valid FROM (SELECT DISTINCT source_url FROM nodes WHERE source_url IS NOT NULL)""",
    "token_savings": f"SELECT doc_id, ceil({_WORDS('text')} * 1.33)::BIGINT AS tokens, {_WORDS('text')} AS n_words, CASE WHEN {_WORDS('text')} > 0 THEN round(greatest(0.0, 100.0 * (1 - ceil({_WORDS('text')} * 1.33) / 500 / ({_WORDS('text')} * 4.0 / 1000.0))), 6) ELSE 0 END::DOUBLE AS savings FROM documents WHERE text IS NOT NULL",
    "paper_scores": f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
        SELECT doc_id, (contains(t, '10.') AND contains(substr(t, strpos(t, '1') + 3), '/'))::INT + {" + ".join("(" + " OR ".join(f"contains(t, '{x}')" for x in g) + ")::INT" for g in X.PAPER_SIGNS)} AS score FROM t""",
    "document_headers": f"WITH {_HEADS.format('doc_id', 'text', 'documents')} SELECT k AS doc_id, level, title, line::INTEGER AS line FROM hd WHERE title <> ''",
    "document_links": "WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\[([^\\]|\\n]+)(?:\\|[^\\]\\n]*)?\\]\\]', 1)) AS link FROM documents) SELECT doc_id, trim(link) AS link FROM l",
    "file_categories": f"WITH m(ext, category) AS (VALUES {_CATS}) SELECT category, count(*) AS n_files FROM (SELECT path, {_EXT('path')} AS ext FROM (SELECT DISTINCT path FROM files)) JOIN m USING (ext) GROUP BY category",
    "file_routes": f"SELECT path, {_case(detect.EXTRACTORS, _EXT('path'))} ELSE 'stub' END AS extractor, {_SERVER} AS server, ({_sens}) AS sensitive FROM (SELECT DISTINCT path, {_B('path')} AS n, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM files)",
    "server_groups": f"SELECT server, count(*) AS n_files FROM (SELECT {_SERVER} AS server FROM (SELECT DISTINCT path FROM files)) WHERE server IS NOT NULL GROUP BY server",
    "stub_nodes": f"SELECT {_HASH.format('path')} || '_' || string_split({_B('path')}, '.')[1] AS id, {_B('path')} AS label, path AS source_file FROM (SELECT DISTINCT path FROM files)",
    "document_graph": f"""WITH f AS (SELECT DISTINCT path, content FROM files WHERE suffix(path, '.md')), {_HEADS.format('path', 'content', 'f')},
        e AS (SELECT {_HASH.format('k')} AS p, string_split({_B('k')}, '.')[1] AS s, k, line, level, title FROM hd WHERE title <> ''),
        l AS (SELECT path AS k, {_HASH.format('path')} AS p, string_split({_B('path')}, '.')[1] AS s, trim(unnest(regexp_extract_all(content, '\\[\\[([^\\]|\\n]+)(?:\\|[^\\]\\n]*)?\\]\\]', 1))) AS link FROM f),
        t AS (SELECT path AS k, {_HASH.format('path')} AS p, string_split({_B('path')}, '.')[1] AS s, unnest(regexp_extract_all('x' || content, '[^\\n]#([\\p{{L}}\\p{{N}}_/-]{{2,}})', 1)) AS tag FROM f)
        SELECT DISTINCT p || '_doc_' || s AS source, p || '_h' || level || '_' || {_CL} AS target, 'contains' AS relation, 'EXTRACTED' AS confidence, 1.0::DOUBLE AS confidence_score, k AS source_file, 'L' || line AS source_location FROM e
        UNION SELECT p || '_doc_' || s, p || '_tag_' || tag, 'references', 'EXTRACTED', 1.0, k, NULL FROM t UNION SELECT p || '_doc_' || s, link, 'references', 'INFERRED', 0.8, k, NULL FROM l WHERE link <> ''""",
    "haskell_declarations": """WITH f AS (SELECT path, content FROM files WHERE ext = 'hs' AND content IS NOT NULL), l AS (SELECT path, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM f),
        m AS (SELECT path, line, regexp_extract(t, '^module +([A-Z][\\w.]*)', 1) AS a, regexp_extract(t, '^import +(?:safe +)?(?:qualified +)?([A-Z][\\w.]*)', 1) AS b, regexp_extract(t, '^(data|newtype|type|class|instance) +([A-Z]\\w*)', 1) AS k,
          regexp_extract(t, '^(data|newtype|type|class|instance) +([A-Z]\\w*)', 2) AS c, regexp_extract(t, '^([a-z_][\\w'']*) *::', 1) AS v FROM l)
        SELECT path, line::INTEGER AS line, CASE WHEN a <> '' THEN 'module' WHEN b <> '' THEN 'import' ELSE 'declaration' END AS part, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), v) AS name,
          CASE WHEN a <> '' THEN 'Module' WHEN b <> '' THEN 'Import' WHEN v <> '' THEN 'Function' WHEN k = 'class' THEN 'Interface' ELSE 'Class' END AS kind FROM m WHERE a <> '' OR b <> '' OR c <> '' OR v <> ''""",
    "cache_split": """WITH f AS (SELECT DISTINCT path, content FROM files), c AS (SELECT DISTINCT path, coalesce(content, '') AS content FROM files WHERE extraction_seq <= 4)
        SELECT path, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.path = f.path AND c.content = coalesce(f.content, '')) THEN 'hit' ELSE 'miss' END AS part FROM f""",
    "manifest_changes": """WITH o AS (SELECT path, arg_max(content, (extraction_seq, content)) AS c FROM files WHERE extraction_seq <= 4 GROUP BY 1), n AS (SELECT path, arg_max(content, (extraction_seq, content)) AS c FROM files WHERE extraction_seq > 4 GROUP BY 1)
        SELECT * FROM (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.c <> n.c THEN 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path) WHERE change IS NOT NULL""",
    "conversation_nodes": "SELECT DISTINCT id, coalesce(question, '') AS label, 'memory/' || id || '.md' AS source_file, timestamp AS captured_at, 'Conversation' AS kind FROM conversations WHERE id IS NOT NULL",
    "conversation_edges": "WITH x AS (SELECT DISTINCT id AS source, unnest(relevant_nodes) AS target FROM conversations WHERE id IS NOT NULL) SELECT source, target, 'references' AS relation, 0.8::DOUBLE AS confidence_score FROM x WHERE target IS NOT NULL AND target <> ''",
    "conversation_search": f"""WITH c AS (SELECT id, question, summary FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY question DESC NULLS LAST, summary DESC NULLS LAST) AS rn FROM conversations WHERE id IS NOT NULL) WHERE rn = 1),
        s AS (SELECT id, question, 3 * ({_M('question')}) + ({_M('summary')}) AS score FROM c) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 10""",
    "chat_community": """WITH k AS (SELECT node_id, pos FROM communities WHERE community_id = 0), n AS (SELECT DISTINCT id FROM conversations WHERE id IS NOT NULL AND id NOT IN (SELECT node_id FROM k))
        SELECT community_id, node_id, pos FROM communities UNION ALL SELECT 0, id, (coalesce((SELECT max(pos) FROM k), -1) + row_number() OVER (ORDER BY id))::INTEGER FROM n""",
    "cypher_nodes": f"WITH {G} SELECT id, 'MERGE (n:Node {{id: ' || {_cy('id')} || '}}) SET n.label = ' || {_cy('label')} || ', n.file_type = ' || {_cy('file_type')} || ', n.source_file = ' || {_cy('source_file')} || ';' AS statement FROM gn",
    "cypher_edges": f"WITH {G} SELECT source, target, 'MATCH (a:Node {{id: ' || {_cy('source')} || '}}) MATCH (b:Node {{id: ' || {_cy('target')} || '}}) MERGE (a)-[r:`' || upper(relation) || '`]->(b) SET r.confidence = ' || {_cy('confidence')} || ';' AS statement FROM ge",
    "push_batches": f"WITH {G}, s AS (SELECT 'MERGE (n:Node {{id: ' || {_cy('id')} || '}}) SET n.label = ' || {_cy('label')} || ', n.file_type = ' || {_cy('file_type')} || ', n.source_file = ' || {_cy('source_file')} || ';' AS statement FROM gn), r AS (SELECT statement, (row_number() OVER (ORDER BY statement) - 1) // 50 AS batch FROM s) SELECT batch, count(*) AS n, min(statement) AS first FROM r GROUP BY batch",
    "svg_positions": f"""WITH {G}, r AS (SELECT gn.id, row_number() OVER (ORDER BY gn.id) - 1 AS idx, count(*) OVER () AS n, cm.c FROM gn LEFT JOIN cm ON cm.node_id = gn.id)
        SELECT id, idx, round(500 + 400 * cos(2 * pi() * idx / n), 3)::DOUBLE AS x, round(500 + 400 * sin(2 * pi() * idx / n), 3)::DOUBLE AS y, [{', '.join(f"'{c}'" for c in export.PALETTE)}][(coalesce(c, 0) % {len(export.PALETTE)} + 1)::INT] AS colour FROM r""",
    "page_nodes": f"WITH {G} SELECT gn.id, left({_HTML("regexp_replace(label, '[\\x00-\\x1f\\x7f]', '', 'g')")}, 256) AS label, coalesce(source_file, '') AS file, coalesce(cm.c, -1) AS \"group\", degree FROM gn JOIN dg USING (id) LEFT JOIN cm ON cm.node_id = gn.id",
    "page_edges": f"WITH {G} SELECT source, target, relation, confidence FROM ge WHERE source IN (SELECT id FROM gn) AND target IN (SELECT id FROM gn)",
    "note_search": f"WITH {G} SELECT id, label FROM gn WHERE contains(lower(label), 'parser') OR contains(lower(source_file), 'parser') ORDER BY CASE WHEN contains(id, '_h1_') THEN 1 WHEN contains(id, '_h2_') THEN 2 ELSE 0 END, label, id LIMIT 50",
    "one_hop": f"""WITH {G}, m AS (SELECT id FROM gn WHERE contains(lower(label), 'parser') OR contains(lower(source_file), 'parser') ORDER BY CASE WHEN contains(id, '_h1_') THEN 1 WHEN contains(id, '_h2_') THEN 2 ELSE 0 END, label, id LIMIT 50),
        e AS (SELECT source, target FROM ge WHERE source IN (SELECT id FROM gn) AND target IN (SELECT id FROM gn)), n AS (SELECT source AS id FROM e WHERE target IN (SELECT id FROM m) UNION SELECT target FROM e WHERE source IN (SELECT id FROM m))
        SELECT id, CASE WHEN id IN (SELECT id FROM m) THEN 'match' WHEN id IN (SELECT id FROM n) THEN 'neighbour' ELSE 'dim' END AS role FROM gn""",
    "node_details": f"""WITH {G}, e AS (SELECT source, target FROM ge WHERE source IN (SELECT id FROM gn) AND target IN (SELECT id FROM gn)), a AS (SELECT source AS id, target AS b FROM e UNION SELECT target, source FROM e), k AS (SELECT id, count(*) AS k FROM a GROUP BY 1)
        SELECT gn.id, label, array_to_string(string_split(source_file, '/')[-2:], '/') AS file, cm.c AS community_id, coalesce(k, 0) AS n_neighbours FROM gn LEFT JOIN cm ON cm.node_id = gn.id LEFT JOIN k ON k.id = gn.id""",
    "watch_batches": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(DISTINCT user_id)::INTEGER AS n_paths, string_agg(DISTINCT 'user/' || user_id, ', ' ORDER BY 'user/' || user_id) AS paths FROM events WHERE ts IS NOT NULL GROUP BY 1",
    "conversation_notes": """SELECT DISTINCT id, 'memory/' || id || '.md' AS file, '---' || chr(10) || 'id: "' || replace(id, '"', '\\"') || '"' || chr(10) || 'question: "' || replace(coalesce(question, ''), '"', '\\"') || '"' || chr(10) || 'timestamp: "' || replace(coalesce(timestamp, ''), '"', '\\"') || '"' || chr(10) ||
        'tokens_used: ' || coalesce(tokens_used::VARCHAR, '0') || chr(10) || '---' || chr(10) || coalesce(summary, '') || chr(10) AS content FROM conversations WHERE id IS NOT NULL""",
}

_sql = lambda x: "'" + x.replace("'", "''") + "'"
_lang = "CASE " + " ".join(f"WHEN suffix(path, '.{e}') THEN '{lang}'" for e, lang in code.LANGUAGES.items()) + " END"
_forms = lambda of: "CASE lang " + " ".join(f"WHEN '{lang}' THEN CASE " + " ".join(f"WHEN regexp_matches(t, {_sql(f)}) THEN {of(k, f)}" for k, f in fs) + " END" for lang, fs in code.FORMS.items()) + " END"
_DECLARED = f"""f AS (SELECT DISTINCT path, content, {_lang} AS lang FROM files WHERE content IS NOT NULL AND {_lang} IS NOT NULL),
  l AS (SELECT path, lang, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM f),
  dc AS (SELECT * FROM (SELECT path, line::INTEGER AS line, {_forms(lambda k, f: _sql(k))} AS kind, {_forms(lambda k, f: f"regexp_extract(t, {_sql(f)}, 1)")} AS name FROM l) WHERE name <> '')"""
_stub = f"{_HASH.format('path')} || '_' || string_split({_B('path')}, '.')[1]"
_note = lambda c: "coalesce('\"' || " + c + " || '\"', 'null')"
_stmt = lambda c: f"replace(replace({c}, '\\', '\\\\'), '''', '''''')"
_share = "printf('%.3f', coalesce(k, 0) / greatest(1, size * (size - 1) // 2))"

ORACLE |= {
    "document_tags": "SELECT DISTINCT doc_id, unnest(regexp_extract_all('x' || text, '[^\\n]#([\\p{L}\\p{N}_/-]{2,})', 1)) AS tag FROM documents",
    "graphml": f"""WITH {G} SELECT 0 AS ord, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || '<key id="label" for="node" attr.name="label" attr.type="string"/>' || chr(10) || '<key id="relation" for="edge" attr.name="relation" attr.type="string"/>' || chr(10) || '<graph edgedefault="undirected">' AS line
        UNION ALL SELECT 3, '</graph></graphml>' UNION ALL SELECT 1, '<node id="' || {_HTML('id')} || '"><data key="label">' || {_HTML("coalesce(label, '')")} || '</data></node>' FROM gn
        UNION ALL SELECT 2, '<edge source="' || {_HTML('source')} || '" target="' || {_HTML('target')} || '"><data key="relation">' || {_HTML('relation')} || '</data></edge>' FROM ge""",
    "vault_notes": f"""WITH {G}, n AS (SELECT gn.*, regexp_replace(coalesce(label, id), '[/\\\\:*?"<>|]', '_', 'g') AS name, cm.c FROM gn LEFT JOIN cm ON cm.node_id = gn.id)
        SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' ' || regexp_replace(id, '[/\\\\:*?"<>|]', '_', 'g') ELSE name END || '.md' AS file,
          '---' || chr(10) || 'id: ' || id || chr(10) || 'file_type: ' || coalesce(file_type, '') || chr(10) || 'source: ' || coalesce(source_file, '') || chr(10) || 'community: ' || coalesce(c::VARCHAR, '') || chr(10) || '---' || chr(10) || '# ' || coalesce(label, id) || chr(10) AS content FROM n""",
    "code_declarations": f"WITH {_DECLARED} SELECT path, line, kind, name FROM dc",
    "code_graph": f"""WITH {_DECLARED}, e AS (SELECT {_stub} AS source, {_stub} || CASE WHEN kind = 'Import' THEN '_import_' || name ELSE '_' || regexp_replace(name, '[\\n\\r"''`]', '', 'g') END AS target, kind = 'Import' AS imported, path, line FROM dc)
        SELECT source, target, CASE WHEN imported THEN 'imports' ELSE 'contains' END AS relation, 'L' || min(line) AS source_location FROM e GROUP BY source, target, imported, path""",
    "url_notes": f"""WITH u AS (SELECT source_url AS url, captured_at, author, contributor, row_number() OVER (PARTITION BY source_url ORDER BY captured_at NULLS FIRST, author NULLS FIRST, contributor NULLS FIRST) AS rn FROM nodes WHERE regexp_matches(source_url, '^https?://')),
        t AS (SELECT *, CASE WHEN contains(url, 'twitter.com') OR contains(url, 'x.com') THEN 'twitter' WHEN contains(url, 'arxiv.org') THEN 'arxiv' WHEN suffix(url, '.pdf') THEN 'pdf' WHEN regexp_matches(url, '\\.(png|jpg|webp)$') THEN 'image' WHEN contains(url, 'youtube.com') OR contains(url, 'youtu.be') THEN 'youtube' ELSE 'webpage' END AS type FROM u WHERE rn = 1)
        SELECT url, type, translate(right(url, 40), '/\\:*?.', '______') || CASE type WHEN 'pdf' THEN '.pdf' WHEN 'image' THEN '.png' ELSE '.md' END AS file,
          '---' || chr(10) || 'source_url: "' || url || '"' || chr(10) || 'captured_at: "' || coalesce(captured_at, '') || '"' || chr(10) || 'author: ' || {_note('author')} || chr(10) || 'contributor: ' || {_note('contributor')} || chr(10) || '---' || chr(10) AS content FROM t""",
    "community_notes": f"""WITH {G}, {_PAIRS}, s AS (SELECT community_id, count(*) AS n FROM communities GROUP BY 1)
        SELECT community_id, 'communities/_COMMUNITY_' || community_id || '.md' AS file, 0 AS part, 0 AS pos, '# Community ' || community_id || chr(10) || chr(10) || '- Members: ' || n || chr(10) || '- Cohesion: ' || {_share} || chr(10) || chr(10) || '## Members' || chr(10) AS line
          FROM s LEFT JOIN cs ON cs.c = s.community_id UNION ALL SELECT community_id, 'communities/_COMMUNITY_' || community_id || '.md', 1, pos, '- [[' || coalesce(label, 'unknown') || ']]' FROM communities LEFT JOIN gn ON gn.id = node_id""",
    "canvas": f"""WITH {G} SELECT 'node' AS part, (community_id::BIGINT * 1000 + pos) || ':' || node_id AS key, '  - id: ' || (community_id::BIGINT * 1000 + pos) || chr(10) || '    node: ' || node_id || chr(10) || '    community: ' || community_id AS text FROM communities
        UNION ALL SELECT 'edge', source || '->' || target, '  - from: ' || source || chr(10) || '    to: ' || target FROM ge""",
    "community_focus": f"""WITH {G}, k AS (SELECT gn.id, label FROM gn JOIN cm ON cm.node_id = gn.id WHERE cm.c = {FOCUS}) SELECT 'node' AS part, id AS key, left({_HTML("regexp_replace(label, '[\\x00-\\x1f\\x7f]', '', 'g')")}, 256) AS text FROM k
        UNION ALL SELECT 'edge', source || '->' || target, relation FROM ge WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)""",
    "cypher_communities": f"""WITH {G}, {_PAIRS}, lb AS (SELECT * FROM ({GRAPH_ORACLE['community_labels']}))
        SELECT 'community' AS kind, cs.c::VARCHAR AS key, 'MERGE (c:Community {{id: ' || cs.c || '}}) SET c.label = ''' || {_stmt('lb.label')} || ''', c.size = ' || size || ', c.cohesion = ' || {_share} || ';' AS statement FROM cs JOIN lb ON lb.community_id = cs.c
        UNION ALL SELECT DISTINCT 'member', community_id || ':' || node_id, 'MATCH (n:Node {{id: ''' || {_stmt('node_id')} || '''}}) MATCH (c:Community {{id: ' || community_id || '}}) MERGE (n)-[:BELONGS_TO]->(c);' FROM communities""",
    "token_sums": "SELECT count(*) AS exchanges, coalesce(sum(t), 0)::BIGINT AS tokens FROM (SELECT id, max(greatest(coalesce(tokens_used, 0), 0)) AS t FROM conversations WHERE id IS NOT NULL GROUP BY id)",
    "related_conversations": f"""WITH f AS (SELECT * FROM ({ORACLE['conversation_search']})), x AS (SELECT DISTINCT id, unnest(relevant_nodes) AS target FROM conversations WHERE id IS NOT NULL), r AS (SELECT id, string_agg(target, ', ' ORDER BY target) AS related FROM x WHERE target <> '' GROUP BY id)
        SELECT f.id, question, score, coalesce(related, '') AS related FROM f LEFT JOIN r ON r.id = f.id""",
    "server_files": f"SELECT server, path FROM (SELECT path, {_SERVER} AS server FROM (SELECT DISTINCT path FROM files)) WHERE server IS NOT NULL",
    "file_manifest": "SELECT path, max(sha256(coalesce(content, ''))) AS hash FROM files WHERE path IS NOT NULL GROUP BY path",
    "cached_rows": "WITH k AS (SELECT DISTINCT path, sha256(path || chr(0) || coalesce(content, '')) AS key FROM files), n AS (SELECT source_file, count(*)::INTEGER AS n FROM (SELECT DISTINCT source_file, id, label FROM nodes) GROUP BY 1) SELECT path, key, n AS n_rows FROM k JOIN n ON n.source_file = k.path",
    "snapshot_changes": """WITH o AS (SELECT * FROM (SELECT path, mtime, n_bytes, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, n_bytes DESC NULLS LAST) AS rn FROM files WHERE extraction_seq <= 4) WHERE rn = 1),
        n AS (SELECT * FROM (SELECT path, mtime, n_bytes, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, n_bytes DESC NULLS LAST) AS rn FROM files WHERE extraction_seq > 4) WHERE rn = 1)
        SELECT * FROM (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN (o.mtime, o.n_bytes) IS DISTINCT FROM (n.mtime, n.n_bytes) THEN 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path) WHERE change IS NOT NULL""",
}
