"""The registered queries once more as SQL, to check them by."""

from __future__ import annotations

from nearkin.plans.queries import CHUNK_CHARS, CHUNK_WORDS

# The 29 whitespace characters, as a class RE2 understands.
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_PAGE_TEXT = _clean("regexp_replace(html, '<[^>]*>', ' ', 'g')")
_WHOLE_PAGE = "contains(html, '</html>')"
_TRUNCATED = "'extraction failed: ValueError: truncated page'"

_VECTORS = """
  vectors AS (SELECT vec_id AS row_id, label, embedding::double[] AS v FROM embeddings),
  scaled AS (
    SELECT row_id, label, list_transform(v, lambda x: x * (label + 1)) AS v FROM vectors)
"""

_CENTROIDS = f"""{_VECTORS},
  parts AS (
    SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vectors),
  means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY label, pos),
  centroids AS (
    SELECT label AS query_id, list(m ORDER BY pos) AS v FROM means GROUP BY label)
"""

def _closeness(t: str, q: str, metric: str) -> str:
    if metric == "cosine":
        return f"list_cosine_similarity({t}.v, {q}.v)"
    return f"pow(list_distance({t}.v, {q}.v), 2)"


def _knn(
    table: str, queries: str, k: int, metric: str, carry: str = "", keep: str = "true"
) -> str:
    """CTE ``hits`` with the k nearest rows of one CTE for each row of another."""
    extra = f", {carry}" if carry else ""
    order = "round(raw_score, 12) DESC"
    if metric == "l2":
        # twelve significant digits
        unit = "pow(10, floor(log10(raw_score)))"
        order = f"CASE WHEN raw_score > 0 THEN round(raw_score / {unit}, 11) * {unit} ELSE 0 END"
    score = "(raw_score + 1) / 2" if metric == "cosine" else "1 / (1 + raw_score)"
    return f"""
  pairs AS (
    SELECT q.query_id, t.row_id{", t." + carry if carry else ""},
           {_closeness("t", "q", metric)} AS raw_score
    FROM {table} t, {queries} q),
  ranked AS (
    SELECT *, row_number() OVER (
      PARTITION BY query_id ORDER BY {order}, row_id) AS rn
    FROM pairs WHERE {keep}),
  hits AS (
    SELECT query_id, rn::int AS rank, row_id{extra},
           raw_score, {score} AS score
    FROM ranked WHERE rn <= {k})
"""


# Rounded once, at the very end: rounding twice would make ties of its own.
_ROUNDED = "round(raw_score, 6) + 0.0 AS raw_score, round(score, 6) AS score"
_HITS = f"SELECT * REPLACE ({_ROUNDED}) FROM hits"


def _hashed(source: str, key: str, size: int | None, name: str) -> str:
    """CTEs ending in ``name(key, v)``: hashed words, averaged over chunks."""
    n = size if size is not None else 10**9
    return f"""
  {name}_t AS (
    SELECT {key} AS key, string_split({_clean("text")}, ' ') AS tok
    FROM {source} WHERE {_clean("text")} <> ''),
  {name}_c AS (
    SELECT key, i AS chunk_no, list_slice(tok, i * {n} + 1, (i + 1) * {n}) AS c
    FROM (SELECT *, unnest(range(0, (len(tok) + {n} - 1) // {n})) AS i FROM {name}_t)),
  {name}_w AS (SELECT key, chunk_no, unnest(c) AS w FROM {name}_c),
  {name}_f AS (
    SELECT key, chunk_no, ('0x' || substr(md5(w), 1, 8))::bigint % 64 AS b, count(*) AS n
    FROM {name}_w GROUP BY ALL),
  {name}_u AS (
    SELECT key, b,
           n / sqrt(sum(n * n) OVER (PARTITION BY key, chunk_no)) AS x FROM {name}_f),
  {name}_s AS (SELECT key, b, sum(x) AS x FROM {name}_u GROUP BY key, b),
  {name}_k AS (SELECT key, count(*) AS chunks FROM {name}_c GROUP BY key),
  {name}_l AS (
    SELECT k.key, d.b AS pos, coalesce(s.x, 0) / k.chunks AS x
    FROM {name}_k k CROSS JOIN (SELECT unnest(range(64)) AS b) d
    LEFT JOIN {name}_s s ON s.key = k.key AND s.b = d.b),
  {name} AS (SELECT key, list(x ORDER BY pos) AS v FROM {name}_l GROUP BY key)
"""


def _hashed_long(source: str, key: str, size: int | None) -> str:
    return f"""
WITH {_hashed(source, key, size, "h")}
SELECT key AS {key}, pos::int AS pos, round(x, 6) AS x FROM h_l
"""


def _search(k: int, metric: str) -> str:
    return f"""
WITH {_hashed("documents", "doc_id", 2048, "d")},
     {_hashed("benchmark", "item_id", None, "b")},
  docs AS (
    SELECT doc_id AS row_id, source || '/' || doc_id AS filename, v
    FROM d JOIN documents ON key = doc_id),
  asked AS (SELECT key AS query_id, v FROM b),
  {_knn("docs", "asked", k, metric, "filename")}
{_HITS}
"""


_CORPUS = f"""{_hashed("documents", "doc_id", 2048, "h")},
  corpus AS (
    SELECT doc_id AS row_id, sha1(text) AS id, source || '/' || doc_id AS filename, text, v
    FROM documents JOIN h ON key = doc_id)
"""


def _average_similarity(source: str, extra: str) -> str:
    """CTE ``averages``: mean cosine to the others, from all pairs."""
    return f"""
  pair_averages AS (
    SELECT a.row_id, avg(list_cosine_similarity(a.v, b.v)) AS avg_sim
    FROM {source} a JOIN {source} b ON a.row_id <> b.row_id GROUP BY ALL),
  averages AS (
    SELECT a.row_id{extra}, avg_sim FROM pair_averages JOIN {source} a USING (row_id))
"""


def _overfetch(keep: str) -> str:
    """The first five of all rows in order that a condition leaves."""
    return f"""
WITH {_CENTROIDS}, {_knn("scaled", "centroids", 1_000_000_000, "cosine", "label")},
  again AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn
    FROM hits WHERE {keep})
SELECT query_id, rn::int AS rank, row_id, label, {_ROUNDED} FROM again WHERE rn <= 5
"""


def _search_page(metric: str) -> str:
    scale = "sqrt(list_inner_product(v, v))" if metric == "cosine" else "1"
    asked = f"""{_CORPUS}, {_hashed("benchmark", "item_id", None, "b")},
  scaled_corpus AS (
    SELECT row_id, filename, list_transform(v, lambda x: x / {scale}) AS v FROM corpus),
  asked AS (SELECT key AS query_id, v FROM b)"""
    return f"""
{_pca(asked, "scaled_corpus")},
  {_knn("scaled_corpus", "asked", 5, metric, "filename")}
SELECT h.query_id, p.row_id, CASE WHEN h.query_id IS NULL THEN 'background' ELSE 'neighbour' END AS role,
       pc1, pc2, rank, h.filename, round(score, 3) AS score
FROM points p LEFT JOIN hits h ON h.row_id = p.row_id
"""


_WORDS = f"SELECT unnest(string_split({_clean('text')}, ' ')) AS word"

# Power iteration by repeated squaring: the square of a square ... of the
# covariance converges to the projector on the leading axis.
def _pca(inputs: str, source: str) -> str:
    """CTEs ending in ``points(row_id, pc1, pc2)``."""
    return f"""
WITH RECURSIVE {inputs},
  long AS (SELECT row_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {source}),
  mean AS (SELECT pos, avg(x) AS m FROM long GROUP BY pos),
  centred AS (SELECT row_id, l.pos, x - m AS x FROM long l JOIN mean USING (pos)),
  cov AS (
    SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) AS c
    FROM centred a JOIN centred b USING (row_id) GROUP BY i, j),
  first_power(step, i, j, c) AS (
    SELECT 0, i, j, c / (SELECT sum(c) FROM cov WHERE i = j) FROM cov
    UNION ALL
    SELECT step + 1, i, j, c / sum(CASE WHEN i = j THEN c END) OVER () FROM (
      SELECT a.step, a.i, b.j, sum(a.c * b.c) AS c
      FROM first_power a JOIN first_power b ON a.j = b.i
      WHERE a.step < 24 GROUP BY a.step, a.i, b.j)),
  first_top AS (SELECT i, j, c FROM first_power WHERE step = 24),
  first_raw AS (
    SELECT i, c FROM first_top
    WHERE j = (SELECT i FROM first_top WHERE i = j ORDER BY c DESC LIMIT 1)),
  axis1 AS (
    SELECT i, c / (SELECT sqrt(sum(c * c)) FROM first_raw)
              * (SELECT sign(arg_max(c, abs(c))) FROM first_raw) AS c FROM first_raw),
  lambda1 AS (
    SELECT sum(a.c * cov.c * b.c) AS l
    FROM cov JOIN axis1 a ON a.i = cov.i JOIN axis1 b ON b.i = cov.j),
  rest AS (
    SELECT cov.i, cov.j, cov.c - (SELECT l FROM lambda1) * a.c * b.c AS c
    FROM cov JOIN axis1 a ON a.i = cov.i JOIN axis1 b ON b.i = cov.j),
  second_power(step, i, j, c) AS (
    SELECT 0, i, j, c / (SELECT sum(c) FROM rest WHERE i = j) FROM rest
    UNION ALL
    SELECT step + 1, i, j, c / sum(CASE WHEN i = j THEN c END) OVER () FROM (
      SELECT a.step, a.i, b.j, sum(a.c * b.c) AS c
      FROM second_power a JOIN second_power b ON a.j = b.i
      WHERE a.step < 24 GROUP BY a.step, a.i, b.j)),
  second_top AS (SELECT i, j, c FROM second_power WHERE step = 24),
  second_raw AS (
    SELECT i, c FROM second_top
    WHERE j = (SELECT i FROM second_top WHERE i = j ORDER BY c DESC LIMIT 1)),
  axis2 AS (
    SELECT i, c / (SELECT sqrt(sum(c * c)) FROM second_raw)
              * (SELECT sign(arg_max(c, abs(c))) FROM second_raw) AS c FROM second_raw),
  points AS (
    SELECT row_id, round(sum(x * a.c), 4) + 0.0 AS pc1, round(sum(x * b.c), 4) + 0.0 AS pc2
    FROM centred JOIN axis1 a ON a.i = pos JOIN axis2 b ON b.i = pos GROUP BY row_id)
"""

_ROLES = f"""
  {_average_similarity("corpus", ", a.filename, a.text")},
  asked AS (
    SELECT filename AS query_id, v FROM corpus WHERE row_id = (
      SELECT row_id FROM averages ORDER BY round(avg_sim, 12) DESC, filename DESC, text DESC LIMIT 1)),
  {_knn("corpus", "asked", 6, "cosine", "filename")},
  roles AS (
    SELECT row_id, filename,
           CASE WHEN filename IN (SELECT query_id FROM asked) THEN 'query'
                WHEN filename IN (SELECT filename FROM hits) THEN 'neighbour'
                ELSE 'background' END AS role
    FROM corpus)
"""

_INGESTED = f"""
  sha1(html) AS id, url AS filename, sha1({_PAGE_TEXT}) AS text_sha1, 64::int AS dim
FROM pages WHERE {_WHOLE_PAGE} AND {_PAGE_TEXT} <> ''
"""

ORACLES: dict[str, str] = {
    "clean_and_hash": f"""
SELECT doc_id, {_clean("text")} AS clean, sha1({_clean("text")}) AS text_sha1
FROM documents
""",
    "embed_input": f"""
SELECT doc_id, {_strip("replace(text, chr(10), ' ')")} AS input FROM documents
""",
    "file_ids": "SELECT url AS filename, sha1(html) AS id FROM pages",
    "token_counts": f"""
SELECT doc_id, CASE WHEN {_clean("text")} = '' THEN 0
                    ELSE len(string_split({_clean("text")}, ' ')) END::int AS n_tokens
FROM documents
""",
    "chunk_words": f"""
WITH t AS (
    SELECT doc_id, string_split({_clean("text")}, ' ') AS tok
    FROM documents WHERE {_clean("text")} <> ''),
  c AS (
    SELECT doc_id, tok,
           unnest(range(0, (len(tok) + {CHUNK_WORDS - 1}) // {CHUNK_WORDS})) AS i FROM t)
SELECT doc_id, i::int AS chunk_no,
       array_to_string(list_slice(tok, i * {CHUNK_WORDS} + 1, (i + 1) * {CHUNK_WORDS}), ' ')
         AS chunk
FROM c
""",
    "chunk_chars": f"""
WITH c AS (
    SELECT doc_id, text,
           unnest(range(0, (length(text) + {CHUNK_CHARS - 1}) // {CHUNK_CHARS})) AS i
    FROM documents),
  s AS (
    SELECT doc_id, i,
           {_strip(f"replace(substr(text, i * {CHUNK_CHARS} + 1, {CHUNK_CHARS}), chr(10), ' ')")}
             AS chunk
    FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS chunk_no,
       chunk
FROM s WHERE chunk <> ''
""",
    "text_previews": """
SELECT doc_id, substr(text, 1, 1000) AS preview,
       substr(text, 1, 200) || '...' AS short_preview
FROM documents
""",
    "assemble_parts": """
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""",
    "file_filter": """
SELECT page_id, url AS filename FROM pages
WHERE lower(url) LIKE '%.html' AND contains(url, '/en/')
""",
    "extract_pages": f"""
SELECT url AS query_id,
       CASE WHEN {_WHOLE_PAGE} THEN {_PAGE_TEXT} END AS text,
       CASE WHEN {_WHOLE_PAGE} THEN substr({_PAGE_TEXT}, 1, 1000) END AS preview,
       CASE WHEN NOT {_WHOLE_PAGE} THEN {_TRUNCATED}
            WHEN {_PAGE_TEXT} = '' THEN 'no text after cleaning' END AS error
FROM pages
""",
    "new_documents_only": """
SELECT sha1(text) AS id, doc_id FROM documents
WHERE sha1(text) NOT IN (
  SELECT sha1(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
""",
    "first_of_equal_documents": """
SELECT sha1(text) AS id, min(doc_id) AS doc_id FROM documents GROUP BY sha1(text)
""",
    # The second run skips what the first stored; equal pages within a run stay.
    "ingest_pages": f"""
WITH first_run AS (SELECT * FROM pages WHERE page_id IN (SELECT doc_id FROM labels)),
  stored AS (
    SELECT sha1(html) AS id FROM first_run
    WHERE {_WHOLE_PAGE} AND {_PAGE_TEXT} <> '')
SELECT {_INGESTED} AND (page_id IN (SELECT doc_id FROM labels)
                        OR sha1(html) NOT IN (SELECT id FROM stored))
""",
    "rejected_pages": f"""
SELECT sha1(html) AS id, url AS filename,
       CASE WHEN NOT {_WHOLE_PAGE} THEN {_TRUNCATED} ELSE 'no text after cleaning' END AS error
FROM pages WHERE NOT {_WHOLE_PAGE} OR {_PAGE_TEXT} = ''
""",
    "stream_ingest_pages": f"""
SELECT {_INGESTED} AND url IN (SELECT min(url) FROM pages GROUP BY sha1(html))
""",
    "jsonl_records": f"""
WITH {_CORPUS}
SELECT id, filename, text, round(sqrt(list_inner_product(v, v)), 6) AS norm,
       '2024-01-01T00:00:00.000000+00:00' AS ingested_at
FROM corpus
""",
    "jsonl_ids": f"WITH {_CORPUS} SELECT id FROM corpus",
    "hashed_embedding_pooled": _hashed_long("documents", "doc_id", CHUNK_WORDS),
    "cached_embedding": _hashed_long("documents", "doc_id", 2048),
    "cache_lookup": """
SELECT doc_id, sha1(text) AS text_sha1,
       sha1(text) IN (
         SELECT sha1(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS hit
FROM documents
""",
    "short_text_embedding": _hashed_long("benchmark", "item_id", None),
    "whole_text_embedding": _hashed_long("documents", "doc_id", None),
    "average_pool": f"""
WITH {_CENTROIDS}
SELECT label, (pos - 1)::int AS pos, round(m, 6) + 0.0 AS x FROM means
""",
    "vector_table_cosine": f"""
WITH {_VECTORS}
SELECT row_id, (generate_subscripts(v, 1) - 1)::int AS pos,
       round(unnest(v) / sqrt(list_inner_product(v, v)), 6) + 0.0 AS x
FROM scaled
""",
    "vector_table_l2": f"""
WITH {_VECTORS}
SELECT row_id, (generate_subscripts(v, 1) - 1)::int AS pos, round(unnest(v), 6) + 0.0 AS x
FROM scaled
""",
    "id_map": """
SELECT vec_id AS row_id, sha1('vec-' || vec_id) AS uuid, 'vec-' || vec_id AS filename
FROM embeddings
""",
    "numbered_parts": """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id FROM documents
""",
    "dense_row_numbers": "SELECT doc_id AS row_id, doc_id FROM documents",
    "vector_norms": f"""
WITH {_VECTORS}
SELECT row_id, len(v)::int AS dim, round(sqrt(list_inner_product(v, v)), 6) AS norm
FROM scaled
""",
    "l2_to_centroid": f"""
WITH {_CENTROIDS},
  d AS (
    SELECT t.row_id, pow(list_distance(t.v, c.v), 2) AS d
    FROM vectors t JOIN centroids c ON t.label = c.query_id)
SELECT row_id, round(d, 6) AS raw_score, round(1 / (1 + d), 6) AS score FROM d
""",
    "knn_cosine": f"""
WITH {_CENTROIDS}, {_knn("scaled", "centroids", 5, "cosine")} {_HITS}
""",
    "knn_l2": f"""
WITH {_CENTROIDS}, {_knn("scaled", "centroids", 5, "l2")} {_HITS}
""",
    "knn_blocks": f"""
WITH {_VECTORS}, asked AS (SELECT row_id AS query_id, v FROM scaled),
  {_knn("scaled", "asked", 5, "l2")} {_HITS}
""",
    "knn_l2_small_scale": f"""
WITH {_CENTROIDS},
  small AS (SELECT row_id, list_transform(v, lambda x: x * 1e-6) AS v FROM scaled),
  asked AS (SELECT query_id, list_transform(v, lambda x: x * 1e-6) AS v FROM centroids),
  {_knn("small", "asked", 5, "l2")}
SELECT query_id, rank, row_id, round(raw_score * 1e12, 6) + 0.0 AS raw_score FROM hits
""",
    "knn_near_copies": f"""
WITH {_VECTORS},
  asked AS (SELECT 0::bigint AS query_id, v FROM vectors WHERE row_id = 0),
  turned AS (
    SELECT t.row_id, list_transform(range(1, len(t.v) + 1),
      lambda i: a.v[i] + t.v[i] * 1e-4 / (t.row_id + 1)) AS v
    FROM vectors t, asked a),
  {_knn("turned", "asked", 10, "cosine")}
SELECT query_id, rank, row_id FROM hits
""",
    "knn_overfetch": _overfetch("label <> query_id"),
    "knn_overfetch_rare": _overfetch("label = (query_id + 1) % 10"),
    "hit_metadata_default": f"""
WITH {_CENTROIDS}, {_knn("scaled", "centroids", 10, "l2")}
SELECT hits.* REPLACE ({_ROUNDED}), coalesce(url, 'unknown') AS filename
FROM hits LEFT JOIN pages ON page_id = row_id
""",
    "hit_metadata_strict": f"""
WITH {_CENTROIDS}, {_knn("scaled", "centroids", 5, "l2")}
SELECT query_id, rank, 'vec-' || row_id AS filename, round(score, 3) AS score FROM hits
""",
    "search_texts": _search(5, "l2"),
    "search_files_l2": _search(20, "l2"),
    "search_files_cosine": _search(5, "cosine"),
    "average_similarity": f"""
WITH {_VECTORS}, {_average_similarity("scaled", "")}
SELECT row_id, round(avg_sim, 6) + 0.0 AS avg_sim FROM averages
""",
    "universal_report": f"""
WITH {_CORPUS}, {_average_similarity("corpus", ", a.filename, a.text")}
SELECT filename, round(avg_sim, 6) + 0.0 AS avg_sim, substr(text, 1, 200) || '...' AS preview
FROM (
  SELECT * FROM averages ORDER BY round(avg_sim, 12) DESC, filename DESC, text DESC LIMIT 10)
""",
    "universal_ranks": f"""
WITH {_CORPUS}, {_average_similarity("corpus", ", a.filename, a.text")}
SELECT row_id, round(avg_sim, 6) + 0.0 AS avg_sim, filename, row_number() OVER (
  ORDER BY round(avg_sim, 12) DESC, filename DESC, text DESC, row_id) AS rank
FROM averages
""",
    "common_words": f"""
WITH {_CORPUS}, {_average_similarity("corpus", ", a.text")},
  top AS (SELECT * FROM averages ORDER BY round(avg_sim, 12) DESC, row_id DESC LIMIT 5),
  w AS ({_WORDS} FROM top)
SELECT word, count(*) AS count FROM w WHERE word <> '' GROUP BY word
ORDER BY count DESC, word LIMIT 20
""",
    "word_counts": f"""
WITH w AS ({_WORDS} FROM documents)
SELECT word, count(*) AS count FROM w WHERE word <> '' GROUP BY word
""",
    "top_words": f"""
WITH w AS ({_WORDS} FROM documents)
SELECT word, count(*) AS count FROM w WHERE word <> '' GROUP BY word
ORDER BY count DESC, word LIMIT 20
""",
    "embedding_stats": f"""
WITH {_VECTORS}, n AS (SELECT len(v) AS d, sqrt(list_inner_product(v, v)) AS norm FROM scaled)
SELECT count(*) AS n, max(d)::int AS dim, round(avg(norm), 6) AS mean_norm,
       round(stddev_pop(norm), 6) AS std_norm
FROM n
""",
    "similarity_stats": f"""
WITH {_VECTORS},
  s AS (SELECT list_cosine_similarity(a.v, b.v) AS s FROM scaled a, scaled b)
SELECT round(avg(s), 6) + 0.0 AS mean_sim, round(min(s), 6) + 0.0 AS min_sim,
       round(max(s), 6) AS max_sim
FROM s
""",
    "text_stats": f"""
WITH n AS (
  SELECT text, CASE WHEN {_clean("text")} = '' THEN 0
                    ELSE len(string_split({_clean("text")}, ' ')) END AS n
  FROM documents)
SELECT round(avg(n), 6) AS mean_tokens, round(stddev_pop(n), 6) AS std_tokens,
       count(DISTINCT text) AS unique_texts, count(*) AS total_texts
FROM n
""",
    "kept_statistics": f"""
WITH {_CORPUS}, one AS (
    SELECT count(*) AS n, max(len(v))::int AS dim,
      round(avg(sqrt(list_inner_product(v, v))), 6) AS mean_norm,
      round(stddev_pop(sqrt(list_inner_product(v, v))), 6) AS std_norm FROM corpus),
  two AS (
    SELECT round(avg(list_cosine_similarity(a.v, b.v)), 6) + 0.0 AS mean_sim,
      round(max(list_cosine_similarity(a.v, b.v)), 6) AS max_sim FROM corpus a, corpus b),
  n AS (
    SELECT text, CASE WHEN {_clean("text")} = '' THEN 0
                      ELSE len(string_split({_clean("text")}, ' ')) END AS n
    FROM corpus),
  three AS (
    SELECT round(avg(n), 6) AS mean_tokens, round(stddev_pop(n), 6) AS std_tokens,
           count(DISTINCT text) AS unique_texts, count(*) AS total_texts
    FROM n)
SELECT * FROM one, two, three
""",
    "pca_2d": f"{_pca(_VECTORS, 'scaled')} SELECT row_id, pc1, pc2 FROM points",
    "role_labels": f"WITH {_CORPUS}, {_ROLES} SELECT row_id, filename, role FROM roles",
    "similarity_map": f"""
{_pca(_CORPUS, 'corpus')},
  {_ROLES}
SELECT row_id, role, pc1, pc2 FROM points JOIN roles USING (row_id)
""",
    "similarity_map_absent_neighbours": f"""
{_pca(_CORPUS, 'corpus')},
  {_ROLES}
SELECT row_id, role, pc1, pc2 FROM points JOIN roles USING (row_id)
""",
    "similarity_map_absent_query": f"""
{_pca(_CORPUS, 'corpus')},
  {_ROLES}
SELECT row_id,
       CASE WHEN filename IN (SELECT filename FROM hits) THEN 'neighbour'
            ELSE 'background' END AS role, pc1, pc2
FROM points JOIN roles USING (row_id)
""",
    "search_page_l2": _search_page("l2"),
    "search_page_cosine": _search_page("cosine"),
}
