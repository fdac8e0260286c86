"""DuckDB oracle SQL for every registered query.

Each query is written independently of the Spark code, mostly in the naive
form (BM25L and cosine over all query x document pairs, substring
containment for relevance), over the pre-registered views documents,
benchmark, embeddings, pages, conversations. Shared CTEs are composed with
the small builders below. Numeric contract: rank on round(score, 9) DESC,
doc_id ASC; output round(x, 6).
"""

from __future__ import annotations

import zipfile
from pathlib import Path
from types import SimpleNamespace

import pyspark
from pyspark import SparkContext
from pyspark.ml.feature import StopWordsRemover

# Written out here and not imported, so that a wrong pattern on the other side
# shows up as a mismatch. The stop list is the library's own.
PUNCTUATION = r"[!-/:-@\[\]^_`{-~]"
DIGIT_WORD = r"[\p{L}\p{N}_]*\p{Nd}[\p{L}\p{N}_]*"
WHITESPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
WORD_2PLUS = r"[\p{L}\p{N}_]{2,}"
BM25_WORD = r"[\p{L}\p{N}_]+"
HYDE_PROMPT = "Write one paragraph that could stand in a text answering this:    Question: {question}    Paragraph:"
PROJECTION_SOURCES = ("src1", "src3", "src5", "src7")
P = SimpleNamespace(
    COMMENT=r"(?s)<!--.*?-->", SCRIPT=r"(?s)<script[^>]*>.*?</script>", STYLE=r"(?s)<style[^>]*>.*?</style>",
    TITLE=r"(?s)<h1[^>]*>(.*?)</h1>", BLOCK=r"(?s)<article[^>]*>(.*?)</article>", PARA_OPEN=r"<p(?:\s[^>]*)?>",
    PARA_REST=r"(?s)</p>.*$", TAG=r"<[^>]+>", HREF=r'href="([^"]*)"',
    EDGE_SPACE=r"^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$",
    ORIGIN=r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)")

TOP_K = 10
RRF_K = 61
HEX = "'0123456789abcdef'"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def stop_words() -> list[str]:
    """Spark ML's English stop words; without a session, read from Spark's own jar."""
    if SparkContext._active_spark_context is not None:
        return StopWordsRemover.loadDefaultStopWords("english")
    jar = next((Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as files:
        return files.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().splitlines()


def stop_list_sql() -> str:
    return "[" + ", ".join(_lit(w) for w in stop_words()) + "]"


def tok(expr: str, pattern: str = WORD_2PLUS) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), {_lit(pattern)}, 0)"


def clean_words(expr: str) -> str:
    s = f"regexp_replace({expr}, {_lit(PUNCTUATION)}, ' ', 'g')"
    s = f"regexp_replace({s}, {_lit(DIGIT_WORD)}, '', 'g')"
    return f"list_filter(regexp_split_to_array(lower({s}), {_lit(WHITESPACE)}), lambda x: x <> '')"


def unigrams(expr: str) -> str:
    return f"list_filter({tok(expr)}, lambda x: NOT list_contains({stop_list_sql()}, x))"


def with_bigrams(u: str) -> str:
    return (f"list_concat({u}, CASE WHEN len({u}) >= 2 THEN "
            f"list_transform(range(1, len({u})), lambda i: {u}[i] || ' ' || {u}[i + 1]) ELSE [] END)")


def hex_digit(word: str, pos: str) -> str:
    return f"(instr({HEX}, substr(md5({word}), ({pos})::INT, 1)) - 1)"


def prompt(expr: str) -> str:
    before, after = HYDE_PROMPT.split("{question}")
    return f"({_lit(before)} || coalesce({expr}, '') || {_lit(after)})"


def jaccard(a: str, b: str) -> str:
    return (f"CASE WHEN len(list_distinct(list_concat({tok(a)}, {tok(b)}))) = 0 THEN 0.0 ELSE "
            f"len(list_intersect(list_distinct({tok(a)}, ), list_distinct({tok(b)})))::DOUBLE"
            f" / len(list_distinct(list_concat({tok(a)}, {tok(b)}))) END").replace(", )", ")")


# ---------------------------------------------------------------------------
# CTE fragments; each takes a name prefix so one query can use several.
# ---------------------------------------------------------------------------

def cte_queries(top_k: int = TOP_K) -> str:
    return f"q AS (SELECT item_id AS query_id, text AS query, {top_k} AS top_k FROM benchmark)"


def cte_conv_queries(name: str = "cq", top_k: int = TOP_K) -> str:
    return (f"{name} AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS query_id, text AS query, {top_k} AS top_k "
            f"FROM conversations WHERE role = 'user')")


def cte_hash_vectors(name: str, source: str, id_col: str, text_col: str) -> str:
    """{name}(id, vec DOUBLE[8]) : sum of md5 word vectors, zeros when no word."""
    return f"""
{name}_tok AS (SELECT {id_col} AS id, unnest({tok(text_col)}) AS w FROM {source}),
{name}_dim AS (SELECT id, p, sum({hex_digit('w', 'p')})::DOUBLE AS v
               FROM {name}_tok CROSS JOIN range(1, 9) t(p) GROUP BY id, p),
{name}_all AS (SELECT s.{id_col} AS id, t.p, coalesce(d.v, 0.0) AS v
               FROM {source} s CROSS JOIN range(1, 9) t(p)
               LEFT JOIN {name}_dim d ON d.id = s.{id_col} AND d.p = t.p),
{name} AS (SELECT id, list(v ORDER BY p) AS vec FROM {name}_all GROUP BY id)"""


def cte_cosine_topk(name: str, qvec: str, dvec: str, queries: str) -> str:
    """{name}(query_id, rank, doc_id, score) exact cosine top-k."""
    return f"""
{name}_qn AS (SELECT id, vec, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS n FROM {qvec}),
{name}_dn AS (SELECT id, vec, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS n FROM {dvec}),
{name}_pairs AS (SELECT a.id AS query_id, b.id AS doc_id,
                   list_dot_product(a.vec::DOUBLE[], b.vec::DOUBLE[]) / (a.n * b.n) AS score
                 FROM {name}_qn a CROSS JOIN {name}_dn b
                 WHERE a.n > 0 AND b.n > 0 AND len(a.vec) = len(b.vec)),
{name}_r AS (SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY round(p.score, 9) DESC, p.doc_id) AS rank,
               qq.top_k AS k FROM {name}_pairs p JOIN {queries} qq USING (query_id)),
{name} AS (SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM {name}_r WHERE rank <= k)"""


def cte_bm25(name: str = "bm25", queries: str = "q", k: str = "top_k") -> str:
    """Naive BM25L: every (query, document) pair, every distinct query term."""
    return f"""
{name}_docs AS (SELECT doc_id, {tok('text', BM25_WORD)} AS tokens FROM documents WHERE text IS NOT NULL),
{name}_stats AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens))::DOUBLE AS avglen FROM {name}_docs),
{name}_tf AS (SELECT doc_id, term, count(*) AS tf
              FROM (SELECT doc_id, unnest(tokens) AS term FROM {name}_docs) GROUP BY doc_id, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_qt AS (SELECT DISTINCT query_id, unnest({tok('query', BM25_WORD)}) AS term FROM {queries}),
{name}_idf AS (SELECT qt.query_id, qt.term,
                 CASE WHEN d.df IS NULL THEN 0.0 ELSE ln((s.n + 1.0) / (d.df + 0.5)) END AS idf
               FROM {name}_qt qt LEFT JOIN {name}_df d USING (term) CROSS JOIN {name}_stats s),
{name}_pairs AS (SELECT i.query_id, d.doc_id, i.term, i.idf,
                   coalesce(t.tf, 0) / (1 - 0.75 + 0.75 * len(d.tokens) / s.avglen) AS c
                 FROM {name}_idf i CROSS JOIN {name}_docs d CROSS JOIN {name}_stats s
                 LEFT JOIN {name}_tf t ON t.doc_id = d.doc_id AND t.term = i.term),
{name}_scored AS (SELECT query_id, doc_id, sum(idf * (2.5 * (c + 0.5) / (1.5 + c + 0.5))) AS score
                  FROM {name}_pairs GROUP BY query_id, doc_id),
{name}_ranked AS (SELECT s.query_id, s.doc_id, s.score,
                    row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, s.doc_id) AS rank,
                    qq.{k} AS k
                  FROM {name}_scored s JOIN {queries} qq USING (query_id)),
{name} AS (SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM {name}_ranked WHERE rank <= k AND score > 0)"""


def cte_rrf(name: str, legs: list[str], queries: str = "q") -> str:
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, rank FROM {leg}" for leg in legs)
    n = len(legs)
    return f"""
{name}_s AS (SELECT query_id, doc_id, sum(1.0 / ({RRF_K} + rank - 1)) * {RRF_K}.0 / {n} AS score
             FROM ({union}) GROUP BY query_id, doc_id),
{name}_r AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, s.doc_id) AS rank,
               qq.top_k AS k FROM {name}_s s JOIN {queries} qq USING (query_id)),
{name} AS (SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM {name}_r WHERE rank <= k)"""


def cte_word_vectors(name: str, source: str, id_col: str, text_col: str, with_idf: bool = False) -> str:
    """{name}(id, vec): word vectors weighted by tf, or by tf-idf over the source."""
    long_form = _word_vector_sql(source, id_col, text_col, "id", with_idf, places=None)
    return f"""
{name}_l AS ({long_form}),
{name} AS (SELECT id, list(value ORDER BY pos) AS vec FROM {name}_l GROUP BY id)"""


def cte_query_vectors(name: str, hyde: bool, vectors, queries: str = "q") -> str:
    """{name}(id, vec): of the query, or the mean of its generated answers (one each)."""
    if not hyde:
        return vectors(name, queries, "query_id", "query")
    hyp = f"""
{name}_hyp AS (SELECT query_id, 0 AS n, array_to_string(list_filter(
                 regexp_split_to_array({prompt('query')}, {_lit(WHITESPACE)}), lambda x: x <> ''), ' ') AS text
               FROM {queries})"""
    hv = vectors(f"{name}_hv", f"(SELECT query_id * 1000 + n AS hid, query_id, text FROM {name}_hyp)", "hid", "text")
    return f"""{hyp}, {hv},
{name} AS (SELECT h.query_id AS id, list(m ORDER BY p) AS vec FROM (
                SELECT hh.query_id, t.p, avg(v.vec[t.p]) AS m
                FROM (SELECT query_id * 1000 + n AS hid, query_id FROM {name}_hyp) hh
                JOIN {name}_hv v ON v.id = hh.hid CROSS JOIN range(1, 9) t(p)
                GROUP BY hh.query_id, t.p) h GROUP BY h.query_id)"""


def cte_search(name: str, hyde: bool, bm25: bool, queries: str = "q", words: bool = False) -> str:
    """The O72 composition with the hash encoder or the word vectors, and the first-words generator."""
    if words:
        parts = [cte_word_vectors(f"{name}_dv", "documents", "doc_id", "text", with_idf=True)]
    else:
        parts = [cte_hash_vectors(f"{name}_dv", "documents", "doc_id", "text")]
    parts.append(cte_query_vectors(f"{name}_qv", hyde, cte_word_vectors if words else cte_hash_vectors, queries))
    parts.append(cte_cosine_topk(f"{name}_dense", f"{name}_qv", f"{name}_dv", queries))
    final = f"{name}_dense"
    if bm25:
        parts.append(cte_bm25(f"{name}_bm", queries, "top_k"))
        parts.append(cte_rrf(f"{name}_fused", [f"{name}_dense", f"{name}_bm"], queries))
        final = f"{name}_fused"
    parts.append(f"{name} AS (SELECT * FROM {final})")
    return ",".join(parts)


def cte_qrels(name: str = "truth") -> str:
    return (f"{name} AS (SELECT DISTINCT b.item_id AS query_id, d.doc_id FROM benchmark b "
            f"JOIN documents d ON contains(d.text, b.text))")


def cte_vectorizer(name: str = "vt", source: str = "documents", id_col: str = "doc_id",
                   text_col: str = "text", bigrams: bool = True) -> str:
    terms = with_bigrams("u") if bigrams else "u"
    return f"""
{name}_u AS (SELECT {id_col} AS doc_id, {unigrams(text_col)} AS u FROM {source}),
{name} AS (SELECT doc_id, {terms} AS terms FROM {name}_u)"""


def cte_tf(name: str = "tf", vt: str = "vt") -> str:
    return (f"{name} AS (SELECT doc_id, term, count(*) AS tf FROM "
            f"(SELECT doc_id, unnest(terms) AS term FROM {vt}) GROUP BY doc_id, term)")


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------

def _cleaned_html() -> str:
    h = "html"
    for pat in (P.COMMENT, P.SCRIPT, P.STYLE):
        h = f"regexp_replace({h}, {_lit(pat)}, '', 'g')"
    return h


def _text_of(expr: str) -> str:
    t = f"regexp_replace({expr}, {_lit(P.TAG)}, '', 'g')"
    for ent, ch in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = f"replace({t}, {_lit(ent)}, {_lit(ch)})"
    return f"replace({t}, chr(13) || chr(10), ' ')"


def pages_extract() -> str:
    return f"""WITH c AS (SELECT page_id, url, {_cleaned_html()} AS h FROM pages),
b AS (SELECT page_id, url, h, regexp_extract(h, {_lit(P.BLOCK)}, 1) AS block FROM c)
SELECT page_id,
  regexp_replace({_text_of(f"regexp_extract(h, {_lit(P.TITLE)}, 1)")}, {_lit(P.EDGE_SPACE)}, '', 'g') AS title,
  {_text_of(f"regexp_replace(regexp_split_to_array(block, {_lit(P.PARA_OPEN)})[3], {_lit(P.PARA_REST)}, '')")} AS abstract,
  regexp_extract(url, {_lit(P.ORIGIN)}, 1) || '/' || page_id::VARCHAR || '/' AS webpage_url,
  nullif(regexp_extract(block, {_lit(P.HREF)}, 1), '') AS document_url
FROM b"""


def pages_links() -> str:
    return f"""WITH l AS (SELECT page_id, regexp_extract_all({_cleaned_html()}, {_lit(P.HREF)}, 1) AS hrefs FROM pages),
u AS (SELECT page_id, unnest(range(len(hrefs))) AS pos, unnest(hrefs) AS href FROM l)
SELECT page_id, pos::INTEGER AS pos, href, string_split(href, '/')[-2] AS target_id FROM u"""


def csv_roundtrip() -> str:
    return "SELECT doc_id, text, lang, source, n_chars FROM documents"


def ingest_papers() -> str:
    return f"""WITH p AS ({pages_extract()}),
c AS (SELECT nullif(title, '') AS title, nullif(abstract, '') AS abstract, webpage_url FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY abstract, webpage_url) AS rn
      FROM c WHERE abstract IS NOT NULL)
SELECT title AS doc_id, abstract AS content FROM r WHERE rn = 1"""


def documents_validate() -> str:
    blank = f"regexp_replace(text, {_lit(WHITESPACE)}, '', 'g') = ''"
    return f"""SELECT 'null_id' AS rule, count(*) FILTER (WHERE doc_id IS NULL)::BIGINT AS n FROM documents
UNION ALL SELECT 'null_or_blank_content', count(*) FILTER (WHERE text IS NULL OR {blank})::BIGINT FROM documents
UNION ALL SELECT 'duplicate_id', coalesce(sum(c), 0)::BIGINT FROM
  (SELECT doc_id, count(*) AS c FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'wrong_length_vector', count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <>
  (SELECT l FROM (SELECT len(embedding) AS l, count(*) AS c FROM embeddings GROUP BY 1 ORDER BY c DESC, l LIMIT 1)))::BIGINT
  FROM embeddings"""


def word_vectors_roundtrip() -> str:
    return f"""WITH w AS (SELECT DISTINCT unnest({clean_words('text')}) AS word FROM conversations)
SELECT word, (p - 1)::INTEGER AS pos, {hex_digit('word', 'p')}::INTEGER AS value
FROM w CROSS JOIN range(1, 9) t(p)"""


def embeddings_roundtrip() -> str:
    return f"""WITH {cte_hash_vectors('hv', 'documents', 'doc_id', 'text')}
SELECT 'hash' AS method, h.id AS doc_id, sha256(d.text) AS content_hash, (p - 1)::INTEGER AS pos,
       round(h.vec[p], 6) AS value
FROM hv h JOIN documents d ON d.doc_id = h.id CROSS JOIN range(1, 9) t(p)"""


def dedup_documents() -> str:
    return "SELECT min(doc_id) AS doc_id, text AS content FROM documents WHERE text IS NOT NULL GROUP BY text"


def documents_projection() -> str:
    srcs = ", ".join(_lit(s) for s in PROJECTION_SOURCES)
    return f"SELECT doc_id, coalesce(text, '') AS content FROM documents WHERE source IN ({srcs})"


def clean_tokens() -> str:
    return f"""SELECT doc_id, word, count(*) AS n
FROM (SELECT doc_id, unnest({clean_words('text')}) AS word FROM documents) GROUP BY doc_id, word"""


def tokens_bm25() -> str:
    return f"""WITH t AS (SELECT doc_id, {tok('text', BM25_WORD)} AS toks FROM documents)
SELECT doc_id, pos::INTEGER AS pos, token FROM
  (SELECT doc_id, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM t)"""


def tokens_vectorizer() -> str:
    return f"""WITH {cte_vectorizer()}
SELECT doc_id, pos::INTEGER AS pos, term FROM
  (SELECT doc_id, unnest(range(len(terms))) AS pos, unnest(terms) AS term FROM vt)"""


def term_frequency() -> str:
    return f"WITH {cte_vectorizer()}, {cte_tf()} SELECT doc_id, term, tf FROM tf"


def _idf_ctes() -> str:
    return f"""{cte_vectorizer()}, {cte_tf()},
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
idf AS (SELECT term, count(*) AS df, ln((n.n + 1.0) / (count(*) + 1.0)) + 1.0 AS idf
        FROM tf CROSS JOIN n GROUP BY term, n.n)"""


def smooth_idf() -> str:
    return f"WITH {_idf_ctes()} SELECT term, df, round(idf, 6) AS idf FROM idf"


def tfidf() -> str:
    return f"""WITH {_idf_ctes()},
w AS (SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY doc_id)
SELECT w.doc_id, w.term, round(w.w / nrm.n, 6) AS weight FROM w JOIN nrm USING (doc_id)"""


def prompt_render() -> str:
    return f"WITH {cte_conv_queries()} SELECT query_id, {prompt('query')} AS prompt FROM cq"


def _word_vector_sql(source: str, id_col: str, text_col: str, out_id: str, with_idf: bool,
                     places: int | None = 6) -> str:
    idf = ("ln((n.n + 1.0) / (d.df + 1.0)) + 1.0" if with_idf else "1.0")
    value = "coalesce(agg.v, 0.0)" if places is None else f"round(coalesce(agg.v, 0.0), {places})"
    return f"""WITH {cte_vectorizer('vt', source, id_col, text_col, bigrams=False)}, {cte_tf('tf', 'vt')},
n AS (SELECT count(*)::DOUBLE AS n FROM {source}),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT tf.doc_id, tf.term AS word, tf.tf * ({idf}) AS w FROM tf JOIN dfs d USING (term) CROSS JOIN n),
occ AS (SELECT doc_id, word, count(*) AS occ FROM
        (SELECT {id_col} AS doc_id, unnest({clean_words(text_col)}) AS word FROM {source}) GROUP BY doc_id, word),
model AS (SELECT DISTINCT unnest({clean_words('text')}) AS word FROM conversations),
m AS (SELECT o.doc_id, o.word, o.occ * wt.w AS weight FROM occ o JOIN wt USING (doc_id, word) JOIN model USING (word)),
agg AS (SELECT doc_id, p, sum(weight * {hex_digit('word', 'p')}) / sum(weight) AS v
        FROM m CROSS JOIN range(1, 9) t(p) GROUP BY doc_id, p)
SELECT s.{id_col} AS {out_id}, (t.p - 1)::INTEGER AS pos, {value} AS value
FROM {source} s CROSS JOIN range(1, 9) t(p) LEFT JOIN agg ON agg.doc_id = s.{id_col} AND agg.p = t.p"""


def word_vector_embed() -> str:
    return _word_vector_sql("documents", "doc_id", "text", "doc_id", True)


def query_word_vector_embed() -> str:
    return _word_vector_sql("benchmark", "item_id", "text", "query_id", False)


def word_vector_topk() -> str:
    docs = _word_vector_sql("documents", "doc_id", "text", "doc_id", True, places=None)
    qs = _word_vector_sql("benchmark", "item_id", "text", "query_id", False, places=None)
    return f"""WITH {cte_queries()},
dl AS ({docs}),
ql AS ({qs}),
dv AS (SELECT doc_id AS id, list(value ORDER BY pos) AS vec FROM dl GROUP BY doc_id),
qv AS (SELECT query_id AS id, list(value ORDER BY pos) AS vec FROM ql GROUP BY query_id),
{cte_cosine_topk('res', 'qv', 'dv', 'q')}
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM res"""


def hash_embed() -> str:
    return f"""WITH {cte_hash_vectors('hv', 'documents', 'doc_id', 'text')}
SELECT id AS doc_id, (p - 1)::INTEGER AS pos, round(vec[p], 6) AS value FROM hv CROSS JOIN range(1, 9) t(p)"""


def _hyp_source() -> str:
    """Assistant turns with the user turn they answer, the last one before them."""
    return ("(SELECT a.conv_id::VARCHAR || ':' || a.turn::VARCHAR AS hid, a.conv_id::VARCHAR || ':' || max(u.turn)::VARCHAR "
            "AS query_id, any_value(a.text) AS text FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id "
            "AND u.role = 'user' AND u.turn < a.turn WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn)")


def hyde_mean() -> str:
    return f"""WITH {cte_hash_vectors('hv', _hyp_source(), 'hid', 'text')},
hq AS (SELECT hid, query_id FROM {_hyp_source()})
SELECT hq.query_id, (t.p - 1)::INTEGER AS pos, round(avg(hv.vec[t.p]), 6) AS value
FROM hq JOIN hv ON hv.id = hq.hid CROSS JOIN range(1, 9) t(p) GROUP BY hq.query_id, t.p"""


def generate_hypotheses() -> str:
    return f"""WITH {cte_conv_queries()}
SELECT query_id, 0::INTEGER AS n, array_to_string(list_filter(
  regexp_split_to_array({prompt('query')}, {_lit(WHITESPACE)}), lambda x: x <> ''), ' ') AS text FROM cq"""


def cosine_topk() -> str:
    return f"""WITH vq AS (SELECT vec_id AS query_id, {TOP_K} AS top_k FROM embeddings),
v AS (SELECT vec_id AS id, embedding AS vec FROM embeddings),
{cte_cosine_topk('res', 'v', 'v', 'vq')}
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM res"""


def bm25_topk() -> str:
    return f"""WITH {cte_queries()}, {cte_bm25()}
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM bm25"""


def _search_select(name: str, evaluator: bool) -> str:
    if not evaluator:
        return f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM {name}"
    return (f"SELECT r.query_id, r.rank, r.doc_id, round(r.score, 6) AS score, "
            f"round({jaccard('qq.query', 'd.text')}, 6) AS similarity "
            f"FROM {name} r JOIN q qq USING (query_id) JOIN documents d USING (doc_id)")


def dense_hash_topk() -> str:
    return f"WITH {cte_queries()}, {cte_search('s', False, False)} {_search_select('s', False)}"


def rrf_hybrid() -> str:
    return f"WITH {cte_queries()}, {cte_search('s', False, True)} {_search_select('s', False)}"


def hyde_topk() -> str:
    return f"""WITH {cte_conv_queries('cq')},
{cte_hash_vectors('dv', 'documents', 'doc_id', 'text')},
{cte_hash_vectors('hv', _hyp_source(), 'hid', 'text')},
qv AS (SELECT query_id AS id, list(m ORDER BY p) AS vec FROM (
         SELECT hq.query_id, t.p, avg(hv.vec[t.p]) AS m
         FROM (SELECT hid, query_id FROM {_hyp_source()}) hq JOIN hv ON hv.id = hq.hid
         CROSS JOIN range(1, 9) t(p) GROUP BY hq.query_id, t.p) GROUP BY query_id),
{cte_cosine_topk('res', 'qv', 'dv', 'cq')}
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM res"""


def search_flags(hyde: bool, bm25: bool, evaluator: bool, words: bool = False) -> str:
    return f"WITH {cte_queries()}, {cte_search('s', hyde, bm25, words=words)} {_search_select('s', evaluator)}"


def store_methods() -> str:
    """A vector without a direction is stored, but not searched."""
    return f"""WITH {cte_hash_vectors('hv', 'documents', 'doc_id', 'text')},
{cte_word_vectors('wv', 'documents', 'doc_id', 'text', with_idf=True)},
v AS (SELECT 'hash' AS method, vec FROM hv UNION ALL SELECT 'hash4', vec[1:4] FROM hv UNION ALL SELECT 'words', vec FROM wv)
SELECT method, count(*) AS vectors, max(len(vec))::INTEGER AS dims,
       count(*) FILTER (WHERE list_dot_product(vec::DOUBLE[], vec::DOUBLE[]) > 0) AS searchable
FROM v GROUP BY method"""


def judged_titles() -> str:
    return f"""WITH d AS ({ingest_papers()}), p AS ({pages_extract()})
SELECT DISTINCT p.page_id // 10 AS query_id, d.doc_id FROM p JOIN d ON d.doc_id = p.title"""


def ingest_search() -> str:
    """The ingested papers take the place of ``documents`` in the search parts."""
    runs = " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM {leg}" for m, leg in (("dense", "sd"), ("hybrid", "sh")))
    return f"""WITH documents AS (SELECT doc_id, content AS text FROM ({ingest_papers()})),
{cte_queries()}, {cte_search('sd', False, False)}, {cte_search('sh', False, True)}
SELECT r.method, r.query_id, r.rank, r.doc_id, d.text AS content, round(r.score, 6) AS score
FROM ({runs}) r JOIN documents d USING (doc_id)"""


def listing_unknown_documents() -> str:
    return f"""WITH {cte_queries()}, {cte_bm25()}
SELECT r.query_id, r.rank, CASE WHEN r.rank = 2 THEN -r.query_id - 1 ELSE r.doc_id END AS doc_id,
  CASE WHEN r.rank = 2 THEN NULL ELSE d.text END AS content, round(r.score, 6) AS score
FROM bm25 r JOIN documents d USING (doc_id)"""


def pair_similarity() -> str:
    return f"""WITH {cte_queries()}, {cte_bm25()}
SELECT r.query_id, r.rank, r.doc_id, round({jaccard('qq.query', 'd.text')}, 6) AS similarity
FROM bm25 r JOIN q qq USING (query_id) JOIN documents d USING (doc_id)"""


def search_listing() -> str:
    return f"""WITH {cte_queries()}, {cte_bm25()}
SELECT r.query_id, r.rank, r.doc_id, d.text AS content, round(r.score, 6) AS score,
       round({jaccard('qq.query', 'd.text')}, 6) AS similarity
FROM bm25 r JOIN q qq USING (query_id) JOIN documents d USING (doc_id)"""


def embeddings_missing() -> str:
    return f"""WITH {cte_hash_vectors('hv', 'documents', 'doc_id', 'text')}
SELECT d.doc_id, sha256(d.text) AS content_hash, d.lang = 'en' AS reused, list_sum(h.vec) AS emb_sum
FROM documents d JOIN hv h ON h.id = d.doc_id"""


def store_force_keeps_methods() -> str:
    return f"""WITH {cte_hash_vectors('hv', 'documents', 'doc_id', 'text')}
SELECT 'hash' AS method, id AS doc_id, list_sum(vec) AS emb_sum FROM hv
UNION ALL SELECT 'hash4', id, list_sum(vec[1:4]) FROM hv"""


def store_changed_text() -> str:
    return f"""WITH now AS (SELECT doc_id, CASE WHEN source = 'src1' THEN coalesce(text, '') || ' changed words' ELSE text END
  AS text FROM documents),
{cte_hash_vectors('hv', 'now', 'doc_id', 'text')}
SELECT now.doc_id, sha256(coalesce(now.text, '')) AS content_hash, list_sum(hv.vec) AS emb_sum
FROM now JOIN hv ON hv.id = now.doc_id"""


def qrels_resolve() -> str:
    return f"WITH {cte_qrels()} SELECT query_id, doc_id FROM truth"


def mark_relevant() -> str:
    return f"""WITH {cte_queries()}, {cte_bm25()}, {cte_qrels()}
SELECT r.query_id, r.rank, r.doc_id, CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END::INTEGER AS relevant
FROM bm25 r LEFT JOIN truth t ON t.query_id = r.query_id AND t.doc_id = r.doc_id"""


def _three_methods() -> tuple[str, list[tuple[str, str]]]:
    """Legs and runs of three methods under the HyDE and BM25 flags."""
    def hash4(name: str, *source: str) -> str:
        return f"{cte_hash_vectors(name + '_8', *source)}, {name} AS (SELECT id, vec[1:4] AS vec FROM {name}_8)"

    parts, runs = [], []
    for m, vectors in (("hash", cte_hash_vectors), ("hash4", hash4), ("words", cte_word_vectors)):
        whole = {"with_idf": True} if m == "words" else {}
        parts.append(vectors(f"{m}_dv", "documents", "doc_id", "text", **whole))
        for h in (0, 1):
            parts.append(cte_query_vectors(f"{m}_q{h}", bool(h), vectors))
            if m == "hash4" and h:      # the mean of a shorter vector
                parts[-1] = parts[-1].replace("range(1, 9) t(p)\n                GROUP BY hh", "range(1, 5) t(p)\n                GROUP BY hh")
            parts.append(cte_cosine_topk(f"{m}_d{h}", f"{m}_q{h}", f"{m}_dv", "q"))
            parts.append(cte_rrf(f"{m}_f{h}", [f"{m}_d{h}", "bm25"]))
            runs += [(f"{m} {h}0", f"{m}_d{h}"), (f"{m} {h}1", f"{m}_f{h}")]
    return ",".join(parts), runs


def _metrics_ctes(legs: str = "", named: list[tuple[str, str]] | None = None) -> str:
    legs = legs or f"{cte_search('sd', False, False)}, {cte_search('sh', False, True)}"
    named = named or [("bm25", "bm25"), ("dense", "sd"), ("hybrid", "sh")]
    runs = " UNION ALL ".join(f"SELECT '{m}' AS method, query_id, rank, doc_id FROM {leg}" for m, leg in named)
    return f"""{cte_queries()}, {cte_bm25()}, {legs},
{cte_qrels()},
runs AS ({runs}),
keys AS (SELECT doc_id, sha256(coalesce(text, '')) AS ck, text FROM documents),
tkeys AS (SELECT DISTINCT t.query_id, k.ck FROM truth t JOIN keys k USING (doc_id)),
marked AS (SELECT r.method, r.query_id, r.rank, r.doc_id, k.ck,
             CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END AS relevant,
             CASE WHEN tk.ck IS NULL THEN 0 ELSE 1 END AS rel_content,
             {jaccard('qq.query', 'k.text')} AS similarity
           FROM runs r JOIN keys k USING (doc_id) JOIN q qq ON qq.query_id = r.query_id
           LEFT JOIN truth t ON t.query_id = r.query_id AND t.doc_id = r.doc_id
           LEFT JOIN tkeys tk ON tk.query_id = r.query_id AND tk.ck = k.ck),
hits AS (SELECT *, sum(rel_content) OVER (PARTITION BY method, query_id ORDER BY rank
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM marked),
per AS (SELECT method, query_id, count(*) AS retrieved, sum(relevant) AS relevant,
          sum(relevant / log2(rank + 1)) AS dcg, sum(rel_content) AS content_hits,
          sum(CASE WHEN rel_content = 1 THEN hits / rank END) AS ap_num, avg(similarity) AS avg_similarity
        FROM hits GROUP BY method, query_id),
tc AS (SELECT query_id, count(*) AS n_truth FROM truth GROUP BY query_id),
idcg AS (SELECT query_id, list_sum(list_transform(range(1, n_truth + 1), lambda i: 1.0 / log2(i + 1))) AS idcg FROM tc),
want AS (SELECT query_id, count(*) AS ntc FROM tkeys GROUP BY query_id),
inter AS (SELECT method, query_id, count(*) AS nhc FROM
          (SELECT DISTINCT method, query_id, ck FROM marked WHERE rel_content = 1) GROUP BY method, query_id),
mq AS (SELECT m.method, qq.query_id FROM (SELECT DISTINCT method FROM runs) m CROSS JOIN q qq),
corpus AS (SELECT count(*) AS n FROM documents),
base AS (SELECT mq.method, mq.query_id,
           coalesce(per.retrieved, 0) AS retrieved, coalesce(per.relevant, 0)::BIGINT AS relevant,
           coalesce(per.dcg, 0.0) AS dcg, coalesce(per.content_hits, 0) AS content_hits, per.ap_num,
           per.avg_similarity, coalesce(tc.n_truth, 0) AS n_truth, coalesce(idcg.idcg, 0.0) AS idcg,
           coalesce(want.ntc, 0) AS ntc, coalesce(inter.nhc, 0) AS nhc, corpus.n AS corpus
         FROM mq LEFT JOIN per USING (method, query_id) LEFT JOIN tc ON tc.query_id = mq.query_id
         LEFT JOIN idcg ON idcg.query_id = mq.query_id LEFT JOIN want ON want.query_id = mq.query_id
         LEFT JOIN inter ON inter.method = mq.method AND inter.query_id = mq.query_id CROSS JOIN corpus),
pr AS (SELECT *, CASE WHEN retrieved = 0 THEN NULL ELSE relevant::DOUBLE / retrieved END AS p,
                 CASE WHEN n_truth = 0 THEN NULL ELSE relevant::DOUBLE / n_truth END AS r FROM base),
mpq AS (SELECT method, query_id, retrieved, relevant, n_truth AS ground_truth, corpus,
          p AS precision, r AS recall,
          CASE WHEN corpus - n_truth = 0 THEN NULL ELSE (retrieved - relevant)::DOUBLE / (corpus - n_truth) END AS fallout,
          CASE WHEN p + r = 0 THEN NULL ELSE 2 * p * r / (p + r) END AS f1,
          CASE WHEN 4 * p + r = 0 THEN NULL ELSE 5 * p * r / (4 * p + r) END AS f2,
          CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg,
          CASE WHEN content_hits > 0 THEN ap_num / content_hits ELSE 0.0 END AS ap,
          CASE WHEN ntc > 0 AND retrieved > 0 THEN nhc::DOUBLE / ntc ELSE 0.0 END AS recall_multi_hit,
          avg_similarity
        FROM pr)"""


METRICS = ["precision", "recall", "fallout", "f1", "f2", "ndcg", "ap", "recall_multi_hit", "avg_similarity"]


def metrics_per_query() -> str:
    cols = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
    return f"""WITH {_metrics_ctes()}
SELECT method, query_id, retrieved, relevant, ground_truth, corpus, {cols} FROM mpq"""


def metrics_stored_methods() -> str:
    return metrics_per_method(*_three_methods())


def metrics_per_method(legs: str = "", named: list[tuple[str, str]] | None = None) -> str:
    cols = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)
    return f"WITH {_metrics_ctes(legs, named)} SELECT method, count(*) AS queries, {cols} FROM mpq GROUP BY method"


def recall_multi_hit() -> str:
    return f"WITH {_metrics_ctes()} SELECT method, query_id, round(recall_multi_hit, 6) AS recall_multi_hit FROM mpq"


def oracle_sql() -> dict[str, str]:
    out = {
        "pages_extract": pages_extract(),
        "pages_links": pages_links(),
        "csv_roundtrip": csv_roundtrip(),
        "ingest_papers": ingest_papers(),
        "documents_validate": documents_validate(),
        "word_vectors_roundtrip": word_vectors_roundtrip(),
        "embeddings_roundtrip": embeddings_roundtrip(),
        "metrics_roundtrip": metrics_per_query(),
        "dedup_documents": dedup_documents(),
        "documents_projection": documents_projection(),
        "clean_tokens": clean_tokens(),
        "tokens_bm25": tokens_bm25(),
        "tokens_vectorizer": tokens_vectorizer(),
        "term_frequency": term_frequency(),
        "smooth_idf": smooth_idf(),
        "tfidf": tfidf(),
        "prompt_render": prompt_render(),
        "word_vector_embed": word_vector_embed(),
        "query_word_vector_embed": query_word_vector_embed(),
        "word_vector_topk": word_vector_topk(),
        "hash_embed": hash_embed(),
        "hyde_mean": hyde_mean(),
        "generate_hypotheses": generate_hypotheses(),
        "cosine_topk": cosine_topk(),
        "bm25_topk": bm25_topk(),
        "bm25_index_topk": bm25_topk(),
        "dense_hash_topk": dense_hash_topk(),
        "rrf_hybrid": rrf_hybrid(),
        "hyde_topk": hyde_topk(),
        "stream_search": search_flags(False, True, False),
        "pair_similarity": pair_similarity(),
        "search_listing": search_listing(),
        "ingest_search": ingest_search(),
        "listing_unknown_documents": listing_unknown_documents(),
        "embeddings_missing": embeddings_missing(),
        "store_force_keeps_methods": store_force_keeps_methods(),
        "store_changed_text": store_changed_text(),
        "qrels_resolve": qrels_resolve(),
        "mark_relevant": mark_relevant(),
        "metrics_per_query": metrics_per_query(),
        "metrics_per_method": metrics_per_method(),
        "recall_multi_hit": recall_multi_hit(),
        "store_methods": store_methods(),
        "metrics_stored_methods": metrics_stored_methods(),
        "judged_titles": judged_titles(),
    }
    for h in (0, 1):
        for b in (0, 1):
            for e in (0, 1):
                out[f"search_flags_{h}{b}{e}"] = search_flags(bool(h), bool(b), bool(e))
                out[f"word_flags_{h}{b}{e}"] = search_flags(bool(h), bool(b), bool(e), words=True)
    return out
