"""Queries by name over the provided tables, each with the SQL that it must agree with.

Fixtures: a project is a ``source``, a chunk is a document or a conversation's turn, vectors are ``embeddings``, the work queue is
``labels`` (toxic: failed, else good: done, else pending), file events are ``events``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, comments, ignore, markup, paths, text
from ..operators import export, folders, fusion, hierarchical, keyword, moves, projects, summaries, upkeep
from ..operators import vectors as V
from ..operators.keyword_index import KeywordIndex
from ..session import prepare, shared_folder
from ..sources import uploads
from ..sources.ingest import content_hash, queue_state, with_state
from ..sources.store import Store, latest
from ..streaming import debounce, registry, watch
from .search import Collection, SearchRequest, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_INDEXES: dict[tuple, KeywordIndex] = {}

QUERY = "the tion and wh"
#: A term of one document or none: most rows of its result are padding.
RARE = "ouwheonti atanonth"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = prepare(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def chunks(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.col("source").alias("project_id"), F.col("lang"))

    @property
    def index(self) -> KeywordIndex:
        """A stored keyword index of the documents: built once for a table as it stands, then read by every search."""
        path = f"{self.dir}/documents.parquet"
        fs, p = Store(self.spark, path)._fs(path)
        files = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in (fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]))
        key = (self.spark.sparkContext.applicationId, path, tuple(files))
        if key not in _INDEXES:
            index = KeywordIndex(Store(self.spark, f"{shared_folder(self.spark)}/keyword-{uuid.uuid4().hex}"))
            index.build(self.chunks)
            _INDEXES[key] = index
        return _INDEXES[key]

    @property
    def turns(self) -> DataFrame:
        return self.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"), "role")

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("vector_id"), F.col("label").alias("document_id"), "label", "embedding")

    @property
    def linked(self) -> DataFrame:
        """Chunks with the vector that bears their number, if there is one."""
        have = self.embeddings.select(F.col("vec_id").alias("vector_id"))
        docs = self.chunks
        return docs.join(have, docs.chunk_id == have.vector_id, "left")

    @property
    def queue(self) -> DataFrame:
        status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "done").otherwise("pending")
        return self.labels.select(F.col("doc_id").alias("chunk_id"), status.alias("status"), F.pmod("doc_id", F.lit(5)).cast("int").alias("retry_count"))

    def ask(self) -> list[float]:
        """A fixed query vector of the table's width."""
        return [((7 * i) % 13 - 6) / 10 for i in range(64)]


_ASK = "[" + ", ".join(f"{((7 * i) % 13 - 6) / 10}::DOUBLE" for i in range(64)) + "]"
_TOKENS = "[x for x in regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') if length(x) > 1]"
_QUEUE = "(SELECT doc_id AS chunk_id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'done' ELSE 'pending' END AS status, CAST(doc_id % 5 AS INTEGER) AS retry_count FROM labels)"
_LINKED = "(SELECT d.doc_id AS chunk_id, d.source AS project_id, d.text AS content, e.vec_id AS vector_id FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"


def _bm25(words: str, documents: str = "documents") -> str:
    terms = ", ".join(f"('{w}')" for w in text.tokenize_literal(words))
    return f"""
tokens AS (SELECT doc_id AS chunk_id, {_TOKENS} AS ts FROM {documents}),
len AS (SELECT chunk_id, len(ts) AS dl FROM tokens),
stats AS (SELECT count(*) AS n, sum(dl) * 1.0e0 / count(*) AS avgdl FROM len),
tf AS (SELECT chunk_id, t AS term, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS t FROM tokens) GROUP BY 1, 2),
raw AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS idf0 FROM tf, stats GROUP BY term),
idf AS (SELECT term, df, CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25e0 * (SELECT avg(idf0) FROM raw) END AS idf FROM raw),
q(term) AS (VALUES {terms}),
part AS (SELECT tf.chunk_id, sum(idf.idf * tf.tf * 2.5e0 / (tf.tf + 1.5e0 * (0.25e0 + 0.75e0 * len.dl / stats.avgdl))) AS s
         FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN len USING (chunk_id), stats GROUP BY tf.chunk_id),
scored AS (SELECT d.doc_id AS chunk_id, round(coalesce(part.s, 0e0), 6) AS score FROM {documents} d LEFT JOIN part ON part.chunk_id = d.doc_id)"""


_COSINE = f"""
sem AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_ASK}), 6) AS score FROM embeddings)"""
_RRF = """
kw AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 20)),
sm AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT * FROM sem ORDER BY score DESC, vec_id LIMIT 20)),
fused AS (SELECT chunk_id, round(sum(1e0 / (60 + r)), 6) AS score, min(l * 1000 + r) AS seen
          FROM (SELECT chunk_id, r, 1 AS l FROM sm UNION ALL SELECT chunk_id, r, 2 AS l FROM kw) GROUP BY chunk_id)"""


# --- text ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT t AS term, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS t FROM documents) GROUP BY t HAVING count(*) >= 20")
def token_counts(t: Tables) -> DataFrame:
    terms = t.documents.select(F.explode(text.tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
  '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS content FROM pages""")
def preprocess_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.preprocess(F.col("html")).alias("content"))


@query("""
SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 57) || '...' END AS short,
  CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet, left(text, 4000) AS cut FROM documents""")
def truncate_content(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", text.shorten(c, 60).alias("short"), text.snippet(c, 200).alias("snippet"), F.left(c, F.lit(4000)).alias("cut"))


@query("""
SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars * 1e0) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024e0) ELSE printf('%.1f MB', n_chars / 1048576e0) END AS size
FROM documents""")
def size_labels(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.size_label(F.col("n_chars")).alias("size"))


@query("""
SELECT doc_id, strpos(text, 'the') AS position,
  CAST(length(left(text, strpos(text, 'the') - 1)) - length(replace(left(text, strpos(text, 'the') - 1), chr(10), '')) + 1 AS BIGINT) AS line
FROM documents WHERE strpos(text, 'the') > 0""")
def char_to_line(t: Tables) -> DataFrame:
    at = F.instr("text", "the")
    return t.documents.where(at > 0).select("doc_id", at.cast("long").alias("position"), text.line_of(F.col("text"), at - 1).cast("long").alias("line"))


@query("""
SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_fields(t: Tables) -> DataFrame:
    m = text.json_map(F.col("props"))
    return t.events.select("event_id", F.get(F.map_values(F.map_filter(m, lambda k, v: k == "page")), F.lit(0)).alias("page"), F.get(F.map_values(F.map_filter(m, lambda k, v: k == "missing")), F.lit(0)).alias("missing"))


@query("""
SELECT vec_id, list_bool_and([x = 0 for x in embedding]) AS zero, CAST(len(embedding) AS BIGINT) AS width FROM embeddings""")
def zero_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", V.is_zero(F.col("embedding")).alias("zero"), F.size("embedding").cast("long").alias("width"))


@query("""
SELECT vec_id, CASE WHEN score >= 0.8 THEN 'green' WHEN score >= 0.6 THEN 'yellow' ELSE 'red' END AS band, round(score, 3) + 0e0 AS score
FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings)""")
def score_bands(t: Tables) -> DataFrame:
    first = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("ask"))
    scored = t.embeddings.crossJoin(F.broadcast(first)).select("vec_id", V.cosine(F.col("embedding"), F.col("ask")).alias("score"))
    return scored.select("vec_id", text.score_band(F.col("score")).alias("band"), (F.round("score", 3) + 0.0).alias("score"))


# --- keyword search -----------------------------------------------------------------------------------------------------


@query(f"WITH tokens AS (SELECT {_TOKENS} AS ts FROM documents) SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS total, sum(len(ts)) * 1e0 / count(*) AS avgdl FROM tokens")
def bm25_corpus_stats(t: Tables) -> DataFrame:
    return keyword.corpus_stats(t.chunks)


@query(f"""
WITH seen AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(ts) AS term FROM (SELECT doc_id, {_TOKENS} AS ts FROM documents)) GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS idf0 FROM seen, (SELECT count(*) AS n FROM documents)),
mean AS MATERIALIZED (SELECT avg(idf0) AS m FROM raw)
SELECT term, df, round(CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25e0 * m END, 6) AS idf FROM raw, mean""")
def bm25_term_idf(t: Tables) -> DataFrame:
    return keyword.term_idf(t.chunks).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_bm25(QUERY).strip()} SELECT chunk_id, score FROM scored ORDER BY score DESC, chunk_id LIMIT 40")
def keyword_search(t: Tables) -> DataFrame:
    return t.index.search(QUERY, 40).select("chunk_id", "score")


@query(f"WITH {_bm25(RARE).strip()} SELECT chunk_id, score FROM scored ORDER BY score DESC, chunk_id LIMIT 40")
def keyword_search_zero_padded(t: Tables) -> DataFrame:
    return t.index.search(RARE, 40).select("chunk_id", "score")


@query(f"""
WITH {_bm25(QUERY).strip()}, top AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 20)
SELECT top.chunk_id, top.score, d.lang, d.source, l.quality FROM top JOIN documents d ON d.doc_id = top.chunk_id LEFT JOIN labels l ON l.doc_id = top.chunk_id""")
def keyword_search_hydrated(t: Tables) -> DataFrame:
    hits = t.index.search(QUERY, 20).select("chunk_id", "score")
    labels = t.labels.select(F.col("doc_id").alias("chunk_id"), "quality")
    return hits.join(t.chunks.select("chunk_id", "lang", F.col("project_id").alias("source")), "chunk_id").join(labels, "chunk_id", "left")


# --- vector search ------------------------------------------------------------------------------------------------------


@query(f"WITH {_COSINE.strip()} SELECT vec_id AS vector_id, score FROM sem ORDER BY score DESC, vec_id LIMIT 20")
def semantic_search(t: Tables) -> DataFrame:
    return V.search(t.vectors, t.ask(), 20).select("vector_id", "score")


@query(f"WITH {_COSINE.strip()} SELECT vec_id AS vector_id, label, score FROM sem WHERE label IN (1, 3, 5) ORDER BY score DESC, vec_id LIMIT 20")
def semantic_search_filtered(t: Tables) -> DataFrame:
    return V.search(t.vectors, t.ask(), 20, filters={"label": [1, 3, 5]}).select("vector_id", "label", "score")


@query(f"WITH {_COSINE.strip()} SELECT vec_id AS vector_id, score FROM sem WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 100")
def semantic_threshold(t: Tables) -> DataFrame:
    return V.search(t.vectors, t.ask(), 100, threshold=0.1).select("vector_id", "score")


@query("""
SELECT query_id, CAST(rank AS INTEGER) AS rank, vector_id, score FROM (
  SELECT query_id, vector_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS vector_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id))
WHERE rank <= 10""")
def batch_knn(t: Tables) -> DataFrame:
    return V.batch_search(t.vectors, t.vectors.where("vector_id % 100 = 0"), 10)


# --- fusion -------------------------------------------------------------------------------------------------------------


@query(f"WITH {_bm25(QUERY).strip()}, {_COSINE.strip()}, {_RRF.strip()} SELECT chunk_id, score FROM fused")
def rrf_hybrid(t: Tables) -> DataFrame:
    c = Collection(t.chunks, t.vectors, index=t.index)
    return fusion.rrf(c.semantic(t.ask(), 20).unionByName(c.keyword(QUERY, 20))).select("chunk_id", "score")


@query(f"WITH {_bm25(QUERY).strip()}, {_COSINE.strip()}, {_RRF.strip()} SELECT chunk_id, score FROM fused ORDER BY score DESC, seen, chunk_id LIMIT 10")
def hybrid_search(t: Tables) -> DataFrame:
    return search(Collection(t.chunks, t.vectors, index=t.index), SearchRequest(QUERY, 10, rerank=False), t.ask()).select("chunk_id", "score")


@query(f"WITH {_bm25(QUERY).strip()}, {_COSINE.strip()}, {_RRF.strip()} SELECT chunk_id, score FROM fused WHERE score >= 0.7")
def hybrid_threshold_empty(t: Tables) -> DataFrame:
    return search(Collection(t.chunks, t.vectors, index=t.index), SearchRequest(QUERY, 10, score_threshold=0.7, rerank=False), t.ask()).select("chunk_id", "score")


@query(f"""
WITH {_bm25(QUERY).strip()}, top AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT 40), tokens2 AS (SELECT chunk_id, list_distinct(ts) AS ts FROM tokens)
SELECT top.chunk_id, round(len(list_intersect(ts, ['and', 'the', 'tion', 'wh'])) / 4e0, 6) AS score
FROM top JOIN tokens2 USING (chunk_id) ORDER BY 2 DESC, top.score DESC, chunk_id LIMIT 20""")
def rerank_lexical(t: Tables) -> DataFrame:
    return fusion.rerank(Collection(t.chunks, t.vectors, index=t.index).keyword(QUERY, 40), fusion.lexical_scorer(QUERY), 20).select("chunk_id", "score")


_HIER = f"""
{_COSINE.strip()},
mean AS (SELECT label, list(x ORDER BY i) AS v FROM (
  SELECT label, i, round(avg(x), 9) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
five AS (SELECT label, round(list_cosine_similarity(v, {_ASK}), 6) AS score FROM mean ORDER BY 2 DESC, 1 LIMIT 5),
best AS (SELECT vec_id, label, score FROM (SELECT vec_id, label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM sem WHERE label IN (SELECT label FROM five)) WHERE n <= 3)"""


@query(f"WITH {_HIER.strip()} SELECT vec_id AS vector_id, label AS document_id, score FROM best ORDER BY score DESC, vec_id LIMIT 10")
def hierarchical_search(t: Tables) -> DataFrame:
    _, best = hierarchical.search(hierarchical.centroids(t.vectors), t.vectors, t.ask(), 10)
    return best.select("vector_id", "document_id", "score")


@query(f"""
WITH {_HIER.strip()}, s AS (SELECT conv_id, left(arg_min(text, turn), 200) || '...' AS summary FROM conversations GROUP BY conv_id)
SELECT vec_id AS vector_id, label AS document_id, score, summary FROM (SELECT * FROM best ORDER BY score DESC, vec_id LIMIT 10) b LEFT JOIN s ON s.conv_id = b.label""")
def hierarchical_with_summary(t: Tables) -> DataFrame:
    _, best = hierarchical.search(hierarchical.centroids(t.vectors), t.vectors, t.ask(), 10)
    return hierarchical.with_summaries(best.select("vector_id", "document_id", "score"), hierarchical.fallback_summary(t.turns))


@query("SELECT conv_id AS document_id, left(arg_min(text, turn), 200) || '...' AS summary, count(*) AS chunk_count FROM conversations GROUP BY conv_id")
def summary_fallback(t: Tables) -> DataFrame:
    return hierarchical.fallback_summary(t.turns)


@query("""
SELECT conv_id AS document_id, CASE WHEN length(p) > 4000 THEN left(p, 4000) || '...' ELSE p END AS prompt
FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS p FROM conversations WHERE turn < 10 GROUP BY conv_id)""")
def summary_prompts(t: Tables) -> DataFrame:
    return hierarchical.summary_prompt(t.turns)


@query("""
WITH p AS (SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn < 10), '') AS p FROM conversations GROUP BY conv_id),
now AS (SELECT conv_id, sha256(CASE WHEN length(p) > 4000 THEN left(p, 4000) || '...' ELSE p END) AS h FROM p),
old AS (SELECT l.doc_id, CASE WHEN l.quality = 1 THEN now.h ELSE 'old' END AS h, toxic = 1 AS stand_in FROM labels l LEFT JOIN now ON now.conv_id = l.doc_id)
SELECT coalesce(now.conv_id, old.doc_id) AS document_id,
  CASE WHEN now.conv_id IS NULL THEN 'gone' WHEN old.doc_id IS NULL THEN 'new' WHEN now.h IS DISTINCT FROM old.h OR old.stand_in THEN 'changed' ELSE 'kept' END AS change
FROM now FULL JOIN old ON now.conv_id = old.doc_id""")
def summary_changes(t: Tables) -> DataFrame:
    """Stored summaries are those of the rated rows: good ones hold the present prompt, the others an older one, toxic ones stand in for a failed one."""
    now = summaries.sources(t.turns)
    held = t.labels.join(now.select(F.col("document_id").alias("doc_id"), "source_hash"), "doc_id", "left")
    digest = F.when(F.col("quality") == 1, F.col("source_hash")).otherwise("old")
    stored = held.select(F.col("doc_id").alias("document_id"), digest.alias("source_hash"), F.when(F.col("toxic") == 1, "failed").otherwise("ok").alias("summary_status"))
    return summaries.changes(now, stored)


# --- projects and documents ---------------------------------------------------------------------------------------------


@query("SELECT source AS project_id, 'Project ' || source AS name FROM (SELECT DISTINCT source FROM documents) WHERE source = 'src3' OR 'Project ' || source = 'src3' ORDER BY 1 LIMIT 1")
def project_lookup(t: Tables) -> DataFrame:
    projects = t.documents.select(F.col("source").alias("project_id"), F.concat(F.lit("Project "), "source").alias("name")).distinct()
    return export.find_project(projects, "src3")


_EXTS = ["pdf", "doc", "xls", "ppt", "png", "md", "rst", "txt", "py", "rs", "sh", "yaml", "xml", "zip"]


@query(f"""
WITH f AS (SELECT page_id, '.' || [{", ".join(f"'{e}'" for e in _EXTS)}][CAST(page_id % {len(_EXTS)} AS INTEGER) + 1] AS ext FROM pages)
SELECT page_id, ext,
  CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.doc' THEN 'docx' WHEN ext = '.xls' THEN 'xlsx' WHEN ext = '.ppt' THEN 'pptx' WHEN ext = '.png' THEN 'image' WHEN ext = '.md' THEN 'md' WHEN ext = '.txt' THEN 'txt' WHEN ext IN ('.py', '.rs') THEN 'code' ELSE 'other' END AS upload_type,
  CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.doc' THEN 'docx' WHEN ext = '.xls' THEN 'xlsx' WHEN ext = '.ppt' THEN 'pptx' WHEN ext = '.png' THEN 'image' WHEN ext = '.md' THEN 'md' WHEN ext IN ('.txt', '.rst') THEN 'txt' ELSE 'other' END AS watch_type,
  CASE WHEN ext IN ('.pdf', '.doc', '.xls', '.ppt', '.md', '.txt', '.rst') THEN 'doc' WHEN ext IN ('.py', '.rs', '.sh') THEN 'code' WHEN ext IN ('.yaml', '.xml') THEN 'config' WHEN ext = '.png' THEN 'image' ELSE 'unknown' END AS category
FROM f""")
def doc_type_mapping(t: Tables) -> DataFrame:
    name = F.concat(F.lit("a/b.c/file"), F.col("page_id").cast("string"), F.lit("."), F.get(F.array(*[F.lit(e) for e in _EXTS]), F.pmod("page_id", F.lit(len(_EXTS))).cast("int")))
    ext = t.pages.select("page_id", paths.suffix(name).alias("ext"))
    e = F.col("ext")
    return ext.select("page_id", "ext", paths.upload_type(e).alias("upload_type"), paths.watch_type(e).alias("watch_type"), paths.category(e).alias("category"))


@query("SELECT doc_id, source, left(text, 40) AS head FROM documents WHERE text ILIKE '%THE T%' ORDER BY doc_id OFFSET 10 LIMIT 25")
def list_documents_page(t: Tables) -> DataFrame:
    found = t.documents.where(F.col("text").ilike(text.like_literal("THE T")))
    return export.page(found.select("doc_id", "source", F.left("text", F.lit(40)).alias("head")), ["doc_id"], 10, 25)


@query("SELECT source AS project_id, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS size, CAST(max(n_chars) AS BIGINT) AS largest FROM documents GROUP BY source")
def project_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("project_id")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("size"), F.max("n_chars").alias("largest"))


@query("SELECT DISTINCT source AS project_id FROM documents")
def distinct_projects(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("project_id")).distinct()


@query("""
SELECT d.source AS project_id, count(*) AS documents, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS chunks
FROM documents d LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id
WHERE d.source NOT IN ('src0', 'src1', 'src2') GROUP BY d.source""")
def orphan_projects(t: Tables) -> DataFrame:
    folders = t.spark.createDataFrame([("src0",), ("src1",), ("src2",)], "source string")
    counts = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    gone = t.documents.join(folders, "source", "left_anti").join(counts, "doc_id", "left")
    return gone.groupBy(F.col("source").alias("project_id")).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


@query("SELECT count(DISTINCT source) AS projects, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def system_totals(t: Tables) -> DataFrame:
    return projects.totals(t.documents.select(F.col("source").alias("project_id"), F.col("n_chars").alias("file_size")))


@query("""
SELECT l.doc_id AS chunk_id, CAST(l.quality AS DOUBLE) AS score, coalesce(d.text, '') AS content, coalesce(CAST(d.doc_id AS VARCHAR), '') AS document_id,
  d.source AS filename FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def hit_projection(t: Tables) -> DataFrame:
    hits = t.labels.select(F.col("doc_id").alias("chunk_id"), F.col("quality").cast("double").alias("score"))
    none = {c: F.lit(None).cast(k) for c, k in (("source_path", "string"), ("start_line", "int"), ("end_line", "int"), ("symbols", "array<string>"))}
    payload = t.chunks.select("chunk_id", "content", "document_id", F.col("project_id").alias("filename")).withColumns(none)
    return projects.hit_fields(hits, payload).select("chunk_id", "score", "content", "document_id", "filename")


@query("""
WITH f AS (SELECT source, lang, n_chars, doc_id FROM documents),
up AS (SELECT '' AS folder, n_chars, doc_id FROM f UNION ALL SELECT source, n_chars, doc_id FROM f UNION ALL SELECT source || '/' || lang, n_chars, doc_id FROM f)
SELECT folder, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, max(n_chars) AS largest, max(doc_id) AS newest FROM up GROUP BY folder""")
def folder_sizes(t: Tables) -> DataFrame:
    path = F.concat_ws("/", F.lit(""), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return folders.sizes(t.documents.select(path.alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("modified_at")))


_ABOUT = """(SELECT doc_id, CASE lang WHEN 'de' THEN '{"source": "' || source || '"' WHEN 'fr' THEN '["' || source || '"]' ELSE ' {"source": "' || source || '", "n": ' || n_chars || ', "more": {"lang": "' || lang || '"}}' END AS about FROM documents)"""


@query(f"""
SELECT doc_id, CAST(CASE WHEN ok THEN len(json_keys(about)) ELSE 0 END AS BIGINT) AS members, CASE WHEN ok THEN about->>'$.source' END AS source, CASE WHEN ok THEN CAST(about->>'$.n' AS BIGINT) END AS n
FROM (SELECT doc_id, CASE WHEN json_valid(about) THEN about ELSE '{{}}' END AS about, json_valid(about) AND json_type(CASE WHEN json_valid(about) THEN about ELSE '{{}}' END) = 'OBJECT' AS ok FROM {_ABOUT})""")
def upload_metadata(t: Tables) -> DataFrame:
    """What is told of an upload: German documents have broken JSON, French ones an array, the others an object."""
    whole = F.format_string(' {"source": "%s", "n": %d, "more": {"lang": "%s"}}', "source", "n_chars", "lang")
    about = F.when(F.col("lang") == "de", F.format_string('{"source": "%s"', "source")).when(F.col("lang") == "fr", F.format_string('["%s"]', "source")).otherwise(whole)
    told = t.documents.select("doc_id", uploads.metadata(about).alias("m"))
    return told.select("doc_id", F.size("m").cast("long").alias("members"), F.col("m")["source"].alias("source"), F.col("m")["n"].cast("long").alias("n"))


# --- coverage and consistency -------------------------------------------------------------------------------------------


@query(f"""
SELECT count(*) AS total, count(vector_id) AS with_vector, count(*) - count(vector_id) AS without_vector, round(count(vector_id) * 100e0 / count(*), 2) AS coverage FROM {_LINKED}""")
def vector_coverage(t: Tables) -> DataFrame:
    return upkeep.coverage(t.linked)


@query(f"""
SELECT project_id, count(*) AS total, count(vector_id) AS with_vector, count(*) - count(vector_id) AS without_vector, round(count(vector_id) * 100e0 / count(*), 2) AS coverage FROM {_LINKED} GROUP BY project_id""")
def coverage_by_project(t: Tables) -> DataFrame:
    return upkeep.coverage(t.linked, "project_id")


@query("SELECT doc_id AS vector_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(t: Tables) -> DataFrame:
    return upkeep.missing(t.documents.select(F.col("doc_id").alias("vector_id")), t.vectors)


@query("""
SELECT 'missing' AS kind, doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id * 3 FROM embeddings)
UNION ALL SELECT 'orphan' AS kind, vec_id * 3 AS chunk_id FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)""")
def payload_gaps(t: Tables) -> DataFrame:
    """Missing and orphaned by the chunk_id that a vector's payload holds, which isn't the vector's own id."""
    payload = t.embeddings.select((F.col("vec_id") * 3).alias("chunk_id"))
    lacking = upkeep.missing(t.chunks.select("chunk_id"), payload, "chunk_id").select(F.lit("missing").alias("kind"), "chunk_id")
    return lacking.unionAll(upkeep.orphans(payload, t.chunks.select("chunk_id"), "chunk_id").select(F.lit("orphan").alias("kind"), "chunk_id"))


@query("SELECT vec_id AS vector_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_vectors(t: Tables) -> DataFrame:
    return upkeep.orphans(t.vectors, t.labels.select(F.col("doc_id").alias("vector_id"))).select("vector_id", "label")


@query("SELECT vec_id AS vector_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def valid_vectors(t: Tables) -> DataFrame:
    return upkeep.valid(t.vectors, t.labels.select(F.col("doc_id").alias("vector_id"))).select("vector_id")


_VERDICT = """
db AS (SELECT 'p' || (doc_id % 10) AS project_id, count(*) AS n FROM documents GROUP BY 1),
vec AS (SELECT 'p' || label AS project_id, count(*) * 2 AS n FROM embeddings GROUP BY 1),
counts AS (SELECT coalesce(db.project_id, vec.project_id) AS project_id, coalesce(db.n, 0) AS db_count, coalesce(vec.n, 0) AS vector_count FROM db FULL JOIN vec USING (project_id)),
verdicts AS (SELECT project_id, db_count, vector_count, greatest(db_count - vector_count, 0) AS missing, greatest(vector_count - db_count, 0) AS orphan,
  CASE WHEN db_count > vector_count THEN 'sync_missing' WHEN vector_count > db_count THEN 'clean_orphans' ELSE 'none' END AS action,
  abs(db_count - vector_count) > 0.05e0 * greatest(db_count, vector_count) AS drift FROM counts)"""


def _verdicts(t: Tables) -> DataFrame:
    chunks = t.documents.select(F.concat(F.lit("p"), F.pmod("doc_id", F.lit(10)).cast("string")).alias("project_id"))
    vectors = t.embeddings.select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("project_id"))
    return upkeep.verdict(chunks, vectors.unionAll(vectors))


@query(f"WITH {_VERDICT.strip()} SELECT * FROM verdicts")
def consistency_verdict(t: Tables) -> DataFrame:
    return _verdicts(t)


@query(f"""
WITH {_VERDICT.strip()} SELECT project_id, count(*) AS projects, CAST(sum(CASE WHEN action <> 'none' THEN 1 ELSE 0 END) AS BIGINT) AS with_issues,
  CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(orphan) AS BIGINT) AS orphan FROM verdicts GROUP BY ROLLUP (project_id)""")
def consistency_rollup(t: Tables) -> DataFrame:
    return upkeep.verdict_rollup(_verdicts(t))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphaned_documents(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') INTERSECT SELECT vec_id FROM embeddings")
def id_intersection(t: Tables) -> DataFrame:
    return t.documents.where(F.col("source").isin("src1", "src2")).select("doc_id").intersect(t.embeddings.select(F.col("vec_id").alias("doc_id")))


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') EXCEPT SELECT vec_id FROM embeddings")
def id_difference(t: Tables) -> DataFrame:
    return t.documents.where(F.col("source").isin("src1", "src2")).select("doc_id").subtract(t.embeddings.select(F.col("vec_id").alias("doc_id")))


# --- queue --------------------------------------------------------------------------------------------------------------


@query(f"SELECT s.status, count(q.status) AS count FROM (VALUES ('pending'), ('processing'), ('done'), ('failed')) s(status) LEFT JOIN {_QUEUE} q USING (status) GROUP BY s.status")
def queue_status(t: Tables) -> DataFrame:
    return upkeep.status_counts(t.queue)


@query(f"SELECT chunk_id FROM {_LINKED} WHERE vector_id IS NULL AND chunk_id NOT IN (SELECT chunk_id FROM {_QUEUE} WHERE status <> 'failed')")
def queue_populate(t: Tables) -> DataFrame:
    return upkeep.populate(t.linked, t.queue).select("chunk_id")


@query(f"SELECT chunk_id, status, retry_count FROM {_QUEUE} WHERE status = 'pending' ORDER BY chunk_id LIMIT 50")
def queue_head(t: Tables) -> DataFrame:
    return t.queue.where("status = 'pending'").orderBy("chunk_id").limit(50)


@query(f"SELECT chunk_id, status, retry_count, CASE WHEN status = 'failed' AND retry_count < 3 THEN 'pending' ELSE status END AS next_status FROM {_QUEUE}")
def queue_next_state(t: Tables) -> DataFrame:
    return upkeep.next_state(t.queue)


@query(f"""
WITH c AS (SELECT count(*) AS total FROM documents), q AS (SELECT count(*) AS queued FROM documents WHERE doc_id NOT IN (SELECT chunk_id FROM {_QUEUE}))
SELECT queued, total - queued AS skipped, total FROM c, q""")
def queue_insert_counts(t: Tables) -> DataFrame:
    return upkeep.enqueue(t.queue, t.chunks.select("chunk_id", "content"))[1]


@query(f"SELECT count(*) AS retryable FROM {_QUEUE} WHERE status = 'failed' AND retry_count < 3")
def retryable_count(t: Tables) -> DataFrame:
    return t.queue.where((F.col("status") == "failed") & (F.col("retry_count") < upkeep.MAX_RETRY)).agg(F.count(F.lit(1)).alias("retryable"))


@query(f"SELECT d.source AS project_id, count(*) AS failed FROM {_QUEUE} q JOIN documents d ON d.doc_id = q.chunk_id WHERE q.status = 'failed' GROUP BY d.source ORDER BY 2 DESC, 1")
def failed_by_project(t: Tables) -> DataFrame:
    failed = t.queue.where("status = 'failed'").join(t.chunks.select("chunk_id", "project_id"), "chunk_id")
    return failed.groupBy("project_id").agg(F.count(F.lit(1)).alias("failed")).orderBy(F.desc("failed"), "project_id")


@query(f"SELECT q.chunk_id, q.retry_count, coalesce(d.source, 'unknown') AS filename FROM {_QUEUE} q LEFT JOIN (SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) d ON d.doc_id = q.chunk_id WHERE q.status = 'failed' ORDER BY q.retry_count DESC, q.chunk_id LIMIT 30")
def failed_list(t: Tables) -> DataFrame:
    names = t.linked.where("vector_id IS NOT NULL").select("chunk_id", F.col("project_id").alias("filename"))
    joined = t.queue.where("status = 'failed'").join(names, "chunk_id", "left").select("chunk_id", "retry_count", F.coalesce("filename", F.lit("unknown")).alias("filename"))
    return joined.orderBy(F.desc("retry_count"), "chunk_id").limit(30)


@query("SELECT event_id FROM events WHERE NOT (event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY)")
def purge_done(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))
    old = (F.col("event_type") == "view") & (F.col("ts") < F.col("last") - F.expr("INTERVAL 7 DAYS"))
    return t.events.crossJoin(F.broadcast(last)).where(~old).select("event_id")


# --- chunks -------------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (length(text) > 4000) AS overlong, CAST(max(length(text)) AS BIGINT) AS longest, count(*) FILTER (length(text) > 4000) = 0 AS passed FROM documents")
def overlong_audit(t: Tables) -> DataFrame:
    return upkeep.overlong(t.chunks, 4000)


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS length FROM documents WHERE length(text) > 4000 ORDER BY 2 DESC, 1 LIMIT 20")
def overlong_list(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length("text").cast("long").alias("length")).where("length > 4000").orderBy(F.desc("length"), "doc_id").limit(20)


@query("""
SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, trim(substr(text, 4000 * i + 1, 4000), ' ' || chr(9) || chr(10) || chr(13)) AS content
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 4000e0) AS BIGINT))) AS i FROM documents)
WHERE trim(substr(text, 4000 * i + 1, 4000), ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def fixed_window_chunks(t: Tables) -> DataFrame:
    return chunking.fixed_windows(t.documents, "doc_id", "text", 4000)


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS chunk_index FROM conversations")
def chunk_index_assign(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t.conversations.select("conv_id", "turn", n.cast("long").alias("chunk_index"))


@query("SELECT conv_id, turn, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 100), '') || text AS content FROM conversations")
def chunk_overlap_lag(t: Tables) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.concat(F.coalesce(F.right(before, F.lit(100)), F.lit("")), F.col("text")).alias("content"))


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS BIGINT) AS batch FROM documents")
def batch_assignment(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return t.documents.select("doc_id", F.floor(n / 10).cast("long").alias("batch"))


@query("SELECT conv_id AS document_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def export_document(t: Tables) -> DataFrame:
    return export.documents_text(t.turns)


@query("""
WITH each AS (SELECT 'p' || (conv_id % 5) AS project_id, conv_id, lpad(CAST(conv_id AS VARCHAR), 8, '0') AS filename,
    string_agg('[片段 ' || (turn + 1) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY conv_id)
SELECT project_id, string_agg('# ' || filename || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY filename) AS text FROM each GROUP BY project_id""")
def export_project(t: Tables) -> DataFrame:
    return export.project_text(t.turns, _conversation_documents(t))


@query("""
SELECT 'p' || (conv_id % 5) AS project_id, lpad(CAST(conv_id AS VARCHAR), 8, '0') AS filename, conv_id AS document_id,
  '# ' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || chr(10) || chr(10) || string_agg('[片段 ' || (turn + 1) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY conv_id""")
def export_project_rows(t: Tables) -> DataFrame:
    return export.project_rows(t.turns, _conversation_documents(t))


def _conversation_documents(t: Tables) -> DataFrame:
    """Conversations as documents of five projects; those rated toxic have failed."""
    ids = t.conversations.select(F.col("conv_id").alias("document_id")).distinct()
    toxic = t.labels.where("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit("failed").alias("failed")).distinct()
    named = ids.join(toxic, "document_id", "left")
    project = F.concat(F.lit("p"), F.pmod("document_id", F.lit(5)).cast("string"))
    return named.select("document_id", project.alias("project_id"), F.lpad(F.col("document_id").cast("string"), 8, "0").alias("filename"), F.coalesce("failed", F.lit("completed")).alias("status"))


@query("""
SELECT 'p' || (conv_id % 5) AS project_id, lpad(CAST(conv_id AS VARCHAR), 8, '0') AS filename, conv_id AS document_id, count(*) AS chunks,
  to_json(list({'chunk_index': turn, 'content': text} ORDER BY turn)) AS json
FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY conv_id""")
def export_project_json(t: Tables) -> DataFrame:
    return export.project_json(t.turns, _conversation_documents(t))


# --- events -------------------------------------------------------------------------------------------------------------


@query("""
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (
  SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
    SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, session""")
def debounce_sessions(t: Tables) -> DataFrame:
    return watch.sessions(t.events.select(F.col("user_id"), "ts"), "user_id", "30 minutes")


_FILE_EVENTS = "(SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS kind FROM events)"


def _file_events(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "purchase", "moved").otherwise("modified")
    return t.events.select(F.col("user_id").cast("string").alias("src_path"), "ts", kind.alias("event_type"))


@query()
def debounce_coalesced(t: Tables) -> DataFrame:
    """The fold over each session is procedural; tests hold it against a plain loop."""
    return watch.coalesce(_file_events(t), "1 day")


@query("""
WITH f AS (SELECT vec_id AS path, vec_id % 11 AS modified_at FROM embeddings), d AS (SELECT doc_id AS path, doc_id % 7 AS updated_at FROM labels)
SELECT coalesce(f.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'created' WHEN f.path IS NULL THEN 'deleted' WHEN f.modified_at > d.updated_at THEN 'updated' ELSE 'unchanged' END AS change
FROM f FULL JOIN d ON f.path = d.path""")
def sync_classify(t: Tables) -> DataFrame:
    files = t.embeddings.select(F.col("vec_id").alias("path"), (F.col("vec_id") % 11).alias("modified_at"))
    return upkeep.classify(files, t.labels.select(F.col("doc_id").alias("path"), (F.col("doc_id") % 7).alias("updated_at")))


@query(f"""
WITH e AS (SELECT 'p' || (user_id % 10) AS project_id, CASE kind WHEN 'modified' THEN 'updated' WHEN 'moved' THEN 'renamed' ELSE kind END AS change FROM {_FILE_EVENTS})
SELECT project_id, count(*) FILTER (change = 'created') AS created, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'deleted') AS deleted,
  count(*) FILTER (change = 'renamed') AS renamed, count(*) FILTER (change = 'skipped') AS skipped, count(*) FILTER (change = 'errors') AS errors FROM e GROUP BY ROLLUP (project_id)""")
def sync_counters_rollup(t: Tables) -> DataFrame:
    e = _file_events(t)
    change = F.when(F.col("event_type") == "modified", "updated").when(F.col("event_type") == "moved", "renamed").otherwise(F.col("event_type"))
    return upkeep.counters(e.select(F.concat(F.lit("p"), F.pmod(F.col("src_path").cast("long"), F.lit(10)).cast("string")).alias("project_id"), change.alias("change")))


# --- a collection that changes ------------------------------------------------------------------------------------------

_CHANGED = "(SELECT doc_id, CASE WHEN lang = 'es' THEN text || ' wh the' ELSE text END AS text FROM documents WHERE lang <> 'de')"


@query(f"WITH {_bm25(QUERY, _CHANGED).strip()} SELECT chunk_id, score FROM scored ORDER BY score DESC, chunk_id LIMIT 40")
def index_after_changes(t: Tables) -> DataFrame:
    """Three segments: all documents, those of one language removed, those of another replaced."""
    index = KeywordIndex(Store(t.spark, f"{shared_folder(t.spark)}/changing-{uuid.uuid4().hex}"))
    index.build(t.chunks)
    index.remove(t.chunks.where("lang = 'de'"))
    index.add(t.chunks.where("lang = 'es'").withColumn("content", F.concat("content", F.lit(" wh the"))))
    return index.search(QUERY, 40).select("chunk_id", "score")


@query(f"""
WITH c AS (SELECT d.doc_id, d.source, sha256(coalesce(d.text, '')) AS h, q.status, q.retry_count,
             EXISTS (SELECT 1 FROM embeddings e JOIN documents o ON o.doc_id = e.vec_id WHERE o.source = d.source AND o.lang IN ('en', 'fr') AND sha256(coalesce(o.text, '')) = sha256(coalesce(d.text, ''))) AS embedded
           FROM documents d LEFT JOIN {_QUEUE} q ON q.chunk_id = d.doc_id)
SELECT doc_id AS chunk_id, CASE WHEN embedded THEN 'done' WHEN status <> 'done' THEN status ELSE 'pending' END AS status, CASE WHEN NOT embedded AND status <> 'done' THEN retry_count ELSE 0 END AS retry_count
FROM c WHERE NOT embedded OR status IS NOT NULL""")
def queue_after_reingest(t: Tables) -> DataFrame:
    """Vectors of English and French documents hold their text, the others an older one; copies within a project share a vector."""
    digest = content_hash(F.col("content"))
    chunks = t.chunks.withColumns({"content_hash": digest, "vector_id": F.lit(None).cast("long")})
    known = t.embeddings.join(chunks.withColumnRenamed("chunk_id", "vec_id"), "vec_id")
    held = F.when(F.col("lang").isin("en", "fr"), F.col("content_hash")).otherwise(F.sha2(F.lit("old"), 256))
    vectors = known.select(F.col("vec_id").alias("vector_id"), "project_id", "document_id", held.alias("content_hash"), "embedding")
    queue = t.queue.join(chunks.select("chunk_id", "content_hash"), "chunk_id")
    stated, _ = with_state(chunks, vectors)
    return queue_state(queue, stated).select("chunk_id", "status", "retry_count")


@query("""
WITH b AS (SELECT d.doc_id, source || '/' || d.doc_id AS path, d.text, d.lang, coalesce(l.toxic, 0) = 1 AS gone FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT CASE WHEN gone THEN 'deleted' WHEN lang = 'de' THEN 'renamed' WHEN lang = 'fr' THEN 'updated' ELSE 'unchanged' END AS change, doc_id AS document_id, path AS old_path,
  CASE WHEN gone THEN NULL WHEN lang = 'de' THEN 'moved/' || doc_id ELSE path END AS path FROM b
UNION ALL SELECT 'created', NULL, NULL, 'pages/' || page_id FROM pages""")
def rename_detection(t: Tables) -> DataFrame:
    """Files of one language have moved, those of another changed, toxic ones are gone, pages are new."""
    path = F.concat_ws("/", "source", "doc_id")
    stored = t.documents.select(F.col("doc_id").alias("document_id"), path.alias("path"), F.length("text").cast("long").alias("size"), content_hash(F.col("text")).alias("content_hash"))
    there = t.documents.join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    body = F.when(F.col("lang") == "fr", F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    where = F.when(F.col("lang") == "de", F.concat(F.lit("moved/"), "doc_id")).otherwise(path)
    found = there.select(where.alias("path"), F.length(body).cast("long").alias("size"), content_hash(body).alias("content_hash"))
    new = t.pages.select(F.concat(F.lit("pages/"), "page_id").alias("path"), F.length("html").cast("long").alias("size"), content_hash(F.col("html")).alias("content_hash"))
    return moves.classify(stored, found.unionByName(new))


@query("""
WITH e AS (SELECT event_type AS root, CAST(user_id AS VARCHAR) AS src_path, ts, CASE WHEN lag(ts) OVER w > ts - INTERVAL 60 SECOND THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
b AS (SELECT root, src_path, ts, CAST(sum(fresh) OVER (PARTITION BY root ORDER BY ts) AS BIGINT) AS burst FROM e)
SELECT root, burst, src_path, max(ts) AS last_ts, count(*) AS n, (SELECT max(o.ts) FROM b o WHERE o.root = b.root AND o.burst = b.burst) + INTERVAL 60 SECOND AS flushed_at FROM b GROUP BY root, burst, src_path""")
def debounce_global(t: Tables) -> DataFrame:
    """One timer for all paths of a root; what each path's events amount to is procedural, and held against a simulation in tests."""
    events = t.events.select(F.col("event_type").alias("root"), F.col("user_id").cast("string").alias("src_path"), F.lit("modified").alias("event_type"), "ts")
    return debounce.bursts(events, 60.0).drop("event_type")


@query("""
SELECT project_id, points, indexed, project_id || ': ' || points || ' points, none indexed' AS message FROM (
  SELECT d.lang || '/' || d.source AS project_id, count(*) AS points, count(*) FILTER (l.toxic = 1) AS indexed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)
WHERE points > 10 AND indexed = 0""")
def unindexed_alarm(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").groupBy(F.concat_ws("/", "lang", "source").alias("project_id"))
    return upkeep.unindexed(rows.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("toxic") == 1).alias("indexed")), 10)


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_version(t: Tables) -> DataFrame:
    """Of several rows of a key the latest counts, as in every upsert."""
    return latest(t.events.select("event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("""
SELECT doc_id, quality, toxic FROM labels WHERE toxic = 0 UNION ALL SELECT l.doc_id, l.quality, 2 FROM labels l WHERE toxic = 1
UNION ALL SELECT doc_id, -1, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def upsert_commit(t: Tables) -> DataFrame:
    """A table and a log of the change in one commit of a store: toxic labels are replaced, those that were missing added."""
    store = Store(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")
    labels = t.labels.select("doc_id", "quality", "toxic")
    store.write("labels", labels)
    step = store.begin()
    toxic = labels.where("toxic = 1").withColumn("toxic", F.lit(2).cast(labels.schema["toxic"].dataType))
    lacking = t.documents.join(labels, "doc_id", "left_anti").select("doc_id", F.lit(-1).cast(labels.schema["quality"].dataType).alias("quality"), F.lit(0).cast(labels.schema["toxic"].dataType).alias("toxic"))
    step.upsert("labels", toxic.unionByName(lacking), ["doc_id"])
    step.write("log", lacking.select("doc_id"))
    step.commit()
    return store.read("labels")


@query("SELECT source || '/' || doc_id || '.' || lang AS path, source = 'src1' OR (lang = 'de' AND source <> 'src2') AS ignored FROM documents")
def project_ignored(t: Tables) -> DataFrame:
    """The root's rules, and those of one folder that take files back in."""
    rows = t.documents.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit("."), F.col("lang")).alias("path"))
    return ignore.with_ignored(rows, "path", {"": "*.de\nsrc1/\n", "src2": "!*.de\n"})


@query(f"""
WITH e AS (SELECT event_id, user_id, kind, kind = 'moved' AS m, user_id > event_id AS f, event_id % 2 = 0 AS g FROM {_FILE_EVENTS})
SELECT event_id, CASE WHEN m AND f AND NOT g THEN 'to' || user_id ELSE CAST(user_id AS VARCHAR) END AS src_path, CASE WHEN m AND f AND NOT g THEN 'created' WHEN m AND NOT f AND g THEN 'deleted' ELSE kind END AS event_type
FROM e WHERE NOT (m AND f AND g)""")
def boundary_moves(t: Tables) -> DataFrame:
    """A move out of what is ignored creates its target, one into it deletes its source, one inside it is nothing."""
    kinds = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "purchase", "moved").otherwise("modified")
    events = t.events.select("event_id", F.col("user_id").cast("string").alias("src_path"), F.concat(F.lit("to"), "user_id").alias("dest_path"), kinds.alias("event_type"))
    user = F.coalesce(F.regexp_extract("src_path", "([0-9]+)", 1).cast("long"), F.lit(0))
    return watch.across_boundary(events, user > F.col("event_id"), F.col("event_id") % 2 == 0).select("event_id", "src_path", "event_type")


_WATCH_ROWS = """
r AS (SELECT 'p' || user_id AS project_id, ts AS tm, CASE WHEN event_id % 7 = 0 THEN 'remove' WHEN event_type = 'signup' THEN 'add' WHEN event_type = 'error' THEN 'pause' WHEN event_type = 'purchase' THEN 'resume' ELSE 'measure' END AS kind,
           event_id % 200 + CASE WHEN event_id % 3 = 0 THEN 11 ELSE 2 END AS chunks, event_id % 200 AS points, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 200 END AS indexed FROM events),
s AS (SELECT *, coalesce(sum(CAST(kind = 'remove' AS INT)) OVER (PARTITION BY project_id ORDER BY tm, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spell FROM r),
w AS (SELECT *, coalesce(bool_or(kind = 'add') OVER p, false) AS watched FROM s WINDOW p AS (PARTITION BY project_id, spell ORDER BY tm, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT *, coalesce(last_value(CASE WHEN watched AND kind IN ('pause', 'resume') THEN kind END IGNORE NULLS) OVER p = 'pause', false) AS paused FROM w WINDOW p AS (PARTITION BY project_id, spell ORDER BY tm, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE kind WHEN 'add' THEN NOT watched WHEN 'remove' THEN watched WHEN 'pause' THEN watched AND NOT paused ELSE watched AND paused END AS ok FROM j WHERE kind <> 'measure'),
a AS (SELECT * FROM (SELECT *, lead(tm) OVER (PARTITION BY project_id ORDER BY tm, kind) AS e FROM c WHERE ok) WHERE kind IN ('add', 'resume')),
until AS (SELECT max(ts) AS u FROM events)"""


def _watch_rows(t: Tables) -> DataFrame:
    n, kind = F.col("event_id"), F.when(F.col("event_id") % 7 == 0, "remove").when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "purchase", "resume").otherwise("measure")
    points = (n % 200).alias("points")
    return t.events.select(F.concat(F.lit("p"), "user_id").alias("project_id"), kind.alias("kind"), F.col("ts").alias("at"), (n % 200 + F.when(n % 3 == 0, 11).otherwise(2)).alias("chunks"), points, F.when(n % 5 == 0, 0).otherwise(n % 200).alias("indexed"))


@query(f"""
WITH {_WATCH_ROWS},
d AS (SELECT project_id, spell, 'health' AS kind, unnest(generate_series(tm + INTERVAL 1 HOUR, coalesce(e - INTERVAL 1 MICROSECOND, u), INTERVAL 1 HOUR)) AS tm FROM a, until
      UNION ALL SELECT project_id, spell, 'consistency', unnest(generate_series(tm + INTERVAL 24 HOUR, coalesce(e - INTERVAL 1 MICROSECOND, u), INTERVAL 24 HOUR)) FROM a, until),
m AS (SELECT d.project_id, d.kind, d.tm, x.points, x.indexed, x.chunks FROM d ASOF LEFT JOIN (SELECT * FROM j WHERE kind = 'measure' AND watched) x ON d.project_id = x.project_id AND d.spell = x.spell AND d.tm >= x.tm),
f AS (SELECT *, concat_ws('; ', CASE WHEN points > 100 AND indexed = 0 THEN project_id || ': ' || points || ' points, none indexed' END,
                          CASE WHEN abs(chunks - points) > 0.05e0 * greatest(chunks, points) THEN project_id || ': ' || chunks || ' chunks, ' || points || ' points' END) AS alarms FROM m)
SELECT project_id, kind, tm AS "at", ok, CASE WHEN NOT ok THEN project_id || CASE kind WHEN 'add' THEN ' is already watched' WHEN 'remove' THEN ' is not watched' WHEN 'pause' THEN ' is not watched, or paused' ELSE ' is not paused' END END AS message FROM c
UNION ALL SELECT project_id, kind, tm, CASE WHEN kind = 'consistency' THEN true WHEN points IS NOT NULL THEN alarms = '' END,
  CASE WHEN kind = 'consistency' THEN 'scan ' || project_id WHEN points IS NULL THEN 'not measured' WHEN alarms <> '' THEN alarms END FROM f""")
def watch_history(t: Tables) -> DataFrame:
    """The watch registry's whole history: commands taken or refused, hourly health checks and daily scans while a project is watched."""
    end = t.events.agg(F.max("ts")).first()[0]
    return registry.history(_watch_rows(t), F.lit(end), 3600, 24 * 3600)


@query(f"""
WITH {_WATCH_ROWS}
SELECT project_id, CASE WHEN kind = 'pause' THEN 'paused' ELSE 'active' END AS state, tm AS since
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY tm DESC, kind DESC) AS n FROM c WHERE ok) WHERE n = 1 AND kind <> 'remove'""")
def watch_registry(t: Tables) -> DataFrame:
    """Which projects are watched, or paused, and since when."""
    return registry.standing(_watch_rows(t))


_NOTE = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))"


@query(f"""
WITH d AS (SELECT doc_id, {_NOTE} AS note, coalesce(lang, '') || ' of ' || coalesce(source, '') AS b, 'last ' || doc_id AS z,
             (['javascript', 'typescript', 'java', 'c', 'go'])[CAST(doc_id % 5 AS INTEGER) + 1] AS language FROM documents),
n AS (SELECT *, CASE WHEN length(note) < 3 OR lower(note) IN ('todo', 'fixme') AND (language <> 'go' OR note IN ('TODO', 'FIXME')) THEN NULL
             WHEN language = 'go' THEN '[Package] ' || CASE WHEN length(note) > 500 THEN left(note, 500) || '...' ELSE note END ELSE note END AS c FROM d)
SELECT doc_id, language, CASE WHEN language IN ('java', 'c') THEN concat_ws(' | ', c, z, b) WHEN language = 'go' THEN concat_ws(' | ', c, b, z) ELSE concat_ws(' | ', b, c, z) END AS comments,
       CAST(2 + (c IS NOT NULL)::INT AS INTEGER) AS n FROM n""")
def comment_lexer(t: Tables) -> DataFrame:
    """Each document as a source file of one of five languages, its words in comments and, between marks of comments, in literals."""
    note = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))
    of = F.concat(F.coalesce("lang", F.lit("")), F.lit(" of "), F.coalesce("source", F.lit("")))
    names = ["javascript", "typescript", "java", "c", "go"]
    literals = {
        "javascript": ["s = `// ", " ${ '/* no' + `${ \"//\" }` } */`; if (s) /[/'\"`]\\/* no/.test(s / 2 / 3);"],
        "typescript": ["const s: string = '// ", " /* no'; const t = { u: s } / 2; v = s as `/*${string}`;"],
        "java": ['String s = """\n// ', ' \\""" /* no\n"""; char q = \'"\';'],
        "c": ['char *s = "// ', ' \\" /* no"; char q = \'"\'; int r = q / *p;'],
        "go": ["var s = `// ", " \n/* no \\`"],
    }
    rows = t.documents.select("doc_id", note.alias("note"), of.alias("b"), F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 5 + 1).cast("int")).alias("language"))
    literal = F.coalesce(*[F.when(F.col("language") == k, F.concat(F.lit(a), "note", F.lit(z))) for k, (a, z) in literals.items()])
    last = F.concat(F.lit("\n// last "), "doc_id", F.lit("\n"))
    plain = F.concat(F.lit("/* "), "b", F.lit(" */\n// "), "note", F.lit("\n"), literal, last)
    go = F.concat(F.lit("// "), "note", F.lit("\npackage p\n/* "), "b", F.lit(" */\n"), literal, F.lit("\n// "), "note", last)
    found = rows.select("doc_id", "language", comments.extract(F.when(F.col("language") == "go", go).otherwise(plain), F.col("language")).alias("found"))
    return found.select("doc_id", "language", F.array_join("found", " | ").alias("comments"), F.size("found").alias("n"))


# --- procedural operators (tests hold them against plain loops) ---------------------------------------------------------


@query()
def semantic_chunks(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents, "doc_id", "text", chunking.SemanticChunker())


@query()
def legacy_chunks(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents, "doc_id", "text", chunking.LineChunker())


@query()
def code_chunks(t: Tables) -> DataFrame:
    return chunking.chunk(t.pages, "page_id", "html", chunking.CodeChunker("javascript"))


@query()
def markdown_sections(t: Tables) -> DataFrame:
    titled = t.conversations.groupBy("conv_id").agg(F.array_join(export.ordered(F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.col("text")), "turn"), "\n").alias("text"))
    return chunking.markdown_sections(titled, "conv_id", "text")


@query()
def html_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", markup.html_text(F.col("html")).alias("text"))


@query()
def comment_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", comments.extract(F.col("html"), F.lit("javascript")).alias("comments"))
