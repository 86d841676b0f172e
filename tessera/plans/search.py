"""Queries over retrieval, evaluation, markup, sheets, gateways and state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import media, text
from tessera.functions.similarity import similarity_udf, trigrams
from tessera.operators import chunking, images, retrieval, state, vectors
from tessera.schema import load
from tessera.session import spread, written
from tessera.sources import readers

from .base import micros, query

# Vectors


#: The vectors that are queries: each searches all chunks of its knowledge base.
DUE = "vec_id % 50 = 0"


def _vectors(spark: SparkSession, sf_dir: str, which: str = DUE) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "embeddings")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("kb_id"), "embedding")
    queries = e.where(which).select(F.col("vec_id").alias("query_id"), F.col("label").alias("kb_id"), "embedding")
    return queries, chunks


_SCORED = """s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 50 = 0),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM s)"""


@query(f"WITH {_SCORED} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM v WHERE rank < 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest chunks of each query in its knowledge base."""
    return _rounded(retrieval.vector_search(*_vectors(spark, sf_dir), 10), 6)


@query(f"WITH {_SCORED} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM v WHERE rank < 5 + query_id % 3")
def vector_topk_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, K1 for many queries, each with its own k."""
    queries, chunks = _vectors(spark, sf_dir)
    return _rounded(retrieval.vector_search(queries.withColumn("k", 5 + F.col("query_id") % 3), chunks, "k"), 6)


def _by_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The approximate and the exact ten nearest chunks of each query."""
    queries, chunks = _vectors(spark, sf_dir)
    centroids = vectors.fit_cells(chunks)
    index = written(vectors.build_index(chunks, centroids))
    probes = vectors.fit_probes(chunks, index, centroids, 10)
    return vectors.ann_search(queries, index, chunks, centroids, 10, probes), vectors.vector_search(queries, chunks, 10)


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: the ten nearest chunks of each query by the index of cells; approximate, so without SQL."""
    return _rounded(_by_index(spark, sf_dir)[0], 6)


@query(f"WITH {_SCORED} SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS enough FROM v WHERE rank < 10")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: whether the index finds nine in ten of the exact results, measured for all queries."""
    return vectors.recall(*_by_index(spark, sf_dir)).select("queries", "wanted", (F.col("recall") >= 0.9).alias("enough"))


def _rounded(ranked: DataFrame, digits: int) -> DataFrame:
    return ranked.select("query_id", "chunk_id", F.round("score", digits).alias("score"), F.col("rank").cast("long").alias("rank"))


_KEYWORD = "SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, (c.vec_id * 7 + q.vec_id * 3) % 500 AS rank FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 50 = 0 AND (c.vec_id * 7 + q.vec_id * 3) % 500 < 100"
_FUSED = f"""{_SCORED}, k AS ({_KEYWORD}), l AS (SELECT query_id, chunk_id, rank, 0 AS side FROM v WHERE rank < 10 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM k UNION ALL SELECT query_id, chunk_id, rank, 0 FROM v WHERE rank < 2),
f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank + 1)) AS score, min(rank) FILTER (side = 0) AS a, min(rank) FILTER (side = 1) AS b FROM l GROUP BY ALL),
o AS (SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, a NULLS LAST, b NULLS LAST, chunk_id) - 1 AS rank FROM f)"""


@query(f"WITH {_FUSED} SELECT * FROM o")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings fused, repeats within one list included."""
    return _rounded(retrieval.fuse(*_two_lists(spark, sf_dir)), 9)


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries, chunks = _vectors(spark, sf_dir)
    vector = retrieval.vector_search(queries, chunks, 10)
    vector = vector.unionByName(vector.where("rank < 2"))
    met = chunks.join(queries.select("query_id", "kb_id"), "kb_id")
    keyword = met.withColumn("rank", (F.col("chunk_id") * 7 + F.col("query_id") * 3) % 500).where("rank < 100").select("query_id", "chunk_id", "rank")
    return vector, keyword


@query(f"WITH {_FUSED}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id % 17 DESC, rank) - 1 AS r FROM o WHERE rank < 20) SELECT query_id, chunk_id, score, r AS rank FROM h WHERE r < 5")
def rerank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty in another order, fused scores kept."""
    vector, keyword = _two_lists(spark, sf_dir)
    queries, chunks = _vectors(spark, sf_dir)
    scorer = lambda _, content: content.cast("long") % 17
    out = retrieval.rerank(retrieval.fuse(vector, keyword), chunks.withColumn("content", F.col("chunk_id").cast("string")), queries.withColumn("query", F.lit("q")), scorer)
    return _rounded(out, 9)


@query(f"WITH {_FUSED}, t AS (SELECT query_id, string_agg('[' || (rank + 1) || '] chunk ' || chunk_id, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS sources FROM o WHERE rank < 5 GROUP BY 1), q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 < 2) SELECT query_id, coalesce(context, '') AS context, coalesce(sources, 0) AS sources, CASE WHEN context IS NULL THEN 'No relevant information found.' ELSE '' END AS answer FROM q LEFT JOIN t USING (query_id)")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context, sources and answer; half of the queries have no results."""
    ranked = retrieval.fuse(*_two_lists(spark, sf_dir)).where("rank < 5")
    e = load(spark, sf_dir, "embeddings")
    chunks = e.selectExpr("vec_id AS chunk_id", "label AS doc_id", "'chunk ' || vec_id AS content")
    queries = e.where("vec_id % 50 < 2").selectExpr("vec_id AS query_id", "'q' AS query")
    out = retrieval.assemble(queries, ranked, chunks)
    return out.select("query_id", "context", F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("sources"), "answer").withColumn("sources", F.greatest("sources", F.lit(0)))


# Evaluation

_EVAL = """n AS (SELECT count(*) AS n FROM documents), r AS (SELECT item_id AS query_id, k AS rank, (item_id * 25 + k) % n AS doc_id FROM benchmark, n, range(12) x(k) WHERE k < n),
h AS (SELECT b.item_id AS query_id, b.item_id % 3 AS tier, min(r.rank) FILTER (contains(d.text, string_split(b.text, ' ')[1] || ' ')) + 1 AS hit FROM benchmark b LEFT JOIN r ON r.query_id = b.item_id LEFT JOIN documents d USING (doc_id) GROUP BY ALL)"""
_SCORES = "count(*) AS queries, round(avg(CASE WHEN hit <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN hit <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_3, round(avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hits where each item ranks twelve of all documents: places are modulo the table's own count."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    items = load(spark, sf_dir, "benchmark")
    start = items.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")).where("n > 0"))).select(F.col("item_id").alias("query_id"), "n", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("rank"))
    ranked = start.where("rank < n").select("query_id", ((F.col("query_id") * 25 + F.col("rank")) % F.col("n")).alias("chunk_id"), "rank")
    phrases = items.select(F.col("item_id").alias("query_id"), F.array(F.lit(""), F.concat(F.get(F.split("text", " "), F.lit(0)), F.lit(" "))).alias("phrases"))
    return retrieval.first_hits(ranked, docs, phrases)


@query(f"WITH {_EVAL} SELECT {_SCORES} FROM h")
def eval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates and reciprocal rank over labelled queries."""
    return retrieval.scores(_hits(spark, sf_dir))


@query(f"WITH {_EVAL} SELECT tier, {_SCORES} FROM h GROUP BY tier")
def eval_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by tier."""
    return retrieval.scores(_hits(spark, sf_dir).withColumn("tier", F.col("query_id") % 3), "tier")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(median(value), 6) AS p50, round(max(value) FILTER (i = round_even(0.95 * (n - 1), 0)), 6) AS p95 FROM r GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and nearest-rank 95 % value."""
    return retrieval.latency(load(spark, sf_dir, "events"), "value", "event_type")


# Hybrid retrieval over documents: no SQL equivalent; tests hold the parts against brute force


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as queries, and the chunks of all documents as one knowledge base."""
    docs = load(spark, sf_dir, "documents").selectExpr("doc_id", "'all' AS kb_id", "text AS content")
    chunks = written(chunking.chunk_documents(spread(docs)))
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("kb_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("query"))
    return items.withColumn("embedding", retrieval.embed(F.col("query"))), chunks


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chunked, embedded and searched both ways for many queries."""
    queries, chunks = _corpus(spark, sf_dir)
    return retrieval.hybrid(queries, chunks.withColumn("embedding", retrieval.embed(F.col("content"))))


@query()
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-similarity search, pruned by an inverted index of trigrams."""
    queries, chunks = _corpus(spark, sf_dir)
    return retrieval.keyword_search(queries, chunks, 10)


@query("""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark), t AS (SELECT DISTINCT item_id, substring('  ' || w || ' ', i, 3) AS g FROM w, unnest(range(1, length(w) + 2)) AS r(i))
SELECT item_id, count(*) AS n, sha256(string_agg(g, '|' ORDER BY g COLLATE "C")) AS grams FROM t GROUP BY 1
""".replace(' COLLATE "C"', ""))
def trigram_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct trigrams of texts, as the index has them."""
    g = trigrams(F.col("text"))
    b = load(spark, sf_dir, "benchmark").select("item_id", F.array_sort(g).alias("g"))
    return b.select("item_id", F.size("g").cast("long").alias("n"), text.sha256(F.array_join("g", "|")).alias("grams"))


@query()
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each benchmark text against the text itself."""
    b = load(spark, sf_dir, "benchmark").withColumn("q", F.array_join(F.slice(F.split("text", " "), 1, 3), " "))
    return b.select("item_id", F.round(similarity_udf("q", "text"), 6).alias("score"))


@query()
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents."""
    docs = load(spark, sf_dir, "documents").selectExpr("doc_id", "source AS kb_id", "text AS content")
    return chunking.chunk_documents(docs)


# Markdown, images, names

_MARKDOWN = "'# Doc ' || doc_id || chr(10) || text || chr(10) || '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || '## Part  ' || (doc_id % 7) || '  ' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '```' || chr(10) || '### open fence' ELSE '#nospace' END"


@query(f"""
WITH m AS (SELECT doc_id, string_split({_MARKDOWN}, chr(10)) AS l FROM documents), x AS (SELECT doc_id, i - 1 AS line, l[i] AS s, len(list_filter(l[1:i], lambda y: starts_with(y, '```'))) AS before, len(list_filter(l, lambda y: starts_with(y, '```'))) AS total FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM m))
SELECT doc_id, line, length(regexp_extract(s, '^(#{{1,6}})\\s', 1))::INT AS level, trim(regexp_extract(s, '^#{{1,6}}\\s+(.+)$', 1)) AS title FROM x WHERE regexp_matches(s, '^#{{1,6}}\\s+.+') AND NOT (before % 2 = 1 AND before < total) AND NOT starts_with(s, '```')
""")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of markdown outside of code fences."""
    d = load(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MARKDOWN.replace('chr(10)', 'char(10)')} AS content")
    return images.outline(d).withColumn("line", F.col("line").cast("long"))


@query()
def image_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references placed in markdown, orphans by page."""
    made = "'# Top' || char(10) || left(text, length(text) div 2) || char(10) || '![first](imgs/a.png)' || char(10) || '## Two' || char(10) || substring(text, length(text) div 2 + 1) || ' ![second](b.png) tail'"
    refs = "array(named_struct('name', 'a.png', 'width', 300, 'height', 200, 'page', 1), named_struct('name', 'b.png', 'width', cast(null as int), 'height', cast(null as int), 'page', 3), named_struct('name', 'c.png', 'width', 400, 'height', 400, 'page', 2), named_struct('name', 'small.png', 'width', 50, 'height', 400, 'page', 2))"
    d = load(spark, sf_dir, "documents").selectExpr("doc_id", f"{made} AS md", f"{refs} AS refs")
    return d.select("doc_id", F.posexplode(images.place_udf("md", "refs")).alias("at", "x")).select("doc_id", "at", "x.*")


_SIZES = "SELECT event_id, (event_id * 37) % 2000 AS w, (event_id * 91) % 1500 AS h FROM events"


@query(f"""
WITH s AS ({_SIZES}), g AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN gcd(w, h) END AS g FROM s), r AS (SELECT *, w // g AS rw, h // g AS rh, w / h AS q FROM g)
SELECT event_id, CASE WHEN w = 0 OR h = 0 THEN '' {' '.join(f"WHEN abs(q - {a}.0 / {b}) < 0.05 THEN '{a}:{b}'" for a, b in media.RATIOS)} {' '.join(f"WHEN (rw > 20 OR rh > 20) AND abs(q - {a}.0 / {b}) < 0.1 THEN '{a}:{b}'" for a, b in media.RATIOS)} ELSE rw || ':' || rh END AS ratio,
 w >= 100 AND h >= 100 AS kept, CASE WHEN w >= 200 AND h >= 200 THEN 'pending' ELSE 'skipped' END AS vision FROM r
""")
def image_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspect ratios, size filter and vision gate."""
    e = load(spark, sf_dir, "events").selectExpr("event_id", "(event_id * 37) % 2000 AS w", "(event_id * 91) % 1500 AS h")
    w, h = F.col("w"), F.col("h")
    return e.select("event_id", media.aspect_ratio(w, h).alias("ratio"), media.image_kept(w, h).alias("kept"), media.vision_status(True, w, h).alias("vision"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 4000 + 1 END AS width, CASE WHEN event_id % 3 <> 0 THEN user_id + 7 END AS height FROM events")
def png_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from PNG headers; other bytes have none."""
    head = "unhex(CASE WHEN event_id % 3 <> 0 THEN '89504E470D0A1A0A' ELSE 'FFD8FFE000104A46' END || '0000000D49484452' || lpad(hex(event_id % 4000 + 1), 8, '0') || lpad(hex(user_id + 7), 8, '0'))"
    width, height = media.png_size(F.col("b"))
    return load(spark, sf_dir, "events").selectExpr("event_id", f"{head} AS b").select("event_id", width.alias("width"), height.alias("height"))


_HASH = "SELECT event_id AS id, left(md5(CAST(event_id % 300 AS VARCHAR)), 15) || substr('0123456789abcdef', (event_id % 16)::INT + 1, 1) AS phash FROM events"
_BITS = "bit_count(xor(('0x' || left(x.phash, 8))::BIGINT, ('0x' || left(y.phash, 8))::BIGINT))::INT + bit_count(xor(('0x' || right(x.phash, 8))::BIGINT, ('0x' || right(y.phash, 8))::BIGINT))::INT"


@query(f"WITH h AS ({_HASH}), c AS (SELECT phash, min(id) AS rep FROM h GROUP BY 1) SELECT x.rep AS a, y.rep AS b, {_BITS} AS bits FROM c x JOIN c y ON x.rep < y.rep WHERE {_BITS} <= 5 UNION ALL SELECT rep, id, 0 FROM h JOIN c USING (phash) WHERE id <> rep")
def near_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose perceptual hashes differ in five bits at most, equal hashes as one class: pairs of representatives, and the members of each."""
    return images.near_image_classes(_hashes(spark, sf_dir))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr("event_id AS id", "left(md5(encode(cast(event_id % 300 AS string), 'UTF-8')), 15) || substr('0123456789abcdef', cast(event_id % 16 AS int) + 1, 1) AS phash")


@query("SELECT user_id AS doc_id, event_id AS image_index, 'img' || (event_id % 5) || CASE row_number() OVER w WHEN 1 THEN '' ELSE '_' || (row_number() OVER w - 1) END || '.png' AS filename FROM events WINDOW w AS (PARTITION BY user_id, event_id % 5 ORDER BY event_id)")
def unique_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image file names without repeats in a document."""
    e = load(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "event_id AS image_index", "'p/img' || (event_id % 5) || '.png?x=1' AS name")
    return images.unique_names(e)


@query("""
SELECT event_id, coalesce(NULLIF(CASE WHEN event_id % 7 = 0 THEN 'sub' || user_id WHEN event_id % 7 = 1 THEN '' END, ''), CASE WHEN event_id % 5 = 0 THEN left(sha256('key' || user_id), 16) END, NULLIF(trim(CASE WHEN event_id % 3 = 0 THEN ' 9.9.9.' || (user_id % 250) || ' , 1.1.1.1' END.split(',')[1]), ''), CASE WHEN event_id % 2 = 0 THEN 'h' || user_id END, 'unknown') AS principal,
 CASE event_id % 5 WHEN 0 THEN 'German' WHEN 1 THEN 'Chinese' WHEN 2 THEN 'xx-Yy' WHEN 3 THEN 'English' ELSE 'English' END AS language,
 CASE WHEN event_id < 60 THEN event_id || ' 秒' WHEN event_id < 3600 THEN (event_id // 60) || ' 分' || CASE WHEN event_id % 60 > 0 THEN ' ' || (event_id % 60) || ' 秒' ELSE '' END ELSE (event_id // 3600) || ' 小时' || CASE WHEN event_id % 3600 // 60 > 0 THEN ' ' || (event_id % 3600 // 60) || ' 分' ELSE '' END END AS duration,
 CASE event_id % 4 WHEN 0 THEN 'ERR_CERT_DATE_INVALID' WHEN 1 THEN 'ERR_SSL_UNRECOGNIZED_NAME_ALERT' END AS permanent FROM events
""".replace("END.split(',')[1]", "END, ',')[1]").replace("trim(CASE WHEN event_id % 3 = 0 THEN ' 9", "trim(string_split(CASE WHEN event_id % 3 = 0 THEN ' 9"))
def request_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principals, languages, durations and permanent fetch errors."""
    e = load(spark, sf_dir, "events")
    c = lambda sql: F.expr(sql)
    principal = text.principal_key(c("CASE WHEN event_id % 7 = 0 THEN 'sub' || user_id WHEN event_id % 7 = 1 THEN '' END"), F.lit(None).cast("string"), c("CASE WHEN event_id % 5 = 0 THEN 'key' || user_id END"), c("CASE WHEN event_id % 3 = 0 THEN ' 9.9.9.' || (user_id % 250) || ' , 1.1.1.1' END"), c("CASE WHEN event_id % 2 = 0 THEN 'h' || user_id END"))
    language = text.language_name(c("CASE event_id % 5 WHEN 0 THEN 'de-AT' WHEN 1 THEN ' zh ' WHEN 2 THEN 'xx-Yy' WHEN 3 THEN 'no such thing' END"))
    error = text.permanent_browser_error(c("CASE event_id % 4 WHEN 0 THEN 'Page.goto: net::ERR_CERT_DATE_INVALID at x' WHEN 1 THEN 'net::ERR_SSL_UNRECOGNIZED_NAME_ALERT' WHEN 2 THEN 'net::ERR_SSL_PROTOCOL_ERROR' ELSE 'timeout' END"))
    return e.select("event_id", principal.alias("principal"), language.alias("language"), text.duration(F.col("event_id")).alias("duration"), error.alias("permanent"))


# Sheets, pages, gateways


@query("""
WITH r AS (SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row, n_nationkey, n_name || '|x' AS name FROM nation), t AS (SELECT doc_id, string_agg('| ' || n_nationkey || ' | ' || replace(name, '|', '\\|') || ' |', chr(10) ORDER BY row) FILTER (row > 1) AS rest, max('| ' || n_nationkey || ' | ' || replace(name, '|', '\\|') || ' |') FILTER (row = 1) AS head FROM r GROUP BY 1)
SELECT doc_id::BIGINT AS doc_id, 'S' AS sheet, '## Sheet: S' || chr(10) || chr(10) || head || chr(10) || '| --- | --- |' || chr(10) || rest AS markdown FROM t
""")
def sheet_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets as pipe tables; blank rows around the filled ones go."""
    n = load(spark, sf_dir, "nation")
    rows = n.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.lit("S").alias("sheet"), F.col("n_nationkey").alias("row"), F.array(F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit("|x"))).alias("cells"))
    blank = rows.groupBy("doc_id", "sheet").agg(F.lit(-1).alias("row"), F.array(F.lit(" "), F.lit(None).cast("string")).alias("cells"))
    return readers.sheet_markdown(rows.unionByName(blank))


@query("SELECT conv_id AS doc_id, string_agg('## Page ' || turn || chr(10) || chr(10) || CASE WHEN length(text) > 400 THEN left(text, 400) || chr(10) || chr(10) || '_page cut_' ELSE text END, chr(10) || chr(10) ORDER BY turn, text) AS content, count(*)::INT AS page_count FROM conversations GROUP BY 1")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages put together, long ones cut with a notice."""
    pages = load(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "turn AS page", "text")
    return readers.page_markdown(pages, 400)


@query("""
SELECT event_id AS doc_id, CASE WHEN event_id % 5 <> 0 THEN 'p ' || event_id || ' ![](a.png)' || chr(10) || chr(10) || 'q' END AS content, CASE WHEN event_id % 5 <> 0 THEN 2 END AS page_count, CASE WHEN event_id % 5 <> 0 THEN '1:a.png' END AS images, CASE WHEN event_id % 5 = 0 THEN 'busy' END AS error FROM events
""")
def layout_gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of a layout service."""
    body = """'{"errorCode": ' || IF(event_id % 5 = 0, '7, "errorMsg": "busy"', '0') || ', "result": {"layoutParsingResults": [{"markdown": {"text": "p ' || event_id || ' <img src=\\'x/y/a.png\\' width=3>", "images": {"x/y/a.png": "b64"}}}, {"markdown": {"text": "q"}}]}}'"""
    r = readers.layout_gateway(load(spark, sf_dir, "events").selectExpr("event_id AS doc_id", f"{body} AS body"))
    return r.select("doc_id", "content", "page_count", F.array_join(F.transform("images", lambda i: F.concat_ws(":", i["page"], i["name"])), ",").alias("images"), "error")


@query("SELECT event_id AS doc_id, 'a.png:' || (event_id % 9 + 1) || ',b.png:3' AS pages FROM events")
def content_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of images from a content list; the last entry of a name wins."""
    lists = load(spark, sf_dir, "events").selectExpr("event_id AS doc_id", """'[{"img_path": "i/a.png", "page_idx": 0}, {"img_path": "i/b.png", "page_idx": 2}, {"type": "text"}, {"img_path": "j/a.png", "page_idx": ' || (event_id % 9) || '}]' AS content_list""")
    r = readers.content_list_pages(lists)
    return r.select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries("pages"), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",").alias("pages"))


@query("SELECT event_id AS doc_id, '# N' || user_id || ' (@n)' || chr(10) || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'hello' ELSE '## T' || chr(10) || chr(10) || 'B' END || chr(10) || chr(10) || '![](u1)' || chr(10) || chr(10) || '![](u2)' AS markdown FROM events")
def post_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of posts as markdown."""
    body = """'{"author": {"name": "N' || user_id || '", "screen_name": "n"}, ' || IF(event_id % 2 = 0, '"text": "hello"', '"text": "", "article": {"title": "T", "body": "B"}') || ', "images": ["u1", "u2", "u1"]}'"""
    return readers.post_record(load(spark, sf_dir, "events").selectExpr("event_id AS doc_id", f"{body} AS body"))


# State machines


@query("""
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS name, event_id AS id, epoch_us(ts) / 1e6 AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
 SELECT name, id, n, 'pass' AS verdict, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS bad, 0::DOUBLE AS opened FROM e WHERE n = 1
 UNION ALL
 SELECT e.name, e.id, e.n, CASE WHEN held THEN 'reject' ELSE 'pass' END, CASE WHEN held THEN 'open' WHEN e.ok THEN 'closed' WHEN s.state = 'open' OR s.bad + 1 >= 2 THEN 'open' ELSE 'closed' END,
  CASE WHEN held THEN s.bad WHEN e.ok THEN 0 ELSE s.bad + 1 END, CASE WHEN NOT held AND NOT e.ok AND (s.state = 'open' OR s.bad + 1 >= 2) THEN e.t ELSE s.opened END
 FROM s JOIN e ON e.name = s.name AND e.n = s.n + 1, LATERAL (SELECT s.state = 'open' AND e.t - s.opened < 86400 AS held) h
)
SELECT name, id, verdict, state FROM s
""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: verdict and state for each call of a service."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (F.col("event_type") != "error").alias("ok"), F.lit(True).alias("counted"))
    return state.breaker(e, 2, 86400.0)


@query("""
WITH RECURSIVE e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS key, event_id AS id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events),
s AS (
 SELECT key, id, n, true AS allowed, t AS newest, NULL::DOUBLE AS before FROM e WHERE n = 1
 UNION ALL
 SELECT e.key, e.id, e.n, free, CASE WHEN free THEN e.t ELSE s.newest END, CASE WHEN free THEN s.newest ELSE s.before END
 FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1, LATERAL (SELECT s.before IS NULL OR e.t - s.before >= 3600 AS free) f
)
SELECT key, id, allowed FROM s
""")
def moving_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: which hits a moving window lets through."""
    e = load(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return state.limiter(e, 2, 3600.0)


_COOLED = "WITH v AS (SELECT user_id AS host, event_id AS id, epoch(ts) AS t, event_type = 'error' AS blocked FROM events) SELECT host, id, coalesce(t - max(CASE WHEN blocked THEN t END) OVER (PARTITION BY host ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 90000, false) AS cooled FROM v"


@query(_COOLED)
def block_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: visits to hosts that are on cooldown."""
    v = load(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (F.col("event_type") == "error").alias("blocked"))
    return state.cooldown(v, 90000).select("host", "id", "cooled")


_ATTEMPT_COLUMNS = ("CAST(floor(event_id / 3) AS BIGINT) AS url_id", "event_id % 3 + 1 AS attempt", "CASE (event_id * 7) % 11 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 429 ELSE 200 END AS status", "(event_id * 5) % 7 = 0 AS empty", "(event_id * 3) % 13 = 0 AS blocked")
_ATTEMPTS = f"SELECT {', '.join(_ATTEMPT_COLUMNS)} FROM events"


@query(f"WITH a AS ({_ATTEMPTS}), e AS (SELECT *, CASE WHEN status IN (404, 410) THEN 'gone' WHEN blocked THEN 'blocked' WHEN status >= 500 OR status = 429 OR empty THEN NULL ELSE 'ok' END AS e FROM a), g AS (SELECT url_id, min(attempt) FILTER (e IS NOT NULL) AS f, max(attempt) AS l FROM e GROUP BY 1) SELECT g.url_id, coalesce(e.e, 'failed') AS outcome, coalesce(f, l) AS used FROM g LEFT JOIN e ON e.url_id = g.url_id AND e.attempt = g.f")
def fetch_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of fetches with up to three tries."""
    return state.fetch_outcome(load(spark, sf_dir, "events").selectExpr(*_ATTEMPT_COLUMNS))


_TIERS = (
    "event_id % 3 AS k",
    "CASE (event_id * 7) % 13 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 503 ELSE 200 END AS status",
    "CASE WHEN (event_id * 5) % 11 = 0 THEN 'application/PDF; v=1' ELSE 'text/html' END AS content_type",
    "CASE (event_id * 3) % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'short' WHEN 2 THEN 'Just a moment ' || repeat('x', 400) ELSE repeat('word ', 90) END AS content",
    "(event_id * 11) % 17 = 0 AS blocked",
)


@query(f"""
WITH a AS (SELECT event_id // 3 AS url_id, {', '.join(_TIERS)} FROM events),
t AS (SELECT *, (url_id % 7) = 0 AS skips, trim(CASE WHEN status = 200 AND NOT blocked THEN content ELSE '' END) AS said FROM a),
e AS (SELECT url_id, k, CASE WHEN skips AND k < 2 THEN NULL WHEN status = 404 THEN 'gone' WHEN k = 0 AND status = 200 AND content_type LIKE 'application/PDF%' THEN 'pdf' WHEN k = 0 AND length(said) >= 300 AND NOT starts_with(said, 'Just a moment') THEN 'ok' WHEN k > 0 AND said <> '' THEN 'ok' WHEN k = 2 THEN 'empty' END AS e FROM t),
f AS (SELECT url_id, min(k) FILTER (e IS NOT NULL) AS k FROM e GROUP BY 1)
SELECT f.url_id, CASE f.k WHEN 0 THEN 'http' WHEN 1 THEN 'impersonated' WHEN 2 THEN 'browser' END AS tier, coalesce(e.e, 'unfinished') AS outcome FROM f LEFT JOIN e ON e.url_id = f.url_id AND e.k = f.k
""")
def fetch_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier that ended each fetch, from recorded attempts."""
    a = load(spark, sf_dir, "events").selectExpr("event_id DIV 3 AS url_id", *_TIERS)
    host = F.when(F.col("url_id") % 7 == 0, "www.threads.net").otherwise("h.example")
    return state.fetch_tiers(a.select("*", F.concat(F.lit("https://"), host, F.lit("/p")).alias("url"), F.get(F.array(*map(F.lit, state.TIERS)), F.col("k").cast("int")).alias("tier")))


# Streams


@query("WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS start FROM events) SELECT epoch_us(start) AS start, count(*) AS total, count(*) FILTER (event_type = 'error')::BIGINT AS bad FROM w GROUP BY start")
def streamed_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 as a stream: sliding counts, run to the end of what is there."""
    import uuid

    from tessera.streaming import windows

    events = windows.event_stream(spark, sf_dir)
    counts = windows.windowed_ratio(events, F.col("event_type") == "error", "10 minutes", "5 minutes")
    return windows.run_to_end(counts, f"counts_{uuid.uuid4().hex}", "complete").select(micros("start"), "total", "bad")


@query(_COOLED)
def streamed_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10 as a stream: visits are folded in event time, and a host's block is forgotten by a timer."""
    from tessera.streaming import ordered, windows

    e = windows.event_stream(spark, sf_dir, files=100_000).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), "ts", (F.col("event_type") == "error").alias("blocked"))
    cooled = windows.run_to_table(ordered.cooldown_stream(ordered.ended(e), 90000, "0 seconds"), **ordered.STORE)
    return cooled.select(F.col("key").cast("long").alias("host"), "id", F.col("verdict").alias("cooled"))


# Main content, and sites with rules of their own


@query()
def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page as markdown."""
    from tessera.sources.sites import extract_main

    return extract_main(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


_SITE_PAGES = (
    "CASE page_id % 4 WHEN 0 THEN 'xhs' WHEN 1 THEN 'baike' WHEN 2 THEN 'wechat' ELSE 'generic' END AS site, "
    "CASE page_id % 4 WHEN 0 THEN '<title>N' || page_id || ' - 小红书</title><meta name=\"description\" content=\"body ' || page_id || '\"><img src=\"https://ci.xhscdn.com/' || page_id || '\"><img src=\"https://ci.xhscdn.com/avatar\">' "
    "WHEN 1 THEN '<title>E' || page_id || '_百度百科</title><div class=\"para_x1\">' || repeat('text ', 60) || page_id || '</div><div class=\"paraTitle_1\">no</div>' "
    "WHEN 2 THEN '<h1 id=\"activity-name\"> T' || page_id || ' </h1><div id=\"js_content\"><p>Hello  ' || page_id || '</p><img data-src=\"u' || page_id || '\"></div>' ELSE html END AS html"
)


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'xhs' WHEN 1 THEN 'baike' ELSE 'wechat' END AS site, CASE page_id % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'E' ELSE 'T' END || page_id AS title,
 CASE page_id % 4 WHEN 0 THEN 'body ' || page_id WHEN 1 THEN repeat('text ', 60) || page_id ELSE 'Hello ' || page_id END AS body, CASE page_id % 4 WHEN 0 THEN 'https://ci.xhscdn.com/' || page_id WHEN 1 THEN '' ELSE 'u' || page_id END AS images FROM pages WHERE page_id % 4 < 3
""")
def site_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, bodies and images by the rules of single sites."""
    from tessera.sources.sites import extract_sites

    p = load(spark, sf_dir, "pages").selectExpr("page_id", *[_SITE_PAGES.rsplit(", CASE", 1)[0], "CASE" + _SITE_PAGES.rsplit(", CASE", 1)[1]])
    return extract_sites(p).withColumn("images", F.array_join("images", " "))
