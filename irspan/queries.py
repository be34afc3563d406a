"""Registered retrieval queries, each over whole tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irspan.functions import text as T
from irspan.operators import agreement, combine, encoding, expansion, metrics, physical, retrievers, segments, significance, sweeps, vectors
from irspan.operators.bm25 import BM25Retriever, LexicalIndex, query_terms
from irspan.operators.ranking import top_k
from irspan.operators.rm3 import RM3Retriever
from irspan.plans.service import describe_benchmark
from irspan.sources import datasets, embeddings
from irspan.sources import fixtures as X

_QUERIES: dict = {}
_ORACLES: dict = {}

STOP = "('" + "','".join(T.STOPWORDS) + "')"


def _query(sql: str | None = None, name: str | None = None):
    """Register a query, with its SQL where there is one; ``{x}`` places are filled by the caller."""

    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _ORACLES[key] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLES)


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([X.SQL.strip(), *ctes]) + "\n" + select


def _ints(df: DataFrame) -> DataFrame:
    """Integers as bigint, doubles to six decimals: what both engines compare."""
    kinds = dict(df.dtypes)
    return df.select(*(F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns))


# ---- SQL of the lexical index and of scoring ------------------------------------------------------


def _lex(stop: bool = True) -> str:
    where = f"WHERE term NOT IN {STOP}" if stop else ""
    return f"""t AS (SELECT doc_id, term FROM tok {where}),
dl AS (SELECT c.doc_id, count(t.term) AS dl FROM corpus c LEFT JOIN t USING (doc_id) GROUP BY 1),
fs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), fs),
qt AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM qtok {where} GROUP BY ALL)"""


def _scored(name: str, k1: float = 0.9, b: float = 0.4, terms: str = "qt", k: int = 10) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(weight * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
  FROM {terms} JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), fs GROUP BY ALL) WHERE score > 0 QUALIFY rank <= {k})"""


_FIELDS = f"""ft AS (SELECT 'title' AS field, doc_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS term FROM corpus
  UNION ALL SELECT 'text', doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM corpus),
fk AS (SELECT * FROM ft WHERE term NOT IN {STOP}),
fdl AS (SELECT f.field, c.doc_id, count(k.term) AS dl FROM corpus c CROSS JOIN (VALUES ('title'), ('text')) f(field) LEFT JOIN fk k ON k.doc_id = c.doc_id AND k.field = f.field GROUP BY ALL),
ffs AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM fdl GROUP BY 1),
ftf AS (SELECT field, doc_id, term, count(*) AS tf FROM fk GROUP BY ALL),
fidf AS (SELECT field, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT field, term, count(*) AS df FROM ftf GROUP BY ALL) JOIN ffs USING (field)),
fqt AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM qtok WHERE term NOT IN {STOP} GROUP BY ALL)"""


def _field_scored(name: str, title: float = 1, text: float = 1, terms: str = "fqt", k: int = 10) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(CASE field WHEN 'title' THEN {title} ELSE {text} END * weight * idf * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))), 6) AS score
  FROM {terms} JOIN ftf USING (term) JOIN fidf USING (field, term) JOIN fdl USING (field, doc_id) JOIN ffs USING (field) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= {k})"""


_RUN = "SELECT query_id, doc_id, score, rank FROM "
_VECTOR_RUN = """vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(list_cosine_similarity(vq.v, vc.v), 6) AS score FROM vq, vc) QUALIFY rank <= 10)"""


_INDEXES: dict[tuple, LexicalIndex] = {}


def written_index(spark, sf_dir, tokenizer=T.NO_STEM, fields: tuple[str, ...] | None = None) -> LexicalIndex:
    """The index of a folder's corpus, written once a session and opened by every query on it."""
    key = (spark.sparkContext.applicationId, sf_dir, tokenizer, fields)
    if key not in _INDEXES or not _INDEXES[key].there():
        corpus = X.corpus(spark, sf_dir) if fields else X.single(spark, sf_dir)
        _INDEXES[key] = LexicalIndex.build(corpus, tokenizer, fields)
    return _INDEXES[key]


def _bm25(spark, sf_dir, k1=0.9, b=0.4, tokenizer=T.NO_STEM) -> BM25Retriever:
    return BM25Retriever(k1, b, tokenizer, indexed=written_index(spark, sf_dir, tokenizer))


FIELDS = ("title", "text")


def _multi(spark, sf_dir, weights=None) -> BM25Retriever:
    return BM25Retriever(tokenizer=T.NO_STEM, fields=FIELDS, weights=weights, indexed=written_index(spark, sf_dir, T.NO_STEM, FIELDS))


def _run(spark, sf_dir, k=10, **kw) -> DataFrame:
    return _bm25(spark, sf_dir, **kw).retrieve(X.queries(spark, sf_dir), k)


def _dense_run(spark, sf_dir, k=10) -> DataFrame:
    return vectors.dense_retrieve(X.vec_queries(spark, sf_dir), X.vec_corpus(spark, sf_dir), k)


# ---- text and index -------------------------------------------------------------------------------


@_query(_with(select="SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL"))
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, without stop words or stems taken out."""
    return X.single(spark, sf_dir).select("doc_id", F.explode(T.PLAIN(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@_query(_with(_lex(), select="SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL"))
def tokenize_stopped(spark, sf_dir):
    return X.single(spark, sf_dir).select("doc_id", F.explode(T.NO_STEM(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@_query(_with(select="SELECT query_id, term, count(*) AS n FROM qtok WHERE length(term) >= 4 GROUP BY ALL"))
def min_length_terms(spark, sf_dir):
    return X.queries(spark, sf_dir).select("query_id", F.explode(T.Tokenizer(None, False, 4)(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))


@_query(_with(select="SELECT doc_id, trim(title || ' ' || text) AS document FROM corpus"))
def document_texts(spark, sf_dir):
    return X.corpus(spark, sf_dir).select("doc_id", T.document_text(F.col("title"), F.col("text")).alias("document"))


@_query(_with(_lex(), select="SELECT doc_id, dl FROM dl"))
def doc_lengths(spark, sf_dir):
    return written_index(spark, sf_dir).lengths.select("doc_id", F.col("dl").cast("bigint").alias("dl"))


@_query(_with(_lex(), select="SELECT term, df, round(idf, 6) AS idf FROM idf"))
def term_stats_idf(spark, sf_dir):
    return written_index(spark, sf_dir).term_stats().select("term", "df", F.round("idf", 6).alias("idf"))


@_query(_with(_FIELDS, select="SELECT field, n, round(avgdl, 6) AS avgdl FROM ffs"))
def field_stats(spark, sf_dir):
    return _ints(written_index(spark, sf_dir, T.NO_STEM, FIELDS).field_stats())


# ---- BM25 -----------------------------------------------------------------------------------------


@_query(_with(_lex(), _scored("r"), select=_RUN + "r"))
def bm25_top10(spark, sf_dir):
    """The ten best documents of every query."""
    return _ints(_run(spark, sf_dir))


@_query(_with(_lex(), _scored("r"), select=_RUN + "r"))
def bm25_segments_top10(spark, sf_dir):
    """An index that changed: every document first with its first line for its text, along with the benchmark's own
    passages; then the documents as they are, which replace those, and the passages are deleted."""
    passages = X.queries(spark, sf_dir).select(F.concat(F.lit("passage "), "query_id").alias("doc_id"), F.lit("").alias("title"), "text")
    stale = X.corpus(spark, sf_dir).select("doc_id", F.lit("").alias("title"), F.col("title").alias("text"))
    first = segments.SegmentedBM25(tokenizer=T.NO_STEM).index(stale.unionByName(passages))
    now = first.add(X.single(spark, sf_dir)).delete(passages.select("doc_id"))
    return _ints(now.retrieve(X.queries(spark, sf_dir), 10))


@_query(_with(_lex(), _scored("r", 1.2, 0.75), select=_RUN + "r"))
def bm25_k12_b75(spark, sf_dir):
    return _ints(_run(spark, sf_dir, k1=1.2, b=0.75))


@_query(_with(_lex(), _scored("r", 1.5, 0), select=_RUN + "r"))
def bm25_b0(spark, sf_dir):
    return _ints(_bm25(spark, sf_dir).with_parameters(1.5, 0).retrieve(X.queries(spark, sf_dir), 10))


@_query(_with(_lex(False), _scored("r"), select=_RUN + "r"))
def bm25_no_stopwords(spark, sf_dir):
    return _ints(_run(spark, sf_dir, tokenizer=T.PLAIN))


@_query(_with(_lex(), "wt AS (SELECT query_id, term, weight / length(term) AS weight FROM qt)", _scored("r", terms="wt"), select=_RUN + "r"))
def bm25_weighted_terms(spark, sf_dir):
    terms = query_terms(X.queries(spark, sf_dir), T.NO_STEM).withColumn("weight", F.col("weight") / F.length("term"))
    return _ints(top_k(_bm25(spark, sf_dir).score_weighted_terms(terms), 10))


@_query(_with(_FIELDS, _field_scored("r"), select=_RUN + "r"))
def bm25_multifield(spark, sf_dir):
    return _ints(_multi(spark, sf_dir).retrieve(X.queries(spark, sf_dir), 10))


@_query(_with(_FIELDS, _field_scored("r", 3, 0.5), select=_RUN + "r"))
def bm25_field_weights(spark, sf_dir):
    return _ints(_multi(spark, sf_dir, (3.0, 0.5)).retrieve(X.queries(spark, sf_dir), 10))


@_query()
def bm25_stemmed(spark, sf_dir):
    """BM25 over stems; SQL has no stemmer."""
    return _ints(_run(spark, sf_dir, tokenizer=T.Tokenizer()))


@_query(_with(_lex(), select="""SELECT q.query_id, coalesce(round(max(idf), 6), 0) AS max_idf, coalesce(round(avg(idf), 6), 0) AS mean_idf, count(s.term) AS num_terms, count(idf) AS num_in_vocabulary,
  CASE WHEN count(s.term) = 0 THEN 0 ELSE round((count(s.term) - count(idf)) / count(s.term), 6) END::DOUBLE AS out_of_vocabulary_rate
FROM queries q LEFT JOIN (SELECT * FROM qtok WHERE term NOT IN """ + STOP + """) s USING (query_id) LEFT JOIN idf USING (term) GROUP BY 1"""))
def query_statistics(spark, sf_dir):
    return _ints(_bm25(spark, sf_dir).query_statistics(X.queries(spark, sf_dir)))


# ---- measures -------------------------------------------------------------------------------------




def _dcg(gains: str, ks: tuple = (10, 100)) -> str:
    """Values by query of the run r, as long rows in pq."""
    g = {"exponential": "(pow(2, grade) - 1)", "linear": "grade::DOUBLE"}
    parts = []
    for kind in gains.split():
        for k in ks:
            parts.append(f"""SELECT query_id, '{kind}' AS gain, 'ndcg@{k}' AS metric, coalesce(d / nullif(i, 0), 0) AS value FROM jq LEFT JOIN (
  SELECT query_id, sum({g[kind]} / log2(rank + 1)) AS d FROM hits WHERE rank <= {k} GROUP BY 1) USING (query_id) LEFT JOIN (
  SELECT query_id, sum({g[kind]} / log2(nth + 1)) AS i FROM ideal WHERE nth <= {k} GROUP BY 1) USING (query_id)""")
            parts.append(f"""SELECT query_id, '{kind}' AS gain, 'recall@{k}' AS metric, coalesce(f / nullif(m, 0), 0)::DOUBLE AS value FROM jq LEFT JOIN (
  SELECT query_id, count(*) AS f FROM hits WHERE rank <= {k} GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS m FROM ideal GROUP BY 1) USING (query_id)""")
    return """jq AS (SELECT DISTINCT query_id FROM qrels),
ideal AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS nth FROM qrels WHERE grade > 0),
hits AS (SELECT query_id, rank, grade FROM r JOIN qrels USING (query_id, doc_id) WHERE grade > 0),
pq AS (""" + "\nUNION ALL ".join(parts) + ")"


_EVALUATED = (_lex(), _scored("r", k=100), _dcg("exponential linear"))
_BOTH = ("exponential", "linear")


def _per_query(spark, sf_dir) -> DataFrame:
    return metrics.evaluate_per_query(_run(spark, sf_dir, 100), X.qrels(spark, sf_dir), (10, 100), _BOTH)


@_query(_with(select="SELECT count(*) AS judgements, count(*) FILTER (WHERE grade > 0) AS relevant, count(DISTINCT query_id) AS queries, string_agg(DISTINCT grade::VARCHAR, ',' ORDER BY grade::VARCHAR) AS levels, count(DISTINCT grade) FILTER (WHERE grade > 0) > 1 AS graded FROM qrels"))
def qrels_profile(spark, sf_dir):
    return metrics.qrels_profile(X.qrels(spark, sf_dir)).withColumn("levels", F.array_join(F.array_sort(F.transform("levels", lambda x: x.cast("string"))), ","))


@_query(_with(_lex(), _scored("r", k=100), _dcg("exponential"), select="SELECT query_id, round(value, 6) AS value FROM pq WHERE metric = 'ndcg@10'"))
def ndcg_exp(spark, sf_dir):
    rows = metrics.evaluate_per_query(_run(spark, sf_dir, 100), X.qrels(spark, sf_dir))
    return _ints(rows.where("metric = 'ndcg@10'").select("query_id", "value"))


@_query(_with(*_EVALUATED, select="SELECT query_id, round(value, 6) AS value FROM pq WHERE metric = 'ndcg@10' AND gain = 'linear'"))
def ndcg_linear(spark, sf_dir):
    return _ints(_per_query(spark, sf_dir).where("metric = 'ndcg@10' and gain = 'linear'").select("query_id", "value"))


@_query(_with(*_EVALUATED, select="SELECT query_id, round(value, 6) AS value FROM pq WHERE metric = 'recall@100' AND gain = 'exponential'"))
def recall_at_k(spark, sf_dir):
    return _ints(_per_query(spark, sf_dir).where("metric = 'recall@100' and gain = 'exponential'").select("query_id", "value"))


@_query(_with(*_EVALUATED, select="SELECT query_id, gain, metric, round(value, 6) AS value FROM pq"))
def per_query_long(spark, sf_dir):
    return _ints(_per_query(spark, sf_dir))


@_query(_with(*_EVALUATED, select="SELECT gain, metric, round(avg(value), 6) AS value, count(*) AS num_queries FROM pq GROUP BY ALL"))
def macro_mean(spark, sf_dir):
    return _ints(metrics.macro_mean(_per_query(spark, sf_dir)))


@_query(_with(*_EVALUATED, select="""SELECT metric, round(avg(value) FILTER (WHERE gain = 'exponential'), 6) AS exponential, round(avg(value) FILTER (WHERE gain = 'linear'), 6) AS linear,
  round(avg(value) FILTER (WHERE gain = 'exponential') - avg(value) FILTER (WHERE gain = 'linear'), 6) + 0.0::DOUBLE AS difference FROM pq GROUP BY 1"""))
def gain_difference(spark, sf_dir):
    return _ints(metrics.gain_difference(_per_query(spark, sf_dir)))


@_query(_with(select="SELECT round(avg(least(10, n) / n), 6) AS oracle_recall FROM (SELECT query_id, count(*) AS n FROM qrels WHERE grade > 0 GROUP BY 1)"))
def oracle_recall(spark, sf_dir):
    return _ints(metrics.oracle_recall(X.qrels(spark, sf_dir), 10))


@_query(_with(*_EVALUATED, select="""SELECT dataset, round(value, 6) AS value, published, round(value - published, 6) AS delta, abs(value - published) <= 0.03 AS within
FROM (SELECT avg(value) AS value FROM pq WHERE metric = 'ndcg@10' AND gain = 'exponential'), (VALUES ('scifact', 0.665), ('nfcorpus', 0.325), ('scidocs', 0.158), ('trec-covid', 0.656)) p(dataset, published)""").replace("published, round(value", "published::DOUBLE AS published, round(value"))
def baseline_delta(spark, sf_dir):
    value = metrics.macro_mean(_per_query(spark, sf_dir)).where("metric = 'ndcg@10' and gain = 'exponential'").select("value")
    names = spark.createDataFrame([(n,) for n in metrics.PUBLISHED_NDCG_10], "dataset string")
    return _ints(metrics.baseline_verdict(names.crossJoin(F.broadcast(value))))


# ---- feedback -------------------------------------------------------------------------------------

_FEEDBACK = """w AS (SELECT query_id, doc_id, score / sum(score) OVER (PARTITION BY query_id) AS share FROM fb),
rm AS (SELECT query_id, term, round(sum(share * tf / dl), 10) AS weight FROM w JOIN tf USING (doc_id) JOIN dl USING (doc_id) GROUP BY ALL),
best AS (SELECT * FROM rm WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) <= 10),
model AS (SELECT query_id, term, weight / sum(weight) OVER (PARTITION BY query_id) AS weight FROM best),
mixed AS (SELECT query_id, term, sum(weight) AS weight FROM (
  SELECT query_id, term, (CASE WHEN query_id IN (SELECT query_id FROM model) THEN 0.5 ELSE 1 END) * weight / sum(weight) OVER (PARTITION BY query_id) AS weight FROM qt
  UNION ALL SELECT query_id, term, 0.5 * weight FROM model) GROUP BY ALL)"""
_RM3 = (_lex(), _scored("fb"), _FEEDBACK)


def _rm3(spark, sf_dir, **kw) -> RM3Retriever:
    scorer = _multi(spark, sf_dir) if kw.get("multi_field") else _bm25(spark, sf_dir)
    return RM3Retriever(tokenizer=T.NO_STEM, scorer=scorer, harvested=written_index(spark, sf_dir), **kw)


@_query(_with(*_RM3, select="SELECT query_id, term, round(weight, 6) AS weight FROM model"))
def rm3_relevance_model(spark, sf_dir):
    r = _rm3(spark, sf_dir)
    return _ints(r.relevance_model(r.scorer.retrieve(X.queries(spark, sf_dir), r.fb_docs)))


@_query(_with(*_RM3, select="SELECT query_id, term, round(weight, 6) AS weight FROM mixed"))
def rm3_expanded_query(spark, sf_dir):
    return _ints(_rm3(spark, sf_dir).expanded_queries(X.queries(spark, sf_dir)))


@_query(_with(*_RM3, _scored("r", terms="mixed"), select=_RUN + "r"))
def rm3_top10(spark, sf_dir):
    return _ints(_rm3(spark, sf_dir).retrieve(X.queries(spark, sf_dir), 10))


@_query(_with(_lex(), _FIELDS, _field_scored("fb"), _FEEDBACK, _field_scored("r", terms="mixed"), select=_RUN + "r"))
def rm3_multifield(spark, sf_dir):
    return _ints(_rm3(spark, sf_dir, multi_field=True).retrieve(X.queries(spark, sf_dir), 10))


@_query(_with(_lex(), "own AS (SELECT query_id, term, weight / sum(weight) OVER (PARTITION BY query_id) AS weight FROM qt)", _scored("r", terms="own"), select=_RUN + "r"))
def rm3_alpha0(spark, sf_dir):
    return _ints(_rm3(spark, sf_dir).with_parameters(alpha=0.0).retrieve(X.queries(spark, sf_dir), 10))


# ---- vectors --------------------------------------------------------------------------------------


@_query(_with(_VECTOR_RUN, select=_RUN + "vr"))
def dense_cosine_top10(spark, sf_dir):
    return _ints(_dense_run(spark, sf_dir))


@_query(_with(select="""SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, max(round(list_cosine_similarity(vq.v, vg.v), 6)) AS score FROM vq, vg GROUP BY ALL) QUALIFY rank <= 10"""))
def dense_maxp(spark, sf_dir):
    """Documents of four chunks each, scored by the best one."""
    return _ints(vectors.dense_retrieve(X.vec_queries(spark, sf_dir), X.vec_groups(spark, sf_dir), 10))


@_query(_with(_VECTOR_RUN, select="SELECT query_id, count(*) FILTER (WHERE vq.label = vc.label) AS relevant FROM vr JOIN vq USING (query_id) JOIN vc USING (doc_id) GROUP BY 1"))
def dense_relevant(spark, sf_dir):
    rows = _dense_run(spark, sf_dir).join(X.vec_queries(spark, sf_dir).select("query_id", F.col("label").alias("q")), "query_id").join(X.vec_corpus(spark, sf_dir).select("doc_id", "label"), "doc_id")
    return rows.groupBy("query_id").agg(F.count_if(F.col("q") == F.col("label")).alias("relevant"))


def _windows(size: int, stride: int) -> str:
    return _with(f"w AS (SELECT doc_id, list_filter(string_split_regex(whole, '\\s+'), lambda x: x <> '') AS w FROM corpus)", select=f"""SELECT doc_id, i AS chunk_no, md5(array_to_string(w[i * {stride} + 1 : i * {stride} + {size}], ' ')) AS chunk
FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= {size} THEN 1 ELSE (len(w) - 1) // {stride} + 1 END)) AS i FROM w)""")


def _chunked(spark, sf_dir, size: int, overlap: int) -> DataFrame:
    rows = X.single(spark, sf_dir).select("doc_id", F.posexplode(T.chunks(F.col("text"), size, overlap)).alias("chunk_no", "chunk"))
    return _ints(rows.select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("chunk")))


@_query(_windows(200, 200))
def chunk_windows(spark, sf_dir):
    return _chunked(spark, sf_dir, 200, 0)


@_query(_windows(120, 80))
def chunk_overlap(spark, sf_dir):
    return _chunked(spark, sf_dir, 120, 40)


@_query(_with(select="SELECT round(avg(CASE WHEN n + 1 > 256 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT doc_id, len(regexp_extract_all(lower(whole), '[a-z0-9]+')) AS n FROM corpus)"))
def truncation_rate(spark, sf_dir):
    return _ints(X.single(spark, sf_dir).agg(T.truncation_rate(T.PLAIN(F.col("text")), 256).alias("rate")))


_SPARSE = """sd AS (SELECT doc_id, i - 1 AS term_id, round(max(ln(1 + greatest(x, 0))), 6) AS weight FROM (SELECT doc_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM vg) GROUP BY ALL HAVING weight > 0),
sq AS (SELECT query_id, i - 1 AS term_id, round(max(ln(1 + greatest(x, 0))), 6) AS weight FROM (SELECT query_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM vqg) GROUP BY ALL HAVING weight > 0)"""


@_query(_with(_SPARSE, select="SELECT doc_id, term_id, weight FROM sd"))
def sparse_encode(spark, sf_dir):
    return _ints(vectors.sparse_encode(X.vec_groups(spark, sf_dir)))


@_query(_with(_SPARSE, select="SELECT doc_id, term_id, weight FROM sd QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term_id) <= 8"))
def sparse_top_terms(spark, sf_dir):
    return _ints(vectors.sparse_encode(X.vec_groups(spark, sf_dir), 8))


@_query(_with(_SPARSE, select="SELECT round(avg(n), 6) AS mean_terms FROM (SELECT doc_id, count(*) AS n FROM sd GROUP BY 1)"))
def sparse_mean_terms(spark, sf_dir):
    return _ints(vectors.mean_terms(vectors.sparse_encode(X.vec_groups(spark, sf_dir))))


@_query(_with(_SPARSE, select="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(sq.weight * sd.weight), 6) AS score FROM sq JOIN sd USING (term_id) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 10"""))
def sparse_dot_top10(spark, sf_dir):
    return _ints(vectors.sparse_retrieve(vectors.sparse_encode(X.vec_query_groups(spark, sf_dir), key="query_id"), vectors.sparse_encode(X.vec_groups(spark, sf_dir)), 10))


@_query(_with(select="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(m), 6) AS score FROM (SELECT query_id, vqg.pos, doc_id, max(list_dot_product(vqg.v, vg.v)) AS m FROM vqg, vg GROUP BY ALL) GROUP BY ALL) QUALIFY rank <= 10"""))
def maxsim_top10(spark, sf_dir):
    return _ints(vectors.maxsim_retrieve(X.vec_query_groups(spark, sf_dir), X.vec_groups(spark, sf_dir), 10))


_LENGTH = 180
_IDS = f"""ids AS (SELECT doc_id, list_concat([1::BIGINT, 3::BIGINT], list_transform(regexp_extract_all(lower(whole), '[a-z0-9]+|[.,;]'),
  lambda t: CASE t WHEN '.' THEN 5 WHEN ',' THEN 6 WHEN ';' THEN 7 ELSE ('0x' || substr(md5(t), 1, 6))::BIGINT % 20000 + 10 END)[1:{_LENGTH - 3}], [2::BIGINT]) AS ids FROM corpus),
p AS (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM ids),
v AS (SELECT doc_id, pos, {", ".join(f"{X.SeededModel.projected_sql(d)} AS x{d}" for d in range(X.SeededModel.dimensions))} FROM p WHERE id NOT IN (5, 6, 7))"""
_NORM = "sqrt(" + " + ".join(f"x{d} * x{d}" for d in range(X.SeededModel.dimensions)) + ")"


_ASKED = 32


@_query(_with(_IDS.split("p AS")[0].replace("3::BIGINT", "9::BIGINT").replace(f"[1:{_LENGTH - 3}]", f"[1:{_ASKED - 3}]") + f"f AS (SELECT doc_id, list_resize(ids, {_ASKED}, 0) AS ids FROM ids)",
  select="""SELECT doc_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i = 2 THEN 8 WHEN x = 0 THEN 4 ELSE x END), ' ') AS query_ids,
  array_to_string(list_transform(ids, lambda x: CASE WHEN x IN (0, 5, 6, 7) THEN '0' ELSE '1' END), '') AS kept FROM f"""))
def colbert_prepare_ids(spark, sf_dir):
    """Every document's first tokens prepared as a query's, with a marker and mask tokens, and which of them count in a
    document: neither padding nor punctuation."""
    m = X.SeededModel
    words = F.slice(F.regexp_extract_all(F.lower("whole"), F.lit("[a-z0-9]+|[.,;]"), F.lit(0)), 1, _ASKED - 3)
    number = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 6), 16, 10).cast("int") % 20000 + 10
    tokens = F.transform(words, lambda w: F.when(w == ".", 5).when(w == ",", 6).when(w == ";", 7).otherwise(number(w)))
    ids = F.concat(F.array(F.lit(m.cls), F.lit(9)), tokens, F.array(F.lit(m.sep)))
    rows = X.corpus(spark, sf_dir).select("doc_id", F.concat(ids, F.array_repeat(F.lit(m.pad), _ASKED - F.size(ids))).alias("ids"))
    rows = rows.withColumn("mask", F.transform("ids", lambda x: (x != m.pad).cast("int")))
    query, _ = T.prepared_ids(F.col("ids"), F.col("mask"), m.query_marker, m.pad, m.mask, True)
    _, kept = T.prepared_ids(F.col("ids"), F.col("mask"), m.document_marker, m.pad, m.mask, False, m.skipped)
    return rows.select("doc_id", F.array_join(F.transform(query, lambda x: x.cast("string")), " ").alias("query_ids"), F.array_join(F.transform(kept, lambda k: F.when(k, "1").otherwise("0")), "").alias("kept"))


def _token_encoder() -> encoding.LateInteractionEncoder:
    m = X.SeededModel
    return encoding.LateInteractionEncoder(encoding.Spec(m, "seeded", _LENGTH), m.projection(), m.query_marker, m.document_marker, skipped=m.skipped)


@_query(_with(_IDS, select=f"SELECT doc_id, pos, {', '.join(f'round(x{d} / {_NORM}, 6) AS v{d}' for d in range(X.SeededModel.dimensions))} FROM v"))
def token_vectors(spark, sf_dir):
    """Projected unit vectors of the positions of every document: marker, tokens to the model's length, no punctuation."""
    rows = _token_encoder().encode_tokens(X.corpus(spark, sf_dir).select("doc_id", F.col("whole").alias("text")))
    return _ints(rows.select("doc_id", F.col("pos").cast("long"), *(F.get("embedding", d).alias(f"v{d}") for d in range(X.SeededModel.dimensions))))


_HIDDEN = [f"((id * {j + 1} * 7919 + {(j + 1) * 104729}) % 1009) / 1009.0::DOUBLE - 0.5" for j in range(X.SeededModel.width)]
_MEANS = _IDS.split("p AS")[0].replace("[1::BIGINT, 3::BIGINT]", "[1::BIGINT]").replace(f"{_LENGTH - 3}]", f"{_LENGTH - 2}]") + f"""p AS (SELECT doc_id, unnest(ids) AS id FROM ids),
m AS (SELECT doc_id, {", ".join(f"avg({h}) AS x{j}" for j, h in enumerate(_HIDDEN))} FROM p GROUP BY 1)"""


@_query(_with(_MEANS, select=f"SELECT doc_id, {', '.join(f'round(x{j} / sqrt(' + ' + '.join(f'x{i} * x{i}' for i in range(8)) + f'), 6) AS v{j}' for j in range(8))}, CASE WHEN doc_id::BIGINT % 100 = 0 THEN 2 ELSE 1 END AS version FROM m"))
def incremental_embeddings(spark, sf_dir):
    """Embeddings of all documents from a store that had them when a hundredth of them had another text: the second
    update encodes those only."""
    now = X.corpus(spark, sf_dir).select("doc_id", F.col("whole").alias("text"))
    changed = F.col("doc_id").cast("long") % X.EVERY == 0
    store = embeddings.EmbeddingStore(spark, physical.shared_folder(spark, "embeddings"), {"model": "seeded", "max_tokens": _LENGTH})
    encoder = encoding.MeanEncoder(encoding.Spec(X.SeededModel, "seeded", _LENGTH))
    store.update(now.withColumn("text", F.when(changed, F.concat(F.lit("before. "), "text")).otherwise(F.col("text"))), encoder)
    rows = store.update(now, encoder)
    return _ints(rows.select("doc_id", *(F.get("embedding", j).alias(f"v{j}") for j in range(X.SeededModel.width)), "version"))


# ---- fusion, reranking, routing -------------------------------------------------------------------

_TWO = (_lex(), _scored("a", k=50), _scored("b", 1.5, 0.9, k=50))


def _fused(k: float, wa: float, wb: float, top: int = 10) -> str:
    return f"""f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(p), 9) AS score FROM (SELECT query_id, doc_id, {float(wa)} / ({float(k)} + rank) AS p FROM a WHERE {wa} <> 0 UNION ALL SELECT query_id, doc_id, {float(wb)} / ({float(k)} + rank) FROM b WHERE {wb} <> 0) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= {top})"""


def _two(spark, sf_dir, k=50) -> list[DataFrame]:
    r = _bm25(spark, sf_dir)
    q = X.queries(spark, sf_dir)
    return [r.retrieve(q, k), r.with_parameters(1.5, 0.9).retrieve(q, k)]


_ROUNDED_RUN = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM "


@_query(_with(*_TWO, _fused(60, 1, 1), select=_ROUNDED_RUN + "f"))
def rrf_two(spark, sf_dir):
    return _ints(combine.reciprocal_rank_fusion(_two(spark, sf_dir), top=10))


@_query(_with(*_TWO, _fused(5, 1, 3), select=_ROUNDED_RUN + "f"))
def rrf_weighted(spark, sf_dir):
    return _ints(combine.reciprocal_rank_fusion(_two(spark, sf_dir), 5, 10, [1, 3]))


@_query(_with(*_TWO, _fused(0, 1, 0), select=_ROUNDED_RUN + "f"))
def rrf_zero_weight(spark, sf_dir):
    return _ints(combine.reciprocal_rank_fusion(_two(spark, sf_dir), 0, 10, [1, 0]))


@_query(_with(_lex(), _scored("r", k=30), """h AS (SELECT query_id, doc_id, rank, CASE WHEN rank <= 10 THEN CASE WHEN contains(c.whole, q.text) THEN 1 ELSE -1 END + round(1.0 / length(c.whole), 6) END AS new FROM r JOIN corpus c USING (doc_id) JOIN queries q USING (query_id)),
s AS (SELECT query_id, doc_id, CASE WHEN rank <= 10 THEN round(new, 6) ELSE min(round(new, 6)) OVER (PARTITION BY query_id) - (rank - 10) END AS score FROM h)""", select="SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s"))
def rerank_depth(spark, sf_dir):
    """The first ten reranked by a rule, the rest below them."""
    rule = F.when(F.contains("text", "query_text"), 1).otherwise(-1) + F.round(1.0 / F.length("text"), 6)
    return _ints(combine.rerank(_run(spark, sf_dir, 30), X.queries(spark, sf_dir), X.single(spark, sf_dir), rule, 10))


_STATS = f"st AS (SELECT q.query_id, coalesce(round(max(idf), 6), 0) AS max_idf FROM queries q LEFT JOIN (SELECT * FROM qtok WHERE term NOT IN {STOP}) s USING (query_id) LEFT JOIN idf USING (term) GROUP BY 1)"


def _stats(spark, sf_dir) -> DataFrame:
    return _bm25(spark, sf_dir).query_statistics(X.queries(spark, sf_dir)).withColumn("max_idf", F.round("max_idf", 6)).cache()  # a row a query


_ASSIGNED = "asg AS (SELECT query_id, CASE WHEN max_idf >= 5 THEN 'a' ELSE 'b' END AS system FROM st)"


@_query(_with(_lex(), _STATS, _ASSIGNED, select="SELECT * FROM asg"))
def route_threshold(spark, sf_dir):
    return combine.threshold_assignment(_stats(spark, sf_dir), "max_idf", 5, "a", "b")


@_query(_with(*_TWO, _STATS, _ASSIGNED, select="SELECT query_id, doc_id, score, rank FROM a JOIN asg USING (query_id) WHERE system = 'a' AND rank <= 50 UNION ALL SELECT query_id, doc_id, score, rank FROM b JOIN asg USING (query_id) WHERE system = 'b'"))
def route_runs(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return _ints(combine.route({"a": a, "b": b}, combine.threshold_assignment(_stats(spark, sf_dir), "max_idf", 5, "a", "b")))


def _ndcg_of(run: str) -> str:
    return f"""SELECT query_id, '{run}' AS system, round(coalesce(d / nullif(i, 0), 0), 6) AS value FROM (SELECT DISTINCT query_id FROM qrels)
  LEFT JOIN (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS d FROM {run} JOIN qrels USING (query_id, doc_id) WHERE grade > 0 AND rank <= 10 GROUP BY 1) USING (query_id)
  LEFT JOIN (SELECT query_id, sum((pow(2, grade) - 1) / log2(nth + 1)) AS i FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS nth FROM qrels WHERE grade > 0) WHERE nth <= 10 GROUP BY 1) USING (query_id)"""


_SYSTEMS = f"sys AS ({_ndcg_of('a')}\nUNION ALL {_ndcg_of('b')})"


def _systems(spark, sf_dir) -> DataFrame:
    q = X.qrels(spark, sf_dir)
    rows = [metrics.evaluate_per_query(r, q, (10,)).where("metric = 'ndcg@10'").select("query_id", F.lit(s).alias("system"), F.round("value", 6).alias("value")) for s, r in zip("ab", _two(spark, sf_dir), strict=True)]
    return rows[0].unionByName(rows[1]).cache()  # a value a query, read several times by a test


def _pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = _systems(spark, sf_dir)
    return tuple(s.where(F.col("system") == x).select("query_id", "value") for x in "ab")


@_query(_with(*_TWO, _SYSTEMS, select="SELECT query_id, system, value FROM sys QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, system) = 1"))
def route_oracle(spark, sf_dir):
    return combine.oracle_assignment(_systems(spark, sf_dir))


@_query(_with(*_TWO, select="SELECT query_id, count(b.doc_id) AS shared FROM a LEFT JOIN (SELECT * FROM b WHERE rank <= 10) b USING (query_id, doc_id) WHERE a.rank <= 10 GROUP BY 1"))
def overlap_at_k(spark, sf_dir):
    return combine.overlap(*_two(spark, sf_dir), 10)


# ---- tests between systems ------------------------------------------------------------------------

_TEST_COLUMNS = "round(o / n, 6) AS delta, round({p}, 6) AS p_value, n, '{m}' AS method, {r}::BIGINT AS assignments, {s}::BIGINT AS seed, ties, n - ties AS effective_queries"


@_query(_with("s AS (SELECT (vec_id % 13) AS i, avg(embedding[1] - embedding[2])::DOUBLE AS d FROM embeddings GROUP BY 1)", """o AS (SELECT sum(d) AS o, count(*) AS n, count(*) FILTER (WHERE d = 0) AS ties FROM s),
m AS (SELECT m, sum(d * (1 - 2 * ((m >> i) & 1))) AS s FROM s, range(0, (1 << 13)) AS g(m) GROUP BY 1)""", select="SELECT " + _TEST_COLUMNS.format(p="c / t", m="exact", r="t", s="NULL") + " FROM o, (SELECT count(*) FILTER (WHERE abs(s) + 1e-12 * greatest(1, abs(o)) >= abs(o)) AS c, count(*) AS t FROM m, o)"))
def paired_exact(spark, sf_dir):
    """Exact test over thirteen groups of all vectors: two means a group."""
    rows = X.table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 13).alias("i")).agg(F.avg(F.col("embedding")[0] - F.col("embedding")[1]).alias("d"))
    return _ints(significance.paired_exact(rows.select(F.format_string("%02d", "i").alias("query_id"), F.col("d").alias("a"), F.lit(0.0).alias("b"))))


@_query(_with(*_TWO, _SYSTEMS, """d AS (SELECT a.query_id, a.value - b.value AS d FROM sys a JOIN sys b USING (query_id) WHERE a.system = 'a' AND b.system = 'b'),
o AS (SELECT sum(d) AS o, count(*) AS n, count(*) FILTER (WHERE d = 0) AS ties FROM d),
m AS (SELECT r, sum(CASE WHEN substr(md5('0:' || r || ':' || query_id), 1, 1) < '8' THEN d ELSE -d END) AS s FROM d, range(0, 10000) AS g(r) GROUP BY 1)""", select="SELECT " + _TEST_COLUMNS.format(p="least(1, (c + 1) / 10001.0)", m="monte-carlo", r="10000", s="0") + " FROM o, (SELECT count(*) FILTER (WHERE abs(s) + 1e-12 * greatest(1, abs(o)) >= abs(o)) AS c FROM m, o)"))
def paired_mc_portable(spark, sf_dir):
    return _ints(significance.paired_sampled(significance.aligned(*_pairs(spark, sf_dir))))


@_query(_with(*_TWO, _SYSTEMS, """d AS (SELECT a.query_id, a.value - b.value AS d, row_number() OVER (ORDER BY a.query_id) - 1 AS i FROM sys a JOIN sys b USING (query_id) WHERE a.system = 'a' AND b.system = 'b'),
o AS (SELECT sum(d) AS o, count(*) AS n, count(*) FILTER (WHERE d = 0) AS ties FROM d),
e AS (SELECT m, sum(d * (1 - 2 * ((m >> i) & 1))) AS s FROM d, o, range(0, (1 << 16)) AS g(m) WHERE n <= 16 AND m < (1 << least(n, 16)) GROUP BY 1),
m AS (SELECT r, sum(CASE WHEN substr(md5('0:' || r || ':' || query_id), 1, 1) < '8' THEN d ELSE -d END) AS s FROM d, o, range(0, 10000) AS g(r) WHERE n > 16 GROUP BY 1),
h AS (SELECT count(*) FILTER (WHERE abs(s) + 1e-12 * greatest(1, abs(o)) >= abs(o)) AS c, count(*) AS t FROM (SELECT s FROM e UNION ALL SELECT s FROM m), o)""", select="SELECT round(o / n, 6) AS delta, round(CASE WHEN n <= 16 THEN c / t ELSE least(1, (c + 1) / 10001.0) END, 6) AS p_value, n, CASE WHEN n <= 16 THEN 'exact' ELSE 'monte-carlo' END AS method, t::BIGINT AS assignments, CASE WHEN n > 16 THEN 0 END::BIGINT AS seed, ties, n - ties AS effective_queries FROM o, h"))
def paired_test(spark, sf_dir):
    """Test over all queries: all sign vectors of few, draws of many."""
    return _ints(significance.paired_test(*_pairs(spark, sf_dir)))


@_query(_with("st AS (SELECT doc_id, length(title) AS x FROM corpus)", select="SELECT doc_id, round(rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0, 6)::DOUBLE AS avg_rank FROM st"))
def average_ranks(spark, sf_dir):
    rows = X.corpus(spark, sf_dir).select("doc_id", F.length("title").alias("x"))
    return _ints(physical.average_ranks(rows, "x", "avg_rank").select("doc_id", "avg_rank"))


_XY = "xy AS (SELECT st.query_id, max_idf AS x, value AS y FROM st JOIN sys USING (query_id) WHERE system = 'a'), rk AS (SELECT query_id, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, row_number() OVER (ORDER BY query_id) AS i FROM xy)"
_RHO = "coalesce((count(*) * sum(rx * ry) - sum(rx) * sum(ry)) / nullif(sqrt((count(*) * sum(rx * rx) - sum(rx) * sum(rx)) * (count(*) * sum(ry * ry) - sum(ry) * sum(ry))), 0), 0)"


def _xy(spark, sf_dir) -> DataFrame:
    return _stats(spark, sf_dir).select("query_id", F.col("max_idf").alias("x")).join(_pairs(spark, sf_dir)[0].withColumnRenamed("value", "y"), "query_id")


@_query(_with(*_TWO, _STATS, _SYSTEMS, _XY, select=f"SELECT round({_RHO}, 6) AS rho, count(*) AS n FROM rk"))
def spearman(spark, sf_dir):
    return _ints(significance.spearman(_xy(spark, sf_dir)))


@_query(_with(*_TWO, _STATS, _SYSTEMS, _XY, f"""w AS (SELECT count(*) AS n, {_RHO} AS rho, sum(rx) * sum(ry) / count(*) AS centre, sum(rx * ry) AS sxy FROM rk),
sh AS (SELECT r, ry, row_number() OVER (PARTITION BY r ORDER BY md5('0:' || r || ':' || query_id), query_id) AS i FROM rk, range(0, 10000) AS g(r)),
m AS (SELECT r, sum(rk.rx * sh.ry) AS s FROM sh JOIN rk USING (i) GROUP BY 1)""", select="SELECT round(rho, 6) AS rho, round((count(*) FILTER (WHERE abs(s - centre) + 1e-9 >= abs(sxy - centre)) + 1) / 10001.0, 6) AS p_value, n FROM m, w GROUP BY rho, n"))
def perm_corr_portable(spark, sf_dir):
    return _ints(significance.correlation_test(_xy(spark, sf_dir)))


@_query()
def paired_numpy(spark, sf_dir):
    """The paired test with the signs of NumPy's generator, as published p-values have them; SQL has no such stream."""
    return _ints(significance.numpy_paired_test(significance.aligned(*_pairs(spark, sf_dir))))


@_query()
def perm_corr_numpy(spark, sf_dir):
    """The correlation test with the shuffles of NumPy's generator."""
    return _ints(significance.numpy_correlation_test(_xy(spark, sf_dir)))


_ADV = "adv AS (SELECT st.query_id, max_idf AS predictor, a.value - b.value AS advantage FROM st JOIN sys a USING (query_id) JOIN sys b USING (query_id) WHERE a.system = 'a' AND b.system = 'b')"


@_query(_with(*_TWO, _STATS, _SYSTEMS, _ADV, select="SELECT tercile, count(*) AS n, round(min(predictor), 6) AS low, round(max(predictor), 6) AS high, round(avg(advantage), 6) AS mean_advantage FROM (SELECT *, ntile(3) OVER (ORDER BY predictor, query_id) AS tercile FROM adv) GROUP BY 1"))
def terciles(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    rows = significance.aligned(a, b).join(_stats(spark, sf_dir), "query_id").select("query_id", F.col("max_idf").alias("predictor"), (F.col("a") - F.col("b")).alias("advantage"))
    return _ints(significance.terciles(rows))


def _pair_sql(i: int, x: str, y: str) -> str:
    return f"""d{i} AS (SELECT a.query_id, a.value - b.value AS d FROM sys a JOIN sys b USING (query_id) WHERE a.system = '{x}' AND b.system = '{y}'),
o{i} AS (SELECT sum(d) AS o, count(*) AS n FROM d{i}),
m{i} AS (SELECT r, sum(CASE WHEN substr(md5('0:' || r || ':' || query_id), 1, 1) < '8' THEN d ELSE -d END) AS s FROM d{i}, range(0, 10000) AS g(r) GROUP BY 1),
t{i} AS (SELECT {i} AS position, '{x}' AS first, '{y}' AS second, any_value(o) / any_value(n) AS delta, least(1, (count(*) FILTER (WHERE abs(s) + 1e-12 * greatest(1, abs(o)) >= abs(o)) + 1) / 10001.0) AS p FROM m{i}, o{i})"""


_THREE = (*_TWO, _scored("c", 0.6, 0.1, k=50), f"sys AS ({_ndcg_of('a')}\nUNION ALL {_ndcg_of('b')}\nUNION ALL {_ndcg_of('c')})")


_COMPARED = (*_THREE, *(_pair_sql(i, x, y) for i, (x, y) in enumerate((("a", "b"), ("a", "c"), ("b", "c")))), "tt AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)")
_STEPPED = "round(least(1, max(step) OVER (ORDER BY p, position ROWS UNBOUNDED PRECEDING)), 6) AS adjusted\nFROM (SELECT *, (3 - row_number() OVER (ORDER BY p, position) + 1) * p AS step FROM tt)"


def _compared(spark, sf_dir) -> DataFrame:
    r, q, judged = _bm25(spark, sf_dir), X.queries(spark, sf_dir), X.qrels(spark, sf_dir)
    values = {s: metrics.evaluate_per_query(r.with_parameters(*p).retrieve(q, 50), judged, (10,)).where("metric = 'ndcg@10'").select("query_id", F.round("value", 6).alias("value")).cache() for s, p in (("a", (0.9, 0.4)), ("b", (1.5, 0.9)), ("c", (0.6, 0.1)))}
    return significance.compare_family(values)


@_query(_with(*_COMPARED, select=f"SELECT first, second, round(delta, 6) AS delta, round(p, 6) AS p_value, {_STEPPED}"))
def compare_runs(spark, sf_dir):
    """Three systems, every pair of them, corrected together."""
    return _ints(_compared(spark, sf_dir))


@_query(_with(*_COMPARED, select=f"SELECT first || second AS position, round(p, 6) AS p, {_STEPPED}"))
def holm(spark, sf_dir):
    """Holm's correction of the p-values of three systems' comparisons."""
    p = physical.written(_compared(spark, sf_dir).select(F.concat("first", "second").alias("position"), F.col("p_value").alias("p")), "tests")
    return _ints(significance.holm(p))


_FULL_STATS = f"""st AS (SELECT q.query_id, coalesce(max(idf), 0) AS max_idf, coalesce(avg(idf), 0) AS mean_idf, count(s.term)::DOUBLE AS num_terms, coalesce((count(s.term) - count(idf)) / nullif(count(s.term), 0), 0) AS out_of_vocabulary_rate
  FROM queries q LEFT JOIN (SELECT * FROM qtok WHERE term NOT IN {STOP}) s USING (query_id) LEFT JOIN idf USING (term) GROUP BY 1)"""


def _dependence_sql(i: int, c: str, n: int = 20_000) -> str:
    return f"""rk{i} AS (SELECT query_id, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY advantage) + (count(*) OVER (PARTITION BY advantage) - 1) / 2.0 AS ry, row_number() OVER (ORDER BY query_id) AS i FROM (SELECT query_id, round({c}, 6) AS x, advantage FROM st JOIN adv USING (query_id))),
w{i} AS (SELECT count(*) AS n, count(DISTINCT rx) = 1 OR count(DISTINCT ry) = 1 AS flat, {_RHO} AS rho, sum(rx) * sum(ry) / count(*) AS centre, sum(rx * ry) AS sxy FROM rk{i}),
m{i} AS (SELECT r, sum(k.rx * s.ry) AS s FROM (SELECT r, ry, row_number() OVER (PARTITION BY r ORDER BY md5('0:' || r || ':' || query_id), query_id) AS i FROM rk{i}, range(0, {n}) AS g(r)) s JOIN rk{i} k USING (i) GROUP BY 1),
c{i} AS (SELECT {i} AS position, '{c}' AS predictor, any_value(rho) AS rho, CASE WHEN any_value(flat) THEN 1 ELSE (count(*) FILTER (WHERE abs(s - centre) + 1e-9 >= abs(sxy - centre)) + 1) / ({n} + 1.0) END AS p FROM m{i}, w{i})"""


def _dependence(n: int) -> tuple[str, ...]:
    parts = (_dependence_sql(i, c, n) for i, c in enumerate((significance.PRIMARY, *significance.SECONDARY)))
    return *_TWO, _FULL_STATS, _SYSTEMS, "adv AS (SELECT a.query_id, round(a.value - b.value, 6) AS advantage FROM sys a JOIN sys b USING (query_id) WHERE a.system = 'a' AND b.system = 'b')", *parts, "tt AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3)"


def _dependent(spark, sf_dir, n: int) -> DataFrame:
    stats = _bm25(spark, sf_dir).query_statistics(X.queries(spark, sf_dir))
    stats = stats.cache().select("query_id", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in (significance.PRIMARY, *significance.SECONDARY)))
    advantage = significance.aligned(*_pairs(spark, sf_dir)).select("query_id", F.round(F.col("a") - F.col("b"), 6).alias("advantage"))
    return significance.query_dependence(stats, physical.written(advantage, "advantage"), n)


@_query(_with(*_dependence(20_000), select="""SELECT predictor, round(rho, 6) AS rho, round(p, 6) AS p_value, round(CASE position WHEN 0 THEN p ELSE least(1, max(step) OVER (PARTITION BY position > 0 ORDER BY p, position ROWS UNBOUNDED PRECEDING)) END, 6) AS adjusted
FROM (SELECT *, (3 - row_number() OVER (PARTITION BY position > 0 ORDER BY p, position) + 1) * p AS step FROM tt)"""))
def query_dependence(spark, sf_dir):
    """How a system's advantage goes with predictors of the query."""
    return _ints(_dependent(spark, sf_dir, 20_000))


@_query(_with(*_dependence(1_000), select="SELECT bool_and(rho > 0) AS all_positive, count(*) FILTER (WHERE p < 0.05) AS significant, round(min(rho), 6) AS min_rho, round(max(rho), 6) AS max_rho, round(quantile_cont(rho, 0.5), 6) AS median_rho FROM tt"))
def family_summary(spark, sf_dir):
    """The tests of :func:`query_dependence`, of fewer shuffles, as one family."""
    return _ints(significance.family_summary(_dependent(spark, sf_dir, 1_000).select("rho", F.col("p_value").alias("p"))))


# ---- expansion ------------------------------------------------------------------------------------

_PASSAGE = "qp AS (SELECT query_id, q.text, trim(coalesce(generations[1], '')) AS p, generations FROM queries q LEFT JOIN expansions e ON e.id = q.query_id)"


def _expanded(weight: int) -> str:
    return _with(_PASSAGE, select=f"SELECT query_id, CASE WHEN p = '' THEN text ELSE trim(repeat(text || ' ', {weight}) || p) END AS text FROM qp")


@_query(_expanded(0))
def expand_queries_w0(spark, sf_dir):
    return expansion.expand_queries(X.queries(spark, sf_dir), X.expansions(spark, sf_dir), 0)


@_query(_expanded(2))
def expand_queries_w2(spark, sf_dir):
    return expansion.expand_queries(X.queries(spark, sf_dir), X.expansions(spark, sf_dir), 2)


@_query(_with("g AS (SELECT c.doc_id, c.title, c.whole, list_filter(list_transform(coalesce(generations, []), lambda x: trim(x)), lambda x: x <> '') AS g FROM corpus c LEFT JOIN expansions e ON e.id = c.doc_id)", select="SELECT doc_id, md5(CASE WHEN len(g) = 0 THEN whole ELSE whole || ' ' || array_to_string(g, ' ') END) AS text FROM g"))
def expand_documents(spark, sf_dir):
    return expansion.expand_documents(X.single(spark, sf_dir), X.expansions(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


_TERMS = f"list_filter(regexp_extract_all(lower({{x}}), '[a-z0-9]+'), lambda x: NOT list_contains([{', '.join(repr(w) for w in T.STOPWORDS)}], x))"


@_query(_with(_PASSAGE, select=f"""SELECT query_id, array_to_string(list_sort(list_distinct(list_filter({_TERMS.format(x='p')}, lambda x: NOT list_contains({_TERMS.format(x='text')}, x)))), ' ') AS added FROM qp"""))
def added_terms(spark, sf_dir):
    rows = X.queries(spark, sf_dir).join(X.expansions(spark, sf_dir).select(F.col("id").alias("query_id"), F.get("generations", F.lit(0)).alias("p")), "query_id", "left")
    return rows.select("query_id", F.array_join(F.array_sort(T.added_terms(F.col("text"), F.coalesce("p", F.lit("")))), " ").alias("added"))


def _spread_sql(c: str) -> str:
    """Quartiles, mean and range of a number over the expansions that are there; 0 without any."""
    parts = [f"coalesce(round(quantile_cont({c}, {p}) FILTER (WHERE made), 6), 0)::DOUBLE AS {c}_{n}" for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))]
    return ", ".join([*parts, f"coalesce(round(avg({c}) FILTER (WHERE made), 4), 0)::DOUBLE AS {c}_mean", f"coalesce(min({c}) FILTER (WHERE made), 0) AS {c}_min", f"coalesce(max({c}) FILTER (WHERE made), 0) AS {c}_max"])


# Words are counted in the raw text, terms as sets of rows: nothing here follows the Spark plan.
_EXPANSIONS_OF = """ex AS (SELECT q.query_id, q.text, g.text AS generation FROM queries q LEFT JOIN (SELECT id, unnest(generations) AS text FROM expansions) g ON g.id = q.query_id),
pooled AS (SELECT query_id, any_value(text) AS text, coalesce(string_agg(trim(generation), ' ') FILTER (WHERE trim(generation) <> ''), '') AS gen FROM ex GROUP BY 1),
counted AS (SELECT query_id, gen <> '' AS made, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(gen, '\\S+'))) t) AS words FROM pooled),
gt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(gen), '[a-z0-9]+')) AS term FROM pooled) WHERE term NOT IN """ + STOP + """),
ot AS (SELECT DISTINCT query_id, term FROM qtok WHERE term NOT IN """ + STOP + """),
tt AS (SELECT gt.query_id, count(*) AS terms, count(*) FILTER (WHERE ot.term IS NULL) AS added FROM gt LEFT JOIN ot USING (query_id, term) GROUP BY 1),
st AS (SELECT made, words, coalesce(terms, 0) AS terms, coalesce(added, 0) AS added FROM counted LEFT JOIN tt USING (query_id))"""


@_query(_with(_EXPANSIONS_OF, select=f"SELECT count(*) AS inputs, count(*) FILTER (WHERE NOT made) AS empty, count(*) FILTER (WHERE made AND added = 0) AS adding_nothing, {_spread_sql('words')}, {_spread_sql('added')}, coalesce(round(avg(coalesce(added / nullif(terms, 0), 0)) FILTER (WHERE made), 4), 0)::DOUBLE AS mean_fraction FROM st"))
def expansion_stats(spark, sf_dir):
    return _ints(expansion.summarise_expansions(X.queries(spark, sf_dir).select(F.col("query_id").alias("id"), "text"), X.expansions(spark, sf_dir)))


# ---- judging and answers --------------------------------------------------------------------------

_ANSWER_SQL = "CASE (vec_id % 9) WHEN 0 THEN ' Yes.' WHEN 1 THEN 'No' WHEN 2 THEN 'not relevant' WHEN 3 THEN 'TRUE' WHEN 4 THEN 'maybe' WHEN 5 THEN 'irrelevant' WHEN 6 THEN 'relevant' WHEN 7 THEN 'none of it' ELSE '' END"


def _answer(n) -> F.Column:
    out = F.lit("")
    for i, a in enumerate((" Yes.", "No", "not relevant", "TRUE", "maybe", "irrelevant", "relevant", "none of it")):
        out = F.when(n % 9 == i, a).otherwise(out)
    return out


_VERDICTS = f"v AS (SELECT *, CASE WHEN a LIKE 'no%' OR a LIKE 'false%' OR a LIKE 'irrelevant%' THEN 0 WHEN a LIKE 'yes%' OR a LIKE 'true%' OR a LIKE 'relevant%' THEN 1 END AS verdict FROM (SELECT vec_id, label, lower(trim({_ANSWER_SQL})) AS a FROM embeddings))"


@_query(_with(_VERDICTS, select="SELECT vec_id, verdict::BIGINT AS verdict FROM v"))
def parse_verdict(spark, sf_dir):
    return _ints(X.table(spark, sf_dir, "embeddings").select("vec_id", T.verdict(_answer(F.col("vec_id"))).alias("verdict")))


@_query(_with(select="SELECT query_id, doc_id, grade::BIGINT AS grade FROM qrels"))
def judgeable_qrels(spark, sf_dir):
    return _ints(agreement.judgeable_pairs(X.qrels(spark, sf_dir), min_per_class=0))


@_query(_with(_lex(), _scored("r", k=20), select="SELECT query_id, doc_id, grade::BIGINT AS grade FROM r JOIN qrels USING (query_id, doc_id)"))
def judgeable_retrieved(spark, sf_dir):
    return _ints(agreement.judgeable_pairs(X.qrels(spark, sf_dir), _run(spark, sf_dir, 20), 20, "retrieved", min_per_class=0))


@_query(_with("o AS (SELECT *, row_number() OVER (ORDER BY query_id, doc_id) - 1 AS nth, count(*) OVER () AS n FROM qrels)", select="SELECT query_id, doc_id, grade::BIGINT AS grade FROM o WHERE n <= 100 OR nth IN (SELECT floor(i * (n / 100.0))::BIGINT FROM range(100) g(i), (SELECT any_value(n) AS n FROM o))"))
def judge_thinning(spark, sf_dir):
    return _ints(agreement.thinned(agreement.judgeable_pairs(X.qrels(spark, sf_dir), min_per_class=0), 100))


_LABELS = "l AS (SELECT quality AS first, toxic AS second FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


def _labels(spark, sf_dir) -> DataFrame:
    return X.table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select(F.col("quality").alias("first"), F.col("toxic").alias("second"))


@_query(_with(_LABELS, "u AS (SELECT first AS x FROM l UNION SELECT second FROM l)", select="SELECT a.x::BIGINT AS first, b.x::BIGINT AS second, (SELECT count(*) FROM l WHERE l.first = a.x AND l.second = b.x) AS n FROM u a, u b"))
def confusion(spark, sf_dir):
    return _ints(agreement.confusion(_labels(spark, sf_dir)))


def _kappa_sql(source: str) -> str:
    return f"""k AS (SELECT n, same / n AS po, (SELECT coalesce(sum(x.c * y.c), 0) FROM (SELECT first, count(*) AS c FROM {source} GROUP BY 1) x JOIN (SELECT second, count(*) AS c FROM {source} GROUP BY 1) y ON x.first = y.second) / (n * n) AS pc
  FROM (SELECT count(*) AS n, count(*) FILTER (WHERE first = second) AS same FROM {source}))"""


_KAPPA = "n, round(po, 6) AS observed, round(pc, 6) AS chance, round(CASE WHEN pc >= 1 THEN 0 ELSE (po - pc) / (1 - pc) END, 6) AS kappa"


@_query(_with(_LABELS, _kappa_sql("l"), select=f"SELECT {_KAPPA} FROM k"))
def kappa(spark, sf_dir):
    return _ints(agreement.kappa(_labels(spark, sf_dir)))


@_query(_with(_VERDICTS, "g AS (SELECT (label % 3 > 0)::INT AS first, verdict AS second FROM v)", "s AS (SELECT * FROM g WHERE second IS NOT NULL)", _kappa_sql("s"), select=f"SELECT {_KAPPA}, (SELECT count(*) FROM g WHERE second IS NULL) AS unparseable, (SELECT count(*) FROM g WHERE first = 0 AND second = 1) AS false_positives, (SELECT count(*) FROM g WHERE first = 1 AND second = 0) AS false_negatives, (SELECT round(avg(second), 6) FROM g) AS yes_rate FROM k"))
def calibrate(spark, sf_dir):
    rows = X.table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("grade"), _answer(F.col("vec_id")).alias("answer"))
    return _ints(agreement.calibrated(rows))


_CITE = "c AS (SELECT query_id, text || ' [' || (query_id::BIGINT % 7) || '] and [2] [' || (query_id::BIGINT % 5) || '] [x]' AS a FROM queries), m AS (SELECT query_id, list_transform(regexp_extract_all(a, '\\[(\\d+)\\]', 1), lambda x: x::BIGINT) AS l FROM c), u AS (SELECT query_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM m)"


@_query(_with(_CITE, select="""SELECT query_id, array_to_string(list_filter(l, lambda x: x BETWEEN 1 AND 3), ' ') AS valid, array_to_string(list_filter(l, lambda x: NOT x BETWEEN 1 AND 3), ' ') AS invalid,
  round(1 - len(list_filter(l, lambda x: NOT x BETWEEN 1 AND 3)) / len(l), 6) AS citation_precision FROM u"""))
def citations(spark, sf_dir):
    q = F.col("query_id").cast("long")
    rows = X.queries(spark, sf_dir).select("query_id", F.concat("text", F.lit(" ["), (q % 7).cast("string"), F.lit("] and [2] ["), (q % 5).cast("string"), F.lit("] [x]")).alias("a"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    n = F.lit(3)
    return _ints(rows.select("query_id", joined(T.valid_citations(F.col("a"), n)).alias("valid"), joined(T.invalid_citations(F.col("a"), n)).alias("invalid"), T.citation_precision(F.col("a"), n).alias("citation_precision")))


@_query(_with(_lex(), _scored("r", k=3), select="SELECT query_id, md5(string_agg(regexp_replace('[' || rank || '] ' || regexp_replace(title, '^\\s+|\\s+$', '', 'g') || chr(10) || substr(regexp_replace(c.text, '^\\s+|\\s+$', '', 'g'), 1, 700), '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY rank)) AS sources FROM r JOIN corpus c USING (doc_id) GROUP BY 1"))
def format_sources(spark, sf_dir):
    from irspan.plans.service import format_sources as formatted

    return formatted(_run(spark, sf_dir, 3), X.corpus(spark, sf_dir)).select("query_id", F.md5(F.col("sources").cast("binary")).alias("sources"))


@_query(_with(_lex(), _scored("r", k=5), select="SELECT query_id, doc_id, round(score::DECIMAL(18, 6), 4)::DOUBLE AS score, title, md5(substr(c.text, 1, 600)) AS snippet, rank FROM r JOIN corpus c USING (doc_id)"))
def search_documents(spark, sf_dir):
    from irspan.plans.service import result_rows

    return _ints(result_rows(_run(spark, sf_dir, 5), X.corpus(spark, sf_dir)).withColumn("snippet", F.md5(F.col("snippet").cast("binary"))))


@_query(_with(select="SELECT (SELECT count(*) FROM corpus) AS documents, count(DISTINCT query_id) AS queries, count(*) AS judgements, count(*) FILTER (WHERE grade > 0) AS relevant FROM qrels"), name="describe_benchmark")
def _describe(spark, sf_dir):
    return describe_benchmark(X.single(spark, sf_dir), X.qrels(spark, sf_dir))


@_query(_with("""h AS (SELECT sha256(doc_id || chr(0) || title || chr(0) || text) AS h FROM (SELECT doc_id, '' AS title, whole AS text FROM corpus))""", select="SELECT n AS documents, substr(sha256(n || ':' || a || ':' || b || ':' || c || ':' || d), 1, 16) AS digest FROM (SELECT count(*) AS n, " + ", ".join(f"sum(('0x' || substr(h, {at}, 8))::HUGEINT) AS {x}" for x, at in zip("abcd", (1, 9, 17, 25), strict=True)) + " FROM h)"))
def corpus_digest(spark, sf_dir):
    return datasets.corpus_digest(X.single(spark, sf_dir))


# ---- sweeps ---------------------------------------------------------------------------------------

_CELLS = sweeps.bm25_grid()
_CELL_ROWS = ", ".join(f"({i}, {k1}::DOUBLE, {b}::DOUBLE)" for i, (k1, b) in enumerate(_CELLS))
_SWEEP = f"""g AS (SELECT * FROM (VALUES {_CELL_ROWS}) v(cell, k1, b)),
r AS (SELECT *, row_number() OVER (PARTITION BY cell, query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT cell, query_id, doc_id, round(sum(weight * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), fs, g GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 10),
i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(nth + 1)) AS i FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS nth FROM qrels WHERE grade > 0) WHERE nth <= 10 GROUP BY 1),
sw AS (SELECT cell, k1, b, avg(coalesce(d / nullif(i, 0), 0)) AS ndcg FROM g CROSS JOIN (SELECT DISTINCT query_id FROM qrels) q LEFT JOIN (SELECT cell, query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS d FROM r JOIN qrels USING (query_id, doc_id) WHERE grade > 0 GROUP BY ALL) USING (cell, query_id) LEFT JOIN i USING (query_id) GROUP BY ALL)"""


def _swept(spark, sf_dir) -> DataFrame:
    return sweeps.sweep_bm25(_bm25(spark, sf_dir), X.queries(spark, sf_dir), X.qrels(spark, sf_dir), _CELLS)


@_query(_with(_lex(), _SWEEP, select="SELECT cell::BIGINT AS cell, k1, b, round(ndcg, 6) AS ndcg FROM sw"))
def sweep_bm25(spark, sf_dir):
    return _ints(_swept(spark, sf_dir))


@_query(_with(_lex(), _SWEEP, "v AS (SELECT round(ndcg, 6) AS v FROM sw), m AS (SELECT max(v) AS best FROM v)", select="SELECT best, min(v) AS worst, round(best - min(v), 6) AS span, count(*) AS cells, count(*) FILTER (WHERE best - v <= 0.005 + 1e-9) AS within_005, count(*) FILTER (WHERE best - v <= 0.010 + 1e-9) AS within_010 FROM v, m GROUP BY best"))
def sweep_surface(spark, sf_dir):
    return sweeps.surface(_swept(spark, sf_dir))


@_query(_with(_lex(), _SWEEP, "p AS (SELECT b AS x, round(ndcg, 6) AS value FROM sw WHERE k1 = 0.9), l AS (SELECT *, value - lag(value) OVER (ORDER BY x) AS step FROM p)", select="""SELECT best_x, best_x = low OR best_x = high AS at_edge, CASE WHEN up THEN 'increasing' WHEN down THEN 'decreasing' ELSE 'neither' END AS direction
FROM (SELECT (SELECT x FROM p ORDER BY value DESC, x LIMIT 1) AS best_x, min(x) AS low, max(x) AS high, bool_and(coalesce(step > 0, true)) AS up, bool_and(coalesce(step < 0, true)) AS down FROM l)"""))
def sweep_shape(spark, sf_dir):
    """The direction of the measure along b."""
    return _ints(sweeps.shape(_swept(spark, sf_dir).where("k1 = 0.9").select(F.col("b").alias("x"), F.round("ndcg", 6).alias("value"))))


_FORMS = {"head": (1, 8), "middle": (5, 12), "all": (1, 0)}  # first word and number of words; 0: all


def _form_sql(i: int, a: int, n: int) -> str:
    return f"""y{i} AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM (SELECT query_id, unnest(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[{a}:{a + n - 1 if n else 'len(text) + 1'}], ' ')), '[a-z0-9]+')) AS term FROM queries) WHERE term NOT IN {STOP} GROUP BY ALL),
{_scored(f"z{i}", terms=f"y{i}")}"""


@_query(_with(_lex(), *(_form_sql(i, *f) for i, f in enumerate(_FORMS.values())), "v AS (" + "\nUNION ALL ".join(f"SELECT avg(value) AS value FROM ({_ndcg_of(f'z{i}')})" for i in range(len(_FORMS))) + ")", select="SELECT round(max(value), 6) AS best, round(min(value), 6) AS worst, round(max(value) - min(value), 6) AS spread FROM v"))
def formulation_spread(spark, sf_dir):
    """Means of three formulations of the queries."""
    r, judged, q = _bm25(spark, sf_dir), X.qrels(spark, sf_dir), X.queries(spark, sf_dir)
    means = None
    for name, (a, n) in _FORMS.items():
        part = q.select("query_id", (F.array_join(F.slice(F.split("text", " "), a, n), " ") if n else F.col("text")).alias("text"))
        values = metrics.evaluate_per_query(r.retrieve(part, 10), judged, (10,)).where("metric = 'ndcg@10'").agg(F.avg(F.round("value", 6)).alias("value")).select(F.lit(name).alias("formulation"), "value")
        means = values if means is None else means.unionByName(values)
    return _ints(metrics.formulation_spread(means))


def _union_cells(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


_RRF_CELLS = sweeps.RRF_K


def _fused_as(name: str, k: float) -> str:
    return _fused(k, 1, 1).replace("f AS (", f"{name} AS (", 1)


@_query(_with(*_TWO, *(_fused_as(f"f{i}", k) for i, k in enumerate(_RRF_CELLS)), select=_union_cells([f"SELECT {i}::BIGINT AS cell, {k}::DOUBLE AS rrf_k, round(avg(v), 6) AS ndcg FROM (SELECT value AS v FROM ({_ndcg_of(f'f{i}')}))" for i, k in enumerate(_RRF_CELLS)]).replace("round(coalesce(d / nullif(i, 0), 0), 6) AS value", "coalesce(d / nullif(i, 0), 0) AS value")))
def sweep_rrf_k(spark, sf_dir):
    return _ints(sweeps.sweep_rrf(_two(spark, sf_dir), X.qrels(spark, sf_dir), _RRF_CELLS))


_WEIGHTS = sweeps.EXPANSION_WEIGHTS


def _weighted_as(i: int, w: int) -> str:
    return f"""x{i} AS (SELECT query_id, term, sum(weight) AS weight FROM (SELECT query_id, term, weight * CASE WHEN query_id IN (SELECT query_id FROM pt) THEN {w} ELSE 1 END AS weight FROM qt UNION ALL SELECT * FROM pt) GROUP BY ALL),
{_scored(f"e{i}", terms=f"x{i}")}"""


@_query(_with(_lex(), _PASSAGE, f"pt AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM (SELECT query_id, unnest({_TERMS.format(x='p')}) AS term FROM qp) GROUP BY ALL)", *(_weighted_as(i, w) for i, w in enumerate(_WEIGHTS)), select=_union_cells([f"SELECT {i}::BIGINT AS cell, {w}::BIGINT AS weight, round(avg(v), 6) AS ndcg FROM (SELECT value AS v FROM ({_ndcg_of(f'e{i}')}))" for i, w in enumerate(_WEIGHTS)]).replace("round(coalesce(d / nullif(i, 0), 0), 6) AS value", "coalesce(d / nullif(i, 0), 0) AS value")))
def sweep_expansion_weight(spark, sf_dir):
    passages = X.queries(spark, sf_dir).select("query_id").join(X.expansions(spark, sf_dir).select(F.col("id").alias("query_id"), F.get("generations", F.lit(0)).alias("text")), "query_id")
    return _ints(sweeps.sweep_expansion(_bm25(spark, sf_dir), X.queries(spark, sf_dir), passages, X.qrels(spark, sf_dir), _WEIGHTS))


_RM3_ROWS = ", ".join(f"({i}, {d}, {t}, {a}::DOUBLE)" for i, (d, t, a) in enumerate(sweeps.rm3_grid()))
_RM3_SWEEP = f"""cells AS (SELECT * FROM (VALUES {_RM3_ROWS}) v(cell, fb_docs, fb_terms, alpha)),
fd AS (SELECT f.fb_docs, query_id, doc_id, score / sum(score) OVER (PARTITION BY f.fb_docs, query_id) AS share FROM fb, (SELECT DISTINCT fb_docs FROM cells) f WHERE rank <= f.fb_docs),
rm AS (SELECT fb_docs, query_id, term, round(sum(share * tf / dl), 10) AS weight FROM fd JOIN tf USING (doc_id) JOIN dl USING (doc_id) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY fb_docs, query_id ORDER BY weight DESC, term) AS nth FROM rm WHERE weight > 0),
mo AS (SELECT fb_docs, c.fb_terms, query_id, term, weight / sum(weight) OVER (PARTITION BY fb_docs, c.fb_terms, query_id) AS share FROM rk, (SELECT DISTINCT fb_terms FROM cells) c WHERE nth <= c.fb_terms),
own AS (SELECT query_id, term, weight / sum(weight) OVER (PARTITION BY query_id) AS weight FROM qt),
mixed AS (SELECT cell, query_id, term, sum(weight) AS weight FROM (
  SELECT cell, query_id, term, CASE WHEN EXISTS (SELECT 1 FROM mo WHERE mo.fb_docs = c.fb_docs AND mo.fb_terms = c.fb_terms AND mo.query_id = own.query_id) THEN 1 - alpha ELSE 1 END * weight AS weight FROM own, cells c
  UNION ALL SELECT cell, query_id, term, alpha * share FROM mo JOIN cells c USING (fb_docs, fb_terms)) GROUP BY ALL),
part AS (SELECT term, doc_id, idf * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl)) AS c FROM tf JOIN idf USING (term) JOIN dl USING (doc_id), fs WHERE term IN (SELECT term FROM mixed)),
r AS (SELECT *, row_number() OVER (PARTITION BY cell, query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT cell, query_id, doc_id, round(sum(weight * c), 6) AS score FROM mixed JOIN part USING (term) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 10),
i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(nth + 1)) AS i FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS nth FROM qrels WHERE grade > 0) WHERE nth <= 10 GROUP BY 1),
d AS (SELECT cell, query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS d FROM r JOIN qrels USING (query_id, doc_id) WHERE grade > 0 GROUP BY ALL),
sw AS (SELECT cell, fb_docs, fb_terms, alpha, (SELECT coalesce(sum(d.d / i.i), 0) FROM d JOIN i USING (query_id) WHERE d.cell = cells.cell) / (SELECT count(DISTINCT query_id) FROM qrels) AS ndcg FROM cells)"""


@_query(_with(_lex(), _scored("fb", k=max(sweeps.RM3_GRID["fb_docs"])), _RM3_SWEEP, select="SELECT cell::BIGINT AS cell, fb_docs::BIGINT AS fb_docs, fb_terms::BIGINT AS fb_terms, alpha, round(ndcg, 6) AS ndcg FROM sw"))
def sweep_rm3(spark, sf_dir):
    """All 96 cells of the feedback grid."""
    return _ints(sweeps.sweep_rm3(_rm3(spark, sf_dir), X.queries(spark, sf_dir), X.qrels(spark, sf_dir)))


@_query(_with(_lex(), _SWEEP, select="SELECT cell::BIGINT AS cell, k1, b, round(ndcg, 6) AS ndcg FROM sw QUALIFY row_number() OVER (PARTITION BY b ORDER BY round(ndcg, 6) DESC, cell) = 1"))
def sweep_best_by_axis(spark, sf_dir):
    """The best k1 for each b."""
    return _ints(sweeps.best_by_axis(_swept(spark, sf_dir), "b"))


@_query(_with(_lex(), _SWEEP, select="SELECT cell::BIGINT AS cell, k1, b, round(ndcg, 6) AS ndcg FROM sw ORDER BY round(ndcg, 6) DESC, cell LIMIT 1"))
def sweep_best_cell(spark, sf_dir):
    """The best cell of the grid, the first of equals."""
    return _ints(sweeps.best_cell(_swept(spark, sf_dir)))


@_query(_with(*_TWO, _STATS, _SYSTEMS, "qs AS (SELECT i AS cell, quantile_cont(max_idf, i / 20) AS threshold FROM st, range(21) g(i) GROUP BY i)".replace("quantile_cont(max_idf, i / 20)", "(SELECT quantile_cont(max_idf, [x / 20.0 FOR x IN range(21)]) FROM st)[i + 1]").replace("FROM st, range(21) g(i) GROUP BY i", "FROM range(21) g(i)"), select="SELECT cell::BIGINT AS cell, round(threshold, 6) AS threshold, round(avg(CASE WHEN max_idf >= threshold THEN a.value ELSE b.value END), 6) AS value FROM qs, st JOIN sys a USING (query_id) JOIN sys b USING (query_id) WHERE a.system = 'a' AND b.system = 'b' GROUP BY ALL"))
def router_sweep(spark, sf_dir):
    return _ints(sweeps.sweep_router(_stats(spark, sf_dir), _systems(spark, sf_dir), "max_idf", "a", "b"))


# ---- datasets on disk, written from the tables and read again ---------------------------------------


def _dataset(spark, sf_dir, name: str) -> str:
    """A folder with one dataset, as its public format has it: JSON lines and tab-separated judgements."""
    folder = physical.shared_folder(spark, "datasets")
    record = lambda *cols: F.to_json(F.struct(*cols)).alias("value")
    corpus = X.corpus(spark, sf_dir).select(F.col("doc_id").alias("_id"), "title", "text")
    corpus.select(record("_id", "title", "text")).write.text(f"{folder}/{name}/corpus.jsonl")
    asked = X.queries(spark, sf_dir).select(F.col("query_id").alias("_id"), "text", F.struct(F.substring_index("text", " ", 2).alias("query"), F.when(F.col("query_id").cast("long") % 3 == 0, F.lit("")).otherwise(F.col("query_id")).alias("narrative")).alias("metadata"))
    asked.select(record("_id", "text", "metadata")).write.text(f"{folder}/{name}/queries.jsonl")
    lines = X.qrels(spark, sf_dir).select(F.concat_ws("\t", "query_id", "doc_id", F.col("grade").cast("string")).alias("value"), F.lit(1).alias("o"))
    head = spark.createDataFrame([("query-id\tcorpus-id\tscore", 0)], "value string, o int")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("o").select("value").write.text(f"{folder}/{name}/qrels/test.tsv")
    return folder


@_query(_with(select="SELECT doc_id, md5(title) AS title, md5(text) AS text FROM corpus"))
def scan_corpus(spark, sf_dir):
    """A JSONL corpus."""
    rows = datasets.read_corpus(spark, f"{_dataset(spark, sf_dir, 'made')}/made/corpus.jsonl")
    return rows.select("doc_id", *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("title", "text")))


@_query(_with(select="SELECT query_id, doc_id, grade::BIGINT AS grade FROM qrels"))
def scan_qrels(spark, sf_dir):
    """Tab-separated judgements with a header."""
    return _ints(datasets.read_qrels(spark, f"{_dataset(spark, sf_dir, 'made')}/made/qrels/test.tsv"))


@_query(_with(select="SELECT query_id, text, (SELECT count(*) FROM corpus) AS documents, (SELECT count(*) FROM qrels) AS judgements FROM queries WHERE query_id IN (SELECT query_id FROM qrels)"))
def load_dataset(spark, sf_dir):
    """A whole dataset: its judged queries, and how much there is of the rest."""
    data = datasets.load_dataset(spark, "made", folder=_dataset(spark, sf_dir, "made"))
    return data.queries.select("query_id", "text", F.lit(data.corpus.count()).cast("long").alias("documents"), F.lit(data.qrels.count()).cast("long").alias("judgements"))


@_query(_with(select="SELECT query_id, concat_ws(' ', split_part(text, ' ', 1) || CASE WHEN contains(text, ' ') THEN ' ' || split_part(text, ' ', 2) ELSE '' END, CASE WHEN query_id::BIGINT % 3 = 0 THEN NULL ELSE query_id END) AS text FROM queries"))
def query_formulations(spark, sf_dir):
    """Queries put together from dotted fields of their records."""
    path = f"{_dataset(spark, sf_dir, 'made')}/made/queries.jsonl"
    return datasets.formulated_queries(spark, path, ["metadata.query", "metadata.nothing", "metadata.narrative"])


@_query(_with(select="SELECT id, len(generations) AS n, md5(array_to_string(generations, '|')) AS generations FROM expansions"))
def stored_expansions(spark, sf_dir):
    """Expansions written beside their settings and read again."""
    path = f"{physical.shared_folder(spark, 'expansions')}/made"
    datasets.write_expansions(X.expansions(spark, sf_dir), path, {"model": "none"})
    rows = datasets.read_expansions(spark, path)
    return _ints(rows.select("id", F.size("generations").alias("n"), F.md5(F.array_join("generations", "|").cast("binary")).alias("generations")))


@_query(_with(_lex(), _scored("r", k=100), _dcg("exponential"), select="SELECT query_id, round(value, 6) AS value FROM pq WHERE metric = 'recall@100'"))
def stored_results(spark, sf_dir):
    """A run's values written with its summary, and one metric read by the summary's pointer."""
    values = metrics.evaluate_per_query(_run(spark, sf_dir, 100), X.qrels(spark, sf_dir))
    folder = f"{physical.shared_folder(spark, 'results')}/made"
    datasets.write_results(metrics.macro_mean(values), values, folder, "bm25")
    return _ints(datasets.read_per_query(spark, folder, "bm25", "recall@100"))


# ---- retrievers over a model's vectors, from texts to runs ------------------------------------------

_VOCABULARY = ("the", "of", "and", "in", "that", "with", "der", "und", "die", "que", "la", "les")
_VOCABULARY_LIST = "[" + ", ".join(f"'{w}'" for w in _VOCABULARY) + "]"
_MODEL = f"""dw AS (SELECT doc_id, list_filter(string_split_regex(trim(title || ' ' || text), '\\s+'), lambda x: x <> '') AS w FROM corpus),
ch AS (SELECT doc_id, lower(array_to_string(w[i * 40 + 1 : i * 40 + 50], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 50 THEN 1 ELSE (len(w) - 1) // 40 + 1 END)) AS i FROM dw)),
cv AS (SELECT doc_id, list_transform({_VOCABULARY_LIST}, lambda v: len(list_filter(string_split_regex(t, '\\s+'), lambda x: x = v))::DOUBLE) AS v FROM ch),
qv AS (SELECT query_id, list_transform({_VOCABULARY_LIST}, lambda v: len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x = v))::DOUBLE) AS v FROM queries),
ds AS (SELECT query_id, doc_id, round(max(CASE WHEN list_sum(qv.v) = 0 OR list_sum(cv.v) = 0 THEN 0 ELSE list_cosine_similarity(qv.v, cv.v) END), 6) AS score FROM qv, cv GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds),
dt AS (SELECT doc_id, unnest(string_split_regex(lower(title || ' ' || text), '\\s+')) AS term FROM corpus), dk AS (SELECT * FROM dt WHERE list_contains({_VOCABULARY_LIST}, term)),
kt AS (SELECT query_id, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM queries), qk AS (SELECT * FROM kt WHERE list_contains({_VOCABULARY_LIST}, term))"""


def _encoder() -> vectors.VocabularyEncoder:
    return vectors.VocabularyEncoder(_VOCABULARY)


@_query(_with(_MODEL, select=_RUN + "dr WHERE rank <= 10"))
def retriever_dense(spark, sf_dir):
    """Chunks, vectors, the best chunk of every document: a dense retriever with a stand-in model."""
    made = retrievers.DenseRetriever(_encoder(), 50, 10).index(X.corpus(spark, sf_dir))
    return _ints(made.retrieve(X.queries(spark, sf_dir), 10))


@_query(_with(_MODEL, select="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(count(*) * 0.693147::DOUBLE * 0.693147::DOUBLE, 6) AS score FROM (SELECT DISTINCT * FROM qk) JOIN (SELECT DISTINCT * FROM dk) USING (term) GROUP BY ALL) QUALIFY rank <= 10"""))
def retriever_sparse(spark, sf_dir):
    """A learned-sparse retriever with a stand-in model: a word's weight is log 2 wherever it occurs."""
    return _ints(retrievers.SparseRetriever(_encoder()).index(X.corpus(spark, sf_dir)).retrieve(X.queries(spark, sf_dir), 10))


@_query(_with(_MODEL, "td AS (SELECT DISTINCT doc_id, term FROM dk), asks AS (SELECT DISTINCT query_id FROM qk)", select="""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, (SELECT count(*) FROM qk JOIN td USING (term) WHERE qk.query_id = a.query_id AND td.doc_id = d.doc_id)::DOUBLE AS score FROM asks a, (SELECT DISTINCT doc_id FROM td) d) QUALIFY rank <= 10"""))
def retriever_late(spark, sf_dir):
    """Late interaction with a stand-in model, over the documents that have a token of it."""
    has = F.exists(F.split(F.lower(F.concat_ws(" ", "title", "text")), r"\s+"), lambda w: w.isin(*_VOCABULARY))
    made = retrievers.LateInteractionRetriever(_encoder()).index(X.corpus(spark, sf_dir).where(has))
    return _ints(made.retrieve(X.queries(spark, sf_dir), 10))


@_query(_with(_MODEL, _lex(), _scored("a", k=100), "b AS (SELECT * FROM dr WHERE rank <= 100)", _fused(5, 1, 1), select=_ROUNDED_RUN + "f"))
def retriever_fused(spark, sf_dir):
    """BM25 and the dense retriever, fused by ranks."""
    dense = retrievers.DenseRetriever(_encoder(), 50, 10).index(X.corpus(spark, sf_dir))
    return _ints(retrievers.FusedRetriever((_bm25(spark, sf_dir), dense), k=5).retrieve(X.queries(spark, sf_dir), 10))
