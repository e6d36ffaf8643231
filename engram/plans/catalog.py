"""Named queries over generic tables, each with the SQL that says the same.

A query takes (session, folder of tables). Clock, brain, texts and vectors are
fixed, so that results are the same at any time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.errors import ProfileMismatchError
from engram.functions import clock, embedding, jsons, text, vectors
from engram.operators import blocks, constraints, imports, lexical, lifecycle, metrics, scan, search, vector
from engram.schemas import DAY_MS
from engram.session import shared_dir
from engram.sources import corpus, jsonl

Query = Callable[[SparkSession, str], DataFrame]
NOW, BRAIN = corpus.NOW_MS, "en"
WORDS = "Of the THTION; er-re ing, wasn't the"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_CREATED = "(1706745600000 - (doc_id % 8760) * 3600000)"
MEM = f"""
mem AS (
  SELECT 'm' || lpad(doc_id::VARCHAR, 8, '0') AS memory_id, lang AS brain_id, 'corpus' AS agent_id, source AS topic,
    (['bug','decision','preference','fact','note','task'])[(doc_id % 6 + 1)::INT] AS catalog,
    split_part(text, chr(10), 1) AS summary, substr(text, length(split_part(text, chr(10), 1)) + 2) AS content,
    strftime(make_timestamp({_CREATED} * 1000), '%Y-%m-%d') AS timeline_day,
    {_CREATED} AS created_at_ms, (1 + doc_id % 5)::INT AS importance,
    {_CREATED} + 86400000::BIGINT * (CASE doc_id % 5 WHEN 0 THEN 7 WHEN 1 THEN 30 WHEN 2 THEN 90 WHEN 3 THEN 180 ELSE 365 END) AS expires_at_ms,
    CASE WHEN doc_id % 17 = 0 THEN {_CREATED} + 86400000 END AS deleted_at_ms, doc_id % (SELECT count(*) FROM embeddings) AS vec, doc_id, text
  FROM documents
), live AS (
  SELECT * FROM mem WHERE deleted_at_ms IS NULL AND expires_at_ms > 1706745600000
)"""
AUDIT = """
audit AS (
  SELECT 'e' || lpad(event_id::VARCHAR, 10, '0') AS event_id, (['en','de','fr','es'])[(user_id % 4 + 1)::INT] AS brain_id,
    'm' || lpad((event_id % (SELECT count(*) FROM documents))::VARCHAR, 8, '0') AS memory_id, 'agent' || (user_id % 3)::VARCHAR AS agent_id,
    CASE event_type WHEN 'click' THEN 'remember' WHEN 'error' THEN 'reinforce' WHEN 'purchase' THEN 'forget' WHEN 'signup' THEN 'restore' ELSE 'hard_delete' END AS action,
    epoch_us(ts) // 1000 AS event_at_ms, strftime(ts, '%Y-%m-%d') AS timeline_day, props AS detail_json
  FROM events
)"""
TOKENS = r"regexp_extract_all(lower(strip_accents({0})), '[\p{{L}}\p{{N}}]+')"
_WEIGHTED = " UNION ALL ".join(f"SELECT brain_id, memory_id, unnest({TOKENS.format(c)}) AS term, {w}::DOUBLE AS w FROM mem" for c, w in (("topic", 5), ("summary", 3), ("content", 1)))
POSTINGS = f"""
tok AS ({_WEIGHTED}), lens AS (
  SELECT m.brain_id, m.memory_id, count(t.term) AS len FROM mem m LEFT JOIN tok t USING (brain_id, memory_id) GROUP BY ALL
), stats AS (
  SELECT count(*) AS n_rows, sum(len)::BIGINT AS n_tokens, sum(len)::DOUBLE / count(*) AS avg_len FROM lens
), posts AS (
  SELECT brain_id, memory_id, term, sum(w) AS tf, min(len) AS len FROM tok JOIN lens USING (brain_id, memory_id) GROUP BY ALL
)"""


def _query_rows(rows: str) -> str:
    return f"q AS (SELECT * FROM (VALUES {rows}) v(query_id, brain_id, text, vec_id))"


def _lexical_sql(where: str = "true", limit: int = 50) -> str:
    return f"""
asked AS (
  SELECT query_id, brain_id, term, min(pos) AS pos FROM (SELECT query_id, brain_id, unnest({TOKENS.format("text")}) AS term, generate_subscripts({TOKENS.format("text")}, 1) AS pos FROM q) GROUP BY ALL
), dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term
), parts AS (
  SELECT a.query_id, p.memory_id, a.pos,
    -CASE WHEN ln((n_rows - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_rows - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
      * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * p.len / avg_len)) AS part
  FROM posts p JOIN asked a USING (term, brain_id) JOIN dfs USING (term), stats
), lex0 AS (
  SELECT query_id, memory_id, list_reduce(list(part ORDER BY pos), lambda x, y: x + y) AS score FROM parts
  WHERE memory_id IN (SELECT memory_id FROM live WHERE {where}) GROUP BY ALL
), lex AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, memory_id) AS rank FROM lex0) WHERE rank <= {limit}
)"""


def _vector_sql(where: str = "true", floor: int = 300000, limit: int = 50) -> str:
    return f"""
qv AS (SELECT q.query_id, q.brain_id, e.embedding::DOUBLE[] AS v FROM q JOIN embeddings e ON e.vec_id = q.vec_id
), keys AS (
  SELECT qv.query_id, l.memory_id, round_even(list_dot_product(e.embedding::DOUBLE[], qv.v)
      / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(qv.v, qv.v))) * 1e6, 0)::BIGINT AS key
  FROM (SELECT * FROM live WHERE {where}) l JOIN embeddings e ON e.vec_id = l.vec JOIN qv ON qv.brain_id = l.brain_id
), vec AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, memory_id) AS rank FROM keys WHERE key >= {floor}) WHERE rank <= {limit}
)"""


_FUSE = """
fused AS (
  SELECT query_id, memory_id, min(l) AS lexical_rank, min(v) AS vector_rank FROM (
    SELECT query_id, memory_id, rank AS l, NULL AS v FROM lex UNION ALL SELECT query_id, memory_id, NULL, rank FROM vec) GROUP BY ALL
), scored AS (
  SELECT *, coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0) AS score FROM fused
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
    (lexical_rank IS NOT NULL)::INT + (vector_rank IS NOT NULL)::INT DESC, least(lexical_rank, vector_rank), memory_id) AS rank FROM scored) WHERE rank <= 5
)"""
_PREVIEW_SQL = "memory_id, topic, catalog, summary, timeline_day, importance, length(content) > 0 AS has_content"
_ROUND = "round(score, 9) AS score"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _mem(spark: SparkSession, d: str, *, vectors: bool = False) -> DataFrame:
    return corpus.memories(spark, d, vectors=vectors)


def _whole() -> F.Column:
    """A document's text, of which a memory has the first line as its summary."""
    return F.concat_ws("\n", "summary", "content")


def _longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# ------------------------------------------------------------------ scans and listings


@query(f"WITH {MEM} SELECT brain_id, memory_id, expires_at_ms FROM live")
def live_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.live(_mem(spark, d), now_ms=NOW).select("brain_id", "memory_id", "expires_at_ms")


@query(f"WITH {MEM} SELECT brain_id, count(*) AS n, min(memory_id) AS first_id FROM live WHERE brain_id = 'de' GROUP BY brain_id")
def brain_isolation(spark: SparkSession, d: str) -> DataFrame:
    return scan.live(_mem(spark, d), now_ms=NOW, brain_id="de").groupBy("brain_id").agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id"))


@query(
    f"WITH {MEM} SELECT memory_id, topic, catalog, summary, timeline_day, importance, length(content) > 0 AS has_content, content, agent_id, '{{}}' AS metadata, "
    "strftime(make_timestamp(created_at_ms * 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS created_at, strftime(make_timestamp(created_at_ms * 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS updated_at, "
    "strftime(make_timestamp(expires_at_ms * 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS expires_at, NULL::VARCHAR AS period_start, NULL::VARCHAR AS period_end FROM live "
    "WHERE memory_id = (SELECT min(memory_id) FROM live WHERE brain_id = 'en' AND memory_id > 'm00000020') AND brain_id = 'en'"
)
def get_by_id(spark: SparkSession, d: str) -> DataFrame:
    m = _mem(spark, d)
    name = scan.live(m, now_ms=NOW, brain_id=BRAIN).where("memory_id > 'm00000020'").agg(F.min("memory_id")).first()[0]
    return scan.detail(scan.get(m, name, brain_id=BRAIN, now_ms=NOW))


def _recent_sql(where: str, limit: int = 20) -> str:
    return f"WITH {MEM} SELECT memory_id, created_at_ms FROM live WHERE brain_id = 'en' AND {where} ORDER BY created_at_ms DESC, memory_id LIMIT {limit}"


def _recent(spark: SparkSession, d: str, limit: int = 20, **filters: object) -> DataFrame:
    f = scan.Filters.of(now_ms=NOW, **filters)
    return scan.recent(_mem(spark, d), brain_id=BRAIN, now_ms=NOW, limit=limit, filters=f).select("memory_id", "created_at_ms")


@query(_recent_sql("true"))
def recent(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d)


@query(_recent_sql("topic = 'src3'"))
def recent_topic(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d, topic="src3")


@query(_recent_sql("catalog = 'fact'"))
def recent_catalog(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d, catalog="fact")


@query(_recent_sql("timeline_day = '2024-01-30'"))
def recent_day(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d, timeline_day="2024-01-30")


@query(_recent_sql("importance >= 4", 100))
def recent_min_importance(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d, limit=100, min_importance=4)


@query(_recent_sql(f"created_at_ms >= {NOW - 3 * DAY_MS}", 100))
def recent_since_days(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d, limit=100, days=3)


@query(_recent_sql(f"created_at_ms BETWEEN {NOW - 5 * DAY_MS} AND {NOW - 2 * DAY_MS}", 100))
def recent_window(spark: SparkSession, d: str) -> DataFrame:
    return _recent(spark, d, limit=100, since_ms=NOW - 5 * DAY_MS, until_ms=NOW - 2 * DAY_MS)


@query(f"WITH {MEM} SELECT {_PREVIEW_SQL} FROM live WHERE brain_id = 'en'")
def preview_projection(spark: SparkSession, d: str) -> DataFrame:
    return scan.preview(scan.live(_mem(spark, d), now_ms=NOW, brain_id=BRAIN))


@query(
    f"WITH {MEM}, flat AS (SELECT *, trim(regexp_replace(summary, '\\s+', ' ', 'g')) AS s FROM live) SELECT memory_id, timeline_day || ' [' || catalog || '] ' || topic || ': ' "
    "|| CASE WHEN length(s) > 120 THEN substr(s, 1, 117) || '...' ELSE s END AS line FROM flat"
)
def recent_line(spark: SparkSession, d: str) -> DataFrame:
    return scan.lines(scan.live(_mem(spark, d), now_ms=NOW))


@query(f"WITH {MEM} SELECT memory_id, importance FROM live")
def hydrate_keys(spark: SparkSession, d: str) -> DataFrame:
    m = _mem(spark, d)
    return scan.get_many(m, m.select("brain_id", "memory_id"), now_ms=NOW).select("memory_id", "importance")


# ------------------------------------------------------------------ lexical


@query(f"WITH {MEM} SELECT memory_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM mem")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return _mem(spark, d).select("memory_id", F.explode(text.terms(_whole())).alias("term"))


@query(f"WITH {MEM}, {POSTINGS} SELECT term, count(*) AS df FROM posts GROUP BY term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_df(_mem(spark, d))


@query(f"WITH {MEM}, {POSTINGS} SELECT n_rows, n_tokens, round(avg_len, 9) AS avg_len FROM stats")
def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus_stats(_mem(spark, d)).withColumn("avg_len", F.round("avg_len", 9))


@query(f"WITH {MEM}, {POSTINGS} SELECT brain_id, memory_id, term, tf, len FROM posts")
def weighted_tf(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(_mem(spark, d))


def _questions(spark: SparkSession, d: str, rows: list[tuple[str, str, str | None, int | None]]) -> DataFrame:
    """``query_id, brain_id, text, vector`` with vectors looked up by number."""
    q = spark.createDataFrame(rows, "query_id string, brain_id string, text string, vec_id long")
    e = corpus.read(spark, d, "embeddings").where(F.col("vec_id").isin(*{r[3] for r in rows if r[3] is not None})).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return q.join(e, "vec_id", "left").select("query_id", "brain_id", "text", "vector")


_ONE = [("q1", BRAIN, WORDS, 3)]
_ONE_SQL = _query_rows(f"('q1', '{BRAIN}', '{WORDS.replace(chr(39), chr(39) * 2)}', 3)")
_NO_TERMS = [("q1", BRAIN, "?! -- ...", 3)]
_NO_TERMS_SQL = _query_rows(f"('q1', '{BRAIN}', '?! -- ...', 3)")


@query(f"WITH {MEM}, {POSTINGS}, {_ONE_SQL}, {_lexical_sql()} SELECT query_id, memory_id, {_ROUND}, rank FROM lex")
def lexical_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = lexical.lexical_branch(_mem(spark, d), _questions(spark, d, _ONE), scan.is_live(NOW))
    return _longs(found.withColumn("score", F.round("score", 9)), "rank")


@query(f"WITH {MEM}, {POSTINGS}, {_ONE_SQL}, {_lexical_sql('importance >= 4', 10)} SELECT query_id, memory_id, {_ROUND}, rank FROM lex")
def lexical_filtered(spark: SparkSession, d: str) -> DataFrame:
    eligible = scan.is_live(NOW) & scan.Filters(min_importance=4).predicate()
    found = lexical.lexical_branch(_mem(spark, d), _questions(spark, d, _ONE), eligible, limit=10)
    return _longs(found.withColumn("score", F.round("score", 9)), "rank")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/engram-{name}-{uuid.uuid4().hex}"


@query(SQL["lexical_candidates"])
def lexical_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stored index, of which only tiles that can matter are scored."""
    m = _mem(spark, d)
    index = blocks.BlockIndex.build(m, _scratch(spark, "index"))
    found = lexical.lexical_branch(m, _questions(spark, d, _ONE), scan.is_live(NOW), index=index)
    return _longs(found.withColumn("score", F.round("score", 9)), "rank")


_MANY_SQL = """
q AS (
  SELECT 'b' || lpad(item_id::VARCHAR, 4, '0') AS query_id, (['en','de','fr','es'])[(item_id % 4 + 1)::INT] AS brain_id, text, item_id % (SELECT count(*) FROM embeddings) AS vec_id FROM benchmark
)"""


def _by_parts(spark: SparkSession, d: str) -> blocks.BlockIndex:
    """An index of all memories, appended in eight parts, merged and then without the deleted rows."""
    m = _mem(spark, d)
    index = blocks.BlockIndex(spark, _scratch(spark, "segments"))
    part = F.pmod(F.xxhash64("memory_id"), F.lit(8))
    for i in range(8):
        index = index.append(m.where(part == i)).merged(4)
    return index.remove(m.where("deleted_at_ms is not null"))


_KEPT = MEM.replace("mem AS", "whole AS", 1).replace("), live AS", "), mem AS (SELECT * FROM whole WHERE deleted_at_ms IS NULL), live AS", 1) + f", {POSTINGS}"


@query(f"WITH {_KEPT}, {_MANY_SQL}, {_lexical_sql()} SELECT query_id, memory_id, {_ROUND}, rank FROM lex")
def lexical_segments(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark questions against an index that was built by appends, a merge and a removal; equal to scoring everything."""
    m = _mem(spark, d).where("deleted_at_ms is null")
    found = _by_parts(spark, d).search(m, batch_questions(spark, d), scan.is_live(NOW), limit=lexical.BRANCH_LIMIT, score_all=0)
    return _longs(found.withColumn("score", F.round("score", 9)), "rank")


@query(f"WITH {_KEPT} SELECT brain_id, memory_id, term, tf, len FROM posts")
def segment_parity(spark: SparkSession, d: str) -> DataFrame:
    """What such an index holds: the postings of the rows that are left."""
    return _by_parts(spark, d).postings()


# ------------------------------------------------------------------ vectors and fusion


@query(f"WITH {MEM}, {_ONE_SQL}, {_vector_sql()} SELECT memory_id, key FROM keys")
def micro_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = _questions(spark, d, _ONE).first()["vector"]
    return vector.cosine_keys(scan.live(_mem(spark, d, vectors=True), now_ms=NOW, brain_id=BRAIN), v).select("memory_id", "key")


@query(f"WITH {MEM}, {_ONE_SQL}, {_vector_sql()} SELECT query_id, memory_id, key, rank FROM vec")
def vector_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _longs(vector.vector_branch(_mem(spark, d, vectors=True), _questions(spark, d, _ONE), scan.is_live(NOW)), "rank")


@query(f"WITH {MEM}, {_ONE_SQL}, {_vector_sql(chr(39).join(('catalog IN (', 'fact', ', ', 'note', ')')), 100000, 20)} SELECT query_id, memory_id, key, rank FROM vec")
def vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    eligible = scan.is_live(NOW) & F.col("catalog").isin("fact", "note")
    return _longs(vector.vector_branch(_mem(spark, d, vectors=True), _questions(spark, d, _ONE), eligible, limit=20, floor=100_000), "rank")


@query(SQL["vector_candidates"])
def vector_quantised(spark: SparkSession, d: str) -> DataFrame:
    """The same from stored bytes with error bounds; vectors are read of rows only that can be among the best."""
    path = _scratch(spark, "quantised")
    stored = vector.quantised(_mem(spark, d, vectors=True)).repartitionByRange("brain_id", "memory_id").sortWithinPartitions("brain_id", "memory_id")
    stored.write.option("parquet.page.row.count.limit", 256).parquet(path)
    return _longs(vector.vector_branch(spark.read.parquet(path), _questions(spark, d, _ONE), scan.is_live(NOW)), "rank")


@query(f"WITH {MEM}, {_MANY_SQL}, {_vector_sql()} SELECT query_id, memory_id, key, rank FROM vec")
def vector_blocks(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark questions, met with the rows in blocks as more questions than can be sent to every task would be."""
    q = batch_questions(spark, d).where("vector is not null").select("query_id", "brain_id", "vector")
    found = vector._in_blocks(_mem(spark, d, vectors=True).where(scan.is_live(NOW)), q, vector.BRANCH_LIMIT, vector.MICRO_COSINE_FLOOR)
    return _longs(lexical.ranked(found, [F.col("key").desc(), F.col("memory_id").asc()], vector.BRANCH_LIMIT), "rank")


_HYBRID_SQL = f"{_lexical_sql()}, {_vector_sql()}, {_FUSE}"


@query(f"WITH {MEM}, {POSTINGS}, {_ONE_SQL}, {_HYBRID_SQL} SELECT query_id, memory_id, {_ROUND}, lexical_rank, vector_rank, rank FROM best")
def rrf_rank(spark: SparkSession, d: str) -> DataFrame:
    found = search.rank(_mem(spark, d, vectors=True), _questions(spark, d, _ONE), now_ms=NOW)
    return _longs(found.withColumn("score", F.round("score", 9)), "lexical_rank", "vector_rank", "rank")


_SHOW_SQL = f"SELECT b.query_id, b.rank, {_PREVIEW_SQL.replace('memory_id', 'l.memory_id')} FROM best b JOIN live l USING (memory_id)"


@query(f"WITH {MEM}, {POSTINGS}, {_ONE_SQL}, {_HYBRID_SQL} {_SHOW_SQL}")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _longs(search.search(_mem(spark, d, vectors=True), _questions(spark, d, _ONE), now_ms=NOW), "rank")


@query(f"WITH {MEM}, {POSTINGS}, {_NO_TERMS_SQL}, {_HYBRID_SQL} {_SHOW_SQL}")
def hybrid_search_punct(spark: SparkSession, d: str) -> DataFrame:
    return _longs(search.search(_mem(spark, d, vectors=True), _questions(spark, d, _NO_TERMS), now_ms=NOW), "rank")


def batch_questions(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("item_id"), max(corpus.read(spark, d, "embeddings").count(), 1)
    q = corpus.read(spark, d, "benchmark").select(
        F.concat(F.lit("b"), F.lpad(i.cast("string"), 4, "0")).alias("query_id"), F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (i % 4 + 1).cast("int")).alias("brain_id"), "text", (i % n).alias("vec_id")
    )
    e = corpus.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return q.join(e, "vec_id", "left").select("query_id", "brain_id", "text", "vector")


@query(f"WITH {MEM}, {POSTINGS}, {_MANY_SQL}, {_HYBRID_SQL} SELECT query_id, memory_id, {_ROUND}, lexical_rank, vector_rank, rank FROM best")
def hybrid_search_batch(spark: SparkSession, d: str) -> DataFrame:
    found = search.rank(_mem(spark, d, vectors=True), batch_questions(spark, d), now_ms=NOW)
    return _longs(found.withColumn("score", F.round("score", 9)), "lexical_rank", "vector_rank", "rank")


# ------------------------------------------------------------------ time, payloads, retention


@query(f"WITH {MEM} SELECT memory_id, importance, expires_at_ms - created_at_ms AS ttl FROM mem")
def ttl_policy(spark: SparkSession, d: str) -> DataFrame:
    return _mem(spark, d).select("memory_id", "importance", clock.ttl_ms(F.col("importance")).alias("ttl"))


@query("SELECT event_id, strftime(timezone('Asia/Ho_Chi_Minh', timezone('UTC', ts)), '%Y-%m-%d') AS day FROM events")
def timeline_day_tz(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return corpus.read(spark, d, "events").select("event_id", clock.timeline_day(at, "Asia/Ho_Chi_Minh").alias("day"))


@query(f"WITH {MEM} SELECT memory_id, replace(topic, '-', ' ') || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS payload FROM mem")
def document_payload(spark: SparkSession, d: str) -> DataFrame:
    return _mem(spark, d).select("memory_id", text.document_payload(F.col("topic"), _whole()).alias("payload"))


def _lifecycle_sql(done: str, deleted: str, expires: str, removed: str = "false") -> str:
    return f"""WITH {MEM}, ttl AS (SELECT *, {NOW} + expires_at_ms - created_at_ms AS fresh, {done} AS done FROM mem)
SELECT brain_id, memory_id, CASE WHEN done THEN 'applied' ELSE 'not_found' END AS outcome, CASE WHEN done THEN {deleted} ELSE deleted_at_ms END AS deleted_at_ms,
  CASE WHEN done THEN {expires} ELSE expires_at_ms END AS expires_at_ms, {removed} AS removed FROM ttl"""


_IS_LIVE_SQL = f"(deleted_at_ms IS NULL AND expires_at_ms > {NOW})"


def _one(spark: SparkSession, d: str, op: str) -> DataFrame:
    return lifecycle.apply_one(_mem(spark, d), op, F.lit(True), now_ms=NOW)


@query(_lifecycle_sql(_IS_LIVE_SQL, "deleted_at_ms", "fresh"))
def reinforce(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "reinforce")


@query(_lifecycle_sql(_IS_LIVE_SQL, str(NOW), f"least(expires_at_ms, {NOW + 30 * DAY_MS})"))
def forget(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "forget")


@query(_lifecycle_sql(f"(deleted_at_ms IS NOT NULL AND deleted_at_ms > {NOW - 30 * DAY_MS})", "NULL::BIGINT", "fresh"))
def restore(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "restore")


@query(_lifecycle_sql("true", "deleted_at_ms", "expires_at_ms", "true"))
def hard_delete(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, d, "hard_delete")


def lifecycle_ops(spark: SparkSession, d: str) -> DataFrame:
    """Operations from events: many a key, in order of their time."""
    e = corpus.audit_events(spark, d).where("action <> 'remember'")
    number = F.substring("event_id", 2, 10).cast("long")
    docs = corpus.memories(spark, d, vectors=False).select("brain_id", "memory_id")
    return e.select(number.alias("op_seq"), "memory_id", F.col("action").alias("op"), F.lit(NOW).cast("long").alias("at_ms")).join(docs, "memory_id")


_FOLD_SQL = f"""
WITH RECURSIVE {MEM}, {AUDIT}, ops AS (
  SELECT memory_id, substr(event_id, 2)::BIGINT AS op_seq, action AS op, row_number() OVER (PARTITION BY memory_id ORDER BY event_id) AS i FROM audit WHERE action <> 'remember'
), steps AS (
  SELECT brain_id, memory_id, 0::BIGINT AS i, true AS there, deleted_at_ms AS d, expires_at_ms AS e, {NOW} + expires_at_ms - created_at_ms AS fresh, NULL::BIGINT AS op_seq, NULL::VARCHAR AS op, false AS done
  FROM mem WHERE memory_id IN (SELECT memory_id FROM ops)
  UNION ALL
  SELECT brain_id, memory_id, i, there AND NOT (done AND op = 'hard_delete'), CASE WHEN done AND op = 'forget' THEN {NOW} WHEN done AND op = 'restore' THEN NULL ELSE d END,
    CASE WHEN done AND op IN ('reinforce', 'restore') THEN fresh WHEN done AND op = 'forget' THEN least(e, {NOW + 30 * DAY_MS}) ELSE e END, fresh, op_seq, op, done
  FROM (SELECT s.brain_id, s.memory_id, o.i, s.there, s.d, s.e, s.fresh, o.op_seq, o.op, s.there AND CASE o.op WHEN 'restore' THEN s.d IS NOT NULL AND s.d > {NOW - 30 * DAY_MS}
      WHEN 'hard_delete' THEN true ELSE s.d IS NULL AND s.e > {NOW} END AS done FROM steps s JOIN ops o ON o.memory_id = s.memory_id AND o.i = s.i + 1)
)"""


@query(
    f"{_FOLD_SQL} SELECT brain_id, memory_id, true AS known, NOT arg_max(there, i) AS removed, last(d ORDER BY i) AS deleted_at_ms, arg_max(e, i) AS expires_at_ms, (count(*) - 1)::INT AS n_ops, (count(*) FILTER (done))::INT AS n_applied "
    "FROM steps GROUP BY brain_id, memory_id"
)
def lifecycle_fold(spark: SparkSession, d: str) -> DataFrame:
    folded = lifecycle.fold(_mem(spark, d), lifecycle_ops(spark, d))
    applied = F.size(F.filter("outcomes", lambda o: o["outcome"] == "applied"))
    return folded.select("brain_id", "memory_id", "known", "removed", "deleted_at_ms", "expires_at_ms", F.size("outcomes").alias("n_ops"), applied.alias("n_applied"))


@query(f"{_FOLD_SQL} SELECT brain_id, memory_id, 'engine' AS agent_id, op AS action, op_seq FROM steps WHERE done")
def audit_if_applied(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.audit_of(lifecycle.fold(_mem(spark, d), lifecycle_ops(spark, d)))


_PURGE_SQL = f"(expires_at_ms <= {NOW} OR (deleted_at_ms IS NOT NULL AND deleted_at_ms + {30 * DAY_MS} < {NOW}))"


@query(f"WITH {MEM} SELECT brain_id, memory_id FROM mem WHERE {_PURGE_SQL} ORDER BY expires_at_ms, brain_id, memory_id LIMIT 100")
def purge_expired(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.purge_expired(_mem(spark, d), now_ms=NOW, max_rows=100)[1]


@query(f"WITH {MEM}, gone AS (SELECT brain_id, memory_id FROM mem WHERE {_PURGE_SQL} ORDER BY expires_at_ms, brain_id, memory_id LIMIT 100) SELECT memory_id FROM mem WHERE memory_id NOT IN (SELECT memory_id FROM gone)")
def purge_survivors(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.purge_expired(_mem(spark, d), now_ms=NOW, max_rows=100)[0].select("memory_id")


_LATER = NOW + 80 * DAY_MS


@query(f"WITH {AUDIT} SELECT event_id FROM audit WHERE event_at_ms < {_LATER - 90 * DAY_MS} ORDER BY event_at_ms, event_id LIMIT 500")
def purge_audit(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.purge_audit(corpus.audit_events(spark, d), now_ms=_LATER)[1]


# ------------------------------------------------------------------ audit


@query(f"WITH {AUDIT} SELECT event_id, action, event_at_ms FROM audit WHERE brain_id = 'en' AND timeline_day = (SELECT min(timeline_day) FROM audit) ORDER BY event_at_ms DESC, event_id DESC LIMIT 50")
def audit_day(spark: SparkSession, d: str) -> DataFrame:
    e = corpus.audit_events(spark, d)
    day = e.agg(F.min("timeline_day")).first()[0]
    return scan.audit_day(e, day, brain_id=BRAIN, limit=50).select("event_id", "action", "event_at_ms")


@query(f"WITH {AUDIT} SELECT brain_id, action, count(*) AS n FROM audit GROUP BY ALL")
def audit_action_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.audit_events(spark, d).groupBy("brain_id", "action").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'detail.a.summary' WHEN 1 THEN 'detail.list[1].topic' WHEN 2 THEN 'not an object' END AS violation FROM events")
def audit_privacy(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id") % 5
    value = F.when(i == 0, '{"a":{"summary":1}}').when(i == 1, '{"list":[1,{"topic":"x"}]}').when(i == 2, "[1]").otherwise(F.col("props"))
    return corpus.read(spark, d, "events").select("event_id", jsons.audit_violation(value).alias("violation"))


# ------------------------------------------------------------------ import


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("memory_id", 2, 8).cast("long")
    return _mem(spark, d).withColumn("topic", F.when(n % 10 == 4, F.lit("changed")).otherwise(F.col("topic"))).withColumn("seq", n + 1)


def _existing(spark: SparkSession, d: str) -> DataFrame:
    return _mem(spark, d).where(F.substring("memory_id", 2, 8).cast("long") % 2 == 0)


_STATUS_SQL = f"CASE WHEN expires_at_ms <= {NOW} THEN 'expired' WHEN doc_id % 2 = 1 THEN 'insert' WHEN doc_id % 10 = 4 THEN 'conflict' ELSE 'skip' END"


@query(f"WITH {MEM} SELECT brain_id, memory_id, {_STATUS_SQL} AS status FROM mem")
def import_classify(spark: SparkSession, d: str) -> DataFrame:
    return imports.classify_memories(_incoming(spark, d), _existing(spark, d), started_ms=NOW).select("brain_id", "memory_id", "status")


@query(f"WITH {MEM} SELECT memory_id FROM mem WHERE expires_at_ms <= {NOW}")
def import_expired_skip(spark: SparkSession, d: str) -> DataFrame:
    return imports.classify_memories(_incoming(spark, d), _existing(spark, d), started_ms=NOW).where("status = 'expired'").select("memory_id")


@query(f"WITH {MEM}, s AS (SELECT {_STATUS_SQL} AS status FROM mem) SELECT count(*) FILTER (status = 'insert') AS imported, count(*) FILTER (status IN ('skip', 'expired')) AS skipped, count(*) FILTER (status = 'conflict') AS failed FROM s")
def import_counters(spark: SparkSession, d: str) -> DataFrame:
    return imports.counters(imports.classify_memories(_incoming(spark, d), _existing(spark, d), started_ms=NOW))


@query(f"WITH {AUDIT}, i AS (SELECT *, substr(event_id, 2)::BIGINT AS n FROM audit) SELECT event_id, CASE WHEN n % 3 = 1 THEN 'insert' WHEN n % 7 = 2 AND action <> 'forget' THEN 'conflict' ELSE 'skip' END AS status FROM i")
def import_classify_audit(spark: SparkSession, d: str) -> DataFrame:
    e = corpus.audit_events(spark, d)
    n = F.substring("event_id", 2, 10).cast("long")
    incoming = e.withColumn("action", F.when(n % 7 == 2, F.lit("forget")).otherwise(F.col("action"))).withColumn("seq", n)
    return imports.classify_audit(incoming, e.where(n % 3 != 1)).select("event_id", "status")


@query("SELECT doc_id, sha256('{\"id\":' || doc_id || ',\"source\":\"' || source || '\"}') AS payload_sha256 FROM documents")
def payload_sha256(spark: SparkSession, d: str) -> DataFrame:
    payload = F.concat(F.lit('{"source":"'), F.col("source"), F.lit('", "id": '), F.col("doc_id").cast("string"), F.lit("}"))
    return corpus.read(spark, d, "documents").select("doc_id", F.sha2(jsons.canonical_json(payload).cast("binary"), 256).alias("payload_sha256"))


@query(f"WITH {MEM} SELECT memory_id, 'memory:' || brain_id || ':' || memory_id AS idempotency_key FROM mem")
def idempotency_keys(spark: SparkSession, d: str) -> DataFrame:
    return _mem(spark, d).select("memory_id", imports.idempotency_key("memory", F.col("brain_id"), F.col("memory_id")).alias("idempotency_key"))


@query(f"WITH {MEM} SELECT memory_id, greatest(0, expires_at_ms - {NOW}) AS remaining, abs((doc_id % 5 - 2) * 600) <= 1000 AS ok FROM mem")
def remaining_ttl_check(spark: SparkSession, d: str) -> DataFrame:
    """What is left at an export, and whether a recorded value that is off by 0, 600 or 1200 ms is within tolerance."""
    n = F.substring("memory_id", 2, 8).cast("long")
    left = imports.remaining_ttl(F.col("expires_at_ms"), NOW)
    recorded = F.greatest(F.lit(0).cast("long"), F.col("expires_at_ms") - NOW) + (n % 5 - 2) * 600
    return _mem(spark, d).select("memory_id", left.alias("remaining"), imports.ttl_agrees(recorded, F.col("expires_at_ms"), NOW).alias("ok"))


@query(f"WITH {MEM} SELECT brain_id, (row_number() OVER (PARTITION BY brain_id ORDER BY memory_id))::BIGINT AS seq, memory_id, summary, content, greatest(0, expires_at_ms - {NOW}) AS remaining_ttl_ms FROM mem")
def line_sortedness(spark: SparkSession, d: str) -> DataFrame:
    """Exports of each brain, written and read back with full validation: contiguous, sorted lines, numbered on from file to file."""
    target = _scratch(spark, "exports")
    jsonl.write_exports(_mem(spark, d), target, exported_at_ms=NOW)
    files = f"{target}/*/part-*"
    found = jsonl.read_exports(spark, files)[0].join(F.broadcast(jsonl.records_before(spark, files)), "export_id")  # a row a file
    return found.select("brain_id", (F.col("seq") + F.col("before")).alias("seq"), "memory_id", "summary", "content", "remaining_ttl_ms")


# ------------------------------------------------------------------ constraints and metrics


@query(
    f"WITH {MEM} SELECT 'importance_range' AS rule, count(*) AS n FROM mem WHERE doc_id % 50 = 7 HAVING count(*) > 0 "
    "UNION ALL SELECT 'metadata_object', count(*) FROM mem WHERE doc_id % 40 = 3 HAVING count(*) > 0 UNION ALL SELECT 'topic_filled', count(*) FROM mem WHERE doc_id % 30 = 5 HAVING count(*) > 0 "
    "UNION ALL SELECT 'updated_after_created', count(*) FROM mem WHERE doc_id % 25 = 6 HAVING count(*) > 0"
)
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("memory_id", 2, 8).cast("long")
    broken = _mem(spark, d).withColumns(
        {
            "importance": F.when(n % 50 == 7, 9).otherwise(F.col("importance")),
            "metadata": F.when(n % 40 == 3, "[1]").otherwise(F.col("metadata")),
            "topic": F.when(n % 30 == 5, " \t").otherwise(F.col("topic")),
            "updated_at_ms": F.when(n % 25 == 6, F.col("created_at_ms") - 1).otherwise(F.col("updated_at_ms")),
        }
    )
    return constraints.counted(broken, constraints.memory_rules())


@query(f"WITH {MEM} SELECT memory_id FROM mem WHERE doc_id % 11 = 0")
def fk_check(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("memory_id", 2, 8).cast("long")
    m = _mem(spark, d).withColumn("profile_id", F.when(n % 11 == 0, "gone").otherwise(F.col("profile_id")))
    return constraints.orphans(m, spark.createDataFrame([(corpus.PROFILE,)], "profile_id string")).select("memory_id")


@query(f"WITH {MEM}, {POSTINGS} SELECT 'missing' AS side, brain_id, memory_id, term, tf, len FROM posts WHERE term = 'the' AND memory_id LIKE '%5'")
def index_parity(spark: SparkSession, d: str) -> DataFrame:
    m = _mem(spark, d)
    index = lexical.postings(m).where(~((F.col("term") == "the") & F.col("memory_id").endswith("5")))
    return constraints.index_parity(m, index).select("side", "brain_id", "memory_id", "term", "tf", "len")


@query(f"WITH {MEM} SELECT count(*) AS memories, count(*) FILTER (doc_id % 11 = 0) AS orphans, count(*) FILTER (doc_id % 13 = 0) AS without_vector, 1::BIGINT AS profiles FROM mem")
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("memory_id", 2, 8).cast("long")
    broken = _mem(spark, d, vectors=True).withColumns({"profile_id": F.when(n % 11 == 0, "gone").otherwise(F.col("profile_id")), "embedding": F.when(n % 13 != 0, F.col("embedding"))})
    return constraints.integrity(broken, spark.createDataFrame([(corpus.PROFILE,)], "profile_id string"))


@query("SELECT dimension, CASE WHEN dimension = (SELECT max(len(embedding)) FROM embeddings) THEN 'same' ELSE 'mismatch' END AS state FROM (SELECT unnest([8, 64, 640]) AS dimension)")
def profile_check(spark: SparkSession, d: str) -> DataFrame:
    """A profile of the tables' own dimension against wanted ones."""
    own = corpus.read(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    stored = spark.createDataFrame([(corpus.PROFILE, "r1", 2, own)], "profile_id string, revision string, input_version int, dimension int")

    def state(dimension: int) -> str:
        try:
            return constraints.register_profile(stored, {"profile_id": corpus.PROFILE, "dimension": dimension})
        except ProfileMismatchError:
            return "mismatch"

    return spark.createDataFrame([(n, state(n)) for n in (8, 64, 640)], "dimension int, state string")


@query(f"WITH {AUDIT} SELECT 'action_known' AS rule, count(*) AS n FROM audit WHERE substr(event_id, 2)::BIGINT % 7 = 3 HAVING count(*) > 0 UNION ALL SELECT 'day_shape', count(*) FROM audit WHERE substr(event_id, 2)::BIGINT % 5 = 1 HAVING count(*) > 0")
def audit_rule_violations(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("event_id", 2, 10).cast("long")
    broken = corpus.audit_events(spark, d).withColumns(
        {"action": F.when(n % 7 == 3, "seen").otherwise(F.col("action")), "timeline_day": F.when(n % 5 == 1, F.concat("timeline_day", F.lit("\n"))).otherwise(F.col("timeline_day"))}
    )
    return constraints.counted(broken, constraints.audit_rules())


@query("SELECT rule, count(*) AS n FROM (SELECT unnest(CASE o_orderkey % 4 WHEN 0 THEN ['sha_shape'] WHEN 1 THEN ['status_known'] WHEN 2 THEN ['counters', 'running_is_open'] ELSE [] END) AS rule FROM orders) GROUP BY rule")
def import_run_violations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    runs = corpus.read(spark, d, "orders").select(
        F.when(k == 0, "ABC").otherwise(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("artifact_sha256"),
        F.when(k == 1, "lost").when(k == 2, "running").otherwise("completed").alias("status"),
        F.lit(NOW).alias("completed_at_ms"),
        F.when(k == 2, -1).otherwise(0).alias("imported_count"),
        *(F.lit(0).alias(c) for c in ("last_committed_seq", "skipped_count", "failed_count")),
    )
    return constraints.counted(runs, constraints.import_run_rules())


@query("SELECT vec_id, vec_id % 5 = 4 AS ok FROM embeddings")
def malformed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Of five vectors one is kept; the others are missing, cut, zero or hold a NaN."""
    v, k = F.col("embedding").cast("array<float>"), F.col("vec_id") % 5
    e = corpus.read(spark, d, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0]
    broken = F.when(k == 0, F.lit(None)).when(k == 1, F.slice(v, 1, 3)).when(k == 2, F.transform(v, lambda x: x * 0)).when(k == 3, F.transform(v, lambda x, i: F.when(i == 1, F.lit(float("nan"))).otherwise(x))).otherwise(v)
    return e.select("vec_id", F.coalesce(vectors.well_formed(broken.cast("array<float>"), size), F.lit(False)).alias("ok"))


_JUDGED_SQL = f"""
WITH {MEM}, {POSTINGS}, {_MANY_SQL}, {_lexical_sql()}, {_vector_sql()}, {_FUSE},
judged AS (SELECT query_id, memory_id, (substr(memory_id, 2)::BIGINT + substr(query_id, 2)::BIGINT) % 4 AS grade FROM (SELECT DISTINCT query_id, memory_id FROM best UNION SELECT query_id, 'm00000001' FROM q)),
hit AS (SELECT j.*, b.rank, row_number() OVER (PARTITION BY j.query_id ORDER BY grade DESC, j.memory_id) AS ideal FROM judged j LEFT JOIN best b USING (query_id, memory_id)),
per AS (SELECT query_id, count(*) FILTER (grade >= 1) AS n, count(*) FILTER (grade >= 1 AND rank <= 5) AS found, min(rank) FILTER (grade >= 1) AS first,
  coalesce(sum(grade / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg, sum(grade / log2(ideal + 1)) FILTER (ideal <= 10) AS idcg FROM hit GROUP BY query_id)
SELECT round(avg(CASE WHEN n > 0 THEN found / least(5, n) ELSE 0 END), 9) AS recall, round(avg(coalesce(1.0 / first, 0)), 9) AS mrr, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 9) AS ndcg FROM per
"""


@query(_JUDGED_SQL)
def recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    q = batch_questions(spark, d)
    # What is found is judged and measured: it is written, so that the search runs once.
    path = _scratch(spark, "ranking")
    search.rank(_mem(spark, d, vectors=True), q, now_ms=NOW).select("query_id", F.col("memory_id").alias("doc_id"), "rank").write.parquet(path)
    ranking = spark.read.parquet(path)
    grade = (F.substring("doc_id", 2, 8).cast("long") + F.substring("query_id", 2, 8).cast("long")) % 4
    judged = ranking.select("query_id", "doc_id").union(q.select("query_id", F.lit("m00000001"))).distinct().withColumn("grade", grade)
    return metrics.quality(ranking, judged).select(*(F.round(c, 9).alias(c) for c in ("recall", "mrr", "ndcg")))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.latency(corpus.read(spark, d, "events"), "value", ["event_type"])
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query("SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, true AS within FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of all days merged from a sketch a day, and whether each one's exact rank is within the sketch's error."""
    e = corpus.read(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    kept = metrics.daily_sketches(e, "value", "day", ["event_type"])
    merged = metrics.merged_latency(kept, "day", "0000-01-01", "9999-12-31", ["event_type"])
    points = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    ranks = e.where("value is not null").join(F.broadcast(merged), "event_type")  # a row for each type of event
    below = [F.avg((F.col("value") < F.col(c)).cast("double")).alias(f"_{c}") for c, _ in points]
    upto = [F.avg((F.col("value") <= F.col(c)).cast("double")).alias(f"{c}_") for c, _ in points]
    near = F.lit(True)
    for c, p in points:
        near &= (F.col(f"_{c}") - 0.03 <= p) & (F.col(f"{c}_") + 0.03 >= p)
    return ranks.groupBy("event_type", "n", "low", "high").agg(*below, *upto).select("event_type", "n", "low", "high", near.alias("within"))


@query("SELECT event_id, replace(props, ' ', '') AS canonical, replace(props, ' ', '') AS stored FROM events")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    return corpus.read(spark, d, "events").select("event_id", jsons.canonical_json("props").alias("canonical"), jsons.stored_json("props").alias("stored"))


@query()
def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    m = _mem(spark, d)
    return m.select("memory_id", embedding.embed(text.document_payload(F.col("topic"), _whole())).alias("embedding"))


@query(f"WITH {MEM} SELECT brain_id, memory_id FROM mem WHERE expires_at_ms > {NOW}")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Memories written as a file stream's batches, then read back."""
    from engram.streaming.ingest import ingest

    target = _scratch(spark, "stream")
    _mem(spark, d).where(F.col("expires_at_ms") > NOW).write.parquet(f"{target}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{target}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{target}/in")
    ingest(source, f"{target}/out", f"{target}/state", started_ms=NOW).awaitTermination()
    return spark.read.parquet(f"{target}/out").select("brain_id", "memory_id")


#: Rows of a file of that stream, where they are many, and files of a batch at most.
REPEAT_ROWS, REPEAT_FILES = 20_000, 64


@query(f"WITH {MEM} SELECT brain_id, memory_id FROM mem WHERE expires_at_ms > {NOW}")
def stream_repeats(spark: SparkSession, d: str) -> DataFrame:
    """A stream in which every memory comes twice, some of them expired: what is written is each live one, once."""
    from engram.streaming.ingest import ingest

    target = _scratch(spark, "repeats")
    m = _mem(spark, d)
    files = max(4, -(-m.count() // REPEAT_ROWS))
    for part in ("a", "b"):
        m.repartition(files, "memory_id").write.parquet(f"{target}/in/{part}")
    source = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", min(files // 2, REPEAT_FILES)).parquet(f"{target}/in/*")
    ingest(source, f"{target}/out", f"{target}/state", started_ms=NOW).awaitTermination()
    return spark.read.parquet(f"{target}/out").select("brain_id", "memory_id")
