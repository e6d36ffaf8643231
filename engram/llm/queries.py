"""The registered query of each corpus operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped_lines")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.fingerprints import compare_with_edit

    return compare_with_edit(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), size=3, percent=90)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.neighbours import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", "text", "copy")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.secrets import digest, scan_secrets

    return digest(scan_secrets(table(spark, sf_dir, "documents")))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.chat import format_chats, read_back

    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    return read_back(*format_chats(chats.unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.clusters import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("scans")


def queries() -> dict[str, Query]:
    numbered = (op1_lines, op2_fingerprints, op3_packing, op4_jaccard, op5_toxicity, op6_neighbours, op7_mixing, op8_passages, op9_licenses, op10_secrets, op11_trie, op12_chat, op13_clusters)
    return {f.__name__: f for f in numbered}


#: Budgets, seeds and the temperature are those of the operator's defaults.
_OP7 = """
WITH stats AS (
  SELECT source AS s, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source
), whole AS (
  SELECT sum(pow(size, 0.7)) AS w, sum(size) AS n FROM stats
), rates AS (
  SELECT s, CASE WHEN size > 0 THEN pow(size, 0.7) / w * n / size ELSE 1.0 END AS rate FROM stats, whole
), terms AS (
  SELECT s, k, exp(-rate) * pow(rate, k) / gamma(k + 1) AS p FROM rates, range(0, 60) r(k)
), cdf AS (
  SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms
), drawn AS (
  SELECT *, ('0x' || substr(md5('mix:' || doc_id::VARCHAR || '/1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents
), counted AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, d.u, count(c.k) AS n
  FROM drawn d JOIN cdf c ON c.s IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY ALL
)
SELECT doc_id, source, lang, n_chars, text, unnest(range(1, n + 1))::INTEGER AS "copy" FROM counted
"""


_OP1 = r"""
WITH parts AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
), lines AS (
  SELECT doc_id, no, line, NOT regexp_full_match(line, '[\s[:cntrl:]]*') AS solid FROM parts
), uniq AS (
  SELECT line, length(line) AS n, string_split(line, '') AS c, min((doc_id, no)) AS pos FROM lines WHERE solid GROUP BY line
), long AS (SELECT * FROM uniq WHERE n >= 16
), pairs AS (
  SELECT b.line, a.c AS ac, b.c AS bc FROM long a JOIN long b ON a.n = b.n AND a.pos < b.pos
), longer AS (
  SELECT a.line AS la, b.line AS lb, a.pos AS pa, b.pos AS pb, a.c AS ac, b.c AS bc,
    coalesce(list_position(list_transform(list_zip(a.c[:b.n], b.c), lambda x: x[1] <> x[2]), true), b.n + 1) AS cut
  FROM long a JOIN long b ON a.n = b.n + 1
), near AS (
  SELECT line FROM pairs WHERE len(list_filter(list_zip(ac, bc), lambda x: x[1] <> x[2])) = 1
  UNION SELECT CASE WHEN pa < pb THEN lb ELSE la END FROM longer WHERE ac[cut + 1:] = bc[cut:]
), kept AS (
  SELECT l.doc_id, l.no, l.line, NOT solid OR ((l.doc_id, l.no) = u.pos AND l.line NOT IN (SELECT line FROM near)) AS stays
  FROM lines l LEFT JOIN uniq u ON l.line = u.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (stays), '') AS text, count(*) FILTER (NOT stays) AS n_dropped_lines
FROM kept GROUP BY doc_id
"""


#: Checksums bit by bit; a node is the sequence of its first turns, written out.
_OP11 = """
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM own)
), rows AS (
  SELECT v.c, o.k AS d, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.k <= v.h
  UNION ALL
  SELECT v.c, o.k - v.h + least(v.h, (SELECT count(*) FROM own b WHERE b.c = v.base)), o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.k > v.h
), seqs AS (
  SELECT c, list(struct_pack(role, text) ORDER BY d) AS s FROM rows GROUP BY c
), members AS (
  SELECT c, coalesce(len(s), 0) AS n, unnest(range(coalesce(len(s), 0) + 1)) AS d, s FROM convs LEFT JOIN seqs USING (c)
), prefixes AS (
  SELECT c, n, d, CASE WHEN d = 0 THEN '' ELSE sha256(s[1:d]::VARCHAR || to_json(s[1:d])::VARCHAR) END AS id,
    CASE WHEN d > 0 THEN CASE WHEN d = 1 THEN '' ELSE sha256(s[1:d - 1]::VARCHAR || to_json(s[1:d - 1])::VARCHAR) END END AS up,
    CASE WHEN d > 0 THEN length(s[d].text) ELSE 0 END AS chars FROM members
), nodes AS (
  SELECT id, d, min(up) AS up, min(c) AS owner, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '')) AS ends FROM prefixes GROUP BY id, d
), kids AS (
  SELECT up AS id, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up
), under AS (
  SELECT DISTINCT p.id, q.id AS below FROM prefixes p JOIN prefixes q ON p.c = q.c AND q.d >= p.d
), sums AS (
  SELECT under.id, sum(b.saved)::BIGINT AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM under JOIN nodes b ON b.id = below LEFT JOIN kids k ON k.id = below GROUP BY under.id
)
SELECT n.owner AS conv_id, n.d::BIGINT AS depth, u.owner AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.id = n.id LEFT JOIN kids k ON k.id = n.id LEFT JOIN nodes u ON u.id = n.up
"""


def _escape(col: str) -> str:
    out = f"replace({col}, chr(92), repeat(chr(92), 2))"
    for c in ("<s>", "</s>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


_OP12 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(20 + length({_escape("role")}) + length({_escape("text")}))::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined
"""


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    at = "list_sum(list_transform(list_zip(x, q), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT"
    parts = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x AS q FROM kept QUALIFY c < {k}
)"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, min(vec_id) AS vec_id, min((d, c)) AS best, min(x) AS x
  FROM (SELECT rid, vec_id, c, x, {at} AS d FROM (SELECT row_number() OVER () AS rid, * FROM kept), c{r}) GROUP BY rid
)""")
        if r < rounds:
            parts.append(f"""s{r} AS (
  SELECT best[2] AS c, j, sum(v) AS s, count(*) AS n FROM (SELECT best, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM a{r}) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(m, q) AS q FROM c{r} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM s{r} GROUP BY c) USING (c)
)""")
    last = f"""
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
  (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best[2]"""
    return ", ".join(parts) + last


def oracle_sql() -> dict[str, str]:
    return {"op1_lines": _OP1, "op7_mixing": _OP7, "op11_trie": _OP11, "op12_chat": _OP12, "op13_clusters": _clusters_sql()}
