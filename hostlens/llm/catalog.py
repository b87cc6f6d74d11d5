"""Registered queries of the pipeline operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm.centroid_search import cluster_vectors
from hostlens.llm.common import LOWER, UPPER, WORD, table
from hostlens.llm.cover_anchors import remove_repeats
from hostlens.llm.deobfuscation import fit_toxicity, score_toxicity
from hostlens.llm.kernel_langid import fit_languages, kept_back, predict_languages
from hostlens.llm.link_trust import CUT_EVERY, DAMPING, LINK, TOLERANCE, judge_urls
from hostlens.llm.mixing import mix_plan
from hostlens.llm.multiset_hash import edited_fingerprints
from hostlens.llm.partenum import similar_components
from hostlens.llm.piece_codec import Vocabulary, decode_documents, encode_documents
from hostlens.llm.sharding import shard_documents
from hostlens.llm.source_divergence import LEAST_DOCUMENTS, TOP_TERMS, UNIT, source_divergence
from hostlens.llm.streaming_dedup import streaming_dedup
from hostlens.llm.template_lines import BLANK_FREE, drop_recurring_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

AZ = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def query(key: str, sql: str | None = None):
    def register(run):
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return run

    return register


@query("op1_streaming_dedup", f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256({AZ}) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY {AZ})
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming_dedup(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


MIX = {"target_entropy": 0.97, "repetition_limit": 1.5, "seed": 17}
_STEPS = "SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL"


@query("op2_temperature_mixing", f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) + 1 AS tokens,
    md5(coalesce(text, '')) AS h
  FROM documents
), sizes AS (
  SELECT source, count(*) AS n, sum(tokens)::BIGINT AS t FROM rows GROUP BY source
), shares AS (
  SELECT list(t / (SELECT sum(t) FROM sizes)::DOUBLE) AS p, (max(t) / min(t))::DOUBLE AS steep
  FROM sizes
), e AS ({_STEPS}
  SELECT step + 1,
    CASE WHEN good THEN (low + high) / 2 ELSE low END,
    CASE WHEN good THEN high ELSE (low + high) / 2 END
  FROM (SELECT *,
    ln(list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2))))
      - (low + high) / 2 * list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2) * ln(x)))
      / list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2)))
      >= {MIX["target_entropy"]} * ln(len(p)) AS good
    FROM e, shares WHERE step < 40)
), r AS ({_STEPS}
  SELECT step + 1,
    CASE WHEN often THEN (low + high) / 2 ELSE low END,
    CASE WHEN often THEN high ELSE (low + high) / 2 END
  FROM (SELECT *, pow(steep, 1 - (low + high) / 2) > {MIX["repetition_limit"]} AS often
    FROM r, shares WHERE step < 40)
), x AS (
  SELECT greatest(
    (SELECT CASE WHEN high = 1.0 THEN 1.0 ELSE floor(low * 1e6) / 1e6 END FROM e WHERE step = 40),
    (SELECT least(1.0, ceil(high * 1e6) / 1e6) FROM r WHERE step = 40)) AS exponent
), plan AS (
  SELECT source, n, t, exponent, ceil(sqrt(n))::BIGINT AS blocks, greatest(t, round(
    t * pow((SELECT max(t) FROM sizes)::DOUBLE / t, 1 - exponent))::BIGINT) AS budget_tokens
  FROM sizes, x
), slots AS (
  SELECT r.doc_id, r.source, r.tokens, r.h, p.t, p.exponent, p.budget_tokens,
    unnest(range(ceil(p.budget_tokens / p.t)::BIGINT)) AS epoch,
    ('0x' || substr(md5(concat_ws(':', '{MIX["seed"]}', 'block', coalesce(
      r.doc_id::VARCHAR, 'null'), r.h)), 1, 8))::BIGINT % p.blocks AS block
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
), keyed AS (
  SELECT *,
    md5(concat_ws(':', '{MIX["seed"]}', epoch::VARCHAR, coalesce(source, 'null'), block::VARCHAR))
      AS block_key,
    md5(concat_ws(':', '{MIX["seed"]}', epoch::VARCHAR, coalesce(doc_id::VARCHAR, 'null'), h))
      AS row_key
  FROM slots
), placed AS (
  SELECT *, dense_rank() OVER (PARTITION BY source, epoch ORDER BY block_key, block) AS block_rank,
    epoch * t + coalesce(sum(tokens) OVER (PARTITION BY source, epoch
      ORDER BY block_key, block, row_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS token_offset
  FROM keyed
)
SELECT doc_id, source, epoch, block_rank, token_offset::BIGINT AS token_offset,
       tokens AS n_tokens, exponent, budget_tokens
FROM placed WHERE token_offset < budget_tokens
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, placed = mix_plan(table(spark, sf_dir, "documents"), **MIX)
    return placed.select("doc_id", "source", "epoch", "block_rank", "token_offset", "n_tokens",
                         "exponent", "budget_tokens")


@query("op4_minimax_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_piece_codec")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, model).select("doc_id", "ids")
    return decode_documents(coded, model).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_multiset_hash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


# fixed by the contract of the query
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


# the same steps by recursion, looked at every CUT_EVERY of them; then the last one
_RANK_SQL = f"""spread AS (
  SELECT 0 AS step, kind, host, seed AS rank, 0.0::DOUBLE AS old FROM seeds
  UNION ALL
  SELECT step + 1, kind, host, sum(rank), sum(old) FROM (
    SELECT r.step, f.kind, f.dst AS host, r.rank * f.share * {DAMPING} AS rank, 0.0::DOUBLE AS old
    FROM flow f JOIN spread r ON f.src = r.host AND f.kind = r.kind
    UNION ALL SELECT (SELECT any_value(step) FROM spread), kind, host, seed * {1 - DAMPING}, 0.0
    FROM seeds
    UNION ALL SELECT step, kind, host, 0.0, rank FROM spread)
  WHERE NOT (SELECT coalesce(any_value(step) > 0 AND any_value(step) % {CUT_EVERY} = 0
    AND sum(abs(rank - old)) < {TOLERANCE}, true) FROM spread)
  GROUP BY step, kind, host
), ranks AS (
  SELECT host, sum(rank) FILTER (kind = 'trust') AS trust,
    sum(rank) FILTER (kind = 'distrust') AS distrust
  FROM spread WHERE step = (SELECT max(step) FROM spread) GROUP BY host
)"""


_HOST = "regexp_extract({0}, '://([^/?#]*)', 1)"
_LINK_SQL = LINK.removeprefix("(?i)").replace("'", "''")


@query("op5_link_trust", f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, translate({_HOST.format("url")}, '{UPPER}', '{LOWER}') AS host,
    regexp_extract(url, '://[^/?#]*(/[^?#]*)?', 1) AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}
), judged AS (
  SELECT page_id, any_value(u.host) AS host, any_value(path) AS path,
    arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM u LEFT JOIN rules r
    ON (u.host = rule_host OR u.host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
  GROUP BY page_id
), links AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '{_LINK_SQL}', 1, 'i')) AS link FROM u
), linked AS (
  SELECT src, translate({_HOST.format("CASE WHEN link LIKE '//%' THEN ':' || link ELSE link END")},
    '{UPPER}', '{LOWER}') AS dst
  FROM links WHERE link LIKE '%//%'
), parts AS (
  SELECT DISTINCT string_split(host, '.') AS labels FROM u WHERE host <> ''
), steps AS (
  SELECT DISTINCT array_to_string(labels[k:], '.') AS child,
    array_to_string(labels[k + 1:], '.') AS parent
  FROM (SELECT labels, unnest(range(1, len(labels) - 1)) AS k FROM parts)
), edges AS (
  SELECT src, dst, sum(w)::DOUBLE AS weight FROM (
    SELECT src, dst, 1 AS w FROM linked WHERE src <> '' AND dst <> '' AND src <> dst
    UNION ALL SELECT child, parent, 1 FROM steps UNION ALL SELECT parent, child, 1 FROM steps)
  GROUP BY src, dst
), flow AS (
  SELECT 'trust' AS kind, src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL
  SELECT 'distrust', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM edges
), seeds AS (
  SELECT CASE rule_verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host,
    count(*) / (SELECT count(*) FROM judged k WHERE k.rule_verdict = j.rule_verdict) AS seed
  FROM judged j WHERE rule_verdict IS NOT NULL GROUP BY rule_verdict, host
), {_RANK_SQL}
SELECT page_id, j.host, path, rule, coalesce(rule_verdict,
    CASE WHEN round(coalesce(trust, 0) - coalesce(distrust, 0), 12) < 0 THEN 'block'
    ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
FROM judged j LEFT JOIN ranks r ON j.host = r.host
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op10_cover_anchors", f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), wins AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS start, words FROM w WHERE len(words) >= 13
), keyed AS (
  SELECT doc_id, start, md5(array_to_string(words[start:start + 12], ' ')) AS k FROM wins
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 13)) AS pos
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS low FROM keyed) WHERE low < doc_id
), gone AS (
  SELECT doc_id, list(pos) AS pos FROM covered GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(pos), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda x, i:
    pos IS NULL OR NOT list_contains(pos, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_partenum_join", f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({AZ}, '{WORD}') AS words FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5
    THEN [hash(array_to_string(words, ' '))] ELSE list_distinct(list_transform(
      range(1, len(words) - 3), lambda k: hash(array_to_string(words[k:k + 4], ' ')))) END AS grams
  FROM w
), e AS (SELECT doc_id, unnest(grams) AS gram FROM g
), hits AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), linked AS (
  SELECT a, b FROM hits JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b
  WHERE 100 * common >= 80 * (len(x.grams) + len(y.grams) - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
)
SELECT g.doc_id, len(grams)::BIGINT AS n_shingles, low AS component_id
FROM g JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON g.doc_id = r.a
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


_SPACED = (f"regexp_replace(regexp_replace(line, '({BLANK_FREE})([0-9])', '\\1 \\2', 'g'), "
           f"'([0-9])({BLANK_FREE})', '\\1 \\2', 'g')")
_LEAD = ("array_to_string(list_transform(string_split(spaced, ' ')[1:3], lambda t: "
         "CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ')")


@query("op7_template_lines", f"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), led AS (
  SELECT doc_id, text, pos, line, spaced, len(string_split(spaced, ' ')) || ' ' || {_LEAD} AS leaf
  FROM (SELECT *, {_SPACED} AS spaced FROM l) WHERE regexp_matches(line, '[^ \t\n\v\f\r]')
), h AS (
  SELECT *, list_min(list_transform(regexp_extract_all(line, '[^ ]+(?: +[^ ]+){{0,3}}'),
    lambda c: left(md5(c), 16))) AS h
  FROM led
), f AS (
  SELECT doc_id, min({{'h': h, 'line': line}}) AS top FROM h GROUP BY doc_id
), f2 AS (
  SELECT doc_id, min(h.h) AS second FROM h JOIN f USING (doc_id)
  WHERE line <> f.top.line GROUP BY doc_id
), lines AS MATERIALIZED (
  SELECT h.doc_id, pos, line, spaced, leaf, CASE WHEN line = f.top.line
    THEN coalesce(second, left(md5(text), 16)) ELSE f.top.h END AS family
  FROM h JOIN f ON h.doc_id = f.doc_id LEFT JOIN f2 ON h.doc_id = f2.doc_id
), found AS MATERIALIZED (
  SELECT * FROM lines WHERE leaf IN (
    SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT family) >= 10)
), same AS MATERIALIZED (
  SELECT line FROM found GROUP BY line HAVING count(DISTINCT family) >= 10
), varied AS MATERIALIZED (SELECT * FROM found WHERE line NOT IN (SELECT line FROM same)
), tokens AS (
  SELECT leaf, line, family, unnest(string_split(spaced, ' ')) AS token,
    generate_subscripts(string_split(spaced, ' '), 1) AS i
  FROM (SELECT DISTINCT leaf, line, spaced, family FROM varied)
), constants AS (
  SELECT leaf, i, token FROM tokens WHERE NOT regexp_matches(token, '[0-9]')
  GROUP BY leaf, i, token HAVING count(DISTINCT family) >= 10
), parsed AS (
  SELECT t.line, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY t.i) AS template
  FROM (SELECT DISTINCT leaf, line, i, token FROM tokens) t
  LEFT JOIN constants c ON t.leaf = c.leaf AND t.i = c.i AND t.token = c.token
  GROUP BY t.line HAVING 5 * count(c.token) >= 2 * count(*) AND 4 * count(c.token) >= 3 *
    count(*) FILTER (NOT regexp_matches(t.token, '[0-9]') OR regexp_matches(t.token, '\\p{{L}}'))
), placed AS (
  SELECT v.*, p.template FROM varied v JOIN parsed p ON v.line = p.line
), gone AS (
  SELECT doc_id, pos FROM placed WHERE template IN (
    SELECT template FROM placed GROUP BY template HAVING count(DISTINCT family) >= 10)
  UNION ALL SELECT doc_id, pos FROM found WHERE line IN (SELECT line FROM same)
)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped, sha256(coalesce(
  string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), ''))
  AS kept_sha256
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@query("op6_deobfuscation")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score_toxicity(docs, fit_toxicity(docs, labels), out_col="score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


CLUSTERS = {"k": 16, "rounds": 3, "size": 64, "seed": 1}


def _rounds_sql() -> str:
    """Assignment and update of each round; the last assignment is `a` with the round's number."""
    steps = []
    for t in range(CLUSTERS["rounds"] + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS hit FROM (
    SELECT rid, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i:
      (v[i] - cv[i]) * (v[i] - cv[i])))::BIGINT AS d FROM kept, c{t}) GROUP BY rid)""")
        if t < CLUSTERS["rounds"]:
            steps.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT c{t}.c, CASE WHEN any_value(m.n) IS NULL THEN any_value(cv)
    ELSE list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) END AS cv
  FROM c{t} LEFT JOIN (
    SELECT hit.c AS c, i, count(*)::HUGEINT AS n, sum(v[i])::HUGEINT AS s
    FROM a{t}, range(1, 65) r(i) GROUP BY ALL) m ON m.c = c{t}.c GROUP BY c{t}.c)""")
    return ",\n".join(steps)


@query("op11_centroid_search", f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {CLUSTERS["size"]}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {CLUSTERS["size"]}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{CLUSTERS["seed"]}:' || vec_id), v) - 1 AS c, v AS cv
  FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS["k"]}
), {_rounds_sql()}
SELECT vec_id, hit.c::INT AS cluster, hit.d AS distance,
  (sum(hit.d) OVER (PARTITION BY hit.c))::BIGINT AS cluster_inertia,
  (sum(hit.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(cv, ',')) AS centroid_sha256
FROM a{CLUSTERS["rounds"]} a JOIN c{CLUSTERS["rounds"]} c ON c.c = a.hit.c
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), **CLUSTERS)


_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


@query("op12_source_divergence", f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
    coalesce(source, '') AS source FROM documents
), t AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(
    translate(text, '{UPPER}', '{LOWER}'), '{_TERM}')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term
  HAVING count(DISTINCT rid) >= {LEAST_DOCUMENTS}
), langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT t.lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    1 + {UNIT}::HUGEINT * (coalesce(n, 0) + 1) // (coalesce(total, 0) + v)::HUGEINT AS p,
    1 + {UNIT}::HUGEINT * (lang_n + 1) // (lang_total + v)::HUGEINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    (SELECT coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) FROM p x JOIN p y
     ON x.lang = y.lang AND x.term = y.term
     WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
  FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query("op13_kernel_langid")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.filter(~kept_back(F.col("doc_id"))))
    found = predict_languages(docs.select("doc_id", "text"), model, score_out="score")
    return found.select("doc_id", kept_back(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
