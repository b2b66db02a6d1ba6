"""One query for each operator, over its whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import centroids, langid, lattice, lm, merkle, neardup, pieces, pii, secrets, spelling, tokenfiles, warc
from tessella.llm.decontaminate import decontaminate
from tessella.llm.storage import new_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_text(spans: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _span_columns(base: tuple[str, ...]) -> list[Column]:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return [*map(count, base), F.sha2(span_text(own), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), path)
    out = tokenfiles.read_token_files(spark, path)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", *_span_columns(pii.BASE))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each whole text and whether they decode to it. Both ways run in one pass over the rows."""
    docs = table(spark, sf_dir, "documents")
    return pieces.round_trips(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), "round_trip")


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the edited spans as start:end, comma-joined."""
    edits = F.array_join(F.transform("edits", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return merkle.compare_with_next(table(spark, sf_dir, "documents")).withColumn("edits", edits)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "text_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    # Written, so that the archives are read once and the planner knows the records' size.
    records = written(warc.read_records(spark, [r.file for r in files.collect()], payloads=False), "records")
    page = F.try_element_at(F.col("metadata")[0]["fields"], F.lit("page-id")).cast("long")
    captures = written(warc.assemble(records), "captures")
    response = F.col("response")
    found = warc.resolve(captures, {"page_id": page})
    return found.select(page.alias("page_id"), response["payload_bytes"].alias("payload_bytes"), response["payload_digest"].alias("payload_digest"), response["type"].alias("record_type"), F.col("original.page_id").alias("refers_to"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), null_items=True)
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are the sources; the table names no repositories, so that each document counts as one.

    ownership: owners:repositories of each span's value.
    """
    out = secrets.scan_secrets(table(spark, sf_dir, "documents"), repo_col="doc_id")
    verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long").alias(f"n_{v}")
    counts = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["owners"], s["repositories"])), ",").alias("ownership")
    return out.select("doc_id", *map(verdict, ("live", "example")), counts, *_span_columns(secrets.BASE))


def op11_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_pii": op2_pii,
    "op3_pieces": op3_pieces,
    "op4_merkle": op4_merkle,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_warc": op6_warc,
    "op7_language": op7_language,
    "op8_decontaminate": op8_decontaminate,
    "op9_katz": op9_katz,
    "op10_secrets": op10_secrets,
    "op11_lattice": op11_lattice,
    "op12_centroids": op12_centroids,
    "op13_spelling": op13_spelling,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _secret_rule_sql(rank: int, kind: str, regex: str, group: int, least: int) -> str:
    regex = regex.replace("'", "''").replace("*+", "*").replace("++", "+").replace("}+", "}")  # RE2 never goes back
    parts = f"regexp_extract_all(t, '{regex}', 0) AS m, regexp_extract_all(t, '{regex}', {group}) AS v, string_split_regex(t, '{regex}') AS g"
    return f"SELECT rid, owner, repo, {rank} AS rank, '{kind}' AS kind, {least} AS least, {parts} FROM d"


def _secrets_sql() -> str:
    count = lambda cond, name: f"CAST(count(*) FILTER ({cond}) AS BIGINT) AS n_{name}"
    text = lambda cond: f"coalesce(string_agg(kind || ':' || pos || ':' || (pos + n), ',' ORDER BY pos, rank) FILTER ({cond}), '')"
    columns = [count(f"verdict = '{v}'", v) for v in ("live", "example")] + [count(f"kind = '{k}'", k) for k in secrets.BASE]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(0)) AS owner, coalesce(CAST(doc_id AS VARCHAR), chr(0)) AS repo, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(_secret_rule_sql(i, *r) for i, r in enumerate(secrets.RULES))}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a WHERE len(m) > 0),
x AS (SELECT rid, owner, repo, rank, kind, v[i] AS value, kind = 'assign' AND regexp_matches(m[i], '{secrets.PASSWORD}') AS password, length(m[i]) AS n, CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS pos FROM e WHERE length(v[i]) >= least),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM x GROUP BY value),
w AS (SELECT x.*, owners, repos, CASE WHEN owners >= 2 OR repos >= CASE WHEN regexp_matches(value, '{secrets.PLACEHOLDER}') THEN {secrets.HINTED} ELSE {secrets.REPOSITORIES} END THEN 'example'
 WHEN (length(value) >= CASE WHEN password THEN {secrets.SHORT} ELSE {secrets.LONG} END AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')) OR kind IN ('pem', 'github', 'jwt') THEN 'live' ELSE 'weak' END AS verdict FROM x JOIN o USING (value))
SELECT doc_id, {', '.join(columns)}, sha256({text("kind IN ('assign', 'access', 'hex')")}) AS base_sha256, {text('kind IS NOT NULL')} AS spans,
coalesce(string_agg(owners || ':' || repos, ',' ORDER BY pos, rank) FILTER (kind IS NOT NULL), '') AS ownership
FROM d LEFT JOIN w USING (rid) GROUP BY rid, doc_id"""


def _centroids_sql(s: centroids.Settings = centroids.Settings()) -> str:
    most = centroids.LIMIT
    apart = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    rounds = "".join(
        f""",
a{i} AS MATERIALIZED (SELECT id, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT id, v, k, {apart} AS d FROM x, c{i}) GROUP BY id, v),
u{i} AS (SELECT k, p, CAST((sum(z) - (sum(z) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS z FROM (SELECT k, unnest(v) AS z, unnest(range(len(v))) AS p FROM a{i}) GROUP BY k, p),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(w, c) AS c FROM c{i} LEFT JOIN (SELECT k, list(z ORDER BY p) AS w FROM u{i} GROUP BY k) USING (k))"""
        for i in range(s.rounds)
    )
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = {s.length}),
x AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(e, lambda x: CAST(floor(least(greatest(1024 * x, {-most}), {most})) AS BIGINT)) AS v
 FROM e WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {s.length}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{s.seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v AS c FROM x QUALIFY k < {s.clusters}){rounds},
f AS (SELECT id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT id, k, {apart} AS d FROM x, c{s.rounds}) GROUP BY id)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN x USING (id) JOIN c{s.rounds} USING (k)"""


def _spelling_sql(s: spelling.Settings = spelling.Settings()) -> str:
    """The crc's table follows from its polynomial: a byte's entry is the register after its eight bits."""

    def entry(value: int) -> int:
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        return value

    crcs = [entry(i) for i in range(256)]
    return f"""
WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{{s.least_length},}}')) AS w FROM documents),
r AS (SELECT id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM d GROUP BY ALL),
c AS (SELECT w, n, flatten(list_transform(string_split(id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS b FROM r),
h AS (SELECT w, n, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM c, (SELECT {crcs}::BIGINT[] AS t)),
o AS (SELECT CASE WHEN h % {s.divisor} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
k AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= {s.least_length} GROUP BY word HAVING sum(n) >= {s.least_count}),
g AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) AS a, substr(word, p + 1) AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM k)),
e AS (SELECT x.word, y.word AS other, y.n AS m FROM g x JOIN g y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
 UNION SELECT g.word, k.word, k.n FROM g JOIN k ON k.word = g.a || g.z UNION SELECT k.word, g.word, g.n FROM g JOIN k ON k.word = g.a || g.z),
f AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS m FROM e GROUP BY word),
v AS MATERIALIZED (SELECT k.word, CASE WHEN m >= {s.ratio} * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {s.ratio} * n THEN m END AS form_n FROM k LEFT JOIN f USING (word)),
l AS (SELECT word, word AS root, 0 AS step FROM v UNION ALL SELECT l.word, v.form, step + 1 FROM l JOIN v ON v.word = l.root WHERE v.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM v JOIN (SELECT word, arg_max(root, step) AS root FROM l GROUP BY word) USING (word)"""


ORACLE_SQL: dict[str, str] = {
    "op13_spelling": _spelling_sql(),
    "op12_centroids": _centroids_sql(),
    "op10_secrets": _secrets_sql(),
    "op6_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
CASE WHEN n >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 100 AND page_id > least THEN least END AS refers_to FROM m""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, w, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS win FROM bw),
dp AS (SELECT doc_id, w, s.n, unnest(range(len(w) - s.n + 1)) AS i FROM d, (SELECT DISTINCT n FROM iw) s WHERE len(w) >= s.n),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS win FROM dp),
h AS (SELECT doc_id, item_id, i, n FROM dw JOIN iw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
