"""The registered queries of this subpackage: each applies its operator to whole tables and derives the result's columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import byte_bpe, centroid_clustering, decontaminate, fill_in_middle, fingerprints, line_dedup, quality, simhash, source_mix, substring_dedup, token_output, url_filter, warc
from arcweave.llm.common import table, work_folder, written

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: The rules of op6.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP1 = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
windows AS (
  SELECT *, lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2 FROM lines
  WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, pos) > 1 AS again
  FROM windows WHERE l2 IS NOT NULL),
covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(3) t(k) WHERE again),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.pos IS NOT NULL AS gone
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS INTEGER) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the quarter that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry scores of all documents, fitted on labels outside the held-out quarter."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, raw = quality.ranked(docs, training_labels(labels))
    scored = raw.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), quality.placed(model, F.col("raw")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= model.cut).cast("int"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    both = fingerprints.edited(docs, fingerprints.fingerprints(docs))
    canon = fingerprints.canonical(F.col("edited"))
    both = both.withColumn("edited_digest", fingerprints.digest(canon))
    # equal digests alone take a second look at the bytes, which tells texts of one digest apart
    equal = F.when(F.col("digest") == F.col("edited_digest"), fingerprints.canonical(F.col("text")) == canon).otherwise(False)
    both = both.withColumn("equal", equal)
    other = F.when(F.col("digest") == F.col("edited_digest"), F.concat("edited_digest", F.lit(":"), F.sha2(canon, 256))).otherwise(F.col("edited_digest"))
    return both.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        F.when(F.col("equal"), F.col("fingerprint")).otherwise(other).alias("edited_fingerprint"),
        F.col("equal").cast("double").alias("near_edited"),
        (F.col("fingerprint") == F.col("next_print")).cast("double").alias("near_next"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substring_dedup.parse(table(spark, sf_dir, "documents"))
    return parsed.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP5 = """
WITH trimmed AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS x FROM documents),
split AS (
  SELECT doc_id, CASE WHEN x = '' THEN [] ELSE regexp_split_to_array(x, '[ \\t\\n\\x0B\\f\\r]+') END AS ws FROM trimmed),
words AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM split),
windows AS (
  SELECT s.doc_id, p.pos, array_to_string(list_slice(s.ws, p.pos, p.pos + 12), ' ') AS win
  FROM split s, LATERAL (SELECT unnest(range(1, len(s.ws) - 11)) AS pos) p),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
late AS (SELECT w.doc_id, w.pos FROM windows w JOIN firsts f ON w.win = f.win WHERE f.first < w.doc_id),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM late, range(13) t(k)),
marked AS (
  SELECT w.doc_id, w.pos, w.word, c.pos IS NOT NULL AS gone
  FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id AND w.pos = c.pos),
summed AS (
  SELECT doc_id, count(*) AS n_words, sum(CAST(gone AS INTEGER)) AS n_removed,
         string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host and bad (quality 0 or toxic 1) of each labelled page: the number that ends its path is the id of the document
    whose text the page shows, which is what labels mark. Of repeated labels of one document the worst counts."""
    named = pages.select(url_filter.host_of(F.col("url")).alias("host"), F.regexp_extract(url_filter.path_of(F.col("url")), r"/(\d{1,18})(?:\.html)?/?$", 1).alias("n"))
    marked = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")).where("bad is not null")
    marked = marked.groupBy("id").agg(F.max("bad").alias("bad"))
    return named.where("n <> '' and host <> ''").select("host", F.col("n").cast("long").alias("id")).join(marked, "id").select("host", "bad")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bad_bound", 6).alias("bad_bound"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"), shingle=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def level_sql(tag: str, rows: str) -> str:
    """CTEs of one level of the reputation: rows (with n, bad and the parent's mean m) to its posterior a, b and mean."""
    return f"""
placed_{tag} AS (SELECT * FROM ({rows})),
sums_{tag} AS (
  SELECT sum(n * pow(bad / n - m, 2)) AS ss, sum(m * (1 - m)) AS inside, sum(n * m * (1 - m)) AS scale FROM placed_{tag}),
k_{tag} AS (
  SELECT CASE WHEN ss IS NULL OR scale <= inside OR (ss - inside) / (scale - inside) <= 1.0::DOUBLE / {url_filter.MAX_STRENGTH + 1} THEN {url_filter.MAX_STRENGTH}::DOUBLE
              ELSE greatest(1 / least((ss - inside) / (scale - inside), 0.999::DOUBLE) - 1, {url_filter.MIN_STRENGTH}::DOUBLE) END AS k FROM sums_{tag}),
beta_{tag} AS (SELECT p.* EXCLUDE (n, bad, m), m * k + bad AS a, (1 - m) * k + n - bad AS b FROM placed_{tag} p, k_{tag}),
{tag} AS (
  SELECT *, a / (a + b) AS m, a / (a + b) - {url_filter.Z}::DOUBLE * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS bound FROM beta_{tag})"""


ORACLE_OP6 = (
    r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts),
names AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS h FROM parts),
levels AS (
  SELECT host, h, string_split(h, '.') AS x, regexp_matches(h, '^[0-9]+([.][0-9]+){3}$|^\[') AS address,
         array_to_string(list_slice(string_split(h, '.'), greatest(len(string_split(h, '.')) - 1, 1), len(string_split(h, '.'))), '.') AS last2,
         array_to_string(list_slice(string_split(h, '.'), greatest(len(string_split(h, '.')) - 2, 1), len(string_split(h, '.'))), '.') AS last3
  FROM names),
placed AS (
  SELECT host, h,
         CASE WHEN address THEN h WHEN last2 IN (SUFFIXES) THEN last3 ELSE last2 END AS d,
         CASE WHEN address THEN h WHEN last2 IN (SUFFIXES) THEN last2 ELSE x[len(x)] END AS s
  FROM levels),
marked AS (
  SELECT doc_id AS id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
outcomes AS (
  SELECT host, bad FROM parts JOIN marked ON TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(?:[.]html)?/?$', 1), '') AS BIGINT) = id WHERE host <> ''),
by_h AS (SELECT h, d, s, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM outcomes JOIN placed USING (host) GROUP BY 1, 2, 3),
by_d AS (SELECT d, s, sum(n) AS n, sum(bad) AS bad FROM by_h GROUP BY 1, 2),
by_s AS (SELECT s, sum(n) AS n, sum(bad) AS bad FROM by_d GROUP BY 1),
overall AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM by_h),""".replace("SUFFIXES", ", ".join(f"'{x}'" for x in url_filter.TWO_LABEL_SUFFIXES))
    + ",".join(
        [
            level_sql("ps", "SELECT s, n, bad, m FROM by_s, overall"),
            level_sql("pd", "SELECT d, by_d.s, by_d.n, by_d.bad, ps.m FROM by_d JOIN ps ON by_d.s = ps.s"),
            level_sql("ph", "SELECT h, by_h.d, by_h.s, by_h.n, by_h.bad, pd.m FROM by_h JOIN pd ON by_h.d = pd.d AND by_h.s = pd.s"),
        ]
    )
    + """
SELECT page_id, r.host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN coalesce(ph.bound, pd.bound, ps.bound) > (SELECT m FROM overall) THEN 'block' ELSE 'allow' END AS verdict,
       round(coalesce(ph.bound, pd.bound, ps.bound), 6) AS bad_bound
FROM ruled r JOIN placed p ON r.host = p.host LEFT JOIN ph ON p.h = ph.h LEFT JOIN pd ON p.d = pd.d LEFT JOIN ps ON p.s = ps.s
"""
)

ORACLE_OP8 = """
WITH given AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
owned AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM given),
bits AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(hex, 5 * CAST(k // 4 AS INTEGER) + 1, 5) AS INTEGER) >> (15 - 5 * CAST(k % 4 AS INTEGER))) & 31), 1), '' ORDER BY k) AS digest
  FROM given, range(32) t(k) GROUP BY page_id)
SELECT o.page_id, CAST(strlen(o.html) AS BIGINT) AS payload_bytes, b.digest AS payload_digest,
       CASE WHEN o.page_id < o.owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.page_id < o.owner THEN o.owner END AS refers_to, true AS digest_ok
FROM owned o JOIN bits b ON o.page_id = b.page_id
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leaking document and benchmark item; documents that hold none have no row."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "ids")
    token_output.write_ids(table(spark, sf_dir, "documents"), folder, WORD_BPE, END_ID)
    sums = written(token_output.checksums(token_output.read_ids(spark, folder)), "sums")
    return token_output.offsets(sums).select("doc_id", "start", "n_tokens", "ids_crc32")


#: The weights of op11's sources, in order and repeating.
SOURCE_WEIGHTS = [5, 2, 1]


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources at 5, 2, 1 (repeating) of all words, at most three copies of a document."""
    done = source_mix.mix(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, 3)
    return done.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("rate", 9).alias("rate"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines; all texts are cut, half of them with the suffix in front."""
    done = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), "7:", 100, 50)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE_OP12 = r"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS x FROM documents),
drawn AS (
  SELECT doc_id, t, x, CAST(len(x) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(x) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(x) + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS r, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS s FROM given),
formed AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 100 THEN 'plain' WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(list_slice(x, 1, least(a, b)), ''), '') AS p, coalesce(array_to_string(list_slice(x, least(a, b) + 1, greatest(a, b)), ''), '') AS m,
         coalesce(array_to_string(list_slice(x, greatest(a, b) + 1, n), ''), '') AS e FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM formed
"""


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters after ten rounds."""
    found = centroid_clustering.cluster(table(spark, sf_dir, "embeddings"), 8, 10, "3:")
    at = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    per = found.inertia if max(found.inertia, default=0) < centroid_clustering.LONG else [None] * len(found.inertia)
    whole = sum(found.inertia) if sum(found.inertia) < centroid_clustering.LONG else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    return found.assigned("vec_id").select(
        "vec_id", "cluster", "distance", at(per, "bigint").alias("cluster_inertia"), F.lit(whole).cast("bigint").alias("inertia"), at(digests, "string").alias("centroid_sha256")
    )


def lloyd_sql(rounds: int = 10, k: int = 8) -> str:
    """A CTE for each round's assignment and each round's centroids; whole numbers throughout."""
    near = lambda r: f"""a{r} AS MATERIALIZED (
  SELECT id, vec_id, v, best.k AS k, best.d AS d FROM (
    SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v,
           min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), k := k)) AS best
    FROM kept, c{r} GROUP BY id))"""  # noqa: E731
    move = lambda r: f"""s{r} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY k, i),
m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.k = m{r}.k)"""  # noqa: E731
    steps = ",\n".join(f"{near(r)},\n{move(r)}" for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS k, v AS c FROM kept QUALIFY k < {k}),
{steps},
{near(rounds)}
SELECT vec_id, a.k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_output": op10_token_output,
    "op11_source_mix": op11_source_mix,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": ORACLE_OP1,
    "op5_substring_dedup": ORACLE_OP5,
    "op6_url_filter": ORACLE_OP6,
    "op8_warc": ORACLE_OP8,
    "op12_fill_in_middle": ORACLE_OP12,
    "op13_centroid_clustering": lloyd_sql(),
}
