"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.simhash import simhash_components

    out = simhash_components(Scratch(spark, "op1"), _table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings from labels: 0 low quality, 1 good but toxic, 2 good and clean. Every document comes back;
    `selected` says whether P(grade >= 1) reaches one half."""
    from lumenreel.llm import quality

    scratch = Scratch(spark, "op2")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    ratings = _table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    out = quality.grade_texts(scratch, docs, quality.fit(scratch, docs, ratings, 3))
    tail = F.col("tails")
    return out.select("doc_id", "expected_grade", tail[0].alias("p_grade_1"), tail[1].alias("p_grade_2"), (tail[0] >= 0.5).alias("selected"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.lines import line_classes

    out = line_classes(Scratch(spark, "op3"), _table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line_no", "line_class", "kept")


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.lm import score_texts

    return score_texts(Scratch(spark, "op4"), _table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.mixing import mix

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(Scratch(spark, "op5"), docs).apply(docs)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").cast("long").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def op6_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images: each row of embeddings is drawn as a file, every eighth also as an edited copy."""
    from lumenreel.llm.media import image_copies, pictures

    return image_copies(Scratch(spark, "op6"), pictures(_table(spark, sf_dir, "embeddings")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm import toxicity

    scratch = Scratch(spark, "op7")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(scratch, docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(scratch, docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.ann import nearest

    return nearest(Scratch(spark, "op8"), _table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lumenreel.llm.packing import pack

    docs = _table(spark, sf_dir, "documents")
    return pack(Scratch(spark, "op9"), docs, public_tokenizers.path("byte_bpe_50k.json"))


def op10_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.sharding import kd_shards, number_rows

    scratch = Scratch(spark, "op10")
    placed = kd_shards(scratch, _table(spark, sf_dir, "documents"), shards=16)
    out = number_rows(scratch, placed, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm import langid

    scratch = Scratch(spark, "op11")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.fit(scratch, docs.where(~held))
    out = langid.predict(scratch, docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.resampling import resample

    docs, target = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return resample(Scratch(spark, "op12"), docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenreel.llm.centroids import cluster, with_facts

    scratch = Scratch(spark, "op13")
    return with_facts(scratch, *cluster(scratch, _table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_ordinal": op2_ordinal,
    "op3_lines": op3_lines,
    "op4_maxent": op4_maxent,
    "op5_mixing": op5_mixing,
    "op6_images": op6_images,
    "op7_toxicity": op7_toxicity,
    "op8_hnsw": op8_hnsw,
    "op9_packing": op9_packing,
    "op10_kdtree": op10_kdtree,
    "op11_langid": op11_langid,
    "op12_resample": op12_resample,
    "op13_centroids": op13_centroids,
}



def _rounds(n: int) -> str:
    """CTEs of one assignment and one replacement of centroids a round, and of a last assignment."""
    meet = """a{i} AS MATERIALIZED (
  SELECT vec_id, arg_min(c{i}.k, (d, c{i}.k)) AS k, min(d) AS d, any_value(x) AS x FROM (
    SELECT v.vec_id, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i} AS c) AS c{i} GROUP BY vec_id
)"""
    move = """s{i} AS (
  SELECT k, j, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(x) AS e, unnest(range(64)) AS j FROM a{i}) GROUP BY k, j
), c{j} AS MATERIALIZED (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} AS c LEFT JOIN (SELECT k, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY j) AS x FROM s{i} GROUP BY k) AS m USING (k)
)"""
    return ", ".join(part.format(i=i, j=i + 1) for i in range(n + 1) for part in ((meet, move) if i < n else (meet,)))


#: DuckDB for op5: targets, expected copies, odds and the order by them, all from the tables.
ORACLES: dict[str, str] = {
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS skey, source IS NULL AS nosrc,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, '~'), coalesce(source, '~'), md5(coalesce(text, '~')))) AS draw
  FROM documents
), l AS (
  SELECT *, length(bin(size)) AS digits, (('0x' || substr(draw, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d
), s AS (
  SELECT skey, nosrc, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY nosrc, skey) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS room FROM s
), f AS (
  SELECT *, room / w AS fill, sum(source_size) OVER ()::DOUBLE AS total FROM w
), g AS (
  SELECT *, (total - coalesce(sum(room) OVER (ORDER BY fill, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY fill, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f
), h AS (
  SELECT *, (SELECT arg_min(level, (fill, skey)) FROM g WHERE level < fill) AS final FROM g
), t AS (
  SELECT skey, source_size, CASE WHEN final IS NULL OR fill <= final THEN room ELSE w * final END AS target FROM h
), v AS (
  SELECT skey, digits, sum(size)::BIGINT AS words, digits + 8 AS want FROM l GROUP BY ALL
), a AS (
  SELECT v.*, t.source_size, t.target,
         (t.target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY skey ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / nullif(sum(want * words) OVER (PARTITION BY skey ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT, 0) AS scale
  FROM v JOIN t USING (skey)
), b AS (
  SELECT skey, arg_min(scale, -digits) AS scale FROM a WHERE scale * want < 3 GROUP BY 1
), e0 AS (
  SELECT a.skey, a.digits, a.words, a.source_size, a.target,
         CASE WHEN a.source_size <= 0 THEN 0.0::DOUBLE WHEN b.scale IS NULL THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, b.scale * a.want) END AS often
  FROM a LEFT JOIN b USING (skey)
), e AS (
  SELECT *, floor(often)::BIGINT AS whole, often - floor(often) AS frac, target - sum(floor(often)::BIGINT * words) OVER (PARTITION BY skey)::BIGINT AS rest FROM e0
), q AS (
  SELECT l.doc_id, l.size, l.draw, e.skey, e.source_size, e.target, e.whole, e.frac, e.rest, (l.u / (1 - l.u)) / (e.frac / (1 - e.frac)) AS odds
  FROM l JOIN e ON l.skey = e.skey AND l.digits = e.digits
), r AS (
  SELECT *, coalesce(sum(size) FILTER (frac > 0) OVER (PARTITION BY skey ORDER BY CASE WHEN frac > 0 THEN odds / (1 + odds) ELSE 2 END, draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN frac > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r""",
    "op12_resample": r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS v FROM range(256) AS r(i))
), w AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS MATERIALIZED (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w
), h AS (
  SELECT f, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, 2 * strlen(f), 2), lambda i: ('0x' || substr(hex(f), i, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 10000 AS bucket FROM (SELECT DISTINCT f FROM f) CROSS JOIN crc
), g AS MATERIALIZED (
  SELECT f.side, f.r, h.bucket FROM f JOIN h USING (f)
), n AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM g GROUP BY bucket
), a AS (
  SELECT sum(s)::DOUBLE AS alls, sum(t)::DOUBLE AS allt FROM n
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (alls + 10000)) / ((s + 1)::DOUBLE * (allt + 10000))))::BIGINT AS gain FROM n, a
), m AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM g JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r
), d AS (
  SELECT w.id AS doc_id, len(w.w) >= 20 AS eligible, coalesce(m.n, 0)::BIGINT AS n_features, coalesce((total - ((total % n + n) % n)) // n, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || coalesce(w.id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (r) WHERE side = 'd'
), e AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d
), o AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (eligible) OVER () AS alln FROM e
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 25 * alln // 100 THEN place END::BIGINT AS rank FROM o""",
    "op13_centroids": """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (SELECT x, sha256('1:' || vec_id::VARCHAR) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h LIMIT 16)
), """
    + _rounds(3)
    + """
SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (k)""",
}
