"""The registered queries of the text operators, with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroid_clustering import cluster
from .common import table
from .embedding_dedup import near_duplicates
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .license_scan import scan_licenses
from .mixing import mix_sources
from .ngram_lm import score_documents
from .piece_codec import encode_pieces
from .quality import score_quality
from .secret_scan import scan_secrets
from .sharding import minimax_shards
from .toxicity import fit_toxicity, score_toxicity
from .whitening import whiten


def pieces(spark: SparkSession) -> str:
    """The piece model's file, from the setting ``spark.spectralake.pieces``."""
    return spark.conf.get("spark.spectralake.pieces", "/opt/tokenizers/piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 3).alias("score"), F.round("mean_score", 5).alias("mean_score"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"), joined(F.concat("places.label", "spans.label")).alias("labels"),
        F.col("coverage").alias("score"), F.size("spans").cast("long").alias("n_spans"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = F.array(*[F.lit(k) for k in ("assign", "access", "hex", "like_assign", "like_access", "like_hex")])
    ranked = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.array_sort(F.concat(ranked(F.col("base")), ranked(F.col("added"))))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(spans).alias("spans"), "n_candidates", F.round("top_gain", 4).alias("top_gain"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(table(spark, sf_dir, "documents"), pieces(spark), verify=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_bytes", F.round("score", 4).alias("score"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and leading axis (numbered from 1)."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    axes = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "axis")
    return found.select("vec_id", "n", "deviation", "identity_error", axes).select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "axis.whitened", "axis.explained", "identity_error")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, labelled or not."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector of 64 finite components."""
    return cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_lm_scoring, op3_toxicity, op4_embedding_near_dedup, op5_license_scan, op6_sharding, op7_source_mixing, op8_jaccard_join, op9_secret_scan, op10_sentencepiece, op11_embedding_whitening, op12_quality, op13_centroid_clustering)}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op2_lm_scoring": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
        b AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM t),
        c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w),
        c2 AS (SELECT v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY v, w),
        s AS (SELECT b.doc_id, CASE WHEN c2.n >= 2 THEN ln(c2.n) - ln(p.n) ELSE CASE WHEN b.v IS NULL THEN 0 ELSE ln(0.4) END + ln(c1.n) - ln((SELECT count(*) FROM t)) END AS x
              FROM b JOIN c1 ON b.w = c1.w LEFT JOIN c2 ON b.v = c2.v AND b.w = c2.w LEFT JOIN c1 p ON b.v = p.w),
        a AS (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(x, 0), 3) AS score, CASE WHEN len(ws) > 0 THEN round(x / len(ws), 5) END AS mean_score
        FROM d LEFT JOIN a USING (doc_id)""",
    "op4_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE a.l > 0 AND b.l > 0 AND list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.9),
        n AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
        r AS (SELECT vec_id AS id, vec_id AS low FROM v UNION SELECT n.b, r.low FROM r JOIN n ON n.a = r.id WHERE r.low < n.b)
        SELECT vec_id, (SELECT count(*) FROM n WHERE n.a = vec_id) AS n_links, (SELECT min(low) FROM r WHERE r.id = vec_id) AS component_id, vec_id = (SELECT min(low) FROM r WHERE r.id = vec_id) AS kept FROM v""",
    "op7_source_mixing": r"""
        WITH r AS (SELECT doc_id, 'domain' || (ascii(substr(md5(coalesce(source, '')), 1, 1)) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
        leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap FROM r GROUP BY ALL),
        n1 AS (SELECT domain, sum(cap)::BIGINT AS cap, 1 AS w, (SELECT floor(sum(tokens) * 0.5)::BIGINT FROM leaf) AS budget FROM leaf GROUP BY domain),
        f1 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                 <= w * (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM n1),
        a1 AS (SELECT domain, (CASE WHEN f THEN cap ELSE (w * (budget - coalesce(sum(cap) FILTER (f) OVER (), 0))) // sum(w) FILTER (NOT f) OVER () END)::BIGINT AS budget FROM f1),
        n2 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w, any_value(budget) AS budget FROM leaf JOIN a1 USING (domain) GROUP BY domain, lang),
        f2 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                 <= w * (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM n2),
        a2 AS (SELECT domain, lang, (CASE WHEN f THEN cap ELSE (w * (budget - coalesce(sum(cap) FILTER (f) OVER p, 0))) // sum(w) FILTER (NOT f) OVER p END)::BIGINT AS budget FROM f2 WINDOW p AS (PARTITION BY domain)),
        n3 AS (SELECT domain, lang, source, tokens, cap, 1 AS w, budget FROM leaf JOIN a2 USING (domain, lang)),
        f3 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                 <= w * (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM n3),
        a3 AS (SELECT domain, lang, source, tokens, (CASE WHEN f THEN cap ELSE (w * (budget - coalesce(sum(cap) FILTER (f) OVER p, 0))) // sum(w) FILTER (NOT f) OVER p END)::BIGINT AS alloc FROM f3 WINDOW p AS (PARTITION BY domain, lang)),
        e AS (SELECT *, CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END AS epochs FROM a3),
        k AS (SELECT r.*, alloc, epochs, alloc - epochs * tokens AS rest, md5('7:' || epochs || ':' || doc_id) AS key FROM r JOIN e USING (domain, lang, source))
        SELECT doc_id, domain, lang, source, n_tokens, alloc, (epochs + (sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) <= rest)::INT)::BIGINT AS copies FROM k""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ') || ' .'] ELSE list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' ')) END) AS g FROM w)),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        k AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
        l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
        r AS (SELECT doc_id AS id, doc_id AS low FROM w UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id WHERE r.low < l.b),
        f AS (SELECT id, min(low) AS low FROM r GROUP BY id)
        SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, f.low AS component_id FROM w LEFT JOIN c USING (doc_id) JOIN f ON f.id = w.doc_id""",
}


def _clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds one after the other: a_t is the assignment of round t, c_t the centroids that it starts from (c, d, y)."""
    near = "SELECT vec_id, min_by(c, (dist, c)) AS c, min(dist)::BIGINT AS dist FROM (SELECT v.vec_id, c, sum((x - y) * (x - y)) AS dist FROM v JOIN c{0} USING (d) GROUP BY v.vec_id, c) GROUP BY vec_id"
    floor_ = "(s - ((s % n) + n) % n) // n"
    parts = [
        "g AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        "v AS MATERIALIZED (SELECT vec_id, d, floor(1024 * e[d]::DOUBLE)::BIGINT AS x FROM g, range(1, 65) q(d))",
        f"c0 AS MATERIALIZED (SELECT k - 1 AS c, d, x AS y FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) AS k FROM g) JOIN v USING (vec_id) WHERE k <= {k})",
    ]
    for t in range(rounds):
        parts.append(f"a{t} AS MATERIALIZED ({near.format(t)})")
        sums = f"(SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n FROM a{t} JOIN v USING (vec_id) GROUP BY c, d)"
        parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c, d, coalesce({floor_}, y) AS y FROM c{t} LEFT JOIN {sums} USING (c, d))")
    parts.append(f"f AS MATERIALIZED ({near.format(rounds)})")
    parts.append(f"h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"WITH {', '.join(parts)} SELECT vec_id, c::INT AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia, centroid_sha256 FROM f JOIN h USING (c)"


ORACLE_SQL["op13_centroid_clustering"] = _clustering_sql()
