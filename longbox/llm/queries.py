"""Queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.llm import fingerprint, language, lengths, merkle, order_minhash, packing, piece, private, quality, token_file, topk, url_filter, whitening

#: (host, path prefix, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.round_trip(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), limit=2048, end_id=0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lengths.token_counts(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
    return lengths.length_table(lengths.histogram(counts))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.written_and_read(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.verdicts(_table(spark, sf_dir, "pages", "page_id", "url"), rules)


def op9_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), components=8, scale=1024, shift=100_000)


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents", *merkle.FIELDS))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_packing, op3_token_counts, op4_quality, op5_order_minhash, op6_language, op7_token_file, op8_url_filter, op9_private, op10_top_k, op11_whitening, op12_fingerprint, op13_merkle, pipeline)}


OP8_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, COALESCE(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         COALESCE(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM u
), r(rhost, rpath, act) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT page_id, rhost || rpath AS rule, act, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, host, path, rule, COALESCE(act, 'allow') AS verdict FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND n = 1
"""

OP10_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""


#: Levels that the SQL writes out: trees of up to 8 to that power leaves.
_LEVELS = 7


def _op13_sql() -> str:
    """Trees level by level, for languages and then over their subroots, and each row's way up by joins with its runs."""
    size = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf = lambda text: "sha256(" + " || ".join(size(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bit = "list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    digits = "list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {digits}), lambda c, b: {bit}), 4294967295)"
    lower = f"translate(text, '{upper}', '{upper.lower()}')"
    parts = [
        f"d AS (SELECT doc_id, lang AS tree, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS found FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d)",
        "l0 AS (SELECT tree, pos, n, leaf AS h FROM a0)",
    ]
    for name in ("l", "t"):
        if name == "t":
            tops = " UNION ALL ".join(f"SELECT tree, h FROM l{k} WHERE n = 1" for k in range(_LEVELS + 1))
            parts.append(f"s AS (SELECT tree AS lang, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM ({tops}))")
            parts.append("t0 AS (SELECT '' AS tree, pos, n, subroot AS h FROM s)")
        for k in range(_LEVELS):
            parts.append(f"{name}{k + 1} AS (SELECT tree, pos // 8 AS pos, (max(n) + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 8)")
            # What stands before and after each node in its run.
            run = "PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN"
            parts.append(f"{name}s{k} AS (SELECT tree, pos, COALESCE(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef, COALESCE(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft FROM {name}{k} WHERE n > 1)")
    root = " UNION ALL ".join(f"SELECT h AS root FROM t{k} WHERE n = 1" for k in range(_LEVELS + 1))
    parts.append(f"root AS ({root})")
    step = lambda up, k, n, place, tree: f"SELECT {up}.* EXCLUDE (f, p), CASE WHEN {n} THEN sha256(bef || f || aft) ELSE f END AS f, CASE WHEN {n} THEN p || bef || aft ELSE p END AS p FROM {up} LEFT JOIN {k} ON {k}.tree IS NOT DISTINCT FROM {tree} AND {k}.pos = {place}"
    parts.append("w0 AS (SELECT *, found AS f, '' AS p FROM a0)")
    for k in range(_LEVELS):
        parts.append(f"w{k + 1} AS ({step(f'w{k}', f'ls{k}', 'bef IS NOT NULL', f'w{k}.pos // {8**k}', f'w{k}.tree')})")
    parts.append(f"u0 AS (SELECT w.*, s.subroot, s.pos AS spot FROM w{_LEVELS} w JOIN s ON s.lang IS NOT DISTINCT FROM w.tree)")
    for k in range(_LEVELS):
        parts.append(f"u{k + 1} AS ({step(f'u{k}', f'ts{k}', 'bef IS NOT NULL', f'u{k}.spot // {8**k}', chr(39) * 2)})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM u{_LEVELS}, root"


def oracle_sql() -> dict[str, str]:
    """Only where SQL can give whole rows: the others are tested against brute force in ``tests/llm``."""
    return {"op8_url_filter": OP8_SQL, "op10_top_k": OP10_SQL, "op13_merkle": _op13_sql()}
