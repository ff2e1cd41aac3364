"""The queries opN_<name>: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import ann, bpe, maxent, merkle, negatives, packing, quality, setsketch, sharding, simhash, token_files, topk, toxicity
from tokenloom.llm.registry import query, table, vocabulary
from tokenloom.session import scratch_dir


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_token_orc")
def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents to ORC files and read them back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2, split_added=True)
    return token_files.digests(spark, path)


@query("op3_hash_ring")
def op3_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op4_length_buckets")
def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in batches of 262,144 byte tokens: doc_id, length, bucket, bound, batch, row, padding."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op5_multi_index")
def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found for every hundredth vector: query_id, rank, vec_id, score."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query("op6_impact_topk")
def op6_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products for every hundredth vector: query_id, rank, vec_id, score."""
    return topk.highest(table(spark, sf_dir, "embeddings"))


@query("op10_setsketch")
def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents: doc_id, n_shingles, component_id, kept."""
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_maxent")
def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = table(spark, sf_dir, "documents")
    scored = maxent.score(docs, maxent.fold(F.col("doc_id"), 5) != 1)
    return scored.select("doc_id", (maxent.fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _scored(docs: DataFrame, threshold: float) -> DataFrame:
    return docs.select(
        "doc_id", (maxent.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs.select("doc_id", "text"), lexicon), 0.5)


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    voters = quality.learn(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.score(docs.select("doc_id", "text"), voters), 0.3)


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose fingerprints differ in three bits or fewer: doc_id, fingerprint, component_id."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_CRC_EVEN = """
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda d, z: xor(d >> 1, (d & 1) * 3988292384))) % 2 = 1"""


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"


@query(
    "op12_merkle",
    f"""
    WITH RECURSIVE leaves AS (
      SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
        {_leaf_sql(f"CASE WHEN {_CRC_EVEN} THEN replace(text, chr(10), '') ELSE text END")} AS claim
      FROM documents),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS place,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves),
    nodes AS (
      SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
      UNION ALL
      SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 2) // 3
      FROM nodes WHERE n > 1 GROUP BY tree, level, place // 3),
    roots AS (SELECT tree, digest AS subroot FROM nodes WHERE n = 1),
    above AS (
      SELECT 0 AS level, tree AS place, subroot AS digest, count(*) OVER () AS n FROM roots
      UNION ALL
      SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 2) // 3
      FROM above WHERE n > 1 GROUP BY level, place // 3),
    steps AS (
      SELECT p.tree, p.place AS leaf_place, l.level,
        coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < p.place // CAST(pow(3, l.level) AS BIGINT)), '') AS before,
        coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > p.place // CAST(pow(3, l.level) AS BIGINT)), '') AS after
      FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) l ON l.tree = p.tree
      JOIN nodes s ON s.tree = p.tree AND s.level = l.level AND s.place // 3 = p.place // CAST(pow(3, l.level + 1) AS BIGINT)
      GROUP BY ALL),
    top_steps AS (
      SELECT r.tree, l.level,
        coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < r.tree // CAST(pow(3, l.level) AS BIGINT)), '') AS before,
        coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > r.tree // CAST(pow(3, l.level) AS BIGINT)), '') AS after
      FROM roots r JOIN (SELECT DISTINCT level FROM above WHERE n > 1) l ON true
      JOIN above s ON s.level = l.level AND s.place // 3 = r.tree // CAST(pow(3, l.level + 1) AS BIGINT)
      GROUP BY ALL),
    ways AS (
      SELECT tree, leaf_place, list(before ORDER BY tier, level) AS before, list(after ORDER BY tier, level) AS after
      FROM (SELECT tree, leaf_place, 0 AS tier, level, before, after FROM steps
        UNION ALL SELECT p.tree, p.place, 1, t.level, t.before, t.after FROM placed p JOIN top_steps t ON t.tree = p.tree)
      GROUP BY ALL),
    folds AS (
      SELECT p.tree, p.place, 1 AS pos, p.claim AS digest, w.before, w.after FROM placed p LEFT JOIN ways w ON w.tree = p.tree AND w.leaf_place = p.place
      UNION ALL
      SELECT tree, place, pos + 1, sha256(before[pos] || digest || after[pos]), before, after FROM folds WHERE pos <= len(before)),
    folded AS (SELECT tree, place, arg_max(digest, pos) AS folded_root FROM folds GROUP BY ALL)
    SELECT p.doc_id, p.leaf, r.subroot, a.digest AS root,
      sha256(coalesce(list_reduce(list_prepend('', list_transform(list_zip(w.before, w.after), lambda x: x[1] || x[2])), lambda x, y: x || y), '')) AS proof_sha256,
      f.folded_root, f.folded_root = a.digest AS verified
    FROM placed p JOIN roots r ON r.tree = p.tree JOIN (SELECT digest FROM above WHERE n = 1) a ON true
    LEFT JOIN ways w ON w.tree = p.tree AND w.leaf_place = p.place JOIN folded f ON f.tree = p.tree AND f.place = p.place
    """,
)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle manifest of all documents and what proofs make of tampered ones: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    stripped = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, stripped).otherwise(F.col("text"))
    return merkle.prove(merkle.build(table(spark, sf_dir, "documents"), merkle.leaf_column(tampered)))


@query(
    "op13_hard_negatives",
    """
    WITH fine AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS alike, CAST(list_dot_product(a.vec, r.vec) AS BIGINT) AS score
      FROM fine a JOIN fine r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
    positives AS (
      SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, p.positive_id,
      CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
      s.other_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
      AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label)
