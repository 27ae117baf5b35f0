"""The registered queries of the operators, as thin as their result contracts allow, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegeo.llm import bpe, exact_dedup, jaccard_join, katz, manifest, mixing, periods, quotes, suffix_dedup, token_counts, topk, toxicity, winnow
from tablegeo.llm.common import bound_batches, text_bytes


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path()
    both = docs.select("doc_id", bpe.round_trip("text", path).alias("both")).select("doc_id", "both.ids", "both.decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, "text", tokenizer_path())
    return counted.select("doc_id", F.octet_length(text_bytes("text")).cast("long").alias("n_bytes"), "n_tokens").withColumn("over_limit", F.col("n_tokens") > 512)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = toxicity.train(docs, labels.filter(~held_out))
    verdicts = docs.select("doc_id", held_out.alias("held_out"), toxicity.scored("text", model).alias("verdict"))
    return verdicts.select("doc_id", "held_out", "verdict.score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = katz.train(docs.filter(~held_out))
    return katz.score(docs, model).withColumn("held_out", held_out)


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.in_reply_order(quotes.link_quotes(table(spark, sf_dir, "conversations")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    earlier = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0  # what counts as the history of the other rows
    found = exact_dedup.two_runs(docs.filter(earlier), docs.filter(~earlier))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled("embedding").alias("v"))
    return topk.search(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "v", 10)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; tampering deletes line ends of the texts whose id has an even checksum."""
    docs = table(spark, sf_dir, "documents")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest.verified(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": tampered})
    proof = manifest.digest(manifest.siblings("path")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its words inside windows of benchmark items, and which items."""
    found = winnow.with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = found.select("doc_id", "leak.n_words", hit.alias("n_hit"), F.size("leak.item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("leak.item_ids", ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document; those whose id's checksum ends in 0 are made periodic first, as the contract says."""
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    sum32 = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", sum32.alias("h"), F.when(sum32 % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i >= a, a + (i - a) % p).otherwise(i)))
    changed = words.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
    found = changed.select("doc_id", periods.with_runs("text").alias("found"))
    found = found.select("doc_id", "found", periods.longest("found.runs").alias("best"))
    lines = F.array_join(F.transform("found.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("found.runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    digests = F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2("found.collapsed", 256).alias("collapsed_sha256")
    return found.select("doc_id", F.size("found.runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli, *digests)


QUERIES = {"op1_bpe": op1_bpe, "op2_token_counts": op2_token_counts, "op3_mixing": op3_mixing, "op4_jaccard": op4_jaccard, "op5_toxicity": op5_toxicity, "op6_katz": op6_katz, "op7_quotes": op7_quotes, "op8_exact_dedup": op8_exact_dedup, "op9_suffix_dedup": op9_suffix_dedup, "op10_topk": op10_topk, "op11_manifest": op11_manifest, "op12_winnowing": op12_winnowing, "op13_periods": op13_periods}

ORACLE = {
    "op3_mixing": """
WITH RECURSIVE counts AS (SELECT source AS s, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT count(*) AS all_w, sum(n) AS all_n FROM counts),
rates AS (SELECT s, CAST(all_n AS DOUBLE) * 1.0::DOUBLE / all_w / n AS rate FROM counts, sums),
cdf AS (
  SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn AS (
  SELECT d.*, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents d),
times AS (
  SELECT drawn.doc_id, drawn.text, drawn.lang, drawn.source, drawn.n_chars, count(*) AS k
  FROM drawn JOIN cdf ON drawn.source IS NOT DISTINCT FROM cdf.s AND cdf.c <= drawn.u
  GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, k + 1)) AS INTEGER) AS "copy" FROM times
""",
    "op4_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sets a ON x = a.doc_id JOIN sets b ON y = b.doc_id
  WHERE 100 * shared >= 80 * (len(a.s) + len(b.s) - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reach r USING (doc_id) GROUP BY ALL
""",
    "op8_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
""",
    "op11_manifest": r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
crcs AS (
  SELECT doc_id, xor(list_reduce(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table),
fields AS (
  SELECT d.doc_id, source, text,
    coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || CAST(d.doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents d LEFT JOIN crcs ON d.doc_id = crcs.doc_id),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS other FROM fields)),
nodes(source, level, i, h, n) AS (
  SELECT source, 0, i, leaf, count(*) OVER (PARTITION BY source) FROM leaves
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, i // 3),
subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, i, h, n) AS (
  SELECT 0, i, h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, i // 3),
heights AS (SELECT source, max(level) AS height FROM nodes GROUP BY source),
all_nodes AS (
  SELECT source, level, i, h, n FROM nodes WHERE n > 1
  UNION ALL
  SELECT s.source, height + t.level, t.i, t.h, t.n FROM tops t, subroots s JOIN heights ON s.source IS NOT DISTINCT FROM heights.source WHERE t.n > 1),
runs AS (SELECT source, level, i // 3 AS parent, list({'i': i, 'h': h} ORDER BY i) AS each FROM all_nodes GROUP BY ALL),
walk(key, doc_id, source, leaf, level, i, folded, sides) AS (
  SELECT row_number() OVER (), doc_id, source, leaf, 0, i, other, '' FROM leaves
  UNION ALL
  SELECT key, w.doc_id, w.source, leaf, w.level + 1,
    CASE WHEN w.level + 1 = height THEN s.i ELSE parent END,
    sha256(array_to_string(list_transform(each, lambda x: CASE WHEN x.i = w.i THEN folded ELSE x.h END), '')),
    sides || array_to_string(list_transform(list_filter(each, lambda x: x.i <> w.i), lambda x: x.h), '')
  FROM (SELECT w.key, w.doc_id, w.source, w.leaf, w.level, CASE WHEN w.level = 0 AND height = 0 THEN s.i ELSE w.i END AS i, w.folded, w.sides, height, s.i AS si
    FROM walk w JOIN heights ON w.source IS NOT DISTINCT FROM heights.source JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source) w
  JOIN runs ON w.source IS NOT DISTINCT FROM runs.source AND w.level = runs.level AND w.i // 3 = parent
  JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source),
last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level DESC) AS back FROM walk)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(sides) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM last l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, (SELECT h FROM tops WHERE n = 1) r WHERE back = 1
""",
    "op12_winnowing": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths)),
hits AS (SELECT r, s, p.n, item_id FROM places p JOIN windows USING (n, t)),
covered AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""",
}
