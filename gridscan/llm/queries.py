"""One query per operator over its whole table; names and columns are fixed by contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridscan.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco

_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

LINES_SQL = f"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, {_WORDS.format("text")} AS w FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS k FROM tri WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, host, text, line, len(lw) AS n, regexp_replace(lower(array_to_string(lw, ' ')), '[1-9]', '0', 'g') AS norm
  FROM (SELECT *, {_WORDS.format("line")} AS lw FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE len(lw) > 0),
freq AS (SELECT host, norm FROM l GROUP BY host, norm HAVING count(DISTINCT doc_id) > 10),
lost AS (SELECT doc_id, count(DISTINCT l.norm) AS k, sum(n) AS n FROM l JOIN freq ON l.norm = freq.norm AND l.host IS NOT DISTINCT FROM freq.host GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY 1),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  CAST(coalesce(lost.k, 0) AS INTEGER) AS n_removed_lines, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_removed_words <= 0.5 * n_words AS kept FROM f
"""

NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s), e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a)
SELECT doc_id, any_value(n) AS n_shingles, min(y) AS component_id, doc_id = min(y) AS kept FROM n JOIN r ON x = doc_id GROUP BY doc_id
"""

PASSAGES_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT g, min(doc_id) AS first FROM x GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS k FROM x JOIN m USING (g) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM t ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""


@query("op3_toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM r
"""


@query("op6_exact_dedup", EXACT_SQL)
def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.exact_dedup import dedup_exact

    return dedup_exact(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op2_near_dedup", NEAR_SQL)
def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op5_secret_scan")
def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.secret_scan import BASE, joined, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in BASE]
    base = joined(F.filter("spans", lambda x: x["kind"].isin(*BASE)))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op8_best_fit_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query("op10_repeated_passages", PASSAGES_SQL)
def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.passages import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op1_line_rules", LINES_SQL)
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.line_rules import line_rules

    out = line_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.size("removed_lines").alias("n_removed_lines"), "n_removed_words")


@query("op4_bpe")
def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridscan.llm.bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(role) + length(text) + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, p)) + len(regexp_extract_all(role, p)) + length(role) - length(replace(role, chr(10), ''))
    + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS n
  FROM c, (SELECT '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>' AS p))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op7_chat_format", CHAT_SQL)
def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.chat import conversation_nodes, format_branches, read_back, unescaped

    probe = spark.sql("SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    out = format_branches(conversation_nodes(talks)).withColumn("turns", read_back(F.col("formatted")))
    learnt = unescaped(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.when(F.col("tree") != "", F.col("tree")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op9_quality_grade")
def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.ordinal import grade_texts

    # Three grades: bad, good but toxic, good.
    ratings = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.when((F.col("quality") > 0) & (F.col("toxic") == 0), 1).otherwise(0)).alias("grade"))
    return grade_texts(table(spark, sf_dir, "documents"), ratings, n_grades=3)


#: crc32 of a UTF-8 text in SQL: the table of bytes from its rule, then one fold over the bytes.
_CRC_TABLE = "SELECT list(c ORDER BY v) AS t FROM (SELECT v, list_reduce([v]::BIGINT[] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS v))"
_BYTES = "[4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
_CRC = "xor(list_reduce({}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def _shards_sql(shards: int = 24, seed: int = 0) -> str:
    from gridscan.llm.sharding import PRIME, round_keys

    steps = "SELECT i, n, a, b, x // b AS l, x % b AS r FROM {}"
    for k, key in enumerate(round_keys(seed)):
        side, other, modulus = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        for now in (f"({other} + {key}) % {PRIME} AS t", f"t * t % {PRIME} AS t", f"(t + {key}) * t % {PRIME} AS t"):
            steps = f"SELECT i, n, a, b, l, r, {now} FROM ({steps})"
        steps = f"SELECT i, n, a, b, {other}, ({side} + t) % {modulus} AS {side} FROM ({steps})"
    steps = f"SELECT i, n, a, b, l * b + r AS x FROM ({steps})"
    named = lambda c: f"coalesce(md5(CAST({c} AS VARCHAR)), '-')"
    return f"""
WITH RECURSIVE tab AS MATERIALIZED ({_CRC_TABLE}),
e AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {_BYTES.format("coalesce(text, '')")} AS bytes,
  md5(concat_ws(':', {", ".join(map(named, ["doc_id", "lang", "n_chars", "source", "text"]))})) AS digest FROM documents),
d AS MATERIALIZED (SELECT doc_id, size, {_CRC.format("bytes")} AS text_crc32, digest FROM e, tab),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY digest) - 1 AS i FROM d),
m AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM d)),
walk(i, n, a, b, x) AS ({steps.format("(SELECT i, n, a, b, i AS x FROM o, m)")} UNION ALL {steps.format("(SELECT * FROM walk WHERE x >= n)")})
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, x // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM o JOIN walk USING (i) WHERE x < n
"""


@query("op12_feistel_shards", _shards_sql())
def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def _negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


VARIANTS_SQL = f"""
WITH RECURSIVE tab AS MATERIALIZED ({_CRC_TABLE}),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
e AS (SELECT run, n, {_BYTES.format("concat(doc_id, ':', run)")} AS bytes FROM r),
h AS (SELECT run, n, {_CRC.format("bytes")} AS h FROM e, tab),
t AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT word, n, k, left(word, k) AS a, substr(word, k + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS k FROM w)),
p AS (SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y USING (k, a, b) WHERE x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN w y ON x.a || x.b = y.word UNION SELECT y.word, x.word, x.n FROM cut x JOIN w y ON x.a || x.b = y.word),
f AS MATERIALIZED (SELECT word, any_value(n) AS n, count(other) AS n_near, min_by(other, (-m, other)) AS best, max(m) AS m FROM w LEFT JOIN p USING (word) GROUP BY word),
g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN m >= 5 * n THEN best END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM f),
go(word, root) AS (SELECT word, word FROM g UNION ALL SELECT go.word, g.form FROM go JOIN g ON go.root = g.word WHERE g.form IS NOT NULL)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN go USING (word) WHERE root NOT IN (SELECT word FROM g WHERE form IS NOT NULL)
"""


@query("op11_spelling_variants", VARIANTS_SQL)
def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridscan.llm.spelling import document_variants

    return document_variants(table(spark, sf_dir, "documents"))
