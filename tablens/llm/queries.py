"""The numbered queries over the driver tables, and the SQL of those that SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .conversation_trie import conversation_trie
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .html_text import extract
from .jaccard_join import jaccard_join
from .language import language_id
from .lexical_search import ranked_search
from .licenses import scan_licenses
from .line_dedup import line_dedup, passage_dedup
from .sharding import shard
from .token_counts import count_tokens
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "text", F.col("removed_lines").cast("long").alias("removed_lines"))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = passage_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "text", F.col("removed_lines").cast("long").alias("removed_lines"))


def held_out():
    """Documents that language identification may not learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id(table(spark, sf_dir, "documents"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return conversation_trie(table(spark, sf_dir, "conversations"), shared)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~fifth)
    held = F.coalesce(fifth, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "score", "predicted", "nearest_id", "nearest_cosine")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_bpe": op4_bpe,
    "op5_html_extraction": op5_html_extraction,
    "op6_license_scan": op6_license_scan,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op9_passage_dedup": op9_passage_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_toxicity": op13_toxicity,
}

OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, i, lines[i] AS line,
         CAST('0x' || substr(md5(lines[i]), 1, 8) AS BIGINT) AS h,
         length(lines[i]) - length(replace(lines[i], ' ', '')) + 1 AS words, len(lines) AS n
  FROM d, unnest(generate_series(1, len(lines))) AS u(i)
),
e AS (
  SELECT *, i = n OR (xor(h, coalesce(lag(h) OVER w, 0) * 2) >> 5) % 2 = 0 OR words >= 50
         OR coalesce(lead(words) OVER w >= 50, false) AS stop
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
c AS (SELECT *, coalesce(sum(CAST(stop AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
p AS (
  SELECT doc_id, k, min(i) AS start, max(i) AS stop, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, k
),
q AS (
  SELECT *, (stop > start OR length(chunk) - length(replace(chunk, ' ', '')) + 1 >= 50)
         AND length(chunk) - length(replace(chunk, ' ', '')) + 1 >= 8 AS able FROM p
),
r AS (SELECT *, able AND row_number() OVER (PARTITION BY chunk, able ORDER BY doc_id, start) > 1 AS gone FROM q)
SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text,
       CAST(coalesce(sum(stop - start + 1) FILTER (WHERE gone), 0) AS BIGINT) AS removed_lines
FROM r GROUP BY doc_id
UNION ALL SELECT doc_id, text, 0 FROM documents WHERE text IS NULL
"""

OP12_SQL = r"""
WITH t AS (
  SELECT doc_id AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
q AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
f AS (SELECT id, term, count(*) AS tf FROM t GROUP BY id, term),
n AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM c) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM f GROUP BY term
),
m AS (SELECT id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM n, c),
s AS (
  SELECT item_id, id AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (id) GROUP BY item_id, id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""



def crc32_sql(digits: str) -> str:
    """CRC-32 of ASCII text in DuckDB, four bits at a time; the table follows from the polynomial."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    nibbles = f"flatten(list_transform(string_split({digits}, ''), lambda x: [ascii(x) & 15, ascii(x) >> 4]))"
    step = f"lambda s, x: xor(s >> 4, ({table})[(xor(s, x) & 15) + 1])"
    return f"xor(list_reduce(list_concat([4294967295], {nibbles}), {step}), 4294967295)"


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (SELECT c, {crc32_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
b AS (
  SELECT c.c, 0 AS own, i, r, x FROM c JOIN t ON t.c = c.c - c.c % 100 AND i <= h
  UNION ALL SELECT c.c, 1, i, r, x FROM c JOIN t USING (c) WHERE i > h
),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS depth, r, x FROM b),
p AS (
  SELECT c, depth, length(x) AS size, list({{'r': r, 'x': x}}) OVER (PARTITION BY c ORDER BY depth) AS path FROM d
  UNION ALL SELECT c, 0, 0, [] FROM c
),
n AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n, max(size) AS size FROM p GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS children FROM n WHERE depth > 0 GROUP BY ALL),
o AS (SELECT n.*, coalesce(children, 0) AS children, (n - 1) * size AS saved FROM n LEFT JOIN k ON n.path = k.path),
u AS (
  SELECT path[1:a] AS path, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(generate_series(0, depth)) AS a FROM o) GROUP BY ALL
),
e AS (
  SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends
  FROM p JOIN (SELECT c, max(depth) AS depth FROM p GROUP BY c) USING (c, depth) GROUP BY path
)
SELECT o.conv_id, o.depth, up.conv_id AS parent_conv_id, o.n AS n_convs, o.children AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM o JOIN u ON u.path = o.path LEFT JOIN e ON e.path = o.path
LEFT JOIN o AS up ON o.depth > 0 AND up.path = o.path[1:o.depth - 1]
"""

ORACLES = {"op11_conversation_trie": OP11_SQL, "op2_exact_dedup": OP2_SQL, "op9_line_dedup": OP9_SQL, "op12_lexical_search": OP12_SQL}
