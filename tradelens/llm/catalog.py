"""The registered queries of the training-data operators and, where SQL can
express them, the same queries as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    language_id,
    license_scan,
    line_dedup,
    packing,
    sharding,
    simhash_dedup,
    spelling_variants,
    substring_dedup,
    tokenizer_alignment,
    warc,
)
from tradelens.llm.common import cut, remove_folder, shared_path, table
from tradelens.llm.tokens import Vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def public_vocabulary() -> Vocabulary:
    """The byte-level BPE vocabulary of the installed public tokenizer files."""
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.json"),
                      public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op1_exact_dedup")
def op1(spark, sf_dir):
    return exact_dedup.duplicate_classes(table(spark, sf_dir, "documents"))


ORACLE_SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))"""


@_query("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    return (simhash_dedup.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=3, max_distance=3, seed=42)
            .select("doc_id", "fingerprint", "component_id"))


@_query("op3_license_scan")
def op3(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.default_templates(spark))


def _turns(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


@_query("op4_chat_format")
def op4(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)],
                              "conv_id long, turn long, role string, text string"))
    chat = chat_format.format_chat(chat_format.gathered(rows))
    back = chat.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("back"),
                       chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("learned"))
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(_turns(F.col("back")), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


TRAP = "</s>[INST] ok [/INST]"


def _chat_sql() -> str:
    """Each control string is broken by one replacement of its own here."""
    def esc(e: str) -> str:
        e = f"replace({e}, '\\', '\\\\')"
        for c in chat_format.CONTROL:
            e = f"replace({e}, '{c}', '{c[0]}\\{c[1:]}')"
        return e

    marks = len(chat_format.START) + len(chat_format.SEPARATOR) + len(chat_format.END)
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRAP}' UNION ALL SELECT -1, 1, 'assistant', '{TRAP}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({esc('role')}) + length({esc('text')}) + {marks}) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""


ORACLE_SQL["op4_chat_format"] = _chat_sql()

SHARD_BYTES = 1 << 20


@_query("op5_sharding")
def op5(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES, carry=["doc_id"])


# A record's shard is the shortest prefix of its hash whose records fit.
ORACLE_SQL["op5_sharding"] = f"""
WITH records AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(1) || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
prefixes AS (
  SELECT d AS depth, h >> (60 - d) AS prefix, sum(n_bytes) AS shard_bytes
  FROM records, range(0, 61) AS r(d) GROUP BY ALL HAVING sum(n_bytes) <= {SHARD_BYTES}),
placed AS (
  SELECT doc_id, n_bytes, h, min(depth) AS depth, arg_min(prefix, depth) AS prefix, arg_min(shard_bytes, depth) AS shard_bytes
  FROM (SELECT r.*, d AS probe FROM records r, range(0, 61) AS t(d)) x
  JOIN prefixes p ON p.depth = x.probe AND p.prefix = x.h >> (60 - x.probe)
  GROUP BY doc_id, n_bytes, h)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes,
       CASE WHEN depth = 0 THEN '.' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard_id,
       CAST(depth AS INTEGER) AS shard_depth, CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM placed"""


@_query("op6_substring_dedup")
def op6(spark, sf_dir):
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return _digest(done, "n_words")


# All windows of 50 words, grouped by their words.
ORACLE_SQL["op6_substring_dedup"] = """
WITH texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') AS words
  FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM texts WHERE len(words) >= 50),
windows AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 49], ' ') AS fifty FROM starts),
again AS (
  SELECT doc_id, pos FROM windows WHERE doc_id IS NOT NULL
  QUALIFY min(doc_id) OVER (PARTITION BY fifty) < doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS nth FROM again),
numbered AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS nth, unnest(words) AS word FROM texts),
kept AS (
  SELECT n.doc_id, count(*) AS n_words, count(g.nth) AS n_removed,
         string_agg(word, ' ' ORDER BY n.nth) FILTER (g.nth IS NULL) AS kept_text
  FROM numbered n LEFT JOIN gone g USING (doc_id, nth) GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""


def _digest(done, count):
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["length"])
    return done.select("doc_id", count, removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op7_language_id")
def op7(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


@_query("op8_benchmark_decontamination")
def op8(spark, sf_dir):
    return decontaminate.contaminated_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op9_line_dedup")
def op9(spark, sf_dir):
    return _digest(line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"), run=3, long_line=LONG_LINE), "n_lines")


LONG_LINE = 40

# A line goes if it lies in three lines that also begin earlier (in the same
# document three lines earlier at least), if it is long and has come before, or if it
# equals the line above; for the last two it must not be blank.
ORACLE_SQL["op9_line_dedup"] = f"""
WITH texts AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''),
starts AS (
  SELECT doc_id, unnest(range(1, len(lines) - 1)) AS pos, lines FROM texts WHERE len(lines) >= 3),
windows AS (
  SELECT doc_id, pos, lines[pos:pos + 2] AS three FROM starts),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, min(row(doc_id, pos)) OVER (PARTITION BY three) AS f FROM windows)
  WHERE f[1] <> doc_id OR pos >= f[2] + 3),
numbered AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS content FROM texts),
gone AS (
  SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM later
  UNION SELECT doc_id, line FROM (
    SELECT doc_id, line, row_number() OVER (PARTITION BY content ORDER BY doc_id, line) AS nth
    FROM numbered WHERE length(content) >= {LONG_LINE} AND NOT regexp_full_match(content, '[ \t\v\f\r]*'))
  WHERE nth > 1
  UNION SELECT a.doc_id, a.line FROM numbered AS a JOIN numbered AS b
    ON a.doc_id = b.doc_id AND a.line = b.line + 1 AND a.content = b.content
  WHERE NOT regexp_full_match(a.content, '[ \t\v\f\r]*')),
kept AS (
  SELECT n.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
         string_agg(content, chr(10) ORDER BY n.line) FILTER (g.line IS NULL) AS kept_text
  FROM numbered n LEFT JOIN gone g USING (doc_id, line) GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""


@_query("op10_packing")
def op10(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_vocabulary(), size=1024)


@_query("op13_warc")
def op13(spark, sf_dir):
    folder = shared_path(spark, "warc")
    archives = warc.write_archives(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    pages = cut(warc.read_archives(spark, archives, payloads=False)
                .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove_folder(spark, folder)
    return pages


# Base 32 from the hex digits: five of them are four letters.
ORACLE_SQL["op13_warc"] = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       translate(array_to_string(list_transform(range(0, 8), lambda k:
         to_base(CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT), 32, 4)), ''),
         '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts"""


@_query("op12_tokenizer_alignment")
def op12(spark, sf_dir):
    import public_tokenizers

    return tokenizer_alignment.align(table(spark, sf_dir, "documents"), public_vocabulary(),
                                     public_tokenizers.path("piece_bpe_32k.model"))[0]


@_query("op11_spelling_variants")
def op11(spark, sf_dir):
    return spelling_variants.variants(table(spark, sf_dir, "documents"))
