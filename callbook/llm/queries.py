"""One query for each operator, over the whole given tables with production settings."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callbook.llm import (bpe, chat, classlm, collocations, factorisation, hnsw, jaccard, licenses, outliers, packing,
                          repeats, secrets, sharding)
from callbook.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return keep


@query("op1_packing")
def op1_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), remembered=400_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query("op2_factorisation_machine")
def op2_factorisation_machine(spark, sf_dir):
    return factorisation.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


CHAT_SQL = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, length(text) + (length(text) - length(replace(text, chr(92), '')))
            + (length(text) - length(replace(text, '<s>', ''))) // 3
            + (length(text) - length(replace(text, '</s>', ''))) // 4
            + (length(text) - length(replace(text, '[INST]', ''))) // 6
            + (length(text) - length(replace(text, '[/INST]', ''))) // 7
            + (length(text) - length(replace(text, '[ROLE]', ''))) // 6
            + (length(text) - length(replace(text, '[/ROLE]', ''))) // 7
            + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE length(role) + 16 END AS size
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
           AS loss_sha256,
       CAST(3 + sum(size) AS BIGINT) AS formatted_chars, false AS history_rewritten
FROM sized GROUP BY conv_id
"""


@query("op3_incremental_chat", CHAT_SQL)
def op3_incremental_chat(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("""
        SELECT -1L AS conv_id, CAST(turn AS bigint) AS turn, role, '</s>[INST] ok [/INST]' AS text
        FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    return chat.digest(chat.format_turns(given.unionByName(probe)))


@query("op5_robust_outliers")
def op5_robust_outliers(spark, sf_dir):
    return outliers.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *outliers.COUNTS, "base_failed", "distance", "kept")


def joined_spans(column):
    return F.concat_ws(",", F.transform(column, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _only(kind):
    return lambda x: F.when(x == kind, x)


@query("op8_secret_worklist")
def op8_secret_worklist(spark, sf_dir):
    found = secrets.scan_table(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _only(kind)))).cast("long").alias(f"n_{kind}")
              for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined_spans("base"), 256).alias("base_sha256"),
                        joined_spans("spans").alias("spans"))


@query("op9_merge_replay")
def op9_merge_replay(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(coded, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_label_propagation")
def op10_label_propagation(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op4_minhash_join")
def op4_minhash_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")) \
        .withColumn("kept", F.col("doc_id") == F.col("class_id"))


@query("op6_class_lm")
def op6_class_lm(spark, sf_dir):
    found = classlm.score(table(spark, sf_dir, "documents"), ~classlm.held_out())
    return found.select("doc_id", classlm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        "base_score", "score")


@query("op7_small_world_links")
def op7_small_world_links(spark, sf_dir):
    return hnsw.link(table(spark, sf_dir, "embeddings")) \
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))


def with_repeated_end(key: object, text: str) -> list[bytes]:
    """The words of a text; of every tenth key, the last ones repeat what stands before them."""
    words = repeats.words_of(key, text)
    chosen, n = (1 if key is None else zlib.crc32(str(key).encode())), len(words)
    if chosen % 10 or not n:
        return words
    turn = chosen // 10
    start = turn % n
    period = 1 + (n - start) // (3 + turn % 8)
    times = -(-(n - start) // period)
    return words[:start] + (words[start:start + period] * times)[:n - start]


@query("op11_word_runs")
def op11_word_runs(spark, sf_dir):
    found = repeats.find(table(spark, sf_dir, "documents"), words=with_repeated_end)
    # The greatest exponent by cross-multiplication; runs are in order, so the first of equals stays.
    best = F.expr("""aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>),
        (best, x) -> IF(best IS NULL OR x.length * best.period > best.length * x.period, x, best))""")
    listed = F.concat_ws("", F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    """The same rules without keywords, located by the lengths of what stands between the matches."""
    values = ", ".join(f"({i}, {r.tier}, {_quoted(r.label)}, {r.confidence}, {_quoted(r.regex)})"
                       for i, r in enumerate(licenses.rules()))
    base = len(licenses.BASE)
    return f"""
WITH rules(no, tier, label, confidence, regex) AS (VALUES {values}),
spelt AS (
    SELECT row_number() OVER () AS id, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{licenses.LETTERS[0]}',
        '{licenses.LETTERS[1]}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') AS w FROM documents
), texts AS (
    SELECT id, doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || w || ' ' END AS words FROM spelt
), hits AS (
    SELECT id, no, tier, label, confidence, string_split_regex(words, regex) AS gaps,
           regexp_extract_all(words, regex) AS found
    FROM texts JOIN rules ON regexp_matches(words, regex)
), placed AS (
    SELECT id, no, tier, label, confidence, unnest(range(1, len(found) + 1)) AS j, gaps, found FROM hits
), matches AS (
    SELECT id, no, tier, label, confidence, s AS start, s + (length(found[j]) - length(replace(found[j], ' ', ''))) // 2 AS stop
    FROM (SELECT *, (length(before) - length(replace(before, ' ', ''))) // 2 AS s FROM (
        SELECT *, array_to_string(gaps[1:j], '') || array_to_string(found[1:j - 1], '') AS before
        FROM placed))
), kept AS (
    SELECT * FROM matches m WHERE no < {base} OR NOT EXISTS (
        SELECT 1 FROM matches o WHERE o.id = m.id AND o.tier <= m.tier AND o.start <= m.start AND o.stop >= m.stop
          AND (o.start < m.start OR o.stop > m.stop OR o.tier < m.tier OR o.no < m.no))
), base AS (
    SELECT id, count(*) AS n, min(start) AS first_word, max(start) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM matches WHERE no < {base} GROUP BY id
), shown AS (
    SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(confidence) AS score FROM kept GROUP BY id
)
SELECT doc_id, CAST((length(words) - length(replace(words, ' ', ''))) // 2 AS BIGINT) AS n_words,
       coalesce(b.n, 0) AS n_base, first_word, last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(s.labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM texts LEFT JOIN base b USING (id) LEFT JOIN shown s USING (id)
"""


@query("op12_license_rules", license_sql())
def op12_license_rules(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["rule"] < len(licenses.BASE))

    def joined(column):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda m: m["label"]))), ",")

    return found.withColumn("base", base).withColumn("all", F.concat("base", "detections")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda m: m["start"])).alias("last_word"),
        joined("base").alias("base_labels"), joined("all").alias("labels"),
        F.coalesce(F.array_max(F.transform("all", lambda m: m["confidence"])), F.lit(0.0)).alias("score"))


COLLOCATION_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces
), sizes AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), grams AS (
    SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4), (5)) AS t(k)
    WHERE len(w) >= k
), f AS (
    SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
    SELECT * FROM f WHERE k > 1
), parts AS (
    SELECT lang, a, p, k, b, unnest(range(b + 1, k + 1)) AS e FROM
        (SELECT *, unnest(range(1, k)) AS b FROM (SELECT * FROM candidates WHERE k > 2))
    UNION ALL SELECT lang, a, p, k, b, unnest(range(b + 1, k + 1)) AS e FROM
        (SELECT *, k AS b FROM candidates WHERE k > 2)
), inner_ones AS (
    SELECT DISTINCT s.lang, s.p FROM candidates s JOIN (
        SELECT lang, a, p[b:e] AS p FROM parts WHERE e - b + 1 < k) l ON s.lang = l.lang AND s.p = l.p
    WHERE CAST(100 AS HUGEINT) * l.a >= CAST(100 AS HUGEINT) * s.a
), cuts AS (
    SELECT c.lang, c.p, c.a, c.k, unnest(range(1, c.k)) AS cut FROM candidates c
    ANTI JOIN inner_ones i ON c.lang = i.lang AND c.p = i.p
), scored AS (
    SELECT c.lang, c.p, c.a, cut, x.a AS l, y.a AS r, n,
           CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:cut]
    JOIN f y ON y.lang = c.lang AND y.p = c.p[cut + 1:c.k] JOIN sizes z ON z.lang = c.lang
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
       array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000
"""


@query("op13_collocations", COLLOCATION_SQL)
def op13_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))
