"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat_format, chat_repair, exact_dedup, language_id, lattice_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec, sharding, toxicity, url_filter, whitening
from quern.session import table


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, translate(coalesce(text, ''), E' \t\n\x0b\f\r', '') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id)
"""


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat_format.format_chats(turns).select("*", chat_format.parse_chats(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("learned"))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '\\\\|<</SYS>>|<<SYS>>|\[/INST\]|\[/ROLE\]|\[/TURN\]|\[INST\]|\[ROLE\]|\[TURN\]|</s>|<s>', '__', 'g'))
    + CASE role WHEN 'system' THEN 16 - 1 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 END AS n,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after
  FROM t
), v AS (
  SELECT *, CASE role
      WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant') ELSE before = 'user' AND before IS NOT NULL END
    AND (after IS NOT NULL OR role = 'assistant') AS fine
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars,
       bool_and(fine) AS valid
FROM v GROUP BY conv_id
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs, language_id.train(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "start")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), by="bytes", columns=["doc_id", "source", "text"])


OP6_SQL = r"""
WITH s AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1) AS size FROM documents GROUP BY source
), r AS (
  SELECT source, (sum(size) OVER ())::DOUBLE / (count(*) OVER ()) / size AS rate FROM s
), c AS (
  SELECT source, list(p ORDER BY k) AS cdf FROM (
    SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
    FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 12)::BIGINT)) AS k FROM r)
  ) GROUP BY source
), d AS (
  SELECT d.doc_id, d.source, d.text, len(list_filter(c.cdf, lambda x: x <= ('0x' || substr(md5('mix:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0)) AS n
  FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source
), k AS (SELECT doc_id, source, text, unnest(range(0, n))::INTEGER AS mix_copy FROM d WHERE n > 0)
SELECT doc_id, source, text, mix_copy, ('0x' || substr(md5('mix:' || doc_id || ':' || mix_copy), 1, 15))::BIGINT AS mix_key FROM k
"""


def block_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of `pages`, dealt by the digits of md5(host): hosts, domains and language folders."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    digit = lambda i: F.conv(F.substring(F.md5("host"), i, 1), 16, 10).cast("int")
    day = lambda n: F.expr("timestamp'2024-01-01'") + F.make_interval(days=n)
    rows = hosts.select(
        F.when(digit(4) < 8, "spam").otherwise("adult").alias("list"),
        digit(1).alias("a"),
        digit(2).alias("b"),
        digit(3).alias("c"),
        "host",
    )
    kind = F.when(F.col("a") < 4, "host").when(F.col("a") < 7, "domain").when(F.col("a") < 10, "prefix")
    key = F.when(F.col("a") < 4, F.col("host")).when(F.col("a") < 7, F.substring_index("host", ".", -3)).when(F.col("a") < 10, F.concat("host", F.lit("/en")))
    listed = rows.select("list", kind.alias("kind"), key.alias("key"), (F.col("b") * 10).alias("on"), (F.col("b") * 10 + 30 + F.col("c") * 10).alias("off")).filter("kind is not null").distinct()
    return listed.select("list", "kind", "key", day(F.col("on")).alias("date"), F.lit("add").alias("action")).unionByName(
        listed.select("list", "kind", "key", day(F.col("off")).alias("date"), F.lit("remove").alias("action"))
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # The tables have no fetch times: a page's is a day of 2024 from its id.
    fetched = F.expr("timestamp'2024-01-01'") + F.make_interval(days=(F.col("page_id") * 7919 % 366).cast("int"))
    out = url_filter.filter_urls(pages.withColumn("fetch_time", fetched), block_entries(pages))
    return out.select("page_id", "fetch_time", "host", F.array_join("lists", ",").alias("lists"), F.array_join("matched", ",").alias("matched"), "blocked")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id * 7919 % 366)::INTEGER) AS fetch_time,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]*)', 1) AS folder
  FROM pages
), h AS (
  SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 1))::INTEGER AS a, ('0x' || substr(md5(host), 2, 1))::INTEGER AS b,
         ('0x' || substr(md5(host), 3, 1))::INTEGER AS c, ('0x' || substr(md5(host), 4, 1))::INTEGER AS l FROM p WHERE host IS NOT NULL
), listed AS (
  SELECT DISTINCT CASE WHEN l < 8 THEN 'spam' ELSE 'adult' END AS list,
         CASE WHEN a < 4 THEN 'host' WHEN a < 7 THEN 'domain' ELSE 'prefix' END AS kind,
         CASE WHEN a < 4 THEN host WHEN a < 7 THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE host || '/en' END AS key,
         b * 10 AS on_day, b * 10 + 30 + c * 10 AS off_day
  FROM h WHERE a < 10
), entries AS (
  SELECT list, kind, key, TIMESTAMP '2024-01-01' + to_days(on_day) AS date, 'add' AS action FROM listed
  UNION ALL SELECT list, kind, key, TIMESTAMP '2024-01-01' + to_days(off_day), 'remove' FROM listed
), keys AS (
  SELECT page_id, 'host' AS kind, host AS key FROM p WHERE host IS NOT NULL
  UNION SELECT page_id, 'domain', array_to_string(string_split(host, '.')[i:], '.') FROM p, range(1, 12) g(i) WHERE host IS NOT NULL AND i <= len(string_split(host, '.'))
  UNION SELECT page_id, 'prefix', host || '/' || lower(folder) FROM p WHERE host IS NOT NULL AND folder <> ''
), hits AS (
  -- As of the fetch time: the latest entry of the list and key, a removal first among equals.
  SELECT k.page_id, e.list, e.kind, e.key, arg_max(e.action, (e.date, e.action)) AS action
  FROM keys k JOIN p USING (page_id) JOIN entries e ON e.kind = k.kind AND e.key = k.key AND e.date <= p.fetch_time
  GROUP BY ALL
), m AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(DISTINCT kind || ':' || key, ',' ORDER BY kind || ':' || key) AS matched
  FROM hits WHERE action = 'add' GROUP BY page_id
)
SELECT page_id, fetch_time, host, coalesce(lists, '') AS lists, coalesce(matched, '') AS matched, lists IS NOT NULL AS blocked
FROM p LEFT JOIN m USING (page_id)
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2")
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask("base"))) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), r AS (
  SELECT doc_id, unnest(range(i, i + 8)) AS word FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM g) WHERE n > 1
), c AS (SELECT doc_id, count(DISTINCT word) AS n FROM r GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_upper, len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaims
  FROM d LEFT JOIN c USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 16 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * word_chars < 3 * n_words THEN 64 ELSE 0 END + CASE WHEN 2 * n_exclaims > n_words THEN 128 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


#: The tokenizer of the SentencePiece queries, a public file.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_decode(docs, sentencepiece_codec.load(PIECES))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), words=4, percent=85)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n m ON m.doc_id = p.a JOIN n o ON o.doc_id = p.b WHERE 100 * p.i >= 85 * (m.n + o.n - p.i)
), reach(doc_id, peer) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.peer
)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(peer) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_repair.damaged(table(spark, sf_dir, "conversations"))
    return chat_repair.report(chat_repair.repair(turns, copies_col="copies")).withColumnRenamed("conv", "conv_id")


def _way(at: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state's struct (cost, edits, text so far) after one more edit, as SQL; null stays null."""
    text = f"CASE {at}.t WHEN '' THEN '' ELSE {at}.t || chr(10) END || {line}" if line else f"{at}.t"
    return f"CASE WHEN {at} IS NOT NULL THEN struct_pack(c := {at}.c + {cost}, a := {at}.a || '{letter}', t := {text}) END"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}], 'ASC', 'NULLS LAST')[1]"


#: The states: no role yet, system, user, assistant last. First rows may be inserted, then the row is deleted, kept or given the role that is due.
_DUE_USER = ("u0", "u1", "u3")
_SAID, _USER, _ASSISTANT = "role || ':' || text", "'user:' || text", "'assistant:' || text"
_INSERTED = f"""SELECT * REPLACE ({_least("u2", *[_way(s, "5", "I", "'user:'") for s in _DUE_USER])} AS u2) FROM ("""
OP12_SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), k AS (
  -- crc32, bit by bit.
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS k FROM src
), d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0
), n AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS times, trim(text, E' \t\n\r\f' || chr(11)) AS core FROM n
), f AS MATERIALIZED (
  SELECT conv_id, turn, role, text, n, left(role, 1) AS i, CASE WHEN core = '' THEN 1 WHEN times > 1 THEN 2 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal, CASE WHEN core <> '' AND times = 1 AND right(core, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more
  FROM o
), p AS (
  SELECT conv_id, 0::BIGINT AS n, struct_pack(c := 0::BIGINT, a := '', t := '') AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, {_way("u0", "2", "D")}, {_least(_way("u1", "2", "D"), f"CASE WHEN i = 's' AND fault NOT IN (1, 2) THEN {_way('u0', 'more', 'K', _SAID)} END")},
    {_least(_way("u2", "2", "D"), *[f"CASE WHEN i = 'u' AND fault NOT IN (1, 2) THEN {_way(u, 'more', 'K', _SAID)} END" for u in _DUE_USER], *[f"CASE WHEN fault NOT IN (1, 2) THEN {_way(u, 'more + 1', 'R', _USER)} END" for u in _DUE_USER])},
    {_least(_way("u3", "2", "D"), f"CASE WHEN i = 'a' AND fault NOT IN (1, 2) THEN {_way('u2', 'more', 'K', _SAID)} END", f"CASE WHEN fault NOT IN (1, 2) THEN {_way('u2', 'more + 1', 'R', _ASSISTANT)} END")}
  FROM (
    SELECT * REPLACE ({_least("u3", _way("u2", "5", "I", "'assistant:'"))} AS u3) FROM (
      {_INSERTED}SELECT f.*, p.s0 AS u0, p.s1 AS u1, p.s2 AS u2, p.s3 AS u3 FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1)
    )
  )
), e AS (SELECT conv_id, max(n) AS n FROM p GROUP BY 1),
g AS (
  SELECT conv_id, {_least("u0", "u3")} AS best FROM (
    SELECT * REPLACE ({_least("u3", _way("u2", "5", "I", "'assistant:'"))} AS u3) FROM (
      {_INSERTED}SELECT p.conv_id, p.s0 AS u0, p.s1 AS u1, p.s2 AS u2, p.s3 AS u3 FROM p JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.n = p.n)
    )
  )
), r AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY 1
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
FROM g LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id
"""


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(vec_id, peer) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.peer
), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT r.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(peer) AS component_id, r.vec_id = min(peer) AS kept FROM reach r LEFT JOIN n USING (vec_id) GROUP BY r.vec_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_language_id": op2_language_id,
        "op3_toxicity": op3_toxicity,
        "op4_sharding": op4_sharding,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_mixing": op6_mixing,
        "op7_url_filter": op7_url_filter,
        "op8_quality_rules": op8_quality_rules,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_ngram_join": op10_ngram_join,
        "op11_whitening": op11_whitening,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_near_vectors": op13_near_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1_SQL,
        "op6_mixing": OP6_SQL,
        "op7_url_filter": OP7_SQL,
        "op8_quality_rules": OP8_SQL,
        "op9_exact_dedup": OP9_SQL,
        "op10_ngram_join": OP10_SQL,
        "op12_conversation_repair": OP12_SQL,
        "op13_near_vectors": OP13_SQL,
    }
