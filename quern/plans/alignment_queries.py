"""Queries that align, match and compare, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import audit as A
from quern.operators import byte_echoes as B
from quern.operators import chunk_refs as R
from quern.operators import deltas as D
from quern.operators import folds
from quern.operators import matching as M
from quern.operators import medians
from quern.operators import path_codes as P
from quern.plans.base import REQUESTS, cte, query, view
from quern.session import table


def document_versions(spark, sf):
    """Four versions of every document: as it is, once more, with lines edited, and with other lines edited."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = F.array(F.col("text"), F.col("text"), D.edited(F.col("text"), 7), D.edited(D.edited(F.col("text"), 7), 3))
    return docs.select("key", F.posexplode(texts).alias("idx", "text"))


@query()
def version_deltas(spark, sf):
    """Versions as line diffs against the one before, where that is under half the bytes."""
    out = D.deltas(document_versions(spark, sf))
    return out.select("key", "idx", "prev", "bytes", "delta_bytes", F.sha2("delta", 256).alias("delta_sha256"))



@query("""
WITH s AS (
  SELECT CASE WHEN id % 11 = 0 THEN 'fh:' || substr(sha256('said ' || id % 200), 1, 16) || repeat(' ', (id % 3)::INT) || ':' || id WHEN id % 11 = 1 THEN 'fh:' || substr(sha256('said ' || id), 1, 16) WHEN id % 2 = 0 THEN 'no-session:' || id ELSE 'fh:' || id END AS session,
    CASE WHEN id % 17 = 0 THEN NULL ELSE epoch_us(lo) / 1e6 END AS lo, CASE WHEN id % 19 = 0 THEN NULL ELSE epoch_us(hi) / 1e6 - CASE WHEN id % 3 = 0 THEN 0.9 * (epoch_us(hi) - epoch_us(lo)) / 1e6 ELSE 0 END END AS hi,
    CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'm' || id % 40 END AS model, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'codex' ELSE 'f' || id % 7 END AS family
  FROM (SELECT user_id, date_trunc('day', ts) AS day, min(ts) AS lo, max(ts) AS hi, min(event_id) AS id FROM events GROUP BY 1, 2)
), t AS (
  SELECT event_id AS thread, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'said ' || CASE WHEN event_id % 6 = 0 THEN event_id % 100 ELSE event_id END END AS said,
    CASE WHEN event_id % 23 = 0 THEN NULL ELSE floor(epoch_us(ts) / 1e6) END AS created, CASE WHEN event_id % 400 = 7 THEN NULL ELSE floor(epoch_us(ts) / 1e6) + floor(value * 400) END AS updated,
    CASE event_id % 6 WHEN 0 THEN '' ELSE 'm' || event_id % 40 END AS model, 'f' || event_id % 7 AS family
  FROM events WHERE event_type IN ('purchase', 'signup')
), h AS (SELECT substr(sha256(said), 1, 16) AS hash, min(thread) AS thread, count(*) AS n FROM t WHERE said <> '' GROUP BY 1),
b AS (SELECT s.session, h.thread FROM s JOIN h ON h.n = 1 AND h.hash = regexp_replace(trim(s.session), '^fh:', '')),
c AS (
  SELECT s.session, count(*) AS n, min(t.thread) AS thread
  FROM (SELECT * FROM s ANTI JOIN b USING (session)) s JOIN t ON (coalesce(s.model, '') = '' OR t.model = '' OR s.model = t.model) AND (s.family IN ('', 'codex') OR s.family = t.family)
    AND CASE WHEN starts_with(s.session, 'no-session:') THEN t.created <= s.lo + 300 AND t.updated >= s.hi - 300 AND s.lo <= s.hi
        ELSE s.lo IS NULL OR s.hi IS NULL OR t.updated IS NULL OR (t.updated >= s.lo - 1800 AND t.updated <= s.hi + 1800) END
  GROUP BY 1
)
SELECT s.session, coalesce(b.thread, CASE WHEN c.n = 1 THEN c.thread END) AS thread, CASE WHEN b.thread IS NOT NULL THEN 'hash' WHEN c.n = 1 THEN 'time' END AS how,
  CASE WHEN b.thread IS NOT NULL OR c.n = 1 THEN '' WHEN c.n > 1 THEN 'ambiguous_thread_candidates' ELSE 'no_matching_thread_candidate' END AS reason
FROM s LEFT JOIN b USING (session) LEFT JOIN c USING (session)
""")
def session_threads(spark, sf):
    """The thread of each session: days of a user against purchases and sign-ups."""
    events = table(spark, sf, "events")
    days = events.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.min("event_id").alias("id"))
    sessions = days.selectExpr(
        "CASE WHEN id % 11 = 0 THEN 'fh:' || substr(sha2('said ' || id % 200, 256), 1, 16) || repeat(' ', int(id % 3)) || ':' || id WHEN id % 11 = 1 THEN 'fh:' || substr(sha2('said ' || id, 256), 1, 16) WHEN id % 2 = 0 THEN 'no-session:' || id ELSE 'fh:' || id END AS session",
        "CASE WHEN id % 17 = 0 THEN NULL ELSE unix_micros(timestamp(lo)) / 1e6 END AS first",
        "CASE WHEN id % 19 = 0 THEN NULL ELSE unix_micros(timestamp(hi)) / 1e6 - CASE WHEN id % 3 = 0 THEN 0.9D * (unix_micros(timestamp(hi)) - unix_micros(timestamp(lo))) / 1e6 ELSE 0 END END AS last",
        "CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'm' || id % 40 END AS model",
        "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'codex' ELSE 'f' || id % 7 END AS family",
    )
    threads = events.filter("event_type IN ('purchase', 'signup')").selectExpr(
        "event_id AS thread",
        "CASE WHEN event_id % 13 = 0 THEN '' ELSE 'said ' || CASE WHEN event_id % 6 = 0 THEN event_id % 100 ELSE event_id END END AS first_text",
        "CASE WHEN event_id % 23 = 0 THEN NULL ELSE floor(unix_micros(timestamp(ts)) / 1e6) END AS created",
        "CASE WHEN event_id % 400 = 7 THEN NULL ELSE floor(unix_micros(timestamp(ts)) / 1e6) + floor(value * 400) END AS updated",
        "CASE event_id % 6 WHEN 0 THEN '' ELSE 'm' || event_id % 40 END AS model",
        "'f' || event_id % 7 AS family",
    )
    return M.match_threads(sessions, threads)


@query(f"""
WITH {cte('e', REQUESTS)}, r AS (
  SELECT *, kind = 'error' AS failed,
    list(original) FILTER (WHERE NOT hit AND kind <> 'error' AND original > 0) OVER (PARTITION BY session ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
    lead(ts) OVER w AS retry_ts, lead(original) OVER w AS retry
  FROM (SELECT * REPLACE (CASE WHEN id % 31 = 0 THEN 0 ELSE original END AS original) FROM e) WINDOW w AS (PARTITION BY session ORDER BY ts, id)
), n AS (
  -- The next row with a size.
  SELECT f.session, f.id, f.ts, f.prior, arg_min(q.original, (q.ts, q.id)) AS retry, min(q.ts) AS retry_ts
  FROM r f JOIN r q ON q.session = f.session AND (q.ts, q.id) > (f.ts, f.id) AND q.original > 0 WHERE f.failed GROUP BY ALL
), m AS (
  SELECT session, retry - (list_sort(prior)[(len(prior) + 1) // 2] + list_sort(prior)[len(prior) // 2 + 1]) // 2 AS extra FROM n WHERE len(prior) > 0 AND retry_ts < ts + INTERVAL 7200 SECOND
)
SELECT session, coalesce(count(extra) FILTER (extra > 0), 0) AS events, coalesce(sum(extra) FILTER (extra > 0), 0)::BIGINT AS tokens FROM (SELECT DISTINCT session FROM r) LEFT JOIN m USING (session) GROUP BY session
""")
def negative_events(spark, sf):
    """What retries of failed requests took over the running median, within two hours."""
    rows = view(spark, sf, REQUESTS).select("session", "ts", "id", F.when(F.col("id") % 31 == 0, 0).otherwise(F.col("original")).cast("long").alias("original"), (F.col("kind") == "error").alias("failed"), (~F.col("hit")).alias("usual"))
    return medians.negative_events(rows, seconds=7200)


def audited_lines(spark, sf):
    """Lines of every document as the blocks of a turn of its source, and what a reduction by checksum left of them."""
    docs = table(spark, sf, "documents").select("source", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("place", "text"))
    lines = docs.select(F.col("source").alias("session"), F.col("doc_id").alias("turn"), (F.col("place") * 2).cast("long").alias("block"), "text", F.pmod(F.crc32(F.concat("text", (F.col("doc_id") % 3).cast("string")).cast("binary")), F.lit(40)).alias("k"))
    name = F.concat(F.left(F.md5("text"), F.lit(12)), F.lit("_"), F.col("k").cast("string"))
    marked = F.concat(F.lit("[context-chunk status=unchanged uri=local-archive://"), name, F.lit(" bytes=1]"))
    left = (
        F.when(F.col("k").isin(1, 2), "").when(F.col("k").isin(3, 4), F.concat(F.lit("see local-archive://"), name)).when(F.col("k") == 5, F.concat(F.left("text", F.lit(9)), marked)).when(F.col("k") == 6, F.left("text", F.lit(10))).when(F.col("k") == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    )
    after = lines.filter("k != 0").select("session", "turn", "block", left.alias("text"))
    extra = lines.filter("k = 8").select("session", "turn", F.col("block") + 1, F.lit("summary of the above"))
    blocks = lines.select("session", "turn", F.lit("before").alias("side"), "block", "text").unionByName(after.unionByName(extra.toDF("session", "turn", "block", "text")).withColumn("side", F.lit("after")))
    kept = lines.filter("k BETWEEN 3 AND 5").select(name.alias("id"), "text", "k", F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(3)).alias("way")).distinct()
    # Of three entries one holds the text, one names an entry that holds it, one isn't there; chunks hold the rest of their line.
    body = F.when(F.col("k") == 5, F.substring("text", F.lit(10), F.length("text"))).when(F.col("way") == 0, F.col("text")).otherwise(F.concat(F.lit("moved to local-archive://"), "id", F.lit("x")))
    held = F.array(F.when((F.col("k") == 5) | (F.col("way") < 2), F.struct("id", body.alias("body"))), F.when((F.col("k") < 5) & (F.col("way") == 1), F.struct(F.concat("id", F.lit("x")).alias("id"), F.col("text").alias("body"))))
    entries = kept.select(F.inline(F.array_compact(held)))
    return blocks, entries


@query()
def reduction_audit(spark, sf):
    """Every line that a reduction changed, with its severity."""
    return A.audit(*audited_lines(spark, sf))


@query()
def reduction_losses(spark, sf):
    """Sizes, changes and losses of every source."""
    blocks, entries = audited_lines(spark, sf)
    return A.audit_report(blocks, A.audit(blocks, entries))


_R = f"{cte('e', REQUESTS)}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, id) AS n FROM e)"


@query(f"""
WITH RECURSIVE {_R}, h AS (
  SELECT session, id, n, CASE WHEN n >= 10 THEN avg(hit::INT) OVER (PARTITION BY session ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS rate FROM r
), f AS (
  SELECT session, id, n, rate, rate AS baseline, false AS spike FROM h WHERE n = 1
  UNION ALL SELECT h.session, h.id, h.n, h.rate,
    CASE WHEN f.baseline IS NULL THEN h.rate WHEN h.rate < f.baseline * (1 - 0.25::DOUBLE) THEN f.baseline ELSE (1 - 0.05::DOUBLE) * f.baseline + 0.05::DOUBLE * h.rate END,
    coalesce(h.rate < f.baseline * (1 - 0.25::DOUBLE), false)
  FROM f JOIN h ON h.session = f.session AND h.n = f.n + 1
)
SELECT session, id, rate, baseline, spike FROM f
""")
def hit_baseline(spark, sf):
    """Hit rates of the last ten requests of a session against a baseline that follows them."""
    return folds.fold(view(spark, sf, REQUESTS), ["session"], ["ts", "id"], folds.HitBaseline(size=10)).select("session", "id", "rate", "baseline", "spike")


@query("""
WITH RECURSIVE s AS (SELECT user_id AS session, 'f' || user_id % 4 AS family, count(*) AS length, max(ts) AS seen FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY seen, session) AS n FROM s),
f AS (
  SELECT family, session, n, length::DOUBLE AS estimate, 1::BIGINT AS samples FROM r WHERE n = 1
  UNION ALL SELECT r.family, r.session, r.n, 0.1::DOUBLE * r.length + (1 - 0.1::DOUBLE) * f.estimate, f.samples + 1 FROM f JOIN r ON r.family = f.family AND r.n = f.n + 1
)
SELECT family, session, estimate, samples FROM f
""")
def session_lengths(spark, sf):
    """The expected length of a family's sessions after each of them, in the order in which they were last seen."""
    sessions = table(spark, sf, "events").groupBy(F.col("user_id").alias("session")).agg(F.count(F.lit(1)).alias("length"), F.max("ts").alias("seen"))
    rows = sessions.withColumn("family", F.concat(F.lit("f"), (F.col("session") % 4).cast("string")))
    return folds.fold(rows, ["family"], ["seen", "session"], folds.LengthAverage()).select("family", "session", "estimate", "samples")


@query(f"""
WITH RECURSIVE {cte('e', REQUESTS)}, r AS (SELECT id, trim(model) AS model, output - 20 AS observed, estimated_output AS estimated, row_number() OVER (PARTITION BY trim(model), session ORDER BY ts, id) AS n, session FROM e),
f AS (
  SELECT model, session, n, id, (CASE WHEN observed > 0 AND estimated > 0 THEN floor(least(greatest(3500 * 0.95::DOUBLE + 3500::DOUBLE * estimated / observed * 0.05::DOUBLE, 1500), 6000)) ELSE 3500 END)::BIGINT AS ratio FROM r WHERE n = 1
  UNION ALL SELECT r.model, r.session, r.n, r.id, (CASE WHEN observed > 0 AND estimated > 0 THEN floor(least(greatest(ratio * 0.95::DOUBLE + ratio::DOUBLE * estimated / observed * 0.05::DOUBLE, 1500), 6000)) ELSE ratio END)::BIGINT
  FROM f JOIN r ON r.model = f.model AND r.session = f.session AND r.n = f.n + 1
)
SELECT model, session, id, ratio FROM f
""")
def token_ratios(spark, sf):
    """Calibrated bytes per 1000 tokens of each model in a session, after every request."""
    rows = view(spark, sf, REQUESTS).select(F.trim("model").alias("model"), "session", "ts", "id", (F.col("output") - 20).alias("observed"), F.col("estimated_output").alias("estimated"))
    return folds.fold(rows, ["model", "session"], ["ts", "id"], folds.TokenRatio()).select("model", "session", "id", "ratio")


@query(f"""
WITH RECURSIVE r AS (SELECT event_type AS trigger, event_id AS id, epoch_us(ts) AS micros, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, user_id % 7 AS lane FROM events),
o AS (SELECT trigger, lane, id, micros, row_number() OVER (PARTITION BY trigger, lane ORDER BY n) AS n FROM r),
f AS (
  SELECT trigger, lane, id, n, micros AS last, true AS accepted FROM o WHERE n = 1
  UNION ALL SELECT o.trigger, o.lane, o.id, o.n, CASE WHEN o.micros - f.last >= 7200000000 THEN o.micros ELSE f.last END, o.micros - f.last >= 7200000000
  FROM f JOIN o ON o.trigger = f.trigger AND o.lane = f.lane AND o.n = f.n + 1
)
SELECT trigger, lane, id, accepted FROM f
""")
def checkpoint_captures(spark, sf):
    """Which triggers of a lane of users take a checkpoint: none within two hours of the last one taken."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("trigger"), (F.col("user_id") % 7).alias("lane"), "ts", F.col("event_id").alias("id"), folds.micros(F.col("ts")).alias("micros"))
    return folds.fold(rows, ["trigger", "lane"], ["ts", "id"], folds.Debounce(7200)).select("trigger", "lane", "id", "accepted")


@query(f"""
WITH RECURSIVE {cte('e', REQUESTS)}, r AS (
  SELECT provider, id % 3 AS lane, id, applied, added, output, kind IN ('error', 'secret') AS failed, CASE id % 3 WHEN 0 THEN 'aggressive' WHEN 1 THEN 'standard' ELSE 'mild' END AS wanted,
    row_number() OVER (PARTITION BY provider, id % 3 ORDER BY ts, id) AS n FROM e
), f AS (
  SELECT provider, lane, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS got, NULL::VARCHAR AS soft, NULL::VARCHAR AS now, 0::BIGINT AS cooling, 0::BIGINT AS k, 0::HUGEINT AS over, 0::HUGEINT AS gave, 0::BIGINT AS bad FROM (SELECT DISTINCT provider, lane FROM r)
  UNION ALL
  SELECT provider, lane, n, id, got, CASE WHEN down THEN CASE p2 WHEN 'aggressive' THEN 'standard' WHEN 'standard' THEN 'mild' ELSE 'off' END ELSE s1 END,
    CASE WHEN down THEN CASE p2 WHEN 'aggressive' THEN 'standard' WHEN 'standard' THEN 'mild' ELSE 'off' END ELSE p2 END,
    CASE WHEN down THEN 5 ELSE c1 END, CASE WHEN down THEN 0 ELSE k2 END, CASE WHEN down THEN 0 ELSE o2 END, CASE WHEN down THEN 0 ELSE g2 END, CASE WHEN down THEN 0 ELSE b2 END
  FROM (
    SELECT *, applied AND c1 <= 0 AND k2 >= 8 AND (b2::DOUBLE / k2 > 0.3::DOUBLE OR g2 > 0 AND o2::DOUBLE / g2 * 100 > 12) AS down
    FROM (
      SELECT *, CASE WHEN applied AND c1 <= 0 THEN wanted ELSE p1 END AS p2, k + applied::INT AS k2, over + CASE WHEN applied THEN added ELSE 0 END AS o2, gave + CASE WHEN applied THEN output ELSE 0 END AS g2, bad + (applied AND failed)::INT AS b2
      FROM (
        SELECT r.*, f.k, f.over, f.gave, f.bad, CASE WHEN f.soft IS NOT NULL AND f.cooling > 0 THEN f.cooling - 1 ELSE f.cooling END AS c1,
          CASE WHEN f.soft IS NOT NULL AND f.cooling > 0 THEN f.soft ELSE r.wanted END AS got, CASE WHEN f.cooling > 0 THEN f.soft END AS s1,
          CASE WHEN f.soft IS NOT NULL AND f.cooling <= 0 THEN r.wanted ELSE coalesce(f.now, r.wanted) END AS p1
        FROM f JOIN r ON r.provider = f.provider AND r.lane = f.lane AND r.n = f.n + 1
      )
    )
  )
)
SELECT provider, lane, id, got AS profile, cooling FROM f WHERE n > 0
""")
def profile_downgrades(spark, sf):
    """The output profile of every request: softer for a while after failures or too much overhead."""
    wanted = F.when(F.col("id") % 3 == 0, "aggressive").when(F.col("id") % 3 == 1, "standard").otherwise("mild")
    rows = view(spark, sf, REQUESTS).select("provider", (F.col("id") % 3).alias("lane"), "ts", "id", wanted.alias("wanted"), "applied", "added", "output", F.col("kind").isin("error", "secret").alias("failed"))
    rule = folds.Downgrade(samples=8, cooldown=5, failures=0.3, overhead=12.0)
    return folds.fold(rows, ["provider", "lane"], ["ts", "id"], rule).select("provider", "lane", "id", "profile", "cooling")


@query()
def byte_echoes(spark, sf):
    """Stretches of 200 bytes and more that documents share with passages of the benchmark, none overlapping another."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    blocks = table(spark, sf, "benchmark").select(F.col("item_id").alias("block_id"), "text")
    return B.echoes(texts, blocks)


@query()
def chunk_references(spark, sf):
    """Documents with the chunks that their source has seen replaced by references, and whether they read back."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    out = R.encoded(docs)
    back = R.decoded(out, R.archived(docs)).select("source", "doc_id", F.sha2("text", 256).alias("back"))
    plain = docs.select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("plain"))
    told = out.select("source", "doc_id", "saved", "refs", "ref_bytes", F.sha2("data", 256).alias("data_sha256"))
    return told.join(back.join(plain, ["source", "doc_id"]).select("source", "doc_id", (F.col("back") == F.col("plain")).alias("reads_back")), ["source", "doc_id"])


@query(r"""
WITH t AS (
  SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '[P1] ' ELSE '' END || 'see http://x/usr/share/doc/tables/of/contents ' || repeat('in /home/user/project_' || page_id % 7 || '/src/main.py and ', (page_id % 5)::INT)
    || repeat('at /opt/tools/release/bin/' || page_id % 3 || '/run ', (page_id % 4 + 1)::INT) || replace(coalesce(html, ''), '/', '') AS text FROM pages
), p AS (
  SELECT page_id, text, list_filter(regexp_extract_all(text, '(:?(?:/[A-Za-z0-9._%+@=\-]+){3,})', 1), lambda x: regexp_matches(x, '^/(Users|private|var|tmp|opt|usr|home|root|Volumes|Applications)/') AND length(x) >= 24) AS found FROM t
), d AS (
  -- Two paths at most in these texts, in order of their first place.
  SELECT page_id, text, CASE WHEN contains(text, '[P1]') THEN [] ELSE list_filter(list_transform(list_filter(list_zip(found, range(1, len(found) + 1)), lambda z: list_position(found, z[1]) = z[2]), lambda z: z[1]), lambda x: len(list_filter(found, lambda y: y = x)) >= 3) END AS paths FROM p
), c AS (
  SELECT page_id, text, len(paths) AS n, '[path dictionary]' || chr(10) || coalesce('[P1]=' || paths[1] || chr(10), '') || coalesce('[P2]=' || paths[2] || chr(10), '') || '[/path dictionary]' || chr(10)
    || replace(replace(text, coalesce(paths[1], chr(0)), '[P1]'), coalesce(paths[2], chr(0)), '[P2]') AS coded FROM d
)
SELECT page_id, CASE WHEN n > 0 AND strlen(text) - strlen(coded) >= 16 THEN strlen(text) - strlen(coded) ELSE 0 END AS saved,
  sha256(CASE WHEN n > 0 AND strlen(text) - strlen(coded) >= 16 THEN coded ELSE text END) AS coded_sha256, true AS reads_back FROM c
""")
def path_dictionary(spark, sf):
    """Pages behind listings with long paths, coded by a path dictionary and read back."""
    listing = F.concat(
        F.when(F.col("page_id") % 10 == 0, "[P1] ").otherwise(""), F.lit("see http://x/usr/share/doc/tables/of/contents "),
        F.expr("repeat('in /home/user/project_' || page_id % 7 || '/src/main.py and ', int(page_id % 5))"), F.expr("repeat('at /opt/tools/release/bin/' || page_id % 3 || '/run ', int(page_id % 4 + 1))"),
        F.translate(F.coalesce("html", F.lit("")), "/", ""),
    )
    out = P.coded(table(spark, sf, "pages").select("page_id", listing.alias("text")))
    return out.select("page_id", "saved", F.sha2("coded", 256).alias("coded_sha256"), (P.expanded(F.col("coded")) == F.col("text")).alias("reads_back"))
