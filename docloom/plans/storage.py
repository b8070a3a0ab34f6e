"""Stores, caches, manifests, installs: lookups, upserts and set logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import ordered, sets, store
from docloom.plans import fixtures
from docloom.plans.registry import query, table
from docloom.session import scratch_path
from docloom.sources import files


@query("a1_scan_pages", "WITH " + fixtures.PAGE_META + """
SELECT page_id, path FROM page_meta WHERE NOT starts_with(path, 'fr/') AND NOT starts_with(path, 'en/1')""")
def scan_pages(spark, sf_dir):
    pages = fixtures.page_meta(spark, sf_dir).select("page_id", "path")
    return sets.without_excluded(pages, "path", ["fr/", "en/1"])


@query("a2_check_required", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def check_required(spark, sf_dir):
    return sets.missing_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def store_rows(spark, sf_dir):
    """Full store rows for labelled entries, one per distinct text."""
    labelled = fixtures.entries(spark, sf_dir).join(fixtures.entry_store(spark, sf_dir), "page_ord")
    first = labelled.groupBy("key").agg(
        F.min_by(F.struct("category", "breaking", "version_text", "text", "page_ord"), "page_ord").alias("r")
    )
    return first.select(
        "key", "r.category", "r.breaking",
        F.when(F.col("r.breaking"), "names a removed part").otherwise("").alias("breaking_reason"),
        F.lit(fixtures.MODEL).alias("model"), F.lit(fixtures.EFFORT).alias("effort"),
        F.lit(fixtures.PROMPT_VERSION).alias("prompt_version"),
        F.col("r.version_text").alias("release"), "r.text", F.timestamp_seconds("r.page_ord").alias("classified_at"),
    )


_BROKEN_SQL = "WITH " + fixtures.ENTRIES + ", " + fixtures.STORE_BY_ENTRY + """
, first AS (SELECT key, min(page_ord) AS page_ord FROM entries JOIN entry_store USING (page_ord) GROUP BY key)"""


def _written_lines(spark, sf_dir):
    """Store rows written as JSON lines, every seventh damaged in one of several ways."""
    stamp = F.get_json_object("value", "$.classified_at").cast("double").cast("bigint")
    kind = F.col("_n") % 35
    damaged = files.store_lines(store_rows(spark, sf_dir)).withColumn("_n", stamp).select(
        F.when(kind == 0, F.lit('{"key": "torn'))
        .when(kind == 7, F.lit('{"key": "k"}'))
        .when(kind == 14, F.regexp_replace("value", '"breaking":(true|false)', '"breaking":"yes"'))
        .when(kind == 21, F.regexp_replace("value", '"category":"[a-z]+"', '"category":"odd"'))
        .when(kind == 28, F.regexp_replace("value", '"key":"....', '"key":"0000'))
        .otherwise(F.col("value")).alias("value")
    )
    path = scratch_path(spark, "lines")
    damaged.write.text(path)
    return path


@query("a3_read_strict_jsonl", _BROKEN_SQL + """
SELECT CASE WHEN page_ord % 7 <> 0 THEN 'good'
            WHEN page_ord % 35 = 0 THEN 'not valid JSON'
            WHEN page_ord % 35 = 7 THEN 'missing or unexpected fields breaking, breaking_reason, category, classified_at, effort, model, prompt_version, release, text'
            WHEN page_ord % 35 = 14 THEN 'breaking is not true or false'
            WHEN page_ord % 35 = 21 THEN 'unknown category'
            ELSE 'key does not match its text and settings' END AS outcome, count(*) AS n
FROM first GROUP BY 1""")
def read_strict_jsonl(spark, sf_dir):
    good, bad = files.read_strict_jsonl(spark, _written_lines(spark, sf_dir))
    outcomes = good.select(F.lit("good").alias("outcome")).unionByName(bad.select(F.col("reason").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("a4_write_jsonl", _BROKEN_SQL + """
SELECT f.key, s.category, s.breaking, CASE WHEN s.breaking THEN 'names a removed part' ELSE '' END AS breaking_reason,
       e.version_text AS release, e.text, f.page_ord AS at
FROM first f JOIN entries e USING (page_ord) JOIN entry_store s USING (page_ord)""")
def write_jsonl(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    files.write_jsonl(store_rows(spark, sf_dir), path)
    good, _ = files.read_strict_jsonl(spark, path)
    return good.select(
        "key", "category", "breaking", "breaking_reason", "release", "text", F.unix_seconds("classified_at").alias("at")
    )


def _documents_out(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("name"),
        F.concat(F.lit("man"), F.col("lang")).alias("section"),
        F.col("text").alias("body"),
    )


@query("a5_write_partitioned", """
SELECT 'doc.' || doc_id AS name, 'man' || lang AS section, text AS body FROM documents""")
def write_partitioned(spark, sf_dir):
    path = scratch_path(spark, "documents")
    files.write_documents(_documents_out(spark, sf_dir), path, gzip=True)
    return spark.read.schema("name string, body string, section string").json(path).select("name", "section", "body")


@query("a5_duplicate_names", """
SELECT lang AS section, 'doc.' || (doc_id // 2) AS name, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1""")
def duplicate_names(spark, sf_dir):
    name = F.concat(F.lit("doc."), F.floor(F.col("doc_id") / 2).cast("string"))
    return files.duplicate_documents(table(spark, sf_dir, "documents").select(F.col("lang").alias("section"), name.alias("name")))


_UPSERTED = """
WITH old AS (SELECT doc_id, quality, toxic FROM labels),
new AS (SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS quality, 1 AS toxic FROM documents WHERE doc_id % 3 = 0)"""


def _old_and_new(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    third = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0")
    # Two writes of each key: the later one counts.
    both = third.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("write_no"))
    new = both.select(
        "doc_id", F.when(F.col("write_no") == 2, (F.col("doc_id") % 2).cast("int")).otherwise(9).alias("quality"),
        F.lit(1).alias("toxic"), "write_no",
    )
    return old, new


@query("a6_upsert_store", _UPSERTED + """
SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)""")
def upsert_store(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    return store.upsert(old, new, "doc_id", order="write_no")


@query("a7_read_store", """
SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT item_id * 5 FROM benchmark)""")
def read_store(spark, sf_dir):
    keys = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 5).alias("doc_id"))
    return store.rows_for_keys(table(spark, sf_dir, "labels"), keys, "doc_id")


@query("a8_stored_keys", "WITH " + fixtures.STORE + " SELECT key FROM store")
def stored_keys(spark, sf_dir):
    """Keys of a store written as a snapshot and a change that replaces some of its rows."""
    root = scratch_path(spark, "store")
    rows = store_rows(spark, sf_dir)
    store.commit_snapshot(rows.filter("substr(key, 1, 1) < '8'"), root)
    store.commit_changes(rows.filter("substr(key, 1, 1) > '4'"), root)
    return store.stored_keys(spark, root)


@query("a9_freshest_snapshot", """
WITH e AS (SELECT *, epoch_us(ts) AS us, (SELECT max(epoch_us(ts)) FROM events) AS now FROM events),
old AS (SELECT user_id AS url, max(us) AS old_us, arg_max(event_id, us) AS old_id FROM e
        WHERE event_type <> 'error' AND us <= now - 21600000000 AND user_id % 10 <> 3 GROUP BY 1),
new AS (SELECT user_id AS url, max(us) AS new_us, arg_max(event_id, us) AS new_id FROM e
        WHERE event_type <> 'error' AND us > now - 21600000000 GROUP BY 1)
SELECT url, CASE how WHEN 'refetched' THEN new_us ELSE old_us END AS fetched_us,
       CASE how WHEN 'refetched' THEN new_id ELSE old_id END AS body, how
FROM (SELECT *, CASE WHEN old_us IS NOT NULL AND (SELECT any_value(now) FROM e) - old_us <= 43200000000 THEN 'cached'
                     WHEN new_us IS NOT NULL THEN 'refetched' ELSE 'stale' END AS how
      FROM old FULL JOIN new USING (url))""")
def freshest_snapshot(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).scalar()
    timed = events.select(
        F.col("user_id").alias("url"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("body"),
        (F.col("event_type") != "error").alias("ok"),
        (F.col("ts") > now - F.expr("INTERVAL 6 HOURS")).alias("recent"),
    )
    recent = F.col("recent")
    cached = timed.filter(~recent & F.col("ok") & (F.col("url") % 10 != 3)).select("url", "fetched_at", "body")
    refetched = timed.filter(recent)
    chosen = store.freshest_snapshot(cached, refetched, now, 12 * 3600.0)
    return chosen.select("url", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("fetched_us"), "body", "how")


@query("a10_source_fallback", "WITH " + fixtures.ENTRIES + ", " + fixtures.STORE_BY_ENTRY + """
, rules AS (SELECT page_ord, CASE WHEN page_ord % 2 = 0 THEN 'changed' ELSE 'other' END AS category FROM entries WHERE page_ord % 5 > 0)
SELECT page_ord, coalesce(s.category, r.category) AS category, CASE WHEN s.page_ord IS NOT NULL THEN 'primary' ELSE 'secondary' END AS how
FROM entry_store s FULL JOIN rules r USING (page_ord)""")
def source_fallback(spark, sf_dir):
    ids = fixtures.entries(spark, sf_dir).select("page_ord").filter("page_ord % 5 > 0")
    secondary = ids.withColumn("category", F.when(F.col("page_ord") % 2 == 0, "changed").otherwise("other"))
    return store.source_fallback(fixtures.entry_store(spark, sf_dir), secondary, "page_ord", ["category"])


@query("a11_snapshot_cache", """
SELECT doc_id, doc_id % 2 = 0 AND doc_id % 10 <> 0 AS hit FROM documents""")
def snapshot_cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = docs.select("doc_id", store.fingerprint("p1", F.col("doc_id"), F.col("text")).alias("fingerprint"))
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))
    cached = docs.filter("doc_id % 2 = 0").select("doc_id", store.fingerprint("p1", F.col("doc_id"), changed).alias("fingerprint"))
    return store.cache_split(now, cached, "doc_id").select("doc_id", "hit")


@query("a11_through_cache", """
SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 0 THEN -1 ELSE length(text) END AS INTEGER) AS n FROM documents""")
def through_cache(spark, sf_dir):
    """Cached rows carry -1 here, so the result tells which rows were computed again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = docs.withColumn("fingerprint", store.fingerprint("p1", F.col("doc_id"), F.col("text")))
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))
    cached = docs.filter("doc_id % 2 = 0").select(
        "doc_id", store.fingerprint("p1", F.col("doc_id"), changed).alias("fingerprint"), F.lit(-1).alias("n")
    )
    full = store.through_cache(
        now, cached, "doc_id", lambda rest: rest.select("doc_id", "fingerprint", F.length("text").alias("n"))
    )
    return full.select("doc_id", "n")


@query("a13_read_manifest_strict", """
WITH m AS (SELECT CASE WHEN doc_id % 17 = 0 THEN 'man/' ELSE '/man/' END || lang AS dir,
  CASE WHEN doc_id % 17 = 0 THEN 'folder is not absolute' WHEN doc_id % 11 = 0 THEN 'invalid version' WHEN doc_id % 13 = 0 THEN 'unexpected path' END AS reason, doc_id FROM documents)
SELECT dir, CASE WHEN reason IS NULL THEN 'man3/doc.' || doc_id || '.3.gz' END AS path, reason FROM m""")
def read_manifest_strict(spark, sf_dir):
    """One manifest per document, some damaged; exploded records and rejected ones."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    record = F.to_json(F.struct(
        F.when(n % 11 == 0, F.lit("latest")).otherwise(F.concat(F.lit("1."), F.substring("source", 4, 10), F.lit(".0"))).alias("version"),
        n.cast("double").alias("installed_at"),
        F.array(F.concat(F.lit("man3/doc."), n.cast("string"), F.when(n % 13 == 0, ".txt").otherwise(".3.gz"))).alias("paths"),
    ))
    folder = F.concat(F.when(n % 17 == 0, "man/").otherwise("/man/"), F.col("lang"))
    raw = docs.select(F.concat(F.lit('{"'), folder, F.lit('":'), record, F.lit("}")).alias("value"), n.cast("string").alias("file"))
    good, bad = files.manifest_records(raw, r"^man[37]/[^/]+\.[37](?:\.gz)?$")
    return good.select("dir", "path", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("dir", F.lit(None).cast("string").alias("path"), "reason")
    )


# -- installs ----------------------------------------------------------------------------

_PATHS = """paths AS (
  SELECT lang || '/' || source || '/' || doc_id AS path, lang AS section, CAST(substr(source, 4) AS BIGINT) AS minor, doc_id FROM documents),
prev AS (SELECT path FROM paths WHERE minor <= 9), new AS (SELECT path FROM paths WHERE minor >= 5)"""


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "lang", "source", "doc_id").alias("path"), F.col("lang").alias("section"),
        F.substring("source", 4, 10).cast("bigint").alias("minor"), "doc_id",
    )


def _prev_new(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    return paths.filter("minor <= 9").select("path"), paths.filter("minor >= 5").select("path")


@query("g1_stale_paths", "WITH " + _PATHS + " SELECT path FROM prev EXCEPT SELECT path FROM new")
def stale_paths(spark, sf_dir):
    return sets.stale_paths(*_prev_new(spark, sf_dir))


@query("g2_intent_paths", "WITH " + _PATHS + " SELECT path FROM prev UNION SELECT path FROM new")
def intent_paths(spark, sf_dir):
    return sets.intent_paths(*_prev_new(spark, sf_dir))


@query("c10_install_conflicts", "WITH " + _PATHS + """
SELECT path FROM new WHERE path IN (SELECT path FROM paths WHERE doc_id % 2 = 0) AND path NOT IN (SELECT path FROM prev)""")
def install_conflicts(spark, sf_dir):
    prev, new = _prev_new(spark, sf_dir)
    existing = _paths(spark, sf_dir).filter("doc_id % 2 = 0").select("path")
    return sets.install_conflicts(new, existing, prev)


@query("g7_removable", "WITH " + _PATHS + """
SELECT path FROM prev WHERE path IN (SELECT path FROM paths WHERE doc_id % 3 = 0)""")
def removable(spark, sf_dir):
    prev, _ = _prev_new(spark, sf_dir)
    return sets.removable(prev, _paths(spark, sf_dir).filter("doc_id % 3 = 0"))


@query("d5_count_by_section", "WITH " + _PATHS + """
SELECT 'r' || (minor % 4) AS dir, section, count(*) AS n, bool_or(doc_id % 50 = 0) AS incomplete FROM paths GROUP BY ALL
UNION ALL SELECT 'r' || (minor % 4), NULL, count(*), bool_or(doc_id % 50 = 0) FROM paths GROUP BY 1""")
def count_by_section(spark, sf_dir):
    manifest = _paths(spark, sf_dir).select(
        F.concat(F.lit("r"), (F.col("minor") % 4).cast("string")).alias("dir"), "section", (F.col("doc_id") % 50 == 0).alias("incomplete")
    )
    return sets.count_by_section(manifest)


@query("f4_sample_with_more", "WITH " + _PATHS + """
, ranked AS (SELECT DISTINCT section, path FROM paths), numbered AS (
  SELECT section, path, row_number() OVER (PARTITION BY section ORDER BY path) AS i, count(*) OVER (PARTITION BY section) AS n FROM ranked)
SELECT section, n AS n_values,
       string_agg(path, ', ' ORDER BY path) || CASE WHEN n > 5 THEN ' (and ' || (n - 5) || ' more)' ELSE '' END AS sample
FROM numbered WHERE i <= 5 GROUP BY section, n""")
def sample_with_more(spark, sf_dir):
    return sets.sample_with_more(_paths(spark, sf_dir), "section", "path")


@query("g3_field_mismatch", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k,x' ELSE '' END AS wrong FROM events""")
def field_mismatch(spark, sf_dir):
    expected = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("k")))
    wrong = sets.field_mismatch(F.json_object_keys("props"), expected)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(wrong, ",").alias("wrong"))


@query("f5_mode_order", "WITH " + fixtures.SAMPLES + """
SELECT event_id, CAST(CASE mode WHEN 'threads' THEN 0 WHEN 'asyncio' THEN 1 WHEN 'asyncio-uvloop' THEN 2
                           WHEN 'raw-asyncio' THEN 3 ELSE 4 END AS BIGINT) AS mode_rank FROM samples""")
def mode_order(spark, sf_dir):
    from docloom.operators.metrics import MODE_ORDER

    return fixtures.samples(spark, sf_dir).select("event_id", sets.position_in(F.col("mode"), MODE_ORDER).alias("mode_rank"))


@query("d29_run_progress", """
WITH o AS (SELECT user_id AS run_id, CASE event_type WHEN 'view' THEN 'stored' WHEN 'click' THEN 'saved'
             WHEN 'purchase' THEN 'printed' ELSE 'missing' END AS status FROM events)
SELECT run_id, count(*) FILTER (status = 'stored') AS stored, count(*) FILTER (status = 'saved') AS saved,
       count(*) FILTER (status = 'printed') AS printed, count(*) FILTER (status = 'missing') AS missing
FROM o GROUP BY run_id""")
def run_progress(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "view", "stored").when(kind == "click", "saved").when(kind == "purchase", "printed").otherwise("missing")
    return store.run_progress(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), status.alias("status")))


@query("f3_order_pages", "WITH " + fixtures.PAGE_META + """
SELECT page_id, row_number() OVER (ORDER BY host, path, page_id) AS position FROM page_meta""")
def order_pages(spark, sf_dir):
    pages = fixtures.page_meta(spark, sf_dir).select("page_id", "host", "path")
    placed = ordered.sorted_ordinal(pages, [F.col("host"), F.col("path"), F.col("page_id")], "position")
    return placed.select("page_id", "position")
