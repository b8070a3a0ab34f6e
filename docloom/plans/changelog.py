"""Release diffs: ranges, stored classifications, groups, entry trees, rendered lines."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from docloom.functions.versions import format_version, parse_version
from docloom.operators import changelog, ordered, scoring, store
from docloom.plans import fixtures
from docloom.plans.registry import query, table

LOW, HIGH = "1.2.0", "1.11.0"


def _classified(spark, sf_dir):
    """Entries of the range with the stored result of their text."""
    ranged = changelog.version_range(fixtures.entries(spark, sf_dir), LOW, HIGH)
    return changelog.attach_classification(ranged, fixtures.keyed_store(spark, sf_dir))


@query("b1_version_range", "WITH " + fixtures.ENTRIES + """
SELECT page_ord, version_text, vnum FROM entries WHERE vnum > 1002000 AND vnum <= 1011000""")
def version_range(spark, sf_dir):
    ranged = changelog.version_range(fixtures.entries(spark, sf_dir), HIGH, LOW)
    return ranged.select("page_ord", "version_text", "vnum")


@query("b1_unknown_version", "WITH " + fixtures.ENTRIES + """
, wanted AS (SELECT DISTINCT 1000000 + 500 * (o_custkey % 60) AS vnum FROM orders)
SELECT w.vnum, (SELECT max(vnum) FROM entries e WHERE e.vnum < w.vnum) AS nearest_lower,
       (SELECT min(vnum) FROM entries e WHERE e.vnum > w.vnum) AS nearest_higher
FROM wanted w WHERE w.vnum NOT IN (SELECT vnum FROM entries)""")
def unknown_version(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select((F.lit(1_000_000) + 500 * (F.col("o_custkey") % 60)).alias("vnum"))
    return changelog.unknown_versions(wanted.distinct(), fixtures.entries(spark, sf_dir), "vnum")


@query("c1_attach_classification", "WITH " + fixtures.STORE + """
SELECT page_ord, key, category, breaking FROM entries LEFT JOIN store USING (key)""")
def attach_classification(spark, sf_dir):
    items = fixtures.entries(spark, sf_dir).select("page_ord", "key")
    return changelog.attach_classification(items, fixtures.keyed_store(spark, sf_dir))


@query("c2_pending_items", "WITH " + fixtures.STORE + """
SELECT page_ord, key FROM entries WHERE key NOT IN (SELECT key FROM store)""")
def pending_items(spark, sf_dir):
    items = fixtures.entries(spark, sf_dir).select("page_ord", "key")
    return changelog.pending_items(items, fixtures.keyed_store(spark, sf_dir))


@query("c6_nearest_known", "WITH " + fixtures.ENTRIES + """
, known AS (SELECT DISTINCT vnum FROM entries WHERE vnum % 3000 = 1000),
probes AS (SELECT DISTINCT 1000000 + 500 * (o_custkey % 60) AS vnum FROM orders)
SELECT p.vnum, (SELECT max(k.vnum) FROM known k WHERE k.vnum < p.vnum) AS nearest_lower,
       (SELECT min(k.vnum) FROM known k WHERE k.vnum > p.vnum) AS nearest_higher
FROM probes p""")
def nearest_known(spark, sf_dir):
    known = fixtures.entries(spark, sf_dir).filter("vnum % 3000 = 1000")
    probes = table(spark, sf_dir, "orders").select((F.lit(1_000_000) + 500 * (F.col("o_custkey") % 60)).alias("vnum"))
    return changelog.nearest_known(probes, known)


@query("d1_group_entries", "WITH " + fixtures.DIFF + """
, dims(grp, grp_rank, heading) AS (VALUES ('breaking', 1, 'Breaking'), ('deprecated', 2, 'Deprecated'), ('added', 3, 'Added'),
  ('changed', 4, 'Changed'), ('fixed', 5, 'Fixed'), ('other', 6, 'Other')),
ranked AS (SELECT grp, page_ord, version_text, row_number() OVER (PARTITION BY grp ORDER BY vnum, page_ord) AS seq FROM diff)
SELECT grp, coalesce(d.grp_rank, 7) AS grp_rank, coalesce(d.heading, 'Pending') AS heading, coalesce(r.seq, 0) AS seq, r.page_ord, r.version_text
FROM dims d FULL JOIN ranked r USING (grp)""")
def group_entries(spark, sf_dir):
    diff = _classified(spark, sf_dir).select("page_ord", "version_text", "entry_no", "category", "breaking")
    grouped = changelog.group_entries(diff)
    return grouped.select("grp", "grp_rank", "heading", "seq", "page_ord", "version_text")


@query("d2_group_counts", "WITH " + fixtures.DIFF + """
, dims(grp, grp_rank) AS (VALUES ('breaking', 1), ('deprecated', 2), ('added', 3), ('changed', 4), ('fixed', 5), ('other', 6), ('pending', 7)),
per AS (SELECT grp, count(*) AS n_entries, count(DISTINCT vnum) AS n_releases FROM diff GROUP BY grp)
SELECT grp, grp_rank, coalesce(n_entries, 0) AS n_entries, coalesce(n_releases, 0) AS n_releases
FROM dims LEFT JOIN per USING (grp)
UNION ALL SELECT 'total', 0, count(*), count(DISTINCT vnum) FROM diff""")
def group_counts(spark, sf_dir):
    return changelog.group_counts(_classified(spark, sf_dir))


@query("d2_header_line", "WITH " + fixtures.DIFF + """
, per AS (SELECT CASE grp WHEN 'breaking' THEN 1 WHEN 'added' THEN 3 WHEN 'fixed' THEN 5 ELSE 7 END AS r, upper(substr(grp, 1, 1)) || substr(grp, 2) || ' ' || count(*) AS t
         FROM diff GROUP BY grp)
SELECT '1.2.0' AS from_version, '1.11.0' AS to_version, (SELECT count(DISTINCT vnum) FROM diff) AS n_releases, (SELECT count(*) FROM diff) AS n_entries,
       (SELECT string_agg(t, ', ' ORDER BY r) FROM per) AS counts""")
def header_line(spark, sf_dir):
    return changelog.diff_header(_classified(spark, sf_dir), HIGH, LOW)


@query("d3_release_coverage", "WITH " + fixtures.STORE + """
SELECT vnum, count(*) AS n_entries, count(s.key) AS n_classified
FROM entries e LEFT JOIN store s USING (key) GROUP BY vnum""")
def release_coverage(spark, sf_dir):
    return changelog.release_coverage(fixtures.entries(spark, sf_dir), fixtures.keyed_store(spark, sf_dir), "vnum")


@query("d4_dedupe_first", "WITH " + fixtures.ENTRIES + """
SELECT key, min(page_ord) AS page_ord, arg_min(version_text, page_ord) AS version_text, arg_min(text, page_ord) AS text
FROM entries GROUP BY key""")
def dedupe_first(spark, sf_dir):
    items = fixtures.entries(spark, sf_dir).select("key", "page_ord", "version_text", "text")
    return changelog.dedupe_first(items, "key", "page_ord", "version_text", "text")


@query("d7_duplicate_keys", "WITH " + fixtures.ENTRIES + """
SELECT vnum, lang, count(*) AS n FROM entries GROUP BY vnum, lang HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    counted = fixtures.entries(spark, sf_dir).groupBy("vnum", "lang").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("n > 1")


@query("d30_release_index", "WITH " + fixtures.ENTRIES + """
SELECT row_number() OVER (ORDER BY vnum DESC) AS position, version_text AS version,
       format('{:,}', n) || CASE WHEN n = 1 THEN ' entry' ELSE ' entries' END AS label
FROM (SELECT vnum, version_text, count(*) AS n FROM entries GROUP BY vnum, version_text)""")
def release_index(spark, sf_dir):
    return changelog.release_index(fixtures.entries(spark, sf_dir))


@query("e4_neighbours", "WITH " + fixtures.ENTRIES + """
SELECT vnum, lag(vnum) OVER (ORDER BY vnum) AS previous, lead(vnum) OVER (ORDER BY vnum) AS next
FROM (SELECT DISTINCT vnum FROM entries)""")
def neighbours(spark, sf_dir):
    return changelog.release_neighbours(fixtures.entries(spark, sf_dir).select("vnum").distinct())


@query("e5_entry_ordinals", "WITH " + fixtures.ENTRIES + """
SELECT page_ord, version_text, row_number() OVER (PARTITION BY vnum ORDER BY page_ord) AS seq,
       row_number() OVER (ORDER BY vnum, page_ord) AS overall
FROM entries""")
def entry_ordinals(spark, sf_dir):
    items = fixtures.entries(spark, sf_dir).select("vnum", "page_ord", "version_text", "entry_no")
    within = ordered.with_ordinal(items, ["vnum"], "page_ord")
    return ordered.with_ordinal(within, [], "entry_no", "overall").select("page_ord", "version_text", "seq", "overall")


_FOUND = r"""found AS (SELECT DISTINCT m FROM (
  SELECT unnest(regexp_extract_all(text, '\d+\.\d+\.\d+')) AS m FROM documents))"""
_FOUND_PARTS = "WITH " + _FOUND + r""", parts AS (
  SELECT m, TRY_CAST(split_part(m, '.', 1) AS INTEGER) AS major, TRY_CAST(split_part(m, '.', 2) AS INTEGER) AS minor,
         TRY_CAST(split_part(m, '.', 3) AS INTEGER) AS patch FROM found)"""


def _versions_in_text(spark, sf_dir):
    matches = F.regexp_extract_all("text", F.lit(r"\d+\.\d+\.\d+"), F.lit(0))
    found = table(spark, sf_dir, "documents").select(F.explode(matches).alias("m"))
    return found.select(parse_version(F.col("m")).alias("version")).filter(F.col("version").isNotNull())


@query("f1_latest_version", _FOUND_PARTS + """
SELECT major || '.' || minor || '.' || patch AS latest FROM parts
WHERE major IS NOT NULL AND minor IS NOT NULL AND patch IS NOT NULL
ORDER BY major DESC, minor DESC, patch DESC LIMIT 1""")
def latest_version(spark, sf_dir):
    return _versions_in_text(spark, sf_dir).agg(format_version(F.max("version")).alias("latest"))


@query("f2_order_releases", "WITH " + fixtures.ENTRIES + """
SELECT version_text, row_number() OVER (ORDER BY vnum) AS oldest_first, row_number() OVER (ORDER BY vnum DESC) AS newest_first
FROM (SELECT DISTINCT vnum, version_text FROM entries)""")
def order_releases(spark, sf_dir):
    releases = fixtures.entries(spark, sf_dir).select("version", "version_text").distinct()
    placed = ordered.sorted_ordinal(releases, [F.col("version")], "oldest_first")
    total = releases.agg(F.count(F.lit(1))).scalar()
    return placed.select(
        "version_text", "oldest_first", (total - F.col("oldest_first") + 1).alias("newest_first")
    )


@query("g5_distinct_versions", _FOUND_PARTS + """
SELECT DISTINCT major || '.' || minor || '.' || patch AS version FROM parts
WHERE major IS NOT NULL AND minor IS NOT NULL AND patch IS NOT NULL""")
def distinct_versions(spark, sf_dir):
    return _versions_in_text(spark, sf_dir).distinct().select(format_version(F.col("version")).alias("version"))


# -- entry trees: a document is an entry, its lines are the nodes -------------------------
# A line's depth follows its number: 0, then 1 and 2 in turn, so the tree has three levels.

_NODES = """nodes AS (
  SELECT doc_id AS page_ord, text, i, CASE WHEN i = 0 THEN 0 WHEN i % 3 = 1 THEN 1 ELSE 2 END AS depth
  FROM (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


def _nodes(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_ord"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text")
    )
    i, parent = F.col("i"), F.floor((F.col("i") - 1) / 3).cast("int")
    path = (
        F.when(i == 0, F.array(F.lit(0)))
        .when(i % 3 == 1, F.array(F.lit(0), parent))
        .otherwise(F.array(F.lit(0), parent, (i + 1) % 3))
    )
    return lines.withColumn("path", path).withColumn("depth", F.size("path") - 1)


@query("h4_1_flatten_entry", "WITH " + _NODES + """
SELECT page_ord, string_agg(CASE WHEN depth > 0 THEN repeat('  ', depth) || '- ' || text ELSE text END, chr(10) ORDER BY i) AS full_text
FROM nodes GROUP BY page_ord""")
def flatten_entry(spark, sf_dir):
    return changelog.flatten_entry(_nodes(spark, sf_dir))


@query("h4_2_nest_children", "WITH " + _NODES + """
, kids AS (SELECT page_ord, CASE WHEN depth = 1 THEN 0 ELSE 3 * ((i - 1) // 3) + 1 END AS parent, i, text FROM nodes WHERE depth > 0)
SELECT n.page_ord, CAST(n.i AS INTEGER) AS i, count(k.text) AS n_children,
       coalesce(string_agg(k.text, '|' ORDER BY k.i), '') AS children
FROM nodes n LEFT JOIN kids k ON n.page_ord = k.page_ord AND n.i = k.parent GROUP BY n.page_ord, n.i""")
def nest_children(spark, sf_dir):
    nested = changelog.nest_children(_nodes(spark, sf_dir))
    return nested.select(
        "page_ord", "i", F.size("children").cast("bigint").alias("n_children"), F.array_join("children", "|").alias("children")
    )


# -- rendered lines ----------------------------------------------------------------------


def _rendered_input(spark, sf_dir):
    """Classified entries with first line as text, next lines as children, and a reason."""
    lines = F.split("text", "\n", -1)
    reason = F.when(F.col("breaking") & (F.col("page_ord") % 2 == 0), F.concat(F.lit("release "), F.col("version_text")))
    return _classified(spark, sf_dir).select(
        "version_text", "entry_no", "category", "breaking", reason.alias("breaking_reason"), lines[0].alias("text"),
        F.slice(lines, F.lit(2), F.size(lines)).alias("children"),
    )


_LINES = "WITH " + fixtures.DIFF + """
, shown AS (SELECT d.*, string_split(text, chr(10)) AS ls,
    row_number() OVER (PARTITION BY grp ORDER BY vnum, page_ord) AS seq,
    CASE grp WHEN 'breaking' THEN 1 WHEN 'added' THEN 3 WHEN 'fixed' THEN 5 ELSE 7 END AS grp_rank,
    CASE grp WHEN 'breaking' THEN 'Breaking' WHEN 'added' THEN 'Added' WHEN 'fixed' THEN 'Fixed' ELSE 'Pending' END AS heading,
    CASE WHEN breaking AND page_ord % 2 = 0 THEN ['  - why: release ' || version_text] ELSE [] END AS why
  FROM diff d),
bullets AS (SELECT grp_rank, seq, [HEAD] || why || list_transform(ls[2:], lambda x: '  - ' || x) AS parts FROM shown)
SELECT CAST(grp_rank AS INTEGER) AS grp_rank, seq, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS line_no, unnest(parts) AS line FROM bullets
UNION ALL SELECT CAST(grp_rank AS INTEGER), 0, 0, TITLE || ' (' || count(*) || ')' FROM shown GROUP BY grp_rank, heading"""
_TAGGED = "'- ' || CASE WHEN grp = 'breaking' THEN '{0}' || category || '{1} ' ELSE '' END || ls[1] || ' {2}' || version_text || '{3}'"


@query("a14_diff_to_text", _LINES.replace("HEAD", _TAGGED.format("[", "]", "[", "]")).replace("TITLE", "upper(heading)"))
def diff_to_text(spark, sf_dir):
    return changelog.diff_text_lines(_rendered_input(spark, sf_dir))


@query("a12_diff_to_markdown", _LINES.replace("HEAD", _TAGGED.format("`", "`", "*", "*")).replace("TITLE", "'## ' || heading"))
def diff_to_markdown(spark, sf_dir):
    return changelog.diff_markdown_lines(_rendered_input(spark, sf_dir))


@query("a12_diff_to_json", _LINES[: _LINES.index("bullets AS")].rstrip().rstrip(",") + """
SELECT CAST(grp_rank AS INTEGER) AS grp_rank, seq, CAST(to_json(struct_pack(release := version_text, category := category, breaking := breaking,
  breaking_reason := CASE WHEN breaking AND page_ord % 2 = 0 THEN 'release ' || version_text ELSE '' END, text := ls[1], children := ls[2:])) AS VARCHAR) AS line
FROM shown""")
def diff_to_json(spark, sf_dir):
    return changelog.diff_json_lines(_rendered_input(spark, sf_dir))


# -- scoring -----------------------------------------------------------------------------

# The given texts are invented prose, so the rules are tried on short phrases around them.
_PHRASE = """phrases AS (SELECT page_ord, key, vnum, CASE page_ord % 8
    WHEN 0 THEN 'Fixed a crash in ' WHEN 1 THEN 'Added support for ' WHEN 2 THEN 'Removed the function '
    WHEN 3 THEN 'Deprecated ' WHEN 4 THEN 'Updated documentation for ' WHEN 5 THEN 'Changed the default of '
    WHEN 6 THEN 'Added a check to avoid a race in ' ELSE '' END || text AS text FROM entries)"""
_RULE_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in scoring.RULES
) + " ELSE 'other' END"


def _phrases(spark, sf_dir):
    heads = F.array(*[F.lit(p) for p in (
        "Fixed a crash in ", "Added support for ", "Removed the function ", "Deprecated ", "Updated documentation for ",
        "Changed the default of ", "Added a check to avoid a race in ", "",
    )])
    head = F.element_at(heads, (F.col("page_ord") % 8 + 1).cast("int"))
    return fixtures.entries(spark, sf_dir).select("page_ord", "key", "vnum", F.concat(head, "text").alias("text"))


@query("k5_rule_scorer", "WITH " + fixtures.ENTRIES + ", " + _PHRASE + f"""
SELECT page_ord, {_RULE_CASE} AS category, regexp_matches(text, '{scoring.BREAKING}') AS breaking FROM phrases""")
def rule_scorer(spark, sf_dir):
    return scoring.rule_scores(_phrases(spark, sf_dir)).select("page_ord", "category", "breaking")


@query("k4_score_entries", "WITH " + fixtures.STORE + ", " + _PHRASE + f"""
, pending AS (SELECT key, min(page_ord) AS page_ord, arg_min(text, page_ord) AS text FROM phrases
              WHERE key NOT IN (SELECT key FROM store) GROUP BY key)
SELECT key, {_RULE_CASE} AS category, regexp_matches(text, '{scoring.BREAKING}') AS breaking, 'ok' AS status
FROM pending""")
def score_entries(spark, sf_dir):
    """All pending texts, whole, scored by the keyword rules."""
    fresh = changelog.pending_items(_phrases(spark, sf_dir), fixtures.keyed_store(spark, sf_dir))
    first = changelog.dedupe_first(fresh, "key", "page_ord", "text")
    scored = scoring.score_entries(first, order="page_ord")
    return scored.select("key", "category", "breaking", "status")


@query("k4_score_in_waves", "WITH " + fixtures.STORE + ", " + _PHRASE + f"""
, pending AS (SELECT key, min(page_ord) AS page_ord, arg_min(text, page_ord) AS text FROM phrases
              WHERE key NOT IN (SELECT key FROM store) GROUP BY key),
numbered AS (SELECT *, (row_number() OVER (ORDER BY page_ord) - 1) // 40 AS batch, count(*) OVER () AS n FROM pending),
judged AS (SELECT *, batch < ((n + 39) // 40 + 1) // 2 AS sent FROM numbered)
SELECT key, CASE WHEN sent THEN {_RULE_CASE} END AS category, CASE WHEN sent THEN 'ok' ELSE 'skipped' END AS status,
       CASE WHEN NOT sent THEN 'run stopped: max_requests' END AS reason FROM judged""")
def score_in_waves(spark, sf_dir):
    """A run that may send half of its batches, a quarter of them at a time: the rest is skipped."""
    fresh = changelog.pending_items(_phrases(spark, sf_dir), fixtures.keyed_store(spark, sf_dir))
    first = changelog.dedupe_first(fresh, "key", "page_ord", "text")
    plan = scoring.planned_caps(first, "page_ord")
    batches = (plan.max_requests - 4) // 2
    caps = replace(plan, max_requests=(batches + 1) // 2)
    found = scoring.score_in_waves(first, scoring.keyword_scorer, caps, order="page_ord", wave=max(1, batches // 4))
    return found.select("key", "category", "status", "reason")


@query("k6_validate_hook", "WITH " + fixtures.ENTRIES + """
SELECT page_ord, CASE WHEN length(text) < 40 THEN 'too short' WHEN contains(text, '###') THEN 'marked' END AS reason
FROM entries WHERE length(text) < 40 OR contains(text, '###')""")
def validate_hook(spark, sf_dir):
    reason = F.when(F.length("text") < 40, "too short").when(F.contains("text", F.lit("###")), "marked")
    _, bad = store.validate_rows(fixtures.entries(spark, sf_dir), reason)
    return bad.select("page_ord", "reason")


@query("k3_name_index", """
WITH titles AS (SELECT DISTINCT replace(p_name, ' ', '::') || '::v' || p_size AS title FROM part),
heads AS (SELECT title, unnest(range(1, 4)) AS i FROM titles)
SELECT array_to_string(string_split(title, '::')[1:i], '::') AS prefix, count(*) AS n_titles FROM heads GROUP BY 1""")
def name_index(spark, sf_dir):
    title = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("::")), F.lit("::v"), F.col("p_size").cast("string"))
    return scoring.name_index(table(spark, sf_dir, "part").select(title.alias("title")))
