"""The core engine's queries on the driver's tables, each with its SQL equivalent.

The tables stand in for the entities: documents for manuals' text, conversations for
versioned sections, nation for departments, customer and supplier for users, orders and
lineitem for manuals and their sections, events for revisions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import extension, preview, shown_date, shown_lines, status_badge, status_label, tag_colour
from quire.operators import access, listings, tagging, workflow
from quire.operators.diffs import positional_rows, unified
from quire.operators.entities import SCHEMAS
from quire.operators.state import SectionStore, UniqueTable
from quire.operators.structure import clean, split_sections
from quire.session import delete_on_exit, shared_dir, table
from quire.sources import files, tables

# ---- text ------------------------------------------------------------------------

_STRIP = r"E' \t\n\r\x0b\x0c'"
def _clean_ctes(source: str) -> str:
    return rf"""
    split AS (SELECT doc_id, string_split(text, E'\n') AS a FROM {source} WHERE text IS NOT NULL),
    trimmed AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM split),
    numbered AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a FROM trimmed),
    lines AS (SELECT doc_id, i, trim(a[i], {_STRIP}) AS s FROM numbered),
    classed AS (SELECT *, CASE WHEN s = '' THEN 'B'
        WHEN (regexp_matches(s, '\p{{Lu}}') AND NOT regexp_matches(s, '\p{{Ll}}|\p{{Lt}}')) OR regexp_matches(s, '(?i)^(CHAPTER|SECTION|ARTICLE|PART|APPENDIX)') OR regexp_matches(s, '^\d+(\.\d+)*\s') THEN 'H'
        WHEN len(regexp_split_to_array(s, '\s+')) <= 3 AND NOT regexp_matches(s, '[.?!:]$') THEN 'S' ELSE 'L' END AS k FROM lines),
    marked AS (SELECT *, CASE WHEN k IN ('B', 'H') OR lag(k) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM 'S' THEN 1 ELSE 0 END AS starts FROM classed),
    grouped AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
    rejoined AS (SELECT doc_id, g, string_agg(s, ' ' ORDER BY i) AS line FROM grouped GROUP BY ALL),
    cleaned AS (SELECT doc_id, trim(string_agg(line, E'\n' ORDER BY g), {_STRIP}) AS cleaned FROM rejoined GROUP BY doc_id)"""


def _sections_ctes(source: str, text: str) -> str:
    return rf"""
    body AS (SELECT doc_id, {text} AS text FROM {source} WHERE {text} IS NOT NULL),
    raw AS (SELECT doc_id, unnest(range(1, len(string_split(text, E'\n')) + 1)) AS i, string_split(text, E'\n') AS a FROM body),
    kept AS (SELECT doc_id, i, trim(a[i], {_STRIP}) AS s FROM raw WHERE trim(a[i], {_STRIP}) <> ''),
    flagged AS (SELECT *, (length(s) < 80 AND (regexp_matches(s, '^\d+[\.\)]\s+\w+') OR regexp_matches(s, '^[A-Z][A-Z\s]{{2,60}}$') OR regexp_matches(s, '^[A-Z][a-z]+(\s[A-Z][a-z]+){{0,6}}$'))) AS h FROM kept),
    numbered2 AS (SELECT *, sum(h::int) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM flagged),
    made AS (SELECT doc_id, g, coalesce(max(s) FILTER (WHERE h), 'Introduction') AS subtitle, string_agg(s, E'\n' ORDER BY i) FILTER (WHERE NOT h) AS content FROM numbered2 GROUP BY doc_id, g),
    full_ AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INTEGER AS ord, subtitle, content FROM made WHERE content IS NOT NULL),
    sections AS (SELECT doc_id, ord, subtitle, content FROM full_ UNION ALL SELECT doc_id, 0, 'Full Document', trim(text, {_STRIP}) FROM body WHERE doc_id NOT IN (SELECT doc_id FROM full_))"""


_HEADED_SQL = r"""headed AS (SELECT doc_id, lang, source, n_chars, E'1. Purpose\n\n' || text || E'\n\nSCOPE\n' || coalesce(source, '') || E' keeps this and the next line.\nchapter notes\n\nQuality Policy\n\nshort line\nwritten in ' || coalesce(lang, 'none') || ' and no other language' AS text FROM documents)"""


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings of all kinds around their text, as the texts themselves have next to none."""
    parts = ["1. Purpose\n\n", F.col("text"), "\n\nSCOPE\n", F.coalesce("source", F.lit("")), " keeps this and the next line.\nchapter notes\n\nQuality Policy\n\nshort line\nwritten in ", F.coalesce("lang", F.lit("none")), " and no other language"]
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("text"))


def headed_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(_headed(spark, sf_dir)).select("doc_id", "cleaned")


def headed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sections(clean(_headed(spark, sf_dir)), "cleaned")


def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents")).select("doc_id", "cleaned")


def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sections(table(spark, sf_dir, "documents"))


def cleanup_then_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sections(clean(table(spark, sf_dir, "documents")), "cleaned")


def section_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.tag(cleanup_then_section(spark, sf_dir)).select("doc_id", "ord", "subtitle", "tag")


def edit_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as an edit gives them: blank text asks the model too."""
    return tagging.tag(table(spark, sf_dir, "documents"), "text", untag_blank=False).select("doc_id", "tag")


_TAGS_SQL = f"WITH {_clean_ctes('documents')}, {_sections_ctes('cleaned', 'cleaned')}, {tagging.oracle_scores('content', 'sections', 'doc_id, ord')} SELECT doc_id, ord, subtitle, CASE WHEN trim(content, {_STRIP}) = '' THEN 'UNTAGGED' ELSE tag END AS tag FROM sections JOIN tags USING (doc_id, ord)"
_EDIT_TAGS_SQL = f"WITH {tagging.oracle_scores('text', 'documents', 'doc_id')} SELECT doc_id, tag FROM documents JOIN tags USING (doc_id)"


def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files with an invalid byte at the end, which reading drops; some have a type that isn't read."""
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("lang") == "de", ".doc").otherwise(".TXT"))
    raw = table(spark, sf_dir, "documents").select("doc_id", name.alias("path"), F.concat(F.encode("text", "utf-8"), F.lit(bytearray(b"\xff"))).alias("content"))
    return files.extract(raw).select("doc_id", "raw_text", F.col("error").isNotNull().alias("failed"))


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations kept as files, read back by the names that manuals hold: some name no file, one that is gone, or one of a type that isn't read."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    # A file a conversation; some are of another type.
    ending = F.when(F.col("conv_id") % 7 == 3, "csv").otherwise("txt")
    folder = delete_on_exit(spark, f"{shared_dir(spark)}/quire-files-{uuid.uuid4().hex}")
    there = files.write_each(turns.select(F.col("conv_id").alias("key"), F.array_join("t.text", "\n").alias("text"), ending.alias("ending")), folder)
    name = F.when(F.col("key") % 5 == 1, F.lit("")).when(F.col("key") % 5 == 2, F.concat("path", F.lit(".gone.txt"))).otherwise(F.col("path"))
    manuals = there.select(F.col("key").alias("id"), name.alias("file"))
    found = files.read_back(manuals, files.read_named(spark, folder, manuals))
    return found.select("id", "text", F.substring_index("error", ":", 1).alias("error"))


_STORED_SQL = rf"""WITH docs AS (SELECT conv_id AS doc_id, string_agg(text, E'\n' ORDER BY turn) AS text FROM conversations GROUP BY conv_id), {_clean_ctes('docs')},
    back AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 1 THEN 'no file' WHEN doc_id % 5 = 2 THEN 'file not found' WHEN doc_id % 7 = 3 THEN 'ValueError' END AS error, cleaned FROM cleaned)
    SELECT id, CASE WHEN error IS NULL THEN cleaned END AS text, error FROM back"""


def upload_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads titled by their source: what upload, cleanup, sectioning and tagging insert; German files can't be read."""
    made = clean(_headed(spark, sf_dir)).withColumn("file", F.concat(F.lit("manual-"), "doc_id"))
    rows = made.select(F.col("doc_id").alias("id"), F.when(F.col("source") != "src1", F.col("source")).alias("title"), F.pmod("n_chars", F.lit(25)).cast("long").alias("department_id"), "file")
    texts = made.select("file", F.when(F.col("lang") != "de", F.col("cleaned")).alias("text"), F.when(F.col("lang") == "de", "unreadable").alias("error"))
    none = spark.createDataFrame([], SCHEMAS["manual"]), spark.createDataFrame([], SCHEMAS["section"])
    _, sections, _ = workflow.upload_manuals(*none, rows, texts)
    return sections.select("manual_id", "order", "subtitle", "content", "tag", "version")


_UPLOAD_SQL = f"""WITH {_HEADED_SQL}, {_clean_ctes('headed')}, {_sections_ctes('cleaned', 'cleaned')}, {tagging.oracle_scores('content', 'sections', 'doc_id, ord')}
    SELECT s.doc_id AS manual_id, s.ord AS "order", s.subtitle, s.content, CASE WHEN trim(s.content, {_STRIP}) = '' THEN 'UNTAGGED' ELSE tag END AS tag, 1 AS version
    FROM sections s JOIN tags t ON s.doc_id = t.doc_id AND s.ord = t.ord JOIN documents d ON d.doc_id = s.doc_id WHERE d.lang <> 'de' AND d.source <> 'src1'"""

# ---- versions and diffs --------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("section_id"), F.col("turn").alias("version"), F.col("text").alias("content"))
    return listings.previous(turns, order=("version",))


def previous_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_rows(_pairs(spark, sf_dir), "previous_content", "content", ("section_id", "version"))


def unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("section_id", "version", unified(F.col("previous_content"), F.col("content")).alias("diff_text"))


def unified_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified diffs of one-line texts: equal, emptied, filled and changed ones, all of which SQL can tell."""
    first = _pairs(spark, sf_dir).select("section_id", "version", F.substring_index(F.coalesce("previous_content", F.lit("")), "\n", 1).alias("old"), F.substring_index("content", "\n", 1).alias("line"))
    new = F.when(F.col("version") % 3 == 1, F.col("old")).when(F.col("version") % 4 == 2, "").otherwise(F.col("line"))
    return first.withColumn("new", new).select("section_id", "version", unified(F.col("old"), F.col("new")).alias("diff_text"))


def unified_diff_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as texts of many lines against a later version: turns taken out, moved to the front and added, so that lines have to be aligned."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = lambda x: F.concat_ws("\n", x["role"], x["text"])
    old = F.array_join(F.transform("t", said), "\n\n")
    kept = F.transform(F.filter("t", lambda x: x["turn"] % 4 != 1), said)
    new = F.array_join(F.concat(F.transform(F.slice("t", -1, 1), said), kept, F.array(F.concat(F.lit("end of "), F.col("conv_id")))), "\n\n")
    return turns.select("conv_id", old.alias("old"), new.alias("new")).select("conv_id", unified(F.col("old"), F.col("new")).alias("diff_text"))


def _unified_sql(source: str, keys: str) -> str:
    """Unified diffs of ``source`` (keys, old, new); its texts have less than 200 lines, and no line ends but \\n."""
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys.split(", "))
    of = lambda x: ", ".join(f"{x}.{k}" for k in keys.split(", "))
    lines = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN []::VARCHAR[] WHEN {c}[-1:] = E'\\n' THEN string_split({c}, E'\\n')[:-2] ELSE string_split({c}, E'\\n') END"
    shown = lambda a, b: f"CASE WHEN {b} - {a} = 1 THEN ({a} + 1)::VARCHAR WHEN {b} = {a} THEN {a} || ',0' ELSE ({a} + 1) || ',' || ({b} - {a}) END"
    return rf"""RECURSIVE texts AS (SELECT {keys}, {lines('old')} AS a, {lines('new')} AS b FROM {source}),
    la AS (SELECT {keys}, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i FROM texts),
    lb AS (SELECT {keys}, unnest(b) AS line, generate_subscripts(b, 1) - 1 AS j FROM texts),
    alike AS (SELECT {of('la')}, i, j, i - row_number() OVER (PARTITION BY {of('la')}, i - j ORDER BY i) AS island FROM la JOIN lb ON {on('la', 'lb')} AND la.line = lb.line),
    runs AS (SELECT {keys}, min(i) AS i, min(j) AS j, count(*) AS k FROM alike GROUP BY {keys}, i - j, island),
    walk({keys}, alo, ahi, blo, bhi, best) AS (
        SELECT {keys}, 0::BIGINT, len(a)::BIGINT, 0::BIGINT, len(b)::BIGINT, (SELECT min((-least(len(a) - r.i, len(b) - r.j, r.k), r.i, r.j)) FROM runs r WHERE {on('r', 'texts')}) FROM texts
        UNION ALL
        SELECT {of('p')}, p.alo, p.ahi, p.blo, p.bhi, (SELECT min((-(least(p.ahi - r.i, p.bhi - r.j, r.k) - greatest(p.alo - r.i, p.blo - r.j, 0)), greatest(r.i, p.alo, r.i + p.blo - r.j), greatest(r.j, p.blo, r.j + p.alo - r.i))) FROM runs r WHERE {on('r', 'p')} AND least(p.ahi - r.i, p.bhi - r.j, r.k) > greatest(p.alo - r.i, p.blo - r.j, 0))
        FROM (SELECT {keys}, x.alo, x.ahi, x.blo, x.bhi FROM (SELECT {keys}, unnest([{{'alo': alo, 'ahi': best[2], 'blo': blo, 'bhi': best[3]}}, {{'alo': best[2] - best[1], 'ahi': ahi, 'blo': best[3] - best[1], 'bhi': bhi}}]) AS x FROM walk WHERE best IS NOT NULL) WHERE x.alo < x.ahi AND x.blo < x.bhi) p),
    blocks AS (SELECT {keys}, best[2] AS i, best[3] AS j, -best[1] AS k FROM walk WHERE best IS NOT NULL UNION ALL SELECT {keys}, len(a), len(b), 0 FROM texts),
    gaps AS (SELECT {keys}, coalesce(lag(i + k) OVER w, 0) AS i, i AS e, coalesce(lag(j + k) OVER w, 0) AS j, j AS f FROM blocks WINDOW w AS (PARTITION BY {keys} ORDER BY i, j, k DESC)),
    changes AS (SELECT *, lag(e) OVER w AS above, coalesce(i - lag(e) OVER w > 6, true) AS opens, coalesce(lead(i) OVER w - e > 6, true) AS closes FROM gaps WHERE i < e OR j < f WINDOW w AS (PARTITION BY {keys} ORDER BY i, j)),
    grouped AS (SELECT *, sum(opens::INT) OVER (PARTITION BY {keys} ORDER BY i, j) AS g FROM changes),
    pieces AS (SELECT {of('c')}, c.g, c.i, c.j, list_transform(CASE WHEN opens THEN a[greatest(c.i - 2, 1) : c.i] ELSE a[above + 1 : c.i] END, lambda x: ' ' || x) || list_transform(a[c.i + 1 : e], lambda x: '-' || x) || list_transform(b[c.j + 1 : f], lambda x: '+' || x) || CASE WHEN closes THEN list_transform(a[e + 1 : e + 3], lambda x: ' ' || x) ELSE [] END AS said FROM grouped c JOIN texts ON {on('c', 'texts')}),
    ends AS (SELECT {of('c')}, g, min(c.i - least(c.i, 3)) AS a0, max(e + least(len(a) - e, 3)) AS a1, min(c.j - least(c.i, 3)) AS b0, max(f + least(len(a) - e, 3)) AS b1 FROM grouped c JOIN texts ON {on('c', 'texts')} GROUP BY {of('c')}, g),
    hunks AS (SELECT {of('p')}, p.g, '@@ -' || {shown('any_value(a0)', 'any_value(a1)')} || ' +' || {shown('any_value(b0)', 'any_value(b1)')} || E' @@
' || string_agg(array_to_string(said, E'
'), E'
' ORDER BY i, j) AS hunk FROM pieces p JOIN ends ON {on('p', 'ends')} AND p.g = ends.g GROUP BY {of('p')}, p.g),
    diffs AS (SELECT {of('t')}, CASE WHEN count(hunk) = 0 THEN '' ELSE E'--- 
+++ 
' || string_agg(hunk, E'
' ORDER BY g) END AS diff_text FROM texts t LEFT JOIN hunks h ON {on('t', 'h')} GROUP BY {of('t')})"""


_EDITED_SQL = r"""(SELECT conv_id, string_agg(said, E'\n\n' ORDER BY turn) AS old,
        arg_max(said, turn) || E'\n\n' || CASE WHEN count(*) FILTER (WHERE turn % 4 <> 1) > 0 THEN string_agg(said, E'\n\n' ORDER BY turn) FILTER (WHERE turn % 4 <> 1) || E'\n\n' ELSE '' END || 'end of ' || conv_id AS new
        FROM (SELECT conv_id, turn, concat_ws(E'\n', role, text) AS said FROM conversations) GROUP BY conv_id)"""
_DIFF_LINES_SQL = r"""WITH p AS (SELECT conv_id AS section_id, turn AS version, split_part(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), E'\n', 1) AS old, split_part(text, E'\n', 1) AS line FROM conversations),
    q AS (SELECT *, CASE WHEN version % 3 = 1 THEN old WHEN version % 4 = 2 THEN '' ELSE line END AS new FROM p)
    SELECT section_id, version, CASE WHEN old = new THEN '' ELSE E'--- \n+++ \n@@ -' || CASE WHEN old = '' THEN '0,0' ELSE '1' END || ' +' || CASE WHEN new = '' THEN '0,0' ELSE '1' END || ' @@' || CASE WHEN old = '' THEN '' ELSE E'\n-' || old END || CASE WHEN new = '' THEN '' ELSE E'\n+' || new END END AS diff_text FROM q"""


def submit_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-line revisions of suppliers' names as sections: the submission with its diff as the submitter sees it; those of other departments are refused."""
    s = table(spark, sf_dir, "supplier")
    sections = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("manual_id"), F.col("s_name").alias("content"))
    manuals = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("department_id"))
    users = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_regionkey").cast("long").alias("department_id"))
    text = F.when(F.col("s_suppkey") % 2 == 0, F.rpad("s_name", 600, "x")).otherwise(F.col("s_name"))
    uploads = s.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("section_id"), F.col("s_suppkey").alias("submitted_by_id"), F.when(F.col("s_suppkey") % 5 != 0, "file.txt").alias("uploaded_file"), text.alias("text"), F.lit(None).cast("timestamp").alias("submitted_at"))
    good, _ = workflow.allowed_uploads(uploads, users, sections, manuals)
    return workflow.submitted(workflow.submit_revisions(spark.createDataFrame([], SCHEMAS["revision"]), sections, good))


_SUBMIT_SQL = r"""SELECT s_suppkey AS id, 'pending' AS status, CASE WHEN s_suppkey % 2 = 0 THEN substring(E'--- \n+++ \n@@ -1 +1 @@\n-' || s_name || E'\n+' || rpad(s_name, 600, 'x'), 1, 500) ELSE 'No changes detected.' END AS diff_preview
    FROM supplier JOIN nation m ON s_nationkey = m.n_nationkey JOIN customer ON c_custkey = s_suppkey JOIN nation u ON c_nationkey = u.n_nationkey WHERE s_suppkey % 5 <> 0 AND m.n_regionkey = u.n_regionkey"""

_PAIRS_SQL = "SELECT conv_id AS section_id, turn AS version, text AS content, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_content FROM conversations"
_POSITIONAL_SQL = rf"""WITH pairs AS ({_PAIRS_SQL}),
    arrays AS (SELECT section_id, version, string_split(coalesce(previous_content, ''), E'\n') AS a, string_split(coalesce(content, ''), E'\n') AS b FROM pairs),
    places AS (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM arrays),
    compared AS (SELECT section_id, version, i, CASE WHEN i <= len(a) THEN a[i] END AS x, CASE WHEN i <= len(b) THEN b[i] END AS y FROM places),
    rows_ AS (SELECT section_id, version, i, 0 AS j, 'same' AS kind, x AS line FROM compared WHERE x = y
        UNION ALL SELECT section_id, version, i, 1, 'removed', x FROM compared WHERE x IS NOT NULL AND x IS DISTINCT FROM y
        UNION ALL SELECT section_id, version, i, 2, 'added', y FROM compared WHERE y IS NOT NULL AND x IS DISTINCT FROM y)
    SELECT section_id, version, (row_number() OVER (PARTITION BY section_id, version ORDER BY i, j) - 1)::INTEGER AS ord, kind, line FROM rows_"""


def _conversation_entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as (sections, history): the last turn is the present version."""
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    made = turns.select(F.col("conv_id").alias("section_id"), F.col("n").alias("version"), F.col("role").alias("subtitle"), F.col("text").alias("content"), F.lit("UNTAGGED").alias("tag"), F.when(F.col("role") == "user", F.lit(1)).cast("long").alias("edited_by_id"), F.lit(None).cast("timestamp").alias("edited_at"), (F.col("turn") == F.col("last")).alias("now"))
    return made.filter("now").drop("now").withColumnRenamed("section_id", "id"), made.filter("not now").drop("now")


def history_with_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections, old = _conversation_entities(spark, sf_dir)
    people = spark.createDataFrame([(1, "editor")], "id long, username string")
    return listings.history(old, sections, people).select("section_id", "version", "subtitle", "content", "edited_by", "is_current")


_HISTORY_SQL = """WITH t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS version, turn = max(turn) OVER (PARTITION BY conv_id) AS is_current FROM conversations)
    SELECT conv_id AS section_id, version, role AS subtitle, text AS content, CASE WHEN is_current THEN 'Current' WHEN role = 'user' THEN 'editor' ELSE 'N/A' END AS edited_by, is_current FROM t"""


def _edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first turn of a conversation as a section, later ones as edits: even turns give content, those over 2 a title."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    start = turns.join(first, ["conv_id", "turn"])
    sections = start.select(F.col("conv_id").alias("id"), F.pmod("conv_id", F.lit(10)).alias("manual_id"), F.col("role").alias("subtitle"), F.col("text").alias("content"), F.lit("UNTAGGED").alias("tag"), F.lit(5).alias("page_number"), F.lit(0).alias("order"), F.lit(1).alias("version"))
    later = turns.join(first.withColumnRenamed("turn", "first"), "conv_id").filter("turn > first")
    none = F.lit(False)
    events = later.select(F.col("conv_id").alias("section_id"), F.col("turn").cast("int").alias("seq"), (F.col("turn") > 2).alias("has_subtitle"), F.col("role").alias("subtitle"), (F.col("turn") % 2 == 0).alias("has_content"), F.col("text").alias("content"), (F.col("turn") == 1).alias("has_page"), F.lit(None).cast("int").alias("page_number"), none.alias("has_order"), F.lit(None).cast("int").alias("order"), F.col("turn").alias("actor"), F.lit(None).cast("timestamp").alias("ts"))
    return sections, events


def version_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, _ = workflow.fold_edits(*_edits(spark, sf_dir))
    return now.select("id", "subtitle", "content", "tag", "page_number", "version")


def incremental_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``version_fold`` in batches of a turn: each reads the last snapshot and its own events only; every batch is delivered twice."""
    sections, events = _edits(spark, sf_dir)
    store = SectionStore.create(spark, delete_on_exit(spark, f"{shared_dir(spark)}/quire-store-{uuid.uuid4().hex}"), sections, buckets=8)
    for turns in (events.filter("seq <= 1"), events.filter("seq between 2 and 4"), events.filter("seq > 4")):
        batch = store.next_batch()
        for _ in range(2):
            store.apply(turns, batch)
    return store.sections().select("id", "subtitle", "content", "tag", "page_number", "version")


def edit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, past = workflow.fold_edits(*_edits(spark, sf_dir))
    return past.select("section_id", "version", "subtitle", "content", "edited_by_id")


def manual_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections, events = _edits(spark, sf_dir)
    manuals = spark.range(12).select("id", F.lit(1).alias("version"))
    return workflow.bump_manuals(manuals, sections, events)


_STATES = """WITH t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS version, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations),
    s AS (SELECT conv_id, version, turn, turn = first AS start,
        last_value(CASE WHEN turn = first OR turn > 2 THEN role END IGNORE NULLS) OVER w AS subtitle,
        last_value(CASE WHEN turn = first OR turn % 2 = 0 THEN text END IGNORE NULLS) OVER w AS content,
        CASE WHEN count(*) FILTER (WHERE turn <> first AND turn = 1) OVER w > 0 THEN NULL ELSE 5 END AS page_number,
        lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS edited_by_id
        FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""
_EDIT_HISTORY_SQL = f"{_STATES} SELECT conv_id AS section_id, version, subtitle, content, edited_by_id FROM s WHERE edited_by_id IS NOT NULL"
_RETAGGED_SQL = f"""{_STATES}, last AS (SELECT conv_id, subtitle, content, page_number, version FROM s WHERE edited_by_id IS NULL), {tagging.oracle_scores('content', 'last', 'conv_id')},
    given AS (SELECT conv_id, bool_or(NOT start AND turn % 2 = 0) AS retag FROM s GROUP BY 1)
    SELECT conv_id AS id, subtitle, content, CASE WHEN retag THEN tag ELSE 'UNTAGGED' END AS tag, page_number, version FROM last JOIN tags USING (conv_id) JOIN given USING (conv_id)"""


def apply_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later turns as revisions of the first: those of assistants are approved, files of every third turn can't be read; sections after approval, with tag and version."""
    sections, events = _edits(spark, sf_dir)
    turns = events.select((F.col("section_id") * 1000 + F.col("seq")).alias("id"), "section_id", "seq", "content", "subtitle", "actor")
    named = turns.withColumn("uploaded_file", F.concat(F.lit("revision-"), F.col("id")))
    revisions = named.select("id", "section_id", F.col("actor").alias("submitted_by_id"), "uploaded_file")
    reviews = named.select("id", "seq", F.when(F.col("subtitle") == "assistant", "approved").otherwise("rejected").alias("status"), F.lit(None).cast("timestamp").alias("ts"))
    texts = named.filter("seq % 5 <> 0").select("uploaded_file", F.when(F.col("seq") % 3 != 0, F.col("content")).alias("text"), F.when(F.col("seq") % 3 == 0, "unreadable").alias("error"))
    now, _ = workflow.fold_edits(sections, workflow.approval_events(reviews, revisions, texts))
    failed = workflow.failed_approvals(reviews, revisions, texts).groupBy(F.floor(F.col("id") / 1000).alias("id")).agg(F.count("*").alias("n"))
    return now.join(failed, "id", "left").select("id", "content", "tag", "version", F.coalesce("n", F.lit(0)).alias("failed"))


_APPROVAL_SQL = f"""WITH t AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations),
    r AS (SELECT *, turn > first AND role = 'assistant' AS approved FROM t),
    ok AS (SELECT *, approved AND turn % 3 <> 0 AND turn % 5 <> 0 AS applied FROM r),
    last AS (SELECT conv_id, arg_max(text, turn) AS content, (1 + count(*) FILTER (WHERE applied))::INTEGER AS version FROM ok WHERE applied OR turn = first GROUP BY 1), {tagging.oracle_scores('content', 'last', 'conv_id')}
    SELECT conv_id AS id, content, CASE WHEN version > 1 THEN tag ELSE 'UNTAGGED' END AS tag, version, (SELECT count(*) FROM ok o WHERE o.conv_id = last.conv_id AND approved AND NOT applied) AS failed FROM last JOIN tags USING (conv_id)"""
_MANUAL_VERSIONS_SQL = f"{_STATES}, n AS (SELECT conv_id % 10 AS m, count(*) FILTER (WHERE NOT start) AS n FROM s GROUP BY 1) SELECT id, (1 + coalesce(n, 0))::INTEGER AS version FROM range(12) r(id) LEFT JOIN n ON n.m = r.id"

# ---- listings --------------------------------------------------------------------------


def _departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as departments, those of region 0 left out so that some references have no name."""
    return table(spark, sf_dir, "nation").filter("n_regionkey <> 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.concat("c_name", F.lit("@example.org")).alias("email"), F.when(F.col("c_custkey") % 7 == 0, "admin").otherwise("staff").alias("role"), (F.col("c_acctbal") >= 0).alias("is_approved"), (F.col("c_custkey") % 7 == 0).alias("is_staff"), F.col("c_nationkey").cast("long").alias("department_id"))


def pending_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.users(_users(spark, sf_dir), _departments(spark, sf_dir), False)


def approved_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.users(_users(spark, sf_dir), _departments(spark, sf_dir), True)


def department_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.departments(_departments(spark, sf_dir))


def login_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.login(_users(spark, sf_dir), _departments(spark, sf_dir))


def user_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.admin_list(_users(spark, sf_dir), ["id", "username", "role"], is_approved=True, role="admin")


def _manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), (F.col("o_custkey") % 25).alias("department_id"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("uploaded_by_id"), F.col("o_orderdate").alias("uploaded_at"), F.lit(1).alias("version"))


def manual_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as manuals with all lines as sections; some have no uploader, some a department without a name."""
    sections = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("manual_id"))
    return listings.manuals(_manuals(spark, sf_dir), _departments(spark, sf_dir), _users(spark, sf_dir), sections).withColumn("uploaded_at", F.date_format("uploaded_at", "yyyy-MM-dd"))


def section_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manual's sections, its lines ordered by number."""
    line = table(spark, sf_dir, "lineitem")
    sections = line.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("manual_id"), F.col("l_shipdate").cast("string").alias("subtitle"), F.col("l_returnflag").alias("content"), F.col("l_linestatus").alias("tag"), F.lit(None).cast("int").alias("page_number"), F.col("l_linenumber").alias("order"), F.lit(1).alias("version"))
    return listings.sections(sections, _manuals(spark, sf_dir), _departments(spark, sf_dir), 1).select("manual", "department", "id", "content", "preview", "tag", "order", "version")


def section_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text"), 200).alias("preview"))


def revision_list(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("section_id"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("submitted_by_id"), F.col("event_type").alias("status"), F.col("props").alias("diff_text"), F.col("ts").alias("submitted_at"), F.lit("").alias("reviewer_notes"))
    c = table(spark, sf_dir, "customer")
    sections = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("manual_id"), F.col("c_name").alias("subtitle"))
    manuals = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"), F.col("n_regionkey").cast("long").alias("department_id"))
    departments = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return listings.revisions(rows, sections, manuals, departments, _users(spark, sf_dir), status).select("id", "section", "manual", "department", "submitted_by", "status", "diff_preview")


def revision_list_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision_list(spark, sf_dir, "purchase")


def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.access_counts(_users(spark, sf_dir), _manuals(spark, sf_dir))


def readable_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.readable(_manuals(spark, sf_dir), 3, False).select("id", "department_id")


def _accessed(spark: SparkSession, sf_dir: str, reader: int | None) -> DataFrame:
    sections = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("manual_id"))
    access.install(spark, _departments(spark, sf_dir), _users(spark, sf_dir), _manuals(spark, sf_dir), sections)
    return access.visible(spark, reader)


def access_anonymous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accessed(spark, sf_dir, None)


def access_authenticated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accessed(spark, sf_dir, 3)


def access_staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accessed(spark, sf_dir, 7)


def admin_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _departments(spark, sf_dir).withColumn("created_at", F.lit("2020-01-01").cast("date"))
    return listings.admin_list(rows, ["name", "created_at"])


def admin_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manuals with the ids of their department and uploader; those without an uploader by a facet of None."""
    return listings.admin_list(_manuals(spark, sf_dir), ["id", "title", "department_id", "uploaded_by_id"], uploaded_by_id=None)


def admin_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_returnflag").alias("subtitle"), F.col("l_orderkey").alias("manual_id"), F.col("l_linestatus").alias("tag"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("page_number"), F.col("l_linenumber").alias("order"))
    return listings.admin_list(rows, ["subtitle", "manual_id", "tag", "page_number", "order"], tag="O")


def admin_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("section_id"), F.col("user_id").alias("submitted_by_id"), F.col("event_type").alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("submitted_at"))
    return listings.admin_list(rows, ["section_id", "submitted_by_id", "status", "submitted_at"], status="purchase")


def uploaded_manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manuals' own rows after uploads: orders are there, documents are new; those without a title or file are refused."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select((-1 - F.col("doc_id")).alias("id"), F.when(F.col("source") != "src1", F.col("source")).alias("title"), F.pmod("n_chars", F.lit(25)).cast("long").alias("department_id"), F.when(F.col("lang") != "de", F.concat(F.lit("manual-"), "doc_id")).alias("file"))
    there = _manuals(spark, sf_dir).select("id", "title", F.col("department_id").cast("long").alias("department_id"), F.lit(None).cast("string").alias("file"), "version")
    texts = docs.select(F.concat(F.lit("manual-"), "doc_id").alias("file"), "text", F.lit(None).cast("string").alias("error"))
    manuals, _, _ = workflow.upload_manuals(there, spark.createDataFrame([], SCHEMAS["section"]), rows, texts)
    return manuals.select("id", "title", "department_id", "file", "version")


def reviewed_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as revisions, submitted at a stated time, and the time of each one's latest review."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "view", "rejected").otherwise("other")
    reviews = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("event_type").alias("notes"), F.col("ts").cast("timestamp").alias("ts"))
    now = F.lit("2026-01-02 03:04:05").cast("timestamp")
    c = table(spark, sf_dir, "customer")
    sections = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("content"))
    uploads = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("section_id"), F.col("c_custkey").alias("submitted_by_id"), F.lit("f.txt").alias("uploaded_file"), F.col("c_name").alias("text"), now.alias("submitted_at"))
    revisions = workflow.submit_revisions(spark.createDataFrame([], SCHEMAS["revision"]), sections, uploads)
    at = lambda name: F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
    return workflow.review(revisions, reviews)[0].select("id", "status", "reviewer_notes", at("submitted_at"), at("reviewed_at"))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON text, nulls included."""
    return tables.as_json(_manuals(spark, sf_dir).select("id", "title", "uploaded_by_id", "version"))


def password_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of customers' names as new passwords, some of them repeated otherwise, and what is wrong with them."""
    c = table(spark, sf_dir, "customer")
    new = F.substring("c_name", F.lit(1), (F.col("c_custkey") % 12).cast("int"))
    again = F.when(F.col("c_custkey") % 5 != 0, new)
    return c.select(F.col("c_custkey").alias("id"), workflow.password_problem(new, again).alias("problem"))


def stored_model_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edit_tags`` by a model kept in the shared storage: the first caller trains it, the next reads it."""
    path = delete_on_exit(spark, f"{shared_dir(spark)}/quire-model-{uuid.uuid4().hex}.json")
    for _ in range(2):
        model = tagging.TagModel.load_or_train(path, spark)
    return tagging.tag(table(spark, sf_dir, "documents"), "text", untag_blank=False, model=model).select("doc_id", "tag")


_SEEN = lambda reader: rf"""WITH {_USERS}, r AS (SELECT * FROM u WHERE id = {reader}), s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS manual_id FROM lineitem)
    SELECT 'departments' AS what, id FROM d UNION ALL SELECT 'manuals', m.id FROM m, r WHERE r.is_staff OR r.department_id = m.department_id
    UNION ALL SELECT 'sections', s.id FROM s JOIN m ON s.manual_id = m.id, r WHERE r.is_staff OR r.department_id = m.department_id
    UNION ALL SELECT 'uploads', m.id FROM m, r WHERE r.department_id = m.department_id UNION ALL SELECT 'users', u.id FROM u, r WHERE r.is_staff"""  # noqa: E731

_REVIEWED_SQL = r"""WITH e AS (SELECT user_id, event_id, event_type, ts FROM events WHERE event_type IN ('purchase', 'view') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT c_custkey AS id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'rejected' ELSE 'pending' END AS status, coalesce(event_type, '') AS reviewer_notes, '2026-01-02 03:04:05.000000' AS submitted_at, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS reviewed_at
    FROM customer LEFT JOIN e ON user_id = c_custkey"""


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as users: two batches that share names are inserted in turn; those in the table, and the refused ones."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 != 0, F.concat(F.lit("name "), F.pmod("p_partkey", F.lit(97)))).alias("name"))
    store = UniqueTable.create(spark, delete_on_exit(spark, f"{shared_dir(spark)}/quire-names-{uuid.uuid4().hex}"), part.filter("id % 3 = 1"), "name")
    refused = store.insert(part.filter("id % 3 <> 1"))
    return store.rows().select("id", "name", F.lit(True).alias("kept")).union(refused.select("id", "name", F.lit(False)))


_UNIQUE_NAMES_SQL = """WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 <> 0 THEN 'name ' || p_partkey % 97 END AS name, p_partkey % 3 <> 1 AS late FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY late, id) AS n FROM p)
    SELECT id, name, n = 1 AS kept FROM r WHERE name IS NOT NULL AND (n = 1 OR late) UNION ALL SELECT id, name, false FROM r WHERE name IS NULL AND late"""


def unique_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names as new departments: refused if they end in an even digit, which are taken."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    taken = s.filter("id % 2 = 0").select((-F.col("id")).alias("id"), "name")
    made, refused = workflow.create_departments(taken, s)
    return made.select("id", "name", F.lit("there").alias("state")).union(refused.select("id", "name", F.lit("refused")))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.lookup(table(spark, sf_dir, "orders"), 7, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


def type_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", extension(F.col("url")).alias("ext"))


# ---- deletions and reviews ------------------------------------------------------------------


def _entity_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    line = table(spark, sf_dir, "lineitem")
    return {
        "department": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")),
        "user": _users(spark, sf_dir).select("id", "department_id"),
        "manual": _manuals(spark, sf_dir).select("id", "department_id", "uploaded_by_id"),
        "section": line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("manual_id")),
    }


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        nulls = [F.count_if(F.col(c).isNull()) for c in df.columns if c != "id"]
        one = df.agg(F.count("*").alias("n_rows"), sum(nulls, F.lit(0)).cast("long").alias("n_nulls")).select(F.lit(name).alias("entity"), "n_rows", "n_nulls")
        out = one if out is None else out.union(one)
    return out


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and null references by entity after department 3 goes."""
    gone = spark.createDataFrame([(3,)], "id long")
    return _counts(workflow.delete(_entity_tables(spark, sf_dir), "department", gone))


def set_null_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manuals after the users of department 5 go."""
    tables = _entity_tables(spark, sf_dir)
    gone = tables["user"].filter("department_id = 5").select("id")
    return workflow.delete(tables, "user", gone)["manual"]


def delete_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, with lines' parts as their history, that stay after the manuals of user 4 go."""
    tables = _entity_tables(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    tables["section_history"] = line.select((key * 10).alias("id"), key.alias("section_id"), F.col("l_partkey").alias("edited_by_id"))
    tables["revision"] = line.select((key * 10 + 1).alias("id"), key.alias("section_id"), F.col("l_suppkey").alias("submitted_by_id"))
    return _remaining(workflow.delete(tables, "manual", tables["manual"].filter("uploaded_by_id = 4").select("id")))


def delete_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on sections that stay after all third lines go."""
    tables = _entity_tables(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    tables["revision"] = line.select((key * 10 + 1).alias("id"), key.alias("section_id"), F.col("l_suppkey").alias("submitted_by_id"))
    return _remaining(workflow.delete(tables, "section", line.filter("l_linenumber = 3").select(key.alias("id"))))


def _remaining(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("entity"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def register_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for accounts named by the last digits of their key: taken and repeated names are refused, unknown departments are null."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 50 != 0, F.right(F.col("c_name"), F.lit(2))).otherwise("").alias("username"), F.col("c_nationkey").cast("long").alias("department_id"))
    there = spark.createDataFrame([(-1, "07", None, True, "admin")], "id long, username string, department_id long, is_approved boolean, role string")
    users, refused = workflow.register_users(there, _departments(spark, sf_dir), rows)
    made = users.filter("id >= 0").select("id", "username", "department_id", "role", "is_approved", F.lit("made").alias("state"))
    return made.unionByName(refused.select("id", "username", F.lit(None).cast("long").alias("department_id"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("boolean").alias("is_approved"), F.lit("refused").alias("state")))


def approve_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.approve_user(_users(spark, sf_dir), 5).select("id", "is_approved")


def create_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as new sections: titles are needed, page and order that aren't numbers become null and 0, empty content stays untagged."""
    p = table(spark, sf_dir, "part")
    content = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, F.concat(F.lit("The manager shall ensure compliance of the "), "p_name")).when(F.col("p_size") % 4 == 2, F.concat(F.lit("Follow these steps for the "), "p_name")).otherwise(F.col("p_name"))
    page = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    rows = p.select(F.col("p_partkey").alias("id"), F.lit(1).cast("long").alias("manual_id"), F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("subtitle"), content.alias("content"), page.alias("page_number"), page.alias("order"))
    made, _ = workflow.create_sections(spark.createDataFrame([], SCHEMAS["section"]), rows)
    return made.select("id", "subtitle", "tag", "page_number", "order", "version")


_CREATE_SQL = f"""WITH rows_ AS (SELECT p_partkey AS id, p_name AS subtitle, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'The manager shall ensure compliance of the ' || p_name WHEN 2 THEN 'Follow these steps for the ' || p_name ELSE p_name END AS content, CASE WHEN p_size % 2 = 0 THEN p_size END AS page FROM part WHERE p_size % 7 <> 0), {tagging.oracle_scores('content', 'rows_', 'id')}
    SELECT id, subtitle, CASE WHEN content = '' THEN 'UNTAGGED' ELSE tag END AS tag, page AS page_number, coalesce(page, 0) AS "order", 1 AS version FROM rows_ JOIN tags USING (id)"""


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*[F.lit(x) for x in (".PDF", ".txt", ".b.JpEg", ".png", ".doc", "")])
    name = F.concat("url", F.get(endings, (F.col("page_id") % 6).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", files.kind(name).alias("kind"))


def revision_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How events look as revisions: label and badge of the status, the date, the colour of a tag."""
    colours = {"purchase": "green", "view": "blue", "UNTAGGED": "grey"}
    return table(spark, sf_dir, "events").select("event_id", status_label(F.col("event_type")).alias("label"), status_badge(F.col("event_type")).alias("badge"), shown_date(F.col("ts")).alias("day"), tag_colour(F.col("event_type"), colours).alias("colour"))


def shown_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(shown_lines(F.concat("text", F.lit("\n \nend"))), "|").alias("shown"))


def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as revisions, events as their reviews: purchases approve, views reject, others are refused."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "view", "rejected").otherwise("other")
    reviews = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), F.lit(None).cast("string").alias("notes"), F.col("ts").cast("timestamp").alias("ts"))
    revisions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit("").alias("reviewer_notes"))
    return workflow.review(revisions, reviews)[0].select("id", "status", "reviewer_notes")


_USERS = "u AS (SELECT c_custkey AS id, c_name AS username, c_name || '@example.org' AS email, CASE WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'staff' END AS role, c_acctbal >= 0 AS is_approved, c_custkey % 7 = 0 AS is_staff, c_nationkey::bigint AS department_id FROM customer), d AS (SELECT n_nationkey::bigint AS id, n_name AS name FROM nation WHERE n_regionkey <> 0), m AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_custkey % 25 AS department_id, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS uploaded_by_id, o_orderdate AS uploaded_at FROM orders)"
_JOINED = "FROM u LEFT JOIN d ON u.department_id = d.id"
_REVISIONS = """SELECT e.event_id AS id, c.c_name AS section, n.n_name AS manual, r.r_name AS department, CASE WHEN e.user_id % 3 <> 0 THEN coalesce(p.c_name, 'N/A') ELSE 'N/A' END AS submitted_by, e.event_type AS status, substring(e.props, 1, 300) AS diff_preview
    FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer p ON p.c_custkey = e.user_id"""

#: name: (query, SQL or None)
REGISTRY = {
    "section_split": (section_split, f"WITH {_sections_ctes('documents', 'text')} SELECT doc_id, ord, subtitle, content FROM sections"),
    "text_cleanup": (text_cleanup, f"WITH {_clean_ctes('documents')} SELECT doc_id, coalesce(cleaned, '') AS cleaned FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN cleaned USING (doc_id) UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL"),
    "cleanup_then_section": (cleanup_then_section, f"WITH {_clean_ctes('documents')}, {_sections_ctes('cleaned', 'cleaned')} SELECT doc_id, ord, subtitle, content FROM sections"),
    "section_tags": (section_tags, _TAGS_SQL),
    "edit_tags": (edit_tags, _EDIT_TAGS_SQL),
    "previous_version": (previous_version, _PAIRS_SQL),
    "positional_diff": (positional_diff, _POSITIONAL_SQL),
    "unified_diff": (unified_diff, f"WITH {_unified_sql('(SELECT conv_id AS section_id, turn AS version, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old, text AS new FROM conversations)', 'section_id, version')} SELECT * FROM diffs"),
    "unified_diff_edits": (unified_diff_edits, f"WITH {_unified_sql(_EDITED_SQL, 'conv_id')} SELECT * FROM diffs"),
    "history_with_current": (history_with_current, _HISTORY_SQL),
    "version_fold": (version_fold, _RETAGGED_SQL),
    "apply_approval": (apply_approval, _APPROVAL_SQL),
    "unified_diff_lines": (unified_diff_lines, _DIFF_LINES_SQL),
    "submit_revision": (submit_revision, _SUBMIT_SQL),
    "incremental_fold": (incremental_fold, _RETAGGED_SQL),
    "stored_files": (stored_files, _STORED_SQL),
    "unique_names": (unique_names, _UNIQUE_NAMES_SQL),
    "stored_model_tags": (stored_model_tags, _EDIT_TAGS_SQL),
    "access_anonymous": (access_anonymous, _SEEN("NULL")),
    "access_authenticated": (access_authenticated, _SEEN("3")),
    "access_staff": (access_staff, _SEEN("7")),
    "admin_departments": (admin_departments, f"WITH {_USERS} SELECT name, DATE '2020-01-01' AS created_at FROM d"),
    "admin_manuals": (admin_manuals, f"WITH {_USERS} SELECT id, title, department_id, uploaded_by_id FROM m WHERE uploaded_by_id IS NULL"),
    "admin_sections": (admin_sections, "SELECT l_returnflag AS subtitle, l_orderkey AS manual_id, l_linestatus AS tag, CASE WHEN l_linenumber > 1 THEN l_linenumber END AS page_number, l_linenumber AS \"order\" FROM lineitem WHERE l_linestatus = 'O'"),
    "admin_revisions": (admin_revisions, "SELECT event_id AS section_id, user_id AS submitted_by_id, event_type AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS submitted_at FROM events WHERE event_type = 'purchase'"),
    "uploaded_manuals": (uploaded_manuals, f"WITH {_USERS} SELECT id, title, department_id, NULL AS file, 1 AS version FROM m UNION ALL SELECT -1 - doc_id, source, n_chars % 25, 'manual-' || doc_id, 1 FROM documents WHERE source <> 'src1' AND source <> '' AND lang <> 'de' AND n_chars IS NOT NULL"),
    "reviewed_at": (reviewed_at, _REVIEWED_SQL),
    "json_rows": (json_rows, f"WITH {_USERS} SELECT '{{\"id\":' || id || ',\"title\":\"' || title || '\",\"uploaded_by_id\":' || coalesce(uploaded_by_id::VARCHAR, 'null') || ',\"version\":1}}' AS value FROM m"),
    "password_check": (password_check, "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'passwords do not match' WHEN length(substring(c_name, 1, (c_custkey % 12)::INT)) < 8 THEN 'password is shorter than 8 characters' END AS problem FROM customer"),
    "headed_cleanup": (headed_cleanup, f"WITH {_HEADED_SQL}, {_clean_ctes('headed')} SELECT doc_id, cleaned FROM cleaned UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL"),
    "headed_sections": (headed_sections, f"WITH {_HEADED_SQL}, {_clean_ctes('headed')}, {_sections_ctes('cleaned', 'cleaned')} SELECT doc_id, ord, subtitle, content FROM sections"),
    "text_source": (text_source, "SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE coalesce(text, '') END AS raw_text, coalesce(lang = 'de', false) AS failed FROM documents"),
    "upload_sections": (upload_sections, _UPLOAD_SQL),
    "edit_history": (edit_history, _EDIT_HISTORY_SQL),
    "manual_versions": (manual_versions, _MANUAL_VERSIONS_SQL),
    "pending_users": (pending_users, f"WITH {_USERS} SELECT u.id, username, email, coalesce(name, 'N/A') AS department {_JOINED} WHERE NOT is_approved"),
    "approved_users": (approved_users, f"WITH {_USERS} SELECT u.id, username, email, role, coalesce(name, 'N/A') AS department {_JOINED} WHERE is_approved"),
    "department_list": (department_list, f"WITH {_USERS} SELECT id, name FROM d"),
    "login_view": (login_view, f"WITH {_USERS} SELECT u.id, username, role, department_id, name AS department, is_approved AS allowed {_JOINED}"),
    "user_facets": (user_facets, f"WITH {_USERS} SELECT id, username, role FROM u WHERE is_approved AND role = 'admin'"),
    "manual_list": (manual_list, f"WITH {_USERS}, n AS (SELECT l_orderkey AS mid, count(*) AS c FROM lineitem GROUP BY 1) SELECT m.id, title, coalesce(d.name, 'N/A') AS department, coalesce(u.username, 'N/A') AS uploaded_by, strftime(uploaded_at, '%Y-%m-%d') AS uploaded_at, 1 AS version, coalesce(c, 0) AS sections FROM m LEFT JOIN d ON m.department_id = d.id LEFT JOIN u ON u.id = m.uploaded_by_id LEFT JOIN n ON n.mid = m.id"),
    "section_list": (section_list, f"WITH {_USERS} SELECT title AS manual, coalesce(d.name, 'N/A') AS department, l_partkey AS id, l_returnflag AS content, l_returnflag AS preview, l_linestatus AS tag, l_linenumber AS \"order\", 1 AS version FROM lineitem JOIN m ON l_orderkey = m.id LEFT JOIN d ON m.department_id = d.id WHERE m.id = 1"),
    "section_preview": (section_preview, "SELECT doc_id, substring(text, 1, 200) AS preview FROM documents"),
    "revision_list": (revision_list, _REVISIONS),
    "revision_list_by_status": (revision_list_by_status, f"{_REVISIONS} WHERE e.event_type = 'purchase'"),
    "access_filter": (access_filter, f"WITH {_USERS}, o AS (SELECT department_id, count(*) AS n FROM m GROUP BY 1) SELECT u.id, CASE WHEN is_staff THEN (SELECT count(*) FROM m) ELSE coalesce(n, 0) END AS may_list, coalesce(n, 0) AS may_upload FROM u LEFT JOIN o USING (department_id)"),
    "readable_manuals": (readable_manuals, f"WITH {_USERS} SELECT id, department_id FROM m WHERE department_id = 3"),
    "unique_check": (unique_check, "SELECT -s_suppkey AS id, s_name AS name, 'there' AS state FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'refused' ELSE 'there' END FROM supplier"),
    "point_lookup": (point_lookup, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7"),
    "type_dispatch": (type_dispatch, "SELECT page_id, lower(list_last(string_split(url, '.'))) AS ext FROM pages"),
    "file_kinds": (file_kinds, "WITH n AS (SELECT page_id, lower(list_last(string_split(url || ['.PDF', '.txt', '.b.JpEg', '.png', '.doc', ''][page_id % 6 + 1], '.'))) AS ext FROM pages) SELECT page_id, CASE WHEN ext = 'txt' THEN 'text' WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('jpg', 'jpeg', 'png') THEN 'image' END AS kind FROM n"),
    "revision_display": (revision_display, "SELECT event_id, upper(event_type[1]) || lower(event_type[2:]) AS label, upper(event_type) AS badge, strftime(ts, '%-m/%-d/%Y') AS day, CASE event_type WHEN 'purchase' THEN 'green' WHEN 'view' THEN 'blue' ELSE 'grey' END AS colour FROM events"),
    "shown_text": (shown_text, rf"SELECT conv_id, turn, array_to_string(list_filter(string_split(text || E'\n \nend', E'\n'), lambda x: trim(x, {_STRIP}) <> ''), '|') AS shown FROM conversations"),
    "register_users": (register_users, f"WITH {_USERS}, q AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 <> 0 THEN right(c_name, 2) ELSE '' END AS username, c_nationkey::bigint AS dep FROM customer), k AS (SELECT *, username <> '' AND username <> '07' AND row_number() OVER (PARTITION BY username ORDER BY id) = 1 AS ok FROM q) SELECT k.id, username, CASE WHEN ok THEN d.id END AS department_id, CASE WHEN ok THEN 'staff' END AS role, CASE WHEN ok THEN false END AS is_approved, CASE WHEN ok THEN 'made' ELSE 'refused' END AS state FROM k LEFT JOIN d ON k.dep = d.id"),
    "approve_user": (approve_user, f"WITH {_USERS} SELECT id, is_approved OR id = 5 AS is_approved FROM u"),
    "create_sections": (create_sections, _CREATE_SQL),
    "delete_manual": (delete_manual, f"WITH {_USERS}, l AS (SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM m WHERE uploaded_by_id = 4)) SELECT 'department' AS entity, n_nationkey::bigint AS id FROM nation UNION ALL SELECT 'user', id FROM u UNION ALL SELECT 'manual', id FROM m WHERE uploaded_by_id IS DISTINCT FROM 4 UNION ALL SELECT 'section', id FROM l UNION ALL SELECT 'section_history', id * 10 FROM l UNION ALL SELECT 'revision', id * 10 + 1 FROM l"),
    "delete_section": (delete_section, f"WITH {_USERS}, l AS (SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_linenumber <> 3) SELECT 'department' AS entity, n_nationkey::bigint AS id FROM nation UNION ALL SELECT 'user', id FROM u UNION ALL SELECT 'manual', id FROM m UNION ALL SELECT 'section', id FROM l UNION ALL SELECT 'revision', id * 10 + 1 FROM l"),
    "cascade_delete": (cascade_delete, f"WITH {_USERS} SELECT 'department' AS entity, count(*) AS n_rows, 0 AS n_nulls FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'user', count(*), count(*) FILTER (WHERE department_id = 3 OR department_id IS NULL) FROM u UNION ALL SELECT 'manual', count(*), count(*) FILTER (WHERE uploaded_by_id IS NULL) FROM m WHERE department_id <> 3 UNION ALL SELECT 'section', count(*), 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM m WHERE department_id = 3)"),
    "set_null_delete": (set_null_delete, f"WITH {_USERS} SELECT m.id, m.department_id, CASE WHEN u.department_id = 5 THEN NULL ELSE uploaded_by_id END AS uploaded_by_id FROM m LEFT JOIN u ON u.id = uploaded_by_id"),
    "review_status": (review_status, "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type IN ('purchase', 'view')) SELECT c_custkey AS id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'rejected' ELSE 'pending' END AS status, '' AS reviewer_notes FROM customer LEFT JOIN r ON user_id = c_custkey AND k = 1"),
}


def queries() -> dict:
    return {name: run for name, (run, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
