"""Text, cleaning, chunking and check queries over the driver's documents, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from govflow.functions import checks
from govflow.functions import text as T
from govflow.operators import chunking, cleaning, cleaning_report

QUERIES, ORACLE = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


PAGES = """pages_ AS (SELECT doc_id, unnest(range(1, len(lines) // 10 + CASE WHEN len(lines) % 10 > 0 THEN 2 ELSE 1 END)) AS page_no, lines FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
    doc_pages AS (SELECT doc_id, page_no::BIGINT AS page_no, array_to_string(lines[(page_no - 1) * 10 + 1 : page_no * 10], chr(10)) AS text FROM pages_)"""
LINES = f"{PAGES}, doc_lines AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM doc_pages)"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query("SELECT item_id, lower(translate(translate(text, 'aeo,', 'ａｅｏ，'), 'ａｅｏ，', 'aeo,')) AS folded FROM benchmark")
def fold_text(t):
    """Half-width, over items whose letters were widened first."""
    return t("benchmark").select("item_id", F.lower(T.fold(F.translate("text", "aeo,", "ａｅｏ，"))).alias("folded"))


@query("SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-.]*'))) AS n, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-.]*'))), ' ') AS terms FROM benchmark")
def query_terms(t):
    terms = T.query_terms(F.col("text"))
    return t("benchmark").select("item_id", F.size(terms).cast("long").alias("n"), F.array_join(F.array_sort(terms), " ").alias("terms"))


@query(f"WITH {PAGES} SELECT doc_id, page_no, doc_id::VARCHAR || ':' || page_no::VARCHAR || ':' || substring(sha1(text), 1, 12) AS chunk_key FROM doc_pages")
def chunk_keys(t):
    return chunking.pages_of(t("documents")).select("doc_id", "page_no", T.chunk_key(F.col("doc_id").cast("string"), F.col("page_no"), F.col("text")).alias("chunk_key"))


@query(f"WITH {LINES} SELECT key, count(*) AS n FROM (SELECT lower(regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '\\d+', '', 'g')) AS key FROM doc_lines) GROUP BY 1 HAVING count(*) > 1")
def repeat_key(t):
    lines = cleaning.lines_of(chunking.pages_of(t("documents")))
    return lines.groupBy(T.repeat_key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def level_counts(line: str) -> str:
    return f"""WITH {LINES} SELECT level, count(*) AS n FROM (SELECT (CASE
        WHEN regexp_matches(v, '^#{{1,6}}\\s+\\S.*$') THEN length(regexp_extract(v, '^#+'))
        WHEN regexp_matches(v, '^\\d+(\\.\\d+){{1,3}}\\s*\\S.*$') THEN least(6, 1 + greatest(1, length(regexp_replace(regexp_extract(v, '^[0-9.]*'), '[^.]', '', 'g'))))
        WHEN length(v) BETWEEN 2 AND 30 AND right(v, 1) NOT IN ('。', '！', '？', '；', '!', '?', ';', '…', ':', '：', '）', '】', '"', '”') AND NOT regexp_matches(v, '^\\d+(\\.\\d+)*[\\.、]?\\s*\\S.*$|^[（(][一二三四五六七八九十0-9]+[）)]\\s*.*$') THEN 6
        ELSE 0 END)::BIGINT AS level FROM (SELECT {STRIP.format(line)} AS v FROM doc_lines)) GROUP BY 1"""


@query(level_counts("CASE doc_id % 3 WHEN 0 THEN '## ' || text WHEN 1 THEN (doc_id % 9)::VARCHAR || '.2 ' || text ELSE text END"))
def heading_levels(t):
    """Over lines that a rule on the id turns into markdown headings or numbered ones, and whole lines as they are."""
    k = F.col("doc_id")
    line = F.when(k % 3 == 0, F.concat(F.lit("## "), F.col("text"))).when(k % 3 == 1, F.concat((k % 9).cast("string"), F.lit(".2 "), F.col("text"))).otherwise(F.col("text"))
    lines = cleaning.lines_of(chunking.pages_of(t("documents")))
    return lines.groupBy(T.heading_level(line).cast("long").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(level_counts("text"))
def heading_levels_plain(t):
    """Lines as they are."""
    lines = cleaning.lines_of(chunking.pages_of(t("documents")))
    return lines.groupBy(T.heading_level(F.col("text")).cast("long").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^。！？；!?;]*[。！？；!?;]|[^。！？；!?;]+$')) AS n FROM (SELECT doc_id, replace(text, '.', '!') AS text FROM documents)")
def sentence_counts(t):
    return t("documents").select("doc_id", F.size(T.sentences(F.translate("text", ".", "!"))).cast("long").alias("n"))


@query("SELECT item_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM benchmark")
def occurrence_counts(t):
    return t("benchmark").select("item_id", T.occurrences(F.col("text"), F.lit("the")).cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN length(v) > 200 THEN left(v, 199) || '…' ELSE v END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS v FROM documents)")
def snippets(t):
    return t("documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def behind(made_up):
    """Whole texts, with values behind them that a rule on the ids makes up."""
    return F.concat_ws("\n\n", "text", made_up)


@query(
    f"""WITH {PAGES}, made AS (SELECT doc_id, page_no, concat_ws(chr(10) || chr(10), text, (doc_id % 90)::VARCHAR || ' % and ' || (100 + page_no % 4 - doc_id % 90)::VARCHAR || '％' || chr(10) || chr(10) || 'alone 7%') AS text FROM doc_pages),
    paras AS (SELECT doc_id, page_no, unnest(string_split_regex(text, '\\n\\s*\\n')) AS p, generate_subscripts(string_split_regex(text, '\\n\\s*\\n'), 1) - 1 AS paragraph FROM made),
    found AS (SELECT doc_id, page_no, paragraph, list_transform(regexp_extract_all(p, '(\\d+(?:[.．]\\d+)?)\\s*[%％]', 1), lambda x: replace(x, '．', '.')::DECIMAL(38,10)) AS f FROM paras)
    SELECT doc_id, page_no, paragraph::BIGINT AS paragraph, list_sum(f)::DECIMAL(18,2) AS total, CASE WHEN abs(list_sum(f)::DECIMAL(18,2) - 100) <= 1 THEN 'pass' ELSE 'warn' END AS status FROM found WHERE len(f) >= 2"""
)
def percent_sum_check(t):
    k, p = F.col("doc_id"), F.col("page_no")
    values = F.concat((k % 90).cast("string"), F.lit(" % and "), (100 + p % 4 - k % 90).cast("string"), F.lit("％\n\nalone 7%"))
    found = checks.percent_sum(chunking.pages_of(t("documents")).withColumn("text", behind(values)))
    return found.withColumn("paragraph", F.col("paragraph").cast("long"))


@query(
    """WITH raws AS (SELECT doc_id, unnest(regexp_extract_all(concat_ws(chr(10) || chr(10), text, (1000 + doc_id % 50)::VARCHAR || ' and 1,0' || lpad((doc_id % 50)::VARCHAR, 2, '0')), '[0-9０-９][0-9０-９,，.．]*')) AS raw FROM documents),
    plains AS (SELECT DISTINCT doc_id, raw, replace(replace(translate(raw, '．０１２３４５６７８９', '.0123456789'), ',', ''), '，', '') AS plain FROM raws WHERE length(raw) >= 4),
    kinds AS (SELECT doc_id, plain, string_agg(raw, ' | ' ORDER BY raw) AS style FROM plains GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT doc_id, string_agg(style, '; ' ORDER BY plain) AS styles FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY plain) AS place FROM kinds) WHERE place <= 12 GROUP BY 1"""
)
def number_style_check(t):
    k = F.col("doc_id")
    values = F.concat((1000 + k % 50).cast("string"), F.lit(" and 1,0"), F.lpad((k % 50).cast("string"), 2, "0"))
    return checks.number_style(t("documents").select("doc_id", behind(values).alias("text")))


NUMBERS = r"""list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '\d{{1,3}}(?:[,，]\d{{3}})+(?:[.．]\d{{1,2}})?|\d+(?:[.．]\d{{1,2}})?'),
    lambda x: try_cast(replace(replace(replace(x, '．', '.'), ',', ''), '，', '') AS DECIMAL(38,10))), lambda x: x IS NOT NULL AND x <> 0), lambda x: regexp_replace(regexp_replace(x::VARCHAR, '(\.\d*?)0+$', '\1'), '\.$', '')))"""


@query(
    f"""WITH turns AS (SELECT conv_id, turn, concat_ws(chr(10) || chr(10), text, (conv_id + 5)::VARCHAR || '.50') AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations),
    told AS (SELECT conv_id, turn, {NUMBERS.format("answer")} AS own, {NUMBERS.format("source")} AS known FROM turns),
    lacking AS (SELECT conv_id, turn, own, list_sort(list_filter(own, lambda x: NOT list_contains(known, x))) AS missing FROM told)
    SELECT conv_id, turn, CASE WHEN len(own) = 0 THEN 'skip' WHEN len(missing) = 0 THEN 'pass' ELSE 'warn' END AS status, array_to_string(missing[1:20], ',') AS missing FROM lacking"""
)
def answer_numbers(t):
    """Each turn, with a number behind it, against the turn before."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    result = checks.traceable(behind(F.concat((F.col("conv_id") + 5).cast("string"), F.lit(".50"))), before)
    return t("conversations").select("conv_id", "turn", result["status"].alias("status"), F.array_join(result["missing"], ",").alias("missing"))


HEAD = "'Report ' || (doc_id % 5)::VARCHAR || ' page ' || page_no::VARCHAR || chr(10) || text || chr(10) || CASE WHEN page_no % 2 = 0 THEN 'Page ' || page_no::VARCHAR || ' of 9' ELSE '- ' || page_no::VARCHAR || ' -' END"
HEADED = f"{PAGES}, headed AS (SELECT doc_id, page_no, {HEAD} AS text FROM doc_pages), hl AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, len(string_split(text, chr(10))) AS lines FROM headed)"
TABLES = "|| chr(10) || 'a | b | c' || chr(10) || '--- | --- | ---' || chr(10) || 'and' || chr(10) || ' 1 | 2 | 3' || chr(10) || '4 | 5 | 6' || chr(10) || '7 | 8 | 9 '"
KEY = r"lower(regexp_replace(regexp_replace(text, '\s+', '', 'g'), '\d+', '', 'g'))"


def headed(t):
    """Pages between a header and a page number."""
    k, p = F.col("doc_id"), F.col("page_no")
    foot = F.when(p % 2 == 0, F.concat(F.lit("Page "), p.cast("string"), F.lit(" of 9"))).otherwise(F.concat(F.lit("- "), p.cast("string"), F.lit(" -")))
    head = F.concat(F.lit("Report "), (k % 5).cast("string"), F.lit(" page "), p.cast("string"))
    return chunking.pages_of(t("documents")).select("doc_id", "page_no", F.concat_ws("\n", head, "text", foot).alias("text"))


def unremoved(pages):
    """Pages that hold their lines, of which no rule has removed any. As a page stays one row, pages of a null id or of one
    that comes twice don't mix."""
    return pages.withColumn("lines", F.transform("lines", lambda x: x.withField("rule", F.lit(None).cast("string"))))


@query(
    f"""WITH {HEADED}, tab AS (SELECT *, length(regexp_replace(text, '[^|]', '', 'g')) >= 2 AS pipe FROM hl),
    runs AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, page_no, pipe ORDER BY line_no) AS run FROM tab),
    marked AS (SELECT *, pipe AND count(*) OVER (PARTITION BY doc_id, page_no, pipe, run) >= 3 AS tbl, {KEY} AS key, line_no < 2 OR line_no >= lines - 2 AS edge FROM runs),
    seen AS (SELECT doc_id, key, count(DISTINCT page_no) AS n FROM marked WHERE edge AND NOT tbl AND length(key) >= 4 GROUP BY 1, 2),
    total AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM marked WHERE length({STRIP.format("text")}) > 0 GROUP BY 1)
    SELECT m.doc_id, m.page_no, m.line_no::BIGINT AS line_no FROM marked m JOIN seen ON seen.doc_id = m.doc_id AND seen.key = m.key JOIN total ON total.doc_id = m.doc_id
    WHERE m.edge AND NOT m.tbl AND seen.n >= greatest(2, ceil(total.n * 0.5))"""
)
def clean_header_footer(t):
    rows = cleaning.spread(cleaning.repeated_edges(cleaning.tables(cleaning.held(headed(t)))))
    return rows.where("rule = 'c1'").select("doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"))


@query(
    f"""WITH {HEADED} SELECT doc_id, page_no, line_no::BIGINT AS line_no, try_cast(regexp_extract(v, '(?i)^page\\s+\\d+\\s+of\\s+(\\d+)$', 1) AS INTEGER) AS total_pages
    FROM (SELECT *, {STRIP.format("text")} AS v FROM hl) WHERE length(v) > 0 AND (regexp_matches(v, '^[-—–\\s]*\\d{{1,4}}[-—–\\s]*$') OR regexp_matches(v, '(?i)^page\\s+(\\d+)(\\s+of\\s+(\\d+))?$') OR regexp_matches(v, '^(\\d+)\\s*/\\s*(\\d+)$'))"""
)
def clean_page_numbers(t):
    lines = cleaning.tables(cleaning.lines_of(headed(t))).withColumn("rule", F.lit(None).cast("string"))
    return cleaning.page_numbers(lines).where("rule = 'c2'").select("doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"), "total_pages")


@query(f"""WITH {LINES} SELECT doc_id, page_no, line_no::BIGINT AS line_no, trim(regexp_replace('x' || text, '^x', '')) AS text FROM (SELECT doc_id, page_no, 2 * line_no AS line_no, text FROM doc_lines) WHERE length(trim(text)) > 0
    UNION ALL SELECT doc_id, page_no, 2 * line_no + 1, '' FROM doc_lines WHERE line_no = 0 OR length(trim(text)) > 0""")
def clean_whitespace(t):
    """Over lines that are set apart by wide spaces and doubled blank lines."""
    pages = chunking.pages_of(t("documents")).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    pages = pages.withColumn("text", F.concat("text", F.lit("\n")))
    held = unremoved(cleaning.held(pages)).withColumn("lines", F.transform("lines", lambda x: x.withField("table", F.lit(False))))
    rows = cleaning.spread(cleaning.white_space(held))
    return rows.where("rule is null").select("doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"), "text")


@query(f"""WITH {PAGES}, keys AS (SELECT doc_id, page_no, half, regexp_replace(text, '\\s+', '', 'g') AS key FROM (SELECT doc_id, page_no, 1 AS half, text FROM doc_pages UNION ALL SELECT doc_id, page_no, 2, text FROM doc_pages WHERE page_no % 3 = 0) WHERE length({STRIP.format("text")}) > 0)
    SELECT doc_id, count(*) AS duplicates FROM (SELECT doc_id, length(key) >= 20 AND row_number() OVER (PARTITION BY doc_id, key ORDER BY page_no, half) > 1 AS dup FROM keys) WHERE dup GROUP BY 1""")
def clean_dedupe(t):
    """Paragraphs that repeat: every third page is written twice."""
    body = F.regexp_replace("text", "\n\\s*(?=\n)", "")
    pages = chunking.pages_of(t("documents")).withColumn("text", F.when(F.col("page_no") % 3 == 0, F.concat(body, F.lit("\n\n"), body)).otherwise(body))
    found = cleaning.paragraphs(unremoved(cleaning.held(pages)))
    return found.where("duplicate").groupBy("doc_id").agg(F.count(F.lit(1)).alias("duplicates"))


@query(f"WITH {LINES} SELECT doc_id, page_no, line_no::BIGINT AS line_no, translate(text, 'a,e', 'a，e') AS text FROM doc_lines")
def clean_encoding(t):
    """Letters come back from full width, the comma of sentences doesn't."""
    lines = cleaning.lines_of(chunking.pages_of(t("documents"))).withColumn("text", F.translate("text", "a,e", "ａ，ｅ"))
    return cleaning.encoding(lines).select("doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"), "text")


@query(f"""WITH {LINES}, tab AS (SELECT *, length(regexp_replace(text, '[^|]', '', 'g')) >= 2 AS pipe FROM doc_lines),
    runs AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, page_no, pipe ORDER BY line_no) AS run FROM tab)
    SELECT doc_id, page_no, count(*) AS rows FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no, run) AS n FROM runs WHERE pipe) WHERE n >= 3 GROUP BY 1, 2""")
def table_rows(t):
    rows = cleaning.tables(cleaning.lines_of(chunking.pages_of(t("documents"))))
    return rows.where("table").groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("rows"))


TABLED = "'- ' || page_no::VARCHAR || ' -' || chr(10) || text || chr(10) || 'a | b | c' || chr(10) || '1 | 2 | 3' || chr(10) || '4 | 5 | 6' || chr(10) || 'end'"


@query(
    f"""WITH {PAGES}, tl AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM (SELECT doc_id, page_no, {TABLED} AS text FROM doc_pages)),
    live AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1 AS place FROM tl WHERE NOT (length({STRIP.format("text")}) > 0 AND (regexp_matches({STRIP.format("text")}, '^[-—–\\s]*\\d{{1,4}}[-—–\\s]*$') OR regexp_matches({STRIP.format("text")}, '(?i)^page\\s+(\\d+)(\\s+of\\s+(\\d+))?$') OR regexp_matches({STRIP.format("text")}, '^(\\d+)\\s*/\\s*(\\d+)$')))),
    tab AS (SELECT doc_id, page_no, place, place - row_number() OVER (PARTITION BY doc_id, page_no ORDER BY place) AS run FROM live WHERE length(regexp_replace(text, '[^|]', '', 'g')) >= 2)
    SELECT doc_id, page_no, min(place)::BIGINT AS start, max(place)::BIGINT AS "end", count(*) AS rows FROM tab GROUP BY doc_id, page_no, run HAVING count(*) >= 3"""
)
def clean_table_ranges(t):
    """Pages with a page number before their text and a table behind it."""
    text = F.concat(F.lit("- "), F.col("page_no").cast("string"), F.lit(" -\n"), "text", F.lit("\na | b | c\n1 | 2 | 3\n4 | 5 | 6\nend"))
    lines = cleaning.tables(cleaning.lines_of(chunking.pages_of(t("documents")).withColumn("text", text)))
    return cleaning.table_ranges(cleaning.page_numbers(lines.withColumn("rule", F.lit(None).cast("string"))))


@query(f"WITH {LINES} SELECT doc_id, page_no, line_no::BIGINT AS line_no, text FROM doc_lines")
def clean_disabled(t):
    rows = cleaning.clean(chunking.pages_of(t("documents")), enabled=False)
    return rows.where("rule is null and not table").select("doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"), "text")


WIDE, NARROW = ("".join(c for w, c in zip(T.FULL_WIDTH, x, strict=True) if w not in cleaning.KEPT_WIDE).replace("'", "''") for x in (T.FULL_WIDTH, T.HALF_WIDTH))
ENDS = f"strpos('{T.LINE_ENDS}', right({{0}}, 1)) > 0"
# The patterns hold braces, so they are set in after formatting.
BOUNDARY = " OR ".join(f"regexp_matches(here, '{p}')" for p in (T.HEADING, T.CHAPTER, T.SECTION, T.NUMBERED, T.CLAUSE, T.BULLET)) + f" OR length(here) BETWEEN 2 AND {T.SHORT_HEADING} AND NOT {ENDS.format('here')}"
NUMBER = " OR ".join(f"regexp_matches(v, '{p}')" for p in cleaning.PAGE_NUMBER)
TOTAL = ", ".join(f"nullif(regexp_extract(v, '{p}', {g}), '')" for p, g in zip(cleaning.PAGE_NUMBER[1:], (3, 2, 3), strict=True))
CLEANED = f"""{HEADED}, enc AS (SELECT doc_id, page_no, line_no::INTEGER AS line_no, lines, translate(text, '{WIDE}', '{NARROW}') AS text, length(regexp_replace(text, '[^�]', '', 'g')) AS lost_chars FROM hl),
    tab AS (SELECT *, {STRIP.format("text")} AS v, length(regexp_replace(text, '[^|]', '', 'g')) >= 2 AS pipe FROM enc),
    runs AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, page_no, pipe ORDER BY line_no) AS run, pipe AND regexp_matches(regexp_replace(text, '[|\\s]', '', 'g'), '^[-:+]*-[-:+]*$') AS ruled FROM tab),
    marked AS (SELECT *, pipe AND count(*) OVER p >= CASE WHEN bool_or(ruled) OVER p THEN 2 ELSE 3 END AS tbl, {KEY} AS key, line_no < 2 OR line_no >= lines - 2 AS edge FROM runs WINDOW p AS (PARTITION BY doc_id, page_no, pipe, run)),
    seen AS (SELECT doc_id, key, count(DISTINCT page_no) AS n FROM marked WHERE edge AND NOT tbl AND length(key) >= 4 GROUP BY 1, 2),
    total AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM marked WHERE v <> '' GROUP BY 1),
    numbered AS (SELECT m.*, CASE WHEN edge AND NOT tbl AND seen.n >= greatest(2, ceil(total.n * 0.5)) THEN 'c1' WHEN NOT tbl AND v <> '' AND ({NUMBER}) THEN 'c2' END AS rule, CASE WHEN NOT tbl THEN try_cast(coalesce({TOTAL}) AS INTEGER) END AS total_pages
        FROM marked m LEFT JOIN seen ON seen.doc_id = m.doc_id AND seen.key = m.key LEFT JOIN total ON total.doc_id = m.doc_id),
    befores AS (SELECT doc_id, page_no, line_no, text, v AS here, tbl, lag(v) OVER p AS before, lag(tbl) OVER p AS before_tbl FROM numbered WHERE rule IS NULL WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
    joints AS (SELECT *, before IS NOT NULL AND here <> '' AND before <> '' AND NOT tbl AND NOT before_tbl AND NOT {ENDS.format("before")} AND NOT ({BOUNDARY}) AS joined FROM befores),
    breaks AS (SELECT *, joined AND right(before, 1) IN ('-', '‐', '‑') AND regexp_matches(here, '^[a-z]') AS broken FROM joints),
    pieces AS (SELECT *, CASE WHEN broken THEN here ELSE text END AS piece, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER p AS run, coalesce(lead(broken) OVER p, false) AS falls FROM breaks WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
    parts AS (SELECT *, CASE WHEN joined AND NOT broken AND regexp_matches(right(lag(piece) OVER p, 1), '^[A-Za-z0-9,.]') AND regexp_matches(text, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || CASE WHEN falls THEN left(piece, length(piece) - 1) ELSE piece END AS part FROM pieces WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
    merged AS (SELECT doc_id, page_no, min(line_no) AS line_no, string_agg(part, '' ORDER BY line_no) AS whole FROM parts GROUP BY doc_id, page_no, run),
    spaced AS (SELECT n.*, whole IS NOT NULL AS live, {STRIP.format(f"translate(regexp_replace(whole, '{cleaning.NO_WIDTH}', '', 'g'), '{T.IDEOGRAPHIC_SPACE}', ' ')")} AS w FROM numbered n LEFT JOIN merged m ON m.doc_id = n.doc_id AND m.page_no = n.page_no AND m.line_no = n.line_no),
    squeezed AS (SELECT * EXCLUDE (w), text AS raw, CASE WHEN tbl THEN w ELSE regexp_replace(w, '[ \\t\\x0B\\f]{{3,}}', ' ', 'g') END AS w FROM spaced),
    cleaned AS (SELECT doc_id, page_no, line_no, CASE WHEN live THEN w ELSE text END AS text, tbl AS "table", lost_chars, CASE WHEN tbl THEN length(raw) END AS table_chars, total_pages, CASE WHEN live AND w = '' AND lag(w) OVER (PARTITION BY doc_id, page_no, live ORDER BY line_no) = '' THEN 'c3' WHEN live THEN NULL ELSE coalesce(rule, 'c4') END AS rule FROM squeezed)"""


@query(f"WITH {CLEANED} SELECT * FROM cleaned")
def clean_all(t):
    """All rules, with lines merged."""
    return cleaning.clean(headed(t))


@query(
    f"""WITH {CLEANED}, of_page AS (SELECT doc_id, page_no, coalesce(sum(length(text)) FILTER (rule IS NULL), 0) + greatest(count(*) FILTER (rule IS NULL) - 1, 0) AS after, count(*) FILTER (rule IS NOT NULL) AS removed, count(*) FILTER ("table") AS rows, sum(lost_chars) AS lost FROM cleaned GROUP BY 1, 2),
    sizes AS (SELECT doc_id, sum(length(text))::BIGINT AS chars_before FROM headed GROUP BY 1)
    SELECT doc_id, chars_before, sum(after)::BIGINT AS chars_after, sum(removed)::BIGINT AS removed_lines, sum(rows)::BIGINT AS table_lines, sum(lost)::BIGINT AS lost_chars, CASE WHEN chars_before = 0 THEN 0.0 ELSE round((chars_before - sum(after)) / chars_before, 4) END::DOUBLE AS removed_ratio
    FROM of_page JOIN sizes USING (doc_id) GROUP BY doc_id, chars_before"""
)
def clean_counters(t):
    pages = headed(t)
    return cleaning.counters(pages, cleaning.clean(pages))


# The same pages with two tables each, cleaned but for every fifth page.
REPORTED = CLEANED.replace(f"{HEAD} AS text", f"{HEAD} {TABLES} AS text").replace("FROM headed)", "FROM headed WHERE page_no % 5 > 0)")
REPORT = f"""{REPORTED}, of_page AS (SELECT doc_id, page_no, coalesce(sum(length(text)) FILTER (rule IS NULL), 0) + greatest(count(*) FILTER (rule IS NULL) - 1, 0) AS after, bool_or(rule IS NULL AND {STRIP.format("text")} <> '') AS filled, count(*) FILTER (rule IS NOT NULL) AS removed,
        count(*) FILTER (begins) AS blocks, sum(table_chars) AS chars, sum(lost_chars) AS lost, arg_max(total_pages, line_no) FILTER (total_pages > 0) AS total FROM (SELECT *, "table" AND coalesce(lag("table") OVER (PARTITION BY doc_id, page_no ORDER BY line_no), false) = false AS begins FROM cleaned) GROUP BY 1, 2),
    paras AS (SELECT *, sum(CASE WHEN {STRIP.format("text")} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS para FROM cleaned WHERE rule IS NULL),
    keys AS (SELECT doc_id, page_no, para, regexp_replace(string_agg(text, '' ORDER BY line_no), '\\s+', '', 'g') AS key FROM paras WHERE {STRIP.format("text")} <> '' GROUP BY 1, 2, 3),
    repeats AS (SELECT doc_id, count(*) AS duplicate_paragraphs FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY page_no, para) AS nth FROM keys WHERE length(key) >= 20) WHERE nth > 1 GROUP BY 1),
    of_doc AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (page_no % 5 > 0) AS pages_cleaned, count(*) FILTER (page_no % 5 = 0) AS pages_skipped, count(*) FILTER (page_no % 5 > 0 AND {STRIP.format("text")} <> '' AND NOT filled) AS pages_all_removed,
        sum(length(text))::BIGINT AS before_chars, sum(coalesce(after, length(text)))::BIGINT AS after_chars, coalesce(sum(removed), 0)::BIGINT AS removed_lines, coalesce(sum(blocks), 0)::BIGINT AS table_blocks, coalesce(sum(chars), 0)::BIGINT AS table_chars, coalesce(sum(lost), 0)::BIGINT AS replacement_chars, arg_max(total, page_no) AS total_pages
        FROM headed LEFT JOIN of_page USING (doc_id, page_no) GROUP BY 1)"""


def reported(t):
    """Pages with a header, a page number and two tables, whether they are cleaned, and their cleaned lines."""
    tables = "\na | b | c\n--- | --- | ---\nand\n 1 | 2 | 3\n4 | 5 | 6\n7 | 8 | 9 "
    pages, supported = headed(t).withColumn("text", F.concat("text", F.lit(tables))), F.col("page_no") % 5 > 0
    return pages, cleaning.clean(pages.where(supported)), supported


@query(f"""WITH {REPORT} SELECT of_doc.*, coalesce(duplicate_paragraphs, 0) AS duplicate_paragraphs, greatest(before_chars - after_chars, 0) AS removed_chars, CASE WHEN before_chars > 0 THEN floor(greatest(before_chars - after_chars, 0)::DOUBLE / before_chars * 10000 + 0.5) / 10000 ELSE 0 END AS removed_ratio FROM of_doc LEFT JOIN repeats USING (doc_id)""")
def clean_report(t):
    return cleaning_report.document_counters(*reported(t))


@query(f"WITH {REPORTED} SELECT doc_id, rule, count(*) AS lines FROM cleaned WHERE rule IS NOT NULL GROUP BY 1, 2")
def clean_rules_fired(t):
    return cleaning_report.rules_fired(reported(t)[1])


@query(f"""WITH {REPORTED}, places AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line_no) AS place, page_no, rule, text AS line FROM cleaned WHERE rule IS NOT NULL)
    SELECT d.doc_id, place, page_no, rule, line FROM (SELECT DISTINCT doc_id FROM headed) d JOIN places USING (doc_id) WHERE place <= 3""")
def clean_diff_samples(t):
    """The first removed lines as the diff's JSON holds them, read back from it."""
    diff = cleaning_report.cleaning_diff(*reported(t), samples=3, most=1_000_000)
    rows = F.from_json("content", "struct<removed_samples:array<struct<page_no:bigint,rule:string,line:string>>>")
    held = diff.select("doc_id", F.posexplode(rows["removed_samples"]).alias("place", "x"))
    return held.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "x.page_no", "x.rule", "x.line")


PACKED = f"""{PAGES}, paras AS (SELECT doc_id, page_no, list_filter(list_transform(string_split({STRIP.format("text")}, chr(10)), lambda x: {STRIP.format("x")}), lambda x: x <> '') AS p FROM doc_pages),
    packed AS (SELECT doc_id, page_no, list_reduce(list_transform(p, lambda x: [x]), lambda a, b: CASE WHEN length(a[-1]) + length(b[1]) > 500 THEN a || b ELSE a[:-2] || [a[-1] || chr(10) || b[1]] END) AS c FROM paras WHERE len(p) > 0),
    chunks AS (SELECT doc_id, page_no, unnest(c) AS text, generate_subscripts(c, 1)::BIGINT - 1 AS order_in_page FROM packed)"""


@query(f"WITH {PACKED} SELECT doc_id, page_no, order_in_page, doc_id::VARCHAR || ':' || page_no::VARCHAR || ':' || substring(sha1(text), 1, 12) AS chunk_key, text FROM chunks")
def chunk_legacy(t):
    chunks = chunking.plain_chunks(chunking.pages_of(t("documents")))
    return chunks.select("doc_id", "page_no", F.col("order_in_page").cast("long").alias("order_in_page"), "chunk_key", "text")


@query(f"WITH {PACKED} SELECT count(*) AS chunks, floor(avg(length(text)) + 0.5)::BIGINT AS mean_chars, max(length(text))::BIGINT AS max_chars, count(*) FILTER (length(text) > 500) AS over_limit, count(*) FILTER (order_in_page > 0) AS overlapped, count(DISTINCT (doc_id, page_no)) AS parents FROM chunks")
def chunk_counters(t):
    return chunking.counters(chunking.plain_chunks(chunking.pages_of(t("documents"))))


@query()
def chunk_improved(t):
    return chunking.structured_chunks(chunking.pages_of(t("documents")))


@query(
    """WITH RECURSIVE numbers AS (SELECT doc_id, unnest(range(1, (len(string_split(coalesce(text, ''), chr(10))) + 1) // 2 + 1))::BIGINT AS page_no FROM documents),
    heads AS (SELECT doc_id, page_no, level, repeat('#', level::INTEGER) || ' Part ' || page_no::VARCHAR AS head FROM (SELECT *, (doc_id * 7 + page_no * page_no * 3) % 5 + 1 AS level FROM numbers)),
    walk AS (SELECT doc_id, 1::BIGINT AS page_no, []::VARCHAR[] AS path FROM documents
        UNION ALL SELECT w.doc_id, h.page_no + 1, w.path[:h.level - 1] || [h.head] FROM walk w JOIN heads h ON h.doc_id = w.doc_id AND h.page_no = w.page_no)
    SELECT w.doc_id, w.page_no, array_to_string(path, ' > ') AS path, len(path) AS depth FROM walk w JOIN numbers n ON n.doc_id = w.doc_id AND n.page_no = w.page_no"""
)
def section_paths(t):
    """What is open where a page begins; every page of two lines gets a heading of some level."""
    pages, k, p = chunking.pages_of(t("documents"), page_lines=2), F.col("doc_id"), F.col("page_no")
    head = F.concat(F.repeat(F.lit("#"), ((k * 7 + p * p * 3) % 5 + 1).cast("int")), F.lit(" Part "), p.cast("string"))
    open_ = chunking.open_sections(pages.withColumn("text", F.concat_ws("\n", head, "text")))
    return open_.select("doc_id", "page_no", F.array_join("path", " > ").alias("path"), F.size("path").cast("long").alias("depth"))


@query(
    f"""WITH {PAGES}, tabled AS (SELECT doc_id, page_no, text {TABLES} AS text FROM doc_pages),
    tl AS (SELECT doc_id, page_no, {STRIP.format("unnest(string_split(text, chr(10)))")} AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM tabled),
    tab AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS run, regexp_matches(regexp_replace(text, '[|\\s]', '', 'g'), '^[-:+]*-[-:+]*$') AS ruled FROM tl WHERE length(regexp_replace(text, '[^|]', '', 'g')) >= 2),
    blocks AS (SELECT doc_id, page_no, count(*) AS n, length(string_agg(text, chr(10) ORDER BY line_no)) AS chars FROM tab GROUP BY doc_id, page_no, run HAVING count(*) >= 3 OR count(*) = 2 AND bool_or(ruled))
    SELECT count(*) AS table_chunks, sum(n)::BIGINT AS table_rows, max(chars)::BIGINT AS max_table_chars, 0::BIGINT AS over_limit, (SELECT count(*) FROM doc_pages) AS parents FROM blocks"""
)
def chunk_tables(t):
    """Tables among the chunks; two tables stand at the end of every page. The hard limit is out of reach, as SQL can follow
    whole tables but not how longer ones are packed in parts (``chunk_improved``)."""
    tables = "\n a | b | c\n--- | --- | ---\nand\n 1 | 2 | 3\n4 | 5 | 6\n7 | 8 | 9 "
    pages = chunking.pages_of(t("documents")).withColumn("text", F.concat("text", F.lit(tables)))
    most = 1_000_000
    counts = chunking.table_counters(chunking.structured_chunks(pages, chunking.Options(most=most)), most)
    return counts.select("table_chunks", "table_rows", "max_table_chars", "over_limit", "parents")
