"""Every registered query of the core, with its SQL where SQL can express it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.formats.markdown import html_to_markdown
from folioforge.formats.registry import PLAIN
from folioforge.functions import text as T
from folioforge.functions import urls as U
from folioforge.operators import convert, evaluation, layout, routing, tables
from folioforge.plans import documents
from folioforge.runtime import table
from folioforge.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """All sources, converted where their content is at hand, and why not where it isn't."""
    results = convert.convert(table(spark, folder, "documents_in"))
    return results.select("doc_id", "converter", "markdown", "title", convert.failure_message().alias("failure")).distinct()


# ---------------------------------------------------------------- routing and addresses

OOXML = "application/vnd.openxmlformats-officedocument."
ROUTE = f"""CASE
  WHEN extension = '.pdf' OR mimetype LIKE 'application/pdf%' OR mimetype LIKE 'application/x-pdf%' THEN 'pdf'
  WHEN extension = '.docx' OR mimetype LIKE '{OOXML}wordprocessingml.document%' THEN 'docx'
  WHEN extension = '.pptx' OR mimetype LIKE '{OOXML}presentationml.presentation%' THEN 'pptx'
  WHEN extension = '.xlsx' OR mimetype LIKE '{OOXML}spreadsheetml.sheet%' THEN 'xlsx'
  WHEN extension = '.epub' OR mimetype LIKE 'application/epub%' OR mimetype LIKE 'application/x-epub+zip%' THEN 'epub'
  WHEN extension = '.ipynb' THEN 'ipynb'
  WHEN extension IN ('.pages', '.key', '.numbers') THEN 'iwork'
  WHEN regexp_matches(url, '^https?://(github\\.com|www\\.github\\.com|gist\\.github\\.com)(:[0-9]+)?/[^/?#]') THEN 'github'
  WHEN regexp_matches(url, '^https?://([a-z]{{2,3}}\\.)?wikipedia\\.org/') THEN 'wikipedia'
  WHEN extension IN ('.rss', '.atom', '.xml') OR mimetype LIKE 'application/rss%' OR mimetype LIKE 'application/atom%' OR mimetype LIKE 'text/xml%' OR mimetype LIKE 'application/xml%' THEN 'rss'
  WHEN extension IN ('.csv', '.tsv') OR mimetype LIKE 'text/csv%' OR mimetype LIKE 'text/tab-separated-values%' THEN 'csv'
  WHEN extension = '.json' OR mimetype LIKE 'application/json%' THEN 'json'
  WHEN extension IN ('.yaml', '.yml') OR mimetype LIKE 'text/yaml%' OR mimetype LIKE 'application/x-yaml%' THEN 'yaml'
  WHEN extension IN ('.jpg', '.jpeg', '.png', '.gif', '.webp', '.tiff', '.tif', '.bmp', '.svg') OR mimetype LIKE 'image/%' THEN 'image'
  WHEN extension IN ('.mp3', '.wav', '.m4a', '.mp4', '.ogg', '.flac', '.aac', '.wma') OR mimetype LIKE 'audio/%' OR mimetype = 'video/mp4' THEN 'audio'
  WHEN extension = '.zip' OR mimetype LIKE 'application/zip%' OR mimetype LIKE 'application/x-zip-compressed%' THEN 'zip'
  WHEN extension IN ('.xml', '.svg') THEN 'xml'
  WHEN extension IN ('.html', '.htm') OR mimetype LIKE 'text/html%' OR mimetype LIKE 'application/xhtml%' THEN 'html'
  WHEN extension IN ({", ".join(f"'{e}'" for e in PLAIN.split())}) OR mimetype LIKE 'text/%' OR (extension IS NULL AND mimetype IS NULL) THEN 'plain-text' END"""


@query(f"SELECT doc_id, received_at, {ROUTE} AS route FROM documents_in")
def route_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The first converter that takes each source."""
    return routing.routed(table(spark, folder, "documents_in")).select("doc_id", "received_at", "route")


@query(f"SELECT route, count(*) AS sources, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, {ROUTE} AS route FROM documents_in) GROUP BY route")
def route_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sources and documents by route."""
    return routing.routed(table(spark, folder, "documents_in")).groupBy("route").agg(F.count("*").alias("sources"), F.count_distinct("doc_id").alias("documents"))


@query(
    """WITH p AS (SELECT doc_id, received_at, url, regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', 3) AS raw FROM documents_in WHERE url IS NOT NULL),
    q AS (SELECT *, CASE WHEN raw = '' THEN '/' ELSE raw END AS path FROM p)
    SELECT doc_id, received_at, path, regexp_extract(path, '([^/]*)$', 1) AS basename, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\\.[^.]*)$', 1)) AS extension,
    nullif(regexp_extract(url, '^(https?://[^/?#]*)/?(?:[?#].*)?$', 1), '') AS root_origin FROM q"""
)
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of addresses."""
    u = F.col("url")
    return table(spark, folder, "documents_in").where("url is not null").select("doc_id", "received_at", U.path(u).alias("path"), U.basename(u).alias("basename"), U.extension(u).alias("extension"), U.root_origin(u).alias("root_origin"))


@query(
    """SELECT DISTINCT doc_id, href, CASE WHEN href LIKE 'https://%' THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^(https?):', 1) || ':' || href
    WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]*)', 1) || href
    ELSE regexp_extract(url, '^(https?://[^/]*)', 1) || CASE WHEN regexp_extract(url, '^https?://[^/]*(.*)$', 1) LIKE '%/%' THEN regexp_extract(regexp_extract(url, '^https?://[^/]*(.*)$', 1), '^(.*/)[^/]*$', 1) ELSE '/' END || regexp_replace(href, '^\\./', '') END AS resolved
    FROM documents_in, (SELECT unnest(['https://a.example/x', '//b.example/y', '/c/d.md', './e.md', 'f/g.md']) AS href) WHERE url IS NOT NULL"""
)
def resolved_links(spark: SparkSession, folder: str) -> DataFrame:
    """U4: links as seen from each page."""
    hrefs = F.explode(F.array(*map(F.lit, ("https://a.example/x", "//b.example/y", "/c/d.md", "./e.md", "f/g.md"))))
    rows = table(spark, folder, "documents_in").where("url is not null").select("doc_id", "url", hrefs.alias("href"))
    return rows.select("doc_id", "href", U.resolved(F.col("href"), F.col("url")).alias("resolved")).distinct()


@query(
    """SELECT DISTINCT doc_id, CASE WHEN length(url) % 3 = 0 THEN regexp_extract(url, '^(https?://[^/]*)', 1) || '/raw/' || doc_id || '.md'
    WHEN length(url) % 3 = 1 AND NOT regexp_matches(regexp_extract(regexp_extract(url, '^(https?)://([^/?#]*)([^?#]*)', 3), '([^/]*)$', 1), '\\.[^.]*$') THEN regexp_replace(url, '/$', '') || '.md' END AS source
    FROM documents_in WHERE url IS NOT NULL"""
)
def markdown_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Where the Markdown of a page is to be had."""
    html = (
        F.when(F.length("url") % 3 == 0, F.concat(F.lit('<html><LINK class="x" rel="alternate" type="text/markdown" href="/raw/'), "doc_id", F.lit('.md"></html>')))
        .when(F.length("url") % 3 == 1, F.lit('<div id="VPContent"></div>'))
        .otherwise(F.lit("<p>plain</p>"))
    )
    return table(spark, folder, "documents_in").where("url is not null").select("doc_id", U.markdown_source(html, F.col("url")).alias("source")).distinct()


@query("SELECT lower(trim(split_part(mimetype, ';', 1))) AS media_type, count(*) AS n FROM documents_in GROUP BY 1")
def media_types(spark: SparkSession, folder: str) -> DataFrame:
    """Media types without parameters."""
    return table(spark, folder, "documents_in").groupBy(U.media_type(F.col("mimetype")).alias("media_type")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, received_at, sha256(content) AS digest, octet_length(content) AS bytes FROM documents_in WHERE content IS NOT NULL")
def content_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of what was received."""
    return table(spark, folder, "documents_in").where("content is not null").select("doc_id", "received_at", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("bigint").alias("bytes"))


@query()
def converted_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every source with content, converted."""
    sources = table(spark, folder, "documents_in").where("content is not null")
    return convert.convert(sources).select("doc_id", "converter", "markdown", "title", convert.failure_message().alias("failure")).distinct()


@query("SELECT DISTINCT doc_id FROM documents_in WHERE content IS NULL")
def sources_without_content(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that report what is missing instead of failing the job."""
    sources = table(spark, folder, "documents_in").where("content is null")
    return convert.convert(sources).where("markdown is null and size(errors) = 1").select("doc_id").distinct()


# ---------------------------------------------------------------- text

@query("SELECT doc_id, converted_at, md5(trim(regexp_replace(markdown, '[\\s\\p{Z}]+', ' ', 'g'))) AS digest, length(markdown) AS chars FROM documents_out WHERE markdown IS NOT NULL")
def normalized_text(spark: SparkSession, folder: str) -> DataFrame:
    """Text with single spaces."""
    rows = table(spark, folder, "documents_out").where("markdown is not null")
    return rows.select("doc_id", "converted_at", F.md5(T.one_space(F.col("markdown"))).alias("digest"), F.length("markdown").cast("bigint").alias("chars"))


@query(f"SELECT doc_id, converted_at, md5(translate(markdown, '{T.WIDE}', '{T.NARROW.replace(chr(39), chr(39) * 2)}')) AS digest FROM documents_out WHERE markdown IS NOT NULL")
def half_width_text(spark: SparkSession, folder: str) -> DataFrame:
    """Full-width forms as plain ones."""
    return table(spark, folder, "documents_out").where("markdown is not null").select("doc_id", "converted_at", F.md5(T.half_width(F.col("markdown"))).alias("digest"))


PLAIN_FORM = f"translate(translate(text, '\ue000\ue001\ue002\ue003', ''), '{T.WIDE}', '{T.NARROW.replace(chr(39), chr(39) * 2)}')"


@query(
    f"""SELECT doc_id, page_number, seq, text, replace(replace(replace(replace(replace(plain, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(10), '<br>') AS html, replace(replace(plain, '|', '\\|'), chr(10), '<br>') AS cell
    FROM (SELECT *, {PLAIN_FORM} AS plain FROM (SELECT DISTINCT * FROM text_boxes))"""
)
def table_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Text for cells."""
    rows = table(spark, folder, "text_boxes").distinct()
    return rows.select("doc_id", "page_number", "seq", "text", T.html_cell(F.col("text")).alias("html"), T.cell(F.col("text")).alias("cell"))


@query(
    r"""WITH p AS (SELECT doc_id, converted_at, string_split(markdown, '-' || chr(10) || chr(10)) AS parts FROM documents_out WHERE markdown IS NOT NULL)
    SELECT doc_id, converted_at, md5(list_reduce(parts, lambda a, b: CASE WHEN regexp_matches(a, '[\p{L}\p{Nl}]$') AND regexp_matches(b, '^\p{Ll}') THEN a || CASE WHEN regexp_matches(a, '-[^\s\p{Z}]*$') THEN '-' ELSE '' END || b ELSE a || '-' || chr(10) || chr(10) || b END)) AS digest FROM p"""
)
def dehyphenated_text(spark: SparkSession, folder: str) -> DataFrame:
    """Words broken over blocks, compounds with their hyphen."""
    rows = table(spark, folder, "documents_out").where("markdown is not null")
    return rows.select("doc_id", "converted_at", F.md5(T.dehyphenated(F.col("markdown"))).alias("digest"))


# ---------------------------------------------------------------- pages

BOXES = "b AS (SELECT DISTINCT * REPLACE (trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS text) FROM (SELECT DISTINCT * FROM text_boxes)), bx AS (SELECT * FROM b WHERE text <> '')"
OUTER = "((y_top + y_bottom) / 2 >= page_height - 0.12 * page_height OR (y_top + y_bottom) / 2 <= 0.12 * page_height)"
HEADS = f"""{BOXES}, g AS (SELECT DISTINCT doc_id, page_number, page_height FROM page_geometry),
    o AS (SELECT DISTINCT doc_id, text, page_number FROM bx JOIN g USING (doc_id, page_number) WHERE {OUTER}),
    r AS (SELECT doc_id, text, page_number - row_number() OVER (PARTITION BY doc_id, text ORDER BY page_number) AS island FROM o),
    t AS (SELECT doc_id, text, sum(n)::BIGINT AS pages, max(n) AS longest FROM (SELECT doc_id, text, island, count(*) AS n FROM r GROUP BY ALL) GROUP BY doc_id, text),
    s AS (SELECT doc_id, count(DISTINCT page_number) AS n FROM g GROUP BY doc_id),
    heads AS (SELECT doc_id, text, pages, longest FROM t JOIN s USING (doc_id) WHERE n >= 5 AND (pages >= greatest(3, n // 5) OR longest >= 8))"""
# Box by box down each page: a line ends where the next middle lies more than 3 below that of its first box.
LINES = f"""{BOXES}, q AS (SELECT *, (y_top + y_bottom) / 2 AS mid, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY (y_top + y_bottom) / 2 DESC, x_left, seq) AS k FROM bx),
    w AS (SELECT doc_id, page_number, k, mid AS mark, 0::BIGINT AS line FROM q WHERE k = 1
      UNION ALL SELECT q.doc_id, q.page_number, q.k, CASE WHEN w.mark - q.mid > 3.0 THEN q.mid ELSE w.mark END, w.line + (w.mark - q.mid > 3.0)::BIGINT FROM w JOIN q ON q.doc_id = w.doc_id AND q.page_number = w.page_number AND q.k = w.k + 1),
    n AS (SELECT q.*, w.line, x_left - lag(x_right) OVER (PARTITION BY q.doc_id, q.page_number, w.line ORDER BY x_left, seq) AS space FROM q JOIN w USING (doc_id, page_number, k)),
    ln AS (SELECT doc_id, page_number, line, string_agg(text, ' ' ORDER BY x_left, seq) AS text, arg_min(mid, (x_left, seq)) AS top, max(font_size) AS font_size, bool_or(is_bold) AS is_bold, coalesce(max(space) > 30.0, false) AS is_tabular FROM n GROUP BY ALL)"""
BODY = """sz AS (SELECT DISTINCT doc_id, page_number, seq, round(font_size, 1) AS size FROM text_boxes), c AS (SELECT doc_id, page_number, size, count(*) AS n, min(seq) AS first FROM sz WHERE size > 0 GROUP BY ALL),
    body AS (SELECT doc_id, page_number, size AS body FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY size < 7, n DESC, first) = 1)"""
MARK = "CASE WHEN font_size / body >= 2 THEN '# ' WHEN font_size / body >= 1.4 THEN '## ' WHEN font_size / body >= 1.1 AND is_bold THEN '### ' ELSE '' END"
MARKED = f"m AS (SELECT *, {MARK} AS mark FROM ln LEFT JOIN body USING (doc_id, page_number))"


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "text_boxes")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_geometry")


@query(f"WITH {HEADS} SELECT doc_id, text, pages, longest FROM heads")
def running_heads(spark: SparkSession, folder: str) -> DataFrame:
    """A5: texts that recur in the margins of a document's pages."""
    return layout.running_heads(_boxes(spark, folder), _pages(spark, folder))


@query(
    f"""WITH {HEADS}, x AS (SELECT bx.* , page_height FROM bx JOIN g USING (doc_id, page_number))
    SELECT doc_id, page_number, count(*) AS boxes FROM x WHERE NOT ({OUTER} AND EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = x.doc_id AND h.text = x.text)) GROUP BY ALL"""
)
def boxes_without_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes left on each page."""
    return layout.without_heads(_boxes(spark, folder), _pages(spark, folder)).groupBy("doc_id", "page_number").agg(F.count("*").alias("boxes"))


@query(f"WITH {BODY} SELECT doc_id, page_number, body FROM body")
def modal_size(spark: SparkSession, folder: str) -> DataFrame:
    """The commonest type size of each page."""
    return layout.modal_size(_boxes(spark, folder))


@query("WITH s AS (SELECT doc_id, page_number, font_size, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY font_size) - 1 AS k, count(*) OVER (PARTITION BY doc_id, page_number) AS n FROM (SELECT DISTINCT * FROM text_boxes) WHERE font_size > 0) SELECT doc_id, page_number, font_size AS median FROM s WHERE k = n // 2")
def median_size(spark: SparkSession, folder: str) -> DataFrame:
    """The upper median of each page's type sizes."""
    return layout.median_size(_boxes(spark, folder))


@query(f"WITH RECURSIVE {LINES} SELECT doc_id, page_number, line, text, top, font_size, is_bold, is_tabular FROM ln")
def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes as lines."""
    return layout.lines(_boxes(spark, folder))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    boxes = _boxes(spark, folder)
    return layout.headings(layout.lines(boxes), layout.modal_size(boxes))


@query(f"WITH RECURSIVE {LINES}, {BODY}, {MARKED} SELECT doc_id, page_number, line, text, mark FROM m WHERE mark <> ''")
def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are headings."""
    return _marked(spark, folder).where("mark <> ''").select("doc_id", "page_number", "line", "text", "mark")


@query(
    f"""WITH RECURSIVE {LINES}, {BODY}, {MARKED}, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line) AS j FROM m),
    h AS (SELECT doc_id, page_number, j, line, mark, text, top AS head_top, line AS heading FROM e WHERE j = 1
      UNION ALL SELECT e.doc_id, e.page_number, e.j, e.line, e.mark, e.text, CASE WHEN e.mark = h.mark AND h.head_top - e.top <= greatest(3 * e.body, 30.0) THEN h.head_top ELSE e.top END,
      CASE WHEN e.mark = h.mark AND h.head_top - e.top <= greatest(3 * e.body, 30.0) THEN h.heading ELSE e.line END FROM h JOIN e ON e.doc_id = h.doc_id AND e.page_number = h.page_number AND e.j = h.j + 1)
    SELECT doc_id, page_number, heading, mark, string_agg(text, ' ' ORDER BY line) AS text FROM h WHERE mark <> '' GROUP BY ALL"""
)
def merged_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings set over several lines."""
    return layout.merged_headings(_marked(spark, folder))


@query(f"WITH RECURSIVE {LINES} SELECT doc_id, page_number, md5(string_agg(text, chr(10) ORDER BY line)) AS digest, count(*) AS lines FROM ln GROUP BY ALL")
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages put together from their lines."""
    rows = layout.lines(_boxes(spark, folder))
    return layout.page_text(rows).select("doc_id", "page_number", F.md5("text").alias("digest"), (F.regexp_count("text", F.lit("\n")) + 1).cast("bigint").alias("lines"))


@query(
    f"""WITH {BOXES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y_top, seq DESC) AS k FROM bx)
    SELECT doc_id, page_number, seq, text FROM k WHERE k <= 3 AND y_top <= 120 AND regexp_replace(text, '^[\\s—-]+|[\\s—-]+$', '', 'g') = page_number::varchar"""
)
def foot_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Page numbers at the foot."""
    return layout.foot_numbers(_boxes(spark, folder)).select("doc_id", "page_number", "seq", "text")


# The rules of single lines in SQL, written apart from the Columns of functions.text.
CHROME_SQL = r"""(p <> '' AND (
      contains(l, 'http://') OR contains(l, 'https://') OR starts_with(l, 'www.') OR contains(l, ' www.') OR contains(l, 'doi:') OR contains(l, 'doi.org/') OR contains(l, 'dx.doi.org')
      OR contains(l, 'please cite this article') OR contains(l, 'contents lists available at') OR contains(l, 'available online at') OR contains(l, 'downloaded from')
      OR contains(p, '©') OR contains(l, 'copyright ') OR contains(l, 'all rights reserved') OR regexp_matches(l, '^page [0-9]') OR regexp_full_match(p, '[0-9]{1,4}')
      OR (strlen(l) BETWEEN 2 AND 7 AND regexp_full_match(l, 'm{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})'))
      OR regexp_matches(l, '(^|[^a-z0-9])vol(ume)?[., ].*[0-9]') OR regexp_matches(l, '(^|[^a-z0-9])[vn][.] ?[0-9]')
      OR (strlen(p) <= 80 AND contains(l, 'et al'))
      OR (strlen(p) <= 120 AND regexp_matches(l, '(^|[^a-z0-9])(19|20)[0-9][0-9]($|[^a-z0-9])') AND (regexp_matches(p, '[0-9]:[0-9]') OR len(list_filter(regexp_extract_all(p, '[0-9]+ *[-–—] *[0-9]+'), lambda r: NOT regexp_full_match(r, '(19|20)[0-9][0-9] *[-–—] *[0-9]{1,2}'))) > 0))
      OR (strlen(p) <= 120 AND regexp_matches(p, '[(](19|20)[0-9][0-9][)][.]? *[0-9]+, *[0-9]+'))
      OR (strlen(p) <= 30 AND (regexp_full_match(p, '[0-9]{1,2}[.]? +\p{L}+[.]? +(19|20)[0-9][0-9][.]?') OR regexp_full_match(p, '\p{L}+ +[0-9]{1,2}, +(19|20)[0-9][0-9][.]?')))))""".replace("\\\\", "\\")
STRIPPED = "regexp_replace(translate(text, '\ue000\ue001\ue002\ue003', ''), '^[\\s\\p{Z}|•·▪–—_=~*-]+|[\\s\\p{Z}|•·▪–—_=~*-]+$', '', 'g')"


@query(f"WITH {BOXES}, s AS (SELECT *, {STRIPPED} AS p, lower({STRIPPED}) AS l FROM bx) SELECT doc_id, page_number, seq, text FROM s WHERE {CHROME_SQL}")
def chrome_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that look like furniture."""
    return layout.chrome(_boxes(spark, folder)).select("doc_id", "page_number", "seq", "text")


@query()
def page_chrome(spark: SparkSession, folder: str) -> DataFrame:
    """Furniture of single pages, by place, distance and wording."""
    return layout.page_chrome(_boxes(spark, folder), _pages(spark, folder))


@query(
    """WITH i AS (SELECT DISTINCT * FROM raw_items), r AS (SELECT *, x + coalesce(width, 0.0) AS rgt FROM i),
    s AS (SELECT *, coalesce((lag(y) OVER w - y > 2.0)::int, 0) AS step FROM r WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y DESC, x, item_no)),
    l AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, page_number ORDER BY y DESC, x, item_no) AS line FROM s),
    g AS (SELECT *, x - lag(rgt) OVER (PARTITION BY doc_id, page_number, line ORDER BY x, item_no) AS gap FROM l),
    n AS (SELECT *, CASE WHEN gap IS NULL OR gap > least(greatest(0.6 * font_size, 6.0), 14.0) THEN 1 ELSE 0 END AS new FROM g),
    w AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id, page_number ORDER BY line, x, item_no))::BIGINT AS word FROM n)
    SELECT doc_id, page_number, word, string_agg(CASE WHEN new = 0 AND gap > 0.1 * font_size THEN ' ' ELSE '' END || text, '' ORDER BY x, item_no) AS text, min(x) AS x_left, max(rgt) AS x_right FROM w GROUP BY ALL"""
)
def merged_items(spark: SparkSession, folder: str) -> DataFrame:
    """A1: fragments merged into runs of text."""
    return layout.words(table(spark, folder, "raw_items"))


@query(
    """WITH b AS (SELECT DISTINCT doc_id, page_number, x_left, x_right FROM text_boxes), m AS (SELECT *, max(x_right) OVER (PARTITION BY doc_id, page_number ORDER BY x_left, x_right ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
    i AS (SELECT *, (sum(CASE WHEN before IS NULL OR x_left > before + 10.0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY x_left, x_right ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS island FROM m)
    SELECT doc_id, page_number, island, min(x_left) AS low, max(x_right) AS high FROM i GROUP BY ALL"""
)
def width_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Extents of text across each page."""
    return layout.islands(_boxes(spark, folder).select("doc_id", "page_number", "x_left", "x_right").distinct(), ["doc_id", "page_number"], "x_left", "x_right")


@query("SELECT DISTINCT i.doc_id, i.page_number, i.item_no, b.id FROM raw_items i JOIN text_boxes b ON i.doc_id = b.doc_id AND i.page_number = b.page_number AND i.x BETWEEN b.x_left AND b.x_right AND i.y BETWEEN b.y_bottom AND b.y_top")
def items_in_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The boxes in which fragments lie."""
    return layout.placed(table(spark, folder, "raw_items"), _boxes(spark, folder))


@query(
    """WITH i AS (SELECT DISTINCT doc_id, page_number, item_no, x, y FROM raw_items), b AS (SELECT DISTINCT * FROM text_boxes),
    m AS (SELECT i.doc_id, i.page_number, i.item_no, b.id, round(greatest(b.y_bottom - i.y, i.y - b.y_top, 0.0), 4) AS distance, NOT (i.x BETWEEN b.x_left AND b.x_right) AS beside, b.seq FROM i JOIN b ON i.doc_id = b.doc_id AND i.page_number = b.page_number)
    SELECT doc_id, page_number, item_no, id, distance FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, item_no ORDER BY beside, distance, seq) = 1"""
)
def nearest_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The box nearest to each fragment."""
    return layout.nearest(table(spark, folder, "raw_items"), _boxes(spark, folder))


@query(
    """WITH c AS (SELECT DISTINCT doc_id, page_number, seq AS r, floor(x_left / 100) AS col, trim(text) AS t FROM text_boxes), z AS (SELECT doc_id, page_number, count(DISTINCT r) AS rows, count(DISTINCT col) AS columns, count(*) FILTER (t <> '') AS f FROM c GROUP BY ALL),
    u AS (SELECT doc_id, page_number, t, count(*) AS n, count(DISTINCT col) > 1 AS across FROM c WHERE strlen(t) > 3 GROUP BY ALL), v AS (SELECT doc_id, page_number, sum(n) AS s, sum(n) - count(*) AS dups, coalesce(sum(n) FILTER (across), 0) AS x FROM u GROUP BY ALL),
    a AS (SELECT z.*, f / (rows * columns) AS fill, CASE WHEN coalesce(s, 0) > 2 THEN least(dups, x) / s ELSE 0.0 END AS dup FROM z LEFT JOIN v USING (doc_id, page_number))
    SELECT doc_id, page_number, rows, columns, round(fill, 6) AS filled, round(dup, 6) AS repeated, columns > 25 OR fill < 0.25 OR (fill < 0.5 AND dup > 0.3) OR (dup > 0.4 AND columns >= 6) OR (fill < 0.4 AND columns >= 6) AS is_diagram FROM a"""
)
def grid_fill(spark: SparkSession, folder: str) -> DataFrame:
    """G11, AG6: how full grids are."""
    cells = _boxes(spark, folder).select("doc_id", "page_number", F.col("seq").alias("r"), F.floor(F.col("x_left") / 100).alias("col"), "text").distinct()
    return layout.fill(cells, ["doc_id", "page_number"], "r", "col", "text").withColumns({c: F.round(c, 6) for c in ("filled", "repeated")})


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY item_no) - 1 AS k FROM (SELECT DISTINCT doc_id, page_number, item_no, width, font_size FROM raw_items) WHERE trunc(coalesce(width, 0)) * trunc(font_size) >= 500) SELECT doc_id, page_number, item_no, 'p' || page_number || '-i' || k AS id FROM f")
def sized_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of some size, numbered on their page."""
    rows = table(spark, folder, "raw_items").select("doc_id", "page_number", "item_no", "width", "font_size").distinct()
    return layout.sized_regions(rows, F.col("width"), F.col("font_size"), "item_no", 500).select("doc_id", "page_number", "item_no", "id")


@query("SELECT n_regionkey, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey")
def markdown_tables(spark: SparkSession, folder: str) -> DataFrame:
    """C4, C11: rows as Markdown tables."""
    return layout.markdown_table(table(spark, folder, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"])


@query(
    """WITH t AS (SELECT n_regionkey, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS m FROM nation GROUP BY n_regionkey)
    SELECT string_agg('## ' || r_name || chr(10) || chr(10) || m, chr(10) || chr(10) ORDER BY r_regionkey) AS markdown FROM t JOIN region ON n_regionkey = r_regionkey"""
)
def sheets(spark: SparkSession, folder: str) -> DataFrame:
    """C4, C3, AG7: titled tables put together in order."""
    tables = markdown_tables(spark, folder).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return layout.sections(tables, [], ["r_regionkey"], F.col("r_name"), F.col("markdown"))


def _escaped(x: str) -> str:
    """The SQL of a line's text as Markdown shows it, rule by rule."""
    for kind, what, by in (("replace", "\\", "\\\\"), ("replace", "*", "\\*"), ("first", "^-", "\\\\-"), ("first", "^\\+ ", "\\\\+ "), ("first", "^(=+)", "\\\\\\1"), ("first", "^(#{1,6}) ", "\\\\\\1 "), ("replace", "`", "\\`"), ("first", "^~~~", "\\\\~~~"), ("replace", "[", "\\["), ("replace", "]", "\\]"), ("first", "^>", "\\\\>"), ("replace", "_", "\\_"), ("first", "^([0-9]+)\\. ", "\\1\\\\. ")):
        x = f"{'replace' if kind == 'replace' else 'regexp_replace'}({x}, '{what}', '{by}')"
    return x


LINE = _escaped("trim(regexp_replace(x, '[ \\r\\n\\t]+', ' ', 'g'), ' ')")


@query(
    f"""WITH t AS (SELECT doc_id, source, regexp_split_to_array({PLAIN_FORM}, '\\n{{2,}}') AS ps FROM documents),
    b AS (SELECT doc_id, source, list_transform(ps, lambda p: regexp_replace(array_to_string(list_transform(string_split(p, chr(10)), lambda x: {LINE}), '  ' || chr(10)), '\\n+$', '')) AS bs FROM t)
    SELECT doc_id, trim('# ' || replace({_escaped("source")}, '\\.', '.') || chr(10) || chr(10) || array_to_string(list_filter(bs, lambda b: b <> ''), chr(10) || chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS markdown FROM b"""
)
def html_to_markdown_pages(spark: SparkSession, folder: str) -> DataFrame:
    """M1: court decisions set as HTML and brought back to Markdown."""
    @F.pandas_udf("string")
    def back(html: pd.Series) -> pd.Series:
        return html.map(html_to_markdown, na_action="ignore")

    safe = T.html_cell(F.regexp_replace("text", "\n{2,}", "\u0001"))
    html = F.concat(F.lit("<html><body><h1>"), "source", F.lit("</h1><p>"), F.replace(safe, F.lit("\u0001"), F.lit("</p>\n<p>")), F.lit("</p></body></html>"))
    return table(spark, folder, "documents").select("doc_id", back(html).alias("markdown"))


@query(
    """WITH s AS (SELECT DISTINCT doc_id, page_number, y_bottom AS y FROM text_boxes), n AS (SELECT *, coalesce((y - lag(y) OVER (PARTITION BY doc_id, page_number ORDER BY y) > 2.0)::int, 1) AS new FROM s),
    k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number ORDER BY y) AS k FROM n) SELECT doc_id, page_number, min(y) AS position, count(*) AS rules FROM k GROUP BY doc_id, page_number, k"""
)
def line_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Places of level lines, near ones merged."""
    flat = layout.classified(layout.segments(_boxes(spark, folder))).where("kind = 'h'").select("doc_id", "page_number", "y1").distinct()
    return layout.line_positions(flat, "y1")


RULES = """b AS (SELECT DISTINCT * FROM text_boxes), lv AS (SELECT doc_id, page_number, y_bottom AS y, x_left AS lx, x_right AS hx FROM b WHERE x_right > x_left), up AS (SELECT doc_id, page_number, x_left AS x, y_bottom AS ly, y_top AS hy FROM b),
    box AS (SELECT doc_id, page_number, seq, (x_left + x_right) / 2 AS cx, (y_top + y_bottom) / 2 AS cy FROM b)"""


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    """The lower and the left edges of boxes, as rules."""
    boxes = _boxes(spark, folder)
    return layout.segments(boxes).where("x2 > x1").unionByName(tables.uprights(boxes))


@query(
    f"""WITH {RULES}, h AS (SELECT doc_id, page_number, seq, bool_or(y >= cy) AS up, bool_or(y <= cy) AS down FROM box JOIN lv USING (doc_id, page_number) WHERE cx BETWEEN lx AND hx GROUP BY ALL),
    v AS (SELECT doc_id, page_number, seq, bool_or(x <= cx) AS lft, bool_or(x >= cx) AS rgt FROM box JOIN up USING (doc_id, page_number) WHERE cy BETWEEN ly AND hy GROUP BY ALL)
    SELECT doc_id, page_number, seq, coalesce(up, false) AS up, coalesce(down, false) AS down, coalesce(lft, false) AS "left", coalesce(rgt, false) AS "right" FROM h FULL JOIN v USING (doc_id, page_number, seq)"""
)
def box_rays(spark: SparkSession, folder: str) -> DataFrame:
    """Where rays from boxes meet rules."""
    return tables.rays(_boxes(spark, folder), _rules(spark, folder))


# Chains of upright rules, one rule after the other from the bottom: (place, covered from, covered to).
BRIDGES = f"""{RULES}, y AS (SELECT DISTINCT doc_id, page_number, y FROM lv), p AS (SELECT * FROM (SELECT doc_id, page_number, lag(y) OVER (PARTITION BY doc_id, page_number ORDER BY y DESC) AS upper, y AS lower FROM y) WHERE upper IS NOT NULL),
    w AS (SELECT DISTINCT doc_id, page_number, floor(x + 0.5)::bigint AS x, ly, hy FROM up), wk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, x ORDER BY ly, hy) AS j FROM w),
    ch AS (SELECT doc_id, page_number, x, j, ly AS start, hy AS reach FROM wk WHERE j = 1
      UNION ALL SELECT wk.doc_id, wk.page_number, wk.x, wk.j, CASE WHEN wk.ly > ch.reach + 1.5 THEN wk.ly ELSE ch.start END, CASE WHEN wk.ly > ch.reach + 1.5 THEN wk.hy ELSE greatest(ch.reach, wk.hy) END FROM ch JOIN wk ON wk.doc_id = ch.doc_id AND wk.page_number = ch.page_number AND wk.x = ch.x AND wk.j = ch.j + 1),
    e AS (SELECT doc_id, page_number, min(x) AS x0, max(x) AS x9 FROM w GROUP BY ALL),
    c AS (SELECT doc_id, page_number, upper, lower, count(DISTINCT x) AS columns, bool_and(x - x0 <= 1.5 OR x9 - x <= 1.5) AS outr FROM p JOIN ch USING (doc_id, page_number) JOIN e USING (doc_id, page_number) WHERE start <= lower + 1.5 AND reach >= upper - 1.5 GROUP BY ALL),
    br AS (SELECT p.*, coalesce(columns, 0) AS columns, coalesce(outr, true) AS outr FROM p LEFT JOIN c USING (doc_id, page_number, upper, lower))"""


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return layout.segments(_boxes(spark, folder)).where("x2 > x1").select("doc_id", "page_number", F.col("y1").alias("y")).distinct()


@query(f"WITH RECURSIVE {BRIDGES} SELECT doc_id, page_number, upper, lower, columns, outr AS \"outer\" FROM br")
def line_bridges(spark: SparkSession, folder: str) -> DataFrame:
    """Upright rules that lead from one level line to the next."""
    return tables.bridges(_levels(spark, folder), tables.uprights(_boxes(spark, folder)))


@query(
    f"""WITH RECURSIVE {BRIDGES}, s AS (SELECT *, CASE WHEN columns = 0 THEN 'gone' WHEN coalesce(lag(columns) OVER o, 0) >= 3 AND columns < 3 AND NOT outr THEN 'shared' END AS parted FROM br WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY lower DESC)),
    g AS (SELECT *, count(parted) OVER (PARTITION BY doc_id, page_number ORDER BY lower DESC) AS grp FROM s)
    SELECT doc_id, page_number, 0::bigint AS "group", max(y) AS y FROM y GROUP BY ALL UNION ALL SELECT doc_id, page_number, grp, lower FROM g UNION ALL SELECT doc_id, page_number, grp, upper FROM g WHERE parted = 'shared'"""
)
def grid_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Level lines grouped into tables."""
    return tables.line_groups(_levels(spark, folder), tables.uprights(_boxes(spark, folder)))


FRAMES = """b AS (SELECT DISTINCT doc_id, page_number, item_no AS seq, text, x AS x_left, x + coalesce(width, 0) AS x_right, y + font_size AS y_top, y AS y_bottom FROM raw_items), f AS (SELECT doc_id, page_number, floor(seq / 10)::int AS frame, min(x_left) AS x_min, max(x_right) AS x_max, min(y_bottom) AS y_min, max(y_top) AS y_max FROM b GROUP BY ALL)"""


@query(
    f"""WITH RECURSIVE {FRAMES}, m AS (SELECT f.*, seq, text, x_left, x_right, (x_left + x_right) / 2 AS cx, (y_top + y_bottom) / 2 AS cy FROM f JOIN b USING (doc_id, page_number)),
    d AS (SELECT *, coalesce(lag(cy) OVER w, y_min) - cy > 30 AS far FROM m WHERE cx BETWEEN x_min AND x_max AND cy < y_min WINDOW w AS (PARTITION BY doc_id, page_number, frame ORDER BY cy DESC, x_left, seq)),
    e AS (SELECT * EXCLUDE (far, fars) FROM (SELECT *, count_if(far) OVER (PARTITION BY doc_id, page_number, frame ORDER BY cy DESC, x_left, seq) AS fars FROM d) WHERE fars = 0),
    h AS (SELECT * FROM m WHERE x_left >= x_min - 30 AND x_right <= x_max + 30 AND cy BETWEEN y_min AND y_max UNION ALL SELECT * FROM e),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, frame ORDER BY cy DESC, x_left, seq) AS j, max(x_left) OVER o - min(x_left) OVER o AS wide FROM h WINDOW o AS (PARTITION BY doc_id, page_number, frame)),
    k AS (SELECT * FROM t WHERE wide >= 50), r AS (SELECT doc_id, page_number, frame, j, seq, cy AS mark, 0 AS row FROM k WHERE j = 1
      UNION ALL SELECT k.doc_id, k.page_number, k.frame, k.j, k.seq, CASE WHEN r.mark - k.cy > 8 THEN k.cy ELSE r.mark END, r.row + (r.mark - k.cy > 8)::int FROM r JOIN k ON k.doc_id = r.doc_id AND k.page_number = r.page_number AND k.frame = r.frame AND k.j = r.j + 1),
    x AS (SELECT *, coalesce((cx - lag(cx) OVER (PARTITION BY doc_id, page_number, frame ORDER BY cx) >= 20)::int, 0) AS new FROM k), z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_number, frame ORDER BY cx RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::int AS col FROM x)
    SELECT doc_id, page_number, frame, row, col AS "column", string_agg(text, ' ' ORDER BY x_left, z.seq) AS text FROM z JOIN r USING (doc_id, page_number, frame, j) WHERE cx BETWEEN x_min AND x_max GROUP BY ALL"""
)
def level_rule_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables between level rules only."""
    items = table(spark, folder, "raw_items")
    boxes = items.select("doc_id", "page_number", F.col("item_no").alias("seq"), "text", F.col("x").alias("x_left"), (F.col("x") + F.coalesce("width", F.lit(0.0))).alias("x_right"), (F.col("y") + F.col("font_size")).alias("y_top"), F.col("y").alias("y_bottom"))
    frames = layout.once(boxes).groupBy("doc_id", "page_number", F.floor(F.col("seq") / 10).cast("int").alias("frame")).agg(F.min("x_left").alias("x_min"), F.max("x_right").alias("x_max"), F.min("y_bottom").alias("y_min"), F.max("y_top").alias("y_max"))
    return tables.level_tables(frames, boxes)


@query(
    """WITH b AS (SELECT DISTINCT * FROM text_boxes), g AS (SELECT doc_id, page_number, floor(seq / 10)::int AS grp, min(x_left) AS l, max(x_right) AS r, min(y_bottom) AS bo, max(y_top) AS t FROM b GROUP BY ALL)
    SELECT DISTINCT b.doc_id, b.page_number, b.seq, g.grp AS "group" FROM b JOIN g ON b.doc_id = g.doc_id AND b.page_number = g.page_number AND greatest(x_left, x_right) >= l - 10 AND least(x_left, x_right) <= r + 10 AND y_bottom >= bo - 10 AND y_bottom <= t + 10"""
)
def lines_of_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that meet the extent of groups of boxes."""
    boxes = _boxes(spark, folder).distinct()
    groups = boxes.groupBy("doc_id", "page_number", F.floor(F.col("seq") / 10).cast("int").alias("group")).agg(F.min("x_left").alias("left"), F.max("x_right").alias("right"), F.min("y_bottom").alias("bottom"), F.max("y_top").alias("top"))
    return layout.overlapping(layout.segments(boxes), groups)


@query(
    """WITH c AS (SELECT DISTINCT doc_id, page_number, seq AS r0, floor(x_left / 50)::bigint AS c0, text FROM text_boxes), f AS (SELECT * FROM c WHERE trim(text) <> ''),
    r AS (SELECT doc_id, page_number, r0, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY r0) - 1 AS r FROM (SELECT DISTINCT doc_id, page_number, r0 FROM f)), k AS (SELECT doc_id, page_number, c0, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY c0) - 1 AS c FROM (SELECT DISTINCT doc_id, page_number, c0 FROM f))
    SELECT doc_id, page_number, r, c, text FROM c JOIN r USING (doc_id, page_number, r0) JOIN k USING (doc_id, page_number, c0)"""
)
def pruned_grids(spark: SparkSession, folder: str) -> DataFrame:
    """Grids without empty rows and columns."""
    cells = _boxes(spark, folder).select("doc_id", "page_number", F.col("seq").alias("r0"), F.floor(F.col("x_left") / 50).alias("c0"), "text").distinct()
    return layout.pruned(cells, ["doc_id", "page_number"], "r0", "c0", "text")


@query(
    f"""WITH RECURSIVE {LINES}, {BODY}, {MARKED}, e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line) AS j FROM m),
    h AS (SELECT doc_id, page_number, j, 0::BIGINT AS paragraph, text AS content, mark, is_tabular, top FROM e WHERE j = 1
      UNION ALL SELECT e.doc_id, e.page_number, e.j, h.paragraph + (NOT c.wraps)::BIGINT,
      CASE WHEN NOT c.wraps THEN e.text WHEN regexp_matches(h.content, '[\\p{{L}}\\p{{Nl}}]-$') AND regexp_matches(e.text, '^\\p{{Ll}}') THEN CASE WHEN regexp_matches(h.content, '-[^\\s]*-$') THEN h.content ELSE regexp_replace(h.content, '-$', '') END || e.text ELSE h.content || ' ' || e.text END,
      CASE WHEN c.wraps THEN h.mark ELSE e.mark END, CASE WHEN c.wraps THEN h.is_tabular ELSE e.is_tabular END, e.top
      FROM h JOIN e ON e.doc_id = h.doc_id AND e.page_number = h.page_number AND e.j = h.j + 1,
      LATERAL (SELECT coalesce(h.mark = '' AND e.mark = '' AND NOT h.is_tabular AND NOT e.is_tabular AND h.top - e.top > 0 AND h.top - e.top <= 2 * e.body AND length(h.content) > 25 AND NOT regexp_matches(h.content, '[.!?…)\\]]\\s*$'), false) AS wraps) c)
    SELECT doc_id, page_number, paragraph, arg_max(mark || content, j) AS text FROM h GROUP BY ALL"""
)
def page_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Wrapped lines joined to paragraphs."""
    return layout.paragraphs(_marked(spark, folder))


@query(f"SELECT position, name FROM (VALUES {', '.join(f'({k}, {chr(39)}{n}{chr(39)})' for k, n in enumerate('pdf docx pptx xlsx epub ipynb iwork github wikipedia rss csv json yaml image audio zip xml html plain-text'.split(), 1))}) AS v(position, name)")
def converter_names(spark: SparkSession, folder: str) -> DataFrame:
    """The converters in order."""
    return routing.converter_names(spark)


@query("SELECT 23 AS formats, 23 AS builtin")
def known_formats(spark: SparkSession, folder: str) -> DataFrame:
    """The formats that are told of."""
    return routing.formats(spark).agg(F.count("*").cast("int").alias("formats"), F.count_if("builtin").cast("int").alias("builtin"))


# ---------------------------------------------------------------- evaluation

TEXTS = "t AS (SELECT DISTINCT doc_id, converter, markdown FROM documents_out WHERE markdown IS NOT NULL)"


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents_out").where("markdown is not null").select("doc_id", "converter", "markdown").distinct()


@query(
    f"""WITH {TEXTS} SELECT doc_id, length(markdown) AS chars, len(regexp_extract_all(markdown, '(?m)^#{{1,6}} ')) AS headings, len(regexp_extract_all(markdown, '(?m)^\\|.*\\|[ ]*$')) AS table_rows,
    len(regexp_extract_all(markdown, '(?m)^[ ]*(?:[-*+]|[0-9]+\\.) ')) AS list_items, len(regexp_extract_all(markdown, '\\[[^\\]\\n]*\\]\\([^)\\n]*\\)')) AS links, len(regexp_extract_all(markdown, '\\[\\^[^\\]\\n]+\\]')) AS footnotes FROM t"""
)
def structure_counts(spark: SparkSession, folder: str) -> DataFrame:
    """AG14, E5: what texts are made of."""
    counted = evaluation.structure(_texts(spark, folder), "markdown").drop("markdown", "converter")
    return counted.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in counted.columns if c != "doc_id"))


WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


@query(
    f"""WITH d AS (SELECT doc_id, docket, text, {WORDS.format("text")} AS w FROM documents WHERE docket IS NOT NULL),
    s AS (SELECT doc_id, docket, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d)
    SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN len(a.g) > 0 THEN round(len(list_intersect(a.g, b.g)) / len(a.g), 4) END AS a_in_b, CASE WHEN len(b.g) > 0 THEN round(len(list_intersect(a.g, b.g)) / len(b.g), 4) END AS b_in_a
    FROM s a JOIN s b ON a.docket = b.docket AND a.doc_id < b.doc_id"""
)
def trigram_containment(spark: SparkSession, folder: str) -> DataFrame:
    """AG15, AG11, J17: how much of each version of a decision another one holds."""
    docs = table(spark, folder, "documents").where("docket is not null")
    return evaluation.contained_versions(docs, ["docket"], "doc_id", "text")


@query(
    f"""WITH d AS (SELECT doc_id, docket, source, text, {WORDS.format("text")} AS w FROM documents WHERE docket IS NOT NULL),
    s AS (SELECT doc_id, docket, source, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d),
    p AS (SELECT a.source, CASE WHEN len(a.g) > 0 THEN round(len(list_intersect(a.g, b.g)) / len(a.g), 4) END AS ab, CASE WHEN len(b.g) > 0 THEN round(len(list_intersect(a.g, b.g)) / len(b.g), 4) END AS ba FROM s a JOIN s b ON a.docket = b.docket AND a.doc_id < b.doc_id)
    SELECT source, count(*) AS documents, round(avg(ab), 4) AS a_in_b, round(avg(ba), 4) AS b_in_a FROM p GROUP BY source"""
)
def mean_containment(spark: SparkSession, folder: str) -> DataFrame:
    """AG11: how much of each other versions hold, on average by source of the first."""
    return evaluation.mean_containment(trigram_containment(spark, folder).join(table(spark, folder, "documents").select(F.col("doc_id").alias("a"), "source"), "a"), ["source"])


NORMAL = "trim(regexp_replace(lower(regexp_replace({0}, '[®™]', '', 'g')), '[ \\t\\r\\n]+', ' ', 'g'))"


@query(
    f"""WITH o AS (SELECT DISTINCT doc_id, coalesce(converter, 'none') AS tool, markdown AS text FROM documents_out), k AS (SELECT DISTINCT doc_id, title FROM documents_out WHERE title IS NOT NULL),
    c AS (SELECT doc_id, 'contains' AS type, title AS value FROM k UNION ALL SELECT doc_id, 'min_chars', '500' FROM k UNION ALL SELECT doc_id, 'min_table_rows', '3' FROM k UNION ALL SELECT doc_id, 'not_contains', 'lorem ipsum' FROM k UNION ALL SELECT doc_id, 'regex', '^# ' FROM k),
    l AS (SELECT DISTINCT tool FROM o), m AS (SELECT c.doc_id, l.tool, coalesce(CASE type WHEN 'contains' THEN contains({NORMAL.format("coalesce(text, '')")}, {NORMAL.format("value")}) WHEN 'not_contains' THEN NOT contains({NORMAL.format("coalesce(text, '')")}, {NORMAL.format("value")})
      WHEN 'min_chars' THEN length(coalesce(text, '')) >= try_cast(value AS int) WHEN 'min_table_rows' THEN len(regexp_extract_all(coalesce(text, ''), '(?m)^\\|.*\\|[ ]*$')) >= try_cast(value AS int) WHEN 'regex' THEN regexp_matches(coalesce(text, ''), '(?im)^# ') END, false) AS ok FROM c CROSS JOIN l LEFT JOIN o ON o.doc_id = c.doc_id AND o.tool = l.tool),
    d AS (SELECT tool, doc_id, count_if(ok) AS passed, count(*) AS total FROM m GROUP BY ALL)
    SELECT tool, sum(passed)::BIGINT AS passed, sum(total)::BIGINT AS total, round(sum(passed) / sum(total), 4) AS score, count_if(passed = total)::BIGINT AS complete, count(*) AS documents FROM d GROUP BY tool"""
)
def assertion_scores(spark: SparkSession, folder: str) -> DataFrame:
    """J16, AG9, E4: assertions by converter."""
    outputs = table(spark, folder, "documents_out").select("doc_id", F.coalesce("converter", F.lit("none")).alias("tool"), F.col("markdown").alias("text")).distinct()
    titled = table(spark, folder, "documents_out").where("title is not null").select("doc_id", "title").distinct()
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("type"), v.alias("value")) for k, v in (("contains", F.col("title")), ("min_chars", F.lit("500")), ("min_table_rows", F.lit("3")), ("not_contains", F.lit("lorem ipsum")), ("regex", F.lit("^# "))))))
    checks = titled.select("doc_id", kinds.alias("c")).select("doc_id", "c.*")
    return evaluation.scored(checks, outputs)


@query(
    """SELECT coalesce(converter, 'none') AS tool, count(*) AS runs, count_if(markdown IS NOT NULL)::BIGINT AS passed, count_if(markdown IS NULL)::BIGINT AS failed, round(median(CASE WHEN markdown IS NOT NULL THEN length(markdown) END), 3) AS median, sum(CASE WHEN markdown IS NOT NULL THEN length(markdown) END)::double AS total
    FROM documents_out GROUP BY 1"""
)
def converter_report(spark: SparkSession, folder: str) -> DataFrame:
    """AG13, E2: runs, failures, median and total by converter."""
    rows = table(spark, folder, "documents_out").withColumn("tool", F.coalesce("converter", F.lit("none")))
    return evaluation.run_report(rows, "tool", F.col("markdown").isNotNull(), F.length("markdown").cast("double"))


@query("WITH x AS (SELECT unnest(errors) AS err FROM documents_out) SELECT err.converter AS failed, err.message AS message, count(*) AS n FROM x GROUP BY ALL")
def error_report(spark: SparkSession, folder: str) -> DataFrame:
    """Errors by converter and message."""
    rows = table(spark, folder, "documents_out").select(F.explode("errors").alias("e"))
    return rows.groupBy(F.col("e.converter").alias("failed"), F.col("e.message").alias("message")).agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT lang, source, avg(n_chars) AS m FROM documents GROUP BY ALL) SELECT lang, round(avg(m), 4) AS macro FROM m GROUP BY lang")
def macro_average(spark: SparkSession, folder: str) -> DataFrame:
    """AG10, E11: means of means."""
    return evaluation.macro_average(table(spark, folder, "documents"), ["lang"], "source", "n_chars")


@query(
    """WITH a AS (SELECT doc_id, md5(coalesce(max(substr(extension, 2)), '')) AS d FROM documents_in GROUP BY doc_id), b AS (SELECT doc_id, md5(max(converter)) AS d FROM documents_out WHERE markdown IS NOT NULL GROUP BY doc_id)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.d IS DISTINCT FROM b.d"""
)
def manifest_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Sources without a result, results without a source, and results of another kind than the source's name says."""
    expected = table(spark, folder, "documents_in").groupBy("doc_id").agg(F.md5(F.coalesce(F.max(F.substring("extension", 2, 99)), F.lit(""))).alias("digest"))
    found = table(spark, folder, "documents_out").where("markdown is not null").groupBy("doc_id").agg(F.md5(F.max("converter")).alias("digest"))
    return evaluation.manifest_difference(expected, found)


@query("SELECT doc_id, count(*) AS runs, count(DISTINCT md5(coalesce(markdown, ''))) <= 1 AS deterministic FROM documents_out GROUP BY doc_id HAVING count(*) > 1")
def repeated_runs(spark: SparkSession, folder: str) -> DataFrame:
    """AG12: whether repeated conversions agree."""
    return evaluation.deterministic(table(spark, folder, "documents_out"), ["doc_id"], F.md5(F.coalesce("markdown", F.lit("")))).where("runs > 1")


@query("SELECT DISTINCT doc_id FROM documents_in WHERE doc_id NOT IN (SELECT doc_id FROM documents_out WHERE markdown IS NOT NULL)")
def remaining_work(spark: SparkSession, folder: str) -> DataFrame:
    """Sources still to convert."""
    return evaluation.remaining(table(spark, folder, "documents_in").select("doc_id").distinct(), table(spark, folder, "documents_out").where("markdown is not null"), ["doc_id"])


@query(
    """WITH p AS (SELECT doc_id, max(page_number) AS pages FROM page_geometry GROUP BY doc_id) SELECT doc_id, share, greatest(1, least(round_even(pages * share, 0), pages))::int AS page
    FROM p, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) AS share)"""
)
def quantile_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages at shares of a document."""
    sizes = _pages(spark, folder).groupBy("doc_id").agg(F.max("page_number").alias("pages"))
    return evaluation.quantile_pages(sizes, "doc_id", "pages")


PHRASE = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)?')"


@query(
    f"""WITH p AS (SELECT doc_id, max(page_number) AS pages FROM page_geometry GROUP BY doc_id), a AS (SELECT DISTINCT doc_id, greatest(1, least(round_even(pages * share, 0), pages))::int AS page_number FROM p, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) AS share)),
    b AS (SELECT DISTINCT doc_id, page_number, seq, text FROM text_boxes JOIN a USING (doc_id, page_number)), l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY doc_id, page_number) / 2 AS half FROM b),
    w AS (SELECT *, {PHRASE.format("text")} AS w FROM l WHERE NOT regexp_matches(text, '[a-z][A-Z][A-Za-z]*-|[\\p{{L}}\\p{{N}}_]-\\s+[\\p{{L}}\\p{{N}}_]')
      AND len(regexp_extract_all(text, '[\\x{{0590}}-\\x{{08ff}}]')) < 0.3 * greatest(len(regexp_extract_all(text, '\\p{{L}}')), 1)),
    t AS (SELECT doc_id, list_distinct(flatten(list({PHRASE.format("title")}))) AS t FROM documents_out WHERE title IS NOT NULL GROUP BY doc_id),
    f AS (SELECT *, array_to_string(w[(len(w) - 7) // 2 + 1:(len(w) - 7) // 2 + 7], ' ') AS anchor, len(list_intersect(list_distinct(w), coalesce(t, []))) / greatest(len(coalesce(t, [])), 1) AS overlap FROM w LEFT JOIN t USING (doc_id)
      WHERE len(w) BETWEEN 7 AND 30 AND len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) >= 5),
    n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, anchor) AS times FROM f)
    SELECT doc_id, page_number, anchor FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY CASE WHEN times > 1 THEN 2 WHEN overlap >= 0.6 THEN 1 ELSE 0 END, overlap, abs(len(w) - 12), abs(pos - half), anchor) = 1"""
)
def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """E8, AG8: a phrase that finds each of five pages of a document again."""
    boxes = _boxes(spark, folder).select("doc_id", "page_number", "seq", "text").distinct()
    pages = evaluation.quantile_pages(_pages(spark, folder).groupBy("doc_id").agg(F.max("page_number").alias("pages")), "doc_id", "pages").select("doc_id", F.col("page").alias("page_number"))
    titles = table(spark, folder, "documents_out").where("title is not null").select("doc_id", "title")
    return evaluation.anchors(boxes, pages, titles)


@query("SELECT doc_id, md5(CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || chr(10) || '[...]' ELSE text END) AS digest FROM documents")
def clipped_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts clipped for a judge."""
    return table(spark, folder, "documents").select("doc_id", F.md5(evaluation.clipped(F.col("text"), 4000)).alias("digest"))


@query("SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def longest_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """The longest texts of each source; a top-k report."""
    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    return table(spark, folder, "documents").withColumn("k", F.row_number().over(w)).where("k <= 3").select("doc_id", "source", "n_chars")


@query("SELECT event_type, try_cast(json_extract_string(props, '$.k') AS int) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """C12, JSON functions: a field of JSON text."""
    k = F.get_json_object("props", "$.k").try_cast("int").alias("k")
    return table(spark, folder, "events").groupBy("event_type", k).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """WITH r AS (SELECT DISTINCT doc_id, markdown, title FROM documents_out)
    SELECT doc_id, md5('{"success":' || (markdown IS NOT NULL)::varchar || ',"source":' || to_json(doc_id)::varchar || coalesce(',"title":' || to_json(title)::varchar, '') || coalesce(',"length":' || length(markdown) || ',"markdown":' || to_json(markdown)::varchar, '') || '}') AS digest FROM r"""
)
def json_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Results as JSON, without the fields that have no value."""
    rows = table(spark, folder, "documents_out").select("doc_id", "markdown", "title").distinct()
    return rows.select("doc_id", F.md5(evaluation.envelope()).alias("digest"))


@query(
    """WITH o AS (SELECT DISTINCT doc_id, docket, version::varchar AS tool, md5(text) AS h FROM documents WHERE docket IS NOT NULL AND version IS NOT NULL)
    SELECT sha256(to_json({'a': x.tool, 'b': y.tool, 'doc_id': x.docket, 'ha': x.h, 'hb': y.h})::varchar) AS task_id, x.docket AS doc_id, x.tool AS a, y.tool AS b FROM o x JOIN o y ON x.docket = y.docket AND x.tool <> y.tool"""
)
def judge_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered pairs to judge, with ids that their inputs determine."""
    outputs = table(spark, folder, "documents").where("docket is not null and version is not null").select(F.col("docket").alias("doc_id"), F.col("version").cast("string").alias("tool"), "text", F.col("doc_id").alias("k")).distinct()
    return evaluation.judge_tasks(outputs.drop("k"))


@query(
    """WITH f AS (SELECT DISTINCT docket FROM documents WHERE docket IS NOT NULL AND version IS NOT NULL ORDER BY docket LIMIT 200),
    o AS (SELECT DISTINCT docket, version::varchar AS tool, md5(text) AS h FROM documents JOIN f USING (docket) WHERE version IS NOT NULL),
    t AS (SELECT sha256(to_json({'a': x.tool, 'b': y.tool, 'doc_id': x.docket, 'ha': x.h, 'hb': y.h})::varchar) AS task_id, x.docket AS doc_id, x.tool AS a, y.tool AS b, x.tool < y.tool AS judged FROM o x JOIN o y ON x.docket = y.docket AND x.tool <> y.tool)
    SELECT judged, count(*) AS tasks, count(DISTINCT doc_id) AS documents FROM t GROUP BY judged"""
)
def judge_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The tasks of the first 200 dockets, those that the journal has and those that are left; the limit is the feature."""
    rows = table(spark, folder, "documents").where("docket is not null and version is not null")
    outputs = rows.select(F.col("docket").alias("doc_id"), F.col("version").cast("string").alias("tool"), "text").distinct()
    tasks = evaluation.judge_tasks(evaluation.first_documents(outputs, 200))
    journal = tasks.where("a < b").select("task_id", F.lit("A").alias("winner"))
    done, left = evaluation.recorded(tasks, journal, ["task_id"]), evaluation.remaining(tasks, journal, ["task_id"])
    both = done.withColumn("judged", F.lit(True)).unionByName(left.withColumn("judged", F.lit(False)))
    return both.groupBy("judged").agg(F.count("*").alias("tasks"), F.count_distinct("doc_id").alias("documents"))


@query("SELECT doc_id, converter, converted_at FROM documents_out QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY converted_at DESC NULLS LAST) = 1")
def latest_results(spark: SparkSession, folder: str) -> DataFrame:
    """The last result of each document."""
    return evaluation.latest(table(spark, folder, "documents_out").select("doc_id", "converter", "converted_at"), ["doc_id"], ["converted_at"])


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM documents_in INTERSECT SELECT doc_id FROM documents_out) UNION ALL SELECT 'in', count(*) FROM (SELECT doc_id FROM documents_in EXCEPT SELECT doc_id FROM documents_out) UNION ALL SELECT 'out', count(*) FROM (SELECT doc_id FROM documents_out EXCEPT SELECT doc_id FROM documents_in)")
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """2.14: intersection and differences of ids."""
    a, b = table(spark, folder, "documents_in").select("doc_id"), table(spark, folder, "documents_out").select("doc_id")
    count = lambda name, df: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return count("both", a.intersect(b)).unionByName(count("in", a.subtract(b))).unionByName(count("out", b.subtract(a)))


@query("SELECT coalesce(converter, 'none') AS converter, count(*) AS n, count(DISTINCT doc_id) AS documents FROM documents_out GROUP BY 1")
def streamed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Incremental ingestion: the results table read as a stream gives the same counts."""
    return ingest.counted(spark, f"{folder}/documents_out.parquet")


def queries() -> dict:
    return QUERIES | documents.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | documents.SQL
