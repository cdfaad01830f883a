"""Queries that convert files of every format, and the Markdown that SQL expects of them.

The files hold each nation's suppliers. Text formats are put together by
expressions, others by samples.py in one narrow stage; all go through
operators.convert like any source.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.formats.markdown import html_to_markdown
from folioforge.functions import text as T
from folioforge.operators import convert
from folioforge.plans import samples
from folioforge.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: One row a supplier: its nation's number ``k`` and name ``n``, its number ``i`` and name ``t``.
ROWS = "s AS (SELECT n_nationkey AS k, n_name AS n, s_suppkey AS i, s_name AS t FROM nation JOIN supplier ON s_nationkey = n_nationkey)"
LF = "chr(10)"
#: A nation's name as text in Markdown: its line would else begin emphasis.
N = "replace(n, '_', '\\_')"


def expected(converter: str, markdown: str, title: str = "NULL::varchar") -> str:
    """The SQL of results: ``markdown`` and ``title`` are aggregates over each nation's rows."""
    return f"WITH {ROWS} SELECT k AS doc_id, '{converter}' AS converter, {markdown} AS markdown, {title} AS title FROM s GROUP BY k, n"


def each(piece: str, between: str = LF) -> str:
    return f"string_agg({piece}, {between} ORDER BY i)"


def query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def nations(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, n, rows``: each nation with its suppliers (i, t) in order."""
    met = table(spark, folder, "nation").join(table(spark, folder, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return met.groupBy(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.col("s_suppkey").alias("i"), F.col("s_name").alias("t")))).alias("rows"))


def told(piece, between: str = "") -> Column:
    """``piece`` of every supplier, in order."""
    return F.array_join(F.transform("rows", lambda r: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in piece(r["i"].cast("string"), r["t"])))), between)


def written(spark: SparkSession, folder: str, extension: str, *parts) -> DataFrame:
    """The results of converting texts that ``parts`` give."""
    text = F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    files = nations(spark, folder).select("doc_id", F.encode(text, "UTF-8").alias("content"), F.lit(extension).alias("extension"), F.concat(F.lit("file"), F.lit(extension)).alias("filename"))
    return converted(files)


def made(spark: SparkSession, folder: str, extension: str, sample) -> DataFrame:
    """The results of converting files that a function of samples.py makes."""

    def run(batches):
        for batch in batches:
            files = [sample(n, [(r["i"], r["t"]) for r in rows]) for n, rows in zip(batch.column("n").to_pylist(), batch.column("rows").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(files, pa.binary())], names=["doc_id", "content"])

    files = nations(spark, folder).mapInArrow(run, "doc_id int, content binary")
    return converted(files.withColumn("extension", F.lit(extension)).withColumn("filename", F.concat(F.lit("file"), F.lit(extension))))


def converted(files: DataFrame) -> DataFrame:
    return convert.convert(files.withColumn("doc_id", F.col("doc_id").cast("string"))).select(F.col("doc_id").cast("int").alias("doc_id"), "converter", "markdown", "title")


HEAD = "'| Key | Name |' || chr(10) || '| --- | --- |' || chr(10) || "
LINES = "string_agg('| ' || i || ' | ' || t || ' |', chr(10) ORDER BY i)"


@query(expected("csv", f"'| key | name | note |' || {LF} || '| --- | --- | --- |' || {LF} || " + each("""'| ' || i || ' | ' || t || ', Inc. | says "yes" |'""")))
def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """C11: tables with quoted cells."""
    return written(spark, folder, ".csv", "key,name,note\n", told(lambda i, t: (i, ',"', t, ', Inc.", "says ""yes""" \r\n')))


@query(expected("json", f"""'```json' || {LF} || '{{' || {LF} || '  "nation": "' || n || '",' || {LF} || '  "suppliers": [' || {LF} || """ + each(f"""'    {{' || {LF} || '      "key": ' || i || ',' || {LF} || '      "name": "' || t || '"' || {LF} || '    }}'""", f"',' || {LF}") + f""" || {LF} || '  ]' || {LF} || '}}' || {LF} || '```'"""))
def json_files(spark: SparkSession, folder: str) -> DataFrame:
    """Compact JSON set out anew."""
    return written(spark, folder, ".json", '{"nation":"', F.col("n"), '","suppliers":[', told(lambda i, t: ('{"key":', i, ',"name":"', t, '"}'), ","), "]}")


@query(expected("yaml", f"'```yaml' || {LF} || 'nation: ' || n || {LF} || " + each("'- ' || t") + f" || {LF} || '```'"))
def yaml_files(spark: SparkSession, folder: str) -> DataFrame:
    """YAML in a fence."""
    return written(spark, folder, ".yaml", "nation: ", F.col("n"), "\n", told(lambda i, t: ("- ", t), "\n"))


@query(expected("xml", f"'```xml' || {LF} || '<nation name=\"' || n || '\">' || " + each("'<s>' || t || '</s>'", "''") + f" || '</nation>' || {LF} || '```'"))
def xml_files(spark: SparkSession, folder: str) -> DataFrame:
    """XML that is no feed falls to the next converter."""
    return written(spark, folder, ".xml", '<nation name="', F.col("n"), '">', told(lambda i, t: ("<s>", t, "</s>")), "</nation>")


@query(expected("rss", f"'# ' || n || {LF} || {LF} || 'Suppliers of **' || {N} || '**' || {LF} || {LF} || " + each(f"'## ' || t || {LF} || 'Published: day ' || i || {LF} || '[Link](https://shop.example/' || i || ')' || {LF} || 'Number _' || i || '_'", f"{LF} || {LF}"), "n"))
def rss_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds of channels."""
    entry = lambda i, t: ("<item><title><![CDATA[", t, "]]></title><pubDate>day ", i, "</pubDate><link>https://shop.example/", i, "</link><description>&lt;p&gt;Number &lt;i&gt;", i, "&lt;/i&gt;&lt;/p&gt;</description></item>")
    return written(spark, folder, ".rss", '<?xml version="1.0"?><rss version="2.0"><channel><title>', F.col("n"), "</title><description>Suppliers of &lt;b&gt;", F.col("n"), "&lt;/b&gt;</description>", told(entry), "</channel></rss>")


@query(expected("rss", f"'# ' || n || {LF} || {LF} || 'All of them' || {LF} || {LF} || " + each(f"'## ' || t || {LF} || 'Updated: day ' || i || {LF} || 'Plain ' || i", f"{LF} || {LF}"), "n"))
def atom_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds of entries."""
    entry = lambda i, t: ("<entry><title>", t, "</title><updated>day ", i, "</updated><summary>Plain ", i, "</summary></entry>")
    return written(spark, folder, ".atom", "<feed><title>", F.col("n"), "</title><subtitle>All of them</subtitle>", told(entry), "</feed>")


@query(expected("ipynb", f"'# ' || n || {LF} || 'Suppliers' || {LF} || {LF} || " + each(f"'```sql' || {LF} || 'select ' || i || {LF} || '```' || {LF} || {LF} || '```' || {LF} || t || {LF} || '```'", f"{LF} || {LF}"), "n"))
def notebooks(spark: SparkSession, folder: str) -> DataFrame:
    """Notebooks with code and its output."""
    cell = lambda i, t: ('{"cell_type":"code","source":"select ', i, '","outputs":[{"output_type":"stream","text":["', t, '\\n"]}]}')
    return written(spark, folder, ".ipynb", '{"metadata":{"kernelspec":{"language":"sql"}},"cells":[{"cell_type":"markdown","source":["# ', F.col("n"), '\\n","Suppliers"]},', told(cell, ","), "]}")


PAGE = N + " || ' page' || chr(10) || chr(10) || '# ' || " + N + " || chr(10) || chr(10) || 'Has **' || count(*) || '** _suppliers_, `all`.' || chr(10) || chr(10) || {0} || chr(10) || chr(10) || {1} || chr(10) || chr(10) || '> Quoted' || chr(10) || chr(10) || '[more](/n/' || k || ')  ' || chr(10) || '![logo](/l.png)' || chr(10) || chr(10) || '* * *' || chr(10) || chr(10) || '```sql' || chr(10) || 'select ' || k || chr(10) || '```'"


def _html(name: Column, key: Column) -> tuple:
    return (
        "<html><head><title> ", name, " page </title><style>p { color: red }</style><script>if (a < b) run('</p>')</script></head>\n<body><h1>", name, "</h1>\n<p>Has <b>", F.size("rows").cast("string"), "</b> <i>suppliers</i>, <code>all</code>.</p>\n<ul>\n",
        told(lambda i, t: ("  <li>", t, "</li>\n")), "</ul><table><tr><td><p>Key</p></td><td>Name</td></tr>", told(lambda i, t: ("<tr><td>", i, "</td><td>", t, "</td></tr>")), "</table><blockquote>Quoted</blockquote><p><a href=\"/n/", key, "\">more</a><br><img src=\"/l.png\" alt=\"logo\"></p><hr><pre><code class=\"language-sql\">select ", key, "\n</code></pre></body></html>",
    )


@query(expected("html", PAGE.format(each("'- ' || t"), HEAD + LINES), "n || ' page'"))
def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """Headings, emphasis, lists, tables, links, quotes and code."""
    return written(spark, folder, ".html", *_html(F.col("n"), F.col("doc_id").cast("string")))


NESTED = "'1. ' || " + N + " || chr(10) || " + each("'  - ' || t") + " || chr(10) || '2. end' || chr(10) || chr(10) || '<table><tbody><tr><td>' || n || '</td></tr></tbody></table>' || chr(10) || chr(10) || '1\\\\. not \\\\*a list\\\\* \\\\[x\\\\]\\\\_' || chr(10) || chr(10) || '~~old~~ **bold** word'".replace("\\\\", "\\")


@query(f"WITH {ROWS} SELECT k AS doc_id, {NESTED} AS markdown FROM s GROUP BY k, n")
def html_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Nested lists, kept tables, escapes, misnested marks."""
    @F.pandas_udf("string")
    def back(html):
        return html.map(html_to_markdown, na_action="ignore")

    html = F.concat(F.lit("<ol><li>"), "n", F.lit("<ul>"), told(lambda i, t: ("<li>", t, "")), F.lit("</ul><li>end</ol><table><tr><td>"), "n", F.lit("</td></tr></table><p>1. not *a list* [x]_</p><p><del>old</del><b> bold </b>word"))
    return nations(spark, folder).select("doc_id", back(html).alias("markdown"))


@query(
    r"""SELECT doc_id, trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, md5(regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g')) AS stripped
    FROM (SELECT doc_id, '<TITLE lang="x"> ' || source || ' </TITLE><script type="a">' || left(text, 50) || '</script><p>' || text || '</p><STYLE>p {}</STYLE><scripted>' AS h FROM documents)"""
)
def html_titles(spark: SparkSession, folder: str) -> DataFrame:
    """L1: titles of pages, and pages without scripts and styles."""
    html = F.concat(F.lit('<TITLE lang="x"> '), "source", F.lit(' </TITLE><script type="a">'), F.substring("text", 1, 50), F.lit("</script><p>"), "text", F.lit("</p><STYLE>p {}</STYLE><scripted>"))
    return table(spark, folder, "documents").select("doc_id", T.html_title(html).alias("title"), F.md5(T.without_blocks(html)).alias("stripped"))


@query(expected("docx", f"'# ' || {N} || {LF} || {LF} || '**Suppliers** by number' || {LF} || {LF} || string_agg(o || '. ' || t, {LF} ORDER BY i) || {LF} || {LF} || " + HEAD + LINES).replace("FROM s GROUP", "FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS o FROM s) GROUP"))
def word_files(spark: SparkSession, folder: str) -> DataFrame:
    """Headings, bold runs, numbered lists, tables."""
    return made(spark, folder, ".docx", samples.word)


@query(expected("pptx", f"string_agg('<!-- Slide ' || o || ' -->' || {LF} || '# ' || t || {LF} || 'Key ' || i || ' of ' || n, {LF} || {LF} ORDER BY i)").replace("FROM s GROUP", "FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS o FROM s) GROUP"))
def slide_files(spark: SparkSession, folder: str) -> DataFrame:
    """Slides in the order of the deck."""
    return made(spark, folder, ".pptx", samples.slides)


@query(expected("xlsx", f"'## ' || n || {LF} || {LF} || " + HEAD + LINES))
def workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets with shared strings."""
    return made(spark, folder, ".xlsx", samples.workbook)


@query(expected("epub", f"'**Title:** ' || n || {LF} || '**Authors:** First Author, Second Author' || {LF} || {LF} || " + each(f"'# ' || t || {LF} || {LF} || 'Key ' || i", f"{LF} || {LF}"), "n"))
def books(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters in the order of the spine."""
    return made(spark, folder, ".epub", samples.book)


@query(expected("iwork", f"'### ' || n || {LF} || {LF} || " + each("t", f"{LF} || {LF}"), "n"))
def pages_files(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with styles."""
    return made(spark, folder, ".pages", samples.pages)


@query(expected("zip", f"'Content from `file.zip`:' || {LF} || {LF} || '## File: rows.csv' || {LF} || {LF} || '| key | name |' || {LF} || '| --- | --- |' || {LF} || " + LINES + f" || {LF} || {LF} || '## File: page.html' || {LF} || {LF} || '## ' || {N} || {LF} || {LF} || '## File: note.txt' || {LF} || {LF} || '*[binary file]*' || {LF} || {LF} || '## File: inner.zip' || {LF} || {LF} || '*[binary file]*'"))
def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archives entry by entry."""
    return made(spark, folder, ".zip", samples.archive)


@query(expected("audio", f"'## Metadata' || {LF} || {LF} || 'Duration: ' || (7 * count(*)) // 60 || ':' || lpad(((7 * count(*)) % 60)::varchar, 2, '0') || {LF} || 'Format: PCM' || {LF} || 'SampleRate: 1000 Hz' || {LF} || 'Channels: 1' || {LF} || 'Bitrate: 16 kbps'"))
def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of recordings."""
    return made(spark, folder, ".wav", samples.recording)


@query(expected("pdf", f"'# ' || {N} || {LF} || {LF} || " + each("'The register names ' || t || ' as the supplier of number ' || i || ' here.'", f"{LF} || {LF}")))
def printed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and wrapped paragraphs of printed pages."""
    return made(spark, folder, ".pdf", samples.printed)


@query(f"WITH {ROWS}, p AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY i) - 1) // 19 AS page FROM s), g AS (SELECT k, page, {HEAD}{LINES} AS m FROM p GROUP BY k, page) SELECT k AS doc_id, 'pdf' AS converter, string_agg(m, chr(10) || chr(10) ORDER BY page) AS markdown, NULL::varchar AS title FROM g GROUP BY k")
def ruled_files(spark: SparkSession, folder: str) -> DataFrame:
    """Tables that ruling lines frame."""
    return made(spark, folder, ".pdf", samples.ruled)
