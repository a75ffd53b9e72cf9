"""Queries of page parsing, sources and sinks, coding and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkfold.functions import text as X
from inkfold.operators import coding, html
from inkfold.plans.registry import query
from inkfold.sources import files, remote, workbook
from inkfold.sources.relations import BLOCKS_SQL, MANIFEST_SQL, RECORDS_SQL, blocks, documents, manifest, records, table
from inkfold.sources.shared import shared_path
from inkfold.streaming import intake


def pages(spark, d):
    return table(spark, d, "pages")


_CLEAN_SQL = r"(SELECT page_id, regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<nav.*?</nav>|<footer.*?</footer>', '', 'g') AS h FROM pages)"
_TEXT_SQL = r"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"
#: What the rules of the HTML walk call boilerplate, in SQL.
_DULL_SQL = r"({t} = '' OR lower({t}) IN ('share', 'copied', 'tags', 'written by', 'subscribe', 'sign up', 'listen') OR starts_with(lower({t}), 'listen') OR regexp_matches(lower({t}), '^\d+\s*minutes?( read)?$') OR regexp_matches(lower({t}), '^[a-z]+\.?\s+\d{{1,2}},?\s+\d{{4}}$') OR (length({t}) < 100 AND NOT regexp_matches({t}, '[.!?]') AND NOT regexp_matches({t}, '^[-‐-―]\s*\S')))"
#: The walk over these pages, in which paragraphs follow the only h1; an unclosed bold paragraph is bold to its end.
PAGE_BLOCKS_SQL = rf"""(WITH title AS (SELECT page_id, {_TEXT_SQL.format(x="regexp_extract(h, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS title, regexp_extract(h, '(?s)</h1>(.*)$', 1) AS rest FROM {_CLEAN_SQL}
), raw AS (SELECT page_id, title, unnest(string_split(rest, '<p>')) AS x, generate_subscripts(string_split(rest, '<p>'), 1) AS k FROM title
), par AS (SELECT page_id, title, k, starts_with(x, '<b>') AND (NOT contains(x, '</b>') OR regexp_matches(x, '(?s)</b>\s*(</p>|$)')) AS bold, {_TEXT_SQL.format(x="regexp_extract(x, '(?s)^(.*?)(</p>|</article>|$)', 1)")} AS text FROM raw WHERE k > 1
), said AS (SELECT *, count(*) OVER (PARTITION BY page_id, text) >= 2 AND length(text) < 150 AS often, bold AND length(text) < 100 AND NOT regexp_matches(text, '[.!?]$') AS head FROM par WHERE text <> ''
), kept AS (SELECT page_id, 0 AS k, 'title' AS position, title AS text FROM title WHERE title <> '' UNION ALL
  SELECT page_id, k, CASE WHEN head THEN 'section_heading' ELSE 'body' END, text FROM said WHERE head OR NOT ({_DULL_SQL.format(t="text")} OR text = title OR often)
) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS ord, position, text,
  CASE WHEN position = 'body' THEN coalesce(last_value(CASE WHEN position = 'section_heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS path FROM kept)"""


def page_blocks(spark, d):
    return html.parse_pages(pages(spark, d)).select("page_id", "ord", "position", F.array_join("heading_path", " > ").alias("path"), "text")


@query("e01_html_blocks", f"SELECT page_id, ord, position, path, md5(text) AS text_md5 FROM {PAGE_BLOCKS_SQL}")
def e01(spark, d):
    return page_blocks(spark, d).select("page_id", "ord", "position", "path", F.md5("text").alias("text_md5"))


@query("e02_container_choice", rf"SELECT page_id, CASE WHEN inner_n >= 3 THEN 'article' ELSE 'body' END AS root, CASE WHEN inner_n >= 3 THEN inner_n ELSE n END AS n FROM (SELECT page_id, len(regexp_extract_all(h, '<(p|li)[ >]')) AS n, len(regexp_extract_all(regexp_extract(h, '(?s)<article[^>]*>(.*?)</article>', 1), '<(p|li)[ >]')) AS inner_n FROM {_CLEAN_SQL})")
def e02(spark, d):
    """The first main or article with three paragraphs or list items, else the body."""
    return html.roots(pages(spark, d))


@query("e03_title", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), ''), nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), ''), CAST(page_id AS VARCHAR)) AS title FROM pages")
def e03(spark, d):
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    h1 = blank(F.regexp_replace(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))
    return pages(spark, d).select("page_id", F.coalesce(h1, blank(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), F.col("page_id").cast("string")).alias("title"))


def line_pages(spark, d, end: str | None = None):
    """Documents as pages: the first line is the title, short lines are headings of two levels, lines with a quotation mark quotations.

    A line after a quotation is written as its attribution.  ``end`` names a line
    that becomes a heading at which articles end.
    """
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    quoted = lambda x: x.contains('"') & (F.length(x) > 30)
    put = lambda tag, x: F.concat(F.lit(f"<{tag}>"), plain(x), F.lit(f"</{tag}>"))
    lines = F.split("text", "\n")

    def element(x, i):
        before = F.get(lines, i - 1)
        stop = F.lit(False) if end is None else x == end
        attribution = (i > 1) & quoted(before) & (F.trim(x) != "")
        return F.when(i == 0, put("h1", x)).when(stop, F.lit("<h2>Read more</h2>")).when(quoted(x), put("blockquote", x)).when(attribution, put("p", F.concat(F.lit("— "), x))).when(F.length(x) <= 15, put("h3", x)).when(F.length(x) <= 30, put("h2", x)).otherwise(put("p", x))

    return documents(spark, d).select(F.col("doc_id").alias("page_id"), F.array_join(F.transform(lines, element), "").alias("html"))


def _line_blocks_sql(end: str | None = None) -> str:
    """The rules of the walk, stated over lines."""
    stop = f"raw = '{end}'" if end else "false"
    return rf"""(WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents
), t AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text, contains(raw, '"') AND length(raw) > 30 AS q, lag(contains(raw, '"') AND length(raw) > 30) OVER (PARTITION BY doc_id ORDER BY k) AS after_q FROM l
), e AS (SELECT doc_id, k, CASE WHEN k = 0 THEN 'h1' WHEN {stop} THEN 'stop' WHEN q THEN 'quotation' WHEN k > 1 AND after_q AND text <> '' THEN 'attribution' WHEN length(raw) <= 15 THEN 'h3' WHEN length(raw) <= 30 THEN 'h2' ELSE 'p' END AS tag, text FROM t WHERE text <> ''
), o AS (SELECT *, count(*) FILTER (tag = 'p') OVER (PARTITION BY doc_id, text) AS n, count(*) FILTER (tag IN ('h1', 'h2', 'h3')) OVER (PARTITION BY doc_id, text) AS heads, min(CASE WHEN tag = 'stop' THEN k END) OVER (PARTITION BY doc_id) AS stops FROM e
), b AS (SELECT doc_id, k, tag, CASE WHEN tag = 'quotation' AND lead(tag) OVER w = 'attribution' THEN text || ' — ' || lead(text) OVER w ELSE text END AS text, n, heads FROM o WHERE stops IS NULL OR k < stops WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), m AS (SELECT * FROM b WHERE tag IN ('h1', 'h2', 'h3', 'quotation') OR tag = 'p' AND NOT ({_DULL_SQL.format(t="text")} OR regexp_matches(text, '^[-‐-―]\s*\S') OR heads > 0 OR n >= 2 AND length(text) < 150)
), h AS (SELECT *, max(CASE WHEN tag = 'h2' THEN k END) OVER u AS k2, max(CASE WHEN tag = 'h3' THEN k END) OVER u AS k3, last_value(CASE WHEN tag = 'h2' THEN text END IGNORE NULLS) OVER u AS t2, last_value(CASE WHEN tag = 'h3' THEN text END IGNORE NULLS) OVER u AS t3 FROM m WINDOW u AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS ord, CASE tag WHEN 'h1' THEN 'title' WHEN 'h2' THEN 'section_heading' WHEN 'h3' THEN 'section_heading' WHEN 'p' THEN 'body' ELSE tag END AS position, text,
  CASE WHEN tag IN ('h1', 'h2') THEN '' ELSE concat_ws(' > ', t2, CASE WHEN tag <> 'h3' AND k3 > coalesce(k2, -1) THEN t3 END) END AS path FROM h)"""


def line_blocks(spark, d, end: str | None = None):
    b = html.parse_pages(line_pages(spark, d, end))
    return b.select(F.col("page_id").alias("doc_id"), "ord", "position", F.array_join("heading_path", " > ").alias("path"), "text")


@query("e04_heading_path", f"SELECT doc_id, ord, path FROM {_line_blocks_sql()}")
def e04(spark, d):
    """The stack of headings above each block: a heading ends those of its level and below."""
    return line_blocks(spark, d).select("doc_id", "ord", "path")


@query("e05_block_classes", f"SELECT doc_id, position, count(*) AS n FROM {_line_blocks_sql()} GROUP BY doc_id, position")
def e05(spark, d):
    return line_blocks(spark, d).groupBy("doc_id", "position").agg(F.count("*").alias("n"))


@query("e06_boilerplate_filter", rf"SELECT doc_id, ord FROM {BLOCKS_SQL} WHERE NOT {_DULL_SQL.format(t='text')}")
def e06(spark, d):
    return blocks(documents(spark, d)).where(~X.boilerplate(F.col("text"))).select("doc_id", "ord")


@query("e07_stop_at_boilerplate", f"SELECT doc_id, count(*) AS n, md5(string_agg(text, ' ' ORDER BY ord)) AS text_md5 FROM {_line_blocks_sql('All rights reserved.')} GROUP BY doc_id")
def e07(spark, d):
    """What follows a heading such as "Read more" belongs to other articles."""
    b = line_blocks(spark, d, "All rights reserved.")
    per = b.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return per.select("doc_id", "n", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), " ")).alias("text_md5"))


@query("e08_links", "SELECT page_id, link, CASE WHEN ends_with(lower(link), '.pdf') THEN 'pdf' ELSE 'html' END AS kind FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages)")
def e08(spark, d):
    rows = pages(spark, d).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("link"))
    return rows.select("page_id", "link", F.when(F.lower("link").endswith(".pdf"), "pdf").otherwise("html").alias("kind"))


@query("e09_repeated_short_lines", f"SELECT doc_id, md5(text) AS text_md5, count(*) AS n FROM {BLOCKS_SQL} WHERE length(text) < 150 GROUP BY doc_id, text HAVING count(*) >= 2")
def e09(spark, d):
    return blocks(documents(spark, d)).where(F.length("text") < 150).groupBy("doc_id", F.md5("text").alias("text_md5")).agg(F.count("*").alias("n")).where("n >= 2")


@query("e10_toc_drop", f"SELECT b.doc_id, b.ord FROM {BLOCKS_SQL} b WHERE position <> 'section_heading' AND NOT EXISTS (SELECT 1 FROM {BLOCKS_SQL} h WHERE h.position = 'section_heading' AND h.doc_id = b.doc_id AND h.text = b.text)")
def e10(spark, d):
    b = blocks(documents(spark, d))
    heads = b.where("position = 'section_heading'").select("doc_id", "text")
    return b.where("position <> 'section_heading'").join(heads, ["doc_id", "text"], "left_anti").select("doc_id", "ord")


_SAYING = ("token", "password", "secret", "key")


@query("e11_quotations", "SELECT doc_id, ord FROM " + BLOCKS_SQL + r""" WHERE regexp_matches(text, '[“”"][^“”"]{20,}[“”"]') AND regexp_matches(text, '(?i)\b(token|password|secret|key)\b')""")
def e11(spark, d):
    """A quoted span of 20 characters, and a verb: here the words that these tables quote after."""
    said = r"(?i)\b(" + "|".join(_SAYING) + r")\b"
    return blocks(documents(spark, d)).where(F.col("text").rlike(r'[“”"][^“”"]{20,}[“”"]') & F.col("text").rlike(said)).select("doc_id", "ord")


@query("e13_attribution_merge", f"SELECT doc_id, ord, md5(text) AS text_md5 FROM {_line_blocks_sql()} WHERE position = 'quotation'")
def e13(spark, d):
    """Quotations with the attribution line that follows them."""
    return line_blocks(spark, d).where("position = 'quotation'").select("doc_id", "ord", F.md5("text").alias("text_md5"))


@query("e18_publication_date", "SELECT doc_id, CASE WHEN genre = 'es' THEN NULL ELSE strftime(date, '%Y-%m-%d') END AS published FROM " + MANIFEST_SQL)
def e18(spark, d):
    """Dates as pages give them: a meta tag, a time element, a sentence, or not at all."""
    iso, said = F.date_format("date", "yyyy-MM-dd"), F.date_format("date", "d MMMM yyyy")
    meta = F.concat(F.lit('<head><meta content="'), iso, F.lit('T10:00:00Z" property="article:published_time"></head>'))
    time = F.concat(F.lit('<p>On <time class="x" datetime="'), iso, F.lit('">'), said, F.lit("</time></p>"))
    text = F.concat(F.lit("<p>Published: <b>"), said, F.lit("</b> by us</p>"))
    page = F.when(F.col("genre") == "en", meta).when(F.col("genre") == "de", time).when(F.col("genre") == "fr", text).otherwise(F.lit("<p>Published some time ago</p>"))
    return manifest(spark, d).select("doc_id", html.publication_date(page).alias("published"))


_ARTICLE = r"(?s)<article[^>]*>(.*?)</article>"


@query("a13_tiered_fallback", rf"SELECT page_id, CASE WHEN length(a) >= 2000 THEN 'article' WHEN length(p) >= 1000 THEN 'paragraphs' ELSE 'title' END AS tier, md5(CASE WHEN length(a) >= 2000 THEN a WHEN length(p) >= 1000 THEN p ELSE t END) AS content_md5 FROM (SELECT page_id, regexp_extract(html, '{_ARTICLE}', 1) AS a, array_to_string(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), ' ') AS p, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages)")
def a13(spark, d):
    """The first source whose content is good enough, and where it came from: one pass, no candidate rows."""
    h = F.col("html")
    tiers = {"article": (F.regexp_extract(h, _ARTICLE, 1), 2000), "paragraphs": (F.array_join(F.regexp_extract_all(h, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), " "), 1000), "title": (F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1), 0)}
    return pages(spark, d).select("page_id", files.first_tier(tiers).alias("t")).select("page_id", "t.tier", F.md5("t.content").alias("content_md5"))


_LINKS_SQL = """(SELECT p.page_id, p.url, length(p.html) AS n, l.k, l.link FROM pages p LEFT JOIN (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS k FROM pages) l USING (page_id))"""


@query("a14_thin_page_resolution", f"""SELECT page_id, coalesce(CASE WHEN max(n) < 3000 THEN arg_min(link, k) FILTER (good) END, CASE WHEN max(n) < 3000 THEN arg_min(link, k) FILTER (ends_with(lower(link), '.pdf')) END, max(url)) AS target
 FROM (SELECT x.*, EXISTS (SELECT 1 FROM documents d WHERE d.n_chars >= 500 AND x.link = '/' || regexp_extract(d.text, '^\\S+', 0)) AS good FROM {_LINKS_SQL} x) GROUP BY page_id""")
def a14(spark, d):
    """A thin landing page stands for the first linked document with content, else its first PDF, else itself.

    Documents are named by their first word here.
    """
    p = pages(spark, d).select("page_id", "url", (F.length("html") < 3000).alias("thin"), F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("links"))
    with_content = documents(spark, d).where("n_chars >= 500").select(F.concat(F.lit("/"), F.regexp_extract("text", r"^\S+", 0)).alias("link")).distinct()
    links = p.where("thin").select("page_id", F.posexplode("links").alias("k", "link"))
    good = links.join(with_content, "link", "left_semi").groupBy("page_id").agg(F.min_by("link", "k").alias("good"))
    pdf = F.get(F.filter("links", lambda x: F.lower(x).endswith(".pdf")), F.lit(0))
    return p.join(good, "page_id", "left").select("page_id", F.coalesce("good", F.when(F.col("thin"), pdf), "url").alias("target"))


@query("a15_archive_status", "SELECT page_id, CASE WHEN contains(url, '?') AND contains(url, '#') THEN 'ok' WHEN contains(url, '?') OR contains(url, '#') THEN 'partial' ELSE 'failed' END AS status FROM pages")
def a15(spark, d):
    """Two snapshots are ok, one is partial, none is failed; here a query and a fragment stand for them."""
    old, new = (F.col("url").contains(c).cast("int") for c in "?#")
    return pages(spark, d).select("page_id", F.element_at(F.array(F.lit("failed"), F.lit("partial"), F.lit("ok")), old + new + 1).alias("status"))


# --- sources and sinks ---------------------------------------------------------------


@query("a01_csv_round_trip", "SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def a01(spark, d):
    path = shared_path(spark, "csv")
    files.write_csv(table(spark, d, "benchmark"), path)
    return files.read_csv(spark, path, "item_id bigint, text string").select("item_id", F.md5("text").alias("text_md5"))


@query("a02_keyed_keep_last", f"SELECT unit, arg_max(question, ordinal) AS question FROM {RECORDS_SQL} GROUP BY unit")
def a02(spark, d):
    from inkfold.operators.aggregates import keep_last

    return keep_last(records(spark, d).select("unit", "question", "ordinal"), ["unit"], "ordinal").select("unit", "question")


@query("a03_commented_csv", "SELECT n_nationkey, n_name, 'STATUS partial' AS note FROM nation")
def a03(spark, d):
    """The rows, and the note that stands before them."""
    path = shared_path(spark, "commented")
    note = spark.createDataFrame([("# STATUS partial",)], "value string")
    note.unionByName(table(spark, d, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))).write.text(path)
    said = files.csv_notes(spark, path).select(F.trim("note").alias("note"))
    rows = spark.read.schema("n_nationkey int, n_name string").option("comment", "#").csv(path)
    return rows.crossJoin(F.broadcast(said.limit(1)))  # one line


@query("a04_typed_counts", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END AS n FROM documents")
def a04(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("n_chars").cast("string"))
    return documents(spark, d).select("doc_id", files.count_or_zero(raw).alias("n"))


@query("a05_spreadsheet", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS INTEGER) AS row, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def a05(spark, d):
    """A sheet's rows as text, numbered from 2 as the first one is the header."""
    path = f"{shared_path(spark, 'workbook')}.xlsx"
    rows = table(spark, d, "nation").orderBy("n_nationkey").select(F.col("n_nationkey").cast("string"), "n_name").collect()  # 25 nations
    workbook.put(spark, path, workbook.workbook([["key", "name"], *map(list, rows)]))
    return workbook.read_workbooks(spark, path).select("row", F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("name"))


def _stub(url: str) -> tuple[int, str]:
    """A service of the pages' addresses: one host is gone, and unsafe ones need a second call."""
    if "spam-farm" in url:
        raise ConnectionError("no such host")
    calls = _stub.__dict__.setdefault("calls", {})
    calls[url] = calls.get(url, 0) + 1
    return (503, "") if url.startswith("http://") and calls[url] % 2 else (404, "") if url.endswith(".html") else (200, f"page of {url}")


@query("a12_fetch_with_retry", "SELECT DISTINCT url, CAST(CASE WHEN contains(url, 'spam-farm') THEN NULL WHEN ends_with(url, '.html') THEN 404 ELSE 200 END AS INTEGER) AS status, CAST(CASE WHEN contains(url, 'spam-farm') THEN 3 WHEN starts_with(url, 'http://') THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN contains(url, 'spam-farm') THEN 'no such host' WHEN ends_with(url, '.html') THEN 'status 404' END AS error FROM pages")
def a12(spark, d):
    """Addresses that fail are asked again; what stays wrong is a row."""
    return remote.fetch_pages(pages(spark, d).select("url").distinct(), _stub).select("url", "status", "attempts", "error")


@query("a06_json_documents", "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def a06(spark, d):
    """Nested documents written as JSON, read with their schema, exploded."""
    path = shared_path(spark, "json")
    table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("blocks")).write.json(path)
    back = spark.read.schema("conv_id bigint, blocks array<struct<turn:bigint,text:string>>").json(path)
    return back.select("conv_id", F.explode("blocks").alias("b")).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("b.text")).alias("chars"))


@query("a07_tolerant_documents", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE length(d.text) END AS chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def a07(spark, d):
    """A document that cannot be read is an empty one: here those without labels."""
    docs = documents(spark, d).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n"))
    have = table(spark, d, "labels").select("doc_id", F.lit(True).alias("readable"))
    return docs.join(have, "doc_id", "left").select("doc_id", F.when(F.col("readable"), F.col("n")).otherwise(0).alias("chars"))


@query("a09_corrupt_lines_skipped", "SELECT event_id FROM events WHERE event_id % 10 <> 0")
def a09(spark, d):
    path = shared_path(spark, "jsonl")
    line = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id")))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "event_id bigint")


@query("a10_json_map", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def a10(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(files.json_map(F.col("props"), "string")).alias("e")).select("event_id", "e.key", "e.value")


@query("b05_partitioned_replace", "SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 'new' ELSE 'old' END AS version FROM documents")
def b05(spark, d):
    """Replace one partition; the others stay."""
    path = shared_path(spark, "partitions")
    docs = documents(spark, d).select("doc_id", "lang")
    files.replace_partitions(docs.withColumn("version", F.lit("old")), path, "lang")
    files.replace_partitions(docs.where("lang = 'de'").withColumn("version", F.lit("new")), path, "lang")
    return spark.read.schema("doc_id bigint, version string, lang string").parquet(path)


@query("b07_json_graph", f"SELECT unit, count(*) AS n FROM {RECORDS_SQL} GROUP BY unit")
def b07(spark, d):
    path = shared_path(spark, "graph")
    e = records(spark, d).groupBy("unit").agg(F.collect_list(F.struct("ordinal", "confidence")).alias("edges"))
    e.select(F.to_json(F.struct("unit", "edges")).alias("value")).write.text(path)
    back = spark.read.schema("unit bigint, edges array<struct<ordinal:bigint,confidence:double>>").json(path)
    return back.select("unit", F.size("edges").cast("bigint").alias("n"))


@query("b09_vector_file", "SELECT vec_id, len(embedding) AS dims FROM embeddings")
def b09(spark, d):
    path = shared_path(spark, "vectors")
    table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v")).write.parquet(path)
    return spark.read.schema("vec_id bigint, v array<float>").parquet(path).select("vec_id", F.size("v").cast("bigint").alias("dims"))


@query("b10_append_with_new_columns", "SELECT doc_id, lang, NULL AS note FROM documents WHERE n_chars < 500 UNION ALL SELECT doc_id, lang, 'late' FROM documents WHERE n_chars >= 500")
def b10(spark, d):
    """Rows with a column more are appended; the rows before have none of it."""
    path = shared_path(spark, "appended")
    docs = documents(spark, d)
    files.append(docs.where("n_chars < 500").select("doc_id", "lang"), path)
    return files.append_with_union(docs.where("n_chars >= 500").select("doc_id", "lang", F.lit("late").alias("note")), path)


# --- coding ------------------------------------------------------------------------------


def tasks(spark, d):
    """Units x questions; the questions are a fixed catalogue."""
    questions = spark.createDataFrame([("public", "Find the word public"), ("license", "Find the word license")], "question string, prompt string")
    units = documents(spark, d).select(F.format_string("%d::full", "doc_id").alias("unit_id"), F.col("text").alias("passage"))
    return units.crossJoin(F.broadcast(questions))


@query("h02_coding_function", "SELECT printf('%d::full', doc_id) AS unit_id, w AS question, contains(lower(text), w) AS applies, CASE WHEN contains(lower(text), w) THEN substr(text, instr(lower(text), w), length(w)) END AS quote FROM documents, (VALUES ('public'), ('license')) t(w)")
def h02(spark, d):
    return coding.code_units(tasks(spark, d), coding.word_coder).select("unit_id", "question", "applies", "quote")


@query("h06_model_evaluation", "SELECT w AS question, count(*) AS calls, count(*) FILTER (contains(lower(text), w)) AS applies, count(*) FILTER (contains(lower(text), w)) AS verified FROM documents, (VALUES ('public'), ('license')) t(w) GROUP BY w")
def h06(spark, d):
    r = coding.code_units(tasks(spark, d), coding.word_coder)
    return r.groupBy("question").agg(F.count("*").alias("calls"), F.count_if("applies").alias("applies"), F.count_if(F.coalesce("verified", F.lit(False))).alias("verified"))


def busy_coder(prompt: str, passage: str) -> str:
    """The word coder behind a service that refuses every first call of a passage."""
    seen = busy_coder.__dict__.setdefault("seen", set())
    if (key := hash((prompt, passage))) not in seen:
        seen.add(key)
        raise coding.TransientError("429")
    return coding.word_coder(prompt, passage)


@query("h01_retried_calls", "SELECT printf('%d::full', doc_id) AS unit_id, w AS question, contains(lower(text), w) AS applies, CAST(NULL AS VARCHAR) AS error FROM documents, (VALUES ('public'), ('license')) t(w)")
def h01(spark, d):
    """A service that is busy at first: calls are made again, and no row is lost."""
    return coding.code_units(tasks(spark, d), busy_coder).select("unit_id", "question", "applies", "error")


@query("h03_document_function", "SELECT doc_id, CASE WHEN contains(lower(left(text, 12000)), 'license') THEN 'legal' ELSE 'other' END AS profile, lang AS genre FROM documents")
def h03(spark, d):
    """One call for each document, with its context line and its first 12,000 characters."""
    docs = documents(spark, d).select("doc_id", F.concat_ws(" | ", "lang", "source").alias("context"), F.left("text", F.lit(12_000)).alias("passage"))

    def profile(prompt: str, passage: str) -> str:
        return '{"profile": "%s", "genre": "%s"}' % ("legal" if "license" in passage.lower() else "other", prompt.split(" | ")[0])

    return coding.profile_documents(docs, profile, ["profile", "genre"]).select("doc_id", "profile", "genre")


@query("h07_embedding_function", "SELECT doc_id, CAST(768 AS BIGINT) AS dims, CASE WHEN length(text) > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS norm FROM documents")
def h07(spark, d):
    """Texts to unit vectors by an encoder that is given: here hashed letters."""
    v = coding.embed(documents(spark, d).select("doc_id", "text"), coding.letter_encoder, dims=768)
    return v.select("doc_id", F.size("embedding").cast("bigint").alias("dims"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 5).alias("norm"))


@query("h08_probe_before_overwrite", "SELECT item_id, 'kept' AS run FROM benchmark")
def h08(spark, d):
    """A service that does not answer leaves the last output as it is."""
    path = shared_path(spark, "probed")
    items = table(spark, d, "benchmark").select("item_id")
    coding.write_if_available(lambda: True, items.withColumn("run", F.lit("kept")), path)
    coding.write_if_available(lambda: 1 / 0, items.withColumn("run", F.lit("new")), path)
    return spark.read.schema("item_id bigint, run string").parquet(path)


@query("h05_resumed_run", "SELECT printf('%d::full', doc_id) AS unit_id, w AS question, CASE WHEN w = 'license' THEN 1 ELSE 2 END AS run FROM documents, (VALUES ('public'), ('license')) t(w)")
def h05(spark, d):
    """A run that stopped half way is taken up: only pairs without a record are coded, and what was flushed stays."""
    path = shared_path(spark, "records")
    t = tasks(spark, d)
    for run, some in ((1, t.where("question = 'license'")), (2, t)):
        coding.resume(some, coding.word_coder, path, run)
    return coding.flushed(spark, path).select("unit_id", "question", "run")


@query("n03_resumable_queue", f"SELECT printf('%d::full', doc_id) AS unit_id, w AS question FROM documents, (VALUES ('public'), ('license')) t(w) WHERE NOT (w = 'public' AND contains(lower(text), 'public'))")
def n03(spark, d):
    t = tasks(spark, d).select("unit_id", "question", "passage")
    done = t.where((F.col("question") == "public") & F.lower("passage").contains("public")).select("unit_id", "question")
    return t.select("unit_id", "question").join(done, ["unit_id", "question"], "left_anti")


# --- streams -----------------------------------------------------------------------------


@query("n01_incremental_intake", "SELECT doc_id FROM documents WHERE n_chars >= 500")
def n01(spark, d):
    base = shared_path(spark, "intake")
    like = documents(spark, d).limit(0)
    intake.admit(intake.stream_parquet(spark, f"{d}/documents.parquet", like), F.col("n_chars") >= 500, f"{base}/table", f"{base}/checkpoint")
    return spark.read.schema("doc_id bigint, batch int").option("basePath", f"{base}/table").parquet(f"{base}/table").select("doc_id")


@query("n02_version_filter", f"SELECT doc_id, CAST(1 + 12 * (year(date) - 2024) + month(date) - 1 AS INTEGER) AS corpus_version FROM {MANIFEST_SQL} WHERE 12 * (year(date) - 2024) + month(date) <= 12")
def n02(spark, d):
    """The corpus grows by a version a month; the first year's corpus is a filter."""
    version = (12 * (F.year("date") - 2024) + F.month("date")).cast("int")
    return manifest(spark, d).select("doc_id", version.alias("corpus_version")).where("corpus_version <= 12")


@query("x01_tumbling_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x01(spark, d):
    """An addition: the same plan runs on a stream with a watermark."""
    return intake.tumbling(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("x02_session_windows", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(flag) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS flag FROM events)) GROUP BY user_id, s")
def x02(spark, d):
    return intake.sessions(table(spark, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
