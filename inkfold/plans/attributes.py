"""Queries of projections, classifiers and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkfold.functions import text as X
from inkfold.plans.registry import query
from inkfold.sources.relations import BLOCKS_SQL, MANIFEST_SQL, RECORDS_SQL, blocks, documents, manifest, records, table

_CUT = "SELECT doc_id, min(ord) AS cut FROM " + BLOCKS_SQL + " WHERE contains(lower(text), 'license') GROUP BY doc_id"


@query("c01_prefix_cutoff", f"SELECT b.doc_id, b.ord, md5(b.text) AS text_md5 FROM {BLOCKS_SQL} b LEFT JOIN ({_CUT}) USING (doc_id) WHERE cut IS NULL OR ord < cut")
def c01(spark, d):
    """Rows before the first one that holds the marker."""
    # A document's lines stand together: the marker's place is found where they are.
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda x: F.lower(x).contains("license"))
    end = F.coalesce(F.nullif(F.array_position(marked, True), F.lit(0)) - 1, F.size(lines))
    return documents(spark, d).select("doc_id", F.posexplode(F.slice(lines, F.lit(1), end.cast("int"))).alias("ord", "text")).select("doc_id", "ord", F.md5("text").alias("text_md5"))


@query("c02_non_empty_rows", r"SELECT conv_id, turn FROM conversations WHERE coalesce(nullif(trim(text), ''), nullif(trim(role), '')) IS NOT NULL AND conv_id IS NOT NULL AND regexp_matches(role, '^(user|assistant)$')")
def c02(spark, d):
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "conversations").where(F.coalesce(blank("text"), blank("role")).isNotNull() & F.col("conv_id").isNotNull() & F.col("role").rlike("^(user|assistant)$")).select("conv_id", "turn")


_KEY = r"^https?://([^/]+)/([a-z]{2})/([0-9]+)"


@query("c03_key_parse", rf"SELECT page_id, regexp_extract(url, '{_KEY}', 1) AS host, regexp_extract(url, '{_KEY}', 2) AS lang, regexp_extract(url, '{_KEY}', 3) AS number FROM pages WHERE regexp_matches(url, '{_KEY}')")
def c03(spark, d):
    part = lambda k: F.regexp_extract("url", _KEY, k)
    return table(spark, d, "pages").where(F.col("url").rlike(_KEY)).select("page_id", part(1).alias("host"), part(2).alias("lang"), part(3).alias("number"))


@query("c04_trivalent_status", "SELECT o_orderkey, CASE WHEN upper(trim(o_orderstatus)) IN ('1', '1.0', 'F') THEN 'present' WHEN upper(trim(o_orderstatus)) IN ('0', '0.0', 'O') THEN 'absent' WHEN contains(lower(o_orderstatus), 'p') THEN 'variant' ELSE 'check' END AS status FROM orders")
def c04(spark, d):
    s = F.upper(F.trim("o_orderstatus"))
    status = F.when(s.isin("1", "1.0", "F"), "present").when(s.isin("0", "0.0", "O"), "absent").when(F.lower("o_orderstatus").contains("p"), "variant").otherwise("check")
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"))


@query("c05_speaker_classifier", f"SELECT doc_id, CASE WHEN family = 'src0' THEN 'company' WHEN contains(family, '1') AND genre = 'en' THEN 'government' WHEN genre IN ('de', 'fr') THEN 'partner' ELSE 'other' END AS speaker FROM {MANIFEST_SQL}")
def c05(spark, d):
    s = F.when(F.col("family") == "src0", "company").when(F.col("family").contains("1") & (F.col("genre") == "en"), "government").when(F.col("genre").isin("de", "fr"), "partner").otherwise("other")
    return manifest(spark, d).select("doc_id", s.alias("speaker"))


_FAMILIES = ["apache", "gnu", "mit license", "copyright", "cc by"]


@query("c06_family_classifier", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{f}') THEN '{f}'" for f in _FAMILIES) + " ELSE 'None' END AS family FROM documents")
def c06(spark, d):
    """The first family in list order that the text names, else the value "None"."""
    t, out = F.lower("text"), F.lit("None")
    for f in reversed(_FAMILIES):
        out = F.when(t.contains(f), f).otherwise(out)
    return documents(spark, d).select("doc_id", out.alias("family"))


_HOST = r"^[a-z]+://([^/?#]+)"


@query("c07_page_genre", rf"SELECT page_id, CASE WHEN starts_with(regexp_extract(url, '{_HOST}', 1), 'blog.') THEN 'BLOG' WHEN starts_with(regexp_extract(url, '{_HOST}', 1), 'm.') THEN 'MOBILE' WHEN contains(url, '?page=') THEN 'LIST' ELSE 'PAGE' END AS genre FROM pages")
def c07(spark, d):
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    g = F.when(host.startswith("blog."), "BLOG").when(host.startswith("m."), "MOBILE").when(F.col("url").contains("?page="), "LIST").otherwise("PAGE")
    return table(spark, d, "pages").select("page_id", g.alias("genre"))


@query("c08_host_predicate", rf"SELECT page_id FROM pages WHERE len(list_filter(['blog.', 'm.', 'th'], lambda h: contains(regexp_extract(url, '{_HOST}', 1), h))) > 0")
def c08(spark, d):
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    return table(spark, d, "pages").where(F.exists(F.array(*map(F.lit, ("blog.", "m.", "th"))), lambda h: host.contains(h))).select("page_id")


@query("c11_definitional_status", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'defined' WHEN contains(lower(d.text), 'license') THEN 'used' ELSE 'not_present' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)")
def c11(spark, d):
    defined = table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("defined")).distinct()
    s = F.when(F.col("defined"), "defined").when(F.lower("text").contains("license"), "used").otherwise("not_present")
    return documents(spark, d).join(defined, "doc_id", "left").select("doc_id", s.alias("status"))


@query("c12_published_first", f"SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN a.date < b.date THEN 'a' WHEN a.date > b.date THEN 'b' ELSE 'same_day' END AS first FROM {MANIFEST_SQL} a JOIN {MANIFEST_SQL} b ON b.doc_id = a.doc_id * 7 + 3")
def c12(spark, d):
    a, b = manifest(spark, d).alias("a"), manifest(spark, d).select((F.col("doc_id")).alias("b"), F.col("date").alias("b_date"))
    first = F.when(F.col("date") < F.col("b_date"), "a").when(F.col("date") > F.col("b_date"), "b").otherwise("same_day")
    return a.join(b, F.col("b") == F.col("doc_id") * 7 + 3).select(F.col("doc_id").alias("a"), "b", first.alias("first"))


@query("c13_best_url", "SELECT page_id, coalesce(nullif(regexp_extract(html, 'canonical\" href=\"([^\"]*)\"', 1), ''), nullif(trim(url), '')) AS best FROM pages")
def c13(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("html", 'canonical" href="([^"]*)"', 1), F.lit("")), F.nullif(F.trim("url"), F.lit(""))).alias("best"))


@query("c14_classification_sheet", f"SELECT doc_id, genre, family, CAST(date AS VARCHAR) AS date, substr(CAST(date AS VARCHAR), 1, 4) AS year FROM {MANIFEST_SQL}")
def c14(spark, d):
    iso = F.col("date").cast("string")
    return manifest(spark, d).select("doc_id", "genre", "family", iso.alias("date"), F.substring(iso, 1, 4).alias("year"))


@query("c15_successful_passages", f"SELECT ordinal, unit, question FROM {RECORDS_SQL} WHERE coalesce(error, '') = '' AND confidence > 0 AND coalesce(payload, '') <> ''")
def c15(spark, d):
    return records(spark, d).where("coalesce(error, '') = '' AND confidence > 0 AND coalesce(payload, '') <> ''").select("ordinal", "unit", "question")


@query("c16_search_all_columns", "SELECT c_custkey FROM customer WHERE len(list_filter([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)], lambda x: contains(lower(x), 'build'))) > 0")
def c16(spark, d):
    cols = F.array(*(F.col(c).cast("string") for c in ("c_name", "c_mktsegment", "c_nationkey")))
    return table(spark, d, "customer").where(F.exists(cols, lambda x: F.lower(x).contains("build"))).select("c_custkey")


@query("c17_document_context", f"SELECT doc_id, concat_ws(' | ', coalesce(CAST(date AS VARCHAR), '?'), coalesce(genre, '?'), coalesce(family, '?')) AS context FROM {MANIFEST_SQL}")
def c17(spark, d):
    return manifest(spark, d).select("doc_id", F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("date", "genre", "family"))).alias("context"))


@query("c18_prompt_fill", "SELECT item_id, md5(replace(replace('Context: {context}. Passage: {text}', '{context}', CAST(item_id AS VARCHAR)), '{text}', text)) AS prompt_md5 FROM benchmark")
def c18(spark, d):
    filled = F.replace(F.replace(F.lit("Context: {context}. Passage: {text}"), F.lit("{context}"), F.col("item_id").cast("string")), F.lit("{text}"), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.md5(filled).alias("prompt_md5"))


@query("c19_truncations", "SELECT doc_id, length(left(text, 12000)) AS document, length(left(text, 1500)) AS embedded, md5(left(text, 120)) AS heading_md5 FROM documents")
def c19(spark, d):
    n = lambda k: F.length(F.left("text", F.lit(k))).cast("bigint")
    return documents(spark, d).select("doc_id", n(12000).alias("document"), n(1500).alias("embedded"), F.md5(F.left("text", F.lit(120))).alias("heading_md5"))


_STOP = ["a", "of", "the", "and", "in", "to"]


@query(
    "c20_slug_ids",
    f"""WITH s AS (SELECT item_id, left(array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w))[1:6], lambda w: upper(w[1]) || w[2:]), ''), 60) AS slug FROM benchmark)
    SELECT item_id, slug || CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY item_id) > 1 THEN CAST(row_number() OVER (PARTITION BY slug ORDER BY item_id) AS VARCHAR) ELSE '' END AS slug FROM s""",
)
def c20(spark, d):
    """First six words that are no stop words, in camel case; collisions are numbered from 2."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(_STOP))
    camel = F.left(F.array_join(F.transform(F.slice(words, 1, 6), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), ""), F.lit(60))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("item_id"))
    return table(spark, d, "benchmark").select("item_id", camel.alias("slug")).select("item_id", F.concat("slug", F.when(n > 1, n.cast("string")).otherwise("")).alias("slug"))


@query("c21_short_label", "SELECT p_partkey, regexp_replace(replace(p_name, ' ', '_'), '^([^_]*_){2}', '') AS label FROM part")
def c21(spark, d):
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(F.replace("p_name", F.lit(" "), F.lit("_")), "^([^_]*_){2}", "").alias("label"))


@query("c22_seed_override", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') THEN 'metal' WHEN contains(lower(p_type), 'all') THEN 'everyone' ELSE lower(p_type) END AS name FROM part")
def c22(spark, d):
    t = F.lower("p_type")
    return table(spark, d, "part").select("p_partkey", F.when(t.contains("steel") | t.contains("tin"), "metal").when(t.contains("all"), "everyone").otherwise(t).alias("name"))


@query("c23_phase_status", f"SELECT question, CASE WHEN count(nullif(error IS NULL, FALSE)) = count(*) THEN 'done' WHEN count(nullif(error IS NULL, FALSE)) > 0 THEN 'in progress' ELSE 'pending' END AS status FROM {RECORDS_SQL} GROUP BY question")
def c23(spark, d):
    ok = F.count_if(F.col("error").isNull())
    return records(spark, d).groupBy("question").agg(F.when(ok == F.count("*"), "done").when(ok > 0, "in progress").otherwise("pending").alias("status"))


# --- scalar functions ------------------------------------------------------------


@query("g01_case_and_trim", "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, trim('  ' || n_name || ' ') AS t, ltrim('  ' || n_name) AS l, rtrim(n_name || '  ') AS r, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM nation")
def g01(spark, d):
    n = F.col("n_name")
    pad = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    return table(spark, d, "nation").select("n_nationkey", F.lower(n).alias("lo"), F.upper(n).alias("up"), F.trim(pad("  ", " ")).alias("t"), F.ltrim(pad("  ", "")).alias("l"), F.rtrim(pad("", "  ")).alias("r"), F.initcap(n).alias("title"))


@query("g02_find", "SELECT p_partkey, contains(p_name, 'e') AS has, starts_with(p_name, 'a') AS head, ends_with(p_name, 'e') AS tail, instr(p_name, 'e') AS first, CASE WHEN contains(p_name, 'e') THEN length(p_name) - instr(reverse(p_name), 'e') + 1 ELSE 0 END AS last, length(p_name) - length(replace(p_name, 'e', '')) AS n FROM part")
def g02(spark, d):
    p, e = F.col("p_name"), F.lit("e")
    last = F.when(p.contains("e"), F.length(p) - F.position(e, F.reverse(p)) + 1).otherwise(0)
    return table(spark, d, "part").select("p_partkey", p.contains("e").alias("has"), p.startswith("a").alias("head"), p.endswith("e").alias("tail"), F.position(e, p).cast("bigint").alias("first"), last.cast("bigint").alias("last"), (F.length(p) - F.length(F.replace(p, e, F.lit("")))).cast("bigint").alias("n"))


@query("g03_split_join_pad", "SELECT p_partkey, string_split(p_name, ' ')[1] AS head, array_to_string(list_reverse(string_split(p_name, ' ')), '-') AS back, substr(p_name, 2, 5) AS cut, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded FROM part")
def g03(spark, d):
    w = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.get(w, F.lit(0)).alias("head"), F.array_join(F.reverse(w), "-").alias("back"), F.substring("p_name", 2, 5).alias("cut"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"))


@query("g04_regex", r"SELECT doc_id, regexp_matches(text, '\d{4}') AS has_number, regexp_extract(text, '([A-Z]\w+) ([a-z]+)', 2) AS second, len(regexp_extract_all(text, '[,;]')) AS commas, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked_md5 FROM documents")
def g04(spark, d):
    return documents(spark, d).select("doc_id", F.col("text").rlike(r"\d{4}").alias("has_number"), F.regexp_extract("text", r"([A-Z]\w+) ([a-z]+)", 2).alias("second"), F.regexp_count("text", F.lit("[,;]")).cast("bigint").alias("commas"), F.md5(F.regexp_replace("text", "[0-9]+", "#")).alias("masked_md5"))


@query("g05_url_parts", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def g05(spark, d):
    part = lambda *a: F.parse_url(F.col("url"), *map(F.lit, a))
    return table(spark, d, "pages").select("page_id", part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY", "page").alias("page"))


@query("g06_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def g06(spark, d):
    return documents(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"))


@query("g08_dates", f"SELECT doc_id, strftime(strptime(CAST(date AS VARCHAR), '%Y-%m-%d'), '%d.%m.%Y') AS parsed, year(date) AS year, date BETWEEN DATE '2024-06-01' AND DATE '2025-06-30' AS inside FROM {MANIFEST_SQL}")
def g08(spark, d):
    return manifest(spark, d).select("doc_id", F.date_format(F.to_date(F.col("date").cast("string")), "dd.MM.yyyy").alias("parsed"), F.year("date").cast("bigint").alias("year"), F.col("date").between(F.lit("2024-06-01").cast("date"), F.lit("2025-06-30").cast("date")).alias("inside"))


@query("g09_bankers_rounding", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS half FROM lineitem")
def g09(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2, 0).cast("bigint").alias("half"))


@query("g10_json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def g10(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("g11_get_with_default", "SELECT doc_id, coalesce(CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' END, 'other') AS name FROM documents")
def g11(spark, d):
    names = F.create_map(*map(F.lit, ("en", "English", "de", "German")))
    return documents(spark, d).select("doc_id", F.coalesce(F.try_element_at(names, F.col("lang")), F.lit("other")).alias("name"))


@query("g13_pairs_of_n", f"SELECT genre, count(*) * (count(*) - 1) // 2 AS pairs FROM {MANIFEST_SQL} GROUP BY genre")
def g13(spark, d):
    n = F.count("*")
    return manifest(spark, d).groupBy("genre").agg(((n * (n - 1)) / 2).cast("bigint").alias("pairs"))


@query("g14_snapshot_status", "SELECT page_id, CASE WHEN starts_with(url, 'https://') AND length(html) >= 2000 THEN 'ok' WHEN starts_with(url, 'https://') OR length(html) >= 2000 THEN 'partial' ELSE 'failed' END AS status FROM pages")
def g14(spark, d):
    """Ordered cases: both conditions, either, none."""
    safe, full = F.col("url").startswith("https://"), F.length("html") >= 2000
    return table(spark, d, "pages").select("page_id", F.when(safe & full, "ok").when(safe | full, "partial").otherwise("failed").alias("status"))


@query("e17_cleaning", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), ' +', ' ', 'g'))) AS clean_md5 FROM documents")
def e17(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.cleaned(F.col("text"))).alias("clean_md5"))


# --- answers -----------------------------------------------------------------------


@query("f11_quote_verification", "SELECT d.doc_id, contains(d.text, coalesce(b.text, '')) AS verified FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 50")
def f11(spark, d):
    """A quote is verified when the passage holds it; an empty or missing one always is."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("m"), F.col("text").alias("quote"))
    return documents(spark, d).withColumn("m", F.col("doc_id") % 50).join(q, "m", "left").select("doc_id", F.col("text").contains(F.coalesce("quote", F.lit(""))).alias("verified"))


@query("f12_answer_summary", "SELECT ordinal, 'k=' || json_extract_string(payload, '$.k') AS summary FROM " + RECORDS_SQL)
def f12(spark, d):
    m = F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, v: k != "verbatim_quote")
    return records(spark, d).select("ordinal", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ").alias("summary"))


@query("f13_label_extraction", "SELECT ordinal, coalesce(nullif(regexp_extract('x=1; k=' || json_extract_string(payload, '$.k') || '; z', 'k=([^;]+)', 1), ''), left(payload, 30)) AS label FROM " + RECORDS_SQL)
def f13(spark, d):
    s = F.concat(F.lit("x=1; k="), F.get_json_object("payload", "$.k"), F.lit("; z"))
    return records(spark, d).select("ordinal", F.coalesce(F.nullif(F.regexp_extract(s, "k=([^;]+)", 1), F.lit("")), F.left("payload", F.lit(30))).alias("label"))


@query("f14_slugify", "SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), 40) AS slug FROM part")
def f14(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query("f15_expression_normalise", r"SELECT c_custkey, regexp_replace(lower(trim(c_name)), '\s+', ' ', 'g') AS expression FROM customer")
def f15(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.regexp_replace(F.lower(F.trim("c_name")), r"\s+", " ").alias("expression"))


@query("f16_fenced_json", "SELECT ordinal, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM " + RECORDS_SQL)
def f16(spark, d):
    """The outermost braces of a fenced answer, parsed."""
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.col("payload"), F.lit("\n```\nDone."))
    return records(spark, d).select("ordinal", F.get_json_object(X.json_in_answer(answer), "$.k").cast("bigint").alias("k"))
