"""Queries over documents: lexicon, sections, classification, echoes, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.functions import text as X
from inkfold.operators import echo, lexicon
from inkfold.operators.aggregates import zero_filled
from inkfold.plans.registry import query
from inkfold.sources.relations import BLOCKS_SQL, HEADING_CHARS, MANIFEST_SQL, documents, manifest, table

# A pattern with a lookahead has no RE2 form: all matches less those with the plural guard.
_N = "(len(regexp_extract_all({t}, '(?i)license')) - len(regexp_extract_all({t}, '(?i)licensed')) + len(regexp_extract_all({t}, '(?i)general public license')) + len(regexp_extract_all({t}, '(?i)gnu general public license')))"
_V = "(len(regexp_extract_all({t}, '(?i)licensed')) + len(regexp_extract_all({t}, '(?i)released under')))"
_D = "(len(regexp_extract_all({t}, '(?i)the public')) + len(regexp_extract_all({t}, '(?i)everyone')) + len(regexp_extract_all({t}, '(?i)copyright')))"
COUNTS_SQL = f"(SELECT doc_id, {_N.format(t='text')} AS n_nominal, {_V.format(t='text')} AS n_variant, {_D.format(t='text')} AS n_distributive FROM documents)"
STATUS_SQL = f"(SELECT *, CASE WHEN n_nominal > 0 THEN 'present' WHEN n_variant > 0 THEN 'variant' ELSE 'absent' END AS term_status FROM {COUNTS_SQL})"
SECTIONS_SQL = f"""(SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS BIGINT) AS section_idx, coalesce(heading, '(start)') AS heading, n_blocks, text
 FROM (SELECT doc_id, run, count(*) AS n_blocks, string_agg(text, chr(10) ORDER BY ord) AS text, max(CASE WHEN position = 'section_heading' THEN substr(text, 1, 120) END) AS heading
 FROM (SELECT *, sum(CASE WHEN position = 'section_heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM {BLOCKS_SQL}) GROUP BY doc_id, run))"""


def counts(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.term_counts(documents(spark, d))


def status(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).withColumn("term_status", lexicon.term_status(F.col("n_nominal"), F.col("n_variant")))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.document_sections(documents(spark, d), HEADING_CHARS)


@query("f02_lexicon_counts", f"SELECT doc_id, n_nominal, n_variant, n_distributive FROM {COUNTS_SQL}")
def f02(spark, d):
    return counts(spark, d).drop("nominal_forms")


@query("f01_lexicon_forms", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '(?i)gnu general public license|license[d]?'), lambda x: lower(x) <> 'licensed'), lambda x: lower(x)))), '; ') AS forms FROM documents")
def f01(spark, d):
    hits = F.regexp_extract_all("text", F.lit("(?iu)gnu general public license|license(?!d)"), F.lit(0))
    return documents(spark, d).select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(hits, F.lower))), "; ").alias("forms"))


@query("c09_term_status", f"SELECT doc_id, term_status FROM {STATUS_SQL}")
def c09(spark, d):
    return status(spark, d).select("doc_id", "term_status")


_SPINE = ["en", "de", "es", "fr", "it"]


@query(
    "i04_status_by_genre",
    f"""SELECT g.genre, count(m.doc_id) AS n_docs, count(*) FILTER (term_status = 'present') AS n_present, count(*) FILTER (term_status = 'variant') AS n_variant,
    count(*) FILTER (term_status = 'absent') AS n_absent, CAST(coalesce(sum(n_nominal), 0) AS BIGINT) AS nominal_hits
    FROM (VALUES ('en'), ('de'), ('es'), ('fr'), ('it')) g(genre) LEFT JOIN {MANIFEST_SQL} m USING (genre) LEFT JOIN {STATUS_SQL} s ON s.doc_id = m.doc_id GROUP BY g.genre""",
)
def i04(spark, d):
    """The flagship cross-tab: term status by genre, with rows for genres that have none."""
    spine = spark.createDataFrame([(g,) for g in _SPINE], "genre string")
    # Both attributes come from one scan: no join is needed.
    hits = [X.pattern_counts(F.col("text"), lexicon.LEXICON[c]) for c in ("nominal", "variant")]
    joined = documents(spark, d).select(F.col("lang").alias("genre"), hits[0].alias("n_nominal"), lexicon.term_status(*hits).alias("term_status"))
    n = lambda s: F.count_if(F.col("term_status") == s)
    per = joined.groupBy("genre").agg(F.count("*").alias("n_docs"), n("present").alias("n_present"), n("variant").alias("n_variant"), n("absent").alias("n_absent"), F.sum("n_nominal").alias("nominal_hits"))
    return spine.join(per, "genre", "left").na.fill(0)


@query("d07_zero_filled_spine", f"SELECT g.genre, count(m.doc_id) AS n FROM (VALUES ('en'), ('de'), ('es'), ('fr'), ('it')) g(genre) LEFT JOIN {MANIFEST_SQL} m USING (genre) GROUP BY g.genre")
def d07(spark, d):
    spine = spark.createDataFrame([(g,) for g in _SPINE], "genre string")
    return zero_filled(spine, manifest(spark, d).groupBy("genre").agg(F.count("*").alias("n")), ["genre"])


_TIER_SQL = "CASE WHEN family = 'src1' THEN 'T1' WHEN regexp_matches(lower(text), 'government|public|license|release|copyright|apache') THEN 'T2' ELSE 'T3' END"


def tier(family, text):
    return F.when(family == "src1", "T1").when(F.lower(text).rlike("government|public|license|release|copyright|apache"), "T2").otherwise("T3")


@query("c10_tier", f"SELECT doc_id, {_TIER_SQL} AS tier FROM (SELECT doc_id, source AS family, text FROM documents)")
def c10(spark, d):
    return documents(spark, d).select("doc_id", tier(F.col("source"), F.col("text")).alias("tier"))


@query("i05_status_by_tier", f"SELECT tier, term_status, count(*) AS n FROM (SELECT doc_id, {_TIER_SQL} AS tier FROM (SELECT doc_id, source AS family, text FROM documents)) JOIN {STATUS_SQL} USING (doc_id) GROUP BY tier, term_status")
def i05(spark, d):
    # Both attributes come from one scan: no join is needed.
    docs = documents(spark, d)
    n = [X.pattern_counts(F.col("text"), lexicon.LEXICON[c]) for c in ("nominal", "variant")]
    return docs.select(tier(F.col("source"), F.col("text")).alias("tier"), lexicon.term_status(*n).alias("term_status")).groupBy("tier", "term_status").agg(F.count("*").alias("n"))


@query("e19_sections", f"SELECT doc_id, section_idx, heading, n_blocks, md5(text) AS text_md5 FROM {SECTIONS_SQL}")
def e19(spark, d):
    return parts(spark, d).select("doc_id", "section_idx", "heading", "n_blocks", F.md5("text").alias("text_md5"))


@query("e20_reassembly", f"SELECT doc_id, md5(string_agg(text, ' ' ORDER BY ord)) AS joined_md5 FROM {BLOCKS_SQL} GROUP BY doc_id")
def e20(spark, d):
    # A document's blocks are its own lines: they are joined where they stand.
    return documents(spark, d).select("doc_id", F.md5(F.array_join(F.split("text", "\n"), " ")).alias("joined_md5"))


_HIT = "(" + _N.format(t="text") + " + " + _V.format(t="text") + " + " + _D.format(t="text") + ")"
UNITS_SQL = f"""(WITH hit AS (SELECT printf('%d::s%02d', doc_id, section_idx) AS unit_id, doc_id, 'lexicon' AS retrieval, length(text) AS chars FROM {SECTIONS_SQL} WHERE {_HIT} > 0)
 SELECT * FROM hit UNION ALL SELECT printf('%d::full', doc_id), doc_id, 'full_short_doc', length(text) FROM documents WHERE length(text) <= 9000 AND doc_id NOT IN (SELECT doc_id FROM hit))"""


def units(spark, d):
    return lexicon.coding_units(documents(spark, d), HEADING_CHARS)


@query("f05_coding_units", f"SELECT * FROM {UNITS_SQL}")
def f05(spark, d):
    return units(spark, d)


@query("f03_lexicon_retrieval", f"SELECT * FROM {UNITS_SQL} WHERE retrieval = 'lexicon'")
def f03(spark, d):
    return units(spark, d).where("retrieval = 'lexicon'")


@query("q03_uncovered_documents", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {UNITS_SQL})")
def q03(spark, d):
    return documents(spark, d).select("doc_id").join(units(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")


@query("k01_union_of_modes", f"SELECT retrieval, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM {UNITS_SQL} GROUP BY retrieval")
def k01(spark, d):
    return units(spark, d).groupBy("retrieval").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


# --- echoes -----------------------------------------------------------------

_NORM = r"trim(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}_'']+', ' ', 'g'))"
ECHO_SQL = rf"""(WITH w AS (
  SELECT 'a' AS side, item_id AS doc, string_split({_NORM.format(t='text')}, ' ') AS w FROM benchmark
  UNION ALL SELECT 'b', doc_id, string_split({_NORM.format(t='text')}, ' ') FROM documents
), g AS (SELECT side, doc, p, array_to_string(list_slice(w, p, p + 5), ' ') AS gram FROM w, unnest(range(1, len(w) - 4)) AS t(p)
), m AS (SELECT a.doc AS a, b.doc AS b, a.p AS i, b.p AS j, a.gram FROM g a JOIN g b ON a.side = 'a' AND b.side = 'b' AND a.gram = b.gram
), r AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS island FROM m
), s AS (SELECT a, b, min(i) AS i, max(i) AS l FROM r GROUP BY a, b, i - j, island
), f AS (SELECT DISTINCT a, b, l - i + 6 AS n_words, array_to_string(list_slice(w, i, l + 5), ' ') AS phrase FROM s JOIN w ON side = 'a' AND doc = a
) SELECT a AS item_id, b AS doc_id, n_words, phrase FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.a = x.a AND y.b = x.b AND y.n_words > x.n_words AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')))"""


def echoes(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), "text")
    found = echo.shared_phrases(items, documents(spark, d).select(F.col("doc_id").alias("doc"), "text"))
    return found.select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), "n_words", "phrase")


@query("f07_echo_phrases", f"SELECT * FROM {ECHO_SQL}")
def f07(spark, d):
    return echoes(spark, d)


@query("f08_formulaic", f"SELECT e.item_id, e.doc_id, e.phrase, count(DISTINCT lang) OVER (PARTITION BY phrase) >= 2 AS formulaic FROM {ECHO_SQL} e JOIN documents USING (doc_id)".replace("count(DISTINCT lang) OVER (PARTITION BY phrase)", "(SELECT count(DISTINCT d2.lang) FROM e2 JOIN documents d2 USING (doc_id) WHERE e2.phrase = e.phrase)").replace("SELECT e.item_id", f"WITH e2 AS (SELECT * FROM {ECHO_SQL}) SELECT e.item_id", 1).replace(f"FROM {ECHO_SQL} e JOIN", "FROM e2 e JOIN"))
def f08(spark, d):
    found = echoes(spark, d).join(documents(spark, d).select("doc_id", F.col("lang").alias("family")), "doc_id")
    return echo.formulaic(found).select("item_id", "doc_id", "phrase", "formulaic")


#: Items belong to the family whose article word they hold first in this order.
_FAMILY_SQL = "CASE WHEN contains(lower(text), ' the ') THEN 'en' WHEN contains(lower(text), ' der ') THEN 'de' WHEN contains(lower(text), ' les ') THEN 'fr' ELSE 'es' END"
FAMILY_ECHO_SQL = rf"""(SELECT e.*, lang AS family, CASE WHEN DATE '2025-04-01' < m.date THEN 'government' WHEN m.date < DATE '2025-04-01' THEN 'company' ELSE 'same_day' END AS published_first
 FROM {ECHO_SQL} e JOIN documents d USING (doc_id) JOIN (SELECT item_id, {_FAMILY_SQL} AS family FROM benchmark) i ON i.item_id = e.item_id AND i.family = d.lang JOIN {MANIFEST_SQL} m ON m.doc_id = d.doc_id)"""


def family_echoes(spark, d):
    """Echoes of items in documents of their own family, and which side was first; items are of 1 April 2025."""
    t = F.lower("text")
    family = F.when(t.contains(" the "), "en").when(t.contains(" der "), "de").when(t.contains(" les "), "fr").otherwise("es")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), "text", family.alias("family"))
    found = echo.shared_phrases(items, documents(spark, d).select(F.col("doc_id").alias("doc"), "text", F.col("lang").alias("family")))
    dated = found.join(manifest(spark, d).select(F.col("doc_id").alias("b"), "date"), "b")
    day = F.lit("2025-04-01").cast("date")
    first = F.when(day < F.col("date"), "government").when(F.col("date") < day, "company").otherwise("same_day")
    return dated.select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), "n_words", "phrase", "family", first.alias("published_first"))


@query("d08_echoes_within_family", f"SELECT family, item_id, doc_id, n_words, phrase, published_first FROM {FAMILY_ECHO_SQL}")
def d08(spark, d):
    return family_echoes(spark, d)


@query("i13_echo_pairs", f"SELECT item_id, doc_id, count(*) AS n, max(n_words) AS longest, arg_max(phrase, {{'n': n_words, 'p': phrase}}) AS phrase FROM {ECHO_SQL} GROUP BY item_id, doc_id")
def i13(spark, d):
    """Echoes of each pair, and the longest one (of equal ones the last in order)."""
    return echoes(spark, d).groupBy("item_id", "doc_id").agg(F.count("*").alias("n"), F.max("n_words").alias("longest"), F.max_by("phrase", F.struct("n_words", "phrase")).alias("phrase"))


@query("i15_echo_by_family", f"""WITH e AS (SELECT * FROM {FAMILY_ECHO_SQL}), f AS (SELECT phrase, count(DISTINCT family) >= 2 AS formulaic FROM e GROUP BY phrase)
SELECT family, count(*) AS n, count(*) FILTER (formulaic) AS n_formulaic, max(n_words) FILTER (NOT formulaic) AS longest, arg_max(phrase, {{'n': n_words, 'p': phrase}}) FILTER (NOT formulaic) AS phrase,
 (SELECT published_first FROM e x WHERE x.family = e.family GROUP BY published_first ORDER BY count(*) DESC, published_first LIMIT 1) AS first FROM e JOIN f USING (phrase) GROUP BY family""")
def i15(spark, d):
    """Per family: formulaic echoes and others, the longest of the others, and which side was first most often."""
    found = echo.formulaic(family_echoes(spark, d))
    other = ~F.col("formulaic")
    per = found.groupBy("family").agg(F.count("*").alias("n"), F.count_if("formulaic").alias("n_formulaic"), F.max(F.when(other, F.col("n_words"))).alias("longest"), F.max_by("phrase", F.when(other, F.struct("n_words", "phrase"))).alias("phrase"))
    votes = found.groupBy("family", "published_first").agg(F.count("*").alias("v")).groupBy("family").agg(F.min_by("published_first", F.struct(-F.col("v"), "published_first")).alias("first"))
    return per.join(votes, "family")


@query("f06_ngram_text", rf"SELECT doc_id, md5({_NORM.format(t='text')}) AS norm_md5 FROM documents")
def f06(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.ngram_text(F.col("text"))).alias("norm_md5"))


# --- references ---------------------------------------------------------------

#: Titles and what names them, longest first where one holds another.
ALIASES = ["gnu general public license", "general public license", "apache license", "mit license", "cc by-nc 4.0"]


def _masked_sql() -> str:
    """The same fold in SQL: one level of masking per alias, longest first."""
    sql = "SELECT doc_id, lower(text) AS t, lower(string_split(text, chr(10))[1]) AS own FROM documents"
    for k, a in enumerate(sorted(ALIASES, key=len, reverse=True)):
        n = f"CASE WHEN contains(own, '{a}') THEN 0 ELSE (length(t) - length(replace(t, '{a}', ''))) // {len(a)} END AS n{ALIASES.index(a)}"
        sql = f"SELECT * EXCLUDE (t), {n}, replace(t, '{a}', '{'#' * len(a)}') AS t FROM ({sql}) s{k}"
    names = ", ".join(f"CAST(n{i} AS BIGINT) AS \"{a}\"" for i, a in enumerate(ALIASES))
    return f"SELECT doc_id, {names} FROM ({sql})"


@query("f09_masked_references", f"SELECT * FROM (UNPIVOT ({_masked_sql()}) ON COLUMNS(* EXCLUDE doc_id) INTO NAME target VALUE count) WHERE count > 0")
def f09(spark, d):
    # What a document's first line names is its own title: masked, but no reference.
    title = F.lower(F.get(F.split("text", "\n"), F.lit(0)))
    own = F.array_compact(F.array(*(F.when(title.contains(a), a) for a in ALIASES)))
    n, _ = X.masked_counts(F.lower("text"), ALIASES, own)
    rows = documents(spark, d).select("doc_id", F.array(*(F.struct(F.lit(a).alias("target"), c.alias("count")) for a, c in zip(ALIASES, n))).alias("r"))
    return rows.select("doc_id", F.explode(F.filter("r", lambda r: r["count"] > 0)).alias("r")).select("doc_id", "r.target", "r.count")


@query("i16_weighted_in_degree", f"WITH e AS (SELECT * FROM (UNPIVOT ({_masked_sql()}) ON COLUMNS(* EXCLUDE doc_id) INTO NAME target VALUE count) WHERE count > 0) SELECT target, CAST(sum(count) AS BIGINT) AS in_degree FROM e GROUP BY target")
def i16(spark, d):
    return f09(spark, d).groupBy("target").agg(F.sum("count").alias("in_degree"))


@query("j04_top_in_degree", f"WITH e AS (SELECT * FROM (UNPIVOT ({_masked_sql()}) ON COLUMNS(* EXCLUDE doc_id) INTO NAME target VALUE count) WHERE count > 0) SELECT target, CAST(sum(count) AS BIGINT) AS in_degree FROM e GROUP BY target ORDER BY 2 DESC, 1 LIMIT 3")
def j04(spark, d):
    return i16(spark, d).orderBy(F.desc("in_degree"), "target").limit(3)


@query("f17_evidence_snippet", r"""SELECT doc_id, trim(regexp_replace(substr(t, greatest(p - 90, 1), p - greatest(p - 90, 1) + 14 + 90), '\s+', ' ', 'g')) AS evidence
  FROM (SELECT doc_id, lower(text) AS t, instr(lower(text), 'apache license') AS p FROM documents) WHERE p > 0""")
def f17(spark, d):
    t, needle = F.lower("text"), F.lit("apache license")
    return documents(spark, d).where(t.contains("apache license")).select("doc_id", X.snippet(t, needle).alias("evidence"))


_OMNIBUS = "src0"


@query("f10_company_agreement", rf"SELECT doc_id, lang AS family FROM documents WHERE (contains(lower(text), 'license') OR regexp_matches(lower(text), '\bmit\b')) AND (contains(lower(text), CASE lang WHEN 'en' THEN 'apache' WHEN 'de' THEN 'gnu' WHEN 'fr' THEN 'mit' ELSE 'cc' END) OR source = '{_OMNIBUS}' AND regexp_matches(lower(text), 'apache|gnu|mit|cc'))")
def f10(spark, d):
    """The instrument, and the token of the document's own family; the omnibus source may name any family's."""
    t = F.lower("text")
    token = F.when(F.col("lang") == "en", "apache").when(F.col("lang") == "de", "gnu").when(F.col("lang") == "fr", "mit").otherwise("cc")
    named = t.contains(token) | ((F.col("source") == _OMNIBUS) & t.rlike("apache|gnu|mit|cc"))
    return documents(spark, d).where((t.contains("license") | t.rlike(r"\bmit\b")) & named).select("doc_id", F.col("lang").alias("family"))
