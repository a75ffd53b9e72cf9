"""Further queries: configuration, merge sinks, order-dependent folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from inkfold.functions import text as X
from inkfold.operators import html
from inkfold.plans.registry import query
from inkfold.sources import files
from inkfold.sources.relations import MANIFEST_SQL, RECORDS_SQL, blocks, documents, manifest, records, table
from inkfold.sources.shared import shared_path

_YAML = "nominal:\n  - license\n  - public\nvariant:\n  - licensed\n"


@query("a11_yaml_lexicon", "SELECT c AS class, p AS pattern, (SELECT count(*) FROM documents WHERE contains(lower(text), p)) AS n_docs FROM (VALUES ('nominal', 'license'), ('nominal', 'public'), ('variant', 'licensed')) t(c, p)")
def a11(spark, d):
    """A lexicon from configuration: its patterns become literals of one scan."""
    lexicon = [tuple(r) for r in files.read_yaml(spark, _YAML).collect()]
    each = F.array(*(F.struct(F.lit(c).alias("class"), F.lit(p).alias("pattern"), F.lower("text").contains(p).cast("int").alias("hit")) for c, p in lexicon))
    return documents(spark, d).select(F.explode(each).alias("x")).groupBy("x.class", "x.pattern").agg(F.sum("x.hit").alias("n_docs"))


@query("b02_spine_sink", f"SELECT g.genre, CAST(count(m.doc_id) AS BIGINT) AS n FROM (VALUES ('en'), ('it')) g(genre) LEFT JOIN {MANIFEST_SQL} m USING (genre) GROUP BY g.genre")
def b02(spark, d):
    path = shared_path(spark, "spine")
    spine = spark.createDataFrame([("en",), ("it",)], "genre string")
    files.write_csv(spine.join(manifest(spark, d).groupBy("genre").agg(F.count("*").alias("n")), "genre", "left").na.fill(0), path)
    return files.read_csv(spark, path, "genre string, n bigint")


@query("b04_jsonl_sink", "SELECT item_id, length(text) AS chars FROM benchmark")
def b04(spark, d):
    path = shared_path(spark, "lines")
    table(spark, d, "benchmark").write.json(path)
    return files.read_jsonl(spark, path, "item_id bigint, text string").select("item_id", F.length("text").cast("bigint").alias("chars"))


@query("b06_merge_overwrite", f"SELECT unit, question, ordinal, CASE WHEN question = 'view' THEN 'new' ELSE 'old' END AS run FROM {RECORDS_SQL} WHERE question <> 'view' OR confidence > 50")
def b06(spark, d):
    """New records replace all old ones of their question on disk; the others stay."""
    path = shared_path(spark, "merged")
    r = records(spark, d).select("unit", "question", "ordinal", "confidence")
    files.merge_overwrite(r.withColumn("run", F.lit("old")).drop("confidence"), path, "question", ["unit", "ordinal"])
    files.merge_overwrite(r.where("question = 'view' AND confidence > 50").withColumn("run", F.lit("new")).drop("confidence"), path, "question", ["unit", "ordinal"])
    return spark.read.schema("unit bigint, ordinal bigint, run string, question string").parquet(path).select("unit", "question", "ordinal", "run")


_COVER_SQL = "(SELECT count(*) AS n, count(l.doc_id) AS m FROM documents d LEFT JOIN labels l USING (doc_id))"


@query("b03_partial_banner", f"SELECT lang, n, CASE WHEN m * 1000 < t.n_all * 995 THEN 'STATUS: PARTIAL (' || m || ' of ' || t.n_all || ')' END AS note FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang), (SELECT n AS n_all, m FROM {_COVER_SQL}) t")
def b03(spark, d):
    """Counts by language in a CSV that says how much of the corpus is labelled, if it is not all of it."""
    path = shared_path(spark, "banner")
    docs = documents(spark, d)
    total, covered = docs.count(), docs.select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").count()
    files.write_with_banner(docs.groupBy("lang").agg(F.count("*").alias("n")), path, covered, total)
    note = [r.note for r in files.csv_notes(spark, path).collect()]
    back = files.read_csv(spark, path, "lang string, n bigint", comment="#")
    return back.withColumn("note", F.lit(note[0].strip() if note else None).cast("string"))


@query("b08_yaml_guidebook", "SELECT l_returnflag AS class, l_linestatus AS pattern FROM lineitem GROUP BY 1, 2")
def b08(spark, d):
    """A small table as YAML text and back: classes and what belongs to them."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("class"), F.col("l_linestatus").alias("pattern")).distinct()
    return files.read_yaml(spark, files.to_yaml(rows))


@query("a08_json_lines_of_several_files", f"SELECT unit, question, ordinal FROM {RECORDS_SQL} WHERE question NOT IN ('error', 'view') AND ordinal IS NOT NULL")
def a08(spark, d):
    """JSON lines of several folders; those whose names are excluded or begin with CONTEXT_ are not read."""
    base = shared_path(spark, "lines")
    r = records(spark, d).select("unit", "question", "ordinal")
    named = r.withColumn("file", F.when(F.col("question") == "view", "CONTEXT_view").when(F.col("question") == "error", "doc_profiles").otherwise(F.col("question")))
    named.write.partitionBy("file").json(base)
    return files.read_json_lines(spark, base, "unit bigint, question string, ordinal bigint", "file", ["doc_profiles"], "CONTEXT_")


@query("b11_run_history", f"SELECT question, count(*) AS calls, 2 AS runs FROM {RECORDS_SQL} GROUP BY question")
def b11(spark, d):
    path = shared_path(spark, "history")
    for run in (1, 2):
        files.append(records(spark, d).groupBy("question").agg(F.count("*").alias("calls")).withColumn("run", F.lit(run)), path)
    back = spark.read.schema("question string, calls bigint, run int").parquet(path)
    return back.groupBy("question").agg(F.max("calls").alias("calls"), F.max("run").alias("runs"))


@query("e12_dangling_quotes")
def e12(spark, d):
    """Lines of a document with open quotations merged, in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, k, t) for i, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, t in enumerate(html.merged_quotes(lines))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int32(), pa.string()))], ["doc_id", "ord", "text"])

    return documents(spark, d).select("doc_id", F.split("text", "\n")).mapInArrow(run, "doc_id bigint, ord int, text string")


_BOLD = r"<p><b>([^<]{1,99})<"


@query("e14_pseudo_headings", rf"SELECT page_id, h AS heading FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_BOLD}', 1)) AS h FROM pages) WHERE NOT regexp_matches(h, '[.!?:]\s*$')")
def e14(spark, d):
    """Short bold paragraphs without a final stop."""
    found = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_BOLD), F.lit(1))).alias("heading"))
    return found.where(~F.col("heading").rlike(r"[.!?:]\s*$"))


@query("g07_ascii_folding", r"SELECT doc_id, md5(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')) AS folded_md5 FROM documents")
def g07(spark, d):
    return documents(spark, d).select("doc_id", F.md5(X.ascii_folded("text")).alias("folded_md5"))


@query("g12_html_escape", "SELECT page_id, md5(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_md5 FROM pages")
def g12(spark, d):
    out = F.col("url")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return table(spark, d, "pages").select("page_id", F.md5(out).alias("escaped_md5"))


@query("j01_stable_ranking", f"SELECT question, rank() OVER (ORDER BY n DESC, first) AS place FROM (SELECT question, count(*) AS n, min(ordinal) AS first FROM {RECORDS_SQL} GROUP BY question)")
def j01(spark, d):
    from pyspark.sql import Window

    per = records(spark, d).groupBy("question").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    # One row per question of a fixed catalogue: a single task orders them.
    return per.select("question", F.rank().over(Window.orderBy(F.desc("n"), "first")).cast("bigint").alias("place"))


@query("n05_flushed_blocks", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY doc_id")
def n05(spark, d):
    """Blocks written as they are made, and read back."""
    path = shared_path(spark, "flushed")
    files.append(blocks(documents(spark, d)).select("doc_id", "ord"), path)
    return spark.read.schema("doc_id bigint, ord int").parquet(path).groupBy("doc_id").agg(F.count("*").alias("n"))
