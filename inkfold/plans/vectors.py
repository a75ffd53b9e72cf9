"""Queries of vectors, clusters and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from inkfold.functions import text as X
from inkfold.operators import aggregates as A
from inkfold.operators import graph as G
from inkfold.operators import lexicon
from inkfold.operators import sampling
from inkfold.operators import vectors as V
from inkfold.plans.corpus import COUNTS_SQL, SECTIONS_SQL, UNITS_SQL, counts, parts, units
from inkfold.plans.registry import query
from inkfold.plans.relational import PROJECTION_SQL, projection
from inkfold.sources.relations import MANIFEST_SQL, RECORDS_SQL, manifest, records, table

_UNIT_SQL = "(SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
PAIRS_SQL = f"(SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.v, b.v) AS cosine FROM {_UNIT_SQL} a JOIN {_UNIT_SQL} b ON a.vec_id < b.vec_id WHERE list_inner_product(a.v, b.v) >= 0.4)"
CLUSTERS_SQL = f"""(WITH RECURSIVE e AS (SELECT a AS u, b AS v FROM {PAIRS_SQL} UNION ALL SELECT b, a FROM {PAIRS_SQL}), c(u, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.v, c.m FROM c JOIN e ON e.u = c.u AND c.m < e.v)
 SELECT u AS vec_id, min(m) AS component FROM c GROUP BY u)"""


def embeddings(spark, d):
    return table(spark, d, "embeddings")


def clusters(spark, d):
    return V.threshold_clusters(embeddings(spark, d), 0.4)


def _probes(spark, d) -> list[list[float]]:
    """Three probes: a fixed, tiny set of vectors, as literals of the plan."""
    rows = embeddings(spark, d).where("vec_id IN (0, 1, 2)").select(V.normalised(F.col("embedding"))).collect()
    return [list(r[0]) for r in rows]


@query("l01_normalise", f"SELECT vec_id, round(v[1], 9) AS first, round(list_inner_product(v, v), 9) AS norm FROM {_UNIT_SQL}")
def l01(spark, d):
    v = embeddings(spark, d).select("vec_id", V.normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 9).alias("first"), F.round(V.dot(F.col("v"), F.col("v")), 9).alias("norm"))


@query("d11_similar_pairs", f"SELECT a, b, round(cosine, 9) AS cosine FROM {PAIRS_SQL}")
def d11(spark, d):
    return V.similar_pairs(embeddings(spark, d), 0.4).select("a", "b", F.round("cosine", 9).alias("cosine"))


@query("l03_max_probe_similarity", f"SELECT x.vec_id, round(max(list_inner_product(x.v, p.v)), 3) + 0.0 AS similarity FROM {_UNIT_SQL} x, {_UNIT_SQL} p WHERE p.vec_id IN (0, 1, 2) GROUP BY x.vec_id")
def l03(spark, d):
    return embeddings(spark, d).select("vec_id", (F.round(V.max_similarity(embeddings(spark, d), _probes(spark, d)), 3) + 0.0).alias("similarity"))


_SIM_SQL = f"(SELECT x.vec_id, x.label, max(list_inner_product(x.v, p.v)) AS similarity FROM {_UNIT_SQL} x, {_UNIT_SQL} p WHERE p.vec_id IN (0, 1, 2) GROUP BY x.vec_id, x.label)"


#: Sections of the documents: as their number, modulo the vectors, a vector stands for each one's embedding.
_SECTION_SIM_SQL = f"(SELECT s.doc_id, s.section_idx, s.n_nominal, sim.similarity FROM (SELECT x.*, max(section_idx) OVER () AS m FROM (SELECT doc_id, section_idx, text, c.n_nominal FROM {SECTIONS_SQL} JOIN {COUNTS_SQL} c USING (doc_id)) x WHERE length(text) > 200) s JOIN {_SIM_SQL} sim ON sim.vec_id = (s.doc_id * 7 + s.section_idx) % (SELECT count(*) FROM embeddings))"


@query("f04_semantic_retrieval", f"""SELECT printf('%d::s%02d', doc_id, section_idx) AS unit_id, doc_id, 'semantic' AS retrieval, round(similarity, 3) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, section_idx) AS k FROM {_SECTION_SIM_SQL} WHERE n_nominal = 0)
 WHERE k <= 2 AND similarity >= 0.1 AND printf('%d::s%02d', doc_id, section_idx) NOT IN (SELECT unit_id FROM {UNITS_SQL})""")
def f04(spark, d):
    """Where the lexicon found nothing nominal: the two sections of over 200 characters nearest to a probe, then the threshold, then without those that are units already.

    There is no encoder here: a section's vector is the one numbered by its document and place.
    """
    n = embeddings(spark, d).count()
    sim = embeddings(spark, d).select("vec_id", V.max_similarity(embeddings(spark, d), _probes(spark, d)).alias("similarity"))
    bare = counts(spark, d).where("n_nominal = 0").select("doc_id")
    parts_ = parts(spark, d).where(F.length("text") > 200).select("doc_id", "section_idx").join(bare, "doc_id", "left_semi")
    similar = parts_.withColumn("vec_id", F.pmod(F.col("doc_id") * 7 + F.col("section_idx"), F.lit(n))).join(sim, "vec_id").drop("vec_id")
    taken = units(spark, d).where("retrieval = 'lexicon'").select("doc_id", F.regexp_extract("unit_id", r"::s(\d+)$", 1).cast("bigint").alias("section_idx"))
    top = lexicon.top_by_similarity(similar, taken, 2, 0.1)
    return top.select(F.format_string("%d::s%02d", "doc_id", "section_idx").alias("unit_id"), "doc_id", F.lit("semantic").alias("retrieval"), F.round("similarity", 3).alias("similarity"))


@query("l04_threshold_clusters", f"SELECT * FROM {CLUSTERS_SQL}")
def l04(spark, d):
    return clusters(spark, d).select(F.col("id").alias("vec_id"), "component")


#: What a coder said of a vector: its label names a beneficiary, and documents with the vector's number give the quote.
_SAID_SQL = f"(SELECT c.component, c.vec_id, 'ROLE=x; BENEFICIARY=' || CASE label % 4 WHEN 0 THEN 'All citizens' WHEN 1 THEN 'Small firms' WHEN 2 THEN 'The Public Sector ' ELSE 'Researchers' END || '; END' AS summary, left(d.text, 20) AS quote FROM {CLUSTERS_SQL} c JOIN embeddings USING (vec_id) LEFT JOIN documents d ON d.doc_id = c.vec_id)"
_SEEDS = {"citizens_general": ["citizen", "everyone"], "public_sector": ["public sector", "government"]}
_NAME_SQL = f"(SELECT component, label FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, first) AS k FROM (SELECT component, lower(trim(regexp_extract(summary, 'BENEFICIARY=([^;]+)', 1))) AS label, count(*) AS n, min(vec_id) AS first FROM {_SAID_SQL} GROUP BY 1, 2)) WHERE k = 1)"


def said(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("All citizens", "Small firms", "The Public Sector ", "Researchers"))), (F.col("label") % 4 + 1).cast("int"))
    c = clusters(spark, d).join(embeddings(spark, d).select(F.col("vec_id").alias("id"), "label"), "id")
    c = c.select("component", "id", F.concat(F.lit("ROLE=x; BENEFICIARY="), name, F.lit("; END")).alias("summary"))
    return c.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.left("text", F.lit(20)).alias("quote")), "id", "left")


@query("l05_cluster_names", f"SELECT component, CASE WHEN contains(label, 'citizen') OR contains(label, 'everyone') THEN 'citizens_general' WHEN contains(label, 'public sector') OR contains(label, 'government') THEN 'public_sector' ELSE left(regexp_replace(regexp_replace(label, '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), 40) END AS name FROM {_NAME_SQL}")
def l05(spark, d):
    """The most common label (first met wins a tie), as a slug, unless a seed's word is in it."""
    labels = said(spark, d).withColumn("label", F.lower(F.trim(F.regexp_extract("summary", "BENEFICIARY=([^;]+)", 1))))
    label = F.col("label")
    name = X.slug(label)
    for seed, words in reversed(_SEEDS.items()):
        name = F.when(reduce(lambda a, b: a | b, (label.contains(w) for w in words)), seed).otherwise(name)
    return A.first_mode(labels, ["component"], "label", "id").select("component", name.alias("name"))


@query("l06_cluster_summary", f"SELECT component, count(*) AS n, array_to_string(list_transform(list_sort(list({{'i': vec_id, 'q': coalesce(quote, '')}}))[1:3], lambda x: CAST(x.i AS VARCHAR) || '=' || x.q), '|') AS examples FROM {_SAID_SQL} GROUP BY component")
def l06(spark, d):
    """Instances of each cluster, and the quotes of its first three."""
    rows = said(spark, d)
    first = A.first_n(rows, ["component"], F.concat_ws("=", F.col("id").cast("string"), F.coalesce("quote", F.lit(""))), "id", 3, "examples")
    return rows.groupBy("component").agg(F.count("*").alias("n")).join(first, "component").select("component", "n", F.array_join("examples", "|").alias("examples"))


@query("l07_merge_rate", f"SELECT count(DISTINCT component) AS clusters, count(*) AS instances, count(DISTINCT component) > 0.4 * count(*) AS flagged FROM {CLUSTERS_SQL}")
def l07(spark, d):
    return clusters(spark, d).agg(F.countDistinct("component").alias("clusters"), F.count("*").alias("instances")).withColumn("flagged", F.col("clusters") > 0.4 * F.col("instances"))


@query("l13_adjusted_rand_index", "WITH c AS (SELECT quality, toxic, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS rij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY quality)) AS ra, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY toxic)) AS rb, (SELECT sum(n) FROM c) AS t) SELECT round((rij - ra * rb / (t * (t - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2)), 9) AS ari FROM s")
def l13(spark, d):
    return G.adjusted_rand_index(table(spark, d, "labels"), "quality", "toxic").select(F.round("ari", 9).alias("ari"))


_EDGES_SQL = f"(SELECT unit AS source, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS target, count(*) AS weight FROM {RECORDS_SQL} GROUP BY 1, 2)"
UNDIRECTED_SQL = f"(SELECT least(source, target) AS a, greatest(source, target) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM {_EDGES_SQL} WHERE source <> target AND source IN (SELECT doc_id FROM labels) AND target IN (SELECT doc_id FROM labels) GROUP BY 1, 2)"


def undirected(spark, d):
    e = records(spark, d).groupBy(F.col("unit").alias("source"), F.get_json_object("payload", "$.k").cast("bigint").alias("target")).agg(F.count("*").alias("weight"))
    return G.undirected_pairs(e, table(spark, d, "labels").select("doc_id"))


@query("l09_undirected_pairs", f"SELECT * FROM {UNDIRECTED_SQL}")
def l09(spark, d):
    return undirected(spark, d)


@query("l11_label_propagation")
def l11(spark, d):
    return G.label_propagation(undirected(spark, d))


@query("l10_communities")
def l10(spark, d):
    return G.greedy_modularity(undirected(spark, d))


@query("l12_modularity", f"WITH p AS (SELECT * FROM {UNDIRECTED_SQL}), m AS (SELECT CAST(sum(weight) AS DOUBLE) AS m FROM p), i AS (SELECT coalesce(sum(weight), 0) AS w FROM p WHERE a % 3 = b % 3), g AS (SELECT c, CAST(sum(weight) AS DOUBLE) AS g FROM (SELECT a % 3 AS c, weight FROM p UNION ALL SELECT b % 3, weight FROM p) GROUP BY c) SELECT round(max(i.w) / max(m.m) - sum(g * g) / (4 * max(m.m) * max(m.m)), 9) AS modularity FROM g, m, i")
def l12(spark, d):
    p = undirected(spark, d)
    ids = p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct()
    return G.modularity(p, ids.withColumn("community", F.col("id") % 3)).select(F.round("modularity", 9).alias("modularity"))


@query("l14_isolated_nodes", f"SELECT count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT a FROM {UNDIRECTED_SQL} UNION ALL SELECT b FROM {UNDIRECTED_SQL})")
def l14(spark, d):
    return G.isolated(table(spark, d, "labels").select(F.col("doc_id").alias("id")), undirected(spark, d)).agg(F.count("*").alias("n"))


@query("l15_stratified_sample")
def l15(spark, d):
    return sampling.stratified(manifest(spark, d), "genre", "doc_id", 10, diverse="family")


#: Quotas in SQL: rounded half to even, one at least; what is too much or too little goes round by size.
_QUOTA_SQL = f"""(WITH q AS (SELECT genre, n, greatest(CAST(round_even(n * 10.0 / sum(n) OVER (), 0) AS INTEGER), 1) AS q, row_number() OVER (ORDER BY n DESC, genre) AS place, count(*) OVER () AS groups FROM (SELECT genre, count(*) AS n FROM {MANIFEST_SQL} GROUP BY genre)),
 o AS (SELECT *, sum(q) OVER () - 10 AS over FROM q) SELECT genre, CAST(greatest(q - sign(over) * (abs(over) // groups + CASE WHEN place <= abs(over) % groups THEN 1 ELSE 0 END), 1) AS BIGINT) AS quota FROM o)"""


@query("l15_stratified_quotas", f"SELECT genre, quota FROM {_QUOTA_SQL}")
def l15_quotas(spark, d):
    return sampling.stratified(manifest(spark, d), "genre", "doc_id", 10).groupBy("genre").agg(F.count("*").alias("quota"))


@query("l16_double_coding_sheet", f"SELECT unit, " + ", ".join(f"array_to_string(list_transform(list_sort(list({{'o': ordinal, 'v': coalesce(error, json_extract_string(payload, '$.k'))}}) FILTER (question = '{q}'))[1:3], lambda x: x.v), ' || ') AS \"{q}\"" for q in ("click", "error")) + f" FROM {RECORDS_SQL} GROUP BY unit")
def l16(spark, d):
    """One row per unit, one column per core question, its first answers joined."""
    r = records(spark, d).withColumn("said", F.coalesce("error", F.get_json_object("payload", "$.k")))
    first = A.first_n(r.where(F.col("question").isin("click", "error")), ["unit", "question"], F.col("said"), "ordinal", 3, "first")
    text = lambda q: F.max(F.when(F.col("question") == q, F.array_join("first", " || "))).alias(q)
    sheet = first.groupBy("unit").agg(text("click"), text("error"))
    return r.select("unit").distinct().join(sheet, "unit", "left")


@query("d12_thematic_edges", f"SELECT source, target, weight FROM {PROJECTION_SQL} WHERE weight >= 4")
def d12(spark, d):
    return projection(spark, d, least=4)
