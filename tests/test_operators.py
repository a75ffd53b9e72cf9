"""Semantic edges of the operators, on invented fixtures."""

import io
import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from inkfold.functions import text as X
from inkfold.operators import aggregates, coding, echo, graph, html, lexicon, sampling, vectors
from inkfold.sources import files, remote, workbook


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_overlapping_patterns_count_each(spark):
    df = spark.createDataFrame([(1, "the GNU General Public License"), (2, "a general public license"), (3, "licensed licenses"), (4, "")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_nominal, r.n_variant) for r in lexicon.term_counts(df).collect()}
    assert got == {1: (3, 0), 2: (2, 0), 3: (1, 1), 4: (0, 0)}


def block_rows(spark, docs):
    return spark.createDataFrame([(d, i, p, t) for d, bs in docs.items() for i, (p, t) in enumerate(bs)], "doc_id bigint, ord int, position string, text string")


def test_sections_begin_at_headings(spark):
    b = block_rows(spark, {1: [("section_heading", "A"), ("body", "x"), ("section_heading", "B")], 2: [("title", "T"), ("body", "y"), ("section_heading", "C")], 3: [("body", "z")]})
    got = rows(lexicon.sections(b).select("doc_id", "section_idx", "heading", "n_blocks", "text"))
    assert got == [(1, 0, "A", 2, "A\nx"), (1, 1, "B", 1, "B"), (2, 0, "(start)", 2, "T\ny"), (2, 1, "C", 1, "C"), (3, 0, "(start)", 1, "z")]


@pytest.mark.parametrize(("size", "units"), [(9000, 1), (9001, 0)])
def test_whole_document_only_when_short(spark, size, units):
    docs = spark.createDataFrame([(1, "x" * size)], "doc_id bigint, text string")
    assert lexicon.coding_units(docs, 30).count() == units


def test_sections_in_the_scan_equal_those_of_blocks(spark):
    texts = {1: "Title\nA\nx" + "y" * 40 + "\nB\nC", 2: "only", 3: "", 4: "T\n" + "z" * 31 + "\n\n" + "w" * 31}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    cols = ("doc_id", "section_idx", "heading", "n_blocks", "text")
    b = {i: [("title" if k == 0 else "section_heading" if len(t) <= 30 else "body", t) for k, t in enumerate(x.split("\n"))] for i, x in texts.items()}
    assert rows(lexicon.document_sections(docs, 30).select(*cols)) == rows(lexicon.sections(block_rows(spark, b)).select(*cols))
    hit = spark.createDataFrame([(1, "T\nH\n" + "licensed " * 9), (2, "licensed"), (3, "x"), (4, "x" * 9001)], "doc_id bigint, text string")
    assert [r.unit_id for r in lexicon.coding_units(hit, 30).orderBy("unit_id").collect()] == ["1::s01", "2::s00", "3::full"]


def test_top_k_before_threshold_before_taken(spark):
    sim = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.8), (1, 2, 0.7), (2, 0, 0.6), (2, 1, 0.1)], "doc_id bigint, section_idx bigint, similarity double")
    taken = spark.createDataFrame([(1, 0), (1, 1)], "doc_id bigint, section_idx bigint")
    assert rows(lexicon.top_by_similarity(sim, taken)) == [(2, 0, 0.6)]


def maximal(a, b, n):
    """All shared sequences of n words or more that lie in no longer one, by definition."""
    grams = lambda w: {tuple(w[i:j]) for i in range(len(w)) for j in range(i + n, len(w) + 1)}
    both = grams(a) & grams(b)
    inside = lambda s, l: len(s) < len(l) and any(l[i : i + len(s)] == s for i in range(len(l)))
    return {" ".join(s) for s in both if not any(inside(s, l) for l in both)}


def test_shared_phrases_match_their_definition(spark):
    rnd = random.Random(3)
    pairs = [([rnd.choice("abc") for _ in range(rnd.randint(0, 14))], [rnd.choice("abc") for _ in range(rnd.randint(0, 14))]) for _ in range(25)]
    left = spark.createDataFrame([(i, i, " ".join(a)) for i, (a, _) in enumerate(pairs)], "k int, doc int, text string")
    right = spark.createDataFrame([(i, i, " ".join(b)) for i, (_, b) in enumerate(pairs)], "k int, doc int, text string")
    got = {}
    for r in echo.shared_phrases(left, right, 3).collect():
        got.setdefault(r.k, set()).add(r.phrase)
    for i, (a, b) in enumerate(pairs):
        assert got.get(i, set()) == maximal(a, b, 3)


def test_formulaic_needs_two_families(spark):
    df = spark.createDataFrame([("x", "p"), ("y", "p"), ("x", "q"), ("x", "q")], "family string, phrase string")
    assert {(r.phrase, r.formulaic) for r in echo.formulaic(df).collect()} == {("p", True), ("q", False)}


def test_masked_aliases_longest_first(spark):
    df = spark.createDataFrame([("gnu general public license and general public license", []), ("general public license", ["general public license"])], "t string, own array<string>")
    n, masked = X.masked_counts(F.col("t"), ["general public license", "gnu general public license"], F.col("own"))
    assert [tuple(r) for r in df.select(*n).collect()] == [(1, 1), (0, 0)]
    assert "license" not in df.select(masked.alias("m")).collect()[1].m


def test_mode_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4)], "g string, v string, o int")
    assert rows(aggregates.first_mode(df, ["g"], "v", "o")) == [("g", "b", 2)]


def test_keep_last_and_first_n(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2)], "k int, v string, o int")
    assert rows(aggregates.keep_last(df, ["k"], "o")) == [(1, "b", 3)]
    assert aggregates.first_n(df, ["k"], F.col("v"), "o", 2, "f").collect()[0].f == ["a", "c"]


def test_positions_in_few_large_groups(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("g"), F.xxhash64("id").alias("a"), "id").repartition(7)
    want, seen = {}, {True: 0, False: 0}
    for r in sorted(df.collect(), key=lambda r: (r.a, r.id)):
        seen[r.g] += 1
        want[r.id] = seen[r.g]
    assert {r.id: r.position for r in aggregates.numbered(df, "g", ["a", "id"]).collect()} == want


def union_find(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {(i, find(i)) for i in range(n)}


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(20)] + [tuple(rnd.sample(range(21, 60), 2)) for _ in range(25)]
    nodes = spark.createDataFrame([(i,) for i in range(60)], "id bigint")
    got = graph.components(nodes, spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {tuple(r) for r in got.select("id", "component").collect()} == union_find(60, edges)


def test_similar_pairs_over_blocks(spark):
    rnd = random.Random(7)
    vecs = [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(40)] + [[0.0] * 4]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "vec_id bigint, embedding array<double>")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = {(i, j) for i, j in itertools.combinations(range(40), 2) if sum(x * y for x, y in zip(vecs[i], vecs[j])) / norm(vecs[i]) / norm(vecs[j]) >= 0.7}
    got = vectors.similar_pairs(df, 0.7, block=7).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_chain_is_one_cluster(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.28, 0.96])], "vec_id bigint, embedding array<double>")
    assert {r.component for r in vectors.threshold_clusters(df, 0.75).collect()} == {0}


def test_undirected_pairs_drop_loops_and_unknown(spark):
    e = spark.createDataFrame([(1, 2, 3), (2, 1, 4), (1, 1, 9), (1, 7, 5)], "source bigint, target bigint, weight bigint")
    known = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert rows(graph.undirected_pairs(e, known)) == [(1, 2, 7)]


@pytest.mark.parametrize(("pairs", "ari"), [([(1, 1), (1, 1), (2, 2)], 1.0), ([(1, 1), (1, 1)], 1.0), ([(1, 1), (1, 2), (2, 1), (2, 2)], -0.5)])
def test_adjusted_rand_index(spark, pairs, ari):
    df = spark.createDataFrame(pairs, "a int, b int")
    assert graph.adjusted_rand_index(df, "a", "b").collect()[0].ari == pytest.approx(ari)


def test_label_propagation_is_stable(spark):
    tri = [(0, 1, 1), (1, 2, 1), (0, 2, 1), (10, 11, 1), (11, 12, 1), (10, 12, 1)]
    got = graph.label_propagation(spark.createDataFrame(tri, "a bigint, b bigint, weight bigint"))
    by = {r.id: r.community for r in got.collect()}
    assert len({by[i] for i in (0, 1, 2)}) == len({by[i] for i in (10, 11, 12)}) == 1 and by[0] != by[10]


def test_greedy_modularity_ends_where_no_merger_gains(spark):
    rnd = random.Random(7)
    edges = {}
    for _ in range(160):
        a, b = sorted((rnd.randrange(40), rnd.randrange(40)))
        if a != b and (a % 4 == b % 4 or rnd.random() < 0.15):
            edges[a, b] = edges.get((a, b), 0) + 1
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a bigint, b bigint, weight bigint")
    by = {r.id: r.community for r in graph.greedy_modularity(df).collect()}
    m = sum(edges.values())

    def quality(by):
        inside, degree = 0, {}
        for (a, b), w in edges.items():
            inside += w * (by[a] == by[b])
            for x in (a, b):
                degree[by[x]] = degree.get(by[x], 0) + w
        return inside / m - sum(x * x for x in degree.values()) / (4 * m * m)

    names = sorted(set(by.values()))
    assert set(by) == {x for e in edges for x in e} and all(min(i for i in by if by[i] == c) == c for c in names)
    best = quality(by)
    assert best > 0.3 and best > quality({i: i for i in by})
    for a, b in itertools.combinations(names, 2):
        assert quality({i: a if c == b else c for i, c in by.items()}) <= best + 1e-9
    got = graph.modularity(df, spark.createDataFrame(list(by.items()), "id bigint, community bigint")).collect()[0].modularity
    assert got == pytest.approx(best)
    assert graph.greedy_modularity(df.limit(0)).count() == 0


def test_quotas_sum_to_k(spark):
    df = spark.createDataFrame([("a", i) for i in range(25)] + [("b", 100 + i) for i in range(5)] + [("c", 200)], "g string, id bigint")
    got = {r.g: r["count"] for r in sampling.stratified(df, "g", "id", 10).groupBy("g").count().collect()}
    assert sum(got.values()) == 10 and set(got) == {"a", "b", "c"}
    of = df.withColumn("f", F.when(F.col("id") < 3, F.col("id")).otherwise(9))
    taken = [r.f for r in sampling.stratified(of, "g", "id", 10, diverse="f").where("g = 'a'").collect()]
    assert {0, 1, 2, 9} == set(taken)


def test_sinks_that_merge_append_and_warn(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    old = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3)], "k string, v int")
    files.merge_overwrite(old, at("merge"), "k", ["v"])
    files.merge_overwrite(spark.createDataFrame([("x", 9), ("z", 4)], "k string, v int"), at("merge"), "k", ["v"])
    assert rows(spark.read.schema("v int, k string").parquet(at("merge")).select("k", "v")) == [("x", 9), ("y", 3), ("z", 4)]
    files.append(old, at("append"))
    assert rows(files.append_with_union(spark.createDataFrame([("w", 5, "n")], "k string, v int, note string"), at("append"))) == [("w", 5, "n"), ("x", 1, None), ("x", 2, None), ("y", 3, None)]
    for covered, note in ((99, ["STATUS: PARTIAL (99 of 100)"]), (100, [])):
        files.write_with_banner(old, at("banner"), covered, 100)
        assert [r.note for r in files.csv_notes(spark, at("banner")).collect()] == note
        assert rows(files.read_csv(spark, at("banner"), "k string, v int", comment="#")) == rows(old)
    (tmp_path / "doc.json").write_text('{\n "a": 1,\n "b": [2, 3]\n}')
    assert rows(files.read_json_documents(spark, at("doc.json"), "a int, b array<int>")) == [(1, [2, 3])]


def test_remote_functions_and_what_fails(spark, tmp_path):
    docs = spark.createDataFrame([(1, "c", "long"), (2, "c", "bad"), (3, None, None)], "doc_id bigint, context string, passage string")

    def coder(context, passage):
        return {"bad": "no json", "": '{"x": null}'}.get(passage, '{"x": 5}')

    got = rows(coding.profile_documents(docs, coder, ["x"]))
    assert got == [(1, "5", None), (2, None, "no JSON object in the answer"), (3, None, None)]
    v = coding.embed(spark.createDataFrame([(1, "ab"), (2, None)], "doc_id bigint, text string"), coding.letter_encoder, 768)
    by = {r.doc_id: r.embedding for r in v.collect()}
    assert by[1][ord("a")] == pytest.approx(0.5**0.5, abs=1e-6) and not any(by[2]) and len(by[2]) == 768
    path, calls = f"file://{tmp_path}/out", []
    assert coding.write_if_available(lambda: calls.append(1), spark.range(2), path)
    assert not coding.write_if_available(lambda: 1 / 0, spark.range(9), path) and spark.read.parquet(path).count() == 2
    busy = []

    def service(prompt, passage):
        busy.append(1)
        if len(busy) < 3:
            raise coding.TransientError("429")
        return "{}"

    assert coding.with_retry(service)("p", "t") == "{}" and len(busy) == 3
    with pytest.raises(coding.TransientError):
        coding.with_retry(lambda p, t: (_ for _ in ()).throw(coding.TransientError("429")))("p", "t")


def test_intake_of_a_folder_and_of_one_file(spark, tmp_path):
    from inkfold.streaming import intake

    like = spark.createDataFrame([], "doc_id bigint, n bigint")
    for name, ids in (("a[1].parquet", [1, 2, 3]), ("b.parquet", [3, 4])):
        spark.createDataFrame([(i, i) for i in ids], "doc_id bigint, n bigint").coalesce(1).toPandas().to_parquet(tmp_path / name)
    for source, want in ((f"file://{tmp_path}/", {1, 2, 4}), (f"file://{tmp_path}/a[1].parquet", {1, 2})):
        out = f"file://{tmp_path}-out-{len(want)}"
        intake.admit(intake.stream_parquet(spark, source, like), F.col("n") != 3, f"{out}/table", f"{out}/checkpoint")
        got = [r.doc_id for r in spark.read.schema("doc_id bigint, batch int").parquet(f"{out}/table").collect()]
        assert sorted(got) == sorted(want)


def prose_of(n):
    return [f"<p>Paragraph {k} is long enough to count as prose, as it has a stop.</p>" for k in range(n)]


def test_content_root_needs_three_paragraphs():
    for n, root in ((2, "body"), (3, "article")):
        page = "<p>Outside.</p><article>" + "".join(prose_of(n)) + "</article>"
        assert html.content_root(html.walked(page).elements) == root
        assert ("body", [], "Outside.") in html.page_blocks(page) or root == "article"
    both = "<article>" + "".join(prose_of(5)) + "</article><main>" + "".join(prose_of(3)) + "</main>"
    assert html.content_root(html.walked(both).elements) == "main"
    second = "<article><p>One.</p></article><article>" + "".join(prose_of(4)) + "</article>"
    assert html.content_root(html.walked(second).elements) == "body"  # only the first one counts


def test_page_walk():
    page = "<nav><p>skip.</p></nav><main><h1>T</h1><p><b>one.<p>two &amp; more.<script>var a='</p>'</script><h2>S</h2><p>S</p><h4>deep</h4><li>An item that has thirty characters.</li><li>short.</li><h3>mid</h3><blockquote><p>said.</p></blockquote><p>— who</p><h2>Next</h2><p>three.</p></main><footer><p>x</p></footer>"
    assert html.page_blocks(page) == [
        ("title", [], "T"), ("body", [], "one."), ("body", [], "two & more."), ("section_heading", [], "S"), ("section_heading", ["S"], "deep"), ("body", ["S", "deep"], "An item that has thirty characters."),
        ("section_heading", ["S"], "mid"), ("quotation", ["S", "mid"], "said. — who"), ("section_heading", [], "Next"), ("body", ["Next"], "three."),
    ]
    assert html.page_blocks("") == [] and html.page_blocks(None) == []
    assert html.page_blocks("<title> A  b </title><p>x.</p>") == [("title", [], "A b"), ("body", [], "x.")]


def test_the_article_ends_at_boilerplate_headings():
    page = "<h1>T</h1><p>one.</p><h2>Related Content</h2><p>two.</p>"
    assert [t for _, _, t in html.page_blocks(page)] == ["T", "one."]
    assert [t for _, _, t in html.page_blocks("<h1>T</h1><p>one.</p><h1>U</h1><p>two.</p>")] == ["T", "one."]


def test_widgets_contents_and_bold_paragraphs():
    page = "<h1>T</h1><p>Share</p><p>5 minute read</p><p>Jun 15, 2025</p><p>no stop here</p><p>Try it now!</p><p>Try it now!</p><p><strong>Sub heading</strong></p><p><b>Bold.</b></p><p><b>a</b> b.</p><h2>Part</h2><p>Pillar 1</p><h3>Pillar 1</h3>"
    assert html.page_blocks(page) == [("title", [], "T"), ("section_heading", [], "Sub heading"), ("body", ["Sub heading"], "Bold."), ("body", ["Sub heading"], "a b."), ("section_heading", [], "Part"), ("pillar_name", ["Part"], "Pillar 1")]


def test_quotations_need_a_span_and_a_verb():
    quoted = "She said: “a span of twenty characters or more”."
    page = f"<h1>T</h1><p>{quoted}</p><p>- A. Person</p><p>“a span of twenty characters or more”, and no verb.</p>"
    assert html.page_blocks(page)[1:] == [("quotation", [], f"{quoted} - A. Person"), ("body", [], "“a span of twenty characters or more”, and no verb.")]
    twice = "<h1>T</h1><blockquote>Words.</blockquote><p>Words.</p><p>– me</p>"
    assert html.page_blocks(twice)[1:] == [("quotation", [], "Words. – me")]


def test_open_quotes_absorb_four_paragraphs():
    assert html.merged_quotes(["she said “a", "b” end", "c"]) == ["she said “a b” end", "c"]
    assert html.merged_quotes(["she said “a", *"bcdef"]) == ["she said “a b c d e", "f"]
    assert html.merged_quotes(['he added "a', 'b" c']) == ['he added "a b" c']
    assert html.merged_quotes(["“a", "b”"]) == ["“a", "b”"]  # nobody said it
    assert html.merged_quotes(["he says “a” and 5\" more", "b"]) == ["he says “a” and 5\" more", "b"]


def test_publication_dates(spark):
    pages = [
        '<meta name="date" content="2024-02-01"><meta property="article:published_time" content="2024-03-04T10:00Z">', "<meta content='2024-05-06' property='og:updated_time'><time datetime=\"2023-01-01\">x</time>",
        '<time class="a" datetime="2025-07-08T00:00">8 July</time> Published 1 May 2020', "<p>Published:  <b>9 August 2024</b></p>", "Published 31 February 2024", "Published 5 Foo 2024", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    got = [r[0] for r in df.orderBy("i").select(html.publication_date(F.col("h"))).collect()]
    assert got == ["2024-03-04", "2024-05-06", "2025-07-08", "2024-08-09", None, None, None, None]


def test_first_tier_that_is_good_enough(spark):
    df = spark.createDataFrame([("long enough", "x", "t"), ("no", "also long", "t"), (None, "no", "")], "a string, b string, c string")
    got = df.select(files.first_tier({"a": (F.col("a"), 5), "b": (F.col("b"), 5), "c": (F.col("c"), 1)}).alias("t")).collect()
    assert [r.t and tuple(r.t) for r in got] == [("a", "long enough"), ("b", "also long"), None]


def test_tolerant_answers():
    assert coding.parsed('```json\n{"applies": true}\n```') == {"applies": True}
    assert coding.parsed("no") is None and coding.parsed("{bad}") is None
    row = coding.coded(lambda p, t: '{"applies": true, "instances": []}', "u", "q", "p", "text")
    assert row == [("u", "q", 0, True, None, True, None)]
    calls = []

    def wrong_once(prompt, passage):
        calls.append(prompt)
        return '{"applies": true, "instances": [{"quote": "%s"}]}' % ("text" if len(calls) > 1 else "nope")

    assert coding.coded(wrong_once, "u", "q", "p", "text")[0][4:6] == ("text", True) and len(calls) == 2
    assert coding.coded(lambda p, t: 1 / 0, "u", "q", "p", "t")[0][6] == "division by zero"


def test_non_ascii_words_stay_in_grams(spark):
    df = spark.createDataFrame([("Été, l'école… ß!",)], "t string")
    assert df.select(X.ngram_text(F.col("t"))).collect()[0][0] == "été l'école ß"


def test_workbooks(spark, tmp_path):
    data = workbook.workbook([["a", "b", "c"], ["1", None, "x & <y>"], [], ["  ", "é"]])
    assert list(workbook.sheet_rows(data)) == [(2, ["1", None, "x & <y>"]), (3, []), (4, ["  ", "é"])]
    path = f"file://{tmp_path}/books"
    workbook.put(spark, f"{path}/one.xlsx", data)
    workbook.put(spark, f"{path}/two.xlsx", workbook.workbook([["h"]]))
    got = workbook.read_workbooks(spark, path).orderBy("row").collect()
    assert [(r.row, r.cells) for r in got] == list(workbook.sheet_rows(data)) and got[0].path.endswith("one.xlsx")
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"/><row r="5"><c r="AB5" t="s"><v>1</v></c><c r="AC5"><v>2.5</v></c><c r="AD5"/></row></sheetData></worksheet>')
    assert list(workbook.sheet_rows(out.getvalue())) == [(5, [None] * 27 + ["two", "2.5", None])]


def test_fetching_and_watching(spark):
    calls, pauses = [], []

    def service(url):
        calls.append(url)
        if url == "down":
            raise OSError("refused")
        return (429 if len(calls) < 2 else 200, "text")

    assert remote.fetched(service, "a") == ("a", 200, "text", 2, None)
    assert remote.fetched(service, "down") == ("down", None, None, 3, "refused")
    assert remote.fetched(lambda u: (404, "gone"), "x") == ("x", 404, None, 1, "status 404")
    assert remote.fetched(lambda u: (500, ""), "x") == ("x", 500, None, 3, "status 500")
    urls = spark.createDataFrame([("u",), (None,)], "url string")
    assert rows(remote.fetch_pages(urls, lambda u: (200, u * 2))) == [("u", 200, "uu", 1, None)]
    answers = iter([False, False, True])
    assert remote.watch(lambda: next(answers), pause=5, sleep=pauses.append) == 3 and pauses == [5, 5]
    assert remote.watch(lambda: False, attempts=2, sleep=pauses.append) == -2
