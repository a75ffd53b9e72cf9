"""The registered queries and the pipeline on a small folder of tables, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_small import brute_groups, brute_hits, brute_repeats, brute_scores, edited, own_tokenizer, prose, scored_alike

import corpus_pipeline
from inkfold.llm import queries, secrets

ALPHABETS = {"aa": "abcdeé", "bb": "fghijkü"}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    rnd = random.Random(11)
    say = lambda x, n: " ".join("".join(rnd.choice(ALPHABETS[x]) for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    items = {i: say("aa", 16) for i in range(4)}
    docs = []
    for i in range(90):
        x = rnd.choice(["aa", "bb"])
        docs.append((i, say(x, rnd.randrange(20, 60)), x))
    docs += [(100 + i, edited(rnd, docs[3][1], 1), docs[3][2]) for i in range(6)] + [(110, docs[5][1], docs[5][2])]
    docs += [(120, f"{say('aa', 12)} {items[2]} {say('aa', 5)}", "aa"), (121, f"{say('bb', 30)} password=hunter2222", "bb"), (122, None, "aa"), (123, "12 34 !!", None), (124, "", "bb")]
    folder = tmp_path_factory.mktemp("tables")
    ids, texts, langs = zip(*docs)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": ["s"] * len(ids), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(list(items), pa.int64()), "text": list(items.values())}), folder / "benchmark.parquet")
    return str(folder), {i: t for i, t, _ in docs}, {i: x for i, _, x in docs}, items


def rows_of(spark, name, folder):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}


def test_op1(spark, tables):
    got = rows_of(spark, "op1_minhash_dedup", tables[0])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_groups(tables[1], 2, 80, 100)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_op2(spark, tables):
    got = rows_of(spark, "op2_lm_score", tables[0])
    crc = {i: zlib.crc32(str(i).encode()) for i in tables[1]}
    assert all(got[i].held_out == (crc[i] % 7 == 2) for i in crc)
    scored_alike(got, brute_scores(tables[1], lambda i: crc[i] % 7 != 2, lambda i: crc[i] // 7 % 7 == 0, 3))


def test_op3(spark, tables):
    got = rows_of(spark, "op3_suffix_dedup", tables[0])
    want = {i: (*r[:3], hashlib.sha256(r[3]).hexdigest()) for i, r in brute_repeats(tables[1], 50).items()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want


def test_op4(spark, tables):
    got, start = rows_of(spark, "op4_token_shards", tables[0]), 0
    t = own_tokenizer(queries.tokenizer_file("byte_bpe_50k.json"))
    for i in sorted(tables[1]):
        ids = [*t.encode(tables[1][i] or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5(spark, tables):
    got = rows_of(spark, "op5_secret_scan", tables[0])
    for i, t in tables[1].items():
        found = secrets.scan_text(t or "")
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, is_base in found if is_base)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[i].spans == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in found)
    assert (got[121].n_assign, got[121].n_access, got[121].n_hex) == (1, 0, 0)


def test_op7(spark, tables):
    got = rows_of(spark, "op7_decontamination", tables[0])
    for i, (n, hit, items) in brute_hits(tables[1], tables[3]).items():
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0)
    assert got[120].contaminated


def test_op8(spark, tables):
    got = rows_of(spark, "op8_language_id", tables[0])
    real = [i for i, x in tables[2].items() if i < 121]
    assert sum(got[i].lang_pred == tables[2][i] for i in real) >= 0.97 * len(real)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert {got[i].lang_pred for i in (122, 123, 124)} == {"und"}


def test_op10(spark, tables):
    sentencepiece = pytest.importorskip("sentencepiece")
    p = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    got = rows_of(spark, "op10_sentencepiece", tables[0])
    for i, t in tables[1].items():
        ids = p.encode(t or "")
        assert (got[i].n_ids, got[i].ids_crc32, got[i].decoded_sha256) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest())


def test_pipeline(spark, tables):
    folder, texts, _, items = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "sentencepiece"]
    left = {i: t for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    left = {i: left[i] for i, (_, c) in brute_groups(left, 5, 80, 100).items() if c == i}
    left = {i: secrets.redact(left[i]) for i, (_, hit, _) in brute_hits(left, items).items() if not hit}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}
    assert 120 not in got and 110 not in got and 121 in got and "hunter2222" not in left[121]


CLASHES = ["a.b", "_lang", "score", "lang_pred", "id", "spans", "component", "n", "words", "met", "hash", "row", "item", "from", "rep"]


@pytest.fixture(scope="module")
def odd_documents(spark, tables):
    """The tables' documents with repeats, null ids, an id of two texts, a long text, and columns of clashing names."""
    from pyspark.sql import functions as F

    _, texts, langs, _ = tables
    rnd = random.Random(17)
    long = " ".join("".join(rnd.choice(ALPHABETS["aa"]) for _ in range(6)) for _ in range(20_000))
    rows = [(i, t, langs[i]) for i, t in texts.items()] + [(7, texts[7], langs[7]), (None, texts[8], langs[8]), (9, "Zweite " + texts[10], langs[9]), (300, long, "aa"), (301, None, "aa")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return df.select("*", F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"), *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_handle_odd_rows(spark, tables, odd_documents, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_documents, tables[0])
    assert out.columns == odd_documents.columns
    got, before = out.collect(), odd_documents.collect()
    place = {c: i for i, c in enumerate(odd_documents.columns)}
    assert all([r[place[c]] for c in CLASHES] == list(range(len(CLASHES))) for r in got)
    ids = sorted((r.doc_id for r in got), key=str)
    if name == "language_id":
        assert None not in ids and ids.count(7) == 2 and 300 in ids and not {122, 123, 124, 301} & set(ids)
        assert {r.doc_id for r in before if r.text and re.search(r"[^\W\d_]", r.text) and r.doc_id is not None} == set(ids)
    elif name == "near_dedup":
        assert None not in ids and len(ids) == len(set(ids)) and {122, 124, 300, 301} <= set(ids) and 110 not in ids
        assert [r.text for r in got if r.doc_id == 9] == [min(r.text for r in before if r.doc_id == 9)]
    elif name == "decontamination":
        assert len(ids) == len(before) - 1 and 120 not in ids
    else:
        assert len(ids) == len(before) and not any(r.text and "hunter2222" in r.text for r in got)
        assert sum(r.text is None for r in got) == sum(r.text is None for r in before)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_an_empty_table(spark, tables, odd_documents, k):
    out = corpus_pipeline.STAGES[k][1](spark, odd_documents.limit(0), tables[0])
    assert out.count() == 0 and (k == 4 or out.columns == odd_documents.columns)


def test_last_stage_on_odd_rows(spark, tables, odd_documents):
    got = corpus_pipeline.sentencepiece(spark, odd_documents, tables[0]).collect()
    want = [r for r in odd_documents.collect() if r.doc_id is not None]
    assert len(got) == len(want)
    assert sorted((r.doc_id, r.decoded_sha256) for r in got) == sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in want)
