"""A corpus pipeline of five stages; each works on all that its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm import langid, minhash, secrets, spm, winnow
from inkfold.llm.common import keyed, shared_dir, table
from inkfold.llm.queries import tokenizer_file


#: A document whose best language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.4


def _quoted(docs: DataFrame) -> list[Column]:
    """The columns of documents, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """These names, longer where documents have a column of that name (in any case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in no language that the labels know, go.

    Null and empty texts have no letter; rows without doc_id go as well, as nothing
    could be reported about them; a document as likely in two languages is judged by
    that likelihood; long texts are read whole; repeated rows are judged alike and
    stay repeated; without any label, and in an empty table, no row stays; further
    columns stay as they are, whatever their names.
    """
    docs = docs.where("doc_id IS NOT NULL")
    model = langid.train(docs, key=F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")))
    lang, score = _unused(docs, "lang_pred", "score")
    judged = langid.identify(docs, model, lang_col=lang, score_col=score)
    return judged.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*_quoted(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates stays, once.

    Of rows that repeat a doc_id, the one with the least text stays (rows that
    differ in further columns only: the least in the order of those columns), so
    runs agree.  Texts without words are near nothing and stay; rows without doc_id
    go; long texts are compared whole; an empty table stays empty; further columns
    stay as they are, whatever their names.
    """
    groups = minhash.near_duplicates(docs)
    kept = groups.where("id = component").select(F.col("id").alias("doc_id")).distinct()
    stays = docs.join(kept, "doc_id", "left_semi")
    (row,) = _unused(docs, "row")
    # Columns without an order (maps) are compared as JSON.
    rest = [c if dict(docs.dtypes)[n].find("map<") < 0 else F.to_json(F.struct(c)) for c, n in zip(_quoted(docs), docs.columns)]
    often = stays.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    whole = F.struct(*_quoted(docs))
    one = stays.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct("text", *rest)).alias(row)).select(f"{row}.*")
    return stays.join(often, "doc_id", "left_anti").select(*_quoted(docs)).unionByName(one.select(*_quoted(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null or empty text holds nothing and stays, as do all documents where
    benchmark is empty; an item that is repeated, or ties with another, takes a
    document only once; rows that repeat a doc_id go if any of them holds a window;
    long texts are read whole; an empty table stays empty; further columns stay as
    they are, whatever their names.
    """
    met = winnow.hits(keyed(docs, "doc_id", "text"), keyed(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    return docs.join(met.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*_quoted(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret that the scan finds is cut out of the text; no document goes.

    Null texts stay null and empty ones empty; overlapping secrets are cut as one,
    named by the first; long texts are read whole; repeated rows stay repeated; an
    empty table stays empty; further columns stay as they are, whatever their names.
    """
    return secrets.redacted(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left as ids, and proof that they decode to their texts.

    Null and empty texts have no ids; ties between segmentations go as in the
    library; long texts and long words are encoded whole; rows without doc_id go;
    repeated rows repeat; an empty table gives no rows; further columns are not read.
    """
    path = tokenizer_file("piece_bpe_32k.model")
    back = spm.round_trip(docs, path)
    return back.select(F.col("id").alias("doc_id"), "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the trained classifier nor the decoding worklist.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/inkfold/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{base}/{k}_{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
