"""Lexicon counts, sections and retrieval of coding units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.text import pattern_counts, pattern_hits

#: The classes' patterns.
LEXICON = {
    "nominal": ["license(?!d)", "general public license", "gnu general public license"],
    "variant": ["licensed", "released under"],
    "distributive": ["the public", "everyone", "copyright"],
}


def term_counts(docs: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Hits of each class, and the distinct lower-case forms of the first one."""
    lexicon = lexicon or LEXICON
    first = next(iter(lexicon))
    forms = F.array_join(F.array_sort(F.array_distinct(F.transform(pattern_hits(F.col("text"), lexicon[first]), F.lower))), "; ")
    return docs.select("doc_id", *(pattern_counts(F.col("text"), p).alias(f"n_{c}") for c, p in lexicon.items()), forms.alias(f"{first}_forms"))


def term_status(nominal: Column, variant: Column) -> Column:
    return F.when(nominal > 0, "present").when(variant > 0, "variant").otherwise("absent")


def sections(blocks: DataFrame) -> DataFrame:
    """A heading begins a section; what stands before the first one is "(start)"."""
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    numbered = blocks.withColumn("run", F.sum((F.col("position") == "section_heading").cast("int")).over(order))
    # Dense from 0: a document that begins with a heading has no "(start)" section.
    per = numbered.groupBy("doc_id", "run").agg(
        F.count("*").alias("n_blocks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.min_by(F.when(F.col("position") == "section_heading", F.substring("text", 1, 120)), "ord").alias("heading"),
    )
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    return per.select("doc_id", index.cast("bigint").alias("section_idx"), F.coalesce("heading", F.lit("(start)")).alias("heading"), "n_blocks", "text")


def text_sections(text: Column, heading_chars: int) -> Column:
    """The same sections as an array, from a text's own lines: nothing is shuffled.

    The first line is the title; a later line of ``heading_chars`` characters at most
    is a heading.  Elements have ``section_idx, heading, n_blocks, text``.
    """
    lines = F.split(text, "\n")
    is_head = lambda i: F.length(F.get(lines, i)) <= heading_chars
    heads = F.when(F.size(lines) > 1, F.filter(F.sequence(F.lit(1), F.size(lines) - 1), is_head)).otherwise(F.array().cast("array<int>"))
    starts = F.concat(F.array(F.lit(0)), heads)
    ends = F.concat(heads, F.array(F.size(lines)))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda s, k: F.struct(
            k.cast("bigint").alias("section_idx"),
            F.when(k == 0, "(start)").otherwise(F.substring(F.get(lines, s["a"]), 1, 120)).alias("heading"),
            (s["b"] - s["a"]).cast("bigint").alias("n_blocks"),
            F.array_join(F.slice(lines, s["a"] + 1, s["b"] - s["a"]), "\n").alias("text"),
        ),
    )


def document_sections(docs: DataFrame, heading_chars: int) -> DataFrame:
    """``doc_id, section_idx, heading, n_blocks, text`` of ``doc_id, text``."""
    return docs.select("doc_id", F.explode(text_sections(F.col("text"), heading_chars)).alias("s")).select("doc_id", "s.*")


def coding_units(docs: DataFrame, heading_chars: int, short: int = 9000, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Sections with a hit of any class; whole short documents that have none.

    Both come from one scan: a document's own sections say whether it has a hit.
    """
    lexicon = lexicon or LEXICON
    every = [p for c in lexicon.values() for p in c]
    hits = docs.select("doc_id", "text", F.filter(text_sections(F.col("text"), heading_chars), lambda s: pattern_counts(s["text"], every) > 0).alias("hit"))
    unit = lambda name, how, chars: F.struct(name.alias("unit_id"), F.lit(how).alias("retrieval"), chars.cast("bigint").alias("chars"))
    sections_ = F.transform("hit", lambda s: unit(F.format_string("%d::s%02d", "doc_id", s["section_idx"]), "lexicon", F.length(s["text"])))
    whole = F.when((F.size("hit") == 0) & (F.length("text") <= short), F.array(unit(F.format_string("%d::full", "doc_id"), "full_short_doc", F.length("text"))))
    each = F.explode(F.concat(sections_, F.coalesce(whole, F.array().cast("array<struct<unit_id:string,retrieval:string,chars:bigint>>"))))
    return hits.select("doc_id", each.alias("u")).select("u.unit_id", "doc_id", "u.retrieval", "u.chars")


def top_by_similarity(similar: DataFrame, taken: DataFrame, k: int = 2, least: float = 0.52) -> DataFrame:
    """The ``k`` most similar sections of each document, then the threshold, then without those taken."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("similarity"), "section_idx"))
    return similar.withColumn("rank", rank).where(F.col("rank") <= k).where(F.col("similarity") >= least).join(taken, ["doc_id", "section_idx"], "left_anti").drop("rank")
