"""File sources and sinks with explicit schemas; any path that Spark can open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, comment: str | None = None) -> DataFrame:
    """Header and quoted fields over several lines; ``comment`` marks lines to leave out."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def csv_notes(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith(comment)).select(F.ltrim(F.regexp_replace("value", f"^{comment}+", "")).alias("note"))


def count_or_zero(c: Column) -> Column:
    """A typed count: blank or unreadable is 0."""
    return F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0))


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document in each file, over as many lines as it takes."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and undecodable ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_lines(spark: SparkSession, base: str, schema: str, by: str, skip: list[str], prefix: str) -> DataFrame:
    """JSON lines of the folders ``by=name`` under ``base``, without the names in ``skip`` and those that begin with ``prefix``.

    Folders that are left out are pruned before anything is read.
    """
    df = spark.read.schema(f"{schema}, {by} string").option("mode", "DROPMALFORMED").json(base)
    return df.where(~F.col(by).isin(skip) & ~F.col(by).startswith(prefix)).drop(by)


def first_tier(tiers: dict[str, tuple[Column, int]]) -> Column:
    """``tier, content`` of the first source whose content has its least length; null if none has."""
    some = (F.when(F.length(c) >= least, F.struct(F.lit(name).alias("tier"), c.alias("content"))) for name, (c, least) in tiers.items())
    return F.coalesce(*some)


def json_map(column: Column, value_ddl: str) -> Column:
    """Entries of a JSON object as an array of (key, value)."""
    return F.map_entries(F.from_json(column, f"map<string,{value_ddl}>"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite the partitions that ``df`` has; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_with_union(df: DataFrame, path: str) -> DataFrame:
    """Append rows that may have new columns; the table then has the columns of both, null where a file has none.

    Old files stay as they are: the schemas are merged when the table is read, and
    returned with it.
    """
    append(df, path)
    return df.sparkSession.read.option("mergeSchema", True).parquet(path)


def merge_overwrite(new: DataFrame, path: str, by: str, order: list[str]) -> None:
    """Replace the ``by`` values that ``new`` has, keep the others; every partition is sorted by ``order``.

    The table is partitioned by ``by``: partitions without new rows are not touched.
    """
    rows = new.repartition(by).sortWithinPartitions(by, *order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_with_banner(df: DataFrame, path: str, covered: int, total: int, least: float = 0.995) -> None:
    """A CSV whose first line says ``# STATUS: PARTIAL``, with the coverage, unless ``least`` of it is covered.

    The line is a file of its own that sorts before the rows' files.
    """
    write_csv(df, path)
    if covered < least * total:
        line = df.sparkSession.createDataFrame([(f"# STATUS: PARTIAL ({covered} of {total})",)], "value string")
        line.coalesce(1).write.mode("append").text(path)


def read_yaml(spark: SparkSession, text: str) -> DataFrame:
    """A small configuration ``{class: [pattern, ...]}`` as ``class, pattern`` rows."""
    import yaml

    entries = yaml.safe_load(text) or {}
    rows = [(k, p) for k, v in entries.items() if isinstance(v, list) for p in v]
    return spark.createDataFrame(rows, "class string, pattern string")


def to_yaml(df: DataFrame) -> str:
    """``class, pattern`` rows as YAML text; for configuration-sized tables only."""
    import yaml

    out: dict[str, list[str]] = {}
    for r in df.orderBy("class", "pattern").collect():
        out.setdefault(r["class"], []).append(r["pattern"])
    return yaml.safe_dump(out, allow_unicode=True)
