"""Readers and writers of the pipeline's file formats."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions.text import norm_key
from querymill.operators.stats import hash_order, latest

CLICK_NAMES = {"query": "query_text"}
CLICK_COLUMNS = ["sku_id", "sku_name", "sku_brand_name", "sku_price", "query", "sku_position"]


def click_scan(df: DataFrame, columns: list[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Only the wanted columns, renamed; the scan reads no others."""
    return df.select(*(columns or CLICK_COLUMNS)).withColumnsRenamed(names or CLICK_NAMES)


def fraction(df: DataFrame, key: list[str], share: float, seed: str = "42") -> DataFrame:
    """``greatest(1, floor(rows * share))`` rows in the fixed random order of the key."""
    n = max(1, int(df.count() * share))
    return df.orderBy(hash_order(*key, seed=seed), *key).limit(n)


def schema_names(df: DataFrame) -> DataFrame:
    """``column_name`` of every column; reads no data."""
    return df.sparkSession.createDataFrame([(c,) for c in df.schema.names], "column_name string")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``phrase`` of each line that isn't blank, trimmed; a path that doesn't exist gives none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], "phrase string")
    return spark.read.text(path).select(F.trim("value").alias("phrase")).where("phrase <> ''")


def write_phrases(phrases: DataFrame, col: str, path: str) -> None:
    """Distinct normal forms, longest first, then by text, one a line."""
    key = norm_key(F.col(col)).alias("value")
    phrases.select(key).where("value <> ''").distinct().orderBy(F.desc(F.length("value")), "value").coalesce(1).write.mode("overwrite").text(path)


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """``canon, alias`` of a file ``canon<TAB>alias,alias``; lines with # are comments."""
    cut = F.split("phrase", "\t")
    rows = lines(spark, path).where(~F.col("phrase").startswith("#") & (F.size(cut) >= 2))
    return rows.select(F.trim(cut[0]).alias("canon"), F.explode(F.split(cut[1], ",")).alias("alias")).select("canon", F.trim("alias").alias("alias")).where("alias <> '' AND canon <> ''")


GOLD = "index int, query string, tags array<string>, subtypes map<string,string>, annotator string, ts string"


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows with ``tokens`` where the words by white space match the tags in number, else null tokens."""
    words = F.filter(F.split("query", r"\s+"), lambda w: w != "")
    return spark.read.schema(GOLD).json(path).withColumn("tokens", F.when(F.size(words) == F.size("tags"), words))


def gold_strict(rows: DataFrame) -> DataFrame:
    """Gold rows whose tags match the strict tokens of the query, with the spans of tokens and of entities.

    ``index, query, tokens, tags, entities``: tokens with [start, end) offsets, entities as (label, start, end) in characters.
    """
    from querymill.functions.bio import spans
    from querymill.functions.text import token_spans

    own = rows.where("query IS NOT NULL").select("index", "query", token_spans(F.col("query")).alias("tokens"), "tags").where("size(tokens) = size(tags)")
    cut = F.transform(spans(F.col("tags")), lambda s: F.struct(s["label"].alias("label"), F.get("tokens", s["start"])["start"].alias("start"), F.get("tokens", s["end"] - 1)["end"].alias("end")))
    return own.withColumn("entities", cut)


def gold_report(rows: DataFrame) -> DataFrame:
    """``n_raw, n_usable, n_skipped``."""
    return rows.agg(F.count(F.lit(1)).alias("n_raw"), F.count("tokens").alias("n_usable")).withColumn("n_skipped", F.col("n_raw") - F.col("n_usable"))


#: Names under which a list of offers may lie, and those of an offer's fields, the first that is there.
OFFER_LISTS = ("offer", "offers")


def _offers_of(node: object) -> Iterator[dict]:
    """All offers below a node, at any depth: the objects of lists under one of the names, or of a list at the top."""
    if isinstance(node, list):
        for x in node:
            yield from _offers_of(x)
    elif isinstance(node, dict):
        for name, x in node.items():
            own = x if isinstance(x, list) else [x] if name == "offer" else []
            if name in OFFER_LISTS and any(isinstance(o, dict) for o in own):
                yield from (o for o in own if isinstance(o, dict))
            else:
                yield from _offers_of(x)


def catalog_offers(spark: SparkSession, path: str, most: int | None = None, lines_: bool = False) -> DataFrame:
    """Offers of nested catalog dumps in JSON: ``offer_id, name, brand, category_id, url, price`` as strings.

    Offers are looked for at any depth, and names vary between dumps, so each field is the first of several that is there.
    A dump is a whole file, read by one task, or with ``lines_`` a line, which lets large dumps be split. Text that is no
    JSON has no offers.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                try:
                    top = json.loads(text, parse_float=str, parse_int=str)
                except ValueError:
                    continue
                found = [o for o in top if isinstance(o, dict)] if isinstance(top, list) else list(_offers_of(top))
                for o in found:
                    first = lambda *names, o=o: next((str(o[n]) for n in names if o.get(n) is not None), None)
                    rows.append((first("@id", "id"), first("name", "model"), first("vendor", "brand"), first("categoryId", "category_id"), first("url"), first("price")))
            yield pd.DataFrame(rows, columns=["offer_id", "name", "brand", "category_id", "url", "price"])

    raw = spark.read.text(path, wholetext=not lines_)
    out = raw.mapInPandas(parse, "offer_id string, name string, brand string, category_id string, url string, price string")
    return out.orderBy("offer_id").limit(most) if most else out


#: Values keep line ends, quotes (doubled), backslashes and outer white space; '' is quoted, null is not.
CSV = {"multiLine": True, "lineSep": "\n", "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": "\0", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header whose first line carries the byte order mark that spreadsheets look for."""
    first = df.columns[0]
    df.withColumnRenamed(first, "\ufeff" + first).coalesce(1).write.mode("overwrite").options(header=True, **CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, with or without the byte order mark; the schema is given, never inferred."""
    return spark.read.schema(schema).options(header=True, enforceSchema=True, nullValue="\ufdd0", **CSV).csv(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a store, in order; a folder without its success mark is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(jpath)] if fs.exists(jpath) else []
    whole = [n for n in names if re.fullmatch(r"v\d+", n) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in whole)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    """The last complete version of a store; no rows without one."""
    have = _versions(spark, path)
    return spark.read.schema(schema).json(f"{path}/v{have[-1]}") if have else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: list[str], order: list[str], keep: int = 2) -> None:
    """Keyed upsert of a JSON lines store: the last write of each key stays.

    Every upsert writes the next version beside the last; readers take the last one that is complete, so a crash at any
    time loses nothing. The ``keep`` newest versions stay.
    """
    have = _versions(spark, path)
    both = stored(spark, path, rows.schema).unionByName(rows) if have else rows
    number = have[-1] + 1 if have else 0
    latest(both, key, order).orderBy(*key).write.mode("overwrite").json(f"{path}/v{number}")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    for old in have[: max(0, len(have) - keep + 1)]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}"), True)


def append_log(df: DataFrame, path: str) -> None:
    """Append to a JSON lines log."""
    df.write.mode("append").json(path)


def write_journal(df: DataFrame, path: str) -> None:
    """Append the rows to a Markdown journal, one table row each; bars and line ends in values are escaped."""
    cells = [F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "[\\r\\n]+", " ") for c in df.columns]
    df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("append").text(path)


def write_rows(df: DataFrame, path: str) -> None:
    """A table of any size as CSV, JSON or Parquet, by the ending of the path, a file a task."""
    w = df.write.mode("overwrite")
    if path.endswith(".csv"):
        w.option("header", True).csv(path)
    elif path.endswith(".json"):
        w.json(path)
    else:
        w.parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A metric table, which is small, in one file."""
    write_rows(df.coalesce(1), path)
