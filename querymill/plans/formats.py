"""Queries of the readers and writers: rows written in a format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from querymill.plans.clicks import strip_sql
from querymill.plans.registry import CORE
from querymill.plans.text import _W, _dash, _spaced
from querymill.sources import readers as R
from querymill.sources.tables import shared_dir, table


def _place(spark) -> str:
    return f"{shared_dir(spark)}/format-{uuid.uuid4().hex}"


@CORE.add("SELECT cand_id, query, label FROM candidates_to_label WHERE label IS NOT NULL")
def format_csv(spark, sf):
    """All labels written as CSV and read back, whatever their queries hold."""
    p = _place(spark)
    R.write_csv(table(spark, sf, "candidates_to_label").where("label IS NOT NULL").select("cand_id", "query", "label"), p)
    return R.read_csv(spark, p, "cand_id long, query string, label int")


@CORE.add("SELECT sku_id, name, brand, price FROM flat_catalog WHERE sku_id % 3 <> 0 UNION ALL SELECT sku_id, name, 'new', price FROM flat_catalog WHERE sku_id % 3 = 0")
def format_upsert(spark, sf):
    """Rows upserted twice into a JSON lines store."""
    p = _place(spark)
    c = table(spark, sf, "flat_catalog").withColumn("ts", F.lit(1))
    R.upsert(spark, c, p, ["sku_id"], ["ts"])
    R.upsert(spark, c.where("sku_id % 3 = 0").withColumn("brand", F.lit("new")).withColumn("ts", F.lit(2)), p, ["sku_id"], ["ts"])
    return R.stored(spark, p, c.schema).drop("ts")


@CORE.add("SELECT canon, alias FROM spell_aliases")
def format_aliases(spark, sf):
    """The alias list written as lines and read back."""
    p = _place(spark)
    a = table(spark, sf, "spell_aliases").groupBy("canon").agg(F.array_join(F.array_sort(F.collect_list("alias")), ",").alias("l"))
    a.select(F.concat_ws("\t", "canon", "l").alias("value")).union(spark.createDataFrame([("# canon and aliases",), ("",)], "value string")).write.text(p)
    return R.aliases(spark, p)


@CORE.add("SELECT sku_id::VARCHAR AS offer_id, name, brand, round(price * 100)::BIGINT AS cents FROM flat_catalog")
def format_offers(spark, sf):
    """Offers of nested catalog dumps, a dump a line, at varying depth and under varying names."""
    p = _place(spark)
    c = table(spark, sf, "flat_catalog").withColumn("sku", F.col("sku_id").cast("string"))
    deep = F.to_json(F.struct(F.struct(F.struct(F.struct(F.array(F.struct(F.col("sku").alias("@id"), "name", F.col("brand").alias("vendor"), "price")).alias("offer")).alias("offers")).alias("shop")).alias("yml_catalog")))
    flat = F.to_json(F.array(F.struct(F.col("sku").alias("id"), "name", "brand", "price")))
    odd = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(F.col("sku").alias("id"), F.col("name").alias("model"), "brand", "price")).alias("offers")).alias("list")).alias("export")))
    c.select(F.when(F.col("sku_id") % 3 == 0, deep).when(F.col("sku_id") % 3 == 1, flat).otherwise(odd).alias("value")).write.text(p)
    return R.catalog_offers(spark, p, lines_=True).select("offer_id", "name", "brand", F.round(F.col("price").cast("double") * 100).cast("long").alias("cents"))


@CORE.add("SELECT sum((n > 0)::INT)::BIGINT AS n_raw, sum(ok)::BIGINT AS n_usable, sum(1 - ok)::BIGINT AS n_skipped FROM (SELECT 1 AS n, (item_id % 4 <> 0)::INT AS ok FROM benchmark WHERE query <> '')")
def format_gold(spark, sf):
    """Gold rows of which every fourth has a tag too many."""
    p = _place(spark)
    b = table(spark, sf, "benchmark").where("query <> ''").select("item_id", "query", F.filter(F.split("query", r"\s+"), lambda w: w != "").alias("w"))
    tags = F.transform("w", lambda _: F.lit("O"))
    b.select(F.col("item_id").alias("index"), "query", F.when(F.col("item_id") % 4 == 0, F.concat(tags, F.array(F.lit("O")))).otherwise(tags).alias("tags")).write.json(p)
    return R.gold_report(R.gold(spark, p))


@CORE.add(
    f"SELECT DISTINCT key AS phrase FROM (SELECT {_spaced(f'''regexp_replace({_dash(f"regexp_replace(translate(lower({strip_sql('brand')}), 'ё', 'е'), '[_\\x{{A0}}]+', ' ', 'g')")}, '[^{_W}\\s\\p{{Z}}\\x{{85}}.\\-]', ' ', 'g')''')} AS key FROM brands) WHERE key <> ''"
)
def format_phrases(spark, sf):
    """All brands written as a phrase list and read back."""
    p = _place(spark)
    R.write_phrases(table(spark, sf, "brands"), "brand", p)
    return R.lines(spark, p)


@CORE.add("SELECT count(*) AS n, sum(len(entities))::BIGINT AS n_entities FROM benchmark WHERE query <> '' AND len(entities) >= 0")
def format_gold_strict(spark, sf):
    """Gold rows of the benchmark read by strict tokens: rows, and entities whose characters come back."""
    from querymill.plans.learned import _sentences

    p = _place(spark)
    b = table(spark, sf, "benchmark").where("query <> '' AND entities IS NOT NULL").select(F.col("item_id").alias("id"), "query", F.size("entities").alias("k"))
    s = _sentences(spark, sf).join(b, "id")
    s.select(F.col("id").alias("index"), "query", "tags").write.json(p)
    g = R.gold_strict(R.gold(spark, p))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("entities")).cast("long").alias("n_entities"))
