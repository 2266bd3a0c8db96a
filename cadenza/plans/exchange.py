"""Queries of sources and sinks: tables are written and read back through them, or brought into the form of a corpus and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import corpora, sinks
from ..storage import new_path
from .registry import query, table


@query("manifest_round_trip", """SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, coalesce(o_orderpriority, '') || ', "quoted"' AS remark, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def manifest_round_trip(spark, sf_dir):
    """IO-01, IO-02, IO-04: a manifest as CSV with quotes, commas and nulls."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.concat(F.coalesce("o_orderpriority", F.lit("")), F.lit(', "quoted"')).alias("remark"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("o_orderstatus")
    )
    path = new_path(spark, "manifest")
    sinks.write_csv(rows, path)
    return corpora.read_manifest(spark, path)


@query("combined_frames", """SELECT c_custkey AS key, c_name AS name, NULL::DOUBLE AS balance, 'c' AS origin FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal, 's' FROM supplier UNION ALL SELECT n_nationkey, n_name, NULL, NULL FROM nation""")
def combined_frames(spark, sf_dir):
    """IO-03, IO-19, SE-01: frames whose columns differ in number and order."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("c").alias("origin"))
    suppliers = table(spark, sf_dir, "supplier").select(F.lit("s").alias("origin"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    return corpora.combine([customers, suppliers, nations]).select("key", "name", "balance", "origin")


@query("kaldi_metadata", """SELECT 'u' || o_orderkey AS utterance_id, 's' || o_custkey AS speaker_id, CASE WHEN o_custkey % 3 = 0 THEN 'UNKNOWN' WHEN o_custkey % 3 = 1 THEN 'F' ELSE 'M' END AS speaker_gender,
    CASE WHEN o_custkey % 5 = 0 THEN (o_custkey % 60)::VARCHAR ELSE '' END AS speaker_age, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS transcript, 'wav/' || o_orderkey || '.wav' AS wav FROM orders""")
def kaldi_metadata(spark, sf_dir):
    """IO-06, IO-07: maps of lines with blank lines and padding, joined to utterances."""
    orders = table(spark, sf_dir, "orders")
    speakers = orders.select("o_custkey").distinct()
    utterance, speaker = F.concat(F.lit("u"), F.col("o_orderkey")), F.concat(F.lit("s"), F.col("o_custkey"))

    def lines(rows, key, value):
        return corpora.kaldi_map(rows.select(F.explode(F.array(F.lit("  "), F.concat(F.lit(" "), key, F.lit("  "), value, F.lit(" ")))).alias("value")))

    return corpora.utterance_metadata(
        lines(orders, utterance, speaker), lines(orders, utterance, F.concat(F.lit("wav\\"), F.col("o_orderkey"), F.lit(".wav"))), lines(orders.where("o_orderstatus <> 'F'"), utterance, F.col("o_orderpriority")),
        lines(speakers.where("o_custkey % 3 > 0"), speaker, F.when(F.col("o_custkey") % 3 == 1, "f").otherwise("m")), lines(speakers.where("o_custkey % 5 = 0"), speaker, (F.col("o_custkey") % 60).cast("string")),
    )


@query("scored_phones", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity % 20 / 10 AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem)
    SELECT 'u' || l_orderkey AS utterance_id, i::INTEGER AS word_index, p::INTEGER AS place, CASE p WHEN 0 THEN 'AH' ELSE 'T' END AS target_phone, round(a - 0.1 * p, 6) AS source_score, (round(a - 0.1 * p, 6) >= 1)::INTEGER AS gold_binary,
    (round(a - 0.1 * p, 6) < 1.8)::INTEGER AS attention_binary, CASE WHEN round(a - 0.1 * p, 6) >= 1.8 THEN 'correct' WHEN round(a - 0.1 * p, 6) >= 1 THEN 'acceptable' ELSE 'incorrect' END AS gold_three_class FROM r, range(2) t(p)""")
def scored_phones(spark, sf_dir):
    """IO-08: nested words of two phones with a score each."""
    score = F.col("l_quantity") % 20 / 10
    word = F.struct(
        F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.lit("w").alias("word"), F.array(F.lit("AH0"), F.lit("T")).alias("phones"),
        F.array(F.round(score, 6), F.round(score - 0.1, 6)).alias("accuracies"),
    )
    words = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("u"), F.col("l_orderkey")).alias("utterance_id")).agg(F.sort_array(F.collect_list(word)).alias("words"))
    found = corpora.scored_phones(words, words.select("utterance_id"))
    return found.select("utterance_id", "word_index", "place", "target_phone", "source_score", "gold_binary", "attention_binary", "gold_three_class")


@query("textgrid_tiers", """SELECT 'u' || l_orderkey AS path, 'phones "raw"' AS tier, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1)::INTEGER AS interval_index, l_linenumber::DOUBLE AS start,
    l_linenumber + 0.5::DOUBLE AS "end", CASE WHEN l_quantity < 10 THEN '' ELSE 'say "' || l_returnflag || '"' END AS text FROM lineitem""")
def textgrid_tiers(spark, sf_dir):
    """IO-05: a long TextGrid an order, with quotes in names and texts and a tier of points beside."""
    text = F.when(F.col("l_quantity") < 10, "").otherwise(F.concat(F.lit('say ""'), F.col("l_returnflag"), F.lit('""')))
    interval = F.format_string("            xmin = %s\n            xmax = %s\n            text = \"%s\"\n", F.col("l_linenumber").cast("string"), (F.col("l_linenumber") + 0.5).cast("string"), text)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", interval.alias("x")))).alias("all"))
    body = F.array_join(F.transform("all", lambda r, i: F.concat(F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n"), r["x"])), "")
    head = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\nitem []:\n    item [1]:\n        class = "TextTier"\n        name = "points"\n    item [2]:\n        class = "IntervalTier"\n        name = "phones ""raw"""\n'
    return corpora.tiers_of(rows.select(F.concat(F.lit("u"), F.col("l_orderkey")).alias("path"), F.concat(F.lit(head), body).alias("value")))


@query("strict_json", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 10 AND l_quantity <= 40 THEN l_quantity END AS quantity, l_returnflag FROM lineitem""")
def strict_json(spark, sf_dir):
    """IO-16, IO-17, IO-18: objects with NaN and infinite numbers as null, read back."""
    odd = F.when(F.col("l_quantity") < 10, float("nan")).when(F.col("l_quantity") > 40, float("inf")).otherwise(F.col("l_quantity"))
    rows = sinks.json_rows(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", odd.alias("quantity"), "l_returnflag"))
    whole = F.json_object_keys("value")
    parsed = rows.where(F.size(whole) == 4).select(F.from_json("value", "l_orderkey long, l_linenumber int, quantity double, l_returnflag string", {"allowNonNumericNumbers": "false"}).alias("x"))
    return parsed.select("x.*")


@query("resumed_features", """SELECT o_orderkey, count(*)::BIGINT AS n, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS run FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def resumed_features(spark, sf_dir):
    """IO-20, IO-21: a run that wrote a third of the orders is resumed; what it wrote is not computed again."""
    lines, path = table(spark, sf_dir, "lineitem"), new_path(spark, "features")
    todo = table(spark, sf_dir, "orders").select("o_orderkey")

    def features(orders, run):
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(run))

    sinks.append(features(todo.where("o_orderkey % 3 = 0"), 1), path)
    sinks.append(features(sinks.not_done(todo, spark.read.parquet(path), ["o_orderkey"]), 2), path)
    return spark.read.parquet(path)
