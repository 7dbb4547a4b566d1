"""Changes that are written: upserts, reloads, cascades on stored tables read back; answers streamed delta by delta."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.stored import shared_folder
from millrace.plans.registry import ORACLES, query, table
from millrace.plans.retrieval_queries import snk1_upsert
from millrace.sources import versions
from millrace.streaming import sentences


@query(ORACLES[snk1_upsert.__name__])
def snk1_applied_upsert(spark, sf_dir):
    """Rows by key replaced in a stored table; the batch comes twice, the second time it changes nothing."""
    root = shared_folder(spark, "orders")
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.lit(0).alias("fresh"))
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("v"), F.lit(1).alias("fresh"))
    versions.reload(root, old, ["k"], "orders")
    for _ in range(2):
        versions.upsert(root, new, ["k"], "line-items")
    return versions.current(spark, root)


@query("""
    SELECT 'customer' AS name, count(*) AS held, max(c_custkey) + 1 AS next_id FROM customer
    UNION ALL SELECT 'orders', count(*), max(o_orderkey) + 1 FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 'supplier', count(*), max(s_suppkey) + 1 FROM supplier
""")
def snk3_applied_loads(spark, sf_dir):
    """A table truncated and loaded anew, one with rows left alone, an empty one filled; sequences go on after the greatest id."""
    root = shared_folder(spark, "loads")
    read = lambda name: table(spark, sf_dir, name)
    places = {name: (f"{root}/{name}", [key]) for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey"))}
    versions.reload(places["customer"][0], read("customer").withColumn("c_custkey", F.col("c_custkey") + 7), places["customer"][1], "before")
    versions.reload(places["customer"][0], read("customer"), places["customer"][1], "reload")
    versions.reload(places["orders"][0], read("orders").where("o_orderkey % 2 = 0"), places["orders"][1], "before")
    versions.load_if_empty(places["orders"][0], read("orders"), places["orders"][1], "copy")
    versions.load_if_empty(places["supplier"][0], read("supplier"), places["supplier"][1], "copy")
    found = [versions.current(spark, p).agg(F.count(F.lit(1)).alias("held"), (F.max(k[0]) + 1).alias("next_id")).select(F.lit(n).alias("name"), "held", "next_id") for n, (p, k) in places.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""
    WITH gone AS (SELECT user_id FROM events WHERE event_type = 'signup' AND value < 3), kept AS (SELECT * FROM events WHERE user_id NOT IN (FROM gone))
    SELECT user_id, count(*) AS messages, max(event_id) AS last_message, count_if(event_type = 'view')::BIGINT AS patched FROM kept GROUP BY user_id
""")
def snk8_applied_cascade(spark, sf_dir):
    """Users deleted with their messages, messages patched, each user's last change set: all in stored tables."""
    root = shared_folder(spark, "app")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").withColumn("patched", F.lit(False))
    users = events.select("user_id").distinct().withColumn("last_message", F.lit(None).cast("long"))
    versions.reload(f"{root}/messages", events, ["event_id"], "insert")
    versions.reload(f"{root}/users", users, ["user_id"], "insert")
    gone = events.where("event_type = 'signup' AND value < 3").select("user_id").distinct()
    versions.delete(f"{root}/users", gone, ["user_id"], "delete")
    orphans = versions.current(spark, f"{root}/messages").join(versions.current(spark, f"{root}/users"), "user_id", "left_anti")
    versions.delete(f"{root}/messages", orphans, ["event_id"], "cascade")
    views = versions.current(spark, f"{root}/messages").where("event_type = 'view'").withColumn("patched", F.lit(True))
    versions.upsert(f"{root}/messages", views, ["event_id"], "patch")
    last = versions.current(spark, f"{root}/messages").groupBy("user_id").agg(F.max("event_id").alias("last_message"))
    versions.upsert(f"{root}/users", last, ["user_id"], "touch")
    messages = versions.current(spark, f"{root}/messages").groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if("patched").alias("patched"))
    return versions.current(spark, f"{root}/users").join(messages, "user_id").select("user_id", "messages", "last_message", "patched")


@query(r"""
    WITH a AS (SELECT conv_id, turn, text, conv_id % 3 = 0 AS warned, (length(text) + 6) // 7 AS k FROM conversations WHERE role = 'assistant' AND text <> ''),
    p AS (SELECT *, substring(text, 1, n * 7) AS prefix FROM (SELECT *, unnest(range(1, k + 1)) AS n FROM a)),
    f AS (SELECT conv_id, turn, text, warned, k, min(n) AS first, arg_min(prefix, n) AS held FROM p WHERE regexp_matches(prefix, '[.!?。]\s*|\n') OR length(prefix) >= 80 OR n = k GROUP BY ALL),
    e AS (SELECT *, regexp_extract(held, '^[^.!?。\n]*([.!?。]\s*|\n)') AS sentence FROM f),
    s AS (SELECT *, CASE WHEN sentence <> '' AND NOT warned AND contains(sentence, 'th') THEN regexp_replace(substring(held, length(sentence) + 1), '^\s+', '') ELSE held END AS start FROM e)
    SELECT conv_id || ':' || turn AS message_id, CAST(k - first + CASE WHEN start <> '' THEN 1 ELSE 0 END AS BIGINT) AS pieces, CASE WHEN start <> '' THEN first ELSE first + 1 END AS first_seq, md5(start || substring(text, first * 7 + 1)) AS text_md5
    FROM s WHERE start <> '' OR k > first
""")
def str1_streamed_answers(spark, sf_dir):
    """Answers as streams of seven characters at a time, in two batches: starts are held until their first sentence ends,
    and a first sentence with a phrase is dropped where no warning is due."""
    folder = shared_folder(spark, "answers")
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant' AND text <> ''").withColumn("k", F.expr("(length(text) + 6) DIV 7"))
    deltas = rows.select(F.concat_ws(":", "conv_id", "turn").alias("message_id"), "text", "k", (F.col("conv_id") % 3 == 0).alias("warned"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("seq"))
    deltas = deltas.select("message_id", "seq", F.expr("substring(text, cast(seq * 7 - 6 AS int), 7)").alias("delta"), "warned", (F.col("seq") == F.col("k")).alias("last"))
    for part in ("seq <= 5", "seq > 5"):  # the second part's files are newer, so they are a batch of their own
        deltas.where(part).coalesce(4).write.mode("append").parquet(f"{folder}/in")
    texts = sentences.run(spark, f"{folder}/in", f"{folder}/stream", deltas.schema, phrase="th")
    held = F.array_sort(F.collect_list(F.struct("seq", "text")))
    found = texts.groupBy("message_id").agg(F.count(F.lit(1)).alias("pieces"), F.min("seq").alias("first_seq"), held.alias("h"))
    return found.select("message_id", "pieces", "first_seq", F.md5(F.array_join(F.transform("h", lambda x: x["text"]), "")).alias("text_md5"))
