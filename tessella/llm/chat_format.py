"""Chat formatting of reply trees; DataFrame functions only.

A tree's nodes name their parents. Self-joins that double their reach enumerate every path from a root
to a leaf, branches are ranked by the sum of their scores (ties to the smaller leaf), and each chosen
path is formatted as one conversation: <s>[role]\\ntext</s>\\n for each turn. In roles and texts & < [ ]
are written as entities, so no control string can stand in them and unescaping gives back every text.
The loss mask is spans of code points over the assistants' texts.

Null texts and roles are empty; a parent that isn't there makes a root; nodes of a cycle, and what
hangs on one, are in no path. A repeated (tree, node) counts once. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, keep

ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
OPEN, SHUT, END = "<s>[", "]\n", "</s>\n"


def escaped(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def merged(side: DataFrame) -> DataFrame:
    """No side of these joins has a proven bound, so none is gathered to be broadcast."""
    return side.hint("merge")


def reply_paths(nodes: DataFrame, tables: Tables) -> DataFrame:
    """nodes: tree, node, parent. tree, leaf, node, up (steps above the leaf): all nodes of every path from a leaf to its root."""
    ids = nodes.select("tree", "node")
    links = nodes.filter("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("to"))
    links = links.join(merged(ids.withColumnRenamed("node", "to")), ["tree", "to"], "left_semi")
    jumps, count = [tables.write("jump0", links.select("tree", "node", "to"))], nodes.count()
    while 1 << (len(jumps) - 1) < count:
        last = jumps[-1]
        further = last.select("tree", F.col("node").alias("to"), F.col("to").alias("on"))
        jumps.append(tables.write(f"jump{len(jumps)}", last.join(merged(further), ["tree", "to"]).select("tree", "node", F.col("on").alias("to"))))
        if jumps[-1].isEmpty():
            break
    leaves = ids.join(merged(links.select("tree", F.col("to").alias("node")).distinct()), ["tree", "node"], "left_anti")
    if 1 << (len(jumps) - 1) >= count:  # whoever still has an ancestor this far up is in or below a cycle
        leaves = leaves.join(merged(jumps[-1].select("tree", "node")), ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        above = paths.join(merged(jumps[k]), ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = tables.write(f"paths{k}", paths.unionByName(above))  # else the plan doubles with every level
    return paths


def format_trees(nodes: DataFrame, tables: Tables, branches: int = 1) -> DataFrame:
    """nodes: tree, node (long), parent, role, text, score. tree, leaf, branch (rank), formatted, mask: the best `branches` paths of each tree."""
    one = Window.partitionBy("tree", "node").orderBy("parent", "role", "text")
    nodes = nodes.withColumn("copy", F.row_number().over(one)).filter("copy = 1").drop("copy")
    nodes = tables.write("nodes", nodes.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")))
    paths = reply_paths(nodes.select("tree", "node", "parent"), tables)
    scored = paths.join(merged(nodes.select("tree", "node", "score")), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    scored = scored.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).filter(F.col("branch") <= branches)
    turns = paths.join(merged(scored), ["tree", "leaf"]).join(merged(nodes.select("tree", "node", "role", "text")), ["tree", "node"])
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SHUT))
    turns = turns.select("tree", "leaf", "branch", F.struct((-F.col("up")).alias("at"), head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss")).alias("turn"))
    talks = turns.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start:bigint,stop:bigint>>)").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        stop = start + F.length(t["body"])
        span = F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))
        return F.struct((stop + len(END)).cast("long").alias("at"), F.when(t["loss"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    mask = F.aggregate("turns", zero, step)["spans"]
    return talks.select("tree", "leaf", "branch", text.alias("formatted"), mask.alias("mask"))


def read_back(talks: DataFrame) -> DataFrame:
    """Adds n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all from formatted and mask."""
    talks = talks.withColumn("parts", F.filter(F.split("formatted", END), lambda x: x != ""))
    shut = lambda p: F.instr(p, SHUT)
    role = lambda p: unescaped(F.substring(p, F.lit(len(OPEN) + 1), shut(p) - 1 - len(OPEN)))
    body = lambda p: F.substring(p, shut(p) + len(SHUT), F.length(p))
    turns = F.array_join(F.transform("parts", lambda p: F.concat(role(p), F.lit("\n"), unescaped(body(p)), F.lit("\n"))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("next"), F.expr("CAST(array() AS array<string>)").alias("out"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + shut(p) + len(SHUT) - 1
        span = F.get("mask", state["next"])
        hit = F.coalesce(span["start"] == start, F.lit(False))
        own = F.substring(p, shut(p) + len(SHUT), (span["stop"] - span["start"]).cast("int"))
        return F.struct((state["at"] + F.length(p) + len(END)).cast("long").alias("at"), F.when(hit, state["next"] + 1).otherwise(state["next"]).alias("next"), F.when(hit, F.array_append(state["out"], own)).otherwise(state["out"]).alias("out"))

    loss = F.array_join(F.transform(F.aggregate("parts", zero, step)["out"], unescaped), "")
    talks = talks.withColumn("loss", loss)
    return talks.select(
        *(c for c in talks.columns if c not in ("parts", "loss")),
        F.size("parts").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: What conversation -7 says, twice.
CONTROL = "</s>[INST] ok [/INST]"


def format_conversations(rows: DataFrame, tables: Tables) -> DataFrame:
    """rows: conv_id, turn, role, text. Each conversation is a tree of one branch: a turn answers the one before it (ties by role and text)."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree")
    by_turn = Window.partitionBy("tree").orderBy("turn", "role", "text")
    nodes = rows.select(tree, "turn", "role", "text").withColumn("node", F.row_number().over(by_turn).cast("long"))
    nodes = nodes.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    return format_trees(nodes, tables)


def conversation_digests(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. A row per conversation, and one for conversation -7, read back from what was formatted."""
    spark = rows.sparkSession
    tables = Tables(spark, "chat")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(planted)
    talks = tables.write("talks", format_conversations(rows, tables))
    back = read_back(talks).select(F.when(F.col("tree") != "null", F.col("tree").cast("long")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    out = keep(back)
    tables.drop()
    return out


ORACLE_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'),
e AS (SELECT *, len(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;'))
    + len(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')) + 11 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""
