"""Transcript readers: JSONL and markdown to turns, exchanges, blocks and chunks, without running code on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Openings of injected text, which is no user turn.
INJECTED = r"^<(system-reminder|[A-Z]+_CONTEXT|[A-Z]+_MEMORY|function_calls>)"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of JSONL files; lines are numbered by their place in the file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return rows.filter(F.trim("value") != "")


def first_text(message: Column) -> Column:
    """Text of a message: its string content, else the first text block."""
    plain = F.try_variant_get(message, "$.message.content", "string")
    blocks = F.try_variant_get(message, "$.message.content", "array<struct<type:string,text:string>>")
    block = F.get(F.filter(blocks, lambda b: b["type"] == "text"), F.lit(0))["text"]
    return F.coalesce(block, plain)


def turns_of(lines: DataFrame, keys: list[str], injected: str = INJECTED) -> DataFrame:
    """Kept user and assistant turns of (keys, line, value) rows with a running index; broken lines and texts that open like `injected` are skipped."""
    v = lines.withColumn("v", F.try_parse_json("value")).filter("v IS NOT NULL")
    t = v.select(*keys, "line", F.try_variant_get("v", "$.type", "string").alias("role"), first_text(F.col("v")).alias("content"))
    t = t.filter(F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != "") & ~F.col("content").rlike(injected))
    return t.withColumn("turn_index", F.row_number().over(Window.partitionBy(*keys).orderBy("line")) - 1)


def digest(turns: DataFrame, keys: list[str], each: int = 300, most: int = 4000) -> DataFrame:
    """One text per session: turns cut to `each` characters, the last `most` characters of all."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring("content", 1, each))
    rows = turns.filter(F.col("role").isin("user", "assistant") & (F.col("content") != "")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn_index", line.alias("t")))).alias("rows"))
    return rows.select(*keys, F.right(F.array_join(F.transform("rows", lambda r: r["t"]), "\n"), F.lit(most)).alias("digest"))


def exchanges(turns: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """Each assistant turn of `least` characters with the user turn that is still unanswered before it."""
    talk = turns.filter(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy(*keys).orderBy("turn_index")
    t = talk.withColumns({"asked": F.lag("content").over(w), "who": F.lag("role").over(w)})
    t = t.filter((F.col("role") == "assistant") & (F.col("who") == "user") & (F.char_length("content") >= least))
    return t.select(*keys, "turn_index", F.regexp_replace("asked", r"^\[.*?\]\s*", "").alias("user"), F.col("content").alias("assistant"))


def chunk_markdown(docs: DataFrame, id_col: str, text_col: str, least: int = 10) -> DataFrame:
    """(id, chunk): runs of non-blank lines outside headings, bullets stripped, joined by spaces, longer than `least`."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    breaks = (F.col("line") == "") | F.startswith("line", F.lit("#"))
    block = F.sum(breaks.cast("int")).over(Window.partitionBy("id").orderBy("pos"))
    kept = lines.withColumn("block", block).filter(~breaks).withColumn("line", F.regexp_replace("line", r"^[-*] ", ""))
    out = kept.groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    return out.select("id", "block", F.array_join(F.transform("rows", lambda r: r["line"]), " ").alias("chunk")).filter(F.char_length("chunk") > least)


def fence_tables(text: Column) -> Column:
    """Runs of markdown table rows wrapped in code fences."""
    rows = F.transform(F.split(text, "\n"), lambda x: F.struct((F.startswith(F.trim(x), F.lit("|")) & F.endswith(F.trim(x), F.lit("|"))).alias("t"), x.alias("x")))

    def mark(r: Column, i: Column) -> Column:
        before, after = F.get(rows, i - 1), F.get(rows, i + 1)
        opens, closes = r["t"] & ~F.coalesce(before["t"], F.lit(False)), r["t"] & ~F.coalesce(after["t"], F.lit(False))
        return F.concat(F.when(opens, "```\n").otherwise(""), F.when(r["t"], F.trim(r["x"])).otherwise(r["x"]), F.when(closes, "\n```").otherwise(""))

    return F.array_join(F.transform(rows, mark), "\n")


def unchanged(files: DataFrame, manifest: DataFrame, key: str = "key", digest_col: str = "hash") -> DataFrame:
    """Files that are new or changed against the manifest of (key, hash)."""
    return files.join(manifest.select(key, digest_col), [key, digest_col], "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows of the table with the changes merged in: rules give each column from the old (t.) and new (n.) values."""
    joined = table.alias("t").join(changes.alias("n"), keys, "full_outer")
    return joined.select(*keys, *[expr.alias(name) for name, expr in rules.items()])
