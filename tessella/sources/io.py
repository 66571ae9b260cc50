"""Readers and writers of problem tables and logs. Schemas are declared, never inferred."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt"


def read_problem_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with quoted cells that hold line breaks and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no JSON keeps its text in `_corrupt` and nulls elsewhere."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array or object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_episodes(spark: SparkSession, arrays: str | None, lines: str | None, schema: str) -> DataFrame:
    """Episodes from files of JSON arrays and of JSON lines together."""
    parts = [read_json_array(spark, arrays, schema)] if arrays else []
    if lines:
        parts.append(spark.read.schema(schema).json(lines))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_tasks(spark: SparkSession, path: str, schema: str, task: Column, wanted: list[str]) -> DataFrame:
    """Problems from JSON lines whose derived task is wanted; lines that are no JSON are left out."""
    rows = read_json_lines(spark, path, schema).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return rows.withColumn("task", task).filter(F.col("task").isin(wanted))


def sniffed(cell: Column) -> Column:
    """A text cell as JSON text of its value: true and false in any case, numbers, JSON objects and lists; other text as a string; empty as null.

    One column has one type in a table, so the value stays JSON text until a schema is applied.
    """
    t = F.trim(cell)
    number = F.when(t.rlike(r"^[-+]?\d+$"), t.try_cast("bigint").cast("string")).when(t.rlike(r"^[-+]?(\d+\.\d*|\.\d+)([eE][-+]?\d+)?$"), t.try_cast("double").cast("string"))
    flag = F.when(F.lower(t).isin("true", "false"), F.lower(t))
    nested = F.when(t.rlike(r"^[\[{]"), F.coalesce(F.to_json(F.from_json(t, "map<string,string>")), F.when(F.json_array_length(t).isNotNull(), t)))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(t != "", F.coalesce(flag, number, nested, quoted))


def result_parts(spark: SparkSession, path: str, metrics: str, episodes: str, episode_schema: str) -> tuple[DataFrame, DataFrame]:
    """From result documents of one JSON object each: (file, name, value) of the numbers in object `metrics`, and (file, episode columns) of list `episodes`."""
    schema = f"`{metrics}` map<string,string>, `{episodes}` array<struct<{episode_schema}>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    numbers = docs.select("file", F.explode(F.col(metrics)).alias("name", "value")).withColumn("value", F.col("value").try_cast("double")).filter("value is not null")
    return numbers, docs.select("file", F.inline(F.col(episodes)))


def with_questions(problems: DataFrame, questions: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Problems with their question lists, from `fallback` where the first source has none; an empty list where neither has."""
    first = questions.select(key, F.col("questions").alias("_a"))
    other = fallback.select(key, F.col("questions").alias("_b"))
    return problems.join(first, key, "left").join(other, key, "left").withColumn("questions", F.coalesce("_a", "_b", F.array().cast("array<string>"))).drop("_a", "_b")


def write_statistics(df: DataFrame, path: str, columns: list[str]) -> None:
    """Statistics as JSON with sorted fields and as CSV with the given columns in order, below one folder."""
    df.select(*sorted(columns)).write.json(f"{path}/json")
    df.select(*columns).write.option("header", True).csv(f"{path}/csv")


def read_shards(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    """JSON lines of all shard folders that a path with wildcards names, as one table; `shard` is the pattern's first group in the file's path."""
    rows = spark.read.schema(schema).json(path)
    return rows.select("*", F.regexp_extract("_metadata.file_path", pattern, 1).alias("shard"))


def read_documents(spark: SparkSession, path: str, key: str = "tree") -> DataFrame:
    """(key, json): files of one JSON document each, whole, named by the file without its ending."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias(key), F.col("value").alias("json"))


def copies_differ(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(name, problem): files of two folders that aren't byte-identical: missing on either side, size, or content.

    A file of more than 2 GB is an error of the reader.
    """
    sizes = lambda path, c: files_of(spark, path).select("name", F.col("bytes").alias(c))
    sums = lambda path, c: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.sha2("content", 256).alias(c))
    both = sizes(left, "_a").join(sizes(right, "_b"), "name", "full")
    same = both.filter("_a = _b").select("name").join(sums(left, "_x"), "name").join(sums(right, "_y"), "name").select("name", (F.col("_x") == F.col("_y")).alias("_same"))
    problem = F.when(F.col("_a").isNull(), "missing left").when(F.col("_b").isNull(), "missing right").when(F.col("_a") != F.col("_b"), "size").when(~F.col("_same"), "content")
    return both.join(same, "name", "left").select("name", problem.alias("problem")).filter("problem is not null")


def files_of(spark: SparkSession, path: str, pattern: str = "*", excluded: str | None = None) -> DataFrame:
    """(path, name, modified, bytes) of files below a folder whose name fits; content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    out = files.select("path", F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return out.filter(~F.col("name").rlike(excluded)) if excluded else out


def last_file(files: DataFrame, by: list[str], newest: bool = False) -> DataFrame:
    """One file of each group: the lexicographically last, or the newest (ties: the last path)."""
    order = F.struct("modified", "path") if newest else F.struct("path")
    return files.groupBy(*by).agg(F.max_by("path", order).alias("path"))


def newest_documents(spark: SparkSession, path: str, pattern: str, group: str, items: str | None = None, item_schema: str = "") -> DataFrame:
    """(pool, path, n_items): of the JSON documents of each pool the newest one that has items; ties: the last path.

    `group` is a pattern whose first group in the path is the pool. `items` names the list that a document must hold;
    without it the document must be a list itself.
    Empty files, text that isn't JSON, documents of another kind and empty lists are passed over, so an older document
    of the pool may be taken; a pool without any has no row. Only the list's length is kept of a document.
    """
    documents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.decode("content", "UTF-8")
    number = F.json_array_length(text) if items is None else F.size(F.from_json(text, f"`{items}` array<struct<{item_schema}>>")[items])
    counted = documents.filter(F.col("length") > 0).select("path", F.col("modificationTime").alias("modified"), number.alias("n_items"), F.regexp_extract("path", group, 1).alias("pool"))
    newest = F.max_by(F.struct("path", "n_items"), F.struct("modified", "path"))
    return counted.filter("n_items > 0 and pool <> ''").groupBy("pool").agg(newest.alias("_r")).select("pool", "_r.*")


def read_pools(spark: SparkSession, path: str) -> DataFrame:
    """(pool, pos, name): candidate pools, a text file for each, named like it, with a candidate a line.

    Of names that differ only in case or outer blanks the first stays; pos, from 0, counts what stays, in the order of lines. A pool is
    one document that one task reads, as a question's candidates are one list.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("pool"), "value")
    names = F.filter(F.transform(F.split("value", r"\r?\n"), lambda n: F.trim(n)), lambda n: n != "")
    lines = files.select("pool", F.posexplode(names).alias("line", "name"))
    first = lines.groupBy("pool", F.lower("name").alias("_k")).agg(F.min(F.struct("line", "name")).alias("_f"))
    order = Window.partitionBy("pool").orderBy("_f.line")
    return first.select("pool", (F.row_number().over(order) - 1).alias("pos"), F.col("_f.name").alias("name"))


def read_checked(spark: SparkSession, path: str, schema: str, required: list[str], form: str = "json", **options: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows of JSON lines or CSV that fit the schema, and the others as (file, line, reason).

    reason: `unreadable`, text that isn't of the form or a value that isn't of its type; or `missing <column>`, the first
    required column that is null. Blank lines are passed over, and a row of CSV is a line. Nothing is lost: each line is in one of the two.
    """
    parse = {"json": F.from_json, "csv": F.from_csv}[form]
    names = StructType.fromDDL(schema).fieldNames()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter("trim(value) <> ''")
    parsed = lines.withColumn("_r", parse("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE", **options}))
    reason = F.when(F.col("_r").isNull() | F.col("_r._bad").isNotNull(), F.lit("unreadable"))
    for name in required:
        reason = reason.when(F.col("_r")[name].isNull(), F.lit(f"missing {name}"))
    told = parsed.withColumn("reason", reason)
    return told.filter("reason is null").select(*[F.col("_r")[n].alias(n) for n in names]), told.filter("reason is not null").select("file", F.col("value").alias("line"), "reason")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(key, result, batch, pos, file, line): an append-only log of JSON lines; lines that don't parse are left out.

    Later lines have a greater (batch, pos, file, line). `batch` and `pos` are what `append_log` wrote: the append's time
    in nanoseconds and the row's place in it. Lines of another writer lack both; their file's time stands for the first.
    """
    written = (F.unix_micros("_metadata.file_modification_time") * 1000).alias("written")
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), written, F.monotonically_increasing_id().alias("line"))
    parsed = text.withColumn("_j", F.from_json("value", "key string, result string, batch long, pos long"))
    return parsed.filter(F.col("_j.key").isNotNull()).select("_j.key", "_j.result", F.coalesce("_j.batch", "written").alias("batch"), "_j.pos", "file", "line")


def append_log(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Append (key, result) rows as one batch, by default numbered by the time in nanoseconds; later rows of `df` are later lines.

    Writers whose clocks may differ must give their own growing numbers: the larger batch wins.
    """
    number = time.time_ns() if batch is None else batch
    rows = df.select("key", "result", F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("pos"))
    rows.write.mode("append").json(path)


def latest_lines(log: DataFrame) -> DataFrame:
    """The last line of each key, by one aggregation."""
    order = F.struct("batch", "pos", "file", "line")
    return log.groupBy("key").agg(F.max_by(F.struct("result", "batch", "pos"), order).alias("_l")).select("key", "_l.*")


def compact_log(spark: SparkSession, path: str, out: str) -> None:
    """One line for each key, the latest, sorted by key within range-partitioned files; later appends still win over it."""
    latest_lines(read_log(spark, path)).orderBy("key").write.mode("overwrite").json(out)


def remaining(rows: DataFrame, log: DataFrame, index: str, start: int, end: int) -> DataFrame:
    """Rows from start to end that the log lacks."""
    return rows.filter(F.col(index).between(start, end)).join(log.select(index), index, "left_anti")


def write_json_cells_csv(df: DataFrame, path: str) -> None:
    """CSV in which nested columns are JSON text."""
    cells = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema]
    df.select(*cells).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def markdown_table(df: DataFrame, order: str, decimals: int = 3) -> DataFrame:
    """(pos, line): a small table as Markdown lines; a missing value prints as -."""
    numeric = {"double", "float", "decimal"}
    cell = lambda f: F.coalesce(F.format_number(f.name, decimals) if f.dataType.typeName() in numeric else F.col(f.name).cast("string"), F.lit("-"))
    head = "| " + " | ".join(df.columns) + " |"
    rule = "|" + "---|" * len(df.columns)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(f) for f in df.schema]), F.lit(" |"))
    rows = df.select((F.row_number().over(Window.orderBy(order)) + 1).alias("pos"), line.alias("line"))
    heads = df.sparkSession.createDataFrame([(0, head), (1, rule)], "pos int, line string")
    return heads.unionByName(rows)


def embedded_record(messages: Column, mark: str = "LOG_JSON: ") -> Column:
    """The JSON text of the last user message that starts with the mark; messages: array of (role, content)."""
    hits = F.filter(messages, lambda m: (m["role"] == "user") & m["content"].startswith(mark))
    return F.substring(F.try_element_at(hits, F.lit(-1))["content"], len(mark) + 1, 1_000_000_000)
