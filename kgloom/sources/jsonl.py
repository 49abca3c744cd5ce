"""JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions import names as N

TASK_SCHEMA = "conversation_id string, task_id string, Collection string, input array<struct<speaker:string,text:string>>, contexts array<struct<document_id:string,text:string,score:double>>, predictions array<struct<text:string>>"


def numbered_lines(spark: SparkSession, path: str, first: int = 0, name_part: str | None = None) -> DataFrame:
    """source, line_number, line of every line of the .jsonl files below a path; numbers count blank lines too.

    Files stay splittable: lines are numbered within each split, and a split starts after the lines of those before it in
    its file. name_part keeps files whose name has it, in any case; Spark prunes the others before it reads them.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    if name_part:
        rows = rows.where(F.contains(F.lower("_metadata.file_name"), F.lit(name_part.lower())))
    rows = rows.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    counts = rows.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source", "split", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("source", "split").orderBy("seq")) - 1
    return rows.withColumn("place", place).join(starts, ["source", "split"]).select("source", (F.col("before") + F.col("place") + first).cast("long").alias("line_number"), "line")


def parsed_lines(lines: DataFrame, text_key: str = "text", metadata_keys: list[str] | None = None) -> DataFrame:
    """page_content, metadata, source, line_number of the lines that are objects with a text.

    Lines that are blank, no JSON, no object, or without text are skipped. metadata has the listed keys that are there, or
    all but the text, and source and line_number; values are texts.
    """
    obj = F.from_json(F.trim("line"), "map<string,string>", {"mode": "PERMISSIVE"})
    rows = lines.withColumn("o", obj).where(F.col("o").isNotNull()).withColumn("page_content", F.try_element_at("o", F.lit(text_key)))
    rows = rows.where(F.coalesce("page_content", F.lit("")) != "")
    kept = F.map_filter("o", lambda k, _: k.isin(*metadata_keys) if metadata_keys is not None else k != text_key)
    place = F.create_map(F.lit("source"), "source", F.lit("line_number"), F.col("line_number").cast("string"))
    others = F.map_filter(kept, lambda k, _: ~k.isin("source", "line_number"))
    return rows.select("page_content", F.map_concat(others, place).alias("metadata"), "source", "line_number")


def load_documents(spark: SparkSession, path: str, dataset: str | None = None, text_key: str = "text", metadata_keys: list[str] | None = None) -> DataFrame:
    """Documents of all files below a path, or of those whose name has the dataset's."""
    return parsed_lines(numbered_lines(spark, path, name_part=dataset), text_key, metadata_keys)


def load_dataset(spark: SparkSession, name: str, directory: str = "dataset") -> DataFrame:
    """Documents of <directory>/<name>.jsonl; Spark raises an AnalysisException if there is none."""
    return parsed_lines(numbered_lines(spark, f"{directory}/{name}.jsonl"))


def listed_datasets(spark: SparkSession, path: str) -> DataFrame:
    """name, path of the .jsonl files below a path, sorted; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path).select("path")
    return files.select(N.domain_of_path(F.col("path")).alias("name"), "path").distinct().orderBy("name", "path")


#: Between a file's name and the number of its part.
PART = "~"


def bounded_files(rows: DataFrame, order: str, most: int) -> DataFrame:
    """rows (file, line, and the order column) with the part of its file that each line goes to: <file>~<lane>-<number>,
    or -large-<number>.

    A part has at most `most` bytes, unless one line has more. A large file is dealt to lanes of about four parts, which are
    numbered side by side; a line of over half a part has a part of its own.
    """
    size = (F.octet_length("line") + 1).cast("long")
    lanes = F.ceil(F.col("__all") / (4 * most)).cast("int")
    whole = rows.groupBy("file").agg(F.sum(size).alias("__all")).withColumn("__lanes", lanes)
    dealt = rows.join(whole.select("file", "__lanes"), "file").withColumns({"__lane": F.pmod(F.xxhash64(order), "__lanes"), "__large": size > most // 2})
    run = Window.partitionBy("file", "__lane", "__large").orderBy(order, "line")
    before = F.sum(size).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    number = F.when(F.col("__large"), -F.row_number().over(run)).otherwise(F.floor(before / (most // 2)))
    part = F.concat("file", F.lit(PART), F.concat_ws("-", "__lane", F.when(number < 0, "large"), F.abs(number).cast("string")))
    return dealt.withColumn("file", part).select(rows.columns)


def write_lines(rows: DataFrame, root: str, order: str) -> int:
    """rows (file, line, and the order column) as <root>/<file>.jsonl, the lines of each in order; how many files.

    A file is written by one task, so rows have to be dealt to files small enough for one; a line may hold several.
    """
    spark = rows.sparkSession
    dealt = rows.select("file", order, "line").repartition("file").sortWithinPartitions("file", order).select("file", "line")
    dealt.write.partitionBy("file").text(f"{root}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    made = 0
    for folder in files.listStatus(path(f"{root}/parts")):
        name = folder.getPath().getName()
        if name.startswith("file="):
            for part in files.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    files.rename(part.getPath(), path(f"{root}/{name.removeprefix('file=')}.jsonl"))
                    made += 1
    files.delete(path(f"{root}/parts"), True)
    return made


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK_SCHEMA).json(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """JSON lines, in place of what is there."""
    predictions.write.mode("overwrite").json(path)


def payload(text: Column, metadata: Column) -> Column:
    """What a point carries: text and metadata; a metadata entry of that name replaces the text."""
    named = F.map_filter(F.create_map(F.lit("page_content"), text), lambda k, _: ~F.map_contains_key(metadata, "page_content"))
    return F.map_concat(named, metadata)
