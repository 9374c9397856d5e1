"""Readers of low-degree series, archives of fields, SINEX files and Love numbers."""

from __future__ import annotations

import io
import tarfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names of blocks of coefficients, and of symmetric matrices.
VECTORS = ("SOLUTION/ESTIMATE", "SOLUTION/APRIORI", "SOLUTION/NORMAL_EQUATION_VECTOR")
MATRICES = ("SOLUTION/NORMAL_EQUATION_MATRIX", "SOLUTION/MATRIX_ESTIMATE", "SOLUTION/MATRIX_APRIORI")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, line, value); line, a struct (split, row), orders the lines of a file.

    Spark cuts a large file into ranges of bytes that are read side by side: the range's first byte and the number of the row
    within the reading task put the lines in order, so no file has to fit a task.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), place.alias("line"), F.regexp_replace("value", r"\r$", "").alias("value"))


def _words(value: str = "value") -> Column:
    return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")


def _number(x) -> Column:
    return F.regexp_replace(x, "[dD]", "e").try_cast("double")


def _midpoint(start: Column, end: Column) -> Column:
    return F.timestamp_micros(F.floor((F.unix_micros(start) + F.unix_micros(end)) / 2).cast("long")).cast("timestamp_ntz")


def read_geocentre(spark: SparkSession, path: str) -> DataFrame:
    """Degree-1 series: rows (path, epoch, n, m, trig, value) of GRCOF2 lines, the epoch midway between the last two words."""
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), _words().alias("w")).where(F.col("w")[0] == "GRCOF2")
    start, end = (F.to_timestamp(F.substring(F.col("w")[k], 1, 13), "yyyyMMdd.HHmm") for k in (7, 8))
    parts = F.array(*[F.struct(F.lit(t).alias("trig"), _number(F.col("w")[3 + t]).alias("value")) for t in (0, 1)])
    found = rows.select("path", _midpoint(start, end).alias("epoch"), F.col("w")[1].cast("int").alias("n"), F.col("w")[2].cast("int").alias("m"), F.explode(parts).alias("x"))
    return found.select("path", "epoch", "n", "m", "x.*").where("not (m = 0 and trig = 1)")


def read_low_zonals(spark: SparkSession, path: str) -> DataFrame:
    """C20 and C30 series: rows (path, epoch, n, m, trig, value) after the line Product:, epoch midway in days; a NaN C30 is left out."""
    lines = numbered_lines(spark, path)
    head = lines.where(F.trim("value").startswith("Product:")).groupBy("path").agg(F.min("line").alias("_head"))
    rows = lines.join(head, "path").where("line > _head and trim(value) != ''").select("path", _words().alias("w"))
    middle = (F.col("w")[0].cast("double") + F.element_at("w", -2).cast("double")) / 2
    epoch = F.timestamp_micros(F.round((middle - 40587) * 86400e6).cast("long")).cast("timestamp_ntz")
    parts = F.array(*[F.struct(F.lit(n).alias("n"), _number(F.col("w")[k]).alias("value")) for n, k in ((2, 2), (3, 5))])
    found = rows.select("path", epoch.alias("epoch"), F.explode(parts).alias("x"))
    return found.select("path", "epoch", "x.n", F.lit(0).alias("m"), F.lit(0).alias("trig"), "x.value").where("value is not null and not isnan(value)")


def read_field_archive(spark: SparkSession, path: str, min_degree: int = 0, max_degree: int | None = None) -> DataFrame:
    """Rows (path, epoch, radius, gm, n, m, trig, value) of gzipped tars of coefficient files; epochs are in the members' names."""

    def unpack(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for member in tar:
                        if member.isfile():
                            text = tar.extractfile(member).read().decode("latin-1")
                            yield pd.DataFrame({"path": [name], "member": [member.name], "text": [text]})

    members = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, member string, text string")
    lines = members.select("path", "member", F.explode(F.split("text", r"\r?\n")).alias("value")).select("path", "member", _words().alias("w"))
    word = F.col("w")[0]
    keys = ["path", "member"]
    heads = lines.where(word.isin("radius", "earth_gravity_constant")).groupBy(*keys).agg(*[F.max(F.when(word == k, _number(F.element_at("w", -1)))).alias(n) for k, n in (("radius", "radius"), ("earth_gravity_constant", "gm"))])
    parts = F.array(*[F.struct(F.lit(t).alias("trig"), _number(F.col("w")[3 + t]).alias("value")) for t in (0, 1)])
    rows = lines.where(word == "gfc").select(*keys, F.col("w")[1].cast("int").alias("n"), F.col("w")[2].cast("int").alias("m"), F.explode(parts).alias("x"))
    rows = rows.where(F.col("n") >= min_degree) if max_degree is None else rows.where(F.col("n").between(min_degree, max_degree))
    epoch = F.to_timestamp(F.regexp_extract("member", r"(\d{8}_\d{2}).{4}$", 1), "yyyyMMdd_HH").cast("timestamp_ntz")
    joined = rows.where("not (m = 0 and x.trig = 1)").join(heads, keys, "left")
    return joined.select("path", epoch.alias("epoch"), F.coalesce("radius", F.lit(6378136.3)).alias("radius"), F.coalesce("gm", F.lit(3.986004415e14)).alias("gm"), "n", "m", "x.trig", "x.value")


def monthly_header(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, degree, radius, gm, epoch) a monthly solution: the values after the header's keys, the epoch midway in its coverage."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "# End of YAML header")[0].alias("h"))

    def after(key, pattern):
        return F.nullif(F.regexp_extract("h", key + pattern, 1), F.lit(""))

    number = r"\s*:\s*(?:[^:]*?\n\s+value\s*:\s*|[^\n]*?\n(?:[^\n]*\n)*?\s*value\s*:\s*)?([-+0-9.eEdD]+)"
    start, end = (F.to_timestamp(F.regexp_replace(after(k, r"\s*:\s*['\"]?([0-9T:\- .]+)"), "T", " ")) for k in ("time_coverage_start", "time_coverage_end"))
    return whole.select("path", after("degree", r"\s*:\s*([0-9]+)").cast("int").alias("degree"), _number(after("mean_equator_radius", number)).alias("radius"), _number(after("earth_gravity_param", number)).alias("gm"), _midpoint(start, F.coalesce(end, start)).alias("epoch"))


def sinex_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, line, block, value) of the lines within blocks, whatever their names; comments are left out.

    The block is that of the last mark before a line: of its own range of bytes, or else of the ranges before, a row each.
    """
    lines = numbered_lines(spark, path).withColumn("split", F.col("line.split"))
    mark = F.when(F.col("value").rlike(r"^\+"), F.trim(F.expr("substring(value, 2)"))).when(F.col("value").rlike("^-"), "")
    marked = lines.withColumn("_mark", mark)
    last = marked.groupBy("path", "split").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("line"))).alias("_last"))
    before = last.select("path", "split", F.last("_last", ignorenulls=True).over(W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    own = F.last("_mark", ignorenulls=True).over(W.partitionBy("path", "split").orderBy("line"))
    placed = marked.withColumn("_own", own).join(before, ["path", "split"]).withColumn("block", F.coalesce("_own", "_before"))
    return placed.where(~F.col("value").rlike(r"^[-+*%]") & (F.col("block") != "")).select("path", "line", "block", "value")


def sinex_epoch(text) -> Column:
    """Timestamps of yy:ddd:sssss, or with four digits of the year; two digits up to 50 are of this century. 00:000:00000 is null."""
    year, day, second = (F.regexp_extract(text, r"^\s*(\d{2}|\d{4}):(\d{3}):(\d{1,5})\s*$", k) for k in (1, 2, 3))
    number = year.try_cast("int")
    whole = F.when(F.length(year) == 4, number).when(number <= 50, number + 2000).otherwise(number + 1900)
    start = F.unix_micros(F.to_timestamp(F.make_date(whole, F.lit(1), F.lit(1))))
    made = F.timestamp_micros(start + ((day.try_cast("long") - 1) * 86400 + second.try_cast("long")) * 1_000_000)
    return F.when(day.try_cast("int") > 0, made.cast("timestamp_ntz"))


def sinex_blocks(lines: DataFrame) -> DataFrame:
    """Rows (path, block, kind, lines): what each block holds, vector, matrix, statistics or other; others are kept as lines."""
    name = F.split("block", " ")[0]
    kind = F.when(name.isin(*VECTORS), "vector").when(name.isin(*MATRICES), "matrix").when(name == "SOLUTION/STATISTICS", "statistics").otherwise("other")
    return lines.groupBy("path", "block").agg(F.count("*").alias("lines")).select("path", "block", kind.alias("kind"), "lines")


def read_sinex(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Everything of the files: rows of vectors and matrices with their block, of statistics, and the lines of all other blocks."""
    lines = sinex_lines(spark, path)
    name = F.split("block", " ")[0]
    vectors = reduce(DataFrame.unionByName, [sinex_vector(lines, b).withColumn("block", F.lit(b)) for b in VECTORS])
    matrices = reduce(DataFrame.unionByName, [sinex_matrix(lines, b).withColumn("block", F.lit(b)) for b in MATRICES])
    return {"vectors": vectors, "matrices": matrices, "statistics": sinex_statistics(lines), "other": lines.where(~name.isin(*VECTORS, *MATRICES, "SOLUTION/STATISTICS"))}


def sinex_vector(lines: DataFrame, block: str) -> DataFrame:
    """Rows (path, i, n, m, trig, value, sigma, epoch) of a block of coefficients, by its fixed columns."""
    cut = lambda a, b: F.trim(F.substring("value", a + 1, b - a))
    rows = lines.where(F.split("block", " ")[0] == block)
    return rows.select("path", (cut(1, 6).cast("long") - 1).alias("i"), cut(14, 18).cast("int").alias("n"), cut(22, 26).cast("int").alias("m"), F.when(cut(7, 13) == "SN", 1).otherwise(0).alias("trig"), _number(cut(47, 68)).alias("x"), _number(cut(69, 80)).alias("sigma"), sinex_epoch(cut(27, 39)).alias("epoch")).withColumnRenamed("x", "value")


def sinex_matrix(lines: DataFrame, block: str) -> DataFrame:
    """Rows (path, i, j, v) of a symmetric block, both triangles, whichever the file has."""
    rows = lines.where(F.split("block", " ")[0] == block).select("path", _words().alias("w"))
    entries = rows.select("path", (F.col("w")[0].cast("long") - 1).alias("i"), F.col("w")[1].cast("long").alias("first"), F.posexplode(F.slice("w", 3, 3)).alias("k", "x"))
    one = entries.select("path", "i", (F.col("first") + F.col("k") - 1).alias("j"), _number("x").alias("v"))
    return one.unionByName(one.where("i != j").select("path", F.col("j").alias("i"), F.col("i").alias("j"), "v")).dropDuplicates(["path", "i", "j"])


def sinex_statistics(lines: DataFrame) -> DataFrame:
    """One row (path, dof, obs, parameters, lpl) a file."""
    labels = {"dof": "NUMBER OF DEGREES OF FREEDOM", "obs": "NUMBER OF OBSERVATIONS", "parameters": "NUMBER OF UNKNOWNS", "lpl": "WEIGHTED SQUARE SUM OF O-C"}
    rows = lines.where(F.col("block").startswith("SOLUTION/STATISTICS"))
    label, number = F.trim(F.substring("value", 2, 30)), _number(F.trim(F.expr("substring(value, 33)")))
    return rows.groupBy("path").agg(*[F.max(F.when(label.startswith(v), number)).alias(k) for k, v in labels.items()])


def sinex_normals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matrix, right side and statistics of files that hold normal equations; fails for those without."""
    lines = sinex_lines(spark, path)
    needed = {"SOLUTION/NORMAL_EQUATION_MATRIX", "SOLUTION/NORMAL_EQUATION_VECTOR", "SOLUTION/STATISTICS"}
    found = {r["b"] for r in lines.select(F.split("block", " ")[0].alias("b")).distinct().collect()}
    if needed - found:
        raise ValueError(f"no blocks {sorted(needed - found)}")
    right = sinex_vector(lines, "SOLUTION/NORMAL_EQUATION_VECTOR").select("path", "i", F.col("value").alias("rhs"))
    return sinex_matrix(lines, "SOLUTION/NORMAL_EQUATION_MATRIX"), right, sinex_statistics(lines)


def read_love_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Rows (n, h, l, k) of a text table with a heading row."""
    words = spark.read.text(path).select(_words().alias("w")).where(F.col("w")[0].rlike("^[0-9]+$"))
    return words.select(F.col("w")[0].cast("int").alias("n"), *[_number(F.col("w")[k]).alias(c) for k, c in ((1, "h"), (2, "l"), (3, "k"))])


def write_sinex(path: str, right: DataFrame, matrix: DataFrame, stats: dict[str, float], agency: str = "XXX", created: str = "00:000:00000") -> None:
    """One SINEX file of normal equations, in a folder: rows (i, n, m, trig, value) and (i, j, v), of which the upper triangle counts.

    The file is one ordered text, so its lines go through one task, sorted there with spilling.
    """
    spark = right.sparkSession

    def fixed(section, texts):
        return spark.createDataFrame([(section, 0, k, t) for k, t in enumerate(texts)], "section int, a long, b long, value string")

    vector = right.select(F.lit(3).alias("section"), F.col("i").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string(" %5d %-6s %4d -- %4d %12s %-4s 2 %21.14e", F.col("i") + 1, F.when(F.col("trig") == 1, "SN").otherwise("CN"), "n", "m", F.lit(created), F.lit("----"), "value").alias("value"))
    entries = matrix.where("i <= j").select(F.lit(5).alias("section"), F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b"), F.format_string(" %5d %5d %21.14e", F.col("i") + 1, F.col("j") + 1, "v").alias("value"))
    labels = {"obs": "NUMBER OF OBSERVATIONS", "parameters": "NUMBER OF UNKNOWNS", "dof": "NUMBER OF DEGREES OF FREEDOM", "lpl": "WEIGHTED SQUARE SUM OF O-C"}
    head = [f"%=SNX 2.02 {agency} {created}", "+SOLUTION/STATISTICS", *[f" {labels[k]:<30} {v:>22.15g}" for k, v in stats.items()], "-SOLUTION/STATISTICS", "+SOLUTION/NORMAL_EQUATION_VECTOR"]
    between = ["-SOLUTION/NORMAL_EQUATION_VECTOR", "+SOLUTION/NORMAL_EQUATION_MATRIX U"]
    lines = fixed(1, head).unionByName(vector).unionByName(fixed(4, between)).unionByName(entries).unionByName(fixed(6, ["-SOLUTION/NORMAL_EQUATION_MATRIX U", "%ENDSNX"]))
    lines.repartition(1).sortWithinPartitions("section", "a", "b").select("value").write.text(path)
