"""Text files as tables of lines, and blocks, runs and frames within them.

A file may be larger than a task. Its lines keep the split that they were read from, and what a line must know of the lines before it
(the last marker, how many there were, the frame) is found in three steps: each split is summed up by itself, the sums are scanned in
the order of splits (a row for each split, not for each line), and the scanned sums are carried into the splits. So the windows over
lines have a split's lines, in as many tasks as there are splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eEdD][-+]?\d+)?"
#: Lines of a part of a table of lines that does not come with splits of its own.
RUN = 1 << 20


def scan_text(spark: SparkSession, paths: str | list[str], extensions: list[str] | None = None, separator: str | None = None) -> DataFrame:
    """(file, name, ext, split, pos, line): file is the whole path, name the file's up to the first dot, ext what follows, in lower case.

    split is the first byte of the line's split. pos orders the lines of a file; inside a split it counts by one, from one split to the
    next it may jump: a partition has no more rows than bytes, and a split begins at most a partition's size after the one before, so
    split + row of the partition needs no count of what comes before. separator: what ends a row, in place of an end of line.
    """
    reader = spark.read
    if separator is not None:
        reader = reader.option("lineSep", separator)
    if extensions:  # other files are not even opened
        either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(map(either, extensions)) + "}")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = reader.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), (F.col("_metadata.file_block_start") + row).alias("pos"), F.col("value").alias("line"))
    base = F.regexp_extract("file", r"([^/]*)$", 1)
    raw = raw.withColumn("name", F.regexp_extract(base, r"^([^.]*)", 1)).withColumn("ext", F.lower(F.regexp_extract(base, r"^[^.]*\.(.*)$", 1)))
    if extensions:
        raw = raw.where(F.col("ext").isin(*extensions))
    return raw.select("file", "name", "ext", "split", "pos", "line")


def read_lines(spark: SparkSession, paths: str | list[str], extensions: list[str] | None = None) -> DataFrame:
    """scan_text with the lines of a file counted from 0."""
    lines = scan_text(spark, paths, extensions)
    return places(lines, ["file"], "split", ["pos"], "_n").withColumn("pos", F.col("_n") - 1).drop("_n")


def places(rows: DataFrame, by: list[str], chunk: str, order: list[str], name: str) -> DataFrame:
    """rows with their place, from 1, in their group's order, of which chunk is the leading column: rows are counted by chunk, the counts
    summed over the chunks before, and rows are numbered inside their chunk, so that a group of any size is spread by its chunks."""
    earlier = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    counts = rows.groupBy(*by, chunk).agg(F.count("*").alias("_c"))
    counts = counts.select(*by, chunk, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*by, chunk).orderBy(*order)))
    return inside.join(counts, [*by, chunk]).withColumn(name, F.col("_row") + F.col("_before")).drop("_row", "_before")


def in_splits(lines: DataFrame) -> DataFrame:
    """lines with a split; those that come without are cut by their place."""
    return lines if "split" in lines.columns else lines.withColumn("split", F.floor(F.col("pos") / RUN))


def numbers(line: Column) -> Column:
    """All numbers of a line; Fortran's exponents too."""
    return F.transform(F.regexp_extract_all(line, F.lit(f"({NUMBER})")), lambda x: F.regexp_replace(x, "[dD]", "E").try_cast("double"))


def nth(array: Column, k: int) -> Column:
    """The k-th value, from 0, or null where there is none."""
    return F.get(array, F.lit(k))


def words(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")


def leading(line: Column, n: int = 3) -> Column:
    """The first n words of a line as numbers; null in place of a word that is none."""
    return F.transform(F.slice(words(line), 1, n), lambda x: F.regexp_replace(x, "[dD]", "E").try_cast("double"))


def last_run(lines: DataFrame, marker: str = "Run started", by: str = "file") -> DataFrame:
    """The lines from a file's last marker on; all of them where there is none."""
    rows = in_splits(lines)
    starts = rows.groupBy(by, "split").agg(F.max(F.when(F.col("line").contains(marker), F.col("pos"))).alias("_s"))
    starts = starts.select(by, "split", F.max("_s").over(Window.partitionBy(by)).alias("_start"))  # a row for each split
    kept = rows.join(starts, [by, "split"]).where(F.col("_start").isNull() | (F.col("pos") >= F.col("_start")))
    return kept.select(*lines.columns)


def tag_blocks(lines: DataFrame, markers: dict[str, Column], by: str = "file") -> DataFrame:
    """lines with block, the name of the last marker line at or before, block_no, how many marker lines there were, and since, the
    lines since it (0 is the marker itself)."""
    rows = in_splits(lines).withColumn("_m", F.coalesce(*(F.when(test, n) for n, test in markers.items())))
    at, key = F.when(F.col("_m").isNotNull(), F.col("pos")), [by, "split"]
    sums = rows.groupBy(*key).agg(F.min("pos").alias("_first"), F.count("*").alias("_lines"), F.count("_m").alias("_marks"), F.max_by("_m", at).alias("_name"), F.max(at).alias("_at"))
    earlier = Window.partitionBy(by).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    # what to add to a place inside the split so that places of a file are without gaps; places of other tables count as they are
    shift = F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first") if "split" in lines.columns else F.lit(0)
    sums = sums.withColumn("_shift", shift)
    carried = sums.select(*key, "_shift", F.last("_name", True).over(earlier).alias("_name"), F.coalesce(F.sum("_marks").over(earlier), F.lit(0)).alias("_marks"), F.max(F.col("_at") + F.col("_shift")).over(earlier).alias("_at"))
    inside = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({"block": F.last("_m", True).over(inside), "block_no": F.count("_m").over(inside), "since": F.last(at, True).over(inside)})
    own = own.join(carried, key)
    since = F.col("pos") + F.col("_shift") - F.coalesce(F.col("since") + F.col("_shift"), F.col("_at"))
    return own.select(*lines.columns, F.coalesce("block", "_name").alias("block"), (F.col("block_no") + F.col("_marks")).alias("block_no"), since.alias("since"))


def frames(lines: DataFrame, by: str = "file") -> DataFrame:
    """Non-blank lines with frame, the number of runs of blank lines before them. A run that goes on from one split to the next is one."""
    key = [by, "split"]
    inside = Window.partitionBy(*key).orderBy("pos")
    rows = in_splits(lines).withColumn("_blank", F.trim("line") == "")
    # null at the first line of a split: whether a run begins there, the split before knows
    rows = rows.withColumn("_fresh", F.col("_blank") & ~F.lag("_blank").over(inside))
    ends = rows.groupBy(*key).agg(F.min_by("_blank", "pos").alias("_head"), F.max_by("_blank", "pos").alias("_tail"), F.count_if("_fresh").alias("_n"))
    order = Window.partitionBy(by).orderBy("split")  # a row for each split
    ends = ends.withColumn("_open", F.col("_head") & ~F.coalesce(F.lag("_tail").over(order), F.lit(False)))
    whole = F.sum(F.col("_n") + F.col("_open").cast("int"))
    carried = ends.select(*key, (F.coalesce(whole.over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_open").cast("int")).alias("_carry"))
    own = rows.withColumn("frame", F.count_if("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("_blank"))
    out = own.join(carried, key).withColumn("frame", F.col("frame") + F.col("_carry"))
    return out.select(*lines.columns, *([] if "split" in lines.columns else ["split"]), "frame")


def in_order(value: Column, where: Column | None = None, order: str = "pos") -> Column:
    """An aggregate: the values of the rows that pass, in order, as an array; null where there are none."""
    pair = F.struct(F.col(order).alias("o"), value.alias("v"))
    found = F.collect_list(pair if where is None else F.when(where, pair))
    return F.when(F.size(found) > 0, F.transform(F.array_sort(found), lambda x: x["v"]))


def gathered(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """(by, name): the values in order as an array; a group is one block of one file."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))
