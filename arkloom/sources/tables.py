"""Reading and writing captures, manifests, raw and clean content."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arkloom.functions import urls
from arkloom.operators.captures import site_key
from arkloom.operators.site import reference_bucket
from arkloom.work import broadcast_if_small, keep

MANIFEST = "original string, key string, timestamp string, wayback_url string, local_path string, target string, kind string"
#: Buckets of a target's clean paths.
CLEAN_BUCKETS = 16
FIELDS = ("urlkey", "timestamp", "original", "statuscode", "mimetype", "digest")


def read_cdx(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Captures from index responses: JSON arrays of rows under a first row of names.

    With ``lines`` each row stands on a line of its own, as index servers print them, so that a
    large response is read by many tasks; a line that holds more or less than a row is an
    error. Without it a response may be laid out in any way and is one task's. Rows of another
    length than the names are dropped, which takes the empty row and the resume key at the end
    with it. ``seq``, a whole number, orders the rows by file and place.
    """
    if lines:
        places, names = _lines(spark, path)
    else:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<array<string>>").alias("rows"))
        places = files.select("file", F.posexplode("rows").alias("at", "row"))
        names = places.filter("at = 0").select("file", F.col("row").alias("names"))
        places = places.filter("at > 0")
    order = Window.orderBy("file")  # of the files' names alone, a row for each response
    names = keep(names.withColumn("file_no", F.row_number().over(order).cast("long")), "responses")
    rows = places.join(broadcast_if_small(names), "file").filter((F.size("row") == F.size("names")) & (F.size("names") > 1)).withColumn("m", F.map_from_arrays("names", "row"))
    return rows.select(*[F.try_element_at("m", F.lit(f)).alias(f) for f in FIELDS], (F.shiftleft("file_no", 42) + F.col("at")).alias("seq"))


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, at, row) of the lines behind the first ones, and (file, names) of these.

    ``at`` grows with a line's place in its file: it is where the line's block begins and the
    number of lines that its task has seen, which are less than the bytes up to the next block.
    """
    counter = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    text = F.trim(F.regexp_replace("value", r"^\s+|[\s,]+$", ""))
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + counter).alias("at"), text.alias("line"))
    first = F.startswith("line", F.lit("[["))
    bare = F.regexp_replace(F.regexp_replace("line", r"^\[(?=\[)", ""), r"(?<=\])\]$", "")
    parsed = F.from_json(F.concat(F.lit("["), bare, F.lit("]")), "array<array<string>>")
    row = F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not one row: "), F.substring("line", 1, 80))))
    whole = read.filter(~F.col("line").isin("", "[", "]", "[]", "[]]")).select("file", "at", first.alias("first"), row.alias("row"))
    return whole.filter("NOT first").select("file", "at", "row"), whole.filter("first").select("file", F.col("row").alias("names"))


def write_captures(captures: DataFrame, path: str) -> None:
    """Captures in the order of their sites and times, so that a target's hosts and window are few
    files and few row groups; ``site`` is the host's labels from the last one on."""
    sited = captures.withColumn("site", site_key(urls.host_of(F.col("original"))))
    sited.repartitionByRange("site", "timestamp").sortWithinPartitions("site", "timestamp").write.mode("overwrite").parquet(path)


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_manifest(spark: SparkSession, path: str, may_be_missing: bool = False) -> DataFrame:
    """A manifest as a JSON array or Parquet; a missing external one is empty, a missing main one an error."""
    try:
        if path.endswith(".json"):
            return spark.read.schema(MANIFEST).json(path, multiLine=True)
        return spark.read.parquet(path)
    except AnalysisException as error:
        if may_be_missing and _missing(error):
            return spark.createDataFrame([], MANIFEST)
        raise


def write_manifest(manifest: DataFrame, path: str) -> None:
    """By target, keys ascending in each file and from file to file."""
    manifest.repartitionByRange("target", "key").sortWithinPartitions("target", "key").write.mode("overwrite").partitionBy("target").parquet(path)


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """(local_path, content) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", r"^.*?" + r"\Q" + root.rstrip("/").removeprefix("file:").lstrip("/") + r"\E/", "").alias("local_path"), "content")


def write_clean(clean: DataFrame, path: str, force: bool = False) -> None:
    """Write clean content by target and bucket of paths: all anew with ``force``, else only paths not
    there yet.

    A page written before under the name of what has turned out to be a stylesheet or script
    goes; only the buckets that have such a page are written anew.
    """
    spark = clean.sparkSession
    # A file has the bucket of what it may have been named before.
    bucket = F.pmod(F.xxhash64(F.regexp_replace("path", "[.](html|css|js)$", "")), F.lit(CLEAN_BUCKETS)).cast("int")
    places = ["target", "bucket", "path"]
    clean = clean.withColumn("bucket", bucket)
    write = lambda df: df.write.partitionBy("target", "bucket")
    if not force:
        try:
            there = spark.read.parquet(path)
        except AnalysisException as error:
            if not _missing(error):
                raise
            force = True
    if force:
        write(clean.repartition("target", "bucket")).mode("overwrite").parquet(path)
        return
    new = keep(clean.join(there.select(*places), places, "left_anti"), "clean")
    former = new.filter("media IN ('css', 'js')").select("target", F.regexp_replace("path", "[.](css|js)$", ".html").alias("path")).withColumn("bucket", bucket)
    stale = keep(there.select(*places).join(former, places, "left_semi"), "stale")
    if stale.isEmpty():
        write(new.repartition("target", "bucket")).mode("append").parquet(path)
        return
    touched = broadcast_if_small(keep(stale.select("target", "bucket").distinct(), "touched"))
    rest = there.join(touched, ["target", "bucket"], "left_semi").join(stale, places, "left_anti")
    anew = keep(rest.unionByName(new.join(touched, ["target", "bucket"], "left_semi"), allowMissingColumns=True), "anew")
    write(new.join(touched, ["target", "bucket"], "left_anti").repartition("target", "bucket")).mode("append").parquet(path)
    write(anew.repartition("target", "bucket")).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_references(index: DataFrame, path: str, mode: str = "append") -> None:
    """Add to a kept index of references (see :func:`arkloom.operators.site.reference_index`), by buckets of
    bases, so that the referrers of some URLs are read from few files."""
    index.withColumn("bucket", reference_bucket(F.col("base"))).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    """Listings by target, rows ascending within a file and from file to file, as these are numbered;
    a large target is dealt to several tasks."""
    order = ["target", "rel_path", "title"]
    index.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("target").parquet(path)
