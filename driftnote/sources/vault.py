"""Reading a folder of Markdown notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: folders that are passed over, and the reports that programs write
IGNORED = [".git", ".obsidian", ".trash", "__pycache__", ".venv", "node_modules", "examples", "tests"]


def read_vault(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """path (relative to ``root``), name, depth, modified, text of every matching file; bytes that are no UTF-8 are replaced, ignored folders (below the root) are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    where = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    base = where.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root)).toUri().getPath().rstrip("/") + "/"
    raw = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^[a-z]+:/*", "/")
    rows = files.select(F.expr("make_valid_utf8(cast(content as string))").alias("text"), F.to_date("modificationTime").alias("modified"), F.substring(raw, len(base) + 1, 4096).alias("path"))
    rows = rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.size(F.split("path", "/")).alias("depth"), "modified", "text")


def named_day(name: Column, whole: bool = False) -> Column:
    """The calendar day in a name (the whole stem where ``whole``); null if there is none or no such day."""
    pattern = r"^(20[0-9]{2}-[0-9]{2}-[0-9]{2})(?:\.[^.]*)?$" if whole else r"(20[0-9]{2}-[0-9]{2}-[0-9]{2})"
    return F.try_to_date(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), "yyyy-MM-dd")


def daily_notes(vault: DataFrame, cutoff: str, days: int) -> DataFrame:
    """The last ``days`` days up to the cutoff that have a daily note, one note a day: the shallowest, then the first by path. No days give none."""
    rows = vault.withColumn("day", named_day(F.col("name"), True)).where(F.col("day") <= F.lit(cutoff).cast("date"))
    one = rows.withColumn("rn", F.row_number().over(Window.partitionBy("day").orderBy("depth", "path"))).where("rn = 1").drop("rn")
    return one.orderBy(F.col("day").desc()).limit(max(days, 0))


def recent_notes(vault: DataFrame, today: str, days: int, most: int = 600, least: int = 20) -> DataFrame:
    """Notes whose day (in the name, else of modification) lies in the last ``days`` calendar days, of at least ``least`` characters, the newest ``most`` (the reader's window)."""
    day = F.coalesce(named_day(F.col("name")), F.col("modified"))
    t = F.lit(today).cast("date")
    rows = vault.withColumn("day", day).where((F.col("day") <= t) & (F.col("day") >= F.date_sub(t, days)) & (F.length("text") >= least))
    return rows.orderBy(F.col("day").desc(), F.col("path").desc()).limit(most)


def scanned(vault: DataFrame, excluded: list[str] | None = None, most: int = 0) -> DataFrame:
    """All notes but those named, by depth and path; the first ``most`` if that isn't 0."""
    rows = vault.where(~F.col("name").isin(excluded or [""])).orderBy("depth", F.lower("path"))
    return rows.limit(most) if most else rows


def file_signals(files: DataFrame, note_days: DataFrame, projects: list[str] | None = None) -> DataFrame:
    """day, state, files: files (path, modified) that by suffix and words speak for a state, on days that have notes (a left-semi join).

    ``projects``: words in the paths of the caller's own memory project; without any no file speaks for that state.
    """
    p = F.lower("path")
    suffix = F.regexp_extract(p, r"(\.[^./]*)$", 1)
    holds = lambda ws: F.rlike(p, F.lit("|".join(ws)))
    own = F.lit(False)
    for w in projects or []:
        own = own | F.contains(p, F.lit(w.lower()))
    state = (
        F.when(suffix.isin(".csv", ".xlsx", ".xls", ".png", ".jpg", ".jpeg", ".svg") & holds(["实验", "数据", "wave", "figure", "plot", "result"]), "Experiment")
        .when(suffix.isin(".docx", ".tex", ".md", ".pdf") & holds(["论文", "thesis", "章节", "盲审"]), "Thesis")
        .when(suffix.isin(".pdf", ".docx") & holds(["简历", "resume", "cv"]), "Career")
        .when(suffix.isin(".py", ".md", ".json") & own, "AI_Memory")
    )
    rows = files.select("path", F.col("modified").alias("day"), state.alias("state")).where("state is not null")
    return rows.join(note_days.select("day").distinct(), "day", "left_semi").groupBy("day", "state").agg(F.countDistinct("path").alias("files"))
