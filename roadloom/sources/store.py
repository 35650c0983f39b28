"""The survey store: three Parquet tables partitioned by survey, a ledger of loads, and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom import schemas
from roadloom.operators.ranking import blocked_rank
from roadloom.session import cut

TABLES = {"surveys": schemas.SURVEY, "defects": schemas.DEFECT, "segments": schemas.SEGMENT, "loads": "stream string, epoch bigint, finished_at timestamp"}
IDS = {"defects": "defect_id", "segments": "segment_id"}


class SurveyStore:
    """Appends, keyed updates and lookups below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(TABLES[table]).parquet(self._path(table))
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            return self.spark.createDataFrame([], TABLES[table])

    def _write(self, df: DataFrame, table: str, mode: str = "append", dealt: bool = False) -> None:
        """``dealt``: the rows lie in ranges of survey already."""
        cols = [f.split()[0] for f in TABLES[table].split(", ")]
        # even files: small surveys share a task, a large one is split over several
        rows = df.select(*cols) if dealt else df.select(*cols).hint("rebalance", "survey_id")
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("survey_id").parquet(
            self._path(table)
        )

    def add_surveys(self, surveys: DataFrame, replace: bool = False) -> None:
        """surveys: survey_id, surveyed_on, route_name, source; status starts as processing.

        ``replace`` writes over what an earlier, broken load of these surveys left, and empties
        their defects and segments.
        """
        rows = surveys.withColumn("status", F.lit("processing")).withColumn("created_at", F.current_timestamp())
        if replace:
            self._clear(surveys.select("survey_id"))
        self._write(cut(rows) if replace else rows, "surveys", "overwrite" if replace else "append")

    def _clear(self, surveys: DataFrame) -> None:
        """Removes the defects and segments of ``surveys``, folder by folder; few surveys of a load have any."""
        jvm = self.spark.sparkContext._jvm
        for table in ("defects", "segments"):
            found = self.read(table).select("survey_id").distinct().join(surveys, "survey_id", "left_semi")
            for row in found.toLocalIterator():
                folder = jvm.org.apache.hadoop.fs.Path(f"{self._path(table)}/survey_id={row['survey_id']}")
                folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def set_survey_status(self, changes: DataFrame) -> None:
        """changes: survey_id, status."""
        old = self.read("surveys").join(changes.select("survey_id"), "survey_id", "left_semi").drop("status")
        self._write(cut(old.join(changes.select("survey_id", "status"), "survey_id")), "surveys", "overwrite")

    def _assign_ids(self, rows: DataFrame, table: str, order: str) -> DataFrame:
        """Ids follow the largest stored one, in survey and given order; given ids are ignored."""
        name = IDS[table]
        top = self.read(table).agg(F.coalesce(F.max(name), F.lit(0))).scalar()
        ranked = blocked_rank(rows, [], order, "_rk", lead=[("survey_id", True)])
        return ranked.withColumn(name, top + F.col("_rk")).drop("_rk")

    def add_defects(self, defects: DataFrame) -> None:
        """Appends defects with status New; boxes are stored flat."""
        numbered = self._assign_ids(defects, "defects", "defect_id")
        have = numbered.columns

        def given(name: str, kind: str):
            return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)

        self._write(
            numbered.select(
                "survey_id", "defect_id", "class_name", "lat", "lon", "severity",
                given("priority", "double"), given("estimated_cost", "double"),
                F.col("area_px").cast("bigint").alias("area_px"), "confidence",
                *[F.col(c).alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")],
                F.lit("New").alias("status"), F.lit(False).alias("recurrence"), F.lit(False).alias("unverified"),
                given("matched_prev_id", "bigint"), given("crop_path", "string"), given("review_status", "string"),
            ),
            "defects",
            dealt=True,
        )

    def add_segments(self, segments: DataFrame) -> None:
        self._write(self._assign_ids(segments, "segments", "segment_id"), "segments", dealt=True)

    def update_defects(self, changes: DataFrame) -> None:
        """changes: survey_id, defect_id, status, matched_prev_id, recurrence, unverified.

        A changed defect takes all four values (missing flags are false); the touched
        surveys only are rewritten.
        """
        fields = ["status", "matched_prev_id", "recurrence", "unverified"]
        flags = {"recurrence", "unverified"}
        new = changes.select(
            "survey_id", "defect_id", F.lit(True).alias("_hit"),
            *[(F.coalesce(f, F.lit(False)) if f in flags else F.col(f)).alias(f"_{f}") for f in fields],
        )
        touched = self.read("defects").join(changes.select("survey_id").distinct(), "survey_id", "left_semi")
        merged = touched.join(new, ["survey_id", "defect_id"], "left")
        for f in fields:
            merged = merged.withColumn(f, F.when(F.col("_hit"), F.col(f"_{f}")).otherwise(F.col(f)))
        self._write(cut(merged), "defects", "overwrite")

    def finish_load(self, stream: str, epoch: int) -> None:
        """Enters a finished micro-batch in the ledger."""
        row = self.spark.range(1).select(F.lit(stream).alias("stream"), F.lit(epoch).cast("bigint").alias("epoch"), F.current_timestamp().alias("finished_at"))
        row.write.mode("append").parquet(self._path("loads"))

    def has_load(self, stream: str, epoch: int) -> bool:
        return not self.read("loads").filter((F.col("stream") == stream) & (F.col("epoch") == epoch)).isEmpty()

    # lookups: partition pruning on survey_id, row-group pruning on defect_id
    def survey(self, survey_id: int) -> DataFrame:
        return self.read("surveys").filter(F.col("survey_id") == survey_id)

    def defect(self, defect_id: int, survey_id: int | None = None) -> DataFrame:
        """The stored defect; with its survey only that survey's folder is read."""
        rows = self.read("defects").filter(F.col("defect_id") == defect_id)
        return rows if survey_id is None else rows.filter(F.col("survey_id") == survey_id)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Stored rows of many defects (survey_id, defect_id); only the wanted surveys' folders are read where these are few."""
        return lookup_defects(self.read("defects"), wanted)

    def defects_of(self, survey_id: int) -> DataFrame:
        return self.read("defects").filter(F.col("survey_id") == survey_id).orderBy("defect_id")

    def segments_of(self, survey_id: int) -> DataFrame:
        return self.read("segments").filter(F.col("survey_id") == survey_id).orderBy("start_m")

    def surveys_newest_first(self) -> DataFrame:
        return self.read("surveys").orderBy(F.col("surveyed_on").desc(), F.col("survey_id").desc())

    def survey_counts(self) -> DataFrame:
        return count_children(self.read("surveys"), self.read("defects"), self.read("segments"))


def lookup_defects(defects: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (survey_id, defect_id) with the stored rows; ``found`` is false for unknown ids."""
    rows = defects.withColumn("_at", F.lit(True))
    return wanted.join(rows, ["survey_id", "defect_id"], "left").withColumn("found", F.coalesce("_at", F.lit(False))).drop("_at")


def count_children(surveys: DataFrame, defects: DataFrame, segments: DataFrame) -> DataFrame:
    """Surveys with their numbers of defects and segments, zero included."""
    d = defects.groupBy("survey_id").agg(F.count("*").alias("n_defects"))
    s = segments.groupBy("survey_id").agg(F.count("*").alias("n_segments"))
    return (
        surveys.join(d, "survey_id", "left")
        .join(s, "survey_id", "left")
        .fillna(0, ["n_defects", "n_segments"])
    )


def export_queue(queue: DataFrame, path: str, rank_col: str = "queue_rank") -> None:
    """Queue CSV in rank order: money with two decimals, absent text empty, absent numbers 0.00.

    A queue of several surveys (it has ``survey_id``) is written as one folder per survey.
    """
    by_survey = ["survey_id"] if "survey_id" in queue.columns else []

    def money(c: str):
        return F.format_string("%.2f", F.coalesce(c, F.lit(0.0)))

    rows = queue.orderBy(*by_survey, rank_col).select(
        *by_survey,
        F.coalesce(F.col("defect_id").cast("string"), F.lit("")).alias("defect_id"),
        F.coalesce("class_name", F.lit("")).alias("class"),
        F.coalesce("severity", F.lit("")).alias("severity"),
        money("priority").alias("priority"),
        money("estimated_cost").alias("estimated_cost"),
        F.coalesce("status", F.lit("")).alias("status"),
    )
    out = rows.write.mode("errorifexists").option("header", True).option("emptyValue", "")
    (out.partitionBy(*by_survey) if by_survey else out).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
