"""Runs and curves in and out of files: JSON documents, Parquet curves, CSV exports, text summaries."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cosmotab.functions import cosmology as cos
from cosmotab.operators.pairing import shares
from cosmotab.operators.params import plain_number, safe_stem
from cosmotab.sources.schemas import RUN

#: The products of a run.
PRODUCTS = ("params.json", "derived.json", "class_settings.json", "power_spectrum.csv", "sigma.csv", "hmf.csv", "run_summary.md")
#: The two header versions of an exported sigma curve.
SIGMA_HEADERS = {
    "new": ("M_h_hinv_Msun", "M_Msun", "R_Mpc", "sigma", "dlnsigma_dlnM"),
    "old": ("M_h_inv_Msun", "M_Msun", "R_Mpc", "sigma", "dlnsigma_dlnM", "window_type"),
}
#: The header of an exported mass function.
HMF_HEADER = ("M_h_inv_Msun", "hmf_press_schechter_z0", "hmf_sheth_tormen_z0", "cumulative_press_schechter_z0", "cumulative_sheth_tormen_z0")
#: The header of an exported power spectrum.
POWER_HEADER = ("k_Mpc^-1", "P_Mpc^3", "Delta2")
#: The columns that imported curves have.
SIGMA_COLUMNS = ("m_h", "m", "r", "sigma", "dlns", "window_type")
#: Folders of a written dataset, and most rows of one of its files.
BUCKETS, ROWS_PER_FILE = 64, 2_000_000
#: Folders of runs that one task writes, and most tasks that list folders for the importers.
FOLDERS_A_TASK, LISTING_TASKS = 128, 64


def read_runs(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(runs by created_at, rejects): the documents of a folder with names and defaults filled in; unreadable ones, or
    ones without an id, are the rejects (their text; a document without an id has no text that is left).

    run_name, the older alias, comes before name; visible is true, is_baseline false and exports empty where they're
    missing; updated_at is then created_at, and now where that is missing too."""
    schema = T.StructType([*T._parse_datatype_string(RUN).fields, T.StructField("_corrupt", T.StringType())])
    docs = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("run_id").isNull()
    runs = docs.filter(~bad).drop("_corrupt").withColumns({
        "name": F.coalesce("run_name", "name", F.lit("Untitled run")), "visible": F.coalesce("visible", F.lit(True)), "is_baseline": F.coalesce("is_baseline", F.lit(False)),
        "exports": F.coalesce("exports", F.create_map().cast("map<string,string>")), "updated_at": F.coalesce("updated_at", "created_at", F.current_timestamp()),
    }).drop("run_name")
    return runs.orderBy("created_at", "run_id"), docs.filter(bad).select(F.col("_corrupt").alias("text"))


def bucket_of(run_id: Column) -> Column:
    """The folder that a run's rows are written to."""
    return F.pmod(F.hash(run_id), F.lit(BUCKETS))


def laid_out(rows: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """rows with their bucket, dealt to counted / rows_per_file tasks by ranges of (bucket, run_id, all columns), sorted.

    The rows are counted first, so tasks and files grow with the data, while the folders stay BUCKETS. A run lies in one
    folder, mostly in one file; one that holds a large share of all rows is cut by its other columns. Files are sorted by
    run_id, so readers of one run skip by folder, by file and by row group. The rows are worked out three times (count,
    sample of the ranges, write): store them first if that is dear.
    """
    tasks = max(1, -(-rows.count() // rows_per_file))
    keys = ["bucket", "run_id", *[c for c, kind in rows.dtypes if c != "run_id" and not kind.startswith(("map", "array", "struct"))]]
    return rows.withColumn("bucket", bucket_of(F.col("run_id"))).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)


def write_curves(curves: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Curves as Parquet in BUCKETS folders by hashed run_id, no file of more than rows_per_file rows."""
    laid_out(curves, rows_per_file).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("bucket").parquet(path)


def write_runs(runs: DataFrame, curves: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Documents as JSON lines under path/runs, curves as Parquet under path/curves."""
    runs.write.mode("overwrite").json(f"{path}/runs")
    write_curves(curves, f"{path}/curves", rows_per_file)


def read_curves(spark: SparkSession, path: str, run_id: object = None) -> DataFrame:
    """Curves that write_curves() wrote; those of one run are read from its folder alone, and there from the files and row
    groups whose range of ids holds it."""
    rows = spark.read.parquet(path)
    if run_id is not None:
        wanted = F.lit(run_id).cast(rows.schema["run_id"].dataType)
        number = spark.range(1).select(bucket_of(wanted)).first()[0]
        rows = rows.filter((F.col("bucket") == number) & (F.col("run_id") == wanted))
    return rows.drop("bucket")


def export_power(power: DataFrame) -> DataFrame:
    """The exported power table: run_id, k, P and Delta2 at z = 0."""
    return power.filter("z = 0").select("run_id", F.col("k").alias("k_Mpc_inv"), F.col("p").alias("P_Mpc3"), cos.delta2(F.col("k"), F.col("p")).alias("Delta2"))


def export_sigma(sigma: DataFrame, header: str = "new") -> DataFrame:
    """The exported sigma table at z = 0 under the header's column names."""
    c = F.col
    values = (c("m_h"), c("m"), c("r"), c("sigma"), c("dlns"), c("window_type"))
    names = SIGMA_HEADERS[header]
    return sigma.filter("z = 0").select("run_id", *[v.alias(n) for v, n in zip(values, names, strict=False)])


def export_hmf(hmf: DataFrame) -> DataFrame:
    """One row a mass at z = 0: both analytic fits' mass functions and tails."""
    fits = {"Press-Schechter 1974": "press_schechter", "Sheth-Tormen 2001": "sheth_tormen"}
    rows = hmf.filter(F.col("z") == 0).groupBy("run_id", F.col("m_h").alias("M_h_inv_Msun")).pivot("fit", list(fits)).agg(F.first("hmf").alias("hmf"), F.first("n_gt_m").alias("cumulative"))
    return rows.select("run_id", "M_h_inv_Msun", *[F.col(f"`{f}_{v}`").alias(f"{v}_{s}_z0") for v in ("hmf", "cumulative") for f, s in fits.items()])


def z_column(z: float, before: str, after: str = "") -> str:
    """A column name of a redshift; a point in it is written p."""
    return f"{before}{z:g}{after}".replace(".", "p")


def export_power_wide(power: DataFrame, zs: list[float]) -> DataFrame:
    """One row a run and k, one column of P for each redshift of the list."""
    wide = power.groupBy("run_id", "k").agg(*[F.max(F.when(F.col("z") == z, F.col("p"))).alias(z_column(z, "P_z", "_Mpc3")) for z in zs])
    return wide


def export_sigma_wide(sigma: DataFrame, zs: list[float]) -> DataFrame:
    """One row a run and mass, one column of sigma for each redshift of the list."""
    return sigma.groupBy("run_id", "m_h", "m", "r").agg(*[F.max(F.when(F.col("z") == z, F.col("sigma"))).alias(z_column(z, "sigma_z")) for z in zs])


def write_csv(table: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """A CSV dataset with headers, laid out as curves are; run_id is the first column. read_csv() reads it."""
    rows = laid_out(table.select("run_id", *[x for x in table.columns if x != "run_id"]), rows_per_file)
    rows.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).partitionBy("bucket").csv(path)


def read_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A dataset that write_csv() wrote: run_id and the other columns (DDL), in order. Files with another header are an
    error; for files that others exported see import_curves()."""
    return spark.read.schema(f"run_id bigint, {columns}").option("header", True).option("enforceSchema", False).csv(path, recursiveFileLookup=True)


def write_run_folders(table: DataFrame, path: str) -> None:
    """One folder a run with one CSV file, named by its id, for readers that want that; as many folders as runs.

    A folder costs calls of the file system, not bytes: the runs are counted, and dealt by number to as many tasks as they
    ask for (Spark would join small partitions into a few). The rows are worked out twice: store them first if that is dear.
    """
    tasks = shares(table.select("run_id").distinct().count(), FOLDERS_A_TASK)
    table.repartition(tasks, "run_id").write.mode("overwrite").option("header", True).partitionBy("run_id").csv(path)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by LISTING_TASKS tasks at most while this lasts: by default each of 10,000 folders gets a task, which
    costs more than the folder does."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), LISTING_TASKS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def exported_rows(spark: SparkSession, paths: str | list[str], headers: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """(lines, rejects) of exported CSV files in one folder a run, `<run_id>/<any name>.csv`, below the paths.

    A file's columns are found by the names in its own first line, in any order: they must be just those of one of the
    given headers (version -> names). lines: path, run_id (the folder's name as text; `run_id=` before it doesn't count),
    header (the version), line (its number in the file, 1 is the header) and cells, a map of name and text. rejects: path,
    line and reason, of files with an unknown header or none, and of lines with more or fewer cells than the header.
    Line ends are LF or CRLF; blank lines and files without a byte don't count. A file is one row and so must fit in memory: it holds one run's
    curve, some thousand lines at most.
    """
    with few_listing_tasks(spark):
        files = spark.read.format("binaryFile").load(paths, pathGlobFilter="*.csv", recursiveFileLookup=True)
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), r"^file:/+", "/")
    value = F.col("content").cast("string")
    files = files.filter("length > 0").select(path.alias("path"), F.split(F.regexp_replace(value, "^\ufeff", ""), "\r?\n").alias("texts"))
    cells = lambda text: F.transform(F.split(text, ","), lambda x: F.btrim(x, F.lit(' "')))
    names = cells(F.col("texts")[0])
    version = F.coalesce(*[F.when(F.array_sort(names) == F.array(*[F.lit(n) for n in sorted(h)]), F.lit(v)) for v, h in headers.items()])
    files = files.withColumns({"names": names, "header": version, "run_id": F.regexp_extract("path", r"(?:run_id=)?([^/]*)/[^/]+$", 1)})
    known = files.filter("header is not null").select("path", "run_id", "header", "names", F.posexplode("texts").alias("line", "text"))
    known = known.filter((F.col("line") > 0) & (F.trim("text") != "")).select("path", "run_id", "header", (F.col("line") + 1).alias("line"), "names", cells(F.col("text")).alias("values"))
    fits = F.size("values") == F.size("names")
    rejects = files.filter("header is null").select("path", F.lit(1).alias("line"), F.concat(F.lit("unknown header: "), F.left(F.col("texts")[0], F.lit(200))).alias("reason"))
    ragged = known.filter(~fits).select("path", "line", F.format_string("%d cells under %d names", F.size("values"), F.size("names")).alias("reason"))
    found = F.when(fits, F.map_from_arrays("names", "values")).alias("cells")  # the condition stays with it wherever filters move
    return known.filter(fits).select("path", "run_id", "header", "line", found), rejects.unionByName(ragged)


def _numbers(lines: DataFrame, rejects: DataFrame, columns: dict[str, Column], texts: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the columns as doubles; a line with a cell that is no number is a reject."""
    rows = lines.withColumns({n: t.try_cast("double") for n, t in columns.items()} | texts)
    good = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in columns])
    bad = rows.filter(~good).select("path", "line", F.lit("a cell is no number").alias("reason"))
    return rows.filter(good).select("run_id", *columns, *texts, "header", "path"), rejects.unionByName(bad)


def import_curves(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(curves, rejects) of exported sigma files of both header versions, see exported_rows(): run_id (text, from the folder),
    m_h, m, r, sigma, dlns, window_type (null in the newer version, which hasn't the column), header (new or old), path."""
    lines, rejects = exported_rows(spark, paths, SIGMA_HEADERS)
    cell = lambda n: F.coalesce(*[F.try_element_at("cells", F.lit(SIGMA_HEADERS[v][n])) for v in SIGMA_HEADERS if n < len(SIGMA_HEADERS[v])])
    return _numbers(lines, rejects, {c: cell(i) for i, c in enumerate(SIGMA_COLUMNS[:-1])}, {SIGMA_COLUMNS[-1]: cell(5)})


def import_hmf(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of exported mass functions and tails of both analytic fits, see exported_rows(): run_id (text, from
    the folder), the exported columns, header and path."""
    lines, rejects = exported_rows(spark, paths, {"hmf": HMF_HEADER})
    return _numbers(lines, rejects, {n: F.try_element_at("cells", F.lit(n)) for n in HMF_HEADER}, {})


def import_power(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of exported power spectra at z = 0, see exported_rows(): run_id (text, from the folder), k, p, delta2,
    header and path."""
    lines, rejects = exported_rows(spark, paths, {"power": POWER_HEADER})
    return _numbers(lines, rejects, {c: F.try_element_at("cells", F.lit(n)) for c, n in zip(("k", "p", "delta2"), POWER_HEADER, strict=True)}, {})


def export_completeness(runs: DataFrame, produced: DataFrame) -> DataFrame:
    """run_id, file, present for each run and each of the expected products; produced lists (run_id, file)."""
    expected = runs.select("run_id", F.explode(F.array(*map(F.lit, PRODUCTS))).alias("file"))
    return expected.join(produced.select("run_id", "file").distinct().withColumn("_there", F.lit(True)), ["run_id", "file"], "left").select("run_id", "file", F.col("_there").isNotNull().alias("present"))


def stripped(text: Column) -> Column:
    """A text without white space, line ends included, at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def run_summary(runs: DataFrame) -> DataFrame:
    """run_id, stem (for its file) and summary: the reproducibility text of each run, Markdown, with its notes' bullets
    (column bullets, an array of texts; null or missing: none). The sentences are fixed values."""
    c, n = F.col, plain_number
    bullets = F.coalesce("bullets", F.array().cast("array<string>")) if "bullets" in runs.columns else F.array().cast("array<string>")
    text = F.concat_ws(
        "\n", F.concat(F.lit("# "), c("name")), F.lit(""), stripped(F.coalesce("notes", F.lit(""))), F.lit(""), F.lit("## Reproducibility"), F.lit(""),
        F.concat(F.lit("- Backend: "), F.coalesce("class_status", F.lit("UNKNOWN"))),
        F.concat(F.lit("- k range: "), n(c("k_min")), F.lit(" to "), n(c("k_max")), F.lit(" Mpc^-1")), F.format_string("- k samples: %d", c("k_points")),
        F.concat(F.lit("- mass range: 10^"), n(c("mass_min_exp")), F.lit(" to 10^"), n(c("mass_max_exp")), F.lit(" h^-1 Msun")), F.format_string("- mass samples: %d", c("mass_points")),
        F.concat(F.lit("- window: "), c("window_type")), F.lit("- integration: log-k Simpson rule on the sampled grid"), F.lit(""), F.lit("## Notes"),
    )
    listed = F.when(F.size(bullets) > 0, F.concat(F.lit("\n\n"), F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n"))).otherwise("")
    return runs.select("run_id", safe_stem(c("name")).alias("stem"), F.concat(stripped(F.concat(text, listed)), F.lit("\n")).alias("summary"))
