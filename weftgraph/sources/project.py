"""Source trees as tables of files, classified by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config

# File kinds by path, tried in order.
KINDS = (
    ("jsp", r"(?i)[.]jsp$"),
    ("controller", r"Controller[.]java$"),
    ("service", r"(?:Service|ServiceImpl)[.]java$"),
    ("mapper", r"Mapper[.]java$"),
    ("mapper_xml", r"Mapper[.]xml$"),
    ("entity", r"(?:Entity|Model|DTO|VO)[.]java$"),
)
GRADLE_FILES = ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")
WEBAPP_CANDIDATES = ("webapp", "web", "WebContent", "public", "src/main/webapp", "src/main/web", "src/main/WebContent", "src/main/public")


def read_files(spark: SparkSession, root: str, pattern: str = "*", skip: tuple[str, ...] = config.EngineConfig.skip_patterns) -> DataFrame:
    """``path, rel, mtime, length, content`` of the files under ``root`` on any file system Spark reads; skipped folders by part of the path. Spark does not list empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    for part in skip:
        files = files.where(~F.contains("path", F.lit(part)))
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.regexp_replace(F.col("path"), r"^.*?\Q" + base + r"\E/", "")
    return files.select("path", rel.alias("rel"), F.col("modificationTime").alias("mtime"), "length", F.decode("content", "UTF-8").alias("content"))


def kind(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def classify(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``files`` (rel, ..) with ``kind``; rows of no kind go. ``kinds`` None or with ``all``: every kind."""
    out = files.withColumn("kind", kind(F.col("rel"))).where("kind is not null")
    return out if not kinds or "all" in kinds else out.where(F.col("kind").isin(kinds))


def project_type(files: DataFrame) -> DataFrame:
    """One row: maven if there is a pom.xml at the root, gradle by its four files, else unknown."""
    has = lambda *names: F.max(F.col("rel").isin(list(names)))
    return files.agg(F.when(has("pom.xml"), "maven").when(has(*GRADLE_FILES), "gradle").otherwise("unknown").alias("project_type"))


#: Folders by build system and role, the first that holds files or, where ``every``, all; generic java folders must hold .java files.
FOLDERS: dict[str, tuple[tuple[str, tuple[str, ...], bool], ...]] = {
    "maven": (("webapp", ("src/main/webapp",), False), ("java", ("src/main/java",), True), ("resource", ("src/main/resources",), True), ("test", ("src/test/java",), True)),
    "gradle": (("webapp", ("src/main/webapp", "webapp"), False), ("java", ("src/main/java",), True), ("resource", ("src/main/resources",), True), ("test", ("src/test/java",), True)),
    "unknown": (
        ("webapp", ("webapp", "src/main/webapp", "web", "src/main/web", "WebContent", "src/main/WebContent", "public", "src/main/public"), False),
        ("java", ("src/main/java", "src/java", "src", "java"), True), ("resource", ("src/main/resources", "src/resources", "resources"), True), ("test", ("src/test/java",), True),
    ),
}


def directories(files: DataFrame) -> DataFrame:
    """``role, dir``: webapp, java, resource and test folders that hold files, by the rules of the project's build system."""
    dirs = files.select(F.regexp_replace("rel", "/[^/]*$", "").alias("d"), F.col("rel").endswith(".java").alias("java")).groupBy("d").agg(F.max("java").alias("java"))
    cases = [(kind, role, d, i, every) for kind, rules in FOLDERS.items() for role, names, every in rules for i, d in enumerate(names)]
    want = files.sparkSession.createDataFrame(cases, "project_type string, role string, dir string, rank int, every boolean")
    want = want.join(F.broadcast(project_type(files)), "project_type")
    hit = dirs.join(F.broadcast(want), (F.col("d") == F.col("dir")) | F.col("d").startswith(F.concat("dir", F.lit("/"))))
    hit = hit.groupBy("role", "dir", "rank", "every", "project_type").agg(F.max("java").alias("java"))
    hit = hit.where((F.col("role") != "java") | (F.col("project_type") != "unknown") | F.col("java"))
    first = F.row_number().over(Window.partitionBy("role").orderBy("rank"))
    return hit.withColumn("k", first).where("every or k = 1").select("role", "dir")


def contains_java(files: DataFrame, folder: str, max_depth: int = 3) -> DataFrame:
    """One row: whether a .java file lies under ``folder`` within ``max_depth`` levels."""
    below = F.substring_index(F.col("rel"), folder + "/", -1)
    deep = F.size(F.split(below, "/")) <= max_depth
    return files.agg(F.coalesce(F.max(F.col("rel").startswith(folder + "/") & F.col("rel").endswith(".java") & deep), F.lit(False)).alias("contains_java"))


def mapper_pairs(files: DataFrame) -> DataFrame:
    """``stem, interface, xml``: mapper interfaces with the last XML of their name; null where one is missing."""
    stem = F.regexp_extract("rel", r"([^/]+)[.][^.]+$", 1)
    c = classify(files, ["mapper", "mapper_xml"]).withColumn("stem", stem)
    java = c.where("kind = 'mapper'").groupBy("stem").agg(F.max("rel").alias("interface"))
    xml = c.where("kind = 'mapper_xml'").groupBy("stem").agg(F.max("rel").alias("xml"))
    return java.join(xml, "stem", "full_outer")


def tasks(files: DataFrame) -> DataFrame:
    """``kind, identifier, context``: what to analyse; mapper tasks carry their XML as context, entities give none."""
    one = classify(files, ["jsp", "controller", "service"]).select("kind", F.col("rel").alias("identifier"), F.lit(None).cast("string").alias("context"))
    pairs = mapper_pairs(files).select(F.lit("mapper").alias("kind"), F.coalesce("interface", "xml").alias("identifier"), F.when(F.col("interface").isNotNull(), F.col("xml")).alias("context"))
    return one.unionByName(pairs)


def counts(files: DataFrame) -> DataFrame:
    return classify(files).groupBy("kind").agg(F.count("*").alias("n"))
