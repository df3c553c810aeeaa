"""Sinks: documents of programs, issues and architectures, triples and the model document, each a distributed write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators import model as M
from fleetscope.operators.triples import to_ntriples

from .launch import LaunchModel, documents_model, to_documents


def _write(rows: DataFrame, key: str, path: str, as_files: bool) -> None:
    """(key, document) as a folder and file a key, which suits a workspace, or as one table, which suits any number of them."""
    if as_files:
        rows.select(key, F.col("document").alias("value")).write.mode("overwrite").partitionBy(key).text(path)
    else:
        rows.select(key, "document").write.mode("overwrite").parquet(path)


def write_documents(model: LaunchModel, path: str, as_files: bool = True) -> None:
    """One JSON document a launch description, in a folder of its id (files of one stem don't overwrite each other), or in one table."""
    _write(to_documents(model), "ld_id", path, as_files)


def read_document_table(spark, path: str) -> LaunchModel:
    """The model of a table that write_documents wrote."""
    return documents_model(spark.read.parquet(path).select(F.col("ld_id").alias("path"), F.col("document").cast("binary").alias("content")))


def issue_documents(issues: DataFrame, timestamp: str, key: str = "ld_id") -> DataFrame:
    """(key, document): ``{analysis_timestamp, issue_count, issues}`` with one timestamp for all. Issues of a description are few; they are gathered by its id."""
    fields = F.struct("issue_id", "severity", "category", "description", "entity_type", "entity_id", "analysis_tool", F.lit(timestamp).alias("analysis_timestamp"), "metadata")
    each = issues.groupBy(key).agg(F.count(F.lit(1)).alias("issue_count"), F.sort_array(F.collect_list(F.to_json(fields))).alias("said"))
    return each.select(key, F.concat(F.lit('{"analysis_timestamp":"'), F.lit(timestamp), F.lit('","issue_count":'), F.col("issue_count").cast("string"), F.lit(',"issues":['), F.array_join("said", ","), F.lit("]}")).alias("document"))


def write_issues(issues: DataFrame, path: str, timestamp: str, key: str = "ld_id", as_files: bool = True) -> None:
    _write(issue_documents(issues, timestamp, key), key, path, as_files)


def read_issues(spark, path: str) -> DataFrame:
    """Issues of files that hold a list, or a document with ``issues``."""
    item = "array<struct<issue_id: string, id: string, severity: string, category: string, description: string, entity_type: string, entity_id: string, analysis_tool: string, analysis_timestamp: string>>"
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    both = rows.select(F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", item)), F.from_json("value", f"struct<issues: {item}>")["issues"]).alias("x"))
    return both.select(F.explode("x").alias("x")).select("x.*").withColumn("issue_id", F.coalesce("issue_id", "id")).drop("id")


def architecture_documents(arch: dict[str, DataFrame]) -> DataFrame:
    """(graph, document): nodes, topics, publications, subscriptions and warnings of each architecture."""
    out = arch["nodes"].select("graph").distinct()
    for name in ("nodes", "topics", "publications", "subscriptions", "warnings"):
        rows = arch[name]
        out = out.join(rows.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "graph"]))).alias(name)), "graph", "left")
    return out.select("graph", F.to_json(F.struct(F.col("graph").alias("id"), "nodes", "topics", "publications", "subscriptions", "warnings")).alias("document"))


def write_architectures(arch: dict[str, DataFrame], path: str, as_files: bool = True) -> None:
    _write(architecture_documents(arch), "graph", path, as_files)


def write_ntriples(triples: DataFrame, path: str) -> None:
    to_ntriples(triples).write.mode("overwrite").text(path)


#: Actions that one model document tells of at most.
MOST_ACTIONS = 1_000_000


def model_document(model: LaunchModel, issues: DataFrame | None = None, project: str = "fleet", interfaces: DataFrame | None = None) -> DataFrame:
    """One JSON document of a whole workspace: packages with their files, descriptions under their main package, execution configurations, issues.

    For a workspace that one viewer shows: more than MOST_ACTIONS are refused, as larger fleets keep the tables.
    """
    model = model.stored
    if model.actions.limit(MOST_ACTIONS + 1).count() > MOST_ACTIONS:
        raise ValueError(f"one document cannot hold more than {MOST_ACTIONS} actions")
    actions, named = model.actions, M.main_package(model.actions).select("ld_id", "package")
    nodes = actions.where("action_type = 'node' AND package <> '' AND NOT startswith(package, '$(')")
    files = nodes.select("package", F.col("file_id").alias("path")).distinct()
    file_of = F.struct(F.concat(F.lit("file_"), F.substring(F.md5("path"), 1, 8)).alias("id"), "path", F.when(F.col("path").endswith(".py"), "python").when(F.col("path").endswith(".xml"), "xml").otherwise("yaml").alias("language"))
    packages = files.groupBy(F.col("package").alias("name")).agg(F.sort_array(F.collect_list(file_of)).alias("files"))
    packages = packages.select(F.concat(F.lit("package_"), F.regexp_replace("name", "[-.]", "_")).alias("id"), "name", F.concat(F.lit("src/"), "name").alias("path"), "files")
    descriptions = model.descriptions.join(named, "ld_id", "left").select("ld_id", F.concat(F.coalesce(F.concat("package", F.lit("/")), F.lit("")), "launch_file_id").alias("launch_file_id"), "format", F.col("launch_file_id").alias("file_id"))
    configs = M.exec_configs(descriptions.select(F.lit(project).alias("workspace"), "ld_id")).join(descriptions, "ld_id").select(F.col("config_id").alias("id"), "ld_id", "launch_file_id")

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name))

    parts = [gathered(packages, "packages"), gathered(descriptions, "launch_descriptions"), gathered(configs, "execution_configurations")]
    if interfaces is not None:
        parts.append(gathered(interfaces.select("impl_id", "package", "executable", "node_type", "language"), "node_implementations"))
    if issues is not None:
        parts.append(gathered(issues.select("issue_id", "issue_key", "severity", "description", "entity_id"), "issues"))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.select(F.to_json(F.struct(F.lit("1.0.0").alias("metamodel_version"), F.lit(project).alias("project_name"), *out.columns)).alias("document"))


def folder_document(spark, folder: str, project: str = "fleet") -> DataFrame:
    """The model document of a results folder: its programs (*.json), its issues below ``issues`` and the annotations in ``node_interfaces`` beside it, as far as there are any."""
    from .interfaces import read_interfaces
    from .launch import read_documents

    def there(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    beside = f"{folder.rstrip('/').rpartition('/')[0]}/node_interfaces"
    issues = read_issues(spark, f"{folder}/issues").withColumn("issue_key", F.lit(None).cast("string")) if there(f"{folder}/issues") else None
    impls = read_interfaces(spark, beside).impls if there(beside) else None
    return model_document(read_documents(spark, folder), issues, project, impls)
