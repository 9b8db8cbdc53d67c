"""Path hierarchy as tables: ancestor closure, folder nodes, pruning, rolled-up weights and sibling ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import path_ancestors, path_name, path_parent
from tessera.operators.skew import row_numbers

ROOT = "root"


def ancestors(paths: DataFrame) -> DataFrame:
    """``path`` to one row ``path, ancestor, depth`` per proper ancestor folder; ``/`` has depth 1."""
    return paths.select("path", F.posexplode(path_ancestors(F.col("path"))).alias("i", "ancestor")).select(
        "path", "ancestor", (F.col("i") + 1).alias("depth")
    )


def _depth() -> Column:
    """Depth of a path below the synthetic root: its number of slashes and one for ``/``."""
    return F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))) + 1


def _folder_and_above() -> Column:
    folder = F.col("path")
    return F.when(folder == "/", F.array(folder)).otherwise(F.array_append(path_ancestors(folder), folder))


def folder_nodes(paths: DataFrame) -> DataFrame:
    """One node per distinct folder above ``paths``, linked to its parent, under a synthetic root.

    Parent folders are made distinct before they are expanded, so the expansion is over folders, not over files.
    """
    parents = paths.select(path_parent(F.col("path")).alias("path")).distinct()
    folders = parents.select(F.explode(_folder_and_above()).alias("path")).distinct()
    top = F.col("path") == "/"
    levels = F.when(top, F.lit(1)).otherwise(_depth())
    nodes = folders.select(
        F.col("path").alias("node_id"),
        F.when(top, F.lit(ROOT)).otherwise(path_parent(F.col("path"))).alias("parent_id"),
        levels.alias("depth"),
        F.lit(0).alias("ord"),
        F.when(top, F.lit("/")).otherwise(path_name(F.col("path"))).alias("name"),
        F.lit("directory").alias("nodetype"),
        "path",
    )
    spark = paths.sparkSession
    root = spark.range(1).select(
        F.lit(ROOT).alias("node_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(0).alias("depth"),
        F.lit(0).alias("ord"),
        F.lit(ROOT).alias("name"),
        F.lit("directory").alias("nodetype"),
        F.lit("/").alias("path"),
    )
    return root.unionByName(nodes)


def file_nodes(paths: DataFrame) -> DataFrame:
    return paths.select(
        F.col("path").alias("node_id"),
        path_parent(F.col("path")).alias("parent_id"),
        _depth().alias("depth"),
        F.lit(0).alias("ord"),
        path_name(F.col("path")).alias("name"),
        F.lit("file").alias("nodetype"),
        "path",
    )


def unit_node_id(path: Column, lineno: Column) -> Column:
    return F.concat(path, F.lit("#"), lineno.cast("string"))


def unit_nodes(units: DataFrame) -> DataFrame:
    """Class, function and method nodes; a method hangs below its class, the others below their file."""
    is_method = F.col("nodetype") == "method"
    owner = F.when(is_method, unit_node_id(F.col("path"), F.col("class_lineno"))).otherwise(F.col("path"))
    return units.select(
        unit_node_id(F.col("path"), F.col("lineno")).alias("node_id"),
        owner.alias("parent_id"),
        (_depth() + F.when(is_method, 2).otherwise(1)).alias("depth"),
        F.col("lineno").alias("ord"),
        "name",
        "nodetype",
        "path",
    )


def build_hierarchy(files: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """All nodes above and in ``files(path)``: ``node_id, parent_id, depth, ord, name, nodetype, path``."""
    paths = files.select("path")
    nodes = folder_nodes(paths).unionByName(file_nodes(paths))
    return nodes if units is None else nodes.unionByName(unit_nodes(units))


def child_facts(nodes: DataFrame) -> DataFrame:
    """Per folder: number of children, whether any is a file, and its only child where there is one."""
    children = nodes.filter(F.col("nodetype").isin("directory", "file"))
    facts = children.groupBy(F.col("parent_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n_children"),
        F.bool_or(F.col("nodetype") == "file").alias("has_files"),
        F.min("node_id").alias("only_child"),
    )
    folders = nodes.filter(F.col("nodetype") == "directory").select("node_id", "parent_id", "depth")
    return folders.join(facts, "node_id", "left").select(
        "node_id",
        "parent_id",
        "depth",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("has_files", F.lit(False)).alias("has_files"),
        F.when(F.col("n_children") == 1, F.col("only_child")).alias("only_child"),
    )


def pruned_root(nodes: DataFrame) -> DataFrame:
    """The node left on top after the leading chain is cut, as one row ``node_id, depth``.

    A folder is passed over while its only child is a folder without files of its own. Above the first fork there is
    one folder per depth, so the answer is the shallowest folder that is not passed over; nothing is walked.
    """
    facts = child_facts(nodes)
    single = facts.select(F.col("node_id").alias("only_child"), (~F.col("has_files")).alias("passed"))
    judged = facts.join(single, "only_child", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    stops = judged.filter(~F.col("passed"))
    return stops.agg(F.min_by("node_id", "depth").alias("node_id"), F.min("depth").alias("depth"))


def below(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """The nodes of the subtree under ``root(node_id)``, the root included."""
    top = root.select("node_id").scalar()
    prefix = F.when(top == "/", F.lit("/")).otherwise(F.concat(top, F.lit("/")))
    inside = (F.col("node_id") == top) | F.startswith("path", prefix)
    return nodes.filter((top == ROOT) | ((F.col("node_id") != ROOT) & inside))


def prune(nodes: DataFrame) -> DataFrame:
    """The tree below its pruned root, which loses its parent.

    Finding the root returns one row to the driver; the cut is then a plain filter on literals.
    """
    top = pruned_root(nodes).first()["node_id"]
    if top == ROOT:
        return nodes
    prefix = top if top == "/" else f"{top}/"
    inside = (F.col("node_id") == top) | F.startswith("path", F.lit(prefix))
    cut = nodes.filter(inside & (F.col("node_id") != ROOT))
    return cut.withColumn("parent_id", F.when(F.col("node_id") != top, F.col("parent_id")))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children, whatever their type: also empty files and classes without methods."""
    parents = nodes.select(F.col("parent_id").alias("node_id")).filter("node_id is not null").distinct()
    return nodes.join(parents, "node_id", "left_anti")


def leaf_weight(lines: Column) -> Column:
    """``log10(lines + 1)``, with 0 lines taken as 1; 0 for a leaf without metrics."""
    return F.coalesce(F.log10(F.when(lines == 0, F.lit(1)).otherwise(lines) + 1), F.lit(0.0))


def subtree_weights(weighted: DataFrame) -> DataFrame:
    """``path, weight`` of leaves to ``node_id, weight`` of every folder above: the sum over its subtree.

    Summed per parent folder first (map-side), so the expansion to ancestors is over folders and not over leaves.
    """
    per_folder = weighted.groupBy(path_parent(F.col("path")).alias("path")).agg(F.sum("weight").alias("weight"))
    return (
        per_folder.select(F.explode(_folder_and_above()).alias("node_id"), "weight")
        .groupBy("node_id")
        .agg(F.sum("weight").alias("weight"))
    )


def node_weights(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """Weight of every node of a code tree, from ``units(path, lineno, nodetype, class_lineno, metrics)``."""
    leaf = units.filter(F.col("nodetype") != "class").select(
        "path",
        unit_node_id(F.col("path"), F.col("lineno")).alias("node_id"),
        F.when(F.col("nodetype") == "method", unit_node_id(F.col("path"), F.col("class_lineno"))).alias("class_id"),
        leaf_weight(F.col("metrics.lines")).alias("weight"),
    )
    in_classes = leaf.filter("class_id is not null").groupBy(F.col("class_id").alias("node_id"))
    in_files = leaf.groupBy("path").agg(F.sum("weight").alias("weight"))
    folders = subtree_weights(in_files)
    everything = folders.filter(F.col("node_id") == "/").select(F.lit(ROOT).alias("node_id"), "weight")
    weights = (
        leaf.select("node_id", "weight")
        .unionByName(in_classes.agg(F.sum("weight").alias("weight")))
        .unionByName(in_files.withColumnRenamed("path", "node_id"))
        .unionByName(folders)
        .unionByName(everything)
    )
    return nodes.join(weights, "node_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def sibling_ranks(weighted: DataFrame) -> DataFrame:
    """Rank of each node among its siblings: weight descending, then the original order."""
    order = [F.col("weight").desc(), F.col("ord"), F.col("node_id")]
    return row_numbers(weighted.filter("parent_id is not null"), ["parent_id"], order, "rank")


def display_names(nodes: DataFrame) -> DataFrame:
    """``node_id, display_name``: a method is shown with the name of its class."""
    classes = nodes.filter(F.col("nodetype") == "class").select(
        F.col("node_id").alias("parent_id"), F.col("name").alias("owner")
    )
    methods = nodes.filter(F.col("nodetype") == "method").join(classes, "parent_id")
    shown = methods.select("node_id", F.concat_ws(".", "owner", "name").alias("display_name"))
    others = nodes.filter(F.col("nodetype") != "method").select("node_id", F.col("name").alias("display_name"))
    return others.unionByName(shown)
