"""The registered queries: each takes ``(spark, sf_dir)`` and reads whole tables of that folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.metrics import METRIC_NAMES, node_type_counts, round3, shown
from tessera.functions.text import (
    has_marker,
    label_text,
    line_count,
    line_range,
    lines_of,
    name_or_fallback,
    path_name,
    path_parent,
    qualified_name,
)
from tessera.operators import hierarchy, summary
from tessera.operators.extract import render_corpus
from tessera.operators.neardup import (
    attach_matches,
    best_by_sketch,
    build_index,
    pair_groups,
    partner_counts,
    partners_of,
    sketch_pairs,
    sketch_units,
)
from tessera.operators.quantiles import exact_quantiles
from tessera.operators.scoring import best_by_text, score_pairs
from tessera.plans.analysis import Report
from tessera.plans.rendered import render_files
from tessera.session import spread, stage, stage_path
from tessera.sources.corpus import scan_table
from tessera.sources.files import drop_ignored, merge_inputs, plan_scan, scan_corpus
from tessera.sources.report import read_report
from tessera.sources.tables import document_path, document_units, page_paths, table, text_units, token_units

# Words counted in the prose tables, which have no TODO comments.
PROSE_MARKERS = ("the", "que", "der", "los")
IGNORED_DIRS = ("/spam-farm.example.org", "/www.cheap-pills.example.com/en")
IGNORED_FILES = ("/blog.tionsh.example.net/es/533",)
CHAIN = "/data/corpus"
CONTINUOUS_QUANTILES = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)


def _r6(x: Column, name: str) -> Column:
    return F.round(x, 6).alias(name)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _document_tokens(spark, sf_dir):
    return token_units(_documents(spark, sf_dir), "doc_id", "text")


def _document_texts(spark, sf_dir):
    return text_units(_documents(spark, sf_dir), "doc_id", "text")


# Units, lines, words


def unit_lines_tokens(spark, sf_dir):
    units = document_units(_documents(spark, sf_dir))
    counts = _document_tokens(spark, sf_dir).select("key", F.size("tokens").alias("n_tokens"))
    return units.join(counts, "key").select(
        F.col("key").alias("doc_id"), "path", path_name(F.col("path")).alias("name"), path_parent(F.col("path")).alias("parent"),
        "lines", "n_tokens",
    )


def _marked_lines(text: Column) -> Column:
    return F.size(F.filter(lines_of(text), lambda s: has_marker(s, PROSE_MARKERS)))


def marker_counts(spark, sf_dir):
    docs = spread(_documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", _marked_lines(F.col("text")).alias("todo_comments"))


def line_slice(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", line_range(F.col("text"), F.lit(2), F.lit(4)).alias("source"))


def _conversation_units(spark, sf_dir) -> DataFrame:
    """Conversations as classes ``conv<id>`` and their turns as methods ``turn<k>`` of one file."""
    turns = table(spark, sf_dir, "conversations")
    owner = F.concat(F.lit("conv"), F.col("conv_id").cast("string"))
    path = F.concat(F.lit("/chats/"), owner)
    methods = turns.select(
        path.alias("path"),
        F.lit("method").alias("nodetype"),
        F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("name"),
        owner.alias("class_name"),
        F.lit(1).alias("class_lineno"),
        (F.col("turn") + 2).cast("int").alias("lineno"),
    )
    classes = methods.select(
        "path", F.lit("class").alias("nodetype"), F.col("class_name").alias("name"), F.lit(None).cast("string").alias("class_name"),
        F.lit(None).cast("int").alias("class_lineno"), F.lit(1).alias("lineno"),
    ).distinct()
    return classes.unionByName(methods)


def qualified_names(spark, sf_dir):
    units = _conversation_units(spark, sf_dir)
    shown_as = hierarchy.display_names(hierarchy.unit_nodes(units))
    qualname = F.when(F.col("nodetype") == "method", qualified_name(F.col("class_name"), F.col("name"))).otherwise("")
    named = units.select(
        hierarchy.unit_node_id(F.col("path"), F.col("lineno")).alias("node_id"),
        qualname.alias("qualname"),
        name_or_fallback(qualname, F.col("name")).alias("reported"),
    )
    return named.join(shown_as, "node_id")


# Near-duplicates


def shingle_sketch(spark, sf_dir):
    sketched = sketch_units(_document_texts(spark, sf_dir)).filter(F.col("n") > 0)
    return sketched.select(F.col("key").alias("doc_id"), "n_tokens", "n", F.array_join("fp", ",").alias("fp"))


def neardup_pairs(spark, sf_dir):
    return _rounded(sketch_pairs(build_index(_document_texts(spark, sf_dir))), "jaccard")


def neardup_groups(spark, sf_dir):
    """All gated pairs of documents as pairs of groups of copies, with the number of pairs that each stands for."""
    links = pair_groups(build_index(_document_texts(spark, sf_dir))).links
    return _rounded(links.select("a", "b", "size_a", "size_b", "inter", "uni", "jaccard", "pairs"), "jaccard")


def neardup_links(spark, sf_dir):
    """Each document's group of copies and its number of gated partners."""
    counts = partner_counts(pair_groups(build_index(_document_texts(spark, sf_dir))))
    return counts.select(F.col("key").alias("doc_id"), F.col("group").alias("group_id"), "size", "n_links")


def neardup_partners(spark, sf_dir):
    """Every gated partner of the documents that are asked for: those with an id divisible by 50, among all."""
    asked = _documents(spark, sf_dir).filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("key"))
    found = partners_of(pair_groups(build_index(_document_texts(spark, sf_dir)), asked), asked)
    return found.select(F.col("key").alias("doc_id"), F.col("partner").alias("other_id"), _r6(F.col("jaccard"), "jaccard"))


def neardup_best(spark, sf_dir):
    """Each document's nearest copy by sketch, with the partner's name and lines."""
    best = best_by_sketch(build_index(_document_texts(spark, sf_dir)))
    matches = attach_matches(best, document_units(_documents(spark, sf_dir)))
    return _rounded(matches.withColumnRenamed("key", "doc_id"), "score")


def neardup_pages(spark, sf_dir):
    best = best_by_sketch(build_index(text_units(table(spark, sf_dir, "pages"), "page_id", "html")))
    return best.select(F.col("key").alias("page_id"), _r6(F.col("score"), "score"), F.col("partner").alias("other_id"))


def neardup_merged(spark, sf_dir):
    """Two tables as one corpus, with a two-part key."""
    def part(kind: str, name: str, key: str) -> DataFrame:
        unit = F.struct(F.lit(kind).alias("kind"), F.col(key).alias("id"))
        return text_units(table(spark, sf_dir, name).select(unit.alias("unit"), "text"), "unit", "text")

    corpus = part("benchmark", "benchmark", "item_id").unionByName(part("document", "documents", "doc_id"))
    best = best_by_sketch(build_index(corpus))
    return best.select(
        "key.kind", "key.id", _r6(F.col("score"), "score"), F.col("partner.kind").alias("other_kind"),
        F.col("partner.id").alias("other_id"),
    )


def neardup_scored(spark, sf_dir):
    """Each document's nearest copy by exact text similarity among all gated partners."""
    documents = _documents(spark, sf_dir)
    index = build_index(_document_texts(spark, sf_dir))
    by_sketch = stage(best_by_sketch(index), "best-by-sketch")
    sources = spread(documents.select(F.col("doc_id").alias("key"), F.col("text").alias("source")))
    best = best_by_text(index, sources, by_sketch).withColumn("score", round3(F.col("score")))
    return attach_matches(best, document_units(documents)).withColumnRenamed("key", "doc_id")


def neardup_extended(spark, sf_dir):
    """The pass by exact ratio over each document and a copy of it with one more character, so that the winner is known:
    an equal text if there is one, else the document's own other form."""
    docs = _documents(spark, sf_dir).filter(F.col("text").isNotNull())
    forms = F.explode(F.array(
        F.struct((2 * F.col("doc_id")).alias("key"), F.col("text").alias("source")),
        F.struct((2 * F.col("doc_id") + 1).alias("key"), F.concat("text", F.lit("\x01")).alias("source")),
    )).alias("form")
    sources = stage(spread(docs.select("doc_id", "text")).select(forms).select("form.*"), "extended")
    index = build_index(sources.select("key", F.col("source").alias("text")))
    best = best_by_text(index, sources, stage(best_by_sketch(index), "best-by-sketch"))
    return best.select(F.col("key").alias("unit_id"), round3(F.col("score")).alias("score"), F.col("partner").alias("other_id"))


# The scan, over files that tasks have written


def _tree(spark, sf_dir) -> tuple[str, list[str], list[str]]:
    """Root of the rendered files, overlapping and missing inputs, and ignores."""
    root = render_files(_documents(spark, sf_dir))
    inputs = ("src", "src/a1", "src/a1/b1", "more/_f31.py", "none")
    return root, [f"{root}/{p}" for p in inputs], [f"{root}/{p}" for p in ("src/skip", "src/a2/b0", "src/away")]


def _inside(root: str) -> Column:
    return F.replace("path", F.lit(f"{root}/"), F.lit(""))


def scan_files(spark, sf_dir):
    """Found files with size and decoded content: overlapping folders, a single file, links, ignored folders."""
    root, inputs, ignores = _tree(spark, sf_dir)
    found = scan_table(spark, inputs, ignores).filter(F.col("error").isNull())
    return found.select(_inside(root).alias("path"), "size", F.length("content").alias("chars"), F.md5("content").alias("content_md5"))


def scan_plan(spark, sf_dir):
    """The dry run of the scan that the analysis uses: paths only, nothing is opened."""
    root, inputs, ignores = _tree(spark, sf_dir)
    return plan_scan(scan_corpus(spark, inputs, ignores)).select(_inside(root).alias("path"))


def scan_errors(spark, sf_dir):
    """What the scan could not find: an input, an ignored folder, and the targets of links."""
    root, inputs, ignores = _tree(spark, sf_dir)
    bad = scan_table(spark, inputs, ignores, content=False).filter(F.col("error").isNotNull())
    return bad.groupBy(_inside(root).alias("path"), "kind").agg(F.count(F.lit(1)).alias("n"))


# Paths and trees


def scan_dedup_ignore(spark, sf_dir):
    paths = page_paths(table(spark, sf_dir, "pages"))
    everything, secure = paths.select("path"), table(spark, sf_dir, "pages").filter(F.startswith("url", F.lit("https:")))
    merged = merge_inputs([everything, page_paths(secure).select("path")])
    return drop_ignored(merged, IGNORED_FILES, IGNORED_DIRS)


def path_ancestors(spark, sf_dir):
    return hierarchy.ancestors(page_paths(table(spark, sf_dir, "pages")).select("path").distinct())


def dir_nodes(spark, sf_dir):
    nodes = hierarchy.folder_nodes(page_paths(table(spark, sf_dir, "pages")))
    return nodes.select("node_id", "parent_id", "depth", "name", "path")


def node_predicates(spark, sf_dir):
    paths = page_paths(table(spark, sf_dir, "pages")).select("path").distinct()
    facts = hierarchy.child_facts(hierarchy.build_hierarchy(paths))
    return facts.select("node_id", "n_children", "has_files")


def _chained_documents(spark, sf_dir) -> DataFrame:
    path = F.concat(F.lit(CHAIN), document_path())
    return _documents(spark, sf_dir).select(path.alias("path"), line_count(F.col("text")).alias("lines"))


def prune_root(spark, sf_dir):
    nodes = hierarchy.prune(hierarchy.build_hierarchy(_chained_documents(spark, sf_dir)))
    return nodes.select("node_id", "parent_id", "depth", "name", "nodetype")


def subtree_nodes(spark, sf_dir):
    nodes = hierarchy.build_hierarchy(_chained_documents(spark, sf_dir))
    top = nodes.filter(F.col("node_id") == f"{CHAIN}/en").select("node_id")
    return hierarchy.below(nodes, top).select("node_id", "nodetype")


def _document_weights(spark, sf_dir) -> DataFrame:
    docs = _documents(spark, sf_dir).select(document_path().alias("path"), line_count(F.col("text")).alias("lines"))
    return docs.select("path", hierarchy.leaf_weight(F.col("lines")).alias("weight"))


def subtree_weight(spark, sf_dir):
    return _rounded(hierarchy.subtree_weights(_document_weights(spark, sf_dir)), "weight")


def sibling_rank(spark, sf_dir):
    nodes = hierarchy.file_nodes(_documents(spark, sf_dir).select(document_path().alias("path")))
    weights = _document_weights(spark, sf_dir).withColumnRenamed("path", "node_id")
    ranked = hierarchy.sibling_ranks(nodes.join(weights, "node_id"))
    return _rounded(ranked.select("node_id", "parent_id", "weight", "rank"), "weight")


def leaf_units(spark, sf_dir):
    units = _conversation_units(spark, sf_dir)
    nodes = hierarchy.build_hierarchy(units.select("path").distinct(), units)
    return hierarchy.leaves(nodes).select("node_id", "nodetype", "name")


# Summaries over documents


def _document_leaves(spark, sf_dir) -> DataFrame:
    """Documents with the metrics the summaries read: marked lines stand for TODO comments, words for expressions."""
    docs = spread(_documents(spark, sf_dir).select("doc_id", "lang", "source", "text", "n_chars"))
    words = F.regexp_count("text", F.lit("[^ \t\n\r]+"))
    return docs.select(
        "doc_id", "lang", "source", line_count(F.col("text")).alias("lines"), words.alias("expressions"),
        F.regexp_count("text", F.lit("[.]")).alias("statements"), _marked_lines(F.col("text")).alias("todo_comments"),
    )


def node_counts(spark, sf_dir):
    units = _conversation_units(spark, sf_dir)
    return summary.node_counts(hierarchy.build_hierarchy(units.select("path").distinct(), units))


def summary_expressions(spark, sf_dir):
    return _rounded(summary.expression_summary(_document_leaves(spark, sf_dir)), "mean")


def summary_lines(spark, sf_dir):
    stats = summary.line_summary(_document_leaves(spark, sf_dir))
    return _rounded(
        stats.withColumns({"mean_shown": shown(F.col("mean"), 1), "median_shown": shown(F.col("median"))}),
        "mean", "median", "p90",
    )


def summary_generic(spark, sf_dir):
    long = summary.unpivot_metrics(_document_leaves(spark, sf_dir), ["doc_id"], ["statements", "lines"])
    stats = _rounded(summary.generic_summary(long), "mean", "median", "p90", "total")
    return stats.withColumn("metric", label_text(F.col("metric")))


def summary_lineitem(spark, sf_dir):
    """The generic summary on the largest table, per return flag."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    long = summary.unpivot_metrics(items, ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"])
    stats = summary.generic_summary(long, ["l_returnflag"])
    return stats.withColumns({n: F.round(n, 4) for n in ("mean", "median", "p90", "total")})


def quantiles_lineitem(spark, sf_dir):
    """Exact quantiles of prices, nearly all of them different, per return flag."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    found = exact_quantiles(items, ["l_returnflag"], "l_extendedprice", CONTINUOUS_QUANTILES)
    return found.withColumn("quantile", F.round("quantile", 4))


def summary_events(spark, sf_dir):
    """The generic summary of a continuous column per event type."""
    return _rounded(
        summary.continuous_summary(table(spark, sf_dir, "events"), "value", ["event_type"]), "min", "max", "mean", "median", "p90", "total"
    )


def summary_dup_weighted(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    best = best_by_sketch(build_index(_document_texts(spark, sf_dir)))
    scored = document_units(documents).join(best.select("key", round3(F.col("score")).alias("duplication")), "key", "left")
    return _rounded(summary.duplication_summary(scored), "mean", "median", "p90", "duplicated_lines", "share")


def summary_ratio(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "lang")
    rated = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    stats = summary.coverage_summary(rated, ["lang"], "quality")
    return _rounded(stats, "mean", "median", "p90", "full_share")


def summary_markers(spark, sf_dir):
    return _rounded(summary.marker_summary(_document_leaves(spark, sf_dir)), "marked_share")


def group_summary(spark, sf_dir):
    stats = summary.line_summary(_document_leaves(spark, sf_dir), ["lang", "source"])
    return _rounded(stats, "mean", "median", "p90")


def metric_unpivot(spark, sf_dir):
    leaves = _document_leaves(spark, sf_dir)
    return summary.unpivot_metrics(leaves, ["doc_id"], ["lines", "expressions", "statements", "todo_comments"])


def metric_selected(spark, sf_dir):
    return summary.select_metric(metric_unpivot(spark, sf_dir), "todo_comments")


def metric_scaled(spark, sf_dir):
    leaves = _document_leaves(spark, sf_dir).select("doc_id", "lines")
    return _rounded(summary.scaled(leaves, "lines"), "scaled")


def unit_details(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    best = best_by_sketch(build_index(_document_texts(spark, sf_dir)))
    matches = stage(attach_matches(best, document_units(documents)), "matches")
    scores = matches.select(F.col("key").alias("doc_id"), round3(F.col("score")).alias("duplication"))
    leaves = _document_leaves(spark, sf_dir).select("doc_id", "lines", "todo_comments").join(scores, "doc_id", "left")
    long = summary.unpivot_metrics(leaves, ["doc_id"], ["lines", "todo_comments", "duplication"])
    return summary.unit_details(long, matches.select(F.col("key").alias("doc_id"), "other"), ["doc_id"])


def topk_units(spark, sf_dir):
    leaves = _document_leaves(spark, sf_dir).select("doc_id", "lines")
    return summary.top_units(leaves, "lines", 20, ["doc_id"])


# Source code, rendered from the documents


def _rendered(spark, sf_dir) -> DataFrame:
    return render_corpus(spread(_documents(spark, sf_dir).select("doc_id", "lang", "source", "text")))


def code_units(spark, sf_dir):
    units = Report(_rendered(spark, sf_dir)).units
    return units.select(
        "path", "nodetype", "name", "class_name", "qualname", "lineno", "end_lineno", "docstring",
        F.length("source").alias("source_chars"), F.md5("source").alias("source_md5"),
    )


def code_files(spark, sf_dir):
    files = _rendered(spark, sf_dir).select("path")
    return hierarchy.file_nodes(files).select("path", "parent_id", "name", "nodetype")


def code_metrics(spark, sf_dir):
    units = Report(_rendered(spark, sf_dir)).units.filter(F.col("nodetype") != "class")
    return units.select("path", "qualname", *[F.col(f"metrics.{n}").alias(n) for n in METRIC_NAMES])


def code_histogram(spark, sf_dir):
    counts = node_type_counts(Report(_rendered(spark, sf_dir)).units)
    return counts.filter(~F.startswith("node_type", F.lit("#"))).groupBy("node_type").agg(F.sum("n").alias("n"))


def bad_files(spark, sf_dir):
    """Errors of the rendered files when one in seven does not parse and one has a docstring that is no valid text."""
    kind = F.regexp_extract("path", r"doc_(\d+)\.py$", 1).cast("long") % 7
    spoilt = F.when(kind == 0, F.lit("def broken(:\n")).when(kind == 1, F.lit('def odd():\n    "\\ud800"\n')).otherwise(F.lit(""))
    files = _rendered(spark, sf_dir).select("path", F.concat(spoilt, "content").alias("content"))
    return Report(files).errors.select("path", "stage")


def text_ratio(spark, sf_dir):
    """Exact ratio of each whole text and a copy with one more character: the longest block is the text itself."""
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("source"))
    own = docs.select((2 * F.col("doc_id")).alias("text_id"), "source")
    longer = docs.select((2 * F.col("doc_id") + 1).alias("text_id"), F.concat("source", F.lit("\x01")).alias("source"))
    pairs = docs.select(
        (2 * F.col("doc_id")).alias("ta"), (2 * F.col("doc_id") + 1).alias("tb"), F.col("doc_id").alias("a"),
        F.col("doc_id").alias("b"), F.lit(True).alias("forward"), F.lit(False).alias("backward"),
    )
    return score_pairs(pairs, own.unionByName(longer)).select(F.col("a").alias("doc_id"), _r6(F.col("r_forward"), "ratio"))


def _code_leaves(spark, sf_dir) -> DataFrame:
    return Report(_rendered(spark, sf_dir), duplication=False).leaves()


def code_type_coverage(spark, sf_dir):
    return _rounded(summary.coverage_summary(_code_leaves(spark, sf_dir)), "mean", "median", "p90", "full_share")


def code_summary(spark, sf_dir):
    long = summary.unpivot_metrics(_code_leaves(spark, sf_dir), ["node_id"], list(METRIC_NAMES))
    return _rounded(summary.generic_summary(long), "mean", "median", "p90", "total")


def code_weights(spark, sf_dir):
    report = Report(_rendered(spark, sf_dir), duplication=False)
    return _rounded(report.weights.select("node_id", "parent_id", "weight"), "weight")


def code_neardup(spark, sf_dir):
    """Each function's nearest copy by the sketch of its source tokens."""
    functions = Report(_rendered(spark, sf_dir)).units.filter(F.col("nodetype") != "class")
    best = best_by_sketch(build_index(functions.select("key", "tokens")))
    return best.select(
        "key.path", "key.lineno", _r6(F.col("score"), "score"), F.col("partner.path").alias("other_path"),
        F.col("partner.lineno").alias("other_lineno"),
    )


def code_duplication(spark, sf_dir):
    """The full duplication pass on code: sketch gate, exact text ratio, best partner of each function."""
    matches = Report(_rendered(spark, sf_dir)).matches
    return matches.select(
        "key.path", "key.lineno", "score", F.col("other_id.path").alias("other_path"),
        F.col("other_id.lineno").alias("other_lineno"), "other", "lines_other",
    )


def report_roundtrip(spark, sf_dir):
    """Write the nested report of the rendered code, read it back, and list what it holds."""
    report = Report(_rendered(spark, sf_dir), duplication=False)
    path = stage_path(spark, "report")
    report.write(path)
    nodes, _ = read_report(spark, path)
    return nodes.select(
        "node_id", "parent_id", "nodetype", "name", "qualname", "lineno", "end_lineno", "docstring",
        F.md5("source").alias("source_md5"), *[F.col(f"metrics.{n}").alias(n) for n in METRIC_NAMES],
    )


QUERIES = {
    f.__name__: f
    for f in (
        unit_lines_tokens, marker_counts, line_slice, qualified_names, shingle_sketch, neardup_pairs, neardup_groups, neardup_links, neardup_partners, neardup_best,
        neardup_pages, neardup_merged, neardup_scored, neardup_extended, scan_files, scan_plan, scan_errors, scan_dedup_ignore, path_ancestors, dir_nodes, node_predicates,
        prune_root, subtree_nodes, subtree_weight, sibling_rank, leaf_units, node_counts, summary_expressions,
        summary_lines, summary_generic, summary_lineitem, quantiles_lineitem, summary_events, summary_dup_weighted, summary_ratio, summary_markers,
        group_summary, metric_unpivot, metric_selected, metric_scaled, unit_details, topk_units, code_units, code_files,
        code_metrics, code_histogram, bad_files, text_ratio, code_type_coverage, code_summary, code_weights, code_neardup, code_duplication, report_roundtrip,
    )
}
