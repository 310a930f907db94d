"""Cross references of symbols: several ways of finding them merged into one list, and the links within it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import relations

# The ways in which a reference is found, the first of which counts for a place; call sites upgrade what is there.
MATCH_TYPES = ["semantic", "exact_symbol", "import_search", "call_site"]


def merged(matches: DataFrame) -> DataFrame:
    """One row per symbol_name, collection, rel_path and start_line of ``matches`` (these, match_type, score, reference_type).

    Of several match types of a place the first counts (semantic, exact_symbol, import_search), with its score; a call
    site makes it a call_site with score 1 and reference type call_site, or adds it. Equal types count with their greatest score. Rows of a type that is
    not known are left out; null paths and lines are places like others.
    """
    keys = ["symbol_name", "collection", "rel_path", "start_line"]
    order = F.array_position(F.array(*map(F.lit, MATCH_TYPES)), F.col("match_type"))
    rows = matches.where(F.col("match_type").isin(MATCH_TYPES)).select(*keys, F.struct(order.alias("order"), (-F.col("score")).alias("less"), "match_type", "reference_type").alias("m"))
    best = rows.groupBy(*keys).agg(F.min("m").alias("m"), F.bool_or(F.col("m.match_type") == "call_site").alias("called"))
    pick = lambda upgraded, other: F.when(F.col("called"), F.lit(upgraded)).otherwise(other)
    return best.select(*keys, pick("call_site", F.col("m.match_type")).alias("match_type"), pick(1.0, -F.col("m.less")).alias("score"), pick("call_site", F.col("m.reference_type")).alias("reference_type"))


def links(found: DataFrame) -> DataFrame:
    """symbol_name, kind, from_collection, from_path, to_collection, to_path, paths: what the references of a lookup have to do with each other.

    ``found``: merged references with ``content`` and ``own_symbol`` (what the chunk defines). code_dependency: a call site of the looked-up symbol
    to its definition; http_dependency: a call or configuration of another collection to the endpoint whose path it
    names (``paths``: the pairs that match); code_dependency also: a usage or import in another collection whose text holds the symbol that is defined.
    Two files of two collections have one link a lookup, the first of these. Definitions, callers and endpoints meet by
    the lookup's symbol, so pairs arise within one lookup's result only.
    """
    side = lambda kinds, name, *more: found.where(F.col("reference_type").isin(kinds)).select("symbol_name", F.col("collection").alias(f"{name}_collection"), F.col("rel_path").alias(f"{name}_path"), *more)
    defined = side(["definition"], "to", F.coalesce("own_symbol", F.lit("")).alias("own")).distinct()
    none = F.array().cast("array<string>").alias("paths")
    columns = ["symbol_name", "from_collection", "from_path", "to_collection", "to_path"]
    named = defined.where((F.col("own") == "") | (F.col("own") == F.col("symbol_name")))
    calls = side(["call_site"], "from").distinct().join(named, "symbol_name").select(*columns, F.lit(0).alias("order"), F.lit("code_dependency").alias("kind"), none)
    urls = F.when(F.col("reference_type") == "http_call", text.code_urls(F.col("content"))).otherwise(text.config_urls(F.col("content"))["paths"])
    callers = side(["http_call", "service_config"], "from", F.explode(urls).alias("caller"))
    endpoints = side(["endpoint_definition"], "to", F.explode(text.route_paths(F.col("content"), F.col("rel_path"))).alias("endpoint"))
    matched = relations.matching_paths(
        callers.select(F.col("from_collection").alias("collection"), F.col("caller").alias("path")), endpoints.select(F.col("to_collection").alias("collection"), F.col("endpoint").alias("path"))
    ).select(F.col("caller_collection").alias("from_collection"), "caller", F.col("endpoint_collection").alias("to_collection"), "endpoint")
    http = callers.join(matched, ["from_collection", "caller"]).join(endpoints, ["symbol_name", "to_collection", "endpoint"])
    http = http.groupBy(*columns).agg(F.array_sort(F.collect_set(F.concat_ws(" → ", "caller", "endpoint"))).alias("paths")).select(*columns, F.lit(1).alias("order"), F.lit("http_dependency").alias("kind"), "paths")
    uses = side(["usage", "import"], "from", "content").join(defined, "symbol_name").where(F.col("from_collection") != F.col("to_collection"))
    uses = uses.where((F.col("own") == "") | F.contains("content", F.col("own"))).select(*columns, F.lit(2).alias("order"), F.lit("code_dependency").alias("kind"), none)
    rows = calls.unionByName(http).unionByName(uses).groupBy(*columns).agg(F.min(F.struct("order", "kind", "paths")).alias("l"))
    return rows.select("symbol_name", "l.kind", *columns[1:], "l.paths")


def routed_callers(by_graph: DataFrame, by_calls: DataFrame, flags: DataFrame) -> DataFrame:
    """Callers from the graph in the collections whose flag graph_call_sites is set, from the chunks' own call lists in the others.

    ``by_graph`` and ``by_calls`` have ``collection`` and the same other columns; ``flags``: collection, graph_call_sites. A collection without flags has none set.
    """
    on = flags.where("graph_call_sites").select("collection").distinct()
    return by_graph.join(on, "collection", "left_semi").unionByName(by_calls.join(on, "collection", "left_anti"))
