"""Relations between chunks, files and collections: definitions, calls, paths, dependencies, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import chunking
from skein.operators.search import top_per
from skein.session import cut


def calls(chunks: DataFrame) -> DataFrame:
    """point_id, collection, rel_path, token of everything each chunk calls, once each."""
    return chunks.select("point_id", "collection", "rel_path", F.explode(text.callees(F.col("content"))).alias("token"))


def definitions(chunks: DataFrame) -> DataFrame:
    """collection, rel_path, symbol_name, once each; blank names define nothing."""
    return chunks.where(F.length("symbol_name") > 0).select("collection", "rel_path", "symbol_name").distinct()


def resolve_calls(call_sites: DataFrame, defined: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """``call_sites`` with target: the definition that a token means within its collection.

    A name defined once; else the method of ``receiver.method`` defined once; else, with ``imports`` (collection,
    rel_path, name), the one definition of the method whose place holds the imported receiver; else a callee node.
    """
    call_sites = cut(call_sites)  # used three times, and finding calls in texts is what costs most
    named = defined.select("collection", F.col("symbol_name").alias("name"), text.symbol_key(F.col("collection"), F.col("rel_path"), F.col("symbol_name")).alias("target"))
    single = named.groupBy("collection", "name").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    method = F.when(F.col("token").contains("."), F.substring_index("token", ".", -1))
    tokens = call_sites.select("collection", "token").distinct().withColumn("method", method)
    exact = single.withColumnsRenamed({"name": "token", "target": "exact"})
    by_method = single.withColumnsRenamed({"name": "method", "target": "by_method"})
    known = tokens.join(exact, ["collection", "token"], "left").join(by_method, ["collection", "method"], "left")
    known = known.select("collection", "token", F.coalesce("exact", "by_method").alias("known"))
    sites = call_sites.join(known, ["collection", "token"])
    imported = F.lit(None).cast("string")
    if imports is not None:
        receiver = F.expr("substring(token, 1, length(token) - length(substring_index(token, '.', -1)) - 1)")
        open_sites = sites.where(F.col("known").isNull() & F.col("token").contains(".")).withColumn("receiver", F.lower(receiver)).withColumn("method", method)
        names = imports.select("collection", "rel_path", F.lower("name").alias("receiver")).distinct()
        found = open_sites.join(names, ["collection", "rel_path", "receiver"]).join(named.withColumnRenamed("name", "method"), ["collection", "method"])
        found = found.where(F.contains(F.lower("target"), F.col("receiver"))).groupBy("point_id", "token").agg(F.count_distinct("target").alias("n"), F.min("target").alias("imported")).where("n = 1").drop("n")
        sites, imported = sites.join(found, ["point_id", "token"], "left"), F.col("imported")
    return sites.select("point_id", "collection", "rel_path", "token", F.coalesce("known", imported, text.callee_key(F.col("collection"), F.col("token"))).alias("target"))


def sub_paths(path: Column) -> Column:
    """Every run of two segments or more of a path."""
    parts = F.split(path, "/")
    n = F.size(parts)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(2), F.greatest(n - i + 1, F.lit(2))), lambda m: F.when(i + m - 1 <= n, F.array_join(F.slice(parts, i, m), "/"))))
    return F.filter(F.array_distinct(F.flatten(runs)), lambda x: x.isNotNull())


def matching_paths(callers: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Pairs of a caller's and an endpoint's path (collection, path) of different collections, one of which holds the other.

    Instead of comparing all pairs, every run of segments of the longer path is a key that the shorter one is looked up by.
    """
    norm = lambda df, name: df.select(F.col("collection").alias(f"{name}_collection"), F.col("path").alias(name), text.normal_path(F.col("path")).alias(f"{name}_norm")).where(F.col(f"{name}_norm").contains("/")).distinct()
    a, b = norm(callers, "caller"), norm(endpoints, "endpoint")
    down = a.withColumn("run", F.explode(sub_paths(F.col("caller_norm")))).join(b, F.col("run") == F.col("endpoint_norm"))
    up = b.withColumn("run", F.explode(sub_paths(F.col("endpoint_norm")))).join(a, F.col("run") == F.col("caller_norm"))
    columns = ["caller_collection", "caller", "endpoint_collection", "endpoint"]
    return down.select(*columns).unionByName(up.select(*columns)).where(F.col("caller_collection") != F.col("endpoint_collection")).distinct()


def match_dependencies(deps: DataFrame, collections: DataFrame) -> DataFrame:
    """artifact, group, collection, confidence of dependencies that a collection (of its own set) stands for.

    ``exact``: artifact or group has the collection's normal name; ``fuzzy``: artifact, else group, of four characters or
    more holds it or is held by it. Each artifact and collection once, the dependency's own collection (``self``) never.
    Names are looked up in each other by their parts, not pair by pair.
    """
    names = collections.select("collection").distinct().select("collection", text.normal_name(F.col("collection")).alias("c")).where(F.length("c") > 0)
    rows = deps.select("artifact", F.coalesce("self", F.lit("")).alias("self"), F.array(text.normal_name(F.col("artifact")), text.normal_name(F.coalesce("group", F.lit("")))).alias("both"))
    rows = rows.select("artifact", "self", F.explode("both").alias("x")).where(F.length("x") > 0).distinct()
    asked = rows.select("x").distinct()
    equal = asked.join(names, F.col("x") == F.col("c")).select("x", "c", F.lit("exact").alias("confidence"))
    long = asked.where(F.length("x") >= 4)
    inside = contained(long.select(F.col("x").alias("text")), names.select(F.col("c").alias("name"))).select(F.col("text").alias("x"), F.col("name").alias("c"), F.lit("fuzzy").alias("confidence"))
    around = contained(names.select(F.col("c").alias("text")), long.select(F.col("x").alias("name"))).select(F.col("name").alias("x"), F.col("text").alias("c"), F.lit("fuzzy").alias("confidence"))
    near = equal.unionByName(inside).unionByName(around).groupBy("x", "c").agg(F.min("confidence").alias("confidence"))
    found = rows.join(near, "x").join(names, "c").where(F.col("collection") != F.col("self"))
    return found.groupBy("artifact", "collection").agg(F.min("confidence").alias("confidence"))


def shared_symbols(chunks: DataFrame) -> DataFrame:
    """symbol_name, collections (how many), names of the symbols that two collections or more define."""
    pairs = chunks.where(F.length("symbol_name") > 0).select("symbol_name", "collection").distinct()
    return pairs.groupBy("symbol_name").agg(F.count("*").alias("collections"), F.array_join(F.array_sort(F.collect_list("collection")), ",").alias("names")).where("collections >= 2")


def symbol_locations(chunks: DataFrame) -> DataFrame:
    """symbol_name, collection, rel_path, reference_type of the symbols of two collections or more, once each."""
    kind = text.reference_type(F.col("content"), F.col("symbol_name"), F.lit(""))
    return chunks.join(shared_symbols(chunks).select("symbol_name"), "symbol_name", "left_semi").select("symbol_name", "collection", "rel_path", kind.alias("reference_type")).distinct()


def find_symbols(chunks: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """Per symbol and collection the first ``most`` chunks that define it, by path and line."""
    rows = chunks.join(symbols.select("symbol_name").distinct(), "symbol_name", "left_semi")
    return top_per(rows.select("symbol_name", "collection", "rel_path", "start_line", "point_id"), ["symbol_name", "collection"], [F.col("rel_path"), F.col("start_line"), F.col("point_id")], most)


def find_callers(call_sites: DataFrame, symbols: DataFrame, most: int = 10) -> DataFrame:
    """Per symbol and collection the first ``most`` chunks that call it."""
    wanted = symbols.select(F.col("symbol_name").alias("token")).distinct()
    return top_per(call_sites.join(wanted, "token", "left_semi").select("token", "collection", "rel_path", "point_id"), ["token", "collection"], [F.col("rel_path"), F.col("point_id")], most)


def cross_references(chunks: DataFrame, call_sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Where each symbol occurs: definitions and call sites, one row per symbol, collection, path and line.

    A call site upgrades a row that is there already: match_type call_site, score 1.
    """
    defined = chunks.join(symbols.select("symbol_name").distinct(), "symbol_name", "left_semi").select("symbol_name", "collection", "rel_path", "start_line", F.lit("exact_symbol").alias("match_type"), F.lit(0.9).alias("score"), F.lit(1).alias("order"))
    place = chunks.select("point_id", "start_line")
    called = call_sites.join(symbols.select(F.col("symbol_name").alias("token")).distinct(), "token", "left_semi").join(place, "point_id")
    called = called.select(F.col("token").alias("symbol_name"), "collection", "rel_path", "start_line", F.lit("call_site").alias("match_type"), F.lit(1.0).alias("score"), F.lit(0).alias("order"))
    rows = defined.unionByName(called)
    best = rows.groupBy("symbol_name", "collection", "rel_path", "start_line").agg(F.min(F.struct("order", "match_type", "score")).alias("best"))
    return best.select("symbol_name", "collection", "rel_path", "start_line", "best.match_type", "best.score")


def _holding(texts: DataFrame, names: DataFrame, sizes: list[int], longest: int) -> DataFrame:
    """symbol_name, collection of the names (symbol_name, size, key: its first ``size`` characters) that a text (collection, t) holds.

    Every place of a text is looked up by its next characters, as many as the sizes say: an equi-join whatever the number of names.
    """
    step = 1_024  # long texts are cut first, with overlaps: a place in the middle of a string is found from its start
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / step)), lambda i: F.substr("t", (i * step + 1).cast("int"), F.lit(step + longest - 1)))
    rows = texts.where(F.length("t") > 0).select("collection", F.explode(pieces).alias("t"))
    rows = rows.select("collection", F.explode(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.substr("t", i, F.lit(longest)))).alias("t"))
    keys = F.array(*[F.struct(F.lit(n).alias("size"), F.substring("t", 1, n).alias("key"), F.substring("t", 1, 2 * n - 1).alias("t")) for n in sizes])
    rows = rows.select("collection", F.explode(keys).alias("k")).select("collection", "k.*").where(F.length("key") == F.col("size"))
    return rows.join(names, ["size", "key"]).where(F.startswith("t", F.col("symbol_name"))).select("symbol_name", "collection").distinct()


def contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, name of all pairs in which a short text (text) holds a name (name); equal ones too, empty ones never.

    Every part of a text is a key that names are looked up by: an equi-join. Meant for names, whose parts are few.
    """
    n = F.length("text")
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda size: F.substr("text", i, size)))
    rows = texts.where(n > 0).select("text").distinct().select("text", F.explode(F.array_distinct(F.flatten(parts))).alias("name"))
    return rows.join(names.select("name").distinct(), "name").select("text", "name")


def usages(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_name, defined_in, used_in: collections whose chunks mention a symbol that another collection defines.

    A mention is a part of the content, also of a longer word. ``symbols`` may be of any number; blank ones define nothing.
    """
    wanted = symbols.where(F.length("symbol_name") > 0).select("symbol_name").distinct()
    homes = cut(chunks.select("symbol_name", F.col("collection").alias("defined_in")).distinct().join(wanted, "symbol_name", "left_semi"))
    size = F.pow(F.lit(2), F.floor(F.log2(F.length("symbol_name") + 0.5))).cast("int")  # the power of two that its length reaches
    names = homes.select("symbol_name").distinct().withColumn("size", size).withColumn("key", F.expr("substring(symbol_name, 1, size)")).withColumn("word", F.col("symbol_name").rlike("^[A-Za-z0-9_]+$"))
    kinds = {r.word: r for r in names.groupBy("word").agg(F.sort_array(F.collect_set("size")).alias("sizes"), F.max(F.length("symbol_name")).alias("longest")).collect()}
    texts = chunks.select("collection", F.col("content").alias("t"))
    words = texts.select("collection", F.explode(F.array_distinct(F.split("t", "[^A-Za-z0-9_]+"))).alias("t")).distinct()  # pre-aggregated: a collection's words
    found = homes.select("symbol_name", F.col("defined_in").alias("collection")).limit(0)
    for word, rows in ((True, words), (False, texts)):
        if word in kinds:
            found = found.union(_holding(rows, names.where(F.col("word") == word).drop("word"), kinds[word].sizes, kinds[word].longest))
    return homes.join(found.withColumnRenamed("collection", "used_in"), "symbol_name").where(F.col("defined_in") != F.col("used_in"))


def service_edges(call_sites: DataFrame, defined: DataFrame) -> DataFrame:
    """from, to, tokens: calls of names that exactly one other collection defines and the caller's own does not."""
    homes = defined.select("symbol_name", "collection").distinct().groupBy("symbol_name").agg(F.count("*").alias("n"), F.min("collection").alias("to")).where("n = 1").select(F.col("symbol_name").alias("token"), "to")
    used = call_sites.select("collection", "token").distinct()  # pre-aggregated: one row per collection and token
    return used.join(homes, "token").where(F.col("collection") != F.col("to")).groupBy(F.col("collection").alias("from"), "to").agg(F.count("*").alias("tokens"))


def adjacency(edges: DataFrame) -> DataFrame:
    """service, calls, called_by: sorted names, comma-joined; services are few."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = edges.groupBy(F.col("from").alias("service")).agg(names("to").alias("calls"))
    into = edges.groupBy(F.col("to").alias("service")).agg(names("from").alias("called_by"))
    return out.join(into, "service", "full").na.fill("", ["calls", "called_by"])


def collection_summary(chunks: DataFrame) -> DataFrame:
    """collection, files, chunks, symbols, languages per collection."""
    files = chunks.select("collection", "rel_path", "language").groupBy("collection", "rel_path").agg(F.count("*").alias("chunks"), F.min("language").alias("language"))
    symbols = chunks.where(F.length("symbol_name") > 0).select("collection", "symbol_name").distinct().groupBy("collection").agg(F.count("*").alias("symbols"))
    out = files.groupBy("collection").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.count_distinct("language").alias("languages"))
    return out.join(symbols, "collection", "left").na.fill(0, ["symbols"])


def merged_files(chunks: DataFrame) -> DataFrame:
    """collection, rel_path, content: a file's chunk contents in line order, each after a line feed."""
    parts = F.array_sort(F.collect_list(F.struct("start_line", "point_id", F.coalesce("content", F.lit("")).alias("content"))))
    return chunks.groupBy("collection", "rel_path").agg(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("\n"), p["content"])), "").alias("content"))


def call_imports(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """collection, rel_path, name of what the files of ``chunks`` import, for resolve_calls.

    Read from ``files`` (collection, path, language, content); a file that is not there is put together from its chunks.
    """
    rest = chunks if files is None else chunks.join(files.select("collection", F.col("path").alias("rel_path")).distinct(), ["collection", "rel_path"], "left_anti")
    languages = rest.groupBy("collection", "rel_path").agg(F.min("language").alias("language"))
    whole = merged_files(rest).join(languages, ["collection", "rel_path"]).select("collection", F.col("rel_path").alias("path"), "language", "content")
    if files is not None:
        whole = whole.unionByName(files.select("collection", "path", "language", "content"))
    return chunking.file_imports(whole).withColumnRenamed("path", "rel_path")
