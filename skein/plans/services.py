"""Queries of services' routes, calls, configurations and build files, over texts written from the names of the collections.

The tables hold no such texts. Every collection of index_runs therefore stands for a service that calls, configures, uses and builds on the
one after it by name; what the operators read out of these texts must be what was written into them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import chunking, dependencies, graph, references, relations
from skein.session import table

# The texts, by path; {me} is the service, {next} the one after it, {Me} and {Next} the same as names of types.
TEXTS = {
    "src/Client.java": ("java", "package a;\nimport com.example.{Next};\npublic class {Me} {{\n}}\n"),
    "src/{Me}Controller.cs": ("csharp", '[HttpGet("api/{me}/items")]\npublic object Items() => null;\n[Route("/{me}/[controller]")]\n'),
    "src/routes.js": ("javascript", "router.post('/{me}/orders', handler);\n"),
    "src/Handler.java": ("java", '@GetMapping("/{me}/status")\npublic String status() {{ return ""; }}\n'),
    "src/Caller.java": ("java", 'Object o = WebClient.create().uri("/api/{next}/items").retrieve();\n'),
    "config/app.yaml": ("yaml", "target: /api/{next}/items\nbase_url: https://{next}.example/x\n"),
    "src/use.py": ("python", "value = {Next}()\n"),
    "package.json": ("json", '{{"name": "{me}", "dependencies": {{"{next}-client": "^1"}}, "devDependencies": {{"left": "2"}}}}'),
    "pom.xml": ("xml", "<project><parent><groupId>g</groupId><artifactId>{me}-parent</artifactId><version>1</version></parent><dependencies><dependency><groupId>com.{next}</groupId><artifactId>{next}-api</artifactId><scope>test</scope></dependency></dependencies></project>"),
    "{Me}.csproj": ("xml", '<Project><ItemGroup><PackageReference Include="{next}.Core" Version="3" /><ProjectReference Include="..\\{Next}\\{Next}.csproj" /></ItemGroup></Project>'),
    "build.gradle": ("groovy", "dependencies {{\n  implementation 'com.{next}:{next}-lib:4'\n  api project(':{me}-part')\n}}\n"),
    "go.mod": ("go", "module x/{me}\n\nrequire (\n\tx/{next} v1.2.3 // indirect\n)\nrequire y/z v2\n"),
    "Cargo.toml": ("toml", '[dependencies]\n"{next}" = {{ version = "5" }}\n[dev-dependencies]\nprobe = "6"\n'),
    "requirements.txt": ("python", "# tools\n{next}-tools>=7\n-r other.txt\n"),
}


def _type_name(name):
    return F.replace(F.initcap(F.regexp_replace(name, "[^A-Za-z0-9]+", " ")), F.lit(" "), F.lit(""))


def service_chunks(spark, d) -> DataFrame:
    """point_id, chunk_id, collection, rel_path, path, language, content, start_line: one chunk a text and service; services are few, one row a collection."""
    names = table(spark, d, "index_runs").where(F.col("collection").isNotNull()).select(F.col("collection").alias("me")).distinct()
    order = W.partitionBy(F.lit(1)).orderBy("me")
    first = F.first("me").over(order)
    rows = names.select("me", F.row_number().over(order).alias("n"), F.coalesce(F.lead("me").over(order), first).alias("next"))
    rows = rows.select("*", _type_name(F.col("me")).alias("Me_"), _type_name(F.col("next")).alias("Next_"))

    def written(template: str):
        out = F.lit(template.replace("{{", "\0").replace("}}", "\1"))
        for mark, column in (("{me}", "me"), ("{next}", "next"), ("{Me}", "Me_"), ("{Next}", "Next_")):
            out = F.replace(out, F.lit(mark), F.col(column))
        return F.replace(F.replace(out, F.lit("\0"), F.lit("{")), F.lit("\1"), F.lit("}"))

    texts = F.array(*[F.struct(F.lit(i).alias("i"), written(p).alias("path"), F.lit(language).alias("language"), written(t).alias("content")) for i, (p, (language, t)) in enumerate(TEXTS.items())])
    rows = rows.select("n", F.col("me").alias("collection"), F.explode(texts).alias("t")).select("n", "collection", "t.*")
    key = (F.col("n") * len(TEXTS) + F.col("i")).cast("bigint")
    return rows.select(key.alias("point_id"), F.concat_ws("/", "collection", "path").alias("chunk_id"), "collection", F.col("path").alias("rel_path"), "path", "language", "content", F.lit(1).alias("start_line"))


def declared_routes(spark, d):
    return service_chunks(spark, d).select("collection", F.explode(text.route_paths(F.col("content"), F.col("path"))).alias("route"), text.http_verb(F.col("content")).alias("verb"))


def called_urls(spark, d):
    """Paths in code, paths and addresses in configuration."""
    rows, found = service_chunks(spark, d), text.config_urls(F.col("content"))
    config = rows.where(F.col("path").rlike(text.CONFIG_FILE) & F.col("path").startswith("config/"))
    parts = [rows.where(F.col("path") == "src/Caller.java").select("collection", F.lit("code").alias("kind"), F.explode(text.code_urls(F.col("content"))).alias("url"))]
    parts += [config.select("collection", F.lit(kind), F.explode(found[kind])) for kind in ("paths", "base_urls")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()  # several patterns may find one path


def parsed_manifests(spark, d):
    return dependencies.dependencies(service_chunks(spark, d).select("collection", "path", "content"))


def parsed_imports(spark, d):
    return chunking.file_imports(service_chunks(spark, d).select("collection", "path", "language", "content"))


def typed_edges(spark, d):
    """All families of edges between services."""
    rows = service_chunks(spark, d)
    deps = dependencies.dependencies(rows.select("collection", "path", "content").where("path = 'package.json'"))
    edges = graph.service_edges(rows.where("path <> 'package.json'"), chunking.file_imports(rows.select("collection", "path", "language", "content")), deps, rows.select("collection").distinct())
    return edges.where("type <> 'RESOLVES_TO'").select("type", "src", "dst")


def service_links(spark, d):
    """Links between the references of one lookup that finds every text of the services' sources."""
    rows = service_chunks(spark, d).where("path in ('src/Client.java', 'src/Caller.java', 'src/use.py') or path like 'src/%Controller.cs'")
    kind = text.reference_type(F.col("content"), F.regexp_extract("content", r"class (\w+)", 1), F.col("path"))
    found = rows.select(F.lit("lookup").alias("symbol_name"), "collection", "rel_path", kind.alias("reference_type"), "content", F.regexp_extract("content", r"class (\w+)", 1).alias("own_symbol"))
    return references.links(found).select("kind", "from_collection", "from_path", "to_collection", "to_path", F.array_join("paths", ",").alias("paths"))


def service_calls(spark, d):
    """Which service's calls and configurations lead to which other's endpoints."""
    rows = service_chunks(spark, d)
    routes = rows.select("collection", F.explode(text.route_paths(F.col("content"), F.col("path"))).alias("path"))
    called = rows.where("path = 'src/Caller.java'").select("collection", F.explode(text.code_urls(F.col("content"))).alias("path"))
    configured = rows.where("path = 'config/app.yaml'").select("collection", F.explode(text.config_urls(F.col("content"))["paths"]).alias("path"))
    pair = lambda df, kind: relations.matching_paths(df, routes).select(F.col("caller_collection").alias("from"), F.col("endpoint_collection").alias("to"), F.lit(kind).alias("kind")).distinct()
    return pair(called, "http_call").unionByName(pair(configured, "service_config"))


QUERIES = {f.__name__: f for f in (declared_routes, called_urls, parsed_manifests, parsed_imports, typed_edges, service_links, service_calls)}

_NAME = "array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), '')"
S = f"""WITH n AS (SELECT me, coalesce(lead(me) OVER (ORDER BY me), first(me) OVER (ORDER BY me)) AS next FROM (SELECT DISTINCT collection AS me FROM index_runs WHERE collection IS NOT NULL)),
s AS (SELECT *, {_NAME.format(x='me')} AS Me_, {_NAME.format(x='next')} AS Next_ FROM n)
"""


def _union(rows: list[str]) -> str:
    return S + " UNION ALL ".join(f"SELECT {r} FROM s" for r in rows)


SQL = {
    "declared_routes": _union(["me AS collection, 'api/' || me || '/items' AS route, 'GET' AS verb", "me, me || '/' || lower(Me_), 'GET'", "me, me || '/orders', 'POST'", "me, me || '/status', 'GET'"]).replace("me || '/' || lower(Me_), 'GET'", "me || '/' || lower(Me_), ''").replace("'GET' AS verb", "'' AS verb"),
    "called_urls": _union(["me AS collection, 'code' AS kind, 'api/' || next || '/items' AS url", "me, 'paths', 'api/' || next || '/items'", "me, 'base_urls', 'https://' || next || '.example/x'"]),
    "parsed_manifests": _union(
        [
            "me AS collection, 'package.json' AS path, next || '-client' AS artifact, '' AS \"group\", '^1' AS version, 'dependencies' AS scope, 'npm' AS ecosystem", "me, 'package.json', 'left', '', '2', 'devDependencies', 'npm'",
            "me, 'pom.xml', next || '-api', 'com.' || next, '', 'test', 'maven'", "me, 'pom.xml', me || '-parent', 'g', '1', 'parent', 'maven'", "me, Me_ || '.csproj', next || '.Core', '', '3', '', 'nuget'", "me, Me_ || '.csproj', Next_, '', '', 'project', 'nuget'",
            "me, 'build.gradle', next || '-lib', 'com.' || next, '4', '', 'gradle'", "me, 'build.gradle', me || '-part', '', '', 'project', 'gradle'", "me, 'go.mod', next, 'x/' || next, 'v1.2.3', '', 'go'", "me, 'go.mod', 'z', 'y/z', 'v2', '', 'go'",
            "me, 'Cargo.toml', next, '', '5', '', 'cargo'", "me, 'Cargo.toml', 'probe', '', '6', 'dev', 'cargo'", "me, 'requirements.txt', next || '-tools', '', '', '', 'python'",
        ]
    ),
    "parsed_imports": _union(["me AS collection, 'src/Client.java' AS path, Next_ AS name"]),
    "typed_edges": _union(
        [
            "'IMPORTS' AS type, me || ':src/Client.java' AS src, me || '::import::' || Next_ AS dst", "'DECLARES_ENDPOINT', me || '/src/' || Me_ || 'Controller.cs', 'api/' || me || '/items'", "'DECLARES_ENDPOINT', me || '/src/' || Me_ || 'Controller.cs', me || '/' || lower(Me_)",
            "'DECLARES_ENDPOINT', me || '/src/routes.js', me || '/orders'", "'DECLARES_ENDPOINT', me || '/src/Handler.java', me || '/status'", "'HTTP_CALLS', me || '/src/Caller.java', 'api/' || next || '/items'", "'CONFIGURES', me || '/config/app.yaml', 'api/' || next || '/items'",
            "'BUILD_DEPENDS', me || ':package.json', 'npm:' || next || '-client'", "'BUILD_DEPENDS', me || ':package.json', 'npm:left'",
        ]
    ),
    "service_links": _union(["'http_dependency' AS kind, me AS from_collection, 'src/Caller.java' AS from_path, next AS to_collection, 'src/' || Next_ || 'Controller.cs' AS to_path, 'api/' || next || '/items → api/' || next || '/items' AS paths", "'code_dependency', me, 'src/use.py', next, 'src/Client.java', ''"]),
    "service_calls": _union(["me AS \"from\", next AS \"to\", 'http_call' AS kind", "me, next, 'service_config'"]),
}
