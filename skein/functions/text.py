"""Scalar functions over text, as column expressions that stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of the term weight.
BM25_K, BM25_B, AVERAGE_LENGTH, LONGEST_TOKEN = 1.2, 0.75, 256.0, 40
# Words that stand before a parenthesis without being called.
NOT_CALLED = ["if", "for", "while", "switch", "catch", "return", "new", "synchronized", "super", "this", "do", "else", "try"]
# First segments of service paths.
URL_KEYWORDS = "rest api profile service internal public gateway graphql webhook auth users accounts".split()
# Suffixes that do not tell artifacts apart, in the order in which they are tried.
NAME_SUFFIXES = "-definitions -definition -api -apis -client -clients -core -commons -common -lib -library -impl -implementation -service -services -server -starter".split()
# Names of build manifests, and suffixes of others.
MANIFESTS = "pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts package.json go.mod Cargo.toml pyproject.toml requirements.txt setup.cfg".split()
MANIFEST_SUFFIXES = [".csproj", ".fsproj", ".vbproj", ".nuspec"]
# Folders that no scan enters.
EXCLUDED = "node_modules .git __pycache__ .venv .venv-bench .venv-train venv dist build target bin obj .gradle .mypy_cache .pytest_cache .ruff_cache .idea .vscode migrations".split()
# Languages by file suffix and by file name.
SUFFIX_LANGUAGES = {
    "python": [".py"], "javascript": [".js", ".jsx"], "typescript": [".ts", ".tsx"], "go": [".go"], "rust": [".rs"], "java": [".java"], "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp"], "csharp": [".cs"], "sql": [".sql"], "xml": [".xml", ".xsd", ".xsl", ".xslt", ".wsdl", ".csproj", ".fsproj", ".vbproj", ".nuspec"],
    "yaml": [".yml", ".yaml"], "json": [".json"], "properties": [".properties", ".ini", ".cfg"], "toml": [".toml"], "hcl": [".tf", ".hcl"], "dockerfile": [".dockerfile"],
    "groovy": [".groovy", ".gvy", ".gradle"], "protobuf": [".proto"], "kotlin": [".kt", ".kts"], "scala": [".scala"], "ruby": [".rb"], "php": [".php"], "swift": [".swift"],
    "dart": [".dart"], "bash": [".sh", ".bash"], "powershell": [".ps1"], "markdown": [".md"],
}
NAME_LANGUAGES = {
    "Dockerfile": "dockerfile", "Jenkinsfile": "groovy", "docker-compose.yml": "yaml", "docker-compose.yaml": "yaml", ".env.example": "properties", ".env.local": "properties",
    ".env": "properties", "build.gradle.kts": "groovy", "settings.gradle.kts": "groovy",
}
# The closed sets of names; what is outside of a set becomes its last.
SYMBOL_TYPES = "function method class table procedure view trigger type index manifest config ops other".split()
LANGUAGES = [*SUFFIX_LANGUAGES, "unknown"]

# Patterns of routes, URLs and references.
ROUTES = [
    r"(?i)@(?:Request|Get|Post|Put|Delete|Patch)Mapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?[\"']([^\"']{1,300})[\"']",
    r"(?i)\[(?:Route|Http(?:Get|Post|Put|Delete|Patch))\s*\(\s*[\"']([^\"']{1,300})[\"']",
    r"(?i)\.Map(?:Get|Post|Put|Delete|Patch)\s*\(\s*[\"']([^\"']{1,300})[\"']",
    r"(?i)(?:app|router)\.(?:get|post|put|delete|patch)\s*\(\s*[\"']([^\"']{1,300})[\"']",
]
VERB = r"(?i)@(?:Get|Post|Put|Delete|Patch|Request)Mapping|\[(?:Http(?:Get|Post|Put|Delete|Patch))\]|\.Map(?:Get|Post|Put|Delete|Patch)\(|(?:app|router)\.(?:get|post|put|delete|patch)\("
CONFIG_FILE = r"(?i)\.(ya?ml|json|properties|env|config)$"
CLASS_HEAD = r"(?m)^\s*(?:public\s+|private\s+|protected\s+|internal\s+)?(?:abstract\s+|static\s+|sealed\s+|partial\s+)*(?:class|interface|enum|record|struct)\s+"
ENDPOINT = (
    r"(?i)@(?:Get|Post|Put|Delete|Patch|Request)Mapping|@(?:GET|POST|PUT|DELETE|PATCH|Path)\b|\[Http(?:Get|Post|Put|Delete|Patch)|\[(?:Route|ApiController)(?:\(|\])"
    r"|\.Map(?:Get|Post|Put|Delete|Patch)\(|app\.(?:get|post|put|delete|patch)\(|router\.(?:get|post|put|delete)\("
)
HTTP_CALL = (
    r"(?i)RestTemplate|WebClient\.(?:create|builder)|\.exchange\(|\.retrieve\(|@FeignClient|HttpClient|IHttpClientFactory|\.GetAsync\(|\.PostAsync\(|\.PutAsync\(|\.DeleteAsync\(|\.SendAsync\("
    r"|\.GetFromJsonAsync\(|\.PostAsJsonAsync\(|httpx\.|requests\.|fetch\(|axios\.|\.get\(\s*[\"']https?://|\.post\(\s*[\"']https?://"
)
IMPORT = r"(?m)^(?:import\s|from\s|require\(|using\s|#include)"


def tokens(text: Column) -> Column:
    """Maximal runs of letters, digits, ``_`` and ``$``, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}_$]+"), F.lit(0))


def kept_tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """Tokens of at most 40 characters that are no stopwords; repeated ones stay."""
    kept = F.filter(tokens(text), lambda t: F.length(t) <= LONGEST_TOKEN)
    return F.filter(kept, lambda t: ~t.isin(*stopwords)) if stopwords else kept


def first_tokens(text: Column, most: int) -> Column:
    """The first ``most`` tokens of a text, joined by blanks: what a sparse embedder with a token limit sees."""
    return F.array_join(F.slice(tokens(text), 1, most), " ")


def request_path(path: Column) -> Column:
    """A path as a caller may write it: ``/`` for ``\\``, without blanks around and slashes or ``./`` at its ends."""
    return F.btrim(F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""), F.lit("/"))


def collection_of(path: Column) -> Column:
    """The first segment of a request path, ``codebase`` if there is none."""
    first = F.substring_index(request_path(path), "/", 1)
    return F.when(F.length(first) > 0, first).otherwise("codebase")


def term_weight(count: Column, length: Column) -> Column:
    """Saturated term frequency against a fixed average length; no inverse document frequency."""
    return count * (BM25_K + 1) / (count + BM25_K * (1 - BM25_B + BM25_B * length / AVERAGE_LENGTH))


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def glob_pattern(glob: str) -> str:
    """The pattern of a path glob: ``*`` and ``?`` cross folders, letter case does not matter."""
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def ignore_pattern(line: str, standard: bool = False) -> str | None:
    """The pattern of a line of an ignore file; None for blank lines and comments. There is no negation.

    Patterns are anchored at the root. One that ends in ``/`` matches nothing below the folder, unless ``standard``.
    """
    rule = line.strip()
    if not rule or rule.startswith("#"):
        return None
    anchored = rule.startswith("/")
    rule = rule.lstrip("/")
    if standard:
        rule = rule.rstrip("/")
    body = re.sub(r"\\\*\\\*|\\\*|\\\?", lambda m: {r"\*\*": ".*", r"\*": "[^/]*", r"\?": "."}[m[0]], re.escape(rule))
    return f"^{body}$" if anchored and not standard else f"^{body}(?:/|$)"


def language_of(path: Column) -> Column:
    """Language by file name, then compound suffix, then last suffix; null means that the file is skipped."""
    name = basename(path)
    lower = F.lower(name)
    by_name, by_suffix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for known, language in NAME_LANGUAGES.items():
        by_name = F.when(name == known, language).otherwise(by_name)
    first, last = F.regexp_extract(lower, r"^[^.]*(\..*)$", 1), F.regexp_extract(lower, r"(\.[^.]*)$", 1)
    table = F.create_map(*[F.lit(x) for language, suffixes in SUFFIX_LANGUAGES.items() for s in suffixes for x in (s, language)])
    by_suffix = F.coalesce(F.try_element_at(table, first), F.try_element_at(table, last))
    return F.coalesce(by_name, by_suffix)


def excluded(path: Column, folders: list[str] = EXCLUDED) -> Column:
    """Whether a folder of the path is never entered; of ``.github`` only ``workflows`` is."""
    parts = F.split(path, "/")
    inside = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(inside, F.array(*map(F.lit, folders))) | F.exists(inside, lambda x: x.startswith(".venv")) | (path.rlike(r"(^|/)\.github/") & ~path.rlike(r"(^|/)\.github/workflows/"))


def is_manifest(path: Column) -> Column:
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    return basename(path).isin(*MANIFESTS) | F.lower(clean).rlike(r"\.(?:csproj|fsproj|vbproj|nuspec)$")


def file_symbol_type(path: Column, language: Column) -> Column:
    """manifest, config or ops by path; null where chunks keep their own type."""
    norm = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.substring_index(norm, "/", -1)
    return (
        F.when(name.isin(*[m.lower() for m in MANIFESTS]), "manifest")
        .when(name.isin(".env", ".env.example", ".env.local") | norm.rlike(r"\.(?:properties|ini|cfg|toml)$"), "config")
        .when((language == "yaml") & (norm.contains(".github/workflows/") | norm.contains("templates/")), "ops")
        .when(language == "yaml", "config")
    )


def node_symbol_type(node: Column) -> Column:
    """Symbol type of a syntax node."""
    chain = F.when(node == "create_table", "table")
    for kind in ("procedure", "function", "view", "trigger", "type", "index"):
        chain = chain.when(node == f"create_{kind}", kind)
    return chain.when(node.rlike("class|struct|enum|interface"), "class").when(node.rlike("method|constructor"), "method").when(node.contains("function"), "function").otherwise("other")


def callees(content: Column) -> Column:
    """What a text calls, in order of first mention: methods and receiver.method of all member calls, then bare names."""
    member = r"([A-Za-z_][A-Za-z0-9_$]*)\s*\.\s*([A-Za-z_][A-Za-z0-9_$]*)\s*\("
    pairs = F.arrays_zip(F.regexp_extract_all(content, F.lit(member), F.lit(1)).alias("r"), F.regexp_extract_all(content, F.lit(member), F.lit(2)).alias("m"))
    words = F.array(*map(F.lit, NOT_CALLED))
    free = lambda x: ~F.array_contains(words, x)
    members = F.flatten(F.transform(pairs, lambda p: F.array(F.when(free(p["m"]), p["m"]), F.when(free(p["m"]) & free(p["r"]), F.concat_ws(".", p["r"], p["m"])))))
    bare = F.filter(F.regexp_extract_all(content, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_$]*)\s*\("), F.lit(1)), free)
    return F.array_distinct(F.filter(F.concat(members, bare), lambda x: x.isNotNull()))


def route_paths(content: Column, path: Column) -> Column:
    """Paths of the routes that a text declares; ``[controller]`` becomes the controller's name by the file's."""
    found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in ROUTES])
    controller = F.lower(F.regexp_replace(F.regexp_replace(basename(path), r"(?i)\.cs", ""), "(?i)controller", ""))
    trimmed = F.filter(F.transform(found, lambda p: F.btrim(p, F.lit("/"))), lambda p: F.length(p) > 1)
    return F.transform(trimmed, lambda p: F.when((F.length(controller) > 0) & F.lower(p).contains("[controller]"), F.regexp_replace(p, F.lit(r"(?i)\[controller\]"), controller)).otherwise(p))


def config_patterns(keywords: list[str] = URL_KEYWORDS) -> list[str]:
    words = "|".join([*map(re.escape, keywords), r"v\d+"])
    return [
        rf"(?i):\s*(/(?:{words})/[^\s,}}\]\"']{{1,200}})",
        r":\s*(/[a-zA-Z][a-zA-Z0-9_-]{0,100}/[a-zA-Z][a-zA-Z0-9_{}/-]{0,200})",
        r"(?i)(?:host|baseUrl|baseAddress|base-url|base_url|base\.url|endpoint|uri)\s*[:=]\s*[\"']?(https?://[^\s\"']{1,300})",
    ]


def code_patterns(keywords: list[str] = URL_KEYWORDS) -> list[str]:
    words = "|".join([*map(re.escape, keywords), r"v\d+"])
    return [
        rf"[\"'](/(?:{words})/[^\"']{{1,200}})[\"']",
        r"(?i)(?:exchange|getForObject|getForEntity|postForObject|postForEntity|put|delete|retrieve|uri)\s*\(\s*[\"']([^\"']{0,200}?/[a-zA-Z][a-zA-Z0-9_/-]{1,200})[\"']",
    ]


def _url_paths(found: Column) -> Column:
    return F.filter(F.transform(found, lambda p: F.btrim(p, F.lit("/"))), lambda p: F.length(p) > 2)


def config_urls(content: Column, keywords: list[str] = URL_KEYWORDS) -> Column:
    """struct(paths, base_urls) of a configuration text."""
    found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in config_patterns(keywords)])
    web = lambda p: F.lower(p).startswith("http")
    return F.struct(_url_paths(F.filter(found, lambda p: ~web(p))).alias("paths"), F.filter(found, web).alias("base_urls"))


def code_urls(content: Column, keywords: list[str] = URL_KEYWORDS) -> Column:
    return _url_paths(F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in code_patterns(keywords)]))


def http_verb(content: Column) -> Column:
    """The verb of the first endpoint that a text declares, empty if none is told."""
    token = F.lower(F.regexp_extract(content, f"({VERB})", 1))
    chain = F.when(F.lit(False), "")
    for verb in ("get", "post", "put", "delete", "patch"):
        chain = chain.when(token.contains(verb), verb.upper())
    return chain.otherwise("")


def reference_type(content: Column, symbol: Column, path: Column, has_deps: Column | None = None) -> Column:
    """What a text is to a symbol; the first that holds of a fixed order."""
    urls = config_urls(content)
    defines = content.rlike(CLASS_HEAD) & (F.length(symbol) > 0) & F.regexp_like(content, F.concat(F.lit(r"(?:class|interface|enum|record)\s+\Q"), symbol, F.lit(r"\E\b")))
    return (
        F.when(is_manifest(path) & (has_deps if has_deps is not None else F.lit(False)), "build_dependency")
        .when(path.rlike(CONFIG_FILE) & ((F.size(urls["paths"]) > 0) | (F.size(urls["base_urls"]) > 0)), "service_config")
        .when(defines, "definition")
        .when(content.rlike(ENDPOINT), "endpoint_definition")
        .when(content.rlike(HTTP_CALL), "http_call")
        .when(content.rlike(IMPORT), "import")
        .otherwise("usage")
    )


def normal_path(path: Column) -> Column:
    """A path as :func:`paths_match` compares it: without ``{...}``, lower case, single slashes, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(path, r"\{[^}]+\}", "")), "/+", "/"), F.lit("/"))


def paths_match(a: Column, b: Column) -> Column:
    """Whether two normal paths of two segments at least contain one another segment by segment."""
    shorter, longer = F.when(F.size(F.split(b, "/")) <= F.size(F.split(a, "/")), b).otherwise(a), F.when(F.size(F.split(b, "/")) <= F.size(F.split(a, "/")), a).otherwise(b)
    return a.contains("/") & b.contains("/") & F.concat(F.lit("/"), longer, F.lit("/")).contains(F.concat(F.lit("/"), shorter, F.lit("/")))


def normal_name(name: Column) -> Column:
    """An artifact's or collection's name: lower case, ``-`` for ``_`` and ``.``, without the first suffix of the list that it ends in."""
    n = F.translate(F.lower(name), "_.", "--")
    chain = F.when(F.lit(False), n)
    for suffix in NAME_SUFFIXES:
        chain = chain.when(n.endswith(suffix), F.left(n, F.length(n) - len(suffix)))
    return chain.otherwise(n)


def known(value: Column, names: list[str]) -> Column:
    """The value if it is one of the names, else the last of them."""
    return F.when(value.isin(*names), value).otherwise(names[-1])


def chunk_id(path: Column, line: Column) -> Column:
    return F.sha2(F.concat_ws(":", path, line.cast("string")), 256)


#: The name space of points: that of addresses.
POINT_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name: Column, space: str = POINT_SPACE) -> Column:
    """The name-based UUID (version 5) of a name, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def truncated(content: Column, most: int) -> tuple[Column, Column]:
    """The content cut to ``most`` characters, and whether it was cut."""
    return F.left(content, F.lit(most)), F.length(content) > most


def symbol_key(collection: Column, path: Column, symbol: Column) -> Column:
    return F.concat(collection, F.lit(":"), path, F.lit("::"), symbol)


def import_key(collection: Column, name: Column) -> Column:
    return F.concat(collection, F.lit("::import::"), name)


def callee_key(collection: Column, callee: Column) -> Column:
    return F.concat(collection, F.lit("::callee::"), callee)


def artifact_key(group: Column, name: Column, ecosystem: Column) -> Column:
    return F.when(F.coalesce(F.length(group), F.lit(0)) == 0, F.concat(ecosystem, F.lit(":"), name)).otherwise(F.concat(ecosystem, F.lit(":"), group, F.lit(":"), name))


def folder_prefixes(path: Column, depth: int = 2) -> Column:
    """The folders of a path down to a depth."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(depth), F.size(parts) - 1))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, 1, n), "/")))


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def interval_seconds(text: str) -> int | None:
    """Seconds of ``30s``, ``5m``, ``2h``, ``1d`` or ``[d.]hh:mm:ss``; None for what is no positive interval."""
    t = text.strip().lower()
    if m := re.fullmatch(r"(\d+)([smhd])", t):
        return int(m[1]) * _UNITS[m[2]] or None
    if m := re.fullmatch(r"(?:(\d+)\.)?(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?", t):
        d, h, mi, s = (int(x or 0) for x in m.groups())
        return (d * 86400 + h * 3600 + mi * 60 + s) or None
    return None


def six_field_cron(text: str) -> str:
    """A five-field cron line with seconds in front, one of the two day fields ``?``; others unchanged."""
    fields = text.split()
    if len(fields) != 5:
        return text
    minute, hour, day, month, weekday = fields
    if weekday == "*":
        weekday = "?"
    elif day == "*":
        day = "?"
    return f"0 {minute} {hour} {day} {month} {weekday}"
