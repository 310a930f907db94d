"""Dependencies named in build manifests of seven ecosystems, read by the formats' own parsers."""

from __future__ import annotations

import configparser
import json
import re
import tomllib
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text


class Dependency(NamedTuple):
    artifact: str
    group: str = ""
    version: str = ""
    scope: str = ""
    ecosystem: str = ""


def _elements(content: str) -> Iterator[ElementTree.Element]:
    """The elements of an XML text as they close, names without namespaces; of a damaged text those before the damage."""
    parser = ElementTree.XMLPullParser(["end"])
    body = re.sub(r"<!DOCTYPE[^>]*>", "", re.sub(r"^\s*<\?xml.*?\?>", "", content, flags=re.S))
    parser.feed(f"<all>{body}</all>")
    try:
        for _, element in parser.read_events():
            for part in element.iter():
                part.tag = str(part.tag).rpartition("}")[2]
            yield element
    except ElementTree.ParseError:
        return


def _text(element: ElementTree.Element, name: str) -> str:
    return (element.findtext(name) or "").strip()


def maven(content: str) -> Iterator[Dependency]:
    """Every dependency of a project model (scope compile unless told), and its parent."""
    parents = []
    for e in _elements(content):
        if e.tag in ("dependency", "parent") and _text(e, "groupId") and _text(e, "artifactId"):
            found = Dependency(_text(e, "artifactId"), _text(e, "groupId"), _text(e, "version"), "parent" if e.tag == "parent" else _text(e, "scope") or "compile", "maven")
            if e.tag == "parent":
                parents.append(found)
            else:
                yield found
    yield from parents


def nuget(content: str) -> Iterator[Dependency]:
    """Packages and projects that a project file refers to; a project by the name of its file."""
    for e in _elements(content):
        name = (e.get("Include") or "").strip()
        if e.tag == "PackageReference" and name:
            yield Dependency(name, version=(e.get("Version") or _text(e, "Version")).strip(), ecosystem="nuget")
        elif e.tag == "ProjectReference" and name:
            file = re.split(r"[\\/]", name)[-1]
            yield Dependency(file.rpartition(".")[0] or file, scope="project", ecosystem="nuget")


NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")


def npm(content: str) -> Iterator[Dependency]:
    """The packages of the three sections; of a text that is no JSON as a whole, of the sections that are."""
    try:
        whole = json.loads(content)
        sections = [(s, whole.get(s)) for s in NPM_SECTIONS] if isinstance(whole, dict) else []
    except (ValueError, RecursionError):
        sections, read = [], json.JSONDecoder().raw_decode
        for m in re.finditer(r'"(\w+)"\s*:\s*(?=\{)', content):
            if m[1] in NPM_SECTIONS:
                try:
                    sections.append((m[1], read(content, m.end())[0]))
                except (ValueError, RecursionError):
                    continue
    for scope, entries in sections:
        for name, version in entries.items() if isinstance(entries, dict) else ():
            if isinstance(version, str):
                yield Dependency(name, version=version, scope=scope, ecosystem="npm")


# The configurations that a Gradle build adds dependencies to.
GRADLE_CONFIGURATIONS = frozenset("implementation api compileOnly runtimeOnly testImplementation testRuntimeOnly annotationProcessor kapt compile".lower().split())
_GRADLE_WORD = re.compile(r"//[^\n]*|/\*.*?\*/|\"([^\"\n]*)\"|'([^'\n]*)'|(\w+)|(\S)", re.S)


def gradle(content: str) -> Iterator[Dependency]:
    """``configuration 'group:name:version'``, with or without brackets, also within ``platform(...)``; then ``project(':path')``."""
    words = [(m[1] or m[2] or "", m[3] or m[4] or "") for m in _GRADLE_WORD.finditer(content) if m.lastindex]  # (string, other)
    projects = []
    for i, (_, word) in enumerate(words):
        at = i + 1
        if word.lower() in GRADLE_CONFIGURATIONS:
            while at < len(words) and words[at][1] in ("(", "platform", "enforcedPlatform"):
                at += 1
            parts = words[at][0].split("@")[0].split(":") if at < len(words) else []
            if len(parts) in (2, 3) and all(parts[:2]):
                yield Dependency(parts[1], parts[0], "".join(parts[2:]), ecosystem="gradle")
        elif word == "project" and words[at : at + 1] == [("", "(")] and at + 1 < len(words):
            path = words[at + 1][0]
            if path.startswith(":"):
                projects.append(Dependency(path.lstrip(":"), scope="project", ecosystem="gradle"))
    yield from projects


def go(content: str) -> Iterator[Dependency]:
    """Required modules, each once with the first version named."""
    modules: dict[str, str] = {}
    inside = False
    for line in content.split("\n"):
        words = line.split("//")[0].split()
        if inside and words[:1] == [")"]:
            inside = False
        elif words[:1] in (["require"], ["require("]) and words[-1].endswith("("):
            inside = True
        else:
            words = words if inside else words[1:] if words[:1] == ["require"] else []
            if len(words) >= 2:
                modules.setdefault(words[0], words[1])
    for module, version in modules.items():
        yield Dependency(module.rpartition("/")[2], module, version, ecosystem="go")


def _toml(content: str) -> dict:
    try:
        return tomllib.loads(content)
    except (ValueError, RecursionError):
        return {}


def cargo(content: str) -> Iterator[Dependency]:
    whole = _toml(content)
    for section, scope in (("dependencies", ""), ("dev-dependencies", "dev")):
        entries = whole.get(section)
        for name, wanted in entries.items() if isinstance(entries, dict) else ():
            version = wanted.get("version", "") if isinstance(wanted, dict) else wanted
            yield Dependency(name, version=version if isinstance(version, str) else "", scope=scope, ecosystem="cargo")


_PROJECT_NAME = re.compile(r"\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)")


def _requirements(lines: list) -> Iterator[Dependency]:
    """Requirement specifiers by their names; comments, options and what is no specifier are none."""
    for line in lines:
        m = _PROJECT_NAME.match(line) if isinstance(line, str) else None
        if m:
            yield Dependency(m[1], ecosystem="python")


def pyproject(content: str) -> Iterator[Dependency]:
    project = _toml(content).get("project")
    lines = project.get("dependencies") if isinstance(project, dict) else None
    yield from _requirements(lines if isinstance(lines, list) else [])


def requirements(content: str) -> Iterator[Dependency]:
    yield from _requirements(content.split("\n"))


def setup_cfg(content: str) -> Iterator[Dependency]:
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    try:
        parser.read_string(content)
    except configparser.Error:
        return
    yield from _requirements(parser.get("options", "install_requires", fallback="").split("\n"))


_BY_NAME = {
    "pom.xml": maven, "package.json": npm, "build.gradle": gradle, "build.gradle.kts": gradle, "settings.gradle": gradle, "settings.gradle.kts": gradle, "go.mod": go, "Cargo.toml": cargo,
    "pyproject.toml": pyproject, "requirements.txt": requirements, "setup.cfg": setup_cfg,
}


def manifest_dependencies(content: str, path: str) -> list[Dependency]:
    """What a build manifest depends on; nothing for other files."""
    name = re.split(r"[\\/]", path or "")[-1]
    reader = _BY_NAME.get(name) or (nuget if name.lower().endswith(tuple(text.MANIFEST_SUFFIXES)) else None)
    return list(reader(content)) if reader else []


def dependencies(files: DataFrame) -> DataFrame:
    """collection, path, artifact, group, version, scope, ecosystem of all manifests among ``files`` (collection, path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [manifest_dependencies(t or "", p) for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            at = pa.array([i for i, deps in enumerate(found) for _ in deps], type=pa.int64())
            flat = [d for deps in found for d in deps]
            columns = [pa.array([getattr(d, f) for d in flat], type=pa.string()) for f in Dependency._fields]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *columns], names=["collection", "path", *Dependency._fields])

    rows = files.where(text.is_manifest(F.col("path"))).select("collection", "path", "content")
    return rows.mapInArrow(run, "collection string, path string, " + ", ".join(f"`{n}` string" for n in Dependency._fields))
