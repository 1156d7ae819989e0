"""Markdown and front-matter functions that need Python, Arrow-batched, and their JVM-side companions."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import fnv1a, yaml_scalar


def ascii_slug(c: Column, most: int = 80) -> Column:
    """Slug after NFKD without combining marks: accents fall away instead of the letter."""

    def plain(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not "̀" <= x <= "ͯ"), na_action="ignore").astype(object)

    plain.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    bare = F.pandas_udf("string")(plain)(c)
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most), r"-+$", "")


def short_hash(c: Column) -> Column:
    """FNV-1a in base 36, eight characters."""
    return F.lpad(F.lower(F.conv(fnv1a(c).cast("string"), 10, 36)), 8, "0")


def parse_front_matter(text: str | None) -> dict[str, str] | None:
    """Keys and values of the leading '---' block; inline lists come as values joined by ', ', quotes fall away."""
    found = re.match(r"\A---\r?\n(.*?)\r?\n---", text or "", re.S)
    if not found:
        return None
    out: dict[str, str] = {}
    key = None
    for line in found.group(1).splitlines():
        item = re.match(r"^\s*-\s+(.*)$", line)
        pair = re.match(r"^([A-Za-z_][\w-]*):\s*(.*)$", line)
        if item and key:
            out[key] = ", ".join(x for x in (out[key], _scalar(item.group(1))) if x)
        elif pair:
            key, value = pair.group(1), pair.group(2).strip()
            listed = re.match(r"^\[(.*)\]$", value)
            out[key] = ", ".join(_scalar(v) for v in listed.group(1).split(",") if v.strip()) if listed else _scalar(value)
    return out


def _scalar(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def typed_front_matter(text: str | None) -> dict | None:
    """As :func:`parse_front_matter` for one-line values, but with null, booleans, numbers and inline lists as such."""
    found = re.match(r"\A---\r?\n(.*?)\r?\n---", text or "", re.S)
    if not found:
        return None
    out: dict = {}
    for line in map(str.strip, found.group(1).splitlines()):
        key, colon, value = line.partition(":")
        if colon and key.strip() and not line.startswith("#"):
            out[key.strip()] = _coerced(value.strip())
    return out


def _coerced(value: str):
    plain = {"": "", "null": None, "~": None, "true": True, "false": False}
    if value in plain:
        return plain[value]
    if re.fullmatch(r"-?\d+", value):
        return int(value)
    if re.fullmatch(r"-?\d+\.\d+", value):
        return float(value)
    if value[0] == "[" and value[-1] == "]":
        pieces = re.findall(r"\"((?:[^\"\\]|\\.)*)\"|'([^']*)'|([^,'\"\s][^,]*)", value[1:-1])
        return [(a or b or c.strip()).replace('\\"', '"') for a, b, c in pieces]
    if len(value) > 1 and value[0] == value[-1] == '"':
        return value[1:-1].replace('\\"', '"').replace("\\\\", "\\").replace("\\n", "\n")
    return value[1:-1].replace("''", "'") if len(value) > 1 and value[0] == value[-1] == "'" else value


def front_matter_json(c: Column) -> Column:
    """The front matter with typed values as JSON text, null without one; keys in alphabetical order."""

    def run(batch: pd.Series) -> pd.Series:
        parsed = [typed_front_matter(t if isinstance(t, str) else None) for t in batch]
        return pd.Series([None if p is None else json.dumps(p, ensure_ascii=False, sort_keys=True) for p in parsed], dtype=object)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf("string")(run)(c)


def front_matter_map(c: Column) -> Column:
    """``map<string,string>`` of the front matter, null without one."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([parse_front_matter(t if isinstance(t, str) else None) for t in batch], dtype=object)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf("map<string,string>")(run)(c)


def rendered_front_matter(**fields: Column) -> Column:
    """A front-matter block of the fields that are not null."""
    lines = [F.concat(F.lit(f"{name}: "), yaml_scalar(c.cast("string"))) for name, c in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def with_project(c: Column, project: Column) -> Column:
    """The text with ``project`` in its front matter, behind the other fields; added where there is none; an existing project stays."""
    head = F.regexp_extract(c, r"\A---\n([\s\S]*?)\n---", 1)
    has_block, has_field = c.rlike(r"\A---\n[\s\S]*?\n---"), head.rlike(r"(?m)^project:\s")
    rest = F.substr(c, F.length(head) + 5)
    return F.when(has_block & has_field, c).when(has_block, F.concat(F.lit("---\n"), head, F.lit("\nproject: "), project, rest)).otherwise(F.concat(F.lit("---\nproject: "), project, F.lit("\n---\n\n"), c))


def without_generated_sections(c: Column) -> Column:
    """The body without the 'Related' and 'Concepts' sections that an export adds."""
    return F.regexp_replace(c, r"(?ms)^##\s+(?:Related|Concepts)\s*$.*?(?=^##\s|\z)", "")


def content_hash(title: Column, body: Column, concepts: Column) -> Column:
    """Hash by which an unchanged document is known: title, body and sorted concepts."""
    return F.xxhash64(F.concat_ws("\n---\n", title, body, F.array_join(F.array_sort(concepts), "\n")))


def vault_path(path: Column, project: Column) -> Column:
    """Place of a file in a shared vault: its project's folder first."""
    return F.concat_ws("/", project, F.regexp_replace(path, r"^(?:\./)?(?:psi/)?", ""))


def local_path(path: Column, project: Column) -> Column:
    """The reverse of :func:`vault_path`; paths of other projects are null."""
    return F.when(F.startswith(path, F.concat(project, F.lit("/"))), F.substr(path, F.length(project) + 2))


def inferred_project(path: Column) -> Column:
    """host/owner/name of a path that holds a repository, or of '/Code/a/b/c'; else null."""
    hosted = F.regexp_extract(path, r"((?:github\.com|gitlab\.com|bitbucket\.org)/[^/]+/[^/]+)", 1)
    code = F.regexp_extract(path, r"/Code/([^/]+/[^/]+/[^/]+)", 1)
    return F.when(hosted != "", F.lower(hosted)).when(code != "", F.lower(code))
