"""Markdown notes: front matter, titles, tags, links, and one section of a note."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whinstone.functions.text import SPACE, split_lines, strip

# Fixed patterns of the note format: front matter, headings, inline tags, wiki links.
FRONT = r"\A---[ \t]*\r?\n((?s:.*?))\r?\n---[ \t]*\r?\n"
HEADING = r"^(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$"
TAG = rf"(?:^|[{SPACE}])#([A-Za-z0-9_\-/\x{{4e00}}-\x{{9fff}}]{{1,64}})"
LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
SECTION_LIMIT = 20_000


_META = T.StructType(
    [
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("title", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(_META)
def _yaml(front: pd.Series) -> pd.DataFrame:
    import yaml

    rows = []
    for text in front:
        try:
            found = yaml.safe_load(text) if text else None
        except (yaml.YAMLError, ValueError):
            found = None
        found = {str(k): v for k, v in found.items()} if isinstance(found, dict) else {}
        tags = found.get("tags") or found.get("tag")
        tags = tags.replace(",", " ").split() if isinstance(tags, str) else tags if isinstance(tags, list) else []
        title = found.get("title")
        rows.append(
            (
                {k: v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False) for k, v in found.items()},
                str(title).strip() if title else "",
                [s for s in (str(t).strip() for t in tags) if s],
            )
        )
    return pd.DataFrame(rows, columns=["fields", "title", "tags"])


def stem(path: Column) -> Column:
    """The file's name without its last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def body_of(raw: Column) -> Column:
    return F.regexp_replace(raw, FRONT, "")


def first_title(body: Column) -> Column:
    """The text of the first heading of level one, even where that is empty; null without one."""
    heads = F.filter(split_lines(body), lambda line: line.rlike(r"^#[ \t]"))
    return strip(F.regexp_extract(F.get(heads, F.lit(0)), HEADING, 2))


def parse_notes(files: DataFrame) -> DataFrame:
    """Notes from files (path, raw): path, title, body, tags, links, frontmatter (map of strings).

    The title is the first level-one heading, else the front matter's, else the file's stem; tags are the front matter's, then inline
    ones; both tags and links are distinct in order. Only YAML needs Python, and only the front matter goes there.
    """
    front = F.regexp_extract("raw", FRONT, 1)
    with_meta = files.select("path", body_of(F.col("raw")).alias("body"), _yaml(front).alias("meta"))
    own, from_meta = first_title(F.col("body")), F.col("meta.title")
    title = F.when(F.coalesce(own, F.lit("")) != "", own).when(from_meta != "", from_meta).otherwise(stem(F.col("path")))
    inline = F.regexp_extract_all("body", F.lit(TAG), F.lit(1))
    links = F.transform(F.regexp_extract_all("body", F.lit(LINK), F.lit(1)), strip)
    return with_meta.select(
        "path",
        title.alias("title"),
        "body",
        F.array_distinct(F.concat("meta.tags", inline)).alias("tags"),
        F.array_distinct(F.filter(links, lambda x: x != "")).alias("links"),
        F.col("meta.fields").alias("frontmatter"),
    )


def read_section(raw: Column | str, heading: str = "", limit: int = SECTION_LIMIT) -> Column:
    """A note without front matter, or only its section under `heading` (case and # aside), which any next line that begins with #
    ends; null where there is no such heading. At most `limit` characters."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    body = body_of(raw)
    if not heading:
        return F.substring(body, 1, limit)
    lines = split_lines(body)
    wanted = heading.strip().lower()
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    heads = F.filter(numbered, lambda x: x["line"].startswith("#"))
    named = F.filter(heads, lambda x: F.lower(strip(F.regexp_replace(x["line"], "^#+", ""))) == wanted)
    first = F.get(named, F.lit(0))["i"]
    later = F.array_min(F.transform(F.filter(heads, lambda x: x["i"] > first), lambda x: x["i"]))
    part = F.slice(lines, first + 1, F.coalesce(later, F.size(lines)) - first)
    return F.when(first.isNotNull(), F.substring(strip(F.array_join(part, "\n")), 1, limit))
