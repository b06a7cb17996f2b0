"""Front matter of manifests as people write it: scalars, quoted and continued ones, folded and literal blocks, lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FIELDS = "name string, description string, description_zh string, listed array<string>, h1 string"
_KEY = re.compile(r"([A-Za-z_][\w-]*):(?:[ \t]+(.*)|)$")
_NESTED = re.compile(r"[ \t]*[\w-]+:(\s|$)")
TITLE, PARAGRAPH = 40, 300  # characters


def folded(lines: list[str]) -> str:
    """Lines as one where no blank line stands between them; of blank lines in a row each is a line break."""
    text = re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(x.strip() for x in lines))
    return re.sub(r"\n(\n+)", r"\1", text).strip()


def literal(lines: list[str]) -> str:
    """Lines as they stand, less the indent that all of them have."""
    indent = min((len(x) - len(x.lstrip(" \t")) for x in lines if x.strip()), default=0)
    return "\n".join(x[indent:] if x[:indent].strip(" \t") == "" else x.lstrip(" \t") for x in lines).strip()


def unquoted(text: str) -> str:
    return text[1:-1].strip() if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def value_of(inline: str, lines: list[str]) -> str | list[str] | None:
    """What a key has: on its own line, and on the indented lines below it. A map below it is none."""
    said = [x for x in lines if x.strip()]
    if not inline and said and said[0].strip()[:1] in "|>":  # the mark of a block on a line of its own
        at = lines.index(said[0])
        inline, lines = said[0].strip(), lines[at + 1 :]
    if inline[:1] in ("|", ">") and inline:
        return (literal if inline[0] == "|" else folded)(lines)
    if inline[:1] == "[" and inline[-1:] == "]":
        return [unquoted(x.strip()) for x in inline[1:-1].split(",") if x.strip()]
    if inline:
        more = folded([x for x in lines if not _NESTED.match(x)])
        return unquoted(" ".join(filter(None, (unquoted(inline), more))))
    if any(x.lstrip().startswith("- ") for x in said):
        return [unquoted(x.strip()[2:].strip()) for x in said if x.lstrip().startswith("- ")]
    return None if not said or _NESTED.match(said[0]) else folded(lines)


def front_matter(text: str) -> tuple[dict, list[str]]:
    """Values by lower-cased key, and the lines of the body; a front matter that does not close is body."""
    lines = text.replace("\r\n", "\n").lstrip("﻿").split("\n")
    close = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None) if lines[0].strip() == "---" else None
    if close is None:
        return {}, lines
    out, at = {}, 1
    while at < close:
        found = _KEY.match(lines[at])
        below = next((i for i in range(at + 1, close) if lines[i].strip() and lines[i][0] not in " \t"), close)
        if found and (value := value_of((found[2] or "").strip(), lines[at + 1 : below])):
            out.setdefault(found[1].lower(), value)
        at = below
    return out, lines[close + 1 :]


def title(body: list[str]) -> str:
    """The heading of one # that comes before anything but deeper headings and fences, without marks."""
    for line in filter(None, map(str.strip, body)):
        if line.startswith("# "):
            return " ".join(re.sub(r"[#*_`]+", " ", line[2:]).split())[:TITLE]
        if not line.startswith(("#", "```")):
            break
    return ""


def parse(text: str) -> dict:
    """Front matter, h1, and for what it lacks the name of the first # heading anywhere and the first paragraph that is no heading."""
    out, body = front_matter(text)
    heading = next((m[1].strip() for x in body if (m := re.match(r"#\s+(.+)$", x))), "")
    paragraph = next((p for p in map(str.strip, re.split(r"\n\n", "\n".join(body))) if p and not p.startswith("#")), "")
    out["h1"] = title(body)
    out["name"] = out.get("name") or heading
    out["description"] = out.get("description") or paragraph[:PARAGRAPH]
    return out


def rows(texts: pd.Series) -> pd.DataFrame:
    """FIELDS of texts, null as empty; a list of triggers in one line is cut at commas."""
    found = [parse(t or "") for t in texts]
    text = lambda r, k: r.get(k) if isinstance(r.get(k), str) else None
    many = lambda v: v if isinstance(v, list) else [x.strip() for x in re.split("[、,，;；]", v) if x.strip()] if v else []
    return pd.DataFrame({"name": [text(r, "name") for r in found], "description": [text(r, "description") for r in found], "description_zh": [text(r, "description_zh") for r in found], "listed": [many(r.get("triggers")) for r in found], "h1": [r["h1"] for r in found]}, dtype=object)


def udf():
    return F.pandas_udf(rows, FIELDS)


def fields(text: Column | str) -> Column:
    """A struct of FIELDS of a manifest's text; it goes to Python by batches."""
    return udf()(text)


def register(spark: SparkSession) -> None:
    """shelfmark_front_matter(text): a struct of FIELDS."""
    spark.udf.register("shelfmark_front_matter", udf())
