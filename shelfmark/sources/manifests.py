"""Readers of manifests, registries, configs, lists, files and ledgers into the catalog's tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import manifest
from shelfmark.functions import text as T
from shelfmark.schema import FILE_BYTES, HIT_EVENT, USAGE_EVENT

#: Statuses of a registry that block an entry.
BLOCKED = ("blocked", "disabled", "unavailable", "off", "停用", "不可用", "已停用")
#: Default directories and files that are never read.
IGNORED = (".git/", "node_modules/", "__pycache__/", ".venv/", "dist/", "build/", "*.pyc", "*.lock")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 without a mark, or as Latin-1 where they are not valid UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\\x{FEFF}", "")


def glob_rule(rule: str) -> tuple[str, bool, bool]:
    """A gitignore rule as (regex over a path, negated, for directories only); * stays in a segment, ** does not."""
    negated = rule.startswith("!")
    body = rule[1:] if negated else rule
    directory = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i]))
            i += 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if directory else "(?:/.*)?$"), negated, directory


def ignored(path: Column, is_dir: Column, rules: tuple[str, ...] = IGNORED) -> Column:
    """Whether the last rule that matches a relative path ignores it."""
    whole = F.concat(path, F.when(is_dir, "/").otherwise(""))
    verdict = F.lit(False)
    for rule in rules:
        if rule.strip() and not rule.startswith("#"):
            regex, negated, directory = glob_rule(rule.strip())
            verdict = F.when((whole if directory else path).rlike(regex), F.lit(not negated)).otherwise(verdict)
    return verdict


parse_manifest = manifest.parse


def parsed(texts: DataFrame) -> DataFrame:
    """path, name, description, description_zh, triggers, h1 of manifest texts (path, text)."""
    rows = texts.select("path", manifest.fields("text").alias("m")).select("path", "m.*")
    alias = F.when(F.col("h1").rlike("[\\u4e00-\\u9fff]"), F.array("h1")).otherwise(T.none())
    found = F.when(F.size("listed") > 0, F.col("listed")).otherwise(T.extracted_triggers(F.coalesce("description", F.lit(""))))
    return rows.withColumn("triggers", F.slice(F.array_distinct(F.concat(found, alias)), 1, 10)).drop("listed")


def scan_manifests(spark: SparkSession, roots: list[str], name: str = "skill.md", depth: int = 5, rules: tuple[str, ...] = IGNORED) -> DataFrame:
    """Entries of manifests below roots, first root first: none below another, none deeper than `depth`, none ignored."""
    pattern = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)
    out = None
    for priority, root in enumerate(roots):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        files = files.select("path", F.col("modificationTime").cast("bigint").alias("mtime"), decoded(F.col("content")).alias("text"), F.lit(priority).alias("root"), F.lit(root.rstrip("/")).alias("base"))
        out = files if out is None else out.unionByName(files)
    tail = F.regexp_replace(F.expr("substring(path, locate(base, path) + length(base) + 1)"), "/[^/]*$|^[^/]*$", "")
    rows = out.withColumn("folder", tail).withColumn("level", F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))))
    rows = rows.filter((F.col("level") <= depth) & ~ignored(F.col("folder"), F.lit(True), rules))
    parts = F.split("folder", "/")
    above = rows.filter("level > 0").select("root", "path", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.col("level")), lambda n: F.array_join(F.slice(parts, 1, n), "/")))).alias("up"), "folder").filter("up <> folder")
    nested = above.join(rows.select("root", F.col("folder").alias("up")), ["root", "up"]).select("root", "path").distinct()
    rows = rows.join(nested, ["root", "path"], "left_anti")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("root"))).filter("r = 1")
    meta = parsed(rows.select("path", "text"))
    both = rows.select("path", "mtime", "folder", F.col("text").alias("full_text"), "root").join(meta, "path")
    named = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.element_at(F.split("folder", "/"), -1))
    return both.select(named.alias("name"), F.lit("skill").alias("type"), "description", "description_zh", "triggers", "path", "mtime", "root", "full_text").filter(F.col("name").rlike("\\w"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an authoritative list, {current_agent, skills: [...]} or a bare list: first of a name wins, statuses block, agents may be text."""
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.skills", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    rows = text.select(F.try_variant_get("v", "$.current_agent", "string").alias("current_agent"), F.posexplode(items).alias("ord", "i"))
    get = lambda *keys, kind="string": F.coalesce(*[F.try_variant_get("i", f"$.{k}", kind) for k in keys])
    word = F.when(F.schema_of_variant("i") == "STRING", F.try_variant_get("i", "$", "string"))
    agents = F.coalesce(get("agents", kind="array<string>"), F.split(get("agents"), "[、,，;；/|]+"))
    status = F.lower(F.coalesce(get("status"), F.lit("ready")))
    rows = rows.select("ord", "current_agent", F.coalesce(word, get("name", "id", "title")).alias("name"), get("description", "desc", "summary").alias("description"), get("triggers", kind="array<string>").alias("triggers"), get("path").alias("path"), get("category").alias("category"), get("platform").alias("platform"), agents.alias("agents"), F.when(status.isin(*BLOCKED), "blocked").otherwise("ready").alias("visibility"))
    rows = rows.filter("name is not null").withColumn("r", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("ord"))).filter("r = 1").drop("r")
    return rows.withColumn("excluded", F.col("visibility") != "ready")


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Entries (name, type, spec) of JSON configs: servers, connectors, agents and tools, as maps or lists; first seen wins."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("v"))
    out = None
    for order, (key, kind) in enumerate((("mcpServers", "mcp"), ("mcp_servers", "mcp"), ("connectors", "connector"), ("agents", "agent"))):
        by_name = text.select("path", F.explode(F.map_entries(F.try_variant_get("v", f"$.{key}", "map<string,variant>"))).alias("e")).select("path", F.col("e.key").alias("name"), F.col("e.value").alias("spec"))
        in_list = text.select("path", F.explode(F.try_variant_get("v", f"$.{key}", "array<variant>")).alias("spec")).select("path", F.coalesce(F.try_variant_get("spec", "$.name", "string"), F.try_variant_get("spec", "$", "string")).alias("name"), "spec")
        rows = by_name.unionByName(in_list).withColumns({"kind": F.lit(kind), "order": F.lit(order)})
        out = rows if out is None else out.unionByName(rows)
    prefix = F.regexp_extract("name", "^(connector|agent|mcp):", 1)
    out = out.filter("name is not null").withColumn("type", F.when(prefix != "", prefix).when(F.try_variant_get("spec", "$.role", "string").isNotNull() & F.try_variant_get("spec", "$.prompt", "string").isNotNull(), "agent").otherwise(F.col("kind")))
    out = out.withColumn("name", F.regexp_replace("name", "^(connector|agent|mcp):", ""))
    said = F.coalesce(F.try_variant_get("spec", "$.description", "string"), F.try_variant_get("spec", "$.role", "string"), F.concat(F.col("type"), F.lit(" "), F.col("name"), F.coalesce(F.concat(F.lit(" at "), F.try_variant_get("spec", "$.url", "string")), F.lit(""))))
    first = Window.partitionBy("type", F.lower("name")).orderBy("order", "path")
    return out.withColumn("description", said).withColumn("r", F.row_number().over(first)).filter("r = 1").select("name", "type", "description", T.identifier_parts(F.col("name")).alias("triggers"), "path", F.to_json("spec").alias("spec"))


#: What parts a name from its description, in order of precedence.
LIST_SEPARATORS = (":", "：", "|", "—", "–", " - ")


def _bare(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(name), "^[`\"']+|[`\"']+$", ""))


def read_list(lines: DataFrame) -> DataFrame:
    """name, description of lines (value): bullets and numbers are dropped; the first of the separators, by precedence, that has something before it parts the two."""
    line = F.trim(F.regexp_replace(F.regexp_replace(F.trim("value"), "^[-*+•·]\\s*", ""), "^\\d+[.)、]\\s*", ""))
    rows = lines.select(line.alias("line")).filter("line <> '' and not startswith(line, '#')")
    cut = F.coalesce(*[F.when(F.length(F.trim(F.substring_index("line", sep, 1))) > 0, F.when(F.contains(F.col("line"), F.lit(sep)), F.struct(F.substring_index("line", sep, 1).alias("a"), F.expr(f"substring(line, locate('{sep}', line) + {len(sep)})").alias("b")))) for sep in LIST_SEPARATORS])
    rows = rows.withColumn("cut", cut).select(_bare(F.coalesce("cut.a", "line")).alias("name"), F.trim(F.coalesce("cut.b", F.lit(""))).alias("description"))
    return rows.filter("name <> ''")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """name, description, path, triggers of a JSON list, or of an object's skills, entries, items, list or available_skills, or of one
    object; text items are read as lines of a list. Files that are no JSON give no rows."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ("skills", "entries", "items", "list", "available_skills")], F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    rows = text.filter("v is not null").select(F.explode(items).alias("i"))
    get = lambda *keys, kind="string": F.coalesce(*[F.try_variant_get("i", f"$.{k}", kind) for k in keys])
    is_text = F.schema_of_variant("i") == "STRING"
    listed = F.coalesce(get("triggers", kind="array<string>"), F.split(get("triggers", "trigger"), "[、,，;；/|]+"), T.none())
    objects = rows.filter(~is_text).select(_bare(F.coalesce(*[F.nullif(get(k), F.lit("")) for k in ("name", "title", "skill", "skill_name")])).alias("name"), F.trim(F.coalesce(*[F.nullif(get(k), F.lit("")) for k in ("description", "desc", "summary", "when")], F.lit(""))).alias("description"), F.coalesce(*[F.nullif(get(k), F.lit("")) for k in ("path", "dir", "location")], F.lit("")).alias("path"), F.filter(F.transform(listed, lambda t: F.trim(t)), lambda t: t != "").alias("triggers"))
    texts = read_list(rows.filter(is_text).select(F.try_variant_get("i", "$", "string").alias("value"))).withColumns({"path": F.lit(""), "triggers": T.none()})
    return objects.filter("name <> ''").unionByName(texts)


def stale_share(entries: DataFrame, present: DataFrame) -> DataFrame:
    """share, stale: how many skills with a path are on none of the paths present, and whether they are more than nine in ten;
    null and false for fewer than three. All skills are asked."""
    skills = entries.filter("type = 'skill' and path <> ''").select("path")
    here = skills.join(present.select("path").distinct().withColumn("_here", F.lit(1)), "path", "left").agg(F.count("*").alias("n"), F.count("_here").alias("m"))
    share = F.when(F.col("n") >= 3, 1 - F.col("m") / F.col("n"))
    return here.select(share.alias("share"), F.coalesce(share > 0.9, F.lit(False)).alias("stale"))


def content_files(spark: SparkSession, root: str, rules: tuple[str, ...] = IGNORED, most_bytes: int = FILE_BYTES) -> DataFrame:
    """path, mtime, lines of text files below root; binary, oversized and ignored ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= most_bytes)
    relative = F.expr(f"substring(path, locate('{root.rstrip('/')}', path) + {len(root.rstrip('/')) + 1})")
    files = files.filter(~ignored(relative, F.lit(False), rules)).filter(F.locate("\x00", F.decode(F.substring("content", 1, 8192), "ISO-8859-1")) == 0)
    return files.select("path", F.col("modificationTime").cast("bigint").alias("mtime"), F.split(decoded(F.col("content")), "\r?\n").alias("lines"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """A hit ledger; lines that don't parse are dropped."""
    return spark.read.schema(HIT_EVENT).option("mode", "DROPMALFORMED").json(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE_EVENT).option("mode", "DROPMALFORMED").json(path)


def introspected(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """entities (name, type, description) with gaps in description filled from a document of the name, else by what they are."""
    beside = documents.select(F.lower("name").alias("_low"), F.col("description").alias("_d")).dropDuplicates(["_low"])
    both = entities.join(beside, F.lower("name") == F.col("_low"), "left")
    own = F.when(F.length(F.trim(F.coalesce("description", F.lit("")))) > 0, F.col("description"))
    return both.withColumn("description", F.coalesce(own, "_d", F.concat_ws(" ", "type", "name"))).drop("_low", "_d")


def translated(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """description_zh filled from a dictionary (description, description_zh) where it is empty and the text is not CJK."""
    d = dictionary.select(F.col("description").alias("_k"), F.col("description_zh").alias("_zh")).dropDuplicates(["_k"])
    need = (F.length(F.coalesce("description_zh", F.lit(""))) == 0) & ~F.col("description").rlike("[\\u4e00-\\u9fff]")
    both = entries.join(d, F.col("description") == F.col("_k"), "left")
    return both.withColumn("description_zh", F.when(need & (F.col("_zh") != F.col("description")), F.col("_zh")).otherwise(F.col("description_zh"))).drop("_k", "_zh")
