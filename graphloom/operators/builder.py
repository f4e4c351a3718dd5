"""From a schema catalog to a concept graph, without a model unless one is given."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP = re.compile(r"Thought:\s*(.*?)\s*(?:Action:\s*([A-Za-z_]+)\s*)?(?:Action Input:\s*(.*))?$", re.S)
# fixed values: words of refusals by a content filter
FILTERED = ("invalid_prompt", "usage policy", "content_filter", "content management policy", "responsibleaipolicyviolation", "jailbreak")


def parse_step(text: str) -> dict:
    """Thought, action and action input of a step's text; missing parts are None, and JSON input is decoded."""
    m = _STEP.search(text or "")
    if not m:
        return {"thought": None, "action": None, "input": None}
    return {"thought": m[1] or None, "action": m[2], "input": parse_json(m[3]) if m[3] else None}


def parse_steps(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds thought, action and input (as JSON) of each row's step; rows are read where they are."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            steps = [parse_step(x) for x in pdf[text_col]]
            given = [None if s["input"] is None else json.dumps(s["input"], ensure_ascii=False) for s in steps]
            yield pdf.assign(thought=[s["thought"] for s in steps], action=[s["action"] for s in steps], input=given)

    return texts.mapInPandas(run, f"{schema}, thought string, action string, input string")


def parse_json(text: str | None):
    """JSON out of a model's text: code fences are taken off, and a cut end is closed; None if that fails."""
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "").strip()
    at = min((body.find(c) for c in "{[" if c in body), default=-1)
    if at < 0:
        return None
    body = body[at:]
    try:
        return json.JSONDecoder().raw_decode(body)[0]
    except ValueError:
        open_, quoted, skip = [], False, False
        for ch in body:
            if skip:
                skip = False
            elif ch == "\\":
                skip = quoted
            elif ch == '"':
                quoted = not quoted
            elif not quoted and ch in "{[":
                open_.append("}" if ch == "{" else "]")
            elif not quoted and ch in "}]" and open_:
                open_.pop()
        fixed = re.sub(r",\s*$", "", body + '"' * quoted) + "".join(reversed(open_))
        try:
            return json.loads(re.sub(r",\s*([}\]])", r"\1", fixed))
        except ValueError:
            return None


#: Words of errors that pass.  Whole words, but for those that are the beginnings of some: else "generate" would pass for "rate".
_TRANSIENT = re.compile(r"(?<![a-z0-9])(?:timeouts?|connect\w*|resets?|502|503|504|internal|upstream|rate|429|timed out|temporarily)(?![a-z0-9])")


def is_transient(error: Exception | str) -> bool:
    """Whether an error may pass when the call is made again."""
    return bool(_TRANSIENT.search(re.sub(r"([a-z])([A-Z])", r"\1 \2", str(error)).lower()))


def is_filtered(error: Exception | str) -> bool:
    return any(x in str(error).lower() for x in FILTERED)


def container_name(database: str) -> str:
    """A name for a database's graph: lower case, blanks and hyphens as underscores."""
    return re.sub(r"[ -]", "_", database.strip().lower()) or "graph"


def relationship_edges(tables: DataFrame) -> DataFrame:
    """Edges from relationship text such as ``Tbl(Col), Tbl(Col, Col)``: (src_table, dst_table, dst_columns)."""
    found = F.expr(r"regexp_extract_all(relationship_text, r'([A-Za-z_][\\w ]*?)\\s*\\(([^)]*)\\)', 0)".replace("\\\\", "\\"))
    each = tables.where("relationship_text is not null").select("table_name", F.explode(found).alias("part"))
    target = F.trim(F.regexp_extract("part", r"^([^(]*)\(", 1))
    cols = F.transform(F.split(F.regexp_extract("part", r"\(([^)]*)\)", 1), ","), lambda c: F.trim(c))
    return each.select(F.col("table_name").alias("src_table"), target.alias("dst_table"), F.filter(cols, lambda c: c != "").alias("dst_columns")).distinct()


def minimal_nodes(tables: DataFrame) -> DataFrame:
    """A table node for each catalog row, with what the catalog says: the fallback for a table nobody enriched."""
    return tables.select(
        F.concat_ws("__", "database", "table_name").alias("id"), F.lit("Table").alias("label"), "database", F.col("table_name").alias("name"),
        F.initcap(F.regexp_replace("table_name", "[_]+", " ")).alias("display_name"), F.coalesce("description", F.lit("")).alias("description"), "columns", "primary_keys",
    )


def concept_nodes(tables: DataFrame, min_tables: int = 2) -> DataFrame:
    """A concept for each column name that ``min_tables`` tables of a database share, with its source tables."""
    each = tables.select("database", "table_name", F.explode("columns").alias("column"))
    grouped = each.groupBy("database", F.lower("column").alias("column")).agg(F.sort_array(F.collect_set("table_name")).alias("source_tables")).where(F.size("source_tables") >= min_tables)
    return grouped.select(F.concat_ws("__", "database", F.lit("concept"), "column").alias("id"), F.lit("Concept").alias("label"), "database", F.initcap(F.regexp_replace("column", "_", " ")).alias("name"), "source_tables", F.array("column").alias("key_columns"))


def markdown(vertices: DataFrame, edges: DataFrame, description_chars: int = 120) -> str:
    """The graph as text: counts, shared concepts, and a line for each vertex."""
    n = vertices.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()
    shared = vertices.where("label = 'Concept'").where(F.size("source_tables") >= 2).orderBy("name").select("name", F.concat_ws(", ", "source_tables").alias("tables")).collect()
    rows = vertices.orderBy("label", "name").select("label", "name", F.substring(F.coalesce("description", F.lit("")), 1, description_chars).alias("d")).toLocalIterator()
    lines = ["# Concept graph", "", *(f"- {r['label']}: {r['n']}" for r in n), f"- edges: {edges.count()}", "", "## Shared concepts", "", *(f"- {r['name']}: {r['tables']}" for r in shared), "", "## Nodes", ""]
    return "\n".join([*lines, *(f"- **{r['name']}** ({r['label']}): {r['d']}" for r in rows)]) + "\n"
