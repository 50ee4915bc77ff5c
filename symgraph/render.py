"""Markdown of results. Only here are rows collected, at most ``most`` of each table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TITLES = {
    "status": "Index", "explore": "Architecture", "symbol_definition": "Definition", "blast_radius": "Impact", "callers": "Callers", "callees": "Callees", "affected_tests": "Affected tests", "detect_cycles": "Import cycles", "porting_contract": "Porting contract", "knowledge_search": "Documentation", "knowledge_doc": "Document",
    "cypher": "Query", "call_path": "Call path", "subtypes": "Subtypes", "search_symbols": "Symbols", "unused_symbols": "Unused symbols", "git_diff_impact": "Impact of the diff", "cross_paradigm_blueprint": "Blueprint", "third_party_slice": "Library use", "similar_functions": "Similar functions", "spec_code_flow": "From specification to code",
    "symbol_spec_features": "From code to specification", "contract_storage_mapping": "Contract and storage", "storage_migration_impact": "Migration impact", "sync": "Index",
}


def rows_as_table(df: DataFrame, most: int = 20) -> str:
    columns, rows = df.columns, df.limit(most + 1).collect()
    if not rows:
        return "_none_"
    cell = lambda v: "" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v).replace("|", "\\|").replace("\n", " ")[:200]
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows[:most])]
    return "\n".join(lines + ([f"_more than {most} rows_"] if len(rows) > most else []))


def mermaid(edges: DataFrame, most: int = 200) -> str:
    return "\n".join(["```mermaid", "graph TD", *(f"  {r['line']}" for r in edges.orderBy("line").limit(most).collect()), "```"])


def render(action: str, result, most: int = 20) -> dict[str, str]:
    """``{kind, action, content}``"""
    parts = [f"## {TITLES.get(action, action)}"]
    if isinstance(result, DataFrame):
        parts.append(rows_as_table(result, most))
    elif isinstance(result, dict):
        for name, value in result.items():
            parts.append(f"### {name.replace('_', ' ')}")
            if isinstance(value, DataFrame):
                parts.append(mermaid(value) if name == "edges" else rows_as_table(value.select(*[F.col(c) for c in value.columns if not c.startswith("_")]), most))
            else:
                parts.append(f"```\n{value}\n```" if name == "skeleton" else ", ".join(map(str, value)) if isinstance(value, list) else str(value))
    else:
        parts.append(str(result))
    return {"kind": "markdown", "action": action, "content": "\n\n".join(parts)}
