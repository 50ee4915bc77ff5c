"""Contracts and storage from schema text. A file that cannot be read gives nothing."""

from __future__ import annotations

import json
import re

ENGINES = {"mongodb": "mongodb", "postgresql": "sql", "postgres": "sql", "mysql": "sql", "sqlite": "sql", "sqlserver": "sql", "cockroachdb": "sql"}


def parse_schema(path: str, content: str) -> tuple[list[dict], list[dict]]:
    """(entities with ``fields``, containers with ``attributes``) by extension."""
    ext = path.rpartition(".")[2].lower()
    try:
        if ext in ("sql", "cql"):
            return [], _ddl(path, content)
        if ext == "prisma":
            return [], _prisma(path, content)
        by_ext = {"proto": _proto, "xsd": _xsd, "graphql": _graphql, "gql": _graphql}
        if ext in by_ext:
            return by_ext[ext](path, content), []
        if ext in ("json", "yaml", "yml"):
            data = json.loads(content)
            mapping = _mapping(path, data)
            return ([], mapping) if mapping else (_openapi(path, data, "openapi_json" if ext == "json" else "openapi_yaml"), [])
    except (ValueError, KeyError, TypeError, AttributeError):
        pass
    return [], []


def _entity(path: str, name: str, format_: str, fields: list[dict]) -> dict:
    return {"id": f"{path}:{name}", "name": name, "format": format_, "file": path, "description": "", "fields": fields}


def _field(name: str, raw_type: str, required: bool, many: bool, tag: int = 0) -> dict:
    return {"name": name, "raw_type": raw_type, "is_required": required, "is_list": many, "tag_number": tag}


def _container(path: str, name: str, engine: str, attributes: list[dict]) -> dict:
    return {"id": f"{path}:{name}:{engine}", "name": name, "engine": engine, "file": path, "description": "", "attributes": attributes}


def _attribute(name: str, data_type: str, role: str, nullable: bool, dimension: int | None = None) -> dict:
    return {"name": name, "data_type": data_type, "attribute_role": role, "is_nullable": nullable, "vector_dimension": dimension}


def _proto(path: str, content: str) -> list[dict]:
    out = []
    for name, body in re.findall(r"\bmessage\s+(\w+)\s*\{([^}]*)\}", re.sub(r"//[^\n]*", "", content)):
        rows = re.findall(r"(?:(required|optional|repeated)\s+)?((?:map\s*<[^>]*>)|[\w.]+)\s+(\w+)\s*=\s*(\d+)", body)
        out.append(_entity(path, name, "grpc_proto", [_field(n, t, label == "required", label == "repeated", int(tag)) for label, t, n, tag in rows]))
    return out


def _xsd(path: str, content: str) -> list[dict]:
    out = []
    for name, body in re.findall(r"<(?:\w+:)?complexType\s[^>]*?name=\"([^\"]+)\"[^>]*>(.*?)</(?:\w+:)?complexType>", content, re.S):
        fields = []
        for tag in re.findall(r"<(?:\w+:)?element\s([^>]*?)/>", body, re.S):
            a = dict(re.findall(r"(\w+)=\"([^\"]*)\"", tag))
            low, high = a.get("minOccurs", "1"), a.get("maxOccurs", "1")
            if "name" in a:
                fields.append(_field(a["name"], a.get("type", "xs:string"), not low.isdigit() or int(low) > 0, high == "unbounded" or high.isdigit() and int(high) > 1))
        out.append(_entity(path, name, "xml_xsd", fields))
    return out


def _openapi(path: str, data: dict, format_: str) -> list[dict]:
    schemas = (data.get("components") or {}).get("schemas") or data.get("definitions") or ({data.get("title") or re.sub(r"\..*$", "", path.rpartition("/")[2]): data} if "properties" in data else {})
    out = []
    for name, schema in schemas.items():
        required = set(schema.get("required") or [])
        kind = lambda p: p.get("type") or str(p.get("$ref", "")).rpartition("/")[2] or "object"
        out.append(_entity(path, name, format_, [_field(n, kind(p), n in required, p.get("type") == "array") for n, p in (schema.get("properties") or {}).items()]))
    return out


def _ddl(path: str, content: str) -> list[dict]:
    out = []
    for name, body in re.findall(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?([\w.]+)[`\"\]]?\s*\((.*?)\)\s*;", content, re.I | re.S):
        attributes = []
        for line in body.split("\n"):
            line = line.strip().rstrip(",")
            m = re.match(r"[`\"\[]?(\w+)[`\"\]]?\s+([A-Za-z]+(?:\s*\([^)]*\))?)", line)
            if not m or re.match(r"(?:CONSTRAINT|PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|INDEX|KEY)\b", line, re.I):
                continue
            key = bool(re.search(r"PRIMARY\s+KEY", line, re.I))
            attributes.append(_attribute(m[1], m[2].upper(), "primary_key" if key else "column", not (key or re.search(r"NOT\s+NULL", line, re.I))))
        out.append(_container(path, name, "sql", attributes))
    return out


def _prisma(path: str, content: str) -> list[dict]:
    provider = re.search(r"datasource\s+\w+\s*\{[^}]*?provider\s*=\s*\"(\w+)\"", content)
    engine, out = ENGINES.get(provider[1] if provider else "", "sql"), []
    for name, body in re.findall(r"\bmodel\s+(\w+)\s*\{([^}]*)\}", content):
        rows = [m for line in body.split("\n") if (m := re.match(r"\s*(\w+)\s+(\w+)(\[\])?(\?)?(.*)", line)) and not line.strip().startswith(("@@", "//"))]
        out.append(_container(path, name, engine, [_attribute(m[1], m[2], "primary_key" if "@id" in m[5] else "foreign_key" if "@relation" in m[5] else "column", bool(m[4])) for m in rows]))
    return out


def _graphql(path: str, content: str) -> list[dict]:
    out = []
    for name, body in re.findall(r"\b(?:type|input|interface)\s+(\w+)[^{]*\{([^}]*)\}", re.sub(r"#[^\n]*", "", content)):
        if name not in ("Query", "Mutation", "Subscription"):
            rows = re.findall(r"(\w+)\s*(?:\([^)]*\))?\s*:\s*([\[\]\w!]+)", body)
            out.append(_entity(path, name, "graphql_sdl", [_field(n, re.sub(r"[\[\]!]", "", t), t.endswith("!"), t.startswith("[")) for n, t in rows]))
    return out


def _mapping(path: str, data: dict) -> list[dict]:
    properties = (data.get("mappings") or {}).get("properties") or (data.get("properties") if re.search("mapping", path, re.I) else None)
    if not properties:
        return []
    role = lambda t: "vector" if "vector" in t else t if t in ("keyword", "text") else "column"
    name = re.sub(r"[.-]?(?:mappings?|elasticsearch)?\.\w+$", "", path.rpartition("/")[2], flags=re.I) or "index"
    return [_container(path, name, "elasticsearch", [_attribute(n, p.get("type", "object"), role(p.get("type", "object")), True, p.get("dims")) for n, p in properties.items()])]


def _braces(text: str, at: int) -> str:
    """What stands between the brace at this place and its partner."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if not depth:
            return text[at + 1 : k]
    return text[at + 1 :]


def parse_mongoose(path: str, content: str) -> list[dict]:
    """Schemas of an object mapper in code; for files that import one."""
    out = []
    for m in re.finditer(r"(\w+)Schema\s*=\s*new\s+(?:\w+\.)?Schema\s*(?:<[^>]*>)?\(\s*(?=\{)", content):
        name, body = m[1], _braces(content, m.end())
        rows = re.findall(r"(\w+)\s*:\s*(\{[^{}]*\}|\[[^\]]*\]|[\w.]+)", body)
        kind = lambda t: next((k for k in ("String", "Number", "Boolean", "Date") if k in t), "Mixed")
        fields = [_attribute(n, kind(t), "column", "required: true" not in t) for n, t in rows]
        out.append(_container(path, name.lower() + "s", "mongodb", [_attribute("_id", "ObjectId", "primary_key", False), *fields]))
    return out


MAPPERS = ("mongoose", "mongodb", "sequelize", "typeorm", "prisma")
