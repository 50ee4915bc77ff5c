"""Schemas of node and edge tables. Arrays are arrays, and edges are derived from raw references."""

from __future__ import annotations

FILES = "path string, language string, hash string, line_count int, size long, is_test boolean, mtime_ms double, library_aliases array<struct<alias:string,module:string>>"
SYMBOLS = "id string, name string, qname string, kind string, file string, start_line int, end_line int, signature string, docstring string, is_exported boolean, visibility string, structural_hash string"
RAW_CALLS = "caller_id string, callee_name string, callee_qname string, file string, line int"
RAW_IMPORTS = "src_path string, imported_path string, candidates array<string>, specifiers array<string>"
RAW_HERITAGE = "sub_id string, super_name string, rel string, file string"
CALLS = "src_id string, dst_id string, dst_external string, line int, cnt long, callee_name string, callee_qname string"
IMPORTS = "src_path string, dst_path string, is_external boolean, specifiers array<string>, imported_path string"
HERITAGE = "sub_id string, super_id string, super_name string, rel string, is_external boolean"
DOCUMENTS = "path string, title string, category string, hash string"
SECTIONS = "id string, document_path string, title string, content string, level int, start_line int, end_line int, referenced_symbols array<string>"
RULES = "id string, title string, content string, priority string, source_doc string"
CONTRACT_ENTITIES = "id string, name string, format string, file string, description string"
CONTRACT_FIELDS = "id string, entity_id string, name string, raw_type string, is_required boolean, is_list boolean, tag_number int, file string"
STORAGE_CONTAINERS = "id string, name string, engine string, file string, description string"
STORAGE_ATTRIBUTES = "id string, container_id string, name string, data_type string, attribute_role string, is_nullable boolean, vector_dimension int, file string"
MANIFEST = "path string, hash string, size long, mtime_ms double"
TABLES = {
    "files": FILES, "symbols": SYMBOLS, "raw_calls": RAW_CALLS, "raw_imports": RAW_IMPORTS, "raw_heritage": RAW_HERITAGE, "documents": DOCUMENTS, "sections": SECTIONS, "rules": RULES,
    "contract_entities": CONTRACT_ENTITIES, "contract_fields": CONTRACT_FIELDS, "storage_containers": STORAGE_CONTAINERS, "storage_attributes": STORAGE_ATTRIBUTES,
    "manifest": MANIFEST,
}
#: The column of each table that names the path a row came from: what a change of that path replaces. The manifest has every path that was read.
PATH_KEY = {
    "files": "path", "symbols": "file", "raw_calls": "file", "raw_imports": "src_path", "raw_heritage": "file", "documents": "path", "sections": "document_path", "rules": "source_doc",
    "contract_entities": "file", "contract_fields": "file", "storage_containers": "file", "storage_attributes": "file", "manifest": "path",
}
