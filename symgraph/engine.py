"""All named questions behind one call, by action or alias."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .operators import code, impact, knowledge, porting, storage
from .parsers.diff import HUNKS, working_tree
from .plans import pattern, sqlapi
from .plans.graph import SymGraph, build
from .render import render
from .sources.warehouse import Warehouse
from .streaming.watch import Watcher, index_once

#: Other names of the actions (fixed values).
ALIASES = {
    "status": [], "sync": [],
    "explore": ["code_get_architecture_overview", "code_explore"],
    "symbol_definition": ["code_get_symbol_definition_and_signature", "code_symbol_definition"],
    "blast_radius": ["code_analyze_refactor_blast_radius", "code_blast_radius"],
    "callers": ["code_find_function_callers", "code_function_callers", "code_callers"],
    "callees": ["code_find_function_callees", "code_function_callees", "code_callees"],
    "detect_cycles": ["code_detect_circular_dependencies", "code_detect_cycles"],
    "affected_tests": ["code_find_affected_test_files", "code_affected_tests"],
    "porting_contract": ["code_extract_symbol_porting_contract", "code_porting_contract"],
    "call_path": ["code_find_call_path_between_symbols", "code_call_path", "code_trace_call_path"],
    "subtypes": ["code_find_implementations_and_subtypes", "code_subtypes", "code_implementations"],
    "search_symbols": ["code_search_symbols_by_pattern", "code_search_symbols"],
    "unused_symbols": ["code_find_unused_dead_symbols", "code_unused_symbols", "code_dead_code"],
    "git_diff_impact": ["code_analyze_git_diff_semantic_impact", "code_git_diff_impact", "code_audit_git_diff"],
    "cross_paradigm_blueprint": ["code_generate_cross_paradigm_porting_blueprint", "code_oop_to_rust", "code_port_to_rust", "code_rust_to_oop"],
    "third_party_slice": ["code_extract_third_party_usage_slice", "code_library_slice", "code_slim_polyfill", "code_find_library_equivalent"],
    "similar_functions": ["code_find_similar_duplicate_functions", "code_find_duplicates", "code_code_clones"],
    "spec_code_flow": ["spec_find_code_flow_for_feature", "spec_to_code_flow", "feature_code_flow", "code_feature_flow"],
    "symbol_spec_features": ["spec_find_features_for_symbol", "code_find_spec_features_for_symbol", "code_to_spec_features", "symbol_feature_specs", "feature_for_symbol"],
    "contract_storage_mapping": ["schema_map_contract_to_storage", "schema_map_contract", "contract_to_db", "map_contract_to_storage"],
    "storage_migration_impact": ["schema_analyze_storage_migration_impact", "schema_migration_impact", "db_migration_blast_radius"],
    "knowledge_search": ["knowledge_search_documentation_and_rules"],
    "knowledge_doc": ["knowledge_get_document_content_and_rules"],
    "cypher": [],
}
_ACTION = {name: action for action, names in ALIASES.items() for name in [action, *names]}


class Engine:
    """A workspace, its stored facts and the questions about it. Results are DataFrames, or dicts of them."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root, config or Config()
        self.warehouse = Warehouse(spark, self.config.warehouse)
        self.watcher = Watcher(spark, self.warehouse, self.config.max_file_size, list(self.config.ignored))
        self._graph: tuple[str | None, SymGraph] | None = None

    @property
    def graph(self) -> SymGraph:
        """Of the current version: whoever wrote it, the next question sees it."""
        version = self.warehouse.version()
        if self._graph is None or self._graph[0] != version:
            self._graph = version, build(self.warehouse.read(version))
        return self._graph[1]

    def index(self) -> SymGraph:
        return index_once(self.spark, self.root, self.warehouse, self.config.max_file_size, list(self.config.ignored))

    def rescan(self) -> dict[str, int]:
        return self.watcher.rescan(self.root)

    def watch(self, events: DataFrame, checkpoint: str):
        """Catch up, then follow a stream of events until it is idle for the time that the settings allow."""
        self.rescan()
        query = self.watcher.start(events, checkpoint, self.config.debounce_seconds)
        self.watcher.stop_when_idle(query, self.config.idle_minutes)
        return query

    def ask(self, name: str, **a):
        action = _ACTION.get(name)
        if action is None:
            raise ValueError(f"unknown action: {name}")
        return getattr(self, f"_{action}")(**a)

    def markdown(self, name: str, **a) -> dict[str, str]:
        return render(_ACTION.get(name, name), self.ask(name, **a))

    def _status(self):
        return code.stats(self.graph)

    def _sync(self):
        self.index()
        return code.stats(self.graph)

    def _explore(self, limit: int = 25):
        return code.explore(self.graph, limit)

    def _symbol_definition(self, name: str, file: str | None = None):
        return code.definition(self.graph.symbols, name, file)

    def _blast_radius(self, symbol: str, depth=None):
        return impact.blast_radius(self.graph, symbol, self.config.blast_depth if depth is None else depth)

    def _callers(self, symbol: str):
        return code.callers(self.graph, symbol)

    def _callees(self, symbol: str):
        return code.callees(self.graph, symbol)

    def _detect_cycles(self, limit: int | None = 20, canonical: bool = False):
        return impact.detect_cycles(self.graph, limit, canonical)

    def _affected_tests(self, files: list[str]):
        return impact.affected_tests(self.graph, self.spark.createDataFrame([(f,) for f in files], "file string"))

    def _porting_contract(self, symbol: str):
        return porting.porting_contract(self.graph, symbol)

    def _call_path(self, source: str, target: str):
        return impact.path_nodes(self.graph, impact.call_path(self.graph, source, target))

    def _subtypes(self, symbol: str):
        return code.subtypes(self.graph, symbol)

    def _search_symbols(self, pattern: str, kind: str | None = None, limit: int = 25):
        return code.search_symbols(self.graph.symbols, pattern, kind, limit)

    def _unused_symbols(self, limit: int = 50, include_exported: bool = False):
        return code.unused_symbols(self.graph, limit, include_exported)

    def _git_diff_impact(self, base: str | None = None):
        return impact.diff_impact(self.graph, self.spark.createDataFrame(working_tree(self.root, base), HUNKS))

    def _cross_paradigm_blueprint(self, symbol: str, target: str = "rust"):
        return porting.blueprint(self.graph, symbol, target)

    def _third_party_slice(self, prefix: str, target: str = "rust"):
        return porting.third_party_slice(self.graph, prefix, target)

    def _similar_functions(self, symbol: str | None = None, min_lines: int = 3):
        return code.similar_functions(self.graph.symbols, symbol, min_lines)

    def _spec_code_flow(self, query: str, depth=3):
        return knowledge.spec_code_flow(self.graph, query, depth)

    def _symbol_spec_features(self, symbol: str, search_callers: bool = True):
        return knowledge.symbol_spec_features(self.graph, symbol, search_callers)

    def _contract_storage_mapping(self, contract: str, target: str | None = None, engine: str | None = None):
        return storage.contract_storage_mapping(self.graph, contract, target, engine)

    def _storage_migration_impact(self, container: str, attribute: str, action: str = "drop"):
        return storage.storage_migration_impact(self.graph, container, attribute, action)

    def _knowledge_search(self, query: str, limit: int = 10):
        return knowledge.knowledge_search(self.graph, query, limit)

    def _knowledge_doc(self, path_or_title: str):
        return knowledge.knowledge_doc(self.graph, path_or_title)

    def _cypher(self, query: str, **parameters) -> DataFrame:
        """A pattern query if it begins with MATCH, else SQL over the views."""
        return (pattern.match if query.lstrip().upper().startswith("MATCH") else sqlapi.sql)(self.spark, self.graph, query, **parameters)
