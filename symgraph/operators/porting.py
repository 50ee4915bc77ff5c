"""Porting: a symbol's contract, a skeleton in another paradigm, and what is used of a library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import SymGraph, name_or_qname
from .code import definition
from .impact import affected_tests

LANGUAGES = {"py": "python", "go": "go", "rs": "rust"}
#: Category by key word, and the usual package by target language (fixed values).
EQUIVALENTS = {
    "jwt": {"rust": "jsonwebtoken", "go": "github.com/golang-jwt/jwt/v5", "java": "io.jsonwebtoken:jjwt-api", "typescript": "jsonwebtoken", "python": "pyjwt"},
    "cache": {"rust": "moka", "go": "github.com/allegro/bigcache/v3", "java": "com.github.ben-manes.caffeine:caffeine", "typescript": "lru-cache", "python": "cachetools"},
    "http": {"rust": "reqwest", "go": "github.com/go-resty/resty/v2", "java": "com.squareup.okhttp3:okhttp", "typescript": "axios", "python": "httpx"},
    "json": {"rust": "serde", "go": "encoding/json", "java": "com.fasterxml.jackson.core:jackson-databind", "typescript": "zod", "python": "pydantic"},
}
#: Where a package's call has another name (fixed values).
RENAMED_CALLS = {"moka": {"put": "insert"}}


def members_of(symbols: DataFrame, owner: DataFrame) -> DataFrame:
    """Symbols of the owner's file whose qname begins with the owner's name and a dot; ``owner``: one row."""
    o = owner.select(F.col("name").alias("_on"), F.col("file").alias("_of"), F.col("id").alias("_oi"))
    return symbols.join(o, (F.col("file") == F.col("_of")) & F.col("qname").startswith(F.concat("_on", F.lit("."))) & (F.col("id") != F.col("_oi"))).drop("_on", "_of", "_oi")


def porting_contract(g: SymGraph, wanted: str) -> dict[str, DataFrame]:
    own = definition(g.symbols, wanted)
    members = members_of(g.symbols, own)
    scope = own.select("id", "kind").unionByName(members.select("id", "kind"))
    # of a class or interface the calls of its members count, of anything else its own
    calls = g.calls.join(scope.select(F.col("id").alias("_c")), F.col("src_id") == F.col("_c"), "left_semi").join(scope.select(F.col("id").alias("_c2")), F.coalesce("dst_id", F.lit("")) == F.col("_c2"), "left_anti")
    callees = calls.groupBy("callee_name", F.col("dst_id").isNull().alias("is_external")).agg(F.sum("cnt").alias("calls")).orderBy(F.desc("calls"), "callee_name")
    name, file = own.select(F.col("name").alias("_n")), own.select(F.col("file").alias("_f"))
    supers = g.heritage.join(own.select(F.col("id").alias("_i")), F.col("sub_id") == F.col("_i"), "left_semi").select("super_name", "rel", "is_external").distinct()
    out = {
        "definition": own.withColumn("language", F.coalesce(*[F.when(F.col("file").endswith(f".{k}"), F.lit(v)) for k, v in LANGUAGES.items()], F.lit("typescript"))),
        "callees": callees, "members": members, "supertypes": supers,
        "tests": affected_tests(g, own.select("file")).select("test_path").distinct(),
        "imports": g.imports.join(file, F.col("src_path") == F.col("_f"), "left_semi").orderBy("imported_path", "dst_path").limit(50),
    }
    if g.rules is not None:
        out["rules"] = g.rules.join(name, F.col("content").contains(F.col("_n")) | F.col("title").contains(F.col("_n")), "left_semi")
    return out


def blueprint(g: SymGraph, wanted: str, target: str = "rust") -> dict:
    """A skeleton in the target's paradigm from a symbol's members and supertypes, which are the few rows that are collected."""
    contract = porting_contract(g, wanted)
    own = contract["definition"].first()
    if own is None:
        return {}
    name, error = own["name"], own["name"] if own["name"].endswith("Error") else own["name"] + "Error"
    methods = [(r["name"], any(w in (r["signature"] or "").lower() for w in ("set", "update", "mutate"))) for r in contract["members"].where("kind in ('method', 'function')").orderBy("start_line", "id").select("name", "signature").collect()]
    fields = [r["name"] for r in contract["members"].where("kind in ('variable', 'constant')").orderBy("start_line", "id").select("name").collect()]
    traits = [r["super_name"] for r in contract["supertypes"].orderBy("super_name").collect()]
    return {"name": name, "target": target, "methods": methods, "fields": fields, "traits": traits, "error_enum": error, "guidelines": GUIDELINES.get(target, GUIDELINES["c#"]), "skeleton": skeleton(target, name, methods, fields, traits, error)}


GUIDELINES = {
    "rust": ["Prefer composition and traits to inheritance.", "Return Result with an error enum instead of throwing.", "Take &self to read and &mut self to change."],
    "go": ["Embed structs instead of inheriting.", "Keep interfaces small and on the consumer's side.", "Return errors as values."],
    "java": ["One public class a file.", "Implement interfaces for each role.", "Throw checked exceptions of a type of your own."],
    "c#": ["Implement interfaces for each role.", "Expose properties instead of fields.", "Throw exceptions of a type of your own."],
}


def skeleton(target: str, name: str, methods: list, fields: list, traits: list, error: str) -> str:
    if target == "rust":
        body = [f"pub struct {name} {{", *[f"    {f}: (),  // field" for f in fields], "}", "", f"pub enum {error} {{", "    Failed(String),", "}"]
        body += [line for t in traits for line in ("", f"pub trait {t} {{}}", f"impl {t} for {name} {{}}")]
        return "\n".join([*body, "", f"impl {name} {{", *[f"    pub fn {m}({'&mut self' if mut else '&self'}) -> Result<(), {error}> {{ todo!() }}" for m, mut in methods], "}"])
    if target == "go":
        return "\n".join([f"type {name} struct {{", *[f"\t{t}" for t in traits], *[f"\t{f} any" for f in fields], "}", "", f"type {error} struct{{ Reason string }}", *[f"\nfunc (x *{name}) {m[:1].upper() + m[1:]}() error {{ return nil }}" for m, _ in methods]])
    head = f"public class {name}" + ((" implements " if target == "java" else " : ") + ", ".join(traits) if traits else "")
    return "\n".join([head + " {", *[f"    private object {f};" for f in fields], *[f"    public void {m if target == 'java' else m[:1].upper() + m[1:]}() {{ throw new {error}(); }}" for m, _ in methods], "}"])


def recommend(prefix: str, target: str) -> str | None:
    return next((packages.get(target) for key, packages in EQUIVALENTS.items() if key in prefix.lower()), None)


def third_party_slice(g: SymGraph, prefix: str, target: str = "rust") -> dict[str, DataFrame]:
    """``usage``: calls of what the files import from modules that hold the prefix, by name: call edges, call sites, files, first line; ``summary``: one row.

    A call counts if its name, or its receiver, is a binding of such an import or an alias made from one.
    Without any call the imported names count once each.
    """
    imports = g.imports.where(F.col("imported_path").contains(prefix) | F.col("dst_path").contains(prefix))
    bound = imports.select(F.col("src_path").alias("file"), F.explode("specifiers").alias("binding")).where("binding <> '*'").distinct()
    alias = g.files.select(F.col("path").alias("file"), F.explode("library_aliases").alias("a")).where(F.col("a.module").contains(prefix) | F.lit(prefix).contains(F.col("a.module"))).select("file", F.col("a.alias").alias("binding"))
    files = imports.select(F.col("src_path").alias("_f")).distinct()
    calls = g.calls.join(g.symbols.select(F.col("id").alias("_i"), "file"), F.col("src_id") == F.col("_i")).join(files, F.col("file") == F.col("_f"), "left_semi")
    calls = calls.select("src_id", "dst_id", "file", "line", "cnt", "callee_name", F.when(F.col("callee_qname").contains("."), F.substring_index("callee_qname", ".", 1)).alias("receiver"))
    names = bound.unionByName(alias).distinct()
    by_name = calls.join(bound, (calls["file"] == bound["file"]) & (F.col("callee_name") == F.col("binding")), "left_semi")
    by_receiver = calls.join(names, (calls["file"] == names["file"]) & (F.col("receiver") == F.col("binding")), "left_semi")
    used = by_name.union(by_receiver).distinct().groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("call_edges"), F.sum("cnt").alias("call_sites"), F.array_sort(F.collect_set("file")).alias("files"), F.min("line").alias("first_line"))
    imported = bound.groupBy(F.col("binding").alias("name")).agg(F.lit(1).cast("long").alias("call_edges"), F.lit(1).cast("long").alias("call_sites"), F.array_sort(F.collect_set("file")).alias("files"), F.lit(None).cast("int").alias("first_line"))
    any_used = used.agg((F.count("*") > 0).alias("_any"))
    usage = used.unionByName(imported.crossJoin(any_used).where("not _any").drop("_any"))
    package = recommend(prefix, target)
    renamed = RENAMED_CALLS.get(package or "", {})
    as_ = F.col("name")
    for old, new in renamed.items():
        as_ = F.when(F.col("name") == old, new).otherwise(as_)
    summary = usage.agg(F.count("*").alias("names")).select("names", F.greatest(F.lit(30), F.col("names") * 20).alias("estimated_lines"), F.lit(package).alias("recommended_package"))
    return {"usage": usage.withColumn("target_name", as_), "summary": summary}
