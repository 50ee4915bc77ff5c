"""Whatever is added, changed and deleted, by rescans or by streams of events, the stored graph equals a full index."""

import os
import random

import pytest

from symgraph import schemas
from symgraph.config import Config
from symgraph.engine import Engine
from symgraph.streaming.watch import EVENTS, Watcher
from symgraph.sources.warehouse import Warehouse

#: Several versions of each path: code whose types and members live apart, documents, schemas, and one too large to be read.
VERSIONS = {
    "core/types.rs": ["pub struct Pump { rate: i32 }\npub trait Flow { fn open(&self); }\n", "pub trait Flow { fn open(&self); fn shut(&self); }\n"],
    "core/pump.rs": ["impl Flow for Pump {\n    fn open(&self) { turn(); }\n}\n", "impl Flow for Pump {\n    fn open(&self) { turn(); spin(); }\n    fn shut(&self) { }\n}\n"],
    "core/wheel.py": ["from core.axle import spin\nclass Wheel(Axle):\n    def turn(self):\n        return spin()\n", "def turn():\n    return 1\n"],
    "core/axle.py": ["class Axle:\n    pass\ndef spin():\n    return 2\n"],
    "doc/wheel.md": ["# Wheel\nSee `Wheel` and turn().\n- it MUST turn\n", "# Wheel\nNothing.\n## More\n`spin`\n"],
    "db/wheels.sql": ["CREATE TABLE wheels (\n  id SERIAL PRIMARY KEY,\n  size INTEGER NOT NULL\n);\n", "CREATE TABLE wheels (\n  id SERIAL PRIMARY KEY\n);\nCREATE TABLE axles (\n  id INTEGER\n);\n"],
    "db/wheel.proto": ["message Wheel {\n  string id = 1;\n  int32 size = 2;\n}\n"],
    "core/big.py": ["def small():\n    pass\n", "def large():\n    pass\n" + "# filler\n" * 400],
    "skip/me.py": ["def never():\n    pass\n"],
}
CONFIG = {"max_file_size": 2000, "ignored": ["skip"]}


def stored(warehouse):
    """All facts but times, as sorted rows."""
    out = {}
    for name, t in warehouse.read().items():
        out[name] = sorted(str(r) for r in t.drop("mtime_ms").collect())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_sequence_equals_a_full_index(spark, tmp_path, seed):
    rng, root = random.Random(seed), tmp_path / "ws"
    here: dict[str, str] = {}
    clock = 1_700_000_000

    def put(path, content):
        nonlocal clock
        clock += 10
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(content)
        os.utime(file, (clock, clock))
        here[path] = content

    for path, texts in VERSIONS.items():
        put(path, texts[0])
    engine = Engine(spark, str(root), Config(warehouse=str(tmp_path / "wh"), max_file_size=CONFIG["max_file_size"], ignored=tuple(CONFIG["ignored"])))
    engine.index()
    assert engine.rescan() == {}
    seq = 0
    for step in range(4):
        events = []
        for path in rng.sample(sorted(VERSIONS), rng.randint(1, 4)):
            seq += 1
            if path in here and rng.random() < 0.4:
                (root / path).unlink()
                del here[path]
                events.append((path, seq, "unlink", None))
            else:
                put(path, rng.choice(VERSIONS[path]))
                events.append((path, seq, "change", here[path]))
        if step % 2:
            engine.watcher.apply(spark.createDataFrame(events, EVENTS))
        else:
            engine.rescan()
    full = Engine(spark, str(root), Config(warehouse=str(tmp_path / f"full{seed}"), max_file_size=CONFIG["max_file_size"], ignored=tuple(CONFIG["ignored"])))
    full.index()
    have, want = stored(engine.warehouse), stored(full.warehouse)
    assert {k: v for k, v in have.items() if v != want[k]} == {k: v for k, v in want.items() if v != have[k]} == {}
    assert set(have) == set(schemas.TABLES)
    edges = lambda e: sorted(str(r) for r in e.graph.heritage.collect())
    assert edges(engine) == edges(full)


def test_versions(spark, tmp_path):
    """A reader of an earlier version is not disturbed; buckets that a change does not touch keep their folder; old versions go."""
    root = tmp_path / "ws"
    for path in ("core/axle.py", "core/wheel.py", "core/types.rs", "core/pump.rs", "db/wheels.sql"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(VERSIONS[path][0])
    warehouse = Warehouse(spark, str(tmp_path / "wh"))
    assert warehouse.version() is None and warehouse.read()["symbols"].count() == 0
    engine = Engine(spark, str(root), Config(warehouse=str(tmp_path / "wh")))
    engine.index()
    first, old = warehouse.version(), engine.graph
    before = old.symbols.count()
    watcher = Watcher(spark, warehouse)
    assert old.heritage.where("not is_external").count() == 2
    watcher.apply(spark.createDataFrame([("core/new.py", 1, "add", "def fresh():\n    pass\n")], EVENTS))
    second = warehouse.version()
    assert second > first and old.symbols.count() == before  # still there
    assert engine.graph.symbols.count() == before + 1  # the next question sees the new version
    assert engine.graph.heritage.where("not is_external").count() == 2  # of files that did not change
    changed = {k for k, v in warehouse._layout(second).items() if warehouse._layout(first).get(k) != v}
    assert changed == {str(b) for b in warehouse.touched(spark.createDataFrame([("core/new.py",)], "path string"))}
    for i in range(4):
        watcher.apply(spark.createDataFrame([("core/new.py", 2 + i, "change", f"def fresh{i}():\n    pass\n")], EVENTS))
    assert first not in warehouse._names("versions") and len([n for n in warehouse._names("versions") if n.startswith("v")]) == 3
    assert engine.graph.symbols.count() == before + 1
    os.remove(root / "db/wheels.sql")
    counts = watcher.rescan(str(root))
    assert counts == {"deleted": 2} and warehouse.read()["storage_containers"].count() == 0 == warehouse.read()["storage_attributes"].count()


def test_untracked_files_only_without_a_base(tmp_path):
    import subprocess

    from symgraph.parsers.diff import working_tree

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "b.py").write_text("z = 3\n")
    assert {r["file"] for r in working_tree(str(tmp_path))} == {"a.py", "b.py"}
    assert {r["file"] for r in working_tree(str(tmp_path), "HEAD")} == {"a.py"}
    assert working_tree(str(tmp_path / "nowhere")) == []
