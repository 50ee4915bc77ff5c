"""Unified diffs."""

from __future__ import annotations

import re
import subprocess

HUNKS = "file string, change_type string, start int, end int"


def parse_unified_diff(text: str) -> list[dict]:
    """A row per new-side range: (file, change_type, start, end). Added and deleted files without ranges have one row of nulls; a modified file without any is left out."""
    out: list[dict] = []
    for block in re.split(r"(?m)^diff --git ", text)[1:]:
        new, old = re.search(r"(?m)^\+\+\+ (?:b/)?(.+?)\t?$", block), re.search(r"(?m)^--- (?:a/)?(.+?)\t?$", block)
        named = re.match(r"a/(.+?) b/(.+)", block)
        kind = "added" if re.search(r"(?m)^new file mode|^--- /dev/null", block) else "deleted" if re.search(r"(?m)^deleted file mode|^\+\+\+ /dev/null", block) else "modified"
        file = (old if kind == "deleted" else new)
        path = file[1] if file and file[1] != "/dev/null" else named[2] if named else None
        if path is None:
            continue
        ranges = [(int(a), int(a) + n - 1) for a, b in re.findall(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", block) if (n := int(b) if b else 1) > 0]
        if ranges:
            out += [{"file": path, "change_type": kind, "start": a, "end": b} for a, b in ranges]
        elif kind != "modified":
            out.append({"file": path, "change_type": kind, "start": None, "end": None})
    return out


def working_tree(folder: str, base: str | None = None) -> list[dict]:
    """The diff against ``base``, or against HEAD with untracked files; nothing if git fails."""
    run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, timeout=60)
    try:
        got = run("diff", base or "HEAD")
        if got.returncode and base is None:
            got = run("diff")
        if got.returncode:
            return []
        untracked = [] if base else [x[3:] for x in run("status", "--porcelain").stdout.splitlines() if x.startswith("?? ")]
    except (OSError, subprocess.SubprocessError):
        return []
    return parse_unified_diff(got.stdout) + [{"file": f, "change_type": "added", "start": None, "end": None} for f in untracked]
