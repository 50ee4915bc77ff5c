"""python -m symgraph index|rescan|ask ROOT [ACTION [KEY=VALUE ...]]"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .config import Config
from .engine import Engine
from .shipping import ship


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("index", "rescan", "ask"):
        print(__doc__)
        return 2
    engine = Engine(ship(SparkSession.builder.appName("symgraph").getOrCreate()), args[1], Config(warehouse=f"{args[1].rstrip('/')}/.symgraph"))
    if args[0] == "index":
        engine.index()
        print(engine.markdown("status")["content"])
    elif args[0] == "rescan":
        print(engine.rescan())
    else:
        values = dict(x.split("=", 1) for x in args[3:])
        print(engine.markdown(args[2], **{k: int(v) if v.isdigit() else v.split(",") if k == "files" else v for k, v in values.items()})["content"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
