"""brindle check|run|explain|schema: the engine from the command line over a folder of tables."""

from __future__ import annotations

import argparse
import json
import sys

from brindle.engine import QueryRejected, testdata_engine
from brindle.lang import wire
from brindle.plans import ir
from brindle.session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="brindle", description=__doc__)
    parser.add_argument("action", choices=("check", "run", "explain", "schema"))
    parser.add_argument("query", nargs="?", help="a file with a wire query; standard input without it")
    parser.add_argument("--data", required=True, help="folder of Parquet tables")
    parser.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    engine = testdata_engine(local_session(), args.data)
    if args.action == "schema":
        print(json.dumps(engine.registry.to_dict(), indent=1))
        return 0
    payload = json.load(open(args.query) if args.query else sys.stdin)
    payload = payload.get("query", payload)
    bad = engine.check(payload)
    if bad:
        print(json.dumps({"ok": False, "errors": bad}))
        return 1
    if args.action == "check":
        print(json.dumps({"ok": True, "printed": str(wire.decode(payload))}))
        return 0
    try:
        result = engine.run(payload)
    except QueryRejected as e:
        print(json.dumps({"ok": False, "errors": e.errors}))
        return 1
    if args.action == "explain":
        print(ir.render(result.plan))
        result.frame.explain("formatted")
    else:
        for row in result.frame.limit(args.rows).toJSON().collect():
            print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
