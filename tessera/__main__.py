"""Command line: `python -m tessera -d FOLDER [-e SQL | -f FILE]`, or a prompt where neither is given."""

from __future__ import annotations

import argparse
import json
import sys
from typing import TextIO

from tessera.engine import Engine
from tessera.session import session

HELP = """statements end with ;
:tables  :schema T  :explain Q  :plan Q  :profile T  :sample T [N]  :export KIND PATH QUERY  :snapshot N  :restore N  :checkpoint  :drop T  :alter ...  :history  :help  :quit"""
SHOWN = 100


def show(result: object, out: TextIO) -> None:
    """Prints a result: rows up to SHOWN, or the count of affected rows."""
    if isinstance(result, int):
        print(f"{result} rows", file=out)
        return
    rows = result.limit(SHOWN + 1).collect()
    print("\t".join(result.columns), file=out)
    for r in rows[:SHOWN]:
        print("\t".join("NULL" if v is None else str(v) for v in r), file=out)
    if len(rows) > SHOWN:
        print(f"(the first {SHOWN} rows; :export writes all)", file=out)


def command(engine: Engine, line: str, out: TextIO) -> bool:
    """Runs one `:` command; False ends the prompt."""
    word, _, rest = line[1:].strip().partition(" ")
    rest = rest.strip().rstrip(";")
    statements = {"snapshot": "CREATE SNAPSHOT ", "restore": "RESTORE TO SNAPSHOT ", "checkpoint": "CHECKPOINT ", "drop": "DROP TABLE ", "alter": "ALTER TABLE ", "explain": "EXPLAIN "}
    if word in ("quit", "q"):
        return False
    if word in statements:
        show(engine.sql(statements[word] + rest), out)
    elif word == "tables":
        print("\n".join(engine.store.tables()), file=out)
    elif word == "schema":
        for k, v in engine.store.describe(rest).items():
            print(f"{k}: {v}", file=out)
    elif word == "plan":
        print(json.dumps(engine.plan(rest), indent=1), file=out)
    elif word == "profile":
        show(engine.profile(rest), out)
    elif word == "sample":
        name, _, n = rest.partition(" ")
        show(engine.sample(name, int(n or 10)), out)
    elif word == "export":
        kind, path, query = rest.split(None, 2)
        engine.export(query, path, kind)
    elif word == "history":
        for h in engine.history:
            print(f"{h['seconds']:.2f} s  {h['text']}" + (f"  -- {h['error']}" if h["error"] else ""), file=out)
    else:
        print(HELP, file=out)
    return True


def prompt(engine: Engine, lines: TextIO, out: TextIO) -> None:
    """Reads statements and commands until the end or :quit; an error ends only its statement."""
    held = ""
    for line in lines:
        try:
            if not held and line.lstrip().startswith(":"):
                if not command(engine, line.strip(), out):
                    return
                continue
            held += line
            if line.rstrip().endswith(";"):
                text, held = held, ""
                for result in engine.script(text):
                    show(result, out)
        except Exception as e:
            print(f"error: {e}", file=out)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("-d", "--data", required=True, help="folder of the store; any that Spark can write")
    parser.add_argument("-e", "--execute", help="statements to run")
    parser.add_argument("-f", "--file", help="file of statements to run")
    options = parser.parse_args(argv)
    engine = Engine(session(), options.data)
    if not (options.execute or options.file):
        prompt(engine, sys.stdin, sys.stdout)
        return 0
    try:
        if options.file:
            with open(options.file, encoding="utf-8") as f:
                text = f.read()
        for result in engine.script(options.execute or text):
            show(result, sys.stdout)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
