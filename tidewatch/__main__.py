"""Command line: check, lint, explain, format, test, replay, replay-verify, generate and verify."""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys

from .lang.checker import problems, version_changes
from .lang.explain import explain
from .lang.layout import layout
from .lang.lint import hints
from .lang.preprocess import substitute
from .lang.rule import parse_rules
from .lang.schema import parse_schemas


def _read(path: str) -> str:
    with open(path) as f:
        return f.read()


def _schemas(patterns: list[str]):  # noqa: ANN202
    found = {}
    for p in patterns:
        for path in sorted(glob.glob(p)):
            found |= parse_schemas(_read(path))
    return found


def _spark():  # noqa: ANN202
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidewatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewatch", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "lint", "explain", "test", "replay", "replay-verify"):
        c = sub.add_parser(name)
        c.add_argument("rules")
        c.add_argument("--schemas", nargs="+", default=[])
        c.add_argument("--var", action="append", default=[], help="NAME=value")
        if name.startswith("replay"):
            c.add_argument("--input", required=True)
        if name == "replay":
            c.add_argument("--output")
        if name == "replay-verify":
            c.add_argument("--expected", required=True)
            c.add_argument("--seconds", type=float)
            c.add_argument("--score", type=float)
            c.add_argument("--meta", help="JSON with time_tolerance_secs and score_tolerance, for what is not given")
            c.add_argument("--format", choices=("json", "markdown"), default="json")
    c = sub.add_parser("format")
    c.add_argument("file")
    c.add_argument("--write", action="store_true")
    c = sub.add_parser("generate")
    c.add_argument("scenario")
    c.add_argument("--schemas", nargs="+", required=True)
    c.add_argument("--rules", nargs="+", default=[])
    c.add_argument("--output", required=True)
    c = sub.add_parser("verify")
    c.add_argument("expected")
    c.add_argument("actual")
    c.add_argument("--seconds", type=float, default=1.0)
    c.add_argument("--score", type=float, default=0.01)
    a = p.parse_args(argv)
    if a.command == "format":
        text = layout(_read(a.file))
        if a.write:
            with open(a.file, "w") as f:
                f.write(text)
        else:
            sys.stdout.write(text)
        return 0
    if a.command == "verify":
        from .gen import verify

        spark = _spark()
        got = verify.report(verify.compare(verify.read(spark.read.json(a.expected)), verify.read(spark.read.json(a.actual)), a.seconds, a.score))
        print(json.dumps(got))
        return int(got["status"] != "pass")
    schemas = _schemas(a.schemas)
    if a.command == "generate":
        from .gen import output, scenario

        s = scenario.parse_scenario(_read(a.scenario))
        rules = {r.name: r for path in a.rules for r in parse_rules(substitute(_read(path), {}, True)).rules}
        wrong = scenario.problems(s, schemas, rules)
        if wrong:
            print("\n".join(wrong), file=sys.stderr)
            return 1
        output.write_lines(scenario.events(_spark(), s, schemas, rules), schemas, a.output)
        return 0
    variables = dict(v.split("=", 1) for v in a.var)
    text = substitute(_read(a.rules), {**os.environ, **variables})
    parsed = parse_rules(text)
    if a.command == "check":
        wrong = [x for r in parsed.rules for x in problems(r, schemas)]
        print("\n".join(wrong) if wrong else "no problems")
        return int(bool(wrong))
    if a.command == "lint":
        print("\n".join([*(h for r in parsed.rules for h in hints(r, schemas)), *version_changes(parsed.rules)]))
        return 0
    if a.command == "explain":
        print("\n\n".join(explain(r) for r in parsed.rules))
        return 0
    if a.command == "test":
        from .harness import run_tests

        outcomes = run_tests(_spark(), text, schemas)
        for o in outcomes:
            print(f"{'ok  ' if o.passed else 'FAIL'} {o.test}", *o.failures, sep="\n     " if o.failures else "")
        return int(not all(o.passed for o in outcomes))
    from .engine import Engine
    from .sources.readers import ndjson

    spark = _spark()
    alerts = Engine(schemas, ndjson(spark, a.input, schemas), {}).run_all(text)
    if a.command == "replay-verify":
        from .gen import verify

        meta = json.loads(_read(a.meta)) if a.meta else {}
        near = [given if given is not None else float(meta.get(name, usual)) for given, name, usual in ((a.seconds, "time_tolerance_secs", 1.0), (a.score, "score_tolerance", 0.01))]
        result = verify.compare(verify.read(spark.read.json(a.expected)), verify.read(alerts), *near)
        got = verify.report(result)
        print(verify.markdown(result, got) if a.format == "markdown" else json.dumps(got))
        return int(got["status"] != "pass")
    if a.output:
        alerts.write.mode("overwrite").json(a.output)
    else:
        for row in alerts.toJSON().toLocalIterator():
            print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
