"""Command line: python -m ontoloom.cli COMMAND ... Each command is a thin shell over the library."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ontoloom.engine import Engine


def json_argument(value: str):
    """JSON written out, or the name of a file that holds it."""
    if os.path.exists(value):
        with open(value, encoding="utf-8") as f:
            return json.load(f)
    return json.loads(value)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ontoloom")
    p.add_argument("--store", help="root of the document store")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *args, **options):
        c = sub.add_parser(name, **options)
        for a, o in args:
            c.add_argument(a, **o)

    source, out = ("source", {"help": "ontology file, folder or pattern"}), ("--out", {})
    add("blueprint", source, out, help="tables of an ontology, as JSON")
    add("validators", source, out, ("--strict", {"action": "store_true"}), help="JSON schemas of the collections")
    add("augment", source, ("instances", {}), out, help="blueprint with the instances of another file")
    add("load", source, ("--instances", {}), ("--drop", {"action": "store_true"}), help="collections and documents into the store")
    add("inspect", source, ("--name", {}), help="what the registry knows")
    add("pipeline", source, ("--instances", {}), ("--workdir", {"required": True}), ("--keep", {"action": "store_true"}), help="blueprint, validators, load and counts in one run")
    add("create", ("mode", {"choices": ["validate", "execute"]}), source, ("class_name", {}), ("payload", {}), ("--layers", {"action": "store_true"}))
    add("read", ("mode", {"choices": ["get", "one", "list"]}), source, ("name", {}), ("--id", {}), ("--query", {}), ("--limit", {"type": int, "default": 50}), ("--depth", {"type": int, "default": 0}), ("--no-metadata", {"action": "store_true"}))
    add("update", ("mode", {"choices": ["validate", "execute"]}), source, ("name", {}), ("id", {}), ("patch", {}))
    add("delete", ("mode", {"choices": ["validate", "preview", "execute", "suggest"]}), source, ("name", {}), ("id", {}), ("--delete-mode", {"default": "restrict"}))
    return p


def show(df, stream) -> None:
    for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator():
        print(r["j"], file=stream)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stream=None) -> int:
    a, stream = parser().parse_args(argv), stream or sys.stdout
    spark = spark or SparkSession.builder.appName("ontoloom").getOrCreate()
    instances = getattr(a, "instances", None)
    e = Engine.open(spark, a.source, instances if a.command != "blueprint" else None, a.store or f"{getattr(a, 'workdir', '.')}/store")
    if a.command in ("blueprint", "augment"):
        from ontoloom.plans import blueprint

        if a.out:
            blueprint.write_json(e.blueprint, a.out)
        print(blueprint.report(e.blueprint), file=stream)
    elif a.command == "validators":
        found = e.validators(strict=a.strict)
        if a.out:
            found.coalesce(1).write.mode("overwrite").json(a.out)
        show(found, stream)
    elif a.command == "load":
        print(json.dumps(e.load(drop=a.drop), sort_keys=True), file=stream)
    elif a.command == "inspect":
        r = e.registry
        if a.name:
            print(json.dumps({"class": r.class_exists(a.name), "collection": r.get_collection_for_class(a.name), "fields": r.get_allowed_fields_for_class(a.name), "parents": r.get_parent_classes(a.name, True), "required": r.get_required_rule_map_for_class(a.name)}, sort_keys=True), file=stream)
        else:
            show(r.collections.orderBy("class"), stream)
    elif a.command == "pipeline":
        print(json.dumps(e.run(a.workdir, keep=a.keep), sort_keys=True), file=stream)
    elif a.command == "create":
        payload = json.dumps(json_argument(a.payload))
        issues = e.create_issues(a.class_name, payload, a.layers)
        show(issues, stream)
        bad = not issues.where("coalesce(level, 'error') = 'error'" if "level" in issues.columns else "true").isEmpty()
        if not bad and a.mode == "execute":
            print(json.dumps({"_id": e.create(a.class_name, payload)}), file=stream)
        return int(bad)
    elif a.command == "read":
        query = {"_id": a.id} if a.mode == "get" else json_argument(a.query) if a.query else None
        show(e.read(a.name, query, 1 if a.mode in ("get", "one") else a.limit, a.depth, not a.no_metadata), stream)
    elif a.command == "update":
        done, issues = e.plan_update(a.name, a.id, json.dumps(json_argument(a.patch)))
        show(issues, stream)
        if not issues.isEmpty():
            return 1
        if a.mode == "execute":
            e.apply_update(a.name, done)
        show(done, stream)
    elif a.mode == "suggest":
        print(e.suggest_mode(a.name, a.id), file=stream)
    else:
        plan = e.preview_delete(a.name, a.id, a.delete_mode)
        show(plan, stream)
        if not plan.where("level = 'error'").isEmpty():
            return 1
        if a.mode == "execute":
            print(json.dumps(e.delete(a.name, a.id, a.delete_mode), sort_keys=True), file=stream)
    return 0


if __name__ == "__main__":
    sys.exit(main())
