"""Command line: import files into bronze, build silver and gold, show recent events, export a channel."""

from __future__ import annotations

import argparse
import json
import os
import re
from datetime import date


def plain_yaml(text: str):
    """Nested mappings and lists of plain values by indentation: the part of YAML that configurations use."""
    lines = []
    for raw in text.splitlines():
        body = re.sub(r"(?:^|\s)#.*$", "", raw) if not re.search(r"[\"'].*#.*[\"']", raw) else raw
        if body.strip() and body.strip() != "---":
            lines.append((len(body) - len(body.lstrip()), body.strip()))
    value, rest = _block(lines)
    if rest:
        raise ValueError(f"indentation at: {rest[0][1]}")
    return value


def _block(lines: list[tuple[int, str]]):
    """The value that the lines of the first one's depth (and deeper) write, and the lines after it."""
    if not lines:
        return None, []
    depth, out = lines[0][0], [] if lines[0][1].split(" ")[0] == "-" else {}
    while lines and lines[0][0] == depth:
        _, body = lines[0]
        if isinstance(out, list):
            if body.split(" ")[0] != "-":
                break
            item = body[1:].strip()
            if re.match(r"[^\s\"'\[{][^:]*:(\s|$)", item):  # a mapping that begins beside the dash
                value, lines = _block([(depth + len(body) - len(item), item), *lines[1:]])
            elif item:
                value, lines = _scalar(item), lines[1:]
            else:
                value, lines = _block(lines[1:]) if lines[1:] and lines[1][0] > depth else (None, lines[1:])
            out.append(value)
            continue
        key, _, item = body.partition(":")
        lines, item = lines[1:], item.strip()
        if item:
            value = _scalar(item)
        elif lines and (lines[0][0] > depth or (lines[0][0] == depth and lines[0][1].split(" ")[0] == "-")):
            value, lines = _block(lines)
        else:
            value = None
        out[_scalar(key.strip())] = value
    return out, lines


def _scalar(text: str):
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text[0] == "[" and text[-1] == "]":
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    if text == "{}":
        return {}
    low = text.lower()
    if low in ("null", "~"):
        return None
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def load_config(path: str) -> dict:
    """data_root and suppliers [{key, paths}] of a JSON or, where a parser is installed, YAML file; paths relative to it."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        data = json.loads(text)
    except ValueError:
        try:
            from yaml import safe_load
        except ImportError:
            safe_load = plain_yaml
        data = safe_load(text) or {}
    base = os.path.dirname(os.path.abspath(path))
    full = lambda p: p if "://" in p or os.path.isabs(p) else os.path.join(base, p)
    data["data_root"] = full(data.get("data_root") or "data")
    data["suppliers"] = [{"key": s["key"], "paths": [full(p) for p in s.get("paths", [])]} for s in data.get("suppliers", [])]
    return data


def run_import(spark, config: dict) -> tuple[int, int, list]:
    """(imported, unchanged, failed) files: those that the manifest doesn't hold unchanged go into bronze.

    A file's rows replace those of the same supplier, day and file, and its manifest entry is written right
    after them: a run that breaks off is taken up where it stopped, and a file imported twice counts once.
    """
    from pyspark.sql import functions as F

    from .operators.medallion import bronze, write_bronze
    from .sources import ingest, manifest

    jobs = [(s["key"], p) for s in config["suppliers"] for p in s["paths"]]
    book = f"{config['data_root']}/manifest"
    known = manifest.known_files(spark, book)
    done, same, failed = 0, 0, []
    for supplier, path in jobs:
        try:
            here = manifest.list_files(spark, path).withColumn("supplier", F.lit(supplier))
            if not manifest.to_import(here, known).count():
                same += 1
                continue
            rows = bronze(ingest.to_raw(ingest.read_rows(spark, path)), supplier)
            write_bronze(rows, f"{config['data_root']}/bronze", supplier, date.today().isoformat(), os.path.basename(path))
            manifest.register(here, book)
            done += 1
        except Exception as e:  # one bad file doesn't stop the batch
            failed.append((supplier, path, str(e).splitlines()[0]))
    return done, same, failed


def raw_source(spark, root: str, sample: str | None = None):
    """The first of export_raw.parquet, export_raw.csv and a sample file that is there and can be read."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    trouble = []
    for path in [f"{root}/export_raw.parquet", f"{root}/export_raw.csv", sample]:
        if not path:
            continue
        try:
            return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, multiLine=True, escape='"')
        except (PySparkException, Py4JJavaError) as e:
            trouble.append(f"{path}: {str(e).splitlines()[0]}")
    raise FileNotFoundError("no readable export source: " + "; ".join(trouble))


def build_silver(spark, root: str) -> None:
    from .operators.medallion import read_bronze, silver, write_layer

    write_layer(silver(read_bronze(spark, f"{root}/bronze")), f"{root}/silver/offers")


def build_gold(spark, root: str) -> None:
    from .operators.medallion import gold, write_layer

    write_layer(gold(spark.read.parquet(f"{root}/silver/offers")), f"{root}/gold/summary")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pricemill")
    p.add_argument("--config", default="config.json")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("import", "build-silver", "build-gold"):
        sub.add_parser(name)
    sub.add_parser("status").add_argument("--limit", type=int, default=20)
    e = sub.add_parser("export")
    e.add_argument("--source", help="a Parquet or CSV file; else that of the configured data folder")
    e.add_argument("--out", default="exports")
    e.add_argument("--format", nargs="+", default=["csv", "xml"])
    e.add_argument("--selling-type", default="r")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from .sources.events import recent_events, timed
    from .sources.export import run_export

    spark = SparkSession.builder.appName("pricemill").getOrCreate()
    if a.command == "export":
        raw = raw_source(spark, load_config(a.config)["data_root"]) if not a.source else spark.read.parquet(a.source) if a.source.endswith(".parquet") else spark.read.csv(a.source, header=True, multiLine=True, escape='"')
        print(json.dumps(run_export(raw, a.out, a.format, selling_type=a.selling_type)[2]))
        return 0
    config = load_config(a.config)
    root, log = config["data_root"], os.path.join(config["data_root"], "events.jsonl")
    if a.command == "status":
        for r in recent_events(spark, log, a.limit).collect():
            print(r.timestamp, r.event, dict(r.fields))
        return 0
    with timed(log, a.command):
        if a.command == "import":
            done, same, failed = run_import(spark, config)
            print(json.dumps({"imported": done, "unchanged": same, "failed": failed}, ensure_ascii=False))
            return int(bool(failed))
        (build_silver if a.command == "build-silver" else build_gold)(spark, root)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
