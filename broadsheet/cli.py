"""Command line: ``python -m broadsheet <command>``."""

from __future__ import annotations

import argparse
import importlib
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import functions as F

from .functions.cleaning import Cleaner
from .operators import blocks, entities
from .plans.engine import file_coverage, loading_status
from .session import session
from .sources import download, images, tables, xml
from .sources.registry import Registry


def imported(name: str):
    """The object that ``module:attribute`` names."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise SystemExit(f"{name!r} is not of the form module:attribute")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="broadsheet", description="Text archives on Spark")
    p.add_argument("--data-dir")
    p.add_argument("--results-dir")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="group", required=True)
    data = sub.add_parser("data", help="sources, ingest, cleaning").add_subparsers(dest="command", required=True)

    def command(name: str, text: str, **options) -> argparse.ArgumentParser:
        c = data.add_parser(name, help=text, **options)
        c.set_defaults(command=name)
        if name != "list-sources":
            c.add_argument("--source", required=True)
        return c

    command("list-sources", "configured sources", aliases=["sources"])
    command("info", "what is loaded")
    c = command("download", "get a source's archives")
    c.add_argument("--part", action="append", help="only this part; may be given several times")
    c.add_argument("--workers", type=int, default=2)
    c = command("unpack", "unpack the archives that are there")
    c.add_argument("--part", action="append")
    c.add_argument("--fix", nargs=2, action="append", default=[], metavar=("OLD", "NEW"), help="move an issue filed under a wrong date, as 1900/01/02/01 1902/01/02/01")
    c = command("parse", "page files to lines")
    c.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--limit", type=int, help="at most so many files that haven't been read yet")
    command("aggregate", "lines to text blocks").add_argument("--force", action="store_true")
    command("find-empty", "page files without lines").add_argument("--show", type=int, default=10)
    c = command("preprocess", "clean a table's texts")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--steps", required=True, help="comma-joined")
    c.add_argument("--column", default="text")
    c.add_argument("--sample", type=int, help="the first rows in the order of their columns")
    c.add_argument("--model", action="append", default=[], metavar="STEP=MODULE:FUNCTION", help="function for a step that needs a model")
    command("check-completeness", "files that the issues' metadata lead to expect")
    c = command("download-images", "get the pictures that the issues' metadata name")
    c.add_argument("--workers", type=int, default=4)
    c.add_argument("--limit", type=int)
    command("validate-images", "check image files")
    command("verify", "check MD5 sums").add_argument("--path", help="where the archives are, if not in the source's folder")
    analyze = sub.add_parser("analyze", help="annotation").add_subparsers(dest="command", required=True)
    c = analyze.add_parser("extract-entities", help="entities of a source's lines")
    c.add_argument("--source", required=True)
    c.add_argument("--min-length", type=int, default=100)
    c.add_argument("--method", choices=("patterns", "model"), default="patterns")
    c.add_argument("--model", metavar="MODULE:FACTORY", help="for method model: called once per task, gives a function of a list of texts")
    return p


def archives(source, paths: dict, wanted: list[str] | None) -> list[tuple[dict, Path]]:
    """The source's parts and where their archives are or belong."""
    names = [part["name"] for part in source.parts]
    if unknown := [n for n in wanted or () if n not in names]:
        raise SystemExit(f"unknown part {unknown[0]!r}; there are: {', '.join(names) or 'none'}")
    return [(part, Path(paths["downloads"]) / f"{part['name']}.tar.gz") for part in source.parts if not wanted or part["name"] in wanted]


def get_archives(source, paths: dict, args) -> int:
    def one(job: tuple[dict, Path]) -> str:
        try:
            return download.fetch(job[0]["url"], job[1], job[0].get("md5"))
        except (OSError, KeyError, ValueError) as e:
            return f"failed: {e!r}"

    jobs = archives(source, paths, args.part)
    with ThreadPoolExecutor(max(1, args.workers)) as pool:
        results = list(pool.map(one, jobs))
    for (part, _), result in zip(jobs, results, strict=True):
        print(part["name"], result)
    return int(any(r.startswith("failed") for r in results))


def unpack_archives(source, paths: dict, args) -> int:
    missing = 0
    for part, archive in archives(source, paths, args.part):
        if archive.exists():
            print(part["name"], download.unpack(archive, paths["raw"]))
        else:
            print(part["name"], "not there")
            missing = 1
    for old, new in args.fix:
        print(old, new, download.relocate_issue(paths["raw"], old, new))
    return missing


def parse_pages(spark, paths: dict, resume: bool, limit: int | None) -> None:
    """Lines of the files that aren't in the ledger; those without lines go into it, too, and aren't read again."""
    lines, ledger = tables.existing(spark, paths["lines"]), tables.existing(spark, paths["ledger"])
    seen = None
    for known in (lines, ledger) if resume else ():
        if known is not None:
            names = known.select("filename").distinct()
            seen = names if seen is None else seen.unionByName(names)
    # the choice is written first, so that files that arrive meanwhile aren't entered as read
    xml.pending(spark, paths["raw"], seen, limit).write.mode("overwrite").parquet(paths["ledger"] + ".next")
    chosen = spark.read.parquet(paths["ledger"] + ".next")
    mode = "append" if seen is not None else "overwrite"
    tables.write_parquet(xml.scan_lines(spark, paths["raw"], chosen=chosen), paths["lines"], sort=("filename",), mode=mode)
    tables.write_parquet(chosen.select("filename"), paths["ledger"], mode=mode)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    registry = Registry(args.data_dir, args.results_dir)
    if args.command == "list-sources":
        for n in registry.names():
            print(n, registry.load(n).metadata.get("newspaper_title", ""))
        return 0
    source, paths = registry.load(args.source), registry.paths(args.source)
    if args.command == "download":
        return get_archives(source, paths, args)
    if args.command == "unpack":
        return unpack_archives(source, paths, args)
    spark = session(args.master)
    if args.command == "parse":
        parse_pages(spark, paths, args.resume, args.limit)
    elif args.command == "aggregate":
        tables.write_parquet(blocks.text_blocks(spark.read.parquet(paths["lines"])), paths["blocks"], mode="overwrite" if args.force else "errorifexists")
    elif args.command == "find-empty":
        empty = xml.empty_files(xml.listing(spark, paths["raw"], "*.xml").where(F.contains("path", F.lit("/fulltext/"))), spark.read.parquet(paths["lines"]))
        print(empty.count())
        empty.select("path").orderBy("path").show(args.show, False)
    elif args.command == "preprocess":
        df = spark.read.parquet(args.input)
        if args.sample:
            df = df.orderBy(*(c for c, kind in df.dtypes if not kind.startswith("map"))).limit(args.sample)
        cleaner = Cleaner(args.column)
        for step, _, name in (m.partition("=") for m in args.model):
            cleaner.register(step, imported(name))
        tables.write_parquet(cleaner.run(df, [s.strip() for s in args.steps.split(",")]), args.output)
    elif args.command == "info":
        lines = spark.read.parquet(paths["lines"])
        loading_status(lines).show(truncate=False)
        file_coverage(lines, xml.listing(spark, paths["raw"], "*.xml").where(F.contains("path", F.lit("/fulltext/")))).show()
        years = {r[0] for r in lines.select("year").where("year is not null").distinct().collect()}  # a row per year
        print(registry.extraction_status(args.source, years))
    elif args.command == "check-completeness":
        found = xml.scan_images(xml.files(spark, paths["raw"], fulltext=False))
        xml.completeness(found, xml.listing(spark, paths["raw"])).show(50, False)
    elif args.command == "download-images":
        found = xml.image_targets(xml.scan_images(xml.files(spark, paths["raw"], fulltext=False)), paths["images"], paths["raw"]).orderBy("target")
        found = found.limit(args.limit) if args.limit else found
        print(download.fetch_all(((r.url, r.target.removeprefix("file:")) for r in found.select("url", "target").toLocalIterator()), args.workers))
    elif args.command == "validate-images":
        images.validation_summary(images.validate(spark, paths["images"])).show()
    elif args.command == "verify":
        expected = spark.createDataFrame([(p["name"] + ".tar.gz", p.get("md5")) for p in source.parts], "filename string, md5 string")
        tables.verify_checksums(spark, expected, args.path or paths["downloads"]).show(100, False)
    elif args.command == "extract-entities":
        lines = spark.read.parquet(paths["lines"]).where(F.length("text") >= args.min_length)
        if args.method == "model":
            if not args.model:
                raise SystemExit("method model needs --model MODULE:FACTORY")
            found = entities.model_entities(lines, imported(args.model), least=args.min_length)
        else:
            found = entities.regex_entities(lines)
        tables.write_result(found, f"{paths['results']}/entities/{args.method}", "entities", args.method, args.model or "builtin", args.source, {"min_length": args.min_length})
    return 0
