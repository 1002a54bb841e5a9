"""Command line: catalogue queries over a folder of tables, and the phases of an analysis.

    python -m lexmill list
    python -m lexmill run markedness_by_doc --tables DIR [--out DIR] [--rows N]
    python -m lexmill phase1 --docs docs.parquet --meta meta.parquet --out DIR [--force]
    python -m lexmill phase2 --chunks chunks.parquet --vectors DIR/embeddings --out DIR
    python -m lexmill phase3 | profiles | deep | phase4 ... (see --help of each)

A table is a folder or file of Parquet, JSON lines (.json, .jsonl) or CSV (.csv). Any
option may come from the environment instead: LEXMILL_OUT for --out, and so on; a file
named by LEXMILL_ENV holds more of them as NAME=VALUE lines, which the environment goes before.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import bindings, catalog, phases
from lexmill.session import local_session

#: Options of each phase: tables that it needs, tables that it may have, switches, and numbers.
PHASES = {
    "phase1": (("docs", "meta"), (), ("force", "skip-embeddings", "artefacts"), ()),
    "phase2": (("chunks", "vectors"), (), ("force", "skip-topics", "skip-frames", "skip-networks", "by-density", "artefacts", "between"), ("topics-k", "merge-to", "grams")),
    "phase3": (("chunks",), (), ("force", "skip-classification", "skip-aggregation"), ("sample",)),
    "profiles": (("chunks", "frames", "classified"), ("triples",), ("force", "artefacts"), ()),
    "deep": (("frames", "classified"), ("triples",), ("force", "skip-svo", "skip-identity", "skip-markedness"), ()),
    "phase4": ((), (), ("force",), ()),
}


def settings() -> dict[str, str]:
    """LEXMILL_... of the environment, and of the file that LEXMILL_ENV names."""
    found: dict[str, str] = {}
    path = os.environ.get("LEXMILL_ENV")
    if path:
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, equals, value = line.strip().partition("=")
                if equals and not name.startswith("#"):
                    found[name.strip()] = value.strip().strip("\"'")
    return found | {k: v for k, v in os.environ.items() if k.startswith("LEXMILL_")}


def read(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)


def parser_of() -> argparse.ArgumentParser:
    given = settings()
    parser = argparse.ArgumentParser(prog="lexmill")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("query", choices=sorted(catalog.queries()))
    run.add_argument("--tables", default=given.get("LEXMILL_TABLES"), required="LEXMILL_TABLES" not in given, help="folder of Parquet tables")
    run.add_argument("--out", help="folder to write the result to as Parquet")
    run.add_argument("--rows", type=int, default=20, help="rows to show without --out")
    for name, (needed, other, switches, numbers) in PHASES.items():
        phase = commands.add_parser(name)
        for option in (*needed, "out", *(("networks",) if name == "phase4" else ())):
            key = f"LEXMILL_{option.upper()}"
            phase.add_argument(f"--{option}", default=given.get(key), required=key not in given)
        for option in other:
            phase.add_argument(f"--{option}", default=given.get(f"LEXMILL_{option.upper()}"))
        for option in switches:
            phase.add_argument(f"--{option}", action="store_true", default=given.get(f"LEXMILL_{option.upper().replace('-', '_')}") == "1")
        for option in numbers:
            phase.add_argument(f"--{option}", type=int, default=given.get(f"LEXMILL_{option.upper().replace('-', '_')}"))
    return parser


def run_phase(spark: SparkSession, got: argparse.Namespace) -> dict:
    needed, other, switches, numbers = PHASES[got.command]
    tables = {t: read(spark, getattr(got, t)) for t in (*needed, *other) if getattr(got, t)}
    options = {o.replace("-", "_"): getattr(got, o.replace("-", "_")) for o in (*switches, *numbers)}
    options = {k: v for k, v in options.items() if v is not None}
    if got.command == "phase1":
        return phases.run_phase1(spark, tables["docs"], tables["meta"], got.out, **options)
    if got.command == "phase2":
        return phases.run_phase2(spark, tables["chunks"], tables["vectors"], got.out, **options)
    if got.command == "phase3":
        return phases.run_phase3(spark, tables["chunks"], got.out, bindings.CUES, bindings.LEXICON, **options)
    if got.command == "profiles":
        return phases.run_profiles(spark, tables["chunks"], tables["frames"], tables["classified"], got.out, tables.get("triples"), **options)
    if got.command == "deep":
        return phases.run_deep_analysis(spark, tables["frames"], tables["classified"], tables.get("triples"), got.out, **options)
    return phases.run_phase4(spark, got.networks, got.out, **options)


def main(args: list[str] | None = None) -> int:
    got = parser_of().parse_args(args)
    if got.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = local_session()
    if got.command in PHASES:
        print(json.dumps(run_phase(spark, got), ensure_ascii=False, sort_keys=True, default=str))
        return 0
    found = catalog.queries()[got.query](spark, got.tables)
    if got.out:
        found.write.mode("overwrite").parquet(got.out)
    else:
        found.show(got.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
