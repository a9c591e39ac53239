"""Command line: ``struct``, ``pipeline``, ``gate`` and ``csv-select``."""

from __future__ import annotations

import argparse
import sys

from ..contracts import ContractMismatch
from .declared import SchemaError, parquet_schema
from .pipeline_source import PipelineSpec, pipeline_source
from .source import HEADER, struct_source


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessel")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("struct", help="contract class of a Parquet file")
    p.add_argument("from_parquet")
    p.add_argument("--name", required=True)
    p.add_argument("--out")
    p = commands.add_parser("pipeline", help="pipeline from a declared schema")
    p.add_argument("--source-schema", required=True)
    p.add_argument("--source-data")
    p.add_argument("--source-format", choices=["parquet", "csv", "delta"])
    p.add_argument("--target-schema")
    p.add_argument("--transform-sql")
    p.add_argument("--transform-df", action="append", default=[])
    p.add_argument("--sink-parquet", required=True)
    p.add_argument("--name", required=True)
    p.add_argument("--out")
    p = commands.add_parser("gate", help="declared schemas that must equal a model")
    p.add_argument("model", help="schema spec of the model")
    p.add_argument("sources", nargs="+", help="schema specs that must equal it")
    p = commands.add_parser("csv-select", help="one column of a CSV file")
    p.add_argument("input")
    p.add_argument("--column", type=int, required=True)
    p.add_argument("--no-headers", action="store_true")
    return parser


def _write(text: str, out: str | None) -> None:
    if out:
        with open(out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)


def main(argv: list[str] | None = None) -> int:
    """0 for success, 1 for a failure, which is told on the error stream."""
    a = _parser().parse_args(argv)
    try:
        if a.command == "struct":
            _write(HEADER + "\n\n" + struct_source(parquet_schema(a.from_parquet), a.name), a.out)
        elif a.command == "pipeline":
            spec = PipelineSpec(a.source_schema, a.name, a.sink_parquet, a.source_data, a.source_format, a.target_schema, a.transform_sql, tuple(a.transform_df))
            _write(pipeline_source(spec), a.out)
        elif a.command == "gate":
            from .gate import check_gate

            check_gate(a.model, a.sources)
        else:
            from ..sources.csv import select_column

            for line in select_column(a.input, a.column, headers=not a.no_headers):
                sys.stdout.write(line)
    except (SchemaError, ContractMismatch, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
