"""python -m keyloom.cli --input FOLDER --output FOLDER --rule RULE [options]"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession

from .errors import ConversionError, InvalidArgument, code_of
from .operators import metrics
from .operators.batches import Policy
from .plans import directory
from .plans.convert import convert
from .plans.options import ConvertOptions
from .sources import arrow_stream


class Session:
    """Configure once, convert often, ask for the last result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.options, self.last, self.closed = spark, ConvertOptions(), "{}", False

    def configure(self, text: str) -> None:
        self._open()
        self.options = ConvertOptions.from_json(text)

    def convert(self, source: str, output: str, table: str, rule: str, form: str = "arrow", sink: str = "parquet") -> int:
        """The error code; the result is the JSON of the counters or of the error. `sink`: `parquet`, or `cells` for binary cell files."""
        self._open()
        try:
            for name, value in (("source", source), ("output", output), ("rule", rule)):
                if not value:
                    raise InvalidArgument(f"{name} is empty")
            df = arrow_stream.read(self.spark, source, position=True) if form == "arrow" else self.spark.read.format(form).load(source)
            order = ("_file", "_batch", "_row") if form == "arrow" else ()
            options = replace(self.options, rule=rule, table_name=table)
            hidden = tuple(c for c in order if c not in options.excluded_columns)
            counted = convert(df, replace(options, order=order, excluded_columns=options.excluded_columns + hidden))
            directory.write(df, order, output, options, sink)
            self.last = counted.json().first()["result"]
            return 0
        except Exception as e:
            self.last = json.dumps({"error_code": code_of(e), "error": str(e)})
            if not isinstance(e, ConversionError):
                raise
            return e.code

    def convert_directory(self, source: str, output: str, table: str, rule: str, how: directory.DirectoryOptions = directory.DirectoryOptions(), done=None) -> DataFrame:
        """One row per output with its error code; the result is the JSON of the totals."""
        self._open()
        suffix = ".arrow" if how.form == "arrow" else f".{how.form}"
        outcomes = directory.convert_directory(self.spark, directory.list_inputs(source, suffix), output, replace(self.options, rule=rule, table_name=table), how, done)
        self.last = json.dumps(metrics.batch_totals(outcomes).first().asDict())
        return outcomes

    def last_result(self) -> str:
        return self.last

    def close(self) -> None:
        self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise InvalidArgument("the session is closed")


def _flags(p: argparse.ArgumentParser) -> None:
    """A flag for every option of a conversion."""
    for f in fields(ConvertOptions):
        if f.name in ("rule", "table_name", "order", "seed"):
            continue
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        elif "tuple" in f.type:
            p.add_argument(flag, type=lambda v: tuple(x for x in v.split(",") if x), default=None, help="names by commas")
        else:
            p.add_argument(flag, type=int if f.type == "int" else str, default=None)
    p.add_argument("--seed", type=int, default=None)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--rule", required=True)
    p.add_argument("--table", default="")
    p.add_argument("--format", default="arrow")
    p.add_argument("--sink", default="parquet", choices=("parquet", "cells"))
    p.add_argument("--config", default="{}", help="a JSON object of options; flags win over it")
    p.add_argument("--batch", action="store_true", help="one output per file of the input folder, or per batch of merged files")
    p.add_argument("--strategy", default="parallel-convert", choices=directory.STRATEGIES)
    p.add_argument("--parallelism", type=int, default=4)
    p.add_argument("--skip-existing", action="store_true")
    p.add_argument("--merge-threshold", type=int, default=Policy.merge_threshold)
    p.add_argument("--batch-size", type=int, default=Policy.size)
    p.add_argument("--batch-count", type=int, default=Policy.count)
    p.add_argument("--batch-interval-ms", type=int, default=Policy.interval_ms)
    p.add_argument("--progress", action="store_true", help="a line for each output as it is done")
    _flags(p)
    given = p.parse_args(args)
    session = Session(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    try:
        session.configure(given.config)
        own = {f.name: getattr(given, f.name) for f in fields(ConvertOptions) if getattr(given, f.name, None) is not None and f.name not in ("rule", "table_name", "order")}
        session.options = replace(session.options, **own)
        if given.batch:
            policy = Policy(given.merge_threshold, given.batch_size, given.batch_count, given.batch_interval_ms)
            how = directory.DirectoryOptions(given.format, given.sink, given.strategy, given.parallelism, given.skip_existing, policy)
            done = (lambda x: print(json.dumps(x), file=sys.stderr)) if given.progress else None
            session.convert_directory(given.input, given.output, given.table, given.rule, how, done)
            code = 20 if json.loads(session.last_result())["failed"] else 0
        else:
            code = session.convert(given.input, given.output, given.table, given.rule, given.format, given.sink)
    except InvalidArgument as e:
        session.last, code = json.dumps({"error_code": e.code, "error": str(e)}), e.code
    print(session.last_result())
    return code


if __name__ == "__main__":
    sys.exit(main())
