"""Formulas on the command line: python -m lemnia [-l] [-i] [-e FILE] [FORMULA ...]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.lexer import SyntaxProblem
from .plans.logical import compile_logical
from .session import Session


def answer(spark: SparkSession, session: Session, text: str, logical: bool = False) -> str:
    """The value of one line; assignments give nothing and stay in the session."""
    try:
        column = compile_logical(text, session, []) if logical else session.compile(text, [])
        return str(spark.range(1).select(column).first()[0])
    except (SyntaxProblem, ValueError) as e:
        return f"error: {e}"


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lemnia", description="Evaluates formulas, one a line or argument.")
    p.add_argument("formula", nargs="*")
    p.add_argument("-l", "--logical", action="store_true", help="read the formulas as logical ones")
    p.add_argument("-e", "--file", help="a file of formulas, one a line")
    p.add_argument("-i", "--interactive", action="store_true", help="read formulas from the standard input until an empty line")
    p.add_argument("-u", "--angle", default="RAD", choices=["RAD", "DEG", "GRAD"])
    given = p.parse_args(arguments)
    lines = list(given.formula)
    if given.file:
        with open(given.file, encoding="utf-8") as f:
            lines += [x.strip() for x in f if x.strip()]
    spark = spark or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session = Session(given.angle)
    for line in lines:
        print(answer(spark, session, line, given.logical))
    while given.interactive and (line := sys.stdin.readline().strip()):
        print(answer(spark, session, line, given.logical))
    return 0


if __name__ == "__main__":
    sys.exit(main())
