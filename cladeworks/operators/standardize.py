"""Records through a kernel: each distinct input once, failures as typed values, never as exceptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import molecule
from ..storage import stored

STAGES = ("input_validation", "smiles_parse", "fragment_selection", "standardisation", "identifier_generation", "unexpected_exception")


def standardised(df: DataFrame, column: str, require_identifiers: bool = False) -> DataFrame:
    """Adds std (struct, null on failure) and err (struct of stage and reason, null on success).

    The kernel runs once for each distinct text and the result is joined back.
    """
    kind = f"text string, std struct<{molecule.STANDARD_DDL.replace(' ', ':').replace(',:', ',')}>, err struct<stage:string,reason:string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            std, err = [], []
            for text in frame["text"]:
                try:
                    got = molecule.standardise(text)
                    if require_identifiers:
                        raise molecule.MoleculeError("identifier_generation", "backend_unavailable")
                    std.append(got), err.append(None)
                except molecule.MoleculeError as e:
                    std.append(None), err.append({"stage": e.stage, "reason": e.reason})
                except Exception as e:
                    std.append(None), err.append({"stage": "unexpected_exception", "reason": type(e).__name__})
            yield pd.DataFrame({"text": frame["text"], "std": std, "err": err})

    # Written once: the kernel does not run again, and the join can split a text that very many rows have.
    done = stored(df.select(F.coalesce(F.col(column), F.lit("")).alias("text")).distinct().mapInPandas(run, kind))
    return df.join(done, F.coalesce(F.col(column), F.lit("")) == done["text"]).drop("text")


def routed(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Standardised, failed and malformed records of a catalog scan with std and err."""
    good = records.filter("well_formed and std is not null")
    failed = records.filter("well_formed and err is not null").select("catalog", "line_no", "supplied", F.col("err.stage").alias("failure_stage"), F.col("err.reason").alias("failure_reason"))
    malformed = records.filter("not well_formed").select("catalog", "line_no", "raw", F.lit("input_format").alias("failure_stage"))
    return good, failed, malformed


def once_per_text(df: DataFrame, column: str, name: str, kind: str, kernel: Callable[[str], object]) -> DataFrame:
    """Adds ``name``, what ``kernel`` makes of a text: it runs once for each distinct one, and the result is joined back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"text_": frame["text_"], name: [kernel(x) for x in frame["text_"]]})

    done = stored(df.select(F.coalesce(F.col(column), F.lit("")).alias("text_")).distinct().mapInPandas(run, f"text_ string, {name} {kind}"))
    return df.join(done, F.coalesce(F.col(column), F.lit("")) == done["text_"]).drop("text_")


def with_scaffold(df: DataFrame, column: str) -> DataFrame:
    return once_per_text(df, column, "scaffold", "string", lambda x: (molecule.scaffold(x) if x else None) or "UNPARSED")


def with_fingerprint(df: DataFrame, column: str) -> DataFrame:
    return once_per_text(df, column, "fingerprint", "array<int>", molecule.fingerprint)


def tanimoto(a: str, b: str):
    """Shared bits against all bits of two bit lists; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
