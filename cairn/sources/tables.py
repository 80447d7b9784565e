"""Readers and writers: string CSV, aliases of headers, signatures, staged output."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cairn.functions import text as T

ENCODINGS = ("utf-8-sig", "utf-8", "cp932")


def read_strings(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """The named columns of a CSV file, all as strings; NA-like cells are null."""
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    by = {c.strip().lstrip("﻿"): c for c in raw.columns}
    return raw.select(*(T.missing_to_null(F.col(f"`{by[c]}`")).alias(c) if c in by else F.lit(None).cast("string").alias(c) for c in columns))


# What the columns of a path file may be called.
PATH_ALIASES = {
    "source": ["source_package", "source_package_name", "source_package_key", "source_ancestors", "source", "original_package"],
    "source_rank": ["source_rank", "multi_blood_rank", "package_rank", "rank"],
    "step": ["step", "path_step", "reconstruction_step", "forward_step"],
    "state": ["path_state", "state", "status", "representation_status", "stage"],
    "representation": ["representation", "representation_text", "current_representation", "reconstructed_package", "branch_representation", "package_representation", "nearest_reproducible_package"],
    "similarity": ["similarity", "fingerprint_similarity", "representation_similarity"],
    "high_jaccard": ["high_jaccard", "high_group_jaccard", "highdose_jaccard"],
    "low_jaccard": ["low_jaccard", "low_group_jaccard", "lowdose_jaccard"],
    "carrier_recall": ["carrier_recall", "joint_carrier_recall"],
    "joint_jaccard": ["joint_carrier_jaccard", "carrier_jaccard", "joint_jaccard"],
    "high_recall": ["high_recall", "high_group_recall"],
    "log_corr": ["log_dose_corr", "logdosecorr", "dose_corr", "log_dose_pearson"],
    "leaf_count": ["leaf_count", "total_leaves", "branch_leaf_count", "n_leaves"],
    "median_year": ["representation_median_year", "median_year", "leaf_median_year", "component_median_year", "nearest_median_year"],
    "carrier_signature": ["carrier_signature", "joint_carrier_signature", "carrier_bitset_signature", "target_carrier_signature"],
}
PATH_REQUIRED = ("step", "representation", "similarity")


def read_path(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A path file as string columns under their own names; absent ones are left out.

    Without a column for the step, the representation or the similarity it can't be read.
    """
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    found = resolve([c.lstrip("\ufeff") for c in raw.columns], PATH_ALIASES, contains=True)
    if lost := [c for c in PATH_REQUIRED if found[c] is None]:
        raise ValueError(f"{path} has no column for {', '.join(lost)}")
    by = {c.lstrip("\ufeff"): c for c in raw.columns}
    return raw.select(*(F.col(f"`{by[h]}`").alias(name) for name, h in found.items() if h is not None))


#: The columns that Stage B needs from the tables of Stage A.
RESULT_COLUMNS = {
    "ratings": "year int, race_type string, surface_family string, pk string, name string, rating double, network_id int, japan_top3 long",
    "networks": "year int, race_type string, surface_family string, network_id int, network_competitors long, network_races long, internal_comparisons long, external_comparisons long",
}


def read_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of Stage A (CSV folders), typed, with keys cleaned as the race reader cleans them.

    Rows without a year, a key or a network id are left out. A missing table is an error.
    """
    out = {}
    for name, ddl in RESULT_COLUMNS.items():
        path = f"{folder.rstrip('/')}/{name}"
        try:
            raw = spark.read.option("header", True).csv(path)
        except AnalysisException as e:
            raise FileNotFoundError(f"{path} is missing") from e
        kinds = dict(part.split() for part in ddl.split(", "))
        if lost := [c for c in kinds if c not in raw.columns]:
            raise ValueError(f"{path} has no column {', '.join(lost)}")
        clean = {"pk": T.key(F.col("pk")), "race_type": F.upper(T.clean(F.col("race_type"))), "surface_family": F.upper(T.clean(F.col("surface_family")))}
        typed = lambda c, kind: T.to_float(F.col(c)) if kind == "double" else T.to_int(F.col(c)).cast(kind) if kind in ("int", "long") else F.col(c)
        read = raw.select(*(clean.get(c, typed(c, kind)).alias(c) for c, kind in kinds.items()))
        needed = [c for c in ("year", "pk", "network_id") if c in kinds and not (name == "ratings" and c == "network_id")]
        out[name] = read.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in needed)))
    return out


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV part with this schema, or an empty frame if it is missing, empty or has no header."""
    empty_frame = spark.createDataFrame([], schema)
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException:
        return empty_frame
    names = [f.name for f in empty_frame.schema]
    if not set(names) & {c.lstrip("\ufeff") for c in raw.columns}:
        return empty_frame
    by = {c.lstrip("\ufeff"): c for c in raw.columns}
    return raw.select(*((F.col(f"`{by[f.name]}`") if f.name in by else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in empty_frame.schema))


def read_matrix(spark: SparkSession, path: str, label: str = "label") -> DataFrame:
    """A wide matrix whose first column labels the rows, as (label, name, value) rows."""
    raw = spark.read.option("header", True).csv(path)
    first, *rest = raw.columns
    wide = raw.select(F.col(f"`{first}`").alias(label), *(T.to_float(F.col(f"`{c}`")).alias(c) for c in rest))
    return wide.unpivot([label], rest, "name", "value")


def literal(spark: SparkSession, rows: Sequence[Sequence[object]], schema: str) -> DataFrame:
    """A small table written out in the program."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def guess_encoding(head: bytes) -> str:
    """The first encoding that can read a file's first line."""
    line = head.split(b"\n", 1)[0]
    for name in ENCODINGS:
        try:
            line.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    return "utf-8"


def resolve(header: Sequence[str], aliases: Mapping[str, Sequence[str]], contains: bool = False) -> dict[str, str | None]:
    """For each wanted name the header that stands for it: exact after folding, else by containing."""
    fold = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    folded = [(fold(h), h) for h in header]
    out: dict[str, str | None] = {}
    for name, own in aliases.items():
        exact = next((h for a in own for f, h in folded if f == fold(a)), None)
        loose = next((h for a in own for f, h in folded if f and (f in fold(a) or fold(a) in f)), None) if contains and exact is None else None
        out[name] = exact or loose
    return out


EDGE = 1 << 20


def signature(size: int, head: bytes, tail: bytes) -> str:
    """SHA-256 over the size and both ends of a file."""
    return hashlib.sha256(str(size).encode() + head + tail).hexdigest()


def file_signature(path: str | Path) -> dict[str, object]:
    """Name, size, time and hash of a file on the driver, by its size and its first and last megabyte."""
    p = Path(path)
    stat = p.stat()
    with p.open("rb") as f:
        head = f.read(EDGE)
        f.seek(max(0, stat.st_size - EDGE))
        return {"name": p.name, "size": stat.st_size, "mtime": int(stat.st_mtime), "sha256": signature(stat.st_size, head, f.read(EDGE))}


def sampled_signature(path: str | Path) -> str:
    """SHA-256 over the size and three megabytes (first, middle, last), each with its offset."""
    p = Path(path)
    size = p.stat().st_size
    out = hashlib.sha256(str(size).encode())
    with p.open("rb") as f:
        for at in sorted({0, max(0, size // 2 - EDGE // 2), max(0, size - EDGE)}):
            f.seek(at)
            out.update(str(at).encode() + f.read(EDGE))
    return out.hexdigest()


# ---- finding inputs on the driver ----------------------------------------------------------------


def newest(folder: str | Path, patterns: Sequence[str], without: Sequence[str] = ()) -> Path | None:
    """The newest file (then the largest, then the last by name) that matches any pattern, outside the named folders."""
    found = {p for pattern in patterns for p in Path(folder).glob(pattern) if p.is_file() and not set(p.relative_to(folder).parts[:-1]) & set(without)}
    return max(found, key=lambda p: (p.stat().st_mtime, p.stat().st_size, str(p)), default=None)


def discover(folder: str | Path, explicit: str | None, exact: Sequence[str], patterns: Sequence[str], without: Sequence[str] = ()) -> Path:
    """An input file: the one asked for, else the first exact name that is there, else the newest match."""
    if explicit:
        path = Path(explicit) if Path(explicit).is_absolute() else Path(folder) / explicit
        if not path.exists():
            raise FileNotFoundError(path)
        return path
    for name in exact:
        if (path := Path(folder) / name).is_file():
            return path
    found = newest(folder, patterns, without)
    if found is None:
        raise FileNotFoundError(f"nothing in {folder} matches {', '.join([*exact, *patterns])}")
    return found


def discover_results(folder: str | Path, explicit: str | None, names: Sequence[str], needed: Sequence[str]) -> Path:
    """A folder of results: the one asked for, else a known name, else the newest that holds all that is needed."""
    whole = lambda p: p.is_dir() and all((p / n).exists() for n in needed)
    if explicit:
        if not whole(Path(explicit)):
            raise FileNotFoundError(f"{explicit} lacks one of {', '.join(needed)}")
        return Path(explicit)
    known = [Path(folder) / n for n in names if whole(Path(folder) / n)]
    others = sorted((p for p in Path(folder).iterdir() if whole(p)), key=lambda p: (p.stat().st_mtime, str(p)), reverse=True) if Path(folder).is_dir() else []
    if not known + others:
        raise FileNotFoundError(f"no folder in {folder} holds {', '.join(needed)}")
    return (known + others)[0]


def find_inputs(folder: str | Path, pattern: str, own: str) -> list[Path]:
    """All matches below, newest first, without this program's own outputs (``own`` in the name)."""
    return sorted((p for p in Path(folder).rglob(pattern) if own not in p.name), key=lambda p: (-p.stat().st_mtime, str(p)))


def output_stem(path: str | Path, ending: str) -> str:
    """What outputs of this input are called: its name without the known ending, else without its suffix."""
    name = Path(path).name
    return name.removesuffix(ending) if name.endswith(ending) else Path(path).stem


def columns_of(frame: DataFrame, needed: Sequence[str]) -> dict[str, str]:
    """Name and type of each column; an error names those that are needed and missing."""
    if lost := [c for c in needed if c not in frame.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return dict(frame.dtypes)


def manifest(parts: Mapping[str, object]) -> str:
    return json.dumps(parts, sort_keys=True, ensure_ascii=False)


def empty(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))


def write_parts(frame: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace only the partitions that ``frame`` holds; the committer makes each write whole."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)
