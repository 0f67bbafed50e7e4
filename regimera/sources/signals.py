"""Readers of raw signals: level-5 MATLAB files, whitespace tables of engine cycles, remaining-life labels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship

#: Folder, fault type, diameter in thousandths of an inch.
FAULTS = (
    ("Normal", "normal", 0), ("IR007", "inner_race", 7), ("IR014", "inner_race", 14), ("IR021", "inner_race", 21), ("OR007", "outer_race", 7),
    ("OR014", "outer_race", 14), ("OR021", "outer_race", 21), ("Ball007", "ball", 7), ("Ball014", "ball", 14), ("Ball021", "ball", 21),
)
#: File numbers of each load in horsepower.
LOADS = {0: (97, 105, 118, 130, 169, 209), 1: (98, 106, 119, 131, 170, 210), 2: (99, 107, 120, 132, 171, 211), 3: (100, 108, 121, 133, 172, 212)}
CYCLE_COLUMNS = ["unit_id", "cycle", "op1", "op2", "op3", *(f"s{i}" for i in range(1, 22))]
CYCLE_SCHEMA = T.StructType([T.StructField(c, T.IntegerType() if c in ("unit_id", "cycle") else T.DoubleType()) for c in CYCLE_COLUMNS])
#: Fixed values of the file format: numeric element types.
_KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def read_mat(raw: bytes) -> dict[str, np.ndarray]:
    """Real numeric variables of a level-5 MATLAB file, flattened in column order; other variables are skipped."""
    order = "<" if raw[126:128] == b"IM" else ">"
    out: dict[str, np.ndarray] = {}

    def element(data: bytes, at: int) -> tuple[int, bytes, int]:
        word, size = struct.unpack_from(order + "II", data, at)
        if word >> 16:  # small form: size and type share the first word
            return word & 0xFFFF, data[at + 4 : at + 4 + (word >> 16)], at + 8
        end = at + 8 + size
        return word, data[at + 8 : end], end if word == 15 else end + (-size) % 8

    def walk(data: bytes, at: int) -> None:
        while at + 8 <= len(data):
            kind, body, at = element(data, at)
            if kind == 15:
                walk(zlib.decompress(body), 0)
            elif kind == 14:
                _, flags, p = element(body, 0)
                _, _, p = element(body, p)
                _, name, p = element(body, p)
                if 6 <= flags[0] <= 15 and p < len(body):
                    number, values, _ = element(body, p)
                    if number in _KINDS:
                        out[name.decode("ascii", "replace")] = np.frombuffer(values, order + _KINDS[number]).astype(float)

    walk(raw, 128)
    return out


def write_mat(variables: dict[str, np.ndarray]) -> bytes:
    """A level-5 file of double column vectors (for fixtures and exports)."""

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    parts = []
    for name, values in variables.items():
        x = np.asarray(values, "<f8").ravel()
        parts.append(element(14, element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", len(x), 1)) + element(1, name.encode()) + element(9, x.tobytes())))
    return head + b"".join(parts)


def load_hp(stem: Column) -> Column:
    """Load in horsepower from the digits of a file's stem, -1 where unknown."""
    number = F.try_to_number(F.regexp_replace(stem, "[^0-9]", ""), F.lit("999999999")).cast("int")
    out = F.lit(-1)
    for load, files in LOADS.items():
        out = F.when(number.isin(*files), load).otherwise(out)
    return out


def faults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAULTS, "folder string, fault_type string, fault_diameter int")


def vibration_signals(spark: SparkSession, root: str) -> DataFrame:
    """(source_file, de, fe, fault_type, fault_diameter, load_hp) of root/{folder}/*.mat.

    The drive-end variable ends in DE_time and is required; the fan-end one ends in FE_time and is zero where missing; both
    are cut to the shorter. Unreadable files and files without a drive end are left out, unknown folders too.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").option("recursiveFileLookup", "true").load(root)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    found = read_mat(raw)
                except (struct.error, zlib.error, ValueError, IndexError):
                    continue
                pick = lambda suffix: next((v for k, v in found.items() if k.endswith(suffix)), None)
                de, fe = pick("DE_time"), pick("FE_time")
                if de is None:
                    continue
                fe = np.zeros(len(de)) if fe is None else fe
                n = min(len(de), len(fe))
                rows.append((path, de[:n].tolist(), fe[:n].tolist()))
            yield pd.DataFrame(rows, columns=["path", "de", "fe"])

    got = files.select("path", "content").mapInPandas(decode, "path string, de array<double>, fe array<double>")
    parts = F.split("path", "/")
    got = got.select(F.element_at(parts, -1).alias("source_file"), F.element_at(parts, -2).alias("folder"), "de", "fe")
    stem = F.regexp_replace("source_file", r"\.mat$", "")
    return got.join(F.broadcast(faults(spark)), "folder").select("source_file", "de", "fe", "fault_type", "fault_diameter", load_hp(stem).alias("load_hp"))  # ten rows


def cycle_table(spark: SparkSession, path: str) -> DataFrame:
    """Engine cycles from text columns parted by blanks, without a header; lines of other widths are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == len(CYCLE_COLUMNS))
    cast = lambda i, f: F.get("p", i).try_cast(f.dataType).alias(f.name)
    return lines.select(*[cast(i, f) for i, f in enumerate(CYCLE_SCHEMA.fields)])


def engine_cycles(spark: SparkSession, root: str, subset: str = "FD001", split: str = "train") -> DataFrame:
    """One subset and split of root/{split}_{subset}.txt."""
    if split not in ("train", "test"):
        raise ValueError(f"unknown split {split!r}")
    return cycle_table(spark, f"{root}/{split}_{subset}.txt")


def remaining_life_labels(spark: SparkSession, path: str) -> DataFrame:
    """(unit_id, rul): the n-th line is unit n; lines are numbered as one file is read, in one task."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "v"))
    return lines.select((F.col("pos") + 1).cast("int").alias("unit_id"), F.col("v").try_cast("int").alias("rul")).where("rul is not null")


def modality(df: DataFrame, keys: list[str], params: dict, name: str) -> DataFrame:
    """Keys and one modality's sensors under their proper names."""
    places, names = params[f"{name}_indices"], params.get("sensor_names", {})
    return df.select(*keys, *[F.col(f"s{i + 1}").alias(names.get(f"s{i + 1}", f"s{i + 1}")) for i in places])
