"""Packed text stores: relation records and tokenizers.

Formats (fixed): a store is `NSTORE1`, a count, `R` lines (rid, lhs, formula, name, req,
number of variables) each followed by `V` lines (variable, unit, constant), and `END`
with the count.  A tokenizer is `NSTOK1`, four counts, `S` (id, literal), `V` (id, hex)
and `M` (rank, hex, hex) lines, and `END`.  Fields are separated by tabs.

A file is small by definition (at most MAX_RECORDS records), so it is read whole and
parsed by one function; a broken file gives one error row and never half its records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RECORDS, MAX_VARS = 4096, 8


class Broken(ValueError):
    """A packed file that breaks the format; the message is the error code."""


def parse_store(text: str) -> list[dict]:
    lines = text.removesuffix("\n").split("\n")
    if not lines or lines[0] != "NSTORE1":
        raise Broken("magic")
    if len(lines) < 2 or not lines[1].isdigit():
        raise Broken("count")
    count = int(lines[1])
    if count > MAX_RECORDS:
        raise Broken("too_many")
    out: list[dict] = []
    due, ended = 0, False
    for line in lines[2:]:
        if ended:
            if line:
                raise Broken("after_end")
            continue
        kind, *rest = line.split("\t")
        if kind == "R":
            if due:
                raise Broken("missing_variable")
            if len(rest) != 6 or not rest[5].isdigit():
                raise Broken("record")
            due = int(rest[5])
            if due > MAX_VARS:
                raise Broken("too_many_variables")
            out.append(dict(zip(("rid", "lhs", "formula", "name", "req"), rest)) | {"vars": []})
        elif kind == "V":
            if not out or not due:
                raise Broken("stray_variable")
            if len(rest) != 3 or not rest[0]:
                raise Broken("empty_variable")
            if not rest[1]:
                raise Broken("empty_unit")
            out[-1]["vars"].append(dict(zip(("var", "unit", "cval"), rest)))
            due -= 1
        elif kind == "END":
            if due:
                raise Broken("missing_variable")
            if rest != [str(count)] or len(out) != count:
                raise Broken("end_count")
            ended = True
        else:
            raise Broken("tag")
    if not ended:
        raise Broken("no_end")
    return out


RECORD = "rid string, lhs string, formula string, name string, req string, vars array<struct<var:string,unit:string,cval:string>>, error string"


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for text in pdf["value"]:
            try:
                rows, error = parse_store(text), None
            except Broken as e:
                rows, error = [dict.fromkeys(("rid", "lhs", "formula", "name", "req", "vars"))], str(e)
            if rows:
                yield pd.DataFrame(rows).assign(error=error)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Records of packed stores, or one row with an error code for each broken file."""
    return spark.read.text(path, wholetext=True).mapInPandas(_records, RECORD)


def write_store(records: DataFrame, path: str) -> None:
    """Write a store of at most MAX_RECORDS records as one text file, in order of rid."""
    n = records.count()
    if n > MAX_RECORDS:
        raise Broken("too_many")
    v = F.transform("vars", lambda x: F.concat_ws("\t", F.lit("V"), x["var"], x["unit"], x["cval"]))
    head = F.concat_ws("\t", F.lit("R"), "rid", "lhs", "formula", "name", "req", F.size("vars").cast("string"))
    block = records.select("rid", F.array_join(F.concat(F.array(head), v), "\n").alias("block"))
    body = block.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rid", "block"))), lambda b: b["block"]), "\n").alias("b"))
    parts = F.filter(F.array(F.lit(f"NSTORE1\n{n}"), F.nullif("b", F.lit("")), F.lit(f"END\t{n}")), lambda p: p.isNotNull())
    body.select(F.array_join(parts, "\n").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def pack_tokenizer(specials: list[tuple[int, str]], vocab: list[tuple[int, bytes]], merges: list[tuple[bytes, bytes]]) -> str:
    lines = ["NSTOK1", str(len(specials)), str(len(vocab)), str(len(merges)), str(len(specials) + len(vocab))]
    lines += [f"S\t{i}\t{s}" for i, s in specials]
    lines += [f"V\t{i}\t{b.hex()}" for i, b in vocab]
    lines += [f"M\t{r}\t{a.hex()}\t{b.hex()}" for r, (a, b) in enumerate(merges)]
    return "\n".join([*lines, "END", ""])


def parse_tokenizer(text: str) -> tuple[list[tuple[int, str]], list[tuple[int, bytes]], list[tuple[bytes, bytes]]]:
    lines = text.split("\n")
    if lines[0] != "NSTOK1":
        raise Broken("magic")
    if "END" not in lines:
        raise Broken("no_end")
    counts = list(map(int, lines[1:5]))
    rows = [x.split("\t") for x in lines[5 : lines.index("END")]]
    specials = [(int(r[1]), r[2]) for r in rows if r[0] == "S"]
    vocab = [(int(r[1]), bytes.fromhex(r[2])) for r in rows if r[0] == "V"]
    ranked = [(int(r[1]), bytes.fromhex(r[2]), bytes.fromhex(r[3])) for r in rows if r[0] == "M"]
    if [len(specials), len(vocab), len(ranked)] != counts[:3]:
        raise Broken("count")
    if [r[0] for r in ranked] != list(range(len(ranked))):
        raise Broken("merge_order")
    return specials, vocab, [(a, b) for _, a, b in ranked]
