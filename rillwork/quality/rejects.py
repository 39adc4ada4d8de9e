"""Raw delimited lines to typed cells, with a reason for every line that cannot be loaded.

Works on Arrow batches as they are scanned: no shuffle, so neither a hot file nor a repeated
line matters. Per batch and file:

1. lines whose quoting breaks the field grammar are set aside (they would swallow others);
2. the rest goes through pyarrow's CSV reader as strings; its invalid-row callback rejects lines
   with a wrong number of columns;
3. each column is then cast as a vector, and the cells that fail label their line.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame

SCHEMA = (
    "line_id long, in_data_path string, reason string, bad_column int, bad_value string, bad_cells array<struct<column_id:int,text:string>>, "
    "cells array<struct<column_id:int,text:string,as_long:bigint,as_double:double,as_bool:boolean,as_time:timestamp_ntz>>"
)
_CELL = pa.struct([("column_id", pa.int32()), ("text", pa.string()), ("as_long", pa.int64()), ("as_double", pa.float64()), ("as_bool", pa.bool_()), ("as_time", pa.timestamp("us"))])
_BAD = pa.list_(pa.struct([("column_id", pa.int32()), ("text", pa.string())]))
_OUT = pa.schema([("line_id", pa.int64()), ("in_data_path", pa.string()), ("reason", pa.string()), ("bad_column", pa.int32()), ("bad_value", pa.string()), ("bad_cells", _BAD), ("cells", pa.list_(_CELL))])
#: Stands for a delimiter of several characters; lines that hold it themselves are parsed alone.
_UNIT = "\x1f"

BITS = {"BYTE": 8, "INTEGER": 32, "LONG": 64}


@dataclass(frozen=True)
class FileSpec:
    delimiter: str
    count: int
    types: tuple[str, ...]


def grammar(delimiter: str) -> str:
    """RE2 pattern of a line whose fields are quoted as a whole or hold no quote."""
    d = re.escape(delimiter)
    if len(delimiter) == 1:
        bare = f'[^"{d}]*' if delimiter != "^" else '[^"\\^]*'
    else:  # what starts like the delimiter but isn't: any characters, as fields are cut by the parser
        bare = '[^"]*'
    field = f'(?:"(?:[^"]|"")*"|{bare})'
    return f"^(?s:{field}(?:{d}{field})*)$"


def _cast_int(x: pa.Array, bits: int) -> tuple[pa.Array, pa.Array]:
    """(values, ok) of texts; null where the text is no number of that many bits."""
    shape = pc.match_substring_regex(x, "^-?[0-9]+$")
    bare = pc.replace_substring_regex(x, "^(-?)0+([0-9])", "\\1\\2")
    short = pc.and_(shape, pc.less_equal(pc.binary_length(pc.replace_substring_regex(bare, "^-", "")), 18))
    small = pc.cast(pc.if_else(short, bare, pa.scalar(None, pa.string())), pa.int64())
    if bits < 64:
        ok = pc.fill_null(pc.and_(pc.greater_equal(small, -(2 ** (bits - 1))), pc.less(small, 2 ** (bits - 1))), False)
        return pc.if_else(ok, small, pa.scalar(None, pa.int64())), ok
    rest = pc.and_(shape, pc.invert(short))
    if pc.any(rest).as_py():  # 19 digits or more: few, compared as whole numbers
        values = small.to_pylist()
        for i in np.flatnonzero(pc.fill_null(rest, False).to_numpy(zero_copy_only=False)):
            digits = bare[i].as_py()
            if len(digits) <= 20 and -(2**63) <= int(digits) < 2**63:
                values[i] = int(digits)
        small = pa.array(values, pa.int64())
    return small, pc.is_valid(small)


def _cast_double(x: pa.Array) -> tuple[pa.Array, pa.Array]:
    ok = pc.match_substring_regex(x, "^-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    good = pc.if_else(ok, x, pa.scalar(None, pa.string()))
    try:
        return pc.cast(good, pa.float64()), ok
    except pa.ArrowInvalid:
        return pa.array([None if s is None else float(s) for s in good.to_pylist()], pa.float64()), ok


def _cast_bool(x: pa.Array) -> tuple[pa.Array, pa.Array]:
    low = pc.ascii_lower(x)
    yes, ok = pc.equal(low, "true"), pc.or_(pc.equal(low, "true"), pc.equal(low, "false"))
    return pc.if_else(ok, yes, pa.scalar(None, pa.bool_())), ok


def _cast_time(x: pa.Array) -> tuple[pa.Array, pa.Array]:
    shape = pc.fill_null(pc.match_substring_regex(x, "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), False)
    part = lambda a, b: pc.cast(pc.if_else(shape, pc.utf8_slice_codeunits(x, a, b), "0"), pa.int64()).to_numpy(zero_copy_only=False)
    year, month, day, hour, minute, second = part(0, 4), part(5, 7), part(8, 10), part(11, 13), part(14, 16), part(17, 19)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(month, 0, 12)] + (leap & (month == 2))
    ok = shape.to_numpy(zero_copy_only=False) & (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= last) & (hour < 24) & (minute < 60) & (second < 60)
    months = (np.where(ok, year, 1970) - 1970) * 12 + np.where(ok, month, 1) - 1
    micros = months.astype("datetime64[M]").astype("datetime64[D]").astype("int64") * 86_400 + (np.where(ok, day, 1) - 1) * 86_400 + hour * 3_600 + minute * 60 + second
    return pa.array(micros * 1_000_000, pa.int64(), mask=~ok).cast(pa.timestamp("us")), pa.array(ok)


def _split_far(line: str, spec: FileSpec) -> list[str]:
    """Fields of one line that passed the grammar, by the grammar itself (for odd lines only)."""
    out, at, d = [], 0, spec.delimiter
    while True:
        if line.startswith('"', at):
            end = at + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return []
                if line.startswith('""', end):
                    end += 2
                    continue
                break
            out.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
            if at == len(line):
                return out
            if not line.startswith(d, at):
                return []
            at += len(d)
        else:
            end = line.find(d, at)
            field = line[at:] if end < 0 else line[at:end]
            if '"' in field:
                return []
            out.append(field)
            if end < 0:
                return out
            at = end + len(d)


def _columns(lines: pa.Array, spec: FileSpec) -> tuple[np.ndarray, list[pa.Array], np.ndarray, np.ndarray]:
    """(indices, columns) of the lines with the right shape; then the indices with broken quotes and with a wrong count."""
    n = len(lines)
    sound = pc.fill_null(pc.match_substring_regex(lines, grammar(spec.delimiter)), False)
    odd = pc.fill_null(pc.or_(pc.match_substring(lines, _UNIT), pc.match_substring_regex(lines, "[\r\n]")), False)
    if len(spec.delimiter) > 1:  # quotes next to a long delimiter: the grammar's pattern is too mild there
        odd = pc.or_(odd, pc.fill_null(pc.match_substring(lines, '"'), False))
    sound, odd = sound.to_numpy(zero_copy_only=False), odd.to_numpy(zero_copy_only=False)
    broken, wrong, alone = list(np.flatnonzero(~sound)), [], {}
    for i in np.flatnonzero(odd & sound):
        fields = _split_far(lines[int(i)].as_py(), spec)
        if not fields:
            broken.append(i)
        elif len(fields) != spec.count:
            wrong.append(i)
        else:
            alone[int(i)] = fields
    plain = np.flatnonzero(sound & ~odd)
    columns = [pa.array([], pa.string()) for _ in range(spec.count)]
    good = plain
    if len(plain):
        delimiter = spec.delimiter
        chosen = lines.take(pa.array(plain))
        if len(delimiter) > 1:
            chosen, delimiter = pc.replace_substring(chosen, delimiter, _UNIT), _UNIT
        numbered = pc.binary_join_element_wise(pc.cast(pa.array(np.arange(len(plain))), pa.string()), chosen, delimiter)
        data = "\n".join(numbered.to_pylist()).encode()
        rejected: list[int] = []

        def reject(row: pacsv.InvalidRow) -> str:
            rejected.append(int(row.text.split(delimiter, 1)[0]))
            return "skip"

        names = ["#"] + [str(k) for k in range(spec.count)]
        read = pacsv.read_csv(
            io.BytesIO(data), pacsv.ReadOptions(use_threads=False, block_size=max(len(data) + 2, 1 << 16), column_names=names),
            pacsv.ParseOptions(delimiter=delimiter, quote_char='"', double_quote=True, newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=reject),
            pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()) | {"#": pa.int64()}, strings_can_be_null=False),
        )
        good = plain[read["#"].to_numpy()]
        wrong += list(plain[rejected])
        columns = [read[name].combine_chunks() if read[name].num_chunks != 1 else read[name].chunk(0) for name in names[1:]]
    if alone:
        good = np.concatenate([good, np.fromiter(alone, int)])
        columns = [pa.concat_arrays([c, pa.array([f[k] for f in alone.values()], pa.string())]) for k, c in enumerate(columns)]
    assert len(good) + len(broken) + len(wrong) == n
    return good, columns, np.array(broken, int), np.array(wrong, int)


def _parse(specs: dict[str, FileSpec], with_cells: bool):
    def rejects(batch: pa.RecordBatch, at: np.ndarray, reason: str) -> pa.Table:
        ids, paths = batch["line_id"].take(pa.array(at)), batch["in_data_path"].take(pa.array(at))
        n = len(at)
        return pa.Table.from_arrays([ids, paths, pa.array([reason] * n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, _BAD), pa.nulls(n, pa.list_(_CELL))], schema=_OUT)

    def load(batch: pa.RecordBatch, at: np.ndarray, spec: FileSpec) -> Iterator[pa.Table]:
        good, columns, broken, wrong = _columns(batch["raw_line"].take(pa.array(at)), spec)
        for rows, reason in ((broken, "broken quoting"), (wrong, "wrong column count")):
            if len(rows):
                yield rejects(batch, at[rows], reason)
        n = len(good)
        if not n:
            return
        bad_cells: dict[int, list[dict]] = {}
        cells = []
        for k, (texts, kind) in enumerate(zip(columns, spec.types, strict=True)):
            texts = pc.if_else(pc.equal(texts, ""), pa.scalar(None, pa.string()), texts)
            cast = {"as_long": pa.nulls(n, pa.int64()), "as_double": pa.nulls(n, pa.float64()), "as_bool": pa.nulls(n, pa.bool_()), "as_time": pa.nulls(n, pa.timestamp("us"))}
            ok = None
            if kind in BITS:
                cast["as_long"], ok = _cast_int(texts, BITS[kind])
            elif kind in ("FLOAT", "DOUBLE"):
                cast["as_double"], ok = _cast_double(texts)
            elif kind == "BOOLEAN":
                cast["as_bool"], ok = _cast_bool(texts)
            elif kind == "TIMESTAMP":
                cast["as_time"], ok = _cast_time(texts)
            if ok is not None:
                failed = pc.is_valid(texts).to_numpy(zero_copy_only=False) & ~pc.fill_null(ok, False).to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(failed).tolist():
                    bad_cells.setdefault(i, []).append({"column_id": k, "text": texts[i].as_py()})
            if with_cells:
                cells.append(pa.StructArray.from_arrays([pa.array(np.full(n, k, np.int32)), texts, *cast.values()], fields=list(_CELL)))
        bad, bad_col, bad_val = np.zeros(n, bool), np.full(n, -1, np.int32), np.full(n, None, object)
        for i, failing in bad_cells.items():
            bad[i], bad_col[i], bad_val[i] = True, failing[0]["column_id"], failing[0]["text"]
        where = at[good]
        if with_cells:  # column-wise to row-wise
            flat = pa.concat_arrays(cells).take(pa.array(np.arange(n * spec.count).reshape(spec.count, n).T.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * spec.count + 1, spec.count), pa.int32()), flat)
            lists = pc.if_else(pa.array(bad), pa.scalar(None, pa.list_(_CELL)), lists) if bad.any() else lists
        else:
            lists = pa.nulls(n, pa.list_(_CELL))
        types = np.array(spec.types, object)
        reason = np.where(bad, np.char.add("invalid ", types[np.maximum(bad_col, 0)].astype(str)), "")
        yield pa.Table.from_arrays([
            batch["line_id"].take(pa.array(where)), batch["in_data_path"].take(pa.array(where)), pa.array(reason.tolist(), pa.string(), mask=~bad), pa.array(bad_col, mask=~bad),
            pa.array(bad_val.tolist(), pa.string()), pa.array([bad_cells.get(i) for i in range(n)], _BAD), lists.cast(pa.list_(_CELL)),
        ], schema=_OUT)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lost = pc.is_null(batch["raw_line"]).to_numpy(zero_copy_only=False)
            encoded = batch["in_data_path"].fill_null("").dictionary_encode()
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            if lost.any():
                yield from rejects(batch, np.flatnonzero(lost), "no line").to_batches()
            for code, path in enumerate(encoded.dictionary.to_pylist()):
                at = np.flatnonzero((codes == code) & ~lost)
                if not len(at):
                    continue
                spec = specs.get(path)
                for table in load(batch, at, spec) if spec else [rejects(batch, at, "unknown file")]:
                    yield from table.to_batches()

    return parse


def read_specs(files: DataFrame, columns: DataFrame, most: int = 100_000) -> dict[str, FileSpec]:
    """File descriptions on the driver; they are settings tables, refused beyond `most` rows."""
    rows = columns.select("in_data_path", "column_id", "column_type").limit(most + 1).collect()
    heads = files.limit(most + 1).collect()
    if max(len(rows), len(heads)) > most:
        raise ValueError(f"more than {most} file descriptions")
    types: dict[str, dict[int, str]] = {}
    for r in rows:
        types.setdefault(r.in_data_path, {})[r.column_id] = (r.column_type or "STRING").upper()
    return {f.in_data_path: FileSpec(f.field_delimiter, f.column_count, tuple(types.get(f.in_data_path, {}).get(k, "STRING") for k in range(f.column_count))) for f in heads if f.in_data_path and f.field_delimiter and f.column_count}


def parse_lines(lines: DataFrame, specs: dict[str, FileSpec], *, cells: bool = True) -> DataFrame:
    """One row per line with SCHEMA: `reason` is null and `cells` typed for lines that load. `bad_cells` are all
    failing cells of a line; the first of them is its `bad_column` and `bad_value` and gives the reason.

    Defined cases: a null line is rejected ('no line'), as is one of a file without description
    ('unknown file'); an empty field is a null, quoted or not; an empty line has one empty field;
    a repeated line is a line of its own; other columns of `lines` are ignored."""
    return lines.select("line_id", "in_data_path", "raw_line").mapInArrow(_parse(specs, cells), SCHEMA)
