"""Rejected lines against a plain field-by-field reader."""

import re
from datetime import datetime

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillwork.quality import rejects

KINDS = ("STRING", "INTEGER", "DOUBLE", "BOOLEAN", "TIMESTAMP", "BYTE", "LONG")


def fields_of(line, d):
    """Fields of a line, or None where its quoting is broken."""
    out, at = [], 0
    while True:
        m = re.compile(r'"((?:[^"]|"")*)"(?=' + re.escape(d) + r"|$(?![\s\S]))").match(line, at)
        if m:
            out.append(m.group(1).replace('""', '"'))
            at = m.end()
        else:
            end = line.find(d, at)
            part = line[at:] if end < 0 else line[at:end]
            if '"' in part:
                return None
            out.append(part)
            at = len(line) if end < 0 else end
        if at == len(line):
            return out
        at += len(d)


def fits(x, kind):
    if x == "" or kind == "STRING":
        return True
    if kind in rejects.BITS:
        return bool(re.fullmatch("-?[0-9]+", x)) and -(2 ** (rejects.BITS[kind] - 1)) <= int(x) < 2 ** (rejects.BITS[kind] - 1)
    if kind == "DOUBLE":
        return bool(re.fullmatch(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", x))
    if kind == "BOOLEAN":
        return x.lower() in ("true", "false")
    try:
        datetime.strptime(x, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return False
    return bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", x))


def run(lines, spec):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int64()), pa.array(["f"] * len(lines)), pa.array(lines, pa.string())], names=["line_id", "in_data_path", "raw_line"])
    out = {}
    for b in rejects._parse({"f": spec}, True)(iter([batch])):
        for r in b.to_pylist():
            assert r["line_id"] not in out
            out[r["line_id"]] = r
    return [out[i] for i in range(len(lines))]


CELL = st.one_of(st.sampled_from(["", "1", "-5", "007", "999", "--5", "1.5", "1e5", "1e400", ".5", "true", "FALSE", "yes", "2024-02-29 10:00:00", "2023-02-29 10:00:00", "2024-01-01 24:00:00", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "127", "128", "a b", "é", "\x1f", "null", "٣"]), st.text(st.sampled_from(list('ab1"|;\n,\t ')), max_size=6))


@pytest.mark.parametrize("delimiter", [";", "|", "||", "\t", ","])
@settings(max_examples=120, deadline=None)
@given(lines=st.lists(st.lists(st.tuples(CELL, st.booleans()), min_size=6, max_size=8), min_size=1, max_size=12))
def test_against_plain_reader(delimiter, lines):
    spec = rejects.FileSpec(delimiter, 7, KINDS)
    texts = [delimiter.join('"' + c.replace('"', '""') + '"' if quoted else c for c, quoted in line) for line in lines]
    for text, got in zip(texts, run(texts, spec), strict=True):
        fields = fields_of(text, delimiter)
        if fields is None:
            assert got["reason"] in ("broken quoting", "wrong column count"), text
        elif len(fields) != 7:
            assert got["reason"] == "wrong column count", text
        else:
            good = all(map(fits, fields, KINDS))
            assert (got["reason"] is None) == good, (text, got)
            if good:
                assert [c["text"] for c in got["cells"]] == [f or None for f in fields]
                assert got["cells"][1]["as_long"] == (int(fields[1]) if fields[1] else None)


def test_odd_lines(spark):
    lines = spark.createDataFrame([(1, "f", None, 5), (2, "g", "1", 5), (3, "f", "", 5), (4, "f", "x" * 3_000_000, 5), (4, "f", "y", 5), (5, None, "z", 5)], "line_id long, in_data_path string, raw_line string, cells int")
    got = [(r.line_id, r.reason) for r in rejects.parse_lines(lines, {"f": rejects.FileSpec(";", 1, ("STRING",))}).collect()]
    assert sorted(got, key=str) == sorted([(1, "no line"), (2, "unknown file"), (3, None), (4, None), (4, None), (5, "unknown file")], key=str)
    assert rejects.parse_lines(lines.limit(0), {}).count() == 0
