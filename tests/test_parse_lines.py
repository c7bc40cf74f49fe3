import csv
import datetime
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.operators.parse_lines import parse_reads, record_ends

GOOD = "frag,1,ACGTN.,IIIIII,6,40.0,2016-01-05"


def reason(line, offset):
    """The rules, one character at a time."""
    line = line or ""
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            j, text = i + 1, ""
            while True:
                if j >= len(line):
                    return "quoting"
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        text, j = text + '"', j + 2
                        continue
                    break
                text, j = text + line[j], j + 1
            i = j + 1
            if i < len(line) and line[i] != ",":
                return "quoting"
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            text, i = line[i:j], j
            if '"' in text:
                return "quoting"
        fields.append(text)
        if i >= len(line):
            break
        i += 1
    if len(fields) != 7:
        return "column_count"
    name, mate, seq, qual, n, mean, day = fields
    digits = lambda x: bool(x) and all(c in "0123456789" for c in x)
    ok = name.strip() != "" and mate in ("1", "2") and seq != "" and set(seq) <= set("ACGTNacgtn.")
    ok = ok and len(qual) == len(seq) and all(offset <= ord(c) <= offset + 41 for c in qual) and digits(n) and int(n) == len(seq)
    parts = mean.split(".")
    ok = ok and (mean == "" or len(parts) <= 2 and all(map(digits, parts)) and float(mean) <= 41)
    try:
        datetime.date.fromisoformat(day)
        ok = ok and len(day) == 10 and day[4] == day[7] == "-"
    except ValueError:
        ok = False
    return None if ok else "value"


LINES = [
    GOOD, GOOD + "\r", GOOD + "\r\r", None, "", ",", '"', '""', '"""', '""""', "a" + '"' + GOOD, '"a"b' + GOOD[4:], '"lib ""x""",' + GOOD[5:], GOOD + ",", GOOD + ',"', GOOD.replace("frag", "   "),
    GOOD.replace("frag", '"a,b"'), GOOD.replace("IIIIII", '"II""III"'), GOOD.replace("IIIIII", '"IIIII"'), GOOD.replace(",6,", ",06,"), GOOD.replace(",6,", "," + "0" * 30 + "6,"), GOOD.replace(",6,", "," + "9" * 30 + ","),
    GOOD.replace("40.0", ""), GOOD.replace("40.0", "41.01"), GOOD.replace("40.0", "41.00"), GOOD.replace("40.0", "4."), GOOD.replace("40.0", ".4"), GOOD.replace("2016-01-05", "2016-02-30"), GOOD.replace("2016-01-05", "2016-02-29"),
    GOOD.replace("2016-01-05", "2015-02-29"), GOOD.replace("2016-01-05", "0000-01-01"), GOOD.replace("2016-01-05", "2016-1-05"), GOOD.replace(",1,", ",3,"), GOOD.replace(",1,", ',"2",'), GOOD.replace("IIIIII", "IIIIIé"), GOOD.replace("frag", "näme"), GOOD.replace("IIIIII", "KKKKKK"),
    "x,1," + "A" * 100_000 + "," + "I" * 100_000 + ",100000,,2016-01-05",
]


@pytest.mark.parametrize("offset", [33, 64])
def test_reasons_match_one_character_at_a_time(spark, offset):
    rng = random.Random(offset)
    lines = LINES + ["".join(rng.choice(['"', ",", "A", "1", "\n", "é"]) for _ in range(rng.randrange(12))) for _ in range(600)]
    lines += [GOOD[:i] + rng.choice('",A1 ') + GOOD[i + 1 :] for i in range(len(GOOD))]
    df = spark.createDataFrame([(i, x, None if offset == 33 else offset, "?") for i, x in enumerate(lines)], "id long, line string, off int, reason string").drop("reason")
    got = {r.id: r.reason for r in parse_reads(df, F.col("line"), F.col("off"), "id").collect()}
    assert [got[i] for i in range(len(lines))] == [reason(x, offset) for x in lines]


def test_valid_lines_come_out_typed(spark):
    df = spark.createDataFrame([(1, '"a ""b"", c",2,"acG","I""J",3,,2016-02-29\r')], "id long, line string")
    row = parse_reads(df, F.col("line"), F.lit(None), "id").first()
    assert row.asDict() == {"id": 1, "reason": None, "name": 'a "b", c', "mate": 2, "seq": "acG", "qual": [40, 1, 41], "n_bases": 3, "mean_qual": None, "run_date": datetime.date(2016, 2, 29)}


def test_empty_table_and_raw_text(spark):
    assert parse_reads(spark.createDataFrame([], "id long, line string"), F.col("line"), F.lit(33), "id").collect() == []
    text = b'a,"x\ny"\nb,"z"\n'
    assert [int(i) for i in record_ends(np.frombuffer(text, np.uint8))] == [7, 13]
    assert len(list(csv.reader(io.StringIO(text.decode())))) == 2
