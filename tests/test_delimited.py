"""Splittable delimited reader against the whole-file reader."""

import os
import random
import uuid

import pytest

from wingwatch.session import checkpoint_dir
from wingwatch.sources import delimited as D

SEP = "\t"


def _folder(spark):
    path = os.path.join(checkpoint_dir(spark), f"tsv-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _field(rng):
    kind = rng.random()
    plain = "".join(rng.choice("abc de,é'") for _ in range(rng.randrange(0, 30)))
    if kind < 0.55:
        return plain.strip() or "x"
    if kind < 0.6:
        return f'{plain.strip()}z 5" pipe'  # a quote inside an unquoted field
    inner = "".join(rng.choice(["a", "b c", SEP, '""', "\n", "\n\n", "é", '""""']) for _ in range(rng.randrange(1, 12)))
    return f'"k{inner}k"'


def _whole(spark, path, encoding="UTF-8"):
    reader = (spark.read.option("sep", SEP).option("header", True).option("encoding", encoding).option("multiLine", True)
              .option("quote", '"').option("escape", '"'))
    names = reader.csv(path).columns
    every = reader.schema(", ".join(f"`{n}` string" for n in [*names, D.CORRUPT])).option("columnNameOfCorruptRecord", D.CORRUPT).csv(path).collect()
    return (sorted((tuple(r)[:-1] for r in every if r[-1] is None), key=repr), sorted(r[-1] for r in every if r[-1] is not None))


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_equals_the_whole_file_reader(spark, encoding):
    rng = random.Random(encoding)
    folder = _folder(spark)
    for k in range(3):
        lines = [SEP.join(["ACN", "Report 1 / Narrative", "Place"])]
        for i in range(900 if k == 0 else 20):
            n = 3 if rng.random() > 0.03 else rng.choice([2, 4])
            lines.append(SEP.join([str(i), *[_field(rng) for _ in range(n - 1)]]))
        with open(os.path.join(folder, f"r{k}.tsv"), "w", encoding=encoding, newline="") as f:
            f.write("\n".join(lines) + "\n" * (k % 2))
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "3000")
    try:
        assert D._lines(spark, folder).rdd.getNumPartitions() > 8  # one file, many tasks
        rows, rejects = D.read_delimited(spark, folder)
        got = sorted(map(tuple, rows.collect()), key=repr), sorted(r[0] for r in rejects.collect())
        assert D.records(spark, folder)[1] == encoding
    finally:
        spark.conf.unset(key)
    want = _whole(spark, folder, encoding)
    assert got[0] == want[0] and len(got[0]) > 850
    assert len(got[1]) == len(want[1]) > 10


def test_a_record_over_many_splits_and_an_empty_file(spark):
    folder = _folder(spark)
    long = "\n".join(f"line {i}" for i in range(3000))
    with open(os.path.join(folder, "a.tsv"), "w") as f:
        f.write(f'k\tv\n1\t"{long}"\n2\tb\n')
    open(os.path.join(folder, "b.tsv"), "w").close()
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "2000")
    try:
        rows, rejects = D.read_delimited(spark, os.path.join(folder, "a.tsv"))
        assert {r[0]: r[1] for r in rows.collect()} == {"1": long, "2": "b"} and rejects.isEmpty()
        rows, _ = D.read_delimited(spark, folder)
        assert rows.count() == 2
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("line, inside, want", [(b"a\tb", False, False), (b'"a', False, True), (b'a"b', False, False), (b'x"\t"y', True, True),
                                                (b'x""y', True, True), (b'x"', True, False), (b'"a"\t"b""', False, True), (b'"a"z"', False, False)])
def test_quoting_rule(line, inside, want):
    assert D.ends_inside(line, inside, b"\t") is want
