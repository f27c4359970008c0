"""Files with quoted line breaks and JSON lists, cut into many splits at any byte, against readers of whole files."""

import csv
import io
import json
import random

import pytest

from clearwell.sources import splits
from clearwell.sources.files import read_delimited
from clearwell.sources.jsondata import read_json, read_json_records


@pytest.fixture(params=[48, None])
def cut(spark, request):
    """Splits of so many bytes, so that quotes and brackets are open across several of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    if request.param:
        spark.conf.set(names[0], request.param)
        spark.conf.set(names[1], request.param)
    yield request.param
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def odd_records(seed, count):
    pick = random.Random(seed)
    words = ["plain", "two\nlines", 'say "hi"', "a,b", "", "x" * 60, "\n\n", '"', 'end"\n', "é\n€", ',"', "l1\nl2\nl3\nl4", "5'"]
    return [[str(i), pick.choice(words), pick.choice(words) + "z"] for i in range(count)]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_breaks_as_a_whole_file_reader(spark, tmp_path, cut, ending):
    records = odd_records(len(ending), 100)
    for name, some in (("a.csv", records[:60]), ("b.csv", records[60:])):
        text = io.StringIO()
        writer = csv.writer(text, lineterminator=ending)
        writer.writerow(["k", "v", "w"])
        writer.writerows(some)
        (tmp_path / name).write_text(text.getvalue(), newline="")
    table = read_delimited(spark, str(tmp_path), {"multiline": True, "schema": "k int, v string, w string"})
    got = sorted(tuple(r) for r in table.data.collect())
    # empty texts are missing values
    assert got == sorted((int(k), v or None, w) for k, v, w in records)
    assert table.rejects.count() == 0
    if cut == 48:
        assert splits.quoted_records(spark, str(tmp_path), ",", "utf-8", 0).rdd.getNumPartitions() > 1


def test_stray_quotes_do_not_open_fields(spark, tmp_path, cut):
    text = 'k,v\n1,5" pipe\n2,"a ""b"" c"\n3,x"y"z\n4,"open\nline"\n5,tail"\n6,""\n7,"q\n\nr"\n'
    (tmp_path / "a.csv").write_text(text)
    got = read_delimited(spark, str(tmp_path / "a.csv"), {"multiline": True, "schema": "k int, v string"}).data
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, '5" pipe'), (2, 'a "b" c'), (3, 'x"y"z'), (4, "open\nline"), (5, 'tail"'), (6, None), (7, "q\n\nr"),
    ]


def test_too_many_fields_over_several_lines(spark, tmp_path, cut):
    (tmp_path / "a.csv").write_text('k,v\n1,"a\nb"\n2,"c\nd",3\n4,e\n')
    table = read_delimited(spark, str(tmp_path / "a.csv"), {"multiline": True})
    assert sorted(r["k"] for r in table.data.collect()) == [1, 4]
    assert [r["line"] for r in table.rejects.collect()] == ['2,"c\nd",3']


def test_skipped_lines_and_other_separators(spark, tmp_path, cut):
    (tmp_path / "a.csv").write_text('about "this\nk;v\n1;"a;\nb"\n2;c\n')
    table = read_delimited(spark, str(tmp_path / "a.csv"), {"skip_rows": 1, "multiline": True, "separator": ";"})
    assert sorted(tuple(r) for r in table.data.collect()) == [(1, "a;\nb"), (2, "c")]


def odd_values(count):
    pick = random.Random(count)
    texts = ["plain", "a},{b", "[1,2", 'say "hi"', "back\\slash", "\\", '\\"', "}", "two\nlines", "é,€", "x" * 50, ""]
    make = [
        lambda: pick.choice(texts),
        lambda: {"in": [pick.choice(texts), {"deep": pick.choice(texts)}]},
        lambda: None,
        lambda: [{"p": pick.choice(texts)} for _ in range(pick.randrange(4))],
    ]
    return [{"k": i, "t": pick.choice(texts), "v": json.dumps(make[i % 4]()), "o": {"x": {"y": pick.choice(texts)}}} for i in range(count)]


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":")}, {"separators": (" , ", " : ")}])
def test_json_lists_as_a_whole_file_reader(spark, tmp_path, cut, style):
    values = odd_values(60)
    (tmp_path / "a.json").write_text("\n " + json.dumps(values, **style) + "\n\n")
    data, rejects = read_json(spark, str(tmp_path / "a.json"))
    assert rejects is None
    got = sorted(((r["k"], r["t"], r["v"], r["o"]["x"]["y"]) for r in data.collect()))
    assert got == [(v["k"], v["t"], v["v"], v["o"]["x"]["y"]) for v in values]


def test_json_elements_of_any_kind(spark, tmp_path, cut):
    values = [1, "a,b", [2, [3, "],["]], {"k": ","}, None, True, "\\\"", []] * 20
    (tmp_path / "a.json").write_text(json.dumps(values))
    found = splits.array_elements(spark, str(tmp_path / "a.json"), False).collect()
    assert not any(r["bad"] for r in found)
    got = [x for r in found for x in json.loads(r["value"])]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, values))
    (tmp_path / "b.json").write_text(" [ ] ")
    assert [json.loads(r["value"]) for r in splits.array_elements(spark, str(tmp_path / "b.json"), False).collect()] == [[]]


def test_many_documents(spark, tmp_path, cut):
    for n in range(4):
        (tmp_path / f"{n}.json").write_text("﻿" * (n % 2) + json.dumps([{"k": n * 10 + i, "s": "},{"} for i in range(10)]))
    data = read_json(spark, str(tmp_path), "k int, s string")[0]
    assert sorted(r["k"] for r in data.collect()) == list(range(40))


@pytest.mark.parametrize("behind", ["x", ", {}", ", [1]", "[1]", ']'])
def test_what_follows_a_document_is_an_error(spark, tmp_path, cut, behind):
    for i, text in enumerate(['[{"a": 1},\n {"a": 2}]', '{"a": {"b": [1, 2]},\n "c": "}x"}']):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        assert read_json_records(spark, str(path)).count() == 2 - i
        path.write_text(text + "\n" + behind)
        with pytest.raises(Exception):  # noqa: B017 - of the reader or of the job
            read_json(spark, str(path))[0].collect()
