import datetime as dt
import io
import zipfile

import pytest

from clearwell.sources import registry
from clearwell.sources.files import read_delimited, read_file, read_table, read_upload
from clearwell.sources.jdbc import bind, jdbc_options, query_params
from clearwell.sources.jsondata import flatten, read_json, read_json_records, records_from_bodies
from clearwell.sources.office import read_docx, read_excel
from clearwell.sources import rest
from clearwell.sources.rest import read_api, read_bodies
from clearwell.sources.textlines import numbered_lines, read_text_table, read_text_tables, sniff_separator, split_lines


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- delimited files


def test_csv(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'id,name,score,ok,when\n1,"Ann, B",1.5,True,2024-01-02\n2,NA,,False,bad\n')
    df = read_file(spark, {"path": path, "date_columns": ["when"]})
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "boolean", "timestamp"]
    assert rows(df) == [(1, "Ann, B", 1.5, True, dt.datetime(2024, 1, 2)), (2, None, None, False, None)]


def test_csv_columns_in_order(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b,c\n1,2,3\n")
    assert read_file(spark, {"path": path, "columns": ["c", "a"]}).columns == ["c", "a"]
    with pytest.raises(ValueError, match="nope"):
        read_file(spark, {"path": path, "columns": ["nope"]})


def test_tsv_and_unknown_extension(spark, tmp_path):
    assert rows(read_file(spark, {"path": write(tmp_path, "a.tsv", "a\tb\n1\tx\n")})) == [(1, "x")]
    assert rows(read_file(spark, {"path": write(tmp_path, "a.dat", "a;b\n1;x\n"), "separator": ";"})) == [(1, "x")]


def test_long_lines_are_rejected_and_short_ones_padded(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b,c\n1,2,3\n1,2,3,4\n1,2,3,\n7\n8,9,\n1,2,3,4,5\n\n")
    table = read_delimited(spark, path)
    assert sorted(rows(table.data), key=str) == [(1, 2, 3), (7, None, None), (8, 9, None)]
    assert table.rejects.count() == 3


def test_explicit_schema(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b\n1,2\nx,3.5\n")
    df = read_file(spark, {"path": path, "schema": "a int, b double"})
    assert df.dtypes == [("a", "int"), ("b", "double")] and rows(df) == [(1, 2.0), (None, 3.5)]


def test_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b\n"say ""hi""","two\nlines"\n')
    assert rows(read_delimited(spark, path, {"multiline": True}).data) == [('say "hi"', "two\nlines")]


def test_skip_rows(spark, tmp_path):
    text = "made by x\n\na,b\n" + "".join(f"{i},v{i}\n" for i in range(50))
    df = read_file(spark, {"path": write(tmp_path, "a.csv", text), "skip_rows": 2})
    assert df.columns == ["a", "b"] and sorted(r[0] for r in df.collect()) == list(range(50))


def test_repeated_and_empty_header_names(spark, tmp_path):
    assert read_file(spark, {"path": write(tmp_path, "a.csv", "a,a,,b\n1,2,3,4\n")}).columns == ["a", "a.1", "Unnamed: 2", "b"]


def test_missing_file_and_keys(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_file(spark, {"path": str(tmp_path / "none.csv")})
    with pytest.raises(ValueError, match="path"):
        read_file(spark, {})


def test_upload_encodings(spark, tmp_path):
    write(tmp_path, "a.csv", "name,n\nJosé,1\n")
    write(tmp_path, "b.csv", "name,n\nJosé,2\n", "latin-1")
    with pytest.warns(UserWarning, match="Latin-1"):
        df = read_upload(spark, str(tmp_path))
    assert sorted(rows(df)) == [("José", 1), ("José", 2)]


def test_json_and_parquet(spark, tmp_path):
    assert sorted(rows(read_file(spark, {"path": write(tmp_path, "a.jsonl", '{"x":1,"y":"a"}\n{"x":2,"y":"b"}\n')}))) == [(1, "a"), (2, "b")]
    assert rows(read_file(spark, {"path": write(tmp_path, "a.json", '[\n {"x": 1},\n {"x": 2}\n]')})) == [(1,), (2,)]
    spark.createDataFrame([(1,), (2,), (3,)], "val bigint").write.parquet(str(tmp_path / "t.parquet"))
    assert read_file(spark, {"path": str(tmp_path / "t.parquet")}).count() == 3


# -- JSON shapes


@pytest.mark.parametrize(
    "name, text, columns, count",
    [
        ("a.json", '[{"a": 1}, {"a": 2, "b": "x"}]', ["a", "b"], 2),
        ("b.json", '{"meta": 1, "results": [{"a": 1}, {"a": 2}]}', ["a"], 2),
        ("c.json", '{"user": {"id": 1, "tags": [1, 2]}, "n": 2}', ["n", "user.id", "user.tags"], 1),
        ("d.json", '{"a": 1}\n{"a": 2}\n', ["a"], 2),
        ("e.json", '[\n{"a": 1},\n{"a": 2}\n]', ["a"], 2),
        ("f.json", "42", ["value"], 1),
        ("g.jsonl", '{"a": 1}\n', ["a"], 1),
    ],
)
def test_json_records(spark, tmp_path, name, text, columns, count):
    df = read_json_records(spark, write(tmp_path, name, text))
    assert sorted(df.columns) == sorted(columns) and df.count() == count


def test_flatten_separator(spark):
    df = spark.sql("select named_struct('b', 1, 'c', named_struct('d', 2)) as a, 3 as e")
    assert flatten(df, "_").columns == ["a_b", "a_c_d", "e"]


def test_records_of_bodies(spark):
    bodies = ['{"data": [{"k": 1}]}', '[{"k": 2}, {"k": 3}]', "{}", "null", '{"k": 4}', '{"data": {"k": 5}}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert sorted(r[0] for r in records_from_bodies(df, "body", "struct<k: int>", "data").collect()) == [1, 2, 3]
    plain = records_from_bodies(df, "body", "struct<k: int>").collect()
    assert sorted(r[0] for r in plain if r[0]) == [2, 3, 4]


# -- text


def test_sniffing():
    assert sniff_separator(["a,b|c", "d,e"]) == "," and sniff_separator(["a|b", "c|d"]) == "|"
    assert sniff_separator(["a,b", "c"]) is None and sniff_separator([]) is None


def test_text_table(spark, tmp_path):
    assert rows(read_text_table(spark, write(tmp_path, "a.txt", "x|y\n1|a\n2|b\n"))) == [(1, "a"), (2, "b")]
    lines = read_text_table(spark, write(tmp_path, "b.txt", "one  \n\n   \ntwo\n"))
    assert sorted(rows(lines)) == [(1, "one"), (2, "two")]


def test_many_text_files(spark, tmp_path):
    write(tmp_path, "a.txt", "x|y\n" + "1|a\n" * 9)
    write(tmp_path, "b.txt", "\nx|y\n\n2|b\n")
    write(tmp_path, "c.txt", "p;q\n3;c\n")
    write(tmp_path, "d.txt", "plain\nlines\n")
    found = read_text_tables(spark, str(tmp_path))
    assert {k: v.count() for k, v in found.items()} == {"|": 10, ";": 1, None: 2}
    assert found["|"].columns == ["x", "y"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    text = "".join(f"line {i}\n" + ("\n" if i % 3 else "") for i in range(2000))
    path = write(tmp_path, "big.txt", text)
    write(tmp_path, "other.txt", "x\ny\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r["file"][-7:], r["line_number"], r["text"]) for r in numbered_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [g for g in got if g[0] == "big.txt"] == [("big.txt", i + 1, f"line {i}") for i in range(2000)]
    assert len(got) == 2002 and path


def test_split_lines(spark):
    df = spark.createDataFrame([(1, "a \r\n\n b c"), (2, "")], "id int, t string")
    assert rows(split_lines(df, "t", ["id"])) == [(1, 1, "a"), (1, 2, " b"), (1, 3, "c")]


# -- office files

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def archive(folder, name, parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for part, text in parts.items():
            z.writestr(part, text)
    (folder / name).write_bytes(buffer.getvalue())
    return str(folder / name)


def workbook(folder):
    sheet1 = (
        f'<worksheet xmlns="{MAIN}"><sheetData>'
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>name</t></is></c><c r="D1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="inlineStr"><is><t>Ann</t></is></c><c r="D2" s="1"><v>45292.5</v></c></row>'
        '<row r="3"><c r="A3"><v>2</v></c><c r="D3" s="1"><v>45293</v></c></row>'
        "</sheetData></worksheet>"
    )
    sheet2 = f'<worksheet xmlns="{MAIN}"><sheetData><row><c t="b"><v>1</v></c></row><row><c><v>7</v></c></row></sheetData></worksheet>'
    return archive(folder, "w.xlsx", {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="Data" r:id="r1"/><sheet name="More" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><t>id</t></si><si><r><t>at</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet1,
        "xl/worksheets/sheet2.xml": sheet2,
    })


def test_excel(spark, tmp_path):
    table = read_excel(spark, workbook(tmp_path))
    assert table.data.columns == ["id", "name", "Unnamed: 2", "at"] and table.metadata["sheet_names"] == ["Data", "More"]
    assert rows(table.data) == [(1, "Ann", None, "2024-01-01 12:00:00"), (2, None, None, "2024-01-02 00:00:00")]
    with pytest.warns(UserWarning, match="not found"):
        assert read_excel(spark, str(tmp_path / "w.xlsx"), "Nope").metadata["loaded_sheet"] == "Data"
    assert rows(read_excel(spark, str(tmp_path / "w.xlsx"), "More").data) == [(7,)]
    assert read_file(spark, {"path": str(tmp_path / "w.xlsx"), "columns": ["name"]}).count() == 2


def paragraph(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def table(*lines):
    cells = lambda line: "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in line)
    return "<w:tbl>" + "".join(f"<w:tr>{cells(line)}</w:tr>" for line in lines) + "</w:tbl>"


def document(folder, name, body):
    return archive(folder, name, {"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>'})


def test_docx(spark, tmp_path):
    path = document(tmp_path, "t.docx", paragraph("Hi") + table(["a", "b"], ["1", "x"]) + table(["b", "c"], ["y", " z "]))
    found = read_docx(spark, path)
    assert found.data.columns == ["a", "b", "c"] and sorted(rows(found.data), key=str) == [("1", "x", None), (None, "y", "z")]
    plain = read_docx(spark, document(tmp_path, "p.docx", paragraph(" One ") + paragraph(" ") + paragraph("Two")))
    assert rows(plain.data) == [(1, "One"), (2, "Two")] and plain.warnings


# -- HTTP and SQL


def make_fetch(pages, key="data"):
    def fetch(url, params):
        page = params.get("page", 1)
        if not pages:
            return {key: [{"since": params.get("since"), "url": url}]}
        batch = [{"id": (page - 1) * params["per_page"] + i} for i in range(params["per_page"])] if page <= pages else []
        return {key: batch, "next": page < pages or None}

    return fetch


def test_paged_source(spark):
    config = {"url": "u", "pagination": {"size": 10}, "data_key": "data", "schema": "struct<id: bigint>"}
    assert sorted(r[0] for r in read_api(spark, config, make_fetch(3)).collect()) == list(range(30))
    del config["schema"]
    assert read_api(spark, config, make_fetch(2)).dtypes == [("id", "bigint")]


def test_paged_source_in_ranges(spark):
    config = {"url": "u", "pagination": {"size": 2, "total_pages": 9, "tasks": 4}, "data_key": "data"}
    bodies = read_bodies(spark, config, make_fetch(9))
    assert bodies.rdd.getNumPartitions() == 4
    assert sorted(r["page"] for r in bodies.collect()) == list(range(1, 10))


@pytest.mark.parametrize("pages", [0, 1, 2, 3, 7, 8, 9, 64, 1000])
def test_last_page_by_bisection(pages):
    asked = []
    fetch = make_fetch(pages)

    def counted(url, params):
        asked.append(params["page"])
        return fetch(url, params)

    config = {"url": "u", "pagination": {"size": 1}, "data_key": "data"}
    assert rest.last_page(counted, config, {}, 10**9) == max(pages, 1)
    assert len(asked) <= 2 * max(pages, 1).bit_length() + 2
    ranges = rest.spans(fetch, config, {})
    assert len(ranges) == min(8, max(pages, 1)) and [r.first for r in ranges] == sorted({r.first for r in ranges})
    assert [a.last + 1 for a in ranges[:-1]] == [b.first for b in ranges[1:]]


@pytest.mark.parametrize("pages", [1, 5, 23])
def test_pages_of_unknown_number_in_several_tasks(spark, pages):
    config = {"url": "u", "pagination": {"size": 2}, "data_key": "data"}
    bodies = read_bodies(spark, config, make_fetch(pages))
    assert bodies.rdd.getNumPartitions() == min(8, pages)
    assert sorted(r["page"] for r in bodies.collect()) == list(range(1, pages + 1))


def test_pages_that_fail_behind_the_end(spark):
    """A failing probe shortens the ranges, never the result."""
    base = make_fetch(10)

    def fetch(url, params):
        if params["page"] in (4, 16) and "walk" not in params:
            raise OSError("no such page")
        return base(url, params)

    config = {"url": "u", "pagination": {"size": 2}, "data_key": "data"}
    assert rest.last_page(fetch, config, {}, 10**9) <= 10
    ranges = rest.spans(fetch, config, {})
    got = [p for r in ranges for p, _ in rest._pages(base, config, {}, r)]
    assert got == list(range(1, 11))


def test_a_page_without_successor_amid_others_is_an_error():
    def fetch(url, params):
        page = params["page"]
        return {"data": [page] if page <= 20 else [], "next": page < 20 and page != 3}

    config = {"url": "u", "pagination": {"size": 1}, "data_key": "data"}
    with pytest.raises(RuntimeError, match="page 3 is the last"):
        [p for r in rest.spans(fetch, config, {}) for p in rest._pages(fetch, config, {}, r)]


def test_page_limit(spark):
    config = {"url": "u", "pagination": {"size": 1, "max_pages": 4}, "data_key": "data"}
    with pytest.raises(Exception, match="pages after max_pages"):
        read_bodies(spark, config, make_fetch(100)).count()
    del config["pagination"]["max_pages"]
    assert read_bodies(spark, config, make_fetch(700)).count() == 700


def test_single_fetch_with_mark(spark):
    config = {"url": "u", "data_key": "data", "schema": "struct<since: string, url: string>"}
    assert rows(read_api(spark, config, make_fetch(0), "2024-01-01")) == [("2024-01-01", "u")]


def test_jdbc_options():
    base = {"connection_string": "jdbc:x", "table": "t"}
    assert jdbc_options(base)["dbtable"] == "public.t" and jdbc_options(base)["fetchsize"] == "50000"
    assert jdbc_options({**base, "schema": None})["dbtable"] == "t"
    assert jdbc_options({"connection_string": "jdbc:x", "query": "select 1"})["dbtable"] == "(select 1) source_query"
    with pytest.raises(ValueError):
        jdbc_options({"connection_string": "jdbc:x"})
    with pytest.raises(ValueError, match="lower_bound"):
        jdbc_options({**base, "partition_column": "id"})


def test_bound_queries():
    query = "select ':no', \"a:b\", x::int from t where a > :checkpoint and b = :name and c in (:n)"
    bound = bind(query, {"checkpoint": "2024-01-01", "name": "O'Hara", "n": 5})
    assert bound == "select ':no', \"a:b\", x::int from t where a > '2024-01-01' and b = 'O''Hara' and c in (5)"
    with pytest.raises(ValueError, match=":name"):
        bind(query, {"checkpoint": None})
    config = {"query": "select :checkpoint", "incremental": True, "params": {"a": 1}}
    assert query_params(config, "7") == {"a": 1, "checkpoint": "7"} and query_params(config)["checkpoint"] is None
    assert bind("select :checkpoint", {"checkpoint": None}) == "select NULL"


def test_registry(spark, tmp_path):
    assert len(registry.list_sources()) == 12
    with pytest.raises(ValueError, match="Unknown source type"):
        registry.get_source({"type": "ftp"})
    registry.register_source("ones", lambda spark, config, checkpoint=None: spark.range(config["n"]))
    try:
        assert registry.extract(spark, {"type": "Ones", "n": 4}).count() == 4
    finally:
        del registry.SOURCES["ones"]
    with pytest.raises(TypeError):
        registry.register_source("x", 5)


def test_ingest_by_extension(spark, tmp_path):
    assert registry.ingest(spark, write(tmp_path, "a.csv", "a\n1\n")).count() == 1
    assert registry.ingest(spark, write(tmp_path, "a.txt", "hello\nworld\n")).columns == ["line_number", "text"]
    assert registry.ingest(spark, write(tmp_path, "a.json", '{"items": [{"q": 1}]}')).columns == ["q"]
    assert registry.ingest(spark, workbook(tmp_path)).count() == 2
    with pytest.raises(ValueError, match="not supported"):
        registry.ingest(spark, "report.pdf")
    assert registry.ingest(spark, document(tmp_path, "d.docx", paragraph("x"))).count() == 1


# -- nothing is lost in silence


def test_folder_of_differing_headers(spark, tmp_path):
    for name, text in (("1.csv", "id,name\n1,p\n"), ("2.csv", "name,id\nq,7\n"), ("3.csv", "id,name,extra\n3,r,x\n")):
        (tmp_path / name).write_text(text)
    table = read_delimited(spark, str(tmp_path))
    assert {(r.id, r.name, r.extra) for r in table.data.collect()} == {(1, "p", None), (7, "q", None), (3, "r", "x")}
    assert table.rejects.count() == 0
    assert read_upload(spark, str(tmp_path)).count() == 3


def test_bad_json_line_goes_alone(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"x": 1}\n{"x": 2}\n{"x": broken\n{"x": 4}\n5\n')
    data, rejects = read_json(spark, str(path))
    assert sorted(r.x for r in data.collect()) == [1, 2, 4] and rejects.count() == 2
    with pytest.warns(UserWarning, match="2 lines"):
        assert read_json_records(spark, str(path)).count() == 3
    table = read_table(spark, {"path": str(path)})
    assert table.rejects.count() == 2


def test_json_file_of_lines(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    assert read_file(spark, {"path": str(path)}).count() == 3
    path.write_text('{"x": {"y": 1}}\nrest\n')
    assert read_json(spark, str(path))[1].count() == 1
    path.write_text('{\n"x": 1\n}\n{\n"x": 2\n}\n')
    with pytest.raises(ValueError, match="neither"):
        read_json(spark, str(path))


def test_rejected_lines_are_reported(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.warns(UserWarning, match="1 lines"):
        assert read_file(spark, {"path": path}).count() == 1
    assert [r.line for r in read_table(spark, {"path": path}).rejects.collect()] == ["3,4,5"]


def test_skipped_lines_before_quoted_breaks(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'note\na,b\n"one\ntwo",2\nthree,4\n')
    table = read_delimited(spark, path, {"skip_rows": 1, "multiline": True})
    assert sorted(map(tuple, table.data.collect())) == [("one\ntwo", 2), ("three", 4)]


def test_bound_values_stay_values():
    assert bind("x = :a and d = :d", {"a": "it's", "d": dt.date(2024, 1, 2)}) == "x = 'it''s' and d = DATE '2024-01-02'"
    with pytest.raises(ValueError, match="backslash"):
        bind("x = :a", {"a": "\\' or 1 = 1 --"})
