from __future__ import annotations

import pytest
from pyspark.sql import DataFrameWriter

from tabscope.queries import QUERIES, load_all
from tabscope.session import shared_path
from tabscope.sources import csv_tables, records, registry, tables, uploads

load_all()


def write(tmp_path, name, text) -> str:
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_csv_types_and_names(spark, flow_table, capture):
    assert flow_table.columns == [c.strip() for c in capture.columns]
    types = dict(flow_table.dtypes)
    assert types["Sensor"] == "bigint" and types["Label"] == "string"
    assert types["Ratio/s"] == "double"
    assert flow_table.count() == 529


def test_names_are_kept_on_request(spark, capture_csv, capture):
    assert csv_tables.load_csv(spark, capture_csv, normalize=False).columns == list(capture.columns)


def test_repeated_and_colliding_headers():
    assert csv_tables.header_names("a,b,a, c,a") == ["a", "b", "a.1", "c", "a.2"]
    assert csv_tables.header_names('"x,y",z') == ["x,y", "z"]
    with pytest.raises(ValueError, match="collide"):
        csv_tables.header_names(" A,A")


def test_cell_kinds(spark, tmp_path):
    path = write(
        tmp_path,
        "kinds.csv",
        "i,i_gap,f,big,b,b_gap,mix,t,empty,suffix\n"
        "1,5,1.5,1,True,True,1,x,,1d\n"
        " 2,NA,inf,99999999999999999999,False,,True,y,,2\n"
        "-3,7,-1e3,2,True,False,2,1,NaN,3\n",
    )
    df = csv_tables.load_csv(spark, path)
    assert dict(df.dtypes) == {
        "i": "bigint", "i_gap": "double", "f": "double", "big": "double", "b": "boolean",
        "b_gap": "string", "mix": "string", "t": "string", "empty": "double", "suffix": "string",
    }
    rows = df.collect()
    assert [r.i for r in rows] == [1, 2, -3] and [r.i_gap for r in rows] == [5.0, None, 7.0]
    assert [r.f for r in rows] == [1.5, float("inf"), -1000.0]
    given = csv_tables.load_csv(spark, path, types={**dict.fromkeys(df.columns, "string"), "i": "bigint"})
    assert dict(given.dtypes)["f"] == "string"


def test_day_catalogue(spark, capture_csv):
    raw = capture_csv.rsplit("/", 1)[0]
    assert csv_tables.load_day(spark, raw_dir=raw).count() == 529
    with pytest.raises(ValueError, match="no capture is catalogued"):
        csv_tables.resolve_day(spark, "sunday", raw)
    with pytest.raises(csv_tables.CaptureMissingError):
        csv_tables.resolve_day(spark, "monday", raw)
    both = csv_tables.load_days(spark, ["wednesday"], raw_dir=raw)
    assert both.select("day").distinct().first().day == "wednesday"


def test_model_versions(spark, tmp_path):
    root = str(tmp_path / "models")
    assert registry.free_version(spark, root) == "v1"
    with pytest.raises(FileNotFoundError, match="no trained model"):
        registry.version_path(spark, root)
    for name in ("v1", "v3", "v2", "v10", "preprocessing", "v4b"):
        (tmp_path / "models" / name).mkdir(parents=True)
        (tmp_path / "models" / name / registry.COMPLETE).touch()
    (tmp_path / "models" / "v99").write_text("a file, not a version")
    assert registry.free_version(spark, root) == "v11"
    assert registry.version_path(spark, root, "v2").endswith("/v2")
    assert registry.version_path(spark, root + "/").endswith("models/v10")
    with pytest.raises(FileNotFoundError, match="no model v7"):
        registry.version_path(spark, root, "v7")
    names = spark.createDataFrame([("v1",), ("v10",), ("v9",), ("x",)], "name string")
    assert registry.latest_and_next(names).first().asDict() == {"latest": "v10", "next": "v11"}
    none = registry.latest_and_next(names.filter("name = 'x'")).first()
    assert (none.latest, none.next) == (None, "v1")


def test_claimed_versions(spark, tmp_path):
    """Runs at one time get versions of their own, and what isn't complete is no version."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "claims")
    with ThreadPoolExecutor(4) as pool:
        names = list(pool.map(lambda _: registry.claim_version(spark, root), range(8)))
    assert sorted(names) == sorted(f"v{k}" for k in range(1, 9))
    with pytest.raises(FileNotFoundError):
        registry.version_path(spark, root)
    registry.complete_version(spark, root, "v3")
    assert registry.version_path(spark, root).endswith("/v3")
    with pytest.raises(FileNotFoundError, match="no model v5"):
        registry.version_path(spark, root, "v5")
    with pytest.raises(FileExistsError):
        registry.complete_version(spark, root, "v3")
    assert registry.claim_version(spark, root) == "v9"


def test_records(spark):
    path = shared_path(spark, "record")
    tables.write_record(spark, {"a": float("nan"), "b": [1.5, {"c": None}]}, path)
    assert tables.read_record(spark, path) == {"a": None, "b": [1.5, {"c": None}]}
    assert tables.read_record(spark, path + "-absent", optional=True) is None
    with pytest.raises(FileNotFoundError):
        tables.read_record(spark, path + "-absent")


EXPECTED = ["port", "rate"]


def test_upload_accepts_clean_rows(spark, tmp_path):
    up = uploads.scan_upload(spark, write(tmp_path, "a.csv", "rate,port\n1.5,443\n\n2e3,80\n"))
    rows = uploads.accepted_rows(up, EXPECTED).orderBy("row").collect()
    assert [tuple(r) for r in rows] == [(0, 443.0, 1.5), (1, 80.0, 2000.0)]


def test_upload_faults(spark, tmp_path):
    up = uploads.scan_upload(spark, write(tmp_path, "b.csv", "port,rate\n443,not-a-number\n80,Infinity\n0x1F, 7 \n,1\n9\n"))
    messages = [r.message for r in uploads.cell_errors(up, EXPECTED).orderBy("line").collect()]
    assert messages == [
        'Row 2: "rate" is not a valid number (not-a-number)',
        'Row 3: "rate" is not a valid number (Infinity)',
        'Row 6: "rate" is not a valid number (undefined)',
    ]
    short = [r.message for r in uploads.field_errors(up).collect()]
    assert short == ["Row 4: Too few fields: expected 2 fields but parsed 1"]
    rows = uploads.upload_rows(up, EXPECTED).orderBy("row").collect()
    assert [tuple(r)[1:] for r in rows] == [(443.0, 0.0), (80.0, 0.0), (31.0, 7.0), (0.0, 1.0), (9.0, 0.0)]
    with pytest.raises(ValueError, match="Row 2"):
        uploads.accepted_rows(up, EXPECTED)


def test_upload_headers(spark, tmp_path):
    up = uploads.scan_upload(spark, write(tmp_path, "c.csv", "rate,extra,more\n1,2,3\n"))
    assert uploads.header_errors(up.columns, ["port", "rate", "bytes"]) == [
        "Missing columns: port, bytes",
        "Unexpected columns: extra, more",
    ]
    assert uploads.upload_rows(up, EXPECTED).count() == 0
    assert uploads.cell_errors(up, EXPECTED).count() == 0
    empty = uploads.scan_upload(spark, write(tmp_path, "d.csv", "port,rate\n"))
    with pytest.raises(ValueError, match="no rows"):
        uploads.accepted_rows(empty, EXPECTED)


def test_upload_rows_are_numbered_across_files_and_blocks(spark):
    df = spark.range(5000).selectExpr("cast(id as string) port", "cast(id * 2 as string) rate")
    path = shared_path(spark, "upload")
    df.repartitionByRange(6, df["port"].cast("long")).sortWithinPartitions(
        df["port"].cast("long")
    ).write.csv(path, header=True)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = uploads.scan_upload(spark, path).rows
        assert rows.filter("`#row` != cast(port as long)").count() == 0
        assert rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_faults_behind_a_wrong_header(spark, tmp_path):
    """An unexpected column hides neither bad cells nor short rows; a missing one hides the cells only."""
    up = uploads.scan_upload(spark, write(tmp_path, "e.csv", "port,rate,extra\n1,x,2\n3,4\n5,6,7,8\n"))
    found = [(r.line, r.message) for r in uploads.upload_faults(up, EXPECTED).orderBy("line", "ord").collect()]
    assert found == [
        (1, "Unexpected columns: extra"),
        (2, 'Row 2: "rate" is not a valid number (x)'),
        (3, "Row 1: Too few fields: expected 3 fields but parsed 2"),
        (4, "Row 2: Too many fields: expected 3 fields but parsed 4"),
    ]
    missing = uploads.upload_faults(up, [*EXPECTED, "bytes"]).orderBy("line", "ord").collect()
    assert [r.line for r in missing] == [1, 1, 3, 4]


def test_open_quotes():
    for line, inside, want in [
        ("a,b", False, False), ("a,b", True, True), ('"a,b', False, True), ('a,"b', False, True), ('5" pipe,b', False, False),
        ('"a ""b"', False, False), ('"a ""', False, True), ('b""c', True, True), ('b",c', True, False), ('b","c', True, True),
        ('b"', True, False), ('"', False, True), ('"', True, False), ('""', False, False), ('""', True, True), ('a,"b",', False, False),
        ('x" y,"z', True, True), ("", True, True), ('"a"b,c"d', False, False),
    ]:
        assert records.leaves_open(line, inside) == want, (line, inside)


def broken_csv(n: int) -> tuple[str, list[list[str]]]:
    import csv
    import io
    import random

    r = random.Random(4)
    cell = lambda: "".join(r.choices(["a", "b", '"', ",", "\n", " ", "long text ", "7"], [6, 6, 1, 1, 1, 1, 2, 2], k=r.randint(1, 12)))
    rows = [[str(k), "x" + cell() + "x", "y" + cell() + "y"] for k in range(n)]
    rows[n // 2][1] = "x" + "many\nlines\n\n" * 200 + "x"
    text = io.StringIO()
    out = csv.writer(text, lineterminator="\n")
    out.writerow(["k", "first", "second"])
    out.writerows(rows)
    return text.getvalue(), rows


@pytest.mark.parametrize("block", ["300", "1000000"])
def test_line_breaks_inside_quotes(spark, tmp_path, block):
    """Records are whole wherever blocks are cut, also one that is longer than several blocks, and rows are numbered in order."""
    text, rows = broken_csv(300)
    path = write(tmp_path, "breaks.csv", text)
    assert records.has_breaks(spark, path)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, block)
    try:
        table = csv_tables.load_csv(spark, path)
        assert dict(table.dtypes) == {"k": "bigint", "first": "string", "second": "string"}
        assert [[str(r.k), r.first, r.second] for r in table.orderBy("k").collect()] == rows
        up = uploads.scan_upload(spark, path)
        assert [(r["#row"], r["#fields"], r.k) for r in up.rows.orderBy("#row").collect()] == [(i, 3, str(i)) for i in range(300)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_upload_faults_behind_line_breaks(spark, tmp_path):
    text = 'port,rate\n1,"2\n"\n"3\n4",5\n\n6\n7,8,9\nx,"1"\n'
    up = uploads.scan_upload(spark, write(tmp_path, "f.csv", text))
    found = [(r.line, r.message.split(": ", 1)[1]) for r in uploads.upload_faults(up, EXPECTED).orderBy("line", "ord").collect()]
    assert found == [
        (3, '"port" is not a valid number (3\n4)'),
        (4, "Too few fields: expected 2 fields but parsed 1"),
        (4, '"rate" is not a valid number (undefined)'),
        (5, "Too many fields: expected 2 fields but parsed 3"),
        (6, '"port" is not a valid number (x)'),
    ]


def test_tasks_take_several_small_blocks(spark, tmp_path):
    """Two hundred blocks are told apart as such, by four tasks a core at most, and the records are those of one block."""
    path = write(tmp_path, "blocks.csv", "a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(20_000)))
    want = sorted(r.value for r in records.read_records(spark, path).select("value").collect())
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "1k")
    try:
        lines = records.lines_of(spark, path)
        assert lines.select("#block").distinct().count() > 200
        assert lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(r.value for r in records.read_records(spark, path).select("value").collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("text, size", [("20000", 20_000), ("134217728b", 1 << 27), ("128MB", 1 << 27), ("16m", 1 << 24), ("3kb", 3072)])
def test_block_bytes(spark, text, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", text)
    try:
        assert records.block_bytes(spark) == size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_upload_is_sorted_before_one_task_writes_it(spark, monkeypatch, capsys):
    """The task that writes the one file holds no rows, and they still come in order."""
    written, plain = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path, *more: written.append((self._df, path)) or plain(self, path, *more))
    QUERIES["upload_faults_wrong_header"](spark, "/root/testdata/sf0.001")
    [(df, path)] = written
    df.explain()
    assert df.rdd.getNumPartitions() == 1 and "Sort" not in capsys.readouterr().out
    names = [f for f in spark.read.text(path).inputFiles() if "part-" in f]
    rows = [r.value for r in spark.read.text(path).coalesce(1).collect()]
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    third = [int(r.split(",")[2]) for r in rows[1:] if r.count(",") == 2]
    assert len(names) == 1 and rows[0] == "value,user_id,session" and len(rows) == n + 1 and third == sorted(third)
