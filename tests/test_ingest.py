import zipfile

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from eventide import schemas
from eventide.functions import parsing
from eventide.sources import archives, ingest, quality

ROW = "1704067200000,10,12,9,11,{volume},1704067259999,0,{trades},0,0,0"


def archive(folder, name, lines):
    with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as packed:
        packed.writestr(name.replace(".zip", ".csv"), "\n".join(lines) + "\n")


def test_archives(spark, tmp_path):
    good = ROW.format(volume="1.5", trades="7")
    archive(tmp_path, "abcusdt-1m-2024-01.zip", [
        "open_time,open,high,low,close,volume,close_time,q,trades,a,b,c", good, "",
        good.replace("1704067200000", "soon"), good.replace("1704067200000", "1704067260000.0"),
        ROW.format(volume="x", trades="7"), ROW.format(volume="1.5", trades="12.0"),
        ROW.format(volume="-1", trades="7"), ROW.format(volume="1.5", trades="-7"),
        ROW.format(volume=" 2 ", trades=" 8 "), ROW.format(volume="nan", trades="8"), "1,2"])
    archive(tmp_path, "XYZUSDT-1m-2024-01.zip", [" Open Time ,x", good, "open_time,again"])
    archive(tmp_path, "OTHERS-1m-2024-01.zip", [good])
    (tmp_path / "notes.txt").write_text("not an archive")
    flagged = ingest.load_klines(spark, str(tmp_path), ["ABCUSDT ", "xyzusdt"])
    assert rows(ingest.quality_counts(flagged, "symbol"), "symbol") == [("ABCUSDT", 4, 7), ("XYZUSDT", 1, 1)]
    kept = ingest.valid_rows(flagged).filter(F.col("symbol") == "ABCUSDT").orderBy("open_time", "volume").collect()
    assert [(r.open_time, r.volume, r.number_of_trades) for r in kept[:2]] == [
        (at("2024-01-01 00:00"), 1.5, 7), (at("2024-01-01 00:00"), 2.0, 8)]
    assert kept[-1].open_time == at("2024-01-01 00:01")
    assert (kept[0].open_price, kept[0].high_price, kept[0].low_price, kept[0].close_price) == (10, 12, 9, 11)
    named = [f.name for f in schemas.KLINES.fields]
    assert ingest.valid_rows(flagged).select(*named).dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.KLINES.fields]


def test_archive_longer_than_one_batch(spark, tmp_path, monkeypatch):
    archive(tmp_path, "ABCUSDT-1m.zip", [str(i) for i in range(50_001)])
    lines = ingest.read_archive_lines(spark, str(tmp_path), ["ABCUSDT"])
    assert rows(lines.agg(F.count("*"), F.countDistinct("line_no"), F.sum((F.col("line") == F.col("line_no").cast("string")).cast("int")))) == [
        (50_001, 50_001, 50_001)]


def _opened(df):
    """Archives that the scan makes partitions of."""
    return df.rdd.getNumPartitions()


def test_names_choose_the_archives_that_are_opened(spark, tmp_path):
    for symbol in ("AAAUSDT", "bbbusdt", "CCCUSDT"):
        for month in ("2023-12", "2024-01", "2024-02", "2024-02-03"):
            archive(tmp_path, f"{symbol}-1m-{month}.zip", [f"{symbol} {month}"])
    archive(tmp_path, "AAAUSDT-all.zip", ["no month"])
    (tmp_path / "AAAUSDT-1m-2024-03.zip").write_bytes(b"damaged, and never opened")
    every = archives.register(spark).read.format(archives.FORMAT).option("path", tmp_path.as_uri()).load()
    for test, lines in {
        "symbol = 'BBBUSDT' AND month = '2024-01'": {"bbbusdt 2024-01"},
        "symbol IN ('AAAUSDT', 'CCCUSDT') AND month < '2024-01'": {"AAAUSDT 2023-12", "CCCUSDT 2023-12"},
        "month BETWEEN '2024-02' AND '2024-02' AND symbol > 'B'": {f"{s} 2024-02{d}" for s in ("bbbusdt", "CCCUSDT") for d in ("", "-03")},
        "symbol = 'NONE'": set(),
        "symbol = 'AAAUSDT' AND month <= '2024-01' AND line LIKE '%12'": {"AAAUSDT 2023-12"},
    }.items():
        found = every.filter(test)
        assert {r.line for r in found.collect()} == lines, test
        assert _opened(found) == (2 if "LIKE" in test else max(1, len(lines))), test
    january = ingest.read_archive_lines(spark, tmp_path.as_uri(), ["aaausdt "], ("2024-01", "2024-02"))
    assert sorted(r.month for r in january.collect()) == ["2024-01", "2024-02", "2024-02"]


def test_archives_are_inflated_as_a_stream(spark, tmp_path, monkeypatch):
    """An archive larger than a cell of a file table may be."""
    lines = [f"{i},{hash(str(i))}" for i in range(30_000)]
    archive(tmp_path, "ABCUSDT-1m-2024-01.zip", lines)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10000")
    try:
        with pytest.raises(Exception, match="maxLength|exceeds"):
            spark.read.format("binaryFile").load(str(tmp_path)).select("content").collect()
        found = ingest.read_archive_lines(spark, str(tmp_path), ["ABCUSDT"])
        assert [r.line for r in found.orderBy("line_no").collect()] == lines
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    sizes = [b.num_rows for b in archives.ArchiveReader(str(tmp_path)).read(archives.ArchiveReader(str(tmp_path)).partitions()[0])]
    assert sizes == [20_000, 10_000]


def test_csv_tables(spark, tmp_path):
    path = tmp_path / "rates.csv"
    path.write_bytes(b"symbol,ts,rate\r\n btcusdt ,2024-01-01 08:00:00,-1.5e-05\r\n,2024-01-01 08:00:00,1\r\n"
                     b"ETHUSDT,yesterday,1\r\nETHUSDT,2024/01/02 16:00:00,x\r\nETHUSDT,01/03/2024 16:00:00,2\r\n"
                     b"ETHUSDT,2024-01-01T00:00:00Z,inf\r\n")
    flagged = ingest.load_funding(spark, str(path))
    assert rows(ingest.quality_counts(flagged)) == [(3, 3)]
    found = rows(ingest.valid_rows(flagged).drop("arrival"), "symbol", "ts")
    assert found == [("BTCUSDT", at("2024-01-01 08:00"), -1.5e-05), ("ETHUSDT", at("2024-01-01 00:00"), float("inf")),
                     ("ETHUSDT", at("2024-01-03 16:00"), 2.0)]


def test_csv_with_a_missing_column_is_all_bad(spark, tmp_path):
    (tmp_path / "oi.csv").write_text("symbol,ts\nA,2024-01-01 00:00:00\n")
    assert rows(ingest.quality_counts(ingest.load_open_interest(spark, str(tmp_path / "oi.csv")))) == [(0, 1)]


def test_rows_keep_the_order_of_their_file(spark, tmp_path):
    for part in "ab":
        lines = [f"{part.upper()},2024-01-01 00:00:00,{i}" for i in range(40_000)]
        (tmp_path / f"{part}.csv").write_text("symbol,ts,rate\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        read = ingest.load_funding(spark, str(tmp_path)).cache()
        assert read.rdd.getNumPartitions() > 8
        in_order = [r.rate for r in read.filter("symbol = 'B'").orderBy("arrival").collect()]
        assert in_order == [float(i) for i in range(40_000)]
        kept = ingest.insert_ignore(read, None, ["symbol", "ts"], [F.col("arrival").asc()])
        assert sorted((r.symbol, r.rate) for r in kept.collect()) == [("A", 0.0), ("B", 0.0)]
        read.unpersist()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_round_trip(spark, tmp_path):
    times = [at("2024-01-01 00:05:00"), at("2024-03-10 02:30:00.250000")]
    table = spark.createDataFrame([("A", t, 0.1, 0.2, -0.3, 1 / 3) for t in times], schemas.PREMIUM_INDEX)
    ingest.write_csv(table, str(tmp_path / "out"))
    back = ingest.load_premium_index(spark, str(tmp_path / "out"))
    assert rows(ingest.valid_rows(back).drop("arrival"), "ts") == rows(table, "ts")
    text = spark.read.text(str(tmp_path / "out")).collect()
    assert any(r.value.startswith("A,2024-01-01 00:05:00,0.1") for r in text)


@pytest.mark.parametrize("text,expected", [
    ("1", 1.0), (" -2.5 ", -2.5), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("1.0d", None), ("1f", None), ("", None), (None, None), ("0x10", None),
])
def test_to_double(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parsing.to_double(F.col("t"))).first()[0] == expected


def test_symbols(spark):
    names = spark.createDataFrame([(" btcusdt",), ("BTCUSDT",), ("",), (None,), ("USDT",), ("ab",)], "symbol string")
    found = rows(ingest.symbol_dimension(names), "symbol")
    assert found == [("AB", "", "AB"), ("BTCUSDT", "BTC", "USDT"), ("USDT", "", "USDT")]


def test_first_write_wins(spark):
    batch = spark.createDataFrame([("A", 1, 20, "late"), ("A", 1, 10, "early"), ("A", 2, 30, "taken"), ("B", 1, 40, "new")],
                                  "symbol string, k int, load int, note string")
    target = spark.createDataFrame([("A", 2, "old")], "symbol string, k int, note string")
    fresh = ingest.insert_ignore(batch, target, ["symbol", "k"], [F.col("load").asc()])
    assert rows(fresh.select("symbol", "k", "note"), "symbol") == [("A", 1, "early"), ("B", 1, "new")]
    assert ingest.insert_ignore(batch, None, ["symbol", "k"], [F.col("load").asc()]).count() == 3


def test_integrity_checks(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None), (3, None)], "k int, ref string")
    parent = spark.createDataFrame([("a",)], "name string")
    assert rows(quality.duplicate_keys(child, ["k"]), "k") == [(1, 2), (3, 2)]
    assert rows(quality.key_report({"child": (child, ["k"])})) == [("child", 2, 2)]
    assert rows(quality.orphans(child, "ref", parent, "name")) == [("b", 1)]
    assert rows(quality.reference_report({"x": (child, "ref", parent, "name")})) == [("x", 1, 1)]
    assert rows(quality.null_counts(child, ["k", "ref"]), "column_name") == [("k", 0), ("ref", 2)]
    assert quality.outside_domain(child, "ref", ["a"]).count() == 3


def test_grid_clamp_boost(spark):
    bounds = spark.createDataFrame([("A", at("2024-01-01"), at("2024-03-31 23:59:00"))], "symbol string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    grid = ingest.time_grid(bounds, "8 hours")
    assert grid.count() == 273
    series = spark.createDataFrame([("A", at("2024-01-01"), 100.0), ("A", at("2024-01-01 01:00"), 100.0)], "symbol string, ts timestamp_ntz, oi double")
    assert [r.oi for r in ingest.boost_at_events(series, grid, "oi", 1.1).orderBy("ts").collect()] == [pytest.approx(110.0), 100.0]
    clamped = series.select(parsing.clamp(F.col("oi"), 1.0, 50.0)).distinct()
    assert rows(clamped) == [(50.0,)]


def test_offsets_and_white_space(spark):
    cases = {
        "2024-01-01T00:00:00+05:30": at("2023-12-31 18:30"), "2024-01-01 12:00:00-0800": at("2024-01-01 20:00"),
        "2024-01-01T06:00:00.250Z": at("2024-01-01 06:00:00.250"), "\t2024-01-01 06:00:00\u00a0": at("2024-01-01 06:00"),
        "2024/01/02 03:04:05+01:00": at("2024-01-02 02:04:05"), "2024-01-01": at("2024-01-01"), "2024-01-01 06:00:00+99:00": None,
        "2024-10-27T02:30:00+02:00": at("2024-10-27 00:30"), "2024-10-27T02:30:00+01:00": at("2024-10-27 01:30"),
    }
    text = spark.createDataFrame([(t,) for t in cases], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Paris", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert dict(rows(text.select("t", parsing.to_timestamp(F.col("t"))))) == cases, name
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    odd = spark.createDataFrame([("\tabc\n", "\t1.5 ", "\u20037")], "s string, d string, i string")
    found = odd.select(parsing.clean_symbol("s"), parsing.to_double(F.col("d")), parsing.to_int(F.col("i")))
    assert rows(found) == [("ABC", 1.5, 7)]
