"""Parsing, cleaning and series on small hand-made inputs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trafficlens.functions import logfields as lf
from trafficlens.operators import clean as cl
from trafficlens.operators import series as se
from trafficlens.operators.parse import parse_lines, rejected_lines
from trafficlens.sources import loads as ld
from trafficlens.sources import logs as lg
from trafficlens.sources import tables as tb
from trafficlens.streaming import live

GOOD = '199.72.81.55 - - [01/Jul/1995:00:00:01 -0400] "GET /history/apollo/ HTTP/1.0" 200 6245'
LINES = [
    GOOD,
    'unicomp6.unicomp.net - - [01/Jul/1995:00:00:06 -0400] "GET /shuttle/countdown/ HTTP/1.0" 304 0',
    'host - - [01/Jul/1995:00:00:09 -0400] "POST /cgi-bin/x HTTP/1.0" 404 -',
    "  " + GOOD + "  ",
    "not a log line",
    "",
    "   ",
    'host - - [31/Feb/1995:00:00:09 -0400] "GET / HTTP/1.0" 200 1',
    'host - - [01/Jul/1995:00:00:09 -0400] "GET / HTTP/1.0" 200 12.5',
    'host - - [01/Jul/1995:00:00:09 -0400] "GET /a x"y HTTP/1.0" 200 1',
    'host - - [01/Jul/1995:00:00:09 -0400] "GET /" 200 1',
    'host - - [01/Jul/1995:00:00:09] "GET / HTTP/1.0" 200 1',
]


def lines(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "line_no bigint, value string")


def test_parse_and_reject(spark):
    df = lines(spark, LINES)
    rows = {r.line_no: r for r in parse_lines(df).collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    first = rows[0]
    assert (first.host, first.method, first.url, first.protocol, first.status, first.bytes) == (
        "199.72.81.55", "GET", "/history/apollo/", "HTTP/1.0", 200, 6245,
    )
    assert first.timestamp == datetime(1995, 7, 1, 0, 0, 1) and first.utc_offset == "-0400"
    assert rows[2].bytes == 0 and rows[2].method == "POST" and rows[1].status == 304
    assert sorted(r.line_no for r in rejected_lines(df).collect()) == [4, 7, 8, 9, 10, 11]


def test_parse_meets_the_regex_once(spark):
    plan = parse_lines(lines(spark, LINES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(btrim") + plan.count("regexp_replace(trim") == 1


def test_latin1_file(spark, tmp_path):
    text = GOOD.replace("199.72.81.55", "höst") + "\n\n" + GOOD + "\n"
    (tmp_path / "a.log").write_bytes(text.encode("latin-1"))
    rows = lg.read_log(spark, str(tmp_path)).collect()
    assert sorted(r.host for r in rows) == ["199.72.81.55", "höst"]


@pytest.mark.parametrize(
    "url, extension, category",
    [
        ("/images/a.GIF", "gif", "images"), ("/shuttle/x.html?y=1.5", "html", "shuttle"), ("/ksc.html", "html", "homepage"), ("/", "none", "homepage"),
        ("/facilities/lc39a.html", "html", "facilities"), ("/software/a", "none", "software"), ("/elsewhere", "none", "other"), ("/cgi-bin/imagemap/x?1,2", "none", "cgi"),
    ],
)
def test_url_rules(spark, url, extension, category):
    row = spark.range(1).select(lf.url_extension(F.lit(url)).alias("e"), lf.url_category(F.lit(url)).alias("c")).first()
    assert row.c == category
    assert row.e == extension


START = datetime(1995, 7, 1)
SCHEMA = "line_no bigint, host string, timestamp timestamp_ntz, method string, url string, status int, bytes bigint"


def parsed(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def sample(spark):
    return parsed(
        spark,
        [
            ("a", START, "GET", "/x", 200, 10), ("a", START, "GET", "/x", 404, 99), ("b", START + timedelta(minutes=1), "GET", "/y", 302, -5),
            ("c", START + timedelta(minutes=2), "GET", "/z", 404, 30), ("d", START + timedelta(hours=3), "HEAD", "/", 999, 40),
        ],
    )


def test_first_duplicate_wins_before_the_shuffle(spark):
    kept = cl.drop_duplicates(sample(spark))
    assert sorted(r.line_no for r in kept.collect()) == [0, 2, 3, 4]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_clean_flags(spark):
    rows = {r.line_no: r for r in cl.clean(sample(spark)).collect()}
    assert rows[2].bytes == 0 and rows[0].is_success and rows[3].is_error and not rows[2].is_success
    assert not rows[4].status_valid and rows[4].status_category is None and rows[3].status_category == "4xx"


def test_report(spark):
    report = cl.cleaning_report(sample(spark)).first().asDict()
    assert report == {
        "original_rows": 5, "final_rows": 4, "duplicates_removed": 1, "invalid_status": 1, "negative_bytes_fixed": 1, "missing_periods": 1, "outliers_detected": 0,
    }


def test_gap_over_three_hours(spark):
    gaps = cl.find_gaps(sample(spark)).collect()
    assert [(g.gap_start, g.gap_end) for g in gaps] == [(START + timedelta(minutes=2), START + timedelta(hours=3))]


def test_one_outlier(spark):
    rows = [("h", START + timedelta(seconds=i), "GET", "/", 200, 100) for i in range(99)] + [("h", START + timedelta(seconds=99), "GET", "/", 200, 1_000_000)]
    assert cl.flag_outliers(parsed(spark, rows)).where("bytes_outlier").count() == 1


def aggregation_input(spark):
    rows = [(f"h{i % 10}", START + timedelta(seconds=30 * i), "GET", "/", 500 if i >= 90 else 200, 100 + i) for i in range(100)]
    return cl.with_derived(parsed(spark, rows))


@pytest.mark.parametrize("step, n", [(60, 50), (300, 10), (900, 4)])
def test_windows(spark, step, n):
    out = se.traffic_series(aggregation_input(spark), se.SeriesSpec(step)).orderBy("timestamp").collect()
    assert len(out) == n and sum(r.request_count for r in out) == 100 and sum(r.error_count for r in out) == 10
    assert all((b.timestamp - a.timestamp).total_seconds() == step for a, b in zip(out, out[1:]))


@pytest.mark.parametrize("fill", ["zero", "ffill", "interpolate"])
def test_fills_leave_no_nulls(spark, fill):
    rows = aggregation_input(spark).where("minute(timestamp) < 10 or minute(timestamp) > 30")
    out = se.traffic_series(rows, se.SeriesSpec(300, fill)).orderBy("timestamp").collect()
    assert all(v is not None for r in out for v in r)
    hole = out[3]
    assert hole.request_count == 0 and hole.unique_hosts == 0 and hole.bytes_total == 0
    assert (hole.bytes_avg == 0) == (fill == "zero")


def test_measures_by_flag(spark):
    out = se.traffic_series(aggregation_input(spark), se.SeriesSpec(300, hosts=False, errors=False, sizes=False))
    assert out.columns == ["timestamp", "request_count"]
    with pytest.raises(ValueError):
        se.SeriesSpec(300, "mean")


def test_empty_input(spark):
    assert se.traffic_series(aggregation_input(spark).where("false"), se.SeriesSpec(300)).count() == 0


def test_csv_and_text_loads(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,load\n2024-01-01 00:00:00,5\n2024-01-01 00:05:00,-3\n2024-01-01 00:10:00,\n")
    rows = ld.read_csv_loads(spark, str(tmp_path / "a.csv")).orderBy("timestamp").collect()
    assert [r.load for r in rows] == [5.0, 0.0, 0.0]
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        ld.read_csv_loads(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.txt").write_text("# loads\n10\n\n20, 30\t40\nword\n")
    assert sorted(r.load for r in ld.read_text_loads(spark, str(tmp_path / "c.txt")).collect()) == [10.0, 20.0, 30.0, 40.0]


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        tb.save(spark.range(1), str(tmp_path / "x"), "xlsx")
    with pytest.raises(ValueError):
        tb.load(spark, str(tmp_path / "x.xlsx"))


def test_sample_loads_follow_the_wave(spark):
    rows = ld.sample_loads(ld.sample_grid(spark, 2880)).agg(F.min("load").alias("lo"), F.avg("load").alias("m"), F.count("*").alias("n")).first()
    assert rows.lo >= 10 and 40 < rows.m < 80 and rows.n == 2880


LINE = '{} - - [01/Jul/1995:00:00:{:02d} -0400] "GET {} HTTP/1.0" {} 10'


def test_files_of_unequal_size_keep_their_order(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.log").write_text(LINE.format("h", 1, "/x", 200) + "\n")
    (tmp_path / "log/b.log").write_text("\n".join([LINE.format("h", 1, "/x", 404), *[LINE.format("g", i % 60, f"/y{i}", 200) for i in range(50)]]))
    rows = cl.drop_duplicates(lg.read_log(spark, str(tmp_path / "log")))
    assert [r.status for r in rows.where("host = 'h'").collect()] == [200] and rows.count() == 51


def test_control_bytes_and_latin_letters_survive(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.log").write_bytes(LINE.format("h", 1, "/a\x01b/\xe9", 200).encode("latin-1") + b"\n")
    assert [r.url for r in lg.read_log(spark, str(tmp_path / "log")).collect()] == ["/a\x01b/\xe9"]
    stream = lg.stream_lines(spark, str(tmp_path / "log"))
    assert [r.value[-20:-18] for r in live.run_available(spark, stream, "lines").collect()] == [LINE.format("h", 1, "/a\x01b/\xe9", 200)[-20:-18]]


def test_csv_periods_are_dense_over_several_files(spark, tmp_path):
    (tmp_path / "loads").mkdir()
    for i in range(3):
        (tmp_path / f"loads/p{i}.csv").write_text("load\n" + "\n".join(str(100 * i + k) for k in range(5 - i)) + "\n")
    rows = ld.read_csv_loads(spark, str(tmp_path / "loads")).orderBy("period").collect()
    assert [r.period for r in rows] == list(range(12))
    assert [r.load for r in rows] == [100.0 * i + k for i in range(3) for k in range(5 - i)]
