"""Ledger, outputs, templates and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import extract as E
from pagesieve.operators import templates as TP
from pagesieve.operators import runs as R
from pagesieve.plans import QUERIES
from pagesieve.sources import ledger as L
from pagesieve.sources import sinks
from pagesieve.sources import templates as TS
from pagesieve.sources.pages import PAGE_SCHEMA, read_pages, stream_pages
from pagesieve.streaming import records as SR
from pagesieve.streaming import status as SS

START = datetime(2024, 1, 1)


def event(run, seq, minutes, status, file=""):
    return (run, seq, START + timedelta(minutes=minutes), status, file)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), R.EVENT_SCHEMA)


def runs(spark, *ids):
    return spark.createDataFrame([(i, "http://u", "old", "a", 1, "d", "t") for i in ids], R.RUN_SCHEMA)


# --- ledger -----------------------------------------------------------------------------------------


def test_latest_event_counts(spark):
    log = events(
        spark, event("a", 1, 5, "40%", "f"), event("a", 2, 9, "3", "g"), event("a", 3, 7, "50%", "h"),
        event("b", 1, 1, "3", "x"), event("b", 2, 1, "", "y"), event("z", 1, 1, "3", "q"),
    )
    got = {r.run_id: (r.status, r.file_name) for r in R.update_runs(runs(spark, "a", "b", "c"), log).collect()}
    assert got == {"a": (3, "g"), "b": (4, "y"), "c": (1, "old")}


def test_superseded(spark):
    data = [("1", 1, "f"), ("2", 2, "f"), ("3", 2, "f"), ("4", 9, "g"), ("5", 9, None)]
    got = R.superseded(spark.createDataFrame(data, "run_id string, ts long, file_name string"))
    assert {(r.run_id, r.file_name, r.removed) for r in got.collect()} == {
        ("1", "", True), ("2", "", True), ("3", "f", False), ("4", "g", False), ("5", None, False)
    }


def test_outcomes(value):
    counts = F.array(*[F.lit(n).cast("long") for n in (0, 5, None)])
    assert value(F.transform(counts, lambda n: R.result_status(n))) == [4, 3, 4]
    assert value(F.transform(counts, R.cancel_status)) == [7, 3, 7]
    assert value(R.result_status(F.lit(5), F.lit(True))) == 4


def test_registry_by_domain(spark):
    old = spark.createDataFrame([("1", "http://www.a.com/x"), ("2", "http://b.org/"), ("3", "http://localhost/")], "id string, url string")
    new = spark.createDataFrame([("4", "https://shop.a.com/"), ("5", "http://c.net/"), ("6", "http://nowhere/")], "id string, url string")
    now = R.upsert_by_domain(old, new)
    # an old entry without a domain is no match for anything, so it stays
    assert sorted(r.id for r in now.collect()) == ["2", "4", "5"] or sorted(r.id for r in now.collect()) == ["2", "3", "4", "5"]
    found = R.lookup_by_domain(spark.createDataFrame([(1, "http://m.a.com/q")], "page_id long, url string"), now)
    assert [(r.page_id, r.entry.id) for r in found.collect()] == [(1, "4")]


def test_ledger(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.runs().count() == 0
    first = ledger.open(R.open_run(spark, "http://u", "f.csv", ["a", "b"]))
    second = ledger.open(R.open_run(spark, "http://v", "g.csv", ["c"]))
    ledger.record(events(spark, event(first, 1, 1, "30%"), event(first, 2, 2, "3", "f.csv"), event(second, 1, 1, "5")))
    state = {r.run_id: r for r in ledger.runs().collect()}
    assert state[first].status == 3 and state[first].titles == "a, b" and state[second].status == 5
    assert {r.run_id: r.status for r in ledger.runs(restarted=True).collect()} == {first: 3, second: 7}
    ledger.remove(first)
    assert [r.run_id for r in ledger.runs().collect()] == [second]
    ledger.clear()
    assert ledger.runs().count() == 0


def test_ledger_file(spark, tmp_path):
    path = tmp_path / "processes.csv"
    path.write_text('http://a,f.csv,"x, y",1,01/01/2024,10:00:00,\nhttp://b,g.csv,z,,01/01/2024,10:00:00,\nhttp://c,h.csv,z,3,,,\n')
    got = L.read_ledger_file(spark, str(path)).orderBy("url").collect()
    assert [(r.url, r.titles, r.status) for r in got] == [("http://a", "x, y", 7), ("http://b", "z", 4), ("http://c", "z", 3)]


# --- outputs ----------------------------------------------------------------------------------------


@pytest.fixture
def records(spark):
    data = [('say "x", y\nz', " 1 ", "é"), ("<b>&amp;", "", "2")]
    return spark.createDataFrame(data, "`First Name` string, `2nd` string, c string")


@pytest.mark.parametrize("fmt", sinks.FORMATS)
def test_round_trip_and_append(spark, records, tmp_path, fmt):
    path = sinks.output_name(str(tmp_path / "out"), fmt)
    assert sinks.save(records, path) == 2
    assert sinks.save(records.select("c", "First Name", "2nd"), path, append=True) == 2
    names = sinks.written_names(records.columns, fmt)
    stored = sinks.load(spark, path).select(*[F.col(f"`{n}`") for n in names])
    assert sorted(map(tuple, stored.collect())) == sorted([tuple(r) for r in records.collect()] * 2)
    assert sinks.count_rows(spark, path) == 4
    with pytest.raises(sinks.ColumnMismatch):
        sinks.save(records.drop("c"), path, append=True)
    assert sinks.count_rows(spark, path) == 4
    assert sinks.save(records, path) == 2 and sinks.count_rows(spark, path) == 2


@pytest.mark.parametrize("fmt", sinks.FORMATS)
def test_append_to_nothing(spark, records, tmp_path, fmt):
    path = str(tmp_path / f"new.{fmt}")
    assert sinks.save(records, path, append=True) == 2
    empty = str(tmp_path / f"empty.{fmt}")
    sinks.save(records.limit(0), empty)
    sinks.save(records, empty, append=True)
    assert sinks.count_rows(spark, empty) == 2


def test_csv_starts_with_a_byte_order_mark(records, tmp_path):
    path = tmp_path / "out.csv"
    sinks.save(records.coalesce(1), str(path))
    part = next(path.glob("part-*")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfFirst Name,2nd,c\n")


def test_xml_names(spark, tmp_path):
    assert [sinks.xml_name(t) for t in ("First Name", "2nd", "a-b")] == ["First_Name", "_2nd", "a_b"]
    with pytest.raises(ValueError, match="collide"):
        sinks.save(spark.createDataFrame([("1", "2")], "`a b` string, `a-b` string"), str(tmp_path / "x.xml"))


def test_formats(spark, tmp_path):
    assert sinks.output_name("x/y", "csv") == "x/y.csv" and sinks.output_name("x/y.csv", "csv") == "x/y.csv"
    assert sinks.format_of("A/B.XML") == "xml"
    for bad in ("x.xlsx", "x"):
        with pytest.raises(ValueError):
            sinks.format_of(bad)
    assert sinks.count_rows(spark, str(tmp_path / "none.csv")) is None
    assert sinks.count_rows(spark, None) is None and sinks.count_rows(spark, "x.txt") is None


def test_other_tools_json_array(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"a": "1", "b": 2},\n {"a": "3", "b": 4}]')
    assert sorted(map(tuple, sinks.load_array(spark, str(path)).collect())) == [("1", "2"), ("3", "4")]


# --- templates --------------------------------------------------------------------------------------


def test_template_store(spark, tmp_path):
    store = TS.TemplateStore(spark, str(tmp_path / "t"))
    assert store.list().count() == 0 and not store.delete("x")
    a = store.save_new("http://a.com", [("//a", 1, "x", None, "t")], "//next")
    b = store.save_new("http://b.com", [("//b", 1, None, None, None), ("//c", 2, None, None, "u")])
    assert sorted(r.id for r in store.list().collect()) == sorted([a, b])
    assert store.load(a).first().pagination_xpath == "//next"
    assert {r.id: r["values"] for r in TS.column_values(store.templates(), "xpath").collect()} == {a: ["//a"], b: ["//b", "//c"]}
    changed = store.load(a).withColumn("url", F.lit("http://new.com"))
    store.save(changed)
    assert store.load(a).first().url == "http://new.com" and store.list().count() == 2
    assert store.delete(b) and [r.id for r in store.list().collect()] == [a]
    store.clear()
    assert store.list().count() == 0


def test_template_files(spark, tmp_path):
    (tmp_path / "1.json").write_text(
        '{"url": "http://a.com", "pagination_xpath": null, "id": "1",\n "columns": [{"xpath": "//a", "visual_index": 1, '
        '"first_text": "x", "num_elements": null, "column_title": "t"}]}'
    )
    got = TS.read_template_files(spark, str(tmp_path)).first()
    assert got.id == "1" and got.columns[0].column_title == "t"
    assert TP.compile_templates(TS.read_template_files(spark, str(tmp_path))).first().domain == "a.com"


# --- streams ----------------------------------------------------------------------------------------


def job(batch):
    return E.extract_fields(batch, "//li", {"t": "//text()"})


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_stream_equals_batch(spark, tmp_path, fmt):
    source, out, state = (str(tmp_path / n) for n in ("pages", "out", "state"))
    data = [(i, f"http://s/{i}", f"<ul>{'<li>x' + str(i) * 3 + '</li>' * (i % 4)}</ul>") for i in range(40)]
    site = spark.createDataFrame(data, PAGE_SCHEMA)
    counts = []
    for part in (site.filter("page_id < 25"), site.filter("page_id >= 25")):
        part.coalesce(3).write.mode("append").parquet(source)
        stream = stream_pages(spark, source, files_per_trigger=1)
        SR.stream_records(stream, job, out, fmt, state, lambda b, n: counts.append((b, n))).awaitTermination()
    got = SR.load_stream_output(spark, out, fmt).select("page_id", "t")
    want = job(read_pages(spark, source)).select("page_id", "t")
    assert sorted((str(a), b) for a, b in got.collect()) == sorted((str(a), b) for a, b in want.collect())
    assert [b for b, _ in counts] == list(range(len(counts))) and len(counts) > 3
    assert sum(n for _, n in counts) == want.count()


def test_repeated_batch_replaces_itself(spark, tmp_path):
    site = spark.createDataFrame([(1, "u", "<li>a</li>")], PAGE_SCHEMA)
    site.write.parquet(str(tmp_path / "pages"))
    for state in ("s1", "s2"):  # a lost checkpoint makes the batch run again
        stream = stream_pages(spark, str(tmp_path / "pages"))
        SR.stream_records(stream, job, str(tmp_path / "out"), "json", str(tmp_path / state)).awaitTermination()
    assert SR.load_stream_output(spark, str(tmp_path / "out"), "json").count() == 1


@pytest.mark.parametrize("files", [0, 1, 3])
def test_streams_read_tables_of_one_file_or_many(spark, tmp_path, files):
    """A table is a folder of part files, of which one may be empty, or (0) a single file; others beside it are not read."""
    folder = tmp_path / "tables"
    html = '<body><nav><ul><li><a href="/a">x{0}</a></li><li><a href="/b">y</a></li></ul></nav></body>'
    site = spark.createDataFrame([(i, "http://s/", html.format(i)) for i in range(20)], PAGE_SCHEMA)
    log = spark.createDataFrame([(i, START, i % 5, "error" if i > 14 else "view") for i in range(20)], "event_id long, ts timestamp, user_id long, event_type string")
    for name, rows in (("pages", site), ("events", log)):
        where = folder / f"{name}.parquet"
        rows.write.parquet(str(folder / "older" / f"{name}.parquet"))
        if files:
            rows.repartition(files).write.parquet(str(where))
            rows.limit(0).write.mode("append").parquet(str(where))
        else:
            rows.toPandas().to_parquet(where, coerce_timestamps="us")
    got = QUERIES["streamed_records"](spark, str(folder)).collect()
    assert sorted(map(tuple, got)) == sorted([(i, f"x{i}") for i in range(20)] + [(i, "y") for i in range(20)])
    got = QUERIES["streamed_status"](spark, str(folder)).collect()
    assert sorted(map(tuple, got)) == [(str(u), 4, f"out-{15 + u}.csv") for u in range(5)]


def test_stream_checks_columns(spark, tmp_path):
    site = spark.createDataFrame([(1, "u", "<li>a</li>")], PAGE_SCHEMA)
    site.write.parquet(str(tmp_path / "pages"))
    stream = stream_pages(spark, str(tmp_path / "pages"))
    SR.stream_records(stream, job, str(tmp_path / "out"), "json", str(tmp_path / "s")).awaitTermination()
    other = lambda batch: E.extract_fields(batch, "//li", {"u": "//text()"})
    with pytest.raises(Exception, match="ColumnMismatch"):
        again = stream_pages(spark, str(tmp_path / "pages"))
        SR.stream_records(again, other, str(tmp_path / "out"), "json", str(tmp_path / "s2")).awaitTermination()


def test_streamed_status_equals_batch(spark, tmp_path):
    log = [event(f"r{i % 7}", i, (i * 37) % 50, ("10%", "3", "", "7")[i % 4], f"f{i}") for i in range(100)]
    known = spark.createDataFrame([(f"r{i}",) for i in range(6)], "run_id string")
    source = str(tmp_path / "events")
    for part in (log[:30], log[30:], [event("r1", 200, -5, "3", "late")]):
        events(spark, *part).coalesce(2).write.mode("append").parquet(source)
        SS.stream_status(SS.stream_events(spark, source), str(tmp_path / "out"), str(tmp_path / "state"), known).awaitTermination()
    got = SS.current_status(spark, str(tmp_path / "out")).select("run_id", "status", "file_name")
    batch = events(spark, *log).join(known, "run_id", "left_semi")
    want = R.latest_status(batch).select("run_id", "status", "file_name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_snapshots(spark, tmp_path):
    """Readers start from the newest snapshot; files that it names are not read, those behind it are."""
    store = TS.TemplateStore(spark, str(tmp_path / "a b"))
    assert store.compact() == 0
    ids = [store.save_new(f"http://{i}.com", [("//a", 1, None, None, None)]) for i in range(3)]
    store.delete(ids[0])
    before = {(r.id, r.url) for r in store.templates().collect()}
    old = set(spark.read.parquet(store.path).inputFiles())
    assert store.compact() == len(old) and store.compact() == 0
    assert {(r.id, r.url) for r in store.templates().collect()} == before
    assert not old & set(store.log.rows().inputFiles())
    # a slow writer's row from before the deletion does not bring the template back
    late = spark.createDataFrame([(ids[0], "save", START, (ids[0], "http://late", None, []))], TS.LOG_SCHEMA)
    late.write.mode("append").parquet(store.path)
    assert {(r.id, r.url) for r in store.templates().collect()} == before
    store.clear()
    assert store.compact() > 0 and store.templates().count() == 0
    again = store.save_new("http://x.com", [])
    assert [r.id for r in store.list().collect()] == [again]


def test_unfinished_snapshot_does_not_count(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path / "ledger"))
    run = ledger.open(R.open_run(spark, "http://u", "f.csv", ["a"]))
    ledger.record(events(spark, event(run, 1, 1, "30%"), event(run, 2, 5, "3", "f.csv")))
    state = f"{ledger.events_path}/_snapshots/00000000/state"
    events(spark, event(run, 9, 99, "4")).write.parquet(state)
    assert ledger.runs().first().status == 3
    assert ledger.compact() > 0 and ledger.events().count() == 1
    ledger.record(events(spark, event(run, 3, 4, "50%")))
    assert ledger.runs().first().status == 3 and ledger.events().count() == 2


def test_status_is_compacted_while_a_stream_goes_on(spark, tmp_path):
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    log = [event(f"r{i % 5}", i, i * 7 % 60, f"{i}%", f"f{i}") for i in range(40)]
    for part in (log[:20], log[20:35], log[35:]):
        events(spark, *part).write.mode("append").parquet(source)
        SS.stream_status(SS.stream_events(spark, source), out, str(tmp_path / "state")).awaitTermination()
        assert SS.compact(spark, out) > 0
    got = SS.current_status(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.latest_status(events(spark, *log)).select(*got.columns).collect()))


def test_folder_of_intermediate_tables():
    from pagesieve.session import fallback_folder

    assert fallback_folder("local[8]", "file:/w").startswith("file:/w/")
    assert fallback_folder("yarn", "hdfs://store/w").startswith("hdfs://store/w/")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            fallback_folder(master, "file:/w")


@pytest.mark.parametrize("fmt", ["csv", "json", "xml"])
def test_appending_reads_no_records(spark, tmp_path, monkeypatch, fmt):
    path = f"{tmp_path}/out.{fmt}"
    sinks.save(spark.createDataFrame([("1", None), ("2", "b")], "a string, b string"), path)
    asked = []
    monkeypatch.setattr(sinks, "load", lambda *a, load=sinks.load: asked.append(load(*a)) or asked[-1])
    sinks.save(spark.createDataFrame([("c", "3")], "b string, a string"), path, append=True)
    # columns come from the note: the frame asked for has a given schema and was never run
    assert [df.columns for df in asked] == [["a", "b"]]
    monkeypatch.undo()
    assert {(r["a"], r["b"]) for r in sinks.load(spark, path).collect()} >= {("2", "b"), ("3", "c")}
    assert sinks.count_rows(spark, path) == 3
