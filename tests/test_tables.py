"""The report source and tables with versions, on small hand-made inputs."""

import json
import threading
import tracemalloc

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatt.sources import days, feeds, report
from tidewatt.sources.versions import VersionedTable, latest_by, published

GOOD = '''C,SETP.WORLD,SCADA,PUBLIC,2026/08/06
I,DISPATCH,UNIT_SCADA,1,SETTLEMENTDATE,DUID,SCADAVALUE
D,DISPATCH,UNIT_SCADA,1,"2026/08/06 23:00:00",BAY1,383.5
D,DISPATCH,UNIT_SCADA,1,"2026/08/06 23:00:00",ER01,241.25
I,DISPATCH,CONSTRAINT,5,SETTLEMENTDATE,ID,DESCRIPTION
D,DISPATCH,CONSTRAINT,5,"2026/08/06 23:00:00",N_NIL,"Out = Nil, feedback, ""ratings"""
C,"END OF REPORT",7
'''


@pytest.mark.parametrize(
    "text, told",
    [
        (GOOD.replace('REPORT",7', 'REPORT",42'), "footer says 42"),
        (GOOD.rsplit("C,", 1)[0], "no footer"),
        ("C,x\nD,DISPATCH,UNIT_SCADA,1,a,b\n" + 'C,"END OF REPORT",3\n', "no heading"),
        (GOOD.replace("BAY1,383.5", "BAY1,383.5,EXTRA"), "4 values for 3"),
        (GOOD.replace("I,DISPATCH,CONSTRAINT,5", "I,DISPATCH,CONSTRAINT,4"), "no heading"),
        (GOOD.replace("C,SETP", "X,SETP"), "unknown kind 'X'"),
        ("", "no footer"),
    ],
)
def test_broken_reports_fail(spark, tmp_path, text, told):
    with pytest.raises(ValueError, match=told):
        list(report.parse(text))
    (tmp_path / "r.csv").write_text(text)
    with pytest.raises(Exception, match=told):
        report.read_reports(spark, str(tmp_path)).collect()


def test_good_reports_parse():
    rows = list(report.parse(GOOD.replace("\n", "\r\n") + "\r\n\r\n"))
    assert [(t, n) for t, n, _ in rows] == [("DISPATCH.UNIT_SCADA", 3), ("DISPATCH.UNIT_SCADA", 4), ("DISPATCH.CONSTRAINT", 6)]
    assert rows[2][2] == {"SETTLEMENTDATE": "2026/08/06 23:00:00", "ID": "N_NIL", "DESCRIPTION": 'Out = Nil, feedback, "ratings"'}
    assert report.fields('D,"a, b",c"d,') == ["D", "a, b", 'c"d', ""]
    short = GOOD.replace("ER01,241.25", "ER01") + "\n"
    assert list(report.parse(short))[1][2]["SCADAVALUE"] is None
    assert len(list(report.parse(GOOD.replace("BAY1,383.5", "BAY1,383.5,EXTRA"), frozenset(["DISPATCH.CONSTRAINT"])))) == 1  # not looked at
    assert len(list(report.parse(GOOD.replace('",7', '",8'), check=False))) == 3


def test_columns_and_tables_reach_the_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for k in range(3):
        (tmp_path / "a" / f"{k}.csv").write_text(GOOD)
    (tmp_path / "_hidden").write_text("no report")
    typed = report.read_reports(spark, f"file://{tmp_path}", ["DISPATCH.UNIT_SCADA"], schema="SCADAVALUE double, DUID string, MISSING int, line_no long")
    assert sorted(map(tuple, typed.collect())) == sorted([(383.5, "BAY1", None, 3), (241.25, "ER01", None, 4)] * 3)
    assert typed.rdd.getNumPartitions() == 3
    both = report.read_reports(spark, str(tmp_path), ["DISPATCH.UNIT_SCADA", "DISPATCH.CONSTRAINT"])
    assert both.count() == 9 and both.rdd.getNumPartitions() == 6  # a file and table each
    pushed = report.registered(spark).read.format("nested_report").load(str(tmp_path)).where("report = 'DISPATCH.CONSTRAINT'")
    assert pushed.count() == 3 and pushed.rdd.getNumPartitions() == 3
    reader = report.NestedReportReader(StructType.fromDDL(report.SCHEMA), {"path": str(tmp_path)})
    left = list(reader.pushFilters([report.EqualTo(("report",), "DISPATCH.CONSTRAINT"), report.EqualTo(("line_no",), 3)]))
    assert len(left) == 1 and reader.tables == {"DISPATCH.CONSTRAINT"}
    with pytest.raises(Exception, match="number|[Cc]ast|invalid|parse|convert"):
        report.read_reports(spark, str(tmp_path), ["DISPATCH.UNIT_SCADA"], schema="DUID double").collect()
    (tmp_path / "none").mkdir()
    assert report.read_reports(spark, str(tmp_path / "none")).count() == 0


def test_a_long_report_is_read_in_bounded_memory(tmp_path):
    n = 60_000
    with (tmp_path / "long.csv").open("w") as f:
        f.write("I,DISPATCH,UNIT,1,ID,MW\n" + "".join(f"D,DISPATCH,UNIT,1,U{i % 99},{i}.5\n" for i in range(n)) + f'C,"END OF REPORT",{n + 2}\n')
    reader = report.NestedReportReader(StructType.fromDDL("ID string, MW double"), {"path": str(tmp_path / "long.csv")})
    (part,) = reader.partitions()
    sizes, peaks = [], []
    tracemalloc.start()
    for batch in reader.read(part):
        sizes.append(batch.num_rows)
        peaks.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert sum(sizes) == n and max(sizes) == report.BATCH_ROWS and peaks[-1] < 1.5 * peaks[0]


def test_a_stream_of_reports_reads_each_file_once(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        rows = report.read_reports(spark, str(tmp_path / "in"), ["DISPATCH.UNIT_SCADA"], stream=True)
        rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.file.rsplit("/", 1)[1] for r in spark.read.parquet(out).collect())

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.csv").write_text(GOOD)
    assert run() == ["b.csv"] * 2
    (tmp_path / "in" / "a.csv").write_text(GOOD)  # later in time, earlier by name
    assert run() == ["a.csv"] * 2 + ["b.csv"] * 2 and run() == ["a.csv"] * 2 + ["b.csv"] * 2


def test_a_name_is_given_once(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(published(spark, f"file://{tmp_path}/x.json", f"{k}"))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True]
    assert [f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")] == ["x.json"]


SCHEMA = "day string, k int, at int, v double"


def held(table):
    return sorted(map(tuple, table.read().collect()))


def test_merges_keep_rows_and_snapshots(spark, tmp_path):
    def table():
        return VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, "day", latest_by(["day", "k"], "at"))

    def rows(*r):
        return spark.createDataFrame(list(r), SCHEMA)

    t = table()
    assert held(t) == [] and t.parts() == [] and t.versions() == []
    assert t.merge(rows(("d1", 1, 1, 1.0), ("d/2", 1, 1, 2.0), (None, 1, 1, 3.0)), "w", 0)
    first = t.read()
    assert t.merge(rows(("d1", 2, 1, 4.0), ("d1", 1, 0, 9.0)), "w", 1)
    assert not t.merge(rows(("d1", 7, 7, 7.0)), "w", 1) and not t.merge(rows(("d1", 7, 7, 7.0)), "w", 0)  # committed before
    want = [("d/2", 1, 1, 2.0), ("d1", 1, 1, 1.0), ("d1", 2, 1, 4.0)]
    assert [r for r in t.read().orderBy("day", "k").collect() if r.day] == want and t.read().count() == 4
    assert first.count() == 3 and t.read(1).count() == 3  # a snapshot doesn't move
    t.merge(rows(), "w", 2)
    t.replace(rows(("d1", 5, 5, 5.0)))
    assert t.drop(lambda p: p == "d/2") == 1 and t.drop(lambda p: p == "d/2") == 0
    assert t.read().where("day is not null").collect() == [("d1", 5, 5, 5.0)]
    before = t.read().count()
    assert t.vacuum(keep=1, older_than_s=0) > 0 and len(t.versions()) == 1 and t.read().count() == before


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both have read the same version: one commits, the other merges anew; of two of one batch one counts."""
    path, gate = f"file://{tmp_path}/t", threading.Barrier(2)

    class Slow(VersionedTable):
        waited = False

        def _commit(self, *a):
            if not self.waited:
                self.waited = True
                gate.wait(60)
            return super()._commit(*a)

    def write(writer, batch, k, out):
        out.append(Slow(spark, path, SCHEMA, "day", latest_by(["day", "k"], "at")).merge(spark.createDataFrame([("d", k, 1, float(k))], SCHEMA), writer, batch))

    for jobs, want in (([("a", 0, 1), ("b", 0, 2)], [True, True]), ([("c", 0, 3), ("c", 0, 3)], [False, True])):
        out: list[bool] = []
        threads = [threading.Thread(target=write, args=(*j, out)) for j in jobs]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert sorted(out) == want
    t = VersionedTable(spark, path, SCHEMA, "day")
    assert [r[1] for r in held(t)] == [1, 2, 3] and len(t.versions()) == 3


def test_a_writer_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    t = VersionedTable(spark, path, SCHEMA, "day", latest_by(["day", "k"], "at"))
    t.merge(spark.createDataFrame([("d", 1, 1, 1.0)], SCHEMA), "w", 0)
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.merge(spark.createDataFrame([("d", 2, 1, 2.0)], SCHEMA), "w", 1)
    assert held(t) == [("d", 1, 1, 1.0)] and t.merge(spark.createDataFrame([("d", 2, 1, 2.0)], SCHEMA), "w", 1)
    assert [r[1] for r in held(t)] == [1, 2] and json.loads((tmp_path / "t/_log/000000000002.json").read_text())["done"] == {"w": 1}


def test_intervals_and_settled_days_split_over_batches(spark, tmp_path):
    def stream(rows, schema, name):
        for n, r in enumerate(rows):
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    path = f"file://{tmp_path}/feed"
    rows = stream([(300, "a", 1.0), (300, "b", 2.0), (600, "a", 3.0)], "at long, station string, mw double", "in")
    feeds.write_intervals(rows, path, f"{path}-state", ["station"]).awaitTermination()
    assert held(feeds.interval_table(spark, path, rows.schema, ["station"])) == [(300, "a", 1.0), (300, "b", 2.0), (600, "a", 3.0)]
    schema, path = "day string, k int, at int, v double, settled boolean", f"file://{tmp_path}/days"
    rows = stream([("d", 1, 1, 1.0, True), ("d", 2, 9, 7.0, False), ("d", 2, 1, 2.0, True), ("e", 1, 1, 3.0, False), ("e", 1, 2, 4.0, False)], schema, "settled")
    days.settle(rows, path, f"{path}-state", ["k"]).awaitTermination()
    assert held(days.settled_table(spark, path, schema, ["k"])) == [("d", 1, 1, 1.0, True), ("d", 2, 1, 2.0, True), ("e", 1, 2, 4.0, False)]
    assert spark.read.schema(schema).parquet(f"{tmp_path}/settled").where(F.col("settled")).count() == 2
