"""Topics, envelopes, the raw table, settings, and the commands from files to answers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickforge import cli
from tickforge.operators import contract, medallion
from tickforge.operators.tables import VersionedTable
from tickforge.streaming import ingest

BAR = "ticker STRING, trade_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT"


def bars(spark, n=20, tickers=("AA", "BB", "CC")):
    return spark.createDataFrame([(t, dt.date(2022, 3, 1) + dt.timedelta(days=i), 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 100 + i) for t in tickers for i in range(n)], BAR)


def test_messages_are_keyed_tagged_and_told_apart(spark, tmp_path):
    root = f"file://{tmp_path}"
    faulty = contract.payloads(contract.draw_faults(bars(spark), 0.4)).withColumn("raw_payload", F.when((F.col("ticker") == "AA") & (F.dayofmonth("trade_date") == 1), "  ").otherwise(F.col("raw_payload")))
    ingest.produce(faulty, f"{root}/topic", tags={"fault": F.col("fault")})
    topic = spark.read.parquet(f"{root}/topic")
    assert topic.groupBy("key").agg(F.countDistinct("partition").alias("n")).where("n > 1").count() == 0
    ingest.run_ingest(spark, f"{root}/topic", f"{root}/out", 1)
    bad = ingest.read_quarantine(spark, f"{root}/out").collect()
    assert len(bad) + ingest.read_landing(spark, f"{root}/out").count() == 60
    assert all(r["audit"].get("fault") is None or contract.FAULTS[r["audit"]["fault"]] == r["reason"] or not r["raw_payload"].strip() for r in bad)
    assert all(r["details"][0]["reason"] == r["reason"] and r["details"][0]["message"] and r["kafka"]["topic"] == "quotes" and r["rejected_at"] for r in bad)
    assert [r["reason"] for r in bad if not r["raw_payload"].strip()] == ["MALFORMED_JSON"]
    letters = spark.read.parquet(f"{root}/out/dead_letter/*")
    assert letters.count() == len(bad) and json.loads(letters.first()["value"])["reason"]
    ingest.run_ingest(spark, f"{root}/topic", f"{root}/out", 1, reset_landing=False)  # nothing new
    assert ingest.read_quarantine(spark, f"{root}/out").count() == len(bad)


def test_headers_decode(spark):
    df = spark.createDataFrame([([("a", b"1"), ("b", b"\xff\xfe"), ("a", b"2")],), (None,), ([],)], "h ARRAY<STRUCT<key: STRING, value: BINARY>>")
    assert [r[0] for r in df.select(ingest.decoded(F.col("h"))).collect()] == [{"a": "2", "b": "�"}, {}, {}]


def test_a_batch_is_loaded_once(spark, tmp_path):
    path = f"file://{tmp_path}/bronze"
    lines = lambda n: contract.payloads(bars(spark, n)).select(F.col("raw_payload").alias("value"), F.lit("f").alias("source_file"))
    assert medallion.load_bronze(spark, lines(2), path, "one") == {"batch_id": "one", "rows": 6, "files": 1, "replaced": False}
    assert medallion.load_bronze(spark, lines(3), path, "two")["rows"] == 9
    assert medallion.load_bronze(spark, lines(2), path, "one")["replaced"]
    assert VersionedTable(spark, path).read().count() == 15
    with pytest.raises(ValueError):
        medallion.load_bronze(spark, lines(1).where("false"), path, "none")


def test_merge_leaves_other_partitions_alone(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t").create(bars(spark).schema, partition_by="ticker")
    table.append(bars(spark))
    before = table.manifest()["parts"]
    assert table.merge(bars(spark, 2, ("BB",)).withColumn("volume", F.lit(1).cast("bigint")), ["ticker", "trade_date"]) == {"numInserted": 0, "numUpdated": 2, "numKept": 58, "numDeleted": 0}
    after = table.manifest()["parts"]
    assert after["AA"] == before["AA"] and after["CC"] == before["CC"] and after["BB"] != before["BB"]
    assert table.manifest()["metrics"]["partitionsReplaced"] == 1 and table.read().where("volume = 1").count() == 2


def test_settings(tmp_path, monkeypatch):
    c = cli.Settings.load({"TICKFORGE_TICKERS": " aa, ,bb", "TICKFORGE_TOP_K": "5", "TICKFORGE_RESET_LANDING": "no", "TICKFORGE_FAULT_RATE": "0.5"})
    assert (c.tickers, c.top_k, c.reset_landing, c.fault_rate, c.rerank_n) == (("AA", "BB"), 5, False, 0.5, 6)
    (tmp_path / ".env").write_text("# x\nTICKFORGE_BATCH_ID='seven'\n")
    monkeypatch.chdir(tmp_path)
    assert cli.Settings.load().batch_id == "seven"


def test_commands(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TICKFORGE_DATA", str(tmp_path))
    monkeypatch.setenv("TICKFORGE_FAULT_RATE", "0.2")
    monkeypatch.setattr(cli, "_session", lambda: spark)
    raw = tmp_path / "raw"
    raw.mkdir()
    rows = [f"2022-03-{d:02d},{s},10,12,9,11,10.5,{100 + d}" for d in range(1, 29) for s in ("AA", "BB")]
    (raw / "q.csv").write_text("Date,Symbol,Open,High,Low,Close/Last,AdjClose,Volume\n" + "\n".join(rows) + "\n")
    side = tmp_path / "filings" / "side"
    side.mkdir(parents=True)
    (side / "acme.json").write_text(json.dumps({"filing_type": "10-K", "period_of_report": "2021-12-31", "item_1A": "Wind turbines raise the costs of spare parts. " * 30}))
    assert cli.main(["pipeline"]) == 0
    for command in ("kafka-setup", "contract-report", "enforce-schema", "quality-gate", "gate-fails", "history", "rag-index", "rag-demo", "lineage-summary", "config"):
        assert cli.main([command]) == 0, command
    assert cli.main(["rag-ask", "Which costs do wind turbines raise?"]) == 0
    evidence = {p.stem: json.loads(p.read_text()) for p in (tmp_path / "evidence").glob("*.json")}
    assert evidence["consumer"]["consumed"] == 56 and evidence["consumer"]["rejected"] == evidence["producer"]["corrupted"] > 0
    assert evidence["bronze"]["rows"] == evidence["consumer"]["accepted"] and evidence["contract_scorecard"]["organic_rejections"] == {}
    assert "turbines" in evidence["answer"][0]["answer"] and evidence["index"]["embedded"] > 0
    assert evidence["gate_failure"]["details"][0]["partial_unexpected_list"] and evidence["gate_failure"]["details"][0]["kwargs"]
    assert (tmp_path / "evidence" / "answer.md").read_text().startswith("# answer")


def test_lineage_is_posted_and_a_dead_collector_breaks_nothing(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tickforge.operators.lineage import Recorder

    got = []

    class Collector(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Collector)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/events"
    with Recorder(None, url=url).run("job", ("a",), ("b",)) as metrics:
        metrics["rows"] = 3
    server.shutdown()
    server.server_close()
    assert [e["eventType"] for e in got] == ["START", "COMPLETE"] and got[1]["metrics"] == {"rows": "3"}
    with Recorder(f"{tmp_path}/l.jsonl", url=url, timeout=0.5).run("job"):
        pass
    assert len((tmp_path / "l.jsonl").read_text().splitlines()) == 2


def test_retries():
    from tickforge.runner import retried

    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "up"

    assert retried(flaky, sleep=waits.append) == "up" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError("never")), attempts=2, sleep=waits.append)
