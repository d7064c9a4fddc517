import json
import os

import pytest

from passagework.operators import intake
from passagework.sources.intake import EventFolder, EventReader, Receipts, committed

RECEIPT = "name string, client string, state string, event_id string, digest string, content string, masked array<string>"
CLIENTS = [("pen", True, False, "supported", "prompt_id"), ("ink", True, False, "supported", "turn_id"), ("off", True, True, "supported", "prompt_id"),
           ("shy", False, False, "supported", "prompt_id"), ("old", True, False, "unsupported_version", "prompt_id"), ("new", True, None, None, None), ("mute", True, False, "supported", "prompt_id")]


def event(prompt, native="1", session="s", field="prompt_id", kind="UserPromptSubmit"):
    return json.dumps({"hook_event_name": kind, "session_id": session, field: native, "prompt": prompt})


FILES = {
    "001.pen": event("hello"), "002.pen": event("hello"), "003.pen": event("other text"), "004.ink": event("hi", field="turn_id"), "005.ink": event("hi", field="prompt_id"),
    "006.off": event("x"), "007.shy": event("x"), "008.old": event("x"), "009.none": event("x"), "010.pen": "{not json", "011.pen": "[1]", "012.pen": event("x", kind="Stop"),
    "013.pen": event("x", native=7), "014.pen": event("  "), "015.pen": event(" <agent-message> x", native="2"), "016.pen": event("y" * 3000, native="3"), "017.new": event("x"),
    "018.pen": event("my password: hunter2hunter2", native="4"), "019.pen": event("x", session="s" * 600), "020.pen": json.dumps({"hook_event_name": "UserPromptSubmit", "session_id": "s", "prompt_id": "9", "prompt": ["x"]}),
}
STATES = ["captured", "duplicate", "event_identity_conflict", "captured", "missing_event_identity", "paused", "opt_in_required", "unsupported_version", "not_configured", "invalid_payload", "invalid_payload",
          "unsupported_event", "missing_event_identity", "invalid_payload", "harness_event", "payload_too_large", "client_unavailable", "captured", "missing_event_identity", "invalid_payload"]


@pytest.fixture
def clients(spark):
    return spark.createDataFrame(CLIENTS, "client string, opt_in boolean, paused boolean, capability string, id_field string")


def deliver(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, body in files.items():
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(body)


def run(spark, clients, where):
    spark.dataSource.register(EventFolder)
    spark.dataSource.register(Receipts)
    raw = spark.readStream.format("event_folder").options(path=f"{where}/in", clients="pen,ink,off,shy,old,new", mostBytes="2000").load()
    q = intake.judged(raw, clients, 2000).writeStream.format("receipts").option("path", f"{where}/out").option("checkpointLocation", f"{where}/c").start()
    q.processAllAvailable()
    q.stop()
    return committed(spark, f"{where}/out", RECEIPT)


def test_every_event_has_one_receipt_over_restarts(spark, clients, tmp_path):
    where = str(tmp_path)
    first, second = dict(list(FILES.items())[:9]), dict(list(FILES.items())[9:])
    deliver(f"{where}/in", first)
    assert run(spark, clients, where).count() == 9
    deliver(f"{where}/in", second)
    got = intake.identified(run(spark, clients, where)).orderBy("name").collect()
    assert [(r["name"], r["state"]) for r in got] == [(f"{n}.json", s) for n, s in zip(FILES, STATES, strict=True)]
    assert all((r["event_id"] is not None) == (r["digest"] is not None) == (r["content"] is not None) for r in got)
    secret = next(r for r in got if r["name"] == "018.pen.json")
    assert "hunter2" not in secret["content"] and secret["masked"]
    # the last batch comes again, as after a crash between the sink's commit and the checkpoint's
    newest = max(int(n) for n in os.listdir(f"{where}/c/commits") if n.isdigit())
    os.remove(f"{where}/c/commits/{newest}")
    os.remove(f"{where}/c/commits/.{newest}.crc")
    parts = set(os.listdir(f"{where}/out/parts"))
    assert run(spark, clients, where).count() == len(FILES)
    assert {p for p in os.listdir(f"{where}/out/parts") if not p.startswith(".")} == {p for p in parts if not p.startswith(".")}


def test_what_may_not_be_opened_stays_closed(tmp_path):
    deliver(str(tmp_path), {"1.pen": "ok", "2.shy": "private", "3.pen": "x" * 99, "plain": "no client"})
    reader = EventReader({"path": str(tmp_path), "clients": "pen", "mostbytes": "50"})
    assert reader.initialOffset() == {"after": ""} and reader.latestOffset() == {"after": "plain.json"}
    parts = reader.partitions({"after": "1.pen.json"}, {"after": "plain.json"})
    assert [n for p in parts for n in p.names] == ["2.shy.json", "3.pen.json", "plain.json"]
    assert [(n, c, b) for p in reader.partitions({"after": ""}, {"after": "9"}) for n, c, _, b in reader.read(p)] == [("1.pen.json", "pen", "ok"), ("2.shy.json", "shy", None), ("3.pen.json", "pen", None)]
    assert EventReader({"path": str(tmp_path / "none")}).latestOffset() == {"after": ""}


def test_the_states_of_clients(spark, clients, rows):
    receipts = spark.createDataFrame([("1", "pen", "captured"), ("2", "pen", "duplicate"), ("3", "pen", "invalid_payload"), ("1", "off", "captured"), ("9", "none", "not_configured")], "name string, client string, state string")
    got = intake.status(receipts, clients)
    assert rows(got.select("client", "state", "last_success", "receipts")) == sorted([
        ("pen", "invalid_payload", "2", 3), ("ink", "no_receipt", None, 0), ("off", "paused", "1", 1), ("shy", "no_receipt", None, 0), ("old", "unsupported_version", None, 0),
        ("new", "client_unavailable", None, 0), ("mute", "no_receipt", None, 0)], key=repr)
    assert got.where("state = 'paused'").first()["action"] == intake.REMEDIES["paused"]
    assert rows(intake.overall(got)) == [("mixed",)]
    assert rows(intake.overall(got.where("state = 'paused'"))) == [("paused",)] and rows(intake.overall(got.limit(0))) == [("not_configured",)]
