"""Briefings, imports and backups on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import briefing

from sessionlake.sources import backup

SESSION = "id string, date string, title string, session_type string, error_tags array<string>, topic_tags array<string>, fill_pct double, archive_path string, updated_at string, session_timestamp string, body string, _pos long"


def sessions(spark):
    rows = [
        ("a", "2024-04-01", "Rust build", "debug", ["timeout"], ["ci"], 10.0, "p/09-00-00-x-a.md", "", "", "text", 0),
        ("b", "2024-04-07", "Notes", "chat", [], [], 60.0, "p/x.md", "", "2024-04-07T08:00:00Z", "Καλημέρα", 1),
        ("c", "someday", "Other", "chat", [], [], 90.0, "p/x.md", "2024-04-02T00:00:00Z", "", None, 2),
    ]
    return spark.createDataFrame(rows, SESSION)


def ids(frame):
    return [r["id"] for r in frame.collect()]


def test_briefing(spark):
    s = sessions(spark)
    assert ids(briefing.briefing_sessions(s)) == ["b", "c", "a"]
    assert ids(briefing.briefing_sessions(s, fallback=1)) == ["b"]
    assert ids(briefing.briefing_sessions(s, keyword="DEBUG timeout")) == ["a"]  # across fields
    assert ids(briefing.briefing_sessions(s, keyword="καλημερα")) == ["b"]
    assert ids(briefing.briefing_sessions(s, date_from="2024-04-05")) == ["b", "c"]  # an unreadable date passes
    assert ids(briefing.briefing_sessions(s, fill_min=50, fill_max=80)) == ["b"]
    assert len(ids(briefing.briefing_sessions(s, keyword="nowhere", fallback=2))) == 2
    times = {r["id"]: str(r["t"]) for r in s.select("id", briefing.session_time().alias("t")).collect()}
    assert times["a"].startswith("2024-04-01 09:00") and times["b"].startswith("2024-04-07 08:00")


def test_header(spark):
    s = sessions(spark).filter("id <> 'c'")
    line = lambda d: briefing.header(d).first()["header"]
    assert line(s) == "2 sessions - Apr 1-7" and line(s.filter("id = 'a'")) == "1 session - Apr 1"
    assert line(s.union(s.limit(1).withColumn("date", F.lit("2024-05-03")))) == "3 sessions - Apr 1-May 3"
    assert line(s.limit(0)) == "0 sessions - "


def test_first_seen(spark):
    rows = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "b", 2), (1, None, 3)], "k int, v string, at int")
    assert briefing.first_seen(rows, "k", "v", "at").first()["values"] == ["b", "a"]


def test_viber(spark):
    rows = [
        (1, 1, 700000000.0, " hi ", "received", 7, None, None, None),
        (2, 1, 700000001.0, "yo", "delivered", None, None, None, None),
        (3, 9, 700000002.0, "x", "received", 7, None, None, None),
        (4, 1, 0.0, "x", "received", 7, None, None, None),
        (5, 1, 700000003.0, "x", "received", 7, "call", None, None),
        (6, 1, 700000004.0, "x", "odd", 7, None, None, None),
        (7, 1, 700000005.0, " ", "received", 7, None, 3, None),
        (8, 1, 700000006.0, None, "received", 7, None, None, None),
        (9, 1, 700000007.0, "who", "received", None, None, None, None),
    ]
    m = spark.createDataFrame(rows, "Z_PK long, ZCONVERSATION long, ZDATE double, ZTEXT string, ZSTATE string, ZPHONENUMINDEX long, ZSYSTEMTYPE string, ZATTACHMENT long, ZGALLERYTYPE long")
    c = spark.createDataFrame([(1, None, "Chat")], "Z_PK long, ZGROUPID string, ZNAME string")
    p = spark.createDataFrame([(7, "+306912345678")], "Z_PK long, ZPHONE string")
    got = {r["guid"]: r for r in backup.viber_messages(m, c, p).collect()}
    assert [got[f"viber-{k}"]["skip"] for k in range(1, 10)] == [None, None, "orphan", "bad_date", "system", "unknown_state", "media", "unusable_text", None]
    assert (got["viber-1"]["text"], got["viber-1"]["sender"], got["viber-2"]["sender"]) == ("hi", "+306912345678", "me")
    assert got["viber-9"]["no_sender"] and not got["viber-1"]["no_sender"] and str(got["viber-1"]["ts"]).startswith("2023-")


def test_chat_tables(spark):
    join = spark.createDataFrame([(1, 12), (1, 11), (2, 11)], "message_id long, attachment_id long")
    files = spark.createDataFrame([(11, "a", "m", "t", 5), (12, "b", "m", "t", 6)], "ROWID long, filename string, mime_type string, transfer_name string, total_bytes long")
    got = {r["message_id"]: [a["filename"] for a in r["attachments"]] for r in backup.message_attachments(join, files).collect()}
    assert got == {1: ["a", "b"], 2: ["a"]}
    handles = spark.createDataFrame([(1, "x"), (2, "y")], "ROWID long, id string")
    chats = spark.createDataFrame([(5, 2), (5, 1), (5, 2)], "chat_id long, handle_id long")
    assert backup.chat_participants(chats, handles).first()["participants"] == ["x", "y"]
    rows = spark.createDataFrame([(" G ", list("ab")), ("", list("abcdef")), (None, ["a"]), ("G", [])], "name string, labels array<string>")
    assert [r[0] for r in rows.select(backup.conversation_title(F.col("name"), F.col("labels"))).collect()] == ["G", "a, b, c, d, +2", "a", "Unknown"]


def test_manifest_and_discovery(spark):
    files = spark.createDataFrame([("ab12", "HomeDomain", "sms.db"), ("cd34", "AppDomain-Viber", "x")], "fileID string, domain string, relativePath string")
    assert backup.located(files, "HomeDomain", "sms.db").first()["stored"] == "ab/ab12"
    assert [r[0] for r in backup.domains(files, "viber").collect()] == ["AppDomain-Viber"]
    paths = ["/r/x/Conversations.json", "/r/y/conversations-001.json", "/r/z/d/conversations.json", "/r/.h/conversations.json", "/other/conversations.json", "/r/x/other.json"]
    listing = spark.createDataFrame([(p, 1) for p in paths], "path string, length long")
    assert sorted(r["path"] for r in backup.discovered(listing, "/r/", "conversations.json").collect()) == paths[:2]


def test_manifest_lookup_opens_one_range(spark, tmp_path):
    """A lookup by domain and path goes to the file: one partition of many, and the same rows as without."""
    import sqlite3

    from sessionlake.sources import sqlite

    path = tmp_path / "Manifest.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE Files (fileID TEXT, domain TEXT COLLATE NOCASE, relativePath TEXT, n INTEGER)")
        db.executemany("INSERT INTO Files VALUES (?, ?, ?, ?)", [(f"{i:04x}", f"D{i % 7}" if i % 2 else f"d{i % 7}", f"p/{i}", i if i % 3 else None) for i in range(5000)])
    assert backup.backup_state(str(tmp_path)) == "ok" and backup.located(backup.manifest(spark, str(tmp_path)), "D3", "p/4001").collect() == []
    assert backup.located(backup.manifest(spark, str(tmp_path)), "D4", "p/4001").first()["fileID"] == f"{4001:04x}"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def load(rows):
        return spark.read.format("sqlite").schema("ROWID long, fileID string, domain string, relativePath string, n long").option("path", str(path)).option("table", "Files").option("rows", rows).load()

    assert load(100).rdd.getNumPartitions() == 50
    assert load(100).filter("domain = 'D4' AND relativePath = 'p/4001'").rdd.getNumPartitions() == 1
    for where in ("domain = 'd4'", "n > 4990", "n >= 17 AND n <= 20", "n IN (1, 2, 4999)", "relativePath LIKE 'p/12%'", "n IS NULL AND ROWID < 9", "n IS NOT NULL AND domain > 'd5'", "n = 6 OR domain = 'x'", "upper(domain) = 'D1' AND n < 50"):
        plain = spark.createDataFrame(load(100).collect(), load(100).schema).filter(where)
        assert {r["ROWID"] for r in load(100).filter(where).collect()} == {r["ROWID"] for r in plain.collect()}, where
    (tmp_path / "locked").mkdir()
    (tmp_path / "locked" / "Manifest.db").write_bytes(b"\x00" * 64)
    assert backup.backup_state(str(tmp_path / "locked")) == "encrypted" and backup.backup_state(str(tmp_path / "none")) == "not_a_backup"
    with pytest.raises(ValueError, match="encrypted"):
        backup.manifest(spark, str(tmp_path / "locked"))


def test_probe_of_all_tables(spark):
    blob = b"\x04\x0bstreamtyped\x81\xe8\x03\x84\x01@\x84\x84\x84\x12NSString\x01\x94\x84\x01+\x02hi\x86"
    message = spark.createDataFrame([(5, "a", None), (7, " ", bytearray(blob)), (9, None, bytearray(b"junk")), (11, None, None)], "date long, text string, attributedBody binary")
    chat = spark.createDataFrame([(1,), (2,)], "ROWID long")
    got = {r["table"]: tuple(r)[1:] for r in backup.probed({"message": (message, "date", "text", "attributedBody"), "chat": (chat, None, None, None)}).collect()}
    assert got == {"message": (4, 5, 11, 3, 2, 1), "chat": (2, None, None, None, None, None)}
