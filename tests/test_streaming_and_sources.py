from datetime import datetime, timedelta


from lectern.sources import decks, tables
from lectern.streaming import events as streams


def rows(spark):
    start = datetime(2024, 1, 1)
    data = [(i, start + timedelta(seconds=10 * i), i % 2, "view", float(i), f"b{i % 3}") for i in range(40)] + [(3, start + timedelta(seconds=30), 1, "view", 3.0, "other")]
    return spark.createDataFrame(data, streams.SCHEMA)


def run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    rows(spark).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = streams.source(spark, f"{tmp_path}/in")
    assert len(run(streams.feed(source, 30), "feed")) == 9
    assert sum(r.n for r in run(streams.tumbling(source), "tumbling", "complete")) == 41
    assert len(run(streams.first_of_key(source), "firsts")) == 40


def test_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_bytes("﻿line\r\nnext\f".encode())
    (folder / "b.md").write_bytes(b"ok \x00")
    (folder / "c.PDF").write_bytes(b"%PDF-1.7 x")
    (folder / "d.pdf").write_bytes(b"text")
    (folder / "e.exe").write_bytes(b"x")
    (folder / "f.txt").write_bytes(b"\xff\xfe")
    files = tables.raw_files(spark, str(folder))
    verdicts = {r.path.rsplit("/", 1)[1]: r.verdict for r in files.collect()}
    assert verdicts == {"a.txt": "ok", "b.md": "text", "c.PDF": "ok", "d.pdf": "magic", "e.exe": "type", "f.txt": "text"}
    assert tables.texts(files).first().text == "line\nnext\n"


def test_decks_as_files(spark, tmp_path):
    cards = spark.createDataFrame([(1, 0, 'a "b"', "x", "t", "g", "d"), (1, 1, "c", "y\ty", "t", "h", "d"), (2, 0, "e", "z", "", "i", "f")], "deck_id long, place long, front string, back string, tags string, guid string, deck string")
    for kind, sign in (("csv", ","), ("tsv", "\t")):
        decks.write_decks(decks.deck_lines(cards, kind), f"{tmp_path}/{kind}")
        part, = (tmp_path / kind / "deck_id=1").glob("part-*")
        lines = part.read_bytes().decode().splitlines()
        assert lines[0].startswith("\ufeff") == (kind == "csv") and lines[5].endswith(sign.join(decks.COLUMNS)) and len(lines) == 8
        assert lines[6] == sign.join(['"a ""b"""', '"x"', '"t"', '"g"', '"d"'])
