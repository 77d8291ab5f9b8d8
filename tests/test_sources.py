"""Files, tables, packages and published versions."""

import io
import threading
import zipfile

import pytest

from quarry.sources import files, sinks


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_rtf():
    raw = rb"{\rtf1\ansi\ansicpg1252\uc1{\fonttbl{\f0 Arial;}}{\*\generator Some;}{\info{\title Hidden}}\f0 Na\'efve \b bold\b0  \u8364?uro\par second\tab line\line \{braces\}\~x{\pict 0102}\par\u-10179?\u-8704? end}"
    assert files.rtf_text(raw) == "Naïve bold €uro\nsecond\tline\n{braces}\xa0x\n😀 end"
    assert files.rtf_text(b"") == "" and files.rtf_text(b"{\\rtf1\\ansi\\ansicpg1251 \\'cf\\'f0}") == "Пр"


def _book():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{i % 2}</v></c><c r="C{i}"><v>{i}.5</v></c><c r="D{i}" t="b"><v>1</v></c></row>' for i in range(1, 6))
    return _zip({
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Empty" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>a|b</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData>{rows}<row r="9"><c r="A9" t="inlineStr"><is><t> </t></is></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {ns}><sheetData/></worksheet>",
    })


def test_xlsx_tables(spark):
    assert files.xlsx_tables(_book(), most_rows=2) == [("One", "| two runs |  | 1.5 | TRUE |\n| --- | --- | --- | --- |\n| a\\|b |  | 2.5 | TRUE |\n(5 rows and 4 columns in all)")]
    df = spark.createDataFrame([("x.xlsx", bytearray(_book()))], "path string, content binary")
    (row,) = files.read_tables(df).collect()
    assert row.sheet == "One" and row.text.count("\n") == 5


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "a.rtf").write_bytes(b"{\\rtf1 hello\\par world}")
    (tmp_path / "b.docx").write_bytes(_zip({"word/document.xml": "<w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p>", "word/media/x.png": "x"}))
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    d = files.read_files(spark, f"file://{tmp_path}")
    assert {r.suffix: r.magic_ok for r in d.collect()} == {"rtf": True, "docx": True, "pdf": False}
    assert files.read_rtf(d.where("suffix = 'rtf'")).first().text == "hello\nworld"
    (row,) = files.read_ooxml(d.where("suffix = 'docx'")).collect()
    assert row.text == "one\ntwo" and row.has_pictures


def test_package_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/package"
    tables = {
        "chunks": spark.createDataFrame([("c1", "s", 1, "h", "text")], "id string, source_id string, ordinal int, heading string, content string"),
        "entities": spark.createDataFrame([("n1", "s", "name", "type")], "id string, source_id string, name string, type string"),
        "events": spark.createDataFrame([("e1", "c1", None, "t", "x", None)], "id string, chunk_id string, parent_id string, title string, content string, category string"),
        "event_entities": spark.createDataFrame([("e1", "n1", 0.5, None)], "event_id string, entity_id string, weight double, description string"),
    }
    sinks.export_package(tables, path)
    back = files.read_package(spark, path)
    assert back["chunks"].collect() == tables["chunks"].collect() and back["event_entities"].first().weight == 0.5 and back["events"].first().title == "t"
    for broken in ({"event_entities": tables["event_entities"].limit(0)}, {"entities": tables["entities"].limit(0)}):
        try:
            sinks.export_package({**tables, **broken}, f"{path}-broken")
            raise AssertionError("a broken package was written")
        except ValueError:
            pass


def test_readers_always_find_a_version(spark, tmp_path):
    root, missing, stop = f"file://{tmp_path}/published", [], threading.Event()
    assert sinks.current_version(spark, root) is None
    sinks.publish(spark.range(1).toDF("a"), root)
    pointers = tmp_path / "published" / "pointers"

    def watch():
        while not stop.is_set():
            if not any(p.name.endswith(".json") and not p.name.startswith((".", "_")) and p.stat().st_size for p in pointers.iterdir() if p.exists()):
                missing.append(1)

    t = threading.Thread(target=watch)
    t.start()
    versions = [sinks.publish(spark.range(n).toDF("a"), root, n) for n in range(2, 6)]
    assert sinks.read_published(spark, root).count() == 5 and sinks.current_version(spark, root) == versions[-1]
    assert sinks.rollback(spark, root) == versions[-2] and sinks.read_published(spark, root).count() == 4
    stop.set()
    t.join()
    assert not missing and sinks._pointers(spark, root) == [1, 2, 3, 4, 5, 6]
    try:
        sinks.publish(spark.range(3).toDF("a"), root, 4)
        raise AssertionError("a version of the wrong size was published")
    except ValueError:
        assert sinks.current_version(spark, root) == versions[-2]
    folders = {p.name for p in (tmp_path / "published").iterdir() if p.name.startswith("v-")}
    assert len(folders) == 5  # that of the wrong size is gone


def test_two_publishers_at_once(spark, tmp_path, monkeypatch):
    """The second one writes and points while the first one counts its rows: the first fails, and readers find the second's rows."""
    root = f"file://{tmp_path}/published"
    sinks.publish(spark.range(1).toDF("a"), root)
    point = sinks._point

    def late(*args):
        monkeypatch.setattr(sinks, "_point", point)
        sinks.publish(spark.range(9).toDF("a"), root, 9)
        assert sinks.read_published(spark, root).count() == 9
        point(*args)

    monkeypatch.setattr(sinks, "_point", late)
    with pytest.raises(RuntimeError):
        sinks.publish(spark.range(5).toDF("a"), root, 5)
    assert sinks.read_published(spark, root).count() == 9 and sinks._pointers(spark, root) == [1, 2]


def test_old_versions_are_swept_and_dead_pointers_passed_over(spark, tmp_path):
    root = f"file://{tmp_path}/published"
    for n in range(1, sinks.KEEP + 3):
        sinks.publish(spark.range(n).toDF("a"), root)
    assert len(sinks._pointers(spark, root)) == sinks.KEEP
    assert len([p for p in (tmp_path / "published").iterdir() if p.name.startswith("v-")]) == sinks.KEEP
    dead = tmp_path / "published" / "pointers" / f"{sinks.KEEP + 3:012d}.json"
    dead.write_text("")
    assert sinks.read_published(spark, root).count() == sinks.KEEP + 2
    sinks.publish(spark.range(77).toDF("a"), root)
    assert sinks.read_published(spark, root).count() == 77


def test_encodings_are_told_apart(spark):
    from quarry.sources import charset

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ru, el = "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 3, "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία του κόσμου και των ανθρώπων. " * 3
    more = spark.createDataFrame([(ru,), (el,)], "text string")
    pairs = charset.model(charset.pair_counts(docs.select("text").unionByName(more), "text"))
    texts = [r.text for r in docs.where("lang <> 'en' and length(text) > 300").orderBy("doc_id").limit(40).collect()]
    wrong = []
    for t in texts:
        for name in ("utf-8", "utf-8-sig", "utf-16", "utf-32", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be", "cp1252", "mac_roman", "cp850"):
            try:
                raw = t.encode(name)
            except UnicodeEncodeError:
                continue
            got = charset.detect(raw, pairs)
            wrong += [] if got and got[1] == t else [(name, got and got[0])]
    assert not wrong
    for t, names in ((ru, ("cp1251", "koi8_r", "cp866")), (el, ("cp1253",)), ("这是一个用来检查编码的中文句子，里面有标点。" * 3, ("gb18030", "gbk")), ("これは日本語の文章です。ひらがなとカタカナ。" * 3, ("shift_jis",))):
        for name in names:
            assert charset.detect(t.encode(name), pairs)[1] == t
    assert charset.detect(None, pairs) is None and charset.detect(b"", pairs) == ("utf-8", "") and charset.detect(bytes(range(1, 32)) * 20, pairs) is None
    rows = spark.createDataFrame([(1, bytearray(b"plain"), "plain"), (2, bytearray("été où".encode("cp1252")), "été où"), (3, None, None)], "id int, raw binary, want string")
    out = rows.select("want", charset.decoded(rows.raw, pairs).alias("d")).collect()
    assert all((r.d.text if r.d else None) == r.want for r in out)


def test_runs_of_blocks(spark, tmp_path, monkeypatch):
    """A failed run leaves the old blocks readable, a repeated one gives the same rows, a later one replaces its versions only."""
    from quarry.sources import partitions as P

    root = f"file://{tmp_path}/blocks"
    blocks = lambda rows: spark.createDataFrame(rows, "version string, ordinal int, text string")
    with pytest.raises(FileNotFoundError):
        P.read_blocks(spark, root)
    assert P.write_blocks(blocks([("v1", 0, "a"), ("v1", 1, "b"), ("v2", 0, "c")]), root, "r1") == 3
    now = lambda: sorted((r.version, r.ordinal, r.text) for r in P.read_blocks(spark, root).collect())
    old = now()
    assert old == [("v1", 0, "a"), ("v1", 1, "b"), ("v2", 0, "c")]
    with monkeypatch.context() as m:
        m.setattr(P, "_fs", lambda *a: (_ for _ in ()).throw(OSError("no mark")) if a[1].endswith("r2.json") else P.__dict__["_real"](*a))
        P._real = sinks._fs
        with pytest.raises(OSError):
            P.write_blocks(blocks([("v1", 0, "half")]), root, "r2")
    assert now() == old
    for _ in range(2):
        P.write_blocks(blocks([("v1", 0, "new")]), root, "r2")
        assert now() == [("v1", 0, "new"), ("v2", 0, "c")]
    P.write_blocks(blocks([("v1", 0, "a"), ("v1", 1, "b"), ("v2", 0, "c")]), root, "r1")  # the first run again: still the earlier one
    assert now() == [("v1", 0, "new"), ("v2", 0, "c")]


def test_upserts_of_vectors(spark, tmp_path):
    from quarry.sources import partitions as P

    root = f"file://{tmp_path}/points"
    points = lambda rows: spark.createDataFrame(rows, "id long, vec array<double>, payload string")
    up = lambda rows: tuple(P.upsert_vectors(points(rows), root, 2, 4).first())
    assert up([(1, [1.0, 0.0], "a"), (2, None, "b"), (2, None, "c")]) == (1, 0, 1)
    read = lambda: {r.id: (r.vec, r.payload, r.has_vector) for r in spark.read.parquet(f"{root}/points").collect()}
    assert read() == {1: ([1.0, 0.0], "a", True), 2: ([0.0, 0.0], "c", False)}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "points").rglob("*.parquet")}
    assert up([(1, None, "a2")]) == (0, 1, 0) and read()[1] == ([1.0, 0.0], "a2", True)
    assert up([(2, [0.0, 1.0], "b2")]) == (0, 1, 0) and read()[2] == ([0.0, 1.0], "b2", True)
    assert before and all(p.parent.name in ("bucket=0", "bucket=1", "bucket=2", "bucket=3") for p in before)
    with pytest.raises(ValueError):
        up([(3, [1.0], "x")])
