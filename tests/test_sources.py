import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from broadsheet import schemas
from broadsheet.cli import main, parser
from broadsheet.sources import images, tables, xml
from broadsheet.sources.registry import Registry
from broadsheet.streaming import ingest

NS = "http://www.loc.gov/standards/alto/ns-v2#"


def alto(blocks: str, ns: str = f' xmlns="{NS}"', page: str = "1") -> bytes:
    return f'<?xml version="1.0"?><alto{ns}><Layout><Page PHYSICAL_IMG_NR="{page}"><PrintSpace>{blocks}</PrintSpace></Page></Layout></alto>'.encode()


BLOCKS = """
<TextBlock ID="b1"><TextLine ID="l1" HPOS="10" VPOS="9.9E1" WIDTH="x" HEIGHT="5.7"><String CONTENT="Ein"/><SP/><String CONTENT="Ta-" SUBS_CONTENT="Tageblatt"/><String CONTENT="ge  neu"/></TextLine>
<TextLine ID="l2"/><TextLine><String CONTENT="ohne"/></TextLine></TextBlock>
<TextBlock><TextLine ID="l3"><String CONTENT="weg"/></TextLine></TextBlock>
<TextBlock ID="b2"><TextLine ID="l4" HPOS="9.999999E6"><String CONTENT="ſo"/><String CONTENT=""/></TextLine></TextBlock>"""

METS = """<mets:mets xmlns:mets="http://www.loc.gov/METS/" xmlns:mods="http://www.loc.gov/mods/v3" xmlns:xlink="http://www.w3.org/1999/xlink"><mets:dmdSec><mods:mods>
<mods:dateIssued encoding="iso8601">1901-02-15</mods:dateIssued><mods:part><mods:detail type="volume"><mods:number>2</mods:number></mods:detail><mods:detail type="issue"><mods:number>Nr. 415</mods:number></mods:detail></mods:part>
<mods:physicalDescription><mods:extent>12 Seiten</mods:extent></mods:physicalDescription><mods:partNumber>Morgen</mods:partNumber>
<mods:relatedItem type="host"><mods:titleInfo><mods:title>Blatt</mods:title></mods:titleInfo><mods:identifier type="zdb">Z1</mods:identifier></mods:relatedItem>
<mods:language><mods:languageTerm type="code">ger</mods:languageTerm></mods:language></mods:mods></mets:dmdSec>
<mets:fileSec><mets:fileGrp USE="MAX"><mets:file ID="FILE_0001_MASTER" MIMETYPE="image/jpeg"><mets:FLocat xlink:href="http://x/a.jpg"/></mets:file>
<mets:file ID="FILE_0002_MASTER" MIMETYPE="image/tiff"><mets:FLocat xlink:href="http://x/b"/></mets:file></mets:fileGrp>
<mets:fileGrp USE="DEFAULT"><mets:file ID="D"><mets:FLocat xlink:href="http://x/d.jpg"/></mets:file></mets:fileGrp></mets:fileSec></mets:mets>"""

NAME = "3074409X_1901-02-15_000_415_H_2"


@pytest.fixture()
def archive(tmp_path):
    issue = tmp_path / "raw" / "1901" / "02" / "15" / "01"
    (issue / "fulltext").mkdir(parents=True)
    (issue / f"{NAME}.xml").write_text(METS)
    (issue / "fulltext" / f"{NAME}_001.xml").write_bytes(alto(BLOCKS))
    (issue / "fulltext" / f"{NAME}_002.xml").write_bytes(b"<alto broken")
    (issue / "fulltext" / f"{NAME}_010.xml").write_bytes(alto(BLOCKS, ns=""))
    return tmp_path


def test_lines(spark, archive):
    rows = {r.line_id: r for r in xml.scan_lines(spark, str(archive / "raw")).collect()}
    a = rows[f"{NAME}_001.xml_b1_l1"]
    assert (a.text, a.x, a.y, a.width, a.height) == ("Ein Tageblatt ge neu", 10, 99, None, 5)
    assert (a.page_id, a.text_block_id, str(a.date), a.year, a.issue_number, a.page_number) == ("1901-02-15_415_H_2_001", "1901-02-15_415_H_2_001_b1", "1901-02-15 00:00:00", 1901, 415, 1)
    assert (a.newspaper_title, a.page_count, a.year_volume, a.newspaper_subtitle) == ("Blatt", 12, "2", None)
    assert rows[f"{NAME}_001.xml_b2_l4"].x == 9999999 and len(rows) == 2
    assert ", ".join(f"{n} {t}" for n, t in xml.scan_lines(spark, str(archive / "raw")).dtypes) == schemas.LINES


def test_limit_and_resume(spark, archive):
    root = str(archive / "raw")
    assert [p.path.rsplit("_", 1)[1] for p in xml.files(spark, root, 2).orderBy("path").collect()] == ["001.xml", "002.xml"]
    seen = spark.createDataFrame([(f"{NAME}_001.xml",)], "filename string")
    assert xml.scan_lines(spark, root, seen=seen).count() == 0
    assert xml.load_files(spark, [f"{root}/1901/02/15/01/fulltext/{NAME}_001.xml"]).count() == 2
    files = xml.listing(spark, root, "*.xml").where(F.contains("path", F.lit("/fulltext/")))
    assert sorted(r.filename[-7:] for r in xml.empty_files(files, xml.scan_lines(spark, root)).collect()) == ["002.xml", "010.xml"]


def test_blocks(spark, archive):
    rows = xml.scan_blocks(xml.files(spark, str(archive / "raw"))).where("path like '%001.xml'").orderBy("block_order").collect()
    assert [(r.uid, r.page, r.block_order, r.text) for r in rows] == [("1901-02-15-i01", 1, 0, "Ein Ta- ge  neu\nohne"), ("1901-02-15-i01", 1, 1, "weg"), ("1901-02-15-i01", 1, 2, "so")]


def test_issue_metadata_and_images(spark, archive):
    found = xml.files(spark, str(archive / "raw"), fulltext=False)
    r = xml.scan_issues(found).first()
    assert (str(r.date), r.issue_number, r.edition, r.newspaper_id, r.language, r.newspaper_subtitle) == ("1901-02-15 00:00:00", 415, "Morgen", "Z1", "ger", None)
    pics = xml.scan_images(found)
    assert sorted((p.file_id, p.extension) for p in pics.collect()) == [("FILE_0001_MASTER", ".jpg"), ("FILE_0002_MASTER", ".jpg")]
    r = xml.completeness(pics, xml.listing(spark, str(archive / "raw"))).first()
    assert (r.expected, r.images_found, r.alto_found, len(r.missing_images), len(r.missing_alto)) == (2, 0, 2, 2, 0)
    assert xml.mets_images(METS.replace('USE="MAX"', 'USE="MIN"').encode()) == []
    targets = xml.image_targets(pics, "/img", str(archive / "raw"))
    assert sorted(r.target for r in targets.collect())[0] == "/img/1901/02/15/01/FILE_0001_MASTER.jpg"
    assert tuple(images.coverage(targets, spark.createDataFrame([("/img/1901/02/15/01/FILE_0001_MASTER.jpg",)], "path string")).first()) == (2, 1, 1, 50.0)


def png(width, height, size=2000):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\0" * size


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, height, width) + b"\0" * 2000


def test_images(spark, tmp_path):
    for name, data in (("valid.png", png(30, 20)), ("a.jpg", jpeg(40, 50)), ("empty.png", b""), ("small.png", png(3, 3, 10)), ("corrupt.jpg", b"x" * 3000), ("flat.png", png(0, 5))):
        (tmp_path / name).write_bytes(data)
    checked = images.validate(spark, str(tmp_path))
    rows = {r.file_path.rsplit("/", 1)[1]: r for r in checked.collect()}
    assert {k for k, r in rows.items() if r.is_valid} == {"valid.png", "a.jpg"}
    assert (rows["a.jpg"].width, rows["a.jpg"].height, rows["a.jpg"].format) == (40, 50, "JPEG") and rows["valid.png"].width == 30
    assert "too small" in rows["empty.png"].error and rows["flat.png"].error == "no area"
    assert tuple(images.validation_summary(checked).first()) == (6, 2, 4)
    assert images.dimensions(b"GIF89a" + struct.pack("<HH", 7, 8))[1:] == (7, 8)
    assert images.dimensions(b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 256, 4, 1, 9) + struct.pack("<HHIHH", 257, 3, 1, 6, 0))[1:] == (9, 6)
    sums = spark.createDataFrame([("a.jpg", hashlib.md5(jpeg(40, 50)).hexdigest()), ("gone.png", "x")], "filename string, md5 string")
    assert {r.filename: r.ok for r in tables.verify_checksums(spark, sums, str(tmp_path)).collect()} == {"a.jpg": True, "gone.png": False}


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "ner").mkdir()
    (tmp_path / "ner" / "N_1901-01-02_x.json").write_text(json.dumps({"entities": [{"text": "Berlin", "label": "LOC", "start": 0, "end": 6}]}, indent=1))
    assert tuple(tables.ner(spark, str(tmp_path / "ner")).first()) == ("1901-01-02", "Berlin", "LOC", 0, 6, 1.0)
    (tmp_path / "pairs" / "sub").mkdir(parents=True)
    (tmp_path / "pairs" / "a.json").write_text(json.dumps({"fulltext_basename": "N_1901-01-02_x", "caption": {"text_content": "c"}}))
    (tmp_path / "pairs" / "sub" / "b.json").write_text(json.dumps({"fulltext_basename": "odd"}))
    (tmp_path / "pairs" / "sub" / "c.json").write_text("{broken")
    assert [r.fulltext_basename for r in tables.pairs(spark, str(tmp_path / "pairs")).collect()] == ["odd", "N_1901-01-02_x"]
    (tmp_path / "t.csv").write_text("year,month,day,issue,topics,subtopics,path\n1901,2,15,01,a|b,c,p\n1901,2,31,01,a,,p\n")
    assert [str(r.date) for r in tables.topic_table(spark, str(tmp_path / "t.csv")).collect()] == ["1901-02-15", "None"]
    (tmp_path / "e.tsv").write_text("id\t" + "\t".join(f"mean_{e}" for e in schemas.EMOTION_NAMES) + "\tyear\tera1\tera2\nN_1901-01-01\t0,5\tx\t\t1\t2\t3\t1901\twar\tpre\n")
    r = tables.emotion_means(spark, str(tmp_path / "e.tsv")).first()
    assert (r.mean_Agitation, r.mean_Anger, r.mean_Fear, r.year) == (0.5, 0.0, 0.0, 1901)
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "1901-02-15-i01.txt").write_text("a\nb")
    r = tables.issue_texts(spark, str(tmp_path / "txt")).first()
    assert (r.year, r.month, r.day, r.issue, r.text) == ("1901", "02", "15", "01", "a\nb")
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "N_1901-02-15_000_415_H_2_009.txt").write_text("Source: x\nText")
    assert tuple(tables.page_texts(spark, str(tmp_path / "pages")).first()) == ("1901-02-15", "415", 9, "Text")


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,a\n1,one\nx,two\n")
    assert sorted(map(tuple, tables.csv(spark, str(tmp_path / "x.csv"), "a string, b int").collect()), key=str) == [("one", 1), ("two", None)]
    with pytest.raises(ValueError, match="missing columns: c"):
        tables.csv(spark, str(tmp_path / "x.csv"), "a string, c int")
    (tmp_path / "y.csv").write_text('a,b,extra\n"th, ""ree""\nlines",3,q\nshort,4\n')
    (tmp_path / "z.csv").write_bytes(b"a,b\n\xff\xfe,1\n")
    (tmp_path / "empty.csv").write_text("")
    got = sorted(map(tuple, tables.union_csv(spark, str(tmp_path), "a string, b int").collect()))
    assert got == [("one", 1), ('th, "ree"\nlines', 3)]
    assert sorted((r.path.rsplit("/", 1)[1], r.place) for r in tables.misfits(spark, str(tmp_path), "a string, b int").collect()) == [("x.csv", 2), ("y.csv", 2), ("z.csv", 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 1901, "a"), ("2", 1902, "b")], "id string, year int, text string")
    tables.write_parquet(df, str(tmp_path / "p"), ("year",), ("id",))
    back = tables.partitioned(spark, str(tmp_path / "p")).where("year = 1901")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(year" in back._jdf.queryExecution().executedPlan().toString()
    e = spark.createDataFrame([("l", "B", "person")], "line_id string, entity_text string, entity_type string")
    meta = tables.write_result(e, str(tmp_path / "r"), "entities", "llm", "gpt-4.1", "src")
    assert meta["line_count"] == 1 and meta["analysis_id"].startswith("llm_gpt_4_1_") and "." not in meta["analysis_id"]
    assert json.loads(spark.read.text(str(tmp_path / "r" / "metadata")).first()["value"])["source"] == "src"
    tables.write_grouped_json(e, str(tmp_path / "g"))
    assert json.loads(spark.read.text(str(tmp_path / "g")).first()["value"])["entities"]["person"] == ["b"]
    tables.write_csv(df, str(tmp_path / "c"), "\t", ("id",))
    assert spark.read.csv(str(tmp_path / "c"), sep="\t", header=True).count() == 2
    edges = spark.createDataFrame([("d", "x & y", 1)], "source string, target string, weight int")
    tables.write_gexf(edges, str(tmp_path / "g.gexf"))
    assert "x &amp; y" in (tmp_path / "g.gexf").read_text()
    with pytest.raises(ValueError, match="more than"):
        tables.write_gexf(edges, str(tmp_path / "g.gexf"), 0)
    blocks = spark.createDataFrame([("u", 1, 0, "a")], "uid string, page int, block_order int, text string")
    tables.write_issue_texts(blocks, str(tmp_path / "t"))
    assert "".join(p.read_text() for p in (tmp_path / "t" / "uid=u").glob("*.txt")) == "=== PAGE 1 ===\n\na\n"
    tables.write_report(df, str(tmp_path / "rep"), "id")
    assert tables.source_view(spark, str(tmp_path / "none")) is False


def test_streaming_ingest(spark, archive):
    root, out, mark = str(archive / "raw"), str(archive / "out"), str(archive / "mark")
    ingest.append_lines(ingest.pages(spark, root), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    (archive / "raw" / "1901" / "02" / "15" / "01" / "fulltext" / f"{NAME}_011.xml").write_bytes(alto(BLOCKS))
    ingest.append_lines(ingest.pages(spark, root), out, mark).awaitTermination()
    assert spark.read.parquet(out).groupBy("filename").count().count() == 2 and spark.read.parquet(out).count() == 4


def test_streaming_counts(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' event_type UNION ALL SELECT timestamp'2024-01-01 03:00:00', 'a'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = ingest.event_counts(stream).writeStream.format("memory").queryName("counts_").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts_").where("n = 1").count() == 1  # the last window is still open


def test_registry(tmp_path):
    (tmp_path / "sources").mkdir()
    for n in ("b10", "b9"):
        (tmp_path / "sources" / f"{n}.json").write_text(json.dumps({"dataset_name": n, "data_type": "xml", "metadata": {}, "loading": {}, "parts": [{"name": "p", "years": "1900-1902"}]}))
    r = Registry(str(tmp_path))
    assert r.names() == ["b9", "b10"] and r.load("b9").name == "b9"
    with pytest.raises(ValueError, match="b9, b10"):
        r.load("x")
    assert r.extraction_status("b9", {1901}) == {"p": True} and r.extraction_status("b9", {1905}) == {"p": False}
    assert r.paths("b9")["lines"].endswith("b9_lines.parquet")


def test_cli(spark, archive, capsys):
    (archive / "sources").mkdir()
    (archive / "sources" / "s.json").write_text(json.dumps({"dataset_name": "s", "metadata": {"newspaper_title": "Blatt"}, "parts": [{"name": "p", "years": "1901"}]}))
    (archive / "raw").rename(archive / "xml")
    (archive / "raw").mkdir()
    (archive / "xml").rename(archive / "raw" / "s")
    base = ["--data-dir", str(archive), "--results-dir", str(archive / "results")]
    assert main([*base, "data", "list-sources"]) == 0 and "s Blatt" in capsys.readouterr().out
    assert main([*base, "data", "parse", "--source", "s"]) == 0
    assert main([*base, "data", "parse", "--source", "s"]) == 0  # resumes
    lines = Registry(str(archive)).paths("s")["lines"]
    assert spark.read.parquet(lines).count() == 2
    assert main([*base, "data", "aggregate", "--source", "s", "--force"]) == 0
    assert main([*base, "data", "find-empty", "--source", "s"]) == 0 and capsys.readouterr().out.startswith("2\n")
    assert main([*base, "data", "info", "--source", "s"]) == 0
    assert main([*base, "data", "check-completeness", "--source", "s"]) == 0
    assert main([*base, "data", "preprocess", "--source", "s", "--input", lines, "--output", str(archive / "clean"), "--steps", "normalize, lowercase"]) == 0
    assert main([*base, "analyze", "extract-entities", "--source", "s", "--min-length", "5"]) == 0
    with pytest.raises(SystemExit):
        parser().parse_args(["data", "parse"])


def test_cli_downloads(archive, capsys):
    import tarfile

    (archive / "sources").mkdir()
    made = archive / "made.tar.gz"
    with tarfile.open(made, "w:gz") as tar:
        tar.add(archive / "raw" / "1901", arcname="around/1901")
    parts = [{"name": "p", "url": made.as_uri(), "md5": hashlib.md5(made.read_bytes()).hexdigest()}, {"name": "q", "url": (archive / "none").as_uri()}]
    (archive / "sources" / "s.json").write_text(json.dumps({"dataset_name": "s", "parts": parts}))
    base = ["--data-dir", str(archive), "data"]
    assert main([*base, "sources"]) == 0 and capsys.readouterr().out.startswith("s")
    assert main([*base, "download", "--source", "s", "--part", "p"]) == 0 and "p downloaded" in capsys.readouterr().out
    assert main([*base, "download", "--source", "s"]) == 1 and "p present\nq failed" in capsys.readouterr().out
    assert main([*base, "unpack", "--source", "s", "--part", "p", "--fix", "1901/02/15/01", "1902/02/15/01"]) == 0
    assert (archive / "raw" / "s" / "1902" / "02" / "15" / "01").is_dir() and main([*base, "unpack", "--source", "s"]) == 1
    with pytest.raises(SystemExit, match="unknown part"):
        main([*base, "download", "--source", "s", "--part", "x"])


def test_cli_reads_files_once(spark, archive, monkeypatch, capsys):
    (archive / "sources").mkdir()
    (archive / "sources" / "s.json").write_text(json.dumps({"dataset_name": "s"}))
    (archive / "raw").rename(archive / "xml")
    (archive / "raw").mkdir()
    (archive / "xml").rename(archive / "raw" / "s")
    base, paths = ["--data-dir", str(archive), "data"], Registry(str(archive)).paths("s")
    names = lambda: sorted(r.filename[-7:] for r in spark.read.parquet(paths["ledger"]).collect())
    assert main([*base, "parse", "--source", "s", "--limit", "1"]) == 0 and names() == ["001.xml"]
    assert main([*base, "parse", "--source", "s", "--limit", "1"]) == 0 and names() == ["001.xml", "002.xml"]  # the cap counts new files
    assert main([*base, "parse", "--source", "s"]) == 0 and names() == ["001.xml", "002.xml", "010.xml"]
    assert main([*base, "parse", "--source", "s"]) == 0 and names() == ["001.xml", "002.xml", "010.xml"]  # files without text aren't read again
    assert spark.read.parquet(paths["lines"]).count() == 2
    got = []
    monkeypatch.setattr("broadsheet.sources.download.fetch_all", lambda jobs, workers: got.extend(jobs) or {"total": len(got)})
    assert main([*base, "download-images", "--source", "s"]) == 0 and [u for u, _ in got] == ["http://x/a.jpg", "http://x/b"]
    assert all(t.startswith(paths["images"]) for _, t in got)
