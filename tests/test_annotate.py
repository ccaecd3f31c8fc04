import hashlib
import tarfile

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import annotate
from broadsheet.sources import download


def test_client_waits_and_gives_up():
    waits, calls = [], []

    def transport(payload):
        calls.append(payload)
        if len(calls) < 3:
            raise annotate.Refused(429)
        return "ok"

    c = annotate.Client(transport, "m", sleep=waits.append)
    assert c.complete("hi", "sys", True, top_p=1) == "ok" and waits == [1.0, 2.0]
    assert calls[0] == {"model": "m", "messages": [{"role": "system", "content": "sys"}, {"role": "user", "content": "hi"}], "temperature": 0.0, "max_tokens": 1000, "top_p": 1, "response_format": {"type": "json_object"}}

    def no(payload):
        raise annotate.Refused(401)

    with pytest.raises(annotate.Refused):
        annotate.Client(no, sleep=waits.append).complete("x")

    def down(payload):
        raise TimeoutError

    waits.clear()
    with pytest.raises(OSError):
        annotate.Client(down, sleep=waits.append).complete("x")
    assert waits == [1.0, 2.0]


def local():
    # workers can't import this module, so what they run is defined within a function
    def fake():
        def transport(payload):
            text = payload["messages"][-1]["content"]
            if "fail" in text:
                raise annotate.Refused(500)
            if "one per line" in text:
                return "1. War and peace\n2. Trade with Japan"
            if "sentiment" in text:
                return '{"sentiment": "positive", "emotions": ["joy"], "intensity": 0.5, "tone": "calm"}' if "good" in text else "odd"
            return '{"persons": ["Anna"], "locations": ["Berlin"], "organizations": null}'

        return annotate.Client(transport, retries=2, sleep=lambda s: None)

    return fake


fake = local()


def test_entities_and_answers(spark, frame):
    lines = frame("line_id string, text string, date string", ("1", "x" * 60, "1901-01-01"), ("2", "short", None), ("3", "fail " * 20, None), ("4", None, None))
    got = sorted((r.line_id, r.entity_text, r.entity_type) for r in annotate.extract_entities(lines, fake, source="Blatt").collect())
    assert got == [("1", "Anna", "person"), ("1", "Berlin", "location")]
    fine, bad = annotate.ask(frame("id long, text string", (1, "good day"), (2, "hm")), "emotion", fake)
    assert [r.parsed.sentiment for r in fine.collect()] == ["positive"] and [r.id for r in bad.collect()] == [2]
    assert set(annotate.PROMPTS) == {"entities", "topic", "topics", "emotion", "concepts", "summary", "quality"}
    assert annotate.extract_topics(frame("id long, text string", (1, "t")), fake).first()["topics"] == "War and peace|Trade with Japan"


def test_issue_topics(frame):
    r = annotate.issue_topics(frame("issue string, text string", ("a", "Kaiser Wilhelm reist. Kaiser Wilhelm kommt.")), "issue").first()
    assert r.topics.startswith("kaiser wilhelm|") and r.subtopics.split("|")[:2] == ["kaiser", "wilhelm"] and r.method == "keywords"


def test_nested(frame):
    e = frame("line_id string, entity_text string, entity_type string, confidence double", ("1", "A", "person", 0.5))
    assert tuple(annotate.nested(e).select("id", "entity.*").first()) == ("1", "A", "person", 0.5)


def test_download(tmp_path):
    source = tmp_path / "s.bin"
    source.write_bytes(b"data")
    url, good = source.as_uri(), hashlib.md5(b"data").hexdigest()
    assert download.fetch(url, tmp_path / "t" / "a", good) == "downloaded" and download.fetch(url, tmp_path / "t" / "a", good) == "present"
    (tmp_path / "t" / "a").write_bytes(b"bad")
    assert download.fetch(url, tmp_path / "t" / "a", good) == "downloaded"
    with pytest.raises(OSError, match="damaged"):
        download.fetch(url, tmp_path / "b", "0" * 32, delay=0)
    assert not (tmp_path / "b").exists() and not (tmp_path / "b.part").exists()
    jobs = [(url, str(tmp_path / "c")), (url, str(tmp_path / "t" / "a")), ((tmp_path / "none").as_uri(), str(tmp_path / "d"))]
    assert download.fetch_all(jobs, delay=0) == {"downloaded": 1, "present": 1, "failed": 1, "total": 3}


def test_unpack_and_relocate(tmp_path):
    (tmp_path / "in" / "part" / "1900" / "01" / "02" / "01").mkdir(parents=True)
    (tmp_path / "in" / "part" / "1900" / "01" / "02" / "01" / "N_1900-01-02_1.xml").write_text("<a>1900-01-02 02.01.1900 Jahr 1900</a>")
    with tarfile.open(tmp_path / "p.tar.gz", "w:gz") as t:
        t.add(tmp_path / "in" / "part", "part")
    assert download.unpack(tmp_path / "p.tar.gz", tmp_path / "raw") == 1
    assert download.relocate_issue(tmp_path / "raw", "1900/01/02/01", "1902/01/02/01", {"Jahr 1900": "Jahr 1902"}) == 1
    assert (tmp_path / "raw/1902/01/02/01/N_1902-01-02_1.xml").read_text() == "<a>1902-01-02 02.01.1902 Jahr 1902</a>"
    assert download.relocate_issue(tmp_path / "raw", "1900/01/02/01", "1902/01/02/01") == 0
