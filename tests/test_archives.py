"""Archives by member, digests by range: against the standard library's readers, with members and files over 2 GB of holes."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wordloom.sources import archives, markup, tables, text


class Sparse(io.RawIOBase):
    """Writes zeros as holes."""

    def __init__(self, path):
        self.file = open(path, "wb")

    def writable(self):
        return True

    def seekable(self):
        return True

    def tell(self):
        return self.file.tell()

    def seek(self, *at):
        return self.file.seek(*at)

    def write(self, data):
        data = bytes(data)
        if data.strip(b"\0"):
            return self.file.write(data)
        self.file.seek(len(data), 1)
        return len(data)

    def close(self):
        self.file.close()
        super().close()


def made(path, form, members):
    if form == "zip":
        with zipfile.ZipFile(path, "w") as archive:
            for k, (name, data) in enumerate(members):
                archive.writestr(name, data, [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2][k % 3])
    else:
        with tarfile.open(path, form) as archive:
            for name, data in members:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
    return str(path)


MEMBERS = [(f"d/{k}.txt", f"first {k}\r\nzwei ü {k}\n\nlast{' x' * k * 500}".encode()) for k in range(40)] + [("d/none.txt", b""), ("other.bin", b"\xff\xfe")]


@pytest.mark.parametrize("form", ["zip", "w:", "w:gz", "w:xz"])
def test_lines_of_members(spark, tmp_path, form):
    path = made(tmp_path / "a", form, MEMBERS)
    rows = archives.members(spark, path, member=r"d/.*\.txt", run_bytes=2_000)
    got = {}
    for r in rows.orderBy("member", "place").collect():
        assert r["place"] == len(got.setdefault(r["member"], []))
        got[r["member"]].append(r["line"])
    assert got == {n: d.decode().replace("\r\n", "\n").split("\n") for n, d in MEMBERS[:40]}
    assert (rows.rdd.getNumPartitions() > 5) == (form in ("zip", "w:"))
    assert text.archive_lines(spark, path, r"nothing").collect() == []


def test_a_damaged_member_is_an_error(spark, tmp_path):
    path = tmp_path / "a.zip"
    made(path, "zip", MEMBERS[:1])
    raw = bytearray(path.read_bytes())
    raw[40] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        archives.members(spark, str(path)).collect()
    with pytest.raises(FileNotFoundError):
        archives.members(spark, str(tmp_path / "gone*.zip"))


@pytest.mark.parametrize("form", ["zip", "tar"])
def test_members_behind_more_than_two_gigabytes(spark, tmp_path, form):
    path, hole = tmp_path / f"large.{form}", 9 << 28
    sink = Sparse(path)
    if form == "zip":
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as archive:
            with archive.open("hole.bin", "w", force_zip64=True) as out:
                for _ in range(hole >> 24):
                    out.write(bytes(1 << 24))
            archive.writestr("small.txt", "one\ntwo")
    else:
        for name, size, data in (("hole.bin", hole, b""), ("small.txt", 7, b"one\ntwo")):
            info = tarfile.TarInfo(name)
            info.size = size
            sink.write(info.tobuf())
            sink.write(data or b"")
            sink.seek(-sink.tell() % 512 + (0 if data else size), 1)
        sink.write(b"\0" * 1023 + b"\0")
        sink.file.truncate(sink.tell())
    sink.close()
    assert path.stat().st_size > 2**31
    got = archives.members(spark, str(path), member="small.txt").select("place", "line").collect()
    assert [tuple(r) for r in got] == [(0, "one"), (1, "two")]


def test_sentences_at_any_depth_of_json_in_a_zip(spark, tmp_path):
    deep = {"document": [{"paragraph": [{"form": "one"}], "sentence": [{"form": "two", "morpheme": [{"form": "no"}], "inner": {"box": [{"utterance": [{"form": "four", "n": 1}]}]}}]}], "utterance": [{"form": "five"}], "form": "no"}
    for _ in range(150):
        deep = {"more": [deep]}
    path = made(tmp_path / "a.zip", "zip", [("x/1.json", json.dumps(deep).encode()), ("x/readme.txt", b"{"), ("2.json", b'{"sentence": [{"form": "six"}, {"form": null}]}')])
    assert sorted(r["text"] for r in markup.corpus_forms(spark, path).collect()) == ["five", "four", "one", "six", "two"]
    (tmp_path / "plain.json").write_text(json.dumps(deep, indent=1))
    assert [r["text"] for r in markup.corpus_forms(spark, str(tmp_path / "plain.json")).collect()] == ["one", "two", "four", "five"]


def test_headwords_of_xml_in_a_zip(spark, tmp_path):
    item = "<item>\n<wordInfo>\n<word>{}</word>\n<word_unit>{}</word_unit>\n</wordInfo>\n<senseInfo>\n<type>{}</type>\n<pos>noun</pos>\n<relation_info><word>no</word></relation_info></senseInfo>\n</item>\n"
    body = "<channel>" + "<title>items</title>" + "".join(item.format(f"word{k} &amp; " + "y" * 3_000, "single" if k % 2 else "affix", "common") for k in range(900)) + "</channel>"
    path = made(tmp_path / "a.zip", "zip", [("b/1.xml", body.encode()), ("b/2.xml", item.format("only", "single", "old").encode())])
    got = markup.headwords(spark, path, ["common"], ["single"]).select(F.substring_index("phrase", " ", 2).alias("w")).collect()
    assert sorted(r["w"] for r in got) == sorted(f"word{k} &" for k in range(1, 900, 2))


def test_digests_are_the_same_at_any_range_and_over_five_gigabytes(spark, tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a").write_bytes(b"tea")
    (tmp_path / "d/b").write_bytes(b"")
    small = tables.digest(spark, str(tmp_path / "d"))
    assert small == hashlib.sha256("".join(sorted(hashlib.sha256(x).hexdigest() for x in (b"tea", b""))).encode()).hexdigest()
    with open(tmp_path / "d/c", "wb") as out:
        out.seek(archives.LEAF_BYTES * 3 + 5)
        out.write(b"end")
    found = archives.files(spark, str(tmp_path / "d"))
    whole = archives.digest(spark, str(tmp_path / "d"))
    assert len({whole, small}) == 2 and {archives.digest(spark, str(tmp_path / "d"), run) for run in (1, 20_000_000, 10**9)} == {whole}
    by_ranges = sorted(map(tuple, archives.leaf_digests(spark, found).collect()))
    monkeypatch.setattr(archives, "can_seek", lambda path: False)
    assert sorted(map(tuple, archives.leaf_digests(spark, found).collect())) == by_ranges
    monkeypatch.undo()
    with open(tmp_path / "large", "wb") as out:
        out.truncate(5 << 30)
    leaf = hashlib.sha256(bytes(archives.LEAF_BYTES)).hexdigest()
    root = hashlib.sha256((leaf * 640).encode()).hexdigest()
    assert archives.digest(spark, str(tmp_path / "large")) == hashlib.sha256(root.encode()).hexdigest()


def test_files_digested_side_by_side_share_one_source(spark, tmp_path, monkeypatch):
    """Spark refuses a name that another thread has registered, as it did two sources of a recipe with files of several leaves."""

    class Taken(AnalysisException):
        def getCondition(self):
            return "DATA_SOURCE_ALREADY_EXISTS"

    kind, known = type(spark.dataSource), set()
    register = kind.register

    def once(self, source):
        if source.name() in known:
            raise Taken("taken")
        register(self, source)
        known.add(source.name())

    monkeypatch.setattr(kind, "register", once)
    for name in "ab":
        (tmp_path / name).write_bytes(name.encode() * (archives.LEAF_BYTES + 1))
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(lambda name: archives.digest(spark, str(tmp_path / name))), "ab"))
    leaves = lambda name: [name.encode() * archives.LEAF_BYTES, name.encode()]
    hexed = lambda data: hashlib.sha256(data).hexdigest()
    assert found == [hexed(hexed("".join(map(hexed, leaves(name))).encode()).encode()) for name in "ab"]
