"""Packs from recipes: whole, and again after one source changed, which alone is read."""

from __future__ import annotations

import json
import os
import zipfile

import pytest

from wordloom.operators import lexicon
from wordloom.sources import build, recipes, tables


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def language(tmp_path):
    home = tmp_path / "xx"
    (home / "sources").mkdir(parents=True)
    (home / "recipe.toml").write_text('[pack]\nlanguage = "xx"\npack_version = 4\n[pack.script]\nword_separated = true\n[build.lexicon]\nmax_words = 50\nminimum_word_length = 1\n[build.lexicon.admission]\nminimum_count = 2\n[build.language_model]\nminimum_count = 1\n')
    one = '[[sources]]\nname = "{0}"\nversion = "1.0"\nlicense = "CC0"\nattribution = "by {0}"\nformat = "{1}"\nrole = "{2}"\nweight = {3}\npath = "../{4}"\n'
    (home / "sources/00.toml").write_text(one.format("list", "word_list", "inventory", 1.0, "words.txt") + one.format("more", "word_list", "inventory", 0.5, "more.txt"))
    (home / "sources/10.toml").write_text(one.format("talk", "sentences", "frequency", 1.0, "talk.tsv") + one.format("news", "corpus_json", "discovery", 0.5, "news.zip"))
    (home / "sources/20.toml").write_text(one.format("faces", "annotation_list", "inventory", 1.0, "faces.txt") + 'group = "emoticon"\n' + one.format("order", "emoji_order", "inventory", 1.0, "emoji.txt") + 'categories = { "Smileys" = "smileys" }\n')
    (home / "words.txt").write_text("tea\nice^tea\nmilk\n")
    (home / "more.txt").write_text("tea\ncup\n")
    (home / "talk.tsv").write_text("1\txx\tgreen tea with milk\n2\txx\tgreen tea\n4\txx\tice tea\n")
    with zipfile.ZipFile(home / "news.zip", "w") as archive:
        archive.writestr("a.json", json.dumps({"document": [{"paragraph": [{"form": "matcha tea. matcha milk"}, {"form": "matcha tea"}]}]}))
    (home / "faces.txt").write_text("(^^)\ttea,zzz\n")
    (home / "emoji.txt").write_text("# group: Smileys\n1F600 ; fully-qualified # 😀 face\n")
    return home


def test_a_pack_from_a_recipe(spark, language, tmp_path):
    out = str(tmp_path / "out")
    first = build.build(spark, str(language), out)
    assert set(first.counted) == {"list", "more", "talk", "news", "faces", "order"} and first.merged == 3
    pack = tables.read_pack(spark, f"{out}/packs/xx")
    assert {r["key"] for r in pack["lexicon"].collect()} == {"tea", "ice", "icetea", "milk", "cup", "matcha"}
    recipe = recipes.load(spark, str(language))
    s = {kind: df.cache() for kind, df in recipes.read(spark, recipe).items()}
    rules, pair_rules, _ = build.rules_of(recipe.build)
    classified = lexicon.classify(lexicon.gather(s["sources"], s["attested"], s["observed"]), rules)
    promoted = lexicon.admit(lexicon.candidates(classified), rules)
    words = lexicon.cut(lexicon.rank_words(lexicon.accumulate(classified, promoted), rules), rules)
    assert got(pack["lexicon"]) == got(words.select("word", "freq"))
    pairs = lexicon.bigram_budget(lexicon.bigram_lift(s["sources"], s["observed"], s["pairs"], words, pair_rules), pair_rules)
    assert got(pack["bigram"]) == got(pairs) and not pairs.isEmpty()
    assert got(pack["annotation"]) == [("tea", "emoticon", "(^^)", 1)]
    assert {(r["grp"], r["category"], r["text"]) for r in pack["catalogue"].collect()} == {("emoji", "smileys", "😀"), ("emoticon", None, "(^^)")}
    metadata = dict(map(tuple, spark.read.parquet(f"{out}/packs/xx/metadata").collect()))
    assert metadata["pack_version"] == "4" and metadata["encoding"] == "utf8" and metadata["affixes"] == ""
    offered = tables.read_catalogue(spark, f"{out}/packs/catalogue.json", 1).collect()
    assert [(r["name"], r["packVersion"]) for r in offered] == [("xx", 4)] and offered[0]["archiveSize"] > 0
    assert "talk 1.0 CC0 > by talk" in (tmp_path / "out/NOTICE/xx.txt").read_text()
    assert first.report.first()["promoted"] == 1
    assert tables.install_pack(spark, f"{out}/packs/xx", str(tmp_path / "home"), json.loads((tmp_path / "out/packs/catalogue.json").read_text())["packs"][0]["archiveDigest"]).count() == 4


def test_only_a_changed_source_is_read_again(spark, language, tmp_path, monkeypatch):
    out, read = str(tmp_path / "out"), []
    for name, f in list(recipes.FORMATS.items()):
        monkeypatch.setitem(recipes.FORMATS, name, lambda spark, path, settings, f=f: (read.append(path.rsplit("/", 1)[-1]), f(spark, path, settings))[1])
    build.build(spark, str(language), out)
    assert sorted(read) == ["emoji.txt", "faces.txt", "more.txt", "news.zip", "talk.tsv", "words.txt"]
    before = got(tables.read_pack(spark, f"{out}/packs/xx")["lexicon"])
    read.clear()
    same = build.build(spark, str(language), out)
    assert (read, same.counted, same.merged) == ([], (), 0) and got(tables.read_pack(spark, f"{out}/packs/xx")["lexicon"]) == before
    # An unchanged source is not opened at all: other bytes under the old size and time go unseen.
    stat = os.stat(language / "more.txt")
    (language / "more.txt").write_text("xxx\nyyy\n")
    os.utime(language / "more.txt", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (language / ".more.txt.crc").unlink(missing_ok=True)
    (language / "talk.tsv").write_text("1\txx\tgreen tea with milk\n2\txx\tgreen tea\n4\txx\tice tea\n3\txx\tcup cup cup\n")
    changed = build.build(spark, str(language), out)
    assert (read, changed.counted) == (["talk.tsv"], ("talk",)) and changed.merged == 2
    after = dict(got(tables.read_pack(spark, f"{out}/packs/xx")["lexicon"]))
    assert set(after) == {k for k, _ in before} and after["cup"] > dict(before)["cup"]
    # A notice is no signal; a weight is none either, but the sums hold it.
    file = language / "sources/10.toml"
    file.write_text(file.read_text().replace("by news", "by others").replace("weight = 0.5", "weight = 0.75"))
    read.clear()
    weighed = build.build(spark, str(language), out)
    assert read == [] and weighed.merged == 2 and "by others" in (tmp_path / "out/NOTICE/xx.txt").read_text()


def test_recipes_say_what_is_wrong(spark, language, tmp_path):
    with pytest.raises(ValueError, match="encoding"):
        build.rules_of({"lexicon": {"encoding": "morse"}})
    with pytest.raises(TypeError):
        build.rules_of({"lexicon": {"maximum_wrods": 3}})
    (language / "talk.tsv").unlink()
    with pytest.raises(FileNotFoundError, match="talk"):
        build.build(spark, str(language), str(tmp_path / "out"))


def test_running_text_parts_neighbours_at_sentence_ends(spark, tmp_path):
    page = "<page><title>a</title><ns>0</ns><revision><text>red tea. blue tea\nred tea! blue sky</text></revision></page>"
    (tmp_path / "dump.xml").write_text(f"<mediawiki>{page}</mediawiki>")
    found = recipes.FORMATS["encyclopaedia"](spark, str(tmp_path / "dump.xml"), {})
    assert got(found["pairs"]) == [("red", "tea", 2)]  # once-met pairs go
    assert dict(got(found["observed"]))["tea"] == 3
