"""Parsers over small files: word lists, dumps, dictionaries, emoji, readings; sinks and their digests."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import tarfile
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.sources import markup, readings, recipes, tables, text, words


def lines_of(spark, rows, name="f"):
    return spark.createDataFrame([("p", name, k, x) for k, x in enumerate(rows)], "path string, member string, place bigint, line string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_compressed_files_are_lines(spark, tmp_path):
    for name, opener in (("a.gz", gzip.open), ("b.bz2", bz2.open)):
        with opener(tmp_path / name, "wb") as f:
            f.write("één\ntwee\n".encode())
        assert [r["line"] for r in text.lines(spark, str(tmp_path / name)).collect()] == ["één", "twee"]
    (tmp_path / "latin").write_bytes("één".encode("latin-1"))
    assert text.lines(spark, str(tmp_path / "latin"), "ISO-8859-1").first()["line"] == "één"


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        for name, body in (("d/final/english-words.10", "the\n"), ("d/final/english-words.60", "the\nrare\n"), ("d/final/british-upper.10", "X\n"), ("d/other/english-words.10", "no\n")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body.encode()))
    rows = text.archive_lines(spark, str(tmp_path / "x.tar.gz"))
    assert got(words.sized_word_lists(rows, ["english"], ["words"], 70)) == [("rare", 0.25), ("the", 0.875)]
    assert got(words.sized_word_lists(rows, ["english"], ["words"], 50)) == [("the", 1 - 10 / 60)]
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("one.txt", "a\nb")
        z.writestr("two.md", "c")
    assert [r["line"] for r in text.archive_lines(spark, str(tmp_path / "y.zip"), r".*\.txt").orderBy("place").collect()] == ["a", "b"]


def test_sentences_and_counts(spark):
    rows = lines_of(spark, ["1\tkor\t바람 바람 소리", "2\tkor", "3\tkor\t2026년에 Windows는 나왔다."])
    found = words.counted(words.sentences(rows), cased=False, minimum=1)
    assert got(found["observed"]) == [("Windows는", 1), ("나왔다", 1), ("바람", 2), ("소리", 1)]
    assert got(found["pairs"]) == [("Windows는", "나왔다", 1), ("바람", "바람", 1), ("바람", "소리", 1)]


def test_a_corpus_is_read_once_for_words_and_pairs(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    found = words.counted(spark.createDataFrame([("tea tea milk",), ("tea milk",)], "text string").select(seen("text").alias("text")), cased=False, minimum=2)
    assert (got(found["observed"]), got(found["pairs"])) == ([("milk", 2), ("tea", 3)], [("tea", "milk", 2), ("tea", "tea", 1)])
    assert read.value == 2


def test_word_lists(spark):
    found = words.word_list(lines_of(spark, ["# note", "밈", "브이로그\t40", "오탈자\t1", ""]), 0.5, minimum=10)
    assert got(found["attested"]) == [("밈", 0.5), ("브이로그", 0.5)]
    assert got(found["observed"]) == [("밈", 1), ("브이로그", 40)]
    found = words.word_list(lines_of(spark, ["규제^당국", "가-까이"]), 0.4)
    assert {"규제", "당국", "가까이"} <= {r["word"] for r in found["attested"].collect()} and got(found["pairs"]) == [("규제", "당국", 1)]
    spelt = {r["word"] for r in words.word_list(lines_of(spark, ["빅^테크", "정보 기술"]), 0.4)["attested"].collect()}
    assert {"빅테크", "빅", "테크"} <= spelt and "정보기술" not in spelt


def test_morpheme_dictionary(spark):
    rows = [("NNG.csv", "바람,1,1,100,NNG"), ("NNG.csv", "바람,1,1,50,NNG"), ("NNG.csv", "소리,1,1,150,NNG"), ("VV.csv", "먹,1,1,100,VV"), ("Inflect.csv", "먹어,1,1,75,VV+EC"), ("Inflect.csv", "은,1,1,75,JX"), ("NNG.csv", "bad,1")]
    frame = spark.createDataFrame(rows, "member string, line string")
    kinds = F.when(F.col("member") == "NNG.csv", "plain").when(F.col("member") == "VV.csv", "stem").otherwise("inflection")
    found = words.morpheme_dictionary(frame, kinds)
    assert {w: round(r, 3) for w, r in got(found["attested"])} == {"바람": 1.0, "소리": 0.01, "먹다": 0.5, "먹어": 0.75}
    assert got(found["stems"]) == [("먹",)] and got(found["nouns"]) == [("바람", 50), ("바람", 100), ("소리", 150)]


def test_annotations(spark):
    assert got(words.annotation_list(lines_of(spark, ["(^_^)\t웃음, 미소,기쁨", "orz\t깊은 절망", "#x\ty"]), "emoticon")) == [("기쁨", "emoticon", "(^_^)"), ("미소", "emoticon", "(^_^)"), ("웃음", "emoticon", "(^_^)")]
    line = '<annotation cp="😀" draft="contributed">미소 | 스마일 | 활짝 웃음 | 웃음</annotation>'
    assert got(markup.emoji_names(lines_of(spark, [line, '<annotation cp="&amp;">와</annotation>', "<other/>"]))) == [("미소", "emoji", "😀"), ("스마일", "emoji", "😀"), ("와", "symbol", "&"), ("웃음", "emoji", "😀")]
    rows = ["# group: Smileys & Emotion", "1F600 ; fully-qualified # 😀 E1.0 grinning face", "263A ; unqualified # ☺ E0.6 smiling", "# group: Component", "1F3FB ; fully-qualified # 🏻 E1.0 light", "# group: Animals & Nature", "1F415 200D 1F9BA ; fully-qualified # 🐕‍🦺 E12.0 dog"]
    found = markup.emoji_catalogue(lines_of(spark, rows), {"Smileys & Emotion": "SmileysAndPeople", "Animals & Nature": "AnimalsAndNature"})
    assert [(r["category"], r["text"]) for r in found.orderBy("place").collect()] == [("SmileysAndPeople", "😀"), ("AnimalsAndNature", "🐕‍🦺")]


def test_tables_of_scores_fail_on_bad_lines(spark):
    assert got(words.score_table(lines_of(spark, ["the\t100", "theme\t40", "the\t7"]))) == [("the", 100), ("theme", 40)]
    assert got(words.pair_table(lines_of(spark, ["the\tquick\t50", "the\tquick\t1"]))) == [("the", "quick", 51)]
    for bad in ("the 100", "the\tabc", "the\t0", "the\t65536"):
        with pytest.raises(Exception, match="malformed line"):
            words.score_table(lines_of(spark, [bad])).collect()


@pytest.mark.parametrize("given, want", [
    ("{{바깥{{안쪽}}더}}남는다", "�남는다"),
    ("{{일본어|平和}}라고 불렀다", "�라고 불렀다"),
    ("[[한국어]]는 아름답다", "한국어는 아름답다"),
    ("[[문서 이름|보이는 글]]이다", "보이는 글이다"),
    ("[[파일:서울.jpg|섬네일|설명 글]]본문", "�본문"),
    ("본문이다.\n== 외부 링크 ==\n주소\n[[분류:대한민국]]", "본문이다.\n\n\n\n주소\n�"),
    ("가<ref name=x>주</ref>나<!-- c -->다{| a {| b |} |}라", "가�나�다�라"),
    ("앞 {{닫히지 않음 {{x}}", "앞 �"),
    ("a == b [c] {d} < e", "a == b [c] {d} < e"),
    (None, None), ("", ""),
])
def test_wikitext(spark, given, want):
    frame = spark.createDataFrame([(given,)], "t string")
    assert frame.select(markup.strip_wikitext("t").alias("t")).first()["t"] == want


def test_encyclopaedia(spark, tmp_path):
    page = lambda title, ns, more, body: f"<page><title>{title}</title><ns>{ns}</ns>{more}<revision><id>1</id><text bytes='1' xml:space='preserve'>{body}</text></revision></page>"
    body = page("가", 0, "", "앞말 {{틀}} 뒷말 &amp; [[링크]]") + page("나", 0, '<redirect title="가" />', "넘김") + page("다", 1, "", "토론") + page("라", 0, "", "")
    with bz2.open(tmp_path / "d.xml.bz2", "wb") as f:
        f.write(f"<mediawiki>{body}</mediawiki>".encode())
    found = markup.encyclopaedia(spark, str(tmp_path / "d.xml.bz2"))
    assert got(found.filter("text <> ''")) == [("가", "앞말 � 뒷말 & 링크")]
    counted = words.counted(found, cased=False, minimum=1)
    assert Counter(r["word"] for r in counted["observed"].collect()) == Counter(["앞말", "뒷말", "링크"]) and counted["pairs"].isEmpty()


def test_corpora_and_headwords(spark, tmp_path):
    doc = {"document": [{"paragraph": [{"form": "밈이 유행한다"}], "sentence": [{"form": "유행한다", "morpheme": [{"form": "유행"}]}]}], "utterance": [{"form": "밈"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert got(markup.corpus_forms(spark, str(tmp_path / "c.json"))) == [("밈",), ("밈이 유행한다",), ("유행한다",)]
    item = lambda word, unit, kind, pos, more="": f"<item><wordInfo><word>{word}</word><word_unit>{unit}</word_unit></wordInfo><senseInfo><pos>{pos}</pos><type>{kind}</type>{more}</senseInfo></item>"
    body = item("흙-무덤", "어휘", "일반어", "명사", "<relation_info><word>토총001</word></relation_info>") + item("규제^당국", "구", "일반어", "품사 없음") + item("흙무데기", "어휘", "방언", "명사") + item("가", "어휘", "일반어", "어미")
    (tmp_path / "u.xml").write_text(f"<channel>{body}</channel>")
    assert got(markup.headwords(spark, str(tmp_path / "u.xml"), ["일반어"], ["어휘", "구"], ["어미"])) == [("규제^당국",), ("흙-무덤",)]


def test_readings(spark):
    classes = readings.word_classes(lines_of(spark, ["0 BOS/EOS", "1 名詞,一般,*", "2 助詞,格助詞", "3 名詞,一般,x"]), ["助詞"])
    rows = lines_of(spark, ["きしゃ\t1\t1\t5000\t汽車", "a\t1\t1\tdear\tb", "は\t2\t2\t-5\tは", "bad\t1", "x\t1\t1\t99999\ty"])
    assert got(readings.entries(rows, classes)) == [("x", "y", 1, 1, 65535, False), ("きしゃ", "汽車", 1, 1, 5000, False), ("は", "は", 2, 2, 0, True)]
    assert got(readings.single_characters(lines_of(spark, ["あい\t愛藍"]), classes)) == [("あい", "愛", 1, 1, 15000, False), ("あい", "藍", 1, 1, 15010, False)]
    assert got(readings.connection_cells(lines_of(spark, ["2", "0", "-500", "x", "70000"]))) == [(0, 1, -500), (1, 1, 32767)]
    assert got(readings.named_signs(lines_of(spark, ["head\tx", "(^^)\tえがお わらい"]), 0, 1, "emoticon")) == [("えがお", "emoticon", "(^^)"), ("わらい", "emoticon", "(^^)")]
    assert got(readings.test_sentences(lines_of(spark, ["# c", "OK:\tにわ\t庭\tx", "OK:\t\t庭"]))) == [("にわ", "庭")]


def test_packs_caches_and_audits(spark, tmp_path):
    lexicon = spark.createDataFrame([("the", 100), ("then", 70)], "key string, freq int")
    folder = str(tmp_path / "pack")
    manifest = tables.write_pack(spark, {"lexicon": lexicon, "bigram": lexicon.limit(0)}, folder, {"language": "en"})
    assert [(r["section"], r["row_count"]) for r in manifest.collect()] == [("lexicon", 2)]
    assert got(tables.read_pack(spark, folder)["lexicon"]) == [("the", 100), ("then", 70)]
    lexicon.limit(1).write.mode("append").parquet(f"{folder}/lexicon")
    with pytest.raises(ValueError, match="lexicon"):
        tables.read_pack(spark, folder)
    with pytest.raises(ValueError):
        tables.write_pack(spark, {"lexicon": lexicon.limit(0)}, str(tmp_path / "none"), {})
    made = []
    make = lambda: made.append(1) or lexicon
    for key in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert tables.cached(spark, str(tmp_path / "cache"), key, make).count() == 2
    assert len(made) == 2
    assert tables.optional(spark, str(tmp_path / "missing"), spark.read.parquet) is None
    with pytest.raises(FileNotFoundError):
        tables.optional(spark, str(tmp_path / "missing"), spark.read.parquet, required=True)
    tables.write_audit({"words": lexicon}, str(tmp_path / "audit"))
    assert got(spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "audit/words"))) == [("the", "100"), ("then", "70")]
    assert got(tables.deduplicate(lexicon.unionByName(spark.createDataFrame([("the", 5)], "key string, freq int")))) == [("the", 100), ("then", 70)]


def test_catalogues_of_a_later_format_are_refused(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"formatVersion": 2, "packs": [\n {"name": "ko", "packVersion": 6, "archiveSize": 10}]}')
    assert [tuple(r) for r in tables.read_catalogue(spark, str(tmp_path / "c.json"), 2).collect()] == [("ko", 6, 10)]
    with pytest.raises(Exception, match="catalogue format 2"):
        tables.read_catalogue(spark, str(tmp_path / "c.json"), 1).collect()


def test_packs_without_a_catalogue_may_be_loaded(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    have = "name string, packVersion int"
    found = tables.pack_states(names, spark.createDataFrame([("a", 1)], have), spark.createDataFrame([("a", 3), ("b", 2)], have))
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "installed", 1, None, False), ("b", "bundled", 2, None, False), ("c", "not installed", None, 0, False)]


def test_a_language_is_written_beside_the_others(spark, tmp_path):
    folder, schema = str(tmp_path / "snapshots"), "language string, user_id bigint, place int, line string"
    assert tables.read_snapshots(spark, folder, "ko").count() == 0
    tables.write_snapshots(spark.createDataFrame([("ko", 1, 0, "3"), ("en", 1, 0, "4")], schema), folder)
    tables.write_snapshots(spark.createDataFrame([("ko", 1, 0, "5")], schema), folder)
    assert [r["line"] for r in tables.read_snapshots(spark, folder, "ko").collect()] == ["5"]
    assert [r["line"] for r in tables.read_snapshots(spark, folder, "en").collect()] == ["4"]


def test_sources_of_a_recipe_keep_their_files_order(spark, tmp_path):
    language = tmp_path / "xx"
    (language / "sources").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    (language / "recipe.toml").write_text("[build]\nmax_words = 10\n")
    (language / "words.txt").write_text("tea\nice^tea\t3\n")
    (language / "faces.txt").write_text("(^^)\tsmile\n")
    one = '[[sources]]\nname = "{}"\nformat = "{}"\nrole = "inventory"\npath = "../{}"\n'
    (language / "sources/20-faces.toml").write_text(one.format("faces", "annotation_list", "faces.txt") + 'group = "emoticon"\n')
    (language / "sources/10-words.toml").write_text(one.format("words", "word_list", "words.txt") + "weight = 0.5\nrank = 0.4\n" + one.format("gone", "word_list", "gone.txt") + "required = false\n")
    assert [p.rsplit("/", 1)[-1] for p in recipes.languages(spark, str(tmp_path))] == ["xx"]
    with pytest.raises(FileNotFoundError):
        recipes.languages(spark, str(tmp_path), ["empty"])
    recipe = recipes.load(spark, str(language))
    assert (recipe.name, recipe.build, [s.name for s in recipe.sources]) == ("xx", {"max_words": 10}, ["words", "gone", "faces"])
    found = recipes.read(spark, recipe)
    assert got(found["sources"]) == [("faces", "inventory", 1.0), ("words", "inventory", 0.5)]
    assert got(found["attested"]) == [("words", "ice", 0.4), ("words", "icetea", 0.4), ("words", "tea", 0.4)]
    assert got(found["observed"]) == [("words", "ice", 3), ("words", "tea", 4)] and got(found["pairs"]) == [("words", "ice", "tea", 3)]
    assert got(found["annotations"]) == [("faces", "smile", "emoticon", "(^^)")] and found["stems"].isEmpty()
    (language / "sources/30-bad.toml").write_text(one.format("bad", "no such", "words.txt"))
    with pytest.raises(ValueError, match="no such"):
        recipes.load(spark, str(language))
    for file in (language / "sources").iterdir():
        file.write_text("")
    with pytest.raises(ValueError, match="no sources"):
        recipes.load(spark, str(language))


def test_nouns_with_particles_keep_the_dictionarys_own_costs(spark):
    rows = [("NNG.csv", "바람,1,1,100,NNG"), ("NNG.csv", "소리,1,1,150,NNG"), ("NNG.csv", "K,1,1,120,NNG"), ("NNG.csv", "꿈,1,1,900,NNG"), ("VV.csv", "바람이,1,1,7000,VV")]
    kinds = F.when(F.col("member") == "NNG.csv", "plain").when(F.col("member") == "VV.csv", "inflection")
    found = words.morpheme_dictionary(spark.createDataFrame(rows, "member string, line string"), kinds, expanded=3)
    ranks = {w: round(r, 4) for w, r in got(found["attested"])}
    rank = lambda cost: round(1 - (cost - 100) / 6900, 4)
    assert ranks["바람은"] == rank(300) and ranks["소리는"] == rank(350) and ranks["꿈"] == rank(900)
    assert ranks["바람이"] == 0.01 and "바람는" not in ranks and "소리은" not in ranks and "꿈은" not in ranks
    assert not any(w.startswith("K") and w != "K" for w in ranks)
    assert got(found["stems"]) == [("K되",), ("K하",), ("바람되",), ("바람하",), ("소리되",), ("소리하",)]


def test_packs_are_installed_whole_or_not_at_all(spark, tmp_path):
    lexicon = spark.createDataFrame([("the", 100)], "key string, freq int")
    archive, home = str(tmp_path / "new"), str(tmp_path / "home/en")
    tables.write_pack(spark, {"lexicon": lexicon}, archive, {"language": "en"})
    expected = tables.digest(spark, archive)
    for _ in range(2):
        assert [r["section"] for r in tables.install_pack(spark, archive, home, expected).collect()] == ["lexicon"]
    with pytest.raises(ValueError, match="digest"):
        tables.install_pack(spark, archive, home, "0" * 64)
    assert got(tables.read_pack(spark, home)["lexicon"]) == [("the", 100)]
    assert sorted(p.name for p in (tmp_path / "home").iterdir()) == ["en"]


def test_a_damaged_cache_is_made_again(spark, tmp_path):
    lexicon = spark.createDataFrame([("the", 100)], "key string, freq int").coalesce(1)
    folder = tmp_path / "cache"
    assert tables.cached(spark, str(folder), {"a": 1}, lambda: lexicon).count() == 1
    (part,) = folder.glob("*/part-*.parquet")
    part.write_bytes(part.read_bytes()[:-20])
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert got(tables.cached(spark, str(folder), {"a": 1}, lambda: lexicon)) == [("the", 100)]


def test_tables_of_scores_say_which_line_is_bad_and_refuse_to_be_empty(spark):
    with pytest.raises(Exception, match="malformed line 2: bad"):
        words.score_table(lines_of(spark, ["the\t100", "bad"])).collect()
    with pytest.raises(ValueError, match="no lines"):
        words.pair_table(lines_of(spark, ["", " "]))
