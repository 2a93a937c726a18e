"""Column helpers on texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quireflow.functions import text as X
from quireflow.sources import wordlist


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def words(spark, *known):
    return wordlist.dictionary(spark.createDataFrame([(w,) for w in known], "word string"), spark)


@pytest.mark.parametrize(
    ("lines", "joined"),
    [
        (["a hand-", "made chair and", "an out-of-the-", "way barn"], "a hand-made chair and an out-of-the-way barn"), (["U-", "turn"], "U-turn"), (["gamma-", "quill"], "gamma-quill"), (["MP3-", "player"], "MP3-player"),
        (["orna-", "ment"], "ornament"), (["decora-", "tive"], "decorative"), (["The (Orna-", "ment) shop"], "The (Ornament) shop"), (["soft­", "ware"], "software"), (["xylo­", "phonequux"], "xylophonequux"),
        (["winds turned -", "slowly"], "winds turned - slowly"), (["brindl-", "ewick"], "brindl-ewick"), (["  one ", "", " two"], "one two"), ([], ""), (["-", "x"], "- x"),
    ],
)
def test_join_lines(spark, lines, joined):
    known = words(spark, "ornament", "decorative", "hand", "made", "way", "software")
    assert value(spark, X.join_lines(F.lit(lines) if lines else F.expr("cast(array() as array<string>)"), known)) == joined


def test_dictionary_decides(spark, tmp_path):
    (tmp_path / "words").write_text("Zymurgy\n\nfoo-bar\nfoobar \n")
    known = wordlist.dictionary(wordlist.read_words(spark, str(tmp_path / "words")), spark)
    assert known.value == {"zymurgy", "foo-bar", "foobar"}
    for lines, joined in ((["zymur-", "gy"], "zymurgy"), (["foo-", "bar"], "foo-bar"), (["informa-", "tion"], "informa-tion")):
        assert value(spark, X.join_lines(F.lit(lines), known)) == joined


def test_glyph_sizes_agree(spark):
    sizes = [value(spark, X.glyph_size(F.lit(t), F.lit(h))) for t, h in (("Tiles", 7.2), ("sun", 5.2), ("Ropeyard", 9.3))]
    assert max(sizes) / min(sizes) < 1.05 and sizes[0] == pytest.approx(10.0)
    assert value(spark, X.glyph_size(F.lit("--"), F.lit(3.0))) is None


@pytest.mark.parametrize(("text", "margin", "page"), [("Page 3", False, True), ("pg. 4 of 9", False, True), ("3/10", False, False), ("3/10", True, True), ("- 12 -", True, True), ("xiv", True, True), ("civil", True, True), ("12345", True, False), ("Page three", True, False)])
def test_page_numbers(spark, text, margin, page):
    assert value(spark, X.is_page_number(F.lit(text), F.lit(margin))) == page


@pytest.mark.parametrize(("text", "page", "margin", "left"), [("where the lane meets the mill. Page 12", 12, True, "where the lane meets the mill."), ("Page 5 of 9 Body", 6, False, "Body"), ("Page 5 Body", 9, False, "Page 5 Body"), ("see page 7", 7, False, "see"), ("Page 1 x page 2", 1, True, "x page 2")])
def test_page_labels(spark, text, page, margin, left):
    assert value(spark, X.strip_page_label(F.lit(text), F.lit(page), F.lit(margin))) == left


@pytest.mark.parametrize(
    ("text", "conf", "source", "alone", "junk"),
    [("= ~ || -- ^", 40, "ocr", True, True), ("5 15 25 35", 60, "ocr", False, True), ("k", 50, "ocr", True, True), ("Bees like warm walls.", 95, "ocr", True, False), ("Bees like warm walls.", 20, "ocr", True, True), ("•", 10, "ocr", True, False), ("  ", 99, "text", False, True), ("k", 50, "text", True, False), ("== ==", 99, "text", False, True)],
)
def test_junk(spark, text, conf, source, alone, junk):
    assert value(spark, X.is_junk(F.lit(text), F.lit(float(conf)), F.lit(source), F.lit(alone))) == junk


@pytest.mark.parametrize(("text", "escaped"), [("12) x", "12\\) x"), ("3.", "3\\."), ("3.5 x", "3.5 x"), ("# x", "\\# x"), ("#x", "#x"), ("- x", "\\- x"), ("> x", "\\> x"), ("plain", "plain")])
def test_escaped_starts(spark, text, escaped):
    assert value(spark, X.escape_start(F.lit(text))) == escaped


@pytest.mark.parametrize(("path", "name"), [("a/b/My file (1).PDF", "My_file_1.pdf"), ("/x/..PDF", None), ("Über äh.docx", "Über_äh.docx"), ("???.doc", "document.doc"), ("noext", "noext")])
def test_safe_names(spark, path, name):
    got = value(spark, X.safe_name(F.lit(path)))
    assert got == name if name else got


def test_previews(spark):
    assert value(spark, X.preview(F.lit("a\n\nb\n\nc"), 5)) == "a"
    assert value(spark, X.preview(F.lit("a\n\nb"), 50)) == "a\n\nb" and value(spark, X.preview(F.lit("abcdefgh"), 4)) == "abcd"


def test_ligatures_and_counts(spark):
    assert value(spark, X.fold_ligatures(F.lit("ﬁnd oﬃce "))) == "find office"
    assert value(spark, X.alnum_count(F.lit("a1-ß 日"))) == 4 and value(spark, X.alpha_count(F.lit("a1-ß"))) == 2
    assert value(spark, X.n_words(F.lit(" a b\x1cc "))) == 3


def test_nulls_stay_null(spark):
    none = F.lit(None).cast("string")
    for column in (X.strip(none), X.escape_start(none), X.safe_name(none), X.preview(none), X.glyph_size(none, F.lit(1.0)), X.header_key(none), X.join_lines(F.lit(None).cast("array<string>"), words(spark, "a"))):
        assert value(spark, column) is None
