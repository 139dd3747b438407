import pytest
from pyspark.sql import functions as F

from glyphmill.functions import codec, markup
from glyphmill.sources import formats


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first()[0]


def tokens(tt):
    return [codec.ALPHABET.index(c) for c in tt]


def test_encode(spark):
    assert tokens(one(spark, "aZ -_,.éÉß1'", codec.encode_all)) == [1, 26, 27, 27, 27, 27, 62, 28, 28, 46, 63, 63]
    assert tokens(one(spark, "ẞù", codec.encode_all)) == [63, 63]


@pytest.mark.parametrize("text, plain", [("a\t\n b", " a b "), ("a b", " ab "), ("don't", " dont "), ("a 1 b", " a  b "), (None, "  ".replace("  ", " "))])
def test_stream(spark, text, plain):
    got = one(spark, text, lambda c: codec.decode(codec.stream(c)))
    assert got == plain or (text is None and got.strip() == "")


def test_pack(spark):
    assert one(spark, "01", codec.packed) == 66  # a, b
    assert one(spark, "01", lambda c: codec.unpacked(codec.packed(c))) == "01"
    assert formats.pack_word("".join(codec.ALPHABET[t] for t in (1, 2, 3, 4))) == bytes([0x04, 0x20, 0xC4])
    assert formats.packed_length(5) == 4
    assert formats.unpack_word(formats.pack_word("0az9"), 4) == "0az9"


def test_seven_bit(spark):
    assert one(spark, "a\té~\x01", codec.seven_bit) == "a \x7f~\x7f"


def test_markup(spark):
    assert one(spark, 'x<doc id="1">a<b>b</b></doc>c', markup.strip_markup) == " abc"
    assert one(spark, 'x<doc id="1">a<b>b</b></doc>c', lambda c: markup.strip_markup(c, strict_end=True)) == " ab "
    assert one(spark, "no tag", markup.strip_markup) == ""
    assert one(spark, "<doc>a", markup.strip_markup) == ""
    assert one(spark, "<DOC x>a<b", markup.strip_markup) == " a"
    assert one(spark, 'a <doc x>b < c <doc y>d', markup.strip_markup) == " b d"


def test_input_words(spark):
    got = one(spark, "I would like to walkX my dog!", markup.input_words)
    assert [r["word"] for r in got] == ["I", "would", "like", "to", "walkX", "my", "dog"]
    assert (got[4]["start"], got[4]["end"]) == (16, 21)
    assert one(spark, "", markup.input_words) == []


def test_links(spark):
    assert one(spark, '<a href="20240101/"><a href="20250101/">', markup.dump_dates) == ["20240101", "20250101"]
    assert one(spark, '<a href="/x/y-pages-articles-multistream.xml.bz2">', markup.article_dump) == "y-pages-articles-multistream.xml.bz2"
    assert one(spark, "none", markup.article_dump) is None


def test_seven_bit_tokens(spark):
    d = spark.createDataFrame([("a\tZ~é ",), ("",)], "text string").select(codec.seven_bit_tokens(F.col("text")).alias("t"))
    got = d.select("t", codec.seven_bit_text(F.col("t")).alias("s")).collect()
    assert [(r["t"], r["s"]) for r in got] == [([66, 1, 59, 95, 127, 1], "a Z~? "), ([], "")]
    for bad in (0, 96):
        with pytest.raises(Exception, match="not a token"):
            spark.range(1).select(codec.seven_bit_text(F.array(F.lit(bad)))).collect()
    with pytest.raises(Exception, match="not a word"):
        spark.range(1).select(codec.validated(F.lit("0Q1"))).collect()


def test_strict_utf8(spark, tmp_path):
    from glyphmill.sources import formats

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.txt").write_bytes("é\U0001f600".encode())
    assert [r["text"] for r in formats.read_corpus(spark, str(tmp_path)).collect()] == ["é\U0001f600"]
    (tmp_path / "a" / "y.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="not UTF-8"):
        formats.read_corpus(spark, str(tmp_path)).collect()
