import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from proseline.functions import cleaning
from proseline.functions import patterns as P
from proseline.functions.cleaning import TextCleaner
from proseline.functions.concat import TextConcatenator
from proseline.functions.html import html_to_text
from proseline.functions.patterns import Newlines, Separator
from proseline.functions.tokens import TokenCounter
from proseline.functions.urls import extract_urls
from proseline.operators import segments, splitting
from proseline.operators.chunking import TextChunker, chunk_rows, greedy_chunks, register_functions
from proseline.operators.sentences import split_text_into_sentences
from proseline.operators.splitting import TextSplitter
from proseline.plans.statistics import balance, chunk_sizes, chunk_statistics
from proseline.sources import files
from proseline.streaming import chunks as streaming

STORY = "Dr. A. B. Smith paid 3.50 dollars. He said \"No.\" It was 9 a.m. in the U.S.A. and all was well! Was it? (Yes.) The end came et al.. soon"
ODD = [None, "", " ", "\n\n", "a", "a\n\nb", " a \n\n b\n c \n", "x.\ny", "well-known fact", "(ACM) x !", "one — two …", "don't. Stop", "3.14 is e.g. pi", STORY, "He said 'no.' Then \"yes.\" (ok.) done", "Hall.[1] The", "what?! no", "... wait... go.", "日本語。 テキスト です。", "a\x85b\u2028c\u2029d", "C:\\new\\tab", "é\u0301👨\u200d👩\u200d👧 flag 🇩🇪", "\ta\xa0\u3000b [12][1234]", "mail2.example.com is up", "A. B. C.", "x .5 y", "end.) next. \"Q\" 'z.' w"]


def column(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("newlines", list(Newlines))
def test_cleaner_is_the_same_in_spark_and_in_python(spark, newlines):
    for ascii_only in (False, True):
        cleaner = TextCleaner(newlines, ascii_only, ascii_only)
        assert column(spark, ODD, cleaner.run) == [None if t is None else cleaner.run_text(t) for t in ODD]


@pytest.mark.parametrize(
    ("steps", "text", "want"),
    [
        (P.normalize_steps(), "a\t\xa0\\sb\\tc\u2028d\\ne\u2029f\\r\\ng\r\nh\x0bi\x0cj", "a   b c\nd\ne\n\nf\ng\nh\ni\nj"),
        (P.clean_steps(Newlines.SPACE), " a \n\n b\r\nc  d ", "a b c d"),
        (P.clean_steps(Newlines.SINGLE), "a\n\n\nb\nc", "a\nb\nc"),
        (P.clean_steps(Newlines.DOUBLE), "a\n\n\nb\nc", "a\n\nb\nc"),
        (P.clean_steps(Newlines.DOUBLE, True), "a/b+c=d € é ñ (x) [y] {z} 5% #1 <b> _u_", "abcd (x) [y] {z} 5% #1 b u"),
        (P.clean_steps(citations=True), "x [1] y [123] z [1234]", "x y z [1234]"),
        (P.strip_steps(), " \u3000é a é ", "a"),
        (P.single_whitespace_steps(), "  a   b\n\n\nc\t\td  ", "a b\nc\t\td"),
    ],
)
def test_cleaning_examples(spark, steps, text, want):
    assert cleaning.run_steps(text, tuple(steps)) == want
    assert column(spark, [text], lambda c: cleaning.apply_steps(c, steps)) == [want]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\\rn\x0b\xa0\u2028.é", max_size=40))
def test_cleaning_again_changes_little(text):
    once = TextCleaner(Newlines.SPACE).run_text(text)
    assert once == once.strip(P.WHITE_SPACE_CHARS) and "  " not in once and "\n" not in once


@pytest.mark.parametrize("separator", list(Separator))
def test_columns_and_tasks_split_alike(spark, separator):
    got = column(spark, ODD, lambda c: splitting.pieces(c, separator))
    want = [None if t is None else [t[a:b] for a, b in segments.ranges(t, separator)] for t in ODD]
    assert [g and list(g) or ([] if g is not None else None) for g in got] == want
    offsets = column(spark, ODD, lambda c: splitting.split_indices(c, separator))
    assert [o if o is None else [t.encode()[r.start : r.end].decode() for r in o] for t, o in zip(ODD, offsets, strict=True)] == want


def test_sentences_by_rules(spark):
    clean = "The A. M. Turing Award is given. It has 1.5 million dollars (since 2014). Who won it? Ada did. Then Bob!"
    assert [clean[a:b] for a, b in segments.ranges(clean, Separator.SENTENCES_RULE)] == ["The A. M. Turing Award is given.", "It has 1.5 million dollars (since 2014).", "Who won it?", "Ada did.", "Then Bob!"]
    for broken in ("See example.com. Next", "Hall.[1] The", "Really?! Yes.", "Wait!! Go."):
        assert segments.ranges(broken, Separator.SENTENCES_RULE) == []
    assert column(spark, ODD, split_text_into_sentences) == [t if t is None else segments.rule_sentences(t) for t in ODD]
    assert segments.rule_sentences("Hello. World?! Next.") == ["Hello. ", "! ", "Next."]


def test_unicode_sentences_equal_the_library(spark):
    """Spark ships ICU; its break iterator is the judge."""
    iterator = spark._jvm.com.ibm.icu.text.BreakIterator.getSentenceInstance(spark._jvm.com.ibm.icu.util.ULocale.ROOT)
    for text in [t for t in ODD if t] + [STORY.replace(" ", "\n", 3), "U.S. is. it? \"Go!\" he said. 5.5 x.y Z.A b.", "e.g. this. And. that, (so.) Yes"]:
        iterator.setText(text)
        units, cuts = text.encode("utf-16-le"), [0]
        while (at := iterator.next()) != -1:
            cuts.append(len(units[: 2 * at].decode("utf-16-le")))
        assert segments.unicode_sentence_ranges(text) == list(zip(cuts, cuts[1:])), text


def test_words():
    split = lambda t: [t[a:b] for a, b in segments.ranges(t, Separator.WORDS)]
    assert split("The so-called 'Computing'. (ACM) — 79! ends …") == ["The", "so-called", "'Computing'.", "(ACM)", "79!", "ends …"]
    assert split("(ACM) x") == ["ACM)", "x"] and split("well-known fact") == ["known", "fact"]
    assert split("— …") == [] and split("mail2.example.com up") == ["example.com", "up"]


def test_recursion_and_splitting_again(spark):
    texts = ["a b\n\nc d", "a b\nc d", "One is. Two is.", "one two", "ab", "a", None, "Dr.X is. Two is here."]
    used = column(spark, texts, lambda c: TextSplitter().split(c)["separator"])
    assert used == ["two_plus_newline", "single_newline", "sentences_rule_based", "words_unicode", "graphemes_unicode", None, None, "sentences_unicode"]
    assert column(spark, texts, lambda c: TextSplitter(recursive=False).split_text(c))[1] is None
    rows = splitting.split_rows(spark.createDataFrame([("a b\n\nc",)], "t string"), "t", TextSplitter(), [])
    again = rows.select("split_idx", splitting.split_again(F.col("text"), Separator.PARAGRAPHS).alias("x")).orderBy("split_idx").collect()
    assert [r.x and (r.x.separator, list(r.x.texts)) for r in again] == [("words_unicode", ["a", "b"]), None]
    assert column(spark, ["ab"], lambda c: splitting.split_again(c, Separator.GRAPHEMES)) == [None]


def test_uncleaned_text_keeps_its_end(spark):
    assert column(spark, [" a \n b \n c \n "], lambda c: splitting.pieces(c, Separator.LINES)) == [["a", "b", "c"]]
    assert column(spark, [" a \n b  "], lambda c: splitting.pieces(c, Separator.LINES)) == [["a", "b  "]]


def test_joining(spark):
    parts = F.array(F.lit("a"), F.lit("b"))
    join = lambda s, w: spark.range(1).select(splitting.splits_to_text(parts, s, w).alias("x")).first().x
    assert [join(s, False) for s in Separator] == ["a b"] * 5 + ["ab"]
    assert [join(s, True) for s in Separator] == ["a\n\nb\n\n", "a\nb\n", "a b", "a b", "a b", "ab"]


def test_separators():
    assert [s.next() for s in Separator] == [*list(Separator)[1:], None]
    assert Separator.chunking_order() == list(Separator)[:5]
    assert P.group_members("syntactic") == [Separator.WORDS, Separator.GRAPHEMES]


def test_concatenation(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, "c")], "k int, o int, t string")
    for joiner, mark in ((TextConcatenator(), "\n"), (TextConcatenator().concate_deol(), "\n\n"), (TextConcatenator().concate_space(), " "), (TextConcatenator().concate_comma(), ", "), (TextConcatenator().concate_custom("#"), "#")):
        out = {r.k: r.x for r in df.groupBy("k").agg(joiner.join_group(F.col("t"), F.col("o")).alias("x")).collect()}
        assert out == {1: f"a{mark}b", 2: "c"}


def test_urls(spark):
    text = "see http://Example.COM, (https://a.org/x_(y)), <ftp://f.net:21/z>. and https://a.org/x_(y) again; mail a@b.c www.no.scheme HTTP://h.x:80?q=1! http:// x://"
    assert column(spark, [text, None, ""], extract_urls) == [["http://example.com/", "https://a.org/x_(y)", "ftp://f.net/z", "http://h.x/?q=1"], None, []]


def test_html():
    page = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>One &amp; two<br>three<p>Four <b>bold</b></article><div class='sidebar'>ads</div><footer>foot</footer></body></html>"
    assert html_to_text(page) == "Head\n\nOne & two\nthree\n\nFour bold"
    assert html_to_text("<div><p>" + "long enough text, with commas, to be the content of a page. " * 3 + "</p></div><div><a href=1>x</a></div>").startswith("long enough")
    assert html_to_text("") is None and html_to_text(None) is None and html_to_text("plain") == "plain"
    assert "td>" not in html_to_text("<p>a<<b></i></p><table><tr><td>1<td>2</table>" * 50)


def test_token_counters(spark):
    assert column(spark, ["a b\u3000c", "", None], TokenCounter().count) == [3, 0, None]
    bpe = TokenCounter.default()
    if bpe.kind == "bpe":
        assert column(spark, ["One one one one.", None], bpe.count) == [5, None]
    with pytest.raises(ValueError, match="no counter"):
        TokenCounter("x")
    with pytest.raises(ValueError, match="vocabulary"):
        TokenCounter("bpe")


WS = TokenCounter()
LINES = "\n".join([" ".join(["w"] * 25)] * 4)


def test_chunks_of_whole_pieces_and_linear():
    text = "One one one one one.\n\nTwo two two two two.\n\n\nThree three three three three."
    for whole in (True, False):
        assert TextChunker(5, use_whole_pieces=whole, counter=WS).run_text(text)[1] == ["One one one one one.", "Two two two two two.", "Three three three three three."]


def test_overlap_example():
    text = "\n\n".join(" ".join([w] * 10) for w in ("one", "two", "three"))
    want = [" ".join(["one"] * 10 + ["two"] * 2), " ".join(["one"] + ["two"] * 10 + ["three"]), " ".join(["two"] * 2 + ["three"] * 10)]
    assert TextChunker(12, counter=WS).with_overlap(0.166666).run_text(text)[1] == want


def test_small_texts_stay_as_they_are():
    assert TextChunker(10, counter=WS).run_text(" a \n\n b ") == (None, [" a \n\n b "])
    assert TextChunker(10, counter=WS).run_text("") == (None, [""])


def test_limits_options():
    with pytest.raises(ValueError, match="max_tokens"):
        TextChunker(0)
    with pytest.raises(ValueError, match="max_tokens"):
        TextChunker(10, min_tokens=10)
    assert [float(TextChunker(10).with_overlap(x).overlap) for x in (0.2, 0.6, 0.001)] == pytest.approx([0.2, 0.1, 0.1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "c.", "d!", "\n", "\n\n", "well-known", "E.", "x\ny", "long" * 9]), max_size=300), st.integers(4, 40), st.sampled_from([None, 0.1, 0.25]))
def test_chunks_keep_the_limit_and_all_words(words, limit, overlap):
    text = " ".join(words)
    found = TextChunker(limit, counter=WS).with_overlap(overlap).run_text(text)
    if found and found[0]:
        count = WS.counter()
        assert all(count(c) <= limit for c in found[1])
        if overlap is None and found[0] != "words_unicode":
            assert "".join("".join(found[1]).split()) == "".join(segments.clean_for(text, Separator(found[0])).split())


def test_chunk_rows_statistics_and_sql(spark):
    df = spark.createDataFrame([(1, LINES), (2, "short"), (3, None), (4, "")], "id int, t string")
    rows = chunk_rows(df, "t", TextChunker(30, counter=WS), ["id"])
    assert sorted({r.id for r in rows.collect()}) == [1, 2, 3, 4]
    assert [tuple(r) for r in rows.where("id = 3").collect()] == [(3, None, None, None, None, None)]
    one = chunk_statistics(rows, ["id"]).where("id = 1").first()
    assert (one.chunk_count, one.all_chunks_token_count, one.largest_token_size) == (4, 100, 25)
    assert balance(rows, ["id"]).where("id = 1").first().avg_token_size == 25
    assert chunk_sizes(rows, ["id"]).where("id = 1").first().chunk_token_sizes == [25] * 4
    register_functions(spark, WS)
    df.createOrReplaceTempView("texts")
    assert spark.sql("SELECT id, c.* FROM texts, LATERAL chunk_text(t, 30) c WHERE id = 1").count() == 4
    assert spark.sql("SELECT clean_text(concat('a', chr(13), chr(10), chr(10), chr(10), '  b')) AS x").first().x == "a\n\n b"
    assert spark.sql("SELECT count_tokens('a b c') AS x").first().x == 3
    assert [len(c.split()) for c in greedy_chunks("w " * 25 + "x", 10, WS.counter())] == [10, 10, 6]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one\ntwo ")
    (tmp_path / "b.json").write_text(json.dumps({"content": "c", "cases": ["x", "y"]}, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"content": "c", "test_cases": {"case_64": {"first": "f"}}}, indent=1))
    (tmp_path / "d.txt").write_text(" \n ")
    (tmp_path / "e.json").write_text("{nonsense")
    assert [tuple(r) for r in files.read_texts(spark, str(tmp_path / "a.txt")).collect()] == [("a", " one\ntwo ")]
    assert files.read_split_cases(spark, str(tmp_path / "b.json")).first().cases == ["x", "y"]
    assert files.read_chunk_cases(spark, str(tmp_path / "c.json")).select(files.chunk_case(64).alias("x")).first().x.first == "f"
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_texts(spark, str(tmp_path / "d.txt")).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_split_cases(spark, str(tmp_path / "e.json")).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_texts(spark, str(tmp_path / "none.txt")).collect()
    with pytest.raises(ValueError, match="no case"):
        files.chunk_case(65)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(LINES)
    rows = streaming.chunk_stream(streaming.read_text_stream(spark, str(tmp_path / "in")), "text", TextChunker(30, counter=WS), ["name"], TextCleaner(Newlines.KEEP))
    streaming.write_parquet_stream(rows, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_a_part_is_split_in_place(spark):
    df = spark.createDataFrame([("é one\n two \nthree", 3, 15), ("é", 1, 2), ("ab", 0, 9), (None, 0, 1), ("a\nb", 0, 3)], "t string, a int, b int")
    out = [r.x for r in df.select(splitting.split_part(F.col("t"), F.col("a"), F.col("b"), Separator.LINES).alias("x")).collect()]
    assert [x and [tuple(r) for r in x] for x in out] == [[(3, 6), (8, 11), (13, 15)], None, None, None, [(0, 1), (2, 3)]]


def test_long_texts_take_time_in_proportion(spark):
    import time

    texts = ["x" * 1_000_000, "a" + "\n" * 1_000_000 + "b", "é" * 300_000 + "... " * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3).cache()
    df.count()
    for make in (lambda c: F.size(splitting.pieces(c, Separator.WORDS)), lambda c: F.char_length(TextCleaner(Newlines.KEEP).run(c)), lambda c: F.size(splitting.pieces(c, Separator.LINES))):
        began = time.time()
        df.select(make(F.col("t")).alias("x")).collect()
        assert time.time() - began < 20
