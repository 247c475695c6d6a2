import hashlib
import re
import string
import unicodedata

import pytest
from pyspark.sql import functions as F

from fabula.functions import text as X

SPACES = [chr(i) for i in range(0x10000) if chr(i).isspace()]


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression("t")).collect()]


def test_white_space_is_pythons(spark):
    assert len(SPACES) == 29
    texts = [f"{s}a{s}{s}b{s}" for s in SPACES] + ["​a​", "", " ", "a"]
    assert column(spark, texts, X.normalize) == [" ".join(t.split()) for t in texts]
    assert column(spark, texts, X.strip) == [t.strip() for t in texts]
    assert column(spark, texts, X.rstrip) == [t.rstrip() for t in texts]


def test_dialogue_opens_a_line(spark):
    texts = [f"{s}— Oui" for s in SPACES] + [f"a\n{s}— Oui" for s in SPACES] + ["a — b", "- Oui", "« Oui »", "", "a\r— b", "a\n\n—"]
    want = [any(line.strip().startswith("—") for line in t.split("\n")) for t in texts]
    assert column(spark, texts, X.has_dialogue) == want
    assert True in want and False in want


def test_chapter_heading(spark):
    texts = ["Chapitre I", "CHAPITRE premier", " chapitre dixième\n", "Chapitre 1", "Chapitre", "Chapitre I bis", "Chapitre\nI", "Le chapitre I", "Chapitre é_9"]
    heading = re.compile(r"Chapitre \w+", re.IGNORECASE)
    assert column(spark, texts, X.is_chapter_heading) == [bool(heading.fullmatch(t.strip())) for t in texts]


def test_sentence_end(spark):
    ends = set(string.punctuation) | {"…", "»"}
    texts = ["", "  ", "Chapitre I", "Fin. ", "x”", "x’", "x—", "a\nb"] + [f"x{c}" for c in ends]
    want = [s if not (s := t.rstrip()) or s[-1] in ends else s + "." for t in texts]
    assert column(spark, texts, X.sentence_end) == want
    assert len(ends) == 34


def test_hashes(spark):
    assert column(spark, ["é"], X.passage_hash) == [hashlib.sha256("é".encode()).hexdigest()]
    rows = [("Oui.", "Ryan", None, True), ("Oui.", "Ryan", "", True), ("Oui.", "Serena", None, True), ("Oui.", "Ryan", "x", True), ("Oui.", "Ryan", None, False)]
    df = spark.createDataFrame(rows, "t string, v string, i string, n boolean")
    got = [r[0] for r in df.select(X.chunk_hash("t", "v", "i", "n")).collect()]
    assert got == [hashlib.sha256(f"{t}\0{v}\0{i or ''}\0{int(n)}".encode()).hexdigest() for t, v, i, n in rows]
    assert got[0] == got[1] and len(set(got)) == 4


@pytest.mark.parametrize(("path", "slug"), [("/x/Les Misérables Tome I.epub", "les_mis_rables_tome_i"), ("a.b.epub", "a_b"), ("…", "book"), (".epub", "epub"), ("/d.x/Book", "book")])
def test_book_slug(spark, path, slug):
    assert column(spark, [path], X.book_slug) == [slug]


def test_title_slug(spark):
    titles = ["Monsieur Myriel", "L'Évêque—là", "Œuvre Île ½ ①", "", None]
    plain = [None if t is None else re.sub(r"[^a-zA-Z0-9]+", "_", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()).strip("_").lower() for t in titles]
    assert column(spark, titles, lambda t: X.title_slug(F.col(t))) == plain
    assert column(spark, [""], lambda t: X.chapter_filename(F.lit(3), F.col(t))) == ["chapitre_03_.wav"]


def test_messages(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "b")], "t string, p string")
    first, second, third = (r[0] for r in df.select(X.user_message("t", "p")).collect())
    assert first == second == "a" and "b" in third and third.endswith("a")
    rosters = spark.createDataFrame([(["x", "y"],), ([],)], "r array<string>").select(X.roster_text("r")).collect()
    assert [r[0] for r in rosters] == ["x, y", "(none yet)"]
