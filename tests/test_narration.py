import json
import os
import sys
import wave
from dataclasses import replace

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fabula import schemas
from fabula.functions import text as X
from fabula.operators import annotate, assemble, cast, chunk, resume, structure, synth
from fabula.plans import narrate
from fabula.sources import audio, cache, config, epub

# workers can't import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESOLVED = "book_id string, chapter_number int, line_idx int, text string, is_narrator boolean, voice string, instruct string, role string"


def lines_table(spark, rows):
    return spark.createDataFrame([("b", 1, i, *r) for i, r in enumerate(rows)], RESOLVED)


def narrator(text, instruct=None, voice="Ryan"):
    return (text, True, voice, instruct, "narrator")


def speech(text, voice="Serena", role="adult_female"):
    return (text, False, voice, "warm", role)


def chunks(spark, rows):
    return chunk.merge_chunks(lines_table(spark, rows), "cache").orderBy("chunk_idx").collect()


def test_worked_example(spark):
    got = chunks(spark, [narrator("Chapter X"), narrator("Sub-title"), narrator("Paragraph 1."), narrator("Paragraph 2:"), speech("Dialog 1"), speech("Dialog 2."), narrator("Paragraph 3.")])
    assert [c.text for c in got] == ["Chapter X. Sub-title. Paragraph 1. Paragraph 2:", "Dialog 1.", "Dialog 2.", "Paragraph 3."]
    assert [c.role for c in got] == ["narrator", "adult_female", "adult_female", "narrator"]
    assert [c.chunk_idx for c in got] == [0, 1, 2, 3]
    assert got[0].audio_path == f"cache/chapter_01/chunk_narrator_{got[0].content_hash}.wav"


def test_last_line_decides_and_empty_segments_stay(spark):
    (got,) = chunks(spark, [narrator("", "x", "A"), narrator("b", None, "B")])
    assert (got.text, got.voice, got.instruct, got.n_lines) == (" b.", "B", None, 2)
    assert chunks(spark, []) == []


@pytest.mark.parametrize(("gender", "child", "narrates", "role"), [("male", False, True, "narrator"), ("female", True, True, "narrator"), ("male", True, False, "child"), ("female", True, False, "child"), ("male", False, False, "adult_male"), ("female", False, False, "adult_female")])
def test_roles(spark, gender, child, narrates, role):
    df = spark.createDataFrame([("x", gender, child, narrates)], "speaker string, speaker_gender string, speaker_is_child boolean, is_narrator boolean")
    assert cast.assign_voices(df).first()["role"] == role
    pinned = spark.createDataFrame([("x", "Aiden"), ("X", "Dylan")], "speaker string, voice string")
    assert cast.assign_voices(df, pinned).first()["voice"] == "Aiden"


def test_instruct_of_narrators_is_the_chapters(spark):
    rows = [("N", "male", False, True, "own", "calm"), ("S", "male", False, False, "own", "calm")]
    df = spark.createDataFrame(rows, "speaker string, speaker_gender string, speaker_is_child boolean, is_narrator boolean, instruct string, tone string")
    assert {r.speaker: r.instruct for r in cast.resolve_lines(df).collect()} == {"N": "calm", "S": "own"}
    assert {r.speaker: r.instruct for r in cast.resolve_lines(df, tone=None).collect()} == {"N": None, "S": "own"}


def test_config_files(spark, tmp_path):
    assert config.voice_config(spark, str(tmp_path / "none.json")) == cast.DEFAULT_VOICES
    path = tmp_path / "voices.json"
    for text, want in (("{}", {}), ('{"adult_female": "Vivian", "other": "x"}', {"adult_female": "Vivian"}), ("null", {}), ('{"child": null}', {"child": None})):
        path.write_text(text)
        assert config.voice_config(spark, str(path)) == {**cast.DEFAULT_VOICES, **want}
    (tmp_path / "cast.json").write_text('{"Marc": "Aiden", "Narrator": "Dylan"}')
    assert {r.speaker: r.voice for r in config.overrides(spark, str(tmp_path / "cast.json")).collect()} == {"Marc": "Aiden", "Narrator": "Dylan"}
    assert config.overrides(spark, str(tmp_path / "none.json")).count() == 0


# ---- books ------------------------------------------------------------------------

PAIRS = [
    ("one.xhtml", "<html><body><h1>Livre</h1><p>avant</p><h2>Chapitre I</h2><p>table</p><h2>Chapitre I</h2><h3>Le Matin</h3><p>Un  deux</p><p>dit-il :\n  — Bonjour.</p><p> </p><h4>Note</h4></body></html>"),
    ("two%20b.xhtml", "<html><body><p>suite</p><h2>Livre II</h2><h3>x</h3><h2>Chapitre II</h2><h3>Le Soir</h3><p>a</p><p>b</p><p>c</p></body></html>"),
]
NAV = "<html><body><nav><h2>Léa et Marc</h2><h2>Chapitre I</h2><h3>nav</h3></nav></body></html>"
SECTIONS = [
    ("p.xhtml", '<html><body><section epub:type="preface"><h1>Préface</h1><p>non</p></section></body></html>'),
    ("1.xhtml", '<html><body><section class="c" epub:type="chapter"><h1>1</h1><div><p>a</p><p>— b</p><p>c</p></div></section></body></html>'),
    ("2.xhtml", '<html><body><section epub:type="chapter"><h2>2</h2><h3> Deux  mots</h3><h4>perdu</h4><p>d</p><p>\n</p></section><section epub:type="chapter"><p>sans titre</p></section></body></html>'),
]


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    pairs = [(n.replace("%20", " "), m) for n, m in PAIRS]
    data = epub.pack_book("pairs", PAIRS, NAV)
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(folder / "Deux Tomes.epub", "w") as new:
        for n in old.namelist():
            new.writestr(n.replace("%20", " "), old.read(n))
    assert pairs
    (folder / "sections.epub").write_bytes(epub.pack_book("sections", SECTIONS, NAV))
    return str(folder)


def test_chapters_by_heading_pairs_and_sections(spark, shelf):
    chapters, body = structure.read_structure(epub.read_books(spark, shelf))
    got = {(r.book_id, r.chapter_number): (r.heading, r.title) for r in chapters.collect()}
    assert got == {
        ("deux_tomes", 1): ("Chapitre I", "Le Matin"), ("deux_tomes", 2): ("Chapitre II", "Le Soir"),
        ("sections", 1): ("1", ""), ("sections", 2): ("2", "Deux mots"), ("sections", 3): ("", ""),
    }
    texts: dict = {}
    for r in body.orderBy("body_idx").collect():
        texts.setdefault((r.book_id, r.chapter_number), []).append((r.text, r.has_dialogue))
    assert texts["deux_tomes", 1] == [("Un deux", False), ("dit-il : — Bonjour.", True), ("Note", False), ("suite", False), ("Livre II", False), ("x", False)]
    assert texts["deux_tomes", 2] == [("a", False), ("b", False), ("c", False)]
    assert texts["sections", 1] == [("a", False), ("— b", True), ("c", False)]
    assert texts["sections", 2] == [("d", False)]
    assert {r.book_id: r.n_chapters for r in structure.count_chapters(chapters).collect()} == {"deux_tomes": 2, "sections": 3}
    with pytest.raises(ValueError, match="3 chapter boundaries detected in sections"):
        structure.one_chapter(chapters.where("book_id = 'sections'"), 4)
    assert [(r.book_id, r.heading) for r in structure.one_chapter(chapters, 2).orderBy("book_id").collect()] == [("deux_tomes", "Chapitre II"), ("sections", "2")]
    passages = structure.narration_passages(chapters, body).where("book_id = 'sections' and chapter_number > 1").orderBy("chapter_number", "passage_idx").collect()
    assert [(p.passage_idx, p.part, p.text) for p in passages] == [(0, "heading", "2"), (1, "title", "Deux mots"), (2, "body", "d"), (0, "heading", ""), (1, "body", "sans titre")]


def test_markup_is_tolerant():
    found = [(tag, text) for _, _, _, tag, text in epub.markup_elements("<body><p>a<p>b<br>c</p><script>x</script><h6>d<rt>r</rt></h6>")]
    assert found == [("p", "abcd"), ("p", "bc"), ("h6", "d")]
    assert list(epub.markup_elements("<p>no body</p>")) == []


def test_tone_sample(spark):
    chapters = spark.createDataFrame([("b", 1, "H", ""), ("b", 2, "H2", "T")], "book_id string, chapter_number int, heading string, title string")
    rows = [("b", 1, i, f"Paragraph {i}" if i else "x" * 5000, False) for i in range(10)]
    body = spark.createDataFrame(rows, "book_id string, chapter_number int, body_idx int, text string, has_dialogue boolean")
    got = {r.chapter_number: r.sample for r in structure.tone_samples(chapters, body).collect()}
    assert got == {1: "\n".join(["H", "", "x" * 800, *(f"Paragraph {i}" for i in range(1, 5))]), 2: "H2\nT"}


# ---- annotation and resuming -------------------------------------------------------


class Recorder(annotate.RuleProvider):
    def __init__(self, folder):
        self.folder = str(folder)

    def annotate(self, text, roster, preceding):
        with open(os.path.join(self.folder, "calls"), "a") as f:
            f.write(json.dumps([text, roster, preceding]) + "\n")
        return super().annotate(text, roster, preceding)

    def calls(self):
        path = os.path.join(self.folder, "calls")
        found = [json.loads(x) for x in open(path)] if os.path.exists(path) else []
        if found:
            os.remove(path)
        return found


def passages(spark, texts):
    return spark.createDataFrame([("b", 1, i, t, "—" in t) for i, t in enumerate(texts)], "book_id string, chapter_number int, passage_idx int, text string, has_dialogue boolean")


def test_context_and_resume(spark, tmp_path):
    provider = Recorder(tmp_path)
    texts = ["Chapitre I", "dit-il — Oui — Non", "Il part.", "— Adieu", "Fin."]
    empty = spark.createDataFrame([], schemas.ANNOTATION_CACHE)
    done = annotate.annotate_chapters(resume.with_cache(passages(spark, texts), empty), provider).persist()
    rows = {r.passage_idx: r for r in done.collect()}
    calls = provider.calls()
    assert [(c[0], c[2]) for c in calls] == [(texts[1], "Chapitre I"), (texts[3], "Il part.")]
    assert calls[0][1] == ["Narrator"] and calls[1][1] == rows[1].roster
    assert rows[0].roster == ["Narrator"] and len(rows[1].lines) == 3
    lines = annotate.exploded_lines(done)
    running = annotate.running_roster(lines, ("book_id", "chapter_number"), "line_idx", name="r").groupBy("passage_idx").agg(F.max_by("r", "line_idx").alias("r")).collect()
    assert {x.passage_idx: x.r for x in running} == {k: r.roster for k, r in rows.items()}

    # nothing is asked again; a change in the middle is, and all after it
    again = resume.with_cache(passages(spark, texts), done)
    assert resume.first_pending(again).first().first_pending is None
    assert sorted(annotate.annotate_chapters(again, provider).collect()) == sorted(done.collect()) and not provider.calls()
    changed = resume.with_cache(passages(spark, [*texts[:2], "Il reste.", *texts[3:]]), done)
    pending = resume.first_pending(changed)
    assert pending.first().first_pending == 2
    assert sorted(r.passage_idx for r in resume.invalidate(done, pending).collect()) == [0, 1]
    assert resume.roster_at_resume(done, pending).first().roster == rows[1].roster
    new = {r.passage_idx: r for r in annotate.annotate_chapters(changed, provider).collect()}
    assert [c[0] for c in provider.calls()] == [texts[3]] and new[2].lines[0].text == "Il reste."


def test_providers_answers_are_checked():
    good = annotate.RuleProvider().annotate("— Oui", [], None)["lines"][0]
    assert annotate.check_annotation({"lines": [good]})
    for bad in ({}, {"lines": []}, {"lines": [{k: v for k, v in good.items() if k != "instruct"}]}, {"lines": [{**good, "speaker_gender": "x"}]}):
        with pytest.raises(annotate.AnnotationError):
            annotate.check_annotation(bad)

    class Flaky(annotate.RuleProvider):
        n = 0

        def annotate(self, *args):
            self.n += 1
            if self.n < self.fails:
                raise OSError("no")
            return super().annotate(*args)

    flaky = Flaky()
    flaky.fails = 2
    assert annotate.annotate_one(flaky, "— Oui", [], None)
    flaky.n, flaky.fails = 0, 3
    with pytest.raises(annotate.AnnotationError, match="2 times"):
        annotate.annotate_one(flaky, "— Oui", [], None)


def test_answers_in_json(spark):
    lines = annotate.RuleProvider().annotate("a — Oui", [], None)["lines"]
    df = spark.createDataFrame([(annotate.to_answer(lines),)], "a string")
    assert [x.asDict() for x in df.select(annotate.parse_answer("a").alias("l")).first().l] == lines
    with pytest.raises(Exception, match="doesn't hold"):
        spark.createDataFrame([('{"lines": []}',)], "a string").select(annotate.parse_answer("a")).collect()


def test_tones_are_asked_once(spark):
    samples = spark.createDataFrame([("b", 1, "x"), ("b", 2, "xy")], "book_id string, chapter_number int, sample string")
    known = spark.createDataFrame([("b", 1, "cached")], schemas.TONE_CACHE)
    assert {r.chapter_number: r.instruct for r in annotate.tones(samples, known, annotate.RuleProvider()).collect()} == {1: "cached", 2: "Read briskly."}


def test_cache_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    assert cache.read(spark, root, "tones").count() == 0
    cache.commit(spark.createDataFrame([("b", 1, "x")], schemas.TONE_CACHE), root, "tones")
    cache.commit(cache.read(spark, root, "tones").withColumn("instruct", F.lit("y")), root, "tones")
    assert [tuple(r) for r in cache.read(spark, root, "tones").collect()] == [("b", 1, "y")]


def test_jobs_are_left_once(spark):
    got = chunk.merge_chunks(lines_table(spark, [speech("Oui"), speech("Oui"), speech("Non")]), "c").persist()
    there = got.where("text = 'Non.'").select("audio_path")
    assert [r.chunk_idx for r in resume.pending_jobs(got, there).collect()] == [0]


# ---- sound -------------------------------------------------------------------------


def test_assembly(spark, tmp_path):
    paths = []
    for k, n in enumerate((100, 50, 70)):
        paths.append(str(tmp_path / f"{k}.wav"))
        audio.write_wav(paths[-1], np.full(n, 0.5, np.float32))
    rows = [("b", 1, "one.wav", k, p) for k, p in reversed(list(enumerate(paths)))] + [("b", 2, "none.wav", None, None)]
    df = spark.createDataFrame(rows, "book_id string, chapter_number int, filename string, chunk_idx int, audio_path string")
    done = {r.chapter_number: r for r in assemble.assemble_chapters(df, str(tmp_path / "out")).collect()}
    assert done[1].n_samples == 220 + 2 * 16800 and done[2].n_samples == 0
    sound = audio.read_wav(done[1].path)
    assert abs(sound[100 + 16800] - 0.5) < 1e-3 and sound[100] == 0
    sized = spark.createDataFrame([("b", 1, 0, 100), ("b", 1, 1, 50), ("b", 1, 2, 70)], "book_id string, chapter_number int, chunk_idx int, n_samples long")
    assert [r.start_sample for r in assemble.timeline(sized).orderBy("chunk_idx").collect()] == [0, 16900, 33750]
    with pytest.raises(ValueError):
        audio.read_wav(paths[0], 16000)


def test_run_and_resume(spark, shelf, tmp_path):
    s = narrate.Settings(books=shelf, work=str(tmp_path / "w"), output=str(tmp_path / "o"), voices=str(tmp_path / "v"), cast=str(tmp_path / "c"), provider=Recorder(tmp_path), voice=synth.ToneVoice())
    first = narrate.run(spark, s).collect()
    assert len(first) == 5 and len(s.provider.calls()) == 2
    with wave.open(first[0].path) as f:
        assert f.getnframes() == first[0].n_samples > 0
    assert narrate.run(spark, s).count() == 0 and not s.provider.calls()
    os.remove(first[0].path)
    before = {p: os.stat(p).st_mtime_ns for d, _, n in os.walk(tmp_path / "w/audio-tone") for p in (os.path.join(d, x) for x in n)}
    again = narrate.run(spark, s).collect()
    assert [r.path for r in again] == [first[0].path] and not s.provider.calls()
    assert before == {p: os.stat(p).st_mtime_ns for d, _, n in os.walk(tmp_path / "w/audio-tone") for p in (os.path.join(d, x) for x in n)}


class Counting(synth.ToneVoice):
    def __init__(self, folder):
        self.folder = str(folder)

    def speak(self, *args):
        with open(os.path.join(self.folder, "spoken"), "a") as f:
            f.write(args[1] + "\n")
        return super().speak(*args)

    def spoken(self):
        path = os.path.join(self.folder, "spoken")
        found = open(path).read().splitlines() if os.path.exists(path) else []
        if found:
            os.remove(path)
        return found


def test_relative_folders_find_their_audio(spark, shelf, tmp_path):
    # relative to where the session began
    base = os.path.relpath(tmp_path)
    said = []
    s = narrate.Settings(books=shelf, work=f"{base}/w", output=f"{base}/o", voices=f"{base}/v", cast=f"{base}/c", provider=Recorder(tmp_path), voice=Counting(tmp_path), say=said.append)
    first = narrate.run(spark, s).collect()
    assert len(first) == 5 and s.voice.spoken() and s.provider.calls()
    assert any(x.startswith("deux_tomes: 2 chapters, 0") for x in said) and "chapters written: 5" in said
    for r in first:
        os.remove(r.path)
    said.clear()
    # the chapters are put together again from what is there: no call of a model, and no job
    assert len(narrate.run(spark, s).collect()) == 5
    assert not s.provider.calls() and not s.voice.spoken()
    assert any(x.endswith(" 0 of them to synthesize") for x in said)


class Failing(Recorder):
    def annotate(self, text, roster, preceding):
        found = super().annotate(text, roster, preceding)
        if self.fails in text:
            raise OSError("no answer")
        return found


def test_a_failing_chapter_keeps_the_others(spark, shelf, tmp_path):
    provider = Failing(tmp_path)
    provider.fails = "— b"  # in the sections book; the other book's dialogue is fine
    s = narrate.Settings(books=shelf, work=str(tmp_path / "w"), output=str(tmp_path / "o"), voices=str(tmp_path / "v"), cast=str(tmp_path / "c"), provider=provider, voice=synth.ToneVoice(), wave=2)
    with pytest.raises(annotate.AnnotationError, match="sections, chapter 1: annotation failed 2 times"):
        narrate.run(spark, replace(s, wave=100))
    # two attempts in all, whatever Spark would repeat
    assert sorted(c[0] for c in provider.calls()) == ["dit-il : — Bonjour.", "— b", "— b"]
    kept = cache.read(spark, s.caches, "annotations")
    assert {(r.book_id, r.chapter_number) for r in kept.collect()} == {("deux_tomes", 1), ("deux_tomes", 2), ("sections", 1), ("sections", 2), ("sections", 3)}
    # the failing chapter's passages before the failing one are kept too
    assert [r.passage_idx for r in kept.where("book_id = 'sections' and chapter_number = 1").orderBy("passage_idx").collect()] == [0, 1]
    provider.fails = "nothing at all"
    assert len(narrate.run(spark, s).collect()) == 5
    assert [c[0] for c in provider.calls()] == ["— b"]
    # another provider doesn't take these answers for its own
    assert cache.read(spark, replace(s, provider=Named()).caches, "annotations").count() == 0


class Named(annotate.RuleProvider):
    name = "another"


def test_many_versions_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "MOST_VERSIONS", 3)
    for k in range(9):
        cache.commit(spark.createDataFrame([("b", k % 4, str(k))], schemas.TONE_CACHE), str(tmp_path), "tones")
    assert {r.chapter_number: r.instruct for r in cache.read(spark, str(tmp_path), "tones").collect()} == {0: "8", 1: "5", 2: "6", 3: "7"}
    assert len(cache.versions(spark, f"{tmp_path}/tones")) <= 4


def test_canonical_paths(spark, tmp_path):
    assert config.canonical(spark, str(tmp_path)) == config.canonical(spark, f"file:{tmp_path}") == config.canonical(spark, f"file://{tmp_path}") == str(tmp_path)
    assert config.canonical(spark, "some/where").startswith("/") and config.canonical(spark, "some/where").endswith("/some/where")


def test_clashing_overrides(spark):
    lines = spark.createDataFrame([("x", "male", False, False)], "speaker string, speaker_gender string, speaker_is_child boolean, is_narrator boolean")
    pinned = spark.createDataFrame([("x", "B"), ("x", "A"), ("x", "C")], "speaker string, voice string").repartition(3)
    assert cast.assign_voices(lines, pinned).first()["voice"] == "A"


def test_command_line(capsys):
    from fabula.__main__ import settings

    s = settings(["--book", "x.epub", "--all-chapters", "--skip-tts", "--no-narrator-tone", "--stand-ins"])
    assert (s.chapter, s.skip_tts, s.narrator_tone, s.workers) == (None, True, False, 2)
    assert settings(["--book", "x", "--stand-ins"]).chapter == 1
    # without the libraries of the models there is no silent replacement
    for bad in (["--book", "x"], ["--book", "x", "--workers", "0"], ["--book", "x", "--chapter", "2", "--all-chapters"], []):
        with pytest.raises(SystemExit):
            settings(bad)


def test_arrivals(spark, shelf, tmp_path):
    from fabula.streaming.arrivals import watch

    seen = []
    q = watch(spark, shelf, str(tmp_path / "ck"), lambda df, n: seen.extend(r.book_id for r in df.select("book_id").distinct().collect()), once=True)
    q.awaitTermination(60)
    assert sorted(seen) == ["deux_tomes", "sections"]
