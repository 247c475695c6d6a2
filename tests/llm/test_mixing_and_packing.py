"""op8, op10 and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fabula.llm import mixing, packing
from fabula.llm.queries import tokenizer_path
from fabula.llm.textbatch import TextBatch
from fabula.llm.tokens import WordTokenizer

WORD = re.compile("[^\x20\x09-\x0D]+")


def targets(sizes):
    """Shares by weight, what is above twice a source's size shared again until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in free}
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= above
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "B", "é", None, "zz"] + ["big"] * 8)
        rows.append((i, " ".join("w" for _ in range(rng.choice([1, 5, 30, 200]))), "en", source, 1))
    rows += [(9000, None, "en", "a", 0), (9001, " ", "en", "only-empty", 1), (9002, "x " * 5000, "en", "long", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mix(spark, docs):
    rows, df = docs
    got = {r.doc_id: r for r in mixing.mix(df.withColumn("size", F.lit(7)).withColumn("hash", F.lit(1))).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    totals: dict = {}
    for i, _, _, s, _ in rows:
        totals[s] = totals.get(s, 0) + size[i]
    want = targets(totals)
    taken: dict = {}
    for i, _, _, s, _ in rows:
        r = got[i]
        assert r.size == size[i] and r.source_size == totals[s] and r.target == pytest.approx(want[s])
        assert r.taken in (0, size[i], 2 * size[i])
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in taken.items():
        own = [size[i] for i, _, _, x, _ in rows if x == s]
        small = max(x for x in own if x <= sum(own) / len(own))
        assert abs(t - want[s]) <= max(small, 1) / 2 or sum(x for x in own if x <= sum(own) / len(own)) < max(own)
    assert {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()} == {i: r.taken for i, r in got.items()}
    copies = {r.doc_id: r["count"] for r in mixing.apply_mix(df).groupBy("doc_id").count().collect()}
    assert copies == {i: r.taken // r.size for i, r in got.items() if r.taken}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.apply_mix(df).columns == df.columns


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "É", "é", "́", "\x0b", "\x1c", "\x85", "'s", "<|endoftext|>", "7", "ß", "İ", "😀", " ", "\n", ".", ","]), max_size=25).map("".join), max_size=8))
def test_word_ids_are_the_texts_ids(texts):
    words = WordTokenizer(tokenizer_path())
    ids, bounds = words.encode(TextBatch.of(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def test_forgetting_changes_nothing(monkeypatch):
    from fabula.llm import tokens

    monkeypatch.setattr(tokens, "MOST_WORDS", 3)
    words = WordTokenizer(tokenizer_path())
    for text in ("one two three four", "five one", "six seven eight nine ten"):
        assert words.encode(TextBatch.of([text]))[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_every_letter_and_stop_of_plain_words():
    words = WordTokenizer(tokenizer_path())
    letters = [chr(i) for i in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xAA, 0x250))]
    stops = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
    texts = [f"{a}{c}{b}" for c in letters for a, b in (("", ""), ("x", "Y"), ("R", ".'"), ("<|", "|>"))] + [f"aé{s}{t}" for s in stops for t in ("", "'", "<|", "s")]
    for some in ([" ".join(texts)], texts, [t.upper() for t in texts], []):
        ids, bounds = words.encode(TextBatch.of(some))
        for i, t in enumerate(some):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_halves_of_a_letter_in_two_texts_are_none():
    words = WordTokenizer(tokenizer_path())
    raw = [b"ab\xc3", b"\xa9cd", b"\xc3b", b"e\xc3"]
    b = TextBatch(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    ids, bounds = words.encode(b)
    for i, x in enumerate(raw):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == words.tokenizer.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids


def test_forms_of_a_word_are_encoded_once(monkeypatch):
    asked = []
    encode = WordTokenizer._encode
    monkeypatch.setattr(WordTokenizer, "_encode", lambda self, units, *rest: asked.extend(units) or encode(self, units, *rest))
    words = WordTokenizer(tokenizer_path())
    for text in ("River river, RIVER. river;", "(river) river%%% RIVER, stone, Stone", "river. STONE; river%%%"):
        assert words.encode(TextBatch.of([text]))[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) and sorted(x.lower() for x in asked) == sorted(["river", ",", ".", ";", "(river)", "%%%", "stone"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=30), st.integers(0, 2**20))
def test_every_id_is_in_one_piece(sizes, seed):
    rng = np.random.default_rng(seed)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    pieces = packing.pack_shard(rng.integers(0, 30, bounds[-1]).astype(np.uint32), bounds, 16)
    by_doc: dict = {}
    by_sequence: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence, []).append((p.offset, p.length))
    for groups, full in ((by_doc, dict(enumerate(sizes))), (by_sequence, None)):
        for k, spans in groups.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at and length > 0
                at += length
            assert at == full[k] if full else at <= 16 and at & (at - 1) == 0
    assert sorted(by_doc) == list(range(len(sizes)))


def test_neighbours_share_words():
    a, b = np.arange(100, 110), np.arange(200, 210)
    docs = [a, b, a[::-1], b[::-1], np.array([1, 2])]
    index = packing.Bm25(np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    assert index.neighbours(0, np.array([False, True, True, True, True])).tolist() == [2]
    assert index.neighbours(4, np.ones(5, bool)).tolist() == [4]


def test_every_id_of_a_seed_retrieves():
    # 60 ids that only the seed has, and 40 more of which each other document has some
    rng = np.random.default_rng(2)
    shared = np.arange(500, 540)
    seed = np.concatenate([np.arange(1000, 1060), shared])
    docs = [seed, *(np.concatenate([rng.choice(shared, k, replace=False), np.arange(2000 + 50 * k, 2040 + 50 * k - k)]) for k in (1, 9, 30, 3))]
    index = packing.Bm25(np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    unused = np.array([False, True, True, True, True])
    df = {t: sum(t in d for d in docs) for t in shared}
    mean = np.mean([len(d) for d in docs])
    score = {i: sum(np.log1p((5 - df[t] + 0.5) / (df[t] + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in shared if t in d) for i, d in enumerate(docs) if i}
    assert index.neighbours(0, unused).tolist() == sorted(score, key=lambda i: -score[i]) == [3, 2, 4, 1]


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "délta."]) for _ in range(rng.choice([3, 50, 6000])))) for i in range(40)] + [(100, None), (101, ""), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("shard", F.lit(1))
    got = packing.pack(df.repartition(3), tokenizer_path(), shard_tokens=9000, part_tokens=20_000).collect()
    tokenizer = WordTokenizer(tokenizer_path()).tokenizer
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    whole: dict = {}
    fill: dict = {}
    for r in got:
        if r.doc_id != 7:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        whole.setdefault(r.doc_id, []).append((r.start, r.length))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, spans in whole.items():
        if i != 7:
            assert [s for s, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) == len(ids[i])
    # three rows have id 7: each is packed
    first, again = dict(rows[:40])[7], "again"
    own = [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in (first, again, again)]
    assert len(whole) == 42 and sum(n for _, n in whole[7]) == sum(own) and sum(start == 0 for start, _ in whole[7]) == 3
    for spans in fill.values():
        total = sum(n for _, n in spans)
        assert total <= 4096 and total & (total - 1) == 0
    same = packing.pack(df.repartition(5), tokenizer_path(), shard_tokens=9000, part_tokens=20_000).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, got))
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


def test_shards_weigh_ids_by_the_whole_corpus(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "house", "green", "table", "paper", "light", "north"]
    rows = [(i, " ".join(rng.choices(words, [2**-k for k in range(12)], k=rng.choice([20, 60, 300])))) for i in range(120)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokenizer_path(), window=256, shard_tokens=3000, part_tokens=6000).collect()
    tokenizer = WordTokenizer(tokenizer_path()).tokenizer
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    df = np.bincount([t for x in ids.values() for t in set(x)])
    corpus = packing.Corpus(len(rows), sum(map(len, ids.values())) / len(rows), df)
    shards: dict = {}
    for r in got:
        shards.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(shards) > 3
    alone = 0
    for s, pieces in shards.items():
        names = sorted({r.doc_id for r in pieces})
        flat = np.concatenate([ids[i] for i in names]).astype(np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(ids[i]) for i in names])])
        have = sorted((r.sequence_id - (s << 32), r.offset, r.doc_id, r.start, r.length) for r in pieces)
        want, own = (sorted((p.sequence, p.offset, names[p.doc], p.start, p.length) for p in packing.pack_shard(flat, bounds, 256, c)) for c in (corpus, None))
        assert have == want
        alone += have != own
    assert alone


def test_long_documents_and_repeated_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "GIANT_WINDOWS", 3)
    rng = random.Random(7)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "stone"]) for _ in range(700))
    # a text that a third of all rows repeat under one id, and one without an id
    rows = [(1, long), (2, "alpha " * 64), (None, "x")] + [(3, "green table paper " * 9)] * 30 + [(10 + i, " ".join(rng.choice(["light", "north", "river"]) for _ in range(30))) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df.repartition(4), tokenizer_path(), window=64, shard_tokens=400, part_tokens=900).collect()
    tokenizer = WordTokenizer(tokenizer_path()).tokenizer
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    of = lambda i: sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
    for i in (1, 2, 10, None):
        spans, at = of(i), 0
        for start, length, crc in spans:
            assert start == at and crc == zlib.crc32(np.array(ids[i][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[i]) == next(r.doc_tokens for r in got if r.doc_id == i)
    assert sum(n for _, n, _ in of(3)) == 30 * len(ids[3]) and len({r.sequence_id >> 32 for r in got if r.doc_id == 3}) > 3
    fill: dict = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64 and at & (at - 1) == 0
    assert min(fill) < 0
    again = packing.pack(df.repartition(2), tokenizer_path(), window=64, shard_tokens=400, part_tokens=900).collect()
    assert sorted(repr(tuple(r)) for r in again if r.sequence_id >= 0) == sorted(repr(tuple(r)) for r in got if r.sequence_id >= 0)


def test_copies_share_a_shard(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ra", "to", "ne", "su") for c in ("bel", "dor", "fin", "gam")]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    rows = [(k * 1000 + i, t if k == 0 else t + " " + rng.choice(words)) for i, t in enumerate(texts) for k in range(3)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), shard_tokens=6000, part_tokens=9000).collect()
    shard = {r.doc_id: r.sequence_id >> 32 for r in got}
    assert len(set(shard.values())) > 4
    # by hash of the id, about one pair in five would meet
    assert np.mean([shard[i] == shard[1000 + i] for i in range(60)]) > 0.6


def test_bm25_is_the_plain_formula():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 40, rng.integers(1, 60)) for _ in range(30)]
    index = packing.Bm25(np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
    df = {t: sum(t in d for d in docs) for t in range(40)}
    mean = np.mean([len(d) for d in docs])
    for seed in range(0, 30, 7):
        score = np.zeros(30)
        for i, d in enumerate(docs):
            for t in set(docs[seed].tolist()):
                tf = (d == t).sum()
                score[i] += np.log1p((30 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        unused = np.arange(30) % 3 > 0
        want = [i for i in sorted(range(30), key=lambda i: (-round(score[i], 9), i)) if unused[i] and score[i] > 0]
        have = index.neighbours(seed, unused)
        assert sorted(have) == sorted(want) and np.allclose(score[have], score[want])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(6)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.choice(['ra', 'to', 'li'])}{rng.randrange(500)}" for _ in range(n))
    passage = words(55)
    rows = [(i, "\n".join(words(rng.randint(30, 80)) for _ in range(3))) for i in range(80)]
    junk = [(100 + i, " ".join([words(1)] * 200)) for i in range(40)]
    near = [(200, rows[3][1] + " tail"), (201, rows[4][1]), (202, passage + "\n" + words(60)), (203, words(60) + "\n" + passage)]
    every = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in rows + junk + near] + [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    docs = spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in rows[:60]] + [(i, 0, 0) for i, _ in junk[:30]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, seen[-1], str(tmp_path))
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType, name
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    assert {i for i, _ in rows} <= ids[1] and not {i for i, _ in junk} & ids[1]
    assert 201 not in ids[2] and {200, 202, 203} <= ids[2]
    text = {r.doc_id: r.text for r in seen[2].collect()}
    assert passage in text[202] and passage not in text[203]
    assert len(ids[3]) <= len(ids[2]) and {i for i, _ in rows[5:]} <= ids[3]
    assert ids[4] <= ids[3]
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids[4]
    assert sum(r.length for r in packed) > 0


def test_one_row_of_each_group_stays(spark):
    import corpus_pipeline as P

    a, b, c, d = (" ".join(f"{k}{i}" for i in range(80)) for k in "abcd")
    # repeated rows; near copies without an id; and an id with texts of two groups
    rows = [(1, a), (1, a), (5, a + " end"), (None, b), (None, b + " end"), (None, b), (7, c), (7, d), (6, c + " end"), (8, d), (9, None), (9, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.drop_near_duplicates(spark, docs.repartition(3), "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "")[:1]) for r in out.collect()), key=repr)
    assert got == sorted([(1, "a"), (None, "b"), (6, "c"), (7, "d"), (9, ""), (9, ""), (None, "")], key=repr)


def test_stages_take_empty_tables_and_any_columns(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = " ".join(f"word{i}" for i in range(80))
    extra = ("words_left", "size", "hash", "copies", "row", "mark", "root", "score", "grp", "component_id", "line", "at")
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, text + " end", "en", None, 1), (2, text + " end", "en", None, 1), (None, "a\nb", None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs.limit(0), docs.selectExpr("*", *(f"doc_id as {c}" for c in extra))):
        for name, stage in P.STAGES:
            out = stage(spark, frame, str(tmp_path)).persist()
            if name != "packing":
                assert out.columns == frame.columns, name
                kept = {r.doc_id for r in out.collect()}
                assert kept <= {r.doc_id for r in frame.collect()}
            else:
                assert sum(r.length for r in out.collect()) >= frame.count()
