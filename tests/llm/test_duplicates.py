"""op2, op6 and op7 against brute force, and their edge cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm import jaccard_join, line_dedup, vector_dedup
from fabula.llm.components import components, roots

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    u = Union()
    for i, (a, x) in enumerate(sets):
        u.find(a)
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u.join(a, b)
    return {k: (len(s), u.find(k)) for k, s in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    common = " ".join(f"c{i}" for i in range(60))
    for g in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(1, 14)):
            copy = " ".join(edited(rng, words, rng.randint(0, 5)))
            rows.append(copy.upper() if rng.random() < 0.2 else copy + "\n" * rng.randint(0, 2))
        rows.append(common + " " + " ".join(words))
    rows += [common] * 9 + ["a b", "A  b", "a b c", "", None, " \n", "a", "b a"]
    rng.shuffle(rows)
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows, strict=True))


def test_jaccard_is_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "1 as mark", "2 as size", "3 as root")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df.repartition(5)).collect()}
    want = near_duplicates(corpus)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_hot_shingles_change_nothing(spark, corpus, monkeypatch):
    for name, value in (("HOT_DOCS", 4), ("HOT_TOTAL", 50), ("HOT_IN_RUN", 2), ("FLUSH_SHINGLES", 500)):
        monkeypatch.setattr(jaccard_join, name, value)
    df = spark.createDataFrame(corpus, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == near_duplicates(corpus)


def test_dealing_in_steps_and_split_shingles_change_nothing(spark, corpus, monkeypatch):
    # three steps of dealing, and blocks much smaller than a shingle's postings
    for name, value in (("GROUP_SHINGLES", 300), ("FAN", 3), ("TOGETHER", 3), ("PAIRS", 4), ("CHAINS", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == near_duplicates(corpus)


def test_clashing_fingerprints_are_told_apart(spark, corpus, monkeypatch):
    def of(b, n=5, clashing=None):
        s = whole(b, n)
        mark = s.mark % np.uint64(40)  # many different sets share one
        return jaccard_join.Sets(s.keys, s.size, np.where(np.isin(mark, clashing), s.other, mark) if clashing is not None else mark, s.other)

    whole = jaccard_join.Sets.of
    monkeypatch.setattr(jaccard_join.Sets, "of", of)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == near_duplicates(corpus)


def test_jaccard_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(empty).count() == 0
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (3, "A b c d e f G"), (9, None)]
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, 3), (5, 3, 3), (5, 3, 3), (9, 0, 9)]


def test_overlap_bounds():
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(1, 60), np.arange(1, 60)))
    need = jaccard_join.least_overlap(a, b)
    for x, y, n in zip(a, b, need, strict=True):
        assert n == min(i for i in range(x + y) if 100 * i >= 80 * (x + y - i))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(300)] + [(7, 7)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    want = {x: u.find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.node: r.root for r in components(df).collect()} == want
    nodes, root = roots(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert {int(n): int(r) for n, r in zip(nodes, root, strict=True) if n in want} == want
    assert components(df.limit(0)).count() == 0


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        centres = rng.normal(size=(60, 16))
        for c in centres:
            for _ in range(rng.integers(1, 4)):
                rows.append((c + rng.normal(size=16) * rng.choice([0, 0.03, 0.05]), label))
        dense = rng.normal(size=16)
        rows += [(dense + rng.normal(size=16) * 0.02, label) for _ in range(60)]
    rows = [([float(np.float32(x)) for x in v], label) for v, label in rows]
    rows += [(rows[0][0], None), (rows[0][0], 0), (None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([None] * 16, 0), ([float("inf")] + [1.0] * 15, 0), (rows[1][0][:8], 0), ([2 * x for x in rows[0][0]], 0)]
    return [(3 * i + 1, v, label) for i, (v, label) in enumerate(rows)]


def test_vectors_are_brute_force(spark):
    rows = vectors()
    good = [(k, np.array(v, float), label) for k, v, label in rows if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, u = defaultdict(int), Union()
    for i, (a, x, m) in enumerate(good):
        for b, y, n in good[:i]:
            if m == n and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                u.join(a, b)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = vector_dedup.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (links[k], u.find(k), u.find(k) == k) for k, *_ in rows}
    assert max(links.values()) > vector_dedup.LIST
    assert vector_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def linked_by_brute_force(rows):
    found = {i: [] for i, *_ in rows}
    for i, v, lab in rows:
        for j, w, other in rows:
            if i != j and lab == other and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                found[i].append(j)
    return found


def assert_brute_force(spark, rows):
    links = linked_by_brute_force(rows)
    df = spark.createDataFrame([(i, v.tolist(), lab) for i, v, lab in rows], "vec_id long, embedding array<double>, label long")
    least = {i: i for i in links}
    while any(least[i] > least[j] for i in links for j in links[i]):
        least = {i: min([least[i], *(least[j] for j in links[i])]) for i in links}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicate_vectors(df).collect()}
    assert got == {i: (len(links[i]), least[i], least[i] == i) for i in links}


def tight_groups():
    """Groups of 16 near copies, of which those next to each other are at cosine 0.985; and two unlinked rows."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    step = np.arccos(0.985)
    centres = [np.cos(k * step) * basis[0] + np.sin(k * step) * basis[1] for k in range(5)]
    rows = [c + 1e-3 * rng.normal(size=32) / 32 for c in centres for _ in range(16)] + [basis[2], basis[3]]
    return [(int(i), rows[k], 1) for k, i in enumerate(rng.permutation(len(rows)))]


def test_saturated_groups_are_linked(spark, monkeypatch):
    # blocks smaller than the groups: links are found across meetings too
    monkeypatch.setattr(vector_dedup, "BLOCK", 24)
    assert_brute_force(spark, tight_groups())


def test_failed_audit_leads_to_all_comparisons(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 24)
    monkeypatch.setattr(vector_dedup, "REFINED", 1)
    monkeypatch.setattr(vector_dedup, "neighbour_lists", lambda nodes, *_: spark.createDataFrame([], "src long, dst long, cosine double"))
    assert_brute_force(spark, tight_groups())


def by_rows(rows):
    """Each row on its own, whatever its key: sorted (key, n_links, component_id, kept)."""
    good = [(i, np.array(v, float), m) for i, (_, v, m) in enumerate(rows) if v and m is not None and any(v)]
    links, u = defaultdict(int), Union()
    for n, (i, x, m) in enumerate(good):
        for j, y, o in good[:n]:
            if m == o and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    lowest = {}
    for i, (k, *_) in enumerate(rows):
        if k is not None:
            lowest[u.find(i)] = min(lowest.get(u.find(i), k), k)
    found = [(k, links[i], lowest.get(u.find(i))) for i, (k, *_) in enumerate(rows)]
    return sorted(((*f, f[0] == f[2]) for f in found), key=repr)


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.001], 1), (3, [1.0, 0.001], 1), (None, [1.0, 0.0], 1), (None, [-1.0, 0.0], 1), (None, [-1.0, 0.0], 1), (4, None, 1), (4, [1.0, 0.0], None), (None, None, None), (5, [0.0, -0.0, 1.0], 1), (6, [0.0, 0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").selectExpr("*", "vec_id as node", "label as n_links", "1 as row")
    got = sorted((tuple(r) for r in vector_dedup.near_duplicate_vectors(df).collect()), key=repr)
    assert got == by_rows(rows)
    assert (1, 3, 1, True) in got and (1, 1, 1, True) in got and (2, 1, 1, False) in got


def test_audit_counts_nodes_not_links(spark):
    # one large group, all of whose links were found, and a hundred pairs that all were lost
    rng = np.random.default_rng(8)
    basis = rng.normal(size=(101, 64))
    rows = [(i, 1, 1, (basis[100] + 1e-3 * rng.normal(size=64)).tobytes()) for i in range(300)]
    rows += [(1000 + 2 * i + k, 1, 1, (basis[i] + 1e-3 * k).tobytes()) for i in range(100) for k in (0, 1)]
    nodes = spark.createDataFrame([(n, g, c, bytearray(v)) for n, g, c, v in rows], "node long, grp long, copies long, v binary")
    counted = spark.createDataFrame([(i, 0, 299) for i in range(300)], "node long, root long, links long")
    assert vector_dedup.audit(nodes, counted) < 0.75
    every = counted.unionAll(spark.createDataFrame([(1000 + i, 1000 + i // 2 * 2, 1) for i in range(200)], "node long, root long, links long"))
    assert vector_dedup.audit(nodes, every) == 1.0


def test_recall_is_reported(spark):
    report = []
    df = spark.createDataFrame([(k, v, m) for k, v, m in vectors(2)], "vec_id long, embedding array<float>, label int")
    vector_dedup.near_duplicate_vectors(df, report=report).count()
    assert report and report[-1] >= vector_dedup.RECALL
    assert vector_dedup.tables_for(0) == 1 and vector_dedup.tables_for(22) > vector_dedup.tables_for(4) > 1


def without_later_copies(rows, least):
    """Every run of lines with enough words, of any length, that was there before: its lines go, but not those of the first one."""
    seq, docs = [], []
    for k, t in sorted(rows, key=lambda r: r[0]):
        lines = [(x, len(WORD.findall(x))) for x in (t or "").split("\n")]
        full = [x for x in lines if x[1]]
        docs.append((k, t, lines, len(seq), len(full)))
        seq += [*full, None]
    gone, first = [False] * len(seq), {}
    for i in range(len(seq)):
        words, n = 0, 0
        while seq[i + n] if i + n < len(seq) else None:
            words += seq[i + n][1]
            n += 1
            if words >= least:
                begin = first.setdefault(tuple(seq[i : i + n]), i)
                for x in range(max(i, begin + n) if begin < i else i + n, i + n):
                    gone[x] = True
    out = {}
    for k, t, lines, start, n in docs:
        kept, at = [], 0
        for x, words in lines:
            at += words > 0
            if not (at and gone[start + at - 1]):
                kept.append(x)
        out[k] = (None if t is None else "\n".join(kept), sum(gone[start : start + n]))
    return out


def test_first_copies_stay(spark):
    line = " ".join(f"w{i}" for i in range(25))
    other = line.replace("w", "v")
    rows = [(1, "\n".join([line] * 6)), (2, "\n".join([other, line] * 3)), (3, "\n".join([line] * 2)), (4, "\n".join([other, line, "end"]))]
    got = {r.doc_id: (r.text, r.words_left) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the first 50 words stay, and each document's own first copies
    assert got == {1: (f"{line}\n{line}", 50), 2: (f"{other}\n{line}", 50), 3: ("", 0), 4: ("end", 1)}
    assert {k: t for k, (t, _) in got.items()} == {k: t for k, (t, _) in without_later_copies(rows, 50).items()}


def test_ranks_are_places_in_the_suffix_array(spark):
    rng = random.Random(11)
    rows = [(d, d + 1, d, a, w, w + 1000, 1) for d in range(25) for a, w in enumerate(rng.choices([7, 8, 9], [20, 2, 1], k=rng.randint(3, 30)))]
    lines = spark.createDataFrame(rows, "doc long, doc2 long, key long, at long, line long, line2 long, words long").repartition(5)
    ranks = line_dedup._first_ranks(lines)
    segments = line_dedup._segments(lines, ranks, 1).persist()
    texts = {d: [r[4] for r in rows if r[0] == d] for d in range(25)}
    suffixes = [(tuple(texts[d][a:]), d, a) for d in texts for a in range(len(texts[d]))]
    place = {(r["segment"], r["at"]): (r["doc"], r["at"]) for r in segments.collect()}
    assert len({s for s, _ in place}) == 25
    level, depth = segments, 1
    while depth < 32:
        have = {place[r["segment"], r["at"]]: r["rank"] for r in level.collect()}
        heads = sorted(s[:depth] for s, _, _ in suffixes)
        assert have == {(d, a): heads.index(s[:depth]) for s, d, a in suffixes}
        level = line_dedup._deeper(level.select("segment", "at", "rank"), depth)
        depth *= 2


def test_lines_are_brute_force(spark):
    rng = random.Random(2)
    lines = [" ".join(f"l{i}x{j}" for j in range(rng.choice([1, 3, 7, 20]))) for i in range(12)] + ["", " "]
    rows = [(i * 2 % 97, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25)))) for i in range(40)]
    rows += [(200, rows[3][1]), (201, None), (202, ""), (203, "\n".join([lines[0]] * 60)), (204, " ".join(lines) * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id as line", "text", "doc_id", "'a' as at").repartition(3)
    for least in (5, 12, 50):
        got = {r.doc_id: (r.text, r.lines_deleted) for r in line_dedup.dedup_lines(df, least=least).collect()}
        assert got == without_later_copies(rows, least)
    assert sum(n for _, n in without_later_copies(rows, 12).values()) > 20
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_equal_rows_are_one_document(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, "x\n" + long)]
    got = sorted((r.doc_id, r.text, r.lines_deleted) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, long, 0), (1, long, 0), (2, "x", 1)]


def test_shortest_runs():
    words = np.array([3, 3, 3, 10, 1, 1, 20])
    forward, back = line_dedup.shortest_runs(words, np.array([0, 4, 7]), 6)
    assert forward.tolist() == [2, 2, 2, 1, 3, 2, 1] and back.tolist() == [0, 2, 2, 1, 0, 0, 1]
