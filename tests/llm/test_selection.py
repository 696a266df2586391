"""Exact duplicates, ball k-means and importance against plain versions of themselves, on odd rows too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import ball_kmeans, exact_dedup, importance
from docloom.llm.storage import Scratch

#: Names that the operators use themselves.
SCHEMA = "doc_id long, text string, digest string, row string, size long, winner int, rank int, place int, cells string, r int"
TEXTS = [None, "", " ", "\t\n ", "a b", "a\tb", "a  \r\n\x0b b", "a b ", "A b", "a b", "é" * 9, "é" * 9, "漢字 かな 🙂", "a\x00b", "word " * 50_000]


def documents(spark, more=()):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé7") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = TEXTS + [rng.choice([" ", "  ", "\n", ", ", "-"]).join(rng.choice(words) for _ in range(rng.randrange(1, 70))) for _ in range(120)]
    texts += [texts[20]] * 40 + [texts[30].replace(" ", "\n\t"), texts[5]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[20], rows[20], rows[7], (None, texts[20]), (None, "only here"), (None, "only here"), (None, None), *more]
    return [(i, t, "x", None, 1, 2, 3, None, "y", 0) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(spark), SCHEMA).repartition(3)


def one_space(text):
    return re.sub("[\\x20\\x09-\\x0D]+", " ", text or "")


@pytest.mark.parametrize("border", [None, -1, 50, 10**9])
def test_equal_texts_are_one_group_for_any_border(docs, border):
    rows = documents(None)
    members = defaultdict(list)
    for i, t, *_ in rows:
        members[one_space(t)].append(i)
    want, kept = Counter(), 0
    for t, ids in members.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    got = exact_dedup.groups(docs, border=border).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(members) and all(r.doc_id == r.keep_id for r in kept)
    assert len({r.text_sha256 for r in kept}) == len(members)


def test_one_row_of_each_group_stays_whole(docs, spark):
    got = exact_dedup.keep_one(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(one_space(r.text) for r in rows) == sorted({one_space(t) for _, t, *_ in documents(None)})
    assert all(r.winner == 2 and r.digest == "x" for r in rows)
    plain = spark.createDataFrame([(1, "a b"), (2, "a\nb"), (3, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_dedup.keep_one(plain).collect()) == [1, 3]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.groups(none).count() == 0 and exact_dedup.keep_one(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, cluster int")
    assert ball_kmeans.clusters(vectors).count() == 0
    target = spark.createDataFrame([], "text string")
    assert importance.resample(none, target).count() == 0


def test_perfect_hash_is_minimal_and_bytes_are_checked():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 5_000):
        digests = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        # some differ in one byte only
        digests[n // 2 :, :31] = digests[: n - n // 2, :31]
        digests = np.unique(digests, axis=0)
        levels = exact_dedup.perfect_hash(digests)
        at = exact_dedup.slots(digests, levels)
        assert sorted(at.tolist()) == list(range(len(digests)))
    strange = digests.copy()
    strange[:, 31] ^= 1
    known = {bytes(x) for x in digests}
    held = np.empty_like(digests)
    held[at] = digests
    slot = exact_dedup.slots(strange, levels)
    found = (slot >= 0) & (held[slot] == strange).all(axis=1)
    assert found.tolist() == [bytes(x) in known for x in strange]


def test_many_buckets_give_the_same_groups(docs, monkeypatch):
    whole = sorted(map(tuple, exact_dedup.groups(docs).select("text_sha256", "group_size").collect()))
    monkeypatch.setattr(exact_dedup, "PER_BUCKET", 7)
    assert sorted(map(tuple, exact_dedup.groups(docs).select("text_sha256", "group_size").collect())) == whole


def plain_balls(rows, k, rounds, dim, seed=2):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            cells = [math.floor(256 * float(np.float32(x))) for x in v]
            if max(map(abs, cells)) <= ball_kmeans.LIMIT:
                kept.append((i, cells))
    name = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [list(c) for _, c in sorted(kept, key=name)[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        best = [min((gap(c, m), j) for j, m in enumerate(centres)) for _, c in kept]
        if n < rounds:
            for j in range(len(centres)):
                own = [c for (_, c), (_, b) in zip(kept, best, strict=True) if b == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = Counter()
    for d, j in best:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, best, strict=True))


@pytest.mark.parametrize("scale", [1.0, 0.01, 90_000.0])
def test_balls_are_plain_rounds(spark, scale):
    rng = random.Random(int(scale))
    middles = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(7)]
    rows = [(i, [scale * (x + rng.gauss(0, 0.2)) for x in rng.choice(middles)]) for i in range(500)]
    rows += [rows[0], rows[0], (None, rows[3][1]), (None, rows[4][1]), (900, rows[5][1])]
    # ties: corners of a grid, the same vector many times
    rows += [(1000 + k, [scale * (k >> j & 1) for j in range(6)]) for k in range(64)] + [(2000 + k, [scale] * 6) for k in range(200)]
    odd = [(3000, None), (3001, []), (3002, [1.0] * 5), (3003, [None] + [1.0] * 5), (3004, [float("nan")] * 6), (3005, [float("inf")] * 6), (3006, [1e30] * 6), (3007, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, cluster int, distance int").repartition(4)
    for k, rounds in ((9, 5), (1, 2), (2000, 1)):
        got = ball_kmeans.clusters(df, k=k, rounds=rounds, dim=6)
        assert Counter(map(tuple, got.collect())) == plain_balls(rows + odd, k, rounds, 6)


def test_a_stable_core_is_compared_with_nothing():
    rng = np.random.default_rng(2)
    centres = [[1000 * k] * 8 for k in range(10)]
    own = np.repeat(np.arange(10), 50)
    cells = np.array(centres)[own] + rng.integers(-20, 20, (500, 8))
    near = ball_kmeans.neighbours(centres, [60] * 10)
    assert near == [[]] * 10
    got, _, compared = ball_kmeans.nearest(cells, own.astype(np.int32), np.array(centres), ball_kmeans.neighbours(centres, [None] * 10))
    assert got.tolist() == own.tolist() and compared == 0
    wrong = np.roll(own, 25).astype(np.int32)
    got, _, compared = ball_kmeans.nearest(cells, wrong, np.array(centres), ball_kmeans.neighbours(centres, [None] * 10))
    assert got.tolist() == own.tolist() and 0 < compared < 9 * 500


def plain_importance(rows, targets, percent, least, seed=7):
    def features(text):
        ws = [w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")) if w]
        return ws, Counter(zlib.crc32(f.encode()) % importance.BUCKETS for f in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)])

    own, s, t = [(i, *features(x)) for i, x in rows], Counter(), Counter()
    for _, _, f in own:
        s += f
    for x in targets:
        t += features(x)[1]
    S, T, n = s.total(), t.total(), importance.BUCKETS
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + n) / ((s[b] + 1) * (T + n)))) for b in s}
    out = []
    for i, ws, f in own:
        weight = sum(gain[b] * k for b, k in f.items()) // max(f.total(), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(ws), f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = Counter()
    for place, (i, _, f, w, score) in enumerate(long, 1):
        drawn[i, f, w, score, place if place <= percent * len(long) // 100 else None] += 1
    return drawn + Counter((i, f, w, score, None) for i, n, f, w, score in out if n < least)


def test_importance_is_the_plain_formula(docs, spark):
    rows = [(i, t) for i, t, *_ in documents(None)]
    targets = [rows[40][1], rows[41][1], None, "", "Abc-ABC é7"]
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    want = plain_importance(rows, targets, 25, 20)
    assert Counter(map(tuple, importance.resample(docs, target).collect())) == want
    none = spark.createDataFrame([], "text string")
    assert Counter(map(tuple, importance.resample(docs, none, percent=60, least=0).collect())) == plain_importance(rows, [], 60, 0)
    ids = {k[0] for k in want if k[4] is not None}
    got = importance.drawn(docs, target)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == ids


def test_small_portions_and_dictionaries_count_the_same(monkeypatch):
    import pyarrow as pa

    rows = documents(None)
    batch = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    whole = next(importance.counted(iter([batch])))
    for name, small in (("PIECE", 30), ("PORTION", 40), ("HELD", 10)):
        monkeypatch.setattr(importance, name, small)
        assert next(importance.counted(iter([batch]))).equals(whole)


def test_scratch_tables_of_the_operators_lie_in_the_shared_folder(docs):
    assert Scratch(docs.sparkSession, "x").root.startswith(docs.sparkSession.conf.get("spark.checkpoint.dir"))


def test_texts_of_all_lengths_are_learned(spark):
    from docloom.llm import byte_cnn

    rows = [(k, ("good words " if k % 2 else "### %% ") * (20_000 if k > 15 else 20)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    net = byte_cnn.train(docs, labels)
    got = {r.doc_id: r for r in byte_cnn.score(docs, net).collect()}
    assert all(got[k].predicted == k % 2 for k in range(60))
    # only what fits is learned, whatever its length
    assert byte_cnn.train(docs, labels, most_bytes=10).scores(["x"]) == [0.5]
    assert byte_cnn.train(docs, labels, most_bytes=3_000_000).scores([rows[1][1], rows[0][1]])[0] > 0.5


def test_settings_come_back(spark):
    from docloom.llm import storage

    before = {k: spark.conf.get(k, None) for k in storage.SMALL}
    assert Scratch(spark, "settings").save(spark.range(3), "t").count() == 3
    assert {k: spark.conf.get(k, None) for k in storage.SMALL} == before
    held = storage.small_buffers(spark)
    assert spark.conf.get(storage.BATCH) == str(storage.ROWS)
    storage.restore(spark, held)
    assert {k: spark.conf.get(k, None) for k in storage.SMALL} == before


def test_exact_comparison_and_passes_agree(spark):
    from docloom.llm import embedding_passes

    rng = np.random.default_rng(12)
    v = rng.standard_normal((1_500, 32))
    v[500:900] = v[:400] + 0.18 * rng.standard_normal((400, 32))  # pairs
    v[900:1200] = v[0] + 0.15 * rng.standard_normal((300, 32))  # a group around one
    df = spark.createDataFrame([(k, x.tolist(), k % 3) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    plain = lambda exact: {r.vec_id: (r.n_links, r.component_id) for r in embedding_passes.groups(df, exact=exact).collect()}
    want, got = plain(True), plain(False)
    queries = [k for k in want if k % 50 == 0] + list(range(900, 1200, 7))
    same = sum(want[k] == got[k] for k in queries)
    assert same >= 0.95 * len(queries) and all(got[k][0] <= want[k][0] for k in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_labels_that_need_too_many_passes_are_compared_whole(spark, monkeypatch):
    from docloom.llm import embedding_passes

    rng = np.random.default_rng(13)
    monkeypatch.setattr(embedding_passes, "MOST", 5)
    centre = rng.standard_normal(32)
    v = [(centre + 0.45 * rng.standard_normal(32)).tolist() for _ in range(400)]
    v += [(np.array(x) + 0.2 * rng.standard_normal(32)).tolist() for x in v[:200]]
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(v)] + [(9_000 + k, rng.standard_normal(32).tolist(), 2) for k in range(20)], "vec_id long, embedding array<double>, label int")
    got, want = ({r.vec_id: (r.n_links, r.component_id) for r in embedding_passes.groups(df, exact=e).collect()} for e in (False, True))
    assert got == want and sum(n for n, _ in want.values()) > 100


ARTICLE = "This is a sentence of an article that goes on for a while and says something. " * 5
#: Hand-written pages that none of the writers makes, and their texts; A stands for the article.
PAGES = [
    ('<body><form id="aspnetForm"><div class="content"><h1>Title here</h1><p>A</p><p>A</p></div></form></body>', "Title here A A"),
    ('<form method=post><ul><li><a href=x>Home</a></li><li><a href=x>News</a></li></ul><div><p>A</p><p>A</p></div></form>', "A A"),
    ("<body><div>A</div><div>Copyright 2024 Example Corp</div></body>", "A"),
    ("<body><div>A</div><div>&copy; 2024 Example. All rights reserved.</div></body>", "A"),
    ("<body><div id=header>Site name</div><div>A</div><div class=sidebar><p>Something else that is said at some length beside the article.</p></div></body>", "A"),
    ("<body><ul><li><a href=x>Home</a></li><li><a href=x>About</a></li></ul><div><div><p>A</p><p>Short one.</p><ul><li>first point</li><li>second point</li></ul><p>A</p></div></div><div>All rights reserved</div></body>", "A Short one. first point second point A"),
    ("<table><tr><td><a href=x>Menu</a><br><a href=y>Other</a></td><td><p>A</p><p>A</p></td></tr></table>", "A A"),
    ("<body><div><a href=/>Site</a> | <a href=/a>About</a></div><div><h2>Head</h2><div>A</div><div>A</div></div><div>Call 555 1234</div></body>", "Head A A"),
    ("<body><form><input name=q><p>Search</p></form><article><p>A</p></article></body>", "A"),
    ("<body><article><h1>Only a title</h1></article></body>", "Only a title"),
    ("<body><article><p>A</p><p>All rights reserved.</p><p>A</p></article></body>", "A All rights reserved. A"),
    ("<body><nav>Home</nav><main><h1>T</h1><p>A</p><section class=comments><p>I think so, too. It is well said.</p></section></main><footer>A</footer></body>", "T A"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages_by_hand(page, text):
    from docloom.llm import html_mincut

    assert html_mincut.main_text(page.replace("A<", ARTICLE + "<"), html_mincut.fitted()) == " ".join(re.sub(r"\bA\b", ARTICLE, text).split())


def test_features_speak_one_way():
    from docloom.llm import html_mincut

    costs = html_mincut.fitted()
    assert (costs.weights * html_mincut.SPEAKS >= 0).all() and min(costs.edges) >= 0 and max(costs.edges) > 1
