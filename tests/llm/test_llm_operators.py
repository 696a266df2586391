"""Each operator over odd rows: nulls in any column, empty and long texts, ties, repeated rows, an empty table, clashing extra columns."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docloom.llm.storage import Scratch
from docloom.llm import byte_cnn, chat_hmm, embedding_passes, fertility_rules, html_mincut, minhash_forest, sentencepiece_codec, source_mix, token_counts, token_files

PIECES, WORDS, BYTES = map(public_tokenizers.path, ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rep string, place int"
BASE = "Le rapport annuel de la société présente les résultats de chaque service, avec des chiffres et des notes. "


def texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeiouéstrnl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    plain = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(12)]
    near = plain[0].replace(plain[0].split()[40], "autre", 1)
    odd = [None, "", " \n ", "one", "a b c d", "a b c d e", "▁ x  y", "  two  spaces ", "\x01 \x00", "漢字 かな 🙂", "<s> <|endoftext|> x", "a,.b _. ².", "é" * 30, "#*$% " * 80]
    return plain + [plain[0], plain[0].upper(), near] + odd + [" ".join(plain) * 20]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, [None, "fr", "en"][k % 3], [None, "a", "b", ""][k % 4], None, 7, "x", 1) for k, t in enumerate(texts())]
    rows += [rows[3], (None, texts()[0], None, None, 1, 1, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_sentencepiece_is_the_librarys(docs, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(sentencepiece_codec.digests(docs, PIECES))
    for k, t in enumerate(texts()):
        ids = lib.encode(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.digests(none, PIECES).count() == 0
    assert sentencepiece_codec.encode_decode(docs, PIECES).count() == docs.count()


def test_sentencepiece_random_strings():
    import sentencepiece

    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.codec(PIECES), random.Random(2)
    for alphabet in ("ab the in▁  \n\tétionré漢\x01", "theinanrtioes ", " "):
        for _ in range(400):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            ids = lib.encode(s)
            assert own.encode_decode(s) == (",".join(map(str, ids)), lib.decode(ids)), repr(s)


def test_prefix_table_survives_forgetting(monkeypatch):
    own = sentencepiece_codec.PieceCodec(PIECES)
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 2)
    whole = own.encode_decode("one two three four one two")
    assert whole == sentencepiece_codec.codec(PIECES).encode_decode("one two three four one two")


def test_token_counts_are_the_librarys(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    got = by_id(token_counts.token_counts(docs, WORDS, 100))
    for k, t in enumerate(texts()):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 100)
    assert token_counts.token_counts(none, WORDS).count() == 0


@pytest.mark.parametrize("frequent", [0, 3, 10_000])
def test_token_counts_by_either_way(docs, monkeypatch, frequent):
    monkeypatch.setattr(token_counts, "FREQUENT", frequent)
    monkeypatch.setattr(token_counts, "HELD", 100)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, WORDS).collect())
    assert got == sorted((r.doc_id is None, r.doc_id, len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())


def test_tables_are_released(spark, tmp_path):
    from docloom.llm import storage

    before = storage.made()
    one = Scratch(spark, "one")
    other = Scratch(spark, "other")
    for s in (one, other):
        s.save(spark.range(3).toDF("id"), "t")
    at = [s.root.removeprefix("file://") for s in (one, other)]
    assert all(os.path.isdir(x) for x in at)
    storage.release(spark, before, keep=other.root)
    assert [os.path.isdir(x) for x in at] == [False, True]
    storage.release(spark, before)
    assert not os.path.isdir(at[1])


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from docloom.llm import storage

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(far)


def test_rows_that_share_an_id_are_spread(spark):
    df = spark.createDataFrame([(None if k % 2 else 7, f"text number {k}") for k in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = token_files.write_token_files(df, BYTES, Scratch(spark, "spread").path("files"), 2).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) == 4 and max(r.n_docs for r in files) < 200


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    rows = token_files.write_and_read(docs, BYTES, 2).collect()
    assert len(rows) == docs.count()
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d))
    got = {r.doc_id: r for r in rows}
    for k, t in enumerate(texts()):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k].n_tokens, got[k].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert token_files.write_and_read(none, BYTES, 2).count() == 0


def test_blocks_come_back():
    rng = np.random.default_rng(1)
    for k in range(60):
        n = int(rng.integers(1, 5000))
        v = rng.integers(0, [1, 10, 2**16, 2**32][k % 4], n, np.uint32)
        v[rng.integers(0, n, 3)] = 2**32 - 1
        assert (token_files.unpack(token_files.pack(v), n) == v).all()


def test_token_file_random_access(tmp_path):
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 50_000, n, np.uint32) for n in (0, 1, 5000, 3, 9000)]
    with open(tmp_path / "x.tok", "wb") as f:
        w = token_files.TokenFileWriter(f)
        for k, x in enumerate(ids):
            w.add(k, x.astype("<u4").tobytes())
        w.close()
    with open(tmp_path / "x.tok", "rb") as f:
        r = token_files.TokenFileReader(f)
        assert [d for d, _, _ in r.documents()] == [0, 1, 2, 3, 4]
        assert all((a == b).all() for (_, _, a), b in zip(r.documents(), ids, strict=True))
        assert (r.ids(4990, 30) == np.concatenate(ids)[4990:5020]).all()


def brute_mix(rows):
    sizes = {}
    for source, n in rows:
        sizes[source] = sizes.get(source, 0) + n
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            free.remove(s)
            left -= target[s]
    return sizes, target


def test_mix(docs, none):
    got = source_mix.mix(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, target = brute_mix([(r.source, words(r.text)) for r in docs.collect()])
    assert len(got) == docs.count()
    for r in got:
        assert r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-9)
    assert {(r.doc_id, r.size, r.taken) for r in source_mix.mix(docs).collect()} == {(r.doc_id, r.size, r.taken) for r in got}
    assert source_mix.mix(none).count() == 0


def plain_rates(sizes, target, most=3.0):
    """The multiplier of one source by bisection."""
    x = np.array(sizes, float)
    rate = lambda m: np.minimum(most, np.exp(np.minimum(m * x, 50)))
    low, high = -50.0, 50.0
    for _ in range(300):
        m = (low + high) / 2
        low, high = (m, high) if (x * rate(m)).sum() < target else (low, m)
    return dict(zip(sizes, rate(low).tolist(), strict=True))


def test_rates_are_the_duals(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.choice([0, 1, 7, 30, 150, 900, 4000]), rng.choice(["a", "a", "a", "a", "b", "c", None])) for k in range(300)]
    rows += [(None, "w " * 5, "a")] * 40 + [(7, "w " * 5, "b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix(df).collect()
    assert len(got) == len(rows)
    for source in ("a", "b", "c", None):
        own = [r for r in got if r.source == source]
        want = plain_rates([r.size for r in own], own[0].target)
        tilted = [r for r in own if r.size]
        if own[0].target < 2.999 * own[0].source_size:
            assert [r.rate for r in tilted] == pytest.approx([want[r.size] for r in tilted], rel=1e-6)
            assert len({round(r.rate, 6) for r in tilted}) > 2
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, abs=4)
        assert all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in own)


def test_mix_of_one_source_and_none(spark):
    df = spark.createDataFrame([(k, "w " * k, "a") for k in range(20)], "doc_id long, text string, source string")
    assert {(r.size, r.copies) for r in source_mix.mix(df).collect()} == {(k, int(k > 0)) for k in range(20)}
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.taken, r.target) for r in source_mix.mix(empty).collect()} == {(0, 0.0)}


def test_mix_hits_targets(spark):
    rng = random.Random(9)
    rows = [(k, "w " * int(rng.lognormvariate(4, 1)), rng.choice("aaaabc")) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in source_mix.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.001)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><header>Site name</header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>A title &amp; more</h1><p>First <b>bold</b>
part of it.<p>Second one, with <a href=x>a link</a> in its middle &lt;here&gt;.</article><div class="ad">Buy now.</div><aside>Other things</aside>
<div id="comments"><p>I liked this article very much, thank you for it.</p></div><form><p>Name</p></form><footer>&copy; us</footer>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 3), (None, "v", "", 3), (4, "w", "<div><p", 3), (5, "w", "<div>" * 3000 + "deep words stand here, at the end.", 3), (5, "w", "<div>" * 3000 + "deep words stand here, at the end.", 3)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_mincut.extract(df).collect()}
    assert got[1].text == "A title & more First bold part of it. Second one, with a link in its middle <here>."
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == got[None].text == ""
    assert html_mincut.extract(df).count() == 6
    assert html_mincut.extract(df.limit(0)).count() == 0


def cost(gain, edges, side):
    return sum((g if g > 0 else 0) * (not s) + (-g if g < 0 else 0) * s for g, s in zip(gain, side, strict=True)) + sum(c for i, j, c in edges if side[i] != side[j])


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 9)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        best = min(cost(gain, edges, [bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(gain, edges, html_mincut.minimum_cut(gain, edges)) == pytest.approx(best)


def test_cut_of_a_page_is_the_brute_force_minimum():
    from docloom.llm import html_training

    costs, writer, small = html_mincut.fitted(), html_training.Writer(77), 0
    for _ in range(300):
        found = html_mincut.blocks(writer.page())
        for b in found:
            b.text = b.text[1:]
        if len(found) > 11:
            continue
        small += 1
        gain = (np.array([html_mincut.features(b) for b in found], float) @ costs.weights).tolist()
        edges = [(i, j, costs.edges[kind]) for i, j, kind in html_mincut.neighbours(found)]
        best = min(cost(gain, edges, [bool(m >> k & 1) for k in range(len(found))]) for m in range(1 << len(found)))
        assert cost(gain, edges, html_mincut.labels(found, costs)) == pytest.approx(best)
    assert small > 10


def test_the_cut_changes_labels_for_the_better():
    from docloom.llm import html_training

    costs, writer = html_mincut.fitted(), html_training.Writer(98)
    blocks, changed, wrong_alone, wrong = 0, 0, 0, 0
    for _ in range(200):
        found = html_mincut.blocks(writer.page())
        known = [bool(html_training.KNOWN[b.text[0]]) for b in found]
        for b in found:
            b.text = b.text[1:]
        alone = [g > 0 for g in np.array([html_mincut.features(b) for b in found], float) @ costs.weights]
        cut = html_mincut.labels(found, costs)
        blocks += len(found)
        changed += sum(x != y for x, y in zip(alone, cut, strict=True))
        wrong_alone += sum(x != y for x, y in zip(alone, known, strict=True))
        wrong += sum(x != y for x, y in zip(cut, known, strict=True))
    assert changed > 20 and wrong < wrong_alone and wrong < 0.03 * blocks


@pytest.mark.parametrize("box", ["div class=social-policy", "div class=content><section class=share-prices", "section class=menu-of-the-day", "div"])
def test_no_single_name_decides(box):
    text = "A long article about the matter stands here, and more of it follows. " * 5
    assert html_mincut.main_text(f"<body><nav><a href=x>Home</a></nav><{box}><h1>Of this</h1><p>{text}</p><p>{text}</p></body>", html_mincut.fitted()) == f"Of this {text.strip()} {text.strip()}"


def test_a_page_of_many_blocks():
    import time

    rng = random.Random(1)
    page = "".join(rng.choice(["<p>%s</p>", "<div>%s</div>", "<li>%s</li>", "<div><p>%s</p></div>"]) % ("word " * rng.randint(1, 12)) for _ in range(50_000))
    began = time.time()
    found = html_mincut.blocks(page)
    assert len(found) == 50_000 and len(html_mincut.labels(found, html_mincut.fitted())) == 50_000
    n = 30_000
    gain, edges = [rng.uniform(-1, 1) for _ in range(n)], [(i, i + 1, 1.5) for i in range(n - 1)] + [(i, i + 7, 0.7) for i in range(0, n - 7, 3)]
    assert len(html_mincut.minimum_cut(gain, edges)) == n
    assert time.time() - began < 60


def test_chat(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Why?\nReally?"), (1, 2, "assistant", "Because.\nIt is so."), (4, 0, "user", "Twice."), (4, 0, "user", "Twice."), (2, None, "user", None), (3, 0, None, "hello"), (None, 0, "user", "x <|end|>")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {}
    for r in sorted(chat_hmm.turns_of_pieces(chat_hmm.pieces(df)).collect(), key=lambda r: r.turn_no):
        got.setdefault(r.conv_id, []).append((r.role, r.rendered))
    assert [r for r, _ in got[1]] == ["system", "user", "assistant"] and [r for r, _ in got[4]] == ["user", "user"]
    assert got[1][1][1] == "<|user|>\nWhy?\nReally?\n<|end|>\n"
    assert got[2] == [("user", "<|user|>\n\n<|end|>\n")] and got[3] == [("user", "<|user|>\nhello\n<|end|>\n")]
    assert got[None] == [("user", "<|user|>\nx <||end|>\n<|end|>\n")]
    assert chat_hmm.turns_of_pieces(chat_hmm.pieces(df.limit(0))).count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 13])
def test_a_transcript_spread_over_tasks(spark, partitions):
    """However pieces are spread, turns are those of one run over the whole transcript."""
    rng = random.Random(partitions)
    marks = ["User: ", "Assistant: ", "System: ", "Tool: ", "", "", "\n", "\n", "[USER] ", "**Narrator:** ", "Question: ", "\n\n"]
    rows = []
    for conv, n in enumerate([400, 1, 2, 90, 3, 5, 1, 200, 7]):
        rows += [(conv, k, rng.choice(["", "", "\n"]) + rng.choice(marks) + rng.choice(["", " ", "words stand here", "who goes?", "x" * 300, "a\nb", "User: not me", "Note: this"])) for k in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, place long, piece string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for r in chat_hmm.turns_of_pieces(df).collect():
            got.setdefault(r.conv_id, []).append((r.turn_no, r.rendered))
        rates = chat_hmm.rates_of(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tally = chat_hmm.Tally()
    for conv in {c for c, _, _ in rows}:
        tally.whole(chat_hmm.read("\n".join(p for c, _, p in rows if c == conv))[0])
    assert rates == tally.rates()
    for conv in {c for c, _, _ in rows}:
        text = "\n".join(p for c, _, p in rows if c == conv)
        want = [chat_hmm.render([t]) for t in chat_hmm.parse(text, rates)]
        assert [x for _, x in sorted(got.get(conv, []))] == want, conv
        assert [k for k, _ in sorted(got.get(conv, []))] == list(range(len(want)))


def brute_roles(text):
    """The best path by trying all."""
    lines, _ = chat_hmm.read(text)
    way, best = chat_hmm.example(lines), (-math.inf, None)
    n = chat_hmm.N
    for states in itertools.product(range(2 * n), repeat=len(lines)):
        score = 0.0
        for k, (line, s) in enumerate(zip(lines, states, strict=True)):
            first, later = chat_hmm.seen(line, way)
            r, opens = s % n, s < n
            if k == 0:
                score += (chat_hmm.LOG_FIRST[r] if opens else -math.inf) + first[r]
            else:
                b = states[k - 1] % n
                score += chat_hmm.LOG_AFTER[b][r] + first[r] if opens else (chat_hmm.LOG_STAY if b == r else -math.inf) + later[r]
        best = max(best, (score, [(s % n, s < n) for s in states]))
    return best


@pytest.mark.parametrize("text", ["User: hi\nAssistant: so\nwell", "hello\n\nwhat?\n\nthis", "[USER] a\nUser: b\n[BOT] c", "Q: why?\nA: so\nNote: x"])
def test_viterbi_is_the_best_path(text):
    lines, _ = chat_hmm.read(text)
    now, back = chat_hmm.forward(lines, chat_hmm.example(lines), None)
    score, states = brute_roles(text)
    assert max(now) == pytest.approx(score) and chat_hmm.path(back, chat_hmm.best_of(now)) == states


@pytest.mark.parametrize(
    ("text", "roles"),
    [
        ("User: hi\nAssistant: hello\nthere\nUser: bye", ["user", "assistant", "user"]),
        ("Human> what is it?\n\nIt is a thing that goes on.\n\nWho says so?", ["user", "assistant", "user"]),
        ("### System\nRules\n### User\nhi\n### Assistant\nyes", ["system", "user", "assistant"]),
        ("User: he said\nUser: not me\nand left\nAssistant: yes", ["user", "assistant"]),
        ("User: hi\nQuestion: what?\nAssistant: yes", ["user", "assistant"]),
        ("Q: what?\nA: this\nQ: why?\nA: so", ["user", "assistant", "user", "assistant"]),
        ("User: hi\nAssistant: I look\nTool: 42\nAssistant: it is 42", ["user", "assistant", "tool", "assistant"]),
        ("[USER] hi\n\n[NARRATOR] night falls\n\n[BOT] yes", ["user", "narrator", "assistant"]),
        ("", []),
        ("\n \n", []),
        ("x " * 100_000, ["user"]),
    ],
)
def test_viterbi(text, roles):
    assert [r for r, _ in chat_hmm.parse(text)] == roles
    assert [r for r, _ in chat_hmm.parse(None)] == []


MARKED = [
    "<|user|>\nhi\n<|assistant|>\npara one.\n\npara two.\n\npara three.\n<|user|>\nok",
    "User: a\nAssistant: one\n\ntwo",
    "User: how?\n\nAssistant: so:\n\n- x\n\n- y\n\n1. z\n\n```\nfoo = 1\n\nbar: 2\n```\n\nWhat else?\n\nUser: thanks\n\nbye",
    "**User:** q\n\n**Assistant:** Note: keep this\n\nWarning: and this\n\n**User:** > Assistant: quoted\n\nend",
    "### User\nq\n\n### Assistant\n\n# Title\n\n" + "word " * 80 + "\n\nlast",
]


@pytest.mark.parametrize("text", MARKED)
def test_marked_turns_are_never_split(text):
    """Paragraphs, lists, code, quotes and names before a colon stay in their turn."""
    got = chat_hmm.parse(text)
    assert [r for r, _ in got] == ["user", "assistant", "user"][: len(got)] and len(got) == sum(chat_hmm.MARKER.match(x) is not None and chat_hmm.read(x)[0][0].way() is not None for x in text.split("\n") if x.strip())


def test_a_table_of_marked_transcripts_is_never_split(spark):
    rows = [(k, n, ["User: a\n\nb", "Assistant: one\n\ntwo\n\n- three\n\nx = 4"][n % 2]) for k in range(30) for n in range(4)]
    # a few transcripts of another style have turns without a marker
    rows += [(100 + k, n, "\n" + x) for k in range(20) for n, x in enumerate(["[USER] a", "[BOT] b", "c?", "[BOT] d", "e?"])]
    df = spark.createDataFrame(rows, "conv_id long, place long, piece string")
    got = {}
    for r in chat_hmm.turns_of_pieces(df).collect():
        got.setdefault(r.conv_id, []).append((r.turn_no, r.role))
    for k in range(30):
        assert sorted(got[k]) == [(0, "user"), (1, "assistant"), (2, "user"), (3, "assistant")]
    for k in range(20):
        assert [r for _, r in sorted(got[100 + k])] == ["user", "assistant", "user", "assistant", "user"]


def test_words_of_a_turn_stay():
    assert chat_hmm.parse("User: hi\nQuestion: what?\nAssistant: yes")[0] == ("user", "hi\nQuestion: what?")


def brute_groups(rows, percent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in rows}
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_near_duplicates(docs, none):
    got = by_id(minhash_forest.groups(docs))
    want = brute_groups(list(enumerate(texts())))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert minhash_forest.groups(docs).count() == docs.count()
    assert minhash_forest.groups(none).count() == 0
    kept = minhash_forest.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in want.values()})


def test_near_duplicates_around_one_text(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(400)]
    rows = [(500, " ".join(base))]
    for k in range(160):
        words = list(base)
        for at in rng.sample(range(400), 5):
            words[at] = f"x{k}-{at}"
        rows.append((k, " ".join(words)))
    got = by_id(minhash_forest.groups(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute_groups(rows)
    assert {d: r.component_id for d, r in got.items()} == {d: c for d, (_, c) in want.items()}


def variant(base, places, tag):
    words = list(base)
    for at in places:
        words[at] = f"{tag}-{at}"
    return words


def test_near_duplicates_around_two_texts(spark):
    rng = random.Random(9)
    a = [f"w{k}" for k in range(304)]
    b = variant(a, [40, 110, 180, 250], "b")
    spots = range(4, 300, 6)
    rows = [(900, " ".join(a)), (901, " ".join(b))]
    rows += [(k, " ".join(variant([a, b][k % 2], rng.sample(spots, 4), f"x{k}"))) for k in range(200)]
    got = by_id(minhash_forest.groups(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute_groups(rows)
    assert len({c for _, c in want.values()}) == 1
    assert {d: r.component_id for d, r in got.items()} == {d: c for d, (_, c) in want.items()}


def test_near_duplicates_without_centre(spark):
    rng = random.Random(10)
    base = [f"w{k}" for k in range(304)]
    rows = [(k, " ".join(variant(base, rng.sample(range(4, 300, 6), 5), "y"))) for k in range(160)]
    got = by_id(minhash_forest.groups(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute_groups(rows)
    assert {d: r.component_id for d, r in got.items()} == {d: c for d, (_, c) in want.items()}


def test_a_hub_is_salted(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "HOT", 5)
    sets = spark.createDataFrame([(k, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10 + k % 3]) for k in range(60)] + [(100, [50])], "id long, shingles array<long>")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(k, 100) for k in range(60)] + [(3, 4), (7, 8)], "a long, b long")
    got = {(r.a, r.b) for r in minhash_forest.confirmed(pairs, sets, 85).collect()}
    assert got == {(0, k) for k in range(3, 60, 3)}
    assert {(r.a, r.b) for r in minhash_forest.confirmed(pairs, sets, 80).collect()} == {(0, k) for k in range(1, 60)} | {(3, 4), (7, 8)}


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(9)
    for n, m in ((5, 7), (400, 420), (900, 700), (5000, 300), (9000, 9000)):
        pool = rng.integers(0, 1 << 63, n + m, np.uint64)
        x, y = np.unique(pool[:n]), np.unique(pool[n // 2 : n // 2 + m])
        apart = len(np.setxor1d(x, y))
        got = minhash_forest.differing(minhash_forest.parities(x), minhash_forest.parities(y))
        assert got <= apart and got % 2 == apart % 2 and (got > 0.6 * apart or n > 4 * m)


def test_common_prefix():
    rows = np.array([[1, *[0, 0, 0, 7] * 8], [1, *[0, 0, 0, 7] * 5, 0, 0, 0, 8, *[0, 0, 0, 7] * 2], [2, *[0, 0, 0, 7] * 8], [2, *[0, 0, 0, 7] * 8]], np.uint8)
    assert minhash_forest.common_prefix(rows[1:], rows[:-1]).tolist() == [5, 0, 8]


def test_rules(docs, none):
    got = by_id(fertility_rules.verdicts(docs, PIECES, BYTES))
    for k, t in enumerate(texts()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + j for i, x in enumerate(triples) if triples.count(x) > 1 for j in range(3)} if len(w) < 2000 else None
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got[k].n_words == len(w) and got[k].word_chars == sum(map(len, w))
        assert got[k].n_symbols == len(re.findall(r"[#*$%&|<>]", t or "")) and got[k].n_dup_lines == len(lines) - len(set(lines))
        if covered is not None:
            assert got[k].n_repeat_words == len(covered)
        assert got[k].base_failed == (len(w) < 50 or 100 * got[k].n_repeat_words > 50 * len(w))
        assert not (got[k].base_failed and got[k].kept)
    assert got[2].kept
    assert fertility_rules.verdicts(docs, PIECES, BYTES).count() == docs.count()
    assert fertility_rules.verdicts(none, PIECES, BYTES).count() == 0


def fertility(text, pieces, lib):
    """The measures, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    ids = [i for w in words for i in pieces.encode(w)]
    if not ids:
        return [0.0] * 4
    counts = np.array([ids.count(i) for i in set(ids)])
    p = counts / len(ids)
    chars, n = sum(map(len, words)), len(ids)
    entropy = float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 0.0
    return [chars / n, chars / sum(len(lib.encode(" " + w, add_special_tokens=False).ids) for w in words), sum(pieces.is_byte(i) for i in ids) / n, entropy]


def test_bands_by_brute_force(spark, docs):
    import sentencepiece
    from tokenizers import Tokenizer

    pieces, lib = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
    rng = random.Random(12)
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang")
    letters = ["".join(rng.choice("bcdfgk") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    more = [(1000 + k, " ".join(rng.choice(["the", "old", "house", "stands", "near", "water", "and", "is", "small"] + letters[: 40 * (k % 2)]) for _ in range(80)), ["en", None][k % 3 == 0]) for k in range(40)]
    more += [(2000, " ".join("§" + rng.choice(letters) + "¶" for _ in range(90)), "en"), (2001, "漢字 " * 20 + " ".join(f"\u0f40{k}" for k in range(60)), "en")]
    both = plain.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in fertility_rules.verdicts(both, PIECES, BYTES).collect()}
    rows = {r.doc_id: (r.text or "", r.lang if r.lang is not None else f"script {fertility_rules.script(r.text or '')}") for r in both.collect()}
    own = {d: fertility(t, pieces, lib) for d, (t, _) in rows.items()}
    names, inside = list(fertility_rules.LEAST), {}
    for band in {b for _, b in rows.values()}:
        good = [d for d, (_, b) in rows.items() if b == band and not got[d].base_failed]
        for k, m in enumerate(names):
            v = sorted(own[d][k] for d in good)
            if v:
                low, high = (v[-(-len(v) * q // 4) - 1] for q in (1, 3))
                reach = max((high - low) * fertility_rules.REACH[m], fertility_rules.LEAST[m])
                inside[band, m] = (low - reach - 1e-9, high + reach + 1e-9)
    for d, (_, band) in rows.items():
        assert [getattr(got[d], m) for m in names] == pytest.approx(own[d], abs=1e-9), d
        want = not got[d].base_failed and all(a <= own[d][k] <= z for k, m in enumerate(names) for a, z in [inside[band, m]])
        assert got[d].kept == want, d
    assert {got[d].kept for d in rows if not got[d].base_failed} == {True, False}


def test_repeated_words(monkeypatch):
    m = fertility_rules.measures(PIECES, BYTES)
    texts = ["a a a a", "a b c d a b c", "x\nx\n \n \ny", "", "a b c", "a b c"]
    monkeypatch.setattr(fertility_rules, "REMEMBERED", 2)
    got = m.all(texts)
    assert got[4].tolist() == [4, 6, 0, 0, 0, 0] and got[3].tolist() == [0, 0, 1, 0, 0, 0]
    monkeypatch.setattr(fertility_rules, "REMEMBERED", 10**6)
    assert all((x == y).all() for x, y in zip(got, m.all(texts), strict=True))


def test_classifier(spark, none):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "house", "is", "old", "and", "small", "today"]) for _ in range(60)) + "."
    rows = [(k, good() if k % 4 else re.sub(" ", "### ", good()), None, None, None, None, None, None) for k in range(400)] + [(900, None, None, None, None, None, None, None), (None, "x", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(400)] + [(None, 1), (5000, None)], "doc_id long, quality int")
    net = byte_cnn.train(docs, labels)
    got = by_id(byte_cnn.score(docs, net))
    held = [k for k in range(400) if got[k].held_out]
    assert set(held) == {k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1}
    assert sum(got[k].predicted == int(k % 4 > 0) for k in held) >= 0.97 * len(held)
    assert 0 <= got[900].score <= 1
    kept = byte_cnn.keep_good(docs, net)
    assert kept.schema == docs.schema and kept.count() < docs.count()
    assert byte_cnn.score(none, net).count() == 0
    assert {r.score for r in byte_cnn.score(docs, byte_cnn.train(docs, labels.limit(0))).collect()} == {0.5}


def test_classifier_on_odd_labels(spark):
    """Repeated rows on both sides, ties, clashing columns and very long texts."""
    rng = random.Random(7)
    good = lambda n: " ".join(rng.choice(["the", "house", "is", "old"]) for _ in range(n)) + "."
    rows = [(k, good(50) if k % 2 else "### " * 60, 1, "x") for k in range(120)]
    rows += rows[:30] + [(3, "### " * 60, 1, "x"), (500, good(60_000), 1, "x"), (501, "### " * 60_000, 1, "x"), (None, good(9), 1, "x"), (500, None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, lang string")
    labels = spark.createDataFrame([(k, k % 2, "y") for k in range(120)] * 2 + [(0, 1, "y"), (500, 1, "y"), (None, 0, "y"), (7, None, "y")], "doc_id long, quality int, text string")
    net = byte_cnn.train(docs, labels)
    got = byte_cnn.score(docs, net).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(by_text[k]) == 1 for k in range(30) if k != 3) and len(by_text[500]) == 2
    assert max(by_text[500]) > 0.9 and max(by_text[501]) < 0.1
    assert byte_cnn.train(docs, labels, sample=1).scores(["x"]) == [0.5]


def plain_score(net, text):
    """The network byte by byte: filters over the text and the zeros behind it, chunks of places, means and maxima."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(int).tolist()
    if not raw:
        return 1 / (1 + math.exp(-net.offset))
    cells = -(-len(raw) // byte_cnn.CELL)
    padded = raw + [0] * (cells * byte_cnn.CELL - len(raw) + byte_cnn.WIDTH - 1)
    answers = [[max(0.0, sum(float(net.tables[j][padded[i + j]][f]) for j in range(byte_cnn.WIDTH)) + float(net.bias[f])) for f in range(byte_cnn.FILTERS)] for i in range(cells * byte_cnn.CELL)]
    width, hop = byte_cnn.CELLS * byte_cnn.CELL, byte_cnn.HOP * byte_cnn.CELL
    starts = [0] if cells <= byte_cnn.CELLS else list(range(0, (cells - byte_cnn.CELLS + byte_cnn.HOP) * byte_cnn.CELL, hop))
    chunks = [[max(row[f] for row in answers[s : s + width]) for f in range(byte_cnn.FILTERS)] for s in starts]
    logit = net.offset
    for f in range(byte_cnn.FILTERS):
        column = [c[f] for c in chunks]
        logit += float(net.mean_w[f]) * sum(column) / len(column) + float(net.max_w[f]) * max(column)
    return 1 / (1 + math.exp(-logit))


def test_scores_are_the_plain_networks():
    net = byte_cnn.fit(["a b c " * 70, "d e f " * 90, "x"] * 20, [0, 1, 1] * 20, epochs=2)
    texts = ["", "a", "d e", "a b c " * 40, "é" * 130, "d e f g h " * 61, "xyz " * 300]
    assert net.scores(texts) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-5)


def test_every_byte_counts():
    net = byte_cnn.fit(["a" * 300, "b" * 300] * 20, [0, 1] * 20, epochs=2)
    text = "a" * 10_000
    assert net.scores([text]) != net.scores([text[:-4] + "bbbb"])
    assert net.scores(["", "x", text]) == [net.scores([t])[0] for t in ("", "x", text)]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):
        c = rng.standard_normal(16)
        rows += [(g * 100 + k, [float(x) for x in c + 0.12 * rng.standard_normal(16)], g % 2) for k in range([1, 2, 9, 40, 3, 700][g] if g < 5 else 90)]
    rows += [(1000, rows[0][1], rows[0][2]), (1001, rows[0][1], 1 - rows[0][2]), (1002, None, 0), (1003, [0.0] * 16, 0), (1004, [float("nan")] * 16, 0), (1005, [1.0, None], 0), (1006, rows[0][1], None), (1007, [], 0), (1008, [1e300, 1e300], 1), (1009, [2e300, 2e300], 1), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, id string")
    got = embedding_passes.groups(df).collect()
    assert len(got) == len(rows)
    links = {}
    for k, (a, v, x) in enumerate(rows):
        for b, w, y in rows[:k]:
            if v is None or w is None or x is None or x != y or len(v) != len(w) or not len(v):
                continue
            p, q = np.array(v, float), np.array(w, float)
            if np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any():
                p, q = p / np.abs(p).max(), q / np.abs(q).max()
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93:
                    links.setdefault(a, set()).add(b)
                    links.setdefault(b, set()).add(a)
    for r in got:
        if r.vec_id is not None:
            assert r.n_links == len(links.get(r.vec_id, ())), r
            seen, todo = {r.vec_id}, [r.vec_id]
            while todo:
                for n in links.get(todo.pop(), ()):
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            assert r.component_id == min(s for s in seen if s is not None), r
            assert r.kept == (r.vec_id == r.component_id)
    assert embedding_passes.groups(df.limit(0)).count() == 0


def test_wide_component_counts(spark, monkeypatch):
    monkeypatch.setattr(embedding_passes, "BLOCK", 8 * 2 * 8)
    monkeypatch.setattr(embedding_passes, "TILE", 3)
    v = [[1.0, 0.01 * k] for k in range(40)]
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    assert {r.n_links for r in embedding_passes.groups(df).collect()} == {39}


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_recall_of_the_passes(spark, n):
    """Lone pairs just above the limit, among so many others of their label, by the passes alone."""
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 64))
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    lone = n // 4
    w = rng.standard_normal((lone, 64))
    w -= (w * v[:lone]).sum(1, keepdims=True) * v[:lone]
    w /= np.sqrt((w * w).sum(1, keepdims=True))
    c = rng.uniform(0.9301, 0.95, (lone, 1))
    v[lone : 2 * lone] = c * v[:lone] + np.sqrt(1 - c * c) * w
    df = spark.createDataFrame([(k, 1, x) for k, x in enumerate(v.tolist())], "id long, label int, vector array<double>")
    got = {(r.a, r.b) for r in embedding_passes.pass_links(df, 0.93).collect()}
    want = {(k, lone + k) for k in range(lone)}
    assert got == got & want and len(got) >= 0.9 * lone, len(got) / lone


def test_nearly_tied_cosines(spark):
    v = [[1.0, 0.0], [0.93, math.sqrt(1 - 0.93**2)], [0.9299, math.sqrt(1 - 0.9299**2)], [0.9301, math.sqrt(1 - 0.9301**2)]]
    df = spark.createDataFrame([(k, x, "a") for k, x in enumerate(v)] + [(1, v[1], "a"), (9, v[0], "b")], "vec_id long, embedding array<double>, label string")
    got = {(r.vec_id, r.n_links) for r in embedding_passes.groups(df).collect()}
    u = np.array([x for x in v] + [v[1]])
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    want = {(int(k), int(n) - 1) for k, n in zip([0, 1, 2, 3, 1], (u @ u.T >= 0.93).sum(1), strict=True)}
    assert got == want | {(9, 0)}


def test_dense_region_of_embeddings(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    centre /= np.sqrt(centre @ centre)
    v = np.repeat(np.sqrt(0.88) * centre + np.sqrt(0.12 / 64) * rng.standard_normal((400, 64)), 2, axis=0) + np.sqrt(0.06 / 64) * rng.standard_normal((800, 64))
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_passes.groups(df).collect()}
    u = v / np.sqrt((v * v).sum(1, keepdims=True))
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    want = list(range(800))
    for _ in want:
        least = [min([want[k], *(want[n] for n in np.flatnonzero(near[k]))]) for k in range(800)]
        if least == want:
            break
        want = least
    assert near.any() and [got[k].n_links for k in range(800)] == near.sum(1).tolist()
    assert [got[k].component_id for k in range(800)] == want


def test_near_duplicate_stage_from_80_percent(spark):
    import corpus_pipeline

    rng = random.Random(11)
    rows = []
    for k in range(20):
        base = [f"w{k}-{i}" for i in range(304)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(variant(base, rng.sample(range(4, 300, 6), 6 if k < 15 else 8), "z")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == {c for _, c in brute_groups(rows, 80).values()} and len(kept) == 25


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No rows at all; rows without doc_id, repeated doc_id, clashing columns."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, copies long, row_key string"
    rows = [(k, t, "fr", "a", 1, 2, "r") for k, t in enumerate(texts()) if k < 14] + [(None, texts()[1], "fr", "a", 1, 2, "r"), (None, None, None, None, None, None, None), (3, texts()[4], "fr", "b", 1, 2, "r"), (3, texts()[3], "fr", "a", 1, 2, "r")]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for name, docs in (("some", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            found = stage(spark, found, f"{tmp_path}/{name}")
            if k < 4:
                assert found.columns == docs.columns
                found = Scratch(spark, "odd").save(found, f"{name}{k}")
        assert (found.count() > 0) == (name == "some")


def test_pipeline_rows(spark, tmp_path):
    """run() against its stages' brute force: scores, verdicts, groups, copies, the library's ids."""
    import corpus_pipeline
    import sentencepiece

    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    plain = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 140))) + "." for _ in range(60)]
    rows = [(k, plain[k % 50] if k % 3 else plain[k % 50] + " fin", "fr", "abc"[k % 3], 9) for k in range(120)] + [(200 + k, "### $$ " * 40, "fr", "a", 9) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 200)) for k, *_ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = byte_cnn.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [r for r, s in zip(rows, net.scores([r[1] for r in rows]), strict=True) if s >= 0.5]
    kept = by_id(fertility_rules.verdicts(spark.createDataFrame(left, docs.schema), PIECES, BYTES))
    left = [r for r in left if kept[r[0]].kept]
    groups = brute_groups([(r[0], r[1]) for r in left], 80)
    left = [r for r in left if groups[r[0]][1] == r[0]]
    copies = by_id(source_mix.mix(spark.createDataFrame(left, docs.schema)))
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((r[0], len(lib.encode(r[1])), hashlib.sha256(",".join(map(str, lib.encode(r[1]))).encode()).hexdigest()) for r in left for _ in range(copies[r[0]].copies))
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len({d for d, _, _ in got}) > 20


def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, BASE * 2 + t, "fr", "a", 1) if t and len(t) > 300 else (k, t, "fr", "b", 1) for k, t in enumerate(texts())], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 2)) for k in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= set(range(len(texts())))
    rules = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    kept = by_id(fertility_rules.verdicts(docs, PIECES, BYTES))
    assert {r.doc_id for r in rules.collect()} == {d for d, r in kept.items() if r.kept}
    mixed = corpus_pipeline.source_mixing(spark, docs, str(tmp_path))
    copies = by_id(source_mix.mix(docs, key="doc_id"))
    twice = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    assert corpus_pipeline.source_mixing(spark, twice, str(tmp_path)).count() == source_mix.mix(twice).agg(F.sum("copies")).first()[0]
    assert {(r.doc_id, r["count"]) for r in mixed.groupBy("doc_id").count().collect()} == {(d, r.copies) for d, r in copies.items() if r.copies}
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_workers_forget_what_other_operators_remember(spark):
    """Workers keep no words behind a stage, and no model once another operator's task began."""
    import pyarrow as pa

    docs = spark.range(0, 64, 1, 64).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six "), "id").alias("text"))

    def left(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([len(minhash_forest._words) + len(sentencepiece_codec._codecs)])], ["n"])

    sentencepiece_codec.digests(docs, public_tokenizers.path("piece_bpe_32k.model")).write.format("noop").mode("overwrite").save()
    minhash_forest.fingerprints(docs, 85, (np.array([], np.uint64), np.array([], np.int64))).write.format("noop").mode("overwrite").save()
    assert spark.range(0, 64, 1, 64).mapInArrow(left, "n long").agg(F.max("n")).first()[0] == 0
