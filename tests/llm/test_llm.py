"""Each operator on small tables: brute force, round trips and the odd cases."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import DATA, same_as_sql
from tidefold.llm import chat, embed_dedup, induced, langid, line_rules, mixing, pieces, quality_nbsvm, queries, repeats, simhash, toxicity
from tidefold.llm.common import components, held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t ", "one", "one two three", "é ü 漢字 😀 ▁ \x00 end", "a" * 3000, "word " * 3000, "tie tie tie tie", "tie tie tie tie", "é" * 400]


def docs(spark, texts, ids=None, extra=True):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 2}", None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)
    for c in ("size", "count", "score", "fp", "label", "_text", "_block", "shard", "chunk") if extra else ():
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- shared ---------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    same_as_sql(queries.queries()[name](spark, DATA), duck, queries.oracle_sql()[name])


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(20)] + [(None, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links[:-1]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    expected = {(n, find(n)) for a, b in links[:-1] if a != b for n in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {(r.node, r.component) for r in got} == expected and len(got) == len(expected)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- 1 chat ---------------------------------------------------------------


def test_chat_round_trip(spark):
    turns = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, None), (2, 0, "assistant", "### User: x</turn>\n\\h \\# <"), (2, 1, "od:d@r", "</turn>"), (None, 0, "assistant", ""), (3, 0, "@User", "#" * 2000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("tree", F.lit(2))
    out = chat.formatted(chat.linear_replies(df, span=1), F.length("text"))
    rows = out.select("tree", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    got = {None if r.tree.none else r.tree.id: ([tuple(x) for x in r.back], r.loss) for r in rows}
    assert got == {
        1: ([("", ""), ("user", "a"), ("user", "a"), ("user", "b")], ""),
        2: ([("assistant", "### User: x</turn>\n\\h \\# <"), ("od:d@r", "</turn>")], "### User: x</turn>\n\\h \\# <"),
        None: ([("assistant", "")], ""),
        3: ([("@User", "#" * 2000)], ""),
    }
    assert chat.formatted(chat.linear_replies(df.limit(0)), F.lit(0.0)).count() == 0


def test_chat_tree_paths(spark):
    rng = np.random.default_rng(4)
    parent = {i: None if i < 2 else int(rng.integers(0, i)) for i in range(40)}
    score = {i: float(rng.integers(0, 9)) for i in parent}
    rows = [(t, i, p, "user", f"t{i}", score[i]) for t in (0, 1) for i, p in parent.items()]
    df = spark.createDataFrame(rows, "tree int, node int, parent int, role string, text string, s double")
    paths = {}
    for leaf in set(parent) - set(parent.values()):
        path, at = [], leaf
        while at is not None:
            path.insert(0, at)
            at = parent[at]
        paths[leaf] = path
    best = sorted(paths, key=lambda x: (-np.mean([score[i] for i in paths[x]]), -len(paths[x]), x))[:3]
    got = {}
    for r in chat.ranked_paths(df, F.col("s"), 3).where("tree = 1").collect():
        got.setdefault((r.path_rank, r.leaf), []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(i + 1, x): paths[x] for i, x in enumerate(best)}
    cycle = spark.createDataFrame([(0, 1, 2, "user", "x", 1.0), (0, 2, 1, "user", "y", 1.0)], df.schema)
    assert chat.ranked_paths(cycle, F.col("s")).count() == 0


# --- 2 suffix-array dedup --------------------------------------------------


def test_induced_sorting_is_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(60):
        parts = [bytes(rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 12))]
        parts += parts[: trial % 3]
        text = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8).astype((np.uint8, np.int64)[trial % 2])
        suffixes, at = {}, 0
        for p in parts:
            suffixes |= {at + i: p[i:] for i in range(len(p))}
            at += len(p) + 1
        pos, prefix = induced.suffixes(text, text == 0, 10, memory_rows=(1 << 20, 8, 3, 1)[trial % 4])
        assert sorted(pos.tolist()) == sorted(suffixes)
        order = [suffixes[p] for p in pos.tolist()]
        assert order == sorted(order)
        common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
        assert prefix.tolist() == [0] + [min(10, common(a, b)) for a, b in zip(order, order[1:], strict=False)]


def test_sorting_spills_and_recurses_in_little_memory():
    """A text of which the budget holds a fiftieth."""
    import tracemalloc

    rng = np.random.default_rng(0)
    words = [bytes(w) for w in rng.integers(97, 123, (400, 8)).astype(np.uint8)]
    text = np.frombuffer(b"".join(b" ".join(words[i] for i in rng.integers(0, 400, 8)) + b"\0" for _ in range(6000)), np.uint8)
    levels = []
    tracemalloc.start()
    pos, prefix = induced.suffixes(text, text == 0, 50, memory_rows=1 << 13, levels=levels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    names, spills = [x for x in levels if isinstance(x, int)], [x for x in levels if isinstance(x, tuple)]
    assert len(names) >= 2 and min(spills[-1]) > 0 and peak < 20 * len(text)
    assert len(pos) == np.count_nonzero(text)
    raw, at = text.tobytes(), rng.integers(1, len(pos), 2000)
    suffix = lambda p: raw[p : raw.index(b"\0", p)]
    for i in at.tolist():
        a, b = suffix(pos[i - 1]), suffix(pos[i])
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert a <= b and prefix[i] == min(50, same)


def brute_removed(rows, width=50):
    first = {}
    big = 1 << 62
    for i, b in rows:
        for p in range(len(b) - width + 1):
            k = b[p : p + width]
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, b in rows:
        mask = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < (big if i is None else i):
                mask[p : p + width] = b"\1" * width
        out.append((i, len(b), bytes(x for x, m in zip(b, mask, strict=True) if not m), sum(1 for r in bytes(mask).split(b"\0") if r)))
    return sorted(out, key=str)


def test_removed_is_brute_force(spark):
    rng = np.random.default_rng(2)
    passage = " ".join(f"w{x}" for x in rng.integers(0, 500, 60))
    texts = [*ODD, "x" * 200, "ab" * 300, "y" + "x" * 120]
    for i in range(30):
        own = " ".join(f"v{x}" for x in rng.integers(0, 300, 40))
        cutoff = int(rng.integers(0, 200))
        texts.append(own + passage[cutoff : cutoff + int(rng.integers(40, 200))] + own[::-1] if i % 3 else "é" * 30 + passage)
    texts += [texts[-1], texts[-1]]
    ids = [*rng.permutation(len(texts) - 1).tolist(), None]
    ids[5] = ids[4]
    df = docs(spark, texts, ids)
    got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in repeats.removed(df, ["doc_id", "size"], block_bytes=20_000, shard_bytes=5_000, memory_rows=50).collect()), key=str)
    assert got == brute_removed([(i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)])
    for r in repeats.removed(df, ["doc_id"], whole_characters=True).collect():
        bytes(r.kept).decode()
    assert repeats.removed(df.limit(0), ["doc_id"]).count() == 0


def test_an_anchor_of_many_variants_is_dealt_out(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    digits = [" ".join(map(str, x)) for x in rng.integers(0, 10**9, (40_000, 5)).tolist()]
    texts = [f"{a} see also: http://example.org/ {b}" for a, b in zip(digits[::2], digits[1::2], strict=True)]
    texts += [texts[i][c : -1 - c] for i, c in zip(rng.integers(0, 20_000, 90).tolist(), [0, 20, 40] * 30, strict=True)]
    folder = str(tmp_path)

    def noted(text, *rest, real=repeats.first_documents, folder=folder):
        open(f"{folder}/{len(text)}", "w").close()
        return real(text, *rest)

    monkeypatch.setattr(repeats, "first_documents", noted)  # reaches the workers with the functions that use it
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in repeats.removed(df, ["doc_id"]).collect()), key=str)
    assert got == brute_removed([(i, t.encode()) for i, t in enumerate(texts)])
    assert 0 < max(int(f.name) for f in tmp_path.iterdir()) < 8192 * 84


def test_short_common_strings_are_not_sorted(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    digits = [" ".join(map(str, x)) for x in rng.integers(0, 10**9, (400, 8)).tolist()]
    texts = [f"{a} the same twenty-four {b}" for a, b in zip(digits[::2], digits[1::2], strict=True)]
    folder = str(tmp_path)

    def noted(text, *rest, real=repeats.first_documents, folder=folder):
        open(f"{folder}/{len(text)}", "w").close()
        return real(text, *rest)

    monkeypatch.setattr(repeats, "first_documents", noted)
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "doc_id long, text string").repartition(4)
    assert not any(r.spans for r in repeats.removed(frame(texts), ["doc_id"]).collect())
    assert max((int(f.name) for f in tmp_path.iterdir()), default=0) == 0
    # longer ones are, or their windows dealt out
    texts = [f"{a} and see also, for what follows: http://example.org/terms/of/use {b}" for a, b in zip(digits[::2], digits[1::2], strict=True)]
    for most in (8192, 20):
        got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in repeats.removed(frame(texts), ["doc_id"], most_variants=most).collect()), key=str)
        assert got == brute_removed([(i, t.encode()) for i, t in enumerate(texts)])


# --- 3 SentencePiece --------------------------------------------------------


@pytest.fixture(scope="module")
def table():
    return pieces.load_pieces()


def edges_of(table, word):
    """(start, end, id, score) of every piece in a word, unknown characters too."""
    by_name = dict(zip(table.names, zip(table.ids, table.scores, strict=True), strict=True))
    longest = max(map(len, table.names))
    out = []
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - longest), e):
            hit = by_name.get(word[s:e]) or ((-1 - ord(word[s]), table.unknown_score) if e - s == 1 else None)
            if hit:
                out.append((s, e, *hit))
    return out


def best_path(table, word):
    """Dynamic programme: the best sum of scores, ties to the longer last piece."""
    at = {0: (0.0, [])}
    for s, e, i, score in edges_of(table, word):
        total = at[s][0] + score
        if e not in at or total > at[e][0]:
            at[e] = (total, (s, i))
    ids, e = [], len(word)
    while e:
        e, i = at[e][1]
        ids.append(i)
    return ids[::-1]


def all_paths(edges, n, s=0):
    if s == n:
        yield 0.0, []
    for a, b, i, score in edges:
        if a == s:
            for total, ids in all_paths(edges, n, b):
                yield score + total, [i, *ids]


def lattice_of(spark, table, words):
    import pyarrow as pa

    key, long = pieces.keys_of(pa.array([w.encode() for w in words]))
    df = spark.createDataFrame([(*x, k) for k, x in enumerate(zip(key.to_pylist(), long.to_pylist(), strict=True))], "key string, long string, least long")
    return {words[r.least]: r.path for r in pieces.lattice(df, table).collect()}


def test_lattice_is_exhaustive_search(spark, table):
    words = ["▁the", "▁unhappi", "▁", "▁▁▁▁▁", "😀", "▁naïveté", "aaaaaaa", "ﬁ漢", "\n", "nesses"]
    got = lattice_of(spark, table, words)
    scores = dict(zip(table.ids, table.scores, strict=True))
    for w in words:
        paths = list(all_paths(edges_of(table, w), len(w)))
        total = sum(scores.get(i, table.unknown_score) for i in got[w])
        assert total == max(t for t, _ in paths) and got[w] in [p for t, p in paths if t == total]
        assert got[w] == best_path(table, w)


def test_long_chunks_stay_in_the_lattice(spark, table):
    rng = np.random.default_rng(1)
    words = ["a" * n for n in (255, 256, 257, 258, 511, 512, 513, 3000)] + ["".join(rng.choice(list("aeioustrnl"), n)) for n in (300, 1200)]
    assert lattice_of(spark, table, words) == {w: best_path(table, w) for w in words}


def test_encoding_round_trip(spark, table, real):
    texts = [*ODD, " leading", "trailing ", "two  spaces", "▁ mark", "▁▁", "a▁b ▁c", "\U0010fffe \U0010ffff", "\n\n", "b" * 700 + " z", "tab\tand\rreturn", " ", "  ", *[r.text for r in real.limit(40).collect()]]
    df = docs(spark, texts)
    out = pieces.encoded(df, ["doc_id", "size", "text"], table, block_bytes=5_000)
    rows = pieces.decoded(out, table).collect()
    assert len(rows) == len(texts) and all(r.exact and r.decoded == (texts[r.doc_id] or "") and r.text == texts[r.doc_id] for r in rows)
    assert next(r for r in rows if r.doc_id == 0).ids == []
    for r in rows:
        t = texts[r.doc_id] or ""
        if "▁" not in t and len(t) < 20_000:
            path = best_path(table, "▁" + t.replace(" ", "▁")) if t else []
            assert pieces.spelled(np.array(path, np.int32), np.array([len(path)]), table)[0].tolist() == r.ids
    assert pieces.encoded(df.limit(0), ["doc_id", "text"], table).count() == 0


def test_encoding_needs_no_key(spark, table):
    df = docs(spark, ["same text", "same text", "other", None, None], [None, None, None, 3, 3])
    rows = pieces.encoded(df, ["doc_id", "text"], table).collect()
    assert sorted((r.text or "", len(r.ids) > 0) for r in rows) == [("", False), ("", False), ("other", True), ("same text", True), ("same text", True)]


def test_inexact_ids_are_told(table):
    import pyarrow as pa

    units = pa.array([b"\xe2\x96\x81the", b"\xe2\x96\x81of"], pa.binary())
    the, of = (table.ids[table.names.index(x)] for x in ("▁the", "▁of"))
    parts = pieces.Decoder(table).parts
    assert pieces.inexact(np.array([the, of], np.int32), np.array([0, 1, 2]), units, parts).tolist() == [False, False]
    assert pieces.inexact(np.array([the, the], np.int32), np.array([0, 1, 2]), units, parts).tolist() == [False, True]


def test_inexact_units_of_other_lengths(table):
    """Units of another length, of the same length with other bytes, with own marks, and without ids."""
    import pyarrow as pa

    parts = pieces.Decoder(table).parts
    units = [b"\xe2\x96\x81the", b"\xe2\x96\x81of", b"\xe2\x96\x81\xed\xa0\x80x", b"", b"\xe2\x96\x81the", b"\xe2\x96\x81a\xe2\x96\x81"]
    right = [[table.byte_ids[b] for b in u.replace(pieces.MARK, b" ").replace(pieces.OWN, pieces.MARK)] for u in units]
    for bad in range(-1, len(units)):
        for change in ([], [table.byte_ids[0]] * 4, [table.byte_ids[0]]):
            ids = [change if k == bad else r for k, r in enumerate(right)]
            wrong = pieces.inexact(np.array([i for x in ids for i in x], np.int32), np.cumsum([0, *map(len, ids)]), pa.array(units, pa.binary()), parts)
            assert wrong.tolist() == [k == bad and change != right[k] for k in range(len(units))]


def test_frequent_chunks_have_the_paths_of_the_lattice(spark, table):
    """Frequent chunks come from several tasks, in order of their bytes."""
    df = docs(spark, ["the one of many, étés 漢字 " * 3 + "aeiou" * k for k in range(8)] * 2)
    known = pieces.frequent_chunks(df, table, 1.0, 20)
    keys = known.chunks.to_pylist()
    assert len(keys) > 10 and keys == sorted(keys)
    assert {k.decode(): known.ids[a:b].tolist() for k, a, b in zip(keys, known.ends[:-1], known.ends[1:], strict=True)} == {k.decode(): best_path(table, k.decode()) for k in keys}


# --- 4 to 6 classifiers -----------------------------------------------------


def test_language(spark, real):
    out = held_out(F.col("doc_id"), 4, 2)
    model = langid.learn(real, ~out)
    rows = langid.predict(real.withColumn("score", F.lit(1)).withColumn("_text", F.lit(2)), model, ["doc_id", "lang"]).where(out & (F.length("lang") > 0)).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.lang_pred != "und"]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    odd = langid.predict(docs(spark, [*ODD, "12 34 !"]), model, ["doc_id"], reject=False).collect()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {0, 1, 2, len(ODD)}
    assert {r.lang_pred for r in langid.predict(docs(spark, ODD), langid.learn(real.limit(0), ~out), ["doc_id"]).collect()} == {"und"}
    assert any(r.narrow and r.lang_pred == "und" for r in langid.predict(real, model, ["doc_id"], min_margin=0.2).collect())


@pytest.mark.parametrize(("kind", "modulus", "rest"), [(toxicity, 4, 2), (quality_nbsvm, 5, 0)])
def test_trained_scores(spark, kind, modulus, rest):
    big = DATA.replace("sf0.001", "sf0.01")
    real, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = held_out(F.col("doc_id"), modulus, rest)
    model = kind.learn(real, labels, ~out)
    name = "toxic" if kind is toxicity else "quality"
    rows = kind.score(real.join(labels, "doc_id"), model, ["doc_id", name]).where(out).collect()
    p, y = np.array([r.score for r in rows]), np.array([r[name] for r in rows])
    d = p[y == 1][:, None] - p[y == 0][None, :]
    assert ((d > 0) + 0.5 * (d == 0)).mean() > 0.75 and p.min() >= 0 and p.max() <= 1
    odd = {r.doc_id: r.score for r in kind.score(docs(spark, ODD), model, ["doc_id"]).collect()}
    assert odd[0] == odd[1] == odd[2] and odd[8] == odd[9]
    none = kind.learn(real, labels.limit(0), ~out)
    assert {r.score for r in kind.score(docs(spark, ["a b", None]), none, ["doc_id"]).collect()} == {0.0}


def test_misspellings_share_vectors(spark):
    rng = np.random.default_rng(0)
    plain = [" ".join(f"w{x}" for x in rng.integers(0, 200, 30)) for _ in range(300)]
    texts = [t + " horrible" if i % 3 == 0 else t for i, t in enumerate(plain)]
    model = toxicity.train(texts, np.array([i % 3 == 0 for i in range(300)]), 1 / 3)
    scorer = toxicity.Scorer(model.odds, model.shape)
    clean, near = model.scores(["w1 w2 w3 w4", "w1 w2 horribble w4"], scorer)
    assert near > 0.3 > clean


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)]
    y = np.array([int(3 in f or 4 in f) for f in x])
    scale = rng.normal(1, 0.3, 30)
    w, b = quality_nbsvm.dual_coordinate_descent(x, scale, y, np.ones(80), 500, 0)
    sign = np.where(y == 1, 1, -1)
    value = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0, 1 - s * ((w * scale)[f].sum() + b)) for f, s in zip(x, sign, strict=True))
    best = value(w, b)
    assert all(value(w + 0.05 * rng.normal(size=30), b + 0.05 * rng.normal()) > best - 1e-2 for _ in range(200))


# --- 7 line rules -------------------------------------------------------------


def test_repeated_windows(spark):
    rng = np.random.default_rng(0)
    words = [[f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 25))] for _ in range(60)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w array<string>")

    def brute(w):
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})

    assert {r.i: r.n for r in df.select("i", line_rules.repeated_window_words(F.col("w")).alias("n")).collect()} == {i: brute(w) for i, w in enumerate(words)}


def test_common_lines_deplete(spark):
    unique = lambda i: " ".join(f"u{i}x{k}" for k in range(60))
    texts = [f"Common  LINE here {'z ' * 5}\n{unique(i)}" for i in range(12)] + ["common line here z z z z z " + "\n" + "\n".join(f"q{k}" for k in range(60)), *ODD]
    df = docs(spark, texts).withColumn("source", F.lit(None).cast("string"))
    rows = {r.doc_id: r for r in line_rules.line_verdicts(df, max_docs=10).collect()}
    assert len(rows) == len(texts) and rows[0].kept and rows[0].removed_chars == 19
    assert rows[13].base_failed and not rows[13].kept and rows[13].n_words == 0
    assert all(r.removed_chars == 0 for r in line_rules.line_verdicts(df, max_docs=13).collect())
    assert all(r.removed_chars == 0 for r in line_rules.line_verdicts(df, max_docs=10, max_share=0.9).collect())
    assert line_rules.line_verdicts(df.limit(0)).count() == 0
    cleaned = {r.doc_id: r.cleaned for r in line_rules.line_verdicts(df, max_docs=10, with_text=True).collect()}
    assert cleaned[0] == unique(0) and cleaned[12] == "\n".join(f"q{k}" for k in range(60)) and [cleaned[13 + i] for i in range(3)] == ODD[:3]


def test_repeated_rows_lose_lines_once(spark):
    common = "the line that all have in common"  # 26 word characters
    unique = lambda i: " ".join(f"u{i}x{k}" for k in range(60))
    texts = [f"{common}\n{unique(i)}\n {common.upper()} " for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 9 + [(1, f"{common}\n{unique(99)}"), (1, unique(98)), (None, texts[2]), (None, texts[2]), (None, unique(97))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("_copy", F.lit("clash"))
    got = [(r.doc_id, r.word_chars, r.removed_chars, r.kept) for r in line_rules.line_verdicts(df, max_docs=12).collect()]
    chars = lambda t: len("".join(t.split()))
    lost = lambda t: 26 * sum(x.split() == common.split() for x in t.lower().split("\n"))
    assert sorted(got, key=str) == sorted([(i, chars(t), lost(t), True) for i, t in rows], key=str)


# --- 8 embeddings -----------------------------------------------------------------


def test_embeddings_are_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    v = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape), base[:5], base[:5] * 3, rng.normal(size=(30, 8))])
    label = rng.integers(0, 3, len(v)).tolist()
    for i in range(5):
        label[80 + i] = label[85 + i] = label[i]
    rows = [(i, [float(np.float32(x)) for x in r], label[i]) for i, r in enumerate(v)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 8, 1), (n + 3, [float("nan")] * 8, 1), (n + 4, [None] * 8, 1), (n + 5, rows[0][1], None), (n + 6, [float("inf")] * 8, 1), (n + 7, rows[0][1][:4], label[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("unit", F.lit(1)).withColumn("rep", F.lit(1))
    x = np.array([r[1] for r in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = (x @ x.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(hit, False)
    root = np.arange(n)
    for _ in range(n):
        root = np.minimum(root, np.where(hit, root[None, :], n).min(1))
    for shape in (embed_dedup.Shape(balance=0.5, chunk=7, nearest=3), embed_dedup.Shape(balance=2.0, sample_bytes=20_000), embed_dedup.Shape()):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, shape).collect()}
        assert len(got) == len(rows)
        assert {i: got[i] for i in range(n)} == {i: (int(hit[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(n)}
        assert all(got[n + k] == (0, n + k, True) for k in range(8))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_need_no_key(spark):
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(None, 0), (None, 0), (5, 8), (3, -8), (9, 90), (9, 97), (9, 180), (None, 270)]
    df = spark.createDataFrame([(i, at(x), 1) for i, x in rows], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in embed_dedup.near_duplicates(df).collect()]
    want = [(None, 3, 3, False), (None, 3, 3, False), (5, 2, 3, False), (3, 2, 3, True), (9, 1, 9, True), (9, 1, 9, True), (9, 0, 9, True), (None, 0, None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


# --- 9 mixing -----------------------------------------------------------------------


def test_water_filling(spark):
    for sizes in ([100, 200, 300, 50], [1000, 1, 1], [0, 5, 5], [7]):
        df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "_src string, source_size long")
        got = [r.target for r in mixing.source_targets(df).orderBy("_src").collect()]
        w, cap, total = np.array([(3, 1, 2)[i % 3] for i in range(len(sizes))]), 2.0 * np.array(sizes), 1.5 * sum(sizes)
        target, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
        while True:
            target = np.where(free, (total - cap[~free].sum()) * w / max(w[free].sum(), 1), cap)
            over = free & (target > cap)
            if not over.any():
                break
            free &= ~over
        assert got == pytest.approx(target.tolist()) and sum(got) == pytest.approx(total)


def test_mixing_comes_near_its_targets(spark, real, monkeypatch):
    rows = mixing.mixed(real, ["doc_id", "source"]).collect()
    assert rows == mixing.mixed(real.repartition(7), ["doc_id", "source"]).orderBy("doc_id").collect() or sorted(rows) == sorted(mixing.mixed(real.repartition(7), ["doc_id", "source"]).collect())
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.size * r.repeats for r in own) - own[0].target) <= max(r.size for r in own)
    assert all(r.repeats <= 2 for r in rows)
    odd = mixing.mixed(docs(spark, ODD).withColumn("repeats", F.lit("clash")), ["doc_id", "size", "repeats", "count"]).collect()
    assert all(r["count"] == "clash" and isinstance(r.repeats, int) for r in odd)
    assert len(odd) == len(ODD) and all(r.repeats <= 2 for r in odd)
    rows.sort(key=str)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(mixing.mixed(real, ["doc_id", "source"]).collect(), key=str) == rows
    assert mixing.mixed(real.limit(0), ["doc_id"]).count() == 0


# --- 10 SimHash -----------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_is_brute_force(spark, real):
    texts = [*ODD, "A B c d E", "a b C d e"]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    native = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s")).first()[0]
    assert native % 2**64 == xxhash.xxh64_intdigest("a b c d", 42)
    near = [" ".join(f"w{x}" for x in np.random.default_rng(i // 4).integers(0, 99, 400)) + f" end{i}" for i in range(40)]
    texts += near
    df = docs(spark, texts)
    rows = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fp = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    hit = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    root = np.arange(len(fp))
    for _ in range(len(fp)):
        root = np.where(hit, root[None, :], len(fp)).min(1)
    assert {i: (rows[i].fp % 2**64, rows[i].component_id) for i in rows} == {i: (int(fp[i]), int(root[i])) for i in range(len(fp))}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_needs_no_key(spark):
    a, b = ("alpha beta gamma delta " * 5).strip(), ("one two three four five " * 5).strip()
    rows = [(None, a), (None, a), (4, b), (2, b), (2, a), (2, None), (None, ""), (9, "w " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("clash"))
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 2), (None, 2), (4, 2), (2, 2), (2, 2), (2, 2), (None, 2), (9, 9)], key=str)


@pytest.mark.parametrize("chunk", [5, 10_000])
def test_trees_lose_no_link(spark, chunk):
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre, *[centre ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(6)]]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(df, 4, chunk, portion=2 * chunk).collect()
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    from tidefold.llm.common import local_roots

    got = local_roots(len(fp), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert np.array_equal(got, local_roots(len(fp), a, b))


def test_digest_of_a_plain_conversation(spark):
    row = queries.op1_chat_format(spark, DATA).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (row.loss_chars, row.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert zlib.crc32(b"0") % 4 != 2
