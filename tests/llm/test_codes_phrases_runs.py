"""Vector codes, phrase dedup and periodic runs against brute force, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.llm import phrase_dedup, vector_codes
from pairlens.llm.periodic_runs import Extensions, collapse_runs, repeat_tails, word_runs
from pairlens.llm.phrase_dedup import remove_phrases
from pairlens.llm.queries import QUERIES
from pairlens.llm.vector_codes import Slicer, encode_vectors, integer_vectors, train_codebooks, with_group_total

WORDS = "river stone light über garden café winter paper Œuvre cloud 42 north-west".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


# Vector codes


def test_slices_find_the_nearest_entry():
    rng = np.random.default_rng(3)
    for _ in range(60):
        spread = int(rng.choice([2, 10, 500, 1 << 24]))
        entries = rng.integers(-spread, spread + 1, (rng.integers(1, 300), rng.integers(1, 17)))
        entries[rng.integers(0, len(entries), len(entries) // 3)] = entries[0]
        rows = rng.integers(-spread, spread + 1, (50, entries.shape[1]))
        gaps = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        entry, gap = Slicer(entries).nearest(rows)
        assert (entry == gaps.argmin(axis=1)).all()
        assert (gap == gaps.min(axis=1)).all()


def test_masks_hold_what_lies_within_the_radius():
    rng = np.random.default_rng(4)
    entries, rows = rng.integers(-50, 51, (130, 3)), rng.integers(-60, 61, (40, 3))
    masks = Slicer(entries).candidates(rows, np.full(40, 17))
    bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :130]
    assert (bits.astype(bool) == (np.abs(rows[:, None] - entries[None]).max(axis=2) <= 17)).all()


def plain_codes(vectors, entries, rounds, parts=4):
    """vectors: (id, floats, label); codes, errors and codebooks in plain Python."""
    kept = [(i, v, label) for i, v, label in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((i, v) for i, v, _ in kept if i is not None)
    if not named:
        return [], ""
    width = len(named[0][1])
    kept = [(i, [int(np.floor(1024 * x)) for x in v], label) for i, v, label in kept if len(v) == width]
    first = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(i, v)
    cut = [width * k // parts for k in range(parts + 1)]
    starts = [first[i] for i in sorted(first)][:entries]
    books = [[s[a:b] for s in starts] for a, b in zip(cut, cut[1:])]
    for turn in range(rounds + 1):
        near = []
        for _, v, _ in kept:
            gaps = [[sum((x - y) ** 2 for x, y in zip(v[a:b], e)) for e in book] for book, a, b in zip(books, cut, cut[1:])]
            near.append([(min(g), g.index(min(g))) for g in gaps])
        if turn == rounds:
            break
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            for e in range(len(books[p])):
                own = [v[a:b] for (_, v, _), n in zip(kept, near) if n[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, "".join(f"{n[1]:02x}" for n in ns), sum(n[0] for n in ns), label) for (i, _, label), ns in zip(kept, near)]
    return out, ",".join(str(x) for book in books for e in book for x in e)


@pytest.mark.parametrize(("count", "heavy"), [(60, 200), (60, 2), (3, 200)])
def test_codes(spark, monkeypatch, count, heavy):
    monkeypatch.setattr(vector_codes, "HEAVY", heavy)
    rng = random.Random(count)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(10)], rng.choice([None, 1, 1, 1, 2, 3])) for k in range(count)]
    rows += [(100, [0.5] * 10, 7), (101, [0.5] * 10, 7), (102, None, 1), (103, [], 1), (104, [float("nan")] * 10, 1)]
    rows += [(105, [0.1] * 9 + [None], 2), (106, [float("inf")] + [0.1] * 9, 2), (107, [0.1] * 9, 2), (None, [0.25] * 10, 3), (5 % count, rows[5 % count][1], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    ints = integer_vectors(table.withColumns({"CODE": F.lit("x"), "Width": F.lit(1)}), "embedding")
    assert ints.columns == ["vec_id", "label", "CODE", "width", "integers"]
    books = train_codebooks(ints, entries=20)
    coded = with_group_total(encode_vectors(ints, books), "label", "error", "label_error")
    want, text = plain_codes(rows, 20, 4)
    assert books.text() == text
    totals = {}
    for _, _, error, label in want:
        totals[label] = totals.get(label, 0) + error
    got = sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label, r.label_error) for r in coded.collect()), key=repr)
    assert got == sorted(((i, c, e, label, totals[label]) for i, c, e, label in want), key=repr)
    one = coded.where("vec_id = 1").first()
    vector = vector_codes.decoded(bytes(one.code), books)
    assert ((vector - np.floor(1024 * np.array(rows[1][1])).astype(int)) ** 2).sum() == one.error


def test_codes_of_no_vectors(spark):
    for rows in ([], [(None, [1.0, 2.0], 1)], [(1, None, 1)]):
        ints = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
        books = train_codebooks(ints)
        assert books.text() == ""
        out = with_group_total(encode_vectors(ints, books), "label", "error", "total").collect()
        assert all(r.code is None and r.error is None for r in out) and len(out) == sum(r[0] is None for r in rows)


def test_huge_and_tied_components(spark):
    rows = [(k, [1e300 * (-1) ** k, 5e4, 0.0, float(k // 2)], 0) for k in range(6)]
    ints = integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    out = encode_vectors(ints, train_codebooks(ints, entries=256, rounds=0)).collect()
    assert {r.vec_id: bytes(r.code).hex() for r in out} == {k: f"{k % 2:02x}0000{k // 2 * 2:02x}" for k in range(6)}
    assert {r.error for r in out} == {0}


# Phrase dedup


def plain_phrases(rows, width=13):
    split = [(float("inf") if i is None else i, (t or "").encode().split()) for i, t in rows]
    owner = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            owner[key] = min(owner.get(key, i), i)
    out = []
    for (i, _), (n, w) in zip(rows, split):
        gone = {p for k in range(len(w) - width + 1) if owner[tuple(w[k : k + width])] < n for p in range(k, k + width)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def phrase_rows(seed):
    rng = random.Random(seed)
    passages = [sentence(rng, rng.choice([13, 14, 30, 90])) for _ in range(6)]
    rows = [(k, sentence(rng, rng.randrange(0, 60))) for k in range(40)]
    for k in range(40, 90):
        middle = rng.choice(passages).split(" ")
        a = rng.randrange(len(middle) // 2)
        rows.append((k, f"{sentence(rng, rng.randrange(20))}\t\n {' '.join(middle[a:])}  {sentence(rng, rng.randrange(20))} "))
    rows += [(90, rows[50][1]), (91, rows[50][1]), (91, rows[50][1]), (91, sentence(rng, 40)), (None, rows[60][1]), (None, rows[60][1])]
    rows += [(92, None), (93, ""), (94, " \n"), (95, "a " * 40), (96, "a " * 30), (97, sentence(rng, 4000)), (7, rows[42][1]), (98, "a\x00b\x01 " * 14), (99, "a\x00b\x01 " * 15)]
    return rows


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"hot_chunks": 1, "shard_patterns": 10}), (3, {"chunk_bytes": 400, "hot_chunks": 3, "shard_patterns": 3})])
def test_phrases(spark, seed, limits):
    rows = phrase_rows(seed)
    extra = [(i, t, "x", 1) for i, t in rows]
    out = remove_phrases(spark.createDataFrame(extra, "doc_id long, text string, KEPT string, shard int").repartition(5), **limits)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = plain_phrases(rows)
    assert sum(r[2] for r in want) > 300
    assert got == want


def test_phrases_of_an_empty_table(spark):
    out = remove_phrases(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept"] and out.count() == 0


def test_phrases_and_kept_words_are_cut_from_the_text():
    """Runs of words are cut as they stand; any other white space between them becomes one space."""
    rng = random.Random(4)
    texts = [sentence(rng, 50), "", " a\tb  c\n d ", "\n", "\t".join(sentence(rng, 20).split()), sentence(rng, 30).replace(" ", " \x0b", 5)]
    raw = [t.encode() for t in texts]
    chunk = phrase_dedup.Chunk(
        {"chunk": 0, "ids": [*range(6)], "sizes": [len(t) for t in raw], "data": pa.compress(b"".join(raw), codec="zstd", asbytes=True)}
    )
    split = [t.split() for t in raw]
    flat, text = [w for t in split for w in t], np.repeat(np.arange(6), [len(t) for t in split])
    for share in (0, 0.3, 0.9, 1):
        left = np.array([rng.random() < share for _ in flat])
        assert chunk.joined(left) == [b" ".join([w for w, k, x in zip(flat, text, left) if k == i and x]) for i in range(6)]
    starts = np.array([i for i in range(len(flat) - 15) if text[i] == text[i + 15]])
    assert chunk.phrases(starts, np.full(len(starts), 4)) == [b" ".join(flat[i : i + 16]) for i in starts]
    with pytest.raises(ValueError):
        chunk.phrases(np.array([45]), np.array([4]))


def test_hits_are_words_and_not_hashes():
    automaton = phrase_dedup.Automaton()
    phrase = " ".join(f"w{k}" for k in range(14)).encode()
    automaton.add(phrase, 9)
    automaton.add(phrase[3:], 4)
    assert automaton.hits(b"x " + phrase + b" \n " + phrase[: phrase.rindex(b" ")]) == ([1, 2, 16], [9, 4, 9])
    assert automaton.hits(phrase.replace(b"w5", b"w55")) == ([], [])


# Periodic runs


def plain_runs(words, least=12):
    out = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                out.setdefault((start, i + p), p)
    return sorted((a, b - a, p) for (a, b), p in out.items())


def test_runs():
    rng = random.Random(11)
    for _ in range(120):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            n, k = rng.randrange(rng.choice([6, 30, 120, 400])), rng.choice([1, 2, 3, 10])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6 and n:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        least = rng.choice([12, 4])
        for got, w in zip(word_runs([np.array(w, np.int64) for w in texts], least), texts):
            assert [tuple(r) for r in got.tolist()] == plain_runs(w, least)


def test_extensions():
    rng = np.random.default_rng(2)
    for _ in range(40):
        values = np.append(rng.integers(0, rng.integers(1, 4), rng.integers(2, 300)), 99)
        i, j = rng.integers(0, len(values), (2, 200))
        i, j = i[i != j], j[i != j]
        want = [next(k for k in range(len(values)) if max(a, b) + k >= len(values) or values[a + k] != values[b + k]) for a, b in zip(i, j)]
        assert Extensions(values).lengths(i, j).tolist() == want


def tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_collapsed_texts(spark):
    rng = random.Random(8)
    rows = [(k, sentence(rng, rng.randrange(200))) for k in range(120)]
    rows += [(None, "a b " * 20), (120, None), (121, ""), (122, " \t"), (123, "x " * 3000), (123, "x " * 3000), (124, "é a\tb\n" * 9), (125, "x " * 11), (126, "x\n" * 12)]
    table = spark.createDataFrame([(i, t, "r", 2) for i, t in rows], "doc_id long, text string, Runs string, tail_n int").repartition(3)
    out = collapse_runs(repeat_tails(table))
    assert out.columns == ["doc_id", "text", "tail_n", "n_words", "runs", "collapsed"]
    want = []
    for i, t in rows:
        w = tail(i, (t or "").encode().split())
        runs = plain_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want.append((i, len(w), runs, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert collapse_runs(table.where("false")).count() == 0


def test_runs_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, sentence(rng, rng.randrange(150)) if k % 5 else "b c " * rng.randrange(30)) for k in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect())
    want = []
    for i, t in rows:
        w = tail(i, t.encode().split())
        runs = plain_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        digest = hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((i, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), digest))
    assert got == sorted(want)
