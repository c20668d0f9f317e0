"""Parts of the removal of repeated byte strings: layout of runs, matches of windows, bounded shards."""

import random

import numpy as np

from pairlens.llm import suffix_dedup as sd


def chunk_of(texts, lengths, marks):
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return sd.Chunk(np.frombuffer(b"".join(texts), np.uint8), ends, np.arange(len(texts)), lengths, marks)


def test_layout_of_runs_is_that_of_least_hashes(monkeypatch):
    """Two bytes a run, found once, give all windows of all texts with the leftmost least hash as anchor."""
    monkeypatch.setattr(sd, "LAYOUT_BYTES", 500)
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 23, 24, 49, 50, 51, 80, 200]))) for _ in range(60)]
    texts += [b"a" * 300, b"", b"ab" * 90, b"tail of forty-nine bytes, which is too short here"]
    lengths, marks = sd.layout_of(texts)
    runs = sd.runs_of(chunk_of(texts, lengths, marks))

    def hashes(window):
        data = np.frombuffer(window, np.uint8)
        up, down = sd.powers(len(data) + 1)
        sums = sd._prefix_sums(data, up)
        return (sd.mix((sums[sd.GRAM :] - sums[: -sd.GRAM]) * down[: len(data) - sd.GRAM + 1]) >> np.uint64(32)).tolist()

    at = 0
    seen = {}
    for k, text in enumerate(texts):
        last = None
        for w in range(len(text) - sd.LENGTH + 1):
            found = hashes(text[w : w + sd.LENGTH])
            anchor = w + found.index(min(found))
            if anchor != last:
                at += last is not None or w > 0
                last = anchor
                assert (runs.text[at], runs.low[at], runs.low[at] + marks[at]) == (k, w, anchor)
            assert runs.low[at] <= w <= runs.high[at]
        at += len(text) >= sd.LENGTH
    assert at == len(lengths) == len(runs.run)
    for k in range(at):
        whole = texts[runs.text[k]][runs.low[k] : runs.high[k] + sd.LENGTH]
        assert seen.setdefault(int(runs.run[k]), (whole, marks[k])) == (whole, marks[k])
    assert len(seen) == len(set(seen.values()))
    assert len(sd.layout_of([])[0]) == len(sd.layout_of([b"", b"x" * 49])[0]) == 0


def test_window_matches_equal_brute_force():
    rng = random.Random(2)
    base = bytes(rng.choice(b"abc") for _ in range(70))
    strings = [base[rng.randrange(3) : rng.randrange(60, 70)] for _ in range(40)] + [b"z" * 80, b"z" * 50, b"y" * 90]
    ids = np.array([rng.randrange(9) for _ in range(len(strings) - 1)] + [5])
    counts = np.array([len(x) - sd.LENGTH + 1 for x in strings])
    found = sd.window_matches(np.frombuffer(b"".join(strings), np.uint8), counts, ids)
    windows = [(x[k : k + sd.LENGTH], i) for x, i in zip(strings, ids, strict=True) for k in range(len(x) - sd.LENGTH + 1)]
    least = {}
    for w, i in windows:
        least[w] = min(i, least.get(w, i))
    assert found.tolist() == [least[w] < i for w, i in windows] and found.any() and not found.all()


def test_shards_are_bounded():
    """Each chunk sends a row to every shard: the number of rows must not grow with the square of the text."""
    rows = {gb: (gb << 30) // sd.CHUNK_BYTES << sd.shard_bits(gb << 30) for gb in (1, 10, 100, 1000, 10_000)}
    assert rows[10] < 4_000_000 and rows[10_000] == 100 * rows[100]
    assert [sd.shard_bits(x) for x in (0, 1 << 20, 840 << 20)] == [5, 5, 8]
