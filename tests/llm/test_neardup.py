import random

import numpy as np

from quillspark.llm import neardup as N


def test_bit_sliced_distances_equal_a_popcount():
    r = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 5000):
        a, b = (r.integers(0, 256, (n, 64), dtype=np.uint8) for _ in range(2))
        b[::3] = a[::3] ^ (r.random((len(a[::3]), 64)) < 0.1)
        d = np.unpackbits(a ^ b, axis=1).sum(axis=1)
        for radius in (0, 40, 64, 128, 255, 256):
            assert (N.within(a, b, radius) == (d <= radius)).all()


def texts(seed=1, groups=60, vocabulary=3000):
    r = random.Random(seed)
    words, rows = [f"w{i}" for i in range(vocabulary)], []
    for g in range(groups):
        base = r.sample(words, 80)
        for _ in range(r.choice([1, 2, 3])):
            edited = [w if r.random() > 0.06 else r.choice(words) for w in base]
            rows.append((f"{g}-{len(rows)}", " ".join(edited).title()))
    return rows


def brute(rows, threshold=N.THRESHOLD):
    sets = [(i, set(N._WORD.findall(t.lower()))) for i, t in rows if t]
    return {tuple(sorted((a, b))) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and len(x & y) / len(x | y) > threshold}


def test_pairs_against_brute_force(spark):
    rows = texts()
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1].upper()), ("none", None), ("blank", ""), ("marks", "!!! ..."), (None, rows[0][1]), ("long", "word " * 50_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "arxiv_id string, abstract string, class string")
    got = {tuple(r) for r in N.near_pairs(df).collect()}
    assert got == brute([r for r in rows if r[0]])
    assert all(a < b for a, b in got)


def test_hot_band_is_tiled(spark):
    """All texts share their bands: the key is cut into tiles, and no pair is lost."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(f"d{i:03d}", " ".join(base + [f"x{i}"])) for i in range(90)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "arxiv_id string, abstract string")
    reps = N.band_rows(N.classes(df, "arxiv_id", "abstract").select("class", "words"))
    assert N.candidate_pairs(reps, tile=16).count() == 90 * 89 // 2


def test_empty(spark):
    assert N.near_pairs(spark.createDataFrame([], "arxiv_id string, abstract string")).count() == 0


def test_recall_of_the_bands_near_the_threshold():
    """Of sets that share 0.65 to 0.75 of their words, at least 98 of 100 meet in a band and lie within the radius."""
    r = np.random.default_rng(2)
    for share, least in ((0.65, 0.97), (0.66, 0.98), (0.7, 0.99), (0.75, 0.999)):
        n, met, near = 100, 0, 0
        both = round(share * n)
        sets = []
        for _ in range(300):
            pool = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
            own = (n - both) // 2
            sets += [np.unique(pool[: both + own]), np.unique(np.r_[pool[:both], pool[both + own :]])]
        sig = N.signatures(sets)
        bands = sig.reshape(len(sig), N.BANDS, N.ROWS)
        met = (bands[::2] == bands[1::2]).all(axis=2).any(axis=1)
        marks = N.fingerprints(sig)
        near = N.within(marks[::2], marks[1::2])
        assert near.all() and met.mean() >= least, (share, met.mean())


def test_titles_count(spark):
    """Words of titles count with those of abstracts; a title alone is no text."""
    base = [f"w{i}" for i in range(20)]
    rows = [("a", "one two three four", " ".join(base)), ("b", "one two three four", " ".join(base[:16] + ["x1", "x2", "x3", "x4"])), ("c", None, " ".join(base[:16] + ["y1", "y2", "y3", "y4"])), ("d", "one two three four", None), ("e", "one two three four", " ")]
    df = spark.createDataFrame(rows, "arxiv_id string, title string, abstract string")
    assert {tuple(r) for r in N.near_pairs(df).collect()} == {("a", "b")}  # 20 of 28 words; of the abstracts alone 16 of 24


def test_vertical_planes_move():
    r = np.random.default_rng(1)
    bits = r.integers(0, 256, (300, 8), dtype=np.uint8)
    planes, words = N.vertical(bits), np.arange(5)
    for s in (1, 63, 64, 65, 130, 299):
        want = N.vertical(np.r_[bits[s:], np.zeros((s, 8), np.uint8)])
        assert (N.moved(planes, s, words) == want).all()


def test_classes_with_links(spark):
    """One row per text: copies share a class, near classes count as links, and none is expanded into pairs."""
    base = [f"w{i}" for i in range(40)]
    near = " ".join(base[:38] + ["x1", "x2"])
    rows = [("a", " ".join(base)), ("b", " ".join(base).upper()), ("c", near), ("d", "something else"), ("e", None), ("a", " ".join(base))]
    df = spark.createDataFrame(rows, "arxiv_id string, abstract string")
    got = {r.id: (r.copies, r.links) for r in N.class_links(df).collect() if r["class"] == {"b": "a"}.get(r.id, r.id)}
    assert got == {"a": (2, 1), "b": (2, 1), "c": (1, 1), "d": (1, 0)}
