import random
from collections import Counter, defaultdict

from quillspark.llm.packing import fill, pack


def check(sizes, rows, capacity):
    load, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.container] += r.n_tokens
        pieces[r.doc_id].append(r.n_tokens)
    assert all(v <= capacity for v in load.values())
    want = {d: n for d, n in sizes if n}
    assert {d: sum(p) for d, p in pieces.items()} == want
    assert all(len(p) == 1 for d, p in pieces.items() if want[d] <= capacity)
    for r in rows:
        assert r.slack == 0 or capacity - load[r.container] == r.slack
    return len(load)


def test_patterns_use_every_item_once():
    r = random.Random(1)
    counts = Counter(r.randint(1, 100) for _ in range(3000))
    patterns = fill(counts, 100)
    used = Counter()
    for p in patterns:
        assert sum(k * u for k, u in p.uses.items()) <= 100
        for k, u in p.uses.items():
            used[k] += u * p.times
    assert used == counts
    total = sum(k * c for k, c in counts.items())
    assert sum(p.times for p in patterns) <= 1.02 * total / 100


def test_against_brute_force_on_small_sets():
    def best(items, cap):
        items, low = sorted(items, reverse=True), len(items)

        def go(i, bins):
            nonlocal low
            if len(bins) >= low:
                return
            if i == len(items):
                low = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= cap:
                    go(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1 :])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return low

    r = random.Random(5)
    for _ in range(40):
        items = [r.randint(1, 20) for _ in range(9)]
        assert sum(p.times for p in fill(Counter(items), 20)) <= best(items, 20) + 1


def test_documents(spark):
    r = random.Random(2)
    sizes = [(i, r.choice([0, 7, 64, 64, 64, r.randint(1, 300)])) for i in range(2000)]  # a hot length
    df = spark.createDataFrame([(d, n, "x") for d, n in sizes], "doc_id long, n_tokens int, container string")
    rows = pack(df, 64, rows_per_salt=100).collect()
    bins = check(sizes, rows, 64)
    assert bins <= -(-sum(n for _, n in sizes) // 64) * 1.01 + 2


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, -1), (4, 10), (5, 25)], "doc_id long, n_tokens int")
    rows = pack(df, 10).collect()
    assert {(r.doc_id, r.piece, r.n_tokens) for r in rows} == {(4, 0, 10), (5, 0, 10), (5, 1, 10), (5, 2, 5)}
    assert len({r.container for r in rows}) == 4
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens int"), 10).count() == 0
