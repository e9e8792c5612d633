import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from callweave.llm import leaks
from callweave.llm.text import words


def longest_run(a, b):
    best, prev = 0, {}
    for i in range(len(a)):
        cur = {}
        for j in range(len(b)):
            if a[i] == b[j]:
                cur[j] = prev.get(j - 1, 0) + 1
                best = max(best, cur[j])
        prev = cur
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40), st.integers(2, 6))
def test_tiles(doc, item, k):
    tiles = leaks.tile(doc, item, k)
    n = longest_run(doc, item)
    assert (max((t[2] for t in tiles), default=0) == n) if n >= k else not tiles
    used_i, used_d = [], []
    for i, d, m in tiles:
        assert m >= k and item[i : i + m] == doc[d : d + m]
        used_i += range(i, i + m)
        used_d += range(d, d + m)
    assert len(set(used_i)) == len(used_i) and len(set(used_d)) == len(used_d)
    # nothing of that length is left between the tiles
    left_i = [x if p not in set(used_i) else ("i", p) for p, x in enumerate(item)]
    left_d = [x if p not in set(used_d) else ("d", p) for p, x in enumerate(doc)]
    assert longest_run(left_d, left_i) < k


def test_words():
    assert words("Café, L’A­MI!​\nＡＢ") == ["café", "l", "ami", "ab"]
    assert words(None) == words("") == words(" .,;") == []


def test_found_against_brute_force(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(40)] + ["Ünï", "naïve"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 60))), "clash") for i in range(25)]
    docs = []
    for i in range(150):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 80))]
        if i % 3 == 0:
            src = rnd.choice(items)[1].split()
            a = rnd.randrange(len(src))
            at = rnd.randrange(len(w) + 1)
            w[at:at] = src[a : a + rnd.randrange(4, 40)]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(x.upper() if rnd.random() < 0.3 else x for x in w), 7))
    docs += [docs[0], (None, docs[0][1], 7), (2**62 + 1, docs[3][1], 7), (900, None, 7), (901, "", 7), (902, (items[3][1] + " ") * 400, 7)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    t = spark.createDataFrame([*items, (90, None, "c"), (91, "", "c"), (None, items[0][1], "c")], "item_id bigint, text string, doc_id string")
    k = 6
    want = sorted(((i, j) for i, x, _ in docs for j, y, _ in items if longest_run(words(x)[:4000], words(y)) >= k), key=repr)
    small = leaks.find_leaks(d, t, min_match=k)
    assert sorted(((r["doc_id"], r["item_id"]) for r in small.collect()), key=repr) == want
    report = leaks.report_items(small, t).collect()
    assert len(report) == 28 and {r["item_id"] for r in report if r["n_docs"]} == {j for _, j in want}
    assert leaks.find_leaks(d.limit(0), t).count() == leaks.find_leaks(d, t.limit(0)).count() == 0


def test_reordered_passages_are_covered():
    item = [str(i) for i in range(40)]
    doc = [*item[20:], "x", *item[:20]]
    assert sum(n for _, _, n in leaks.tile(doc, item, 8)) == 40


def test_filter_holds_all_seeds(spark):
    texts = [words(" ".join(str(i * j) for i in range(300))) for j in range(1, 40)]
    at, seed = leaks.seeds_of(texts, 12)
    assert len(seed) == sum(len(t) - 11 for t in texts) and sorted(set(at)) == list(range(39))
    df = spark.createDataFrame([(int(x),) for x in seed.astype(np.int64)], "seed bigint")
    f = leaks._filter(df)
    assert f.may_hold(seed).all()
    other = np.random.default_rng(1).integers(0, 2**63, 100_000).astype(np.uint64)
    assert f.may_hold(other).mean() < 0.001
    small = leaks.Filter(15, [(0, b"\x00" * 4096)])
    assert not small.may_hold(seed).any()


def test_hot_passages(spark):
    """A passage that most documents hold, and one that none does."""
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(i, f"start {i} {item} end" if i % 4 else f"other text {i}") for i in range(2000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = leaks.find_leaks(d, spark.createDataFrame([(1, item), (2, item.upper().replace(" ", ", ")), (3, "x " * 30)], "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["covered"]) for r in got) == sorted((i, j, 20) for i in range(2000) if i % 4 for j in (1, 2))
