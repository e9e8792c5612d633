import itertools
import math
import random

import numpy as np

from callweave.llm import source_files as S

SCHEMA = "file string, symbol string, context string, path string, n int"


def hand(rnd, project, file, n=30):
    return [(file, f"{project}_{rnd.choice(['read', 'walk', 'trim'])}_{i % 7}", rnd.choice(["int rc = a_b;", "free(x->y);", "goto out;", 'log_printf("a %d", 3);']), "x", 1) for i in range(n)]


def test_labels(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for p in ("alpha", "bravo"):
        for i in range(6):
            f = f"{p}/src/core/{p}_{i}.c"
            rows += hand(rnd, p, f)
            want[f] = "handwritten"
        decoys = {
            f"{p}/src/vendor_portal/a.c": ["/* bundled with the vendor portal, see list.h for the upstream field names */"],
            f"{p}/tools/generated_ids.c": ['fprintf(out, "/* Generated by %s. DO NOT EDIT. */");', "/* the id is generated by the caller; do not edit it now */"],
            f"{p}/src/table.c": ["static const unsigned char seed[8] = { 0x1f,0x2e,0x3d };", "0x00,0x01,0x02,0x03,0x04,0x05,"],
            f"{p}/src/own.c": [f"/* Copyright (c) the {p} authors. */"],
        }
        for f, contexts in decoys.items():
            rows += hand(rnd, p, f) + [(f, f"{p}_x", c, "x", 1) for c in contexts]
            want[f] = "handwritten"
        gen = f"{p}/include/parser.c"
        rows += hand(rnd, p, gen) + [(gen, "<global>", "/* Generated by tool from a.y. DO NOT EDIT. */", "x", 1)]
        rows += hand(rnd, p, f"{p}/src/msg.pb.c") + hand(rnd, p, f"{p}/autogen/z.h")
        rows += [(f"{p}/src/m.c", "<global>", "!function(a,b){a.d=b}(d,0);" * 20, "x", 1)] * 3 + [(f"{p}/lib/x.min.c", f"{p}_a", "int q;", "x", 1)]
        rows += [(f"{p}/src/blob.c", "<global>", "0x00,0x01,0x02,0x03,0x04,0x05,", "x", 1)] * 20
        lib = f"{p}/third_party/zed-1.2.3/core.c"
        rows += [(lib, f"zz_read_it{i}", "free(x);", "x", 1) for i in range(10)]
        copy = f"{p}/src/zzcore.c"
        rows += [(copy, f"zz_read_it{i}", "free(x);", "x", 1) for i in range(10)] + [(copy, "<global>", "/* zed 1.2.3 - unmodified upstream copy, report bugs upstream */", "x", 1)]
        want |= {gen: "generated", f"{p}/src/msg.pb.c": "generated", f"{p}/autogen/z.h": "generated", f"{p}/src/m.c": "minified", f"{p}/lib/x.min.c": "minified", f"{p}/src/blob.c": "blob", lib: "vendored", copy: "vendored"}
    rows += [(None, "a", "b", "x", 1), ("", "a", "b", "x", 1), ("lone.c", None, None, "x", 1), ("ALPHA\\SRC\\CORE\\ALPHA_0.C", "alpha_q", "y" * 50_000 + " z", "x", 1)]
    want["lone.c"] = "handwritten"
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.classify_files([df]).collect()
    assert {r["path"]: r["label"] for r in got} == want
    assert all(0 < r["confidence"] <= 1 for r in got)
    assert S.classify_files([df.limit(0)]).count() == 0


def brute(parents, unary, edges):
    """Exact marginals of a small forest by summing over all labellings."""
    n = len(parents)
    total = np.zeros((n, 5))
    for labels in itertools.product(range(5), repeat=n):
        w = math.exp(sum(unary[i][labels[i]] for i in range(n)) + sum(edges[i][labels[p]][labels[i]] for i, p in enumerate(parents) if p is not None))
        for i in range(n):
            total[i][labels[i]] += w
    return total / total.sum(axis=1, keepdims=True)


ROWS = [("a/generated/x.c", "q", "int a;", "", 0), ("a/generated/y.c", "a_own", "int b;", "", 0), ("a/z.c", "a_own", "// Code generated by t; do not edit.", "", 0)]


def test_marginals_are_exact(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    m = S.starting_model()
    names = list(S.BINS | S.LISTED)
    feats = {r["path"]: r for r in S.file_features([df]).collect()}
    assert {r["family"] for r in feats.values()} == {"other"}
    of = lambda p: [sum(m.features[f][feats[p]["bins"][i]][k] for i, f in enumerate(names)) for k in range(5)]
    none, e = [0.0] * 5, m.edges
    unary = [[x + m.features["dir_name"][0][k] for k, x in enumerate(m.root)], m.features["dir_name"][1], none, none, of("a/z.c"), of("a/generated/x.c"), of("a/generated/y.c")]
    want = brute([None, 0, 0, 1, 2, 3, 3], unary, [None, e["dir"], e["family"], e["family"], e["file"], e["file"], e["file"]])
    got = {r["path"]: r for r in S.classify_files([df], rounds=0).collect()}
    for i, path in ((4, "a/z.c"), (5, "a/generated/x.c"), (6, "a/generated/y.c")):
        assert abs(got[path]["p_handwritten"] - want[i][0]) < 2e-6
        assert abs(got[path]["confidence"] - max(want[i])) < 2e-6
    marginals = S._pass(S.file_features([df]), names, m, True)
    learnt = S._learn(marginals, names, m, m, True)
    for table in learnt.features.values():
        assert all(abs(sum(math.exp(row[k]) for row in table) - 1) < 1e-9 for k in range(5))
    for table in learnt.edges.values():
        assert all(abs(sum(map(math.exp, row)) - 1) < 1e-9 for row in table)
    # the pair probabilities of files and families add up to the marginals of the files
    for r in marginals["file"].collect():
        own = [sum(r["joint"][a * 5 + b] for a in range(5)) for b in range(5)]
        i = {"a/z.c": 4, "a/generated/x.c": 5, "a/generated/y.c": 6}[r["path"]]
        assert np.allclose(own, want[i], atol=1e-6)


def test_without_word_lists(spark):
    """What shape and naming tell alone; siblings and directories decide where a file itself tells nothing."""
    rnd = random.Random(5)
    rows, want = [], {}
    for p in [f"{a}{b}" for a in ("alpha", "bravo", "carol", "delta") for b in "klmnop"]:
        for i in range(4):
            rows += hand(rnd, p, f"{p}/src/{p}_{i}.c")
            want[f"{p}/src/{p}_{i}.c"] = "handwritten"
        rows += [(f"{p}/src/m.c", "<global>", "!function(a,b){a.d=b}(d,0);" * 20, "x", 1)] * 3
        rows += [(f"{p}/src/blob.c", "<global>", f"0x0{i},0x01,0x02,0x03,0x04,0x05,", "x", 1) for i in range(20)]
        rows += [(f"{p}/x/zed.c", f"zz_read_it{i}", "free(x);", "x", 1) for i in range(10)]
        rows += [(f"{p}/src/state.c", f"{p}_read_1", f"case {i}: goto state_{i * 7};", "x", 1) for i in range(60)]
        want |= {f"{p}/src/m.c": "minified", f"{p}/src/blob.c": "blob", f"{p}/x/zed.c": "vendored", f"{p}/src/state.c": "generated"}
    got = S.classify_files([spark.createDataFrame(rows, SCHEMA)], word_lists=False).collect()
    assert {r["path"]: r["label"] for r in got} == want
