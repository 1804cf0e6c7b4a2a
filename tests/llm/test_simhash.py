import random

import numpy as np
import pytest
import xxhash

from skylattice.llm import simhash
from skylattice.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \n", "Ab", "one TWO", "a b c", "A É b c d É e f g", "x " * 50, "lorem ipsum dolor sit amet " * 7])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def brute_roots(fps):
    values = sorted(set(fps))
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def prints(seed):
    r = random.Random(seed)
    found = [0, (1 << 64) - 1]
    for _ in range(25):
        x = r.getrandbits(64)
        found.append(x)
        for _ in range(r.randint(0, 6)):
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            found.append(x)
    centre = r.getrandbits(64)
    found += [centre ^ 1 << a ^ 1 << b for a in range(8) for b in range(8) if a < b]
    return [int(np.uint64(x).astype(np.int64)) for x in found]


@pytest.mark.parametrize("seed,max_bucket", [(1, 128), (2, 4)])
def test_components_against_brute_force(spark, seed, max_bucket):
    fps = prints(seed)
    rows = [(i, f) for i, f in enumerate(fps)] + [(500, fps[5]), (None, fps[7]), (0, fps[0])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long"), max_bucket).collect()
    label = brute_roots(fps)
    first = {}
    for i, f in rows:
        if i is not None:
            first[label[f]] = min(i, first.get(label[f], i))
    assert sorted((str(g.doc_id), g.fp, g.component_id) for g in got) == sorted((str(i), f, first[label[f]]) for i, f in rows)


def test_masks_are_exact():
    r = random.Random(3)
    for blocks, agree in simhash.LEVELS:
        masks = simhash.block_masks(blocks, agree)
        for _ in range(200):
            flips = sum(1 << b for b in r.sample(range(64), 3))
            assert any(m & flips == 0 for m in masks)


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (60, 60), (None, 1)], "u long, v long")
    got = {r.node: r.root for r in components(links, "u", "v").collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 51: 50}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(simhash.fingerprints(docs)).count() == 0
