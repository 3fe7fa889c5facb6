"""The Merkle manifest against a plain version, and its multiproofs against whole trees."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from subscope.llm import manifest

H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return H(fields)


def tree_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(last[k : k + 3]) for k in range(0, len(last), 3)])
    return levels


def path_of(levels, at):
    runs = []
    for level in levels[:-1]:
        first = at // 3 * 3
        runs.append([None if k == at else level[k] for k in range(first, min(first + 3, len(level)))])
        at //= 3
    return runs


def plain(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([g[2] for g in sorted(groups[s], key=lambda g: g[:3])]) for s in order}
    top = tree_of([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for at, (*_, leaf, row) in enumerate(sorted(groups[s], key=lambda g: g[:3])):
            path = path_of(trees[s], at) + path_of(top, n)
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf_of((*row[:4], text))
            for run in path:
                folded = H([folded if x is None else x for x in run])
            siblings = H([x for run in path for x in run if x is not None])
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], siblings, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def made(frame, **options):
    return sorted((tuple(r)[:7] for r in manifest.manifest(frame, **options).collect()), key=str)


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_equals_plain(spark, depth):
    """Trees of 1, 2, 3, 4, 9, 10, ... leaves, the largest far above a chunk."""
    rnd = random.Random(depth)
    rows = []
    for n, size in enumerate([1, 2, 3, 4, 8, 9, 10, 27, 28, 82, 400]):
        for _ in range(size):
            rows.append((len(rows) * 7 % 1009, None if n == 4 else f"s{n}é", rnd.choice(["en", None]), rnd.choice([None, 3]), rnd.choice(["a\nb", "x", "", None, "ü\n\n"])))
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert made(frame, depth=depth) == plain(rows)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert made(odd) == plain(rows)
    assert made(odd.where("doc_id = 5")) == plain([r for r in rows if r[0] == 5])  # its leaf is the root
    assert manifest.manifest(empty).count() == 0


@pytest.mark.parametrize("leaves", [1, 2, 5, 27, 100])
def test_multiproof_is_enough_and_least(leaves):
    rnd = random.Random(leaves)
    levels = tree_of([H([str(k)]) for k in range(leaves)])
    width = manifest.widths(leaves)
    assert width == [len(level) for level in levels]
    for _ in range(20):
        chosen = sorted(rnd.sample(range(leaves), rnd.randint(1, leaves)))
        needed = manifest.missing(chosen, width)
        derivable = {(0, k) for k in chosen}
        for level in range(1, len(levels)):
            derivable |= {(level, k // 3) for k in chosen for _ in [0] if level == 1} | {(level, at // 3) for lv, at in derivable if lv == level - 1}
        assert not set(needed) & derivable and len(set(needed)) == len(needed)
        nodes = manifest.derive({k: levels[0][k] for k in chosen}, {(lv, at): levels[lv][at] for lv, at in needed}, width)
        for k in chosen:
            path = manifest.proof(k, nodes, width)
            assert path == path_of(levels, k) and manifest.fold(levels[0][k], path) == levels[-1][0]
        used = {(lv, x) for k in chosen for lv, run in enumerate(path_of(levels, k)) for x in range(k // 3 ** (lv + 1) * 3, k // 3 ** (lv + 1) * 3 + len(run))}
        assert set(needed) <= used
