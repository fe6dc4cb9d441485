"""SimHash, line chunks and decontamination against brute force."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from carelake.llm import decontaminate, linededup, simhash
from carelake.llm.graph import components

WORDS = [f"w{i}" for i in range(60)]


def texts(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    base = [" ".join(rnd.choices(WORDS, k=rnd.randint(5, 60))) for _ in range(n // 3)]
    out = list(base)
    while len(out) < n:
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        out.append(" ".join(words))
    return out


def slow_fingerprint(text: str) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(text.encode()).lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def unions(pairs, nodes) -> dict:
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def test_fingerprint_is_the_plain_one():
    for text in [*texts(1, 60), "", " \t\x0b", "A b", "É a b c É", "x" * 50_000, "A B C D " * 3000]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_masks_cover_every_pair_of_bits():
    for radius in (0, 1, 2):
        masks = [m & (1 << 64) - 1 for m in simhash.masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        for i in range(64):
            for j in range(64) if radius == 2 else [i]:
                if radius:
                    assert any(not m >> i & 1 and not m >> j & 1 for m in masks)
        assert all(m for m in masks)


@pytest.mark.parametrize("radius", [0, 1, 2])
@pytest.mark.parametrize("paired", [2, 24])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, radius, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rnd = random.Random(7)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(12):
            prints.add(s ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(1, 3))) & (1 << 64) - 1)
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    rows = [(i, s) for i, s in enumerate(sorted(signed))] + [(900, sorted(signed)[0]), (None, sorted(signed)[1])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long"), radius).collect()
    pairs = [(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= radius]
    root = unions(pairs, signed)
    least: dict = {}
    for i, s in rows:
        if i is not None:
            least[root[s]] = min(i, least.get(root[s], i))
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == sorted((i or -1, least[root[s]]) for i, s in rows)


def test_components_of_a_long_chain_and_of_none(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(chain).collect()} == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components(chain.where("a < 0")).count() == 0


def test_surplus_leaves_the_first_of_each_component(spark):
    rows = [(i, t, 0) for i, t in enumerate([*texts(5, 150), "", " ", None, "a b", "A  B"])]
    rows += [(None, rows[3][1], 0), (None, "alone without an id", 0), (7, rows[7][1], 0), (400, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    gone = [r["doc_id"] for r in simhash.surplus(df).collect()]
    prints = {(i, t): slow_fingerprint(t or "") for i, t, _ in rows}
    values = set(prints.values())
    root = unions([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2], values)
    seen, want = set(), []
    for r in sorted(prints, key=lambda r: (r[0] is None, r[0] or 0)):
        if root[prints[r]] in seen:
            want.append(r[0])
        seen.add(root[prints[r]])
    assert sorted(map(str, gone)) == sorted(map(str, want)) and len(gone) > 20
    assert simhash.surplus(df.where("doc_id < 0")).count() == 0


def slow_line_dedup(rows):
    first: dict = {}
    order = sorted(((i is None, i or 0, t, i) for i, t in set(rows) if t is not None), key=lambda x: x[:2])
    for last, _, t, i in order:
        lines = t.split("\n")
        for no, c in enumerate(linededup.chunks(t)):
            if linededup.removable(*c):
                first.setdefault("\n".join(lines[c[0] : c[1]]), (i, t, no))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        lines, left = t.split("\n"), []
        for no, c in enumerate(linededup.chunks(t)):
            passage = "\n".join(lines[c[0] : c[1]])
            if not linededup.removable(*c) or first[passage] == (i, t, no):
                left += lines[c[0] : c[1]]
        out.append((i, "\n".join(left)))
    return out


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(3)
    lines = [" ".join(rnd.choices(WORDS, k=rnd.choice([0, 1, 4, 9, 60]))) for _ in range(30)]
    rows = [(i, "\n".join(rnd.choices(lines, k=rnd.randint(1, 14)))) for i in range(60)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (90, None), (91, ""), (92, "\n\n\n"), (93, "one line"), (94, "\n".join(["same line"] * 500))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, source string, n int")
    got = linededup.dedup_lines(df, ("source",)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(i), str(t)) for i, t in slow_line_dedup(rows))
    assert sum(r["removed_chunks"] for r in got) > 20
    assert linededup.dedup_lines(df.where("doc_id < 0")).count() == 0


def test_passages_are_found_at_any_offset_and_the_rest_stays(spark):
    passage = "\n".join(" ".join(f"p{i}q{j}" for j in range(12)) for i in range(12))
    long_line = " ".join(f"z{j}" for j in range(55))
    rows = [(i, "\n".join([f"own {i} a"] * (i % 3) + [f"own {i} b", passage if i % 2 else long_line, f"own {i} c"])) for i in range(8)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[1] == rows[1][1]
    for i in range(2, 8):
        assert f"own {i} b" in got[i] and f"own {i} c" in got[i]
        assert long_line not in got[i] and passage not in got[i]
        assert len(got[i]) < len(rows[i][1]) / 2


def slow_shingles(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choices(WORDS, k=k))) for i, k in enumerate([1, 3, 5, 6, 9, 12, 20, 40, 40, 60])]
    items += [(20, items[5][1].upper() + "!"), (21, None), (22, ""), (None, "w1 w2 w3 w4 w5 w6 w7")]
    docs = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 900)))) for i in range(40)]
    for i in range(40, 80):
        item = rnd.choice(items[:10])[1].split()
        cut = rnd.randint(0, len(item) // 6)
        words = rnd.choices(WORDS, k=rnd.randint(0, 3000))
        at = rnd.randint(0, len(words))
        docs.append((i, ", ".join(words[:at] + item[cut:] + words[at:])))
    docs += [(81, items[0][1]), (82, items[1][1] + "."), (83, None), (84, " "), (None, items[6][1]), (40, docs[40][1])]
    got = decontaminate.contaminated(
        spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, words int"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    classes: dict = {}
    for i, t in items:
        if i is not None and (s := slow_shingles(t)):
            classes.setdefault(frozenset(s), []).append(i)
    want = set()
    for d, t in docs:
        have = slow_shingles(t)
        for s, ids in classes.items():
            if len(s & have) >= 0.8 * len(s):
                want.add((d, min(ids), len(s & have), len(s)))
    assert {(r["doc_id"], r["item_id"], r["shared_shingles"], r["item_shingles"]) for r in got} == want
    assert len(got) == len(want) > 25
