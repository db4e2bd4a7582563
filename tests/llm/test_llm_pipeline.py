"""The pipeline's stages, one after the other, each against brute force on its own input."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from feedloom.llm import line_dedup, near_dedup
from test_llm_rules import SMALL, WORD, brute_groups, brute_quality, given, grams


def brute_accepted(text):
    n, chars, symbols, dup_lines, repeated = brute_quality(text)
    lines = text.split("\n")
    bullets, cut = (sum(bool(re.search(p, x)) for x in lines) for p in (r"^\s*[-*•‣▪●]", r"(\.\.\.|…)\s*$"))
    return not (
        n < 10 or 100 * repeated > 20 * n or chars < 2 * n or chars > 15 * n or 10 * symbols > n or 10 * dup_lines > 3 * len(lines)
        or 10 * len(re.findall("[0-9]", text)) > 3 * chars or 10 * bullets > 9 * len(lines) or 10 * cut > 3 * len(lines)
    )


def brute_lines(texts):
    """Each text without the runs of lines that the alignment with any earlier text finds."""
    lines = {i: [x.strip(" \t\n\v\f\r") for x in t.split("\n")] for i, t in texts.items()}
    sizes = {i: [len(x.split()) for x in own] for i, own in lines.items()}
    holders = defaultdict(set)
    for i, own in lines.items():
        for x in own:
            if x:
                holders[x].add(i)
    out = {}
    for i, text in texts.items():
        lost = set()
        for k in {k for x in lines[i] for k in holders[x] if k < i}:
            for start, stop in line_dedup.common_blocks(lines[k], lines[i], sizes[i], line_dedup.LEAST_BLOCK_WORDS):
                lost |= set(range(start, stop + 1))
        out[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lost)
    return {i: t for i, t in out.items() if t == texts[i] or t.split()}


def brute_firsts(texts, percent):
    sets = {i: grams(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: t for i, t in texts.items() if find(i) == i}


def brute_clean(texts, items):
    tokens = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    cut = lambda t: [tuple(w[k:k + 5]) for w in [tokens(t)] for k in range(len(w) - 4)]
    of_item = {i: cut(t) for i, t in items.items()}
    having = Counter(g for gs in of_item.values() for g in set(gs))
    weight = lambda g: math.log1p(len(of_item) / having[g]) / math.log1p(len(of_item)) if g in having else 1.0

    def hit(text):
        g = cut(text)
        for own in of_item.values():
            b = Counter(own)
            for s in range(max(1, len(g) - len(own) + 1)) if b.keys() & set(g) else ():
                a = Counter(g[s:s + len(own)])
                common = sum(weight(x) * min(a[x], b[x]) for x in b)
                if common >= 0.8 * (sum(weight(x) * c for w in (a, b) for x, c in w.items()) - common) - 1e-9:
                    return True
        return False

    return {i: t for i, t in texts.items() if not hit(t)}


@given
def test_stages(spark):
    read = lambda df: {r.doc_id: r.text or "" for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = {
        "line dedup": brute_lines, "near duplicates": lambda t: brute_firsts(t, 80), "decontamination": lambda t: brute_clean(t, items),
    }
    for name, stage in stages.items():
        before = read(docs)
        if name == "packing":
            break
        docs = corpus_pipeline.staged(stage(spark, docs, str(SMALL)), "test-stage")
        after = read(docs)
        if name in expected:
            assert after == expected[name](before), name
        else:
            assert after == {i: t for i, t in before.items() if brute_accepted(t)}
    got = defaultdict(list)
    for r in sorted(corpus_pipeline.run(spark, str(SMALL)).collect(), key=lambda r: (r.doc_id, r.chunk)):
        got[r.doc_id] += WORD.findall(r.text)
    assert got == {i: WORD.findall(t) for i, t in before.items()}


def test_near_stage_at_its_limit(spark):
    """Pairs alike by 0.80 to 0.85 are near duplicates of the stage, each by itself."""
    texts = {}
    for k in range(0, 3000, 2):
        own = [f"a{k}w{x}" for x in range(104)]
        texts[k], texts[k + 1] = " ".join(own), " ".join(own[:52] + [f"b{k}"] + own[53:] + [f"c{k}x{x}" for x in range(12)])
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = rows.selectExpr("*", "'' as lang", "'' as source", "length(text) as n_chars")
    alike = [100 * len(a & b) // len(a | b) for a, b in [(grams(texts[0]), grams(texts[1]))]]
    assert 80 <= alike[0] < 85
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()}
    assert kept == set(range(0, 3000, 2))


def test_bands_and_slots_follow_the_percentage():
    assert (near_dedup.band_rows(85), near_dedup.least_equal_slots(85)) == (5, 88)
    for percent in (60, 70, 80, 85, 90, 95):
        rows, s = near_dedup.band_rows(percent), percent / 100
        assert (1 - s**rows) ** (near_dedup.SLOTS // rows) <= near_dedup.MISSED
        sd = math.sqrt(near_dedup.SLOTS * s * (1 - s))
        assert near_dedup.SLOTS * s - near_dedup.least_equal_slots(percent) >= near_dedup.DEVIATIONS * sd


def test_cells_are_small_on_both_sides(spark):
    """A family of which nearly all rows ask is cut on both sides, and no couple of rows is lost."""
    n = 1000
    rows = [(1, i, i) for i in range(n)] + [(2, n + i, n + min(i, 9)) for i in range(300)] + [(3, -1, -1)]
    members = spark.createDataFrame(rows, "family bigint, node bigint, label bigint")
    left, right = ([(r.family, r.i, r.j, r.node) for r in side.collect()] for side in near_dedup.cells(members, "family"))
    sides = defaultdict(lambda: ([], []))
    for k, side in enumerate((left, right)):
        for family, i, j, node in side:
            sides[family, i, j][k].append(node)
    assert max(len(side) for both in sides.values() for side in both) < 1.5 * near_dedup.BLOCK_ROWS
    label = {node: (family, x) for family, node, x in rows}
    met = {frozenset((a, b)) for asking, answering in sides.values() for a in asking for b in answering if label[a] != label[b]}
    wanted = {frozenset((a, b)) for a, b in itertools.combinations(label, 2) if label[a][0] == label[b][0] and label[a] != label[b]}
    assert met == wanted


def test_family_of_several_blocks(spark):
    """Edits of one text that are akin but mostly not linked, over several blocks on both sides."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(900):
        words = list(base)
        for k in rng.sample(range(120), 3):
            words[k] = f"v{rng.randrange(25)}"
        texts[i] = " ".join(words)
    got = near_dedup.groups(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_groups(texts)


def deleted(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    return {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(rows).collect()}


def test_common_blocks_of_lines_with_other_first_holders(spark):
    """Many documents hold A then B, one document before them A alone, another one B alone."""
    a, b = (" ".join(f"{x}{k}" for k in range(26)) for x in "ab")
    texts = {1: f"one\n{a}", 2: f"two\n{b}"} | {i: f"own {i}\n{a}\n{b}\nend {i}" for i in range(3, 15)}
    # Lines of under five words each, and blocks that end in lines with too few words for a run of their own.
    verse = "\n".join(f"line {k} here" for k in range(12))
    texts |= {i: f"poem {i}\n{verse}\nby {i}" for i in range(20, 32)}
    tail = "\n".join(" ".join(f"t{k}x{x}" for x in range(10)) for k in range(3))
    texts |= {40: f"zero\n{tail}"} | {i: f"more {i}\n{tail}\nlast few words" for i in range(41, 53)}
    got = deleted(spark, texts)
    assert got == {i: t for i, t in ((i, brute_lines(texts)[i]) for i in texts)}
    assert got[3] == texts[3] and got[4] == "own 4\nend 4" and got[31] == "poem 31\nby 31"
    assert got[41] == "more 41\nlast few words" and got[42] == "more 42"
