"""Header trees, windows by budget and sequences against plain versions."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.operators import sheets as H
from skein.operators import tables_etl as Z

SHEET = "table_id string, texts array<array<string>>, regions array<struct<FirstRow: int, LastRow: int, FirstColumn: int, LastColumn: int>>, top_tree string, left_tree string"
NONE = [-1, -1, -1, -1]


def node(r, c, *children):
    return {"RI": r, "CI": c, "Cd": list(children)}


def levels(tree):
    return 1 + max(map(levels, tree["Cd"])) if tree["Cd"] else 0


def plain_paths(tree, regions, height, width, top):
    """{cell: path}; None for a sheet that is left out."""
    grid = {(r, c): list(NONE) for r in range(height) for c in range(width)}
    flat = lambda: {(r, c): [-1, -1, -1, c if top else r] if (width if top else height) <= 256 else list(NONE) for r, c in grid}
    if tree is None or not tree["Cd"]:
        return flat()
    depth = levels(tree)
    if depth > 4:
        return grid

    def wide(n, at):
        return len(n["Cd"]) > (32, 32, 64, 256)[at] or any(wide(c, at + 1) for c in n["Cd"] if c["Cd"])

    if wide(tree, 4 - depth):
        return flat()

    def put(r, c, path):
        if (r, c) not in grid:
            raise IndexError
        grid[r, c] = path

    def walk(n, path, at):
        for k, child in enumerate(n["Cd"]):
            own = path[:at] + [k] + path[at + 1 :]
            r, c = child["RI"], child["CI"]
            put(r, c, own)
            if child["Cd"]:
                walk(child, own, at + 1)
                continue
            m = next((g for g in regions if g[0] <= r <= g[1] and g[2] <= c <= g[3]), None)
            for rr in range(r + 1, height) if top else range(m[0] if m else r, (m[1] if m else r) + 1):
                for cc in range(m[2] if m else c, (m[3] if m else c) + 1) if top else range(c + 1, width):
                    put(rr, cc, own)

    try:
        walk(tree, list(NONE), 4 - depth)
    except IndexError:
        return None
    return grid


def random_tree(draw, height, width, depth, top):
    def grow(at):
        n = draw.randint(1, 3) if at < depth else 0
        kids = [grow(at + 1) for _ in range(n)]
        return node(draw.randrange(height), draw.randrange(width), *kids)

    return grow(0)


def test_paths_equal_a_plain_version(spark):
    draw, rows, want = random.Random(7), [], {}
    for k in range(60):
        height, width = draw.randint(1, 7), draw.randint(1, 7)
        regions = [(a, min(height - 1 + (draw.random() < 0.1), a + draw.randint(0, 2)), c, min(width - 1, c + draw.randint(0, 2))) for a, c in [(draw.randrange(height), draw.randrange(width)) for _ in range(draw.randint(0, 3))]]
        trees = [None if draw.random() < 0.2 else random_tree(draw, height, width, draw.randint(0, 5), top) for top in (True, False)]
        if draw.random() < 0.1 and trees[0]:
            trees[0]["Cd"].append(node(height, 0))
        rows.append((str(k), [[f"{r},{c}" for c in range(width)] for r in range(height)], regions, *(t and json.dumps(t) for t in trees)))
        both = [plain_paths(t, regions, height, width, top) for t, top in zip(trees, (True, False), strict=True)]
        if None not in both:
            want |= {(str(k), r, c): (f"{r},{c}", both[0][r, c], both[1][r, c]) for r, c in both[0]}
    df = spark.createDataFrame(rows, SHEET)
    found = {(r.table_id, r.row, r.column): (r.value, r.top, r.left) for r in H.placed(df).collect()}
    assert len({k[0] for k in want}) not in (0, 60)
    assert found == want


def test_odd_trees_leave_other_sheets_alone(spark):
    texts = [["a", "b"], ["1", "2"]]
    wide = node(-1, -1, node(0, 0, *[node(1, 0) for _ in range(257)]))  # two levels: 257 children in the last place
    deep = node(-1, -1, node(0, 0, node(0, 0, node(0, 0, node(0, 0, node(0, 0))))))
    good = node(-1, -1, node(0, 0), node(0, 1))
    rows = [
        ("good", texts, None, json.dumps(good), None), ("wide", texts, [], json.dumps(wide), None), ("deep", texts, [], json.dumps(deep), None),
        ("torn", texts, [], "{", None), ("odd", texts, [], json.dumps({"RI": 0, "CI": 0, "Cd": [{"RI": 0}]}), None), ("none", texts, [], None, "null"),
        ("far", texts, [], json.dumps(node(-1, -1, node(9, 9))), None), ("minus", texts, [], json.dumps(node(-1, -1, node(-1, 0))), None),
        ("null", None, [], None, None), ("empty", [], [], None, None), ("large", [["x"] * 257], [], None, None), (None, texts, [], None, None),
    ]
    found = defaultdict(dict)
    for r in H.placed(spark.createDataFrame(rows, SHEET)).collect():
        found[r.table_id][r.row, r.column] = (r.top, r.left)
    assert set(found) == {"good", "wide", "deep", "none"}
    assert found["good"][1, 1] == ([-1, -1, -1, 1], [-1, -1, -1, 1]) and found["good"][1, 0][0] == [-1, -1, -1, 0]
    assert found["wide"][0, 1] == ([-1, -1, -1, 1], [-1, -1, -1, 0]) and found["deep"][0, 1][0] == NONE
    assert H.placed(spark.createDataFrame([], SHEET)).collect() == []


def test_pivoted_sheets(spark):
    facts = spark.createDataFrame([("s", 1, "x", "A", "p", 5), ("s", 1, "y", "A", "q", 2), ("s", 2, "x", "B", "p", 1), ("s", 1, "x", "A", "p", 1)], "t string, r1 int, r2 string, c1 string, c2 string, v int")
    sheet = H.pivoted(facts, "t", ("r1", "r2"), ("c1", "c2"), F.sum("v"))
    row = sheet.first()
    assert row.texts == [["", "", "A", "", "B"], ["", "", "p", "q", "p"], ["1", "x", "6", "", ""], ["", "y", "", "2", ""], ["2", "x", "", "", "1"]]
    assert [tuple(r) for r in row.regions] == [(0, 0, 2, 3), (0, 0, 4, 4), (2, 3, 0, 0), (4, 4, 0, 0)]
    paths = {(r.row, r.column): (r.top, r.left) for r in H.placed(sheet).collect()}
    assert paths[3, 3] == ([-1, -1, 0, 1], [-1, -1, 0, 1]) and paths[4, 4] == ([-1, -1, 1, 0], [-1, -1, 1, 0]) and paths[0, 2][0] == [-1, -1, 0, -1]


def plain_windows(lengths, budget, back):
    """[(window, cell)] of cells {(row, column): length}."""
    rows = max(r for r, _ in lengths) + 1
    out, start, k = [], 0, 0
    while start < rows:
        used, nxt = 1, rows
        for r, c in sorted(lengths):
            if r < start:
                continue
            if used + lengths[r, c] >= budget:
                nxt = next((r - b for b in range(back, -1, -1) if r - b > start), r + 1)
                break
            out.append((k, (r, c)))
            used += lengths[r, c]
        start, k = nxt, k + 1
    return out


@pytest.mark.parametrize(("budget", "back"), [(12, 3), (30, 3), (6, 1), (1000, 3), (9, 0)])
def test_windows_equal_a_plain_version(spark, budget, back):
    draw, rows, want = random.Random(budget), [], []
    for t in range(12):
        cells = {(r, c): draw.randint(1, 8) for r in range(draw.randint(1, 14)) for c in range(4) if draw.random() < 0.8}
        if cells:
            rows += [(f"t{t}", r, c, n) for (r, c), n in cells.items()]
            seen = set()
            for k, at in plain_windows(cells, budget, back):
                want.append((f"t{t}", *at, cells[at], k, at in seen))
                seen.add(at)
    df = spark.createDataFrame(rows, "table_id string, row int, column int, length int")
    assert sorted(tuple(r) for r in H.budget_windows(df, budget, back).collect()) == sorted(want)
    assert H.budget_windows(df.where("false"), budget).collect() == []


VOCABULARY = {t: i for i, t in enumerate([Z.UNKNOWN, Z.SEPARATOR, Z.EMPTY, Z.MASK, Z.CLS, Z.VALUE, *"abcdefgh", *("##" + c for c in "abcdefgh")])}


def kinds(spark):
    draw = random.Random(3)
    rows = [(f"t{t}", r, c, draw.choice(["ab", "c d", "12", "a 7", "", "h", None, "abc"])) for t in range(8) for r in range(3 + t * 2) for c in range(5)]
    cell = spark.createDataFrame(rows, "table_id string, row int, column int, value string")
    return rows, H.cell_kinds(Z.tokens(cell, VOCABULARY))


def test_marks_keep_their_quotas(spark):
    rows, df = kinds(spark)
    found = {(r.table_id, r.row, r.column): r for r in H.marked(df, 1, 1).collect()}
    assert len(found) == len(rows)
    for t, r, c, v in rows:
        m = found[t, r, c]
        assert m.kind == {"ab": 2, "c d": 2, "12": 1, "a 7": 3, "": 0, "h": 2, None: 0, "abc": 2}[v]
        assert (m.mark == H.LEFT_OUT) == (m.kind == 0) or r and c and m.kind
        assert m.kind > 1 or m.mark in (H.LEFT_OUT, H.PLAIN)
    for t in {k[0] for k in found}:
        own = [m for k, m in found.items() if k[0] == t]
        weight = sum(1 if m.kind == 1 else 2 for m in own if m.mark != H.LEFT_OUT)
        hidden, blank = (sum(m.mark == k for m in own) for k in (H.HIDDEN, H.BLANK))
        assert hidden + blank <= min(20, int(0.2 * weight)) and blank != 1
        per = defaultdict(int)
        for m in own:
            per[(0 if m.column < 1 else 1) if m.row < 1 else (2 if m.column < 1 else 3)] += m.mark == H.BLANK
        assert max(per.values()) <= 3
    assert sum(m.mark == H.BLANK for m in found.values()) > 5 and sum(m.mark == H.HIDDEN for m in found.values()) > 2
    again = {(r.table_id, r.row, r.column): r.mark for r in H.marked(df.repartition(7), 1, 1).collect()}
    assert again == {k: m.mark for k, m in found.items()}


def test_sequences_equal_a_plain_version(spark):
    _, df = kinds(spark)
    cells = H.marked(df, 1, 1)
    draw = random.Random(9)
    snippets = [(f"t{t}", k, [1, *[draw.randint(6, 12) for _ in range(draw.randint(1, 12))]]) for t in range(8) for k in range(t)]
    snip = spark.createDataFrame(snippets, "table_id string, k int, ids array<int>")
    other = {(r.table_id, r.k): r.other for r in H.choices(snip).collect()}
    own = {(t, k): ids for t, k, ids in snippets}
    assert all(other[x] in [v for (t, _), v in own.items() if t != x[0]] for x in other) and not any(k == 0 for _, k in other)
    tables = defaultdict(list)
    for r in cells.collect():
        tables[r.table_id].append(r)
    found = {r.table_id: r for r in H.assembled(cells, VOCABULARY, snip, most=150, permuted=False).collect()}
    pools = {r.table_id: r for r in H.assembled(cells, VOCABULARY, snip, most=150).collect()}
    for t, rows in tables.items():
        tokens, indicator, at, blanks, holes, labels = [4], [-1], [(-1, -1)], [0], [], [-1]
        first = own.get((t, 0), [1])[1:9]
        tokens, indicator, at, blanks = tokens + first, indicator + [-2] * len(first), at + [(-1, -1)] * len(first), blanks + [0] * len(first)
        labels += [-1] * len(first)
        n = 1
        for r in sorted(rows, key=lambda r: (r.row, r.column)):
            if r.mark == H.LEFT_OUT:
                continue
            n += 1
            ids = {H.BLANK: [1, 2], H.HIDDEN: [r.ids[0]] + [3] * (len(r.ids) - 1), H.PLAIN: r.ids}[r.mark]
            if r.mark == H.BLANK:
                holes.append((len(tokens), r.ids))
                blanks += [-len(tokens), -len(tokens) - 1]
            else:
                blanks += [0] * len(ids)
            labels += [-1, *r.ids[1:]] if r.mark == H.HIDDEN else [-1] * len(ids)
            tokens, indicator, at = tokens + ids, indicator + [2 * n - 1] + [2 * n] * (len(ids) - 1), at + [(r.row, r.column)] * len(ids)
        for place, ids in holes:
            n += 1
            tokens, indicator, at = tokens + ids, indicator + [1 - 2 * n] + [-2 * n] * (len(ids) - 1), at + [(-1, -1)] * len(ids)
            blanks += [place, place + 1] + [0] * (len(ids) - 2)
        fixed, left, texts = len(tokens), 150 - len(tokens), []
        for k in range(1, 5):
            if (t, k) not in other:
                continue
            left -= len(own[t, k]) + len(other[t, k])
            if left < 0:
                break
            texts += [(own[t, k], 1), (other[t, k], 0)]
        if fixed > 150:
            assert t not in found
            continue
        f = found[t]
        assert f.labels == labels + [-1] * (f.length - len(labels))
        assert f.tokens[:fixed] == tokens and f.indicator[:fixed] == indicator and list(zip(f.rows, f.columns, strict=True))[:fixed] == at and f.blanks[:fixed] == blanks
        rest, marks = f.tokens[fixed:], f.choices[fixed:]
        assert f.length == len(f.tokens) == fixed + sum(len(x) for x, _ in texts) and set(f.choices[:fixed]) == {-1}
        got = []
        while rest:
            end = next((i for i in range(1, len(rest)) if rest[i] == 1), len(rest))
            assert marks[0] == marks[1] in (0, 1) and set(marks[2:end]) <= {-1}
            got.append((rest[:end], marks[0]))
            rest, marks = rest[end:], marks[end:]
        assert sorted(got) == sorted(texts)
        # A seeded order of the blanked cells: the same cells, each with its own place.
        assert sorted(pools[t].blanks) == sorted(f.blanks) and sorted(pools[t].tokens) == sorted(f.tokens)
    assert any(pools[t].blanks != found[t].blanks for t in found)
    alone = H.assembled(cells.where("table_id = 't0'"), VOCABULARY).collect()
    assert len(alone) == 1 and alone[0].tokens[0] == 4 and set(alone[0].choices) == {-1}
    assert H.assembled(cells.where("false"), VOCABULARY, snip).collect() == []


def test_batches_pad_little(spark):
    draw = random.Random(2)
    rows = [(f"t{i}", n, [1] * n, [2] * n) for i in range(100) for n in [draw.randint(1, 90)]]
    df = spark.createDataFrame(rows, "table_id string, length int, tokens array<long>, labels array<long>")
    found = H.batches(df, 8, {"tokens": 0, "labels": -1}).collect()
    groups = defaultdict(list)
    for r in found:
        groups[r.batch].append(r)
        assert r.tokens == [1] * r.length + [0] * (r.width - r.length) and r.labels == [2] * r.length + [-1] * (r.width - r.length)
    assert sorted(groups) == list(range(13)) and [len(groups[k]) for k in sorted(groups)] == [8] * 12 + [4]
    assert all(g[0].width == -(-max(r.length for r in g) // 8) * 8 for g in groups.values())
    for k in range(12):
        assert max(r.length for r in groups[k]) <= min(r.length for r in groups[k + 1])
    again = {r.table_id: r.batch for r in H.batches(df.repartition(5), 8, {}).collect()}
    assert again == {r.table_id: r.batch for r in found} and H.batches(df.where("false"), 8, {}).count() == 0


def plain_repository(strings, most):
    import hashlib

    draw = lambda i: hashlib.md5(f"43|{i}".encode()).hexdigest()
    pools = defaultdict(list)
    for i, ids in strings:
        if len(ids) >= 2:
            pools[min(8, len(ids))].append((draw(i), i, ids[:8]))
    out = {n: [(x[1], x[2]) for x in sorted(pools[n])[:most]] for n in range(2, 9)}
    for n in range(8, 1, -1):
        for d, i, ids in sorted(pools[n])[most:]:
            k = next((k for k in range(n - 1, 1, -1) if len(out[k]) < most), None)
            if k is not None:
                at = int(d[8:16], 16) % (len(ids) - k + 1)
                out[k].append((i, ids[at : at + k]))
    return sorted((n, i, ids) for n, rows in out.items() for i, ids in rows)


@pytest.mark.parametrize("most", [1, 5, 30, 500])
def test_repository_equals_a_plain_version(spark, most):
    draw = random.Random(most)
    strings = [(i, [draw.randint(0, 99) for _ in range(draw.choice([0, 1, 2, 5, 5, 5, 8, 9, 20]))]) for i in range(400)]
    df = spark.createDataFrame(strings, "id long, ids array<int>")
    assert sorted((r.length, r.id, r.ids) for r in H.string_repository(df, most).collect()) == plain_repository(strings, most)
    assert H.string_repository(df.where("false"), most).collect() == []


def test_attention(spark):
    draw = random.Random(4)
    path = lambda: [draw.choice([-1, 0, 31]), draw.choice([-1, 1]), draw.choice([-1, 63]), draw.choice([-1, 0, 255])]
    rows = [("t", k, i, path() if i else NONE, path() if i else NONE) for k, i in enumerate([-1, -2, 1, 2, 3, 4, 4, -5, -6, 0, 0])]
    nodes = lambda p: {(k, x) for k, x in enumerate(p) if x >= 0}
    for both, join in (("max", max), ("add", lambda x, y: x + y)):
        found = {r.place: r.distances for r in H.attention(spark.createDataFrame(rows, "table_id string, place int, indicator int, top array<int>, left array<int>"), both).collect()}
        for _, a, i, t, l in rows:
            for _, b, j, u, m in rows:
                want = 0 if -1 in (i, j) else join(len(nodes(t) ^ nodes(u)), len(nodes(l) ^ nodes(m)))
                want += 100 * (0 in (i, j))
                want *= 1 if i > 0 and j > 0 and i % 2 and j % 2 else 101
                assert found[a][b] == want
