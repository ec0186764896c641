"""The dealt operators against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _prose(rng, n, words=400):
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary, n))


def _documents():
    """(doc_id, text): copies, near copies, shared passages, cased and odd texts."""
    rng = np.random.default_rng(4)
    base = [_prose(rng, n) for n in (300, 80, 40, 13, 12, 5, 2, 1)]
    shared = _prose(rng, 30)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, t) for i, t in enumerate(base)]
    for k in range(6):
        words = base[0].split(" ")
        words[17 * k + 3] = "changed"
        rows.append((40 + k, " ".join(words)))
    rows += [(50 + k, f"{_prose(rng, 20)} {shared} {_prose(rng, 15)}\n{shared}") for k in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "ÀÉ" * 90 + " x"), (104, base[1].upper()), (105, "aaaa " * 60), (106, "a" * 500)]
    rows += [(110, _prose(rng, 4000)), (0, base[0])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    # extra columns whose names the operators use themselves
    for name in ("key", "gram", "spans", "node", "size", "score", "component"):
        frame = frame.withColumn(name, F.lit(1))
    return frame.repartition(5)


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_repeated_bytes(spark, docs, rows):
    from undertow.llm.suffix_dedup import repeated_bytes

    seen, want = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want[i] = (i, len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    assert _rows(repeated_bytes(docs)) == sorted(want[i] for i, _ in rows)
    assert repeated_bytes(_empty(spark)).count() == 0


def test_repeated_words(spark, docs, rows):
    from undertow.llm.tree_dedup import repeated_words

    first, want = {}, {}
    for i, text in sorted({(i, t or "") for i, t in rows}):
        words = WORD.findall(text)
        gone = np.zeros(len(words), bool)
        for p in range(len(words) - 12):
            if first.setdefault(tuple(words[p : p + 13]), i) < i:
                gone[p : p + 13] = True
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        want[i] = (i, len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    assert _rows(repeated_words(docs)) == sorted(want[i] for i, _ in rows)
    assert repeated_words(_empty(spark)).count() == 0


def test_two_stage_sorting_and_prefixes():
    from undertow.llm.suffix_dedup import common_prefixes, two_stage

    rng = np.random.default_rng(1)
    for letters in (1, 2, 3, 30):
        for _ in range(8):
            text = np.r_[rng.integers(1, 1 + letters, rng.integers(1, 200)).astype(np.uint8), np.uint8(0)]
            order, words = two_stage(text, 400)
            raw = text.tobytes()
            assert list(order) == sorted(range(len(text)), key=lambda i: raw[i:])
            shared = common_prefixes(order, words, 20)
            for k in range(1, len(order)):
                a, b = raw[order[k] :], raw[order[k - 1] :]
                n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
                assert shared[k] == min(n, 20) or n == min(len(a), len(b))


def test_prefix_groups_are_memory_sized():
    from undertow.llm.tree_dedup import deep_nodes, prefix_groups, subtree

    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 3, (500, 6)).astype(np.int32)
    group = prefix_groups(tokens, 40)
    for same in (tokens[:, None] == tokens[None]).all(2):
        assert len(set(group[same])) == 1
    order, depth = subtree(tokens)
    node = deep_nodes(depth, 6)
    assert len(set(node)) == len({tuple(t) for t in tokens})


def _sets(rows, size):
    out = {}
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else ({tuple(words)} if words else set())
    return out


def _components(nodes, linked):
    low = {i: i for i in nodes}
    while True:
        new = dict(low)
        for a, b in linked:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, rows, size):
    from undertow.llm.sketch_dedup import near_duplicates

    sets = _sets(rows, size)
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = _components(sets, linked)
    assert linked
    assert _rows(near_duplicates(docs, size)) == sorted((i, len(sets[i]), low[i], low[i] == i) for i, _ in rows)
    assert near_duplicates(_empty(spark), size).count() == 0


def test_near_duplicates_with_additions_rarer_than_a_large_group(spark):
    from undertow.llm.sketch_dedup import near_duplicates

    rng = np.random.default_rng(12)
    base = _prose(rng, 201, 3000).split(" ")
    rows = [(k, " ".join(base[:j] + [f"own{k}"] + base[j + 1 :])) for k, j in enumerate(rng.integers(1, 200, 250))] + [(300, " ".join(base))]
    for k in range(60):
        more = " ".join(f"more{k}x{j}" for j in range(49))
        # 249 word pairs, 200 of them the base's; two other documents hold the addition's
        rows += [(400 + k, " ".join(base) + " " + more), (500 + k, f"{more} {_prose(rng, 150)}"), (600 + k, f"{_prose(rng, 150)} {more}")]
    sets = _sets(rows, 2)
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = _components(sets, linked)
    assert all(low[400 + k] == 0 for k in range(60)) and len(set(low.values())) == 121
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == low


def test_documents_that_share_a_passage_are_not_compared(spark, monkeypatch):
    from undertow.llm import sketch_dedup

    held = {}

    def linked(members, *rest):
        held["members"] = members.select("key", "node").distinct().collect()
        return find(members, *rest)

    find = sketch_dedup.linked_components
    monkeypatch.setattr(sketch_dedup, "linked_components", linked)
    rng = np.random.default_rng(31)
    passage = _prose(rng, 60, 3000)
    rows = [(k, f"{passage} {_prose(rng, 70, 3000)}") for k in range(150)] + [(200 + k, _prose(rng, 120, 3000)) for k in range(20)]
    rows += [(300 + k, f"{rows[150 + k][1]} {_prose(rng, 20, 3000)}") for k in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in sketch_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: i - 100 if i >= 300 else i for i, _ in rows}
    lists: dict[int, list[int]] = {}
    for key, node in held["members"]:
        lists.setdefault(key, []).append(node)
    met = {p for x in lists.values() for p in itertools.combinations(sorted(x), 2)}
    assert {(200 + k, 300 + k) for k in range(20)} <= met
    # of 11,175 pairs of the 150 that share a passage
    assert len(met) < 600


def test_large_buckets_lose_no_link(spark):
    from undertow.llm.graph import linked_components

    # buckets of 200 and 90 members; only numbers of one residue are alike
    members = spark.range(200).select(F.lit(1).alias("key"), F.col("id").alias("node")).union(spark.range(150, 240).select(F.lit(2).alias("key"), F.col("id").alias("node")))
    found = linked_components(members, lambda pairs: pairs.filter("a % 7 = b % 7"))
    assert {r["id"]: r["component"] for r in found.collect()} == {i: i % 7 for i in range(240)}


def test_parities_rule_out_unlinked_members_of_a_large_group_and_no_other(spark, monkeypatch):
    from undertow.llm import sketch_dedup

    rng = np.random.default_rng(41)
    x = [rng.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(2)]
    x += [np.concatenate([x[0][:k], x[1][k:]]) for k in range(0, 400, 40)]
    for a, b in itertools.combinations(x, 2):
        apart = sum(int(p ^ q).bit_count() for p, q in zip(*(sketch_dedup.parities(s).view(np.uint64) for s in (a, b)), strict=True))
        assert apart <= len(np.setxor1d(a, b))
    base = _prose(rng, 201, 3000).split(" ")
    # any two share some 0.67 of their pairs: each member lies apart, in buckets of hundreds
    rows = [(k, " ".join(f"own{k}x{j}" if j in own else w for j, w in enumerate(base))) for k in range(150) for own in [set(rng.choice(200, 11, replace=False))]]
    rows += [(1000, rows[77][1] + " end")]
    asked = []

    def linked(members, near, likely, *rest):
        def counted(pairs):
            asked.append(pairs.count())
            return near(pairs)

        return find(members, counted, likely, *rest)

    find = sketch_dedup.linked_components
    monkeypatch.setattr(sketch_dedup, "linked_components", linked)
    sets = _sets(rows, 2)
    low = _components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert len(set(low.values())) > 100
    got = {r["doc_id"]: r["component_id"] for r in sketch_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == low
    # of 11,325 pairs
    assert sum(asked) < 600


def test_components_of_paths_and_stars(spark):
    from undertow.llm.graph import components

    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (7, None)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}}


def test_near_vectors(spark):
    from undertow.llm.multi_index import near_vectors

    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 16))
    x = (centre[rng.integers(0, 40, 600)] + rng.normal(0, 0.18, (600, 16))).astype(np.float32)
    x[500:540] = x[0]
    labels = [int(k) for k in rng.integers(0, 3, 600)]
    rows = [(i, [float(v) for v in x[i]], labels[i]) for i in range(600)]
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, [None] * 16, 1), (704, [1.0] * 16, None), (705, [], 1), (706, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(0))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(near, False)
    low = _components(range(600), list(zip(*np.nonzero(near))))
    want = [(i, int(near[i].sum()), low[i], low[i] == i) for i in range(600)] + [(i, 0, i, True) for i in range(700, 707)]
    assert near.sum() > 1000
    assert _rows(near_vectors(frame)) == sorted(want)
    assert near_vectors(frame.limit(0)).count() == 0


def test_near_vectors_of_many_cells(spark, monkeypatch):
    """Small cells and blocks: no link is made up or counted twice, and the measured bound reaches nearly all."""
    from undertow.llm import multi_index

    monkeypatch.setattr(multi_index, "CELL", 12)
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 16))
    x = (centre[rng.integers(0, 30, 900) // rng.integers(1, 9, 900)] + rng.normal(0, 0.2, (900, 16))).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(v) for v in x[i]], 1) for i in range(900)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in multi_index.near_vectors(frame).collect()}
    want = near.sum(1)
    assert all(got[i] <= want[i] for i in range(900))
    assert sum(got.values()) >= 0.99 * want.sum() > 1000


def test_language(spark):
    from undertow.llm.langid import BiGru, predictions

    rng = np.random.default_rng(5)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["xe", "zu", "qir"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(60)), lang) for i in range(160) for lang in [["aa", "bb"][i % 2]]]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (903, "KALOMI " * 3000, None)]
    got = {r["doc_id"]: r for r in predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:160])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # backpropagation through time against differences
    net = BiGru(3)
    x, mask, y = rng.integers(0, 256, (4, 6)), np.ones((4, 6)), np.array([0, 1, 2, 1])
    mask[1, 4:] = 0

    def loss():
        p, _ = net.forward(x, mask)
        return -(np.log(p[np.arange(4), :, y]) * mask).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for name, at in (("Uf", (1, 2)), ("Ub", (0, 20)), ("Wf", (2, 9)), ("kb", (5,)), ("V", (3, 1)), ("E", (int(x[0, 0]), 2))):
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        down = loss()
        net.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6, name


def test_tiling(spark):
    from undertow.llm.tiling import contamination

    rng = np.random.default_rng(6)
    item = _prose(rng, 40)
    words = item.split()
    swapped = " ".join(words[20:] + ["glue"] + words[:20]).upper() + "!"
    rows = [(1, f"{_prose(rng, 30)} {item}. {_prose(rng, 9)}"), (2, f"intro {swapped}"), (3, _prose(rng, 300)), (4, " ".join(words[:12])), (5, None), (6, "")]
    bench = spark.createDataFrame([(9, item), (10, "too short"), (11, None), (12, _prose(rng, 25))], "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("coverage", F.lit("x"))
    got = {r["doc_id"]: r for r in contamination(frame, bench).collect()}
    assert [i for i in got if got[i]["contaminated"]] == [1, 2] or {i for i in got if got[i]["contaminated"]} == {1, 2}
    assert got[1]["coverage"] == 1.0 and got[1]["item_id"] == 9
    assert contamination(frame, bench.limit(0)).filter("contaminated").count() == 0
    assert contamination(frame.limit(0), bench).count() == 0


def test_lines(spark):
    from undertow.llm.line_dedup import dedup_lines

    rng = np.random.default_rng(7)
    long = _prose(rng, 60)
    near = long.replace(long.split()[30], "other", 1)
    rows = [(1, f"{long}\nonly here\n\nsame"), (2, f"{near}\nSAME\n{_prose(rng, 30)}"), (3, "same"), (4, None), (5, ""), (6, f"{_prose(rng, 9000)}\nx  y\nx y"), (3, "same")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(0))
    got = {r["doc_id"]: r for r in dedup_lines(frame).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["n_removed"] == 2 and got[2]["text"] == rows[1][1].split("\n")[2]
    assert got[3]["text"] == "" and got[4]["text"] is None and got[5]["text"] == ""
    assert got[6]["n_removed"] == 1
    assert dedup_lines(frame).count() == 7
    assert dedup_lines(frame.limit(0)).count() == 0


def test_lines_with_one_typo_and_lines_without_spaces(spark):
    from undertow.llm.line_dedup import dedup_lines

    def shingles(line):
        line = " ".join(line.lower().split())
        return {line[i : i + 5] for i in range(max(1, len(line) - 4))}

    rng = np.random.default_rng(13)
    lines = [_prose(rng, n, 3000) for n in (12, 14, 16, 20) for _ in range(5)]
    lines += ["".join(chr(0x4E00 + k) for k in rng.integers(0, 5000, 60)) for _ in range(5)] + ["".join(rng.choice(list("abcdefgh/-"), 70)) for _ in range(5)]
    rows = list(enumerate(lines)) + [(1000, "abc"), (1001, "ABC"), (1002, "abd")]
    for k, line in enumerate(lines):
        at = len(line) // 2
        rows.append((100 + k, line[:at] + "#" + line[at + 1 :]))
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = _components(sets, linked)
    assert len(linked) > 25
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(low[i] != i) for i in low}


def test_candidate_lines_are_written_as_text(spark, monkeypatch):
    from undertow.llm import line_dedup
    from undertow.llm.tables import Tables

    kinds, write = {}, Tables.write

    def noted(self, df, name):
        kinds.setdefault(name, set()).update(f.dataType.simpleString() for f in df.schema.fields)
        return write(self, df, name)

    monkeypatch.setattr(Tables, "write", noted)
    rng = np.random.default_rng(21)
    line = _prose(rng, 30)
    # a pair of surrogates is one character; a line of four characters is one shingle
    rows = [(1, line), (2, line + "x"), (3, "\U0001f600" * 4), (4, "\U0001f600" * 3 + "a"), (5, "  a   b "), (6, "A b")]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}
    # a set of 64-bit shingles takes some eight times the bytes of its line
    assert not any("array" in kind for name in kinds if name != "distinct" for kind in kinds[name])


def test_a_large_group_of_like_lines_is_not_compared_pair_by_pair(spark, monkeypatch):
    from undertow.llm import line_dedup

    rng = np.random.default_rng(43)
    base = _prose(rng, 40, 3000)
    # any two share some 0.65 of their shingles: near the threshold, and most of them linked with none
    rows = [(k, "".join(chr(0x4E00 + 9 * k + list(at).index(i)) if i in at else c for i, c in enumerate(base))) for k in range(120) for at in [set(rng.choice(len(base), len(base) // 42, replace=False))]]
    rows += [(1000, rows[60][1] + "!")]
    sets = {i: {t[j : j + 5] for j in range(len(t) - 4)} for i, t in ((i, " ".join(t.lower().split())) for i, t in rows)}
    low = _components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert len(set(low.values())) > 60
    asked = []

    def linked(members, near, *rest):
        def counted(pairs):
            asked.append(pairs.count())
            return near(pairs)

        return find(members, counted, *rest)

    find = line_dedup.linked_components
    monkeypatch.setattr(line_dedup, "linked_components", linked)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(low[i] != i) for i in low}
    # of 7,260 pairs
    assert sum(asked) < 2500, asked


def test_mixing(spark):
    from undertow.llm.mixing import min_cost_flow, mix, quotas, word_count

    assert quotas({"a": 100, "b": 100}, {"a": 9, "b": 1}, 300, 2) == {"a": 200, "b": 100}
    flow = min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 18, "b": 9}, 2)
    assert sum(map(sum, flow.values())) == pytest.approx(27) and all(x[0] >= x[1] for x in flow.values())
    rng = np.random.default_rng(8)
    rows = [(i, _prose(rng, int(rng.integers(0, 60))) if i % 9 else None, [None, "s1", "s2", "S0"][min(3, i % 5)]) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    run = lambda: {r["doc_id"]: r for r in mix(frame, word_count(), F.array("source"), [3.0, 1.0, 2.0]).collect()}
    got = run()
    assert {i: r["taken"] for i, r in got.items()} == {i: r["taken"] for i, r in run().items()}
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got.values())
    for source in {r[2] for r in rows}:
        some = [got[i] for i, _, s in rows if s == source]
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 30
    assert mix(frame.limit(0), word_count(), F.array("source"), [1.0]).count() == 0


def test_toxicity(spark):
    from undertow.llm.toxicity import Automaton, toxicity

    terms = ["moron", "idiot", "cur"]
    automaton = Automaton(terms)

    words = ["moron", "morn", "moroon", "maron", "mroon", "idiott", "dio", "cur", "cut", "m", "idiotic", "morom", "xmoron"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    place, _, cost = automaton.run(data, end - [len(w) for w in words], end)
    assert {words[p]: int(c) for p, c in zip(place, cost)} == {"moron": 0, "morn": 1, "moroon": 1, "maron": 1, "idiott": 1, "cur": 0, "morom": 1, "xmoron": 1}
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(400):
        text = _prose(rng, 50)
        if i % 5 == 0:
            text += " you moron you idiot " + _prose(rng, 5)
        rows.append((i, text))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "!!")]
    got = {r["doc_id"]: r for r in toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.97
    assert all(got[i]["predicted"] == 0 for i in (1000, 1001, 1002))


def test_extraction(spark):
    from undertow.llm.extract import extract

    rng = np.random.default_rng(10)
    menu, foot = _prose(rng, 12), _prose(rng, 15)
    rows, want = [], {}
    for k in range(12):
        body = [_prose(rng, 30), _prose(rng, 20)]
        # no article element: only the host's other pages tell what is boilerplate
        rows.append((k, "http://h.example/x", f"<div>{menu}</div><div>{body[0]}<p>{body[1]}</div><div>{foot}</div>"))
        want[k] = "\n".join(body)
    rows.append((20, "http://g.example/a", "<nav>x y</nav><article><h1>A &amp;amp; B</h1><p><b>one\n two<br>three<p class=comments>no<script>if (a<b) {}</script></article><footer>z"))
    want[20] = "A &amp; B\none two three"
    rows += [(21, None, None), (22, "u", ""), (23, "u", "plain < text"), (24, "u", "<article>" + "long " * 30000 + "</article>")]
    want |= {21: "", 22: "", 23: "plain < text", 24: ("long " * 30000).strip()}
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("stream", F.lit(0))).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_keeps_clean_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
    out = corpus_pipeline.run(spark, sf)
    assert 0.6 * docs.count() < out.count() <= docs.count()
    assert {"doc_id", "taken", "target"} <= set(out.columns)


def test_written_tables_replace_each_other(spark):
    from undertow.llm.tables import Tables

    tables = Tables(spark)
    first = tables.write(spark.range(5), "t")
    second = tables.write(first.filter("id > 2"), "t")  # derived from the table it replaces
    assert sorted(r["id"] for r in second.collect()) == [3, 4]
    empty = tables.write(second.filter("id > 9"), "none")
    assert empty.isEmpty() and empty.columns == ["id"]
    base = spark._jvm.org.apache.hadoop.fs.Path(tables.base)
    names = {s.getPath().getName() for s in base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base)}
    assert names == {"t-1", "none-0"}
    tables.drop("t", "unknown")
