"""Main text of pages without an article, on hosts of heavy boilerplate."""

import time

import numpy as np
import pytest

from undertow.llm import extract as ex
from undertow.llm.extract import blocks, extract


def test_runs_go_and_own_words_stay(spark):
    rng = np.random.default_rng(14)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(n))
    menu, half = prose(400), prose(30)
    rows, want = [], {}
    for k in range(6):
        own, tail = prose(30), prose(29)
        # over nine tenths repeated; a block just over half repeated keeps its other words
        rows.append((k, "http://h.example/x", f"<div>{menu}</div><p>{own}</p><div>{half} {tail}</div>"))
        want[k] = f"{own}\n{tail}"
    copy = prose(60)
    rows += [(10 + k, "http://c.example/x", f"<p>{copy}</p>") for k in range(4)]
    # two different streams only, though one has three copies
    rows += [(20 + k, "http://d.example/x", f"<p>{menu}</p>") for k in range(3)] + [(23, "http://d.example/x", f"<p>{menu} end</p>")]
    want |= {10 + k: copy for k in range(4)} | {20 + k: menu for k in range(3)} | {23: f"{menu} end"}
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="layout has-sidebar"><article><p>text</p></article></div>', "text"),
        ('<article><h1 class="article-header">Title</h1><section class="related-work">work</section></article>', "Title\nwork"),
        ('<article>own<div class="site-footer">f</div><div class="cookie-banner">c</div><p class="ad">a</p><p id="share-buttons">s</article>', "own"),
        ("<p data=it's>Hello world it's me</p><p>second</p>", "Hello world it's me\nsecond"),
        ('<p title = "a>b">q', "q"),
        ("a <b>c</b><!-- open", "a c"),
    ],
)
def test_marks_and_quotes(page, want):
    assert "\n".join(t for t, _, off in blocks(page) if not off) == want


@pytest.mark.parametrize("page", ["<a " * 300_000, "<!" * 300_000, '<x a="' * 100_000, "<div>" * 100_000 + "</x>" * 100_000, "<b>" * 60_000 + "<p></p>" * 60_000])
def test_malformed_pages_are_read_once(page):
    begin = time.monotonic()
    assert blocks(page) == []
    assert time.monotonic() - begin < 15


def _brute_frames(articles):
    """Text of each (host, block texts) without the runs of 20 words that half of the host's articles hold, looked up one by one."""
    out = []
    for host, parts in articles:
        of = [[w for b in bs for w in b.split(" ")] for h, bs in articles if h == host and bs]
        words = [(w, k) for k, b in enumerate(parts) for w in b.split(" ")]
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            run = [w for w, _ in words[i : i + 20]]
            holds = [a for a in of if any(a[j : j + 20] == run for j in range(len(a) - 19))]
            different, all_different = {tuple(a) for a in holds}, {tuple(a) for a in of}
            if len(different) >= 3 and 2 * len(holds) >= len(of) and 2 * len(different) >= len(all_different):
                gone[i : i + 20] = [True] * 20
        if 2 * sum(gone) > len(words):
            gone = [False] * len(words)
        left = [" ".join(w for (w, j), x in zip(words, gone) if j == k and not x) for k in range(len(parts))]
        out.append("\n".join(t for t in left if t))
    return out


@pytest.mark.parametrize("held", [1 << 22, 100])
def test_runs_in_articles_go_too(spark, monkeypatch, held):
    rng = np.random.default_rng(21)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(n))
    licence, short, rare, copy = prose(30), prose(12), prose(25), prose(80)
    articles = []
    for k in range(9):
        # repeated on every page, a short phrase on every page, a passage on three of nine pages
        tail = f"{prose(4)} {licence}" if k % 2 else licence
        articles.append(("a.example", [prose(40), f"{prose(9)} {short} {prose(9)}", *([rare] if k < 3 else []), tail]))
    for k in range(5):
        words = copy.split(" ")
        words[7 * k + 3] = "other"
        articles.append(("near.example", [" ".join(words)]))
    articles += [("same.example", [prose(5), licence])] * 4 + [("two.example", [prose(50), licence]) for _ in range(2)]
    # half of the pages are copies of one article, the rest of them differ
    articles += [("half.example", [copy])] * 4 + [("half.example", [prose(60), rare]) for _ in range(4)]
    articles += [("edge.example", [prose(30), *([rare] if k < 3 else [])]) for k in range(6)] + [("over.example", [prose(30), *([rare] if k < 3 else [])]) for k in range(7)]
    rows = [(k, f"http://{host.upper()}/x", "<nav>n</nav><article>" + "".join(f"<p>{b}" for b in bs) + "</article>") for k, (host, bs) in enumerate(articles)]
    monkeypatch.setattr(ex, "HELD", held)
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = _brute_frames(articles)
    assert [got[k]["text"] for k in range(len(rows))] == want
    assert all(licence not in want[k] and short in want[k] for k in range(9)) and rare in want[0]
    assert want[9] == articles[9][1][0] and got[0]["n_repeated"] == 1 and got[9]["n_repeated"] == 0
    assert all(got[k]["n_chars"] == len(want[k]) for k in got)


@pytest.mark.parametrize("held", [1 << 22, 60, 1])
def test_grams_of_tasks_bound_the_whole_count(held, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    shared = word(30)
    pages = [f"<main>{word(25)} {shared if k % 2 else word(30)}</main>" for k in range(20)]
    monkeypatch.setattr(ex, "HELD", held)
    batches = [pa.RecordBatch.from_arrays([pa.array(["h"] * 2), pa.array([None] * 2, pa.string()), pa.array(pages[k : k + 2])], ["host", "url", "html"]) for k in range(0, 20, 2)]
    found = [r for part in ex._shared(batches) for r in part.to_pylist() if r["host"] is not None]
    assert sum(r["pages"] or 0 for r in found) == 20 and len({r["stream"] for r in found if r["stream"] is not None}) == 20
    over = {}
    for r in found:
        if r["gram"] is not None:
            over[r["gram"]] = over.get(r["gram"], 0) + r["over"]
    slack = sum(r["slack"] or 0 for r in found)
    may = {g for g, n in over.items() if 2 * (n + slack) >= 20}
    (tokens, _), = ex._streams([blocks(f"<main>{shared}</main>")], article=True)
    assert set(ex._grams(tokens).tolist()) <= may
