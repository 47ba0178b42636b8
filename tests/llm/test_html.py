import random
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import frames
from quarry.llm.html import LOOSE, OPEN, SURE, blocks, main_text, repeated_runs, suffix_array

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class=sidebar><header>Top</header><nav><a>menu</a></nav>
<!-- c --><div class="ad box">buy</div><article><header><h1>Head &amp; more</h1></header><p><b>A  b<br><p>c&nbsp;d <i>e</i>f&ampx &lt;tag&gt; &#233;<script>var x='</p>';</script>
<div class="comments">no<p>no</div><form>f</form><ul><li>one<li>two</ul></article>tail<footer>f &copy;"""


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (PAGE, [("Head & more", SURE), ("A b", SURE), ("c d ef&x <tag> é", SURE), ("one", SURE), ("two", SURE), ("tail", OPEN)]),
        ("", []),
        ("plain <b>text", [("plain text", OPEN)]),
        ("<div", []),
        ('<div title="a>b">x</div><p hidden>y</p>', [("x", OPEN)]),
        ("<script>never closed <p>x", []),
        ('<article><div class="article-header"><h1>Title</h1></div><div class="social-history"><p>Body</p></div></article>', [("Title", SURE), ("Body", SURE)]),
        ('<main><div class="content related"><p>Body</p></div></main>', [("Body", SURE)]),
        ('<article><p class="advertisement">x<p>y<ul><li class="comment">c<li>d</ul><span hidden>e</span> f</article>', [("y", SURE), ("d", SURE), ("f", LOOSE)]),
        ('<p class="cookie">k</p><p>z</p>', [("z", OPEN)]),
        ('<article>a <span class="ad">b</span> c <div class="comment-body"><p>q</div><div id=site-header>h</div></article>', [("a c", LOOSE), ("h", LOOSE)]),
        ('<div class="site-header">h</div><div class="post-content share">t</div><div class="share">s</div>', [("t", OPEN)]),
        ("<article><p>a<p>b<ul><li>c<ul><li>d</ul>e<li>f</ul><table><tr><td>g<td>h</table></article>", [(x, SURE) for x in "abcdefgh"]),
    ],
)
def test_blocks(page, want):
    assert list(zip(*blocks(page), strict=True)) == want


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 200):
        t = rng.integers(0, 3, n)
        order, lcp = suffix_array(t)
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        for i in range(1, n):
            a, b = t[order[i - 1] :].tolist(), t[order[i] :].tolist()
            assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_runs_of_a_host():
    menu = "home news sport weather business culture travel contact us today"
    pages = [[menu, f"story {i} has words of number {i * 7} only here {i * 13}"] for i in range(6)]
    name, n = repeated_runs(pages, 8)
    grams = defaultdict(set)
    for i, x in enumerate(pages):
        w = " ".join(x).split(" ")
        for k in range(len(w) - 7):
            grams[tuple(w[k : k + 8])].add(i)
    assert len(np.unique(name)) == len(name) == len(grams) and sorted(n.tolist()) == sorted(len(x) for x in grams.values())
    assert [len(x) for x in repeated_runs([["too few"], []], 8)] == [0, 0]


def brute(rows):
    """Text of each page by the rules on blocks(): 8 tokens on 3 distinct pages of a host go from undecided blocks."""
    parsed = [(url, *blocks(page or "")) for _, url, page, *_ in rows]
    host = lambda u: (u or "").split("/")[2].lower() if "://" in (u or "") else ""
    tokens = lambda b, k: [w for x, z in zip(b, k, strict=True) if z != SURE for w in x.split(" ")]
    seen = defaultdict(set)
    for url, b, k in parsed:
        if LOOSE in k or SURE not in k:
            w = tokens(b, k)
            for i in range(len(w) - 7):
                seen[host(url), tuple(w[i : i + 8])].add((tuple(b), tuple(k)))
    out = []
    for url, b, k in parsed:
        w = tokens(b, k)
        gone = {j for i in range(len(w) - 7) if len(seen[host(url), tuple(w[i : i + 8])]) >= 3 for j in range(i, i + 8)}
        at, left = 0, []
        for x, z in zip(b, k, strict=True):
            held = x.split(" ")
            if z != SURE:
                kept = [v for j, v in enumerate(held) if at + j not in gone]
                at += len(held)
                held = [] if z == OPEN and any(y != OPEN for y in k) else kept
            if held:
                left.append(" ".join(held))
        out.append("\n".join(left))
    return out


def test_pages_against_brute_force(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    hosts = ["a.org", "a.org", "a.org", "b.org", "c.org", "d.org"]
    menus = {h: [say(12), say(30)] for h in hosts}
    shared, rows = say(40), []
    for i in range(150):
        h = rng.choice(hosts)
        body = "".join(f"<p>{say(rng.randrange(2, 30))}" for _ in range(rng.randrange(4)))
        body += f"<p>{shared}" * (i % 5 == 0) + f"<div>{rng.choice(menus[h])}</div>" * (i % 3 == 0)
        page = f"<div>{menus[h][0]}</div>" + (f"<article>{body}</article>" if i % 2 else f"<div>{body}</div>") + f"<div>{menus[h][1]} {say(3)}</div>"
        rows.append((i, f"https://{h.upper() if i % 7 == 0 else h}/{i}", page, 1))
    rows += [(200 + i, "https://e.org/", f"<div>{say(20)}</div>", 1) for i in range(1)] * 5  # copies of one page count once
    rows += [(300 + i, "https://f.org/", f"<div>{menus['a.org'][0]} {menus['a.org'][1]}</div>{'<p>' * i}", 1) for i in range(4)]
    rows += [(400 + i, "https://g.org/", f"<div>{menus['a.org'][1]}</div><p>{i}</p>", 1) for i in range(4)]
    rows += [(500, "http://a.org/x", PAGE, 1), (501, None, None, 1), (502, "http://a.org/y", "", 1), (503, "odd", "<p>a</p><p>b</p>", 1), (503, "odd", "<p>a</p><p>b</p>", 1), (None, "http://b.org/z", "<main>m</main>", 1), (504, "http://a.org/l", f"<p>{'long words ' * 40_000}</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(5)
    want = sorted(((r[0], t) for r, t in zip(rows, brute(rows), strict=True)), key=str)
    got = main_text(df).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=str) == want
    assert all(r.n_chars == len(r.text) for r in got)
    held = dict(want)
    assert held[400] == "0" and held[500] == "Head & more\nA b\nc d ef&x <tag> é\none\ntwo" and held[None] == "m" and held[501] == ""
    assert any(menus["a.org"][1] in p and menus["a.org"][1] not in held[i] for i, _, p, _ in rows if i is not None and i < 150)
    assert main_text(df.where("false")).count() == 0


def test_a_page_of_boilerplate_alone_is_empty(spark):
    menu = "home news sport weather business culture travel contact us today"
    rows = [(i, "http://h.org/", f"<div>{menu}</div><p>{'x' * i}</p>") for i in range(4)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "", 1: "x", 2: "xx", 3: "xxx"}


def test_every_page_is_decided_by_the_arrays(spark):
    """Boilerplate of a host goes from text elements of an article too, if markup elsewhere names it; what only articles share stays."""
    notice = "sign up today for our letter and read the best stories each week"
    shared = "a passage that several articles of this host quote word for word in full"
    teaser = "a headline of more than eight words that menus of other pages repeat"
    page = lambda i, *more: f"<nav>{'x' * i} {teaser}</nav><article><p>story {i} of {i * 7}</p><p>{shared}</p>{''.join(more)}</article>"
    rows = [(i, "http://h.org/", page(i, f"<p>{notice}</p>") + f"<div class=newsletter>{notice}</div>") for i in range(4)]
    rows += [(9, "http://h.org/t", page(9, f"<h2>{teaser}</h2>")), (10, "http://other.org/", page(10, f"<p>{notice}</p>"))]
    # adverts may quote what some articles share: that stays, as long as it isn't in half of the host's pages
    rows += [(20 + i, "http://p.org/", f"<div class=ad>{shared}</div><article><p>{i}</p>{f'<p>{shared}</p>' * (i < 3)}</article>") for i in range(8)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    quoted = {i: got.pop(i) for i in range(20, 28)}
    assert quoted == {20 + i: f"{i}\n{shared}" if i < 3 else str(i) for i in range(8)}
    want = {i: f"story {i} of {i * 7}\n{shared}" for i in range(4)}
    assert got == want | {9: f"story 9 of 63\n{shared}\n{teaser}", 10: f"story 10 of 70\n{shared}\n{notice}"}
    # marked blocks are evidence against undecided ones too
    rows = [(i, "http://h.org/", f"<footer>{notice}</footer><article><p>{i}</p></article>") for i in range(3)] + [(5, "http://h.org/", f"<div>{notice}</div><div>own</div>")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "0", 1: "1", 2: "2", 5: "own"}


def held_bytes(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


@pytest.mark.parametrize("form", ["<nav>{menu}</nav><article>{body}</article>", "<div>{menu}</div><div>{body}</div>"])
def test_pages_are_stored_once(spark, tmp_path, monkeypatch, form):
    """With nothing or something to clear, the tables held at once are about as large as the input: texts aren't stored beside the parsed pages."""
    rng = random.Random(5)
    say = lambda n: " ".join(f"{rng.getrandbits(40):x}" for _ in range(n))
    menu = say(12)
    bodies = [[say(60) for _ in range(4)] for _ in range(400)]
    rows = [(i, "http://h.org/", form.format(menu=menu, body="".join(f"<p>{x}</p>" for x in body))) for i, body in enumerate(bodies)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2).write.option("compression", "zstd").parquet(f"{tmp_path}/in")
    monkeypatch.setattr(frames, "shared_folder", lambda _: str(tmp_path / "held"))
    peak, write = [], frames.Tables.write
    monkeypatch.setattr(frames.Tables, "write", lambda self, df: (write(self, df), peak.append(held_bytes(tmp_path / "held")))[0])
    got = main_text(spark.read.parquet(f"{tmp_path}/in"))
    peak.append(held_bytes(tmp_path / "held"))
    assert {r.page_id: r.text for r in got.collect()} == {i: "\n".join(body) for i, body in enumerate(bodies)}
    assert max(peak) < 1.3 * held_bytes(tmp_path / "in")


def test_copies_and_their_host_are_cleared_alike(spark):
    """Copies are looked at once in a task, and their places count for each; the same page of another host keeps what is boilerplate only here."""
    menu = "home news sport weather business culture travel contact us today"
    page = lambda i: f"<div>{menu}</div><p>{i} story</p>"
    rows = [(i, "http://h.org/", page(i // 40)) for i in range(160)] + [(900 + i, "http://other.org/", page(0)) for i in range(3)]
    for parts in (1, 6):
        got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}
        assert got == {i: f"{i // 40} story" for i in range(160)} | {900 + i: f"{menu}\n0 story" for i in range(3)}
