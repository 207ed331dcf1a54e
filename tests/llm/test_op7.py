from tracelake.llm import op7_html as H

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T&amp;</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">two</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy this now.</div><article><h1>A title of words &amp;</h1><p><b>First part, with  some &lt;words&gt; in it.<br><p>Second part
goes on here, and on.</p><p>Third &#233;&nbsp;part is here too, the last one.</p></article><footer>&copy; site &middot; All rights.</footer></body></html>"""
TEXT = "A title of words &\nFirst part, with some <words> in it.\nSecond part goes on here, and on.\nThird é part is here too, the last one."


def test_article_without_boilerplate():
    assert H.extract([PAGE], H.models()) == [TEXT]


def test_cut_off_and_odd_markup():
    got = H.extract([PAGE[: PAGE.index("Third") + 30], "", "   ", "<", "<p", "</p></div>", "<p>Only text, in one block.", "<!-- never closed <p>x</p>", "<script>never closed", "<a href='x\" <p>>" * 50, "<div>" * 3000], H.models())
    assert got[0].startswith("A title of words &\nFirst part") and got[0].split("\n")[-1].startswith("Third é part")
    assert got[1:3] == ["", ""] and got[3] in ("", "<") and got[4:6] == ["", ""] and got[6] == "Only text, in one block." and got[7:9] == ["", ""]


def test_held_out_layouts():
    right = total = 0
    for source, main in H.sample_pages(80, seed=123):
        total += 1
        right += H.extract([source], H.models())[0] == "\n".join(main)
    assert right >= 0.9 * total


def test_choices_do_not_contradict():
    p = H.parse("<div><p>a</p><p>b</p></div><p>c</p>")
    import numpy as np

    mixed, inside = np.full(len(p.parent), 0.02), np.full(len(p.parent), 0.9)
    mixed[0] = 0.9
    leaf = [i for i, t in enumerate(p.text) if t == "b"][0]
    inside[leaf] = 0.3  # outvoted by its ancestors
    inside[[i for i, t in enumerate(p.text) if t == "c"][0]] = 0.01
    inside[p.parent[[i for i, t in enumerate(p.text) if t == "c"][0]]] = 0.05
    assert [p.text[i] for i, k in enumerate(H.decode(p, mixed, inside)) if k] == ["a", "b"]


def test_rows(spark):
    rows = [(1, "u", PAGE, 3, "x"), (None, None, None, 1, "y"), (1, "u", PAGE, 3, "x"), (2, "v", "", 0, "")]
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted([("1", TEXT, len(TEXT))] * 2 + [("None", "", 0), ("2", "", 0)])
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def prose(k):
    return f"<p>This is running text number {k}, with a good many ordinary words in it, and it goes on for a while so that it reads like prose.</p>"


def test_links_stay_and_forms_and_asides_in_the_article_go():
    around = "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Topics</a></li></ul></nav><article>{}</article><footer>&copy; site 2024. All rights reserved.</footer></body></html>"
    cases = {
        prose(1) + "<p><a href='/x'>A paragraph that is one link</a></p>" + prose(2): [1, "A paragraph that is one link", 2],
        "<h1><a href='/x'>The title is a link</a></h1>" + prose(1) + "<h2><a href='/y'>A heading as a link</a></h2>" + prose(2): ["The title is a link", 1, "A heading as a link", 2],
        prose(1) + prose(2) + "<ul><li><a href='/r1'>First linked reference</a></li><li><a href='/r2'>Second linked reference</a></li></ul>": [1, 2, "First linked reference", "Second linked reference"],
        prose(1) + "<form><label>Your mail</label><input name=q><button>go</button></form>" + prose(2): [1, 2],
        prose(1) + "<aside><p>Text beside the article, some words of it.</p></aside>" + prose(2): [1, 2],
        prose(1) + "<aside>Plain words beside the text.</aside>" + prose(2): [1, 2],
    }
    for inner, want in cases.items():
        text = "\n".join(prose(w)[3:-4] if isinstance(w, int) else w for w in want)
        assert H.extract([around.format(inner)], H.models()) == [text]
