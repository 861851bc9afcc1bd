"""Main text of pages without article or main, and the labelling of small pages against all labellings."""

from itertools import product

import numpy as np
import pytest

from pathwright.llm import main_text as M

ARTICLE = "<p>The river rose again last night, and the town moved its boats.</p><p>Nobody slept; the bells rang until morning came over the hills.</p>"
TEXT = "The river rose again last night, and the town moved its boats. Nobody slept; the bells rang until morning came over the hills."
PARTS = {
    "footer": "<footer>{}</footer>", "form": "<form>{}</form>", "comments": "<div id=comments>{}</div>", "dialog": "<div role=dialog>{}</div>", "aside": "<aside>{}</aside>",
    "sidebar": '<div class="sidebar">{}</div>', "nav": "<nav>{}</nav>", "advert": '<div class="advert">{}</div>', "cookies": '<section class="cookie-notice">{}</section>', "related": '<ul class="related">{}</ul>',
}
SHAPES = {"bare": "<body><h1>High water</h1>{}{}</body>", "content": "<body><div class=content><h1>High water</h1>{}</div>{}</body>", "wrapper": "<body><div class=wrapper><h2>High water</h2>{}</div>{}</body>"}


@pytest.fixture(scope="module")
def weights():
    import pyarrow.parquet as pq

    return M.fit(pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist())


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("part", PARTS)
def test_boilerplate_stays_out_however_long(weights, part, shape):
    for n in (1, 3, 20, 200):
        other = PARTS[part].format("".join(f"<p>Sentence {i} of the other part says this, and more of it.</p>" for i in range(n)))
        assert M.main_text(SHAPES[shape].format(ARTICLE, other), weights) == "High water " + TEXT
        before = SHAPES[shape].replace("<body>", "<body>" + other.replace("{", "{{")).format(ARTICLE, "")
        assert M.main_text(before, weights) == "High water " + TEXT


def test_wrappers_keep_the_main_text(weights):
    inside = f"<nav><a href=/>Home</a></nav><div class=page><h1>High water</h1>{ARTICLE}</div><div class=sidebar><p>Links of the week are here, and some more of them.</p></div>"
    assert M.main_text(f"<form id=aspnetForm>{inside}</form>", weights) == "High water " + TEXT
    assert M.main_text(f"<form><div class='widget-area'>{inside}</div></form>", weights) == "High water " + TEXT
    # of two possible wrappers the one with a heading
    two = f"<div class='sidebar-layout'><h1>High water</h1>{ARTICLE}</div><div class='widget'><p>{'Words of a widget go on here, many of them. ' * 40}</p></div>"
    assert M.main_text(two, weights) == "High water " + TEXT
    assert M.main_text(f"<div class=comments><h2>Comments</h2>{ARTICLE}</div>", weights) == ""


def test_deep_and_long_boilerplate(weights):
    assert M.main_text("<form>" * 4_000 + ARTICLE + "</form>" * 4_000, weights) == TEXT
    assert M.main_text(f"<h1>High water</h1>{ARTICLE}" + "<aside><p>More of the same, over and over.</p></aside>" * 3_000, weights) == "High water " + TEXT


def test_labels_are_the_cheapest_of_all(weights):
    """Every labelling of up to eleven blocks, priced from the blocks themselves."""
    rng = np.random.default_rng(5)
    kinds = ["<p>Words of a sentence number {}, and some more of it.</p>", "<li><a href=x>Link {}</a></li>", "<h2>Title {}</h2>", "<div>Short {}</div>", "<nav>Menu {}</nav>", "<div><p>One {}; two.</p><span>x</span></div>", "<aside><p>Other {} text. More of it.</p></aside>"]
    for _ in range(60):
        page = "".join(kinds[k].format(i) for i, k in enumerate(rng.integers(0, len(kinds), rng.integers(2, 10))))
        page = f"<div><h1>Head</h1>{page}</div>" if rng.random() < 0.5 else page
        blocks = M.blocks_of(page)
        assert len(blocks) <= 13
        z = M.features(blocks) @ weights
        own = [(np.log1p(np.exp(-v)), np.log1p(np.exp(v))) for v in z]  # as content, as boilerplate
        near = []
        last = {}
        for i, b in enumerate(blocks):
            if i:
                near.append((i - 1, i, M.NEAR * b.common / max(1, blocks[i - 1].depth, b.depth)))
            if b.container in last and not (b.bad or blocks[last[b.container]].bad):
                near.append((last[b.container], i, M.DOM))
            last[b.container] = i
        best = None
        for labels in product(*[(0,) if b.bad else (0, 1) for b in blocks]):
            cost = sum(own[i][0] if x else own[i][1] for i, x in enumerate(labels) if not blocks[i].bad) + sum(w for i, j, w in near if labels[i] != labels[j])
            if best is None or cost < best[0]:
                best = (cost, labels)
        assert M.main_text(page, weights) == " ".join(b.text for b, x in zip(blocks, best[1], strict=True) if x)
