"""Tables: layout kept where it is in proportion, all text kept where it is not, in bounded time and space."""

import random
import time

import pytest

from lodecraft.llm import html_text


def rendered(html):
    start = time.time()
    text = html_text.render(html)[1]
    assert time.time() - start < 20
    return text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", "a |   | b\nc | d | e"),
        ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td>d<tr><td>e<td>f<tr><td>g</table>", "a | b | c\n  |   | d\n  | e | f\ng"),
    ],
)
def test_layout(html, text):
    assert rendered(html).strip("\n") == text


def test_one_long_cell_pads_no_other_row():
    html = "<table><tr><td>" + "x" * 100_000 + "<td>b" + "".join(f"<tr><td>{k}<td>y" for k in range(1000)) + "</table>"
    text = rendered(html)
    assert len(text) < 2 * len(html) and "999 | y" in text and "7   | y" in text


@pytest.mark.parametrize(
    "html",
    [
        "<table>" + "".join(f"<td colspan=1000 rowspan=65534>c{k}" for k in range(400)) + "</table>",
        "<table>" + "".join(f"<tr><td colspan={k % 1000 + 1} rowspan={60000 - k}>r{k}<td>s{k}" for k in range(4000)) + "</table>",
        "<table>" + "".join(f"<td rowspan={60000 - k}>a{k}" for k in range(5000)) + "".join(f"<tr><td>b{k}" for k in range(5000)) + "</table>",
        "<table>" + "".join(f"<tr><td colspan={k}>d{k}<td>e{k}" for k in range(1, 1000)) + "</table>",
        "<table><tr><td>" * 40 + "deep" + "<td>x<tr><td colspan=900>y<td>z</table>" * 40,
        "<table><td colspan=1000>p<td>q</table>" * 3000,
    ],
)
def test_output_is_bounded_and_whole(html):
    text = rendered(html)
    assert len(text) <= 20 * len(html)
    want = [w for w in html.replace("<", " <").replace(">", "> ").split() if "<" not in w and ">" not in w and "=" not in w]
    assert sorted(w for w in text.split() if w != "|") == sorted(want)


def test_random_tables_keep_all_text():
    rng = random.Random(5)
    for _ in range(200):
        n = 0
        html = "<table>"
        for _ in range(rng.randint(0, 6)):
            html += "<tr>"
            for _ in range(rng.randint(0, 5)):
                html += f"<td colspan={rng.randint(1, 3)} rowspan={rng.randint(1, 3)}>" + rng.choice(["", f"t{n}", f"t{n} u{n}<br>v{n}"])
                n += 1
        text = rendered(html + "</table>")
        words = html.replace("<", " <").replace(">", "> ").split()
        assert sorted(w for w in text.split() if w != "|") == sorted(w for w in words if w[0] in "tuv" and "<" not in w)
