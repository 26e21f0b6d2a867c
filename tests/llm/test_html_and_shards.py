import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodecraft.llm import html_text, shards, tokens


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>one<p>two <b>x</b>  y<br>z", "one\n\ntwo x y\nz"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=3><li>q<li>r</ol>", "3. q\n4. r"),
        ("<table><tr><th>ab<th>c<tr><td>d<td>efg</table>", "ab | c\nd  | efg"),
        ("<title>T</title><div hidden>no</div><div style='display: none'>no</div><script>x<p></script>yes", "yes"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("a &amp; b &lt;i&gt; &eacute;", "a & b <i> é"),
        ("<details><summary>s</summary>gone</details><details open>here</details>", "s\nhere"),
        ("x < y and <> z", "x < y and <> z"),
        ("", ""),
        ("<b><i>deep" + "<div>" * 3000 + "x", "deep\nx"),
        ("<!-- c --><h1>H</h1><p>p</p>", "H\n\np"),
        ("<p>unclosed <b>bold<p>next</b> t", "unclosed bold\n\nnext t"),
    ],
)
def test_rendering(html, text):
    assert html_text.render(html)[1] == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>T</title><font><p>one<p>two</font>", "one\n\ntwo"),
        ("<head><title>T</title><a href=x>link</a> and <img src=y> <b>bold</b><p>p", "link and bold\n\np"),
        ("<html><head><meta charset=utf-8>\n<style>s</style>\nplain text", "plain text"),
        ("<head><title>T</title><script>no</script><noscript><img>no</noscript><template>no</template> \n</head><body>yes", "yes"),
        ("<head><head><title>T</title></head><span>x</span>", "x"),
    ],
)
def test_head_ends_where_content_begins(html, text):
    assert html_text.render(html) == ("T" if "<title>" in html else None, text)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tbody>loose<div>box</div><tr><td>a<td>b</table>", "loose\nbox\na | b"),
        ("<table><tbody><form><tr><td>a<td>b<tr><td>c<td>d</form></table>", "a | b\nc | d"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", "a |   | b\nc | d | e"),
        ("<table><tr><td>漢字<td>x<tr><td>abcd<td>y<tr><td>ab<td>z</table>", "漢字 | x\nabcd | y\nab   | z"),
        ("<tr>stray<td>cell</tr>", "stray\ncell"),
        ("<svg><title>no</title><desc>no</desc><text x=1 y=2>in svg</text><path d=z /></svg> <math><mi>x</mi><annotation>no</annotation></math> <object data=f>instead</object>", "in svg x instead"),
        ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
        ("<div hidden/>x</div>y", "y"),
        ("<p hidden><a href=x/>gone</a></p>y", "y"),
        ("<div style='visibility: hidden'>no <b style='visibility:visible'>yes</b> no</div>z", "yes\nz"),
        ("<div style='content-visibility: hidden'>no</div><div style='backface-visibility: hidden'>yes</div>", "yes"),
        ("<div hidden>" + "<div>" * 2500 + "a" + "</div>" * 2300 + "b" + "</div>" * 201 + "c", "c"),
        ("<div>" * 2500 + "<p hidden>a<b>b</b></p><script>c</script>d" + "</div>" * 2500 + "<p>e", "d\n\ne"),
        ("<ul>" + "<li>x<ul>" * 300, "\n".join("  " * k + "- x" for k in range(300))),
    ],
)
def test_what_browsers_show(html, text):
    assert html_text.render(html)[1] == text


def test_words_of_whole_pages_are_those_of_another_parser(spark):
    """The standard library's event parser, which knows no trees, finds the same words on the test pages."""
    from collections import Counter
    from html.parser import HTMLParser
    from pathlib import Path

    folder = Path("/root/testdata/sf0.01/pages.parquet")
    if not folder.exists():
        pytest.skip("no test tables")

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.said, self.hides = [], [], 0

        def handle_starttag(self, tag, attributes):
            if tag in html_text.VOID:
                self.said.append(" ")
                return
            a = dict(attributes)
            hides = tag in html_text.HIDDEN or "hidden" in a or (tag == "dialog" and "open" not in a) or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style") or ""))
            self.open.append((tag, hides))
            self.said.append(" " if tag in html_text.BLOCK else "")

        def handle_endtag(self, tag):
            tags = [t for t, _ in self.open]
            if tag in tags:
                del self.open[len(tags) - 1 - tags[::-1].index(tag) :]
            self.said.append(" " if tag in html_text.BLOCK else "")

        def handle_data(self, data):
            if not any(h for _, h in self.open):
                self.said.append(data)

    same = total = 0
    for r in spark.read.parquet(str(folder)).select("html").collect():
        parser = Words()
        parser.feed(r.html or "")
        parser.close()
        mine = re.sub(r"(?m)^ *(?:- |\d+\. )+|\|", " ", html_text.render(r.html)[1] or "")
        clean = lambda t: Counter(re.findall(r"[^\W\d_]+", t))
        total += 1
        same += clean(mine) == clean("".join(parser.said))
    assert total > 100 and same >= 0.98 * total, (same, total)


def test_extract_cases(spark):
    rows = [(1, "<title>A &amp; B</title>x", 5), (1, "<title>A &amp; B</title>x", 5), (None, None, 6), (2, "", 7), (3, "w <b>" * 20000, 8)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text long")
    found = html_text.extract(pages).collect()
    assert len(found) == 5 and [(r.title, r.text) for r in found if r.page_id == 1] == [("A & B", "x")] * 2
    assert [(r.title, r.text, r.n_chars) for r in found if r.page_id is None] == [(None, None, None)]
    assert html_text.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 5000])
def test_permutation_is_a_bijection(n):
    out = shards.permute(np.arange(n), n, 99)
    assert sorted(out) == list(range(n))
    assert n < 10 or (out != shards.permute(np.arange(n), n, 100)).any()


TEXTS = ["Hello there", None, "", "tie", "tie", "many words " * 3000, "漢字 🙂"]


def stream(texts):
    code = tokens.encoder(tokens.default_path())
    return [t for ids in code.encode(texts) for t in [*ids.tolist(), 1]]


def in_order(spark, path, layout):
    """The tokens of the records by number, read with plain seeks at the addresses of their slots."""
    out = []
    for slot in shards.permute(np.arange(layout.total), layout.total, layout.key):
        (file,) = (path / "shards" / f"shard={slot // layout.slots_per_shard}").glob("part-*")
        with open(file, "rb") as f:
            f.seek(int(slot) % layout.slots_per_shard * layout.size)
            out += np.frombuffer(f.read(layout.size), "<u2").tolist()
    return out


def test_round_trip(spark, make_docs, tmp_path):
    """Records, read by address in the order of their numbers, are the stream of all tokens in the order of the rows."""
    texts = TEXTS * 3
    docs = make_docs(texts).withColumn("slot", F.lit("mine")).withColumn("shard", F.lit(1)).withColumn("run", F.lit(0)).coalesce(1)
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    layout = shards.write_shards(docs, str(tmp_path / "out"), key=5, stride=64, slots_per_shard=16)
    want = stream(texts)
    got = in_order(spark, tmp_path / "out", layout)
    assert got[: len(want)] == want and set(got[len(want) :]) <= {1} and 0 <= len(got) - len(want) < 64
    found = shards.training_order(docs, 5, path=str(tmp_path / "again"), stride=64, slots_per_shard=16).collect()
    assert sorted(r.slot for r in found) == list(range(layout.total))
    bounds = np.cumsum([0] + [len(stream([t])) for t in texts])
    number = {int(s): k for k, s in enumerate(shards.permute(np.arange(layout.total), layout.total, 5))}
    for r in found:
        lo = number[r.slot] * 64
        assert (r.shard, r.byte_offset) == (r.slot // 16, r.slot % 16 * 128) and r.n_tokens == min(64, len(want) - lo)
        assert r.doc_ids == [i for i in range(len(texts)) if bounds[i] < lo + 64 and bounds[i + 1] > lo]
        assert zlib.crc32(np.array(got[lo : lo + 64], "<u2").tobytes()) == r.record_crc32


def test_order_does_not_depend_on_the_partitions(spark, make_docs, tmp_path):
    make_docs([f"text {k} " * (k % 7) for k in range(300)]).repartition(3).write.option("parquet.block.size", 2000).parquet(str(tmp_path / "in"))
    files = []
    for k, size in enumerate(("128m", "3k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        docs = spark.read.parquet(str(tmp_path / "in"))
        assert k == 0 or docs.rdd.getNumPartitions() > 3
        layout = shards.write_shards(docs, str(tmp_path / f"out{k}"), key=9, stride=32, slots_per_shard=8)
        files.append(in_order(spark, tmp_path / f"out{k}", layout))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files[0] == files[1]


def test_reading_and_writing_go_on_where_they_stopped(spark, make_docs, tmp_path):
    docs = make_docs(["some words here " * k for k in range(60)])
    args = {"key": 3, "stride": 16, "slots_per_shard": 8}
    layout = shards.write_shards(docs, str(tmp_path), **args)
    every = sorted((r.slot, r.shard, r.byte_offset, bytes(r.record)) for r in shards.read_records(spark, str(tmp_path), layout).collect())
    some = sorted((r.slot, r.shard, r.byte_offset, bytes(r.record)) for r in shards.read_records(spark, str(tmp_path), layout, 21, 50).collect())
    assert [r[0] for r in every] == list(range(layout.total)) and some == every[21:50]
    files = {k: next((tmp_path / "shards" / f"shard={k}").glob("part-*")) for k in range(layout.shards)}
    kept = files[0].stat().st_mtime_ns
    files[1].unlink()
    files[2].write_bytes(b"half")
    assert shards.whole_shards(spark, str(tmp_path), layout) == [k for k in range(layout.shards) if k not in (1, 2)]
    shards.write_shards(docs, str(tmp_path), **args)
    again = sorted((r.slot, r.shard, r.byte_offset, bytes(r.record)) for r in shards.read_records(spark, str(tmp_path), layout).collect())
    assert again == every and files[0].stat().st_mtime_ns == kept


def test_no_rows_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    found = shards.training_order(docs, 1, stride=8).collect()
    assert sum(r.n_tokens for r in found) == 4 and [r.doc_ids for r in found] == [[None, None]]
    assert shards.training_order(docs.limit(0), 1).collect() == []
