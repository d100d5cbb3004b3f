"""Copies of pages under several URLs of one host."""

from barflow.llm import page_diff


def test_unmarked_copies_keep_their_text(spark):
    page = lambda i: f"<body><div>Site name</div><div>text of page {i} {i * i}</div><div>All rights reserved</div></body>"
    rows = [(f"{i} {q}", f"http://a.org/p/{i:02d}{q}", page(i)) for i in range(12) for q in ("", "?utm_source=x", "?page=2", "/print")]
    rows += [(f"{i} mirror", f"http://a.org/mirror/{i:02d}", page(i)) for i in range(12)]
    rows += [(f"b {q}", f"http://b.org/{q}", page(99)) for q in ("", "?a", "z")]  # only copies on the host
    rows += [(f"0 extra {q}", f"http://c.org/{q}", f"<article>A</article><p>menu</p><p>{t}</p>") for q, t in (("a", "one"), ("a?x", "one"), ("b", "two"))]
    got = {r["id"]: r["text"] for r in page_diff.extract(spark.createDataFrame(rows, "id string, url string, html string"), ["id"]).collect()}
    assert len(got) == len(rows)
    for k, text in got.items():
        i = k.split()[0]
        if k.startswith("0 extra"):
            assert text == ("A\ntwo" if k.endswith(" b") else "A\none")
        else:
            assert text == ("Site name\ntext of page 99 9801\nAll rights reserved" if i == "b" else f"text of page {int(i)} {int(i) ** 2}"), k
